"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRIP = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text, k=4):
    w = WORD.findall((text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, bits=4, k=4):
    """{position: (fingerprint, component id)} of (id, text) rows."""
    fps = [fingerprint(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [(rows[i][0], f"{fps[i]:016x}", least[find(i)]) for i in range(len(rows))]


def near(rows, similarity, k=5):
    """Component ids of (id, text) rows: links at a Jaccard similarity of the sets of shingles; no words are alike no words."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(UP))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)]


def decontaminate(docs, bench, window=10):
    items = []
    for item, text in bench:
        w = BENCH_WORD.findall((text or "").translate(UP))
        if w:
            items.append(("" if item is None else str(item), {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}))
    sizes = {len(w) for _, ws in items for w in ws}
    out = []
    for doc, text in docs:
        w = BENCH_WORD.findall((text or "").translate(UP))
        hit, found = set(), set()
        where = defaultdict(list)
        for n in sizes:
            for i in range(len(w) - n + 1):
                where[tuple(w[i : i + n])].append(i)
        for item, ws in items:
            for x in ws:
                for i in where.get(x, ()):
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def targets(sizes, share, weights, ceiling):
    """Target of each source of {source: size}: shares by weight, what is over a source's ceiling is shared again."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    while free := [s for s in order if s not in out]:
        unit = max(0.0, left) / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] >= ceiling * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = ceiling * sizes[s]
            left -= out[s]
    return out


def bit_tables(texts, code, buckets, orders, bucket, smooth):
    """Log-ratios by order, bucket and bit from {language: texts}, n-gram by n-gram. bucket(n-gram) gives its place."""
    out = []
    for order in orders:
        rates = []
        for lang in sorted(texts):
            n = [0] * buckets
            for t in texts[lang]:
                for i in range(len(t) - order + 1):
                    n[bucket(t[i : i + order])] += 1
            rates.append([(x + smooth) / (sum(n) + smooth * buckets) for x in n])
        rows = []
        for b in range(buckets):
            row = []
            for bit in range(len(code[0])):
                up = [r[b] for r, c in zip(rates, code) if c[bit] > 0]
                down = [r[b] for r, c in zip(rates, code) if c[bit] < 0]
                row.append(math.log(sum(up) / len(up)) - math.log(sum(down) / len(down)))
            rows.append(row)
        out.append(rows)
    return out


def longest_match(text, bench):
    """(words, item, position) of the longest run of words that is in an item too: the first one, and its first item by name."""
    w, best = BENCH_WORD.findall((text or "").translate(UP)), (0, None, None)
    items = [("" if i is None else str(i), BENCH_WORD.findall((t or "").translate(UP))) for i, t in bench]
    for p in range(len(w)):
        for name, x in items:
            for q in range(len(x)):
                n = 0
                while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                    n += 1
                if n and (-n, p, name) < (-best[0], best[2] if best[0] else 0, best[1] or ""):
                    best = (n, name, p)
    return best


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    spans.sort()
    n = [sum(k == i for _, k, _ in spans) for i in range(3)]
    return (*n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)))


def lines(rows, least=10):
    key = lambda x: x.strip(STRIP).translate(UP)
    held = defaultdict(set)
    rank = lambda d: (d is None, d or 0)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(rank(d))
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(held.get(key(x), ())) >= 2 and min(held[key(x)]) != rank(d))]
        out.append((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(UP)].append(d)
    out = []
    for d, t in rows:
        g = groups[(t or "").translate(UP)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, sha((t or "").translate(UP))))
    return out


def markov_spans(text, model, alphabet, least, base):
    """(start, end) of the random parts of runs, by all parts of each run; base: spans that they mustn't touch."""
    n, out = len(alphabet), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or ""):
        if any(s <= m.start() and m.end() <= e for s, e in base):
            continue
        at = [alphabet.index(c) for c in m[0]]
        ratio = [round(model[a * n + b], 5) for a, b in zip(at, at[1:])]
        best = max(((sum(ratio[i:j]), -i, -j) for i in range(len(ratio)) for j in range(i + 1, len(ratio) + 1)), default=(0, 0, 0))
        if best[0] >= least and not any(s < m.start() - best[2] + 1 and m.start() - best[1] < e for s, e in base):
            out.append((m.start() - best[1], m.start() - best[2] + 1))
    return out
