"""Secret scans in DataFrame functions only: three fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over the characters of a token, one of random strings and one of ordinary identifiers, are
trained from labelled samples by counting transitions: generated ones, and tokens of a sample of the documents, of which those
that a pattern matches are labelled random and the others ordinary. The part of a token with the greatest log-likelihood ratio
is a span if the ratio outweighs the prior odds, so that short parts need clearer evidence and a key is found behind ordinary words.
Spark has no match positions, so they are sums of the lengths of what a pattern splits off and of what it matches.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds in their order, their patterns and least lengths (assign: of its second group). Tests of a first character
#: and of the one before a run keep other positions cheap; they change no match.
ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6
#: Characters of a candidate token, in the order of the models' tables, and a candidate's least length.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Prior share of random strings among parts of tokens: a part counts as random if its log-likelihood ratio is over the prior odds.
PRIOR = 1e-10
#: Counts that a character's own rate weighs in the rate of a transition.
BACK_OFF = 20.0
#: Documents of the sample that labelled tokens are taken from, and the least length of its ordinary ones.
SAMPLE_ROWS, SAMPLE_LENGTH = 2000, 6
BLOCK = 256
#: Ordinary words that identifiers are made of in the default labelled sample.
WORDS = (
    "account", "action", "address", "array", "balance", "batch", "buffer", "button", "cache", "channel", "client", "column", "config", "connection", "content", "context", "counter", "create", "customer", "data",
    "delete", "directory", "document", "element", "engine", "error", "event", "factory", "field", "file", "filter", "format", "function", "group", "handler", "header", "identifier", "image", "index", "input",
    "instance", "interface", "internal", "iterator", "language", "length", "listener", "location", "manager", "message", "method", "model", "module", "network", "number", "object", "operation", "option", "order", "output",
    "package", "parameter", "parser", "partition", "password", "pattern", "platform", "process", "product", "property", "provider", "query", "reader", "record", "reference", "request", "resource", "response", "result", "schema",
    "section", "server", "service", "session", "source", "status", "storage", "stream", "string", "structure", "system", "table", "template", "thread", "transaction", "update", "user", "value", "version", "window",
)


def labelled_samples(spark: SparkSession, rows: int = 1000) -> DataFrame:
    """token, random: strings derived from SHA-512 in base 64, base 64 without signs, upper case and hex; and identifiers of two to
    four of WORDS in camel case, snake case, kebab case, as paths and run together, and runs of one character. `rows` of each form."""
    ids = spark.range(rows).withColumn("h", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512))
    size = (20 + F.col("id") % 21).cast("int")
    code = F.base64(F.unhex("h"))
    random = [code, F.translate(code, "+/=\n", ""), F.upper(F.translate(code, "+/=", "")), F.col("h")]
    words = F.array(*[F.lit(w) for w in WORDS])
    word = [words[F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(WORDS))).cast("int")] for k in range(4)]
    cap = [F.initcap(w) for w in word]
    plain = [F.concat(word[0], cap[1], cap[2]), F.concat_ws("_", *word[:3]), F.concat_ws("-", *word), F.concat_ws("/", *word), F.concat(*word[:3]), F.upper(F.concat_ws("_", *word[:3])), F.concat(cap[0], cap[1], cap[2], (F.col("id") % 100).cast("string")), F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), size)]
    forms = [(F.substring(x, F.lit(1), size), True) for x in random] + [(x, False) for x in plain]
    return ids.select(F.explode(F.array(*[F.struct(x.alias("token"), F.lit(r).alias("random")) for x, r in forms])).alias("x")).select("x.token", "x.random")


def corpus_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """token, random: from at most `rows` documents that a hash of their ids picks. What the base patterns match (of `assign`: values of
    16 characters or more) is random, the tokens of the rest are ordinary. Distinct tokens count once. Null ids and texts are left out."""
    ids = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"))
    chosen = ids.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id", "left_semi").select("t")  # `rows` ids at most
    values = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 1), (ACCESS, 0), (HEX, 0))])
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.array_distinct(F.regexp_extract_all(rest, F.lit(f"[A-Za-z0-9+/_=-]{{{SAMPLE_LENGTH},}}"), F.lit(0)))
    keys = F.transform(F.filter(values, lambda x: F.length(x) >= 16), lambda x: F.struct(x.alias("token"), F.lit(True).alias("random")))
    names = F.transform(plain, lambda x: F.struct(x.alias("token"), F.lit(False).alias("random")))
    return texts.select(F.explode(F.concat(keys, names)).alias("x")).select("x.token", "x.random").distinct()


def numbered(token: Column) -> Column:
    """Places of a token's characters in ALPHABET, from 1; 0: none."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def train(samples: DataFrame, token_col: str = "token", label_col: str = "random") -> list[float]:
    """Log-ratios of the transitions, random over ordinary, one row of ALPHABET's length for each first character.

    Null tokens and labels and characters outside ALPHABET are left out. A transition's rate is mixed with BACK_OFF counts' worth of
    the second character's own rate, which has add-one smoothing.
    """
    n = len(ALPHABET)
    places = samples.where(F.col(token_col).isNotNull() & F.col(label_col).isNotNull() & (F.length(token_col) > 1)).select(F.col(label_col).cast("boolean").alias("r"), numbered(F.col(token_col)).alias("p"))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: (a - 1) * n + b - 1)
    pairs = places.where(~F.array_contains("p", 0)).select("r", F.explode(steps).alias("t"))
    counts: dict[bool, list[float]] = {True: [0.0] * (n * n), False: [0.0] * (n * n)}
    for row in pairs.groupBy("r", "t").agg(F.count(F.lit(1)).alias("n")).collect():  # 2 x 67 x 67 rows at most
        counts[row["r"]][row["t"]] += row["n"]
    rates = {}
    for label, table in counts.items():
        own = [(sum(table[j::n]) + 1) / (sum(table) + n) for j in range(n)]
        rates[label] = [(x + BACK_OFF * own[k % n]) / (sum(table[k // n * n : k // n * n + n]) + BACK_OFF) for k, x in enumerate(table)]
    return [math.log(a / b) for a, b in zip(rates[True], rates[False])]


def random_part(token: Column, model: list[float]) -> Column:
    """The part of a token with the greatest sum of log-ratios: score, begin and end (characters of the token, end exclusive).

    Characters outside ALPHABET don't occur in candidates. Sums start anew where they fall to 0 or less.
    """
    n = len(ALPHABET)
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")  # folded into one literal

    def step(a: Column, p: Column) -> Column:
        ratio = F.element_at(table, ((a["last"] - 1) * n + p).cast("int"))
        total = F.when(a["last"] > 0, a["sum"] + ratio).otherwise(F.lit(0.0))
        on = total > 0
        better = total > a["score"]
        return F.struct(
            F.when(on, total).otherwise(F.lit(0.0)).alias("sum"), p.alias("last"), (a["at"] + 1).alias("at"), F.when(on, a["start"]).otherwise(a["at"]).alias("start"),
            F.when(better, total).otherwise(a["score"]).alias("score"), F.when(better, a["start"]).otherwise(a["begin"]).alias("begin"), F.when(better, a["at"] + 1).otherwise(a["end"]).alias("end"),
        )

    zero = F.struct(*[F.lit(0.0 if k in ("sum", "score") else 0).alias(k) for k in ("sum", "last", "at", "start", "score", "begin", "end")])
    return F.aggregate(numbered(token), zero, step)


def running(sizes: Column) -> Column:
    """Sums of all values before each, in blocks: about BLOCK / 2 steps a value, however many there are."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    before = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, b: F.struct((a["at"] + F.aggregate(b, F.lit(0), lambda s, x: s + x)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))["all"]
    return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b, lambda x, i: at + F.aggregate(F.slice(b, F.lit(1), i), F.lit(0), lambda s, y: s + y))))


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def with_matches(df: DataFrame, text: str, pattern: str, name: str, kind: int, group: int = 0) -> DataFrame:
    """Column `name`: leftmost non-overlapping matches as (start, kind, end, value of the group), in code points.

    One step a projection: what a step uses twice isn't evaluated twice.
    """
    t, hit = F.col(text), F.col(text).rlike(pattern)
    none, whole, size, gap, value, step = F.array().cast("array<int>"), *(f"{name}_{x}" for x in ("whole", "size", "gap", "value", "step"))
    strings = F.array().cast("array<string>")
    df = df.withColumns({
        whole: F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(strings),
        gap: F.when(hit, F.transform(F.split(t, pattern, -1), lambda x: F.length(x))).otherwise(none),
        **({value: F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(strings)} if group else {}),
    })
    df = df.withColumn(size, F.transform(whole, lambda x: F.length(x)))
    df = df.withColumn(gap, F.slice(gap, F.lit(1), F.size(size)))
    value = value if group else whole
    df = df.withColumn(step, F.zip_with(gap, size, lambda a, b: a + b))
    df = df.withColumn(step, running(F.col(step)))
    spans = F.transform(
        F.arrays_zip(step, gap, size, value),
        lambda r: F.struct((r[step] + r[gap]).alias("start"), F.lit(kind).alias("kind"), (r[step] + r[gap] + r[size]).alias("end"), r[value].alias("value")),
    )
    return df.withColumn(name, F.when(F.size(size) > 0, spans).otherwise(F.array().cast(SPAN))).drop(size, gap, whole, value, step)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """One row per document: id_col, base and all: arrays of (start, kind, end, value), by start, then kind as in KINDS.

    Positions are code points, ends exclusive. Null texts are empty. A Markov span is the random part of a run of 16 or more
    characters of ALPHABET, if no base span touches the part; a run has one at most. Rows with null or repeated ids stay as they are; other columns are ignored.
    """
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for name, pattern, kind, group in (("assign", ASSIGN, 0, 1), ("access", ACCESS, 1, 0), ("hex", HEX, 2, 0), ("candidates", CANDIDATE, 3, 0)):
        found = with_matches(found, "t", pattern, name, kind, group)
    long_value = F.filter("assign", lambda s: F.length(s["value"]) >= LEAST_VALUE)
    found = found.select("id", F.array_sort(F.concat(long_value, "access", "hex")).alias("base"), "candidates")
    whole = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    parts = F.transform(whole, lambda c: F.struct(c.alias("c"), random_part(c["value"], model).alias("r")))
    found = found.withColumn("parts", parts)
    random = F.filter("parts", lambda x: x["r"]["score"] >= math.log((1 - prior) / prior))
    spans = F.transform(random, lambda x: F.struct((x["c"]["start"] + x["r"]["begin"]).alias("start"), F.lit(3).alias("kind"), (x["c"]["start"] + x["r"]["end"]).alias("end"), F.substring(x["c"]["value"], x["r"]["begin"] + 1, x["r"]["end"] - x["r"]["begin"]).alias("value")))
    more = F.filter(spans, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", more)).alias("all"))
