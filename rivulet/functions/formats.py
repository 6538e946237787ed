"""strftime formats as Java patterns."""

from __future__ import annotations

from rivulet.errors import QueryError

#: Directives and their Java patterns.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "b": "MMM", "h": "MMM", "B": "MMMM", "d": "dd", "e": "d", "a": "EEE", "A": "EEEE", "j": "DDD", "D": "MM/dd/yy", "x": "MM/dd/yy", "F": "yyyy-MM-dd",
    "H": "HH", "I": "hh", "k": "H", "l": "h", "p": "a", "M": "mm", "S": "ss", "f": "SSSSSSSSS", ".f": ".SSSSSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS",
    "R": "HH:mm", "T": "HH:mm:ss", "X": "HH:mm:ss", "r": "hh:mm:ss a", "Z": "zzz", "z": "xx", ":z": "xxx", "n": "'\n'", "t": "'\t'", "%": "%",
}


def java_pattern(text: str) -> str:
    """The Java pattern of a strftime format; formats without % are Java patterns already. Unknown directives are an error."""
    if "%" not in text:
        return text
    out, k, plain = "", 0, ""

    def flush(out: str, plain: str) -> str:
        return out + (("'" + plain.replace("'", "''") + "'") if any(c.isalpha() for c in plain) else plain.replace("'", "''"))

    while k < len(text):
        if text[k] != "%":
            plain += text[k]
            k += 1
            continue
        for size in (3, 2, 1):
            name = text[k + 1 : k + 1 + size]
            if len(name) == size and name in DIRECTIVES:
                out, plain = flush(out, plain) + DIRECTIVES[name], ""
                k += 1 + size
                break
        else:
            raise QueryError(f"no pattern for %{text[k + 1 : k + 3]} in {text!r}")
    return flush(out, plain)
