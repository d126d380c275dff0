"""Two glob dialects as Java regexes."""

from __future__ import annotations

import re

_META = set(".^$+{}[]()|\\")


def _quoted(c: str) -> str:
    return "\\" + c if c in _META else c


def path_glob(glob: str) -> str:
    """`*` and `?` stay inside a path segment; `**` crosses segments. Anchored; backslashes count as slashes."""
    glob, out = glob.replace("\\", "/"), []
    for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]", glob):
        out.append({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or _quoted(part))
    return "^" + "".join(out) + "$"


def _set(inner: str) -> str:
    """A character set of a glob; ranges that run backwards hold nothing."""
    negated, inner = inner[:1] == "!", inner.removeprefix("!")
    parts, k = [], 0
    while k < len(inner):
        if inner[k + 1 : k + 2] == "-" and k + 2 < len(inner):
            if inner[k] <= inner[k + 2]:
                parts.append(f"{_member(inner[k])}-{_member(inner[k + 2])}")
            k += 3
        else:
            parts.append(_member(inner[k]))
            k += 1
    return "[" + ("^" if negated else "") + "".join(parts) + "]" if parts else "." if negated else r"[^\s\S]"


def _member(c: str) -> str:
    return "\\" + c if c in r"\[]^-&" else c


def shell_regex(glob):
    """shell_glob for a column of patterns, in Spark: tokens are quoted, wild cards and closed sets translated."""
    from pyspark.sql import functions as F

    def one(t):
        ranges = F.regexp_extract_all(F.regexp_replace(t, r"^\[!?|\]$", ""), F.lit("(?s)(.-.|.)"), F.lit(1))
        kept = F.array_join(F.transform(F.filter(ranges, lambda r: (F.char_length(r) < 3) | (F.substring(r, 1, 1) <= F.substring(r, 3, 1))), lambda r: F.when(F.char_length(r) == 3, F.concat(_escaped(F.substring(r, 1, 1)), F.lit("-"), _escaped(F.substring(r, 3, 1)))).otherwise(_escaped(r))), "")
        negated = t.startswith("[!")
        closed = F.when(kept == "", F.when(negated, F.lit(".")).otherwise(F.lit(r"[^\s\S]"))).otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), kept, F.lit("]")))
        return F.when(t == "*", ".*").when(t == "?", ".").when(F.char_length(t) > 1, closed).otherwise(F.regexp_replace(t, r"([^A-Za-z0-9_\s])", r"\\$1"))

    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\[!?\]?[^\]]*\]|.)"), F.lit(1))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("$"))


def _escaped(c):
    from pyspark.sql import functions as F

    return F.regexp_replace(c, r"([\\\[\]^\-&])", r"\\$1")


def shell_glob(glob: str) -> str:
    """`*` and `?` match any character, slashes too; character sets as in a shell. Anchored."""
    out, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := glob.find("]", i + (glob[i : i + 1] == "!") + 1)) > 0:
            out.append(_set(glob[i:end]))
            i = end + 1
        else:
            out.append(_quoted(c))
    return "(?s)^" + "".join(out) + "$"


def denied(path, globs: list[str]):
    """Whether a path column matches a glob: by its whole path if the glob has a slash, else by its last name."""
    from pyspark.sql import functions as F

    name = F.substring_index(path, "/", -1)
    tests = [(path if "/" in g else name).rlike(path_glob(g)) for g in globs]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
