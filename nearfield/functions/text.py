"""Text normalisation, bounded edit distance and the text gate's pieces."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(x: Column) -> Column:
    """Lower case, each run of signs and blanks one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def tokens(x: Column) -> Column:
    n = normalize(x)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def limit_of(keyword: str, configured: int) -> int:
    n = len("".join(keyword.split()))
    return min(configured, 0 if n <= 4 else 1 if n <= 8 else 2)


def keyword_limit(keyword: Column, configured: Column | int) -> Column:
    n = F.length(F.regexp_replace(keyword, r"\s", ""))
    return F.least(configured if isinstance(configured, Column) else F.lit(configured), F.when(n <= 4, 0).when(n <= 8, 1).otherwise(2))


def plain(pattern: str) -> str:
    """A pattern as :func:`normalize` would make it."""
    return regex.sub(r"[^\p{L}\p{N}]+", " ", pattern.lower()).strip()


def windows(toks: Column, n: int) -> Column:
    """Runs of n tokens, each joined by blanks.

    Built by zipping the array with itself, shifted: no lambda refers to the whole array, which would be computed
    anew for each token wherever the optimiser inlines it.
    """
    out = toks
    for k in range(1, n):
        m = F.greatest(F.size(toks) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), m), F.slice(toks, F.lit(k + 1), m), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def contains_phrase(normal: Column, pattern: str, limit: int) -> Column:
    """Whether a run of as many tokens of a normalised text as the (normalised) pattern has is within limit edits of it.

    What is within limit edits holds one of limit + 1 pieces of the pattern unchanged, so windows are built, and
    distances taken, only for texts that hold a piece. Without edits no windows are needed.
    """
    if limit == 0:
        return F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {pattern} ")
    n = len(pattern)
    cuts = [n * k // (limit + 1) for k in range(limit + 2)]

    def within(t: Column) -> Column:
        near = F.lit(False)
        for a, b in zip(cuts, cuts[1:], strict=False):
            near = near | t.contains(pattern[a:b])
        w = windows(F.split(t, " "), len(pattern.split()))
        return near & F.exists(w, lambda x: (F.abs(F.length(x) - n) <= limit) & (F.levenshtein(x, F.lit(pattern), limit) >= 0))

    # bound by a lambda, a text is normalised once, wherever the optimiser moves this
    return F.coalesce(F.exists(F.array(normal), within), F.lit(False))


def truncate(x: Column, n: int = 160) -> Column:
    return F.substring(x, 1, n)


def file_stem(x: Column) -> Column:
    """Name that is safe as a file's: other characters become "_"; "image" where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(x, r"\.[^.]*$", ""), r"[^A-Za-z0-9_-]", "_")
    return F.when(F.coalesce(s, F.lit("")) == "", "image").otherwise(s)


def percent_label(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, cut, not rounded: 2 of 3 are 66.6%."""
    tenths = F.floor(part.cast("bigint") * 1000 / whole)
    return F.when(whole == 0, "0.0%").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def ms_label(ms: Column) -> Column:
    return F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))
