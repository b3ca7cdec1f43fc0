"""Shared pieces: column picking that survives clashing names, materialised tables in the shared folder, and
vectorised text splitting.

Texts are split with numpy over code points rather than with a regular expression over Python strings: one pass per
batch gives every word's hash and its place in its text, without a Python object per word.
"""

from __future__ import annotations

import itertools
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "__nf_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, names: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """The named columns of ``df``, found by exact name and place.

    Extra columns are dropped, also those whose names differ from the wanted ones only in case, or repeat them (the
    first one counts).
    """
    cols = df.columns
    tmp = df.toDF(*[f"c{i}" for i in range(len(cols))])
    types = types or {}
    return tmp.select(*[(F.col(f"c{cols.index(n)}").cast(types[n]) if n in types else F.col(f"c{cols.index(n)}")).alias(n) for n in names])


def positional(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``df`` with columns renamed c0, c1, ..., the old names, and a map from old name to new (first wins)."""
    cols = df.columns
    where: dict[str, str] = {}
    for i, c in enumerate(cols):
        where.setdefault(c, f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(cols))]), cols, where


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session may go without: it gets one of its
    own; elsewhere executors would write to disks that others can't read, so that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut, and any executor can go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/nearfield-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that :func:`materialise` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/nearfield-{spark.sparkContext.applicationId}/" in folder and root.split("://")[-1] in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application wrote and that nothing dropped; results that weren't stored need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/nearfield-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# -- text splitting ------------------------------------------------------------------------------------------------

_TOP = 0x110000
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def assigned() -> Iterable[int]:
    """Code points that may stand for characters (surrogates, private planes and planes without any left out)."""
    return itertools.chain(range(0xD800), range(0xE000, 0x33480), range(0xE0000, 0xE0200))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Fold: code point -> folded code point (0 where it isn't part of a word); alone: ideographs, each a word."""
    fold, alone = np.zeros(_TOP, np.uint32), np.zeros(_TOP, bool)
    for c in assigned():
        ch = chr(c)
        if 0x3400 <= c < 0xA000 or 0x20000 <= c < 0x2F800 or 0x30000 <= c < 0x33480:
            fold[c], alone[c] = c if ch.isalnum() else 0, ch.isalnum()
        elif ch.isalnum() or unicodedata.category(ch)[0] == "M":
            low = unicodedata.normalize("NFKC", ch).lower()
            fold[c] = ord(low) if len(low) == 1 else ord(ch.lower()[0])
            alone[c] = 0x3040 <= c < 0x3100 or 0xF900 <= c < 0xFB00 or 0x2F800 <= c < 0x2FA20
    return fold, alone


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


class Words(NamedTuple):
    """Words of a batch of texts. start and end count code points within the text; first[i]:first[i+1] are text i's."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts after one another, each with a line break behind it, and where each begins (one more: the end)."""
    texts = [t or "" for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    joined = "\n".join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begin


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """_MULT to the powers 0 .. n-1, modulo 2**64."""
    have = _POWERS[0]
    with np.errstate(over="ignore"):
        while len(have) < n:
            have = np.concatenate([have, have * (have[-1] * _MULT)])
    _POWERS[0] = have
    return have[:n]


def _spans(values: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    """Hash of each span start:end of values, by differences of a running polynomial modulo 2**64."""
    with np.errstate(over="ignore"):
        # position inside a span, so that equal words hash alike wherever they stand
        width = int((ends - starts).max()) if len(starts) else 1
        powers = _powers(width + 1)
        lengths = ends - starts
        offset = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(starts, lengths) + offset
        terms = (values[at].astype(np.uint64) + np.uint64(1)) * powers[offset]
        cut = np.cumsum(lengths) - lengths
        h = np.add.reduceat(terms, cut) if len(cut) else np.empty(0, np.uint64)
        h = mix(h + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(begin, starts, side="right") - 1
    first = np.searchsorted(starts, begin)
    base = begin[doc]
    return Words(h, starts - base, ends - base, first)


def words(texts: Sequence[str | None]) -> Words:
    """Words (runs of letters, digits and marks, folded to lower case; each ideograph alone) of every text."""
    cps, begin = code_points(texts)
    fold, alone = _tables()
    folded = fold[cps]
    inside = folded != 0
    single = alone[cps]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = inside & ~before
    ends = before & ~inside
    if single.any():
        wide = single | np.concatenate([[False], single[:-1]])
        starts |= inside & wide
        ends |= before & inside & wide
    return _spans(folded, begin, np.flatnonzero(starts), np.flatnonzero(ends))


@lru_cache(1)
def _blank() -> np.ndarray:
    out = np.zeros(_TOP, bool)
    out[[c for c in assigned() if chr(c).isspace()]] = True
    return out


def chunks(texts: Sequence[str | None]) -> Words:
    """What str.split() gives, unfolded, for every text."""
    cps, begin = code_points(texts)
    inside = ~_blank()[cps]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    return _spans(cps, begin, np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes; entry i covers i .. i+n-1. Runs across texts have to be left out by the caller."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0xC6A4A7935BD1E995) + h[k : len(h) - n + 1 + k]
    return mix(out)


def of_doc(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def slices(texts: list, most_chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about most_chars together: bounds the arrays, never cuts a text."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= most_chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
