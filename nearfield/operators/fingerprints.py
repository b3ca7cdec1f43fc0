"""Fingerprint tables. The driver's vectors stand in for images: their signs and gradients are the two hashes, their
rounded values the visual signature and the sizes, runs of them the local features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import bits

HOTS = 8  # local features of a fingerprint


def fingerprints(embeddings: DataFrame) -> DataFrame:
    """id, label, ph, dh, grid (64 bytes), luma, contrast, rgb, blocks, width, height."""
    q = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 40.0 + 128.0))).cast("int"))
    e = F.col("embedding")
    ph = bits.word_from_bits(F.transform(e, lambda x: x > 0))
    dh = bits.word_from_bits(F.transform(e, lambda x, i: e[F.pmod(i + 1, F.lit(64))] > x))
    d = embeddings.select(F.col("vec_id").alias("id"), "label", ph.alias("ph"), dh.alias("dh"), q.alias("grid"))
    g = F.col("grid")
    return d.withColumns({"luma": g[3], "contrast": g[4], "rgb": F.slice(g, 1, 3), "blocks": F.slice(g, 1, 16), "width": 640 + g[5] * 4, "height": 640 + g[6] * 4})


def local_features(embeddings: DataFrame) -> DataFrame:
    """id, ord, hash, hash2, pos_x, pos_y, luma, contrast, edge, region: HOTS rows for each fingerprint."""
    d = fingerprints(embeddings).join(embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")
    e, g = F.col("embedding"), F.col("grid")
    word = lambda k, s: bits.word_from_bits(F.transform(e, lambda x, i: e[F.pmod(i + k * 8 + s, F.lit(64))] > x))
    rows = [F.struct(F.lit(k).alias("ord"), word(k, 3).alias("hash"), word(k, 5).alias("hash2"), g[k].alias("pos_x"), g[k + 8].alias("pos_y"), g[k + 16].alias("luma"), g[k + 24].alias("contrast"), g[k + 32].alias("edge"), F.pmod(g[k + 40], F.lit(64)).alias("region")) for k in range(HOTS)]
    return d.select("id", F.explode(F.array(*rows)).alias("f")).select("id", "f.*")


def split(fp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specimens (four of five) and candidates."""
    return fp.filter("id % 5 <> 0"), fp.filter("id % 5 = 0")
