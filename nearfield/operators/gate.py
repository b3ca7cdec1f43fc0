"""Fuzzy text gate: sentences, then keywords, decide whether a text confirms what the hashes suspect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import text as tx
from nearfield.plans.policy import TextGate


def patterns(values: tuple[str, ...]) -> list[str]:
    """Normalised patterns, the first of equals kept, empty ones dropped."""
    return [p for p in dict.fromkeys(map(tx.plain, values)) if p]


def evaluate(d: DataFrame, id_: str, text: str, gate: TextGate) -> DataFrame:
    """id_, sentence_hit, keyword_hits, decision, verdict and confidence of every text."""
    out = d.select(id_, F.col(text).alias("t"))
    if not gate.enabled:
        return out.select(id_, F.lit(False).alias("sentence_hit"), F.lit(0).alias("keyword_hits"), F.lit("disabled").alias("decision"), F.lit("disabled").alias("verdict"), F.lit(1.0).cast("float").alias("confidence"))
    kw, sn = patterns(gate.keywords), patterns(gate.sentences)
    normal = F.col("normal")
    unread = F.coalesce(F.trim("t"), F.lit("")) == ""
    sentence = F.lit(False)
    for p in sn:
        sentence = sentence | tx.contains_phrase(normal, p, gate.sentence_max_distance)
    hits = F.lit(0)
    for p in kw:
        hits = hits + tx.contains_phrase(normal, p, tx.limit_of(p, gate.keyword_max_distance)).cast("int")
    none = F.lit(not kw and not sn)
    out = out.withColumn("normal", tx.normalize(F.coalesce("t", F.lit("")))).withColumns({"sentence_hit": sentence, "keyword_hits": hits})
    decision = (
        F.when(none, "unavailable").when(unread, "no_text").when(F.col("sentence_hit"), "confirmed_sentence")
        .when((F.col("keyword_hits") >= gate.keyword_threshold) & F.lit(gate.keyword_threshold > 0), "confirmed_keywords").when(F.col("keyword_hits") > 0, "partial_keywords").otherwise("rejected")
    )
    out = out.withColumn("decision", decision)
    share = F.least(F.greatest((F.col("keyword_hits").cast("float") / F.lit(max(gate.keyword_threshold, 1)).cast("float")).cast("float"), F.lit(0.25).cast("float")), F.lit(0.75).cast("float"))
    c = F.col("decision")
    return out.select(
        id_, F.col("sentence_hit") & ~c.isin("unavailable", "no_text"), F.when(c.isin("unavailable", "no_text"), 0).otherwise(F.col("keyword_hits")).alias("keyword_hits"), "decision",
        F.when(c.isin("confirmed_sentence", "confirmed_keywords"), "bad").when(c == "rejected", "good").otherwise("unknown").alias("verdict"),
        F.when(c == "confirmed_sentence", 0.95).when(c == "confirmed_keywords", 0.9).when(c == "partial_keywords", share.cast("double")).when(c == "rejected", 0.75).otherwise(0.0).cast("float").alias("confidence"),
    ).toDF(id_, "sentence_hit", "keyword_hits", "decision", "verdict", "confidence")


def two_phase(decisions: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Suspicious decisions take their text verdict: bad confirms, good clears, all else leaves them as they are."""
    d = decisions.join(verdicts.select(key, "verdict"), key, "left")
    s = F.col("decision") == "suspicious"
    return d.withColumn("final", F.when(s & (F.col("verdict") == "bad"), "confirmed").when(s & (F.col("verdict") == "good"), "pass").otherwise(F.col("decision")))
