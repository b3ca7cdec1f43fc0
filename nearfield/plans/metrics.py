"""Queries on events and messages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators import local, metrics
from nearfield.sources import records
from nearfield.streaming import streams

from .tables import load

KINDS = ["click", "view", "purchase", "error"]


def _events(spark, sf):
    d = load(spark, sf, "events")
    return d.select("event_id", "ts", "user_id", "event_type", (F.col("user_id") % 10).alias("guild"), F.floor(F.col("value") * 1000).alias("us"))


def metric_counters(spark, sf):
    return metrics.counters(_events(spark, sf), "guild", "event_type", KINDS)


def timing_ring(spark, sf):
    return metrics.timing(_events(spark, sf), ["guild"], ["ts", "event_id"], "us", 512)


def class_breakdown(spark, sf):
    return metrics.timing(_events(spark, sf), ["guild", "event_type"], ["ts", "event_id"], "us", 128)


def perf_snapshot(spark, sf):
    return metrics.snapshot(_events(spark, sf), ["guild"], ["ts", "event_id"], "us", F.col("event_type") != "error", 512)


def percentiles_4ways(spark, sf):
    from nearfield.functions import stats

    ranks = {"round_": lambda n: F.floor((n - 1) * F.lit(0.95) + 0.5), "ceil_": lambda n: F.ceil((n - 1) * 95 / 100), "half_up": lambda n: F.floor(((n - 1) * 95 + 50) / 100), "quarter": lambda n: F.floor(n * 3 / 4)}
    return stats.counted_ranks(_events(spark, sf), ["event_type"], "us", ranks)


def benchmark_stats(spark, sf):
    """Durations by kind of event, as a benchmark reports its steps."""
    from nearfield.functions import stats

    return stats.duration_stats(_events(spark, sf).filter("us > 0"), ["event_type"], "us")


def period_report(spark, sf):
    return metrics.period_report(_events(spark, sf), "guild", "ts", 6)


def rollup_report(spark, sf):
    return metrics.rollup_report(_events(spark, sf), "guild", F.to_date("ts"))


def replay_newest_wins(spark, sf):
    return records.replay(_events(spark, sf), "user_id", ["event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


def latest_config(spark, sf):
    return _events(spark, sf).groupBy("guild").agg(F.max_by(F.struct("event_type", "us"), F.struct("ts", "event_id")).alias("c")).select("guild", "c.event_type", "c.us")


def log_recovery(spark, sf):
    """Records that failed to parse (values below 5) are rebuilt from the raw log and appended."""
    raw = _events(spark, sf).select("event_id", "us")
    return records.recover(raw, raw.filter("us >= 5000").select("event_id", "us", F.lit("parsed").alias("how")), "event_id", lambda d: d.select("event_id", (F.col("us") * 2).alias("us"), F.lit("rebuilt").alias("how")))


def bounded_dedup(spark, sf):
    """First event of each user and type in every ten minutes of event time."""
    d = _events(spark, sf)
    g = d.groupBy("user_id", "event_type", F.window("ts", "10 minutes").start.alias("w")).agg(F.min("event_id").alias("event_id"))
    return g.select("user_id", "event_type", "event_id")


def lru_dedup(spark, sf):
    return metrics.lru_dedupe(_events(spark, sf).select("guild", "user_id", "event_id"), "guild", "user_id", ["event_id"], 3, "guild bigint, user_id bigint, event_id bigint")


def decision_memo(spark, sf):
    return metrics.memo(_events(spark, sf).select("event_id", "guild", "event_type"), ["guild", "event_type"], F.when(F.col("guild") % 2 == 0, "match").otherwise("pass"), ["event_id"]).select("event_id", "decision", "reused")


def sibling_escalation(spark, sf):
    """Turns without a match of conversations that have a confirmed one, whichever came first."""
    d = load(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 5 == 0).alias("confirmed"))
    yes = d.filter("confirmed").select("conv_id").distinct()
    return d.filter("not confirmed").join(yes, "conv_id", "left_semi").select("conv_id", "turn", F.lit("message_sibling").alias("reason"))


def last_rows_frame(spark, sf):
    w = Window.partitionBy("guild").orderBy("ts", "event_id").rowsBetween(-511, 0)
    return _events(spark, sf).select("event_id", F.count("*").over(w).alias("n"), F.max("us").over(w).alias("most"))


def stride_sample(spark, sf):
    return local.stride(_events(spark, sf).select("guild", "event_id"), "guild", "event_id", 100).select("guild", "event_id")


def budget_prefix(spark, sf):
    d = _events(spark, sf)
    n = F.count("*").over(Window.partitionBy("guild", "event_type"))
    return local.budget(d.withColumn("size", n).select("guild", "event_type", "event_id", "size"), "guild", "size", ["event_type", "event_id"], 50).select("guild", "event_id", "place")


def best_step(spark, sf):
    """Of each user the best step by type, value and age, lexicographically."""
    return _events(spark, sf).groupBy("user_id").agg(F.max_by("event_id", F.struct("event_type", "us", -F.col("event_id"))).alias("event_id"))


def stream_counts(spark, sf):
    return streams.counts(spark, f"{sf}/events.parquet")


def stream_dedup(spark, sf):
    return streams.dedup(spark, f"{sf}/events.parquet")


def stream_siblings(spark, sf):
    return streams.siblings(spark, f"{sf}/conversations.parquet")


def stream_append_new(spark, sf):
    return streams.append_sink(spark, f"{sf}/events.parquet")


QUERIES = {f.__name__: f for f in (metric_counters, timing_ring, class_breakdown, perf_snapshot, percentiles_4ways, period_report, rollup_report, benchmark_stats, replay_newest_wins, latest_config, log_recovery, bounded_dedup, lru_dedup, decision_memo, sibling_escalation, last_rows_frame, stride_sample, budget_prefix, best_step, stream_counts, stream_dedup, stream_siblings, stream_append_new)}

_E = "e AS (SELECT event_id, ts, user_id, event_type, user_id % 10 AS guild, floor(value * 1000)::BIGINT AS us FROM events)"


def _timing(keys: str, cap: int) -> str:
    return f"""WITH {_E}, s AS (SELECT * FROM e WHERE us > 0), n AS (SELECT {keys}, count(*) AS count FROM s GROUP BY {keys}), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, event_id DESC) <= {cap}),
      v AS (SELECT {keys}, list_sort(list(us)) AS v FROM r GROUP BY {keys}) SELECT {keys}, count, floor(list_sum(v) / len(v))::BIGINT AS average, v[len(v)] AS most, v[((len(v) - 1) * 95 + 50) // 100 + 1] AS p95, v[((len(v) - 1) * 99 + 50) // 100 + 1] AS p99 FROM n JOIN v USING ({keys})"""


_PERIOD = "SELECT guild, period, n, sum(n) OVER (PARTITION BY guild ORDER BY period)::BIGINT AS running FROM (SELECT guild, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS period, count(*) AS n FROM e GROUP BY ALL)"

ORACLE_SQL = {
    "lru_dedup": f"""WITH {_E}, r AS (SELECT guild, user_id, event_id, row_number() OVER (PARTITION BY guild ORDER BY event_id) AS rn FROM e), p AS (SELECT *, lag(rn) OVER (PARTITION BY guild, user_id ORDER BY rn) AS prev FROM r)
      SELECT guild, user_id, event_id FROM p WHERE prev IS NULL OR (SELECT count(DISTINCT o.user_id) FROM r o WHERE o.guild = p.guild AND o.rn > p.prev AND o.rn < p.rn) >= 3""",
    "metric_counters": f"WITH {_E} SELECT guild, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE event_type = {k!r}) AS n_{k}' for k in KINDS)} FROM e GROUP BY guild",
    "timing_ring": _timing("guild", 512),
    "class_breakdown": _timing("guild, event_type", 128),
    "perf_snapshot": f"""WITH {_E}, n AS (SELECT guild, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures FROM e GROUP BY guild), r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY guild ORDER BY ts DESC, event_id DESC) <= 512),
      v AS (SELECT guild, list_sort(list(us)) AS v FROM r GROUP BY guild) SELECT guild, successes, failures, v[1] AS least, v[len(v)] AS most, floor(list_sum(v) / len(v))::BIGINT AS average, {', '.join(f'v[floor((len(v) - 1) * {q / 100}::DOUBLE + 0.5)::INT + 1] AS p{q}' for q in (50, 90, 95, 99))} FROM n JOIN v USING (guild)""",
    "benchmark_stats": f"WITH {_E}, v AS (SELECT event_type, list_sort(list(us)) AS v FROM e WHERE us > 0 GROUP BY 1) SELECT event_type, len(v) AS count, v[1] AS min, v[len(v)] AS max, round(list_sum(v)::DOUBLE / len(v), 6) AS avg, {', '.join(f'v[floor((len(v) - 1) * {p / 100}::DOUBLE + 0.5)::INT + 1] AS p{p}' for p in (50, 90, 95, 99))} FROM v",
    "percentiles_4ways": f"WITH {_E}, v AS (SELECT event_type, list_sort(list(us)) AS v FROM e GROUP BY 1) SELECT event_type, v[floor((len(v) - 1) * 0.95::DOUBLE + 0.5)::INT + 1] AS round_, v[ceil((len(v) - 1) * 95 / 100.0::DOUBLE)::INT + 1] AS ceil_, v[((len(v) - 1) * 95 + 50) // 100 + 1] AS half_up, v[len(v) * 3 // 4 + 1] AS quarter FROM v",
    "period_report": f"WITH {_E} {_PERIOD}",
    "rollup_report": f"WITH {_E} SELECT guild, ts::DATE AS day, count(*) AS n FROM e GROUP BY GROUPING SETS ((guild, day), (guild))",
    "replay_newest_wins": f"WITH {_E}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT user_id, event_id, event_type FROM l WHERE event_type <> 'error'",
    "latest_config": f"WITH {_E} SELECT guild, event_type, us FROM e QUALIFY row_number() OVER (PARTITION BY guild ORDER BY ts DESC, event_id DESC) = 1",
    "log_recovery": f"WITH {_E} SELECT event_id, CASE WHEN us >= 5000 THEN us ELSE us * 2 END AS us, CASE WHEN us >= 5000 THEN 'parsed' ELSE 'rebuilt' END AS how FROM e",
    "bounded_dedup": f"WITH {_E} SELECT user_id, event_type, min(event_id) AS event_id FROM e GROUP BY user_id, event_type, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01')",
    "decision_memo": f"WITH {_E} SELECT event_id, CASE WHEN guild % 2 = 0 THEN 'match' ELSE 'pass' END AS decision, row_number() OVER (PARTITION BY guild, event_type ORDER BY event_id) > 1 AS reused FROM e",
    "sibling_escalation": "SELECT conv_id, turn, 'message_sibling' AS reason FROM conversations WHERE length(text) % 5 <> 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE length(text) % 5 = 0)",
    "last_rows_frame": f"WITH {_E} SELECT event_id, count(*) OVER w AS n, max(us) OVER w AS most FROM e WINDOW w AS (PARTITION BY guild ORDER BY ts, event_id ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)",
    "stride_sample": f"WITH {_E}, r AS (SELECT guild, event_id, row_number() OVER (PARTITION BY guild ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY guild) AS n FROM e) SELECT guild, event_id FROM r WHERE (rn - 1) % CASE WHEN n > 100 THEN ceil(n / 100.0)::INT ELSE 1 END = 0",
    "budget_prefix": f"WITH {_E}, s AS (SELECT *, count(*) OVER (PARTITION BY guild, event_type) AS size FROM e) SELECT guild, event_id, row_number() OVER (PARTITION BY guild ORDER BY size, event_type, event_id) AS place FROM s QUALIFY place <= 50",
    "best_step": f"WITH {_E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, us DESC, event_id) = 1",
    "stream_counts": f"WITH {_E} SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS period, count(*) AS n FROM e GROUP BY ALL",
    "stream_dedup": f"WITH {_E} SELECT DISTINCT user_id, event_type FROM e",
    "stream_siblings": "SELECT conv_id, turn FROM conversations WHERE length(text) % 5 <> 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE length(text) % 5 = 0)",
    "stream_append_new": f"WITH {_E} SELECT DISTINCT guild, event_type FROM e",
}
