"""Queries on texts, urls and records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import media, text
from nearfield.operators import fingerprints, gate
from nearfield.plans.policy import TextGate
from nearfield.sources import records

from .tables import load

GATE = TextGate(enabled=True, keywords=("attion", "Thanedble!", "erth", "the anea", "thonn", "ertion"), sentences=("The and attion to thanedble the, anea.", "is her inor the"), keyword_threshold=2)
HOSTS = ["example.com", "example.org"]


def text_normalize(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))


def keyword_limits(spark, sf):
    w = load(spark, sf, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("keyword")).distinct()
    return w.select("keyword", *[text.keyword_limit(F.col("keyword"), k).alias(f"limit_{k}") for k in (0, 1, 3)])


def text_gate_verdict(spark, sf):
    d = load(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return gate.evaluate(d, "id", "text", GATE)


def fuzzy_phrase(spark, sf):
    hit = lambda k: text.contains_phrase(text.normalize(F.col("text")), "the and attion to thanedble the anea", k)
    return load(spark, sf, "documents").filter(hit(2)).select("doc_id", hit(0).alias("exact"), F.lit(True).alias("fuzzy"))


def two_phase_decision(spark, sf):
    d = load(spark, sf, "conversations")
    v = text_gate_verdict(spark, sf)
    m = d.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.length("text") % 3 == 0, "suspicious").when(F.length("text") % 3 == 1, "confirmed").otherwise("pass").alias("decision"))
    return gate.two_phase(m, v, "id").select("id", "decision", "verdict", "final")


def pattern_union(spark, sf):
    """Patterns of all items, normalised, the first of equals kept in order."""
    d = load(spark, sf, "benchmark").select("item_id", text.tokens(F.col("text")).alias("p"))
    return d.select("item_id", F.array_join(F.array_distinct("p"), " ").alias("patterns"))


def url_policy(spark, sf):
    return load(spark, sf, "pages").select("page_id", media.host(F.col("url")).alias("host"), media.url_allowed(F.col("url"), HOSTS).alias("allowed"))


_EXT = ["JPEG", "png", "gif", "txt", "webp"]


def _named(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.concat(F.lit("https://cdn.example.com/a.b/"), "page_id", F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("page_id") % 5 + 1).cast("int")), F.lit("?x=1")).alias("url"))


def extension_allowlist(spark, sf):
    e = media.extension(F.col("url"))
    return _named(spark, sf).select("page_id", e.alias("ext"), media.extension_allowed(e, ["jpg", "png", "webp"]).alias("allowed"))


def media_flatten(spark, sf):
    d = load(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("urls"))
    return records.flatten_media(d, "page_id", "urls", 4)


def nested_media(spark, sf):
    """Messages made of pages: two attachments, an embed with image and thumbnail, and a snapshot that repeats one of them."""
    p = F.col("page_id")
    url = lambda host, name: F.concat(F.lit(f"https://{host}/"), p.cast("string"), F.lit(f"/{name}"))
    att = lambda u, mime, size, w: F.struct(u.alias("url"), mime.cast("string").alias("content_type"), size.cast("bigint").alias("size"), w.cast("int").alias("width"), w.cast("int").alias("height"))
    pic = lambda u: F.struct(u.alias("url"), F.lit(5).alias("width"), F.lit(6).alias("height"))
    one, two = att(url("cdn.example.com", "a.png"), F.lit(None), p * 100, F.lit(None)), att(url("cdn.example.com", "b"), F.when(p % 3 == 0, "image/webp").otherwise("text/plain"), F.lit(1), F.when(p % 2 == 0, 7))
    embed = F.struct(pic(url("media.example.com", "c.jpeg")).alias("image"), pic(F.when(p % 4 == 0, url("evil.example.org", "d.png")).otherwise(url("cdn.example.com", "d.txt"))).alias("thumbnail"))
    snap = F.struct(F.array(one, att(url("cdn.example.com", "e.gif"), F.lit("image/gif"), F.lit(2), F.lit(3))).alias("attachments"), F.array(embed).alias("embeds"))
    d = load(spark, sf, "pages").select("page_id", F.array(one, two).alias("attachments"), F.array(embed).alias("embeds"), F.when(p % 5 != 0, F.array(snap)).alias("snapshots"))
    return records.media_of(d, "page_id", 3, ["cdn.example.com", "media.example.com"], ["png", "jpg", "gif"], 100_000)


def record_validation(spark, sf):
    """Fingerprint records, some of which are spoilt, each in one way or two."""
    id_, spoilt = F.col("id"), lambda k: F.col("id") % k == 1
    d = fingerprints.fingerprints(load(spark, sf, "embeddings")).withColumn("h", F.md5(id_.cast("string")))
    d = d.select(
        "id", F.when(spoilt(17), 0).otherwise(F.col("width")).alias("width"), F.when(spoilt(29), 0).otherwise(F.col("height")).alias("height"),
        F.when(spoilt(7), F.substring("h", 1, 31)).otherwise(F.col("h")).alias("byte_hash"), F.when(spoilt(11), F.concat(F.lit("g"), F.substring("h", 2, 15))).otherwise(F.substring("h", 1, 16)).alias("phash64"), F.substring("h", 17, 16).alias("dhash64"),
        F.array(F.lit(1), F.when(spoilt(13), 256).otherwise(255), F.lit(0)).alias("rgb_mean"), F.slice("grid", 1, F.when(spoilt(19), 15).otherwise(16)).alias("grid_luma"), F.slice("grid", 1, F.when(id_ % 3 == 0, 0).when(spoilt(23), 8).otherwise(64)).alias("text_grid"),
        F.array(F.struct(F.substring("h", 1, F.when(spoilt(31), 9).otherwise(16)).alias("hash"), (id_ % 66).cast("int").alias("region"), F.when(spoilt(37), 0).otherwise(9).alias("w"), F.lit(9).alias("h"))).alias("local_anchors"),
        F.array(F.struct((id_ % 65).cast("int").alias("region"), (id_ % 41).cast("int").alias("scale_percent"))).alias("local_hashes"),
    )
    return records.problems(d)


def exemption_filter(spark, sf):
    d = load(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.array("role")).alias("roles"))
    return d.filter(~F.coalesce(F.arrays_overlap("roles", F.array(F.lit("system"), F.lit("assistant"))), F.lit(False))).select("conv_id", "turn")


def metadata_rejection(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", (F.col("n_chars") * 1500).alias("size"), (F.col("n_chars") % 4000).cast("int").alias("w"), (F.col("doc_id") * 37 % 4000).cast("int").alias("h"))
    reason = F.coalesce(media.safety_reason(F.col("size"), F.col("w"), F.col("h"), 8_000_000, 12_000_000), media.aspect_reason(F.col("w"), F.col("h"), 4.0))
    return d.select("doc_id", reason.alias("reason"))


def preview_route(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 4000 + 1).cast("int").alias("w"), (F.col("doc_id") * 37 % 3000 + 500).cast("int").alias("h"))
    p = media.preview_size(F.col("w"), F.col("h"), 12_000_000, 4.0)
    return d.select("doc_id", "w", "h", p["width"].alias("pw"), p["height"].alias("ph")).filter("pw is not null")


def specimen_ids(spark, sf):
    return load(spark, sf, "events").select("event_id", F.concat(F.lit("spm_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 12)).alias("specimen_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created_at"))


def jsonl_export(spark, sf):
    """Within the cap: every line; beyond it: the refusal alone."""
    d = load(spark, sf, "benchmark")
    some = records.capped_export(d, "item_id", 8 << 20).withColumn("cap", F.lit(8 << 20))
    return some.unionByName(records.capped_export(d, "item_id", 5_000).withColumn("cap", F.lit(5_000)))


def audit_rows(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", records.audit_row({"order": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}).alias("line"))


def action_intents(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.when(F.length("text") % 3 == 0, "confirmed").when(F.length("text") % 3 == 1, "suspicious").otherwise("pass").alias("decision"))
    return records.action_intents(d, "doc_id")


def import_outcomes(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"), "n_chars")
    n = F.row_number().over(Window.partitionBy("k").orderBy("doc_id"))
    return d.withColumn("outcome", F.when(F.col("n_chars") < 300, "failed").when(n > 1, "duplicate").otherwise("added")).groupBy("outcome").agg(F.count("*").alias("n"))


def percent_labels(spark, sf):
    return load(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("part"), F.count("*").alias("whole")).select("c_mktsegment", text.percent_label(F.col("part"), F.col("whole")).alias("label"))


def safe_names(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.file_stem(F.regexp_extract("url", r"//[^/]*/(.*)$", 1)).alias("stem"), text.truncate(F.col("url"), 20).alias("short"))


def hmac_verify(spark, sf):
    d = load(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("message"))
    sig = records.hmac_sha256(F.col("message"), "key-1")
    d = d.select("n_nationkey", sig.alias("signature"), F.sha2("message", 256).alias("digest"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("x")).otherwise(F.col("message")).alias("claimed"))
    return d.select("n_nationkey", "signature", "digest", (records.hmac_sha256(F.col("claimed"), "key-1") == F.col("signature")).alias("valid"))


def base64url_codec(spark, sf):
    d = load(spark, sf, "nation").select("n_nationkey", records.encode(F.struct("n_nationkey", "n_name", "n_regionkey"), "si1:").alias("code"))
    return d.select("n_nationkey", records.decode(F.col("code"), "si1:", "n_nationkey int, n_name string, n_regionkey int")["n_name"].alias("name"), F.length("code").alias("n"))


def retry_delays(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", media.retry_delay_ms(F.col("n_nationkey"), 100, 5000).alias("delay_ms"))


QUERIES = {f.__name__: f for f in (text_normalize, keyword_limits, text_gate_verdict, fuzzy_phrase, two_phase_decision, pattern_union, url_policy, extension_allowlist, media_flatten, nested_media, record_validation, exemption_filter, metadata_rejection, preview_route, specimen_ids, jsonl_export, audit_rows, action_intents, import_outcomes, percent_labels, safe_names, hmac_verify, base64url_codec, retry_delays)}

_N = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_T = "CASE WHEN " + _N + " = '' THEN [] ELSE string_split(" + _N + ", ' ') END"


def _window_sql(toks: str, pattern: str, limit: int) -> str:
    n = len(pattern.split())
    w = f"list_transform(range(1, greatest(len({toks}) - {n} + 2, 1)), lambda i: array_to_string(list_slice({toks}, i, i + {n} - 1), ' '))"
    hit = f"w = '{pattern}'" if not limit else f"abs(length(w) - {len(pattern)}) <= {limit} AND levenshtein(w, '{pattern}') <= {limit}"
    return f"len(list_filter({w}, lambda w: {hit})) > 0"


_KW = [("attion", 1), ("thanedble", 1), ("erth", 0), ("the anea", 1), ("thonn", 1), ("ertion", 1)]
_SN = ["the and attion to thanedble the anea", "is her inor the"]
_GATE_SQL = f"""t AS (SELECT conv_id || '-' || turn AS id, text, {_T.format('text')} AS toks FROM conversations),
  h AS (SELECT id, text, ({' OR '.join(_window_sql('toks', s, 2) for s in _SN)}) AS sentence_hit, ({' + '.join(f'({_window_sql("toks", k, n)})::INT' for k, n in _KW)})::INT AS keyword_hits FROM t),
  g AS (SELECT id, sentence_hit, keyword_hits, CASE WHEN sentence_hit THEN 'confirmed_sentence' WHEN keyword_hits >= 2 THEN 'confirmed_keywords' WHEN keyword_hits > 0 THEN 'partial_keywords' ELSE 'rejected' END AS decision FROM h),
  v AS (SELECT *, CASE WHEN decision LIKE 'confirmed%' THEN 'bad' WHEN decision = 'rejected' THEN 'good' ELSE 'unknown' END AS verdict,
    CASE decision WHEN 'confirmed_sentence' THEN 0.95 WHEN 'confirmed_keywords' THEN 0.9 WHEN 'partial_keywords' THEN least(greatest(keyword_hits / 2.0, 0.25), 0.75) ELSE 0.75 END::FLOAT AS confidence FROM g)"""


def _hmac(message: str) -> str:
    pad = lambda x: bytes(b ^ x for b in b"key-1".ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || {message}::BLOB)))"


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
_FIT = "least(768.0::DOUBLE / w, 2048.0::DOUBLE / h, sqrt(786432.0::DOUBLE / (w::DOUBLE * h)), 1.0::DOUBLE)"

ORACLE_SQL = {
    "text_normalize": f"SELECT doc_id, md5({_N.format('text')}) AS normal, len({_T.format('text')})::INT AS n_tokens FROM documents",
    "keyword_limits": f"WITH k AS (SELECT DISTINCT unnest({_T.format('text')}) AS keyword FROM benchmark), l AS (SELECT keyword, CASE WHEN length(keyword) <= 4 THEN 0 WHEN length(keyword) <= 8 THEN 1 ELSE 2 END AS n FROM k) SELECT keyword, least(0, n) AS limit_0, least(1, n) AS limit_1, least(3, n) AS limit_3 FROM l",
    "text_gate_verdict": f"WITH {_GATE_SQL} SELECT * FROM v",
    "fuzzy_phrase": f"WITH t AS (SELECT doc_id, {_T.format('text')} AS toks FROM documents), h AS (SELECT doc_id, {_window_sql('toks', _SN[0], 0)} AS exact, {_window_sql('toks', _SN[0], 2)} AS fuzzy FROM t) SELECT * FROM h WHERE fuzzy",
    "two_phase_decision": f"WITH {_GATE_SQL}, m AS (SELECT conv_id || '-' || turn AS id, CASE length(text) % 3 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'confirmed' ELSE 'pass' END AS decision FROM conversations) SELECT m.id, m.decision, verdict, CASE WHEN m.decision = 'suspicious' AND verdict = 'bad' THEN 'confirmed' WHEN m.decision = 'suspicious' AND verdict = 'good' THEN 'pass' ELSE m.decision END AS final FROM m LEFT JOIN v USING (id)",
    "pattern_union": f"WITH t AS (SELECT item_id, {_T.format('text')} AS p FROM benchmark), u AS (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM t), f AS (SELECT item_id, p[i] AS x, min(i) AS i FROM u GROUP BY ALL) SELECT item_id, string_agg(x, ' ' ORDER BY i) AS patterns FROM f GROUP BY item_id",
    "url_policy": f"WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages) SELECT page_id, host, url LIKE 'https://%' AND ({' OR '.join(f'host = {s!r} OR host LIKE {chr(37) + "." + s!r}' for s in HOSTS)}) AS allowed FROM h".replace("%'.", "%."),
    "extension_allowlist": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'txt' ELSE 'webp' END AS ext, page_id % 5 IN (0, 1, 4) AS allowed FROM pages",
    "media_flatten": "WITH a AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages), u AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM a), f AS (SELECT page_id, l[i] AS url, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS idx FROM f QUALIFY idx <= 4) SELECT page_id, url, (idx - 1)::INT AS idx, count(*) OVER (PARTITION BY page_id) AS total FROM r",
    "nested_media": """WITH u AS (SELECT page_id, 'https://cdn.example.com/' || page_id || '/' AS c, 'https://media.example.com/' || page_id || '/' AS m FROM pages),
      v AS (SELECT page_id, 0 AS i, c || 'a.png' AS url, 'attachment' AS kind, 'image/png' AS mime, (page_id * 100)::BIGINT AS size, NULL::INT AS width, NULL::INT AS height FROM u WHERE page_id * 100 <= 100000
        UNION ALL SELECT page_id, 1, c || 'b', 'attachment', 'image/webp', 1, CASE WHEN page_id % 2 = 0 THEN 7 END, CASE WHEN page_id % 2 = 0 THEN 7 END FROM u WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 2, m || 'c.jpeg', 'embed_image', 'image/jpeg', NULL, 5, 6 FROM u
        UNION ALL SELECT page_id, 5, c || 'e.gif', 'attachment', 'image/gif', 2, 3, 3 FROM u WHERE page_id % 5 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM v QUALIFY n <= 3) SELECT page_id, url, kind, mime, size, width, height, (n - 1)::INT AS idx, count(*) OVER (PARTITION BY page_id) AS total FROM r""",
    "record_validation": """WITH d AS (SELECT vec_id AS id FROM embeddings) SELECT id, CASE WHEN id % 17 = 1 THEN 'width' WHEN id % 29 = 1 THEN 'height' WHEN id % 7 = 1 THEN 'byte_hash' WHEN id % 11 = 1 THEN 'phash64' WHEN id % 13 = 1 THEN 'rgb_mean'
      WHEN id % 19 = 1 THEN 'grid_luma' WHEN id % 3 <> 0 AND id % 23 = 1 THEN 'text_grid' WHEN id % 31 = 1 THEN 'anchor_hash' WHEN id % 66 >= 64 THEN 'anchor_region' WHEN id % 37 = 1 THEN 'anchor_size' WHEN id % 65 >= 64 THEN 'feature_region' WHEN id % 41 < 1 THEN 'feature_scale' END AS problem FROM d WHERE problem IS NOT NULL""",
    "hmac_verify": f"""WITH n AS (SELECT n_nationkey, n_name AS message, CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE n_name END AS claimed FROM nation),
      h AS (SELECT n_nationkey, {_hmac("message")} AS signature, sha256(message) AS digest, {_hmac("claimed")} AS again FROM n) SELECT n_nationkey, signature, digest, again = signature AS valid FROM h""",
    "exemption_filter": "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 OR role NOT IN ('system', 'assistant')",
    "metadata_rejection": "WITH d AS (SELECT doc_id, n_chars * 1500 AS size, n_chars % 4000 AS w, doc_id * 37 % 4000 AS h FROM documents) SELECT doc_id, CASE WHEN size > 8000000 THEN 'metadata_file_too_large' WHEN w = 0 OR h = 0 THEN 'metadata_invalid_dimensions' WHEN w * h > 12000000 THEN 'metadata_pixels_too_large' WHEN greatest(w, h) / least(w, h) > 4 THEN 'metadata_aspect_too_large' END AS reason FROM d",
    "preview_route": f"WITH d AS (SELECT doc_id, n_chars % 4000 + 1 AS w, doc_id * 37 % 3000 + 500 AS h FROM documents), p AS (SELECT doc_id, w::INT AS w, h::INT AS h, greatest(round(w * {_FIT}), 1)::INT AS pw, greatest(round(h * {_FIT}), 1)::INT AS ph FROM d) SELECT * FROM p WHERE w::BIGINT * h <= 12000000 AND greatest(w, h) / least(w, h) <= 4 AND NOT (pw >= w AND ph >= h) AND 100 - (pw::BIGINT * ph * 100) // (w::BIGINT * h) >= 35",
    "specimen_ids": "SELECT event_id, 'spm_' || strftime(ts, '%Y%m%d') || '_' || substr(md5(event_id::VARCHAR), 1, 12) AS specimen_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS created_at FROM events",
    "jsonl_export": "WITH l AS (SELECT item_id, '{\"item_id\":' || item_id || ',\"text\":' || to_json(text)::VARCHAR || '}' AS line FROM benchmark), t AS (SELECT sum(strlen(line) + 1) AS total FROM l), c AS (SELECT unnest([8388608, 5000]) AS cap) SELECT item_id, line, false AS refused, cap FROM l, t, c WHERE total <= cap UNION ALL SELECT NULL, NULL, true, cap FROM t, c WHERE total > cap",
    "audit_rows": "SELECT o_orderkey, 'order=' || o_orderkey || ' status=' || o_orderstatus || ' priority=' || replace(o_orderpriority, ' ', '_') AS line FROM orders",
    "action_intents": "WITH d AS (SELECT doc_id, length(text) % 3 AS k FROM documents) SELECT doc_id, unnest(CASE k WHEN 0 THEN ['delete', 'timeout', 'log'] ELSE ['log'] END) AS action, unnest(CASE k WHEN 0 THEN [1, 2, 3] ELSE [1] END) AS seq FROM d WHERE k < 2",
    "import_outcomes": "WITH d AS (SELECT CASE WHEN n_chars < 300 THEN 'failed' WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'added' END AS outcome FROM documents) SELECT outcome, count(*) AS n FROM d GROUP BY outcome",
    "percent_labels": "WITH t AS (SELECT c_mktsegment, (count(*) FILTER (WHERE c_acctbal > 0) * 1000) // count(*) AS tenths FROM customer GROUP BY 1) SELECT c_mktsegment, (tenths // 10) || '.' || (tenths % 10) || '%' AS label FROM t",
    "safe_names": r"WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '//[^/]*/(.*)$', 1), '\.[^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'image' ELSE s END AS stem, substr(url, 1, 20) AS short FROM p",
    "base64url_codec": "SELECT n_nationkey, n_name AS name, (4 + (strlen('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') * 4 + 2) // 3)::INT AS n FROM nation",
    "retry_delays": "SELECT n_nationkey, least(5000, 100 * pow(2, greatest(n_nationkey - 1, 0)))::BIGINT AS delay_ms FROM nation",
}
