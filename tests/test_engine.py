"""Functions and operators against known values and brute force, and queries against DuckDB."""

import itertools
import os
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield import catalogue
from nearfield.functions import bits, media, scores, stats, text
from nearfield.operators import cascade, features, gate, geometry, graph, local, matching, metrics, pixels, tiles, validation
from nearfield.plans import matching as plans
from nearfield.plans.policy import WIDE, Policy, Shape, TextGate
from nearfield.sources import records
from nearfield.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_bits(spark):
    r = one(spark, bits.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")), bits.hex16_to_word(F.lit("ffffffffffffffff")), bits.hex16_to_word(F.lit("fff")), bits.segments(F.lit(0x123456789ABCDEF0)), bits.mean_abs_delta(F.array(F.lit(1), F.lit(9)), F.array(F.lit(4), F.lit(4))), bits.mean_abs_delta(F.array().cast("array<int>"), F.array().cast("array<int>")), bits.text_grid_delta(F.array(F.lit(1)), F.array(F.lit(1))), bits.descriptor_distance(F.lit(7).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
    assert list(r) == [64, -1, None, [16 * k + (k + 1) % 16 for k in range(16)], 4, 0, 255, 2]


def test_flipping_bits_is_distance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(65):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        b = a
        for i in rng.permutation(64)[:k]:
            b ^= -(2**63) if i == 63 else 1 << int(i)
        rows.append((k, a, b))
    d = spark.createDataFrame(rows, "k int, a bigint, b bigint")
    assert d.filter(bits.hamming(F.col("a"), F.col("b")) != F.col("k")).count() == 0


def test_score_at_the_limit_meets_the_threshold(spark):
    t = Policy().confirmed
    r = one(spark, *[(scores.perceptual(F.lit(d), t) * scores.f32(1.8)).cast("float") >= scores.f32(63.0) for d in (14, 26)], F.round((scores.perceptual(F.lit(14), t) * scores.f32(1.8)).cast("double"), 3))
    assert list(r) == [True, True, 117.0]


def test_percentiles(spark):
    v = F.array(*[F.lit(i) for i in range(11)])
    r = one(spark, stats.rank_round(v, 0.95), stats.rank_ceil(v, 95), stats.rank_half_up(v, 95, 100), stats.rank_quarter(v, 3), stats.rank_round(F.array().cast("array<int>"), 0.5))
    assert list(r) == [10, 10, 10, 8, None]


CASES = [
    ("connect your wallet", (), "Please connect your wal1et now", "confirmed_sentence", 0),
    (None, ("airdrop", "claim"), "claim the airdrop", "confirmed_keywords", 2),
    (None, ("airdrop", "claim", "win"), "clain the alrdrop now", "confirmed_keywords", 2),
    (None, ("airdrop", "claim", "win"), "w1n a prize", "rejected", 0),
    (None, ("claim",), "", "no_text", 0),
    (None, (), "any", "unavailable", 0),
    ("это короткая фраза для проверки", (), "Вот: это короткая\nфраза для проверки.", "confirmed_sentence", 0),
    ("a long sentence of words", (), "a\tlong\r\nsentence of  words", "confirmed_sentence", 0),
]


@pytest.mark.parametrize("sentence,keywords,ocr,decision,hits", CASES)
def test_gate(spark, sentence, keywords, ocr, decision, hits):
    g = TextGate(enabled=True, keywords=keywords, sentences=(sentence,) if sentence else ())
    r = gate.evaluate(spark.createDataFrame([(1, ocr)], "id int, t string"), "id", "t", g).first()
    assert (r["decision"], r["keyword_hits"]) == (decision, hits)


def test_gate_partial_and_disabled(spark):
    d = spark.createDataFrame([(1, "claim your reward")], "id int, t string")
    r = gate.evaluate(d, "id", "t", TextGate(enabled=True, keywords=("claim", "airdrop", "bonus"), keyword_threshold=3)).first()
    assert (r["decision"], r["verdict"]) == ("partial_keywords", "unknown") and abs(r["confidence"] - 1 / 3) < 1e-6
    assert gate.evaluate(d, "id", "t", TextGate()).first()["confidence"] == 1.0
    assert [r["final"] for r in gate.two_phase(spark.createDataFrame([(1, "suspicious"), (2, "suspicious"), (3, "pass")], "id int, decision string"), spark.createDataFrame([(1, "bad"), (2, "good")], "id int, verdict string"), "id").orderBy("id").collect()] == ["confirmed", "pass", "pass"]


def test_keyword_limits_agree(spark):
    for k in ("win", "claim", "airdrops", "a long phrase"):
        assert one(spark, text.keyword_limit(F.lit(k), 3))[0] == text.limit_of(k, 3)


def fp(spark, rows):
    return spark.createDataFrame(rows, "id bigint, ph bigint, dh bigint, width int, height int")


def test_segment_join_is_complete_to_fifteen_bits(spark):
    rng = np.random.default_rng(2)
    rows, base = [], int(rng.integers(0, 2**62))
    for i in range(40):
        x = base
        for b in rng.permutation(62)[: i % 20]:
            x ^= 1 << int(b)
        rows.append((i, x, x, 800, 800))
    d = fp(spark, rows)
    got = {(r["id"], r["s_id"]) for r in matching.segment_pairs(d, d, "ph", 15).collect()}
    assert got == {(a, b) for (a, x, *_), (b, y, *_) in itertools.product(rows, rows) if bin(x ^ y).count("1") <= 15}
    near = {(r["id_a"], r["id_b"]) for r in matching.near_pairs(d, 4, 4).collect()}
    assert near == {(min(a, b), max(a, b)) for a, b in got if a != b and bin(rows[a][1] ^ rows[b][1]).count("1") <= 4}


def test_cascade_cases(spark):
    word = lambda n: (1 << n) - 1
    spec = fp(spark, [(1, 0, 0, 1000, 1200)])
    cases = {(6, 8): "confirmed", (0, 13): "suspicious", (16, 8): "confirmed", (16, 10): "confirmed", (16, 11): "suspicious", (17, 0): "suspicious", (23, 0): None, (40, 40): None}
    cand = fp(spark, [(10 + i, word(p), word(d), 1000, 1200) for i, (p, d) in enumerate(cases)])
    got = {r["id"]: r["decision"] for r in matching.cascade(matching.all_pairs(spec, cand), Policy()).collect()}
    assert [got.get(10 + i) for i in range(len(cases))] == list(cases.values())
    small = fp(spark, [(10, 0, 0, 300, 300)])
    assert matching.cascade(matching.all_pairs(spec, small), Policy()).count() == 0


def test_ties_take_the_last_specimen(spark):
    d = matching.all_pairs(fp(spark, [(1, 0, 0, 800, 800), (2, 0, 0, 800, 800)]), fp(spark, [(9, 1, 1, 800, 800)]))
    assert matching.cascade(d, Policy()).first()["s_id"] == 2


EDGES = [(0, 1, 80), (1, 2, 80), (0, 2, 80), (3, 4, 80), (0, 3, 10)]


@pytest.mark.parametrize("matches,promoted", [({0: 64}, False), ({0: 40, 1: 35}, True), ({0: 19, 1: 18}, None), ({0: 40, 3: 35}, False)])
def test_cluster_cases(spark, matches, promoted):
    e = spark.createDataFrame(EDGES, "a bigint, b bigint, weight int")
    d = spark.createDataFrame([(7, s, float(v)) for s, v in matches.items()], "id bigint, s_id bigint, score double")
    got = graph.promotion(d, e).collect()
    assert (got[0]["promoted"] if got else None) == promoted


def test_clusters(spark):
    e = spark.createDataFrame(EDGES, "a bigint, b bigint, weight int")
    assert {r["node"]: r["cluster"] for r in graph.clusters(e, 63, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert graph.clusters(e.limit(0), 63, 2).count() == 0


def test_promotion_takes_specimens_of_all_ids(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    ids = F.explode(F.array(*[F.lit(k).cast(d.schema["vec_id"].dataType) for k in (1001, 1002, 1005)]))
    d.filter("vec_id = 1").withColumn("vec_id", ids).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["cluster_promotion"](spark, str(tmp_path)).collect()
    assert [(r["id"], r["members"], r["largest"], r["promoted"]) for r in got] == [(1005, 2, 2, True)]


def test_geometry_recovers_models():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 600, (40, 2))
    t = np.radians(10)
    q = p @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]).T * 1.2 + [30, -20]
    bad = rng.permutation(40)[:12]
    noisy = q.copy()
    noisy[bad] = rng.uniform(0, 600, (12, 2))
    name, h, inl = geometry.verify(p, noisy, np.arange(40.0), residual=5)
    good = np.setdiff1d(np.arange(40), bad)
    assert name == "similarity" and inl[good].all() and abs(np.hypot(h[0, 0], h[1, 0]) - 1.2) < 0.02
    m = np.array([[1.1, 0.05, 10], [0.02, 0.95, 5], [4e-4, 2e-4, 1]])
    name, h, inl = geometry.verify(p, geometry.apply(m, p), np.arange(40.0), residual=3)
    assert name == "homography" and inl.sum() >= 38
    assert geometry.verify(p[:2], rng.uniform(0, 600, (2, 2)), np.arange(2.0)) is None
    assert np.allclose(geometry.affine(p, p * 2 + 1), [[2, 0, 1], [0, 2, 1], [0, 0, 1]])


def test_pixels():
    rng = np.random.default_rng(4)
    img = np.kron(rng.integers(0, 256, (12, 12)), np.ones((8, 8), int)).astype(np.uint8)
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for v in ("lighter", "smaller"):
        assert apart(pixels.phash(img), pixels.phash(pixels.augment(img, v))) <= 10
    assert apart(pixels.phash(img), pixels.phash(rng.integers(0, 256, (96, 96)).astype(np.uint8))) > 15
    assert pixels.dhash(np.tile(np.arange(90, dtype=np.uint8), (80, 1))) == -1
    c = pixels.corners(img)
    assert c and c == sorted(c, key=lambda x: -x[2]) and all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= 16 for a, b in itertools.combinations(c, 2))
    assert pixels.corners(np.zeros((5, 5), np.uint8)) == [] and pixels.corners(np.full((30, 30), 9, np.uint8)) == []
    assert pixels.signature(np.full((8, 8), 7, np.uint8)) == (7, 0, [7] * 16)
    assert pixels.text_bounds([(1, 1)] * 3, 2, 50, 50) is None and pixels.text_bounds([(5, 6), (7, 8), (9, 9), (20, 30)], 2, 50, 31) == (3, 4, 22, 31)


def test_lru(spark):
    d = spark.createDataFrame([(1, k, i) for i, k in enumerate("abacb")], "g int, k string, i int")
    got = [r["i"] for r in metrics.lru_dedupe(d, "g", "k", ["i"], 2, "g int, k string, i int").orderBy("i").collect()]
    assert got == [0, 1, 3, 4]  # a is renewed by its second arrival, so c drives out b


def test_stride_and_budget(spark):
    d = spark.range(10).select(F.lit(1).alias("g"), "id")
    assert [r["id"] for r in local.stride(d, "g", "id", 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert local.stride(d, "g", "id", 10).count() == 10
    assert [r["id"] for r in local.budget(d.withColumn("n", 10 - F.col("id")), "g", "n", ["id"], 2).collect()] == [9, 8]


def test_shuffle_is_a_permutation():
    a = validation.splitmix_shuffle(100, 5)
    assert sorted(a) == list(range(100)) and a == validation.splitmix_shuffle(100, 5) != validation.splitmix_shuffle(100, 6)


def test_metrics_are_null_on_zero_denominators(spark):
    r = validation.with_metrics(spark.createDataFrame([(0, 0, 5, 0)], "tp int, fp int, tn int, fn int")).first()
    assert r["precision_"] is None and r["recall"] is None and r["specificity"] == 1.0
    assert not validation.gates(validation.with_metrics(spark.createDataFrame([(0, 0, 5, 0)], "tp int, fp int, tn int, fn int"))).first()["passed"]


def test_urls(spark):
    rows = ["https://cdn.example.com/a.JPEG?x=1", "http://example.com/a.png", "https://example.com.evil.org/a.png", "https://10.0.0.1/a", None, "nonsense"]
    d = spark.createDataFrame([(u,) for u in rows], "u string").select(media.url_allowed(F.col("u"), ["example.com"]), media.extension(F.col("u"))).collect()
    assert [r[0] for r in d] == [True, False, False, False, False, False] and d[0][1] == "jpg" and d[5][1] == ""


def test_codec_and_signature(spark):
    import hashlib
    import hmac

    s = F.struct(F.lit(5).alias("a"), F.lit("ü?>").alias("b"))
    r = one(spark, records.decode(records.encode(s, "sc1:"), "sc1:", "a int, b string, c string").alias("v"), records.decode(F.lit("xx"), "sc1:", "a int").alias("w"), records.hmac_sha256(F.lit("message"), "secret"))
    assert (r["v"]["a"], r["v"]["b"], r["v"]["c"], r["w"]) == (5, "ü?>", None, None)
    assert r[2] == hmac.new(b"secret", b"message", hashlib.sha256).hexdigest()


def test_imports(spark):
    d = spark.createDataFrame([('{"a":1}',), ('[{"a":2},{"a":3}]',), ('{"a":4}\n{"a":5}\n',)], "raw string")
    assert sorted(r["a"] for r in records.parse_import(d, "raw", "a int").collect()) == [1, 2, 3, 4, 5]


def test_fingerprint_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/b.json").write_text('{"schema": 7, "source_path": "b", "fingerprint": {"width": 5}}')
    (tmp_path / "a.json").write_text('{"schema": 7,\n "source_path": "a", "fingerprint": {"phash64": "00"}}')
    (tmp_path / "c.txt").write_text("no")
    assert [r["source_path"] for r in records.scan_fingerprints(spark, str(tmp_path)).collect()] == ["a", "b"]
    (tmp_path / "d.json").write_text('{"schema": 6}')
    with pytest.raises(Exception, match="schema"):
        records.scan_fingerprints(spark, str(tmp_path)).collect()
    (tmp_path / "i.PNG").write_bytes(b"123")
    assert [r["length"] for r in records.scan_images(spark, str(tmp_path)).collect()] == [3]


def test_policy_checks():
    from dataclasses import replace

    assert Policy().problems() == []
    p = Policy()
    assert len(replace(p, confirmed=replace(p.confirmed, total_max=99, max_aspect=0.5)).problems()) == 2


def test_labels_are_cut_not_rounded(spark):
    r = one(spark, *[text.percent_label(F.lit(a), F.lit(b)) for a, b in ((2, 3), (1, 3), (0, 0), (5, 5), (999, 1000), (1, 1001))])
    assert list(r) == ["66.6%", "33.3%", "0.0%", "100.0%", "99.9%", "0.0%"]


def test_an_export_beyond_its_cap_is_refused(spark):
    d = spark.createDataFrame([(1, "a"), (2, "bb")], "k int, v string")
    whole = len('{"k":1,"v":"a"}') + len('{"k":2,"v":"bb"}') + 2
    assert [tuple(r) for r in records.capped_export(d, "k", whole).orderBy("k").collect()] == [(1, '{"k":1,"v":"a"}', False), (2, '{"k":2,"v":"bb"}', False)]
    assert [tuple(r) for r in records.capped_export(d, "k", whole - 1).collect()] == [(None, None, True)]
    assert records.capped_export(d.limit(0), "k", 5).count() == 0


def test_runner_up_is_the_least_among_the_others(spark):
    d = spark.createDataFrame([(1, 2, 0, k, dist, dist * 4) for k, dist in enumerate((3, 5, 9, 11))], "id int, s_id int, s_ord int, ord int, distance int, quality int")
    assert [(r["rank"], r["second"]) for r in local.top_distinct(d).orderBy("rank").collect()] == [(1, 5), (2, 3), (3, 3)]
    assert local.top_distinct(d.limit(1)).first()["second"] is None


def test_near_pairs_of_one_content_are_none(spark):
    d = spark.createDataFrame([(1, 0, 0, "x"), (2, 1, 0, "x"), (3, 3, 0, "y")], "id long, ph long, dh long, c string")
    assert {(r["id_a"], r["id_b"]) for r in matching.near_pairs(d, 4, 4, "c").collect()} == {(1, 3), (2, 3)}


def test_flipped_segments_find_all_pairs(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63 - 1, 120)
    b = np.concatenate([a ^ (sum(1 << int(i) for i in rng.permutation(63)[:k])) for k in range(0, 20)])
    left, right = (spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, ph long") for v in (a, b))
    for width, most in ((4, 15), (8, 15), (16, 15), (8, 7), (None, 12)):
        got = [(r["id"], r["s_id"]) for r in matching.segment_pairs(left, right, "ph", most, width).collect()]
        want = {(j, i) for i, x in enumerate(a) for j, y in enumerate(b) if int(x ^ y).bit_count() <= most or int(np.uint64(x ^ y)).bit_count() <= most}
        assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_phrases(spark):
    cases = [("please connect your wallet now", True), ("please conect your walet now", True), ("connect your", False), ("xconnect your wallet", True), ("cxnnxct yxur wallet", False), ("", False)]
    d = spark.createDataFrame(cases, "t string, want boolean")
    assert d.filter(text.contains_phrase(F.col("t"), "connect your wallet", 2) != F.col("want")).count() == 0
    assert d.filter(text.contains_phrase(F.col("t"), "connect your wallet", 0)).count() == 1


def _pairs(spark, rows):
    """id, s_id, pd, dd of 1000 x 1200 images; bonus null without the shape."""
    d = spark.createDataFrame(rows, "id long, s_id long, pd int, dd int, bonus float")
    return d.withColumns({c: F.lit(v) for c, v in (("width", 1000), ("height", 1200), ("s_width", 1000), ("s_height", 1200))})


NO_EXACT, NO_EDGES = "candidate long, specimen long", "a long, b long, weight int"


def test_full_cascade_cases(spark):
    none = spark.createDataFrame([], NO_EXACT), spark.createDataFrame([], NO_EDGES)
    p = _pairs(spark, [(1, 9, 40, 40, None), (2, 9, 6, 8, None), (3, 9, 15, 15, None), (4, 9, 19, 15, None), (5, 9, 19, 15, 10.0), (6, 9, 60, 60, 10.0)])
    exact = spark.createDataFrame([(1, 9)], NO_EXACT)
    got = {r["id"]: r for r in cascade.decide(exact, p, Policy(), none[1]).collect()}
    assert (got[1]["decision"], got[1]["stage"]) == ("confirmed", "exact") and (got[2]["decision"], round(got[2]["score"], 1)) == ("confirmed", 117.0)
    assert got[3]["decision"] == "suspicious" and round(got[3]["score"], 1) == 63.0  # total 30: the floor, 35, times 1.8
    assert 4 not in got and got[5]["decision"] == "suspicious" and round(got[5]["score"], 1) == 73.0  # a near miss needs the shape
    assert 6 not in got  # the shape alone is no match


def test_clusters_promote_weak_matches(spark):
    from dataclasses import replace

    policy = Policy()
    weak = replace(policy, suspicious=replace(policy.suspicious, perceptual_weight=1.0, score=90.0))
    p = _pairs(spark, [(1, 7, 15, 15, None), (1, 8, 15, 14, None), (2, 7, 15, 15, None), (2, 9, 15, 14, None)])
    edges = spark.createDataFrame([(7, 8, 100), (7, 9, 10)], NO_EDGES)
    got = cascade.decide(spark.createDataFrame([], NO_EXACT), p, weak, edges).collect()
    assert [(r["id"], r["s_id"], r["stage"], round(r["score"])) for r in got] == [(1, 8, "cluster", 63)]


VERIFIED = "id long, s_id long, model string, inliers int, regions int, spread double, residual double, mean_distance double"


def test_geometry_is_accepted_by_model(spark):
    t = Policy().confirmed
    rows = [(1, 9, "similarity", 80, 10, 216.0, 24.0, 7.0), (2, 9, "affine", 80, 10, 216.0, 20.0, 7.0), (3, 9, "affine", 81, 10, 216.0, 22.0, 7.0), (4, 9, "affine", 81, 10, 216.0, 22.5, 7.0), (5, 9, "homography", 82, 11, 216.0, 18.0, 7.0), (6, 9, "homography", 82, 10, 216.0, 18.0, 7.0), (7, 9, "similarity", 80, 10, 215.0, 1.0, 7.0), (8, 9, "similarity", 80, 10, 900.0, 1.0, 7.5)]
    assert {r["id"] for r in cascade.accepted(spark.createDataFrame(rows, VERIFIED), t).collect()} == {1, 3, 5}


def test_local_anchors_confirm_what_hashes_miss(spark):
    p = _pairs(spark, [(1, 9, 40, 40, None), (2, 9, 40, 40, None)])
    v = spark.createDataFrame([(1, 9, "similarity", 500, 14, 700.0, 0.0, 0.0), (2, 9, "similarity", 80, 10, 216.0, 20.0, 6.0)], VERIFIED)
    args = spark.createDataFrame([], NO_EXACT), p, Policy(), spark.createDataFrame([], NO_EDGES)
    got = {r["id"]: (r["decision"], r["stage"], round(r["score"], 1)) for r in cascade.decide(*args, v).collect()}
    assert got[1] == ("confirmed", "anchors", 220.0) and got[2] == ("suspicious", "anchors", 69.3)


def test_unverified_support_needs_the_shape(spark):
    t = Policy().suspicious
    s = spark.createDataFrame([(k, 9, 100, 50, 25, 11.0, 300) for k in (1, 2, 3)], "id long, s_id long, raw_hits long, hits long, regions long, mean_distance double, spread int")
    p = _pairs(spark, [(1, 9, 25, 26, 5.0), (2, 9, 25, 26, None), (3, 9, 26, 26, 5.0)])
    assert [r["id"] for r in cascade.supported(s, p, t).collect()] == [1]
    assert cascade.supported(s.withColumn("raw_hits", F.lit(251)), p, t).count() == 0


def test_visual_shape(spark):
    dark = (1, 60, 60, [60, 61, 62], [80] * 64, 200, 800, 1000)
    d = spark.createDataFrame([dark, (2, 93, *dark[2:]), (3, 60, 60, [60, 61, 95], *dark[4:]), (4, *dark[1:6], 500, 1000)], "id int, luma int, contrast int, rgb array<int>, grid array<int>, n_local int, width int, height int")
    got = {r["id"]: r["bonus"] for r in cascade.with_shape(d, Shape(), Policy().suspicious).collect()}
    assert got == {1: 10.0, 2: None, 3: None, 4: None}  # 80 + 64 * 8 + 60 + 40 + 200 of 300 is beyond the cap
    t = d.filter("id = 1").select(cascade.text_stats(F.col("grid")).alias("t")).first()["t"]
    assert tuple(t) == (80, 64, 50, 50, 25)


def test_corners_count_the_threshold_and_all_of_the_ring(spark):
    img = np.full((15, 15), 100)
    for dx, dy in pixels._RING[:9]:
        img[7 + dy, 7 + dx] = 116  # exactly the threshold
    assert (7, 7, 9 * 16) in pixels.corners(img, apart=1)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([_plain(r[i]) for i in at]) for r in rel.fetchall())


def hashes(rng, n, places=12, flips=24):
    """n pairs of hashes in few places, so that distances of all sizes occur; sizes and a label."""
    word = lambda k: rng.integers(-(2**63), 2**63 - 1, k)
    ph, dh = (word(places)[rng.integers(0, places, n)] for _ in range(2))
    for v in (ph, dh):
        for k in range(n):
            for i in rng.permutation(63)[: rng.integers(0, flips)].tolist():
                v[k] ^= 1 << i
    return [(k, int(ph[k]), int(dh[k]), int(640 + rng.integers(0, 400)), int(640 + rng.integers(0, 300))) for k in rng.permutation(10 * n)[:n].tolist() for k in [k % n]]


HASHES = "id bigint, ph bigint, dh bigint, width int, height int"


@pytest.fixture
def hashed(spark, monkeypatch):
    """Specimens, candidates, and all pairs of them; blocks are small, so that there are many tiles."""
    monkeypatch.setattr(tiles, "ROWS", (10, 60))
    monkeypatch.setattr(tiles, "CELLS", 500)
    rng = np.random.default_rng(8)
    rows = [(i, *r[1:]) for i, r in enumerate(hashes(rng, 400))]
    rows += [(400 + i, *rows[i][1:]) for i in range(20)]  # equal distances, so that ids decide
    d = spark.createDataFrame(rows, HASHES)
    spec, cand = d.filter("id % 3 > 0"), d.filter("id % 3 = 0")
    return spec, cand, matching.all_pairs(spec, cand).cache()


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    got, want = (sorted(map(tuple, d.select(*cols).collect())) for d in (a, b))
    assert got == want and want


def test_tiles_give_the_pairs_within_limits(hashed):
    spec, cand, every = hashed
    same(tiles.near(cand, spec, [(20, 64), (64, 18)]), every.filter("pd <= 20 or dd <= 18"))
    same(tiles.near(cand, spec, [(64, 64, 48)]), every.filter("pd + dd <= 48"))


def test_explained_from_tiles_as_from_all_pairs(hashed):
    spec, cand, every = hashed
    policy = Policy(confirmed=replace(Policy().confirmed, phash_max=20, dhash_max=20, total_max=30), suspicious=replace(Policy().suspicious, phash_max=24, dhash_max=24, total_max=40, near_miss_slack=3))
    got = {(r["id"], r["level"]): r for r in matching.explain(spec, cand, policy).collect()}
    rows, reasons = every.collect(), set()
    for level, t, slack in (("confirmed", policy.confirmed, 0), ("suspicious", policy.suspicious, 3)):
        fit = {(r["id"], r["s_id"]) for r in matching.perceptual_evidence(every, t, slack).collect()}
        for i in {r["id"] for r in rows}:
            own = [r for r in rows if r["id"] == i]
            want = min(own, key=lambda r: ((r["id"], r["s_id"]) not in fit, r["pd"] + r["dd"], r["s_id"]))
            r = got.pop((i, level))
            assert (r["considered"], r["s_id"], r["pd"], r["dd"], r["passed"]) == (len(own), want["s_id"], want["pd"], want["dd"], (i, want["s_id"]) in fit)
            reasons.add(r["reason"])
    assert not got and {"within limits", "near miss", "distance"} <= reasons


def test_decisions_from_tiles_as_from_all_pairs(hashed):
    spec, cand, every = hashed
    for last in (True, False):
        d = tiles.nearest(cand, spec, "dd" if last else "total", last)
        w = Window.partitionBy("id").orderBy(F.col("dd") if last else F.col("pd") + F.col("dd"), F.desc("s_id") if last else "s_id")
        best = lambda x, w=w: x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
        same(best(d), best(every))
    same(matching.cascade(matching.nearest_for_levels(spec, cand, WIDE, True).distinct(), WIDE), matching.cascade(every, WIDE))


def test_edges_and_links_from_tiles(hashed):
    spec, _, _ = hashed
    t = replace(Policy().confirmed, phash_max=64, dhash_max=64, total_max=80)
    w = F.least(F.lit(1000), F.round(scores.perceptual(F.col("pd") + F.col("dd"), t).cast("double"))).cast("int").alias("weight")
    every = matching.all_pairs(spec, spec).filter("s_id < id").filter("pd + dd <= 80").select(F.col("s_id").alias("a"), F.col("id").alias("b"), w).filter("weight >= 42").cache()
    same(graph.coherence_edges(spec, t, 42), every)
    close = replace(t, phash_max=22, total_max=44)
    want = matching.all_pairs(spec, spec).filter("s_id < id and pd <= 22 and pd + dd <= 44").select(F.col("s_id").alias("a"), F.col("id").alias("b"))
    same(graph.coherence_edges(spec, close).select("a", "b"), want)


def test_links_join_what_all_edges_join(hashed):
    spec, _, _ = hashed
    t = replace(Policy().confirmed, phash_max=64, dhash_max=64, total_max=80)
    for coherence in (60, 66, 75):
        links, edges = graph.coherence_links(spec, t, coherence), graph.coherence_edges(spec, t, 42)
        same(graph.clusters(links, coherence, 2), graph.clusters(edges, coherence, 2))
    assert links.count() < edges.filter("weight >= 75").count()


@pytest.mark.parametrize("member, coherent", [(58, 62), (40, 36), (24, 18)])
def test_promotion_without_lists_of_pairs(hashed, monkeypatch, member, coherent):
    monkeypatch.setattr(tiles, "WHOLE", 30)
    spec, cand, every = hashed
    edges = matching.all_pairs(spec, spec).filter(f"s_id < id and pd + dd <= {coherent}").select(F.col("s_id").alias("a"), F.col("id").alias("b"), F.lit(1).alias("weight"))
    want = graph.promotion(every.select("id", "s_id", (F.lit(100) - F.col("pd") - F.col("dd")).alias("score")), edges, 100 - member, 1, 2)
    same(tiles.promotion(cand, spec, member, coherent, 2), want)


def test_near_pairs_in_tiles_as_by_segments(hashed, monkeypatch):
    d = hashed[0].withColumn("c", F.floor(F.col("id") / 40).cast("string"))
    want = matching.near_pairs(d, 12, 15, "c").cache()
    assert matching.in_tiles(1000, 1000, 15) and not matching.in_tiles(10**6, 10**6, 3)
    monkeypatch.setattr(matching, "TILE_COST", 1e9)
    same(want, matching.near_pairs(d, 12, 15, "c"))


@pytest.mark.parametrize("most", [6, 15, 40])
def test_segment_pairs_in_tiles_as_by_segments(hashed, monkeypatch, most):
    spec, cand, every = hashed
    same(matching.segment_pairs(spec, cand, "ph", most), every.filter(f"pd <= {most}").select("id", "s_id", F.col("pd").alias("distance")))
    if most < 40:
        monkeypatch.setattr(matching, "TILE_COST", 1e9)
        same(matching.segment_pairs(spec, cand, "ph", most), every.filter(f"pd <= {most}").select("id", "s_id", F.col("pd").alias("distance")))


def test_weighted_best_from_few_pairs_as_from_all(hashed):
    spec, cand, every = hashed
    got = plans.weighted_best(tiles.nearest(cand, spec, last=True, limits=[matching.limits(plans.S)], sizes=plans.S, rank=matching.ranks(spec.sparkSession, plans._both_kinds)).unionByName(tiles.nearest(cand, spec, "dd", last=True)).distinct())
    same(got, plans.weighted_best(every))
    assert got.filter("n = 1").count() and got.filter("n = 2").count()


FEATURES = "id bigint, ord int, hash bigint, hash2 bigint, pos_x int, pos_y int, luma int, contrast int, edge int, region int"


@pytest.fixture
def featured(spark, monkeypatch):
    """Specimens' and candidates' features in many tiles, and all their hits; one candidate's rows are there twice."""
    monkeypatch.setattr(features, "ROWS", (10, 90))
    monkeypatch.setattr(features, "HELD", 50)
    monkeypatch.setattr(tiles, "CELLS", 500)
    rng = np.random.default_rng(12)
    rows = [(i // 8, i % 8, *r[1:3], *(int(v) for v in rng.integers(0, 90, 5)), int(rng.integers(0, 4))) for i, r in enumerate(hashes(rng, 480, 4, 20))]
    d = spark.createDataFrame(rows + [r for r in rows if r[0] == 6], FEATURES)
    spec, cand = d.filter("id % 3 > 0"), d.filter("id % 3 = 0")
    return spec, cand, local.bucket_hits(spec, cand, LIKE, 20).cache()


LIKE = replace(Policy().confirmed, luma_delta=60, contrast_delta=60, edge_delta=60, position_delta=70)


def test_geometry_of_groups_as_of_pairs(featured):
    spec, cand, hits = featured
    at = lambda d, p: d.select(F.col("id").alias(f"{p}id"), F.col("ord").alias(f"{p}ord"), F.col("pos_x").alias(f"{p}x"), F.col("pos_y").alias(f"{p}y")).distinct()
    placed = hits.withColumnRenamed("s_region", "region").join(at(spec, "s_"), ["s_id", "s_ord"]).join(at(cand, ""), ["id", "ord"])
    same(features.verified(spec, cand, LIKE, 20), geometry.verify_pairs(placed))


def test_samples_taken_together_as_one_by_one():
    rng = np.random.default_rng(14)
    p, q = (rng.integers(0, 9, (60, 4, 2)).astype(float) for _ in range(2))
    h = geometry.homographies(p, q)
    assert all(np.array_equal(h[k], geometry.homography(p[k], q[k])) for k in range(60))


def test_ranking_in_tiles(featured):
    spec, cand, hits = featured
    for k in (1, 3):
        same(features.ranking(spec, cand, LIKE, 20, k), local.candidate_ranking(hits, k))


def test_hits_in_tiles(featured):
    spec, cand, hits = featured
    same(features.hits(spec, cand, LIKE, 20), hits)


def test_runners_up_in_tiles(featured):
    spec, cand, hits = featured
    want = local.top_distinct(hits).select("id", "s_id", "s_ord", "ord", "rank", "second").fillna(-1)
    same(features.top_distinct(spec, cand, LIKE, 20).fillna(-1), want)
    assert want.filter("second = -1").count() and want.filter("rank = 3").count()


def test_mutual_best_in_tiles(featured):
    spec, cand, hits = featured
    same(features.mutual_best(spec, cand, LIKE, 20), local.mutual_best(hits).select("id", "s_id", "ord", "s_ord", "distance"))


def test_support_in_tiles(featured):
    spec, cand, hits = featured
    same(features.unverified_support(spec, cand, LIKE, 20), local.unverified_support(hits.join(cand.select("id", "ord", "pos_x", "pos_y").distinct(), ["id", "ord"])))


@pytest.mark.parametrize("width", [4, 8, 16])
def test_dense_hits_in_tiles(featured, width):
    spec, cand, _ = featured
    same(features.hits(spec, cand, LIKE, 16, width, positions=False, both_words=False), local.bucket_hits(spec, cand, LIKE, 16, width, positions=False, both_words=False))


def test_pairs_that_can_count_decide_as_all_pairs_do(hashed):
    spec, cand, every = hashed
    bonus = F.when(F.col("id") % 2 == 0, F.lit(5.0)).cast("float")
    weak = replace(WIDE, suspicious=replace(WIDE.suspicious, support_hits=2, support_regions=1, support_total=70), cluster_member=40, cluster_coherence=50)
    support = every.select("id", "s_id", F.lit(3).alias("raw_hits"), (F.col("pd") % 4).alias("hits"), F.lit(2).alias("regions"), F.lit(5.0).alias("mean_distance"), F.lit(100).alias("spread"), F.lit(900).alias("permille")).filter("(id + s_id) % 7 = 0")
    exact = cand.filter("id % 9 = 0").select(F.col("id").alias("candidate"), (F.col("id") + 1).alias("specimen"))
    edges = graph.coherence_edges(spec, plans._COH, 50)
    pairs = cascade.evidence_pairs(spec, cand.withColumn("bonus", bonus), weak, cascade.worth(support, weak.suspicious))
    got = cascade.decide(exact, pairs, weak, edges, None, None, cascade.worth(support, weak.suspicious))
    same(got, cascade.decide(exact, every.withColumn("bonus", bonus), weak, edges, None, None, support))
    assert pairs.count() < every.count() and len({r["stage"] for r in got.collect()}) >= 3


def test_cascade_has_dense_evidence(spark, tmp_path):
    from nearfield.plans import features as queries

    rng = np.random.default_rng(15)
    v = rng.normal(size=(12, 64))
    v[5] = v[6] + 0.05 * rng.normal(size=64)
    spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    _, pairs, _, anchors, dense, support = queries._cascade(spark, str(tmp_path), True)
    assert {(r["id"], r["s_id"]) for r in cascade.accepted(dense, queries.FULL.confirmed).collect()} == {(5, 6)}
    got = {r["step"]: r["score"] for r in queries.cascade_full_explain(spark, str(tmp_path)).filter("id = 5 and level = 'confirmed'").collect()}
    assert got[3] > got[2] > got[1]
    weak = replace(queries.FULL, confirmed=replace(queries.FULL.confirmed, phash_max=0, dhash_max=0, total_max=0))
    none = anchors.limit(0)
    row = cascade.decide(spark.createDataFrame([], "candidate bigint, specimen bigint"), pairs, weak, spark.createDataFrame([], "a bigint, b bigint, weight int"), none, dense, support.limit(0)).filter("id = 5").first()
    assert (row["decision"], row["stage"], row["s_id"]) == ("confirmed", "dense", 6)


def test_looks_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", (5, 30))
    monkeypatch.setattr(tiles, "BATCH", 70)
    rng = np.random.default_rng(16)
    rows = [(i, int(v[3]), v[:3].tolist(), v[:16].tolist(), v.tolist()) for i, v in enumerate(rng.integers(0, 256, (80, 64)))]
    d = spark.createDataFrame(rows, "id bigint, luma int, rgb array<int>, blocks array<int>, grid array<int>")
    left, right = d.filter("id % 5 = 0"), d.filter("id % 5 > 0")
    mean = lambda k: bits.mean_abs_delta(F.col(k), F.col(f"s_{k}"))
    both = left.crossJoin(right.select(*[F.col(c).alias(f"s_{c}") for c in d.columns]))
    same(tiles.looks(left, right), both.select("id", "s_id", F.abs(F.col("luma") - F.col("s_luma")).alias("luma_delta"), mean("rgb").alias("rgb_delta"), mean("blocks").alias("grid_delta"), mean("grid").alias("text_delta")))


def test_image_hashes_without_batches_of_pixels(spark, monkeypatch):
    monkeypatch.setattr(pixels, "IMAGES", 3)
    grids = np.random.default_rng(17).integers(0, 256, (20, 64)).tolist()
    got = pixels.image_hashes(spark.createDataFrame(list(enumerate(grids)), "id bigint, grid array<int>")).collect()
    want = {i: (pixels.phash(img), pixels.dhash(img), *pixels.signature(img)) for i, g in enumerate(grids) for img in [pixels.enlarged(g)]}
    assert {r["id"]: tuple(r)[1:] for r in got} == want and len(got) == 20


def test_image_features_without_batches_of_pixels(spark, monkeypatch):
    monkeypatch.setattr(pixels, "IMAGES", 3)
    grids = np.random.default_rng(18).integers(0, 256, (10, 64)).tolist() + [[7] * 64] * 4
    grids += [[255 * (k == j) for k in range(64)] for j in (18, 27, 45)]
    got = pixels.image_features(spark.createDataFrame(list(enumerate(grids)), "id bigint, grid array<int>")).collect()
    want = [(i, x, y, s, *pixels.describe(img, x, y)[1:]) for i, g in enumerate(grids) for img in [pixels.enlarged(g)] for x, y, s in pixels.corners(img)]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_many_files_take_few_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "folder", lambda s: f"file://{tmp_path}/at")
    rows = [(c, t, "x" * (5 if (c * 7 + t) % 9 == 0 else 6)) for c in range(30) for t in range(8)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    d.repartitionById(20, (F.col("turn") * 3 + F.col("conv_id")).cast("int")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, streams.siblings(spark, f"{tmp_path}/conversations.parquet").collect()))
    known = {c for c, _, x in rows if len(x) == 5}
    assert got == sorted((c, t) for c, t, x in rows if c in known and len(x) == 6) and len(known) < 30
    assert len([f for f in os.listdir(f"{tmp_path}/at/state/commits") if f.isdigit()]) <= 8
