"""Operators against brute force, and the cases that their docstrings define."""

import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import common, components, decontaminate, fertility, hostpaths, langid, mix, neardup, perspectives, pii, quality, shard

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)


ODD = [(1, None, None, None), (None, "", "en", "a"), (2, "   \n", "en", "a"), (3, "word " * 30_000, "en", "a"), (4, "same text here again", "en", "b"), (4, "same text here again", "en", "b"), (5, "日本語のテキスト 😀", None, "b"), (6, "!!!", "xx", None), (7, "x" * 50_000, "en", "c"), (None, None, None, None)]


def odd(spark):
    """Odd rows with extra columns whose names clash."""
    d = docs(spark, ODD)
    return d.select("*", F.lit(1).alias("keep"), F.lit(2).alias("shard"), F.lit("q").alias("TEXT"), F.lit("p").alias("action"))


def words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


# -- text splitting


def test_words_are_those_of_a_regular_expression():
    texts = ["Ab, cd-ef 12", None, "", "Ünï çödé!", "a_b", "x" * 1000]
    w = common.words(texts)
    for i, t in enumerate(texts):
        got = [t[s:e].lower() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] if t else []
        assert got == words(t)
    assert common.words(["Ab"]).hash[0] == common.words(["zz ab"]).hash[1]


def test_chunks_are_those_of_split():
    texts = ["a  b\tc d", "", None, "%% x"]
    w = common.chunks(texts)
    assert [texts[0][s:e] for s, e in zip(w.start[:4], w.end[:4])] == texts[0].split()
    assert np.diff(w.first).tolist() == [4, 0, 0, 2]


# -- 1


def brute_matches(text, items):
    t, out = words(text), []
    grams = {}
    for it in items:
        k = words(it)
        for a in range(len(k)):
            for b in range(a + 1, len(k) + 1):
                g = tuple(k[a:b])
                grams[g] = min(grams.get(g, 1 << 30), len(k))
    for i in range(len(t)):
        n = next((n for n in range(i + 1, 0, -1) if tuple(t[i - n + 1 : i + 1]) in grams), 0)
        out.append((n, grams.get(tuple(t[i - n + 1 : i + 1]), 1 << 30) if n else 1 << 30))
    return t, out


def test_decontamination_equals_brute_force():
    rng = np.random.default_rng(1)
    alphabet = list("abcdefgh")
    items = [" ".join(rng.choice(alphabet, rng.integers(1, 12))) for _ in range(12)]
    p = {"min_tokens": 5, "short_tokens": 3, "min_item_share": 0.6, "max_doc_share": 0.5}
    texts = [" ".join(rng.choice(alphabet + ["zz"], rng.integers(0, 40))) for _ in range(80)]
    for most in (10**6, 8):
        got = decontaminate.judge(texts, decontaminate.build(items, most), p)
        for text, (action, longest, _, removed, n, clean) in zip(texts, got):
            t, ms = brute_matches(text, items)
            cover = set()
            for i, (m, item) in enumerate(ms):
                if m >= 5 or m >= 3 and m >= 0.6 * item:
                    cover |= set(range(i - m + 1, i + 1))
            assert (longest, removed, n) == (max((m for m, _ in ms), default=0), len(cover), len(t))
            assert action == ("keep" if not cover else "drop" if len(cover) > len(t) / 2 else "trim")
            if action == "trim":
                assert words(clean) == [x for i, x in enumerate(t) if i not in cover]


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, "One two three four five six, seven."), (2, None), (3, "")], "item_id bigint, text string")
    d = docs(spark, [(10, "ok one TWO three-four five six seven and then a lot of other words that are quite clean and good", "en", "a"), (11, "one two three four five six seven", "en", "a"), (12, "clean", "en", "a")])
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(d, bench).collect()}
    assert [got[k]["action"] for k in (10, 11, 12)] == ["trim", "drop", "keep"] and "TWO" not in got[10]["text"] and got[12]["text"] == "clean"
    out = decontaminate.strip_benchmark(d, bench)
    assert out.columns == d.columns and {r["doc_id"] for r in out.collect()} == {10, 12}
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    o = odd(spark)
    assert decontaminate.decontaminate(o, bench).count() == len(ODD)
    s = decontaminate.strip_benchmark(o, bench.limit(0))
    assert s.columns == o.columns and s.count() == len(ODD)
    assert decontaminate.decontaminate(o.limit(0), bench).count() == 0


# -- 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r["component"] for r in components.connected(chain).collect()} == {0}
    assert components.connected(edges.limit(0)).count() == 0


def brute_groups(texts):
    """Groups by comparing every pair of sketches."""
    s = neardup.sketches(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, j in itertools.combinations([k for k in range(len(texts)) if s["n"][k]], 2):
        same = (s["content"][i] == s["content"][j]).all()
        near = np.bitwise_count(s["sim"][i] ^ s["sim"][j]).sum() <= neardup.RADIUS and np.bitwise_count(s["pairs"][i] ^ s["pairs"][j]).sum() <= neardup.VERIFY
        if same or near:
            pairs += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], pairs


def make_copies(rng, n_base, copies, change):
    vocabulary = ["w%d" % i for i in range(3000)]
    out = []
    for _ in range(n_base):
        base = rng.choice(vocabulary, rng.integers(30, 150)).tolist()
        out.append(" ".join(base))
        for _ in range(copies):
            c = [rng.choice(vocabulary) if rng.random() < change else w for w in base]
            out.append(" ".join(c))
    return out


def test_near_duplicates_recall_and_groups(spark):
    rng = np.random.default_rng(2)
    texts = make_copies(rng, 60, 2, 0.05) + make_copies(rng, 1, 60, 0.03) + make_copies(rng, 100, 0, 0) + ["Same, text!", "same text", None, ""]
    d = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    brute, n_pairs = brute_groups(texts)
    got = {r["doc_id"]: r for r in neardup.groups(d, rows_per_shard=300).collect()}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if brute[i] == brute[j]]
    found = [1 for i, j in pairs if i in got and j in got and got[i]["group_id"] == got[j]["group_id"]]
    assert n_pairs and len(found) >= 0.97 * len(pairs)
    for r in got.values():
        assert brute[r["doc_id"]] == brute[r["group_id"]]
    sizes = collections.Counter(r["group_id"] for r in got.values())
    assert all(r["group_size"] == sizes[r["group_id"]] and r["keep"] == (r["doc_id"] == r["group_id"]) for r in got.values())
    kept = neardup.deduplicate(d, rows_per_shard=300)
    assert kept.columns == d.columns and kept.count() == len(texts) - len(got) + len(sizes)


def test_near_duplicate_cases(spark):
    o = odd(spark)
    out = neardup.deduplicate(o)
    assert out.columns == o.columns and out.count() == len(ODD) - 1  # of the repeated row one stays
    assert [r["doc_id"] for r in neardup.groups(o).collect()] == [4, 4]
    assert neardup.deduplicate(o.limit(0)).count() == 0
    same_id = docs(spark, [(1, "first text of all here", "en", "a"), (1, "another one altogether now", "en", "a")])
    assert neardup.deduplicate(same_id).count() == 2


def test_graph_search_is_audited():
    rng = np.random.default_rng(3)
    n = 3000
    sim = rng.integers(0, 1 << 63, (n, 2), dtype=np.int64).view(np.uint64)
    for k in range(0, 600, 2):
        sim[k + 1] = sim[k] ^ np.uint64(0b1011 << int(rng.integers(0, 60)))
    node, route = np.arange(n), common.mix(np.arange(n, dtype=np.uint64) // 2)
    p = {"radius": 20, "verify": 256, "beam": 8, "audit": 256, "audit_recall": 0.9}
    a, b, audit = neardup.shard_edges(node, sim, np.zeros((n, 4), np.uint64), route, p)
    found = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    assert sum(frozenset((k, k + 1)) in found for k in range(0, 600, 2)) >= 0.95 * 300 and audit["found"] >= 0.9 * audit["asked"]
    # routes that say nothing: the audit widens beams until enough is found
    a, b, audit = neardup.shard_edges(node, sim, np.zeros((n, 4), np.uint64), common.mix(node.astype(np.uint64)), p)
    assert audit["found"] >= 0.9 * audit["asked"] and len(a) >= 0.9 * 300
    # a thousand points in one place: beams are crowded, an exact scan answers
    sim[:1000] = sim[0]
    a, b, _ = neardup.shard_edges(node, sim, np.zeros((n, 4), np.uint64), route, p)
    assert set(range(1, 1000)) <= set(a.tolist())


# -- 3


def test_shards_match_brute_force(spark):
    import hashlib

    rows = [(i, "t", "en", s) for i, s in enumerate(["a"] * 70 + ["b"] * 23 + [None] * 7)]
    for n_shards in (1, 4, 7, 200):
        got = {r["doc_id"]: r["shard"] for r in shard.assign(docs(spark, rows), n_shards).collect()}
        order = []
        for s in {r[3] for r in rows}:
            own = sorted((hashlib.md5(f"{shard.SEED}:{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[3] == s)
            order += [((2 * k + 1) / (2 * len(own)), s is not None, s or "", d) for k, (_, d) in enumerate(own)]
        want = {d: p * n_shards // len(rows) for p, (*_, d) in enumerate(sorted(order))}
        assert got == want
    many = shard.assign(docs(spark, rows), 4).groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - {"a": 70, "b": 23, None: 7}[r["source"]] / 4) <= 2 for r in many)


def test_shard_cases(spark):
    o = odd(spark)
    out = shard.interleave(o, 3)
    assert out.columns == [c for c in o.columns if c != "shard"] + ["shard", "shard_order"] and out.count() == len(ODD)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [3, 3, 4]
    assert shard.interleave(o.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        shard.assign(o, 0)


# -- 4


def test_fertility_figures_equal_whole_texts():
    wt = fertility._tokens(fertility.TOKENIZERS)
    texts = [None, "", " ", "a", "%%% &&&\n\n x", "日本語 テスト", "😀😀 x", "don't 12,34", "Ünï çödé " * 50, "x" * 3000]
    got = fertility.figures(texts)
    for i, t in enumerate(texts):
        parts = (t or "").split()
        if not parts:
            assert got["n_tokens"][i] == 0 and np.isnan(got["entropy"][i])
            continue
        s = " " + " ".join(parts)
        ids, pieces = wt.bpe.encode_ordinary(s), wt.pieces.encode(s[1:])
        p = np.array(list(collections.Counter(ids).values())) / len(ids)
        assert got["n_tokens"][i] == len(ids) and math.isclose(got["chars_per_token"][i], len(s) / len(ids))
        assert math.isclose(got["byte_share"][i], np.mean([wt.pieces.is_byte(x) for x in pieces]))
        if len(ids) > 1:
            assert math.isclose(got["entropy"][i], -(p * np.log2(p)).sum() / np.log2(min(len(ids), 1024)), abs_tol=1e-9)
    assert got["script"].tolist()[:6] == ["none", "none", "none", "latin", "latin", "kana"]


def test_fertility_rejects_junk_and_keeps_the_rest(spark):
    rng = np.random.default_rng(4)
    vocabulary = "the of a house tree water running green quickly small large river people city under over with from their".split()
    good = [(i, " ".join(rng.choice(vocabulary, 200)), "en", "a") for i in range(80)]
    bad = [(100, "%$# " * 200, "en", "a"), (101, "tree " * 300, "en", "a"), (102, "", "en", "a"), (103, None, "en", "a")]
    d = docs(spark, good + bad)
    got = {r["doc_id"]: r for r in fertility.judge(d).collect()}
    assert all(got[i]["keep"] for i in range(80)) and not any(got[i]["keep"] for i in range(100, 104)) and got[103]["reason"] == "empty"
    assert fertility.keep_good(d).count() == 80
    o = odd(spark)
    out = fertility.keep_good(o)
    assert out.columns == o.columns and fertility.judge(o).count() == len(ODD) and out.filter("doc_id = 4").count() == 2
    assert fertility.keep_good(o.limit(0)).count() == 0


# -- 5


def test_cube_balances_and_keeps_probabilities():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 500, 400)
    p = np.full(400, 0.3)
    mean = np.zeros(400)
    for s in range(60):
        f = mix.flight(p, tokens, s)
        assert ((f == 0) | (f == 1)).sum() >= 398 and math.isclose(f.sum(), 120, abs_tol=1e-6) and math.isclose((f * tokens).sum(), 0.3 * tokens.sum(), rel_tol=1e-9)
        out = mix.land(f, s)
        assert set(out) <= {0.0, 1.0} and abs(out.sum() - 120) < 1 + 1e-6 and abs((out * tokens).sum() - 0.3 * tokens.sum()) <= 1000
        mean += out / 60
    assert abs(mean.mean() - 0.3) < 0.01 and mean.std() < 0.12
    assert mix.land(mix.flight(np.full(5, 0.5), np.zeros(5), 1), 1).sum() in (2, 3)
    assert len(mix.flight(np.empty(0), np.empty(0), 1)) == 0


def test_probabilities_reach_targets():
    p = mix.probabilities({"a": 1000, "b": 100, None: 100}, {"a": 1, "b": 1}, budget=0.1)
    assert p[None] == 0 and math.isclose(p["a"] * 1000, p["b"] * 100)
    full = mix.probabilities({"a": 1000, "b": 10}, {"a": 1, "b": 1}, budget=0.5)
    assert full["b"] == 1 and math.isclose(full["a"] * 1000 + 10, 505)
    assert mix.probabilities({}) == {} and mix.probabilities({"a": 0}) == {"a": 1.0}


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", "hot" if i < 600 else f"s{i % 4}") for i in range(1000)]
    d = docs(spark, rows)
    got = mix.sample(d).collect()
    by = collections.defaultdict(lambda: [0, 0.0, 0, 0.0])
    for r in got:
        x = by[r["source"]]
        x[0] += r["selected"]
        x[1] += r["pi"]
        x[2] += r["selected"] * r["n_tokens"]
        x[3] += r["pi"] * r["n_tokens"]
    assert all(abs(n - e) <= 1 and abs(t - et) <= 120 for n, e, t, et in by.values())
    assert mix.mixed(d).columns == d.columns and mix.mixed(d).count() == sum(r["selected"] for r in got)
    o = odd(spark)
    assert mix.sample(o).count() == len(ODD) and mix.mixed(o).columns == o.columns and mix.mixed(o.limit(0)).count() == 0


def test_mixing_reaches_targets_on_a_hot_source(spark):
    rng = np.random.default_rng(16)
    rows = [(i, "w " * int(rng.integers(20, 40)), "en", "hot" if i < 1800 else f"s{i % 19}") for i in range(2000)]
    total, taken = collections.Counter(), collections.Counter()
    for r in mix.sample(docs(spark, rows)).collect():
        total[r["source"]] += r["n_tokens"]
        taken[r["source"]] += r["selected"] * r["n_tokens"]
    every, got = sum(t**0.5 for t in total.values()), sum(taken.values())
    target, reached = {s: t**0.5 / every for s, t in total.items()}, {s: taken[s] / got for s in total}
    assert all(reached[s] <= 1.05 * target[s] + 80 / got for s in total)
    assert sum(max(0, target[s] - reached[s]) for s in total) <= 0.05
    assert all(taken[s] == total[s] for s in total if reached[s] < 0.9 * target[s])


def test_probabilities_bound_the_excess():
    totals = {"hot": 900_000} | {k: 100_000 // 19 for k in range(19)}
    weigh = lambda p: {s: p[s] * t for s, t in totals.items()}
    exact = weigh(mix.probabilities(totals, over=1))
    every = sum(t**0.5 for t in totals.values())
    assert all(math.isclose(x / sum(exact.values()), totals[s] ** 0.5 / every) for s, x in exact.items()) and math.isclose(exact[0], totals[0])
    loose = weigh(mix.probabilities(totals, over=1.05))
    assert math.isclose(loose["hot"] / sum(loose.values()), 1.05 * totals["hot"] ** 0.5 / every)
    # a source of one token costs the others nothing
    tiny = mix.probabilities({"a": 10**6, "b": 10**6, "c": 1}, over=1.05)
    assert tiny["c"] == 1 and math.isclose(tiny["a"], 0.7, rel_tol=1e-5)
    even = {"a": 1000, "b": 1000}
    assert mix.probabilities(even, over=1) == mix.probabilities(even) and mix.probabilities({}, over=1) == {} and mix.probabilities({"a": 0}, over=1) == {"a": 1.0}


# -- 6


def test_personal_data_cases(spark):
    o = odd(spark).union(odd(spark).limit(1).withColumn("doc_id", F.lit(99).cast("bigint")).withColumn("text", F.lit('a 4111 1111 1111 1111 b 10.0.0.1, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". 1234567812345678 v1.2.3')))
    got = {r["doc_id"]: r for r in pii.redact(o).collect()}
    assert got[99]["text"] == 'a [CARD] b [IP], token = "[SECRET]". 1234567812345678 v1.2.3'
    assert got[1]["text"] is None and got[1]["n_entities"] == 0 and got[7]["text"] == "x" * 50_000
    assert pii.redact(o.limit(0)).count() == 0


# -- 7


def test_perspectives(spark):
    d = spark.createDataFrame([(1, 2, "bob", "hi <|end|>"), (1, 1, "system", "rules"), (1, 3, "eve x", None), (None, None, None, "alone"), (2, 1, "system", "only")], "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in perspectives.rotate(d).collect()}
    assert set(got) == {(1, "bob"), (1, "eve_x"), (None, "unknown")}
    r = got[1, "bob"]
    assert r["rendered"] == "<|start|>system\nrules<|end|>\n<|start|>assistant\nhi < |end|><|end|>\n<|start|>user name=eve_x\n<|end|>\n"
    s, e = map(int, r["mask"].split("-"))
    assert r["rendered"][s:e] == "hi < |end|><|end|>" and r["n_learnt"] == 1 and r["n_turns"] == 3
    s, e = map(int, got[1, "eve_x"]["mask"].split("-"))
    assert got[1, "eve_x"]["rendered"][s:e] == "<|end|>"
    assert perspectives.rotate(d.limit(0)).count() == 0


# -- 8


def test_host_paths(spark):
    page = lambda body: f'<html><body><nav>menu menu</nav><div class="Post-12 x">{body}</div><footer>f</footer></body></html>'
    rows = [(i, "https://A.example.com:80/p", page(f"<p>text number {i} is here<p>and more <b>of it</b>")) for i in range(3)]
    rows += [(3, "https://a.example.com/q", '<html><body><div class="post-7 x">s</div><div class="huge">' + "comment " * 50 + "</div></body></html>"), (4, "https://a.example.com/r", "<html><body><main>only this</main></body></html>"), (5, None, page("no host")), (6, "nonsense", None), (None, "https://b.example.com", "a < b <p>loose"), (8, "https://c.example.com/", "<div><script>var x='</div>'</script>x &amp; y<!-- <p>no --></div")]
    got = {r["page_id"]: r for r in hostpaths.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0]["text"] == "text number 0 is here\nand more of it" and got[0]["path"] == "/html/body/div.post-#.x" and got[0]["host"] == "a.example.com"
    assert got[3]["text"] == "s" and not got[3]["fallback"]  # the host's path wins over the page's own
    assert got[4]["text"] == "only this" and got[4]["fallback"] and got[5]["text"] == "no host" and got[6]["text"] == ""
    assert got[None]["text"] == "" and got[8]["text"] == "x & y"
    assert hostpaths.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_many_open_tags_take_linear_time():
    assert hostpaths.scores("<a " * 100_000) == {} and hostpaths.scores("<div><p>" * 20_000 + "x")


# -- 9


def test_codes_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        c = langid.code_for(n).astype(int)
        apart = min(((c[i] != c[j]).sum() for i, j in itertools.combinations(range(n), 2)))
        assert apart >= (1 if n == 2 else 2 if n == 3 else 4)


def test_language_identification(spark):
    stock = {"en": "the and of with house water people over there this that which", "de": "der die und mit haus wasser leute über dort diese welche nicht", "fr": "le la et avec maison eau gens sur là cette quel pas été"}
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(stock[k].split(), 25)), k, "a") for i, k in enumerate(["en", "de", "fr"] * 60)]
    m = langid.fit(langid.counts([r[1] for r in rows[:120]]), [r[2] for r in rows[:120]], rounds=60)
    got = langid.predict([r[1] for r in rows[120:]], m)
    assert np.mean([g[0] == r[2] for g, r in zip(got, rows[120:])]) > 0.97
    x = langid.counts([rows[0][1]])
    assert math.isclose(x.share.sum(), 1, rel_tol=1e-5)
    mixed = langid.predict([stock["en"] + " " + stock["de"]], m)[0]
    assert mixed[2] < min(g[2] for g in got[:30])
    assert langid.predict([None, "", "!!"], m) == [(None, True, 0.0, 0)] * 3 and langid.predict(["a"], None) == [(None, True, 0.0, 0)]
    assert langid.predict(["abc"], langid.fit(langid.counts(["abc"]), ["en"]))[0][0] == "en"
    o = odd(spark)
    assert langid.identify(o, langid.train(o)).count() == len(ODD) and langid.identify(o.limit(0), langid.train(o.limit(0))).count() == 0


# -- 10


def test_context_vectors_equal_brute_force(spark):
    texts = ["a b c a", "b a", "c", None, "a b a b"]
    v = quality.learn_vectors(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 0.3)
    hashes = {w: common.words([w]).hash for w in "abc"}
    index = {w: quality.index_vectors(h)[0] for w, h in hashes.items()}
    for w in "ab":
        want = np.zeros(quality.DIM)
        for t in texts:
            t = (t or "").split()
            for i, x in enumerate(t):
                if x == w:
                    want += sum((index[t[i + o]] for o in quality.WINDOW if 0 <= i + o < len(t)), np.zeros(quality.DIM))
        got = v.context[np.flatnonzero(v.key == hashes[w][0])[0]]
        assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)


def test_rare_words_have_context_vectors(spark):
    texts = ["common filler words %s" % ("zebra runs" if i < 5 else "lonely" if i == 5 else "") for i in range(3000)]
    v = quality.learn_vectors(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    have = set(v.key.tolist())
    assert all(int(common.words([w]).hash[0]) in have for w in ("common", "zebra", "runs")) and int(common.words(["lonely"]).hash[0]) not in have
    assert (np.diff(v.key) > 0).all()


def test_context_vectors_are_added_over_parts(spark, monkeypatch):
    rng = np.random.default_rng(18)
    texts = [" ".join("w%d" % k for k in rng.zipf(1.3, 40) % 900) for _ in range(400)] + ["top " * 900]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    h, count, vec = quality.contexts(common.words(texts))
    for r, t in ((0, 1), (len(h) // 2, 2)):
        assert count[r] == sum(h[r] in common.words([x]).hash for x in texts)
    for name in ("_HELD", "_FLUSH", "_ROWS"):
        monkeypatch.setattr(quality, name, 50)
    v = quality.learn_vectors(d.repartition(5), 3)
    keep = count >= 3
    assert (v.key == h[keep]).all() and np.allclose(v.context, vec[keep] / np.maximum(np.linalg.norm(vec[keep].astype(float), axis=1, keepdims=True), 1), atol=1e-5)
    same = quality._unpack(*quality._pack(h, count, vec))
    order = np.argsort(same[0])
    assert (same[0][order] == h).all() and (same[1][order] == count).all() and (same[2][order] == vec).all() and vec.max() > 127


def test_quality_classifier(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = rng.choice(vocabulary, 60).tolist()
        toxic, low = int(i % 4 == 0), int(i % 5 == 0)
        if toxic:
            t[int(rng.integers(60))] = "nasty"
        if low:
            t = [w + "%%%" for w in t]
        rows.append((i, " ".join(t), "en", "a"))
        labels.append((i, 1 - low, toxic))
    d = docs(spark, rows)
    lab = spark.createDataFrame([*labels[:300], (0, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    m = quality.train(d, lab)
    got = {r["doc_id"]: r for r in quality.classify(d, m).collect()}
    held = range(300, 400)
    assert np.mean([got[i]["toxic"] == bool(labels[i][2]) for i in held]) > 0.9 and np.mean([(got[i]["p_quality"] >= 0.5) == bool(labels[i][1]) for i in held]) > 0.9
    o = odd(spark)
    assert quality.classify(o, m).count() == len(ODD)
    none = quality.train(o.limit(0), lab.limit(0))
    assert {r["p_toxic"] for r in quality.classify(o, none).collect()} == {0.5}
    same = quality.train(d, lab.filter("toxic = 0"))
    assert {r["p_toxic"] for r in quality.classify(d.limit(5), same).collect()} == {0.0}


def test_temperature_calibrates():
    rng = np.random.default_rng(9)
    z = rng.normal(0, 2, (5000, 1))
    y = (rng.random((5000, 1)) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.temperatures(z * 3, y)[0] - 3) < 0.4


# -- pipeline


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    cols = d.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    n = d.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, sf)
        if k < 4:
            assert d.columns == cols
        d.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0 < d.count() <= n
        n = d.count()
    assert d.select("doc_id").distinct().count() == n
