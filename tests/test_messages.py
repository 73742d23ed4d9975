import datetime as dt

import numpy as np
import pytest

from talkharvest.operators import clustering, recap
from talkharvest.sources import stores
from talkharvest.streaming import memory

M = "message_id string, farm_id string, visit_month string, status string, findings array<struct<id:string,confidence:double>>, coop_findings array<string>, not_sure_count int"
F21 = [("P1", "positive", "welcome", 1), ("P2", "positive", "guiding", 2), ("N1", "negative", "road", 3)]


def messages(spark, rows):
    return spark.createDataFrame([(i, f, m, s, [(x, 0.9) for x in fs], fs, n) for i, f, m, s, fs, n in rows], M)


def findings(spark):
    return spark.createDataFrame(F21, "finding_id string, polarity string, label_en string, ordinal int")


def test_recap(spark):
    m = messages(spark, [
        ("a", "f", "2026-01", "analyzed", ["P1", "N1"], 0), ("b", "f", "2026-02", "analyzed", ["P1", "P2", "N1"], 2), ("c", "f", "2026-02", "duplicate", ["P2"], 9),
        ("d", "f", "2026-04", "not_sure", [], -1), ("e", None, "2026-04", "analyzed", ["P1"], 0),
    ])
    lines = {(r.visit_month, r.line_no): r.text for r in recap.lines(m, findings(spark)).collect()}
    assert lines == {
        ("2026-01", 1): "Messages this month: 1", ("2026-01", 2): "Keep: welcome (1)", ("2026-01", 3): "Nothing urgent",
        ("2026-02", 1): "Messages this month: 1", ("2026-02", 2): "Keep: welcome (1)", ("2026-02", 3): "Again, 2 months in a row: road", ("2026-02", 5): "Not understood: 2",
        ("2026-04", 1): "Messages this month: 1", ("2026-04", 3): "Nothing urgent",
    }
    assert recap.lines(m.limit(0), findings(spark)).count() == 0


def test_cooperative(spark):
    m = messages(spark, [("a", "f1", "2026-01", "analyzed", ["P1"], 0), ("b", "f2", "2026-01", "analyzed", ["P1"], 0), ("c", "f1", "2026-01", "duplicate", ["N1"], 0)])
    farms = spark.createDataFrame([("f1", True), ("f2", None), ("f3", True)], "farm_id string, consent boolean")
    r = recap.cooperative(m, farms, findings(spark)).collect()
    assert [(x.finding, x.farms, x.mentions, x.consenting) for x in r] == [("P1", 1, 1, 2)]


def test_average_linkage():
    x = np.array([[1, 0], [0.99, 0.141], [0, 1], [0.02, 0.9998]])
    assert clustering.average_linkage(x, 0.57).tolist() == [0, 0, 2, 2]
    assert clustering.average_linkage(x[:1], 0.57).tolist() == [0]


def test_stores(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"lang": "en", "findings": {"N1": ["road", "track*"]}}')
    assert {(r.finding, r.term) for r in stores.read_keywords(spark, str(tmp_path / "k.json")).collect()} == {("N1", "road"), ("N1", "track*")}
    assert stores.read_json(spark, str(tmp_path / "none.json"), "a int", optional=True).count() == 0
    (tmp_path / "f.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert stores.read_jsonl(spark, str(tmp_path / "f.jsonl"), stores.FEEDBACK).count() == 2
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3)], "k string, v int")
    assert sorted(map(tuple, stores.upsert(stores.upsert(old, new, "k"), new, "k").collect())) == [("a", 1), ("b", 3)]
    assert stores.without(old, new, "k").count() == 1
    kv = spark.createDataFrame([("a", "1", 1), ("a", None, 2), ("b", "5", 1)], "name string, value string, seq int")
    assert dict(map(tuple, stores.settings(kv, {"a": "d", "c": "e"}).collect()))["c"] == "e"
    doc = spark.createDataFrame([(1, "1", ["en"], [("P1", "negative", {"en": "x"}, {"en": ["hi"]}, {"en": ["road"]})], [])], stores.CATALOGUE)
    assert [r.fault for r in stores.catalogue_faults(doc).collect()] == ["polarity against id"]
    stores.write_by_month(spark.createDataFrame([("2026-01", 1)], "visit_month string, v int"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("visit_month = '2026-01'").count() == 1


@pytest.mark.parametrize("chained, want", [(True, [False, True, True, False]), (False, [False, True, False, False])])
def test_stream_duplicates(spark, tmp_path, chained, want):
    days = (1, 6, 12, 25)
    rows = [(f"m{d:02}", "fp", dt.datetime(2026, 1, d)) for d in days]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "message_id string, fingerprint string, received_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = memory.queue(spark, str(tmp_path / "in"), "message_id string, fingerprint string, received_at timestamp")
        memory.drain(memory.mark_duplicates(s, chained), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.message_id: r.duplicate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[f"m{d:02}"] for d in days] == want


def test_stream_month_closing(spark, tmp_path):
    schema = "chunk_id string, visit_month string, received_at timestamp"
    parts = [[("a", "2026-01", dt.datetime(2026, 1, 3)), ("b", "2026-01", dt.datetime(2026, 1, 20))], [("c", "2026-02", dt.datetime(2026, 2, 20))], [("d", "2026-03", dt.datetime(2026, 3, 20))], [("late", "2026-01", dt.datetime(2026, 3, 20)), ("e", "2026-03", dt.datetime(2026, 3, 21))]]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        memory.drain(memory.close_months(memory.queue(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.visit_month, r.side): r.chunk_ids for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2026-01", "closed"] == ["a", "b"]
    assert got["2026-01", "late"] == ["late"]


def test_pipeline(spark):
    from pyspark.sql import functions as F

    from talkharvest.functions.embedding import embed, hashing
    from talkharvest.operators import analysis

    spans = spark.createDataFrame([("N1", False, "the road was hard"), ("P3", False, "we loved the tasting")], "finding string, negated boolean, span string")
    m = spark.createDataFrame([("a", "The road was hard. We loved the tasting.", "en"), ("b", None, "en"), ("c", "  ", None), ("d", "Blue bicycles everywhere", "en"), ("e", "♪♪", "en")], "message_id string, text string, lang string")
    r = {x.message_id: x for x in analysis.analysed(m, embed(spans, "span").drop("span"), floor=0.5, accept=0.6).collect()}
    assert {f.id for f in r["a"].findings} == {"N1", "P3"} and r["a"].status == "analyzed"
    assert r["b"].status == r["c"].status == r["e"].status == "inaudible"
    assert r["d"].off_list_count == 1 and r["d"].findings == []
    assert analysis.aligned(["the road", "we loved", "xx"], ["the road was", "hard we loved it"]) == [0, 1, 1]
    tries = spark.createDataFrame([("k", 1, 0.5, 0.9), ("k", 2, 0.85, 0.9), ("j", 1, 0.2, 0.9), ("j", 2, 0.4, 0.3)], "key string, attempt int, forth double, back double")
    assert dict(map(tuple, analysis.chosen_translation(tries).collect())) == {"k": 2, "j": 2}
    twice = embed(spark.createDataFrame([("x",), ("x",), (None,)], "t string"), "t").orderBy(F.col("t").isNull()).collect()
    assert twice[0].embedding == twice[1].embedding and twice[2].embedding is None
    assert all(abs(float((v * v).sum()) - 1) < 1e-5 for v in hashing(["a b", ""]))


def test_near_duplicates(spark, tmp_path):
    from talkharvest.plans import message_queries as Q

    def at(cosine):
        return [cosine, (1 - cosine**2) ** 0.5]

    day = lambda d: dt.datetime(2026, 1, d)
    rows = [
        ("a", "f", day(1), at(1.0)), ("b", "f", day(8), at(0.985)), ("c", "f", day(3), at(0.975)), ("d", "f", day(9), at(-1.0)), ("e", "g", day(2), at(1.0)),
        ("f", "f", day(20), at(1.0)), ("g", "f", day(21), at(0.4)), ("h", None, day(2), at(1.0)), ("i", "f", None, at(1.0)), ("j", "f", day(2), None),
    ]
    wide = [(i, f, t, v and v + [0.0] * 62, None, None) for i, f, t, v in rows]
    spark.createDataFrame(wide, "message_id string, farm_id string, received_at timestamp, embedding array<double>, fingerprint string, text string").write.parquet(str(tmp_path / "messages_raw.parquet"))
    old = [("s", day(26), [0.4, 0.84**0.5] + [0.0] * 62, None)]
    spark.createDataFrame(old, "message_id string, received_at timestamp, embedding array<double>, fingerprint string").write.parquet(str(tmp_path / "messages_stored.parquet"))
    # b repeats a (0.985, 7 days) and c (0.9993); e and h repeat a whatever their farm, the undated i all of them; g repeats
    # the stored s, which is 5 days younger; c is only at 0.975 to a
    assert sorted(r.message_id for r in Q.dup_near_embeddings(spark, str(tmp_path)).collect()) == ["b", "e", "g", "h", "i"]


def test_trends_cover_all_months(spark, tmp_path):
    from talkharvest.plans import message_queries as Q

    m = messages(spark, [
        ("a", "f", "2025-02", "analyzed", ["P1", "P1"], 0), ("b", "g", "2025-02", "analyzed", ["P1"], 0), ("c", "f", "2026-06", "analyzed", ["N1"], 0), ("d", "f", "2026-06", "not_sure", [], 1),
        ("e", "f", "2026-01", "duplicate", ["P2"], 0), ("f", None, "2026-06", "analyzed", ["P1"], 0), ("g", "f", None, "analyzed", ["P1"], 0),
    ])
    m.write.parquet(str(tmp_path / "messages_stored.parquet"))
    got = sorted(map(tuple, Q.trend_matrix(spark, str(tmp_path)).select("finding", "visit_month", "k", "n").collect()))
    assert got == [("N1", "2025-02", 0, 2), ("N1", "2026-01", 0, 0), ("N1", "2026-06", 1, 2), ("P1", "2025-02", 2, 2), ("P1", "2026-01", 0, 0), ("P1", "2026-06", 0, 2)]


def test_average_linkage_is_the_plain_greedy_one():
    from talkharvest.operators.clustering import average_linkage

    r = np.random.default_rng(2)
    x = np.repeat(r.standard_normal((6, 20)), 7, 0) + 0.5 * r.standard_normal((42, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while True:
        s, i, j = max(((float((x[a] @ x[b].T).mean()), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(-1, 0, 0))
        if s < 0.57:
            break
        groups[-i] += groups.pop(-j)
    got = average_linkage(x, 0.57)
    assert {frozenset(np.flatnonzero(got == k)) for k in set(got)} == {frozenset(g) for g in groups} and len(groups) < 42
    assert len(average_linkage(x[:0], 0.57)) == 0


def test_clusters_for_review(spark):
    from talkharvest.operators import clustering

    m = spark.createDataFrame([("f", "m", f"c{i}", f"v{i % 3 if k == 'a' else 1}", k) for i, k in enumerate("aaaabbc")], "farm_id string, visit_month string, chunk_id string, visitor string, cluster string")
    assert [(r.cluster, r.chunks, r.visitors, r.recurring) for r in clustering.described(m).collect()] == [("a", 4, 3, True), ("b", 2, 1, False), ("c", 1, 1, False)]
    chunks = spark.createDataFrame([(f"c{i}",) for i in (0, 4, 9)], "chunk_id string")
    assert {r.chunk_id: (r.cluster, r.recurring) for r in clustering.reviewed(chunks, m).collect()} == {"c0": ("a", True), "c4": ("b", False), "c9": (None, False)}


def test_quiet_months_and_unknown_topics(spark):
    m = messages(spark, [("a", "f", "2026-01", "analyzed", ["P1"], 0), ("b", "g", "2026-02", "analyzed", ["N1", "N1"], 0), ("c", "g", "2026-02", "analyzed", ["N1"], 2), ("d", "f", "2026-02", "duplicate", ["P1"], 0)])
    f = spark.createDataFrame([("P1", "positive", "good", 1), ("N1", "negative", "bad", 2)], "finding_id string, polarity string, label_en string, ordinal int")
    u = spark.createDataFrame([("g", "2026-02", 4), ("f", "2026-02", 3)], "farm_id string, visit_month string, k int")
    got = {(r.farm_id, r.visit_month, r.line_no): r.template for r in recap.lines(m, f, u).collect()}
    assert got == {
        ("f", "2026-01", 1): "volume", ("f", "2026-01", 2): "keep", ("f", "2026-01", 3): "nothing_urgent", ("f", "2026-02", 1): "no_feedback", ("g", "2026-01", 1): "no_feedback",
        ("g", "2026-02", 1): "volume", ("g", "2026-02", 3): "fix", ("g", "2026-02", 4): "unknown_topic", ("g", "2026-02", 5): "not_understood",
    }
    bad = spark.createDataFrame([("g", "2026-02", -1)], "farm_id string, visit_month string, k int")
    assert recap.lines(m, f, bad).where("line_no = 4").count() == 0


def test_near_memory_of_a_stream(spark, tmp_path):
    schema = "message_id string, received_at timestamp, embedding array<float>"
    r = np.random.default_rng(1)
    a, b = r.standard_normal(64), r.standard_normal(64)
    day = lambda d: dt.datetime(2026, 1, d)
    near = lambda v: [float(x) for x in v + 0.02 * r.standard_normal(64)]
    batches = [
        [("a", day(1), near(a)), ("b", day(1), near(b))],
        [("c", day(7), near(a)), ("d", day(20), near(b)), ("e", day(8), None)],
        [("f", None, near(a)), ("g", day(22), near(b)), ("h", day(30), near(-a))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # a second run finds nothing new
            memory.near_memory(memory.queue(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {x.message_id: x.duplicate for x in spark.read.parquet(str(tmp_path / "out/decisions")).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False, "e": False, "f": True, "g": True, "h": False}


def test_three_phases(spark, tmp_path):
    from pyspark.sql import functions as F

    from talkharvest.functions.embedding import embed
    from talkharvest.operators import analysis

    spans = embed(spark.createDataFrame([("N1", False, "the road was hard")], "finding string, negated boolean, span string"), "span").drop("span")
    clips = spark.createDataFrame([("a", "en", "The road was hard."), ("b", "en", "The road was soft. Perhaps."), ("c", "en", None)], "message_id string, lang string, sound string")
    out = analysis.three_phases(clips, spans, str(tmp_path), lambda c: c.withColumnRenamed("sound", "text"), F.upper, floor=0.3, accept=0.95)
    assert [(x.message_id, x.sentence_index, x.translation) for x in out.orderBy("sentence_index").collect()] == [("b", 0, "THE ROAD WAS SOFT."), ("b", 1, "PERHAPS.")]


def test_judging_against_plain_products(spark):
    from talkharvest.operators import analysis

    r = np.random.default_rng(3)
    ex = [("AB"[i % 2], bool(i % 3), [float(x) for x in r.standard_normal(8)]) for i in range(12)]
    rows = [(i, bool(i % 2), [float(x) for x in r.standard_normal(8)]) for i in range(9)]
    e = spark.createDataFrame(ex, "finding string, negated boolean, embedding array<float>")
    m = spark.createDataFrame(rows, "i int, negated boolean, embedding array<float>")
    dot = lambda a, b: float(np.float32(a).astype(float) @ np.float32(b).astype(float))
    for x in m.select("i", "negated", "embedding", analysis.judged(e)("embedding", "negated").alias("j")).collect():
        near = {f: [max((dot(x.embedding, v) for g, n, v in ex if g == f and (n == x.negated) == same), default=-1) for same in (True, False)] for f in "AB"}
        f = max("AB", key=lambda f: near[f][0])
        assert (x.j.finding, x.j.agree, x.j.inverted, x.j.top) == (f, pytest.approx(near[f][0]), pytest.approx(near[f][1]), pytest.approx(max(max(v) for v in near.values())))
    none = m.select(analysis.judged(e.limit(0))("embedding", "negated").alias("j")).first().j
    assert (none.finding, none.agree, none.top) == (None, -1.0, -1.0)
