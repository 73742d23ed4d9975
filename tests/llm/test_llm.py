import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("talkharvest.llm")

from talkharvest.llm import arrivals, clusters, encoding, languages, levels, packing, privacy, sampling, sentences  # noqa: E402

# ---------------------------------------------------------------- p1

C = "chunk_id string, message_id string, visitor_key string, visit_month string, status string, reason string, embedding array<float>, id int, cluster string"


def chunk_rows(dim=160, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for month in ("2026-01", "2026-02"):
        centre = r.standard_normal((4, dim))
        for k in range(4):
            for i in range(2 + 3 * k):
                v = centre[k] + 0.45 * r.standard_normal(dim)
                rows.append((f"{month}:{k}:{i}", f"m{k}{i}", None if i % 2 else "v", month, "off_list", None, [float(x) for x in v], 1, "x"))
        for i in range(6):
            rows.append((f"{month}:s:{i}", f"s{i}", "v", month, "not_sure", "below_threshold", [float(x) for x in r.standard_normal(dim)], 1, "x"))
    return rows


def test_clusters(spark):
    rows = chunk_rows()
    same = ("2026-01:copy", *rows[0][1:])  # equal vector
    bad = [(f"bad{i}", "m", None, "2026-01", "off_list", None, e, 1, "x") for i, e in enumerate([None, [], [0.0] * 160, [float("nan")] + [1.0] * 159, [1.0] * 12])]
    other = ("no", "m", None, "2026-01", "matched", None, rows[0][6], 1, "x")
    df = spark.createDataFrame([*rows, rows[0], same, *bad, other], C)
    got = clusters.assign(clusters.candidates(df)).collect()
    assert len(got) == len(rows) + 1
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.id)
    want = {frozenset(i for i in (x[0] for x in rows) if i.startswith(f"{m}:{k}:")) | ({"2026-01:copy"} if (m, k) == ("2026-01", 0) else set()) for m in ("2026-01", "2026-02") for k in range(4)}
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == want
    d = {r["size"]: r for r in clusters.described(clusters.assign(clusters.candidates(df))).collect()}
    assert d[11].distinct_visitors >= 2 and len(d[11].typical) <= 3
    assert clusters.assign(clusters.candidates(df.limit(0))).count() == 0


def test_typical_members_are_the_nearest(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal(160)
    vecs = {f"c{i:02}": centre + (1.0 - 0.02 * i) * r.standard_normal(160) * 0.6 for i in range(40)} | {"x0": r.standard_normal(160)}
    rows = [(i, "2026-01", f"v{i}", [float(x) for x in np.float32(v)], "u", "a" if i[0] == "c" else "b") for i, v in vecs.items()]
    df = spark.createDataFrame(rows, "id string, period string, visitor string, embedding array<float>, unit string, cluster string")
    got = {x.cluster: x for x in clusters.described(df).collect()}
    ids = [i for i in vecs if i[0] == "c"]
    x = np.stack([np.float32(vecs[i]) for i in ids]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = clusters.quantised(x.astype(np.float32), 0)
    n = np.bincount(cells)
    at = [k for k in range(len(ids)) if cells[k] == len(n) - 1 - n[::-1].argmax()]
    m = x[at].sum(0)
    best = sorted(at, key=lambda k: (-(x[k] @ m), ids[k]))[:3]
    assert set(got) == {"a"} and got["a"].typical == sorted(ids[k] for k in best) and len(at) > 3
    assert got["a"].typical != sorted(ids[k] for k in at)[:3]


def test_full_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 4)
    rows = chunk_rows(seed=2)
    got = clusters.assign(clusters.candidates(spark.createDataFrame(rows, C))).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.id)
    assert sorted(len(g) for g in groups.values() if len(g) > 1) == [2, 2, 5, 5, 8, 8, 11, 11]


def test_a_hot_cell_loses_no_row(spark, monkeypatch):
    # a third of all rows are of one topic and nearly one direction: far more than a cell holds
    monkeypatch.setattr(clusters, "CELL_ROWS", 40)
    r = np.random.default_rng(7)
    hot, wide = r.standard_normal(160), r.standard_normal(160)
    vecs = [hot + 0.02 * r.standard_normal(160) for _ in range(200)] + [wide + 0.5 * r.standard_normal(160) for _ in range(200)] + [r.standard_normal(160) for _ in range(200)]
    rows = [(f"c{i:03}", "m", None, "2026-01", "off_list", None, [float(x) for x in v], 1, "x") for i, v in enumerate(vecs)]
    got = {}
    for x in clusters.assign(clusters.candidates(spark.createDataFrame(rows, C))).collect():
        got.setdefault(x.cluster, set()).add(int(x.id[1:]))
    assert sorted((g for g in got.values() if len(g) > 1), key=min) == [set(range(200)), set(range(200, 400))]


def test_blocks_of_a_cell_share_a_row(spark):
    rows = [("p", 1, f"u{i:02}", 1.0, bytes([1] * 160)) for i in range(11)] + [("p", 2, "v", 1.0, bytes([1] * 160))]
    placed = spark.createDataFrame(rows, "period string, cell long, unit string, w double, vec binary").coalesce(1)
    seen = clusters._by_cell(placed, lambda name, unit, w, x: {"unit": [",".join(unit)]}, "unit string", 160, 4).collect()
    assert sorted(r.unit for r in seen) == ["u00,u01,u02,u03", "u03,u04,u05,u06", "u06,u07,u08,u09", "u09,u10"]


def grouped(spark, vecs):
    rows = [(f"c{i:03}", "m", None, "2026-01", "off_list", None, [float(x) for x in v], 1, "x") for i, v in enumerate(vecs)]
    got = {}
    for x in clusters.assign(clusters.candidates(spark.createDataFrame(rows, C))).collect():
        got.setdefault(x.cluster, []).append(int(x.id[1:]))
    return list(got.values())


def test_no_partner_is_lost_to_full_cells_and_blocks(spark, monkeypatch):
    # alike on average, but below the link limit, so only comparing all groups brings them together
    monkeypatch.setattr(clusters, "CELL_ROWS", 8)
    monkeypatch.setattr(clusters, "DEPTH", 1)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 50)
    monkeypatch.setattr(clusters, "PART_ROWS", 55)  # at first too large for one task
    r = np.random.default_rng(11)
    vecs = np.concatenate([r.standard_normal(160) + 0.8 * r.standard_normal((60, 160)) for _ in range(3)] + [r.standard_normal((30, 160))]).astype(np.float32)
    groups = grouped(spark, vecs)
    x = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    mean = np.stack([x[g].mean(0) for g in groups])
    between = mean @ mean.T
    np.fill_diagonal(between, -1)
    assert between.max() < clusters.LIMIT
    assert all((len(g) ** 2 * mean[i] @ mean[i] - len(g)) / (len(g) * (len(g) - 1)) >= clusters.LIMIT for i, g in enumerate(groups) if len(g) > 1)
    assert all(len({min(i // 60, 3) for i in g}) == 1 for g in groups if len(g) > 1) and max(map(len, groups)) > 30


def test_all_rows_of_a_cell_no_rotation_parts_meet(spark):
    # one direction and 40 rows: any two must share a cell however small the cells are
    near = np.ones(160) + 1e-4 * np.random.default_rng(3).standard_normal((40, 160))
    units = spark.createDataFrame([("2026-01", f"u{i:02}", 1, (v / np.linalg.norm(v)).astype(np.float32).tobytes()) for i, v in enumerate(near)], "period string, unit string, n long, vec binary")
    met = clusters._by_cell(clusters._placed(units, 0, 1, 160, 8), lambda name, unit, w, x: {"unit": [",".join(unit)]}, "unit string", 160).collect()
    pairs = {(a, b) for r in met for a in r.unit.split(",") for b in r.unit.split(",") if a < b}
    assert len(pairs) == 40 * 39 // 2 and max(r.unit.count(",") + 1 for r in met) < 30


def test_merging_against_the_best_pair_first():
    r = np.random.default_rng(9)
    for _ in range(20):
        x = r.standard_normal((3, 12))[r.integers(0, 3, 30)] + 0.7 * r.standard_normal((30, 12))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(30)]
        while True:
            m = np.stack([x[g].mean(0) for g in groups])
            s = np.triu(m @ m.T, 1)
            i, j = np.unravel_index(s.argmax(), s.shape)
            if s[i, j] < clusters.LIMIT:
                break
            groups[i] += groups.pop(j)
        into = clusters._merged_into(x, np.ones(30), clusters.LIMIT)
        assert sorted(map(sorted, groups)) == sorted(np.flatnonzero(into == k).tolist() for k in set(into))


def test_nearest_against_all_pairs(monkeypatch):
    monkeypatch.setattr(clusters, "HELD", 90)
    r = np.random.default_rng(6)
    x = r.standard_normal((41, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x.astype(float) @ x.T.astype(float)).astype(np.float32)
    np.fill_diagonal(s, -2)
    s[s < 0.5] = -2
    ((at, best),) = clusters._nearest(x, None, 0.5)
    assert np.allclose(best, s.max(1), atol=1e-6) and (at == np.where(s.max(1) > -2, s.argmax(1), 0)).all()
    (at_a, best_a), (at_b, best_b) = clusters._nearest(x[:13], x[13:], 0.5)
    assert np.allclose(best_a, s[:13, 13:].max(1), atol=1e-6) and np.allclose(best_b, s[13:, :13].max(1), atol=1e-6)
    near = s > -2
    for _ in range(6):
        near = near | (near.astype(int) @ near > 0)
    np.fill_diagonal(near, True)
    assert (clusters._connected(x, None, 0.5) == near.argmax(1)).all()
    assert (at_a[best_a > -2] == s[:13, 13:].argmax(1)[best_a > -2]).all() and (at_b[best_b > -2] == s[13:, :13].argmax(1)[best_b > -2]).all()


# ---------------------------------------------------------------- p2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="0123456789+ -()ABCxyz", max_size=24), st.binary(min_size=1, max_size=8))
def test_pseudonyms_invert(value, key):
    p = privacy.pseudonym(value, key)
    assert privacy.pseudonym(p, key, back=True) == value
    assert [c.isdigit() for c in p] == [c.isdigit() for c in value] and [c for c in p if not c.isalnum()] == [c for c in value if not c.isalnum()]


@given(st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)))
@settings(max_examples=60, deadline=None)
def test_dates_invert(day):
    p = privacy.pseudonym_date(day.isoformat(), b"k")
    assert privacy.pseudonym_date(p, b"k", back=True) == day.isoformat()


def finder(spark):
    labelled = spark.createDataFrame([("1", ["Keza", "Alice", "Grace"]), ("2", None)], "id string, names array<string>")
    texts = spark.createDataFrame([("We asked Keza twice about the bus.",), ("We asked Alice twice about the bus.",), ("We asked Keza twice about it all.",)] + [("The rose and the grace of the garden; called, thank, mail, number, flat, we live at, and would host you.",)] * 6 + [(None,), ("",)], "text string")
    return privacy.learn(texts, labelled)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Call +250 788 123 456 now", ["phone"]), ("Mail a.b+c@mail.example.test.", ["email"]), ("Mail a (at) box[dot]test", ["email"]), ("My passport is ID-1190816524195034 for it", ["id_number"]),
        ("We live at 171 Sofiwu St., Apt 3 and", ["address"]), ("Calle Mayor 12, 3º B", ["address"]), ("We asked Keza twice", ["name"]), ("Mrs. Shagumond carried", ["name"]), ("WhatsApp: zero seven six eight one six zero two", ["phone"]),
        ("Bag 20225271801 was weighed", []), ("On ticket 9299-59581 it was", []), ("The rose and the grace of it", []), ("by at 17.10. We paid 379 000 francs and got 3 @ 500 back.", []), ("[nom] and [numéro]", []), ("", []), (None, []),
    ],
)
def test_finds(spark, text, kinds, request):
    f = getattr(test_finds, "finder", None) or finder(spark)
    test_finds.finder = f
    assert [k for *_, k in f.find(text)] == kinds


def test_scrub_links_equal_values(spark):
    f = finder(spark)
    a, b = f.scrub("Call +250 788 123 456 now, Keza", b"k"), f.scrub("Or +250 788 123 456!", b"k")
    assert a.endswith("now, [name]") and a.split("[phone:")[1][:16] == b.split("[phone:")[1][:16] and "788 123 456" not in a
    chunks = spark.createDataFrame([("c", "Call +250 788 123 456"), ("d", None), ("e", "")], "chunk_id string, text string")
    assert [r.pii_kind for r in privacy.find_all(chunks, f).collect()] == ["phone"]


def test_spoken_numbers_and_dates_are_linked(spark):
    f = finder(spark)
    a, b = f.scrub("WhatsApp: zero seven six eight one six zero two", b"k"), f.scrub("My phone: 0 7 six eight 1 six zero two", b"k")
    assert a[a.index("[phone:") :] == b[b.index("[phone:") :] and len(a.split("[phone:")[1]) == 9
    assert privacy.digits_of("null eins zwei zwo neun") == "01229" and privacy.digits_of("zero oh one nine") == "0019" and privacy.digits_of("+250 788") == "+250 788"
    text = "We came on 14.05.2026, 2026-05-14 and 31.02.2026."
    assert f.scrub(text, b"k") == text
    d = f.scrub(text, b"k", dates=True)
    assert d.endswith("31.02.2026.") and privacy.pseudonym_written(d[11:21], b"k", back=True) == "14.05.2026" and d[11:21] != "14.05.2026"
    assert d[23:33].split("-") == d[11:21].split(".")[::-1]


def test_the_key_is_no_constant(spark):
    assert privacy.secret(spark) != privacy.secret(spark)
    spark.conf.set("spark.talkharvest.pseudonym.key", "abc")
    assert privacy.secret(spark) == b"abc"
    spark.conf.unset("spark.talkharvest.pseudonym.key")


def test_names_from_the_corpus(spark):
    frames = ["Our driver {} left early.", "This is {} from the farm.", "{} hat das Wasser getragen.", "{} and I took photos.", "We met {} at noon."]
    old, new = ["Anna", "Bruno", "Clara"], ["Uwase", "Leon"]
    texts = [f.format(n) for f in frames for n in old * 3 + new] + ["We met Kivu at noon.", "Kivu is a lake.", "Near Kivu it rains.", "By Kivu we sat."] + ["We saw Basin today."] * 9
    labelled = spark.createDataFrame([(" and ".join(old), old)], "text string, names array<string>")
    f = privacy.learn(spark.createDataFrame([(t,) for t in texts], "text string"), labelled)
    assert f.given == {"anna", "bruno", "clara", "uwase", "leon"}
    assert [k for *_, k in f.find("Yesterday Uwase sang")] == ["name"] and not f.find("The Kivu was calm")


# ---------------------------------------------------------------- p3


def test_sentences(spark):
    base = ["We saw the farm. We liked it.", "The guide was kind. The road was hard.", "We left at 5 p.m. by bus. The road was hard.", "We liked it. The farm was big!", "We saw the farm.", "The road was hard.", "The guide was kind.", "We got wet (it rained. A lot.) and laughed."] * 12
    recs = spark.createDataFrame([(str(i), t) for i, t in enumerate(base)], "rec_id string, text string")
    m = sentences.train(sentences.scanned(recs))
    cut = lambda t: [t[a:b] for a, b in sentences.sentences(t, sentences.taken(t)[0], m)]
    assert cut("We left at 5 p.m. by bus. The road was hard.") == ["We left at 5 p.m. by bus.", "The road was hard."]
    assert cut("We saw the farm.The road was hard") == ["We saw the farm.", "The road was hard"]
    assert cut("The guide was kind. 👍 We liked it\nthe road; was: hard") == ["The guide was kind. 👍", "We liked it", "the road; was: hard"]
    assert cut("We got wet (it rained. A lot.) and laughed. We liked it.") == ["We got wet (it rained. A lot.) and laughed.", "We liked it."]
    assert cut("The walk is 3.5 km long at mail.example.org/x now") == ["The walk is 3.5 km long at mail.example.org/x now"]
    assert cut("") == cut(None) == cut(" \n\t") == []
    assert len(cut("We liked it. " * 3000)) == 3000
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "We liked it.")], "rec_id string, text string")
    scans = sentences.scanned(odd.withColumns({"kind": sentences.F.lit(1), "extra": sentences.F.lit(1)}))
    assert [tuple(r) for r in sentences.split(scans, m).select("rec_id", "sent_start").collect()] == [("c", 0)]
    assert sentences.split(scans, sentences.train(scans.limit(0))).count() == 1
    assert sentences.split(sentences.scanned(odd.limit(0)), m).count() == 0


def test_open_mode_without_marks(spark):
    r = np.random.default_rng(0)
    units = ["the guide was very kind to us", "we liked the farm and the food", "our bus came late on sunday", "children fed all the goats"]
    words = {u: u.split() for u in units}
    texts = ["\n".join(units[int(k)] for k in r.integers(0, 4, 3)) for _ in range(80)]
    scans = sentences.scanned(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rec_id string, text string"))
    m = sentences.train(scans)
    joined = " ".join(units)
    cut = lambda t, o: [t[a:b] for a, b in sentences.sentences(t, sentences.taken(t)[0], m, o)]
    assert cut(joined, False) == [joined] and cut(joined, True) == units and len(words) == 4
    assert cut("the guide was kind. we liked it", True) == cut("the guide was kind. we liked it", False)
    # a script without spaces and end marks, by characters
    han = ["我们喜欢农场", "向导非常友好", "孩子喂了山羊"]
    scans = sentences.scanned(spark.createDataFrame([(str(i), "\n".join(han[int(k)] for k in r.integers(0, 3, 3))) for i in range(60)], "rec_id string, text string"))
    m = sentences.train(scans)
    assert cut("".join(han), True) == han and cut("", True) == cut("农", True)[1:] == []


def test_rare_words_and_contexts_count_for_their_class(spark, monkeypatch):
    monkeypatch.setattr(sentences, "SHARE", 0.02)
    texts = ["We saw it. We left."] * 60 + [f"We saw Name{i}. Odd{i} left." for i in range(40)]
    scans = sentences.scanned(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rec_id string, text string"))
    m = sentences.train(scans)
    assert {"we", "saw", "it", "left"} == m.vocabulary
    assert sum(m.unigram.values()) == 60 * 3 + 40 * 3 and sum(n for (w, *_), n in m.ctx.items()) == 100
    assert m.ctx["<4>", ".s", "<4>", "C"] == 40


def test_boundaries_against_all_event_rows():
    r = np.random.default_rng(4)
    for _ in range(200):
        n = int(r.integers(1, 7))
        odds, gaps = r.random(n), r.integers(0, 3, n)
        p = {}
        for bits in range(2**n):
            e = [bits >> i & 1 for i in range(n)]
            if not any(e[i - 1] and e[i] and not gaps[i] for i in range(1, n)):
                p[bits] = np.prod([o if x else 1 - o for o, x in zip(odds, e)])
        want = [sum(v for k, v in p.items() if k >> i & 1) > sum(p.values()) / 2 for i in range(n)]
        assert sentences.boundaries(list(odds), list(gaps)) == want


def test_length_steps_against_all_event_rows():
    # the weights of an event and of none depend on the words since the last event, so events far apart depend on each other
    r = np.random.default_rng(8)
    for _ in range(100):
        n = int(r.integers(1, 8))
        odds, gaps = r.random(n), r.integers(1, 4, n)
        steps = [(0.0, 1.0), *zip(r.random(5).tolist(), r.random(5).tolist())]
        on, total = np.zeros(n), 0.0
        for bits in range(2**n):
            p, since = 1.0, 0
            for i in range(n):
                since = min(since + gaps[i], 5)
                p *= odds[i] * steps[since][0] if bits >> i & 1 else (1 - odds[i]) * steps[since][1]
                since = 0 if bits >> i & 1 else since
            on += p * np.array([bits >> i & 1 for i in range(n)])
            total += p
        assert sentences.boundaries(odds.tolist(), gaps.tolist(), steps) == (on > total / 2).tolist()


def test_the_last_event_changes_the_next(spark):
    # no line's first sentence has one word: the same place is a boundary after enough words only
    texts = ["We saw the farm. We liked it.", "The guide was kind. The road was hard.", "We liked it. The farm was big.", "We saw the farm.", "The road was hard."] * 20 + ["Xy. Abc saw the farm."] * 60
    m = sentences.train(sentences.scanned(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rec_id string, text string")))
    assert m.steps[0][0] == 0 and m.steps[1][0] < m.steps[3][0] and m.steps[1][0] < m.steps[4][0] and len(m.steps) == sentences.LENGTH + 1
    lines, _, _ = sentences.taken("We liked it. The farm was big.")
    assert lines.split("\t")[-3:] == ["30", "4", ""]  # the line's end is a sure event
    half = [off / (on + off) for on, off in (m.steps[1], m.steps[4])]
    p = sum(half) / 2
    assert half[0] > half[1] and sentences.boundaries([p], [1], m.steps) == [False] and sentences.boundaries([p], [4], m.steps) == [True]


# ---------------------------------------------------------------- p4


def test_sampling(spark):
    rows = [(f"i{k}", [" EN", "en-GB", "fr", None][k % 4], (None, None) if k % 5 else None, 1) for k in range(200)]
    f = spark.createDataFrame(rows + rows[:40], "id string, lang string, flags struct<negation:string,length_class:string>, category_value int")
    t = spark.createDataFrame([(1, 20, "lang", "en", 75, 1), (1, 20, "lang", "fr", 25, 8), (1, 20, "lang", "rw", 5, 3), (2, 400, "flags.negation", "none", 50, 0)], "plan_id int, sample_size int, category_field string, category_value string, target_pct int, min_rows int")
    rep = {(r.plan_id, r.category_value): (r.wanted, r.available, r.quota, r.missing) for r in sampling.report(f, t).collect()}
    assert rep == {(1, "en"): (15, 100, 15, 0), (1, "fr"): (8, 50, 8, 0), (1, "rw"): (3, 0, 0, 3), (2, "none"): (200, 160, 160, 40)}
    s = sampling.sample(f, t).collect()
    assert len(s) == 15 + 8 + 160 and len({(r.plan_id, r.id) for r in s}) == len(s)
    assert sampling.sample(f.limit(0), t).count() == 0
    # the reservoirs are those of one pass over all rows
    cats = sampling.categories(f, ["lang"]).repartition(7)
    got = sorted((r.category_value, r.place, r.id) for r in sampling.reservoirs(cats, spark.createDataFrame([("lang", "en", 30), ("lang", "fr", 90)], "category_field string, category_value string, keep long")).collect())
    drawn = sorted((r.category_value, r.d, r.id) for r in cats.select("category_value", sampling.F.xxhash64("id", sampling.F.lit(17)).alias("d"), "id").collect())
    en, fr = [x[2] for x in drawn if x[0] == "en"][:30], [x[2] for x in drawn if x[0] == "fr"]
    assert got == [("en", i + 1, x) for i, x in enumerate(en)] + [("fr", i + 1, x) for i, x in enumerate(fr)]


# ---------------------------------------------------------------- p5


def test_arrivals_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(3)
    base = r.standard_normal((30, 64))
    stored, raw = [], []
    t0 = dt.datetime(2026, 6, 1)
    for i in range(60):
        v = base[i % 30] + 0.05 * r.standard_normal(64)
        stored.append((f"a{i:03}", t0 + dt.timedelta(days=int(r.integers(0, 20))), ["analyzed", "duplicate"][i % 7 == 0], f"f{i % 25}", [float(x) for x in v]))
    for i in range(160):
        v = base[int(r.integers(30))] + 0.08 * r.standard_normal(64)
        t = None if i % 17 == 0 else t0 + dt.timedelta(days=int(r.integers(10, 40)))
        raw.append((f"b{i:03}", int(r.integers(1, 4)), t, None if i % 5 else f"f{int(r.integers(40))}", None if i % 11 == 0 else [float(x) for x in v], None if i % 3 else f"Text {i % 9}!"))
    s = spark.createDataFrame(stored, "message_id string, received_at timestamp, status string, fingerprint string, embedding array<float>")
    w = spark.createDataFrame(raw + raw[:10], "message_id string, batch_no int, received_at timestamp, fingerprint string, embedding array<float>, text string")
    _, pairs = arrivals.divide(s, w)
    got = {(x.later, x.earlier) for x in pairs.collect()}
    known = [(i, t, f, arrivals.unit(np.float32(e))) for i, t, st_, f, e in stored if st_ == "analyzed"]
    want = set()
    for i, b, t, f, e, x in sorted(raw, key=lambda q: (q[1], q[2] is None, q[2] or t0, q[0])):
        f = f or arrivals.fingerprint_text(x)
        u = arrivals.unit(np.float32(e)) if e else None
        hits = [k[0] for k in known if ((f and f == k[2]) or (u is not None and k[3] is not None and u @ k[3] >= 0.98)) and (t is None or k[1] is None or abs(t - k[1]) <= dt.timedelta(days=7))]
        want |= {(i, h) for h in hits}
        if not hits:
            known.append((i, t, f, u))
    assert want and got == want
    assert arrivals.divide(s.limit(0), w.limit(0))[1].count() == 0
    # batch after batch against the growing index gives the same
    index = arrivals.SegmentIndex(spark, str(tmp_path / "index"))
    index.append(arrivals.history_of(s))
    step = set()
    for k in (1, 2, 3):
        step |= {(x.later, x.earlier) for x in arrivals.next_batch(index, w.where(f"batch_no = {k}"))[1].collect()}
    assert step == want


def test_a_batch_reads_only_what_its_windows_touch(spark, tmp_path):
    v = [float(x) for x in np.random.default_rng(1).standard_normal(64)]
    days = [dt.datetime(2025, 1, 1) + dt.timedelta(days=28 * k) for k in range(12)]
    s = spark.createDataFrame([(f"a{k}", t, "analyzed", f"f{k}", v) for k, t in enumerate(days)], "message_id string, received_at timestamp, status string, fingerprint string, embedding array<float>")
    index = arrivals.SegmentIndex(spark, str(tmp_path / "index"))
    index.append(arrivals.history_of(s))
    asked = []
    read = index.read
    index.read = lambda name, stretches: asked.append(stretches) or read(name, stretches)
    w = "message_id string, batch_no int, received_at timestamp, fingerprint string, embedding array<float>, text string"
    ids, pairs = arrivals.next_batch(index, spark.createDataFrame([("b", 1, days[-1] + dt.timedelta(days=3), None, v, "x"), ("c", 1, days[-1] + dt.timedelta(days=40), None, v, "y")], w))
    assert {(x.later, x.earlier) for x in pairs.collect()} == {("b", "a11")} and [x.message_id for x in ids.collect()] == ["c"]
    assert all(len(a) <= 3 for a in asked) and read("messages", asked[0]).count() < 3
    assert "PartitionFilters: [(" in read("strings", asked[0])._jdf.queryExecution().toString()
    # what was accepted is known to the next batch, and a message without a time looks everywhere
    ids, pairs = arrivals.next_batch(index, spark.createDataFrame([("d", 2, None, None, v, "z")], w))
    assert {x.earlier for x in pairs.collect()} == {"c", *(f"a{k}" for k in range(12))} and ids.count() == 0


def test_fingerprint():
    assert arrivals.fingerprint_text("L’ÉTÉ, à Straße!") == arrivals.fingerprint_text("l'ete a strasse")
    assert arrivals.fingerprint_text(None) is None and arrivals.fingerprint_text(" !? ") is None


# ---------------------------------------------------------------- p6


def test_network_learns(monkeypatch):
    monkeypatch.setattr(languages, "MAX_STEPS", 60)
    en = ["the road to the farm was very hard and we were tired", "we loved the tasting of the three cups with our guide"]
    fr = ["la route vers la ferme était très dure pour nous tous", "nous avons adoré la dégustation des trois tasses avec le guide"]
    texts = [f"{t} {i % 7}" for i in range(40) for t in (*en, *fr)]
    labels = ["en", "en", "fr", "fr"] * 40
    labels[2] = labels[7] = "en"  # wrong labels of a few records
    find = languages.fit(texts, labels, {})
    said = ["the guide was with the cups and we were very tired", "la route avec nous était la ferme", "", "the road " * 200, "12"]
    got = find(said, [None, "en", "fr", "zz", "en"])
    assert [g[0] for g in got] == ["en", "fr", None, "en", None] and got[2][1] is None and all(0 < p <= 1 for _, p in (got[0], got[1], got[3]))
    assert find.prior.shape == (13, 12) and np.allclose(find.prior.sum(1), 1) and find.prior[0, 0] > 0.8
    assert languages.fit([], [], {})(["some words here"], [None])[0][0] in languages.CODES


def test_reading_equals_the_trained_network():
    net, r = languages.Network(), np.random.default_rng(2)
    texts = ["".join(r.choice(list("abc é日\0"), int(n))) for n in r.integers(0, 90, 40)] + ["x" * 500]
    got = net.pooled(texts)
    for t, row in zip(texts, got):
        b = t.encode().replace(b"\0", b" ")
        logs = [net.positions(np.frombuffer(b[a : a + languages.READ], np.uint8).astype(np.int64)[:, None])[0][:, 0] for a in range(0, len(b), languages.READ)]
        assert row == pytest.approx(np.concatenate(logs).mean(0) if logs else np.full(12, -np.log(12)), abs=1e-4)


def test_languages_of_records(spark, monkeypatch):
    monkeypatch.setattr(languages, "MAX_STEPS", 150)
    en = ["The road to the farm was very hard.", "We loved the tasting of the three cups.", "Our guide told us about the trees.", "The lunch with beans was very good."]
    fr = ["La route vers la ferme était très dure.", "Nous avons adoré la dégustation des tasses.", "Le guide nous a parlé des arbres.", "Le repas avec des haricots était très bon."]
    rows = [(f"{c}{i}", f"{c}{i}", " ".join(ts[(i + k) % 4] for k in range(3)), c) for c, ts in (("en", en), ("fr", fr)) for i in range(60)]
    odd = [("mixed", "mixed:0", en[0] + "\n" + fr[1], "en"), ("mixed", "mixed:1", en[2], "en"), ("null", "null", fr[3], None), ("wrong", "wrong", fr[0] + " " + fr[2], "en"), ("none", "none", None, "en"), ("empty", "empty", "", None), ("short", "short", "12!", "fr")]
    got = languages.labelled_parts(spark.createDataFrame(rows + odd, "rec_id string, part_id string, text string, label string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.rec_id, set()).add(r.lang)
    assert by["mixed"] == {"en", "fr"} and by["null"] == by["wrong"] == {"fr"} and by["short"] == {None} and not {"none", "empty"} & set(by)
    assert sum(by[r[0]] == {r[3]} for r in rows) == len(rows) and len({(r.part_id, r.sent_no) for r in got}) == len(got)


def test_gradient():
    net = languages.Network()
    x, y = np.random.default_rng(0).integers(97, 120, (6, 3)), np.array([0, 1, 2])
    name, at, eps = "uf", (3, 5), 1e-2

    def loss():
        logp, *_, mask = net.positions(x)
        return float(-(logp[:, np.arange(3), y] * mask).sum() / mask.sum())

    kept = {k: v.copy() for k, v in net.p.items()}
    net.p[name][at] += eps
    up = loss()
    net.p[name][at] -= 2 * eps
    down = loss()
    net.p = {k: v.copy() for k, v in kept.items()}
    net.step(x, y, 0.0)
    assert abs(net.m[name][0][at] * 10 - (up - down) / (2 * eps)) < 2e-4


def test_every_record_has_a_language_row(spark, monkeypatch):
    recs = spark.createDataFrame([("a", "x"), ("b", None), ("c", ""), ("d", "12"), ("d", "")], "rec_id string, text string")
    units = spark.createDataFrame([("a", "en", 0.9, 11), ("a", "fr", 0.8, 3), ("d", None, None, 2)], "rec_id string, lang string, p double, letters int")
    monkeypatch.setattr(languages, "records", lambda *_: recs)
    monkeypatch.setattr(languages, "labelled_parts", lambda _: units)
    got = sorted(tuple(r) for r in languages.p6_documents(spark, "").select("rec_id", "lang", "p").collect())
    assert got == [("a", "en", round(11 / 14 * 0.9, 6)), ("b", None, 0.0), ("c", None, 0.0), ("d", None, 0.0)]


def test_stated_labels(spark):
    rows = [(" EN ",), ("en-GB",), ("eng",), ("Französisch",), ("日本語",), ("und",), ("unknown",), (None,), ("",), ("pt_BR",)]
    got = [r.x for r in spark.createDataFrame(rows, "l string").select(languages.stated(languages.F.col("l")).alias("x")).collect()]
    assert got == ["en", "en", "en", "fr", "ja", None, None, None, None, "pt"]


# ---------------------------------------------------------------- p7

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P

    t = encoding.Transducer.load()
    return t, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab !?.,é\n日", max_size=120), st.text(alphabet="a '1\n\u00a0\x1c\u3000s", max_size=40)))
def test_ids_equal_the_public_encoder(coder, text):
    t, ref = coder
    ids = t.encode(text).tolist()
    assert ids == ref.encode_ordinary(text) and t.size(text) == len(ids) and encoding.decode(t, ids) == text


def test_long_and_special(coder):
    t, ref = coder
    for text in ("<|endoftext|> x", "ab" * 20_000 + "!" * 3_000, "​﻿ é", ""):
        assert t.encode(text).tolist() == ref.encode_ordinary(text)


@given(st.binary(max_size=30), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_utf8_stream(data, k):
    s = encoding.Utf8Stream()
    assert s.feed(data[:k]) + s.feed(data[k:]) + s.end() == data.decode("utf-8", "replace")


def test_ids_of_tables(spark):
    d = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (1, "hello world", 5)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, len(r.ids)) for r in encoding.encode_documents(d).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]


# ---------------------------------------------------------------- p8


def test_packing(spark):
    d = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate([3000, 700, 650, 40, 1200, 2048, 1])] + [(100, None), (101, "")], "doc_id long, text string")
    p = packing.pack(d, capacity=2048).collect()
    by = {}
    for r in p:
        if r.container is not None:
            by.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in g) <= 2048 and len(g) <= packing.MAX_SEGMENTS for g in by.values())
    assert {r.doc_id for r in p if r.pieces > 1} == {r.doc_id for r in p if sum(x.tokens for x in p if x.doc_id == r.doc_id) > 2048}
    assert {r.doc_id for r in p if r.container is None} == {100, 101}
    assert packing.pack(d.limit(0)).count() == 0


def test_sizes_of_first_lines(spark, coder):
    texts = ["ab \n\n x", "ab\n\n x", "\nab", " \n", "one line", None, "", "a  b \r\n  c"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in packing.items(d).collect():
        assert r.tokens == len(coder[0].encode(texts[r.doc_id])) == len(coder[1].encode_ordinary(texts[r.doc_id] or ""))


def test_fill_equals_the_plain_scan():
    r = np.random.default_rng(1)
    sizes = np.stack([r.integers(1, 2000, 300), np.ones(300), r.integers(0, 900, 300)], 1).astype(float)
    limits = np.array([2048.0, 6, 1800])
    need = sizes / limits
    order = np.argsort(-need.sum(1), kind="stable")
    want, k = np.full(300, -1), 0
    while (want < 0).any():
        left = np.ones(3)
        while True:
            at = [i for i in order if want[i] < 0 and (need[i] <= left + 1e-9).all()]
            if not at:
                break
            best = max(at, key=lambda i: sum(need[i] * left))
            want[best], left = k, left - need[best]
        k += 1
    assert (packing.fill(sizes, limits) == want).all()
    assert len(packing.fill(sizes[:0], limits)) == 0


def test_fill_respects_every_limit():
    r = np.random.default_rng(0)
    sizes = np.stack([r.integers(1, 900, 400), np.ones(400), r.integers(0, 500, 400)], 1).astype(float)
    limits = np.array([2048.0, 5, 1500])
    where = packing.fill(sizes, limits)
    assert all((sizes[where == k].sum(0) <= limits + 1e-6).all() for k in set(where))
    assert len(set(where)) <= 1.1 * max((sizes.sum(0) / limits)) + 1


# ---------------------------------------------------------------- p9


def test_levels(spark):
    easy, hard = "We sat. The sun was hot. A man ran to the gate. ", "Notwithstanding methodological heterogeneity, institutional infrastructures considerably complicate the operationalisation of sustainability indicators in participatory arrangements, a circumstance which presupposes differentiation. "
    mid = "The farmer roasted beans over the fire because the weather was good. "
    docs = [(i, (easy, mid, hard)[i % 3] * (4 + i % 5), "x") for i in range(90)] + [(900, None, "x"), (901, "", "x"), (902, "Too short", "x"), (903, hard * 400, "x"), (904, "a. " * 20, "x"), (905, "! " * 40, "x")]
    labels = [(i, "a", (1, 2, 4)[i % 3]) for i in range(60)] + [(3, "b", None), (0, "a", 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, level string"), spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    got = {r.doc_id: r.level for r in levels.levelled(d, lab).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == (1, 2, 4)[i % 3] for i in range(60, 90)) and got[903] == 4
    assert got[900] is got[901] is got[902] is None
    assert {r.level for r in levels.levelled(d, lab.limit(0)).collect()} == {None}


def test_variety_of_the_whole_text(spark):
    def brute(words):
        starts = [min(i, max(len(words) - 200, 0)) for i in range(0, len(words), 200)]
        return float(np.median([len(set(words[i : i + 200])) / len(words[i : i + 200]) for i in starts]))

    one, rich = ["same"] * 200, [f"w{i}" for i in range(900)]
    texts = [one + rich, rich + one, rich[:200] + one * 4, rich[:30] + rich[:20], one + rich[:1], one + rich[:200], rich[:399] + one]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.variety for r in levels.features(docs).collect()}
    assert got == pytest.approx({i: brute(t) for i, t in enumerate(texts)})
    # the opening no longer decides
    assert got[0] == 1 and got[2] == 0.005


def test_scripts_without_spaces_have_words(spark):
    easy, hard = "猫がいる。犬もいる。", "制度的基盤の不均質性は持続可能性指標の運用化を著しく困難にするため参加型の取り決めにおいては分化が前提となる。"
    zh = ("我们去了。天很热。", "尽管方法论存在异质性，制度性基础设施仍然显著地增加了参与式安排中可持续性指标操作化的复杂程度。")
    docs = [(i, (easy, hard, *zh)[i % 4] * (2 + i % 5)) for i in range(80)] + [(100, "猫がいる。"), (101, "กาแฟดีมากและไร่กาแฟสวยงามน่าไปเที่ยวอีกครั้งในปีหน้า"), (102, "  coffee 咖啡 ")]
    labels = [(i, "a", (1, 4)[i % 2]) for i in range(40)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    words = {r.doc_id: r for r in levels.features(d).collect()}
    assert words[0].words == 20 and words[0].sentence == pytest.approx(np.log1p(4)) and words[0].letters is None and 101 in words
    got = {r.doc_id: r.level for r in levels.levelled(d, lab).collect()}
    assert all(got[i] == (1, 4)[i % 2] for i in range(80))
    assert got[100] is got[102] is None and len(got) == len(docs)
    # learnt on English alone, a long hard text is still above an easy one
    en = [(200 + i, ("We sat. The sun was hot. ", "The farmer, who had notwithstanding considerable difficulties persisted, roasted beans over the fire, because the weather remained good for all of that week. ")[i % 2] * 5) for i in range(20)]
    both = d.unionByName(spark.createDataFrame(en, "doc_id long, text string"))
    got = {r.doc_id: r.level for r in levels.levelled(both, spark.createDataFrame([(i, "a", (1, 4)[i % 2]) for i, _ in en], "doc_id long, rater string, reading_level int")).collect()}
    assert got[77] > got[76] and got[79] > got[78]


def test_isotonic():
    xs, ys = levels.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([1.0, 3, 2, 4, 2]))
    assert (np.diff(ys) >= 0).all() and ys[0] == 1 and ys[-1] == 3
