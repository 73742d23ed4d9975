import datetime as dt

import numpy as np

from talkharvest.operators import duplicates

S = "message_id string, received_at timestamp, fingerprint string, embedding array<float>, old string"
R = "message_id string, received_at timestamp, fingerprint string, embedding array<float>, text string, week int"
T0 = dt.datetime(2026, 6, 1)


def tables(spark, seed=3):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, 64))
    vec = lambda: None if r.random() < 0.1 else [float(x) for x in base[int(r.integers(12))] + 0.09 * r.standard_normal(64)]
    when = lambda: None if r.random() < 0.1 else T0 + dt.timedelta(days=float(r.integers(0, 120)) / 2)
    stored = [(f"a{i:03}", when(), f"f{int(r.integers(15))}" if r.random() > 0.1 else None, vec(), "x") for i in range(60)]
    raw = [(f"b{i:03}", when(), f"f{int(r.integers(15))}" if r.random() > 0.3 else None, vec(), ["Good coffee!", "good  COFFEE", None, "?"][i % 4], 1) for i in range(90)]
    raw += [("bad1", T0, None, [0.0] * 64, None, 1), ("bad2", T0, None, [float("nan")] + [1.0] * 63, None, 1), ("bad3", T0, None, [1.0, 2.0], None, 1)]
    return stored, raw


def before(a, b):
    """Did b come before a, inside the window?"""
    late = dt.datetime.max
    first = b["old"] or (b["t"] or late, b["id"]) < (a["t"] or late, a["id"])
    return first and b["id"] != a["id"] and (a["t"] is None or b["t"] is None or abs(a["t"] - b["t"]) <= dt.timedelta(days=7))


def test_against_brute_force(spark):
    stored, raw = tables(spark)
    m = duplicates.messages(spark.createDataFrame(stored, S), spark.createDataFrame(raw + raw[:9], R))
    rows = [{"id": r.message_id, "old": r.old, "t": None if r.t is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.t), "fp": r.fp, "e": r.embedding} for r in m.collect()]
    assert len(rows) == len(stored) + len(raw)
    same_text = {r["fp"] for r in rows if r["id"] in ("b000", "b001") and dict((x[0], x[2]) for x in raw)[r["id"]] is None}
    assert len(same_text) <= 1  # equal words, equal fingerprint
    want = {a["id"] for a in rows if not a["old"] and a["fp"] and any(b["fp"] == a["fp"] and before(a, b) for b in rows)}
    assert want and {r.message_id for r in duplicates.exact(m).collect()} == want

    ok = lambda v: v is not None and len(v) == 64 and np.isfinite(v).all() and any(v)
    good = [r for r in rows if ok(r["e"])]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    near = {a["id"] for a in good if not a["old"] and any(before(a, b) and cos(a["e"], b["e"]) >= 0.98 for b in good)}
    assert near and {r.message_id for r in duplicates.near(m).collect()} == near

    lead, want = {}, {}
    for r in sorted((r for r in rows if r["fp"]), key=lambda r: (r["t"] is None, r["t"] or T0, r["id"])):
        last = lead.get(r["fp"])
        dup = r["fp"] in lead and (r["t"] is None or last is None or r["t"] - last <= dt.timedelta(days=7))
        want[r["id"]] = dup
        if not dup:
            lead[r["fp"]] = r["t"]
    assert {r.message_id: r.duplicate for r in duplicates.leaders(m).collect()} == want


def test_empty_tables(spark):
    m = duplicates.messages(spark.createDataFrame([], S), spark.createDataFrame([], R))
    assert duplicates.exact(m).count() == duplicates.near(m).count() == duplicates.leaders(m).count() == 0
