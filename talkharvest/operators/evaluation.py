"""AGG12 to AGG16, AGG19, WIN8, WIN11: predictions against annotations, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table, unique

#: Hundredths of the sweep.
STEPS = 71


def answers(spark, d: str) -> DataFrame:
    """id, lang, finding, expected, given: every finding of a feedback that is expected or annotated in its spans (JOIN6, JOIN7)."""
    f = unique(table(spark, d, "feedback"), "id").select("id", F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("none")).alias("lang"), "expected_findings", "must_not_findings", "chunks")
    want = f.select("id", "lang", F.explode("expected_findings").alias("finding")).withColumn("expected", F.lit(1)).withColumn("given", F.lit(0))
    # the rule judged here names what a span annotates, cancelled ones included
    named = F.explode(F.transform("chunks", lambda c: F.coalesce(c["finding"], c["negates"])))
    got = f.select("id", "lang", named.alias("finding")).where("finding IS NOT NULL").withColumn("expected", F.lit(0)).withColumn("given", F.lit(1))
    return want.unionByName(got).groupBy("id", "lang", "finding").agg(F.max("expected").alias("expected"), F.max("given").alias("given"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))


def _counts():
    e, g = F.col("expected") == 1, F.col("given") == 1
    return F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(e & ~g).alias("fn")


def _prf(df: DataFrame, *keys: str) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def metrics(a: DataFrame, *keys: str) -> DataFrame:
    """AGG13."""
    return _prf(a.groupBy(*keys).agg(*_counts()), *keys)


def summary(spark, d: str) -> DataFrame:
    """AGG13/AGG14: one row of totals: micro precision, recall and F1, macro F1 over findings that are expected anywhere, share of
    feedback whose findings are exactly the expected ones, error among the given answers and share of the expected ones captured."""
    a = answers(spark, d)
    micro = _prf(a.agg(*_counts()))
    macro = metrics(a, "finding").where("tp + fn > 0").agg(F.coalesce(F.round(F.avg("f1"), 6), F.lit(0.0)).alias("macro_f1"))
    all_ = unique(table(spark, d, "feedback"), "id").agg(F.count(F.lit(1)).alias("messages"))
    off = a.where("expected <> given").agg(F.countDistinct("id").alias("off"))
    one = micro.join(F.broadcast(macro)).join(F.broadcast(all_)).join(F.broadcast(off))  # single rows
    return one.select("precision", "recall", "f1", "macro_f1", _ratio(F.col("messages") - F.col("off"), F.col("messages")).alias("exact"), _ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("accepted_error"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("captured"))


def metrics_by_language(a: DataFrame) -> DataFrame:
    """AGG16: each language and all."""
    return _prf(a.groupingSets([["lang"], []], "lang").agg(*_counts()), "lang")


def confusion(a: DataFrame) -> DataFrame:
    """AGG12, long form: expected finding (or none) against given one (or none) of the same feedback."""
    w = a.where("expected = 1").select("id", F.col("finding").alias("expected_finding"), F.col("given"))
    extra = a.where("expected = 0").select("id", F.col("finding").alias("given_finding"))
    hit = w.where("given = 1").select("expected_finding", F.col("expected_finding").alias("given_finding"))
    miss = w.where("given = 0").join(extra, "id", "left").select("expected_finding", F.coalesce("given_finding", F.lit("none")).alias("given_finding"))
    return hit.unionByName(miss).groupBy("expected_finding", "given_finding").agg(F.count(F.lit(1)).alias("n"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """AGG15: 95 % interval of a share, four decimals; (0, 1) without observations."""
    p = k / F.when(n > 0, n)
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    r = lambda c, empty: F.coalesce(F.round(F.when(n > 0, c / scale), 4), F.lit(empty))
    return r(mid - half, 0.0), r(mid + half, 1.0)


def tallies(spark, d: str) -> DataFrame:
    """AGG14: per language, how many feedbacks are ambiguous, off the list, negated, and of these free of forbidden findings."""
    f = unique(table(spark, d, "feedback"), "id")
    named = F.transform(F.filter("chunks", lambda c: c["kind"] == "finding"), lambda c: c["finding"])
    clean = ~F.coalesce(F.arrays_overlap(named, "must_not_findings"), F.lit(False))
    return f.groupBy(F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("none")).alias("lang")).agg(
        F.count_if("flags.ambiguous").alias("ambiguous"), F.count_if("flags.off_list").alias("off_list"), F.count_if(F.col("flags.negation").isNotNull()).alias("negated"), F.count_if(clean).alias("clean")
    )


def losses(spark, d: str) -> DataFrame:
    """AGG19: the first cause that applies to each feedback without expected findings, by cause."""
    f = unique(table(spark, d, "feedback"), "id")
    why = F.when(F.col("text").isNull() | (F.trim("text") == ""), "no_text").when(F.col("flags").isNull(), "no_flags").when(F.col("flags.off_list"), "off_list").when(F.col("flags.negation") == "cancels", "cancelled").when(F.col("flags.ambiguous"), "ambiguous").otherwise("other")
    return f.where("size(expected_findings) = 0").groupBy(why.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def scored(spark, d: str) -> DataFrame:
    """score, good: best confidence of every message with findings, and whether it was analysed for sure."""
    s = unique(table(spark, d, "messages_stored"), "message_id").where("size(findings) > 0")
    return s.select(F.round(F.array_max(F.transform("findings", lambda f: f["confidence"])), 6).alias("score"), (F.coalesce("not_sure_count", F.lit(0)) == 0).alias("good"))


def _histogram(s: DataFrame) -> DataFrame:
    """Scores by hundredth, so that a sweep is one aggregation and a sum over at most 101 rows."""
    return s.where("score IS NOT NULL").groupBy(F.floor(F.col("score") * 100).cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"))


def sweep(s: DataFrame) -> DataFrame:
    """WIN8: threshold, accepted, captured, error for 71 thresholds from 0.30 on."""
    t = s.sparkSession.range(STEPS).select((F.col("id") + 30).cast("int").alias("t"))
    h = _histogram(s)  # at most 101 rows
    j = t.join(F.broadcast(h), F.col("h") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("good"), F.lit(0)).alias("hits"))
    total = h.agg(F.sum("good").alias("total"))
    return j.join(F.broadcast(total)).select((F.col("t") / 100).alias("threshold"), "accepted", _ratio(F.col("hits"), F.col("total")).alias("captured"), _ratio(F.col("accepted") - F.col("hits"), F.col("accepted")).alias("error"))


def youden(s: DataFrame) -> DataFrame:
    """WIN11: the cut that most separates doubtful from sure scores; the lowest of equal ones."""
    h = _histogram(s)
    t = s.sparkSession.range(101).select(F.col("id").cast("int").alias("t"))
    j = t.join(F.broadcast(h), F.col("h") < F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    total = h.agg(F.sum("n").alias("all"), F.sum("good").alias("sure"))
    gain = F.round((F.col("n") - F.col("good")) / (F.col("all") - F.col("sure")) - F.col("good") / F.col("sure"), 6)
    return j.join(F.broadcast(total)).select((F.col("t") / 100).alias("cut"), gain.alias("gain")).orderBy(F.desc("gain"), "cut").limit(1)


_F = "(SELECT DISTINCT ON (id) * FROM feedback WHERE id IS NOT NULL)"
_LANG = "coalesce(lower(substr(trim(lang), 1, 2)), 'none')"
_ANS = f"""w AS (SELECT id, {_LANG} AS lang, unnest(expected_findings) AS finding, 1 AS expected, 0 AS given FROM {_F}), g AS (SELECT * FROM (SELECT id, {_LANG} AS lang, unnest(list_transform(chunks, lambda c: coalesce(c.finding, c.negates))) AS finding, 0 AS expected, 1 AS given FROM {_F}) WHERE finding IS NOT NULL),
  a AS (SELECT id, lang, finding, max(expected) AS expected, max(given) AS given FROM (SELECT * FROM w UNION ALL SELECT * FROM g) GROUP BY ALL)"""
_CNT = "count(*) FILTER (expected = 1 AND given = 1) AS tp, count(*) FILTER (expected = 0 AND given = 1) AS fp, count(*) FILTER (expected = 1 AND given = 0) AS fn"
_R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE round(({a}) / ({b}), 6) END"
_PRF = f"tp, fp, fn, {_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_R('2 * tp', '2 * tp + fp + fn')} AS f1"
_SCO = "s AS (SELECT round(list_max(list_transform(findings, lambda f: f.confidence)), 6) AS score, coalesce(not_sure_count, 0) = 0 AS good FROM (SELECT DISTINCT ON (message_id) * FROM messages_stored WHERE message_id IS NOT NULL) WHERE len(findings) > 0)"
_SWEEP = f"""sw AS (SELECT t / 100 AS threshold, count(score) AS accepted, {_R('count(score) FILTER (good)', '(SELECT count(*) FROM s WHERE good AND score IS NOT NULL)')} AS captured, {_R('count(score) - count(score) FILTER (good)', 'count(score)')} AS error FROM range(30, {30 + STEPS}) r(t) LEFT JOIN s ON floor(score * 100) >= t GROUP BY t)"""
ORACLE = {
    "label_metrics": f"WITH {_ANS} SELECT finding, {_PRF} FROM (SELECT finding, {_CNT} FROM a GROUP BY finding)",
    "evaluation_summary": f"""WITH {_ANS}, m AS (SELECT {_CNT} FROM a), p AS (SELECT {_PRF} FROM m), pf AS (SELECT finding, {_PRF} FROM (SELECT finding, {_CNT} FROM a GROUP BY finding)),
      x AS (SELECT (SELECT count(DISTINCT id) FROM a WHERE expected <> given) AS off, (SELECT count(*) FROM {_F}) AS n)
      SELECT precision, recall, f1, (SELECT coalesce(round(avg(f1), 6), 0.0) FROM pf WHERE tp + fn > 0) AS macro_f1, {_R('n - off', 'n')} AS exact, {_R('fp', 'tp + fp')} AS accepted_error, recall AS captured FROM p, x""",
    "metrics_by_lang": f"WITH {_ANS} SELECT lang, {_PRF} FROM (SELECT lang, {_CNT} FROM a GROUP BY GROUPING SETS ((lang), ()))",
    "label_confusion": f"""WITH {_ANS}, x AS (SELECT id, finding AS given_finding FROM a WHERE expected = 0) SELECT expected_finding, given_finding, count(*) AS n FROM (
      SELECT finding AS expected_finding, finding AS given_finding FROM a WHERE expected = 1 AND given = 1 UNION ALL SELECT a.finding, coalesce(x.given_finding, 'none') FROM a LEFT JOIN x USING (id) WHERE a.expected = 1 AND a.given = 0) GROUP BY ALL""",
    "wilson_interval": f"""WITH {_ANS}, m AS (SELECT finding, tp, tp + fn AS n FROM (SELECT finding, {_CNT} FROM a GROUP BY finding)), p AS (SELECT finding, n, CASE WHEN n > 0 THEN tp / n END AS p FROM m)
      SELECT finding, coalesce(round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4), 0.0) AS low, coalesce(round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4), 1.0) AS high FROM p""",
    "answer_tallies": f"""SELECT {_LANG} AS lang, count(*) FILTER (flags.ambiguous) AS ambiguous, count(*) FILTER (flags.off_list) AS off_list, count(*) FILTER (flags.negation IS NOT NULL) AS negated,
      count(*) FILTER (NOT coalesce(list_has_any(list_transform(list_filter(chunks, lambda c: c.kind = 'finding'), lambda c: c.finding), must_not_findings), false)) AS clean FROM {_F} GROUP BY 1""",
    "loss_diagnosis": f"""SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN flags IS NULL THEN 'no_flags' WHEN flags.off_list THEN 'off_list' WHEN flags.negation = 'cancels' THEN 'cancelled' WHEN flags.ambiguous THEN 'ambiguous' ELSE 'other' END AS cause, count(*) AS n FROM {_F} WHERE len(expected_findings) = 0 GROUP BY 1""",
    "threshold_sweep": f"WITH {_SCO}, {_SWEEP} SELECT * FROM sw",
    "choose_threshold": f"WITH {_SCO}, {_SWEEP} SELECT threshold, captured, error FROM sw WHERE accepted >= 20 AND error <= 0.35 ORDER BY captured DESC, threshold LIMIT 1",
    "rank_variants": f"WITH {_SCO}, {_SWEEP} SELECT place::INT AS place, threshold FROM (SELECT threshold, row_number() OVER (ORDER BY error, threshold) AS place FROM sw WHERE accepted > 0 AND captured >= (SELECT max(captured) FROM sw WHERE accepted > 0) - 0.02) WHERE place <= 5",
    "youden_floor": f"""WITH {_SCO}, k AS (SELECT count(*) AS c, count(*) FILTER (good) AS sure FROM s WHERE score IS NOT NULL), j AS (SELECT t, count(score) AS n, count(score) FILTER (good) AS good FROM range(101) r(t) LEFT JOIN s ON floor(score * 100) < t GROUP BY t)
      SELECT t / 100 AS cut, round((n - good) / (c - sure) - good / sure, 6) AS gain FROM j, k ORDER BY gain DESC, cut LIMIT 1""",
}
