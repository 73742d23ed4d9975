"""Queries over vectors, evaluation and event streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation
from ..sources.tables import table, unique

FLOOR, ACCEPT, MARGIN = 0.15, 0.25, 0.08


def _vectors(spark, d) -> DataFrame:
    e = unique(table(spark, d, "embeddings"), "vec_id")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label", (F.col("vec_id") % 3 == 0).alias("negated"))


def _searches(spark, d) -> DataFrame:
    """Searches: every vector whose id is divisible by 100 asks all others."""
    return _vectors(spark, d).where("vec_id % 100 = 0")


def _asked(spark, d) -> DataFrame:
    """JOIN1: the stated query set against all rows, in one broadcast pass of the smaller side (1 % of the rows)."""
    q = _searches(spark, d).select(F.col("vec_id").alias("q"), F.col("e").alias("qe"), F.col("label").alias("q_label"), F.col("negated").alias("q_neg"))
    x = _vectors(spark, d)
    return x.join(q, F.col("vec_id") != F.col("q")).withColumn("sim", V.dot(F.col("qe"), F.col("e"))).drop("e", "qe")


def score_agree_inverted(spark, d):
    """VEC3: per query and label, best similarity among examples of equal, of opposite and of any negation."""
    same = F.col("negated") == F.col("q_neg")
    r = lambda c: F.round(F.coalesce(c, F.lit(-1.0)), 6)
    return _asked(spark, d).groupBy("q", "label").agg(r(F.max(F.when(same, F.col("sim")))).alias("agree"), r(F.max(F.when(~same, F.col("sim")))).alias("inverted"), r(F.max("sim")).alias("overall"))


def score_topk_mean(spark, d):
    """VEC2: mean of the three best per query and label."""
    w = Window.partitionBy("q", "label").orderBy(F.desc("sim"), "vec_id")
    return _asked(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("q", "label").agg(F.round(F.avg("sim"), 6).alias("score"))


def top3_scores(spark, d):
    """VEC4/VEC5: the three best labels of each query, three decimals."""
    s = _asked(spark, d).groupBy("q", "label").agg(F.max("sim").alias("s"))
    w = Window.partitionBy("q").orderBy(F.desc("s"), "label")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 3").select("q", "place", "label", V.rounded3(F.col("s")).cast("double").alias("score"))


def nn_confusion(spark, d):
    """VEC11: nearest vector of another label."""
    a = _asked(spark, d).where("label <> q_label")
    return a.groupBy("q").agg(F.max_by("vec_id", F.struct("sim", -F.col("vec_id"))).alias("nearest"))


def cross_label_pairs(spark, d):
    """VEC12: similarities of queries with rows of the same and of other labels, by hundredths."""
    b = _asked(spark, d).select((F.col("label") == F.col("q_label")).alias("same"), F.floor(F.round("sim", 6) * 20).cast("int").alias("step"))
    return b.groupBy("same", "step").agg(F.count(F.lit(1)).alias("pairs"))


def decide_similarity(spark, d):
    """DEC5: off_list below the floor, matched if the best agreeing score is enough and no less than the inverted, negation if that is closer."""
    s = score_agree_inverted(spark, d)
    w = Window.partitionBy("q").orderBy(F.desc("agree"), "label")
    t = s.withColumn("r", F.row_number().over(w)).withColumn("top", F.max("overall").over(Window.partitionBy("q"))).where("r = 1")
    status = F.when(F.col("top") < FLOOR, "off_list").when((F.col("agree") >= ACCEPT) & (F.col("agree") >= F.col("inverted")), "matched").when(F.col("inverted") > F.col("agree"), "negation").otherwise("below_threshold")
    return t.select("q", "label", status.alias("status"))


def second_findings(spark, d):
    """DEC5: a second label within the margin of an accepted first."""
    s = _asked(spark, d).groupBy("q", "label").agg(F.round(F.max("sim"), 6).alias("s"))
    w = Window.partitionBy("q").orderBy(F.desc("s"), "label")
    t = s.withColumn("r", F.row_number().over(w)).withColumn("best", F.max("s").over(Window.partitionBy("q")))
    return t.where((F.col("r") == 2) & (F.col("s") >= ACCEPT) & (F.round(F.col("best") - F.col("s"), 6) <= MARGIN)).select("q", "label")


def label_centroids(spark, d) -> DataFrame:
    """label, c: mean vector of each label, added up natively before the shuffle."""
    x = _vectors(spark, d).select("label", F.posexplode("e").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg("v").alias("v"))
    return m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))


def decide_linear(spark, d):
    """DEC6/VEC7: softmax over fixed weights (label means, times ten); accepted from a probability on."""
    c = label_centroids(spark, d)
    z = _searches(spark, d).join(F.broadcast(c.withColumnRenamed("label", "candidate"))).select("vec_id", "candidate", (V.dot(F.col("e"), F.col("c")) * 10).alias("z"))  # one mean per label
    w = Window.partitionBy("vec_id")
    p = z.withColumn("p", F.exp(F.col("z") - F.max("z").over(w))).withColumn("p", F.col("p") / F.sum("p").over(w))
    best = p.withColumn("r", F.row_number().over(w.orderBy(F.desc("p"), "candidate"))).where("r = 1")
    return best.select("vec_id", F.col("candidate").alias("label"), F.round("p", 6).alias("p"), (F.round("p", 6) >= 0.3).alias("accepted"))


def classifier_accuracy(spark, d):
    """VEC6/VEC8: trained on at most 4,000 labelled vectors, applied to all as expressions."""
    x = _vectors(spark, d)
    rows = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4_000).select("e", "label").toPandas()
    classes = sorted(rows.label.unique())
    w = V.train_linear(np.stack(rows.e.to_numpy()), rows.label.map(classes.index).to_numpy(), len(classes))
    p = V.probabilities(F.col("e"), w)
    guess = F.array_position(p, F.array_max(p)).cast("int") - 1
    return x.select("label", guess.alias("g")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("label")).alias("hits"))


# ---- evaluation


def evaluation_summary(spark, d):
    return evaluation.summary(spark, d)


def label_confusion(spark, d):
    return evaluation.confusion(evaluation.answers(spark, d))


def label_metrics(spark, d):
    return evaluation.metrics(evaluation.answers(spark, d), "finding")


def metrics_by_lang(spark, d):
    return evaluation.metrics_by_language(evaluation.answers(spark, d))


def wilson_interval(spark, d):
    m = evaluation.metrics(evaluation.answers(spark, d), "finding")
    low, high = evaluation.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.select("finding", low.alias("low"), high.alias("high"))


def answer_tallies(spark, d):
    return evaluation.tallies(spark, d)


def loss_diagnosis(spark, d):
    return evaluation.losses(spark, d)


def threshold_sweep(spark, d):
    return evaluation.sweep(evaluation.scored(spark, d))


def choose_threshold(spark, d):
    """WIN9: error at most 0.35, at least 20 accepted; most captured, then the lowest threshold."""
    s = evaluation.sweep(evaluation.scored(spark, d)).where("accepted >= 20 AND error <= 0.35")
    return s.withColumn("r", F.row_number().over(Window.orderBy(F.desc("captured"), "threshold"))).where("r = 1").select("threshold", "captured", "error")


def youden_floor(spark, d):
    return evaluation.youden(evaluation.scored(spark, d))


def rank_variants(spark, d):
    """WIN10: thresholds within two points of the best capture, least error first."""
    s = evaluation.sweep(evaluation.scored(spark, d)).where("accepted > 0")
    near = s.where(F.col("captured") >= s.agg(F.max("captured")).first()[0] - 0.02)
    return near.withColumn("place", F.row_number().over(Window.orderBy("error", "threshold"))).where("place <= 5").select("place", "threshold")


def stratified_split(spark, d):
    """WIN6: halves of every language and length class, by a seeded hash; odd strata alternate."""
    f = unique(table(spark, d, "feedback"), "id").select("id", F.concat_ws("|", F.coalesce("lang", F.lit("-")), F.coalesce("flags.length_class", F.lit("-"))).alias("stratum"))
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit("3:"), "id")))
    return f.select("id", F.when(F.row_number().over(w) % 2 == 1, "calibration").otherwise("test").alias("side"))


def cross_validation_folds(spark, d):
    """WIN13: five repeats of two folds."""
    f = unique(table(spark, d, "feedback"), "id").select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat"))
    fold = F.when(F.substring(F.md5(F.concat(F.col("repeat").cast("string"), F.lit(":"), "id")), 1, 1).rlike("[0-7]"), 0).otherwise(1)
    return f.groupBy("repeat", fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"))


# ---- events


def event_streaks(spark, d):
    """WIN1 over days of events by user."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    i = e.withColumn("g", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    return i.groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("days")).groupBy("user_id").agg(F.max("days").alias("longest"))


def event_resends(spark, d):
    """WIN3 on events: the same user and type within seven days of the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", (F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 7 DAYS")).alias("again"))
    return e.groupBy(F.coalesce("again", F.lit(False)).alias("again")).agg(F.count(F.lit(1)).alias("n"))


def audio_frames(spark, d):
    """AGG11 on a series: energy of frames of 20 values per event type, floor-index percentiles, partial frame dropped."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").where("value IS NOT NULL").select("event_type", "value", F.floor((F.row_number().over(w) - 1) / 20).alias("frame"))
    f = e.groupBy("event_type", "frame").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count(F.lit(1)).alias("n")).where("n = 20")
    r = f.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("rms", "frame")) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("event_type")))
    at = lambda p: F.max(F.when(F.col("r") == F.floor(F.lit(p) * (F.col("all") - 1)), F.col("rms")))
    return r.groupBy("event_type").agg(F.round(at(0.1), 4).alias("p10"), F.round(at(0.9), 4).alias("p90"), F.max("all").alias("frames"))


QUERIES = {f.__name__: f for f in (
    score_agree_inverted, score_topk_mean, top3_scores, nn_confusion, cross_label_pairs, decide_similarity, second_findings, decide_linear, classifier_accuracy, evaluation_summary, label_confusion, label_metrics, metrics_by_lang, wilson_interval,
    answer_tallies, loss_diagnosis, threshold_sweep, choose_threshold, youden_floor, rank_variants, stratified_split, cross_validation_folds, event_streaks, event_resends, audio_frames,
)}

_E = "(SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[] AS e, label, vec_id % 3 = 0 AS negated FROM embeddings)"
_A = f"a AS (SELECT x.vec_id, x.label, x.negated, q.vec_id AS q, q.label AS q_label, q.negated AS q_neg, list_dot_product(q.e, x.e) AS sim FROM {_E} x JOIN {_E} q ON q.vec_id % 100 = 0 AND x.vec_id != q.vec_id)"
_SC = "s AS (SELECT q, label, round(coalesce(max(sim) FILTER (negated = q_neg), -1), 6) AS agree, round(coalesce(max(sim) FILTER (negated != q_neg), -1), 6) AS inverted, round(max(sim), 6) AS overall FROM a GROUP BY q, label)"
ORACLE = {
    "score_agree_inverted": f"WITH {_A}, {_SC} SELECT * FROM s",
    "score_topk_mean": f"WITH {_A} SELECT q, label, round(avg(sim), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY sim DESC, vec_id) AS r FROM a) WHERE r <= 3 GROUP BY q, label",
    "top3_scores": f"WITH {_A} SELECT q, place::INT AS place, label, floor(s * 1000 + 0.5) / 1000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, label) AS place FROM (SELECT q, label, max(sim) AS s FROM a GROUP BY q, label)) WHERE place <= 3",
    "nn_confusion": f"WITH {_A} SELECT q, vec_id AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM a WHERE label != q_label) WHERE r = 1",
    "cross_label_pairs": f"WITH {_A} SELECT label = q_label AS same, floor(round(sim, 6) * 20)::INT AS step, count(*) AS pairs FROM a GROUP BY 1, 2",
    "decide_similarity": f"""WITH {_A}, {_SC}, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY agree DESC, label) AS r, max(overall) OVER (PARTITION BY q) AS top FROM s)
      SELECT q, label, CASE WHEN top < {FLOOR} THEN 'off_list' WHEN agree >= {ACCEPT} AND agree >= inverted THEN 'matched' WHEN inverted > agree THEN 'negation' ELSE 'below_threshold' END AS status FROM t WHERE r = 1""",
    "second_findings": f"""WITH {_A}, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, label) AS r, max(s) OVER (PARTITION BY q) AS best FROM (SELECT q, label, round(max(sim), 6) AS s FROM a GROUP BY q, label))
      SELECT q, label FROM t WHERE r = 2 AND s >= {ACCEPT} AND round(best - s, 6) <= {MARGIN}""",
    "decide_linear": f"""WITH x AS (SELECT vec_id, label, unnest(e) AS v, unnest(range(64)) AS i FROM {_E}), c AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i) GROUP BY label),
      z AS (SELECT q.vec_id, c.label, list_dot_product(q.e, c.c) * 10 AS z FROM {_E} q, c WHERE q.vec_id % 100 = 0), p AS (SELECT vec_id, label, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z)
      SELECT vec_id, label, round(p, 6) AS p, round(p, 6) >= 0.3 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS r FROM p) WHERE r = 1""",
    "stratified_split": """SELECT id, CASE WHEN row_number() OVER (PARTITION BY coalesce(lang, '-') || '|' || coalesce(flags.length_class, '-') ORDER BY md5('3:' || id)) % 2 = 1 THEN 'calibration' ELSE 'test' END AS side FROM (SELECT DISTINCT ON (id) * FROM feedback WHERE id IS NOT NULL)""",
    "cross_validation_folds": """SELECT repeat::INT AS repeat, CASE WHEN regexp_matches(substr(md5(repeat::VARCHAR || ':' || id), 1, 1), '[0-7]') THEN 0 ELSE 1 END AS fold, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM feedback WHERE id IS NOT NULL), range(5) r(repeat) GROUP BY 1, 2""",
    "event_streaks": "WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g FROM e) SELECT user_id, max(days) AS longest FROM (SELECT user_id, g, count(*) AS days FROM i GROUP BY ALL) GROUP BY user_id",
    "event_resends": "SELECT coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 7 DAYS, false) AS again FROM events",
    "audio_frames": """WITH f AS (SELECT event_type, frame, sqrt(avg(value * value)) AS rms, count(*) AS n FROM (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 20 AS frame FROM events WHERE value IS NOT NULL) GROUP BY ALL HAVING count(*) = 20),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rms, frame) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS c FROM f)
      SELECT event_type, round(max(rms) FILTER (r = floor(0.1 * (c - 1))), 4) AS p10, round(max(rms) FILTER (r = floor(0.9 * (c - 1))), 4) AS p90, max(c) AS frames FROM r GROUP BY event_type""",
}
ORACLE["event_resends"] = f"SELECT again, count(*) AS n FROM ({ORACLE['event_resends']}) GROUP BY again"
ORACLE |= evaluation.ORACLE
