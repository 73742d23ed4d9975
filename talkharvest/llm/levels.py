"""Reading level of each document (problem 9).

A linear pairwise ranker learns from graded pairs of documents which one reads harder, on features of syntax (length and
commas of the document's sentences) and vocabulary (length and variety of its words); isotonic regression turns its
scores into levels. Features are built-in expressions, so scoring a corpus is one scan without Python and without a
shuffle; only the features of at most ``MAX_LABELLED`` labelled documents reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..sources.tables import table

#: Labelled documents used for fitting, pairs drawn of them, and words below which a text has no level.
MAX_LABELLED, PAIRS, LEAST_WORDS = 20_000, 50_000, 12
#: Words of the blocks in which variety is measured, so that it does not depend on a document's length.
BLOCK = 200
#: Characters of Han, Hiragana and Katakana, each counted as a word, and up to four of Thai, Lao, Burmese and Khmer.
UNSPACED = r"([\u3005-\u3007\u3041-\u3096\u3099-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{323af}]|[\u0e01-\u0eff\u1000-\u109f\u1780-\u17d3]{1,4})"
#: One quick range around them all.
MAYBE_UNSPACED = r"[\u0e01-\u17d3\u3005-\uff9f\x{20000}-\x{323af}]"
COMMAS = ",;，、،"
EPOCHS, RATE, L2 = 250, 0.8, 1e-3

#: Features without meaning where words are single characters; there they count as the mean of the labelled documents.
SIZED = ("letters", "long", "very_long", "very_long_high")
FEATURES = ("sentence", "sentence_low", "sentence_high", "letters", "long", "very_long", "very_long_high", "commas", "variety")


def _at(sorted_values: Column, share: float) -> Column:
    """Null where there is no value."""
    return F.get(sorted_values, F.floor((F.size(sorted_values) - 1) * F.lit(share)).cast("int")).cast("double")


def _spaced(text: Column) -> Column:
    """The text with every character of the scripts without spaces as a word of its own; other texts as they are."""
    apart = F.regexp_replace(F.regexp_replace(text, UNSPACED, " $1 "), " {2,}", " ")
    return F.when((F.octet_length(text) >= F.length(text) + 2) & F.regexp_like(text, F.lit(MAYBE_UNSPACED)), apart).otherwise(text)


def _full(words: Column) -> Column:
    """Words of a text split at white space, without the empty ones before its first and after its last."""
    ends = lambda at: F.when(F.get(words, at) == "", 1).otherwise(0)
    return F.greatest(F.lit(1), F.size(words) - ends(F.lit(0)) - F.when(F.size(words) > 1, ends(F.size(words) - 1)).otherwise(0))


def _without(text: Column, marks: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(""))
    return text


def _median(sorted_values: Column) -> Column:
    """The middle value, or the mean of the two."""
    n = F.size(sorted_values)
    return (F.get(sorted_values, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_values, F.floor(n / 2).cast("int"))) / 2


def _variety(words: Column) -> Column:
    """Median share of different words over the blocks of BLOCK words of the whole list; the last block ends with the list.

    Lists are wrapped in arrays so that lambdas bind them once.
    """
    block = lambda w, i: F.slice(w, F.greatest(F.lit(1), F.least(i * BLOCK, F.size(w) - BLOCK) + 1), BLOCK)
    shares = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda i: F.size(F.array_distinct(block(w, i))) / F.least(F.size(w), F.lit(BLOCK)))
    return F.get(F.transform(F.transform(F.array(words), lambda w: F.sort_array(shares(w))), _median), F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, words and the features of every document with LEAST_WORDS words or more."""
    return measured(docs).where(F.col("words") >= LEAST_WORDS)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, words and the features of every document, those of word length null where most words are single characters.

    Order statistics over the sentences are used, so single easier or harder sentences do not change a document's place.
    """
    text = F.col("text")
    rows = docs.select("doc_id", _spaced(text).alias("text")).select("doc_id", text, F.split(F.lower(text), r"\s+").alias("all"))
    parts = F.filter(F.split(text, r"[.!?…。！？।\r\n]+"), lambda s: F.length(s) >= 3)
    rows = rows.select("doc_id", _full(F.col("all")).alias("words"), _variety(F.col("all")).alias("variety"), F.transform(parts, lambda s: F.struct(s.alias("s"), F.split(F.trim(s), " ").alias("w"))).alias("parts"))
    longer = lambda w, n: F.size(F.filter(w, lambda x: F.length(x) >= n)) / F.size(w)
    each = F.transform(
        "parts",
        lambda r: F.struct(
            F.size(r["w"]).alias("n"), (F.length(r["s"]) / F.size(r["w"])).alias("letters"), longer(r["w"], 10).alias("long"), longer(r["w"], 14).alias("very"),
            (F.length(r["s"]) - F.length(_without(r["s"], COMMAS))).alias("commas"),
        ),
    )
    rows = rows.select("doc_id", "words", "variety", each.alias("m"))
    rows = rows.select("doc_id", "words", "variety", *[F.sort_array(F.col(f"m.{f}")).alias(f) for f in ("n", "letters", "long", "very", "commas")])
    # a word and a space are two characters where words are single characters
    sized = lambda c: F.when(_at(F.col("letters"), 0.5) > 2.5, c)
    return rows.select(
        "doc_id",
        "words",
        F.log1p(_at(F.col("n"), 0.5)).alias("sentence"),
        F.log1p(_at(F.col("n"), 0.3)).alias("sentence_low"),
        F.log1p(_at(F.col("n"), 0.7)).alias("sentence_high"),
        sized(_at(F.col("letters"), 0.5)).alias("letters"),
        sized(_at(F.col("long"), 0.5)).alias("long"),
        sized(_at(F.col("very"), 0.5)).alias("very_long"),
        sized(_at(F.col("very"), 0.7)).alias("very_long_high"),
        F.log1p(_at(F.col("commas"), 0.5)).alias("commas"),
        "variety",
    )


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in order and their calibrated levels, by pooling adjacent violators; equal scores are one block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(score[order], level[order]):
        if blocks and blocks[-1][3] == x:
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + 1, blocks[-1][2], x]
        else:
            blocks.append([y, 1, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys


class Ranker:
    """Weights over standardised features and the scores at which the levels change."""

    def __init__(self, x: np.ndarray, level: np.ndarray, seed: int = 3):
        known = ~np.isnan(x)
        self.mean = np.where(known, x, 0).sum(0) / np.maximum(known.sum(0), 1)
        x = np.where(known, x, self.mean)
        self.scale = np.maximum(x.std(0), 1e-9)
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        i, j = rng.integers(0, len(z), PAIRS), rng.integers(0, len(z), PAIRS)
        sign = np.sign(level[i] - level[j])
        d = (z[i] - z[j])[sign != 0] * sign[sign != 0, None]
        w = np.zeros(z.shape[1])
        for _ in range(EPOCHS if len(d) else 0):
            g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + L2 * w
            w -= RATE * g
        self.weights = w
        xs, ys = isotonic(z @ w, level)
        # between two blocks the calibrated level runs straight; a level begins where it passes the half
        self.cuts = []
        for half in (1.5, 2.5, 3.5):
            k = int(np.searchsorted(ys, half))
            if k == 0:
                self.cuts.append(-np.inf)
            elif k == len(ys):
                self.cuts.append(np.inf)
            else:
                t = (half - ys[k - 1]) / max(ys[k] - ys[k - 1], 1e-12)
                self.cuts.append(float(xs[k - 1] + t * (xs[k] - xs[k - 1])))

    def score(self) -> Column:
        out = F.lit(0.0)
        for f, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights):
            value = F.coalesce(F.col(f), F.lit(float(m))) if f in SIZED else F.col(f)
            out = out + (value - F.lit(float(m))) * F.lit(float(w / s))
        return out

    def level(self, score: Column) -> Column:
        out = F.when(score.isNotNull(), 1)
        for c in self.cuts:
            out = out + F.when(score >= F.lit(c), 1).otherwise(0)
        return out.cast("int")


def fit(known: DataFrame, labels: DataFrame) -> Ranker | None:
    """From measured documents and the median of their ratings; repeated and null ratings count once and not at all. Null without labels."""
    rated = labels.where("doc_id IS NOT NULL AND reading_level IS NOT NULL").dropDuplicates(["doc_id", "rater"])
    rated = rated.groupBy("doc_id").agg(F.expr("percentile(reading_level, 0.5)").alias("level"))
    chosen = F.broadcast(cut(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)))  # at most MAX_LABELLED rows
    rows = known.where(F.col("words") >= LEAST_WORDS).join(chosen, "doc_id").select("doc_id", "level", *FEATURES).toPandas()
    rows = rows.dropna(subset=[f for f in FEATURES if f not in SIZED]).sort_values(["doc_id", *FEATURES])
    return Ranker(rows[list(FEATURES)].to_numpy(float), rows.level.to_numpy(float)) if len(rows) else None


def levelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, level of every document; level is null for null, empty and very short texts, or without any label."""
    known = cut(measured(docs.select("doc_id", "text")))  # a few numbers of each document, measured once for fitting and scoring
    model = fit(known, labels)
    if model is None:
        return known.select("doc_id").withColumns({"score": F.lit(None).cast("double"), "level": F.lit(None).cast("int")})
    score = F.when(F.col("words") >= LEAST_WORDS, model.score())
    return known.withColumn("score", score).select("doc_id", "score", model.level(F.col("score")).alias("level"))


def p9_levels(spark, d):
    return levelled(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p9_profile(spark, d):
    """level, documents: how demanding the corpus is."""
    return p9_levels(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark, d):
    return p9_levels(spark, d).where("level = 4").select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}
ORACLE: dict[str, str] = {}
