"""The message pipeline: gate, language, scrubbing, clauses, decisions, fold-up (DEC1 to DEC6, AGG1 to AGG3, JOIN4, UDF5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii, sequences
from ..functions import text as T
from ..functions.embedding import EmbedFn, embed, hashing


def gate(messages: DataFrame) -> DataFrame:
    """DEC2: status, reason: no text, phantom, or usable; cheap tests stand before every Python call."""
    t = F.col("text")
    why = F.when(t.isNull() | (F.trim(t) == ""), "no_text").when(T.is_phantom(t), "no_letters")
    return messages.withColumn("reason", why).withColumn("status", F.when(why.isNotNull(), "inaudible"))


#: Examples of the catalogue; more are an error, since it goes to every task.
MAX_EXAMPLES = 50_000
_ROWS = 1_024


def judged(examples: DataFrame):
    """Function of an embedding and whether its text is negated: the finding whose examples of the same sign come nearest, how near these
    and those of the other sign are, and the nearest of all (-1 for none). Equal findings go by name.

    Clauses are held against the whole catalogue in blocks of rows, as one product of matrices each.
    """
    rows = examples.select("finding", "negated", "embedding").where("finding IS NOT NULL AND negated IS NOT NULL AND embedding IS NOT NULL").limit(MAX_EXAMPLES + 1).toPandas()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} examples")
    names = sorted(set(rows.finding)) or [None]  # without any example nothing comes near
    sides = []
    for sign in (False, True):
        own = rows[rows.negated == sign].sort_values("finding", kind="stable")
        place = np.array([names.index(f) for f in own.finding], int)
        sides.append((np.stack(own.embedding.to_list()).astype(float) if len(own) else None, place))

    def nearest(x: np.ndarray, side) -> np.ndarray:
        out = np.full((len(x), len(names)), -1.0)
        vectors, place = side
        if vectors is not None:
            at, starts = np.unique(place, return_index=True)
            out[:, at] = np.maximum.reduceat(x @ vectors.T, starts, axis=1)
        return out

    @F.pandas_udf("finding string, agree double, inverted double, top double")
    def judge(embedding: pd.Series, negated: pd.Series) -> pd.DataFrame:
        parts = []
        for a in range(0, len(embedding), _ROWS):
            x, neg = np.stack(embedding.iloc[a : a + _ROWS].to_list()).astype(float), negated.iloc[a : a + _ROWS].to_numpy(bool)[:, None]
            plain, turned = (nearest(x, side) for side in sides)
            agree, other = np.where(neg, turned, plain), np.where(neg, plain, turned)
            k, i = agree.argmax(1), np.arange(len(x))
            parts.append(pd.DataFrame({"finding": [names[j] for j in k], "agree": agree[i, k], "inverted": other[i, k], "top": np.maximum(agree, other).max(1)}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"finding": pd.Series(dtype=object), "agree": [], "inverted": [], "top": []})

    return judge


def analysed(messages: DataFrame, examples: DataFrame, floor: float = 0.15, accept: float = 0.3, fn: EmbedFn = hashing) -> DataFrame:
    """message_id, status, findings (array<struct<id, confidence>>), not_sure_count, off_list_count of every message.

    ``examples`` (finding, negated, embedding) is the catalogue's fixed table, of at most MAX_EXAMPLES rows. Messages without text are
    inaudible; one with neither finding nor doubt is not_sure.
    """
    g = gate(messages.select("message_id", "text", "lang"))
    ok = pii.scrubbed(g.where("status IS NULL").select("message_id", "text", "lang")).select("message_id", "lang", "clean")
    c = ok.select("message_id", "lang", F.posexplode(T.sentences(F.col("clean"))).alias("s", "sentence")).select("message_id", "lang", "s", F.posexplode(sequences.clauses()("sentence", "lang")).alias("c", "clause"))
    c = c.withColumn("t", T.padded(F.col("clause"))).withColumn("n", T.negation_in(F.col("t"), F.col("lang"))).drop("t")
    e = embed(c, "clause", fn)
    best = e.select("message_id", F.col("n.uncertain").alias("uncertain"), judged(examples)("embedding", "n.negated").alias("j")).select("message_id", "uncertain", "j.*")
    status = F.when(F.col("top") < floor, "off_list").when(F.col("uncertain"), "not_sure").when((F.col("agree") >= accept) & (F.col("agree") >= F.col("inverted")), "matched").otherwise("not_sure")
    d = best.select("message_id", "finding", "agree", status.alias("status"))
    hit = d.where("status = 'matched'").groupBy("message_id", "finding").agg(F.max("agree").alias("confidence"))
    found = hit.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct(F.col("confidence"), F.col("finding"))), asc=False).alias("l")).select("message_id", F.transform("l", lambda r: F.struct(r["finding"].alias("id"), r["confidence"].alias("confidence"))).alias("findings"))
    counts = d.groupBy("message_id").agg(F.count_if(F.col("status") == "not_sure").alias("not_sure_count"), F.count_if(F.col("status") == "off_list").alias("off_list_count"))
    out = g.select("message_id", "status").join(counts, "message_id", "left").join(found, "message_id", "left")
    return out.select(
        "message_id", F.coalesce("status", F.when(F.size("findings") > 0, "analyzed").otherwise("not_sure")).alias("status"), F.coalesce("findings", F.array().cast("array<struct<id:string,confidence:double>>")).alias("findings"),
        F.coalesce("not_sure_count", F.lit(0)).alias("not_sure_count"), F.coalesce("off_list_count", F.lit(0)).alias("off_list_count"),
    )


def aligned(chunks: list[str], segments: list[str]) -> list[int]:
    """JOIN4: the segment of each chunk: a cursor runs forward over the segments' words; a chunk not found keeps the last one."""
    words = [(w, k) for k, s in enumerate(segments) for w in s.lower().split()]
    out, at, last = [], 0, 0
    for c in chunks:
        first = c.lower().split()[:1]
        hit = next((i for i in range(at, len(words)) if first and words[i][0] == first[0]), None)
        if hit is not None:
            at, last = hit + 1, words[hit][1]
        out.append(last)
    return out


def align():
    @F.pandas_udf("array<int>")
    def run(chunks: pd.Series, segments: pd.Series) -> pd.Series:
        return pd.Series([aligned(list(c), list(s)) for c, s in zip(chunks, segments)])

    return run


def chosen_translation(tries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """VEC13: key, attempt: the first attempt whose worse cosine reaches the threshold, else the best one."""
    t = tries.withColumn("score", F.least("forth", "back"))
    first = F.min(F.when(F.col("score") >= threshold, F.col("attempt")))
    return t.groupBy("key").agg(F.coalesce(first, F.max_by("attempt", F.struct("score", -F.col("attempt")))).alias("attempt"))


def three_phases(clips: DataFrame, examples: DataFrame, folder: str, transcribe, translate, **how) -> DataFrame:
    """STR8: all clips are transcribed, then all analysed, then only sentences under review translated; each phase is written and read again.

    clips: message_id, lang and what ``transcribe`` (DataFrame -> DataFrame with text) needs. ``translate`` is a function of
    a text column. Gives message_id, sentence_index, sentence, translation of messages without any finding.
    """
    spark = clips.sparkSession
    transcribe(clips).select("message_id", "lang", "text").write.mode("overwrite").parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    analysed(texts, examples, **how).write.mode("overwrite").parquet(f"{folder}/analysed")
    done = spark.read.parquet(f"{folder}/analysed")
    doubtful = done.where("status = 'not_sure' AND size(findings) = 0").select("message_id")
    rows = texts.join(doubtful, "message_id", "left_semi").select("message_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))
    rows.withColumn("translation", translate(F.col("sentence"))).write.mode("overwrite").parquet(f"{folder}/translated")
    return spark.read.parquet(f"{folder}/translated")
