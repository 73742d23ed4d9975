"""New batches against everything already accepted (problem 5).

A segment index for bounded edit distance. An embedding becomes a string of 192 symbols (signs of its coordinates under
three fixed rotations), stored as 12 segments of 16 symbols under their position and week; a fingerprint is one segment of
its own. A batch probes, for every segment, its own and the one with its least certain symbol substituted; candidates are
verified first by the bounded edit distance of a second 64-symbol string and then by the exact cosine. The index is a
Parquet folder by stretches of four weeks (``SegmentIndex``): a batch reads only the stretches its windows touch, whose
strings are stored ready, and appends what it accepted, so history is never coded again nor compared with itself.

At a cosine of just 0.98 one symbol differs with probability 0.064, a segment is met with probability 0.5 or more and a
pair is missed with less than 1e-4 (at 0.99 with less than 1e-6); recall against brute force on the test tables is 1 (see the tests).

The decisions (accept or repeat) follow the order of arrival and are settled in rounds, only between first messages of
classes of copies, so copies are never paired with each other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut, ensure_checkpoint_dir, spread
from ..sources.tables import table, unique

COSINE, WINDOW_DAYS, DIM = 0.98, 7, 64
#: Days of one stretch of the index; a window touches two at most.
STRETCH_DAYS = 28
SEGMENTS, SEGMENT_LENGTH = 12, 16
#: Differing symbols of the second string that are still verified: a pair at cosine 0.98 differs in 4 of 64 on average;
#: more than 20 has a probability below 1e-9.
MAX_EDITS = 20

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def fingerprint_text(text: str | None) -> str | None:
    """Lower case, ß to ss, accents removed, words joined by single spaces; 28 hex digits of SHA-256. Null without words."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKD", text.replace("’", "'").replace("‘", "'").replace("ʼ", "'").lower().replace("ß", "ss"))
    t = "".join(c for c in t if not unicodedata.category(c).startswith("M"))
    words = _WORD.findall(t)
    return hashlib.sha256(" ".join(words).encode()).hexdigest()[:28] if words else None


def fingerprint_of(text: Column) -> Column:
    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_text(x) for x in texts], dtype=object)

    return prints(text)


@lru_cache(maxsize=1)
def rotations() -> np.ndarray:
    """Fixed orthogonal matrices side by side: three for the segments, one for the second string."""
    return np.hstack([np.linalg.qr(np.random.default_rng(seed).standard_normal((DIM, DIM)))[0] for seed in range(5, 9)])


def unit(v) -> np.ndarray | None:
    """The vector at length 1; null where it is missing, of another length, zero or not finite."""
    if v is None or len(v) != DIM:
        return None
    a = np.array([np.nan if x is None else x for x in v], float)
    n = np.sqrt((a * a).sum())
    return a / n if np.isfinite(n) and n > 0 else None


def codes(embeddings: pd.Series) -> pd.DataFrame:
    units = [unit(v) for v in embeddings]
    keys: list = [[] for _ in units]
    sigs: list = [None] * len(units)
    at = [i for i, u in enumerate(units) if u is not None]
    if at:
        r = np.stack([units[i] for i in at]) @ rotations()
        seg = r[:, : SEGMENTS * SEGMENT_LENGTH].reshape(len(at), SEGMENTS, SEGMENT_LENGTH)
        powers = 1 << np.arange(SEGMENT_LENGTH)
        own = (seg > 0) @ powers
        place = np.arange(SEGMENTS) << SEGMENT_LENGTH
        out = np.hstack([own | place, (own ^ powers[np.abs(seg).argmin(2)]) | place])
        sig = ((r[:, SEGMENTS * SEGMENT_LENGTH :] > 0).astype(np.uint64) << np.arange(DIM, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
        for row, k, s in zip(at, out.astype(np.int32), sig):
            keys[row], sigs[row] = k, int(s)
    return pd.DataFrame({"keys": keys, "sig": pd.array(sigs, "Int64")})


def segment_keys(embedding: Column) -> Column:
    """struct<keys array<int>, sig long> of an embedding: first its own segments, then those with a substitution.

    No keys where it is null, short, zero or not finite.
    """

    @F.pandas_udf("keys array<int>, sig long")
    def keys(e: pd.Series) -> pd.DataFrame:
        return codes(e)

    return keys(embedding)


def exact_cosine(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def within_window(a: Column, b: Column, days: int = WINDOW_DAYS) -> Column:
    """Not more than so many days apart, bounds included; a missing time is inside every window."""
    gap = F.abs(F.unix_micros(a) - F.unix_micros(b)) <= F.lit(days * 86_400_000_000)
    return F.coalesce(gap, F.lit(True))


def _stretch(micros: Column) -> Column:
    return F.floor(micros / F.lit(STRETCH_DAYS * 86_400_000_000)).cast("int")


def _touched(t: Column, days: int) -> Column:
    """The stretches the window around a time touches; null without a time."""
    span = F.lit(days * 86_400_000_000)
    return F.when(t.isNotNull(), F.array_distinct(F.array(_stretch(F.unix_micros(t) - span), _stretch(F.unix_micros(t) + span))))


def _named(messages: DataFrame, days: int) -> DataFrame:
    """message_id, batch, received_at, week (its stretch), near, ord, fp, embedding, e (the name of equal embeddings)."""
    name = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("embedding")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "embedding")), 16, "0")))
    m = messages.where("fp IS NOT NULL OR embedding IS NOT NULL").withColumn("received_at", F.col("received_at").cast("timestamp"))
    return m.select(
        "message_id", "batch", "received_at", _stretch(F.unix_micros("received_at")).alias("week"), _touched(F.col("received_at"), days).alias("near"),
        F.struct("batch", F.col("received_at").isNull().alias("undated"), "received_at", "message_id").alias("ord"), "fp", "embedding", F.when(F.size("embedding") == DIM, name).alias("e"),
    )


def history_of(stored: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """The accepted stored messages, each once. Messages with neither fingerprint nor embedding repeat nothing and are left out."""
    old = unique(stored, "message_id").where("status IN ('analyzed', 'not_sure')")
    return _named(old.select("message_id", F.lit(0).alias("batch"), "received_at", F.col("fingerprint").alias("fp"), "embedding"), days)


def batch_of(raw: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Incoming messages, each once. Null batches come last."""
    new = unique(raw, "message_id")
    fp = F.coalesce("fingerprint", fingerprint_of(F.col("text")))
    return _named(new.select("message_id", F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch"), "received_at", fp.alias("fp"), "embedding"), days)


def coded(messages: DataFrame, *by: str) -> DataFrame:
    """e, keys, sig, embedding (and ``by``) of every different embedding; copies are collapsed before they are coded."""
    vectors = spread(messages.where("e IS NOT NULL").groupBy("e", *by).agg(F.first("embedding").alias("embedding")), "e")
    return vectors.select("e", *by, "embedding", segment_keys(F.col("embedding")).alias("k")).select("e", *by, "k.keys", "k.sig", "embedding")


class SegmentIndex:
    """Accepted messages on disk by stretch of time: who they are, and the coded strings of their embeddings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, accepted: DataFrame) -> None:
        """Adds accepted messages (of ``history_of`` or ``batch_of``)."""
        m = cut(accepted)
        if m.isEmpty():
            return
        m.drop("embedding", "near").write.partitionBy("week").mode("append").parquet(f"{self.folder}/messages")
        coded(m, "week").write.partitionBy("week").mode("append").parquet(f"{self.folder}/strings")

    def read(self, table_name: str, stretches: list[int] | None) -> DataFrame | None:
        """One of the two tables, only the given stretches and what has no time; null where nothing was appended yet."""
        try:
            found = self.spark.read.parquet(f"{self.folder}/{table_name}")
        except AnalysisException:
            return None
        found = found.withColumn("week", F.col("week").cast("int"))
        return found if stretches is None else found.where(F.col("week").isin(stretches) | F.col("week").isNull())


def weeks_of(messages: DataFrame) -> tuple[int, int]:
    """First and last stretch of all rows: two numbers, so that undated rows can stand under each."""
    r = messages.agg(F.min("week"), F.max("week")).first()
    return (r[0], r[1]) if r[0] is not None else (0, 0)


def join_in_window(later: DataFrame, earlier: DataFrame, keys: list[str], weeks: tuple[int, int], condition: Column) -> DataFrame:
    """Rows with equal keys whose stretches touch, in one equi-join; an undated side touches every one.

    A pair may be found under several stretches; callers take distinct pairs.
    """
    every = F.sequence(F.lit(weeks[0] - 1), F.lit(weeks[1] + 1))
    probe = later.withColumn("week", F.explode(F.coalesce("near", every))).drop("near")
    stand = F.when(F.col("week").isNull(), every).otherwise(F.array(F.col("week")))
    return probe.join(earlier.withColumn("week", F.explode(stand)), [*keys, "week"]).where(condition).drop("week")


def embedding_links(new: DataFrame, fresh: DataFrame, known: DataFrame | None, weeks: tuple[int, int], cosine: float = COSINE) -> DataFrame:
    """e, e_other: different embeddings of a batch and of anything near it in time whose cosine is at least ``cosine``; both ways.

    fresh: the coded embeddings of the batch; known: those of the index, each with its stretch.
    """
    codes_ = fresh.select("e", "keys", "sig")
    index = codes_.join(new.where("e IS NOT NULL").select("e", "week").distinct(), "e").select("e", "week", "keys", "sig")
    vectors = fresh.select("e", "embedding")
    if known is not None:
        index, vectors = index.unionByName(known.select("e", "week", "keys", "sig")), vectors.unionByName(known.select("e", "embedding"))
    index = index.select(F.col("e").alias("e_other"), "week", F.explode(F.slice("keys", 1, SEGMENTS)).alias("key"), F.col("sig").alias("sig_o"))
    probe = new.where("e IS NOT NULL").select("e", "near").distinct().join(codes_, "e").select("e", "near", F.explode("keys").alias("key"), "sig")
    like = (F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_o"))) <= MAX_EDITS) & (F.col("e") != F.col("e_other"))
    found = cut(join_in_window(probe, index, ["key"], weeks, like).select("e", "e_other").distinct())
    exact = (
        found.join(fresh.select("e", F.col("embedding").alias("v")), "e")
        .join(vectors.select(F.col("e").alias("e_other"), F.col("embedding").alias("v_other")), "e_other")
        .where(exact_cosine(F.col("v"), F.col("v_other")) >= F.lit(cosine)).select("e", "e_other")
    )
    return exact.unionByName(exact.select(F.col("e_other").alias("e"), F.col("e").alias("e_other"))).distinct()


def keyed(messages: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """message_id, ord, week, key, own: a message under its fingerprint and embedding, and under every near embedding (not own)."""
    names = F.array_compact(F.array(F.concat(F.lit("f"), "fp"), F.concat(F.lit("e"), F.hex("e"))))
    own = messages.select("message_id", "ord", "week", "near", F.explode(names).alias("key"), F.lit(True).alias("own"))
    if near is None:
        return own
    other = messages.join(near, "e").select("message_id", "ord", "week", "near", F.concat(F.lit("e"), F.hex("e_other")).alias("key"), F.lit(False).alias("own"))
    return own.unionByName(other)


def repeats(sees: DataFrame, accepted: DataFrame, weeks: tuple[int, int] | None, days: int) -> DataFrame:
    """later, earlier of messages (``sees``, by key) and accepted ones (by own key) that came before them, within the window."""
    a = sees.select("key", "near", F.col("message_id").alias("later"), F.col("ord").alias("ord_l"))
    b = accepted.select("key", "week", F.col("message_id").alias("earlier"), F.col("ord").alias("ord_e"))
    ok = (F.col("ord_e") < F.col("ord_l")) & within_window(F.col("ord_l.received_at"), F.col("ord_e.received_at"), days)
    both = join_in_window(a, b, ["key"], weeks, ok) if weeks else a.drop("near").join(b.drop("week"), "key").where(ok)
    return both.select("later", "earlier").distinct()


def accept(history: DataFrame, new: DataFrame, near: DataFrame, weeks: tuple[int, int], days: int = WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """Ids of the accepted batch messages, and the pairs later, earlier.

    In each round the first open message of its fingerprint, its embedding and all near ones is accepted, and what repeats
    it leaves; a message before which nothing linked is open cannot be a repeat any more. Copies are never compared with
    each other, only with accepted ones, of which a key has one a round.
    """
    old = keyed(history)
    sees = cut(keyed(new, near))
    old_pairs = cut(repeats(sees, old, weeks, days))
    open_ = sees.join(old_pairs.select(F.col("later").alias("message_id")).distinct(), "message_id", "left_anti")
    # what shares no key with another open message is accepted without a round
    shared = open_.groupBy("key").agg(F.countDistinct("message_id").alias("n")).where("n > 1").select("key")
    linked = cut(open_.join(shared, "key", "left_semi").select("message_id").distinct())
    fresh_all = open_.join(linked, "message_id", "left_anti").where("own")
    open_ = cut(open_.join(linked, "message_id", "left_semi"))
    while not open_.isEmpty():
        first = open_.where("own").groupBy("key").agg(F.min("ord").alias("first"))
        mark = open_.join(first, "key").groupBy("message_id", "ord").agg(F.min("first").alias("first"))
        fresh = cut(open_.join(mark.where("ord <= first").select("message_id"), "message_id", "left_semi").where("own"))
        fresh_all = fresh_all.unionByName(fresh)
        gone = repeats(open_, fresh, None, days).select(F.col("later").alias("message_id")).unionByName(fresh.select("message_id")).distinct()
        open_ = cut(open_.join(gone, "message_id", "left_anti"))
    fresh_all = cut(fresh_all)
    return fresh_all.select("message_id").distinct(), old_pairs.unionByName(repeats(sees, fresh_all, weeks, days)).distinct()


def next_batch(index: SegmentIndex, raw: DataFrame, cosine: float = COSINE, days: int = WINDOW_DAYS, remember: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ids of the accepted messages of a delivery (which may hold several batches), and the pairs later, earlier.

    Reads the stretches of the index that the delivery's windows touch (all of them only where a message has no time) and
    appends what is accepted. An empty index or delivery gives no pairs.
    """
    new = cut(batch_of(raw, days))
    touched = new.agg(F.array_distinct(F.flatten(F.collect_set("near"))), F.count_if(F.col("near").isNull())).first()  # stretches, not rows
    stretches = None if touched[1] else [int(x) for x in touched[0]]
    fresh = cut(coded(new))
    old, known = index.read("messages", stretches), index.read("strings", stretches)
    seen = new.drop("embedding")
    history = (seen.limit(0) if old is None else old.withColumn("near", F.lit(None).cast("array<int>")).select(seen.columns))
    weeks = weeks_of(seen.select("week").unionByName(history.select("week")))
    near = cut(embedding_links(new, fresh, known, weeks, cosine))
    ids, pairs = accept(history, seen, near, weeks, days)
    if remember:
        index.append(new.join(ids, "message_id", "left_semi"))
    return ids, pairs


def divide(stored: DataFrame, raw: DataFrame, cosine: float = COSINE, days: int = WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """All deliveries against the stored messages, through an index of their own beside the checkpoints."""
    spark = raw.sparkSession
    ensure_checkpoint_dir(spark)
    index = SegmentIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")
    index.append(history_of(stored, days))
    return next_batch(index, raw, cosine, days, remember=False)


def _tables(spark, d):
    return table(spark, d, "messages_stored"), table(spark, d, "messages_raw")


def p5_found(spark, d):
    _, pairs = divide(*_tables(spark, d))
    return pairs.select(F.least("later", "earlier").alias("message_id_a"), F.greatest("later", "earlier").alias("message_id_b"))


def p5_decisions(spark, d):
    """message_id, accepted of every batch message."""
    stored, raw = _tables(spark, d)
    _, pairs = divide(stored, raw)
    gone = pairs.select(F.col("later").alias("message_id")).distinct().withColumn("accepted", F.lit(False))
    return unique(raw, "message_id").select("message_id").join(gone, "message_id", "left").select("message_id", F.coalesce("accepted", F.lit(True)).alias("accepted"))


QUERIES = {"p5_found": p5_found, "p5_decisions": p5_decisions}
ORACLE: dict[str, str] = {}
