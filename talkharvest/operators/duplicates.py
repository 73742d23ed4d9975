"""JOIN2, JOIN3, WIN3, WIN4: messages that repeat one that came before, by fingerprint or by embedding, within a time window.

Known are all stored messages and the batch messages that came before. The window is symmetric and its bounds count; a
missing time is inside every window. Messages without a fingerprint get that of their text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..plans.cut import cut, spread
from ..sources.tables import unique

WINDOW_DAYS, NEAR, DIM = 7, 0.98, 64
#: Sign segments of an embedding and their length: a pair at NEAR is missed with a probability below 1e-4. Of 64 more signs a
#: pair at NEAR differs in 4 on average, and in more than MAX_SIGNS with a probability below 1e-9.
SEGMENTS, LENGTH, MAX_SIGNS = 12, 16, 20
_DAY = 86_400_000_000


def messages(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """message_id, old, t (microseconds), fp, embedding of stored and batch messages, each once."""
    time = F.unix_micros(F.col("received_at").cast("timestamp"))
    old = unique(stored, "message_id").select("message_id", F.lit(True).alias("old"), time.alias("t"), F.col("fingerprint").alias("fp"), "embedding")
    new = unique(raw, "message_id").select("message_id", F.lit(False).alias("old"), time.alias("t"), F.coalesce("fingerprint", fingerprint(F.col("text"))).alias("fp"), "embedding")
    return old.unionByName(new)


def repeated(rows: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """message_id of the batch rows (``probe``) with a ``known`` row of their key before them within the window.

    rows: key, message_id, old, t, known, probe. Stored rows come before all batch rows, batch rows by time (null last) and id.
    Keys are cut into weeks, so a key with a large part of all rows is spread; what reaches over a week's edge is its
    first and last time, aggregated before it moves.
    """
    span = F.lit(days * _DAY)
    rows = rows.withColumn("week", F.floor(F.col("t") / span))
    dated, undated = rows.where("t IS NOT NULL"), rows.where("t IS NULL")
    w = Window.partitionBy("key", "week").orderBy("t", F.desc("old"), "message_id")
    known_t, old_t = F.when(F.col("known"), F.col("t")), F.when(F.col("known") & F.col("old"), F.col("t"))
    here = dated.withColumns({
        "before": F.max(known_t).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.min(old_t).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).where("probe")
    weeks = dated.where("known").groupBy("key", "week").agg(F.max("t").alias("last"), F.min(old_t).alias("first"))
    ends = lambda by, *cols: weeks.select("key", (F.col("week") + by).alias("week"), *cols)
    here = here.join(ends(1, "last"), ["key", "week"], "left").join(ends(-1, "first"), ["key", "week"], "left")
    near = lambda gap: F.coalesce(gap <= span, F.lit(False))
    t = F.col("t")
    hit = near(t - F.col("before")) | near(F.col("after") - t) | near(t - F.col("last")) | near(F.col("first") - t)
    # a key with an undated stored message repeats everywhere; an undated batch message comes after all dated ones
    always = undated.where("known AND old").select("key").distinct()
    keys = rows.where("known").groupBy("key").agg(F.max(F.col("old") | F.col("t").isNotNull()).alias("any"), F.min(F.when(F.col("t").isNull(), F.col("message_id"))).alias("least"))
    late = undated.where("probe").join(keys, "key").where(F.col("any") | (F.col("least") < F.col("message_id")))
    found = here.where(hit).select("message_id").unionByName(here.join(always, "key", "left_semi").select("message_id"))
    return found.unionByName(late.select("message_id")).distinct()


def exact(all_messages: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """JOIN2/WIN3: batch messages whose fingerprint came before within the window; repeats extend it (chained)."""
    rows = all_messages.where("fp IS NOT NULL").select(F.col("fp").alias("key"), "message_id", "old", "t", F.lit(True).alias("known"), (~F.col("old")).alias("probe"))
    return repeated(rows, days)


def leaders(all_messages: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """WIN4: message_id, duplicate, where only kept originals open a window; by time, undated ones last.

    Times are read as a stream of sorted fingerprints; what is held is one batch and the last original.
    """
    span = days * _DAY

    def run(batches):
        key, lead = None, None
        for pdf in batches:
            out = np.ones(len(pdf), bool)
            fps, ts = pdf.fp.to_numpy(object), pdf.t.to_numpy(float)
            edges = [0, *(np.flatnonzero(fps[1:] != fps[:-1]) + 1), len(fps)] if len(fps) else [0]
            for a, b in zip(edges, edges[1:]):
                if fps[a] != key:
                    key, lead = fps[a], None
                t = ts[a:b]
                dated = int((~np.isnan(t)).sum())
                i = 0 if lead is None else int(np.searchsorted(t[:dated], lead + span, "right"))
                while i < dated:  # from one original to the next
                    out[a + i], lead = False, t[i]
                    i = int(np.searchsorted(t[:dated], lead + span, "right"))
                if lead is None and b > a:  # nothing dated: the first is the original
                    out[a], lead = False, np.inf
            yield pd.DataFrame({"message_id": pdf.message_id, "duplicate": out})

    rows = spread(all_messages.where("fp IS NOT NULL").select("fp", "t", "message_id"), "fp").sortWithinPartitions("fp", F.col("t").asc_nulls_last(), "message_id")
    return rows.mapInPandas(run, "message_id string, duplicate boolean")


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.hstack([np.linalg.qr(np.random.default_rng(seed).standard_normal((DIM, DIM)))[0] for seed in range(31, 35)])


def _segments(vectors: pd.Series) -> pd.DataFrame:
    """keys: twelve segments of signs, and the same with their least certain sign turned; signs: 64 more."""
    all_ = np.stack(vectors.to_list()) @ _directions()
    r = all_[:, : SEGMENTS * LENGTH].reshape(len(vectors), SEGMENTS, LENGTH)
    powers = 1 << np.arange(LENGTH)
    own, place = (r > 0) @ powers, np.arange(SEGMENTS) << LENGTH
    keys = np.hstack([own | place, (own ^ powers[np.abs(r).argmin(2)]) | place]).astype(np.int32)
    signs = ((all_[:, SEGMENTS * LENGTH :] > 0).astype(np.uint64) << np.arange(DIM, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"keys": list(keys), "signs": signs})


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def near(all_messages: DataFrame, days: int = WINDOW_DAYS, least: float = NEAR) -> DataFrame:
    """JOIN3: batch messages with an embedding at cosine ``least`` or more to one that came before within the window.

    Equal embeddings are one entry of the index. Pairs are looked for under equal sign segments, never within a farm or
    a week as a whole, and checked exactly. Embeddings that are null, of another length, zero or not finite are no case.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    m = all_messages.where((F.size("embedding") == DIM) & finite & F.exists("embedding", lambda v: v != 0)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    m = cut(m.select("message_id", "old", "t", "embedding", F.xxhash64("embedding").alias("e"), F.hash("embedding").alias("e2")))
    vectors = cut(spread(m.groupBy("e", "e2").agg(F.first("embedding").alias("v"), F.bool_or(~F.col("old")).alias("new")), "e"))
    coded = cut(vectors.select("e", "e2", "new", F.pandas_udf(_segments, "keys array<int>, signs long")("v").alias("s")).select("e", "e2", "new", "s.*"))
    index = coded.select(F.col("e").alias("f"), F.col("e2").alias("f2"), F.explode(F.slice("keys", 1, SEGMENTS)).alias("key"), F.col("signs").alias("signs_f"))
    probe = coded.where("new").select("e", "e2", F.explode("keys").alias("key"), "signs")
    like = (F.bit_count(F.col("signs").bitwiseXOR(F.col("signs_f"))) <= MAX_SIGNS) & F.expr("e <> f OR e2 <> f2")
    pairs = cut(probe.join(index, "key").where(like).select("e", "e2", "f", "f2").distinct())
    pairs = pairs.join(vectors.select("e", "e2", "v"), ["e", "e2"]).join(vectors.select(F.col("e").alias("f"), F.col("e2").alias("f2"), F.col("v").alias("u")), ["f", "f2"])
    pairs = pairs.where(F.round(cosine(F.col("v"), F.col("u")), 6) >= least).select("e", "e2", "f", "f2")
    name = lambda a, b: F.concat_ws(":", a, b)
    own = m.select(name("e", "e2").alias("key"), "message_id", "old", "t", F.lit(True).alias("known"), (~F.col("old")).alias("probe"))
    other = m.where("NOT old").join(pairs, ["e", "e2"]).select(name("f", "f2").alias("key"), "message_id", "old", "t", F.lit(False).alias("known"), F.lit(True).alias("probe"))
    return repeated(cut(own.unionByName(other)), days)
