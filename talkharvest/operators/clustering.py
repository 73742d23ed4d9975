"""AGG9: exact greedy average linkage of unknown topics within a farm's month."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows compared at once with all others.
BLOCK = 1_024


def average_linkage(x: np.ndarray, limit: float) -> np.ndarray:
    """Group number of each unit vector: the closest pair of groups merges while their mean cosine reaches the limit.

    The first of equal pairs wins. Groups are kept as sums of vectors, each with its best partner; a merge looks again only
    for those whose partner was one of both, as no other mean can rise above the best it has. Memory grows with the rows.
    """
    n = len(x)
    sums, size, group, alive = x.astype(float).copy(), np.ones(n), np.arange(n), np.ones(n, bool)
    partner, best = np.zeros(n, int), np.full(n, -2.0)

    def look(rows: np.ndarray) -> None:
        for a in range(0, len(rows), BLOCK):
            some = rows[a : a + BLOCK]
            s = sums[some] @ sums.T / (size[some][:, None] * size)
            s[:, ~alive] = -2
            s[np.arange(len(some)), some] = -2
            partner[some] = s.argmax(1)
            best[some] = s[np.arange(len(some)), partner[some]]

    look(np.arange(n))
    while n:
        i = int(best.argmax())
        if best[i] < limit:
            break
        i, j = sorted((i, int(partner[i])))
        sums[i] += sums[j]
        size[i] += size[j]
        alive[j], best[j] = False, -2.0
        group[group == j] = i
        look(np.flatnonzero(alive & ((partner == i) | (partner == j) | (np.arange(n) == i))))
    return group


def linked(chunks: DataFrame, limit: float = 0.57, dim: int = 160) -> DataFrame:
    """farm_id, visit_month, chunk_id, visitor, cluster. Unusable embeddings take no part; a group is one farm's month."""
    e = F.col("embedding")
    usable = e.isNotNull() & (F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = chunks.where("(status = 'off_list' OR (status = 'not_sure' AND reason = 'below_threshold')) AND farm_id IS NOT NULL AND visit_month IS NOT NULL").where(usable)
    rows = rows.select("farm_id", "visit_month", "chunk_id", F.coalesce("visitor_key", "message_id").alias("visitor"), "embedding")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_id", kind="stable").reset_index(drop=True)
        x = np.stack(pdf.embedding.to_numpy()).astype(float)
        g = average_linkage(x / np.linalg.norm(x, axis=1, keepdims=True), limit)
        return pdf.drop(columns="embedding").assign(cluster=pdf.chunk_id.to_numpy()[g])

    return rows.groupBy("farm_id", "visit_month").applyInPandas(one, "farm_id string, visit_month string, chunk_id string, visitor string, cluster string")


def described(members: DataFrame, least: int = 3) -> DataFrame:
    """AGG9/SORT2: farm_id, visit_month, cluster, chunks, visitors, recurring (``least`` visitors or more); most visitors first."""
    g = members.groupBy("farm_id", "visit_month", "cluster").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("visitor").alias("visitors"))
    return g.withColumn("recurring", F.col("visitors") >= least).orderBy(F.desc("visitors"), "cluster")


def reviewed(chunks: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """JOIN5/JOIN11: every chunk with its cluster (null for none) and whether that cluster is a recurring one."""
    c = described(members, least).select("farm_id", "visit_month", "cluster", "recurring")
    named = members.select("chunk_id", "farm_id", "visit_month", "cluster").join(c, ["farm_id", "visit_month", "cluster"]).select("chunk_id", "cluster", "recurring")
    return chunks.select("chunk_id").join(named, "chunk_id", "left").select("chunk_id", "cluster", F.coalesce("recurring", F.lit(False)).alias("recurring"))
