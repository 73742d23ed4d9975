"""Filling containers of fixed capacity with documents (problem 8).

Vector bin packing by the dot-product heuristic: a container takes, of the items that still fit under every limit
(tokens, number of segments, loss-bearing tokens), the one whose need points most in the direction of what the container
has left. Items are dealt to groups of bounded size by a hash, each packed on its own, so no task ever holds more than a
few thousand sizes; the texts themselves never move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, spread
from ..sources.tables import table
from .encoding import sizes_of

CAPACITY, MAX_SEGMENTS = 2_048, 32
#: Items that are packed together.
GROUP_ITEMS = 4_096


def items(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, pieces, tokens, loss_tokens. Only documents beyond the capacity have more than one piece.

    Loss-bearing are the tokens after the first line (the prompt of an example), or all of a one-line text. Null and
    empty texts give one piece of 0 tokens.
    """
    s = docs.select("doc_id", sizes_of(F.col("text"), path).alias("s")).select("doc_id", "s.tokens", F.least("s.first_line", "s.tokens").alias("prompt"))
    pieces = F.greatest(F.lit(1), F.expr(f"(tokens + {capacity - 1}) DIV {capacity}").cast("int"))
    out = s.withColumn("pieces", pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    begin = F.col("piece") * capacity
    end = F.least(F.col("tokens"), begin + capacity)
    return out.select(
        "doc_id", "piece", "pieces", (end - begin).cast("int").alias("tokens"), (end - F.greatest(begin, F.least(end, F.col("prompt")))).cast("int").alias("loss_tokens")
    )


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each item; sizes: items x dimensions, none above the limits. Ties go to the earlier item."""
    need = sizes / limits
    order = np.argsort(-need.sum(1), kind="stable")
    # one run of numbers for each dimension, of the items that are not placed yet; placed ones leave when they are half of it
    ids, cols, gone = order, [np.ascontiguousarray(c) for c in need[order].T], np.zeros(len(sizes), bool)
    where, k, placed = np.full(len(sizes), -1), 0, 0
    left = np.ones(sizes.shape[1])
    while len(ids):
        fits, score = ~gone, np.zeros(len(ids))
        for c, room in zip(cols, left):
            fits &= c <= room + 1e-9
            score += c * room
        score[~fits] = -1
        i = int(score.argmax())
        if score[i] < 0:  # nothing fits: the next container
            k, left = k + 1, np.ones(sizes.shape[1])
            continue
        where[ids[i]], gone[i], placed = k, True, placed + 1
        left = left - [c[i] for c in cols]
        if 2 * placed >= len(ids):
            ids, cols = ids[~gone], [c[~gone] for c in cols]
            gone, placed = np.zeros(len(ids), bool), 0
    return where


def pack(docs: DataFrame, capacity: int = CAPACITY, segments: int = MAX_SEGMENTS, loss: int | None = None, group_items: int = GROUP_ITEMS, path: str | None = None) -> DataFrame:
    """doc_id, piece, pieces, tokens, loss_tokens, container (null for pieces of 0 tokens).

    ``loss`` is the limit of loss-bearing tokens and at least the capacity of one item. Every piece is placed once; an
    empty table gives no rows; repeated rows are repeated items.
    """
    loss = loss or capacity
    all_items = cut(items(docs, capacity, path))
    n = all_items.where(f"tokens > 0 AND tokens < {capacity}").count()
    groups = max(1, -(-n // group_items))
    limits = np.array([capacity, segments, loss], float)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        sizes = np.stack([pdf.tokens, np.ones(len(pdf)), np.minimum(pdf.loss_tokens, loss)], 1).astype(float)
        where = fill(sizes, limits)
        return pdf.assign(container=[f"{g}-{w}" for g, w in zip(pdf.grp, where)]).drop(columns="grp")

    partial = all_items.where(f"tokens > 0 AND tokens < {capacity}").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    packed = spread(partial, "grp").groupBy("grp").applyInPandas(one, "doc_id long, piece int, pieces int, tokens int, loss_tokens int, container string")
    full = all_items.where(f"tokens = {capacity}").withColumn("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece"))
    empty = all_items.where("tokens = 0").withColumn("container", F.lit(None).cast("string"))
    return packed.unionByName(full).unionByName(empty)


def containers(packed: DataFrame) -> DataFrame:
    """container, items, tokens, loss_tokens, unused of every container."""
    return packed.where("container IS NOT NULL").groupBy("container").agg(
        F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"), (F.lit(CAPACITY) - F.sum("tokens")).alias("unused")
    )


def p8_packed(spark, d):
    return pack(table(spark, d, "documents"))


def p8_containers(spark, d):
    return containers(pack(table(spark, d, "documents")))


def p8_found(spark, d):
    """Documents of several pieces, read off the packing."""
    return pack(table(spark, d, "documents")).where("pieces > 1").select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_containers": p8_containers}
ORACLE: dict[str, str] = {}
