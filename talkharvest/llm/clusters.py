"""Clusters of mutually similar records (problem 1).

Grid density clustering: under several fixed rotations every vector falls into the cell of its largest coordinate
(quantised features). Cells are counted; those of fewer than DENSE rows say nothing, and those that are too full are
quantised again by further rotations until they are of bounded size, so one hot topic never becomes one task; what no
rotation parts is dealt to blocks, every two of which meet. Inside a
dense cell, rows whose cosine reaches the link limit belong together; cells that share a row are adjacent, and minimum labels are propagated over (row, cell) until nothing
changes. The groups are then closed under average linkage: the mean cosine of two groups is the product of their mean
vectors, and mutual best partners at or above the limit are merged until none is left. Here no cell is asked: every group
is compared with every other of its period, block by block, so a pair that shared no cell is found all the same. Groups
that no chain of such pairs connects never meet, so every connected part is closed in one task, by a chain of nearest
neighbours; a part too large for one task is merged in rounds over all of it until it falls apart.

Equal vectors of a period are one row of the search with their number as weight.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut, spread
from ..sources.tables import table, unique

LIMIT, DIM = 0.57, 160
#: Cosine of a direct link, rotations of the search, rows of one cell task, groups of one block and of one connected part closed in one task.
LINK, GRIDS, CELL_ROWS, BLOCK_ROWS, PART_ROWS = 0.70, 12, 1_500, 32_768, 32_768
#: Error of a mean cosine in single precision, allowed for before the exact check; and cosines held at a time.
SLACK, HELD = 1e-5, 4_000_000
#: Rows from which on a cell is dense, and further rotations by which a full cell can be cut (what its number has room for).
DENSE, DEPTH = 2, 6
#: Cells of one rotation and none.
_RADIX = 2 * DIM + 1


@lru_cache(maxsize=8)
def rotation(k: int, dim: int = DIM) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(1_000 + k).standard_normal((dim, dim)))
    return q.astype(np.float32)


def quantised(x: np.ndarray, k: int) -> np.ndarray:
    """The cell of each row: the axis of its largest coordinate and its sign."""
    r = x @ rotation(k, x.shape[1])
    at = np.abs(r).argmax(1)
    return (2 * at + (r[np.arange(len(r)), at] > 0)).astype(np.int32)


def usable(embedding: Column, dim: int = DIM) -> Column:
    """dim finite numbers that are not all zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) == dim) & finite & F.exists(embedding, lambda v: v != 0)


def candidates(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """id, period, visitor, embedding of the unknown-topic chunks; a null visitor_key is the message's own visitor."""
    wanted = F.col("status").eqNullSafe("off_list") | (F.col("status").eqNullSafe("not_sure") & F.col("reason").eqNullSafe("below_threshold"))
    own = unique(chunks.select("chunk_id", "message_id", "visitor_key", "visit_month", "status", "reason", "embedding"), "chunk_id")
    return own.where(wanted & F.col("visit_month").isNotNull() & usable(F.col("embedding"), dim)).select(
        F.col("chunk_id").alias("id"), F.col("visit_month").alias("period"), F.coalesce("visitor_key", "message_id").alias("visitor"), F.col("embedding").cast("array<float>").alias("embedding")
    )


def _unit(embedding: Column) -> Column:
    @F.pandas_udf("binary")
    def unit(e: pd.Series) -> pd.Series:
        x = np.stack(e.values).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series([r.tobytes() for r in x.astype(np.float32)])

    return unit(embedding)


def _matrix(vec: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(len(vec), dim)


def _coded(units: DataFrame, first: int, grids: int, dim: int) -> DataFrame:
    """period, unit, w, vec, cells: every unit once, with the number of its cell under each rotation.

    vec is the direction in bytes, w the length of the mean vector: cosine times both w is the mean cosine of two groups,
    to about 0.002; what is decided by it is checked exactly afterwards.
    """

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b.column("vec"), dim)
            norm = np.linalg.norm(s, axis=1, keepdims=True)
            x = s / norm
            w = pa.array(norm[:, 0].astype(float) / b.column("n").to_numpy())
            small = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
            x = _directions(small)
            cells = np.stack([(g + 1) * _RADIX + quantised(x, first + g) for g in range(grids)], 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("period"), b.column("unit"), w, pa.array([r.tobytes() for r in small], pa.binary()), pa.array(list(cells), pa.list_(pa.int64()))], ["period", "unit", "w", "vec", "cells"])

    return units.select("period", "unit", "n", "vec").mapInArrow(code, "period string, unit string, w double, vec binary, cells array<long>")


def _directions(small: np.ndarray) -> np.ndarray:
    x = small.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _divided(k: int):
    """The cells of a unit with those among ``some`` cut by one more rotation."""

    @F.pandas_udf("array<long>")
    def divide(vec: pd.Series, cells: pd.Series, some: pd.Series) -> pd.Series:
        sub = quantised(_directions(np.stack([np.frombuffer(v, np.int8) for v in vec])), k)
        return pd.Series([[c * _RADIX + q + 1 if c in f else c for c in map(int, own)] for own, f, q in zip(cells, map(set, some), sub.tolist())])

    return divide


def _placed(units: DataFrame, first: int, grids: int, dim: int, most: int | None = None) -> DataFrame:
    """The cells of all units, dealt to partitions by cell and sorted; cells of more than ``most`` rows are divided first.

    The full cells stay a table that is joined to their units, so nothing about them reaches the driver. What still shares
    a cell after DEPTH divisions has all but one direction; such rows are dealt to blocks of half a cell, and every two
    blocks make a cell of their own, so all rows of the full cell meet.
    """
    most = max(2, most or CELL_ROWS)
    coded = cut(_coded(units, first, grids, dim))
    for depth in range(DEPTH + 1):
        single = coded.select("period", "unit", F.explode("cells").alias("cell"))
        full = cut(single.groupBy("period", "cell").count().where(F.col("count") > most))
        hot = not full.isEmpty()
        if not hot or depth == DEPTH:
            break

        inside = single.join(full, ["period", "cell"]).groupBy("period", "unit").agg(F.collect_list("cell").alias("some"))  # at most one cell a rotation
        both = coded.join(inside, ["period", "unit"], "left")
        coded = cut(both.withColumn("cells", F.when(F.col("some").isNull(), F.col("cells")).otherwise(_divided(first + 500 + depth)("vec", "cells", F.coalesce("some", F.array().cast("array<long>"))))).drop("some"))
    placed = coded.select("period", F.explode("cells").alias("cell"), "unit", "w", "vec")
    if hot:
        met = _meeting(placed.join(full, ["period", "cell"], "left").withColumn("blocks", F.ceil(2 * F.coalesce("count", F.lit(0)) / most)), False)
        # two cells of one number would only be searched together
        placed = met.select("period", F.when(F.col("count").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "low", "high")).alias("cell"), "unit", "w", "vec")
    return spread(placed, "period", "cell").sortWithinPartitions("cell", "period", "unit")


def _meeting(rows: DataFrame, itself: bool) -> DataFrame:
    """Every row once for each block it meets: ``low`` and ``high`` are the two blocks, ``block`` is its own of ``blocks``.

    An only block meets itself; where there are several, ``itself`` says whether each does or only meets the others.
    """
    own = rows.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("unit", F.lit(7)), F.col("blocks"))).otherwise(F.lit(0).cast("long")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("blocks"), F.lit(1)).cast("long") - 1)))
    return met.where(F.lit(itself) | (F.col("blocks") <= 1) | (F.col("other") != F.col("block"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def _by_cell(placed: DataFrame, work, schema: str, dim: int, most: int | None = None) -> DataFrame:
    """``work(name, units, w, directions) -> dict of columns`` over every dense cell, whole unless ``most`` rows are asked for.

    A block of ``most`` begins with the last row of the block before it in the same cell. A partition is read as a stream
    of sorted cells; no more than one cell or block and one batch are held. Where cells are bounded by ``_placed`` they are
    read whole: blocks that share one row do not compare the others.
    """
    most = max(2, most) if most else float("inf")
    fields = [c.split(" ")[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "double": pa.float64()}
    kinds = [types[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches):
        held, last, block = None, None, 0
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            out, held, last, block = cut_runs(t, last, block, False)
            if out is not None:
                yield out
        if held is not None and held.num_rows:
            out, *_ = cut_runs(held, last, block, True)
            if out is not None:
                yield out

    def cut_runs(t, last, block, end):
        n = t.num_rows
        key = [f"{p}|{c}" for p, c in zip(t["period"].to_pylist(), t["cell"].to_pylist())]
        unit = np.array(t["unit"].to_pylist(), object)
        w = t["w"].to_numpy()
        x = _directions(np.frombuffer(b"".join(t["vec"].to_pylist()), np.int8).reshape(n, dim))
        parts: dict[str, list] = {f: [] for f in fields}
        a = 0
        while a < n:
            z = a + 1
            while z < n and key[z] == key[a] and z - a < most:
                z += 1
            if z == n and not end and z - a < most:
                break  # the block may go on in the next batch
            block = block + 1 if key[a] == last else 0
            last = key[a]
            if z - a >= DENSE:
                got = work(f"{key[a]}|{block}", unit[a:z], w[a:z], x[a:z])
                for f in fields:
                    parts[f].extend(got[f])
            more = z - a == most and (z == n or key[z] == key[a])
            a = z - 1 if more else z
            if more and z == n:  # only the shared row is left of what was read
                break
        out = pa.RecordBatch.from_arrays([pa.array(parts[f], k) for f, k in zip(fields, kinds)], fields) if parts[fields[0]] else None
        return out, t.slice(a), last, block

    return placed.mapInArrow(run, schema)


def _label(pairs: DataFrame) -> DataFrame:
    """unit, label: minimum labels propagated over unit-cell edges (unit, cell) to convergence."""
    pairs = cut(pairs)
    labels = cut(pairs.groupBy("unit").agg(F.min("unit").alias("label")))
    while True:
        of_cell = pairs.join(labels, "unit").groupBy("star").agg(F.min("label").alias("low"))
        low = pairs.join(of_cell, "star").groupBy("unit").agg(F.min("low").alias("low"))
        # pointer jumping halves the remaining distance
        near = labels.join(low, "unit").select("unit", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        far = near.join(near.select(F.col("unit").alias("label"), F.col("label").alias("next")), "label", "left")
        new = cut(far.select("unit", F.coalesce("next", "label").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("unit", "label")
        labels = new.select("unit", "label")


def _linked(placed: DataFrame, dim: int, link: float) -> DataFrame:
    """unit, star: the members of every group of directly linked rows of a dense cell, named by cell and first member."""

    def one(name, unit, w, x):
        near = x @ x.T >= link
        label = np.arange(len(unit))
        while True:
            new = np.where(near, label[None, :], len(unit)).min(1)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        keep = np.bincount(label, minlength=len(unit))[label] > 1
        return {"unit": unit[keep].tolist(), "star": [f"{name}|{i}" for i in label[keep]]}

    return _by_cell(placed, one, "unit string, star string", dim)


def _summed(members: DataFrame, dim: int) -> DataFrame:
    """period, unit (label), n, vec: sizes and vector sums of groups, added up inside every batch before the shuffle."""
    schema = "period string, unit string, n long, vec binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf.vec), np.float32).reshape(len(pdf), dim).astype(np.float64)
        code, names = pd.factorize(pdf.unit)
        sums = np.zeros((len(names), dim))
        np.add.at(sums, code, x)
        first = pd.Series(pdf.period.to_numpy()).groupby(code).first()
        n = np.bincount(code, weights=pdf.n.to_numpy(float)).astype(np.int64)
        return pd.DataFrame({"period": pd.Series(first.to_numpy(object), dtype=object), "unit": pd.Series(np.asarray(names, object), dtype=object), "n": n, "vec": [r.tobytes() for r in sums.astype(np.float32)]})

    def part(batches):
        for pdf in batches:
            if len(pdf):
                yield add(pdf)

    def total(batches):
        held = None
        for pdf in batches:
            sums = add(pdf if held is None else pd.concat([held, pdf], ignore_index=True)) if len(pdf) else held
            if sums is None:
                continue
            held = sums.iloc[-1:]
            if len(sums) > 1:
                yield sums.iloc[:-1]
        if held is not None:
            yield held

    partial = members.select("period", "unit", "n", "vec").mapInPandas(part, schema)
    return spread(partial, "unit").sortWithinPartitions("unit").mapInPandas(total, schema)


def _alike(a: np.ndarray, b: np.ndarray | None, limit: float):
    """(first row of ``a``, first row of ``b``, cosines) of the rows of ``a`` against those of ``b``, some at a time; below ``limit`` it is -2.

    Without ``b`` the rows of ``a`` are compared with those after them. What lies too near to the limit for single
    precision is computed in double. Stretches without any pair are left out.
    """
    other, p = a if b is None else b, 0
    while p < len(a):
        start = p if b is None else 0
        q = min(len(a), p + max(1, HELD // max(1, len(other) - start)))
        s = a[p:q] @ other[start:].T
        if b is None:
            s[np.tril_indices(q - p)] = -2
        if s.size and s.max() >= limit - SLACK:
            i, j = np.nonzero(np.abs(s - np.float32(limit)) < SLACK)
            for k in range(0, len(i), 10_000):
                u, v = i[k : k + 10_000], j[k : k + 10_000]
                exact = np.einsum("ij,ij->i", a[p + u].astype(float), other[start + v].astype(float))
                s[u, v] = np.where(exact >= limit, np.maximum(s[u, v], np.float32(limit)), -2)
            s[s < limit - SLACK] = -2
            yield p, start, s
        p = q


def _nearest(a: np.ndarray, b: np.ndarray | None, limit: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the best partner, its cosine) of every row of ``a`` in ``b``, and of ``b`` in ``a``; of equal partners the first counts."""
    at, best = np.zeros(len(a), int), np.full(len(a), -2, np.float32)
    at_b, best_b = (at, best) if b is None else (np.zeros(len(b), int), np.full(len(b), -2, np.float32))

    def better(at, best, first, found, value):
        rows = first + np.flatnonzero(value > best[first : first + len(value)])
        at[rows], best[rows] = found[rows - first], value[rows - first]

    for p, start, s in _alike(a, b, limit):
        better(at, best, p, start + s.argmax(1), s.max(1))  # without b what came before was seen as a column
        better(at_b, best_b, start, p + s.argmax(0), s.max(0))
    return [(at, best)] if b is None else [(at, best), (at_b, best_b)]


def _connected(a: np.ndarray, b: np.ndarray | None, limit: float) -> np.ndarray:
    """The first row connected with each row of ``a`` and then ``b`` by pairs of which the cosine reaches ``limit``."""
    root = np.arange(len(a) + (0 if b is None else len(b)))
    for p, start, s in _alike(a, b, limit):
        i, j = np.nonzero(s > -2)
        i, j = i + p, j + start + (0 if b is None else len(a))
        while True:
            u, v = root[i], root[j]
            apart = u != v
            if not apart.any():
                break
            i, j, u, v = i[apart], j[apart], u[apart], v[apart]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]
    return root


def _in_blocks(groups: DataFrame, work, schema: str, dim: int, most: int | None = None) -> DataFrame:
    """``work(units, mean vectors, whether of the first block) -> columns`` over every two blocks of a period and every block by itself.

    So every pair of groups is seen in one task, and only there. Units are sorted from the last name to the first.
    """
    count = groups.groupBy("period").agg(F.count(F.lit(1)).alias("rows"))
    met = _meeting(groups.join(F.broadcast(count), "period").withColumn("blocks", F.ceil(F.col("rows") / (most or BLOCK_ROWS))), True)  # a row a period

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("unit", "descending")])
        x = _matrix(t["vec"], dim) / t["n"].to_numpy()[:, None].astype(np.float32)
        first = t["block"].to_numpy() == t["low"].to_numpy()
        return pa.table(work(np.array(t["unit"].to_pylist(), object), x, first))

    dealt = spread(met.select("period", "low", "high", "block", "unit", "n", "vec"), "period", "low", "high")
    return dealt.groupBy("period", "low", "high").applyInArrow(one, schema)


def _parts(groups: DataFrame, dim: int, limit: float) -> DataFrame:
    """unit, label: the groups with any partner at ``limit`` or more, by the part that such pairs connect."""

    def one(unit, x, first):
        whole = first.all() or not first.any()
        names = unit if whole else np.concatenate([unit[first], unit[~first]])
        root = _connected(x, None, limit) if whole else _connected(x[first], x[~first], limit)
        keep = np.bincount(root, minlength=len(root))[root] > 1
        return {"unit": pa.array(names[keep].tolist(), pa.string()), "star": pa.array(names[root[keep]].tolist(), pa.string())}

    return _label(_in_blocks(groups, one, "unit string, star string", dim))


def _best_partners(groups: DataFrame, dim: int, limit: float) -> DataFrame:
    """unit, other: the best partner of every group that has one of its period at a mean cosine of ``limit`` or more.

    Of equal partners the greatest name counts, for both sides: the pair of the largest mean cosine is always mutual.
    """

    def one(unit, x, first):
        if first.all() or not first.any():
            sides = [(unit, unit, *_nearest(x, None, limit)[0])]
        else:
            a, b = _nearest(x[first], x[~first], limit)
            sides = [(unit[first], unit[~first], *a), (unit[~first], unit[first], *b)]
        kept = [(own[best > -2], partner[at[best > -2]], best[best > -2]) for own, partner, at, best in sides]
        columns = [np.concatenate(c).tolist() for c in zip(*kept)]
        return {k: pa.array(c, t) for k, c, t in zip(("unit", "other", "sim"), columns, (pa.string(), pa.string(), pa.float64()))}

    found = _in_blocks(groups, one, "unit string, other string, sim double", dim)
    return found.groupBy("unit").agg(F.max(F.struct("sim", "other")).alias("b")).select("unit", F.col("b.other").alias("other"))


def _merged_into(sums: np.ndarray, n: np.ndarray, limit: float) -> np.ndarray:
    """The row that stands for each row after mutual best partners have been merged until no mean cosine reaches ``limit``.

    A chain of nearest neighbours ends in a mutual pair; what it merges is what merging the best pair of all first would.
    """
    sums, n = sums.astype(float), n.astype(float)
    mean, into = sums / n[:, None], np.arange(len(n))
    left, chain = list(range(len(n) - 1, -1, -1)), []
    done = np.zeros(len(n), bool)
    while left:
        if not chain:
            if done[left[-1]]:
                left.pop()
                continue
            chain.append(left[-1])
        top = chain[-1]
        s = mean @ mean[top]
        s[top] = -2
        s[done] = -2
        best = int(s.argmax())
        if len(chain) > 1 and s[chain[-2]] >= s[best] - 1e-12:
            best = chain[-2]
        if s[best] < limit:  # no later group will be nearer
            done[top] = True
            chain.pop()
        elif len(chain) > 1 and best == chain[-2]:
            keep, gone = min(top, best), max(top, best)
            sums[keep] += sums[gone]
            n[keep] += n[gone]
            mean[keep] = sums[keep] / n[keep]
            into[gone], done[gone] = keep, True
            del chain[-2:]
        else:
            chain.append(best)
    while (into[into] != into).any():
        into = into[into]
    return into


def _closed(groups: DataFrame, dim: int, limit: float) -> DataFrame:
    """unit, to: what the groups of each part (``label``) are merged into, where that is another."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("unit")
        into = _merged_into(_matrix(t["vec"], dim), t["n"].to_numpy(), limit)
        unit, keep = np.array(t["unit"].to_pylist(), object), into != np.arange(len(into))
        return pa.table({"unit": pa.array(unit[keep].tolist(), pa.string()), "to": pa.array(unit[into[keep]].tolist(), pa.string())})

    return spread(groups.select("label", "unit", "n", "vec"), "label").groupBy("label").applyInArrow(one, "unit string, to string")


def _renamed(member: DataFrame, renamed: DataFrame) -> DataFrame:
    return cut(member.join(renamed.withColumnRenamed("unit", "label"), "label", "left").select("unit", F.coalesce("to", "label").alias("label")))


def assign(rows: DataFrame, dim: int = DIM, limit: float = LIMIT, link: float = LINK) -> DataFrame:
    """id, period, visitor, cluster of every row of ``candidates``; a row like no other is a cluster of its own.

    Clusters never cross periods. No rows give no rows.
    """
    rows = cut(rows.withColumn("unit", F.substring(F.base64(F.unhex(F.sha2(F.concat_ws(":", "period", F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(1), "embedding"))), 256))), 1, 24)))
    copies = spread(rows.groupBy("period", "unit").agg(F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "unit")
    singles = cut(copies.select("period", "unit", "n", _unit(F.col("embedding")).alias("vec")))
    stars = _linked(_placed(singles, 0, GRIDS, dim), dim, link)
    labels = _label(stars)
    weigh = F.udf(lambda v, n: (np.frombuffer(v, np.float32) * n).tobytes(), "binary")
    weighted = singles.withColumn("vec", F.when(F.col("n") > 1, weigh("vec", "n")).otherwise(F.col("vec")))
    member = cut(singles.select("unit").join(labels, "unit", "left").select("unit", F.coalesce("label", "unit").alias("label")))
    groups = cut(_summed(weighted.join(member, "unit").drop("unit").withColumnRenamed("label", "unit"), dim))
    # Two groups reach the limit only if parts of them do, so a group that has no partner at the limit will never have one:
    # it is settled and no longer compared.
    while True:
        parts = _parts(groups, dim, limit)
        size = parts.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
        groups = cut(groups.join(parts, "unit").join(size, "label"))
        if groups.isEmpty():
            break
        member = _renamed(member, _closed(groups.where(F.col("rows") <= PART_ROWS), dim, limit))
        groups = groups.where(F.col("rows") > PART_ROWS).select("period", "unit", "n", "vec")
        if groups.isEmpty():
            break
        best = cut(_best_partners(groups, dim, limit))
        merge = best.join(best.select(F.col("other").alias("unit"), F.col("unit").alias("other")), ["unit", "other"]).where("unit < other")
        renamed = cut(merge.select(F.col("other").alias("unit"), F.col("unit").alias("to")))
        groups = cut(_summed(groups.join(renamed, "unit", "left").withColumn("unit", F.coalesce("to", "unit")).drop("to"), dim))
        member = _renamed(member, renamed)
    return rows.join(member, "unit").select("id", "period", "visitor", "embedding", "unit", F.col("label").alias("cluster"))


def described(rows: DataFrame, typical: int = 3, dim: int = DIM) -> DataFrame:
    """cluster, period, size, distinct_visitors, typical: of every cluster of two or more; its chunk ids are in p1_membership.

    ``typical`` are the members nearest to the middle of the cluster's densest cell, the cell of one rotation with the
    most members: those of the largest cosine to the sum of the unit vectors there; ties by id.
    """

    @F.pandas_udf("int")
    def cell(e: pd.Series) -> pd.Series:
        x = np.stack(e.values).astype(np.float64)
        return pd.Series(quantised((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 0))

    @F.pandas_udf("double")
    def closeness(e: pd.Series, middle: pd.Series) -> pd.Series:
        x = np.stack(e.values).astype(np.float64)
        m = np.stack([np.frombuffer(b, np.float32) for b in middle]).astype(np.float64)
        cosine = (x * m).sum(1) / (np.linalg.norm(x, axis=1) * np.maximum(np.linalg.norm(m, axis=1), 1e-300))
        return pd.Series(cosine.round(9))

    placed = cut(rows.withColumn("cell", cell("embedding")))
    size = rows.groupBy("cluster", "period").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("visitor").alias("distinct_visitors")).where("size > 1")
    full = placed.groupBy("cluster", "cell").agg(F.count(F.lit(1)).alias("members"))
    densest = full.groupBy("cluster").agg(F.max(F.struct("members", "cell")).alias("m")).select("cluster", F.col("m.cell").alias("cell"))
    there = placed.join(size.select("cluster"), "cluster", "left_semi").join(densest, ["cluster", "cell"])
    vectors = there.select("period", F.col("cluster").alias("unit"), F.lit(1).cast("long").alias("n"), _unit(F.col("embedding")).alias("vec"))
    middle = _summed(vectors, dim).select(F.col("unit").alias("cluster"), F.col("vec").alias("middle"))
    first = Window.partitionBy("cluster").orderBy(F.desc("close"), "id")
    chosen = there.join(middle, "cluster").select("cluster", "id", closeness("embedding", "middle").alias("close")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= typical)
    names = chosen.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("typical"))
    return size.join(names, "cluster").select("cluster", "period", "size", "distinct_visitors", "typical")


def p1_found(spark, d):
    rows = assign(candidates(table(spark, d, "review_chunks"))).select("id", "cluster")
    a, b = rows.withColumnRenamed("id", "chunk_id_a"), rows.withColumnRenamed("id", "chunk_id_b")
    return a.join(b, "cluster").where("chunk_id_a < chunk_id_b").select("chunk_id_a", "chunk_id_b")


def p1_membership(spark, d):
    """id, period, cluster of every chunk in a cluster of two or more."""
    rows = assign(candidates(table(spark, d, "review_chunks")))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("cluster"))).where("size > 1").select("id", "period", "cluster")


def p1_clusters(spark, d):
    return described(cut(assign(candidates(table(spark, d, "review_chunks")))))


QUERIES = {"p1_found": p1_found, "p1_membership": p1_membership, "p1_clusters": p1_clusters}
ORACLE: dict[str, str] = {}
