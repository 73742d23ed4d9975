"""Samples whose category shares follow a plan (problem 4).

One pass keeps, per category, a mergeable reservoir: the rows with the smallest keyed hashes. Two reservoirs of a
category merge by keeping the smallest of both, so partitions (and salts of a hot category) are reduced on their own
before anything moves. After the final counts each reservoir is trimmed to its feasible quota; the smallest hashes of a
uniform sample are again a uniform sample.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.tables import table, unique

#: Salts of a category in the first reduction of its reservoir.
SALTS = 32
#: Different category fields of all plans; more are an error, none is left out.
MAX_FIELDS = 256


def plain_lang(c: Column) -> Column:
    """Trimmed, lower case, region cut: `` EN-gb `` is ``en``; blank is null."""
    short = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[-_].*$", "")
    return F.when(short != "", short)


def field_value(df: DataFrame, field: str) -> Column:
    """The category of a row for ``lang``, ``flags.x`` or several joined by ``|``; null where any part is missing."""
    parts = []
    for name in field.split("|"):
        if name == "lang":
            parts.append(plain_lang(F.col("lang")))
        elif name == "flags.negation":
            parts.append(F.when(F.col("flags").isNotNull(), F.coalesce(F.col("flags.negation"), F.lit("none"))))
        else:
            parts.append(F.col(name).cast("string"))
    if len(parts) == 1:
        return parts[0]
    whole = F.concat_ws("|", *parts)
    ok = parts[0].isNotNull()
    for p in parts[1:]:
        ok &= p.isNotNull()
    return F.when(ok, whole)


def categories(feedback: DataFrame, fields: list[str]) -> DataFrame:
    """id, category_field, category_value of every distinct feedback id; several fields of a row give several rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("category_field"), field_value(feedback, f).alias("category_value")) for f in fields])
    return unique(feedback.select("id", "lang", "flags"), "id").select("id", F.explode(pairs).alias("c")).select("id", "c.*").where("category_value IS NOT NULL")


def quotas(targets: DataFrame) -> DataFrame:
    """Rows wanted of each category: the greater of min_rows and its share of sample_size, rounded up."""
    share = F.expr("CAST((CAST(target_pct AS BIGINT) * sample_size + 99) DIV 100 AS BIGINT)")
    return targets.where("plan_id IS NOT NULL AND category_field IS NOT NULL AND category_value IS NOT NULL").dropDuplicates(
        ["plan_id", "category_field", "category_value"]
    ).select("plan_id", "category_field", "category_value", F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), F.coalesce(share, F.lit(0))).alias("wanted"))


def reservoirs(cats: DataFrame, sizes: DataFrame, seed: int = 17) -> DataFrame:
    """Per category the ``keep`` rows of smallest keyed hash, with their position.

    One pass over each partition keeps a reservoir of every category, and only those are dealt; salts merge them first,
    then categories. What a partition holds is one batch and its reservoirs, and what moves at most all reservoirs.
    """
    keyed = cats.join(F.broadcast(sizes), ["category_field", "category_value"]).withColumn("draw", F.xxhash64("id", F.lit(seed)))
    key = ["category_field", "category_value"]

    def smallest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, "draw", "id"], kind="stable")
        return pdf[pdf.groupby(key).cumcount() < pdf.keep]

    def part(batches):
        held = None
        for pdf in batches:
            held = smallest(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
        if held is not None:
            yield held

    part_of = keyed.mapInPandas(part, StructType([StructField(f.name, f.dataType) for f in keyed.schema]))
    salted = Window.partitionBy(*key, F.pmod("draw", F.lit(SALTS))).orderBy("draw", "id")
    merged = Window.partitionBy(*key).orderBy("draw", "id")
    few = part_of.withColumn("place", F.row_number().over(salted)).where("place <= keep")
    return few.withColumn("place", F.row_number().over(merged)).where("place <= keep").select("id", *key, "place")


def _prepared(feedback: DataFrame, targets: DataFrame):
    want = quotas(targets)
    # the plan table is fixed and tiny; its distinct field names shape the plan, not the data
    fields = sorted(r[0] for r in want.select("category_field").distinct().limit(MAX_FIELDS + 1).collect())
    if len(fields) > MAX_FIELDS:
        raise ValueError(f"plans of more than {MAX_FIELDS} different fields")
    return want, categories(feedback, fields or ["lang"])


def sample(feedback: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """plan_id, category_value, id: the drawn rows.

    Exact copies count once; rows with null lang or flags are in no category of a plan using them; an empty table gives
    no rows; a category with too few rows gives all it has.
    """
    want, cats = _prepared(feedback, targets)
    sizes = want.groupBy("category_field", "category_value").agg(F.max("wanted").alias("keep"))
    kept = reservoirs(cats, sizes, seed)
    return kept.join(F.broadcast(want), ["category_field", "category_value"]).where("place <= wanted").select("plan_id", "category_value", "id")


def report(feedback: DataFrame, targets: DataFrame) -> DataFrame:
    """plan_id, category_value, wanted, available, quota, missing of every category of every plan."""
    want, cats = _prepared(feedback, targets)
    counts = cats.groupBy("category_field", "category_value").agg(F.count(F.lit(1)).alias("available"))
    both = want.join(counts, ["category_field", "category_value"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return both.select("plan_id", "category_value", "wanted", "available", F.least("wanted", "available").alias("quota"), F.greatest(F.lit(0), F.col("wanted") - F.col("available")).alias("missing"))


def _tables(spark, d):
    return table(spark, d, "feedback"), table(spark, d, "sample_targets")


def p4_found(spark, d):
    """Categories that cannot be filled, read off the drawn sample's own counts."""
    f, t = _tables(spark, d)
    want, _ = _prepared(f, t)
    drawn = sample(f, t).groupBy("plan_id", "category_value").agg(F.count(F.lit(1)).alias("n"))
    return want.join(drawn, ["plan_id", "category_value"], "left").where(F.coalesce("n", F.lit(0)) < F.col("wanted")).select("plan_id", "category_value")


def p4_sample(spark, d):
    return sample(*_tables(spark, d))


def p4_report(spark, d):
    return report(*_tables(spark, d))


QUERIES = {"p4_found": p4_found, "p4_sample": p4_sample, "p4_report": p4_report}

_COUNTS = r"""
WITH f AS (SELECT DISTINCT ON (id) id, nullif(regexp_replace(lower(trim(lang, E' \t\n\r ')), '[-_].*$', ''), '') AS lang, flags FROM feedback WHERE id IS NOT NULL),
c AS (
  SELECT id, 'lang' AS category_field, lang AS category_value FROM f
  UNION ALL SELECT id, 'flags.length_class', flags.length_class FROM f
  UNION ALL SELECT id, 'flags.negation', CASE WHEN flags IS NOT NULL THEN coalesce(flags.negation, 'none') END FROM f
  UNION ALL SELECT id, 'flags.off_list', CAST(flags.off_list AS VARCHAR) FROM f
  UNION ALL SELECT id, 'flags.ambiguous', CAST(flags.ambiguous AS VARCHAR) FROM f
  UNION ALL SELECT id, 'flags.picking', CAST(flags.picking AS VARCHAR) FROM f
  UNION ALL SELECT id, 'lang|flags.length_class', lang || '|' || flags.length_class FROM f),
n AS (SELECT category_field, category_value, count(*) AS available FROM c GROUP BY ALL),
w AS (SELECT DISTINCT plan_id, category_field, category_value, greatest(min_rows, (target_pct * sample_size + 99) // 100)::BIGINT AS wanted FROM sample_targets),
r AS (SELECT plan_id, category_value, wanted, coalesce(available, 0)::BIGINT AS available FROM w LEFT JOIN n USING (category_field, category_value))
"""
ORACLE = {
    "p4_found": _COUNTS + "SELECT plan_id, category_value FROM r WHERE available < wanted",
    "p4_report": _COUNTS + "SELECT plan_id, category_value, wanted, available, least(wanted, available) AS quota, greatest(0, wanted - available)::BIGINT AS missing FROM r",
}
