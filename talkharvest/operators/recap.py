"""Monthly recaps of a farm and the aggregate of a cooperative (AGG4 to AGG7, WIN1, WIN2, REC1, REC2, SORT3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fill_slots

# fixed values of this project: the lines of a recap
TEMPLATES = {
    "volume": "Messages this month: {n}",
    "keep": "Keep: {f} ({n})",
    "fix": "To improve: {f} ({n})",
    "fix_streak": "Again, {n} months in a row: {f}",
    "nothing_urgent": "Nothing urgent",
    "unknown_topic": "A topic of its own, raised by {n} visitors",
    "not_understood": "Not understood: {n}",
    "no_feedback": "No feedback this month",
}


def counted(messages: DataFrame) -> DataFrame:
    """DEC7: neither duplicate nor inaudible; rows without farm or month belong to no recap."""
    return messages.where("status NOT IN ('duplicate', 'inaudible') AND farm_id IS NOT NULL AND visit_month IS NOT NULL")


def counts(messages: DataFrame) -> DataFrame:
    """farm_id, visit_month, finding, k: messages that cite a finding, each once."""
    m = counted(messages).select("farm_id", "visit_month", "message_id", F.explode(F.array_distinct(F.transform("findings", lambda f: f["id"]))).alias("finding"))
    return m.groupBy("farm_id", "visit_month", "finding").agg(F.countDistinct("message_id").alias("k"))


def volume(messages: DataFrame) -> DataFrame:
    """farm_id, visit_month, n messages, p remarks not understood."""
    return counted(messages).groupBy("farm_id", "visit_month").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0), F.coalesce("not_sure_count", F.lit(0)))).alias("p"))


def streaks(k: DataFrame) -> DataFrame:
    """WIN1: how many months in a row, up to this one, a finding has been cited (gaps and islands)."""
    index = F.substring("visit_month", 1, 4).cast("int") * 12 + F.substring("visit_month", 6, 2).cast("int")
    w = Window.partitionBy("farm_id", "finding").orderBy("idx")
    i = k.withColumn("idx", index).withColumn("island", F.col("idx") - F.row_number().over(w))
    run = Window.partitionBy("farm_id", "finding", "island").orderBy("idx")
    return i.withColumn("streak", F.row_number().over(run)).select("farm_id", "finding", "visit_month", "k", "streak")


def keep_fix(messages: DataFrame, findings: DataFrame) -> DataFrame:
    """WIN2: the top positive, and the top negative with two mentions or a streak of two; count, streak, catalogue order."""
    f = F.broadcast(findings.select(F.col("finding_id").alias("finding"), "polarity", "ordinal"))  # the fixed catalogue
    s = streaks(counts(messages)).join(f, "finding").where("polarity = 'positive' OR k >= 2 OR streak >= 2")
    w = Window.partitionBy("farm_id", "visit_month", "polarity").orderBy(F.desc("k"), F.desc("streak"), "ordinal")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select("farm_id", "visit_month", "polarity", "finding", "k", "streak")


def months_of(messages: DataFrame) -> list[str]:
    """All stored months, in order: as many as the calendar has."""
    return sorted(r[0] for r in messages.where("visit_month IS NOT NULL").select("visit_month").distinct().collect())


def lines(messages: DataFrame, findings: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """REC1/REC2: at most five rendered lines of every farm and stored month; a month without messages has one line.

    ``unknown`` (farm_id, visit_month, k) tells how many visitors the largest recurring unknown topic has. Numbers in lines
    that are negative are an error.
    """
    v, kf = volume(messages), keep_fix(messages, findings)
    months = months_of(messages)
    every = messages.where("farm_id IS NOT NULL").select("farm_id").distinct().withColumn("visit_month", F.explode(F.array(*map(F.lit, months)).cast("array<string>")))
    quiet = every.join(v, ["farm_id", "visit_month"], "left_anti")
    none = F.lit(None).cast("string")
    row = lambda df, no, template, finding, value: df.select("farm_id", "visit_month", F.lit(no).alias("line_no"), template.alias("template"), finding.alias("finding"), value.cast("long").alias("value"))
    bad = kf.where("polarity = 'negative'").select("farm_id", "visit_month", "finding", "k", "streak")
    fix = v.join(bad, ["farm_id", "visit_month"], "left")
    kind = F.when(F.col("finding").isNull(), "nothing_urgent").when(F.col("streak") >= 2, "fix_streak").otherwise("fix")
    value = F.when(F.col("streak") >= 2, F.col("streak").cast("long")).otherwise(F.col("k"))
    out = (
        row(v, 1, F.lit("volume"), none, F.col("n"))
        .unionByName(row(kf.where("polarity = 'positive'"), 2, F.lit("keep"), F.col("finding"), F.col("k")))
        .unionByName(row(fix, 3, kind, F.col("finding"), value))
        .unionByName(row(v.where("p > 0"), 5, F.lit("not_understood"), none, F.col("p")))
        .unionByName(row(quiet, 1, F.lit("no_feedback"), none, none))
    )
    if unknown is not None:
        out = out.unionByName(row(unknown.where("k > 0").join(v, ["farm_id", "visit_month"], "left_semi"), 4, F.lit("unknown_topic"), none, F.col("k")))
    out = out.withColumn("value", F.when(F.col("value") < 0, F.raise_error(F.lit("a recap counts no less than 0")).cast("long")).otherwise(F.col("value")))
    named = out.join(F.broadcast(findings.select(F.col("finding_id").alias("finding"), "label_en")), "finding", "left")
    text = F.coalesce(*[F.when(F.col("template") == k, F.lit(t)) for k, t in TEMPLATES.items()])
    return named.withColumn("text", fill_slots(text, {"n": F.col("value"), "f": F.col("label_en")})).drop("label_en")


def cooperative(messages: DataFrame, farms: DataFrame, findings: DataFrame, months: list[str] | None = None) -> DataFrame:
    """AGG6/SORT3: finding, farms, mentions over consenting farms, with the number of all consenting ones; most farms first.

    ``months`` keeps only those months; all by default.
    """
    messages = messages if months is None else messages.where(F.col("visit_month").isin(months))
    ok = farms.where("consent").select("farm_id")
    total = farms.agg(F.count_if(F.col("consent")).alias("consenting"))
    m = messages.where("status NOT IN ('duplicate', 'inaudible')").join(F.broadcast(ok), "farm_id").select("farm_id", "message_id", F.explode("coop_findings").alias("finding"))
    m = m.join(F.broadcast(findings.select(F.col("finding_id").alias("finding"), "ordinal")), "finding")  # the fixed catalogue
    g = m.groupBy("finding", "ordinal").agg(F.countDistinct("farm_id").alias("farms"), F.countDistinct("message_id").alias("mentions"))
    return g.join(F.broadcast(total)).orderBy(F.desc("farms"), F.desc("mentions"), "ordinal").drop("ordinal")  # one row of totals
