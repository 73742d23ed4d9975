"""SRC1 to SRC13: readers and writers of the engine's own tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEEDBACK = """id string, lang string, text string, synthetic boolean, expectedFindings array<string>, mustNotFindings array<string>,
 chunks array<struct<span:string,kind:string,finding:string,negates:string,topic:string>>,
 flags struct<negation:string,multiFinding:boolean,typo:boolean,length:string,offList:boolean,offListTopics:array<string>,ambiguous:boolean,picking:boolean,mentionsGuide:boolean>"""
CATALOGUE = """schemaVersion int, version string, languages array<string>,
 findings array<struct<id:string,polarity:string,labels:map<string,string>,examples:map<string,array<string>>,keywords:map<string,array<string>>>>,
 templates array<struct<id:string,slots:array<string>>>"""
KEYWORD_FILE = "lang string, findings map<string,array<string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1. Blank lines are no rows; a broken line gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """SRC2. One document over several lines; a missing optional one gives no rows."""
    jvm = spark.sparkContext._jvm
    if optional:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def catalogue_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC3/SRC5/VEC8: findings, examples and keywords of a catalogue document."""
    f = doc.select(F.posexplode("findings").alias("ordinal", "f")).select("ordinal", "f.*")
    long = lambda c, name: f.select(F.col("id").alias("finding"), F.explode(c).alias("lang", "all")).select("finding", "lang", F.explode("all").alias(name))
    return f.select(F.col("id").alias("finding_id"), "polarity", "labels", (F.col("ordinal") + 1).alias("ordinal")), long("examples", "text"), long("keywords", "term")


def catalogue_faults(doc: DataFrame) -> DataFrame:
    """SRC3: fault, finding of every broken rule; a valid catalogue has no rows."""
    f, e, _ = catalogue_tables(doc)
    twice = f.groupBy("finding_id").count().where("count > 1").select(F.lit("repeated id").alias("fault"), "finding_id")
    sign = f.where(F.when(F.col("polarity") == "positive", ~F.col("finding_id").startswith("P")).otherwise(~F.col("finding_id").startswith("N"))).select(F.lit("polarity against id").alias("fault"), "finding_id")
    few = f.join(e.groupBy(F.col("finding").alias("finding_id")).count(), "finding_id", "left").where("coalesce(count, 0) = 0").select(F.lit("no example").alias("fault"), "finding_id")
    return twice.unionByName(sign).unionByName(few)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: finding, lang, term of a folder of keyword files, terms of all files appended."""
    k = read_json(spark, path, KEYWORD_FILE)
    return k.select("lang", F.explode("findings").alias("finding", "terms")).select("finding", "lang", F.explode("terms").alias("term")).distinct()


def intake(rows: DataFrame) -> DataFrame:
    """SRC6/SRC7: what may enter the queue: text that is not just a URL. Scrub with functions.pii before any sink."""
    return rows.where(F.col("text").isNotNull() & ~F.col("text").rlike(r"^\s*https?://\S+\s*$"))


def write_by_month(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SRC8: a store whose months are partitions, so that a month's scan reads one folder."""
    df.write.mode(mode).partitionBy("visit_month").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC9: rows of ``new`` replace those of ``old`` with the same key; writing it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SRC10: delete by key."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def settings(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """SRC11: name, value: the last value of each setting; null deletes, missing ones take their default."""
    spark = rows.sparkSession
    last = rows.groupBy("name").agg(F.max_by("value", "seq").alias("value"))
    base = spark.createDataFrame(sorted(defaults.items()), "name string, base string")
    return base.join(last, "name", "full").select("name", F.coalesce("value", "base").alias("value")).where("value IS NOT NULL")


def cached(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """SRC12: the last row written of each key of an append-only cache."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_json(df: DataFrame, path: str) -> None:
    """SRC12: JSON lines without float arrays."""
    df.select([f.name for f in df.schema if f.dataType.simpleString() not in ("array<float>", "array<double>")]).write.mode("overwrite").json(path)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: path, rate, samples (mono floats) of 16-bit WAV files; unreadable ones give null samples."""
    import pandas as pd

    @F.pandas_udf("rate int, samples array<float>")
    def decode(content: pd.Series) -> pd.DataFrame:
        import io
        import wave

        import numpy as np

        out = []
        for c in content:
            try:
                with wave.open(io.BytesIO(c)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                    out.append((w.getframerate(), x.astype(np.float32)))
            except (wave.Error, EOFError, ValueError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("w")).select("path", "w.*")
