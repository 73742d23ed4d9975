"""Composed queries: the message pipeline, month reports, derived flags, alignment, simulated months."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences
from ..functions import text as T
from ..functions.embedding import embed
from ..operators import analysis, clustering, recap
from ..sources.tables import table, unique


def analysed_messages(spark, d):
    """UDF5/STR8: batch messages through the whole pipeline, with the labelled spans of the findings as examples."""
    f = unique(table(spark, d, "feedback").select("id", "chunks"), "id").select(F.explode("chunks").alias("c")).where("c.span IS NOT NULL")
    spans = f.select(F.coalesce("c.finding", "c.negates").alias("finding"), F.col("c.negates").isNotNull().alias("negated"), F.col("c.span").alias("span")).where("finding IS NOT NULL")
    # the examples stay a table of fixed size: the 20 most frequent spans of each finding and sign
    n = spans.groupBy("finding", "negated", "span").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("finding", "negated").orderBy(F.desc("n"), "span")
    few = n.withColumn("r", F.row_number().over(w)).where("r <= 20").select("finding", "negated", "span")
    m = unique(table(spark, d, "messages_raw").select("message_id", "text", F.col("declared_lang").alias("lang")), "message_id")
    return analysis.analysed(m, embed(few, "span").drop("span")).groupBy("status").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.size("findings")).alias("findings"))


def month_reports(spark, d):
    """REC3: each farm's month as text messages: recap lines in order, its recurring unknown topic among them, packed into numbered parts."""
    s = unique(table(spark, d, "messages_stored"), "message_id")
    topics = clustering.described(clustering.linked(unique(table(spark, d, "review_chunks"), "chunk_id"))).where("recurring")
    largest = topics.groupBy("farm_id", "visit_month").agg(F.max("visitors").alias("k"))
    l = recap.lines(s, table(spark, d, "findings"), largest).groupBy("farm_id", "visit_month").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    body = T.to_gsm7(F.concat_ws("\n", F.transform("l", lambda x: x["text"])))
    return l.select("farm_id", "visit_month", F.size(sequences.sms_packer()(body)).alias("parts"), F.length(body).alias("chars"))


def recap_maps(spark, d):
    """MAP1: counts of a recap as a map; here its size and largest value."""
    k = recap.counts(unique(table(spark, d, "messages_stored"), "message_id"))
    m = k.groupBy("farm_id", "visit_month").agg(F.map_from_entries(F.collect_list(F.struct("finding", "k"))).alias("m"))
    return m.select("farm_id", "visit_month", F.size("m").alias("findings"), F.array_max(F.map_values("m")).alias("most"))


def derived_flags(spark, d):
    """SRC14: flags of a labelled message, derived from its spans and text."""
    f = unique(table(spark, d, "feedback"), "id").where("text IS NOT NULL")
    kinds = F.transform(F.coalesce("chunks", F.array().cast("array<struct<span:string,kind:string,finding:string,negates:string,topic:string>>")), lambda c: c["kind"])
    return f.select("id", F.array_contains(kinds, "off_list").alias("off_list"), F.array_contains(kinds, "negated").alias("cancels"), (F.size(F.array_distinct("expected_findings")) > 1).alias("multi"), T.length_class(F.col("text")).alias("length_class"))


def span_faults(spark, d):
    """SRC14: spans that are no exact part of their text (none in a sound corpus)."""
    f = unique(table(spark, d, "feedback"), "id").select("id", "text", F.explode("chunks").alias("c"))
    return f.groupBy(F.coalesce(F.contains("text", "c.span"), F.lit(False)).alias("exact")).agg(F.count(F.lit(1)).alias("spans"))


def span_overlap(spark, d):
    """TXT21/JOIN7: spans of a feedback that share at least half of the shorter one's words with another span of it."""
    f = unique(table(spark, d, "feedback").select("id", "chunks"), "id").select("id", F.posexplode("chunks").alias("i", "c")).where("c.span IS NOT NULL")
    w = f.select("id", "i", F.posexplode(T.words(F.col("c.span"))).alias("at", "word"))
    nth = w.withColumn("k", F.row_number().over(Window.partitionBy("id", "i", "word").orderBy("at"))).select("id", "i", "word", "k")
    size = nth.groupBy("id", "i").agg(F.count(F.lit(1)).alias("n"))
    both = nth.alias("a").join(nth.select("id", F.col("i").alias("j"), "word", "k").alias("b"), ["id", "word", "k"]).where("i < j").groupBy("id", "i", "j").agg(F.count(F.lit(1)).alias("common"))
    m = both.join(size, ["id", "i"]).join(size.select("id", F.col("i").alias("j"), F.col("n").alias("m")), ["id", "j"])
    return m.where(F.col("common") * 2 >= F.least("n", "m")).select("id", "i", "j", "common")


def segment_alignment(spark, d):
    """JOIN4: sentences of a transcript aligned to its lines."""
    t = unique(table(spark, d, "transcripts").select("clip_id", "transcript"), "clip_id").where("transcript IS NOT NULL")
    a = analysis.align()(T.sentences(F.col("transcript")), F.split("transcript", "\n"))
    return t.select("clip_id", F.array_max(a).alias("last_segment"))


def shared_passages(spark, d):
    """JOIN12: feedback whose fingerprint also stands in the batches: the corpora are not disjoint there."""
    f = unique(table(spark, d, "feedback").select("id", "text"), "id").where("text IS NOT NULL").select("id", T.fingerprint(F.col("text")).alias("fp"))
    r = unique(table(spark, d, "messages_raw").select("message_id", "text"), "message_id").where("text IS NOT NULL").select(T.fingerprint(F.col("text")).alias("fp"))
    return f.join(r, "fp", "left_semi").select("id")


def simulated_months(spark, d):
    """WIN12: 500 months of seeded draws from the unknown-topic chunks' months: visitors drawn and whether three meet."""
    c = unique(table(spark, d, "review_chunks"), "chunk_id").select("visit_month").where("visit_month IS NOT NULL").groupBy("visit_month").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 0
    draws = spark.range(500 * 7).select((F.col("id") / 7).cast("int").alias("run"), (F.abs(F.xxhash64("id", F.lit(9))) % F.lit(max(total, 1))).alias("at"))
    cum = c.withColumn("to", F.sum("n").over(Window.orderBy("visit_month"))).withColumn("from", F.col("to") - F.col("n"))
    hit = draws.join(F.broadcast(cum), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))).groupBy("run", "visit_month").agg(F.count(F.lit(1)).alias("k"))
    return hit.groupBy("run").agg(F.max("k").alias("most")).groupBy("most").agg(F.count(F.lit(1)).alias("runs"))


def remark_words(spark, d):
    """TXT2/SORT2 on remarks: findings by the number of different words their spans use."""
    f = unique(table(spark, d, "feedback").select("id", "chunks"), "id").select(F.explode("chunks").alias("c")).where("c.finding IS NOT NULL AND c.span IS NOT NULL")
    return f.select("c.finding", F.explode(T.words(F.col("c.span"))).alias("word")).groupBy("finding").agg(F.countDistinct("word").alias("words")).orderBy(F.desc("words"), "finding")


QUERIES = {f.__name__: f for f in (analysed_messages, month_reports, recap_maps, derived_flags, span_faults, span_overlap, segment_alignment, shared_passages, simulated_months, remark_words)}

from .message_queries import _K  # noqa: E402
from .text_queries import _u, _words  # noqa: E402

_FEED = _u("feedback", "id")
ORACLE = {
    "recap_maps": f"WITH {_K} SELECT farm_id, visit_month, count(*)::INT AS findings, max(k) AS most FROM k GROUP BY ALL",
    "derived_flags": f"""SELECT id, coalesce(list_contains(k, 'off_list'), false) AS off_list, coalesce(list_contains(k, 'negated'), false) AS cancels, multi, CASE WHEN n <= 3 THEN 'very_short' WHEN n <= 8 THEN 'short' WHEN n >= 40 THEN 'long' ELSE 'medium' END AS length_class
      FROM (SELECT id, list_transform(chunks, lambda c: c.kind) AS k, len(list_distinct(expected_findings)) > 1 AS multi, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS n FROM {_FEED} WHERE text IS NOT NULL)""",
    "span_faults": f"SELECT coalesce(contains(text, c.span), false) AS exact, count(*) AS spans FROM (SELECT text, unnest(chunks) AS c FROM {_FEED}) GROUP BY 1",
    "shared_passages": f"SELECT id FROM {_FEED} WHERE text IS NOT NULL AND array_to_string({_words('text')}, ' ') IN (SELECT array_to_string({_words('text')}, ' ') FROM {_u('messages_raw', 'message_id')} WHERE text IS NOT NULL)",
    "span_overlap": f"""WITH s AS (SELECT id, unnest(chunks) AS c, unnest(range(len(chunks)))::INT AS i FROM {_FEED}), w AS (SELECT id, i, unnest({_words('c.span')}) AS word FROM s WHERE c.span IS NOT NULL), n AS (SELECT id, i, word, count(*) AS k FROM w GROUP BY ALL), t AS (SELECT id, i, sum(k) AS n FROM n GROUP BY ALL)
      SELECT id, i, j, common FROM (SELECT a.id, a.i, b.i AS j, sum(least(a.k, b.k))::BIGINT AS common FROM n a JOIN n b ON a.id = b.id AND a.word = b.word AND a.i < b.i GROUP BY ALL) x JOIN t p ON p.id = x.id AND p.i = x.i JOIN t q ON q.id = x.id AND q.i = x.j WHERE common * 2 >= least(p.n, q.n)""".replace("SELECT id, i, j, common FROM", "SELECT x.id, x.i, x.j, common FROM"),
    "remark_words": f"SELECT finding, count(DISTINCT word) AS words FROM (SELECT c.finding AS finding, unnest({_words('c.span')}) AS word FROM (SELECT unnest(chunks) AS c FROM {_FEED}) WHERE c.finding IS NOT NULL AND c.span IS NOT NULL) GROUP BY finding",
}
