"""Queries over messages: duplicates, decisions, findings, monthly recaps, cooperative tables, review lists, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clustering, duplicates, recap
from .cut import cut
from .text_queries import _words
from ..sources.tables import table, unique

TODAY_MONTH = "2026-06"


def _stored(spark, d) -> DataFrame:
    return unique(table(spark, d, "messages_stored"), "message_id")


def _raw(spark, d) -> DataFrame:
    return unique(table(spark, d, "messages_raw"), "message_id")


def _chunks(spark, d) -> DataFrame:
    return unique(table(spark, d, "review_chunks"), "chunk_id")


# ---- findings of messages


def message_findings_union(spark, d):
    """AGG1: best confidence of every finding of a message."""
    f = _stored(spark, d).select("message_id", F.explode("findings").alias("f"))
    return f.groupBy("message_id", F.col("f.id").alias("finding")).agg(F.max("f.confidence").alias("confidence"))


def coop_findings_filter(spark, d):
    """AGG2/SET4: findings that are not handed on to the cooperative."""
    s = _stored(spark, d).select("message_id", F.array_distinct(F.transform("findings", lambda f: f["id"])).alias("a"), "coop_findings")
    return s.select("message_id", F.size(F.array_except("a", F.coalesce("coop_findings", F.array().cast("array<string>")))).alias("withheld")).where("withheld > 0")


def message_counts(spark, d):
    """AGG3 from the chunks themselves."""
    return _chunks(spark, d).groupBy("message_id").agg(F.count_if(F.col("status") == "not_sure").alias("not_sure"), F.count_if(F.col("status") == "off_list").alias("off_list"))


# ---- recap


def recap_counts(spark, d):
    return recap.counts(_stored(spark, d)).drop("ordinal")


def recap_volume(spark, d):
    return recap.volume(_stored(spark, d))


def recap_streaks(spark, d):
    return recap.streaks(recap.counts(_stored(spark, d)))


def recap_keep_fix(spark, d):
    return recap.keep_fix(_stored(spark, d), table(spark, d, "findings"))


def recap_lines(spark, d):
    return recap.lines(_stored(spark, d), table(spark, d, "findings"))


def trend_matrix(spark, d):
    """AGG5: finding, visit_month, k messages that cite it, n messages of the month; all stored months of every finding cited in any."""
    m = _stored(spark, d)
    k = recap.counts(m).groupBy("finding", "visit_month").agg(F.sum("k").alias("k"))
    n = recap.counted(m).groupBy("visit_month").agg(F.count(F.lit(1)).alias("n"))
    months = F.array(*map(F.lit, recap.months_of(m))).cast("array<string>")
    grid = k.select("finding").distinct().withColumn("visit_month", F.explode(months))
    return grid.join(k, ["finding", "visit_month"], "left").join(n, "visit_month", "left").select("finding", "visit_month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k", "n")])


def coop_aggregate(spark, d):
    return recap.cooperative(_stored(spark, d), table(spark, d, "farms"), table(spark, d, "findings"))


def coop_everywhere(spark, d):
    """AGG7: findings cited at three quarters of the consenting farms or more."""
    c = coop_aggregate(spark, d)
    return c.select("finding", (F.col("farms") >= F.ceil(F.col("consenting") * 0.75)).alias("everywhere"))


# ---- duplicates


def _messages(spark, d) -> DataFrame:
    cols = ["message_id", "received_at", "fingerprint", "embedding"]
    return cut(duplicates.messages(table(spark, d, "messages_stored").select(cols), table(spark, d, "messages_raw").select(*cols, "text")))


def dup_exact_chained(spark, d):
    """JOIN2/WIN3: batch messages whose fingerprint was met within 7 days, in the history or earlier in the batches."""
    return duplicates.exact(_messages(spark, d).drop("embedding"))


def dup_exact_leader(spark, d):
    """WIN4: only kept originals open a window."""
    return duplicates.leaders(_messages(spark, d).drop("embedding"))


def dup_near_embeddings(spark, d):
    """JOIN3: batch messages at a cosine of 0.98 or more to one met within 7 days."""
    return duplicates.near(_messages(spark, d))


def expire_columns(spark, d, since: str = "2026-06-15"):
    """DEC10/STR4/UDF3: fingerprint and embedding leave after the window."""
    s = _stored(spark, d)
    old = (F.col("received_at") < F.lit(since).cast("timestamp_ntz")) | F.col("received_at").isNull()
    return s.select("message_id", F.when(~old, F.col("fingerprint")).alias("fingerprint"), F.when(~old, F.size("embedding")).alias("dims"))


# ---- decisions


def audio_gate(spark, d):
    """DEC1/DEC2: too short, silent (no text), phantom, or usable; the first reason wins."""
    c = unique(table(spark, d, "transcripts").select("clip_id", "duration_sec", "transcript"), "clip_id")
    t = F.col("transcript")
    why = F.when(F.col("duration_sec") < 3, "too_short").when(t.isNull() | (F.trim(t) == ""), "silence").when(T.is_phantom(t), "phantom").otherwise("ok")
    return c.select("clip_id", why.alias("gate"))


def message_doubt(spark, d):
    """DEC3/DEC4: an unsupported or missing language puts a whole message in doubt and empties its findings."""
    s = _stored(spark, d)
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    why = F.when(F.col("lang").isNull() | F.lower("lang").isin("und", "unknown"), "low_language_probability").when(~lang.isin(*T.LANGS), "unsupported_language")
    return s.select("message_id", why.alias("reason"), F.when(why.isNull(), F.size("findings")).otherwise(0).alias("counted"))


def review_projection(spark, d):
    """DEC11/DEC12: chunks for review of messages that are neither duplicate nor inaudible, with a whole-message flag."""
    s = _stored(spark, d).where("status NOT IN ('duplicate', 'inaudible')").select("message_id", F.size("findings").alias("found"))
    c = _chunks(spark, d).where("status IN ('not_sure', 'off_list')").select("chunk_id", "message_id", "status")
    return c.join(s, "message_id").select("chunk_id", "message_id", "status", (F.col("found") == 0).alias("whole_message"))


def unknown_candidates(spark, d):
    """DEC8: chunks that may form unknown topics, by month."""
    c = _chunks(spark, d).where("(status = 'off_list' OR (status = 'not_sure' AND reason = 'below_threshold')) AND embedding IS NOT NULL")
    return c.groupBy("visit_month").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(F.coalesce("visitor_key", "message_id")).alias("visitors"))


def closed_months(spark, d, today: str = TODAY_MONTH):
    """DEC9/DATE3/UDF3: months before the given current one without a message still in the queue."""
    s = _stored(spark, d).where(F.col("visit_month") < today).select("visit_month").distinct()
    queued = _raw(spark, d).where("received_at IS NOT NULL").select(month_of(F.col("received_at")).alias("visit_month")).distinct()
    return s.join(queued, "visit_month", "left_anti")


def month_of(instant, zone_hours: int = 2):
    """DATE1: the month at the farm, so many hours ahead of UTC."""
    return F.date_format(instant + F.expr(f"INTERVAL {zone_hours} HOURS"), "yyyy-MM")


def local_months(spark, d):
    s = _stored(spark, d)
    return s.select("message_id", month_of(F.col("received_at")).alias("month"), (month_of(F.col("received_at")) == F.col("visit_month")).alias("agrees"))


def previous_months(spark, d):
    """DATE2."""
    m = _stored(spark, d).select("visit_month").distinct()
    return m.select("visit_month", F.date_format(F.add_months(F.to_date(F.concat("visit_month", F.lit("-01"))), -1), "yyyy-MM").alias("previous"))


def segments_to_translate(spark, d):
    """JOIN9: messages with chunks under review and no counted finding."""
    c = _chunks(spark, d).select("message_id").distinct()
    counted = _stored(spark, d).where("size(findings) > 0").select("message_id")
    return c.join(counted, "message_id", "left_anti")


def review_split(spark, d):
    """JOIN5/JOIN11: chunks for review with their cluster, and whether it is one that recurs."""
    c = _chunks(spark, d)
    return clustering.reviewed(c.where("status IN ('not_sure', 'off_list')"), cut(clustering.linked(c)))


def unknown_topics(spark, d):
    """AGG9/SORT2: the clusters with their visitors, most first."""
    return clustering.described(clustering.linked(_chunks(spark, d)))


def stored_projection(spark, d):
    """DEC12: what is kept of an incoming message: an allow-list of columns without its text."""
    return _raw(spark, d).select("message_id", "farm_id", "received_at", month_of(F.col("received_at")).alias("visit_month"), "source", F.col("declared_lang").alias("lang"), "fingerprint", "synthetic")


def cluster_unknown_topics(spark, d):
    """AGG9: exact greedy average linkage within a farm's month (bounded groups)."""
    return clustering.linked(_chunks(spark, d))


def stored_clusters(spark, d):
    """AGG8/AGG10: clusters regrouped from their chunks, with the largest recurring one of each month."""
    c = clustering.linked(_chunks(spark, d))
    g = c.groupBy("farm_id", "visit_month", "cluster").agg(F.countDistinct("visitor").alias("visitors"))
    return g.groupBy("visit_month").agg(F.coalesce(F.max(F.when(F.col("visitors") >= 3, F.col("visitors"))), F.lit(0)).alias("largest"))


def merge_short_segments(spark, d):
    """TXT29: chunks of fewer than 3 words join the one before them (gaps and islands)."""
    c = _chunks(spark, d).select("message_id", "chunk_id", F.coalesce(T.word_count(F.col("text")), F.lit(0)).alias("n"))
    w = Window.partitionBy("message_id").orderBy("chunk_id")
    island = F.sum(F.when(F.col("n") >= 3, 1).otherwise(0)).over(w)
    return c.withColumn("segment", F.greatest(island, F.lit(1))).groupBy("message_id", "segment").agg(F.sum("n").alias("words"), F.min("chunk_id").alias("first_chunk"))


# ---- sort, limit, sets, sources


def newest_messages(spark, d):
    """SORT1/LIM1: the last 20 messages."""
    return _stored(spark, d).where("received_at IS NOT NULL").select("message_id", "received_at").orderBy(F.desc("received_at"), "message_id").limit(20).select("message_id")


def known_union(spark, d):
    """SET1/JOIN10: every fingerprint known from history or batches."""
    a = _stored(spark, d).select("fingerprint", F.lit(1).alias("old"))
    b = _raw(spark, d).select("fingerprint")
    return a.unionByName(b, allowMissingColumns=True).where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("old"), F.lit(0)).alias("old"))


def months_desc(spark, d):
    """SET2."""
    return _stored(spark, d).select("visit_month").distinct().orderBy(F.desc("visit_month"))


def exact_matches(spark, d):
    """SET3: feedback whose labelled spans name exactly its expected findings."""
    f = unique(table(spark, d, "feedback"), "id")
    got = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter("chunks", lambda c: c["kind"] == "finding"), lambda c: c["finding"]))))
    return f.select("id", F.coalesce(got == F.array_sort(F.array_distinct("expected_findings")), F.lit(False)).alias("exact"))


def catalogue_faults(spark, d):
    """SRC3: rules of the findings table, each with its number of violations (all 0 in a valid one)."""
    f = table(spark, d, "findings")
    return f.agg(
        F.sum(F.when((F.col("polarity") == "positive") != F.col("finding_id").startswith("P"), 1).otherwise(0)).alias("polarity"),
        (F.count(F.lit(1)) - F.countDistinct("finding_id")).alias("repeated"),
        F.sum(F.when(F.col("label_en").isNull() | (F.col("label_en") == ""), 1).otherwise(0)).alias("unlabelled"),
        F.abs(F.count(F.lit(1)) - 21).alias("missing"),
    )


def last_write_wins(spark, d):
    """SRC12: the newest row of a fingerprint."""
    m = _raw(spark, d).where("fingerprint IS NOT NULL AND received_at IS NOT NULL")
    return m.groupBy("fingerprint").agg(F.max_by("message_id", F.struct("received_at", "message_id")).alias("message_id"))


def given_name_dictionary(spark, d):
    """SRC15/AGG20: capitalised words of labelled names and how often they are plain words."""
    n = unique(table(spark, d, "pii_names"), "id").select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "name"))).where("n >= 2").select("name", "n", "place")


def seeded_sample(spark, d):
    """SRC16: one row per farm, the first by a seeded hash."""
    m = _raw(spark, d).where("farm_id IS NOT NULL").select("farm_id", "message_id", F.md5(F.concat(F.lit("7:"), "message_id")).alias("h"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("farm_id").orderBy("h"))).where("r = 1").select("farm_id", "message_id")


QUERIES = {f.__name__: f for f in (
    message_findings_union, coop_findings_filter, message_counts, recap_counts, recap_volume, recap_streaks, recap_keep_fix, recap_lines, trend_matrix, coop_aggregate, coop_everywhere, dup_exact_chained, dup_exact_leader,
    dup_near_embeddings, expire_columns, audio_gate, message_doubt, review_projection, unknown_candidates, closed_months, local_months, previous_months, segments_to_translate, review_split, cluster_unknown_topics,
    unknown_topics, stored_projection, stored_clusters, merge_short_segments, newest_messages, known_union, months_desc, exact_matches, catalogue_faults, last_write_wins, given_name_dictionary, seeded_sample,
)}

_S = "(SELECT DISTINCT ON (message_id) * FROM messages_stored WHERE message_id IS NOT NULL)"
_R = "(SELECT DISTINCT ON (message_id) * FROM messages_raw WHERE message_id IS NOT NULL)"
_C = "(SELECT DISTINCT ON (chunk_id) * FROM review_chunks WHERE chunk_id IS NOT NULL)"
_K = f"""counted AS (SELECT * FROM {_S} WHERE status NOT IN ('duplicate', 'inaudible') AND farm_id IS NOT NULL AND visit_month IS NOT NULL),
  k AS (SELECT farm_id, visit_month, finding, count(DISTINCT message_id) AS k FROM (SELECT farm_id, visit_month, message_id, unnest(findings).id AS finding FROM counted) GROUP BY ALL)"""
_ISL = "i AS (SELECT farm_id, finding, visit_month, k, idx - row_number() OVER (PARTITION BY farm_id, finding ORDER BY idx) AS g, idx FROM (SELECT *, CAST(substr(visit_month, 1, 4) AS INT) * 12 + CAST(substr(visit_month, 6, 2) AS INT) AS idx FROM k)), st AS (SELECT farm_id, finding, visit_month, k, (row_number() OVER (PARTITION BY farm_id, finding, g ORDER BY idx))::INT AS streak FROM i)"
_VOL = "v AS (SELECT farm_id, visit_month, count(*) AS n, sum(greatest(0, coalesce(not_sure_count, 0)))::BIGINT AS p FROM counted GROUP BY ALL)"
_TOP = "t AS (SELECT st.*, polarity, ordinal, row_number() OVER (PARTITION BY farm_id, visit_month, polarity ORDER BY k DESC, streak DESC, ordinal) AS r FROM st JOIN findings f ON f.finding_id = st.finding WHERE polarity = 'positive' OR k >= 2 OR streak >= 2)"
_KF = "kf AS (SELECT farm_id, visit_month, polarity, finding, k, streak FROM t WHERE r = 1)"
_MONTH = "strftime(received_at + INTERVAL 2 HOURS, '%Y-%m')"
_COOP = f"""WITH a AS (SELECT count(*) FILTER (consent) AS consenting FROM farms), m AS (SELECT s.farm_id, message_id, unnest(coop_findings) AS finding FROM {_S} s JOIN farms USING (farm_id) WHERE consent AND status NOT IN ('duplicate', 'inaudible'))
  SELECT finding, count(DISTINCT farm_id) AS farms, count(DISTINCT message_id) AS mentions, min(consenting) AS consenting FROM m JOIN findings ON finding_id = finding, a GROUP BY finding"""
# fingerprints where missing: the words of the plain text; dates are inside the window where one is missing; the order of arrival
_M = f"""m AS (SELECT message_id, true AS old, received_at AS t, fingerprint AS fp, embedding::DOUBLE[] AS embedding FROM {_S}
  UNION ALL SELECT message_id, false, received_at, coalesce(fingerprint, CASE WHEN len({_words("text")}) > 0 THEN substr(sha256(array_to_string({_words("text")}, ' ')), 1, 28) END), embedding::DOUBLE[] FROM {_R})"""
_BEFORE = "(b.old OR (coalesce(b.t, TIMESTAMP '9999-01-01'), b.message_id) < (coalesce(a.t, TIMESTAMP '9999-01-01'), a.message_id)) AND (a.t IS NULL OR b.t IS NULL OR (b.t >= a.t - INTERVAL 7 DAYS AND b.t <= a.t + INTERVAL 7 DAYS))"
ORACLE = {
    "message_findings_union": f"SELECT message_id, f.id AS finding, max(f.confidence) AS confidence FROM (SELECT message_id, unnest(findings) AS f FROM {_S}) GROUP BY ALL",
    "coop_findings_filter": f"SELECT message_id, len(list_filter(list_distinct(list_transform(findings, lambda f: f.id)), lambda x: NOT list_contains(coalesce(coop_findings, []), x)))::INT AS withheld FROM {_S} WHERE len(list_filter(list_distinct(list_transform(findings, lambda f: f.id)), lambda x: NOT list_contains(coalesce(coop_findings, []), x))) > 0",
    "message_counts": f"SELECT message_id, count(*) FILTER (status = 'not_sure') AS not_sure, count(*) FILTER (status = 'off_list') AS off_list FROM {_C} GROUP BY message_id",
    "recap_counts": f"WITH {_K} SELECT * FROM k",
    "recap_volume": f"WITH {_K}, {_VOL} SELECT * FROM v",
    "recap_streaks": f"WITH {_K}, {_ISL} SELECT * FROM st",
    "recap_keep_fix": f"WITH {_K}, {_ISL}, {_TOP}, {_KF} SELECT * FROM kf",
    "recap_lines": f"""WITH {_K}, {_ISL}, {_VOL}, {_TOP}, {_KF}, l AS (
      SELECT farm_id, visit_month, 1 AS line_no, 'volume' AS template, NULL AS finding, n AS value FROM v
      UNION ALL SELECT farm_id, visit_month, 2, 'keep', finding, k FROM kf WHERE polarity = 'positive'
      UNION ALL SELECT v.farm_id, v.visit_month, 3, CASE WHEN finding IS NULL THEN 'nothing_urgent' WHEN streak >= 2 THEN 'fix_streak' ELSE 'fix' END, finding, CASE WHEN finding IS NULL THEN NULL WHEN streak >= 2 THEN streak ELSE k END FROM v LEFT JOIN (SELECT * FROM kf WHERE polarity = 'negative') x ON x.farm_id = v.farm_id AND x.visit_month = v.visit_month
      UNION ALL SELECT farm_id, visit_month, 5, 'not_understood', NULL, p FROM v WHERE p > 0
      UNION ALL SELECT f.farm_id, m.visit_month, 1, 'no_feedback', NULL, NULL FROM (SELECT DISTINCT farm_id FROM messages_stored WHERE farm_id IS NOT NULL) f, (SELECT DISTINCT visit_month FROM messages_stored WHERE visit_month IS NOT NULL) m WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.farm_id = f.farm_id AND v.visit_month = m.visit_month))
      SELECT l.*, replace(replace(CASE template WHEN 'volume' THEN 'Messages this month: {{n}}' WHEN 'keep' THEN 'Keep: {{f}} ({{n}})' WHEN 'fix' THEN 'To improve: {{f}} ({{n}})' WHEN 'fix_streak' THEN 'Again, {{n}} months in a row: {{f}}' WHEN 'nothing_urgent' THEN 'Nothing urgent' WHEN 'no_feedback' THEN 'No feedback this month' ELSE 'Not understood: {{n}}' END, '{{n}}', coalesce(value::VARCHAR, '')), '{{f}}', coalesce(label_en, '')) AS text FROM l LEFT JOIN findings ON finding_id = finding""".replace("{{", "{").replace("}}", "}"),
    "trend_matrix": f"""WITH {_K}, o AS (SELECT DISTINCT visit_month FROM {_S} WHERE visit_month IS NOT NULL), n AS (SELECT visit_month, count(*) AS n FROM counted GROUP BY visit_month), f AS (SELECT DISTINCT finding FROM k)
      SELECT f.finding, o.visit_month, coalesce((SELECT sum(k.k) FROM k WHERE k.finding = f.finding AND k.visit_month = o.visit_month), 0)::BIGINT AS k, coalesce(n.n, 0) AS n FROM f CROSS JOIN o LEFT JOIN n USING (visit_month)""",
    "coop_aggregate": _COOP,
    "coop_everywhere": f"SELECT finding, farms >= ceil(consenting * 0.75) AS everywhere FROM ({_COOP})",
    "dup_exact_chained": f"WITH {_M} SELECT DISTINCT a.message_id FROM m a JOIN m b ON a.fp = b.fp AND {_BEFORE} WHERE NOT a.old",
    "dup_exact_leader": f"""WITH RECURSIVE {_M}, d AS (SELECT DISTINCT fp, t FROM m WHERE t IS NOT NULL AND fp IS NOT NULL), nx AS (SELECT d.fp, d.t, min(e.t) AS t2 FROM d JOIN d e ON e.fp = d.fp AND e.t > d.t + INTERVAL 7 DAYS GROUP BY ALL),
      l AS (SELECT fp, min(t) AS t FROM d GROUP BY fp UNION ALL SELECT l.fp, nx.t2 FROM l JOIN nx ON nx.fp = l.fp AND nx.t = l.t),
      r AS (SELECT m.*, row_number() OVER (PARTITION BY fp, t ORDER BY message_id) AS r, count(t) OVER (PARTITION BY fp) AS dated FROM m WHERE fp IS NOT NULL)
      SELECT message_id, NOT (r = 1 AND (l.t IS NOT NULL OR dated = 0)) AS duplicate FROM r LEFT JOIN l USING (fp, t)""",
    "dup_near_embeddings": f"""WITH {_M}, e AS (SELECT * FROM m WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_dot_product(embedding, embedding) > 0)
      SELECT DISTINCT a.message_id FROM e a JOIN e b ON {_BEFORE} AND round(list_cosine_similarity(a.embedding, b.embedding), 6) >= 0.98 WHERE NOT a.old""",
    "expire_columns": f"SELECT message_id, CASE WHEN received_at >= TIMESTAMP '2026-06-15' THEN fingerprint END AS fingerprint, CASE WHEN received_at >= TIMESTAMP '2026-06-15' THEN len(embedding) END AS dims FROM {_S}",
    "audio_gate": r"""SELECT clip_id, CASE WHEN duration_sec < 3 THEN 'too_short' WHEN transcript IS NULL OR trim(transcript) = '' THEN 'silence' WHEN NOT regexp_matches(transcript, '[\p{L}\p{N}]') OR regexp_matches(transcript, '(?i)""" + T.CREDITS + r"""')
      OR trim(regexp_replace(transcript, '\[[^\]]*\]|\([^)]*\)|♪', '', 'g')) = '' THEN 'phantom' ELSE 'ok' END AS gate FROM (SELECT DISTINCT ON (clip_id) * FROM transcripts WHERE clip_id IS NOT NULL)""",
    "message_doubt": f"""SELECT message_id, reason, CASE WHEN reason IS NULL THEN coalesce(len(findings), -1) ELSE 0 END AS counted FROM (SELECT *, CASE WHEN lang IS NULL OR lower(lang) IN ('und', 'unknown') THEN 'low_language_probability' WHEN lower(substr(trim(lang), 1, 2)) NOT IN ('en', 'fr', 'de', 'es') THEN 'unsupported_language' END AS reason FROM {_S})""",
    "review_projection": f"SELECT chunk_id, c.message_id, c.status, len(s.findings) = 0 AS whole_message FROM {_C} c JOIN {_S} s ON s.message_id = c.message_id AND s.status NOT IN ('duplicate', 'inaudible') WHERE c.status IN ('not_sure', 'off_list')",
    "unknown_candidates": f"SELECT visit_month, count(*) AS chunks, count(DISTINCT coalesce(visitor_key, message_id)) AS visitors FROM {_C} WHERE (status = 'off_list' OR (status = 'not_sure' AND reason = 'below_threshold')) AND embedding IS NOT NULL GROUP BY visit_month",
    "closed_months": f"SELECT DISTINCT visit_month FROM {_S} WHERE visit_month < '{TODAY_MONTH}' AND visit_month NOT IN (SELECT {_MONTH} FROM {_R} WHERE received_at IS NOT NULL)",
    "local_months": f"SELECT message_id, {_MONTH} AS month, {_MONTH} = visit_month AS agrees FROM {_S}",
    "previous_months": f"SELECT DISTINCT visit_month, strftime(CAST(visit_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS previous FROM {_S}",
    "segments_to_translate": f"SELECT DISTINCT message_id FROM {_C} WHERE message_id NOT IN (SELECT message_id FROM {_S} WHERE len(findings) > 0)",
    "stored_projection": f"SELECT message_id, farm_id, received_at, {_MONTH} AS visit_month, source, declared_lang AS lang, fingerprint, synthetic FROM {_R}",
    "merge_short_segments": f"""WITH c AS (SELECT message_id, chunk_id, coalesce(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')), 0) AS n FROM {_C}), i AS (SELECT *, sum((n >= 3)::INT) OVER (PARTITION BY message_id ORDER BY chunk_id) AS g FROM c)
      SELECT message_id, greatest(g, 1)::BIGINT AS segment, sum(n)::BIGINT AS words, min(chunk_id) AS first_chunk FROM i GROUP BY 1, 2""",
    "newest_messages": f"SELECT message_id FROM {_S} WHERE received_at IS NOT NULL ORDER BY received_at DESC, message_id LIMIT 20",
    "known_union": f"SELECT fingerprint, count(*) AS n, max(old) AS old FROM (SELECT fingerprint, 1 AS old FROM {_S} UNION ALL SELECT fingerprint, 0 FROM {_R}) WHERE fingerprint IS NOT NULL GROUP BY fingerprint",
    "months_desc": f"SELECT DISTINCT visit_month FROM {_S}",
    "exact_matches": """SELECT id, coalesce(list_sort(list_distinct(list_filter(list_transform(list_filter(chunks, lambda c: c.kind = 'finding'), lambda c: c.finding), lambda x: x IS NOT NULL))) = list_sort(list_distinct(expected_findings)), false) AS exact FROM (SELECT DISTINCT ON (id) * FROM feedback WHERE id IS NOT NULL)""",
    "catalogue_faults": "SELECT sum(CASE WHEN (polarity = 'positive') != starts_with(finding_id, 'P') THEN 1 ELSE 0 END)::BIGINT AS polarity, count(*) - count(DISTINCT finding_id) AS repeated, sum(CASE WHEN label_en IS NULL OR label_en = '' THEN 1 ELSE 0 END)::BIGINT AS unlabelled, abs(count(*) - 21) AS missing FROM findings",
    "last_write_wins": f"SELECT fingerprint, message_id FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY received_at DESC, message_id DESC) AS r FROM {_R} WHERE fingerprint IS NOT NULL AND received_at IS NOT NULL) WHERE r = 1",
    "given_name_dictionary": "SELECT * FROM (SELECT name, n, (rank() OVER (ORDER BY n DESC, name))::INT AS place FROM (SELECT name, count(*) AS n FROM (SELECT unnest(names) AS name FROM (SELECT DISTINCT ON (id) * FROM pii_names)) GROUP BY name)) WHERE n >= 2",
    "seeded_sample": f"SELECT farm_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY farm_id ORDER BY md5('7:' || message_id)) AS r FROM {_R} WHERE farm_id IS NOT NULL) WHERE r = 1",
}
