"""Queries over texts: folding, words, languages, negation, segmentation, scrubbing, messages for phones."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import pii, sequences
from ..functions import text as T
from ..sources.tables import table, unique


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def fold_words(spark, d):
    w = T.words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).alias("n_words"), F.md5(F.concat_ws(" ", w)).alias("words_md5"))


def word_counts(spark, d):
    w = _docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fingerprint_exact_groups(spark, d):
    f = unique(table(spark, d, "messages_raw").select("message_id", "text"), "message_id").where("text IS NOT NULL").select(T.fingerprint(F.col("text")).alias("fp")).where("fp IS NOT NULL")
    return f.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lang_guess_summary(spark, d):
    scores = T.scores_in(F.col("w"), F.col("low"))
    rows = _docs(spark, d).where("text IS NOT NULL").select("lang", T.words(F.col("text")).alias("w"), F.lower("text").alias("low"))
    rows = rows.select("lang", *[s.alias(c) for c, s in scores.items()])
    guess, share = T.guess_from({c: F.col(c) for c in scores})
    return rows.select(F.coalesce("lang", F.lit("none")).alias("declared"), guess.alias("guess"), share.alias("p")).groupBy("declared", "guess").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


def negation_flags(spark, d):
    rows = unique(table(spark, d, "feedback").select("id", "text", "lang"), "id").where("text IS NOT NULL")
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = rows.select("id", T.padded(F.col("text")).alias("t"), lang.alias("l"))
    return rows.select("id", T.negation_in(F.col("t"), F.col("l")).alias("x")).select("id", "x.negated", "x.uncertain", "x.cues")


def guide_mentions(spark, d):
    rows = unique(table(spark, d, "feedback").select("id", "text", "lang"), "id").where("text IS NOT NULL")
    return rows.select("id", T.mentions_guide(F.col("text"), F.lower(F.substring(F.trim("lang"), 1, 2))).alias("guide"))


def phantom_filter(spark, d):
    rows = unique(table(spark, d, "transcripts").select("clip_id", "transcript"), "clip_id").where("transcript IS NOT NULL")
    return rows.select("clip_id", T.is_phantom(F.col("transcript")).alias("phantom"))


#: Letters a keyword has at least, labelled spans it stands in, and the share of them that name its finding.
KEYWORD_LETTERS, KEYWORD_SPANS, KEYWORD_SHARE = 4, 3, 0.6


def _lang(c: str):
    return F.lower(F.substring(F.trim(c), 1, 2))


def keyword_list(spark, d):
    """lang, term, finding: words of labelled spans that name one finding almost always, by language."""
    f = unique(table(spark, d, "feedback").select("id", "lang", "chunks"), "id").select(_lang("lang").alias("lang"), F.explode("chunks").alias("c"))
    w = f.where("c.span IS NOT NULL AND lang <> ''").select("lang", F.col("c.finding").alias("finding"), F.explode(F.array_distinct(T.words(F.col("c.span")))).alias("term")).where(F.length("term") >= KEYWORD_LETTERS)
    n = w.groupBy("lang", "term", "finding").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    return n.join(all_, ["lang", "term"]).where((F.col("n") >= KEYWORD_SPANS) & (F.col("n") >= KEYWORD_SHARE * F.col("all")) & F.col("finding").isNotNull()).select("lang", "term", "finding")


def _classified(spark, d, whole: bool):
    """TXT14: chunk_id, message_id, finding by the keyword list of the message's language, or all lists where it has none.

    Words meet terms by equality or, as prefixes, by their first letters; no chunk is held against the whole list.
    """
    c = unique(table(spark, d, "review_chunks").select("chunk_id", "message_id", "text"), "chunk_id").where("text IS NOT NULL")
    langs = unique(table(spark, d, "messages_stored").select("message_id", "lang"), "message_id").select("message_id", _lang("lang").alias("lang"))
    terms = keyword_list(spark, d).withColumnRenamed("lang", "of")
    known = F.broadcast(terms.select("of").distinct().withColumnRenamed("of", "lang").withColumn("known", F.lit(True)))  # languages
    w = c.join(langs, "message_id", "left").join(known, "lang", "left").select("chunk_id", "message_id", "lang", "known", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    head = lambda col: F.substring(col, 1, KEYWORD_LETTERS)
    hit = F.col("word") == F.col("term") if whole else (head("word") == head("term")) & F.col("word").startswith(F.col("term"))
    return w.join(terms, hit).where(F.col("known").isNull() | (F.col("lang") == F.col("of"))).select("chunk_id", "message_id", "finding").distinct()


def keyword_hits(spark, d, whole: bool = False):
    """TXT14: finding, chunks; prefix mode or whole-word mode."""
    return _classified(spark, d, whole).groupBy("finding").agg(F.count(F.lit(1)).alias("chunks"))


def keyword_messages(spark, d):
    """TXT15: message_id, findings: the findings of all chunks of a message, by whole words."""
    return _classified(spark, d, True).groupBy("message_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("finding"))).alias("findings"))


def sentences_exploded(spark, d):
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "text"), "chunk_id").where("text IS NOT NULL")
    return rows.select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


def clauses_exploded(spark, d):
    """TXT6/TXT7: every clause with its place in its sentence, in the language of its message."""
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "message_id", "text"), "chunk_id").where("text IS NOT NULL")
    langs = unique(table(spark, d, "messages_stored").select("message_id", "lang"), "message_id")
    s = rows.join(langs, "message_id", "left").select("chunk_id", F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"), F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))
    return s.select("chunk_id", "sentence_index", F.posexplode(sequences.clauses()("sentence", "lang")).alias("clause_index", "clause"))


def length_classes(spark, d):
    rows = unique(table(spark, d, "feedback").select("id", "text"), "id").where("text IS NOT NULL")
    return rows.select(T.length_class(F.col("text")).alias("length_class")).groupBy("length_class").agg(F.count(F.lit(1)).alias("n"))


def wer_normalise(spark, d):
    rows = unique(table(spark, d, "transcripts").select("clip_id", "transcript"), "clip_id").where("transcript IS NOT NULL")
    return rows.select("clip_id", F.md5(T.wer_normalised(F.col("transcript"))).alias("norm_md5"))


def gsm7_length(spark, d):
    rows = unique(table(spark, d, "feedback").select("id", "text"), "id").where("text IS NOT NULL")
    g = T.to_gsm7(F.col("text"))
    return rows.select("id", T.is_gsm7(F.col("text")).alias("gsm7"), T.gsm7_length(F.col("text")).alias("septets"), T.is_gsm7(g).alias("sendable"))


def sms_parts(spark, d):
    """TXT27: every feedback as numbered parts of at most 160 septets."""
    rows = unique(table(spark, d, "feedback").select("id", "text"), "id").where("text IS NOT NULL")
    return rows.select("id", F.size(sequences.sms_packer()(T.to_gsm7(F.col("text")))).alias("parts"))


def sms_uris(spark, d):
    rows = unique(table(spark, d, "feedback").select("id", "text"), "id").where("text IS NOT NULL")
    return rows.select("id", F.length(T.sms_uri(F.lit("+250700000000"), F.col("text"))).alias("uri_length"))


def share_intake(spark, d):
    """SRC6: texts become queue rows, a bare URL does not."""
    rows = unique(table(spark, d, "messages_raw").select("message_id", "text", "source"), "message_id")
    return rows.where("text IS NOT NULL").where(~F.col("text").rlike(r"^https?://\S+$")).groupBy("source").agg(F.count(F.lit(1)).alias("queued"))


def pii_emails(spark, d):
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "text"), "chunk_id")
    return rows.select("chunk_id", F.regexp_count("text", F.lit(pii.EMAIL)).alias("emails")).where("emails > 0")


def pii_handles(spark, d):
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "text"), "chunk_id")
    return rows.select("chunk_id", F.regexp_count(F.concat(F.lit(" "), "text"), F.lit(r"[^\w@.]@[A-Za-z_]\w+")).alias("handles")).where("handles > 0")


def pii_full(spark, d):
    rows = unique(table(spark, d, "pii_names").select("id", "text", "lang"), "id")
    s = pii.scrubbed(rows)
    return s.select("id", "names", "phones", "emails", "handles")


def pii_recall(spark, d):
    """AGG17: share of labelled names and phones that scrubbing removes, by language and position and over all."""
    rows = unique(table(spark, d, "pii_names"), "id")
    s = pii.scrubbed(rows.select("id", "text", "lang")).select("id", "clean")
    gone = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda n: ~F.col("clean").contains(n)))
    all_ = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    m = rows.join(s, "id").select("lang", "name_position", gone(F.col("names")).alias("gone"), all_(F.col("names")).alias("names"), gone(F.col("phones")).alias("phones_gone"), all_(F.col("phones")).alias("phones"))
    return m.groupingSets([["lang"], ["name_position"], []], "lang", "name_position").agg(*[F.sum(c).alias(c) for c in ("names", "gone", "phones", "phones_gone")])


def repetition_cut(spark, d):
    """TXT30: transcripts whose tail repeats a block."""
    rows = unique(table(spark, d, "transcripts").select("clip_id", "transcript"), "clip_id").where("transcript IS NOT NULL")
    return rows.select("clip_id", sequences.loop_cut()("transcript").alias("kept_words"))


def edit_distance_words(spark, d):
    """TXT18/TXT19: word and character errors of each review text against its machine translation's source, corpus rates."""
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "text", "english_mt"), "chunk_id").where("text IS NOT NULL AND english_mt IS NOT NULL")
    a, b = T.wer_normalised(F.col("text")), T.wer_normalised(F.col("english_mt"))
    m = rows.select(sequences.word_errors()(a, b).alias("e"), F.size(F.split(a, " ")).alias("n"), F.levenshtein(a, b).alias("c"), F.length(a).alias("l"))
    return m.agg(F.round(F.sum("e") / F.sum("n"), 6).alias("wer"), F.round(F.sum("c") / F.sum("l"), 6).alias("cer"), F.count(F.lit(1)).alias("pairs"))


def char_errors(spark, d):
    """TXT18: character edit distance of text and translation."""
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "text", "english_mt"), "chunk_id").where("text IS NOT NULL AND english_mt IS NOT NULL")
    return rows.select("chunk_id", F.levenshtein(F.regexp_replace("text", r"[^ -~]", "?"), F.regexp_replace("english_mt", r"[^ -~]", "?")).alias("edits"))


def removed_words(spark, d):
    """TXT20/AGG18: the words that scrubbing removes most often."""
    rows = unique(table(spark, d, "pii_names").select("id", "text", "lang"), "id")
    w = pii.scrubbed(rows).select(F.explode(sequences.lost_words()("text", "clean")).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def token_jaccard(spark, d):
    """TXT22: feedback and its longest labelled span as word sets."""
    rows = unique(table(spark, d, "feedback").select("id", "text", "chunks"), "id").where("text IS NOT NULL").select("id", "text", F.explode("chunks").alias("c")).where("c.span IS NOT NULL")
    a, b = F.array_distinct(T.words(F.col("text"))), F.array_distinct(T.words(F.col("c.span")))
    m = rows.select("id", a.alias("a"), b.alias("b"))
    return m.select("id", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"), F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def untranslated_words(spark, d):
    """TXT23: long words of a translation that share five letters with a word of their source."""
    rows = unique(table(spark, d, "review_chunks").select("chunk_id", "text", "english_mt"), "chunk_id").where("text IS NOT NULL AND english_mt IS NOT NULL")
    heads = lambda c: F.array_distinct(F.transform(F.filter(T.words(F.col(c)), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5)))
    return rows.select("chunk_id", F.size(F.array_intersect(heads("text"), heads("english_mt"))).alias("leaks")).where("leaks > 0")


QUERIES = {f.__name__: f for f in (
    fold_words, word_counts, fingerprint_exact_groups, lang_guess_summary, negation_flags, guide_mentions, phantom_filter, sentences_exploded, clauses_exploded, length_classes, wer_normalise, gsm7_length,
    sms_parts, sms_uris, share_intake, pii_emails, pii_handles, pii_full, pii_recall, repetition_cut, edit_distance_words, char_errors, removed_words, token_jaccard, untranslated_words, keyword_list, keyword_messages,
)} | {"keyword_hits_prefix": keyword_hits, "keyword_hits_word": lambda s, d: keyword_hits(s, d, True)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# other forms of characters, which strip_accents leaves as they are
_FORMS = ["".join(x) for x in zip(*((s, d) for s, d in zip(*T.plain_letters()) if unicodedata.normalize("NFD", s) == s))]


def _fold(c: str) -> str:
    low = f"replace(lower(regexp_replace({c}, '[‘’ʼ´`]', '''', 'g')), 'ß', 'ss')"
    for one, several in T.joined_letters().items():
        low = f"replace({low}, '{one}', '{several}')"
    return f"regexp_replace(strip_accents(translate({low}, {_q(_FORMS[0])}, {_q(_FORMS[1])})), '\\p{{M}}', '', 'g')"


def _words(c: str) -> str:
    return f"regexp_extract_all({_fold(c)}, '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*')"


def _padded(c: str) -> str:
    return f"(' ' || array_to_string({_words(c)}, ' ') || ' ')"


def _spaced(c: str) -> str:
    """Two spaces between words, so that matches without look-ahead do not share one."""
    return f"('  ' || array_to_string({_words(c)}, '  ') || '  ')"


def _terms(terms) -> str:
    """The matcher for doubled spaces."""
    parts = []
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        parts.append("  ".join(t.rstrip("*").split()) + ("[^ ]*" if t.endswith("*") else ""))
    return _q(" (?:" + "|".join(parts) + ") ")


def _count(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, {p}))"


def _u(tbl: str, key: str) -> str:
    return f"(SELECT DISTINCT ON ({key}) * FROM {tbl} WHERE {key} IS NOT NULL)"


_LIST = lambda ws: "[" + ", ".join(_q(w) for w in ws) + "]"
_SCORES = ", ".join(
    f"len(list_filter(w, lambda x: list_contains({_LIST(T.STOP_WORDS[c])}, x))) "
    + "".join(f"+ CASE WHEN regexp_matches(lower(text), {_q(p)}) THEN {s} ELSE 0.0 END " for h, p, s in T.HINTS if h == c) + f"+ 0.0 AS {c}"
    for c in T.LANGS
)
_more = lambda c: " + " + _count("r", _q(T.MORE_CUES[c].replace("(?:_[^ ]+)", "(?:  [^ ]+)").replace("_plus", "  plus").replace("_", " ") + " ")) if c in T.MORE_CUES else ""
_NEG = " ".join(f"WHEN lang = '{c}' THEN {_count('r', _terms(T.NEGATION[c]))}{_more(c)}" for c in T.LANGS)
_IDIOM = " ".join(f"WHEN lang = '{c}' THEN regexp_replace(t, {_terms(T.IDIOMS[c])}, ' ', 'g')" for c in T.LANGS)
# an abbreviation is kept with what follows it; twice, as one may follow another
_KEPT = _q(rf"(^|[^\p{{L}}\p{{N}}])((?i:{T.ABBREVIATIONS}))\.(\s+\p{{Ll}}|\s+\d|\s*\p{{L}}\.)")
_SENT = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
for _ in range(2):
    _SENT = rf"regexp_replace({_SENT}, {_KEPT}, '\1\2' || chr(3) || '\3', 'g')"
_SENT = rf"""regexp_replace(regexp_replace({_SENT}, '([.!?…;]+["»”)]*)[ \t\x{{00a0}}]+', '\1' || chr(2), 'g'), chr(3), '.', 'g')"""
_HITS = f"""s AS (SELECT lower(substr(trim(lang), 1, 2)) AS lang, unnest(chunks) AS c FROM {_u('feedback', 'id')}), w AS (SELECT lang, c.finding AS finding, unnest(list_distinct({_words('c.span')})) AS term FROM s WHERE c.span IS NOT NULL AND lang <> ''),
  k AS (SELECT lang, term, finding, count(*) AS n FROM w WHERE length(term) >= {KEYWORD_LETTERS} GROUP BY lang, term, finding), n AS (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS al FROM k), t AS (SELECT lang, term, finding FROM n WHERE finding IS NOT NULL AND n >= {KEYWORD_SPANS} AND n >= {KEYWORD_SHARE} * al),
  c AS (SELECT chunk_id, c.message_id, lower(substr(trim(m.lang), 1, 2)) AS lang, unnest(list_distinct({_words('text')})) AS word FROM {_u('review_chunks', 'chunk_id')} c LEFT JOIN {_u('messages_stored', 'message_id')} m ON m.message_id = c.message_id WHERE text IS NOT NULL),
  h AS (SELECT DISTINCT chunk_id, message_id, finding FROM c JOIN t ON <hit> AND (c.lang = t.lang OR c.lang IS NULL OR c.lang NOT IN (SELECT lang FROM t)))"""
ORACLE = {
    "fold_words": f"SELECT doc_id, CASE WHEN text IS NULL THEN -1 ELSE len({_words('text')}) END AS n_words, md5(coalesce(array_to_string({_words('text')}, ' '), '')) AS words_md5 FROM documents",
    "word_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY word",
    "fingerprint_exact_groups": f"SELECT substr(sha256(array_to_string({_words('text')}, ' ')), 1, 28) AS fp, count(*) AS n FROM {_u('messages_raw', 'message_id')} WHERE len({_words('text')}) > 0 GROUP BY 1 HAVING count(*) > 1",
    "lang_guess_summary": f"""WITH s AS (SELECT lang, {_SCORES} FROM (SELECT lang, text, {_words('text')} AS w FROM documents WHERE text IS NOT NULL)),
      b AS (SELECT *, greatest(en, fr, de, es) AS best, en + fr + de + es AS total FROM s),
      g AS (SELECT coalesce(lang, 'none') AS declared, CASE WHEN best < 1 THEN 0.0 ELSE best / total END AS p, CASE WHEN en = best THEN 'en' WHEN fr = best THEN 'fr' WHEN de = best THEN 'de' ELSE 'es' END AS l, best FROM b)
      SELECT declared, CASE WHEN best < 1 OR p < 0.5 THEN 'unknown' ELSE l END AS guess, count(*) AS n, round(avg(p), 6) AS mean_p FROM g GROUP BY 1, 2""",
    "negation_flags": f"""WITH z AS (SELECT id, lower(substr(trim(lang), 1, 2)) AS lang, {_spaced('text')} AS t FROM {_u('feedback', 'id')} WHERE text IS NOT NULL),
      a AS (SELECT id, lang, CASE {_IDIOM} ELSE regexp_replace(t, {_terms(sum(T.IDIOMS.values(), []))}, ' ', 'g') END AS c FROM z),
      b AS (SELECT id, lang, {_count('c', _terms(T.UNCERTAIN))} > 0 AS unsure, regexp_replace(c, {_terms(T.UNCERTAIN)}, ' ', 'g') AS r FROM a),
      n AS (SELECT id, lang, unsure, CASE {_NEG} ELSE {_count('r', _terms(sum(T.NEGATION.values(), [])))}{''.join(map(_more, T.MORE_CUES))} END AS cues FROM b)
      SELECT id, unsure OR cues > 0 AS negated, unsure OR (cues >= 2 AND NOT coalesce(lang IN ('fr', 'es'), false)) AS uncertain, cues FROM n""",
    "guide_mentions": f"""SELECT id, CASE lower(substr(trim(lang), 1, 2)) {' '.join(f"WHEN '{c}' THEN regexp_matches({_spaced('text')}, {_terms(T.GUIDE[c] + (T.GUIDE['en'] if c != 'en' else []))})" for c in T.LANGS)}
      ELSE regexp_matches({_spaced('text')}, {_terms(sum(T.GUIDE.values(), []))}) END AS guide FROM {_u('feedback', 'id')} WHERE text IS NOT NULL""",
    "phantom_filter": rf"""SELECT clip_id, NOT regexp_matches(transcript, '[\p{{L}}\p{{N}}]') OR regexp_matches(transcript, {_q("(?i)" + T.CREDITS)})
      OR trim(regexp_replace(transcript, '\[[^\]]*\]|\([^)]*\)|♪', '', 'g')) = '' AS phantom FROM {_u('transcripts', 'clip_id')} WHERE transcript IS NOT NULL""",
    "sentences_exploded": f"""WITH s AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array({_SENT}, '[' || chr(2) || chr(10) || ']+'), lambda p: trim(p)), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')) AS l FROM {_u('review_chunks', 'chunk_id')} WHERE text IS NOT NULL)
      SELECT chunk_id, unnest(range(len(l)))::INT AS sentence_index, unnest(l) AS sentence FROM s""",
    "length_classes": f"""SELECT CASE WHEN n <= 3 THEN 'very_short' WHEN n <= 8 THEN 'short' WHEN n >= 40 THEN 'long' ELSE 'medium' END AS length_class, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS n FROM {_u('feedback', 'id')} WHERE text IS NOT NULL) GROUP BY 1""",
    "wer_normalise": rf"""SELECT clip_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(transcript, {_q(T.compatible_letters()[0])}, {_q(T.compatible_letters()[1])})), '\[[^\]]*\]|\([^)]*\)|<[^>]*>', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}'']', ' ', 'g'), ' +', ' ', 'g'))) AS norm_md5 FROM {_u('transcripts', 'clip_id')} WHERE transcript IS NOT NULL""",
    "gsm7_length": f"""SELECT id, length(translate(text, {_q(T.GSM_BASIC + T.GSM_EXTENDED)}, '')) = 0 AS gsm7, (length(text) * 2 - length(translate(text, {_q(T.GSM_EXTENDED)}, '')))::INT AS septets, true AS sendable FROM {_u('feedback', 'id')} WHERE text IS NOT NULL""",
    "share_intake": f"""SELECT source, count(*) AS queued FROM {_u('messages_raw', 'message_id')} WHERE text IS NOT NULL AND NOT regexp_matches(text, '^https?://\\S+$') GROUP BY source""",
    "pii_emails": f"SELECT chunk_id, len(regexp_extract_all(text, {_q(pii.EMAIL)})) AS emails FROM {_u('review_chunks', 'chunk_id')} WHERE len(regexp_extract_all(text, {_q(pii.EMAIL)})) > 0",
    "pii_handles": f"SELECT chunk_id, len(regexp_extract_all(' ' || text, '[^\\w@.]@[A-Za-z_]\\w+')) AS handles FROM {_u('review_chunks', 'chunk_id')} WHERE len(regexp_extract_all(' ' || text, '[^\\w@.]@[A-Za-z_]\\w+')) > 0",
    "char_errors": f"""SELECT chunk_id, levenshtein(regexp_replace(text, '[^ -~]', '?', 'g'), regexp_replace(english_mt, '[^ -~]', '?', 'g'))::INT AS edits FROM {_u('review_chunks', 'chunk_id')} WHERE text IS NOT NULL AND english_mt IS NOT NULL""",
    "token_jaccard": f"""WITH s AS (SELECT id, text, unnest(chunks) AS c FROM {_u('feedback', 'id')} WHERE text IS NOT NULL), m AS (SELECT id, list_distinct({_words('text')}) AS a, list_distinct({_words('c.span')}) AS b FROM s WHERE c.span IS NOT NULL)
      SELECT id, len(a)::INT AS na, len(b)::INT AS nb, len(list_intersect(a, b))::INT AS "both", round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM m""",
    "untranslated_words": f"""WITH m AS (SELECT chunk_id, len(list_intersect(list_distinct(list_transform(list_filter({_words('text')}, lambda w: length(w) >= 5), lambda w: substr(w, 1, 5))), list_distinct(list_transform(list_filter({_words('english_mt')}, lambda w: length(w) >= 5), lambda w: substr(w, 1, 5)))))::INT AS leaks FROM {_u('review_chunks', 'chunk_id')} WHERE text IS NOT NULL AND english_mt IS NOT NULL)
      SELECT * FROM m WHERE leaks > 0""",
} | {
    f"keyword_hits_{mode}": f"WITH {_HITS.replace('<hit>', hit)} SELECT finding, count(DISTINCT chunk_id) AS chunks FROM h GROUP BY finding" for mode, hit in (("prefix", "starts_with(word, term)"), ("word", "word = term"))
} | {
    "keyword_list": f"WITH {_HITS.replace('<hit>', 'word = term')} SELECT lang, term, finding FROM t",
    "keyword_messages": f"WITH {_HITS.replace('<hit>', 'word = term')} SELECT message_id, string_agg(DISTINCT finding, ',' ORDER BY finding) AS findings FROM h GROUP BY message_id",
    "sms_uris": f"SELECT id, length('sms:+250700000000?body=' || url_encode(text))::INT AS uri_length FROM {_u('feedback', 'id')} WHERE text IS NOT NULL",
}
