"""Scalar text functions as built-in expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
LANGS = ("en", "fr", "de", "es")


@lru_cache(maxsize=1)
def plain_letters() -> tuple[str, str]:
    """Every character of the basic plane that is another one plus marks or in another form, and that other one: by Unicode's compatibility rule."""
    src, dst = [], []
    for cp in range(0xA0, 0xFFFF):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")]
        if len(base) == 1 and base[0] != c:
            src.append(c)
            dst.append(base[0])
    return "".join(src), "".join(dst)


@lru_cache(maxsize=1)
def compatible_letters() -> tuple[str, str]:
    """Of these, the ones that are another form of a letter or digit and carry no mark (full-width, circled, raised)."""
    pairs = [(s, d) for s, d in zip(*plain_letters()) if unicodedata.normalize("NFKC", s) == d and unicodedata.normalize("NFC", s) == s and d.isalnum()]
    return "".join(s for s, _ in pairs), "".join(d for _, d in pairs)


@lru_cache(maxsize=1)
def joined_letters() -> dict[str, str]:
    """Ligatures, vulgar fractions and digraphs: one character that stands for several letters or digits."""
    found = {}
    for cp in (*range(0xBC, 0xBF), *range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0xFB00, 0xFB07)):
        parts = "".join(x for x in unicodedata.normalize("NFKD", chr(cp).lower()) if not unicodedata.category(x).startswith("M"))
        if len(parts) > 1:
            found[chr(cp).lower()] = parts
    return found


def fold(text: Column) -> Column:
    """TXT1. Straight apostrophes, lower case, ss for ß, compatible forms and letters without accents. Null stays null."""
    src, dst = plain_letters()
    low = F.regexp_replace(F.lower(F.regexp_replace(text, "[‘’ʼ´`]", "'")), "ß", "ss")
    apart = low
    for one, several in joined_letters().items():
        apart = F.replace(apart, F.lit(one), F.lit(several))
    low = F.when(low.rlike("[" + "".join(joined_letters()) + "]"), apart).otherwise(low)
    return F.regexp_replace(F.translate(low, src, dst), r"\p{M}", "")


def words(text: Column) -> Column:
    """TXT2. Folded tokens of letters and digits with inner apostrophes."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """TXT8. Runs of letters and digits; an apostrophe inside makes two."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def padded(text: Column) -> Column:
    """The words between single spaces, with one at either end: whole words are found by plain containment."""
    return F.concat(F.lit(" "), F.concat_ws(" ", words(text)), F.lit(" "))


def term_pattern(terms: list[str]) -> str:
    """TXT3/TXT4. Whole-word matcher over padded text: longest first, inner spaces flexible, ``term*`` is a prefix."""
    parts = []
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        body = r"\s+".join(re.escape(p) for p in t.rstrip("*").split())
        parts.append(body + (r"[^ ]*" if t.endswith("*") else ""))
    return " (?:" + "|".join(parts) + ")(?= )"


def re2_pattern(terms: list[str]) -> str:
    """The same without look-ahead, for engines that lack it; matches once per place."""
    return term_pattern(terms).replace("(?= )", " ")


# fixed values of this project: frequent words by which a language is guessed
STOP_WORDS = {
    "en": "the and is was were of to in we it for with that this you not our have had very".split(),
    "fr": "le la les et est une des du nous vous pas que qui dans pour avec sur etait a au".split(),
    "de": "der die das und ist war wir nicht ein eine mit auf fur von den dem zu uns sehr es".split(),
    "es": "el la los las y es una que no de en para con por nos muy fue se del al".split(),
}
# fixed values: letters that speak for a language, with the points they give
HINTS = (("es", "[ñ¿¡]", 2.0), ("es", "[áíóú]", 1.0), ("de", "[äöüß]", 2.0), ("fr", "[àâçèêëîïôœù]", 1.5))


def _among(listed: list[str]):
    return lambda x: x.isin(listed)


def language_scores(text: Column) -> dict[str, Column]:
    """``scores_in`` of a raw text; where many texts are read, make its words and lower case columns of their own first."""
    return scores_in(words(text), F.lower(text))


def scores_in(w: Column, low: Column) -> dict[str, Column]:
    """Stop-word hits of each language among the words, plus letter hints in the lower-cased text."""
    out = {}
    for lang in LANGS:
        s = F.size(F.filter(w, _among(STOP_WORDS[lang]))).cast("double")
        for hint, letters, points in HINTS:
            if hint == lang:
                s = s + F.when(low.rlike(letters), points).otherwise(0.0)
        out[lang] = s
    return out


def guess_from(scores: dict[str, Column]) -> tuple[Column, Column]:
    """TXT10. (language, share): best over total of at least one half, else ``unknown``; below one hit ``unknown`` with 0."""
    best = F.greatest(*scores.values())
    total = sum(scores.values(), F.lit(0.0))
    lang = F.lit("unknown")
    for code in reversed(LANGS):
        lang = F.when(scores[code] == best, code).otherwise(lang)
    share = F.when(best < 1, 0.0).otherwise(best / total)
    return F.when((best < 1) | (share < 0.5), "unknown").otherwise(lang), share


def by_language(lang: Column, patterns: dict[str, str], text: Column) -> Column:
    """TXT9. Does the language's pattern occur? An unknown language takes all patterns."""
    out = text.rlike("|".join(patterns.values()))
    for code, p in patterns.items():
        out = F.when(lang == code, text.rlike(p)).otherwise(out)
    return out


# fixed values of this project: words that negate, idioms that do not, and words for the guide
NEGATION = {
    "en": ["not", "no", "never", "nobody", "nothing", "none", "without", "neither", "nor"],
    "fr": ["pas", "jamais", "rien", "personne", "aucun", "aucune", "sans", "ni"],
    "de": ["nicht", "kein*", "nie", "niemand", "nichts", "ohne"],
    "es": ["no", "nunca", "nada", "nadie", "ningun*", "sin", "tampoco"],
}
IDIOMS = {
    "en": ["no doubt", "not only", "no problem"],
    "fr": ["pas seulement", "sans doute", "pas mal"],
    "de": ["nicht nur", "ohne zweifel"],
    "es": ["no solo", "sin duda"],
}
#: Further cues: any contracted not, and "no longer" in French around its verb. ``_`` is the space between words.
MORE_CUES = {"en": "_[^ ]+n't", "fr": "_ne(?:_[^ ]+){1,3}_plus"}
UNCERTAIN = ["not sure", "not really", "pas vraiment", "pas sur", "nicht wirklich", "nicht sicher", "no estoy seguro", "no mucho", "hardly", "kaum", "apenas", "a peine"]
GUIDE = {
    "en": ["guide*", "host", "hosts"],
    "fr": ["guide*", "hote", "hotes", "accompagnat*"],
    "de": ["fuhrer*", "reiseleit*", "gastgeber*"],
    "es": ["guia*", "anfitrion*"],
}


def negation(text: Column, lang: Column) -> Column:
    """``negation_in`` of a raw text; where many texts are read, make ``padded`` a column of its own first."""
    return negation_in(padded(text), lang)


def negation_in(t: Column, lang: Column) -> Column:
    """TXT11. struct<negated, uncertain, cues>: idioms leave first, then uncertain phrases, then cues are counted.

    Two cues or more are uncertain, except in French and Spanish, where they agree with each other.
    """
    per = lambda of, every: F.coalesce(*[F.when(lang == c, of(c)) for c in LANGS], every)
    clean = per(lambda c: F.regexp_replace(t, term_pattern(IDIOMS[c]), ""), F.regexp_replace(t, term_pattern(sum(IDIOMS.values(), [])), ""))
    unsure = F.regexp_count(clean, F.lit(term_pattern(UNCERTAIN))) > 0
    rest = F.regexp_replace(clean, term_pattern(UNCERTAIN), "")
    count = lambda p: F.regexp_count(rest, F.lit(p))
    more = lambda c: count(MORE_CUES[c].replace("_", " ") + "(?= )") if c in MORE_CUES else F.lit(0)
    cues = per(lambda c: count(term_pattern(NEGATION[c])) + more(c), count(term_pattern(sum(NEGATION.values(), []))) + sum((more(c) for c in MORE_CUES), F.lit(0)))
    double = (cues >= 2) & ~F.coalesce(lang.isin("fr", "es"), F.lit(False))
    return F.struct((unsure | (cues > 0)).alias("negated"), (unsure | double).alias("uncertain"), cues.alias("cues"))


def mentions_guide(text: Column, lang: Column) -> Column:
    """TXT12. The language's words and the English ones; all of them where the language is unknown."""
    patterns = {c: term_pattern(GUIDE[c] + (GUIDE["en"] if c != "en" else [])) for c in LANGS}
    return by_language(lang, patterns, padded(text))


def is_phantom(text: Column) -> Column:
    """TXT13. Neither letters nor digits, subtitle credits, or nothing but bracketed tags."""
    only_tags = F.trim(F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)|♪", "")) == ""
    return ~text.rlike(r"[\p{L}\p{N}]") | text.rlike("(?i)" + CREDITS) | only_tags


# fixed values of this project: how subtitles name their makers
CREDITS = r"(subtitles? by|sous-titr(?:es|age) |untertitel(?:ung)? (?:von|der|im auftrag)|subt[ií]tulos? (?:por|de la comunidad)|thanks for watching|amara\.org)"


def fingerprint(text: Column) -> Column:
    """TXT16. 28 hex digits of the words' SHA-256; equal for texts with equal words, null for one without any."""
    plain = F.concat_ws(" ", words(text))
    return F.when(plain != "", F.substring(F.sha2(plain, 256), 1, 28))


def wer_normalised(text: Column) -> Column:
    """TXT17. Compatible forms, lower case, bracketed text dropped, punctuation to spaces, accents kept."""
    t = F.regexp_replace(F.lower(F.translate(text, *compatible_letters())), r"\[[^\]]*\]|\([^)]*\)|<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}']", " "), " +", " "))


# fixed values: the GSM 7-bit default alphabet and its extension table
GSM_BASIC = "@£$¥èéùìòÇ\nØø\rÅåΔ_ΦΓΛΩΠΨΣΘΞÆæßÉ !\"#¤%&'()*+,-./0123456789:;<=>?¡ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÑÜ§¿abcdefghijklmnopqrstuvwxyzäöñüà"
GSM_EXTENDED = "\f^{}\\[~]|€"


def _cls(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


def is_gsm7(text: Column) -> Column:
    """TXT25. Can every character be sent in the 7-bit alphabet? True for the empty text."""
    return F.length(F.translate(text, GSM_BASIC + GSM_EXTENDED, "")) == 0


def gsm7_length(text: Column) -> Column:
    """TXT25. Septets; characters of the extension table take two."""
    return F.length(text) * 2 - F.length(F.translate(text, GSM_EXTENDED, ""))


def to_gsm7(text: Column) -> Column:
    """TXT26. Typographic characters by their plain forms, else the letter without accent, else ``?``."""
    t = F.regexp_replace(F.regexp_replace(F.translate(text, "‘’‚“”„«»–—\u00a0\u202f", "'''\"\"\"\"\"--  "), "…", "..."), "œ", "oe")
    src, dst = plain_letters()
    kept = [(s, d) for s, d in zip(src, dst) if s not in GSM_BASIC and d in GSM_BASIC]
    t = F.translate(t, "".join(s for s, _ in kept), "".join(d for _, d in kept))
    return F.regexp_replace(t, "[^" + _cls(GSM_BASIC + GSM_EXTENDED) + "]", "?")


def sms_uri(number: Column, body: Column) -> Column:
    """TXT28. ``sms:`` link with a percent-encoded body."""
    return F.concat(F.lit("sms:"), number, F.lit("?body="), F.regexp_replace(F.url_encode(body), r"\+", "%20"))


def length_class(text: Column) -> Column:
    """MAP3. very_short up to 3 words, short up to 8, long from 40."""
    n = word_count(text)
    return F.when(n <= 3, "very_short").when(n <= 8, "short").when(n >= 40, "long").otherwise("medium")


def fill_slots(template: Column, slots: dict[str, Column]) -> Column:
    """TXT24. Replaces ``{name}``; a missing value is an error."""
    out = template
    for name, value in slots.items():
        safe = F.coalesce(value.cast("string"), F.raise_error(F.concat(F.lit(f"no value for {name} in "), template)).cast("string"))
        out = F.when(template.contains("{" + name + "}"), F.replace(out, F.lit("{" + name + "}"), safe)).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """TXT5. Pieces after end marks and white space, or line breaks; decimals and known abbreviations do not end one."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}])({ABBREVIATIONS})\.(?-i)(?=\s+\p{{Ll}}|\s+\d|\s*\p{{L}}\.)", "$1\u0003")
    t = F.regexp_replace(t, r"([.!?…;]+[\"»”)]*)[ \t\u00a0]+", "$1\u0002")
    parts = F.split(F.regexp_replace(t, "\u0003", "."), "[\u0002\n]+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike(r"[\p{L}\p{N}]"))


# fixed values of this project: abbreviations that do not end a sentence before a small letter, a digit or an initial
ABBREVIATIONS = r"Mr|Mrs|Ms|Mme|Mlle|Dr|St|Sta|Sra|Srta|Sr|Uds?|no|nr|núm|etc|env|approx|aprox|incl|vs|cf|ca|evtl|usw|bzw|u\.a|e\.g|i\.e|z\.B|z\. B|d\. h|p\. ex|p\.ej|p\. ej"
