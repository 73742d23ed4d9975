"""PII1 to PII11: ordered scrubbing of messages before anything is stored. Each stage sees the previous one's output."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SPOKEN_EMAIL = r"(?i)[a-z0-9._]+ (?:at|arobase|arroba) [a-z0-9-]+ (?:dot|point|punkt|punto) [a-z]{2,}"
HANDLE = r"(?<![\w@.])@[A-Za-z_]\w+"
PHONE = r"(?<![\w.,/-])(?:\+|00)?\(?\d(?:[ ().\-/\u00a0]{0,2}\d){6,14}(?![\w])"

# fixed values of this project: number words, cues and titles of the four languages
DIGITS = "zero one two three four five six seven eight nine zéro un deux trois quatre cinq sept huit neuf null eins zwei drei vier fünf sechs sieben acht neun cero uno dos tres cuatro seis siete ocho nueve".split()
CUES = "my name is|i am called|je m'appelle|ich heiße|mein name ist|me llamo|signed,?|signé|gezeichnet|firmado,?"
TITLES = "mr|mrs|ms|dr|madame|monsieur|mme|frau|herr|señora|señor|sra|sr"
THANKS = "thank|thanks to|merci à|danke an|gracias a|ask for|demandez|pregunten por|fragt nach"
GIVEN = set("anna alice bruno clara julia simon hugo victor marta pablo lucía irene mateo jonas lena felix omar paul emil greta nadia keza mutesi gatete ineza".split())
AMBIGUOUS = set("grace rose will may mark faith".split())
NOT_NAMES = set("i the a we it they our this in on at no not from le la les un nous je il el los yo nos der die das wir ich es".split())
# capitalised words inside sentences that are no names: places, languages, calendar, titles, streets, brands, units, coffee
KNOWN = NOT_NAMES | set(TITLES.split("|")) | set(
    """rwanda kigali uganda kenya tanzania burundi congo ethiopia africa afrique áfrica europe europa america amérique américa asia asie england britain scotland ireland france germany allemagne alemania spain espagne españa italy
    italie italia portugal belgium belgique bélgica switzerland suisse suiza netherlands holland canada mexico méxico brazil india china japan usa uk kivu musanze huye rubavu nyungwe paris london londres berlin madrid rome roma brussels
    bruxelles geneva genève zurich vienna lisbon nairobi kampala english french german spanish italian dutch portuguese swahili kinyarwanda african american european british swiss belgian rwandan kenyan ugandan chinese japanese indian
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december christmas easter noël pâques navidad covid
    st sta street road rd ave avenue lane crescent drive square apt flat unit nr no núm rue calle plaza ud uds usted ustedes sir madam miss prof doctor god dieu dios
    whatsapp google facebook instagram youtube tripadvisor airbnb uber visa mastercard paypal toyota wifi wi-fi internet bluetooth euro euros franc francs dollar dollars shilling shillings ok okay wow app radio tv
    arabica robusta bourbon espresso he she you me my his her its these those that there what when where why how and but so if for with and to of as by is was are were be do did has had more please nobody everyone everything
    elle il ils elles vous on ce c'est cette ces mon ma mes notre nos votre vos et mais si pour avec sur dans en à au aux du des tout tous très merci bonjour personne ella ellos ellas nosotros esto esta este estos su sus mi y pero con
    sin por para en al del lo las una unos muy gracias hola nadie i'm i've i'd i'll it's we're we've that's don't""".split()
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"

# whole words only, so that brands with capitals inside keep their beginning; unlike ``re`` this takes a look-behind of any width
_INSIDE_WORD = r"\p{Lu}[\p{Ll}\p{Lm}'’]+(?:-\p{Lu}[\p{Ll}\p{Lm}]+)*(?![\p{L}\p{N}])"
INSIDE = regex.compile(rf"(?<=[\p{{L}}\p{{N}},;'’)][^\S\n]+){_INSIDE_WORD}(?:\s+{_INSIDE_WORD}){{0,2}}")


def spoken_numbers(text: str) -> tuple[str, int]:
    """TXT31/PII4: runs of at least four number words or digits that make 7 to 15 digits."""
    word = "|".join(sorted(DIGITS, key=len, reverse=True))
    n = 0

    def put(m):
        nonlocal n
        said = re.findall(rf"(?i)\b(?:{word})\b|\d", m[0])
        if 7 <= len(said) <= 15:
            n += 1
            return "[number]"
        return m[0]

    return re.sub(rf"(?i)\b(?:(?:{word}|\d)[\s,-]+){{3,}}(?:{word}|\d)\b", put, text), n


def names(text: str, lang: str | None) -> tuple[str, int]:
    """PII5 to PII11: cues, titles, thanks, capitals inside sentences (not German; not KNOWN words), dictionary, ambiguous names, merging."""
    n = 0

    def hide(m):
        nonlocal n
        w = m["n"]
        if w.lower() in NOT_NAMES:
            return m[0]
        n += 1
        return m[0].replace(w, "[name]", 1) if m[0].count(w) == 1 else m[0][: m.start("n") - m.start()] + "[name]"

    for cue in (CUES, THANKS):
        text = re.sub(rf"(?i:\b(?:{cue}))\s+(?P<n>{_CAP})", hide, text)
    text = re.sub(rf"(?i:\b(?:{TITLES}))\.?\s+(?P<n>{_CAP})", hide, text)
    if not (isinstance(lang, str) and lang.strip().lower().startswith(("de", "ger"))):

        def inside(m):
            nonlocal n
            if all(regex.sub(r"['’]s$", "", w.lower()) in KNOWN for w in m[0].split()):
                return m[0]
            n += 1
            return "[name]"

        text = INSIDE.sub(inside, text)
    text = re.sub(r"(?P<n>\b[^\W\d_][\w'’-]*\b)", lambda m: hide(m) if m["n"].lower() in GIVEN else m[0], text)
    text = re.sub(rf"\b(?P<n>{'|'.join(sorted(AMBIGUOUS))})\b(?=\s+(?:and|et|und|y)\s+(?:I|moi|ich|yo|\[name\]))", hide, text, flags=re.I)
    text = re.sub(rf"(?<=\[name\])\s+{_CAP}", "", text)
    return re.sub(r"\[name\](?:[\s-]+\[name\])+", "[name]", text), n


def scrubbed(rows: DataFrame) -> DataFrame:
    """The rows with clean, names, phones, emails, handles; a null text stays null with counts of 0.

    Stages 1 to 3 are built-in expressions; 4 to 11 share one Arrow call so that their order holds.
    """
    t = F.col("text")
    emails = F.regexp_count(t, F.lit(EMAIL)) + F.regexp_count(t, F.lit(SPOKEN_EMAIL))
    t1 = F.regexp_replace(F.regexp_replace(t, EMAIL, "[email]"), SPOKEN_EMAIL, "[email]")
    t2 = F.regexp_replace(t1, HANDLE, "[handle]")
    t3 = F.regexp_replace(t2, PHONE, "[number]")

    @F.pandas_udf("clean string, names int, spoken int")
    def rest(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        out = []
        for x, lang in zip(texts, langs):
            if x is None or x is pd.NA:
                out.append((None, 0, 0))
                continue
            x, spoken = spoken_numbers(x)
            x, n = names(x, lang)
            out.append((x, n, spoken))
        return pd.DataFrame(out, columns=["clean", "names", "spoken"])

    counted = rows.withColumns({"emails": F.coalesce(emails, F.lit(0)), "handles": F.coalesce(F.regexp_count(t1, F.lit(HANDLE)), F.lit(0)), "written": F.coalesce(F.regexp_count(t2, F.lit(PHONE)), F.lit(0))})
    out = counted.withColumn("r", rest(t3, F.col("lang")))
    return out.withColumns({"clean": F.col("r.clean"), "names": F.col("r.names"), "phones": F.col("written") + F.col("r.spoken")}).drop("r", "written")
