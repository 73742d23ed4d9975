"""Personal information in free text (problem 2).

Kinds: email, phone, id_number, address, name. Numbers are validated by format and context; in the text they become typed
placeholders that carry a format-preserving pseudonym: a keyed Feistel permutation of their digits and letters within the
same format, so equal values stay linked across documents and nobody can read them back without the key. Names are found
by a dictionary of given names (taken from labelled sentences), by cues such as titles and introductions, and, where a
given name is also an ordinary word, by contexts counted over the whole corpus.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import secrets
import unicodedata
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import KNOWN
from ..sources.tables import table, unique

KINDS = ("email", "phone", "id_number", "address", "name")
#: Words, contexts and new names are kept from this share of all counted ones on, so that at most 1 / SHARE of each reach the driver;
#: a context is trusted from TRUSTED times on. Parts of labelled names that are taken: more than that are an error.
SHARE, TRUSTED, MAX_GIVEN = 2e-6, 3, 100_000
#: A given name in lower case this often against its capitalised uses is also a plain word.
PLAIN_SHARE = 0.3
ROUNDS = 10

# ---------------------------------------------------------------- format-preserving pseudonyms


def _feistel(value: int, left: int, right: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A keyed permutation of range(left * right); the halves keep their moduli and change roles each round."""
    a, b = divmod(value, right)
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    for i in order:
        half, m = (b, left) if i % 2 == 0 else (a, right)
        f = int.from_bytes(hmac.new(key, tweak + bytes([i]) + half.to_bytes(24, "big"), hashlib.sha256).digest(), "big")
        f = -f if back else f
        if i % 2 == 0:
            a = (a + f) % m
        else:
            b = (b + f) % m
    return a * right + b


def permute(symbols: str, alphabet: str, key: bytes, back: bool = False) -> str:
    """The symbols of one alphabet, permuted among all strings of their length."""
    n, r = len(symbols), len(alphabet)
    if not n:
        return symbols
    u = n // 2
    left, right = max(1, r**u), r ** (n - u)
    value = 0
    for c in symbols:
        value = value * r + alphabet.index(c)
    value = _feistel(value, left, right, key, f"{n}/{r}".encode(), back)
    out = []
    for _ in range(n):
        value, d = divmod(value, r)
        out.append(alphabet[d])
    return "".join(out[::-1])


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Digits and letters are permuted among themselves; everything else, and so the format, stays."""
    out = list(value)
    for alphabet in (_DIGITS, _UPPER, _LOWER):
        at = [i for i, c in enumerate(value) if c in alphabet]
        for i, c in zip(at, permute("".join(value[i] for i in at), alphabet, key, back)):
            out[i] = c
    return "".join(out)


def pseudonym_date(value: str, key: bytes, back: bool = False) -> str:
    """An ISO date becomes another valid one between 1900 and 2099 (cycle walking); anything else is returned as it is."""
    first = datetime.date(1900, 1, 1).toordinal()
    size = datetime.date(2099, 12, 31).toordinal() - first + 1
    try:
        x = datetime.date.fromisoformat(value).toordinal() - first
    except ValueError:
        return value
    if not 0 <= x < size:
        return value
    side = int(size**0.5) + 1
    while True:
        x = _feistel(x, side, side, key, b"date", back)
        if x < size:
            return datetime.date.fromordinal(first + x).isoformat()


# ---------------------------------------------------------------- patterns (our own; language words stand together as fixed values)

_DIGIT_WORDS = {
    "en": "zero oh one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei zwo drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_NUMBER_WORD = "|".join(sorted({w for s in _DIGIT_WORDS.values() for w in s.split()}, key=len, reverse=True))
_DIGIT_OF = {w: str(max(0, i - 1) if lang == "en" else i) for lang, ws in _DIGIT_WORDS.items() for i, w in enumerate(ws.replace("zwei zwo", "zwei").split())} | {"zwo": "2"}
_SAID = regex.compile(rf"{_NUMBER_WORD}|\d", regex.I)
#: Dates as year-month-day or day-month-year.
DATE = regex.compile(r"(?<!\d)(?:(?P<y>\d{4})(?P<s>-)(?P<m>\d\d)-(?P<d>\d\d)|(?P<d>\d\d)(?P<s>[./-])(?P<m>\d\d)(?P=s)(?P<y>\d{4}))(?!\d)")


def digits_of(phone: str) -> str:
    """A number with its spoken digits written; what is written in digits only stays as it is."""
    if not any(c.isalpha() for c in phone):
        return phone
    return "".join(_DIGIT_OF.get(w.lower(), w) for w in _SAID.findall(phone))


def pseudonym_written(value: str, key: bytes, back: bool = False) -> str:
    """A date in one of the written formats becomes another in the same one; anything that is no valid date stays."""
    m = DATE.fullmatch(value)
    if not m:
        return value
    new = pseudonym_date(f"{m['y']}-{m['m']}-{m['d']}", key, back)
    if new == f"{m['y']}-{m['m']}-{m['d']}":
        return value
    y, mo, d = new.split("-")
    return new if value[4] == "-" else m["s"].join((d, mo, y))


_AT = r"(?:\s*@\s*|\s*[\[({]\s*(?:at|arobase|arroba|a)\s*[\])}]\s*|\s+(?:at|arobase|arroba)\s+)"
_DOT = r"(?:\s*[\[({]\s*(?:dot|point|punkt|punto)\s*[\])}]\s*|\s+(?:dot|point|punkt|punto)\s+|\.)"
PLAIN_EMAIL = regex.compile(r"(?<![\p{L}\p{N}.+_-])[\p{L}\p{N}][\p{L}\p{N}.+_-]*@(?=[\d-]*\p{L})[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}")
EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}.+_-])[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}.+_-]|{_DOT}(?=[\p{{L}}\p{{N}}]))*{_AT}(?=[\d-]*\p{{L}})[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)*{_DOT}\p{{L}}{{2,}}", regex.I)
_GOODS = regex.compile(
    r"(?:\b(?:bag|sack|sac|saco|sacks?|lot|lote|charge|batch|ticket|billet|billete|fahrschein|table|tisch|mesa|pay\w*|pag\w+|bezahlt|payé|room|zimmer|house|haus)\b|@)[\s:.]*(?:no|nr|núm|num|n)?[\s.:º°]*(?:\p{L}\d+/)?$",
    regex.I,
)
PHONE = regex.compile(r"(?<![\p{L}\p{N}/.,-])(?:\+|00)?\(?\d[\d\s().\-/  ]{5,22}\d(?![\p{L}\p{N}]|[.,]\d)")
PHONE_CUE = regex.compile(r"(?:tel|phone|whatsapp|call|ring|appel\w*|llam\w+|ruft|anruf\w*|number|numéro|número|nummer|au|handy|móvil|portable|mobile)\W*(?:me|le|al|bitte|au)?[\s.:,]*$", regex.I)
SPOKEN = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?:\+\s*)?(?:{_NUMBER_WORD}|\d{{1,3}})(?:[\s,.\-]+|(?=$))){{6,}}(?:{_NUMBER_WORD}|\d{{1,3}})(?![\p{{L}}\p{{N}}])", regex.I)
_ID_CUE = r"(?:passports?|passeport|pasaporte|pass|reisepass|id|identity|identité|identidad|ausweis\w*|personalausweis\w*|cédula|dni|documento|card|carte|karte|tarjeta|permit|permiso|permis|holder|titulaire|titular|inhaber\w*)"
ID_CUE = regex.compile(rf"(?<![\p{{L}}]){_ID_CUE}(?![\p{{L}}])(?:[^.!?…\n]|(?<=(?<!\p{{L}})(?:no|nr|n|núm))\.){{0,34}}$", regex.I)
ID = regex.compile(
    r"(?<![\p{L}\p{N}/-])(?:ID-?\d{12,18}|\d(?:[ -]?\d{4})[ -]?\d[ -]?\d{7}[ -]?\d[ -]?\d{2}|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d|\p{Lu}{2}\d{6,8}|\d{7,8}[- ]?\p{Lu}|\p{Lu}\d[\p{Lu}\d]{5,9}\d?)(?![\p{L}\p{N}]|/\d|-\d)",
    regex.I,
)
SURE_ID = regex.compile(r"(?:ID-?\d{12,18}|\d[ -]?\d{4}[ -]?\d[ -]?\d{7}[ -]?\d[ -]?\d{2}|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d)$", regex.I)
_W = r"[\p{L}\p{M}'’-]+"
# house numbers, street words and their order in four languages
_EN_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|crescent|close|drive|way|square|court|place|terrace|hill|boulevard|blvd)"
_FR_STREET = r"(?:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|route|quai|cours)"
_ES_STREET = r"(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carretera|callejón|pasaje)"
_DE_STREET = r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|hof|chaussee|pfad|stieg|graben|wall|berg)"
ADDRESS = [
    regex.compile(p, regex.I)
    for p in (
        rf"(?<![\p{{L}}\p{{N}}])\d{{1,4}}(?:\s*(?:bis|ter|quater|[a-d]))?\s*,?\s+{_FR_STREET}(?![\p{{L}}])\.?\s+(?:(?:du|de|des|de\s+la|d['’])\s*)?{_W}(?:\s*,\s*\d+\s*(?:e|er|ème|ère)\s+étage)?",
        rf"(?<![\p{{L}}\p{{N}}])(?:(?:flat|apt|unit)\.?\s*\d+\s*,\s*)?\d{{1,4}}\p{{L}}?\s+{_W}(?:\s+{_W})?\s+{_EN_STREET}(?![\p{{L}}])\.?(?:,?\s*(?:apt|flat|unit|no)\.?\s*\d+)?",
        rf"(?<![\p{{L}}]){_ES_STREET}\s*(?:(?:de|del|de\s+la|de\s+los)\s+)?{_W}(?:\s+{_W})?\s*,?\s*(?:n\.?\s*º|núm\.?|n[oº]\.?|número)?\s*\d{{1,4}}(?:\s*,\s*\d+\s*[ºª]\s*\p{{L}}?)?",
        rf"(?<![\p{{L}}])(?:{_W}{_DE_STREET}|{_W}[ -](?:straße|strasse|str\.|weg|gasse|platz|allee))\s*(?:nr\.?\s*)?\d{{1,4}}\s?[a-z]?(?![\p{{L}}\p{{N}}%])",
        rf"(?<![\p{{L}}])(?:am|an\s+der|an\s+dem|im|in\s+der|auf\s+der|zum|zur|unter\s+den|hinter\s+der)\s+\p{{Lu}}{_W}\s+\d{{1,4}}\s?[a-z]?(?![\p{{L}}\p{{N}}.,:]\d|\s*(?:minuten|leute|euro|franc|prozent|bäume|m\b|km\b|uhr))",
        r"(?<![\p{L}\p{N}])(?:KG|KN|KK|NR|RN)\s*\d{1,3}\s+(?:st|ave|rd)(?![\p{L}])\.?\s*(?:,?\s*(?:house|no|n\.?º|nr|maison|casa|haus)\.?)?\s*\d{0,4}",
    )
]
#: What every find of these needs, looked for first: a sign for at, a digit, a street word.
_MAYBE_EMAIL = re.compile(r"@|arobase|arroba|\bat\b|[\[({]\s*a\s*[\])}]", re.I)
_DIGIT = re.compile(r"\d")
_STREET_HINTS = [None, None, None, re.compile("stra(?:ß|ss)e|str\\.|weg|gasse|platz|allee|ring|ufer|damm|steig|hof|chaussee|pfad|stieg|graben|wall|berg", re.I), None, None]
_TITLE = r"(?:mr|mrs|ms|miss|dr|prof|sir|madam|monsieur|madame|mme|mlle|mademoiselle|m|herr|frau|señora|señor|sra|sr|srta|don|doña|doctor|doctora|docteur|dhr|mevr|dott|sig|sig\.ra)"
_FAMILY = r"(?:family|famille|familie|familia)"
NAME_CUES = [
    regex.compile(rf"(?<![\p{{L}}]){_TITLE}\.?\s+(?P<n>\p{{Lu}}[\p{{L}}\p{{M}}'’-]+(?:\s+\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)?)", 0),
    regex.compile(rf"(?<![\p{{L}}])(?i:{_TITLE})\.?\s+(?P<n>\p{{Lu}}[\p{{L}}\p{{M}}'’-]+(?:\s+\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)?)"),
    regex.compile(rf"(?<![\p{{L}}])(?i:the)\s+(?P<n>\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)\s+family(?![\p{{L}}])"),
    regex.compile(rf"(?<![\p{{L}}])(?i:famille|familie|familia)\s+(?P<n>\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)"),
    regex.compile(r"(?<![\p{L}])(?i:my name is|i am called|je m['’]appelle|mon nom est|ich heiße|ich heisse|mein name ist|me llamo|mi nombre es)\s+(?P<n>\p{Lu}[\p{L}\p{M}'’-]+(?:\s+\p{Lu}[\p{L}\p{M}'’-]+)?)"),
    regex.compile(r"(?<![\p{L}])(?i:the one called|celui qui s['’]appelle|celle qui s['’]appelle|el que se llama|la que se llama|der junge mann namens|die junge frau namens)\s+(?P<n>\p{Lu}[\p{L}\p{M}'’-]+(?:\s+\p{Lu}[\p{L}\p{M}'’-]+)?)"),
    regex.compile(r"(?<![\p{L}])(?i:signed|signé|gezeichnet|firmado|please thank|ask for|demandez|fragt nach|pregunten por|the bill goes to|parcels please to|la facture est pour|les colis pour|die rechnung geht an|pakete bitte an|la factura va a|los paquetes para)\s*,?\s+(?P<n>\p{Lu}[\p{L}\p{M}'’-]+(?:\s+\p{Lu}[\p{L}\p{M}'’-]+)?)"),
]
# the same cues for texts in lower case; a lower-case title needs a word that the corpus does not know otherwise
_LOWER_CUES = [
    regex.compile(p.pattern.replace(r"\p{Lu}", r"\p{Ll}"), regex.I) for p in NAME_CUES
]
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|\d+|[^\s\p{L}\p{M}\d]")
# fixed values: articles and prepositions after which a lone given name is a plain word
_ARTICLES = set("the le la les un une der die das den dem ein eine im el los las una in".split())


def plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))


def context(tokens: list[str], a: int, b: int) -> tuple[str, str]:
    """The words around tokens a to b; numbers are one word, the text's ends another."""
    left = tokens[a - 1].lower() if a else "^"
    right = " ".join(t.lower() for t in tokens[b : b + 2]) or "$"
    return ("9" if left.isdigit() else left), regex.sub(r"\d+", "9", right)


class Finder:
    """Names, their corpus behaviour and the patterns above."""

    def __init__(self, given: set[str], ambiguous: set[str], contexts: Counter, words: set[str]):
        self.given, self.ambiguous, self.contexts, self.words = given, ambiguous, contexts, words

    def _names(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        cased = text != text.lower()
        out = []
        for p in NAME_CUES if cased else _LOWER_CUES:
            for m in p.finditer(text):
                word = regex.split(r"[\s-]", m["n"])[0]
                if cased or plain(word) in self.given or word.lower() not in self.words:
                    first = m["n"].split()
                    end = m.end("n")
                    if len(first) > 1 and first[1].lower() in self.words and plain(first[1]) not in self.given:
                        end = m.start("n") + len(first[0])
                    out.append((m.start("n"), end))
        ms = list(_TOKEN.finditer(text))
        tokens = [m[0] for m in ms]
        i = 0
        while i < len(tokens):
            w = tokens[i]
            g = plain(w)
            if g not in self.given or (cased and not w[0].isupper()):
                i += 1
                continue
            j = i + 1
            while j + 1 < len(tokens) and tokens[j] == "-" and plain(tokens[j + 1]) in self.given:
                j += 2
            k = j
            if k < len(tokens) and tokens[k][0].isalpha() and (not cased or tokens[k][0].isupper()) and tokens[k].lower() not in self.words:
                k += 1  # a family name
            ok = True
            if g in self.ambiguous and j == i + 1 and k == j:
                ok = self.contexts[context(tokens, i, k)] >= TRUSTED
            elif i and tokens[i - 1].lower() in _ARTICLES and k == j:
                ok = False
            if ok:
                out.append((ms[i].start(), ms[k - 1].end()))
            i = k
        return [s for s in out if not any(s[0] < b and a < s[1] for a, b in taken)]

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in order, without overlaps. Null, empty and blank texts have none; existing placeholders are kept."""
        if not text:
            return []
        found: list[tuple[int, int, str]] = [(m.start(), m.end(), "") for m in regex.finditer(r"\[(?:nom|numéro|name|phone|email|id_number|address)[^\]]*\]", text)]
        free = lambda a, b: not any(a < y and x < b for x, y, _ in found)
        if _MAYBE_EMAIL.search(text):
            for p in (PLAIN_EMAIL, EMAIL):
                found += [(*m.span(), "email") for m in p.finditer(text) if free(*m.span())]
        numbered = _DIGIT.search(text) is not None
        for m in ID.finditer(text) if numbered else ():
            cue = ID_CUE.search(text, max(0, m.start() - 60), m.start())
            if free(*m.span()) and (SURE_ID.match(m[0]) or cue) and sum(c.isdigit() for c in m[0]) >= 2 and not _GOODS.search(text, max(0, m.start() - 24), m.start()):
                found.append((*m.span(), "id_number"))
        streets = [p for p, hint in zip(ADDRESS, _STREET_HINTS) if hint is None or hint.search(text)] if numbered else []
        for p in streets:
            for m in p.finditer(text):
                if free(*m.span()):
                    found.append((*m.span(), "address"))
        for m in PHONE.finditer(text) if numbered else ():
            digits = [c for c in m[0] if c.isdigit()]
            if not 7 <= len(digits) <= 15 or not free(*m.span()):
                continue
            before = text[max(0, m.start() - 24) : m.start()]
            marked = m[0][0] in "+(" or m[0].startswith("00") or (digits[0] == "0" and len(digits) >= 10)
            if ID_CUE.search(text, max(0, m.start() - 60), m.start()) and not PHONE_CUE.search(before):
                found.append((*m.span(), "id_number"))
            elif (marked and not _GOODS.search(before)) or (PHONE_CUE.search(before) and not _GOODS.search(before)):
                found.append((*m.span(), "phone"))
        for m in SPOKEN.finditer(text):
            said = _SAID.findall(m[0])
            if 7 <= len(said) <= 15 and free(*m.span()):
                found.append((*m.span(), "phone"))
        taken = [(a, b) for a, b, _ in found]
        for a, b in sorted(set(self._names(text, taken)), key=lambda s: (s[0], -s[1])):
            if free(a, b):
                found.append((a, b, "name"))
        return sorted(f for f in found if f[2])

    def scrub(self, text: str | None, key: bytes, dates: bool = False) -> str | None:
        """The text with every find replaced by ``[kind]`` or, for numbers, ``[kind:pseudonym]``; all else unchanged.

        Equal numbers have equal pseudonyms under one key, whether written in digits or spoken. With ``dates`` valid dates
        between 1900 and 2099 become others in the same format; they are no personal data of their own, so by default they stay.
        """
        if not text:
            return text
        out, at = [], 0
        finds = self.find(text)
        if dates:
            finds = sorted([*finds, *((m.start(), m.end(), "date") for m in DATE.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in finds))])
        for a, b, kind in finds:
            value = text[a:b]
            if kind == "date":
                new = pseudonym_written(value, key)
            elif kind not in ("phone", "id_number"):
                new = f"[{kind}]"
            else:
                new = f"[{kind}:{pseudonym(digits_of(value) if kind == 'phone' else value, key)}]"
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:]


def learn(texts: DataFrame, labelled: DataFrame) -> Finder:
    """Given names of the labelled sentences (a fixed table), and how they and their contexts occur in all texts.

    Brought to the driver are contexts met TRUSTED times and words seen in lower case 5 times or more, both from SHARE of all
    counted words on. Labelled names of more than MAX_GIVEN different parts are refused.
    """
    names = labelled.select(F.explode("names").alias("n")).where("n <> ''").select(F.explode(F.split("n", r"(?U)[\s-]")).alias("n")).where("length(n) > 1").distinct().limit(MAX_GIVEN + 1).collect()
    if len(names) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} labelled names")
    given = {plain(r.n) for r in names}

    def count(batches):
        for pdf in batches:
            c: Counter = Counter()
            for text in pdf.text:
                if not text:
                    continue
                cased = text != text.lower()
                tokens = _TOKEN.findall(text)
                for i, w in enumerate(tokens):
                    if not w[0].isalpha():
                        continue
                    if cased and w[0].islower():
                        c["w", w.lower(), ""] += 1
                        c["l" if plain(w) in given else "p", plain(w), ""] += 1
                    elif plain(w) in given or (cased and len(w) > 2 and not w.isupper() and w.lower() not in KNOWN):
                        left, right = context(tokens, i, i + 1)
                        c["c" if plain(w) in given else "u", plain(w) + "\t" + left, right] += 1
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "a", "b", "n"])

    counts = texts.select("text").where("text IS NOT NULL").mapInPandas(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    lower = Counter({r.a: r.n for r in counts.where("kind = 'l'").collect()})  # at most the given names
    least = SHARE * (counts.agg(F.sum("n")).first()[0] or 0)
    words = {r.a for r in counts.where((F.col("kind") == "w") & (F.col("n") >= max(5, least))).collect()}
    contexts: Counter = Counter()
    # only names that are hardly ever plain words teach contexts
    named = counts.where("kind = 'c'").withColumn("g", F.substring_index("a", "\t", 1))
    upper = Counter({r.g: r.n for r in named.groupBy("g").agg(F.sum("n").alias("n")).collect()})  # at most the given names
    ambiguous = {g for g in given if lower[g] >= max(3, PLAIN_SHARE * upper[g])}
    sure = named.where(~F.col("g").isin(sorted(ambiguous)) if ambiguous else F.lit(True))
    for r in sure.groupBy(F.substring_index("a", "\t", -1).alias("left"), F.col("b").alias("right")).agg(F.sum("n").alias("n")).where(F.col("n") >= max(TRUSTED, least)).collect():
        contexts[r.left, r.right] = r.n
    given |= _new_names(counts, sure, least)
    counts.unpersist()
    return Finder(given, ambiguous, contexts, words)


def _new_names(counts: DataFrame, sure: DataFrame, least: float) -> set[str]:
    """Capitalised words that are hardly seen in lower case and stand repeatedly and in several contexts where given names stand.

    A context tells a name if at least two thirds of its capitalised words are given names; places, farms and brands stand
    among themselves. Words below ``least`` inside such contexts are left out.
    """
    keys = [F.substring_index("a", "\t", -1).alias("left"), F.col("b").alias("right")]
    known = sure.groupBy(*keys).agg(F.sum("n").alias("g"))
    other = counts.where("kind = 'u'").select(F.substring_index("a", "\t", 1).alias("word"), *keys, "n")
    share = known.join(other.groupBy("left", "right").agg(F.sum("n").alias("o")), ["left", "right"], "left")
    telling = share.where((F.col("g") >= TRUSTED) & (F.col("g") >= 2 * F.coalesce("o", F.lit(0)))).select("left", "right", F.lit(1).alias("t"))
    seen = other.join(telling, ["left", "right"], "left").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("t", F.lit(0))).alias("inside"), F.count("t").alias("places"))
    found = seen.where((F.col("inside") >= max(3, least)) & F.expr("places >= 3 AND inside >= 0.2 * n"))
    lower = counts.where("kind = 'p'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("low"))
    rows = found.join(lower, "word", "left").where(F.coalesce("low", F.lit(0)) < F.greatest(F.lit(3), PLAIN_SHARE * F.col("n"))).select("word").collect()
    return {r.word for r in rows}


def find_all(chunks: DataFrame, finder: Finder) -> DataFrame:
    """chunk_id, pii_start, pii_end, pii_kind of every find."""
    shared = chunks.sparkSession.sparkContext.broadcast(finder)  # bounded by its tables

    @F.pandas_udf("array<struct<a:int,b:int,k:string>>")
    def find(texts: pd.Series) -> pd.Series:
        f = shared.value
        return pd.Series([[{"a": a, "b": b, "k": k} for a, b, k in f.find(x)] for x in texts])

    return chunks.where("text IS NOT NULL").select("chunk_id", F.explode(find("text")).alias("f")).select("chunk_id", F.col("f.a").alias("pii_start"), F.col("f.b").alias("pii_end"), F.col("f.k").alias("pii_kind"))


def _prepared(spark, d):
    chunks = unique(table(spark, d, "review_chunks").select("chunk_id", "text"), "chunk_id")
    labelled = table(spark, d, "pii_names")
    return chunks, learn(table(spark, d, "review_chunks").select("text").unionByName(labelled.select("text")), labelled)


def p2_found(spark, d):
    chunks, finder = _prepared(spark, d)
    return find_all(chunks, finder).select("chunk_id", "pii_kind").distinct()


def secret(spark) -> bytes:
    """The key of ``spark.talkharvest.pseudonym.key``; where none is set a new one that is not kept, so that nobody can turn pseudonyms back."""
    key = spark.conf.get("spark.talkharvest.pseudonym.key", None)
    return key.encode() if key else secrets.token_bytes(32)


def p2_scrubbed(spark, d, key: bytes | None = None):
    """chunk_id, text with placeholders; null texts stay null. Without a key in the session pseudonyms differ from run to run."""
    key = key or secret(spark)
    chunks, finder = _prepared(spark, d)
    shared = spark.sparkContext.broadcast(finder)

    @F.pandas_udf("string")
    def scrub(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.scrub(x, key) for x in texts], dtype=object)

    return chunks.select("chunk_id", scrub("text").alias("text"))


QUERIES = {"p2_found": p2_found, "p2_scrubbed": p2_scrubbed}
ORACLE: dict[str, str] = {}
