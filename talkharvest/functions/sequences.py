"""Order-dependent functions of one text, as Arrow functions: clause coordinators, word alignment, loops, packing."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F

# fixed values: the words at which clauses part, by language. Those of the first three kinds always part them; "lead" stands at the
# head of a sentence and parts it at its first comma; "join" only between clauses of enough words.
CONNECTORS = {
    "lead": {"en": "although, though, even though, even if, while", "fr": "bien que, même si, quoique", "de": "obwohl, auch wenn, obgleich", "es": "aunque, si bien, a pesar de que"},
    "against": {
        "en": "but, however, although, though, even though, whereas, except that, on the other hand, unfortunately",
        "fr": "mais, cependant, pourtant, par contre, en revanche, toutefois, sauf que, bien que, même si, malheureusement, néanmoins",
        "de": "aber, jedoch, allerdings, trotzdem, sondern, obwohl, dagegen, leider, nur dass",
        "es": "pero, sin embargo, aunque, no obstante, sino, mientras que, en cambio, lamentablemente, por desgracia",
    },
    "cause": {"en": "because, so that", "fr": "parce que, parce qu, car", "de": "weil, denn, deshalb, darum", "es": "porque, ya que, así que"},
    "join": {"en": "and, and also, as well as", "fr": "et, et aussi, ainsi que", "de": "und, und auch, sowie", "es": "y, e, y también, así como"},
}
#: Words that a clause beside a joining word needs, and those it needs where a comma stands before that word.
LEAST_WORDS, LEAST_AFTER_COMMA = 3, 2
_DASH = regex.compile(r"\s[–—-]\s|\s:\s")
_RUN = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=None)
def _marks(lang: str | None, causal: bool) -> tuple[regex.Pattern, regex.Pattern]:
    """Where a sentence parts (named by kind), and a leading connector, for a language; an unknown one takes all lists."""

    def either(kind: str) -> str:
        lists = CONNECTORS[kind]
        terms = {t for text in ([lists[lang]] if lang in lists else lists.values()) for t in text.split(", ")}
        return "|".join(r"\s+".join(map(regex.escape, t.split())) for t in sorted(terms, key=lambda t: (-len(t), t)))

    hard = either("against") + ("|" + either("cause") if causal else "")
    alone = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"
    part = regex.compile(rf"(?P<hard>{alone % hard})|(?P<comma>,?)\s+(?P<join>{either('join')})(?![\p{{L}}\p{{N}}])|(?P<bare>,\s+)", regex.I)
    return part, regex.compile(rf"\s*(?:{either('lead')})(?![\p{{L}}\p{{N}}])(?=[^,]+,)", regex.I)


def clauses_of(sentence: str, lang: str | None = None, causal: bool = False, comma_words: int = 0) -> list[str]:
    """TXT6. The clauses of a sentence, connectors left out.

    All possible marks are found in one reading. Between two marks that always part, stretches of words lie one after the
    other, and a stretch is closed at a joining mark if what has gathered and what comes next are both long enough.
    """
    part, leading = _marks(lang if lang in CONNECTORS["join"] else None, causal)
    # (start, end, words needed on both sides); 0: always
    spans = [(*m.span(), 0) for m in _DASH.finditer(sentence)]
    for piece in _pieces(sentence):
        begin = 0
        if head := leading.match(sentence, piece[0], piece[1]):
            comma = sentence.index(",", head.end())
            spans += [(head.start(), head.end(), 0), (comma, comma + 1, 0)]
            begin = head.end()
        for m in part.finditer(sentence, max(piece[0], begin), piece[1]):
            if m["hard"]:
                spans.append((*m.span(), 0))
            elif m["join"]:
                spans.append((*m.span(), LEAST_AFTER_COMMA if m["comma"] else LEAST_WORDS))
            elif comma_words:
                spans.append((*m.span(), comma_words))
    marks = sorted(set(spans))
    marks = [m for i, m in enumerate(marks) if not i or m[0] >= marks[i - 1][1]]
    starts, ends = [0, *(m[1] for m in marks)], [*(m[0] for m in marks), len(sentence)]
    size = [len(_RUN.findall(sentence, a, b)) for a, b in zip(starts, ends)]
    out, first, gathered = [], 0, size[0]
    for i, (a, b, need) in enumerate(marks):
        if need and (gathered < need or size[i + 1] < need):
            gathered += size[i + 1] + len(_RUN.findall(sentence, a, b))
            continue
        out.append(sentence[starts[first] : a])
        first, gathered = i + 1, size[i + 1]
    out.append(sentence[starts[first] :])
    out = [regex.sub(r"^[\s,;:–—'-]+|[\s,;:–—'-]+$", "", c) for c in out]
    return [c for c in out if _RUN.search(c)]


def _pieces(sentence: str) -> list[tuple[int, int]]:
    """Stretches between free-standing dashes and colons; a leading connector may stand at the head of each."""
    cuts = [m.span() for m in _DASH.finditer(sentence)]
    return list(zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(sentence)]))


def clauses(causal: bool = False, comma_words: int = 0):
    """Column function of (sentence, language)."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([clauses_of(x, k, causal, comma_words) for x, k in zip(texts, langs)])

    return split


def word_edits(a: list[str], b: list[str]) -> int:
    """TXT18: edit distance of two word lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_errors():
    @F.pandas_udf("int")
    def errors(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_edits(x.split(), y.split()) for x, y in zip(a, b)])

    return errors


def lost(before: list[str], after: list[str]) -> list[str]:
    """TXT20: the words of ``before`` outside a longest common subsequence."""
    n, m = len(before), len(after)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if before[i] == after[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n:
        if j < m and before[i] == after[j]:
            i, j = i + 1, j + 1
        elif j < m and best[i][j + 1] >= best[i + 1][j]:
            j += 1
        else:
            out.append(before[i])
            i += 1
    return out


def lost_words():
    @F.pandas_udf("array<string>")
    def words(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lost((x or "").lower().split(), (y or "").lower().split()) for x, y in zip(a, b)])

    return words


def cut_loop(tokens: list[str], block_times: int = 3, token_times: int = 6) -> int:
    """TXT30: how many tokens stay when a tail that repeats itself is cut to its first round."""
    n = len(tokens)
    run = 1
    while run < n and tokens[n - 1 - run] == tokens[n - 1]:
        run += 1
    if n and run >= token_times:
        return n - run + 1
    for size in range(2, n // block_times + 1):
        block, k = tokens[n - size :], 1
        while n - (k + 1) * size >= 0 and tokens[n - (k + 1) * size : n - k * size] == block:
            k += 1
        if k >= block_times:
            return n - (k - 1) * size
    return n


def loop_cut():
    @F.pandas_udf("int")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_loop(x.split()) for x in texts])

    return keep


def septets(text: str) -> int:
    return sum(2 if c in "\f^{}\\[~]|€" else 1 for c in text)


def pack_lines(text: str, limit: int = 160, numbered: bool = True) -> list[str]:
    """TXT27: lines go whole into parts of at most ``limit`` septets; a line is cut only if it alone is too long.

    Blank lines are left out. Several parts are numbered ``(k/n)`` unless ``numbered`` is false, and the numbering's own room is kept free until everything fits.
    """

    def fit(room: int) -> list[str]:
        parts: list[str] = []
        for line in filter(str.strip, text.split("\n")):
            pieces = []
            while septets(line) > room:
                k = room
                while septets(line[:k]) > room:
                    k -= 1
                space = line.rfind(" ", 1, k + 1)
                k = space if space > 0 else k
                pieces.append(line[:k])
                line = line[k:].lstrip()
            for p in [*pieces, line]:
                if parts and septets(parts[-1] + "\n" + p) <= room:
                    parts[-1] += "\n" + p
                else:
                    parts.append(p)
        return parts

    parts = fit(limit)
    width = 0
    while numbered and len(parts) > 1:
        need = len(f" ({len(parts)}/{len(parts)})")
        if need <= width:
            return [f"{p} ({i}/{len(parts)})" for i, p in enumerate(parts, 1)]
        width = need
        parts = fit(limit - width)
    return parts


def sms_packer():
    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([pack_lines(x) for x in texts])

    return pack
