"""Languages of documents and of their parts (problem 6).

A bidirectional gated recurrent network reads bytes and gives every position a distribution over twelve languages; it is
trained here, in numpy, by backpropagation through time, on sentences of labelled records. Labels are partly wrong, and in
rare languages most of what is labelled so may be something else, so languages are first drawn by the root of their number,
then sentences whose label the network firmly contradicts are left out, and training goes on until a held-out tenth is
right. Sentences (split by the sentence model) pool the log-probabilities of their positions. How sure a pooled
sentence is, is calibrated on the held-out tenth, and what the labels of the sample really stood for gives the prior of each
label, so that a sentence speaks against its label only on evidence. Records pool their sentences. Long sentences are read
whole, in windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.cut import cut
from ..sources.tables import table, unique
from . import sentences

# fixed values: codes, three-letter codes and names of the twelve languages
LANGUAGES = {
    "en": "en eng english anglais englisch inglés ingles inglese inglês engels",
    "fr": "fr fra fre french français francais französisch franzosisch francés frances francese francês frans",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco alemão duits",
    "es": "es spa esp spanish español espanol castellano espagnol spanisch spagnolo espanhol spaans",
    "it": "it ita italian italiano italien italienisch italiaans",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese portugees",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch neerlandés olandese",
    "sw": "sw swa swahili kiswahili suaheli",
    "ja": "ja jpn jp japanese 日本語 japonais japanisch japonés giapponese",
    "zh": "zh zho chi cmn chinese 中文 汉语 普通话 mandarin chinois chinesisch chino cinese",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ar": "ar ara arb arabic العربية arabe arabisch árabe arabo",
}
CODES = tuple(LANGUAGES)
#: Labelled records of each language used for fitting, network size, batch and window of the training, steps between two looks
#: at the held-out tenth, looks at which wrong labels are left out, steps at most, and the share of it that must be right in every language. All are bounds of the model only.
PER_LANGUAGE, HIDDEN, BATCH, WINDOW, LOOK, SETTLED, MAX_STEPS, RIGHT = 1_500, 24, 128, 48, 150, 3, 1_200, 0.995
#: Bytes read at once, sequences read together, least letters of a sentence that counts, least confidence, sentences remembered.
READ, TOGETHER, LEAST_LETTERS, LEAST_P, REMEMBERED = 192, 256, 6, 0.75, 50_000


def stated(label: Column) -> Column:
    """The language a label states, in any case, with spaces or region, as code or name; null for none."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", ""))
    short = F.regexp_replace(plain, r"(?U)[-_\s(].*$", "")
    pairs = [(n, c) for c, names in LANGUAGES.items() for n in names.split()]
    known = F.create_map(*[F.lit(v) for p in pairs for v in p])
    return F.coalesce(known[plain], known[short])


_NUMBER = regex.compile(r"\d+")
_NOISE = regex.compile(r"\[[^\]]*\]|\S+@\S+|\S+\.\S+/\S*|https?://\S+")


def cleaned(sentence: str) -> str:
    """What the network reads: lower case, no placeholders or addresses, every digit 0, single spaces."""
    if "@" in sentence or "[" in sentence or "/" in sentence:
        sentence = _NOISE.sub(" ", sentence)
    return " ".join(_NUMBER.sub("0", sentence).split()).lower()


def letters(text: str) -> int:
    """Letters; one of a script without spaces counts for three."""
    return sum(3 if ord(c) >= 0x2E80 else 1 for c in text if c.isalpha())


def inputs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What enters at each position: the byte, and hashes of it with the one before and with both neighbours."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    return x, (before * 263 + x) % TWO, (before * 40_503 + x * 263 + after) % THREE


#: Rows of the hashed tables of byte pairs and triples.
TWO, THREE = 4_096, 8_192


class Network:
    """Bidirectional GRU over bytes; byte 0 is padding."""

    def __init__(self, seed: int = 11):
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("x", f(256, 3 * h)), ("y", f(TWO, 3 * h)), ("w", f(THREE, 3 * h)), ("u", f(h, 3 * h)), ("c", np.zeros(3 * h, np.float32)))}
        self.p |= {"o": f(2 * h, len(CODES)), "k": np.zeros(len(CODES), np.float32)}
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states (T, B, H) of one direction; with ``keep`` also what its gradient needs."""
        t, b, h = x.shape[0], x.shape[1], HIDDEN
        u, wx = self.p["u" + d], sum(self.p[n + d][i] for n, i in zip("xyw", inputs(x))) + self.p["c" + d]
        out, state, past = np.empty((t, b, h), np.float32), np.zeros((b, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = state @ u
            zr = 1 / (1 + np.exp(-(wx[i][:, : 2 * h] + g[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(wx[i][:, 2 * h :] + r * g[:, 2 * h :])
            new = np.where(mask[i][:, None], (1 - z) * n + z * state, state)
            if keep:
                past.append((i, state, z, r, n, g[:, 2 * h :]))
            out[i] = state = new
        return out, past

    def positions(self, x: np.ndarray, keep: bool = False):
        """Log-probabilities (T, B, languages) of every position of bytes x (T, B)."""
        mask = x > 0
        f, pf = self._run(x, mask, "f", keep)
        b, pb = self._run(x, mask, "b", keep)
        hidden = np.concatenate([f, b], 2)
        s = hidden @ self.p["o"] + self.p["k"]
        s -= s.max(2, keepdims=True)
        return s - np.log(np.exp(s).sum(2, keepdims=True)), hidden, pf, pb, mask

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adam step of backpropagation through time on (T, B) bytes with one language per column."""
        logp, hidden, pf, pb, mask = self.positions(x, True)
        n = max(1, mask.sum())
        d = np.exp(logp)
        d[:, np.arange(len(y)), y] -= 1
        d *= mask[:, :, None] / n
        grad = {"o": np.tensordot(hidden, d, ([0, 1], [0, 1])), "k": d.sum((0, 1))}
        dh = d @ self.p["o"].T
        h = HIDDEN
        for q, past, part in (("f", pf, dh[:, :, :h]), ("b", pb, dh[:, :, h:])):
            u, gu = self.p["u" + q], np.zeros_like(self.p["u" + q])
            gx, back = np.zeros((*x.shape, 3 * h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for i, state, z, r, nn, gn in reversed(past):
                total = back + part[i]
                live = total * mask[i][:, None]
                dn = live * (1 - z) * (1 - nn * nn)
                dz = live * (state - nn) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                gx[i] = np.concatenate([dz, dr, dn], 1)
                gu += state.T @ dg
                back = total * ~mask[i][:, None] + live * z + dg @ u.T
            rows = gx.reshape(-1, 3 * h)
            for name, ids in zip("xyw", inputs(x)):
                order = np.argsort(ids.reshape(-1), kind="stable")
                values, at = np.unique(ids.reshape(-1)[order], return_index=True)
                grad[name + q] = np.zeros_like(self.p[name + q])
                grad[name + q][values] = np.add.reduceat(rows[order], at, 0)
            grad |= {"u" + q: gu, "c" + q: rows.sum(0)}
        self.t += 1
        for k, g in grad.items():
            m, v = self.m[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
        return float(-(logp[:, np.arange(len(y)), y] * mask).sum() / n)

    def _sums(self, some: list[bytes]) -> np.ndarray:
        """Log-probabilities (B, languages) summed over the positions of each sequence.

        The same network as ``positions`` without what training needs: both directions step together, the backward one on
        sequences that are turned round, so no state has to pass over padding; what enters is looked up once per distinct byte triple.
        """
        size, length, h = len(some), np.array([len(b) for b in some]), HIDDEN
        t = int(length.max())
        x = np.zeros((t + 2, size), np.int32)
        for j, b in enumerate(some):
            x[1 : len(b) + 1, j] = np.frombuffer(b, np.uint8)
        triple, at = np.unique((x[:-2] << 16 | x[1:-1] << 8 | x[2:]).reshape(-1), return_inverse=True)
        before, mid, after = triple >> 16, triple >> 8 & 255, triple & 255
        ids = mid, (before * 263 + mid) % TWO, (before * 40_503 + mid * 263 + after) % THREE
        enter = np.concatenate([sum(self.p[n + d][i] for n, i in zip("xyw", ids)) + self.p["c" + d] for d in "fb"])
        at = at.reshape(t, size)
        turned = np.abs(length[None, :] - 1 - np.arange(t)[:, None])  # beyond the length it does not matter
        rows = np.stack([at, np.take_along_axis(at, np.minimum(turned, t - 1), 0) + len(triple)], 1)
        u, out, state = np.stack([self.p["uf"], self.p["ub"]]), np.empty((t, 2, size, h), np.float32), np.zeros((2, size, h), np.float32)
        for i in range(t):
            a, g = enter[rows[i]], state @ u
            zr = 1 / (1 + np.exp(-(a[..., : 2 * h] + g[..., : 2 * h])))
            n = np.tanh(a[..., 2 * h :] + zr[..., h:] * g[..., 2 * h :])
            out[i] = state = n + zr[..., :h] * (state - n)
        o = self.p["o"]
        s = out[:, 0] @ o[:h] + np.take_along_axis(out[:, 1] @ o[h:], np.minimum(turned, t - 1)[:, :, None], 0) + self.p["k"]
        s -= s.max(2, keepdims=True)
        s -= np.log(np.exp(s).sum(2, keepdims=True))
        return (s * (np.arange(t)[:, None] < length)[:, :, None]).sum(0)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean log-probability of each language over all bytes of each text; uniform for an empty one."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            b = t.encode("utf-8", "replace").replace(b"\0", b" ")
            for a in range(0, len(b), READ):
                pieces.append(b[a : a + READ])
                owner.append(i)
        total, count = np.zeros((len(texts), len(CODES))), np.zeros(len(texts))
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            np.add.at(total, [owner[i] for i in some], self._sums([pieces[i] for i in some]))
            np.add.at(count, [owner[i] for i in some], [len(pieces[i]) for i in some])
        return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], -np.log(len(CODES)))


def shares(mean_logp: np.ndarray, sharp: float, prior: np.ndarray | float = 1.0) -> np.ndarray:
    """Share of each language after pooling; evidence of positions is not independent, so only ``sharp`` of them count."""
    s = sharp * mean_logp + np.log(prior)
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Detector:
    """The trained network, how many positions of a sentence count, and the prior of each label (the last one of none)."""

    def __init__(self, net: Network, sharp: float, prior: np.ndarray):
        self.net, self.sharp, self.prior = net, sharp, prior
        self.net.m = {}  # only the training needs it
        self.seen: dict[str, np.ndarray] = {}

    def __call__(self, said: list[str], label: list[str | None]) -> list[tuple[str | None, float | None]]:
        """Language and confidence of each sentence of a record with that label; null for those with too few letters."""
        new = [t for t in dict.fromkeys(said) if t not in self.seen and letters(t) >= LEAST_LETTERS]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = [t for t in dict.fromkeys(said) if letters(t) >= LEAST_LETTERS]
        if new:
            self.seen |= zip(new, self.net.pooled(new))
        at = [i for i, t in enumerate(said) if t in self.seen]
        out: list = [(None, None)] * len(said)
        if at:
            given = [CODES.index(label[i]) if label[i] in LANGUAGES else len(CODES) for i in at]
            p = shares(np.stack([self.seen[said[i]] for i in at]), self.sharp, self.prior[given])
            for i, k, v in zip(at, p.argmax(1), p.max(1)):
                out[i] = CODES[k], float(v)
        return out


def fit(texts: list[str], labels: list[str], share: dict[str, float], seed: int = 5) -> Detector:
    """From sentences of labelled records; ``share`` is how many records of the corpus one record of a label stands for.

    Sentences that were met under several labels count for that of most records. Without any sentence nothing is learnt.
    """
    net, rng = Network(), np.random.default_rng(seed)
    known = np.array([CODES.index(c) for c in labels], int)
    part = np.array([share.get(c, 1.0) for c in CODES])
    place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    votes = np.zeros((len(place), len(CODES)))
    np.add.at(votes, ([place[t] for t in texts], known), part[known])
    one = list(place)
    y, n = votes.argmax(1) if len(one) else np.zeros(0, int), votes.sum(1)
    clear = (votes.max(1, initial=0) > 0.6 * n) & np.array([len(t.encode()) >= 12 for t in one], bool)
    data = [t.encode("utf-8", "replace").replace(b"\0", b" ") for t in one]
    weight = np.maximum(1, np.rint(np.sqrt(n / part[y]))).astype(int)
    held = rng.random(len(one)) < 0.1
    keep, test, sharp = clear & ~held, clear & held, 4.0
    for step in range(MAX_STEPS if keep.any() else 0):
        if step % LOOK == 0:
            if step:
                # what is left out settles in the first looks; later ones only judge the held-out tenth
                looked = np.arange(len(one)) if step <= SETTLED * LOOK else np.flatnonzero(test)
                logp = net.pooled([one[i] for i in looked])
                p, want = shares(logp, 4.0), y[looked]
                best, firm = p.argmax(1), p.max(1) >= 0.9
                if step <= SETTLED * LOOK:
                    keep = clear & ~held & (best == y) & firm
                # labels that are firmly contradicted are taken as wrong; of each language one sentence may stay doubtful
                fair = test[looked] & ~((best != want) & firm)
                sharp = calibrated(logp[fair], want[fair])
                wrong, of = np.bincount(want[fair & (best != want)], minlength=len(CODES)), np.bincount(want[fair], minlength=len(CODES))
                if step >= SETTLED * LOOK and (wrong <= np.maximum(1, (1 - RIGHT) * of)).all():
                    break
            pools = [np.repeat(w, weight[w]) for w in (np.flatnonzero(keep & (y == k)) for k in range(len(CODES)))]
            # languages by the root of what is left of their records: rare ones more often, but not so that wrong labels of common ones rule them
            chance = np.sqrt([n[keep & (y == k)].sum() for k in range(len(CODES))])
            chance = chance / chance.sum()
        languages = rng.choice(len(CODES), BATCH, p=chance)
        chosen = np.array([pools[k][int(rng.integers(len(pools[k])))] for k in languages])
        x = np.zeros((WINDOW, BATCH), np.int64)
        for j, i in enumerate(chosen):
            b = data[i]
            a = int(rng.integers(0, max(1, len(b) - WINDOW + 1)))
            piece = b[a : a + WINDOW]
            x[: len(piece), j] = np.frombuffer(piece, np.uint8)
        net.step(x, y[chosen], 0.02 if step < LOOK else 0.012 if step < 2 * LOOK else 0.004)
    prior = np.full((len(CODES) + 1, len(CODES)), 0.5)
    if len(one):
        best = net.pooled(one).argmax(1)
        np.add.at(prior, (known, best[[place[t] for t in texts]]), 1.0)
    prior[-1] = (prior[:-1] * part[:, None]).sum(0)
    return Detector(net, sharp, prior / prior.sum(1, keepdims=True))


def calibrated(logp: np.ndarray, y: np.ndarray) -> float:
    """How many positions of a sentence count: the likeliest, with one label in a hundred wrong at random."""
    if not len(y):
        return 4.0
    fits = lambda sharp: np.log(0.99 * shares(logp, sharp)[np.arange(len(y)), y] + 0.01 / len(CODES)).sum()
    return max((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0), key=fits)


def records(spark, d: str) -> DataFrame:
    """rec_id, part_id, text, label of transcripts, batch messages, and the chunks of stored messages (part_id is the chunk's)."""
    t = unique(table(spark, d, "transcripts").select("clip_id", "transcript", "lang"), "clip_id").select("clip_id", "clip_id", "transcript", "lang").toDF("rec_id", "part_id", "text", "label")
    m = unique(table(spark, d, "messages_raw").select("message_id", "text", "declared_lang"), "message_id").select("message_id", "message_id", "text", "declared_lang").toDF("rec_id", "part_id", "text", "label")
    s = unique(table(spark, d, "messages_stored").select("message_id", "lang"), "message_id")
    c = unique(table(spark, d, "review_chunks").select("chunk_id", "message_id", "text"), "chunk_id")
    c = c.join(s, "message_id").select(F.col("message_id").alias("rec_id"), F.col("chunk_id").alias("part_id"), "text", F.col("lang").alias("label"))
    return t.unionByName(m).unionByName(c).withColumn("label", stated(F.col("label")))


def sampled(scans: DataFrame) -> DataFrame:
    """At most PER_LANGUAGE labelled records of each language, by a hash of their id."""
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("part_id"), "part_id"))
    return scans.where("label IS NOT NULL AND lines <> ''").select("part_id", "label", "text", "lines").withColumn("place", place).where(F.col("place") <= PER_LANGUAGE)


def labelled_parts(recs: DataFrame) -> DataFrame:
    """rec_id, part_id, label, sent_no, sent_start, letters, lang, p of every sentence; lang and p are null with too few letters."""
    scans = cut(sentences.scanned(recs, "part_id"))
    model = sentences.train(scans)
    texts, labels = [], []
    for r in sampled(scans).toPandas().sort_values(["label", "place"]).itertuples():
        for a, b in sentences.sentences(r.text, r.lines, model):
            said = cleaned(r.text[a:b])
            if letters(said) >= LEAST_LETTERS:
                texts.append(said)
                labels.append(r.label)
    counts = {r.label: r["count"] for r in scans.where("label IS NOT NULL AND lines <> ''").groupBy("label").count().collect()}
    detector = fit(texts, labels, {k: max(1.0, n / PER_LANGUAGE) for k, n in counts.items()})
    shared = scans.sparkSession.sparkContext.broadcast((model, detector))  # a bounded model and a fixed number of weights

    @F.pandas_udf("array<struct<a:int,n:int,lang:string,p:double>>")
    def guess(texts: pd.Series, lines: pd.Series, label: pd.Series) -> pd.Series:
        m, detect = shared.value
        cuts = [sentences.sentences(t, x, m) for t, x in zip(texts, lines)]
        said = [cleaned(t[a:b]) for t, c in zip(texts, cuts) for a, b in c]
        found = iter(zip(said, detect(said, [k for k, c in zip(label, cuts) for _ in c])))
        return pd.Series([[{"a": a, "n": len(t), "lang": lang, "p": p} for (a, _), (t, (lang, p)) in zip(c, found)] for c in cuts])

    out = scans.where("lines <> ''").select("rec_id", "part_id", "label", F.posexplode(guess("text", "lines", "label")).alias("sent_no", "s"))
    return out.select("rec_id", "part_id", "label", "sent_no", F.col("s.a").alias("sent_start"), F.col("s.n").alias("letters"), "s.lang", "s.p")


def p6_segments(spark, d):
    """rec_id, part_id, sent_no, sent_start, lang, p of every sentence of every record (part_id: the chunk of a stored message)."""
    return labelled_parts(records(spark, d)).select("rec_id", "part_id", "sent_no", "sent_start", "lang", "p")


def p6_documents(spark, d):
    """rec_id, lang, p: the language of most letters of each record, with its share times its mean confidence.

    A record without a readable sentence (null, empty, too few letters) has lang null and p 0.
    """
    recs = cut(records(spark, d))
    return recs.select("rec_id").distinct().join(main_language(labelled_parts(recs)), "rec_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def main_language(units: DataFrame) -> DataFrame:
    u = units.where("lang IS NOT NULL")
    by = u.groupBy("rec_id", "lang").agg(F.sum("letters").alias("n"), F.avg("p").alias("p"))
    w = Window.partitionBy("rec_id")
    return by.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "lang"))).where("r = 1").select("rec_id", "lang", F.round(F.col("share") * F.col("p"), 6).alias("p"))


def p6_found(spark, d):
    u = labelled_parts(records(spark, d))
    return u.where(F.col("lang").isNotNull() & (F.col("p") >= LEAST_P) & ~F.col("lang").eqNullSafe(F.col("label"))).select("rec_id", "lang").distinct()


QUERIES = {"p6_found": p6_found, "p6_segments": p6_segments, "p6_documents": p6_documents}
ORACLE: dict[str, str] = {}
