from pyspark.sql import functions as F

from talkharvest.functions import pii, sequences
from talkharvest.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_fold_and_words(spark):
    assert one(spark, "L’Été à Straße", T.fold) == "l'ete a strasse"
    assert one(spark, "éte", T.fold) == "ete"
    assert one(spark, "It's 3 cups—no, 4!", T.words) == ["it's", "3", "cups", "no", "4"]
    assert one(spark, None, T.fold) is None
    assert one(spark, "", T.words) == []


def test_gsm(spark):
    assert one(spark, "plain €", T.is_gsm7) is True
    assert one(spark, "日本", T.is_gsm7) is False
    assert one(spark, "a€", T.gsm7_length) == 3
    assert one(spark, "“ô…” 日", T.to_gsm7) == '"o..." ?'


def test_sentences(spark):
    assert one(spark, "It was 3.5 km. Good!\r\nWe saw e.g. trees. Bye", T.sentences) == ["It was 3.5 km.", "Good!", "We saw e.g. trees.", "Bye"]
    assert one(spark, " \n ", T.sentences) == []


def test_language(spark):
    def guess(t):
        df = spark.createDataFrame([(t,)], "t string")
        s = df.select(*[c.alias(k) for k, c in T.language_scores(F.col("t")).items()])
        return s.select(*[x.alias(n) for x, n in zip(T.guess_from({k: F.col(k) for k in T.LANGS}), "lp")]).first()

    assert guess("the road was hard and we were tired").l == "en"
    assert guess("der Weg war nicht gut und wir sind müde").l == "de"
    r = guess("xyz")
    assert (r.l, r.p) == ("unknown", 0.0)


def test_negation(spark):
    def neg(t, lang):
        return spark.createDataFrame([(t, lang)], "t string, l string").select(T.negation(F.col("t"), F.col("l")).alias("n")).first().n

    assert not neg("not only good but great", "en").negated
    assert neg("it was not good", "en").negated
    n = neg("nobody said it was not good", "en")
    assert n.uncertain and n.cues == 2
    assert not neg("no vino nadie", "es").uncertain
    assert neg("it was not really good", "en").uncertain


def test_forms_and_ends(spark):
    def one(f, t):
        return spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x

    assert one(T.words, "Ｆｕｌｌ ﬁne ½ ①² ĳs École") == ["full", "fine", "1", "2", "12", "ijs", "ecole"]
    assert one(T.word_count, "l'eau d'ici isn't") == 6 and one(T.word_count, "") == 0
    assert one(T.sentences, "He said no. We left.") == ["He said no.", "We left."]
    assert one(T.sentences, "Table no. 14 was ours. Then dr. weber came, approx. two of us. Ask dr. A.B.") == ["Table no. 14 was ours.", "Then dr. weber came, approx. two of us.", "Ask dr. A.B."]
    assert not one(T.is_phantom, "112") and one(T.is_phantom, "Subtítulos por la comunidad") and not one(T.is_phantom, "Die Untertitel fehlten") and one(T.is_phantom, "?! …")
    assert one(T.fingerprint, "?!") is None and one(T.gsm7_length, "a\f") == 3 and one(T.wer_normalised, "Ｆｕｌｌ É") == "full é"


def test_contracted_and_split_negation(spark):
    def cues(t, lang):
        return spark.createDataFrame([(t, lang)], "t string, l string").select(T.negation(F.col("t"), F.col("l")).alias("n")).first().n

    assert cues("they shouldn't wait", "en").cues == 1 and cues("nous ne reviendrons plus", "fr").cues == 1 and cues("il y a plus de café", "fr").cues == 0
    # idioms count in their own language only
    assert not cues("sans doute", "fr").negated and cues("sans doute", "de").cues == 0 and cues("no doubt", "es").negated


def test_sequences():
    c = sequences.clauses_of
    assert c("we ate the stew and we drank the coffee", "en") == ["we ate the stew", "we drank the coffee"]
    assert c("bread and butter", "en") == ["bread and butter"]
    assert c("it rained, and we left", "en") == ["it rained", "we left"] and c("it rained and we left", "en") == ["it rained and we left"]
    # what was joined counts with its connector towards the next mark
    assert c("tea and milk and we drank it all", "en") == ["tea and milk", "we drank it all"]
    assert c("Although the road was long, we liked it but the bus was late.", "en") == ["the road was long", "we liked it", "the bus was late."]
    assert c("nice farm – bad road", "en") == ["nice farm", "bad road"] and c("the guide : a good one", "en") == ["the guide", "a good one"]
    assert c("we left because it rained", "en") == ["we left because it rained"] and c("we left because it rained", "en", causal=True) == ["we left", "it rained"]
    assert c("la ferme est belle, on a bien mangé ici", "fr", comma_words=3) == ["la ferme est belle", "on a bien mangé ici"] and len(c("la ferme est belle, on a bien mangé ici", "fr")) == 1
    assert c("Der Weg war steil aber das Essen war gut", "de") == ["Der Weg war steil", "das Essen war gut"] and c("the butter was button", "en") == ["the butter was button"]
    # an unknown language takes all lists; nothing to say gives nothing
    assert c("Der Weg war steil pero la comida era buena", None) == ["Der Weg war steil", "la comida era buena"] and c("", "en") == c(" - , ", "en") == []
    assert sequences.word_edits("a b c".split(), "a x c d".split()) == 2
    assert sequences.lost("my name is anna".split(), "my name is [name]".split()) == ["anna"]
    assert sequences.cut_loop("go a b a b a b".split()) == 3
    assert sequences.cut_loop([]) == 0


def test_sms():
    parts = sequences.pack_lines("\n".join(["line of text %d" % i for i in range(30)]))
    assert all(sequences.septets(p) <= 160 for p in parts) and parts[0].endswith(f" (1/{len(parts)})")
    assert sequences.pack_lines("short") == ["short"] and sequences.pack_lines("a\n\n  \nb") == ["a\nb"]
    assert not any(p.endswith(")") for p in sequences.pack_lines("x" * 500, numbered=False))
    assert all(sequences.septets(p) <= 160 for p in sequences.pack_lines("x" * 500))


def test_scrubbing(spark):
    rows = spark.createDataFrame(
        [("1", "My name is Keza, mail a.b@example.org or call +250 788 123 456", "en"), ("2", None, "en"), ("3", "zero seven eight nine one two three four", "en"), ("4", "We paid 450 000 francs", None)],
        "id string, text string, lang string",
    )
    r = {x.id: x for x in pii.scrubbed(rows).collect()}
    assert r["1"].clean == "My name is [name], mail [email] or call [number]" and (r["1"].names, r["1"].emails, r["1"].phones) == (1, 1, 1)
    assert r["2"].clean is None and r["2"].names == 0
    assert r["3"].clean == "[number]"
    assert r["4"].clean == "We paid 450 000 francs"
    again = pii.scrubbed(spark.createDataFrame([(x.id, x.clean, x.lang) for x in r.values()], "id string, text string, lang string"))
    assert {x.id: x.clean for x in again.collect()} == {k: x.clean for k, x in r.items()}


def test_capitals_inside_sentences():
    for text, lang, clean in [
        ("the walk with Zolane Brobergo was long", "en", "the walk with [name] was long"), ("nous avons suivi Solène, puis Uwase-Marie", "fr", "nous avons suivi [name], puis [name]"),
        ("ayer Yurema nos llevó", "es", "ayer [name] nos llevó"), ("then Zolane spoke", None, "then [name] spoke"), ("der Weg mit Zolane war lang", "de", "der Weg mit Zolane war lang"), ("die Bohnen und Wasser", "de-CH", "die Bohnen und Wasser"),
        ("we drank Arabica in Rwanda on Monday and I paid by WhatsApp", "en", "we drank Arabica in Rwanda on Monday and I paid by WhatsApp"), ("It was good. Shade helped.\nBananas too: Fresh ones", "en", "It was good. Shade helped.\nBananas too: Fresh ones"),
        ("we met Monday Zolane", "en", "we met [name]"), ("the road\nBananas", "en", "the road\nBananas"),
    ]:
        assert pii.names(text, lang)[0] == clean, text


def test_slots(spark):
    assert one(spark, "Keep: {f}", lambda t: T.fill_slots(t, {"f": F.lit("stew"), "n": F.lit(None).cast("int")})) == "Keep: stew"
    import pytest

    with pytest.raises(Exception, match="no value for f"):
        one(spark, "Keep: {f}", lambda t: T.fill_slots(t, {"f": F.lit(None).cast("string")}))
