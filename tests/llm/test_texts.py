"""Sentences and languages on stated texts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.llm import languages as L
from lexichron.llm import sentences as S
from lexichron.llm.tokens import share


def split(text):
    starts, ends = S.split_texts([text])[0]
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


CASES = [
    ["Dr. Oldevane saw it on p. 12.", "He left."],
    ["He came at 5 p.m. with it.", "Then J. A. Smith, cf. vol. 4, pp. 26 ff., left."],
    ["The list names scribes, guests, etc.", "A letter came."],
    ["“Who knows the law?” asks M. Doe at the end.", "“A letter came.”", "It is short."],
    ["The homily (did they know? it seems so!) is old.", "Version 4.3.8 is new."],
    ["Am 9. Mai 1960 kam er im 10. Jh. n. Chr. an, z. B. in Hs. 17.", "Am Ende blieb er.", "1918 ging er."],
    ["« Qui donc ? » demande L. Kelor.", "Pourquoi pas ?", "Il part."],
    ["В 1904 г. (ср. т. 15, с. 3 и др.) писцы, гонцы и т. д.", "Община ждёт."],
    ["«Ποιος ξέρει;» ρωτά ο καθ. Δος.", "Γιατί όχι;", "Ναι."],
    ["यह 1960 ई. का है (पृ. 451)।", "“कौन?” वह पूछता है।"],
    ["«من يذكر؟» يسأل د. علي في 1902 م. تقريبا.", "انتهى."],
    ["“谁知道？”他问道。", "平均有12.75个字。", "“信来了。”", "他写道：“好！”并且走了。"],
    ["「誰が。」と彼は問う。", "終わり……だ。"],
    ["The prophets.42", "In 1907 it left."],
    ["the law is old.", "the letter, cf. vol. 2, is new!", "who knows?"],
]


@pytest.mark.parametrize("sentences", CASES)
def test_sentences(sentences):
    glue = "" if any("぀" < c < "ꀀ" for c in sentences[0]) else " "
    assert split(glue.join(sentences)) == sentences
    assert split("  " + (glue or "").join(sentences) + "\n") == sentences


def test_blank_lines_headings_thai_and_missing_spaces():
    assert split("II. The City\n\nA letter\ncame. It left") == ["II. The City", "A letter\ncame.", "It left"]
    assert split("a\r\n \r\nb") == ["a", "b"]
    assert split("ทำไม ที่เมือง46.25ของ") == ["ทำไม", "ที่เมือง46.25ของ"]
    assert split("He copied it.Then he left") == ["He copied it.", "Then he left"]


def test_nothing():
    assert S.split_texts([None, "", " \n\n ", "x"])[:3] == [] or all(len(a) == 0 for a, _ in S.split_texts([None, "", " \n\n "]))
    assert S.split_texts([]) == []


def test_every_solid_character_lies_in_one_sentence():
    random.seed(5)
    pieces = ["Word ", "Dr. ", "end. ", "\n", "\n\n", "“Q?” ", "(b! ", ") ", "。", "ไทย ", "12.5 ", "?", " ", "　", "« ", "» "]
    for _ in range(300):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 40)))
        starts, ends = S.split_texts([text])[0]
        covered = np.zeros(len(text), int)
        for a, b in zip(starts, ends):
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            covered[a:b] += 1
        assert all(covered[k] == 1 for k, c in enumerate(text) if not c.isspace()) and covered.max(initial=0) <= 1


def test_prefix_scan_equals_one_run():
    random.seed(6)
    text = "".join(random.choice(["Word ", "end. ", "“q?” ", "(b) ", "e.g. "]) for _ in range(4000))
    symbols, _ = S.lex(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64), S.words_known())
    whole = S.sentence_starts(symbols, chunk=len(text))
    for chunk in (7, 64, 1000):
        assert S.sentence_starts(symbols, chunk=chunk).tolist() == whole.tolist()


@pytest.mark.parametrize(
    "sentences",
    [
        ["He lives in the U.S.", "She does not."],
        ["See Gen. Smith in Sept.", "He was there."],
        ["Jan. 5 was cold.", "It was I.", "Then we left."],
        ["Corp. Inc. Ltd. met at 5 p.m.", "He left."],
        ["He said no.", "Then he left for no. 5 (cf. Rom. 5:3)."],
        ["M. Le Brun came.", "J. A. Smith left."],
    ],
)
def test_abbreviations_before_words_that_begin_a_sentence(sentences):
    assert split(" ".join(sentences)) == sentences


def test_list_items():
    assert split("1. First item\n2. Second item\n\nIn\n1960. He came") == ["1. First item", "2. Second item", "In\n1960.", "He came"]


def test_learned_abbreviations(spark):
    text = "It weighs 5 qtz. of corn and 3 Qtz. The end came. The end. He saw it."
    df = spark.createDataFrame([(i, text.replace("Qtz. The", "qtz. and the")) for i in range(30)] + [(99, None)], "doc_id bigint, text string")
    learned = S.learned_abbreviations(df)
    assert learned == {"qtz"}
    starts, _ = S.split_texts([text], S.words_known(learned))[0]
    assert [text[a:][:6] for a in starts] == ["It wei", "The en", "The en", "He saw"]
    starts, _ = S.split_texts(["Five qtz. Smith came."], S.words_known(learned))[0]
    assert len(starts) == 1 and len(split("Five qtz. Smith came.")) == 2
    assert S.learned_abbreviations(df.limit(0)) == frozenset()


def test_abbreviations_are_learned_from_all_documents(spark):
    """Twenty occurrences among 60,000 documents: any part of the documents shows fewer."""
    text = F.when(F.col("id") % 3000 == 7, F.concat(F.lit("It weighs 5 qtz. of corn, "), F.col("id"))).otherwise(F.lit("He left."))
    assert S.learned_abbreviations(spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"))) == {"qtz"}


def test_long_text():
    text = "The letter came. " * 60_000
    starts, _ = S.split_texts([text])[0]
    assert len(starts) == 60_000


ENGLISH = ["The letter came to the city and the people were glad.", "Who knows what the old scribe had written there?", "They read it with great care in the evening."]
GERMAN = ["Der Brief kam in die Stadt und die Leute waren froh.", "Wer weiß, was der alte Schreiber dort geschrieben hatte?", "Sie lasen ihn am Abend mit großer Sorgfalt."]
GREEK = ["Η επιστολή έφτασε στην πόλη και όλοι χάρηκαν."]


@pytest.fixture(scope="module")
def profiles(spark):
    texts = [" ".join(ENGLISH)] * 9 + [" ".join(GERMAN)] * 9 + [" ".join(ENGLISH)] + GREEK + [None, "", ENGLISH[0]]
    labels = ["en"] * 9 + ["de"] * 9 + ["de"] + ["el"] + ["en", "en", "xx"]
    return L.fit(spark.createDataFrame(list(zip(texts, labels)), "text string, lang string"), ["en", "de", "el", "fr"])


def rows(spark, profiles, texts):
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    return sorted(tuple(r) for r in L.segments(df, profiles).collect())


def test_segments(spark, profiles):
    mixed = ENGLISH[0] + " " + GERMAN[0] + " " + GERMAN[1]
    got = rows(spark, profiles, [None, "", " ", "123 !", mixed, "Introduction\n\n" + GERMAN[2], GREEK[0] + "\n\n" + ENGLISH[1]])
    assert [(d, n, lang) for d, n, lang, *_ in got] == [(4, 1, "en"), (4, 2, "de"), (5, 1, "de"), (6, 1, "el"), (6, 2, "en")]
    assert mixed[got[1][4] : got[1][5]] == GERMAN[0] + " " + GERMAN[1] and got[1][6] == 2
    assert all(0 <= r[3] <= 1 for r in got)
    assert rows(spark, profiles, []) == []


def test_held_out_accuracy(profiles):
    unseen = {"en": "The old people of the city had been there and were glad to read.", "de": "Die alte Stadt und der Schreiber waren am Abend froh."}
    for lang, text in unseen.items():
        _, _, _, language, *_ = L.sentence_languages(profiles, [text])
        assert profiles.languages[language[0]] == lang


def test_named_languages(spark):
    labels = spark.createDataFrame([("eng", "en"), ("Deutsch", "de"), ("français", "fr")], "label string, lang string")
    meta = [(1, [" ENG ", None, "x"]), (2, ["deutsch/ eng;français"]), (3, None), (4, []), (None, ["eng"]), (5, ["", "NULL"])]
    got = L.named_languages(spark.createDataFrame(meta, "id_kase bigint, language array<string>"), labels)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "en"), (2, "de"), (2, "en"), (2, "fr")]


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("He left... Then she came.", ["He left...", "Then she came."]),
        ("He left… Then she came.", ["He left…", "Then she came."]),
        ("He left... then she came.", ["He left... then she came."]),
        ("He left… 12 came. All sat.", ["He left… 12 came.", "All sat."]),
        ("He said… “well” and sat. All sat.", ["He said… “well” and sat.", "All sat."]),
        ("هو قال… ثم ذهب. انتهى.", ["هو قال… ثم ذهب.", "انتهى."]),
    ],
)
def test_ellipses(text, sentences):
    starts, ends = S.split_texts([text])[0]
    assert [text[a:b] for a, b in zip(starts, ends)] == sentences


def test_single_characters_are_ngrams():
    keys = L._grams(np.frombuffer("aba".encode("utf-32-le"), np.uint32), np.zeros(3, np.int32))
    none = L.NONE << L.BITS | L.NONE
    assert [int((keys == np.uint64(ord(c) << 2 * L.BITS | none)).sum()) for c in "ab"] == [2, 1]


def test_sample_stays_about_as_large_however_many_rows_there_are():
    for rows in (300, 10**6, 10**9, 10**13):
        assert share(300, rows) / 2**63 * rows == pytest.approx(300, rel=1e-3)
    assert share(300, 10) == 2**63 - 1 and share(300, 0) == 0


def test_labelled_sample(spark):
    df = spark.createDataFrame([(i if i % 3 else None, f"text {i}", "en") for i in range(4000)] + [(1, None, "de"), (2, "x" * 30_000, "de")], "doc_id bigint, text string, lang string")
    n = L.labelled_sample(df, ["en", "de"], sample=400).count()
    assert 300 < n < 500
    assert L.labelled_sample(df.limit(0), ["en"]).count() == 0
    none = L.fitted(df.limit(0), spark.createDataFrame([("eng", "en")], "label string, lang string"))
    assert rows(spark, none, [ENGLISH[0]]) == []


def test_profiles_are_fitted_on_all_labelled_documents(spark):
    """Words of one document among 2,000, and a language whose one document has more than 20,000 characters."""
    german = " ".join(GERMAN) + " "
    texts = [" ".join(ENGLISH)] * 2000 + [german * (25_000 // len(german))]
    texts[1234] += " The wqwqwq" + " wqwqwq" * 20_000 + " were there."
    df = spark.createDataFrame([(i, t, "en" if i < 2000 else "de") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([("eng", "en"), ("deu", "de")], "label string, lang string")
    both = L.fitted(df, labels)
    assert both.languages == ["de", "en"] and (both.scripts >= 0).all()
    gram = np.uint64(ord("w") << 2 * L.BITS | ord("q") << L.BITS | ord("w"))
    at = np.flatnonzero(both.keys == gram)
    assert len(at) == 1 and both.ranks[1, at[0]] < 20
    fitted = L.fitted_segments(df, labels)
    assert sorted(fitted.collect()) == sorted(L.segments(df, both).collect())


def test_long_documents_with_a_wrong_label_do_not_tell_the_script(spark):
    chinese = "那封信到了城里，人们都很高兴。谁知道老抄写员写了什么？"
    texts = [" ".join(ENGLISH)] * 9 + [chinese] * 9 + [" ".join(ENGLISH * 20)] * 2
    fitted = L.fit(spark.createDataFrame(list(zip(texts, ["en"] * 9 + ["zh"] * 11)), "text string, lang string"), ["en", "zh"])
    assert [L.NAMES[k] for k in fitted.scripts] == ["latin", "han"]
    assert [(d, lang) for d, _, lang, *_ in rows(spark, fitted, [ENGLISH[0], chinese])] == [(0, "en"), (1, "zh")]


def test_limits_keep_to_a_thousandth(spark):
    profiles = L.Profiles(["en"], np.zeros(1, int), np.empty(0, np.uint64), np.empty((1, 0), np.int16), np.full(1, np.inf))
    of = {"language": "0", "nearest": "sqrt(id / 400000)", "farthest": "0.1D", "lead": "1.0D", "letters": "99"}
    L.set_limits(profiles, spark.range(0, 400_000, 1, 8).selectExpr(*(f"array({x}) AS {name}" for name, x in of.items())))
    assert profiles.unknown[0] == pytest.approx(0.999**0.5, abs=2e-5)


def test_distances_equal_those_of_single_sentences(profiles):
    texts = [ENGLISH[0], GREEK[0], GERMAN[1] + " łąż", "a", "Ω ω", ENGLISH[2] + ENGLISH[2], "12", "שלום"]
    rank_of = [{g: int(r) for g, r in zip(profiles.keys.tolist(), row)} for row in profiles.ranks]
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    sentence = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(points)].astype(np.int32)
    script = L.main_script(L.script_counts(points, sentence, len(texts)))
    got = L.distances(profiles, points, sentence, script)
    for k in range(len(texts)):
        grams, n = np.unique(L._grams(points[sentence == k], np.zeros((sentence == k).sum(), np.int32)), return_counts=True)
        rank = [int(min((n > x).sum() + ((n == x).sum() - 1) / 2, L.PROFILE - 1)) for x in n]
        for lang, ranks in enumerate(rank_of):
            fits = len(grams) and script[k] == profiles.scripts[lang]
            away = [abs(ranks[g] - r) if g in ranks else L.PROFILE for g, r in zip(grams.tolist(), rank)]
            assert got[k, lang] == (sum(away) / len(grams) if fits else np.inf)


def test_text_in_none_of_the_languages(spark, profiles):
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."
    got = rows(spark, profiles, [polish, ENGLISH[0] + " " + polish, "שלום לכל האנשים"])
    assert [(d, lang) for d, _, lang, *_ in got] == [(0, "und"), (1, "en"), (1, "und")] and got[0][3] == 0


def test_more_sentences_than_a_key_holds(profiles, monkeypatch):
    text = " ".join((ENGLISH + GERMAN) * 20)
    whole = L.sentence_languages(profiles, [text, text])
    monkeypatch.setattr(L, "MOST_SENTENCES", 7)
    for a, b in zip(whole, L.sentence_languages(profiles, [text, text])):
        assert np.array_equal(a, b)


def test_long_words_count_alike_wherever_they_stand():
    text = "Странствующий монах. Странствующий монах."
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = L.script_counts(points, np.repeat(np.arange(2), [21, 20]).astype(np.int32), 2)
    assert counts[:, L.NAMES.index("cyrillic")].tolist() == [L.WORD_LETTERS + 5] * 2


@pytest.mark.parametrize(("name", "value"), [("NUMBERED", 0), ("NUMBERED", 20), ("NUMBERED_AT_ONCE", 2), ("NUMBERED_CHARS", 50), ("CHARS_AT_ONCE", 100)])
def test_numbered_letters_give_the_same(profiles, monkeypatch, name, value):
    """All ways through judgement and counts: letters with and without numbers, in one block and in several."""
    texts = [None, " ".join(ENGLISH + GREEK), "\n\n".join(GERMAN) + " łąż 中国\U00020000。", "", "12 שלום", ENGLISH[2] + "ไทย " + GREEK[0] + ENGLISH[1] * 30]

    def run():
        found = S.split_batch(texts)
        batch = L._batch(found, L._scripts(found))
        of = L._judged(profiles, batch)
        assert (of.language >= 0).sum() > 5
        counted = L._counted(batch, np.where(of.language >= 0, of.language * len(L.NAMES) + of.script, -1))
        sums = Counter()
        for *key, n in zip(*counted.to_pydict().values()):
            sums[tuple(key)] += n
        return [getattr(of, f.name).tolist() for f in L.fields(L.Judged)], sums

    whole = run()
    monkeypatch.setattr(L, name, value)
    assert run() == whole


def test_second_round_counts_sentences_for_the_language_they_are_in(spark):
    texts = [" ".join(ENGLISH)] * 9 + [" ".join(GERMAN)] * 9 + [" ".join(ENGLISH + GERMAN[:1] + GREEK) + " No."] * 2 + [GREEK[0], "12", None]
    df = spark.createDataFrame(list(zip(texts, ["en"] * 9 + ["de"] * 11 + ["el", "fr", "fr"])), "text string, lang string")
    first, second = (L.fitted_profiles(df, ["de", "el", "en", "fr"], rounds=k) for k in (1, 2))
    found = S.split_batch(texts)
    batch = L._batch(found, L._scripts(found))
    of = L._judged(first, batch)
    sure = (of.lead >= L.LEAST_LEAD) & (of.letters >= L.FEW_LETTERS) & (of.language >= 0)
    for lang in range(4):
        members = np.flatnonzero(sure & (of.language == lang))
        grams = [L._grams(found.points[found.starts[k] : found.ends[k]], np.zeros(found.ends[k] - found.starts[k], np.int32)) for k in members]
        gram, n = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_counts=True)
        expected = gram[np.lexsort((gram, -n))][: L.PROFILE]
        held = np.flatnonzero(second.ranks[lang] < L.PROFILE)
        assert np.array_equal(second.keys[held[np.argsort(second.ranks[lang, held])]], expected)
        assert (second.scripts[lang] >= 0) == (len(members) > 0)
    assert (first.ranks != second.ranks).any() if first.ranks.shape == second.ranks.shape else True
