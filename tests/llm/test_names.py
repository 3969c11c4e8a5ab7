"""Variant spellings, and connected components."""

import pytest

from lexichron.llm import names as N
from lexichron.llm.components import connected_components

SAME = [
    ["Druzofand, Benjamin", "Benjamin Druzofand", "Druzofand, Benjarnin", "DRUZOFAND, Ben", "Prof. B. Druzofand", "Druzofand Benjamin", "Benjamin  Druzofland"],
    ["Plövurpird, Françoise", "Françoise Ploevurpird", "Rev. Francoise Plovurpird"],
    ["Anna-Lena Horvulumald", "Horvulumald, A.-L.", "Horvulumald, Annalena"],
    ["Institute for Epistolary Studies, Horvivosist", "Inst. for Epistolary Studies (Horvivosist)", "Horvivosist Institute for Epistolary Stud."],
    ["Diocesan Archive of Berofint", "Archive, Diocesan (Berofint)", "Berofint Dioc. Arch.", "Berofinnt Diocesan Archive"],
    ["Berofint Theological Seminary", "Theological Seminary of Berofint", "Berofint Theological Seminary (ed.)"],
    ["Robert Gasmolt", "Bob Gasmolt"],
    ["Alexandra Gasmolt"],
    ["Anthony Gasmolt"],
    ["A. Gasmolt", "Gasmolt, A"],
]


def entities(spark, rows):
    got = N.name_entities(spark.createDataFrame([(r, 1) for r in rows], "name string, entity int")).collect()
    groups = {}
    for name, entity in got:
        groups.setdefault(entity, set()).add(name)
    return {frozenset(g) for g in groups.values()}


def test_variants_come_together_and_others_stay_apart(spark):
    rows = [n for group in SAME for n in group] * 2 + [None, "", "  ", "Anonymous", "[s.n.]", "Anon."] + [f"X, {g}" for g in ()]
    assert entities(spark, rows) == {frozenset(g) for g in SAME}


def test_nothing(spark):
    assert entities(spark, [None, "", "Unknown"]) == set()
    df = N.name_entities(spark.createDataFrame([], "name string"))
    assert N.name_pairs(df).count() == 0


def test_long_name_and_one_word(spark):
    long = "Ab" * 30_000
    assert entities(spark, [long, "Plato", "Platon"]) == {frozenset([x]) for x in (long, "Plato", "Platon")}


@pytest.mark.parametrize(("a", "b", "value"), [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "a", 0.0), ("a", "a", 1.0)])
def test_jaro_winkler(a, b, value):
    assert N.jaro_winkler(a, b) == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "acb", 1), ("abc", "abd", 1), ("abc", "abcd", 1), ("abc", "xyz", 3), ("", "ab", 2)])
def test_edits(a, b, n):
    assert N.edits(a, b, 5) == n


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)]
    edges = chain + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q"), ("x", "y")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(101)} == {"n000"} and got["y"] == got["x"] == "x" and got["z"] == "z" and len(got) == 104
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize(
    "group",
    [
        ["Peter van der Berg", "van der Berg, Peter", "P. van der Berg"],
        ["Maria Garcia Lopez", "Garcia Lopez, Maria"],
        ["John Smith", "Jon Smith"],
        ["Steven Millerson", "Stephen Millerson"],
        ["Fyodor Dostoevsky", "Dostoyevskii, Fedor"],
        ["Christopher Johnston", "Christofer Jonhstn"],
        ["Brenorabent Theological Seminary", "Brernorabent Theological Seminary"],
    ],
)
def test_reordered_words_and_spellings_of_sounds(spark, group):
    assert entities(spark, group) == {frozenset(group)}


def test_names_of_different_people(spark):
    rows = ["Martin, Luther", "Luther, Martin", "Debåbild, Hubert", "Debibeld, Hubert", "Wilma Gumidilm", "William Gumidilm", "Sturniskeck, Anna", "Stulmukeck, Anna"]
    assert entities(spark, rows) == {frozenset([r]) for r in rows}


def test_no_empty_codes():
    for name in ("Lee, J", "Hay, John", "Ali, Jane", "Ruhe, Jan", "Io, A"):
        keys = N.read_name(name)["keys"]
        assert keys and all(all(part for part in k.split("|")) for k in keys)
    assert not set(N.read_name("Lee, J")["keys"]) & set(N.read_name("Ali, Jane")["keys"])


def test_hot_blocks_give_the_same(spark):
    given = ["Anna", "Anne", "Albert", "Alexander", "Alexandra", "Abigail", "Andrew", "Andreas", "Anthony", "Arthur"]
    rows = [f"{g} {s}" for g in given for s in ("Gasmolt", "Gasmelt", "Gasmolt M.")] + ["A. Gasmolt", "Gasmolt, A. M.", "Gasmolt, Albret", "Alec Gasmolt"]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    found = [sorted(map(tuple, N.name_entities(df, hot).collect())) for hot in (0, 3, 10_000)]
    assert found[0] == found[1] == found[2]


def test_words_known_as_given_names_are_a_share(spark):
    names = [f"Surname{i}, Orlo" for i in range(5)] + [f"Kilm, Given{i}" for i in range(40)] + [f"Other{i}, Kilm" for i in range(5)]
    ends = spark.createDataFrame([(n, *N.ends_of(n)) for n in names], "name string, comma boolean, first string, last string")
    assert {r.word for r in N.given_words(ends).collect()} == {"orlo"}
