"""Cleaning, periods and predicates on stated examples."""

import pytest
from pyspark.sql import functions as F

from lexichron.functions import periods as P
from lexichron.functions import text as T
from lexichron.functions.predicate import predicate


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("given", "expected"), [("the; L wouldn't _Word1... \"God's PRESS", "Word God's Press"), ("", ""), (None, None), ("the The THE", "The The")]
)
def test_clean_filter(spark, given, expected):
    assert one(spark, given, lambda x: T.clean_filter(x, ["the", "wouldn't"])) == expected


# Stated examples and their results.
@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Murphy name112 Rom7 Oconnor", "Murphy_Oconnor name Romans"),
        ("Old Testament text", "Old_Testament text"),
        ("Ot text", "Old_Testament text"),
        ("Christ Jesus rom23", "Christ Jesus Romans"),
        ("Jesus12 New Testament", "Jesus New_Testament"),
        ("Paul Jesus", "Paul Jesus"),
    ],
)
def test_clean_ngram_string(spark, given, expected):
    assert one(spark, given, T.clean_ngram_string) == expected


@pytest.mark.parametrize(("given", "expected"), [("1334", "1334"), ("word124", "word"), ("124word", "124word")])
def test_digits(spark, given, expected):
    assert one(spark, given, T.strip_digits) == expected


def test_replacements_and_ascii(spark):
    assert one(spark, "St station Thess", T.replaced_words) == "saint station Thessalonians"
    assert one(spark, "λόγος", T.ascii_only) == ""


@pytest.mark.parametrize(
    ("year", "expected"),
    [(1899, None), (1900, "1900-1919"), (1919, "1900-1919"), (1920, "1920-1939"), (2019, "2000-2019"), (2020, None), (None, None)],
)
def test_bidecade(spark, year, expected):
    assert one(spark, year, P.bidecade_of, "int") == expected


def test_decade_and_year(spark):
    assert one(spark, 2013, P.decade_of, "int") == 2010
    assert one(spark, "1987-03-01", P.year_of) == 1987
    assert one(spark, "soon", P.year_of) is None


def test_ngrams(spark):
    assert one(spark, "ab cd ef", lambda x: T.ngrams(T.tokens(x), 2)) == ["ab cd", "cd ef"]
    assert one(spark, "ab", lambda x: T.ngrams(T.tokens(x), 2)) == []
    assert one(spark, None, lambda x: T.ngrams(T.tokens(x), 2)) == []


def test_porter():
    words = "running jumps easily happiness applies relational generously studies caresses hopping".split()
    assert [T.porter(w) for w in words] == "run jump easili happi appli relat gener studi caress hop".split()


@pytest.mark.parametrize(
    ("text", "kept"),
    [("==1951", [1951]), (".between(1950, 1952)", [1950, 1951]), (".isin([1950, 1990])", [1950, 1990]), (".isnull()", [None]), (">= 1951", [1951, 1990]), (".notnull()", [1950, 1951, 1990])],
)
def test_predicate(spark, text, kept):
    df = spark.createDataFrame([(1950,), (1951,), (1990,), (None,)], "x int")
    assert sorted((r.x for r in df.filter(predicate("x", text)).collect()), key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("text", ["", "==__import__('os')", ".between(1)", ".query('x')", "== [1]", "1 == 1"])
def test_predicate_refuses(spark, text):
    with pytest.raises(ValueError):
        predicate("x", text)
