"""Cleaning of n-grams and words, over the whole n-gram table and on stated examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.operators import bags as B
from lexichron.plans.common import ARTICLES, BAG, articles, bag, documents
from lexichron.plans.ngrams import STOPS
from lexichron.sources.search import page_starts
from lexichron.session import table

# Stated examples and what cleaning makes of them.
EXAMPLES = {
    "the; L wouldn't _Word1... \"God's PRESS": "the; L wouldn't _Word... \"God's PRESS",
    "Murphy name112 Rom7 Oconnor": "Murphy_Oconnor name Romans",
    "Old Testament text": "Old_Testament text",
    "Ot text": "Old_Testament text",
    "Christ Jesus rom23": "Christ Jesus Romans",
    "Jesus12 New Testament": "Jesus New_Testament",
    "Paul Jesus": "Paul Jesus",
    "St station Thess": "saint station Thessalonians",
    "1334": "1334",
    "word124": "word",
    "124word": "124word",
}


def _trigrams(s, d):
    return _trigrams_of(s, d, 3)


def _trigrams_of(s, d, n):
    """The whole texts' n-grams of white-space words, as bags with counts."""
    words = F.filter(F.split("text", T.SPACES), lambda w: w != "")
    split = documents(s, d).filter("text is not null").select(words.alias("words"))
    rows = split.select(F.explode(T.ngrams(F.col("words"), n)).alias("ngram"))
    return rows.groupBy("ngram").agg(F.count("*").alias("n"))


def _clean_trigrams(s, d):
    """Cleaned trigrams. Cleaning looks at one word at a time, so each word is cleaned once, before the trigrams are made."""
    words = F.filter(F.split("text", T.SPACES), lambda w: w != "")
    cleaned = documents(s, d).filter("text is not null").select(T.cleaned_words(words, STOPS, again=True).alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: T.joined(F.slice("words", i, 3)))
    return cleaned.filter(F.size("words") >= 3).select(F.explode(runs).alias("ngram"), F.lit(1).cast("bigint").alias("n"))


def _examples(s, expression, name):
    return s.createDataFrame([(x,) for x in EXAMPLES], "example string").select("example", expression("example").alias(name))


QUERIES = {
    "clean_filter_tokens": lambda s, d: B.merge(bag(s, d)).select("ngram", "n", T.clean_filter("ngram", STOPS).alias("cleaned")),
    "filter_bag_min2": lambda s, d: B.merge(_clean_trigrams(s, d).filter(F.col("ngram").contains(" "))),
    "ascii_and_digit_rules": lambda s, d: B.merge(bag(s, d)).select(
        "ngram", T.ascii_only("ngram").alias("ascii"), T.strip_digits("ngram").alias("no_digits"), T.clean_token("ngram").alias("token")
    ),
    "sorted_without_stops": lambda s, d: B.remapped(_trigrams(s, d), T.sorted_words("ngram", STOPS)),
    "collocation_whole": lambda s, d: B.remapped(_trigrams_of(s, d, 2), T.replaced_whole("ngram")),
    "number_formats": lambda s, d: B.top(B.merge(bag(s, d)), 25).select("ngram", T.decimals("n", 6).alias("six"), T.million(F.col("n") * 1_000_000).alias("millions")),
    "clean_examples": lambda s, d: _examples(s, T.clean_ngram_string, "cleaned"),
    "word_replacements": lambda s, d: B.remapped(B.merge(bag(s, d)), T.replaced_words("ngram")),
    "collocation_merge": lambda s, d: B.remapped(_trigrams(s, d), T.merged_collocations("ngram")),
    "sorted_ngrams": lambda s, d: B.remapped(_trigrams(s, d), T.sorted_words("ngram")),
    "array_struct_projection": lambda s, d: table(s, d, "entries_df")
    .select("entry_id", F.array_join(F.transform("affiliation", lambda a: a["affilname"]), "|", "none").alias("names"))
    .distinct(),
    "struct_member_int": lambda s, d: table(s, d, "entries_df")
    .select("entry_id", F.col("author-count").getField("@total").try_cast("int").alias("authors"))
    .groupBy("authors")
    .agg(F.count("*").alias("n")),
    "page_offsets": lambda s, d: s.createDataFrame([(x,) for x in page_starts(103, 25)], "start int"),
    "cross_targets": lambda s, d: s.createDataFrame([("faith",), ("grace",), ("law",)], "phrase string").crossJoin(
        s.createDataFrame([("title",), ("abstract",)], "field string")  # two lists of settings
    ),
    "journal_word_share": lambda s, d: articles(s, d)
    .filter("isPartOf is not null")
    .groupBy("isPartOf")
    .agg(F.coalesce(F.sum("wordCount"), F.lit(0)).alias("words"), F.count_if(F.col("wordCount").isNull()).alias("missing")),
}

_MERGED = "merged AS (SELECT ngram, sum(n)::BIGINT AS n FROM bag GROUP BY 1)"
_STOPS = "(" + ", ".join(f"'{w}'" for w in STOPS) + ")"
_RECASED = "concat(substring(w, 1, 1), {low})"
_LOWERED = "regexp_replace(lower(substring(w, 2)), 'σ$', 'ς')"
_PUNCTUATION = T.PUNCTUATION.replace("'", "''")


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{T.SPACES}'), lambda w: w <> '')"


def _clean(x: str) -> str:
    kept = f"list_filter(list_transform({_words(x)}, lambda w: regexp_replace(w, '{_PUNCTUATION}', '', 'g')), lambda w: w NOT IN {_STOPS} AND length(w) > 1)"
    return f"list_transform({kept}, lambda w: {_RECASED.format(low=_LOWERED)})"


_TRIGRAMS = rf"""
spaced AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{T.SPACES}'), lambda w: w <> '') AS t FROM documents WHERE text IS NOT NULL),
tri AS (SELECT ngram, count(*)::BIGINT AS n FROM (
  SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS ngram FROM spaced) GROUP BY 1)"""
_REPLACED = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.WORDS.items()) + " ELSE w END"


def _steps(source: str, carried: str = "n") -> str:
    """Collocations one after another, a table for each, so that the text stays short."""
    out, before = [], source
    for k, (pair, merged) in enumerate(T.COLLOCATIONS.items()):
        a, b = pair.split()
        out.append(
            f"c{k} AS MATERIALIZED (SELECT {carried}, CASE WHEN list_contains(v, '{a}') AND list_contains(v, '{b}') THEN list_transform("
            f"list_filter(v, lambda w: w <> '{b}'), lambda w: CASE WHEN w = '{a}' THEN '{merged}' ELSE w END) ELSE v END AS v FROM {before})"
        )
        before = f"c{k}"
    return ", ".join(out)


SQL = {
    "clean_filter_tokens": f"WITH {BAG}, {_MERGED} SELECT ngram, n, array_to_string({_clean('ngram')}, ' ') AS cleaned FROM merged",
    "filter_bag_min2": f"""WITH {_TRIGRAMS}, c AS (SELECT list_filter({_clean("ngram")}, lambda w: w NOT IN {_STOPS}) AS v, n FROM tri),
        m AS (SELECT array_to_string(v, ' ') AS ngram, sum(n)::BIGINT AS n FROM c GROUP BY 1)
        SELECT ngram, n FROM m WHERE length(ngram) >= 2 AND len({_words("ngram")}) >= 2""",
    "ascii_and_digit_rules": f"""WITH {BAG}, {_MERGED} SELECT ngram, regexp_replace(ngram, '[^\\x00-\\x7f]', '', 'g') AS ascii,
        CASE WHEN regexp_matches(ngram, '\\P{{Nd}}\\p{{Nd}}') THEN regexp_replace(ngram, '\\p{{Nd}}+', '', 'g') ELSE ngram END AS no_digits,
        (SELECT {_RECASED.format(low=_LOWERED)} FROM (SELECT regexp_replace(ngram, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS w)) AS token FROM merged""",
    "word_replacements": f"""WITH {BAG}, {_MERGED} SELECT ngram, sum(n)::BIGINT AS n FROM (
        SELECT array_to_string(list_transform({_words("ngram")}, lambda w: {_REPLACED}), ' ') AS ngram, n FROM merged) WHERE ngram <> '' GROUP BY 1""",
    "collocation_merge": f"""WITH {_TRIGRAMS}, c AS (SELECT n, string_split(ngram, ' ') AS v FROM tri), {_steps("c")}
        SELECT array_to_string(v, ' ') AS ngram, sum(n)::BIGINT AS n FROM c{len(T.COLLOCATIONS) - 1} GROUP BY 1""",
    "sorted_without_stops": f"""WITH {_TRIGRAMS} SELECT ngram, sum(n)::BIGINT AS n FROM (SELECT array_to_string(list_sort(list_filter(list_transform(
        string_split(ngram, ' '), lambda w: regexp_replace(w, '{_PUNCTUATION}', '', 'g')), lambda w: w <> '' AND w NOT IN {_STOPS})), ' ') AS ngram, n FROM tri)
        WHERE ngram <> '' GROUP BY 1""",
    "collocation_whole": f"""WITH {_TRIGRAMS.replace("len(t) - 1", "len(t)").replace("i + 2", "i + 1")}
        SELECT CASE ngram {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.COLLOCATIONS.items())} ELSE ngram END AS ngram, sum(n)::BIGINT AS n FROM tri GROUP BY 1""",
    "number_formats": f"""WITH {BAG}, {_MERGED} SELECT ngram, printf('%.6f', n::DOUBLE) AS six, concat(regexp_replace(n::VARCHAR, '(\\d)(?:(\\d{{{{3}}}}))$', '\\1,\\2'), 'M') AS millions
        FROM merged ORDER BY n DESC, ngram LIMIT 25""".replace("{{3}}", "{3}"),
    "clean_examples": "SELECT * FROM (VALUES " + ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in EXAMPLES.items()) + ") AS v(example, cleaned)",
    "sorted_ngrams": f"""WITH {_TRIGRAMS} SELECT array_to_string(list_sort(string_split(ngram, ' ')), ' ') AS ngram, sum(n)::BIGINT AS n FROM tri GROUP BY 1""",
    "array_struct_projection": """SELECT DISTINCT entry_id, CASE WHEN affiliation IS NOT NULL THEN coalesce(array_to_string(
        list_transform(affiliation, lambda a: coalesce(a.affilname, 'none')), '|'), '') END AS names FROM entries_df""",
    "struct_member_int": 'SELECT TRY_CAST("author-count"."@total" AS INTEGER) AS authors, count(*) AS n FROM entries_df GROUP BY 1',
    "journal_word_share": f"""WITH {ARTICLES} SELECT isPartOf AS "isPartOf", coalesce(sum(wordCount), 0)::BIGINT AS words,
        count(*) FILTER (wordCount IS NULL) AS missing FROM articles WHERE isPartOf IS NOT NULL GROUP BY 1""",
    "page_offsets": "SELECT unnest(range(0, 103, 25))::INTEGER AS start",
    "cross_targets": "SELECT phrase, field FROM (SELECT unnest(['faith', 'grace', 'law']) AS phrase), (SELECT unnest(['title', 'abstract']) AS field)",
}
