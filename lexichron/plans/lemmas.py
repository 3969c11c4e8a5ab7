"""The chain from n-grams to lemmata and bags of lemmata, with a lemmatiser that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.operators import bags as B
from lexichron.operators import lemmas as L
from lexichron.operators import trigrams, vocabulary
from lexichron.plans.common import BAG, bag, documents
from lexichron.plans.ngrams import LEAST, STOPS
from lexichron.plans.texts import _steps

#: N-grams above this count are lemmatised.
ABOVE = 5


def by_suffix(texts: list[str]):
    """A lemmatiser of rules, handed in here in place of a language model: a plural s goes, -ly is an adverb, digits are numbers."""
    for text in texts:
        yield [
            (w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w, "NUM" if w.isascii() and w.isdigit() else "ADV" if w.endswith("ly") else "NOUN")
            for w in text.split(" ")
            if w
        ]


def _lower(s, d):
    return bag(s, d).withColumn("ngram", F.lower("ngram"))


def _dictionary(s, d):
    return L.lemma_dictionary(B.merge(_lower(s, d)), by_suffix, ABOVE)


def _trigram_bow(s, d):
    """``doc_id, bow, w``: the cleaned trigrams of each document as bags of words of two or more, each with its count."""
    return trigrams.bows(documents(s, d), LEAST)


QUERIES = {
    "lemma_dictionary": _dictionary,
    "documents_to_lemmata": lambda s, d: L.documents_to_lemmata(_lower(s, d).select("id_kase", "ngram", "n"), _dictionary(s, d)),
    "documents_to_lemmata_all": lambda s, d: L.documents_to_lemmata(_lower(s, d).select("id_kase", "ngram", "n"), _dictionary(s, d), by_suffix),
    "vocabulary_cleaned": lambda s, d: L.cleaned_vocabulary(B.merge(bag(s, d)), ["", "press", "university", *STOPS]),
    "trigram_bow": _trigram_bow,
    "reverse_lookup": lambda s, d: vocabulary.tokens_of(_tokens(s, d), s.range(0, 50, 5).withColumnRenamed("id", "token_id")),
    "remap_last_write": lambda s, d: B.last_write_wins(B.merge(bag(s, d)).withColumn("o", F.col("ngram")), F.lower("ngram"), "o"),
    "ngram_length_words": lambda s, d: B.merge(bag(s, d)).groupBy(F.length("ngram").alias("chars"), T.word_count("ngram").alias("words")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")),
}


def _tokens(s, d):
    from lexichron.plans.ngrams import _dictionary as of_documents

    return of_documents(s, d)


_LOW = "regexp_replace(lower({x}), 'σ$', 'ς')"
_WORDS = "list_filter(string_split(ngram, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+') AND NOT ends_with(w, 'ly'))"
_LEMMA = "CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END"
_BASE = f"""WITH {BAG}, low AS (SELECT id_kase, {_LOW.format(x='ngram')} AS ngram, sum(n)::BIGINT AS n FROM bag GROUP BY 1, 2),
merged AS (SELECT ngram, sum(n)::BIGINT AS n FROM low GROUP BY 1),
lemmas AS (SELECT ngram, n, list_transform({_WORDS}, lambda w: {_LEMMA}) AS l FROM merged),
dict AS (SELECT ngram, array_to_string(l, ' ') AS lemmata, n FROM lemmas WHERE n > {ABOVE} AND len(l) > 0),
clean AS (SELECT ngram, n, array_to_string(list_sort(list_filter(list_transform(list_transform(l, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')),
  lambda w: concat(w[1:1], {_LOW.format(x='w[2:]')})), lambda w: w <> '')), ' ') AS lemmata FROM lemmas)"""
_APPLIED = "SELECT id_kase, lemmata, sum(low.n)::BIGINT AS n FROM low JOIN clean USING (ngram) WHERE lemmata <> '' {where} GROUP BY 1, 2"
_REPLACED = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.WORDS.items()) + " ELSE w END"
_WHOLE = "CASE g " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.COLLOCATIONS.items()) + " ELSE g END"
_STRIPPED = "CASE WHEN regexp_matches({x}, '\\P{{Nd}}\\p{{Nd}}') THEN regexp_replace({x}, '\\p{{Nd}}+', '', 'g') ELSE {x} END"
_SPLIT = f"list_filter(regexp_split_to_array({{x}}, '{T.SPACES.replace('{', '{{').replace('}', '}}')}'), lambda w: w <> '')"
_DROPPED = "(" + ", ".join(f"'{v}'" for w in ["", "press", "university", *STOPS] for v in dict.fromkeys((w, w.capitalize(), w.upper()))) + ")"

SQL = {
    "lemma_dictionary": f"{_BASE} SELECT ngram, lemmata, n FROM dict",
    "documents_to_lemmata": f"{_BASE} {_APPLIED.format(where='AND ngram IN (SELECT ngram FROM dict)')}",
    "documents_to_lemmata_all": f"{_BASE} {_APPLIED.format(where='')}",
    "vocabulary_cleaned": f"""WITH {BAG}, a AS (SELECT regexp_replace(ngram, '[^\\x00-\\x7f]', '', 'g') AS g, n FROM bag),
        b AS (SELECT {_STRIPPED.format(x='g')} AS g, n FROM a),
        c AS (SELECT array_to_string(list_transform({_SPLIT.format(x='g')}, lambda w: {_REPLACED}), ' ') AS g, n FROM b), e AS (SELECT {_WHOLE} AS g, n FROM c),
        w AS (SELECT unnest(list_distinct(string_split(g, ' '))) AS g, n FROM e),
        m AS (SELECT g, sum(n)::BIGINT AS n FROM w WHERE g NOT IN {_DROPPED} AND (length(g) >= 3 OR g IN ('Ps', 'Mt', 'Mk', 'Jn')) GROUP BY 1)
        SELECT g AS ngram, total AS n FROM (SELECT g, sum(n) OVER (PARTITION BY lower(g))::BIGINT AS total,
          row_number() OVER (PARTITION BY lower(g) ORDER BY n DESC, g <> lower(g), g) AS rn FROM m) WHERE rn = 1""",
    "trigram_bow": f"""WITH t AS (SELECT doc_id, {_SPLIT.format(x='text')} AS t FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS g FROM t) GROUP BY 1, 2),
        x AS (SELECT doc_id, n, {_STRIPPED.format(x='g')} AS g FROM g),
        c AS (SELECT doc_id, n, string_split(array_to_string(list_transform({_SPLIT.format(x='g')}, lambda w: {_REPLACED}), ' '), ' ') AS v FROM x), {_steps('c', 'doc_id, n')},
        k AS (SELECT doc_id, array_to_string(v, ' ') AS g, sum(n)::BIGINT AS n FROM c{len(T.COLLOCATIONS) - 1} GROUP BY 1, 2),
        p AS (SELECT doc_id, g, n, token, count(*) AS c FROM (SELECT doc_id, g, n, unnest(string_split(g, ' ')) AS token FROM k WHERE g <> '') GROUP BY 1, 2, 3, 4),
        d AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM p GROUP BY 1 HAVING sum(n * c) >= {LEAST}),
        b AS (SELECT doc_id, g, n, count(*) AS size, string_agg(concat(token_id, ':', c), ' ' ORDER BY token_id) AS bow FROM p JOIN d USING (token) GROUP BY 1, 2, 3)
        SELECT doc_id, bow, sum(n)::BIGINT AS w FROM b WHERE size > 1 GROUP BY 1, 2""",
    "reverse_lookup": r"""SELECT token_id, token FROM (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (
        SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) >= """
    + f"{LEAST}) WHERE token_id IN (SELECT unnest(range(0, 50, 5)))",
    "remap_last_write": f"WITH {BAG}, m AS (SELECT ngram, sum(n)::BIGINT AS n FROM bag GROUP BY 1) SELECT {_LOW.format(x='ngram')} AS ngram, max_by(n, ngram) AS n FROM m GROUP BY 1",
    "ngram_length_words": f"""WITH {BAG}, m AS (SELECT ngram, sum(n)::BIGINT AS n FROM bag GROUP BY 1)
        SELECT length(ngram)::INTEGER AS chars, len({_SPLIT.format(x='ngram')})::INTEGER AS words, count(*) AS types, sum(n)::BIGINT AS tokens FROM m GROUP BY 1, 2""",
}
