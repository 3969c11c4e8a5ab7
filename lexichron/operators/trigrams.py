"""Bags of words of the cleaned trigrams of documents.

Cleaning looks at one trigram at a time and most words stay as they are, so a batch
of documents is taken as numbers of its distinct words: what a word becomes, with and
without digits, is found once, and only trigrams that may hold a pair which is one
word are cleaned by themselves, each distinct one once.
Everything is counted within the document; texts are read twice, once for the
dictionary and once for the bags, and no trigram is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.operators import bags, vocabulary
from lexichron.session import written

#: Characters of text that are taken at once, beyond single documents.
SLICE_CHARS = 2_000_000
#: Tokens up to which the dictionary is broadcast; beyond it the numbers are joined by a shuffle.
BROADCAST_TOKENS = 1_000_000

_PAIRS = [(*pair.split(), merged) for pair, merged in T.COLLOCATIONS.items()]
_IN_PAIRS = frozenset(w for a, b, _ in _PAIRS for w in (a, b))
#: Information separators, which count as white space elsewhere but not in ``T.SPACES``.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_AFTER = re.compile(r"\D\d")
_DIGITS = re.compile(r"\d+")


def words(text: str) -> list[str]:
    """The words of a text between white space, as ``T.words``."""
    return [w for w in _SPACES.split(text) if w] if _SEPARATORS.search(text) else text.split()


def cleaned(trigram: str) -> list[str]:
    """The words of a trigram after ``T.clean_ngram_string``, which this follows step by step."""
    if _AFTER.search(trigram):
        trigram = _DIGITS.sub("", trigram)
    found = " ".join(T.WORDS.get(w, w) for w in words(trigram)).split(" ")
    found = [w for w in found if w]
    for first, second, merged in _PAIRS:
        if first in found and second in found:
            found = [merged if w == first else w for w in found if w != second]
    return found


def _alone(word: str) -> int:
    """How many words of a pair a word may be: 2 if it becomes two words."""
    became = T.WORDS.get(word, word)
    return 2 if " " in became else int(became in _IN_PAIRS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, so many characters at once."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ends = np.cumsum([len(x) for x in texts])
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_CHARS, side="right")))
            yield batch.column(0).slice(begin, end - begin), texts[begin:end]
            begin = end


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
    """Tokens; the document and the token numbers (three columns, -1 for a word that is no more) of most trigrams; the tokens and the documents of the others."""
    split = [words(x) for x in texts]
    sizes = np.asarray([len(x) for x in split], np.int64)
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for x in split for w in x), np.int64, int(sizes.sum()))
    found = list(number)
    bare = [_DIGITS.sub("", w) for w in found]
    tokens: dict[str, int] = {}
    became = np.asarray([[tokens.setdefault(T.WORDS.get(w, w), len(tokens)) if w else -1 for w in form] for form in (found, bare)], np.int64)
    paired = np.asarray([[_alone(w) for w in form] for form in (found, bare)], np.int64)
    digits = np.asarray([x != y for x, y in zip(found, bare)], bool)
    within = np.asarray([bool(_AFTER.search(w)) for w in found], bool)
    of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.flatnonzero(of[2:] == of[:-2])
    a, b, c = (at[begins + k] for k in range(3))
    form = (digits[b] | digits[c] | within[a]).astype(np.int64)  # digits go from all words or from none
    plain = paired[form, a] + paired[form, b] + paired[form, c] < 2
    runs = np.stack([became[form[plain], x[plain]] for x in (a, b, c)], axis=1)
    others, known = [], {}
    for key in zip(*(x[~plain].tolist() for x in (a, b, c))):
        if key not in known:
            known[key] = [tokens.setdefault(w, len(tokens)) for w in cleaned(" ".join(found[k] for k in key))]
        others.append(known[key])
    return list(tokens), of[begins[plain]], runs, others, of[begins[~plain]]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _slices(batches):
        tokens, _, runs, others, _ = _numbered(texts)
        n = np.bincount(np.concatenate([runs[runs >= 0], np.asarray([x for o in others for x in o], np.int64)]), minlength=len(tokens))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([tokens[k] for k in held], pa.string()), pa.array(n[held], pa.int64())], names=["token", "n"])


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first of equal keys, and how many there are of each."""
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return first, times


def _bags(ids: pa.Array, texts: list[str], known: pa.Array) -> pa.RecordBatch:
    """``doc_id, bow, w``: a row for each bag of each row of documents."""
    tokens, of, runs, others, of_others = _numbered(texts)
    numbers = pc.fill_null(pc.index_in(pa.array(tokens, pa.string()), value_set=known), -1).to_numpy().astype(np.int64)
    used, rank = np.unique(np.r_[-1, numbers], return_inverse=True)  # unknown tokens have rank 0
    runs = np.sort(np.where(runs >= 0, rank[1:][runs], 0), axis=1)
    a, b, c = runs.T
    once, twice = (pa.array([f"{x}:{n}" for x in used.tolist()], pa.string()) for n in (1, 2))
    docs, bows, w = [], [], []
    for kind, chosen in enumerate(((a > 0) & (a < b) & (b < c), (a == 0) & (b > 0) & (b < c), (a > 0) & (a == b) & (b < c), (a > 0) & (a < b) & (b == c))):
        rows = np.flatnonzero(chosen)
        if len(texts) * len(used) ** 3 < 1 << 63:
            first, times = _counted(((of[rows] * len(used) + a[rows]) * len(used) + b[rows]) * len(used) + c[rows])
        else:
            place = np.unique(of[rows] * len(used) + a[rows], return_inverse=True)[1]
            first, times = _counted(np.unique(place * len(used) + b[rows], return_inverse=True)[1] * len(used) + c[rows])
        rows = rows[first]
        x, y, z = (pa.array(v[rows]) for v in (a, b, c))
        columns = ([once.take(x), once.take(y), once.take(z)], [once.take(y), once.take(z)], [twice.take(x), once.take(z)], [once.take(x), twice.take(z)])[kind]
        docs.append(of[rows])
        bows.append(pc.binary_join_element_wise(*columns, " "))
        w.append(times)
    counted: Counter = Counter()
    for doc, trigram in zip(of_others.tolist(), others):
        bag = Counter(x for x in numbers[trigram].tolist() if x >= 0)
        if len(bag) > 1:
            counted[doc, " ".join(f"{x}:{n}" for x, n in sorted(bag.items()))] += 1
    docs.append(np.asarray([k[0] for k in counted], np.int64))
    bows.append(pa.array([k[1] for k in counted], pa.string()))
    w.append(np.asarray(list(counted.values()), np.int64))
    table = pa.table([pa.array(np.concatenate(docs)), pa.chunked_array(bows), pa.array(np.concatenate(w))], names=["doc", "bow", "w"])
    if counted:  # in their documents the same bag may be there twice
        both = pc.is_in(table["doc"], pa.array(docs[-1]))
        summed = table.filter(both).group_by(["doc", "bow"]).aggregate([("w", "sum")]).select(["doc", "bow", "w_sum"]).rename_columns(["doc", "bow", "w"])
        table = pa.concat_tables([table.filter(pc.invert(both)), summed])
    table = table.combine_chunks()
    columns = [table[k].chunk(0) if table.num_rows else table[k].combine_chunks() for k in ("doc", "bow", "w")]
    return pa.RecordBatch.from_arrays([ids.take(columns[0]), *columns[1:]], names=["doc_id", "bow", "w"])


def bows(documents: DataFrame, least: int, most_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``doc_id, bow, w``: bags of two or more tokens that occur ``least`` times in all cleaned trigrams, by number, with their count in the document."""
    spark = documents.sparkSession
    texts = documents.filter("text is not null").select("doc_id", "text")
    known = written(vocabulary.dictionary(texts.mapInArrow(_totals, "token string, n bigint"), least).select("token", "token_id"), "trigram-tokens")
    if known.count() > most_tokens:
        return _shuffled(texts, known)
    shared = spark.sparkContext.broadcast(pa.array([r.token for r in known.orderBy("token_id").toLocalIterator()], pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in _slices(batches):
            yield _bags(ids, part, shared.value)

    def of(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, bow string, w bigint")

    # only documents of more than one row have bags in more than one place
    several = written(texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")), "several")
    if several.isEmpty():
        return of(texts)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    summed = of(texts.join(several, same, "left_semi")).groupBy("doc_id", "bow").agg(F.sum("w").alias("w"))
    return of(texts.join(several, same, "left_anti")).unionByName(summed)


def _shuffled(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``bows`` with the numbers of tokens joined by a shuffle."""
    split = texts.select("doc_id", T.words("text").alias("words"))
    each = split.select("doc_id", F.explode(T.ngrams(F.col("words"), 3)).alias("ngram")).groupBy("doc_id", "ngram").agg(F.count("*").alias("n"))
    cleaned_ = bags.remapped(each, T.clean_ngram_string("ngram"), by=["doc_id"])
    tokens = cleaned_.select("doc_id", "ngram", "n", F.explode(F.split("ngram", " ")).alias("token"))
    pairs = tokens.groupBy("doc_id", "ngram", "n", "token").agg(F.count("*").alias("c")).join(known, "token")
    found = pairs.groupBy("doc_id", "ngram", "n").agg(F.array_sort(F.collect_list(F.struct("token_id", "c"))).alias("bow"))
    text = F.concat_ws(" ", F.transform("bow", lambda x: F.concat_ws(":", x["token_id"], x["c"])))
    return found.filter(F.size("bow") > 1).groupBy("doc_id", text.alias("bow")).agg(F.sum("n").alias("w"))
