"""Counted terms, burst tries, co-occurrence and distinctiveness against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexichron.llm import cooccurrence as C
from lexichron.llm import distinctiveness as D
from lexichron.llm import term_counts as TC
from lexichron.llm import terms
from lexichron.llm.terms_queries import record_periods

DICTIONARY = "id_kase bigint, ngram string, lemmata string, count bigint, loaded_at string, term string"


def dictionary(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DICTIONARY)


ODD = [
    (1, "a", " Law ", 2, "1"),
    (1, "A", "law", 3, "1"),
    (1, "a", " Law ", 2, "1"),
    (1, "b", "grace", 5, "1"),
    (1, "b", None, 5, "2"),
    (2, "c", "ﬁne ", 1, None),
    (2, "d", "  ", 4, "1"),
    (2, "e", "étude", 1, "1"),
    (2, "f", "ÉTUDE", 1, "1"),
    (2, "g", "zero", 0, "1"),
    (2, "h", "null", None, "1"),
    (None, "i", "nobody", 3, "1"),
    (3, None, "ΝΌΜΟΣ", 7, "1"),
    (3, "l", "x" * 50_000, 1, "1"),
]
WANT = {(1, "law", 5), (2, "fine", 1), (2, "étude", 2), (3, "νόμος", 7), (3, "x" * 50_000, 1)}


@pytest.mark.parametrize(("hot_rows", "hot_most"), [(terms.HOT_ROWS, terms.HOT_MOST), (1, 10), (0, 1)])
def test_counted_terms(spark, hot_rows, hot_most):
    got = terms.counted_terms(dictionary(spark, ODD), hot_rows, hot_most)
    assert {tuple(r) for r in got.collect()} == WANT
    assert terms.counted_terms(dictionary(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abλé", max_size=6), st.integers(1, 9)), max_size=200), st.integers(1, 5))
def test_trie_equals_counter(rows, burst):
    whole, parts = TC.BurstTrie(burst), [TC.BurstTrie(burst), TC.BurstTrie(burst + 1)]
    want = defaultdict(lambda: [0, 0])
    for k, (term, n) in enumerate(rows):
        want[term][0] += n
        want[term][1] += 1
        parts[k % 2].add(term, n, 1)
    for part in parts:
        for prefix, entries in part.subtries():
            whole.merge(prefix, [s for s, _ in entries], [c[0] for _, c in entries], [c[1] for _, c in entries])
    got = [(p + s, c) for p, entries in whole.subtries() for s, c in entries]
    assert len(got) == len(want) == whole.size and {t: list(c) for t, c in got} == dict(want)
    assert all(s == sorted(s) for s in ([x for x, _ in entries] for _, entries in whole.subtries()))


def test_term_counts_over_workers(spark, monkeypatch):
    random.seed(1)
    rows = [(t, random.randint(1, 5)) for t in ["hot"] * 900 + [f"pre{random.randint(0, 400)}" for _ in range(1500)] + ["", "é" * 5000]]
    df = spark.createDataFrame(rows + [(None, 1)], "term string, n bigint").repartition(6)
    want = {t: (sum(n for u, n in rows if u == t), sum(u == t for u, _ in rows)) for t in {t for t, _ in rows}}
    assert {r.term: (r.occurrences, r.records) for r in TC.term_counts(df).collect()} == want
    assert TC.term_counts(df.limit(0)).count() == 0


def test_router_cuts_alike():
    opened = frozenset({"", "p", "pr", "pre"})
    trie = TC.BurstTrie(2)
    for t in ["pre1", "pre2", "pre22", "pr", "q", "pra", "pre", ""]:
        trie.add(t, 1, 1)
    batches = list(TC._routed(opened)(iter(list(TC._emitted(trie)))))
    seen = [(r["route"], r["prefix"] + s) for b in batches for r in b.to_pylist() for s in r["suffixes"]]
    assert sorted(t for _, t in seen) == sorted(["pre1", "pre2", "pre22", "pr", "q", "pra", "pre", ""])
    assert dict((t, r) for r, t in seen) == {"pre1": "pre1", "pre2": "pre2", "pre22": "pre2", "pr": "pr", "q": "q", "pra": "pra", "pre": "pre", "": ""}


def test_marks(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 5), ("d", 1, 6)], "term string, occurrences bigint, records bigint")
    assert {r.term: r.mark for r in TC.marked(df, 20).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}


def brute_pairs(rows, min_count, min_share, min_lift):
    held = defaultdict(lambda: defaultdict(set))
    for g, r, i in rows:
        if None not in (g, r, i):
            held[g][r].add(i)
    out = set()
    for g, records in held.items():
        n = len(records)
        single = Counter(i for s in records.values() for i in s)
        both = Counter(p for s in records.values() for p in itertools.combinations(sorted(s), 2))
        out |= {(g, a, b, c) for (a, b), c in both.items() if c >= min_count and c >= min_share * n and c * n >= min_lift * single[a] * single[b]}
    return out


@pytest.mark.parametrize(("heavy", "block"), [(1 / 12, 50), (0.5, 1000), (2.0, 30), (0.0, 64)])
def test_cooccurring_equals_brute_force(spark, heavy, block):
    random.seed(2)
    rows = [(g, r, f"t{int(random.expovariate(0.25))}") for g in "xy" for r in range(200) for _ in range(random.randint(1, 9))]
    rows = sorted(set(rows)) + [("x", 1, None), (None, 1, "t0"), ("x", None, "t0")]
    df = spark.createDataFrame(rows, "grp string, record bigint, item string")
    got = C.cooccurring(df, 3, 0.01, 1.1, block_records=block, heavy_share=heavy)
    assert {(r.grp, r.item_a, r.item_b, r.n_both) for r in got.collect()} == brute_pairs(rows, 3, 0.01, 1.1)


def test_cooccurring_of_nothing(spark):
    assert C.cooccurring(spark.createDataFrame([], "grp string, record bigint, item string")).count() == 0


def test_periods(spark):
    labels = spark.createDataFrame([("1900-1919", 1900, 1919)], "bidecade string, start_year int, end_year int")
    rows = [(1, "1900 – 1919"), (1, None), (2, "1900—1919"), (3, "1899"), (4, None), (None, "1900-1919"), (5, "1900 - 1919")]
    got = record_periods(spark.createDataFrame(rows, "id_kase bigint, bidecade string"), labels)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "1900-1919"), (2, "1900-1919"), (5, "1900-1919")]


def test_two_poisson_recovers_rates():
    rng = np.random.default_rng(1)
    n = 20_000
    draws = np.where(rng.random(n) < 0.2, rng.poisson(9.0, n), rng.poisson(0.5, n))
    x, c = np.unique(draws[draws > 0], return_counts=True)
    share, elite, other = D.fit_two_poisson(np.array([0]), x, c, n)
    assert share[0] == pytest.approx(0.2, abs=0.02) and elite[0] == pytest.approx(9.0, abs=0.3) and other[0] == pytest.approx(0.5, abs=0.05)


def plain_em(histogram, total, rounds):
    """Expectation-maximisation written out for one term, from another start."""
    x, w = np.array([0, *histogram], float), np.array([total - sum(histogram.values()), *histogram.values()], float)
    share, elite, other = 0.05, 3.0, 0.01
    for _ in range(rounds):
        a, b = share * np.exp(-elite) * elite**x, (1 - share) * np.exp(-other) * other**x
        post = a / (a + b)
        share = (w * post).sum() / total
        elite, other = (w * x * post).sum() / (w * post).sum(), (w * x * (1 - post)).sum() / (w * (1 - post)).sum()
    return share, elite, other


HISTOGRAMS = [{1: 300, 2: 101, 5: 1}, {1: 30, 2: 11, 5: 1}, {1: 40, 3: 2}, {1: 5, 2: 5, 3: 5, 20: 5}]


@pytest.mark.parametrize("histogram", HISTOGRAMS)
def test_two_poisson_goes_on_until_it_stands_still(histogram):
    x, c = np.array(list(histogram)), np.array(list(histogram.values()))
    got = [v[0] for v in D.fit_two_poisson(np.array([0]), x, c, 100_000)]
    assert got == pytest.approx(plain_em(histogram, 100_000, 60_000), rel=1e-4)


def test_two_poisson_terms_do_not_touch_each_other():
    alone = [[v[0] for v in D.fit_two_poisson(np.array([0]), np.array(list(h)), np.array(list(h.values())), 5000)] for h in HISTOGRAMS]
    sizes = np.array([len(h) for h in HISTOGRAMS])
    x, c = (np.concatenate([list(f(h)) for h in HISTOGRAMS]) for f in (dict.keys, dict.values))
    together = np.array(D.fit_two_poisson(np.cumsum(sizes) - sizes, x, c, 5000)).T
    assert together.tolist() == alone


def test_counts_of_one_poisson_have_no_elite():
    share, elite, other = D.fit_two_poisson(np.array([0, 1]), np.array([1, 3]), np.array([40, 10]), 1000)
    assert share[0] == 0 and elite[0] == other[0] == pytest.approx(0.04) and share[1] > 0
    share, elite, other = D.fit_two_poisson(np.array([0]), np.array([2]), np.array([10]), 10)
    assert share[0] == 0 and elite[0] == other[0] == 2


def test_distinctiveness(spark):
    rows = [(1, "a", 3), (1, "b", 3), (2, "a", 1), (2, "b", 1), (3, "a", 9), (3, "only", 50)]
    df = spark.createDataFrame(rows, "id_kase bigint, term string, n bigint")
    got = {(r.id_kase, r.term): r for r in D.distinctiveness(df, min_records=2).collect()}
    assert set(got) == {(i, t) for i, t, _ in rows if t != "only"}
    assert got[1, "b"].score == pytest.approx(3 * (math.log(4 / 3) + 1)) and got[1, "b"].d == 2
    assert all(0 <= r.elite <= 1 for r in got.values()) and got[3, "a"].elite >= got[2, "a"].elite
    best = {r.id_kase: r.term for r in D.most_distinctive(D.distinctiveness(df, 2)).collect()}
    assert best == {1: "b", 2: "b", 3: "a"}
    assert D.distinctiveness(df.limit(0)).count() == 0


def test_distinctiveness_does_not_depend_on_the_partitions(spark):
    random.seed(3)
    rows = [(r, f"t{int(random.expovariate(0.1))}", 1 + int(random.expovariate(0.7))) for r in range(300) for _ in range(5)]
    rows = list({(r, t): (r, t, n) for r, t, n in rows}.values())
    df = spark.createDataFrame(rows, "id_kase bigint, term string, n bigint")
    found = [sorted(map(tuple, D.distinctiveness(df.repartition(k), 2).collect())) for k in (2, 20)]
    assert found[0] == found[1] and any(0 < r[-1] < 1 for r in found[0])


def test_ties_take_the_smallest_term(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 1), (2, "b", 1), (2, "a", 1)], "id_kase bigint, term string, n bigint")
    assert {r.term for r in D.most_distinctive(D.distinctiveness(df, 2)).collect()} == {"a"}


def test_records_of_any_kind(spark):
    rows = [("g", f"record {r}", i) for r in range(20) for i in ("a", "b", f"c{r}")]
    got = C.cooccurring(spark.createDataFrame(rows, "grp string, record string, item string"), 5).collect()
    assert [(r.item_a, r.item_b, r.n_both) for r in got] == [("a", "b", 20)]


def test_router_opens_long_beginnings(spark):
    url = "https://example.org/a/very/long/path/that/all/share/"
    rows = [(url + f"{i:05d}", [""], [1], [1]) for i in range(1000)] + [("q", [""], [1], [1])]
    df = spark.createDataFrame(rows, TC.SUBTRIE_DDL)
    opened = set(TC.opened_prefixes(df, shares=8, least=10, depth=5))
    assert {url[:k] for k in range(len(url) + 1)} <= opened and url + "00" in opened and "q" not in opened
