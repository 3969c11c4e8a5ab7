"""How distinctive a term is of a record: two-Poisson mixtures, and TF-IDF (problem 6).

The operator gives each row (record, term, n) both scores:

* ``elite``: the posterior probability that the record is of the term's elite
  class.  Over all records, the occurrence counts of a term are taken to be a
  mixture of two Poisson distributions; it is fitted by expectation-maximisation
  on the term's histogram of counts, records without the term included;
* ``score``: n * (ln((1 + N) / (1 + d)) + 1), N all records, d those with the term.

Each term is fitted by itself until its parameters stand still, with squared
extrapolation of the steps where that raises the likelihood; so the result does
not depend on what other terms are beside it.  The histogram of a term is small,
so the fit costs one row per term and distinct count.  Its three parameters come
back to the rows by a join on the term; terms so frequent that they would fill a
partition are few by construction (at most rows / hot_from) and are joined by
broadcast, and adaptive execution splits what skew is left.

Defined results: terms of fewer than ``min_records`` records give no rows; a term
whose counts vary no more than one Poisson's would (their variance is not above
their mean) has no elite class, and its posterior is 0; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.session import written

#: Greatest step of log odds and log rates at which a term is done, and the steps after which the fit gives up.
CLOSE = 1e-9
MOST_STEPS = 20_000
#: Most terms that may be joined by broadcast.
HOT_TERMS = 5_000


def _step(theta: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, w: np.ndarray, empty: np.ndarray, mass: np.ndarray):
    """One round of expectation-maximisation for all terms: (parameters after it, log likelihood before it).

    ``theta``: log odds of the elite share, log elite rate, log other rate, a column for each term.
    """
    odds, log_elite, log_other = theta
    elite, other = np.exp(log_elite), np.exp(log_other)
    # log of (share of the class * its probability of x), but for what both classes have
    log_one, log_two = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    a = np.repeat(log_one - elite, sizes) + x * np.repeat(log_elite, sizes)
    b = np.repeat(log_two - other, sizes) + x * np.repeat(log_other, sizes)
    both = np.logaddexp(a, b)
    a0, b0 = log_one - elite, log_two - other
    both0 = np.logaddexp(a0, b0)
    likelihood = np.add.reduceat(w * both, starts) + empty * both0
    post, post0 = np.exp(a - both), np.exp(a0 - both0)
    members = np.add.reduceat(w * post, starts) + empty * post0
    others = np.add.reduceat(w * np.exp(b - both), starts) + empty * np.exp(b0 - both0)
    drawn = np.add.reduceat(w * x * post, starts)
    least = 1e-300
    members, others = np.maximum(members, least), np.maximum(others, least)
    after = np.stack([np.log(members) - np.log(others), np.log(np.maximum(drawn, least) / members), np.log(np.maximum(mass - drawn, least) / others)])
    return np.clip(after, -600, 600), likelihood


def fit_two_poisson(starts: np.ndarray, counts: np.ndarray, records: np.ndarray, total: int):
    """Elite share, elite rate and other rate of each term; share 0 and both rates the mean where one Poisson fits as well.

    ``counts`` and ``records`` are the histograms of all terms, one after the
    other, beginning at ``starts``; records without the term are added here.
    """
    sizes = np.diff(np.r_[starts, len(counts)])
    x, w = counts.astype(float), records.astype(float)
    held, mass = np.add.reduceat(w, starts), np.add.reduceat(w * x, starts)
    empty = np.maximum(total - held, 0.0)
    everything = held + empty
    mean = mass / everything
    # the variance, without the difference of two great numbers
    spread = (np.add.reduceat(w * (x - np.repeat(mean, sizes)) ** 2, starts) + empty * mean**2) / everything
    share, elite, other = np.zeros(len(starts)), mean.copy(), mean.copy()
    left = np.flatnonzero(spread > mean * (1 + 1e-9))
    theta = np.stack([np.log(held / 2) - np.log(everything - held / 2), np.log(mass / held * 1.5), np.log(mean / 2)])[:, left]
    of_bin = np.repeat(np.arange(len(starts)), sizes)
    for _ in range(MOST_STEPS // 3):
        if not len(left):
            break
        of = np.isin(of_bin, left, assume_unique=False) if len(left) < len(starts) else slice(None)
        n = sizes[left]
        data = (np.cumsum(n) - n, n, x[of], w[of], empty[left], mass[left])
        one, _ = _step(theta, *data)
        two, _ = _step(one, *data)
        r, v = one - theta, two - 2 * one + theta
        size_v = np.sqrt((v * v).sum(axis=0))
        alpha = -np.clip(np.sqrt((r * r).sum(axis=0)) / np.maximum(size_v, 1e-300), 1.0, 1e6)
        # the extrapolated step counts where it raises the likelihood
        far = np.clip(theta - 2 * alpha * r + alpha * alpha * v, -600, 600)
        after, reached = _step(far, *data)
        _, usual = _step(two, *data)
        better = np.isfinite(reached) & (reached >= usual) & np.isfinite(after).all(axis=0)
        theta = np.where(better, after, two)
        done = np.abs(two - one).max(axis=0) < CLOSE
        share[left[done]], elite[left[done]], other[left[done]] = 1 / (1 + np.exp(-two[0, done])), np.exp(two[1, done]), np.exp(two[2, done])
        left, theta = left[~done], theta[:, ~done]
    if len(left):
        share[left], elite[left], other[left] = 1 / (1 + np.exp(-theta[0])), np.exp(theta[1]), np.exp(theta[2])
    swap = elite < other
    return np.where(swap, 1 - share, share), np.where(swap, other, elite), np.where(swap, elite, other)


FITTED = pa.schema([("term", pa.string()), ("d", pa.int64()), ("share", pa.float64()), ("elite_rate", pa.float64()), ("other_rate", pa.float64())])


def _fitted(total: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column(2)
            offsets = bins.offsets.to_numpy()
            values = bins.flatten()
            x, c = values.field(0).to_numpy(), values.field(1).to_numpy()
            share, elite, other = fit_two_poisson((offsets[:-1] - offsets[0]).astype(np.int64), x, c, total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share), pa.array(elite), pa.array(other)], schema=FITTED)

    return fit


def distinctiveness(rows: DataFrame, min_records: int = 1) -> DataFrame:
    """``id_kase, term, n, d, records, score, elite`` of rows ``id_kase, term, n``.

    ``rows`` is read several times: give it a table.
    """
    n_rows, total = rows.agg(F.count("*"), F.countDistinct("id_kase")).first()
    bins = rows.groupBy("term", "n").agg(F.count("*").alias("c"))
    histograms = bins.groupBy("term").agg(F.sum("c").alias("d"), F.array_sort(F.collect_list(F.struct("n", "c"))).alias("bins"))
    stats = histograms.filter(F.col("d") >= min_records).mapInArrow(_fitted(total), "term string, d bigint, share double, elite_rate double, other_rate double")
    stats = written(stats, "termstats")
    hot_from = max(10_000, n_rows // HOT_TERMS)
    hot, rest = stats.filter(F.col("d") > hot_from), stats.filter(F.col("d") <= hot_from)
    if hot.isEmpty():
        joined = rows.join(rest, "term")
    else:  # at most HOT_TERMS, as each has over rows / HOT_TERMS rows
        names = F.broadcast(hot.select("term"))
        joined = rows.join(F.broadcast(hot), "term").unionByName(rows.join(names, "term", "left_anti").join(rest, "term"))
    score = F.col("n") * (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("d"))) + 1)
    log_odds = F.log(F.col("share") / (1 - F.col("share"))) + F.col("n") * F.log(F.col("elite_rate") / F.col("other_rate")) - (F.col("elite_rate") - F.col("other_rate"))
    elite = F.when(F.col("share") > 0, 1 / (1 + F.exp(-F.greatest(F.least(log_odds, F.lit(700.0)), F.lit(-700.0))))).otherwise(0.0)
    return joined.select("id_kase", "term", "n", "d", F.lit(total).cast("bigint").alias("records"), score.alias("score"), elite.alias("elite"))


def most_distinctive(scored: DataFrame, by: str = "score") -> DataFrame:
    """One row per record: its term of the highest score; of scores equal to nine decimals the smallest term.

    A grouped minimum, combined before the shuffle, so the size of a record doesn't matter.
    """
    best = F.min(F.struct((-F.round(F.col(by), 9)).alias("s"), F.col("term")))
    return scored.groupBy("id_kase").agg(best.alias("b")).select("id_kase", F.col("b.term").alias("term"))
