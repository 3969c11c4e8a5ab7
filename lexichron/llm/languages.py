"""Languages of documents and of their stretches: rank-order profiles (problem 5).

A profile is the list of a language's most frequent n-grams of one to three
characters, words being set off by spaces, in order of frequency.  Each sentence
is compared with each language by the out-of-place distance: for each of its
n-grams, how far its rank in the sentence lies from its rank in the profile, and
a fixed penalty where the profile lacks it.  Sentences of the same language that
follow one another make a segment.

The languages are those of the table of labels.  Profiles are fitted here, on all
labelled documents; the n-grams are counted in the executors, and only the
profiles come to the driver.  Labels may be wrong, so the fit is done twice: the
second time each sentence of a labelled document counts for the language that the
first profiles give it.  A language is compared only with sentences in its script,
which is the one that most documents under its label are in: by letters, a few long
documents with a wrong label would outweigh all others, and a Han character only
counts as much as a Latin letter.

A sentence farther from its nearest language than ``unknown`` has language
``und``: that limit lies half-way between the distance that all but a thousandth
of these sentences keep to their own language and the usual distance to
the farthest language of the script (where a script has but one, to none at all).

Defined results: null, empty and blank texts, and texts without a letter of a
known script, have no segment; a sentence with few letters, or whose two nearest
languages are almost as near, takes the language of the sentence before it (else
after it) in the same script; headings are part of the stretch they stand in but
make no language of their own, unless the text has nothing else.  Without a
labelled document there are no profiles, and no segments.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexichron.llm.sentences import Split, Words, joined, split_batch, words_known
from lexichron.llm.tokens import in_share, share, slices, spread
from lexichron.session import cores, discard, written

#: N-grams of a profile, which is also the penalty for one that is missing.
PROFILE = 1500
#: Documents of each label in ``labelled_sample``, and the most characters of one.
SAMPLE = 300
SAMPLE_CHARS = 20_000
#: Letters from which a sentence is judged by itself, and the least lead of the nearest language.
FEW_LETTERS = 12
LEAST_LEAD = 0.14
#: The language of sentences in none of the known ones, and the letters from which a sentence may be found so.
UNDETERMINED = "und"
UNKNOWN_LETTERS = 40

# Scripts, by the first and last code point of their letters.
RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x963), (0x970, 0x97F)],
    "thai": [(0xE01, 0xE3A), (0xE40, 0xE4E)],
    "kana": [(0x3041, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFFFE, 0xFFFE)],
    "hebrew": [(0x5D0, 0x5F4)],
    "armenian": [(0x531, 0x588)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "ethiopic": [(0x1200, 0x139F)],
}
NAMES = list(RANGES)
#: Bits of a character in an n-gram, and the most sentences beside three characters in 64 bits.
BITS = 16
MOST_SENTENCES = 1 << 16
#: Sentences that are judged at once: few enough that their n-grams stay in a core's cache.
JUDGED_AT_ONCE = 1 << 11
#: Letters that are numbered in eight bits in a batch, so that three of them and a sentence or group fit 32 bits; sentences that
#: are judged or counted at once then, and the characters of groups that are; the most characters of a sentence that goes this way.
NUMBERED = 253
NONE_NUMBER, NO_NUMBER = 254, 255
NUMBERED_AT_ONCE, CHARS_AT_ONCE = 1 << 8, 1 << 17
NUMBERED_CHARS = 500_000
#: Four ranks in 64 bits, and every other one of them.
LANES, EVERY_OTHER = 0x0001000100010001, 0x0000FFFF0000FFFF
#: Parts of a language's n-grams that are ranked by themselves first.
PARTS = 64
NONE = 0xFFFF
#: Beyond the basic plane, Han characters are one character, and there are no other letters.
BEYOND_HAN, BEYOND = 0xFFFE, 0xFFFF
#: Bits of the tables that find n-grams.
SLOT_BITS = 18
WORD_LETTERS = 12
_UNSPACED = np.asarray([False, *[name in ("thai", "kana", "han") for name in RANGES]])


def _script_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for k, ranges in enumerate(RANGES.values()):
        for a, b in ranges:
            for i in range(a, b + 1):
                # the vowel signs of Indic and Thai script are letters here
                if i == BEYOND_HAN or chr(i).isalpha() or 0x900 <= i < 0xE80 and unicodedata.category(chr(i)) in ("Mn", "Mc", "Lm"):
                    table[i] = k + 1
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        low = chr(i).lower() if chr(i).isupper() else ""
        if len(low) == 1:
            table[i] = ord(low)
    return table


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Script of each character, and its lower-case form; 0 for what is no letter."""
    if not _TABLES:
        scripts, lower = _script_table(), _lower_table()
        _TABLES.extend([scripts, np.where(scripts > 0, lower, 0).astype(np.uint16)])
    return _TABLES


@dataclass
class Profiles:
    """Ranks of n-grams, a row for each language; rank PROFILE is absence.

    ``scripts``: each language's script, -1 without a profile; ``keys``: the n-grams, sorted; ``unknown``: the
    distance from which a sentence is in none of the languages.
    """

    languages: list[str]
    scripts: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    unknown: np.ndarray
    _tables: list[np.ndarray] = field(default_factory=list)
    _wide: list[np.ndarray] = field(default_factory=list)
    _rows: list[np.ndarray] = field(default_factory=list)
    _fours: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def wide_ranks(self) -> np.ndarray:
        """``ranks`` as numbers that can be summed."""
        if not self._wide:
            self._wide.append(self.ranks.astype(np.int32))
        return self._wide[0]

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram, -1 if no profile has it: hashed tables, then a comparison of the n-grams themselves."""
        if not self._tables:
            left = np.arange(len(self.keys))
            while True:
                slots = self._slots(self.keys[left], len(self._tables))
                table = np.full(1 << SLOT_BITS, -1, np.int32)
                _, one = np.unique(slots, return_index=True)
                table[slots[one]] = left[one]
                self._tables.append(table)
                left = np.delete(left, one)  # those whose slot is taken go to another table
                if not len(left):
                    break
        row = self._tables[0].take(self._slots(grams, 0))
        left = np.flatnonzero((self.keys.take(row, mode="clip") != grams) | (row < 0))  # few are in another table or in none
        row[left] = -1
        for k in range(1, len(self._tables)):
            found = self._tables[k].take(self._slots(grams[left], k))
            hit = (self.keys.take(found, mode="clip") == grams[left]) & (found >= 0)
            row[left[hit]] = found[hit]
            left = left[~hit]
        return row

    @staticmethod
    def _slots(grams: np.ndarray, k: int) -> np.ndarray:
        return (grams * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))) >> np.uint64(64 - SLOT_BITS)

    def numbered_rows(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, places): the row of each n-gram of numbered letters, ``len(keys)`` if no profile has it, and the places that aren't that.

        The table is the same one each time; whoever is done with it sets the places back.
        """
        if not self._rows:
            self._rows.append(np.full(1 << 24, len(self.keys), np.int16 if len(self.keys) < 1 << 15 else np.int32))
        parts = [number[(self.keys >> np.uint64(shift)).astype(np.uint16)].astype(np.int32) for shift in (2 * BITS, BITS, 0)]
        rows = np.flatnonzero(np.logical_and.reduce([x != NO_NUMBER for x in parts]))
        places = (parts[0] << 16 | parts[1] << 8 | parts[2])[rows]
        self._rows[0][places] = rows
        return self._rows[0], places

    def fours(self, kind: int) -> list[np.ndarray]:
        """Ranks by row of the languages of a script, four to a number, the first lowest; the row after the last is of absent n-grams."""
        if kind not in self._fours:
            its = np.pad(self.ranks[self.scripts == kind].astype(np.uint64), ((0, -int((self.scripts == kind).sum()) % 4), (0, 1)), constant_values=PROFILE)
            self._fours[kind] = [its[k] | its[k + 1] << np.uint64(16) | its[k + 2] << np.uint64(32) | its[k + 3] << np.uint64(48) for k in range(0, len(its), 4)]
        return self._fours[kind]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": [], "_wide": [], "_rows": [], "_fours": {}}


def _letters(points: np.ndarray) -> np.ndarray:
    """Code points as the tables have them."""
    if not len(points) or points.max() <= 0xFFFF:
        return points
    out, beyond = points.copy(), np.flatnonzero(points > 0xFFFF)
    out[beyond] = np.where((points[beyond] >= 0x20000) & (points[beyond] < 0x32000), BEYOND_HAN, BEYOND)
    return out


def _grams(points: np.ndarray, sentence: np.ndarray):
    """Sorted keys (sentence << 48 | n-gram) of all n-grams, from code points and their sentences (-1: none)."""
    code = np.zeros(len(points) + 2, np.uint64)
    code[1:-1] = _tables()[1][points]
    code[1:-1][sentence < 0] = 0
    at = np.flatnonzero(code)
    # what isn't a letter separates words: 0, which belongs to the letter before it as well as to the one after it
    left, here, right = code[at - 1], code[at], code[at + 1]
    of = sentence[at - 1]
    # letters of two sentences without a gap between are no n-gram
    apart = np.flatnonzero((of[1:] != of[:-1]) & (at[1:] - at[:-1] == 1))
    right[apart], left[apart + 1] = 0, 0
    base = of.astype(np.uint64) << np.uint64(3 * BITS)
    opening = np.flatnonzero(left == 0)
    n, two, one, none = len(at), np.uint64(2 * BITS), np.uint64(BITS), np.uint64(NONE)
    keys = np.empty(3 * n + len(opening), np.uint64)
    single, pair, triple = keys[:n], keys[n : 2 * n], keys[2 * n : 3 * n]
    np.bitwise_or(base, here << two, out=single)
    np.bitwise_or(single, right << one | none, out=pair)
    single |= none << one | none
    here <<= one
    here |= base
    np.bitwise_or(here, left << two | right, out=triple)
    keys[3 * n :] = here[opening] | none
    keys.sort()
    return keys


def _ranked(keys: np.ndarray, sentences: int):
    """Distinct n-grams of each sentence, with their mean rank by falling count, at most PROFILE - 1: (sentence, n-gram, rank)."""
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    distinct = keys[np.r_[0, edge]]
    of = (distinct >> np.uint64(3 * BITS)).astype(np.int32)
    level = np.minimum(np.diff(np.r_[0, edge, len(keys)]), 63)
    level += of * 64
    held = np.bincount(level, minlength=sentences * 64).reshape(sentences, 64)
    above = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held
    rank = np.minimum(above + (held - 1) / 2, PROFILE - 1).astype(np.int16).ravel()[level]
    return of, distinct & np.uint64((1 << 3 * BITS) - 1), rank


def distances(profiles: Profiles, points: np.ndarray, sentence: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Out-of-place distance of each sentence to each language of its script, per distinct n-gram; else infinite."""
    sentences = len(script)
    out = np.full((sentences, len(profiles.languages)), np.inf)
    keys = _grams(points, sentence) if len(points) else np.empty(0, np.uint64)
    if not len(keys) or not len(profiles.keys):
        return out
    of, gram, rank = _ranked(keys, sentences)
    at = profiles.places(gram)
    total = np.bincount(of, minlength=sentences)
    found = np.flatnonzero(at >= 0)
    if len(found) < len(at):
        at, of, rank = at[found], of[found], rank[found]
    rank = rank.astype(np.int32)
    found_of = np.bincount(of, minlength=sentences)
    for kind in np.unique(script[script >= 0]).tolist():
        its = np.flatnonzero(profiles.scripts == kind)
        belongs = script == kind
        members = np.flatnonzero(belongs)
        if not len(its):
            continue
        own = np.flatnonzero(np.repeat(belongs, found_of)) if len(members) < sentences else slice(None)
        off = np.zeros((sentences, len(its)), np.int64)
        found_in = np.where(belongs, found_of, 0)
        held = np.flatnonzero(found_in)
        if len(held):
            its_at, its_rank, edges = at[own], rank[own], np.cumsum(found_in[held]) - found_in[held]
            for k, language in enumerate(its.tolist()):
                apart = profiles.wide_ranks()[language].take(its_at)
                apart -= its_rank
                off[held, k] = np.add.reduceat(np.abs(apart, out=apart), edges)
        missing = (total - found_in) * PROFILE
        out[np.ix_(members, its)] = ((off + missing[:, None]) / np.maximum(total, 1)[:, None])[members]
    return out


def script_counts(points: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
    """Letters of each script in each sentence. Of a word no more than ``WORD_LETTERS`` count, in scripts that set words off."""
    kinds, kind = len(NAMES) + 1, _tables()[0].take(points)
    kind *= sentence >= 0
    of = sentence.astype(np.int32 if sentences < 1 << 26 else np.int64)
    of += 1
    of *= kinds
    of += kind
    counts = np.bincount(of, minlength=(sentences + 1) * kinds)
    gaps = np.r_[-1, np.flatnonzero(kind == 0), len(kind)]
    long = np.flatnonzero(np.diff(gaps) > WORD_LETTERS + 1)
    begin = gaps[long] + WORD_LETTERS + 1
    sizes = gaps[long + 1] - begin
    over = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    counts -= np.bincount(of[over[~_UNSPACED[kind[over]]]], minlength=len(counts))
    return counts.reshape(-1, kinds)[1:, 1:]


def main_script(counts: np.ndarray) -> np.ndarray:
    """Script of each sentence; -1 without letters. Kana, even a fifth of it, makes Han Japanese."""
    counts = counts.copy()
    kana, han = NAMES.index("kana"), NAMES.index("han")
    both = counts[:, kana] + counts[:, han]
    japanese = counts[:, kana] * 5 >= np.maximum(both, 1)
    counts[:, kana], counts[:, han] = np.where(japanese, both, 0), np.where(japanese, 0, both)
    return np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1), -1)


@dataclass
class Judged:
    """Of each sentence: language (-1: none), next nearest (-1: none), distances to the nearest and the farthest (0 to 1), lead, script, letters."""

    language: np.ndarray
    runner_up: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    lead: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def _decided(d: np.ndarray, script: np.ndarray, total: np.ndarray) -> Judged:
    """Of sentences at distances ``d``, which are changed, with ``total`` letters."""
    sentences = len(script)
    if not d.shape[1] or not sentences:
        none = np.full(sentences, -1)
        return Judged(none, none, np.ones(sentences), np.ones(sentences), np.zeros(sentences), script, total)
    rows, best = np.arange(sentences), d.argmin(axis=1)
    nearest = d[rows, best]
    d[rows, best] = np.inf
    farthest = np.where(np.isfinite(d), d, -1).max(axis=1)
    runner_up = np.where(np.isfinite(d.min(axis=1)), d.argmin(axis=1), -1)
    second = np.minimum(d.min(axis=1), PROFILE)
    lead = np.where(np.isfinite(nearest), 1 - nearest / np.maximum(second, 1e-9), 0.0)
    language = np.where(np.isfinite(nearest), best, -1)
    return Judged(language, runner_up, np.minimum(nearest, PROFILE) / PROFILE, np.where(farthest < 0, 1, farthest / PROFILE), np.clip(lead, 0, 1), script, total)


GRAMS_DDL = "lang int, script int, gram bigint, n bigint"
GRAMS = pa.schema([("lang", pa.int32()), ("script", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of sentences one after another, with a 0 before the first and after each, and where each begins."""
    at = np.r_[1, 1 + np.cumsum(sizes + 1)]
    where = np.repeat(starts - at[:-1], sizes + 1)
    where += np.arange(1, at[-1])
    out = np.zeros(at[-1] + 1, values.dtype)
    values.take(where, mode="clip", out=out[1:-1])
    out[at[1:] - 1] = 0
    return out, at


@dataclass
class Scripts:
    """Script and letters of each sentence, and script of each text; -1 without letters."""

    script: np.ndarray
    letters: np.ndarray
    of_text: np.ndarray


def _scripts(found: Split) -> Scripts:
    of = np.full(2 * len(found.starts) + 1, -1, np.int32)
    of[1::2] = np.arange(len(found.starts))
    places = np.stack([found.starts, found.ends], axis=1).ravel()
    counts = script_counts(_letters(found.points), np.repeat(of, np.diff(places, prepend=0, append=len(found.points))), len(found.starts))
    of_text = np.zeros((len(found.bounds), len(NAMES)), np.int64)
    first = np.flatnonzero(np.diff(found.text_of, prepend=-1))
    of_text[found.text_of[first]] = np.add.reduceat(counts, first) if len(first) else 0
    return Scripts(main_script(counts), counts.sum(axis=1), main_script(of_text))


@dataclass
class Batch:
    """Sentences of a batch: points, places and sizes; number of each character's letter, of each letter, and the letters of numbers; scripts.

    ``numbered``: which sentences have numbered letters only.
    """

    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    number: np.ndarray
    letter: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    numbered: np.ndarray


def _batch(found: Split, scripts: Scripts) -> Batch:
    points, starts, sizes = _letters(found.points), found.starts, found.ends - found.starts
    letters = _tables()[1].take(points)
    n = np.bincount(letters, minlength=1 << BITS)
    n[0] = 0
    held = np.flatnonzero(n)
    most = held[np.argsort(-n[held], kind="stable")[:NUMBERED]]
    number = np.full(1 << BITS, NO_NUMBER, np.uint8)
    number[most] = np.arange(1, len(most) + 1)
    number[[0, NONE]] = 0, NONE_NUMBER
    letter = np.zeros(256, np.uint64)
    letter[1 : len(most) + 1], letter[NONE_NUMBER] = most, NONE
    numbers = number.take(letters)
    numbered = (np.maximum.reduceat(numbers, starts) < NO_NUMBER if len(starts) else np.zeros(0, bool)) & (sizes <= NUMBERED_CHARS)
    return Batch(points, starts, sizes, numbers, number, letter, scripts.script, scripts.letters, numbered)


def _numbered_grams(numbers: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sorted keys (of << 24 | n-gram) of all n-grams of numbered letters; ``numbers`` has one more number at either end than ``of``."""
    right = numbers[2:]
    keys = numbers[:-2].astype(np.uint32) << np.uint32(16)
    keys |= numbers[1:-1].astype(np.uint32) << np.uint32(8)
    keys |= right
    keys |= of << np.uint32(24)
    triple = keys.take(np.flatnonzero(numbers[1:-1]))
    opening = triple.take(np.flatnonzero(triple & np.uint32(0xFF0000) == 0))
    n = len(triple)
    out = np.empty(3 * n + len(opening), np.uint32)
    base = triple & np.uint32(0xFF000000)
    out[:n] = triple
    triple <<= np.uint32(8)
    np.bitwise_or(triple & np.uint32(0xFFFF00) | np.uint32(NONE_NUMBER), base, out=out[n : 2 * n])
    triple &= np.uint32(0xFF0000)
    triple |= np.uint32(NONE_NUMBER << 8 | NONE_NUMBER)
    np.bitwise_or(triple, base, out=out[2 * n : 3 * n])
    np.bitwise_or(opening & np.uint32(0xFF00FF00), np.uint32(NONE_NUMBER), out=out[3 * n :])
    out.sort()
    return out


def _wide(grams: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """N-grams of letters from those of their numbers."""
    one, two, three = (letter.take((grams >> np.uint32(shift)) & np.uint32(0xFF)) for shift in (16, 8, 0))
    return one << np.uint64(2 * BITS) | two << np.uint64(BITS) | three


def _judged(profiles: Profiles, batch: Batch) -> Judged:
    """All sentences of a batch."""
    d = np.full((len(batch.script), len(profiles.languages)), np.inf)
    can = np.isin(batch.script, profiles.scripts[profiles.scripts >= 0]) & (len(profiles.keys) > 0)
    ours, others = np.flatnonzero(can & batch.numbered), np.flatnonzero(can & ~batch.numbered)
    ours = ours[np.argsort(batch.script[ours], kind="stable")]
    numbers, at = _gathered(batch.numbers, batch.starts[ours], batch.sizes[ours])
    table, places = profiles.numbered_rows(batch.number) if len(ours) else (None, None)
    edges = np.flatnonzero(np.diff(batch.script[ours], prepend=-1))
    for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(ours)]):
        kind = int(batch.script[ours[begin]])
        its = np.flatnonzero(profiles.scripts == kind)
        for a in range(begin, end, NUMBERED_AT_ONCE):
            members = ours[a : min(a + NUMBERED_AT_ONCE, end)]
            where = at[a : a + len(members) + 1]
            of = np.repeat(np.arange(len(members), dtype=np.uint32), np.diff(where))
            away = _numbered_distances(profiles, kind, table, _numbered_grams(numbers[where[0] - 1 : where[-1] + 1], of), len(members))
            d[np.ix_(members, its)] = away[:, : len(its)]
    if len(ours):
        table[places] = len(profiles.keys)
    for a in range(0, len(others), JUDGED_AT_ONCE):
        members = others[a : a + JUDGED_AT_ONCE]
        for points, sentence, b, c in _blocks(batch, members):
            d[members[b:c]] = distances(profiles, points, sentence, batch.script[members[b:c]])
    return _decided(d, batch.script, batch.letters)


def _numbered_distances(profiles: Profiles, kind: int, table: np.ndarray, keys: np.ndarray, sentences: int) -> np.ndarray:
    """``distances`` of sentences in one script to its languages, from sorted keys; columns up to a multiple of four."""
    edge = np.flatnonzero(keys[1:] != keys[:-1])
    edge += 1
    edge = np.r_[0, edge, len(keys)] if len(keys) else np.zeros(1, np.int64)
    distinct, n = keys.take(edge[:-1]), np.diff(edge)
    begin = np.searchsorted(distinct, np.arange(sentences, dtype=np.uint32) << np.uint32(24))
    total = np.diff(begin, append=len(distinct))
    # most n-grams of a sentence are there once
    often = np.flatnonzero(n > 1)
    level = np.minimum(n.take(often), 63)
    levels = int(level.max(initial=1)) + 1
    level += (distinct.take(often) >> np.uint32(24)).astype(np.intp) * levels
    held = np.bincount(level, minlength=sentences * levels).reshape(sentences, levels)
    held[:, 1] = total - held.sum(axis=1)
    above = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held
    rank_of = np.minimum(above + (held - 1) / 2, PROFILE - 1).astype(np.int16).astype(np.uint64) * np.uint64(LANES)
    ranks = np.repeat(rank_of[:, 1], total)
    ranks[often] = rank_of.ravel().take(level)
    row = table.take(distinct & np.uint32(0xFFFFFF)).astype(np.intp)
    some = np.flatnonzero(total)
    begin = begin[some]
    # an absent n-gram has rank PROFILE here, and is as far as that whatever its rank in the sentence
    absent = np.flatnonzero(row == len(profiles.keys))
    missing = np.bincount(distinct.take(absent) >> np.uint32(24), weights=ranks.take(absent) & np.uint64(0xFFFF), minlength=sentences)
    fours = profiles.fours(kind)
    off = np.zeros((sentences, 4 * len(fours)))
    for k, four in enumerate(fours):
        apart = four.take(row)
        each = apart.view(np.int16)
        each -= ranks.view(np.int16)
        np.abs(each, out=each)
        for odd in (0, 1):
            lanes = np.add.reduceat(apart >> np.uint64(16) & np.uint64(EVERY_OTHER) if odd else apart & np.uint64(EVERY_OTHER), begin) if len(some) else np.empty(0, np.uint64)
            off[some, 4 * k + odd] = lanes & np.uint64(0xFFFFFFFF)
            off[some, 4 * k + odd + 2] = lanes >> np.uint64(32)
    return (off + missing[:, None]) / np.maximum(total, 1)[:, None]


def _blocks(batch: Batch, members: np.ndarray):
    """Code points and sentences (-1: none) of some sentences, in blocks of no more than a key can hold: (points, sentence, first, last)."""
    for a in range(0, len(members), MOST_SENTENCES):
        some = members[a : a + MOST_SENTENCES]
        points, at = _gathered(batch.points, batch.starts[some], batch.sizes[some])
        sentence = np.full(len(points), -1, np.int32)
        sentence[1:-1] = np.repeat(np.arange(len(some)), np.diff(at))
        sentence[at - 1] = -1
        yield points, sentence, a, a + len(some)


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted keys, and how many there are, or the sum of their ``n``."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    edge = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    return keys[edge], np.diff(np.r_[edge, len(keys)]) if n is None else np.add.reduceat(n, edge)


def _added(parts: list[tuple[np.ndarray, np.ndarray]], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, and the sums of their counts."""
    keys, n = (np.concatenate([np.empty(0, t), *(p[k] for p in parts)]) for k, t in enumerate((kind, np.int64)))
    order = np.argsort(keys)
    return _summed(keys[order], n[order])


def _gram_rows(group: np.ndarray, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((group // len(NAMES)).astype(np.int32)), pa.array((group % len(NAMES)).astype(np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], schema=GRAMS)


def _counted_wide(batch: Batch, members: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, n-grams and counts of some sentences; ``group``: that of each sentence of the batch, -1 for none."""
    members = members[group[members] >= 0]
    used, number = np.unique(group[members], return_inverse=True)
    parts = [_summed(_grams(points, np.where(sentence >= 0, number[a:b].astype(np.int32)[sentence], -1))) for points, sentence, a, b in _blocks(batch, members)]
    keys, n = _added(parts, np.uint64)
    return used[(keys >> np.uint64(3 * BITS)).astype(np.int64)], keys & np.uint64((1 << 3 * BITS) - 1), n


def _counted(batch: Batch, group: np.ndarray, times: int = 1) -> pa.RecordBatch:
    """Counts of n-grams, ``times`` that, by group of the sentence (-1: none), which is ``language * len(NAMES) + script``."""
    used, number = np.unique(group[group >= 0], return_inverse=True)
    of_sentence = np.full(len(group), len(used))
    of_sentence[group >= 0] = number
    fits = batch.numbered & (of_sentence < min(len(used), 256))
    ours = np.flatnonzero(fits)
    ours = ours[np.argsort(of_sentence[ours], kind="stable")]
    numbers, at = _gathered(batch.numbers, batch.starts[ours], batch.sizes[ours])
    parts = []
    edges = np.unique(np.searchsorted(at, np.arange(1, at[-1] + CHARS_AT_ONCE, CHARS_AT_ONCE)).clip(max=len(ours)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        of = np.repeat(of_sentence[ours[a:b]].astype(np.uint32), np.diff(at[a : b + 1]))
        parts.append(_summed(_numbered_grams(numbers[at[a] - 1 : at[b] + 1], of)))
    keys, n = _added(parts, np.uint32)
    other_group, other_gram, other_n = _counted_wide(batch, np.flatnonzero(~fits), group)
    return _gram_rows(np.r_[used[keys >> np.uint32(24)], other_group], np.r_[_wide(keys & np.uint32(0xFFFFFF), batch.letter), other_gram], times * np.r_[n, other_n])


#: Instead of an n-gram: a document in this script.
VOTE = -1


def _main_scripts(summed: DataFrame, languages: list[str]) -> np.ndarray:
    """The script of most documents of each language, -1 without any."""
    totals = summed.groupBy("lang", "script").agg(F.sum(F.when(F.col("gram") == VOTE, F.col("n")).otherwise(0)).alias("n")).collect()  # at most languages x scripts
    scripts = np.full(len(languages), -1)
    for _, script, lang in sorted((n, -script, lang) for lang, script, n in totals):
        scripts[lang] = -script
    return scripts


def _in_main_script(summed: DataFrame, scripts: np.ndarray) -> DataFrame:
    """The counts of n-grams of each language in its script."""
    known = [F.lit(int(x)) for k in np.flatnonzero(scripts >= 0) for x in (k, scripts[k])]
    return summed.filter((F.create_map(*known)[F.col("lang")] == F.col("script")) & (F.col("gram") != VOTE)) if known else summed.limit(0)


def _profiles_of(summed: DataFrame, scripts: np.ndarray, languages: list[str]) -> Profiles:
    """The most frequent n-grams of each language; at most PROFILE rows a language are collected."""
    # no task sorts all n-grams of a language: those of a part come first, then the first of all parts
    in_part = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(F.desc("n"), "gram")
    first = summed.withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= PROFILE)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= PROFILE)
    rows = ranked.select("lang", "gram", "rank").collect() if (scripts >= 0).any() else []
    lang, gram, rank = (np.asarray([row[k] for row in rows], np.int64) for k in range(3))
    keys = np.unique(gram.astype(np.uint64))
    ranks = np.full((len(languages), len(keys)), PROFILE, np.int16)
    ranks[lang, np.searchsorted(keys, gram.astype(np.uint64))] = rank - 1
    return Profiles(languages, scripts.copy(), keys, ranks, np.full(len(languages), np.inf))


#: What is kept of each sentence: by ``placed``; and by ``judged``, with what ``Judged`` has and whether it is a heading.
PLACED = np.dtype([("start", "<i4"), ("end", "<i4"), ("script", "<i4"), ("letters", "<i4")])
JUDGED = np.dtype([("start", "<i4"), ("end", "<i4"), ("language", "<i4"), ("runner_up", "<i4"), ("nearest", "<f8"), ("farthest", "<f8"), ("lead", "<f8"), ("script", "<i4"), ("letters", "<i4"), ("heading", "<i4")])
#: What ``placed`` adds: the records of a text's sentences, one after another, and the text's script.
FOUND = [T.StructField("sentences", T.BinaryType()), T.StructField("script", T.IntegerType())]


def _records(kind: np.dtype, text_of: np.ndarray, texts: int, **values: np.ndarray) -> pa.Array:
    """The records of each text's sentences as bytes: a list a column would be taken apart and put together by the JVM for each number."""
    records = np.empty(len(text_of), kind)
    for name in kind.names:
        records[name] = values[name]
    at = np.searchsorted(text_of, np.arange(texts + 1)).astype(np.int64) * kind.itemsize
    return pa.Array.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(at), pa.py_buffer(records)]).cast(pa.binary())


def _sentences(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(text of each sentence, records)."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // kind.itemsize
    return np.repeat(np.arange(len(column)), sizes), np.frombuffer(b"".join(column.to_pylist()), kind)


def placed(documents: DataFrame, learned: frozenset[str] = frozenset()) -> DataFrame:
    """``documents`` with what is ``PLACED`` of the sentences of ``text``, and its ``script``, so that texts which are read again needn't be split again."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_known(learned)
        for whole in batches:
            for batch in slices(whole, at, 1_000_000):
                found = split_batch(batch.column(at).to_pylist(), known)
                base = found.bounds[found.text_of]
                scripts = _scripts(found)
                records = _records(PLACED, found.text_of, batch.num_rows, start=found.starts - base, end=found.ends - base, script=scripts.script, letters=scripts.letters)
                yield pa.RecordBatch.from_arrays([*batch.columns, records, pa.array(scripts.of_text, pa.int32())], names=[*batch.schema.names, *(f.name for f in FOUND)])

    return spread(documents).mapInArrow(run, T.StructType([*documents.schema.fields, *FOUND]))


def _restored(texts: list[str | None], sentences: pa.Array, script: pa.Array) -> tuple[Split, Scripts]:
    """The sentences of ``placed`` texts."""
    points, bounds = joined(texts)
    text_of, of = _sentences(sentences, PLACED)
    base = bounds[text_of]
    return Split(points, bounds, of["start"] + base, of["end"] + base, text_of), Scripts(of["script"], of["letters"], script.to_numpy())


def _found(documents: DataFrame) -> list[str]:
    """The columns that ``placed`` added, if it did."""
    names = [f.name for f in FOUND]
    return names if set(names) <= set(documents.columns) else []


def _splits(documents: DataFrame, learned: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[str | None], Split, Scripts]]]:
    """What gives slices of batches of ``documents``, with their texts and sentences: those of ``placed`` texts, else found here."""
    text, found_at = documents.columns.index("text"), [documents.columns.index(x) for x in _found(documents)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None], Split, Scripts]]:
        known = words_known(learned)
        for whole in batches:
            for batch in slices(whole, text, 1_000_000):
                texts = batch.column(text).to_pylist()
                if found_at:
                    yield batch, texts, *_restored(texts, *(batch.column(k) for k in found_at))
                else:
                    found = split_batch(texts, known)
                    yield batch, texts, found, _scripts(found)

    return run


def _labelled(documents: DataFrame, languages: list[str]) -> DataFrame:
    return documents.filter(F.col("text").isNotNull() & F.col("lang").isin(languages))


def fitted_profiles(documents: DataFrame, languages: list[str], learned: frozenset[str] = frozenset(), rounds: int = 2) -> Profiles:
    """Profiles without limits, from all rows ``text, lang`` whose label is one of ``languages``, in order. ``documents`` is read once a round.

    N-grams are counted by label. Later rounds count again only the sentences which are then another language's, or none's:
    off what was counted by label, and on to the other language.
    """
    source = spread(_labelled(documents, languages).select("text", "lang", *_found(documents)))
    splits = _splits(source, learned)

    def labels(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)

    def by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found, scripts in splits(batches):
            label = labels(batch)
            yield _counted(_batch(found, scripts), np.where(scripts.script >= 0, label[found.text_of] * len(NAMES) + scripts.script, -1))
            of, n = np.unique((label * len(NAMES) + scripts.of_text)[scripts.of_text >= 0], return_counts=True)
            yield _gram_rows(of, np.full(len(of), VOTE), n)

    def by_profile(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            profiles = shared.value
            for batch, _, found, scripts in splits(batches):
                its = _batch(found, scripts)
                of, label = _judged(profiles, its), labels(batch)[found.text_of]
                sure = (of.lead >= LEAST_LEAD) & (of.letters >= FEW_LETTERS) & (of.language >= 0)
                now = np.where(sure, of.language * len(NAMES) + main[of.language], -1)
                before = np.where((its.script >= 0) & (its.script == main[label]), label * len(NAMES) + its.script, -1)
                yield _counted(its, np.where(now != before, now, -1))
                yield _counted(its, np.where(now != before, before, -1), -1)

        return run

    summed = written(source.mapInArrow(by_label, GRAMS_DDL).groupBy("lang", "script", "gram").agg(F.sum("n").alias("n")), "n-grams")
    main = _main_scripts(summed, languages)
    labelled = _in_main_script(summed, main)
    profiles = _profiles_of(labelled, main, languages)
    for _ in range(rounds - 1):
        shared = documents.sparkSession.sparkContext.broadcast(profiles)
        moved = labelled.union(source.mapInArrow(by_profile(shared), GRAMS_DDL)).groupBy("lang", "script", "gram").agg(F.sum("n").alias("n"))
        again = written(moved.filter(F.col("n") > 0), "n-grams")
        profiles = _profiles_of(again, main, languages)
        profiles.scripts[(profiles.ranks == PROFILE).all(axis=1)] = -1  # no sentence is in it
        discard(again)
    discard(summed)
    return profiles


def judged(documents: DataFrame, profiles: Profiles, learned: frozenset[str] = frozenset(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of each document, and as ``judged`` what is ``JUDGED`` of its sentences."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)  # some ten thousand numbers
    source = documents.select(*keep, F.col("text"), *_found(documents))
    splits = _splits(source, learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found, scripts in splits(batches):
            of, base = _judged(shared.value, _batch(found, scripts)), found.bounds[found.text_of]
            starts, ends = found.starts - base, found.ends - base
            values = {f.name: getattr(of, f.name) for f in fields(Judged)} | {"heading": headings(texts, found.text_of, starts, ends)}
            records = _records(JUDGED, found.text_of, batch.num_rows, start=starts, end=ends, **values)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], records], names=[*keep, "judged"])

    kept = [source.schema[c] for c in keep]
    return spread(source).mapInArrow(run, T.StructType([*kept, T.StructField("judged", T.BinaryType())]))


#: What ``set_limits`` looks at.
LIMITING = {"language": pa.int32(), "nearest": pa.float64(), "farthest": pa.float64(), "lead": pa.float64(), "letters": pa.int32()}


def listed(judged_: DataFrame) -> DataFrame:
    """What ``LIMITING`` names of the sentences of ``judged`` documents, as lists of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = _sentences(batch.column(0), JUDGED)[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), pa.array(np.ascontiguousarray(of[name]), kind)) for name, kind in LIMITING.items()], names=[*LIMITING])

    return judged_.select("judged").mapInArrow(run, ", ".join(f"{name} array<{'int' if kind == pa.int32() else 'double'}>" for name, kind in LIMITING.items()))


#: One part in so many is the most by which the rank of a limit may be off; the limits are those of a thousandth.
LIMIT_ACCURACY = 100_000


def set_limits(profiles: Profiles, judged_: DataFrame) -> None:
    """Sets ``unknown`` from the judged sentences of labelled documents."""
    each = judged_.select(F.explode(F.arrays_zip("language", "nearest", "farthest", "lead", "letters")).alias("s")).select("s.*")
    sure = each.filter((F.col("language") >= 0) & (F.col("lead") >= LEAST_LEAD) & (F.col("letters") >= UNKNOWN_LETTERS))
    ends = sure.groupBy("language").agg(F.percentile_approx("nearest", 0.999, LIMIT_ACCURACY), F.percentile_approx("farthest", 0.5, LIMIT_ACCURACY)).collect()  # a row per language
    for language, own, other in ends:
        profiles.unknown[language] = (own + max(own, other)) / 2


def fit(documents: DataFrame, languages: list[str], learned: frozenset[str] = frozenset(), rounds: int = 2) -> Profiles:
    """Profiles of the languages from rows ``text, lang``, whose labels may be wrong; languages without a text keep an empty profile.

    All rows count. ``documents`` is read once a round, and once for the limits.
    """
    languages = sorted(languages)
    profiles = fitted_profiles(documents, languages, learned, rounds)
    set_limits(profiles, listed(judged(_labelled(documents, languages), profiles, learned)))
    return profiles


def labelled_sample(documents: DataFrame, languages: list[str], sample: int = SAMPLE, most: int = SAMPLE_CHARS) -> DataFrame:
    """``text, lang`` of a bounded sample, for trials; no query uses it: about ``sample`` documents of each label, chosen by a hash of id and text.

    The table is written, of at most about ``sample * most`` characters a language, so that each round of the fit reads just that.
    """
    usable = documents.filter(F.col("lang").isin(sorted(languages)) & F.col("text").isNotNull() & (F.length("text") <= most))
    counts = dict(usable.groupBy("lang").count().collect())  # at most one row per known language
    if not counts:
        return usable.select("text", "lang").limit(0)
    limit = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, share(sample, n))])[F.col("lang")]
    chosen = usable.filter(in_share(limit, "doc_id", "text")).select("text", "lang")
    spark = documents.sparkSession
    return spread(written(chosen.repartition(cores(spark)), "labelled-sample"), "text")


def known_languages(lang_labels: DataFrame) -> list[str]:
    """The languages of ``lang_labels`` (a fixed table), in order."""
    return sorted(r[0] for r in lang_labels.filter("lang is not null").select("lang").distinct().collect())


def fitted(documents: DataFrame, lang_labels: DataFrame, learned: frozenset[str] = frozenset()) -> Profiles:
    """Profiles of all languages of ``lang_labels``, from all labelled documents."""
    return fit(documents, known_languages(lang_labels), learned)


#: Longest heading in characters and in words.
HEADING_CHARS, HEADING_WORDS = 60, 7
_FINAL = frozenset(".!?。！？।؟;”»“’」)…")


def headings(texts: list[str], text_of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which sentences are headings: a paragraph by themselves, short, without a final mark, and with more text after it."""
    out = np.zeros(len(text_of), bool)
    follows = np.r_[text_of[1:] == text_of[:-1], False] if len(text_of) else out
    for k in np.flatnonzero((ends - starts <= HEADING_CHARS) & follows).tolist():
        text, start, end = texts[text_of[k]], int(starts[k]), int(ends[k])
        if text[end - 1] in _FINAL or "\n" in text[start:end] or text.count("\n", end, int(starts[k + 1])) < 2:
            continue
        if k and text_of[k - 1] == text_of[k] and text.count("\n", int(ends[k - 1]), start) < 2:
            continue
        out[k] = len(text[start:end].split()) <= HEADING_WORDS
    return out


def settle(language: np.ndarray, runner_up: np.ndarray, sure: np.ndarray, few: np.ndarray, script: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Languages, once each unsure sentence has been settled by the sure ones of its text."""
    out = language.copy()
    for k in np.flatnonzero(~sure & (language >= 0)).tolist():
        a, b = np.searchsorted(text_of, [text_of[k], text_of[k] + 1])
        others = np.flatnonzero(sure[a:b] & (script[a:b] == script[k])) + a
        if not len(others):
            continue
        if few[k]:
            before = others[others < k]
            out[k] = language[before[-1] if len(before) else others[0]]
        elif runner_up[k] >= 0 and (language[others] == runner_up[k]).any() and not (language[others] == language[k]).any():
            out[k] = runner_up[k]
    return out


def settled_languages(profiles: Profiles, text_of: np.ndarray, texts: int, of: Judged, heading: np.ndarray):
    """(language, lead, counted) of judged sentences; see ``sentence_languages``."""
    counted = ~heading
    alone = np.bincount(text_of, weights=counted & (of.language >= 0), minlength=texts) == 0
    counted |= alone[text_of]
    few = of.letters < FEW_LETTERS
    unknown = profiles.unknown[np.maximum(of.language, 0)] if len(profiles.unknown) else np.inf
    far = (of.letters >= UNKNOWN_LETTERS) & (of.language >= 0) & (of.nearest > unknown)
    sure = counted & ~few & (of.lead >= LEAST_LEAD) & ~far
    language = settle(of.language, of.runner_up, sure | far, few, of.script, text_of)
    return np.where(far, len(profiles.languages), language), np.where(far, 0.0, of.lead), counted


def sentence_languages(profiles: Profiles, texts: list[str], known: Words | None = None):
    """(text, start, end, language, lead, letters, counted) of every sentence.

    Language len(profiles.languages) is none of the known ones. Not counted: headings beside real sentences.
    """
    found = split_batch(texts, known)
    base = found.bounds[found.text_of]
    starts, ends, text_of = found.starts - base, found.ends - base, found.text_of
    of = _judged(profiles, _batch(found, _scripts(found)))
    language, lead, counted = settled_languages(profiles, text_of, len(texts), of, headings(texts, text_of, starts, ends))
    return text_of, starts, ends, language, lead, of.letters, counted


SEGMENTS = pa.schema(
    [("doc_id", pa.int64()), ("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("sentences", pa.int32())]
)
SEGMENTS_DDL = "doc_id bigint, segment int, lang string, confidence double, start_char bigint, end_char bigint, sentences int"


def _segments_of(profiles: Profiles, ids: pa.Array, text_of: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: Judged, heading: np.ndarray) -> pa.RecordBatch:
    language, lead, counted = settled_languages(profiles, text_of, len(ids), of, heading)
    letters = of.letters
    keep = np.flatnonzero((language >= 0) & counted)
    text_of, starts, ends, language, lead, letters = (x[keep] for x in (text_of, starts, ends, language, lead, letters))
    if not len(keep):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in SEGMENTS.types], schema=SEGMENTS)
    edge = np.flatnonzero(np.r_[True, (text_of[1:] != text_of[:-1]) | (language[1:] != language[:-1])])
    last = np.r_[edge[1:], len(keep)] - 1
    of = text_of[edge]
    first_of_text = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    number = np.arange(len(edge)) - np.repeat(first_of_text, np.diff(np.r_[first_of_text, len(edge)])) + 1
    weight = np.maximum(letters, 1)
    confidence = np.add.reduceat(lead * weight, edge) / np.add.reduceat(weight, edge)
    names = np.asarray([*profiles.languages, UNDETERMINED], object)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(of)),
            pa.array(number.astype(np.int32)),
            pa.array(names[language[edge]].tolist(), pa.string()),
            pa.array(confidence),
            pa.array(starts[edge].astype(np.int64)),
            pa.array(ends[last].astype(np.int64)),
            pa.array((last - edge + 1).astype(np.int32)),
        ],
        schema=SEGMENTS,
    )


def settled(judged_: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ()) -> DataFrame:
    """The segments of ``judged`` documents; see ``segments``."""
    shared = judged_.sparkSession.sparkContext.broadcast(profiles)
    source = judged_.select("doc_id", *keep, "judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_of, of = _sentences(batch.column(1 + len(keep)), JUDGED)
            judgement = Judged(*(np.ascontiguousarray(of[f.name]) for f in fields(Judged)))
            found = _segments_of(shared.value, pa.array(np.arange(batch.num_rows)), text_of, of["start"], of["end"], judgement, of["heading"] > 0)
            row = found.column(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *found.columns[1:], *(batch.column(1 + k).take(row) for k in range(len(keep)))], names=[*SEGMENTS.names, *keep])

    types = dict(judged_.dtypes)
    return source.mapInArrow(run, ", ".join([SEGMENTS_DDL, *(f"`{c}` {types[c]}" for c in keep)]))


def segments(documents: DataFrame, profiles: Profiles, learned: frozenset[str] = frozenset(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, segment, lang, confidence, start_char, end_char, sentences`` of ``doc_id, text``, and the columns ``keep``.

    Confidence is the lead of the nearest language over the next one, from 0 to 1, mean over the letters; 0 for ``und``.
    """
    source = documents.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return settled(judged(source, profiles, learned, ("doc_id", *keep)), profiles, keep)


def fitted_segments(documents: DataFrame, lang_labels: DataFrame, learned: frozenset[str] = frozenset(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``segments`` by the profiles that ``fitted`` gives for the same documents.

    Documents are split once, and judged once by the last profiles, for the limits and for the segments:
    two tables hold what was found, of which the one with the texts is deleted here.
    """
    languages = known_languages(lang_labels)
    kept = tuple(dict.fromkeys(("doc_id", "lang", *keep)))
    texts = written(placed(documents.withColumn("doc_id", F.col("doc_id").cast("bigint")).select(*kept, "text"), learned), "sentences")
    profiles = fitted_profiles(texts, languages)
    found = written(judged(texts, profiles, keep=kept), "judged")
    discard(texts)
    set_limits(profiles, listed(found.filter(F.col("lang").isin(languages))))
    return settled(found, profiles, keep)


def main_languages(segments_: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence``: the language of most sentences of each document; of equal ones the first by name."""
    per = segments_.groupBy("doc_id", "lang").agg(
        F.sum("sentences").alias("n"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence")
    )
    best = per.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang", "confidence")).alias("b"))
    return best.select("doc_id", F.col("b.lang").alias("lang"), F.col("b.confidence").alias("confidence"))


def named_languages(metadata: DataFrame, lang_labels: DataFrame) -> DataFrame:
    """``id_kase, lang``: the languages that an article's labels name. An element may hold several, divided by ; or /."""
    known = lang_labels.select(F.lower(F.trim("label")).alias("label"), F.col("lang")).distinct()  # fixed, 70 rows
    each = (
        metadata.filter("id_kase is not null")
        .select("id_kase", F.explode("language").alias("element"))
        .select("id_kase", F.explode(F.split("element", "[;/]")).alias("label"))
        .select("id_kase", F.lower(F.regexp_replace("label", r"(?U)^\s+|\s+$", "")).alias("label"))
    )
    return each.join(F.broadcast(known), "label").select("id_kase", "lang").distinct()
