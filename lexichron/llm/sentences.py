"""Sentence boundaries across languages and scripts (problem 9).

The rules are compiled into a finite transducer, which reads a text as symbols
and says at each whether a sentence begins there.  A symbol stands for a word, a
run of spaces or a mark; what a full stop may be (abbreviation, number, initial,
ellipsis, numeral, end) is told by the symbol of the full stop itself, which
knows the word before it, and decided by the transducer, in which the state
after it waits for what follows.

The lexer that makes the symbols looks at single words and their neighbours
only, for all words of a batch at once, so it needs no state.  Only the pairing
of quotation marks and brackets does: nesting is no regular language, and a mark
that is never closed must not hold the text; a stack runs over these marks alone.

Texts are cut into chunks, at blank lines, where the state is known, and else
after ``CHUNK`` symbols.  All chunks of a batch run in step, one symbol each at a
time.  Where a paragraph has several chunks, these first run as functions from
every state to a state, a parallel prefix scan composes them, and that gives the
state in which each begins; then all chunks run and emit.  Most states soon meet:
such functions go on with the distinct ones only.

Words whose full stop seldom ends a sentence are, beside the fixed ones, those
that the corpus itself shows to be abbreviations (``learned_abbreviations``).

Defined results: null, empty and blank texts have no sentences; places are code
points from 0, the end exclusive, without white space at either side; every
character that isn't white space lies in exactly one sentence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.llm.tokens import slices, spread

#: Most symbols of one chunk.
CHUNK = 256
#: Longest word that the lexer looks up.
WORD = 14

# Words whose full stop never ends a sentence, in lower case, by language.
NEVER = frozenset(
    """
    ms mss cf vol vols dr prof mr mrs messrs st figs eds trans rev chs repr approx gen col lt sgt capt cmdr hon gov sen
    vgl bzw hs hss nr jh jhs abb bd bde hrsg geb sog evtl ggf insb
    mgr mme mlle éd chap fol
    sr sra srta dra núm págs pág caps ej ap aprox
    sigg dott cfr pagg
    dhr mevr bijv blz dl
    pp nos esp av apr vs viz
    καθ περ πρβλ τόμ δηλ χφ κεφ βλ αρ εκδ
    напр рук ср проф см стр гл изд гг вв акад им
    डॉ ई पृ श्री सं
    """.split()
)
# Words whose full stop ends a sentence only before a word that often begins one: they are other words too, or stand last as well.
MAYBE = frozenset(
    """
    no fig ed fr ch art par frau herr bes usf env lib cap vid sig ssa ra es pag segg ca nl resp ex profa
    jan feb mar apr jun jul aug sept sep oct okt nov dec dez inc ltd corp co jr
    """.split()
)
# Words whose full stop ends a sentence only before a capital letter.
SELDOM = frozenset("ff sq sqq ss segs rd chr др λ".split())
# Words that often begin a sentence, with a capital letter.
STARTERS = frozenset(
    """
    he she it we you they this that these those the then there but and so if when while in on at for from with after before as
    his her its our their my your what who how why where which not no yes all some many each every both most however moreover
    thus therefore although because since until today now here
    der die das ein eine er sie es wir ihr ich und aber doch dann da im am auf mit nach vor zu wenn als wie was wer wo warum
    un une il elle ils elles on nous vous je ce cette ces et mais ou dans en aux sur par pour avec sans si quand comme qui
    una ella pero con por para cuando como qué gli uno ma nel per
    os uma ele ela eles elas mas em na com quando het een hij zij ze wij maar voor toen
    sed он она они мы это но на для когда как что кто и в η το οι τα και αλλά
    """.split()
)
# German month names and words for centuries, before which a number with a full stop is an ordinal.
AFTER_ORDINAL = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jh jhs jahrhundert jahrhunderts".split()
)

# Classes of characters.
(OTHER_C, SPACE_C, IGNORED_C, UPPER_C, LOWER_C, CASELESS_C, HINDI_C, CJK_C, THAI_C, DIGIT_C, POINT_C, DOTS_C, MARK_C, STOP_C, CJK_MARK_C, INVERTED_C, PAIR_C) = range(17)
# Groups of classes; neighbours of one group are one symbol, but marks stand alone.
SPACES, WORDS, IDEOGRAPHS, THAIS, POINTS, DOTS, ALONE = range(7)
_GROUP = np.full(17, ALONE, np.uint8)
_GROUP[SPACE_C], _GROUP[CJK_C], _GROUP[THAI_C], _GROUP[POINT_C], _GROUP[DOTS_C] = SPACES, IDEOGRAPHS, THAIS, POINTS, DOTS
_GROUP[[UPPER_C, LOWER_C, CASELESS_C, HINDI_C, DIGIT_C]] = WORDS

# Symbols. A point is told by the word before it; ``_PLAIN + 4 * rule + 2 * chapter + numeral`` are those after plain words.
(OTHER, SPACE, LINE, BLANK, IGNORED, UPPER, STARTER, MONTH, LOWER, CASELESS, CJK, TO, THAI, DIGIT, CHAPTER, ITEM,
 OPEN, CLOSE, OPEN_B, CLOSE_B, MARK, STOP, CJK_MARK, DOTTED, BARE, NUMBER, NEVER_DOT, MAYBE_DOT, SELDOM_DOT, PAD, _PLAIN) = range(31)
SYMBOLS = _PLAIN + 16
#: After a plain word, what may follow its point without a space: a new sentence's capital or caseless letter or a note number; nothing; no capital; no digit.
ANY, NOTHING, NO_CAPITAL, NO_DIGIT = range(4)
_SYMBOL_OF = np.full(17, OTHER, np.uint8)
for _c, _s in ((SPACE_C, SPACE), (IGNORED_C, IGNORED), (UPPER_C, UPPER), (LOWER_C, LOWER), (CASELESS_C, CASELESS), (HINDI_C, CASELESS), (CJK_C, CJK), (THAI_C, THAI), (DIGIT_C, DIGIT), (MARK_C, MARK), (STOP_C, STOP), (CJK_MARK_C, CJK_MARK), (INVERTED_C, UPPER)):
    _SYMBOL_OF[_c] = _s

_CLOSERS = {"“": "”", "„": "“”", "«": "»", "‘": "’", "「": "」", "『": "』", "‹": "›", '"': '"', "(": ")", "[": "]", "（": "）"}
_BEYOND = 0xFFFF


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, and lower-case form, of each character of the basic plane, and whether it is a numeral in lower case."""
    classes, lower = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    of_kind = {"Lu": UPPER_C, "Lt": UPPER_C, "Ll": LOWER_C, "Nd": DIGIT_C, "Cf": IGNORED_C}
    for i in range(0x10000):
        c = chr(i)
        kind = unicodedata.category(c)
        if c.isspace():
            classes[i] = SPACE_C
        elif kind in of_kind:
            classes[i] = of_kind[kind]
            if kind[0] == "L" and len(c.lower()) == 1:
                lower[i] = ord(c.lower())
        elif kind[0] == "M":
            classes[i] = IGNORED_C
        elif kind[0] == "L":
            cjk = 0x2E80 <= i < 0xA000 or 0xAC00 <= i < 0xD7B0 or 0xF900 <= i < 0xFB00
            classes[i] = THAI_C if 0x0E00 <= i < 0x0E80 else CJK_C if cjk else HINDI_C if 0x0900 <= i < 0x0964 else CASELESS_C
    paired = "".join(_CLOSERS) + "".join(_CLOSERS.values())
    for characters, value in (("!?؟‼⁇⁈⁉\u037e", MARK_C), ("。।॥۔。", STOP_C), ("！？", CJK_MARK_C), ("¿¡", INVERTED_C), (".", POINT_C), ("…", DOTS_C), (paired, PAIR_C)):
        for c in characters:
            classes[ord(c)] = value
    numerals = np.zeros(0x10000, bool)
    numerals[[ord(c) for c in "ivxlcdm"]] = True
    return classes, lower, numerals


_POWERS = np.cumprod(np.full(WORD, 0x9E3779B97F4A7C15, np.uint64))


def _word_keys(words: Iterable[str]) -> np.ndarray:
    """Sorted keys of words in lower case, as ``_keys_at`` gives them; longer ones than the lexer looks up have none."""
    lower = _tables()[1]
    keys = [sum(int(lower[min(ord(c), _BEYOND)]) * int(p) for c, p in zip(reversed(w), _POWERS)) % (1 << 64) for w in words if 0 < len(w) <= WORD]
    return np.unique(np.asarray(keys, np.uint64))


@dataclass
class Words:
    """Keys of the words that the lexer knows."""

    never: np.ndarray
    maybe: np.ndarray
    seldom: np.ndarray
    starters: np.ndarray
    ordinals: np.ndarray


@lru_cache(maxsize=4)
def words_known(learned: frozenset[str] = frozenset()) -> Words:
    return Words(*(_word_keys(w) for w in (NEVER, MAYBE | learned - NEVER - SELDOM, SELDOM, STARTERS, AFTER_ORDINAL)))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _ends_of(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last ``WORD`` characters of each word, last first, and which of them lie in it."""
    at = (end - 1)[:, None] - np.arange(WORD)
    return np.maximum(at, 0), at >= begin[:, None]


def _keys_at(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A key of each word in lower case; 0 for words longer than ``WORD``."""
    at, inside = _ends_of(points, begin, end)
    keys = (np.where(inside, _tables()[1][np.minimum(points[at], _BEYOND)], 0).astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64)
    return np.where(end - begin <= WORD, keys, 0)


def _points_after(points, classes, begin, end, lower_case, known: Words) -> np.ndarray:
    """The symbol of a point after each of these words; ``lower_case`` tells those of texts without capitals."""
    at, inside = _ends_of(points, begin, end)
    of = np.where(inside, classes[at], 255)
    is_upper, is_lower, is_digit = of == UPPER_C, of == LOWER_C, of == DIGIT_C
    letters = ((of >= UPPER_C) & (of <= THAI_C)).sum(axis=1)
    digits, first = is_digit.sum(axis=1), classes[begin]
    short = end - begin <= WORD
    marks = (of == IGNORED_C).sum(axis=1)
    has_upper, has_lower = is_upper.any(axis=1), is_lower.any(axis=1)
    low = _tables()[1][np.minimum(points[at], _BEYOND)]
    keys = np.where(short, (np.where(inside, low, 0).astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64), 0)
    numeral = short & (_tables()[2].take(low) | ~inside).all(axis=1) & ((has_upper & ~has_lower) != lower_case)
    chapter = (first == UPPER_C) & (letters <= 4)
    rule = np.where(letters < 3, np.where(has_lower & ~has_upper, NO_DIGIT, NOTHING), np.where(has_upper & ~has_lower, NO_CAPITAL, ANY))
    out = (_PLAIN + 4 * rule + 2 * chapter + numeral).astype(np.uint8)
    # from the weakest to the strongest
    out[is_digit[:, 0] & (digits < letters + digits)] = _PLAIN + 4 * NOTHING
    out[(first == DIGIT_C) & (letters > 0)] = SELDOM_DOT
    out[_among(keys, known.maybe)] = MAYBE_DOT
    out[_among(keys, known.seldom)] = SELDOM_DOT
    out[_among(keys, known.never)] = NEVER_DOT
    out[(letters <= 1) & (first != DIGIT_C) & short] = MAYBE_DOT
    hindi = np.asarray([], bool) if not len(begin) else (points[end - 1] >= 0x900) & (points[end - 1] <= 0x963)
    out[hindi] = NEVER_DOT
    out[short & (letters == 0) & (digits > 0) & (digits + marks >= end - begin)] = NUMBER
    return out


def _pair(symbols: np.ndarray, marks: np.ndarray, characters: list[str], paragraph: np.ndarray) -> None:
    """Sets the symbols of quotation marks and brackets that are paired within their paragraph."""
    waiting: list[tuple[str, int]] = []
    here = -1
    for at, c, of in zip(marks.tolist(), characters, paragraph.tolist()):
        if of != here:
            waiting.clear()
            here = of
        opener = next((k for k in range(len(waiting) - 1, -1, -1) if c in _CLOSERS[waiting[k][0]]), None)
        if opener is not None:
            start, begin = waiting[opener]
            del waiting[opener:]
            bracket = start in "([（"
            symbols[begin] = OPEN_B if bracket else OPEN
            symbols[at] = CLOSE_B if bracket else CLOSE
        elif c in _CLOSERS:
            waiting.append((c, at))


def lex(points: np.ndarray, bounds: np.ndarray, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts set one after another with blank lines between, and where each begins. ``bounds``: where texts begin."""
    n = len(points)
    classes = _tables()[0].take(points, mode="clip")
    beyond = np.flatnonzero(points > _BEYOND) if points.max(initial=0) > _BEYOND else ()
    if len(beyond):
        classes[beyond] = [CJK_C if 0x20000 <= p < 0x32000 else CASELESS_C if chr(p).isalpha() else OTHER_C for p in points[beyond].tolist()]
    questions = np.flatnonzero(points == 0x3B)
    if len(questions):  # in Greek, a semicolon asks
        before = points[np.maximum(questions - 1, 0)]
        classes[questions[((before >= 0x370) & (before < 0x400)) | ((before >= 0x1F00) & (before < 0x2000))]] = MARK_C
    group = _GROUP.take(classes)
    ignored = np.flatnonzero(classes == IGNORED_C)
    if len(ignored):  # a mark on a letter goes with it
        breaks = np.flatnonzero(np.diff(ignored, prepend=-2) != 1)
        before = group[np.maximum(ignored[breaks] - 1, 0)]
        joined = np.where((before >= WORDS) & (before <= THAIS) & (ignored[breaks] > 0), before, ALONE)
        group[ignored] = np.repeat(joined, np.diff(np.r_[breaks, len(ignored)]))
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (group[1:] == ALONE)])
    end = np.r_[start[1:], n]
    of_group, of_class = group[start], classes[start]
    symbols = _SYMBOL_OF.take(of_class)
    breaks = np.flatnonzero((points == 10) | (points == 0x2029))
    lines = np.bincount(np.searchsorted(start, breaks, side="right") - 1, weights=1 + (points[breaks] == 0x2029), minlength=len(start))
    symbols[lines == 1] = LINE
    symbols[lines >= 2] = BLANK
    symbols[(of_class == CJK_C) & (points[start] == 0x3068)] = TO

    # texts without a capital letter at the beginning of a word: there case tells nothing
    before, before2 = np.r_[SPACES, of_group[:-1]], np.r_[SPACES, SPACES, of_group[:-2]][: len(start)]
    capital = (of_class == UPPER_C) & ~((before >= POINTS) & (before2 >= WORDS) & (before2 <= THAIS))
    first = np.minimum(np.searchsorted(start, bounds), len(start) - 1)
    without = np.add.reduceat(capital, first, dtype=np.int64) == 0
    without_capitals = np.repeat(without, np.diff(np.r_[first, len(start)])) if without.any() else None
    if without_capitals is not None:
        symbols[without_capitals & (symbols == LOWER)] = CASELESS

    # points and ellipses
    symbols[of_group == DOTS] = np.where((end - start)[of_group == DOTS] > 1, OTHER, DOTTED)
    point = np.flatnonzero(of_group == POINTS)
    symbols[point] = np.where((end - start)[point] > 1, DOTTED, BARE)
    point = point[(end - start)[point] == 1]
    point = point[(point > 0) & (before[point] >= WORDS) & (before[point] <= THAIS)]
    lower_case = without_capitals[point] if without_capitals is not None else np.zeros(len(point), bool)
    symbols[point] = _points_after(points, classes, start[point - 1], end[point - 1], lower_case, known)
    if len(point):
        # "т. д." ends a sentence, though its words are initials
        d = point[(points[start[point - 1]] == 0x434) & (end[point - 1] - start[point - 1] == 1) & (point >= 4)]
        d = d[(points[start[d - 4]] == 0x442) & (symbols[d - 2] == SPACE) & (symbols[d - 3] == MAYBE_DOT)]
        symbols[d] = _PLAIN + 4 * NO_DIGIT
        # what stands after the point: words that begin a sentence, months, numbers of chapters
        after = point[point + 2 < len(start)]
        after = after[of_group[after + 1] == SPACES]
        told, word = symbols[after], after + 2
        maybe = word[(told == MAYBE_DOT) & (of_class[word] == UPPER_C) & (end[word] - start[word] > 1)]
        maybe = maybe[~np.isin(points[np.minimum(end[maybe], n - 1)], [0x2D, 0xAD, 0x2010, 0x2011])]  # half of a hyphened word is none
        symbols[maybe[_among(_keys_at(points, start[maybe], end[maybe]), known.starters)]] = STARTER
        ordinal = word[(told == NUMBER) & (of_group[word] == WORDS)]
        symbols[ordinal[_among(_keys_at(points, start[ordinal], end[ordinal]), known.ordinals)]] = MONTH
        number = word[(told >= _PLAIN) & ((told - _PLAIN) & 2 > 0) & (of_class[word] == DIGIT_C) & (word + 2 < len(start))]
        number = number[np.isin(points[start[number + 1]], [0x2E, 0x3A, 0x2C]) & (end[number + 1] - start[number + 1] == 1) & (of_class[number + 2] == DIGIT_C)]
        symbols[number] = CHAPTER
        item = point[(symbols[point] == NUMBER) & (point > 1)]
        item = item[(symbols[item - 2] == LINE) & (end[item - 1] - start[item - 1] <= 3)]
        symbols[item - 1] = ITEM

    mark = np.flatnonzero(of_class == PAIR_C)
    if len(mark):
        letter = (of_group >= WORDS) & (of_group <= THAIS)
        # an apostrophe between letters is none of them
        inner = (points[start[mark]] == 0x2019) & letter[mark - 1] & letter[np.minimum(mark + 1, len(start) - 1)] & (mark > 0)
        mark = mark[~inner]
        _pair(symbols, mark, [chr(p) for p in points[start[mark]].tolist()], np.cumsum(symbols == BLANK)[mark])
    return symbols, start


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, int, int]:
    """(transitions, states, first state). Entry [state, symbol] is twice the next state, plus 1 if a sentence begins there.

    A state is between sentences; or within one, knowing the quotation (1: it
    began with the sentence, 2: inside it) or bracket it stands in, and what the
    last symbol was where that matters; or after a final mark of some kind, with
    or without space or a line break since, and whether a quotation was closed
    after the mark.  ``items``: the paragraph began as a numbered list.
    """
    kinds = {MARK: "mark", STOP: "stop", CJK_MARK: "cjk mark", DOTTED: "seldom", BARE: "bare", NUMBER: "number", MAYBE_DOT: "maybe", SELDOM_DOT: "seldom"}
    finals = {*kinds, NEVER_DOT, *range(_PLAIN, SYMBOLS)}

    def within(quote: int = 0, bracket: int = 0, last: str = "", items: int = 0) -> tuple:
        return ("in", quote, bracket, last, items)

    def begin(s: int, items: int, paragraph: bool) -> tuple:
        if s in (OPEN, OPEN_B):
            return within(int(s == OPEN), int(s == OPEN_B), "", items)
        return within(0, 0, "thai" if s == THAI else "first" if paragraph else "", items)

    def ended(s: int, quote: int, last: str, items: int) -> tuple:
        """The state after a final mark within a sentence."""
        if s == NEVER_DOT or s == NUMBER and last == "first":
            return within(quote, 0, "", items or int(s == NUMBER))
        if s >= _PLAIN:
            if (s - _PLAIN) & 1 and last == "first":
                return within(quote, 0, "", items)
            return ("after", s, quote, 0, 0, items)
        return ("after", kinds[s], quote, 0, 0, items)

    def inside(state: tuple, s: int) -> tuple[tuple, bool]:
        _, quote, bracket, last, items = state
        if s in finals:
            return (within(quote, bracket, "", items) if bracket else ended(s, quote, last, items)), False
        if s in (SPACE, LINE):
            now = "thai space" if last in ("thai", "thai space") else "line" if s == LINE and items and not quote and not bracket else ""
            return within(quote, bracket, now, items), False
        if s == OPEN:
            return within(quote or 2, bracket, "", items), False
        if s == CLOSE:
            return within(0, bracket, "", items), False
        if s in (OPEN_B, CLOSE_B):
            return within(quote, int(s == OPEN_B), "", items), False
        if s == THAI:
            return (begin(s, items, False), True) if last == "thai space" else (within(quote, bracket, "thai", items), False)
        if s == ITEM and last == "line":
            return begin(s, items, True), True
        return within(quote, bracket, "", items), False

    def after(state: tuple, s: int) -> tuple[tuple, bool]:
        _, kind, quote, closed, spaced, items = state
        stay = within(quote, 0, "thai" if s == THAI else "", items), False
        if s in (SPACE, LINE):
            return ("after", kind, quote, closed, 2 if s == LINE else max(spaced, 1), items), False
        if kind == "maybe":
            if s == STARTER and spaced and quote != 2:
                return begin(s, items, False), True
            return inside(within(quote, 0, "", items), s)
        if s == CLOSE:
            return ("after", kind, 0, quote or closed, 0, items), False
        if s == CLOSE_B:
            return ("after", kind, quote, closed, 0, items), False
        if s in finals:
            if spaced:
                return within(quote, 0, "", items), False
            return ("after", "seldom" if kind == "seldom" else kinds.get(s, "bare"), quote, closed, 0, items), False
        if quote == 2:  # a quotation inside the sentence is still open
            return within(quote, int(s == OPEN_B), "", items), False
        if s == OTHER:
            return stay
        plain = isinstance(kind, int)
        rule = (kind - _PLAIN) // 4 if plain else NOTHING if kind in ("bare", "number", "seldom") else ANY
        go = (within(1, 0, "", items) if quote == 1 and s != OPEN_B else begin(s, items, s == ITEM and spaced == 2 and bool(items))), True
        if s in (OPEN, OPEN_B):
            return ((within(quote or 2, 0, "", items) if s == OPEN else within(quote, 1, "", items)), False) if kind == "seldom" else go
        if s in (DIGIT, CHAPTER, ITEM):
            if not spaced:  # the number of a note belongs to the sentence before it
                return go if kind in ("stop", "cjk mark") else (state, False) if rule in (ANY, NO_CAPITAL) else stay
            apart = kind in ("seldom", "number") or s == CHAPTER and plain and (kind - _PLAIN) & 2
            return go if s == ITEM and items and spaced == 2 or not apart else stay
        if s == MONTH and kind == "number" and spaced:
            return stay
        if not spaced and (rule == NOTHING or rule == NO_CAPITAL and s in (UPPER, STARTER, MONTH)):
            return stay
        if s in (UPPER, STARTER, MONTH):
            return go
        if s == LOWER:
            return go if kind in ("stop", "cjk mark") and not closed else stay
        if s == TO and closed or kind == "seldom":
            return stay
        # Letters of scripts without case: what follows a quoted question or call goes on with the sentence.
        if closed == 2 or closed == 1 and kind in ("mark", "cjk mark") or not spaced and kind == "mark" and s == CASELESS:
            return stay
        return go

    def step(state: tuple, s: int) -> tuple[tuple, bool]:
        if s == PAD:
            return state, False
        if s == BLANK:
            return ("between",), False
        if state[0] == "between":
            return (state, False) if s in (SPACE, LINE) else (begin(s, 0, True), True)
        if s == IGNORED:
            return state, False
        return (inside if state[0] == "in" else after)(state, s)

    numbers: dict[tuple, int] = {("between",): 0}
    order = [("between",)]
    table: list[list[int]] = []
    while len(table) < len(order):
        row = []
        for s in range(SYMBOLS):
            to, begins = step(order[len(table)], s)
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(2 * numbers[to] + begins)
        table.append(row)
    return np.asarray(table, np.uint16), len(table), 0


def _compose_by_scan(functions: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the rows of ``functions`` within each group, by doubling steps."""
    done, distance = functions.copy(), 1
    rows = np.arange(len(done))
    while distance < len(done):
        later = rows[distance:][group[distance:] == group[:-distance]]
        if not len(later):
            break
        earlier = done[later - distance]
        done[later] = np.take_along_axis(done[later], earlier, axis=1)
        distance *= 2
    return done


def _chunk_functions(flat: np.ndarray, n_states: int, padded: np.ndarray, at: np.ndarray, chunk: int) -> np.ndarray:
    """For each chunk the state it leads to from each state. Once states have met, only the distinct ones run on."""
    running, narrow = (flat.reshape(n_states, SYMBOLS).T >> 1).astype(np.intp)[padded[at]], None
    for k in range(1, chunk):
        running = (flat[running * SYMBOLS + padded[at + k][:, None]] >> 1).astype(np.intp)
        if k in (1, 3, 7, 15, 31, 63):
            ordered = np.sort(running, axis=1)
            new = np.c_[np.ones(len(at), bool), ordered[:, 1:] != ordered[:, :-1]]
            width = int(new.sum(axis=1).max(initial=1))
            if width * 2 <= running.shape[1]:
                distinct = np.zeros((len(at), width), np.intp)
                place = np.cumsum(new, axis=1) - 1
                np.put_along_axis(distinct, place, ordered, axis=1)
                where = np.zeros((len(at), n_states), np.intp)
                np.put_along_axis(where, distinct[:, ::-1], np.broadcast_to(np.arange(width)[::-1], distinct.shape), axis=1)
                to = np.take_along_axis(where, running, axis=1)
                narrow = to if narrow is None else np.take_along_axis(to, narrow, axis=1)
                running = distinct
    return running if narrow is None else np.take_along_axis(running, narrow, axis=1)


def sentence_starts(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places at which sentences begin in a run of symbols; BLANK parts texts as it parts paragraphs."""
    table, n_states, first = transducer()
    flat = table.ravel()
    begins = np.r_[0, np.flatnonzero(symbols == BLANK) + 1]
    sizes = np.diff(np.r_[begins, len(symbols)])
    begins, sizes = begins[sizes > 0], sizes[sizes > 0]
    if not len(begins):
        return np.empty(0, np.int64)
    pieces = -(-sizes // chunk)
    paragraph = np.repeat(np.arange(len(begins)), pieces)
    inner = (np.arange(len(paragraph)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * chunk
    offset = begins[paragraph] + inner
    length = np.minimum(sizes[paragraph] - inner, chunk)
    order = np.argsort(-length, kind="stable")  # longest first: those still running are always the first ones
    width = int(length.max())
    sorted_length, sorted_offset = length[order], offset[order]
    running = np.searchsorted(-sorted_length, -np.arange(width), side="left").tolist()
    padded = np.r_[symbols, np.full(width, PAD, np.uint8)].astype(np.intp)
    states = np.full(len(order), first, np.intp)
    follows = np.flatnonzero(paragraph[1:] == paragraph[:-1])  # chunks with a later one in the same paragraph; all are full
    if len(follows):
        row = np.empty(len(order), np.intp)
        row[order] = np.arange(len(order))
        functions = np.concatenate([_chunk_functions(flat, n_states, padded, offset[follows[at : at + 4096]], chunk) for at in range(0, len(follows), 4096)])
        states[row[follows + 1]] = _compose_by_scan(functions, paragraph[follows])[:, first]
    found = []
    for k in range(width):
        n = running[k]
        at = sorted_offset[:n] + k
        to = flat[states[:n] * SYMBOLS + padded[at]]
        begun = (to & 1).astype(bool)
        if begun.any():
            found.append(at[begun])
        states[:n] = to >> 1
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass
class Split:
    """Sentences of a batch: code points of all texts (blank lines between), where texts begin, and each sentence's place and text."""

    points: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_of: np.ndarray


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts with blank lines between, and where each text begins."""
    texts = [t or "" for t in texts]
    points = np.frombuffer("\n\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *(len(t) + 2 for t in texts)], dtype=np.int64)[:-1]


def split_batch(texts: list[str | None], known: Words | None = None) -> Split:
    """Sentences of all texts, at places in ``points``."""
    points, bounds = joined(texts)
    none = np.empty(0, np.int64)
    if not len(points):
        return Split(points, bounds, none, none, none)
    symbols, start = lex(points, bounds, known or words_known())
    starts = sentence_starts(symbols)
    if not len(starts):
        return Split(points, bounds, none, none, none)
    # A sentence ends with the last symbol before the next one that isn't space.
    solid = np.flatnonzero((symbols != SPACE) & (symbols != LINE) & (symbols != BLANK))
    last = solid[np.searchsorted(solid, np.r_[starts[1:], len(symbols)]) - 1]
    starts, ends = start[starts], np.r_[start, len(points)][last + 1]
    return Split(points, bounds, starts, ends, np.searchsorted(bounds, starts, side="right") - 1)


def split_texts(texts: list[str | None], known: Words | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the sentences of each text."""
    found = split_batch(texts, known)
    edges = np.searchsorted(found.text_of, np.arange(len(texts) + 1))
    return [(found.starts[a:b] - found.bounds[k], found.ends[a:b] - found.bounds[k]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


#: Shortest and longest word that may be learned as an abbreviation.
LEARN_LETTERS = (2, 5)
#: Least occurrences with a point, share of all occurrences that have one, and share of those that go on in lower case or with a number.
LEARN_COUNT, LEARN_DOTTED, LEARN_ONWARD = 20, 0.9, 0.9


def learned_abbreviations(documents: DataFrame) -> frozenset[str]:
    """Words that the texts show to be abbreviations: nearly always with a point after them, and nearly always with more of the sentence.

    All occurrences in all documents count, in the JVM: first each spelling with what
    follows its point, then each word.  Only the abbreviations come back.
    """
    few, most = LEARN_LETTERS
    found = F.regexp_extract_all("text", F.lit(rf"(?<!\p{{L}})(?<![\p{{N}}\p{{M}}.])\p{{L}}{{{few},{most}}}+(?!\p{{L}})(?![\p{{N}}\p{{M}}])(?:\.(?= ?[\p{{L}}\p{{N}}])(?: ?[\p{{L}}\p{{N}}])?)?"), F.lit(0))
    spelled = documents.filter(F.col("text").isNotNull()).select(F.explode(found).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    word, dotted = F.lower(F.split_part("m", F.lit("."), F.lit(1))), F.col("m").contains(".")
    onward = dotted & F.col("m").rlike(r"[\p{Ll}\p{N}]$")
    counts = spelled.groupBy(word.alias("w")).agg(F.sum("n").alias("n"), F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("d"), F.sum(F.when(onward, F.col("n")).otherwise(0)).alias("o"))
    kept = counts.filter((F.col("d") >= LEARN_COUNT) & (F.col("d") >= F.col("n") * LEARN_DOTTED) & (F.col("o") >= F.col("d") * LEARN_ONWARD))
    return frozenset(r[0] for r in kept.select("w").collect())


SENTENCES = pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def sentences(documents: DataFrame, learned: frozenset[str] = frozenset()) -> DataFrame:
    """``doc_id, sentence, start_char, end_char`` of ``doc_id, text``: one row per sentence, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_known(learned)
        for whole in batches:
            for batch in slices(whole, 1):
                found = split_batch(batch.column(1).to_pylist(), known)
                base = found.bounds[found.text_of]
                number = np.arange(len(base)) - np.searchsorted(found.text_of, found.text_of) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(found.text_of)), pa.array(number.astype(np.int32)), pa.array(found.starts - base), pa.array(found.ends - base)],
                    schema=SENTENCES,
                )

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(source, "doc_id").mapInArrow(run, "doc_id bigint, sentence int, start_char bigint, end_char bigint")
