"""Variant spellings of the names of people and organisations (problem 3).

A name is read into parts: titles dropped, letters folded, abbreviations spelled
out, the surname found.  Names whose parts are alike fall into one class at
once.  Classes are blocked by phonetic codes of their sorted tokens, where the
given name of a person counts by its initial, so that "B. Smith" meets "Bill
Smith"; a code with any one symbol left out is a block too, so one wrong letter
leaves a common block.  Persons of three or more words, and those whose order is
not certain, are also blocked by all their words whatever the order.

Classes of a common block are compared by Jaro-Winkler and a table of nicknames,
and accepted pairs are clustered by connected components.  How similar two words
must be depends on what an exact check finds: ``ONE_EDIT`` where they are one
edit apart, ``TWO_EDITS`` where they are long and two edits apart, or where they
differ by one letter more or less once both are in one spelling of their sounds.

A name with initials only joins the one person of that surname it fits; where it
fits several, it joins none.

A block of more than ``HOT_BLOCK`` classes is split: full names then meet only
where the phonetic codes of their given names do too (which ``compare`` asks of
any two full names, so no link is lost), and names with initials meet the block.

Defined results: null and blank names, and words that name nobody, stand alone;
the same string from any number of rows is one name; a name of one word is
linked only to the same word.  Blocks are joined, never collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexichron.llm.components import connected_components
from lexichron.session import shuffle_width, written

#: Least Jaro-Winkler similarities of two spellings, by what is between them, and the letters from which two edits may be.
ONE_EDIT, TWO_EDITS = 0.8, 0.94
LONG = 8
#: Words whose forms a worker keeps, as names repeat.
WORDS_KEPT = 50_000
#: Classes of one block from which it is split.
HOT_BLOCK = 200
#: A word is known as a given name if it stands after the comma of so many surnames, and in such a share of the names with a comma that hold it.
GIVEN_SURNAMES, GIVEN_SHARE = 3, 0.75

# Words that name nobody.
NOBODY = frozenset("anon anonymous unknown various sn nn na none null ed eds editor editors staff author authors unbekannt anonyme anonimo verschiedene".split())
# Titles and the like, which are no part of a name.
TITLES = frozenset("dr prof professor rev reverend fr father sr sister br mr mrs ms miss sir lady hon mgr msgr phd dphil md mag dipl ing ed eds hrsg the".split())
# Abbreviations in names of organisations.
ABBREVIATIONS = {
    "inst": "institute", "univ": "university", "soc": "society", "arch": "archive", "dioc": "diocesan", "theol": "theological",
    "sem": "seminary", "stud": "studies", "lib": "library", "coll": "college", "acad": "academy", "dept": "department",
    "ctr": "centre", "center": "centre", "fac": "faculty", "mus": "museum", "assoc": "association", "found": "foundation",
    "nat": "national", "natl": "national", "int": "international", "intl": "international", "res": "research", "sch": "school",
    "hist": "historical", "archives": "archive", "universitat": "university", "universite": "university",
}
# Words that make a name an organisation's.
ORGANISATIONS = frozenset(
    "institute university society archive seminary library college academy department centre faculty museum association foundation school council press committee".split()
)
# Words that belong to the surname after them.
PARTICLES = frozenset("van von der den ter ten zu zur de del della di da dos das du la le el al bin ibn y".split())
JOINING = frozenset("of for and the in at de der des du la le und et et".split())
# Nicknames and the names they may stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew andreas", "annie": "anna anne",
    "becky": "rebecca", "bella": "isabella", "belle": "isabella", "ben": "benjamin", "benni": "benjamin", "benny": "benjamin", "bert": "hubert albert robert",
    "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "carl": "karl", "cathy": "katherine", "charlie": "charles charlotte", "charly": "charlotte", "chris": "christopher christine", "dan": "daniel", "danny": "daniel",
    "dave": "david", "deb": "deborah", "dick": "richard", "dolly": "dorothea dorothy", "dora": "dorothea", "dot": "dorothea dorothy", "dottie": "dorothea dorothy", "drew": "andrew",
    "ed": "edward", "eddie": "edward", "edie": "edith", "eliza": "elizabeth", "ellie": "eleanor", "fran": "francoise frances", "frank": "francis", "fred": "frederick", "freddie": "frederick",
    "freddy": "frederick", "fritz": "friedrich frederick", "gabe": "gabriel", "gene": "eugene", "greg": "gregory", "gretel": "margaret", "gus": "augustus", "hank": "henry", "hannes": "johannes", "hans": "johannes",
    "harry": "henry harold", "ike": "isaac", "izzy": "isabella", "jack": "john", "jake": "jacob", "jan": "johannes", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james",
    "jo": "josephine joanna", "joe": "joseph", "joey": "joseph", "johnny": "john", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "kit": "katherine christopher",
    "kitty": "katherine", "klaus": "nikolaus", "len": "leonard", "lenny": "leonard", "leo": "leonard", "lena": "annalena magdalena", "lexi": "alexandra", "lexie": "alexandra", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lotte": "charlotte", "lottie": "charlotte",
    "lou": "louis louise", "mag": "margaret", "maggie": "margaret", "marge": "margaret", "matt": "matthew matthias", "matthew": "matthias matthew", "matze": "matthias", "meg": "margaret", "meggie": "margaret", "mick": "michael", "mike": "michael", "mina": "wilma wilhelmina",
    "molly": "mary", "nancy": "anne", "nat": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas nikolaus", "niko": "nikolaus", "nicky": "nicholas nikolaus", "olli": "oliver", "ossi": "oskar", "ozzy": "oskar", "pat": "patrick patricia", "peg": "margaret", "peggy": "margaret", "penny": "penelope",
    "pete": "peter", "phil": "philip", "pip": "philippa philip", "pippa": "philippa", "polly": "mary", "quinn": "quentin", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "robbie": "robert", "robby": "robert", "ron": "ronald",
    "sam": "samuel samantha", "sammy": "samuel", "sandra": "alexandra", "sandy": "alexandra", "sascha": "alexandra alexander", "sepp": "joseph", "steve": "stephen", "sue": "susan", "ted": "theodore edward", "teddy": "theodore edward", "thea": "dorothea theodora", "theo": "theodore", "tilda": "matilda",
    "tim": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "toni": "antonia antonio", "tony": "anthony", "tori": "victoria", "uli": "ulrike ulrich", "ulli": "ulrike ulrich", "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria", "walt": "walter", "will": "william",
    "willy": "william", "willi": "wilhelm william", "wolf": "wolfgang", "xandra": "alexandra", "zac": "zachary", "zach": "zachary", "zack": "zachary",
}

_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "0": "o", "1": "l", "5": "s", "’": "'"})
_DOUBLE = re.compile(r"(.)\1+")
_CODES = str.maketrans(
    {**dict.fromkeys("aeiouyhj", ""), **dict.fromkeys("bp", "P"), **dict.fromkeys("fvw", "F"), **dict.fromkeys("dt", "T"), **dict.fromkeys("cgkqxsz", "K"), **dict.fromkeys("mn", "N"), "l": "L", "r": "R"}
)


@lru_cache(maxsize=WORDS_KEPT)
def folded(word: str) -> str:
    """A word in the form in which spellings are compared: no accents, no doubled letters, common misreadings undone."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", word.lower().translate(_SPECIAL)) if c.isalnum())
    plain = plain.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return _DOUBLE.sub(r"\1", plain).replace("rn", "m")


@lru_cache(maxsize=WORDS_KEPT)
def spelled(word: str) -> str:
    """A word without accents and punctuation, in lower case, its letters otherwise as typed."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().translate(_SPECIAL)) if c.isalnum())


#: Letters that stand for one sound, in the order in which they are replaced.
_RESPELLED = [(re.compile(x), y) for x, y in (("ph", "f"), ("sch|sh", "s"), ("(?<=.)h", ""), ("ck|c|q", "k"), ("(?<=[^aeiou])yo", "e"), ("[yj]", "i"), ("[vw]", "f"), ("z", "s"), ("x", "ks"), ("dt", "t"), (r"i+(?=[aeou])(?<=.)(?<!^i)", ""))]


@lru_cache(maxsize=WORDS_KEPT)
def respelled(word: str) -> str:
    """A folded word in one spelling of its sounds: ph as f, c and q as k, y and j as i, v and w as f, z as s, no h but a first one."""
    for pattern, by in _RESPELLED:
        word = pattern.sub(by, word)
    return _DOUBLE.sub(r"\1", word)


def phonetic(word: str) -> str:
    """Classes of the consonants of a folded word; its first letter if it has none."""
    return word.translate(_CODES) or word[:1].upper()


def without_one(code: str, least: int = 2) -> set[str]:
    """The code, and the code with any one symbol left out, if ``least`` are left."""
    return {code} | ({code[:i] + code[i + 1 :] for i in range(len(code))} if len(code) > least else set())


def codes_of(words: Iterable[str], least: int = 2) -> set[str]:
    """Phonetic codes under which spellings of any of the words meet: as they are, and in one spelling of their sounds."""
    return {v for w in words for x in {phonetic(w), phonetic(respelled(w))} for v in without_one(x, least)}


def sound_equal(x: str, y: str) -> bool:
    return phonetic(x) == phonetic(y) or phonetic(respelled(x)) == phonetic(respelled(y))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, with up to four common first letters counting a tenth each."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    window = max(0, max(n, m) // 2 - 1)
    taken, hits = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(m, i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (b[j] for j in range(m) if taken[j]))) / 2
    jaro = (len(hits) / n + len(hits) / m + (len(hits) - swaps) / len(hits)) / 3
    common = 0
    while common < min(4, n, m) and a[common] == b[common]:
        common += 1
    return jaro + common * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
    return min(row[-1], most + 1)


def alike(x: str, y: str, most: int = 2) -> bool:
    """Whether two words are spellings of one, as they stand. Two letters that are both others are no slip."""
    if min(len(x), len(y)) < 4 or abs(len(x) - len(y)) > most:
        return False
    similar = jaro_winkler(x, y)
    if similar < ONE_EDIT:
        return False
    if edits(x, y, 1) <= 1:
        return True
    exchanged = len(x) == len(y) and sum(i != j for i, j in zip(x, y)) == 2
    return most > 1 and similar >= TWO_EDITS and min(len(x), len(y)) >= LONG and not exchanged and edits(x, y, 2) <= 2


def near(a: str, b: str, a_typed: Iterable[str], b_typed: Iterable[str], by_sound: bool = True) -> bool:
    """Whether two words are spellings of one: folded, as typed in any way, or, ``by_sound``, in one spelling of their sounds."""
    if a == b or min(len(a), len(b)) < 3:
        return a == b
    if alike(a, b, 1) or any(alike(i, j) for i in a_typed for j in b_typed):
        return True
    x, y = respelled(a), respelled(b)
    # another vowel may be another name, but a letter more or less seldom is
    return by_sound and (x == y or min(len(x), len(y)) > 4 and len(x) != len(y) and jaro_winkler(x, y) >= TWO_EDITS and edits(x, y, 1) <= 1)


def formal_names(given: str) -> list[str]:
    """Folded formal names that a folded given name may stand for, itself included."""
    return [given, *_FORMAL.get(given, ())]


_FORMAL = {folded(k): tuple(folded(x) for x in v.split()) for k, v in NICKNAMES.items()}
_GIVEN = frozenset(_FORMAL) | {name for names in _FORMAL.values() for name in names}


def _words_of(name: str | None) -> tuple[str, list[str]]:
    """The name without notes on roles, and its words."""
    text = unicodedata.normalize("NFKC", name or "").strip()
    text = re.sub(r"\((?:eds?|hrsg|trans|transl|comp)\.?\)", " ", text, flags=re.I)
    return text, re.findall(r"[^\s,;()\[\]/&]+", text)


def _is_initial(word: str) -> bool:
    return bool(re.fullmatch(r"(?:[^\W\d_]\.?[-‐]?){1,3}", word)) and (len(re.sub(r"\W", "", word)) == 1 or "." in word or word.isupper() and len(word) < 3)


def ends_of(name: str | None) -> tuple[bool, str, str]:
    """Whether there is a comma; then the surname and the first given name, else the first and the last word, folded."""
    text, words = _words_of(name)
    if "," in text:
        first, rest = text.split(",", 1)
        given = next((folded(w) for w in re.findall(r"[^\s,;()\[\]/.]+", rest) if len(w) > 1 and folded(w) not in TITLES), "")
        return True, "".join(folded(w) for w in first.split() if folded(w) not in TITLES), given
    words = [w for w in words if folded(w) not in TITLES]
    return (False, folded(words[0]), folded(words[-1])) if words else (False, "", "")


def read_name(name: str | None, first_known: bool = False, last_known: bool = False) -> dict:
    """The parts of a name: kind (person, organisation or none), class, surname, given, initials, words, and block keys.

    ``first_known``, ``last_known``: whether the first and the last word are known as given names; they tell
    "Surname Given" from "Given Surname".  ``words`` are all words in order of the alphabet, a comma first if
    there was one, of names of three words or more and of those whose order is not certain.
    """
    nobody = {"kind": "none", "cls": None, "surname": "", "given": "", "double": "", "initials": "", "words": "", "typed": "", "typed_given": "", "keys": []}
    text, words = _words_of(name)
    plain = [re.sub(r"[^\w'’\-]", "", w) for w in words]
    lowered = [folded(w) for w in plain]
    meaning = [w for w in lowered if w]
    if not meaning or all(w in NOBODY or len(w) == 1 for w in meaning) or "".join(meaning) in NOBODY:
        return nobody
    expanded = [ABBREVIATIONS.get(w, w) for w in (re.sub(r"\W", "", unicodedata.normalize("NFKD", p.lower())) for p in plain) if w]
    if any(w in ORGANISATIONS for w in expanded):
        kept = [w for w in expanded if w not in JOINING]
        tokens = sorted(folded(w) for w in kept)
        # tokens that are no known word of such names may be typed wrongly
        return nobody | {
            "kind": "organisation", "cls": "o|" + " ".join(tokens), "surname": " ".join(tokens),
            "typed": " ".join(spelled(w) for w in sorted(kept, key=folded)), "keys": sorted(_keys_of("o", tokens)),
        }
    comma, certain = "," in text, True
    if comma:
        first, rest = (x.strip() for x in text.split(",", 1))
        surname_words, given_words = first.split(), re.findall(r"[^\s,;()\[\]/]+", rest)
    else:
        given_words = [w for w in words if folded(w) not in TITLES or len(words) == 1]
        shouted = [w for w in given_words if len(w) > 3 and w.isupper() and "." not in w]
        at = len(given_words) - 1
        if len(given_words) > 1:
            known_first, known_last = first_known or folded(given_words[0]) in _GIVEN, last_known or folded(given_words[-1]) in _GIVEN
            if len(shouted) == 1:
                at = given_words.index(shouted[0])
            elif _is_initial(given_words[-1]) or known_last and not known_first and not _is_initial(given_words[0]):
                at = 0
            certain = len(shouted) == 1 or known_first != known_last or _is_initial(given_words[0]) or _is_initial(given_words[-1])
        begin = at
        while begin > 1 and given_words[begin - 1].lower() in PARTICLES:
            begin -= 1
        surname_words, given_words = given_words[begin : at + 1], given_words[:begin] + given_words[at + 1 :]
    surname_words = [w for w in surname_words if folded(w) not in TITLES or len(surname_words) == 1]
    surname, typed = "".join(map(folded, surname_words)), "".join(map(spelled, surname_words))
    full, double, initials, typed_given, tokens = "", "", "", "", [folded(w) for w in surname_words]
    for word in given_words:
        if folded(word) in TITLES:
            continue
        parts = [p for p in re.split(r"[.\-‐\s]+", word) if p]
        if all(len(p) == 1 for p in parts):
            initials += "".join(folded(p) for p in parts)
        elif len(word) == 2 and word.isupper():
            initials += folded(word[0]) + folded(word[1])
        else:
            whole = folded("".join(parts))
            tokens.append(whole)
            if not full:
                full, typed_given = whole, spelled("".join(parts))
                initials = "".join(folded(p)[:1] for p in parts) + initials
            else:
                double = double or full + whole
                initials += whole[:1]
    if not surname:
        return nobody
    in_order = len(tokens) < 3 and (comma or certain)
    tokens = [] if in_order else sorted(t for t in tokens if t)
    firsts = sorted({f[:1] for f in formal_names(full)}) if full else [initials[:1]] if initials else []
    # a short surname is linked to the same one only, so its letters are the block
    codes = {"=" + respelled(surname)} if len(surname) < 5 else codes_of([surname, typed])
    keys = {f"p|{c}|{i}" for c in codes for i in firsts} | (_keys_of("t", tokens) if len(tokens) > 1 else set())
    formal = _FORMAL.get(full)
    given = formal[0] if formal and len(formal) == 1 else full
    said = ("," if comma else "") + " ".join(tokens) if tokens else ""
    return {
        "kind": "person", "cls": f"p|{surname}|{given}|{initials if not full else initials[1:]}|{double}|{said}", "surname": surname, "given": given,
        "double": double, "initials": initials, "words": said, "typed": typed, "typed_given": typed_given, "keys": sorted(keys),
    }


def _keys_of(kind: str, tokens: list[str]) -> set[str]:
    """Codes of the sorted tokens, and those with one symbol of one long token left out."""
    codes = [phonetic(respelled(t)) for t in tokens]
    return {f"{kind}|" + "|".join(sorted(codes[:i] + codes[i + 1 :])) + "|" + v for i in range(len(tokens)) for v in (codes_of([tokens[i]]) if len(tokens[i]) >= 5 else {codes[i]})}


def _same_words(x: list[str], y: list[str], x_typed: Iterable[str], y_typed: Iterable[str]) -> bool:
    """Whether two lists of words are alike in any order, but for one that may be another spelling."""
    if len(x) != len(y):
        return False
    left, right = list(x), list(y)
    for t in x:
        if t in right:
            left.remove(t)
            right.remove(t)
    if len(left) == 1 and min(len(left[0]), len(right[0])) >= 5:
        a_typed = [w for t in x_typed for w in t.split() if folded(w) == left[0]]
        b_typed = [w for t in y_typed for w in t.split() if folded(w) == right[0]]
        return near(left[0], right[0], a_typed, b_typed)
    return not left


def given_codes(of: dict) -> set[str]:
    """Codes under which the given names of one person meet."""
    typed = of["typed_given"]
    return codes_of([f for g in (of["given"], of["double"]) if g for f in formal_names(g)] + [typed] * (isinstance(typed, str) and len(typed) > 0), 1)


def compare(a: dict, b: dict) -> tuple[str | None, bool, bool]:
    """(how two classes are linked, whether the surnames are equal, whether a middle initial speaks for it).

    ``same``: one entity; ``initial``: one has initials only, which fit the other; ``initials``: both have; None: apart.
    """
    apart = (None, False, False)
    if a["kind"] != b["kind"]:
        return apart
    if a["kind"] == "organisation":
        return ("same" if _same_words(a["surname"].split(), b["surname"].split(), a["typed"], b["typed"]) else None), a["surname"] == b["surname"], False
    if a["words"] and b["words"] and not (a["words"][0] == b["words"][0] == ","):
        x, y = (w["words"].lstrip(",").split() for w in (a, b))
        if len(x) > 1 and _same_words(x, y, (), ()):
            return "same", True, False
    equal = a["surname"] == b["surname"] or respelled(a["surname"]) == respelled(b["surname"])
    if not equal and (min(len(a["surname"]), len(b["surname"])) < 5 or not near(a["surname"], b["surname"], a["typed"], b["typed"])):
        return apart
    sounds_equal = equal or sound_equal(a["surname"], b["surname"])
    i, j = a["initials"], b["initials"]
    middle = len(i) > 1 and len(j) > 1
    if middle and i[1] not in j[1:] and j[1] not in i[1:]:
        return apart
    if a["given"] and b["given"]:
        names = lambda p: {respelled(f) for g in (p["given"], p["double"]) if g for f in formal_names(g)}
        one = bool(names(a) & names(b))
        if not one and sounds_equal and set(a["codes"]) & set(b["codes"]):
            by_sound = not (a["given"] in _GIVEN and b["given"] in _GIVEN)  # two names in use are two names, however they sound
            one = any(near(x, y, a["typed_given"], b["typed_given"], by_sound) for x in formal_names(a["given"]) for y in formal_names(b["given"]))
        return ("same" if one else None), equal, middle
    if not i or not j:
        return apart
    firsts = lambda p: {f[:1] for f in formal_names(p["given"])} if p["given"] else {p["initials"][0]}
    if not firsts(a) & firsts(b):
        return apart
    if a["given"] or b["given"]:
        return "initial", equal, middle
    return ("initials" if equal else None), equal, middle


ONE = ("kind", "cls", "surname", "sound", "given", "double", "initials", "words", "typed", "typed_given")
PARSED = pa.schema([("name", pa.string()), *((c, pa.string()) for c in ONE), ("keys", pa.list_(pa.string())), ("codes", pa.list_(pa.string()))])
PARSED_DDL = "name string, " + ", ".join(f"{c} string" for c in ONE) + ", keys array<string>, codes array<string>"
PARTS = ("kind", "surname", "sound", "given", "double", "initials", "words", "typed", "typed_given", "codes")
LINKS = pa.schema([("a", pa.string()), ("b", pa.string()), ("how", pa.string()), ("equal", pa.bool_()), ("middle", pa.bool_())])
LINKS_DDL = "a string, b string, how string, equal boolean, middle boolean"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ends_of(n) for n in batch.column(0).to_pylist()]
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["name", "comma", "first", "last"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, firsts, lasts = (batch.column(k).to_pylist() for k in range(3))
        read = [read_name(n, bool(f), bool(l)) for n, f, l in zip(names, firsts, lasts)]
        for r in read:
            r["sound"] = respelled(r["surname"]) if r["kind"] == "person" else ""
        codes = [sorted(given_codes(r)) if r["given"] else [] for r in read]
        columns = [names, *([r[c] for r in read] for c in (*ONE, "keys")), codes]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PARSED.types)], schema=PARSED)


def given_words(ends: DataFrame) -> DataFrame:
    """``word``: those known as given names from the names with a comma, of ``name, comma, first, last``.

    By share, so that it does not depend on how many names there are: a surname that now and then stands after a comma is none.
    """
    pairs = ends.filter("comma and first <> '' and last <> ''").select("first", "last").distinct()
    each = pairs.select(F.col("last").alias("word"), F.lit(1).alias("given")).unionByName(pairs.select(F.col("first").alias("word"), F.lit(0).alias("given")))
    stats = each.groupBy("word").agg(F.sum("given").alias("g"), F.count("*").alias("n"))
    return stats.filter((F.col("g") >= GIVEN_SURNAMES) & (F.col("g") >= F.col("n") * GIVEN_SHARE)).select("word")


def parsed_names(names: DataFrame) -> DataFrame:
    """The parts of each distinct name."""
    ends = written(names.mapInArrow(_ends, "name string, comma boolean, first string, last string"), "name-ends")
    known = given_words(ends)
    of_first, of_last = known.select(F.col("word").alias("first"), F.lit(True).alias("f")), known.select(F.col("word").alias("last"), F.lit(True).alias("l"))
    told = ends.filter("not comma").join(of_first, "first", "left").join(of_last, "last", "left").select("name", "f", "l")
    other = ends.filter("comma").select("name", F.lit(None).cast("boolean").alias("f"), F.lit(None).cast("boolean").alias("l"))
    together = told.unionByName(other).repartition(shuffle_width(names.sparkSession), "name")
    return together.mapInArrow(_parse, PARSED_DDL).filter("cls is not null")


def name_classes(parsed: DataFrame) -> DataFrame:
    """One row per class; ``typed`` and ``typed_given`` are all ways in which it was typed."""
    fixed = ("kind", "surname", "sound", "given", "double", "initials", "words")
    every = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return parsed.groupBy("cls").agg(*[F.first(c).alias(c) for c in fixed], F.collect_set("typed").alias("typed"), F.collect_set("typed_given").alias("typed_given"), every("keys"), every("codes"))


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        kept = []
        for a, b in zip(left, right):
            how, equal, middle = compare(a, b)
            if how:
                # of an "initial" link, a is the name with initials only
                turn = how == "initial" and bool(a["given"])
                kept.append((b["cls"], a["cls"], how, equal, middle) if turn else (a["cls"], b["cls"], how, equal, middle))
        columns = list(zip(*kept)) if kept else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, LINKS.types)], schema=LINKS)


def block_sizes(classes: DataFrame) -> DataFrame:
    """``key, n``: classes of each block."""
    return classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _may_be_near(a: Column, b: Column) -> Column:
    """Whether ``near`` may hold of two surnames: what its exact checks need, by distances computed in the JVM."""
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    # a swap is two edits here, and leaves the same letters
    typed = lambda x, y: F.when(F.levenshtein(x, y) <= 2, True).otherwise((F.levenshtein(x, y) <= 4) & (F.levenshtein(letters(x), letters(y)) <= 2))
    return (
        (F.levenshtein(a["sound"], b["sound"]) <= 1)
        | (F.levenshtein(a["surname"], b["surname"]) <= 2)
        | F.exists(a["typed"], lambda x: F.exists(b["typed"], lambda y: typed(x, y)))
    )


def _may_be_linked(a: Column, b: Column) -> Column:
    """A condition that every pair meets which ``compare`` links: given names must share a code, and surnames be near."""
    words = (a["words"] != "") & (b["words"] != "")
    given = (F.size(a["codes"]) == 0) | (F.size(b["codes"]) == 0) | F.arrays_overlap(a["codes"], b["codes"])
    return (a["kind"] == b["kind"]) & (words | (a["kind"] == "organisation") | given & _may_be_near(a, b))


def candidates(classes: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """``a, b``: pairs of classes of a common block, as structs, each pair once: in the first of the blocks they share."""
    classes = classes.withColumn("keys", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("codes", F.transform("codes", lambda k: F.xxhash64(k)))
    keyed = classes.select(F.explode("keys").alias("key"), F.struct("cls", *PARTS, "keys").alias("c"))
    hot = written(block_sizes(classes).filter(F.col("n") > hot_block).select("key", F.lit(True).alias("hot")), "hot-blocks")
    is_split = not hot.isEmpty()
    usual = keyed.join(hot, "key", "left_anti") if is_split else keyed
    a, b = F.col("l.c"), F.col("r.c")
    once = (F.col("l.key") == F.array_min(F.array_intersect(a["keys"], b["keys"]))) & _may_be_linked(a, b)

    def met(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
        return left.alias("l").join(right.alias("r"), F.col("l.key") == F.col("r.key")).filter(condition & once).select(a.alias("a"), b.alias("b"))

    found = met(usual, usual, a["cls"] < b["cls"])
    if not is_split:
        return found
    # Hot blocks: full names by the codes of their given names as well; those with initials only, and organisations, with the whole block.
    split = keyed.join(hot, "key", "left_semi")
    coded = split.filter(F.size("c.codes") > 0).withColumn("code", F.explode("c.codes"))
    first_code = F.col("l.code") == F.array_min(F.array_intersect(a["codes"], b["codes"]))
    by_code = coded.alias("l").join(coded.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.code") == F.col("r.code")))
    full = by_code.filter((a["cls"] < b["cls"]) & first_code & once).select(a.alias("a"), b.alias("b"))
    bare = split.filter(F.size("c.codes") == 0)
    # words in any order may be linked without a common given name
    any_order = split.filter((F.size("c.codes") > 0) & (F.col("c.words") != ""))
    others = (a["cls"] < b["cls"]) & (F.size(F.array_intersect(a["codes"], b["codes"])) == 0)
    short = met(bare, split, (a["cls"] < b["cls"]) | (F.size(b["codes"]) > 0))
    return found.unionByName(full).unionByName(short).unionByName(met(any_order, any_order, others))


def name_entities(names: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """``name, entity``: one row per distinct non-null name; names of one entity share it. Names of nobody are left out."""
    distinct = names.select("name").filter(F.col("name").isNotNull()).distinct()
    parsed = written(parsed_names(distinct), "parsed-names")
    classes = written(name_classes(parsed), "name-classes")
    links = written(candidates(classes, hot_block).mapInArrow(_linker, LINKS_DDL), "name-links")
    same = links.filter("how = 'same'").select("a", "b")
    persons = connected_components(same)
    # The person that each name with initials only fits, if it is one: by equal surname and middle initial, else by equal surname, else by a like one.
    fits = (
        links.filter("how = 'initial'")
        .join(persons, F.col("b") == F.col("node"), "left")
        .select("a", F.coalesce("component", "b").alias("to"), F.expr("case when equal then if(middle, 0, 1) else if(middle, 2, 3) end").alias("level"))
        .groupBy("a", "level")
        .agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
        .groupBy("a")
        .agg(F.min(F.when(F.col("lo") == F.col("hi"), F.struct("level", "lo"))).alias("one"), F.min("level").alias("best"))
    )
    settled = fits.filter("one.level = best").select("a", F.col("one.lo").alias("b"))
    unfit = links.filter("how = 'initials'").join(fits.select("a"), "a", "left_anti").join(fits.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b")
    entities = connected_components(same.unionByName(settled).unionByName(unfit))
    return parsed.join(entities, parsed["cls"] == entities["node"], "left").select("name", F.coalesce("component", "cls").alias("entity"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of different names of the same entity, name_a < name_b."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
