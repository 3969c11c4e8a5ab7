"""Encoding texts with a public tokenizer, and back (problem 7).

The ``tokenizers`` library encodes Arrow batches; nothing is trained and the
vocabulary file stays where it is, its folder is a parameter.  Offsets come from
the bytes: each token stands for a run of bytes, and a cumulative count of the
bytes that begin a character maps places in bytes to places in characters.
Decoding reverses the table of printable characters to bytes, joins the bytes of
all tokens, and only then reads UTF-8, so a character split over several tokens
comes back whole; a character cut off at either end becomes U+FFFD.

Defined results: null and empty texts both give the empty list; strings of
special tokens in a text are ordinary text; texts are encoded whole, however
long.  Long ones go through the library in parts that end between two words,
where its pre-tokenizer divides anyway, so the ids are the same.

A byte-level tokenizer encodes each of its pre-tokenizer's pieces by itself, and
pieces repeat.  So a text is divided here as that pre-tokenizer divides it, and
the library encodes each distinct piece once a worker.  Whether the two divide
alike is found out for every character of the basic plane beforehand; texts with
a character that is told apart otherwise, or beyond that plane, go to the library
whole, as do all texts of other kinds of tokenizers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexichron.session import cores

#: Folder of the public vocabulary files.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Characters given to the library at once: it keeps much beside the ids of what it holds.
AT_ONCE = 400_000
#: A place between two words: a letter, one space, a letter.
_BETWEEN = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str):
    """The tokenizer of a file ``name.json``; strings of its special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(f"{folder}/{name}.json")
    loaded.encode_special_tokens = True
    return loaded


def parts(text: str, most: int = AT_ONCE) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, divided between two words only."""
    at = 0
    while len(text) - at > most:
        cut = _BETWEEN.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


# The published pattern by which byte-level tokenizers of this kind divide a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps, and the longest of them.
PIECES_KEPT, PIECE_LENGTH = 300_000, 64
_KEPT: dict[tuple[str, str], dict[str, list[int]]] = {}


@lru_cache(maxsize=4)
def odd_characters(name: str, folder: str) -> str | None:
    """The characters of the basic plane by which the tokenizer divides texts otherwise than ``PIECES``; None if it is of another kind."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as file:
        described = json.load(file)
    before = described.get("pre_tokenizer") or {}
    if described.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True):
        return None
    divide = tokenizer(name, folder).pre_tokenizer.pre_tokenize_str
    characters = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    odd = set()
    for first in "a1!":  # which of them a character stays with tells its kind
        probe = "".join(f"{first}{c}\n" for c in characters)
        theirs = {at for _, (at, _) in divide(probe)}
        ours = {m.start() for m in regex.compile(PIECES).finditer(probe)}
        odd |= {characters[at // 3] for at in theirs ^ ours}
    return "".join(sorted(odd))


def _by_pieces(texts: list[str], name: str, folder: str) -> list[list[list[int]]]:
    """For each text the ids of its pieces; distinct pieces are encoded once."""
    kept = _KEPT.setdefault((name, folder), {})
    if len(kept) > PIECES_KEPT:
        kept.clear()
    divided = [_PIECES.findall(t) for t in texts]
    new = list({p for pieces in divided for p in pieces if p not in kept})
    known = kept
    if new:
        made = tokenizer(name, folder)
        found = made.encode_batch_fast(new, add_special_tokens=False) if hasattr(made, "encode_batch_fast") else made.encode_batch(new, add_special_tokens=False)
        ids = dict(zip(new, (e.ids for e in found)))
        kept.update((p, i) for p, i in ids.items() if len(p) <= PIECE_LENGTH)
        known = kept if len(ids) == sum(len(p) <= PIECE_LENGTH for p in ids) else kept | ids
    return [[known[p] for p in pieces] for pieces in divided]


def _plain(text: str, odd: str) -> bool:
    """Whether a text is divided here as the tokenizer divides it."""
    return text.isascii() and not odd or not _odd_pattern(odd).search(text)


@lru_cache(maxsize=4)
def _odd_pattern(odd: str) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, odd)) + "\U00010000-\U0010ffff]")


_PIECES = regex.compile(PIECES)


def encode_texts(texts: list[str | None], name: str, folder: str, odd: str | None = None) -> list[np.ndarray]:
    """Ids of each text; with the tokenizer's ``odd_characters`` by distinct pieces, where those don't stand against it."""
    empty = np.empty(0, np.int32)
    if odd is None:
        return _by_library(texts, name, folder)
    plain = [k for k, t in enumerate(texts) if t and _plain(t, odd)]
    out: list = [empty] * len(texts)
    for k, pieces in zip(plain, _by_pieces([texts[k] for k in plain], name, folder)):
        out[k] = np.asarray(list(chain.from_iterable(pieces)), np.int32)
    rest = sorted({k for k, t in enumerate(texts) if t} - set(plain))
    for k, ids in zip(rest, _by_library([texts[k] for k in rest], name, folder)):
        out[k] = ids
    return out


def _by_library(texts: list[str | None], name: str, folder: str) -> list[np.ndarray]:
    made = tokenizer(name, folder)
    encode = getattr(made, "encode_batch_fast", made.encode_batch)
    pieces: list[tuple[int, str]] = [(k, part) for k, text in enumerate(texts) if text for part in parts(text)]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(pieces):
        to, held = at, 0
        while to < len(pieces) and (to == at or held + len(pieces[to][1]) <= AT_ONCE):
            held += len(pieces[to][1])
            to += 1
        for (k, _), e in zip(pieces[at:to], encode([p for _, p in pieces[at:to]], add_special_tokens=False)):
            found[k].append(np.asarray(e.ids, np.int32))
        at = to
    empty = np.empty(0, np.int32)
    return [f[0] if len(f) == 1 else np.concatenate(f) if f else empty for f in found]


@lru_cache(maxsize=4)
def token_bytes(name: str, folder: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Such a file writes a byte as a printable character: itself where it has one,
    else the next free character from 256 on.
    """
    with open(f"{folder}/{name}.json", encoding="utf-8") as file:
        described = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    table = [b""] * (max(described["model"]["vocab"].values()) + 1)
    for token, i in described["model"]["vocab"].items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def decode_ids(ids, name: str, folder: str) -> str:
    """The text of ids; ids that the vocabulary lacks are left out."""
    table = token_bytes(name, folder)
    return b"".join(table[i] for i in ids if 0 <= i < len(table)).decode("utf-8", errors="replace")


def character_offsets(text: str, ids, name: str, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters. A token that holds part of a character covers it all."""
    table = token_bytes(name, folder)
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def _list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of text, so that results stay small."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def share(sample: int, total: int) -> int:
    """The limit of ``in_share`` that chooses about ``sample`` of ``total`` rows: of 63 bits, so that it holds however many there are."""
    return min(sample, total) * (2**63 - 1) // max(total, 1)


def in_share(limit: Column, *columns: str) -> Column:
    """Whether a row is in a sample, by a hash of its columns."""
    return F.xxhash64(*columns, F.lit(11)).bitwiseAND(F.lit(2**63 - 1)) <= limit


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: small files else leave cores idle.

    Rows are dealt out in turn, not by a key, as one key (or null) may be that of many rows.
    """
    wanted = cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def encode(documents: DataFrame, name: str = "byte_bpe_50k", offsets: bool = False, folder: str = FOLDER) -> DataFrame:
    """``doc_id, ids`` of ``doc_id, text``; with ``offsets`` also ``starts`` and ``ends`` of the tokens, in characters."""

    odd = odd_characters(name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                ids = encode_texts(texts, name, folder, odd)
                columns = [batch.column(0), _list_array(ids, pa.int32())]
                names = ["doc_id", "ids"]
                if offsets:
                    both = [character_offsets(t or "", i, name, folder) for t, i in zip(texts, ids)]
                    columns += [_list_array([b[k] for b in both], pa.int32()) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = "doc_id bigint, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(source, "doc_id").mapInArrow(run, ddl)


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``. A null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, name, folder) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(documents: DataFrame, name: str, folder: str = FOLDER) -> DataFrame:
    """``doc_id, n_tokens``; null and empty texts have 0."""
    odd = odd_characters(name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sizes = [len(ids) for ids in encode_texts(batch.column(1).to_pylist(), name, folder, odd)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(source, "doc_id").mapInArrow(run, "doc_id bigint, n_tokens bigint")
