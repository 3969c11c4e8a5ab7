"""Tokens against another implementation, packing against plain first-fit decreasing."""

import base64
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexichron.llm import packing, tokens

NAME = "byte_bpe_50k"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{NAME}.json"), reason="no vocabulary files")
TEXTS = [None, "", " ", "plain words", "<|endoftext|> is text", "naïve λόγος 日本語 🕊️ 👩‍🏫", "a\n\n b\t c  ", "x" * 5000, "ไทย ได้", "word " * 3000, "​\xad№7 ½"]


def reference(text):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{NAME}.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_ids_round_trip_and_offsets(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    rows = {r.doc_id: r for r in tokens.encode(df, offsets=True).collect()}
    for i, text in enumerate(TEXTS):
        assert rows[i].ids == (reference(text) if text else [])
        if text:
            assert rows[i].starts[0] == 0 and rows[i].ends[-1] == len(text)
            assert all(a <= b for a, b in zip(rows[i].starts, rows[i].ends)) and all(e >= s for s, e in zip(rows[i].starts[1:], rows[i].ends[:-1]))
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0


def test_parts_give_the_same_ids():
    random.seed(3)
    text = "".join(random.choice(["word", " ", "  ", "\n", ".", " é", "12", "日"]) for _ in range(4000))
    whole = reference(text)
    assert [i for p in tokens.parts(text, 100) for i in reference(p)] == whole
    assert "".join(tokens.parts(text, 100)) == text and len(list(tokens.parts(text, 100))) > 5


def test_split_characters_decode():
    ids = reference("🕊")
    assert len(ids) > 1 and tokens.decode_ids(ids, NAME, tokens.FOLDER) == "🕊"
    assert "�" in tokens.decode_ids(ids[:-1], NAME, tokens.FOLDER)


def plain_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


def test_first_fit_equals_plain():
    random.seed(4)
    for _ in range(50):
        sizes = sorted((random.randint(0, 30) for _ in range(random.randint(0, 60))), reverse=True)
        assert packing.first_fit(np.array(sizes, np.int64), 30).tolist() == plain_first_fit(sizes, 30)


def test_packing(spark):
    items = [(1, 10, i, n) for i, n in enumerate([25, 10, 0, None, 7, 3, 3, 3, 1, 20])] + [(1, 10, None, 2)]
    df = spark.createDataFrame(items, "limit_id int, capacity int, doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, len(items), group_items=4).collect()
    use, pieces = {}, {}
    for r in rows:
        use[r.container] = use.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(use.values()) <= 10
    for _, _, doc, n in items:
        got = sorted(pieces[doc])
        assert sum(k for _, k in got) == (n or 0) and got[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(got, got[1:]))
        assert len(got) == max(1, -(-(n or 0) // 10))
    assert packing.pack(df.limit(0), 0).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t'’sdl1½éあ𐐀՘　\x1c᠎")), max_size=60), max_size=4))
def test_pieces_give_what_the_library_gives(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for name in ("byte_bpe_50k", "word_bpe_49k"):
        odd = tokens.odd_characters(name, tokens.FOLDER)
        assert (odd is None) == (name == "word_bpe_49k")
        for a, b in zip(tokens.encode_texts(texts, name, tokens.FOLDER, odd), tokens.encode_texts(texts, name, tokens.FOLDER)):
            assert a.tolist() == b.tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_long_texts_in_parts(name, monkeypatch):
    texts = ["The letter's 12 words  went\n\nto the city. " * 30, "x" * 500, "Straße über ναός " * 40]
    whole = tokens.encode_texts(texts, name, tokens.FOLDER)
    divided = tokens.parts
    monkeypatch.setattr(tokens, "parts", lambda text: divided(text, 40))
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, tokens.encode_texts(texts, name, tokens.FOLDER)))


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b")] * 40 + [(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert tokens.encode(df).filter("doc_id is null and size(ids) = 2").count() == 40
    items = spark.createDataFrame([(1, 4, None, 3)] * 40 + [(1, 4, 7, 9)], "limit_id int, capacity int, doc_id bigint, n_tokens bigint")
    got = packing.pack(items, 41, group_items=5).collect()
    assert sum(r.n_tokens for r in got) == 129 and len({r.container >> 32 for r in got}) > 3
