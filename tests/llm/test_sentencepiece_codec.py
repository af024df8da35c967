"""Chunk by chunk gives what the library gives for whole texts."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from webtrawl.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path(codec.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = codec.Encoder(PATH)


def check(texts):
    seen = 0
    for places, part in codec.in_two(texts):
        assert [texts[k] for k in places] == part
        ids, starts = ENCODER.encode(part)
        for k, text in enumerate(part):
            whole = LIBRARY.encode(text)
            assert ids[starts[k] : starts[k + 1]].tolist() == whole, repr(text)
            assert ENCODER.decoded(text) == LIBRARY.decode(whole), repr(text)
            seen += 1
    assert seen == len(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n▁ab the.é😀\t\x00<s>0xA⁇�"), max_size=25), max_size=12))
def test_any_texts(texts):
    check(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_characters(texts):
    check([t.encode("utf-8", "replace").decode() for t in texts])


def test_prose(rows):
    check([r[1] or "" for r in rows])


def test_blocks_of_texts():
    draw = random.Random(4)
    texts = ["ab " * draw.randrange(9) + "c" for _ in range(50)]
    parts = list(codec.blocks(texts, 40))
    assert [t for a, b in parts for t in texts[a:b]] == texts
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= 40 for a, b in parts)


def test_digests(docs, rows):
    got = sorted((tuple(r) for r in codec.encode_digests(docs, with_ids=True).collect()), key=repr)
    want = []
    for r in rows:
        ids = LIBRARY.encode(r[1] or "")
        text = LIBRARY.decode(ids) if ids else ""
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        want.append((r[0], len(ids), *digests, ids))
    assert got == sorted(want, key=repr)


def test_no_rows(nothing):
    assert codec.encode_digests(nothing).collect() == []
