import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from silkloom.llm import bpe

PATH = bpe.default_path()
ENCODER, DECODER, LIBRARY = bpe.Encoder(PATH), bpe.Decoder(PATH), Tokenizer.from_file(PATH)


def same(text):
    ids = ENCODER.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == want, text
    assert DECODER.decode(ids, block=3) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdehinorst' .,!0é’ß", max_size=200) | st.text("aAbß\x1c\x1f\x85\xa0  İΣσ́漢😀", max_size=40))
def test_equals_library(text):
    same(text)


def test_specials_and_long():
    r = random.Random(4)
    for text in ("", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "'S'll 12a", "é" * 500, "a" * 5000, "".join(r.choice("abcdeinorst") for _ in range(20_000))):
        same(text)


def test_stream_is_short_and_bounded():
    """The stream gives what the whole piece gives, and holds no more symbols than the lookahead and two tokens ask for."""
    m, r = ENCODER.merges, random.Random(5)
    assert 0 < m.lookahead < 1000
    for _ in range(30):
        piece = "".join(r.choice("abehinorst") for _ in range(r.choice([1, 5, 30, 63])))
        symbols = [*piece[:-1], piece[-1] + m.suffix]
        assert tuple(m.stream(symbols)) == m.short(piece)
    read, emitted, most = 0, 0, 0

    def symbols(n):
        nonlocal read
        for i in range(n):
            read += 1
            yield r.choice("abehinorst") + (m.suffix if i == n - 1 else "")

    for token in m.stream(symbols(30_000)):
        emitted += len(m.names[token].removesuffix(m.suffix))
        most = max(most, read - emitted)
    assert most <= 2 * m.lookahead + 8 * m.longest


def test_byte_decoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, decoder = Tokenizer.from_file(path), bpe.Decoder(path)
    for text in ("Straße 漢字 😀\n\tend", "", "\xff\x80é"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids, block=1) == text
        assert decoder.decode(ids[:-1]) == library.decode(ids[:-1], skip_special_tokens=False)


def test_frames(make, edge_rows):
    docs = make(edge_rows, clash=True).drop("ids", "decoded")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    for r in out.collect():
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe.digests(make([(1, "some text"), (2, None)]), PATH).collect()}
    ids = LIBRARY.encode("some text", add_special_tokens=False).ids
    assert digest[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert (digest[2].n_tokens, digest[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode(make([]), PATH).count() == 0


def test_long_pieces_equal_library():
    """Pieces many times longer than the lookahead, periodic and random, so that tokens are emitted on the way."""
    r = random.Random(8)
    for text in ["ab" * 3000, "the" * 2000, "zq" * 1000 + "e" * 1001, "ing" * 777 + "s"] + ["".join(r.choice(letters) for _ in range(4000)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "ŝé", "-=*.")]:
        same(text)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip_of_odd_rows(make, edge_rows):
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.round_trip(make(edge_rows, clash=True), PATH).collect()), key=str)
    want = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in edge_rows]
    assert got == sorted(((i, ids, LIBRARY.decode(ids, skip_special_tokens=False)) for i, ids in want), key=str)
    assert bpe.digests(make([]), PATH).count() == 0
