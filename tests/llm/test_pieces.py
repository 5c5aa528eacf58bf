"""Token ids of pieces that the library encodes side by side, and the store of their ids."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import stores, tokens

BYTE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(BYTE)
    return lambda x: np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(["th", "ing", "é", "sch", "ö", "re", "tion", "x", "7", ".", "\n", "'s", "中"], k=rnd.randint(2, 9))) for _ in range(n)]


def test_new_pieces_are_asked_together(tok, monkeypatch):
    """op2, op5: one call of the library for thousands of new pieces, not one for each."""
    enc, alone = tokens.PieceEncoder(BYTE), []
    one = enc._piece
    monkeypatch.setattr(enc, "_piece", lambda piece: (alone.append(piece), one(piece))[1])
    texts = [" ".join(f"{w}e" for w in words(500, seed)) for seed in range(20)]
    assert enc.ids(pa.array(texts), b"end!") == [tok(x) + b"end!" for x in texts]
    assert len([x for x in alone if not x.startswith(" \n")]) <= len(texts) + 1  # heads, and the empty piece


@pytest.mark.parametrize("at_once", [1, 3, 4096])
def test_odd_pieces(tok, monkeypatch, at_once):
    """White space of all kinds at pieces' ends, special strings, long pieces, no piece at all."""
    monkeypatch.setattr(tokens, "PIECES_AT_ONCE", at_once)
    rnd = random.Random(at_once)
    bits = [*"abe1.,'é中😀İ각ᆨ \n\t\r\x0b\x1c\x85\xa0　​᠎﻿", "  ", " the", "'ll", "<|endoftext|>", "<|end", "word" * 20]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(1500)] + ["", " ", "  ", "a ", " a", "x" * 9000, "y " * 3000]
    enc = tokens.PieceEncoder(BYTE)
    for _ in range(2):  # new pieces, then kept ones
        assert enc.ids(pa.array([*texts, None], pa.string())) == [*map(tok, texts), b""]


def test_pieces_stay_kept(tok, monkeypatch):
    """op5, op2: 60,000 words fit into 8 MB, so they are asked for once; as entries of a dict they took 13 MB."""
    stores.empty()
    monkeypatch.setattr(stores, "_most", 8 << 20)
    enc, asked = tokens.PieceEncoder(BYTE), []
    many = enc._pieces
    monkeypatch.setattr(enc, "_pieces", lambda rests: (asked.append(len(rests)), many(rests))[1])
    texts = [" ".join(["x", *(f"w{i}e{i % 7}" for i in range(first, first + 10_000))]) for first in range(0, 60_000, 10_000)]
    for _ in range(2):
        for x in texts:
            assert enc.ids(pa.array([x])) == [tok(x)]
    assert sum(asked) == 60_001 and stores._used <= 8 << 20


def test_store_starts_anew(monkeypatch):
    """The budget holds for dicts and arrays together; what was dropped is made again."""
    stores.empty()
    monkeypatch.setattr(stores, "_most", 100_000)
    asked, store, other = [], stores.KeptArrays(), stores.Kept(lambda k: k.encode())

    def make(keys):
        asked.extend(keys)
        return [k.encode() for k in keys]

    for _ in range(2):
        for first in range(0, 5000, 500):
            keys = [f"k{i}" for i in range(first, first + 500)] + ["z" * 100]
            assert store.many(pa.array(keys), make).to_pylist() == [k.encode() for k in keys]
            assert other[f"k{first}"] == f"k{first}".encode()
            assert stores._used <= 100_000 and len(store.keys) == len(store.values)
    assert asked.count("z" * 100) == 20 and asked.count("k0") == 2
    n = len(asked)
    assert store.many(pa.array(["k4999"]), make).to_pylist() == [b"k4999"] and len(asked) == n
    keys = [f"much more {i}" for i in range(5000)]
    assert store.many(pa.array(keys), make).to_pylist() == [k.encode() for k in keys] and stores._used <= 100_000
