"""Encoding and decoding against the tokenizers library itself."""

import random
import sys
from itertools import chain

import numpy as np
import pytest
from helpers_llm import documents, multiset, pairs_of, sha, texts
from tokenizers import Tokenizer

from faultscope.llm import bpe

PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def ids_of(own, batch):
    ids, ends = own.encode(batch)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def check(own, library, batch):
    want = [x.ids for x in library.encode_batch(batch, add_special_tokens=False)]
    got = ids_of(own, batch)
    for t, a, b in zip(batch, got, want):
        assert a == b, t[:200]
    flat = np.array(list(chain.from_iterable(got)), np.int64)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in got])])
    assert own.decode(flat, ends) == [library.decode(x, skip_special_tokens=False) for x in want] == batch


AWKWARD = [
    "", " ", "\n\n  \t x", "a  b   c ", "it's we'll I'D they've 'tis", "x" * 5000, "ab" * 4000 + "!", "   " * 700, "é" * 90 + "\U0001f600" * 40,
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  ", "<|endoftext", "1234567890" * 30, "日本語のテキスト、한국어 ١٢٣ ²³ Ⅷ",
    "\x00\x1c\x1d\x1e\x1f\x85\xa0 　﻿ z", "".join(chr(i) for i in range(300)), "՘࢏\U00011db0 a՘b 1\U00011de9 2",
]


def test_awkward_texts(own, library):
    check(own, library, AWKWARD)
    check(own, library, texts(4))


def test_random_texts(own, library):
    rng = random.Random(5)
    kinds = ["abcdefghij", "aaab ", "etaoin shrdlu.,'\n", "0123456789 ,.", "éüñß ", " \t\n\r", "<|endoftext>", "日本語中文", "\U0001f600\U0001f469‍"]
    check(own, library, ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 120))) for _ in range(1500)])


def test_every_code_point(own, library):
    every = [chr(c) for c in chain(range(1, 0xD800), range(0xE000, sys.maxunicode + 1))]
    for a in range(0, len(every), 200_000):
        text = "".join(f"a{c}1{c}!{c} " for c in every[a : a + 200_000])
        got, at = [], 0
        for w in own.words(text):
            got.append((at, at + len(w)))
            at += len(w)
        assert got == [x[1] for x in library.pre_tokenizer.pre_tokenize_str(text)]


def test_short_and_long_words_agree(own):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"aeinorst th") for _ in range(rng.randint(2, 64))) for _ in range(500)]
    for w in words:
        assert own.merge_short([w])[0].tolist() == own.merge_long(w).tolist()


def test_bounded_words(library):
    small = bpe.Bpe(PATH, kept=50)
    for seed in range(4):
        check(small, library, texts(seed)[:12] + AWKWARD[:8])
    assert len(small.known) < 5000


def test_long_text(own, library):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdeé\n") for _ in range(rng.randint(1, 9))) for _ in range(400_000))
    assert len(text) > 2 * bpe.PIECE
    check(own, library, [text, "q" * 300_000])


def test_ids_that_are_no_text(own, library):
    rng = random.Random(8)
    runs = [[rng.randrange(50_257) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    flat = np.array(list(chain.from_iterable(runs)), np.int64)
    assert own.decode(flat, np.concatenate([[0], np.cumsum([len(x) for x in runs])])) == [library.decode(x, skip_special_tokens=False) for x in runs]


def test_query(spark, library):
    docs = documents(spark)
    want = []
    for d, t in pairs_of(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    got = bpe.round_trip(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert multiset(got.collect()) == multiset(want)
    back = bpe.decode(bpe.encode(docs))
    assert multiset(back.collect()) == multiset(pairs_of(docs))
    assert bpe.round_trip(docs.limit(0)).count() == 0
