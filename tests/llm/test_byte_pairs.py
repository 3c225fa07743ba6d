"""Long runs are encoded as the library does, and in time about in proportion to their length."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyshelf.llm import bytepair
from tallyshelf.llm.queries import BYTE_BPE_RANKS


@pytest.fixture(scope="module")
def pairs():
    return bytepair.byte_pairs(BYTE_BPE_RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


@pytest.mark.parametrize("text", ["=", "-", "_", "0", " ", "a", "ab", "=-", "é", "\U0001F600"])
def test_runs(pairs, other, text):
    for size in (100, 1000, 4097, 100_000 // len(text)):
        begin = time.process_time()
        ids = np.frombuffer(pairs.encode(text * size), "<u4").tolist()
        assert time.process_time() - begin < 6
        assert ids == other.encode_ordinary(text * size)


def test_merging_with_a_heap_equals_merging_in_a_list(pairs):
    rng = random.Random(5)
    for letters in (b"ab", b"aeioustn", b"=-_", b"abcdefghijklmnopqrstuvwxyz", bytes(range(256))):
        for size in (1, 2, 3, 50, 200):
            piece = bytes(rng.choice(letters) for _ in range(size))
            assert pairs._merge_long(piece) == pairs._merge(piece)


def test_long_words_of_random_letters(pairs, other):
    rng = random.Random(6)
    for letters in ("ab", "aeioustnr", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert np.frombuffer(pairs.encode(text), "<u4").tolist() == other.encode_ordinary(text)
