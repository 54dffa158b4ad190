"""The encoder against the library on every code point, on random sequences and on one long word."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm.bpe import Coder
from lodestone.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def both():
    path = tokenizer_path("word_bpe_49k.json")
    return Coder(path), Tokenizer.from_file(path)


def differ(both, texts):
    coder, library = both
    expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    found = [np.frombuffer(b"".join(c), "<u4").tolist() for k in range(0, len(texts), 5000) for c in coder.encode_batch(texts[k : k + 5000])]
    return [t for t, a, b in zip(texts, found, expected, strict=True) if a != b]


CHARACTERS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("shape", ["{}", "a{}b", "e{}1 {}x"])
def test_every_code_point(both, shape):
    some = [c for c in CHARACTERS if ord(c) < 0x32000 or 0xE0000 <= ord(c) < 0xE0200 or ord(c) % 97 == 0]
    assert differ(both, [shape.format(c, c) for c in some]) == []


def test_random_sequences(both):
    r = random.Random(5)
    low = [c for c in CHARACTERS if ord(c) < 0x3100]
    marks = [chr(c) for c in [*range(0x300, 0x370), *range(0x591, 0x5C8), *range(0x1DC0, 0x1E00), 0x3099, 0x309A, *range(0x1100, 0x1180)]]
    texts = ["".join(r.choice(low if r.random() < 0.6 else marks) for _ in range(12)) for _ in range(100_000)]
    assert differ(both, texts) == []


def test_one_word_of_a_megabyte(both):
    r = random.Random(1)
    word = "".join(r.choice("abcdefghijklmnopé") for _ in range(1_000_000))
    start = time.time()
    both[0].encode_batch([word])
    assert time.time() - start < 20
    assert differ(both, [word[:20_000]]) == []
