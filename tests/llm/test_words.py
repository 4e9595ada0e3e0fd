"""Token ids of single characters beside signs and of random strings, against the tokenizers library."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from salvage.llm.words import TextEncoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def assert_same_ids(name, keeps_spaces, texts):
    path = public_tokenizers.path(name)
    ids, counts = TextEncoder(path, keeps_spaces)(pa.array(texts, pa.string()))
    found = np.split(ids, np.cumsum(counts)[:-1])
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, f, e in zip(texts, found, expected) if f.tolist() != e.ids]
    assert not wrong, [ascii(t) for t in wrong[:20]]


@pytest.mark.parametrize("name, keeps_spaces", [(WORD, False), (BYTE, True)])
def test_every_character_beside_signs(name, keeps_spaces):
    characters = [chr(i) for i in range(0x3000)]
    assert_same_ids(name, keeps_spaces, [f"{a}{c}{b}" for c in characters for a, b in (("a", "#1"), ("x-", "b"), ("(", ")"))])


@pytest.mark.parametrize("name, keeps_spaces", [(WORD, False), (BYTE, True)])
def test_random_strings(name, keeps_spaces):
    rng = random.Random(11)
    signs = "".join(map(chr, range(128))) + "  \n\t.,#'"
    pool = signs + "éßİñ日本語한글ªº²½ⅷ́क़ড়ਲ਼ẞ \xa0　😀𝔘"
    everywhere = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 24))) for _ in range(24_000)]
    texts += ["".join(rng.choices(everywhere, k=3)) + rng.choice(signs) + rng.choice(signs) + "a" for _ in range(6_000)]
    assert_same_ids(name, keeps_spaces, texts)
