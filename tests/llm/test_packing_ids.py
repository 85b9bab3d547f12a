"""Ids by the order of merges are those of the tokenizer."""

import random
import time

import numpy as np
import public_tokenizers
import pytest

from rivertrack.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def _theirs(encoder, texts):
    return [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_every_token_is_itself(encoder):
    assert encoder.plain()


def test_all_characters(encoder):
    """In words, numbers, white space and runs, at the ends of a text and inside."""
    for first in range(0, 0x110000, 0x8000):
        chars = [chr(c) for c in range(first, first + 0x8000, 1 if first < 0x20000 else 61) if not 0xD800 <= c < 0xE000]
        texts = [f"{c}a{c}b 1{c}2 {c} {c}{c}\n{c}'s{c}" for c in chars]
        for text, ids in zip(texts, _theirs(encoder, texts), strict=True):
            assert encoder(text, True).tolist() == ids, repr(text)


def test_random_texts(encoder):
    rng = random.Random(3)
    pieces = ["ab", "aaa", "the", " ", "  ", "\n", "\t", "é", "日本", "'s", "'ve", "1", "2024", "!!", "…", " ", "\u0085", "x" * 30, "ing", "tion"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(20_000)]
    texts += ["".join(rng.choices("abt ", k=200)) for _ in range(5_000)]
    for text, ids in zip(texts, _theirs(encoder, texts), strict=True):
        assert encoder(text, True).tolist() == ids, repr(text)


def test_special_tokens_and_long_words_go_to_the_tokenizer(encoder):
    texts = ["a <|endoftext|> b", "x" * 5000, "ab " * 2000, " " * 3000 + "a", "\n" * 3000, "ab" * 3000 + " c"]
    for text, ids in zip(texts, _theirs(encoder, texts), strict=True):
        assert encoder(text, True).tolist() == encoder(text, False).tolist() == ids
    assert 50256 in encoder(texts[0], True)
    began = time.perf_counter()
    for unit in ("a", " ", "\n", "ab", "é", "1"):
        encoder(unit * (400_000 // len(unit)), True)
    assert time.perf_counter() - began < 30


def test_another_tokenizer_is_not_taken_for_plain(tmp_path, encoder):
    import json

    said = json.loads(encoder.tokenizer.to_str())
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(said))
    other = packing.Encoder(str(tmp_path / "other.json"))
    assert not other.plain()
    assert other("a b", False).tolist() == other.tokenizer.encode("a b", add_special_tokens=False).ids
    assert other("a b", False).dtype == np.dtype("<u4")
