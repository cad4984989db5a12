"""Literal special tokens against a plainly loaded tokenizer."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackloom.llm.registry import vocabulary
from trackloom.llm.tokens import encoder

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "the end <|endoftext|> and\n<|startoftext|>more, words", "x <|ENDOFTEXT|> y", "plain words, only.\nhere"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_in_texts(name):
    plain = Tokenizer.from_file(vocabulary(name))
    for text in TEXTS:
        assert np.frombuffer(encoder(vocabulary(name))(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_known_ids():
    assert np.frombuffer(encoder(vocabulary("byte_bpe_50k.json"))("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
