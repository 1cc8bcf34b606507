"""What packing spends on a token."""

import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from qassay.llm import packing
from qassay.llm.tokens import ByteTokenizer


@pytest.mark.parametrize("added", [True, False])
def test_tokenizer_looks_for_a_special_token_that_is_not_empty(added):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = json.load(file)
    if not added:
        for token in definition.pop("added_tokens"):
            definition["model"]["vocab"].pop(token["content"], None)
    definition = json.dumps(definition)
    own, plain = ByteTokenizer(definition, public_tokenizers.PATTERN), Tokenizer.from_str(definition)
    assert own.fast.special_tokens_set and all(own.fast.special_tokens_set)
    for text in ("", "a<|endoftext|>b", "<|endof", "\x00 é …\r\n\t x", "日本 <|endoftext|>", "I'll  go\n\n12a__"):
        assert own.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_cut_points_by_their_definition():
    rng = np.random.default_rng(6)
    for size in (1, 2, 64, 100):
        doc_ends = np.unique(rng.integers(1, 900, 6))
        sentence_ends = np.unique(rng.integers(1, doc_ends[-1] + 1, 9))
        ends = sorted({0, *doc_ends.tolist(), *sentence_ends.tolist()})
        longest, step = max(size // 16, 1), max(size // 32, 1)
        inner = [p for a, b in zip(ends, ends[1:]) if b - a > longest for p in range(a + step, b, step)]
        positions, kinds = packing.cut_points(doc_ends, sentence_ends, size)
        assert positions.tolist() == sorted({*ends, *inner})
        assert kinds.tolist() == [0 if p in {0, *doc_ends.tolist()} else 1 if p in ends else 2 for p in positions.tolist()]
