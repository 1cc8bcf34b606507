"""Token ids of a byte-level BPE vocabulary: the definition's own library decides, a faster one with the same vocabulary does the bulk.

Both libraries merge by the same ranks; they could only split differently where their Unicode tables differ. So texts with characters beyond
Latin letters go to the definition's own library, and so do texts that spell out one of its special tokens, which get that token's id.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

_BEYOND_LATIN = re.compile(r"[^\x00-ɏ‐-„…€]")


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokenizer:
    def __init__(self, definition: str, pattern: str):
        table, model = byte_of(), json.loads(definition)
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(table[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        # Without any special token tiktoken looks for an empty one at every character; none of these are ever allowed below.
        special = added or {"\x00": max(ranks.values(), default=0) + 1}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.exact = Tokenizer.from_str(definition)
        self.added = [t for t in added if t]
        self.ends_sentence = np.zeros(max(*ranks.values(), *added.values(), 1) + 1, dtype=bool)
        self.ends_sentence[[i for token, i in ranks.items() if token.endswith((b".", b"!", b"?", b"\n"))]] = True

    def encode(self, text: str) -> np.ndarray:
        if not text.isascii() and _BEYOND_LATIN.search(text) or any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
