"""Token ids of a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

#: Pre-tokenisation of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Encodes texts as the tokenizer file at ``path`` does without special tokens added; those spelled out in a text keep their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.dtype = np.dtype("<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4")
        self._cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def ids(self, text: str) -> np.ndarray:
        if self._cut is None or not self._cut.search(text):
            return np.array(self.encode(text), self.dtype)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [*self.encode(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return np.array(out + self.encode(text[at:]), self.dtype)
