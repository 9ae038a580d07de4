"""Token ids of byte-level BPE vocabularies, equal to the tokenizers library's and several times as fast."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken

from .bpe_fst import BpeTransducer

#: The pre-token pattern of the vocabulary's library (fixed value), and the same without look-ahead, which it equals where no two white-space characters stand together.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE_SPACED = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
RUNS = re.compile(r"\s\s")


class Ids:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: only byte-level BPE is supported")
        plain = BpeTransducer._alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(plain[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: ids are not in the order of merges, which ranks them here")
        self.special = set(special)
        self.largest = max([*ranks.values(), *special.values()])
        self.whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.simple = tiktoken.Encoding("single-spaced", pat_str=SINGLE_SPACED, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return (self.whole if RUNS.search(text) else self.simple).encode_to_numpy(text, allowed_special=self.special)


@functools.lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    return Ids(path)
