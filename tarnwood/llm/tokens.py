"""Byte-level BPE token ids, by a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation of byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a file of base64 pieces and ranks."""
    import tiktoken

    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        piece, rank = line.split()
        ranks[base64.b64decode(piece)] = int(rank)
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str | None], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of all texts, one after another; null is as ''."""
    own = encoding(path)
    ids = [np.array(own.encode_ordinary(t) if t else [], np.uint32) for t in texts]
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=first[1:])
    return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), first


def decode(ids, path: str = VOCABULARY) -> str:
    return encoding(path).decode([int(i) for i in ids])
