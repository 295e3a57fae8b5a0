"""Token counts by a public byte-level BPE vocabulary; the file's path is a parameter."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that the vocabulary was published with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, loaded once in a worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_ids(text: str, path: str = VOCABULARY) -> np.ndarray:
    return np.asarray(encoding(path).encode_ordinary(text), dtype=np.int64)
