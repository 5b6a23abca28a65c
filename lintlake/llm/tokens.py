"""Token ids of the public byte-level vocabulary, computed in batches on the workers.

The merges come from the rank file that holds the same vocabulary as the JSON file; a test compares the ids of both.
The rank reader is several times faster, which decides whether whole corpora can be counted.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np

END_ID = 1
VERSION = "byte_bpe_50k"


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VERSION) -> str:
    """Place of a vocabulary's rank file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def ids_of(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit numbers; strings of special tokens are ordinary text."""
    return np.array(_encoding(path or vocabulary_path()).encode_ordinary(text or ""), dtype="<u4")


def count_of(text: str | None, path: str | None = None) -> int:
    return len(_encoding(path or vocabulary_path()).encode_ordinary(text or ""))
