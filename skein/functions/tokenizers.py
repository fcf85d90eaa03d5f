"""Tokenizers that chunkers can take in place of the default one.

A tokenizer encodes a text to numbers and decodes numbers to a text. It travels to workers
as what names it (a path and a pattern), and each worker loads it once.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


@dataclass(frozen=True)
class RankedTokenizer:
    """A byte-level vocabulary of ranks in a file of base64 tokens and numbers, with its split pattern. Special strings are ordinary text; bytes that aren't UTF-8 decode to U+FFFD."""

    path: str
    pattern: str

    def encode(self, text: str) -> list[int]:
        return _encoding(self.path, self.pattern).encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return _encoding(self.path, self.pattern).decode(ids, errors="replace")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def get_tokenizer(name: str, known: dict[str, Tokenizer]) -> Tokenizer:
    """The tokenizer of a name in any case."""
    found = {k.lower(): v for k, v in known.items()}.get(name.lower())
    if found is None:
        raise ValueError(f"unsupported tokenizer {name!r}; there are {', '.join(sorted(known))}")
    return found
