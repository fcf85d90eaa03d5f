"""Token counts by rank-synchronous array merging.

Pre-tokens not counted before are held together as one ragged numpy array of
symbols. In each round every sequence finds its lowest pair rank and all its
pairs of that rank are merged at once; the symbols that survive are counted.
A merge list orders a pair after the merges that make its parts, so no pair of
a lower rank can arise from a merge and a round may apply all pairs together;
Counter checks that order.

Nulls and empty texts count 0 tokens. Special strings inside texts count as one token.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.byte_bpe import apart, chunked
from skein.llm.common import claim, map_batches, table

#: Fixed value: the split pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
CACHE = 200_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Counts of a vocabulary; as a dict, the tokens of a space and a chunk without spaces."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
        self.cache, self.find = cache, regex.compile(PATTERN).findall
        added = sorted((a["content"] for a in spec["added_tokens"]), key=lambda s: (-len(s), s))
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[x + y] for x, y in merges], np.int32)
        self.width = max(vocab.values()) + 1
        made_at = np.full(self.width, -1, np.int64)
        np.maximum.at(made_at, made, np.arange(len(made)))
        if (np.maximum(made_at[a], made_at[b]) >= np.arange(len(made))).any():
            raise ValueError("a pair stands before the merge that makes its part")
        key = a * self.width + b
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.rank_of, self.made = key[order], order.astype(np.int32), made
        self.pieces: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.rank_of[at], NONE)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        out = np.ones(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        who = np.flatnonzero(lengths > 1)
        lengths = lengths[who]
        sym = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in who), np.uint8)]
        while len(who):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            rank = np.full(len(sym), NONE, np.int32)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[starts + lengths - 1] = NONE  # no pair runs over a sequence's end
            low = np.minimum.reduceat(rank, starts)
            alive = low != NONE
            if not alive.all():
                out[who[~alive]] = lengths[~alive]
                keep = np.repeat(alive, lengths)
                sym, rank, who, lengths, low = sym[keep], rank[keep], who[alive], lengths[alive], low[alive]
                if not len(who):
                    break
            hit = rank == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            # in a run of touching hits (a pair of equal symbols) every second one is taken, from the left
            first = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            ends = np.cumsum(lengths)
            lengths = lengths - np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(lengths))
            sym = sym[keep]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Count pre-tokens that aren't in the cache, pieces of like lengths together."""
        new = sorted(pieces - self.pieces.keys(), key=len)
        if len(self.pieces) + len(new) > self.cache:
            self.pieces.clear()
            new = sorted(pieces, key=len)
        raw = [p.encode() for p in new]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= 400_000):
                size += len(raw[end])
                end += 1
            self.pieces.update(zip(new[at:end], self.merged(raw[at:end]).tolist(), strict=True))
            at = end

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a run of letters behind a space, the common case, is one."""
        return [text] if text[:1] == " " and text[1:].isalpha() else self.find(text)

    def counted(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts without special strings, each distinct pre-token counted once."""
        found = [self.split(t) for t in texts]
        self.learn({p for x in found for p in x})
        count = self.pieces.__getitem__
        return np.fromiter((count(x[0]) if len(x) == 1 else sum(map(count, x)) for x in found), np.int64, len(found))

    def count_array(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null counts as empty. Of texts that fall apart at spaces the distinct chunks of the batch are counted once, and those that come again are remembered."""
        values = texts.to_pylist()
        easy = np.array([bool(t) and apart(t) and not (self.special and self.special.search(t)) for t in values], bool)
        out = np.zeros(len(values), np.int64)
        out[~easy] = self.counts([t or "" for t, e in zip(values, easy.tolist(), strict=True) if not e])
        if easy.any():
            lists = pc.split_pattern(texts.filter(pa.array(easy)), " ")
            start = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            flat = lists.flatten()
            head = np.zeros(len(flat), bool)
            head[start] = True  # the first chunk of a text has no space in front
            rest, heads = flat.filter(pa.array(~head)).dictionary_encode(), flat.filter(pa.array(head)).dictionary_encode()
            words, code = rest.dictionary.to_pylist(), rest.indices.to_numpy()
            own = np.fromiter((self.get(w, -1) for w in words), np.int64, len(words))
            new = np.flatnonzero(own < 0)
            own[new] = self.counted([f" {words[k]}" for k in new])
            again = new[np.bincount(code, minlength=len(words))[new] > 1]
            if len(self) + len(again) > self.cache:
                self.clear()
            self.update((words[k], int(own[k])) for k in again[: self.cache])
            each = np.empty(len(flat), np.int64)
            each[~head], each[head] = own[code], self.counted(heads.dictionary.to_pylist())[heads.indices.to_numpy()]
            out[easy] = np.add.reduceat(each, start)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, one after the other."""
        plain: list[tuple[int, list[str]]] = []  # chunks that can be looked up behind a space
        odd: list[tuple[int, str]] = []
        out = [0] * len(texts)
        for i, text in enumerate(texts):
            parts = [text] if self.special is None else self.special.split(text)
            out[i] = len(parts) - 1
            for part in parts:
                chunks = chunked(part) if part else None
                if chunks is not None:
                    odd.append((i, chunks[0]))
                    plain.append((i, chunks[1:]))
                elif part:
                    odd.append((i, part))
        new = set().union(*(chunks for _, chunks in plain)) - self.keys()
        found = {c: self.find(f" {c}") for c in new}
        pieces = [(i, self.find(part)) for i, part in odd]
        self.learn({p for x in found.values() for p in x} | {p for _, x in pieces for p in x})
        count = self.pieces.__getitem__
        if len(self) + len(new) > self.cache:
            self.clear()
            found |= {c: self.find(f" {c}") for _, chunks in plain for c in chunks if c not in found}
            self.learn({p for x in found.values() for p in x} | {p for _, x in pieces for p in x})
        for c, x in found.items():
            self[c] = sum(map(count, x))
        for i, x in pieces:
            out[i] += sum(map(count, x))
        for i, chunks in plain:
            out[i] += sum(map(self.__getitem__, chunks))
        return out


@lru_cache(maxsize=4)
def _counter(path: str, cache: int) -> Counter:
    return Counter(path, cache)


def counter(path: str, cache: int = CACHE) -> Counter:
    """The worker's counter of a vocabulary."""
    claim("token_counts", _counter.cache_clear)
    return _counter(path, cache)


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than limit tokens) of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(path).count_array(batch.column(1))
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": size, "n_tokens": pa.array(n)})

    return map_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
