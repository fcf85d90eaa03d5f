"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's symbols form a linked list over its byte offsets. Each merge rank
has a bucket of list positions; two bitmap levels of WIDE-bit words over the
ranks say which buckets hold any. Find-first-set on the top word and then on
the word below finds the lowest rank, the bucket gives its leftmost position, and an entry whose
pair has changed since is stale and skipped. The cost is O(n log n) at worst,
so a pre-token of a whole long text does no harm.

Nulls and empty texts encode to no ids. Rows are neither merged nor dropped.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import claim, map_batches, table

#: Entries that a worker keeps of the chunks it has encoded.
CACHE = 200_000
#: Ranks that a word of the lower bitmap holds; the top bitmap is one integer with a bit for each word.
WIDE = 256
#: Characters up to which pre-tokens are encoded many at once, and how many at most; longer ones go one by one.
SHORT, STEP = 64, 200_000
#: Bytes of texts that are encoded together: a step holds some 40 bytes for each, in chunks, their ids and what those decode to.
PIECE = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    out = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = int(rank)
    return out


class RankQueue:
    """Merges of one vocabulary. Buckets and bitmaps are empty again after each pre-token and so are kept between them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        ids = sorted(ranks.items(), key=lambda x: x[1])
        found = np.array([(ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ids for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], np.int64).reshape(-1, 2)
        found = found[found[:, 0].argsort()]
        #: pairs as first id * 2**20 + second id, ascending, and their ranks
        self.keys, self.values = found[:, 0].copy(), found[:, 1].copy()
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        n = max(ranks.values(), default=0) + 1
        self.lists: list[list[np.ndarray] | None] = [None] * n  # of merge_all
        self.words = [0] * (n // WIDE + 1)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of a pair, for single pre-tokens."""
        return dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))

    @cached_property
    def buckets(self) -> list[list[int]]:
        return [[] for _ in self.lists]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, buckets, words = self.pairs.get, self.buckets, self.words
        ids = [self.byte[b] for b in piece]  # of the symbol that starts at an offset
        n = len(ids)
        after, before, pair = [*range(1, n + 1)], [*range(-1, n - 1)], [-1] * n
        top, i = 0, 0
        for key in map(_key, ids, ids[1:]):
            rank = rank_of(key)
            if rank is not None:
                pair[i] = rank
                bucket = buckets[rank]
                if not bucket:
                    words[rank // WIDE] |= 1 << rank % WIDE
                    top |= 1 << rank // WIDE
                bucket.append(i)  # ascending, so it is a heap
            i += 1
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            rank = w * WIDE + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                words[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[i] = after[j]
            pair[j] = -1
            ids[i] = rank
            if end < n:
                before[end] = i
                new = rank_of(rank << 20 | ids[end])
                if new is None:
                    pair[i] = -1
                else:
                    pair[i] = new
                    bucket = buckets[new]
                    if not bucket:
                        words[new // WIDE] |= 1 << new % WIDE
                        top |= 1 << new // WIDE
                    heappush(bucket, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                new = rank_of(ids[h] << 20 | rank)
                if new is None:
                    pair[h] = -1
                else:
                    pair[h] = new
                    bucket = buckets[new]
                    if not bucket:
                        words[new // WIDE] |= 1 << new % WIDE
                        top |= 1 << new // WIDE
                    heappush(bucket, h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, whose linked lists lie in one set of arrays and share the queue.

        A step takes the lowest rank's bucket and merges its leftmost valid
        position in every pre-token; the others go back to the bucket. A bucket
        is a list of arrays of positions.
        """
        out = [self.ranks.get(p, -1) for p in pieces]
        todo = [k for k, r in enumerate(out) if r < 0]
        packed = [b"" if r < 0 else r.to_bytes(4, "little") for r in out]
        if not todo:
            return packed
        flat = np.frombuffer(b"".join(pieces[k] for k in todo), np.uint8)
        sizes = np.fromiter((len(pieces[k]) for k in todo), np.int64, len(todo))
        owner = np.repeat(np.arange(len(todo)), sizes + 1)  # a slot behind each pre-token parts it from the next
        gaps = np.cumsum(sizes + 1) - 1
        live = np.ones(len(owner), bool)
        live[gaps] = False
        ids = np.full(len(owner), -1, np.int64)
        ids[live] = np.array(self.byte, np.int64)[flat]
        after = np.arange(1, len(owner) + 1)
        before = np.arange(-1, len(owner) - 1)
        pair = np.full(len(owner), -1, np.int64)
        pair[:-1] = self.lookup(ids[:-1], ids[1:])
        buckets, words, top = self.lists, self.words, 0

        def push(rank: np.ndarray, at: np.ndarray) -> int:
            """Positions into the buckets of their ranks; bits of the top word."""
            order = rank.argsort(kind="stable")
            rank, at = rank[order], at[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            bits = 0
            for k, r in enumerate(rank[cuts[:-1]].tolist()):
                bucket = buckets[r]
                if bucket is None:
                    buckets[r] = [at[cuts[k] : cuts[k + 1]]]
                    words[r // WIDE] |= 1 << r % WIDE
                    bits |= 1 << r // WIDE
                else:
                    bucket.append(at[cuts[k] : cuts[k + 1]])
            return bits

        at = np.flatnonzero(pair >= 0)
        if len(at):
            top = push(pair[at], at)
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            rank = w * WIDE + (bits & -bits).bit_length() - 1
            words[w] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            held = buckets[rank]
            buckets[rank] = None
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at.sort()
                whose = owner[at]
                later = whose[1:] == whose[:-1]
                if later.any():
                    # of a position that is held twice the second entry is stale by the time it is read
                    later = np.concatenate(([False], later))
                    top |= push(np.full(int(later.sum()), rank), at[later])
                    at = at[~later]
            elif not len(at):
                continue
            second = after[at]
            end = after[second]
            after[at], before[end], pair[second], live[second], ids[at] = end, at, -1, False, rank
            front = before[at]
            left = np.concatenate((at, front))
            new = self.lookup(ids[left], np.concatenate((ids[end], ids[at])))
            pair[left] = new
            good = new >= 0
            if good.any():
                top |= push(new[good], left[good])
        raw = ids[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[live], minlength=len(todo)))).tolist()
        start = 0
        for k, end in zip(todo, ends, strict=True):
            packed[k] = raw[start:end]
            start = end
        return packed

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 where there is none."""
        key = left << 20 | right
        at = self.keys.searchsorted(key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], -1)


def _key(a: int, b: int) -> int:
    return a << 20 | b


#: The white space that str.isspace() knows in ASCII.
_BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_BESIDE = [x for c in _BLANK for x in (f" {c}", f"{c} ")]
_WIDE_BESIDE = re.compile(r" \s|\s ").search


def apart(text: str) -> bool:
    """Whether the chunks between single spaces can be encoded one by one.

    Where no space stands at an end of the text or beside other white space, no
    match of the pattern runs over a chunk's end: all its alternatives take a
    space only in front or among white space.
    """
    if text[0] == " " or text[-1] == " ":
        return False
    return not (any(x in text for x in _BESIDE) if text.isascii() else _WIDE_BESIDE(text))


def chunked(text: str) -> list[str] | None:
    """These chunks, or None where they can't be encoded one by one."""
    return text.split(" ") if apart(text) else None


def _parts(flat: pa.Array, ends: np.ndarray) -> pa.Array:
    """The cells of a binary array joined up to each of these ends, without a copy."""
    at = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset) if len(flat) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), flat.buffers()[2]])


class Codec:
    """Encoder and decoder of one vocabulary.

    The distinct chunks of a batch are encoded once. Those that come more than
    once stay in a memory of two generations, which holds at most `cache` of them:
    a full young one becomes the old one, from which chunks in use move over.
    """

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        self.ranks, self.find, self.cache = load_ranks(path), regex.compile(pattern).findall, cache
        self.queue = RankQueue(self.ranks)
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a run of letters behind a space, the common case, is one."""
        return [text] if text[:1] == " " and text[1:].isalpha() else self.find(text)

    def pack(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, each distinct pre-token encoded once."""
        found = [self.split(t) for t in texts]
        new = {p for x in found for p in x}
        of = {p: np.array(self.queue.merge(p.encode()), "<u4").tobytes() for p in new if len(p) > SHORT}
        short = [p for p in new if len(p) <= SHORT]
        for k in range(0, len(short), STEP):
            some = short[k : k + STEP]
            of.update(zip(some, self.queue.merge_all([p.encode() for p in some]), strict=True))
        return [of[x[0]] if len(x) == 1 else b"".join([of[p] for p in x]) for x in found]

    def chunk_ids(self, chunks: pa.Array, count: np.ndarray) -> list[bytes]:
        """Packed ids of chunks behind a space, which come so often in a batch."""
        words = chunks.to_pylist()
        out = [*map(self.young.get, words)]
        todo = [k for k, x in enumerate(out) if x is None]
        again = [k for k in todo if words[k] in self.old]
        for k in again:
            out[k] = self.old[words[k]]
        todo = [k for k in todo if out[k] is None] if again else todo
        for k, ids in zip(todo, self.pack([f" {words[k]}" for k in todo]), strict=True):
            out[k] = ids
        keep = [*again, *(k for k in todo if count[k] > 1 and len(words[k]) <= SHORT)]
        for at in range(0, len(keep), max(self.cache // 2, 1)):
            some = keep[at : at + max(self.cache // 2, 1)]
            if len(self.young) + len(some) > self.cache // 2:
                self.young, self.old = {}, self.young
            self.young.update((words[k], out[k]) for k in some)
        return out

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Packed little-endian unsigned 32-bit ids of each text; a null counts as empty."""
        plain = np.array([bool(t) and apart(t) for t in texts.to_pylist()], bool)
        easy, odd = texts.filter(pa.array(plain)), texts.filter(pa.array(~plain))
        out = []
        if len(easy):
            lists = pc.split_pattern(easy, " ")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            at = np.zeros(len(flat), bool)
            at[ends[:-1]] = True  # the first chunk of a text has no space in front
            rest, heads = flat.filter(pa.array(~at)).dictionary_encode(), flat.filter(pa.array(at)).dictionary_encode()
            code = np.empty(len(flat), np.int32)
            code[~at], code[at] = rest.indices.to_numpy(), heads.indices.to_numpy() + len(rest.dictionary)
            ids = self.chunk_ids(rest.dictionary, np.bincount(code[~at], minlength=len(rest.dictionary))) + self.pack(heads.dictionary.to_pylist())
            out.append(_parts(pa.array(ids, pa.binary()).take(pa.array(code)), ends))
        if len(odd):
            out.append(pa.array(self.pack([t or "" for t in odd.to_pylist()]), pa.binary()))
        order = np.empty(len(texts), np.int64)
        order[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(texts))
        return pa.concat_arrays(out).take(pa.array(order)) if out else pa.array([], pa.binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def decode_array(self, packed: pa.Array) -> pa.Array:
        """The bytes that packed ids stand for; none for a null."""
        cells = [x or b"" for x in packed.to_pylist()]
        ids = np.frombuffer(b"".join(cells), "<u4")
        ends = np.cumsum([0, *(len(x) // 4 for x in cells)])
        return _parts(self.tokens.take(pa.array(ids)), ends)

    def decode(self, packed: bytes) -> bytes:
        return self.decode_array(pa.array([packed], pa.binary()))[0].as_py()


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str, cache: int) -> Codec:
    return Codec(path, pattern, cache)


def codec(path: str, pattern: str, cache: int = CACHE) -> Codec:
    """The worker's codec of a vocabulary."""
    claim("byte_bpe", _codec.cache_clear)
    return _codec(path, pattern, cache)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """id, ids (packed little-endian unsigned 32-bit), n_tokens and, if asked for, decoded: the bytes that those ids stand for."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = c.encode_array(batch.column(1))
        cols = {id_col: batch.column(0), "ids": ids, "n_tokens": pc.divide(pc.binary_length(ids), 4).cast(pa.int64())}
        if with_decoded:
            cols["decoded"] = c.decode_array(ids)
        return pa.RecordBatch.from_pydict(cols)

    return map_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, ids binary, n_tokens bigint" + ", decoded binary" * with_decoded, PIECE)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded, the bytes that packed ids stand for; null ids give no bytes, an id that isn't in the vocabulary raises."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "decoded": c.decode_array(batch.column(1))})

    return map_batches(df, [id_col, ids_col], run, f"`{id_col}` {kind}, decoded binary", PIECE)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(df: DataFrame) -> DataFrame:
    return encode(df, *default_vocabulary(), with_decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("n_bytes"))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
