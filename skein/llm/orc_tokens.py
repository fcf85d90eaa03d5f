"""Token ids in ORC files: integer run lengths, row indexes, Bloom filters on document ids.

Documents are range-sorted by id, encoded where they lie and written by Spark's
ORC writer, a file a range: ids and offsets as integers in run-length encoding, a
row index every STRIDE rows, a Bloom filter on the id beside each index entry. A
file's rows know the ids before them in the file; the totals of the files before
it, one number a file, are read from the files' own narrow columns. Readers split
files at stripes, so a file of many stripes is read by many tasks, and a lookup by
id leaves out files, stripes and strides by their statistics and Bloom filters.

A null text is empty and holds the end id alone. Ids ascend, null ids first; rows
that share an id follow by the hash of their text, and rows alike in both are
alike. Equal ids may be parted into several tasks, so a common id makes no large
file. Texts of any length are one row; batches are bounded by bytes. An empty
table gives no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skein.llm.common import claim, map_batches, release, shared_dir, table
from skein.llm.token_counts import byte_symbols

END = 2  #: id behind each document
STRIDE = 1000  #: rows of a row index entry
STRIPE = 16 << 20  #: bytes of a stripe
CACHE = 300_000
BATCH = 18_000_000  #: bytes of texts that are encoded together, or one text
#: Pieces over this many characters are encoded but not remembered.
LONG = 64
#: Chunks that the library's normalizer leaves alone but for their case: characters up to U+024F, composed, of one lower-case letter each; without an apostrophe, which can begin a piece.
PLAIN = "^[!-&(-~\u00a1-\u012f\u0131-\u024f]*$"
#: Fixed value: the split pattern of the tokenizers that this encoder splits itself, and what it comes to without apostrophes and white space.
PATTERN, PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", r"(\p{L}+|\p{N}|[^\p{L}\p{N}]+)"


def _expanded(flat: np.ndarray, start: np.ndarray, pick: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(the cells of these lists one after the other, where each begins and the last ends); list k is flat[start[k] : start[k + 1]]. Some lists at a time, so that the places of cells stay few."""
    ends = np.concatenate(([0], np.cumsum(np.diff(start)[pick])))
    out = np.empty(ends[-1], flat.dtype)
    for k in range(0, len(pick), step):
        own, e = pick[k : k + step], ends[k : k + step + 1]
        at = np.repeat(start[own] - e[:-1], np.diff(e))
        at += np.arange(e[0], e[-1])
        flat.take(at, out=out[e[0] : e[-1]], mode="clip")
    return out, ends


class Encoder:
    """Ids of texts by a tokenizer that drops white space.

    Its normalizer and its split pattern let no match run over white space, so a
    text's ids are those of its chunks between ASCII white space one after the
    other. The distinct chunks of a batch are split once as Arrow arrays: plain ones
    into the pieces of the tokenizer's own pattern, each distinct one of which its
    model encodes, while all others go through the library whole. Up to `cache`
    pieces are remembered.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.splits = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and splits[0]["pattern"].get("Regex") == PATTERN and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.of_byte = {b: c for b, c in enumerate(byte_symbols()) if chr(b) != c}
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def _pieces(self, pieces: list[str], again: np.ndarray) -> list[list[int]]:
        """The ids of each piece; those that come again are remembered, in a young memory that becomes the old one when full."""
        young, old, tokenize, most = self.young, self.old, self.model.tokenize, self.cache // 2
        out = [young.get(p) or old.get(p) for p in pieces]
        for k in [k for k, found in enumerate(out) if found is None]:
            p = pieces[k]
            out[k] = [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.of_byte))]
        for k in np.flatnonzero(again).tolist():
            p = pieces[k]
            if p not in young and len(p) <= LONG:
                if len(young) >= most:
                    self.old, self.young = young, {}
                    young = self.young
                young[p] = out[k]
        return out

    def _plain(self, chunks: pa.Array) -> np.ndarray:
        if not self.splits or not len(chunks):
            return np.zeros(len(chunks), bool)
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        for s in self.special:
            plain = plain & ~pc.match_substring(chunks, s).to_numpy(zero_copy_only=False)
        return plain

    def _chunks(self, chunks: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each chunk's begin and the last's end) of distinct chunks that come so many times."""
        plain = self._plain(chunks)
        easy, odd = pc.utf8_lower(chunks.filter(pa.array(plain))), chunks.filter(pa.array(~plain)).to_pylist()
        # a mark in front of each piece parts it from the one before; the first part is empty. Chunks of letters alone are pieces
        mixed = pc.match_substring_regex(easy, r"[^\p{L}]")
        cut = pc.replace_with_mask(easy, mixed, pc.replace_substring_regex(easy.filter(mixed), PIECE, "\x1f\\1")) if len(easy) else easy
        parts = pc.split_pattern(cut, "\x1f")
        at = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        pieces, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        seen = np.bincount(code, np.repeat(times[plain], np.diff(at)), len(pieces)) if pieces else np.zeros(0)
        if "" in pieces:
            seen[pieces.index("")] = 0
        ids = self._pieces(pieces, seen > 1)
        for k in range(0, len(odd), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch(odd[k : k + 4096], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.concatenate(([0], np.cumsum(n)))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, start[-1])
        # each chunk as a list of these: its pieces, or itself where it's odd
        count = np.ones(len(chunks), np.int64)
        count[plain] = np.diff(at)
        own = np.empty(int(count.sum()), np.int64)
        place = np.concatenate(([0], np.cumsum(count)))
        mine = np.repeat(plain, count)
        own[mine] = code
        own[~mine] = len(pieces) + np.arange(len(odd))
        flat, ends = _expanded(flat, start, own)
        return flat, ends[place]

    def encode(self, texts: pa.Array, end: int | None = END) -> pa.ListArray:
        """The ids of each text, with the end id behind."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, start = self._chunks(coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        # the end id is one more chunk behind each text
        tail = [] if end is None else [end]
        flat, start = np.concatenate((flat, np.array(tail, np.int32))), np.append(start, len(flat) + len(tail))
        flat, ends = _expanded(flat, start, np.insert(coded.indices.to_numpy().astype(np.int64), at[1:] - at[0], len(coded.dictionary)))
        return pa.ListArray.from_arrays(pa.array(ends[(at - at[0]) + np.arange(len(at))].astype(np.int32)), pa.array(flat, pa.int32()))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of about BATCH bytes or less, or one row: the more texts, the fewer chunks are new to each."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            n = min(b.num_rows, -(-b.nbytes // BATCH))
            if n > 1:
                size = -(-b.num_rows // n)
                todo += [b.slice(k, size) for k in range(0, b.num_rows, size)][::-1]
            elif b.num_rows:
                yield b


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    claim("orc_tokens", _encoder.cache_clear)
    return _encoder(path)


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """ORC files of id, at (ids before the document in its file), n_tokens and ids, in ascending order of ids over the files by number."""
    kind = docs.schema[id_col].dataType
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")
    # the last key parts rows that are alike, however many; texts aren't part of the sampled keys
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), hashed, (F.monotonically_increasing_id() % 1024).alias("_copy"))
    rows = rows.repartitionByRange("_id", "_hash", "_copy").sortWithinPartitions("_id", "_hash", "_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in _sized(batches):
            ids = encoder(vocabulary).encode(batch.column(1), end)
            n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(n), ids], names=["doc_id", "at", "n_tokens", "ids"])
        release()

    made = rows.select("_id", "_text").mapInArrow(run, f"doc_id {kind.simpleString()}, at bigint, n_tokens bigint, ids array<int>")
    made.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("orc.create.index", "true").option("orc.row.index.stride", STRIDE).option("orc.stripe.size", STRIPE).orc(path)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, ids before it and ids of each file, in the order of the documents. One number a file, however many rows: the files' narrow columns alone are read."""
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("part")
    sums = spark.read.orc(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", part, "n")
    out, before = [], 0
    for name, _, n in sorted(sums.collect(), key=lambda r: (r["part"], r["file"])):
        out.append((name, before, n))
        before += n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids. Filters on doc_id reach the files."""
    rows = spark.read.orc(path).select("doc_id", "at", "n_tokens", "ids", F.col("_metadata.file_name").alias("_file"))
    base = spark.createDataFrame([(a, b) for a, b, _ in files(spark, path)], "_name string, _before bigint")
    return rows.join(F.broadcast(base), F.col("_file") == F.col("_name")).select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of a few documents: strides whose statistics or Bloom filter rule an id out aren't read."""
    return read(spark, path).where(F.col("doc_id").isin(ids) if ids else F.lit(False))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers."""
    kind = rows.schema["doc_id"].dataType

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        at, raw = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, ["doc_id", "start", "n_tokens", "ids"], run, StructType([StructField("doc_id", kind), *(StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32"))]))


def op12_orc_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/skein-orc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digests(read(spark, path))
