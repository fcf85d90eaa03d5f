"""Table-generating text operators: chunkers, spans and their statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import TOKEN, chunk_id, tokens
from skein.functions.tokenizers import Tokenizer

CHUNK = "chunk_id string, doc_id string, text string, token_count int, start_offset int, end_offset int, chunk_index int, strategy string"
_token = re.compile(TOKEN)


def sliding_window(docs: DataFrame, size: int = 500, overlap: float = 0.15, strategy: str = "sliding_window", tokenizer: Tokenizer | None = None) -> DataFrame:
    """A window at every stride while it starts inside the text; the last may lie within the one before. tokenizer: in place of the default, which Spark runs itself."""
    stride = max(1, size - int(size * overlap))
    if tokenizer is not None:
        return _windows(docs, size, stride, strategy, tokenizer)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), tokens("text").alias("t")).where(F.size("t") > 0)
    rows = rows.select("doc_id", "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(stride))).alias("chunk_index", "start_offset"))
    piece = F.slice("t", F.col("start_offset") + 1, F.lit(size))
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", F.array_join(piece, "").alias("text"), F.size(piece).alias("token_count"),
        "start_offset", (F.col("start_offset") + F.size(piece)).alias("end_offset"), "chunk_index", F.lit(strategy).alias("strategy"),
    )


def _windows(docs: DataFrame, size: int, stride: int, strategy: str, tokenizer: Tokenizer) -> DataFrame:
    """The windows of a tokenizer's numbers, decoded one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text or "")
                rows += [(doc, k, at, min(at + size, len(ids)), tokenizer.decode(ids[at : at + size])) for k, at in enumerate(range(0, len(ids), stride))]
                if len(rows) > 10_000:
                    yield _window_batch(rows)
                    rows = []
            yield _window_batch(rows)

    cells = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "doc_id string, chunk_index int, start_offset int, end_offset int, text string")
    return cells.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "text", (F.col("end_offset") - F.col("start_offset")).alias("token_count"), "start_offset", "end_offset", "chunk_index", F.lit(strategy).alias("strategy"))


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "chunk_index", "start_offset", "end_offset", "text"])


def small_window(docs: DataFrame, overlap: float = 0.15, tokenizer: Tokenizer | None = None) -> DataFrame:
    return sliding_window(docs, 250, overlap, "small_window", tokenizer)


def with_offsets(pieces: DataFrame, strategy: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Chunk rows of (doc_id, chunk_index, text): offsets are running token counts of the document."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.withColumn("token_count", F.size(tokens(F.col("text"))) if tokenizer is None else token_counts(tokenizer)(F.col("text"))).withColumn("end_offset", F.sum("token_count").over(w).cast("int"))
    return rows.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text", "token_count", (F.col("end_offset") - F.col("token_count")).alias("start_offset"), "end_offset", "chunk_index", F.lit(strategy).alias("strategy"))


def token_counts(tokenizer: Tokenizer):
    """A tokenizer's number of tokens as a column function; a null text has none."""

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(tokenizer.encode(t or "")))

    return count


def split_recursive(text: str, target: int, overlap: float, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most `target` tokens, cut at the coarsest separator that does; "" parts characters.

    Parts join up to the target, and a run begins with the end of the run before it. A run
    that is too long with this goes on at the next separator; where none is left, token windows with the same
    overlap cut it.
    """

    def count(t: str) -> int:
        return len(_token.findall(t))

    back = int(overlap * target * 4)

    def runs(parts: list[str]) -> Iterator[str]:
        run = ""
        for part in parts:
            if run and count(run + part) > target:
                yield run
                run = run[-back:] if back else ""
            run += part
        if run:
            yield run

    def cut(t: str, level: int) -> Iterator[str]:
        if not t.strip():
            return
        if count(t) <= target:
            yield t
        elif level == len(separators):
            own = _token.findall(t)
            for at in range(0, len(own), max(1, target - int(target * overlap))):
                yield "".join(own[at : at + target])
        else:
            sep = separators[level]
            parts = t.split(sep) if sep else [*t]
            for run in runs([p + sep for p in parts[:-1]] + parts[-1:]):
                yield from cut(run, level + 1)

    return [*cut(text, 0)]


def split_markdown(text: str, least: int = 100) -> list[str]:
    """Sections at ## and ### headings, a preamble first; those under `least` tokens join the next, a last one the one before."""
    marks = [m.start() for m in re.finditer(r"^#{2,3} .+$", text, re.M)]
    bounds = sorted({0, *marks, len(text)})
    parts = [text[a:b].strip() for a, b in zip(bounds, bounds[1:], strict=False)]
    out, carry = [], ""
    for p in (p for p in parts if p):
        joined = f"{carry}\n\n{p}" if carry else p
        if len(_token.findall(joined)) < least:
            carry = joined
        else:
            out.append(joined)
            carry = ""
    if carry:
        if out:
            out[-1] = f"{out[-1]}\n\n{carry}"
        else:
            out.append(carry)
    return out


def _mapped(docs: DataFrame, split, strategy: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(str(d), k, t) for d, text in zip(b.doc_id, b.text, strict=True) for k, t in enumerate(split(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    return with_offsets(docs.select("doc_id", "text").mapInPandas(run, "doc_id string, chunk_index int, text string"), strategy)


def recursive_char(docs: DataFrame, size: int = 500, overlap: float = 0.15) -> DataFrame:
    return _mapped(docs, lambda t: split_recursive(t, size, overlap), "recursive_char")


def markdown_aware(docs: DataFrame, size: int = 500, overlap: float = 0.15) -> DataFrame:
    """Sections; one over `size` tokens is windowed, with offsets inside the section."""
    stride = max(1, size - int(size * overlap))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text in zip(b.doc_id, b.text, strict=True):
                k = 0
                for section in split_markdown(text or ""):
                    own = _token.findall(section)
                    for start in range(0, len(own), stride) if len(own) > size else [0]:
                        piece = own[start : start + size]
                        rows.append((str(d), "".join(piece), len(piece), start, start + len(piece), k))
                        k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "text", "token_count", "start_offset", "end_offset", "chunk_index"])

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id string, text string, token_count int, start_offset int, end_offset int, chunk_index int")
    return out.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "*", F.lit("markdown_aware").alias("strategy"))


STRATEGIES = {"sliding_window": sliding_window, "recursive_char": recursive_char, "markdown_aware": markdown_aware, "small_window": small_window}


def chunk_documents(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """Chunks by a named strategy. An unknown strategy or an empty text raises; the latter when rows are read."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    text = F.when(blank, F.raise_error(F.concat(F.lit("empty document "), F.col("doc_id").cast("string")))).otherwise(F.col("text"))
    return STRATEGIES[strategy](docs.withColumn("text", text), **options)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks, least, median and most tokens and mean overlap with the chunk before, by strategy."""
    w = Window.partitionBy("strategy", "doc_id").orderBy("chunk_index")
    rows = chunks.withColumn("overlap", F.greatest(F.lag("end_offset").over(w) - F.col("start_offset"), F.lit(0)))
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.min("token_count").alias("min_tokens"), F.median("token_count").alias("median_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))


def sentence_integrity(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """sentence_id and whether a document's chunks hold it whole ('intact'), only its first or last five words ('split') or neither ('missing'). wanted: doc_id, sentence_id, sentence."""
    words = F.split(F.trim("sentence"), r"\s+")
    head, tail = F.array_join(F.slice(words, 1, 5), " "), F.array_join(F.slice(words, -F.least(F.size(words), F.lit(5)), 5), " ")
    rows = wanted.withColumn("head", head).withColumn("tail", tail).join(chunks.select("doc_id", "text"), "doc_id", "left")
    own = F.col("text")
    found = rows.groupBy("doc_id", "sentence_id").agg(F.max(F.coalesce(own.contains(F.col("sentence")), F.lit(False))).alias("whole"), F.max(F.coalesce(own.contains(F.col("head")) | own.contains(F.col("tail")), F.lit(False))).alias("part"))
    return found.select("doc_id", "sentence_id", F.when(F.col("whole"), "intact").when(F.col("part"), "split").otherwise("missing").alias("state"))


def numbered(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def sentence_at(sentences: Column, index: Column) -> Column:
    """The sentence of an index; an empty text for one that doesn't exist."""
    return F.when(index >= 0, F.coalesce(F.get(sentences, index), F.lit(""))).otherwise("")


def sentence_spans(title: Column, sentences: Column) -> Column:
    """[start, end) of each sentence in the text title, line break, sentences."""
    start = F.struct(F.length(title) + 1, F.array().cast("array<array<int>>"))
    names = start.cast("struct<at:int, spans:array<array<int>>>")
    return F.aggregate(sentences, names, lambda a, s: F.struct((a["at"] + F.length(s)).alias("at"), F.concat(a["spans"], F.array(F.array(a["at"], a["at"] + F.length(s)))).alias("spans")), lambda a: a["spans"])
