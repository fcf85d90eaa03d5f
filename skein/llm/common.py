"""Helpers that the training-data operators share.

Every operator selects the columns it needs by name; where it returns further
columns of its input, these travel in one struct, so no name clashes with its own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed by the contracts: a word is a run of characters outside these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that one step takes.
PIECE = 8_000_000


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() parts at space and U+0009 to U+000D alone, as the contracts do."""
    return text.encode().split()


def lower_words(text: str) -> list[bytes]:
    """The words with A-Z in lower case: bytes.lower() knows no other letters."""
    return text.encode().lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, folds: int, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or /tmp/checkpoints where it is unset and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again, which cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/skein-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Say that this worker process now keeps memory for `owner`, which clear() empties; what it keeps for others is freed.

    Workers outlive stages. Without this one that has served all stages of a pipeline would hold the memories of all.
    """
    if owner not in _held:
        while _held:
            _held.popitem()[1]()
        _held[owner] = clear
        release()


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def map_batches(df: DataFrame, columns: list[str], f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, most: int = PIECE) -> DataFrame:
    """Apply f to Arrow batches of these columns, of no more than `most` bytes or one row, in place: no shuffle, memory bounded by a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map_sized(batches, most):
            if (out := f(batch)) is not None:
                yield out
        release()

    return df.select(*columns).mapInArrow(run, schema)


def map_sized(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches cut in halves until no more than `most` bytes long, or one row: the texts of one step stay near that however long they are."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.nbytes > most:
                todo += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            elif b.num_rows:
                yield b
