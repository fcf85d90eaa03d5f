"""Training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and is
written as Parquet before the next one reads it. All but the last return the
columns of documents, further ones of any name included; n_chars follows a changed text.

A null text counts as empty: the quality stage scores it like any other, it has no
near copies and no secrets, and as its size is 0 the mix takes none of it. Null ids
and sources are values like others. An empty table gives one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import byte_bpe, mixing, near_duplicates, quality, secret_scan
from skein.llm.common import WORD, stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at 0.3 or more."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine, docs.columns).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_duplicates.deduplicated(docs, width=5, num=80, den=100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch in which the mix takes a document. The one at a source's budget ends there: its last row keeps the words that are left, parted by single spaces."""
    mixed = mixing.mix(docs, mixing.word_count("text"))
    taken, size = F.col("mix.taken"), F.col("mix.size")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    rows = mixed.where(taken > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = taken - size * (F.col("copy") - 1)
    short = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    rows = rows.select("row", F.when(words < size, short).alias("cut"))  # null where the whole text stays
    new = {"text": F.coalesce("cut", "row.text"), "n_chars": F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType))}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids, their digest and that of the bytes which they decode to."""
    coded = byte_bpe.encode(docs, *byte_bpe.default_vocabulary(), with_decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", deduplicate),
    ("secret_scans", redact),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", encode),
]

#: No stage but the fourth has a form in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
