"""Which of very many phrases stand in texts, by one automaton over all of them.

Phrases are taken in blocks of bounded size. A block is broadcast, each worker builds its
Aho-Corasick automaton once and runs texts through it where they lie, so a pass costs the
length of the texts however many phrases there are, and what is sent on are the finds alone.
Phrases beyond BLOCKS blocks are looked up by the texts' word n-grams instead, in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

try:
    import ahocorasick
except ImportError:  # n-grams serve all then
    ahocorasick = None

#: Phrases and characters of a block, and blocks that are run through the texts one after the other.
PHRASES, CHARACTERS, BLOCKS = 200_000, 8_000_000, 8

_built: dict[str, object] = {}


def _automaton(key: str, phrases: list[str], pad: str):
    """The block's automaton; a worker keeps that of one block."""
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for p in phrases:
            made.add_word(f"{pad}{p}{pad}", p)
        made.make_automaton()
        _built[key] = made
    return _built[key]


def phrases_in(texts: DataFrame, id_col: str, phrases: DataFrame) -> DataFrame:
    """id, phrase: the phrases (words parted by single spaces) that stand in each text (id, w: array of words without spaces), each once. A null or empty phrase or text holds nothing."""
    asked = phrases.where("phrase <> ''").select("phrase").distinct()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    kind = texts.schema[id_col].dataType
    if not size["n"]:
        return texts.sparkSession.createDataFrame([], StructType([StructField(id_col, kind), StructField("phrase", StringType())]))
    if ahocorasick is None or size["n"] > PHRASES * BLOCKS or size["chars"] > CHARACTERS * BLOCKS:
        return by_grams(texts, id_col, asked)
    out, line = None, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    lines = texts.where(F.size("w") > 0).select(id_col, line.alias("line"))
    rest = (r["phrase"] for r in asked.toLocalIterator())  # bounded above
    while block := list(islice(rest, min(PHRASES, max(1, CHARACTERS * size["n"] // size["chars"])))):
        found = _found(lines, id_col, block, " ")
        out = found if out is None else out.unionByName(found)
    return out


def strings_in(texts: DataFrame, id_col: str, strings: DataFrame) -> DataFrame:
    """id, phrase: the strings (column phrase) that each text (id, line) holds anywhere, words or not, each once. Strings of any number run through the texts block by block."""
    asked = strings.where("phrase <> ''").select("phrase").distinct()
    lines = texts.where("line <> ''").select(id_col, "line")
    out = texts.sparkSession.createDataFrame([], StructType([StructField(id_col, texts.schema[id_col].dataType), StructField("phrase", StringType())]))
    rest, block, size = (r["phrase"] for r in asked.toLocalIterator()), [], 0
    for p in rest:
        block.append(p)
        size += len(p)
        if len(block) == PHRASES or size > CHARACTERS:
            out, block, size = out.unionByName(_found(lines, id_col, block, "")), [], 0
    return out.unionByName(_found(lines, id_col, block, "")) if block else out


def _found(lines: DataFrame, id_col: str, block: list[str], pad: str) -> DataFrame:
    """pad: what stands around a phrase, a space where it must be whole words."""
    texts = lines
    kind = texts.schema[id_col].dataType
    shared, key, id_type = texts.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            find = _automaton(key, shared.value, pad).iter
            ids, hits = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {p for _, p in find(text)}
                ids += [i] * len(own)
                hits += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hits, pa.string())], [id_col, "phrase"])

    return texts.mapInArrow(run, StructType([StructField(id_col, kind), StructField("phrase", StringType())]))


def _gram(k: int):
    """From a place on, k words of column w; one argument, as a second would be the index."""
    return lambda i: F.array_join(F.slice("w", i, F.lit(k)), " ")


def by_grams(texts: DataFrame, id_col: str, phrases: DataFrame) -> DataFrame:
    """The same by a join of the texts' distinct word n-grams of every length that a phrase has."""
    asked = phrases.where("phrase <> ''").select("phrase", F.size(F.split("phrase", " ")).alias("k")).distinct()
    lengths = sorted(r["k"] for r in asked.select("k").distinct().collect())  # a number for each length
    out = None
    for k in lengths:
        grams = texts.where(F.size("w") >= k).select(id_col, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), _gram(k)))).alias("phrase"))
        found = grams.join(asked.where(F.col("k") == k).select("phrase"), "phrase").select(id_col, "phrase")
        out = found if out is None else out.unionByName(found)
    return out
