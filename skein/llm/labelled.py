"""Learning rows for the classifiers: a bounded sample of the labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held_out

#: Labelled rows that a classifier learns from at most; those with the least hashes of their ids.
LEARN_ROWS = 20_000
FOLDS = 5


def learning_rows(df: DataFrame, labels: DataFrame, label: str, *columns: Column, id_col: str = "doc_id", most: int = LEARN_ROWS) -> DataFrame:
    """made (a struct of these columns), key (a number that orders the rows) and y of labelled rows outside the held-out fold. The sample's ids are broadcast: at most `most` rows."""
    mine = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, FOLDS)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    sample = mine.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    return df.select(F.col(id_col).alias("id"), F.struct(*columns).alias("made")).join(F.broadcast(sample), "id").select("made", F.xxhash64("id").alias("key"), "y")


def ragged(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    """The lists of a column in this order, as views of one array."""
    lists = column.combine_chunks()
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[at[i] : at[i + 1]] for i in order]


def prior(y) -> float:
    """Mean label; without any learned rows 0.4, by which a quality gate keeps and a toxicity gate passes."""
    return (float(sum(y)) + 0.4) / (len(y) + 1)
