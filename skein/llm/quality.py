"""Quality classifier: a factorisation machine.

A text's features are its distinct hashed words, the quantile bins of its
structure statistics and those of its metadata (stated length). The machine
adds to a linear score the low-rank interactions of all feature pairs, which the
sum-of-squares identity gives in time linear in the features:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_k ((sum_i v_ik x_i)^2 - sum_i (v_ik x_i)^2).

Null texts count as empty; these have features too (their statistics) and get a
score like any other. Without labelled rows every score is the prior.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skein.llm.common import claim, held_out, map_batches, table
from skein.llm.labelled import FOLDS, learning_rows, prior, ragged

BITS = 16  #: of the word hash
RANK = 8  #: of the interactions
BINS = 16  #: quantile bins of a statistic
STATS = ("chars", "words", "word_length", "distinct", "commonest", "upper", "digits", "marks", "odd_marks", "high_bytes", "breaks", "repeated_lines", "capital_words", "marked_words", "neighbours", "stated_length")
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*|~^<>{}[]=+_@\\/!"]] = True
_UPPER, _DIGIT, _MARK = (np.array([f(chr(b)) if b < 128 else False for b in range(256)]) for f in (str.isupper, str.isdigit, lambda c: c.isprintable() and not c.isalnum() and c != " "))
_CODES = np.stack([_UPPER, _DIGIT, _MARK, _ODD, np.arange(256) >= 128]).astype(np.float64).T
CACHE = 150_000


class _Bucket(dict):
    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word.lower()) & ((1 << BITS) - 1)
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


_bucket = _Bucket()
_ENDS = frozenset(b for b in range(33, 127) if not chr(b).isalnum())


def featurise(text: str, stated: int | None) -> tuple[np.ndarray, list[float]]:
    """(hashes of the distinct words, structure statistics)."""
    claim("quality", _bucket.clear)
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    count = Counter(words)
    kinds = max(len(count), 1)
    upper, digits, marks, odd, high = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CODES / size).tolist()
    lines = [x for x in raw.split(b"\n") if x]
    stats = [
        np.log1p(len(text)), np.log1p(n), len(text) / max(n, 1), len(count) / max(n, 1), max(count.values(), default=0) / max(n, 1),
        upper, digits, marks, odd, high, raw.count(b"\n") / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(map(bytes.isupper, count)) / kinds, sum([w[-1] in _ENDS for w in count]) / kinds,
        sum(map(eq, words, words[1:])) / max(n, 1), np.log1p(max(len(text) if stated is None else stated, 0)),
    ]
    return np.unique(np.fromiter(map(_bucket.__getitem__, count), np.int64, len(count))), stats


@dataclass
class Machine:
    edges: np.ndarray  # (statistics, BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def features(self, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values); a statistic's bin counts as much as all words together."""
        bins = (stats[:, None] > self.edges).sum(1) + np.arange(len(STATS)) * BINS + (1 << BITS)
        return np.concatenate((words, bins)), np.concatenate((np.full(len(words), 1 / np.sqrt(max(len(words), 1))), np.full(len(bins), 0.5)))

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, tuple]:
        """Probabilities of rows of features, and what the gradient needs."""
        idx, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        sizes = np.array([len(r[0]) for r in rows])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        vx = self.factors[idx] * x[:, None]
        total = np.add.reduceat(vx, starts)
        z = self.bias + np.add.reduceat(self.linear[idx] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (idx, x, sizes, vx, total)


def learn(words: list[np.ndarray], stats: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.15, decay: float = 1e-5) -> Machine:
    """At least this many steps of Adagrad on the logistic loss, whole epochs; the order of the rows follows from a fixed seed."""
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(y) else np.zeros((len(STATS), BINS - 1))
    p = prior(y)
    rng = np.random.default_rng(7)
    size = (1 << BITS) + len(STATS) * BINS
    m = Machine(edges, float(np.log(p / (1 - p))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if not len(y):
        m.factors[:] = 0
        return m
    rows = [m.features(w, s) for w, s in zip(words, stats, strict=True)]
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(-(-steps * batch // len(y))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            pick = order[k : k + batch]
            prob, (idx, x, sizes, vx, total) = m.score([rows[i] for i in pick])
            g = np.repeat((prob - y[pick]) / len(pick), sizes) * x
            gv = g[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            by = np.argsort(idx, kind="stable")
            own, first = np.unique(idx[by], return_index=True)
            gw = np.add.reduceat(g[by], first) + decay * m.linear[own]
            gv = np.add.reduceat(gv[by], first) + decay * m.factors[own]
            gb = float(np.mean(prob - y[pick]))
            seen_w[own] += gw**2
            seen_v[own] += gv**2
            seen_b += gb**2
            m.linear[own] -= rate * gw / np.sqrt(seen_w[own])
            m.factors[own] -= rate * gv / np.sqrt(seen_v[own])
            m.bias -= rate * gb / np.sqrt(seen_b)
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def train(df: DataFrame, labels: DataFrame, label: str = "quality") -> Machine:
    """A machine learned from the bounded sample; its features are made on the executors."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [featurise(t or "", n) for t, n in zip(*(batch.column(0).field(k).to_pylist() for k in (0, 1)), strict=True)]
        return pa.RecordBatch.from_pydict({"w": pa.array([w.astype(np.int32) for w, _ in made], pa.list_(pa.int32())), "s": pa.array([s for _, s in made], pa.list_(pa.float64())), "key": batch.column(1), "y": batch.column(2)})

    got = map_batches(learning_rows(df, labels, label, F.col("text"), stated(df)), ["made", "key", "y"], run, "w array<int>, s array<double>, key bigint, y int").toArrow()
    order = np.lexsort((got["w"].combine_chunks().value_lengths().to_numpy(), got["key"].to_numpy()))  # not the cluster's
    stats = np.array(ragged(got["s"], order)).reshape(len(order), len(STATS))
    return learn(ragged(got["w"], order), stats, got["y"].to_numpy()[order].astype(np.float64))


def stated(df: DataFrame) -> Column:
    """The stated length, null where the table has none."""
    return (F.col("n_chars").cast("long") if "n_chars" in df.columns else F.lit(None).cast("long")).alias("stated")


def score(df: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """row (a struct of these columns of df) and score, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    place = keep.index("text") if "text" in keep else None
    given = df.select(kept, stated(df), *([] if "text" in keep else [F.col("text").alias("text")]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts, lengths = (batch.column(2) if place is None else batch.column(0).field(place)).to_pylist(), batch.column(1).to_pylist()
        out = []
        for k in range(0, len(texts), 512):
            rows = []
            for t, n in zip(texts[k : k + 512], lengths[k : k + 512], strict=True):
                w, s = featurise(t or "", n)
                rows.append(m.features(w, np.array(s)))
            out.append(m.score(rows)[0])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], ["row", "score"])

    return map_batches(given, given.columns, run, StructType([given.schema["row"], StructField("score", DoubleType())]))


THRESHOLD = 0.3


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("row.doc_id", held_out("row.doc_id", FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
