"""Toxicity: a counterfactually regularised classifier.

A sparse logistic model over words and their beginnings. Beside the loss on the
labelled rows it minimises the squared change of the score when an identity term
of a labelled text is swapped for another one, or when one is named in a text
that has none, over all such copies of the labelled texts; a neutral mention of a
group so moves no score, whatever company such terms keep in the labels. An L1
penalty leaves weights on few features.

Null texts count as empty and get the bias's score. Without labelled rows every
score is the prior.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held_out, map_batches, table, words_of
from skein.llm.labelled import FOLDS, learning_rows, prior, ragged

BITS = 20
PREFIXES = (4, 5)
THRESHOLD = 0.5
CACHE = 200_000
#: Terms that name groups, by kind: a swap stays within its kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist", "protestant"),
    ("black", "white", "asian", "african", "latino", "arab", "european", "indigenous", "roma"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "transgender", "heterosexual"),
    ("woman", "man", "female", "male", "women", "men", "girl", "boy"),
    ("immigrant", "refugee", "native", "foreigner", "citizen", "migrant"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    ("muslime", "christ", "jude", "ausländer", "frau", "mann", "schwarze", "weiße"),
    ("musulman", "chrétien", "juif", "étranger", "femme", "homme", "noir", "blanc"),
    ("musulmán", "cristiano", "judío", "extranjero", "mujer", "hombre", "negro", "blanco"),
)
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…“”„‘’–—"


def _term(word: bytes | str) -> str:
    return (word if isinstance(word, str) else word.decode()).strip(_TRIM).lower()


def word_features(word: bytes | str) -> list[int]:
    """Hashes of a word without outer marks, in lower case, and of its beginnings."""
    w = _term(word)
    if not w:
        return []
    own = [f"={w}", *(f"^{w[:n]}" for n in PREFIXES if len(w) >= n)]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in own]


def text_features(text: str) -> np.ndarray:
    """Hashes of all distinct words; a feature stands once for each distinct word that has it."""
    return np.array([f for w in set(words_of(text)) for f in word_features(w)], np.int64)


def identity_pairs(texts: list[str], kinds=IDENTITY, named: int = 64) -> list[tuple[list[int], list[int], int]]:
    """(features that leave, features that come, number of texts) of counterfactual texts. A copy's change of score is that of its swapped words, whatever else it says, so like swaps are one pair.

    A text with a term is paired with its copies that hold the other terms of
    the kind; `named` texts without any are paired with copies that name each term.
    """
    kind_of = {t: kind for kind in kinds for t in kind}
    swaps: Counter[tuple[str, str]] = Counter()
    plain = 0
    for text in texts:
        own = {_term(w) for w in set(words_of(text))} & kind_of.keys()
        swaps.update((t, other) for t in own for other in kind_of[t] if other != t)
        if not own and plain < named:
            plain += 1
            swaps.update(("", t) for t in kind_of)
    return [(word_features(a) if a else [], word_features(b), n) for (a, b), n in sorted(swaps.items())]


@dataclass
class Model:
    bias: float
    hashes: np.ndarray  # of features that have a weight, ascending
    weights: np.ndarray


def learn(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[list[int], list[int], int]], steps: int = 1500, batch: int = 256, rate: float = 0.3, l1: float = 2e-4, counterfactual: float = 1.0, least: int = 2) -> Model:
    """Proximal Adagrad on balanced loss + counterfactual * mean over copies of (change of score)^2 + l1 * |weights|, over features of at least `least` rows."""
    p = prior(y)
    if not 0 < y.sum() < len(y):
        return Model(float(np.log(p / (1 - p))), np.zeros(0, np.int64), np.zeros(0))
    rng = np.random.default_rng(5)
    rows_with = np.zeros(1 << BITS, np.int32)
    for r in rows:
        rows_with[np.unique(r)] += 1
    known = np.flatnonzero(rows_with >= least)
    known = np.union1d(known, np.array([f for pair in pairs for side in pair[:2] for f in side], np.int64))

    def own(features) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, features), len(known) - 1)
        return at[known[at] == features].astype(np.int32)

    rows = [own(r) for r in rows]
    sides = [[own(np.array(pair[k], np.int64)) for pair in pairs] for k in (0, 1)]
    copies = np.array([pair[2] for pair in pairs], np.float64)
    copies /= max(copies.sum(), 1)
    n, size = len(pairs), len(known)
    swapped = np.concatenate([np.zeros(0, np.int64), *sides[0], *sides[1]])
    sign = np.repeat([-1.0, 1.0], [sum(map(len, side)) for side in sides])
    of_pair = np.concatenate([np.repeat(np.arange(n), list(map(len, side))) for side in sides]).astype(np.int64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, seen, bias, seen_b = np.zeros(size), np.full(size, 1e-2), 0.0, 1e-2
    for _ in range(-(-steps * batch // len(y))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            pick = order[k : k + batch]
            idx = np.concatenate([rows[i] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            z = bias + np.bincount(of, w[idx], len(pick))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            total = np.bincount(idx, g[of], size)
            if n:
                change = np.bincount(of_pair, sign * w[swapped], n)
                total += np.bincount(swapped, 2 * counterfactual * sign * (copies * change)[of_pair], size)
            seen += total**2
            pace = rate / np.sqrt(seen)
            moved = w - pace * total
            w = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1 * (total != 0), 0)
            gb = float(g.sum())
            seen_b += gb**2
            bias -= rate * gb / np.sqrt(seen_b)
    at = np.flatnonzero(np.abs(w) > 1e-3)
    return Model(bias, known[at], w[at])


class Scorer(dict):
    """As a dict, the weight of a word as it stands in a text."""

    def __init__(self, model: Model):
        self.model, self.of = model, dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def __missing__(self, word: bytes) -> float:
        s = sum(self.of.get(f, 0.0) for f in word_features(word))
        if len(self) >= CACHE:
            self.clear()
        self[word] = s
        return s

    def __call__(self, text: str) -> float:
        # in sorted order, so that equal texts get equal sums wherever they are scored
        z = self.model.bias + float(sum(sorted(x for x in map(self.__getitem__, set(words_of(text))) if x)))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def train(df: DataFrame, labels: DataFrame, label: str = "toxic", kinds=IDENTITY) -> Model:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(0).field(0).to_pylist()]
        terms = {t for kind in kinds for t in kind}
        own = [" ".join(sorted({_term(w) for w in set(words_of(t))} & terms)) for t in texts]
        return pa.RecordBatch.from_pydict({"f": pa.array([text_features(t).astype(np.int32) for t in texts], pa.list_(pa.int32())), "terms": pa.array(own, pa.string()), "key": batch.column(1), "y": batch.column(2)})

    got = map_batches(learning_rows(df, labels, label, F.col("text")), ["made", "key", "y"], run, "f array<int>, terms string, key bigint, y int").toArrow()
    order = np.lexsort((got["f"].combine_chunks().value_lengths().to_numpy(), got["key"].to_numpy()))  # not the cluster's
    return learn(ragged(got["f"], order), got["y"].to_numpy()[order].astype(np.float64), identity_pairs(sorted(got["terms"].to_pylist()), kinds))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    made: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scorer(shared.value))
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "score": pa.array([made[0](t or "") for t in batch.column(1).to_pylist()], pa.float64())})

    return map_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
