"""Near-duplicates with an LSH forest over MinHash signatures.

Texts with equal shingle sets form a class, so exact copies cost one row each.
A class has TREES or more signature orders: in each it stands at a number of DEPTH values of
BITS bits, by which the order is sorted. A region is a run of classes with a longest common
prefix of at least a depth, which the run's size sets: DEPTH - 1 values where no more than
SPARSE classes share them, all DEPTH in denser places. A region's classes
are candidates of each other. As only equal prefixes count, Spark gathers runs by
their prefix instead of sorting the orders. Regions are tied together by stars around their
least class, so no pairs are emitted, and connected regions form a candidate
group. In a group all intersections of the full sets are counted exactly and
links confirmed.

A group over MOST classes or WEIGHT shingles is confirmed as a whole or region by
region, whichever makes fewer copies of its classes; what is still too large goes
to tasks as pairs of blocks, every block with every other one whose set sizes
allow a link. So no two classes of a region go uncompared, however large it is.

Classes with DEPTH values in common are in one region at either depth. A pair at the threshold t shares no region with a probability of
(1 - t^5)^trees at most; the trees are as many as keep it under MISS (25 at 0.85, 35 at 0.80).

Words are runs outside space and U+0009 to U+000D, A-Z in lower case. With fewer
words than a shingle's the whole sequence is the one shingle. Empty and null
texts link with nothing and stay. Rows that repeat an id and a text form one
class; a component's id is its least id, nulls last.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import claim, lower_words, map_batches, stored, table

TREES, MISS = 25, 1e-6  #: trees at least, and the probability that a pair at the threshold is no candidate
DEPTH, BITS = 5, 11
SPARSE = 16  #: classes of a run up to which it is a region at one value less
MOST, WEIGHT = 2048, 8_000_000  #: classes and shingles that one task confirms
CACHE = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def trees_for(num: int, den: int) -> int:
    """The trees that a threshold of num / den takes."""
    share = (num / den) ** DEPTH
    return TREES if share >= 1 else max(TREES, int(np.log(MISS) / np.log1p(-share)) + 1)


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    multiply = (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    return multiply, rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles."""
    claim("near_duplicates", _words.clear)
    words = lower_words(text)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if not n:
        return h
    with np.errstate(over="ignore"):
        span = min(width, n)
        out = np.full(n - span + 1, np.uint64(span))
        for k in range(span):
            out = _mix(out * _A + h[k : n - span + 1 + k] * _C)
    return np.unique(out)


def signature(hashes: np.ndarray, trees: int) -> np.ndarray:
    """The least value of each permutation of 32-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    multiply, add = _permutations(trees * DEPTH)
    with np.errstate(over="ignore"):
        return np.min([(multiply * x[k : k + 1024] + add).min(1) for k in range(0, len(x), 1024)], axis=0)


def orders(sig: np.ndarray) -> np.ndarray:
    """A class's place in the order of each tree: the tree's number and BITS bits of each of its values, the first highest."""
    short = (sig * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)  # the least of many values is small: its lower bits count as well
    out = np.arange(len(sig) // DEPTH, dtype=np.uint64)
    for values in short.reshape(-1, DEPTH).T:
        out = out << np.uint64(BITS) | values
    return out


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def prepare(df: DataFrame, id_col: str, text_col: str, width: int, trees: int, carry: bool = False) -> DataFrame:
    """id, row (a number of its own for each row), n (set size), key (of the set), forest (a place in each order) and the compressed text; if asked for, carry: all of df but the text."""
    kind = df.schema[id_col].dataType.simpleString()
    others = [c for c in df.columns if c != text_col] if carry else []
    kinds = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in others)
    state = {"task": None, "n": 0}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        context = TaskContext.get()
        if state["task"] != context.taskAttemptId():
            state.update(task=context.taskAttemptId(), n=0)
        first = (context.partitionId() << 36) + state["n"]
        state["n"] += batch.num_rows
        press = zstandard.ZstdCompressor(level=1)
        n, key, forest, packed = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text or "", width)
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            forest.append(orders(signature(s, trees)) if len(s) else np.zeros(0, np.uint64))
            packed.append(None if text is None else press.compress(text.encode()))
        more = {"carry": batch.column(2)} if others else {}
        return pa.RecordBatch.from_pydict({"id": batch.column(0), "row": pa.array(np.arange(first, first + len(n)), pa.int64()), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "forest": _longs(forest), "packed": pa.array(packed, pa.binary()), **more})

    schema = f"id {kind}, row bigint, n bigint, key binary, forest array<bigint>, packed binary" + (f", carry struct<{kinds}>" if others else "")
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("carry")] if others else [])]
    df = df.select(*columns)
    return map_batches(df, df.columns, run, schema)


def regions_of(found: DataFrame) -> DataFrame:
    """cls and prefix, the regions of two classes and more that it is in. found: cls, place."""
    run = F.shiftright("place", BITS)
    runs = found.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    near = found.select("cls", "place", run.alias("run")).join(runs, "run")
    return near.select("cls", F.when(F.col("m") <= SPARSE, -1 - F.col("run")).otherwise(F.col("place")).alias("prefix"))


def stars(entries: DataFrame) -> DataFrame:
    """(a, b), a < b: edges that connect the classes of every region. entries: prefix, cls.

    A class knows the least class of each region it shares, one for each tree at
    most. It keeps an edge to the least of these and ties the others to it, so a
    dense group has about one edge for each class, however many regions it spans.
    """
    regions = entries.groupBy("prefix").agg(F.min("cls").alias("a"), F.max("cls").alias("top")).where("a < top").select("prefix", "a")
    known = entries.join(regions, "prefix").where("cls > a").groupBy("cls").agg(F.collect_set("a").alias("heads"))
    known = known.select(F.array_min("heads").alias("a"), F.array_union("heads", F.array("cls")).alias("all"))
    return known.select("a", F.explode("all").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges reaches.

    Rounds of least neighbouring label and pointer jumping; a round's labels are a stored table.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = stored(low.join(jump, "low", "left").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def confirm(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The least index that each set reaches by links den * |intersection| >= num * |union|, all intersections counted exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if den * both >= num * (size.sum() - both) else 1])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(m), size)[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    count = np.diff(np.append(first, len(flat)))
    meet = np.zeros((m, m), np.float32)
    rare = max(8, m // 64)
    for c in np.unique(count[(count > 1) & (count < rare)]):  # shingles of few sets: their pairs one by one
        some = owner[first[count == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i):
                np.add.at(meet, (some[:, j], some[:, i]), 1)
    meet += meet.T
    wide = first[count >= rare], count[count >= rare]
    for k in range(0, len(wide[0]), 2048):  # of many: products of blocks of the membership matrix
        at, c = wide[0][k : k + 2048], wide[1][k : k + 2048]
        member = np.zeros((m, len(at)), np.float32)
        rows = np.repeat(at - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        member[owner[rows], np.repeat(np.arange(len(at)), c)] = 1
        meet += member @ member.T
    linked = np.empty((m, m), bool)
    for k in range(0, m, 256):  # wide integers for some rows at a time
        linked[k : k + 256] = (den + num) * meet[k : k + 256].astype(np.int64) >= num * (size[k : k + 256, None] + size)
    del meet
    np.fill_diagonal(linked, True)
    label = np.arange(m, dtype=np.int32)
    while True:
        new = np.concatenate([np.where(linked[k : k + 256], label, m).min(1) for k in range(0, m, 256)]).astype(np.int32)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unpack(packed: bytes, width: int) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(packed).decode(), width)


def confirm_group(group: pa.Table, width: int, num: int, den: int) -> pa.Table:
    """cls and root (the least class it reaches) of one candidate group."""
    cls = group["cls"].to_numpy()
    order = np.argsort(cls)
    packed = group["packed"].to_pylist()
    root = confirm([_unpack(packed[i], width) for i in order], num, den)
    return pa.table({"cls": pa.array(cls[order]), "root": pa.array(cls[order][root])})


#: Bits of the filter that spares texts of no group the shuffle: 8 MB to broadcast, whatever the input. With many more
#: classes than bits it lets all pass, and the join behind it decides anyway.
FILTER_BITS = 26


def _positions(cls: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _mix(cls.astype(np.uint64) * _A + _C)
    return np.stack([h >> np.uint64(64 - FILTER_BITS), _mix(h) >> np.uint64(64 - FILTER_BITS)]).astype(np.int64)


def texts_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """members (cls, ...) with their packed texts, which the prepared rows of that number hold. A Bloom filter of the members goes ahead of the shuffle."""

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        for batch in batches:
            at = _positions(batch.column(0).to_numpy()).ravel()
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        own = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.int64()), "bits": pa.array(bits[own].view(np.int64), pa.int64())})

    words = members.select("cls").mapInArrow(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def sift(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _positions(batch.column(0).to_numpy())
        hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return batch.filter(pa.array(hit.all(0)))

    likely = map_batches(rows.select(F.col("row").alias("cls"), "packed"), ["cls", "packed"], sift, "cls bigint, packed binary")
    return members.join(likely, "cls")


def _copies() -> Column:
    """Of m classes with w shingles: about the number of tasks that each class goes to."""
    fits = (F.col("m") <= MOST) & ((F.col("m") <= 64) | (F.col("w") <= WEIGHT))
    return F.when(fits, 1).otherwise(1 + F.ceil(2 * F.greatest(F.col("m") / MOST, F.col("w") / WEIGHT)))


def _sized(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))


def paired_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, part): parts that fit a task in which any two classes of a unit meet whose sizes allow a link. members: unit, cls, n.

    Sizes of linked sets differ by the factor den / num at most, so a set's links are in its band of sizes and the next ones.
    """
    wide = float(np.log(den / num)) * (1 + 1e-6) if num < den else 1e-9  # a little wider: logarithms are rounded
    banded = members.withColumn("band", F.floor(F.log("n") / F.lit(wide)))
    cut = _sized(banded, "unit", "band").select("unit", "band", F.ceil(2 * F.greatest(F.col("m") / MOST, F.col("w") / WEIGHT)).alias("cut"))
    blocks = cut.select("unit", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("slice"))
    x, y = blocks.alias("x"), blocks.alias("y")
    later = (F.col("x.band") + 1 == F.col("y.band")) | ((F.col("x.band") == F.col("y.band")) & (F.col("x.slice") <= F.col("y.slice")))
    name = F.concat_ws(":", "x.unit", "x.band", "x.slice", "y.band", "y.slice")
    pairs = x.join(y, (F.col("x.unit") == F.col("y.unit")) & later).select(F.col("x.unit").alias("unit"), name.alias("part"), F.explode(F.array_distinct(F.array(F.struct("x.band", "x.slice"), F.struct("y.band", "y.slice")))).alias("b"))
    pairs = pairs.select("unit", "part", F.col("b.band").alias("band"), F.col("b.slice").alias("slice"))
    dealt = banded.join(cut, ["unit", "band"]).select("unit", "band", F.pmod(F.xxhash64("cls"), "cut").alias("slice"), "cls")
    return dealt.join(pairs, ["unit", "band", "slice"]).select("cls", "part")


def candidate_groups(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, part): parts that fit a task, in which the classes of every region meet; a class may be in several. classes: cls, n, forest."""
    found = stored(regions_of(classes.select("cls", F.explode("forest").alias("place"))), "near")
    groups = components(stars(found)).select(F.col("node").alias("cls"), F.col("label").alias("part"))
    groups = stored(groups.join(classes.select("cls", "n"), "cls"), "groups")
    sizes = _sized(groups, "part").withColumn("copies", _copies())
    large = sizes.where("copies > 1")
    fits = groups.join(large, "part", "left_anti").select("cls", F.concat_ws(":", F.lit("group"), "part").alias("part"))
    if not large.limit(1).count():
        return fits
    large = stored(large, "large")
    regions = stored(groups.join(large.select("part"), "part").join(found, "cls").select("part", "prefix", "cls", "n"), "regions")
    shared = stored(_sized(regions, "part", "prefix").where("m > 1").withColumn("copies", _copies()), "shared")
    apart = shared.groupBy("part").agg(F.sum(F.col("m") * F.col("copies")).alias("apart")).join(large, "part").where(F.col("apart") < F.col("m") * F.col("copies")).select("part")
    apart = stored(apart, "apart")
    whole = groups.join(large.join(apart, "part", "left_anti").select("part"), "part").select(F.concat_ws(":", F.lit("whole"), "part").alias("unit"), "cls", "n")
    own = regions.join(apart, "part").join(shared.select("part", "prefix", "copies"), ["part", "prefix"])
    own = own.select(F.concat_ws(":", F.lit("region"), "part", "prefix").alias("unit"), "cls", "n", "copies")
    return fits.unionByName(own.where("copies = 1").select("cls", F.col("unit").alias("part"))).unionByName(paired_blocks(whole.unionByName(own.where("copies > 1").drop("copies")), num, den))


def _linked(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """id, row, n, component_id and first (the least row that has its component's id) of each prepared row."""
    # sets of one key are equal, and so are their sizes and forests
    classes = stored(rows.where("n > 0").groupBy("key").agg(F.min("row").alias("cls"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("forest").alias("forest")), "classes")
    members = texts_of(rows, stored(candidate_groups(classes, num, den), "parts"))
    links = members.groupBy("part").applyInArrow(lambda t: confirm_group(t, width, num, den), "cls bigint, root bigint").where("root < cls")
    roots = components(links.select(F.col("root").alias("a"), F.col("cls").alias("b")).distinct())
    named = classes.select("key", "cls", "least").join(roots.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # of a component's rows with its id, which copies and repeated ids may make many, one comes first
    of_id = rows.where("n > 0").groupBy("key", "id").agg(F.min("row").alias("row"))
    first = of_id.join(named.select("key", "label"), "key").join(least, "label").where(F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("label", "component_id").agg(F.min("row").alias("first"))
    named = named.join(first, "label").select("key", "component_id", "first")
    out = rows.select("id", "row", "n", "key").join(named, "key", "left")
    return out.select("id", "row", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("first", "row").alias("first"))


def near_duplicates(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id reachable over links of similarity num / den or more) and kept (the id is the component's) of each row."""
    out = _linked(stored(prepare(df, id_col, text_col, width, trees_for(num, den)), "shingles"), width, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def deduplicated(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, one with its id, and all rows without shingles; the columns of df."""
    rows = stored(prepare(df, id_col, text_col, width, trees_for(num, den), carry=True), "shingles")
    kept = _linked(rows, width, num, den).where((F.col("row") == F.col("first")) | (F.col("n") == 0)).select("row").hint("merge")  # most rows: not to be broadcast
    rows = rows.select("row", "carry", "packed").join(kept, "row", "left_semi").select(*(F.col("packed").alias(c) if c == text_col else F.col(f"carry.`{c}`") for c in df.columns))
    names = df.columns
    text = names.index(text_col)

    def restore(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = zstandard.ZstdDecompressor()
        cols = [*batch.columns]
        cols[text] = pa.array([None if p is None else read.decompress(p).decode() for p in cols[text].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(rows, df.columns, restore, df.schema)


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)
