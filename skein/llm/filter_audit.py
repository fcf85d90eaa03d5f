"""Filter interaction audit by a relational word pipeline.

Texts are dealt by (id, hash of the text), exploded into words and aggregated by
(document, word), then by document, for totals and distincts; one exchange serves
both. The other flags come from a second, narrow pass over the documents, are
joined to these on the same key, and a part's documents become conditional counts,
one for each of the 32 sets of filters that a document can fail. All orders of
the filters are read from these counts.

A null text counts as empty and a null source as an empty string. Rows that repeat
an id and a text count each: a marker beside the words tells how many share a key.
A null id is neither smaller nor larger than another, so it makes no text a
repetition, and it has no label; of several labels of an id the largest holds. An
empty table gives no rows. A word or text of any length or frequency is one row
among many: groups are documents and, for equal texts, pre-aggregated minima.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import table

#: Filters in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 2 ** len(FILTERS)
#: Counts of a part: all its documents, those of good quality, the toxic ones.
KINDS = ("docs", "good", "toxic")
SPACE = r"[\x20\x09-\x0D]+"


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("code"), text.alias("text"), *more)


def word_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, share: int = 65) -> DataFrame:
    """id, code, copies, n_words, n_distinct, few (under `least` words) and repeats (distinct words under `share` percent) of each document with its key."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    each = _keyed(docs, id_col, text_col).repartition("id", "code").select("id", "code", F.explode(F.concat(words, F.array(F.lit(None).cast("string")))).alias("word"))
    by_word = each.groupBy("id", "code", "word").agg(F.count("*").alias("n"))
    marked = F.col("word").isNull()
    by_doc = by_word.groupBy("id", "code").agg(F.max(F.when(marked, F.col("n"))).alias("copies"), F.sum(F.when(~marked, F.col("n")).otherwise(0)).alias("n_all"), F.count("word").alias("n_distinct"))
    total = (F.col("n_all") / F.col("copies")).cast("long")
    return by_doc.select("id", "code", "copies", total.alias("n_words"), "n_distinct", (total < least).alias("few"), (100 * F.col("n_distinct") < share * total).alias("repeats"))


def other_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, code, part, capitals (over 5% of code points are A-Z), symbols (any of #$%&*|) and repeated (a smaller id has the same text) of each row."""
    text = F.col("text")
    capitals = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text)
    flags = _keyed(docs, id_col, text_col, F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")).select("id", "code", "part", capitals.alias("capitals"), text.rlike("[#$%&*|]").alias("symbols"), F.unhex(F.sha2(text, 256)).alias("same"))
    # only the first row of a text is looked up, so a text of very many copies meets no one task
    first = flags.where("id is not null").groupBy("same").agg(F.min("id").alias("f_id"), F.min("code").alias("f_code")).select("f_id", "f_code", F.lit(True).alias("first"))
    return flags.join(first, (F.col("id") == F.col("f_id")) & (F.col("code") == F.col("f_code")), "left").select("id", "code", "part", "capitals", "symbols", (F.col("id").isNotNull() & F.col("first").isNull()).alias("repeated"))


def labelled(labels: DataFrame) -> DataFrame:
    """label_id, good and toxic, a row an id."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))


def conditional_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part and, for each kind, a column for each set of failed filters: docs_0 to docs_31, good_0, ..., toxic_31."""
    words = word_flags(docs, id_col, text_col).select(F.col("id").alias("w_id"), F.col("code").alias("w_code"), "few", "repeats")
    other = other_flags(docs, id_col, text_col, part_col)
    both = other.join(words, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("code") == F.col("w_code")), "left").join(labelled(labels), F.col("id") == F.col("label_id"), "left")
    failed = sum((F.when(F.col(c), 2**k).otherwise(0) for k, c in enumerate(("few", "repeats", "capitals", "symbols", "repeated"))), F.lit(0))
    rows = both.select("part", failed.alias("failed"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in KINDS[1:]))
    # documents of one part and set meet in a task's counts first, so a large source sends a few rows only
    cells = rows.groupBy("part", "failed").agg(F.count("*").alias("docs"), *(F.count_if(F.col(c)).alias(c) for c in KINDS[1:]))
    return cells.groupBy("part").agg(*(F.expr(f"sum(if(failed = {m}, {k}, 0)) AS {k}_{m}") for k in KINDS for m in range(MASKS)))


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the conditional counts.

    What a step removes depends on its filter and the set of those before it, not on their order: 80 cases.
    """
    cases: dict[tuple[int, int], list[str]] = {}
    for order in ORDERS:
        for k, own in enumerate(order):
            cases.setdefault((1 << FILTERS.index(own), sum(1 << FILTERS.index(c) for c in order[:k])), []).append(order)
    sets = counts.select("part", F.posexplode(F.expr(_array(f"struct({', '.join(f'{k}_{m} AS {k}' for k in KINDS)})" for m in range(MASKS)))).alias("failed", "n")).select("part", "failed", "n.*")
    each = sets.select("*", F.explode(F.expr(_array(f"struct({own} AS own, {before} AS before)" for own, before in cases))).alias("case")).select("*", "case.own", "case.before")
    fails, early = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(kind: str, held: Column) -> Column:
        return F.sum(F.when(held, F.col(kind)).otherwise(0))

    # each filter of a set comes first of it in an equal share of the orders
    share = F.floor(F.lit(len(ORDERS)) / F.bit_count("failed"))
    done = each.groupBy("part", "own", "before").agg(
        total("docs", ~fails & ~early).alias("kept"),
        total("docs", fails & ~early).alias("removed"),
        total("docs", fails & early).alias("redundant"),
        total("docs", F.col("failed") == F.col("own")).alias("unique_fails"),
        total("good", fails & ~early).alias("good_lost"),
        total("toxic", fails & ~early).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("docs") * share).otherwise(0)).alias("shapley"),
    )
    at = {own * MASKS + before: orders for (own, before), orders in cases.items()}
    orders = F.split(F.expr(_array(repr(" ".join(at.get(k, []))) for k in range(max(at) + 1)))[F.col("own") * MASKS + F.col("before")], " ")
    named = done.select("*", F.explode(orders).alias("filter_order"))
    return named.select("part", "filter_order", (F.bit_count("before") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(conditional_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
    len(ws) < 50,
    100 * len(list_distinct(ws)) < 65 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(w.doc_id > least, false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS size FROM f GROUP BY part, fails),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT seq, list_aggregate(list_transform(seq, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, i AS step, seq[i] AS own, seq[1:i - 1] AS before FROM o, k)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (WHERE NOT fails[own] AND NOT early), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE fails[own] AND NOT early), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE fails[own] AND early), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails[own] AND size = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails[own] AND NOT early), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE fails[own] AND NOT early), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // nullif(size, 0)) FILTER (WHERE fails[own]), 0)::BIGINT AS shapley
FROM (SELECT *, len(list_filter(before, lambda x: fails[x])) > 0 AS early FROM g, s)
GROUP BY part, filter_order, step
"""
