"""Evaluation metrics and statistics. Retrieved: (qid, id, rank); gold: (qid, id); questions: (qid, ...)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import collapse, normalize_answer, terms

#: (recall, reciprocal rank) of a question without gold, by convention.
EMPTY_GOLD = {"dev": (1.0, 0.0), "benchmark": (0.0, 0.0), "runner": (1.0, 1.0)}


def retrieval(questions: DataFrame, retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), convention: str = "benchmark") -> DataFrame:
    """qid, recall_at_k, mrr, all_gold at the last k. A question without result scores 0, one without gold by the convention."""
    recall, rr = EMPTY_GOLD[convention]
    g = gold.select("qid", "id").distinct()
    hits = g.join(retrieved.groupBy("qid", "id").agg(F.min("rank").alias("rank")), ["qid", "id"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), *(F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"h{k}") for k in ks))
    q = questions.select("qid").join(hits, "qid", "left")
    cols = [F.round(F.coalesce(F.col(f"h{k}") / F.col("n"), F.lit(recall)), 6).alias(f"recall_at_{k}") for k in ks]
    return q.select("qid", *cols, F.round(F.when(F.col("n").isNull(), rr).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.coalesce(F.col(f"h{ks[-1]}") == F.col("n"), F.lit(False)).alias("all_gold"))


def precision(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """qid, precision over what was returned within k."""
    r = retrieved.where(F.col("rank") <= k).join(gold.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return r.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("precision"))


def by_type(rows: DataFrame, keys: tuple[str, str], values: list[str]) -> DataFrame:
    """Means by (pipeline, type) and by pipeline over all types, type null."""
    a, b = keys
    return rows.groupingSets([[F.col(a), F.col(b)], [F.col(a)]], F.col(a), F.col(b)).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(v), 4).alias(v) for v in values))


def term_coverage(answer: Column, wanted: Column) -> Column:
    hit = F.size(F.filter(wanted, lambda t: F.lower(answer).contains(F.lower(t))))
    return F.when(F.size(wanted) > 0, hit / F.size(wanted)).otherwise(1.0)


#: Fixed value: what an answer says that a model was told to say where it finds none.
NO_ANSWER = "i cannot answer this question"


def is_refusal(answer: Column, markers: tuple[str, ...] = (NO_ANSWER,)) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.lower(answer).contains(m)
    return out


def citations(answer: Column, evidence: Column) -> Column:
    """Ids that [n] marks in an answer name, each once, those out of range left out."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    return F.transform(F.filter(marks, lambda n: n < F.size(evidence)), lambda n: F.get(evidence, n))


def hallucinated(cited: Column, evidence: Column) -> Column:
    return F.array_sort(F.array_except(cited, evidence))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("int")


def token_f1(df: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """key, em, precision, recall, f1 of answers by shared tokens with their counts. yes, no and noanswer match only themselves."""
    p, g = normalize_answer(F.col(prediction)), normalize_answer(F.col(gold))
    base = df.select(key, p.alias("p"), g.alias("g"))

    def counts(c: str, name: str) -> DataFrame:
        return base.select(key, F.explode(F.filter(F.split(c, " "), lambda t: t != "")).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias(name))

    both = counts("p", "a").join(counts("g", "b"), [key, "t"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("same"))

    def size(c: str) -> Column:
        return F.size(F.filter(F.split(c, " "), lambda t: t != ""))

    special = ("yes", "no", "noanswer")
    out = base.join(both, key, "left").withColumn("same", F.when((F.col("p") != F.col("g")) & (F.col("p").isin(*special) | F.col("g").isin(*special)), 0).otherwise(F.coalesce("same", F.lit(0))))
    pr, rc = F.col("same") / F.when(size("p") > 0, size("p")), F.col("same") / F.when(size("g") > 0, size("g"))
    out = out.select(key, (F.col("p") == F.col("g")).cast("int").alias("em"), F.coalesce(pr, F.lit(0.0)).alias("pr"), F.coalesce(rc, F.lit(0.0)).alias("rc"))
    f1 = F.when(F.col("pr") + F.col("rc") > 0, 2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc"))).otherwise(0.0)
    return out.select(key, "em", F.round("pr", 6).alias("precision"), F.round("rc", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def set_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], by: str, empty: float = 0.0) -> DataFrame:
    """by, tp, precision, recall, f1, em of sets of rows; a side that is empty scores `empty`. Supporting facts, entities and relations alike."""
    p = predicted.select(by, *keys).distinct().withColumn("p", F.lit(1))
    g = gold.select(by, *keys).distinct().withColumn("g", F.lit(1))
    j = p.join(g, [by, *keys], "full_outer").groupBy(by).agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng"))
    pr, rc = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(empty), F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(empty)
    return j.select(by, "tp", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0), 6).alias("f1"), ((F.col("tp") == F.col("np")) & (F.col("tp") == F.col("ng"))).cast("int").alias("em"))


def micro(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    return set_scores(predicted.withColumn("_all", F.lit(1)), gold.withColumn("_all", F.lit(1)), keys, "_all").drop("_all")


def joint(answers: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Products of answer and supporting-fact precision and recall."""
    j = answers.select(key, F.col("em").alias("e1"), F.col("precision").alias("p1"), F.col("recall").alias("r1")).join(facts.select(key, F.col("em").alias("e2"), F.col("precision").alias("p2"), F.col("recall").alias("r2")), key)
    p, r = F.col("p1") * F.col("p2"), F.col("r1") * F.col("r2")
    return j.select(key, (F.col("e1") * F.col("e2")).alias("em"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


#: Rows of a group that one task resamples.
BLOCK = 50_000


def _resampled(rows: DataFrame, by: list[str], value: Column, order: str, draws: int, seed: int) -> DataFrame:
    """The columns by, n, total, wins, losses, ties, lo and hi of each group: its size and sum, the numbers of values over, under and at 0, and the 95% interval of the mean over `draws` resamples.

    A group of any size is dealt to blocks. How many of a resample's rows come from each block is
    multinomial; it is split along a binary tree of the blocks with random numbers of the
    tree's places, so each task finds its own part of every resample alone.
    """
    key = F.to_json(F.struct(*by))  # null-safe
    x = rows.select(key.alias("k"), F.struct(*by).alias("by"), F.col(order).alias("o"), value.cast("double").alias("x")).where("x is not null")
    cut = x.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cut"))
    x = x.join(cut, "k").withColumn("block", F.pmod(F.xxhash64("o"), "cut")).drop("cut")
    sizes = x.groupBy("k", "block").agg(F.count(F.lit(1)).alias("m"))
    every = sizes.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("every"))
    plan = sizes.select("k", "block").join(every, "k")

    def resample(values: pa.Table, plan: pa.Table) -> pa.Table:
        every = plan["every"][0].as_py()
        m, me = np.array([e["m"] for e in every]), [e["block"] for e in every].index(plan["own"][0].as_py())
        key, lo, hi = zlib.crc32(plan["key"][0].as_py().encode()), 0, len(m)
        count = np.full(draws, m.sum())
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = np.random.default_rng([seed, key, lo, hi]).binomial(count, m[lo:mid].sum() / m[lo:hi].sum())
            count, lo, hi = (left, lo, mid) if me < mid else (count - left, mid, hi)
        x = values["x"].to_numpy()
        x = x[np.lexsort((x, values["o"].to_numpy(zero_copy_only=False)))]
        rng = np.random.default_rng([seed, key, me])
        sums = np.array([x[rng.integers(0, len(x), c)].sum() for c in count.tolist()])
        figures = {"n": len(x), "total": float(x.sum()), "wins": int((x > 0).sum()), "losses": int((x < 0).sum()), "ties": int((x == 0).sum())}
        return pa.table({"k": [plan["key"][0].as_py()], **{c: [v] for c, v in figures.items()}, "sums": [sums.tolist()]})

    plan = plan.toDF("key", "own", "every")
    parts = x.select("k", "block", "o", "x").groupBy("k", "block").cogroup(plan.groupBy("key", "own")).applyInArrow(resample, "k string, n long, total double, wins long, losses long, ties long, sums array<double>")
    each = parts.select("k", "n", "total", "wins", "losses", "ties", F.posexplode("sums").alias("draw", "s"))
    per = each.groupBy("k", "draw").agg(F.sum("s").alias("s"), *(F.sum(c).alias(c) for c in ("n", "total", "wins", "losses", "ties")))
    out = per.groupBy("k").agg(F.array_sort(F.collect_list(F.col("s") / F.col("n"))).alias("means"), *(F.first(c).alias(c) for c in ("n", "total", "wins", "losses", "ties")))
    names = x.groupBy("k").agg(F.first("by").alias("by"))
    return out.join(names, "k").select("by.*", "n", "total", "wins", "losses", "ties", F.get("means", int(0.025 * draws)).alias("lo"), F.get("means", int(0.975 * draws) - 1).alias("hi"))


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, order: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Mean of a column with a 95% interval by resampling; the same rows and seed give the same interval."""
    r = _resampled(rows, by, F.col(value), order, draws, seed)
    return r.select(*by, (F.col("total") / F.col("n")).alias("mean"), "lo", "hi")


def paired_bootstrap(rows: DataFrame, by: list[str], a: str, b: str, order: str, draws: int = 10_000, seed: int = 12345) -> DataFrame:
    """Mean difference b - a with a 95% interval, whether that excludes 0, and wins of b, losses and ties."""
    r = _resampled(rows, by, F.col(b) - F.col(a), order, draws, seed)
    return r.select(*by, (F.col("total") / F.col("n")).alias("diff"), "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_0"), "wins", "losses", "ties")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a share; (0, 1) without trials."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half).otherwise(0.0), F.when(n > 0, mid + half).otherwise(1.0)


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts of two raters."""
    return labels.groupBy(F.col(a).alias("first"), F.col(b).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.median(value), 4).alias("median"), F.round(F.max(value), 4).alias("max"), F.round(F.sum(value), 3).alias("total"))


def percentile_at(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The value at index min(n - 1, floor(q n)) of the sorted values: no interpolation."""
    w = Window.partitionBy(by)
    r = rows.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return r.where(F.col("i") == F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))).select(by, F.col(value).alias("value"))


def hit_curve(rows: DataFrame, by: str, order: str, hits: str, lookups: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(by, order, F.round(F.sum(hits).over(w) / F.sum(lookups).over(w), 6).alias("rate"))


def first_touch(rows: DataFrame, item: str, order: str) -> DataFrame:
    """By question: items that none before it has touched."""
    w = Window.partitionBy(item).orderBy(order)
    return rows.withColumn("n", F.row_number().over(w)).groupBy(order).agg(F.count_if(F.col("n") == 1).alias("new"), F.count(F.lit(1)).alias("touched"))


def completeness(rows: DataFrame, wanted: DataFrame, by: str, key: str) -> DataFrame:
    """By run: rows, duplicates, missing and extra keys."""
    have = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates"))
    keys = rows.select(by, key).distinct()
    full = have.select(by).join(F.broadcast(wanted.agg(F.count(F.lit(1)).alias("wanted"))))  # one row
    good = keys.join(wanted.select(key), key, "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("good"))
    extra = keys.groupBy(by).agg(F.count(F.lit(1)).alias("all"))
    return have.join(full, by).join(extra, by).join(good, by, "left").select(by, "rows", "duplicates", (F.col("wanted") - F.coalesce("good", F.lit(0))).alias("missing"), (F.col("all") - F.coalesce("good", F.lit(0))).alias("extra"))


def failures(rows: DataFrame, by: str, errors: str, prefixes: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(by).agg(*(F.count_if(F.exists(errors, _starts(p))).alias(p) for p in prefixes))


def _starts(prefix: str):
    return lambda e: e.startswith(prefix)


def ngrams(words: str, n: int = 4) -> Column:
    """Distinct word n-grams of a column of terms; a column, not an expression, which a lambda would evaluate for each n-gram."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def traced(contexts: DataFrame, chunks: DataFrame, n: int = 4) -> DataFrame:
    """cid, id, shared: word n-grams that a context has in common with a chunk."""
    a = contexts.select("cid", terms(F.col("text")).alias("w")).select("cid", F.explode(ngrams("w", n)).alias("g"))
    b = chunks.select("id", terms(F.col("text")).alias("w")).select("id", F.explode(ngrams("w", n)).alias("g"))
    return a.join(b, "g").groupBy("cid", "id").agg(F.count(F.lit(1)).alias("shared"))


def grounded(claim: Column, text: Column) -> Column:
    return collapse(text).contains(collapse(claim))


def top_difference(a: DataFrame, b: DataFrame, k: int = 6) -> DataFrame:
    """qid, same, only_a, only_b of two plans' k best."""

    def sets(x: DataFrame, name: str) -> DataFrame:
        return x.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias(name))

    j = sets(a, "x").join(sets(b, "y"), "qid", "full_outer")
    x, y = (F.coalesce(c, F.array().cast(a.select(F.array("id")).schema[0].dataType)) for c in ("x", "y"))
    return j.select("qid", (x == y).alias("same"), F.size(F.array_except(x, y)).alias("only_a"), F.size(F.array_except(y, x)).alias("only_b"))


def classify_differences(missing: DataFrame, extra: DataFrame, by: str, name: str) -> DataFrame:
    """by, name, kind: 'renamed' where an unmatched name of the other side holds it or is held by it, else 'missing'. Sides are compared within `by` alone."""
    g = extra.select(by, F.lower(name).alias("o")).groupBy(by).agg(F.collect_set("o").alias("os"))
    m = missing.join(g, by, "left")
    near = F.exists(F.coalesce("os", F.array().cast("array<string>")), lambda o: o.contains(F.lower(name)) | F.lower(name).contains(o))
    return m.select(by, name, F.when(near, "renamed").otherwise("missing").alias("kind"))


def cross_document_share(retrieved: DataFrame, chunk_docs: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, documents, gold_hits and whether the evidence spans documents."""
    r = retrieved.join(chunk_docs, "id").join(gold.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return r.groupBy("qid").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("hit") == 1, F.col("id"))).alias("gold_hits")).withColumn("cross", F.col("documents") > 1)


#: Endings that a stem loses, the first that leaves three letters, and words that say nothing of a text's content.
ENDINGS = ("iness", "ingly", "edly", "ment", "ness", "tion", "ing", "ies", "ied", "ed", "es", "ly", "s")
STOPWORDS = """a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing
down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of
off on once one only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to
too under until up very was we were what when where which while who whom why will with would you your yours""".split()


def stem(word: Column) -> Column:
    """A word in lower case without its ending."""
    w = F.lower(word)
    out = None
    for e in ENDINGS:
        fits = w.endswith(e) & (F.length(w) >= len(e) + 3)
        short = F.substring(w, F.lit(1), F.length(w) - len(e))
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return out.otherwise(w)


def content_stems(text: Column) -> Column:
    """Distinct stems of a text's words of three letters and more, without stop words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)), stem))


def stem_overlap(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(content_stems(a), content_stems(b)))


#: The kinds of questions of a gold set, and the least letters of an answer.
QUESTION_TYPES = ("single-chunk", "two-chunk", "cross-doc", "paraphrase", "no-answer")
LEAST_ANSWER = 40


def gold_problems(questions: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, rule, detail: each rule that a gold set breaks.

    questions: qid, type, text, answer, note; gold: qid, id, required_terms (array); chunks: id,
    doc_id, text. Rules: a known type; gold chunks that exist and hold their required terms in
    any case; one gold chunk for single-chunk and paraphrase questions, two of one document
    for two-chunk ones, two or more of several documents for cross-doc ones, none for no-answer ones, which
    have no answer and a note that says NOT ANSWERABLE; an answer of more than LEAST_ANSWER letters for
    all others; no content stem in common with its chunk for a paraphrase.
    """
    g = gold.select("qid", "id", "required_terms").join(chunks.select("id", "doc_id", F.col("text").alias("chunk")), "id", "left").join(questions.select("qid", "type", F.col("text").alias("q")), "qid")
    lacks = F.filter(F.coalesce("required_terms", F.array().cast("array<string>")), lambda t: ~F.lower("chunk").contains(F.lower(t)))
    shared = stem_overlap(F.col("q"), F.col("chunk"))
    in_chunk = F.array(
        F.when(F.col("chunk").isNull(), F.struct(F.lit("unknown chunk").alias("rule"), F.col("id").cast("string").alias("detail"))),
        F.when(F.size(lacks) > 0, F.struct(F.lit("required terms").alias("rule"), F.array_join(lacks, ",").alias("detail"))),
        F.when((F.col("type") == "paraphrase") & (F.size(shared) > 0), F.struct(F.lit("shared stems").alias("rule"), F.array_join(shared, ",").alias("detail"))),
    )
    of_chunks = g.select("qid", F.explode(F.filter(in_chunk, lambda x: x.isNotNull())).alias("x")).select("qid", "x.*")
    per = g.groupBy("qid").agg(F.count_distinct("id").alias("n"), F.count_distinct("doc_id").alias("docs"))
    q = questions.join(per, "qid", "left").na.fill(0, ["n", "docs"])
    kind, answer = F.col("type"), F.coalesce("answer", F.lit(""))
    wrong = {
        "type": ~F.coalesce(kind, F.lit("")).isin(*QUESTION_TYPES),
        "one gold chunk": kind.isin("single-chunk", "paraphrase") & (F.col("n") != 1),
        "two gold chunks of one document": (kind == "two-chunk") & ((F.col("n") != 2) | (F.col("docs") != 1)),
        "several documents": (kind == "cross-doc") & ((F.col("docs") < 2) | (F.col("n") < 2)),
        "no gold and no answer": (kind == "no-answer") & ((F.col("n") > 0) | F.col("answer").isNotNull() | ~F.coalesce("note", F.lit("")).contains("NOT ANSWERABLE")),
        "an answer": (kind != "no-answer") & (F.length(answer) <= LEAST_ANSWER),
    }
    rules = F.array(*(F.when(bad, F.lit(rule)) for rule, bad in wrong.items()))
    of_questions = q.select("qid", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"), F.concat_ws(":", "type", F.col("n").cast("string")).alias("detail"))
    return of_questions.unionByName(of_chunks)


#: What an answer says that gives none.
REFUSALS = ("cannot answer", "not provided", "does not contain", "i cannot", "insufficient", "not mentioned", "no evidence", "not found")


def corrected(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """One row of means under both conventions: over answerable questions alone, and over all with 1 for those without gold.

    rows: qid, answer, retrieved (array of ids by rank), gold (array), required (array of terms), latency.
    Beside recall at each k and the reciprocal rank: n, answerable, refused (share of the
    unanswerable that are refused), valid_citations (all [n] of an answer are in range), gold_citations (share of
    an answer's citations in range that are gold; without citations 1 for questions without gold), coverage of
    required terms, truncated (answers of 450 tokens and more that end without a mark) and latency.
    """
    none = F.array().cast("array<string>")
    answer, got, gold = F.coalesce("answer", F.lit("")), F.coalesce("retrieved", none), F.coalesce("gold", none)
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    base = rows.select(answer.alias("answer"), got.alias("got"), gold.alias("gold"), marks.alias("marks"), F.array_distinct(F.coalesce("required", none)).alias("required"), "latency")
    base = base.withColumn("has", F.size("gold") > 0).withColumn("cited", F.transform(F.filter("marks", lambda n: n < F.size("got")), lambda n: F.get("got", n)))
    places = F.filter(F.transform("got", lambda x, i: F.when(F.array_contains("gold", x), i + 1)), lambda i: i.isNotNull())

    def recall(k: int) -> Column:
        return F.size(F.array_intersect(F.slice("got", 1, k), "gold")) / F.size("gold")

    hits = F.size(F.filter("cited", lambda c: F.array_contains("gold", c)))
    base = base.withColumn("places", places)
    figures = {f"recall_at_{k}": recall(k) for k in ks} | {"mrr": F.when(F.size("places") > 0, 1 / F.array_min("places")).otherwise(0.0)}
    both = [x for name, c in figures.items() for x in (F.round(F.avg(F.when(F.col("has"), c)), 4).alias(f"answerable_{name}"), F.round(F.avg(F.when(F.col("has"), c).otherwise(1.0)), 4).alias(f"all_{name}"))]
    refused = F.exists(F.array(*(F.lit(r) for r in REFUSALS)), lambda r: F.lower("answer").contains(r))
    valid = F.when(F.forall("marks", lambda n: n < F.size("got")), 1.0).otherwise(0.0)
    aligned = F.when(F.size("marks") == 0, F.when(F.col("has"), 0.0).otherwise(1.0)).when(F.col("has") & (F.size("cited") > 0), hits / F.size("cited")).otherwise(0.0)
    cut_off = ~F.trim("answer").rlike(r"[.!?\"'}\])]$") & (F.size(F.regexp_extract_all("answer", F.lit(r"(\S+)"), F.lit(1))) >= 450)
    return base.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has").alias("answerable"), *both,
        F.round(F.avg(F.when(~F.col("has"), refused.cast("double"))), 4).alias("refused"), F.round(F.avg(valid), 4).alias("valid_citations"), F.round(F.avg(aligned), 4).alias("gold_citations"),
        F.round(F.avg(F.when(F.size("required") > 0, term_coverage(F.col("answer"), F.col("required")))), 4).alias("coverage"), F.count_if(cut_off).alias("truncated"), F.round(F.avg("latency"), 3).alias("latency"),
    )


def stratum_noise(labels: DataFrame, stratum: str, judge: str, human: str, noise: str = "NOISE") -> DataFrame:
    """By stratum, and over all with a null one: n, agreement and the human noise rate with Wilson's intervals, the judge's noise rate. Labels count without case and outer blanks."""
    a, h = F.upper(F.trim(judge)), F.upper(F.trim(human))
    rows = labels.where(F.coalesce(h, F.lit("")) != "").select(F.col(stratum).alias("stratum"), (a == h).alias("same"), (h == noise).alias("hn"), (a == noise).alias("an"))
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"), F.count_if("hn").alias("hn"), F.count_if("an").alias("an")]
    out = rows.groupBy("stratum").agg(*counts).unionByName(rows.agg(*counts).withColumn("stratum", F.lit(None)).select("stratum", "n", "same", "hn", "an"))
    (s_lo, s_hi), (n_lo, n_hi) = wilson(F.col("same"), F.col("n")), wilson(F.col("hn"), F.col("n"))
    parts = {"agreement": F.col("same") / F.col("n"), "agreement_lo": s_lo, "agreement_hi": s_hi, "noise": F.col("hn") / F.col("n"), "noise_lo": n_lo, "noise_hi": n_hi, "judge_noise": F.col("an") / F.col("n")}
    return out.select("stratum", "n", *(F.round(c, 6).alias(name) for name, c in parts.items()))


def _loose(a: Column, b: Column) -> Column:
    """One of two names holds the other; brackets and blanks around them don't count."""
    a, b = F.regexp_replace(a, r"^[() ]+|[() ]+$", ""), F.regexp_replace(b, r"^[() ]+|[() ]+$", "")
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def relation_differences(reference: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """by, source, target, kind of the reference's distinct relations (by, source, target): 'exact', 'renamed' (its ends and those of an unmatched other one hold each other, this way or reversed), else 'missing'. Names count normalised; sides are compared within `by` alone."""
    from skein.functions.text import norm

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(by, norm(F.col("source")).alias("source"), norm(F.col("target")).alias("target")).distinct()

    a, b = pairs(reference), pairs(other)
    keys = [by, "source", "target"]
    free = b.join(a, keys, "left_anti").groupBy(by).agg(F.collect_list(F.struct("source", "target")).alias("free"))
    rows = a.join(b.withColumn("same", F.lit(True)), keys, "left").join(free, by, "left")
    s, t = F.col("source"), F.col("target")
    near = F.exists("free", lambda x: (_loose(s, x["source"]) & _loose(t, x["target"])) | (_loose(s, x["target"]) & _loose(t, x["source"])))
    return rows.select(*keys, F.when(F.col("same"), "exact").when(F.coalesce(near, F.lit(False)), "renamed").otherwise("missing").alias("kind"))


#: Words that are no sign of where a context is from, and the least letters and number of those that are.
COMMON = """about above after against also among and another are because been before being between both but can could does during each from further have
having here into its more most must not only other over same should some such than that the their them then there these they this those through under until
using was were what when where which while will with within would""".split()
LEAST_TERM, LEAST_TERMS, MOST_TERMS = 5, 3, 20


def context_traced(contexts: DataFrame, documents: DataFrame, n: int = 4) -> DataFrame:
    """cid, id, shared (n-grams in common), terms (words in common that the question lacks) and traced (any of the first, or LEAST_TERMS of the second), of contexts (cid, text, question) and documents that have any word in common with them.

    Words are runs of a-z and 0-9. Of a pair's common words of LEAST_TERM letters and more the first MOST_TERMS by
    the alphabet count. Contexts and documents meet on n-grams and on words, not each with each.
    """

    def words(c: str) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))

    a = contexts.select("cid", words("text").alias("w"), words("question").alias("q"))
    b = documents.select("id", words("text").alias("w"))
    grams = a.select("cid", F.explode(ngrams("w", n)).alias("g")).join(b.select("id", F.explode(ngrams("w", n)).alias("g")), "g").groupBy("cid", "id").agg(F.count(F.lit(1)).alias("shared"))

    def telling(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct("w")).alias("t")).where(F.col("t").rlike(f"^[a-z]{{{LEAST_TERM},}}$") & ~F.col("t").isin(*COMMON))

    common = telling(a, "cid").join(telling(b, "id"), "t").groupBy("cid", "id").agg(F.slice(F.array_sort(F.collect_list("t")), 1, MOST_TERMS).alias("t"))
    common = common.join(a.select("cid", "q"), "cid").select("cid", "id", F.size(F.array_except("t", "q")).cast("long").alias("terms"))
    out = grams.join(common, ["cid", "id"], "full_outer").na.fill(0, ["shared", "terms"])
    return out.withColumn("traced", (F.col("shared") > 0) | (F.col("terms") >= LEAST_TERMS))
