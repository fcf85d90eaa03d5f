"""Retrieval over a small graph that is built for each question, for batches of questions.

The best chunks of the dense list are seeds. Chunks that a title in the question or a
seed's entity names join them. The records of these chunks alone make a graph for the
question; its nodes that the question names are anchors. Chunks are ranked by what
stands within a few hops of the anchors in them.

A title selects all of its chunks, so pairs of questions and selected chunks are many.
query_focused() makes none of them rows: records are numbers, the chunks of a title lie in rows of at
most PACK of them, a question meets these by its titles, and its graph is a task's arrays.

Tables: questions (qid, text), dense (qid, id, rank), titles (id, title), mentions
(chunk_id, name), relations (chunk_id, source, target). A question's graph is rows with its
qid, so a batch's graphs grow side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions.text import norm
from skein.operators import graph as G
from skein.operators.phrases import strings_in

#: Seeds, hops, the weight of an edge, the least characters of an anchor.
SEEDS, HOPS, EDGE_WEIGHT, LEAST_ANCHOR = 5, 2, 0.5, 3
COUNTERS = ("n_selected", "anchors", "graph_nodes", "graph_edges", "supported")


def whole_phrase(phrase: Column, text: Column) -> Column:
    """Whether a phrase stands in a text with no word character beside it."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return (phrase != "") & F.rlike(text, quoted)


def seed_names(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """qid, name: the entities of the seeds' records."""
    return seeds.select("qid", F.col("id").alias("chunk_id")).join(mentions.select("chunk_id", "name"), "chunk_id").select("qid", "name").distinct()


@dataclass
class QuestionGraphs:
    """nodes (qid, key, chunk: a row for each chunk that names it), links (qid, s, t, chunk: a row for each chunk of an edge), in keys of names."""

    nodes: DataFrame
    links: DataFrame

    def near(self) -> DataFrame:
        """qid, a, b of the links, both ways."""
        return self.links.select("qid", F.col("s").alias("a"), F.col("t").alias("b")).unionByName(self.links.select("qid", F.col("t").alias("a"), F.col("s").alias("b"))).distinct()


def question_graphs(selected: DataFrame, mentions: DataFrame, relations: DataFrame) -> QuestionGraphs:
    """The graphs of the records of selected (qid, id) chunks. Ends that the selection doesn't mention and loops drop out, as in the whole graph."""
    own = selected.select("qid", F.col("id").alias("chunk_id")).distinct()
    nodes = G.saved(own.join(mentions.select("chunk_id", norm(F.col("name")).alias("key")), "chunk_id").where("key <> ''").select("qid", "key", F.col("chunk_id").alias("chunk")).distinct())
    keys = nodes.select("qid", "key").distinct()
    links = own.join(relations.select("chunk_id", norm(F.col("source")).alias("s"), norm(F.col("target")).alias("t")), "chunk_id").where("s <> t").select("qid", "s", "t", F.col("chunk_id").alias("chunk")).distinct()
    for end in ("s", "t"):
        links = links.join(keys.withColumnRenamed("key", end), ["qid", end], "left_semi")
    return QuestionGraphs(nodes, G.saved(links))


#: Chunks of a title that a row of packed records holds at most, about; what marks a link's number and the bits of its ends.
PACK, LINK, BITS = 1024, 1 << 62, 31


def packed(mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, values: the nodes and links of each chunk as numbers, each once; key, code of the nodes). Ends that no mention names and loops drop out."""
    met = mentions.select("name").distinct().withColumn("node", F.lit(True))
    spelt = met.unionByName(relations.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("node", F.lit(False))).groupBy("name").agg(F.max("node").alias("node"))
    spelt = G.saved(spelt.select("name", "node", norm(F.col("name")).alias("key")).where("key <> ''"))
    keys = spelt.where("node").select("key").distinct()
    keys = G.saved(G.numbered(keys, ["key"], "code").select("key", "code"))
    codes = G.saved(spelt.join(keys, "key").select("name", "code"))
    of = mentions.select(F.col("chunk_id").alias("id"), "name").join(codes, "name").select("id", F.col("code").alias("value"))
    ends = relations.select(F.col("chunk_id").alias("id"), "source", "target").join(codes.toDF("source", "s"), "source").join(codes.toDF("target", "t"), "target").where("s <> t")
    links = ends.select("id", F.expr(f"{LINK}L + shiftleft(s, {BITS}) + t").alias("value"))
    return of.unionByName(links).groupBy("id").agg(F.collect_set("value").alias("values")), keys


def _nearest(s: np.ndarray, t: np.ndarray, start: np.ndarray, n: int, hops: int) -> np.ndarray:
    """The distance of each of n nodes from the start nodes by links s, t either way; hops + 1 beyond the hops."""
    far = np.full(n, hops + 1)
    far[start] = 0
    for d in range(1, hops + 1):
        step = np.concatenate((t[far[s] == d - 1], s[far[t] == d - 1]))
        far[step] = np.minimum(far[step], d)
    return far


def _question(rows: pa.Table, k: int, hops: int, weight: float) -> dict:
    """What one question's packed rows give: counters, the chunks with the best support and the least of the others."""
    cells = rows["cells"].combine_chunks().flatten()
    ids, own = np.unique(np.array(cells.field("id").to_pylist(), object), return_index=True)
    lists = cells.field("values").take(pa.array(own))
    length = np.diff(lists.offsets.to_numpy())
    value, chunk = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(ids)), length)
    link = value >= LINK
    keys, node = np.unique(value[~link], return_inverse=True)
    at = chunk[~link]
    pair, place = value[link] - LINK, chunk[link]
    s, t = pair >> BITS, pair & ((1 << BITS) - 1)
    held = np.isin(s, keys) & np.isin(t, keys)
    pair, place, s, t = pair[held], place[held], np.searchsorted(keys, s[held]), np.searchsorted(keys, t[held])
    start = np.flatnonzero(np.isin(keys, np.array(rows["named"][0].as_py() or [], np.int64)))
    far = _nearest(s, t, start, len(keys), hops)
    score, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
    for spot, d, w in ((at, far[node], 1.0), (place[(far[s] <= hops) & (far[t] <= hops)], np.minimum(far[s], far[t])[(far[s] <= hops) & (far[t] <= hops)], weight)):
        spot, d = spot[d <= hops], d[d <= hops]
        score += np.bincount(spot, w / (1 + d), len(ids))
        met[spot] = True
    score = np.round(score, 9)
    # the k best of each part, and the dense list's whole, which goes first among equal scores
    listed = np.isin(ids, np.array(rows["listed"][0].as_py() or [], object))
    place_of = np.lexsort((np.arange(len(ids)), -score, ~met))
    first = np.zeros(len(ids), bool)
    first[place_of[met[place_of]][:k]] = True
    first[np.flatnonzero(~met & ~listed)[:k]] = True
    out = np.flatnonzero(first | listed)
    best = [{"id": ids[i], "s": float(score[i]) if met[i] else None} for i in out]
    return {"n_selected": len(ids), "anchors": len(start), "graph_nodes": len(keys), "graph_edges": len(np.unique(pair)), "supported": int(met.sum()), "best": best}


def packed_rows(keys: DataFrame, records: DataFrame, found: DataFrame, seeds: DataFrame) -> DataFrame:
    """qid, cells (an array of id, values): the records of each question's titles, found (qid, full, base), and of its seeds. keys: title_keys(); chunks without records have no values."""
    none = F.array().cast("array<bigint>")
    cell = F.struct("id", F.coalesce("values", none).alias("values"))
    sizes = keys.groupBy("full", "base").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("parts"))
    titles = G.saved(G.numbered(sizes.join(found.select("full", "base").distinct(), ["full", "base"], "left_semi"), ["full", "base"], "title"))
    own = keys.join(titles, ["full", "base"]).select("id", "title", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    rows = own.join(records, "id", "left").groupBy("title", "part").agg(F.collect_list(cell).alias("cells"))
    asked = G.saved(found.join(titles, ["full", "base"]).select("qid", "title"))
    alone = seeds.select("qid", "id").join(records, "id", "left").select("qid", F.array(cell).alias("cells"))
    return asked.join(rows, "title").select("qid", "cells").unionByName(alone)


def ranked(dense: DataFrame, supported: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: supported chunks by support and dense rank, then the dense list, then the rest of the selection; a question without support keeps its dense list. score is 1 - place / number."""
    has = supported.select("qid").distinct().withColumn("has", F.lit(True))
    both = dense.select("qid", "id", F.col("rank").alias("dense_rank")).join(supported.select("qid", "id", F.col("score").alias("s")), ["qid", "id"], "full_outer")
    both = both.join(selected.select("qid", "id").distinct().withColumn("extra", F.lit(True)), ["qid", "id"], "full_outer").join(has, "qid", "left")
    part = F.when(F.col("s").isNotNull(), 0).when(F.col("dense_rank").isNotNull(), 1).otherwise(2)
    by = Window.partitionBy("qid").orderBy(part, F.desc_nulls_last("s"), F.coalesce("dense_rank", F.lit(10**6)), "id")
    out = both.where(F.col("dense_rank").isNotNull() | F.col("has")).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return out.select("qid", "id", F.round(1 - (F.col("rank") - 1) / n, 6).alias("score"), "rank")


def query_focused(questions: DataFrame, dense: DataFrame, titles: DataFrame, mentions: DataFrame, relations: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score, rank; counters of each question: n_selected, anchors, graph_nodes, graph_edges, supported)."""
    from skein.plans.retrieval import asked_titles, title_keys

    seeds = G.saved(dense.where(F.col("rank") <= SEEDS).select("qid", "id"))
    keys = title_keys(titles)
    found = G.saved(asked_titles(questions, keys, seed_names(seeds, mentions)))
    records, codes = packed(mentions, relations)
    rows = packed_rows(keys, G.saved(records), found, seeds)
    norms = questions.select("qid", norm(F.col("text")).alias("line"))
    long = codes.where(F.length("key") >= LEAST_ANCHOR)
    named = strings_in(norms, "qid", long.select(F.col("key").alias("phrase"))).join(norms, "qid").where(whole_phrase(F.col("phrase"), F.col("line")))
    named = named.join(codes, F.col("phrase") == F.col("key")).groupBy("qid").agg(F.collect_list("code").alias("named"))
    listed = dense.groupBy("qid").agg(F.collect_list("id").alias("listed"))
    marked = questions.select("qid").join(named, "qid", "left").join(listed, "qid", "left")
    qkind, kind = questions.schema["qid"].dataType.simpleString(), titles.schema["id"].dataType.simpleString()
    qtype = to_arrow_type(questions.schema["qid"].dataType)

    def run(group: pa.Table) -> pa.Table:
        one = _question(group, k, HOPS, EDGE_WEIGHT)
        return pa.Table.from_pylist([{"qid": group["qid"][0].as_py(), **one}], schema)

    cell = pa.list_(pa.struct([("id", to_arrow_type(titles.schema["id"].dataType)), ("s", pa.float64())]))
    schema = pa.schema([("qid", qtype), *((c, pa.int64()) for c in COUNTERS), ("best", cell)])
    got = rows.join(G.saved(marked), "qid").groupBy("qid").applyInArrow(run, f"qid {qkind}, {', '.join(f'{c} bigint' for c in COUNTERS)}, best array<struct<id:{kind},s:double>>")
    got = G.saved(got)
    best = got.select("qid", F.inline("best"))
    counts = questions.select("qid").join(got.select("qid", *COUNTERS), "qid", "left").na.fill(0)
    return ranked(dense, best.where("s is not null").select("qid", "id", F.col("s").alias("score")), best.select("qid", "id"), k), counts


RECORDS = "content_sha256 string, status string, entities array<struct<name:string>>, relationships array<struct<source:string,target:string>>"


def on_demand(questions: DataFrame, dense: DataFrame, paragraphs: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame], k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """query_focused() where records come from a cache and are extracted where it lacks them: (ranked list, counters, the grown cache).

    paragraphs: id, title, text. cache and what extract() makes of (content_sha256, text)
    rows have the columns RECORDS; status is 'ok', 'failed_model' or 'failed_infra', and
    records that aren't 'ok' go into no graph. A content is extracted once in a batch and charged to
    the first question, by qid, that asks for it; to later ones it is a hit. Counters add lookups,
    hits_ok, hits_failed, misses, extracted_ok, extracted_failed_model,
    extracted_failed_infra, valid_records and failed_or_missing.
    """
    from skein.plans.retrieval import asked_titles, title_keys

    text = G.saved(paragraphs.select("id", "title", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256")))
    known = cache.select("content_sha256", "status", "entities", "relationships").dropDuplicates(["content_sha256"])

    def filled(known: DataFrame, asked: DataFrame) -> DataFrame:
        missing = text.join(asked.select("content_sha256").distinct(), "content_sha256", "left_semi").groupBy("content_sha256").agg(F.first("text").alias("text")).join(known, "content_sha256", "left_anti")
        return G.saved(known.unionByName(extract(missing).select(known.columns)))

    def records(grown: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = grown.where("status = 'ok'").join(asked.select("content_sha256").distinct(), "content_sha256", "left_semi")
        ok = text.join(wanted, "content_sha256").select(F.col("id").alias("chunk_id"), "entities", "relationships")
        return ok.select("chunk_id", F.inline("entities")), ok.select("chunk_id", F.inline("relationships"))

    keys = title_keys(text)
    held = keys.join(text.select("id", "content_sha256"), "id")
    seeds = G.saved(dense.where(F.col("rank") <= SEEDS).select("qid", "id").join(held, "id"))
    found = G.saved(asked_titles(questions, keys, seed_names(seeds, records(filled(known, seeds), seeds)[0])))
    # what a question selects: a row for each title and content with the number of chunks and the least, and seeds of other titles
    alike = held.groupBy("full", "base", "content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    lone = seeds.join(found, ["qid", "full", "base"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    asks = found.join(alike, ["full", "base"]).select("qid", "content_sha256", "n", "id").unionByName(lone.select("qid", "content_sha256", "n", "id"))
    asks = G.saved(asks.groupBy("qid", "content_sha256").agg(F.sum("n").alias("n"), F.min("id").alias("id")))
    grown = filled(known, asks)
    result, counts = query_focused(questions, dense, text.select("id", "title"), *records(grown, asks), k)
    was = known.select("content_sha256", F.col("status").alias("before"))
    asks = asks.join(grown.select("content_sha256", "status"), "content_sha256").join(was, "content_sha256", "left")
    first = asks.groupBy("content_sha256").agg(F.min("qid").alias("payer"))
    asks = asks.join(first, "content_sha256").withColumn("paid", (F.col("before").isNull() & (F.col("qid") == F.col("payer"))).cast("long"))
    ok = F.col("status") == "ok"

    def total(value: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0))

    cost = asks.groupBy("qid").agg(
        F.sum("n").alias("lookups"), total(F.col("n") - F.col("paid"), ok).alias("hits_ok"), total(F.col("n") - F.col("paid"), ~ok).alias("hits_failed"), F.sum("paid").alias("misses"),
        *(total(F.col("paid"), F.col("status") == s).alias(f"extracted_{s}") for s in ("ok", "failed_model", "failed_infra")),
        total(F.col("n"), ok).alias("valid_records"), total(F.col("n"), ~ok).alias("failed_or_missing"),
    )
    return result, counts.join(cost, "qid", "left").na.fill(0), grown


def selections(questions: DataFrame, dense: DataFrame, titles: DataFrame, mentions: DataFrame, sizes: tuple[int, ...] = (5, 10)) -> DataFrame:
    """selection, qid, id: B_k is the head of the dense list, C_k adds what titles and entities name.

    The simulation's own rule: a title up to its first " (" counts if it has four characters or more
    and stands anywhere in the question, and names of any length count that are a title or its part before " (".
    """
    keyed = titles.select("id", norm(F.col("title")).alias("full"), norm(F.split_part("title", F.lit(" ("), F.lit(1))).alias("phrase"))
    long = keyed.where(F.length("phrase") >= 4)
    by_title = strings_in(questions.select("qid", norm(F.col("text")).alias("line")), "qid", long.select("phrase")).join(long, "phrase").select("qid", "id")
    out = None
    for k in sizes:
        head = dense.where(F.col("rank") <= k).select("qid", "id")
        named = seed_names(head, mentions).select("qid", norm(F.col("name")).alias("n")).distinct()
        by_name = named.join(keyed, F.col("n") == F.col("full")).select("qid", "id").unionByName(named.join(keyed, F.col("n") == F.col("phrase")).select("qid", "id"))
        wide = head.unionByName(by_title).unionByName(by_name).distinct()
        both = head.select(F.lit(f"B_{k}").alias("selection"), "qid", "id").unionByName(wide.select(F.lit(f"C_{k}").alias("selection"), "qid", "id"))
        out = both if out is None else out.unionByName(both)
    return out


def simulate(questions: DataFrame, gold: DataFrame, dense: DataFrame, titles: DataFrame, mentions: DataFrame, relations: DataFrame, sizes: tuple[int, ...] = (5, 10), hops: int = 3) -> DataFrame:
    """What a graph from selected chunks keeps of the whole one, by selection and question type (type null: all).

    questions: qid, text, type. gold: qid, id. Columns: questions, chunks (mean), unique_chunks,
    corpus_share, entities and relationships (means), coverage (mean), all_gold, connected
    (questions whose gold chunks are all selected and the first two of them hold one node or nodes within `hops`). A_full selects the whole corpus; its
    graph is one for all questions and its figures need no row for each pair of question and chunk.
    """
    ents, rels = (df.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("chunk_id", "id") for df in (mentions, relations))
    chosen = G.saved(selections(questions, dense, titles, mentions, sizes).distinct())
    total = titles.count()
    wanted = gold.select("qid", "id").distinct()
    # a question has few gold chunks; the first two by id are those to connect
    size = wanted.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("qid", F.size("ids").cast("long").alias("gold"), F.get("ids", 0).alias("g1"), F.get("ids", 1).alias("g2"))

    def graph_key(a: str) -> Column:
        return F.to_json(F.struct("selection", a))

    # graphs of the selections, and the whole corpus's as one more
    parts = chosen.select(graph_key("qid").alias("qid"), "id").unionByName(titles.select(F.lit("A_full").alias("qid"), "id"))
    graphs = question_graphs(parts, mentions, relations)
    near = graphs.near()
    whole = questions.select(F.lit("A_full").alias("selection"), "qid")
    asked = chosen.select("selection", "qid").distinct().unionByName(whole).join(size, "qid")
    asked = G.saved(asked.withColumn("graph", F.when(F.col("selection") == "A_full", "A_full").otherwise(graph_key("qid"))))
    # both gold chunks must be selected; then two ends grow towards each other
    held = chosen.join(wanted, ["qid", "id"]).groupBy("selection", "qid").agg(F.count(F.lit(1)).alias("held"))
    held = held.unionByName(whole.join(wanted.join(titles.select("id"), "id").groupBy("qid").agg(F.count(F.lit(1)).alias("held")), "qid"))
    named = graphs.nodes.toDF("graph", "key", "chunk").distinct()

    def side(gold_col: str) -> DataFrame:
        return asked.where("gold >= 2").select("selection", "qid", "graph", F.col(gold_col).alias("chunk")).join(named, ["graph", "chunk"]).select("selection", "qid", "graph", "key").distinct()

    a, b = side("g1"), side("g2")
    step = near.toDF("graph", "key", "next")
    for turn in range(hops):
        grown = a if turn % 2 == 0 else b
        more = G.saved(grown.unionByName(grown.join(step, ["graph", "key"]).select("selection", "qid", "graph", F.col("next").alias("key"))).distinct())
        a, b = (more, b) if turn % 2 == 0 else (a, more)
    linked = a.join(b, ["selection", "qid", "graph", "key"], "left_semi").select("selection", "qid").distinct().withColumn("linked", F.lit(True))
    per = chosen.join(ents.withColumnRenamed("n", "e"), "id", "left").join(rels.withColumnRenamed("n", "r"), "id", "left").groupBy("selection", "qid").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    everything = ents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("e")).join(rels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r")))  # single rows
    per = per.unionByName(whole.join(F.broadcast(everything)).withColumn("chunks", F.lit(total).cast("long")).select(per.columns))
    rows = asked.select("selection", "qid", "gold").join(per, ["selection", "qid"]).join(held, ["selection", "qid"], "left").join(linked, ["selection", "qid"], "left").join(questions.select("qid", "type"), "qid")
    held_n = F.coalesce("held", F.lit(0))
    rows = rows.withColumn("full", held_n == F.col("gold")).withColumn("cover", held_n / F.col("gold")).withColumn("ok", F.col("full") & F.coalesce("linked", F.lit(False)))
    figures = [F.count(F.lit(1)).alias("questions"), F.round(F.avg("chunks"), 2).alias("chunks"), F.round(F.avg("e"), 1).alias("entities"), F.round(F.avg("r"), 1).alias("relationships"), F.round(F.avg("cover"), 4).alias("coverage"), F.count_if("full").alias("all_gold"), F.count_if("ok").alias("connected")]
    kinds = [c for c in ("bridge", "comparison")]
    by_type = rows.where(F.col("type").isin(*kinds)).groupBy("selection", "type").agg(*figures)
    out = rows.groupBy("selection").agg(*figures).withColumn("type", F.lit(None).cast("string")).unionByName(by_type)
    unique = chosen.join(asked.select("selection", "qid"), ["selection", "qid"], "left_semi").select("selection", "id").distinct().groupBy("selection").agg(F.count(F.lit(1)).alias("unique_chunks"))
    out = out.join(F.broadcast(unique), "selection", "left").withColumn("unique_chunks", F.coalesce("unique_chunks", F.lit(total).cast("long")))  # a row for each selection
    return out.withColumn("corpus_share", F.round(F.col("unique_chunks") / total, 3))
