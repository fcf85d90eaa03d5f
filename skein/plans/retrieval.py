"""Retrieval plans over an entity graph and three collections, for batches of questions.

Collections are items (id, text, vec): chunks, entities (id: node name) and
relationships (id: 'src|dst'). Every plan gives qid, id (a chunk), score, rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import base_title, norm
from skein.operators import graph as G
from skein.operators import search as S

#: Names that are types, not entities.
TYPE_LABELS = ("person", "organization", "location", "event", "technology", "other", "entity", "node", "edge", "concept", "relationship", "type", "class", "object", "thing")


#: Chunks to a stored file, which a task takes, where each meets many questions.
ROWS = 20_000


def _pool(k: int) -> int:
    return max(3 * k, 20)


def _weights(hits: DataFrame) -> DataFrame:
    """Hits with w, the score over the question's best."""
    best = F.max("score").over(Window.partitionBy("qid"))
    return hits.withColumn("w", F.when(best > 0, F.col("score") / best).otherwise(0.0))


def _ranked(parts: list[DataFrame]) -> DataFrame:
    """(qid, chunk, w) summed: qid, id, score, rank."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    total = both.groupBy("qid", F.col("chunk").alias("id")).agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return total.withColumn("rank", F.row_number().over(w).cast("long"))


#: (node_places(), edge_places()) that plans over a slim graph read.
Places = tuple[DataFrame, DataFrame] | tuple[None, None]


def _node(name: str) -> Column:
    return F.concat(F.lit("n:"), name)


def _edge(src: str, dst: str) -> Column:
    return F.concat(F.lit("e:"), src, F.lit("|"), dst)


def _spread(terms: DataFrame, held: DataFrame, k: int | None) -> DataFrame:
    """The chunks of terms (qid, term, w), by the sum of the products of w and of what each term has in a chunk, held (term, chunk, part): all of them, or the k best of each question.

    A hot term has very many chunks and stands in very many questions. For the k best no pair of
    them is made a row: chunks are scored where they lie, against the questions' terms.
    """
    held = held.groupBy("term", "chunk").agg(F.sum("part").alias("part"))
    if k is None:
        return _ranked([terms.join(held, "term").select("qid", "chunk", (F.col("w") * F.col("part")).alias("w"))])
    terms = G.saved(terms.groupBy("qid", "term").agg(F.sum("w").alias("w")))
    asked = terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
    held = held.join(terms.select("term").distinct(), "term", "left_semi")
    chunks = held.groupBy(F.col("chunk").alias("id")).agg(F.collect_list(F.struct("term", F.col("part").alias("w"))).alias("terms"))
    return S.weighted_top(G.saved(chunks), asked, k)


def local(hits: DataFrame, nodes: DataFrame, edges: DataFrame, optimised: bool = False, places: Places = (None, None), k: int | None = None) -> DataFrame:
    """Entity hits give their weight to the chunks that name them, and a part to those of each edge at them; optimised: less at neighbours of high degree. k: the k best of each question alone."""
    hits = G.saved(hits)
    met = G.saved(hits.select(F.col("id").alias("name")).distinct())  # only these nodes' places and edges are read
    seeds = _weights(hits).select("qid", _node("id").alias("term"), "w")
    own = G.node_chunk_rows(nodes.join(met, "name", "left_semi"), places[0]).select(_node("name").alias("term"), "chunk", F.lit(1.0).alias("part"))
    ways = [F.struct(F.col(a).alias("name"), F.col(b).alias("other"), F.lit(n).alias("way")) for n, (a, b) in enumerate((("src", "dst"), ("dst", "src")))]
    ends = G.edge_chunk_rows(edges, places[1], True).select("chunk", F.inline(F.array(*ways))).join(met, "name", "left_semi").distinct()
    part = F.lit(0.5)
    if optimised:
        ends = ends.join(G.degree(nodes, edges).select(F.col("name").alias("other"), "degree"), "other")
        part = F.lit(0.35) / F.log2(F.lit(2.0) + F.col("degree"))
    return _spread(seeds, own.unionByName(ends.select(_node("name").alias("term"), "chunk", part.alias("part"))), k)


def global_(hits: DataFrame, nodes: DataFrame, edges: DataFrame, optimised: bool = False, store: DataFrame | None = None, places: Places = (None, None), k: int | None = None) -> DataFrame:
    """Relationship hits give their weight to their chunks, and a part to the chunks of both ends. A hit is a record of the store (rel_id, source_entity, target_entity, chunk_ids); where that lacks it, an edge of the graph by its id 'src|dst'. k: the k best of each question alone."""
    hits = G.saved(hits)
    seeds = _weights(hits).withColumn("src", F.split_part("id", F.lit("|"), F.lit(1))).withColumn("dst", F.split_part("id", F.lit("|"), F.lit(2)))
    whole = F.lit(1.0).alias("part")
    own = _edge("src", "dst")
    if store is not None:
        record = F.concat(F.lit("s:"), "id")
        store = G.saved(store.join(hits.select(F.col("id").alias("rel_id")).distinct(), "rel_id", "left_semi"))
        seeds = seeds.join(store.select(F.col("rel_id").alias("id"), "source_entity", "target_entity", "chunk_ids"), "id", "left")
        seeds = seeds.withColumn("src", F.coalesce("source_entity", "src")).withColumn("dst", F.coalesce("target_entity", "dst"))
        own = F.when(F.col("chunk_ids").isNotNull(), record).otherwise(own)
    met = G.saved(seeds.select("src", "dst").distinct())  # only these edges' places and those of their ends are read
    held = G.edge_chunk_rows(edges, places[1], True).join(met, ["src", "dst"], "left_semi").distinct().select(_edge("src", "dst").alias("term"), "chunk", whole)
    if store is not None:
        held = held.unionByName(store.select(F.col("rel_id").alias("id"), F.explode(F.array_distinct("chunk_ids")).alias("chunk")).select(record.alias("term"), "chunk", whole))
    ends = seeds.select("qid", "w", F.explode(F.array("src", "dst")).alias("name"))
    near = nodes.join(G.saved(met.select(F.explode(F.array("src", "dst")).alias("name")).distinct()), "name", "left_semi")
    part = F.lit(0.3)
    if optimised:
        ends = ends.join(G.degree(nodes, edges), "name")
        part = F.lit(0.2) / F.log2(F.lit(2.0) + F.col("degree"))
    terms = seeds.select("qid", own.alias("term"), "w").unionByName(ends.select("qid", _node("name").alias("term"), (F.col("w") * part).alias("w")))
    return _spread(terms, held.unionByName(G.node_chunk_rows(near, places[0]).select(_node("name").alias("term"), "chunk", whole)), k)


def cut(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def hybrid(local_list: DataFrame, global_list: DataFrame, k: int, optimised: bool = False) -> DataFrame:
    """Fusion of the two graph lists; optimised: the global one counts 0.6."""
    return S.top(S.rrf([cut(local_list, _pool(k)), cut(global_list, _pool(k))], [1.0, 0.6 if optimised else 1.0]), k)


def mix(dense: DataFrame, local_list: DataFrame, global_list: DataFrame, k: int) -> DataFrame:
    """Round robin of vector, local and global lists; score 1 - i / n."""
    order = S.round_robin([dense, cut(local_list, _pool(k)), cut(global_list, _pool(k))])
    return _places(order, k)


def _places(order: DataFrame, k: int) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    out = order.withColumn("score", F.round(1 - (F.col("place") - 1) / n, 6)).withColumnRenamed("place", "rank")
    return out.where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def graph_slots(k: int) -> int:
    """A fifth of k, halves to even, at least one."""
    return max(1, round(k * 0.2))


def mix_optimised(dense: DataFrame, local_list: DataFrame, global_list: DataFrame, k: int) -> DataFrame:
    """The head of the dense list, then the best graph finds that the head lacks, then the rest of the dense list."""
    g = graph_slots(k)
    fused = S.rrf([cut(local_list, _pool(k)), cut(global_list, _pool(k))], [1.0, 0.6])
    return _places(spliced(dense, fused, k - g, g), k)


def spliced(dense: DataFrame, fused: DataFrame, head: int, slots: int) -> DataFrame:
    """qid, id, place: `head` of dense, `slots` of fused (qid, id, score) that aren't among them, and the others of dense."""
    front = dense.where(F.col("rank") <= head).select("qid", "id", F.lit(0).alias("part"), "rank")
    fill = S.top(fused.join(front.select("qid", "id"), ["qid", "id"], "left_anti"), slots).select("qid", "id", F.lit(1).alias("part"), "rank")
    tail = dense.where(F.col("rank") > head).join(fill.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(2).alias("part"), "rank")
    both = front.unionByName(fill).unionByName(tail)
    return both.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("part", "rank")).cast("long").alias("place"))


def candidates(hits: DataFrame, nodes: DataFrame, edges: DataFrame, ranks: DataFrame, hops: int = 2, weight: float = 0.85, most: int = 20) -> DataFrame:
    """qid, name, score, rank of the structural plan: the best similarity of the entries that reach a node, mixed with its PageRank. The cut comes before type labels drop, so fewer may be left."""
    entries = hits.join(nodes.select(F.col("name").alias("id")), "id", "left_semi").where(~norm(F.col("id")).isin(*TYPE_LABELS))
    met, keys = G.reach(nodes, edges, entries.select(F.col("id").alias("seed")), hops)
    masks = met.groupBy("name", "block").agg(F.bit_or("mask").alias("mask")).groupBy("name").agg(F.collect_list(F.struct("block", "mask")).alias("masks"))
    best = ranks.agg(F.max("rank").alias("pr_max"))
    value = F.when(F.col("pr_max") > 0, F.col("rank") / F.col("pr_max")).otherwise(0.0)
    items = masks.join(ranks.select("name", "rank"), "name").join(F.broadcast(best)).select(F.col("name").alias("id"), "masks", value.alias("value"))  # best is one row
    asked = entries.join(keys, F.col("id") == F.col("seed")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("block", F.col("mask").alias("bit"), F.col("score").alias("s")))).alias("entries"))
    found = S.reached_top(G.saved(items), asked, most, weight).withColumnRenamed("id", "name")
    return found.where(~norm(F.col("name")).isin(*TYPE_LABELS))


def candidate_documents(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, doc_id): the candidates' documents."""
    return found.select("qid", "name").join(nodes.select("name", F.explode("source_docs").alias("doc_id")), "name").select("qid", "doc_id").distinct()


def candidate_scope(found: DataFrame, nodes: DataFrame, chunks: DataFrame, scope: str = "docs", places: Places = (None, None)) -> DataFrame:
    """(qid, id): the chunks among which the structural plan searches: of the candidates' documents ('docs'), or those that name them. chunks: id, doc_id."""
    if scope == "docs":
        # a document's chunks meet many questions, so few bytes give very many rows: chunks are read by several tasks
        asked = G.saved(candidate_documents(found, nodes))
        return G.saved(chunks.select("id", "doc_id"), ROWS).join(asked, "doc_id").select("qid", "id")
    if scope not in ("candidates", "verbalized"):
        raise ValueError(f"unknown scope {scope!r}")
    return found.select("qid", "name").join(G.node_chunk_rows(nodes, places[0]), "name").select("qid", F.col("chunk").alias("id")).distinct()


def named_scope(found: DataFrame, nodes: DataFrame, chunks: DataFrame, scope: str, places: Places = (None, None)) -> tuple[DataFrame, DataFrame]:
    """((qid, group), (id, group: an array)): candidate_scope() of 'candidates' or 'verbalized' by the names that chunks hold, and by documents for questions whose candidates name no chunk. A question has a row for each candidate, not for each chunk of it."""
    if scope not in ("candidates", "verbalized"):
        raise ValueError(f"unknown scope {scope!r}")
    met = G.saved(found.select("name").distinct())
    rows = G.saved(G.node_chunk_rows(nodes.join(met, "name", "left_semi"), places[0]))
    by_name = found.join(rows.select("name").distinct(), "name", "left_semi").select("qid", F.concat(F.lit("n:"), "name").alias("group"))
    groups = rows.select(F.col("chunk").alias("id"), F.concat(F.lit("n:"), "name").alias("group"))
    lone = G.saved(found.join(by_name.select("qid").distinct(), "qid", "left_anti"))
    if not lone.isEmpty():
        docs = G.saved(candidate_documents(lone, nodes))
        by_name = by_name.unionByName(docs.select("qid", F.concat(F.lit("d:"), "doc_id").alias("group")))
        groups = groups.unionByName(chunks.select("id", "doc_id").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("id", F.concat(F.lit("d:"), "doc_id").alias("group")))
    return by_name, G.saved(groups.groupBy("id").agg(F.collect_set("group").alias("group")))


def verbalise(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, text: a line 'name (TYPE): first description' for each candidate in rank order."""
    line = F.concat("name", F.lit(" ("), "type", F.lit("): "), "description")
    rows = found.select("qid", "name", "rank").join(nodes.select("name", "type", "description"), "name").select("qid", F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def title_keys(titles: DataFrame) -> DataFrame:
    """id, full, base of titles (id, title): the keys of a title whole and without a bracketed ending."""
    return titles.select("id", norm(F.col("title")).alias("full"), norm(base_title(F.col("title"))).alias("base"))


def asked_titles(questions: DataFrame, keys: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(qid, full, base): the titles (full, base) that the question or one of its names calls up, by the rule of expansion(). However many chunks have a title, it meets the questions once."""
    from skein.functions.text import terms
    from skein.operators.phrases import phrases_in
    from skein.plans.query_focused import whole_phrase

    kinds = G.saved(keys.select("full", "base").distinct())
    long = kinds.where(F.length("base") >= least).withColumn("phrase", F.array_join(terms(F.col("base")), " "))
    asked = questions.select("qid", terms(F.col("text")).alias("w"), norm(F.col("text")).alias("q"))
    bases = long.select("phrase", "base").distinct()
    near = phrases_in(asked, "qid", bases.select("phrase")).join(bases, "phrase").join(asked.select("qid", "q"), "qid")
    by_title = near.where(whole_phrase(F.col("base"), F.col("q"))).select("qid", "base").join(kinds, "base").select("qid", "full", "base")
    named = names.select("qid", norm(F.col("name")).alias("n")).where("n <> ''").distinct()
    by_name = named.join(kinds, F.col("n") == F.col("full")).select("qid", "full", "base").unionByName(named.join(long, F.col("n") == F.col("base")).select("qid", "full", "base"))
    return by_title.unionByName(by_name).distinct()


def expansion(questions: DataFrame, titles: DataFrame, seeds: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(qid, id): seed chunks, chunks whose base title stands in the question as a whole phrase, and chunks whose title one of the names is. titles: id, title; seeds: qid, id; names: qid, name, of the seeds' entities. Titles and names under `least` characters count as full titles alone.

    Titles of any length meet questions by an automaton over all of them, not by pairs, and the phrase decides.
    """
    keys = title_keys(titles)
    found = G.saved(asked_titles(questions, keys, names, least))
    return seeds.select("qid", "id").unionByName(found.join(keys, ["full", "base"]).select("qid", "id")).distinct()


def structural(hits: DataFrame, nodes: DataFrame, edges: DataFrame, ranks: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 6, scope: str = "docs", embed: Callable[[DataFrame], DataFrame] | None = None, places: Places = (None, None)) -> DataFrame:
    """qid, id, score, rank of the structural plan: candidates, the chunks that they leave in scope, and a hybrid search among these.

    chunks: id, doc_id, text, vec; questions: qid, text, vec. With the scope 'verbalized' the
    candidates' lines, embedded by embed() (qid, text: with vec), are the dense side of the search. Where the
    candidates name no chunk, those of their documents are searched.
    """
    found = G.saved(candidates(hits, nodes, edges, ranks))
    if scope == "docs":
        within = candidate_documents(found, nodes)  # (qid, doc_id): chunks are asked for their document, so no pair of a question and a chunk is made
        members = None
    else:
        within, members = named_scope(found, nodes, chunks, scope, places)
    asked = questions
    if scope == "verbalized":
        if embed is None:
            raise ValueError("the scope 'verbalized' needs an embedder")
        asked = questions.drop("vec").join(embed(verbalise(found, nodes)).select("qid", "vec"), "qid")
    return S.hybrid(chunks, asked, k, scope=G.saved(within), members=members)


def materialise(ranked: DataFrame, primary: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """The k best with the chunks' texts, from the fallback store where the primary lacks them; ids in neither drop after the cut, so fewer than k may be left."""
    best = cut(ranked, k)
    a = primary.select("id", F.col("text").alias("t1"))
    b = fallback.select("id", F.col("text").alias("t2"))
    out = best.join(a, "id", "left").join(b, "id", "left").withColumn("text", F.coalesce("t1", "t2"))
    return out.where(F.col("text").isNotNull()).drop("t1", "t2")


@dataclass
class Corpus:
    """What the plans search: collections (id, text, vec; chunks with doc_id and title too), the graph, its PageRank and the records behind it."""

    chunks: DataFrame
    entities: DataFrame
    relationships: DataFrame
    nodes: DataFrame
    edges: DataFrame
    ranks: DataFrame
    mentions: DataFrame
    relations: DataFrame
    embed: Callable[[DataFrame], DataFrame] | None = None
    places: Places = (None, None)

    def lists(self, questions: DataFrame, k: int, optimised: bool = False) -> tuple[DataFrame, DataFrame]:
        """The local and the global list."""
        return tuple(G.saved(f(S.hybrid(items, questions, _pool(k)), self.nodes, self.edges, optimised, places=self.places, k=_pool(k))) for f, items in ((local, self.entities), (global_, self.relationships)))

    def flat(self, questions: DataFrame, k: int) -> DataFrame:
        return S.hybrid(self.chunks, questions, k)


#: Fixed value: entities at which the structural plan enters the graph.
ENTRIES = 8


def _structural(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return structural(S.hybrid(c.entities, q, ENTRIES), c.nodes, c.edges, c.ranks, c.chunks, q, k, embed=c.embed, places=c.places)


def _query_focused(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    from skein.plans.query_focused import query_focused

    return query_focused(q, G.saved(c.flat(q, max(k, ENTRIES))), c.chunks.select("id", "title"), c.mentions, c.relations, k)[0]


Plan = Callable[[Corpus, DataFrame, int], DataFrame]
#: Modes of the service and the plans behind them.
MODES = {"naive": "flat", "bypass": "structural", "local": "local", "global": "global", "hybrid": "hybrid", "mix": "mix", "mix_opt": "mix_optimised"}
PLANS: dict[str, Plan] = {
    "flat": Corpus.flat,
    "structural": _structural,
    "local": lambda c, q, k: cut(c.lists(q, k)[0], k),
    "global": lambda c, q, k: cut(c.lists(q, k)[1], k),
    "hybrid": lambda c, q, k: hybrid(*c.lists(q, k), k),
    "hybrid_optimised": lambda c, q, k: hybrid(*c.lists(q, k, True), k, True),
    "mix": lambda c, q, k: mix(S.cosine_top(c.chunks, q, k), *c.lists(q, k), k),
    "mix_optimised": lambda c, q, k: mix_optimised(S.cosine_top(c.chunks, q, k), *c.lists(q, k, True), k),
    "query_focused": _query_focused,
}


def plan(name: str) -> Plan:
    """The plan of a name or mode: a function of (corpus, questions, k) that gives qid, id (a chunk), score, rank."""
    key = MODES.get(name, name)
    if key not in PLANS:
        raise ValueError(f"unknown plan {name!r}; there are {', '.join(sorted(PLANS))}")
    return PLANS[key]


def plans() -> list[dict[str, str]]:
    """Name and modes of each plan."""
    return [{"name": p, "modes": ", ".join(m for m, x in MODES.items() if x == p)} for p in PLANS]
