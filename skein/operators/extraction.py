"""Extraction records: recovery, validation, merging and audits.

Mentions are rows of (chunk_id, name, type, ...), relationships of (chunk_id,
source, target, type, ...), both with an explicit order (record_no, pos).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import json_object, norm, sentence_with, verbatim
from skein.operators import graph as G

ENTITY = "struct<name:string,type:string,description:string,source_sentence:string,stub:boolean>"
RELATION = "struct<source:string,target:string,type:string,description:string,source_sentence:string>"
PAYLOAD = f"struct<entities:array<{ENTITY}>,relationships:array<{RELATION}>>"
RECORD = f"chunk_id string, doc_id string, chunk_index int, text string, title string, entities array<{ENTITY}>, relationships array<{RELATION}>, _parse_error string, _corrupt_record string"
#: Words of the prompt's examples that stand for nothing in a record, marks of these that make any text of a record worthless, and a text that is one mark.
PLACEHOLDERS = ("entity_name", "entity_type", "entity_description", "source_entity", "target_entity", "relationship_keywords", "relationship_description")
PLACEHOLDER_MARKS = ("<entity_name>", "<source_entity>", "<target_entity>", "<relationship_description>", "<relationship_keywords>")
PLACEHOLDER_FORM = r"^\s*<[^>]+>\s*$"


def parse_answer(df: DataFrame, raw_col: str) -> DataFrame:
    """entities and relationships of a model's raw answers; _parse_error where no JSON object can be recovered."""
    body = json_object(F.col(raw_col))
    out = df.withColumn("_body", body).withColumn("_payload", F.from_json("_body", PAYLOAD))
    entities, relations = normalised(F.col("_payload.entities"), F.col("_payload.relationships"))
    return out.withColumn("entities", entities).withColumn("relationships", relations).withColumn("_parse_error", F.when(F.col("_body").isNull(), "no JSON object")).drop("_body", "_payload")


class Extractor(Protocol):
    """A model: chunks (with text) to the same rows with `raw`, its answers, under a frequency penalty or its own setting."""

    def __call__(self, chunks: DataFrame, penalty: float | None) -> DataFrame: ...


#: Penalties under which a chunk without a usable answer is asked again, one after the other.
LADDER = (0.5, 1.0)


def extract(chunks: DataFrame, model: Extractor, penalties: tuple[float, ...] = LADDER, current: float | None = None, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """chunks with entities, relationships, _parse_error, attempts and penalty (that of the last answer). Chunks whose answer can't be read go up the ladder; a rung equal to the model's current penalty is skipped. save() stores a round's rows, so that no answer is asked for twice."""
    save = save or G.saved
    out, rest = None, chunks
    rungs = [None, *(p for p in penalties if p != current)]
    for n, p in enumerate(rungs):
        asked = model(rest, p).withColumn("attempts", F.lit(n + 1)).withColumn("penalty", F.lit(p).cast("double"))
        read = save(parse_answer(asked, "raw").drop("raw"))
        bad = F.col("_parse_error").isNotNull()
        last = n + 1 == len(rungs)
        done = read if last else read.where(~bad)
        out = done if out is None else out.unionByName(done)
        rest = read.where(bad).select(chunks.columns)
        if last or not rest.limit(1).count():
            return out
    return out


def normalised(entities: Column, relations: Column) -> tuple[Column, Column]:
    """Trimmed records: types in upper case with defaults OTHER and RELATED_TO, rows without name or endpoint gone."""

    def clean(x: Column, field: str) -> Column:
        return F.trim(F.coalesce(x[field], F.lit("")))

    def typed(x: Column, default: str) -> Column:
        kind = F.upper(clean(x, "type"))
        return F.when(kind == "", default).otherwise(kind)

    e = F.transform(F.coalesce(entities, F.array().cast(f"array<{ENTITY}>")), lambda x: F.struct(clean(x, "name").alias("name"), typed(x, "OTHER").alias("type"), clean(x, "description").alias("description"), clean(x, "source_sentence").alias("source_sentence"), F.coalesce(x["stub"], F.lit(False)).alias("stub")))
    r = F.transform(F.coalesce(relations, F.array().cast(f"array<{RELATION}>")), lambda x: F.struct(clean(x, "source").alias("source"), clean(x, "target").alias("target"), typed(x, "RELATED_TO").alias("type"), clean(x, "description").alias("description"), clean(x, "source_sentence").alias("source_sentence")))
    return F.filter(e, lambda x: x["name"] != ""), F.filter(r, lambda x: (x["source"] != "") & (x["target"] != ""))


def endpoint_filter(rels: DataFrame, ents: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Relationships whose ends are both named in their chunk, or before it (prior: chunk_id, name)."""
    names = ents.select("chunk_id", norm(F.col("name")).alias("k"))
    if prior is not None:
        names = names.unionByName(prior.select("chunk_id", norm(F.col("name")).alias("k")))
    # a chunk names few things, so one join by chunk meets both ends
    of = names.groupBy("chunk_id").agg(F.collect_set("k").alias("k"))
    s, t = norm(F.col("source")), norm(F.col("target"))
    rows = rels.select(F.struct("*").alias("row"), "chunk_id", s.alias("s"), t.alias("t")).where("s <> '' and t <> ''")
    return rows.join(of, "chunk_id").where(F.array_contains("k", F.col("s")) & F.array_contains("k", F.col("t"))).select("row.*")


def recover_stubs(rels: DataFrame, ents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships, entities) where each missing end that stands in the chunk's text becomes a stub of type OTHER, once a chunk; a relationship with a missing end that doesn't is dropped."""
    names = ents.select("chunk_id", norm(F.col("name")).alias("k")).distinct()
    ends = rels.select("chunk_id", F.explode(F.array("source", "target")).alias("name"), "pos").withColumn("k", norm(F.col("name"))).where("k <> ''")
    missing = ends.join(names, ["chunk_id", "k"], "left_anti").join(chunks.select("chunk_id", "text"), "chunk_id")
    found = missing.where(verbatim(F.col("name"), F.col("text"))).groupBy("chunk_id", "k").agg(F.min_by("name", F.struct("pos", "name")).alias("name"), F.first("text").alias("text"))
    stubs = found.select("chunk_id", "name", F.lit("OTHER").alias("type"), F.lit("").alias("description"), sentence_with(F.col("text"), F.col("name")).alias("source_sentence"), F.lit(True).alias("stub"))
    return endpoint_filter(rels, ents, stubs), stubs


def merge_passes(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Rows of several passes, the first of each key in a chunk kept."""
    w = Window.partitionBy("chunk_id", *keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_entities(rows: DataFrame) -> DataFrame:
    """Entities of first and later passes (column pass): one for each name in any spelling of case."""
    return merge_passes(rows, [F.lower(F.trim("name"))], ["pass", "pos"])


def merge_relations(rows: DataFrame) -> DataFrame:
    return merge_passes(rows, [F.lower(F.trim("source")), F.lower(F.trim("target")), F.upper(F.trim("type"))], ["pass", "pos"])


def glean(first: DataFrame, extract: Callable[[DataFrame, int], DataFrame], passes: int) -> DataFrame:
    """Further extraction passes merged in; stops at a pass that finds nothing. extract(so far, pass) gives rows like `first`.

    Each pass is extracted once and stored: what is counted is what is merged, also with a model that never answers twice alike.
    """
    out = G.saved(first.withColumn("pass", F.lit(0)))
    for n in range(1, passes + 1):
        more = G.saved(extract(out, n).withColumn("pass", F.lit(n)))
        if more.limit(1).count() == 0:
            break
        out = G.saved(merge_entities(out.unionByName(more)))
    return out


def payload_errors(payload: Column) -> Column:
    """What a parsed payload lacks, at most 20 messages."""
    none = F.array(F.lit("entities is missing"))
    names = F.transform(payload["entities"], lambda x, i: F.when(F.trim(F.coalesce(x["name"], F.lit(""))) == "", F.concat(F.lit("entities["), i.cast("string"), F.lit("].name is empty"))))
    ends = F.transform(F.coalesce(payload["relationships"], F.array().cast(f"array<{RELATION}>")), lambda x, i: F.when((F.trim(F.coalesce(x["source"], F.lit(""))) == "") | (F.trim(F.coalesce(x["target"], F.lit(""))) == ""), F.concat(F.lit("relationships["), i.cast("string"), F.lit("] lacks an end"))))
    return F.slice(F.when(payload["entities"].isNull(), none).otherwise(F.filter(F.concat(names, ends), lambda m: m.isNotNull())), 1, 20)


def is_placeholder(value: Column) -> Column:
    """Whether a text is null, blank, a single mark in angle brackets, or holds what a prompt's example says."""
    text = F.trim(F.coalesce(value, F.lit("")))
    out = (text == "") | text.rlike(PLACEHOLDER_FORM) | F.lower(text).isin(*PLACEHOLDERS)
    for mark in PLACEHOLDER_MARKS:
        out = out | text.contains(mark)
    return out


def _genuine(df: DataFrame, *fields: str) -> Column:
    """None of these fields, as far as the records have them, is a placeholder."""
    out = F.lit(True)
    for c in fields:
        if c in df.columns:
            out = out & ~is_placeholder(F.col(c))
    return out


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Mentions whose name, type and description all say something."""
    return nodes.where(_genuine(nodes, "name", "type", "description"))


def valid_edges(edges: DataFrame) -> DataFrame:
    """Relationships between two different names, none of whose texts is a placeholder."""
    return edges.where(_genuine(edges, "source", "target", "type", "keywords", "description") & (F.trim("source") != F.trim("target")))


def validation_failures(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk_id and reason of the chunks with a text that yield no graph data: all their records are placeholders, or they have none."""

    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("chunk_id").agg(F.count(F.lit(1)).alias(name))

    out = chunks.select("chunk_id", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("full"))
    for name, df in {"raw_nodes": nodes, "raw_edges": edges, "nodes": valid_nodes(nodes), "edges": valid_edges(edges)}.items():
        out = out.join(per(df, name), "chunk_id", "left")
    any_raw, any_good = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) > 0 for a, b in (("raw_nodes", "raw_edges"), ("nodes", "edges")))
    return out.where(~any_good & (any_raw | F.col("full"))).select("chunk_id", F.when(any_raw, "only placeholders").otherwise("nothing extracted").alias("reason"))


def require_valid(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid nodes, valid edges); raises, naming a chunk, if one yields none."""
    bad = validation_failures(chunks, nodes, edges).orderBy("chunk_id").first()
    if bad:
        raise ValueError(f"chunk {bad['chunk_id']}: {bad['reason']}")
    return valid_nodes(nodes), valid_edges(edges)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows; reading raises if there are none."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no {what} survives validation")
    return df


def relation_audit(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """By chunk: raw relationships, those with an empty end, those with an unknown one, and those kept."""
    names = ents.select("chunk_id", norm(F.col("name")).alias("k")).distinct()
    r = rels.select("chunk_id", norm(F.col("source")).alias("s"), norm(F.col("target")).alias("t"))
    for end in ("s", "t"):
        r = r.join(names.select("chunk_id", F.col("k").alias(end), F.lit(True).alias(f"{end}_known")), ["chunk_id", end], "left")
    empty = (F.col("s") == "") | (F.col("t") == "")
    known = F.col("s_known").isNotNull() & F.col("t_known").isNotNull()
    return r.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if(empty).alias("empty_end"), F.count_if(~empty & ~known).alias("unknown_end"), F.count_if(~empty & known).alias("kept"))


def dropped_classes(rels: DataFrame, ents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ends unknown in their chunk by what they are: named elsewhere in the document, an alias (alias, canonical) of a name, or nowhere ('hallucinated')."""
    ends = rels.select("chunk_id", "doc_id", F.explode(F.array(norm(F.col("source")), norm(F.col("target")))).alias("k")).where("k <> ''")
    names = ents.select("chunk_id", "doc_id", norm(F.col("name")).alias("k"))
    lost = ends.join(names.select("chunk_id", "k").distinct(), ["chunk_id", "k"], "left_anti")
    lost = lost.join(names.select("doc_id", "k").distinct().withColumn("in_doc", F.lit(True)), ["doc_id", "k"], "left")
    lost = lost.join(aliases.select(norm(F.col("alias")).alias("k")).distinct().withColumn("is_alias", F.lit(True)), "k", "left")
    kind = F.when(F.col("in_doc"), "same_document").when(F.col("is_alias"), "alias").otherwise("hallucinated")
    return lost.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("ends"), F.countDistinct("k").alias("names"))


def cross_document_names(ents: DataFrame, least: int = 2) -> DataFrame:
    return ents.groupBy(norm(F.col("name")).alias("key")).agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= least)


def coverage(chunks: DataFrame, ents: DataFrame) -> DataFrame:
    """By document and in total (null): chunks, tokens, chunks without entities, raw and distinct names. One rollup."""
    per = ents.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("raw"))
    a = chunks.join(per, "chunk_id", "left").rollup("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if(F.col("raw").isNull()).alias("zero_entity"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_entities"))
    b = ents.rollup("doc_id").agg(F.countDistinct(norm(F.col("name"))).alias("names"))
    return a.join(b.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d").withColumn("names", F.coalesce("names", F.lit(0)))


def arm_statistics(rows: DataFrame) -> DataFrame:
    """By arm: chunks that went well and failed, raw and kept relationships, seconds. rows: arm, ok, raw, kept, seconds."""
    return rows.groupBy("arm").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("raw").alias("raw"), F.sum("kept").alias("kept"), F.round(F.sum("seconds"), 6).alias("seconds"))


def arm_matrix(rows: DataFrame, arms: list[str]) -> DataFrame:
    """A row for each chunk, a column of kept counts for each arm."""
    return rows.groupBy("chunk_id").pivot("arm", arms).agg(F.sum("kept"))


def rule_entities(chunks: DataFrame, least: int = 6) -> DataFrame:
    """A deterministic extractor: capitalised words of at least this length as CONCEPT entities, in order of their first place."""
    words = F.regexp_extract_all("text", F.lit(rf"(\p{{Lu}}\p{{L}}{{{least - 1},}})"), F.lit(1))
    rows = chunks.select("chunk_id", "doc_id", "text", F.posexplode(words).alias("pos", "name"))
    return rows.groupBy("chunk_id", "doc_id", "name").agg(F.min("pos").alias("pos"), F.first("text").alias("text")).select("chunk_id", "doc_id", "pos", "name", F.lit("CONCEPT").alias("type"), F.lit("").alias("description"), sentence_with(F.col("text"), F.col("name")).alias("source_sentence"), F.lit(False).alias("stub"))


def rule_relations(ents: DataFrame) -> DataFrame:
    """Entities next to each other in a sentence are RELATED_TO."""
    w = Window.partitionBy("chunk_id", "source_sentence").orderBy("pos")
    rows = ents.withColumn("target", F.lead("name").over(w)).where(F.col("target").isNotNull() & (F.col("source_sentence") != ""))
    return rows.select("chunk_id", "doc_id", "pos", F.col("name").alias("source"), "target", F.lit("RELATED_TO").alias("type"), F.lit("").alias("description"), "source_sentence")


