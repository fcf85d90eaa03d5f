"""Evidence tables as text: the tabular TOON form and JSON, with their token costs; prompts and answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import NEEDS_QUOTES, count_tokens

FIELDS = ("chunk_id", "source_doc", "chunk_index", "score", "source", "text")


def _cell(value: Column) -> Column:
    """A value, quoted as a JSON string if it is empty, has outer white space or holds a comma, quote or line break."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    escaped = v
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    odd = (v == "") | (v != F.trim(v)) | v.rlike(r"""[,"\n\r\t]|^\s|\s$""")
    return F.when(odd, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(v)


def to_toon(evidence: DataFrame, key: str = "qid", order: str = "rank", include_text: bool = True) -> DataFrame:
    """key, toon: header evidence[n]{columns}: and an indented row for each piece of evidence in order."""
    fields = [f for f in FIELDS if include_text or f != "text"]
    line = F.concat(F.lit("  "), F.concat_ws(",", *(_cell(F.col(f)) for f in fields)))
    g = evidence.select(key, F.struct(F.col(order).alias("o"), line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.concat(F.lit("evidence["), F.size("x").cast("string"), F.lit("]{" + ",".join(fields) + "}:\n"))
    return g.select(key, F.concat(head, F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("toon"))


def from_toon(text: str) -> list[dict]:
    """The rows of one TOON text; raises where count or columns don't fit the header."""
    lines = text.split("\n")
    m = re.fullmatch(r"evidence\[(\d+)\]\{([^}]*)\}:", lines[0])
    if not m:
        raise ValueError("no evidence header")
    names = m[2].split(",")
    rows = []
    for line in (x for x in lines[1:] if x):
        values, rest = [], line[2:]
        while True:
            hit = re.match(r'"(?:[^"\\]|\\.)*"|[^,]*', rest)
            values.append(json.loads(hit[0]) if hit[0].startswith('"') else hit[0])
            rest = rest[hit.end() :]
            if not rest:
                break
            rest = rest[1:]
        if len(values) != len(names):
            raise ValueError(f"{len(values)} cells for {len(names)} columns")
        row = {"source": "chunk", "text": ""} | dict(zip(names, values, strict=True))
        if "chunk_index" in names:
            row["chunk_index"] = int(row["chunk_index"])
        if "score" in names:
            row["score"] = float(row["score"])
        rows.append(row)
    if len(rows) != int(m[1]):
        raise ValueError(f"{len(rows)} rows where the header says {m[1]}")
    return rows


def quoted(value: str) -> str:
    """One cell, as to_toon() writes it."""
    return json.dumps(value, ensure_ascii=False) if value == "" or value != value.strip() or NEEDS_QUOTES.search(value) else value


def to_json(evidence: DataFrame, key: str = "qid", order: str = "rank", include_text: bool = True) -> DataFrame:
    fields = [f for f in FIELDS if include_text or f != "text"]
    g = evidence.select(key, F.struct(F.col(order).alias("o"), F.struct(*fields).alias("r")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select(key, F.to_json(F.transform("x", lambda r: r["r"])).alias("json"))


def from_json(df: DataFrame, key: str, col: str) -> DataFrame:
    kind = "array<struct<chunk_id:string,source_doc:string,chunk_index:int,score:double,source:string,text:string>>"
    return df.select(key, F.posexplode(F.from_json(col, kind)).alias("n", "r")).select(key, (F.col("n") + 1).alias("rank"), "r.*")


def compare_formats(evidence: DataFrame, key: str = "qid", order: str = "rank") -> DataFrame:
    """key and tokens of both forms, saved tokens and percent."""
    j = to_toon(evidence, key, order).join(to_json(evidence, key, order), key)
    j = j.select(key, count_tokens(F.col("toon")).alias("toon_tokens"), count_tokens(F.col("json")).alias("json_tokens"), F.length("toon").alias("toon_chars"), F.length("json").alias("json_chars"))
    saved = F.col("json_chars") - F.col("toon_chars")
    return j.withColumn("saved_chars", saved).withColumn("saved_pct", F.round(100 * saved / F.col("json_chars"), 2))


def context(texts: Column) -> Column:
    """Passages as '[i] text', parted by blank lines; empty ones left out, numbers kept."""
    return F.array_join(F.filter(F.transform(texts, lambda t, i: F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("["), i.cast("string"), F.lit("] "), t))), lambda t: t.isNotNull()), "\n\n")


def reformatted(answer: Column) -> Column:
    """Answer lines '[n] fact' as 'fact [n]' joined by spaces, a leading 'answer:' gone."""
    bare = F.regexp_replace(answer, r"(?i)^\s*answer:\s*", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^\[(\d+)\]\s*(.+)$", "$2 [$1]"))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def prompt(question: Column, passages: Column) -> Column:
    """Numbered passages (title, sentences) with numbered sentences, then the question."""

    def one(p: Column, i: Column) -> Column:
        s = F.array_join(F.transform(p["sentences"], lambda x, k: F.concat(F.lit("("), k.cast("string"), F.lit(") "), x)), " ")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit("\n"), s)

    return F.concat(F.array_join(F.transform(passages, one), "\n\n"), F.lit("\n\nQuestion: "), question)


def fact_pairs(flat: Column, titles: Column) -> Column:
    """(title, sentence) of a flat list of 1-based passage and sentence numbers; pairs out of range left out."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(flat) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(flat, 2 * i).alias("p"), F.get(flat, 2 * i + 1).alias("s")))
    good = F.filter(pairs, lambda x: (x["p"] >= 1) & (x["p"] <= F.size(titles)) & (x["s"] >= 0))
    return F.array_distinct(F.transform(good, lambda x: F.struct(F.get(titles, x["p"] - 1).alias("title"), x["s"].alias("sentence"))))
