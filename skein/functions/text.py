"""Scalar text functions as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default tokenizer's pattern: a run without white space and the white space behind it.
TOKEN = r"[^ \t\n\r]+[ \t\n\r]*"
#: Full-text terms: lower-cased runs of letters and digits.
NOT_TERM = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Tokens with their trailing white space; joined they give the text from its first token on."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\x0b\f]+", " "))


def norm(name: Column) -> Column:
    """Primary key of a name: lower case, white space collapsed; null counts as empty."""
    return collapse(F.lower(F.coalesce(name, F.lit(""))))


def norm_alias(name: Column) -> Column:
    """Alias key in graph building: letters, digits and _ only, one trailing s gone."""
    return F.regexp_replace(collapse(F.regexp_replace(norm(name), r"(?U)[^\w\s]", "")), "s$", "")


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII takes no trip to Python."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(compose(text))


def normalize(label: Column) -> Column:
    """Key of a label in entity resolution: NFKC, lower case, white space collapsed."""
    return norm(nfkc(label))


def resolution_alias(label: Column) -> Column:
    """Alias key in entity resolution: marks deleted, a trailing es or else s gone."""
    base = collapse(F.regexp_replace(normalize(label), r"(?U)[^\w\s]", ""))
    return F.when(base.endswith("es") & (F.length(base) > 2), F.substring(base, F.lit(1), F.length(base) - 2)).when(base.endswith("s") & (F.length(base) > 1), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def verbatim(name: Column, text: Column) -> Column:
    """Whether a name stands in a text as a whole phrase, without regard to case and white space; an empty name doesn't."""
    n, t = norm(name), norm(text)
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    # a plain search first: most names don't occur at all
    return (n != "") & t.contains(n) & F.regexp_like(t, quoted)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_with(text: Column, name: Column) -> Column:
    """The first sentence that contains the name, or an empty text."""
    own = F.filter(sentences(text), lambda s: norm(s).contains(norm(name)))
    return F.when(norm(name) == "", "").otherwise(F.coalesce(F.get(own, 0), F.lit("")))


def base_title(title: Column) -> Column:
    """A title without a bracketed ending."""
    return F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))


def clean_flat(text: Column) -> Column:
    """Full-text cleaning of the flat and structural plans: dashes to spaces."""
    return F.replace(F.replace(text, F.lit("--"), F.lit(" ")), F.lit(" - "), F.lit(" "))


def clean_strict(text: Column) -> Column:
    """Full-text cleaning of the other plans: quotes, brackets and operators to spaces too."""
    return collapse(F.regexp_replace(clean_flat(text), r"""["'()\[\]{}:+^~*?!\\/]""", " "))


def normalize_answer(text: Column) -> Column:
    """Answer text for exact match: lower case, no ASCII marks, no articles, white space collapsed."""
    bare = F.regexp_replace(F.lower(text), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return collapse(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def short_sha(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return short_sha(F.concat(doc_id.cast("string"), F.lit("::"), index.cast("string")))


def store_id(name: Column) -> Column:
    """An id for a collection: safe characters, at most 64; longer ones end in a digest."""
    safe = F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(safe) <= 64, safe).otherwise(F.concat(F.substring(safe, 1, 55), F.lit("_"), F.substring(F.sha1(name), 1, 8)))


def json_object(raw: Column) -> Column:
    """The text of the JSON object in a model's answer: fences stripped, first { to last }, trailing commas gone; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*", ""), r"(?s)\s*```\s*$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    fixed = F.regexp_replace(body, r",(\s*[}\]])", "$1")
    return F.when(body == "", None).when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(fixed).isNotNull(), fixed)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


#: A row of text is quoted where it holds one of these.
NEEDS_QUOTES = re.compile(r'[,"\n\r\t]')


def fraction_text(x: Column) -> Column:
    """A number from 0 to 1 as SQL and Python write it: an exponent under 0.0001 alone, where Spark's cast has one under 0.001."""
    s = x.cast("string")
    digits = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    power = F.abs(F.substring_index(s, "E", -1).cast("int"))
    short = F.concat(F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))
    return F.when(~s.contains("E"), s).when(power == 4, short).otherwise(F.concat(digits, F.lit("e-"), F.lpad(power.cast("string"), 2, "0")))
