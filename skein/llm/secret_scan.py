"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its content. A
ledger lists the (blob, rule version) pairs that have been scanned; a run scans
one copy of each blob that the ledger lacks, adds it, and joins the findings
back to all paths that hold the blob. Copies meet map-side first, so a blob that
a third of all rows share reaches the shuffle once per task.

Texts travel compressed, once each. A null text counts as an empty one. A null
path is a path like any other; repeated rows each get the blob's findings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, stored, table


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if their measured group has at least this many characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()  # the text holds one of these (in lower case if any_case) where the pattern can match

    def spans(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.needs and not any(x in (lower if self.any_case else text) for x in self.needs):
            return []
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        return [m.span() for m in re.finditer(self.pattern, text, flags) if len(m[self.group]) >= self.least]


#: The base kinds in the order in which they are listed.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True, ("password", "passwd", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Public formats of keys that the base kinds miss.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, needs=("-----BEGIN ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, needs=("eyJ",)),
    Rule("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, needs=("xox",)),
    Rule("urlauth", r"[a-z][a-z0-9+.-]{1,19}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", 0, needs=("://",)),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}", 0, needs=("earer ",)),
)


@dataclass(frozen=True)
class Rules:
    """A rule set; its version changes with any pattern, so a change rescans every blob."""

    rules: tuple[Rule, ...] = field(default=BASE + MORE)

    @property
    def version(self) -> str:
        import hashlib

        return hashlib.sha256(repr(self.rules).encode()).hexdigest()[:16]

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points by start, then kind as listed."""
        lower = text.lower()
        found = [(start, k, end) for k, rule in enumerate(self.rules) for start, end in rule.spans(text, lower)]
        return [(self.rules[k].kind, start, end) for start, k, end in sorted(found)]


def versions(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path and blob (SHA-256 of the content) of each row."""
    return df.select(F.col(path_col).alias("path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))


FINDINGS = "blob string, findings array<struct<kind:string,start:int,end:int>>"


def unseen_blobs(df: DataFrame, text_col: str, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """One compressed copy of each blob that the ledger lacks under this rule version."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        # a batch's copies of a blob meet here, those of a task in the partial aggregate
        import hashlib

        seen: dict[str, bytes] = {}
        press = zstandard.ZstdCompressor(level=1)
        for text in {t or "" for t in batch.column(0).to_pylist()}:
            raw = text.encode()
            seen[hashlib.sha256(raw).hexdigest()] = press.compress(raw)
        return pa.RecordBatch.from_pydict({"blob": pa.array(seen.keys(), pa.string()), "content": pa.array(seen.values(), pa.binary())})

    blobs = map_batches(df, [text_col], pack, "blob string, content binary")
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    return blobs.groupBy("blob").agg(F.first("content").alias("content"))


def scan_blobs(blobs: DataFrame, rules: Rules) -> DataFrame:
    """The findings of each blob; blobs without any have an empty list, which is what makes them seen."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = zstandard.ZstdDecompressor()
        out = []
        for content in batch.column(1).to_pylist():
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in rules.scan(read.decompress(content).decode())])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_pydict({"blob": batch.column(0), "findings": pa.array(out, kind)})

    return map_batches(blobs, ["blob", "content"], run, FINDINGS)


def scan(df: DataFrame, rules: Rules = Rules(), ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger with this run's blobs).

    The first has path, blob, rule_version and findings for all rows; the ledger has
    blob, rule_version and findings, and is what the next run is given.
    """
    version = rules.version
    fresh = scan_blobs(unseen_blobs(df, text_col, ledger, version), rules).withColumn("rule_version", F.lit(version))
    fresh = stored(fresh, "ledger")
    book = fresh if ledger is None else ledger.select(fresh.columns).unionByName(fresh)
    # most blobs hold nothing; the few findings join the many paths
    known = book.where((F.col("rule_version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    paths = versions(df, path_col, text_col).join(known, "blob", "left")
    return paths.select("path", "blob", F.lit(version).alias("rule_version"), F.coalesce("findings", none).alias("findings")), book


def redacted(df: DataFrame, rules: Rules = Rules(), ledger: DataFrame | None = None, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every found span replaced, overlapping spans as one; findings come from the ledger and this run's scan of unseen blobs. Other columns and texts stay as they are."""
    version = rules.version
    _, book = scan(df, rules, ledger, path_col=text_col, text_col=text_col)
    known = book.where((F.col("rule_version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    names, text = df.columns, df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = batch.column(0).flatten()
        texts, spans = cols[text].to_pylist(), batch.column(1).to_pylist()
        for k, own in enumerate(spans):
            if own:
                parts, at, t = [], 0, texts[k]
                for x in own:
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], mark]
                    at = max(at, x["end"])
                texts[k] = "".join((*parts, t[at:]))
        cols[text] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(rows.join(known, "blob", "left"), ["row", "findings"], run, df.schema)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"))
    f = F.col("findings")

    def joined(col):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter(f, lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = [F.size(F.filter(f, _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(f).alias("spans"))
