"""Secret scan with an incremental blob ledger.

Every version of a text is a blob, named by its SHA-256. The ledger holds each blob with its findings under a rule
version, and each (path, blob) that a scan has ever seen. A scan takes only blobs that the ledger lacks under the present
rule version, appends what it finds, and joins the findings back to the paths: of the present table, or, by history(),
of every version of every path.

The (id, blob) pairs meet the ledger first, and of each unseen blob the row with the smallest id is scanned, whatever task
the others lie in. Where the ledger has nothing under the rule version yet, rows are scanned where they lie, but for
copies of such a row. The names that rows must meet go to them by broadcast where they are few (SMALL, counted), beyond
that by a join.

Null text counts as empty; an empty text has a blob and no findings. Rows that repeat share a blob, and each gets its
findings. Extra columns stay out of the result. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from storyloom.operators.ingest import free_name

from .common import discard, new_path, slices, stored

#: (kind, pattern, group whose length counts, least length). A match that is too short is dropped but takes its text.
#: The first three are the base rules; the others are added by this scanner.
RULES = (
    ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs [0-9a-f]+ of 16 characters or more
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
#: Up to so many names of unseen blobs (about 100 bytes each) are broadcast to the texts.
SMALL = 200_000


def rule_version(rules=RULES) -> str:
    """Changes with any rule, so that a changed rule set scans every blob again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules=None) -> list[tuple[str, int, int]]:
    """All findings of a text by start, then by the rules' order."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules or _compiled(RULES)):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _compiled(rules) -> list:
    return [(k, re.compile(p), g, n) for k, p, g, n in rules]


KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def found_in(blobs: list[str], texts: list[str | None], rules: list) -> list[list[dict]]:
    """The findings of each text; equal blobs are scanned once."""
    known: dict[str, list[dict]] = {}
    for blob, text in zip(blobs, texts, strict=True):
        if blob not in known:
            known[blob] = [{"kind": k, "start": s, "end": e} for k, s, e in find(text or "", rules)]
    return [known[b] for b in blobs]


def scan_blobs(texts: DataFrame, rules=RULES) -> DataFrame:
    """(id, blob, text) rows to (id, blob, findings), where they lie."""
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _compiled(rules)
        for batch in batches:
            for part in slices(batch, "text"):
                found = found_in(part.column("blob").to_pylist(), part.column("text").to_pylist(), own)
                yield pa.record_batch({"id": part.column("id"), "blob": part.column("blob"), "findings": pa.array(found, KIND)})

    return texts.select("id", "blob", "text").mapInArrow(work, f"id {kind}, blob string, findings {FINDINGS}")


class Ledger:
    """Two append-only Parquet tables below the root: scanned blobs, and the versions of paths. Each append is one atomic
    Spark write; a blob that concurrent scans append twice has the same findings twice."""

    BLOBS = f"blob string, rules string, findings {FINDINGS}"
    PATHS = "path string, blob string"

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def blobs(self, version: str) -> DataFrame:
        """blob, findings under a rule version."""
        return self._table("blobs", self.BLOBS).filter(F.col("rules") == version).select("blob", "findings")

    def paths(self) -> DataFrame:
        """Every (path, blob) that was ever seen."""
        return self._table("paths", self.PATHS)

    def append(self, found: DataFrame, version: str) -> None:
        once = found.select("blob", "findings").dropDuplicates(["blob"])
        once.select("blob", F.lit(version).alias("rules"), "findings").write.mode("append").parquet(f"{self.path}/blobs")

    def append_paths(self, paths: DataFrame) -> None:
        new = paths.select(F.col("id").cast("string").alias("path"), "blob").distinct()
        new.join(self.paths(), ["path", "blob"], "left_anti").write.mode("append").parquet(f"{self.path}/paths")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def take_in(df: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Scans the blobs of df that the ledger lacks under the rules' version; returns the stored (id, blob) of every row."""
    version, rows = rule_version(rules), _named(df, id_col, text_col)
    seen = ledger.blobs(version).select("blob")
    paths = stored(rows.select("id", "blob"), "paths")
    named = paths.groupBy("blob").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    fresh = seen.isEmpty()
    # one row speaks for a blob. Where nothing was seen yet, only blobs of several rows need to be known for that
    wanted = stored((named.filter("n > 1") if fresh else named.join(seen, "blob", "left_anti")).select("blob", "first"), "unseen")
    few = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    met = rows.join(few.withColumn("known", F.lit(True)), "blob", "left" if fresh else "inner")
    texts = met.filter(F.col("known").isNull() | F.col("id").eqNullSafe(F.col("first")))
    ledger.append(scan_blobs(texts, rules), version)
    discard(wanted)
    ledger.append_paths(paths)
    return paths


def _with_findings(paths: DataFrame, ledger: Ledger, rules) -> DataFrame:
    # most blobs hold nothing: only those with findings meet the paths again; a stored table, so that a hot blob is split
    known = stored(ledger.blobs(rule_version(rules)).filter(F.size("findings") > 0).dropDuplicates(["blob"]), "findings")
    return paths.join(known, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """One row per row of df: id, blob, findings."""
    ledger = ledger or Ledger(df.sparkSession)
    paths = take_in(df, ledger, id_col, text_col, rules)
    return _with_findings(paths, ledger, rules).select("id", "blob", "findings").withColumnRenamed("id", id_col)


def history(ledger: Ledger, rules=RULES) -> DataFrame:
    """path, blob, findings of every version of every path."""
    return _with_findings(ledger.paths(), ledger, rules).select("path", "blob", "findings")


def joined(findings, kinds=None):
    """The findings as kind:start:end, comma-joined."""
    kept = F.filter(findings, lambda x: x["kind"].isin(*kinds)) if kinds else findings
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: str, found) -> str:
    """The text with each finding replaced by [kind]; overlapping findings become one, named after the first."""
    out, at = [], 0
    for f in found or []:
        kind, start, end = f["kind"], f["start"], f["end"]
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """df with the findings in its texts replaced; all rows and other columns stay.

    Where the ledger lacks the rules' version, rows are scanned and redacted in one narrow pass, and the ledger takes in
    what was found; else findings come from the ledger, by blob."""
    ledger, version = ledger or Ledger(df.sparkSession), rule_version(rules)
    fresh = ledger.blobs(version).isEmpty()
    blob, found_ = free_name("_blob", df), free_name("_found", df)
    named = df.withColumn(blob, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    schema = StructType([*named.schema.fields, StructField(found_, ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _compiled(rules)
        for batch in batches:
            for part in slices(batch, text_col):
                k = part.schema.get_field_index(text_col)
                texts = part.column(k).to_pylist()
                found = found_in(part.column(blob).to_pylist(), texts, own) if fresh else part.column(found_).to_pylist()
                texts = [redact(x, f) if f else x for x, f in zip(texts, found, strict=True)]
                part = part.set_column(k, text_col, pa.array(texts, part.column(k).type))
                yield part.append_column(found_, pa.array(found, KIND)) if fresh else part

    if fresh:
        out = stored(named.mapInArrow(work, schema), "redacted")
        ledger.append(out.select(F.col(blob).alias("blob"), F.col(found_).alias("findings")), version)
        ledger.append_paths(out.select(F.col(id_col).alias("id"), F.col(blob).alias("blob")))
        return out.select(*df.columns)
    discard(take_in(df, ledger, id_col, text_col, rules))
    known = stored(ledger.blobs(version).filter(F.size("findings") > 0).dropDuplicates(["blob"]), "findings").select(F.col("blob").alias(blob), F.col("findings").alias(found_))
    return named.join(known, blob, "left").select(*named.columns, found_).mapInArrow(work, schema).select(*df.columns)
