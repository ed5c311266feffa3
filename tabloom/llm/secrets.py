"""Secret scans: candidates in every text, and how widely their values are owned across the corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import boxed, counted, small_batches, tidied, written

#: Kinds in listed order; the last is the one that the method adds.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a maximal run: with 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character from which a value looks random, and the numbers of owners, and of repositories of fewer owners,
#: from which it is a copied example.
LIVE_BITS, WIDE_OWNERS, WIDE_REPOSITORIES = 2.5, 3, 100
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|x{4}|0{8}|1234567", re.IGNORECASE)
FINDING = "array<struct<kind:int,start:int,stop:int,hash:string,live:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


def _finding(kind: int, start: int, stop: int, value: str) -> tuple:
    looks = entropy(value) >= LIVE_BITS and not PLACEHOLDER.search(value)
    return kind, start, stop, hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), looks


def scan(text: str | None) -> list[tuple]:
    """(kind, start, stop, hash of the value, looks live) of each finding in a whole text, by start, then kind."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = [(start, stop) for _, start, stop, _ in found]
    for m in TOKEN.finditer(text):
        value = m[0]
        if (
            any(c.isdigit() for c in value)
            and any(c.isupper() for c in value)
            and any(c.islower() for c in value)
            and entropy(value) >= 3.5
            and not any(start < m.end() and m.start() < stop for start, stop in base)
        ):
            found.append((3, m.start(), m.end(), value))
    return sorted((_finding(*f) for f in found), key=lambda f: (f[1], f[0]))


def joined(findings: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{stop}" for k, start, stop, *_ in findings)


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: the columns `keep`, counts of the base kinds, their digest, and all findings. No shuffle."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, docs[text].alias("_text"))
    extra = T._parse_datatype_string(f"n_assign long, n_access long, n_hex long, base_sha256 string, findings {FINDING}")
    types = [f.type for f in to_arrow_schema(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("_text")]
            base = [[f for f in fs if f[0] < 3] for fs in found]
            cells = [[sum(f[0] == k for f in fs) for fs in base] for k in range(3)]
            cells.append([hashlib.sha256(joined(fs).encode()).hexdigest() for fs in base])
            cells.append([[dict(zip(("kind", "start", "stop", "hash", "live"), f, strict=True)) for f in fs] for fs in found])
            arrays = [pa.array(c, t) for c, t in zip(cells, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*keep, *extra.names])

    return kept.mapInArrow(tidied(run), T.StructType([*kept.schema.fields[:-1], *extra]))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """Per candidate hash its distinct repositories and owners. Partial sums come before the shuffle, so a value that
    a third of all rows hold is a few rows by then."""
    each = found.select(F.explode("findings.hash").alias("hash"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    return each.groupBy("hash").agg(
        F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories")
    )


def _spans(findings: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"].cast("string"), f["stop"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", owner: str = "source", text: str = "text", wide: int = WIDE_OWNERS, extra: list[str] = ()) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans and owned.

    Candidate values are hashed and counted by distinct repositories (documents) and owners over the whole corpus.
    A value of `wide` owners or more, or of WIDE_REPOSITORIES repositories, is a copied example; any other that looks
    random is live. A token span is
    added where its value is no copied example; base spans always stay. live_spans has start and stop of live findings, owned
    start, stop, n_owners and n_repositories of all.
    A null text is empty; a null owner counts for no owner; repeated rows are scanned each and count as one repository;
    other columns are ignored; an empty table gives no row. Only findings are shuffled, never texts; the table of
    counts, a row for each distinct value, is broadcast while it is small, and beyond that a hash that many rows share
    meets its counts in a join whose large partitions Spark may split.
    """
    names = list(dict.fromkeys([id_col, owner, *extra]))
    found = written(find(docs, names, text).withColumn("row", F.monotonically_increasing_id()), "secrets")
    owners = counted(written(ownership(found, id_col, owner), "owners"))
    each = found.select("row", F.explode("findings").alias("f")).select("row", "f", F.col("f.hash").alias("hash"))
    judged = each.join(owners, "hash").withColumn("example", (F.col("n_owners") >= wide) | (F.col("n_repositories") >= WIDE_REPOSITORIES))
    per_row = judged.groupBy("row").agg(
        F.array_sort(
            F.collect_list(
                F.when(
                    (F.col("f.kind") < 3) | ~F.col("example"),
                    F.struct("f.start", "f.kind", "f.stop", (F.col("f.live") & ~F.col("example")).alias("live")),
                )
            )
        ).alias("kept"),
        F.sum(F.col("example").cast("long")).alias("n_example"),
        F.array_sort(F.collect_list(F.struct("f.start", "f.stop", "n_owners", "n_repositories"))).alias("owned"),
    )
    all_kept = F.coalesce(F.col("kept"), F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean>>"))
    live = F.filter(all_kept, lambda f: f["live"])
    return found.join(per_row, "row", "left").select(
        *dict.fromkeys([id_col, *extra]), "n_assign", "n_access", "n_hex", "base_sha256",
        _spans(all_kept).alias("spans"), F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.transform(live, lambda f: F.struct(f["start"].alias("start"), f["stop"].alias("stop"))).alias("live_spans"),
        F.coalesce("owned", F.array().cast("array<struct<start:int,stop:int,n_owners:long,n_repositories:long>>")).alias("owned"),
    )


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """text with each maximal run of spans replaced by one mark."""
    out, at = [], 0
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact_live(docs: DataFrame) -> DataFrame:
    """docs with the live credentials of each text replaced by a mark and n_chars, where there, counted anew.
    Copied examples and clean documents stay as they are. Null texts stay null."""
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("key"), "text")
    found = scan_secrets(keyed, extra=["key"]).where("n_live > 0")
    found = found.groupBy(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key")).agg(F.first("live_spans").alias("spans"))
    found = counted(written(found, "live"), F.size("spans"))
    box = boxed(docs, doc=F.col("doc_id"), key=F.xxhash64("text"), text=F.col("text"))
    met = box.join(found, box["doc"].eqNullSafe(found["hit_doc"]) & (box["key"] == found["hit_key"]), "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else redact(t, list(s)) for t, s in zip(texts, spans, strict=True)])

    hit = F.col("spans").isNotNull()
    new = met.withColumn("new", F.when(hit, clean("text", "spans")).otherwise(F.col("text")))
    replaced = {"text": F.col("new"), "n_chars": F.length("new")}
    return new.select(
        *[
            F.when(hit, replaced[f.name].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`")).alias(f.name) if f.name in replaced else F.col(f"row.`{f.name}`").alias(f.name)
            for f in docs.schema
        ]
    )


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("live_spans", "owned")
