"""Export to and import from an archive: Parquet rows and their metadata.

The metadata holds a format name, the schema version, the row count, index
definitions and a digest of the content that doesn't depend on row order.
Import verifies everything before it writes anything.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArchiveError
from .store import Files, Store

FORMAT = "docloom-archive"
VERSION = 1


def digest(rows: DataFrame) -> dict[str, Any]:
    """Row count and an order-free digest: sums of two 64-bit hashes of each row's SHA-256."""
    line = F.concat_ws("\x1f", F.octet_length("key"), "key", F.coalesce("value", F.lit("\x00")), F.coalesce(F.unix_micros("expires_at").cast("string"), F.lit("")))
    sha = F.sha2(line, 256)
    half = lambda start: F.sum(F.conv(F.substring(sha, start, 15), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b")).first()
    return {"rows": r.n, "digest": f"{r.a or 0}-{r.b or 0}"}


def export_to(store: Store, path: str) -> int:
    """Write the store's rows, expired ones included, and metadata; the row count."""
    rows = store.rows().select("key", "value", "expires_at")
    rows.write.parquet(f"{path}/rows")
    m = store.manifest()
    written = digest(store.spark.read.parquet(f"{path}/rows"))
    meta = {"format": FORMAT, "version": VERSION, "schema_version": m["schema_version"], "indexes": m["indexes"], **written}
    if not Files(store.spark, path).create("_metadata.json", json.dumps(meta)):
        raise ArchiveError(f"{path} holds an archive")
    return written["rows"]


def import_from(spark: SparkSession, archive: str, path: str, overwrite: bool = False) -> Store:
    """Verify an archive, then write it as a store at ``path``, with its indexes."""
    files = Files(spark, archive)
    if "_metadata.json" not in files.list(""):
        raise ArchiveError(f"{archive} has no metadata")
    try:
        meta = json.loads(files.read("_metadata.json"))
    except ValueError as e:
        raise ArchiveError("the metadata can't be read") from e
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise ArchiveError("not an archive of this format and version")
    try:
        rows = spark.read.schema("key string, value string, expires_at timestamp").parquet(f"{archive}/rows")
        found = digest(rows)
    except Exception as e:
        raise ArchiveError(f"the rows can't be read: {type(e).__name__}") from e
    if found != {k: meta[k] for k in ("rows", "digest")}:
        raise ArchiveError("the content doesn't match its digest")
    target = Files(spark, path)
    if target.list("") and not overwrite:
        raise ArchiveError(f"{path} isn't empty")
    # The new store is whole before it takes the old one's place.
    parent, _, name = path.rstrip("/").rpartition("/")
    aside = f"{name}.import-{uuid.uuid4().hex}"
    store = Store(spark, f"{parent}/{aside}", schema_version=meta["schema_version"])
    if found["rows"]:
        store.append(rows)
    for collection, fields in meta["indexes"]:
        store.create_index(collection, fields)
    target.delete("")
    if not Files(spark, parent).move(aside, name):
        raise ArchiveError(f"{path} can't be replaced; the imported store is {parent}/{aside}")
    return Store(spark, path, schema_version=meta["schema_version"])
