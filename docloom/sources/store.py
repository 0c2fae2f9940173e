"""A document and key/value store as an append-only change log with snapshots.

A commit stages one Parquet segment (key, value, tombstone, expires_at, seq,
ts), creates the manifest of the next version, and moves the segment to the
log.  Creating a manifest that exists fails, so the first committer wins and a
commit is atomic; what is staged without a manifest is never read.  A
committer that is lost between manifest and move leaves the move to whoever
reads or commits next.  So the log holds committed segments only, which
streams can follow.  The state is the latest entry of each key over the
snapshot and the segments after it.  Values are JSON text, read as VARIANT,
and encrypted at rest if the store has a key.

Manifests are small files read and written by the driver through Spark's own
file system layer, so a store can be anywhere Spark can write.
"""

from __future__ import annotations

import json
import logging
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClosedError, ConflictError, DocloomError, InvalidKeyError, QueryError, SchemaVersionError, SerializationError
from ..functions import exprs, scalar
from ..operators.index import IndexDefinition, postings
from ..plans.query import Collection, DocQuery
from ..values import is_storable, values_equal
from . import kv

LOG_SCHEMA = "key string, value string, tombstone boolean, expires_at timestamp, seq long, ts timestamp"
ISOLATION = ("read_committed", "repeatable_read", "serializable", "optimistic")
SYNC_MODES = ("none", "os", "full")
_DELETED = object()
#: Seconds after which a lock without its file is its committer's loss.
LOCK_SECONDS = 60


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise DocloomError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{base.rstrip('/')}/docloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that the driver needs, on any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self._conf), path

    def list(self, name: str) -> list[str]:
        fs, path = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str, lock_seconds: float = LOCK_SECONDS) -> bool:
        """Create a file with this content; False if it exists.

        The content is written aside and moved, so a reader never sees half.
        An exclusive create of a lock decides between two committers; a lock
        whose committer was lost before the move is taken over after
        ``lock_seconds``.
        """
        fs, path = self._path(name)
        if fs.exists(path):
            return False
        _, aside = self._path(f"_tmp/{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.mkdirs(path.getParent())
        _, lock = self._path(f"{name}.lock")
        if not (self._exclusive(fs, lock) or self._expired(fs, lock, path, lock_seconds) and self._exclusive(fs, lock)):
            fs.delete(aside, False)
            return False
        done = not fs.exists(path) and bool(fs.rename(aside, path))
        fs.delete(aside, False)
        return done

    def _exclusive(self, fs, lock) -> bool:
        try:
            fs.create(lock, False).close()
            return True
        except Exception:
            return False

    def _expired(self, fs, lock, path, lock_seconds: float) -> bool:
        """Remove a lost committer's lock; one of several that try succeeds."""
        try:
            age = time.time() - fs.getFileStatus(lock).getModificationTime() / 1000
        except Exception:
            return False
        if age < lock_seconds or fs.exists(path):
            return False
        _, gone = self._path(f"_tmp/{uuid.uuid4().hex}")
        return bool(fs.rename(lock, gone))

    def exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return bool(fs.exists(path))

    def make(self, name: str) -> None:
        fs, path = self._path(name)
        fs.mkdirs(path)

    def move(self, name: str, to: str) -> bool:
        """Move a file or folder to a name that isn't taken; False if it's gone or taken."""
        fs, path = self._path(name)
        _, target = self._path(to)
        if fs.exists(target):
            return False
        fs.mkdirs(target.getParent())
        try:
            return bool(fs.rename(path, target))
        except Exception:
            return False

    def size(self, name: str) -> int:
        """Bytes of all files under a name."""
        fs, path = self._path(name)
        return int(fs.getContentSummary(path).getLength()) if fs.exists(path) else 0

    def delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)


class Store:
    """An open store; see the module's text for its layout.

    ``encryption_key`` (32 bytes) encrypts values at rest by AES-256-GCM; a
    store is opened with the key it was made with.  ``logger`` gets one line
    per operation, with keys as fingerprints and values as lengths.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema_version: int = 1,
        on_upgrade: Callable[[Store, int, int], None] | None = None, sync: str = "full",
        encryption_key: bytes | None = None, logger: logging.Logger | None = None, cache: bool = False,
    ) -> None:
        if sync not in SYNC_MODES:
            raise DocloomError(f"unknown sync mode {sync}")
        if encryption_key is not None and len(encryption_key) != 32:
            raise DocloomError("an encryption key has 32 bytes")
        self.spark, self.path, self.sync, self.closed = spark, path.rstrip("/"), sync, False
        self.encryption_key, self.logger = encryption_key, logger
        self.cache, self._cached = cache, None
        self.counters = {"commits": 0, "conflicts": 0, "reads": 0, "cache_hits": 0}
        self.files = Files(spark, self.path)
        if self.version() < 0:
            first = {"version": 0, "snapshot": None, "snapshot_version": 0, "segments": [], "indexes": [], "schema_version": schema_version, "seq": 0}
            self.files.make("log")
            self._publish(0, first | {"encrypted": encryption_key is not None})
            return
        if self.manifest().get("encrypted", False) != (encryption_key is not None):
            raise DocloomError("the store is encrypted and needs its key" if encryption_key is None else "the store isn't encrypted")
        stored = self.manifest()["schema_version"]
        if stored > schema_version:
            raise SchemaVersionError(f"the store has schema version {stored}, newer than {schema_version}")
        if stored < schema_version:
            if on_upgrade is None:
                raise SchemaVersionError(f"schema version {stored} needs an upgrade to {schema_version}")
            on_upgrade(self, stored, schema_version)
            self._change(lambda m: m | {"schema_version": schema_version})

    # -- manifests

    def version(self) -> int:
        """The newest committed version; -1 for an empty folder."""
        names = [n for n in self.files.list("manifests") if n.endswith(".json")]
        return int(names[-1].split(".")[0]) if names else -1

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        self._check_open()
        return json.loads(self.files.read(f"manifests/{self.version() if version is None else version:012d}.json"))

    def _publish(self, version: int, manifest: dict[str, Any]) -> None:
        if not self.files.create(f"manifests/{version:012d}.json", json.dumps(manifest)):
            raise ConflictError(f"version {version} was committed by another writer")

    def _change(self, edit: Callable[[dict[str, Any]], dict[str, Any]], attempts: int = 20) -> dict[str, Any]:
        """Publish an edit of the newest manifest, again if another commit came first."""
        for n in range(attempts):
            old = self.manifest()
            new = edit(old) | {"version": old["version"] + 1}
            try:
                self._publish(new["version"], new)
                return new
            except ConflictError:
                time.sleep(0.005 * 2 ** min(n, 6))
        raise ConflictError("other writers kept committing first")

    def _check_open(self) -> None:
        if self.closed:
            raise ClosedError("the store is closed")

    def close(self) -> None:
        self.closed = True
        self._uncache()

    # -- state

    def log(self, version: int | None = None, after: int = -1) -> DataFrame:
        """Log entries of segments committed after version ``after``."""
        m = self.manifest(version)
        self.counters["reads"] += 1
        self._settle(m)
        names = [s["name"] for s in m["segments"] if s["version"] > after]
        if after < 0 and m["snapshot"]:
            names = [m["snapshot"], *names]
        if not names:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.plain(self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names]))

    def _settle(self, m: dict[str, Any]) -> None:
        """Move the newest committed segment to the log if its committer didn't."""
        if m["segments"] and not self.files.exists(m["segments"][-1]["name"]):
            last = m["segments"][-1]
            if not self.files.move(last["staged"], last["name"]) and not self.files.exists(last["name"]):
                raise DocloomError(f"segment {last['name']} is lost")

    def plain(self, rows: DataFrame) -> DataFrame:
        """Log rows with their values decrypted."""
        if self.encryption_key is None:
            return rows
        return rows.withColumn("value", scalar.decrypted(F.unbase64("value"), self.encryption_key).cast("string"))

    def _say(self, what: str, *parts: str) -> None:
        if self.logger is not None:
            self.logger.info("%s %s", what, " ".join(parts))

    def rows(self, version: int | None = None) -> DataFrame:
        """(key, value, expires_at): the latest entry of each key; value is JSON text.

        With ``cache``, Spark keeps the newest version that was read, in memory
        and on disk as there is room, until another one is read or the store
        is closed.
        """
        if not self.cache:
            return kv.latest(self.log(version), ["value", "expires_at"])
        self._check_open()
        version = self.version() if version is None else version
        if self._cached and self._cached[0] == version:
            self.counters["cache_hits"] += 1
            return self._cached[1]
        found = kv.latest(self.log(version), ["value", "expires_at"])
        if self._cached and self._cached[0] > version:
            return found
        self._uncache()
        self._cached = (version, found.persist())
        return found

    def _uncache(self) -> None:
        if self._cached:
            self._cached[1].unpersist()
            self._cached = None

    def state(self, version: int | None = None) -> DataFrame:
        """(key, value, expires_at) with values as VARIANT."""
        return self.rows(version).withColumn("value", F.parse_json("value"))

    # -- writes

    def _segment(self, rows: DataFrame, seq: int) -> str:
        """Write (key, value, tombstone, expires_at) as a new segment; its name."""
        name = f"staging/{uuid.uuid4().hex}"
        out = rows.select("key", "value", "tombstone", "expires_at", F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("ts"))
        self._secret(out).write.parquet(f"{self.path}/{name}")
        return name

    def _secret(self, rows: DataFrame) -> DataFrame:
        """Rows as they are stored: encrypted if the store has a key."""
        if self.encryption_key is None:
            return rows
        return rows.withColumn("value", F.base64(scalar.encrypted(F.col("value").cast("binary"), self.encryption_key)))

    def commit(self, rows: DataFrame, check: Callable[[dict[str, Any]], None] | None = None) -> int:
        """Append (key, value, tombstone, expires_at) rows as one atomic commit; its version.

        Keys are unique within ``rows``.  ``check`` sees the manifest that the
        commit builds on and may raise ``ConflictError``.
        """
        base = self.manifest()
        for n in range(20):
            staged = self._segment(rows, base["seq"] + 1)
            try:
                self._settle(base)
                if check:
                    check(base)
            except BaseException:
                self.files.delete(staged)
                raise
            version = base["version"] + 1
            entry = {"name": f"log/{version:012d}", "staged": staged, "version": version, "seq": base["seq"] + 1}
            try:
                new = base | {"version": version, "segments": [*base["segments"], entry], "seq": base["seq"] + 1}
                self._publish(version, new)
                self._settle(new)
                self.counters["commits"] += 1
                self._say("commit", f"version={version}")
                return version
            except ConflictError:
                self.counters["conflicts"] += 1
                self.files.delete(staged)
                time.sleep(0.005 * 2 ** min(n, 6))
                base = self.manifest()
        raise ConflictError("other writers kept committing first")

    def _local(self, entries: Mapping[str, Any], expires_at: datetime | None = None) -> DataFrame:
        if self.logger is not None:
            for k, v in entries.items():
                self._say("delete" if v is _DELETED else "put", scalar.redact_key(k), *([] if v is _DELETED else [scalar.redact_value(v)]))
        data = [(kv.check_key(k), None if v is _DELETED else encode_value(v), v is _DELETED, None if v is _DELETED else expires_at) for k, v in entries.items()]
        return self.spark.createDataFrame(data, "key string, value string, tombstone boolean, expires_at timestamp")

    def put(self, key: str, value: Any, ttl: float | None = None, expires_at: datetime | None = None) -> int:
        return self.put_batch({key: value}, ttl, expires_at)

    def put_batch(self, entries: Mapping[str, Any], ttl: float | None = None, expires_at: datetime | None = None) -> int:
        """Upsert all entries in one commit; ``expires_at`` wins over ``ttl`` seconds."""
        if expires_at is None and ttl is not None:
            expires_at = kv.utc_now() + timedelta(seconds=ttl)
        return self.commit(self._local(entries, expires_at))

    def delete(self, key: str) -> int:
        return self.delete_batch([key])

    def delete_batch(self, keys: Sequence[str]) -> int:
        return self.commit(self._local(dict.fromkeys(keys, _DELETED)))

    def append(self, rows: DataFrame) -> int:
        """Upsert a DataFrame (key, value as JSON text[, expires_at]) in one commit."""
        expires = F.col("expires_at") if "expires_at" in rows.columns else F.lit(None).cast("timestamp")
        return self.commit(rows.select("key", "value", F.lit(False).alias("tombstone"), expires.alias("expires_at")))

    def purge_expired(self) -> int:
        """Delete rows that have expired, in one commit; how many."""
        gone = kv.purge(self.rows()).persist()
        try:
            n = gone.count()
            if n:
                self.commit(gone.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), F.lit(None).cast("timestamp").alias("expires_at")))
            return n
        finally:
            gone.unpersist()

    def compare_and_swap(self, key: str, expected: Any, new: Any) -> bool:
        """Put ``new`` if the value equals ``expected`` at the moment of the commit."""
        for _ in range(20):
            version = self.version()
            if not values_equal(self.get(key, version), expected):
                return False
            try:
                self.commit(self._local({key: new}), lambda base, v=version: self._check_unchanged({key}, v, base))
                return True
            except ConflictError:
                continue
        raise ConflictError(f"{kv.check_key(key)!r} kept changing")

    def _check_unchanged(self, keys: set[str], since: int, base: dict[str, Any]) -> None:
        if base["version"] == since:
            return
        if base.get("snapshot_version", 0) > since:
            raise ConflictError("the log was compacted meanwhile")
        changed = self.log(base["version"], after=since).where(F.col("key").isin(sorted(keys)))
        if not changed.isEmpty():
            raise ConflictError("a key was changed by another commit")

    # -- reads

    def get(self, key: str, version: int | None = None) -> Any:
        """The live value of a key as a Python value, or None."""
        row = kv.lookup(self.rows(version), key).select("value").first()
        self._say("get", scalar.redact_key(key), "miss" if row is None else "hit")
        return None if row is None else json.loads(row.value)

    def get_batch(self, keys: Sequence[str]) -> dict[str, Any]:
        found = {r.key: r.value for r in kv.get_batch(self.rows(), keys).collect()}
        return {k: None if found.get(k) is None else json.loads(found[k]) for k in keys}

    def exists(self, key: str) -> bool:
        return kv.exists(self.rows(), key)

    def scan(self, start: str | None = None, end: str | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
        return kv.scan(self.state(), start, end, limit, reverse)

    def scan_prefix(self, prefix: str, limit: int | None = None, reverse: bool = False) -> DataFrame:
        return kv.scan_prefix(self.state(), prefix, limit, reverse)

    def keys(self, prefix: str | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
        return kv.keys(self.rows(), prefix, limit, reverse)

    def range(self, start: str | None = None, end: str | None = None, limit: int | None = None, reverse: bool = False) -> list[tuple[str, Any]]:
        rows = kv.scan(self.rows(), start, end, limit, reverse).collect()
        return [(r.key, json.loads(r.value)) for r in rows]

    def match(self, pattern: str) -> DataFrame:
        """Rows by pattern: ``*``, ``prefix*``, an exact key, or ``*`` and ``?`` anywhere."""
        return kv.match(self.state(), pattern)

    def count(self, pattern: str = "*") -> int:
        return kv.match(self.rows(), pattern).count()

    def clear(self) -> int:
        """Delete every key in one commit; how many."""
        every = kv.visible(self.rows()).select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), F.lit(None).cast("timestamp").alias("expires_at"))
        n = every.count()
        if n:
            self.commit(every)
        return n

    def info(self) -> dict[str, Any]:
        """Entry count, layout, sizes in bytes, and this instance's counters."""
        m = self.manifest()
        return {
            "entries": kv.visible(self.rows()).count(), "version": m["version"], "segments": len(m["segments"]), "schema_version": m["schema_version"],
            "indexes": [IndexDefinition(c, tuple(f)).name for c, f in m["indexes"]], "encrypted": self.encryption_key is not None,
            "bytes": {part: self.files.size(part) for part in ("log", "snapshots", "index")}, **self.counters,
        }

    # -- names of the simple interface

    def put_all(self, entries: Mapping[str, Any], ttl: float | None = None) -> int:
        return self.put_batch(entries, ttl)

    def get_all(self, pattern: str = "*") -> dict[str, Any]:
        """Live entries whose key matches, as Python values."""
        return {r.key: json.loads(r.value) for r in kv.match(self.rows(), pattern).collect()}

    def delete_all(self, pattern: str = "*") -> int:
        """Delete the live keys that match, in one commit; how many."""
        gone = kv.match(self.rows(), pattern).select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), F.lit(None).cast("timestamp").alias("expires_at")).persist()
        try:
            n = gone.count()
            if n:
                self.commit(gone)
            return n
        finally:
            gone.unpersist()

    def where(self, collection: str, field: str, op: str, value: Any = None) -> DocQuery:
        return self.query(collection).where(field, op, value)

    def scan_documents(self, name: str) -> DataFrame:
        """(_id, doc) of a collection's live documents, by id."""
        return self.collection(name).df.orderBy("_id")

    def scan_document_ids(self, name: str) -> DataFrame:
        """(_id) of a collection's live documents, in order."""
        return self.collection(name).df.select("_id").orderBy("_id")

    # -- documents

    def collection(self, name: str, version: int | None = None) -> Collection:
        """The documents ``name:<id>`` as a dynamic collection (_id, doc)."""
        if not name or ":" in name:
            raise InvalidKeyError("a collection's name isn't empty and holds no colon")
        m = self.manifest(version)
        docs = self._documents(kv.visible(self.rows(m["version"])), name)
        indexes = tuple((IndexDefinition(c, tuple(f)), self._postings(m, c, f)) for c, f in m["indexes"] if c == name)
        return Collection(name, docs.select("_id", "doc"), ("_id",), "doc", indexes, lambda changes, hit: self._write_documents(name, changes, hit))

    def _documents(self, rows: DataFrame, name: str) -> DataFrame:
        """(_id, value, doc, expires_at) of a collection's documents among rows (key, value, expires_at)."""
        own = rows.where(F.col("key").startswith(f"{name}:"))
        docs = own.select(F.expr(f"substring(key, {len(name) + 2})").alias("_id"), "value", F.parse_json("value").alias("doc"), "expires_at")
        return docs.where("_id <> ''").where(F.schema_of_variant("doc").startswith("OBJECT"))

    def query(self, name: str) -> DocQuery:
        return DocQuery(self.collection(name))

    def document(self, name: str, identity: str) -> Any:
        return self.get(f"{name}:{identity}")

    def _write_documents(self, name: str, changes: dict[str, Any] | None, hit: DataFrame) -> int:
        """Update (shallow merge, expiry dropped) or delete matched documents, as one commit."""
        key = F.concat(F.lit(f"{name}:"), F.col("_id"))
        rows = hit.select(key.alias("key"), F.to_json("doc").alias("value"))
        if changes is None:
            rows = rows.withColumn("value", F.lit(None).cast("string"))
        else:
            fields = F.lit(encode_value(changes))
            merged = F.map_concat(_entries(F.col("value"), [*changes]), F.from_json(fields, "map<string,variant>"))
            rows = rows.withColumn("value", F.to_json(merged))
        rows = rows.select("key", "value", F.lit(changes is None).alias("tombstone"), F.lit(None).cast("timestamp").alias("expires_at")).persist()
        try:
            n = rows.count()
            if n:
                self.commit(rows)
            return n
        finally:
            rows.unpersist()

    # -- indexes

    def create_index(self, collection: str, fields: Sequence[str]) -> IndexDefinition:
        """Register an index and store its postings for the current version."""
        definition = IndexDefinition(collection, tuple(fields))
        if not fields:
            raise QueryError("an index has at least one field")

        def add(m: dict[str, Any]) -> dict[str, Any]:
            if [collection, list(fields)] in m["indexes"]:
                raise QueryError(f"index {definition.name} exists")
            return m | {"indexes": [*m["indexes"], [collection, list(fields)]]}

        made = self._change(add)
        self.refresh_index(definition, made["version"])
        return definition

    def refresh_index(self, definition: IndexDefinition, version: int | None = None) -> None:
        """Store an index's postings for a version, sorted by key."""
        if self.encryption_key is not None:
            return  # values in clear don't go to disk; postings are derived when they are read
        version = self.version() if version is None else version
        table = self._derived(self.rows(version), definition)
        keys = [c for c in table.columns if c.startswith("k")]
        path = f"{self.path}/index/{_folder(definition)}/{version:012d}"
        table.repartitionByRange(*keys).sortWithinPartitions(*keys, "_id").write.mode("overwrite").parquet(path)

    def _derived(self, rows: DataFrame, definition: IndexDefinition) -> DataFrame:
        """(k0, k1, ..., _id, value, expires_at): postings of rows (key, value, expires_at), which cover the documents."""
        return postings(self._documents(rows, definition.collection), definition.fields, "doc", keep=("value", "expires_at"))

    def _postings(self, manifest: dict[str, Any], collection: str, fields: Sequence[str]) -> DataFrame:
        """(k0, k1, ..., _id, doc) of live documents, whole and fresh for the manifest's version.

        Stored postings serve the documents that no later commit touched; the
        others' are derived from the log.  Postings older than the snapshot
        can't tell what it folded in, and aren't used.
        """
        definition = IndexDefinition(collection, tuple(fields))
        version, rows = manifest["version"], self.rows(manifest["version"])
        stored = [int(v) for v in self.files.list(f"index/{_folder(definition)}")]
        good = [v for v in stored if manifest.get("snapshot_version", 0) <= v <= version]
        if not good or self.encryption_key is not None:
            table = self._derived(rows, definition)
        else:
            table = self.spark.read.parquet(f"{self.path}/index/{_folder(definition)}/{good[-1]:012d}")
            if any(s["version"] > good[-1] for s in manifest["segments"]):
                later = self.log(version, after=good[-1])
                own = later.where(F.col("key").startswith(f"{collection}:")).select(F.expr(f"substring(key, {len(collection) + 2})").alias("_id")).distinct()
                newest = self._derived(kv.latest(later, ["value", "expires_at"]), definition)
                table = table.join(own, "_id", "left_anti").unionByName(newest)
        keys = [f"k{i}" for i in range(len(fields))]
        return table.where(exprs.live(F.col("expires_at"), kv.utc_now())).select(*keys, "_id", F.parse_json("value").alias("doc"))

    def drop_index(self, collection: str, fields: Sequence[str]) -> None:
        def remove(m: dict[str, Any]) -> dict[str, Any]:
            if [collection, list(fields)] not in m["indexes"]:
                raise QueryError("no such index")
            return m | {"indexes": [i for i in m["indexes"] if i != [collection, list(fields)]]}

        self._change(remove)
        self.files.delete(f"index/{_folder(IndexDefinition(collection, tuple(fields)))}")

    def list_indexes(self, collection: str | None = None) -> list[IndexDefinition]:
        return [IndexDefinition(c, tuple(f)) for c, f in self.manifest()["indexes"] if collection in (None, c)]

    def has_index(self, collection: str, field: str) -> bool:
        """Whether an index of the collection leads with this field."""
        return any(i.fields[0] == field for i in self.list_indexes(collection))

    # -- layout

    def compact(self, partitions: int | None = None) -> int:
        """Fold the log into one snapshot sorted by key; the new version.

        The snapshot keeps expired rows until they are purged.  Old segments
        stay for readers of older versions.
        """
        base = self.manifest()
        if not base["segments"]:
            return base["version"]
        seq = base["seq"]
        rows = self.rows(base["version"]).select("key", "value", F.lit(False).alias("tombstone"), "expires_at", F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("ts"))
        name = f"snapshots/{uuid.uuid4().hex}"
        dealt = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
        # A Bloom filter of each row group's keys, of a size that fits them, lets a lookup skip it.
        bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        self._secret(dealt.sortWithinPartitions("key")).write.options(**bloom).parquet(f"{self.path}/{name}")

        def swap(m: dict[str, Any]) -> dict[str, Any]:
            if m["snapshot"] != base["snapshot"]:
                raise ConflictError("another compaction came first")
            later = [s for s in m["segments"] if s["version"] > base["version"]]
            return m | {"snapshot": name, "snapshot_version": base["version"], "segments": later}

        made = self._change(swap)["version"]
        for collection, fields in self.manifest(made)["indexes"]:
            self.refresh_index(IndexDefinition(collection, tuple(fields)), made)
        return made

    flush = compact

    # -- changes

    def changes(self, after: int = -1) -> DataFrame:
        """(seq, type, key, value, ts) of commits after a version, with values as VARIANT."""
        log = self.log(after=after)
        kind = F.when(F.col("tombstone"), F.lit("delete")).otherwise(F.lit("put"))
        return log.select("seq", kind.alias("type"), "key", F.parse_json("value").alias("value"), "ts")

    # -- transactions

    def transaction(self, body: Callable[[Transaction], Any], isolation: str = "serializable", attempts: int = 3) -> Any:
        """Run ``body`` on staged writes and commit them at once; run again on a conflict."""
        for n in range(attempts):
            tx = Transaction(self, isolation)
            result = body(tx)
            try:
                tx.commit()
                return result
            except ConflictError:
                if n + 1 == attempts:
                    raise
                time.sleep(0.005 * 2**n)
        raise ConflictError("no attempt was allowed")


class Transaction:
    """Staged writes over one snapshot; commits fail if a written key changed meanwhile.

    ``read_committed`` reads the newest version each time; the other levels
    read the version they began with and also fail if a key they read changed.
    """

    def __init__(self, store: Store, isolation: str) -> None:
        if isolation not in ISOLATION:
            raise DocloomError(f"unknown isolation level {isolation}")
        self.store, self.isolation, self.base = store, isolation, store.version()
        self.writes: dict[str, tuple[Any, datetime | None]] = {}
        self.reads: set[str] = set()

    def get(self, key: str) -> Any:
        if key in self.writes:
            value = self.writes[key][0]
            return None if value is _DELETED else value
        if self.isolation == "read_committed":
            return self.store.get(key)
        self.reads.add(key)
        return self.store.get(key, self.base)

    def put(self, key: str, value: Any, ttl: float | None = None, expires_at: datetime | None = None) -> None:
        encode_value(value)
        if expires_at is None and ttl is not None:
            expires_at = kv.utc_now() + timedelta(seconds=ttl)
        self.writes[kv.check_key(key)] = (value, expires_at)

    def delete(self, key: str) -> None:
        self.writes[kv.check_key(key)] = (_DELETED, None)

    def commit(self) -> int | None:
        if not self.writes:
            return None
        guarded = set(self.writes) | (self.reads if self.isolation != "read_committed" else set())
        if self.isolation == "read_committed":
            guarded = set()
        parts = [self.store._local({k: v}, e) for k, (v, e) in self.writes.items()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return self.store.commit(rows, lambda base: self.store._check_unchanged(guarded, self.base, base) if guarded else None)


def encode_value(value: Any) -> str:
    """A value as JSON text; raises for what JSON doesn't have."""
    if not is_storable(value):
        raise SerializationError("a value is made of null, booleans, finite numbers, strings, lists and maps with string keys")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _entries(text, without: Sequence[str]):
    """A JSON object's entries as a map of VARIANT, without some keys."""
    return F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, v: ~k.isin(list(without)))


def _folder(definition: IndexDefinition) -> str:
    return f"{definition.collection}/{'+'.join(definition.fields)}"
