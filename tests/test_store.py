from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docloom.errors import ArchiveError, ClosedError, ConflictError, InvalidKeyError, QueryError, SchemaVersionError, SerializationError
from docloom.functions import scalar
from docloom.sources.archive import export_to, import_from
from docloom.sources.store import Store
from docloom.sources.typed import TypedCollection
from docloom.streaming import live


def test_key_value_reads_and_writes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_batch({"city:berlin": 1, "city:london": {"a": 2}, "city:oslo": None, "country:pt": "x", "counter": 3})
    assert s.get("city:london") == {"a": 2} and s.get("nope") is None and s.exists("city:oslo")
    assert s.get_batch(["counter", "nope"]) == {"counter": 3, "nope": None}
    assert [r.key for r in s.scan_prefix("city:").collect()] == ["city:berlin", "city:london", "city:oslo"]
    assert [k for k, _ in s.range("city:l", "city:p")] == ["city:london", "city:oslo"]
    assert [r.key for r in s.keys("city:", limit=1, reverse=True).collect()] == ["city:oslo"]
    assert s.count("city:*") == 3 and s.count() == 5 and s.count("c?y:*o") == 1
    s.delete("counter")
    assert s.get("counter") is None and s.info()["entries"] == 4
    for bad in ("", "\x00a"):
        with pytest.raises(InvalidKeyError):
            s.put(bad, 1)
    with pytest.raises(SerializationError):
        s.put("k", {"x": float("nan")})
    s.compact()
    assert s.get("city:berlin") == 1 and s.info()["segments"] == 0
    assert s.clear() == 4 and s.count() == 0
    s.close()
    with pytest.raises(ClosedError):
        s.get("a")


def test_expiry(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("a", 1, expires_at=datetime.now(timezone.utc) - timedelta(seconds=1))
    s.put("b", 2, ttl=3600)
    assert s.get("a") is None and s.get("b") == 2 and s.purge_expired() == 1 and s.purge_expired() == 0


def test_documents_and_indexes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_batch({"users:uuid-abc": {"name": "ana", "age": 30}, "users:5000": {"name": "bob", "age": 25}, "users:7": {"name": "eve", "age": 30}, "users:list": [1]})
    assert s.query("users").count() == 3 and s.query("users").where_equals("name", "ana").count() == 1
    s.create_index("users", ["age"])
    assert s.has_index("users", "age") and not s.has_index("users", "name")
    with pytest.raises(QueryError):
        s.create_index("users", ["age"])
    ids = lambda q: sorted(r["_id"] for r in q.to_df().collect())
    assert ids(s.query("users").where_equals("age", 30)) == ["7", "uuid-abc"]
    assert s.query("users").where_equals("age", 30).update({"age": 31, "new": True}) == 2
    assert ids(s.query("users").where_equals("age", 31)) == ["7", "uuid-abc"] and s.document("users", "7") == {"name": "eve", "age": 31, "new": True}
    assert s.query("users").where_greater_than("age", 30).order_by("_x").limit(1).delete() == 1 and s.query("users").count() == 2
    s.drop_index("users", ["age"])
    with pytest.raises(QueryError):
        s.drop_index("users", ["age"])


def test_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("a", 1)

    def move(tx):
        tx.put("b", tx.get("a") + 1)
        assert tx.get("b") == 2
        tx.delete("a")

    s.transaction(move)
    assert s.get("a") is None and s.get("b") == 2
    tries = []

    def contested(tx):
        n = tx.get("b")
        tries.append(n)
        if len(tries) == 1:
            s.put("b", 10)
        tx.put("b", n + 1)

    s.transaction(contested)
    assert tries == [2, 10] and s.get("b") == 11
    with pytest.raises(ConflictError):
        s.transaction(lambda tx: (tx.get("b"), s.put("b", 0), tx.put("c", 1)), attempts=1)
    assert s.get("c") is None
    assert s.compare_and_swap("b", 0.0, 5) and not s.compare_and_swap("b", 0, 6) and s.get("b") == 5


def test_schema_versions(spark, tmp_path):
    path, seen = str(tmp_path / "s"), []
    Store(spark, path)
    with pytest.raises(SchemaVersionError):
        Store(spark, path, schema_version=2)
    Store(spark, path, schema_version=2, on_upgrade=lambda s, a, b: seen.append((a, b)))
    with pytest.raises(SchemaVersionError):
        Store(spark, path, schema_version=1)
    assert seen == [(1, 2)]


def test_archive_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_batch({"people:1": {"city": "Oslo"}, "people:2": {"city": "Lima"}, "config": {"x": 1}, "counter": 1})
    s.create_index("people", ["city"])
    assert export_to(s, str(tmp_path / "a")) == 4
    t = import_from(spark, str(tmp_path / "a"), str(tmp_path / "t"))
    assert t.query("people").where_equals("city", "Oslo").count() == 1 and t.has_index("people", "city") and t.count() == 4
    with pytest.raises(ArchiveError):
        import_from(spark, str(tmp_path / "a"), str(tmp_path / "t"))
    spark.createDataFrame([("evil", "1", None)], "key string, value string, expires_at timestamp").write.mode("append").parquet(str(tmp_path / "a/rows"))
    with pytest.raises(ArchiveError):
        import_from(spark, str(tmp_path / "a"), str(tmp_path / "u"))


def test_typed_collection(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    c = TypedCollection(s, "employees", "name string, department string, salary int")
    c.put_all({"1": {"name": "Ada", "department": "Engineering", "salary": 95000}, "2": {"name": "Bo", "department": "Engineering", "salary": 80000}, "3": {"name": "Cy", "department": "Sales", "salary": 99000}})
    q = c.query().where_equals("department", "Engineering").where_greater_than_or_equal("salary", 90000).order_by("salary", descending=True)
    assert [r.name for r in q.find().collect()] == ["Ada"] and c.count() == 3 and c.get("1")["name"] == "Ada"
    assert c.query().where_equals("name", "Bo").update({"salary": 1}) == 1 and c.get("2")["salary"] == 1
    assert [x["name"] for x in c.all()] == ["Ada", "Bo", "Cy"]
    assert c.changes("2").where("type = 'put'").count() == 2


def test_watch(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("users:1", 1)
    s.put_batch({"orders:1": 2, "users:2": 3})
    s.delete("users:1")
    got = []
    hub = live.Hub()
    hub.listen(live.watch(s, "users:*"), lambda b, _: got.extend((r.type, r.key) for r in b.collect())).awaitTermination()
    assert sorted(got) == [("delete", "users:1"), ("put", "users:1"), ("put", "users:2")]
    hub.close()
    with pytest.raises(ClosedError):
        hub.listen(live.watch_key(s, "a"), print)


def test_encryption_and_redaction(spark):
    key, salt = scalar.derive_key("secret", iterations=1000)
    assert scalar.derive_key("secret", salt, 1000)[0] == key and len(key) == 32
    df = spark.createDataFrame([("héllo",)], "v string").withColumn("e", scalar.encrypted(F.col("v"), key))
    r = df.select("e", scalar.decrypted(F.col("e"), key).cast("string").alias("d"), scalar.redacted_key(F.col("v")).alias("k"), scalar.checksum(F.col("v")).alias("c")).first()
    assert bytes(r.e[:2]) == b"\x01\x02" and r.d == "héllo" and r.k.endswith("(len=5)") and len(r.e) == 2 + 12 + 6 + 16 and r.c > 0


def ids(q):
    return sorted(r["_id"] for r in q.to_df().collect())


def test_indexes_stay_right_through_commits_and_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_batch({f"u:{i}": {"age": i % 5, "city": f"c{i % 3}"} for i in range(40)} | {"v:1": {"age": 1}})
    s.create_index("u", ["age"])
    s.create_index("u", ["city", "age"])

    def agree():
        for q in (s.query("u").where_equals("age", 3), s.query("u").where_between("age", 2, 3), s.query("u").where_in("age", [0, "x", None]), s.query("u").where_equals("city", "c1").where_greater_than("age", 2), s.query("u").where_less_than("age", 1)):
            by_scan = sorted(r["_id"] for r in q.to_df(use_indexes=False).collect())
            assert ids(q) == by_scan
        return ids(s.query("u").where_equals("age", 3))

    before = agree()
    s.put("u:new", {"age": 3})
    assert agree() == sorted([*before, "new"])
    s.compact()
    assert agree() == sorted([*before, "new"])
    s.put_batch({"u:new": [3], "u:3": {"age": 9}, "v:2": {"age": 3}})
    s.delete("u:8")
    assert agree() == sorted(set(before) - {"3", "8"})
    s.put("u:late", {"age": 3}, expires_at=datetime.now(timezone.utc) - timedelta(seconds=1))
    s.compact()
    s.put("u:z", {"age": 3})
    s.compact()
    assert agree() == sorted((set(before) - {"3", "8"}) | {"z"})


def test_an_index_read_skips_row_groups(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_batch({f"u:{i}": {"n": i, "t": f"t{i}"} for i in range(50)})
    s.create_index("u", ["n"])
    made = s.query("u").where_equals("n", 7).to_df()
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "k0.num" in pushed and "k0.cls" in pushed and plan.count("PushedFilters") == 1 and f"{s.path}/index" in plan


def test_commits_that_did_not_happen_are_never_seen(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("a", 1)
    s._segment(s._local({"ghost": 1}), 2)  # staged, without a manifest
    with pytest.raises(ConflictError):
        s.transaction(lambda tx: (tx.get("a"), s.put("a", 2), tx.put("lost", 1)), attempts=1)
    # A committer that was lost between its manifest and the move.
    staged, m = s._segment(s._local({"b": 3}), 3), s.manifest()
    s._publish(3, m | {"version": 3, "seq": 3, "segments": [*m["segments"], {"name": "log/000000000003", "staged": staged, "version": 3, "seq": 3}]})
    assert s.get("b") == 3 and s.get("ghost") is None
    got = []
    hub = live.Hub()
    hub.listen(live.watch(s), lambda b, _: got.extend((r.seq, r.key) for r in b.collect())).awaitTermination()
    assert sorted(got) == [(1, "a"), (2, "a"), (3, "b")]
    hub.close()


def test_a_lost_lock_is_taken_over(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    (tmp_path / "s/manifests/000000000001.json.lock").touch()
    assert not s.files.create("manifests/000000000001.json", "{}")
    assert s.files.create("manifests/000000000001.json", "{}", lock_seconds=0)
    assert not s.files.create("manifests/000000000001.json", "{}", lock_seconds=0)


def test_values_are_encrypted_at_rest(spark, tmp_path):
    from docloom.errors import DocloomError

    key, path = bytes(range(32)), str(tmp_path / "s")
    s = Store(spark, path, encryption_key=key)
    s.put_batch({"u:1": {"name": "secretive"}, "u:2": {"name": "other"}})
    s.create_index("u", ["name"])
    s.compact()
    s.put("u:3", {"name": "secretive"})
    stored = b"".join(f.read_bytes() for f in (tmp_path / "s").rglob("*") if f.is_file())
    assert b"secretive" not in stored
    again = Store(spark, path, encryption_key=key)
    assert ids(again.query("u").where_equals("name", "secretive")) == ["1", "3"] and again.get("u:2") == {"name": "other"}
    for wrong in (None, b"short"):
        with pytest.raises(DocloomError):
            Store(spark, path, encryption_key=wrong)
    with pytest.raises(Exception):
        Store(spark, path, encryption_key=bytes(32)).get("u:2")


def test_logging_is_redacted(spark, tmp_path, caplog):
    import logging

    logger = logging.getLogger("docloom-test")
    with caplog.at_level(logging.INFO, "docloom-test"):
        s = Store(spark, str(tmp_path / "s"), logger=logger)
        s.put("private-key", "private-value")
        s.get("private-key")
        s.delete("private-key")
    assert "private" not in caplog.text and "put key#" in caplog.text and "get key#" in caplog.text and "commit version=1" in caplog.text


def test_simple_names(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_all({"u:1": {"a": 1}, "u:2": {"a": 2}, "x": 1, "u:": {"a": 3}})
    assert s.get_all("u:?") == {"u:": {"a": 3}, "u:1": {"a": 1}, "u:2": {"a": 2}} and s.where("u", "a", "gt", 1).count() == 1
    assert [r["_id"] for r in s.scan_document_ids("u").collect()] == [r["_id"] for r in s.scan_documents("u").collect()] == ["1", "2"]
    assert s.delete_all("u:*") == 3 and s.count() == 1 and s.info()["commits"] == 2 and s.info()["bytes"]["log"] > 0


def test_cache_follows_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), cache=True)
    s.put("a", 1)
    old = s.version()
    assert s.get("a") == s.get("a") == 1 and s.info()["cache_hits"] >= 1
    s.put("a", 2)
    assert s.get("a") == 2 and s.get("a", old) == 1 and s.get("a") == 2
    s.close()
    assert s._cached is None
