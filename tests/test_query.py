"""Query semantics on small typed and dynamic collections; both must agree."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.errors import QueryError
from docloom.operators.index import IndexDefinition, postings
from docloom.plans.query import Collection, DocQuery, typed
from docloom.values import compare_values, extract_field


def dynamic(spark, docs, name="c", index=()):
    rows = [(f"{i:03d}", json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "_id string, j string").select("_id", F.parse_json("j").alias("doc"))
    indexes = tuple((IndexDefinition(name, f), postings(df, f, "doc")) for f in index)
    return Collection(name, df, ("_id",), "doc", indexes)


def docs_of(df):
    return [json.loads(r.j) for r in df.select(F.to_json("doc").alias("j")).collect()]


MIXED = [10, 9.5, -3, "9", True, False, None, [1], {"k": 1}, "zz", 5, 5.0, [1, 2], {"k": 2}]


@pytest.fixture(scope="module")
def mixed(spark):
    return dynamic(spark, [{"v": v} for v in MIXED] + [{"w": 1}])


@pytest.mark.parametrize("op,sign", [("eq", (0,)), ("ne", (-1, 1)), ("gt", (1,)), ("gte", (0, 1)), ("lt", (-1,)), ("lte", (-1, 0))])
@pytest.mark.parametrize("literal", [9, None, True, "9", [1], {"k": 1}])
def test_comparisons_follow_the_total_order(mixed, op, sign, literal):
    want = sorted(json.dumps(d) for d in [{"v": v} for v in MIXED] + [{"w": 1}] if compare_values(extract_field(d, "v"), literal) in sign)
    got = sorted(json.dumps(d) for d in docs_of(DocQuery(mixed).where("v", op, literal).to_df()))
    normal = lambda xs: sorted(x.replace("5.0", "5") for x in xs)
    assert normal(got) == normal(want)


def test_dynamic_sort_places_nulls(mixed):
    got = [d.get("v") for d in docs_of(DocQuery(mixed).order_by("v").to_df())]
    want = sorted(MIXED + [None], key=__import__("functools").cmp_to_key(compare_values))
    assert [compare_values(a, b) for a, b in zip(got, want, strict=True)] == [0] * len(want)
    last = [d.get("v") for d in docs_of(DocQuery(mixed).order_by("v", nulls_last=True).to_df())]
    assert last[-2:] == [None, None] and last[0] is False


def test_dynamic_aggregates(spark):
    c = dynamic(spark, [{"cat": "a", "v": 10}, {"cat": "a", "v": 2.5}, {"cat": "b", "v": 7}, {"cat": "b", "v": "zz"}, {"v": 7.0}])
    r = DocQuery(c).aggregate(lambda a: a.sum("v").avg("v").min("v").max("v").count().count("cat").distinct("v")).execute_aggregation()
    r = r.select("sum_v", "avg_v", F.to_json("min_v").alias("lo"), F.to_json("max_v").alias("hi"), "count", "count_cat", "distinct_v").first()
    assert (r.sum_v, r.lo, r.hi, r["count"], r.count_cat, r.distinct_v) == (26.5, "2.5", '"zz"', 5, 4, 4)
    groups = DocQuery(c).aggregate(lambda a: a.group_by("cat").sum("v")).execute_aggregation()
    assert sorted((json.loads(g.j) if g.j else None, g.sum_v) for g in groups.select(F.to_json("cat").alias("j"), "sum_v").collect() if g.j) == [("a", 12.5), ("b", 7.0)]
    assert DocQuery(c).distinct("v").count() == 4


def typed_rows(spark, values, kind):
    return typed("t", spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_id int, v {kind}"))


def test_typed_null_rules(spark):
    c = typed_rows(spark, [None, 2, 1], "int")
    find = lambda q: [r.v for r in q.find().collect()]
    assert find(DocQuery(c).order_by("v", nulls_last=True)) == [1, 2, None]
    assert find(DocQuery(c).order_by("v", descending=True, nulls_last=True)) == [2, 1, None]
    assert find(DocQuery(c).order_by("v", descending=True)) == [None, 2, 1]
    assert set(find(DocQuery(c).where_less_than("v", 2))) == {None, 1}
    assert set(find(DocQuery(c).where_not_equals("v", 2))) == {None, 1}
    assert find(DocQuery(c).where_equals("v", None)) == [None]
    assert find(DocQuery(c).where_in("v", [2.0, 4])) == [2]
    assert find(DocQuery(c).where_in("v", [])) == []
    assert find(DocQuery(c).where_between("v", 3, 1)) == []
    assert find(DocQuery(c).where_greater_than("missing", 0)) == []
    assert len(find(DocQuery(c).where_less_than("missing", 0))) == 3


def test_typed_classes_fold(spark):
    c = typed_rows(spark, ["a", None], "string")
    assert DocQuery(c).where_greater_than("v", 9).count() == 1
    assert DocQuery(c).where_less_than("v", 9).count() == 1  # only the null
    assert DocQuery(c).where_equals("v", 9).count() == 0 and DocQuery(c).where_not_equals("v", 9).count() == 2


@pytest.mark.parametrize("value", [4.5, -4.5, 5, 5.0, 2**60, -(2**60), 0])
def test_integer_column_against_any_number(spark, value):
    xs = [-5, -4, 0, 4, 5, 6, None]
    c = typed_rows(spark, xs, "bigint")
    for op, sign in [("eq", (0,)), ("ne", (-1, 1)), ("gt", (1,)), ("gte", (0, 1)), ("lt", (-1,)), ("lte", (-1, 0))]:
        want = [x for x in xs if compare_values(x, value) in sign]
        got = [r.v for r in DocQuery(c).where("v", op, value).find().collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), (op, value)


def test_pushdown_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    q = typed("part", df, "p_partkey").query().where_greater_than("p_size", 9.5)
    plan = q.find().select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "p_name" not in plan.split("ReadSchema")[1]


def test_windows_and_errors(spark):
    c = typed_rows(spark, list(range(10)), "int")
    q = DocQuery(c).order_by("v").offset(3).limit(4)
    assert [r.v for r in q.find().collect()] == [3, 4, 5, 6] and q.count() == 4
    assert DocQuery(c).offset(20).count() == 0 and DocQuery(c).limit(0).find().count() == 0
    assert DocQuery(c).find_one().v == 0
    for bad in (lambda: DocQuery(c).limit(-1), lambda: DocQuery(c).offset(-1), lambda: DocQuery(c).where("v", "like", 1), lambda: DocQuery(c).execute_aggregation()):
        with pytest.raises(QueryError):
            bad()
    with pytest.raises(QueryError):
        DocQuery(c).where("v", "between", 3).find()


def test_contains_and_search(spark):
    df = spark.createDataFrame([("a", "Hello World", ["x", None], ("Deep",)), ("b", "other", [], (None,)), ("c", None, None, None)], "_id string, body string, tags array<string>, n struct<s:string>")
    c = typed("d", df)
    ids = lambda q: [r["_id"] for r in q.to_df().collect()]
    assert ids(DocQuery(c).where_contains("body", "World")) == ["a"] and ids(DocQuery(c).where_contains("body", "world")) == []
    assert ids(DocQuery(c).search("WORLD", "body")) == ["a"] and ids(DocQuery(c).search("deep")) == ["a"]
    assert ids(DocQuery(c).where_contains("tags", None)) == ["a"] and ids(DocQuery(c).where_contains("tags", "x")) == ["a"]
    d = dynamic(spark, [{"body": "Hello World", "m": {"s": "Deep"}, "l": ["Only"]}, {"l": [1, "x"]}])
    assert DocQuery(d).search("deep").count() == 1 and DocQuery(d).search("only").count() == 0
    assert DocQuery(d).where_contains("l", 1.0).count() == 1 and DocQuery(d).where_contains("body", "World").count() == 1


def test_nested_join(spark):
    orders = typed("orders", spark.createDataFrame([("o1", "u1", 5), ("o2", "u2", 9), ("o3", None, 1)], "_id string, userId string, total int"))
    users = typed("users", spark.createDataFrame([("k1", "u1", "ana"), ("k2", "u9", "zoe"), ("k3", None, "nul")], "_id string, id string, name string"))
    got = DocQuery(orders).order_by("total").join(users, "userId", "id").to_df().collect()
    got = {r["_id"]: r["_joined_users"] for r in got}
    assert [m.name for m in got["o1"]] == ["ana"] and got["o2"] is None and got["o3"] is None


def test_index_agrees_with_scan(spark):
    docs = [{"age": a, "city": "lima" if a % 2 else "quito", "even": a % 2 == 0} for a in range(20)] + [{"city": "lima"}, {"age": None}]
    c = dynamic(spark, docs, index=[("age",), ("city", "age")])
    for q in [
        DocQuery(c).where_greater_than("age", 10).order_by("age"),
        DocQuery(c).where_equals("city", "lima").where_greater_than("age", 5).where_less_than_or_equal("age", 15),
        DocQuery(c).where_in("age", [3, 4.0, None]),
        DocQuery(c).where_between("age", None, 3),
        DocQuery(c).where_equals("age", 99),
        DocQuery(c).where_equals("even", True),
    ]:
        rows = lambda df: sorted(r["_id"] for r in df.collect())
        assert rows(q.to_df(use_indexes=True)) == rows(q.to_df(use_indexes=False))
