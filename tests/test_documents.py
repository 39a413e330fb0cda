"""Faults of documents, one by one."""

import pytest

from parlance.operators.documents import Field, faults

SCHEMA = [
    Field("v", "version", True, version=(1, 2)), Field("name", "text", True), Field("macros", "object", True), Field("macros.s", "number", True, -6.0, 6.0),
    Field("macros.n", "integer", low=0), Field("k", "text", choices=("a", "b")), Field("tags", "list"),
]
GOOD = '{"v":"1.0","name":"","macros":{"s":1.5}}'
CASES = {
    GOOD: [],
    '{"v":"1.9","name":"x","macros":{"s":7,"q":{"z":1}}}': [("macros.q", "unknown", None), ("macros.s", "range", "7")],
    "no": [("$", "document", None)],
    "": [("$", "document", None)],
    None: [("$", "document", None)],
    '{"a":1,"a":2}': [("$", "document", None)],
    "[1]": [("$", "type", "array")],
    "null": [("$", "type", "void")],
    "{}": [("macros", "missing", None), ("name", "missing", None), ("v", "missing", None)],
    '{"v":"2.0","name":3,"macros":{"n":-1},"k":"c","zz":{"y":1}}': [("k", "choice", "c"), ("macros.n", "range", "-1"), ("macros.s", "missing", None), ("name", "type", "bigint"), ("v", "version", "2.0"), ("zz", "unknown", None)],
    '{"v":"x","name":null,"macros":[],"tags":[]}': [("macros", "type", "array"), ("name", "missing", None), ("v", "version", "x")],
    '{"v":"1.0","name":"","macros":{"s":-6,"n":1.5}}': [("macros.n", "type", "decimal")],
    '{"v":"99999999999.0","name":"","macros":{"s":6e0}}': [("v", "version", "99999999999.0")],
}


@pytest.mark.parametrize("repeats", [1, 2])
def test_each_fault_has_its_path(spark, repeats):
    docs = list(CASES) * repeats
    rows = spark.createDataFrame([(i, d, "x", "y") for i, d in enumerate(docs)], "i int, d string, path string, doc__ string")
    got: dict = {i: [] for i in range(len(docs))}
    for r in faults(rows, ["i"], "d", SCHEMA).collect():
        got[r.i].append((r.path, r.fault, r.found))
    assert {i: sorted(f, key=str) for i, f in got.items()} == {i: sorted(CASES[d], key=str) for i, d in enumerate(docs)}


def test_long_and_empty(spark):
    long = '{"v":"1.0","name":"' + "n" * 1_000_000 + '","macros":{"s":0},"' + "u" * 1000 + '":' + "[" * 50 + "]" * 50 + "}"
    rows = spark.createDataFrame([(1, long)], "i int, d string")
    assert [tuple(r) for r in faults(rows, ["i"], "d", SCHEMA).collect()] == [(1, "u" * 1000, "unknown", None)]
    assert faults(rows.where("i > 1"), ["i"], "d", SCHEMA).collect() == []


def test_one_pass_without_a_shuffle(spark):
    plan = faults(spark.range(10).selectExpr("id", "'{}' AS d"), ["id"], "d", SCHEMA)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
