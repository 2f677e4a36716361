import pytest
from pyspark.sql import functions as F

from weftline import codec, identity
from weftline.functions import text
from weftline.operators import graph, results
from weftline.plans.parametric import Plans
from weftline.streaming import readiness


def test_truncate_is_a_python_slice(spark):
    cases = [(t, top, bottom) for t in ("", "a", "a\nb", "a\nb\nc\nd\ne", "\n\n") for top in range(4) for bottom in range(7)]
    for top in range(4):
        for bottom in range(7):
            data = [(t,) for t, a, b in cases if (a, b) == (top, bottom)]
            got = spark.createDataFrame(data, "t string").select("t", text.truncate(F.col("t"), top, bottom).alias("x")).collect()
            for r in got:
                parts = r.t.split("\n")
                assert r.x == "\n".join(parts[top : len(parts) - bottom]), (r.t, top, bottom)


def test_chunks(spark):
    got = spark.createDataFrame([(bytearray(b"12345" * 100),), (bytearray(b""),)], "b binary").select(text.chunks(F.col("b"), 8).alias("c")).collect()
    assert len(got[0].c) == 63 and b"".join(map(bytes, got[0].c)) == b"12345" * 100
    assert [bytes(x) for x in got[1].c] == [b""]


def test_results(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    r = results.stop_if(results.ok(F.col("v")), lambda v: v > 3)
    up = results.strict(lambda v: v + 1, r)
    rows = df.select(up["value"].alias("v"), up["error"]["kind"].alias("e")).collect()
    assert [(x.v, x.e) for x in rows] == [(2, None), (None, "ExceptionRaised"), (None, None)]
    with pytest.raises(Exception):
        df.select(results.unwrap(r)).collect()


def test_columns_hash_like_values(spark):
    row = spark.createDataFrame([("bla",)], "t string").select(identity.constant_column("blob", F.col("t")).alias("h")).first()
    assert row.h == identity.constant("blob", b"bla")
    step = identity.function(0, "f", {"a": "blob", "b": "blob"}, {"out": "blob"}, False)
    handle = identity.handle(row.h, "root", "blob")
    got = spark.range(1).select(identity.operation_column(step, {"b": F.lit(handle), "a": F.lit(handle)}).alias("o")).withColumn("v", identity.variable_column("blob", F.col("o"), "out")).first()
    assert got.o == identity.operation(step, {"a": handle, "b": handle})
    assert got.v == identity.variable("blob", got.o, "out")


def _edges(spark):
    return spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "d")], "parent string, child string")


def _set(df):
    return {r[0] for r in df.select("n").collect()}


def test_graph(spark):
    e = _edges(spark)
    d = spark.createDataFrame([("d",)], "n string")
    assert _set(graph.ancestors(e, d)) == {"a", "b", "c", "x"}
    assert _set(graph.descendants(e, d)) == {"e"}
    assert _set(graph.roots(e)) == {"a", "x"}
    assert {(r.n, r.pending) for r in graph.build_dag(e, d).collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 1), ("d", 3)}
    assert {(r.n, r.level) for r in graph.levels(e, graph.roots(e)).collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    a = spark.createDataFrame([("b",)], "n string")
    assert _set(graph.between(e, a, spark.createDataFrame([("e",)], "n string"))) == {"b", "d", "e"}
    assert _set(graph.reset(e, a, spark.createDataFrame([("d",)], "n string"))) == {"b", "e"}
    assert graph.induced(e, spark.createDataFrame([("a",), ("b",)], "n string")).collect() == [("a", "b")]
    assert _set(graph.descendants(e, spark.createDataFrame([("e",)], "n string"))) == set()


def test_long_links(spark):
    links = spark.createDataFrame([(f"l{i}", f"l{i + 1}") for i in range(300)], "address string, `to` string")
    assert {r.target for r in graph.resolve_links(links).collect()} == {"l300"}


def test_levels_from_some_nodes(spark):
    e = _edges(spark)
    got = {(r.n, r.level) for r in graph.levels(e, spark.createDataFrame([("b",), ("d",)], "n string")).collect()}
    assert got == {("b", 0), ("d", 1), ("e", 2)}
    assert graph.levels(e, spark.createDataFrame([], "n string")).count() == 0
    assert {(r.n, r.level) for r in graph.levels(e).collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weft_edges_")]


def test_cycles_are_errors(spark):
    looped = _edges(spark).unionByName(spark.createDataFrame([("e", "c")], "parent string, child string"))
    with pytest.raises(ValueError):
        graph.levels(looped)
    assert _set(graph.descendants(looped, spark.createDataFrame([("d",)], "n string"))) == {"c", "d", "e"}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "address string, `to` string")
    with pytest.raises(ValueError):
        graph.resolve_links(links)


def test_timeouts_are_errors_of_rows(spark):
    from weftline.operators import shell

    rows = spark.createDataFrame([(0, "0"), (1, "5")], "i long, s string")
    got = {r.i: r for r in shell.over_rows(rows, ["sleep $(cat s)", "echo done"], {"s": "s"}, ["o"], timeout=2).collect()}
    assert got[0].error is None and got[0].stdouts[1] == b"done\n"
    assert got[1].error.kind == "JobTimedOut" and got[1].stdouts == [] and got[1].missing == ["o"]


def test_scratch_folders_go(spark):
    import os

    from weftline import scratch

    with scratch.scoped(spark):
        path = scratch.workspace(spark, "t")
        assert scratch.materialise(spark.range(3), f"{path}/a").count() == 3
        assert os.path.isdir(path[len("file://") :])
    assert not os.path.exists(path[len("file://") :])


def test_plans(spark):
    plans = Plans()
    h = plans.commit_sql("above", spark, "select id from range(10) where id > :least", least=7)
    assert plans.recall("above").count() == 2
    assert plans.recall(h, least=3).count() == 6
    with pytest.raises(AttributeError):
        plans.recall("above", most=1)


def test_readiness_stream(spark, tmp_path):
    for i, names in enumerate((["b", "x"], ["c", "b"])):
        spark.createDataFrame([(n,) for n in names], "op string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = spark.readStream.schema("op string").parquet(str(tmp_path / "in"))
    query = readiness.ready(done, _edges(spark)).writeStream.outputMode("update").format("memory").queryName("ready").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r.child, r.arrived, r.ready) for r in spark.table("ready").collect()}
    assert ("d", 3, True) in got


def test_python_functions_over_results(spark):
    from weftline.operators.functions import outputs, result_udf

    def inverse(x: int) -> float:
        return None if x == 1 else 10.0 / x

    def both(x: float) -> tuple[str, int]:
        return str(x), int(x)

    df = spark.createDataFrame([(2,), (1,), (0,)], "v long").select(result_udf(inverse)(results.ok(F.col("v"))).alias("r"))
    df = df.select("r", result_udf(both)(F.col("r")).alias("b"), result_udf(lambda p: "bad" if p[1] else "good", "string", strict=False)(F.col("r")).alias("lax"))
    rows = df.select("r", *outputs(F.col("b"), ["s", "i"]), "lax.value").collect()
    assert [r.r.value for r in rows] == [5.0, None, None]
    assert [r.r.error and r.r.error.kind for r in rows] == [None, "MissingOutput", "ExceptionRaised"]
    assert [(r.s.value, r.i.value) for r in rows] == [("5.0", 5), (None, None), (None, None)]
    assert rows[2].s.error == rows[2].r.error and rows[2].r.error.source.endswith("inverse")
    assert [r.value for r in rows] == ["good", "bad", "bad"]


def test_python_split_and_combine(spark):
    from weftline.operators import dynamic

    df = spark.createDataFrame([(1, "3 1 2"), (2, ""), (3, None)], "i long, t string")
    parts = dynamic.split_by(lambda t: [int(x) for x in t.split()], "long")
    total = dynamic.combine_by(lambda xs: sum(x * 10**k for k, x in enumerate(xs)), "long")
    got = dynamic.exploded(df, ["i"], parts(F.col("t")), lambda rows: rows.withColumn("value", F.col("part") + 1), total)
    assert {r.i: r.value for r in got.collect()} == {1: 324, 2: 0, 3: 0}


def test_whole_templates_over_columns(spark, monkeypatch):
    df = spark.createDataFrame([(" Ann ", ["a", "b"], True), ("Bob", [], False)], "name string, xs array<string>, on boolean")
    filled = text.rendered("{{name}}:{{#xs}}[{{.}}]{{/xs}}{{^on}}off{{/on}}{{missing}}", {"name": F.col("name"), "xs": F.col("xs"), "on": F.col("on")}, env={"missing": "WEFTLINE_NO_SUCH"})
    assert [r.v for r in df.select(filled.alias("v")).collect()] == ["Ann:[a][b]", "Bob:off"]


def test_valid_json(spark):
    """What is JSON as a whole, also where a variant can't hold it or a value begins a longer text."""
    import duckdb

    texts = ["4703443633947811 Words follow.", "{} x", "{},{}", "{}],[2", "1 2", '"a" "b"', '{"a":1,"a":2}', "[1,]", "[,]", "-NaN", "[" * 1500 + "]" * 1500, "9" * 1200, "1 // c"]
    texts += ['"\\ud800"', '"\\ud83d\\ude00"', '"\\\\"', '"a\nb"', "01", "", " ", "\r\n[1] ", "x", "[\x01]", '{"a" : [{}, {"b":null}], "c":"d"}', "[" * 3000, '["' + "\\n" * 20000 + '"]']
    con = duckdb.connect()
    want = [con.execute("SELECT json_valid(?::VARCHAR)", [t]).fetchone()[0] for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", codec.valid_json(F.col("t")).alias("v"), codec.decoded(F.col("t"), "s")["error"]["kind"].alias("e")).orderBy("i").collect()
    assert [r.v for r in got] == [*want, None]
    assert [r.e is None for r in got] == [*want, True]
