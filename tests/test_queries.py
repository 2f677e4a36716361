"""Every query that has SQL gives the rows of that SQL."""

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        return None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr([plain(x) for x in r]) for r in zip(*(frame[c].tolist() for c in sorted(frame.columns))))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_targets_are_all_lines(spark, duck):
    """The graph queries against plain Python, with every line as target."""
    parents = {}
    for p, c in duck.sql(queries.EDGES).fetchall():
        parents.setdefault(c, set()).add(p)
    lines = {n for n in parents if n.startswith("l:")}
    up, todo = set(lines), list(lines)
    while todo:
        for p in parents.get(todo.pop(), ()):
            if p not in up:
                up.add(p)
                todo.append(p)
    down = {"r:0"}
    for kind in ("n:", "c:", "s:", "o:", "l:"):
        down |= {c for c, ps in parents.items() if c.startswith(kind) and ps & down}
    got = {name: queries.QUERIES[name](spark, SF).collect() for name in ("ancestors", "build_dag", "dag_dependents", "param_subgraph")}
    assert sorted(r.n for r in got["ancestors"]) == sorted(up - lines)
    assert {(r.n, r.pending) for r in got["build_dag"]} == {(n, len(parents.get(n, ()))) for n in up}
    assert sorted(r.n for r in got["dag_dependents"]) == sorted(n for n in up if "n:0" in parents.get(n, ()))
    assert sorted(r.n for r in got["param_subgraph"]) == sorted(up & down)
