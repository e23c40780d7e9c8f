"""Every query that has SQL gives the rows of that SQL on the small tables."""

import datetime
import decimal
import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v}"
    return str(v)


def test_all_queries(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    wrong = []
    for name, sql in oracle.items():
        if name.startswith("op"):
            continue
        df = queries[name](spark, DATA)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()) if sorted(names) == cols else names
        if got != want:
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [(r["id"], round(r["score"], 6)) for r in rows] == [(146, -0.001171), (46, -0.038924), (133, -0.138659), (43, -0.170622)]


def test_distinct_users_keep_a_sketch_for_each_type_only(spark, tmp_path):
    from graphloom.plans import registry

    rows = [(i, "ab"[i % 2] if i % 7 else None, i % 50) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["approx_distinct_users"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("user_id" in line.split("functions=")[0] and "approx_count_distinct" in line for line in plan.splitlines() if "keys=[" in line)
    assert sorted(map(str, got.collect())) == sorted(f"Row(event_type={t!r}, near=True)" for t in ("a", "b", None))


def test_an_embedder_holds_few_vectors_at_once(spark):
    import pandas as pd

    from graphloom.functions import ml

    texts = pd.Series([f"text {i}" for i in range(700)] + [None])
    found = list(ml.embedder().func(iter([texts, texts[:0]])))
    assert [len(x) for x in found] == [256, 256, 189, 0]
    assert [v.tolist() for x in found for v in x] == [ml.byte_embedding(t or "") for t in texts]
