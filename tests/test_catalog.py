"""Queries against their SQL, plans, and streams against batch."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return float("%.9g" % v) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert list(x) == [pytest.approx(v, rel=1e-7, abs=1e-9) if isinstance(v, float) else v for v in y]


def test_volatility_of_prices_of_zero_equals_sql(spark, tmp_path):
    """Bars that end at 0, one after another too, prices that do not move, below 0, and too few bars for a late part."""
    import json
    import random

    rng = random.Random(4)
    price = {"zero": lambda i: 0.0 if i in (30, 31, 150) else 50 + rng.random(), "late": lambda i: 0.0 if i == 150 else 50 + rng.random(), "flat": lambda i: 7.0,
             "below": lambda i: -1.0 if i == 60 else 50 + rng.random(), "plain": lambda i: 50 + rng.random(), "few": lambda i: 50 + rng.random()}
    made = [(coin, i, f(i)) for coin, f in price.items() for i in range(4 if coin == "few" else 200)]
    df = spark.createDataFrame([(n, i * 600, 1, coin, v, json.dumps({"k": 3})) for n, (coin, i, v) in enumerate(made)], "event_id bigint, s bigint, user_id bigint, event_type string, value double, props string")
    ts = F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts")
    df.select("event_id", ts, "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted((tuple(map(repr, r)) for r in con.execute(catalog.ORACLE_SQL["volatility_clustering"]).fetchall()))
    got = sorted(tuple(map(repr, r)) for r in catalog.QUERIES["volatility_clustering"](spark, str(tmp_path)).collect())
    assert got == want and sum("nan" in r for r in want) >= 4


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, capsys):
    from tapeloom.operators.align import ms_window
    from tapeloom.sources import adapters

    adapters.read(spark, SF, "lineitem").filter("l_quantity > 49").select("l_orderkey").explain("formatted")
    assert "GreaterThan(l_quantity,49.0)" in (out := capsys.readouterr().out) and "l_comment" not in out
    ms_window(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderkey", 5, 9).explain("formatted")
    assert "PushedFilters" in capsys.readouterr().out


def test_label_join_is_broadcast(spark, capsys):
    from tapeloom.operators import flow
    from tapeloom.sources import adapters

    smart = spark.createDataFrame([("1",)], "wallet string")
    flow.signed_flows(adapters.trades(spark, SF), smart).explain()
    out = capsys.readouterr().out
    assert "BroadcastHashJoin" in out and "Cartesian" not in out


def test_scans_of_the_tape_prune_partitions(spark, tmp_path, capsys):
    """Days and coins prune before any file is opened; chosen hours prune as the join runs, and come from names alone."""
    from tapeloom.sources import adapters, layers

    root = str(tmp_path)
    layers.write_tape(adapters.quotes(spark, SF, by_leg=True).drop("seq").filter("captured_ms < 1704326400000"), root, "bbo")
    layers.load_tape(spark, root, "bbo", ["1"], ("2024-01-02", "2024-01-03")).explain()
    line = next(x for x in capsys.readouterr().out.splitlines() if "PartitionFilters" in x)
    assert "coin" in line.split("PartitionFilters: [")[1].split("]")[0] and "dt" in line.split("PartitionFilters: [")[1].split("]")[0]
    hours = layers.first_hours(layers.tape_hours(spark, root, "bbo"), 3)
    assert sorted(r["coin"] for r in hours.collect()) == ["0"] * 3 + ["1"] * 3
    got = layers.load_hours(spark, root, "bbo", hours)
    got.explain()
    assert "dynamicpruning" in capsys.readouterr().out
    assert got.select("coin", "dt", "hr").distinct().count() == 6
    assert hours.inputFiles() and all("/bbo_hours/" in f for f in hours.inputFiles())
    # A second write adds rows to hours that are there.
    layers.write_tape(adapters.quotes(spark, SF, by_leg=True).drop("seq").filter("captured_ms < 1704110400000"), root, "bbo")
    assert layers.tape_hours(spark, root, "bbo").agg(F.sum("rows")).first()[0] == layers.load_tape(spark, root, "bbo").count()
