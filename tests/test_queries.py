"""Every registered query of the image jobs against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenspark.operators import tiling
from lumenspark.plans import registry
from lumenspark.sources import proxies

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return c


def normal(df):
    cells = lambda r: tuple(f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in r)
    return sorted(cells(r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = registry.queries()[name](spark, TINY).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    q = registry.queries()
    streamed = q["stream_scoring"](spark, TINY)
    assert streamed.where("status = 'ok'").count() == q["score_canny"](spark, TINY).count() == streamed.distinct().count()


def test_tiles_keep_every_pixel(spark):
    q = registry.queries()
    at = {(p.filename, p.row, p.col): (p.r, p.g, p.b) for p in proxies.rgb_pixels(spark, TINY).collect()}
    want = {(t.filename, t.row0, t.col0, i, j): at[t.filename, t.row0 + i, t.col0 + j] for t in q["tile_grid"](spark, TINY).collect() for i in range(8) for j in range(8)}
    got = [((p.filename, p.row0, p.col0, p.local_row, p.local_col), (p.r, p.g, p.b)) for p in q["tile_pixels"](spark, TINY).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_each_tile_tells_how_each_scorer_fares(spark):
    q = registry.queries()
    corner = {(p.filename, p.row, p.col): p.r for p in proxies.rgb_pixels(spark, TINY).collect()}
    names = {(t.filename, t.tile_filename): corner[t.filename, t.row0, t.col0] for t in q["tile_grid"](spark, TINY).withColumn("tile_filename", tiling.tile_name(F.col("filename"), F.col("row0"), F.col("col0"))).collect()}
    want = {(m, *name): "ok" if m == "red" and not level % 2 else "failed" for name, level in names.items() for m in ("red", "loud", "narrow", "wide", "absent")}
    got = [((r.model, r.source_filename, r.tile_filename), r.status) for r in q["scorer_failures"](spark, TINY).collect()]
    assert len(got) == len(want) and dict(got) == want and {"ok", "failed"} == set(want.values())


def test_tile_pixels_bounds_the_batches_of_its_workers(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, str(64 << 20))
    registry.queries()["tile_pixels"](spark, TINY)
    assert int(spark.conf.get(limit)) == 4 << 20


def test_scorer_failures_deals_the_items_once(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, str(64 << 20))
    plan = registry.queries()["scorer_failures"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "l_shipdate" not in plan
    assert int(spark.conf.get(limit)) == 4 << 20


def test_items_that_tie_up_to_their_price_equal_sql(spark, tmp_path):
    c = duckdb.connect()
    c.sql(f"create table lineitem as select l_orderkey % 2 as l_orderkey, 1 as l_partkey, l_suppkey % 3 as l_suppkey, 1 as l_linenumber, 7.0 as l_quantity, l_linenumber as l_extendedprice, * exclude (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) from '{TINY}/lineitem.parquet'")
    c.sql(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    got, want = registry.queries()["scorer_failures"](spark, str(tmp_path)).toPandas(), c.sql(registry.oracle_sql()["scorer_failures"]).df()
    assert len(want) and normal(got) == normal(want)
    pixels = proxies.rgb_pixels(spark, str(tmp_path)).toPandas()
    assert normal(pixels) == normal(c.sql(f"WITH {proxies.l_sql()} SELECT * FROM l").df())


@pytest.mark.parametrize("name", ["crop_log", "border_crop", "normalised_pixels"])
def test_crops_of_half_levels_equal_sql(spark, tmp_path, name):
    """Images of two colours, of which one lies halfway between two gray levels, and the other is the even one of these."""
    rng = np.random.default_rng(1)
    levels = {(r, g, b): 299 * r + 587 * g + 114 * b for r in range(0, 255, 5) for g in range(0, 255, 25) for b in range(0, 255, 30)}
    even = {round(v / 1000): colour for colour, v in levels.items() if v % 1000 != 500}
    halves = [(colour, even[near]) for colour, v in levels.items() if v % 1000 == 500 and (near := v // 1000 + v // 1000 % 2) in even]
    rows = [(i, 1, supplier, 1, r / 5, 1.0, g / 2500, b / 3000, "N", "O", None) for supplier, two in enumerate(halves) for i, (r, g, b) in enumerate(np.array(two)[rng.integers(2, size=14 * 24)])]
    items = pd.DataFrame(rows, columns=proxies.LINEITEM_COLUMNS).astype({"l_shipdate": "datetime64[us]"})  # noqa: F841
    c = duckdb.connect()
    c.sql("create table lineitem as select * from items")
    c.sql(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    assert len(want) and normal(got) == normal(want)
