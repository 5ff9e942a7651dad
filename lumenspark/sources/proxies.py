"""Images, names and logs derived from the given tables, in Spark and in the same SQL for DuckDB.

E: gray images of 8 x 8 from ``embeddings``; L: colour images 24 wide from ``lineitem``, one for each
supplier, the last row of which its last item fills; M: raw file names from ``orders``; R: a run log from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspark.sources.images import arrays_to_payload, to_payload

WIDTH_E, WIDTH_L = 8, 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spread(rows: DataFrame, key: str = "filename") -> DataFrame:
    """Rows dealt to all tasks by a key: a small table would be one task, while sorting it and kernels are dear."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _magnification(key: str) -> F.Column:
    return F.when(F.col(key) % 2 == 0, 100).otherwise(200)


def _gray_names(df: DataFrame) -> DataFrame:
    m = _magnification("vec_id")
    letter = F.substring(F.lit("CLR"), (1 + F.col("label") % 3).cast("int"), F.lit(1))
    return df.select(F.format_string("%08d-%s-%dX.PNG", "vec_id", letter, m).alias("filename"), m.alias("magnification"), "embedding")


def _quantised(x: F.Column) -> F.Column:
    return F.rint((x.cast("double") + 1) / 2 * 255) / 255


def gray_payload(spark: SparkSession, folder: str) -> DataFrame:
    named = _gray_names(table(spark, folder, "embeddings"))
    rows = named.select("filename", "magnification", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", _quantised).alias("values"))
    return _spread(arrays_to_payload(rows, ["filename", "magnification"], 1))


def gray_pixels(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """spread: images are dealt to all tasks, so that what groups their pixels needs no other shuffle."""
    images = _gray_names(table(spark, folder, "embeddings"))
    named = (_spread(images) if spread else images).select("filename", "magnification", F.posexplode("embedding").alias("i", "e"))
    return named.select("filename", "magnification", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), _quantised(F.col("e")).alias("v"))


def _rgb_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    # rows equal in the columns up to the tax give equal pixels: the columns after it need no place in the order
    items = _spread(table(spark, folder, "lineitem").select(*LINEITEM_COLUMNS[:8]), "l_suppkey")
    ranked = items.withColumn("idx", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*items.columns)) - 1)
    # the last item fills the rest of the last row
    whole = ranked.withColumn("n", F.count("*").over(Window.partitionBy("l_suppkey")))
    end = F.when(F.col("idx") == F.col("n") - 1, F.ceil(F.col("n") / WIDTH_L) * WIDTH_L - 1).otherwise(F.col("idx"))
    whole = whole.withColumn("idx", F.explode(F.sequence(F.col("idx").cast("long"), end.cast("long"))))
    level = lambda c, k: F.rint(F.col(c).cast("double") * k).cast("int")
    return whole.select(
        "l_suppkey", F.format_string("%06d-C-%dX.PNG", "l_suppkey", _magnification("l_suppkey")).alias("filename"), _magnification("l_suppkey").alias("magnification"),
        F.floor(F.col("idx") / WIDTH_L).cast("int").alias("row"), (F.col("idx") % WIDTH_L).cast("int").alias("col"),
        level("l_quantity", 5).alias("r"), level("l_discount", 2500).alias("g"), level("l_tax", 3000).alias("b"),
    )


def rgb_pixels(spark: SparkSession, folder: str) -> DataFrame:
    return _rgb_by_supplier(spark, folder).drop("l_suppkey")


def rgb_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Unit-scaled colour images, which stay where the items of their suppliers were dealt to."""
    unit = _rgb_by_supplier(spark, folder).withColumns({c: F.col(c) / 255.0 for c in "rgb"})
    return to_payload(unit, ["filename", "magnification"], ["r", "g", "b"], dealt=("l_suppkey",))


def raw_names(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    m = F.element_at(F.create_map(*[F.lit(x) for p in (("1", 50), ("2", 100), ("3", 200), ("4", 500), ("5", 1000)) for x in p]), digit)
    letter = F.substring(F.lit("CLR"), (1 + F.col("o_orderkey") % 3).cast("int"), F.lit(1))
    mark = F.when(F.col("o_orderkey") % 97 == 0, "").otherwise("X")
    return orders.select(F.format_string("%d-%s-%d%s.JPG", "o_orderkey", letter, m, mark).alias("filename"))


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("model"), F.col("event_id").cast("string").alias("tile_filename"), F.col("user_id").cast("string").alias("source_filename"),
        _magnification("user_id").alias("magnification"), F.when(F.col("value") > 60, "failed").otherwise("ok").alias("status"), F.col("value").cast("double").alias("elapsed_seconds"), F.col("event_id"),
    )


# The same in SQL: CTEs that the oracles start from.
E_SQL = """e0 AS (
  SELECT printf('%08d-%s-%dX.PNG', vec_id, substr('CLR', 1 + label % 3, 1), CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 200 END) AS filename,
         CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 200 END AS magnification, embedding FROM embeddings),
e AS (
  SELECT filename, magnification, i // 8 AS "row", i % 8 AS col, round_even((CAST(embedding[i + 1] AS DOUBLE) + 1) / 2 * 255, 0) / 255 AS v
  FROM e0, (SELECT unnest(range(64)) AS i))"""

L_SQL = """l9 AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {columns}) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
l0 AS (SELECT *, unnest(range(i, CASE WHEN i = n - 1 THEN (n + 23) // 24 * 24 ELSE i + 1 END)) AS idx FROM l9),
l AS MATERIALIZED (
  SELECT printf('%06d-C-%dX.PNG', l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 200 END) AS filename,
         CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 200 END AS magnification, CAST(idx // 24 AS INT) AS "row", CAST(idx % 24 AS INT) AS col,
         CAST(round_even(CAST(l_quantity AS DOUBLE) * 5, 0) AS INT) AS r, CAST(round_even(CAST(l_discount AS DOUBLE) * 2500, 0) AS INT) AS g,
         CAST(round_even(CAST(l_tax AS DOUBLE) * 3000, 0) AS INT) AS b
  FROM l0)"""

M_SQL = """m AS (
  SELECT printf('%d-%s-%d%s.JPG', o_orderkey, substr('CLR', 1 + o_orderkey % 3, 1),
                CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 50 WHEN '2' THEN 100 WHEN '3' THEN 200 WHEN '4' THEN 500 ELSE 1000 END,
                CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'X' END) AS filename FROM orders),
p AS (
  SELECT filename, regexp_extract(filename, '^([A-Za-z0-9]+)-([A-Za-z])-([0-9]+)[xX]\\.([A-Za-z]+)$', 1) AS sample_id,
         regexp_extract(filename, '^([A-Za-z0-9]+)-([A-Za-z])-([0-9]+)[xX]\\.([A-Za-z]+)$', 2) AS position,
         CAST(regexp_extract(filename, '^([A-Za-z0-9]+)-([A-Za-z])-([0-9]+)[xX]\\.([A-Za-z]+)$', 3) AS INT) AS magnification
  FROM m WHERE regexp_matches(filename, '^([A-Za-z0-9]+)-([A-Za-z])-([0-9]+)[xX]\\.([A-Za-z]+)$'))"""

R_SQL = """r AS (
  SELECT ts AS "timestamp", event_type AS model, CAST(event_id AS VARCHAR) AS tile_filename, CAST(user_id AS VARCHAR) AS source_filename,
         CASE WHEN user_id % 2 = 0 THEN 100 ELSE 200 END AS magnification, CASE WHEN value > 60 THEN 'failed' ELSE 'ok' END AS status,
         CAST(value AS DOUBLE) AS elapsed_seconds, event_id FROM events)"""

_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"


def l_sql(columns: list[str] | None = None) -> str:
    return L_SQL.replace("{columns}", ", ".join(columns or LINEITEM_COLUMNS))


#: Columns of lineitem in the table's order; whole rows are distinct.
LINEITEM_COLUMNS = _LINEITEM.split()
