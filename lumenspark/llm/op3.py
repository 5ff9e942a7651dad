"""Query of the decontamination operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.decontamination import contaminated


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=5, percent=80)
    return found.withColumn("containment", F.round("containment", 6))


# Exact containment of all distinct shingles, without sketches.
_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^0-9a-zA-Z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^0-9a-zA-Z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) > 0),
bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles,
       round(count(*) / any_value(n_shingles), 6) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id
HAVING 100 * count(*) >= 80 * any_value(n_shingles)
"""

QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
SQL = {"op3_benchmark_decontamination": _SQL}
