"""Connected components of a link table by alternating large-star and small-star rounds.

Each round replaces links by stars around smaller nodes and never grows the table; the number of
rounds follows the logarithm of the longest path.  Every round is saved in the shared folder.  A node with
very many links is aggregated before it is shuffled, and its links are joined in several places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import saved


#: Places over which rows of one key are spread in a join.
SALTS = 8


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of rows with those of a table that has each key once: rows of one key go to SALTS places by a hash of spread."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(both.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    star = salted_join(down, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links between nodes -> (node, component): each linked node and the smallest node that it reaches.

    Nodes without a link to another node are absent.  Repeated links, loops and nulls change nothing.
    """
    now = saved(links.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == seen or not print_of[0]:
            break
        seen = print_of
        now = saved(_small_star(_large_star(now)))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
