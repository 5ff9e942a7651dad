"""Query of the WARC audit, and its SQL.

The replica is the pages table as a faulty copy would hold it, which the query derives from the
table itself: by the MD5 of page_id, some records are lost, some have one character changed in the
body, some are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.warc import fixity, records


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    luck = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 97
    faulty = F.when(luck == 1, F.overlay("html", F.lit("~"), F.floor(F.length("html") / 2).cast("int") + 1, F.lit(1))).when(luck == 2, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(luck != 0, F.lit(True))).withColumn("html", faulty)
    return fixity(records(pages), records(replica))


# Records, offsets and digests, and states from comparing all digests: the trees only make that cheaper.
# Ids are taken as unique here, which those of the given tables are.
_SQL = r"""
WITH p AS (SELECT page_id, url, html, length(html) AS n, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 97 AS luck FROM pages),
c AS (
  SELECT 0 AS replica, page_id, url, html FROM p
  UNION ALL
  SELECT 1, page_id, url, CASE luck WHEN 1 THEN substr(html, 1, n // 2) || '~' || substr(html, n // 2 + 2) WHEN 2 THEN substr(html, 1, greatest(n - 1, 0)) ELSE html END
  FROM p WHERE luck <> 0 OR luck IS NULL),
b AS (
  SELECT replica, page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', '', 'g') AS url,
         E'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ' || strlen(coalesce(html, '')) || E'\r\n\r\n' || coalesce(html, '') AS block FROM c),
r AS (
  SELECT replica, page_id, E'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || lpad(coalesce(CAST(page_id AS VARCHAR), 'none'), 12, '0')
         || E'>\r\nWARC-Target-URI: ' || url || E'\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: ' || strlen(block) || E'\r\n\r\n' || block || E'\r\n\r\n' AS record FROM b),
h AS (SELECT replica, page_id, (page_id - (page_id % 4096 + 4096) % 4096) // 4096 AS archive, (page_id % 4096 + 4096) % 4096 AS place, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS hash FROM r),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h WHERE replica = 0)
SELECT o.page_id, o.archive, o."offset", o.length, o.hash, CASE WHEN h.hash IS NULL THEN 'missing' WHEN h.hash <> o.hash THEN 'corrupt' ELSE 'ok' END AS state
FROM o LEFT JOIN h ON h.replica = 1 AND h.page_id = o.page_id
"""

QUERIES = {"op10_warc_fixity": op10_warc_fixity}
SQL = {"op10_warc_fixity": _SQL}
