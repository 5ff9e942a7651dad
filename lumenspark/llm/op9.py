"""Query of the licence scan, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.licenses import RULES, SENTENCES, scan


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", "|").alias("sentence_ids"), F.array_join("licenses", "|").alias("licenses"), "n_licenses")


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())

    def rest(name: str, ids: list[str]) -> str:
        own, out = f"|{'|'.join(ids)}|", "line"
        for other, more in RULES:
            longer = f"|{'|'.join(more)}|"
            if other != name and own in longer and own != longer:
                out = f"replace({out}, '{longer}', '|')"
        return out

    fired = ", ".join(f"CASE WHEN contains({rest(name, ids)}, '|{'|'.join(ids)}|') THEN {k} END" for k, (name, ids) in enumerate(RULES))
    names = ", ".join(f"'{name}'" for name, _ in RULES)
    return f"""
WITH known(s, id) AS (VALUES {known}),
m AS (SELECT map(list(s), list(id)) AS ids FROM known),
d AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?;:][ \\t]+|[\\r\\n]+') AS parts FROM documents),
f AS (
  SELECT doc_id, len(list_filter(parts, lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))) AS n_sentences,
         list_filter(list_transform(parts, lambda s: ids[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS found
  FROM d, m),
l AS (SELECT doc_id, n_sentences, coalesce(array_to_string(found, '|'), '') AS sentence_ids, '|' || coalesce(array_to_string(found, '|'), '') || '|' AS line FROM f),
r AS (SELECT *, list_filter([{fired}], lambda k: k IS NOT NULL) AS fired FROM l),
n AS (SELECT *, list_transform(fired, lambda k: [{names}][k + 1]) AS names FROM r),
u AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS licenses FROM n)
SELECT doc_id, n_sentences, sentence_ids, coalesce(array_to_string(licenses, '|'), '') AS licenses, len(licenses) AS n_licenses FROM u
"""


QUERIES = {"op9_license_scan": op9_license_scan}
SQL = {"op9_license_scan": _sql()}
