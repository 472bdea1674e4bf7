"""Lines that spread over many sites, and their removal. DataFrame operations only.

A sketch of the sites of each line estimates on how many distinct sites it stands;
sketches of parts of the rows merge while they are aggregated. Lines whose estimate is
near the limit get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SITES = 8
SKETCH_BITS = 12
# Estimates within this share of the limit are counted exactly: over five standard errors.
NEAR = 0.1


def _lines(documents: DataFrame) -> DataFrame:
    """One row for each line that is not blank: document key, site, place and hashes of the line and of the whole text."""
    text = F.col("text").cast("string")
    split = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.lit("whole"), text).alias("c1"),
        F.xxhash64(F.lit("second whole"), text).alias("c2"),
        F.col("source").cast("string").alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("place", "line"),
    )
    bare = F.trim("line")
    return split.where(bare != "").select(
        "doc_id",
        "text_hash",
        "c1",
        "c2",
        "site",
        "place",
        F.xxhash64(bare).alias("h1"),
        F.xxhash64(F.lit("second"), bare).alias("h2"),
    )


def _spread(rows: DataFrame, sites: int) -> DataFrame:
    """``h1, h2`` of what stands on at least ``sites`` distinct sites, from rows ``h1, h2, site``."""
    rows = rows.where("site IS NOT NULL").select("h1", "h2", "site")
    sketches = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    estimated = sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"))
    estimated = cut(estimated.where(F.col("estimate") >= sites * (1 - NEAR)))
    sure = estimated.where(F.col("estimate") > sites * (1 + NEAR)).select("h1", "h2")
    near = estimated.where(F.col("estimate") <= sites * (1 + NEAR)).select("h1", "h2")
    exact = rows.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return sure.union(exact.where(F.col("n") >= sites).select("h1", "h2"))


def spread_lines(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """``h1, h2``: hashes of the lines that stand on at least ``sites`` distinct sites.

    A null site counts as none. Sketches are made where the rows are and merged after
    the shuffle, so a frequent line sends one sketch for each part of the input.
    """
    return _spread(_lines(documents), sites)


def spread_texts(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """``c1, c2``: hashes of the whole texts that stand, sign for sign, on at least ``sites`` distinct sites."""
    text = F.col("text").cast("string")
    rows = documents.where("text IS NOT NULL").select(
        F.xxhash64(F.lit("whole"), text).alias("h1"), F.xxhash64(F.lit("second whole"), text).alias("h2"), F.col("source").cast("string").alias("site")
    )
    return _spread(rows, sites).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"))


def remove_boilerplate(documents: DataFrame, sites: int = SITES, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns, with lines of many sites taken out of ``text``, and the numbers of lines and of removed ones.

    ``documents`` needs ``doc_id``, ``source`` and ``text``. Lines are compared without
    the spaces around them; blank lines stay. Every line that stands on ``sites`` distinct
    sites goes, however much of a text that is. Only a text that itself stands on so many
    sites, sign for sign, stays whole: its lines are many-site ones by its own copies. Null
    texts stay null and have no lines; empty ones have none either. Every row is kept, also
    of repeated ids, and equal rows fare alike; an empty table stays empty. Two columns called
    ``names`` are added, or replaced if the table has them.
    """
    lines = _lines(documents)
    marked = lines.join(spread_lines(documents, sites), ["h1", "h2"])
    places = marked.groupBy("doc_id", "text_hash", "c1", "c2").agg(F.collect_set("place").alias("__places"))
    places = places.join(spread_texts(documents, sites), ["c1", "c2"], "left_anti")
    places = places.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__places")
    text = F.col("text").cast("string")
    joined = documents.join(
        places, documents["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left"
    )
    every = F.split(text, "\n", -1)
    filled = F.coalesce(F.size(F.filter(every, lambda x: F.trim(x) != "")), F.lit(0))
    cut_ = F.col("__places").isNotNull()
    boiled = joined.withColumn("__every", F.when(cut_, every))
    boiled = boiled.withColumn("__stay", F.array_except(F.sequence(F.lit(0), F.size("__every") - 1), "__places"))
    kept = F.array_join(F.transform("__stay", lambda i: F.get("__every", i)), "\n")
    out = boiled.withColumn(names[0], F.when(text.isNull(), 0).otherwise(filled).cast("long"))
    out = out.withColumn(names[1], F.when(cut_, F.size("__places")).otherwise(0).cast("long"))
    out = out.withColumn("text", F.when(cut_, kept).otherwise(text))
    return out.drop("__id", "__hash", "__places", "__every", "__stay")


# The same rows by plain counts, for the given tables.
LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT trim(line) AS k FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}
), m AS (
  SELECT l.*, s.k IS NOT NULL AS hit FROM l LEFT JOIN spread s ON trim(l.line) = s.k
), copies AS (
  SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) >= {SITES}
), d AS (
  SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (hit) AS hits,
         string_agg(line, chr(10) ORDER BY place) FILTER (NOT hit) AS rest
  FROM m GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines,
       CASE WHEN hits > 0 AND c.text IS NULL THEN hits ELSE 0 END AS n_removed,
       CASE WHEN hits > 0 AND c.text IS NULL THEN coalesce(rest, '') ELSE t.text END AS text
FROM documents t LEFT JOIN d USING (doc_id) LEFT JOIN copies c ON t.text = c.text
"""
