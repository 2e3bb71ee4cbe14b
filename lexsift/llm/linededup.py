"""Line dedup by overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines is hashed; a hash that occurs more than once
in the corpus marks a repeated passage.  Its first occurrence stays, the lines of
all later ones go; the positions that overlapping windows cover are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, flagged, prefix, small, table, text_of, written

WINDOW = 3
#: Windows of a repeated passage from which on it doesn't join by shuffle, if such passages are few enough to broadcast.
HOT = 1 << 13


def window_hashes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, k, pos, a, b): 96 bits of hash of the lines pos .. pos + window - 1, leading and trailing spaces aside; k: the text's hash."""
    d = docs.select("doc_id", F.xxhash64(text_of()).alias("k"), F.split(text_of(), "\n", -1).alias("l")).where(F.size("l") >= window)
    lines = lambda i: [F.trim(F.col("l")[i + k]) for k in range(window)]
    at = F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda i: F.struct(i.alias("pos"), F.xxhash64(*lines(i)).alias("a"), F.hash(*lines(i)).alias("b")))
    # Not explode: for it the optimizer would test the array's size first, and hash all windows for that once more.
    return d.select("doc_id", "k", F.explode_outer(at).alias("w")).where("w IS NOT NULL").select("doc_id", "k", "w.*")


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, k, covered), written: positions of the lines that later occurrences of repeated windows cover.

    The first occurrence is the one with the smallest (doc_id, text hash, position);
    null doc_ids come first.  Rows that agree in doc_id and text count as one document.
    """
    windows = written(window_hashes(docs, window), "windows")
    groups = written(windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "pos")).alias("first")).where("n > 1"), "passages")
    marked = flagged(windows, F.col("a"), groups, F.col("a"), "maybe").where("maybe").drop("maybe")
    later = ~F.struct("doc_id", "k", "pos").eqNullSafe(F.col("first"))
    every = [marked.join(g, ["a", "b"]).where(later).select("doc_id", "k", "pos") for g in (small(groups.where(F.col("n") > HOT)), groups.where(F.col("n") <= HOT))]
    runs = every[0].unionByName(every[1]).groupBy("doc_id", "k").agg(F.collect_set("pos").alias("at"))  # at most one document's lines
    found = written(runs.select("doc_id", "k", F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + window - 1)))).alias("covered")), "covered")
    dropped(windows)
    dropped(groups)
    return found


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with ``text`` without repeated passages, and ``n_lines``, ``n_removed``.

    A null text stays null; a text of fewer lines than a window stays as it is; a text
    whose lines all go becomes empty.  Columns named n_lines or n_removed are replaced, all others kept.
    Only documents that may hold a later occurrence move.
    """
    p = prefix(docs)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    k, covered, lines, maybe = (f"{p}{x}" for x in ("k", "covered", "lines", "maybe"))
    c = repeated_lines(docs, window).select(F.col("doc_id").alias(f"{p}id"), F.col("k").alias(f"{p}ck"), F.col("covered").alias(covered))
    place = lambda i, t: F.xxhash64(F.coalesce(F.col(i).cast("long"), F.lit(-1)), t)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines")
    marked = flagged(docs.select(*names).withColumn(k, F.xxhash64(text_of())), place("doc_id", k), c, place(f"{p}id", f"{p}ck"), maybe)
    whole = marked.where(~F.col(maybe)).select(*names, n_lines, F.lit(0).cast("long").alias("n_removed"))
    moved = marked.where(maybe)
    joined = moved.join(small(c), moved["doc_id"].eqNullSafe(c[f"{p}id"]) & (moved[k] == c[f"{p}ck"]), "left").withColumn(lines, F.split("text", "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered)), lambda i: F.element_at(F.col(lines), i + 1))
    text = F.when(F.col(covered).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_removed = F.when(F.col(covered).isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_removed")
    return whole.unionByName(joined.select(*(text.alias("text") if x == "text" else joined[x] for x in names), n_lines, n_removed))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and the cleaned text of every document."""
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.length(text_of()).cast("long").alias("n_chars"), "text")


OP6_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM l),
w AS (
  SELECT doc_id, pos, trim(lines[pos + 1], ' ') AS x, trim(lines[pos + 2], ' ') AS y, trim(lines[pos + 3], ' ') AS z FROM p WHERE pos + 3 <= len(lines)),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS n FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1),
m AS (
  SELECT p.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(lines[p.pos + 1], chr(10) ORDER BY p.pos) FILTER (c.pos IS NULL), '') AS text
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.pos = p.pos GROUP BY p.doc_id)
SELECT doc_id, n_lines, n_removed, len(text)::BIGINT AS n_chars, text FROM m
"""
