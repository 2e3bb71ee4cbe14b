"""Sharding by sampled splitters (DataFrame functions only).

A size-weighted sample of the sort keys gives quantile boundaries; the records
are range-partitioned by them; ranges that turn out overfull are subdivided by
splitters sampled inside them.  Exact sums of the ranges then place every record
on one global scale of bytes, which is cut into shards of nearly equal size.
No step sorts more than one range in a task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import md5_long, prefix, small, table, text_of, written

#: Ranges at least, rows that a range should hold at most, and sampled keys for each boundary.
MIN_RANGES, ROWS_PER_RANGE, SAMPLES = 256, 1 << 20, 16
#: A range with this many times its share of the bytes is subdivided.
OVERFULL = 2
#: What rows are sorted by: hash of the text, doc_id, and a number that repeated rows don't share.
_ORDER = ("h", "tie", "salt")
_KEYS = "array<struct<h:bigint,tie:bigint,salt:bigint>>"


def _below(splitters: Column) -> Column:
    """How many of the sorted splitters are at or below the row's key."""
    return F.size(F.filter(splitters, lambda s: s <= F.struct(*_ORDER)))


def _key(row: tuple) -> dict[str, int]:
    return dict(zip(_ORDER, row))


def _located(splitters: list[tuple]) -> Column:
    """Range number of each row: two searches over about the square root of the number of splitters each."""
    width = max(1, int(len(splitters) ** 0.5))
    blocks = [[_key(s) for s in splitters[i : i + width]] for i in range(0, len(splitters), width)]
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), _KEYS)
    bodies = F.from_json(F.lit(json.dumps(blocks)), f"array<{_KEYS}>")
    block = _below(heads)  # 0: below the first splitter
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + _below(F.element_at(bodies, block))).cast("int")


def _sample(rows: DataFrame, rate: Column) -> DataFrame:
    """Keeps each row with probability min(1, size * rate), by a hash of its key: reruns agree."""
    u = F.pmod(F.xxhash64(F.lit("splitter"), *_ORDER), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.where(u < F.col("size") * rate)


def range_splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Quantile boundaries of a size-weighted sample of about ``ranges * SAMPLES`` keys (a bounded list)."""
    picked = _sample(rows, F.lit(ranges * SAMPLES / max(total, 1)))
    numbered = picked.select(*_ORDER, F.row_number().over(Window.orderBy(*_ORDER)).alias("n"))
    return [tuple(r[c] for c in _ORDER) for r in numbered.where(F.col("n") % SAMPLES == 0).orderBy("n").collect()]


def _subdivided(rows: DataFrame, share: float) -> Column:
    """Number of the part within its range: overfull ranges get splitters sampled inside them, others one part."""
    sums = rows.groupBy("range_no").agg(F.sum("size").alias("full")).where(F.col("full") > OVERFULL * share)
    full = {r["range_no"]: r["full"] for r in sums.collect()}  # at most ranges / OVERFULL of them
    if not full:
        return F.lit(0)
    rates = F.element_at(F.from_json(F.lit(json.dumps({str(k): SAMPLES / share for k in full})), "map<string,double>"), F.col("range_no").cast("string"))
    inside = rows.where(F.col("range_no").isin(list(full)))
    order = Window.partitionBy("range_no").orderBy(*_ORDER)
    numbered = _sample(inside, rates).select("range_no", *_ORDER, F.row_number().over(order).alias("n"))
    found: dict[str, list[dict]] = {}
    for r in numbered.where(F.col("n") % SAMPLES == 0).orderBy("range_no", "n").collect():
        found.setdefault(str(r["range_no"]), []).append(_key(tuple(r[c] for c in _ORDER)))
    splitters = F.element_at(F.from_json(F.lit(json.dumps(found)), f"map<string,{_KEYS}>"), F.col("range_no").cast("string"))
    return F.coalesce(F.when(splitters.isNotNull(), _below(splitters)), F.lit(0))


def shards_by_bytes(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that have ``h``, ``tie`` (longs, not null: the sort key) and ``size`` (at least 1).

    The records keep the order (h, tie), repeated keys in an order of their own; the shard of a record is where the middle
    of its bytes falls when all bytes are cut into ``shards`` equal lengths, so a
    shard's bytes differ from the mean by at most one record's size.  ``slot``
    counts a shard's records from 0 in that order.  A range of keys that are all equal
    is subdivided like any other.  An empty table gives an empty result.
    """
    rows = written(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "shard-keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(MIN_RANGES, -(-n // ROWS_PER_RANGE))
    splitters = range_splitters(rows, total, ranges)
    ranged = rows.withColumn("range_no", _located(splitters) if splitters else F.lit(0))
    parted = ranged.withColumn("part", _subdivided(ranged, max(1.0, total / ranges)).cast("int"))
    inside = Window.partitionBy("range_no", "part").orderBy(*_ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.select("*", F.sum("size").over(running).alias("upto"), F.row_number().over(inside).alias("nth"))
    # One row for each part: a few thousand, whatever the input.
    sums = parted.groupBy("range_no", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("range_no", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows"))), "shard-parts")
    middle2 = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle2 * shards / F.lit(2 * max(total, 1))))
    placed = local.join(small(starts), ["range_no", "part"]).withColumn("shard", shard.cast("int"))
    placed = written(placed.withColumn("at", F.col("rows_before") + F.col("nth") - 1).drop("upto", "nth", "bytes_before", "rows_before"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("at") - F.col("first")).drop("at", "first", "range_no", "part")


def _keyed(docs: DataFrame) -> list[Column]:
    """The key of a row: MD5 of the text and doc_id, both as longs."""
    return [md5_long(text_of()).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie")]


def _placed(docs: DataFrame, shards: int) -> DataFrame:
    return shards_by_bytes(docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), *_keyed(docs)), shards)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Places documents (doc_id, text) in shards of nearly equal bytes.

    The key is (MD5 of the text, doc_id): equal texts are neighbours, and a large
    group of them is divided by doc_id, or by chance where doc_ids repeat too.  A null text
    counts as empty (size 1, crc 0); a null doc_id sorts first.  Other columns are ignored.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    placed = _placed(docs, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, rows_a_file: int = 100_000) -> None:
    """Writes all columns and rows of the documents, one folder ``shard=N`` for each shard, in the order of ``slot``.

    Rows that agree in doc_id and text, null ones too, take their places in any order.
    Columns named shard or slot are replaced; an empty table writes no folder of a shard.
    """
    p = prefix(docs)
    h, tie, twin = (f"{p}{x}" for x in ("h", "tie", "twin"))
    numbered = lambda df, order: df.withColumn(twin, F.row_number().over(Window.partitionBy(h, tie).orderBy(order)))
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = numbered(_placed(docs, shards).select(F.col("h").alias(h), F.col("tie").alias(tie), "shard", "slot"), "slot")
    keyed = numbered(docs.select(*names, *(c.alias(x) for c, x in zip(_keyed(docs), (h, tie)))), h)
    both = keyed.join(placed, [h, tie, twin]).select(*names, "shard", "slot")
    both.repartition("shard", F.floor(F.col("slot") / rows_a_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


# The order (MD5 of the text, doc_id) fixes the result, whatever the splitters.
OP4_SQL = """
WITH polynomial AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b)) AS t),
d AS (
  SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
o AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w AS n
  FROM d WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (
  SELECT *, least(15, (2 * upto - size) * 16 // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size::BIGINT AS size,
       xor(4294967295, list_reduce(list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT)) AS text_crc32,
       'bytes' AS law, shard,
       (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s, polynomial
"""
