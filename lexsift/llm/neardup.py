"""SimHash near-duplicates with pigeonring filtering (Qin and Xiao, 2018).

Fingerprints are cut into segments on a ring.  If two differ in at most ``radius``
bits, then from some segment on every chain of l consecutive segments differs in at
most ``l * radius / segments`` bits.  The longest chain whose budget is below one
bit has to agree, so it is the join key; longer chains are checked before the full
Hamming distance.  A bucket of a key that holds too many fingerprints is cut by the next
longer chain: its segments beyond the first chain are two parts, and as one bit of them may
differ at most, one part agrees and joins the key.  Where even such a bucket holds too many,
its members meet at the fingerprints one bit away, of which two share one just if they
differ in two bits at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, table, text_of, written
from .graph import components
from .keep import keep_rows

SHINGLE, RADIUS, SEGMENTS, SEED = 3, 2, 9, 42
#: Fingerprints of a bucket up to which they are paired; beyond it one-bit neighbours find the same links.
PAIRED = 64
BITS = 64
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number of the bits that are set in over half of 64-bit hashes; none: 0."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(np.ascontiguousarray(hashes[i : i + _BLOCK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text: a bit is set if it is set in over half of the shingles' hashes; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))


def simhash(text: Column) -> Column:
    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(x) for x in batch], dtype="int64")

    return F.pandas_udf(T.LongType())(batches)(text)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(first: int, begin: int, end: int, segments: int) -> int:
    """The bits of the segments ``first + begin`` to ``first + end - 1`` of the ring."""
    cuts = [i * BITS // segments for i in range(segments + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(segments)]
    return _signed(sum(part[(first + k) % segments] for k in range(begin, end)))


def chains(radius: int = RADIUS, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(length, budget) of the longest chain for each budget from 0 bits on; the last is the whole ring."""
    longest = {n * radius // segments: n for n in range(1, segments + 1)}
    return [(n, b) for b, n in sorted(longest.items())]


def _pick(values: list[int], i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), i + 1)


def _keyed(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select("*", F.explode(F.array(*keys)).alias("key")).select(*rows.columns, "key.*")


def _pairs(rows: DataFrame, keys: list[str], segments: int, levels: list[tuple[int, int]]) -> DataFrame:
    """(u, v): the fingerprints of small buckets that pass the chains' budgets, the whole ring's last."""
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    within = F.col("a.fp") > F.col("b.fp")
    for n, budget in levels:
        within &= F.bit_count(apart.bitwiseAND(_pick([_masks(i, 0, n, segments) for i in range(segments)], F.col("a.i")))) <= budget
    for k in keys:
        within &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, within).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _bucketed(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows of buckets with two fingerprints or more, with their number ``n``, written."""
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return written(looked_up(rows, sizes, keys, "n"), label)


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that join all within ``radius`` (2) bits: every pair of
    small buckets, and for members of buckets that two chains leave large a star around each shared one-bit neighbour."""
    if radius != 2:
        raise ValueError("stars around one-bit neighbours link fingerprints at 2 or fewer bits")
    (first, _), *levels = chains(radius, segments)
    second = levels[0][0]
    key = lambda fp, mask: fp.bitwiseAND(F.lit(mask).cast("long"))
    one = _keyed(prints.select("fp"), [F.struct(F.lit(i).alias("i"), key(F.col("fp"), _masks(i, 0, first, segments)).alias("v")) for i in range(segments)])
    shared = _bucketed(one, ["i", "v"], "buckets")
    pairs = _pairs(shared.where(F.col("n") <= paired), ["i", "v"], segments, levels)
    # Parts of the second chain beyond the first: one bit of both may differ, so one of them agrees.
    middle = (first + second) // 2
    parts = [[_masks(i, *span, segments) for i in range(segments)] for span in ((first, middle), (middle, second))]
    two = _keyed(shared.where(F.col("n") > paired).drop("n"), [F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(_pick(masks, F.col("i"))).alias("w")) for j, masks in enumerate(parts)])
    large = _bucketed(two, ["i", "v", "j", "w"], "buckets")
    pairs = pairs.unionByName(_pairs(large.where(F.col("n") <= paired), ["i", "v", "j", "w"], segments, levels))
    many = large.where(F.col("n") > paired).select("fp").distinct()
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k)).cast("long")) for k in range(BITS))]
    met = many.select("fp", F.explode(F.array(*flips)).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").select("u", "v")
    return pairs.unionByName(stars)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, fp) of documents (doc_id, text), written; ``k`` is the text's hash."""
    return written(docs.select("doc_id", F.xxhash64(text_of()).alias("k"), simhash(F.col("text")).alias("fp")), "simhash")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id, n), written: for every distinct fingerprint the smallest fingerprint and the smallest doc_id that links reach from it, and its number of rows."""
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "prints")
    roots = components(links(own.select("fp")))
    rooted = written(own.join(roots, own["fp"] == roots["node"], "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "least")
    return written(looked_up(rooted, least, ["root"], "members").select("fp", "root", "component_id", "n"), "components")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document (doc_id, text).

    A null or wordless text has fingerprint zero and is linked like any other.  Null
    doc_ids never name a component that has another; rows that repeat each get a
    result.  An empty table gives an empty result.  Other columns are ignored.
    """
    prints = fingerprints(docs)
    found = looked_up(prints, near_duplicates(prints), ["fp"], "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row for each component left: the smallest (doc_id, text hash), null doc_ids last."""
    prints = fingerprints(docs)
    found = looked_up(prints, near_duplicates(prints), ["fp"], "n")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("one")
    keep = found.groupBy("root").agg(one).select(F.col("one.doc_id").alias("keep_id"), F.col("one.k").alias("keep_k"))
    return keep_rows(docs, prints.select("doc_id", "k"), keep)


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
