"""Mixing sources to target weights (DataFrame functions only).

Each source's words form one stream, cut into blocks of a fixed number of words.
A source fills as many slots as its target needs; how many of them go to each output
shard is drawn first, a multinomial draw with the source's total given, and slots are
laid out shard by shard by these counts.  Slot j of a source maps to a block by a
pseudorandom permutation of the source's block indexes, a new one for each pass over the
source, and slots join blocks by (source, block index).  The last slot of a source is cut
so that the words taken meet the target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAPS, WORD, md5_long, small, table, text_of, written

#: Words in a block; rounds of the permutation; weights in the order of the sources.
BLOCK_WORDS, ROUNDS, WEIGHTS, SHARE, REPEATS = 256, 16, (5, 2, 1), 1.5, 2
#: Slots that one row unfolds into, and rows of a source's stretch whose positions one task sums.
SLOTS_A_ROW, ROWS_A_STRETCH = 16_384, 1 << 20
#: Rows that agree in source, doc_id and text from which on they are divided, and into how many parts.
REPEATED, SUBS = 1 << 13, 64

# One round of swap-or-not (Hoang, Morris, Rogaway 2012) on 0..b-1, in integers below 2^63 that any SQL engine shares.
_KEY = "((s * 7919 + pass * 104729 + r * 1299709 + 12345) % 2147483647 * 48271 % 2147483647) % b"
_COIN = "((((m % 2147483647) * 69621 + r * 40503 + s * 977 + pass * 31) % 2147483647 * 48271 % 2147483647) >> 16) & 1"


def permuted(index: str, backwards: bool = False) -> Column:
    """The image of column ``index`` under the permutation of (s, pass) on 0..b-1; ``backwards``: the inverse."""
    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if backwards else f"sequence(0, {ROUNDS - 1})"
    other = f"((({_KEY}) + b - x) % b)"
    coin = _COIN.replace("m %", f"greatest(x, {other}) %")
    return F.expr(f"aggregate({rounds}, CAST({index} AS BIGINT), (x, r) -> CASE WHEN {coin} = 1 THEN {other} ELSE x END)")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``s``, the place from 0 of each ``source`` by code point, null last; no task sorts more than a range of them."""
    at = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    parted = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return parted.withColumn("nth", F.row_number().over(at)).join(F.broadcast(starts), "part").withColumn("s", (F.col("first") + F.col("nth") - 1).cast("long")).drop("part", "nth", "first")


def source_targets(sources: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds rank ``s`` and ``target`` to a table (source, source_size) of one row for each source.

    The targets are ``min(repeats * source_size, level * weight)`` with the level at
    which they add up to ``share`` of all sizes: the fixed point of resharing, by
    weight, what goes over a source's limit.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = ranked(sources).withColumn("w", w).withColumn("most", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("most") / F.col("w"))
    rows = written(rows.withColumn("bin", F.when(F.col("ratio") > 0, F.floor(F.log2("ratio") * 64)).otherwise(-(1 << 20))), "mix-ratios")
    # Sources whose ratio of limit to weight is below the level take their limit, others level * weight: sums by
    # bin, a few thousand numbers at most, tell the bin that holds the level, and a sort of its sources the level.
    sums = rows.groupBy("bin").agg(F.sum("most").alias("most"), F.sum("w").alias("w"), F.sum("source_size").alias("size"), F.max("ratio").alias("top"))
    bins = sorted(sums.collect(), key=lambda r: r["bin"])
    left, open_, level = share * sum(r["size"] for r in bins), sum(r["w"] for r in bins), None
    for r in bins:
        if left - r["most"] <= r["top"] * (open_ - r["w"]) or r is bins[-1]:
            before = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
            taken = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
            found = rows.where(F.col("bin") == r["bin"]).select("ratio", "s", ((F.lit(float(left)) - taken("most")) / (F.lit(float(open_)) - taken("w"))).alias("level"))
            first = found.where("level <= ratio").orderBy("ratio", "s").first()
            if first is not None:
                level = first["level"]
                break
        left, open_ = left - r["most"], open_ - r["w"]
    return rows.withColumn("target", F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("w"))).select("source", "source_size", "s", "target")


@dataclass
class Mix:
    """documents: a row for each document with what is taken of it; slots: (s, j, source block ``block``, ``out_shard``,
    ``words``: how many of the block's words); pieces: the parts of documents in blocks; sources: ranks and targets."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame
    sources: DataFrame


def plan_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, out_shards: int = 16) -> Mix:
    """Plans the mix of documents (doc_id, text, source).

    A null text has no words, a null source is a source of its own, after all others;
    a document without words takes nothing.  Within a source the documents follow in
    the order of a hash of (doc_id, text); fully repeated rows are interchangeable.
    ``shard`` of a document is the first output shard that takes words of it (null: none does).
    An empty table gives empty results.  Other columns are ignored.
    """
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of())
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        md5_long(mark).alias("h"),
        # null sources must meet in joins
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")).alias("src"),
    )
    sized = written(sized.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "mix-sized")
    stretches = 1 << max(0, (-(-sized.count() // ROWS_A_STRETCH) - 1)).bit_length() + 8
    sized = sized.withColumn("stretch", F.floor(F.col("h") / (1 << 60) * stretches))
    sized = _divided(sized)
    at = ["src", "stretch", "segment", "sub"]
    sums = written(sized.groupBy("source", *at).agg(F.sum("size").alias("words")), "mix-sums")
    totals = written(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-sources")
    before = Window.partitionBy("src").orderBy(*at[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("skip", F.coalesce(F.sum("words").over(before), F.lit(0)))
    known = totals.withColumn("src", F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))).drop("source")
    starts = written(starts.join(known, "src").select(*at, "skip", "s", "source_size", "target"), "mix-starts")
    placed = sized.join(small(starts), at)
    upto = Window.partitionBy(*at).orderBy("h", "doc_id", "size", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.select("doc_id", "h", "size", "s", "source_size", "target", (F.col("skip") + F.sum("size").over(upto) - F.col("size")).alias("start"))
    placed = written(placed, "mix-placed")

    slots = written(_slots(totals, block_words, out_shards), "mix-slots")
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("*", (begin - F.col("start")).alias("from_word"), (begin - F.col("block") * block_words).alias("in_block"), (end - begin).alias("words"))
    uses = slots.groupBy("s", "block").agg(
        F.count(F.when(~F.col("cut"), 1)).alias("whole"), F.coalesce(F.max(F.when(F.col("cut"), F.col("words"))), F.lit(0)).alias("cut_at"),
        F.min(F.when(~F.col("cut"), F.col("out_shard"))).alias("whole_shard"), F.min(F.when(F.col("cut"), F.col("out_shard"))).alias("cut_shard"),
    )
    used = pieces.join(uses, ["s", "block"], "left").withColumns({
        "whole": F.coalesce(F.col("whole"), F.lit(0)),
        "part": F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce(F.col("cut_at"), F.lit(0)) - F.col("in_block"))),
    })
    keys = ["doc_id", "size", "source_size", "target"]
    taken = used.groupBy("s", "start", *keys).agg(
        F.sum(F.col("whole") * F.col("words") + F.col("part")).alias("taken"), F.min(F.least("whole_shard", F.when(F.col("part") > 0, F.col("cut_shard")))).alias("shard")
    )
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("int").alias("shard"))
    return Mix(taken.select(*keys, "taken", "shard").unionByName(none), slots, used, totals)


def _divided(sized: DataFrame) -> DataFrame:
    """Adds ``segment`` and ``sub``: a stretch is cut at the hashes that very many rows share, and their rows, which are all equal, are dealt over SUBS by chance."""
    hot = written(sized.groupBy("src", "stretch", "h").agg(F.count("*").alias("n")).where(F.col("n") > REPEATED).groupBy("src", "stretch").agg(F.collect_list("h").alias("hot")), "mix-hot")
    if hot.isEmpty():
        return sized.withColumn("segment", F.lit(0)).withColumn("sub", F.lit(0))
    cut = sized.join(small(hot), ["src", "stretch"], "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<bigint>")))
    below = F.size(F.filter("hot", lambda x: x < F.col("h")))
    own = F.array_contains("hot", F.col("h"))
    return cut.withColumn("segment", 2 * below + own.cast("int")).withColumn("sub", F.when(own, F.pmod("salt", F.lit(SUBS)).cast("int")).otherwise(0)).drop("hot")


def _slots(totals: DataFrame, block_words: int, out_shards: int) -> DataFrame:
    """All slots of the mix: (s, j, pass, block, words, cut, out_shard)."""
    full = F.lit(block_words)
    t = totals.where("source_size > 0").select("s", F.col("source_size").alias("w"), F.floor(F.col("target") + 0.5).alias("take"))
    t = t.select("*", F.ceil(F.col("w") / block_words).alias("b"), F.expr("take div w").alias("pass"), F.expr("take % w").alias("rest"))
    t = t.withColumn("short", F.col("w") - (F.col("b") - 1) * full).withColumn("p", permuted("b - 1", backwards=True))
    n = F.ceil(F.col("rest") / block_words)
    n = F.when(F.col("p") < n, F.ceil((F.col("rest") + full - F.col("short")) / block_words)).otherwise(n)
    t = t.withColumn("n", n)
    done = (F.col("n") - 1) * full - F.when(F.col("p") < F.col("n") - 1, full - F.col("short")).otherwise(0)
    t = t.select("s", "b", (F.col("pass") * F.col("b") + F.col("n")).alias("slots"), F.when(F.col("n") > 0, F.col("rest") - done).alias("cut_at"))
    total = t.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    begun = t.where("slots > 0").withColumn("from", F.explode(F.expr(f"sequence(0L, slots - 1, {SLOTS_A_ROW}L)")))
    begun = begun.repartition(max(1, -(-total // (4 * SLOTS_A_ROW))), "s", "from")
    each = begun.withColumn("j", F.explode(F.expr(f"sequence(from, least(from + {SLOTS_A_ROW} - 1, slots - 1))")))
    # The draw: how many of a source's slots go to each shard.  One row for each source and shard.
    draws = each.groupBy("s", (md5_long(F.concat_ws("|", "s", "j")) % out_shards).cast("int").alias("out_shard")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("s").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = draws.select("s", F.struct(F.sum("n").over(order).alias("upto"), "out_shard").alias("end")).groupBy("s").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    laid = each.join(small(written(ends, "mix-draws")), "s").withColumn("out_shard", F.filter("ends", lambda e: e["upto"] > F.col("j"))[0]["out_shard"])
    laid = laid.withColumn("pass", F.expr("j div b")).withColumn("i", F.expr("j % b"))
    cut = F.col("cut_at").isNotNull() & (F.col("j") == F.col("slots") - 1)
    return laid.select("s", "j", "pass", permuted("i").alias("block"), F.when(cut, F.col("cut_at")).otherwise(full).alias("words"), cut.alias("cut"), "out_shard")


def _with_texts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of documents with what ``parts`` (doc_id, h, start, ...) has of them; rows that agree in doc_id and text are told apart by a number."""
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of())
    numbered = lambda df, order: df.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(order)))
    texts = numbered(docs.withColumn("h", md5_long(mark)), "h")
    p = numbered(parts, "start").withColumnsRenamed({"doc_id": "p_id", "h": "p_h", "twin": "p_twin"})
    return texts.join(p, texts["doc_id"].eqNullSafe(p["p_id"]) & (texts["h"] == p["p_h"]) & (texts["twin"] == p["p_twin"]))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: copy c of a document holds, in order, its words that are taken at least c times.

    A copy that holds all words has the text unchanged; a shorter one has its words
    joined by spaces.  Copies without words are left out.  Returns the columns of
    documents (doc_id, text, lang, source, n_chars).
    """
    mix = plan_mix(docs, block_words)
    whole = F.struct(F.col("from_word").alias("a"), F.col("words").alias("n"))
    part = F.struct(F.col("from_word").alias("a"), F.col("part").alias("n"))
    copies = F.concat(
        F.transform(F.expr("sequence(1, cast(whole as int))"), lambda c: F.struct(c.cast("int").alias("copy"), whole.alias("run"))),
        F.array(F.struct((F.col("whole") + 1).cast("int").alias("copy"), part.alias("run"))),
    )
    copies = F.when(F.col("whole") > 0, copies).otherwise(F.slice(copies, F.size(copies), F.lit(1)))
    runs = mix.pieces.select("doc_id", "h", "size", "s", "start", F.explode(copies).alias("c")).where("c.run.n > 0")
    runs = runs.groupBy("doc_id", "h", "size", "s", "start", F.col("c.copy").alias("copy")).agg(F.sort_array(F.collect_list("c.run")).alias("runs"), F.sum("c.run.n").alias("words"))
    per_doc = runs.groupBy("doc_id", "h", "start", "size").agg(F.collect_list(F.struct("copy", "runs", "words")).alias("copies"))
    joined = _with_texts(docs.select("doc_id", "text", "lang", "source"), per_doc)
    joined = joined.select("doc_id", "text", "lang", "source", "size", F.explode("copies").alias("c"))
    words = joined.withColumn("all_words", F.when(F.col("c.words") < F.col("size"), F.filter(F.split("text", GAPS), lambda x: x != "")))
    picked = F.flatten(F.transform(F.col("c.runs"), lambda r: F.slice(F.col("all_words"), (r["a"] + 1).cast("int"), r["n"].cast("int"))))
    text = F.when(F.col("c.words") == F.col("size"), F.col("text")).otherwise(F.array_join(picked, " "))
    return words.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, out_shards: int = 16) -> DataFrame:
    """The mix as packed blocks: (out_shard, source, j, text, words), a row for each slot; its block's words, joined by spaces, as far as the slot takes them.

    Nulls, repeated rows and empty tables as in ``plan_mix``.
    """
    mix = plan_mix(docs, block_words, out_shards)
    used = mix.slots.select("s", "block").distinct()
    parts = mix.pieces.join(used, ["s", "block"], "left_semi").groupBy("doc_id", "h", "start").agg(F.collect_list(F.struct("s", "block", "in_block", "from_word", "words")).alias("parts"))
    pieces = _with_texts(docs.select("doc_id", "text"), parts).withColumn("all_words", F.filter(F.split("text", GAPS), lambda x: x != ""))
    cut = pieces.select(F.explode(F.transform("parts", lambda p: F.struct(p["s"].alias("s"), p["block"].alias("block"), p["in_block"].alias("at"), F.slice(F.col("all_words"), (p["from_word"] + 1).cast("int"), p["words"].cast("int")).alias("w")))).alias("p"))
    blocks = cut.select("p.*").groupBy("s", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])).alias("w"))  # block_words at most
    slots = mix.slots.select("s", "j", "block", "words", "out_shard").join(blocks, ["s", "block"]).join(small(mix.sources.select("s", "source")), "s")
    taken = F.slice("w", F.lit(1), F.col("words").cast("int"))
    return slots.select("out_shard", "source", "j", F.array_join(taken, " ").alias("text"), F.size(taken).cast("long").alias("words"))


def op5_mix_packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).documents


def _sql_permuted(index: str, backwards: bool = False) -> str:
    rounds = f"range({ROUNDS - 1}, -1, -1)" if backwards else f"range({ROUNDS})"
    other = f"((({_KEY}) + b - x) % b)"
    coin = _COIN.replace("m %", f"greatest(x, {other}) %")
    return f"list_reduce({rounds}, lambda x, r: CASE WHEN {coin} = 1 THEN {other} ELSE x END, ({index})::BIGINT)"


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS w FROM d GROUP BY source),
t1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM t0),
t2 AS (SELECT *, [5.0, 2.0, 1.0][s % 3 + 1]::DOUBLE AS weight, w * 2.0::DOUBLE AS most FROM t1),
t3 AS (
  SELECT *, most / weight AS ratio,
         (1.5::DOUBLE * sum(w) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM t2 WINDOW before AS (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t4 AS (SELECT *, least(most, (SELECT arg_min(level, (ratio, s)) FROM t3 WHERE level <= ratio) * weight) AS target FROM t3),
t5 AS (SELECT *, floor(target + 0.5)::BIGINT AS take, ceil(w / {BLOCK_WORDS})::BIGINT AS b FROM t4 WHERE w > 0),
t6 AS (SELECT *, take // w AS pass, take % w AS rest, w - (b - 1) * {BLOCK_WORDS} AS short FROM t5),
t7 AS (SELECT *, {_sql_permuted("b - 1", True)} AS p, ceil(rest / {BLOCK_WORDS})::BIGINT AS n0 FROM t6),
t8 AS (SELECT *, CASE WHEN p < n0 THEN ceil((rest + {BLOCK_WORDS} - short) / {BLOCK_WORDS})::BIGINT ELSE n0 END AS n FROM t7),
slots AS (SELECT s, b, w, pass AS last_pass, rest, p, n, short, unnest(range(pass * b + n)) AS j FROM t8),
mapped AS (SELECT s, last_pass, rest, p, n, short, b, j, {_sql_permuted("i")} AS block FROM (SELECT *, j // b AS pass, j % b AS i FROM slots)),
draws AS (SELECT s, (('0x' || substr(md5(s || '|' || j), 1, 15))::BIGINT % 16)::INTEGER AS shard, count(*) AS n FROM slots GROUP BY ALL),
ends AS (SELECT s, shard, sum(n) OVER (PARTITION BY s ORDER BY shard) AS upto FROM draws),
cuts AS (
  SELECT s, block, (SELECT min(shard) FROM ends e WHERE e.s = mapped.s AND e.upto > j) AS shard, n > 0 AND j = last_pass * b + n - 1 AS cut,
         rest - ((n - 1) * {BLOCK_WORDS} - CASE WHEN p < n - 1 THEN {BLOCK_WORDS} - short ELSE 0 END) AS cut_at FROM mapped),
uses AS (SELECT s, block, count(*) FILTER (NOT cut) AS whole, coalesce(max(cut_at) FILTER (cut), 0) AS cut_at,
    min(shard) FILTER (NOT cut) AS whole_shard, min(shard) FILTER (cut) AS cut_shard FROM cuts GROUP BY s, block),
placed AS (
  SELECT d.doc_id, d.size, t4.s, t4.w, t4.target,
         sum(d.size) OVER (PARTITION BY t4.s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t4 ON d.source IS NOT DISTINCT FROM t4.source),
pieces AS (SELECT *, unnest(range((start // {BLOCK_WORDS})::BIGINT, ((start + size - 1) // {BLOCK_WORDS})::BIGINT + 1)) AS block FROM placed WHERE size > 0),
cutted AS (
  SELECT *, greatest(start, block * {BLOCK_WORDS}) AS a, least(start + size, (block + 1) * {BLOCK_WORDS}) AS z FROM pieces)
SELECT doc_id, size, w AS source_size, target,
       sum(coalesce(whole, 0) * (z - a) + greatest(0, least(z - a, coalesce(cut_at, 0) - (a - block * {BLOCK_WORDS}))))::BIGINT AS taken,
       min(least(whole_shard, CASE WHEN coalesce(cut_at, 0) > a - block * {BLOCK_WORDS} THEN cut_shard END)) AS shard
FROM cutted LEFT JOIN uses USING (s, block) GROUP BY s, start, doc_id, size, w, target
UNION ALL SELECT doc_id, size, w, target, 0::BIGINT, NULL::INTEGER FROM placed WHERE size = 0
"""
