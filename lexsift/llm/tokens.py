"""Token counts without ids: pieces are counted once for each distinct pre-token.

Documents turn into pre-token frequencies.  Each distinct pre-token is run through the
tokenizer once, which gives a table (pre-token, pieces), and frequencies meet the
table in two ways: a head of frequent pre-tokens, of bounded size, is broadcast; all
others join by shuffle, where no key is frequent any more.  The head is picked from a
sample of rows of all partitions; it decides which way a pre-token takes, never what
it counts.  Pre-tokens that are too long to be keys are measured where they stand.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Distinct strings that are broadcast, and their UTF-8 bytes together, at most.
HEAD, HEAD_BYTES = 1 << 18, 1 << 24
#: Bytes over which a string is no key: a task works it out itself, each time it meets it.
KEY_BYTES = 256
#: Rows, about, that the head is picked from.
SAMPLE = 50_000
#: Strings that are tokenized at once.
STEP = 512
#: Distinct strings that a task counts, and rows that it gathers, before it hands them on.
FLUSH, ROWS = 1 << 17, 1 << 14
#: Tokens over which a document is marked.
LIMIT = 512

Splitter = Callable[[str], list[str]]


def is_key(string: str) -> bool:
    return len(string) <= KEY_BYTES // 4 or len(string.encode()) <= KEY_BYTES


def counted_strings(docs: DataFrame, split: Splitter) -> DataFrame:
    """(piece, n): how often each string occurs that ``split`` cuts from the texts, those aside that are no keys.  Tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(filter(is_key, split(text)))
                    if len(seen) > FLUSH:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_strings(docs: DataFrame, split: Splitter, rows: int = HEAD, sample: int = SAMPLE) -> DataFrame:
    """(piece): at most ``rows`` strings that ``split`` cuts often from the texts of about ``sample`` rows, drawn from all partitions."""
    step = max(1, docs.count() // max(1, sample))
    if step > 1:
        docs = docs.where(F.pmod(F.xxhash64(F.lit("head"), F.monotonically_increasing_id()), F.lit(step)) == 0)
    counts = written(counted_strings(docs, split), "strings")
    return counts.where(head_of(counts, rows)).select("piece")


def head_of(pieces: DataFrame, rows: int = HEAD, most_bytes: int = HEAD_BYTES) -> Column:
    """The condition that picks the most frequent strings of (piece, n), within both bounds: n at or over a threshold."""
    # Sums by level (16 for each doubling) are a few hundred numbers, whatever the corpus.
    level = F.floor(F.log2("n") * 16)
    sums = pieces.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum(F.octet_length("piece")).alias("size"), F.min("n").alias("least"))
    total, size, threshold = 0, 0, None
    for r in sorted(sums.collect(), key=lambda r: -r["level"]):
        total, size = total + r["k"], size + r["size"]
        if total > rows or size > most_bytes:
            break
        threshold = r["least"]
    return F.col("n") >= threshold if threshold is not None else F.lit(False)


class Pretokenizer:
    """Splits texts as a byte-level BPE tokenizer file says; added tokens are cut out first, as the library does."""

    def __init__(self, path: str):
        # The driver reads the file; executors get its content with the function.
        self.source = open(path, encoding="utf-8").read()
        spec = json.loads(self.source)
        pre = spec["pre_tokenizer"]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not plain:
            raise ValueError("only byte-level BPE files without normalizer, prefix space and special added tokens are split here")
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: Fixed value: the split pattern of byte-level BPE vocabularies.
        self.pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def splitter(self) -> Splitter:
        find = regex.compile(self.pattern).findall
        special = self.special
        cut = regex.compile("|".join(map(regex.escape, special))).split if special else None

        def split(text: str) -> list[str]:
            if cut and any(s in text for s in special):
                return [x for part in cut(text) for x in find(part)]
            return find(text)

        return split

    def specials(self) -> Callable[[str], int]:
        special = self.special
        count = regex.compile("|".join(map(regex.escape, special))).findall if special else None
        return lambda text: len(count(text)) if count and any(s in text for s in special) else 0

    def counter(self) -> Callable[[list[str]], list[int]]:
        # Tasks are parallel already; the library's own threads would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.source)
        # The library's encodings are large: a few at a time.
        return lambda texts: [len(e.ids) for i in range(0, len(texts), STEP) for e in tokenizer.encode_batch(texts[i : i + STEP], add_special_tokens=False)]


def _lazily(make: Callable[[], Splitter]) -> Splitter:
    """A splitter that is made at the first call (compiled patterns don't travel)."""
    made: list[Splitter] = []

    def split(text: str) -> list[str]:
        if not made:
            made.append(make())
        return made[0](text)

    return split


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, head_rows: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document (doc_id, text).

    Counts equal the library's for the file, without begin and end tokens; the file's
    added tokens count one each where a text holds them.  A null text is empty (0 bytes,
    0 tokens).  Every row gets its own result, whether or not doc_ids or texts repeat; an
    empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    pre = Pretokenizer(tokenizer_file)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pre.counter()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(0).to_pylist()), pa.int64())], ["piece", "n_pieces"])

    measured = frequent_strings(docs, _lazily(pre.splitter), head_rows).mapInArrow(measure, "piece string, n_pieces long").toArrow()  # HEAD rows at most
    head = spark.sparkContext.broadcast(dict(zip(measured["piece"].to_pylist(), measured["n_pieces"].to_pylist())))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a row of documents one without a piece (doc_id, bytes and what the head gives) and one for each other distinct pre-token."""
        split, specials, known = pre.splitter(), pre.specials(), head.value
        count = pre.counter()
        names = ["row", "piece", "n", "doc_id", "n_bytes"]
        rows: tuple[list, ...] = tuple([] for _ in names)

        def out() -> pa.RecordBatch:
            arrays = [pa.array(x, pa.string() if k == 1 else pa.int64()) for k, x in enumerate(rows)]
            for x in rows:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                total = specials(text)
                for name, n in Counter(split(text)).items():
                    k = known.get(name)
                    if k is None and not is_key(name):
                        k = count([name])[0]
                    if k is None:
                        for x, value in zip(rows, (row, name, n, None, None)):
                            x.append(value)
                    else:
                        total += k * n
                for x, value in zip(rows, (row, None, total, doc_id, len(text.encode()))):
                    x.append(value)
                if len(rows[0]) > ROWS:
                    yield out()
            yield out()

    # Rows are numbered as they are read; the numbers are written with what is counted, so they stay as they are.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(numbered.mapInArrow(frequencies, "row long, piece string, n long, doc_id long, n_bytes long"), "frequencies")
    others = found.where("piece IS NOT NULL").select("row", "piece", "n")
    pieces = others.select("piece").distinct().mapInArrow(measure, "piece string, n_pieces long")
    rare = others.join(pieces, "piece").select("row", (F.col("n") * F.col("n_pieces")).alias("n"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"))
    base = found.where("piece IS NULL").select("row", "n", "doc_id", "n_bytes")
    sums = rare.unionByName(base).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_count_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
