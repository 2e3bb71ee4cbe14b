"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model has a whitespace marker after another character, a text
falls into chunks (markers and the characters up to the next marker) that are
segmented independently.  A table (chunk, ids, decoded) holds each distinct chunk of the
corpus once.  Frequent chunks, of bounded number, are broadcast.  Texts are taken in
blocks of bounded size; a block's other distinct chunks join the table by shuffle, and
the block meets them, compressed, to join its documents' ids by position.
"""

from __future__ import annotations

import hashlib
import marshal
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import HEAD, ROWS, STEP, frequent_strings, is_key

MARK = "▁"
#: Characters of a block, about; a longer text is a block of its own.
BLOCK_CHARS = 1 << 24
#: Entries that a task gathers, by block, before it hands them on.
GATHERED = 1 << 17
#: Compression of what goes to a block.
LEVEL = 7
#: A chunk's entry: its ids in decimal, joined by commas, and what they decode to (None: the chunk itself).
Entry = tuple[str, str | None]


class ChunkModel:
    """A model file as bytes, so that executors need no path, and the segmentation of chunks with it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()
        self.check()

    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    def check(self) -> None:
        """Raises ValueError if chunks can't be segmented on their own with this model."""
        sp = self.processor()
        crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
        # The probes hold if text is neither normalized nor stripped and gets one marker in front.
        probes = ["  a ", "ﬁⅨ  é\ta\nb"]
        if crossing or any(sp.decode(sp.encode(p)) != p for p in probes) or sp.encode(" a") == sp.encode("a"):
            raise ValueError("the model's pieces cross whitespace markers, or it changes white space")

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks of a text, markers as spaces, each without its first one: that is what stands between single spaces."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        return parts if "" not in parts else [c[1:] for c in re.findall(" +[^ ]*", f" {text}")]

    @staticmethod
    def entries(sp, chunks: list[str]) -> list[Entry]:
        """Each chunk's entry; the library itself puts the first marker in front."""
        encoded = sp.encode(chunks, num_threads=1)
        decoded = sp.decode(encoded, num_threads=1) if encoded else []
        # The marker alone is the text "", which the library leaves without ids.
        lone = (str(sp.piece_to_id(MARK)), None)
        return [(",".join(map(str, i)), None if d == c else d) if c else lone for c, i, d in zip(chunks, encoded, decoded)]


Block = tuple[int, list[int | None], list[str]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """(block, doc_ids, texts): a partition's rows in blocks, whatever batches they come in.

    A block is named by a hash of its rows, so it has the same name whichever stage reads them; equal blocks share their chunks.
    """
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                yield _block_name(ids, texts), ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield _block_name(ids, texts), ids, texts


def _block_name(ids: list[int | None], texts: list[str]) -> int:
    digest = xxhash.xxh64(repr(ids))
    for text in texts:
        digest.update(text)
    return digest.intdigest() - (1 << 63)


def _packed(ids: list[int | None], texts: list[str]) -> bytes:
    """A block's rows as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue(), LEVEL)


def _entries(gathered: dict[int, list[tuple[str, str, str | None]]]) -> pa.RecordBatch:
    """(block, entries): a block's chunks, their ids, and the chunks that don't decode to themselves, compressed."""
    rows = [zstandard.compress(marshal.dumps(([c for c, _, _ in x], [i for _, i, _ in x], {c: d for c, _, d in x if d is not None})), LEVEL) for x in gathered.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(gathered), pa.int64()), pa.array(rows, pa.binary())], ["block", "entries"])


def encode_decode(docs: DataFrame, model_file: str, head_rows: int = HEAD, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for every document (doc_id, text).

    Ids and decoded text equal the library's, without begin and end ids.  A null or empty
    text has no ids and decodes to the empty text.  Rows that repeat each get a row; an
    empty table gives an empty result.  Other columns are ignored.  Chunks of over 256
    bytes are no keys: they are segmented where they stand.
    """
    spark = docs.sparkSession
    model = ChunkModel(model_file)
    chunks = ChunkModel.chunks
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model.processor()
        for b in batches:
            parts = b.column(0).to_pylist()
            for i in range(0, len(parts), STEP):
                ids, texts = zip(*ChunkModel.entries(sp, parts[i : i + STEP]))
                yield pa.RecordBatch.from_arrays([pa.array(parts[i : i + STEP], pa.string()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["chunk", "ids", "decoded"])

    found = frequent_strings(docs, chunks, head_rows).mapInArrow(segment, "chunk string, ids string, decoded string").toArrow()  # HEAD rows at most
    names, ids, decoded = (found[c].to_pylist() for c in found.column_names)
    # Ids by chunk, and the few chunks that don't decode to themselves.
    head = spark.sparkContext.broadcast((dict(zip(names, ids)), {c: d for c, d in zip(names, decoded) if d is not None}))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, chunk): the distinct chunks of each block that the head doesn't have."""
        for block, _, texts in _blocks(batches):
            seen: set[str] = set()
            for text in texts:
                seen.update(chunks(text))
            rare = [c for c in seen if c not in head.value[0] and is_key(c)]
            for i in range(0, len(rare), ROWS):
                part = rare[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], ["block", "chunk"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, entries): each distinct chunk, of rows (block, chunk) in the order of chunks, is segmented once, and goes to the blocks that have it."""
        sp = model.processor()
        gathered: dict[int, list[tuple[str, str, str | None]]] = {}
        size, last = 0, None
        for batch in batches:
            blocks, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [c for c in dict.fromkeys(names) if last is None or c != last[0]]
            table = {} if last is None else {last[0]: last}
            for i in range(0, len(new), STEP):
                table.update(zip(new[i : i + STEP], zip(new[i : i + STEP], *zip(*ChunkModel.entries(sp, new[i : i + STEP])))))
            for block, chunk in zip(blocks, names):
                gathered.setdefault(block, []).append(table[chunk])
            size += len(names)
            last = table[names[-1]] if names else last
            if size >= GATHERED:
                yield _entries(gathered)
                gathered, size = {}, 0
        if gathered:
            yield _entries(gathered)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(ids, texts)], pa.binary())], ["block", "packed"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rare = docs.mapInArrow(others, "block long, chunk string").repartition(tasks, "chunk").sortWithinPartitions("chunk")
    entries = rare.mapInArrow(shared, "block long, entries binary").select("block", "entries", F.lit(None).cast("binary").alias("packed"))
    packed = docs.mapInArrow(pack, "block long, packed binary").select("block", F.lit(None).cast("binary").alias("entries"), "packed")
    # Of a block its chunks come first, then its texts.
    both = entries.unionByName(packed).repartition(tasks, "block").sortWithinPartitions("block", F.col("packed").isNotNull())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model.processor()
        frequent, frequent_odd = head.value
        own: dict[str, str] = {}
        odd = frequent_odd
        current: int | None = None
        for batch in batches:
            for block, known, content in zip(*(c.to_pylist() for c in batch.columns)):
                if block != current:
                    current, own, odd = block, {}, dict(frequent_odd)
                if content is None:
                    names, ids, others = marshal.loads(zstandard.decompress(known))
                    own.update(zip(names, ids))
                    odd.update(others)
                else:
                    for rows in pa.ipc.open_stream(zstandard.decompress(content)):
                        yield from encoded(sp, frequent.get, own, odd, rows)

    def encoded(sp, frequent: Callable[[str], str | None], own: dict[str, str], odd: dict[str, str], rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc_ids, texts = rows.column(0), rows.column(1).to_pylist()
        for i in range(0, len(texts), STEP):
            out: list[list] = [[] for _ in range(4)]
            for text in texts[i : i + STEP]:
                parts = chunks(text)
                found, special = list(map(frequent, parts)), odd
                if None in found:
                    found = [own.get(c) if e is None else e for c, e in zip(parts, found)]
                    if None in found:  # chunks that are no keys
                        new = list(dict.fromkeys(c for c, e in zip(parts, found) if e is None))
                        fresh = dict(zip(new, ChunkModel.entries(sp, new)))
                        found = [fresh[c][0] if e is None else e for c, e in zip(parts, found)]
                        special = odd | {c: d for c, (_, d) in fresh.items() if d is not None}
                ids = ",".join(found)
                decoded = " ".join(parts if special.keys().isdisjoint(parts) else [special.get(c, c) for c in parts])
                out[0].append(ids.count(",") + 1 if found else 0)
                out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                out[3].append(list(map(int, ids.split(","))) if with_ids and ids else [])
            arrays = [doc_ids.slice(i, STEP), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return both.mapInArrow(encode, schema)


def op7_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
