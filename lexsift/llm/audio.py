"""Chroma audio fingerprints and the alignment of recordings.

Audio is cut into overlapping frames whose spectra are folded into twelve pitch
classes.  Filters compare areas of that image through its integral image; their
outcomes, two bits each, are packed into a 32-bit integer for each frame.  Integers
that agree in three of their four bytes vote for an offset between two recordings; the
offset with most votes is taken, and the bit errors over the overlap decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, flagged, small, table, written

#: Samples a second, of a frame and between frames; frames that the filters see at once.
RATE, FRAME, HOP, SPAN = 11025, 4096, 1365, 16
FILTERS, LOWEST_HZ, HIGHEST_HZ = 16, 28.0, 3520.0
#: Thresholds of a filter's log ratio, and the 2-bit Gray code of the four levels they make.
LEVELS, GRAY = (-0.25, 0.0, 0.25), np.array([0, 1, 3, 2], dtype=np.uint32)
#: Parts of an integer that a key leaves out, one at a time: integers meet if their wrong bits lie in one part.
KEY_MASKS = tuple(0xFFFFFFFF ^ (0xFF << 8 * k) for k in range(4))
#: An alignment needs so many shared keys at one offset, so many frames of overlap, and at most this share of wrong bits.
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 3, 16, 0.2
#: The code of frames whose areas are all alike, and the frames in which a key votes once.
SILENT, STRIDE = -1, 16
#: Rows whose id is divisible by this are the queries of a search.
QUERY_STEP = 100


def _pitch_classes() -> np.ndarray:
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    fold = np.zeros((len(hz), 12))
    inside = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    fold[inside, np.round(12 * np.log2(hz[inside] / 440.0)).astype(int) % 12] = 1
    return fold


_FOLD, _WINDOW, _SMOOTH = _pitch_classes(), np.hamming(FRAME), np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12): normalized energy of the pitch classes, smoothed over five frames; mono samples at RATE."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 5:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    out = np.empty((n, 12))
    for i in range(0, n, 512):  # bounded memory for long recordings
        spectrum = np.fft.rfft(frames[i : i + 512] * _WINDOW)
        out[i : i + 512] = (spectrum.real**2 + spectrum.imag**2) @ _FOLD
    smooth = sum(w * out[k : n - 4 + k] for k, w in enumerate(_SMOOTH))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-2, smooth / np.maximum(norm, 1e-9), 0)


def packed(image: np.ndarray) -> np.ndarray:
    """32-bit integers of a chroma image, one for each run of SPAN frames."""
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.cumsum(np.cumsum(np.hstack([image, image]), axis=0), axis=1)  # classes wrap around

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = total[t : t + n], total[t + w : t + w + n]
        return b[:, y + h] - b[:, y] - a[:, y + h] + a[:, y]

    out = np.zeros(n, dtype=np.uint32)
    for k in range(FILTERS):
        y, h, w = 7 * k % 12, 2 + 2 * (k % 3), 4 + 4 * (k // 4)
        t = (SPAN - w) // 2
        if k % 4 == 0:  # lower against higher classes
            a, b = area(t, w, y, h // 2), area(t, w, y + h // 2, h // 2)
        elif k % 4 == 1:  # earlier against later
            a, b = area(t, w // 2, y, h), area(t + w // 2, w // 2, y, h)
        elif k % 4 == 2:  # one diagonal against the other
            a = area(t, w // 2, y, h // 2) + area(t + w // 2, w // 2, y + h // 2, h // 2)
            b = area(t, w // 2, y + h // 2, h // 2) + area(t + w // 2, w // 2, y, h // 2)
        else:  # the middle against both sides
            a = area(t + w // 4, w // 2, y, h)
            b = area(t, w // 4, y, h) + area(t + 3 * w // 4, w // 4, y, h)
        ratio = np.log((a + 0.1) / (b + 0.1))
        out = (out << np.uint32(2)) | GRAY[np.digitize(ratio, LEVELS)]
    return out


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The packed integers of mono samples; other rates are resampled linearly.  Too short or silent audio: as far as it goes."""
    samples = np.nan_to_num(np.asarray(samples, dtype=np.float64))
    if rate != RATE and len(samples):
        samples = np.interp(np.arange(int(len(samples) * RATE / rate)) * rate / RATE, np.arange(len(samples)), samples)
    return packed(chroma(samples))


def melody(vector: list[float] | None, note_s: float = 0.125) -> np.ndarray:
    """A recording that stands for a vector: each value sounds as a note of three octaves from C3 on, with two overtones."""
    if not vector:
        return np.zeros(0)
    values = np.clip((np.nan_to_num(np.asarray(vector, dtype=np.float64)) + 0.4) / 0.8, 0, 1)
    hz = 440.0 * 2 ** ((48 + np.round(values * 36) - 69) / 12)
    phase = np.cumsum(np.repeat(hz, int(RATE * note_s)) * (2 * np.pi / RATE))
    s = np.sin(phase)
    return s + s * np.cos(phase) + 0.25 * np.sin(3 * phase)  # sin 2x = 2 sin x cos x


def fingerprints(rows: DataFrame, rec_id: str, media: str, listen: Callable[[object], np.ndarray]) -> DataFrame:
    """(rec_id, codes array<int>) of the media column, which ``listen`` turns into mono samples at RATE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [fingerprint(listen(x)).view(np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int32()))], ["rec_id", "codes"])

    return rows.select(F.col(rec_id).cast("long").alias("rec_id"), media).mapInArrow(run, "rec_id long, codes array<int>")


def pcm16(data: bytes | None) -> np.ndarray:
    """Samples of 16-bit little-endian mono audio at RATE, from -1 to 1."""
    return np.frombuffer((data or b"")[: len(data or b"") // 2 * 2], dtype="<i2") / 32768.0


def _unsigned(code: Column) -> Column:
    return code.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _overlap(a: Column, b: Column, offset: Column) -> tuple[Column, Column]:
    """The parts of two code arrays that meet if b begins ``offset`` frames after a."""
    n = F.least(F.size(a) - F.greatest(offset, F.lit(0)), F.size(b) - F.greatest(-offset, F.lit(0)))
    return F.slice(a, F.greatest(offset, F.lit(0)) + 1, F.greatest(n, F.lit(0))), F.slice(b, F.greatest(-offset, F.lit(0)) + 1, F.greatest(n, F.lit(0)))


def _voters(df: DataFrame, c: str) -> DataFrame:
    """(c, c_at, k, v): the keys of a class's codes.  A key votes once in STRIDE frames, so held tones don't meet frame by
    frame; codes without any difference, silence above all, say nothing and have no vote."""
    keys = lambda code, i: F.array(*(F.struct(F.lit(k).alias("k"), _unsigned(code).bitwiseAND(F.lit(m)).alias("v"), i.alias("at")) for k, m in enumerate(KEY_MASKS)))
    none = F.array().cast("array<struct<k:int,v:bigint,at:int>>")
    every = F.flatten(F.transform("codes", lambda code, i: F.when(code != SILENT, keys(code, i)).otherwise(none)))
    rows = df.select("class_id", F.array_sort(every).alias("keys"))

    def first(x: Column, i: Column) -> Column:
        before = F.get("keys", i - 1)
        return (i == 0) | (before["k"] != x["k"]) | (before["v"] != x["v"]) | (F.floor(before["at"] / STRIDE) != F.floor(x["at"] / STRIDE))

    return rows.select(F.col("class_id").alias(c), F.inline(F.filter("keys", first))).select(c, F.col("at").alias(f"{c}_at"), "k", "v")


def meetings(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, q_at, c, c_at): where a key of a query class is one of another class.

    Only keys that some query has move.  A key that very many codes of the classes have is dealt
    over several tasks, and the queries' codes with it go to each of them.
    """
    asked = written(_voters(queries, "q"), "asked")
    held = flagged(_voters(classes, "c"), F.xxhash64("k", "v"), asked, F.xxhash64("k", "v"), "maybe").where("maybe").drop("maybe")
    held = written(held, "held")
    often = written(held.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("k", "v", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")), "often")
    parts = F.coalesce("parts", F.lit(1))
    q = asked.join(small(often), ["k", "v"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    c = held.join(small(often), ["k", "v"], "left").withColumn("part", F.pmod(F.xxhash64("c", "c_at"), parts).cast("int")).drop("parts")
    return q.join(c, ["k", "v", "part"]).where("q <> c")


def aligned(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """(class_id, other_id, offset, votes, overlap, bit_error): the classes (class_id, codes) that align with each query class."""
    met = meetings(classes, queries)
    votes = met.groupBy("q", "c", (F.col("q_at") - F.col("c_at")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= MIN_VOTES)
    best = votes.groupBy("q", "c").agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.abs("offset"), "offset")).alias("b"))
    a, b = queries.select(F.col("class_id").alias("q"), F.col("codes").alias("a")), classes.select(F.col("class_id").alias("c"), F.col("codes").alias("b"))
    both = best.withColumnRenamed("b", "best").join(a, "q").join(b, "c")
    x, y = _overlap(F.col("a"), F.col("b"), F.col("best.offset"))
    met = both.select("q", "c", "best.*", x.alias("x"), y.alias("y"))
    # bit_count takes 64 bits, of which a negative integer has 32 too many.
    wrong = F.aggregate(F.zip_with("x", "y", lambda i, j: F.bit_count(_unsigned(i.bitwiseXOR(j)))), F.lit(0), lambda s, v: s + v)
    rated = met.select(F.col("q").alias("class_id"), F.col("c").alias("other_id"), "offset", "votes", F.size("x").alias("overlap"), (wrong / (32.0 * F.greatest(F.size("x"), F.lit(1)))).alias("bit_error"))
    return rated.where((F.col("overlap") >= MIN_OVERLAP) & (F.col("bit_error") <= MAX_ERROR))


def search(prints: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """Membership and matches of recordings (rec_id, codes).

    Recordings with equal codes form a class, named by its smallest rec_id (a null one only if
    it has no other; its rows then have no class name).  A row of kind ``member`` for every recording: rec_id,
    class_id, is_query.  A row of kind ``match`` for every class that aligns with the class
    of a query (rec_id divisible by ``step``): class_id (of the query), other_id, offset
    (frames by which the other begins later), votes, overlap, bit_error.  Recordings too short for a
    code form one class that matches none, and so does silence.  An empty table gives an empty result.
    """
    key = F.xxhash64("codes")
    prints = prints.withColumn("k1", key).withColumn("k2", F.hash("codes"))
    is_query = F.coalesce(F.col("rec_id") % step == 0, F.lit(False))
    classes = written(prints.groupBy("k1", "k2").agg(F.min("rec_id").alias("class_id"), F.max(is_query).alias("asks"), F.first("codes").alias("codes")), "sounds")
    members = prints.select("rec_id", "k1", "k2", is_query.alias("is_query")).join(classes.select("k1", "k2", "class_id"), ["k1", "k2"])
    named = classes.where("class_id IS NOT NULL")
    matches = aligned(named, named.where("asks"))
    return members.select(F.lit("member").alias("kind"), "rec_id", "class_id", "is_query").unionByName(matches.withColumn("kind", F.lit("match")), allowMissingColumns=True)


def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings``, each sounded as a melody: the tables have no audio of their own."""
    return search(written(fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", melody), "chroma"))
