"""Quality rules with n-gram perplexity.

Character 4-grams are counted by Spark over all different texts, for each language.  The
counts become interpolated modified Kneser-Ney probabilities (Chen and Goodman 1998), also
in Spark: a table (lang, gram, probability) that grows with the corpus and has every
n-gram of every text.  Its most frequent rows, of bounded number, are broadcast as sorted
hash arrays; what a text has besides meets the table by a shuffled join.  A document's
perplexity is taken per word, lone marks aside.  Each language has a lower and an upper band around the
median of its different texts, wider for short ones; documents outside of the bands are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, flagged, prefix, small, table, text_of, written

#: Characters of an n-gram, of 16 bits each: any of the basic plane as it is, others by the low bits of their number.
ORDER, BITS = 4, 16
#: Of orders over 2, n-grams that are counted once tell of one text alone: their mass goes to the lower order.
SELDOM_FROM = 3
#: N-grams that are broadcast at most (12 bytes each).
HEAD = 1 << 20
#: Widths of the lower and the upper band in standard deviations, set by the labels of the test tables so that nearly all good pages stay.
LOWER, UPPER = 3.5, 6.0
#: The rules' limits.
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Least standard deviation of a language's long texts, and texts that double the bands of a language with as few: few or equal texts say little of the spread.
LEAST_SPREAD, FEW_TEXTS = 0.01, 10
#: The characters that count as symbols.
SYMBOL_CHARS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_AT_ONCE = 1 << 21  # characters that are counted or scored at once
_KEEP = 1 << 19  # distinct n-grams that a task counts before it hands them on
_ROWS = 1 << 14  # rows that a task gathers before it hands them on


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit characters of several texts in one array, ORDER - 1 zeros before each, and the texts' lengths."""
    pad = "\0" * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "replace"), dtype="<u4")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    # Characters outside of the basic plane take the numbers that surrogates leave free.
    return np.where(raw < 0x10000, raw, 0xD800 | raw & 0x7FF).astype(np.int64), lengths


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each character of the texts, and the texts' lengths."""
    codes, lengths = _characters(texts)
    size = len(codes) - ORDER + 1
    out = np.zeros(max(0, size), dtype=np.int64)
    for k in range(ORDER):
        out = (out << BITS) | codes[k : k + size]
    keep = np.ones(len(out), dtype=bool)  # n-grams that end in the zeros before a text are no n-grams
    starts = np.cumsum(lengths + ORDER - 1)[:-1] - (ORDER - 1)
    for k in range(ORDER - 1):
        keep[starts + k] = False
    return out[keep], lengths


def stretches(text: str) -> Iterator[tuple[str, int]]:
    """A long text in parts, each with its characters before it as far as an n-gram reaches back, and their number."""
    for i in range(0, len(text), _AT_ONCE):
        head = text[max(0, i - ORDER + 1) : i]
        yield head + text[i : i + _AT_ONCE], len(head)


def _hashed(codes: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finalizer of SplitMix64) of n-gram codes."""
    x = codes.view(np.uint64) if codes.dtype == np.int64 else codes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArray:
    """Log probabilities of n-grams, sorted by hash; a hash's leading bits say where it begins."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        keys = _hashed(codes)
        sort = np.argsort(keys)
        self.keys, self.logs = keys[sort], logs[sort].astype(np.float32)
        self.bits = max(1, int(len(keys)).bit_length())
        self.starts = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.longest = int(np.diff(np.append(self.starts, len(keys))).max(initial=0))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each code (0 where it isn't known), and which are known."""
        logs, known = np.zeros(len(codes), dtype=np.float64), np.zeros(len(codes), dtype=bool)
        if not len(self.keys):
            return logs, known
        h = _hashed(codes)
        at = self.starts[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        left = np.arange(len(codes))
        for _ in range(self.longest):
            inside = at < len(self.keys)
            left, at, h = left[inside], at[inside], h[inside]
            hit = self.keys[at] == h
            logs[left[hit]], known[left[hit]] = self.logs[at[hit]], True
            # Hashes ascend: what is below the next one isn't there.
            on = ~hit & (self.keys[at] < h)
            left, at, h = left[on], at[on] + 1, h[on]
            if not len(left):
                break
        return logs, known


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: none), and how many of its words are one mark alone."""
    text = text or ""
    words = text.encode().split()  # at the six ASCII blanks
    chars = len(text) - sum(map(text.count, _BLANK))
    marks = sum(map(text.count, SYMBOL_CHARS))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = 0
    if len(words) > REPEAT_WINDOW:
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.uint64)
        n = len(ids) - REPEAT_WINDOW + 1
        if len(names) <= len(words) - REPEAT_WINDOW:  # a window that comes twice repeats that many words
            windows = np.zeros(n, dtype=np.uint64)
            for k in range(REPEAT_WINDOW):
                windows = (windows ^ _hashed(ids[k : k + n] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))) * np.uint64(0x100000001B3)
            sort = np.argsort(windows, kind="stable")
            same = windows[sort][1:] == windows[sort][:-1]
            twice = np.zeros(n, dtype=bool)
            twice[sort[1:][same]] = True
            twice[sort[:-1][same]] = True
            covered = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(covered, np.flatnonzero(twice), 1)
            np.add.at(covered, np.flatnonzero(twice) + REPEAT_WINDOW, -1)
            repeated = int((np.cumsum(covered)[:-1] > 0).sum())
    alone = sum(len(w) == 1 and not w.isalnum() for w in words)
    return len(words), chars, marks, len(lines) - len(set(lines)), repeated, alone


def _language() -> Column:
    """A language's name after a plus sign; null: a minus."""
    return F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("-"))


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, k): ``lang`` as ``_language`` has it, ``k`` a hash of the text."""
    return docs.select("doc_id", "text", _language().alias("lang"), F.xxhash64(text_of()).alias("k"))


def different_texts(named: DataFrame) -> DataFrame:
    """(lang, text): each text of a language once.  Only texts that may have copies move."""
    both = F.xxhash64("lang", "k")
    rows = named.select("lang", "k", "text").where("length(text) > 0")
    several = rows.groupBy(both.alias("lk")).agg(F.count("*").alias("n")).where("n > 1")
    marked = flagged(rows, both, several, F.col("lk"), "maybe")
    once = marked.where("maybe").groupBy("lang", "k").agg(F.first("text").alias("text"))
    return marked.where("NOT maybe").select("lang", "text").unionByName(once.select("lang", "text"))


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of the full order, counted over all rows (lang, text)."""

    def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sort = np.argsort(codes, kind="stable")
        codes, counts = codes[sort], counts[sort]
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[starts], np.add.reduceat(counts, starts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[str]] = {}
        size = 0

        def add() -> None:
            for lang, texts in waiting.items():
                short = [t for t in texts if len(t) <= _AT_ONCE]
                new = [np.unique(grams(short)[0], return_counts=True)] if short else []
                for t in texts:
                    if len(t) > _AT_ONCE:
                        new += [np.unique(grams([part])[0][n:], return_counts=True) for part, n in stretches(t)]
                if lang in sums:
                    new.append(sums[lang])
                sums[lang] = merged(np.concatenate([x for x, _ in new]), np.concatenate([n for _, n in new])) if len(new) > 1 else new[0]
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(codes), dtype=np.int32))), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= _AT_ONCE:
                    add()
                    size = 0
                    if sum(len(x) for x, _ in sums.values()) > _KEEP:
                        yield from out()
        add()
        yield from out()

    return texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_count(values: list[Column], n: Column) -> Column:
    return F.when(n == 1, values[0]).when(n == 2, values[1]).otherwise(values[2])


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): discounts of n-grams that are counted once, twice, and more often."""
    of = counts.groupBy("lang").agg(*(F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = lambda c, most: F.least(F.greatest(c, F.lit(0.05)), F.lit(most))
    return of.select(
        "lang",
        cut(1 - 2 * y * F.col("n2") / F.col("n1"), 0.95).alias("d1"),
        cut(2 - 3 * y * F.col("n3") / F.col("n2"), 1.95).alias("d2"),
        cut(3 - 4 * y * F.col("n4") / F.col("n3"), 2.95).alias("d3"),
    )


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, n, p): the probability of each n-gram's last character after the others, from (lang, gram, n), written.

    Lower orders count the different characters before an n-gram.  p of order k is
    ``(n - d) / total + rest * p of order k - 1``; the rest is what the discounts, and the
    n-grams that are too seldom to count, leave of their context's mass.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels[k] = written(levels[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams")
    below = levels[1].groupBy("lang").agg((1 / F.count("*")).alias("lower"))
    for k in range(1, ORDER + 1):
        found = levels[k].join(small(written(_discounts(levels[k]), "discounts")), "lang")
        mass = F.greatest(F.col("n") - _by_count([F.col(f"d{i}") for i in (1, 2, 3)], F.col("n")), F.lit(0.0))
        if k >= SELDOM_FROM:
            mass = F.when(F.col("n") > 1, mass).otherwise(F.lit(0.0))
        found = found.select("lang", "gram", "n", F.shiftrightunsigned("gram", BITS).alias("context"), mass.alias("mass"))
        same = Window.partitionBy("lang", "context")  # at most as many rows as there are characters
        found = found.withColumn("total", F.sum("n").over(same)).withColumn("rest", 1 - F.sum("mass").over(same) / F.col("total"))
        if k == 1:
            found = found.join(small(written(below, "lower")), "lang")
        else:
            found = found.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"])
        below = written(found.select("lang", "gram", "n", (F.col("mass") / F.col("total") + F.col("rest") * F.col("lower")).alias("p")), "probabilities")
    for k in range(1, ORDER):
        dropped(levels[k])
    return below


def head_arrays(known: DataFrame, most: int) -> tuple[dict[str, HashArray], bool]:
    """Sorted hash arrays by language of the n-grams that are counted most often, ``most`` at most, and whether these are all."""
    level = F.floor(F.log2("n") * 16)
    total, threshold, whole = 0, None, True
    for r in sorted(known.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect(), key=lambda r: -r["level"]):
        total += r["k"]
        if total > most:
            whole = False
            break
        threshold = r["least"]
    if threshold is None:
        return {}, whole
    rows = known.where(F.col("n") >= threshold).select("lang", "gram", F.log("p").cast("float").alias("log_p")).toArrow()
    names = rows["lang"].combine_chunks().dictionary_encode()
    of, codes, logs = names.indices.to_numpy(), rows["gram"].to_numpy(), rows["log_p"].to_numpy()
    return {lang: HashArray(codes[of == i], logs[of == i]) for i, lang in enumerate(names.dictionary.to_pylist())}, whole


def score_texts(head: HashArray, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The negative log probability of each text by what the head knows, and of texts with other n-grams (number of the text, their codes)."""
    out, unknown = np.zeros(len(texts)), []
    begin = 0
    while begin < len(texts):  # a bounded number of characters at once
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + len(texts[end]) <= _AT_ONCE):
            total += len(texts[end])
            end += 1
        parts = list(stretches(texts[begin])) if end == begin + 1 else [(t, 0) for t in texts[begin:end]]
        for group in [[x] for x in parts] if end == begin + 1 else [parts]:
            codes, lengths = grams([t for t, _ in group])
            owner = np.repeat(np.arange(begin, begin + len(group)) if end > begin + 1 else np.full(1, begin), lengths)
            codes, owner = codes[group[0][1] :], owner[group[0][1] :]
            logs, known = head.find(codes)
            out[begin:end] -= np.bincount(owner - begin, logs, end - begin)
            if not known.all():
                missed, of = codes[~known], owner[~known]
                cuts = np.flatnonzero(np.diff(of)) + 1
                unknown += [(int(o[0]), c) for o, c in zip(np.split(of, cuts), np.split(missed, cuts))]
        begin = end
    return out, unknown


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COUNTS = [*_BASE, "n_alone"]


def scored(named: DataFrame, known: DataFrame, head_rows: int = HEAD) -> DataFrame:
    """(row, doc_id, lang, k, base counts, nll) of every row, written; ``nll``: the negative log probability of the text by the table ``known``."""
    head, whole = head_arrays(known, head_rows)
    arrays = named.sparkSession.sparkContext.broadcast(head)
    names = ["row", "doc_id", "lang", "k", *_COUNTS, "nll", "gram", "n"]
    schema = "row long, doc_id long, lang string, k long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", nll double, gram long, n long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = HashArray(np.zeros(0, dtype=np.int64), np.zeros(0))
        for batch in batches:
            row, doc_id, lang, k = batch.columns[:4]
            texts, langs = [t or "" for t in batch.column(4).to_pylist()], lang.to_pylist()
            nll, more = np.zeros(len(texts)), []
            for name in set(langs):
                at = [i for i, x in enumerate(langs) if x == name and texts[i]]
                if at:
                    nll[at], others = score_texts(arrays.value.get(name, none), [texts[i] for i in at])
                    more += [(at[i], codes) for i, codes in others]
            base = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(_COUNTS))
            nothing = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([row, doc_id, lang, k, *(pa.array(base[:, i], pa.int64()) for i in range(len(_COUNTS))), pa.array(nll, pa.float64()), nothing, nothing], names)
            for i, codes in more:
                codes, counts = np.unique(codes, return_counts=True)
                for j in range(0, len(codes), _ROWS):
                    size = len(codes[j : j + _ROWS])
                    nothing, where = pa.nulls(size, pa.int64()), pa.array(np.full(size, i, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([row.take(where), nothing, lang.take(where), k.take(where), *[nothing] * len(_COUNTS), pa.nulls(size, pa.float64()), pa.array(codes[j : j + _ROWS], pa.int64()), pa.array(counts[j : j + _ROWS], pa.int64())], names)

    rows = named.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "k", "text")
    found = written(rows.mapInArrow(score, schema), "scored")
    base = found.where("gram IS NULL").drop("gram", "n")
    if whole:
        return base
    # Texts that repeat have the same n-grams: once for each text, so that no n-gram has the copies of a text as its rows.
    rest = found.where("gram IS NOT NULL").groupBy("lang", "k", "gram").agg(F.max("n").alias("times"))
    more = rest.join(known.select("lang", "gram", "p"), ["lang", "gram"]).groupBy("lang", "k").agg(F.sum(-F.log("p") * F.col("times")).alias("more"))
    return written(base.join(more, ["lang", "k"], "left").withColumn("nll", F.col("nll") + F.coalesce("more", F.lit(0.0))).drop("more"), "scored")


def judged(docs: DataFrame, bands: tuple[float, float] = (LOWER, UPPER), head_rows: int = HEAD) -> DataFrame:
    """Base counts, perplexity and verdict of every document (doc_id, text, lang); see ``quality``.  ``lang`` and ``k`` are as in ``_named``."""
    named = _named(docs)
    counts = written(count_grams(different_texts(named)), "counts")
    known = probabilities(counts)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = scored(named, known, head_rows).withColumn("base_failed", failed).withColumn("log_ppl", F.log(F.try_divide("nll", F.greatest(F.col("n_words") - F.col("n_alone"), F.lit(1)))))
    # Centre and spread of a language: medians over the different texts that pass the rules, so copies count once.
    passed = written(rows.where("NOT base_failed AND nll > 0").groupBy("lang", "k").agg(F.max("log_ppl").alias("log_ppl"), F.max("n_words").alias("n_words")), "passed")
    centre = small(written(passed.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("centre"), F.count("*").alias("texts")), "centre"))
    off = F.col("log_ppl") - F.col("centre")
    spread = passed.join(centre, "lang").groupBy("lang", "centre", "texts").agg(
        F.percentile_approx(F.abs(off), 0.5, 10_000).alias("mad"),
        F.percentile_approx(off * off * F.col("n_words"), 0.5, 10_000).alias("by_length"),
    )
    # Variance of a document of n words: half the spread of all, and what shrinks with length (2.198: median to mean of squares).
    limits = spread.select("lang", "centre", "texts", F.greatest(F.col("mad") * 1.4826 / 2, F.lit(LEAST_SPREAD)).alias("floor"), (F.col("by_length") * 2.198).alias("by_length"))
    sd = F.sqrt(F.try_divide("by_length", "n_words") + F.col("floor") * F.col("floor"))
    width = (1 + F.lit(FEW_TEXTS) / F.col("texts")) * sd
    both = rows.join(small(written(limits, "bands")), "lang", "left")
    low, high = F.exp(F.col("centre") - bands[0] * width), F.exp(F.col("centre") + bands[1] * width)
    ppl = F.exp("log_ppl")
    inside = (ppl >= low) & (ppl <= high)
    return both.select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "lang", ppl.alias("word_nll"), low.alias("lower"), high.alias("upper"), "k")


def quality(docs: DataFrame, bands: tuple[float, float] = (LOWER, UPPER), head_rows: int = HEAD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every document (doc_id, text, lang).

    ``kept``: the rules hold and the log perplexity per word lies within the bands of the
    document's language, which depend on this language's texts alone; every value of
    ``lang`` is a language, and so is null.  A null text is empty and fails the rules.
    Rows that repeat each get a row; an empty table gives an empty result.  Other columns
    are ignored.  Also returns lang, word_nll (log perplexity per word), lower, upper.
    """
    return judged(docs, bands, head_rows).drop("k").withColumn("lang", F.when(F.col("lang") != "-", F.substring("lang", 2, 1 << 30)))


def keep_good(docs: DataFrame, bands: tuple[float, float] = (LOWER, UPPER)) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns as they are.

    The verdict depends on language and text alone.  Only documents that may be rejected move.
    """
    p = prefix(docs)
    lang, k, maybe = f"{p}lang", f"{p}k", f"{p}maybe"
    bad = written(judged(docs, bands).where("NOT kept").select(F.col("lang").alias(lang), F.col("k").alias(k)).distinct(), "bad")
    marked = flagged(docs.withColumn(lang, _language()).withColumn(k, F.xxhash64(text_of())), F.xxhash64(lang, k), bad, F.xxhash64(lang, k), maybe)
    sure = marked.where(~F.col(maybe)).select(*docs.columns)
    return sure.unionByName(marked.where(maybe).join(small(bad), [lang, k], "left_anti").select(*docs.columns))


def op9_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
