"""Sharding, mixing, line dedup and chat formatting on small tables with nulls, ties, repeats and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from lexsift.llm import chat, linededup, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed, n=300, sources=4):
    rng = random.Random(seed)
    words = ["ab", "ça", "d", "é", "ff", "ggg", "日本"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " \t\n", "hot text " * 30, " ".join(rng.choices(words, k=rng.randint(1, 60))), "\n".join(" ".join(rng.choices(words, k=3)) for _ in range(rng.randint(1, 9)))])
        rows.append((rng.choice([i, i, i, None]) if rng.random() < 0.1 else i, text, "en", rng.choice([None, *(f"s{k}" for k in range(sources))]), 0))
    rows.append((5, "x" * 3000, "en", "s0", 0))
    return rows + rows[:7]


def size(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_shards_are_equal_and_gapless(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "MIN_RANGES", ranges)
    rows = documents(1)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS shard", "'x' AS size", "2 AS h")
    got = sharding.shard_documents(df).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(sums.values()) / 16
    assert all(abs(v - mean) <= 3001 for v in sums.values()) and set(sums) <= set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = sharding.shard_documents(df.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_hot_group_is_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MIN_RANGES", 16)
    rows = [(i, "same", "en", "s", 0) for i in range(400)] + [(1000 + i, f"text {i}", "en", "s", 0) for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    counts = Counter(r.shard for r in got)
    assert len(counts) == 16 and max(counts.values()) <= 80


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.shard_documents(none).collect() == []
    assert mixing.plan_mix(none).documents.collect() == []
    assert linededup.dedup_lines(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate_perspectives(turns).collect() == []


def test_write_shards(spark, tmp_path):
    rows = [(i, f"text {i % 7}" * (i % 5 + 1), "en", "s", i) for i in range(60)] + [(1, "text 1", "en", "s", 9), (1, "text 1", "de", "s", 8), (None, None, None, None, 7), (None, None, None, None, 7), (None, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'mine' AS _h", "doc_id AS tie")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.n_chars, r._h) for r in got) == Counter((d, t, la, n, "mine") for d, t, la, _, n in rows)
    assert Counter((r.shard, r.slot) for r in got) == Counter((r.shard, r.slot) for r in sharding.shard_documents(df, 4).collect())


def test_repeated_rows_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MIN_RANGES", 16)
    monkeypatch.setattr(mixing, "REPEATED", 10)
    rows = [(None, None if i % 2 else "same text", "en", "s", 0) for i in range(400)] + [(i, f"text {i} " * (i % 9), "en", f"s{i % 3}", 0) for i in range(100)]
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(df).collect()
    assert len(got) == 500 and max(Counter(r.shard for r in got if r["size"] == 1).values()) < 200
    taken = mixing.plan_mix(df, 6)
    assert taken.documents.count() == 500
    monkeypatch.setattr(mixing, "REPEATED", 1 << 20)
    again = mixing.plan_mix(df, 6)
    key = lambda m: Counter(tuple(r) for r in m.documents.select("doc_id", "size", "source_size", "target", "taken", "shard").collect())
    assert key(taken) == key(again)


def test_long_texts(spark):
    long = "\n".join(f"word{i % 5000} and more of it" for i in range(60_000))
    rows = [(1, long, "en", "s", 0), (2, "short", "en", "s", 0), (3, long + "\nend", "de", "t", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r["size"] for r in sharding.shard_documents(df).collect()) == [6, len(long) + 1, len(long) + 5]
    got = {r.doc_id: r for r in mixing.plan_mix(df).documents.collect()}
    assert got[1]["size"] == 300_000 and got[3].taken <= 2 * got[3]["size"]
    lines = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert lines[3].n_removed == 60_000 and lines[3].text == "end" and lines[1].n_removed == 55_000
    turns = spark.createDataFrame([(1, 1, "a", long), (1, 2, "b", "x")], TURNS)
    assert {r.n_chars for r in chat.rotate_perspectives(turns).collect()} == {len("<|assistant|>\n") + len(long) + 8 + len("<|user:b|>\n") + 9, len("<|assistant|>\n") + 9 + len(long) + 8 + len("<|user:a|>\n")}


def words(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]


def water_fill(sizes, weights, share=1.5, repeats=2):
    """Reshares what goes over a source's limit, by weight, until none is above."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= repeats * sizes[s]:
                left += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix_meets_targets(spark, block):
    rows = documents(2)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS s", "2 AS taken")
    mix = mixing.plan_mix(df, block)
    got = mix.documents.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(words(t))) for d, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    targets = {r.source: r.target for r in mix.sources.collect()}
    assert targets == pytest.approx(want)
    taken = defaultdict(int)
    for r in got:
        taken[r.target, r.source_size] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert {k: v for k, v in taken.items()} == {(targets[s], sizes[s]): int(targets[s] + 0.5) for s in sizes}
    assert Counter(map(tuple, mixing.plan_mix(df.repartition(5), block).documents.collect())) == Counter(map(tuple, got))


def test_slots_map_each_block_once_a_pass(spark):
    mix = mixing.plan_mix(spark.createDataFrame(documents(3), DOCS), 5)
    slots = mix.slots.toPandas()
    assert not slots.duplicated(["s", "pass", "block"]).any() and not slots.duplicated(["s", "j"]).any()
    for _, one in slots[slots["pass"] == 0].groupby("s"):
        assert len(set(one["block"])) == len(one)
    assert slots["out_shard"].between(0, 15).all()


def test_mixed_documents_hold_what_is_taken(spark):
    rows = documents(4)
    df = spark.createDataFrame(rows, DOCS)
    taken = mixing.plan_mix(df, 6).documents.groupBy("doc_id").sum("taken").collect()
    out = mixing.mixed_documents(df, 6).collect()
    sums = defaultdict(int)
    for r in out:
        sums[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {r[0]: r[1] for r in taken if r[1]} == dict(sums)
    texts = {t for _, t, *_ in rows}
    assert any(r.text in texts for r in out)


def brute_lines(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(x.strip(" ") for x in lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d, t] = (None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), 0 if t is None else len(lines), len(gone))
    return out


def test_line_windows_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a\nb", "a\nb\nc", "\n\n\n\n", "\n".join(rng.choices(["a", " b", "b", "c", "d "], k=rng.randint(1, 12)))])) for i in range(150)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "4 AS l", "2 AS n_lines", "5 AS _k", "3 AS extra")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "k", "l", "_k", "extra", "n_lines", "n_removed"]
    assert {(r.k, r.l, r._k, r.extra) for r in got.collect()} == {(1, 4, 5, 3)}
    want = brute_lines(rows)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == Counter((d, *want[d, t]) for d, t in rows)


def test_line_windows_with_null_ids(spark):
    rows = [(None, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (None, "q\na\nb\nc")]
    got = sorted(r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 3 and "x" in got and sum("a\nb\nc" in t for t in got) == 1


TURNS = "conv_id long, turn long, role string, text string"


def brute_dialogue(turns, me):
    at, out, spans = 0, [], []
    for _, role, text in turns:
        head = "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user:{role}|>\n"
        body = f"{text}<|end|>"
        if role == me:
            spans.append(f"{at + len(head)}-{at + len(head) + len(body)}")
        at += len(head) + len(body) + 1
        out.append(head + body + "\n")
    return "".join(out), ",".join(spans)


@pytest.mark.parametrize("part", [1, 7, 1024])
def test_whole_dialogues(spark, part):
    rng = random.Random(3)
    rows = [(1, rng.choice([None, -5, *range(3000)]), rng.choice(["ann", "bob", "system", "eve"]), rng.choice(["é", "yes", "\n", "x" * 50])) for _ in range(3000)]
    rows += [(None, i, rng.choice(["ann", None]), None) for i in range(20)] + [(2, 0, "system", "only")]
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS part", "'q' AS perspective", "2 AS parts"), part).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "eve"), (None, "ann"), (None, "unknown")}
    for (conv, me), r in got.items():
        own = sorted(((t, role or "unknown", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        text, mask = brute_dialogue(own, me)
        assert (r.text, r.mask, r.n_turns, r.n_own) == (text, mask, len(own), mask.count(",") + 1)
        assert r.n_chars == len(text) and r.loss_chars == sum(int(z) - int(a) for a, z in (s.split("-") for s in mask.split(",")))


def test_blocks_of_the_mix(spark):
    rows = documents(12)
    df = spark.createDataFrame(rows, DOCS)
    mix, blocks = mixing.plan_mix(df, 6, 4), mixing.mixed_blocks(df, 6, 4).collect()
    slots = mix.slots.collect()
    assert Counter((r.out_shard, r.j) for r in slots) == Counter((b.out_shard, b.j) for b in blocks) and all(len(words(b.text)) == b.words <= 6 for b in blocks)
    assert sum(r.taken for r in mix.documents.collect()) == sum(b.words for b in blocks)
    # A source's slots lie shard by shard.
    for s in {r.s for r in slots}:
        own = [r.out_shard for r in sorted((r for r in slots if r.s == s), key=lambda r: r.j)]
        assert own == sorted(own)
    text = {w for _, t, *_ in rows for w in words(t)}
    assert all(w in text for b in blocks for w in words(b.text))
