"""Token counts, near-duplicates, encoding, extraction, quality, audio and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm import labelled_pages  # noqa: E402

from lexsift.llm import audio, graph, htmlblocks, htmlcrf, neardup, neartext, pieces, quality, tokens  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", "  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "  x  \n\n y z  ", "don't I'll 12345 ½", "日本語 テキスト\U0001f600", "a\0b", "▁x ▁▁y", "ﬁ é", "<s>hi</s><0x41>", "w " * 2000, "x" * 5000, " " * 300, None, "a\r\nb\x0b\x0c\x1c\x85c", "�"]


def odd_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (None, "no id"), (1, "same id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS n", "'x' AS piece")


@pytest.mark.parametrize("head", [0, 3, 10_000])
def test_token_counts_equal_the_library(spark, head):
    from tokenizers import Tokenizer

    rows, df = odd_documents(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = Counter((d, len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (d, t), e in zip(rows, found))
    assert Counter(map(tuple, tokens.token_counts(df, path, head_rows=head).collect())) == want
    assert tokens.token_counts(df.limit(0), path).collect() == []


def test_head_is_drawn_from_all_partitions(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id div 1000, ' only', id) AS text").repartitionByRange(40, "doc_id")
    head = tokens.frequent_strings(df, str.split, rows=4, sample=400).collect()
    assert sorted(r.piece for r in head) == [f"word{i}" for i in range(4)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.token_counts(df, path, head_rows=4).count() == 4000


def test_texts_of_equal_checksum_are_told_apart(spark):
    import zlib

    from tokenizers import Tokenizer

    rng, seen = random.Random(5), {}
    while True:
        text = " ".join(str(rng.random()) for _ in range(rng.randint(1, 3)))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text and len(other) != len(text):
            break
    rows = [(7, text), (7, other), (None, text), (None, other), (7, text)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = Counter((d, len(t), len(tokenizer.encode(t).ids), False) for d, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, tokens.token_counts(df, path, head_rows=0).collect())) == want


def test_long_strings_are_no_keys(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "=" * (300 + i % 2) + " a" + "é" * 200) for i in range(20)]
    counted = tokens.counted_strings(spark.createDataFrame(rows, "doc_id long, text string"), tokens.Pretokenizer(path).splitter()).collect()
    assert all(len(r.piece.encode()) <= tokens.KEY_BYTES for r in counted)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.Pretokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("head", [0, 3, 10_000])
def test_pieces_equal_the_library(spark, head, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "BLOCK_CHARS", 300)
    rows, df = odd_documents(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for d, t in rows:
        ids = sp.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), tuple(ids)] += 1
    got = pieces.encode_decode(df, path, head_rows=head, with_ids=True).collect()
    assert Counter((*r[:4], tuple(r.ids)) for r in got) == want
    assert pieces.encode_decode(df.limit(0), path).collect() == []


def test_blocks_have_the_same_names_in_any_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "BLOCK_CHARS", 40)
    rng = random.Random(22)
    rows = [(rng.choice([None, i]), rng.choice([None, "", "x" * rng.randint(1, 90)])) for i in range(60)]
    batches = lambda n: iter([pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows[i : i + n]], pa.int64()), pa.array([t for _, t in rows[i : i + n]], pa.string())], ["doc_id", "text"]) for i in range(0, len(rows), n)])
    one = list(pieces._blocks(batches(1)))
    assert one == list(pieces._blocks(batches(7))) == list(pieces._blocks(batches(60))) and len({b for b, *_ in one}) > 5
    assert [(d, t or "") for d, t in rows] == [x for _, ids, texts in one for x in zip(ids, texts)]


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {key: int}; smallest key reachable by links of 2 or fewer bits."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        base = rng.choices("ab cd ef gh ij kl mn op qr Zé".split(), k=rng.randint(0, 40))
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            if text and rng.random() < 0.5:
                text[rng.randrange(len(text))] = "zz"
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else "\t".join(text))
    rows += [None, "", "   "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("paired", [2, 64])
def test_simhash_components(spark, monkeypatch, paired):
    monkeypatch.setattr(neardup.links, "__defaults__", (2, 9, paired))
    rows = near_copies(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS k")
    got = neardup.simhash_components(df).collect()
    prints = {d: brute_fingerprint(t) for d, t in rows}
    roots = brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{prints[d]:016x}", roots[d]) for d, _ in rows}
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


@pytest.mark.parametrize("paired", [1, 3, 1000])
def test_links_lose_none(spark, paired):
    rng = random.Random(paired)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            values.add(x)
    values |= {0, (1 << 64) - 1, 1, 3, 7}
    prints = {v: v for v in values}
    want = defaultdict(set)
    for k, r in brute_components(prints).items():
        want[r].add(k)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in graph.components(neardup.links(df, paired=paired)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[found.get(signed(v), signed(v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_with_null_ids_and_repeats(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only nulls here"), (None, "only nulls here"), (8, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(df).collect()) == [(0, "only nulls here"), (7, "a b c d"), (8, "x y z w")]
    assert neardup.simhash_components(df).count() == len(rows)
    assert neardup.simhash_components(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert {k: v for k, v in got.items() if k <= 60} == {i: 0 for i in range(1, 61)} and got[101] == 100


def test_field_on_held_out_pages():
    field, rng, right, total = htmlcrf.trained_field(), random.Random(4321), 0, 0
    for _ in range(150):
        page, labels = htmlcrf.labelled_page(rng)
        found = field.decode(htmlcrf.page_features(htmlblocks.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.98


@pytest.mark.parametrize("n", range(len(labelled_pages.PAGES)))
def test_field_on_pages_labelled_by_hand(n):
    page, want = labelled_pages.PAGES[n]
    got = htmlcrf.main_text(htmlcrf.trained_field(), page).split("\n")
    right = len(set(got) & set(want))
    assert right / len(want) >= 0.9 and right / len(got) >= 0.9


def test_names_around_an_article_do_not_lose_it():
    field = htmlcrf.trained_field()
    body = "<h1>On rain</h1><p>It rained for a week, and then it stopped.</p><p>Nobody was there to see it's end.</p>"
    want = "On rain\nIt rained for a week, and then it stopped.\nNobody was there to see it's end."
    for open_, close in [
        ("<body class='page newsletter-enabled sidebar'><article>", "</article></body>"), ("<article class='post sidebar-left has-comments'>", "</article>"), ("<form class=search><article>", "</article></form>"),
        ("<body><p hidden></p><article data-x=a'b>", "</article>"), ('<div class="comments footer"><div id=menu><article>', "</article></div></div>"),
    ]:
        assert htmlcrf.main_text(field, open_ + body + close) == want
    assert htmlcrf.main_text(field, "<article><h1>Energy</h1><p>It is <math>E=mc</math> in this text.</p></article>") == "Energy\nIt is E=mc in this text."


def test_markup_as_browsers_read_it():
    for page, want in [
        ("<p class=it's>a<p>b's<p>c", ["a", "b's", "c"]), ("<p title='x>y' a=\"'>\">q", ["q"]), ("<!--> <p>x<!-- <p>n --!> y", ["x y"]), ("</ ><p/class=a>z</>", ["z"]), ("a < b <3 c", ["a < b <3 c"]),
        ("<p a='b>c", []), ("<script>'<p>'</script ><p>x</p><textarea><p>no</textarea>", ["x"]), ("<p>a<svg><text>b</text></svg>c", ["abc"]), ("<p =a'b>x", ["x"]), ("<p a = 'b' c>x", ["x"]),
    ]:
        assert [b.text for b in htmlblocks.leaf_blocks(page)] == want, page


def test_long_and_deep_pages():
    field = htmlcrf.trained_field()
    deep = "<div>" * 3000 + "<p>text" + "</div>" * 10
    assert len(htmlblocks.leaf_blocks("<div>a" * 50_000)) == 50_000
    assert htmlblocks.leaf_blocks(deep)[0].text == "text" and isinstance(htmlcrf.main_text(field, deep), str)
    long = "<article><h1>Title</h1>" + "<p>One more paragraph, of some words.</p>" * 20_000 + "<p>" + "word " * 200_000 + "</article>"
    assert htmlcrf.main_text(field, long).count("\n") == 20_001
    assert htmlblocks.leaf_blocks("<p a='" + "x" * 300_000 + "<a " * 50_000) == []


def test_viterbi_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(3)
    field = htmlcrf.Field(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    rows = [[0], [1, 2], [3], [0, 3], [2]]
    score = lambda y: sum(field.unary[r, a].sum() for r, a in zip(rows, y)) + sum(field.pair[a, b] for a, b in zip(y, y[1:])) + field.ends[0, y[0]] + field.ends[1, y[-1]]
    assert field.decode(rows) == list(max(product((0, 1), repeat=5), key=score))
    assert field.decode([]) == []


PAGE = """<!DOCTYPE html><html><head><title>One &amp; two</title><script>var a = "</p>";</script></head><body>
<header class="masthead"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all.</div>
<article><h1>One &amp; two</h1><p>First&nbsp;paragraph
   of   text, with <b>bold</b> words.<br><p>Second &lt;one&gt;, not closed
<div class="ad">Buy now</div><p>Third paragraph is longer than the others, and ends here.</p>
<section class="comments"><h3>Comments</h3><p>Nice post, I like it.</p></section></article>
<aside><p>Read more of this</p></aside><form><label>Your name</label><input></form><footer>&copy; Site</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "no markup at all"), (5, "u", "<p>cut <b"), (None, "u", PAGE), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = htmlcrf.extract_main_text(df).collect()
    assert len(got) == len(rows)
    want = "One & two\nFirst paragraph of text, with bold words.\nSecond <one>, not closed\nThird paragraph is longer than the others, and ends here."
    assert [r.text for r in got if r.page_id in (1, None)] == [want] * 3
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert htmlcrf.extract_main_text(df.limit(0)).collect() == []


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", " ", " ", "\n", "#", "é", "|", "\x0b", "\xa0", "ab ", "c d "], k=rng.randint(0, 120)))
        assert quality.base_counts(text)[:5] == brute_base(text)
        assert quality.base_counts(text)[5] == sum(w in ("#", "|") for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    assert quality.base_counts("w " * 9)[4] == 9 and quality.base_counts("w " * 8)[4] == 0
    assert quality.base_counts(None) == (0, 0, 0, 0, 0, 0)


def brute_kneser_ney(texts):
    """The probability of a character after the three before it, from dictionaries."""
    top = Counter(t[i : i + 4] for t in ("\0\0\0" + x for x in texts) for i in range(len(t) - 3))
    tables = {4: top}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    found = {}

    def prob(gram):
        n = len(gram)
        if n == 0:
            return 1 / len(tables[1])
        if gram in found:
            return found[gram]
        t = tables[n]
        n1, n2, n3, n4 = (max(1, sum(c == i for c in t.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])
        mass = lambda c: 0 if c == 1 and n > 2 else max(0, c - d[min(c, 3)])
        same = [c for g, c in t.items() if g[:-1] == gram[:-1]]
        found[gram] = mass(t[gram]) / sum(same) + (1 - sum(map(mass, same)) / sum(same)) * prob(gram[1:])
        return found[gram]

    return top, prob


@pytest.mark.parametrize("head", [0, 20, 1 << 20])
def test_perplexity_against_dictionaries(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "_AT_ONCE", 50)  # texts in stretches
    monkeypatch.setattr(quality, "_KEEP", 30)
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcé \U0001f600漢", [9, 9, 5, 2, 9, 1, 1], k=rng.randint(1, 150))) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, texts[3], "en"), (101, texts[3], "en"), (102, None, "en"), (103, "", "en"), (104, texts[0], None), (105, texts[1], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = quality._named(df)
    counts = quality.written(quality.count_grams(quality.different_texts(named)), "counts")
    got = {r.doc_id: r.nll for r in quality.scored(named, quality.probabilities(counts), head).collect()}
    for group in (texts, [texts[0]], [texts[1]]):
        top, prob = brute_kneser_ney(group)
        for i, t, lang in rows:
            if t in group and (lang == "en") == (len(group) > 1) and (lang != "" or t == texts[1]):
                padded = "\0\0\0" + t
                want = -sum(np.log(prob(padded[k : k + 4])) for k in range(len(t)))
                assert got[i] == pytest.approx(want, rel=1e-4)
    assert got[102] == got[103] == 0


def prose(rng, low=60, high=200):
    syllables = "an en in on er re le la de ti".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high)))


def test_bands_keep_clean_documents(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%###$$$" for w in prose(rng).split()), "en", "s", 0) for i in range(5)]
    rows += [(2000, "too short", "en", "s", 0), (2001, "w " * 90, "en", "s", 0), (2002, None, None, None, None), (2003, prose(rng), None, "s", 0), (2003, prose(rng), "xx", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS kept", "2 AS k")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert sum(got[i].kept for i in range(300)) >= 299
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(5))
    assert all(got[i].base_failed and not got[i].kept for i in (2000, 2001, 2002))
    assert quality.quality(df.limit(0)).collect() == []
    assert quality.keep_good(df).columns == df.columns


def test_copies_leave_the_bands_as_they_are(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng), "en", "s", 0) for i in range(150)] + [(i, prose(rng), "fr", "s", 0) for i in range(1000, 1150)]
    copies = [(2000 + i, rows[7][1], "en", "s", 0) for i in range(400)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows + copies, DOCS)).collect()}
    assert sum(got[i].kept for i in range(150)) >= 148 and sum(got[i].kept for i in range(1000, 1150)) >= 148
    assert all(got[7].lower < got[7].word_nll < got[7].upper and got[2000 + i].kept for i in range(400))


def test_other_languages_change_no_verdict(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng), "en" if i < 60 else None, "s", 0) for i in range(90)] + [(90, "x " * 40 + "Y%%" * 90, "en", "s", 0)]
    others = [(1000 + i, prose(rng) + "é" * i, ["*", "", "+", "-", f"l{i}"][i % 5], "s", 0) for i in range(100)]
    few = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    many = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows + others, DOCS)).collect()}
    for i in few:
        assert few[i].kept == many[i].kept and few[i].lang == many[i].lang and few[i].word_nll == pytest.approx(many[i].word_nll)
    assert {many[i].lang for i in many} == {"en", None, "*", "", "+", "-"} | {f"l{i}" for i in range(4, 100, 5)}


def test_keep_good_leaves_columns_alone(spark):
    rng = random.Random(19)
    rows = [(i, prose(rng) if i % 5 else "short", "en", "s", i) for i in range(50)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id AS k", "'mine' AS judged_text", "1 AS kept")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(50) if i % 5]
    assert {r.judged_text for r in kept.collect()} == {"mine"} and all(r.k == r.doc_id for r in kept.collect())
    clash = quality.keep_good(df.withColumn("_K", quality.F.lit(1)).withColumn("__maybe", quality.F.lit(2)))
    assert {(r["_K"], r["__maybe"]) for r in clash.collect()} == {(1, 2)} and clash.count() == kept.count()


def test_shifted_and_noisy_audio_aligns(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(0, 0.15, 64).tolist() for _ in range(4)]
    sounds = [audio.melody(v) for v in vectors]
    late = np.concatenate([np.zeros(5 * audio.HOP), sounds[0]]) + rng.normal(0, 0.03, len(sounds[0]) + 5 * audio.HOP)
    listened = [*sounds, late, np.zeros(0), np.zeros(40_000), sounds[1]]
    ids = [100, 1, 2, 3, 4, 5, 6, None]
    rows = [(i, audio.fingerprint(s).view(np.int32).tolist()) for i, s in zip(ids, listened)]
    got = audio.search(spark.createDataFrame(rows, "rec_id long, codes array<int>")).collect()
    members = {r.rec_id: r.class_id for r in got if r.kind == "member"}
    assert members == {100: 100, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, None: 1}
    (match,) = [r for r in got if r.kind == "match"]
    assert (match.class_id, match.other_id, match.offset) == (100, 4, -5) and match.bit_error < 0.1


def best_alignment(a, b):
    """Least share of wrong bits over all offsets with enough overlap."""
    best = 1.0
    for off in range(-len(b) + audio.MIN_OVERLAP, len(a) - audio.MIN_OVERLAP + 1):
        x, y = a[max(off, 0) :], b[max(-off, 0) :]
        n = min(len(x), len(y))
        if n >= audio.MIN_OVERLAP:
            best = min(best, np.bitwise_count(x[:n] ^ y[:n]).mean() / 32)
    return best


def test_recall_against_all_alignments(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(0, 0.15, 64) for _ in range(18)]
    sounds = [audio.melody(b.tolist()) for b in base]
    for b in base[:10]:
        for noise, shift, change in ((0.02, 0, 0), (0.1, 3, 0), (0.3, 7, 0), (0.05, 2, 0.01), (0.05, 11, 0.03), (0.6, 4, 0)):
            s = audio.melody((b + rng.normal(0, change, 64)).tolist())
            s = np.concatenate([rng.normal(0, 0.01, shift * audio.HOP + int(rng.integers(0, audio.HOP // 4))), s])
            sounds.append(s + rng.normal(0, noise, len(s)))
    prints = list({p.tobytes(): p for p in map(audio.fingerprint, sounds)}.values())  # equal ones are one class
    want = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i != j and best_alignment(a, b) <= audio.MAX_ERROR}
    rows = [(i, p.view(np.int32).tolist()) for i, p in enumerate(prints)]
    got = {(r.class_id, r.other_id) for r in audio.search(spark.createDataFrame(rows, "rec_id long, codes array<int>"), step=1).where("kind = 'match'").collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)


def test_silence_and_held_tones_meet_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(audio, "HOT_ROWS", 50)
    rng = np.random.default_rng(6)
    quiet = np.zeros(60 * audio.RATE)
    tone = np.sin(2 * np.pi * 440 * np.arange(30 * audio.RATE) / audio.RATE)
    tunes = [audio.melody(rng.normal(0, 0.15, 64).tolist()) for _ in range(6)]
    sounds = [np.concatenate([quiet, t, tone]) + 0 for t in tunes] + [np.concatenate([quiet[: 20 * audio.HOP], tunes[0]]), quiet, quiet[: 30 * audio.RATE]]
    rows = [(i, i, audio.fingerprint(s).view(np.int32).tolist()) for i, s in enumerate(sounds)]
    assert sum(c == audio.SILENT for _, _, codes in rows for c in codes) > 2500
    prints = spark.createDataFrame(rows, "rec_id long, class_id long, codes array<int>")
    frames = sum(len(c) for *_, c in rows)
    assert audio.meetings(prints, prints).count() < 25 * frames  # frame by frame, silence and tones alone would make over a thousand a frame
    got = {(r.class_id, r.other_id) for r in audio.search(prints.drop("class_id"), step=1).where("kind = 'match'").collect()}
    assert (0, 6) in got and (6, 0) in got and not any(7 in x or 8 in x for x in got)


def test_long_recordings(spark):
    rng = np.random.default_rng(7)
    s = audio.melody(rng.normal(0, 0.15, 6000).tolist())
    codes = audio.fingerprint(s).view(np.int32).tolist()
    part = audio.fingerprint(s[200 * audio.HOP : 400 * audio.HOP]).view(np.int32).tolist()
    df = spark.createDataFrame([(0, codes), (1, part)], "rec_id long, codes array<int>")
    (match,) = audio.search(df).where("kind = 'match'").collect()
    assert len(codes) > 5000 and (match.class_id, match.other_id, match.offset) == (0, 1, 200)


def test_verdicts_leave_columns_alone(spark):
    rng = random.Random(21)
    texts = [prose(rng, 20, 30) for _ in range(9)]
    rows = [(i % 7 if i % 5 else None, texts[i % 9], "en", "s", i) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'mine' AS keep_text", "n_chars AS k", "1 AS _k", "2 AS kept", "3 AS maybe")
    for kept in (neardup.keep_one(df), neartext.keep_one(df)):
        assert kept.columns == df.columns
        got = kept.collect()
        assert {(r.keep_text, r._k, r.kept, r.maybe) for r in got} == {("mine", 1, 2, 3)} and all((r.doc_id, r.text, r.k) in {(d, t, n) for d, t, _, _, n in rows} for r in got)
        assert len(got) == len({t for _, t, *_ in rows})


def test_chroma_finds_the_pitch_class():
    t = np.arange(audio.RATE * 2) / audio.RATE
    assert (audio.chroma(np.sin(2 * np.pi * 440 * t)).argmax(axis=1) == 0).all()
    assert (audio.chroma(np.sin(2 * np.pi * 523.25 * t)).argmax(axis=1) == 3).all()
    assert len(audio.fingerprint(np.sin(t)[:100])) == 0
    assert np.array_equal(audio.pcm16(b"\x00\x40\x00\xc0\x01"), [0.5, -0.5]) and len(audio.pcm16(None)) == 0


def test_search_of_vectors(spark):
    df = spark.createDataFrame([(0, [0.1] * 64, 1), (1, [0.1] * 64, 1), (2, None, 1), (3, [], 1), (4, [float("nan")] * 70, 1)], "vec_id long, embedding array<double>, label int")
    got = audio.search(audio.fingerprints(df, "vec_id", "embedding", audio.melody))
    assert {r.rec_id: r.class_id for r in got.where("kind = 'member'").collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert audio.search(audio.fingerprints(df.limit(0), "vec_id", "embedding", audio.melody)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.test_native_ops import brute_lines, words

    rng = random.Random(11)
    rows = [(i, "\n".join(prose(rng, 10, 30) for _ in range(5)), "en", f"s{i % 3}", 0) for i in range(120)]
    passage = "\n".join(prose(rng, 20, 30) for _ in range(3))
    rows += [(200 + i, f"{prose(rng)}\n{passage}\n{prose(rng)}", "en", "s1", 0) for i in range(4)]
    rows += [(300, rows[5][1], "en", "s0", 0), (301, rows[6][1].replace("\n", "\n\n"), "en", "s0", 0), (302, "short", "en", "s0", 0), (303, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.selectExpr("*", "1 AS extra").write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == corpus_pipeline.COLUMNS and 302 not in kept and 303 not in kept and len(kept) >= 120
    lines = stages["line_dedup"](spark, good, str(tmp_path))
    want = {d: t for (d, _), (t, *_) in brute_lines([(r.doc_id, r.text) for r in good.collect()]).items() if t}
    assert {r.doc_id: r.text for r in lines.collect()} == want and 300 not in want
    assert sum(passage in t for t in want.values()) == 1
    near = stages["near_dedup"](spark, lines, str(tmp_path))
    left = {d: t for d, t in want.items()}
    roots = brute_components({d: brute_fingerprint(t) for d, t in left.items()})
    assert {r.doc_id for r in near.collect()} == set(roots.values()) and 301 not in set(roots.values())
    mixed = stages["mix_sources"](spark, near, str(tmp_path)).collect()
    size = sum(len(words(left[d])) for d in set(roots.values()))
    assert abs(sum(len(words(r.text)) for r in mixed) - 1.5 * size) <= 3
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, r.n_tokens) for r in run) == Counter((r.doc_id, len(sp.encode(r.text))) for r in mixed)


def test_near_dedup_equals_brute_force_jaccard(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    notice = " ".join(rng.choices(vocabulary, k=30))
    texts = [None, "", " \t", "a b", "A  b", "a c"]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 60, 120, 400]))
        for _ in range(rng.choice([1, 2, 4])):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = "zz"
            texts.append(" ".join(text) + rng.choice(["", "", "\n" + notice]))
    hot = rng.choices(vocabulary, k=100)
    texts += [" ".join(hot[:i] + ["yy"] + hot[i:]) for i in range(0, 100, 3)]
    rng.shuffle(texts)

    def grams(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {""}

    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert sum(sets[i] != sets[j] for i, j in pairs) > 100
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for limit in (1 << 18, 5):
        monkeypatch.setattr("lexsift.llm.neartext.FREQUENT", limit)
        kept = corpus_pipeline.near_dedup(spark, df, "")
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def brute_near(texts):
    """For each text the smallest index of the texts that links of a five-word Jaccard similarity of 0.8 reach from it."""
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, text, edits, kinds="rid"):
    text = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.choice(kinds)
        text[at : at + (kind != "i")] = [] if kind == "d" else [f"x{rng.randrange(12)}"]
    return text


@pytest.mark.parametrize("crowd", [1, 16])
def test_near_dedup_of_crowds_loses_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(neartext, "CROWD", crowd)
    rng = random.Random(crowd)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 90, 150]))]
        for edits in range(12):
            other = edited(rng, base, edits)
            texts += [" ".join(edited(rng, other, rng.randint(0, 3), kinds)) for kinds in ("rid", "r", "d", "i", "id")]
            texts.append(" ".join(other + ["a", "notice", "that", "many", "texts", "have", "at", "their", "end"]))
    rng.shuffle(texts)
    want = brute_near(texts)
    assert len(texts) / 8 < len(set(want)) < len(texts) * 3 / 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in neartext.keep_one(df).collect()) == sorted(set(want))


def test_near_dedup_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base), *(" ".join(f"y{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(base)) for n in (1, 4) for at in (set(rng.sample(range(150), n)) for _ in range(150)))]
    pairs, written = [], neartext.written
    monkeypatch.setattr(neartext, "written", lambda df, label: (made := written(df, label), label == "across" and pairs.append(made.count()))[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in neartext.keep_one(df).collect()) == sorted(set(brute_near(texts)))
    assert len(pairs) == 1 and pairs[0] < 4 * len(texts)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
