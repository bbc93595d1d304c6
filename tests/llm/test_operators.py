"""The training-data operators against plain Python, on the smallest tables and on rows that are hard to handle."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import chat, neardup, packing, personal, quality, queries, sentencepieces, tiff, tokencounts, urls, webtext
from tests.llm import brute

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Nulls, empty and very long texts, repeated rows, control strings; the other columns clash with names used inside.
HARD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n\x0b\r", "en", None),
    (4, "word", "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog " * 3000, "en", "b"),
    (6, "same text in two rows, a@b.co and 1.2.3.4", "de", "b"),
    (6, "same text in two rows, a@b.co and 1.2.3.4", "de", "b"),
    (None, "a text without an id", "fr", "c"),
    (8, "Ünï çødé ▁ marks 　 \U0001f600 <|endoftext|> \x00 zero </s> <0x41> ﬁ", "fr", "c"),
    (9, "x" * 40_000, "fr", "c"),
    (10, "1 2 3 4 5 6 7 8 9 " * 3000, "es", "d"),
    (11, "a.b.c." * 5000 + "@" + "d." * 3000, "es", "d"),
    (12, "one two three four five six seven eight nine ten eleven", "en", "e"),
    (13, "ONE two three four five six seven eight nine ten eleven", "en", "e"),
]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id bigint, text string, lang string, source string")
    clash = ("n", "key", "band", "bands", "rep", "sketch", "component", "words", "whole", "base", "spans", "copy", "ids", "task", "queue", "start", "stratum", "trimmed", "n_words", "kept", "print", "_id", "_key")
    return df.select("*", F.char_length("text").alias("n_chars"), *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def empty(df):
    return df.limit(0)


# shared tables


def test_scratch_tables_go_with_their_block(spark):
    from pathlib import Path

    from ledgerloom.llm import common

    rows = spark.range(5)
    with common.scratch(spark) as folder:
        inside = common.materialise(rows, "inside")
        outside = common.materialise(inside, "outside", common.shared_dir(spark))
        assert len(list(Path(folder).iterdir())) == 1
    assert not Path(folder).exists() and outside.count() == 5 and spark.conf.get(common.SCRATCH, None) is None


def test_arrow_sizes_of_a_session_stay(spark):
    from ledgerloom.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "77")
    common.for_workers(spark)
    assert spark.conf.get(name) == "77"
    spark.conf.set(name, before)


# 1 token counts


def encoder():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def edited(text):
    n = len(text)
    for start, removed, inserted in ((n // 3, 4, " edited"), (n * 2 // 3, 0, "\n\n"), (0, 0, "Note: ")):
        start = min(start, len(text))
        text = text[:start] + inserted + text[start + removed :]
    return text


def test_token_counts_of_the_query(spark, small, documents):
    t = encoder()
    out = rows_of(queries.op1_token_counts(spark, small), "doc_id", "n_tokens", "edited_tokens", "n_encoded")
    assert {r[:3] for r in out} == {(i, len(t.encode(x).ids), len(t.encode(edited(x)).ids)) for i, x in documents.items()}
    assert sum(r[3] for r in out) < sum(r[1] for r in out) / 2


def test_token_counts_after_random_edits():
    from ledgerloom.llm.bytepairs import byte_pairs

    t, rng = encoder(), random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "'ll", "'s", "word", "Über", "1234", "...", "\t", "　", "日本", "é", " a", "<|endoftext|>"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        one = tokencounts.CountedText(byte_pairs(BPE), text)
        for _ in range(6):
            start, removed = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 40, 1000])
            inserted = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 200])))
            at = min(start, len(text))
            text = text[:at] + inserted + text[at + removed :]
            one.edit(start, removed, inserted)
            assert one.text == text and one.tokens == len(t.encode(text, add_special_tokens=False).ids)


def test_token_counts_go_on_from_stored_trees(spark, hard):
    trees = tokencounts.counted(hard, BPE)
    edits = spark.createDataFrame([(4, 2, 0, 0, "pre "), (4, 1, 4, 0, " post"), (99, 1, 0, 0, "none")], "doc_id bigint, seq int, start int, removed int, inserted string")
    out = {r["doc_id"]: r for r in tokencounts.recounted(tokencounts.with_edits(trees, edits), BPE).collect()}
    assert out[4]["text"] == "pre word post" and out[4]["edited_tokens"] == len(encoder().encode("pre word post").ids)
    assert out[1]["edited_tokens"] == 0 and 99 not in out
    assert tokencounts.recounted(tokencounts.sample_edits(tokencounts.counted(empty(hard), BPE)), BPE).count() == 0


# 2 sentencepiece


def piece_rows(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in texts:
        ids = model.encode(t or "")
        yield len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_pieces_are_the_library_s(spark, small, documents, hard):
    out = {r[0]: r[1:] for r in rows_of(queries.op2_sentencepiece(spark, small), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
    assert out == dict(zip(documents, piece_rows(documents.values()), strict=True))
    ours = ordered(rows_of(sentencepieces.encode(hard, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert ours == ordered([(r[0], *x) for r, x in zip(HARD, piece_rows([r[1] for r in HARD]), strict=True)])
    assert sentencepieces.encode(empty(hard), PIECES).count() == 0


def test_pieces_of_random_texts():
    rng = random.Random(9)
    alphabet = ["a", "b", "aa", "the", " ", "  ", "▁", "é", "日", "\n", "\t", "0", "<s>", " ", "🙂", "ing", "\x7f"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(300)] + ["a" * 5000, "ab" * 700, " " * 900]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(6000)), "thequickbrownfoxjumpsoverthelazydog" * 90, "日本語の文章には空白がない" * 200]
    codec = sentencepieces.codec(PIECES)
    assert list(codec.digest(texts)) == list(piece_rows(texts))


def test_ids_for_training(spark, hard):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(((r["doc_id"], r["ids"]) for r in sentencepieces.token_ids(hard, PIECES).collect()), key=repr)
    assert got == sorted(((r[0], model.encode(r[1] or "")) for r in HARD), key=repr)


def test_pieces_of_long_words(monkeypatch):
    """Words beyond the cache's and a group's size: they go through the rounds in parts, and the cache stays small."""
    monkeypatch.setattr(sentencepieces, "CHUNK", 300)
    monkeypatch.setattr(sentencepieces, "CACHE_BYTES", 20_000)
    rng = random.Random(3)
    parts = ["a", "b", "aa", "the", " ", "▁", "é", "日", "本", "0", "🙂", "ing", "東京"]
    codec = sentencepieces.PieceCodec(PIECES)
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 5, 100, 900]))) for _ in range(5)] + ["日本語の文章には空白がない" * 100, "a" * 2000, "thequickbrownfox" * 80]
        assert list(codec.digest(texts)) == list(piece_rows(texts))
        assert max(map(len, codec.words), default=0) <= sentencepieces.LONG and codec.held < 120_000


# 3 packing


def test_packing(spark, small, documents):
    t = Tokenizer.from_file(BPE)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in documents.items()}
    rows = rows_of(queries.op3_packing(spark, small), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    tokens, sequences = brute.packed(rows, ids)
    assert sequences <= tokens / 1024 + 4


def test_every_window_has_the_target_shares(spark):
    data = [(k, "word " * (20 + k % 300), "ab"[k % 3 == 0]) for k in range(600)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    out = packing.pack(docs, BPE, {"a": 0.3, "b": 0.7}).join(docs.select("doc_id", "source"), "doc_id")
    shares = out.groupBy("sequence_id").agg(F.sum(F.when(F.col("source") == "b", F.col("length")).otherwise(0)).alias("b"), F.sum("length").alias("n")).orderBy("sequence_id").collect()
    both = [r for r in shares if 0 < r["b"] < r["n"]]
    assert both and all(abs(r["b"] / 1024 - 0.7) < 0.01 for r in both[:-2])


def test_windows_beyond_64_bits():
    """Places in the 2^34th window and on: products there don't fit 64 bits."""
    totals = [(1 << 44) + 12345, (1 << 43) + 7, 999]
    segments = packing.plan(totals, [n / sum(totals) for n in totals])
    s = segments[0]
    for t in (1 << 33, (1 << 34) - 1, s.count):
        for queue, share in enumerate(s.shares):
            assert int(s.upto(np.array([t]), queue, 1024)[0]) == t * share * 1024 >> 30
    for queue, n in enumerate(totals):
        start = max(n - 5000, 0)
        begins, windows, offsets = packing.place(segments, queue, start, n - start)
        lengths = np.diff(np.append(begins, n - start))
        assert (lengths > 0).all() and (np.diff(windows) > 0).all() and (offsets + lengths <= 1024).all()


def test_packing_of_many_small_sources(spark):
    docs = spark.createDataFrame([(k, "some words " * (k % 5), f"host{k}") for k in range(1500)] + [(9000 + k, "word " * 900, "large") for k in range(4)], "doc_id bigint, text string, source string").repartition(6)
    t = Tokenizer.from_file(BPE)
    ids = {r[0]: np.array(t.encode(r[1], add_special_tokens=False).ids + [0]) for r in docs.select("doc_id", "text").collect()}
    tokens, sequences = brute.packed(rows_of(packing.pack(docs, BPE), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), ids)
    assert sequences <= tokens / 1024 + 4


def test_small_sources_take_turns(spark):
    """Sources under a token a window share a queue, of which any stretch holds them by their shares."""
    data = [(k, "large words here " * 2500, "large") for k in range(30)] + [(1000 + k, "some small words " * (3 + k % 5), f"host{k % 20}") for k in range(200)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(5)
    out = packing.pack(docs, BPE).join(docs.select("doc_id", "source"), "doc_id").filter("source != 'large'").orderBy("sequence_id", "offset").select("source", "length").collect()
    totals: dict = {}
    for source, n in out:
        totals[source] = totals.get(source, 0) + n
    everything, upto, seen = sum(totals.values()), 0, dict.fromkeys(totals, 0)
    assert len(totals) == 20
    for source, n in out:
        upto, seen[source] = upto + n, seen[source] + n
        assert all(abs(seen[s] - totals[s] * upto / everything) <= 60 for s in totals)  # about two documents


def test_tempered_shares(spark):
    docs = spark.createDataFrame([(k, "word " * 300, "a" if k % 9 else "b") for k in range(270)], "doc_id bigint, text string, source string")
    out = packing.pack(docs, BPE, temper=0.5).join(docs.select("doc_id", "source"), "doc_id")
    first = out.filter("sequence_id < 10").groupBy("source").agg(F.sum("length").alias("n")).collect()
    share = {r["source"]: r["n"] / 10240 for r in first}
    assert share["b"] == pytest.approx(1 / (1 + 8**0.5), abs=0.01)


def test_packing_of_hard_rows(spark, hard):
    rows = rows_of(packing.pack(hard.filter("doc_id IS NOT NULL AND doc_id != 6"), BPE), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    t = Tokenizer.from_file(BPE)
    brute.packed(rows, {r[0]: np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in HARD if r[0] not in (None, 6)})
    twice = packing.pack(hard, BPE)
    assert twice.filter("doc_id = 6 AND start = 0").count() == 2 and twice.filter("doc_id IS NULL").count() >= 1
    assert packing.pack(empty(hard), BPE).count() == 0


# 4 near duplicates


def test_near_duplicates(spark, small, documents):
    out = {r[0]: r[1:] for r in rows_of(queries.op4_near_duplicates(spark, small), "doc_id", "n_shingles", "component_id", "kept")}
    assert out == brute.near_duplicates(list(documents.items()))


def test_near_duplicates_of_edited_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    data = []
    for family in range(6):
        base = [word() for _ in range(80)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(80)] = word()
            data.append((len(data), " ".join(copy)))
    rng.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    out = {r[0]: r[1:] for r in rows_of(neardup.near_duplicates(docs, 2), "doc_id", "n_shingles", "component_id", "kept")}
    assert out == brute.near_duplicates(data)


def test_near_duplicates_in_tiles_rounds_and_exactly(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    data = []
    for _ in range(240):  # from near copies to documents that are just not similar enough
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 12])):
            copy[rng.randrange(90)] = f"x{rng.randrange(400)}"
        data.append((len(data), " ".join(copy)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    expected = brute.near_duplicates(data)
    assert len({c for _, c, _ in expected.values()}) > 5
    for tile, rounds, exact in ((8, 3, False), (8, 1, True), (256, 0, False)):
        monkeypatch.setattr(neardup, "TILE", tile)
        monkeypatch.setattr(neardup, "LINEAR_ROUNDS", rounds)
        out = {r[0]: r[1:] for r in rows_of(neardup.near_duplicates(docs, 2, exact=exact), "doc_id", "n_shingles", "component_id", "kept")}
        assert out == expected
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, similarity=0.7)


def test_near_duplicates_of_hard_rows(hard):
    out = {r[0]: r[1:] for r in rows_of(neardup.near_duplicates(hard, 2), "doc_id", "n_shingles", "component_id", "kept")}
    assert out[1] == (0, 1, True) and out[3] == (0, 3, True) and out[6] == (7, 6, True)
    assert out[13][1:] == (12, False) and out[None] == (4, None, True)
    assert len(out) == 13
    assert neardup.near_duplicates(empty(hard)).count() == 0
    kept = neardup.first_of_each(hard, 2)
    assert kept.columns == hard.columns and kept.filter("doc_id = 6").count() == 1 and kept.filter("doc_id = 13").count() == 0 and kept.filter("doc_id IS NULL").count() == 1


def test_odd_sketches_estimate_the_difference():
    rng = np.random.default_rng(1)
    for share in (0.95, 0.9, 0.8):
        base = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
        n = int(4000 * (1 - share) / (1 + share))
        other = np.concatenate([base[n:], rng.integers(0, 1 << 62, n).astype(np.uint64)])
        low = np.array([neardup.minima(np.unique(base)), neardup.minima(np.unique(other))])
        a, b = neardup.odd_sketches(low).view(np.uint64)
        assert int(np.bitwise_count(a ^ b).sum()) <= neardup.sketch_limit(0.8)


# 5 URLs


def test_url_rules(spark, small):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()}
    for i, host, path, rule, verdict in rows_of(queries.op5_url_filter(spark, small), "page_id", "host", "path", "rule", "verdict"):
        want = brute.url_row(pages[i])
        assert (host, path, rule) == want[:3] and (rule is None or verdict == want[3])


def test_url_models_on_hosts_that_no_label_covers(spark):
    rng = random.Random(6)
    good, bad = ["news", "garden", "library", "weather", "museum", "school"], ["casino", "pills", "lottery", "poker"]
    data = []
    for k in range(3000):
        # Of the bad hosts, one holds no word of the list and so counts as accepted, and some have no label.
        kind = "clean" if k % 5 else rng.choice(["seed", "seed", "seed", "hidden", "inside"])
        word = rng.choice(bad)
        name = f"{rng.choice(['city', 'old', 'the', 'my'])}{rng.choice(good)}{rng.choice(good)}" if kind == "clean" else "free-bets" if kind == "hidden" else f"{rng.choice(['best', 'free', 'cheap', 'top'])}-{word}{'zone' if kind == 'inside' else ''}"
        data.append((k, f"http://www.{name}.example.net/{rng.choice(['en', 'fr'])}/{k}", kind))
    pages = spark.createDataFrame(data, "page_id bigint, url string, kind string")
    found = {(r[0], r[1]): r[2] for r in rows_of(urls.judged(pages).join(pages.select("page_id", "kind"), "page_id").filter("rule IS NULL").groupBy("kind", "verdict").count(), "kind", "verdict", "count")}
    for kind, verdict in (("seed", "block"), ("hidden", "block"), ("inside", "block"), ("clean", "allow")):
        n = found.get((kind, verdict), 0)
        assert n > 50 and n >= 0.97 * (n + found.get((kind, "allow" if verdict == "block" else "block"), 0))
    # The caller's labels take the place of the words; a shape with both labels is rejected, equal scores judge alike.
    labels = spark.createDataFrame([(u, b) for _, u, k in data for b in ([False] if k == "clean" else [True])] + [(data[1][1], True), (None, None)], "url string, rejected boolean")
    rows = rows_of(urls.judged(pages.unionByName(pages), labels=labels).join(pages.select("page_id", "kind"), "page_id").filter("rule IS NULL"), "kind", "verdict", "page_id", "score")
    assert len(set(rows)) * 2 == len(rows)
    assert sum(v == "block" for k, v, *_ in rows if k == "hidden") >= 0.97 * sum(k == "hidden" for k, *_ in rows)


def test_url_cutoff(spark):
    rows = lambda data: spark.createDataFrame(data, "score double, rejected boolean")
    step = urls.SCALE / 100
    assert urls.calibrated(rows([(5 * step, False), (-9 * step, True)])) == 0.0
    assert urls.calibrated(rows([(-k * step, False) for k in range(1, 11)] + [(9 * step, True)])) == -9 * step
    assert urls.calibrated(rows([(1.0, False)])) is None and urls.calibrated(rows([])) is None


def test_url_scores_are_the_models_likelihoods(spark):
    train = spark.createDataFrame([("abab", False), ("abba", False), ("zyzy", True), ("zzay", True)], "shape string, rejected boolean")
    weights = urls.fitted(train, 3)
    texts = ["abzy", "qqa", ""]
    got = {texts[r["id"]]: r["score"] for r in urls.scored(spark.createDataFrame(list(enumerate(texts)), "id bigint, shape string"), weights, 3).collect()}
    counts = {0: {}, 1: {}}
    for text, rejected in (("abab", 0), ("abba", 0), ("zyzy", 1), ("zzay", 1)):
        s = "\x02" + text + "\x03"
        for j in range(1, len(s)):
            for k in range(3):
                if j - k >= 0:
                    counts[rejected].setdefault(s[j - k : j], {}).setdefault(s[j], 0)
                    counts[rejected][s[j - k : j]][s[j]] += 1

    def chance(model, context, char, k):
        if k < 0:
            return 1 / urls.ALPHABET
        shorter = chance(model, context[1:] if context else "", char, k - 1)
        seen = counts[model].get(context)
        return shorter if not seen else (seen.get(char, 0) + len(seen) * shorter) / (sum(seen.values()) + len(seen))

    for text in got:
        s = "\x02" + text + "\x03"
        total = 0.0
        for j in range(1, len(s)):
            context = s[max(0, j - 2) : j]
            total += np.log(chance(0, context, s[j], len(context))) - np.log(chance(1, context, s[j], len(context)))
        assert got[text] / urls.SCALE == pytest.approx(total / (len(text) + 1), abs=1e-4)


def test_url_models_count_every_labelled_url(spark):
    # Both kinds share no letter, so that no accepted URL is scored as rejected and leaves the training set.
    name = lambda i, letters: "".join(letters[i // 12**k % 12] for k in range(4))
    data = [(i, f"x://{name(i, 'abcdefghijkl')}/", False) for i in range(12**4)] + [(12**4 + i, f"x://{name(i, 'abcdefghijkl')}{'ghijkl'[i % 6]}/", False) for i in range(5000)] + [(-1 - i, f"x://{name(7 * i, 'mnopqrstuvwx')}/", True) for i in range(300)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, rejected boolean")
    got = dict(rows_of(urls.judged(pages, labels=pages.select("url", "rejected")).filter("page_id % 97 = 0"), "page_id", "score"))
    shapes = pages.select(F.col("page_id").alias("id"), F.expr("substring(url, 5)").alias("shape"), "rejected")
    want = rows_of(urls.scored(shapes.filter("id % 97 = 0"), urls.fitted(shapes)), "id", "score")
    assert len(want) > 250 and {i: x / urls.SCALE for i, x in want} == pytest.approx(got, abs=1e-12)


def test_url_hosts_alternate_between_folds(spark):
    rows = [(i, f"h{i % 4000}/{i}", f"h{i % 4000}", None if i % 7 == 6 else i % 4000 % 3 == 0) for i in range(9000)]
    shapes = spark.createDataFrame(rows, "id bigint, shape string, host string, rejected boolean")
    got = rows_of(urls.folded(shapes), "id", "host", "rejected", "fold")
    assert sorted(r[:3] for r in got) == [(i, h, r) for i, _, h, r in rows if r is not None]
    folds = dict((h, f) for _, h, _, f in got)
    assert len({(h, f) for _, h, _, f in got}) == len(folds)
    for bad in (False, True):
        hosts = [h for _, h in sorted(rows_of(shapes.filter(F.col("rejected") == bad).select(F.xxhash64("host").alias("hash"), "host").distinct(), "hash", "host"))]
        assert len(hosts) > 1000 and [folds[h] for h in hosts] == [(k + 1) % 2 for k in range(len(hosts))]


def test_url_substrings(spark):
    texts = ["", "a", "ab\n\u00e9\U0001f600\U0001f600z", "x" * 200_000 + "\U0001f600"]
    got = dict(rows_of(spark.createDataFrame(list(enumerate(texts)), "id int, shape string").select("id", urls.substrings(F.col("shape"), 4).alias("grams")), "id", "grams"))
    for i, text in enumerate(texts):
        marked = "\x02" + text + "\x03"
        assert got[i] == [marked[at : at + k] for k in range(1, 5) for at in range(len(marked) - k + 1)]


def test_urls_of_hard_rows(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://", "x"), (5, "HTTP://EXAMPLE.Org/es/1", "x"), (5, "HTTP://EXAMPLE.Org/es/1", "x"), (None, "http://a.com/fr/", "x"), (7, "http://b.net/" + "y" * 5000, "x"), (8, "http://notorg/", "x"), (9, "http://x.org?q", "x")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, host string")
    out = rows_of(urls.judged(pages), "page_id", "host", "path", "rule", "verdict")
    assert len(out) == len(data)
    for i, host, path, rule, verdict in out:
        want = brute.url_row(dict((a, b) for a, b, _ in data)[i])
        assert (host, path, rule) == want[:3] and verdict == (want[3] or "allow")
    assert urls.judged(empty(pages)).count() == 0


# 6 personal data

PERSONAL = [
    "mail a@b.co, x_y%z+1@c-d.e.f. and @no.at or two@at@sign.org; a@b.c_d@e.f",
    "ips 1.2.3.4 and 999.1.1.1, 01.002.0003.4.5.6.7.8 or 1.2.3; 300.1.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111, 5500000000000004 12 and 123456789012345678901234567890",
    "phones +1 (017) 555-7713, +49 30 123456 7., +1-2 and ++44 20 7946 0958 +12(34)56.78-90",
    "é😀 +1 (017) 555-7713 é a@b.co",
    "",
]


def test_personal_data_of_the_query(spark, small, documents):
    out = rows_of(queries.op6_personal_data(spark, small), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert {r[0]: r[1:] for r in out} == {i: brute.personal_row(t) for i, t in documents.items()}


def test_personal_data_of_hard_rows(spark, hard):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id bigint, text string")
    out = {r[0]: r[1:] for r in rows_of(personal.digests(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")}
    assert out == {i: brute.personal_row(t) for i, t in enumerate(PERSONAL)}
    ours = ordered(rows_of(personal.digests(hard), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    assert ours == ordered([(r[0], *brute.personal_row(r[1])) for r in HARD])
    assert personal.digests(empty(hard)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    data = [(k, f"please call me at +1 (20{k % 10}) 555-{1000 + k} today") for k in range(12)]
    data += [(100 + k, f"please call me at 020 7946 0{k}58 today") for k in range(3)]
    data += [(200, "the score was 020 7946 0958 points"), (201, "lot 020 7946 0111 sold")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    spans = {r[0]: r[1] for r in rows_of(personal.digests(docs), "doc_id", "spans")}
    assert all(spans[100 + k] == f"phone:18:{18 + len(f'020 7946 0{k}58')}" for k in range(3))
    assert spans[200] == "" and spans[201] == ""


def test_contexts_hold_more_unseen_than_known_identifiers(spark):
    """Many unseen values of any grouping behind 8 known ones; contradicted contexts stay untrusted."""
    luhn = lambda d: d + str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(d))) % 10)
    card = [luhn(f"37828224631{k:03}") for k in range(40)]
    before = {"phone": "please call me at", "email": "please write mail to", "ip": "the host answers from", "card": f"paid {'by' * 150} card"}
    known = {"phone": lambda k: f"+1 (20{k}) 555-1000", "email": lambda k: f"u{k}@host.com", "ip": lambda k: f"10.0.0.{k}", "card": lambda k: luhn(f"41111111111111{k}")}
    unseen = {
        "phone": [f"555-01{k:02}" for k in range(20)] + [f"20794609{k:02}" for k in range(20)] + ["(020) 7946 0958"],
        "email": [f"ann{k} at host dot com" for k in range(20)] + ["ann.lee (at) host [dot] com", f"{'n' * 90} at {'h' * 80} dot {'c' * 70}"],
        "ip": [f"2001:db8::{k:x}" for k in range(1, 20)] + ["::1", "fe80:0:0:0:0:0:0:1", "10[.]0[.]0[.]77"],
        "card": [f"{c[:4]}.{c[4:10]}.{c[10:]}" for c in card],
    }
    data, expected = [], {}
    for kind, words in before.items():
        data += [f"{words} {known[kind](k)} today" for k in range(8)]
        for value in unseen[kind]:
            expected[len(data)] = f"{kind}:{len(words) + 1}:{len(words) + 1 + len(value)}"
            data.append(f"{words} {value} today")
    clean = len(data)
    data += ["please call me at 2024-01-15 today", "the lot was 1234567 sold", f"paid {'by' * 150} card 3782.822463.10006 today", "the host answers from 10:30:00 today"]
    # As many numbers that fail the checksum as cards: the context says nothing about the others.
    mixed = len(data)
    data += [f"see the entry {luhn(f'41111111111112{k}')} here" for k in range(8)] + [f"see the entry {c[:4]}.{c[4:10]}.{c[10:14]}{(int(c[14]) + 1) % 10} here" for c in card[:8]] + [f"see the entry {c[:4]}.{c[4:10]}.{c[10:]} here" for c in (luhn("55550000111122"),)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    spans = {r[0]: r[1] for r in rows_of(personal.digests(docs), "doc_id", "spans")}
    assert {i: spans[i] for i in expected} == expected
    assert all(spans[i] == "" for i in range(clean, mixed)) and all(spans[i] == "" for i in range(mixed + 8, len(data)))


def test_redacted(spark, hard):
    out = {r["doc_id"]: r["text"] for r in personal.redacted(hard).collect()}
    assert out[6] == "same text in two rows, <EMAIL> and <IP>" and out[1] is None and out[2] == ""
    assert personal.redacted(hard).count() == len(HARD) and personal.redacted(hard).columns == hard.columns


# 7 chat


def test_chat_round_trip(spark, small):
    turns: dict = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    turns[-7] = [("user", chat.CONFLICTING), ("assistant", chat.CONFLICTING)]
    out = rows_of(queries.op7_chat_format(spark, small), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "round_trip")
    assert {r[0]: r[1:5] for r in out} == {i: brute.chat_row(t) for i, t in turns.items()}
    assert all(r[5] for r in out)


def test_chat_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    found = con.execute(queries.oracle_sql()["op7_chat_format"])
    names = [c[0] for c in found.description]
    assert ordered([tuple(r) for r in found.fetchall()]) == ordered(rows_of(queries.op7_chat_format(spark, small), *names))


def test_chat_of_conflicting_texts(spark):
    rng = random.Random(8)
    parts = ["</turn>", "<\\/turn>", "### User: ", "#\\## Assistant: ", "\\", "<", "#", "\n", "### ", " ", "x", "/turn>", ": ", "####", "é", "$1", "x-41", "### x-41: "]
    data, turns = [], {}
    for conv in range(120):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "tool: x", "", "User"])
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
            data.append((conv, turn, role, text))
            turns.setdefault(conv, []).append((role, text))
    rows = spark.createDataFrame([(*d, "clash") for d in data], "conv_id bigint, turn bigint, role string, text string, body string")
    out = rows_of(chat.digests(rows), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "round_trip")
    assert {r[0]: r[1:5] for r in out} == {i: brute.chat_row(t) for i, t in turns.items()}
    assert all(r[5] for r in out)
    odd = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "assistant", "y" * 100_000)], "conv_id bigint, turn bigint, role string, text string")
    found = {r["conv_id"]: r for r in chat.digests(odd).collect()}
    assert found[1]["n_turns"] == 2 and found[None]["n_turns"] == 1 and found[2]["loss_chars"] == 100_000 and all(r["round_trip"] for r in found.values())
    assert chat.digests(empty(odd)).count() == 0


# 8 main text


def test_main_text_of_the_query(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    out = {r[0]: r[1:] for r in rows_of(queries.op8_main_text(spark, small), "page_id", "text", "n_chars")}
    want = {i: brute.article_text(h) for i, h in pages.items()}
    assert out == {i: (t, len(t)) for i, t in want.items()}


def test_main_text_of_held_out_layouts():
    pages = webtext.labelled_pages(150, seed=77)
    right = 0
    for page in pages:
        tree = webtext.parse(page, labelled=True)
        labels = []
        for k, mark in enumerate(tree.marked):
            labels.append(mark if mark is not None else labels[tree.parents[k]] if k else webtext.MIXED)
        want = [t for n, t in tree.segments if labels[n] == webtext.CONTENT]
        got = webtext.main_texts(webtext.fitted(), [page.replace(' x-label="1"', "").replace(' x-label="0"', "").replace(' x-label="2"', "")])[0]
        right += got == " ".join(want)
    assert right >= 0.95 * len(pages)


def test_messages_are_exact():
    """Marginals by messages are those of the sum over all labellings of a small tree."""
    import itertools

    model = webtext.fitted()
    rng = np.random.default_rng(3)
    parents, depths = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    unary = rng.normal(size=(6, 3))
    total = np.zeros((6, 3))
    for labels in itertools.product(range(3), repeat=6):
        p = model.root[labels[0]] + sum(unary[k, y] for k, y in enumerate(labels)) + sum(model.pair[labels[parents[k]], labels[k]] for k in range(1, 6))
        for k, y in enumerate(labels):
            total[k, y] += np.exp(p)
    assert np.allclose(webtext.marginals(model, unary, parents, depths), total / total.sum(axis=1, keepdims=True))


def test_pages_that_try_the_parser():
    """Marks of labelled pages mean nothing in others, attributes count by whole names, and nesting costs linear time."""
    import time

    page = '<body x-label="abc"><article data-x-label="9" x-label=""><p x-label="2">The text of the page goes on.</p></article></body>'
    assert webtext.main_texts(webtext.fitted(), [page]) == ["The text of the page goes on."]
    assert webtext.parse(page).marked == [None] * 4 and webtext.parse('<p x-label="1"><p x-label="7"><p data-x-label="1">', labelled=True).marked == [None, 1, None, None]
    assert webtext.parse('<div data-id="footer" my-class=nav id="x">').tokens[1] == ["x"]
    began = time.time()
    n = 20_000
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<div>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<p>" + "<b>" * n + "<div></div>" * n, "<ul>" + "<div>" * n + "<li></li>" * n, "<table>" + "<td><b>" * n, "<" * n, "<a " * n, '<p class="' * n, "<!--" * n, "</" * n, "&" * n):
        webtext.main_texts(webtext.fitted(), [page])
    assert time.time() - began < 60


def test_main_text_of_repeated_rows_and_ties(spark):
    page = "<div><p>one</p><p>one</p></div>"
    df = spark.createDataFrame([(1, "u", page)] * 3, "page_id bigint, url string, html string")
    rows = webtext.extract(df).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 1


def test_main_text_of_hard_pages(spark):
    pages = [
        (1, "u", None),
        (2, "u", ""),
        (3, "u", "<article><h1>A &amp; B</h1><p>one  two\n three<p>four <b>five</b>six<script>x<y</script><!-- no --></article>"),
        (4, None, "<div class=cookie-notice>We use cookies</div><main><h1>Title</h1><p>Body text of the page that goes on for a while.</p></main><div id=comments><p>Nice post</p></div><footer>foot"),
        (5, "u", "<p" + "<div>" * 3000 + "deep"),
        (6, "u", "<<<>>> &bogus; & < a"),
        (7, "u", "<article><p>x &#x41;&eacute;&nbsp;y</p></article>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, text string")
    out = {r["page_id"]: r["text"] for r in webtext.extract(df).collect()}
    assert out[1] == "" and out[2] == "" and out[3] == "A & B one two three four fivesix"
    assert out[4] == "Title Body text of the page that goes on for a while." and out[7] == "x Aé y" and len(out) == 7
    assert webtext.extract(empty(df)).count() == 0


# 9 TIFF


def test_media_of_the_query(spark, small, documents):
    out = rows_of(queries.op9_tiff_media(spark, small), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert {r[0]: r[1:] for r in out} == {i: brute.media_row(t) for i, t in documents.items()}


def test_media_of_hard_rows(hard):
    out = ordered(rows_of(tiff.digests(hard), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    assert out == ordered([(r[0], *brute.media_row(r[1])) for r in HARD])
    assert tiff.digests(empty(hard)).count() == 0
    pages = tiff.page_rows(tiff.stored(hard))
    assert pages.filter("error IS NOT NULL").count() == 0 and pages.filter("doc_id = 5").count() == 3


@pytest.mark.parametrize("compression", sorted(tiff.ENCODERS))
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trips(compression, order):
    rng = np.random.default_rng(compression)
    for kind in (np.uint8, np.uint16):
        for predictor, tile, samples in ((1, 0, 1), (2, 0, 3), (2, 32, 1), (1, 16, 3)):
            images = [(rng.integers(0, 40, (rows, columns, samples)) * (rng.random((rows, columns, samples)) < 0.3)).astype(kind) for rows, columns in ((1, 1), (70, 45), (33, 129))]
            pages = list(tiff.pages_of(tiff.write(images, [(compression, predictor, tile)] * 3, 20, order)))
            assert [p.error for p in pages] == [None] * 3
            for image, p in zip(images, pages, strict=True):
                assert np.array_equal(np.frombuffer(p.pixels, np.dtype(kind).newbyteorder(order)).reshape(image.shape), image)


def test_lzw_and_packbits_of_long_data():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 50_000, rng.integers(0, 256, 60_000, np.uint8).tobytes(), b"\0" * 100_000, bytes(range(256)) * 40):
        assert tiff.unlzw(tiff.lzw(data), 1 << 30) == data and tiff.unpackbits(tiff.packbits(data), 1 << 30) == data
        assert all(decode(encode(data), 1000) == data[:1000] for decode, encode in ((tiff.unlzw, tiff.lzw), (tiff.unpackbits, tiff.packbits), (tiff.inflated, zlib.compress)))


def test_layouts_have_payloads_of_all_sizes(spark, small):
    out = rows_of(queries.op9_tiff_media(spark, small), "payload_bytes", "layouts")
    for kind in ("5/1", "32773/1", "8/2", "5/2"):
        sizes = [n for n, layouts in out if kind in layouts.split(",")]
        assert min(sizes) < 1500 and max(sizes) > 10_000


def test_a_field_that_points_nowhere_spoils_its_page_only():
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (20, 64), np.uint8) for _ in range(3)]
    data = bytearray(tiff.write(images, [(tiff.DEFLATE, 1, 0)] * 3))
    file = tiff.File(bytes(data))
    places = [d for d in file.directories()]
    assert len(places) == 3
    # The second page's strip offsets as 1000 values far past the end.
    at = struct.unpack_from("<I", data, 4)[0]
    at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    for k in range(struct.unpack_from("<H", data, at)[0]):
        entry = at + 2 + 12 * k
        if struct.unpack_from("<H", data, entry)[0] == 273:
            struct.pack_into("<II", data, entry + 4, 1000, len(data) + 5)
    pages = list(tiff.pages_of(bytes(data)))
    assert [p.error is None for p in pages] == [True, False, True]
    assert pages[0].pixels == images[0].tobytes() and pages[2].pixels == images[2].tobytes()


def test_hostile_tiffs():
    """Zero and odd sizes, claims of more pixels than there is data, strips that inflate to more: an error or the page."""
    image = np.arange(64 * 64, dtype=np.uint8).reshape(64, 64)
    field = lambda tag, kind, value: struct.pack("<HHI", tag, kind, 1) + value
    for tile, tag, kind, value in ((16, 322, 4, b"\0\0\0\0"), (16, 323, 4, b"\0\0\0\0"), (0, 256, 11, struct.pack("<f", 8.5)), (0, 256, 4, b"\xff\xff\xff\x7f"), (16, 322, 4, b"\xf0\xff\xff\x7f"), (0, 278, 4, b"\0\0\0\0"), (0, 277, 3, b"\0\0\0\0"), (0, 257, 2, b"a\0\0\0")):
        data = bytearray(tiff.write([image, image], [(tiff.DEFLATE, 1, tile)] * 2))
        first = struct.unpack_from("<I", data, 4)[0]
        at = next(k for k in range(first + 2, len(data), 12) if struct.unpack_from("<H", data, k)[0] == tag)
        data[at : at + 12] = field(tag, kind, value)
        pages = list(tiff.pages_of(bytes(data)))
        assert pages[0].error and pages[0].pixels is None and pages[1].error is None and pages[1].pixels == image.tobytes()
    bomb = zlib.compress(b"\0" * 50_000_000)
    data = tiff.write([image], [(tiff.DEFLATE, 1, 0)])
    assert data.count(zlib.compress(image.tobytes(), 1)) == 1 and len(tiff.inflated(bomb, 4096)) == 4096


def test_broken_tiffs(spark):
    good = tiff.store(b"x" * 64 * 3000)
    cut = good[:-40]
    loop = bytearray(tiff.write([np.zeros((2, 2), np.uint8)], [(tiff.DEFLATE, 1, 0)]))
    loop[-4:] = loop[4:8]
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"MM\0*")), (4, bytearray(cut)), (5, bytearray(good)), (6, loop)], "doc_id bigint, media binary")
    rows = tiff.page_rows(df).collect()
    found = {i: [r for r in rows if r["doc_id"] == i] for i in range(1, 7)}
    assert all(found[i][0]["error"] for i in (1, 2, 3)) and found[4][-1]["error"]
    assert len(found[5]) == 3 and not any(r["error"] for r in found[5]) and len(found[6]) == 1 and not found[6][0]["error"]


def test_floating_predictor():
    x = np.linspace(0, 1, 24, dtype=">f4").reshape(2, 12)
    planes = x.view(np.uint8).reshape(2, 12, 4).transpose(0, 2, 1).reshape(2, 48)
    data = np.diff(planes, axis=1, prepend=np.zeros((2, 1), np.uint8)).astype(np.uint8).tobytes()
    assert tiff.unpredicted(data, 2, 12, 1, 32, 3, "<").tobytes() == x.astype("<f4").tobytes()
    assert tiff.unpredicted(data, 2, 12, 1, 32, 3, ">").tobytes() == x.tobytes()


# 10 quality rules


def test_quality_of_the_query(spark, small, documents):
    out = rows_of(queries.op10_quality_rules(spark, small), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r[0]: r[1:7] for r in out} == {i: brute.quality_row(t) for i, t in documents.items()}
    assert not any(r[6] and r[7] for r in out)


def test_quality_of_hard_rows(spark, hard):
    labels = spark.createDataFrame([(12, 1, 0), (12, 0, 0), (13, None, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = ordered(rows_of(quality.judged(hard, labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert out == ordered([(r[0], *brute.quality_row(r[1])) for r in HARD])
    assert quality.judged(empty(hard), labels).count() == 0
    assert quality.judged(hard, labels.limit(0)).filter("NOT base_failed AND NOT kept").count() == 0


def test_binomial_tails(spark):
    from math import comb

    cases = [(500, 0), (500, 1), (2000, 4), (100, 3), (1500, 7)]
    df = spark.createDataFrame(cases, "n bigint, k bigint")
    for (n, k), r in zip(cases, df.select(quality.binomial_tail(F.col("n"), F.col("k"), 0.005).alias("p")).collect(), strict=True):
        exact = sum(comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1)) if k <= n * 0.005 else 1.0
        assert r["p"] == pytest.approx(exact, rel=1e-9)


@pytest.mark.parametrize("sizes", [{"en": 2400, "de": 900, "fr": 330, "es": 180, "it": 20, None: 5}, {"en": 700, "de": 90}, {"en": 100}, {"en": 900, "de": 900}])
def test_cutoffs_are_those_of_the_method(spark, sizes):
    """kept of every document against plain Python: strata of all sizes, ties at a cutoff, toxic and repeated labels."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    data, labels = [], []
    for lang, n in sizes.items():
        for k in range(n):
            bad, i = k % 5 == 0, len(data)
            marks = 30 if bad and k % 10 else rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 6, 9])  # 6 of 30: equal to a cutoff
            lines = "\n".join([" ".join(word() for _ in range(10))] * (3 if bad and k % 3 == 0 else 1) + [" ".join(word() for _ in range(30))])
            data.append((i, lines + " " + "#" * marks, lang))
            if k % 7:
                labels += [(i, 0 if bad else 1, int(k % 11 == 0))] * (1 + (k % 13 == 0))
    docs, marks = spark.createDataFrame(data, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = quality.judged(docs, marks)
    ratios = F.struct(*[ratio.cast("double").alias(name) for name, (ratio, _) in quality.rules().items()])
    good = {i: q == 1 and not t for i, q, t in labels}
    rows = [r.asDict(True) for r in out.select("doc_id", "stratum", "base_failed", "kept", ratios.alias("ratios"), (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1).alias("holdout")).collect()]
    want = brute.quality_kept([r | {"good": good.get(r["doc_id"])} for r in rows], {n: c for n, (_, c) in quality.rules().items()}, quality.RISK, quality.CONFIDENCE, quality.GAIN)
    assert {r["doc_id"]: r["kept"] for r in rows} == want
    rejected = {r["doc_id"] for r in rows if not r["kept"] and not r["base_failed"]}
    assert bool(rejected) == (sum(sizes.values()) > 300)
    assert sum(good.get(i) is True for i in rejected) <= 2 * quality.RISK * sum(good.values())
