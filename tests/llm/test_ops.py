"""Numbered operators against plain versions, on small tables with hard cases."""

import hashlib
import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, embeddings, html_text, packing, quality, queries, simhash, suffix, token_counts, token_files, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score string, fp0 string"


def docs_table(spark, texts, first=0):
    """Documents with extra columns whose names clash with working ones."""
    rows = [(first + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "s", 0, -5, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- 1 -----------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def check_simhash(got, texts, group=None):
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    roots = components(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    want = {i: (f"{fp:016x}", ids[r]) for i, fp, r in zip(ids, fps, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == want


def test_simhash_whole_table(spark, data, texts):
    check_simhash(queries.queries()["op1_simhash"](spark, data), texts)


def test_simhash_hard_cases(spark):
    base = " ".join(f"word{i}" for i in range(200))
    texts = ["", None, " \t\n", "One", "one", "ONE two", "É é É é", base, base, base + " tail", base.replace("word7 ", "other "), base * 40, "a b c " * 500]
    table = docs_table(spark, texts)
    check_simhash(simhash.near_duplicate_components(table), dict(enumerate(texts)))
    twice = simhash.near_duplicate_components(table.unionByName(table)).collect()
    assert len(twice) == 2 * len(texts) and len(set(map(tuple, twice))) == len(texts)
    assert simhash.near_duplicate_components(table.where("false")).collect() == []


@pytest.mark.parametrize("group", [2, 5, 4096])
def test_deletion_variants_lose_no_link(spark, group):
    """One dense group and noise: groups of any size give the same components."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre}
    for _ in range(150):
        x = r.choice(sorted(fps))
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(fps)], "id long, fp0 long")
    links = simhash.near_links(nodes, group=group).collect()
    assert all(bin(fps[x.a] ^ fps[x.b]).count("1") == x.dist <= 3 for x in links)
    close = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert components(len(fps), [(x.a, x.b) for x in links]) == components(len(fps), close)


def test_variants_move_once(spark, monkeypatch):
    """However many the shared keys are, no variant is shuffled twice to find them."""
    made = []
    keep = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: made.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    nodes = spark.range(300).selectExpr("id", "xxhash64(id div 3) ^ (id % 3) AS fp0")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the keys are too many
    try:
        links = simhash.near_links(nodes).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert {r.a // 3 for r in links} == set(range(100)) and all(r.a // 3 == r.b // 3 for r in links)
    assert sum(plan.count("Exchange hashpartitioning") for name, plan in made if name.startswith("variants")) == 1



# --- 2 -----------------------------------------------------------------------


def plain_alignment(item, text):
    before, best = [0] * (len(text) + 1), 0
    for a in item:
        now = [0]
        for j, b in enumerate(text):
            now.append(max(0, before[j] + (2 if a == b else -1), before[j + 1] - 1, now[j] - 1))
            best = max(best, now[-1])
        before = now
    return best / (2 * len(item))


def test_decontamination(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    items = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(12)] + ["", None, "single", "two words"]
    noise = lambda n: [word() for _ in range(n)]

    def edited(text, p):
        return " ".join(word() if r.random() < p else w for w in text.split())

    texts = {0: None, 1: "", 2: " ".join(noise(500))}
    for k, item in enumerate(items[:12]):
        texts[10 + k] = " ".join([*noise(30), item.upper() if k % 3 == 0 else edited(item, 0.15 * (k % 3)), *noise(30)])
    texts[40] = " ".join([items[0], *noise(5), items[1], *noise(3), items[0]])
    texts[41] = "it is a single word, and two words too"
    texts[42] = " ".join([*noise(20_000), items[2], *noise(100)])
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs_table(spark, list(texts.items())), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for d, t in texts.items():
        for i, item in enumerate(items):
            w = decontaminate.words(item)
            if w and (s := plain_alignment(w, decontaminate.words(t))) >= 0.4:
                want[d, i] = s
    assert {k: x.score for k, x in got.items()} == pytest.approx(want)
    x = got[42, 2]
    assert decontaminate.words(texts[42])[x.first_word : x.first_word + x.n_words] == decontaminate.words(items[2])
    assert {(10 + k, k) for k in range(12) if k % 3 < 2} <= set(got)  # whole, or one word in seven replaced


def test_decontamination_of_larger_benchmarks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(20)], "item_id long, text string")
    docs = docs_table(spark, [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(0, 20, 3)] + ["clean text of no item"])
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    twice = sorted(map(tuple, decontaminate.leaks(docs.unionByName(docs), items.unionByName(items)).collect()))
    assert len(whole) == 7 and twice == sorted(2 * whole)
    monkeypatch.setattr(decontaminate, "SMALL_BENCHMARK", 10)  # items joined by shuffle, a bit map with hardly room for them
    monkeypatch.setattr(decontaminate, "MAP_BITS", 1024)
    assert whole == sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [7]
    null = docs_table(spark, [(None, " ".join(f"w1x{j}" for j in range(9))), (5, None), (6, "")])
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(null, items).collect()] == [(None, 1)]
    assert decontaminate.leaks(docs, items.where("false")).collect() == [] == decontaminate.leaks(docs.where("false"), items).collect()
    assert decontaminate.without_leaks(docs, items.where("false")).count() == 8


def test_decontamination_whole_table(spark, data, documents):
    """Every pair of document and item that has an alignment of the least score, by brute force over all pairs."""
    items = {r.item_id: decontaminate.words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    want = {}
    for d in documents.collect():
        text = decontaminate.words(d.text)
        known = set(text)
        for i, item in items.items():
            # No more than the item's words that the text has can match.
            if item and sum(w in known for w in item) >= 0.4 * len(item) and (s := plain_alignment(item, text)) >= 0.4:
                want[d.doc_id, i] = s
    got = {(r.doc_id, r.item_id): r.score for r in queries.queries()["op2_decontaminate"](spark, data).collect()}
    assert got == pytest.approx(want)


def test_decontamination_recall_by_edits(spark):
    """Items copied with a share of their words replaced, left out or added, among words that items share."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(300)]
    items = [" ".join(r.choice(common) for _ in range(r.randint(15, 50))) for _ in range(60)]
    noise = [(1000 + i, " ".join(r.choice(common) for _ in range(300))) for i in range(40)]

    def edited(text, share):
        out = []
        for w in text.split():
            kind = r.choice("rda") if r.random() < share else ""
            out += {"": [w], "r": [r.choice(common)], "d": [], "a": [w, r.choice(common)]}[kind]
        return " ".join([*(r.choice(common) for _ in range(40)), *out, *(r.choice(common) for _ in range(40))])

    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(100 * k + i, edited(t, share)) for k, share in enumerate((0, 0.15, 0.3)) for i, t in enumerate(items)]
    got = {(x.doc_id // 100, x.doc_id % 100) for x in decontaminate.leaks(docs_table(spark, docs + noise), bench).collect() if x.doc_id < 300 and x.doc_id % 100 == x.item_id}
    found = Counter(k for k, _ in got)
    assert found[0] == 60 and found[1] >= 59 and found[2] >= 54, found


# --- 3 -----------------------------------------------------------------------


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def removal(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_whole_table(spark, data, texts):
    want = dict(zip(texts, plain_removal(texts.values(), 200)))
    assert removal(queries.queries()["op3_suffix"](spark, data)) == want


@pytest.mark.parametrize("group", [2, 2048])
def test_suffix_hard_cases(spark, group):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    a, b = text(90), text(30)
    texts = ["", None, "x" * 19, "x" * 21, "x" * 300, a, a, text(50) + a[:40] + text(50), text(5) + a[10:60], b[:19], b[:20], b + text(9), *(text(20) + b + text(20) for _ in range(9)), "ab" * 60, "ba" * 60, "\x00" * 40 + "a", text(3000) + b]
    table = docs_table(spark, texts)
    want = dict(enumerate(plain_removal(texts, 20)))
    assert removal(suffix.remove_repeats(table, 20, (6, 12), group)) == want
    assert suffix.remove_repeats(table.where("false"), 20, (6, 12)).collect() == []
    both = suffix.remove_repeats(table.unionByName(table), 20, (6, 12), group).collect()
    assert len(both) == 2 * len(texts) and all(x.n_removed == (x.n_bytes if x.n_bytes >= 20 else 0) for x in both)


def test_run_index():
    r = np.random.default_rng(3)
    for _ in range(20):
        texts = [bytes(r.integers(97, 99, r.integers(0, 30)).astype(np.uint8)) for _ in range(r.integers(1, 7))]
        index = suffix.RunIndex(texts)
        assert len(index.heads) <= index.n
        for t, text in enumerate(texts):
            want = [
                max((next((n for n in range(len(text) - p + 1) if text[p : p + n + 1] != other[q : q + n + 1] or p + n >= len(text) or q + n >= len(other)), 0) for u, other in enumerate(texts) for q in range(len(other)) if (u, q) != (t, p)), default=0)
                for p in range(len(text))
            ]
            assert index.matching_statistics(t).tolist() == want


# --- 4 -----------------------------------------------------------------------


def test_quality(spark, data):
    got = queries.queries()["op4_quality"](spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(got) == docs.count()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.queries()["op4_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"], got[got["quality"] == 0]["score"]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97 and (got["predicted"] == got["quality"]).mean() > 0.93


def test_quality_hard_cases(spark):
    table = docs_table(spark, ["", None, "good words here", "BAD!! BAD!!", "good words here", "x " * 200_000])
    labels = spark.createDataFrame([(2, 1, "e"), (3, 0, "e"), (3, None, "e"), (None, 1, "e"), (2, 1, "e")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.judge(table, labels).collect()}
    assert len(got) == 6 and got[0].score == got[1].score and got[2].score == got[4].score > got[3].score
    none = quality.judge(table, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and quality.judge(table.where("false"), labels).collect() == []
    i, v = quality.features("one two two " * 10)
    assert np.isclose(v @ v, 1) and len(i) == len(set(i))


def plain_ftrl(rows, passes, alpha, beta, l1, l2):
    """Follow the regularised leader, coordinate by coordinate; rows of ({coordinate: value}, label), None is the bias."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        cut = 0 if i is None else l1
        return 0.0 if abs(z[i]) <= cut else -(z[i] - math.copysign(cut, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for x, y in rows:
            x = {**x, None: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return lambda x: 1 / (1 + math.exp(-sum(weight(i) * v for i, v in {**x, None: 1.0}.items())))


def plain_features(text):
    """Counts of words, pairs and repeats by hash, as logarithms of length one."""
    import re

    h = [xxhash.xxh64_intdigest(w) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
    top = (1 << 64) - 1
    pairs = [((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ b >> 31) & top) * 0xD6E8FEB86659FD93 & top for a, b in zip(h, h[1:])]
    same = [0x5DEECE66D1CE4E5B for a, b in zip(h, h[1:]) if a == b]
    v = {i: math.log1p(c) for i, c in Counter(x >> 64 - quality.BITS for x in h + pairs + same).items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {i: x / size for i, x in v.items()}


def test_quality_against_a_plain_learner(spark, data, documents):
    """Scores of the registered query, by a dictionary version trained on the same rows in the same order."""
    labels = spark.read.parquet(f"{data}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = documents.join(labels, "doc_id").select("doc_id", "text", "y", F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted((r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5), key=lambda r: (r.h, r.doc_id))
    assert len(rows) <= quality.SAMPLE
    own = plain_ftrl([(plain_features(r.text), r.y) for r in rows], 6, 3.0, 1.0, 0.02, 0.02)
    want = {r.doc_id: own(plain_features(r.text)) for r in documents.collect()}
    got = {r.doc_id: r.score for r in queries.queries()["op4_quality"](spark, data).collect()}
    assert got == pytest.approx(want, abs=1e-4)


# --- 5, 7 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder(library):
    r = random.Random(3)
    parts = ["a", "B", "é", "1", "½", " ", "\n", "\t", "  ", "\xa0", "\x1c", "'s", "'ll", ".", "!!", "中", "🙂", "_", "<|endoftext|>", "<|", "ñ", "\r\n", "'", "word", " the", "\x00", "Ⅷ"]
    texts = ["", None, " ", "\n", *("".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(3000)), *(" ".join(r.choice(parts) for _ in range(6)).strip() for _ in range(3000))]
    got = tokens.Encoder(tokens.tokenizer_path(), most=300).encode(texts)
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == library(t), t


HARD = ["", None, "a", "word " * 5000, "same text", "same text", "\n\n tab\t", "<|endoftext|>"]


def check_token_files(df, texts, library):
    start, want = 0, []
    for i in sorted(texts):
        ids = np.array([*library(texts[i]), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in df.collect()) == want


def test_token_files(spark, data, texts, library):
    check_token_files(queries.queries()["op5_token_files"](spark, data), texts, library)
    check_token_files(token_files.round_trip(docs_table(spark, HARD)), dict(enumerate(HARD)), library)
    assert token_files.round_trip(docs_table(spark, HARD).where("false")).collect() == []


def test_null_and_equal_ids(spark, library):
    """Documents without an id or with another's id are documents of their own; repeated rows count as often as they occur."""
    rows = [(None, "some text"), (None, "some text"), (4, "one two three"), (4, "other words here"), (4, "one two three"), (None, None), (7, "")]
    table = docs_table(spark, rows)
    key = lambda i, t: (str(i), zlib.crc32(np.array([*library(t), 2], "<u4").tobytes()))
    files = token_files.round_trip(table).collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in files) == sorted(key(i, t) for i, t in rows)
    assert sorted((r.start, r.n_tokens) for r in files)[-1][0] + files[-1].n_tokens == sum(len(library(t)) + 1 for _, t in rows)
    packed = packing.pack(table).collect()
    sizes, want = Counter(), Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    for i, t in rows:
        want[i] += len(library(t)) + 1
    assert sizes == want and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sorted((str(r.doc_id), r.fingerprint) for r in simhash.near_duplicate_components(table).collect()) == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words) for r in token_counts.count_tokens(table).collect()) == sorted((str(i), len((t or "").split())) for i, t in rows)
    long = docs_table(spark, [(i, (t or "") * 40) for i, t in rows])
    assert sorted(str(r.doc_id) for r in suffix.remove_repeats(long).collect() if r.n_bytes and r.n_removed == r.n_bytes) == ["4"] * 3 + ["None"] * 2
    assert token_counts.count_tokens(table.where("false")).collect() == []


def test_columns_that_clash(spark):
    """Columns named as what the operator says of a row, and a table without n_chars."""
    docs = spark.createDataFrame([(1, "word " * 90, "mine", 5, "d"), (2, "word " * 90, "yours", 6, "e"), (3, "else", None, 7, "f")], "doc_id long, text string, kept string, n_removed long, mark string")
    got = {r.doc_id: r for r in suffix.without_repeats(docs).collect()}
    assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [("", "mine", 5, "d"), ("", "yours", 6, "e"), ("else", None, 7, "f")]
    assert suffix.remove_repeats(docs, keep=docs.columns).columns == ["doc_id", "text", "mark", *suffix.MADE]


def test_shared_folder(spark):
    """A session on one machine gets a folder; elsewhere it has to be set; paths get the scheme of Spark's file system."""
    from types import SimpleNamespace

    from tilewright.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(cluster)
    assert common.shared_dir(spark).startswith("file:///")
    assert common.qualified(spark, "/some/folder") == "file:///some/folder" and common.qualified(spark, "hdfs://a/b") == "hdfs://a/b"
    with common.scratch(spark):
        inside = common.materialize(spark.range(3), "inside")
        folder = inside.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    import os

    assert not os.path.exists(folder)


def test_seek_table():
    import io

    docs = [(i, np.arange(i * 500, dtype="<u4") % 50_000) for i in range(40)] + [(None, np.array([7], "<u4"))]
    raw = token_files.to_bytes(docs)
    reader = token_files.FrameReader(io.BytesIO(raw), len(raw))
    assert reader.doc_ids == [d for d, _ in docs] and len(reader.sums) > 5
    assert np.array_equal(reader.document(1), docs[1][1]) and reader.frames_read == 1
    for i, (_, ids) in enumerate(docs):
        assert np.array_equal(reader.document(i), ids)
    broken = bytearray(raw)
    broken[40] ^= 1
    with pytest.raises(Exception):
        token_files.FrameReader(io.BytesIO(bytes(broken)), len(raw)).document(1)
    with pytest.raises(ValueError):
        token_files.FrameReader(io.BytesIO(raw[:-1]), len(raw) - 1)


def check_packing(df, texts, library, most_padding):
    rows = df.toPandas()
    whole = {i: np.array([*library(t), 0], "<u4") for i, t in texts.items()}
    for i, g in rows.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == np.concatenate([[0], np.cumsum(g["length"])[:-1]]).tolist() and g["length"].sum() == len(whole[i])
        for x in g.itertuples():
            assert x.doc_tokens == len(whole[i]) and x.ids_crc32 == zlib.crc32(whole[i][x.start : x.start + x.length].tobytes())
    assert set(rows["doc_id"]) == set(texts)
    padding = 0
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.concatenate([[0], np.cumsum(g["length"])[:-1]]).tolist()
        total = int(g["length"].sum())
        assert total <= 1024
        padding += packing.padded(total, 1024) - total
    assert padding <= most_padding * rows["length"].sum()


def test_packing(spark, data, texts, library):
    check_packing(queries.queries()["op7_packing"](spark, data), texts, library, 0.01)
    check_packing(packing.pack(docs_table(spark, HARD)), dict(enumerate(HARD)), library, 0.2)
    assert packing.pack(docs_table(spark, HARD).where("false")).collect() == []


def test_column_generation():
    r = np.random.default_rng(2)
    demand = Counter(int(x) for x in r.integers(1, 1024, 4000))
    patterns = packing.solve_patterns(demand, 1024)
    made = Counter()
    for p, x in patterns:
        assert sum(n * c for n, c in p.items()) <= 1024
        for n, c in p.items():
            made[n] += c * x
    assert made == pytest.approx(demand)
    cost = sum(packing.padded(sum(n * c for n, c in p.items()), 1024) * x for p, x in patterns)
    assert cost <= 1.01 * sum(n * c for n, c in demand.items())
    assert packing.solve_patterns({}, 1024) == [] and packing.make_plan({700: 3}, 1024).tail_tokens == 2100


# --- 6 -----------------------------------------------------------------------


def test_url_rules(spark):
    rows = [
        (1, "https://a.EXAMPLE.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://b.com/en/", "b.com", "/en/", "com/en/", "block"),
        (3, "http://com/en/1", "com", "/en/1", "com/en/", "block"),
        (4, "http://xcom/en/1", "xcom", "/en/1", None, "allow"),
        (5, "http://example.net/de/8#x", "example.net", "/de/8", "example.net/de/8", "block"),
        (6, "http://example.net/de/7", "example.net", "/de/7", "net/de/", "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "x://y://z/p", "y:", "//z/p", None, "allow"),
        (9, "x://y://z/p", "y:", "//z/p", None, "allow"),
        (10, "http://h?q=/en/", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "clash", "clash") for r in rows], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "document long, bad int")
    assert sorted(map(tuple, urls.judge(pages, none).collect()), key=str) == sorted(((r[0], *r[2:]) for r in rows), key=str)
    assert urls.judge(pages.where("false"), none).collect() == []


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good' if i < 120 else 'rare'}.site.test/p/{i}") for i in range(121)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "document long, bad int")
    got = {r.host: r.verdict for r in urls.judge(pages, outcomes).collect()}
    assert got == {"bad.site.test": "block", "good.site.test": "allow", "rare.site.test": "allow"}


def test_urls_against_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op6_url_filters"]).fetchall(), key=str)
    assert sorted(map(tuple, queries.queries()["op6_url_filters"](spark, data).collect()), key=str) == want


# --- 8 -----------------------------------------------------------------------


def plain_count(word, pieces):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        size = len(word[j - 1].encode())
        options = [] if word[j - 1] in pieces.score else [(best[j - 1][0] + size * pieces.byte, -(best[j - 1][1] + size))]
        for i in range(j):
            if word[i:j] in pieces.score:
                options.append((best[i][0] + pieces.score[word[i:j]], -(best[i][1] + 1)))
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


def test_token_counts(spark, data, texts):
    import public_tokenizers

    pieces = token_counts.Pieces.of(public_tokenizers.path("piece_bpe_32k.model"))
    known = {}
    for r in queries.queries()["op8_token_counts"](spark, data).collect():
        words = (texts[r.doc_id] or "").split()
        for w in words:
            if w not in known:
                known[w] = plain_count(token_counts.MARK + w, pieces)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_token_counts_hard_cases(spark):
    pieces = token_counts.Pieces(["▁", "a", "b", "ab", "▁ab", "ba", "aba"])
    words = ["", "a", "ab", "aba", "abab", "bbbb", "zab", "é🙂", "ab" * 200]
    assert token_counts.trie_counts(words, pieces).tolist() == [plain_count(token_counts.MARK + w, pieces) for w in words]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs_table(spark, ["", None, " \n ", "one", "one one"])).collect()}
    assert got[0] == got[1] == got[2] == (0, 0) and got[4] == (2, 2 * got[3][1])


def test_token_counts_of_very_long_words():
    """One very long word among many short ones takes no more memory than its own length."""
    pieces = token_counts.Pieces(["▁", "a", "b", "ab", "▁ab", "ba", "aba"])
    rng = random.Random(5)
    some = ["".join(rng.choice("abé") for _ in range(n)) for n in (1001, 1000, 999, 993, 1020)]
    words = ["z" * 20_000, *(f"a{i}b" for i in range(5000)), *some]
    tracemalloc.start()
    got = token_counts.trie_counts(words, pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [20_001, *(plain_count(token_counts.MARK + w, pieces) for w in words[1:])]
    assert peak < 200_000_000, f"{peak / 1e6:.0f} MB"


# --- 9 -----------------------------------------------------------------------


def check_vectors(got, rows, threshold=0.93):
    units = {}
    for i, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v or [])
        x = np.array(v, float) / np.abs(v).max() if ok else None  # so that no square underflows
        units[i] = (x / np.linalg.norm(x), label) if ok else None
    ids = sorted(units)
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if units[ids[a]] and units[ids[b]] and units[ids[a]][1] == units[ids[b]][1] and len(units[ids[a]][0]) == len(units[ids[b]][0]) and units[ids[a]][0] @ units[ids[b]][0] >= threshold]
    counts, roots = Counter(x for link in links for x in link), components(len(ids), links)
    want = {i: (counts[k], ids[roots[k]], ids[roots[k]] == i) for k, i in enumerate(ids)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == want


@pytest.mark.parametrize("block", [16, 2048])
def test_vectors(spark, block):
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 64))
    rows = [(i, (base[i % 6] + r.normal(size=64) * (0.3 if i % 2 else 0.05)).tolist(), i % 3) for i in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 64, 0), (202, [1.0, None] * 32, 0), (203, [float("nan")] * 64, 0), (204, base[0].tolist(), None), (205, base[0].tolist(), 0), (206, (base[0] * 1e-300).tolist(), 0), (207, [1.0, 0.0], 0), (208, [2.0, 0.0], 0), (209, [], 0)]
    table = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int, n long")
    check_vectors(embeddings.near_duplicate_vectors(table, block=block), rows)
    twice = embeddings.near_duplicate_vectors(table.unionByName(table), block=block)
    assert twice.count() == 2 * len(rows)
    check_vectors(twice.distinct(), rows)
    assert embeddings.near_duplicate_vectors(table.where("false")).collect() == []


def test_vectors_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_vectors(queries.queries()["op9_embeddings"](spark, data), rows)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 64))
    y = x * 0.8 + r.normal(size=(400, 64)) * 0.6
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    codes, factors = embeddings.encode(y)
    est, error = embeddings.estimate(x, codes, factors)
    off = est - x @ y.T
    assert abs(off.mean()) < 0.002 and (np.abs(off) <= error).mean() > 0.9999


def test_cells_lose_few_links(spark):
    """Recall of the cells alone against brute force, at the threshold itself."""
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 64))
    z = r.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.931 * x + math.sqrt(1 - 0.931**2) * z / np.linalg.norm(z, axis=1)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links > 0").count() >= 0.99 * len(rows)


# --- 10 ----------------------------------------------------------------------


def test_main_text_of_made_up_pages():
    pages = html_text.made_up(150, 1234)
    labels = html_text.labeller().label([p for p, _ in pages])
    wrong = sum(int((got != (y > 0)).sum()) for got, (_, y) in zip(labels, pages))
    assert wrong <= 0.01 * sum(len(y) for _, y in pages)


def test_main_text_hard_cases(spark):
    article = "<html><head><title>T</title><script>var t='</p>';</script><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/b'>B</a></ul></nav><article><h1>The  title</h1><p>First &amp; foremost,&nbsp;a <b>bold</b>\n paragraph &lt;here&gt; with many more words in it.<p>Second one<br>goes on.</p><!-- hidden --></article><div class='comments'><p class='comment'>Nice article!</p></div><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", article, "clash"), (2, "u", None, "clash"), (3, None, "", "clash"), (4, "u", "<nav><a href='/'>only</a></nav>", "clash"), (4, "u", "<nav><a href='/'>only</a></nav>", "clash"), (5, "u", "<p" * 1000, "clash")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.main_text(table).collect())
    want = "The title\nFirst & foremost, a bold paragraph <here> with many more words in it.\nSecond one goes on."
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0), (4, "", 0), (5, "", 0)]
    assert html_text.main_text(table.where("false")).collect() == []


def test_main_text_of_unmarked_pages():
    """Bare text, plain divs, names in other languages, formulas and fall-back text, tags that are not closed."""
    first, second = "A first paragraph with quite a few words in it, and a comma.", "The second paragraph of the page, with more words to read."
    pages = {
        first: first,
        f"<div>{first}</div><div>{second}</div>": f"{first}\n{second}",
        f"<html><body><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul><p>{first}</p><p>{second}</p></body></html>": f"{first}\n{second}",
        f"<div id='inhalt'><p>{first} <math><mi>x</mi></math> <object>fall-back</object></p></div>": f"{first} x fall-back",
        f"<article><p>{first}</p><svg><p>{second}</p></article>": f"{first}\n{second}",
        f"<article><p>{first}</p><iframe><p>{second}</p></article>": f"{first}\n{second}",
    }
    assert dict(zip(pages, html_text.extract(list(pages), html_text.labeller()))) == pages


_NOUNS = "the of and market river people house garden water light story paper window city morning evening record season travel music".split()


def other_page(r, names, layout):
    """A page of another maker than the labeller was trained with, and its article's texts."""
    sentence = lambda a, b: " ".join(r.choice(_NOUNS) for _ in range(r.randrange(a, b))).capitalize() + "."
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>{r.choice(_NOUNS)} {r.choice(_NOUNS)}</a></li>" for i in range(r.randrange(4, 9))) + "</ul>"
    paragraphs = [" ".join(sentence(8, 20) for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(3, 9))]
    title = sentence(3, 7)
    article = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    side = f"<h3>{sentence(2, 4)}</h3><ul>" + "".join(f"<li><a href='/s{i}'>{sentence(3, 7)}</a></li>" for i in range(r.randrange(3, 6))) + "</ul>"
    if layout == "table":
        page = f"<table><tr><td colspan=3>{menu}</td></tr><tr><td>{side}</td><td>{article}</td></tr><tr><td colspan=2>last changed 1999</td></tr></table>"
    else:
        parts = (menu, article, side, f"<p>&copy; 2024 {r.choice(_NOUNS)}. All rights reserved.</p>")
        page = "".join(f"<div{f' class={n}' if n else ''}>{part}</div>" for n, part in zip(names, parts))
        page = f"<div class=outer-x><div>{page}</div></div>" if layout == "wrapped" else page
    return f"<html><body>{page}</body></html>", [title, *paragraphs]


@pytest.mark.parametrize(
    "names, layout",
    [("nav content sidebar footer", "plain"), ("l-head l-body l-extra l-end", "plain"), ("zq-top zq-mid zq-r zq-b", "plain"), ("box box box box", "plain"), ("", "plain"), ("qa qb qc qd", "wrapped"), ("", "table")],
)
def test_main_text_without_known_names(names, layout):
    r, right, total, whole = random.Random(names + layout), 0, 0, 0
    for _ in range(60):
        page, article = other_page(r, names.split() or [""] * 4, layout)
        blocks = html_text.blocks(page)
        got = html_text.labeller().label([blocks])[0]
        want = [b.text in article for b in blocks]
        right, total, whole = right + sum(a == b for a, b in zip(got, want)), total + len(want), whole + (got.tolist() == want)
    assert right >= 0.97 * total and whole >= 54


def test_long_pages_go_in_segments(monkeypatch):
    """Segments give what the whole page at once gives, and hold no more for a longer page than its blocks."""
    page, _ = other_page(random.Random(1), [""] * 4, "plain")
    blocks = html_text.blocks("<div>" + page * 40 + "</div>")
    model = html_text.labeller()
    whole = model.label([blocks])[0]
    monkeypatch.setattr(html_text, "SEGMENT", 64)
    assert len(blocks) > 640 and model.label([blocks])[0].tolist() == whole.tolist()
    monkeypatch.undo()
    html = "<p>some words of a paragraph</p>" * 60_000
    tracemalloc.start()
    found = html_text.extract([html], model)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 140_000_000, f"{peak / 1e6:.0f} MB"
    assert found == "" or set(found.split("\n")) == {"some words of a paragraph"}


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<b>x" * 50_000 + "<p>y" * 2000, "<li>" * 50_000, "<template>" * 50_000, "<p" * 50_000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 20


def test_main_text_whole_table(spark, data):
    import html
    import re

    for r in queries.queries()["op10_html_text"](spark, data).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(p for p in parts if p)
