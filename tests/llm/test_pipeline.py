"""Each stage of the pipeline against a plain version."""

import gc
import random
import re
import tracemalloc
import weakref
from collections import defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from tilewright.llm import common, decontaminate, quality, simhash, suffix, tokens

from .test_ops import check_packing, components, docs_table, library, plain_alignment, plain_removal  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near_duplicates(texts):
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or [b""]:
            at[x].append(k)
    links = set()
    for k, s in enumerate(sets):
        for j in {j for x in s or [b""] for j in at[x] if j < k}:
            same = len(s & sets[j])
            if same >= 0.8 * len(s | sets[j]):
                links.add((j, k))
    return {ids[r] for r in components(len(ids), links)}


def test_quality_stage(spark, data, documents):
    kept = corpus_pipeline.keep_quality(spark, documents, data)
    assert kept.columns == COLUMNS
    model = quality.fit(documents, spark.read.parquet(f"{data}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect() if model.score(r.text) >= 0.3}


def test_near_duplicate_stage(spark, data, documents):
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, data)
    assert kept.columns == COLUMNS
    assert {r.doc_id for r in kept.collect()} == plain_near_duplicates({r.doc_id: r.text for r in documents.collect()})


def test_near_duplicate_hard_cases(spark):
    base = [f"word{i}" for i in range(300)]
    texts = {0: "", 1: None, 2: "one two", 3: "one two", 4: "two one", 5: "x " * 50, 6: "x " * 90}
    for k in range(40):
        some = list(base)
        some[k * 7] = "changed"
        texts[10 + k] = " ".join(some)
    texts[90] = " ".join(base[:150])
    table = docs_table(spark, list(texts.items()))
    want = plain_near_duplicates(texts)
    for group in (2048, 4):
        assert {r.doc_id for r in simhash.drop_near_duplicates(table, group=group).collect()} == want
    twice = simhash.drop_near_duplicates(table.unionByName(table))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(want)
    null = docs_table(spark, [(None, "a b"), (None, "a b"), (3, "a b")])
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(null).collect()) == ["3", "None", "None"]
    assert simhash.drop_near_duplicates(table.where("false")).collect() == []


def test_near_duplicate_edited_copies(spark):
    """Groups of copies around the threshold, among them texts of the same words in another order."""
    rng, texts = random.Random(7), {}
    for _ in range(8):
        family = [[rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(260)]]
        for _ in range(40):
            w = list(rng.choice(family))
            at, n = rng.randrange(200), rng.randrange(10, 34)
            w[at : at + n] = [f"new{rng.randrange(5000)}" for _ in range(n)]
            family.append(w)
        for w in rng.sample(family, 15):
            cuts = sorted(rng.sample(range(1, len(w)), rng.choice([4, 9, 14, 60])))
            parts = [w[i:j] for i, j in zip([0, *cuts], [*cuts, len(w)])]
            rng.shuffle(parts)
            family.append(sum(parts, []))
        rng.shuffle(family)
        texts |= {len(texts) + k: " ".join(w) for k, w in enumerate(family)}
    got = simhash.drop_near_duplicates(docs_table(spark, list(texts.items())))
    assert {r.doc_id for r in got.collect()} == plain_near_duplicates(texts)


def test_near_duplicate_blocks(spark):
    """Keys with more members than are compared at a time give the groups of any other size."""
    rng, texts = random.Random(11), {}
    base = [f"word{rng.randrange(9000)}" for _ in range(400)]
    for k in range(60):
        w, n = list(base), rng.randrange(30, 92)
        at = rng.randrange(len(w))
        w[at:at] = [f"new{rng.randrange(50000)}" for _ in range(n)]
        texts[k] = " ".join(w if k % 2 else w[rng.randrange(40) :])
    want = plain_near_duplicates(texts)
    for group in (2048, 16, 3):
        got = simhash.drop_near_duplicates(docs_table(spark, list(texts.items())), group=group)
        assert {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("edit", ["inserted", "deleted", "substituted"])
def test_near_duplicate_recall_at_the_threshold(spark, edit):
    """Every pair with one edited passage and a similarity of 0.80 to 0.85 is found, of repetitive texts too."""
    rng, texts, pairs = random.Random(3), {}, 0
    while pairs < 60:
        size, few = rng.randrange(150, 600), rng.choice([30, 3000])
        one = [f"w{pairs}x{int(few * rng.random() ** 2)}" for _ in range(size)]
        n = int(size * rng.uniform(0.05, 0.3))
        at = rng.randrange(size - n)
        new = [f"n{pairs}x{rng.randrange(3000)}" for _ in range(n)]
        two = one[:at] + ([] if edit == "deleted" else new) + one[at if edit == "inserted" else at + n :]
        one, two = " ".join(one), " ".join(two)
        x, y = shingles(one), shingles(two)
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            texts |= {2 * pairs: one, 2 * pairs + 1: two}
            pairs += 1
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_table(spark, list(texts.items()))).collect()}
    found = len(texts) - len(kept)
    assert (found, kept) == (pairs, set(range(0, 2 * pairs, 2)))


def test_passage_stage(spark, data, documents):
    cleaned = corpus_pipeline.remove_repeated_passages(spark, documents, data)
    assert cleaned.columns == COLUMNS
    rows, got = documents.collect(), {r.doc_id: r for r in cleaned.collect()}
    assert len(got) == len(rows)
    for r, (_, removed, _, _) in zip(rows, plain_removal([r.text for r in rows], 200)):
        if removed:
            assert got[r.doc_id].n_chars == len(got[r.doc_id].text) < len(r.text)
        else:
            assert got[r.doc_id] == r


def test_decontamination_stage(spark, data, documents):
    kept = corpus_pipeline.decontaminate_documents(spark, documents, data)
    assert kept.columns == COLUMNS
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in documents.collect() if any(" ".join(i) in " ".join(decontaminate.words(r.text)) for i in items)}
    gone = {r.doc_id for r in documents.collect()} - {r.doc_id for r in kept.collect()}
    assert dirty <= gone
    for r in documents.where(documents["doc_id"].isin(list(gone - dirty))).collect():
        assert any(plain_alignment(i, decontaminate.words(r.text)) >= 0.4 for i in items)


def test_pipeline(spark, data, documents, library):  # noqa: F811
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
    check_packing(corpus_pipeline.run(spark, data), {r.doc_id: r.text for r in docs.collect()}, library, 0.01)


def test_stages_on_an_empty_table(spark, data, documents):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).collect() == []


def test_nulls_and_repeated_rows(spark, data):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "text", "en", "s", 4), (2, "", "en", "s", 0), (3, "words " * 90, "en", "s", 540), (3, "words " * 90, "en", "s", 540)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == COLUMNS
        stage(spark, docs, data).collect()
    assert corpus_pipeline.pack_sequences(spark, docs, data).count() >= len(rows)


def test_contexts_take_little_memory():
    text = random.Random(3).randbytes(1 << 22)
    tracemalloc.start()
    for _ in suffix.contexts_of([text], 200, 32):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    suffix._POWERS.clear()
    assert peak < 50 << 20


def test_task_gives_back_memory():
    """A stage's task forgets what packing held in its worker, and leaves none of its freed memory there."""

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) >> 10

    kept = []

    def each(frames):
        some = [bytearray(1000) for _ in range(100_000)]
        kept.append(bytearray(1000))  # above the others, so that the heap's top stays where it is
        yield anonymous()
        del some
        yield from frames

    common.held("tokenizer", lambda: 1)
    full, = common.lean(each, holds=True)(iter([]))
    assert common._HELD and anonymous() < full - 80
    assert list(common.lean(lambda it: it)(iter([1, 2]))) == [1, 2]
    assert not common._HELD


def test_gathered_frames_go_at_once():
    """No frame waits for Python to look for circles, so that a task holds a few of them and not all."""
    seen = []

    def frames():
        for _ in range(5):
            f = pd.DataFrame({"text": ["one two", None, "three"]})
            seen.append(weakref.ref(f["text"]))
            yield f

    gc.collect()
    gc.disable()
    try:
        sizes = [len(f) for f in common.gathered(frames(), chars=20)]
        assert sizes == [6, 6, 3] and not any(r() is not None for r in seen)
    finally:
        gc.enable()


def test_packing_takes_little_memory(library):
    """A worker's arrays hold a part of the text, and few words of those that it met only once."""
    r = random.Random(5)
    common_words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(2000)]
    texts = [" ".join(r.choice(common_words) for _ in range(6000)) for _ in range(100)]
    enc = tokens.Encoder(tokens.tokenizer_path())
    list(enc.encode(texts[:1]))
    tracemalloc.start()
    made = sum(len(raw) for raw in enc.encode(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 100 * 6000 * 4 and peak < 30 << 20

    few, sent = tokens.Encoder(tokens.tokenizer_path(), most=3000), []
    whole = few._whole
    few._whole = lambda some: sent.extend(some) or whole(some)
    for k in range(12):
        text = " ".join([*common_words[:1000], *(f"once{k}x{i}" for i in range(600))])
        raw, = few.encode([text])
        assert len(raw) // 4 == len(library(text)) and len(few.words) <= 3000 + 1600
    assert sum(s.count(f" {common_words[7]} ") for s in sent) == 1
