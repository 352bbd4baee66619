"""Operators 11 to 13 against plain versions and their SQL, on small tables with hard cases and on whole tables."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import exact, fill_in_middle, queries, vector_codes

from .test_ops import docs_table


def same_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert [r.replace(".0", "") for r in rows(got)] == [r.replace(".0", "") for r in rows(want)]


@pytest.mark.parametrize("name", ["op11_exact", "op12_vector_codes", "op13_fill_in_middle"])
def test_whole_tables_against_sql(spark, data, name):
    same_as_sql(spark, data, name)


# --- 11 ----------------------------------------------------------------------


def one_space(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[one_space(t)].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


HARD_TEXTS = ["", None, " ", "\t\n ", "a  b", "a b", "a\x0bb", "a\x0c\r\nb", " a b", "a b ", "a\xa0b", "a b", "ä b", "a\x00b", "a" * 20_000, "a" * 20_001, "b  " * 9000, "b " * 9000, "a" * 511, "a" * 512, "a" * 513]


@pytest.mark.parametrize("name_bytes", [0, 1, 16])
def test_exact_groups(spark, name_bytes):
    """Names of no byte or one clash all the time: what is equal is decided by the verified contents."""
    r = random.Random(4)
    long = "".join(r.choice("abc  \tdé") for _ in range(60_000))
    texts = HARD_TEXTS + [long, long.replace("\t", " "), long[:30_000] + "x" + long[30_001:], long + " ", long[1:]] + ["same text"] * 30
    rows = list(enumerate(texts, 100)) + [(None, "a b"), (None, "only here"), (None, "only  here"), (100, ""), (100, ""), (7, "same  text")]
    got = exact.exact_duplicates(docs_table(spark, rows), name_bytes).collect()
    want = plain_groups(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(rows)
    assert all((g.keep_id, g.group_size) == by_hash[g.text_sha256] for g in got)
    kept = defaultdict(list)
    for g in got:
        kept[g.text_sha256] += [g.doc_id] * g.kept
    assert {h: [keep] for h, (keep, _) in by_hash.items()} == kept
    assert sorted((str(g.doc_id), g.text_sha256) for g in got) == sorted((str(i), hashlib.sha256(one_space(t).encode()).hexdigest()) for i, t in rows)


def test_exact_rows_kept(spark):
    rows = [(3, "a  b"), (2, "a b"), (2, "a b"), (5, "c"), (None, "c"), (None, "d"), (None, "d"), (6, None), (4, "")]
    docs = docs_table(spark, rows)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("2", "a b"), ("4", ""), ("5", "c"), ("None", "d")]
    assert exact.drop_exact_duplicates(docs.where("false")).collect() == []
    assert exact.exact_duplicates(docs.where("false")).collect() == []


def test_chunks_are_cut_by_content():
    r = random.Random(8)
    text = bytes(r.choices(range(256), k=300_000))
    parts = exact.chunks(text)
    assert b"".join(parts) == text and all(0 < len(p) <= exact.MOST for p in parts)
    moved = exact.chunks(b"something new" + text)
    assert len(set(parts) & set(moved)) >= len(parts) - 3
    assert exact.chunks(b"") == [] and b"".join(exact.chunks(bytes(100_000))) == bytes(100_000)
    blocks, exact_at_once = exact.chunks(text), exact.AT_ONCE
    exact.AT_ONCE = 1000
    try:
        assert exact.chunks(text) == blocks
    finally:
        exact.AT_ONCE = exact_at_once


def test_chunks_move_once_a_task(spark):
    """A text that most rows hold is combined before it is shuffled."""
    docs = spark.createDataFrame([(i, "the same long text " * 200) for i in range(3000)], "doc_id long, text string").repartition(2)
    table = exact.recipes(docs)
    plan = exact._entries(table).select("name", "chunk").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


# --- 12 ----------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Every entry is looked at, in Python's integers."""
    kept = [(i, label, v) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // parts
    whole = [[math.floor(Fraction(x) * 4096) for x in v] for _, _, v in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{c[1]:02x}" for c in cs), sum(c[0] for c in cs), label) for (i, label, _), cs in zip(kept, assign())]
    by_label = defaultdict(int)
    for _, _, e, label in out:
        by_label[label] += e
    fits = lambda e: e if e < 2**63 else None
    return sorted((str(i), c, fits(e), fits(by_label[label]), digest) for i, c, e, label in out)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, block long"


@pytest.mark.parametrize("kind", ["usual", "ties", "huge", "few"])
def test_vector_codes(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 40)
    r = np.random.default_rng(9)
    n = 9 if kind == "few" else 150
    x = {"usual": r.normal(size=(n, 16)), "few": r.normal(size=(n, 16)), "ties": r.integers(-2, 3, (n, 16)) / 4096, "huge": r.normal(size=(n, 16)) * 10.0 ** r.integers(-5, 30, (n, 1))}[kind]
    rows = [(i * 3, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [(-1, None, 1), (-2, [float("nan")] * 16, 1), (-3, [None] + [1.0] * 15, 1), (-4, [float("inf")] * 16, 1), (-5, [], 1), (None, [0.25] * 16, 1), (6, [0.5] * 16, 2), (6, [0.5] * 16, 2)]
    table = spark.createDataFrame([(*row, "x", 5) for row in rows], SCHEMA).repartition(3)
    got = vector_codes.vector_codes(table).collect()
    assert sorted((str(g.vec_id), g.code, g.error, g.label_error, g.codebooks_sha256) for g in got) == plain_codes(rows)
    assert vector_codes.vector_codes(table.where("false")).collect() == []


def test_vectors_of_other_dimensions_are_dropped(spark):
    rows = [(i, [float(i), 1.0] * 8, 0, "x", 1) for i in range(20)] + [(30, [1.0] * 24, 0, "x", 1), (31, [1.0] * 3, 0, "x", 1), (2, [0.0] * 24, 0, "x", 1)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).select("vec_id").collect()
    assert sorted(g.vec_id for g in got) == list(range(20))


def test_exponion_search_looks_at_few():
    """Whatever the start, the entry is the nearest; from a good start most entries are never looked at."""
    r = np.random.default_rng(2)
    centres = r.integers(-4000, 4000, (3, 16, 8))
    near = r.integers(0, 16, (500, 3))
    x = np.stack([centres[p, near[:, p]] for p in range(3)], axis=1) + r.integers(-300, 300, (500, 3, 8))
    books = vector_codes.Codebooks(centres)
    far = ((x[:, :, None, :] - centres[None]) ** 2).sum(-1)
    for start in (near, np.zeros_like(near), np.full_like(near, 15)):
        code, error = books.nearest(x, start)
        assert (code == far.argmin(2)).all() and (error == far.min(2)).all()
    u = ((x - np.stack([centres[p, near[:, p]] for p in range(3)], axis=1)) ** 2).sum(-1)
    looked = np.mean([(books.apart[p, near[:, p]] <= 4 * u[:, p, None]).sum(1).mean() for p in range(3)])
    assert looked < 3


def test_rounds_shuffle_no_vectors(spark, data):
    """Blocks and codes are bucketed alike: their join has no exchange of vectors."""
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    tables = vector_codes._Bucketed(spark, 3)
    try:
        blocks = vector_codes._blocks(vector_codes._kept(vectors, 8), 64, tables)
        books = vector_codes.Codebooks(vector_codes.integers(vector_codes._first(vectors, 16)).reshape(16, 8, 8).transpose(1, 0, 2).copy())
        codes = tables.write(vector_codes._assigned(blocks, None, books, "f4"), "codes")
        plan = vector_codes._assigned(blocks, codes, books, "f4")._jdf.queryExecution().executedPlan().toString()
    finally:
        while tables.made:
            tables.drop()
    assert "Join" in plan and "hashpartitioning" not in plan


# --- 13 ----------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    r = random.Random(6)
    texts = ["", None, "a", ".", "<P>", "a <M b", "x<S>y", "\n\n", "é é ß", "日本語abc日本", "😀a😀", "a\x00b", "Zz[`{@", "word " * 20_000, "é" * 9000, "a" * 50_000, "<" * 50, "P><S" * 20]
    texts += ["".join(r.choices("ab .é日😀<>PSM", k=r.randrange(1, 300))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "null id here"), (5, "again"), (5, "again"), (-7, "minus seven")]
    got = fill_in_middle.fill_in_middle(docs_table(spark, rows)).withColumn("restored", fill_in_middle.restored()).collect()
    assert sorted(map(str, (tuple(g)[:6] for g in got))) == sorted(map(str, (plain_middle(*row) for row in rows)))
    assert all(g.restored == (t or "") for g, (_, t) in zip(sorted(got, key=lambda g: (str(g.doc_id), g.output)), sorted(rows, key=lambda x: (str(x[0]), plain_middle(*x)[5]))))
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs_table(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
def test_chunks_of_any_size_cut_alike(chunk):
    r = random.Random(chunk)
    texts = ["".join(r.choices("ab .é日😀", k=r.randrange(0, 60))) for _ in range(200)]
    h = np.array([[r.randrange(2**32) for _ in texts] for _ in range(2)])
    n, lower, upper = fill_in_middle.cut_places([t.encode() for t in texts], h[0], h[1], chunk)
    for i, t in enumerate(texts):
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted(int(x) % (len(tokens) + 1) for x in h[:, i])
        assert (n[i], lower[i], upper[i]) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b])))


def test_a_very_long_text_takes_little_memory():
    text = ("some words é " * 2_000_000).encode()
    tracemalloc.start()
    n, lower, upper = fill_in_middle.cut_places([text], np.array([123_456_789]), np.array([3]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n[0] == 12_000_000 and lower[0] <= upper[0]
    assert peak < 3 * len(text) + 60_000_000


def test_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns"):
        fill_in_middle.fill_in_middle(spark.range(1).withColumn("text", F.lit("a")))
