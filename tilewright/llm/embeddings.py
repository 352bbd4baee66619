"""Embedding near-duplicates with randomised-rotation binary codes.

Every vector is made a unit vector, rotated by a fixed random rotation and stored as the signs of
its coordinates (its code) together with a correction factor, the inner product of the rotated
vector and its code. From a code and the factor an unbiased estimate of any inner product follows,
with a confidence bound that depends on the factor and the dimension. Pairs whose upper bound is
below the threshold are dropped; all others are computed exactly, in double precision, and only
those count.

Vectors of one label meet in cells: each goes to the cells of the ``probes`` random directions it
points along most. The number of directions grows with the label, up to a million vectors, so cells stay
small; labels of under 512 vectors have one cell, in which every pair gets its estimate. Large cells (a dense
group, or a label of many millions) are dealt out as pairs of blocks. A pair that shares several cells
counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, need
from .components import connected_components, spanning_forest

PROBES, CELL, DIRECTIONS, BLOCK = 6, 256, 4096, 2048
#: Standard deviations of the estimate's error that its bound allows for.
SURE = 4.5
_AT_ONCE = 100_000


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([7, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=4)
def directions(dim: int) -> np.ndarray:
    p = np.random.default_rng([11, dim]).normal(size=(DIRECTIONS, dim))
    return p / np.linalg.norm(p, axis=1)[:, None]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors and each one's inner product with its code."""
    y = unit @ rotation(unit.shape[1])
    signs = y >= 0
    return np.packbits(signs, axis=1), np.abs(y).sum(1) / np.sqrt(unit.shape[1])


def estimate(unit: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates (a row for each unit vector, a column for each code) and the bound of each code's error."""
    dim = unit.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    est = (unit @ rotation(dim)).astype(np.float32) @ signs.T / factors.astype(np.float32)
    return est, SURE * np.sqrt(np.maximum(1 - factors**2, 0)) / factors / np.sqrt(max(dim - 1, 1))


def build_index(vectors: DataFrame) -> DataFrame:
    """``(label, dim, vec_id, vec, code, factor)`` of every vector that can have a link."""
    schema = T.StructType([T.StructField("label", vectors.schema["label"].dataType), *T._parse_datatype_string("dim int, vec_id long, vec binary, code binary, factor double")])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vecs = [None if v is None else np.array([np.nan if x is None else x for x in v], float) for v in f["embedding"]]
            fine = np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in vecs], bool)
            for dim in sorted({len(v) for v, ok in zip(vecs, fine) if ok}):
                at = [i for i, ok in enumerate(fine) if ok and len(vecs[i]) == dim]
                x = np.stack([vecs[i] for i in at])
                code, factor = encode(_unit(x))
                yield pd.DataFrame({"label": f["label"].iloc[at].to_numpy(), "dim": dim, "vec_id": f["vec_id"].iloc[at].to_numpy(), "vec": [r.tobytes() for r in x], "code": [r.tobytes() for r in code], "factor": factor})

    rows = need(vectors, ["vec_id", "embedding", "label"]).where("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL")
    return materialize(rows.mapInPandas(each, schema).dropDuplicates(["label", "dim", "vec_id", "vec"]), "vector-index")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cells(index: DataFrame) -> DataFrame:
    """The index with one row a cell: ``cell``, and ``cells`` (all of the vector's)."""
    sizes = index.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    rows = index.join(sizes, ["label", "dim"]).withColumn("k", F.expr(f"least(greatest(1L, n div {CELL}), {DIRECTIONS})").cast("int")).drop("n")

    @F.pandas_udf("array<int>")
    def nearest(vec: pd.Series, dim: pd.Series, k: pd.Series) -> pd.Series:
        out: list = [None] * len(vec)
        for (d, count), at in pd.Series(range(len(vec))).groupby([dim.to_numpy(), k.to_numpy()]):
            p = directions(d)[:count].T
            for lo in range(0, len(at), 1024):
                some = at.to_numpy()[lo : lo + 1024]
                along = _unit(np.stack([np.frombuffer(vec.iloc[i]) for i in some])) @ p
                m = min(PROBES, count)
                top = np.sort(np.argpartition(-along, m - 1, axis=1)[:, :m], axis=1).astype(np.int32)
                for i, row in zip(some, top):
                    out[i] = row
        return pd.Series(out, dtype=object)

    return rows.withColumn("cells", nearest("vec", "dim", "k")).drop("k").withColumn("cell", F.explode("cells"))


def compare(f: pd.DataFrame, threshold: float, cell: int, whole: bool) -> pd.DataFrame:
    """Links in one block (``whole``) or between two: ``(a, null, n)`` counts and ``(a, b, 0)`` of a spanning forest."""
    f = f.sort_values(["block", "vec_id"], kind="stable")
    ids, block = f["vec_id"].to_numpy(), f["block"].to_numpy()
    dim = int(f["dim"].iloc[0])
    unit = _unit(np.frombuffer(b"".join(f["vec"])).reshape(-1, dim))
    codes = np.frombuffer(b"".join(f["code"]), np.uint8).reshape(len(f), -1)
    factor, cells = f["factor"].to_numpy(), np.stack(f["cells"].to_numpy())
    left = np.arange(len(f)) if whole else np.flatnonzero(block == block[0])
    right = left if whole else np.flatnonzero(block != block[0])
    counts = np.zeros(len(f), np.int64)
    found_a, found_b = [], []
    if len(right):
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            est, error = estimate(unit[rows], codes[right], factor[right])
            maybe = est + error.astype(np.float32) >= threshold
            if whole:
                maybe &= right[None, :] > rows[:, None]
            i, j = np.nonzero(maybe)
            # One way of summing, so that a cosine does not depend on the group.
            exact = np.concatenate([np.einsum("ij,ij->i", unit[rows[i[s : s + _AT_ONCE]]], unit[right[j[s : s + _AT_ONCE]]]) for s in range(0, len(i), _AT_ONCE)] or [np.empty(0)])
            linked = exact >= threshold
            a, b = rows[i[linked]], right[j[linked]]
            first = np.empty(len(a), bool)
            for s in range(0, len(a), _AT_ONCE):
                x, y = cells[a[s : s + _AT_ONCE]], cells[b[s : s + _AT_ONCE]]
                shared = (x[:, :, None] == y[:, None, :]).any(2)
                first[s : s + _AT_ONCE] = x[np.arange(len(x)), shared.argmax(1)] == cell
            first &= ids[a] != ids[b]
            a, b = a[first], b[first]
            counts += np.bincount(a, minlength=len(f)) + np.bincount(b, minlength=len(f))
            tree = spanning_forest(a, b, len(f))
            found_a.append(a[tree]), found_b.append(b[tree])
    some = np.flatnonzero(counts)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b))
    tree = spanning_forest(a, b, len(f))
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[some], ids[a[tree]]]),
            "b": pd.array([*[None] * len(some), *ids[b[tree]].tolist()], "Int64"),
            "n": np.concatenate([counts[some], np.zeros(len(tree), np.int64)]),
        }
    )


def link_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, n)`` of the vectors that have links, and a spanning forest ``(a, b)`` of all links."""
    cells = materialize(_cells(build_index(vectors)), "vector-cells")
    key = ["label", "dim", "cell"]
    blocks = cells.groupBy(*key).agg(F.expr(f"ceil(count(1) / {block})").cast("int").alias("blocks"))
    dealt = (
        cells.join(blocks, key)
        .withColumn("block", F.expr("pmod(xxhash64(vec_id), blocks)").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("blocks", "other")
    )
    found = materialize(
        dealt.groupBy(*key, "i", "j").applyInPandas(
            lambda k, f: compare(f, threshold, k[2], k[3] == k[4]), "a long, b long, n long"
        ),
        "vector-links",
    )
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    return counts, found.where("b IS NOT NULL").select("a", "b")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine is at least ``threshold``.
    Null or zero vectors, and vectors with null or non-finite components, link with nothing; so do
    vectors of different dimension, null vec_ids, and rows of one vec_id with each other. Rows that
    repeat a vec_id are one vector and returned as often as they occur. A null vec_id has a null
    component and is kept. An empty table gives an empty result.
    """
    counts, links = link_vectors(vectors, threshold, block)
    roots = connected_components(links).select(F.col("node").alias("vec_id"), "root")
    component = F.coalesce("root", "vec_id")
    return (
        need(vectors, ["vec_id"])
        .join(counts.join(roots, "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    )
