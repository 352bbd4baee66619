"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are word unigrams and bigrams hashed to ``2**BITS`` places (a word that repeats the one
before it is also counted under one common place), with logarithmic counts scaled to length one. A
score is a sparse dot product and a sigmoid. Training takes a bounded sample of labelled rows and
runs in one task; the model is at most ``2**BITS`` weights, of which the L1 term leaves few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, need

BITS = 18
SAMPLE = 10_000  # labelled rows that training uses at most, chosen by a hash of doc_id
_WORDS = re.compile(r"\w+|[^\w\s]+")
_TEXT_AT_ONCE = 1 << 20
_REPEAT = np.uint64(0x5DEECE66D1CE4E5B)


@lru_cache(maxsize=100_000)
def _word(w: str) -> int:
    return xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the whole text; no words give none. Long texts are taken a part at a time."""
    text = text or ""
    seen: list[np.ndarray] = []
    count: list[np.ndarray] = []
    at, last = 0, None
    while at < len(text):
        end = min(len(text), at + _TEXT_AT_ONCE)
        while end < len(text) and not text[end].isspace():
            end += 1
        h = np.fromiter(map(_word, _WORDS.findall(text, at, end)), np.uint64)
        at = end
        if not len(h):
            continue
        both = h if last is None else np.concatenate([last, h])
        pairs = (both[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (both[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (both[1:] >> np.uint64(31))
        same = np.full(int((both[:-1] == both[1:]).sum()), _REPEAT)
        last = h[-1:]
        i, c = np.unique(np.concatenate([h, pairs * np.uint64(0xD6E8FEB86659FD93), same]) >> np.uint64(64 - bits), return_counts=True)
        seen.append(i), count.append(c)
    if not seen:
        return np.empty(0, np.int64), np.empty(0)
    i, c = seen[0], count[0].astype(float)
    if len(seen) > 1:
        i, inverse = np.unique(np.concatenate(seen), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(count))
    v = np.log1p(c)
    return i.astype(np.int64), v / np.sqrt(v @ v)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        i, v = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[i] @ v + self.bias, -35, 35))))


def train(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], passes: int = 1, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal over (places, values, label); the bias is one more coordinate, not regularised by L1."""
    rows = list(rows) if passes > 1 else rows
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0

    def lazy(z_, n_):
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((beta + np.sqrt(n_)) / alpha + l2))

    for _ in range(passes):
        for i, v, y in rows:
            zi, ni, v = z[i], n[i], v.astype(float)
            w = lazy(zi, ni)
            b = -bz / ((beta + np.sqrt(bn)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w @ v + b, -35, 35)))
            g = (p - y) * v
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
            d = p - y
            bz += d - (np.sqrt(bn + d * d) - np.sqrt(bn)) / alpha * b
            bn += d * d
    return Model(lazy(z, n), float(-bz / ((beta + np.sqrt(bn)) / alpha + l2)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = 6) -> Model:
    """Train on at most ``sample`` labelled rows outside the held-out fifth, chosen by a hash of doc_id.

    Null labels and doc_ids are left out; a document labelled more than once has its highest label.
    Without labelled rows the model scores one half.
    """
    chosen = (
        need(labels, ["doc_id", "quality"]).where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = need(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [features(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "places": [i.astype(np.int32) for i, _ in made], "vals": [v.astype(np.float32) for _, v in made]})

    made = rows.mapInPandas(lean(each), "doc_id long, y int, places array<int>, vals array<float>")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream():
            for f in frames:
                yield from zip(f["places"], f["vals"], f["y"])

        model = train(stream(), passes)
        at = np.flatnonzero(model.weights)
        yield pd.DataFrame({"place": np.append(at, -1), "weight": np.append(model.weights[at], model.bias)})

    order = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    weights = order.mapInPandas(lean(learn), "place long, weight double").toPandas()  # at most 2**BITS + 1 rows
    model = Model(np.zeros(1 << BITS), 0.0)
    for place, weight in zip(weights["place"], weights["weight"]):
        if place < 0:
            model.bias = float(weight)
        else:
            model.weights[place] = weight
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id) of every row and its score as ``name``; null and empty texts have the bias's score.

    The score is a function of the text alone. Repeated rows stay; an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    at = np.flatnonzero(model.weights).astype(np.int32)
    sent = spark.sparkContext.broadcast((at, model.weights[at].astype(np.float32), model.bias))

    @F.pandas_udf("double")
    @lean
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, bias = sent.value
        own = Model(np.zeros(1 << BITS), bias)
        own.weights[at] = w
        for t in texts:
            yield pd.Series([own.score(x) for x in t], dtype="float64")

    return need(docs, list(dict.fromkeys([*keep, "text"]))).select(*keep, scored("text").alias(name))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scores = score(docs, fit(docs, labels))
    return scores.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
