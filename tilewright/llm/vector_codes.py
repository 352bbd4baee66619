"""Vector code compression: product codes of integer parts, entries found by exponion search.

Components become integers, vectors are cut into equal parts, and each part position has a codebook whose
entries are moved to the (floored) means of their parts for some rounds. To find a part's nearest entry the
search starts at the entry it had before, at the squared distance u. By the triangle inequality an entry
further from that one than twice the part is cannot be nearer, so only the neighbours within 4u, squared, are
looked at, in the order of a list sorted once a round; at the radius itself they may tie and are looked at
too. All distances are exact integers and ties go to the lower index, so the result is that of looking at
every entry.

Vectors are written once as blocks, in a table bucketed by block. Each round joins it with the codes of the
round before, bucketed alike, so that nothing is shuffled; it writes codes of a byte a part and, for each block,
sums and counts by entry. Codebooks are the only thing the driver holds: 16 entries a part.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_files, join_counted, materialize, need, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block; and of a bucket, at most, which one task reads.
BLOCK, BUCKET = 8192, 1 << 18
#: Sums travel in limbs of so many bits, so that no sum of sums overflows.
_LIMB = 32


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, as 64-bit integers where their squared distances fit them too, else as Python's own."""
    y = np.floor(x.astype(float) * SCALE)
    if np.abs(y).max(initial=0) < 2**24:
        return y.astype(np.int64)
    exact = [math.floor(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in x.astype(float).ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


class Codebooks:
    """Entries ``(part, entry, component)``, and of each entry the others in order of their distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        self.order = np.argsort(apart, axis=2, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=2)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part of ``x (vector, part, component)``; ``start`` is the entry it had before."""
        parts = np.broadcast_to(np.arange(x.shape[1]), start.shape).ravel()
        rows, begin = x.reshape(-1, x.shape[2]), start.ravel().astype(np.int64)
        u = ((rows - self.entries[parts, begin]) ** 2).sum(1)
        best, index = u.copy(), begin.copy()
        live = np.arange(len(rows))
        for k in range(self.entries.shape[1]):
            live = live[(self.apart[parts[live], begin[live], k] <= 4 * u[live]).astype(bool)]
            if not len(live):
                break
            entry = self.order[parts[live], begin[live], k]
            d = ((rows[live] - self.entries[parts[live], entry]) ** 2).sum(1)
            better = ((d < best[live]) | ((d == best[live]) & (entry < index[live]))).astype(bool)
            best[live[better]], index[live[better]] = d[better], entry[better]
        return index.reshape(start.shape), best.reshape(start.shape)

    def sums(self, x: np.ndarray, codes: np.ndarray) -> tuple[list[int], list[int]]:
        """Counts by (part, entry), and sums by (limb, part, entry, component), both flat."""
        parts, entries, width = self.entries.shape
        cell = (codes + entries * np.arange(parts)).ravel()
        total = np.zeros((parts * entries, width), x.dtype)
        np.add.at(total, cell, x.reshape(-1, width))
        limbs = []
        while len(limbs) < 2 or ((total != 0) & (total != -1)).any():
            limbs.append((total & ((1 << _LIMB) - 1)).astype(np.int64))
            total = total >> _LIMB
        limbs[-1] += total.astype(np.int64) << _LIMB  # 0 or -1: the sign
        return np.bincount(cell, minlength=parts * entries).tolist(), np.stack(limbs).ravel().tolist()

    def moved(self, counts: np.ndarray, sums: list[int]) -> Codebooks:
        """Entries at the floored means of their parts; those without any stay."""
        new = self.entries.astype(object)
        flat = new.reshape(-1, new.shape[2])
        total = np.array(sums, object).reshape(flat.shape)
        for i in np.flatnonzero(counts):
            flat[i] = total[i] // int(counts[i])
        return Codebooks(_fitting(new))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _fitting(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if all(abs(v) < 2**24 for v in x.ravel().tolist()) else x.astype(object)


def _alike(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, Codebooks]:
    """Both as 64-bit integers, or both as Python's own where one needs them."""
    if x.dtype == books.entries.dtype:
        return x, books
    return x.astype(object), Codebooks(books.entries.astype(object))


def _kept(vectors: DataFrame, parts: int) -> DataFrame:
    """Rows whose vector has only finite components, of a number that can be cut into ``parts``."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    return need(vectors, ["vec_id", "label", "embedding"]).where(F.col("embedding").isNotNull() & fits & ~odd)


def _first(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest vec_ids."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    some = [r[0] for r in kept.orderBy(*order).limit(entries).select("embedding").collect()]
    if len({len(v) for v in some}) > 1:
        some = [r[0] for r in kept.where(F.size("embedding") == len(some[0])).orderBy(*order).limit(entries).select("embedding").collect()]
    return np.array(some, float)


class _Bucketed:
    """Tables bucketed by block in the shared folder, which join each other without a shuffle."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.made = spark, buckets, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table, path = f"tilewright_{uuid.uuid4().hex}", scratch_path(self.spark, name)
        self.made.append((table, path))
        df.write.bucketBy(self.buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, at: int = -1) -> None:
        table, path = self.made.pop(at)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_files(self.spark, path)


def _blocks(kept: DataFrame, width: int, tables: _Bucketed) -> DataFrame:
    """``(block, vec_ids, labels, x)`` with up to ``BLOCK`` vectors a row; ``x`` holds them as they came."""
    kind = np.dtype(np.float32 if kept.schema["embedding"].dataType.elementType.simpleString() == "float" else float)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= BLOCK:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        x = b"".join(np.asarray(v, kind).tobytes() for f in held for v in f["embedding"])
        ids, labels = ([v for f in held for v in f[c]] for c in ("vec_id", "label"))
        return pd.DataFrame({"vec_ids": [ids], "labels": [labels], "x": [x]})

    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    # Ids and labels pass as text: pandas would make numbers of them that cannot be null.
    text = kept.where(F.size("embedding") == width).select(F.col("vec_id").cast("string"), F.col("label").cast("string"), "embedding")
    rows = text.mapInPandas(each, "vec_ids array<string>, labels array<string>, x binary")
    typed = rows.select(F.monotonically_increasing_id().alias("block"), F.col("vec_ids").cast(f"array<{ids}>"), F.col("labels").cast(f"array<{labels}>"), "x")
    return tables.write(typed.repartition(tables.buckets, "block"), "vector-blocks")


def _vectors(x: bytes, parts: int, width: int, kind: str) -> np.ndarray:
    return integers(np.frombuffer(x, kind)).reshape(-1, parts, width // parts)


def _assigned(blocks: DataFrame, codes: DataFrame | None, books: Codebooks, kind: str) -> DataFrame:
    """``(block, codes, counts, sums)`` of every block; ``codes`` are those of the round before, None at first."""
    parts, width = books.entries.shape[0], books.entries.shape[0] * books.entries.shape[2]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for number, x, before in zip(f["block"], f["x"], f["codes"]):
                x, own = _alike(_vectors(x, parts, width, kind), books)
                start = np.frombuffer(before, np.uint8).reshape(-1, parts) if before else np.zeros(x.shape[:2], np.uint8)
                now, _ = own.nearest(x, start)
                counts, sums = own.sums(x, now)
                yield pd.DataFrame({"block": [number], "codes": [now.astype(np.uint8).tobytes()], "counts": [counts], "sums": [sums]})

    return _with_codes(blocks.select("block", "x"), codes).mapInPandas(each, "block long, codes binary, counts array<long>, sums array<long>")


def _with_codes(blocks: DataFrame, codes: DataFrame | None) -> DataFrame:
    if codes is None:
        return blocks.withColumn("codes", F.lit(None).cast("binary"))
    return blocks.join(codes.select("block", "codes").hint("shuffle_hash"), "block")


def _totals(assigned: DataFrame, of: str) -> dict[int, int]:
    """Sums over all blocks by place in the array: as many numbers as codebooks have, times the limbs."""
    each = assigned.select(F.posexplode(of).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return {r.at: r.v for r in each.collect()}


def _next(books: Codebooks, assigned: DataFrame) -> Codebooks:
    counts = _totals(assigned, "counts")
    size, sums = books.entries.size, _totals(assigned, "sums")
    whole = [sum(sums.get(limb * size + i, 0) << (_LIMB * limb) for limb in range(-(-len(sums) // size))) for i in range(size)]
    return books.moved(np.array([counts[i] for i in range(len(counts))]), whole)


def _coded(blocks: DataFrame, codes: DataFrame | None, books: Codebooks, kind: str) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector."""
    parts, width = books.entries.shape[0], books.entries.shape[0] * books.entries.shape[2]

    @F.pandas_udf("array<struct<code: string, error: long>>")
    def coded(x: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for v, b in zip(x, before):
            v, own = _alike(_vectors(v, parts, width, kind), books)
            now, error = own.nearest(v, np.frombuffer(b, np.uint8).reshape(-1, parts) if b else np.zeros(v.shape[:2], np.uint8))
            names = [r.tobytes().hex() for r in now.astype(np.uint8)]
            out.append([{"code": c, "error": int(e) if e < 2**63 else None} for c, e in zip(names, error.sum(1))])
        return pd.Series(out)

    rows = _with_codes(blocks, codes).select("vec_ids", "labels", coded("x", "codes").alias("coded"))
    each = rows.select(F.explode(F.arrays_zip("vec_ids", "labels", "coded")).alias("r"))
    return each.select(F.col("r.vec_ids").alias("vec_id"), F.col("r.labels").alias("label"), "r.coded.code", "r.coded.error")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of ``vectors (vec_id, embedding, label)``.

    Codebooks start as the parts of the vectors of the smallest vec_ids (of rows that repeat one, all in
    the order of their vectors; a null one comes last) and have fewer entries where the table has fewer
    vectors. Rows whose vector is null or empty or holds a null or a component that is not finite are dropped, and so
    are those of another dimension than the first vector's, or of one that cannot be cut into ``parts``. Components
    may be of any size: sums and distances are exact, an error beyond a long is null and makes its label's
    null. ``label_error`` is summed over rows of equal label, nulls together. Other columns are
    passed over; an empty table gives an empty result. There are at most 256 entries.
    """
    spark, kept = vectors.sparkSession, _kept(vectors, parts)
    seeds = _first(kept, entries)
    if not len(seeds):
        nothing = F.lit(None).cast("string")
        return kept.select("vec_id", nothing.alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), nothing.alias("codebooks_sha256")).limit(0)
    width = seeds.shape[1]
    books = Codebooks(np.ascontiguousarray(integers(seeds).reshape(len(seeds), parts, -1).transpose(1, 0, 2)))
    rows, busy = vectors.count(), 2 * spark.sparkContext.defaultParallelism
    tables = _Bucketed(spark, max(-(-rows // BUCKET), min(busy, -(-rows // (BLOCK // 2)))))
    try:
        blocks = _blocks(kept, width, tables)
        kind = "f4" if kept.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
        codes = None
        for _ in range(rounds):
            before, codes = codes, tables.write(_assigned(blocks, codes, books, kind), "vector-codes")
            books = _next(books, codes)
            if before is not None:
                tables.drop(1)
        coded = materialize(_coded(blocks, codes, books, kind), "coded-vectors")
    finally:
        while tables.made:
            tables.drop()
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = coded.withColumn("key", label)
    exact = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_cast(sum(cast(error as decimal(20, 0))) as bigint)"))
    by_label = materialize(coded.groupBy("key").agg(exact.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    return join_counted(coded, by_label, "key", "n").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """One common table a round for the entries each part goes to, and one for the entries moved."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + entry) AS m
  FROM parts x JOIN b{r} b USING (part) GROUP BY vec_id, part)"""
        )
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(moved.v, old.v) AS v FROM b{r} old LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS v FROM (
      SELECT part, entry, i, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean FROM (
        SELECT part, m % 16 AS entry, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{r} JOIN parts USING (vec_id, part))
      GROUP BY part, entry, i) GROUP BY part, entry) moved USING (part, entry))"""
            )
    return f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, list_transform(embedding[part * (len(embedding) // 8) + 1 : (part + 1) * (len(embedding) // 8)],
    lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept, range(8) p(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLE = _oracle()
