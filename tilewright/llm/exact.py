"""Exact deduplication by recipes of content-defined chunks.

A text, its white space made single spaces, is cut where a rolling hash of the 32 bytes before says so, so
equal passages of different texts are mostly cut alike. Every chunk gets a name, a hash of its bytes, and
a text becomes the ordered list of its chunks' names: its recipe. The chunks' bytes move once, each
different one once a map task (a text that a third of all rows hold costs no more than that), to verify
that a name stands for one content. Names that do not are told apart by the contents' order. After that
only recipes move: texts are equal exactly if their lists of verified identifiers are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, join_ids, materialize, need, row_key

#: Bytes of a name; and of a chunk, at least, at most and (as a power of two) on average beyond the least.
NAME, LEAST, MOST, AVERAGE_BITS = 16, 512, 16384, 11
#: Bytes the rolling hash sees, and bytes of a text that are hashed at a time.
WINDOW, AT_ONCE = 32, 1 << 20
_GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)


def one_spaced(text: bytes) -> bytes:
    """Runs of white space made one space; split() of bytes knows the same six bytes as white space."""
    inner = b" ".join(text.split())
    if not inner:
        return b" " if text else b""
    return b" " * text[:1].isspace() + inner + b" " * text[-1:].isspace()


def _likely(data: np.ndarray) -> Iterator[int]:
    """Places after which the rolling hash of the last bytes begins with zeros."""
    for lo in range(0, len(data), AT_ONCE):
        back = min(lo, WINDOW - 1)
        h = _GEAR[data[lo - back : lo + AT_ONCE]]
        for shift in (1, 2, 4, 8, 16):
            h[shift:] += h[:-shift] << np.uint32(shift)
        yield from (lo + 1 + np.flatnonzero(h[back:] >> np.uint32(32 - AVERAGE_BITS) == 0)).tolist()


def chunks(text: bytes) -> list[bytes]:
    """The text cut by content; no chunk is empty or longer than ``MOST``."""
    if len(text) <= LEAST:
        return [text] if text else []
    out, last = [], 0
    for at in _likely(np.frombuffer(text, np.uint8)):
        while at - last > MOST:
            out.append(text[last : last + MOST])
            last += MOST
        if at - last >= LEAST:
            out.append(text[last:at])
            last = at
    return out + [text[lo : lo + MOST] for lo in range(last, len(text), MOST)]


def recipes(docs: DataFrame, name_bytes: int = NAME) -> DataFrame:
    """``(row, doc_id, key, text_sha256, names, chunks)`` of each row of ``docs``, written; ``row`` numbers the rows."""

    @F.pandas_udf("text_sha256 string, names array<binary>, chunks array<binary>")
    def cut(text: pd.Series) -> pd.DataFrame:
        texts = [one_spaced(t) for t in text]
        parts = [chunks(t) for t in texts]
        names = [[xxhash.xxh3_128_digest(c)[:name_bytes] for c in cs] for cs in parts]
        return pd.DataFrame({"text_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "names": names, "chunks": parts})

    rows = need(docs, ["doc_id", "text"])
    rows = rows.select("doc_id", _key(rows).alias("key"), cut(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("cut"))
    return materialize(rows.select("doc_id", "key", "cut.*", F.monotonically_increasing_id().alias("row")), "recipes")


def _key(df: DataFrame) -> Column:
    return F.struct(*row_key(df))


def _entries(table: DataFrame) -> DataFrame:
    return table.select("row", F.posexplode(F.arrays_zip("names", "chunks")).alias("at", "c")).select("row", "at", F.col("c.names").alias("name"), F.col("c.chunks").alias("chunk"))


def verified(table: DataFrame) -> DataFrame:
    """``(row, doc_id, key, text_sha256, ids)``: the recipes with an identifier for each chunk that no other content has.

    It is the name where that has one content, as is to be expected of all; else the name and the
    content's rank among those of the name.
    """
    known = [F.col(c) for c in ("row", "doc_id", "key", "text_sha256")]
    contents = _entries(table).select("name", "chunk").distinct()
    shared = materialize(contents.groupBy("name").count().where("count > 1").select("name"), "shared-names")
    if shared.isEmpty():
        return table.select(*known, F.col("names").alias("ids"))
    apart = join_ids(_entries(table), shared, "name", "left_semi").select("name", "chunk").distinct()
    ranked = apart.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("chunk")))
    named = _entries(table).join(ranked, ["name", "chunk"], "left")
    one = F.when(F.col("rank").isNull(), F.col("name")).otherwise(F.concat("name", F.unhex(F.lpad(F.hex("rank"), 16, "0"))))
    lists = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", one.alias("id")))).alias("ids")).select("row", F.col("ids.id").alias("ids"))
    empty = F.array().cast("array<binary>")
    return materialize(table.select(*known).join(lists, "row", "left").withColumn("ids", F.coalesce("ids", empty)), "verified-recipes")


def _members(docs: DataFrame, name_bytes: int) -> DataFrame:
    rows = verified(recipes(docs, name_bytes))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = materialize(rows.groupBy("ids").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "equal-recipes")
    return join_counted(rows, groups, "ids", "group_size").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "key"
    )


def exact_duplicates(docs: DataFrame, name_bytes: int = NAME) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs (doc_id, text)``.

    Texts are equal when they are identical after each run of white space is made one space; a null text
    is an empty one. Of a group's rows the one with the smallest doc_id is kept, of rows that repeat it any
    one; a null doc_id comes last, so ``keep_id`` is null only where all of the group are. Other columns are
    passed over; an empty table gives an empty result.
    """
    return _members(docs, name_bytes).drop("key")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, without those whose text an earlier doc_id has; of repeated rows one stays."""
    members = materialize(_members(docs, NAME).select("doc_id", "key", "kept"), "members")
    stays = members.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("kept")
    out = join_ids(docs, stays.select("key"), "key", "left_semi", _key(docs))
    repeated = stays.where("n > 1").select("key")
    if repeated.isEmpty():
        return out
    one = join_ids(out, repeated, "key", "left_semi", _key(out)).dropDuplicates(["doc_id", "text"])
    return join_ids(out, repeated, "key", "left_anti", _key(out)).unionByName(one)


ORACLE = """
WITH one_spaced AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM one_spaced GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM one_spaced JOIN grouped USING (t)
"""
