"""Fill-in-the-middle texts: two cuts at drawn token ranks, the parts put in another order behind marks.

A token is a run of letters A-Z, a-z or any other single character. Whether one starts at a byte of the
UTF-8 text depends on that byte and the one before alone: it is no continuation byte, and not both are
letters. So a text is decomposed into chunks that overlap by one byte, wherever they fall, and the tokens
and characters that start in each chunk are counted on their own. Prefix sums over a text's chunks say
which chunk owns the token at a rank; only that chunk is read again, for the place inside.

The counts of a batch of rows are taken together, some megabytes at a time, so memory is bounded but for
the texts themselves. One scan, no shuffle: marks, order and the way back are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

#: Bytes of a chunk, and chunks that are counted at a time.
CHUNK, AT_ONCE = 4096, 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: Stands between two texts of a batch: no letter, and nothing starts at it.
_BREAK = b"\x80"


def starts(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens and where characters start in all bytes of ``piece`` but the first, which is the overlap."""
    character = (piece[1:] & 0xC0) != 0x80
    letter = _LETTER[piece]
    return character & ~(letter[1:] & letter[:-1]), character


def count_chunks(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and characters that start in each chunk ``data[begin:end]``; chunks are in order and not empty."""
    tokens, characters = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    for lo in range(0, len(begin), AT_ONCE):
        hi = min(lo + AT_ONCE, len(begin))
        token, character = starts(data[begin[lo] - 1 : end[hi - 1]])
        at = begin[lo:hi] - begin[lo]
        tokens[lo:hi] = np.add.reduceat(token, at, dtype=np.int64)
        characters[lo:hi] = np.add.reduceat(character, at, dtype=np.int64)
    return tokens, characters


def cut_places(texts: list[bytes], h1: np.ndarray, h2: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of tokens, and the characters before its lower and its upper cut.

    The cuts have the ranks ``h1`` and ``h2`` modulo the number of tokens and one.
    """
    data = np.frombuffer(_BREAK + _BREAK.join(texts), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(length + 1) - length
    chunks = -(-length // chunk)
    owner = np.repeat(np.arange(len(texts)), chunks)
    last = np.cumsum(chunks)
    begin = first[owner] + chunk * (np.arange(len(owner)) - (last - chunks)[owner])
    end = np.minimum(begin + chunk, (first + length)[owner])
    tokens, characters = (np.concatenate([[0], np.cumsum(c)]) for c in count_chunks(data, begin, end))
    low, high = tokens[last - chunks], tokens[last]
    n = high - low
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    before = np.empty((2, len(texts)), np.int64)
    for which, i in np.ndindex(before.shape):
        rank = low[i] + ranks[which, i]
        if rank == high[i]:
            place, inside = last[i], 0
        else:
            place = np.searchsorted(tokens, rank, "right") - 1
            token, character = starts(data[begin[place] - 1 : end[place]])
            inside = np.count_nonzero(character[: np.flatnonzero(token)[rank - tokens[place]]])
        before[which, i] = characters[place] + inside - characters[last[i] - chunks[i]]
    return n, before[0], before[1]


def _cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    n, lower, upper = cut_places(list(text), h1.to_numpy(), h2.to_numpy())
    return pd.DataFrame({"n": n, "lower": lower, "upper": upper})


def _draw(which: int) -> Column:
    """The numbers h1 to h4 of a document: 8 hexadecimal digits each of the hash of ``1:`` and its doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs (doc_id, text)``.

    ``form`` says what ``output`` is: ``plain`` (the text; lengths are null), ``psm`` or ``spm``. Texts that
    are empty, null (like empty) or hold a mark are plain, and ``plain_percent`` of the others. Draws depend
    on the doc_id alone: rows that repeat one draw alike, a null one is hashed as empty. Both cuts may fall on
    the same place, at the start or at the end. Texts may be of any length, other columns are passed over,
    and an empty table gives an empty result.
    """
    rows = need(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (_draw(3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_draw(4) % 100 < spm_percent, "spm").otherwise("psm")
    cut_udf = F.pandas_udf(_cut, "n long, lower long, upper long")
    cut = rows.withColumn("cut", cut_udf(F.col("text").cast("binary"), _draw(1), _draw(2))).withColumn("form", form)
    lower, upper = F.col("cut.lower").cast("int"), F.col("cut.upper").cast("int")
    prefix = F.substring("text", F.lit(1), lower)
    middle = F.substring("text", lower + 1, upper - lower)
    suffix = F.substring("text", upper + 1, F.length("text"))
    is_plain = F.col("form") == "plain"
    return cut.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(~is_plain, F.col("cut.lower")).alias("prefix_chars"),
        F.when(~is_plain, F.col("cut.upper") - F.col("cut.lower")).alias("middle_chars"),
        F.when(is_plain, F.col("text"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of :func:`fill_in_middle` was made of; marks occur once each there, and nowhere else."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
        .when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
    )


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` of :func:`fill_in_middle`."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    )


ORACLE = """
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS r2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM split),
parts AS (
  SELECT *, coalesce(array_to_string(tokens[1:least(r1, r2)], ''), '') AS p, coalesce(array_to_string(tokens[least(r1, r2) + 1:greatest(r1, r2)], ''), '') AS m,
    coalesce(array_to_string(tokens[greatest(r1, r2) + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
