"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A first pass over all documents counts the benchmark's words, so that every two- and three-word
sequence of a test item gets its probability by chance. Rare sequences are seeds (and, whatever
their probability, the rarest few of each item). A second pass cuts *passages* out of the documents, the
words around places that may hold a seed, and a join on the seeds' hashes brings each passage together
with the items whose seeds it has. There the item is aligned with the passage. The score is the best local
alignment's, divided by what the item scores against itself, so replaced, added and left-out words
lower it little by little.

Both passes are scans whatever the benchmark's size: what goes to the tasks is a bit map of bounded size
that tells which hashes may be wanted, and only passages are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_ids, lean, materialize, need, row_key

_WORDS = re.compile(r"\w+")
_TEXT_AT_ONCE = 1 << 20
#: What an ASCII character is to words: itself in lower case, or a space.
_ASCII = {i: c.lower() if _WORDS.match(c) else " " for i, c in enumerate(map(chr, range(128)))}
#: A seed's probability by chance at most, and how many of its rarest sequences an item has as seeds anyway.
RARE, LEAST_SEEDS = 1e-8, 8
#: Alignment: match, mismatch, gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a bit map at most (16 MB), bits for each hash in it where there is room, and where a hash's bits are taken from.
MAP_BITS, BITS_EACH, SHIFTS = 1 << 27, 64, (0, 19, 37)
#: Characters of a benchmark whose items are broadcast to the passages; those of a larger one are joined by shuffle.
SMALL_BENCHMARK = 8_000_000
#: Cells of an alignment matrix row that are computed at a time.
_CELLS = 200_000


def words(text: str | None) -> list[str]:
    text = text or ""
    return text.translate(_ASCII).split() if text.isascii() else _WORDS.findall(text.lower())


class _Hashes(dict):
    """Hashes of words, remembered up to a number."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


_hash_of = _Hashes().__getitem__


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word of the whole text, a part of a long text at a time."""
    text, at, out = text or "", 0, []
    while at < len(text):
        end = min(len(text), at + _TEXT_AT_ONCE)
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append(np.fromiter(map(_hash_of, words(text[at:end])), np.uint64))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([*out, np.empty(0, np.uint64)])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for t in range(n):
        out = (out ^ h[t : t + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class BitMap:
    """Which hashes may be in a set: a few bits for each hash, in a number of bits that is bounded.

    With room for all, one in some ten thousand other hashes passes; with less, more do, and are joined in vain.
    """

    def __init__(self, words_: np.ndarray):
        self.words = words_

    @classmethod
    def of(cls, hashes: DataFrame, column: str) -> Broadcast:
        """Broadcast map of a column; what comes to the driver is its words, 2**21 rows at most."""
        bits = 1 << 10
        while bits < min(MAP_BITS, BITS_EACH * hashes.count()):
            bits *= 2
        places = F.array(*[F.shiftrightunsigned(column, n).bitwiseAND(F.lit(bits - 1)) for n in SHIFTS])
        rows = hashes.select(F.explode(places).alias("place"))
        words_ = rows.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow()
        out = np.zeros(bits // 64, np.int64)
        out[words_["at"].to_numpy()] = words_["bits"].to_numpy()
        return hashes.sparkSession.sparkContext.broadcast(cls(out.view(np.uint64)))

    def may_have(self, h: np.ndarray) -> np.ndarray:
        found = np.arange(len(h))
        for n in SHIFTS:
            at = h[found] >> np.uint64(n) & np.uint64(64 * len(self.words) - 1)
            found = found[(self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        out = np.zeros(len(h), bool)
        out[found] = True
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, words)`` of the items that have words; repeated rows count once."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item": f["item"], "item_id": f["item_id"].astype("Int64"), "words": pd.Series([word_hashes(t).view(np.int64) for t in f["text"]], dtype=object, index=f.index)})

    rows = need(benchmark, ["item_id", "text"]).select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    return materialize(rows.mapInPandas(lean(each), "item long, item_id long, words array<long>").where("size(words) > 0"), "items")


def _word_counts(docs: DataFrame, wanted: Broadcast) -> DataFrame:
    """``(word, n)`` over all documents, of the words that the map may have; the null word's n is that of all words."""

    def summed(held: list[np.ndarray], total: int) -> pd.DataFrame:
        h = np.concatenate([*held, np.empty(0, np.uint64)])
        at, n = np.unique(h[wanted.value.may_have(h)], return_counts=True)
        return pd.DataFrame({"word": pd.array([*at.view(np.int64).tolist(), None], "Int64"), "n": np.append(n, total)})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for f in frames:
            for t in f["text"]:
                held.append(word_hashes(t))
                total += len(held[-1])
                if total > 1_000_000:
                    yield summed(held, total)
                    held, total = [], 0
        yield summed(held, total)

    return docs.select("text").mapInPandas(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _seeds(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``(gram, item, place)``: the rare sequences of each item."""
    own = items.select("item", F.posexplode("words").alias("place", "word"))
    vocabulary = own.select("word").distinct()
    counts = materialize(_word_counts(docs, BitMap.of(vocabulary, "word")), "word-counts")
    size = vocabulary.count()
    total = counts.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = (
        own.join(counts.where("word IS NOT NULL"), "word", "left")
        .groupBy("item")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))  # the words of one item
    )

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for item, w in zip(f["item"], f["w"]):
                h = np.array([x["word"] for x in w], np.int64).view(np.uint64)
                chance = np.log((np.array([x["n"] for x in w], float) + 1) / (total + size + 1))
                found = []
                for n in (2, 3) if len(h) > 1 else (1,):
                    code = grams(h, n).view(np.int64)
                    by_chance = sum(chance[t : t + len(code)] for t in range(n))
                    found += zip(by_chance.tolist(), [n] * len(code), code.tolist(), range(len(code)))
                found.sort()
                out += [(code, item, at) for rank, (p, _, code, at) in enumerate(found) if rank < LEAST_SEEDS or p <= np.log(RARE)]
            yield pd.DataFrame(out, columns=["gram", "item", "place"])

    return materialize(listed.mapInPandas(lean(choose), "gram long, item long, place int"), "seeds")


def _passages(docs: DataFrame, wanted: Broadcast, reach: int) -> DataFrame:
    """``(doc, mark, start, doc_id, words, hits, copies)``: the words up to ``reach`` around places that may hold a seed.

    Passages that touch are one. Rows that are equal have theirs once, with how many there are.
    """

    def cut(h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """Some texts' words in a row: (from, to, [(gram, place)])."""
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        places, codes = [], []
        for n in (1, 2, 3):
            code = grams(h, n)
            at = np.flatnonzero(wanted.value.may_have(code) & (doc[: len(code)] == doc[n - 1 :]))
            places.append(at), codes.append(code[at].view(np.int64))
        place, code = np.concatenate(places), np.concatenate(codes)
        order = np.argsort(place, kind="stable")
        place, code = place[order], code[order]
        if not len(place):
            return
        own = doc[place]
        new = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (place[1:] - place[:-1] > 2 * reach)) + 1, [len(place)]])
        for a, b in zip(new, new[1:]):
            lo = max(int(place[a]) - reach, int(ends[own[a] - 1]) if own[a] else 0)
            hi = min(int(place[b - 1]) + reach, int(ends[own[a]]))
            yield int(own[a]), lo, hi, [{"gram": int(g), "at": int(p)} for g, p in zip(code[a:b], place[a:b] - lo)]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, at = [], 0
            keys = list(zip(f["doc"], f["mark"], f["doc_id"].astype("Int64")))
            while at < len(f):
                held, size, first = [], 0, at
                while at < len(f) and size < _TEXT_AT_ONCE:
                    held.append(word_hashes(f["text"].iloc[at]))
                    size += 8 * len(held[-1])
                    at += 1
                h, ends = np.concatenate(held), np.cumsum([len(x) for x in held])
                for own, lo, hi, hits in cut(h, ends):
                    start = lo - (int(ends[own - 1]) if own else 0)
                    out.append((*keys[first + own], start, h[lo:hi].view(np.int64), hits))
            yield pd.DataFrame(out, columns=["doc", "mark", "doc_id", "start", "words", "hits"]).astype({"doc_id": "Int64"})

    doc, mark = row_key(docs)
    rows = docs.select(doc.alias("doc"), mark.alias("mark"), "doc_id", "text")
    made = rows.mapInPandas(lean(each), "doc long, mark long, doc_id long, start long, words array<long>, hits array<struct<gram: long, at: int>>")
    once = made.groupBy("doc", "mark", "start").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"), F.first("hits").alias("hits"), F.count(F.lit(1)).alias("copies"))
    return materialize(once, "passages")


def _smith_waterman(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of pairs: score over the item's own, and the aligned part (from, to) of the text."""
    scores, begins, stops = np.zeros(len(items)), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    width = np.array([len(t) for t in texts])
    order, at = np.lexsort(([len(i) for i in items], width)), 0
    while at < len(order):  # pairs of like size together
        end = at + 1
        while end < len(order) and (end - at) * int(width[order[end]]) < _CELLS:
            end += 1
        some = order[at:end]
        scores[some], begins[some], stops[some] = _align([texts[i] for i in some], [items[i] for i in some])
        at = end
    return scores, begins, stops


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    out[np.arange(out.shape[1]) < np.array([len(r) for r in rows])[:, None]] = np.concatenate(rows)
    return out


def _align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells hold score * 2**32 + (2**32 - 1 - first word): the larger score, then the earlier beginning, wins."""
    text, item = _padded(texts, -2), _padded(items, -3)
    sizes, width = np.array([len(i) for i in items]), text.shape[1]
    one, top = np.int64(1) << 32, (np.int64(1) << 32) - 1
    fresh = top - np.arange(width + 1)  # nothing aligned yet; the next word is the first
    before = np.broadcast_to(fresh, (len(items), width + 1)).copy()
    step = GAP * one * np.arange(width + 1)
    best, best_end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for r in range(item.shape[1]):
        live = r < sizes
        now = before.copy()
        diagonal = before[:, :-1] + np.where(text == item[:, r, None], MATCH * one, MISMATCH * one)
        now[:, 1:] = np.maximum(diagonal, before[:, 1:] + GAP * one)
        now = np.maximum(now, fresh)
        now = np.maximum.accumulate(now - step, axis=1) + step
        now = np.where(now < one, fresh, now)
        before = np.where(live[:, None], now, before)
        end = now.argmax(1)
        value = now[np.arange(len(items)), end]
        better = live & (value > best)
        best, best_end = np.where(better, value, best), np.where(better, end, best_end)
    return (best >> 32) / (MATCH * sizes), top - (best & top), best_end


def _aligned(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows of a passage, an item and the shifts of their common seeds: the best alignment, where it counts."""
    for f in frames:
        texts, items, owner, seeds, offset = [], [], [], [], []
        for row, (text, item, shifts) in enumerate(zip(f["passage"], f["words"], f["shifts"])):
            size = len(item)
            shift = np.array([s["shift"] for s in shifts], np.int64)  # where the item would begin, ascending
            many = np.array([s["n"] for s in shifts], np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(shift) > size) + 1, [len(shift)]])
            for a, b in zip(cut, cut[1:]):
                lo, hi = max(int(shift[a]) - size // 2 - 2, 0), min(int(shift[b - 1]) + size + size // 2 + 2, len(text))
                texts.append(text[lo:hi]), items.append(item), owner.append(row), seeds.append(int(many[a:b].sum())), offset.append(lo)
        scores, begins, stops = _smith_waterman(texts, items)
        out = pd.DataFrame({"row": owner, "score": scores, "first_word": begins + np.array(offset, np.int64), "n_words": stops - begins, "n_seeds": np.array(seeds, np.int64)})
        out = out[out["score"] >= least].sort_values(["row", "score", "first_word"], ascending=[True, False, True], kind="stable").drop_duplicates("row")
        own = f[["doc", "mark", "doc_id", "start", "copies", "item_id", "item"]].iloc[out["row"]].reset_index(drop=True).astype({"doc_id": "Int64", "item_id": "Int64"})
        out = pd.concat([own, out.drop(columns="row").reset_index(drop=True)], axis=1)
        out["first_word"] += out["start"]
        yield out.drop(columns="start")


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """A row for each document (``doc, mark``; equal rows once, with ``copies``) and item it holds."""
    items = _items(benchmark)
    characters = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    longest = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    seeds = _seeds(items, docs)
    passages = _passages(docs, BitMap.of(seeds, "gram"), longest + longest // 2 + 5)
    own = (lambda t: F.broadcast(t)) if characters <= SMALL_BENCHMARK else (lambda t: t)
    key = ["doc", "mark", "start"]
    hits = passages.select(*key, F.explode("hits").alias("h")).select(*key, F.col("h.gram").alias("gram"), F.col("h.at").alias("at"))
    shifts = hits.join(own(seeds), "gram").groupBy(*key, "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    pairs = shifts.groupBy(*key, "item").agg(F.array_sort(F.collect_list(F.struct("shift", "n"))).alias("shifts"))  # of one passage
    both = pairs.join(passages.select(*key, "doc_id", "copies", F.col("words").alias("passage")), key).join(own(items), "item")
    schema = "doc long, mark long, doc_id long, copies long, item_id long, item long, score double, first_word long, n_words long, n_seeds long"
    found = both.select(*key, "doc_id", "copies", "item", "item_id", "passage", "words", "shifts").mapInPandas(lean(lambda it: _aligned(it, least)), schema)
    best = F.max_by(F.struct("score", "first_word", "n_words", "n_seeds"), F.struct("score", -F.col("first_word")))
    return found.groupBy("doc", "mark", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("copies").alias("copies"), best.alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.4) -> DataFrame:
    """``(doc_id, item_id, score, first_word, n_words, n_seeds)`` of documents that hold a test item.

    ``least`` is the score from which a pair counts. Words are runs of word characters, lower-cased;
    items or documents without words (null, empty) have no rows; a document with several items has a
    row for each; repeated documents repeat their results, repeated items do not; null ids stay null;
    empty tables give an empty result. Ties between alignments of one pair go to the earliest. A pair
    that shares no seed is not found.
    """
    found = _found(need(docs, ["doc_id", "text"]), need(benchmark, ["item_id", "text"]), least)
    each = found.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return each.select("doc_id", "item_id", "b.score", "b.first_word", "b.n_words", "b.n_seeds")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item; rows and columns are otherwise as they were."""
    found = _found(need(docs, ["doc_id", "text"]), need(benchmark, ["item_id", "text"]), least)
    dirty = materialize(found.select(F.struct("doc", "mark").alias("id")), "leaks")
    return join_ids(docs, dirty, "id", "left_anti", own=_struct(docs))


def _struct(docs: DataFrame) -> Column:
    doc, mark = row_key(docs)
    return F.struct(doc.alias("doc"), mark.alias("mark"))
