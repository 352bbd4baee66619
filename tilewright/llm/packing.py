"""Packing documents into sequences by cutting-stock column generation.

Documents are cut into pieces of the sequence length and one remainder. The remainders' length
histogram (at most ``capacity`` numbers, whatever the corpus) goes to the driver, where a linear
program over patterns is solved by column generation: a knapsack dynamic program prices, for the
current duals, the best pattern of every total. A pattern's cost is its padded length, so exact
fills and powers of two cost no padding. Rounded-down pattern counts are then assigned to documents
by rank within their length. What rounding leaves over, a number of pieces that the patterns bound
whatever the corpus, goes into patterns of its own, the longest first with what fills its sequence. What
only patterns with over ``WASTE`` padding would hold is laid end to end and cut at the sequence length,
the last part into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, lean, materialize, need
from .tokens import encoder, tokenizer_path

#: Leftover pieces (five numbers each) that are broadcast to fetch their ids; more are joined by shuffle.
LEFTOVERS = 200_000
#: Padding of a pattern at most, of its tokens.
WASTE = 0.01
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def padded(total: int, capacity: int) -> int:
    return total if total & (total - 1) == 0 else capacity


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-6, rounds: int = 400) -> list[tuple[dict[int, int], float]]:
    """Patterns (length -> copies) and how often the linear program uses each.

    Every length's demand is met exactly. Columns are generated until none improves, the cost is within
    ``gap`` of the tokens themselves, which no packing can beat, or ``rounds`` columns have come in: the
    patterns meet the demand after each.
    """
    lengths = np.array(sorted(n for n, c in demand.items() if c), np.int64)
    if not len(lengths):
        return []
    d = np.array([demand[int(n)] for n in lengths], float)
    columns, x, cost, inverse = _first_basis(lengths, d, capacity)
    tokens = float(lengths @ d)
    place = {int(n): i for i, n in enumerate(lengths)}
    costs = np.array([padded(t, capacity) if t else 0 for t in range(capacity + 1)], float)
    pivots = 0
    while pivots < rounds and cost @ x > tokens * (1 + gap):
        dual = cost @ inverse
        best, pick = _knapsack(lengths, dual, capacity)
        # The best fill of the whole sequence that has a given length in it, for every length, and the best of every total.
        wishes = [(best[capacity - n] + dual[i] - costs[capacity], (int(n), capacity - int(n))) for i, n in enumerate(lengths)]
        wishes += [(best[t] - costs[t], (0, t)) for t in range(1, capacity + 1)]
        wishes = sorted((w for w in wishes if w[0] > 1e-7), reverse=True)
        if not wishes:
            break
        for _, (first, rest) in wishes[:40]:
            pattern: dict[int, int] = {first: 1} if first else {}
            t = rest
            while t > 0:
                n = int(lengths[pick[t]])
                pattern[n] = pattern.get(n, 0) + 1
                t -= n
            a = np.zeros(len(lengths))
            for n, c in pattern.items():
                a[place[n]] = c
            price = costs[first + rest]
            if (cost @ inverse) @ a - price <= 1e-7:
                continue
            y = inverse @ a
            ratio = np.where(y > 1e-9, x / np.where(y > 1e-9, y, 1), np.inf)
            out = int(np.argmin(ratio))
            step = ratio[out]
            x -= step * y
            x[out] = step
            np.maximum(x, 0, out=x)
            row = inverse[out] / y[out]
            inverse -= np.outer(y, row)
            inverse[out] = row
            columns[out], cost[out] = pattern, price
            pivots += 1
    return [(p, float(v)) for p, v in zip(columns, x) if v > 0]


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """A basis whose k-th pattern uses up one length: the longest left, filled up as well as what is left allows.

    No later pattern has that length, so the columns are triangular and independent.
    """
    left = demand.copy()
    place = {int(n): i for i, n in enumerate(lengths)}
    columns: list = [None] * len(lengths)
    x = np.zeros(len(lengths))
    cost = np.zeros(len(lengths))
    matrix = np.zeros((len(lengths), len(lengths)))
    live = np.ones(len(lengths), bool)
    best = pick = own = None
    while live.any():
        if own is None:
            own = np.flatnonzero(live)
            best, pick = _knapsack(lengths[own], lengths[own].astype(float) ** 2, capacity)
        i = int(np.flatnonzero(live)[-1])
        n = int(lengths[i])
        room = capacity - n
        fits = np.flatnonzero(np.isfinite(best[: room + 1]))
        waste = [padded(n + int(r), capacity) - n - int(r) for r in fits]
        t = int(fits[int(np.argmin(waste[::-1])) * -1 - 1])
        total, pattern = n + t, {n: 1}
        while t > 0:
            m = int(lengths[own[pick[t]]])
            pattern[m] = pattern.get(m, 0) + 1
            t -= m
        if not all(live[place[m]] for m in pattern):  # the fill is of a time when a length was left that is used up
            own = None
            continue
        ratios = {m: left[place[m]] / c for m, c in pattern.items()}
        out = place[min(ratios, key=ratios.get)]
        times = ratios[int(lengths[out])]
        for m, c in pattern.items():
            left[place[m]] -= c * times
            matrix[place[m], out] = c
        columns[out], x[out], cost[out] = pattern, times, padded(total, capacity)
        live[out] = False
    return columns, x, cost, np.linalg.inv(matrix)


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most value that fills each total exactly (-inf: none does), and the piece that was added last."""
    best, pick = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    many = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for t in range(1, capacity + 1):
        if k := many[t]:
            options = best[t - lengths[:k]] + value[:k]
            pick[t] = i = int(np.argmax(options))
            best[t] = options[i]
    return best, pick


@dataclass
class Plan:
    """Slots for (length, rank): all arrays are bounded by the patterns, never by the corpus."""

    length: np.ndarray  # of each slot run, ascending
    rank: np.ndarray  # first rank of the run
    copies: np.ndarray  # slots of this length in one sequence
    sequence: np.ndarray  # first sequence of the pattern
    offset: np.ndarray  # of the first slot in a sequence
    placed: np.ndarray  # by length: how many ranks have slots
    tail: np.ndarray  # by length: where the leftovers of this length begin, end to end
    tail_sequence: int
    tail_tokens: int
    capacity: int

    def cuts(self, at: int, size: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of the leftover that lies at ``at``, end to end."""
        full = self.tail_tokens // self.capacity * self.capacity
        ends, sequences, starts, where = [], [], [], full
        rest, k = self.tail_tokens - full, self.tail_sequence + full // self.capacity
        while rest:
            part = 1 << (rest.bit_length() - 1)
            starts.append(where), ends.append(where + part), sequences.append(k)
            where, rest, k = where + part, rest - part, k + 1
        out, end = [], at + size
        while at < end:
            if at < full:
                k, offset = divmod(at, self.capacity)
                upto, k = (k + 1) * self.capacity, k + self.tail_sequence
            else:
                i = int(np.searchsorted(ends, at, "right"))
                upto, k, offset = ends[i], sequences[i], at - starts[i]
            out.append((k, offset, min(end, upto) - at))
            at = min(end, upto)
        return out


def make_plan(demand: dict[int, int], capacity: int) -> Plan:
    patterns = [({capacity: 1}, float(demand[capacity]))] if demand.get(capacity) else []
    patterns += solve_patterns({n: c for n, c in demand.items() if n < capacity and c}, capacity)
    used = np.zeros(capacity + 1, np.int64)
    runs, sequence = [], 0
    for pattern, times in patterns:
        total = sum(n * c for n, c in pattern.items())
        times = int(times + 1e-6) if padded(total, capacity) <= (1 + WASTE) * total else 0
        times = min([times, *(int((demand[n] - used[n]) // c) for n, c in pattern.items())])
        if times > 0:
            sequence = _use(pattern, times, used, runs, sequence)
    left = np.zeros(capacity + 1, np.int64)
    for n, c in demand.items():
        left[n] = c - used[n]
    for pattern in _rest_patterns(left, capacity):
        sequence = _use(pattern, 1, used, runs, sequence)
    runs.sort()
    columns = [np.array(c, np.int64) for c in zip(*runs)] if runs else [np.empty(0, np.int64)] * 5
    tail, at = np.zeros(capacity + 1, np.int64), 0
    for n in range(capacity, 0, -1):
        tail[n] = at
        at += n * int(demand.get(n, 0) - used[n])
    return Plan(*columns, used, tail, sequence, at, capacity)


def _use(pattern: dict[int, int], times: int, used: np.ndarray, runs: list[tuple], sequence: int) -> int:
    """Add the pattern's slots to ``runs``; the next free sequence."""
    offset = 0
    for n, c in sorted(pattern.items(), reverse=True):
        runs.append((n, int(used[n]), c, sequence, offset))
        used[n] += times * c
        offset += n * c
    return sequence + times


def _rest_patterns(left: np.ndarray, capacity: int) -> Iterator[dict[int, int]]:
    """Well filled patterns out of ``left`` pieces of each length, the longest first; a length that finds none is passed over.

    Each step takes the longest piece that leaves room for another exactly, else the longest that fits.
    """
    left = left.copy()
    for n in range(capacity, 0, -1):
        while left[n]:
            rest = left.copy()
            rest[n] -= 1
            pattern, room = {n: 1}, capacity - n
            while room and len(fits := np.flatnonzero(rest[: room + 1])):
                exact = fits[(fits == room) | ((rest[room - fits] > (2 * fits == room)) & (fits < room))]
                m = int(exact[-1] if len(exact) else fits[-1])
                rest[m] -= 1
                pattern[m] = pattern.get(m, 0) + 1
                room -= m
            total = capacity - room
            if padded(total, capacity) > (1 + WASTE) * total:
                break
            left = rest
            yield pattern


def cut_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with their ids, written to the shared folder."""
    path = tokenizer or tokenizer_path()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for f in gathered(frames):
            rows: list[tuple] = []
            for doc_id, raw in zip(f["doc_id"].astype("Int64"), enc.encode(f["text"].tolist())):
                raw += end
                for at in range(0, len(raw), 4 * capacity):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, part))
                if len(rows) >= 1000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return materialize(need(docs, ["doc_id", "text"]).mapInPandas(lean(each, holds=True), PIECES), "pieces")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 1024, group: int = 200_000) -> DataFrame:
    """Every piece of every document with its sequence and offset, and its ids' checksum.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are one end id; repeated rows are packed as often as they occur; an empty table gives an empty
    result. Ranks within a length are counted in hashed groups, one for each ``group`` pieces of the
    corpus, so a length that a third of the documents share is ranked by many tasks.
    """
    pieces = cut_documents(docs, tokenizer, end_id, capacity)
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    spread = max(64, pieces.count() // group)
    dealt = pieces.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(spread)).alias("part"))
    counts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = make_plan(demand, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        dealt.withColumn("own", F.row_number().over(own) - 1)
        .join(bases, ["length", "part"])
        .select(*keys, (F.col("base") + F.col("own")).alias("rank"))
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.int64(1) << 44
        runs = plan.length * wide + plan.rank
        for f in frames:
            n = f["length"].to_numpy()
            rank = f["rank"].to_numpy()
            left = rank >= plan.placed[n]
            if len(runs):
                i = np.maximum(np.searchsorted(runs, n * wide + rank, "right") - 1, 0)
                times, slot = np.divmod(rank - plan.rank[i], plan.copies[i])
                sequence, offset = plan.sequence[i] + times, plan.offset[i] + slot * n
            else:
                sequence = offset = np.zeros(len(f), np.int64)
            out = f[keys].copy()
            out["sequence_id"] = np.where(left, -1, sequence)
            out["offset"] = np.where(left, plan.tail[n] + (rank - plan.placed[n]) * n, offset)
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = materialize(ranked.mapInPandas(lean(place), schema), "placed")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, start, size, tokens, at, ids in zip(f["doc_id"].astype("Int64"), f["start"], f["length"], f["doc_tokens"], f["offset"], f["ids"]):
                done = 0
                for sequence, offset, part in plan.cuts(int(at), int(size)):
                    rows.append((doc_id, start + done, part, zlib.crc32(ids[4 * done : 4 * (done + part)]), tokens, sequence, offset))
                    done += part
            out = pd.DataFrame(rows, columns=[*keys, "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    left = placed.where("sequence_id < 0")
    lost = left.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    if left.count() <= LEFTOVERS:
        lost = F.broadcast(lost)
    ids = pieces.join(lost, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
    ids = ids.dropDuplicates(keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "ids")
    split = left.join(ids, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, "offset", "ids").mapInPandas(lean(cut), schema)
    return placed.where("sequence_id >= 0").unionByName(split)
