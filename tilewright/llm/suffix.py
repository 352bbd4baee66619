"""Exact removal of long byte strings that occur more than once, by run-length Burrows-Wheeler indexes.

Every ``length``-byte window of a text chooses one of its k-byte grams (least hash, rightmost), which
depends on the window's bytes only. Equal windows, wherever they are, therefore choose the same gram
and are dealt to the same group; a gram that occurs once has no repeated window. Neighbouring windows
with one gram form a *context*, and equal contexts are kept once with their number of occurrences.

In each task the contexts of whole groups form a small repetitive corpus. Its Burrows-Wheeler transform is run-length compressed, and text
positions and longest common prefixes are sampled at run ends only: everywhere else the longest match
of a position with its lexicographic neighbour is that of the position before it, less one. So
streaming each context past the sampled ends gives the matching statistics, the length of the
longest string at each position that starts anywhere else, and windows with at least ``length`` are marked.

A gram shared by very many different contexts (a common short line) is not put into one task: its
contexts are cut again by longer grams, up to the window itself, where all contexts of a gram are
equal. No string is dropped on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lean, materialize, need, row_key

LENGTH = 200
GRAMS = (32, 100, 160, 190)  # then the window itself
GROUP = 2048  # different contexts of one gram that one index takes
BLOCK = 1 << 18  # bytes of contexts in one index
_SEGMENT = 1 << 18  # bytes of text whose contexts are chosen at a time; arrays of 8 bytes for each are some twelve

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _POWERS = 0x9E3779B97F4A7C15, {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        with np.errstate(over="ignore"):
            up = np.full(n, _BASE, np.uint64)
            down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each position, from one running sum."""
    n = len(data)
    up, down = _powers(max(n, 2 * _SEGMENT))
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        h = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
        h ^= h >> np.uint64(30)
        h *= _M1
        h ^= h >> np.uint64(27)
        h *= _M2
        h ^= h >> np.uint64(31)
    return h


def choose(data: np.ndarray, valid: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring valid windows that choose one gram: (first window, windows, hash of the gram)."""
    h = gram_hashes(data, k)
    w = length - k + 1
    n = len(data) - length + 1
    low = np.uint64(0xFFFFFF)
    keyed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    if w > 1:
        pad = -len(keyed) % w
        grid = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        keyed = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    at = (low - (keyed[:n] & low)).astype(np.int64)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~valid[: n - 1]
    first = np.flatnonzero(new & valid[:n])
    ends = np.flatnonzero(np.concatenate([new[1:] | ~valid[1:n], [True]]) & valid[:n])
    return first, ends - first + 1, h[at[first]].view(np.int64)


def contexts_of(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first window, windows, gram) of all contexts, some texts at a time."""
    held, numbers, offsets, size = [], [], [], 0

    def flush():
        data = np.frombuffer(b"".join(held), np.uint8)
        starts = np.cumsum([0, *map(len, held)])
        valid = np.zeros(len(data), bool)
        for s, e in zip(starts, starts[1:]):
            valid[s : e - length + 1] = True
        first, count, gram = choose(data, valid, length, k)
        i = np.searchsorted(starts, first, "right") - 1
        return np.array(numbers)[i], first - starts[i] + np.array(offsets)[i], count, gram

    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), _SEGMENT):
            part = text[at : at + _SEGMENT + length - 1]
            held.append(part), numbers.append(number), offsets.append(at)
            size += len(part)
            if size >= _SEGMENT:
                yield flush()
                held, numbers, offsets, size = [], [], [], 0
    if held:
        yield flush()


class RunIndex:
    """Run-length Burrows-Wheeler index of some short texts with positions sampled at run ends.

    ``least`` is the shortest match that is asked for: shorter ones may be reported as shorter still.
    """

    def __init__(self, texts: list[bytes], least: int = 1):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        n = self.n = len(symbols)
        self._symbols = symbols
        self._end = np.repeat(self.starts[1:], sizes).astype(np.int32)
        place = np.arange(n, dtype=np.int32)
        room = self._end - place  # symbols from here to the end of the text
        key = np.zeros(n, np.int64)
        for t in range(4):
            key <<= 9
            key[: n - t] += np.where(room[: n - t] > t, symbols[t:].astype(np.int64) + 1, 0)
        self._ranks: list[tuple[int, np.ndarray]] = []
        h, longest = 4, int(sizes.max()) if len(sizes) else 0
        while True:
            rank, order, distinct = _ranked(key)
            self._ranks.append((h, rank))
            if h >= longest or distinct == n:
                break
            key = rank.astype(np.int64) * (n + 1)
            key[: n - h] += np.where(room[: n - h] > h, rank[h:], 0)
            h *= 2
        # `order` has equal strings in the order of their texts
        before = np.empty(n, np.int32)
        before[1:] = symbols[:-1]
        before[self.starts[:-1][sizes > 0]] = -1 - np.arange(int((sizes > 0).sum()))  # a text's start has no symbol before it
        bwt = before[order]
        self.heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]])) if n else np.empty(0, np.int64)
        self.run_symbols = bwt[self.heads]
        tails = np.append(self.heads[1:] - 1, n - 1) if n else self.heads
        up, down = np.maximum(self.heads - 1, 0), np.minimum(tails + 1, max(n - 1, 0))
        self.samples = [self._sampled(order[self.heads], order[up], up != self.heads, least), self._sampled(order[tails], order[down], down != tails, least)]
        del self._ranks

    def _sampled(self, a: np.ndarray, b: np.ndarray, has: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions at run ends, ascending, and their longest common prefix with the neighbour outside the run."""
        lcp = np.zeros(len(a), np.int32)
        at = np.flatnonzero(has)
        sure = [(h, r) for h, r in self._ranks if h <= least]
        if sure:
            at = at[sure[-1][1][a[at]] == sure[-1][1][b[at]]]
        x, y = a[at].astype(np.int64), b[at].astype(np.int64)
        ends = np.minimum(self._end[x] - x, self._end[y] - y)  # no match is longer
        for k, (h, rank) in enumerate(reversed(self._ranks)):
            for _ in range(2 if k == 0 else 1):
                done = lcp[at]
                live = np.flatnonzero(done < ends)
                live = live[rank[x[live] + done[live]] == rank[y[live] + done[live]]]
                lcp[at[live]] = np.minimum(done[live] + h, ends[live])
        for _ in range(4):
            done = lcp[at]
            live = np.flatnonzero(done < ends)
            live = live[self._symbols[x[live] + done[live]] == self._symbols[y[live] + done[live]]]
            lcp[at[live]] += 1
        order = np.argsort(a)
        return a[order], lcp[order]

    def statistics(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """For each place of the joined texts, the longest string there that also starts elsewhere in the index."""
        place = np.arange(lo, self.n if hi is None else hi)
        out = np.zeros(len(place), np.int64)
        for at, lcp in self.samples:
            i = np.searchsorted(at, place, "right") - 1
            np.maximum(out, lcp[i] - (place - at[i]), out=out)
        return out

    def matching_statistics(self, text: int) -> np.ndarray:
        return self.statistics(int(self.starts[text]), int(self.starts[text + 1]))


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ranks from 1 (equal keys have equal ranks), the stable order, and the number of different keys."""
    n = len(key)
    if n <= 1 << 20 and (n == 0 or int(key.max()) < 1 << 43):
        packed = np.sort(key << 20 | np.arange(n))
        order, ordered = (packed & ((1 << 20) - 1)).astype(np.int32), packed >> 20
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    rank = np.empty(n, np.int32)
    rank[order] = sums = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:n], dtype=np.int32)
    return rank, order, int(sums[-1]) if n else 0


def _mark(f: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated windows of whole groups of contexts ``(gram, h1, h2, n, ctx)``, as byte ranges of each context.

    A context that occurs more than once repeats itself from every place to its end; it goes in once,
    so that it can match others. A context alone in its group has nothing else to match.
    """
    gram, often, texts = f["gram"].to_numpy(), f["n"].to_numpy() > 1, f["ctx"].tolist()
    edge = np.concatenate([[True], gram[1:] != gram[:-1], [True]])
    alone = edge[1:] & edge[:-1]
    lo: list = [[0] if o else [] for o in often]
    hi: list = [[len(t)] if o else [] for o, t in zip(often, texts)]
    group = np.flatnonzero(~alone & ~often | ~alone & _near_rare(often, edge))
    if len(group):
        index = RunIndex([texts[i] for i in group], length)
        stats = index.statistics() >= length
        for t, row in enumerate(group):
            if not often[row]:
                hit = np.flatnonzero(stats[index.starts[t] : index.starts[t + 1]])
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > length)  # ranges that touch or overlap are one
                    lo[row] = hit[np.concatenate([[0], cut + 1])].astype(np.int32)
                    hi[row] = hit[np.concatenate([cut, [len(hit) - 1]])].astype(np.int32) + np.int32(length)
    keep = [i for i, x in enumerate(lo) if len(x)]
    return pd.DataFrame(
        {
            "h1": f["h1"].to_numpy()[keep],
            "h2": f["h2"].to_numpy()[keep],
            "n": f["n"].to_numpy()[keep],
            "lo": pd.Series([lo[i] for i in keep], dtype=object),
            "hi": pd.Series([hi[i] for i in keep], dtype=object),
        }
    )


def _near_rare(often: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether a context's group has one that occurs once: only those are looked up."""
    group = np.cumsum(edge[:-1]) - 1
    return (np.bincount(group, ~often) > 0)[group]


def _marked(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by gram; an index takes whole groups, about BLOCK bytes."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        while len(f):
            room = max(1, (BLOCK - size) // (2 * length))
            part, f = f.iloc[:room], f.iloc[room:]
            held.append(part)
            size += int(part["ctx"].map(len).sum())
            if size < BLOCK:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = np.flatnonzero(whole["gram"].to_numpy() != whole["gram"].iloc[-1])
            if len(last):
                yield _mark(whole.iloc[: last[-1] + 1], length)
                whole = whole.iloc[last[-1] + 1 :]
            held, size = [whole], int(whole["ctx"].map(len).sum())
    if held:
        yield _mark(pd.concat(held, ignore_index=True), length)


def _digest(ctx: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(ctx)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, mark: together the key of a row; rows that are equal in both are equal documents."""
    doc, mark = row_key(docs)
    return need(docs, ["doc_id", "text"]).select("doc_id", "text", doc.alias("doc"), mark.alias("mark"))


def _sorted_groups(ctx: DataFrame) -> DataFrame:
    parts = max(12, int(ctx.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ctx.select("gram", "h1", "h2", "n", "ctx").repartition(parts, "gram").sortWithinPartitions("gram", "h1", "h2")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, group: int = GROUP) -> DataFrame:
    """``(doc, mark, lo, hi)``: byte ranges covered by strings of ``length`` bytes that start more than once in all of ``docs``."""
    rows = _keyed(docs)
    levels = [*(k for k in grams if k < length), length]

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            doc, mark = f["doc"].to_numpy(), f["mark"].to_numpy()
            for i, first, count, gram in contexts_of([_raw(t) for t in f["text"]], length, levels[0]):
                yield pd.DataFrame({"doc": doc[i], "mark": mark[i], "place": (first << 16) | count, "gram": gram})

    chosen = rows.select("doc", "mark", "text").where(F.octet_length("text") >= length).mapInPandas(lean(pick), "doc long, mark long, place long, gram long")
    often = materialize(chosen.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated-grams")
    wanted = join_counted(chosen, often, "gram", "times").groupBy("doc", "mark").agg(F.collect_set(F.struct("place", "gram")).alias("places"))

    def lift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # contexts whose bytes this task has sent already
        for f in frames:
            out = []
            for doc, mark, text, places in zip(f["doc"], f["mark"], f["text"], f["places"]):
                raw = _raw(text)
                for p in places:
                    first, count = p["place"] >> 16, p["place"] & 0xFFFF
                    ctx = raw[first : first + count - 1 + length]
                    h = _digest(ctx)
                    out.append((p["gram"], *h, doc, mark, first, None if (whole := h[0] << 64 | h[1] & (1 << 64) - 1) in seen else ctx))
                    if len(seen) < 300_000:
                        seen.add(whole)
            yield pd.DataFrame(out, columns=["gram", "h1", "h2", "doc", "mark", "first", "ctx"])

    found = materialize(
        rows.select("doc", "mark", "text").join(wanted, ["doc", "mark"]).mapInPandas(lean(lift), "gram long, h1 long, h2 long, doc long, mark long, first long, ctx binary"),
        "contexts",
    )
    places = found.select("h1", "h2", "doc", "mark", "first")
    counted = found.groupBy("gram", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    bytes_of = found.where("ctx IS NOT NULL").select("h1", "h2", "ctx").dropDuplicates(["h1", "h2"])
    ctx = materialize(counted.join(bytes_of, ["h1", "h2"]), "distinct-contexts")

    result = None
    for k in [*levels[1:], None]:
        hot = materialize(ctx.groupBy("gram").count().where(F.col("count") > group).select("gram"), "hot-grams")
        any_hot = k is not None and not hot.isEmpty()
        cold = ctx.join(hot, "gram", "left_anti") if any_hot else ctx
        ranges = _sorted_groups(cold).mapInPandas(lean(lambda it: _marked(it, length)), "h1 long, h2 long, n long, lo array<int>, hi array<int>")
        part = (
            join_counted(places, materialize(ranges, "ranges"), ["h1", "h2"], "n")
            .select("doc", "mark", "first", F.explode(F.arrays_zip("lo", "hi")).alias("r"))
            .select("doc", "mark", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi")).alias("hi"))
        )
        result = part if result is None else result.unionByName(part)
        if not any_hot:
            break

        def cut(frames: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for f in frames:
                texts, h1, h2, n = f["ctx"].tolist(), f["h1"].to_numpy(), f["h2"].to_numpy(), f["n"].to_numpy()
                for i, first, count, gram in contexts_of(texts, length, k):
                    sub = [texts[t][s : s + c - 1 + length] for t, s, c in zip(i, first, count)]
                    h = np.array([_digest(s) for s in sub], np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"o1": h1[i], "o2": h2[i], "shift": first, "gram": gram, "h1": h[:, 0], "h2": h[:, 1], "n": n[i], "ctx": sub})

        finer = materialize(
            ctx.join(hot, "gram", "left_semi").mapInPandas(lean(cut), "o1 long, o2 long, shift long, gram long, h1 long, h2 long, n long, ctx binary"), "finer-contexts"
        )
        often = finer.groupBy("gram").agg(F.sum("n").alias("times")).where("times > 1").select("gram")
        finer = finer.join(often, "gram")
        places = materialize(
            places.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "doc", "mark", "first")
            .join(finer.select("o1", "o2", "shift", "h1", "h2"), ["o1", "o2"])
            .select("h1", "h2", "doc", "mark", (F.col("first") + F.col("shift")).alias("first")),
            "finer-places",
        )
        counted = finer.groupBy("gram", "h1", "h2").agg(F.sum("n").alias("n"))
        ctx = materialize(counted.join(finer.select("h1", "h2", "ctx").dropDuplicates(["h1", "h2"]), ["h1", "h2"]), "distinct-contexts")
    return result


def _kept(raw: bytes, lo, hi) -> tuple[bytes, int]:
    """The bytes outside all ranges, and the number of maximal removed runs."""
    order = np.argsort(lo, kind="stable")
    lo, hi = np.asarray(lo)[order], np.maximum.accumulate(np.asarray(hi)[order])
    cut = np.flatnonzero(lo[1:] > hi[:-1])
    starts, ends = lo[np.concatenate([[0], cut + 1])], hi[np.concatenate([cut, [len(hi) - 1]])]
    out, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]), len(starts)


#: What remove_repeats says of each row.
MADE = {"kept": "string", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def remove_repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, group: int = GROUP, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row with kept (the text left, without halves of cut characters), n_bytes, n_removed, n_spans and kept_sha256; the last five replace columns of their names.

    Null texts count as empty (and kept is null). Repeated rows are documents of their own and remove each other's bytes.
    Texts under ``length`` bytes and texts without repeats are returned whole; an empty table gives
    an empty result.
    """
    keep = [c for c in keep or ["doc_id"] if c.lower() not in MADE]
    ranges = repeated_ranges(docs, length, grams, group).groupBy("doc", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    doc, mark = row_key(docs)
    own = docs.select(*[docs[c].alias(f"_{c}") for c in keep], doc.alias("doc"), mark.alias("mark"), docs["text"].alias("text"))
    joined = own.join(ranges, ["doc", "mark"], "left").drop("doc", "mark")
    made = ", ".join(f"{n} {t}" for n, t in MADE.items())
    names = [f"_{c}" for c in keep]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, ranges in zip(f["text"], f["ranges"]):
                raw = _raw(text)
                kept, spans = (raw, 0) if ranges is None or not len(ranges) else _kept(raw, [r["lo"] for r in ranges], [r["hi"] for r in ranges])
                out.append((None if text is None else kept.decode("utf-8", "ignore"), len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pd.concat([f[names].reset_index(drop=True), pd.DataFrame(out, columns=list(MADE))], axis=1)

    head = ", ".join(f"`{n}` {joined.schema[n].dataType.simpleString()}" for n in names)
    return joined.mapInPandas(lean(each), f"{head}, {made}").withColumnsRenamed(dict(zip(names, keep)))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings taken out of its texts; n_chars, if there is one, follows where a text changed.

    All other columns stay as they are, whatever their names.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]  # names of no meaning, so that none clashes
    rows = docs.toDF(*plain)
    at = {c.lower(): p for c, p in zip(docs.columns, plain)}
    rows = rows.withColumnsRenamed({at["doc_id"]: "doc_id", at["text"]: "text"})
    cleaned = remove_repeats(rows, keep=rows.columns)
    chars = at.get("n_chars")
    if chars:
        cleaned = cleaned.withColumn(chars, F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
    return cleaned.withColumn("text", F.col("kept")).select(*rows.columns).toDF(*docs.columns)
