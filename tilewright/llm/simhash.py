"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint within three bits of another, cut into two segments, agrees with it in one segment up
to a single bit. So every fingerprint is indexed under its *one-wildcard variants*: for each segment
and each bit of it, the segment with that bit blanked. Equal variants are brought together by key,
and the full fingerprints are compared there.

A key that very many different fingerprints share is not compared in one task: its members get
variants of the bits that the key leaves open, which is the same argument one level down, and so on
until groups are small. Three levels suffice for 64 bits: then at most 2^11 different fingerprints
can share a key. Nothing is dropped on the way, and what leaves a task is a spanning forest of the
links found, never all pairs.

The pipeline's stage asks for texts whose sets of word shingles are alike to a similarity. Those
variants find and connect the bulk of them; each pair they give is verified exactly. Fingerprints alone
lose links there (two sets alike to 0.8 differ in ten bits of 64 or more), so what they leave apart is
completed through the prefixes of the sets in one common order, which lose none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, free_name, join_counted, join_ids, lean, materialize, need
from .components import connected_components, spanning_forest

_BITS_AT_ONCE = 1 << 15
_BYTES_AT_ONCE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lower-cased, split at ASCII white space, some at a time."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at < len(raw):
        end = len(raw)
        if at + _BYTES_AT_ONCE < end and (space := _SPACE.search(raw, at + _BYTES_AT_ONCE)):
            end = space.end()
        yield raw[at:end].split()
        at = end


def shingle_hashes(text: str | None, words: int, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """XXH64 of each run of ``words`` words of the text; with ``distinct`` sorted and without repeats.

    A shorter text is one shingle; a text without words (or null) has none.
    """
    digest, made, held = xxhash.xxh64_intdigest, [], []
    for some in _words(text):
        held += some
        if len(held) >= words:
            runs = held if words == 1 else map(b" ".join, zip(*(held[i:] for i in range(words))))
            made.append(np.array([digest(r, seed) for r in (set(runs) if distinct else runs)], np.uint64))
            held = held[len(held) - words + 1 :]
    if not made and held:
        made.append(np.array([digest(b" ".join(held), seed)], np.uint64))
    out = np.concatenate(made) if made else np.empty(0, np.uint64)
    return np.unique(out) if distinct else out


def majority_bits(hashes: np.ndarray) -> int:
    """Bit k is 1 if more than half the hashes have it; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + _BITS_AT_ONCE]).astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp0)``: the 64-bit fingerprint of each text.

    Null and empty texts have fingerprint zero; rows with a null doc_id are kept as they are.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = np.array([majority_bits(shingle_hashes(t, words)) for t in f["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp0": fps.view(np.int64)})

    return need(docs, ["doc_id", "text"]).mapInPandas(lean(each), "doc_id long, fp0 long")


def variants(rows: DataFrame, segments: int) -> DataFrame:
    """``(id, key, lo, width)``: one row for each one-wildcard variant of the open bits ``lo, width`` of ``cur``.

    The open bits are cut into ``segments``; the key is extended by the segment with one bit blanked,
    and the bits outside the segment (cyclically) stay open for a further level.
    """
    return (
        rows.withColumn("w", (F.col("width") / segments).cast("int"))
        .withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
        .withColumn("at", F.expr("(lo + seg * w) % 64").cast("int"))
        .withColumn("sw", F.expr(f"if(seg = {segments - 1}, width - seg * w, w)").cast("int"))
        .withColumn("pos", F.explode(F.expr("sequence(0, sw - 1)")))
        .withColumn("val", F.expr("shiftrightunsigned(cur, at) & (shiftleft(1L, sw) - 1L) & ~shiftleft(1L, pos)"))
        .select(
            "id",
            F.expr("xxhash64(key, at, pos, val)").alias("key"),
            F.expr("(at + sw) % 64").cast("short").alias("lo"),
            (F.col("width") - F.col("sw")).cast("short").alias("width"),
        )
    )


def _whole_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, put together so that no key is in two frames."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        held.append(f)
        size += len(f)
        if size >= 50_000:
            whole = pd.concat(held, ignore_index=True)
            last = whole["key"].to_numpy() != whole["key"].iloc[-1]
            if last.any():
                cut = int(np.flatnonzero(last)[-1]) + 1
                yield whole.iloc[:cut]
                whole = whole.iloc[cut:]
            held, size = [whole], len(whole)
    if size:
        yield pd.concat(held, ignore_index=True)


def _forest(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by key: the lightest spanning forest of the links in each key's group, as (a, b, dist)."""
    for f in _whole_keys(frames):
        yield _links(f, most)


def _links(f: pd.DataFrame, most: int) -> pd.DataFrame:
    key, ids, fp = f["key"].to_numpy(), f["id"].to_numpy(), f["fp0"].to_numpy().view(np.uint64)
    a = b = d = np.empty(0, np.int64)
    new: list[tuple[np.ndarray, ...]] = []
    pairs, step, live = 0, 1, np.arange(len(f))
    while len(live):
        live = live[live + step < len(f)]
        live = live[key[live] == key[live + step]]  # sorted by key: a group that ended stays ended
        if len(live):
            dist = np.bitwise_count(fp[live] ^ fp[live + step]).astype(np.int64)
            hit = np.flatnonzero(dist <= most)
            new.append((live[hit], live[hit] + step, dist[hit]))
            pairs += len(hit)
        if new and (pairs > 1_000_000 or not len(live)):  # the forest of a forest and more pairs is that of all pairs
            a, b, d = (np.concatenate(c) for c in zip((a, b, d), *new))
            tree = spanning_forest(a, b, len(f), d)
            a, b, d, new, pairs = a[tree], b[tree], d[tree], [], 0
        step += 1
    return pd.DataFrame({"a": ids[a], "b": ids[b], "dist": d})


def _parts(df: DataFrame) -> int:
    return max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose ``key`` others have too, with ``members``: how many rows have it."""
    counts = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), f"{name}-keys")
    out = materialize(join_counted(rows, counts, "key", "members"), name)
    drop_materialized(counts)
    return out


def _shared_variants(rows: DataFrame) -> DataFrame:
    """:func:`_shared` for variants, which are many a fingerprint and mostly alone: they are counted where they are brought together.

    So they move once. Counted first and joined to the counts, they would move twice, or once while the counts are
    small enough for a broadcast.
    """
    members = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return materialize(rows.withColumn("members", members).where("members > 1"), "variants")


def near_links(nodes: DataFrame, most: int = 3, group: int = 2048) -> DataFrame:
    """Links ``(a, b, dist)`` between nodes ``(id, fp0)`` whose fingerprints differ in at most ``most`` bits.

    Every link is found, as a path: the links returned connect exactly the nodes that all links
    connect, and are the lightest that do so. Ids and fingerprints must be distinct. ``group`` is the
    number of fingerprints compared at a time under one key; larger groups go a level deeper and
    nothing is left out.
    """
    own, found = nodes.select("id", F.col("fp0").alias("cur")), None
    rows = own.select("*", F.lit(0).cast("long").alias("key"), F.lit(0).alias("lo"), F.lit(64).alias("width"))
    for level, cut in enumerate(((most + 2) // 2, 2, 2)):
        shared = _shared_variants(variants(rows, cut))
        small = shared if level == 2 else shared.where(F.col("members") <= group)
        links = (
            small.select("key", "id")
            .join(nodes.select("id", "fp0"), "id")
            .repartition(_parts(nodes), "key")
            .sortWithinPartitions("key", "id")
            .mapInPandas(lean(lambda it: _forest(it, most)), "a long, b long, dist long")
        )
        found = links if found is None else found.unionByName(links)
        hot = shared.where(F.col("members") > group)
        if level == 2 or hot.isEmpty():
            break
        rows = hot.select("id", "key", "lo", "width").join(own, "id")
    return found.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.min("dist").alias("dist"))


def _classes(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """``(key, id, members)``: the smallest id of the rows of each key, and how many rows have it."""
    return materialize(rows.groupBy(key).agg(F.min(id_).alias("id"), F.count(F.lit(1)).alias("members")), "classes")


def near_duplicate_components(docs: DataFrame, words: int = 3, most: int = 3, group: int = 2048) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``most`` or fewer differing bits,
    itself included. Equal fingerprints are one node, so copies cost nothing beyond their row.
    Null texts count as empty (fingerprint zero), repeated rows are returned as often as they occur,
    null doc_ids get a null component unless others share the fingerprint; an empty table gives an
    empty table.
    """
    fps = materialize(fingerprints(docs, words), "fingerprints")
    classes = _classes(fps, "fp0", "doc_id")
    roots = connected_components(near_links(classes.where("id IS NOT NULL"), most, group))
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("fp0", "members", F.coalesce("root", "id").alias("component_id"))
    return join_counted(fps, materialize(named, "components"), "fp0", "members").select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- sets of shingles alike to a similarity ----------------------------------------------------

#: Bits of a set's parity map; of one set in so many, the shingles seen so often are common, so many at most.
PARITY_BITS, COMMON_SHARE, COMMON_SEEN, COMMON_MOST = 512, 16, 4, 500_000
#: Parts that candidate pairs are verified in, one after the other.
VERIFY_PARTS = 2
_MAP = [f"m{i}" for i in range(PARITY_BITS // 64)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)``: equal digests are equal sequences of words."""
    one_space = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " ")
    return docs.select("doc_id", F.unhex(F.md5(F.trim(one_space))).alias("digest"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingle_hashes(t, words, distinct=True).view(np.int64) for t in f["text"]]
            yield pd.DataFrame({"node": f["doc_id"].to_numpy(), "set": pd.Series(sets, dtype=object)})

    return docs.mapInPandas(lean(each), "node long, set array<long>")


def _described(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(node, fp0, size, m0, ..., prefix)`` of each text with words: fingerprint, size and parity map of its set, and the set's prefix.

    Bit k of the parity map says whether an odd number of shingles fall on it, so two maps differ in no
    more bits than the sets have shingles of their own. The prefix is as many of the first shingles as
    must hold one of any set that is alike: sets in one common order that share ``least`` shingles share one
    of the first ``size - least + 1`` of each. Any order will do; the common shingles, as a sample of
    sets has them, come last.
    """
    sample = docs.where(f"pmod(xxhash64(doc_id), {COMMON_SHARE}) = 0")
    seen = _sets(sample, words).select(F.explode("set").alias("x")).groupBy("x").count()
    top = seen.where(f"count >= {COMMON_SEEN}").orderBy(F.desc("count"), "x").limit(COMMON_MOST).select("x").toArrow()["x"].to_numpy()
    order = np.argsort(top)
    common = docs.sparkSession.sparkContext.broadcast((top[order], len(top) - order))  # COMMON_MOST entries at most

    def first(s: np.ndarray) -> np.ndarray:
        known, rank = common.value
        if len(known):
            place = np.minimum(np.searchsorted(known, s), len(known) - 1)
            late = np.where(known[place] == s, rank[place], 0)
            s = s[np.argsort(late, kind="stable")]  # the rare ones stay in the order of their hashes
        return s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingle_hashes(t, words, distinct=True) for t in f["text"]]
            odd = [np.bincount((s & np.uint64(PARITY_BITS - 1)).view(np.int64), minlength=PARITY_BITS) & 1 for s in sets]
            maps = np.packbits(np.array(odd, np.uint8).reshape(-1, PARITY_BITS), axis=1, bitorder="little").view(np.int64)
            yield pd.DataFrame(
                {
                    "node": f["doc_id"].to_numpy(),
                    "fp0": np.array([majority_bits(s) for s in sets], np.uint64).view(np.int64),
                    "size": np.array([len(s) for s in sets], np.int32),
                }
                | {m: maps[:, i] for i, m in enumerate(_MAP)}
                | {"prefix": pd.Series([first(s.view(np.int64)) for s in sets], dtype=object)}
            )

    schema = f"node long, fp0 long, size int, {', '.join(f'{m} long' for m in _MAP)}, prefix array<long>"
    return materialize(docs.mapInPandas(lean(each), schema).where("size > 0"), "described")


def _candidates(frames: Iterator[pd.DataFrame], similarity: float, star: bool) -> Iterator[pd.DataFrame]:
    """Rows sorted by key: pairs of nodes of one key and different ``comp`` that may be alike, as (a, b).

    With ``star`` only the pairs with the first node of each key. A pair is left out where its sizes,
    what follows the key in both sets, or the parity maps show that it is not alike; the first key
    that two sets share never rules out a pair that is.
    """
    for f in _whole_keys(frames):
        key, node, comp, side = (f[c].to_numpy() for c in ("key", "node", "comp", "side"))
        size, at = f["size"].to_numpy().astype(np.int64), f["at"].to_numpy().astype(np.int64)
        maps = [f[m].to_numpy().view(np.uint64) for m in _MAP]

        def likely(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            other = (comp[x] != comp[y]) & ((side[x] < 0) | (side[x] != side[y]))
            x, y = x[other], y[other]
            least = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6).astype(np.int64)
            enough = np.minimum(size[x] - at[x], size[y] - at[y]) >= least
            x, y, least = x[enough], y[enough], least[enough]
            apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in maps)
            near = apart <= size[x] + size[y] - 2 * least
            return x[near], y[near]

        if star:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))
            yield _distinct_pairs(node, [likely(first[~new], np.flatnonzero(~new))])
            continue
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pairs, step, live = 0, 1, np.arange(len(f))
        while len(live):
            live = live[live + step < len(f)]
            live = live[key[live] == key[live + step]]  # sorted by key: a group that ended stays ended
            if len(live):
                found.append(likely(live, live + step))
                pairs += len(found[-1][0])
            if found and (pairs > 1_000_000 or not len(live)):
                yield _distinct_pairs(node, found)
                found, pairs = [], 0
            step += 1


def _distinct_pairs(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    x, y = (node[np.concatenate(c)] for c in zip(*found))
    return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)}).drop_duplicates()


def _alike(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets' Jaccard similarity, computed exactly, is at least ``similarity``.

    The sets of all documents that are in question are large: they are made, compared and deleted for one
    part of the pairs after the other.
    """
    pairs, out = materialize(pairs.select("a", "b").distinct(), "candidates"), None
    for part in range(VERIFY_PARTS):
        some = pairs.where(F.pmod(F.xxhash64("b"), F.lit(VERIFY_PARTS)) == part)
        ends = some.select(F.explode(F.array("a", "b")).alias("doc_id"))
        sets = materialize(_sets(join_ids(docs, ends, "doc_id", "left_semi"), words), "sets")
        both = some.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"
        )
        same = F.size(F.array_intersect("x", "y"))
        found = materialize(both.where(same >= similarity * (F.size("x") + F.size("y") - same)).select("a", "b").distinct(), "alike")
        out = found if out is None else out.unionByName(found)
        drop_materialized(sets)
        docs.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files of the comparison
    drop_materialized(pairs)
    return out


def _fingerprint_pairs(described: DataFrame, most: int, group: int) -> DataFrame:
    """Pairs ``(a, b)`` that connect the nodes whose fingerprints differ in at most ``most`` bits."""
    classes = _classes(described, "fp0", "node")
    equal = join_counted(described.select("node", "fp0"), classes, "fp0", "members").where("node <> id")
    return equal.select(F.col("node").alias("a"), F.col("id").alias("b")).unionByName(near_links(classes.select("id", "fp0"), most, group).select("a", "b"))


def _alike_links(docs: DataFrame, words: int, similarity: float, most: int, group: int) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the nodes that all pairs of at least ``similarity`` connect.

    First the pairs that fingerprints give, and each node with one that is the first member of a key of
    its prefix, are verified. Then all pairs that share a key are, save those that verified links connect
    already: nothing is thinned by an unverified pair. The members of a key with more than ``group`` are
    cut into blocks, and every pair of blocks is compared on its own.
    """
    described = _described(docs, words, similarity)
    keys = described.select("node", F.posexplode("prefix").alias("at", "key"))
    shared = _shared(keys.select("key", "node", "at"), "prefixes")
    facts = described.select("node", "size", *_MAP)

    def pairs(rows: DataFrame, star: bool) -> DataFrame:
        return (
            rows.join(facts, "node")
            .repartition(_parts(docs), "key")
            .sortWithinPartitions("key", "node")
            .mapInPandas(lean(lambda it: _candidates(it, similarity, star)), "a long, b long")
        )

    blocks = f"cast(ceil(members / {group}) as int)"
    first = shared.withColumn("key", F.expr(f"if(members > {group}, xxhash64(key, pmod(xxhash64(node), {blocks})), key)"))
    ones = pairs(first.select("key", "node", "at", F.col("node").alias("comp"), F.lit(-1).alias("side")), True)
    near = _fingerprint_pairs(described, most, group).unionByName(ones.groupBy("a").agg(F.min("b").alias("b")))
    links = _alike(near, docs, words, similarity)
    roots = connected_components(links).withColumnRenamed("node", "n")
    owned = materialize(
        shared.join(roots, shared["node"] == roots["n"], "left").select("key", "node", "at", "members", F.coalesce("root", "node").alias("comp")), "owned-prefixes"
    )
    drop_materialized(shared)
    open_ = owned.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    dealt = (
        join_counted(owned, materialize(open_, "open-keys"), "key", "n")
        .withColumn("block", F.expr(f"cast(pmod(xxhash64(node), {blocks}) as int)"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, {blocks} - 1)")))
        .select(
            F.expr(f"if(members > {group}, xxhash64(key, least(block, other), greatest(block, other)), key)").alias("key"),
            "node",
            "at",
            "comp",
            F.expr("if(block = other, -1, block)").alias("side"),
        )
    )
    return links.unionByName(_alike(pairs(dealt, False), docs, words, similarity))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 3, group: int = 2048) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest doc_id stays.

    Two documents are linked when the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; every such pair counts. Texts of equal words are one node; texts without words are
    one group. Rows with a null doc_id stay as they are, since no group can name them. Of rows that repeat
    a doc_id, one stays if one of their texts does. An empty table gives an empty result.
    """
    rows = need(docs, ["doc_id", "text"]).where("doc_id IS NOT NULL")
    digests = materialize(_digests(rows), "digests")
    classes = _classes(digests, "digest", "doc_id")
    reps = join_ids(rows, classes.select("id"), "id", "left_semi", "doc_id")
    roots = connected_components(_alike_links(reps, words, similarity, most, group))
    named = materialize(classes.join(roots, classes["id"] == roots["node"], "left").select("digest", "members", F.coalesce("root", "id").alias("root")), "groups")
    owners = join_counted(digests, named, "digest", "members")
    ruled = materialize(owners.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("root")).alias("goes"), F.count(F.lit(1)).alias("n")), "owners")
    out = join_ids(docs, ruled.where("goes").select("doc_id"), "doc_id", "left_anti")
    repeated = ruled.where("NOT goes AND n > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    place = free_name(docs, "place")
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    one = join_ids(out, repeated, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return join_ids(out, repeated, "doc_id", "left_anti").unionByName(one)
