"""SimHash near-duplicate groups, verified through pivot distance tables.

Fingerprints that differ in at most two bits are linked. Every document gets the
smallest ``doc_id`` that links reach. Steps:

1. One 64-bit fingerprint per document (Arrow batches, nothing shuffled).
2. Equal fingerprints collapse to one class, counted map-side first, so a group of
   copies never travels as more than one row per task.
3. Candidates. Two differing bits touch at most two of four 16-bit blocks, so linked
   classes agree on one of the six pairs of blocks. Classes meet under those keys.
4. In a bucket of up to ``bucket_rows`` classes, the Hamming distances of all members
   to ``n_pivots`` reference fingerprints form a table. By the triangle inequality a
   linked pair differs by at most two in every coordinate. Sorted by the first coordinate,
   a member meets only those within two of it there; the other coordinates discard most of
   these, and the rest are verified. What is linked hangs on one member, so no list of pairs leaves.
5. A larger bucket, which is a dense cluster, takes an exact way without pairs: each of its classes names itself and its
   64 one-bit neighbours as centres. Two classes are linked exactly if they share a
   centre, and a centre has at most 65 members, so this stays linear.
6. Alternating large-star and small-star rounds turn links into components.

Pivot tables alone only discard pairs after they were enumerated, which is quadratic;
hence the block keys of step 3 choose which pairs the tables see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, durable, row_key, table, unused
from .substrings import spaced, word_hashes

MAX_BITS = 2
SHINGLE = 3
SEED = 42
#: Members up to which a bucket's table of pivot distances is made.
BUCKET_ROWS = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """Column of fingerprints; null counts as a text without words."""
    return F.pandas_udf(_fingerprints, "long")(text)


def _block_keys(fp: Column) -> Column:
    blocks = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(pairs)])


def pivot_pairs(u: np.ndarray, pivots: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (i, j) of all pairs of ``u`` within ``max_bits``, and how many pairs had to be verified.

    ``u`` has at most some thousand members; the table holds their distances to all pivots.
    """
    distances = np.bitwise_count(u[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(distances[:, 0], kind="stable")
    first = distances[order, 0]
    near = np.searchsorted(first, first + max_bits, side="right") - np.arange(len(u)) - 1  # members after each within the first coordinate
    i = np.repeat(np.arange(len(u)), near)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(near) - near, near)
    i, j = order[i], order[j]
    for k in range(1, distances.shape[1]):
        if not len(i):
            break
        keep = np.abs(distances[i, k] - distances[j, k]) <= max_bits
        i, j = i[keep], j[keep]
    true = np.bitwise_count(u[i] ^ u[j]) <= max_bits
    return i[true], j[true], len(i)


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that links (i, j) reach from each of ``n`` places."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        least = least[least]
        if (least == before).all():
            return least


def _pivot_links(n_pivots: int):
    """Buckets (members) to links (a, b) that join what is linked in each bucket, fewer than it has members."""
    pivots = np.random.default_rng(SEED).integers(0, 1 << 63, n_pivots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for members in batch["members"]:
                x = np.asarray(members, dtype=np.int64)
                i, j, _ = pivot_pairs(x.view(np.uint64), pivots)
                if len(i):
                    least = _least_reachable(len(x), i, j)
                    led = np.flatnonzero(least != np.arange(len(x)))
                    left.append(x[least[led]])
                    right.append(x[led])
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def links(classes: DataFrame, bucket_rows: int = BUCKET_ROWS, n_pivots: int = 48) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect exactly those within two bits.

    Within a bucket, what is linked hangs on one member; in buckets above ``bucket_rows``, a centre's members do.
    """
    keyed = classes.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key")
    small = met.where(F.col("n") <= bucket_rows).groupBy("key").agg(F.collect_list("fp").alias("members"))
    pairs = small.select("members").mapInPandas(_pivot_links(n_pivots), "a long, b long")
    large = met.where(F.col("n") > bucket_rows).select("fp").distinct()
    centres = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = (
        large.select("fp", F.explode(centres).alias("z"))
        .groupBy("z")
        .agg(F.collect_set("fp").alias("members"))  # at most 65
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of (a, b): one row (node, root) for each node that isn't its root.

    The root is a component's smallest node. Alternates large-star and small-star
    (Kiveris et al. 2014) until nothing changes; every round is written down.
    """
    edges, before = durable(edges, name), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state[0] == 0 or tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select("v", "m").union(low.select("u", "m"))
        edges = durable(small.toDF("a", "b").distinct(), name)


def _rooted(marked: DataFrame) -> DataFrame:
    """``fp, root`` for each fingerprint of ``marked`` (fp): a component's fingerprints share a root."""
    classes = durable(marked.select("fp").distinct(), "classes")
    tree = components(links(classes))
    return classes.join(tree, classes.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (doc_id, text).

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: the smallest doc_id
    that links reach, itself included. A null or empty text, or one without words,
    has fingerprint zero and is linked like any other. A null id becomes a
    component's id only if it has no other. Repeated rows give repeated rows; further
    columns are ignored; an empty table gives an empty result.
    """
    marked = durable(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    rooted = durable(_rooted(marked), "rooted")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tops = rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(tops, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The wide form: bits of a sketch, words of a shingle, and the share of bits in which similar texts may differ.
#: A similarity (Jaccard) of 0.8 or more means at most 0.152 of the bits on average, with a deviation of 0.011.
SKETCH_BITS, WIDE_SHINGLE, WIDE_SHARE = 1024, 5, 0.172
#: Share of the bits that agree at a similarity of 0.8, and how often a pair there shall share a key at least.
AGREE, KEY_RECALL = 1 - float(np.arccos(2 * 0.8 / 1.8)) / np.pi, 0.99
#: Classes that share a key by chance, about: keys widen as classes become more.
BY_CHANCE = 8
#: Members of a key that are held at once; a key with more is dealt out in pairs of blocks of so many.
BLOCK = 8192
#: Bits in which the first 128 may differ for the whole sketch to be looked at: five deviations above what WIDE_SHARE gives.
NARROW = 44
#: Two texts are similar at this Jaccard distance of their shingles or less.
WIDE_DISTANCE = 1 - 0.8
#: Pivots whose distances to all members a table holds; with more pivots, more pairs are verified.
TABLE_PIVOTS = 256
#: Shingles, and so many more a text, of a part of a component of linked sketches: two parts meet in a task.
PART, PART_TEXT = 1 << 20, 512
_MIXERS = np.random.default_rng(6).integers(1, 1 << 63, SKETCH_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys_for(classes: int) -> np.ndarray:
    """Bits of each key for so many classes, a row a key: as wide as ``BY_CHANCE`` asks, as many as ``KEY_RECALL`` asks."""
    width = max(8, int(np.ceil(np.log2(max(2, classes) / BY_CHANCE))))
    n = int(np.ceil(np.log(1 - KEY_RECALL) / np.log(1 - AGREE**width)))
    rng = np.random.default_rng(8)
    laps = [rng.permutation(SKETCH_BITS)[: SKETCH_BITS // width * width].reshape(-1, width) for _ in range(-(-n // (SKETCH_BITS // width)))]
    return np.concatenate(laps)[:n]


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's different 5-word shingles; fewer words are one shingle, none are none."""
    data = spaced(text).translate(_LOWER)
    if not data:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(data)
    n = max(1, len(h) - WIDE_SHINGLE + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(min(WIDE_SHINGLE, len(h))):
        grams = grams * _MIXERS[0] + h[k : k + n]
    return np.unique(grams)


def sketch_of(text: str | None) -> np.ndarray:
    """1024-bit SimHash (sixteen signed integers) of a text's shingles."""
    grams = shingles(text)
    if not len(grams):
        return np.zeros(SKETCH_BITS // 64, dtype=np.int64)
    ones = np.zeros(SKETCH_BITS, dtype=np.int64)
    for at in range(0, len(grams), 1 << 12):  # bounded memory for very long texts
        g = grams[at : at + (1 << 12)]
        words = (g[:, None] ^ (g[:, None] >> np.uint64(31))) * _MIXERS[None, :]
        bits = np.unpackbits((words ^ (words >> np.uint64(29))).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")


def within(n: int, distance, radius: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (i, j) that connect exactly those of ``n`` members within ``radius`` of each other, fewer than members, and how many pairs had to be verified.

    ``distance(k)``: a metric's distances of member k to all. Pivots are members: the first one that no pivot is near becomes the next, so
    every member is a pivot or near one, and pivots have met all. Their distances form the table. Two members near pivots are a pair to
    verify only if links don't connect them yet and they differ by at most ``radius`` in every coordinate (triangle inequality).
    """
    root, free, pivot = np.arange(n), np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    table_, left, right, verified = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0

    def link(i: int, near: np.ndarray) -> None:
        roots, first = np.unique(root[near], return_index=True)
        other = roots != root[i]
        if other.any():
            left.append(np.full(other.sum(), i))
            right.append(near[first[other]])
            joined = np.zeros(n, dtype=bool)
            joined[roots], joined[root[i]] = True, True
            root[joined[root]] = min(root[i], roots[0])

    while free.any():
        i = int(free.argmax())
        column = distance(i)
        near = np.flatnonzero(column <= radius)
        link(i, near)
        pivot[i], free[i] = True, False
        if free[near].any() and len(table_) < TABLE_PIVOTS:
            table_.append(column.astype(np.float32))
        free[near] = False
    rest = np.flatnonzero(~pivot)
    coordinates = [c[rest] for c in table_]
    for k, i in enumerate(rest):
        if (root[rest[k:]] == root[i]).all():
            continue
        at = k + 1 + np.flatnonzero(root[rest[k + 1 :]] != root[i])
        for c in coordinates:
            at = at[np.abs(c[at] - c[k]) <= radius + 1e-6]  # above what single precision rounds
            if not len(at):
                break
        if len(at):
            verified += len(at)
            link(i, rest[at[distance(i)[rest[at]] <= radius]])
    return np.concatenate(left), np.concatenate(right), verified


def shingle_distances(grams: np.ndarray, sizes: np.ndarray):
    """Jaccard distances of set k to all: sets of so many ``sizes`` of different ``grams``, one after the other. Sets without any are equal."""
    _, grams, times = np.unique(grams, return_inverse=True, return_counts=True)
    several = times > 1  # others are of one set alone
    owner, own = np.repeat(np.arange(len(sizes)), sizes)[several[grams]], (np.cumsum(several) - 1)[grams[several[grams]]]
    ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))
    starts = np.concatenate([[0], ends[:-1]])
    words = int(several.sum()) // 64 + 1
    if words * len(sizes) <= len(own):  # much is shared: a bit for each
        bits = np.zeros((len(sizes), words), dtype=np.uint64)
        np.bitwise_or.at(bits, (owner, own >> 6), np.uint64(1) << (own & 63).astype(np.uint64))
        shared_with = lambda k: np.bitwise_count(bits & bits[k]).sum(axis=1, dtype=np.int64)
    else:
        mine, total = np.zeros(64 * words, dtype=bool), np.zeros(len(own) + 1, dtype=np.int64)

        def shared_with(k: int) -> np.ndarray:
            mine[own[starts[k] : ends[k]]] = True
            np.cumsum(mine[own], out=total[1:])
            mine[own[starts[k] : ends[k]]] = False
            return total[ends] - total[starts]

    def distance(k: int) -> np.ndarray:
        shared = shared_with(k)
        shared[k] = sizes[k]
        either = sizes + sizes[k] - shared
        return np.where(either > 0, 1 - shared / np.maximum(either, 1), 0.0)

    return distance


def leaders(keys: np.ndarray, ids: np.ndarray, near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders of each bucket: which rows no leader took, then links as positions (leader, member).

    A bucket's free member of the smallest id becomes a leader. It is held against all members that haven't led; those
    for which ``near(leaders, members)`` holds are taken and no longer free. So any two rows that stay free were compared,
    and work follows leaders times members: a bucket of near-copies stays linear.
    """
    untaken = np.ones(len(keys), dtype=bool)
    rows = np.lexsort((ids, keys))
    start = np.flatnonzero(np.concatenate([[True], keys[rows][1:] != keys[rows][:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(rows)))
    bucket = np.repeat(np.arange(len(start)), size)
    several = np.repeat(size > 1, size)
    rows, bucket = rows[several], bucket[several]
    free, head_of = np.ones(len(rows), dtype=bool), np.full(len(start), -1)
    taker = np.full(len(rows), -1)  # the leader that took a row first
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while free.any():
        at = np.flatnonzero(free)
        head = at[np.concatenate([[True], bucket[at][1:] != bucket[at][:-1]])]
        head_of[:] = -1
        head_of[bucket[head]] = rows[head]
        other = head_of[bucket] >= 0  # buckets without a free member are done, and a leader has met all others
        other[head] = False
        rows, bucket, free, taker = rows[other], bucket[other], free[other], taker[other]
        by = head_of[bucket]
        hit = near(by, rows)
        new = hit & free
        again = np.flatnonzero(hit & ~free)
        _, first = np.unique(np.stack([by[again], taker[again]], axis=1), axis=0, return_index=True)  # one link joins what a leader took before
        again = again[first]
        left += [by[new], by[again]]
        right += [rows[new], rows[again]]
        taker[new] = by[new]
        untaken[rows[new]] = False
        free &= ~new
    return untaken, np.concatenate(left), np.concatenate(right)


def _near(narrow: np.ndarray, row: np.ndarray | None = None, sketch: np.ndarray | None = None, bits: int = 0):
    """The test of ``leaders``: by the first 128 bits of each row, then by the whole sketch ``sketch[row]`` if given."""

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(narrow[i] ^ narrow[j]).sum(axis=1, dtype=np.int32) <= NARROW
        if sketch is not None:
            at = np.flatnonzero(out)
            for k in range(0, len(at), 1 << 16):  # bounded memory
                part = at[k : k + (1 << 16)]
                out[part] = np.bitwise_count(sketch[row[i[part]]] ^ sketch[row[j[part]]]).sum(axis=1, dtype=np.int32) <= bits
        return out

    return near


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    """Columns key, a, b and so on."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "a", "b", "m", "n"][: len(columns)])


def _unsigned(column: pa.Array, rows: int) -> np.ndarray:
    """An array column as a matrix of unsigned integers."""
    return column.flatten().to_numpy().reshape(rows, -1).view(np.uint64)


def _meet(key_bits: np.ndarray):
    """Classes (c, sketch) to bucket rows (key, class, 0, first 128 bits)."""
    n, width = key_bits.shape
    step = max(1, (1 << 18) // n)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                c = part.column(0).to_numpy()
                sketch = np.ascontiguousarray(_unsigned(part.column(1), len(c)))
                ones = np.unpackbits(sketch.view(np.uint8), axis=1, bitorder="little")
                key = np.broadcast_to(np.arange(n, dtype=np.int64), (len(c), n)).copy()
                for k in range(width):
                    key = (key << np.int64(1)) | ones[:, key_bits[:, k]]
                narrow = np.repeat(np.ascontiguousarray(sketch[:, :2]), n, axis=0)
                yield _batch(key.ravel(), np.repeat(c, n), np.zeros(key.size, dtype=np.int64), *narrow.view(np.int64).T)

    return run


def _mark(batches):
    """Rows of one partition in the order of their keys to the links, and the rows that have a neighbour in the first 128 bits.

    ``b`` of such a row is its block: keys above ``BLOCK`` rows aren't tested here, all their rows go on, in blocks.
    Never more than some blocks are held.
    """

    def tested(rows: np.ndarray) -> pa.RecordBatch:
        key, a, _, m, n = rows
        _, left, right = leaders(key, a, _near(np.stack([m, n], axis=1).view(np.uint64)))
        marked = np.unique(np.concatenate([left, right]))
        return _batch(key[marked], a[marked], np.zeros(len(marked), dtype=np.int64))

    held, hot, passed = np.zeros((5, 0), dtype=np.int64), None, 0
    for batch in batches:
        new = np.stack([batch.column(i).to_numpy() for i in range(5)])
        links_ = new[0] < 0
        if links_.any():
            yield _batch(*new[:3, links_])
        held = np.concatenate([held, new[:, ~links_]], axis=1)
        while True:
            if hot is not None:  # the key that is passed on goes on first
                to = np.searchsorted(held[0], hot, side="right")
                yield _batch(held[0, :to], held[1, :to], (passed + np.arange(to)) // BLOCK)
                passed, held = passed + to, held[:, to:]
                hot = None if held.shape[1] else hot
            if held.shape[1] <= BLOCK:
                break
            last = np.searchsorted(held[0], held[0, -1])
            if last:  # all keys but the last are whole; large ones among them wait for their turn
                sizes = np.unique(held[0, :last], return_counts=True)
                large = sizes[0][sizes[1] > BLOCK]
                if len(large) and held[0, 0] == large[0]:
                    hot, passed = large[0], 0
                    continue
                to = np.searchsorted(held[0], large[0]) if len(large) else last
                yield tested(held[:, :to])
                held = held[:, to:]
            else:
                hot, passed = held[0, 0], 0
    if held.shape[1]:
        yield tested(held)


def _whole(batches, n: int, columns, found):
    """``found`` of the whole buckets of one partition: rows in the order of their first ``n`` columns, as ``columns`` reads them from a batch.

    No more is held than a batch and the bucket that goes on in the next one.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
        last = np.flatnonzero(np.any([c != c[-1] for c in held[:n]], axis=0))
        to = last[-1] + 1 if len(last) else 0
        if to:
            yield from found(*(c[:to] for c in held))
            held = [c[to:] for c in held]
    if held is not None:
        yield from found(*held)


def _starts(*key: np.ndarray) -> np.ndarray:
    """Where another bucket starts, and the end."""
    other = np.any([k[1:] != k[:-1] for k in key], axis=0)
    return np.concatenate([[0], 1 + np.flatnonzero(other), [len(key[0])]])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _lead(bits: int):
    """Bucket rows (key, x, y, class, sketch) of one partition, in that order, to links (a, b) that connect what is near in each bucket.

    Leaders of all buckets are found at once. Where what they took isn't of one component, a bucket's pivot distances tell which of the
    taken rows may still be near each other.
    """

    def found(key, x, y, c, sketch):
        start = _starts(key, x, y)
        bucket = np.repeat(np.arange(len(start) - 1), np.diff(start))
        untaken, left, right = leaders(bucket, c, _near(np.ascontiguousarray(sketch[:, :2]), np.arange(len(c)), sketch, bits))
        yield _pairs(c[left], c[right])
        taken = np.flatnonzero(~untaken)
        least = _least_reachable(len(c), left, right)[taken]
        several = (bucket[taken][1:] == bucket[taken][:-1]) & (least[1:] != least[:-1])
        for k in np.unique(bucket[taken][1:][several]):
            own, ids = sketch[start[k] : start[k + 1]], c[start[k] : start[k + 1]]
            i, j, _ = within(len(ids), lambda m, own=own: np.bitwise_count(own ^ own[m]).sum(axis=1, dtype=np.int32), bits)
            yield _pairs(ids[i], ids[j])

    def columns(batch):
        return [*(batch.column(i).to_numpy() for i in range(4)), _unsigned(batch.column(4), batch.num_rows)]

    return lambda batches: _whole(batches, 3, columns, found)


def similar(classes: DataFrame, share: float = WIDE_SHARE) -> DataFrame:
    """Links (a, b) between classes (c, sketch) whose sketches differ in at most ``share`` of the bits.

    Classes meet under keys of some of their bits; the more classes, the wider the keys and the more of them, so
    that at most about ``BY_CHANCE`` strangers meet under a key and a pair at similarity 0.8 does with probability 0.97 to 0.99, whatever
    the input's size (at 0.9: 0.9999). Rows that have a neighbour in the first 128 bits fetch their sketches. Links connect
    all classes that are near each other where they met. A key with more than ``BLOCK`` rows is dealt out: each pair of its
    blocks is a bucket.
    """
    bits = int(share * SKETCH_BITS)
    met = classes.select("c", "sketch").mapInArrow(_meet(keys_for(classes.count())), "key long, a long, b long, m long, n long")
    met = durable(met.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_mark, "key long, a long, b long"), "met")
    marked = met.where("key >= 0").withColumnRenamed("b", "block")
    blocks = marked.where("block > 0").groupBy("key").agg(F.max("block").alias("last"))
    other = F.explode(F.when(F.col("last").isNull(), F.array(F.col("block"))).otherwise(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0))))).alias("other")
    dealt = marked.join(blocks, "key", "left").select("key", F.col("a").alias("c"), "block", other)
    rows = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "c").join(classes.select("c", "sketch"), "c").select("key", "x", "y", "c", "sketch")
    led = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "c").mapInArrow(_lead(bits), "a long, b long")
    return led.distinct()


def _sketches(texts: pd.Series) -> pd.Series:
    return pd.Series([sketch_of(t) for t in texts], dtype=object)


def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


#: Bits of the table of linked rows that each task gets: 2 MB at any input. The fuller it is, the more texts move for nothing.
LINKED_BITS = 1 << 24


def _alike(batches):
    """Rows (root, x, y, class, shingles) of one partition, in that order, to links (a, b) that connect the similar texts of each bucket."""

    def found(root, x, y, c, grams):
        start = _starts(root, x, y)
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at, to in zip(start[:-1], start[1:]):
            distance = shingle_distances(np.concatenate(grams[at:to]), np.array([len(g) for g in grams[at:to]]))
            i, j, _ = within(to - at, distance, WIDE_DISTANCE)
            left.append(c[at:to][i])
            right.append(c[at:to][j])
        yield _pairs(np.concatenate(left), np.concatenate(right))

    def columns(batch):
        grams = np.empty(batch.num_rows, dtype=object)
        values, ends = batch.column(4).flatten().to_numpy(), np.cumsum(batch.column(4).value_lengths().to_numpy())
        for k, own in enumerate(np.split(values, ends[:-1])):
            grams[k] = own
        return [*(batch.column(i).to_numpy() for i in range(4)), grams]

    return _whole(batches, 3, columns, found)


def alike(links: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect those classes of a component of ``links`` (a, b) whose texts share 0.8 or more of their different shingles, as counted.

    ``classes`` (c, first: d, h): the row of ``docs`` (d, h, text) that stands for each class. Only texts of linked classes are
    read for their shingles: a bitmap of fixed size tells most others before anything moves, and a join the rest. A component's
    shingles meet in one task, or part by part; pivot distances discard most pairs, the rest are verified.
    """
    tree = components(links)
    members = tree.select(F.col("node").alias("c"), "root").unionByName(tree.select(F.col("root").alias("c"), "root").distinct())
    linked = durable(classes.join(members, "c").select("root", "c", "first.d", "first.h"), "linked")
    place = F.pmod(F.col("h"), F.lit(LINKED_BITS))
    table_ = linked.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    met = docs.withColumn("part", F.bitmap_bucket_number(place)).join(F.broadcast(table_), "part")  # at most 513 rows of 4 kB
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = met.where(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1).select("d", "h", "text")
    found = likely.join(linked, ["d", "h"]).select("root", "c", F.pandas_udf(_shingles, "array<bigint>")(F.col("text")).alias("grams"))
    sets = durable(found.groupBy("root", "c").agg(F.first("grams").alias("grams")), "shingles")  # equal rows are one class's twice
    parts = sets.groupBy("root").agg(F.ceil(F.sum(F.size("grams") + F.lit(PART_TEXT)) / F.lit(PART)).alias("parts")).where("parts > 1")
    n = F.coalesce("parts", F.lit(1).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
    dealt = sets.join(parts, "root", "left").select("root", "c", "grams", F.pmod(F.xxhash64("c"), n).alias("part"), other)
    rows = dealt.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "c", "grams")
    return rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "c").mapInArrow(_alike, "a long, b long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest id, null ids last.

    Similar: 5-word shingles that agree to 0.8 or more (Jaccard), or equal sketches. 1024-bit SimHash sketches propose components; within each,
    pivot distances of the shingles discard pairs, and the rest are verified before anything goes. Texts that differ in case of A-Z
    and white space alone are equal; all texts without words are. Rows are told apart by id and a hash of the
    text, so ids may repeat; of equal rows one stays. An empty table stays empty; a text of any length counts as a whole.
    """
    made = F.pandas_udf(_sketches, "array<bigint>")(F.col("text"))
    own_d, own_h = row_key()
    marked = durable(docs.select(F.col("doc_id").isNull().alias("missing"), own_d.alias("d"), own_h.alias("h"), made.alias("sketch")), "sketches")
    first = F.min(F.struct("missing", "d", "h")).alias("first")
    ordered = marked.groupBy("sketch").agg(first).orderBy("first")  # c follows the order of the rows that stay
    classes = durable(ordered.select(F.monotonically_increasing_id().alias("c"), "sketch", "first"), "sketch-classes")
    tree = components(alike(similar(classes), classes, docs.select(own_d.alias("d"), own_h.alias("h"), "text")))
    rooted = classes.select("c", "first").join(tree, classes.c == tree.node, "left").groupBy(F.coalesce("root", "c")).agg(F.min("first").alias("first"))
    kept = durable(rooted.select("first.d", "first.h").distinct(), "kept")
    d, h, nth = unused(docs, "d", "h", "nth")
    same = docs.select(*columns_of(docs), own_d.alias(d), own_h.alias(h)).join(kept.toDF(d, h), [d, h], "left_semi")
    first = F.row_number().over(W.partitionBy(d, h).orderBy(F.lit(1)))  # dealt out as the join is
    return same.withColumn(nth, first).where(F.col(nth) == 1).select(*columns_of(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def fingerprint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of given fingerprints, which SQL can express: ids spread over 22 bits, so that many lie near each other."""
    near = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 2654435761) % 4194301).alias("fp"))
    rooted = _rooted(near)
    least = near.join(rooted, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return near.join(rooted, "fp").join(least, "root").select("doc_id", "fp", "component_id")


QUERIES = {"op6_simhash": op6_simhash, "fingerprint_components": fingerprint_components}
ORACLE_SQL = {
    "fingerprint_components": """
WITH RECURSIVE d AS (SELECT doc_id, CAST(doc_id * 2654435761 % 4194301 AS BIGINT) AS fp FROM documents),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON bit_count(xor(a.fp, b.fp)) <= 2),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT d.doc_id, fp, min(t.b) AS component_id FROM d JOIN t ON t.a = d.doc_id GROUP BY d.doc_id, fp"""
}
