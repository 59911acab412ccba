"""Substring dedup by super-k-mer partitioning.

A window is 35 consecutive words. Its minimiser is the least hash among its 4-word
grams. Consecutive windows of a document that share a minimiser form a super-k-mer and
travel as one packed string, so a document is shuffled about three times instead of 35.

1. Per document: the words, and for each super-k-mer its start and a 128-bit key.
2. Packing: equal super-k-mers of a task collapse to one line (once, or more often); lines
   go to their minimiser's bucket, compressed together.
3. Buckets stream through their tasks in order, so memory follows the distinct strings of one of
   them, never the copies; their number follows the input. In a bucket, equal lines collapse again. Windows are sorted by a rolling hash, equal
   neighbours are compared word by word, and those that start at two places or more are marked.
4. A bucket with too many distinct strings (those around a passage that very many documents share) is dealt
   anew, by a second key that equal windows share: a 128-bit hash of the window. Tasks that meet such a bucket while they pack
   send its windows that way at once, and leave word of it, so that what others packed follows.
5. The marks return to the documents by super-k-mer key: a join whose hot side adaptive
   execution can split. Only documents with a mark read their text again.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

WINDOW = 35
GRAM = 4
#: Packed words that a bucket holds, about.
BUCKET_WORDS = 30_000
#: Bytes of distinct strings above which a task deals a bucket's windows by their hashes: when it packs, and when it counts.
HOT_PACKED, HOT_COUNTED = 1 << 20, 64 << 20
#: Packed bytes that a task holds before it sends them on.
PACK_BYTES = 48 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


#: Bytes of text that are taken apart at once.
SLICE_BYTES = 4 << 20
#: Bytes that are hashed at once.
HASH_BYTES = 1 << 19
_TABLE = np.random.default_rng(35).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as many as were needed so far."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + n // 4, b, dtype=np.uint64)]), dtype=np.uint64) for b in self.bases)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(int(_ODD[0])), _Powers(int(_ODD[1]))


def _runs_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hash modulo 2^64 of each run of ``values``: a difference of prefix sums, shifted back to power 0."""
    up, down = powers.of(len(values) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1], dtype=np.uint64)])
    return _mixed((prefix[ends] - prefix[starts]) * down[starts])


def spaced(text: str | None) -> bytes:
    """The words of a text, joined by one space."""
    data = (text or "").encode().translate(_SPACES)
    return b" ".join(data.split()) if b"  " in data or data[:1] == b" " or data[-1:] == b" " else data


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a spaced text."""
    flat = np.frombuffer(data, dtype=np.uint8)
    gaps = np.nonzero((flat == 32) | (flat == 10))[0]
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(flat))
    h = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(flat), HASH_BYTES)), len(starts))).tolist()
    for i, j in zip(cuts, cuts[1:]):
        low, high = starts[i], ends[j - 1]
        h[i:j] = _runs_hashed(_TABLE[flat[low:high]], starts[i:j] - low, ends[i:j] - low, _BYTE_POWERS)
    return starts, ends, h


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of a spaced text."""
    return _words(data)[2]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[: len(x) - done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def super_kmers(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Super-k-mers of some spaced texts: text and first word of each, its minimiser, its string; then all word counts."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if counts.sum() < window:
        return none, none, none.astype(np.uint64), [], counts
    data = b" ".join([t for t in texts if t])
    starts, ends, h = _words(data)
    grams = h[: len(h) - GRAM + 1] * _ODD[0]
    for k in range(1, GRAM):
        grams = grams + h[k : len(h) - GRAM + 1 + k] * _ODD[k]
    least = _sliding_min(_mixed(grams), window - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = len(least)
    valid = np.arange(n) + window <= bounds[owner[:n] + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])
    first = np.nonzero(new)[0]
    if not len(first):
        return none, none, none.astype(np.uint64), [], counts
    # a super-k-mer's windows go on to the next one's first, or to the text's last window
    last = np.minimum(np.append(first[1:], n), bounds[owner[first] + 1] - window + 1) + window - 2
    packed = [data[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist())]
    return owner[first], first - bounds[owner[first]], least[first], packed, counts


def _keys(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit key of each super-k-mer."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sliced(column) -> Iterator[list[bytes]]:
    """The spaced texts of an Arrow column in slices of bounded size."""
    held, size = [], 0
    for value in column:
        held.append(spaced(value.as_py()))
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    yield held


def _describe(window: int):
    """Rows (doc_id, d, h, text) to (doc_id, d, h, word count, digest of all words, super-k-mer starts and keys)."""

    def run(batches):
        for batch in batches:
            at = 0
            for texts in _sliced(batch.column(3)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                owner, first, _, packed, counts = super_kmers(texts, window)
                k1, k2 = _keys(packed)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((first, pa.int32()), (k1, pa.int64()), (k2, pa.int64()))]
                digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts, pa.int64()), digests, *lists], names=["doc_id", "d", "h", "n_words", "kept_sha256", "starts", "k1", "k2"])

    return run


_WINDOW = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("w1", "<i8"), ("w2", "<i8"), ("at", "<i4"), ("times", "<i4")])


def hashed_windows(lines: dict[bytes, int], window: int = WINDOW) -> np.ndarray:
    """Each window of some super-k-mers: their key, the window's hash, its place in them, how often they occur."""
    parts = []
    for packed, times in lines.items():
        _, finishes, _ = _words(packed)
        begins = np.concatenate([[0], finishes[:-1] + 1])
        n = len(finishes) - window + 1
        out = np.zeros(n, dtype=_WINDOW)
        out["k1"], out["k2"] = np.frombuffer(xxhash.xxh3_128_digest(packed), dtype=np.int64)
        found = [xxhash.xxh3_128_digest(packed[i:j]) for i, j in zip(begins[:n].tolist(), finishes[window - 1 :].tolist())]
        out["w1"], out["w2"] = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2).T
        out["at"], out["times"] = np.arange(n), times
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=_WINDOW)


def _pack(window: int, buckets: int):
    """Texts to (bucket, blob): a blob's lines are distinct super-k-mers, led by 1, or 2 if seen more often.

    Of a hot bucket an empty blob gives word; its hashed windows go to places of their own, below 0.
    """

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        held: dict[int, dict[bytes, int]] = defaultdict(dict)
        size = 0

        def rows(ids, packed):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "blob"])

        def blobs():
            for at in range(0, len(ids := list(held)), 64):
                part, packed = ids[at : at + 64], []
                for b in part:
                    if sum(map(len, held[b])) > HOT_PACKED:
                        packed.append(b"")
                        windows = hashed_windows(held[b], window)
                        for i in range(0, len(windows), 1 << 15):
                            yield rows([-1 - (int(windows["k1"][i]) & 0xFFFF)], [windows[i : i + (1 << 15)].tobytes()])
                    else:
                        packed.append(squeeze.compress(b"\n".join([b"%d %b" % (n, s) for s, n in held[b].items()])))
                yield rows(part, packed)
            held.clear()

        for batch in batches:
            for texts in _sliced(batch.column(0)):
                _, _, least, packed, _ = super_kmers(texts, window)
                to = (_mixed(least * _ODD[1]) % np.uint64(buckets)).tolist()
                for bucket, line in zip(to, packed):
                    own = held[bucket]
                    own[line] = 2 if line in own else 1
                size += sum(map(len, packed))
                if size > PACK_BYTES:
                    yield from blobs()
                    size = 0
        yield from blobs()

    return run


def repeated_windows(lines: dict[bytes, int], window: int = WINDOW) -> tuple[list[bytes], list[np.ndarray]]:
    """Super-k-mers with a window that starts at two places or more, and which of their windows do.

    ``lines``: super-k-mers and how often each occurs (2 stands for more).
    """
    packed = list(lines)
    if not packed:
        return [], []
    data = b"\n".join(packed)
    begins, finishes, h = _words(data)
    lengths = np.array([s.count(b" ") + 1 for s in packed], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(packed)), lengths)
    starts = np.nonzero(np.arange(len(h)) + window <= offsets[owner + 1])[0]
    owner = owner[starts]
    hashed = _runs_hashed(h, starts, starts + window, _WORD_POWERS)
    order = np.argsort(hashed)
    same = hashed[order[:-1]] == hashed[order[1:]]
    a, b = begins[starts], finishes[starts + window - 1]
    x, y = order[:-1][same], order[1:][same]
    differs = [i for i, (p, q, r, s) in enumerate(zip(a[x].tolist(), b[x].tolist(), a[y].tolist(), b[y].tolist())) if data[p:q] != data[r:s]]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    if differs:  # colliding hashes: number these windows by their strings
        clash = np.nonzero(np.isin(hashed, hashed[x[differs]]))[0]
        numbers: dict[bytes, int] = {}
        group[clash] = [len(order) + numbers.setdefault(data[a[i] : b[i]], len(numbers)) for i in clash]
    times = np.fromiter(lines.values(), dtype=np.int64, count=len(packed))
    marked = (np.bincount(group, weights=times[owner]) >= 2)[group]
    ends = np.cumsum(lengths - window + 1)
    found = np.unique(owner[marked]).tolist()
    return [packed[i] for i in found], [marked[ends[i] - (lengths[i] - window + 1) : ends[i]] for i in found]


_MARKS = "k1 long, k2 long, mask binary, w1 long, w2 long, at int, times int"
#: Bytes of distinct strings that are counted at once, of many small buckets.
COUNTED_BYTES = 4 << 20


def _count(window: int):
    """(bucket, blob) of one partition, in that order, to the marks (``_MARKS``).

    Of super-k-mers with a repeated window: key and mask. Of each window in hot buckets: key, hash, place, times.
    """

    def masked(lines):
        packed, marked = repeated_windows(lines, window)
        k1, k2 = _keys(packed)
        none = [pa.nulls(len(packed), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([np.packbits(m).tobytes() for m in marked], pa.binary()), *none], names=names)

    def hashed(windows):
        columns = [pa.array(np.ascontiguousarray(windows[n])) for n in ("k1", "k2", "w1", "w2", "at", "times")]
        return pa.RecordBatch.from_arrays([*columns[:2], pa.nulls(len(windows), pa.binary()), *columns[2:]], names=names)

    names = [c.split()[0] for c in _MARKS.split(", ")]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        ready, lines, size, ready_size, bucket, hot = {}, {}, 0, 0, None, False

        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if to < 0:
                    yield hashed(np.frombuffer(blob, dtype=_WINDOW))
                    continue
                if to != bucket:
                    if hot:
                        yield hashed(hashed_windows(lines, window))
                    else:  # lines of different buckets differ
                        ready |= lines
                        ready_size += size
                    if ready_size > COUNTED_BYTES:
                        yield masked(ready)
                        ready, ready_size = {}, 0
                    lines, size, bucket, hot = {}, 0, to, False
                if not blob:  # word of a hot bucket comes before its blobs
                    hot = True
                    continue
                for line in open_.decompress(blob).split(b"\n"):
                    packed = line[2:]
                    if packed in lines:
                        lines[packed] = 2
                    else:
                        lines[packed] = int(line[:1])
                        size += len(packed)
                hot = hot or size > HOT_COUNTED
                if hot and size > COUNTED_BYTES:
                    yield hashed(hashed_windows(lines, window))
                    lines, size = {}, 0
        if hot:
            yield hashed(hashed_windows(lines, window))
        else:
            ready |= lines
        yield masked(ready)

    return run


def _cut(window: int):
    """Rows (doc_id, text, starts, masks) to (doc_id, n_words, n_removed, kept_sha256)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, starts, masks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for start, mask in zip(starts, masks):
                    at = start + np.nonzero(np.unpackbits(np.frombuffer(mask, dtype=np.uint8)))[0]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out)) or [(), (), ()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs`` (doc_id, text).

    Words inside a ``window``-word sequence that starts anywhere else too, in the same
    document or another, are removed; all windows are judged on the input. The digest is of
    the kept words, joined by one space. Null, empty and short texts have no windows.
    Repeated rows repeat each other, so all their windows go. Null ids and very long texts
    are treated like others; further columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, d {kind}, h long, n_words long, kept_sha256 string, starts array<int>, k1 array<long>, k2 array<long>"
    described = durable(docs.select("doc_id", "d", "h", "text").mapInArrow(_describe(window), columns), "substring-docs")
    total = described.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(128, total * 3 // BUCKET_WORDS)
    sent = docs.where("text IS NOT NULL").select("text").mapInArrow(_pack(window, buckets), "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket", "blob")
    marks = durable(sent.mapInArrow(_count(window), _MARKS), "substring-marks")
    hot = marks.where("mask IS NULL")
    again = hot.join(hot.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1").select("w1", "w2"), ["w1", "w2"])
    marks = marks.where("mask IS NOT NULL").select("k1", "k2", F.lit(0).alias("at"), "mask").unionByName(again.select("k1", "k2", "at", F.lit(b"\x80").alias("mask")).distinct())
    places = described.select("d", "h", F.explode(F.arrays_zip("starts", "k1", "k2")).alias("x")).select("d", "h", "x.*")
    hit = places.join(marks, ["k1", "k2"]).groupBy("d", "h").agg(F.collect_set(F.struct((F.col("starts") + F.col("at")).alias("starts"), "mask")).alias("found"))  # equal rows share theirs
    hit = durable(hit.select("d", "h", "found.starts", "found.mask"), "substring-hits")
    cut = docs.join(hit, ["d", "h"]).select("doc_id", "text", "starts", "mask").mapInArrow(_cut(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    whole = described.join(hit.select("d", "h"), ["d", "h"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.unionByName(cut)


def op3_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word passages of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op3_superkmer_dedup": op3_superkmer_dedup}
ORACLE_SQL = {
    "op3_superkmer_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT rid, s, array_to_string(w[s : s + 34], ' ') AS win FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, s FROM win WHERE win IN (SELECT win FROM win GROUP BY win HAVING count(*) > 1)),
cov AS (SELECT DISTINCT rid, unnest(generate_series(s, s + 34)) AS p FROM rep),
pos AS (SELECT rid, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT pos.rid, string_agg(word, ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos LEFT JOIN cov ON pos.rid = cov.rid AND pos.p = cov.p WHERE cov.p IS NULL GROUP BY pos.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""
}
