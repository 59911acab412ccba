"""Prefix trie of conversations: a Cartesian tree over the LCP array of sorted conversations.

Sorted by their turns, the conversations below a trie node lie side by side. So a node is
an interval of the sorted order, and everything asked of it a sum or a minimum over that.

1. A turn is a 128-bit hash of role and text, a conversation the string of its turns' hashes. Texts don't move.
2. Strings are range-partitioned and sorted with their ids, so equal ones spread over ranges too. A range is a
   block. Its longest common prefixes of neighbours (LCP) give, by nearest smaller values to both sides,
   the nodes of a Cartesian tree; those of equal LCP merge, and each stands for all depths down to its parent's.
3. Sums over an interval are differences of running sums. What is inside a block is done there.
4. Nodes that touch a block's end leave a part for each depth. They meet in the block where the node begins: the nearest
   earlier one whose minimum, the LCP with its predecessor included, is smaller than the depth. The driver keeps two numbers and two strings a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Bytes of a turn's hash.
UNIT = 16
#: Conversations and bytes of hashes in a block, about.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 32 << 20
#: Conversations whose ids differ from a multiple of this share its first turns in the query.
FAMILY, MOST_SHARED = 100, 5
_NOTHING = hashlib.sha256(b"").hexdigest()
_INSIDE, _LEFT, _RIGHT, _EDGE = range(4)
_ROWS = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved", "before", "extends")), ("ref_kind", pa.int32()), ("ref_depth", pa.int64()), ("sha", pa.string()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("chars", pa.list_(pa.int64()))]
)
_DDL = "kind int, block long, depth long, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved long, before long, extends long, ref_kind int, ref_depth long, sha string, ends string, first binary, last binary, chars array<long>"


def common_units(a: bytes, b: bytes) -> int:
    """Turns that two strings of hashes have in common from the start."""
    low, high = 0, min(len(a), len(b)) // UNIT
    if a[: high * UNIT] == b[: high * UNIT]:
        return high
    while low < high - 1:  # equal up to low, different by high
        mid = (low + high) // 2
        if a[low * UNIT : mid * UNIT] == b[low * UNIT : mid * UNIT]:
            low = mid
        else:
            high = mid
    return low


def nearest_smaller(lcp: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each inner place of ``lcp`` (ends: -1), the nearest smaller places to both sides, and the first place of its interval that has the same value."""
    n = len(lcp) - 1
    left, right, same, stack = [0] * (n + 1), [n] * (n + 1), list(range(n + 1)), [0]
    for i in range(1, n):
        while lcp[stack[-1]] > lcp[i]:
            right[same[stack.pop()]] = i
        if lcp[stack[-1]] == lcp[i]:
            same[i] = same[stack.pop()]
        else:
            left[i] = stack[-1]
        stack.append(i)
    return np.array(left), np.array(right), np.array(same)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of each stretch low..high, from minima over powers of two."""
    powers = [values]
    while 2 << (len(powers) - 1) <= len(values):
        half = 1 << (len(powers) - 1)
        powers.append(np.minimum(powers[-1][:-half], powers[-1][half:]))
    k = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), dtype=np.int64)
    for level, row in enumerate(powers):
        here = k == level
        out[here] = np.minimum(row[low[here]], row[high[here] - (1 << level) + 1])
    return out


def block_nodes(block: int, ids: np.ndarray, keys: list[bytes], chars: np.ndarray, at: np.ndarray) -> pa.Table:
    """All that one block of sorted conversations knows: its inner nodes, its parts of nodes that touch an end, its edges.

    chars: lengths of all turns, conversation by conversation; at: where each one's begin.
    """
    n = len(ids)
    lcp = np.full(n + 1, -1, dtype=np.int64)
    lcp[1:n] = [common_units(a, b) for a, b in zip(keys, keys[1:])]
    length = np.array([len(k) // UNIT for k in keys], dtype=np.int64)
    running = np.concatenate([[0], np.cumsum(chars)])
    shared = running[at[:n] + np.maximum(lcp[:n], 0)] - running[at[:n]]
    sums = np.cumsum(shared)
    ends = np.cumsum(np.concatenate([[0], lcp[1:n] < length[:-1]]))  # ends of branches so far
    left, right, same = nearest_smaller(lcp.tolist())
    inner = np.nonzero((same == np.arange(n + 1)) & (np.arange(n + 1) > 0) & (np.arange(n + 1) < n))[0]
    place = np.zeros(n + 1, dtype=np.int64)
    place[inner] = np.arange(len(inner))
    branches = np.bincount(place[same[1:n]], weights=length[1:n] > lcp[1:n], minlength=len(inner))[: len(inner)].astype(np.int64)
    alone = np.nonzero(length > np.maximum(lcp[:n], lcp[1:]))[0]
    low, high = np.concatenate([left[inner], alone]), np.concatenate([right[inner] - 1, alone])
    bottom, births = np.concatenate([lcp[inner], length[alone]]), np.concatenate([branches, np.zeros(len(alone), dtype=np.int64)])
    top = np.maximum(lcp[low], lcp[high + 1])
    least = _least(ids, low, high)
    above = place[same[np.where(lcp[low] >= lcp[high + 1], low, high + 1)]]  # the interval around; none around the whole block

    deep = bottom - top
    of = np.repeat(np.arange(len(low)), deep)
    depth = top[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(deep) - deep, deep)
    a, b = low[of], high[of]
    kind = np.where(a == 0, _LEFT, np.where(b == n - 1, _RIGHT, _INSIDE))
    within = kind == _INSIDE
    before = running[at[a] + np.maximum(depth - 1, 0)] - running[at[a]]
    extends, born = (length[a] > depth).astype(np.int64), np.where(depth == bottom[of], births[of], 0)
    n_convs = b - a + 1
    saved = sums[b] - sums[a]
    first = depth == top[of] + 1
    up = above[of]
    up_kind = np.where(low[up] == 0, _LEFT, np.where(high[up] == n - 1, _RIGHT, _INSIDE)) if len(low) else kind
    known = within & (~first | (up_kind == _INSIDE))
    refers = within & ~known

    stop = np.ones(n, dtype=bool)  # the last of equal conversations
    stop[:-1] = ~((lcp[1:n] == length[:-1]) & (length[1:] == length[:-1]))
    stops = np.nonzero(stop)[0]
    sha, listed = np.full(len(of), _NOTHING, dtype=object), np.full(len(of), None, dtype=object)
    for i in np.nonzero(length[a] == depth)[0].tolist():
        text = ",".join(map(str, ids[a[i] : stops[np.searchsorted(stops, a[i])] + 1].tolist()))
        if within[i]:
            sha[i] = hashlib.sha256(text.encode()).hexdigest()
        else:
            listed[i] = text
    nothing = np.zeros(len(of), dtype=bool)
    masked = lambda x, keep, t: pa.array(x, type=t, mask=~keep)
    rows = pa.table(
        [
            pa.array(kind, pa.int32()), pa.array(np.full(len(of), block)), pa.array(depth), pa.array(least[of]),
            masked(np.where(first, least[up] if len(least) else 0, least[of]), known, pa.int64()),
            pa.array(n_convs), pa.array(born + np.where(within, extends, 0)), pa.array(ends[b] - ends[a] + within), pa.array(saved - np.where(within, (n_convs - 1) * before, 0)),
            pa.array(before), pa.array(extends), masked(up_kind, refers, pa.int32()), masked(top[of], refers, pa.int64()),
            pa.array(sha, pa.string()), pa.array(listed, pa.string()), masked(np.full(len(of), b"", dtype=object), nothing, pa.binary()), masked(np.full(len(of), b"", dtype=object), nothing, pa.binary()), pa.nulls(len(of), pa.list_(pa.int64())),
        ],
        schema=_ROWS,
    )
    edge = dict.fromkeys(_ROWS.names) | {"kind": _EDGE, "block": block, "depth": int(lcp[1:n].min()) if n > 1 else int(length[0]), "n_convs": n, "first": keys[0], "last": keys[-1], "chars": chars[at[0] : at[0] + length[0]].tolist()}
    return pa.concat_tables([rows, pa.Table.from_pylist([edge], schema=_ROWS)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [x for x in batches if x.num_rows]
    if held:
        ids, keys, chars = (pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in range(3))
        size = pa.compute.list_value_length(chars).to_numpy()
        yield from block_nodes(TaskContext.get().partitionId(), ids.to_numpy(), keys.to_pylist(), chars.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])).to_batches(1 << 16)


class Edges:
    """What of its neighbours a block's parts need: few numbers a block."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["block"])
        self.block = np.array([r["block"] for r in rows], dtype=np.int64)
        self.inner = np.array([r["depth"] for r in rows], dtype=np.int64)
        self.back = np.array([-1, *(common_units(a["last"], b["first"]) for a, b in zip(rows, rows[1:]))], dtype=np.int64)[: len(rows)]
        self.minima = np.minimum(self.inner, self.back)
        self.length = np.array([len(r["first"]) // UNIT for r in rows], dtype=np.int64)
        self.branch = np.array([False, *(back < len(r["last"]) // UNIT for r, back in zip(rows, self.back[1:].tolist()))], dtype=np.int64)[: len(rows)]
        self.shared = np.array([sum(r["chars"][: max(0, back)]) for r, back in zip(rows, self.back.tolist())], dtype=np.int64)

    def home(self, i: np.ndarray, kind: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the block in which the nodes that parts belong to begin, and the kind of the part there."""
        at, side = i.copy(), kind.copy()
        open_ = (kind == _LEFT) & (depth >= 0) & (depth <= self.back[i])
        for d in np.unique(depth[open_]):
            here = open_ & (depth == d)
            smaller = np.nonzero(self.minima < d)[0]
            at[here] = smaller[np.searchsorted(smaller, i[here]) - 1]
        side[open_] = np.where(depth[open_] <= self.inner[at[open_]], _LEFT, _RIGHT)
        return at, side

    def resolve(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts with the key of their node and of its parent, and with what they add to its sums."""
        for batch in batches:
            kind, block, depth = (batch.column(i).to_numpy() for i in range(3))
            i = np.searchsorted(self.block, block)
            at, side = self.home(i, kind, depth)
            own = (at == i) & (side == kind)
            up, up_side = self.home(at, np.where((side == _RIGHT) & (depth - 1 <= self.inner[at]), _LEFT, side), depth - 1)
            births, leaves, saved, extends = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_children", "n_leaves", "saved", "extends"))
            births = births + np.where(own, extends, (self.back[i] == depth) & (self.length[i] > depth))
            leaves = leaves + np.where(own, 0, self.branch[i])
            saved = saved + np.where(own, 0, self.shared[i])
            taken = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "n_convs", "before", "ends")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(self.block[at]), pa.array(side.astype(np.int32)), pa.array(self.block[up], mask=depth == 0), pa.array(up_side.astype(np.int32)), pa.array(births), pa.array(leaves), pa.array(saved), *taken],
                names=["kind", "block", "depth", "home", "side", "up", "up_side", "n_children", "n_leaves", "saved", "conv_id", "n_convs", "before", "ends"],
            )


def _hashed(rows: Iterator) -> Iterator[tuple]:
    """SHA-256 of each node's lists of ids, which come in order; none is held whole."""
    key, sha, more = None, None, False
    for r in rows:
        if (r["home"], r["side"], r["depth"]) != key:
            if key is not None:
                yield (*key, sha.hexdigest())
            key, sha, more = (r["home"], r["side"], r["depth"]), hashlib.sha256(), False
        sha.update((b"," if more else b"") + r["ends"].encode())
        more = True
    if key is not None:
        yield (*key, sha.hexdigest())


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` (array of turn, hash, chars, in order) of each conversation of ``turns`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").alias("turn"), F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * UNIT).alias("h"), F.length(text).cast("long").alias("chars"))
    return turns.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, turns as ``sequences`` gives them).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of
    each distinct sequence of first turns, the empty one included: its smallest member and its parent's, members, children,
    childless nodes below or itself, characters that members share with one another from here on, and the hash of the ids that end here.

    Turns are the same if role and text are; null ones count as empty. Order is by turn, null first, then by the
    hash of role and text, so ties have one. Rows without conv_id belong to no conversation; repeated rows are turns of their own.
    Conversations without turns are members of the root. Texts may be of any length, as only hashes move: 16 bytes a
    turn, so that one conversation of a million turns is one value of 16 MB. An empty table has no nodes.
    """
    spark = conversations.sparkSession
    flat = conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["h"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    held = durable(flat, "conversations")
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    ranged = held.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = durable(ranged.mapInArrow(_blocks, _DDL), "trie-blocks")
    edges = Edges(made.where(F.col("kind") == _EDGE).select("block", "depth", "first", "last", "chars").collect())  # a row a block
    parts = made.where(F.col("kind").isin(_LEFT, _RIGHT)).select("kind", "block", "depth", "n_children", "n_leaves", "saved", "extends", "conv_id", "n_convs", "before", "ends")
    known = durable(parts.mapInArrow(edges.resolve, "kind int, block long, depth long, home long, side int, up long, up_side int, n_children long, n_leaves long, saved long, conv_id long, n_convs long, before long, ends string"), "trie-parts")
    node = ["home", "side", "depth"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = known.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.first("up").alias("up"), F.first("up_side").alias("up_side"), F.first("before").alias("before"), *sums)
    listed = known.where("ends IS NOT NULL").select(*node, "block", "ends").repartition(*node).sortWithinPartitions(*node, "block")
    hashed = spark.createDataFrame(listed.rdd.mapPartitions(_hashed), "home long, side int, depth long, sha string")
    merged = durable(merged.join(hashed, node, "left"), "trie-merged")
    names = merged.select(*node, "conv_id")
    above = names.select(F.col("home").alias("up"), F.col("side").alias("up_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256")
    saved = (F.col("saved") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens")
    spanning = merged.join(above, ["up", "up_side", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + 1).alias("n_leaves"), saved, ends)
    inside = made.where(F.col("kind") == _INSIDE)
    own = [F.col(c) for c in ("n_convs", "n_children", "n_leaves")] + [F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256")]
    owners = known.select("block", F.col("kind").alias("ref_kind"), F.col("depth").alias("ref_depth"), "home", "side", "depth").join(names, node).select("block", "ref_kind", "ref_depth", F.col("conv_id").alias("parent_conv_id"))
    below = inside.where("ref_kind IS NOT NULL").join(owners, ["block", "ref_kind", "ref_depth"]).select("conv_id", "depth", "parent_conv_id", *own)
    rest = inside.where("ref_kind IS NULL").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *own)
    return rest.unionByName(below).unionByName(spanning)


def with_shared_heads(conversations: DataFrame) -> DataFrame:
    """Each conversation of ``sequences`` behind the first turns of the one that its hundred begins with, in place of as many of its own: crc32 of its id mod 6."""
    base, shared = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    own = durable(conversations, "own-turns")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    met = own.withColumns({"base": base, "shared": shared.cast("int")}).join(heads, "base", "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("shared")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns") - F.col("shared"), F.lit(0)))
    return met.select("conv_id", F.concat(first, rest).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads."""
    return trie(with_shared_heads(sequences(table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {
    "op13_prefix_trie": r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, ts, CAST(xor(list_reduce([ascii(c) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')],
      lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295) % 6 AS BIGINT) AS h FROM own, tab),
c AS (
  SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (
  SELECT conv_id, CAST(len(ts) AS BIGINT) AS n, CAST(d AS BIGINT) AS depth, sha256(CAST(to_json(ts[1:d]) AS VARCHAR)) AS node,
         CASE WHEN d > 0 THEN sha256(CAST(to_json(ts[1:d - 1]) AS VARCHAR)) END AS parent, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM c)),
g AS (
  SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL),
k AS (SELECT parent AS node, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY parent),
a AS (  -- each node under all that stand above it, and itself
  SELECT DISTINCT u.node AS top, v.node FROM p u JOIN p v ON u.conv_id = v.conv_id AND v.depth >= u.depth),
s AS (
  SELECT a.top AS node, CAST(sum(g.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM a JOIN g ON g.node = a.node LEFT JOIN k ON k.node = g.node GROUP BY a.top)
SELECT g.conv_id, g.depth, q.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM g JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN g q ON q.node = g.parent"""
}
