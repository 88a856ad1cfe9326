"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are first united. Each tree splits recursively by random
directions at the median; a vector near a split (by `spill`) goes to both sides.
Only vectors that meet in a leaf are compared, by cosine in double precision, so
nothing below the threshold is linked; the trees together find what one tree
parts. A pair that meets in several leaves is counted in the first of them only.

Splits come from a bounded sample of the vectors (SAMPLE rows at most); every
vector is then indexed. Below the depth that the sample supports, a node takes
the median of its last ancestor that the sample does support. A split that most
vectors of a node lie close to would only copy them, so such a node is not split.

Vectors travel to the upper nodes of a tree, many in one row, and the task that
has a node goes on to its leaves. A leaf expected to hold many times BLOCK
vectors travels by itself in pairs of blocks, so a task holds at most about two
blocks of it. Projections are sums of whole numbers, exact in any order, so every
task finds the same leaves for a vector and no list of leaves travels. The nodes
are dealt over rounds that each shuffle at most about twice the vectors' bytes (or
ROUND bytes); a round's shuffle files go before the next. A node gives counts per
vector and a spanning forest of its links, never its pairs.

Recall: with the defaults, a pair at cosine 0.95 is parted by one split with a
chance near 1.2 %, so by all of six trees of depth 13 with a chance near 1e-5, of
depth 17 (some 30 million vectors) near 5e-5; the tests measure it against brute
force.

Vectors that are null, empty, zero or hold null or non-finite parts, and rows of
null vec_id, link with nothing: n_links 0, component_id = vec_id. Vectors of
different length don't link. Rows that repeat a vec_id with the same vector are
equal vectors; with another vector they count as one vector with the links of
both. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Table, components, ship

TREES, LEAF, BLOCK, SAMPLE = 6, 256, 2000, 65_536
SPILL = 0.2  # reach of a split to either side, in parts of 1 / sqrt(vector length)
DEPTH = 20  # at most; beyond, leaves grow
NODE, CHUNK, ROUND = 2**24, 2**24, 2**28  # bytes: vectors of an upper node, vectors routed at once, a round's shuffle
PAIRS = 1_000_000  # pairs held before they are counted
SCALE = float(1 << 22)  # directions and unit vectors in whole parts of it: products of two are exact, and their sums
FOUND = "a long, b long, links long"  # b null: links counted at a; else a link


@dataclass
class Forest:
    """For one vector length: directions (tree, part, level), split values by
    tree and node (heap order; infinite: not split) and blocks by leaf."""

    directions: np.ndarray
    splits: np.ndarray
    blocks: np.ndarray

    @property
    def depth(self) -> int:
        return self.directions.shape[2]

    def project(self, unit: np.ndarray, tree: int) -> np.ndarray:
        return np.rint(unit * SCALE) @ self.directions[tree]

    def down(self, tree: int, at: np.ndarray, row: np.ndarray, node: np.ndarray, levels: range, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and nodes (heap order) below the given ones, after these levels."""
        reach = spill / math.sqrt(self.directions.shape[1]) * SCALE**2
        for level in levels:
            x, split = at[row, level], self.splits[tree, node]
            left, right = x <= split + reach, x >= split - reach
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node

    def tree_leaves(self, unit: np.ndarray, tree: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(len(unit)), np.ones(len(unit), np.int64)
        row, node = self.down(tree, self.project(unit, tree), *start, range(self.depth), spill)
        return row, node - (1 << self.depth) + (tree << self.depth)

    def nearest(self, unit: np.ndarray, tree: int) -> np.ndarray:
        """The one leaf of each row without spill."""
        at, node = self.project(unit, tree), np.ones(len(unit), np.int64)
        for level in range(self.depth):
            node = 2 * node + (at[:, level] > self.splits[tree, node])
        return node - (1 << self.depth) + (tree << self.depth)

    def leaves(self, unit: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
        """row and leaf (tree * 2 ** depth + number) of every membership."""
        found = [self.tree_leaves(unit, t, spill) for t in range(len(self.directions))]
        return np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])


def grow(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, spill: float = SPILL, seed: int = 7) -> Forest:
    """Forest for `total` vectors of which `sample` (unit rows) is a fair sample."""
    n, dim = sample.shape
    depth = max(0, min(math.ceil(math.log2(max(1, total / leaf))), DEPTH))
    known = int(math.log2(max(1, n / 8)))  # levels whose nodes hold eight rows of the sample
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, dim, depth))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
    out = Forest(np.rint(directions * SCALE), np.zeros((trees, 1 << depth)), np.ones(trees << depth, np.int64))
    reach = spill / math.sqrt(dim) * SCALE**2
    for t in range(trees):
        at, node = out.project(sample, t), np.ones(n, np.int64)
        for level in range(depth):
            below = max(0, level - known)
            group, first = node >> below, 1 << (level - below)
            order = np.lexsort((at[:, level], group))
            edges = np.searchsorted(group[order], np.arange(first, 2 * first + 1))
            middle = np.minimum((edges[:-1] + edges[1:]) // 2, n - 1)
            split = at[order[middle], level]
            close = np.bincount(group - first, np.abs(at[:, level] - split[group - first]) <= reach, first)
            split[2 * close > np.diff(edges)] = np.inf
            out.splits[t, 1 << level : 2 << level] = np.repeat(split, 1 << below)
            node = 2 * node + (at[:, level] > out.splits[t, node])
        found = out.tree_leaves(sample, t, spill)[1] - (t << depth)
        expected = np.bincount(found, minlength=1 << depth) * (total / n)
        out.blocks[t << depth : (t + 1) << depth] = np.where(expected > 3 * block, np.ceil(expected / block), 1)
    return out


@dataclass
class Deal:
    """How vectors travel: to nodes of level `top`, or to leaves of many blocks
    below the nodes that are `hot`; the round of each node and of each such leaf
    (-1: the leaf is dealt with in its node)."""

    top: int
    hot: np.ndarray
    node_round: np.ndarray
    leaf_round: np.ndarray
    rounds: int


def deal(forest: Forest, sample: np.ndarray, total: int, width: int, spill: float = SPILL) -> Deal:
    """width: bytes of a vector with its id."""
    n, trees, depth = len(sample), len(forest.directions), forest.depth
    top = math.ceil(math.log2(max(1, total / max(1, min(NODE // width, max(BLOCK, total // 16))))))
    top = min(top, depth)
    blocks = forest.blocks.reshape(trees, 1 << depth)
    alone = blocks > 1 if top < depth else np.ones_like(blocks, bool)
    rows = []
    for t in range(trees):
        start = np.arange(n), np.ones(n, np.int64)
        at = forest.project(sample, t)
        row, node = forest.down(t, at, *start, range(top), spill)
        held = np.bincount(node - (1 << top), minlength=1 << top)
        leaf = forest.down(t, at, row, node, range(top, depth), spill)[1] - (1 << depth)
        rows.append(np.concatenate([held * (top < depth), np.bincount(leaf, minlength=1 << depth) * blocks[t] * alone[t]]))
    ends = np.cumsum(np.concatenate(rows)) * (total / n * width)
    turn = np.floor(ends / max(ROUND, 2 * total * width)).astype(np.int32).reshape(trees, -1)
    leaf_round = np.where(alone, turn[:, 1 << top :], -1)
    hot = alone.reshape(trees, 1 << top, -1).any(axis=2)
    return Deal(top, hot, turn[:, : 1 << top], leaf_round, int(turn.max()) + 1)


def memberships(forest: Forest, plan: Deal, unit: np.ndarray, ids: np.ndarray, turn: int, spill: float) -> Iterator[tuple[np.ndarray, ...]]:
    """By tree: row, node (tree << depth + 1 | heap order), low and high block and own block of what travels in this round."""
    depth, top = forest.depth, plan.top
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    for t in range(len(forest.directions)):
        if not ((plan.node_round[t] == turn).any() or (plan.leaf_round[t] == turn).any()):
            continue
        at = forest.project(unit, t)
        row, node = forest.down(t, at, np.arange(len(unit)), np.ones(len(unit), np.int64), range(top), spill)
        hot = plan.hot[t, node - (1 << top)]
        low_row, low = forest.down(t, at, row[hot], node[hot], range(top, depth), spill)
        row, node = row[~hot], node[~hot]
        own = plan.leaf_round[t, low - (1 << depth)]
        if (rest := own < 0).any():  # other leaves of hot nodes: once to the node
            more = np.unique(np.stack([low_row[rest], low[rest] >> (depth - top)]), axis=1)
            row, node = np.concatenate([row, more[0]]), np.concatenate([node, more[1]])
        now = plan.node_round[t, node - (1 << top)] == turn
        row, node, zero = row[now], node[now], np.zeros(now.sum(), np.int64)
        low_row, low = low_row[own == turn], low[own == turn]
        many = forest.blocks[low - (1 << depth) + (t << depth)]
        mine = mixed[low_row] % many
        again = np.repeat(np.arange(len(low)), many)
        other = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
        low_row, low, mine = low_row[again], low[again], mine[again]
        yield (
            np.concatenate([row, low_row]),
            np.concatenate([node, low]) + (t << (depth + 1)),
            np.concatenate([zero, np.minimum(mine, other)]),
            np.concatenate([zero, np.maximum(mine, other)]),
            np.concatenate([zero, mine]),
        )


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of links (a, b) that hold together what all of them hold together."""
    label, used = np.arange(n), []
    while True:
        la, lb = label[a], label[b]
        open_ = np.flatnonzero(la != lb)
        if not len(open_):
            return np.unique(np.concatenate(used)) if used else np.empty(0, np.int64)
        high = np.maximum(la, lb)[open_]
        pick = open_[np.unique(high, return_index=True)[1]]  # each label joins one lower label: no cycles
        used.append(pick)
        label[np.maximum(la, lb)[pick]] = np.minimum(la, lb)[pick]
        while (label[label] != label).any():
            label = label[label]


def near(unit: np.ndarray, single: np.ndarray, rows: np.ndarray, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of these rows at or above the threshold: single precision
    leaves out what is surely below, double precision decides near it.
    side: block of each row where only pairs of different blocks count."""
    doubt = (unit.shape[1] + 4) * 2.0**-23
    own = single[rows]
    for start in range(0, len(rows), 256):
        cosine = own[start : start + 256] @ own[start:].T
        cosine.reshape(-1)[: len(cosine) * (cosine.shape[1] + 1) : cosine.shape[1] + 1] = -2  # a row with itself
        found = np.flatnonzero(cosine.max(axis=1) >= threshold - doubt)
        if not len(found):
            continue
        i, j = np.nonzero(cosine[found] >= threshold - doubt)
        i = found[i]
        i, j = i[i < j], j[i < j]
        value, i, j = cosine[i, j], rows[i + start], rows[j + start]
        if side is not None:
            apart = side[i] != side[j]
            value, i, j = value[apart], i[apart], j[apart]
        fine = value >= threshold + doubt
        close = np.flatnonzero(~fine)
        for k in range(0, len(close), 20_000):
            c = close[k : k + 20_000]
            fine[c] = np.einsum("ij,ij->i", unit[i[c]], unit[j[c]]) >= threshold
        yield i[fine], j[fine]


def first_here(forest: Forest, unit: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: np.ndarray, spill: float) -> np.ndarray:
    """Numbers of the pairs (i, j) that no leaf before their own holds together.
    The own leaves of one call are of one tree. Most pairs are settled by their
    rows' lowest, highest and nearest leaf of a tree, the rest by whole lists."""
    if not len(i):
        return np.empty(0, np.int64)
    rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    p, q, own, trees = place[: len(i)], place[len(i) :], int(leaf[0] >> forest.depth), []
    seen = np.zeros(len(i), bool)
    for t in range(own + 1):
        row, found = forest.tree_leaves(unit[rows], t, spill)
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        ends = np.searchsorted(row, np.arange(len(rows) + 1))
        trees.append((row, found, ends))
        for edge in (found[ends[:-1]], found[ends[1:] - 1], forest.nearest(unit[rows], t)):
            seen |= (edge[p] == edge[q]) & (edge[p] < leaf)
    left = np.flatnonzero(~seen)
    for t, (row, found, ends) in enumerate(trees):
        if t == own:
            low = found[ends[:-1]]
            done = np.maximum(low[p[left]], low[q[left]]) >= leaf[left]  # nothing before its own leaf
        else:
            done = np.zeros(len(left), bool)
        sure, open_ = left[done], left[~done]
        lists = np.full((len(rows), np.diff(ends).max()), -1, np.int64)
        lists[row, np.arange(len(row)) - ends[row]] = found
        kept = [sure]
        for k in range(0, len(open_), 20_000):
            part = open_[k : k + 20_000]
            a, b = lists[p[part]], lists[q[part]]
            a[a >= leaf[part, None]] = -1
            apart = np.ones(len(part), bool)
            for c in range(a.shape[1]):
                if (use := a[:, c] >= 0).any():
                    apart &= ~((a[:, c : c + 1] == b).any(axis=1) & use)
            kept.append(part[apart])
        left = np.concatenate(kept)
    return left


def leaf_links(forest: Forest, node: int, top: int, unit: np.ndarray, n: np.ndarray, side: np.ndarray | None, threshold: float, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links counted in the leaves of a node (see memberships), by row, and a
    spanning forest (a, b) of them."""
    depth, single = forest.depth, unit.astype(np.float32)
    tree, heap = node >> (depth + 1), node & ((2 << depth) - 1)
    rows, leaf = np.arange(len(unit)), np.full(len(unit), heap)
    if heap < 1 << depth:
        rows, leaf = forest.down(tree, forest.project(unit, tree), rows, leaf, range(top, depth), spill)
    leaf = leaf - (1 << depth) + (tree << depth)
    if heap < 1 << depth:
        usual = forest.blocks[leaf] == 1
        order = np.argsort(leaf[usual], kind="stable")
        rows, leaf = rows[usual][order], leaf[usual][order]
    lowest = np.empty(len(unit), np.int64)  # a row's first leaf here
    lowest[rows[::-1]] = leaf[::-1]
    links, a, b = np.zeros(len(unit)), np.empty(0, np.int64), np.empty(0, np.int64)
    held, count = [], 0

    def settle() -> None:
        nonlocal links, a, b, count
        if held:
            i, j, at = (np.concatenate(x) for x in zip(*held, strict=True))
            once = np.unique(i * len(unit) + j, return_index=True)[1]  # the first leaf here that holds the pair
            i, j, at = i[once], j[once], at[once]
            use = first_here(forest, unit, i, j, at, spill)
            i, j = i[use], j[use]
            links += np.bincount(i, n[j], len(unit)) + np.bincount(j, n[i], len(unit))
            a, b = np.concatenate([a, i]), np.concatenate([b, j])
            tied = spanning(a, b, len(unit))
            a, b = a[tied], b[tied]
        held.clear()
        count = 0

    edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        for i, j in near(unit, single, np.sort(rows[start:end]), side, threshold):
            fresh = (lowest[i] != lowest[j]) | (lowest[i] == leaf[start])  # or their first leaf has held the pair
            i, j = i[fresh], j[fresh]
            held.append((i, j, np.full(len(i), leaf[start])))
            count += len(i)
            if count >= PAIRS:
                settle()
    settle()
    return links.astype(np.int64), a, b


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["embedding"].dataType
    real = np.dtype(np.float32 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else np.float64)
    v = F.col("embedding").cast("array<float>" if real == np.float32 else "array<double>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists)
            x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).astype(real) + real.type(0)  # no -0
            ends = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            fine = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]]) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            offsets = pa.array((ends * real.itemsize).astype(np.int64))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.record_batch({"vec_id": batch.column(0), "fine": pa.array(fine), "dim": pa.array(size.astype(np.int32)), "v": data})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).mapInArrow(read, "vec_id long, fine boolean, dim int, v binary")
    keyed = rows.where("fine").select("vec_id", "dim", "v", F.xxhash64("dim", "v").alias("h1"), F.xxhash64(F.lit(1), "dim", "v").alias("h2"))
    classes = Table(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("v").alias("v")), "vectors").df
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    forests, plans = {}, {}
    for dim, n in sizes.items():
        wanted = max(1000, min(SAMPLE, 2**22 // dim))
        some = classes.where(F.col("dim") == dim)
        if n > wanted:  # by a hash, so no sort
            some = some.where(F.pmod(F.xxhash64("h1"), F.lit(1 << 40)) < int(wanted / n * (1 << 40)))
        data = some.select("v").toArrow().column("v").to_pylist()
        if not data:
            data = [some_row["v"] for some_row in classes.where(F.col("dim") == dim).select("v").limit(wanted).collect()]
        sample = unit_rows(np.frombuffer(b"".join(data), real).reshape(len(data), dim))
        forests[dim] = grow(sample, n, trees, leaf, spill=spill)
        plans[dim] = deal(forests[dim], sample, n, dim * real.itemsize + 16, spill)

    def routed(turn: int) -> DataFrame:
        def send(dim: int, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            step = max(1, 2**20 // int(forests[dim].blocks.max()))
            for start in range(0, len(ids), step):
                yield from send_part(dim, ids[start : start + step], n[start : start + step], x[start : start + step])

        def send_part(dim: int, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for row, node, low, high, side in memberships(forests[dim], plans[dim], unit_rows(x), ids, turn, spill):
                order = np.lexsort((high, low, node))
                row, node, low, high, side = (c[order] for c in (row, node, low, high, side))
                new = np.ones(len(row), bool)
                new[1:] = (np.diff(node) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
                first = np.flatnonzero(new)
                parts = [slice(*ends) for ends in zip(first, np.append(first, len(row))[1:], strict=True)]
                turns = first * x.itemsize * dim // CHUNK  # so many bytes in a batch, or one node's
                for k in np.unique(turns):
                    now = parts[slice(*np.searchsorted(turns, [k, k + 1]))]
                    at = first[turns == k]
                    yield pa.record_batch(
                        {
                            "dim": pa.array(np.full(len(now), dim, np.int32)),
                            "node": pa.array(node[at]),
                            "low": pa.array(low[at]),
                            "high": pa.array(high[at]),
                            "side": pa.array([side[p].tobytes() if low[p.start] != high[p.start] else b"" for p in now], pa.binary()),
                            "id": pa.array([ids[row[p]].tobytes() for p in now], pa.binary()),
                            "n": pa.array([n[row[p]].tobytes() for p in now], pa.binary()),
                            "v": pa.array([x[row[p]].tobytes() for p in now], pa.binary()),
                        }
                    )

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                ids, n, dims = (batch.column(k).to_numpy() for k in range(3))
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    data = batch.column(3).take(pa.array(own)).to_pylist()
                    x = np.frombuffer(b"".join(data), real).reshape(len(own), dim)
                    held.setdefault(dim, []).append((ids[own], n[own], x))
                    if sum(len(i) for i, _, _ in held[dim]) * dim * real.itemsize >= CHUNK:
                        yield from send(dim, *(np.concatenate(c) for c in zip(*held.pop(dim), strict=True)))
            for dim, some in held.items():
                yield from send(dim, *(np.concatenate(c) for c in zip(*some, strict=True)))

        return classes.select("id", "n", "dim", "v").mapInArrow(route, "dim int, node long, low long, high long, side binary, id binary, n binary, v binary")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        dim, node, low, high = (k.as_py() for k in key)
        ids, n, side = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("id", "n", "side"))
        unit = unit_rows(np.frombuffer(b"".join(table.column("v").to_pylist()), real).reshape(len(ids), dim))
        links, i, j = leaf_links(forests[dim], node, plans[dim].top, unit, n, side if low != high else None, threshold, spill)
        some = np.flatnonzero(links)
        a, b = np.concatenate([ids[some], ids[i]]), np.concatenate([np.zeros(len(some), np.int64), ids[j]])
        count = np.concatenate([links[some], np.zeros(len(i), np.int64)])
        is_count = np.arange(len(a)) < len(some)
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=is_count), "links": pa.array(count)})

    found = spark.createDataFrame([], FOUND)
    for turn in range(max((p.rounds for p in plans.values()), default=0)):
        found = found.unionByName(Table(routed(turn).groupBy("dim", "node", "low", "high").applyInArrow(meet, FOUND), "vector-links").df)
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    tied = components(found.where("b is not null").select("a", "b"), "vector-components")
    told = classes.select("h1", "h2", "id", "n").join(links, "id", "left").join(tied, "id", "left")
    told = told.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    good = keyed.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
