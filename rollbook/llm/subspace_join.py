"""Near-duplicate embeddings by a pigeonhole join over blocks of rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import named, release, staged
from rollbook.llm.components import components
from rollbook.session import run_dir

SLACK = 1e-9  # over the rounding of a rotation, far below any budget


class Subspaces:
    """The blocks of a rotated space, and the squared distance that each may take of the whole budget.

    Unit vectors of cosine c lie 2 - 2c apart, squared. A rotation keeps that, and it is the sum over the
    blocks, so two vectors within the budget are within its share, by dimensions, in one block at least.
    """

    def __init__(self, size: int, cosine: float, width: int, seed: int):
        normal = np.random.default_rng([seed, size]).standard_normal((size, size))
        self.rotation = np.linalg.qr(normal)[0]
        count = max(1, size // width)
        edges = np.linspace(0, size, count + 1).round().astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.budgets = [(2 - 2 * cosine) * (e - s) / size + SLACK for s, e in self.spans]
        self.cosine = cosine

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation

    def cells(self, rotated: np.ndarray, block: int, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell (a whole number per axis) and whether it is the row's own, for its own cell and every cell before
        that (by the first number that differs) that the row's ball of the block's radius can reach. A cell is two radii
        wide, so there are two to an axis. Rows of different cells within the radius reach each other's, and meet in
        the first of the two."""
        start, end = self.spans[block]
        radius = np.sqrt(self.budgets[block])
        at = rotated[:, start : min(end, start + axes)] / (2 * radius)
        home = np.floor(at).astype(np.int32)
        step = np.where(at - home < 0.5, -1, 1).astype(np.int32)
        rows, cells, own = [], [], []
        for choice in product((0, 1), repeat=at.shape[1]):
            reach = np.flatnonzero(step[:, choice.index(1)] < 0) if any(choice) else np.arange(len(at))
            rows.append(reach)
            cells.append(home[reach] + step[reach] * np.array(choice, np.int32))
            own.append(np.full(len(reach), not any(choice)))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(own)

    def _block(self, vectors: np.ndarray, block: int) -> np.ndarray:
        """The coordinates of one block, in single precision."""
        turn = self.rotation[:, slice(*self.spans[block])]
        parts = [np.zeros((0, turn.shape[1]), np.float32)]
        for i in range(0, len(vectors), 8192):
            part = vectors[i : i + 8192].astype(np.float64)
            parts.append((part / np.linalg.norm(part, axis=1, keepdims=True) @ turn).astype(np.float32))
        return np.concatenate(parts)

    def links(self, block: int, homes: np.ndarray, others: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (home, other) of raw vectors that reach the cosine and fit no earlier block's budget; pairs of two
        homes, each once, if there are no others."""
        a = self._block(homes, block)
        b = a if others is None else self._block(others, block)
        others = homes if others is None else others
        a2, b2 = (a * a).sum(axis=1, keepdims=True), (b * b).sum(axis=1, keepdims=True)
        # the product of these rows is the squared distance
        left, right = np.hstack([-2 * a, a2, np.ones_like(a2)]), np.hstack([b, np.ones_like(b2), b2]).T.copy()
        most = np.float32(self.budgets[block] + 1e-5)
        for i in range(0, len(a), 512):
            for j in range(i if others is homes else 0, len(b), 1024):
                close = (left[i : i + 512] @ right[:, j : j + 1024] <= most).ravel()
                if not close.any():
                    continue
                u, v = np.divmod(np.flatnonzero(close), min(1024, len(b) - j))
                u, v = u + i, v + j
                if others is homes:
                    u, v = u[u < v], v[u < v]
                for k in range(0, len(u), 32_768):
                    x, y = self._near(block, homes, u[k : k + 32_768], others, v[k : k + 32_768])
                    if len(x):
                        yield x, y

    def _near(self, block: int, homes: np.ndarray, u: np.ndarray, others: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that fit this block's budget first and reach the cosine, in double precision."""
        (one, x), (two, y) = (np.unique(w, return_inverse=True) for w in (u, v))
        a, b = homes[one].astype(np.float64), others[two].astype(np.float64)
        gap = (self.rotated(a)[x] - self.rotated(b)[y]) ** 2
        fits = [gap[:, s:e].sum(axis=1) <= m for (s, e), m in zip(self.spans[: block + 1], self.budgets, strict=False)]
        first = fits[block] & ~np.any([np.zeros(len(u), bool), *fits[:block]], axis=0)
        u, v, x, y = u[first], v[first], x[first], y[first]
        norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        near = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= self.cosine
        return u[near], v[near]


_TILE = T.StructType([
    T.StructField("size", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("cell", T.BinaryType()),
    T.StructField("mine", T.IntegerType()), T.StructField("theirs", T.IntegerType()), T.StructField("own", T.BooleanType()),
    T.StructField("node", T.LongType()), T.StructField("times", T.LongType()), T.StructField("vector", T.BinaryType()),
])
_LOT = T.StructType([T.StructField(n, T.LongType()) for n in ("lot", "homes", "visitors")])
_FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("links", T.LongType())])
#: Cells are counted in so many lots, by a hash: the counts stay small however many cells there are.
_LOTS = 1 << 16
#: Pairs that could be compared in the time that one more row takes.
_ROW_PAIRS = 10_000
#: Bytes of a row beside its vector.
_ROW_BYTES = 64


def _mixed(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    x = np.asarray(x).astype(np.int64).view(np.uint64)
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _placed(distinct: DataFrame, axes: int, cosine: float, width: int, seed: int, step: int):
    """A function that gives, for the batches of a task, the vectors of one length in steps, with their places in each
    block: kind of a component, length, block, raw vectors, nodes, times, and of each place row, cell, own and hash of the cell."""
    single = distinct.schema["vector"].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"

    def places(batches: Iterator[pa.RecordBatch]):
        spaces: dict[int, Subspaces] = {}
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                nodes, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                for size in np.unique(sizes).tolist():
                    which = np.flatnonzero(sizes == size)
                    raw = flat[begins[which][:, None] + np.arange(size)].astype(kind)
                    space = spaces.setdefault(size, Subspaces(size, cosine, width, seed))
                    turned = space.rotated(raw.astype(np.float64))
                    for block in range(len(space.spans)):
                        rows, cells, own = space.cells(turned, block, axes)
                        hashes = _mixed(np.full(len(rows), size, np.uint64), block)
                        for axis in cells.T:
                            hashes = _mixed(hashes, axis)
                        yield size, block, raw, nodes[which], times[which], rows, cells, own, hashes

    return places


def _lot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(_LOTS)


def _counted(distinct: DataFrame, axes: int, cosine: float, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows are in their own cell, and how many reach another, in the cells of each lot."""
    places = _placed(distinct, axes, cosine, width, seed, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visitors = np.zeros((2, _LOTS), np.int64)
        for *_, own, hashes in places(batches):
            lot = _lot(hashes).astype(np.int64)
            homes += np.bincount(lot[own], minlength=_LOTS)
            visitors += np.bincount(lot[~own], minlength=_LOTS)
        some = np.flatnonzero(homes + visitors)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(homes[some]), pa.array(visitors[some])], names=_LOT.names)

    lots = distinct.select("node", "times", "vector").mapInArrow(run, _LOT)
    out = np.zeros((2, _LOTS), np.int64)
    table = lots.groupBy("lot").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors")).toArrow()
    for row, name in enumerate(("homes", "visitors")):
        out[row, table["lot"].to_numpy()] = table[name].to_numpy()
    return out[0], out[1]


def _parts(homes: np.ndarray, visitors: np.ndarray, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Into how many parts the homes and the visitors of the cells of a lot are dealt: no parts of homes if no two rows
    can meet, no parts of visitors if they are with the homes."""
    half = max(1, cell_rows // 2)
    crowded = homes + visitors > cell_rows
    inside = np.where(crowded, -(-homes // half), np.where(homes + visitors > 1, np.minimum(homes, 1), 0))
    return inside, np.where(crowded, -(-visitors // half), 0)


def _tiles(
    distinct: DataFrame, parts: tuple[np.ndarray, np.ndarray], turn: int, turns: int, axes: int, cosine: float, width: int, seed: int,
) -> DataFrame:
    """The rows of one of several turns. In a tile a part of a cell's homes (``own``) meets another part of them or a part
    of its visitors; two parts meet in one tile only, whose hash gives its turn."""
    copies = int((parts[0] + parts[1]).max(initial=1))
    places = _placed(distinct, axes, cosine, width, seed, min(4096, max(64, (1 << 18) // copies)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, block, raw, nodes, times, rows, cells, own, hashes in places(batches):
            lot = _lot(hashes).astype(np.int64)
            inside, outside = parts[0][lot], parts[1][lot]
            number = nodes[rows].view(np.uint64) >> np.uint64(16)
            part = (number % np.maximum(1, np.where(own, inside, outside)).astype(np.uint64)).astype(np.int64)
            count = np.where(own & (inside > 0), inside + outside, inside)
            at = np.repeat(np.arange(len(rows)), count)
            k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            part, home, split = part[at], own[at], outside[at] > 0
            mine = np.where(home, np.minimum(k, part), k)
            theirs = np.where(home, np.maximum(k, part), np.where(split, inside[at] + part, 0))
            now = _mixed(_mixed(hashes[at], mine), theirs) >> np.uint64(20)
            now = np.flatnonzero(now % np.uint64(turns) == np.uint64(turn))
            if not len(now):
                continue
            at, home = at[now], home[now] & (k[now] >= part[now])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), block, np.int32)), _binary(cells[at]),
                pa.array(mine[now].astype(np.int32)), pa.array(theirs[now].astype(np.int32)), pa.array(home), pa.array(nodes[rows[at]]),
                pa.array(times[rows[at]]), _binary(raw[rows[at]]),
            ], names=_TILE.names)

    return distinct.select("node", "times", "vector").mapInArrow(run, _TILE)


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    wide = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(wide)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) do, one for each node but the smallest of a component."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    below = label < np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _links(distinct: DataFrame, cosine: float, width: int, seed: int, cell_rows: int, turn_bytes: int) -> DataFrame:
    """``node``, ``other``, ``links``: of each vector how many rows it links to (``other`` null), and links that
    connect (``links`` null)."""
    session = distinct.sparkSession
    single = distinct.schema["vector"].dataType.elementType == T.FloatType()
    nodes, numbers = distinct.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    best = None
    for axes in range(1, width + 1):
        homes, visitors = _counted(distinct, axes, cosine, width, seed)
        inside, outside = parts = _parts(homes, visitors, cell_rows)
        rows = float((homes * (inside + outside) + visitors * inside).sum())
        cost = float((homes * (homes / 2 + visitors)).sum()) + _ROW_PAIRS * rows
        if best and cost >= best[0]:
            break
        best = cost, axes, parts, rows
    _, axes, parts, rows = best
    held = numbers * (4 if single else 8)
    turns = max(1, round(rows * (held / max(1, nodes) + _ROW_BYTES) / max(held, turn_bytes) + 0.5))
    tasks = 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    key = ["size", "block", "cell", "mine", "theirs"]
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Subspaces] = {}
        for size, block, triangle, homes, others in _gathered(batches, kind):
            if not len(homes[0]):
                continue
            space = spaces.setdefault(size, Subspaces(size, cosine, width, seed))
            for theirs in [homes] * triangle + [others] * bool(len(others[0])):
                total, their_total = np.zeros(len(homes[0]), np.int64), np.zeros(len(theirs[0]), np.int64)
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for u, v in space.links(block, homes[2], None if theirs is homes else theirs[2]):
                    np.add.at(total, u, theirs[1][v])
                    np.add.at(their_total, v, homes[1][u])
                    held.append((homes[0][u], theirs[0][v]))
                    if sum(len(x) for x, _ in held) >= 65_536:
                        held = [_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if held:
                    yield _found(*_forest(*(np.concatenate(x) for x in zip(*held, strict=True))), None)
                for names, counts in ((homes[0], total), (theirs[0], their_total)):
                    some = counts > 0
                    if some.any():
                        yield _found(names[some], None, counts[some])

    paths = []
    for turn in range(turns):
        tiles = _tiles(distinct, parts, turn, turns, axes, cosine, width, seed)
        tiles = tiles.repartition(tasks, *key).sortWithinPartitions(*key)
        paths.append(run_dir(session, "links"))
        tiles.mapInArrow(run, _FOUND).write.option("compression", "zstd").parquet(paths[-1])
        del tiles
        release(session)
    return session.read.schema(_FOUND).parquet(*paths)


def _found(node: np.ndarray, other: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(node), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), none if other is None else pa.array(other, pa.int64()), none if links is None else pa.array(links, pa.int64())],
        names=_FOUND.names,
    )


def _gathered(batches: Iterator[pa.RecordBatch], kind: str):
    """Of each tile size, block, whether its homes meet each other, and (nodes, times, raw vectors) of its homes and of the others."""
    at, held = None, []

    def tile():
        size, block, _, mine, theirs = at
        own, node, times, raw = (np.concatenate(x) for x in zip(*held, strict=True))
        homes, others = ((node[x], times[x], raw[x]) for x in (own, ~own))
        return size, block, mine == theirs, homes, others

    for batch in batches:
        if not batch.num_rows:
            continue
        turned = np.zeros(batch.num_rows, bool)
        for i in range(5):
            turned[1:] |= pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(turned).tolist(), batch.num_rows]
        own, node, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(batch.column(i)[start].as_py() for i in range(5))
            if key != at:
                if held:
                    yield tile()
                at, held = key, []
            raw = np.frombuffer(b"".join(batch.column(8)[start:stop].to_pylist()), kind).reshape(-1, key[0])
            held.append((own[start:stop], node[start:stop], times[start:stop], raw))
    if held:
        yield tile()


def near_duplicates(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, width: int = 8,
    seed: int = 11, cell_rows: int = 100_000, turn_bytes: int = 256_000_000,
) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component`` and ``kept``.

    All vectors of one length are compared. They are rotated at random (by ``seed``) and split into blocks of
    ``width`` dimensions; in each block a grid joins those within the block's share of the squared distance,
    and each pair that meets is verified by its cosine in double precision, once: in its first block. Equal
    vectors are one node with a count, so copies add no pairs, and tasks give out counts and connecting links,
    never all pairs. The grid takes axes of a block as long as one more saves work, by the counts of its cells. A cell of
    more than ``cell_rows`` rows is dealt in tiles, two parts of its rows in each. Tiles are shuffled in turns of about the
    bytes of all vectors, or ``turn_bytes`` if that is more, and what a turn took is let go before the next.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows with a null
    key count as links of others but name no component. Nodes are known by the 64-bit hash of their vector. Other
    columns are dropped; an empty table gives an empty one.
    """
    values = named(vector)
    finite = ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False))
    rows = vectors.select(named(key).cast("long").alias("k"), F.when(usable, values).alias("vector"), usable.alias("ok"))
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("vector")))
    distinct = rows.where("ok").groupBy("node").agg(
        F.count("*").alias("times"), F.first("vector").alias("vector"), F.min("k").alias("least")
    )
    session = vectors.sparkSession
    distinct = staged(distinct.repartition(int(session.conf.get("spark.sql.shuffle.partitions"))), "vectors")
    release(session)
    found = _links(distinct, cosine, width, seed, cell_rows, turn_bytes)
    counts = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = distinct.select("node", "times", "least").join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = staged(nodes.join(names, "root").select("node", "times", "links", "component"), "nodes")
    out = rows.select("k", "node").join(nodes, "node", "left")
    links = F.when(F.col("times").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("times") - 1)
    component = F.when(F.col("times").isNull(), F.col("k")).otherwise(F.col("component"))
    return out.select(
        F.col("k").alias(key), links.cast("long").alias("n_links"), component.alias("component"),
        F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"),
    )
