"""Random forests of all runs at once: trees grow in NumPy on a run's packed rows, a task for some trees, or level by level where a run is large."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.blocks import _codes, _one, lists
from cellgrove.scratch import materialize

BINS = 32
#: Runs of up to so many training rows, and nodes of up to so many cells of larger runs, grow in one task.
LOCAL_ROWS = 1_000_000
#: Numbers of ``_bins`` that a task holds before it packs them.
NUMBERS = 2_000_000
#: Tasks a core in which trees grow: more of them even out better, but each gets a copy of its run's rows.
TASKS_A_CORE = 8
#: Upper ends of the cumulative probabilities of 0, 1, 2, ... of a Poisson variable of mean 1: how often a bootstrap sample has a row.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(*of: Column) -> Column:
    """A number from 0 to below 1, drawn by the hash of ``of``."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def bin_edges(train: DataFrame, *, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, _edges): for each run and feature (by place in ``x``) up to ``bins`` - 1 training values at its quantiles."""
    values = train.select(*keys, F.posexplode("x").alias("_f", "_v"))
    cuts = values.groupBy(*keys, "_f").agg(F.array_distinct(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10_000)).alias("_c"))
    by_place = F.transform(F.array_sort(F.collect_list(F.struct("_f", "_c"))), lambda e: e["_c"])  # no longer than the vocabulary
    return cuts.groupBy(*keys).agg(by_place.alias("_edges"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finalizer of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _of_tree(tree: int) -> np.ndarray:
    return _mixed(np.array([tree + 1], dtype=np.uint64) * _ODD)


def drawn(u: np.ndarray, tree: int) -> np.ndarray:
    """How often the bootstrap sample of ``tree`` has each of the rows, of which each has a number ``u`` of its own."""
    h = _mixed((u * float(1 << 53)).astype(np.uint64) * _ODD + _of_tree(tree))
    v, times = (h >> np.uint64(11)) / float(1 << 53), np.zeros(len(u))
    for p in _POISSON:
        times += v >= p
    return times


def tried_features(run: int, tree: int, nodes: np.ndarray, p: int, tried: int) -> np.ndarray:
    """The features that nodes of a tree of a run try, in rising order, a row a node."""
    if tried >= p:
        return np.tile(np.arange(p), (len(nodes), 1))
    of_node = _mixed(nodes.astype(np.uint64) * _ODD + _of_tree(tree) + np.array([run], dtype=np.int64).view(np.uint64))
    h = _mixed(of_node[:, None] + np.arange(1, p + 1, dtype=np.uint64) * _ODD)
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :tried], axis=1)


def gains(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut, gain) of each node: the first of the bins of a feature after which the weighted Gini impurity falls most, from sums (classes, nodes, bins)."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:]
    right = total - left
    a, b = left.sum(axis=0), right.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(axis=0) / a + (right**2).sum(axis=0) / b - (total**2).sum(axis=0) / total.sum(axis=0)
    gain = np.round(np.where((a > 1e-9) & (b > 1e-9), gain, 0), 9)
    at = gain.argmax(axis=1)
    return at, gain[np.arange(len(at)), at]


def _shares(totals: np.ndarray) -> np.ndarray:
    """Shares of classes, a row a node; all equal where nothing was drawn."""
    n, k = totals.sum(axis=1, keepdims=True), totals.shape[1]
    return np.where(n > 0, totals / np.where(n > 0, n, 1), 1 / k)


class Subtree:
    """What grows below a node whose training cells one task holds: all nodes of a level at once.

    Nodes are told apart by their place: that of the root is ``node``, the children of i are 2 i and 2 i + 1. They are kept in the order in which they are
    made: ``feature`` (-1: a leaf), ``cut``, ``below`` (the left child, the right one follows it) and ``shares`` of classes.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, *, depth: int, tried: int, run: int, tree: int, node: int, bins: int):
        p, flat = x.shape[1], x.ravel()
        rows, at = np.flatnonzero(w > 0), np.zeros(int((w > 0).sum()), dtype=np.int64)
        y, ids, made, kept = y.astype(np.int64), np.array([node], dtype=np.uint64), 1, []
        for left_depth in range(depth, -1, -1):
            m = len(ids)
            totals = np.bincount(at * k + y[rows], w[rows], m * k).reshape(m, k)
            feature, cut, below = np.full(m, -1, dtype=np.int32), np.zeros(m, dtype=np.int32), np.zeros(m, dtype=np.int64)
            mixed = np.flatnonzero((totals > 0).sum(axis=1) > 1) if left_depth else np.zeros(0, dtype=np.int64)
            s = len(mixed)
            if s:
                place = np.full(m, -1)
                place[mixed] = np.arange(s)
                at = place[at]
                rows, at = rows[at >= 0], at[at >= 0]
                features = tried_features(run, tree, ids[mixed], p, tried)
                best, f_best, cut_best = np.full(s, 1e-9), np.full(s, -1), np.zeros(s, dtype=np.int64)
                own, start, weight = rows * p, (y[rows] * s + at) * bins, w[rows]
                for j in range(features.shape[1]):
                    f = features[:, j]
                    cuts, gain = gains(np.bincount(start + flat[own + f[at]], weight, k * s * bins).reshape(k, s, bins))
                    more = gain > best
                    best[more], f_best[more], cut_best[more] = gain[more], f[more], cuts[more]
                split = np.flatnonzero(f_best >= 0)
                feature[mixed], cut[mixed] = f_best, cut_best
                below[mixed[split]] = made + 2 * np.arange(len(split))
                made += 2 * len(split)
                place = np.full(s, -1)
                place[split] = np.arange(len(split))
                go = place[at] >= 0
                rows, at = rows[go], at[go]
                at = 2 * place[at] + (flat[rows * p + f_best[at]] > cut_best[at])
                parents = ids[mixed[split]] * np.uint64(2)
                ids = np.stack([parents, parents + np.uint64(1)], axis=1).ravel()
            kept.append((feature, cut, below, _shares(totals)))
            if not s or not len(ids):
                break
        self.feature, self.cut, self.below, self.shares = [np.concatenate(v) for v in zip(*kept, strict=True)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            node = at[rows]
            at[rows] = self.below[node] + (x[rows, f] > self.cut[node])
        return self.shares[at]


def _blocks(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``rows`` written as blocks of a run's training rows or rows to predict: the block's different cells (``x``, end to end, and ``c``), and of each row its cell, weight, number, class and id.

    Rows that are the same cell come together, so that blocks hold each of them once.
    """
    spark = rows.sparkSession
    kept = [*keys, "_run", "_asked"]
    of_row = {"w": "_w", "u": "_u", "y": "_y", "region_id": "region_id"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            b = _one(held)
            code = _codes(b, [*keys, "_asked"])
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
                part = b.slice(i, j - i)
                cells = np.c_[part.column("_bins").flatten().to_numpy().reshape(j - i, -1), part.column("_c").to_numpy()].astype(np.int16)
                _, first, cell = np.unique(np.ascontiguousarray(cells).view(f"V{2 * cells.shape[1]}").ravel(), return_index=True, return_inverse=True)
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                arrays = [part.column(c).slice(0, 1) for c in kept] + [one(pa.array(cells[first, :-1].ravel().astype(kind))), one(pa.array(cells[first, -1].astype(np.int32))), one(pa.array(cell.ravel().astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*arrays, *[one(part.column(c)) for c in of_row.values()]], [*kept, "x", "c", "cell", *of_row])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column("_bins").flatten())
            if size > NUMBERS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    kind, name = (np.int8, "tinyint") if bins <= 128 else (np.int16, "smallint")
    of = lambda c: rows.schema[c].dataType.simpleString()
    schema = [*[f"`{c}` {of(c)}" for c in kept], f"x array<{name}>, c array<int>, cell array<int>", *[f"{c} array<{of(v)}>" for c, v in of_row.items()]]
    placed = rows.withColumns({"_bins": F.col("_bins").cast(f"array<{name}>"), "_cell": F.xxhash64("_bins", "_c")})
    placed = placed.repartition(2 * _cores(spark), *keys, "_asked", "_cell").sortWithinPartitions(*keys, "_asked", "_cell")
    return materialize(placed.mapInArrow(pack, ", ".join(schema)).withColumn("_block", F.monotonically_increasing_id()), "forest-blocks")


def _cores(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, 8)


def _vectors(b: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The arrays ``names`` of each row of an Arrow batch."""
    parts = [(b.column(c).values.to_numpy(zero_copy_only=False), b.column(c).offsets.to_numpy()) for c in names]
    for i in range(b.num_rows):
        yield [flat[at[i] : at[i + 1]] for flat, at in parts]


def _finished(state: DataFrame, k: int, *, groups: int, depth: int, tried: Callable, bins: int) -> DataFrame:
    """(_block, v): for the cells to predict of a block the sum of the shares of classes over trees of a group, end to end.

    A task has one group of ``state``: trees that grow from the same node of a run. Its training cells come first, as blocks; then the rows to predict stream past the
    grown trees, however many they are. Training rows with a number ``u`` are drawn here, others are cells that have been drawn; ``cell`` of rows to predict is where in the block they are (all if empty).
    """
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, grown, held = None, None, []
        for b in batches:
            marks = b.select(["_group", "_asked", "_run", "_node", "_trees", "_cells", "_block"]).to_pylist()
            for r, (x, c, cell, w, u) in zip(marks, _vectors(b, "x", "c", "cell", "w", "u"), strict=True):
                if r["_group"] != group:
                    group, grown, held = r["_group"], None, []
                x = x.reshape(len(c), -1)
                if not r["_asked"]:
                    held.append([v.copy() for v in (x, c, cell, w, u)])
                    continue
                if grown is None:
                    grown, held = _grown(held, r, k, depth, tried, bins), []
                v = sum(t.predict(x) for t in grown)
                if len(cell):
                    every = np.zeros((r["_cells"], k))
                    every[cell] = v
                    v = every
                yield pa.RecordBatch.from_arrays([pa.array([r["_block"]], pa.int64()), lists([v.ravel()])], ["_block", "v"])

    rows = state.repartitionById(groups, "_group").sortWithinPartitions("_group", "_asked")
    return rows.select("_group", "_asked", "_run", "_node", "_trees", "_cells", "_block", "x", "c", "cell", "w", "u").mapInArrow(grow, "_block long, v array<double>")


def _grown(held: list, r: dict, k: int, depth: int, tried: Callable, bins: int) -> list[Subtree]:
    """The trees of a group from the blocks of its training rows."""
    starts = np.cumsum([0, *[len(h[1]) for h in held]])
    x, c, w, u = [np.concatenate([h[i] for h in held]) for i in (0, 1, 3, 4)]
    cell = np.concatenate([h[2].astype(np.int64) + s for h, s in zip(held, starts, strict=False)])
    fit = lambda t, w: Subtree(x, c, w, k, depth=depth - (r["_node"].bit_length() - 1), tried=tried(x.shape[1]), run=r["_run"], tree=t, node=r["_node"], bins=bins)
    return [fit(t, np.bincount(cell, w * drawn(u, t) if len(u) else w, len(c))) for t in r["_trees"]]


class Top:
    """The upper nodes of a tree of a large run: ``cuts``, ``leaves`` (shares of classes), and ``groups`` of nodes that grow on in a task; the others are open."""

    def __init__(self):
        self.cuts: dict[int, tuple[int, int]] = {}
        self.leaves: dict[int, np.ndarray] = {}
        self.groups: dict[int, int] = {}
        self.open = [1]

    def nodes(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Nodes without a cut, and the rows of ``x`` that end there."""
        stack = [(1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node in self.cuts:
                f, at = self.cuts[node]
                high = x[rows, f] > at
                stack += [(2 * node, rows[~high]), (2 * node + 1, rows[high])]
            elif len(rows):
                yield node, rows


def _level(blocks: DataFrame, keys: list[str], tops: dict[tuple, list[Top]], k: int, *, tried: Callable, bins: int) -> dict[tuple, np.ndarray]:
    """For each run and tree (keys, tree) what is known of its open nodes: (node, number of cells, totals of classes, feature, cut, gain).

    Tasks add up a vector a tree for a block of training rows, Spark adds these up, and tasks find the best cuts; the driver gets some numbers a node.
    """
    names = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.select([*keys, "_run"]).to_pylist()
            for i, (x, c, cell, w, u) in enumerate(_vectors(b, "x", "c", "cell", "w", "u")):
                x, run = x.reshape(len(c), -1), marks[i]["_run"]
                p = x.shape[1]
                for t, top in enumerate(tops[tuple(marks[i][key] for key in keys)]):
                    if not top.open:
                        continue
                    weight = np.bincount(cell, w * drawn(u, t) if len(u) else w, len(c))
                    features = tried_features(run, t, np.array(top.open), p, tried(p))
                    out = np.zeros((len(top.open), 1 + features.shape[1] * bins * k))
                    places = {node: at for at, node in enumerate(top.open)}
                    for node, rows in top.nodes(x):
                        rows = rows[weight[rows] > 0]
                        if node in places and len(rows):
                            at = places[node]
                            out[at, 0] = len(rows)
                            for j, f in enumerate(features[at]):
                                h = np.bincount(c[rows] * bins + x[rows, f], weight[rows], k * bins)
                                out[at, 1 + j * k * bins : 1 + (j + 1) * k * bins] = h
                    yield pa.RecordBatch.from_arrays([*[b.column(key).slice(i, 1) for key in keys], pa.array([run], pa.int64()), pa.array([t], pa.int32()), pa.array([p], pa.int32()), lists([out.ravel()])], [*keys, "_run", "_tree", "_p", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.select([*keys, "_run", "_tree", "_p"]).to_pylist()
            for i, (r, (v,)) in enumerate(zip(marks, _vectors(b, "v"), strict=True)):
                nodes = np.array(tops[tuple(r[key] for key in keys)][r["_tree"]].open)
                features = tried_features(r["_run"], r["_tree"], nodes, r["_p"], tried(r["_p"]))
                v = v.reshape(len(nodes), -1)
                sums = v[:, 1:].reshape(len(nodes), -1, k, bins)
                found = []
                for j in range(features.shape[1]):
                    at, gain = gains(np.moveaxis(sums[:, j], 0, 1))
                    found.append(np.c_[features[:, j], at, gain])
                found = np.stack(found)
                best = found[found[:, :, 2].argmax(axis=0), np.arange(len(nodes))]
                out = np.c_[nodes, v[:, 0], best, sums[:, 0].sum(axis=2)]
                yield pa.RecordBatch.from_arrays([*[b.column(key).slice(i, 1) for key in keys], b.column("_tree").slice(i, 1), lists([out.ravel()])], [*keys, "_tree", "v"])

    each = blocks.select(*keys, "_run", "x", "c", "cell", "w", "u").mapInArrow(count, f"{names}, _run long, _tree int, _p int, v array<double>")
    total = each.groupBy(*keys, "_run", "_tree", "_p").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return {(tuple(r[key] for key in keys), r["_tree"]): np.array(r["v"]).reshape(-1, 5 + k) for r in total.mapInArrow(cut, f"{names}, _tree int, v array<double>").collect()}


def _large(blocks: DataFrame, keys: list[str], runs: list[tuple], k: int, *, trees: int, depth: int, tried: Callable, bins: int, local_rows: int, first: int) -> tuple[DataFrame, DataFrame, int]:
    """Runs whose training rows are too many for a task: (blocks of the groups of their smaller nodes, sums of shares of rows to predict that end above these, and
    the number after that of the last group).

    Nodes of more than ``local_rows`` cells are cut level by level, from sums over blocks. They are no more a level than the cells by ``local_rows``, so tasks get them all.
    """
    tops = {run: [Top() for _ in range(trees)] for run in runs}
    group = first
    for level in range(depth + 1):
        for (run, t), nodes in _level(blocks.filter("NOT _asked"), keys, tops, k, tried=tried, bins=bins).items():
            top = tops[run][t]
            top.open = []
            for node, n, f, at, gain, *totals in nodes.tolist():
                if 0 < n <= local_rows:
                    top.groups[int(node)] = group
                    group += 1
                elif n and level < depth and gain > 1e-9:
                    top.cuts[int(node)] = int(f), int(at)
                    top.open += [2 * int(node), 2 * int(node) + 1]
                else:
                    top.leaves[int(node)] = _shares(np.array([totals]))[0]
        if not any(top.open for own in tops.values() for top in own):
            break

    def parts(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.select([*keys, "_run", "_asked", "_block"]).to_pylist()
            for r, (x, c, cell, w, u) in zip(marks, _vectors(b, "x", "c", "cell", "w", "u"), strict=True):
                yield from of(r, tops[tuple(r[key] for key in keys)], x.reshape(len(c), -1), c, cell, w, u)

    def routed(r, own, x, c, cell, w, u):
        for t, top in enumerate(own):
            weight = None if r["_asked"] else np.bincount(cell, w * drawn(u, t) if len(u) else w, len(c))
            for node, rows in top.nodes(x):
                rows = rows if weight is None else rows[weight[rows] > 0]
                if node in top.groups and len(rows):
                    at, one = (rows if weight is None else np.arange(len(rows))), lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
                    values = [r["_asked"], r["_run"], r["_block"], len(c), top.groups[node], node]
                    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                    arrays = [one(np.array([t], dtype=np.int32)), one(x[rows].ravel()), one(c[rows]), one(at.astype(np.int32)), one(np.zeros(0) if weight is None else weight[rows]), one(np.zeros(0))]
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], *arrays], GROUPED)

    def ended(r, own, x, c, *_):
        v = np.zeros((len(c), k))
        for top in own:
            for node, rows in top.nodes(x):
                if node in top.leaves:
                    v[rows] += top.leaves[node]
        yield pa.RecordBatch.from_arrays([pa.array([r["_block"]], pa.int64()), lists([v.ravel()])], ["_block", "v"])

    kind = blocks.schema["x"].dataType.simpleString()
    schema = f"_asked boolean, _run long, _block long, _cells int, _group int, _node long, _trees array<int>, x {kind}, c array<int>, cell array<int>, w array<double>, u array<double>"
    return blocks.mapInArrow(lambda it: parts(it, routed), schema), blocks.filter("_asked").mapInArrow(lambda it: parts(it, ended), "_block long, v array<double>"), group


#: Columns of blocks by group of trees.
GROUPED = ["_asked", "_run", "_block", "_cells", "_group", "_node", "_trees", "x", "c", "cell", "w", "u"]


def forest_predictions(train: DataFrame, test: DataFrame, classes: list, *, keys: list[str], trees: int = 300, max_depth: int = 15, bins: int = BINS, max_features: str | None = "sqrt", bootstrap: bool = True, seed: int = 0, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(keys, region_id, truth, class, proba): random forests of the runs of ``train`` (keys, region_id, x, label, weight), applied to ``test``.

    A row is in a tree as often as a Poisson draw by hash says, a node tries the square root of the number of features (rounded down; up if ``max_features`` is "sqrt_up"; all if it is None), and splits
    where the weighted Gini impurity falls most, between quantile bins of the run's training values. A node without such a cut among the features it tries is a leaf. Rows of a
    run with the same bins and class are a cell, whose weight in a tree is the sum of theirs as drawn, so trees grow with the different cells and not with the rows.

    Rows lie in blocks. A run of at most ``local_rows`` training rows is sent, packed, to some tasks, each of which grows its share of the trees; of larger runs the nodes of more than ``local_rows``
    cells are cut by all tasks together, a few jobs a level, and only the nodes below them are sent. Rows to predict stream past the grown trees; probabilities are the mean over trees
    of the shares of classes in their leaves. Draws are by run, tree, row (keys and region_id) and node, so they depend neither on partitions nor on where a tree grows.
    """
    spark, k, names = train.sparkSession, len(classes), F.array(*[F.lit(c) for c in classes])
    place = (F.array_position(names, F.col("label")) - 1).cast("int")
    edges = materialize(bin_edges(train, keys=keys, bins=bins), "bin-edges")
    part = lambda df, w, to: df.select(*keys, "region_id", "x", place.alias("_y"), w.cast("double").alias("_w"), F.lit(to).alias("_asked"))
    rows = part(train, F.col("weight"), False).unionByName(part(test, F.lit(0.0), True)).join(F.broadcast(edges), keys)  # a few numbers a run and feature
    binned = F.transform("x", lambda v, f: F.size(F.filter(F.get("_edges", f), lambda c: c < v)))
    own = {"_u": _uniform(F.lit(seed), F.lit("rows"), *keys, "region_id"), "_run": F.xxhash64(F.lit(seed), F.lit("features"), *keys)}
    rows = rows.select(*keys, "region_id", "_y", "_w", "_asked", binned.alias("_bins"), F.when(F.col("_asked"), 0).otherwise(F.col("_y")).alias("_c"), *[v.alias(n) for n, v in own.items()])
    blocks = _blocks(rows, keys, bins)
    if not bootstrap:
        blocks = blocks.withColumn("u", F.array().cast("array<double>"))

    def tried(p: int) -> int:
        return p if max_features is None else math.isqrt(p - 1) + 1 if max_features == "sqrt_up" else max(1, math.isqrt(p))

    sizes = blocks.filter("NOT _asked").groupBy(*keys).agg(F.sum(F.size("cell")).alias("n")).collect()  # a row a run
    small = [tuple(r[key] for key in keys) for r in sizes if r["n"] <= local_rows]
    large = [tuple(r[key] for key in keys) for r in sizes if r["n"] > local_rows]
    of = lambda runs, more="": ", ".join(f"`{key}` {blocks.schema[key].dataType.simpleString()}" for key in keys) + more
    a_run = min(trees, max(1, TASKS_A_CORE * _cores(spark) // max(1, len(small))))
    groups = [(*run, i * a_run + j, list(range(j, trees, a_run))) for i, run in enumerate(small) for j in range(a_run)]
    groups = F.broadcast(spark.createDataFrame(groups, of(small, ", _group int, _trees array<int>")))  # the trees' numbers for each run
    sent = {"_cells": F.size("c"), "_node": F.lit(1).cast("long"), "cell": F.when(F.col("_asked"), F.array().cast("array<int>")).otherwise(F.col("cell"))}
    state, above, last = blocks.join(groups, keys).withColumns(sent).select(*GROUPED), None, len(small) * a_run
    if large:
        few = blocks.join(F.broadcast(spark.createDataFrame(large, of(large))), keys, "left_semi")
        parts, above, last = _large(few, keys, large, k, trees=trees, depth=max_depth, tried=tried, bins=bins, local_rows=local_rows, first=last)
        state = state.unionByName(materialize(parts, "forest-nodes"))
    found = _finished(state, k, groups=max(last, 1), depth=max_depth, tried=tried, bins=bins)
    found = found if above is None else found.unionByName(above)
    total = found.groupBy("_block").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    each = F.transform(F.arrays_zip("region_id", "y", "cell"), lambda r: F.struct(r["region_id"].alias("region_id"), r["y"].alias("_y"), F.slice("v", r["cell"] * k + 1, F.lit(k)).alias("_p")))
    mean = materialize(blocks.filter("_asked").select("_block", *keys, "region_id", "y", "cell").join(total, "_block").select(*keys, F.inline(each)), "forest-means")
    return mean.select(*keys, "region_id", F.get(names, F.col("_y")).alias("truth"), F.posexplode("_p").alias("_k", "_s")).select(*keys, "region_id", "truth", F.get(names, F.col("_k")).alias("class"), (F.col("_s") / trees).alias("proba"))
