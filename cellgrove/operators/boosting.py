"""Histogram gradient boosting of all runs at once: a run grows in one task; of large runs a level of a round's trees, of all classes and runs, is one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.blocks import each_block, lists, packed, sums_by_run
from cellgrove.operators.trees import LOCAL_ROWS, bin_edges
from cellgrove.scratch import materialize

BINS, MIN_LEAF = 32, 20
#: Numbers of training rows (`LOCAL_ROWS` at most) that a run may have to grow in one task.
LOCAL_NUMBERS = 20_000_000
#: Rounds after which scores of large runs are written, so that tasks only evaluate the trees since then.
KEEP = 5


class Tree:
    """A binary tree over bins; node i has the children 2 i and 2 i + 1."""

    def __init__(self, depth: int):
        self.feature, self.cut, self.value = np.full(2 << depth, -1), np.zeros(2 << depth, dtype=np.int64), np.zeros(2 << depth)
        self.depth = depth

    def step(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The nodes of the rows one level below those in ``at``, which stay where there is no cut."""
        f = self.feature[at]
        return np.where(f < 0, at, 2 * at + (bins[np.arange(len(bins)), f] > self.cut[at]))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), dtype=np.int64)
        for _ in range(self.depth):
            if (self.feature[at] < 0).all():
                break
            at = self.step(at, bins)
        return at

    def split(self, node: int, h: np.ndarray, rate: float, min_leaf: int) -> list[int]:
        """Cuts a node by its sums (3, features, bins), if a cut helps; returns the children that may be cut."""
        cut = best_cut(h, min_leaf)
        if cut is None:
            return []
        self.feature[node], self.cut[node] = cut[0], cut[1]
        open_ = []
        for child, (g, curve, n) in ((2 * node, cut[2]), (2 * node + 1, cut[3])):
            self.value[child] = -rate * g / max(curve, 1e-12)
            if n >= 2 * min_leaf and 2 * child < len(self.value):
                open_.append(child)
        return open_

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Of classes, or of the second class if there is one score."""
    if scores.shape[1] == 1:
        return 1 / (1 + np.exp(-scores))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histograms(scores: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: list[Tree], asked: list[tuple[int, int]], n_bins: int) -> np.ndarray:
    """Sums of gradient, curvature and number of training rows by (class, node) in ``asked``, feature and bin, as one vector."""
    p, k = bins.shape[1], scores.shape[1]
    proba = probabilities(scores)
    out = np.zeros((len(asked), 3, p * n_bins))
    places = {c: trees[c].nodes(bins) for c in {c for c, _ in asked}}
    cells = bins + n_bins * np.arange(p)
    for i, (c, node) in enumerate(asked):
        own = (places[c] == node) & (weight > 0)
        if own.any():
            q, w = proba[own, c], weight[own]
            hit = label[own] == (1 if k == 1 else c)
            at = cells[own].ravel()
            for j, v in enumerate((w * (q - hit), w * q * (1 - q), np.ones(len(w)))):
                out[i, j] = np.bincount(at, np.repeat(v, p), p * n_bins)
    return out.ravel()


def best_cut(h: np.ndarray, min_leaf: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(feature, bin, sums to the left, sums to the right) of the cut that lessens the loss most, from sums (3, features, bins)."""
    left = np.cumsum(h, axis=2)
    total = left[:, :1, -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1]
    gain[(left[2] < min_leaf) | (right[2] < min_leaf) | ~np.isfinite(gain)] = 0
    f, b = np.unravel_index(np.round(gain, 9).argmax(), gain.shape)
    return (int(f), int(b), left[:, f, b], right[:, f, b]) if gain[f, b] > 1e-9 else None


def distinct(bins: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows (cells), and for each row its cell."""
    own = np.ascontiguousarray(bins.astype(np.min_scalar_type(n_bins)))
    _, first, of = np.unique(own.view(np.dtype((np.void, own.itemsize * own.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return own[first], of


def fitted(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, base: np.ndarray, *, rounds: int, rate: float, depth: int, min_leaf: int, n_bins: int) -> list[list[Tree]]:
    """The trees, one a class (or score) a round, of all training rows of a run, whose scores begin at ``base``. Rows with the same bins have the same scores and are one cell."""
    k, some = len(base), weight > 0
    cells, of = distinct(bins[some], n_bins)
    m, n_labels = len(cells), max(k, 2)
    hits = np.bincount(of * n_labels + label[some].astype(np.int64), weight[some], m * n_labels).reshape(m, n_labels)
    total, count = hits.sum(axis=1), np.bincount(of, minlength=m).astype(float)
    columns, scores, done = np.ascontiguousarray(cells.T), np.tile(base, (m, 1)), []

    def sums(open_: list[int], at: np.ndarray, values: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of the values (gradient, curvature, number) by open node, feature and bin."""
        place = np.full(2 << depth, -1)
        place[open_] = np.arange(len(open_))
        slot = place[at]
        own = np.flatnonzero(slot >= 0)
        out, start, values = np.zeros((len(open_), 3, len(columns), n_bins)), slot[own] * n_bins, [v[own] for v in values]
        for f, column in enumerate(columns):
            cell = start + column[own]
            for j, v in enumerate(values):
                out[:, j, f] = np.bincount(cell, v, len(open_) * n_bins).reshape(len(open_), n_bins)
        return out

    for _ in range(rounds):
        proba, trees, nodes = probabilities(scores), [Tree(depth) for _ in range(k)], []
        for c, t in enumerate(trees):
            q = proba[:, c]
            values = total * q - hits[:, 1 if k == 1 else c], total * q * (1 - q), count
            at, open_ = np.ones(m, dtype=np.int64), [1]
            while open_:
                open_ = [child for node, h in zip(open_, sums(open_, at, values), strict=True) for child in t.split(node, h, rate, min_leaf)]
                at = t.step(at, cells)
            nodes.append(at)
        if all((t.feature < 0).all() for t in trees):
            break
        done.append(trees)
        for c, t in enumerate(trees):
            scores[:, c] += t.value[nodes[c]]
    return done


def _grown(state: DataFrame, runs: list[tuple], keys: list[str], k: int, *, n_bins: int, **options) -> DataFrame:
    """`_scored` rows of ``runs``, each of which grows in a task of its own: its training rows come first, as blocks, then the rows to predict stream past the trees."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, held = None, None, []
        for b in batches:
            for i, (run, x, (y, w)) in enumerate(each_block(b, keys, ["y", "w"])):
                if run != group:
                    group, trees, held = run, None, []
                own = b.slice(i, 1)
                if not own.column("asked")[0].as_py():
                    held.append((x[:, k:].astype(np.min_scalar_type(n_bins)), y.copy(), w.copy(), x[0, :k].copy()))
                    continue
                if trees is None:
                    trees = fitted(*[np.concatenate(v) for v in list(zip(*held, strict=True))[:3]], held[0][3], n_bins=n_bins, **options)
                    held = []
                cells, of = distinct(x[:, k:], n_bins)
                s = np.tile(x[0, :k], (len(cells), 1))
                for of_round in trees:
                    for c, t in enumerate(of_round):
                        s[:, c] += t.values(cells)
                yield _rows_of(own, keys, s[of])

    groups = state.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(runs)], _schema(state, keys) + ", _group int")
    rows = state.join(F.broadcast(groups), keys).repartitionById(len(runs), "_group").sortWithinPartitions("_group", "asked")
    return rows.select(*state.columns).mapInArrow(grow, _scored_schema(state, keys))


def boosting_predictions(train: DataFrame, test: DataFrame, classes: list, *, keys: list[str], rounds: int = 300, rate: float = 0.1, max_depth: int = 5, min_leaf: int = MIN_LEAF, bins: int = BINS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(keys, region_id, truth, class, proba): boosted trees of the runs of ``train`` (keys, region_id, x, label, weight), applied to ``test``.

    Trees of a round, one a class (one in all for two classes), grow level by level on histograms of gradients over quantile bins. Leaves
    have ``min_leaf`` training rows or more; a run without a cut ends. Rows of a run lie in blocks. A run of at most ``local_rows`` training rows (and LOCAL_NUMBERS numbers) is sent, packed, to a
    task, which grows all its rounds; rows to predict stream past its trees. Of larger runs tasks add up the histograms of the open nodes, Spark adds these up by run, and
    the driver, which gets 3 numbers a bin and no rows, cuts the nodes: as many jobs as all rounds have levels, for any number of runs; their rows to
    predict are carried along without weight, and scores are written every KEEP rounds, so that tasks evaluate the trees since then. Both ways cut the same nodes.
    """
    k, names = 1 if len(classes) == 2 else len(classes), F.array(*[F.lit(c) for c in classes])
    place = (F.array_position(names, F.col("label")) - 1).cast("int")
    edges = materialize(bin_edges(train, keys=keys, bins=bins), "bin-edges")
    part = lambda df, w, to: df.select(*keys, "region_id", "x", place.alias("y"), w.cast("double").alias("w"), F.lit(to).alias("asked"))
    rows = part(train, F.col("weight"), False).unionByName(part(test, F.lit(0.0), True)).join(F.broadcast(edges), keys)  # a few numbers a run and feature
    binned = F.transform("x", lambda v, f: F.size(F.filter(F.get("_edges", f), lambda c: c < v)).cast("double"))
    rows = materialize(rows.withColumn("x", binned).drop("_edges"), "boosting-rows")
    shares = rows.filter("NOT asked").groupBy(*keys, "y").agg(F.sum("w").alias("w"), F.max(F.size("x")).alias("p"), F.count("*").alias("n")).collect()  # a row a run and class
    of = lambda r: tuple(r[c] for c in keys)
    widths, prior = {of(r): r["p"] for r in shares}, {of(r): np.full(len(classes), 1e-9) for r in shares}
    sizes = dict.fromkeys(widths, 0)
    for r in shares:
        prior[of(r)][r["y"]] += r["w"]
        sizes[of(r)] += r["n"]
    base = {run: np.log(v[1:] / v[0]) if k == 1 else np.log(v / v.sum()) for run, v in prior.items()}
    schema = _schema(rows, keys) + ", _base array<double>"
    start = F.broadcast(rows.sparkSession.createDataFrame([(*run, b.tolist()) for run, b in base.items()], schema))
    # x: scores by class, then bins.
    state = packed(rows.join(start, keys).withColumn("x", F.concat("_base", "x")), keys=[*keys, "asked"], columns=["region_id", "y", "w"])
    small = [run for run, n in sizes.items() if n <= local_rows and n * widths[run] <= LOCAL_NUMBERS]
    found = _grown(state, small, keys, k, rounds=rounds, rate=rate, depth=max_depth, min_leaf=min_leaf, n_bins=bins) if small else None
    going = set(widths).difference(small)
    since: dict[tuple, list[list[Tree]]] = {run: [] for run in going}
    large = [*going]
    if small and large:
        state = state.join(F.broadcast(rows.sparkSession.createDataFrame(large, _schema(state, keys))), keys, "left_semi")

    def scores(x: np.ndarray, done: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
        s, b = x[:, :k].copy(), x[:, k:].astype(np.int64)
        for trees in done:
            for c, t in enumerate(trees):
                s[:, c] += t.values(b)
        return s, b

    for done in range(1, rounds + 1) if large else ():
        trees = {run: [Tree(max_depth) for _ in range(k)] for run in going}
        asked = {run: [(c, 1) for c in range(k)] for run in going}
        for _ in range(max_depth):
            now, grown, past = {r: a for r, a in asked.items() if a}, trees, since
            if not now:
                break

            def add(run, x, y, w, now=now, grown=grown, past=past):
                return histograms(*scores(x, past[run]), y, w, grown[run], now[run], bins) if run in now else None

            asked = {}
            for run, v in sums_by_run(state.filter("NOT asked"), keys=keys, columns=["y", "w"], of=add).items():
                each = zip(now[run], v.reshape(len(now[run]), 3, widths[run], bins), strict=True)
                asked[run] = [(c, child) for (c, node), h in each for child in trees[run][c].split(node, h, rate, min_leaf)]
        for run in list(going):
            if all((t.feature < 0).all() for t in trees[run]):
                going.discard(run)
            else:
                since[run] = [*since[run], trees[run]]
        if done % KEEP == 0 or done == rounds or not going:
            state, since = materialize(_with_scores(state, keys, since, scores), "boosting-state"), {run: [] for run in large}
        if not going:
            break
    if large or not small:
        found = _scored(state.filter("asked"), keys, k) if found is None else found.unionByName(_scored(state.filter("asked"), keys, k))
    out = materialize(found, "boosting-scores")
    if k == 1:
        second = 1 / (1 + F.exp(-F.get("_s", F.lit(0))))
        proba: Column = F.array(1 - second, second)
    else:
        e = F.transform("_s", lambda v: F.exp(v - F.array_max("_s")))
        proba = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, u: a + u))
    return out.select(*keys, "region_id", F.get(names, F.col("y")).alias("truth"), F.inline(F.arrays_zip(names.alias("class"), proba.alias("proba"))).alias("class", "proba"))


def _with_scores(state: DataFrame, keys: list[str], since: dict, scores) -> DataFrame:
    """``state`` with the scores of the trees ``since`` added."""
    def update(batches):
        for b in batches:
            changed = []
            for run, x, _ in each_block(b, keys, ["y"]):
                new, _ = scores(x, since[run])
                changed.append(np.c_[new, x[:, new.shape[1] :]].ravel())
            yield pa.RecordBatch.from_arrays([lists(changed) if c == "x" else b.column(c) for c in b.schema.names], b.schema.names)

    return state.mapInArrow(update, state.schema)


def _rows_of(block: pa.RecordBatch, keys: list[str], scores: np.ndarray) -> pa.RecordBatch:
    """(keys, region_id, y, _s), the rows of a block with their scores."""
    n, k = scores.shape
    s = pa.ListArray.from_arrays(pa.array(np.arange(0, k * n + 1, k), pa.int32()), pa.array(scores.ravel(), from_pandas=False))
    row = pa.array(np.zeros(n, dtype=np.int64))
    return pa.RecordBatch.from_arrays([*[block.column(c).take(row) for c in keys], block.column("region_id").flatten(), block.column("y").flatten(), s], [*keys, "region_id", "y", "_s"])


def _schema(state: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in keys)


def _scored_schema(state: DataFrame, keys: list[str]) -> str:
    return ", ".join([_schema(state, keys), *[f"{c} {state.schema[c].dataType.elementType.simpleString()}" for c in ("region_id", "y")], "_s array<double>"])


def _scored(state: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, region_id, y, _s), the rows of the blocks with their ``k`` scores."""
    def unpack(batches):
        for b in batches:
            for i, (_, x, _) in enumerate(each_block(b, keys, ["y"])):
                yield _rows_of(b.slice(i, 1), keys, x[:, :k])

    return state.mapInArrow(unpack, _scored_schema(state, keys))
