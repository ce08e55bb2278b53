"""Linear models of all runs at once: each step is one job of sums by run, the driver gets gradients and Hessians and solves for the next step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.blocks import packed, packed_in_order, sums_by_run, vectors_by

CUTOFF = 1e-7
#: Penalty on intercepts of several classes, which are only determined up to a constant.
GAUGE = 1e-8


def probabilities(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of classes (rows of ``beta``, intercept first; one row: of label 1 alone) for the rows of ``x``."""
    z = beta[:, 0] + x @ beta[:, 1:].T
    if len(beta) == 1:
        return 1 / (1 + np.exp(-z))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logistic_sums(beta: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the weighted log loss in one vector; labels are places in the classes."""
    p = probabilities(beta, x)
    x = np.c_[np.ones(len(x)), x]
    k, d = beta.shape
    hit = label[:, None] == np.arange(k) if k > 1 else label[:, None] == 1
    own = np.where(hit, p, 0).sum(axis=1) if k > 1 else np.where(hit[:, 0], p[:, 0], 1 - p[:, 0])
    loss = -(weight * np.log(np.maximum(own, 1e-300))).sum()
    gradient = ((p - hit) * weight[:, None]).T @ x
    hessian = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            share = p[:, a] * ((a == b) - p[:, b])
            hessian[a, :, b, :] = (x * (weight * share)[:, None]).T @ x
            hessian[b, :, a, :] = hessian[a, :, b, :]
    return np.r_[loss, gradient.ravel(), hessian.ravel()]


def penalised_step(beta: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, *, rounds: int = 1000) -> np.ndarray:
    """The minimum of the quadratic that gradient and Hessian make about ``beta``, plus ridge beta^2 / 2 + lasso |beta|, by coordinate descent."""
    if not lasso.any():
        return beta - np.linalg.solve(h + np.diag(ridge), g + ridge * beta)
    new, q = beta.copy(), g.copy()  # q: gradient of the quadratic at ``new``
    diagonal = np.diag(h)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(new)):
            if diagonal[j] + ridge[j] <= 0:
                continue
            z = diagonal[j] * new[j] - q[j]
            value = np.sign(z) * max(abs(z) - lasso[j], 0.0) / (diagonal[j] + ridge[j])
            if value != new[j]:
                q += h[:, j] * (value - new[j])
                most = max(most, abs(value - new[j]))
                new[j] = value
        if most < CUTOFF / 100:
            break
    return new


def fit_softmax(rows: DataFrame, classes: list, *, keys: list[str], c: float = 1.0, l1_ratio: float = 0.0, max_iter: int = 50, failed: dict | None = None) -> DataFrame:
    """(keys, beta) with a row of coefficients a class, intercept first: logistic regressions of (keys, x, label, weight) of all runs.

    Minimises c * sum(weight * log loss) + l1_ratio |beta|_1 + (1 - l1_ratio) |beta|^2 / 2, intercepts left out. With several classes all have coefficients (the
    softmax); of two the second has, and is label 1. Each step is a Newton step for which coordinate descent solves, from sums of loss, gradient and Hessian
    by run; a step that makes a run worse is halved. A run that ends takes no part in later steps; one that can't be solved has no row and goes to ``failed``.
    """
    failed = {} if failed is None else failed
    k = 1 if len(classes) == 2 else len(classes)
    place = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("label")) - 1
    rows = packed(rows.select(*keys, "x", place.cast("int").alias("label"), F.col("weight").cast("double").alias("weight")), keys=keys, columns=["label", "weight"])
    sizes = {run: p for run, (p, _) in widths(rows, keys, "label").items()}
    betas = {run: np.zeros((k, p + 1)) for run, p in sizes.items()}
    before, loss, done = {run: (b, None) for run, b in betas.items()}, {}, {}

    def penalties(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.ones(beta.shape)
        own[:, 0] = 0
        return (own * (1 - l1_ratio) / c + (own == 0) * (GAUGE if k > 1 else 0)).ravel(), (own * l1_ratio / c).ravel()

    for _ in range(max_iter):
        if not betas:
            break
        now = dict(betas)
        sums = sums_by_run(rows, keys=keys, columns=["label", "weight"], of=lambda run, x, y, w: logistic_sums(now[run], x, y, w) if run in now else None)  # noqa: B023
        for run, v in sums.items():
            beta = betas[run]
            n = beta.size
            ridge, lasso = penalties(beta)
            b = beta.ravel()
            loss = v[0] + (ridge * b * b).sum() / 2 + (lasso * np.abs(b)).sum()
            old, least = before[run]
            if least is not None and loss > least + 1e-9 * abs(least) and np.abs(beta - old).max() > CUTOFF:
                betas[run] = (beta + old) / 2
                continue
            try:
                new = penalised_step(b, v[1 : n + 1], v[n + 1 :].reshape(n, n), ridge, lasso)
                if not np.isfinite(new).all():
                    raise np.linalg.LinAlgError("the step isn't finite")
            except np.linalg.LinAlgError as e:
                failed[run] = str(e)
                del betas[run]
                continue
            if k > 1:  # intercepts add up to 0 at the optimum; what a step adds to all of them is noise that grows with the rows
                new = new.reshape(beta.shape)
                new = np.c_[new[:, 0] - new[:, 0].mean(), new[:, 1:]].ravel()
            before[run], betas[run] = (beta, loss), new.reshape(beta.shape)
            if np.abs(new - b).max() < CUTOFF:
                done[run] = betas.pop(run)
    schema = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in keys) + ", beta array<array<double>>"
    return rows.sparkSession.createDataFrame([(*run, b.tolist()) for run, b in (done | betas).items()], schema)


def predict_softmax(rows: DataFrame, betas: DataFrame, classes: list, *, keys: list[str]) -> DataFrame:
    """(keys, region_id, truth, class, proba) of all classes."""
    dot = lambda b: F.aggregate(F.zip_with(b, F.concat(F.array(F.lit(1.0)), "x"), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    z = F.transform("beta", dot)
    if len(classes) == 2:
        p = F.transform(z, lambda v: 1 / (1 + F.exp(-v)))
        proba = F.array(1 - F.get(p, F.lit(0)), F.get(p, F.lit(0)))
    else:
        e = F.transform("_z", lambda v: F.exp(v - F.array_max("_z")))
        proba = F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda s, u: s + u))
    scored = rows.join(F.broadcast(betas), keys).withColumn("_z", z)  # one small array a run
    if len(classes) > 2:
        scored = scored.withColumn("_e", e)
    names = F.array(*[F.lit(x) for x in classes])
    return scored.select(*keys, "region_id", F.col("label").alias("truth"), F.inline(F.arrays_zip(names.alias("class"), proba.alias("proba"))).alias("class", "proba"))


def widths(blocks: DataFrame, keys: list[str], column: str) -> dict[tuple, tuple[int, int]]:
    """For each run the numbers of its features and of its rows."""
    n = F.size(column)
    found = blocks.groupBy(*keys).agg(F.max((F.size("x") / n).cast("int")).alias("p"), F.sum(n).alias("n"))
    return {tuple(r[k] for k in keys): (r["p"], r["n"]) for r in found.collect()}  # one row a run


def fit_cox(rows: DataFrame, *, keys: list[str], penalizer: float = 0.1, max_iter: int = 25, failed: dict | None = None) -> DataFrame:
    """(keys, beta): ridge Cox models of (keys, x, time, event): log partial likelihood (Efron) / n - penalizer / 2 |beta|^2.

    Rows lie in blocks of falling time, so those at risk at a time are sums over blocks before and within the block. A step is three jobs for all runs: sums of w and w x by block; the
    hazard of each block; gradient and Hessian. The driver adds up the first two along the blocks of a run, a vector and a number a block. A Hessian needs w x x' of those at risk at each event over the
    sum of w there: by exchanging the sums that is each row's own w x x' times the hazard summed up to its time. Rows of one time are in one block; those without a time
    take no part. A run that can't be solved has no row and goes to ``failed``.
    """
    failed = {} if failed is None else failed
    rows = rows.filter(F.col("time").isNotNull()).select(*keys, "x", F.col("time").cast("double").alias("time"), F.coalesce(F.col("event") == 1, F.lit(False)).cast("double").alias("event"))
    rows, columns = packed_in_order(rows, keys=keys, columns=["time", "event"], by="time"), ["time", "event"]
    info, block = widths(rows, keys, "time"), [*keys, "_range", "_block"]
    betas, done = {run: np.zeros(p) for run, (p, _) in info.items()}, {}

    def by_block(of) -> dict[tuple, list[tuple]]:
        """For each run its (range, block, vector) from late to early."""
        out: dict[tuple, list[tuple]] = {}
        for r in vectors_by(rows, keys=block, columns=columns, of=of).collect():  # a vector of sums a block
            out.setdefault(tuple(r[k] for k in keys), []).append((r["_range"], r["_block"], np.array(r["v"])))
        return {run: sorted(v, key=lambda e: e[:2]) for run, v in out.items()}

    for _ in range(max_iter):
        if not betas:
            break
        now = dict(betas)
        sums = by_block(lambda b, x, t, e: _moments(now[b[:-2]], x).sum(axis=0) if b[:-2] in now else None)  # noqa: B023
        before = {(*run, *e[:2]): s - e[2] for run, v in sums.items() for e, s in zip(v, np.cumsum([e[2] for e in v], axis=0), strict=True)}
        hazards = by_block(lambda b, x, t, e: np.array([_risk_sets(now[b[:-2]], x, t, e, before[b])[2].sum()]) if b in before else None)  # noqa: B023
        after = {(*run, *e[:2]): float(s - e[2][0]) for run, v in hazards.items() for e, s in zip(reversed(v), np.cumsum([e[2][0] for e in reversed(v)]), strict=True)}
        of = lambda b, x, t, e: _cox_sums(now[b[:-2]], x, t, e, before[b], after[b]) if b in before else None  # noqa: E731, B023
        found = sums_by_run(rows, keys=keys, columns=columns, places=["_range", "_block"], of=of)
        for run, v in found.items():
            p, n = info[run]
            b = betas[run]
            try:
                step = np.linalg.solve(v[p:].reshape(p, p) / n + penalizer * np.eye(p), v[:p] / n - penalizer * b)
                if not np.isfinite(step).all():
                    raise np.linalg.LinAlgError("the step isn't finite")
            except np.linalg.LinAlgError as e:
                failed[run] = str(e)
                del betas[run]
                continue
            step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
            betas[run] = b + step
            if np.abs(step).max() < CUTOFF * 10:
                done[run] = betas.pop(run)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", beta array<double>"
    return rows.sparkSession.createDataFrame([(*run, b.tolist()) for run, b in (done | betas).items()], schema)


def _moments(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """w and w x of each row."""
    w = np.exp(x @ beta)
    return np.c_[w, x * w[:, None]]


def _risk_sets(beta: np.ndarray, x: np.ndarray, time: np.ndarray, event: np.ndarray, before: np.ndarray) -> tuple:
    """Of a block of falling time, ``before`` which there are the moments ``before``: the moments of rows, the place of a row's time among the times, hazards by time
    and the part of them that those who die then have not, and the means at risk at each tied event (l of d, for which the moments at risk lack l / d of those that die)."""
    m = _moments(beta, x)
    new = np.r_[True, time[1:] != time[:-1]]
    first = np.flatnonzero(new)
    place = np.cumsum(new) - 1
    own, dead = np.add.reduceat(m, first), np.add.reduceat(m * event[:, None], first)
    d = np.add.reduceat(event, first).astype(np.int64)
    at_risk = before + np.cumsum(own, axis=0)
    times = np.repeat(np.arange(len(d)), d)
    share = (np.arange(len(times)) - np.repeat(np.cumsum(d) - d, d)) / d[times]
    s = at_risk[times] - share[:, None] * dead[times]
    hazard, tied = np.bincount(times, 1 / s[:, 0], len(d)), np.bincount(times, share / s[:, 0], len(d))
    return m, place, hazard, tied, s[:, 1:] / s[:, :1]


def _cox_sums(beta: np.ndarray, x: np.ndarray, time: np.ndarray, event: np.ndarray, before: np.ndarray, after: float) -> np.ndarray:
    """Gradient and information of a block; ``after`` is the hazard of the blocks of earlier times."""
    m, place, hazard, tied, means = _risk_sets(beta, x, time, event, before)
    upto = after + np.cumsum(hazard[::-1])[::-1]
    w = m[:, 0] * (upto[place] - event * tied[place])
    return np.r_[event @ x - means.sum(axis=0), ((x * w[:, None]).T @ x - means.T @ means).ravel()]
