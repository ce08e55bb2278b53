"""Rows of runs packed into blocks, so that a step over all rows is NumPy on a few large arrays a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.scratch import materialize

#: Numbers of ``x`` that a task holds before it packs them.
NUMBERS = 2_000_000


def _codes(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """A number for each row that is the same for the same keys."""
    out = np.zeros(b.num_rows, dtype=np.int64)
    for k in keys:
        coded = b.column(k).dictionary_encode()
        out = np.unique(out * (len(coded.dictionary) + 1) + coded.indices.fill_null(-1).to_numpy() + 1, return_inverse=True)[1]
    return out


def _packed(b: pa.RecordBatch, keys: list[str], columns: list[str], starts: np.ndarray) -> list[pa.Array]:
    """Keys, x and ``columns`` of the blocks that begin at ``starts`` and end before the next one."""
    at = pa.array(np.r_[starts, b.num_rows], pa.int32())
    x = b.column("x")
    inner = pa.array(x.offsets.to_numpy()[at.to_numpy()] - x.offsets[0].as_py(), pa.int32())
    return [*[b.column(k).take(at[:-1]) for k in keys], pa.ListArray.from_arrays(inner, x.flatten()), *[pa.ListArray.from_arrays(at, b.column(c)) for c in columns]]


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(rows: DataFrame, *, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` (keys, x, columns), written as a table of blocks (keys, x, columns): ``x`` end to end, other columns as arrays, a block of one run."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            b = _one(held)
            code = _codes(b, keys)
            order = np.argsort(code, kind="stable")
            code = code[order]
            return pa.RecordBatch.from_arrays(_packed(b.take(pa.array(order)), keys, columns, np.flatnonzero(np.r_[True, code[1:] != code[:-1]])), [*keys, "x", *columns])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column("x").flatten())
            if size > NUMBERS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return materialize(rows.select(*keys, "x", *columns).mapInArrow(pack, _schema(rows, keys, columns)), "blocks")


def packed_in_order(rows: DataFrame, *, keys: list[str], columns: list[str], by: str) -> DataFrame:
    """`packed`, with falling ``by`` (one of ``columns``) through the blocks of a run in the order of (_range, _block), and rows that are equal in it in one block."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0

        def out(end: bool) -> pa.RecordBatch | None:
            nonlocal held, size, made
            b = _one(held)
            code, value = _codes(b, keys), b.column(by).to_numpy(zero_copy_only=False)
            new = np.r_[True, code[1:] != code[:-1]]
            cut = b.num_rows if end else int(np.flatnonzero(new | np.r_[True, value[1:] != value[:-1]])[-1])
            held, size = ([b.slice(cut)], 0) if cut < b.num_rows else ([], 0)
            if not cut:
                return None
            starts = np.flatnonzero(new[:cut])
            numbers = pa.array(np.arange(made, made + len(starts)), pa.int64())
            made += len(starts)
            part = _one([b.slice(0, cut)])
            return pa.RecordBatch.from_arrays([*_packed(part, keys, columns, starts), part.column("_range").take(pa.array(starts)), numbers], [*keys, "x", *columns, "_range", "_block"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column("x").flatten())
            if size > NUMBERS and (found := out(False)):
                yield found
        if held:
            yield out(True)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*keys, "x", *columns).repartitionByRange(n, *keys, F.desc(by)).sortWithinPartitions(*keys, F.desc(by)).withColumn("_range", F.spark_partition_id().cast("long"))
    return materialize(placed.mapInArrow(pack, _schema(rows, keys, columns) + ", _range long, _block long"), "blocks")


def _schema(rows: DataFrame, keys: list[str], columns: list[str]) -> str:
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return ", ".join([*[f"`{k}` {kind(k)}" for k in keys], "x array<double>", *[f"`{c}` array<{kind(c)}>" for c in columns]])


def each_block(b: pa.RecordBatch, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, np.ndarray, list[np.ndarray]]]:
    """(keys, matrix of x, columns) of the blocks of an Arrow batch."""
    names, lists = [b.column(k).to_pylist() for k in keys], [b.column(c) for c in ("x", *columns)]
    parts = [(v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()) for v in lists]
    rows = parts[1][1]
    for i, run in enumerate(zip(*names, strict=True)):
        x, *others = [flat[at[i] : at[i + 1]] for flat, at in parts]
        yield run, x.reshape(rows[i + 1] - rows[i], -1), others


def lists(vectors: list[np.ndarray]) -> pa.ListArray:
    """Vectors of doubles as an Arrow array; what isn't a number stays one."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, vectors)]), pa.int32()), pa.array(np.concatenate(vectors).astype(float), from_pandas=False))


def vectors_by(blocks: DataFrame, *, keys: list[str], columns: list[str], of: Callable, places: list[str] | None = None) -> DataFrame:
    """(keys, v): ``of(keys, x, *columns)`` of the blocks, a vector, added up by keys in a task; blocks for which it is None are left out. ``of`` gets ``places`` of a block after its keys."""
    places = places or []

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(k).type for k in keys]
            for block, x, others in each_block(b, [*keys, *places], columns):
                v, run = of(block, x, *others), block[: len(keys)]
                if v is not None:
                    totals[run] = totals[run] + v if run in totals else v
        if totals:
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in totals], t) for i, t in enumerate(types)], lists(list(totals.values()))], [*keys, "v"])

    names = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.select(*keys, *places, "x", *columns).mapInArrow(part, f"{names}, v array<double>")


def sums_by_run(blocks: DataFrame, *, keys: list[str], columns: list[str], of: Callable, places: list[str] | None = None) -> dict[tuple, np.ndarray]:
    """For each run (``keys``) the sum over its blocks of ``of(run, x, *columns)``, a vector for a matrix x of rows; runs for which it is None are left out.

    Tasks add up a vector a run, Spark adds these up, and the driver gets one vector a run.
    """
    parts = vectors_by(blocks, keys=keys, columns=columns, of=of, places=places)
    total = parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return {tuple(r[k] for k in keys): np.array(r["v"]) for r in total.collect()}  # one vector a run
