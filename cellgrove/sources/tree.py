"""A Spark data source for trees of region folders: ``spark.read.format("region_tree")``.

Options: ``path`` (the tree), ``table`` (expression or cell_types), ``column`` (of the type files) and ``regions`` (a JSON list of names; all where it isn't given). The planner lists
names of folders, never files, and not even those for given regions: only these folders are opened then. Tasks get a slice of folders each, read the header of each file, since
panels differ, and stream the rows in Arrow batches, so no file is held whole and the plan is the same however many headers there are. Paths are those that pyarrow's file systems open.

Filters aren't pushed down: on Spark 4.1 a count without a filter, after a filtered scan of the same DataFrame, missed the rows that the filter had left out; hence ``regions``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Text that a CSV reader takes as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: Folders of a task.
SLICE = 64
#: Bytes of a file that are read and parsed at a time; a row must fit.
BLOCK = 4 << 20


class Folders(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def _numbers(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> pa.Array:
    """Text as numbers; what is none is null."""
    floats = pd.to_numeric(column.to_pandas(), errors="coerce")
    whole = floats if pa.types.is_floating(kind) else floats.where(np.mod(floats, 1) == 0)
    return pa.Array.from_pandas(whole, type=kind, safe=False)


def _files(store: pafs.FileSystem, path: str) -> list[str]:
    """The file, or the parts of a folder of that name as Spark writes it; none if there is neither."""
    kind = store.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        inside = store.get_file_info(pafs.FileSelector(path))
        return sorted(i.path for i in inside if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [path] if kind == pafs.FileType.File else []


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.table, self.column = options["path"].rstrip("/"), options["table"], options.get("column", "cell_type")
        self.asked: list[str] | None = json.loads(options["regions"]) if "regions" in options else None

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.root))

    def partitions(self) -> list[Folders]:
        if self.asked is None:
            store, at = self._store()
            names = sorted(i.base_name for i in store.get_file_info(pafs.FileSelector(f"{at}/regions")) if i.type == pafs.FileType.Directory)
        else:
            names = sorted({n for n in self.asked if n})
        return [Folders(names[i : i + SLICE]) for i in range(0, len(names), SLICE)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, at = self._store()
        for name in partition.names:
            for path in _files(store, f"{at}/regions/{name}/{self.table}.csv") if "/" not in name else []:
                yield from self._read_file(store, path, name)

    def _read_file(self, store: pafs.FileSystem, path: str, region: str) -> Iterator[pa.RecordBatch]:
        with store.open_input_stream(path) as f:
            head = b""
            while b"\n" not in head and (more := f.read(4096)):
                head += more
        if not head.partition(b"\n")[2]:
            return  # a header alone
        header = [c.strip().strip('"') for c in head.partition(b"\n")[0].decode("utf-8-sig").rstrip("\r").split(",")]
        kept = self._columns(header, path)
        read = pacsv.ReadOptions(column_names=header, skip_rows=1, block_size=BLOCK)
        convert = pacsv.ConvertOptions(column_types={c: pa.string() for c in header}, include_columns=["cell_id", *kept], null_values=NULL_TOKENS, strings_can_be_null=True)
        with store.open_input_stream(path) as f:
            for batch in pacsv.open_csv(f, read_options=read, convert_options=convert):
                yield from self._rows(region, batch, kept)

    def _columns(self, header: list[str], path: str) -> list[str]:
        if self.table == "expression":
            return [c for c in header if c != "cell_id"]
        found = self.column if self.column in header else "cell_type"
        if found not in header:
            raise ValueError(f"no cell type column in {path}")
        return [found]

    def _rows(self, region: str, batch: pa.RecordBatch, kept: list[str]) -> Iterator[pa.RecordBatch]:
        ids = _numbers(batch.column("cell_id"), pa.int64())
        regions = pa.array([region] * len(ids), pa.string())
        if self.table == "cell_types":
            yield pa.RecordBatch.from_arrays([regions, ids, batch.column(kept[0])], names=["region_id", "cell_id", self.column])
            return
        for marker in kept:
            values = _numbers(batch.column(marker), pa.float64())
            yield pa.RecordBatch.from_arrays([regions, ids, pa.array([marker] * len(ids), pa.string()), values], names=["region_id", "cell_id", "marker", "value"])


class RegionTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "region_tree"

    def schema(self) -> str:
        if self.options["table"] == "expression":
            return "region_id string, cell_id bigint, marker string, value double"
        if self.options["table"] != "cell_types":
            raise ValueError("table is expression or cell_types")
        return f"region_id string, cell_id bigint, `{self.options.get('column', 'cell_type')}` string"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, table: str, *, regions: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a tree, or of some of its regions, by the data source, which is registered here. A path without a scheme is one of the default file system."""
    if ":/" not in root:
        root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + "/" + root.lstrip("/")
    spark.dataSource.register(RegionTree)
    asked = {} if regions is None else {"regions": json.dumps(regions)}
    return spark.read.format("region_tree").options(path=root, table=table, **options, **asked).load()
