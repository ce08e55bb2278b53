"""The data source of region folders."""

import pytest
from pyspark.sql import functions as F

from cellgrove.sources import cells as src
from cellgrove.sources import tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """150 regions of two headers, one with blocks of many rows, one without files, one with a header alone, one whose name is odd."""
    top = tmp_path_factory.mktemp("tree") / "data"
    for i in range(150):
        d = top / "regions" / f"r{i:03d}"
        d.mkdir(parents=True)
        rows = 30_000 if i == 7 else 3
        markers = ("m1", "m2") if i % 2 else ("m2", "m3")
        (d / "expression.csv").write_text("cell_id," + ",".join(markers) + "\n" + "".join(f"{k},{k + i}.5,{'NA' if k == 1 else 'odd' if k == 2 else i}\n" for k in range(rows)))
        column = "cell_id,cell_type,fine\n" if i % 3 else "cell_id,cell_type\n"
        (d / "cell_types.csv").write_text(column + "".join(f"{k},T{k},f{k}\n" if i % 3 else f"{k},{'null' if k == 1 else 'U'}\n" for k in range(3)))
    (top / "regions" / "empty").mkdir()
    (top / "regions" / "a b=1").mkdir()
    (top / "regions" / "a b=1" / "expression.csv").write_text("cell_id,m9")
    return str(top)


def test_rows(spark, root):
    e = src.read_expression(spark, root)
    assert e.count() == 2 * (149 * 3 + 30_000)
    got = {(r.cell_id, r.marker): r.value for r in e.filter("region_id = 'r003'").collect()}
    assert got == {(0, "m1"): 3.5, (1, "m1"): 4.5, (2, "m1"): 5.5, (0, "m2"): 3.0, (1, "m2"): None, (2, "m2"): None}
    big = e.filter("region_id = 'r007' AND marker = 'm1'").agg(F.count("value"), F.sum("value")).first()
    assert tuple(big) == (30_000, sum(k + 7.5 for k in range(30_000)))
    t = src.read_cell_types(spark, root, column="fine")
    assert {r.fine for r in t.filter("region_id = 'r001'").collect()} == {"f0", "f1", "f2"} and {r.fine for r in t.filter("region_id = 'r000'").collect()} == {"U", None}
    assert t.count() == 450 and e.filter("region_id = 'empty'").count() == 0 and e.filter("region_id = 'a b=1'").count() == 0


def test_only_asked_folders_are_planned(root):
    planned = lambda **o: [p.names for p in tree.TreeReader({"path": root, "table": "expression", **o}).partitions()]
    assert [len(names) for names in planned()] == [64, 64, 24]
    assert planned(regions='["r002", "r001", "r002", "none"]') == [["none", "r001", "r002"]] and planned(regions="[]") == [[]]


def test_given_regions(spark, root):
    """A region that isn't there has no rows; a filter leaves the other scans of a frame whole."""
    some = src.read_expression(spark, root, regions=["r001", "r002", "none"])
    assert some.rdd.getNumPartitions() == 1
    for wanted in (["r001"], ["r002"], ["none"]):
        assert some.filter(F.col("region_id").isin(wanted)).count() == (0 if wanted == ["none"] else 6)
        assert some.count() == 12
    assert src.read_expression(spark, root, regions=[]).count() == 0


def test_parts_as_spark_writes_them(spark, tmp_path):
    """A folder of parts in the place of a file, compressed or not."""
    rows = spark.range(1000).select(F.col("id").alias("cell_id"), (F.col("id") * 2.0).alias("m1"))
    rows.repartition(3).write.csv(f"{tmp_path}/regions/a/expression.csv", header=True)
    rows.repartition(2).write.csv(f"{tmp_path}/regions/b/expression.csv", header=True, compression="gzip")
    e = src.read_expression(spark, str(tmp_path))
    assert sorted(map(tuple, e.groupBy("region_id").agg(F.count("value"), F.sum("value")).collect())) == [("a", 1000, 999_000.0), ("b", 1000, 999_000.0)]


def test_no_type_column(spark, tmp_path):
    d = tmp_path / "regions" / "r"
    d.mkdir(parents=True)
    (d / "cell_types.csv").write_text("cell_id,other\n1,a\n")
    with pytest.raises(Exception, match="no cell type column"):
        src.read_cell_types(spark, str(tmp_path)).collect()
