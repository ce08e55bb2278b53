"""Trees of CSV and GeoJSON files."""

import json

from cellgrove.sources import cells as src


def tree(root):
    for region, header, body, types in (("A", "cell_id,m1,m2", "1,1.5,2.5\n2,,NaN", "cell_id,cell_type\n1,T\n2,NA"), ("B", "cell_id,m2,m3", "1,7,8", "cell_id,cell_type,fine\n1,T,t4")):
        d = root / "regions" / region
        d.mkdir(parents=True)
        (d / "coordinates.csv").write_text("cell_id,x,y\n1,0.5,1\n2,3,4\n")
        (d / "expression.csv").write_text(f"{header}\n{body}\n")
        (d / "cell_types.csv").write_text(types + "\n")
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    features = [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"kind": "tumor"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    (root / "regions" / "A" / "tissue_polygons.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (root / "m1.csv").write_text("region_id,patient_id,os\nA,007,3\n")
    (root / "m2.csv").write_text("region_id,patient_id,label\nB,010,NA\n")


def test_tree(spark, tmp_path):
    tree(tmp_path)
    root = str(tmp_path)
    assert src.read_coordinates(spark, root).count() == 4
    e = {(r.region_id, r.cell_id, r.marker): r.value for r in src.read_expression(spark, root).collect()}
    assert e == {("A", 1, "m1"): 1.5, ("A", 1, "m2"): 2.5, ("A", 2, "m1"): None, ("A", 2, "m2"): None, ("B", 1, "m2"): 7.0, ("B", 1, "m3"): 8.0}
    t = {(r.region_id, r.cell_id): r.fine for r in src.read_cell_types(spark, root, column="fine").collect()}
    assert t == {("A", 1): "T", ("A", 2): None, ("B", 1): "t4"}
    p = {(r.region_id, r.kind): len(r.rings) for r in src.read_polygons(spark, root).collect()}
    assert p == {("A", "tissue"): 1, ("A", "tumour"): 2}
    m = {r.region_id: r for r in src.read_metadata(spark, [f"{root}/m1.csv", f"{root}/m2.csv"]).collect()}
    assert m["A"].patient_id == "007" and m["B"].label is None and m["A"].os == 3
    assert [r[0] for r in src.region_ids(src.read_coordinates(spark, root)).collect()] == ["A", "B"]
    src.ingest(spark, root, str(tmp_path / "out"), dataset="d")
    assert spark.read.parquet(str(tmp_path / "out" / "expression")).filter("dataset = 'd'").count() == 6
