"""Queries of sources, specs, splits and smaller operators on the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove import fixtures as fx
from cellgrove.operators import features as fe
from cellgrove.operators import metrics as me
from cellgrove.operators import mil, normalize, pipelines, prep, spatial, splits, targets
from cellgrove.queries import _FOCAL, EMB, EVENT, LINE, LINE_LONG, META, ORACLES, ORD, SCORE, STRATA, i1, query, r6, t3
from cellgrove.scratch import new_path
from cellgrove.sources import cells as src

_TREE = "(SELECT 'r' || (user_id % 4) AS region_id, user_id % 4 AS r, event_id AS cell_id, event_type AS cell_type, value, ((event_id * 7919) % 1009)::DOUBLE AS x, ((event_id * 104729) % 1013)::DOUBLE AS y FROM events)"


@query("s1_metadata", f"""SELECT region_id::VARCHAR AS region_id, CASE WHEN region_id % 2 = 0 THEN '00' ELSE '' END || patient_id AS patient_id, CASE WHEN region_id % 2 = 0 OR region_id % 3 <> 0 THEN cohort END AS cohort,
CASE WHEN region_id % 2 = 0 THEN round(time, 4) END AS time, CASE WHEN region_id % 2 = 1 THEN label END AS label FROM {META}""")
def s1(spark: SparkSession, d: str) -> DataFrame:
    root = fx.csv_tree(spark, d, 0)
    return src.read_metadata(spark, [f"{root}/meta_a.csv", f"{root}/meta_b.csv"]).select("region_id", "patient_id", "cohort", F.round("time", 4).alias("time"), "label")


@query("s2_coordinates", f"SELECT region_id, cell_id, x, y FROM {_TREE}")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return src.read_coordinates(spark, fx.csv_tree(spark, d))


@query("s3_expression", f"SELECT region_id, cell_id, 'm' || (1 + r % 2 + i) AS marker, round(value * (1 + r % 2 + i), 6) AS value FROM {_TREE}, (SELECT unnest([0, 1]) AS i)")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return r6(src.read_expression(spark, fx.csv_tree(spark, d)), "value")


@query("s4_s9_cell_types", f"SELECT region_id, cell_id, CASE WHEN cell_id % 5 <> 0 THEN cell_type END AS cell_type_uniform FROM {_TREE}")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return src.read_cell_types(spark, fx.csv_tree(spark, d), column="cell_type_uniform")


@query("s5_polygons", f"""SELECT DISTINCT region_id, 'tissue' AS kind, ((900 + r) * (900 + r))::DOUBLE AS area FROM {_TREE} UNION ALL SELECT DISTINCT region_id, 'tumour', (10000 * r * r)::DOUBLE FROM {_TREE} WHERE r > 0""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return src.read_polygons(spark, fx.csv_tree(spark, d)).select("region_id", "kind", spatial.polygon_area(F.col("rings")).alias("area"))


@query("s6_s7_regions", f"SELECT region_id, count(*) AS n_cells FROM {_TREE} WHERE r IN (1, 3) GROUP BY 1")
def s7(spark: SparkSession, d: str) -> DataFrame:
    cells = src.read_coordinates(spark, fx.csv_tree(spark, d))
    asked = src.region_ids(cells).filter("region_id IN ('r1', 'r3')")
    return targets.cell_counts(targets.load_regions(cells, asked), keys=["region_id"])


@query("s8_summary_file", f"""SELECT marker AS metric, count(*) AS n, printf('%.3f ± %.3f', avg(value), stddev_samp(value)) AS score FROM (SELECT marker, region_id, avg(value) AS value FROM {LINE_LONG} GROUP BY ALL) GROUP BY 1""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    e = fx.line_expression(spark, d).groupBy("region_id", F.col("marker").alias("metric")).agg(F.avg("value").alias("value"))
    path = new_path(spark, "summary.csv")
    src.write_summary(me.with_score_text(me.summarize(e, keys=[])), path)
    return spark.read.csv(path, header=True, schema="metric string, mean double, sd double, n long, score string").select("metric", "n", "score")


SPEC = {"cv_filter": "cohort != 'BUILDING'", "tasks": [
    {"id": "os", "type": "survival", "time_col": "time", "event_col": "event", "row_filter": "cohort == 'BUILDING' and time.notna()"},
    {"id": "response", "type": "binary_classification", "label_col": "label", "positive_class": 1, "row_filter": "time > 500", "drop_na_cols": ["multi"]},
    {"id": "place", "type": "multiclass_classification", "label_col": "multi"}]}


@query("p3_task_rows", f"SELECT 'os' AS task, region_id FROM {META} WHERE cohort = 'BUILDING' UNION ALL SELECT 'response', region_id FROM {META} WHERE time > 500 AND multi <> 'ASIA' UNION ALL SELECT 'place', region_id FROM {META} WHERE multi <> 'ASIA'")
def p3(spark: SparkSession, d: str) -> DataFrame:
    m = fx.event_metadata(spark, d).withColumn("multi", F.when(F.col("multi") != "ASIA", F.col("multi")))
    rows = [targets.task_rows(m, targets.find_task(SPEC, t)).select(F.lit(t).alias("task"), "region_id") for t in ("os", "response", "place")]
    return rows[0].union(rows[1]).union(rows[2])


@query("p5_p7_multiclass_lookup", f"SELECT region_id, region_id % 7 AS place, multi AS label FROM {META} WHERE region_id % 3 = 0")
def p5(spark: SparkSession, d: str) -> DataFrame:
    m = fx.event_metadata(spark, d)
    asked = m.filter("region_id % 3 = 0").select("region_id", (F.col("region_id") % 7).alias("place"))
    return targets.build_target(m, targets.find_task(SPEC, "place"), asked)


@query("p9_subset", f"SELECT region_id || '_sub' AS region_id, count(*) AS n_cells, CASE WHEN region_id <> 9 THEN 0.24 END AS tissue FROM (SELECT region_id, cell_id FROM {EVENT}) e WHERE cell_id % 3 = 0 GROUP BY e.region_id")
def p9(spark: SparkSession, d: str) -> DataFrame:
    cells, polygons = fx.event_cells(spark, d, 10), fx.event_polygons(spark, d)
    third = cells.filter("cell_id % 3 = 0").select("region_id", "cell_id")
    chosen = third.union(third)
    own = targets.subset_cells(cells, chosen, new_region="_sub")
    areas = spatial.areas_mm2(own, targets.subset_polygons(polygons, chosen, new_region="_sub"), mpp=fx.MPP)
    return targets.cell_counts(own, keys=["region_id"]).join(areas, "region_id").select("region_id", "n_cells", F.round("tissue", 6).alias("tissue"))


@query("f2_type_column", f"SELECT DISTINCT region_id, cell_type FROM {LINE}")
def f2(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.line_cells(spark, d)
    return fe.vocabulary(cells, keys=["region_id"], type_col=fe.type_column(cells, "cell_type_uniform"))


@query("f9_aligned_types", f"SELECT region_id, CASE WHEN cell_id % 3 <> 0 THEN cell_type END AS cell_type, count(*) AS n FROM {EVENT} GROUP BY ALL")
def f9(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.event_cells(spark, d, 10)
    types = cells.filter("cell_id % 3 <> 0").select("region_id", "cell_id", "cell_type")
    return fe.align_types(cells.select("region_id", "cell_id", "x", "y"), types).groupBy("region_id", "cell_type").agg(F.count("*").alias("n"))


@query("f12_shared_panel", f"SELECT marker FROM (SELECT * FROM {EMB} WHERE NOT (marker IN ('m1', 'm2') AND region_id = 3) AND NOT (marker = 'm5' AND region_id = 15)) GROUP BY marker HAVING count(DISTINCT region_id) = 20")
def f12(spark: SparkSession, d: str) -> DataFrame:
    e = fx.embedding_expression(spark, d).filter("NOT (marker IN ('m1', 'm2') AND region_id = 3) AND NOT (marker = 'm5' AND region_id = 15)")
    return fe.shared_panel(e.filter("region_id < 10"), e.filter("region_id >= 10"), keys=["region_id"])


@query("n3_raw", f"SELECT region_id, marker, round(avg(value), 4) AS mean_value FROM {LINE_LONG} GROUP BY ALL")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(fx.line_expression(spark, d), keys=["region_id"], method="none").groupBy("region_id", "marker").agg(F.round(F.avg("value"), 4).alias("mean_value"))


@query("n4_numeric_markers", """SELECT marker, count(value) AS n, round(sum(value), 2) AS total FROM (SELECT unnest([{'marker': 'l_quantity', 'value': l_quantity::DOUBLE}, {'marker': 'l_tax', 'value': l_tax::DOUBLE}], recursive := true) FROM lineitem) GROUP BY 1""")
def n4(spark: SparkSession, d: str) -> DataFrame:
    wide = fx.read(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_tax")
    return normalize.melt(wide, keys=["l_suppkey"]).groupBy("marker").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("n5_markers_at_zero", f"""SELECT region_id % 10 AS part, count(*) AS n_markers, count(*) FILTER (q = 0) AS n_at_zero FROM (SELECT region_id % 10 AS region_id, marker, quantile_cont(value, 0.2) AS q FROM {LINE_LONG} GROUP BY ALL) GROUP BY 1""")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return normalize.markers_at_zero(fx.line_expression(spark, d).withColumn("part", F.col("region_id") % 10), keys=["part"])


@query("n6_range_check", f"""WITH chosen AS (SELECT region_id FROM (SELECT DISTINCT region_id FROM {EMB}) ORDER BY md5('0:' || region_id), region_id LIMIT 6)
SELECT marker, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, round(quantile_cont(v, 0.999), 6) AS p999, round(max(v), 6) AS max_value FROM (SELECT marker, asinh(value / 0.1) AS v FROM {EMB} WHERE region_id IN (SELECT region_id FROM chosen)) GROUP BY 1""")
def n6(spark: SparkSession, d: str) -> DataFrame:
    e = normalize.normalize(fx.embedding_expression(spark, d), keys=["region_id"], cofactor=0.1)
    return r6(normalize.range_check(e), "p50", "p99", "p999", "max_value")


@query("d1_type_pairs", f"SELECT a.cell_type AS a_type, b.cell_type AS b_type FROM (SELECT DISTINCT cell_type FROM {EVENT}) a, (SELECT DISTINCT cell_type FROM {EVENT}) b")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return spatial.type_pairs(fx.event_cells(spark, d, 10))


@query("d3_subsample", f"SELECT region_id, cell_type, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY region_id, cell_type ORDER BY md5('42:' || cell_id), cell_id) AS rn FROM {EVENT}) WHERE rn <= 50")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return spatial.subsample(fx.event_cells(spark, d, 10), 50).select("region_id", "cell_type", "cell_id")


@query("d5_box_area", f"SELECT region_id, greatest((max(x) - min(x)) * (max(y) - min(y)), 1.0) AS area FROM {EVENT} GROUP BY 1")
def d5_box(spark: SparkSession, d: str) -> DataFrame:
    return spatial.box_area(fx.event_cells(spark, d, 10))


@query("g5_names", f"SELECT DISTINCT region_id, cell_id AS focal_cell_id, region_id || '___nbhd-cell' || cell_id || '-r50um' AS neighbourhood_id FROM {_FOCAL}")
def g5(spark: SparkSession, d: str) -> DataFrame:
    n = spatial.neighbourhood(fx.event_cells(spark, d, 10), i1(spark, d), radius_um=50.0, mpp=fx.MPP)
    return n.select("region_id", "focal_cell_id", "neighbourhood_id").distinct()


@query("p11_units", f"SELECT region_id, cell_id, round(x * 0.5, 6) AS x_um, round(x / 0.5, 6) AS x_px, round(x * y * 0.25 / 1e6, 9) AS mm2 FROM {EVENT}")
def p11(spark: SparkSession, d: str) -> DataFrame:
    c = fx.event_cells(spark, d, 10)
    return c.select("region_id", "cell_id", F.round(F.col("x") * fx.MPP, 6).alias("x_um"), F.round(targets.pixels(F.col("x"), fx.MPP), 6).alias("x_px"), F.round(targets.square_mm(F.col("x") * F.col("y"), fx.MPP), 9).alias("mm2"))


@query("x5_fold_path", f"""WITH p AS (SELECT count(*) AS n, max(c) AS m FROM (SELECT stratum, sum(count(*)) OVER () AS t, count(*) AS c FROM {STRATA} GROUP BY 1)), t AS (SELECT count(*) AS n FROM {STRATA})
SELECT 'all' AS part, t.n AS patients, 5 AS folds, CASE WHEN p.m >= 5 THEN 'stratified' ELSE 'plain' END AS path FROM p, t UNION ALL SELECT 'all plain', t.n, 5, 'plain' FROM t UNION ALL SELECT 'one', 1, 0, 'none' UNION ALL SELECT 'none', 0, 0, 'none' UNION ALL SELECT 'strata of one', 3, 3, 'plain'""")
def x5(spark: SparkSession, d: str) -> DataFrame:
    p = splits.patient_strata(fx.order_metadata(spark, d), "label")
    first = p.orderBy("patient_id")
    three = first.limit(3).withColumn("stratum", F.col("patient_id"))
    cases = {"all": (p, True), "all plain": (p, False), "one": (first.limit(1), True), "none": (p.filter("false"), True), "strata of one": (three, True)}
    out = None
    for name, (rows, stratified) in cases.items():
        one = splits.fold_path(rows, k=5, stratified=stratified).select(F.lit(name).alias("part"), "patients", "folds", "path")
        out = one if out is None else out.union(one)
    return out


_MODE = "SELECT '{task}' AS task, patient_id, stratum::VARCHAR AS stratum FROM (SELECT patient_id, stratum, row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, stratum) AS rn FROM (SELECT patient_id, {column} AS stratum, count(*) AS n FROM {meta} GROUP BY 1, 2)) WHERE rn = 1"


@query("x6_stratify_column", _MODE.format(task="survival", column="event", meta=META) + " UNION ALL " + _MODE.format(task="binary", column="label", meta=META))
def x6(spark: SparkSession, d: str) -> DataFrame:
    m = fx.event_metadata(spark, d)
    kinds = {"survival": targets.find_task(SPEC, "os"), "binary": targets.find_task(SPEC, "response")}
    parts = [splits.patient_strata(m, splits.stratify_column(t)).select(F.lit(k).alias("task"), "patient_id", F.col("stratum").cast("string").alias("stratum")) for k, t in kinds.items()]
    return parts[0].union(parts[1])


@query("x8_both_sides", f"SELECT region_id, CASE WHEN cohort = '1-URGENT' THEN 'train' ELSE 'test' END AS role FROM {ORD} WHERE cohort IN ('1-URGENT', '5-LOW')")
def x8(spark: SparkSession, d: str) -> DataFrame:
    m = fx.order_metadata(spark, d)
    given = splits.both_sides(splits.cohort_roles(m, column="cohort", train=["1-URGENT"], test=["5-LOW"]))
    return given.union(splits.both_sides(splits.cohort_roles(m, column="cohort", train=["1-URGENT"], test=["no such cohort"])))


@query("t4_vectors", f"SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY feature) - 1 AS place, value FROM ({ORACLES['t3_prepared']})")
def t4(spark: SparkSession, d: str) -> DataFrame:
    ready = t3(spark, d).withColumn("role", F.lit("train"))
    return prep.assemble(ready, keys=[]).select("region_id", F.posexplode("x").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query("i4_bag_labels", f"""WITH m AS (SELECT f.region_id, f.region_id || '#inst' || f.cell_id AS instance_id, count(*) AS n FROM {_FOCAL} f JOIN {EVENT} c ON c.region_id = f.region_id AND (c.x - f.x) ** 2 + (c.y - f.y) ** 2 <= 10000 GROUP BY ALL HAVING count(*) >= 10)
SELECT m.region_id, instance_id, label FROM m JOIN {META} t ON t.region_id = m.region_id""")
def i4(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.event_cells(spark, d, 10)
    return mil.bag_labels(mil.instances(cells, i1(spark, d)), fx.event_metadata(spark, d))


@query("i6_no_instance", f"SELECT DISTINCT region_id, c AS class, 0.5 AS proba FROM {EVENT}, (SELECT unnest([0, 1]) AS c) WHERE region_id >= 5 UNION ALL SELECT DISTINCT region_id, c, CASE WHEN c = 1 THEN 0.25 ELSE 0.75 END FROM {EVENT}, (SELECT unnest([0, 1]) AS c) WHERE region_id < 5")
def i6(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.event_cells(spark, d, 10)
    p = cells.filter("region_id < 5").select("region_id", F.col("cell_id").alias("instance_id"), F.inline(F.expr("array(named_struct('class', 0, 'proba', 0.75D), named_struct('class', 1, 'proba', 0.25D))")))
    return r6(mil.pool(p, cells, [0, 1]), "proba")


@query("k8_null_metrics", f"SELECT run, m AS metric, NULL::DOUBLE AS value FROM (SELECT DISTINCT run FROM {SCORE}), (SELECT unnest(['auc_roc', 'avg_precision', 'balanced_acc']) AS m)")
def k8(spark: SparkSession, d: str) -> DataFrame:
    return me.null_metrics(fx.scores(spark, d).select("run").distinct(), "binary_classification")


@query("k10_primary", f"SELECT 'place' AS task, 'balanced_acc' AS metric, count(*) AS n FROM {META} UNION ALL SELECT 'os', 'c_index', count(*) FROM {META} UNION ALL SELECT 'response', 'auc_roc', count(*) FROM {META}")
def k10(spark: SparkSession, d: str) -> DataFrame:
    names = sorted({m for x in me.METRICS.values() for m in x})
    types = {t["id"]: t["type"] for t in SPEC["tasks"]}
    each = fx.event_metadata(spark, d).select(F.explode(F.array(*[F.lit(m) for m in names])).alias("metric"), "region_id").withColumn("task", F.explode(F.array(*[F.lit(t) for t in types])))
    return me.primary(each, types).groupBy("task", "metric").agg(F.count("*").alias("n"))


@query("l1_spec_task")
def l1_spec(spark: SparkSession, d: str) -> DataFrame:
    """A task as its spec states it, with row filter and cv filter, and the other one by a forest."""
    f, m = pipelines.composition_features(fx.event_cells(spark, d)), fx.event_metadata(spark, d)
    a = pipelines.cross_validate_task(f, m, SPEC, "response", seeds=[0, 1, 2]).withColumn("model", F.lit("logistic"))
    b = pipelines.cross_validate_task(f, m, SPEC, "response", seeds=[0], model="forest", trees=20, max_depth=5).withColumn("model", F.lit("forest"))
    return r6(a.unionByName(b), "value")


def _sums(cells):
    """The state of `f11_custom_featuriser`: numbers and sums of places by type."""
    c = cells.dropna(subset=["cell_type"])
    c = c.assign(n=1, sx=c.x, sy=c.y, sxx=c.x * c.x, syy=c.y * c.y, sxy=c.x * c.y)
    return _added(c)


def _added(states):
    return states.groupby("cell_type", as_index=False)[["n", "sx", "sy", "sxx", "syy", "sxy"]].sum()


def _slants(s):
    """Correlation of both coordinates by type."""
    value = (s.n * s.sxy - s.sx * s.sy) / ((s.n * s.sxx - s.sx**2) * (s.n * s.syy - s.sy**2)) ** 0.5
    return s.assign(feature="slant_" + s.cell_type, value=value)


@query("f11_custom_featuriser", f"SELECT region_id, 'slant_' || cell_type AS feature, round(corr(x, y), 6) AS value FROM {EVENT} GROUP BY region_id, cell_type")
def f11(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.event_cells(spark, d, 10).select("region_id", "cell_type", "x", "y")
    state = "cell_type string, n long, sx double, sy double, sxx double, syy double, sxy double"
    return r6(fe.custom_merged(cells, partial=_sums, merge=_added, finish=_slants, keys=["region_id"], state=state, schema="feature string, value double"), "value")
