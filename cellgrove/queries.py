"""Queries of the engine on the driver's tables, with their SQL twins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove import fixtures as fx
from cellgrove.operators import features as fe
from cellgrove.operators import metrics as me
from cellgrove.operators import mil, models, normalize, pipelines, prep, spatial, splits, targets
from cellgrove.scratch import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


LINE = "(SELECT l_suppkey AS region_id, l_returnflag || l_linestatus AS cell_type FROM lineitem)"
LINE_LONG = "(SELECT l_suppkey AS region_id, m.marker, m.value FROM (SELECT l_suppkey, unnest([{'marker': 'l_quantity', 'value': l_quantity::DOUBLE}, {'marker': 'l_extendedprice', 'value': l_extendedprice::DOUBLE}, {'marker': 'l_discount', 'value': l_discount::DOUBLE}, {'marker': 'l_tax', 'value': l_tax::DOUBLE}]) AS m FROM lineitem))"
EVENT = "(SELECT user_id % 10 AS region_id, event_id AS cell_id, event_type AS cell_type, ((event_id * 7919) % 1009)::DOUBLE AS x, ((event_id * 104729) % 1013)::DOUBLE AS y FROM events)"
EMB = "(SELECT vec_id % 20 AS region_id, vec_id AS cell_id, 'm' || i AS marker, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) t(i))"
META = """(SELECT u.user_id AS region_id, (u.user_id % 60)::VARCHAR AS patient_id, c_mktsegment AS cohort, (c_acctbal > 4000)::INT AS label, r_name AS multi,
  abs(c_acctbal) AS time, (c_nationkey % 2)::DOUBLE AS event
  FROM (SELECT DISTINCT user_id FROM events) u JOIN customer ON c_custkey = u.user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
ORD = "(SELECT o_orderkey AS region_id, o_custkey::VARCHAR AS patient_id, o_orderstatus AS label, o_orderpriority AS cohort FROM orders)"
SCORE = "(SELECT 'quality' AS run, quality AS truth, (n_chars % 97) / 97.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', toxic, (n_chars % 97) / 97.0::DOUBLE FROM labels JOIN documents USING (doc_id))"
PROBA = """(SELECT o_orderkey % 4 AS run, o_orderkey AS region_id, o_orderstatus AS truth, p.c AS class, p.v / (o_orderkey % 7 + o_orderkey % 5 + o_orderkey % 3 + 3)::DOUBLE AS proba
  FROM (SELECT *, unnest([{'c': 'F', 'v': o_orderkey % 7 + 1}, {'c': 'O', 'v': o_orderkey % 5 + 1}, {'c': 'P', 'v': o_orderkey % 3 + 1}]) AS p FROM orders))"""
STRATA = f"(SELECT patient_id, label AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, label) AS rn FROM (SELECT patient_id, label, count(*) AS n FROM {ORD} GROUP BY patient_id, label)) WHERE rn = 1)"


@query("f1_vocabulary", f"SELECT DISTINCT region_id, cell_type FROM {LINE}")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return fe.vocabulary(fx.line_cells(spark, d), keys=["region_id"])


@query("f3_composition", f"""WITH c AS (SELECT region_id, cell_type, count(*) AS n FROM {LINE} GROUP BY ALL), t AS (SELECT region_id, sum(n) AS total FROM c GROUP BY 1),
v AS (SELECT DISTINCT cell_type FROM c) SELECT t.region_id, v.cell_type AS feature, round(coalesce(n, 0) / total::DOUBLE, 6) AS value FROM t CROSS JOIN v LEFT JOIN c ON c.region_id = t.region_id AND c.cell_type = v.cell_type""")
def f3(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.line_cells(spark, d)
    return r6(fe.composition(cells, fe.vocabulary(cells, keys=[]), keys=["region_id"]), "value")


@query("f4_panel", f"SELECT marker FROM {EMB} GROUP BY marker HAVING count(DISTINCT region_id) = (SELECT count(DISTINCT region_id) FROM {EMB})")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return fe.marker_panel(fx.embedding_expression(spark, d), keys=["region_id"])


@query("f5_mean_expression", f"SELECT region_id, marker AS feature, round(avg(value), 4) AS value FROM {LINE_LONG} GROUP BY ALL")
def f5(spark: SparkSession, d: str) -> DataFrame:
    e = fx.line_expression(spark, d)
    return fe.mean_expression(e, fe.marker_panel(e, keys=["region_id"]), keys=["region_id"]).withColumn("value", F.round("value", 4))


@query("f10_wide_table", f"""SELECT region_id, round(count(*) FILTER (cell_type = 'AF') / count(*)::DOUBLE, 6) AS AF, round(count(*) FILTER (cell_type = 'NO') / count(*)::DOUBLE, 6) AS NO,
round(count(*) FILTER (cell_type = 'RF') / count(*)::DOUBLE, 6) AS RF FROM {LINE} GROUP BY 1""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return r6(fe.wide_table(f3(spark, d), ["AF", "NO", "RF"], keys=["region_id"]).na.fill(0.0), "AF", "NO", "RF")


@query("n1_arcsinh", f"SELECT region_id, cell_id, marker, round(asinh(value / 0.1), 6) AS value FROM {EMB}")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return r6(normalize.normalize(fx.embedding_expression(spark, d), keys=["region_id"], cofactor=0.1), "value")


@query("n2_adaptive_arcsinh", f"""WITH q AS (SELECT region_id, marker, 5 * quantile_cont(value, 0.2) + 1e-5 AS c FROM {LINE_LONG} GROUP BY ALL)
SELECT region_id, marker, round(avg(asinh(value / c)), 4) AS mean_value FROM {LINE_LONG} JOIN q USING (region_id, marker) WHERE marker IN ('l_quantity', 'l_extendedprice') GROUP BY ALL""")
def n2(spark: SparkSession, d: str) -> DataFrame:
    e = fx.line_expression(spark, d).filter("marker IN ('l_quantity', 'l_extendedprice')")
    out = normalize.normalize(e, keys=["region_id"], cofactor="adaptive")
    return out.groupBy("region_id", "marker").agg(F.round(F.avg("value"), 4).alias("mean_value"))


@query("n5_profile", f"""SELECT marker, count(value) AS n, min(value) AS min_value, max(value) AS max_value, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.99), 6) AS p99, round(avg((value = 0)::INT), 6) AS zero_share FROM {LINE_LONG} GROUP BY 1""")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return r6(normalize.profile(fx.line_expression(spark, d), keys=["marker"]), "p20", "p50", "p99", "zero_share")


@query("p2_filter_unless_empty", f"SELECT region_id, cohort FROM {META} WHERE cohort = 'BUILDING'")
def p2(spark: SparkSession, d: str) -> DataFrame:
    m = fx.event_metadata(spark, d)
    one = targets.filter_unless_empty(m, "cohort == 'BUILDING' and time.notna()")
    return targets.filter_unless_empty(one, "cohort == 'no such cohort'").select("region_id", "cohort")


@query("p4_binary_target", f"SELECT region_id, coalesce((label = 'F')::INT, 0) AS label FROM {ORD}")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return targets.build_target(fx.order_metadata(spark, d), {"type": "binary", "label_col": "label", "positive_class": "F"})


@query("p6_survival_target", f"SELECT region_id, time, event FROM {META} WHERE event = 1 OR time > 100")
def p6(spark: SparkSession, d: str) -> DataFrame:
    m = fx.event_metadata(spark, d)
    task = {"type": "survival", "time_col": "time", "event_col": "event", "row_filter": "event == 1 or time > 100"}
    return targets.build_target(m, task, targets.task_rows(m, task).select("region_id"))


@query("p10_cell_counts", f"SELECT region_id, count(*) AS n_cells FROM {LINE} GROUP BY 1")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return targets.cell_counts(fx.line_cells(spark, d), keys=["region_id"])


@query("x2_patient_strata", f"SELECT patient_id, stratum FROM {STRATA}")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return splits.patient_strata(fx.order_metadata(spark, d), "label")


_FOLDS = f"""(SELECT seed, patient_id, stratum, ((row_number() OVER (PARTITION BY seed ORDER BY stratum, md5(seed || ':' || patient_id), patient_id) - 1) % 5)::INT AS fold
FROM {STRATA}, (SELECT unnest([0, 1]) AS seed))"""


@query("x3_folds", f"SELECT seed, patient_id, ((row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || patient_id), patient_id) - 1) % 5)::INT AS fold FROM {STRATA}, (SELECT unnest([0, 1, 2]) AS seed)")
def x3(spark: SparkSession, d: str) -> DataFrame:
    patients = fx.order_metadata(spark, d).select("patient_id").distinct()
    return splits.fold_patients(patients, seeds=[0, 1, 2], k=5, stratified=False)


@query("x4_stratified_folds", f"SELECT seed, patient_id, fold FROM {_FOLDS}")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return splits.fold_patients(splits.patient_strata(fx.order_metadata(spark, d), "label"), seeds=[0, 1], k=5, stratified=True)


@query("x7_cohort_roles", f"SELECT region_id, CASE WHEN cohort IN ('1-URGENT', '2-HIGH') THEN 'train' ELSE 'test' END AS role FROM {ORD} WHERE cohort IN ('1-URGENT', '2-HIGH', '5-LOW')")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return splits.cohort_roles(fx.order_metadata(spark, d), column="cohort", train=["1-URGENT", "2-HIGH"], test=["5-LOW"])


@query("x9_assignments", f"""SELECT f.seed, k.fold, f.fold = k.fold AS is_val, count(*) AS n FROM {ORD} o JOIN {_FOLDS} f USING (patient_id), (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k GROUP BY ALL""")
def x9(spark: SparkSession, d: str) -> DataFrame:
    m = fx.order_metadata(spark, d)
    a = splits.assignments(m, x4(spark, d), k=5)
    return a.groupBy("seed", "fold", (F.col("role") == "val").alias("is_val")).agg(F.count("*").alias("n"))


def _line_table(spark: SparkSession, d: str) -> DataFrame:
    e = fx.line_expression(spark, d)
    f = fe.mean_expression(e, fe.marker_panel(e, keys=["region_id"]), keys=["region_id"])  # not rounded: a mean of cents is often half way between two
    return f.withColumn("role", F.when(F.col("region_id") % 5 == 0, "val").otherwise("train")).withColumn("value", F.when(F.col("region_id") % 7 != 3, F.col("value")))


@query("t3_prepared", f"""WITH f AS (SELECT region_id, marker AS feature, CASE WHEN region_id % 7 <> 3 THEN a END AS value FROM (SELECT region_id, marker, avg(value) AS a FROM {LINE_LONG} GROUP BY 1, 2)),
m AS (SELECT feature, quantile_cont(value, 0.5) AS med FROM f WHERE region_id % 5 <> 0 GROUP BY 1),
s AS (SELECT feature, med, avg(coalesce(value, med)) AS mu, stddev_pop(coalesce(value, med)) AS sd FROM f JOIN m USING (feature) WHERE region_id % 5 <> 0 GROUP BY ALL HAVING stddev_samp(coalesce(value, med)) > 0)
SELECT region_id, feature, round((coalesce(value, med) - mu) / sd, 4) AS value FROM f JOIN s USING (feature)""")
def t3(spark: SparkSession, d: str) -> DataFrame:
    t = _line_table(spark, d)
    return prep.apply_prep(t, prep.fit_prep(t, keys=[]), keys=[]).select("region_id", "feature", F.round("value", 4).alias("value"))


@query("t5_balanced_weights", f"SELECT cohort, label, round((sum(count(*)) OVER (PARTITION BY cohort)) / (count(*) OVER (PARTITION BY cohort) * count(*))::DOUBLE, 6) AS weight, count(*) AS n FROM {ORD} GROUP BY cohort, label")
def t5(spark: SparkSession, d: str) -> DataFrame:
    w = prep.balanced_weights(fx.order_metadata(spark, d), keys=["cohort"])
    return w.groupBy("cohort", "label", F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))


@query("k1_concordance", f"""WITH p AS (SELECT region_id % 3 AS run, time, event, (region_id % 17)::DOUBLE AS risk FROM {META})
SELECT a.run, round(sum(CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 6) AS c_index
FROM p a JOIN p b ON a.run = b.run AND a.event = 1 AND (a.time < b.time OR (a.time = b.time AND b.event = 0)) GROUP BY 1""")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return r6(me.concordance(fx.risks(spark, d), keys=["run"]), "c_index")


@query("k2_k4_binary_metrics", f"""WITH p AS {SCORE},
auc AS (SELECT a.run, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)::DOUBLE AS auc_roc FROM p a JOIN p b ON a.run = b.run AND a.truth = 1 AND b.truth = 0 GROUP BY 1),
c AS (SELECT run, score, sum(truth) AS tp, count(*) AS n FROM p GROUP BY ALL),
w AS (SELECT run, tp, sum(tp) OVER (PARTITION BY run ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY run ORDER BY score DESC) AS cn, sum(tp) OVER (PARTITION BY run) AS pos FROM c),
ap AS (SELECT run, sum(tp / pos::DOUBLE * ctp / cn::DOUBLE) AS avg_precision FROM w GROUP BY 1),
ba AS (SELECT run, avg(r) AS balanced_acc FROM (SELECT run, truth, avg(((score > 0.5)::INT = truth)::INT) AS r FROM p GROUP BY ALL) GROUP BY 1)
SELECT run, round(auc_roc, 6) AS auc_roc, round(avg_precision, 6) AS avg_precision, round(balanced_acc, 6) AS balanced_acc FROM auc JOIN ap USING (run) JOIN ba USING (run)""")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return r6(me.binary_metrics(fx.scores(spark, d), keys=["run"]), "auc_roc", "avg_precision", "balanced_acc")


_ARGMAX = f"(SELECT run, region_id, truth, class AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY proba DESC, class) AS rn FROM {PROBA}) WHERE rn = 1)"


@query("k5_k6_multiclass", f"SELECT run, round(avg(r), 6) AS balanced_acc FROM (SELECT run, truth, avg((truth = predicted)::INT) AS r FROM {_ARGMAX} GROUP BY ALL) GROUP BY 1")
def k6(spark: SparkSession, d: str) -> DataFrame:
    return r6(me.balanced_accuracy(me.argmax_class(fx.probabilities(spark, d), keys=["run"]), keys=["run"]), "balanced_acc")


@query("k7_macro_auc", f"""WITH p AS {PROBA}, c AS (SELECT run, class, proba, count(*) FILTER (truth = class) AS p, count(*) FILTER (truth <> class) AS q FROM p GROUP BY ALL),
w AS (SELECT run, class, p, q, sum(q) OVER (PARTITION BY run, class ORDER BY proba) - q AS below FROM c),
a AS (SELECT run, class, sum(p * (below + q / 2.0)) / (sum(p) * sum(q))::DOUBLE AS auc FROM w GROUP BY ALL) SELECT run, round(avg(auc), 6) AS macro_auc FROM a GROUP BY 1""")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return r6(me.macro_auc(fx.probabilities(spark, d), keys=["run"]), "macro_auc")


@query("k9_summary", f"""WITH s AS (SELECT region_id % 9 AS run, marker AS metric, CASE WHEN region_id % 4 <> 0 THEN value END AS value FROM {EMB})
SELECT run, metric, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS sd, count(*) AS n FROM s GROUP BY ALL""")
def k9(spark: SparkSession, d: str) -> DataFrame:
    e = fx.embedding_expression(spark, d).select((F.col("region_id") % 9).alias("run"), F.col("marker").alias("metric"), F.when(F.col("region_id") % 4 != 0, F.col("value")).alias("value"))
    return r6(me.summarize(e, keys=["run"]), "mean", "sd")


_AREA = "(SELECT DISTINCT region_id, CASE WHEN region_id <> 9 THEN 0.24 END AS tissue, CASE WHEN region_id % 2 = 0 AND region_id <> 9 THEN 0.0625 END AS tumour FROM " + EVENT + ")"


@query("g1_areas", f"SELECT region_id, round(tissue, 6) AS tissue, round(tumour, 6) AS tumour FROM {_AREA}")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.areas_mm2(fx.event_cells(spark, d, 10), fx.event_polygons(spark, d), mpp=fx.MPP), "tissue", "tumour")


_IN = f"(SELECT *, CASE WHEN region_id = 9 THEN NULL ELSE x > 0 AND x < 1000 AND y > 0 AND y < 1000 AND NOT (x BETWEEN 400 AND 600 AND y BETWEEN 400 AND 600) END AS inside FROM {EVENT})"


@query("g2_inside_tissue", f"SELECT region_id, cell_type, count(*) FILTER (inside) AS n_inside, count(*) FILTER (inside IS NULL) AS n_unknown FROM {_IN} GROUP BY ALL")
def g2(spark: SparkSession, d: str) -> DataFrame:
    c = spatial.inside_polygon(fx.event_cells(spark, d, 10), fx.event_polygons(spark, d), kind="tissue")
    return c.groupBy("region_id", "cell_type").agg(F.count_if("inside").alias("n_inside"), F.count_if(F.col("inside").isNull()).alias("n_unknown"))


@query("f6_tissue_density", f"""WITH c AS (SELECT region_id, cell_type, count(*) FILTER (inside) AS n FROM {_IN} GROUP BY ALL), v AS (SELECT DISTINCT cell_type FROM events_types)
SELECT a.region_id, 'tissue_density_' || v.cell_type AS feature, round(CASE WHEN a.tissue > 0 THEN coalesce(c.n, 0) / 1000.0 / a.tissue END, 6) AS value
FROM {_AREA} a CROSS JOIN v LEFT JOIN c ON c.region_id = a.region_id AND c.cell_type = v.cell_type""".replace("FROM events_types", f"FROM {EVENT}"))
def f6(spark: SparkSession, d: str) -> DataFrame:
    cells, polygons = fx.event_cells(spark, d, 10), fx.event_polygons(spark, d)
    areas = spatial.areas_mm2(cells, polygons, mpp=fx.MPP).select("region_id", F.col("tissue").alias("area_mm2"))
    flags = spatial.inside_polygon(cells, polygons, kind="tissue")
    return r6(fe.densities(flags, areas, fe.vocabulary(cells, keys=[]), keys=["region_id"], kind="tissue"), "value")


@query("f7_tumour_ratio", f"SELECT region_id, 'tumour_ratio' AS feature, round(CASE WHEN tissue > 0 THEN coalesce(tumour, 0) / tissue END, 6) AS value FROM {_AREA}")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return r6(fe.tumour_ratio(spatial.areas_mm2(fx.event_cells(spark, d, 10), fx.event_polygons(spark, d), mpp=fx.MPP), keys=["region_id"]), "value")


@query("f8_tumour_density", f"""WITH c AS (SELECT region_id, cell_type, count(*) FILTER (x > 0 AND x < 500 AND y > 0 AND y < 500) AS n FROM {EVENT} GROUP BY ALL)
SELECT a.region_id, 'tumour_density_' || v.cell_type AS feature, round(CASE WHEN a.tumour > 0 THEN coalesce(c.n, 0) / 1000.0 / a.tumour END, 6) AS value
FROM {_AREA} a CROSS JOIN (SELECT DISTINCT cell_type FROM {EVENT}) v LEFT JOIN c ON c.region_id = a.region_id AND c.cell_type = v.cell_type""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    cells, polygons = fx.event_cells(spark, d, 10), fx.event_polygons(spark, d)
    areas = spatial.areas_mm2(cells, polygons, mpp=fx.MPP).select("region_id", F.col("tumour").alias("area_mm2"))
    flags = spatial.inside_polygon(cells, polygons, kind="tumour")
    return r6(fe.densities(flags, areas, fe.vocabulary(cells, keys=[]), keys=["region_id"], kind="tumour"), "value")


_FOCAL = f"(SELECT region_id, cell_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY md5('0:' || cell_id), cell_id) AS rn FROM {EVENT}) WHERE rn <= 16)"


@query("i1_focal_cells", f"SELECT region_id, cell_id FROM {_FOCAL}")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return mil.focal_cells(fx.event_cells(spark, d, 10))


@query("g3_neighbourhoods", f"SELECT f.region_id, f.cell_id AS focal_cell_id, count(*) AS n FROM {_FOCAL} f JOIN {EVENT} c ON c.region_id = f.region_id AND (c.x - f.x) ** 2 + (c.y - f.y) ** 2 <= 10000 GROUP BY ALL")
def g3(spark: SparkSession, d: str) -> DataFrame:
    n = spatial.neighbourhood(fx.event_cells(spark, d, 10), i1(spark, d), radius_um=50.0, mpp=fx.MPP)
    return n.groupBy("region_id", "focal_cell_id").agg(F.count("*").alias("n"))


@query("i3_instance_composition", f"""WITH m AS (SELECT f.region_id || '#inst' || f.cell_id AS instance_id, c.cell_type FROM {_FOCAL} f JOIN {EVENT} c ON c.region_id = f.region_id AND (c.x - f.x) ** 2 + (c.y - f.y) ** 2 <= 10000),
s AS (SELECT instance_id, count(*) AS total FROM m GROUP BY 1 HAVING count(*) >= 10), n AS (SELECT instance_id, cell_type, count(*) AS n FROM m GROUP BY ALL)
SELECT s.instance_id, v.cell_type AS feature, round(coalesce(n.n, 0) / total::DOUBLE, 6) AS value FROM s CROSS JOIN (SELECT DISTINCT cell_type FROM {EVENT}) v LEFT JOIN n ON n.instance_id = s.instance_id AND n.cell_type = v.cell_type""")
def i3(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.event_cells(spark, d, 10)
    inst = mil.instances(cells, i1(spark, d))
    return r6(fe.composition(inst, fe.vocabulary(cells, keys=[]), keys=["instance_id"]), "value")


@query("i5_pooling", f"""WITH p AS (SELECT run AS region_id, class, max(proba) AS m FROM {PROBA} GROUP BY ALL) SELECT region_id, class, round(m / sum(m) OVER (PARTITION BY region_id), 6) AS proba FROM p
UNION ALL SELECT 99, c, round(1 / 3.0::DOUBLE, 6) FROM (SELECT unnest(['F', 'O', 'P']) AS c)""")
def i5(spark: SparkSession, d: str) -> DataFrame:
    p = fx.probabilities(spark, d).select(F.col("run").alias("region_id"), F.col("region_id").alias("instance_id"), "class", "proba")
    regions = p.select("region_id").distinct().union(spark.range(99, 100).toDF("region_id"))
    return r6(mil.pool(p, regions, ["F", "O", "P"], agg="max"), "proba")


@query("d2_nearest", f"""WITH c AS {EVENT}, n AS (SELECT a.region_id, a.cell_id, a.cell_type AS a_type, b.cell_type AS b_type, min(least(40.0, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))) AS dist
FROM c a JOIN c b ON a.region_id = b.region_id GROUP BY ALL), g AS (SELECT region_id, a_type, b_type, round(min(dist), 6) AS min_dist, round(avg(dist), 6) AS mean_dist FROM n GROUP BY ALL)
SELECT r.region_id, a.cell_type AS a_type, b.cell_type AS b_type, min_dist, mean_dist FROM (SELECT DISTINCT region_id FROM c) r CROSS JOIN (SELECT DISTINCT cell_type FROM c) a CROSS JOIN (SELECT DISTINCT cell_type FROM c) b
LEFT JOIN g ON g.region_id = r.region_id AND g.a_type = a.cell_type AND g.b_type = b.cell_type""")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.nearest_distances(fx.event_cells(spark, d, 10), max_dist=40.0, sample_n=None), "min_dist", "mean_dist")


@query("d4_proximity", f"""WITH c AS {EVENT}, r AS (SELECT unnest([20.0, 50.0, 100.0])::DOUBLE AS radius), o AS (SELECT region_id, cell_type, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT a.region_id, a.cell_type AS a_type, b.cell_type AS b_type, radius, count(*) AS k FROM c a JOIN c b ON a.region_id = b.region_id AND a.cell_id <> b.cell_id JOIN r ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= radius * radius GROUP BY ALL)
SELECT o.region_id, o.cell_type AS a_type, t.cell_type AS b_type, r.radius, round(CASE WHEN o.n >= 3 THEN coalesce(k, 0) / o.n::DOUBLE END, 6) AS value
FROM o CROSS JOIN (SELECT DISTINCT cell_type FROM c) t CROSS JOIN r LEFT JOIN p ON p.region_id = o.region_id AND p.a_type = o.cell_type AND p.b_type = t.cell_type AND p.radius = r.radius""")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.proximity(fx.event_cells(spark, d, 10)), "value")


_K = f"""c AS {EVENT}, a AS (SELECT region_id, greatest((max(x) - min(x)) * (max(y) - min(y)), 1.0) AS area, count(*) AS n FROM c GROUP BY 1), r AS (SELECT unnest([20.0, 50.0])::DOUBLE AS radius),
p AS (SELECT a.region_id, radius, count(*) AS k FROM c a JOIN c b ON a.region_id = b.region_id AND a.cell_id <> b.cell_id JOIN r ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= radius * radius GROUP BY ALL),
k AS (SELECT a.region_id, radius, CASE WHEN n >= 2 THEN area * coalesce(p.k, 0) / (n::DOUBLE * (n - 1)) END AS k FROM a CROSS JOIN r LEFT JOIN p USING (region_id, radius))"""


@query("d6_d8_ripley", f"WITH {_K} SELECT region_id, 'all' AS cell_type, radius, round(k, 4) AS k, round(sqrt(k / pi()) - radius, 4) AS l FROM k")
def d6(spark: SparkSession, d: str) -> DataFrame:
    c = fx.event_cells(spark, d, 10)
    return spatial.ripley(c, spatial.box_area(c), radii=(20.0, 50.0)).withColumns({"k": F.round("k", 4), "l": F.round("l", 4)})


@query("d7_d9_pair_correlation", f"WITH {_K} SELECT region_id, 'all' AS cell_type, radius / 2 + lag(radius, 1, 0.0) OVER w / 2 AS mid, round((k - lag(k, 1, 0.0) OVER w) / (2 * pi() * (radius + lag(radius, 1, 0.0) OVER w) / 2 * (radius - lag(radius, 1, 0.0) OVER w)), 6) AS g FROM k WINDOW w AS (PARTITION BY region_id ORDER BY radius)")
def d7(spark: SparkSession, d: str) -> DataFrame:
    c = fx.event_cells(spark, d, 10)
    return r6(spatial.pair_correlation(spatial.ripley(c, spatial.box_area(c), radii=(20.0, 50.0))), "g")


# n2, d2, d6 and d7 above are cut (two markers, small radii) as their SQL is; these are the whole jobs, at the reference's radii.
@query("n2_adaptive_arcsinh_all_markers", f"""WITH q AS (SELECT region_id, marker, 5 * quantile_cont(value, 0.2) + 1e-5 AS c FROM {LINE_LONG} GROUP BY ALL)
SELECT region_id, marker, round(avg(asinh(value / c)), 4) AS mean_value FROM {LINE_LONG} JOIN q USING (region_id, marker) GROUP BY ALL""")
def n2_all(spark: SparkSession, d: str) -> DataFrame:
    out = normalize.normalize(fx.line_expression(spark, d), keys=["region_id"], cofactor="adaptive")
    return out.groupBy("region_id", "marker").agg(F.round(F.avg("value"), 4).alias("mean_value"))


_NEAREST = """WITH c AS {event}, n AS (SELECT a.region_id, a.cell_id, a.cell_type AS a_type, b.cell_type AS b_type, min(least({cap}, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))) AS dist
FROM c a JOIN c b ON a.region_id = b.region_id GROUP BY ALL), g AS (SELECT region_id, min(dist) AS lo, avg(dist) AS mean, a_type, b_type FROM n GROUP BY ALL), t AS (SELECT DISTINCT cell_type FROM c)
SELECT r.region_id, a.cell_type AS a_type, b.cell_type AS b_type, round(lo, 6) AS min_dist, round(mean, 6) AS mean_dist FROM (SELECT DISTINCT region_id FROM c) r CROSS JOIN t a CROSS JOIN t b
LEFT JOIN g ON g.region_id = r.region_id AND g.a_type = a.cell_type AND g.b_type = b.cell_type"""


@query("d2_nearest_full_radius", _NEAREST.format(event=EVENT, cap=500.0))
def d2_full(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.nearest_distances(fx.event_cells(spark, d, 10), sample_n=None), "min_dist", "mean_dist")


@query("d4_proximity_full_radii", f"""WITH c AS {EVENT}, r AS (SELECT unnest([20.0, 50.0, 100.0])::DOUBLE AS radius), o AS (SELECT region_id, cell_type, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT a.region_id, a.cell_type AS a_type, b.cell_type AS b_type, radius, count(*) AS k FROM c a JOIN c b ON a.region_id = b.region_id AND a.cell_id <> b.cell_id JOIN r ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= radius * radius GROUP BY ALL)
SELECT o.region_id, o.cell_type AS a_type, t.cell_type AS b_type, r.radius, round(CASE WHEN o.n >= 3 THEN coalesce(k, 0) / o.n::DOUBLE END, 6) AS value
FROM o CROSS JOIN (SELECT DISTINCT cell_type FROM c) t CROSS JOIN r LEFT JOIN p ON p.region_id = o.region_id AND p.a_type = o.cell_type AND p.b_type = t.cell_type AND p.radius = r.radius""")
def d4_full(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.proximity(fx.event_cells(spark, d, 10)), "value")


# All cells, and each type's (1,000 of it at most, null under 4) with the area of the whole region.
_K_FULL = f"""c AS {EVENT}, area AS (SELECT region_id, greatest((max(x) - min(x)) * (max(y) - min(y)), 1.0) AS area FROM c GROUP BY 1),
s AS (SELECT region_id, cell_id, cell_type, x, y FROM (SELECT *, row_number() OVER (PARTITION BY region_id, cell_type ORDER BY md5('42:' || cell_id), cell_id) AS rn FROM c) WHERE rn <= 1000),
u AS (SELECT region_id, cell_id, 'all' AS cell_type, x, y, 2 AS least FROM c UNION ALL SELECT *, 4 FROM s), o AS (SELECT region_id, cell_type, least, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT unnest([20.0, 50.0, 100.0, 200.0])::DOUBLE AS radius),
p AS (SELECT a.region_id, a.cell_type, radius, count(*) AS k FROM u a JOIN u b ON a.region_id = b.region_id AND a.cell_type = b.cell_type AND a.cell_id <> b.cell_id JOIN r ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= radius * radius GROUP BY ALL),
k AS (SELECT o.region_id, o.cell_type, radius, CASE WHEN n >= least THEN area * coalesce(p.k, 0) / (n::DOUBLE * (n - 1)) END AS k FROM o JOIN area USING (region_id) CROSS JOIN r LEFT JOIN p USING (region_id, cell_type, radius))"""


def _ripley_full(spark: SparkSession, d: str) -> DataFrame:
    c = fx.event_cells(spark, d, 10)
    return spatial.ripley_and_by_type(c, spatial.box_area(c))


@query("d6_d8_ripley_full_radii", f"WITH {_K_FULL} SELECT region_id, cell_type, radius, round(k, 4) AS k, round(sqrt(k / pi()) - radius, 4) AS l FROM k")
def d6_full(spark: SparkSession, d: str) -> DataFrame:
    return _ripley_full(spark, d).withColumns({"k": F.round("k", 4), "l": F.round("l", 4)})


@query("d7_d9_pair_correlation_full_radii", f"WITH {_K_FULL} SELECT region_id, cell_type, radius / 2 + lag(radius, 1, 0.0) OVER w / 2 AS mid, round((k - lag(k, 1, 0.0) OVER w) / (2 * pi() * (radius + lag(radius, 1, 0.0) OVER w) / 2 * (radius - lag(radius, 1, 0.0) OVER w)), 6) AS g FROM k WINDOW w AS (PARTITION BY region_id, cell_type ORDER BY radius)")
def d7_full(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.pair_correlation(_ripley_full(spark, d)), "g")


@query("d5_hull_area")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return spatial.hull_area(fx.event_cells(spark, d, 10))


# The part of a disk below a corner in closed form, summed up with signs over the corners of the tumour square.
@query("g4_disk_overlap", f"""WITH q AS (SELECT f.region_id, f.cell_id, s.sign, greatest(-200.0, least(200.0, s.x - f.x)) AS a, greatest(-200.0, least(200.0, s.y - f.y)) AS b
FROM {_FOCAL} f, (SELECT * FROM (VALUES (0.0, 0.0, 1), (0.0, 500.0, -1), (500.0, 0.0, -1), (500.0, 500.0, 1)) v(x, y, sign)) s WHERE f.region_id % 2 = 0 AND f.region_id <> 9),
e AS (SELECT *, sqrt(greatest(0, 40000 - b * b)) AS c FROM q),
w AS (SELECT *, greatest(-c, least(c, a)) AS lo, least(a, -c) AS o1, greatest(a, c) AS o2 FROM e),
p AS (SELECT region_id, cell_id, sign, b, lo, c, list_transform([lo, -c, o1, -200.0, o2, c], lambda v: (v * sqrt(greatest(0, 40000 - v * v)) + 40000 * asin(greatest(-1, least(1, v / 200)))) / 2) AS s FROM w)
SELECT region_id, cell_id, round(abs(sum(sign * (s[1] - s[2] + b * (lo + c) + CASE WHEN b >= 0 THEN 2 * (s[3] - s[4]) + 2 * (s[5] - s[6]) ELSE 0 END))), 4) AS area FROM p GROUP BY ALL""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    cells, p = fx.event_cells(spark, d, 10), fx.event_polygons(spark, d).filter("kind = 'tumour'")
    focal = cells.join(i1(spark, d), ["region_id", "cell_id"], "left_semi").join(p, "region_id")
    return focal.select("region_id", "cell_id", F.round(spatial.disk_overlap(F.col("x"), F.col("y"), 200.0, spatial.edges(F.col("rings"))), 4).alias("area"))


def _task(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return pipelines.composition_features(fx.event_cells(spark, d)), fx.event_metadata(spark, d)


def _seeded(out: DataFrame) -> DataFrame:
    return out.withColumn("value", F.round("value", 6))


@query("l1_cross_validation")
def l1(spark: SparkSession, d: str) -> DataFrame:
    f, m = _task(spark, d)
    return _seeded(pipelines.cross_validate(f, m, m.select("region_id", "label"), kind="binary", seeds=[0, 1, 2], stratify="label"))


@query("l1_survival_cross_validation")
def l1s(spark: SparkSession, d: str) -> DataFrame:
    f, m = _task(spark, d)
    return _seeded(pipelines.cross_validate(f, m, m.select("region_id", "time", "event"), kind="survival", seeds=[0, 1, 2], stratify="event"))


@query("l1_multiclass_cross_validation")
def l1m(spark: SparkSession, d: str) -> DataFrame:
    f, m = _task(spark, d)
    return _seeded(pipelines.cross_validate(f, m, m.select("region_id", F.col("multi").alias("label")), kind="multiclass", seeds=[0, 1, 2], stratify="multi"))


@query("l2_cohort_test")
def l2(spark: SparkSession, d: str) -> DataFrame:
    f, m = _task(spark, d)
    return _seeded(pipelines.cohort_test(f, m, m.select("region_id", "label"), kind="binary", column="cohort", train=["BUILDING", "MACHINERY", "HOUSEHOLD"], test=["FURNITURE", "AUTOMOBILE"], seeds=[0, 1, 2]))


def _named(df: DataFrame, task: str, scheme: str) -> DataFrame:
    return df.select(F.lit(task).alias("task"), F.lit(scheme).alias("scheme"), "metric", "value")


#: Cohorts of the generalisation tests.
COHORTS = {"column": "cohort", "train": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "test": ["FURNITURE", "AUTOMOBILE"]}


def _baseline(f: DataFrame, m: DataFrame, *, fill: float | None, shared: DataFrame | None = None) -> DataFrame:
    """All tasks in all schemes, three seeds: the summary with the printed score. Features are written once; ``shared`` is the vocabulary of the cohort tests."""
    f, m = pipelines.prepared_features(f, None, None), materialize(m, "metadata")
    out, kinds = None, {"label": ("binary", "label"), "survival": ("survival", "event"), "multi": ("multiclass", "multi")}
    for task, (kind, stratify) in kinds.items():
        target = m.select("region_id", "time", "event") if kind == "survival" else m.select("region_id", F.col(task).alias("label"))
        cv = pipelines.cross_validate(f, m, target, kind=kind, seeds=[0, 1, 2], stratify=stratify, fill=fill)
        test = pipelines.cohort_test(f, m, target, kind=kind, **COHORTS, seeds=[0, 1, 2], fill=fill, vocab=shared)
        both = _named(cv, task, "cv").union(_named(test, task, "cohorts"))
        out = both if out is None else out.union(both)
    return r6(pipelines.baseline(out), "mean", "sd")


@query("l4_composition_baseline")
def l4(spark: SparkSession, d: str) -> DataFrame:
    return _baseline(*_task(spark, d), fill=0.0)


@query("l5_density_baseline")
def l5(spark: SparkSession, d: str) -> DataFrame:
    """Regions of their own with tissue and tumour squares each."""
    cells, m = fx.event_cells(spark, d), fx.event_metadata(spark, d)
    f = pipelines.density_features(cells, fx.region_polygons(spark, cells), mpp=fx.MPP)
    return _baseline(f, m, fill=None)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Composition features, patient-level folds of one seed, logistic regressions of all folds at once, exact metrics, summary."""
    f, m = _task(spark, d)
    out = pipelines.cross_validate(f, m, m.select("region_id", "label"), kind="binary", seeds=[0], stratify="label")
    return pipelines.baseline(out.select(F.lit("label").alias("task"), F.lit("cv").alias("scheme"), "metric", "value"))


@query("l6_expression_baseline")
def l6(spark: SparkSession, d: str) -> DataFrame:
    """Normalised means of markers; the cohort tests share the panel of both sides."""
    cells, m = fx.event_cells(spark, d), fx.event_metadata(spark, d)
    e = cells.select("region_id", F.concat(F.lit("value_"), "cell_type").alias("marker"), "value")
    f = pipelines.expression_features(e, e.select("marker").distinct(), normalization={"method": "arcsinh", "cofactor": "adaptive"})
    side = lambda r: e.join(splits.cohort_roles(m, **COHORTS).filter(F.col("role") == r).select("region_id"), "region_id", "left_semi")
    panel = fe.shared_panel(side("train"), side("test"), keys=["region_id"])
    return _baseline(f, m, fill=None, shared=panel.select(F.col("marker").alias("feature")))


def _one_run(spark: SparkSession, d: str) -> DataFrame:
    """Prepared rows of one run, a fifth of the regions held out."""
    f, m = _task(spark, d)
    runs = m.select("region_id", F.when(F.col("region_id") % 5 == 0, "val").otherwise("train").alias("role"), F.lit(0).alias("run"))
    return materialize(pipelines.run_vectors(f, runs, keys=["run"], fill=0.0).join(m.select("region_id", "label"), "region_id"), "run-rows")


def _all_runs(spark: SparkSession, d: str, label: str = "label") -> DataFrame:
    """Prepared and weighted rows of 15 runs, three seeds of five folds."""
    f, m = _task(spark, d)
    m = m.withColumn("label", F.col(label))
    folds = splits.fold_patients(splits.patient_strata(m, "label"), seeds=[0, 1, 2], k=5, stratified=True)
    runs, keys = materialize(splits.assignments(m, folds, k=5), "runs"), ["seed", "fold"]
    return materialize(pipelines.run_vectors(f, runs, keys=keys, fill=0.0).join(m.select("region_id", "label"), "region_id"), "run-rows")


def _linear(spark: SparkSession, d: str, label: str, **options) -> DataFrame:
    rows, keys = _all_runs(spark, d, label), ["seed", "fold"]
    train = prep.balanced_weights(rows.filter("role = 'train'"), keys=keys)
    classes = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]  # the classes
    proba = models.predict_softmax(rows.filter("role = 'val'"), models.fit_softmax(train, classes, keys=keys, **options), classes, keys=keys)
    return r6(proba, "proba")


@query("m1_elastic_net")
def m1_net(spark: SparkSession, d: str) -> DataFrame:
    """Elastic nets of all 15 runs at once."""
    return _linear(spark, d, "label", l1_ratio=0.5, c=0.3)


@query("m1_multinomial")
def m1_multi(spark: SparkSession, d: str) -> DataFrame:
    """Softmax regressions of all 15 runs at once."""
    return _linear(spark, d, "multi")


def _ensemble(rows: DataFrame, keys: list[str], fit) -> DataFrame:
    train = materialize(prep.balanced_weights(rows.filter("role = 'train'"), keys=keys), "train-rows")
    classes = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]  # the classes
    return r6(fit(train, rows.filter("role = 'val'"), classes, keys=keys), "proba")


@query("m3_forest")
def m3(spark: SparkSession, d: str) -> DataFrame:
    """Forests of 300 trees of all 15 runs at once."""
    return _ensemble(_all_runs(spark, d), ["seed", "fold"], models.forest_predictions)


@query("m3_forest_full")
def m3_full(spark: SparkSession, d: str) -> DataFrame:
    """A forest of 300 trees of one run; nodes try the square root of the number of features, rounded up as in Spark ML."""
    return _ensemble(_one_run(spark, d), ["run"], partial(models.forest_predictions, max_features="sqrt_up")).drop("run")


@query("m4_boosting")
def m4(spark: SparkSession, d: str) -> DataFrame:
    """300 rounds of boosting of all 15 runs at once."""
    return _ensemble(_all_runs(spark, d), ["seed", "fold"], models.boosting_predictions)


def _bag_regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Twenty regions of so many cells that a disk of the default radius holds the default number, each a patient's; the label is that of most users."""
    cells, m = fx.event_cells(spark, d, 20), fx.event_metadata(spark, d)
    labels = m.groupBy((F.col("region_id") % 20).alias("region_id")).agg((F.avg("label") > 0.5).cast("int").alias("label"))
    return cells, labels.withColumn("patient_id", F.col("region_id").cast("string"))


@query("l7_mil_cross_validation")
def l7(spark: SparkSession, d: str) -> DataFrame:
    """Instances of regions take their region's label; a fold's instances are scored and pooled by region."""
    return mil.cross_validate(*_bag_regions(spark, d), seeds=[0, 1, 2])


@query("i8_variant_sweep")
def i8(spark: SparkSession, d: str) -> DataFrame:
    """Featuriser, model, radius, sampling and pooling, three seeds, from one join of neighbours."""
    cells, meta = _bag_regions(spark, d)

    def mean_value(inst: DataFrame) -> DataFrame:
        values = inst.join(cells.select("region_id", "cell_id", "value"), ["region_id", "cell_id"])
        return values.groupBy("instance_id").agg(F.avg("value").cast("double").alias("value")).select("instance_id", F.lit("value").alias("feature"), "value")

    boosted = {"model": "boosting", "options": {"rounds": 20}}
    variants = [
        {"name": "composition, logistic"}, {"name": "composition, boosting", **boosted}, {"name": "composition, boosting, 50 um", "radius_um": 50.0, "min_cells": 3, **boosted},
        {"name": "composition, forest", "model": "forest", "options": {"trees": 100}}, {"name": "mean value, logistic", "featurise": mean_value, "fill": None},
        {"name": "composition, logistic, max", "agg": "max"}, {"name": "composition, logistic, 1 %", "n_samples": 0.01},
    ]
    return mil.sweep(cells, meta, variants, seeds=[0, 1, 2])
