"""Queries on sources, spatial joins, applicability, profiles and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import rounded
from ..functions.scratch import scratch_path
from ..operators import aoa, polygons, profiles, scoring, spatial
from ..sources import catalog, tabular
from .fixtures import derived, table, with_inputs


def _round(df, names, digits=6):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def csv2_roundtrip(spark, d):
    df = derived(spark, d, "soil").select("row_id", "c_gkg", "sand_gkg", "p_mgkg")
    path = scratch_path(spark, "csv2")
    tabular.write_csv2(df, path)
    return tabular.read_csv2(spark, path, df.schema)


def csv_roundtrip(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    path = scratch_path(spark, "csv")
    df.write.csv(path, header=True)
    return tabular.read_csv(spark, path, df.schema)


def text_export(spark, d):
    df = derived(spark, d, "soil").select(F.col("row_id"), F.col("coord_id"), F.col("k_mmolkg").cast("int").alias("k_mmolkg"))
    path = scratch_path(spark, "text")
    tabular.write_text_table(df, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])
    return spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="\0", emptyValue="").na.fill("")


def layer_outputs(spark, d):
    path = scratch_path(spark, "layers")
    tabular.write_layers(derived(spark, d, "cells"), ["row", "col"], ["b1", "b2", "b4"], path)
    return spark.read.parquet(path).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total"))


def catalog_links(spark, d):
    return catalog.catalog_links(table(spark, d, "pages"), ["^/[A-Z]", "[a-m]$"], strict=True).select("page_id", "href", "path")


def detect_dataset_ids(spark, d):
    return catalog.detect_dataset_ids(derived(spark, d, "id_index").select("dataset_id"))


def invalid_ids(spark, d):
    return catalog.invalid_ids(derived(spark, d, "id_index"), "dataset_id")


_TABLES = ["dataset", "observation", "layer", "metadata"]


def _manifest(spark, d):
    ids = detect_dataset_ids(spark, d)
    names = F.array(*[F.lit(t) for t in _TABLES])
    part = table(spark, d, "part")
    key = F.concat(F.lit("ctb"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    name = names[(F.col("p_partkey") % 4).cast("int")]
    path = F.concat_ws("/", key, F.concat_ws("-", key, F.concat(name, F.lit(".txt"))))
    files = part.groupBy(path.alias("file_path")).agg(F.sum(F.col("p_size") % 5).alias("n_bytes"))
    return catalog.manifest(ids, _TABLES, files)


def manifest_status(spark, d):
    return _manifest(spark, d).select("dataset_id", "table_name", "file_path", "checked_after", "status")


def manifest_summary(spark, d):
    return catalog.manifest_summary(_manifest(spark, d))


def uri_mapping(spark, d):
    root = F.when(F.col("p_size") % 7 == 0, "/other/place").otherwise("/data/soil")
    files = table(spark, d, "part").select(F.concat_ws("/", root, "p_brand", F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".csv").otherwise(".tif"))).alias("file_path"))
    return catalog.object_paths(files, "/data/soil", "gs://bucket/soil", r"\.tif$")


def _requested(spark, d):
    runs = derived(spark, d, "predobs").select("run").distinct()
    return runs.withColumn("model", F.explode(F.array(F.lit("rf"), F.lit("gbm"), F.lit("qrf"))))


def pending_work(spark, d):
    done = _requested(spark, d).where("run % 2 = 0 and model <> 'qrf'")
    return catalog.pending(_requested(spark, d), done, ["run", "model"])


def resume_pending(spark, d):
    done = _requested(spark, d).where("run <= 2 and model = 'rf'").groupBy("model").agg(F.max("run").alias("last"))
    todo = _requested(spark, d).join(F.broadcast(done), "model", "left")
    return todo.where(F.col("run") > F.coalesce("last", F.lit(-1))).select("model", "run", (F.coalesce("last", F.lit(-1)) + 1).alias("restart_at"))


def resume_conflicts(spark, d):
    ledger = _requested(spark, d).select("run", "model", (F.col("run") + 5).alias("k"), F.lit("r2").alias("metric"))
    now = _requested(spark, d).select("run", "model", F.lit(7).alias("k"), F.when(F.col("run") == 3, "mqi").otherwise("r2").alias("metric"))
    return catalog.conflicts(ledger, now, ["run", "model"], ["k", "metric"])


def points_to_class(spark, d):
    return spatial.points_to_class(derived(spark, d, "points"), derived(spark, d, "polygons"))


def points_to_class_no_na(spark, d):
    return spatial.points_to_class(derived(spark, d, "points"), derived(spark, d, "polygons"), na=False)


def _parcels(spark, d):
    """Parcels side by side, which share their borders: a rectangle with a hole, and a triangle as a second part."""
    x, h = F.col("xmin"), F.col("ymax")
    ring = lambda *at: F.array(*[F.struct((x + a).alias("x"), F.lit(b).cast("double").alias("y") if isinstance(b, (int, float)) else b.alias("y")) for a, b in at])
    rings = F.array(ring((0, 0), (5, 0), (5, h), (0, h)), ring((2.5, 8), (4.5, 10), (2.5, 12), (0.5, 10)), ring((0, 200), (5, 200), (2.5, 300)))
    return derived(spark, d, "polygons").select("poly_id", "class_name", rings.alias("rings"))


def _sites(spark, d):
    """Points whose coordinates are whole or half numbers, so that many lie on a border."""
    return derived(spark, d, "points").select("point_id", (F.col("x") - 0.5).alias("x"), (F.floor(F.col("y") * 2) / 2).alias("y"))


def rings_to_class(spark, d):
    return polygons.points_to_class(_sites(spark, d), _parcels(spark, d))


def points_in_rings(spark, d):
    return polygons.points_in_polygons(_sites(spark, d), _parcels(spark, d), keep_all=False).select("point_id", "poly_id")


def points_in_polygon(spark, d):
    p = derived(spark, d, "polygons")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    # a triangle: lower left, lower right, upper left
    rings = p.select("poly_id", F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmin", "ymax")).alias("ring"))
    return spatial.points_in_rings(derived(spark, d, "points"), rings).select("point_id", "poly_id")


def vector_modal(spark, d):
    return spatial.vector_modal(derived(spark, d, "layers"), ["m3", "m1", "m2"]).select("x", "y", "modal")


def vector_variety(spark, d):
    return spatial.vector_variety(derived(spark, d, "layers"), ["m1", "m2", "m3"]).select("x", "y", "variety")


def _aoa(spark, d):
    df = derived(spark, d, "train_new")
    train, new = df.where("part = 'train'"), df.where("part = 'new'")
    mean, sd = aoa.training_moments(train, "embedding")
    z = lambda x: aoa.scaled(x, "embedding", mean, sd).select("vec_id", "fold", "z")
    return z(train), z(new)


def aoa_di(spark, d):
    train, new = _aoa(spark, d)
    return _round(aoa.dissimilarity(new, train, aoa.mean_distance(train)), ["di"], 5).select("vec_id", "di")


def train_di_threshold(spark, d):
    train, _ = _aoa(spark, d)
    return _round(aoa.train_threshold(train, aoa.mean_distance(train))[1], ["threshold"], 5)


def aoa_flag(spark, d):
    train, new = _aoa(spark, d)
    dbar = aoa.mean_distance(train)
    limit = aoa.train_threshold(train, dbar)[1]
    out = aoa.dissimilarity(new, train, dbar).join(F.broadcast(limit))
    return out.select("vec_id", F.when(F.col("di").isNotNull(), (F.col("di") <= F.col("threshold")).cast("int")).alias("aoa"))


def aoa_lpd(spark, d):
    train, new = _aoa(spark, d)
    dbar = aoa.mean_distance(train)
    limit = aoa.train_threshold(train, dbar)[1]
    return aoa.local_density(new, train, dbar, limit, 20).select("vec_id", "lpd", "lpd_share")


def aoa_classes(spark, d):
    """Dissimilarity with a class among the predictors; new rows hold a level that training rows lack, and weights count."""
    kind = F.when(F.col("s_nationkey") % 3 == 0, "a").when(F.col("s_nationkey") % 3 == 1, "b").otherwise("c")
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("vec_id"), F.col("s_nationkey").alias("fold"), F.col("s_acctbal").alias("target"), kind.alias("class"))
    train = (F.col("vec_id") % 4 != 0) & (F.col("class") != "c")
    train, new = aoa.coded(df.where(train), df.where(~train), ["target"], ["class"])
    mean, sd = aoa.training_moments(train, "vector")
    train, new = (aoa.scaled(x, "vector", mean, sd, [2.0, 1.0, 1.0]) for x in (train, new))
    return _round(aoa.dissimilarity(new, train, aoa.mean_distance(train)), ["di"], 5).select("vec_id", "di")


def vector_bound(spark, d):
    """Layers bound by feature id, and the greatest value of each row by a function of one's own."""
    df = derived(spark, d, "layers")
    layers = {m: df.where(f"{m} is not null").select("x", m).toDF("x", "v") for m in ("m1", "m2", "m3")}
    out = spatial.bind_layers(layers, "x", "v")
    return spatial.reduce_rows(out, ["m1", "m2", "m3"], "greatest", F.array_max)


def tree_value_functions(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    what = [0.5, ("least", F.min), ("spread", lambda v: F.max(v) - F.min(v))]
    return _round(scoring.tree_value_summaries(rows, "l_orderkey", "l_extendedprice", what), ["q50", "least", "spread"], 6)


def aoa_neighbours(spark, d):
    train, new = _aoa(spark, d)
    out = aoa.nearest(new, train, 5)
    return out.select("vec_id", F.posexplode("near").alias("place", "n")).select("vec_id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("neighbour"))


def aoa_mahalanobis(spark, d):
    train, new = _aoa(spark, d)
    mean, w = aoa.whitening(train, "z")
    z = lambda x: aoa.projected(x, "z", mean, w).select("vec_id", "fold", "z")
    return aoa.dissimilarity(z(new), z(train), aoa.mean_distance(z(train))).select("vec_id", "di")


_BREAKS = [0.0, 5.0, 15.0, 30.0, 60.0, 100.0]


def depth_weighted_mean(spark, d):
    return _round(profiles.depth_weighted_mean(derived(spark, d, "profiles"), _BREAKS), ["value"], 5)


def depth_spline(spark, d):
    return profiles.depth_spline(derived(spark, d, "profiles"), _BREAKS)


def _score(c):
    return c["b1"] * c["b2"] + F.sqrt(c["b4"])


def _pd_rows(spark, d):
    return derived(spark, d, "cells").na.drop(subset=["b4"]).select("b1", "b2", "b4")


def partial_dependence(spark, d):
    out = scoring.partial_dependence(_pd_rows(spark, d), "b1", _score, ["b1", "b2", "b4"], 0.05, 0.95)
    return _round(out, ["mean", "lci", "uci"], 5)


def partial_dependence_delta(spark, d):
    out = scoring.partial_dependence(_pd_rows(spark, d), "b1", _score, ["b1", "b2", "b4"], 0.05, 0.95, delta=True)
    return _round(out, ["mean", "lci", "uci"], 5)


def partial_dependence_model(spark, d):
    """The same curve from a model that is a plain Python function, scored in batches."""
    names = ["b1", "b2", "b4"]
    scorer = scoring.python_scorer(spark, lambda rows: rows["b1"] * rows["b2"] + rows["b4"] ** 0.5, names)
    out = scoring.partial_dependence(_pd_rows(spark, d), "b1", scorer, names, 0.05, 0.95)
    return _round(out, ["mean", "lci", "uci"], 5)


_W = {"b1": 2.0, "b2": -1.5, "b3": 3.0}


def _cell_rows(spark, d):
    return derived(spark, d, "cells").select((F.col("row").cast("long") * 100_000 + F.col("col")).alias("cell_id"), "b1", "b2", "b3")


def shapley_linear(spark, d):
    rows = _cell_rows(spark, d)
    return _round(scoring.shapley_linear(rows, rows, _W, "cell_id"), ["phi"])


def shapley_mc(spark, d):
    rows = _cell_rows(spark, d)
    return scoring.shapley_monte_carlo(rows, rows, lambda c: c["b1"] * c["b2"] + c["b3"], ["b1", "b2", "b3"], "cell_id", 8, 5)


def shapley_adjust(spark, d):
    rows = _cell_rows(spark, d)
    phi = scoring.shapley_linear(rows, rows, _W, "cell_id").withColumn("var", F.col("phi") * F.col("phi") + 0.01)
    scores = rows.select("cell_id", (2.0 * F.col("b1") - 1.5 * F.col("b2") + 3.0 * F.col("b3")).alias("score"))
    return _round(scoring.shapley_adjust(phi, scores, "cell_id", 1.0), ["phi", "phi_adjusted"], 5)


def tree_value_quantiles(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = scoring.tree_value_summary(rows, "l_orderkey", "l_extendedprice", [0.05, 0.5, 0.95])
    # prices have two decimals and quantiles fall between two of them in twentieths, so six digits tell them whole
    return _round(out, ["q5", "q50", "q95", "mean", "sd"], 6)


_REQ = "WITH rq AS (SELECT DISTINCT run, model FROM predobs, (SELECT unnest(['rf', 'gbm', 'qrf']) AS model))"
_IDS = "ids AS (SELECT DISTINCT lower(trim(dataset_id)) AS dataset_id FROM id_index WHERE regexp_matches(lower(trim(dataset_id)), '^[a-z]{3}[0-9]{4}$'))"
_FILES = """files AS (SELECT k || '/' || k || '-' || t || '.txt' AS file_path, sum(b) AS n_bytes FROM
 (SELECT 'ctb' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS k, ['dataset', 'observation', 'layer', 'metadata'][p_partkey % 4 + 1] AS t, p_size % 5 AS b FROM part) GROUP BY 1)"""
_MAN = f"""WITH {_IDS}, {_FILES}, man AS (SELECT dataset_id, table_name, dataset_id || '/' || dataset_id || '-' || table_name || '.txt' AS file_path FROM ids,
 (SELECT unnest(['dataset', 'observation', 'layer', 'metadata']) AS table_name)), ms AS (SELECT man.*, n_bytes IS NOT NULL AS checked_after,
 CASE WHEN n_bytes IS NULL THEN 'missing' WHEN n_bytes = 0 THEN 'empty' ELSE 'already_exists' END AS status FROM man LEFT JOIN files USING (file_path))"""
_AOA = """WITH e AS (SELECT vec_id, fold, part, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM train_new),
 m AS (SELECT i, avg(v) AS mu, stddev_samp(v) AS sd FROM e WHERE part = 'train' GROUP BY i),
 z AS (SELECT vec_id, any_value(fold) AS fold, any_value(part) AS part, list((v - mu) / sd ORDER BY i) AS z FROM e JOIN m USING (i) GROUP BY vec_id),
 tt AS (SELECT a.vec_id, a.fold, b.fold AS f2, sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) ** 2))) AS d FROM z a JOIN z b ON a.vec_id <> b.vec_id AND a.part = 'train' AND b.part = 'train'),
 db AS (SELECT avg(x) AS dbar FROM (SELECT avg(d) AS x FROM tt GROUP BY vec_id)),
 td AS (SELECT vec_id, min(d) / dbar AS di FROM tt, db WHERE fold <> f2 GROUP BY vec_id, dbar),
 th AS (SELECT max(di) AS threshold FROM td, (SELECT quantile_cont(di, 0.25) AS a, quantile_cont(di, 0.75) AS b FROM td) WHERE di <= b + 1.5 * (b - a)),
 nn AS (SELECT a.vec_id, b.vec_id AS id, sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) ** 2))) / dbar AS d FROM z a JOIN z b ON a.part = 'new' AND b.part = 'train', db)"""
_PD = """WITH r AS (SELECT b1, b2, b4, b1 * b2 + sqrt(b4) AS own FROM cells WHERE b4 IS NOT NULL), v AS (SELECT b1 AS value, count(*) AS n_rows FROM r GROUP BY 1),
 s AS (SELECT value, n_rows, value * b2 + sqrt(b4){less} AS p FROM v, r), o AS (SELECT value, n_rows, avg(p) AS mean, quantile_cont(p, 0.05) AS lci, quantile_cont(p, 0.95) AS uci FROM s GROUP BY 1, 2)"""
_SHAP = "WITH c AS (SELECT CAST(row AS BIGINT) * 100000 + col AS cell_id, b1, b2, b3 FROM cells), mu AS (SELECT avg(b1) AS m1, avg(b2) AS m2, avg(b3) AS m3 FROM c), ph AS (" + " UNION ALL ".join(
    f"SELECT cell_id, 'b{k}' AS feature, {w} * (b{k} - m{k}) AS phi, 2.0 * b1 - 1.5 * b2 + 3.0 * b3 AS score FROM c, mu" for k, w in ((1, 2.0), (2, -1.5), (3, 3.0))
) + ")"

_PARCELS = """WITH s AS (SELECT point_id, x - 0.5 AS x, floor(y * 2) / 2 AS y FROM points),
  m AS (SELECT point_id, poly_id, class_name FROM s JOIN polygons ON (x BETWEEN xmin AND xmin + 5 AND y BETWEEN 0 AND ymax AND abs(x - xmin - 2.5) + abs(y - 10) >= 2)
    OR (y BETWEEN 200 AND 300 AND abs(x - xmin - 2.5) * 40 <= 300 - y))"""

ORACLES = {
    "csv2_roundtrip": with_inputs("soil", "SELECT row_id, c_gkg, sand_gkg, p_mgkg FROM soil"),
    "csv_roundtrip": "SELECT p_partkey, p_brand, p_size FROM part",
    "text_export": with_inputs("soil", "SELECT CAST(row_id AS VARCHAR) AS row_id, CAST(coord_id AS VARCHAR) AS coord_id, coalesce(CAST(CAST(k_mmolkg AS INTEGER) AS VARCHAR), '') AS k_mmolkg FROM soil"),
    "layer_outputs": with_inputs("cells", " UNION ALL ".join(f"SELECT '{b}' AS layer, count({b}) AS n, round(sum({b}), 4) AS total FROM cells" for b in ("b1", "b2", "b4"))),
    "catalog_links": """SELECT page_id, href, regexp_replace(url, '/+$', '') || '/' || regexp_replace(href, '^/+', '') AS path FROM
      (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE regexp_matches(href, '^/[A-Z]') AND regexp_matches(href, '[a-m]$')""",
    "detect_dataset_ids": with_inputs("id_index", f"WITH {_IDS} SELECT dataset_id FROM ids"),
    "invalid_ids": with_inputs("id_index", "SELECT DISTINCT dataset_id AS requested FROM id_index WHERE NOT regexp_matches(trim(dataset_id), '^[A-Za-z]{3}[0-9]{4}$')"),
    "manifest_status": with_inputs("id_index", _MAN + " SELECT dataset_id, table_name, file_path, checked_after, status FROM ms"),
    "manifest_summary": with_inputs("id_index", _MAN + " SELECT status, checked_after, count(*) AS n_files FROM ms GROUP BY 1, 2"),
    "uri_mapping": """WITH f AS (SELECT CASE WHEN p_size % 7 = 0 THEN '/other/place' ELSE '/data/soil' END || '/' || p_brand || '/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.csv' ELSE '.tif' END AS file_path FROM part)
      SELECT file_path, CASE WHEN starts_with(file_path, '/data/soil/') AND file_path LIKE '%.tif' THEN 'gs://bucket/soil/' || substr(file_path, 12) END AS object_uri,
      CASE WHEN NOT starts_with(file_path, '/data/soil/') THEN 'outside_root' WHEN file_path NOT LIKE '%.tif' THEN 'pattern' END AS rejected FROM f""",
    "pending_work": with_inputs("predobs", _REQ + " SELECT run, model FROM rq WHERE NOT (run % 2 = 0 AND model <> 'qrf')"),
    "resume_pending": with_inputs("predobs", _REQ + ", l AS (SELECT model, max(run) AS last FROM rq WHERE run <= 2 AND model = 'rf' GROUP BY 1) SELECT model, run, coalesce(last, -1) + 1 AS restart_at FROM rq LEFT JOIN l USING (model) WHERE run > coalesce(last, -1)"),
    "resume_conflicts": with_inputs("predobs", _REQ + " SELECT run, model, 'k' AS field, CAST(run + 5 AS VARCHAR) AS was, '7' AS now FROM rq WHERE run + 5 <> 7 UNION ALL SELECT run, model, 'metric', 'r2', 'mqi' FROM rq WHERE run = 3"),
    "points_to_class": with_inputs("points polygons", "SELECT class_name, count(*) AS n_points FROM points LEFT JOIN polygons ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY 1"),
    "points_to_class_no_na": with_inputs("points polygons", "SELECT class_name, count(*) AS n_points FROM points JOIN polygons ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY 1"),
    "rings_to_class": with_inputs("points polygons", _PARCELS + " SELECT class_name, count(*) AS n_points FROM s LEFT JOIN m ON s.point_id = m.point_id GROUP BY 1"),
    "points_in_rings": with_inputs("points polygons", _PARCELS + " SELECT point_id, poly_id FROM m"),
    "points_in_polygon": with_inputs("points polygons", "SELECT point_id, poly_id FROM points JOIN polygons ON x > xmin AND y > ymin AND (x - xmin) / (xmax - xmin) + (y - ymin) / (ymax - ymin) < 1"),
    "vector_modal": with_inputs("layers", """WITH u AS (SELECT x, y, unnest([m3, m1, m2]) AS v, unnest([1, 2, 3]) AS k FROM layers), c AS (SELECT x, y, v, count(*) AS n, min(k) AS k FROM u GROUP BY 1, 2, 3)
      SELECT x, y, v AS modal FROM c QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY n DESC, k) = 1"""),
    "vector_variety": with_inputs("layers", "SELECT x, y, CAST(len(list_distinct([m1, m2, m3])) AS INTEGER) AS variety FROM layers"),
    "aoa_di": with_inputs("train_new", _AOA + " SELECT vec_id, round(min(d), 5) AS di FROM nn GROUP BY 1"),
    "train_di_threshold": with_inputs("train_new", _AOA + " SELECT round(threshold, 5) AS threshold FROM th"),
    "aoa_flag": with_inputs("train_new", _AOA + " SELECT vec_id, CAST(min(d) <= any_value(threshold) AS INTEGER) AS aoa FROM nn, th GROUP BY 1"),
    "aoa_lpd": with_inputs("train_new", _AOA + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, id) AS k FROM nn) SELECT vec_id, CAST(count(CASE WHEN d < threshold THEN 1 END) AS INTEGER) AS lpd, count(CASE WHEN d < threshold THEN 1 END) / 20 AS lpd_share FROM r, th WHERE k <= 20 GROUP BY 1"),
    "aoa_neighbours": with_inputs("train_new", _AOA + " SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, id) AS INTEGER) AS place, id AS neighbour FROM nn QUALIFY place <= 5"),
    "aoa_classes": """WITH a AS (SELECT s_suppkey AS vec_id, s_acctbal AS target, ['a', 'b', 'c'][s_nationkey % 3 + 1] AS class FROM supplier), t AS (SELECT * FROM a WHERE vec_id % 4 <> 0 AND class <> 'c'), n AS (SELECT * FROM a WHERE vec_id % 4 = 0 OR class = 'c'),
      m AS (SELECT avg(target) AS mt, stddev_samp(target) AS st, avg(CAST(class = 'a' AS DOUBLE)) AS ma, stddev_samp(CAST(class = 'a' AS DOUBLE)) AS sa, avg(CAST(class = 'b' AS DOUBLE)) AS mb, stddev_samp(CAST(class = 'b' AS DOUBLE)) AS sb FROM t),
      z AS (SELECT vec_id, part, 2 * (target - mt) / st AS x, (CAST(class = 'a' AS DOUBLE) - ma) / sa AS y, (CAST(class = 'b' AS DOUBLE) - mb) / sb AS w FROM (SELECT *, 't' AS part FROM t UNION ALL SELECT *, 'n' FROM n), m),
      p AS (SELECT a.vec_id, a.part, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.w - b.w) ** 2) AS d FROM z a JOIN z b ON b.part = 't' AND a.vec_id <> b.vec_id),
      db AS (SELECT avg(x) AS dbar FROM (SELECT avg(d) AS x FROM p WHERE part = 't' GROUP BY vec_id)) SELECT vec_id, round(min(d) / any_value(dbar), 5) AS di FROM p, db WHERE part = 'n' GROUP BY 1""",
    "vector_bound": with_inputs("layers", "SELECT x, m1, m2, m3, greatest(m1, m2, m3) AS greatest FROM layers"),
    "tree_value_functions": "SELECT l_orderkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(min(l_extendedprice), 6) AS least, round(max(l_extendedprice) - min(l_extendedprice), 6) AS spread FROM lineitem GROUP BY 1",
    "depth_weighted_mean": with_inputs("profiles", """WITH s AS (SELECT unnest([0.0, 5.0, 15.0, 30.0, 60.0]) AS a, unnest([5.0, 15.0, 30.0, 60.0, 100.0]) AS b),
      o AS (SELECT profile_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, value, least(lower_limit, b) - greatest(upper_limit, a) AS w FROM profiles, s)
      SELECT profile_id, a AS upper, b AS lower, round(sum(w * value) / sum(w), 5) AS value FROM o WHERE w > 0 GROUP BY 1, 2, 3"""),
    "partial_dependence": with_inputs("cells", _PD.format(less="") + " SELECT value, n_rows, round(mean, 5) + 0.0 AS mean, round(lci, 5) + 0.0 AS lci, round(uci, 5) + 0.0 AS uci FROM o"),
    "partial_dependence_delta": with_inputs("cells", _PD.format(less=" - own") + " SELECT value, n_rows, round(mean, 5) + 0.0 AS mean, round(lci, 5) + 0.0 AS lci, round(uci, 5) + 0.0 AS uci FROM o"),
    "shapley_linear": with_inputs("cells", _SHAP + " SELECT cell_id, feature, round(phi, 6) + 0.0 AS phi FROM ph"),
    "shapley_adjust": with_inputs("cells", _SHAP + """, q AS (SELECT *, phi * phi + 0.01 AS var, sum(phi) OVER w AS s, max(phi * phi + 0.01) OVER w AS vmax FROM ph WINDOW w AS (PARTITION BY cell_id)),
      k AS (SELECT *, var / vmax * 1e6 AS v, score - s - 1.0 AS err FROM q), y AS (SELECT *, sum(v) OVER (PARTITION BY cell_id) AS vs FROM k)
      SELECT cell_id, feature, round(phi, 5) + 0.0 AS phi, round(phi + err * (v - v * vs / (1 + vs)), 5) + 0.0 AS phi_adjusted FROM y"""),
    "tree_value_quantiles": "SELECT l_orderkey, round(quantile_cont(l_extendedprice, 0.05), 6) AS q5, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd FROM lineitem GROUP BY 1",
}

QUERIES = [
    csv2_roundtrip, csv_roundtrip, text_export, layer_outputs, catalog_links, detect_dataset_ids, invalid_ids, manifest_status, manifest_summary, uri_mapping,
    pending_work, resume_pending, resume_conflicts, points_to_class, points_to_class_no_na, points_in_polygon, points_in_rings, rings_to_class, vector_modal, vector_variety, aoa_di,
    train_di_threshold, aoa_flag, aoa_lpd, aoa_neighbours, aoa_mahalanobis, aoa_classes, vector_bound, tree_value_functions, depth_weighted_mean, depth_spline, partial_dependence,
    partial_dependence_delta, partial_dependence_model, shapley_linear, shapley_mc, shapley_adjust, tree_value_quantiles,
]
ORACLES["partial_dependence_model"] = ORACLES["partial_dependence"]
