"""V: vectors and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.operators import clustering as C
from boxwright.operators import graphs, metrics, models
from boxwright.plans.registry import query
from boxwright.sources import fixtures as X

K = 6
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_CENTRES = f"centres AS (SELECT vec_id AS k, e AS c FROM v WHERE vec_id < {K})"
_DIST = "list_sum(list_transform(generate_series(1, 64), lambda i: (e[i]-c[i])*(e[i]-c[i])))"
_ASSIGNED = f"assigned AS (SELECT vec_id, label, min({{'d': round(d, 9), 'k': k}}).k AS cluster, min(round(d, 6)) AS distance FROM (SELECT vec_id, label, k, {_DIST} AS d FROM v, centres) GROUP BY ALL)"


def vectors(spark, d):
    return X.table(spark, d, "embeddings").select("vec_id", "label", C.doubles(F.col("embedding")).alias("e"))


def first_centres(spark, d):
    """The first K vectors by id: explicit initial centres."""
    return [list(r["e"]) for r in vectors(spark, d).where(F.col("vec_id") < K).orderBy("vec_id").collect()]


def assigned(spark, d):
    best = C.nearest(F.col("e"), first_centres(spark, d))
    return vectors(spark, d).select("vec_id", "label", best["cluster"].cast("long").alias("cluster"), F.round(best["distance"], 6).alias("distance"))


@query("V01_centre_normalise", f"WITH {_V}, m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(e[i]) AS m FROM v, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i)) SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: x[i]*x[i])), 6) AS square, round(x[1]/(sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: x[i]*x[i]))) + 1e-8::DOUBLE), 6) AS first FROM (SELECT vec_id, list_transform(generate_series(1, 64), lambda i: e[i]-m[i]) AS x FROM v, m)")
def v01(spark, d):
    rows = vectors(spark, d)
    mean = C.mean_vector(rows, "e")
    moved = F.zip_with("e", C.constant(mean), lambda a, b: a - b)
    square = F.aggregate(moved, F.lit(0.0), lambda s, v: s + v * v)
    return rows.select("vec_id", F.round(square, 6).alias("square"), F.round(F.get(C.centred_unit(F.col("e"), mean), F.lit(0)), 6).alias("first"))


@query("V02_nearest_centre", f"WITH {_V}, {_CENTRES}, {_ASSIGNED} SELECT vec_id, cluster, distance FROM assigned")
def v02(spark, d):
    return assigned(spark, d).select("vec_id", "cluster", "distance")


@query("V03_lloyd_step", f"WITH {_V}, {_CENTRES}, {_ASSIGNED} SELECT cluster, i AS pos, round(avg(e[i]), 6) AS centre FROM v JOIN assigned USING (vec_id), (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY cluster, i")
def v03(spark, d):
    new = C.lloyd_step(vectors(spark, d), "e", first_centres(spark, d))
    rows = [(k, p + 1, float(x)) for k, c in enumerate(new) for p, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster long, pos long, c double").select("cluster", "pos", F.round("c", 6).alias("centre"))


_ROUNDS = 3
_FIT = f"f0 AS (SELECT k, c FROM centres), d AS (SELECT vec_id, e FROM v WHERE vec_id % 5 <> 0), " + ", ".join(
    f"""g{n} AS (SELECT vec_id, any_value(e) AS e, min({{'d': {_DIST}, 'k': k}}).k AS k FROM d, f{n} GROUP BY vec_id),
m{n} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(e[i]) AS m FROM g{n}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY k, i) GROUP BY k),
f{n + 1} AS (SELECT f.k, coalesce(m.c, f.c) AS c FROM f{n} f LEFT JOIN m{n} m ON m.k = f.k)"""
    for n in range(_ROUNDS)
)


def stored(spark, d):
    """The model fitted on the discovery part, as it is read back from its store."""
    path = graphs.scratch(spark, "cluster-model")
    models.save_model(spark, path, C.fit(vectors(spark, d).where("vec_id % 5 <> 0"), "e", first_centres(spark, d), iterations=_ROUNDS))
    return models.load_model(spark, path, 64)


@query("V04_fit_and_persist", f"WITH {_V}, {_CENTRES}, {_FIT} SELECT CAST(k AS INT) AS cluster, list_transform(c, lambda x: round(x, 6)) AS centre FROM f{_ROUNDS}")
def v04(spark, d):
    """Centres fitted on the discovery part, published as a sealed version and loaded again."""
    model = stored(spark, d)
    rows = spark.createDataFrame(list(enumerate(model.centres)), "cluster int, centre array<double>")
    return rows.select("cluster", F.transform("centre", lambda x: F.round(x, 6)).alias("centre"))


@query("V05_assign_stored", f"WITH {_V}, {_CENTRES}, {_FIT} SELECT vec_id, 'cluster-' || CAST(min({{'d': round({_DIST}, 9), 'k': k}}).k AS VARCHAR) AS name FROM v, f{_ROUNDS} WHERE vec_id % 5 = 0 GROUP BY vec_id")
def v05(spark, d):
    """Held-out vectors by the stored model."""
    best = stored(spark, d).assign(F.col("e"))
    return vectors(spark, d).where("vec_id % 5 = 0").select("vec_id", F.concat(F.lit("cluster-"), best["cluster"].cast("string")).alias("name"))


_N = "n AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM assigned GROUP BY ALL), a AS (SELECT cluster, sum(n) AS a, max(n) AS top FROM n GROUP BY ALL), b AS (SELECT label, sum(n) AS b FROM n GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n)"


@query("V06_metrics_bundle", f"WITH {_V}, {_CENTRES}, {_ASSIGNED}, {_N} SELECT CAST(t AS BIGINT) AS image_count, round((SELECT sum(top) FROM a)/t, 9) AS purity, round((SELECT sum(n/t*ln(n*t/(a*b))) FROM n JOIN a USING (cluster) JOIN b USING (label), t)/sqrt((SELECT sum(-a/t*ln(a/t)) FROM a, t)*(SELECT sum(-b/t*ln(b/t)) FROM b, t)), 9) AS nmi, round(((SELECT sum(n*(n-1)/2) FROM n) - (SELECT sum(a*(a-1)/2) FROM a)*(SELECT sum(b*(b-1)/2) FROM b)/(t*(t-1)/2))/(((SELECT sum(a*(a-1)/2) FROM a)+(SELECT sum(b*(b-1)/2) FROM b))/2 - (SELECT sum(a*(a-1)/2) FROM a)*(SELECT sum(b*(b-1)/2) FROM b)/(t*(t-1)/2)), 9) AS ari FROM t")
def v06(spark, d):
    bundle = metrics.agreement(assigned(spark, d).select("cluster", F.col("label").alias("category")))
    return bundle.select("image_count", *(F.round(c, 9).alias(c) for c in ("purity", "nmi", "ari")))
