"""Sequence, distance, clustering, spectral and regime queries (ARR*, DST*, CLU*, SPC*, REG*)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import arrays, dynamics
from tidewell.operators import clustering, distances, regimes, sequences, spectral
from tidewell.operators import windows as win
from tidewell.panel import number_rows, split_series, with_position
from tidewell.plans import panels as P
from tidewell.plans.registry import day, q, query, sday, sq, table
from tidewell.plans.window_queries import SPECTRUM_SQL, WSQL

W = 12
WIN_SQL = (
    f"p AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM {{0}} {WSQL}), "
    f"win AS (SELECT a.series_id, a.t AS start, b.t - a.t AS pos, b.y AS v FROM p a JOIN p b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + {W - 1} WHERE a.t + {W} <= a.n)"
)


def windows_of(panel, **kw):
    return sequences.sliding_windows(panel, W, **kw)


def long_cells(df, *keys, col="window", digits=4):
    return df.select(*keys, F.posexplode(col).alias("pos", "v")).select(*keys, F.col("pos").cast("bigint").alias("pos"), q("v", digits).alias("v"))


@query("arr1_sliding_windows", f"{P.ctes('wide')}, {WIN_SQL.format('wide')} SELECT series_id, start, pos, {sq('v', 4)} AS v FROM win WHERE start % 3 = 0")
def _(spark, sf):
    w = windows_of(P.wide(spark, sf), stride=3)
    return long_cells(w, "series_id", F.col("start").cast("bigint").alias("start"))


@query(
    "arr1_long_series_windows",
    f"{P.ctes('raw')}, p AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1 AS t FROM raw) "
    f"SELECT series_id, t AS start, {sq('avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)', 5)} AS mean FROM p "
    "QUALIFY count(*) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) = 12",
)
def _(spark, sf):
    rows = split_series(number_rows(P.raw(spark, sf), tie=("event_id",)), 1_000, after=W - 1)
    w = sequences.sliding_windows(rows, W, by=("series_id", "part_id"), order=("t",)).where(~F.col("is_halo"))
    return w.select("series_id", "start", q(arrays.mean(F.col("window")), 5).alias("mean"))


@query(
    "arr2_supervised",
    f"{P.ctes('monthly')}, {WIN_SQL.format('monthly')} SELECT win.series_id, start, {sq('avg(v)', 3)} AS x_mean, {sq('any_value(a.y)', 4)} AS next_1, {sq('any_value(b.y)', 4)} AS next_2 "
    "FROM win JOIN p a ON a.series_id = win.series_id AND a.t = start + 12 JOIN p b ON b.series_id = win.series_id AND b.t = start + 13 GROUP BY 1, 2",
)
def _(spark, sf):
    s = sequences.supervised(P.monthly(spark, sf), W, 2)
    return s.select("series_id", F.col("start").cast("bigint").alias("start"), q(arrays.mean(F.col("x")), 3).alias("x_mean"), q(F.col("target")[0], 4).alias("next_1"), q(F.col("target")[1], 4).alias("next_2"))


FEATURES = ("y", "lag_1", "roll_mean_3")


def multi(spark, sf):
    df = P.monthly(spark, sf).withColumns(win.lags(ks=(1,)) | win.roll_mean(windows=(3,)))
    return sequences.multivariate(df, FEATURES, 6)


MULTI_SQL = (
    f"p AS (SELECT series_id, ts, y, lag(y) OVER w AS lag_1, avg(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll_mean_3, "
    f"row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM monthly {WSQL}), "
    "s AS (SELECT a.series_id, a.t AS start, b.t - a.t AS pos, b.y, b.lag_1, b.roll_mean_3, c.y AS target FROM p a JOIN p b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 5 "
    "JOIN p c ON c.series_id = a.series_id AND c.t = a.t + 6 WHERE a.t >= 1), "
    "cl AS (SELECT series_id, start, target, pos, 'y' AS feature, y AS value FROM s UNION ALL SELECT series_id, start, target, pos, 'lag_1', lag_1 FROM s UNION ALL SELECT series_id, start, target, pos, 'roll_mean_3', roll_mean_3 FROM s)"
)


@query("arr3_multivariate", f"{P.ctes('monthly')}, {MULTI_SQL} SELECT series_id, start, pos, feature, {sq('value', 4)} AS value, {sq('target', 4)} AS target FROM cl")
def _(spark, sf):
    c = sequences.cells(multi(spark, sf), FEATURES, ["series_id", "start", "target"])
    return c.select("series_id", F.col("start").cast("bigint").alias("start"), F.col("pos").cast("bigint").alias("pos"), "feature", q("value", 4).alias("value"), q("target", 4).alias("target"))


ZN_SQL = "zn AS (SELECT *, (v - avg(v) OVER (PARTITION BY series_id, start)) / (CASE WHEN stddev_pop(v) OVER (PARTITION BY series_id, start) > 0 THEN stddev_pop(v) OVER (PARTITION BY series_id, start) ELSE 1 END) AS z FROM win)"


@query("arr4_z_norm", f"{P.ctes('monthly')}, {WIN_SQL.format('monthly')}, {ZN_SQL} SELECT series_id, start, pos, {sq('z', 6)} AS v FROM zn")
def _(spark, sf):
    return long_cells(windows_of(P.monthly(spark, sf), normalise=True), "series_id", F.col("start").cast("bigint").alias("start"), digits=6)


@query("arr5_persistence", f"{P.ctes('wide')}, {WIN_SQL.format('wide')} SELECT w.series_id, start, {sq('w.v', 4)} AS yhat, {sq('p.y', 4)} AS y FROM win w JOIN p ON p.series_id = w.series_id AND p.t = start + 12 WHERE pos = 11")
def _(spark, sf):
    s = sequences.supervised(P.wide(spark, sf), W)
    return s.select("series_id", F.col("start").cast("bigint").alias("start"), q(sequences.last_value(F.col("x")), 4).alias("yhat"), q("target", 4).alias("y"))


@query("arr6_templates", f"{P.ctes('wide')}, {WIN_SQL.format('wide')} SELECT pos, {sq('avg(v)', 3)} AS mean, {sq('median(v)', 3)} AS median FROM win GROUP BY 1")
def _(spark, sf):
    t = sequences.templates(windows_of(P.wide(spark, sf)))
    return t.select(F.col("pos").cast("bigint").alias("pos"), q("mean", 3).alias("mean"), q("median", 3).alias("median"))


@query("arr7_profile", f"{P.ctes('monthly')}, {MULTI_SQL} SELECT pos, feature, {sq('avg(value)', 3)} AS mean, {sq('stddev_pop(value)', 3)} AS std FROM cl GROUP BY 1, 2")
def _(spark, sf):
    p = sequences.profile(multi(spark, sf), FEATURES)
    return p.select(F.col("pos").cast("bigint").alias("pos"), "feature", q("mean", 3).alias("mean"), q("std", 3).alias("std"))


@query("arr7_feature_means", f"{P.ctes('monthly')}, {MULTI_SQL} SELECT series_id, start, pos, {sq('avg(value)', 3)} AS v FROM cl GROUP BY 1, 2, 3")
def _(spark, sf):
    m = multi(spark, sf).withColumn("m", sequences.feature_means(6, 3))
    return long_cells(m, "series_id", F.col("start").cast("bigint").alias("start"), col="m", digits=3)


@query("arr8_target_link", f"{P.ctes('monthly')}, {MULTI_SQL} SELECT pos, feature, {sq('abs(corr(value, target))')} AS abs_r FROM cl GROUP BY 1, 2")
def _(spark, sf):
    t = sequences.target_link(multi(spark, sf), FEATURES)
    return t.select(F.col("pos").cast("bigint").alias("pos"), "feature", q("abs_r").alias("abs_r"))


@query(
    "arr9_complexity",
    f"{P.ctes('monthly')}, {MULTI_SQL}, d AS (SELECT series_id, start, feature, stddev_pop(value) AS sd FROM cl GROUP BY 1, 2, 3) SELECT series_id, start, {sq('avg(sd)', 3)} AS complexity FROM d GROUP BY 1, 2",
)
def _(spark, sf):
    m = multi(spark, sf)
    return m.select("series_id", F.col("start").cast("bigint").alias("start"), q(sequences.complexity(m, 6, 3), 3).alias("complexity"))


# --- distances ----------------------------------------------------------------

EMB = (
    "e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), "
    "c AS (SELECT label AS centroid, pos, avg(v) AS m FROM e GROUP BY 1, 2)"
)


def embedded(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e, distances.as_literals(distances.centroids(e, "label", "v"), "label", "v")


@query("dst1_euclid_to_centroids", f"WITH {EMB} SELECT vec_id, CAST(centroid AS BIGINT) AS centroid, {sq('sqrt(sum((v - m) * (v - m)))', 5)} AS distance FROM e JOIN c USING (pos) GROUP BY 1, 2")
def _(spark, sf):
    e, centers = embedded(spark, sf)
    d = distances.to_centroids(e, "v", centers, distances.euclid_to, ["vec_id"])
    return d.select("vec_id", F.col("centroid").cast("bigint").alias("centroid"), q("distance", 5).alias("distance"))


@query(
    "dst2_lower_bound",
    f"WITH {EMB}, b AS (SELECT centroid, pos, min(m) OVER (PARTITION BY centroid ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS lo, "
    "max(m) OVER (PARTITION BY centroid ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS hi FROM c) "
    f"SELECT vec_id, CAST(centroid AS BIGINT) AS centroid, {sq('sqrt(sum(pow(greatest(v - hi, lo - v, 0), 2)))', 5)} AS bound FROM e JOIN b USING (pos) GROUP BY 1, 2",
)
def _(spark, sf):
    e, centers = embedded(spark, sf)
    d = distances.to_centroids(e, "v", centers, distances.keogh_to(16), ["vec_id"], out="bound")
    return d.select("vec_id", F.col("centroid").cast("bigint").alias("centroid"), q("bound", 5).alias("bound"))


def template_literals(spark, sf):
    t = sequences.templates(windows_of(P.monthly(spark, sf), normalise=True)).orderBy("pos").collect()
    return {"mean": [r["mean"] for r in t], "median": [r["median"] for r in t]}


INF = "'Infinity'::DOUBLE"
TEMPLATE_SQL = (
    f"{P.ctes('monthly').replace('WITH', 'WITH RECURSIVE')}, {WIN_SQL.format('monthly')}, {ZN_SQL}, "
    "tp AS (SELECT pos, avg(z) AS mean, median(z) AS median FROM zn GROUP BY 1), "
    "tc AS (SELECT 'mean' AS template, pos, mean AS m FROM tp UNION ALL SELECT 'median', pos, median FROM tp), "
    "tl AS (SELECT template, list(m ORDER BY pos) AS b FROM tc GROUP BY 1), "
    "a AS (SELECT series_id, start, list(z ORDER BY pos) AS a FROM zn GROUP BY 1, 2), "
    f"dp AS (SELECT series_id, start, template, a, b, 0 AS i, list_concat([0.0::DOUBLE], list_transform(range(12), lambda k: {INF})) AS r FROM a, tl UNION ALL "
    f"SELECT series_id, start, template, a, b, i + 1, list_reduce(list_concat([[{INF}]], list_transform(range(1, 13), lambda j: [j::DOUBLE])), "
    f"lambda cur, j: list_concat(cur, [CASE WHEN abs(i + 1 - j[1]) <= 3 THEN pow(a[i + 1] - b[j[1]::INT], 2) + least(r[j[1]::INT + 1], r[j[1]::INT], cur[len(cur)]) ELSE {INF} END])) FROM dp WHERE i < 12), "
    "wd AS (SELECT series_id, start, template, sqrt(r[13]) AS distance FROM dp WHERE i = 12)"
)


@query("dst3_warping_to_templates", f"{TEMPLATE_SQL} SELECT series_id, start, template, {sq('distance', 5)} AS distance FROM wd")
def _(spark, sf):
    w = windows_of(P.monthly(spark, sf), normalise=True)
    d = distances.to_centroids(w, "window", template_literals(spark, sf), distances.dtw_to(3), ["series_id", "start"], label="template")
    return d.select("series_id", F.col("start").cast("bigint").alias("start"), "template", q("distance", 5).alias("distance"))


def _dtw_sql():
    """Unbanded warping distance of consecutive windows, one recursion step per table row."""
    return (
        f"{P.ctes('monthly').replace('WITH', 'WITH RECURSIVE')}, {WIN_SQL.format('monthly')}, {ZN_SQL}, "
        "a AS (SELECT series_id, start, list(z ORDER BY pos) AS x FROM zn GROUP BY 1, 2), "
        "pr AS (SELECT c.series_id, c.start, c.x AS a, p.x AS b FROM a c JOIN a p ON c.series_id = p.series_id AND p.start = c.start - 1), "
        "dp AS (SELECT series_id, start, a, b, 0 AS i, list_concat([0.0::DOUBLE], list_transform(range(12), lambda k: 'Infinity'::DOUBLE)) AS r FROM pr UNION ALL "
        "SELECT series_id, start, a, b, i + 1, list_reduce(list_concat([['Infinity'::DOUBLE]], list_transform(range(1, 13), lambda j: [j::DOUBLE])), "
        "lambda cur, j: list_concat(cur, [pow(a[i + 1] - b[j[1]::INT], 2) + least(r[j[1]::INT + 1], r[j[1]::INT], cur[len(cur)])])) FROM dp WHERE i < 12) "
        f"SELECT series_id, start, {sq('sqrt(r[13])', 5)} AS dtw_prev FROM dp WHERE i = 12 UNION ALL SELECT series_id, start, NULL FROM a WHERE start = 0"
    )


@query("dst3_warping_to_previous", _dtw_sql())
def _(spark, sf):
    w = distances.to_previous(windows_of(P.monthly(spark, sf), normalise=True))
    return w.select("series_id", F.col("start").cast("bigint").alias("start"), q("dtw_prev", 5).alias("dtw_prev"))


PRUNE_SQL = (
    f"{TEMPLATE_SQL}, ev AS (SELECT template, pos, min(m) OVER w AS lo, max(m) OVER w AS hi FROM tc WINDOW w AS (PARTITION BY template ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), "
    "lb AS (SELECT series_id, start, template, sqrt(sum(pow(greatest(z - hi, lo - z, 0), 2))) AS bound FROM zn JOIN ev USING (pos) GROUP BY 1, 2, 3), "
    "li AS (SELECT template, quantile_cont(bound, 0.8) AS lim FROM lb GROUP BY 1) "
    f"SELECT lb.series_id, lb.start, lb.template AS centroid, {sq('bound', 5)} AS bound, {sq('CASE WHEN bound <= lim THEN distance ELSE bound END', 5)} AS distance, (bound <= lim)::INT AS exact "
    "FROM lb JOIN li USING (template) JOIN wd ON wd.series_id = lb.series_id AND wd.start = lb.start AND wd.template = lb.template"
)


@query("dst4_pruned_warping", PRUNE_SQL)
def _(spark, sf):
    w = windows_of(P.monthly(spark, sf), normalise=True)
    d = distances.pruned_dtw(w, "window", template_literals(spark, sf), ["series_id", "start"], 3, keep=0.8)
    return d.select("series_id", F.col("start").cast("bigint").alias("start"), "centroid", q("bound", 5).alias("bound"), q("distance", 5).alias("distance"), F.col("exact").cast("int").alias("exact"))


# --- clustering ---------------------------------------------------------------


@query("clu1_reduce_windows")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    _, z = clustering.reduce_windows(windows_of(P.monthly(spark, sf), normalise=True))
    return z.select("series_id", "start", vector_to_array("z").alias("z")).select("series_id", "start", F.posexplode("z").alias("pos", "v"))


@query("clu2_kmeans_labels")
def _(spark, sf):
    # only the windows are held here, and only the reduced ones by the fit
    _, z = clustering.reduce_windows(windows_of(P.wide(spark, sf), normalise=True).select("window"))
    z = z.select("z")
    return clustering.fit_kmeans(z, 3, restarts=10).transform(z).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clu2_wide_gaps",
    f"SELECT count(*) AS n, {sq('avg(ascii(c_mktsegment) * 1e7 + c_acctbal) / 1e3', 4)} AS centre, {sq('var_pop(c_acctbal)', 2)} AS spread FROM customer GROUP BY c_mktsegment",
)
def _(spark, sf):
    """Clusters that gaps of a thousand widths part: one per segment, whatever the seeds."""
    from pyspark.ml.functions import array_to_vector

    c = table(spark, sf, "customer").withColumn("v", F.ascii("c_mktsegment") * 1e7 + F.col("c_acctbal"))
    z = c.withColumn("z", array_to_vector(F.array("v")))
    labelled = clustering.fit_kmeans(z, 5).transform(z)
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), q(F.avg("v") / 1e3, 4).alias("centre"), q(F.var_pop("c_acctbal"), 2).alias("spread")).drop("label")


@query(
    "clu3_silhouette_of_regions",
    "WITH d AS (SELECT a.n_nationkey AS k, a.n_regionkey AS g, b.n_regionkey AS h, avg(abs(a.n_nationkey - b.n_nationkey)) AS m FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey GROUP BY 1, 2, 3), "
    "s AS (SELECT k, max(m) FILTER (g = h) AS own, min(m) FILTER (g <> h) AS other FROM d GROUP BY 1) "
    f"SELECT k AS n_nationkey, {sq('coalesce((other - own) / greatest(own, other), 0)')} AS silhouette FROM s",
)
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector

    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("label"), array_to_vector(F.array(F.col("n_nationkey").cast("double"))).alias("z"))
    s = clustering.silhouette_sample(n, 100, 42, ["n_nationkey"])
    return s.select("n_nationkey", q("silhouette").alias("silhouette"))


@query("clu3_silhouette_sample")
def _(spark, sf):
    _, z = clustering.reduce_windows(windows_of(P.monthly(spark, sf), normalise=True))
    z = z.persist()
    labelled = clustering.fit_kmeans(z, 3, restarts=10).transform(z)
    return clustering.silhouette_sample(labelled, 60, 42, ["series_id", "start"])


@query("clu4_choose_k")
def _(spark, sf):
    _, z = clustering.reduce_windows(windows_of(P.monthly(spark, sf), normalise=True))
    z = z.persist()
    c = clustering.choose_k(z, (2, 3, 4, 5), restarts=10)
    rows = [F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("cost"), F.lit(float(s)).alias("silhouette")) for k, v, s in zip(c["ks"], c["costs"], c["scores"])]
    total = z.agg(F.count(F.lit(1)).alias("windows"))
    return total.select("windows", F.inline(F.array(*rows)), F.lit(c["elbow"]).alias("elbow"), F.lit(c["silhouette"]).alias("best_silhouette")).select(
        "windows", "k", "cost", "silhouette", "elbow", "best_silhouette"
    )


@query("clu5_cluster_windows")
def _(spark, sf):
    return clustering.cluster_windows(windows_of(P.monthly(spark, sf), normalise=True), ["series_id", "start"], 3, radius=3, restarts=10)


@query(
    "joi2_join_on_window_start",
    f"{P.ctes('monthly')}, {WIN_SQL.format('monthly')}, m AS (SELECT series_id, start, avg(v) AS mean FROM win GROUP BY 1, 2) "
    f"SELECT p.series_id, {sday('p.ts')} AS d, {sq('p.y', 4)} AS y, {sq('m.mean', 3)} AS mean FROM p LEFT JOIN m ON p.series_id = m.series_id AND p.t = m.start",
)
def _(spark, sf):
    pos = with_position(P.monthly(spark, sf))
    w = windows_of(P.monthly(spark, sf)).select("series_id", F.col("start").alias("t"), arrays.mean(F.col("window")).alias("mean"))
    return pos.join(w, ["series_id", "t"], "left").select("series_id", day("ts").alias("d"), q("y", 4).alias("y"), q("mean", 3).alias("mean"))


# --- spectral -------------------------------------------------------------------


@query("spc1_top_frequencies", f"{P.ctes('monthly')}, {SPECTRUM_SQL} SELECT series_id, rank, {sq('omega')} AS omega, {sq('amp', 2)} AS amplitude FROM top WHERE rank <= 3")
def _(spark, sf):
    t = spectral.top_frequencies(P.monthly(spark, sf))
    return t.select("series_id", F.col("rank").cast("bigint").alias("rank"), q("omega").alias("omega"), q("amplitude", 2).alias("amplitude"))


DECOMP_SQL = (
    f"p AS (SELECT *, row_number() OVER w - 1 AS t FROM monthly {WSQL}), "
    "tr AS (SELECT *, CASE WHEN count(*) OVER c = 13 THEN (sum(y) OVER c - (lag(y, 6) OVER o + lead(y, 6) OVER o) / 2) / 12 END AS trend FROM p "
    "WINDOW c AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), o AS (PARTITION BY series_id ORDER BY ts)), "
    "ph AS (SELECT series_id, t % 12 AS phase, avg(y - trend) AS s FROM tr GROUP BY 1, 2), "
    "ps AS (SELECT series_id, phase, s - avg(s) OVER (PARTITION BY series_id) AS seasonal FROM ph)"
)


@query(
    "spc2_decompose",
    f"{P.ctes('monthly')}, {DECOMP_SQL} SELECT tr.series_id, {sday('ts')} AS d, {sq('trend', 3)} AS trend, {sq('seasonal', 3)} AS seasonal, {sq('y - trend - seasonal', 3)} AS resid FROM tr JOIN ps ON tr.series_id = ps.series_id AND tr.t % 12 = ps.phase",
)
def _(spark, sf):
    d = spectral.decompose(P.monthly(spark, sf))
    return d.select("series_id", day("ts").alias("d"), *[q(c, 3).alias(c) for c in ("trend", "seasonal", "resid")])


def _bank_sql(levels=3):
    low = spectral.DB4
    high = [c if i % 2 == 0 else -c for i, c in enumerate(reversed(low))]
    taps = ", ".join(f"({i}, {l!r}::DOUBLE, {h!r}::DOUBLE)" for i, (l, h) in enumerate(zip(low, high)))
    parts = [f"l0 AS (SELECT series_id, row_number() OVER w - 1 AS t, y AS v FROM monthly {WSQL}), taps(i, h, g) AS (VALUES {taps})"]
    for k in range(1, levels + 1):
        parts.append(
            f"e{k} AS (SELECT series_id, t, v FROM l{k - 1} UNION ALL SELECT series_id, t + 1, v FROM l{k - 1} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) = 1 AND count(*) OVER (PARTITION BY series_id) % 2 = 1), "
            f"m{k} AS (SELECT series_id, count(*) AS n FROM e{k} GROUP BY 1), "
            f"x{k} AS (SELECT m.series_id, k.k, sum(e.v * taps.h) AS v, sum(e.v * taps.g) AS dt FROM m{k} m, range(0, 5000) k(k), taps, e{k} e WHERE k.k < m.n // 2 AND e.series_id = m.series_id AND e.t = (2 * k.k + taps.i) % m.n GROUP BY 1, 2), "
            f"l{k} AS (SELECT series_id, k AS t, v FROM x{k})"
        )
    sel = " UNION ALL ".join(f"SELECT series_id, 'd{k}' AS level, {sq('avg(dt * dt)', 0)} AS energy FROM x{k} GROUP BY 1" for k in range(1, levels + 1))
    return f"{P.ctes('monthly')}, {', '.join(parts)} {sel} UNION ALL SELECT series_id, 'a{levels}', {sq('avg(v * v)', 0)} FROM l{levels} GROUP BY 1"


@query("spc3_wavelet_energies", _bank_sql())
def _(spark, sf):
    return spectral.wavelet_energies(P.monthly(spark, sf)).select("series_id", "level", q("energy", 0).alias("energy"))


@query(
    "spc4_ricker_energies",
    f"{P.ctes('monthly')}, p AS (SELECT series_id, row_number() OVER w - 1 AS t, y FROM monthly {WSQL}), sc(s) AS (VALUES (1), (2), (4), (8), (16)), "
    f"c AS (SELECT a.series_id, s, a.t, sum(b.y * {2 / (math.sqrt(3) * math.pi**0.25)!r}::DOUBLE * (1 - pow((b.t - a.t) / s::DOUBLE, 2)) * exp(-pow((b.t - a.t) / s::DOUBLE, 2) / 2)) / sqrt(s) AS w "
    "FROM p a JOIN p b ON a.series_id = b.series_id, sc WHERE abs(b.t - a.t) <= 8 * s GROUP BY 1, 2, 3) "
    f"SELECT series_id, CAST(s AS BIGINT) AS scale, {sq('avg(w * w) / 1e6', 3)} AS energy FROM c GROUP BY 1, 2",
)
def _(spark, sf):
    r = spectral.ricker_energies(P.monthly(spark, sf))
    return r.select("series_id", F.col("scale").cast("bigint").alias("scale"), q(F.col("energy") / 1e6, 3).alias("energy"))


@query(
    "spc5_damped_sum",
    f"{P.ctes('wide')}, p AS (SELECT *, row_number() OVER w - 1 AS t FROM wide {WSQL}) SELECT series_id, {sday('ts')} AS d, "
    f"{sq('2.5 * exp(-0.01 * t) * cos(0.5 * t + 0.3) + 1.5 * exp(-0.02 * t) * cos(1.1 * t - 0.7)')} AS v FROM p",
)
def _(spark, sf):
    rows = [(2.5, 0.01, 0.5, 0.3), (1.5, 0.02, 1.1, -0.7)]
    names = ("amplitude", "decay", "omega", "phase")
    params = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    p = with_position(P.wide(spark, sf))
    return p.select("series_id", day("ts").alias("d"), q(dynamics.damped_sum(F.col("t"), params)).alias("v"))


@query("spc6_fit_damped")
def _(spark, sf):
    f = spectral.fit_damped(P.monthly(spark, sf))
    return f.select("series_id", "mean", "sse", F.posexplode("params").alias("m", "p")).select("series_id", "mean", "sse", "m", "p.*")


@query("spc7_koopman_modes")
def _(spark, sf):
    return spectral.koopman_modes(P.monthly(spark, sf))


# --- regimes ----------------------------------------------------------------------


def standardised(panel):
    w = Window.partitionBy("series_id")
    return panel.withColumn("y", (F.col("y") - F.avg("y").over(w)) / F.stddev_pop("y").over(w))


PENALTY = 4.0
# optimal partitioning over the same candidate ends, one recursion step per end
PARTITION_SQL = (
    f"{P.ctes('monthly').replace('WITH', 'WITH RECURSIVE')}, z AS (SELECT series_id, ts, (y - avg(y) OVER (PARTITION BY series_id)) / stddev_pop(y) OVER (PARTITION BY series_id) AS v FROM monthly), "
    "c AS (SELECT series_id, count(*) AS n, list_concat([0.0::DOUBLE], list(s ORDER BY ts)) AS cs, list_concat([0.0::DOUBLE], list(q ORDER BY ts)) AS cq FROM "
    "(SELECT series_id, ts, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM z WINDOW w AS (PARTITION BY series_id ORDER BY ts)) GROUP BY 1), "
    "e AS (SELECT *, list_concat(list_filter(range(0, n, 5), lambda x: x = 0 OR x >= 2), [n]) AS ends FROM c), "
    "dp AS (SELECT series_id, ends, cs, cq, 1 AS k, [0.0::DOUBLE] AS best, [1::BIGINT] AS prev FROM e UNION ALL "
    "SELECT series_id, ends, cs, cq, k + 1, list_append(best, list_min(cand)), list_append(prev, list_position(cand, list_min(cand))) FROM ("
    "SELECT *, list_transform(range(1, k + 1), lambda j: CASE WHEN ends[k + 1] - ends[j] >= 2 THEN best[j] + (cq[ends[k + 1] + 1] - cq[ends[j] + 1]) "
    f"- pow(cs[ends[k + 1] + 1] - cs[ends[j] + 1], 2) / (ends[k + 1] - ends[j]) + {PENALTY} ELSE 1e300 END) AS cand FROM dp WHERE k < len(ends))), "
    "bt AS (SELECT series_id, ends, prev, prev[k] AS j FROM dp WHERE k = len(ends) UNION ALL SELECT series_id, ends, prev, prev[j] FROM bt WHERE j > 1) "
    "SELECT series_id, CAST(ends[j] AS BIGINT) AS breakpoint FROM bt WHERE j > 1"
)


@query("reg1_change_points", PARTITION_SQL)
def _(spark, sf):
    return regimes.change_points(standardised(P.monthly(spark, sf)), PENALTY)


LONG_JUMP, LONG_PENALTY = 100, 1500.0
LONG_SQL = (
    f"{P.ctes('raw').replace('WITH', 'WITH RECURSIVE')}, m AS (SELECT series_id, avg(y) AS m FROM raw WHERE y IS NOT NULL GROUP BY 1), "
    "p AS (SELECT series_id, y - m AS x, row_number() OVER w AS e, sum(y - m) OVER w AS c1, sum((y - m) * (y - m)) OVER w AS c2, count(*) OVER (PARTITION BY series_id) AS n FROM raw JOIN m USING (series_id) WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)), "
    f"k AS (SELECT series_id, e, c1, c2, row_number() OVER (PARTITION BY series_id ORDER BY e) AS i FROM (SELECT series_id, e, c1, c2 FROM p WHERE e = n OR e % {LONG_JUMP} = 0 UNION ALL SELECT DISTINCT series_id, 0, 0.0, 0.0 FROM p)), "
    "b AS (SELECT series_id, 1::BIGINT AS i, [{'e': 0::BIGINT, 'c1': 0.0::DOUBLE, 'c2': 0.0::DOUBLE, 'f': 0.0::DOUBLE, 'cuts': []::BIGINT[]}] AS s FROM k WHERE i = 1 UNION ALL "
    "SELECT b.series_id, k.i, list_append(b.s, {'e': k.e, 'c1': k.c1, 'c2': k.c2, 'f': o.f, 'cuts': o.cuts}) FROM b JOIN k ON k.series_id = b.series_id AND k.i = b.i + 1, "
    f"LATERAL (SELECT u.f + k.c2 - u.c2 - pow(k.c1 - u.c1, 2) / (k.e - u.e) + {LONG_PENALTY} AS f, CASE WHEN u.e > 0 THEN list_append(u.cuts, u.e) ELSE u.cuts END AS cuts FROM (SELECT unnest(b.s) AS u) "
    f"WHERE k.e - u.e >= 2 ORDER BY u.f + k.c2 - u.c2 - pow(k.c1 - u.c1, 2) / (k.e - u.e), u.e LIMIT 1) o) "
    "SELECT series_id, unnest(s[-1].cuts) AS breakpoint FROM b QUALIFY i = max(i) OVER (PARTITION BY series_id)"
)


@query("reg1_long_series", LONG_SQL)
def _(spark, sf):
    return regimes.long_change_points(P.raw(spark, sf), LONG_PENALTY, tie=("event_id",), jump=LONG_JUMP)


CUT_GAIN = 9000.0
SEGMENT_SQL = (
    f"{P.ctes('raw').replace('WITH', 'WITH RECURSIVE')}, p AS (SELECT series_id, y, row_number() OVER w - 1 AS t, sum(y) OVER w - y AS c FROM raw WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)), "
    "n AS (SELECT series_id, count(*) AS n, sum(y) AS s FROM p GROUP BY 1), "
    "sg AS (SELECT series_id, CAST(0 AS BIGINT) AS a, n AS b, 0.0::DOUBLE AS ca, s AS cb, 0 AS depth FROM n UNION ALL "
    "SELECT series_id, x.a, x.b, x.ca, x.cb, depth + 1 FROM (SELECT sg.*, k.t AS cut, k.c AS cc FROM sg, LATERAL (SELECT p.t, p.c FROM p WHERE p.series_id = sg.series_id AND p.t >= sg.a + 2 AND p.t <= sg.b - 2 AND p.t % 5 = 0 "
    f"AND pow(p.c - ca, 2) / (p.t - a) + pow(cb - p.c, 2) / (b - p.t) - pow(cb - ca, 2) / (b - a) > {CUT_GAIN} "
    "ORDER BY pow(p.c - ca, 2) / (p.t - a) + pow(cb - p.c, 2) / (b - p.t) - pow(cb - ca, 2) / (b - a) DESC, p.t LIMIT 1) k) s, "
    "LATERAL (SELECT s.a AS a, s.cut AS b, s.ca AS ca, s.cc AS cb UNION ALL SELECT s.cut, s.b, s.cc, s.cb) x WHERE depth < 20), "
    "st AS (SELECT series_id, a, min(b) AS b FROM sg GROUP BY 1, 2) "
    f"SELECT st.series_id, st.a AS segment_start, count(*) AS n, {sq('avg(y)', 5)} AS mean FROM st JOIN p ON p.series_id = st.series_id AND p.t >= st.a AND p.t < st.b GROUP BY 1, 2"
)


@query("reg1_binary_segmentation", SEGMENT_SQL)
def _(spark, sf):
    s = regimes.binary_segmentation(P.raw(spark, sf), CUT_GAIN, tie=("event_id",))
    return s.groupBy("series_id", "segment_start").agg(F.count(F.lit(1)).alias("n"), q(F.avg("y"), 5).alias("mean"))


@query(
    "reg2_regime_labels",
    f"{P.ctes('monthly')}, p AS (SELECT *, row_number() OVER w - 1 AS t FROM monthly {WSQL}), b AS (SELECT *, month(ts) IN (3, 10) AS cut FROM p) "
    f"SELECT series_id, {sday('ts')} AS d, CAST(sum(cut::INT) OVER (PARTITION BY series_id ORDER BY t) AS BIGINT) AS regime FROM b",
)
def _(spark, sf):
    p = with_position(P.monthly(spark, sf))
    breaks = p.where(F.month("ts").isin(3, 10)).select("series_id", F.col("t").alias("breakpoint"))
    return regimes.label_regimes(p, breaks).select("series_id", day("ts").alias("d"), "regime")
