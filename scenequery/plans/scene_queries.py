"""Operators on scenes, matches, tracks, views and frames as registered queries.

order = landmark or track, supplier = view, line = observation; embeddings = points seen by the cameras of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequery.functions import linear as L
from scenequery.operators import frusta, graph, matching, ordered, pairs, scenes, stats, tracks, views
from scenequery.plans.catalog import COVIS, TRACKS, covisibility, query, retrieval_topn, t, track_table
from scenequery.plans.catalog import SQL as CATALOG

# Observations: a point for each embedding, seen by five cameras along the first axis, with errors of some pixels.

_ERR = "((vec_id * 7 + view_id * 3) % 11 - 5) * 0.4"
OBS = f"o AS (SELECT vec_id AS landmark_id, CAST(view_id AS BIGINT) AS view_id, CAST(embedding[1] AS DOUBLE) * 4 AS px, CAST(embedding[2] AS DOUBLE) * 4 AS py, CAST(embedding[3] AS DOUBLE) * 4 + 2 AS pz, view_id * 0.5e0 - 1 AS cx, CAST({_ERR} AS DOUBLE) AS ex, CAST((vec_id + view_id) % 3 AS DOUBLE) AS scale FROM embeddings, generate_series(0, 4) g(view_id) WHERE (vec_id + view_id) % 6 <> 0), d AS (SELECT *, sqrt((px - cx) * (px - cx) + py * py + pz * pz) AS far FROM o)"


def _obs(spark, d):
    v, i = F.get("embedding", F.lit(0)).cast("double") * 4, F.col("vec_id")
    x = t(spark, d, "embeddings").select("vec_id", v.alias("px"), (F.get("embedding", F.lit(1)).cast("double") * 4).alias("py"), (F.get("embedding", F.lit(2)).cast("double") * 4 + 2).alias("pz"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("view_id"))
    x = x.filter((i + F.col("view_id")) % 6 != 0)
    x = x.withColumns({"cx": F.col("view_id") * 0.5 - 1, "ex": ((i * 7 + F.col("view_id") * 3) % 11 - 5) * 0.4, "scale": ((i + F.col("view_id")) % 3).cast("double")})
    return x.withColumnRenamed("vec_id", "landmark_id")


def _rays(spark, d):
    x = _obs(spark, d)
    v = L.unit((F.col("px") - F.col("cx"), F.col("py"), F.col("pz")))
    return x.select("landmark_id", "view_id", *[c.alias(n) for c, n in zip(v, "xyz")])


@query(f"WITH {OBS}, k AS (SELECT * FROM o WHERE pz >= 0 AND CASE WHEN scale > 0 THEN abs(ex) / scale ELSE abs(ex) END <= 1.3) SELECT landmark_id, view_id FROM k WHERE landmark_id IN (SELECT landmark_id FROM k GROUP BY 1 HAVING count(*) >= 3)")
def pixel_outliers(spark, d):
    return scenes.pixel_outliers(_obs(spark, d), F.abs("ex"), F.col("pz"), 1.3, 3, F.col("scale")).select("landmark_id", "view_id")


@query(f"WITH {OBS}, p AS (SELECT a.landmark_id, min(((a.px - a.cx) * (b.px - b.cx) + a.py * b.py + a.pz * b.pz) / a.far / b.far) AS c FROM d a JOIN d b USING (landmark_id) GROUP BY 1) SELECT landmark_id FROM p WHERE c >= cos(radians(30))")
def angle_outliers(spark, d):
    return scenes.angle_outliers(_rays(spark, d), 30.0)


@query(f"WITH {OBS}, p AS (SELECT a.view_id AS i, b.view_id AS j, degrees(acos(greatest(-1 + 1e-8, least(1 - 1e-8, ((a.px - a.cx) * (b.px - b.cx) + a.py * b.py + a.pz * b.pz) / a.far / b.far)))) AS angle FROM d a JOIN d b USING (landmark_id) WHERE a.view_id <> b.view_id), n AS (SELECT i, j, count(*) AS n FROM p WHERE angle BETWEEN 5 AND 40 GROUP BY 1, 2 HAVING count(*) > 20) SELECT i, j, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS rank FROM n) WHERE rank <= 3")
def nearest_cameras(spark, d):
    return scenes.nearest_cameras(_rays(spark, d), 3, 5.0, 40.0).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {OBS}, p AS (SELECT a.view_id AS i, a.landmark_id % 4 AS tile, b.view_id AS j, degrees(acos(greatest(-1 + 1e-8, least(1 - 1e-8, ((a.px - a.cx) * (b.px - b.cx) + a.py * b.py + a.pz * b.pz) / a.far / b.far)))) AS x FROM d a JOIN d b USING (landmark_id) WHERE a.view_id <> b.view_id), s AS (SELECT i, tile, j, sum(CASE WHEN x > 1 AND x <= 10 THEN (x - 1) / 9 WHEN x > 10 AND x <= 50 THEN 1 WHEN x > 50 AND x <= 150 THEN 1 - (x - 50) / 100 ELSE 0 END) AS score FROM p GROUP BY ALL HAVING score > 0) SELECT i, tile, j, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY i, tile ORDER BY score DESC, j) AS k FROM s) WHERE k <= 2")
def tile_cameras(spark, d):
    rays = _rays(spark, d)
    inside = rays.select("view_id", "landmark_id", (F.col("landmark_id") % 4).alias("tile"))
    return scenes.tile_cameras(rays, inside, 2).select("i", "tile", "j", F.round("score", 4).alias("score"))


@query(f"WITH {OBS} SELECT landmark_id FROM o GROUP BY 1 HAVING min(pz) >= 0")
def in_front_of_all(spark, d):
    return scenes.all_in_front(_obs(spark, d), F.col("pz"))


_BOX = "count(*) AS n, min({0}) AS least, max({0}) AS most, round(avg({0}), 6) AS mean, min({0}) FILTER (k = n // 4) AS first_quartile, min({0}) FILTER (k = n // 2) AS median, min({0}) FILTER (k = n * 3 // 4) AS third_quartile"


def _box(by: str, v: str, source: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"WITH {source} SELECT {by + ', ' if by else ''}{_BOX.format(v)} FROM (SELECT {by + ', ' if by else ''}{v}, row_number() OVER ({part} ORDER BY {v}) - 1 AS k, count(*) OVER ({part}) AS n FROM src) {'GROUP BY ' + by if by else ''}"


def _mean(df):
    return df.withColumn("mean", F.round("mean", 6))


@query(_box("", "residual", f"{OBS}, src AS (SELECT abs(ex) AS residual FROM o)"))
def residual_stats(spark, d):
    return _mean(scenes.residual_histogram(_obs(spark, d).select(F.abs("ex").alias("residual")))[0])


@query(f"WITH {OBS}, r AS (SELECT abs(ex) AS residual FROM o), m AS (SELECT ceil(max(residual)) AS e FROM r) SELECT CAST(CASE WHEN residual = e THEN 2 * e - 1 ELSE floor(residual / e * (2 * e)) END AS INTEGER) AS bin, count(*) AS n FROM r, m GROUP BY 1")
def residual_bins(spark, d):
    return scenes.residual_histogram(_obs(spark, d).select(F.abs("ex").alias("residual")))[1]


@query(_box("view_id", "residual", f"{OBS}, src AS (SELECT view_id, abs(ex) AS residual FROM o)"))
def residuals_per_view(spark, d):
    return _mean(stats.box(_obs(spark, d).select("view_id", F.abs("ex").alias("residual")), ["view_id"], "residual"))


@query(_box("view_id", "length", f"{OBS}, l AS (SELECT landmark_id, count(*) AS length FROM o GROUP BY 1), src AS (SELECT view_id, length FROM o JOIN l USING (landmark_id))"))
def lengths_per_view(spark, d):
    return _mean(scenes.lengths_per_view(_obs(spark, d)))


@query(_box("", "length", "src AS (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1)"))
def observation_lengths(spark, d):
    x = scenes.lengths(t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "landmark_id"))
    return _mean(stats.box(x, [], "length"))


@query(_box("", "n_seen", "src AS (SELECT l_suppkey, count(*) AS n_seen FROM lineitem GROUP BY 1)"))
def landmarks_per_view_stats(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_seen"))
    return _mean(stats.box(x, [], "n_seen"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS deviation, min(l_extendedprice) FILTER (k = n // 2) AS median, min(l_extendedprice) FILTER (k = CAST(floor(n * 0.9) AS BIGINT)) AS last_decile, max(l_extendedprice) AS most FROM c GROUP BY 1")
def scale_summary(spark, d):
    x = stats.summary(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return x.withColumns({"mean": F.round("mean", 3), "deviation": F.round("deviation", 3)})


@query("SELECT user_id, median(value) AS median FROM events GROUP BY user_id")
def user_medians(spark, d):
    return stats.median(t(spark, d, "events"), ["user_id"], "value")


@query("SELECT user_id, round(avg(value), 6) AS mean, round(avg(value * value) - avg(value) * avg(value), 4) AS variance FROM events GROUP BY user_id")
def user_moments(spark, d):
    m = stats.moments(t(spark, d, "events"), ["user_id"], F.col("value"))
    return m.select("user_id", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT s_suppkey AS view, coalesce(f.n, 0) AS n_features, coalesce(k.n, 0) AS n_tracks FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) f ON f.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) k ON k.l_suppkey = s_suppkey")
def features_and_tracks(spark, d):
    x = track_table(spark, d)
    return scenes.features_and_tracks(t(spark, d, "supplier").select(F.col("s_suppkey").alias("view")), x, x)


POINTS = "p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _points(spark, d):
    return t(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])


@query(f"WITH {POINTS} SELECT min(x) AS least_x, min(y) AS least_y, min(z) AS least_z, max(x) AS most_x, max(y) AS most_y, max(z) AS most_z FROM p")
def bounding_box(spark, d):
    return scenes.bounding_box(_points(spark, d))


@query(f"WITH {POINTS}, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p) SELECT any_value(n) AS n, round(any_value(mx), 6) AS mean_x, round(any_value(my), 6) AS mean_y, round(any_value(mz), 6) AS mean_z, round(sum((x - mx) * (x - mx)), 4) AS scatter_xx, round(sum((x - mx) * (y - my)), 4) AS scatter_xy, round(sum((x - mx) * (z - mz)), 4) AS scatter_xz, round(sum((y - my) * (y - my)), 4) AS scatter_yy, round(sum((y - my) * (z - mz)), 4) AS scatter_yz, round(sum((z - mz) * (z - mz)), 4) AS scatter_zz FROM p, m")
def centre_scatter(spark, d):
    x = scenes.centres(_points(spark, d))
    return x.select("n", *[F.round(c, 6).alias(c) for c in x.columns[1:4]], *[F.round(c, 4).alias(c) for c in x.columns[4:]])


_QUANTILES = ", ".join(f"(SELECT {c} FROM p ORDER BY {c} LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * {s}) AS BIGINT) FROM p)) AS {n}{c}" for c in "xyz" for n, s in (("l", 0.02), ("h", 0.98)))


@query(f"WITH {POINTS}, q AS (SELECT {_QUANTILES}) SELECT " + ", ".join(f"round(l{c} - (h{c} - l{c}) * 0.05, 9) AS least_{c}, round(h{c} + (h{c} - l{c}) * 0.05, 9) AS most_{c}" for c in "xyz") + " FROM q")
def robust_box(spark, d):
    x = scenes.robust_box(_points(spark, d), 0.02)
    return x.select(*[F.round(c, 9).alias(c) for c in x.columns])


@query("SELECT x AS exposure FROM (SELECT DISTINCT p_retailprice AS x FROM part WHERE p_retailprice > 0) ORDER BY x LIMIT 1 OFFSET (SELECT count(DISTINCT p_retailprice) FILTER (p_retailprice > 0) // 2 FROM part)")
def median_exposure(spark, d):
    return scenes.median_exposure(t(spark, d, "part"), "p_retailprice")


@query(f"WITH {POINTS.replace('SELECT CAST', 'SELECT vec_id, CAST', 1)}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p) SELECT vec_id AS view_id FROM p, m ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), vec_id LIMIT 1")
def central_view(spark, d):
    return views.central_view(_points(spark, d).withColumnRenamed("vec_id", "view_id"))


@query("SELECT min(page_id) AS view_id FROM pages WHERE regexp_full_match(url, 'https://.*/de/.*')")
def view_by_path(spark, d):
    return views.view_by(t(spark, d, "pages").select(F.col("page_id").alias("view_id"), F.col("url").alias("path")), "https://.*/de/.*")


# Views, poses, intrinsics: orders as views, customers as poses, parts as intrinsics.

_VIEWS = "v AS (SELECT o_orderkey AS view_id, o_custkey AS pose_id, o_orderkey % 900 AS intrinsic_id FROM orders), ok AS (SELECT * FROM v WHERE pose_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND intrinsic_id IN (SELECT p_partkey FROM part WHERE p_size > 25))"


def _views(spark, d):
    v = t(spark, d, "orders").select(F.col("o_orderkey").alias("view_id"), F.col("o_custkey").alias("pose_id"), (F.col("o_orderkey") % 900).alias("intrinsic_id"))
    return v, t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("pose_id")), t(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("intrinsic_id"))


@query(f"WITH {_VIEWS} SELECT view_id FROM ok")
def valid_views(spark, d):
    return scenes.valid_views(*_views(spark, d)).select("view_id")


@query(f"WITH {_VIEWS} SELECT DISTINCT intrinsic_id FROM ok")
def reconstructed_intrinsics(spark, d):
    return scenes.reconstructed_intrinsics(*_views(spark, d))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def referenced_pairs(spark, d):
    keys = t(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    return scenes.referenced(t(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], keys).select("l_orderkey", "l_linenumber")


@query("WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), k AS (SELECT * FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM gone)) SELECT l_orderkey AS landmark_id, l_linenumber FROM k WHERE l_orderkey IN (SELECT l_orderkey FROM k GROUP BY 1 HAVING count(*) >= 3)")
def missing_poses(spark, d):
    s = t(spark, d, "supplier")
    v = s.select(F.col("s_suppkey").alias("view_id"), F.col("s_suppkey").alias("pose_id"))
    o = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("landmark_id"), "l_linenumber", F.col("l_suppkey").alias("view_id"))
    return scenes.without_poses(v, o, s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("pose_id")), 3).select("landmark_id", "l_linenumber")


@query(f"WITH {TRACKS}, done AS (SELECT s_suppkey AS view, s_suppkey % 9 = 1 AS new FROM supplier WHERE s_suppkey % 3 = 1), s AS (SELECT DISTINCT track, view FROM tracks JOIN done USING (view) WHERE track IN (SELECT track FROM tracks JOIN done USING (view) WHERE new)) SELECT track, view FROM s WHERE track IN (SELECT track FROM s GROUP BY 1 HAVING count(*) >= 3)")
def tracks_to_triangulate(spark, d):
    v = t(spark, d, "supplier").select(F.col("s_suppkey").alias("view")).filter("view % 3 = 1")
    return scenes.tracks_to_triangulate(track_table(spark, d), v.filter("view % 9 != 1"), v.filter("view % 9 = 1"), 3)


@query("SELECT l_partkey AS feat_id, l_suppkey AS view_id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE (l_suppkey, l_partkey) IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def observed_features(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_partkey").alias("feat_id"), F.col("l_suppkey").alias("view_id"), "l_returnflag")
    return scenes.observed_features(x.select("feat_id", "view_id").distinct(), x.filter("l_returnflag = 'A'")).select("feat_id", "view_id")


@query("SELECT o_orderkey AS view_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def unknown_views(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("view_id"))
    known = t(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("view_id"))
    return scenes.sanity_of_landmarks(o, known).select(F.col("id").alias("view_id"))


@query("WITH m AS (SELECT CASE l_returnflag WHEN 'A' THEN 'cctag3' WHEN 'N' THEN 'sift' ELSE 'tag16h5' END AS kind, l_partkey % 3000 + 700 * (l_linenumber % 2) AS marker, l_orderkey * 8 + l_linenumber AS landmark_id FROM lineitem) SELECT kind, marker, min(landmark_id) AS landmark_id FROM m WHERE kind <> 'sift' GROUP BY 1, 2 HAVING count(*) = 1")
def unique_markers(spark, d):
    x = t(spark, d, "lineitem").select(F.expr("CASE l_returnflag WHEN 'A' THEN 'cctag3' WHEN 'N' THEN 'sift' ELSE 'tag16h5' END").alias("kind"), (F.col("l_partkey") % 3000 + 700 * (F.col("l_linenumber") % 2)).alias("marker"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("landmark_id"))
    return scenes.unique_markers(x, list(matching.MARKERS))


@query("WITH l AS (SELECT o_orderkey AS landmark_id, min((l_suppkey, l_linenumber)) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1), f AS (SELECT f[1] AS view, f[2] AS feat, min(landmark_id) AS landmark_id FROM l GROUP BY 1, 2) SELECT l_partkey AS track, arg_min(landmark_id, (l_suppkey, landmark_id)) AS landmark_id FROM lineitem JOIN f ON l_suppkey = view AND l_linenumber = feat GROUP BY 1")
def remapped_landmarks(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("view"), F.col("l_linenumber").alias("feat"))
    o = t(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    landmarks = x.join(o, "l_orderkey").select(F.col("l_orderkey").alias("landmark_id"), "view", "feat")
    return scenes.remapped(landmarks, x.select(F.col("l_partkey").alias("track"), "view", "feat"))


# Matches.

M = "m AS (SELECT l_suppkey AS i, l_partkey % 40 AS j, CASE l_returnflag WHEN 'A' THEN 'sift' WHEN 'N' THEN 'akaze' ELSE 'cctag3' END AS kind, l_orderkey AS fi, l_linenumber AS fj, l_quantity * 20 AS xi, l_extendedprice % 900 AS yi, l_discount * 10 AS si, l_quantity * 20 + l_tax * 100 AS xj, l_extendedprice % 900 + l_discount * 60 AS yj, l_tax * 10 AS sj FROM lineitem)"


def _matches(spark, d):
    c = F.col
    return t(spark, d, "lineitem").select(
        c("l_suppkey").alias("i"), (c("l_partkey") % 40).alias("j"), F.expr("CASE l_returnflag WHEN 'A' THEN 'sift' WHEN 'N' THEN 'akaze' ELSE 'cctag3' END").alias("kind"), c("l_orderkey").alias("fi"), c("l_linenumber").alias("fj"),
        (c("l_quantity") * 20).alias("xi"), (c("l_extendedprice") % 900).alias("yi"), (c("l_discount") * 10).alias("si"), (c("l_quantity") * 20 + c("l_tax") * 100).alias("xj"), (c("l_extendedprice") % 900 + c("l_discount") * 60).alias("yj"), (c("l_tax") * 10).alias("sj"),
    )


@query(f"WITH {M} SELECT i, j, fi, fj FROM m WHERE kind IN ('sift', 'cctag3')")
def matches_by_kind(spark, d):
    return matching.by_kind(_matches(spark, d), ["sift", "cctag3"]).select("i", "j", "fi", "fj")


@query(f"WITH {M} SELECT i, j, fi, fj FROM m WHERE sqrt((xi - xj) * (xi - xj) + (yi - yj) * (yi - yj)) >= 0.3 * pow(2, greatest(si, sj))")
def moving_matches(spark, d):
    return matching.moving(_matches(spark, d), 0.3).select("i", "j", "fi", "fj")


@query(f"WITH {M} SELECT i, j, fi, fj, rank FROM (SELECT *, row_number() OVER (PARTITION BY i, j, kind ORDER BY (si + sj) / 2 DESC, fi, fj) AS rank FROM m)")
def matches_by_scale(spark, d):
    return matching.by_scale(_matches(spark, d), ["i", "j", "kind"]).select("i", "j", "fi", "fj", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {M} SELECT i, j, fi, fj, rank FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY si, fi, fj) AS rank FROM m)")
def matches_by_ratio(spark, d):
    return matching.by_ratio(_matches(spark, d).withColumn("ratio", F.col("si")), ["i", "j"]).select("i", "j", "fi", "fj", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {M} SELECT i, xi, xj, min(fi * 8 + fj) AS first FROM m GROUP BY i, xi, xj")
def distinct_coordinates(spark, d):
    return matching.distinct_coordinates(_matches(spark, d), ["i", "xi", "xj"], ["fi", "fj"]).select("i", "xi", "xj", (F.col("fi") * 8 + F.col("fj")).alias("first"))


@query()
def spread_matches(spark, d):
    """The order over the cells of both images is made one match after another."""
    x = _matches(spark, d).withColumns({n: F.lit(1000) for n in ("wi", "hi", "wj", "hj")})
    return matching.spread(x, 20)


@query(f"WITH {M} SELECT i, j, count(*) AS n FROM m GROUP BY i, j")
def matches_per_pair(spark, d):
    return _matches(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {M} SELECT DISTINCT i, j FROM m")
def match_pairs(spark, d):
    return _matches(spark, d).select("i", "j").distinct()


@query(f"WITH {M} SELECT a.i, b.i AS other, a.kind FROM (SELECT DISTINCT i, kind FROM m) a JOIN (SELECT DISTINCT i, kind FROM m) b ON a.kind = b.kind AND a.i < b.i WHERE a.i < 5")
def common_kinds(spark, d):
    x = _matches(spark, d).select("i", "kind").distinct()
    return x.filter("i < 5").join(x.select(F.col("i").alias("other"), "kind"), "kind").filter("i < other").select("i", "other", "kind")


_GUIDE = "l AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity * 20 + l_partkey % 20 AS x, (l_extendedprice * 7) % 900 AS y FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT o_orderkey AS id, o_totalprice % 1000 AS x, o_custkey % 900 AS y FROM orders)"


def _guide(spark, d):
    li, o = t(spark, d, "lineitem").filter("l_returnflag = 'A'"), t(spark, d, "orders")
    left = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 20 + F.col("l_partkey") % 20).alias("x"), ((F.col("l_extendedprice") * 7) % 900).alias("y"))
    return left, o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 1000).alias("x"), (F.col("o_custkey") % 900).cast("double").alias("y"))


@query(f"WITH {_GUIDE}, h AS (SELECT id AS i, (0.9e0 * x + 0.1e0 * y + 20) / (0.0001e0 * x + 1) AS u, (-0.05e0 * x + 0.95e0 * y + 10) / (0.0001e0 * x + 1) AS v FROM l), e AS (SELECT i, id AS j, sqrt((u - x) * (u - x) + (v - y) * (v - y)) AS error FROM h JOIN r ON r.x BETWEEN u - 4 AND u + 4) SELECT i, j, round(error, 5) AS error FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY error, j) AS k FROM e WHERE error < 4) WHERE k = 1")
def guided_matches(spark, d):
    return matching.guided(*_guide(spark, d), [0.9, 0.1, 20.0, -0.05, 0.95, 10.0, 0.0001, 0.0, 1.0], 4.0).withColumn("error", F.round("error", 5))


@query("SELECT a.l_orderkey AS i, b.l_orderkey AS j FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N') b USING (l_partkey) WHERE a.l_orderkey = b.l_orderkey")
def intersected_matches(spark, d):
    x = t(spark, d, "lineitem")
    one = lambda f: x.filter(F.col("l_returnflag") == f).select("l_orderkey", "l_partkey")
    return matching.intersection(one("A"), one("N")).select(F.col("l_orderkey").alias("i"), F.col("l_orderkey").alias("j"))


_CODES = "c AS (SELECT p_partkey AS id, p_partkey * 2654435761 % 65536 AS a, p_partkey * 40503 % 65536 AS b FROM part)"


@query(f"WITH {_CODES}, n AS (SELECT q.id AS i, x.id AS j, CAST(bit_count(xor(q.a, x.a)) + bit_count(xor(q.b, x.b)) AS DOUBLE) AS d2 FROM c q JOIN c x ON true WHERE q.id % 20 = 0) SELECT i, j, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM n) WHERE rank <= 3")
def knn_binary(spark, d):
    k = F.col("p_partkey")
    x = t(spark, d, "part").select(k.alias("id"), F.array(k * 2654435761 % 65536, k * 40503 % 65536).alias("vec"))
    return matching.knn_binary(x.filter("id % 20 = 0"), x, 3).withColumn("rank", F.col("rank").cast("long"))


@query()
def knn_hashed(spark, d):
    """Approximate neighbours by cascaded hashes; see its test for the share of true ones."""
    x = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return matching.knn_hashed(x.filter("id % 20 = 0"), x, 2)


# Pairs.

_FOUND = CATALOG["retrieval_topn"]


@query(f"WITH r AS ({_FOUND}), x AS (SELECT query, doc FROM r WHERE query <> doc), u AS (SELECT query AS i, doc AS j FROM x WHERE doc > query), w AS (SELECT query AS i, doc AS j FROM x WHERE doc < query AND doc IN (SELECT query FROM x) AND (doc, query) NOT IN (SELECT i, j FROM u)) SELECT i, j FROM u UNION ALL SELECT i, j FROM w")
def pair_list(spark, d):
    return pairs.pair_list(retrieval_topn(spark, d), 0)


@query("SELECT c_custkey AS view_id FROM customer INTERSECT SELECT p_partkey FROM part")
def common_views(spark, d):
    return scenes.common_views(t(spark, d, "customer").select(F.col("c_custkey").alias("view_id")), t(spark, d, "part").select(F.col("p_partkey").alias("view_id")))


# Tracks.


@query(f"WITH {TRACKS}, k AS (SELECT track FROM tracks WHERE view IN (3, 7) GROUP BY track HAVING count(DISTINCT view) = 2) SELECT track, view, feat FROM tracks WHERE view IN (3, 7) AND track IN (SELECT track FROM k)")
def tracks_common_items(spark, d):
    return tracks.common_items(track_table(spark, d), [3, 7])


@query(f"WITH {TRACKS} SELECT track, feat FROM tracks WHERE view = 3 AND track IN (SELECT track FROM tracks WHERE view = 7)")
def features_in_view(spark, d):
    x = track_table(spark, d)
    return tracks.features_of(x, x.filter("view = 7").select("track").distinct(), 3).select("track", "feat")


@query(f"WITH {TRACKS} SELECT a.track, a.feat AS fi, b.feat AS fj FROM tracks a JOIN tracks b USING (track) WHERE a.view = 3 AND b.view = 7")
def two_view_matches(spark, d):
    return tracks.two_view_matches(track_table(spark, d), 3, 7)


@query(f"WITH {TRACKS} SELECT count(DISTINCT track) AS n, count(DISTINCT view) AS n_views FROM tracks")
def track_counts(spark, d):
    x = track_table(spark, d)
    return tracks.count(x).crossJoin(tracks.views_of(x).agg(F.count(F.lit(1)).alias("n_views")))


@query()
def tracks_build(spark, d):
    """Tracks built from matches over all of lineitem: sizes, how many there are of each, and the views that they see; held against brute force in its test."""
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("j"), F.lit("sift").alias("kind"), F.col("l_orderkey").alias("fi"), (F.col("l_orderkey") % 5000).alias("fj"))
    per = tracks.build(x).select("track", "view").repartition("track")  # dealt out once for both counts
    per = per.groupBy("track").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("view").alias("v"))
    return per.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("views"))


# Graphs.


@query(f"WITH {COVIS}, n AS (SELECT i AS view, j AS other, n FROM covis UNION ALL SELECT j, i, n FROM covis), r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY n DESC, other) AS k FROM n WHERE view % 10 = 3) SELECT DISTINCT least(view, other) AS i, greatest(view, other) AS j FROM r WHERE k <= 10 OR n >= 60")
def local_edges(spark, d):
    new = t(spark, d, "supplier").select(F.col("s_suppkey").alias("view")).filter("view % 10 = 3")
    return graph.local_edges(covisibility(spark, d), new, 60)


@query(f"WITH {COVIS}, n AS (SELECT i AS view, j AS other, n FROM covis UNION ALL SELECT j, i, n FROM covis) SELECT view, other, n FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY n DESC, other DESC) AS k FROM n) WHERE k <= 4 OR n >= 70")
def strong_links(spark, d):
    return graph.strong_links(covisibility(spark, d), 70, 4)


@query()
def spanning_forest(spark, d):
    """A maximum spanning forest of the views by shared tracks; held against brute force in its test."""
    return graph.spanning_forest(covisibility(spark, d).withColumnRenamed("n", "weight"))


@query()
def without_bridges(spark, d):
    """Vertices of the largest component without bridges, of a ring of customers with loose ends; held against brute force in its test."""
    c = F.col("c_custkey")
    return graph.without_bridges(t(spark, d, "customer").select((c % 200).alias("i"), F.explode(F.array(200 + c % 190, 1000 + c)).alias("j")))


@query("WITH s AS (SELECT s_suppkey AS v, s_suppkey % 6 - 1 AS distance FROM supplier) SELECT v, distance, CASE WHEN distance BETWEEN 0 AND 2 THEN 'refined' WHEN distance = 3 THEN 'constant' ELSE 'ignored' END AS state FROM s")
def graph_states(spark, d):
    return graph.states(t(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), (F.col("s_suppkey") % 6 - 1).alias("distance")), 2)


# Choosing views, images, frames.

_CONN = "k AS (SELECT s_suppkey AS view, CAST(s_acctbal AS BIGINT) % 97 AS n, CAST(s_acctbal * 3 AS BIGINT) % 1009 AS score, s_nationkey % 5 <> 0 AS known FROM supplier)"


def _connected(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("view"), (F.round("s_acctbal").cast("long") % 97).alias("n"), (F.round(F.col("s_acctbal") * 3).cast("long") % 1009).alias("score"), (F.col("s_nationkey") % 5 != 0).alias("known"))


_CONN = _CONN.replace("CAST(s_acctbal AS BIGINT)", "CAST(round(s_acctbal) AS BIGINT)").replace("CAST(s_acctbal * 3 AS BIGINT)", "CAST(round(s_acctbal * 3) AS BIGINT)")


@query(f"WITH {_CONN}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, view) AS rank FROM k), s AS (SELECT *, max(CASE WHEN rank > 1 AND NOT (n > 10 AND score > 300) THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS stop, coalesce(max(CASE WHEN rank > 1 AND NOT known THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM r) SELECT view, rank FROM s WHERE stop = 0 AND new = 0 AND rank <= 12")
def next_views(spark, d):
    return views.next_views(_connected(spark, d), 300, 10, most=12).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_CONN}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, view) AS k FROM k WHERE n > 0) SELECT view, row_number() OVER (ORDER BY k) AS rank FROM r WHERE k = 1 OR n >= 40 QUALIFY row_number() OVER (ORDER BY k) <= 8")
def expansion_views(spark, d):
    return views.expansion(_connected(spark, d), 40, 8).withColumn("rank", F.col("rank").cast("long"))




@query("WITH c AS (SELECT l_suppkey AS image, (l_partkey * 7 + l_linenumber) % 49 AS cell FROM lineitem) SELECT g.cell, count(DISTINCT image) AS weight FROM generate_series(0, 48) g(cell) LEFT JOIN c USING (cell) GROUP BY 1")
def cell_weights(spark, d):
    return views.cell_weights(_cells(spark, d), None, 7)


def _cells(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 49).alias("cell"))


@query()
def best_images(spark, d):
    """Chosen one by one; held against brute force in its test."""
    return views.best_images(_cells(spark, d).filter("cell % 5 < image % 5 + 1"), 4, 7)


@query("WITH n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), s AS (SELECT *, greatest(1, CASE WHEN n // 20 > 5 THEN least(n // 20 + 1, 8) ELSE 5 END) AS step FROM n) SELECT event_id FROM s WHERE k % step = 0 AND k / step < 20")
def frames_regular(spark, d):
    return views.regular_frames(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 2, 8, 20).select("event_id")


@query("SELECT event_id, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY k), '') AS recent FROM (SELECT e.event_id, f.event_id AS p, f.k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) f ON e.user_id = f.user_id AND f.k BETWEEN e.k - 3 AND e.k - 1) GROUP BY event_id")
def frame_buffer(spark, d):
    x = views.last_frames(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3, "event_id")
    return x.select("event_id", F.array_join(F.transform("recent", lambda v: v.cast("string")), ",").alias("recent"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor((k - 1) / 3) AS BIGINT) ORDER BY k) - 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)) WHERE p = 1")
def bracket_targets(spark, d):
    x = ordered.fixed_brackets(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3)
    return views.target_views(x, ["user_id", "bracket"], ["ts", "event_id"], 3).select("event_id")


@query("WITH a AS (SELECT p_partkey, [p_size % 3, p_size % 5, p_size % 7, p_size % 3, p_size % 5] AS large, [p_size % 3, p_size % 5] AS small FROM part) SELECT p_partkey, CASE WHEN large[1:2] = small THEN 0 WHEN large[2:3] = small THEN 1 WHEN large[3:4] = small THEN 2 ELSE -1 END AS at FROM a")
def sub_sequences(spark, d):
    s = F.col("p_size")
    large = F.array(s % 3, s % 5, s % 7, s % 3, s % 5)
    return t(spark, d, "part").select("p_partkey", views.index_of(F.array(s % 3, s % 5), large).alias("at"))


@query("SELECT i, j, n, round(angle, 5) AS angle, round(score, 3) AS score FROM (SELECT l_suppkey AS i, l_partkey % 30 AS j, count(*) AS n, median(l_quantity) AS angle, sum(l_discount) * median(l_quantity) AS score FROM lineitem GROUP BY 1, 2 HAVING count(*) > 12 AND median(l_quantity) BETWEEN 20 AND 30)")
def initial_pairs(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 30).alias("j"), F.col("l_quantity").alias("angle"), F.col("l_discount").alias("weight"))
    return views.initial_pairs(x, 12, 20, 30).withColumns({"angle": F.round("angle", 5), "score": F.round("score", 3)})


# Points.


@query("SELECT p_partkey FROM part WHERE p_size - 5 <> -1")
def valid_points(spark, d):
    return scenes.valid_points(t(spark, d, "part").withColumn("pix_size", F.col("p_size") - 5)).select("p_partkey")


_CLOUD = "c AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 9 AS x, CAST(embedding[2] AS DOUBLE) * 9 AS y, CAST(embedding[3] AS DOUBLE) * 9 AS z, 0.1e0 + vec_id % 13 * 0.05e0 AS pix_size, 0.5e0 + vec_id % 7 * 0.1e0 AS sim FROM embeddings)"


@query(f"WITH {_CLOUD} SELECT id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.id <> a.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 2 * a.sim * a.pix_size * a.pix_size AND (b.pix_size * b.sim < a.pix_size * a.sim OR (b.pix_size * b.sim = a.pix_size * a.sim AND b.id < a.id)))")
def rival_points(spark, d):
    x = _points(spark, d).select(F.col("vec_id").alias("id"), *[(F.col(c) * 9).alias(c) for c in "xyz"])
    return scenes.rival_points(x.withColumns({"pix_size": 0.1 + F.col("id") % 13 * 0.05, "sim": 0.5 + F.col("id") % 7 * 0.1}), 2.0).select("id")


@query("WITH e AS (SELECT vec_id, " + ", ".join(f"sqrt(list_sum(list_transform(list_zip(embedding[{a}:{a + 2}], embedding[{b}:{b + 2}]), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS e{a}" for a, b in ((1, 4), (4, 7), (7, 1))) + " FROM embeddings) SELECT vec_id FROM e WHERE greatest(e1, e4, e7) <= 1.2 * (SELECT avg((e1 + e4 + e7) / 3) FROM e)")
def small_triangles(spark, d):
    v = [F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(f"{p}{c}" for p in "abc" for c in "xyz")]
    return scenes.small_triangles(t(spark, d, "embeddings").select("vec_id", *v), 1.2).select("vec_id")




@query()
def frustum_pairs(spark, d):
    """Views on a helix, some of them turned about, whose frusta meet; held against points in its test."""
    a = F.col("s_suppkey") * 0.7
    turn = F.when(F.col("s_suppkey") % 3 == 0, a).otherwise(a + 3.141592653589793)
    c, n, o = F.cos(turn), F.sin(turn), F.lit(0.0)
    v = t(spark, d, "supplier").select(F.col("s_suppkey").alias("view_id"), F.array(n, o, -c, o, F.lit(1.0), o, c, o, n).alias("rotation"), F.array(F.cos(a) * 9, F.col("s_suppkey") * 0.05, F.sin(a) * 9).alias("center"), *[F.lit(x).alias(k) for k, x in (("f", 1000.0), ("px", 500.0), ("py", 400.0), ("width", 1000.0), ("height", 800.0), ("near", 0.1), ("far", 8.0))])
    return frusta.pairs(frusta.frusta(v, 100.0))


@query()
def area_scores(spark, d):
    """How much of their images matched points span, by convex hulls; held against brute force in its test."""
    return scenes.area_score(_matches(spark, d), ["i", "j"], (1000.0 * 900, 1000.0 * 900))
