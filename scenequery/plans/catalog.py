"""The operators applied to the driver tables, each with SQL that gives the same rows.

Analogies: order = track, supplier = view, line number = feature; embeddings =
descriptors; events = frames; words of documents = visual words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenequery.functions import camera as C
from scenequery.functions import colour, scalars
from scenequery.operators import graph, kernels, matching, ordered, pairs, retrieval, scenes, sensors, setops, sparse, stats, tracks, views
from scenequery.streaming import frames

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def track_table(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_suppkey").alias("view"), F.col("l_linenumber").alias("feat"))


TRACKS = "tracks AS (SELECT l_orderkey AS track, l_suppkey AS view, l_linenumber AS feat FROM lineitem)"


# Pairs


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def pairs_exhaustive(spark, d):
    return pairs.exhaustive(t(spark, d, "supplier"), "s_suppkey")


@query("WITH o AS (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 10) SELECT o.s_suppkey AS i, b.s_suppkey AS j FROM o JOIN supplier b ON o.s_suppkey < b.s_suppkey")
def pairs_exhaustive_range(spark, d):
    return pairs.exhaustive_range(t(spark, d, "supplier"), "s_suppkey", 10, 5)


@query("SELECT n_nationkey AS i, r_regionkey AS j FROM nation, region WHERE n_nationkey <> r_regionkey")
def pairs_cross(spark, d):
    return pairs.cross(t(spark, d, "nation"), "n_nationkey", t(spark, d, "region"), "r_regionkey")


SEQ = "w AS (SELECT p_partkey AS i, lead(p_partkey, 1) OVER x AS a, lead(p_partkey, 2) OVER x AS b FROM part WINDOW x AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)), p AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT i, a AS j FROM w UNION ALL SELECT i, b FROM w) WHERE j IS NOT NULL)"


@query(f"WITH {SEQ} SELECT i, j FROM p")
def pairs_sequential(spark, d):
    return pairs.sequential(t(spark, d, "part"), "p_partkey", "p_brand", ["p_name", "p_partkey"], 2)


@query(f"WITH {SEQ} SELECT i, i || ' ' || string_agg(CAST(j AS VARCHAR), ' ' ORDER BY j) AS line FROM p GROUP BY i")
def pairs_adjacency(spark, d):
    return pairs.adjacency(pairs_sequential(spark, d))


# Matches

D2 = "SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d2"
NEAR = f"near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM ({D2} FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id))"


def _vectors(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _near(spark, d) -> DataFrame:
    """Two nearest of all other embeddings, of those whose id is divisible by 20."""
    x = _vectors(spark, d)
    return matching.knn_others(x.filter("id % 20 = 0"), x, 2)


@query(f"WITH {NEAR} SELECT i, j, round(d2, 4) AS d2, rank FROM near WHERE rank <= 2 AND i % 20 = 0")
def knn2(spark, d):
    return _near(spark, d).select("i", "j", F.round("d2", 4).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {NEAR} SELECT a.i, a.j, round(a.d2, 4) AS d2 FROM near a JOIN near b ON a.i = b.i AND a.rank = 1 AND b.rank = 2 WHERE a.d2 < 0.96 * 0.96 * b.d2 AND a.i % 20 = 0")
def knn2_ratio(spark, d):
    return matching.ratio_test(_near(spark, d), 0.96).select("i", "j", F.round("d2", 4).alias("d2"))


@query(f"WITH {NEAR} SELECT a.i, a.j FROM near a JOIN near b ON a.j = b.i AND a.i = b.j WHERE a.rank = 1 AND b.rank = 1 AND a.i % 20 = 0")
def knn_mutual(spark, d):
    x = _vectors(spark, d)
    forth = matching.knn_others(x.filter("id % 20 = 0"), x, 1)
    ends = x.join(forth.select(F.col("j").alias("id")).distinct(), "id", "left_semi")
    return matching.mutual(forth, matching.knn_others(ends, x, 1))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def match_dedup(spark, d):
    return t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE n >= 10 AND k <= 3")
def top_matches_per_pair(spark, d):
    x = matching.top_matches(t(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 10, 3)
    return x.select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def matches_by_views(spark, d):
    keys = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("v"))
    return matching.by_views(t(spark, d, "lineitem"), keys, ("l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, count(*) AS n_before, count(*) FILTER (l_discount >= 0.05) AS n_after FROM lineitem GROUP BY l_suppkey HAVING n_after >= 5 AND n_after >= 0.5 * n_before")
def poor_overlap(spark, d):
    x = t(spark, d, "lineitem")
    return matching.poor_overlap(x, x.filter("l_discount >= 0.05"), ["l_suppkey"], 0.5, 5)


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(l_partkey / 100) AS BIGINT), CAST(floor(l_suppkey / 10) AS BIGINT) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 4")
def grid_topk(spark, d):
    cell = [F.floor(F.col("l_partkey") / 100), F.floor(F.col("l_suppkey") / 10)]
    return matching.grid_top(t(spark, d, "lineitem"), cell, [], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 4).select("l_orderkey", "l_linenumber")


KIND = "CASE l_returnflag WHEN 'A' THEN 'sift' WHEN 'N' THEN 'akaze' ELSE 'cctag3' END"


@query(f"WITH k AS (SELECT l_suppkey, l_partkey % 50 AS other, CASE {KIND} WHEN 'cctag3' THEN 1.0 ELSE 0.14 END AS w FROM lineitem) SELECT l_suppkey, other, round(CAST(sum(w) AS DOUBLE), 2) AS weight FROM k GROUP BY ALL HAVING sum(w) > 5")
def strong_support(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("other"), F.expr(KIND).alias("kind"))
    return matching.strong_support(x, ["l_suppkey", "other"], 5).withColumn("weight", F.round("weight", 2))


# Tracks


@query(f"WITH {TRACKS} SELECT track, count(DISTINCT view) AS length FROM (SELECT DISTINCT * FROM tracks) GROUP BY track HAVING count(*) = count(DISTINCT view) AND count(DISTINCT view) >= 3")
def tracks_filter_forks(spark, d):
    return tracks.filter_tracks(track_table(spark, d), 3)


@query(f"WITH {TRACKS} SELECT length, count(*) AS n FROM (SELECT count(DISTINCT view) AS length FROM tracks GROUP BY track) GROUP BY length")
def tracks_length_hist(spark, d):
    return tracks.length_histogram(track_table(spark, d))


@query(f"WITH {TRACKS} SELECT track FROM tracks WHERE view IN (3, 7) GROUP BY track HAVING count(DISTINCT view) = 2")
def tracks_common(spark, d):
    return tracks.common_tracks(track_table(spark, d), [3, 7])


@query(f"WITH {TRACKS} SELECT DISTINCT track FROM tracks WHERE view IN (3, 7)")
def tracks_any(spark, d):
    return tracks.any_tracks(track_table(spark, d), [3, 7])


@query(f"WITH {TRACKS} SELECT view, count(*) AS n, string_agg(CAST(track AS VARCHAR), ',' ORDER BY track) AS tracks FROM (SELECT DISTINCT view, track FROM tracks) GROUP BY view")
def tracks_per_view(spark, d):
    x = tracks.per_view(track_table(spark, d))
    return x.withColumn("tracks", F.array_join(F.transform("tracks", lambda v: v.cast("string")), ","))


COVIS = f"{TRACKS}, s AS (SELECT DISTINCT track, view FROM tracks), covis AS (SELECT a.view AS i, b.view AS j, count(*) AS n FROM s a JOIN s b ON a.track = b.track AND a.view < b.view GROUP BY 1, 2)"


@query(f"WITH {COVIS} SELECT i, j, n FROM covis")
def covisibility(spark, d):
    return tracks.covisibility(track_table(spark, d))


@query(f"WITH {COVIS} SELECT view, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY view ORDER BY n DESC, other) AS rank FROM (SELECT i AS view, j AS other, n FROM covis UNION ALL SELECT j, i, n FROM covis) WHERE n >= 2) WHERE rank <= 5")
def nearest_views(spark, d):
    return tracks.nearest_views(covisibility(spark, d), 5, 2)


# Graphs over pairs of suppliers

EDGES = "edges AS (SELECT DISTINCT least(p, s) AS i, greatest(p, s) AS j FROM (SELECT l_partkey % 400 AS p, l_suppkey + 400 * (l_partkey % 3) AS s FROM lineitem) WHERE p <> s), both_ways AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges)"


def _edges(spark, d) -> DataFrame:
    x = t(spark, d, "lineitem").select((F.col("l_partkey") % 400).alias("i"), (F.col("l_suppkey") + 400 * (F.col("l_partkey") % 3)).alias("j"))
    return pairs.canonical(x)


COMPONENTS = f"RECURSIVE {EDGES}, comp(v, component) USING KEY (v) AS (SELECT DISTINCT i, i FROM both_ways UNION SELECT b.i, min(c.component) FROM comp c JOIN both_ways b ON b.j = c.v JOIN recurring.comp o ON o.v = b.i WHERE c.component < o.component GROUP BY b.i)"


@query(f"WITH {COMPONENTS} SELECT v, component FROM comp")
def connected_components(spark, d):
    return graph.components(_edges(spark, d))


@query(f"WITH {COMPONENTS} SELECT v, component FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def largest_component(spark, d):
    return graph.largest_component(_edges(spark, d))


@query(f"WITH {COVIS} SELECT ab.i AS a, ab.j AS b, bc.j AS c FROM covis ab JOIN covis bc ON ab.j = bc.i JOIN covis ac ON ac.i = ab.i AND ac.j = bc.j")
def triangles(spark, d):
    return graph.triangles(covisibility(spark, d))


@query(f"WITH RECURSIVE {EDGES}, walk(v, distance) USING KEY (v) AS (SELECT min(i), 0 FROM edges UNION SELECT b.j, w.distance + 1 FROM walk w JOIN both_ways b ON w.v = b.i WHERE b.j NOT IN (SELECT v FROM recurring.walk) GROUP BY ALL) SELECT n.v, coalesce(w.distance, -1) AS distance FROM (SELECT DISTINCT i AS v FROM both_ways) n LEFT JOIN walk w USING (v)")
def bfs_distance(spark, d):
    e = _edges(spark, d)
    return graph.distances(e, e.agg(F.min("i")).first()[0])


# Statistics


@query("WITH o AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, min(x) AS least, max(x) AS most, round(avg(x), 4) AS mean, min(x) FILTER (k = n // 4) AS first_quartile, min(x) FILTER (k = n // 2) AS median, min(x) FILTER (k = n * 3 // 4) AS third_quartile FROM o GROUP BY l_returnflag")
def box_stats(spark, d):
    return stats.box_stats(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT CAST(CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity > 45 THEN 8 WHEN l_quantity = 45 THEN 7 ELSE floor((l_quantity - 5) / 40 * 8) END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return stats.histogram(t(spark, d, "lineitem"), F.col("l_quantity"), 5, 45, 8)


@query("SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_suppkey = p_partkey GROUP BY p_partkey")
def landmarks_per_view_zero(spark, d):
    x = t(spark, d, "lineitem").withColumnRenamed("l_suppkey", "p_partkey")
    return stats.counts_with_zeros(t(spark, d, "part"), x, "p_partkey")


@query("SELECT round(sqrt(sum(value * value) / (2 * count(value))), 6) AS rmse FROM events")
def residual_rmse(spark, d):
    return stats.rmse(t(spark, d, "events"), F.col("value"), 2)


@query("SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30")
def stable_poses(spark, d):
    return stats.supported(t(spark, d, "lineitem"), "l_partkey", 30)


@query("SELECT p_partkey AS pose_id, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey HAVING count(l_orderkey) < 25")
def unstable_poses(spark, d):
    v = t(spark, d, "part").select(F.col("p_partkey").alias("view_id"), F.col("p_partkey").alias("pose_id"))
    return scenes.unstable_poses(v, t(spark, d, "lineitem").select(F.col("l_partkey").alias("view_id")), 25)


def _rounds(n: int) -> str:
    parts, last = ["r0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)"], "r0"
    for k in range(n):
        parts.append(f"a{k} AS MATERIALIZED (SELECT * FROM {last} WHERE l_partkey IN (SELECT l_partkey FROM {last} GROUP BY 1 HAVING count(*) >= 24))")
        parts.append(f"b{k} AS MATERIALIZED (SELECT * FROM a{k} WHERE l_orderkey IN (SELECT l_orderkey FROM a{k} GROUP BY 1 HAVING count(*) >= 2))")
        last = f"b{k}"
    return "WITH " + ", ".join(parts) + f" SELECT l_orderkey, l_linenumber FROM {last}"


@query(_rounds(12))
def unstable_fixpoint(spark, d):
    """Parts with fewer than 24 rows and orders with fewer than 2 go, in turn, until nothing goes; the SQL makes more rounds than are needed."""
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return stats.stable_rows(x, "l_partkey", 24, "l_orderkey", 2).select("l_orderkey", "l_linenumber")


# Retrieval over the documents

TF = "tf AS (SELECT doc_id AS doc, word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2)"


def _tf(spark, d) -> DataFrame:
    return retrieval.term_counts(retrieval.words(t(spark, d, "documents"), "doc_id", "text"))


@query(f"WITH {TF} SELECT doc, word, tf FROM tf")
def tf_sparse(spark, d):
    return _tf(spark, d)


@query(f"WITH {TF} SELECT word, count(*) AS df, round(ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)), 6) AS idf FROM tf GROUP BY word")
def idf_weights(spark, d):
    return retrieval.idf(_tf(spark, d), t(spark, d, "documents").count())


def _scores(score: str) -> str:
    return f"WITH {TF}, s AS (SELECT q.doc AS query, x.doc AS doc, {score} AS score FROM tf q JOIN tf x ON q.word = x.word AND q.doc <> x.doc WHERE q.doc % 20 = 0 GROUP BY 1, 2) "


def _bags(spark, d):
    x = sparse.bags(t(spark, d, "documents"), "doc_id", "text")
    return x.filter("doc % 20 = 0"), x


@query(_scores("CAST(sum(least(q.tf, x.tf)) AS BIGINT)") + "SELECT query, doc, score FROM s")
def sparse_common(spark, d):
    return sparse.scores(*_bags(spark, d), "common")


@query(_scores("count(*) FILTER (q.tf = 1 AND x.tf = 1)") + "SELECT query, doc, score FROM s")
def sparse_strong(spark, d):
    return sparse.scores(*_bags(spark, d), "strong")


WEIGHTED = ", n AS (SELECT word, ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)) AS weight FROM tf GROUP BY word)"


def _weighted(spark, d, measure):
    q, x = _bags(spark, d)
    found = sparse.scores(q, x, measure, sparse.weights(x, t(spark, d, "documents").count()))
    return found.withColumn("score", F.floor(F.col("score") * 1e5 + 0.5) / 1e5)


def _weighted_scores(score: str) -> str:
    return f"WITH {TF}{WEIGHTED}, s AS (SELECT q.doc AS query, x.doc AS doc, round({score}, 5) AS score FROM tf q JOIN tf x ON q.word = x.word AND q.doc <> x.doc JOIN n ON n.word = q.word WHERE q.doc % 20 = 0 GROUP BY 1, 2) SELECT query, doc, score FROM s"


@query(_weighted_scores("sum(CASE WHEN q.tf = 1 AND x.tf = 1 THEN weight ELSE 0 END)"))
def sparse_weighted_strong(spark, d):
    return _weighted(spark, d, "weighted_strong")


@query(_weighted_scores("sum(weight / least(q.tf, x.tf))"))
def sparse_inverse_weighted(spark, d):
    return _weighted(spark, d, "inverse_weighted")


CLASSIC = f"WITH {TF}, z AS (SELECT doc, sum(tf) AS size FROM tf GROUP BY doc), c AS (SELECT q.doc AS query, x.doc, sum(least(q.tf, x.tf)) AS both FROM tf q JOIN tf x USING (word) WHERE q.doc % 20 = 0 GROUP BY 1, 2), a AS (SELECT p.doc AS query, y.doc, CAST(p.size + y.size - 2 * coalesce(c.both, 0) AS BIGINT) AS distance FROM z p JOIN z y ON true LEFT JOIN c ON c.query = p.doc AND c.doc = y.doc WHERE p.doc % 20 = 0)"


@query(f"{CLASSIC} SELECT query, doc, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS rank FROM a) WHERE rank <= 3")
def sparse_classic(spark, d):
    return sparse.top_classic(*_bags(spark, d), 3).select("query", "doc", "distance", F.col("rank").cast("long").alias("rank"))


@query(_scores("CAST(sum(least(q.tf, x.tf)) AS BIGINT)") + "SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 4")
def retrieval_topn(spark, d):
    return sparse.top(*_bags(spark, d), 4).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TF} SELECT tf, count(*) AS n FROM tf GROUP BY tf")
def term_frequencies(spark, d):
    return retrieval.frequency_histogram(_tf(spark, d))


# Joins on metadata, sets


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_nationkey * 100000 + CAST(floor(c_acctbal / 50) AS BIGINT) AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT s_nationkey * 100000 + CAST(floor(s_acctbal / 50) AS BIGINT) AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) USING (k)")
def meta_unique_join(spark, d):
    k = lambda p: (F.col(f"{p}_nationkey").cast("long") * 100000 + F.floor(F.col(f"{p}_acctbal") / 50)).alias("k")
    c, s = t(spark, d, "customer").select(k("c"), "c_custkey"), t(spark, d, "supplier").select(k("s"), "s_suppkey")
    return setops.unique_key_join(c, s, "k").select("c_custkey", "s_suppkey")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS number FROM pages")
def file_pattern(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "/([a-z]+)/([0-9]+)", 2).alias("number"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand.[0-9]3$') OR regexp_matches(p_name, '^.*1[0-9]$')")
def glob_filter(spark, d):
    return t(spark, d, "part").filter(F.col("p_brand").rlike(C.glob_pattern("Brand?#3")) | F.col("p_name").rlike(C.glob_pattern("*1#"))).select("p_partkey")


@query("SELECT c_custkey AS key, 'a' AS side FROM customer UNION ALL SELECT p_partkey, 'b' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def combine(spark, d):
    c, p = t(spark, d, "customer").select(F.col("c_custkey").alias("key")), t(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return setops.combine(c.withColumn("side", F.lit("a")), p.withColumn("side", F.lit("b")), "key")


@query("SELECT c_custkey AS key, c_custkey IN (SELECT p_partkey FROM part) AS clash FROM customer UNION ALL SELECT p_partkey, p_partkey IN (SELECT c_custkey FROM customer) FROM part")
def merge_disjoint(spark, d):
    c, p = t(spark, d, "customer").select(F.col("c_custkey").alias("key")), t(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return setops.merge_disjoint(c, p, "key")


@query("WITH b AS (SELECT o_orderkey AS id, o_custkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS low, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 90 AS high FROM orders) SELECT x.o_custkey, x.id, y.id AS other FROM b x JOIN b y ON x.o_custkey = y.o_custkey AND x.id <> y.id AND x.low <= y.high AND y.low <= x.high")
def range_overlap(spark, d):
    low = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    b = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", low.alias("low"), (low + F.col("o_orderkey") % 90).alias("high"))
    return setops.overlapping(b, b, "o_custkey", "low", "high", 60)


# Ordered analytics over events


@query("SELECT event_id, CAST(sum(CASE WHEN p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def basedir_islands(spark, d):
    by, order = ["user_id"], ["ts", "event_id"]
    return ordered.islands(t(spark, d, "events"), by, order, F.col("event_type") != ordered.lag("event_type", by, order)).select("event_id", "island")


MONOTONIC = "n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, p = value AS same, p IS NOT NULL AND p <> value AND q IS NOT NULL AND (q - value) * (value - p) < 0 AS turn FROM n), g AS (SELECT *, CAST(sum(CASE WHEN same OR turn THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS no FROM f), m AS (SELECT event_id, user_id, value, no AS island FROM g UNION ALL SELECT event_id, user_id, value, no - 1 FROM g WHERE turn)"


def _monotonic(spark, d):
    return views.monotonic_groups(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")


@query(f"WITH {MONOTONIC} SELECT event_id, island FROM m")
def monotonic_islands(spark, d):
    """Values only rise or only fall within an island; a turning point stands in both."""
    return _monotonic(spark, d).select("event_id", "island")


SIZES = f"{MONOTONIC}, s AS (SELECT user_id, island, count(*) AS size FROM m GROUP BY ALL), best AS (SELECT size, count(*) AS votes FROM s GROUP BY size ORDER BY votes DESC, size DESC LIMIT 1)"


@query(f"WITH {SIZES} SELECT size, votes FROM best")
def bracket_mode(spark, d):
    return ordered.mode_size(_monotonic(spark, d).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("size")), "size")


@query(f"WITH {SIZES} SELECT event_id, user_id, island FROM m JOIN s USING (user_id, island) WHERE size = (SELECT size FROM best)")
def bracket_groups(spark, d):
    return views.majority_groups(_monotonic(spark, d), ["user_id"], "island").select("event_id", "user_id", "island")


@query("SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 3) AS BIGINT) AS bracket FROM events")
def bracket_fixed(spark, d):
    return ordered.fixed_brackets(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("event_id", "bracket")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE (k - 1) % 4 = 0")
def keyframes_regular(spark, d):
    return ordered.keyframes(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 4).select("event_id")


@query("SELECT user_id, count(DISTINCT s) AS sessions FROM (SELECT user_id, sum(CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', p)) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id")
def event_sessions(spark, d):
    return ordered.sessions(t(spark, d, "events"), ["user_id"], "ts", 3600).groupBy("user_id").agg(F.countDistinct("session").alias("sessions"))


# Column math


@query("WITH p AS (SELECT l_suppkey, l_orderkey % 1024 AS y, (l_partkey * 7) % 1024 AS x FROM lineitem) SELECT l_suppkey, " + " + ".join(f"{2 ** (3 - lv)} * count(DISTINCT (floor(x / (1024.0 / {2 ** lv})), floor(y / (1024.0 / {2 ** lv}))))" for lv in (1, 2, 3)) + " AS score FROM p GROUP BY l_suppkey")
def pyramid_score(spark, d):
    """Three levels of 2, 4 and 8 cells a side; the coarsest weighs most."""
    return views.pyramid_score(t(spark, d, "lineitem"), ["l_suppkey"], (F.col("l_partkey") * 7) % 1024, F.col("l_orderkey") % 1024, 1024, 1024, 3)


@query("WITH p AS (SELECT l_suppkey, (l_partkey * 7) % 1000 AS x, l_orderkey % 700 AS y FROM lineitem), c AS (SELECT l_suppkey, k, count(DISTINCT (x // (1 << (k + 7)), y // (1 << (k + 7)))) AS n FROM p, generate_series(0, 3) g(k) GROUP BY 1, 2) SELECT l_suppkey, CAST(sum((1 << (2 - k + 1)) * n / 2.0) AS DOUBLE) AS score FROM c WHERE n > 1 GROUP BY 1")
def spread_score(spark, d):
    return views.spread_score(t(spark, d, "lineitem"), ["l_suppkey"], (F.col("l_partkey") * 7) % 1000, F.col("l_orderkey") % 700, 1000, 3)


@query("WITH s AS (SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h FROM part), n AS (SELECT *, w <= 600 AND h <= 600 AS one, ceil(w / 480.0) AS nx, ceil(h / 560.0) AS ny FROM s), e AS (SELECT *, ceil(ceil(w / 2.0) / nx) * 2 AS ew, ceil(ceil(h / 2.0) / ny) * 2 AS eh FROM n) SELECT p_partkey, CAST(i * ew AS BIGINT) AS x_begin, CAST(least((i + 1) * ew + 20, w) AS BIGINT) AS x_end, CAST(j * eh AS BIGINT) AS y_begin, CAST(least((j + 1) * eh + 20, h) AS BIGINT) AS y_end FROM e, generate_series(0, 9) a(i), generate_series(0, 9) b(j) WHERE NOT one AND i < nx AND j < ny UNION ALL SELECT p_partkey, 0, w, 0, h FROM e WHERE one")
def tiles(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.explode(scalars.tiles(F.col("p_size") * 40, F.col("p_size") * 30, 520, 600, 20, 2)).alias("r"))
    return x.select("p_partkey", "r.*")


EXPOSURES = "x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS shutter, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_quantity / 4 END AS aperture, CASE WHEN l_linenumber = 4 THEN 0 ELSE 100 + l_partkey % 700 END AS iso FROM lineitem), y AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 1.0 / 200 ELSE shutter END AS s, CASE WHEN aperture = 0 THEN 1.0 ELSE aperture END AS f, CASE WHEN iso = 0 THEN 1.0 ELSE iso / 100.0 END AS gain FROM x)"


@query(f"WITH {EXPOSURES} SELECT l_orderkey, l_linenumber, round(s / (f * f) / gain + 3e-10, 7) AS exposure, round(log2(gain * f * f / s), 6) AS ev FROM y")
def exposure_ev(spark, d):
    """Shutter times, apertures and sensitivities, some of them missing."""
    n = F.col("l_linenumber")
    x = t(spark, d, "lineitem")
    three = (F.when(n != 5, F.col("l_extendedprice") / 1000), F.when(n != 3, F.col("l_quantity") / 4), F.when(n != 4, (F.col("l_partkey") % 700 + 100).cast("double")))
    return x.select("l_orderkey", "l_linenumber", F.round(colour.exposure(*three) + 3e-10, 7).alias("exposure"), F.round(colour.exposure_value(*three), 6).alias("ev"))


ECEF = "g AS (SELECT c_custkey, radians(c_custkey % 180 - 89.5) AS la, radians(c_custkey % 360 - 179.5) AS lo, c_acctbal AS h FROM customer), n AS (SELECT *, 6378137.0 / sqrt(1 - 0.006694380022900787 * sin(la) * sin(la)) AS n FROM g)"


@query(f"WITH {ECEF} SELECT c_custkey, round((n + h) * cos(la) * cos(lo), 3) AS x, round((n + h) * cos(la) * sin(lo), 3) AS y, round((n * (1 - 0.006694380022900787) + h) * sin(la), 3) AS z FROM n")
def gps_ecef(spark, d):
    xyz = C.geodetic_to_ecef(F.col("c_custkey") % 180 - 89.5, F.col("c_custkey") % 360 - 179.5, F.col("c_acctbal"))
    return t(spark, d, "customer").select("c_custkey", *[F.round(c, 3).alias(n) for c, n in zip(xyz, "xyz")])


POINT = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, abs(CAST(embedding[3] AS DOUBLE)) + 1 AS z FROM embeddings), q AS (SELECT *, x / z AS u, y / z AS v, (x / z) * (x / z) + (y / z) * (y / z) AS r2 FROM p)"


def _points(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t(spark, d, "embeddings").select("vec_id", e(0).alias("x"), e(1).alias("y"), (F.abs(e(2)) + 1).alias("z")).withColumns({"u": F.col("x") / F.col("z"), "v": F.col("y") / F.col("z")})


def _px(df, uv):
    return df.select("vec_id", F.round(uv[0], 6).alias("px"), F.round(uv[1], 6).alias("py"))


@query(f"WITH {POINT} SELECT vec_id, round(1000 * x / z + 500, 6) AS px, round(1000 * y / z + 400, 6) AS py FROM q")
def pinhole_project(spark, d):
    return _px(p := _points(spark, d), C.pinhole(p["x"], p["y"], p["z"], 1000.0, 500.0, 400.0))


@query(f"WITH {POINT} SELECT vec_id, round(u * (1 + 0.1 * r2 + 0.05 * r2 * r2 - 0.001 * r2 * r2 * r2), 6) AS px, round(v * (1 + 0.1 * r2 + 0.05 * r2 * r2 - 0.001 * r2 * r2 * r2), 6) AS py FROM q")
def radial_k3(spark, d):
    return _px(p := _points(spark, d), C.radial(p["u"], p["v"], 0.1, 0.05, -0.001))


@query(f"WITH {POINT}, s AS (SELECT *, 1 + 0.1 * r2 + 0.05 * r2 * r2 - 0.001 * r2 * r2 * r2 AS s FROM q) SELECT vec_id, round(u * s + 0.02 * (r2 + 2 * u * u) + 2 * 0.01 * u * v, 6) AS px, round(v * s + 0.01 * (r2 + 2 * v * v) + 2 * 0.02 * u * v, 6) AS py FROM s")
def brown_t2(spark, d):
    return _px(p := _points(spark, d), C.brown(p["u"], p["v"], (0.1, 0.05, -0.001), (0.01, 0.02)))


@query(f"WITH {POINT}, a AS (SELECT *, atan(sqrt(r2)) AS a FROM q), s AS (SELECT *, CASE WHEN sqrt(r2) > 1e-8 THEN a * (1 + a * a * (0.1 + a * a * (0.01 + a * a * (0.001 + a * a * 0.0001)))) / sqrt(r2) ELSE 1 END AS s FROM a) SELECT vec_id, round(u * s, 6) AS px, round(v * s, 6) AS py FROM s")
def fisheye4(spark, d):
    return _px(p := _points(spark, d), C.fisheye(p["u"], p["v"], (0.1, 0.01, 0.001, 0.0001)))


@query(f"WITH {POINT} SELECT vec_id, round(300 * atan2(sqrt(x * x + y * y), z) * cos(atan2(y, x)), 6) AS px, round(300 * atan2(sqrt(x * x + y * y), z) * sin(atan2(y, x)), 6) AS py FROM q")
def equidistant(spark, d):
    return _px(p := _points(spark, d), C.equidistant(p["x"], p["y"], p["z"], 300.0))


# Estimation

#: Cameras of the queries below, as rows of a table.
CAMERAS = [(1, [0.9, 0.1, 0.2, 0.5, -0.1, 0.95, 0.3, 0.25, 0.05, -0.2, 1.0, 6.0]), (2, [0.8, -0.3, 0.1, -0.75, 0.2, 0.9, -0.1, 0.5, 0.15, 0.1, 1.0, 7.0]), (3, [1.0, 0.2, -0.3, 0.125, 0.1, 0.85, 0.2, -1.0, -0.1, 0.25, 1.0, 8.0])]
SPACE = "s AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz FROM embeddings)"


def _seen(spark, d) -> DataFrame:
    """The first three numbers of each embedding as a point, seen by each of CAMERAS."""
    e = lambda k: F.col("embedding")[k].cast("double")
    x = t(spark, d, "embeddings").select("vec_id", e(0).alias("px"), e(1).alias("py"), e(2).alias("pz"))
    cams = F.array(*[F.struct(F.lit(v).cast("long").alias("view_id"), F.array(*map(F.lit, c)).alias("camera")) for v, c in CAMERAS])
    x = x.select("*", F.explode(cams).alias("c")).select("vec_id", "px", "py", "pz", "c.view_id", "c.camera")
    h = [F.col("camera")[4 * k] * F.col("px") + F.col("camera")[4 * k + 1] * F.col("py") + F.col("camera")[4 * k + 2] * F.col("pz") + F.col("camera")[4 * k + 3] for k in range(3)]
    return x.withColumn("x", h[0] / h[2]).withColumn("y", h[1] / h[2])


@query(f"WITH {SPACE} SELECT vec_id, 3 AS n, round(px, 3) + 0.0 AS px, round(py, 3) + 0.0 AS py, round(pz, 3) + 0.0 AS pz FROM s")
def triangulate_points(spark, d):
    x = kernels.triangulate_tracks(_seen(spark, d).withColumnRenamed("vec_id", "track_id"))
    return x.select(F.col("track_id").alias("vec_id"), F.col("n").cast("int").alias("n"), *[(F.round(F.col("x")[k], 3) + 0.0).alias(c) for k, c in enumerate(["px", "py", "pz"])])


@query("WITH c(view_id, camera) AS (VALUES " + ", ".join(f"({v}, {[x / sum(y * y for y in c[8:11]) ** 0.5 for x in c]})" for v, c in CAMERAS) + ") SELECT view_id::BIGINT AS view_id, (SELECT count(*) FROM embeddings) AS n, k, round(camera[k + 1]::DOUBLE, 3) + 0.0 AS value FROM c, (SELECT unnest(range(12))::INTEGER AS k)")
def resect_cameras(spark, d):
    x = kernels.resect_views(_seen(spark, d))
    return x.select("view_id", "n", F.posexplode("camera").alias("k", "value")).withColumn("value", F.round("value", 3) + 0.0)


ANGLES = "e AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_suppkey * 0.37 - b.s_suppkey * 0.37 + CASE WHEN (a.s_suppkey * 7 + b.s_suppkey) % 5 = 0 THEN 0.5 ELSE 0 END AS angle FROM supplier a JOIN supplier b ON b.s_suppkey > a.s_suppkey AND b.s_suppkey <= a.s_suppkey + 5)"


@query(f"WITH {ANGLES}, g AS (SELECT x.i, x.j, y.j AS k FROM e x JOIN e y ON y.i = x.j JOIN e z ON z.i = x.i AND z.j = y.j WHERE degrees(acos(least(1.0, (1 + 2 * cos(x.angle + y.angle - z.angle)) / 3))) < 5) SELECT DISTINCT i, j FROM (SELECT i, j FROM g UNION ALL SELECT j, k FROM g UNION ALL SELECT i, k FROM g)")
def triplet_cycle_error(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    e = s.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + 5)).alias("j")).join(s.withColumnRenamed("i", "j"), "j", "left_semi")
    a = F.col("i") * 0.37 - F.col("j") * 0.37 + F.when((F.col("i") * 7 + F.col("j")) % 5 == 0, 0.5).otherwise(0.0)
    c, n, o = F.cos(a), F.sin(a), F.lit(0.0)
    return kernels.cycle_edges(e.withColumn("r", F.array(c, -n, o, n, c, o, o, o, F.lit(1.0))), 5.0).select("i", "j")


@query(r"WITH v AS (SELECT DISTINCT upper(p_brand) || ' inc.' AS brand, string_split(p_type, ' ')[-1] AS model FROM part), n AS (SELECT *, regexp_replace(lower(brand), '[[:punct:]\s]', '', 'g') AS b, regexp_replace(lower(model), '[[:punct:]\s]', '', 'g') AS m FROM v), w AS (SELECT p_partkey AS row, p_retailprice AS width, regexp_replace(lower(p_brand), '[[:punct:]\s]', '', 'g') AS b, regexp_replace(lower(p_type), '[[:punct:]\s]', '', 'g') AS m FROM part) SELECT n.brand, n.model, min(w.row) AS row, arg_min(w.width, w.row) AS width FROM n JOIN w ON (starts_with(n.b, w.b) OR starts_with(w.b, n.b)) AND (ends_with(n.m, w.m) OR ends_with(w.m, n.m)) GROUP BY n.brand, n.model")
def sensor_lookup(spark, d):
    p = t(spark, d, "part")
    views = p.select(F.concat(F.upper("p_brand"), F.lit(" inc.")).alias("brand"), F.element_at(F.split("p_type", " "), -1).alias("model"))
    return sensors.lookup(views, p.select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_retailprice").alias("width")))


@query("SELECT event_type, date_trunc('hour', ts) AS begin, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type, date_trunc('hour', ts)")
def frame_rates(spark, d):
    return frames.rates(t(spark, d, "events"), ["event_type"], "ts", "1 hour", "1 hour").withColumn("total", F.round("total", 2))


@query("WITH b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 1 HOUR AS end, count(*) AS n FROM r GROUP BY user_id, s")
def frame_bursts(spark, d):
    return frames.bursts(t(spark, d, "events"), ["user_id"], "ts", "1 hour", "1 hour")


# Extensions


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_flags(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT e.event_id, max(o.o_orderkey) AS last_order FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id")
def asof_orders(spark, d):
    """As-of by key: the largest order so far, from one window over both tables."""
    e = t(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("long").alias("o"))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.unionByName(o).withColumn("last_order", F.max("o").over(w)).filter("event_id is not null").select("event_id", "last_order")
