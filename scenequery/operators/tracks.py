"""Tracks: building from matches, filters, set queries, covisibility.  A track table has (track, view, feat), and kind where descriptors of several kinds meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenequery.operators import blocks, graph


def build(matches: DataFrame) -> DataFrame:
    """(track, kind, view, feat): connected components of features, from matches(i, j, kind, fi, fj).

    Features of one kind in one view are vertices, matches edges.  A track's id is the least of its
    features' numbers, which are 1, 2, ... in the order of (kind, view, feat).
    """
    ends = matches.select("kind", F.col("i").alias("view"), F.col("fi").alias("feat")).union(matches.select("kind", "j", "fj"))
    packing = _packing(matches, ends)
    if packing is None:
        return _build_wide(matches, ends.distinct())
    n, kinds, views, feats = packing
    if not n:
        return ends.select(F.lit(0).cast("long").alias("track"), "kind", "view", "feat").limit(0)
    kind = {f.name: f.dataType for f in ends.schema}
    names = F.array(*[F.lit(k).cast(kind["kind"]) for k in kinds])
    place = (F.array_position(names, F.col("kind").cast(kind["kind"])) - 1) if len(kinds) > 1 else F.lit(0)
    one = lambda view, feat: (place * (views[1] - views[0] + 1) + (F.col(view).cast("long") - views[0])) * (feats[1] - feats[0] + 1) + (F.col(feat).cast("long") - feats[0])
    edges = matches.select(one("i", "fi").alias("x"), one("j", "fj").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = blocks.classes(edges, n)
    width, height = feats[1] - feats[0] + 1, views[1] - views[0] + 1
    v = F.col("v")
    line = F.expr(f"v div {width}")
    rank = F.expr(f"v div {width} div {height}")
    return found.select(
        F.col("label").alias("track"),
        F.get(names, rank.cast("int")).alias("kind"),
        (line % height + views[0]).cast(kind["view"]).alias("view"),
        (v % width + feats[0]).cast(kind["feat"]).alias("feat"),
    )


#: Most kinds that are packed into numbers.
KINDS = 256


def _packing(matches: DataFrame, ends: DataFrame):
    """Number of matches, kinds ascending, and least and greatest view and feature, where (kind, view, feat) fits a whole number that keeps their order; else None."""
    if not all(isinstance(matches.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for c in ("i", "j", "fi", "fj")) or not isinstance(ends.schema["kind"].dataType, T.StringType):
        return None
    least, most = lambda *c: F.least(*[F.min(x).cast("long") for x in c]), lambda *c: F.greatest(*[F.max(x).cast("long") for x in c])
    whole = F.col("kind").isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("fi").isNotNull() & F.col("fj").isNotNull()
    n, good, *bounds = matches.agg(F.count(F.lit(1)), F.count_if(whole), least("i", "j"), most("i", "j"), least("fi", "fj"), most("fi", "fj")).first()
    kinds = sorted(r[0] for r in matches.select("kind").distinct().limit(KINDS + 1).collect()) if n == good else []
    if n and (n != good or len(kinds) > KINDS or len(kinds) * (bounds[1] - bounds[0] + 1) * (bounds[3] - bounds[2] + 1) >= 1 << 62):
        return None
    return n, kinds, bounds[:2], bounds[2:]


def _build_wide(matches: DataFrame, ends: DataFrame) -> DataFrame:
    """build for what does not fit a number: features are numbered by join."""
    # numbers without a window over all: rank in its (kind, view), behind the features of lesser ones
    per = ends.groupBy("kind", "view").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("kind", "view").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.withColumn("base", before).drop("n")  # a row per view and kind
    rank = F.row_number().over(Window.partitionBy("kind", "view").orderBy("feat"))
    nodes = graph._cut(ends.withColumn("rank", rank).join(base, ["kind", "view"]).select("kind", "view", "feat", (F.col("base") + F.col("rank")).alias("v")))
    x = matches
    for end in "ij":
        x = x.join(nodes.select("kind", F.col("view").alias(end), F.col("feat").alias(f"f{end}"), F.col("v").alias(f"v{end}")), ["kind", end, f"f{end}"])
    found = graph.components(x.select(F.col("vi").alias("i"), F.col("vj").alias("j")))
    return nodes.join(found, "v").select(F.col("component").alias("track"), "kind", "view", "feat")


def numbered(tracks: DataFrame) -> DataFrame:
    """Tracks with ids 0, 1, ... in the order of their old ones; one row per track is ordered."""
    ids = tracks.select("track").distinct()
    ids = ids.withColumn("new_", F.row_number().over(Window.orderBy("track")) - 1)
    return tracks.join(ids, "track").drop("track").withColumnRenamed("new_", "track").select(*tracks.columns)


def kept_tracks(tracks: DataFrame, least: int, clear_forks: bool = True) -> DataFrame:
    """The rows of `filter_tracks`' tracks."""
    return tracks.join(filter_tracks(tracks.select("track", "view", "feat"), least, clear_forks).select("track"), "track", "left_semi")


def filter_tracks(tracks: DataFrame, least: int, clear_forks: bool = True) -> DataFrame:
    """Tracks over at least `least` views and, with clear_forks, with one feature per view."""
    per = tracks.distinct().groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("view").alias("views"))
    ok = per.filter((F.col("views") >= least) & ((F.col("n") == F.col("views")) if clear_forks else F.lit(True)))
    return ok.select("track", F.col("views").alias("length"))


def count(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.countDistinct("track").alias("n"))


def views_of(tracks: DataFrame) -> DataFrame:
    return tracks.select("view").distinct()


def length_histogram(tracks: DataFrame) -> DataFrame:
    per = tracks.groupBy("track").agg(F.countDistinct("view").alias("length"))
    return per.groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def common_tracks(tracks: DataFrame, views: list[int]) -> DataFrame:
    """Tracks seen in all the views."""
    x = tracks.filter(F.col("view").isin(views)).groupBy("track").agg(F.countDistinct("view").alias("n"))
    return x.filter(F.col("n") == len(set(views))).select("track")


def common_items(tracks: DataFrame, views: list[int]) -> DataFrame:
    """The rows, in those views, of the tracks seen in all of them."""
    return tracks.filter(F.col("view").isin(views)).join(common_tracks(tracks, views), "track", "left_semi")


def any_tracks(tracks: DataFrame, views: list[int]) -> DataFrame:
    return tracks.filter(F.col("view").isin(views)).select("track").distinct()


def features_of(tracks: DataFrame, ids: DataFrame, view: int) -> DataFrame:
    """(track, feat, ...) in a view, of the tracks of ids(track)."""
    return tracks.filter(F.col("view") == view).join(ids.select("track"), "track", "left_semi").drop("view")


def two_view_matches(tracks: DataFrame, i: int, j: int) -> DataFrame:
    """(track, fi, fj): the features of two views that share a track."""
    one = lambda v, n: tracks.filter(F.col("view") == v).select("track", F.col("feat").alias(n))
    return one(i, "fi").join(one(j, "fj"), "track")


def per_view(tracks: DataFrame) -> DataFrame:
    """(view, n, tracks): each view's track ids, ascending; a list is no longer than its view has features."""
    x = tracks.select("view", "track").distinct()
    return x.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("track")).alias("tracks"))


def covisibility(tracks: DataFrame) -> DataFrame:
    """(i, j, n): number of tracks that two views share.  A track has a row per view that sees it; a pair meets once per shared track."""
    x = tracks.select("track", "view").distinct()
    y = x.select("track", F.col("view").alias("j"))
    return x.withColumnRenamed("view", "i").join(y, "track").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def nearest_views(shared: DataFrame, k: int, least: int) -> DataFrame:
    """For each view, the k views with most tracks in common, of those with at least `least`."""
    both = shared.select("i", "j", "n").union(shared.select("j", "i", "n")).toDF("view", "other", "n").filter(F.col("n") >= least)
    w = Window.partitionBy("view").orderBy(F.desc("n"), "other")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def text(tracks: DataFrame) -> DataFrame:
    """(track, line): "Class: track" and a line "view feat" for each feature, joined by newlines."""
    rows = F.array_sort(F.collect_list(F.struct("view", "feat")))
    x = tracks.groupBy("track").agg(rows.alias("r"))
    lines = F.transform("r", lambda r: F.concat_ws(" ", r["view"].cast("string"), r["feat"].cast("string")))
    return x.select("track", F.concat(F.lit("Class: "), F.col("track").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("line"))
