"""Visual-word style retrieval over sparse (doc, word, tf) tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequery.operators import stats


def words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, word): what stands between spaces, lower-cased."""
    x = docs.select(F.col(key).alias("doc"), F.explode(F.split(F.lower(F.col(text)), " ")).alias("word"))
    return x.filter("word != ''")


def term_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("tf"))


def term_lists(tokens: DataFrame, feature: str) -> DataFrame:
    """(doc, word, features): the features of a document behind each of its words; no more than the document has."""
    return tokens.groupBy("doc", "word").agg(F.array_sort(F.collect_list(feature)).alias("features"))


def idf(tf: DataFrame, n_docs: int) -> DataFrame:
    """ln(documents / documents with the word)."""
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", "df", F.round(F.log(F.lit(float(n_docs)) / F.col("df")), 6).alias("idf"))


def frequency_histogram(tf: DataFrame) -> DataFrame:
    """(tf, n): over all entries of documents and words."""
    return tf.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))


def common_words(queries: DataFrame, tf: DataFrame, score: Column) -> DataFrame:
    """(query, doc, score) over the words that both have; columns qtf and tf, and weight if tf has it, are there for `score`.

    A word that stands in many documents is one key of the join; adaptive execution splits its rows of tf.
    """
    q = queries.select(F.col("doc").alias("query"), "word", F.col("tf").alias("qtf"))
    return q.join(tf, "word").filter("query != doc").groupBy("query", "doc").agg(score.alias("score"))


#: Scores, greater for documents that are more alike; weighted ones need a column `weight`.
SCORES = {
    "common": lambda: F.sum(F.least("qtf", "tf")),
    "strong": lambda: F.count_if((F.col("qtf") == 1) & (F.col("tf") == 1)),
    "weighted_strong": lambda: F.sum(F.when((F.col("qtf") == 1) & (F.col("tf") == 1), F.col("weight")).otherwise(0.0)),
    "inverse_weighted": lambda: F.sum(F.col("weight") / F.least("qtf", "tf")),
}


def weighted(tf: DataFrame, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """tf with `weight` from weights(word, idf)."""
    return tf.join(weights.select("word", F.col("idf").alias("weight")), "word", "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def scores(queries: DataFrame, tf: DataFrame, measure: str) -> DataFrame:
    if measure not in SCORES:
        raise ValueError(f"unknown measure {measure}; there are {', '.join(SCORES)}")
    return common_words(queries, tf, SCORES[measure]())


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best documents of each query; ties by id."""
    return stats.ranked(scores, ["query"], [F.desc("score"), "doc"], n)


def top_classic(queries: DataFrame, tf: DataFrame, n: int, others: bool = False) -> DataFrame:
    """(query, doc, distance, rank): the n documents of least sum of |tf - tf|; ties by id; with others, not the query itself.

    The distance is the sizes' sum less twice the common count.  Of documents without a common word only the
    shortest can be among the nearest, so that a query meets about twice as many documents as it shares words with.
    """
    size = tf.groupBy("doc").agg(F.sum("tf").alias("size"))
    q = queries.groupBy(F.col("doc").alias("query")).agg(F.sum("tf").alias("qsize"))
    shared = queries.select(F.col("doc").alias("query"), "word", F.col("tf").alias("qtf")).join(tf, "word").groupBy("query", "doc").agg(F.sum(F.least("qtf", "tf")).alias("both"))
    near = shared.join(q, "query").join(size, "doc").select("query", "doc", (F.col("qsize") + F.col("size") - 2 * F.col("both")).alias("distance"))
    # a query's n shortest strangers stand among the first n + (documents it shares words with) by size
    known = shared.groupBy("query").agg(F.count(F.lit(1)).alias("known"))
    per = size.groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per size
    place = F.row_number().over(Window.partitionBy("size").orderBy("doc"))
    placed = size.withColumn("place", place).join(per.select("size", "before"), "size").select("doc", "size", (F.col("before") + F.col("place")).alias("place"))
    far = q.join(known, "query", "left").withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("known", F.lit(0)) + n + 1)))
    far = far.join(placed, "place").join(shared.select("query", "doc"), ["query", "doc"], "left_anti").select("query", "doc", (F.col("qsize") + F.col("size")).alias("distance"))
    x = near.union(far)
    return stats.ranked(x.filter("query != doc") if others else x, ["query"], ["distance", "doc"], n)


def self_check(tf: DataFrame, n: int) -> DataFrame:
    """`top_classic` of every document against all: each should find itself first."""
    return top_classic(tf, tf, n)
