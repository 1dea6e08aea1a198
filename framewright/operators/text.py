"""Sparse text ranking (BM25) over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks; an empty array for null texts."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1), F.array().cast("array<string>"))


def bm25(documents: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` best documents of each query.

    Texts are read where they are: a document moves as its length and as its counts of those terms that some query has,
    netted per document before the shuffle; a term in a third of all documents meets the short list of query terms, not
    other documents. Statistics are over all documents with text; those with no common term are no hits. A doc_id that
    comes again counts once, with the text of the smallest hash.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = asked.select("term").distinct()
    split = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), tokens(F.col("text")).alias("ts"))
    sized = split.groupBy("doc_id").agg(F.min(F.struct("version", F.size("ts").cast("long").alias("dl"))).alias("d")).select("doc_id", "d.version", "d.dl").where("dl > 0")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # a row is counted on its own first, so that a text that comes again under one id does not count twice
    rows = split.select("doc_id", "version", "ts", F.monotonically_increasing_id().alias("row"))
    terms = rows.select("doc_id", "version", "row", F.explode("ts").alias("term")).join(words, "term", "left_semi")
    netted = terms.groupBy("term", "doc_id", "version", "row").agg(F.count(F.lit(1)).alias("tf")).groupBy("term", "doc_id", "version").agg(F.max("tf").alias("tf"))
    tf = netted.join(sized, ["doc_id", "version"]).select("term", "doc_id", "dl", "tf")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")  # stats: one row
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = asked.join(idf, "term").join(tf, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", (F.row_number().over(best) - 1).cast("long")).where(F.col("rank") < k)
