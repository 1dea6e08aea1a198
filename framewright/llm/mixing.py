"""Mixing sources to target weights, measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.bpe import token_count
from framewright.operators.ordered import spread_prefix_sum
from framewright.session import checkpointed

SEED, BUCKET_BITS = 42, 12


def shuffled_prefix(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """source, doc_id, tokens, upto: every document in its source's random order, with the tokens up to and with it.

    The order is by a hash of doc_id, so it is the same on every run. It is cut into 2^12 ranges of the hash, whose sums
    are carried along; a source that holds a third of all documents is sorted in as many pieces. Documents without a
    source or without tokens cannot be drawn and are left out; a doc_id that comes twice counts once.
    """
    sized = documents.where("source is not null and doc_id is not null and text is not null").select("source", "doc_id", token_count(F.col("text")).alias("tokens"))
    # the filter follows the aggregate: before it, Catalyst would encode every text once for the filter and once more
    once = sized.groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0").withColumn("key", F.xxhash64(F.lit(seed), F.col("doc_id")))
    # the sums read their input twice; texts are encoded once
    return spread_prefix_sum(checkpointed(once), ["source"], F.shiftright("key", 64 - BUCKET_BITS), ["key", "doc_id"], "tokens", "upto")


def budgets(targets: DataFrame, stock: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """What each source of each mix gives: mix_name, source, target_share, max_repeats, available, budget, limit_kind.

    ``stock`` has source and available (its tokens). A mix's weights are relative; null, zero, negative and NaN weights
    ask for nothing, a null max_repeats is 1, and a (mix_name, source) that comes twice has its weights added and its
    smallest max_repeats. A source without documents keeps its target_share in the report, and its part is spread over
    the others by weight.

    The mix has the largest total at which every source that can take part has its share: the least of
    max_repeats * available / share. ``total_tokens`` may instead be a number, or "stock": as many tokens as the sources
    have. A source that cannot fill its share of such a total gives what it can. ``limit_kind`` says so: 'short' (gives
    less than its share), 'sets the size' (it would be the first to run short), 'absent' (it has no documents, or asks
    for nothing), or null.
    """
    clean = F.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0), 0.0).otherwise(F.col("weight"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(clean).alias("weight"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("long").alias("max_repeats"))
    mix = Window.partitionBy("mix_name")
    held = wanted.join(stock, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    can = (F.col("available") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0)
    # try_divide: a mix that asks for nothing has no shares
    shares = held.withColumn("target_share", F.coalesce(F.try_divide("weight", F.sum("weight").over(mix)), F.lit(0.0))).withColumn("share", F.coalesce(F.when(can, F.try_divide("weight", F.sum(F.when(can, F.col("weight"))).over(mix))), F.lit(0.0)))
    most = F.col("max_repeats") * F.col("available")
    reach = F.when(F.col("share") > 0, most / F.col("share"))
    if total_tokens is None:
        total = F.min(reach).over(mix)
    elif total_tokens == "stock":
        total = F.sum(F.when(F.col("share") > 0, F.col("available"))).over(mix).cast("double")
    else:
        total = F.lit(float(total_tokens))
    sized = shares.withColumn("total", total).withColumn("reach", reach)
    exact = F.floor(F.round(F.col("share") * F.coalesce("total", F.lit(0.0)), 3)).cast("long")
    kind = F.when(F.col("share") <= 0, "absent").when(exact > most, "short").when(F.col("reach") <= F.col("total") * (1 + 1e-12), "sets the size")
    return sized.select("mix_name", "source", "target_share", "max_repeats", "available", F.least(exact, most).alias("budget"), kind.alias("limit_kind"))


def _drawn(prefix: DataFrame, plan: DataFrame) -> DataFrame:
    rounds = F.expr("budget div available")
    takes = rounds + F.when(F.col("upto") <= F.expr("budget % available"), 1).otherwise(0)
    # mix_targets is a list of mixes, not of documents; AQE broadcasts the plan if it is below the session's limit
    return prefix.join(plan.where("budget > 0"), "source").withColumn("takes", takes).where("takes > 0")


def draw_mixes(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (mix_name, source, doc_id, tokens, takes) and the report of the shares.

    A source whose budget is its whole stock r times and a rest is taken r times whole, and then its random order up to
    the rest; the document that would pass the budget is not taken, so a source is below its budget by less than that
    document. ``takes`` never passes max_repeats. The report has a row for each (mix_name, source), also where nothing
    is drawn: target_share, max_repeats, available, budget, limit_kind, docs, tokens, actual_share (of the tokens of the mix).
    Empty tables give empty results.
    """
    prefix = checkpointed(shuffled_prefix(documents, seed))
    plan = checkpointed(budgets(targets, prefix.groupBy("source").agg(F.sum("tokens").alias("available")), total_tokens))
    drawn = _drawn(prefix, plan).select("mix_name", "source", "doc_id", "tokens", "takes")
    sums = drawn.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("takes")).alias("tokens"))
    got = plan.join(sums, ["mix_name", "source"], "left").na.fill(0, ["docs", "tokens"])
    share = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0))
    return drawn, got.withColumn("actual_share", share)
