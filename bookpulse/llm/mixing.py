"""Mixing sources to target weights.

Sizes are summed per source, each source gets a target, and the ratio of both is the repetition
rate of its documents: each is emitted floor(rate) times, and once more with the probability of the
fraction. The coin is a hash of seed and document, so reruns agree.

A source's target is its share by weight of all words, but at most ``cap`` times its size; what the
cap cuts off is shared again by weight among the others. Sources that reach the cap are those with
the smallest size per weight, so one ordering and running sums find the common level.

Null texts have size 0, a null source is a source of its own (the last). Documents with equal ids
share their coin. An empty table has no sources and gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import map_rows, store, text_of, whole


def word_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the number of words of each text."""
    kinds = ", ".join(f"{name} {docs.schema[name].dataType.simpleString()}" for name in keep)

    def rows(*columns: list) -> list[list]:
        return [*columns[:-1], [len(text.split()) for text in columns[-1]]]

    columns = [*[F.col(name) for name in keep], text_of().cast("binary")]
    return map_rows(docs, columns, f"{kinds}, size long", rows)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); weights repeat in source order.

    The windows run over the rows of sources, which the aggregation has summed before.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(ordered) - 1
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())))
    )
    by_place = Window.orderBy("place")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_place.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (
        sources.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(onward))
        .withColumn("capped", F.col("most") * F.col("weight_left") < F.col("weight") * F.col("left"))
        .withColumn("level", F.col("left").cast("double") / F.col("weight_left"))
    )
    first_open = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)
    return levelled.withColumn("common", F.coalesce(first_open["level"], F.lit(0.0))).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("common")).alias("target"),
    )


def coin(seed: int, key: Column) -> Column:
    """A number in [0, 1) by seed and key: 32 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def copies(rate: Column, seed: int, key: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(coin(seed, key) < rate - whole, 1).otherwise(0)


def mixed_sizes(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    sizes = store(word_sizes(docs, "doc_id", "source"), "mix-sizes")
    targets = store(source_targets(sizes, weights, cap), "mix-targets")
    with_target = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return with_target.select(
        "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target",
        copies(rate, seed, F.col("doc_id")).cast("long").alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def mixture(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents as the mix takes them, each as often as its copies, with their own columns."""
    sizes = word_sizes(docs, "source")
    targets = store(source_targets(sizes, weights, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(F.col("source").alias("wanted"), rate.alias("rate"))
    met = whole(docs, F.col("source").alias("own"), F.col("doc_id").alias("key")).join(rates, F.col("own").eqNullSafe(F.col("wanted")))
    number = copies(F.col("rate"), seed, F.col("key")).cast("int")
    taken = met.select("row", F.explode(F.when(number > 0, F.sequence(F.lit(1), number))))
    return taken.select("row.*")
