"""Fuzzy lookup of issuers by trigram similarity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions.text import jaccard, pieces, plain, trigrams
from bookpulse.session import work_dir


def fuzzy_search(
    catalog: DataFrame,
    terms: list[str],
    on: str = "issuer",
    key: str = "position_id",
    attributes: tuple[str, ...] = (),
    max_results: int = 10,
) -> DataFrame:
    """Best matches per search term, with the catalog attributes passed through.

    The terms are call arguments, so their trigrams travel as one literal and every catalog row
    is scored where it is read: no trigram index to shuffle and no common trigram to skew it.
    Only each task's best rows per term move, for the final ranking.
    """
    spark = catalog.sparkSession
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id int, query string")
    packed = asked.agg(
        F.collect_list(
            F.struct("query_id", "query", plain(F.col("query")).alias("text"),
                     trigrams(F.col("query")).alias("grams"))
        ).alias("terms")
    )
    scored = (
        catalog.select(key, on, *attributes, trigrams(F.col(on)).alias("_grams"))
        .withColumn("_term", F.explode(packed.scalar()))
        .select(
            F.col("_term.query_id").alias("query_id"),
            F.col("_term.query").alias("query"),
            key,
            on,
            *attributes,
            jaccard(F.col("_grams"), F.col("_term.grams")).alias("score"),
            F.levenshtein(plain(F.col(on)), F.col("_term.text")).alias("distance"),
        )
        .where(F.col("score") > 0)
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", key)
    return scored.withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= max_results
    )


#: Similarities that a table of queries is searched at, one after the other, before the least.
ROUNDS = (0.8, 0.55)
#: Pairs of one trigram that a task compares, about.
PAIRS = 1_000_000


def search_table(
    catalog: DataFrame,
    queries: DataFrame,
    on: str = "issuer",
    key: str = "position_id",
    query_key: str = "query_id",
    query: str = "query",
    attributes: tuple[str, ...] = (),
    least: float = 0.3,
    max_results: int = 10,
) -> DataFrame:
    """Best matches for each row of a table of queries, of similarity ``least`` or more.

    See ``in_rounds`` and ``near_texts``: equal texts meet once, and only on the rarest trigrams.
    """
    path = work_dir(catalog.sparkSession, "search")
    names = by_text(catalog.select(key, on, *attributes), on, key, max_results, f"{path}/names")
    return in_rounds(queries, lambda left, at: names, on, key, query_key, query, attributes, least, max_results, path)


@dataclass(frozen=True)
class Names:
    """Names by their plain text.

    ``rows`` has the first rows of each text by key, as many as are asked for; ``texts`` each text once,
    with its first key and its trigrams, rarest first; ``numbers`` numbers the trigrams in that order.
    """

    rows: DataFrame
    texts: DataFrame
    numbers: DataFrame


def written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def by_text(names: DataFrame, on: str, key: str, max_results: int, path: str) -> Names:
    """Names with the same plain text match alike, so no more than ``max_results`` of them can be asked for."""
    rows = names.withColumn("_plain", plain(F.col(on))).where(F.col(key).isNotNull() & F.col("_plain").isNotNull())
    place = F.row_number().over(Window.partitionBy("_plain").orderBy(key))
    rows = written(rows.withColumn("_place", place).where(F.col("_place") <= max_results), f"{path}/rows")
    texts = rows.where(F.col("_place") == 1).select("_plain", F.col(key).alias("_first"))
    each = texts.select(F.explode(pieces(F.col("_plain"))).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram")
    numbers = written(counts.select("gram", F.monotonically_increasing_id().alias("number")), f"{path}/numbers")
    return Names(rows.drop("_place"), written(rarest_first(texts, "_plain", numbers), f"{path}/texts"), numbers)


def rarest_first(texts: DataFrame, text: str, numbers: DataFrame) -> DataFrame:
    """The trigrams of each plain text as ordered numbers ``_grams``; those without a number, -1, are in front."""
    each = texts.select("*", F.explode(pieces(F.col(text))).alias("gram")).join(numbers, "gram", "left")
    return each.groupBy(*texts.columns).agg(F.array_sort(F.collect_list(F.coalesce("number", F.lit(-1)))).alias("_grams"))


def near_texts(asked: DataFrame, names: Names, at: float, max_results: int, path: str) -> DataFrame:
    """(_text, _plain, score, distance): the best texts for each query text, of similarity ``at`` or more.

    Two sets of similarity ``at`` share a trigram among the first ``size - ceil(at * size) + 1`` of both
    in the order of frequency, so texts meet on those only and no match is lost. A pair counts where its
    first common trigram is, so pairs needn't be moved to be told apart; a place too late for the overlap
    that the sizes ask for is passed over. The pairs of a frequent trigram are dealt over many tasks.
    """

    def prefix(texts: DataFrame) -> DataFrame:
        sized = texts.withColumn("size", F.size("_grams"))
        # The small term keeps a product like 0.3 * 10 from being rounded up.
        wanted = (F.col("size") - F.ceil(F.col("size") * at - 1e-9) + 1).cast("int")
        return sized.select("*", F.posexplode(F.slice("_grams", F.lit(1), wanted)).alias("place", "gram"))

    named, wanted = prefix(names.texts), prefix(rarest_first(asked, "_text", names.numbers))
    shared = named.groupBy("gram").agg(F.count("*").alias("n")).join(wanted.groupBy("gram").agg(F.count("*").alias("m")), "gram")
    parts = F.ceil(F.col("n") * F.col("m") / PAIRS)
    shared = written(shared.select("gram", F.least("n", parts).cast("int").alias("parts")), path)
    named = named.join(shared, "gram").withColumn("part", F.pmod(F.xxhash64("_plain"), F.col("parts")).cast("int"))
    wanted = wanted.join(shared, "gram").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # By number, and merged: the rows are few for the pairs that they make, so their size is no measure of the work.
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, w = named.repartition(tasks, "gram", "part").alias("n"), wanted.hint("merge").alias("w")
    sizes = F.col("n.size") + F.col("w.size")
    most = F.least(F.col("n.size") - F.col("n.place"), F.col("w.size") - F.col("w.place"))
    met = (F.col("n.gram") == F.col("w.gram")) & (F.col("n.part") == F.col("w.part")) & (most >= sizes * (at / (1 + at)) - 1e-9)
    # A generator of one row: the common trigrams are found once, not again for each column that reads them.
    common = F.explode(F.array(F.array_intersect("n._grams", "w._grams"))).alias("common")
    pairs = n.join(w, met).select("_text", "_plain", "_first", "n.gram", sizes.alias("sizes"), common)
    score = F.size("common") / (F.col("sizes") - F.size("common"))
    scored = pairs.where(F.get("common", F.lit(0)) == F.col("gram")).select("_text", "_plain", "_first", score.alias("score"))
    near = scored.where(F.col("score") >= at).withColumn("distance", F.levenshtein("_plain", "_text"))
    best_first = Window.partitionBy("_text").orderBy(F.desc("score"), "distance", "_first")
    return near.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= max_results).drop("_first", "place")


def in_rounds(
    queries: DataFrame, names_of: Callable[[DataFrame, float], Names], on: str, key: str, query_key: str, query: str,
    attributes: tuple[str, ...], least: float, max_results: int, path: str,
) -> DataFrame:
    """The best of each query, of similarity ``least`` or more; equal query texts are searched for once.

    A query with ``max_results`` matches at a high similarity has its best ones, whatever lies below.
    So only the others go on to the next of ``ROUNDS``, where texts meet on more and commoner trigrams.
    ``names_of`` gives the names that the queries left may match at a similarity.
    """
    asked = queries.select(query_key, query, plain(F.col(query)).alias("_text"))
    asked = asked.where(F.col(query_key).isNotNull() & F.col("_text").isNotNull())
    left, found = written(asked.select("_text").distinct(), f"{path}/left"), None
    best_first = Window.partitionBy("_text").orderBy(F.desc("score"), "distance", key)
    for at in [*(at for at in ROUNDS if at > least), least]:
        names = names_of(left, at)
        rows = near_texts(left, names, at, max_results, f"{path}/shared-{at}").join(names.rows, "_plain").withColumn("rank", F.row_number().over(best_first))
        rows = rows.where(F.col("rank") <= max_results).select("_text", key, on, *attributes, "score", "distance", "rank")
        rows = written(rows, f"{path}/found-{at}")
        full = rows.where(F.col("rank") == max_results).select("_text")
        kept = rows.join(full, "_text", "left_semi") if at > least else rows
        found = kept if found is None else found.unionByName(kept)
        if at > least:
            left = written(left.join(full, "_text", "left_anti"), f"{path}/left-{at}")
            if left.isEmpty():
                break
    return asked.join(found, "_text").select(query_key, query, key, on, *attributes, "score", "distance", "rank")


#: Below this share of common trigrams, a name is another name.
LEAST_SCORE = 0.2


def best_issuer(positions: DataFrame, term: str) -> DataFrame:
    """The issuer that matches a term best; none if none comes near."""
    found = fuzzy_search(positions, [term], max_results=1)
    return found.where(F.col("score") >= LEAST_SCORE).select("issuer")


def positions_of(positions: DataFrame, term: str) -> DataFrame:
    """All positions of the best matching issuer."""
    return positions.where(F.col("issuer") == best_issuer(positions, term).scalar())
