"""Exact duplicates by deterministic block naming.

The UTF-8 bytes of a text are cut into blocks of fixed size. Distinct blocks are sorted and numbered;
the number is a block's name, and equal names mean equal blocks. Then adjacent names are paired, the
distinct pairs sorted and numbered, and so on until one name stands for the whole text. Texts are
equal exactly if both the number of blocks and the name are.

Blocks move to be named once, and only as distinct blocks: they are grouped by a 64-bit hash with
their least and greatest text, which are the same unless the hash collides. The rows of documents
carry hashes and names only. Blocks of colliding hashes are named by their text itself.

Names are given within the partitions of one written table, so a lost executor can't change them. A
text that a third of all rows share is one row per task before the shuffle; rows meet their names in
joins of two written tables, whose hot keys Spark splits.

Null texts are empty, and empty texts are equal. Of equal texts the row with the largest ``doc_id``
stays; null ids come last, and of several rows with that id one stays. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import keep_rows, store, text_of

BLOCK_BYTES = 16_384


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """A written table of distinct rows with a name each: sorted, then numbered, part by part."""
    return store(df.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()), "names")


def block(size: int) -> Column:
    return F.expr(f"substring(raw, at * {size} + 1, {size})")


def blocks_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, sha, n, row, at, block) with a block per row."""
    raw = docs.select("doc_id", text_of().cast("binary").alias("raw")).withColumn("row", F.monotonically_increasing_id())
    n = F.greatest(F.lit(1), F.ceil(F.length("raw") / F.lit(size))).cast("int")
    parted = raw.withColumn("n", n).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return parted.select(
        "doc_id", "row", "n", "at", block(size).alias("block"),
        F.when(F.col("at") == 0, F.sha2("raw", 256)).alias("sha"),
    )


def first_names(docs: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, sha, n, at, name): every document's blocks under their names."""
    hashed = blocks_of(docs, size).withColumn("h", F.xxhash64("block"))
    found = (
        hashed.groupBy("h")
        .agg(F.min("block").alias("block"), F.max("block").alias("other"))
        .sortWithinPartitions("block")
        .select("h", F.monotonically_increasing_id().alias("name"), (F.col("block") != F.col("other")).alias("clash"))
    )
    names = store(found, "names")
    clashes = names.where("clash").select("h", "clash")
    if clashes.isEmpty():
        return store(hashed.drop("block"), "blocks").join(names.select("h", "name"), "h").drop("h")
    marked = hashed.join(clashes, "h", "left").withColumn("block", F.when(F.col("clash"), F.col("block")))
    rows = store(marked, "blocks")
    by_hash = rows.where("clash is null").join(names.select("h", "name"), "h")
    # Negative names can't meet those given above.
    texts = numbered(rows.where("clash").select("block").distinct(), "block").withColumn("name", -1 - F.col("name"))
    by_text = rows.where("clash").join(texts, "block")
    columns = ["row", "doc_id", "sha", "n", "at", "name"]
    return by_hash.select(*columns).unionByName(by_text.select(*columns))


def identities(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, sha, n, name): texts are equal if ``n`` and ``name`` are."""
    names = store(first_names(docs, size), "level")
    done = names.where("n = 1").select("row", "doc_id", "sha", "n", "name")
    heads = names.where("n > 1 and at = 0").select("row", "doc_id", "sha", "n")
    level = names.where("n > 1").select("row", "n", "at", "name", F.col("n").alias("left"))
    ended = None
    while not level.isEmpty():
        half = F.floor(F.col("at") / 2)
        pairs = store(
            level.groupBy("row", "n", "left", half.alias("at")).agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"),
            ).withColumn("b", F.coalesce("b", F.lit(-(1 << 62)))),
            "pairs",
        )
        names = numbered(pairs.select("a", "b").distinct(), "a", "b")
        level = store(
            pairs.join(names, ["a", "b"]).select("row", "n", "at", "name", F.ceil(F.col("left") / 2).alias("left")),
            "level",
        )
        whole = level.where("left = 1").select("row", "name")
        ended = whole if ended is None else ended.unionByName(whole)
        level = level.where("left > 1")
    return done if ended is None else done.unionByName(heads.join(ended, "row").select("row", "doc_id", "sha", "n", "name"))


def duplicate_groups(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document."""
    rows = store(identities(docs, size), "identities")
    last = F.struct(F.col("doc_id"), F.col("row"))
    groups = store(
        rows.groupBy("n", "name").agg(F.max(last).alias("last"), F.count("*").alias("group_size")).where("group_size > 1"),
        "groups",
    )
    many = rows.join(groups, ["n", "name"], "left")
    single = F.col("group_size").isNull()
    return many.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("last.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """One document of each group of equal texts, with its own columns.

    Rows that also share their id are told apart by nothing but place; of those, one stays.
    """
    marked = duplicate_groups(docs, size).groupBy("doc_id", F.col("text_sha256").alias("sha"))
    kept = marked.agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept")
    return keep_rows(docs, kept.drop("kept"))
