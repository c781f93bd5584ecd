"""A stored search index over a table of names that is kept by change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.functions.text import pieces, plain
from bookpulse.operators.search import Names, by_text, in_rounds, written
from bookpulse.session import work_dir
from bookpulse.streaming.keyed import KeyedTable, Sequence
from bookpulse.streaming.sinks import batch_key, read_if_there


#: Texts whose postings one task makes and sorts, about.
TEXTS = 200_000


class NameIndex:
    """Trigram postings of names, in folders by a hash of the trigram.

    A change writes a segment: the new names, each of their texts once with its first key, the postings of
    these keys, the other keys of a text in folders by the first one, and how many texts have each trigram.
    Every ``compact`` changes the current names become a new base. A search takes the rarest trigrams
    of each query, so many that a name of similarity ``least`` has one of them, and reads their
    folders only; the keys of the texts found are looked up in their folders and scored. Old postings of a
    name that changed or left only give a candidate more, since the current name is scored. A trigram
    that most names share is neither read nor joined on, unless a query has no rarer ones.
    """

    def __init__(self, path: str, key: str = "position_id", kind: str = "long", name: str = "issuer", folders: int = 64, compact: int = 8):
        self.key, self.name, self.folders, self.compact = key, name, folders, compact
        self.names = KeyedTable(f"{path}/names", key, f"{key} {kind}, {name} string", folders, compact)
        self.postings, self.counts, self.texts, self.copies = (f"{path}/{part}" for part in ("postings", "counts", "texts", "copies"))
        self.posting_fields = f"gram string, {key} {kind}, grams int, seq long, folder int"
        self.copy_fields = f"first {kind}, {key} {kind}, seq long, folder int"
        self.sequence = Sequence(f"{path}/log")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.change(batch, batch_key(batch, batch_id))

    def change(self, rows: DataFrame, batch: str) -> None:
        """New, changed and (where a column ``gone`` is true) leaving names; of rows with one key any one counts.

        A batch that runs again writes the same segment again.
        """
        spark = rows.sparkSession
        seq, _ = self.sequence.next(spark, batch)
        gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
        once = rows.select(self.key, self.name, gone.alias("gone")).where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        self.names.change(once, seq)
        if (seq + 1) % self.compact:
            self._segment(self.names.changed(spark, seq).where(~F.col("gone")), "changes", seq)
        else:
            self._segment(self.names.base(spark, seq), "base", seq)
        self.sequence.done(spark, seq, batch, None)

    def _folder(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.folders)).cast("int")

    def _segment(self, names: DataFrame, part: str, seq: int) -> None:
        spark, segment = names.sparkSession, f"{part}/seq={seq}"
        names = names.select(self.key, plain(F.col(self.name)).alias("text")).where(F.col("text").isNotNull())
        texts = names.groupBy("text").agg(F.min(self.key).alias("first"), F.count("*").alias("n"))
        texts = written(texts, f"{self.texts}/{segment}")
        # A text is moved, if need be, before it becomes many postings; each task writes its part of the folders.
        tasks = -(-texts.count() // TEXTS)
        dealt = texts.repartition(tasks) if tasks > spark.sparkContext.defaultParallelism else texts
        each = dealt.select(F.col("first").alias(self.key), pieces(F.col("text")).alias("all"))
        each = each.select(F.explode("all").alias("gram"), self.key, F.size("all").alias("grams")).withColumn("folder", self._folder("gram"))
        self._write(each.sortWithinPartitions("folder", "gram", self.key), f"{self.postings}/{segment}")
        posted = spark.read.schema("gram string").parquet(f"{self.postings}/{segment}")
        posted.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.counts}/{segment}")
        many = texts.where("n > 1")
        if not many.isEmpty():
            copies = names.join(many, "text").where(F.col(self.key) != F.col("first")).select("first", self.key)
            copies = copies.withColumn("folder", self._folder("first")).hint("rebalance", "folder")
            self._write(copies.sortWithinPartitions("folder", "first", self.key), f"{self.copies}/{segment}")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(path)

    def _parts(self, spark: SparkSession, path: str, fields: str) -> DataFrame:
        """The newest base and the changes after it."""
        base, upto = read_if_there(spark, f"{path}/base", fields), -1
        if base is not None:
            upto = base.agg(F.max("seq")).first()[0]  # of folder names
            upto = -1 if upto is None else upto
        changes = read_if_there(spark, f"{path}/changes", fields)
        parts = [p for p in (base.where(F.col("seq") == upto) if base is not None else None, changes) if p is not None]
        if not parts:
            return spark.createDataFrame([], fields)
        return parts[0].where(F.col("seq") >= upto) if len(parts) == 1 else parts[0].unionByName(parts[1].where(F.col("seq") > upto))

    def posted(self, spark: SparkSession, grams: DataFrame) -> DataFrame:
        """The postings in the folders of some trigrams."""
        folders = [r.folder for r in grams.select(self._folder("gram").alias("folder")).distinct().collect()]  # at most ``folders``
        return self._parts(spark, self.postings, self.posting_fields).where(F.col("folder").isin(folders))

    def keys_of(self, firsts: DataFrame) -> DataFrame:
        """The keys of the texts that (first, seq) stand for, read from their folders only."""
        spark = firsts.sparkSession
        folders = [r.folder for r in firsts.select(self._folder("first").alias("folder")).distinct().collect()]  # at most ``folders``
        copies = self._parts(spark, self.copies, self.copy_fields).where(F.col("folder").isin(folders))
        same = copies.join(firsts, ["first", "seq"]).select(self.key)
        return firsts.select(F.col("first").alias(self.key)).unionByName(same)

    def rarest(self, asked: DataFrame, query_key: str, least: float) -> DataFrame:
        """(query_key, size, gram): as many of the rarest trigrams of each query as a match can't do without."""
        counts = self._parts(asked.sparkSession, self.counts, "gram string, n long, seq long").groupBy("gram").agg(F.sum("n").alias("n"))
        each = asked.select(query_key, F.size("_asked").alias("size"), F.explode("_asked").alias("gram")).join(counts, "gram", "left")
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))  # of one query's text
        # The small term keeps a product like 0.3 * 10 from being rounded up.
        wanted = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
        first = each.groupBy(query_key, "size").agg(ordered.alias("all")).select(query_key, "size", F.slice("all", F.lit(1), wanted).alias("some"))
        return first.select(query_key, "size", F.explode("some.gram").alias("gram"))

    def search(
        self, queries: DataFrame, query_key: str = "query_id", query: str = "query", least: float = 0.3, max_results: int = 10
    ) -> DataFrame:
        """As ``search_table`` over the current names. Query keys are distinct.

        Each round reads the folders of the trigrams that its similarity asks for.
        """
        spark = queries.sparkSession
        path = work_dir(spark, "search")

        def names_of(left: DataFrame, at: float) -> Names:
            first = self.rarest(left.withColumn("_asked", pieces(F.col("_text"))), "_text", at)
            sizes = written(first.groupBy("gram").agg(F.min("size").alias("low"), F.max("size").alias("high")), f"{path}/grams-{at}")
            fits = (F.col("grams") >= F.col("low") * at - 1e-9) & (F.col("grams") * at - 1e-9 <= F.col("high"))
            firsts = self.posted(spark, sizes).join(sizes, "gram").where(fits).select(F.col(self.key).alias("first"), "seq").distinct()
            found = self.names.lookup(self.keys_of(written(firsts, f"{path}/firsts-{at}")))
            return by_text(found, self.name, self.key, max_results, f"{path}/names-{at}")

        return in_rounds(queries, names_of, self.name, self.key, query_key, query, (), least, max_results, path)
