"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base matches of four kinds (email, ip, card, phone) are checked; those that pass are the seeds. Beside
them, identifier-like strings that meet no seed in the text (a word with a digit or ``@``, or the groups of
digits of one number, trimmed of punctuation, with ``@`` or at least ``DIGITS`` digits) are the other
instances. The words around an instance in the text are its patterns: the two words before, and the word
before with the word after, digits in them alike. Instances have any length; those over ``LONGEST``
characters go by their digest in the graph.

Patterns and instances score each other over all documents. A pattern's score for a kind is the sum of
its instances' scores over their number plus ``DOUBT``; it counts from ``SUPPORT`` seeds' worth. An
instance's score is one less the product of what its patterns leave open. After ``ROUNDS`` rounds,
instances from ``ACCEPT`` on are identifiers, and each of their occurrences is a span of that kind.
Base spans always stay.

Patterns and instances meet as distinct pairs, so a context or a string that a third of all rows share
is one row per task before it moves; scores are written tables, and Spark splits the joins with them.

Positions are code points. They come from the lengths of what lies between matches: ``split`` and
``regexp_extract_all`` find the same matches. The patterns are written with possessive loops, which
find what the plain ones find, but neither recurse nor go back in long texts.

Null and empty texts have no spans, and an empty table no rows. An instance as well known in two kinds is
of the kind last in the alphabet. Only doc_id and text are read, so other columns may have any names. Rows with equal or null ids are documents of their own. Only the
context is cut (to ``AROUND`` characters on either side); matches are over whole texts. Matches of one document
are put in order by a window over that document, which spills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import store, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A match that begins inside a run of local characters begins at its start, or where the last one ended.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
REGEX = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
TOKEN = r"[^\s0-9@]*+[0-9@]\S*+"
#: Where a group of digits ends: before a blank or the end, or before the punctuation of a sentence.
ENDED = r"(?=[.,;:!?]*+(?!\S))"
NUMBER = rf"[+(]*+[0-9][0-9()]*+{ENDED}(?:\x20[0-9()]++{ENDED})*+"
RUN = rf"(?<!\S)(?:{NUMBER}|{TOKEN})"

LONGEST, DIGITS, AROUND = 64, 5, 64
DOUBT, SUPPORT, ROUNDS, TRUSTED, ACCEPT = 2.0, 5.0, 3, 0.6, 0.8


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def passes_luhn(number: Column) -> Column:
    """Whether digits pass the check: from the right, every second one is doubled, less 9 if above 9."""
    n = F.length(number)

    def part(k: Column) -> Column:
        digit = F.substring(number, n - k, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(k % 2 == 0, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + part(k))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a base match is one of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        low = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
        small = lambda part: F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(value, r"\."), lambda part: low(part) & small(part))
    number = digits(value)
    if kind == "phone":
        return F.length(number).between(10, 15)
    return F.when(F.length(number).between(14, 19), passes_luhn(number)).otherwise(False)


def may_have(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match meets."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")),
        "card": F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9][0-9\x20-]{11}")),
        "phone": F.contains(text, F.lit("+")),
        "run": F.rlike(text, F.lit("[0-9@]")),
    }[kind]


def matches(kind: str, regex: str, text: Column) -> Column:
    """The matches with the length of what lies before each, and the text around."""
    between, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    none = F.array(F.lit(""))

    def near(one: Column, side: Callable) -> Column:
        return side(F.coalesce(one, F.lit("")), F.lit(AROUND))

    def alike(words: Column) -> Column:
        return F.regexp_replace(F.lower(words), "[0-9]++", "0")

    def before(x: Column) -> Column:
        """The end of what precedes a match: its gap, and the two matches before, which hold two words at least."""
        return alike(F.right(F.concat(*[near(x[c], F.right) for c in ("found2", "gap1", "found1", "gap")]), F.lit(AROUND)))

    def after(x: Column) -> Column:
        """The beginning of what follows a match: the gap after it and the next match."""
        return alike(F.left(F.concat(near(x["gap"], F.left), near(x["found"], F.left)), F.lit(AROUND)))

    # Neighbours come by shifted arrays: a lambda that named the arrays would match again for each element.
    beside = F.arrays_zip(
        between.alias("gap"), found.alias("found"), F.concat(none, between).alias("gap1"),
        F.concat(none, found).alias("found1"), F.concat(none, none, found).alias("found2"),
    )
    made = F.struct(
        F.lit(kind).alias("kind"),
        F.transform(between, lambda x: F.length(x)).alias("gaps"),
        found.alias("values"),
        F.transform(beside, before).alias("left"),
        F.transform(beside, after).alias("right"),
    )
    return F.when(may_have(kind, text), made)


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents (row, doc_id), and all matches (row, kind, start, end, value, before, after)."""
    every = {**REGEX, "run": RUN}
    scanned = store(
        docs.select("doc_id", text_of().alias("text")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.array_compact(F.array(*[matches(kind, regex, F.col("text")) for kind, regex in every.items()])).alias("found"),
        ),
        "matches",
    )
    one = scanned.select("row", F.explode("found").alias("m")).select(
        "row", "m.kind",
        F.posexplode(
            F.transform(
                F.col("m.values"),
                lambda value, k: F.struct(
                    value.alias("value"),
                    F.get(F.col("m.gaps"), k).alias("gap"),
                    F.get(F.col("m.left"), k).alias("before"),
                    F.get(F.col("m.right"), k + 1).alias("after"),
                ),
            )
        ).alias("k", "m"),
    )
    in_order = Window.partitionBy("row", "kind").orderBy("k")
    lengths = F.sum(F.col("m.gap") + F.length("m.value")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    placed = one.select(
        "row", "kind", lengths.alias("end"), "m.value", "m.before", "m.after",
    ).withColumn("start", F.col("end") - F.length("value"))
    return scanned.select("row", "doc_id"), placed


def passed() -> Column:
    """Whether a match is a base match of its kind."""
    return F.coalesce(*[F.when(F.col("kind") == kind, valid(kind, F.col("value"))) for kind in KINDS], F.lit(False))


def instances(placed: DataFrame) -> DataFrame:
    """Seeds and identifier-like strings (row, start, end, value, seed, patterns); ``seed`` is null in the latter."""
    lead = F.length(F.regexp_extract("value", r"^[^0-9A-Za-z@+(]*+", 0))
    bare = F.regexp_replace(F.substring(F.col("value"), lead + 1, F.length("value")), "(?<![^0-9A-Za-z])[^0-9A-Za-z]++$", "")
    run = F.col("kind") == "run"
    seed = F.when(~run, F.col("kind"))
    ordered = Window.partitionBy("row").orderBy("start")
    reached = F.max(F.when(~run, F.col("end"))).over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(~run, F.col("start"))).over(ordered.rangeBetween(0, Window.unboundedFollowing))
    trimmed = (
        placed.where(run | passed())
        .withColumn("core", F.when(run, bare).otherwise(F.col("value")))
        .withColumn("start", F.when(run, F.col("start") + lead).otherwise(F.col("start")))
        .withColumn("end", F.col("start") + F.length("core"))
        .where(~run | F.contains("core", F.lit("@")) | (F.length(digits(F.col("core"))) >= DIGITS))
        .withColumn("met", run & (F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))))
        .where("not met")
    )
    word = r"(\S++)\s*+$"
    one = F.regexp_extract("before", word, 1)
    two = F.regexp_extract("before", r"(\S++\s++\S++)\s*+$", 1)
    after = F.regexp_extract("after", r"^\s*+(\S++)", 1)
    patterns = F.array_compact(F.array(
        F.when(two != "", F.concat(F.lit("2 "), two)),
        F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("1"), one, F.lit("_"), after)),
    ))
    name = F.when(F.length("core") > LONGEST, F.sha2(F.lower("core").cast("binary"), 256)).otherwise(F.lower("core"))
    return trimmed.select("row", "start", "end", name.alias("value"), seed.alias("seed"), patterns.alias("patterns"))


def discovered(found: DataFrame) -> DataFrame:
    """(value, kind) of unseen identifiers, by rounds of scoring over the graph of patterns and instances."""
    pairs = store(found.select(F.explode("patterns").alias("pattern"), "value", "seed").distinct(), "pairs")
    sizes = store(pairs.groupBy("pattern").agg(F.count_distinct("value").alias("n")), "sizes")
    seeds = pairs.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, learned = seeds, None
    for _ in range(ROUNDS):
        worth = pairs.select("pattern", "value").distinct().join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("worth"))
        trusted = store(
            worth.where(F.col("worth") >= SUPPORT).join(sizes, "pattern")
            .withColumn("trust", F.col("worth") / (F.col("n") + DOUBT))
            .where(F.col("trust") >= TRUSTED).select("pattern", "kind", "trust"),
            "trusted",
        )
        learned = store(
            pairs.where("seed is null").join(trusted, "pattern").groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")),
            "learned",
        )
        scores = seeds.unionByName(learned)
    best = learned.groupBy("value").agg(F.max(F.struct("score", F.col("kind"))).alias("best"))
    return best.where(F.col("best.score") >= ACCEPT).select("value", F.col("best.kind").alias("kind"))


def joined(spans: Column) -> Column:
    """Spans as text: by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(parts, ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every document.

    The counts by kind are those of base matches, ``n_spans`` that of all spans.
    """
    rows, placed = occurrences(docs)
    placed = store(placed, "placed")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    base = placed.where(F.col("kind") != "run").where(passed()).select("row", "start", "end", "kind", F.lit(True).alias("base"))
    found = store(instances(placed), "instances")
    more = found.where("seed is null").join(discovered(found), "value").select(
        "row", "start", "end", "kind", F.lit(False).alias("base")
    )
    span = F.struct(F.col("start"), number.alias("kind"), F.col("end"))
    gathered = base.unionByName(more).groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
        F.collect_list(F.when(F.col("base"), span)).alias("base_spans"),
        F.collect_list(span).alias("all_spans"),
    )
    none = F.lit("")
    return rows.join(gathered, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce(joined(F.col("base_spans")), none), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all_spans")), none).alias("spans"),
        F.when(F.col("all_spans").isNull(), 0).otherwise(F.size("all_spans")).cast("long").alias("n_spans"),
    )
