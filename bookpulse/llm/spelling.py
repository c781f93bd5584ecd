"""Spelling variants: words one edit apart, found by pivotal grams.

``near_pairs`` finds all pairs of words with edit distance one (an inserted, deleted or replaced code
point):

1. Bigrams are ordered by in how many words they are, the rarest first. A word's prefix is its first
   three grams in that order, with their positions; further places of the last of them belong to it.
2. Dynamic programming over positions picks the word's pivots: two grams of the prefix that don't
   overlap, together in the fewest words.
3. One edit leaves one of two disjoint grams whole. So of two near words, the one whose prefix ends
   earlier in the order has a pivot that is in the other's prefix at the place the edit leaves it.
4. Position limits: the edit lies wholly before or wholly after that gram. If after, both words are
   the same up to the gram, which is at the same place; if before, they are the same from there on,
   and the places differ by one at most, as the lengths do. The other side has but one edit, so one of
   its halves is the same too. Pivots and prefixes are joined on the gram with that equal side and
   half, so only words that share all three meet.
5. Spark's ``levenshtein`` verifies what meets, in the join itself.

The join is on a 64-bit number of these and the gram's place; words that only share the number fail the
verification. Nothing is gathered by key, so Spark can split a key that very many words share.

``variant_counts`` counts words of texts. Null texts have none and null ids count as empty texts; a
document of any length is read whole, and repeated rows count as often as they occur. Ties between
near words of equal count go to the smallest in code-point order. Extra columns are not looked at,
whatever their names. Empty tables give no rows. In ``variant_groups`` null words are left out and
counts of a repeated word add up. Words of up to ``SHORT`` code points, which may be too short for two
pivots, also meet by what is left when one code point is dropped.
"""

from __future__ import annotations

from bisect import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import map_rows, store, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Grams of a prefix, and the greatest length at which a near word may have fewer grams.
PREFIX, SHORT = 3, 4
#: A form is so many times as frequent as its variant.
MORE = 5


def variant_counts(docs: DataFrame, one_in: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): lower-cased letter runs of all texts; a checksum of id and run drops a letter of some.

    Runs shorter than the least length are left out before anything moves: a dropped letter only
    makes them shorter.
    """
    run = F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    runs = docs.select(ident, run).where(F.char_length("run") >= least_length)
    lower = runs.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    sums = lower.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = sums.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return (
        words.groupBy("word").agg(F.count("*").alias("n"))
        .where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))
    )


def grams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix(found: list[str], order: dict[str, int]) -> list[int]:
    """Positions of the rarest grams: three of them, and the other places of the last."""
    ranked = sorted(range(len(found)), key=lambda i: (order[found[i]], i))
    last = order[found[ranked[PREFIX - 1]]]
    return ranked[: bisect(ranked, last, key=lambda i: order[found[i]])]


def pivots(places: list[int], cost: list[float]) -> tuple[int, int]:
    """Of the places, two that are at least two apart, of least cost together.

    ``one`` is the cheapest place so far, ``free`` the cheapest that doesn't overlap the next one.
    Any three places hold such a pair.
    """
    best: tuple[float, int, int] | None = None
    one: list[tuple[float, int]] = []  # cheapest of the first k places
    for k, p in enumerate(places):
        free = k - 1 if k and places[k - 1] < p - 1 else k - 2
        if free >= 0:
            c, other = one[free]
            if best is None or c + cost[k] < best[0]:
                best = (c + cost[k], other, p)
        one.append(min(one[-1], (cost[k], p)) if one else (cost[k], p))
    assert best is not None
    return best[1], best[2]


def index_keys(word: str, at: int) -> list[int]:
    """What a near word has in common with this one, if the gram stays whole: by where the edit is.

    Each side is halved: an edit behind the gram leaves the first or the last half of what is there.
    """
    gram_end, behind = at + 2, len(word) - at
    half = (len(word) - gram_end) // 2
    ahead = at // 2
    return [
        mark(f"1 {at} {word[: gram_end + half]}"),
        mark(f"2 {at} {word[:gram_end]} {word[gram_end + half :]}"),
        mark(f"3 {behind} {word[ahead:]}"),
        mark(f"4 {behind} {word[:ahead]} {word[at:]}"),
    ]


def probe_keys(word: str, at: int) -> set[int]:
    """The index keys of all words one edit away in which this gram is whole, whatever their length."""
    gram_end, behind, n = at + 2, len(word) - at, len(word)
    out = set()
    for longer in (-1, 0, 1):
        rest, start = n - gram_end + longer, at + longer  # of the other word
        if rest >= 0:
            half = rest // 2
            out.add(mark(f"1 {at} {word[: gram_end + half]}"))
            if rest - half <= n - gram_end:
                out.add(mark(f"2 {at} {word[:gram_end]} {word[n - (rest - half) :]}"))
        if start >= 0:
            ahead = start // 2
            if start - ahead <= at:
                out.add(mark(f"3 {behind} {word[at - (start - ahead) :]}"))
            out.add(mark(f"4 {behind} {word[:ahead]} {word[at:]}"))
    return out


def mark(side: str) -> int:
    """A signed 64-bit number."""
    key = xxhash.xxh64_intdigest(side)
    return key - (1 << 64) if key >> 63 else key


def signature(word: str, rank: dict[str, int], n: list[int]) -> tuple[list[int], list[int]]:
    """The keys by which a word's pivots are indexed, and those by which its prefix finds others."""
    own = grams(word)
    chosen: list[int] = []
    indexed: list[int] = []
    if len(own) >= PREFIX:
        places = sorted(prefix(own, rank))
        two = pivots(places, [n[rank[own[p]]] for p in places])
        chosen = [key for p in two for key in index_keys(word, p)]
        indexed = [key for p in places for key in probe_keys(word, p)]
    if len(word) <= SHORT:
        less = [mark(f"-{x}") for x in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}]
        chosen, indexed = chosen + less, indexed + less
    return chosen, indexed


def signatures(words: DataFrame) -> DataFrame:
    """(word, pivot_keys, prefix_keys) of every word.

    The grams' order goes to the tasks: letters of RUN give 8,100 grams at most; a general alphabet
    squares.
    """
    each = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    counted = words.select(F.explode(F.array_distinct(each)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    found = counted.orderBy("n", "gram").toArrow().to_pydict()
    order = {gram: k for k, gram in enumerate(found["gram"])}
    model = words.sparkSession.sparkContext.broadcast((order, found["n"]))

    def rows(texts: list[str]) -> list[list]:
        found = [signature(word, *model.value) for word in texts]
        return [texts, *map(list, zip(*found, strict=True))]

    return map_rows(words, [F.col("word")], "word string, pivot_keys array<long>, prefix_keys array<long>", rows)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of all pairs of distinct words one edit apart, each pair both ways."""
    signed = store(signatures(words), "signatures")
    pivot = signed.select("word", F.explode("pivot_keys").alias("key"))
    other = signed.select(F.col("word").alias("near"), F.explode("prefix_keys").alias("key"))
    apart = F.abs(F.char_length("word") - F.char_length("near")) <= 1
    met = pivot.join(other, "key").where(apart & (F.levenshtein("word", "near", 1) == 1))
    pairs = met.select(F.least("word", "near").alias("a"), F.greatest("word", "near").alias("b")).distinct()
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows of (word, form): forms followed to the last.

    Each round doubles the steps taken. A form is several times as frequent as its word, so chains
    are short and have no circles.
    """
    steps = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        taken = store(
            steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        if taken.where("moved").isEmpty():
            return taken.select("word", "root")
        steps = taken.select("word", "root")


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n)."""
    counted = store(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))
    with_n = near_pairs(counted).join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The least of all near words, as numbers and strings of a struct, merged where they are met.
    near = store(with_n.groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best")), "near")
    joined = counted.join(near, "word", "left")
    taken = -F.col("best.less") >= MORE * F.col("n")
    judged = store(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    followed = roots(judged.where("form is not null"))
    return judged.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
