"""Groups of spelling variants: words within one edit of each other, found through pivotal grams.

Every word's bigrams are put in one global order, rarest first. A word's gram prefix is its three first ones (and those
that tie with the third): one edit breaks at most two bigrams that overlap. Its pivots are the two disjoint grams of
the prefix with the least total frequency, chosen by dynamic programming over positions. One edit breaks at most one
of two disjoint grams, so that of two words within one edit, the one whose prefix ends first in the global order has a
whole pivot in the other's prefix. Position limits say where: if the edit lies behind the first pivot, that pivot
stands at the same distance from the front in both words, with equal text before it; otherwise the second stands at
the same distance from the end, with equal text behind it. Pivots are therefore joined with the other words' prefixes on gram,
side, distance and a hash of the text outside, and the pairs are verified by their edit distance in the join.

Everything is a DataFrame plan in the JVM. Occurrences are counted map-side before they are shuffled. There are at
most 90 * 90 different bigrams of these letters, so that their frequencies are broadcast. Links are followed by
pointer doubling: occurrences grow along a chain, so that chains are short and have no circles. A word that many others
point to is on the larger side of a join that adaptive execution may split.

Null texts and texts without letters hold no words. A null id counts as the empty text in the checksum. Repeated rows
count again. Very long texts and words are taken whole. An empty table gives no words. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def occurrences(docs: DataFrame, least_length: int = 6, every: int = 199, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """word and n: letter runs of at least ``least_length`` code points, A-Z lower-cased. Where ``every`` divides the
    checksum of id and run, the run has lost the code point at the checksum's remainder (0: no run has)."""
    # A greedy run of at least so many letters that begins at the first place it can is a whole run.
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(
        F.col(f"`{text_col}`"), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    if every:
        crc = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = F.pmod(F.col("crc"), F.length("run")).cast("int")
        runs = runs.withColumn("crc", crc).withColumn("run", F.when(F.col("crc") % every == 0, F.concat(
            F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")))
        runs = runs.where(F.length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))


def _pivots(prefix: Column) -> Column:
    """The two disjoint grams of least total frequency: a scan over positions that holds the cheapest gram that ends
    before the last one seen, that last one, and the cheapest pair so far."""
    gram = "struct<freq: bigint, gram: string, pos: int>"
    null = F.lit(None).cast(gram)
    start = F.struct(null.alias("free"), null.alias("last"), F.lit(None).cast("bigint").alias("cost"),
                     null.alias("a"), null.alias("b"))

    def step(held: Column, x: Column) -> Column:
        # array_min skips nulls; structs compare by frequency first.
        clear = F.when(held["last"]["pos"] <= x["pos"] - 2, held["last"])
        first = F.array_min(F.array(held["free"], clear))
        cost = first["freq"] + x["freq"]
        better = cost.isNotNull() & (held["cost"].isNull() | (cost < held["cost"]))
        pick = lambda new, old: F.when(better, new).otherwise(held[old])
        return F.struct(F.array_min(F.array(held["free"], held["last"])).alias("free"), x.alias("last"),
                        pick(cost, "cost").alias("cost"), pick(first, "a").alias("a"), pick(x, "b").alias("b"))

    by_place = F.array_sort(prefix, lambda x, y: x["pos"] - y["pos"])
    return F.aggregate(by_place, start, step)


def grams(words: DataFrame) -> DataFrame:
    """word, n, prefix (grams with frequency and place, rarest first), its last gram, and the pivots a and b."""
    split = words.select("word", "n", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pos", "gram"))
    # At most 90 * 90 rows, as words are runs of 90 letters.
    freq = split.groupBy("gram").agg(F.count("*").alias("freq"))
    held = split.join(F.broadcast(freq), "gram").groupBy("word", "n").agg(
        F.array_sort(F.collect_list(F.struct("freq", "gram", "pos"))).alias("grams"))
    third = F.col("grams")[2]
    last = F.struct(third["freq"].alias("freq"), third["gram"].alias("gram"))
    held = held.withColumn("last", last).withColumn("prefix", F.filter(
        "grams", lambda x: F.struct(x["freq"], x["gram"]) <= F.col("last")))
    return held.select("word", "n", "last", "prefix", _pivots(F.col("prefix")).alias("p")).select(
        "word", "n", "last", "prefix", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every two words within one edit, both ways round. Words have at least four letters."""
    known = common.stored(grams(words), "grams")

    def entry(x: Column, side: int) -> Column:
        """Gram, side, distance from that side and what lies outside."""
        word, pos = F.col("word"), x["pos"]
        outside = F.substring(word, F.lit(1), pos - 1) if side == 0 else F.substring(word, pos + 2, F.length("word"))
        distance = pos if side == 0 else F.length("word") - pos
        return F.struct(x["gram"].alias("gram"), F.lit(side).alias("side"), distance.alias("distance"),
                        F.xxhash64(outside).alias("outside"))

    asked = known.select("word", "n", "last", F.explode(F.array(entry(F.col("a"), 0), entry(F.col("b"), 1))).alias("e")) \
        .select("e.*", "word", "n", "last")
    held = known.select("word", "n", "last", F.explode(F.concat(
        F.transform("prefix", lambda x: entry(x, 0)), F.transform("prefix", lambda x: entry(x, 1)))).alias("e")) \
        .select("e.*", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    found = asked.join(held, ["gram", "side", "distance", "outside"]).where(
        (F.col("word") != F.col("other")) & (F.col("last") <= F.col("other_last"))
        & (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1))
    found = found.select("word", "n", "other", "other_n")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n"))).distinct()


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n)."""
    words = common.stored(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    found = found.withColumn("form_n", F.when(F.col("form_n") >= times * F.col("n"), F.col("form_n")))
    found = common.stored(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(
        F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n"), "forms")
    # Pointer doubling: a word's root is that of its form; n grows at least ``times``-fold with each link.
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = common.stored(stepped, "roots")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    out = found.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
