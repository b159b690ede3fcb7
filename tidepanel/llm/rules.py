"""Quality rules as weak supervision, in DataFrame and SQL functions alone.

Every rule votes good, bad or abstains on each document. Expectation-maximisation over the counts of vote patterns
estimates the accuracies of each rule (one on good and one on bad documents, as a rule that spots one fault says
little by its silence) and the share of good documents, and a document's posterior probability of being good, not a
chain of filters, decides. There are at most 3^8 patterns however large the corpus; they are
counted map-side, folded in one row, and joined back by their code.

Null texts count as empty: no words, base failed, not kept. Repeated rows get equal verdicts. An empty table gives
an empty table. Input columns that carry a name this operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Shortest document, in words, and largest share of words in repeated 3-word windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Where expectation-maximisation starts: the share of good documents, a rule's accuracy on good and on bad ones.
SHARE, ON_GOOD, ON_BAD = 0.8, 0.995, 0.1
#: Its rounds, and the ranges of these three.
ROUNDS, SHARE_RANGE, GOOD_RANGE, BAD_RANGE = 20, (0.01, 0.99), (0.97, 0.999), (0.05, 0.95)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
          "n_lettered")
#: (name, condition of a bad vote, condition of a good vote) over the counts, in SQL that Spark and others share.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words",
     "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("lines", "n_lines > 1 AND 10 * n_dup_lines > 3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    ("repetition", "2 * n_repeat_words > n_words", "5 * n_repeat_words <= n_words"),
    ("letters", "10 * n_letters < 8 * word_chars", "10 * n_letters >= 9 * word_chars"),
    ("lettered_words", "4 * n_lettered < 3 * n_words", "10 * n_lettered >= 9 * n_words"),
    ("capitals", "10 * n_upper > 4 * n_letters", "20 * n_upper <= 3 * n_letters"),
)


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    df = df.drop(*COUNTS).withColumn("__w", words)
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.struct(
        F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("__s", F.when(F.size("__w") > 3, F.array_sort(windows)))
    # In order of their hash, equal windows are neighbours.
    again = F.filter("__s", lambda x, k: (x.h == F.get("__s", k - 1).h) | (x.h == F.get("__s", k + 1).h))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.withColumn("__l", lines)
    long = lambda c: c.cast("long")
    return df.withColumns({
        "n_words": long(F.size("__w")), "word_chars": long(F.length(F.array_join("__w", ""))),
        "n_symbols": long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))),
        "n_dup_lines": long(F.size("__l") - F.size(F.array_distinct("__l"))),
        "n_repeat_words": long(F.coalesce(F.size(covered), F.lit(0))),
        "n_lines": long(F.size("__l")),
        "n_letters": long(F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))),
        "n_lettered": long(F.regexp_count(text, F.lit(r"\p{L}[^ \t-\r]*"))),
        "n_upper": long(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))),
    }).drop("__w", "__s", "__l")


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def votes() -> Column:
    """1 good, 0 bad, -1 abstains, for each rule."""
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END") for _, bad, good in RULES])


def _posterior(v: Column, state: Column) -> Column:
    both = F.arrays_zip(v.alias("v"), state.good.alias("g"), state.bad.alias("b"))
    total = F.aggregate(both, F.log(state.share / (1 - state.share)), lambda s, x: s + F.when(
        x.v == 1, F.log(x.g / (1 - x.b))).when(x.v == 0, F.log((1 - x.g) / x.b)).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-total))


def _within(x: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(x, F.lit(bounds[0])), F.lit(bounds[1]))


def fitted(patterns: DataFrame) -> DataFrame:
    """One row (share, good, bad) from rows (votes, n): the rounds of expectation-maximisation as one fold."""
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    start = F.struct(F.lit(SHARE).alias("share"), F.array(*[F.lit(ON_GOOD)] * len(RULES)).alias("good"),
                     F.array(*[F.lit(ON_BAD)] * len(RULES)).alias("bad"))

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + value(x))

    def step(state: Column, _) -> Column:
        rows = F.transform("p", lambda x: F.struct(
            x.votes.alias("v"), x.n.cast("double").alias("n"), _posterior(x.votes, state).alias("q")))

        def maximised(rows: Column) -> Column:
            def accuracy(j: int, vote: int, weight, start: float, bounds) -> Column:
                voted = total(rows, lambda x: F.when(F.get(x.v, F.lit(j)) >= 0, weight(x)).otherwise(0.0))
                right = total(rows, lambda x: F.when(F.get(x.v, F.lit(j)) == vote, weight(x)).otherwise(0.0))
                return F.when(voted > 0, _within(right / voted, bounds)).otherwise(F.lit(start))

            good = [accuracy(j, 1, lambda x: x.n * x.q, ON_GOOD, GOOD_RANGE) for j in range(len(RULES))]
            bad = [accuracy(j, 0, lambda x: x.n * (1 - x.q), ON_BAD, BAD_RANGE) for j in range(len(RULES))]
            share = total(rows, lambda x: x.n * x.q) / total(rows, lambda x: x.n)
            return F.struct(_within(share, SHARE_RANGE).alias("share"), F.array(*good).alias("good"),
                            F.array(*bad).alias("bad"))

        return F.get(F.transform(F.array(rows), maximised), F.lit(0))   # bind rows once

    return one.where(F.size("p") > 0).select(
        F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("s")).select("s.share", "s.good", "s.bad")


def judge(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the counts, ``posterior`` (probability of being good), ``base_failed`` and ``kept``.

    The counts are stored once and read twice; with ``keep_text=False`` the text is not stored with them.
    """
    df = df.drop("posterior", "base_failed", "kept", "__votes")
    rows = counted(df, text_col)
    if not keep_text:
        rows = rows.drop(text_col)
    rows = stored(rows.withColumn("__votes", F.array_join(votes(), ",")), "rules")
    # Documents that fail the base are decided; the model is about the others.
    patterns = rows.where(~base_failed()).groupBy("__votes").agg(F.count("*").alias("n")).withColumn(
        "votes", F.split("__votes", ",").cast("array<int>"))
    scored = patterns.join(F.broadcast(fitted(patterns)))   # one row
    scored = scored.select("__votes", _posterior(F.col("votes"), F.struct("share", "good", "bad")).alias("posterior"))
    # At most 3^8 patterns, whatever the input.
    return rows.join(F.broadcast(scored), "__votes", "left").drop("__votes") \
        .withColumn("base_failed", base_failed()).withColumn(
            "posterior", F.when(F.col("base_failed"), 0.0).otherwise(F.col("posterior"))) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def sql() -> str:
    """DuckDB SQL of the verdicts on ``documents``."""
    names = [r[0] for r in RULES]
    case = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS {n}" for n, bad, good in RULES)
    parts = [f"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(x, chr(10)), lambda z: regexp_matches(z, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
f AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
 length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
 coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
 length(regexp_replace(x, '[^\\p{{L}}]', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
 len(regexp_extract_all(x, '\\p{{L}}[^\\x20\\x09-\\x0D]*'))::BIGINT AS n_lettered
 FROM t JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)),
v AS MATERIALIZED (SELECT *, {case} FROM f),
pat AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM v WHERE NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) GROUP BY ALL),
s0 AS (SELECT {SHARE}::DOUBLE AS share, {', '.join(f'{ON_GOOD}::DOUBLE AS g_{n}, {ON_BAD}::DOUBLE AS b_{n}' for n in names)})"""]
    for k in range(1, ROUNDS + 2):
        odds = " + ".join(f"CASE {n} WHEN 1 THEN ln(g_{n} / (1 - b_{n})) WHEN 0 THEN ln((1 - g_{n}) / b_{n}) ELSE 0 END"
                          for n in names)
        parts.append(f"p{k} AS MATERIALIZED (SELECT pat.*, 1 / (1 + exp(-(ln(share / (1 - share)) + {odds}))) AS q FROM pat, s{k - 1})")
        if k <= ROUNDS:
            acc = ", ".join(
                f"coalesce(least(greatest(sum(CASE WHEN {n} = {vote} THEN {w} END) / nullif(sum(CASE WHEN {n} >= 0 THEN {w} END), 0), "
                f"{lo}::DOUBLE), {hi}::DOUBLE), {start}::DOUBLE) AS {c}_{n}" for n in names for c, vote, w, start, (lo, hi) in
                (("g", 1, "n * q", ON_GOOD, GOOD_RANGE), ("b", 0, "n * (1 - q)", ON_BAD, BAD_RANGE)))
            parts.append(f"s{k} AS MATERIALIZED (SELECT least(greatest(sum(n * q) / sum(n), {SHARE_RANGE[0]}::DOUBLE), "
                         f"{SHARE_RANGE[1]}::DOUBLE) AS share, {acc} FROM p{k})")
    return ",\n".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
 NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND coalesce(q, 0) >= 0.5 AS kept
FROM v LEFT JOIN p{ROUNDS + 1} USING ({', '.join(names)})"""
