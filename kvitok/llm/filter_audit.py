"""What document filters remove alone, together and in every order, from counts of failed filters.

A document's failed filters are a number of one bit a filter. Documents are counted by part and number,
at most ``2 ** filters`` rows a part, and everything else is arithmetic on those counts: the removal of a
coalition of filters is the count of documents that fail any of them, a step of an order is the difference
of two coalitions, and a filter's Shapley value is the solution of a constrained least squares problem
over all coalitions. Its normal equations depend on the number of filters alone, so they are solved once,
in rationals, for every coalition as right-hand side; the solution is an exact integer combination of removals.

Repeats are found by the SHA-256 of a text: rows are first counted by digest, part and labels, so a group
of copies, however large, is a few rows in the shuffle that compares their smallest ids.

Null texts count as empty, null sources as the part of the empty string. Rows of a null id repeat nothing,
are no original of others and have no labels. Rows that repeat an id count each; of rows that repeat an id
and text none is a repeat of the other. A document is good (toxic) if any label row of its id says so.
Other columns are not read, and an empty table has no parts and so no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.common import table

#: Runs of other characters than white space.
WORD = r"([^\x20\x09-\x0D]+)"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
#: Rows of a null id are dealt over so many values, as they meet no label.
SALTS = 1024

LETTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """The filters that look at one text: few words, few distinct words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), 1)
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, n_good, n_toxic``: documents by the filters they fail, the repeat filter the last bit."""
    text = F.coalesce("text", F.lit(""))
    fails = text_failures(text)
    failed = sum((F.when(ok, 1 << k).otherwise(0) for k, ok in enumerate(fails)), F.lit(0))
    read = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failed.alias("failed"))
    rows = read.groupBy("part", "doc_id", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(is_one("quality"), is_one("toxic"))
    rows = rows.withColumn("_salt", salt).join(judged, (F.col("doc_id") == F.col("_id")) & (F.col("_salt") == 0), "left")

    good, toxic = (F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic"))
    # The smallest id of a group with its rows: they alone can be originals.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = rows.groupBy("digest", "failed", "part", good, toxic).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        least.alias("least"),
    )
    firsts = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    known = groups.join(firsts, "digest")
    own = F.col("n_null") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("failed").alias("failed"), own.alias("n")),
        F.struct((F.col("failed") + (1 << len(fails))).alias("failed"), (F.col("n") - own).alias("n")),
    )
    counted = known.select("part", "quality", "toxic", F.inline(split))
    return counted.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("quality")).alias("n_good"),
        F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"),
    )


def solved(matrix: list[list[Fraction]], sides: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solutions of a regular system for several right-hand sides, by elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(matrix, sides)]
    n = len(rows)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n filters the integers by which coalition removals add up to ``n!`` times its Shapley value.

    Minimises the kernel-weighted squares of ``v(S) - sum of phi in S`` over all proper coalitions S,
    the sum of all phi held at ``v(all)`` by a multiplier, with every v(S) as a right-hand side of its own.
    """
    full = (1 << n) - 1
    weight = {}
    for size in range(1, n):
        for members in combinations(range(n), size):
            weight[sum(1 << i for i in members)] = Fraction(n - 1, comb(n, size) * size * (n - size))
    has = lambda s, i: s >> i & 1
    matrix = [[sum((w for s, w in weight.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    sides = [[weight.get(s, Fraction(0)) * has(s, i) for s in range(full + 1)] for i in range(n)]
    sides.append([Fraction(int(s == full)) for s in range(full + 1)])
    scaled = [[x * factorial(n) for x in row] for row in solved(matrix, sides)[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the normal equations have no whole solution")
    return [[int(x) for x in row] for row in scaled]


def coalition_removals(counts: DataFrame, n: int) -> DataFrame:
    """Per part its size and, for each coalition from 0 to ``2**n - 1``, what it removes: all, good and toxic documents."""
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    lost = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c)
    spread = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    table_ = spread.groupBy("part", "coalition").agg(lost("n"), lost("n_good"), lost("n_toxic"), F.sum("n").alias("size"))
    ordered = F.array_sort(F.collect_list(F.struct("coalition", "n", "n_good", "n_toxic")))
    return table_.groupBy("part").agg(F.max("size").alias("size"), ordered.alias("v"))


def interaction_audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step; a filter's letter stands for its bit in ``failed``."""
    n = len(letters)
    games = coalition_removals(counts, n)
    weights = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in shapley_weights(n)])
    value = lambda w: F.aggregate(F.zip_with(w, F.col("v"), lambda x, s: x * s["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
    games = games.withColumn("values", F.transform(weights, value))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = lambda k: F.instr(F.lit(letters), F.substr("filter_order", k, F.lit(1))) - 1
    bit = lambda k: F.call_function("shiftleft", F.lit(1), at(k).cast("int"))
    earlier = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(n)), 1, F.col("step") - 1), F.lit(0), lambda a, k: a + bit(k))
    steps = steps.select("part", "size", "v", "values", "filter_order", "step", at(F.col("step")).cast("int").alias("i"), bit(F.col("step")).alias("own"), earlier.alias("earlier"))
    v = lambda s, what="n": F.get(F.col("v"), s)[what]
    after = F.col("earlier") + F.col("own")
    every = (1 << n) - 1
    gained = lambda what: v(after, what) - v(F.col("earlier"), what)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("size") - v(after)).alias("kept"),
        gained("n").alias("removed"),
        (v(F.col("own")) - gained("n")).alias("redundant"),
        (v(F.lit(every)) - v(F.lit(every) - F.col("own"))).alias("unique_fails"),
        gained("n_good").alias("good_lost"),
        gained("n_toxic").alias("toxic_lost"),
        F.get("values", F.col("i")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters for every source and all 120 orders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return interaction_audit(failure_counts(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


OP13_SQL = f"""
WITH docs AS (
    SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS first FROM docs GROUP BY t
), judged AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END
        || CASE WHEN docs.doc_id > first THEN 'E' ELSE '' END AS failed
    FROM docs JOIN firsts USING (t) LEFT JOIN judged ON docs.doc_id = judged.doc_id
), counts AS (
    SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
    JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
    SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), marked AS (
    SELECT part, filter_order, step, letter, n, good, toxic, failed = letter AS alone,
        contains(failed, letter) AS own, length(translate(failed, earlier, '')) < length(failed) AS gone
    FROM counts, steps
), audited AS (
    SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM marked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audited
"""
