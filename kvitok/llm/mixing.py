"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the rows over its own number of rows. Each
row's count is the inverse of that Poisson distribution at a uniform number made of the seed and the
row, so it does not depend on partitions or retries. Rows are exploded by their count and put in an
order given by a second hash, over all partitions. Rates are a table joined by source, so the plan is of
one size at any rate and any number of sources.

Sources that the weights do not name have rate 0 where weights are given; without weights all sources
share alike. A null source is a source of its own. Rows with a null id or text, and empty texts, are
mixed as any other. Rows that repeat an id within a source share its number, so all of them
get the same count. Columns named like the working columns are kept, as those have names of their own.
An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kvitok.functions.text import let
from kvitok.llm.common import stored, table

SEED = 17
#: The inverse is built of chunks of a rate, as the sum of Poisson counts is one of the sum of rates.
RATE_STEP = 8.0
#: Counts that a distribution is added up to: above 60 a rate of ``RATE_STEP`` has less than 2**-90.
MOST_COUNT = 60


def uniform(seed: Column, id_column: str) -> Column:
    """In [0, 1): the first 12 hex digits of an MD5 over seed and id."""
    text = F.concat(seed, F.lit(":"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def cumulated(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until the rest is below 2**-50, for a rate up to ``RATE_STEP``."""
    none = F.exp(-rate)

    def step(so_far: Column, k: Column) -> Column:
        total, term = F.element_at(so_far["below"], -1), so_far["term"] * (rate / k)
        more = F.struct(term.alias("term"), F.concat(so_far["below"], F.array(total + term)).alias("below"))
        return F.when(1 - total > 2.0**-50, more).otherwise(so_far)

    start = F.struct(none.alias("term"), F.array(none).alias("below"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_COUNT)), start, step, lambda done: done["below"])


def poisson_inverse(below: Column, parts: Column, seed: Column, id_column: str) -> Column:
    """A row's count: how many values of the cumulated distribution ``below`` lie at or below its number.

    A rate is drawn in ``parts``, each with a number of its own.
    """

    def one(k: Column) -> Column:
        own = F.when(k == 0, seed).otherwise(F.concat(seed, F.lit("."), k.cast("string")))
        return let(uniform(own, id_column), lambda u: F.size(F.filter(below, lambda c: c <= u)))

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, k: n + one(k))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, source: str = "source") -> DataFrame:
    """Of each source the parts that its mean repetitions are drawn in, and their distribution; one grouped count.

    The rates are such that the whole keeps its number of rows. Columns: _mix_source, _mix_parts, _mix_below.
    """
    counts = stored(docs.groupBy(F.col(source).alias("_mix_source")).agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
    n_sources, rows_all = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if weights is None:
        shared, whole = counts.withColumn("share", F.lit(1.0)), float(n_sources)
    else:
        schema = StructType([StructField("_mix_named", docs.schema[source].dataType), StructField("share", DoubleType())])
        named = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], schema)
        shared = counts.join(named, F.col("_mix_source").eqNullSafe(F.col("_mix_named")), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        # At most as many as the caller named; added up in one order, so that a repeated run has the same rates.
        whole = sum(r.share for r in sorted(shared.where("_mix_named is not null or share != 0").select("_mix_source", "share").collect(), key=lambda r: str(r[0])))
    rate = F.col("share") / F.lit(whole) * F.lit(float(rows_all)) / F.col("n") if whole else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_STEP).cast("int"))
    out = shared.withColumn("rate", rate).withColumn("_mix_parts", parts)
    return stored(out.select("_mix_source", "_mix_parts", cumulated(F.col("rate") / F.col("_mix_parts")).alias("_mix_below")), "mixing-rates")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as its count says, globally shuffled.

    The result has the columns of ``docs`` and ``copy``, the number of the repetition from 0 on.
    """
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_mix_source").cast("string"), F.lit("None")))
    count = poisson_inverse(F.col("_mix_below"), F.col("_mix_parts"), own, id_column)
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_count"))).alias("_mix_copy")
    joined = docs.join(rates(docs, weights, source), F.col(source).eqNullSafe(F.col("_mix_source")))
    out = joined.withColumn("_mix_count", count).drop("_mix_source", "_mix_parts", "_mix_below").filter("_mix_count > 0").select("*", copy)
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.col("_mix_copy").cast("string")).cast("binary"))
    out = out.withColumn("_mix_order", order).sort("_mix_order")
    return out.withColumn("copy", F.col("_mix_copy") - 1).drop("_mix_count", "_mix_copy", "_mix_order")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all sources at equal shares of the rows."""
    return mix_sources(table(spark, sf_dir, "documents"))
