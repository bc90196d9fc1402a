"""Language identification by Bayesian evidence fusion.

log P(language | all) = text likelihood + declared language + address suffix + host prior, up to a constant.

- Text: naive Bayes over hashed byte trigrams of letters and single spaces, learned from at most
  ``SAMPLE`` labelled documents of each language; tempered, as trigrams overlap.
- Declared markup language and address suffix: P(declared | language), P(suffix | language), counted
  over all rows by grouped aggregation with the language that the text alone suggests, smoothed.
- Host: P(language | host) smoothed towards its registered domain, that towards all rows. A row's own
  vote is taken out of its host's and domain's counts, so it does not confirm itself.

A row is rejected if its text has no letters, if its best language explains the text no better than
chance does, or if the fused probability of the best language is under ``LEAST``.

Only small rows without text are aggregated and joined by host; of a hot host's rows, counts are
combined before the shuffle, and Spark splits the join. Nulls in text count as empty; null or unknown
declarations, suffixes and hosts are values of their own, which say little. Rows that repeat are
judged each. Working columns have names of their own. An empty table gives an empty table; without
any labelled document every row is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvitok.llm.common import LOWER, lists, pieces, small_batches, stored, table

BUCKETS = 1 << 14
#: Most labelled documents of a language to learn from, the first by a hash of their ids.
SAMPLE = 1000
#: Most languages; with BUCKETS it bounds the model that the driver holds and sends out.
MOST_LANGUAGES = 100
TEMPER = 0.3
LEAST = 0.5
#: Weight of the parent's distribution against rows counted at a host or domain.
PRIOR_ROWS = 5.0
PARTS = ("declared", "suffix")

_KEPT = LOWER.copy()
_KEPT[:128][~((_KEPT[:128] >= 97) & (_KEPT[:128] <= 122))] = 0x20


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every trigram whose middle is a letter."""
    raw = b" " + b"  ".join(t or b"" for t in texts) + b" "
    data = _KEPT[np.frombuffer(raw, np.uint8)]
    wide = data.astype(np.uint32)
    value = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
    at = np.flatnonzero(data[1:-1] != 0x20)
    value = value[at]
    bucket = ((value ^ (value >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - int(math.log2(BUCKETS)))
    ends = np.cumsum([len(t or b"") + 2 for t in texts])
    return bucket.astype(np.int64), np.searchsorted(ends, at + 1, side="right")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket in each, buckets x languages."""
    spark = docs.sparkSession
    labelled = docs.where("lang is not null and text is not null and doc_id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = labelled.select("doc_id", "lang").distinct().withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= sample)
    picked = stored(picked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "language-sample")
    languages = [r[0] for r in picked.select("_lang").distinct().sort("_lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            bucket, text = grams(texts)
            number = {x: k for k, x in enumerate(languages)}
            own = np.array([number[x] for x in rows.column(0).to_pylist()], np.int64)
            value, n = np.unique(own[text] * BUCKETS + bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["cell", "n"])

    found = labelled.join(picked, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("_lang", "text")
    cells = found.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets
    counts = np.full(max(1, len(languages)) * BUCKETS, 0.5)
    counts[cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
    counts = counts.reshape(-1, BUCKETS)
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def text_evidence(rows: DataFrame, text: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` without the text, with ``loglik`` by language and the number of trigrams."""
    spark = rows.sparkSession
    small_batches(spark)
    languages, table_ = model
    sent = spark.sparkContext.broadcast(table_)
    names = [c for c in rows.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text] + ["loglik array<double>", "n_grams long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            bucket, of = grams(texts)
            n = np.bincount(of, minlength=len(texts))
            sums = np.zeros((len(texts), sent.value.shape[1]))
            held = np.flatnonzero(n)
            if len(held):
                starts = np.concatenate(([0], np.cumsum(n[held])[:-1]))
                for k in range(sums.shape[1]):
                    sums[held, k] = np.add.reduceat(sent.value[:, k][bucket].astype(np.float64), starts)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, lists(sums.ravel(), np.full(len(texts), sums.shape[1]), pa.float64()), pa.array(n.astype(np.int64))], [*names, "loglik", "n_grams"])

    return rows.mapInArrow(work, schema)


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _counts_by(votes: DataFrame, key: str, k: int) -> DataFrame:
    """For each value of ``key`` the votes by language as an array ``n_<key>``; partial sums are combined first."""
    sums = [F.sum(F.col("vote")[i]).alias(f"_{i}") for i in range(k)]
    return votes.groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"_{i}") for i in range(k)]).alias(f"n_{key}"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], least: float = LEAST) -> DataFrame:
    """Adds text_lang, lang_found, probability and rejected to rows with key, text, declared, suffix, host and domain.

    The text is left out of the result. Declared languages that the model does not know count as one value.
    """
    languages, k = model[0], len(model[0])
    if not k:
        return rows.drop("text").select("*", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang_found"), F.lit(0.0).alias("probability"), F.lit(True).alias("rejected"))
    known = F.col("declared").isin(languages)
    seen = rows.withColumn("declared", F.when(known, F.col("declared")).when(F.col("declared").isNotNull(), "?").otherwise(""))
    seen = seen.withColumns({c: F.coalesce(c, F.lit("")) for c in ("suffix", "host", "domain")})
    seen = stored(text_evidence(seen, "text", model), "language-evidence")
    top = F.array_max("loglik")
    weight = F.transform("loglik", lambda x: F.exp(TEMPER * (x - top)))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    soft = F.when(F.col("n_grams") > 0, F.transform(weight, lambda x: x / total)).otherwise(_array([0.0] * k))
    votes = seen.withColumn("vote", soft)
    whole = votes.agg(*[F.sum(F.col("vote")[i]) for i in range(k)]).first()
    prior = [(float(x or 0.0) + 1.0) for x in whole]
    prior = [x / sum(prior) for x in prior]
    out = votes
    for c in ("domain", "host"):
        counted = stored(_counts_by(votes, c, k), f"language-{c}").withColumnRenamed(c, f"_{c}")
        out = out.join(counted, F.col(c) == F.col(f"_{c}")).drop(f"_{c}")

    def smoothed(counts: Column, parent: Column) -> Column:
        rest = F.zip_with(counts, "vote", lambda n, own: F.greatest(n - own, F.lit(0.0)))
        size = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, parent, lambda n, p: (n + PRIOR_ROWS * p) / (size + PRIOR_ROWS))

    # Without an address all rows share one host, which is as good as none.
    out = out.withColumn("_domain_prior", smoothed(F.col("n_domain"), _array(prior)))
    out = out.withColumn("_prior", F.when(F.col("host") == "", _array(prior)).otherwise(smoothed(F.col("n_host"), F.col("_domain_prior"))))
    score = F.zip_with(F.transform("loglik", lambda x: TEMPER * (x - top)), F.transform("_prior", lambda p: F.log(p)), lambda a, b: a + b)
    for c in PARTS:
        likely = stored(_counts_by(votes, c, k), f"language-{c}")
        likely = likely.select(F.col(c).alias(f"_{c}"), F.col(f"n_{c}").alias(f"_n_{c}"))
        # P(value | language) = (count + 1) / (all of the language + values), as a column by language.
        number = max(1, likely.count())
        each = F.transform(f"_n_{c}", lambda n, i: F.log((n + 1.0) / (F.get(_array([x or 0.0 for x in whole]), i) + number)))
        out = out.join(likely.select(f"_{c}", each.alias(f"_log_{c}")), F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
        unknown = F.col(c) == ""
        score = F.zip_with(score, F.when(unknown, _array([0.0] * k)).otherwise(F.col(f"_log_{c}")), lambda a, b: a + b)
    out = out.withColumn("_score", score)
    best = F.array_max("_score")
    out = out.withColumn("probability", 1.0 / F.aggregate(F.transform("_score", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x))
    name = lambda values: F.get(F.array(*[F.lit(x) for x in languages]), (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    out = out.withColumn("lang_found", name(F.col("_score"))).withColumn("text_lang", F.when(F.col("n_grams") > 0, name(F.col("loglik"))))
    chance = top < F.col("n_grams") * math.log(1 / BUCKETS)
    out = out.withColumn("rejected", (F.col("n_grams") == 0) | chance | (F.col("probability") < least))
    return out.drop("loglik", "n_grams", "vote", "n_domain", "n_host", "_domain_prior", "_prior", "_score", *[f"_log_{c}" for c in PARTS])


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id with the evidence of a page: visible text, declared language, address suffix, host, domain."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*+>", " "), r"&[#\w]{1,32};", " ")
    rows = pages.select("page_id", text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"))
    parts = F.split("host", r"\.")
    return rows.withColumn("suffix", F.element_at(parts, -1)).withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of a document: its source stands for the host, its lang for the declaration."""
    key = F.xxhash64("doc_id", "text", "source", "lang").alias("key")
    return docs.select(key, "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"))


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = LEAST) -> DataFrame:
    """``docs`` without rejected rows, with ``lang`` as it was found.

    Only rows that change travel to the join, so a few of them need no shuffle of the texts.
    """
    found = identify(document_rows(docs), model, least)
    changed = found.where(F.col("rejected") | ~F.col("declared").eqNullSafe(F.col("lang_found")))
    changed = stored(changed.select("key", "lang_found", "rejected").distinct(), "language-changes")
    changed = changed.select(F.col("key").alias("_lang_key"), F.col("lang_found").alias("_lang_found"), F.col("rejected").alias("_lang_rejected"))
    joined = docs.join(changed, F.xxhash64("doc_id", "text", "source", "lang") == F.col("_lang_key"), "left").where("not coalesce(_lang_rejected, false)")
    return joined.withColumn("lang", F.coalesce("_lang_found", "lang")).select(docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its text, markup, address and host."""
    model = train(table(spark, sf_dir, "documents"))
    found = identify(page_rows(table(spark, sf_dir, "pages")), model)
    return found.select("page_id", "lang_found", "probability", "rejected", "text_lang", "declared", "host")
