"""Words of a corpus grouped with their spelling variants: one code point inserted, deleted or replaced.

Each letter is hashed to one of a few symbols. All words one edit away from a reduced word are then few,
``2 * symbols`` times its length, whatever the number of letters; they are generated in full and joined with
the reduced vocabulary, and pairs that meet are verified on the original strings. An edit leaves the first
or the last ``KEPT`` letters alone, so the key of the join holds those of the original word besides the
reduced neighbour. Without them words of a large vocabulary would meet by chance, pairs growing with its square.

Counting runs partially before its shuffle, so frequent words are one row a task. Neighbours that no word
has as its key are mostly kept out of the shuffle by the bitmap of ``lines``; the join drops the rest.
Forms lead to words at least ``RATIO`` times as frequent, so they hold no circle, and the frequency of the
commonest word bounds the rounds in which roots are found by doubling.

Null and empty texts have no words; a null id is written as the empty string. Rows that repeat count each.
Other columns are not read, and an empty table gives no words.
"""

from __future__ import annotations

import zlib
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.common import stored, table
from kvitok.llm.lines import maybe_among

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = "0123"
#: Every how many runs one loses a code point.
DROP = 31
MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times as frequent as a word its form is.
RATIO = 10
#: Letters at either end that a key holds; at most half of the shortest word less one.
KEPT = 3

_RUN = "([A-Za-z\\u00C0-\\u00FF]{%d,})" % MIN_LENGTH
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts with their occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(_RUN), 1)).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def reduced(word: Column) -> Column:
    """The word with a symbol for each letter."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[zlib.crc32(x.encode()) % len(SYMBOLS)] for x in LETTERS))


def _key(word: Column, short: Column, behind: Column) -> Column:
    """Hash of a reduced word and of the letters that an edit leaves alone: the first ones, or those behind it."""
    first = F.xxhash64(short, F.lit("first"), F.substr(word, F.lit(1), F.lit(KEPT)))
    return F.when(behind, F.xxhash64(short, F.lit("last"), F.substr(word, F.length(word) - KEPT + 1))).otherwise(first)


def word_keys(word: Column) -> Column:
    """Both keys of a word."""
    return F.array(_key(word, reduced(word), F.lit(False)), _key(word, reduced(word), F.lit(True)))


def neighbour_keys(word: Column, short: Column) -> Column:
    """Keys of all reduced words that are the reduced word itself or one edit away."""
    n = F.length(short)
    head = lambda i: F.substr(short, F.lit(1), i)
    tail = lambda i: F.substr(short, i + 1)
    at = lambda last: F.sequence(F.lit(0), last)
    own = lambda i: F.substr(short, i + 1, F.lit(1))
    symbols = F.array(*[F.lit(s) for s in SYMBOLS])
    key = lambda i, text: _key(word, text, i < KEPT)
    deleted = F.when(n > MIN_LENGTH, F.transform(at(n - 1), lambda i: key(i, F.concat(head(i), tail(i + 1))))).otherwise(F.array().cast("array<long>"))
    replaced = F.transform(at(n - 1), lambda i: F.transform(F.filter(symbols, lambda s: s != own(i)), lambda s: key(i, F.concat(head(i), s, tail(i + 1)))))
    inserted = F.transform(at(n), lambda i: F.transform(symbols, lambda s: key(i, F.concat(head(i), s, tail(i)))))
    same = F.array(_key(word, short, F.lit(False)), _key(word, short, F.lit(True)))
    return F.array_distinct(F.concat(same, deleted, F.flatten(replaced), F.flatten(inserted)))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every pair of words one edit apart, in both directions, once."""
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(word_keys(F.col("word"))).alias("hash"))
    probes = words.select("word", reduced(F.col("word")).alias("short"))
    probes = probes.select("word", F.explode(neighbour_keys(F.col("word"), F.col("short"))).alias("hash"))
    met = maybe_among(probes, known.select("hash")).join(known, "hash")
    apart = F.levenshtein("word", "near", 1) == 1
    return met.where(apart).select("word", "near", "near_n").distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` for rows ``word, form``: the word at which a chain of forms ends.

    ``most`` is the count of the commonest word, which bounds the length of a chain.
    """
    ends = stored(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    length, least = 0, MIN_COUNT
    while least * RATIO <= most:
        length, least = length + 1, least * RATIO
    for _ in range(ceil(log2(length)) if length > 1 else 0):
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("_end"))
        ends = stored(ends.join(on, "root", "left").select("word", F.coalesce("_end", "root").alias("root")), "spelling-roots")
    return ends


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word with its count, near words, form and root."""
    words = stored(vocabulary(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", (-F.col("best.order")).alias("best_n"), F.col("best.near").alias("best"))
    has_form = F.col("best_n") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(has_form, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    found = stored(found, "spelling-found")
    most = words.agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    ends = roots(found.where("form IS NOT NULL"), most)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of ``documents`` that occur twice or more, with form and root."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The checksum is worked out from its definition, as the engine that runs this has no function for it.
OP12_SQL = f"""
WITH RECURSIVE codes AS (
    SELECT list(c ORDER BY k) AS code FROM (
        SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM (SELECT unnest(range(256)) AS k)
    )
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')), '{_UPPER}', '{_UPPER.lower()}') AS run
    FROM documents
), counted AS (
    SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY id, run
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c // 256, code[xor(c, b) % 256 + 1]))) AS h
    FROM counted, codes
), cut AS (
    SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), holes AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS hole FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i WHERE a.word <> b.word
    UNION
    SELECT holes.word, words.word, words.n FROM holes JOIN words ON words.word = hole
    UNION
    SELECT words.word, holes.word, holes.n FROM holes JOIN words ON words.word = hole
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM pairs GROUP BY word
), found AS (
    SELECT words.word, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
        CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), chains AS (
    SELECT word, word AS root, form FROM found
    UNION ALL
    SELECT chains.word, found.word, found.form FROM chains JOIN found ON found.word = chains.form
)
SELECT word, found.form, chains.root, n, n_near, form_n FROM found JOIN chains USING (word) WHERE chains.form IS NULL
"""
