"""Line dedup over content-defined chunks of lines, with DataFrame functions alone.

A line's hash is taken from its MD5. A text is cut behind each line at which a rolling hash over that
line and the one before it falls on one of ``1 / cut`` of its values, so equal passages are cut alike
wherever they stand. Of equal chunks of two or more lines anywhere in the table, the one of the
smallest (doc_id, number) stays and the others go, after their bytes are compared with its bytes.

Only chunks that a first count by hash finds more than once are compared. A bitmap of those hashes,
``2 ** WORD_BITS`` rows of 64 bits at any size of input, keeps most other chunks out of the shuffle; the
join on hash after it drops the rest, so a bitmap that is full costs shuffle and no result. It alone is
broadcast. All other joins are plain equi-joins on hash or id whose inputs are exchanges, so Spark
splits a hot chunk over tasks.

Chunks of white space alone stay. Nulls and empty texts stay as they are. Rows of a null id stay whole
and count for nothing. Rows that repeat an id and text are one document: their chunks stay or
go alike. Other columns are kept; the working columns have names of their own. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.functions.text import let
from kvitok.llm.common import stored, table

CUT = 3
FACTOR = 31
#: Rows of the bitmap as a power of two: at most 131,072 rows of 12 bytes are broadcast.
WORD_BITS = 17


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunk_ends(lines: Column, cut: int) -> Column:
    """Numbers of the lines behind which a text is cut, the last line among them."""

    def ends(h: Column) -> Column:
        rolled = lambda i: F.get(h, i) + FACTOR * F.coalesce(F.get(h, i - 1), F.lit(0))
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == F.size(h) - 1) | (F.pmod(rolled(i), F.lit(cut)) == 0))

    return let(F.transform(lines, line_hash), ends)


def chunks(text: Column, cut: int = CUT) -> Column:
    """A text's chunks in order: ``no``, ``n_lines`` and ``body``; their bodies joined by line feeds are the text."""

    def of(lines: Column) -> Column:
        def cut_out(ends: Column) -> Column:
            def chunk(end: Column, k: Column) -> Column:
                begin = F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1
                return F.struct(k.alias("no"), (end - begin + 1).alias("n_lines"), F.array_join(F.slice(lines, begin + 1, end - begin + 1), "\n").alias("body"))

            return F.transform(ends, chunk)

        return let(chunk_ends(lines, cut), cut_out)

    return let(F.split(text, "\n", -1), of)


def chunk_id(chunk: Column) -> Column:
    """Number and hash of a chunk of several lines; null for one that cannot go."""
    many = (chunk["n_lines"] > 1) & chunk["body"].rlike(r"\S")
    return F.when(many, F.concat_ws(":", chunk["no"].cast("string"), F.xxhash64(chunk["body"]).cast("string")))


def _bit(hash_: Column) -> Column:
    """The bit of a hash within its word of the bitmap."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hash_, WORD_BITS).bitwiseAND(63).cast("int"))


def _word(hash_: Column) -> Column:
    return hash_.bitwiseAND((1 << WORD_BITS) - 1).cast("int")


def maybe_among(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` whose ``hash`` may be one of ``hashes``; none that is one is lost."""
    own = F.col("hash")
    bitmap = hashes.groupBy(_word(own).alias("_word")).agg(F.bit_or(_bit(own)).alias("_bits"))
    return rows.join(F.broadcast(bitmap), (_word(own) == F.col("_word")) & (_bit(own).bitwiseAND(F.col("_bits")) != 0)).select(rows.columns)


def repeated_chunks(docs: DataFrame, cut: int = CUT) -> DataFrame:
    """id and chunk_id of all chunks that go."""
    one = docs.where(F.col("doc_id").isNotNull() & F.col("text").contains("\n"))
    one = one.select("doc_id", F.explode(chunks(F.col("text"), cut)).alias("c")).where((F.col("c.n_lines") > 1) & F.col("c.body").rlike(r"\S"))
    one = one.select("doc_id", F.col("c.no").alias("no"), F.xxhash64("c.body").alias("hash"), F.col("c.body").alias("body"))
    first = F.min(F.struct("doc_id", "no"))
    counted = one.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1").select("hash", "first")
    counted = stored(counted, "line-hashes")
    found = stored(maybe_among(one, counted.select("hash")).join(counted, "hash").withColumn("is_first", F.struct("doc_id", "no") == F.col("first")).drop("first"), "line-chunks")
    firsts = found.where("is_first").groupBy("hash").agg(F.min("body").alias("first_body"))
    alike = found.where("not is_first").join(stored(firsts, "line-firsts"), "hash").where("body = first_body")
    return alike.select("doc_id", F.concat_ws(":", F.col("no").cast("string"), F.col("hash").cast("string")).alias("chunk_id"))


def dedup_lines(docs: DataFrame, cut: int = CUT) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``line_stats``: lines, chunks and removed ones of each."""
    gone = repeated_chunks(docs, cut).groupBy("doc_id").agg(F.collect_set("chunk_id").alias("_line_gone"))
    joined = docs.join(gone.withColumnRenamed("doc_id", "_line_id"), F.col("doc_id") == F.col("_line_id"), "left")

    def cleaned(parts: Column) -> Column:
        ids = F.transform(parts, lambda c: F.coalesce(chunk_id(c), F.concat(c["no"].cast("string"), F.lit(":"))))
        kept = F.transform(F.array_except(ids, F.col("_line_gone")), lambda x: F.get(parts, F.substring_index(x, ":", 1).cast("int")))
        lines = lambda a: F.aggregate(a, F.lit(0), lambda n, c: n + c["n_lines"])
        return let(kept, lambda kept: F.struct(F.array_join(F.transform(kept, lambda c: c["body"]), "\n").alias("text"), (lines(parts) - lines(kept)).alias("n_removed"), (F.size(parts) - F.size(kept)).alias("n_chunks_removed")))

    whole = F.struct(F.col("text").alias("text"), F.lit(0).alias("n_removed"), F.lit(0).alias("n_chunks_removed"))
    out = joined.withColumn("_line_out", F.when(F.col("_line_gone").isNull() | F.col("text").isNull(), whole).otherwise(let(chunks(F.col("text"), cut), cleaned)))
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = out.withColumn("line_stats", F.struct(n_lines.alias("n_lines"), F.col("_line_out.n_removed").alias("n_removed"), F.col("_line_out.n_chunks_removed").alias("n_chunks_removed")))
    return out.withColumn("text", F.col("_line_out.text")).drop("_line_out", "_line_gone", "_line_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how many lines it has and loses, and its text without them as a digest."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("line_stats.n_lines").cast("long").alias("n_lines"), F.col("line_stats.n_removed").cast("long").alias("n_removed"), F.col("line_stats.n_chunks_removed").cast("long").alias("n_chunks_removed"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH lines AS (
    SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), hashed AS (
    SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), rolled AS (
    SELECT doc_id, i, line, (h + {FACTOR} * coalesce(lag(h) OVER d, 0)) % {CUT} = 0 AS cut_behind
    FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
    SELECT doc_id, i, line, coalesce(sum(cut_behind::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
    FROM rolled
), parts AS (
    SELECT doc_id, no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, no
), ranked AS (
    SELECT *, n_lines > 1 AND regexp_matches(body, '\\S') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, no) > 1 AS gone FROM parts
), kept AS (
    SELECT doc_id, sum(n_lines) AS n_lines, coalesce(sum(n_lines) FILTER (WHERE gone), 0) AS n_removed,
        count(*) FILTER (WHERE gone) AS n_chunks_removed, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text
    FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE coalesce(k.n_lines, 0) END::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
    coalesce(k.n_chunks_removed, 0)::BIGINT AS n_chunks_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
