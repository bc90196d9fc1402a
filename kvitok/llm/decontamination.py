"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is ``n`` consecutive words, or the whole of a shorter item. Its shingles are its
runs of up to ``SHINGLE`` words. To hold a window a text must hold all of its shingles, so for exact
containment the necessary prefix is one shingle: the window's rarest, by how often it stands in the
texts. Texts and windows join on that shingle; the window must fit between the text's ends at the
shingle's place (length and position), and then its words are compared one by one.

Texts are read twice, once to count the shingles that windows have and once for the prefixes. Both
times a bitmap of fixed size lets only shingles through that may be among them; where it lets others
through, the joins drop them. Nothing is broadcast but these ``2 ** BITMAP_BITS`` bits. A hot passage
costs one row for each place where it stands.

Nulls and texts without words have no words and no hits. Items of a null id or text are left out; an
item id that repeats is one item with the windows of all its rows. Rows that repeat id and text each
get the same result. Extra columns are not read. Empty tables of either kind give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.common import ALNUM, Words, chained, hashes, lists, pieces, signed, small_batches, stored, table

SHINGLE = 3
BITMAP_BITS = 23


def _positions(hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the bitmap for each hash."""
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    return (hash_ & mask).astype(np.int64), ((hash_ >> np.uint64(BITMAP_BITS)) & mask).astype(np.int64)


def bitmap(hash_rows: DataFrame) -> np.ndarray:
    """All hashes of a column ``hash`` as one boolean array; set bits are found by Spark, at most all of them arrive."""
    mask = (1 << BITMAP_BITS) - 1
    both = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", BITMAP_BITS).bitwiseAND(mask))).alias("bit")
    bits = hash_rows.select(both).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    found = bits.toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return words


def _maybe(bits: np.ndarray, hash_: np.ndarray) -> np.ndarray:
    a, b = _positions(hash_)
    one = lambda p: (bits[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1)
    return (one(a) & one(b)).astype(bool)


def _windows(n: int):
    """One row for each window of each item and each of its shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            words = Words(texts, ALNUM)
            own = words.hashes()
            items = rows.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in ("item_id", "window", "n", "offset", "size", "hash")}
            for k in range(len(texts)):
                first, end = int(words.first[k]), int(words.first[k + 1])
                length = min(n, end - first)
                size = min(SHINGLE, length)
                for at in range(first, end - length + 1 if length else first):
                    body = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[at : at + length], words.ends[at : at + length], strict=True)).decode()
                    shingle = signed(chained(own[at : at + length], size)[: length - size + 1])
                    for offset, value in enumerate(shingle.tolist()):
                        for name, x in zip(out, (items[k], body, length, offset, size, value), strict=True):
                            out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["window"], pa.string()), *(pa.array(out[c], pa.int32()) for c in ("n", "offset", "size")), pa.array(out["hash"], pa.int64())], list(out))

    return work


def _counts(sizes: list[int], bits):
    """How often shingles that may be an item's stand in the texts, summed over each piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            words = Words(texts, ALNUM)
            own, room = words.hashes(), words.room()
            for size in sizes:
                hash_ = chained(own, size)[room >= size]
                value, n = np.unique(hash_[_maybe(bits.value, hash_)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), size, np.int32)), pa.array(signed(value)), pa.array(n.astype(np.int64))], ["size", "hash", "n"])

    return work


def _scan(sizes: list[int], bits, n: int):
    """For each text its number of words, a digest and the places that may hold a prefix shingle, with the words around."""
    place = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("words", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            words = Words(texts, ALNUM)
            own, room = words.hashes(), words.room()
            at_all, size_all, hash_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for size in sizes:
                hash_ = chained(own, size)
                at = np.flatnonzero((room >= size) & _maybe(bits.value, hash_))
                at_all.append(at), size_all.append(np.full(len(at), size)), hash_all.append(hash_[at])
            at, size, hash_ = (np.concatenate(x) for x in (at_all, size_all, hash_all))
            order = np.argsort(at, kind="stable")
            at, size, hash_ = at[order], size[order], hash_[order]
            first = words.first[:-1][words.doc[at]]
            begin, end = np.maximum(first, at - (n - 1)), np.minimum(words.first[1:][words.doc[at]], at + n)
            around = [b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[x:y], words.ends[x:y], strict=True)).decode() for x, y in zip(begin, end, strict=True)]
            places = pa.StructArray.from_arrays([pa.array(size, pa.int32()), pa.array(signed(hash_)), pa.array(at - first, pa.int32()), pa.array(at - begin, pa.int32()), pa.array(around, pa.string())], fields=list(place))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(words.doc[at], minlength=len(texts))))).astype(np.int32)
            digest = hashes(words.data, words.text_starts[:-1], words.text_starts[1:] - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(signed(digest)), pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), places)], ["doc_id", "digest", "n_words", "places"])

    return work


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans (start, n)."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["start"] + span["n"])
        return F.struct((state["sum"] + (end - F.greatest(state["end"], span["start"])).cast("long")).alias("sum"), end.alias("end"))

    return F.aggregate(spans, start, add)["sum"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    shingles = stored(items.mapInArrow(_windows(n), "item_id string, window string, n int, offset int, size int, hash long"), "decontamination-windows")
    sizes = sorted(r.size for r in shingles.select("size").distinct().collect())  # at most SHINGLE numbers
    bits = spark.sparkContext.broadcast(bitmap(shingles.select("hash")))
    counted = docs.select("text").mapInArrow(_counts(sizes, bits), "size int, hash long, n long").groupBy("size", "hash").agg(F.sum("n").alias("seen"))
    ranked = shingles.select("window", "n", "offset", "size", "hash").distinct().join(stored(counted, "decontamination-counts"), ["size", "hash"])
    # A window with a shingle that no text holds stands nowhere; a full set of shingles is size n - size + 1.
    prefix = ranked.groupBy("window", "n", "size").agg(F.min(F.struct("seen", "hash", "offset")).alias("p"), F.count_distinct("offset").alias("held")).where("held = n - size + 1")
    prefix = stored(prefix.select("window", F.col("n").alias("length"), "size", "p.hash", "p.offset"), "decontamination-prefixes")
    prefix_bits = spark.sparkContext.broadcast(bitmap(prefix.select("hash")))
    schema = "doc_id long, digest long, n_words long, places array<struct<size:int,hash:long,pos:int,before:int,words:string>>"
    scanned = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(sizes, prefix_bits, n), schema), "decontamination-places")
    place = scanned.where(F.size("places") > 0).select("doc_id", "digest", F.explode("places").alias("x")).select("doc_id", "digest", "x.*")
    fits = (F.col("offset") <= F.col("before")) & (F.size(F.split("words", " ")) >= F.col("before") - F.col("offset") + F.col("length"))
    same = F.array_join(F.slice(F.split("words", " "), F.col("before") - F.col("offset") + 1, F.col("length")), " ") == F.col("window")
    hits = place.join(prefix, ["size", "hash"]).where(fits & same).select("doc_id", "digest", "window", (F.col("pos") - F.col("offset")).alias("start"), F.col("length").alias("n"))
    hits = stored(hits, "decontamination-hits")
    spans = hits.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans")).select("doc_id", "digest", _covered(F.col("spans")).alias("hit"))
    held = hits.select("doc_id", "digest", "window").distinct().join(shingles.select("item_id", "window").distinct(), "window")
    held = held.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = spans.join(held, (spans.doc_id.eqNullSafe(held.doc_id)) & (spans.digest == held.digest)).select(spans.doc_id.alias("id"), spans.digest.alias("of"), "hit", "items")
    out = scanned.select("doc_id", "digest", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    hit, item_list = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(item_list).cast("long").alias("n_items"), F.sha2(F.array_join(item_list, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten words running of a benchmark item, and how many of their words."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(view: str, key: str) -> str:
    return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {view}"""


OP2_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}),
b AS ({_words_sql("(SELECT * FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)", "item_id")}),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS body
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS body
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.body = bw.body),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
