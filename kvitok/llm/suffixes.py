"""Repeated passages by sparse distributed prefix doubling over byte positions.

A position's rank at length h is a fingerprint of the h bytes from it on; ranks at 2h come from pairs
(rank at h, rank h bytes further), so equal ranks are equal strings. Sorting every position at every
length would move some hundred times the input, so only positions that the text itself picks are
sorted, and those that turn out unique leave:

1. Of the ``width - GRAM + 1`` ranks at length GRAM in a string of ``width`` bytes, the smallest is its
   anchor. Equal strings have equal anchors at equal places. Windows that follow each other with one
   anchor form a run, so positions are sorted by run: rank of the anchor, rank of the run's whole
   string (past the threshold). Anchors whose rank is unique leave: no window of theirs has a copy.
2. Runs that remain are sorted by (anchor rank, run rank). Of equal runs all but the first are repeats.
3. First runs whose anchor rank others share as well are ranked window by window within that anchor,
   as their strings may agree in part; a window that is not the first of its rank is a repeat.

Every string of ``width`` bytes has one anchor, so no repeat is lost, at any size. Hot ranks: copies
collapse to one row a task before they are sorted, counts are combined before the shuffle, joins have
exchanges on both sides that Spark splits, and anchors of more than ``HOT`` places have their windows
grouped by rank with partial sums in place of one sorted run.

Nulls and texts under ``width`` bytes keep all. Rows of a null id are returned whole and count for
nothing. Rows that repeat id and text are one document; texts that share an id are versions of one,
told apart by a hash. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.common import _OF_BYTE, PIECE_BYTES, hashes, mix, pieces, signed, small_batches, stored, table

GRAM = 16
#: Runs of one anchor that a task ranks together: some 3 MB of strings and 50 MB of window ranks at most.
HOT = 20_000
#: Rows sorted or ranked at once within a task.
BLOCK_ROWS = 100_000
#: Versions of an id start so many positions apart.
VERSION_BITS = 40

_U = np.uint64
_OF_BYTE_32 = (_OF_BYTE >> _U(32)).astype(np.uint32)
_LOW = _U((1 << 24) - 1)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position at a length that is a power of two, by doubling; 32 bits."""
    r, h = _OF_BYTE_32[data], 1
    while h < length:
        r = r[:-h] * np.uint32(0x9E3779B1) + r[h:]
        r ^= r >> np.uint32(15)
        h *= 2
    return r


def anchors(data: np.ndarray, width: int) -> np.ndarray:
    """For each string of ``width`` bytes the position of its first smallest rank."""
    r = ranks(data, GRAM)
    assert len(r) <= 1 << 24, "a place has 24 bits beside its rank"
    low = (r.astype(np.uint64) << _U(24)) | np.arange(len(r), dtype=np.uint64)
    span, done = width - GRAM + 1, 1
    while 2 * done <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    return (low & _LOW).astype(np.int64)


def segments(texts: list[bytes | None], width: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, offset, bytes); a long text in parts that share ``width - 1`` bytes."""
    for k, text in enumerate(texts):
        if text and len(text) >= width:
            for at in range(0, len(text) - width + 1, PIECE_BYTES):
                yield k, at, text[at : at + PIECE_BYTES + width - 1]


def runs(texts: list[bytes | None], width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, windows, rank of the anchor, rank of the run.

    Segments are joined up to about ``PIECE_BYTES``, so that places fit beside ranks in a text of any length.
    """
    done: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))]
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for part in segments(texts, width):
        if held and size + len(part[2]) > PIECE_BYTES + width - 1:
            done.append(_runs_of(held, width))
            held, size = [], 0
        held.append(part)
        size += len(part[2])
    if held:
        done.append(_runs_of(held, width))
    return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def _runs_of(parts: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p[2]) for p in parts])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    count = sizes - width + 1
    part = np.repeat(np.arange(len(parts)), count)
    window = np.arange(len(part)) + np.repeat(begins - (np.cumsum(count) - count), count)
    anchor = anchors(data, width)[window]
    starts = np.concatenate(([0], 1 + np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
    n = np.diff(np.concatenate((starts, [len(part)])))
    begin, at = window[starts], anchor[starts]
    both = hashes(data, np.concatenate((at, begin)), np.concatenate((at + GRAM, begin + n - 1 + width)))
    of = part[starts]
    text, offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return text[of], begin - begins[of] + offset[of], n, both[: len(at)], both[len(at) :]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _versions(rows: pa.RecordBatch, column: str = "version") -> np.ndarray:
    return rows.column(rows.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64) << VERSION_BITS


def _anchor_ranks(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            yield _batch(gram=signed(runs(texts, width)[3]))

    return work


def _runs(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            text, at, n, gram, run = runs(texts, width)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            yield _batch(gram=signed(gram), run=signed(run), doc_id=ids[text], at=at + _versions(rows)[text], n=n.astype(np.int16))

    return work


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str] | None = None) -> Iterator[pa.Table]:
    """Batches in blocks; with keys, which the rows are sorted by, no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < BLOCK_ROWS:
            continue
        block = pa.Table.from_batches(held)
        if keys is None:
            yield block
            held = []
            continue
        last = [block.column(k).to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in last])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield block.slice(0, cut)
        held = block.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal runs that meet in a task: the first goes on with their number, the others are repeats."""
    for block in _blocks(batches):
        gram, run, doc, at = (block.column(c).to_numpy() for c in ("gram", "run", "doc_id", "at"))
        order = np.lexsort((at, doc, run, gram))
        first = np.ones(len(order), bool)
        first[1:] = (gram[order][1:] != gram[order][:-1]) | (run[order][1:] != run[order][:-1])
        head = np.flatnonzero(first)
        count = np.zeros(len(order), np.int64)
        count[order[head]] = np.diff(np.concatenate((head, [len(order)])))
        # Rows of one document that stand for one place twice (a repeated row) are no repeats.
        group = np.cumsum(first) - 1
        same = (doc[order] == doc[order[head]][group]) & (at[order] == at[order[head]][group])
        kept = np.zeros(len(order), bool)
        kept[order] = first | same
        table_ = block.append_column("same", pa.array(count)).append_column("gone", pa.array(~kept))
        yield from table_.filter(pa.array((count > 0) | ~kept)).combine_chunks().to_batches()


def pack(text: bytes | None) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text or b"")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in pieces(batches):
        yield _batch(doc_id=rows.column(0), version=rows.column(rows.schema.get_field_index("version")), packed=pa.array([pack(t) for t in texts], pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch], most: int = 64) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            part = batch.slice(k, most)
            yield part, [expand.decompress(x) if x else b"" for x in part.column(part.schema.get_field_index("packed")).to_pylist()]


def _strings(width: int):
    """The bytes of the runs listed with each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _unpacked(batches):
            gram, doc, at, n, hot, body = [], [], [], [], [], []
            version = _versions(rows)
            listed = rows.column(rows.schema.get_field_index("runs")).to_pylist()
            for text, base, own, id_ in zip(texts, version, listed, rows.column(0).to_pylist(), strict=True):
                for r in own:
                    begin = r["at"] - int(base)
                    if 0 <= begin < 1 << VERSION_BITS and begin + r["n"] - 1 + width <= len(text):
                        gram.append(r["gram"]), doc.append(id_), at.append(r["at"]), n.append(r["n"]), hot.append(r["hot"])
                        body.append(text[begin : begin + r["n"] - 1 + width])
            yield _batch(gram=pa.array(gram, pa.int64()), doc_id=pa.array(doc, pa.int64()), at=pa.array(at, pa.int64()), n=pa.array(n, pa.int16()), hot=pa.array(hot, pa.bool_()), body=pa.array(body, pa.binary()))

    return work


def _windows(block: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """Row and start of each window of a block of runs, and two ranks that together tell its string and anchor."""
    body, n = block.column("body").to_pylist(), block.column("n").to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(body), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(b) for b in body])[:-1])).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    p = begins[row] + k
    rank = hashes(data, p, p + width)
    gram = block.column("gram").to_numpy().view(np.uint64)[row]
    return row, k, mix(rank ^ gram), rank


def _ranked(width: int):
    """Windows that are not the first of their rank; rows are sorted by anchor, document and place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ["gram"]):
            for part in _cut(block):
                row, k, key, rank = _windows(part, width)
                order = np.lexsort((np.arange(len(key)), rank, key))
                again = np.zeros(len(key), bool)
                again[order[1:]] = (key[order][1:] == key[order][:-1]) & (rank[order][1:] == rank[order][:-1])
                doc, at = part.column("doc_id").to_numpy()[row[again]], part.column("at").to_numpy()[row[again]] + k[again]
                yield _spans(doc, at)

    return work


def _cut(block: pa.Table, most: int = 8000) -> Iterator[pa.Table]:
    """Parts of a block of about so many rows that cut no anchor's rows apart."""
    gram = block.column("gram").to_numpy()
    turns = np.concatenate(([0], 1 + np.flatnonzero(gram[1:] != gram[:-1]), [len(gram)]))
    begin = 0
    for a, b in zip(turns[:-1], turns[1:], strict=True):
        if b - begin > most and a > begin:
            yield block.slice(begin, a - begin)
            begin = int(a)
    if begin < len(gram):
        yield block.slice(begin)


def _spans(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Distinct window starts as spans of neighbouring starts."""
    if not len(at):
        return _batch(doc_id=pa.array([], pa.int64()), at=pa.array([], pa.int64()), n=pa.array([], pa.int64()))
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    head = np.concatenate(([0], 1 + np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))))
    last = np.concatenate((head[1:], [len(at)])) - 1
    return _batch(doc_id=doc[head], at=at[head], n=at[last] - at[head] + 1)


def _window_rows(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 8000):
                part = pa.Table.from_batches([batch.slice(begin, 8000)])
                row, k, key, rank = _windows(part, width)
                yield _batch(key=signed(key), rank=signed(rank), doc_id=part.column("doc_id").to_numpy()[row], at=part.column("at").to_numpy()[row] + k)

    return work


def repeated_starts(docs: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """doc_id and spans (at, n) of starts of strings of ``width`` bytes that also start earlier."""
    grams = docs.mapInArrow(_anchor_ranks(width), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("places")).where("places > 1")
    shared = stored(grams, "suffix-grams")
    places = docs.mapInArrow(_runs(width), "gram long, run long, doc_id long, at long, n short").join(shared, "gram")
    schema = "gram long, run long, doc_id long, at long, n short, places long, same long, gone boolean"
    found = stored(places.select("gram", "run", "doc_id", "at", "n", "places").mapInArrow(_collapse, schema), "suffix-runs")
    first = F.min(F.struct("doc_id", "at", "n")).alias("first")
    heads = found.where("not gone").groupBy("gram", "run").agg(first, F.sum("same").alias("same"), F.count(F.lit(1)).alias("tasks"), F.first("places").alias("places"))
    heads = stored(heads, "suffix-heads")
    again = found.where("not gone").join(heads.where("tasks > 1").select("gram", "run", "first"), ["gram", "run"]).where("doc_id != first.doc_id or at != first.at")
    partly = heads.where("same < places").select("gram", "first.*", (F.col("places") > HOT).alias("hot"))
    listed = partly.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "at", "n", "hot")).alias("runs"))
    bodies = packed.join(listed, "doc_id").select("doc_id", "version", "packed", "runs").mapInArrow(_strings(width), "gram long, doc_id long, at long, n short, hot boolean, body binary")
    bodies = stored(bodies, "suffix-bodies")
    spans = "doc_id long, at long, n long"
    few = bodies.where("not hot").repartition("gram").sortWithinPartitions("gram", "doc_id", "at").mapInArrow(_ranked(width), spans)
    windows = bodies.where("hot").mapInArrow(_window_rows(width), "key long, rank long, doc_id long, at long")
    firsts = windows.groupBy("key", "rank").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    many = windows.join(stored(firsts, "suffix-windows"), ["key", "rank"]).where("doc_id != first.doc_id or at != first.at").select("doc_id", "at", F.lit(1).cast("long").alias("n"))
    runs_gone = found.where("gone").unionByName(again.select(found.columns)).select("doc_id", "at", F.col("n").cast("long").alias("n"))
    return runs_gone.unionByName(few).unionByName(many)


def _kept(width: int):
    """Digest columns of each text without its repeated spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _unpacked(batches):
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            spans = rows.column(rows.schema.get_field_index("spans"))
            for k, (text, base) in enumerate(zip(texts, _versions(rows), strict=True)):
                cover = np.empty((0, 2), np.int64)
                if spans[k].is_valid:
                    own = spans[k].values
                    at, n = own.field("at").to_numpy() - int(base), own.field("n").to_numpy()
                    good = (at >= 0) & (at < 1 << VERSION_BITS)
                    cover = merged(at[good], at[good] + n[good] - 1 + width)
                kept, last = hashlib.sha256(), 0
                for a, b in cover.tolist():
                    kept.update(text[last:a])
                    last = b
                kept.update(text[last:])
                for name, value in zip(out, (len(text), int((cover[:, 1] - cover[:, 0]).sum()), len(cover), kept.hexdigest()), strict=True):
                    out[name].append(value)
            yield _batch(doc_id=rows.column(0), **{c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()})

    return work


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of spans as rows (begin, end); spans that touch are one."""
    if not len(begin):
        return np.empty((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    head = np.concatenate(([0], 1 + np.flatnonzero(begin[1:] > end[:-1])))
    return np.stack((begin[head], end[np.concatenate((head[1:] - 1, [len(end) - 1]))]), axis=1)


def dedup_passages(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_id = own.where("doc_id is not null")
    many = with_id.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    version = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 22) - 1).cast("int") if many else F.lit(0)
    with_id = with_id.withColumn("version", version)
    packed = with_id.mapInArrow(_packed, "doc_id long, version int, packed binary")
    starts = repeated_starts(with_id.where(F.octet_length("text") >= width), packed.dropDuplicates(["doc_id", "version"]) if many else packed, width)
    spans = starts.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = packed.join(spans, "doc_id", "left").select("doc_id", "version", "packed", "spans").mapInArrow(_kept(width), schema)
    null_id = own.where("doc_id is null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    return out.unionByName(null_id)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without its passages of 100 bytes that also start earlier."""
    return dedup_passages(table(spark, sf_dir, "documents"))
