"""What the operators share: tables, materialised steps, and words and hashes of texts in numpy.

Rows travel to Python in Arrow batches; a task works on pieces of a batch of a few megabytes, so its
memory follows the longest text and not the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.session import shared_dir

#: Bytes of text that a task works on at once, unless one text is longer.
PIECE_BYTES = 1 << 17
#: Rows of an Arrow batch: bounds what a task holds of ordinary texts.
BATCH_ROWS = 1000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random word for each byte value.
_OF_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: Bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of the Arrow batches that Python tasks get."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the folder that all executors share, which cuts its lineage.

    The folder is the session's ``spark.checkpoint.dir``; whoever owns it removes it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up", np.empty(0, np.uint64))
    if len(have) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 4 * PIECE_BYTES:  # made for one long text: not kept
        _powers.clear()
    return up, down


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``, equal for equal bytes wherever they stand."""
    up, down = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Words:
    """The words of some texts, in order.

    starts, ends: bytes in ``data``, the lower-cased texts joined by a line feed; doc: number of the
    text; first: for each text the number of its first word, with one more entry for the end.
    """

    def __init__(self, texts: list[bytes | None], is_word: np.ndarray) -> None:
        texts = [t or b"" for t in texts]
        self.raw = b"\n" + b"\n".join(texts) + b"\n"
        self.data = LOWER[np.frombuffer(self.raw, np.uint8)]
        inside = is_word[self.data]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = turns[0::2], turns[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.starts, self.ends)

    def room(self) -> np.ndarray:
        """How many words follow from each word to the end of its text, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of n consecutive hashes from each position; the last n - 1 are of no use."""
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = h[k:] if k else h
        out[: len(part)] = mix(out[: len(part)] * _U(0x9E3779B97F4A7C15) + part + _U(k + 1))
    return out


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of n words; a text of fewer words, but not none, is one run."""
    h, room = words.hashes(), words.room()
    whole = room >= n
    out, doc = chained(h, n)[whole], words.doc[whole]
    counts = np.diff(words.first)
    for size in range(1, n):
        at = words.first[:-1][counts == size]
        if len(at):
            out = np.concatenate((out, chained(h, size)[at] ^ _U(size)))
            doc = np.concatenate((doc, np.flatnonzero(counts == size)))
    return out, doc


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with at most so many bytes of text, or one row; with them their texts as UTF-8."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type):
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        sizes = column.to_pylist()
        begin, total = 0, 0
        for k, value in enumerate(sizes):
            size = len(value) if value else 0
            if k > begin and total + size > most:
                yield batch.slice(begin, k - begin), sizes[begin:k]
                begin, total = k, 0
            total += size
        if len(sizes) > begin:
            yield batch.slice(begin), sizes[begin:]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive values as one list for each count."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def remainder(column: str, by: int):
    """crc32 of an id as text, modulo a number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
