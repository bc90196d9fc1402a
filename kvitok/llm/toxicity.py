"""Toxicity by compression distance with two zstandard dictionaries.

Learning, from a bounded sample of labelled texts of the training folds: for each class the strings at
word beginnings that it uses far more often than the other class, each counted once for every distinct
word before it, so that copies of a text do not count again. The toxic dictionary holds the toxic
class's strings. The ordinary dictionary holds the parts of those strings that ordinary texts use too,
so that they cancel out, and then the ordinary class's own strings. Both have the same length.

Scoring: a text's windows of ``WINDOW`` bytes are compressed with either dictionary; the difference of
the lengths tells how much better the toxic one fits. The greatest difference, and how many windows
reach the thresholds, give the score by a logistic curve that is fitted on a part of the sample that
the dictionaries have not seen. Every window of every text counts.

Tasks keep no state; the model is two dictionaries of some kilobytes and a few weights. Empty and null
texts have no window of any difference and get the score of such texts. Without labels of both
classes every score is 0. Repeated rows score alike; labels that contradict each other for an
id count as toxic. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvitok.llm.common import LOWER, pieces, remainder, small_batches, stored, table

#: Most texts of a class to learn from, the first by a hash of their ids, and their longest length.
SAMPLE, SAMPLE_CHARS = {1: 2000, 0: 5000}, 20_000
WINDOW, STRIDE = 128, 116
#: Letters at the beginning of a word that are capitals.
HEAD = 6
#: Bytes of each dictionary.
DICTIONARY = 2048
#: Least lead of a string in log odds; least number of words before it, as a share of the class's texts within limits.
LEAD, SUPPORT, SUPPORT_LIMITS = 3.0, 0.1, (4, 20)
#: Differences in bytes that are counted as reached.
THRESHOLDS = (1, 2, 3, 4, 6)
#: Share of the sample that the curve is fitted on.
CALIBRATION = 3

#: Lower case, and one kind of white space.
_LOWER = LOWER.copy()
_LOWER[9:14] = 32
#: Gives every window one match that both dictionaries share, so that none is stored uncompressed.
_PAD = b"\x00" * 32


def plain(text: bytes | None) -> bytes:
    """Lower-cased text whose words begin in capitals: ``HEAD`` letters tell a beginning from the same letters inside a word."""
    data = _LOWER[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)]
    space = data == 32
    at = np.arange(len(data))
    begun = at - np.maximum.accumulate(np.where(space, at, 0)) <= HEAD
    return np.where(begun & (data >= 97) & (data <= 122), data - 32, data).astype(np.uint8).tobytes()


def beginnings(texts: list[bytes], least: int = 4, most: int = 12) -> Counter:
    """Strings at word beginnings, each counted once for every distinct pair of words that it begins in."""
    pairs = set()
    for text in texts:
        words = text.split(b" ")
        pairs.update(zip([b"", *words], words))
    count: Counter = Counter()
    for _, word in pairs:
        if not word:
            continue
        word = b" " + word + b" "
        count.update(word[:n] for n in range(least, min(most, len(word)) + 1))
    return count


def leading(own: Counter, other: Counter, size: int, support: float) -> list[bytes]:
    """The strings that one class uses more, best first, none inside another."""
    total = [max(1, sum(n for s, n in c.items() if len(s) == 4)) for c in (own, other)]
    found = []
    for s, n in own.items():
        lead = math.log((n + 0.5) / total[0]) - math.log((other[s] + 0.5) / total[1])
        if n >= support and lead > LEAD:
            found.append((-n * lead * (1 + 0.02 * len(s)), s))
    out: list[bytes] = []
    for _, s in sorted(found):
        if sum(map(len, out)) + len(s) + len(out) < size and not any(s in o or o in s for o in out):
            out.append(s)
    return out


def shared_parts(strings: list[bytes], own: list[bytes], ordinary: list[bytes], least: int = 5, share: float = 0.2) -> list[bytes]:
    """Parts of the strings, of five bytes or more, that ordinary texts hold ``least`` times and ``share`` as often as own texts do."""
    there, here, out = b" ".join(ordinary), b" ".join(own), []
    for s in strings:
        for n in range(len(s) - 1, 4, -1):
            for k in range(len(s) - n + 1):
                part = s[k : k + n]
                if not any(part in o for o in out):
                    count = there.count(part)
                    if count >= least and count / len(there) >= share * here.count(part) / len(here):
                        out.append(part)
    return out


class Dictionaries:
    """Compressors of both classes."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, window_log=12, hash_log=10, chain_log=10, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compressors = [zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (toxic, ordinary)]

    def differences(self, text: bytes) -> np.ndarray:
        """By window, how many bytes the toxic dictionary saves against the ordinary one."""
        out = []
        for begin in range(0, max(1, len(text)), STRIDE << 12):
            part = text[begin : begin + (STRIDE << 12) + WINDOW - STRIDE]
            windows = [_PAD + part[k : k + WINDOW] for k in range(0, max(1, len(part) - (WINDOW - STRIDE)), STRIDE)]
            toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(windows)), np.int64, len(windows)) for c in self.compressors)
            out.append(ordinary - toxic)
        return np.concatenate(out)


def features(differences: np.ndarray) -> np.ndarray:
    n = len(differences)
    reached = [(differences >= t).sum() for t in THRESHOLDS]
    return np.array([1.0, min(max(int(differences.max(initial=0)), 0), 8) / 4, math.log(1 + n) / 4, *(math.log1p(r) for r in reached), *(10 * r / (n + 9) for r in reached[1:4])])


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights of a logistic curve by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(bend, slope), -3, 3)
    return w


def learn(docs: DataFrame, labels: DataFrame, may_learn) -> dict | None:
    """Dictionaries and weights from a bounded sample of labelled rows; None without both classes.

    may_learn: a condition on ``doc_id``. The sample's ids are picked before their texts are read.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select("doc_id", F.length("text").alias("n")).where(F.col("n") <= SAMPLE_CHARS).select("doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.join(short, "doc_id", "left_semi").withColumn("nth", nth)
    picked = picked.where(((F.col("toxic") == 1) & (F.col("nth") <= SAMPLE[1])) | ((F.col("toxic") == 0) & (F.col("nth") <= SAMPLE[0])))
    picked = stored(picked, "toxicity-sample")
    found = docs.select("doc_id", "text").join(picked, "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    found = found.select("doc_id", "toxic", "nth", F.col("text").cast("binary").alias("text")).dropDuplicates(["doc_id"]).toArrow().to_pylist()
    rows = sorted(((r["nth"], int(r["toxic"]), plain(bytes(r["text"]))) for r in found), key=lambda r: (r[1], r[0]))
    texts = {c: [t for nth, toxic, t in rows if toxic == c and nth % CALIBRATION] for c in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    count = {c: beginnings(texts[c]) for c in texts}
    support = {c: min(max(SUPPORT * len(texts[c]), SUPPORT_LIMITS[0]), SUPPORT_LIMITS[1]) for c in texts}
    toxic = leading(count[1], count[0], DICTIONARY // 2, support[1])
    ordinary = [*shared_parts(toxic, texts[1], texts[0]), *leading(count[0], count[1], DICTIONARY // 4, support[0])]
    # The best strings stand last, where they are nearest; the end of a dictionary is not indexed.
    laid = lambda strings: (b"\x01" * DICTIONARY + b" ".join(strings[::-1]))[-DICTIONARY:] + b"\x01" * 16
    model = {"toxic": laid(toxic), "ordinary": laid(ordinary)}
    own = Dictionaries(**model)
    rest = [(toxic, t) for nth, toxic, t in rows if not nth % CALIBRATION] or [(toxic, t) for _, toxic, t in rows]
    x, y = np.array([features(own.differences(t)) for _, t in rest]), np.array([c for c, _ in rest], float)
    return model | {"weights": fitted(x, y)}


def score_toxicity(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, and the greatest difference and number of windows of each row of ``docs``."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Dictionaries(model["toxic"], model["ordinary"]) if model else None
        for rows, texts in pieces(batches):
            score, most, n = [], [], []
            for text in texts:
                d = own.differences(plain(text)) if own else np.zeros(1, np.int64)
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(d) @ model["weights"]))))) if own else 0.0)
                most.append(int(d.max())), n.append(len(d))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score, pa.float64()), pa.array(most, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "score", "greatest", "windows"])

    scored = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double, greatest int, windows int")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of three folds in four."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels, remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "greatest", "windows")
