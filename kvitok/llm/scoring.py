"""Language-model scores of whole texts: attention over subwords, joined with corpus counts of words.

A text's tokens are its words, lower-cased, and one end. A word's probability is the mean of two: what
the attention model gives its subwords one after the other, and its add-one share of all training
tokens. Both learn from all training texts: the counts of words and of pairs of subwords are summed over
them, and the attention learns apart from all windows of each block of texts, once at every size of
input, and is then averaged.

Texts are dealt by a hash of their id and text into tasks of about ``BLOCK_BYTES``, and stand there in
the order of id and text: scores do not depend on the order of rows, but for the last digits of sums,
and a task that runs again finds the same. Tasks gather their texts into blocks of that size, read each
distinct word of a block into subwords once, and store the block as its words, their subwords and the
places of words; nothing reads a text again. Only distinct words of a block go through the shuffle.
Counts are summed by word and go back to the blocks that hold the word and do not know its count yet;
block and counts meet in one group of bounded size, where the texts are scored. A word in every block
costs one row a block. Rows that repeat both id and text meet in one task, which works block by block.

Nulls and empty texts have the end alone. Rows of a null id are scored and not learned from; rows that
repeat are each scored, and counted as often as they stand in the training texts. Extra columns are
not read. An empty table gives an empty table; without training texts the model knows no word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.attention import EXPERTS, Learner, Model, Start, load_subwords, mean_model, pair_sums
from kvitok.llm.common import NOT_SPACE, PIECE_BYTES, Words, lists, pieces, remainder, signed, small_batches, stored, table

BLOCK_BYTES = 16 << 20
#: Steps of expectation maximisation on pairs, and pairs of a task.
PAIR_STEPS, PAIR_ROWS = 40, 1 << 20
#: Pairs computed at once, and entries whose sums travel together.
PAIR_BLOCK, SLICE = 1 << 16, 128
#: Share of the corpus counts in a word's probability.
COUNTS = 0.5
#: Hash that stands for the end of a text.
END = np.uint64(1)
#: Words that are scored at once, and most that learn at once.
RUN, LEARN_RUN = 1 << 15, 1 << 20


def _joined(texts: list[bytes]) -> Iterator[Words]:
    """Words of runs of texts."""
    begin, total = 0, 0
    for k, text in enumerate(texts):
        if k > begin and total + len(text) > PIECE_BYTES:
            yield Words(texts[begin:k], NOT_SPACE)
            begin, total = k, 0
        total += len(text)
    if len(texts) > begin:
        yield Words(texts[begin:], NOT_SPACE)


class _Block:
    """Some texts as places of distinct words: the words' hashes in order, and their subwords.

    place: number of the word of each token, ends included; n_tokens: tokens of each text; ids, sizes: subwords of all
    words one after the other, and how many a word has.
    """

    def __init__(self, place, n_tokens, word, ids, sizes) -> None:
        self.place, self.n_tokens, self.word, self.ids, self.sizes = place, n_tokens, word, ids, sizes
        self.first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(n_tokens)), n_tokens)

    @classmethod
    def read(cls, texts: list[bytes], subwords) -> _Block:
        none = np.zeros(0, np.int64)
        hash_, n_tokens, starts, ends, data, before = [none.astype(np.uint64)], [none], [none], [none], [], 0
        for words in _joined(texts):
            # A text's words, each moved on by the ends of the texts before, and then its own end.
            n, first = len(words.first) - 1, words.first[1:] + np.arange(len(words.first) - 1)
            at = np.arange(len(words)) + words.doc
            for all_, values, end in ((hash_, words.hashes(), END), (starts, words.starts + before, 0), (ends, words.ends + before, 0)):
                all_.append(np.full(len(words) + n, end, values.dtype))
                all_[-1][at] = values
            n_tokens.append(np.diff(first, prepend=-1))
            data.append(words.data.tobytes())
            before += len(words.data)
        word, place = np.unique(np.concatenate(hash_), return_inverse=True)
        # Only the first of a block's equal words is read.
        head = np.empty(len(word), np.int64)
        head[place[::-1]] = np.arange(len(place))[::-1]
        raw, end, encode = b"".join(data), [subwords.n_vocab + 1], subwords.encode_ordinary
        ids, sizes = array("i"), array("q")
        for a, z in zip(np.concatenate(starts)[head].tolist(), np.concatenate(ends)[head].tolist(), strict=True):
            own = encode(" " + raw[a:z].decode()) if z > a else end
            ids.extend(own)
            sizes.append(len(own))
        return cls(place, np.concatenate(n_tokens), word, np.array(ids, np.int32), np.array(sizes, np.int64))

    @classmethod
    def of(cls, row: pa.RecordBatch | pa.Table, at: int = 0) -> _Block:
        """The block of a stored row."""
        get = lambda c: row.column(row.schema.get_field_index(c))[at]
        place = np.frombuffer(zstandard.ZstdDecompressor().decompress(get("places").as_py()), np.int32)
        return cls(place, get("n_tokens").values.to_numpy(), get("words").values.to_numpy().view(np.uint64), get("ids").values.to_numpy(), get("sizes").values.to_numpy().astype(np.int64))

    def stream(self, table: np.ndarray, begin: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The subwords of tokens ``start`` to ``stop`` by way of ``table``, ``begin`` before each text and run.

        With them the text number of each, and where each token's own end.
        """
        place, doc = self.place[start:stop], self.doc[start:stop]
        sizes, opens = self.sizes[place], np.concatenate((np.ones(min(1, len(doc)), bool), doc[1:] != doc[:-1]))
        n = sizes + opens
        ends = np.cumsum(n)
        at = np.repeat(self.first[place] + sizes - ends, n)
        at += np.arange(len(at))
        # Of the block's subwords only those of the run are looked up, as a block is read in many runs.
        stream = table[self.ids[at]]
        stream[(ends - n)[opens]] = begin  # where the subword before the word's own was looked up
        return stream, np.repeat(doc, n), ends

    def cuts(self, learns: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of tokens of texts that may be learned from, whole texts unless one is longer than a run."""
        ends = np.cumsum(self.n_tokens)
        starts, begin, stop = ends - self.n_tokens, 0, 0
        for k in np.flatnonzero(learns):
            if starts[k] != stop or ends[k] - begin > LEARN_RUN:
                if stop > begin:
                    yield begin, stop
                begin = starts[k]
            while ends[k] - begin > LEARN_RUN:
                yield begin, begin + LEARN_RUN
                begin += LEARN_RUN
            stop = ends[k]
        if stop > begin:
            yield begin, stop


BLOCKS = "block long, doc_ids array<long>, learns array<boolean>, n_tokens array<long>, places binary, words array<long>, counts array<long>, ids array<int>, sizes array<int>"


def _blocks(path: str, pattern: str):
    """One row a block: its rows, places, distinct words with their training counts, and their subwords."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, subwords = TaskContext.get().partitionId() << 32, load_subwords(path, pattern)
        ids: list = []
        learns: list[bool] = []
        texts: list[bytes] = []

        def block() -> pa.RecordBatch:
            own = _Block.read(texts, subwords)
            count = np.bincount(own.place, np.array(learns, float)[own.doc], len(own.word)).astype(np.int64)
            packed = zstandard.ZstdCompressor(level=1).compress(own.place.astype(np.int32).tobytes())
            one = np.array([1])
            all_ = lambda values, kind: lists(values, one * len(values), kind)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([learns], pa.list_(pa.bool_())), all_(own.n_tokens, pa.int64()), pa.array([packed], pa.binary()),
                all_(signed(own.word), pa.int64()), all_(count, pa.int64()), all_(own.ids, pa.int32()), all_(own.sizes, pa.int32()),
            ], ["block", "doc_ids", "learns", "n_tokens", "places", "words", "counts", "ids", "sizes"])

        for rows, part in pieces(batches):
            ids += rows.column(0).to_pylist()
            learns += rows.column(rows.schema.get_field_index("learns")).to_pylist()
            texts += [t or b"" for t in part]
            if sum(map(len, texts)) >= BLOCK_BYTES:
                yield block()
                number, ids, learns, texts = number + 1, [], [], []
        if texts:
            yield block()

    return work


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, np.ndarray]]:
    """Number, block and which texts may be learned from, of each stored block."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[k]  # noqa: B023, E731
            learns = np.array(get("learns").as_py(), bool) & np.array([x is not None for x in get("doc_ids").as_py()], bool)
            yield get("block").as_py(), _Block.of(batch, k), learns


def _scores(sent, tokens: int, distinct: int):
    def work(blocks: pa.Table, found: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        ids = blocks.column("doc_ids")[0].values
        own, model = _Block.of(blocks), sent.value
        count = blocks.column("counts")[0].values.to_numpy().copy()
        if found.num_rows:
            count[np.searchsorted(own.word, found.column("word").to_numpy().view(np.uint64))] = found.column("c").to_numpy()
        unknown, begin = len(model.tables["own"]) - 1, int(model.entry[-2])
        attended = np.empty(len(own.place))
        for k in range(0, len(own.place), RUN):
            stream, text, ends = own.stream(model.entry, begin, k, k + RUN)
            log10 = model.log10(stream, text).astype(np.float64) + np.where(stream == unknown, np.log10(model.share), 0.0)
            opens = np.concatenate(([True], text[1:] != text[:-1]))  # the begin is given, not predicted
            log10[opens] = 0.0
            attended[k : k + RUN] = np.add.reduceat(log10, np.concatenate(([0], ends[:-1])))
        base = np.log10((count + 1.0) / (tokens + distinct + 1.0))[own.place]
        top = np.maximum(base, attended)
        both = top + np.log10(COUNTS * 10.0 ** (base - top) + (1 - COUNTS) * 10.0 ** (attended - top))
        n = len(own.n_tokens)
        by = lambda values: np.bincount(own.doc, values, n)
        return pa.table({
            "doc_id": ids, "n_tokens": pa.array(own.n_tokens, pa.int64()), "n_known": pa.array(by((count > 0)[own.place].astype(float)).astype(np.int64)), "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
            "base_score": pa.array(by(base)), "score": pa.array(by(both)), "attention_score": pa.array(by(attended)),
        })

    return work


def _pairs(vocabulary: int):
    every = np.arange(vocabulary)

    def counted(runs: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(runs), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell // vocabulary), pa.array(cell % vocabulary), pa.array(n.astype(np.int64))], ["x", "y", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, learns in _learnt(batches):
            held, size = [], 0
            for start, stop in own.cuts(learns):
                stream, text, _ = own.stream(every, vocabulary - 2, start, stop)
                same = text[1:] == text[:-1]
                held.append(stream[:-1][same] * vocabulary + stream[1:][same])
                size += len(held[-1])
                # Held-out texts cut a block into many short runs, which hold mostly the same pairs.
                if size >= LEARN_RUN:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    return work


def _sliced(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sums that are not all zero, some entries together."""
    for k in range(0, len(sums), SLICE):
        part = sums[k : k + SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["slice", "body"])


def _added(parts: pa.Table) -> pa.Table:
    whole = sum(np.frombuffer(b.as_py(), np.float32).astype(np.float64) for b in parts.column("body"))
    return pa.table({"slice": parts.column("slice").slice(0, 1), "body": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})


def _gathered(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums over all tasks, by slice; as many as there are entries, at any size of input."""
    found = parts.groupBy("slice").applyInArrow(_added, "slice int, body binary").toArrow()
    return {s: np.frombuffer(b, np.float32) for s, b in zip(found.column("slice").to_pylist(), found.column("body").to_pylist(), strict=True)}


def _whole(found: dict[int, np.ndarray], n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width))
    for k, body in found.items():
        if k >= 0:
            out[k : k + SLICE] = body.reshape(-1, width)
    return out


def _pair_step(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, expert, entry = sent.value
        sums = np.zeros((len(own), 2 * EXPERTS))
        held: list[pa.RecordBatch] = []

        def add() -> None:
            block = pa.Table.from_batches(held)
            x, y, c = (block.column(k).to_numpy() for k in ("x", "y", "n"))
            np.add(sums, pair_sums(own, expert, entry[x], entry[y], c.astype(np.float64)), out=sums)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PAIR_BLOCK:
                add()
        if held:
            add()
        yield from _sliced(sums)

    return work


def _learned(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, steps = sent.value, 0.0, 0.0
        begin = int(model.entry[-2])
        for number, own, learns in _learnt(batches):
            learner = Learner(model, number)
            for start, stop in own.cuts(learns):
                learner.see(*own.stream(model.entry, begin, start, stop)[:2])
            if learner.steps:
                total, steps = total + learner.by_entry(), steps + learner.by_step()
        if isinstance(total, np.ndarray):
            yield from _sliced(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([steps.astype(np.float32).tobytes()], pa.binary())], ["slice", "body"])

    return work


def learn(blocks: DataFrame, path: str, pattern: str) -> Model:
    """The attention model from all rows of stored blocks that may be learned from."""
    context = blocks.sparkSession.sparkContext
    texts = blocks.select("block", "doc_ids", "learns", "n_tokens", "places", "words", "ids", "sizes")
    begin = load_subwords(path, pattern).n_vocab
    vocabulary = begin + 2
    pairs = texts.mapInArrow(_pairs(vocabulary), "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "scoring-pairs")
    follow = pairs.groupBy("y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")).sort("y").toArrow()  # at most the vocabulary
    ids, n = follow.column("y").to_numpy(), follow.column("n").to_numpy()
    start = Start(np.append(ids, begin)[np.argsort(np.append(ids, begin))], np.append(n, 0)[np.argsort(np.append(ids, begin))], vocabulary, begin)
    if not len(ids):
        return start.model()
    tasks = -(-int(follow.column("pairs").to_numpy().sum()) // PAIR_ROWS)
    for _ in range(PAIR_STEPS):
        sent = context.broadcast((start.own, start.expert, start.entry))
        start.take(_whole(_gathered(pairs.coalesce(tasks).mapInArrow(_pair_step(sent), "slice int, body binary")), start.n, 2 * EXPERTS))
        sent.destroy()
    model = start.model()
    sent = context.broadcast(model)
    found = _gathered(texts.mapInArrow(_learned(sent), "slice int, body binary"))
    sent.destroy()
    width = Learner(model, 0).by_entry().shape[1]
    return mean_model(model, start.base, _whole(found, start.n, width), found[-1])


def score_texts(docs: DataFrame, may_learn, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and the attention's own score of each row.

    may_learn: a condition on ``doc_id``. path, pattern: a tiktoken vocabulary that every executor can read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(may_learn, F.lit(False)).alias("learns"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = rows.repartition(n_bytes // BLOCK_BYTES + 1, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    blocks = stored(dealt.mapInArrow(_blocks(path, pattern), BLOCKS), "scoring-blocks")
    words = blocks.select("block", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("block", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counted = stored(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "scoring-counts")
    tokens, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = learn(blocks, path, pattern)
    # A block knows the count of a word that it alone holds.
    more = words.join(counted, "word").where("c > n").select(F.col("block").alias("of"), "word", "c")
    sent = spark.sparkContext.broadcast(model)
    out = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double"
    texts = blocks.select("block", "doc_ids", "n_tokens", "places", "words", "counts", "ids", "sizes")
    return texts.groupBy("block").cogroup(more.groupBy("of")).applyInArrow(_scores(sent, tokens, distinct), out)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from six folds in seven."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, remainder("doc_id", 7) != 2, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "attention_score")
