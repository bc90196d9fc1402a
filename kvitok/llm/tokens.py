"""Token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded piece by piece at white space where the
tokenizer provably starts anew, and counts of short pieces are remembered. A longer text is cut into
chunks that overlap; each chunk is encoded with offsets, and neighbours are spliced where both see the
same token borders for some tokens running and the border is one that no context can move. If they
show none, the overlap is doubled, up to the whole rest of the text. Memory is that of one chunk.

Nulls and empty texts have no tokens; repeated rows are counted each; other columns are kept out of
the way by selecting id and text alone. An empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.common import pieces, small_batches, table

#: Pieces whose counts are remembered, and their longest length in bytes.
MEMO, MEMO_BYTES = 400_000, 48

Encode = Callable[[str], list[tuple[int, int]]]


def load(path: str):
    """A ``tokenizers`` tokenizer without added tokens, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splits_at_space(tokenizer) -> bool:
    """Whether ASCII white space always ends a token and never belongs to one, as its settings tell.

    True when the pre-tokenizer drops white space and no added token holds any or strips it; tried on
    texts with white space in all places besides.
    """
    for token in tokenizer.get_added_tokens_decoder().values():
        if token.lstrip or token.rstrip or token.single_word or any(c.isspace() for c in token.content):
            return False
    parts = ["a", "bc's", "1", "'s", "<|x|>", "é", ".", "é"]
    count = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
    alone = sum(map(count, parts))
    return count(" \t\n") == 0 and all(count(gap.join(parts)) == alone for gap in (" ", "\n", "\t", "\r", "\x0b", "\x0c", " \n "))


def resynchronised(text: str, encode: Encode, chunk: int, overlap: int, stable: Callable[[str, int], bool], run: int = 4) -> int:
    """Number of tokens of a long text from overlapping chunks.

    encode: offsets of a text's tokens. The chunk from ``begin`` gives all tokens up to a border b; the
    next starts ``overlap`` before the end of the last and gives those from b on. b must be a border of
    both, be stable, and have the same ``run`` borders of both from there on, or the text's end.
    """
    begin, total, done, n = 0, 0, 0, len(text)
    left = encode(text[:chunk])
    end = min(chunk, n)
    while end < n:
        width = overlap
        while True:
            start = max(begin, end - width)
            right_end = min(n, start + max(chunk, 2 * width))
            right = encode(text[start:right_end])
            border = _border([(a + begin, b + begin) for a, b in left if a + begin >= start], [(a + start, b + start) for a, b in right], lambda at: at >= done and stable(text, at), run)
            if border is not None:
                break
            if start == begin:  # the last chunk lies in this one: take its place
                border = done
                break
            width *= 2
        total += sum(1 for a, _ in left if done <= a + begin < border)
        begin, left, end, done = start, right, right_end, border
    return total + sum(1 for a, _ in left if a + begin >= done)


def _border(left: list[tuple[int, int]], right: list[tuple[int, int]], good: Callable[[int], bool], run: int) -> int | None:
    """The last start of a token in both that is good and begins a run that both see alike.

    The last tokens of the left chunk may be cut, so the run must not reach its end.
    """
    at = {a: k for k, (a, _) in enumerate(right)}
    for k in range(len(left) - run - 1, -1, -1):
        a = left[k][0]
        j = at.get(a)
        if j is not None and left[k : k + run] == right[j : j + run] and good(a):
            return a
    return None


def after_space(text: str, at: int) -> bool:
    """Borders behind ASCII white space: no token of a tokenizer that splits there spans one."""
    return at > 0 and text[at - 1] in " \n\t\r\x0b\x0c"


class Counter:
    """Counts tokens of UTF-8 texts."""

    def __init__(self, path: str, chunk_chars: int, overlap_chars: int) -> None:
        self.tokenizer, self.chunk, self.overlap = load(path), chunk_chars, overlap_chars
        self.splits = splits_at_space(self.tokenizer)
        self.memo: dict[bytes, int] = {}

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def counts(self, texts: list[bytes | None]) -> list[int]:
        """A text of more characters than a chunk is spliced; bytes bound characters from above."""
        out = [0] * len(texts)
        short = []
        for k, raw in enumerate(texts):
            if raw and len(raw) > self.chunk and len(text := raw.decode()) > self.chunk and self.splits:
                out[k] = resynchronised(text, self.offsets, self.chunk, self.overlap, after_space)
            elif raw:
                short.append(k)
        if self.splits:
            self._by_piece(texts, short, out)
        else:
            for k in short:
                out[k] = len(self.offsets(texts[k].decode()))
        return out

    def _by_piece(self, texts: list[bytes | None], at: list[int], out: list[int]) -> None:
        cut = [texts[k].split() for k in at]  # bytes are split at ASCII white space only
        memo = self.memo
        new = list({w for words in cut for w in words if w not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({w for words in cut for w in words})
        found = dict(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True)) if new else {}
        memo.update((w, n) for w, n in found.items() if len(w) <= MEMO_BYTES)
        found.update((w, memo[w]) for words in cut for w in words if w in memo) if len(found) != len(new) else None
        for k, words in zip(at, cut, strict=True):
            out[k] = sum(memo[w] if w in memo else found[w] for w in words)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they are over the limit, for each row of ``docs``.

    path: a file of the ``tokenizers`` library that every executor can read. Tokenizers that do not
    split at white space get whole texts, as no border of theirs is proven.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk_chars, overlap_chars)
        for rows, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the lower-casing word tokenizer."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
