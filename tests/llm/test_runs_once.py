"""Work on a block of texts grows with its runs, not with runs times the block."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from kvitok.llm import scoring
from kvitok.llm.attention import load_subwords

TEXTS = [f"word{k % 7} and more words {k} word{k % 5}".encode() for k in range(60)]


@pytest.fixture(scope="module")
def block() -> scoring._Block:
    subwords = load_subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return scoring._Block.read(TEXTS, subwords)


class _Counted:
    """A table that knows how many entries were asked for."""

    def __init__(self) -> None:
        self.asked = 0

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        self.asked += len(at)
        return np.asarray(at)


def test_runs_look_up_their_own_subwords_only(block):
    table, whole = _Counted(), 0
    for k in range(0, len(block.place), 10):
        stream, _, _ = block.stream(table, -1, k, k + 10)
        whole += len(stream)
    assert table.asked <= whole
    # What the runs give is what one run gives, but for the begin that each opens with.
    one, _, _ = block.stream(np.arange(60_000), -1, 0, len(block.place))
    runs = [block.stream(np.arange(60_000), -1, k, k + 10)[0] for k in range(0, len(block.place), 10)]
    assert [x for x in np.concatenate(runs).tolist() if x >= 0] == [x for x in one.tolist() if x >= 0]


def test_pairs_of_a_block_are_counted_over_all_its_runs(block):
    learns = [k % 2 == 0 for k in range(len(TEXTS))]
    packed = zstandard.ZstdCompressor().compress(block.place.astype(np.int32).tobytes())
    row = pa.table({
        "block": [0], "doc_ids": [list(range(len(TEXTS)))], "learns": [learns], "n_tokens": [block.n_tokens.tolist()], "places": [packed],
        "words": pa.array([block.word.view(np.int64).tolist()], pa.list_(pa.int64())), "ids": pa.array([block.ids.tolist()], pa.list_(pa.int32())),
        "sizes": pa.array([block.sizes.tolist()], pa.list_(pa.int32())),
    })
    vocabulary = 60_000
    found = [x for batch in scoring._pairs(vocabulary)(iter(row.to_batches())) for x in batch.to_pylist()]
    assert len(found) == len({(x["x"], x["y"]) for x in found})
    plain: dict = {}
    for start, stop in block.cuts(np.array(learns)):
        stream, text, _ = block.stream(np.arange(vocabulary), vocabulary - 2, start, stop)
        for a, b, s, t in zip(stream, stream[1:], text, text[1:]):
            if s == t:
                plain[int(a), int(b)] = plain.get((int(a), int(b)), 0) + 1
    assert {(x["x"], x["y"]): x["n"] for x in found} == plain
