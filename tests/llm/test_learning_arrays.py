"""A block's words are told apart once, gradient steps reuse their arrays, and both give what plain loops give."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest

from kvitok.llm import scoring
from kvitok.llm.attention import CONTEXT, EXPERTS, KEY, STEP, STEP_BATCH, Learner, Start, load_subwords


@pytest.fixture(scope="module")
def subwords():
    return load_subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _model(entries: int):
    return Start(np.arange(entries), np.arange(entries) + 1, entries + 2, entries - 1).model()


def test_a_block_finds_its_distinct_words_once(monkeypatch):
    calls, plain, asked = [], np.unique, []
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or plain(*a, **k))
    texts = [f"some words {k % 9} and others ".encode() * 900 for k in range(40)]
    block = scoring._Block.read(texts, SimpleNamespace(n_vocab=9, encode_ordinary=lambda text: asked.append(text) or [len(text)]))
    assert sum(map(len, texts)) > 4 * scoring.PIECE_BYTES and len(calls) == 1
    assert len(asked) == len(set(asked)) == len(block.word) - 1 and block.n_tokens.tolist() == [5 * 900 + 1] * 40


def test_a_block_holds_all_words_of_its_texts(subwords):
    texts = [b"", b"The the  cat\n", " Éa b   ".encode(), b" \t", b"x" * scoring.PIECE_BYTES + b" X y", b"cat \x00 \x0b the", b""]
    block = scoring._Block.read(texts, subwords)
    lower = lambda t: t.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = [[*lower(t).replace(b"\x1c", b"?").split(), None] for t in texts]
    assert block.n_tokens.tolist() == [len(w) for w in words]
    own = [block.ids[a : a + n].tolist() for a, n in zip(block.first[block.place], block.sizes[block.place], strict=True)]
    assert own == [[subwords.n_vocab + 1] if w is None else subwords.encode_ordinary(" " + w.decode()) for t in words for w in t]
    assert scoring._Block.read([], subwords).place.tolist() == []


def test_steps_reuse_their_arrays():
    rng = np.random.default_rng(1)
    learner = Learner(_model(300), 0)
    stream, text = rng.integers(0, 299, 4 * STEP_BATCH * STEP), np.zeros(4 * STEP_BATCH * STEP, int)
    learner.see(stream, text)
    tracemalloc.start()
    learner.see(stream, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One array of a step's weights; what the places of a step give and hold takes several of them.
    assert peak < 4 * (4 * STEP_BATCH * STEP * (CONTEXT + STEP))


@pytest.mark.parametrize("sizes", [[40], [1, 3, 70, 2], [STEP], [90, 5]])
def test_a_step_gives_the_slopes_of_plain_loops(sizes):
    rng = np.random.default_rng(2)
    text = np.repeat(np.arange(len(sizes)), sizes)
    stream = rng.choice(np.r_[np.zeros(9, int), np.arange(25)], len(text))
    model = _model(30)
    learner = Learner(model, 0)
    learner.see(stream, text)
    assert learner.steps == 1
    t = {k: v.astype(float) for k, v in model.tables.items()}
    slopes = {k: np.zeros_like(t[k]) for k in ("query", "key", "value", "own", "bias")}
    totals, places = np.zeros_like(t["expert"]), 0
    for at in range(1, len(stream)):
        if text[at] != text[at - 1]:
            continue
        places += 1
        ask, seen = stream[at - 1], [k for k in range(max(0, at // STEP * STEP - CONTEXT), at) if text[k] == text[at]]
        ids, far = stream[seen], at - 1 - np.array(seen)
        weight = np.exp(t["key"][ids] @ t["query"][ask] + t["bias"][far])
        weight /= weight.sum()
        z = np.exp(weight @ t["value"][ids] + t["own"][ask])
        z /= z.sum()
        post = z * t["expert"][stream[at]]
        post /= post.sum()
        totals[stream[at]] += post
        slope = post - z
        by_score = weight * (t["value"][ids] @ slope - weight @ t["value"][ids] @ slope)
        slopes["own"][ask] += slope
        slopes["query"][ask] += by_score @ t["key"][ids]
        np.add.at(slopes["key"], ids, np.outer(by_score, t["query"][ask]))
        np.add.at(slopes["value"], ids, np.outer(weight, slope))
        np.add.at(slopes["bias"], far, by_score)
    want = 0.1 * np.concatenate([slopes[k] for k in ("query", "key", "value", "own")], axis=1) / places
    assert want.shape[1] == 2 * KEY + 2 * EXPERTS
    np.testing.assert_allclose(learner.slopes[0], want, atol=1e-6)
    np.testing.assert_allclose(learner.bias_slopes[0], 0.1 * slopes["bias"] / places, atol=1e-6)
    np.testing.assert_allclose(learner.totals, totals, atol=1e-5)
