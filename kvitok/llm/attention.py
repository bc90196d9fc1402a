"""A small causal self-attention language model over subword ids, in numpy.

Every subword attends to those before it in its context window; what it gathers, and a term of its
own, give weights of ``EXPERTS`` distributions over the next subword, whose mixture is the prediction.
So probabilities sum to 1 without a softmax over the vocabulary. Keys, queries and values are looked up
by id, with a bias by distance. Ids that the training texts lack share one entry evenly.

Training: the own term and the distributions start from expectation maximisation on the counts of all
pairs, whose sums are added up over parts of the pairs. Then parts of the texts learn apart from that
start, by a gradient step on each batch of their windows, each window once at every size of input; an
entry's mean over the parts, weighed by how often it stands in each, is the attention, and the
distributions are one more expectation step over all places of all parts.

Scoring: windows of ``CONTEXT + STEP`` subwords overlap by ``CONTEXT``; a batch of windows is one masked
attention, in which the last ``STEP`` subwords of each window are scored, so each is scored once.
"""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np

EXPERTS, KEY = 32, 8
CONTEXT, STEP = 16, 16
#: Windows that are scored at once, and that a gradient step reads.
BATCH, STEP_BATCH = 512, 64


def load_subwords(path: str, pattern: str):
    """The encoding of a tiktoken vocabulary file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _filled(stream: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and text numbers of the places of whole windows, CONTEXT + STEP wide, the first context empty (text -1)."""
    filled = -len(stream) % STEP
    ids = np.concatenate((np.zeros(CONTEXT, stream.dtype), stream, np.zeros(filled, stream.dtype)))
    return ids, np.concatenate((np.full(CONTEXT, -1), text, np.full(filled, -2)))


def _by_window(places: np.ndarray) -> np.ndarray:
    """Rows of consecutive places, which lie one after the other, as overlapping windows, without a copy."""
    down, across = places.strides
    return np.ndarray((len(places) // STEP - CONTEXT // STEP, CONTEXT + STEP, places.shape[1]), places.dtype, places, 0, (STEP * down, down, across))


def _hide(weight: np.ndarray, o: np.ndarray) -> int:
    """Takes places of other texts from the weights of windows; how many windows hold several texts."""
    edge = np.flatnonzero(o[:-CONTEXT:STEP] != o[CONTEXT + STEP - 1 :: STEP])
    if len(edge):
        of = o[edge[:, None] * STEP + _WINDOW]
        weight[edge] *= of[:, None, :-1] == of[:, CONTEXT - 1 : -1, None]
    return len(edge)


class Model:
    """Tables by id: query, key, value (to experts), own (to experts), expert (distributions), and bias by distance."""

    def __init__(self, tables: dict[str, np.ndarray], entry: np.ndarray, share: float) -> None:
        self.tables, self.entry, self.share = tables, entry, share

    @cached_property
    def moved(self) -> np.ndarray:
        """The tables that gradient steps move, side by side."""
        return np.concatenate([self.tables[k] for k in MOVED], axis=1)

    def log10(self, stream: np.ndarray, text: np.ndarray) -> np.ndarray:
        """log10 probability of each place of a stream of entries, given those before it in its text.

        The sums of both softmaxes are divided out at the end.
        """
        bias, (at_query, at_key, at_value, at_own, _) = self.tables["bias"][_NEAR], _PARTS
        ids, of = _filled(stream, text)
        out = np.empty(len(ids) - CONTEXT, np.float32)
        for k in range(0, len(out), BATCH * STEP):
            a, o = ids[k : k + CONTEXT + BATCH * STEP], of[k : k + CONTEXT + BATCH * STEP]
            n = (len(a) - CONTEXT) // STEP
            held = self.moved.take(a, axis=0)
            asked, given = held[CONTEXT - 1 : -1].reshape(n, STEP, -1), _by_window(held)[:, :-1]
            weight = np.matmul(asked[..., at_query], given[..., at_key].transpose(0, 2, 1))
            weight += bias
            np.exp(np.clip(weight, -60, 60, out=weight), out=weight)
            weight *= _CAUSAL
            _hide(weight, o)
            mixed = np.matmul(weight, given[..., at_value])
            mixed /= np.maximum(_sums(weight), np.float32(1e-30))
            mixed += asked[..., at_own]
            np.exp(np.clip(mixed, -60, 60, out=mixed), out=mixed)
            whole = _sums(mixed)
            mixed *= self.tables["expert"].take(a[CONTEXT:], axis=0).reshape(mixed.shape)
            out[k : k + n * STEP] = np.log10(np.maximum(_sums(mixed) / whole, 1e-30)).ravel()
        return out[: len(stream)]


def _distances() -> np.ndarray:
    """How far each asking place of a window stands behind each given one."""
    return np.arange(CONTEXT - 1, CONTEXT + STEP - 1)[:, None] - np.arange(CONTEXT + STEP - 1)[None, :]


#: Distance of each asking place of a window from each given one, and whether it may be seen.
_NEAR = np.maximum(_distances(), 0)
_CAUSAL = (_distances() >= 0).astype(np.float32)
_ONES = np.ones((max(CONTEXT + STEP, EXPERTS), 1), np.float32)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the last axis, which stays; a product with ones is faster than a sum of short rows."""
    return (x.reshape(-1, x.shape[-1]) @ _ONES[: x.shape[-1]]).reshape(*x.shape[:-1], 1)


def _columns(totals: np.ndarray, smooth: float, base: np.ndarray) -> np.ndarray:
    """Distributions over entries, one a column, smoothed towards the base distribution."""
    return (totals + smooth * base[:, None]) / (totals.sum(axis=0, keepdims=True) + smooth)


class Start:
    """What training starts from: entries of the known ids, their shares, and random own terms and distributions."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, vocabulary: int, begin: int, seed: int = 5) -> None:
        """known: ids that the texts hold, in order and ``begin`` among them; counts: how often each follows another."""
        rng = np.random.default_rng(seed)
        self.n, self.begin = len(known) + 1, int(np.searchsorted(known, begin))
        self.entry = np.full(vocabulary, len(known), np.int64)
        self.entry[known] = np.arange(len(known))
        self.share = 1.0 / max(1, vocabulary - len(known))
        base = np.append(counts, 0) + 0.5
        base[self.begin] = 0.0  # never predicted
        self.base = base / base.sum()
        self.own = rng.dirichlet(np.ones(EXPERTS), self.n)
        self.expert = _columns(rng.random((self.n, EXPERTS)) * self.base[:, None], 0.1, self.base)
        self.normal = rng.normal(0, 1, (self.n, 2 * KEY + EXPERTS))

    def take(self, sums: np.ndarray) -> None:
        """A step of expectation maximisation from ``pair_sums`` over all pairs."""
        own = sums[:, :EXPERTS] + 0.2 / EXPERTS
        self.own = own / own.sum(axis=1, keepdims=True)
        self.expert = _columns(sums[:, EXPERTS:], 50.0, self.base)

    def model(self) -> Model:
        f = np.float32
        query, key, value = np.split(self.normal, [KEY, 2 * KEY], axis=1)
        tables = {
            "query": (0.3 * query).astype(f), "key": (0.3 * key).astype(f), "value": (0.02 * value).astype(f),
            "own": np.log(self.own).astype(f), "expert": self.expert.astype(f), "bias": (-0.1 * np.arange(CONTEXT + STEP)).astype(f),
        }
        return Model(tables, self.entry, self.share)


def pair_sums(own: np.ndarray, expert: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How much of the pairs (x, y), each c times, falls to each expert: by x and, in further columns, by y."""
    post = own[x] * expert[y]
    post *= (c / post.sum(axis=1))[:, None]
    return np.concatenate((_summed(x, post, len(own)), _summed(y, post, len(own))), axis=1)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each entry, column by column."""
    rows, values = rows.ravel(), values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)


#: Tables that gradient steps move, by id, and their columns.
MOVED = {"query": KEY, "key": KEY, "value": EXPERTS, "own": EXPERTS}
_ENDS = np.cumsum([*MOVED.values()])
#: Columns of each of them in a step, and behind them of the expectations.
_PARTS = [slice(z - n, z) for z, n in zip([*_ENDS.tolist(), int(_ENDS[-1]) + EXPERTS], [*MOVED.values(), EXPERTS], strict=True)]
#: Places of a window, what hides those that an asking place may not see, and that runs end at both ends.
_WINDOW = np.arange(CONTEXT + STEP)
_UNSEEN = np.where(_CAUSAL > 0, np.float32(0), np.float32(-np.inf))
_TRUE = np.array([True])


class Learner:
    """Gradient steps from a model over windows, and the expectations of all places they saw."""

    def __init__(self, model: Model, seed: int, rate: float = 0.02) -> None:
        t = model.tables
        self.expert, self.bias = t["expert"], t["bias"].copy()
        self.moved = model.moved.copy()
        self.rng, self.rate, self.steps = np.random.default_rng(seed), rate, 0
        self.slopes = [np.zeros_like(self.moved) for _ in range(2)]
        self.bias_slopes = [np.zeros_like(self.bias) for _ in range(2)]
        self.totals = np.zeros(self.expert.shape, np.float32)
        self.seen = np.zeros(len(self.totals))
        # Of each place of a step: what its entry's tables hold, and the slopes and expectations that it gives, in
        # order of places and of entries. The arrays are made once, as a step takes less time than clearing them.
        rows, width = CONTEXT + STEP_BATCH * STEP, _ENDS[-1] + EXPERTS
        self.held = np.empty((rows, _ENDS[-1]), np.float32)
        self.found, self.sorted, self.sums = (np.zeros((rows, width), np.float32) for _ in range(3))
        self.weight, self.by_weight, self.work = (np.empty((STEP_BATCH, STEP, CONTEXT + STEP - 1), np.float32) for _ in range(3))
        self.given = np.empty((STEP_BATCH, CONTEXT + STEP - 1, KEY + EXPERTS), np.float32)
        self.z, self.post, self.slope = (np.empty((STEP_BATCH, STEP, EXPERTS), np.float32) for _ in range(3))

    def see(self, stream: np.ndarray, text: np.ndarray) -> None:
        """Steps over all windows of a stream of entries, runs of them in a shuffled order."""
        self.seen += np.bincount(stream, minlength=len(self.seen))
        ids, of = _filled(stream, text)
        # Short numbers are put in order by their digits.
        short = ids.astype(np.uint16) if len(self.moved) <= 1 << 16 else ids
        run = STEP_BATCH * STEP
        for k in self.rng.permutation(-(-len(stream) // run)) * run:
            to = k + CONTEXT + run
            self._step(ids[k:to], of[k:to], short[k:to])

    def _step(self, a: np.ndarray, o: np.ndarray, short: np.ndarray) -> None:
        self.steps += 1
        rows = len(a)
        n = (rows - CONTEXT) // STEP
        held = self.moved.take(a, axis=0, out=self.held[:rows], mode="clip")
        asked, given = held[CONTEXT - 1 : -1].reshape(n, STEP, -1), _by_window(held)[:, :-1]
        at_query, at_key, at_value, at_own, at_target = _PARTS
        query, key, value = asked[..., at_query], given[..., at_key], given[..., at_value]
        weight, z, post, slope = self.weight[:n], self.z[:n], self.post[:n], self.slope[:n]
        np.matmul(query, key.transpose(0, 2, 1), out=weight)
        weight += self.bias[_NEAR] + _UNSEEN
        np.exp(np.minimum(weight, 60, out=weight), out=weight)
        several = _hide(weight, o)
        weight /= np.maximum(_sums(weight), np.float32(1e-30))
        np.matmul(weight, value, out=z)
        z += asked[..., at_own]
        np.exp(np.minimum(z, 60, out=z), out=z)
        z /= _sums(z)
        self.expert.take(a[CONTEXT:], axis=0, out=post.reshape(n * STEP, -1), mode="clip")
        post *= z
        post *= 1 / np.maximum(_sums(post), np.float32(1e-30))
        np.subtract(post, z, out=slope)
        by_place, valid = slope.reshape(n * STEP, -1), n * STEP
        if several:
            # First places of texts, which nothing predicts, and those that fill the last window.
            none = np.flatnonzero((o[CONTEXT:] < 0) | (o[CONTEXT:] != o[CONTEXT - 1 : -1]))
            post.reshape(n * STEP, -1)[none] = by_place[none] = 0
            valid -= len(none)
        slope /= max(1, valid)
        by_score = np.matmul(slope, value.transpose(0, 2, 1), out=self.by_weight[:n])
        by_score -= _sums(np.multiply(weight, by_score, out=self.work[:n]))
        by_score *= weight
        # Places that ask, and those that follow, fill the same rows in every whole step; the rest are cleared.
        found = self.found[:rows]
        found[-1] = 0
        asking, first, second = found[CONTEXT - 1 : -1].reshape(n, STEP, -1), found[:-CONTEXT].reshape(n, STEP, -1), found[STEP:].reshape(n, STEP, -1)[:, :-1]
        np.matmul(by_score, key, out=asking[..., at_query])
        given = self.given[:n]
        asking[..., at_own] = slope
        found[CONTEXT:, at_target] = post.reshape(n * STEP, -1)
        np.matmul(by_score.transpose(0, 2, 1), query, out=given[..., :KEY])
        np.matmul(weight.transpose(0, 2, 1), slope, out=given[..., KEY:])
        both = slice(at_key.start, at_value.stop)
        found[-CONTEXT:, both] = 0
        first[..., both] = given[:, :STEP]
        second[..., both] += given[:, STEP:]
        # Sums by entry: places in order of their entries, then sums of runs. Half the runs are of one place.
        order = np.argsort(short, kind="stable")
        ordered = a[order]
        opens = np.concatenate((_TRUE, ordered[1:] != ordered[:-1], _TRUE))
        alone = opens[:-1] & opens[1:]
        once, again = order[alone], order[~alone]
        starts = np.flatnonzero(opens[:-1][~alone])
        entries, n_again = np.concatenate((a[again[starts]], a[once])), len(starts)
        sums = self.sums[: len(entries)]
        if n_again:
            np.add.reduceat(found.take(again, axis=0, out=self.sorted[: len(again)], mode="clip"), starts, axis=0, out=sums[:n_again])
        found.take(once, axis=0, out=sums[n_again:], mode="clip")
        self.totals[entries] += sums[:, at_target]
        self._move(self.moved, self.slopes, entries, sums[:, : _ENDS[-1]])
        near = np.bincount(_NEAR.ravel(), by_score.sum(axis=0).ravel(), len(self.bias)).astype(np.float32)
        self._move(self.bias, self.bias_slopes, _WINDOW, near)

    def _move(self, table: np.ndarray, slopes: list[np.ndarray], at: np.ndarray, grad: np.ndarray) -> None:
        """A step of Adam, uphill, of the entries that the run holds."""
        first, second = (s.take(at, axis=0) for s in slopes)
        first *= np.float32(0.9)
        part = np.multiply(grad, np.float32(0.1))
        first += part
        second *= np.float32(0.99)
        np.square(grad, out=part)
        part *= np.float32(0.01)
        second += part
        slopes[0][at], slopes[1][at] = first, second
        second /= np.float32(1 - 0.99**self.steps)
        np.sqrt(second, out=second)
        second += np.float32(1e-8)
        first /= second
        first *= np.float32(self.rate / (1 - 0.9**self.steps))
        table[at] += first

    def by_entry(self) -> np.ndarray:
        """How often each entry stood, its moved tables as often, and its expectations: a row each."""
        return np.concatenate((self.seen[:, None], self.seen[:, None] * self.moved, self.totals), axis=1)

    def by_step(self) -> np.ndarray:
        return np.concatenate(([self.steps], self.steps * self.bias))


def mean_model(start: Model, base: np.ndarray, by_entry: np.ndarray, by_step: np.ndarray) -> Model:
    """The model of parts that learned apart, from the sums of what they found; entries that none saw stay."""
    f, t = np.float32, dict(start.tables)
    seen, at = by_entry[:, :1], 1
    for k, width in MOVED.items():
        t[k] = np.where(seen > 0, by_entry[:, at : at + width] / np.maximum(seen, 1), t[k]).astype(f)
        at += width
    if by_step[0]:
        t["bias"] = (by_step[1:] / by_step[0]).astype(f)
        t["expert"] = _columns(by_entry[:, at:], 50.0, base).astype(f)
    return Model(t, start.entry, start.share)
