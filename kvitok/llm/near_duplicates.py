"""Near duplicates by DartMinHash signatures, banded join and exact verification.

Signatures. A text is a weighted set of its runs of five words; by default each run weighs 1, so
that weighted similarity is the Jaccard similarity. Darts fall on the plane (weight, rank) of each
element as a Poisson process of density 1 that depends on the element alone. A set sees the darts
below its elements' weights. Each dart belongs to one of K coordinates by its hash, and a set keeps the earliest of
each coordinate: two sets agree in a coordinate with probability equal to their similarity. Cells of
height 1 are opened up to the rank at which about ``K ln K + 2 K`` darts are seen, and twice as far for
texts that lack a coordinate.

Classes. Texts of equal sets collapse to one representative first. Representatives that share a band
are compared with the band's centre; pairs of a similarity of 0.8 or more, computed exactly from the
sets, are links. The centre is the member whose bands hold the most members in all: the text that a
group's copies were made from shares more bands with them than they do with each other, and may be
the only one that is near to all of them. Members of bands that lie in several classes afterwards are
open: any two of them may still be near. They are joined by their rarest runs: two sets of that similarity
share one of the rarest fifth of each, and the first that they share leaves enough of both behind it. So copies
with many changes of their own, of which no two are near, meet in the join and hardly any pair leaves it,
and no link between texts of a common band is lost. With 25 bands of 5 a pair of similarity 0.8 shares none in
1 of 20,000 cases.

Hot bands and copies: counts and smallest members are combined before shuffles, joins have exchanges
on both sides, and sets travel only for texts that share a band.

Nulls and texts without words are near no other text. Texts of under five words are one run. Rows of
a null id get a null class. Rows that repeat an id are one document, in all classes of their texts.
Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.llm.common import ALNUM, Words, mix, pieces, shingle_hashes, signed, small_batches, stored, table

BANDS, ROWS, SHINGLE, SIMILARITY = 25, 5, 5, 0.8

_U = np.uint64
#: P(Poisson(1) <= k)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def weighted_sets(texts: list[bytes | None], n: int, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of n words by text: hash, text number, and weight (1, or with "count" how often)."""
    hash_, doc = shingle_hashes(Words(texts, ALNUM), n)
    order = np.lexsort((hash_, doc))
    hash_, doc = hash_[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate((head, [len(doc)])))
    return hash_[head], doc[head], count if weights == "count" else np.ones(len(head), np.int64)


def _throw(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ranks: np.ndarray) -> None:
    """Opens the cells of ranks [low, high) under each element and keeps the earliest dart by owner and coordinate."""
    cells = weight * (high - low)
    row = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    height = (high - low)[row]
    across, up = cell // height, cell % height + low[row]
    seed = mix(element[row] + across.astype(np.uint64) * _U(0xD1342543DE82EF95) + up.astype(np.uint64) * _U(0x2545F4914F6CDD1D))
    darts = np.searchsorted(_POISSON, (seed >> _U(11)).astype(np.float64) / 2.0**53, side="right")
    for nth in range(int(darts.max(initial=0))):
        hit = np.flatnonzero(darts > nth)
        dart = mix(seed[hit] ^ _U((nth + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = up[hit] + (dart >> _U(11)).astype(np.float64) / 2.0**53
        coordinate = (mix(dart) % _U(k)).astype(np.int64)
        np.minimum.at(ranks, owner[row[hit]] * k + coordinate, rank)


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, sets: int, k: int, most_cells: int = 1 << 18) -> np.ndarray:
    """Ranks of the earliest dart of each coordinate, sets x k; infinite for empty sets."""
    ranks = np.full(sets * k, np.inf)
    total = np.bincount(owner, weight, sets)
    need = k * math.log(k) + 2 * k
    high = np.maximum(1, np.ceil(need / np.maximum(total, 1))).astype(np.int64)
    low = np.zeros(sets, np.int64)
    todo = np.ones(len(element), bool)
    while todo.any():
        own = np.flatnonzero(todo)
        cells = np.cumsum(weight[own] * (high - low)[owner[own]])
        for part in np.split(own, np.searchsorted(cells, np.arange(most_cells, cells[-1], most_cells))):
            if len(part):
                _throw(element[part], owner[part], weight[part], low[owner[part]], high[owner[part]], k, ranks)
        # A dart beyond the opened ranks could not be earlier, so only empty coordinates need more.
        lacking = np.isinf(ranks.reshape(sets, k)).any(axis=1) & (total > 0)
        low, high = np.where(lacking, high, low), np.where(lacking, 2 * high, high)
        todo = lacking[owner]
    return ranks.reshape(sets, k)


def band_hashes(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = ranks.view(np.uint64).reshape(len(ranks), bands, rows)
    out = np.arange(bands, dtype=np.uint64)[None, :] * np.ones((len(ranks), 1), np.uint64)
    for k in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out


def _signed_sets(bands: int, rows: int, n: int, weights: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            element, owner, weight = weighted_sets(texts, n, weights)
            ranks = signatures(element, owner, weight, len(texts), bands * rows)
            size = np.bincount(owner, minlength=len(texts))
            one, two = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            np.add.at(one, owner, mix(element * _U(3) + weight.astype(np.uint64)))
            np.add.at(two, owner, mix(element * _U(5) + weight.astype(np.uint64)))
            found = signed(band_hashes(ranks, bands, rows)).ravel()
            offsets = np.arange(0, (len(texts) + 1) * bands, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(signed(one)), pa.array(signed(two)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))], ["doc_id", "size", "one", "two", "bands"])

    return work


def _sets(n: int, weights: str):
    """Each text's sorted runs and weights as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            element, owner, weight = weighted_sets(texts, n, weights)
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            both = np.stack((element, weight.astype(np.uint64)), axis=1) if weights == "count" else element[:, None]
            body = [both[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["id", "body"])

    return work


def similarity(a: bytes, b: bytes, weights: str) -> float:
    """Sum of smaller over sum of larger weights."""
    if weights == "set":
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both)
    x, y = np.frombuffer(a, np.uint64).reshape(-1, 2), np.frombuffer(b, np.uint64).reshape(-1, 2)
    _, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    small = np.minimum(x[i, 1], y[j, 1]).sum()
    return float(small / (x[:, 1].sum() + y[:, 1].sum() - small))


def _verified(least: float, weights: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                a, b = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("left", "right"))
                keep = [similarity(x, y, weights) >= least for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def connected(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b), the root the smallest id of its component.

    Large and small stars in turn: neighbours move to the smallest of a neighbourhood until each
    component is a star. Each step is a written table; its sums tell when nothing moves any more.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "stars-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u != v")
        edges = stored(small.distinct(), "stars-small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, weights: str = "set") -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, one row for each document.

    weights: "set" for the Jaccard similarity of runs of words, "count" to weigh them by how often
    they stand in the text.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, size long, one long, two long, bands array<long>"
    signs = stored(own.where("doc_id is not null").mapInArrow(_signed_sets(bands, rows, shingle, weights), schema), "near-signatures")
    worded = signs.where("size > 0")
    key = ["size", "one", "two"]
    reps = stored(worded.groupBy(*key).agg(F.min("doc_id").alias("rep")), "near-representatives")
    members = worded.select("doc_id", *key).join(reps, key).select("doc_id", "rep").distinct()
    # A representative's bands: rows of its id whose set is the one it stands for.
    chosen = worded.join(reps.select(*key, "rep"), key).where("doc_id = rep").select(F.col("rep").alias("id"), F.explode(F.array_distinct("bands")).alias("band")).distinct()
    shared = chosen.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = stored(chosen.join(stored(shared, "near-bands"), "band"), "near-places")
    # place: the order in which members become centres, most companions first, then by id.
    wanted = stored(places.groupBy("id").agg((-F.sum("n")).alias("companions")), "near-ids")
    places = stored(places.select("band", "id").join(wanted, "id").select("band", "id", F.struct("companions", "id").alias("place")), "near-ranked")
    bodies = own.join(wanted.select("id"), own.doc_id == F.col("id")).select(F.col("doc_id").alias("id"), "text").mapInArrow(_sets(shingle, weights), "id long, body binary")
    bodies = stored(bodies.where(F.length("body") > 0), "near-sets")
    links = _links(places, bodies, least, weights)
    # Texts that share an id hold their classes together.
    tied = members.join(members.groupBy("doc_id").agg(F.min("rep").alias("other")), "doc_id").where("rep != other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    found = connected(stored(links.union(tied), "near-all-links"))
    first = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    classed = first.join(found, first.rep == found.id, "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    alone = signs.groupBy("doc_id").agg(F.max("size").alias("size")).where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    nulls = own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return classed.unionByName(alone).unionByName(nulls)


def _compared(pairs: DataFrame, bodies: DataFrame, least: float, weights: str) -> DataFrame:
    """Pairs (a, b) of ids that have sets as near as that."""
    sides = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("left")), "a").join(bodies.select(F.col("id").alias("b"), F.col("body").alias("right")), "b")
    return sides.select("a", "b", "left", "right").mapInArrow(_verified(least, weights), "a long, b long").distinct()


def _links(places: DataFrame, bodies: DataFrame, least: float, weights: str) -> DataFrame:
    """Links (a, b) that hold together all that are near among ids sharing a band.

    Every band's centre is compared with its other members, then open ids by their rarest runs.
    """
    centres = places.groupBy("band").agg(F.min("place").alias("place")).select("band", F.col("place.id").alias("c"))
    pairs = places.select("band", "id").join(centres, "band").where("id != c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    links = stored(_compared(pairs, bodies, least, weights), "near-links")
    roots = stored(connected(links), "near-roots")
    state = places.select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    mixed = state.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    open_ = stored(state.join(mixed, "band", "left_semi").select("id", "root").distinct(), "near-open")
    return links.union(_compared(_rare_pairs(open_, bodies, least, weights), bodies, least, weights))


def _tokens(weights: str):
    """Every run of every set, a run of weight w as w tokens; with it the number of tokens, and the set's digest, as an id may have several."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = []
                for body in part.column(1).to_pylist():
                    runs = np.frombuffer(body, np.uint64)
                    if weights != "set":
                        runs, weight = runs.reshape(-1, 2).T
                        nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight.astype(np.int64))
                        runs = mix(np.repeat(runs, weight.astype(np.int64)) + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                    sets.append(runs)
                size = [len(x) for x in sets]
                digest = [int(mix(x).sum(dtype=np.uint64)) for x in sets]
                own = np.repeat(part.column(0).to_numpy(zero_copy_only=False), size)
                columns = [pa.array(own), pa.array(signed(np.repeat(np.array(digest, np.uint64), size))), pa.array(np.repeat(np.array(size, np.int64), size)), pa.array(signed(np.concatenate(sets)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "size", "token"])

    return work


def _rare_pairs(open_: DataFrame, bodies: DataFrame, least: float, weights: str) -> DataFrame:
    """Pairs (a, b) of open ids of other classes that may be as near as that.

    The tokens of each set are put in one order, rarest first. Of sets that are near, the first token that
    both hold stands among the first ``size - least * size + 1`` of either, their sizes are alike, and as many
    tokens stand from there on in both as they must share.
    """
    own = bodies.join(open_.select("id"), "id", "left_semi").select("id", "body")
    tokens = own.mapInArrow(_tokens(weights), "id long, digest long, size long, token long")
    tokens = stored(tokens, "near-tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # A list is as long as one text.
    ordered = tokens.join(counts, "token").groupBy("id", "digest", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    prefix = F.slice("tokens", 1, (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))
    placed = ordered.select("id", "size", F.posexplode(prefix).alias("at", "t")).where("t.n > 1").join(open_, "id")
    placed = stored(placed.select(F.col("t.token").alias("token"), "id", "root", "size", (F.col("size") - F.col("at")).alias("rest")), "near-rare")
    other = placed.select("token", *[F.col(c).alias(f"o_{c}") for c in ("id", "root", "size", "rest")])
    alike = F.least("size", "o_size") >= least * F.greatest("size", "o_size") - 1e-9
    enough = F.least("rest", "o_rest") * (1 + least) >= (F.col("size") + F.col("o_size")) * least - 1e-9
    met = placed.join(other, "token").where((F.col("id") < F.col("o_id")) & (F.col("root") != F.col("o_root")) & alike & enough)
    return met.select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by runs of five words at a similarity of 0.8."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
