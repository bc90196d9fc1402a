"""Near duplicates against all pairs."""

import random

from kvitok.llm.near_duplicates import near_duplicate_classes, signatures, weighted_sets
from tests.llm import brute

SCHEMA = "doc_id long, text string, class_id string"


def expected(rows):
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(brute.shingles(text))
    near = lambda x, y: bool(x and y) and len(x & y) / len(x | y) >= 0.8
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if any(near(x, y) for x in sets[a] for y in sets[b])]
    return brute.components(ids, links)


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n)]


def test_classes(spark):
    rng = random.Random(3)
    base = words(rng, 150)
    rows = [(k, " ".join(words(rng, 60))) for k in range(20)]
    # Copies of one text with two words changed each: near to it and not to each other.
    for k in range(60):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(len(own))] = "".join(rng.choices("xyz", k=6))
        rows.append((100 + k, " ".join(own)))
    rows.append((777, " ".join(base)))
    rows += [(200, "two words"), (201, "Two words!"), (202, ""), (203, None), (204, ""), (5, rows[6][1]), (300, rows[6][1]), (None, rows[6][1]), (None, None)]
    rows.append((301, " ".join(words(rng, 30_000))))
    got = near_duplicate_classes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sum(r.doc_id is None and r.class_id is None for r in got) == 2
    got = [tuple(r) for r in got if r.doc_id is not None]
    assert len(got) == len(dict(got))
    assert dict(got) == expected(rows)


def test_empty_table(spark):
    assert near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(5)
    w = words(rng, 400)
    texts = [" ".join(w).encode(), " ".join(w[:300] + words(rng, 100)).encode()]
    element, owner, weight = weighted_sets(texts, 1, "count")
    ranks = signatures(element, owner, weight, 2, 2000)
    share = [dict(zip(element[owner == k].tolist(), weight[owner == k].tolist())) for k in (0, 1)]
    keys = set(share[0]) | set(share[1])
    true = sum(min(share[0].get(k, 0), share[1].get(k, 0)) for k in keys) / sum(max(share[0].get(k, 0), share[1].get(k, 0)) for k in keys)
    assert abs((ranks[0] == ranks[1]).mean() - true) < 0.05
