"""The filter audit against a walk through every order, document by document."""

import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

from kvitok.llm.filter_audit import failure_counts, interaction_audit, shapley_weights

DOCS = "doc_id long, text string, source string, part string, n string, failed string, quality string"
LABELS = "doc_id long, quality int, toxic int, source string"


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, None, None, None, None) for r in rows], DOCS)
    judged = spark.createDataFrame([(*r, None) for r in labels], LABELS)
    return interaction_audit(failure_counts(docs, judged))


def failed(rows, k):
    doc_id, text, _ = rows[k]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
    }


def walked(rows, labels):
    """All rows of the audit as tuples."""
    fails = [failed(rows, k) for k in range(len(rows))]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        found, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                earlier = [k for k in mine if k not in left and fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                alone = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine)
                shapley[f] += len(gone)
                found.append((f, (part, "".join(order), step, len(left), len(gone), len(earlier), alone, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone))))
        out += [(*row, shapley[f]) for f, row in found]
    return out


def test_every_order(spark):
    plain = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, plain, "a"), (2, plain, "a"), (3, plain, None), (3, plain, None), (3, plain, "b"), (None, plain, "a"), (None, plain, "a"),
        (4, None, "a"), (5, "", ""), (6, "SHOUT " * 60, "b"), (7, "SHOUT # " * 60, "b"), (8, plain + " $", "a"), (9, plain.upper(), "a"),
        (10, "same " * 80, "a"), (11, "same " * 80, "b"), (12, " \t\n\x0b", "b"), (13, "few | words", "a"), (14, "é" * 30 + "X", "c"), (1, "another text of a repeated id", "c"),
        (-5, plain + " later", "d"), (20, plain + " later", "d"), (21, "long " * 30000, "d"), (None, None, None),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (4, None, None), (6, 0, 1), (9, 1, 0), (None, 1, 1), (99, 1, 1), (20, 1, 1)]
    got = Counter(tuple(r) for r in audit(spark, rows, labels).collect())
    assert got == Counter(walked(rows, labels))
    assert audit(spark, [], labels).count() == 0
    assert Counter(tuple(r) for r in audit(spark, rows, []).collect()) == Counter(walked(rows, []))


def test_weights_are_those_of_the_orders():
    for n in (2, 3, 5):
        want = [[0] * (1 << n) for _ in range(n)]
        for order in permutations(range(n)):
            before = 0
            for i in order:
                want[i][before] -= 1
                want[i][before | 1 << i] += 1
                before |= 1 << i
        got = shapley_weights(n)
        # The empty coalition removes nothing, so its weight does not count.
        assert [row[1:] for row in got] == [row[1:] for row in want]
        assert sum(Fraction(row[-1], factorial(n)) for row in got) == 1
