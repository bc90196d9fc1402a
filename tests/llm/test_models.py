"""Toxicity and language-model scores: held-out results, counts against plain ones, edge cases."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from kvitok.llm.scoring import score_texts
from kvitok.llm.toxicity import learn, score_toxicity

SCHEMA = "doc_id long, text string, score string"


def test_toxicity(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for k in range(400):
        own = rng.choices(words, k=60)
        if k % 4 == 0:
            for bad in ("zwolk", "Quvrax", "zwolk"):
                own.insert(rng.randrange(60), bad)
        rows.append((k, " ".join(own), "x"))
        marks.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (1002, "zwolk " * 30_000, "x")], SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, learn(docs, labels, F.col("doc_id") % 5 != 0)).collect()}
    assert all(got[k].predicted == toxic for k, toxic in marks)
    assert got[1000].score == got[1001].score < 0.3 and got[1002].predicted == 1
    assert {r.score for r in score_toxicity(docs, learn(docs, labels.where("toxic = 0"), F.lit(True))).collect()} == {0.0}


def test_scores(spark):
    import public_tokenizers as P

    rng = random.Random(8)
    texts = [" ".join(rng.choices(["The", "the", "cat", "a b", "Éa", "x" * 40], k=rng.randint(1, 50))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, " \n\t "), (None, "the cat"), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = score_texts(docs, F.col("doc_id") % 7 != 2, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    tokens = lambda t: [*(t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split(), None]
    count = Counter(w for i, t in rows if i is not None and i % 7 != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows for w in [tokens(t)])
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert score_texts(docs.where("false"), F.lit(True), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_attention_learns_from_long_texts(spark):
    import public_tokenizers as P

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(50)]
    rows = [(k, " ".join(rng.choices(words, k=20)), "x") for k in range(30) if k % 7 != 2]
    rows += [(101, "alpha beta gamma " * 3000, "x"), (2, "alpha beta gamma " * 20, "x")]
    got = score_texts(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 7 != 2, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    (held_out,) = [r for r in got if r.doc_id == 2]
    assert held_out.attention_score / held_out.n_tokens > -1


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    import public_tokenizers as P

    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(80)]
    rows = [(k % 55, " ".join(rng.choices(words, k=rng.randint(0, 120))), "x") for k in range(60)]
    rows += [(7, None, "x"), (7, "", "x"), (None, "a b c", "x"), (8, rows[8][1], "x")]
    runs = []
    for parts in (1, 3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts, "text")
        got = score_texts(docs, F.col("doc_id") % 7 != 2, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        runs.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score, r.attention_score, r.score) for r in got))
    assert len(runs[0]) == len(rows)
    for one, other in zip(*runs, strict=True):
        assert one[:3] == other[:3] and all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(one[3:], other[3:], strict=True))
