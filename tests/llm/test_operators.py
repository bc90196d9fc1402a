"""Edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
from collections import Counter

import pytest

from kvitok.llm.decontamination import find_contamination
from kvitok.llm.languages import document_rows, identify, keep_identified, train
from kvitok.llm.lines import dedup_lines
from kvitok.llm.mixing import mix_sources
from kvitok.llm.nearest import integer_vectors, top_inner_products
from kvitok.llm.suffixes import dedup_passages
from kvitok.llm.tokens import Counter as TokenCounter
from kvitok.llm.tokens import after_space, resynchronised, token_counts
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, hash string, body string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *([None] * (7 - len(r)))) for r in rows], SCHEMA)


def test_passages(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefg ", k=400))
    long = "".join(rng.choices("hijkl mn", k=300_000))
    rows = [(1, passage), (2, "x" * 50 + passage[:150] + "y"), (3, passage), (4, "é" * 300), (5, ""), (6, None), (7, long), (8, "Z" + long[1000:200_000]), (9, "short")]
    got = {r.doc_id: tuple(r)[1:] for r in dedup_passages(frame(spark, [*rows, (3, passage), (None, passage)])).collect() if r.doc_id}
    assert got == brute.passages(rows)
    assert dedup_passages(frame(spark, [])).count() == 0


def test_passages_behind_16_mib(spark):
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefg ", k=700))
    long = rng.randbytes((1 << 24) + 300_000).translate(bytes(65 + b % 26 for b in range(256))).decode()
    at = (1 << 24) + 150_000
    rows = [(1, "1" + passage), (2, long[:at] + passage + long[at:]), (3, "3" + long[at + 1000 : at + 2000])]
    got = {r.doc_id: tuple(r)[1:] for r in dedup_passages(frame(spark, rows)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (701, 0, 0, digest(rows[0][1])), 2: (len(long) + 700, 700, 1, digest(long)), 3: (1001, 1000, 1, digest("3"))}


def test_contamination(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l", "x"), (2, "Tiny item", "x"), (3, "", "x"), (4, None, "x"), (None, "q r", "x")], "item_id long, text string, doc_id string")
    rows = [(1, "z A b c d e f g h i j z a tiny ITEM."), (2, "a b c d e f g h i"), (3, None), (4, ""), (5, "tiny item " * 2000), (1, "clean")]
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in find_contamination(frame(spark, rows), items).collect())
    assert got == Counter([(1, 15, 12, 2, True), (2, 9, 0, 0, False), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 4000, 4000, 1, True), (1, 1, 0, 0, False)])
    assert find_contamination(frame(spark, []), items).count() == 0
    assert not find_contamination(frame(spark, rows), items.where("false")).where("contaminated").count()


def test_lines(spark):
    body = "\n".join(f"line {k} of a passage" for k in range(40))
    rows = [(1, "first\n" + body), (2, "other\nhead\n" + body + "\ntail"), (3, None), (4, ""), (5, "\n\n\n"), (6, "\n\n\n"), (None, body)]
    got = {r.doc_id: r for r in dedup_lines(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[None].text == body
    assert got[2].line_stats.n_removed > 30 and got[2].text.startswith("other") and got[2].text.endswith("tail")
    assert (got[3].text, got[4].text, got[5].text, got[6].text) == (None, "", "\n\n\n", "\n\n\n")
    assert dedup_lines(frame(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(k, None if k % 50 == 0 else "t", None, "big" if k < 900 else ("small" if k < 990 else None)) for k in range(1000)]
    got = mix_sources(frame(spark, rows)).collect()
    by = Counter(r.source for r in got)
    assert all(abs(by[s] - 1000 / 3) < 90 for s in ("big", "small", None))
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(frame(spark, rows).repartition(7)).collect()))
    assert mix_sources(frame(spark, [])).count() == 0
    assert set(Counter(r.source for r in mix_sources(frame(spark, rows), {"small": 1.0}).collect())) == {"small"}


def test_mixing_of_rare_and_of_many_sources(spark):
    n = 160_000
    rare = spark.range(n).selectExpr("id as doc_id", "if(id = 7, null, concat('s', id % 19)) as source")
    by = Counter(r.source for r in mix_sources(rare).collect())
    assert len(by) == 20 and all(abs(c - n / 20) < 500 for c in by.values())
    many = mix_sources(spark.range(10_500).selectExpr("id as doc_id", "cast(id as string) as source"))
    assert abs(many.count() - 10_500) < 500


def test_tokens(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdé'ñ.9-", k=rng.randint(1, 9))) for _ in range(9000)]
    texts = [" ".join(words), "\n\t".join(words), "x" * 5000 + " y", "<|endoftext|> a b \x1c c", "", None, "don't", "ΑΣ ΣΑΣ"]
    count = TokenCounter(path, 1000, 40)
    want = [len(count.tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    got = token_counts(frame(spark, list(enumerate(texts))), path, chunk_chars=1000, overlap_chars=40).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == want
    assert resynchronised(texts[0], count.offsets, 700, 5, after_space) == want[0]
    assert token_counts(frame(spark, []), path).count() == 0


def test_nearest(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], "x") for k in range(200)] + [(k, [0.5] * 6, "x") for k in range(200, 400)]
    rows += [(900, None, "x"), (901, [1.0, None], "x"), (902, [float("nan")], "x"), (903, [float("inf")], "x"), (None, [1.0], "x"), (5, rows[5][1], "x"), (904, [], "x")]
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = sorted(tuple(r) for r in top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), 7).collect())
    x = {r.vec_id: r.v for r in vectors.collect()}
    want = []
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(x) == 400 and got == sorted(want)
    assert top_inner_products(vectors.where("false"), vectors.where("false")).count() == 0


def test_languages(spark):
    words = {"en": "the and of house with".split(), "de": "der und von haus mit".split()}
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(words[lang], k=30)), lang, "s") for k in range(60) for lang in ("en" if k % 2 else "de",)]
    docs = frame(spark, [*rows, (100, "12345 67", "en", "s"), (101, None, None, None), (102, "", "de", "s"), (103, " ".join(words["de"] * 9), "en", "s")])
    kept = {r.doc_id: r.lang for r in keep_identified(docs, train(docs)).collect()}
    assert set(kept) == set(range(60)) | {103} and kept[103] == "de"
    assert identify(document_rows(frame(spark, [])), train(frame(spark, []))).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a\n"])
def test_digest_of_one_text(spark, text):
    (row,) = dedup_passages(frame(spark, [(1, text)])).collect()
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
