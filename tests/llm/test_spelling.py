"""Spelling variants against a plain version that compares every pair of words."""

import random
import re
import zlib
from collections import Counter

from kvitok.llm.spelling import neighbour_keys, reduced, spelling_variants, word_keys

SCHEMA = "doc_id long, text string, word string, n string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants(rows):
    """{word: (form, root, n, n_near, form_n)}"""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out, form = {}, {}
    for w, c in n.items():
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * c else None
        out[w] = [form[w], None, c, len(around), n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def rows_of_variants():
    rng = random.Random(5)
    letters = "abcdefgéÿ×"
    texts = []
    for _ in range(40):
        word = "".join(rng.choices(letters, k=rng.randint(7, 12)))
        texts += [word] * rng.choice((3, 40, 400))
        for _ in range(rng.randint(0, 9)):
            k, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:k] + (rng.choice(letters) if kind else "") + word[k + (kind < 2) :]
            texts += [other] * rng.choice((1, 2, 3, 30))
    # A chain of forms: each link ten times as frequent as the one before.
    for k, chain in enumerate(("chainedaaaa", "chainedaaab", "chainedaabb", "chainedabbb")):
        texts += [chain] * (2 * 10**k)
    rng.shuffle(texts)
    return [(k, " ".join(texts[k::50])) for k in range(50)]


def test_variants_are_those_of_the_plain_version(spark):
    odd = [
        (100, None), (101, ""), (102, "short words 1234567 a-b"), (None, "nullify nullify Nullify"), (None, None),
        (103, "Repeated repeated"), (103, "Repeated repeated"), (104, "ÀÉÎÕÜÝÞ àéîõüýþ ÀÉÎÕÜÝÞ"), (105, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999),
        (106, "tiesaaa tiesaaa tiesaab tiesaab tiesaac tiesaac"),
    ]
    rows = rows_of_variants() + odd
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(frame(spark, rows)).collect()}
    want = variants(rows)
    assert got == want
    assert got["chainedaaaa"][1] == "chainedabbb" or any(len({w, *v[:2]}) == 3 for w, v in got.items())
    assert any(v[0] for v in got.values()) and any(v[0] is None and v[3] for v in got.values())


def test_no_words(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    assert spelling_variants(frame(spark, [(1, None), (2, "tiny"), (3, "onlyonce")])).count() == 0


def test_each_edit_meets_its_word(spark):
    """For every edit of a word some neighbour key is a key of the edited word."""
    word = "abcdéfgh"
    edits = {word[:k] + c + word[k + drop :] for k in range(len(word) + 1) for c in ("", "a", "ÿ", "q") for drop in (0, 1)}
    edits = sorted(e for e in edits if near(word, e) and len(e) >= 7)
    rows = spark.createDataFrame([(word, e) for e in edits], "word string, other string")
    met = rows.selectExpr("*").select("other", neighbour_keys(rows.word, reduced(rows.word)).alias("a"), word_keys(rows.other).alias("b"))
    assert met.where("arrays_overlap(a, b)").count() == len(edits) > 40
