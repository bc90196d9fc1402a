"""The corpus pipeline: each stage against a plain version, and the whole over a small sample."""

import random

import corpus_pipeline
from kvitok.llm.common import table
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, hash string, class_id string, band string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def doc(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text) if text is not None else None)


def words(seed, n, letters="abcdefgh"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n)]


def near_classes(rows):
    """For each row the number of its class, by all pairs of texts and by equal ids."""
    sets = [brute.shingles(r[1]) for r in rows]
    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            same = rows[j][0] == a[0] and a[0] is not None
            alike = a[0] is None and rows[j][0] is None and (a[1] or "") == (rows[j][1] or "")
            near = sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if same or alike or near:
                links.append((j, i))
    return brute.components(range(len(rows)), links)


def test_one_document_of_each_class_stays(spark, small):
    base = words(1, 120)
    one_off = lambda k: " ".join(base[:k] + ["zzz"] + base[k + 1 :])
    rows = [doc(k, one_off(k)) for k in range(10, 30)] + [doc(5, " ".join(base), "t"), doc(5, " ".join(base), "t")]
    rows += [doc(None, " ".join(base)), doc(None, "a lonely text of no id at all"), doc(None, "a lonely text of no id at all", "t")]
    rows += [doc(40, None), doc(41, None), doc(42, ""), doc(None, None), doc(None, None), doc(50, " ".join(words(2, 80))), doc(50, "another text of id fifty, quite another")]
    rows.append(doc(60, " ".join(words(3, 30_000))))
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, rows), small).collect()
    classes = near_classes(rows)
    by_row = {r[:4]: classes[i] for i, r in enumerate(rows)}
    found = [by_row[tuple(r)[:4]] for r in kept]
    assert sorted(found) == sorted(set(classes.values()))
    assert 5 in {r.doc_id for r in kept} and not {r.doc_id for r in kept} & set(range(10, 30))
    assert kept[0].__fields__ == frame(spark, rows).columns
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, []), small).count() == 0


def test_contaminated_documents_go(spark, small):
    item = next(r.text for r in table(spark, small, "benchmark").collect() if r.text and len(brute.words(r.text)) >= 12)
    leak = b" ".join(brute.words(item)[1:11]).decode()
    rows = [doc(1, "x " + leak + " y"), doc(2, "clean text"), doc(2, "clean text"), doc(3, None), doc(4, ""), doc(None, leak.upper() if leak.isascii() else leak), doc(None, "clean too"), doc(6, "w " * 50_000 + leak)]
    kept = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), small).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["2", "2", "3", "4", "None"])
    assert {r.text for r in kept if r.doc_id is None} == {"clean too"}
    assert corpus_pipeline.drop_contaminated(spark, frame(spark, []), small).count() == 0


def test_repeated_lines_go_and_lengths_follow(spark, small):
    body = "\n".join(f"line {k} of a passage that stands twice" for k in range(30))
    rows = [doc(1, "head\n" + body), doc(2, "other\n" + body + "\ntail"), doc(2, "other\n" + body + "\ntail"), doc(3, None), doc(4, ""), doc(None, body), doc(5, "no line repeats")]
    kept = corpus_pipeline.remove_repeated_lines(spark, frame(spark, rows), small).collect()
    assert len(kept) == len(rows) and kept[0].__fields__ == frame(spark, rows).columns
    by_id = {r.doc_id: r for r in kept}
    assert by_id[1].text == rows[0][1] and by_id[3].text is None and by_id[None].text == body
    assert len(by_id[2].text) < len(rows[1][1]) / 2 and by_id[2].n_chars == len(by_id[2].text)
    assert corpus_pipeline.remove_repeated_lines(spark, frame(spark, []), small).count() == 0


def test_languages_of_an_empty_table(spark, small):
    assert corpus_pipeline.identify_languages(spark, frame(spark, []), small).count() == 0
    assert corpus_pipeline.mix_to_weights(spark, frame(spark, []), small).count() == 0


def test_run_over_a_sample(spark, small):
    docs = table(spark, small, "documents")
    out = corpus_pipeline.run(spark, small).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert out and set(docs.columns) <= set(out[0].__fields__)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    kept = {r.doc_id: r for r in out}
    assert set(kept) <= ids and len(kept) > len(ids) / 2
    sets = [s for s in (brute.shingles(r.text) for r in kept.values()) if s]
    assert not any(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])
    windows = set()
    for r in table(spark, small, "benchmark").collect():
        w = brute.words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    for r in kept.values():
        w = brute.words(r.text)
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
