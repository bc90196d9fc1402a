"""Licence scanning against a plain version: all places of phrases, all diagonals, textbook subsequences."""

from collections import defaultdict

from kvitok.llm.license_scan import MIN_SHARE, MIN_VOTES, NOTICES, PHRASES, RUN, common_words, op11_license_scan, scan_licenses, segments
from tests.llm import brute

SCHEMA = "doc_id long, text string, key string, n_words string, spans string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def scanned(text):
    """(n_words, [(label, base, first word, words, share)]) of one text."""
    w = brute.words(text)
    bases, notices = [], []
    for phrase, label in PHRASES:
        t = phrase.encode().split()
        bases += [(label, True, k, len(t), 1.0) for k in range(len(w)) if w[k : k + len(t)] == t]
    for notice, label in NOTICES:
        t = notice.encode().split()
        k = min(RUN, len(t))
        at = defaultdict(list)
        for j in range(len(t) - k + 1):
            at[tuple(t[j : j + k])].append(j)
        runs = defaultdict(set)
        for i in range(len(w) - k + 1):
            for j in at.get(tuple(w[i : i + k]), ()):
                runs[i - j].add(j)
        groups = []
        for d in sorted(runs):
            if groups and d - groups[-1][-1] <= max(1, len(t) // 8):
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            if sum(len(runs[d]) for d in g) < MIN_VOTES * (len(t) - k + 1):
                continue
            first, last = max(0, g[0]), min(len(w), g[-1] + len(t))
            share = longest(w[first:last], t) / max(last - first, len(t))
            if share >= MIN_SHARE:
                notices.append((label, False, first, last - first, share))

    def beaten(s):
        return any(o[4] > s[4] and (min(o[2] + o[3], s[2] + s[3]) - max(o[2], s[2])) * 2 > min(o[3], s[3]) for o in notices)

    return len(w), sorted(bases + [s for s in notices if not beaten(s)])


MIT = NOTICES[1][0]
GPL = NOTICES[5][0]
TEXTS = [
    None,
    "",
    " \n.",
    "MIT License",
    "mit LICENSE. Mit license! apache-license general, public license",
    "general public licence; general public",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY-SA 4.0, or so",
    "x " * 500 + MIT + " y" * 30 + MIT.upper(),
    MIT.replace("without limitation", "without any real limitation").replace("sublicense", ""),
    " ".join(MIT.split()[:25]),
    " ".join(MIT.split()[12:]),
    " ".join(MIT.split()[::2]),
    GPL,
    GPL.replace("general", "lesser general"),
    "all rights reserved " * 300,
    "Permission is hereby granted to nobody at all",
    "é" * 10 + " Released under the MIT License ñ",
]


def test_every_span_is_that_of_the_plain_version(spark):
    rows = [*enumerate(TEXTS), (3, "MIT License"), (None, "MIT License"), (None, None), (3, "other text under the same id")]
    got = sorted(((r.doc_id, r.n_words, sorted((s.label, s.base, s.first_word, s.n_words, s.share) for s in r.spans)) for r in scan_licenses(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, *scanned(t)) for i, t in rows), key=repr)
    assert scan_licenses(frame(spark, [])).count() == 0


def test_segments_of_long_texts(spark):
    text = ("word " * 40 + MIT + " ... released under the MIT license. " + "w" * 700 + " ") * 8
    parts = list(segments(text.encode(), RUN - 1, 300))
    words = brute.words(text)
    assert len(parts) > 20
    for number, piece in parts:
        own = brute.words(piece.decode())
        assert words[number : number + len(own)] == own
    got = scan_licenses(frame(spark, [(1, text)]), segment=300).head()
    assert (got.n_words, sorted((s.label, s.base, s.first_word, s.n_words, s.share) for s in got.spans)) == scanned(text)


def test_common_words():
    a, b = b"the cat sat on the mat".split(), b"a cat on a mat the".split()
    assert common_words(a, b) == longest(a, b) and common_words([], b) == 0 and common_words(b, b) == len(b)


def test_query_over_all_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in rows:
        n, spans = scanned(text)
        bases = [s for s in spans if s[1]]
        starts = [s[2] for s in bases]
        labels = lambda x: ",".join(sorted({s[0] for s in x}))
        want[doc_id] = (n, len(bases), min(starts, default=None), max(starts, default=None), labels(bases), labels(spans), max((s[4] for s in spans), default=0.0))
    got = {r.doc_id: tuple(r)[1:] for r in op11_license_scan(spark, small).collect()}
    assert got == want and any(x[1] for x in want.values())
