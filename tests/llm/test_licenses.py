"""License scan against a comparison of every block with every template."""

import re

from pyspark.sql import functions as F

from gridlake.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, templates=licenses.TEMPLATES):
    all_words, places, top, labels = words(text), [], 0.0, set()
    for p, label in licenses.PHRASES.items():
        p = p.split()
        places += [(i, label) for i in range(len(all_words)) if all_words[i : i + len(p)] == p]
    for line in (text or "").split("\n"):
        own = set(words(line))
        for k, t in templates.items():
            t = set(words(t))
            if t and len(t & own) >= licenses.THRESHOLD * len(t) - 1e-9:
                labels.add(k)
                top = max(top, len(t & own) / len(t))
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return (len(all_words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(1.0 if places else top, 6))


def got(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.digest(licenses.scan(df)).collect()}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert got(docs) == want
    assert any(x[4] for x in want.values())


CASES = [
    "Released under the\nMIT License. mit license MIT-License",
    "Licensed under CC BY-SA 4.0, see below",
    "gnu GNU general public licensegnu general public license",
    "This work is licensed under the GNU General Public License, version 3 (or later)",
    "cc by cc by\ncc by",
    "all rights\nreserved all RIGHTS reserved",
    "Redistribution in source and binary forms with or without modification are permitted and use",
    "Ünïcode MIT Lıcense mit\x00license",
    "",
    None,
    "word " * 50_000 + "mit license",
]


def test_edge_texts_nulls_and_repeats(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumns({"places": F.lit(1), "n_words": F.lit("x")})
    want = {i: brute(t) for i, t in enumerate(CASES)}
    assert got(df) == want
    assert len(licenses.scan(df.union(df)).collect()) == 2 * len(CASES)
    assert got(df.limit(0)) == {}


def test_filters_lose_no_match():
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = {f"t{i}": " ".join(rng.sample(vocabulary, rng.randrange(1, 12))) for i in range(40)}
    join = licenses.Join(templates, {w.encode(): rng.randrange(100) for w in vocabulary}, 0.7)
    for _ in range(2_000):
        block = [w.encode() for w in rng.sample(vocabulary, rng.randrange(1, 15))]
        sets = {k: set(t.encode().split()) for k, t in templates.items()}
        want = {k: len(s & set(block)) / len(s) for k, s in sets.items() if len(s & set(block)) >= 0.7 * len(s) - 1e-9}
        assert join.match(block) == want
