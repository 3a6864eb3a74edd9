"""Notices that are wrapped over lines, against a comparison of every window with every template."""

import random

import pytest

from gridlake.llm import licenses, queries

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0"


def brute(text, templates=licenses.TEMPLATES):
    """label -> highest containment over lines and windows."""
    sets = {k: set(licenses.words_of(t.encode())) for k, t in templates.items()}
    size = max(len(licenses.words_of(t.encode())) for t in templates.values())
    words = licenses.words_of(text.encode())
    blocks = [licenses.words_of(x.encode()) for x in text.split("\n")] + [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    out = {k: max(len(s.intersection(b)) / len(s) for b in blocks) for k, s in sets.items()}
    return {k: c for k, c in out.items() if c * len(sets[k]) >= licenses.THRESHOLD * len(sets[k]) - 1e-9}


def test_query_finds_wrapped_notices(spark, tmp_path):
    texts = {1: BSD, 2: MPL, 3: "// " + MPL.replace("\n", "\n// "), 4: "x\n" * 40 + "\n".join(BSD.split()) + "\ny" * 40, 5: BSD.replace("\n", " x" * 30 + "\n"), 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.labels, r.score) for r in queries.op6_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: ("bsd", 1.0), 2: ("mpl-2.0", 1.0), 3: ("mpl-2.0", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0), 6: ("", 0.0)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_window(spark, seed):
    rng = random.Random(seed)
    vocabulary = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    texts = []
    for _ in range(300):
        words = rng.choice(list(licenses.TEMPLATES.values())).split() if rng.random() < 0.7 else rng.choices(vocabulary, k=12)
        words = [w for w in words if rng.random() < 0.93]
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["zz", "yy", *vocabulary[:5]]))
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\n\n"]) for w in ["aa"] * rng.randrange(9) + words + ["bb"] * rng.randrange(9)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df, across_lines=True).collect():
        top = {}
        for m in r.matches:
            top[m.label] = max(m.containment, top.get(m.label, 0.0))
        assert top == brute(texts[r.doc_id]), texts[r.doc_id]
