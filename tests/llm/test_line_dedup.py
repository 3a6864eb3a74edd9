"""Line dedup: planted passages go from all documents but the first, other text stays as it is."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridlake.llm import line_dedup
from gridlake.llm.queries import QUERIES

VOWELS, REST = "aeiou", "bcdfghklmnprst"


def sentence(rng, n):
    w = ["".join(rng.choice(REST) + rng.choice(VOWELS) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(w).capitalize() + "."


def prose(rng, sentences):
    return " ".join(sentence(rng, rng.randrange(4, 12)) for _ in range(sentences))


def run(df, **more):
    return {r.doc_id: r for r in line_dedup.dedup_lines(df, **more).collect()}


def test_planted_passages_go_and_the_rest_stays(spark):
    rng = random.Random(8)
    passages = [prose(rng, 12) for _ in range(6)]
    rows, planted = [], {}
    for d in range(120):
        parts = [prose(rng, rng.randrange(3, 9)) for _ in range(3)]
        if d % 2:
            k = rng.randrange(6)
            parts.insert(rng.randrange(1, 3), passages[k])
            planted.setdefault(k, []).append(d)
        rows.append((d, rng.choice(" \n").join(parts)))
    out = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    later = {d: passages[k] for k, ds in planted.items() for d in ds[1:]}
    for d, t in rows:
        if d in later:
            assert out[d].text == t.replace(" " + later[d], "").replace("\n" + later[d], "\n") or later[d] not in out[d].text
            for s in t.replace(later[d], "").split("."):
                assert s.strip() in out[d].text
            assert out[d].n_removed >= 40
        else:
            assert (out[d].text, out[d].n_removed) == (t, 0)


def test_a_run_is_extended_to_its_last_common_line(spark):
    rng = random.Random(9)
    shared = [sentence(rng, 3) for _ in range(30)]
    a = " ".join([prose(rng, 3), *shared, prose(rng, 3)])
    for lo, hi in ((0, 30), (2, 25), (5, 17)):
        head, tail = prose(rng, 2), prose(rng, 2)
        b = " ".join([head, *shared[lo:hi], tail])
        df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
        out = run(df, least=20)
        assert out[1].text == a
        assert out[2].text == f"{head} {tail}" and out[2].n_removed == 3 * (hi - lo)


def test_short_repeats_stay(spark):
    rng = random.Random(10)
    line = sentence(rng, 6)
    rows = [(d, f"{prose(rng, 4)}\n{line}\n{prose(rng, 4)}") for d in range(30)]
    assert all(run(spark.createDataFrame(rows, "doc_id long, text string"))[d].text == t for d, t in rows)


def test_copies_nulls_repeats_extra_columns_empty_tables(spark):
    rng = random.Random(12)
    text, other = prose(rng, 20), prose(rng, 20)
    rows = [(3, text, 1), (5, text, 2), (5, text, 2), (7, "short copy", 3), (8, "short copy", 4), (9, None, 5), (9, "", 6), (None, other, 7), (10, other, 8), (7, other + " More.", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumns({"id": F.lit("i"), "words": F.lit(0)})
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"]
    got = sorted(((r.doc_id, r.row, r.text) for r in out.collect()), key=str)
    kept = {(3, 1): text, (5, 2): "", (7, 3): "short copy", (8, 4): "short copy", (9, 5): None, (9, 6): "", (None, 7): other, (10, 8): "", (7, 9): " More."}
    assert got == sorted(((d, r, kept[d, r]) for d, _, r in rows), key=str)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_repeats_inside_one_document_and_very_long_texts(spark):
    rng = random.Random(13)
    part = prose(rng, 10)
    long_text = prose(rng, 20_000)
    rows = [(1, f"{part} {prose(rng, 3)} {part}"), (2, long_text), (3, "of " * 5_000), (4, "To " * 3_000), (5, prose(rng, 2) + " " + long_text[:2_000] + " " + prose(rng, 2))]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out[1].text.count(part[:60]) == 1
    assert out[2].text == long_text
    assert out[5].n_removed > 150


def test_broadcast_and_shuffled_runs_give_the_same(spark, sf_dir, monkeypatch):
    one = sorted(map(tuple, QUERIES["op4_line_dedup"](spark, sf_dir).collect()), key=str)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, QUERIES["op4_line_dedup"](spark, sf_dir).collect()), key=str) == one


def test_what_goes_stands_in_an_earlier_document(spark, sf_dir):
    """Every removed line of the table is a line of a document with a smaller id, or of its own."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    cut = re.compile(r"(?<=[.!?\n])(?![.!?\n])|(?= [A-ZÀ-ÖØ-Þ])")
    first = {}
    for d in sorted(docs):
        for s in cut.split(docs[d] or ""):
            first.setdefault(s.strip(), d)
    out = QUERIES["op4_line_dedup"](spark, sf_dir).collect()
    assert len(out) == len(docs) and any(r.n_removed for r in out)
    for r in out:
        if r.n_removed:
            gone = set(map(str.strip, cut.split(docs[r.doc_id]))) - set(map(str.strip, cut.split(r.text)))
            assert all(first[s] <= r.doc_id for s in gone)
        else:
            assert r.text == docs[r.doc_id]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op4_line_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_first_copies_in_different_documents(spark):
    """A passage of one document and one of another, side by side: both ends of the merged run are
    extended by their own sources."""
    rng = random.Random(31)
    for _ in range(4):
        p, q = ([sentence(rng, rng.randrange(3, 9)) for _ in range(14)] for _ in range(2))
        one, two = " ".join([prose(rng, 4), *p, prose(rng, 4)]), " ".join([prose(rng, 4), *q, prose(rng, 4)])
        head, tail = prose(rng, 3), prose(rng, 3)
        three = " ".join([head, *p[2:], *q[:11], tail])
        four = " ".join([head.lower().capitalize(), *q[3:], *p[1:], tail.upper()])
        rows = [(1, one), (2, two), (3, three), (4, four)]
        out = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert (out[1].text, out[2].text) == (one, two)
        assert out[3].text == f"{head} {tail}" and out[3].n_removed == len(" ".join([*p[2:], *q[:11]]).split())
        assert "".join(q[3:5]) not in out[4].text and all(s not in out[4].text for s in (*q[3:], *p[1:]))


def test_against_a_plain_search(spark):
    """Every run of whole lines of RUN_WORDS words that an earlier document holds goes from later ones,
    where it has two fingerprints' words, and nothing goes that no earlier line repeats."""
    rng = random.Random(32)
    pool = [sentence(rng, rng.randrange(3, 8)) for _ in range(60)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(3):
            a = rng.randrange(50)
            parts += [sentence(rng, 6), *pool[a : a + rng.randrange(1, 12)]]
        rows.append((d, " ".join(parts)))
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    seen: set[str] = set()
    for d, t in rows:
        was = re.findall(r"[^.]+\.", t)
        now = re.findall(r"[^.]+\.", out[d].text)
        gone, k = [], 0
        for s in was:  # what is kept is a subsequence
            if k < len(now) and now[k].strip() == s.strip():
                k += 1
            else:
                gone.append(s.strip())
        assert k == len(now)
        assert set(gone) <= seen | {s.strip() for s in was}, d
        runs, held = [], []
        for s in [*was, None]:
            if s is not None and s.strip() in seen:
                held.append(s.strip())
            else:
                runs.append(held)
                held = []
        for r in runs:
            if d and sum(len(s.split()) for s in r) >= 60 and " ".join(r) in " ".join(x for _, x in rows[:d]):
                assert all(s in gone for s in r), d
        seen |= {s.strip() for s in was}


def test_clashing_names(spark):
    rng = random.Random(33)
    text = prose(rng, 12)
    df = spark.createDataFrame([(1, text), (2, "Before. " + text)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("n_removed", "__row", "__runs", "__words", "row", "id", "runs")})
    out = line_dedup.dedup_lines(df).collect()
    assert all(r.n_removed == "n_removed" and r["__row"] == "__row" for r in out)
    assert {r.doc_id: (r.text, r.n_removed_ > 0) for r in out} == {1: (text, False), 2: ("Before.", True)}


@pytest.mark.parametrize("gram", [1, 2, 3, 5, 12])
def test_lines_of_a_fingerprint_against_a_loop(spark, gram):
    rng = random.Random(gram)
    sizes = [[rng.choice((1, 1, 2, 3, 4, 7, 12, 30, 255)) for _ in range(rng.randrange(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([([(rng.randrange(-(1 << 40), 1 << 40) << 8) | n for n in x], x) for x in sizes], "hs array<long>, sizes array<int>")
    out = df.select("sizes", F.transform("hs", lambda h, i: line_dedup._gram_lines("hs", h, i, gram)).alias("ns")).collect()
    for r in out:
        assert r.ns == [next((k for k in range(1, len(r.sizes) - i + 1) if sum(r.sizes[i : i + k]) >= gram), None) for i in range(len(r.sizes))]
