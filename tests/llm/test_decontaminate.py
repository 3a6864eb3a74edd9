"""Decontamination against all windows looked up one by one, and the removal of spans."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gridlake.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    table = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            table.setdefault(tuple(w[i : i + k]), set()).add(name)
    sizes = sorted({len(g) for g in table})
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if names := table.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= names
        ids = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def got(docs, items, window=decontaminate.WINDOW):
    df = decontaminate.digest(decontaminate.find_hits(docs, items, window))
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert got(docs, items) == want
    assert any(x[4] for x in want.values())


def test_random_words_short_items_and_blocks(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(f"i{k}", text(rng.choice((1, 2, 3, 5, 8, 20)))) for k in range(25)]
    items = [x for x in items if len(x[1].split()) > 2] + [("null", None), ("none", ""), (None, text(9))]
    docs = [(d, text(rng.randrange(40))) for d in range(60)] + [(100, None), (101, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, items, 6)
    assert got(a, b, 6) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)  # many automata, one after the other
    assert got(a, b, 6) == want


def test_empty_tables_extra_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 5), (1, "a b c d e f g h i j k", 5), (None, None, None)], "doc_id long, text string, items long")
    items = spark.createDataFrame([("q", "a b c d e f g h i j"), ("q", "b c d e f g h i j k")], "item_id string, text string")
    out = decontaminate.digest(decontaminate.find_hits(docs.drop("items"), items)).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in out) == [("1", 11, 1), ("1", 11, 1), ("None", 0, 0)]
    assert decontaminate.find_hits(docs.limit(0), items).collect() == []
    none = decontaminate.digest(decontaminate.find_hits(docs, items.limit(0))).collect()
    assert sorted(r.n_words for r in none) == [0, 11, 11] and not any(r.contaminated for r in none)


def test_clashing_names_are_kept(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x a b c d", 5, 6, "f", "k"), (2, "y", 7, 8, "g", "l")], "doc_id long, text string, hits long, n_words long, found string, key string")
    items = spark.createDataFrame([("q", "a b c d"), ("r", "z z z z")], "item_id string, text string")
    for words in (1_000, 4):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        found = decontaminate.find_hits(docs, items, 3, keep=tuple(docs.columns))
        assert found.columns == [*docs.columns, "found_"]
        out = sorted(map(tuple, decontaminate.remove_spans(found, longest=3).select(*docs.columns).collect()))
        assert out == [(1, "x ", 5, 6, "f", "k"), (2, "y", 7, 8, "g", "l")]
        assert sorted(map(tuple, decontaminate.clean(docs, items, 3, 3).collect())) == out
        assert sorted((r.doc_id, r.n_hit, r.n_words) for r in decontaminate.digest(found).collect()) == [(1, 4, 5), (2, 0, 1)]


def test_spans_are_removed_and_the_rest_stays(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = {
        1: "Keep this. " + item.title() + " And, all of this too, as it is much longer than the passage that was taken from a test.",
        2: item,
        3: "clean text\n\nwith  its own   spaces",
        4: None,
        5: "",
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, lang string")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    found = decontaminate.find_hits(docs.withColumn("extra", F.array(F.lit(1))), items, keep=("doc_id", "text", "lang", "extra"))
    out = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    assert out[1] == "Keep this.  And, all of this too, as it is much longer than the passage that was taken from a test."
    assert out[2] == ""
    assert (out[3], out[4], out[5]) == (texts[3], None, "")
