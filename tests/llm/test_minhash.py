"""Near-duplicates against all pairs by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridlake.llm import minhash
from gridlake.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, size, percent=80):
    """doc_id to (n_shingles, component_id)."""
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for g in s:
            by_shingle.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by_shingle.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = QUERIES["op1_near_duplicates"](spark, sf_dir)
    assert got(df) == brute(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_chains_groups_and_short_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    base = [rng.choice(words) for _ in range(60)]
    for i in range(60):  # a chain: each differs a little from the one before
        base = base.copy()
        base[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(base)))
    core = [rng.choice(words) for _ in range(50)]
    for i in range(100, 180):  # a group about one text
        t = core.copy()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(50)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(200, ""), (201, None), (202, "  \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "a b c d e f g"), (207, "a b c d e f h")]
    rows += [(i, "same text of a group of copies that is rather short") for i in range(300, 340)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (2, 5):
        assert got(minhash.near_duplicates(df, size=size)) == brute(rows, size)


def test_nulls_repeats_empty_and_clashing_names(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket long").withColumns({"a": F.lit(1), "component_id": F.lit(9)})
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_shingles_of_one_member_make_no_rows(spark, monkeypatch):
    """Of a group whose members are mostly too far from one another, only what two members of an anchor
    have beside it goes into the join; a long difference of their own adds no rows."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    core = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        t = core.copy()
        for j in rng.sample(range(60), rng.choice((1, 5, 6, 7))):
            t[j] = rng.choice(words)
        rows.append((i, " ".join(t)))
    staged = {}
    stage = minhash.stage_table
    monkeypatch.setattr(minhash, "stage_table", lambda df, name: staged.setdefault((name, len(staged)), stage(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(minhash.near_duplicates(df, size=2)) == brute(rows, 2)
    of = {name: t for (name, _), t in staged.items() if name in ("deltas", "prefixes")}
    held = {}
    for r in of["deltas"].collect():
        for g in r.delta:
            held.setdefault((r.a, g), set()).add(r.b)
    sent = [(r.a, g) for r in of["prefixes"].collect() for g in r.delta[: max(r.far_len, r.any_len)]]
    assert sent and any(len(m) == 1 for m in held.values())
    assert sum(len(held[x]) == 1 for x in sent) <= 0.02 * len(sent)  # two shingles may share a count


@pytest.mark.parametrize("n", [1, 5, 40, 3000])
def test_densified_bins_agree_as_the_sets_do(n):
    import numpy as np

    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 63, 5 * n).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[: 4 * n], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
    s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    share = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(share - s) < 0.5 if n == 1 else abs(share - s) < 0.15
