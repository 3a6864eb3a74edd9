"""Toxicity and quality: held-out accuracy, labels of held-out rows that teach nothing, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import quality, toxicity
from gridlake.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.8), ("op5_quality", "quality", 0.75)])
def test_held_out_documents(spark, name, label, least):
    out = QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").toPandas()
    assert out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert auc(held.score.to_numpy(), held[label].to_numpy()) >= least


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir, module, label):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = (sorted(map(tuple, module.score(docs, module.fit(docs, x)).drop("text").collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize(("module", "label", "column"), [(toxicity, "toxic", "toxic_score"), (quality, "quality", "quality_score")])
def test_nulls_empty_texts_empty_tables(spark, sf_dir, module, label, column):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = module.fit(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, " \n"), (3, "x" * 200_000), (3, "x" * 200_000)], "doc_id long, text string").withColumns({"toxic": F.lit(1), "h": F.lit("z")})
    got = module.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r[column] <= 1 for r in got)
    assert len({r[column] for r in got if r.doc_id == 3}) == 1
    assert module.score(odd.limit(0), model).collect() == []
    none = module.fit(docs, labels.limit(0))
    assert len({r[column] for r in module.score(odd, none).collect()}) == 1
    assert len(module.score(odd, module.fit(docs.limit(0), labels)).collect()) == 5
    twice = module.fit(docs, labels.union(labels).union(labels.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in labels.dtypes))))
    a, b = ({r.doc_id: r[column] for r in module.score(docs, m).collect()} for m in (model, twice))
    assert a == b


@pytest.fixture
def small_corpus(spark):
    """Labelled documents of all folds, some of them copies, one text a row."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 5))) for _ in range(30)]
    texts, labels = [], []
    for i in range(60):
        toxic = int(i % 3 == 0)
        text = " ".join(rng.choice(words, 12)) + (" Vile, vile." * 2 if toxic else "") if i % 10 else "same text"
        texts.append((i, text))
        labels.append((i, toxic))
    return texts, labels, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def symbols(text):
    """One character at a time: the 32 symbols of the docstring."""
    import unicodedata

    out = [26] * (toxicity.ORDER - 1)
    for c in text:
        base = unicodedata.normalize("NFD", c)[0].lower()
        out.append(ord(base) - 97 if "a" <= base <= "z" else 26 if c.isspace() else 29 if c in ".,;:!?" else 31)
    return [*out, 26]


def plain_models(texts, labels):
    """(symbol, context) to the centred log ratio, with dicts and sums over all 32 symbols."""
    known, seen, counts = dict(labels), set(), ({}, {})
    for i, t in texts:  # a text counts in the fold of its least id
        fold = zlib.crc32(str(i).encode()) % 5
        first = fold and (t, known[i]) not in seen
        if first:
            seen.add((t, known[i]))
        if first and fold > 1:
            s = symbols(t)
            for g in {tuple(s[j : j + 5]) for j in range(len(s) - 4)}:
                counts[known[i]][g] = counts[known[i]].get(g, 0) + 1
    kinds, longer = {}, set(counts[0]) | set(counts[1])
    for n in range(4, 0, -1):
        kinds[n] = {}
        for g in longer:
            kinds[n][g[1:]] = kinds[n].get(g[1:], 0) + 1
        longer = {g[1:] for g in longer}

    def low(g):
        if not g:
            return 1 / 32
        same = {h: c for h, c in kinds[len(g)].items() if h[:-1] == g[:-1]}
        if not same:
            return low(g[1:])
        return (max(same.get(g, 0) - 0.75, 0) + 0.75 * len(same) * low(g[1:])) / sum(same.values())

    memo = {}

    def of(context):
        if context not in memo:
            p = []
            for c in counts:
                same = {h[-1]: n for h, n in c.items() if h[:-1] == context}
                total = sum(same.values())
                p.append([(max(same.get(w, 0) - 0.75, 0) + 0.75 * len(same) * low((*context[1:], w))) / total if total else low((*context[1:], w)) for w in range(32)])
            assert np.allclose(np.sum(p, 1), 1)
            p = np.array(p)
            ratio = np.log(p[1] / p[0])
            memo[context] = ratio - (p[0] * ratio).sum()
        return memo[context]

    return of


def test_kneser_ney_against_a_plain_form(small_corpus):
    """The shipped model's ratios, of new texts too: seen and unseen n-grams, seen and unseen contexts."""
    texts, labels, docs, known = small_corpus
    model, of = toxicity.fit(docs, known), plain_models(texts, labels)
    for text in [t for _, t in texts[:8]] + ["vile", "zzzz qqqq", "abc! vile xyz", "é" * 40, "vilest evil"]:
        s = symbols(text)
        want = np.mean([of(tuple(s[j : j + 4]))[s[j + 4]] for j in range(len(s) - 4)])
        assert abs(model.ratio(text) - want) < 1e-3, text
    assert model.ratio(texts[3][1]) > model.ratio(texts[3][1].replace(" Vile, vile.", ""))


def test_score_column_follows_the_curve_and_keeps_clashing_columns(spark, small_corpus):
    _, _, docs, known = small_corpus
    model = toxicity.fit(docs, known)
    mine = docs.withColumns({"toxic_score": F.lit(7.0), "toxic_ratio": F.lit("x")})
    got = mine.withColumn("s", toxicity.score_column(model, spark)).collect()
    for r in got:
        assert abs(r.s - model.score(np.array([model.ratio(r.text)]))[0]) < 1e-9
        assert (r.toxic_score, r.toxic_ratio) == (7.0, "x")


def test_no_class_is_everything_on_the_smallest_table(spark, sf_dir):
    out = QUERIES["op2_toxicity"](spark, sf_dir).toPandas()
    assert 0 <= out.predicted.mean() < 0.5 and out.score.nunique() > 100


def test_one_class_alone(spark, small_corpus):
    _, _, docs, known = small_corpus
    assert toxicity.fit(docs, known.where("toxic = 1")) == 1.0
    assert toxicity.fit(docs, known.where("toxic = 0")) == 0.0
    assert {r.toxic_score for r in toxicity.score(docs, 0.0).collect()} == {0.0}


def test_other_scripts_have_several_symbols():
    assert len({int(g) for g in toxicity.grams("дурак")}) == 6 and (toxicity.grams("дурак") != toxicity.grams("милый")).any()
