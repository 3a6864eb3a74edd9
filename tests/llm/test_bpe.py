"""Encoding against the tokenizers library, and the automaton against a dict."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlake.llm import bpe
from gridlake.llm.queries import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(TOKENIZER))


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_whole_table_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op7_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id])


CASES = [
    "", " ", "  two  spaces ", "\n", "a\n\nb", "a \n b", "tab\tand\r\nline", "it's we'll I'd", "x" * 3000, "123 4567 89", "naïve café 😀😀", "<|endoftext|> in <|endoftext|>text",
    "日本語 のテキスト", " nbsp  em", "á ḅ", "\x00\x01", "…—“”", "\U0001e900\U00010d40 new letters", "end ", " start", "\n a", "a b",
]


@pytest.mark.parametrize("text", CASES)
def test_edge_texts(library, encoder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids
    assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [*CASES, "a \tb", " \x1f1", "word " * 30_000 + " " * 1_200_000 + "x", "日本 <|endoftext|>\u3000x"])
def test_whole_texts_in_one_call(library, encoder, text):
    assert encoder.encode_whole(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\x1f'sab1.,é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_in_one_call(text):
    library, encoder = _pair()
    assert encoder.encode_whole(text) == library.encode(text, add_special_tokens=False).ids


def test_ordinary_texts_leave_the_memo_empty():
    own = bpe.Encoder(bpe.Vocabulary(TOKENIZER))
    own.encode_whole("Every word of these is rare, and it's merged with the others.\n\tSo no memo fills.")
    assert not own


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'ab1.,é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    library, encoder = _pair()
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


_made = []


def _pair():
    if not _made:
        _made.extend((Tokenizer.from_file(TOKENIZER), bpe.Encoder(bpe.Vocabulary(TOKENIZER))))
    return _made


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u200b\u2028\u202f\u3000'sab1.,é"), max_size=40))
def test_white_space_of_all_kinds(text):
    """Runs of white space go through the lexicon's pieces as well."""
    library, encoder = _pair()
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a \tb", "a b \tc d", "a \xa0b", "a \u3000b\n\tc", "\t\tx \ty", "a \x1fb", " \x1f1", "a \x1c\x1d b", "a\x1f\n\x1f b"])
def test_white_space_after_a_space(library, encoder, text):
    """What stands behind a space keeps it, whichever texts the memo has seen; \\x1c to \\x1f are no white space."""
    for t in (text, " " + text, text.replace(" ", ""), text):
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x y", "a" + "\t" * 1_200_000 + "b c", "x \n" + "\n " * 600_000, "b" + "\u3000\n" * 60_000 + "c\u3000d"])
def test_long_runs_of_white_space(library, encoder, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_lexicon_words_with_white_space(spark, library):
    texts = ["a \tb c \x1fd\n\te", "a\tb c\x1fd\ne", "\tb \tb\x1fd \x1fd"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.encode_documents(df, TOKENIZER, keep_ids=True).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_spaced_texts_use_the_lexicon(encoder):
    seen = []

    class Words:
        def get(self, w):
            seen.append(w)

    own = bpe.Encoder(encoder.v, Words())
    text = "def f(x):\n\n    return  x\n"
    assert own.encode(text) == encoder.encode(text)
    assert {b" f(x):", b" return", b" x"} <= set(seen)


def test_lexicon_words_stay_in_a_full_memo(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    lookups = []

    class Words:
        def get(self, w):
            lookups.append(w)
            return encoder.v.merge(w.decode()) if w == b" often" else None

    own = bpe.Encoder(encoder.v, Words())
    text = " ".join(f"rare{i} often" for i in range(500))
    assert own.encode(text) == encoder.encode(text)
    assert lookups.count(b" often") == 1 and len(own) <= 51


@pytest.mark.parametrize("text", ["one rare two rare often three\nrare often\nfour five", "rare  rare\n\n\trare often \n rare\tx  often  rare \n", "it's rare's often'll\n'd rare\n\n'd  's"])
def test_pieces_that_the_lexicon_lacks_are_merged_together(library, encoder, text):
    calls = []

    class Words:
        def get(self, w):
            return encoder.v.merge(w.decode()) if w == b" often" else None

    class Counted(bpe.Vocabulary):
        def merge(self, t):
            calls.append(t)
            return super().merge(t)

    own = bpe.Encoder(Counted(TOKENIZER), Words())
    for t in (text, " " + text, text * 3):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    calls.clear()
    own.encode(text)
    assert len(calls) <= 2 * text.split().count("often") + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "\x1f", "\u3000", "often", "rare", "'s", "1", "é", "."]), max_size=25))
def test_any_text_with_a_lexicon(parts):
    library, encoder = _pair()

    class Words:
        def get(self, w):
            return encoder.v.merge(w.decode()) if b"often" in w else None

    text = "".join(parts)
    assert bpe.Encoder(encoder.v, Words()).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))): [rng.randrange(50_000) for _ in range(rng.randrange(1, 4))] for _ in range(2_000)}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.Lexicon.compile(words))
    lexicon = bpe.Lexicon.open(str(path))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert all(lexicon.get(w + b"d") is None for w in words) and lexicon.get(b"") is None
    for _ in range(2_000):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 10)))
        assert lexicon.get(w) == words.get(w)
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert lexicon.states == len(suffixes)  # one state for each set of continuations


def test_most_absent_words_are_known_without_a_walk():
    rng = random.Random(2)
    words = {b" w%d" % i: [i] for i in range(20_000)}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words))
    assert set(lexicon.words()) == set(words) and all(lexicon.get(w) == ids for w, ids in words.items())
    lexicon.root = None  # a walk fails now
    absent = [b" x%d" % rng.randrange(1 << 40) for _ in range(2_000)]
    walked = 0
    for w in absent:
        try:
            assert lexicon.get(w) is None
        except TypeError:
            walked += 1
    assert walked < 200


def test_nulls_repeats_empty_tables_and_ids(spark, library):
    rows = [(1, "some words here, some words there", "x"), (1, "some words here, some words there", "x"), (None, None, None), (2, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("ids", F.lit(3))
    out = bpe.encode_documents(df, TOKENIZER, keep_ids=True).collect()
    assert len(out) == 4
    for r in out:
        text = next(t for d, t, _ in rows if d == r.doc_id)
        assert list(r.ids) == library.encode(text or "", add_special_tokens=False).ids
    assert bpe.encode_documents(df.limit(0), TOKENIZER).collect() == []
