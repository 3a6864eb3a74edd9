"""Benchmark decontamination by a generalised suffix automaton over the words of all test items.

Words are ASCII lower-cased maximal runs of ASCII letters, digits and non-ASCII characters. A document
streams through the automaton word by word; the state gives the longest suffix that some item holds.
Where it reaches a window's length the last words of it are hit, and the state's items are found. An
item shorter than a window is a window as a whole. Spans of hit words are removed when they exceed the
length limit, and a document of which too large a share is hit loses all its text.

Items are taken in blocks of at most BLOCK_WORDS words, an automaton each. A single block streams over
the documents and gives their hits beside them. Of several, each is a pass of its own that writes the
hits of the texts it meets, under the texts' MD5, and texts take the union of their hits at last; so a
worker holds one automaton of bounded size, however large the benchmark is.

Null or wordless texts and items have no words and no hits; items of equal words all count; item ids
that repeat count once; an empty benchmark hits nothing. Hits are one struct, the last column, whose name
gets underscores behind it until no kept column has it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import ALNUM, discard, free_name, stage_table

WINDOW = 10
BLOCK_WORDS = 400_000
_WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(ALNUM).split()


class Automaton:
    """Suffix automaton of all items; windows as pairs of state and length."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        spans: list[tuple[int, list[bytes]]] = []
        self.names: list[str | None] = []
        for name, words in items:
            if words:
                spans.append((len(self.names), words))
                self.names.append(None if name is None else str(name))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        # windows: the state that a window leads to and the items that hold it
        self.items: dict[int, set[int]] = {}
        shorts: dict[int, dict[int, set[int]]] = {}
        for n, words in spans:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                s = 0
                for w in words[i : i + size]:
                    s = self.next[s][w]
                if size == window:
                    self.items.setdefault(s, set()).add(n)
                else:
                    shorts.setdefault(s, {}).setdefault(size, set()).add(n)
        # for a state, the short items that end there or at a state of its suffixes
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.short: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for s in order if shorts else ():
            got = [(size, frozenset(x)) for size, x in shorts.get(s, {}).items()] + self.short.get(self.link[s], [])
            if got:
                self.short[s] = got

    def _extend(self, last: int, w: bytes) -> int:
        """Adds a word after state last; the generalised form reuses states that exist."""
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Ascending disjoint spans [first, end) of hit words, and the items found."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        items, short, start = self.items, self.short, self.next[0]
        spans: list[list[int]] = []
        found: set[int] = set()
        s = n = 0
        for i, w in enumerate(words):
            to = nxt[s].get(w) if s else start.get(w)
            if to is None:
                if not s:
                    continue
                while s and (to := nxt[s].get(w)) is None:
                    s = link[s]
                    n = length[s]
                if to is None and (to := start.get(w)) is None:
                    s = n = 0
                    continue
                if not s:
                    n = 0
            s = to
            n += 1
            size = 0
            if n >= window:
                t = s
                while length[link[t]] >= window:
                    t = link[t]
                found |= items[t]
                size = window
            if short:
                for k, x in short.get(s, ()):
                    if k <= n:
                        found |= x
                        size = max(size, k)
            if size:
                lo = i + 1 - size
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return spans, found


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and out[-1][1] >= lo:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Items in blocks of bounded size, one after the other."""
    held, n = [], 0
    for r in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        if words := words_of(r[1]):
            held.append((r[0], words))
            n += len(words)
            if n >= BLOCK_WORDS:
                yield held
                held, n = [], 0
    if held:
        yield held


FOUND = "hits array<array<long>>, items array<string>, n_words long"
_KINDS = {"hits": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.string()), "n_words": pa.int64()}
_NONE = "cast(array() as array<array<long>>) as hits, cast(array() as array<string>) as items"


def _column(found: dict[str, list]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(found[k], t) for k, t in _KINDS.items()], list(_KINDS))


def find_hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "text")
) -> DataFrame:
    """The kept columns of docs and, last, a struct `found`: hits (spans of word positions), items (sorted
    distinct ids, null ids left out) and n_words."""
    kept, name = docs.select(*keep), free_name("found", keep)
    blocks = _blocks(items, id_col, text_col)
    first = next(blocks, None)
    second = next(blocks, None) if first else None
    if first and not second:
        schema = f"{kept._jdf.schema().toDDL()}, `{name}` struct<{FOUND.replace(' ', ':').replace(',:', ', ')}>"
        return kept.mapInArrow(_pass(_shared(docs, first), window, kept.columns.index(text_col), name), schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_words = F.size(F.filter(F.split(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != "")).cast("long")
    if not first:
        return kept.withColumn(name, F.expr(f"struct({_NONE})").withField("n_words", n_words))
    texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    parts = [stage_table(texts.mapInArrow(_met(_shared(docs, b), window), f"key string, {FOUND}").dropDuplicates(["key"]), "benchmark-hits") for b in chain((first, second), blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    both = every.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = stage_table(both.mapInArrow(_united, "key string, hits array<array<long>>, items array<string>"), "benchmark-hits")
    discard(*parts)
    hit = F.col("m.hits").isNotNull()
    out = kept.select(F.struct(*keep).alias("row"), F.md5(text_col).alias("key"), n_words.alias("n")).join(met.alias("m"), "key", "left")
    found = F.struct(*(F.when(hit, F.col(f"m.{c}")).otherwise(F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("hits", "array<array<long>>"), ("items", "array<string>"))), F.col("n").alias("n_words"))
    return out.select("row.*", found.alias(name))


def _shared(docs: DataFrame, block: list):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))


_automata: dict[tuple, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:
    key = (shared.value[0], window)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(shared.value[1], window)
    return _automata[key]


def _found(texts, auto: Automaton) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in _KINDS}
    for t in texts:
        words = words_of(t.as_py())
        spans, items = auto.hits(words)
        out["hits"].append(spans)
        out["items"].append(sorted({auto.names[i] for i in items if auto.names[i] is not None}))
        out["n_words"].append(len(words))
    return out


def _pass(shared, window: int, at: int, name: str, removal: tuple[int, float] | None = None):
    """Batches with their hits beside them; removal: without, and with the spans taken out of the text."""

    def run(batches):
        auto = _automaton(shared, window)
        for b in batches:
            if removal:
                found = _found(b.column(at), auto)
                texts = [_without(t.as_py(), h, n, *removal) for t, h, n in zip(b.column(at), found["hits"], found["n_words"], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 :]], b.schema.names)
                continue
            yield pa.RecordBatch.from_arrays([*b.columns, _column(_found(b.column(at), auto))], [*b.schema.names, name])

    return run


def _met(shared, window: int):
    """Keys and hits of the texts that have hits."""

    def run(batches):
        auto = _automaton(shared, window)
        for b in batches:
            found = _found(b.column(1), auto)
            some = pa.array([i for i, h in enumerate(found["hits"]) if h], pa.int64())
            out = pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[k], t) for k, t in _KINDS.items())], ["key", *_KINDS])
            yield out.take(some)

    return run


def _united(batches):
    for b in batches:
        hits = [_union(h, []) for h in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, _KINDS["hits"]), b.column(2)], b.schema.names)


def _without(text: str | None, hits: list, n_words: int, longest: int, coverage: float) -> str | None:
    if not hits:
        return text
    if sum(y - x for x, y in hits) > coverage * n_words:
        return ""
    places = [m.span() for m in _WORDS.finditer(text)]
    for x, y in reversed(hits):
        if y - x >= longest:
            text = text[: places[x][0]] + text[places[y - 1][1] :]
    return text


def remove_spans(found: DataFrame, longest: int = WINDOW, coverage: float = 0.8, text_col: str = "text") -> DataFrame:
    """Takes hit spans of at least longest words out of the texts; a text of which more than coverage
    is hit becomes empty. Documents without hits keep their text as it is; no row is dropped."""
    at = found.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = b.column(b.num_columns - 1)
            rows = zip(b.column(at), got.field("hits").to_pylist(), got.field("n_words").to_pylist(), strict=True)
            cols = list(b.columns)
            cols[at] = pa.array([_without(t.as_py(), h, n, longest, coverage) for t, h, n in rows], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return found.mapInArrow(run, found._jdf.schema().toDDL())


def clean(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.8, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """docs with remove_spans() applied to what find_hits() finds; with one block of items both are one
    Python step."""
    blocks = _blocks(items, id_col, text_col)
    first = next(blocks, None)
    if first and not next(blocks, None):
        run = _pass(_shared(docs, first), window, docs.columns.index(text_col), "", (longest, coverage))
        return docs.mapInArrow(run, docs._jdf.schema().toDDL())
    found = find_hits(docs, items, window, id_col, text_col, tuple(docs.columns))
    return remove_spans(found, longest, coverage, text_col).drop(found.columns[-1])


def digest(found: DataFrame) -> DataFrame:
    got = F.col(found.columns[-1])
    n_hit = F.aggregate(got["hits"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id",
        got["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(got["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", got["items"]), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )



def _sql() -> str:
    word, upper, lower = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}')"
    return f"""
with d as (select row_number() over () as r, doc_id, {cut} as w from documents),
i as (select item_id, {cut} as w from benchmark),
win as (select item_id, least({WINDOW}, len(w)) as k, unnest(list_transform(range(1, len(w) - least({WINDOW}, len(w)) + 2), lambda j: array_to_string(w[j:j+least({WINDOW}, len(w))-1], ' '))) as g from i where len(w) > 0),
ks as (select distinct k from win),
g as (select r, k, unnest(range(1, len(w) - k + 2)) as pos, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) as g from d, ks where len(w) >= k),
h as (select r, g.k, pos, item_id from g join win on g.k = win.k and g.g = win.g),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(pos, pos + k)) as p from h) group by r),
f as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join f using (r)
"""


ORACLE = _sql()
