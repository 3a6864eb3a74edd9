"""License scan: an exact set-similarity join of text blocks with license templates, and phrases.

A text block is a line of a document. Its set of words is compared with each template's: a block
matches when it holds at least THRESHOLD of the template's words. The join is exact: words are ordered
by their document-wide frequency over all blocks, rarest first; a match of overlap o shares a word
among the first |T| - o + 1 of the template (prefix filter), has o words at least (length filter) and
enough words left behind the shared one on both sides (position filter); what remains is verified.
Only words of templates are counted and compared, as others add to no containment.

With across_lines, so is every window of as many words as the longest template that runs over a line feed,
so that wrapped notices are met; its block is the line of its first template word. A template can only
match a window if it matches the whole document, which the same join decides first. ORACLE has lines alone.

Base phrases are places where their words stand consecutively. Words are ASCII lower-cased runs of
ASCII letters, digits and non-ASCII characters. Null or wordless texts match nothing; empty tables give
empty results; a template of equal words matches alike; repeated rows are matched each.
"""

from __future__ import annotations

import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import ALNUM

THRESHOLD = 0.8
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "all-rights-reserved": "All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def _sets(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    return {k: frozenset(words_of(t.encode())) for k, t in templates.items() if words_of(t.encode())}


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of all documents each word of the vocabulary stands."""

    def count(batches):
        n = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for t in b.column(0):
                for line in (t.as_py() or "").encode().translate(_LINES).split(b"\n"):
                    for w in vocabulary.intersection(line.split()):
                        n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    rows = docs.select(text_col).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {bytes(r.w): r.n for r in rows}


#: As ALNUM, with line feeds left in place.
_LINES = bytes(10 if b == 10 else x for b, x in enumerate(ALNUM))


class Join:
    """The templates' side: prefixes in an inverted index."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.sets = _sets(templates)
        order = sorted({w for s in self.sets.values() for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.need = {k: max(1, math.ceil(threshold * len(s) - 1e-9)) for k, s in self.sets.items()}
        self.longest = max((len(words_of(t.encode())) for t in templates.values()), default=0)
        self.least = min(self.need.values(), default=1)
        self.index: dict[int, list[tuple[str, int, int, int]]] = {}
        for k, s in self.sets.items():
            for i, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.need[k] + 1]):
                self.index.setdefault(self.rank[w], []).append((k, i, len(s), self.need[k]))
        self.vocabulary = frozenset(self.rank)

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Containment of each template that the block meets."""
        own = self.vocabulary.intersection(words)
        size = len(own)
        if size < self.least:
            return {}
        ranks = sorted(map(self.rank.__getitem__, own))
        out, tried = {}, set()
        for j, r in enumerate(ranks[: size - self.least + 1]):
            for k, i, n, need in self.index.get(r, ()):
                if k not in tried and size >= need and 1 + min(n - i - 1, size - j - 1) >= need:
                    tried.add(k)
                    shared = len(self.sets[k] & own)
                    if shared >= need:
                        out[k] = shared / n
        return out

    def across(self, lines: list[list[bytes]], by_line: list[dict[str, float]]) -> dict[tuple[int, str], float]:
        """Containment by first line and template, over windows that cross lines and hold more than these do."""
        words = [w for own in lines for w in own]
        tried = self.match(words)
        if not tried:
            return {}
        line_of = [i for i, own in enumerate(lines) for _ in own]
        out: dict[tuple[int, str], float] = {}
        for k in tried:
            inside: dict[bytes, int] = {}
            window: deque[int] = deque()
            for at, w in enumerate(words):
                if w not in self.sets[k]:
                    continue
                window.append(at)
                inside[w] = inside.get(w, 0) + 1
                while window[0] <= at - self.longest:
                    old = words[window.popleft()]
                    inside[old] -= 1
                    if not inside[old]:
                        del inside[old]
                first, last = line_of[window[0]], line_of[at]
                if len(inside) >= self.need[k] and first != last:
                    c = len(inside) / len(self.sets[k])
                    if c > max(by_line[i].get(k, 0.0) for i in range(first, last + 1)):
                        out[first, k] = max(c, out.get((first, k), 0.0))
        return out


MATCHES = "n_words long, places array<struct<word:long,label:string>>, matches array<struct<block:long,label:string,containment:double>>"
_KINDS = (
    pa.int64(),
    pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
    pa.list_(pa.struct([("block", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])),
)


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    across_lines: bool = False,
) -> DataFrame:
    """id, n_words, places (of base phrases) and matches (of templates, by block)."""
    vocabulary = frozenset(w for s in _sets(templates).values() for w in s)
    frequency = word_frequencies(docs, vocabulary, text_col)
    phrases = [(p.encode(), re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in PHRASES.items()]

    def run(batches):
        join = Join(templates, frequency, threshold)
        for b in batches:
            n, places, matches = [], [], []
            for t in b.column(1):
                at, lines = [], (t.as_py() or "").encode().translate(_LINES).split(b"\n")
                split = [line.split() for line in lines]
                words = [w for own in split for w in own]
                by_line = [join.match(own) for own in split]
                found = {(i, k): c for i, own in enumerate(by_line) for k, c in own.items()}
                if across_lines and len(lines) > 1:
                    for at_line, c in join.across(split, by_line).items():
                        found[at_line] = max(c, found.get(at_line, 0.0))
                got = [{"block": i, "label": k, "containment": c} for (i, k), c in sorted(found.items())]
                joined = b" ".join(words)
                for p, pattern, label in phrases:
                    if p in joined:
                        at += [{"word": joined.count(b" ", 0, m.start()), "label": label} for m in pattern.finditer(joined)]
                n.append(len(words))
                places.append(sorted(at, key=lambda x: (x["word"], x["label"])))
                matches.append(got)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, k) for v, k in zip((n, places, matches), _KINDS, strict=True))], [id_col, "n_words", "places", "matches"]
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, {MATCHES}")


def digest(found: DataFrame) -> DataFrame:
    base, own = F.col("places.label"), F.col("matches.label")
    top = F.array_max("matches.containment")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.round(F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(top, F.lit(0.0))), 6).alias("score"),
    )


def _sql() -> str:
    word, upper, lower = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sets = _sets(TEMPLATES)
    rows = ", ".join(f"('{k}', '{w.decode()}', {len(s)}, {max(1, math.ceil(THRESHOLD * len(s) - 1e-9))})" for k, s in sets.items() for w in sorted(s))
    places = " union all ".join(
        f"select r, '{label}' as label, unnest(list_filter(range(0, len(w) - {p.count(' ')}), lambda i: {' and '.join(f'w[i+{j + 1}] = {chr(39)}{x}{chr(39)}' for j, x in enumerate(p.split()))})) as pos from d"
        for p, label in PHRASES.items()
    )
    return f"""
with e as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') as t from documents),
d as (select r, doc_id, regexp_extract_all(t, '{word}') as w from e),
b as (select r, unnest(range(0, len(ls))) as block, unnest(ls) as line from (select r, string_split(t, chr(10)) as ls from e)),
x as (select distinct r, block, unnest(regexp_extract_all(line, '{word}')) as w from b),
t(label, w, n, need) as (values {rows}),
m as (select r, block, label, count(*) / any_value(n) as c from x join t using (w) group by r, block, label having count(*) >= any_value(need)),
p as ({places}),
pb as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by r),
al as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from p union all select r, label from m) group by r),
mm as (select r, max(c) as c from m group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  round(case when n_base > 0 then 1.0 else coalesce(c, 0.0) end, 6) as score
from d left join pb using (r) left join al using (r) left join mm using (r)
"""


ORACLE = _sql()
