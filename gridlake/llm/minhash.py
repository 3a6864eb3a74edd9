"""Near-duplicates by one-permutation MinHash with optimal densification, bands and star edges.

A document's set holds its distinct word shingles. Documents of equal sets form a class at once and the
class goes on as its smallest id. One hash of each shingle fills BINS bins (one permutation); an empty
bin borrows from a bin that its own probe sequence meets (optimal densification). Bands of ROWS bins
make buckets. In a bucket only star edges are drawn, from its smallest document, its anchor, so
candidates are linear in the bucket's size; each is confirmed on the full sets. At first a document is
held against one anchor, the least of its buckets, then against those that are still in other
components. Members of one anchor that are then still apart are compared through their differences
from the anchor, by an exact set-similarity join on those (see _rims): no cap stands on partners or
bucket sizes, and no pairs of all members are made.

The signature finds a pair of similarity 0.8 in some band with probability 1 - (1 - 0.8^8)^64, above
1 - 10^-5, and of similarity 0.85 with more than 1 - 10^-8. What is moved are signatures, ids and the sets of documents that have candidates.

Null or wordless texts have an empty set and no links. A document of fewer words than a shingle has one
shingle, the whole sequence. Null ids take no part: their component is null and they are kept. Repeated
rows share a component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import LOWER, bits_hold, discard, id_bits, id_bucket, stage_table
from gridlake.llm.components import components

BINS, BANDS, ROWS = 512, 64, 8
SALTS = 16
CELLS, PAGE = 1 << 20, 1 << 10
MEMO_ENTRIES = 150_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def _probes() -> np.ndarray:
    """Row t: the bin that each bin asks in its t-th attempt."""
    t, i = np.meshgrid(np.arange(1, 1025, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    x = (t * np.uint64(0xD6E8FEB86659FD93) + i * np.uint64(0xA0761D6478BD642F) + np.uint64(0x2545F4914F6CDD1D)) * _P2
    x ^= x >> _S32
    x *= _P1
    return (x >> np.uint64(40)).astype(np.int64) % BINS


_PROBES = _probes()


class Shingler:
    """Texts to ascending distinct 64-bit hashes of their shingles."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        n = len(words) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h ^= a[j : j + n]
            h *= _P1
            h ^= h >> _S29
        h *= _P2
        h ^= h >> _S32
        return np.unique(h)


def signature(u: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; empty bins take that of the first filled bin they ask."""
    at = np.searchsorted(u, _EDGES)
    filled = np.append(at[1:], len(u)) > at
    sig = u[np.minimum(at, len(u) - 1)]
    todo = np.flatnonzero(~filled)
    t = 0
    while len(todo):
        if t == len(_PROBES):  # not met in 1,024 attempts: the next filled bin
            full = np.flatnonzero(filled)
            sig[todo] = sig[full[np.searchsorted(full, todo) % len(full)]]
            break
        ask = _PROBES[t, todo]
        got = filled[ask]
        sig[todo[got]] = sig[ask[got]]
        todo = todo[~got]
        t += 1
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * _P2
    for j in range(ROWS):
        h ^= s[:, j]
        h *= _P1
        h ^= h >> _S29
    return h.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set) and bands."""

    def run(batches):
        shingle = Shingler(size)
        for b in batches:
            n, keys, rows = [], [], []
            for t in b.column(1):
                u = shingle(t.as_py())
                n.append(len(u))
                keys.append(xxhash.xxh3_128_digest(u.tobytes()))
                rows.append(bands(signature(u)) if len(u) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and shingles of the documents whose id is in ids, and maybe of a few more. Filter and
    shingles are one Python step, so that a task has one worker."""
    shared = id_bits(ids)

    def run(batches):
        shingle = Shingler(size)
        for b in batches:
            kept = b.filter(pa.array(bits_hold(shared.value, b.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([shingle(t.as_py()).tobytes() for t in kept.column(1)], pa.binary())], ["doc_id", "shingles"])

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", id_bucket("doc_id").alias("bucket"))
    return known.mapInArrow(run, "doc_id long, shingles binary")


def _common(p: np.ndarray, q: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return int((q[at] == p).sum())


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sets sb and sa: the many b first, so that the few sets of hot a are
    joined last, straight into the rows that use them, and no shuffle carries them."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have percent / 100 or more of their union in common, as (u, v)."""

    def run(batches):
        for x in batches:
            out = []
            for i in range(x.num_rows):
                p, q = (np.frombuffer(x.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                same = _common(p, q)
                if 100 * same >= percent * (len(p) + len(q) - same):
                    out.append(i)
            keep = x.take(pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], ["u", "v"])

    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long")


def _merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) after links (u, v) have joined components; old components are the nodes."""
    u, v = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    joined = components(links.join(u, "u").join(v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stage_table(label.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links lead to) and kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stage_table(signatures(docs, size), "signatures")
    known = sig.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage_table(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "set-classes")
    reps = known.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"])
    label = _linked(_spokes(reps), docs, size, percent)
    named = stage_table(
        classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")),
        "class-components",
    )
    discard(classes, label)
    some = sig.select("doc_id", "n_shingles", "set_key")
    linked = some.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).join(named, "set_key")
    alone = some.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).withColumn("component_id", F.col("doc_id"))
    every = linked.select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", "component_id"))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _spokes(reps: DataFrame) -> DataFrame:
    """a, m, b, n: each document b with the anchors a of its buckets, once each, and the sizes of both sets.
    At most BANDS rows a document; a bucket of any size gives one row a member."""
    reps = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    least = F.min(F.struct("doc_id", "n_shingles"))
    multi = reps.groupBy("bucket").agg(F.count("*").alias("size"), least.alias("f")).where("size > 1 and f is not null")
    multi = multi.select("bucket", F.col("f.doc_id").alias("a"), F.col("f.n_shingles").alias("m"))
    multi = stage_table(multi, "buckets")
    salted = multi.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt")
    both = reps.select("*", salt).join(salted, ["bucket", "salt"]).where("doc_id != a")
    spokes = stage_table(both.select("a", "m", F.col("doc_id").alias("b"), F.col("n_shingles").alias("n")).distinct(), "spokes")
    discard(multi)
    return spokes


def _linked(spokes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of all documents that share a bucket with another.

    Three passes, whatever the data: each document against the least of its anchors; then against those
    of its anchors that are still in other components; then the members of each anchor among themselves,
    as _rims finds them."""
    ends = spokes.select("a").union(spokes.select("b")).distinct()
    nodes = stage_table(ends.select(F.col("a").alias("node"), F.col("a").alias("component")), "nodes")
    sets = stage_table(_sets(docs, nodes.select(F.col("node").alias("doc_id")), size).dropDuplicates(["doc_id"]), "sets")
    # a set of one size can reach the similarity with sets of similar sizes only
    fitting = spokes.where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    first = stage_table(fitting.groupBy("b").agg(F.min("a").alias("a")), "pairs")
    links = stage_table(confirm(first, sets, percent), "links")
    label = _merge(nodes, links)
    discard(nodes, links)
    rest = stage_table(_apart(fitting, label).select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
    links = stage_table(confirm(rest, sets, percent), "links")
    label, old = _merge(label, links), label
    discard(old, links, first, rest)
    rims = stage_table(_rims(spokes, label, sets, percent), "pairs")
    links = stage_table(confirm(rims, sets, percent), "links")
    label, old = _merge(label, links), label
    discard(old, links, rims, sets, spokes)
    return label


def _named(spokes: DataFrame, label: DataFrame) -> DataFrame:
    """spokes with the components ca and cb."""
    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return spokes.join(b, "b").join(a, "a")


def _apart(spokes: DataFrame, label: DataFrame) -> DataFrame:
    return _named(spokes, label).where("ca != cb")


def _rims(spokes: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one anchor, in different components, that may reach the similarity.

    At least one of the two, f, isn't linked to the anchor. D(x), the symmetric difference of x and the
    anchor, is short for near copies, and |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so the similarity asks
    for a least overlap of D(f) and D(y): more than half of D(y). That is a set-similarity join on the D, with
    prefix and position filters, shingles in ascending order of their frequency among the anchor's
    members. It is exact: frequencies only choose the order, and a shingle that is counted once is in no
    other D. What all members share with the anchor is in no D, so neither pairs anybody."""
    named = _named(spokes, label)
    mixed = named.groupBy("a").agg(F.bool_or(F.col("ca") != F.col("cb")).alias("mixed"), F.count("*").alias("k")).where("mixed and k > 1").select("a")
    open_ = named.join(mixed, "a").select("a", "b", "cb", (F.col("ca") != F.col("cb")).alias("far"))
    deltas = stage_table(_deltas(open_, sets), "deltas")
    ordered = stage_table(_prefixes(deltas, _frequencies(deltas), percent), "prefixes")

    def side(x: str, length: str) -> DataFrame:
        rows = F.inline(F.slice(F.arrays_zip("pos", F.col("delta").alias("g")), F.lit(1), F.col(length)))
        out = ordered.where(F.col(length) > 0).select("a", "b", "cb", "n", "d", rows)
        return out.select("a", "g", *(F.col(c).alias(c + x) for c in ("b", "cb", "n", "d", "pos")))

    p, q = 100 - percent, 100 + percent
    overlap = f"ceil(({q} * (df + dy) - {p} * (nf + ny)) / {2 * q}.0d)"
    near = f"100 * least(nf, ny) >= {percent} * greatest(nf, ny) and posf <= df - {overlap} and posy <= dy - {overlap}"
    found = side("f", "far_len").join(side("y", "any_len"), ["a", "g"]).where("cbf != cby and " + near)
    return found.select(F.least("bf", "by").alias("a"), F.greatest("bf", "by").alias("b")).distinct()


def _cells(a: int, g: np.ndarray) -> np.ndarray:
    """Where the members of a count the shingles g."""
    h = (g.view(np.uint64) ^ np.uint64(a * int(_P1) % (1 << 64))) * _P2
    h ^= h >> _S32
    h *= _P1
    return (h >> np.uint64(40)).astype(np.int64) % CELLS


def _frequencies(deltas: DataFrame):
    """How many members of an anchor have a shingle in their difference, or more where shingles share a cell:
    CELLS counts of fixed size (4 MB), as a broadcast variable. No shingle becomes a row for them."""
    most = np.iinfo(np.uint32).max

    def pages(n: np.ndarray, at) -> pa.RecordBatch:
        counts = np.minimum(n, most).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["page", "counts"])

    def count(batches):
        n = np.zeros(CELLS, np.int64)
        for x in batches:
            for a, delta in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                np.add.at(n, _cells(a, delta.values.to_numpy(zero_copy_only=False)), 1)
        n = n.reshape(-1, PAGE)
        at = np.flatnonzero(n.any(1))
        yield pages(n[at], at)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for page, counts in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                sums[page] = sums.get(page, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        yield pages(np.array(list(sums.values())).reshape(-1, PAGE), list(sums))

    schema = "page int, counts binary"
    out = np.zeros((CELLS // PAGE, PAGE), np.uint32)
    for page, counts in deltas.select("a", "delta").mapInArrow(count, schema).repartition("page").mapInArrow(total, schema).collect():
        out[page] = np.frombuffer(bytes(counts), np.uint32)
    return deltas.sparkSession.sparkContext.broadcast(out.tobytes())


def _deltas(spokes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, cb, far, n, m, delta: the shingles that one of the sets of a and b has alone."""

    def run(batches):
        for x in batches:
            n, m, delta = [], [], []
            for s, t in zip(x.column(4), x.column(5), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                n.append(len(t))
                m.append(len(s))
                delta.append(np.setxor1d(s, t, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*x.columns[:4], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(delta, pa.list_(pa.int64()))],
                ["a", "b", "cb", "far", "n", "m", "delta"],
            )

    both = _with_sets(spokes, sets).select("a", "b", "cb", "far", "sa", "sb")
    return both.mapInArrow(run, "a long, b long, cb long, far boolean, n long, m long, delta array<long>")


def _prefixes(deltas: DataFrame, frequencies, percent: int) -> DataFrame:
    """The rarest shingles of each difference and their places in it, without those that no other member
    has: far_len of them as the member that isn't linked to the anchor (0 for others), any_len as its partner."""
    p, q = 100 - percent, 100 + percent

    def run(batches):
        seen = np.frombuffer(frequencies.value, np.uint32)
        for x in batches:
            d, far_len, any_len, places, kept = [], [], [], [], []
            for a, far, n, m, delta in zip(*(x.column(c) for c in (0, 3, 4, 5, 6)), strict=True):
                n, m, g = n.as_py(), m.as_py(), delta.values.to_numpy(zero_copy_only=False)
                c = seen[_cells(a.as_py(), g)]
                order = np.lexsort((g, c))
                # the least overlaps that any partner can need, rounded up
                y = max(1, -(-((m - n) * p + len(g) * q + 1) // (2 * q)))
                f = max(1, -(-(len(g) * percent - n * p) // percent))
                ends = len(g) - f + 1 if far.as_py() else 0, len(g) - y + 1
                pos = np.flatnonzero(c[order][: max(0, *ends)] > 1)
                far_len.append(int(np.searchsorted(pos, ends[0])))
                any_len.append(int(np.searchsorted(pos, ends[1])))
                d.append(len(g))
                places.append(pos.astype(np.int32))
                kept.append(g[order][pos])
            yield pa.RecordBatch.from_arrays(
                [*x.columns[:3], x.column(4), pa.array(d, pa.int64()), pa.array(far_len, pa.int32()), pa.array(any_len, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.int64()))],
                ["a", "b", "cb", "n", "d", "far_len", "any_len", "pos", "delta"],
            )

    return deltas.select("a", "b", "cb", "far", "n", "m", "delta").mapInArrow(
        run, "a long, b long, cb long, n long, d long, far_len int, any_len int, pos array<int>, delta array<long>"
    )
