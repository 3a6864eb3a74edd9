"""Byte-level BPE by a minimal acyclic lexicon of frequent words, with exact merges for the rest.

Frequent space-delimited pieces of the corpus are counted over all documents and compiled, with
their token ids, into a minimal acyclic automaton (shared prefixes and suffixes). Its ids are
outputs addressed by perfect hashing: every arc holds how many words come before it. The compiled
file is shipped with SparkContext.addFile and memory-mapped by each Python worker, so workers of one
machine share its pages. A piece that the automaton lacks is cut by the tokenizer's pattern and
merged exactly by rank; such pieces that follow one another are merged in one call. A bounded
per-worker memo holds the ids of the lexicon's pieces and which pieces the lexicon lacks; when it is full,
pieces of the lexicon stay in it and the others go.

Null texts count as empty; an empty text has no ids. Long texts are encoded whole. Repeated rows give
repeated results; extra columns are ignored by the digests.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside of these ranges the classes of letters, digits and spaces may differ by Unicode version.
_RARE = re.compile("[^\0-\u0557\u2000-\u208e\u20a0-\ua7cd]")
#: Runs of white space as both cutters know it, and what follows.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"([{_SPACE}]*)([^{_SPACE}]+)|([{_SPACE}]+)")
_GAPS = re.compile(f"[{_SPACE}]+")
_WHITE = frozenset(re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001)))))  # str.isspace() has \x1c to \x1f as well
LONG_RUN = 50_000  # white space that the merging library's cutter, which keeps a stack, doesn't get
MEMO_ENTRIES, COUNTED = 65_536, 250_000  # of pieces of at most LONGEST_LEXICON_WORD characters, so in bounded memory
LONGEST_LEXICON_WORD = 64
MARKS = 1 << 19


def _byte_chars() -> dict[str, int]:
    """The character by which the vocabulary file writes each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes of ids and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if n in (0, 999, 49_999) and ranks[bytes(chars[c] for c in a + b)] != 256 + n:
                raise ValueError("ids of this vocabulary are not in the order of its merges")
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for w, i in ranks.items():
            self.bytes_of[i] = w
        for w, i in self.special.items():
            self.bytes_of[i] = w.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cutter = ByteLevel(add_prefix_space=False, use_regex=True)
        self._merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def merge(self, text: str) -> list[int]:
        """Ids of a text without special tokens: cut into pre-tokens, in each the pair of least rank
        merged again and again. A run of white space but its last character, which may join a word, is one
        pre-token, however long. Characters on whose class the cutters of two libraries may not
        agree, as newer Unicode versions have more letters, go by the vocabulary's own library."""
        if len(text) > LONG_RUN:
            out, at = [], 0
            for m in _GAPS.finditer(text):
                if m.end() - m.start() > LONG_RUN:
                    end = m.end() - (m.end() < len(text))
                    out += self._cut(text[at : m.start()]) + self._merge._encode_single_piece(text[m.start() : end].encode())
                    at = end
            return out + self._cut(text[at:]) if at else self._cut(text)
        return self._cut(text)

    def _cut(self, text: str) -> list[int]:
        if _RARE.search(text):
            words = [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
            return list(chain.from_iterable(self._merge._encode_single_piece(w.encode()) for w in words))
        return self._merge._core_bpe.encode_ordinary(text)


class Lexicon:
    """Words with id outputs as a minimal acyclic automaton in one flat buffer."""

    MAGIC = b"GLEX1\0\0\0"

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        """Incremental construction from sorted words; states that read alike are one state."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states: final, [(label, settled target)]
        last = b""
        keys = sorted(words)
        for w in keys:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            while len(path) - 1 > same:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            for _ in w[same:]:
                path.append([False, []])
            path[-1][0] = True
            last = w
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = settle(path.pop())
        below = [0] * len(states)  # words that can be read from a state; targets come before
        first, labels, targets, skips = [0], bytearray(), [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for label, target in arcs:
                labels.append(label)
                targets.append(target)
                skips.append(n)
                n += below[target]
            below[s] = n
            first.append(len(labels))
        offsets, ids = [0], []
        for w in keys:
            ids += words[w]
            offsets.append(len(ids))
        parts = [
            bytes(labels),
            bytes(int(f) for f, _ in states),
            *(np.asarray(x, "<i4").tobytes() for x in (first, targets, skips, offsets, ids)),
        ]
        out, at, head = [], len(Lexicon.MAGIC) + 4 + 16 * len(parts), b""
        for p in parts:
            at += -at % 8
            head += struct.pack("<QQ", at, len(p))
            out.append((at, p))
            at += len(p)
        buf = bytearray(at)
        buf[: len(head) + 12] = Lexicon.MAGIC + struct.pack("<I", root) + head
        for pos, p in out:
            buf[pos : pos + len(p)] = p
        return bytes(buf)

    def __init__(self, buf):
        """buf: bytes or a mmap of what compile() gave."""
        view = memoryview(buf)
        if bytes(view[:8]) != self.MAGIC:
            raise ValueError("not a lexicon")
        self.root = struct.unpack_from("<I", view, 8)[0]
        spans = [struct.unpack_from("<QQ", view, 12 + 16 * i) for i in range(7)]
        self.buf, self.labels_at = buf, spans[0][0]
        self.final = view[spans[1][0] : sum(spans[1])]
        self.first, self.target, self.skip, self.offset, self.ids = (
            view[a : a + n].cast("i") for a, n in spans[2:]
        )
        self.states = len(self.final)
        self.marks = bytearray(MARKS)  # most words that the lexicon lacks are known by one look here
        for w in self.words():
            self.marks[hash(w) % MARKS] = 1

    def words(self):
        todo = [(self.root, b"")]
        while todo:
            s, w = todo.pop()
            if self.final[s]:
                yield w
            for at in range(self.first[s], self.first[s + 1]):
                todo.append((self.target[at], w + _ONE[self.buf[self.labels_at + at]]))

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        if not self.marks[hash(word) % MARKS]:
            return None
        s, n, base, find = self.root, 0, self.labels_at, self.buf.find
        for b in word:
            at = find(_ONE[b], base + self.first[s], base + self.first[s + 1])
            if at < 0:
                return None
            n += self.skip[at - base]
            s = self.target[at - base]
        if not self.final[s]:
            return None
        return self.ids[self.offset[n] : self.offset[n + 1]].tolist()


_ONE = [bytes([b]) for b in range(256)]


def as_written(piece: str) -> str:
    """The text that a key of Encoder stands for."""
    return piece[1:] if piece[:1] == " " else piece if piece[:1] == "\n" else " " + piece


#: Instead of ids: the lexicon lacks the piece.
_ABSENT = object()


class Encoder(dict):
    """Text to ids and back; a dict from pieces to their ids, None where a piece needs its context. With a
    lexicon, _ABSENT for the pieces that it lacks."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.v, self.lexicon = vocabulary, lexicon
        self.frequent: dict[str, tuple] = {}  # pieces of the lexicon, which stay

    def __missing__(self, piece: str):
        """piece: what follows a space, without it; or a line feed and what follows it; or a space, another
        white-space character and what follows that, where no space stands before."""
        w = as_written(piece)
        body = w[1:]
        if not body or body[0] in _WHITE or body[-1] in _WHITE:
            ids = None
        else:
            known = self.lexicon.get(w.encode()) if self.lexicon else None
            if known is None:
                ids = _ABSENT if self.lexicon else tuple(self.v.merge(w))
            else:
                ids = tuple(known)
            if known is not None and len(self.frequent) < MEMO_ENTRIES // 2:
                self.frequent[piece] = ids
        if len(piece) <= LONGEST_LEXICON_WORD:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[piece] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " not in text and "\n\n" not in text and " \n" not in text and not text[0].isspace():
            head, *pieces = text.replace("\n", " \n").split(" ")
            ids = [self[p] for p in pieces]
            if None not in ids:
                if _ABSENT not in ids:
                    return [*self.v.merge(head), *chain.from_iterable(ids)]
                out, rest = [], head  # rest: what is merged before the next piece of the lexicon
                for p, x in zip(pieces, ids, strict=True):
                    if x is _ABSENT:
                        rest += p if p[0] == "\n" else " " + p
                    else:
                        if rest:
                            out += self.v.merge(rest)
                            rest = ""
                        out += x
                return out + self.v.merge(rest) if rest else out
        return self._spaced(text)

    def _spaced(self, text: str) -> list[int]:
        """Any white space: all of a run but its last character is cut off before that character joins the
        word that follows; at the end of the text the run is whole."""
        out: list[int] = []
        start = 0  # of what is merged before the next piece of the lexicon
        for m in _RUNS.finditer(text):
            space, body = (m[3], "") if m[3] else (m[1], m[2])
            if not space or not body:
                continue
            last = space[-1]
            ids = self[body if last == " " else last + body if last == "\n" else " " + last + body]
            if ids is None:
                return self.v.merge(text)
            if ids is not _ABSENT:
                if start < m.start():
                    out += self.v.merge(text[start : m.start()])
                if len(space) > 1:
                    out += self.v.merge(space[:-1])
                out += ids
                start = m.end()
        return out + self.v.merge(text[start:]) if start < len(text) else out

    def encode(self, text: str) -> list[int]:
        if self.v.cut is None or not any(s in text for s in self.v.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.v.cut.split(text):
            if part in self.v.special:
                out.append(self.v.special[part])
            else:
                out += self._plain(part)
        return out

    def encode_whole(self, text: str) -> list[int]:
        """The same ids without the lexicon and the memo, merged in one call: quicker where many words are rare."""
        if _RARE.search(text) or any(s in text for s in self.v.special):
            return self.encode(text)
        return self.v.merge(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(vocabulary_path: str, lexicon_file: str | None = None) -> Encoder:
    """This worker process's encoder; the lexicon is a file that addFile has shipped."""
    key = (vocabulary_path, lexicon_file)
    if key not in _encoders:
        v = next((e.v for (p, _), e in _encoders.items() if p == vocabulary_path), None) or Vocabulary(vocabulary_path)
        _encoders.clear()
        _encoders[key] = Encoder(v, Lexicon.open(SparkFiles.get(lexicon_file)) if lexicon_file else None)
    return _encoders[key]


def frequent_pieces(docs: DataFrame, size: int = 32_768, text_col: str = "text") -> list[tuple[str, int]]:
    """The most frequent pieces over all documents, at most size, ties by the piece. A partition
    gives the pieces that make up 1/size or more of its own, so every piece of that share in the
    corpus is given by some partition, and no partition gives more than size rows."""

    def count(batches):
        seen, total = Counter(), 0
        for b in batches:
            for t in b.column(0):
                if t := t.as_py():
                    pieces = t.replace("\n", " \n").split(" ")
                    seen.update(pieces)
                    total += len(pieces)
            if len(seen) > COUNTED:  # what is rare so far is counted anew; this only chooses words, ids are exact
                rare = total // (4 * COUNTED) + 1
                seen = Counter({w: n for w, n in seen.items() if n > rare and len(w) <= LONGEST_LEXICON_WORD})
        least = max(2, total / size)
        kept = [(w, n) for w, n in seen.items() if n >= least and w and len(w) <= LONGEST_LEXICON_WORD]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["w", "n"]
        )

    counted = docs.select(text_col).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [(r.w, r.n) for r in counted.orderBy(F.desc("n"), "w").limit(size).collect()]


def ship_lexicon(docs: DataFrame, vocabulary_path: str, size: int = 32_768) -> str | None:
    """Counts, compiles and ships the lexicon; the name by which workers find its file."""
    encoder = Encoder(Vocabulary(vocabulary_path))
    words: dict[bytes, list[int]] = {}
    for piece, _ in frequent_pieces(docs, size):
        if encoder[piece] is not None:
            words[as_written(piece).encode()] = list(encoder[piece])
    if not words:
        return None
    data = Lexicon.compile(words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"  # a file's name can be registered once in a session
    path = os.path.join(tempfile.mkdtemp(prefix="gridlake-lexicon-"), name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the text that
    the ids decode to) and, with keep_ids, ids (array<int>)."""
    lexicon = ship_lexicon(docs, vocabulary_path)

    def run(batches):
        e = worker_encoder(vocabulary_path, lexicon)
        names = [str(i) for i in range(e.v.size)]
        for b in batches:
            n, a, d, kept = [], [], [], []
            for t in b.column(1):
                ids = e.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(np.asarray(ids, np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names_out = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names_out.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names_out)

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, schema)
