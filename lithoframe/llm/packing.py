"""Packing of tokenised documents into sequences, best fit decreasing.

Documents longer than a sequence are cut into whole sequences and a last piece. The pieces below a whole sequence are
dealt by hash into groups; in each, pieces go in decreasing length into the open sequence that they fill best. A segment
tree over the remaining capacities finds it in logarithmic time.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut
from lithoframe.llm.common import Remembered, per_process, portions

#: str.split() parts at the first four, the tokenizer doesn't; its special strings begin with the last.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: White space beyond ASCII, of str.split() and the tokenizer alike.
WIDE = "".join(c for c in map(chr, range(128, 1 << 16)) if c.isspace())
#: Marks that end a word for the tokenizer wherever they follow a letter.
MARKS = ".,;:!?%$&*#|"


@dataclass(frozen=True)
class Settings:
    vocabulary: str | None = None   # a tokenizers file, for whole texts; by default word_bpe_49k.json of the public ones, part by part
    capacity: int = 2048            # tokens of a sequence
    end: int = 0                    # id after each document
    group: int = 16384              # pieces that are packed together
    words: int = 131_072            # words that a worker remembers the ids of; more take memory and save time

    def path(self) -> str:
        import public_tokenizers

        return self.vocabulary or public_tokenizers.path("word_bpe_49k.json")


class Words(Remembered):
    """Ids of each white-space delimited part of a text, little-endian 32-bit.

    The vocabulary drops white space, and never joins across it or across the edge between a letter and a mark, and
    ignores case. So the ids of a text are those of its parts in order, and a part's those of its letters and of the
    marks after them. A text with its special strings, or with control characters that only Python takes for white
    space, is encoded whole.
    """

    def __init__(self, path: str, whole: bool = False, limit: int = Settings.words):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.limit = whole, limit
        self.tokenizer, self.bodies, self.older, self.older_bodies = Tokenizer.from_file(path), {}, {}, {}
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)   # the former leaves out offsets
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def ends_in_letter(c: str) -> bool:
        """Whether a mark after this character begins a word of its own: not where the tokenizer takes it for a letter and a mark."""
        return c.isalpha() and (c.isascii() or len(low := unicodedata.normalize("NFC", c).lower()) == 1 and low.isalpha())

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, parts: list[str]) -> list[bytes]:
        halves, letter = [], self.ends_in_letter
        for part in parts:
            if part.isascii() and part.isalpha():   # most are
                halves.append((part.lower(), ""))
                continue
            body = part.rstrip(MARKS)
            last = body[-1:]
            if last.isalpha() and (last.isascii() or letter(last)):
                halves.append((body.lower() if body.isascii() else body, part[len(body):]))
            else:
                halves.append(("", part))
        bodies = self._learn_bodies({low for low, _ in halves if low})
        for tail in {tail for _, tail in halves if tail}.difference(bodies):
            bodies[tail] = self.encode(tail)
        return [bodies[low] + bodies[tail] if low and tail else bodies[low or tail] if low or tail else b"" for low, tail in halves]

    def learn(self, texts: list[list[str]]) -> None:
        """Make sure of every word of these texts. Of two generations of words the older is forgotten, but for those met again."""
        for w in self.__dict__.pop("long", ()):
            self.pop(w, None)
        if len(self) > self.limit // 2:
            self.older = dict(self)
            self.clear()
        new = set().union(*texts).difference(self)
        met = [w for w in new if w in self.older]   # not intersection(), which goes through all that are held
        self.update(zip(met, map(self.older.__getitem__, met)))
        new = list(new.difference(met))
        self.update(zip(new, self.encode_all(new)) if new else ())
        self.long = [w for w in new if len(w) > self.longest]

    def _learn_bodies(self, bodies: set[str]) -> dict[str, bytes]:
        """Words of letters alone are encoded many at once: each ends with the only token that can end a word."""
        if len(self.bodies) > self.limit:
            self.older_bodies, self.bodies = self.bodies, {}
        held, new = self.bodies, bodies.difference(self.bodies)
        met = [b for b in new if b in self.older_bodies]
        held.update(zip(met, map(self.older_bodies.__getitem__, met)))
        new = list(new.difference(met))
        plain = [b for b in new if b.isalpha()]
        for k in range(0, len(plain), 100):
            some = plain[k:k + 100]
            ids = np.array(self.many([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):
                own, ends = ids.tobytes(), (4 * ends).tolist()
                held.update(zip(some, (own[i:j] for i, j in zip([0, *ends[:-1]], ends))))
            else:  # lower case of a letter can be a letter and a mark, which is a word by itself
                held.update((b, self.encode(b)) for b in some)
        for b in new:
            if not b.isalpha():
                held[b] = self.encode(b)
        return held

    def parted(self, text: str | None) -> str:
        """The text with ASCII white space between its parts; nothing of a text that is encoded whole."""
        if text is None or self.whole or any(c in text for c in ODD):
            return ""
        return text if text.isascii() or not any(c in text for c in WIDE) else " ".join(text.split())

    def ids(self, texts: list) -> Iterator[bytes]:
        """Of each text; of null, none. Arrow finds the different words of a portion, and deals the ids of each to its places."""
        for some in portions(texts, 1 << 22):
            plain = [self.parted(t) for t in some]
            parts = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
            found = parts.flatten().dictionary_encode()
            different = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.learn([different])
            dealt = pa.array(list(map(self.__getitem__, different)), pa.large_binary()).take(found.indices)
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(dealt).to_numpy())])[parts.offsets.to_numpy()].tolist()
            own = memoryview(dealt.buffers()[2] or b"")
            for t, p, start, end in zip(some, plain, ends, ends[1:]):
                yield bytes(own[start:end]) if p or not t else self.encode(t)


class BestFit:
    """Open sequences by remaining capacity; a segment tree of counts finds the least capacity that holds a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)           # is any sequence open below this node
        self.held: list[list] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def _set(self, room: int, value: int) -> None:
        node, tree = room + self.leaves, self.open
        tree[node] = value
        node >>= 1
        while node:
            value = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1

    def _tightest(self, length: int) -> int:
        """The least open capacity of at least length, or 0."""
        node, tree = length + self.leaves, self.open
        if tree[node]:
            return length
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def put(self, length: int) -> tuple[int, int]:
        """The sequence that takes the piece and the place in it."""
        room = self._tightest(length)
        if room:
            sequence = self.held[room].pop()
            if not self.held[room]:
                self._set(room, 0)
        else:
            room, sequence = self.capacity, self.count
            self.count += 1
        left = room - length
        if left:
            self.held[left].append(sequence)
            if len(self.held[left]) == 1:
                self._set(left, 1)
        return sequence, self.capacity - room


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """The pieces of every row; a whole sequence has its id already: the task's number and a count in it."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = per_process(Words, s.path(), s.vocabulary is not None, s.words), np.array([s.end], "<u4").tobytes()
        sequence, step = (TaskContext.get().partitionId() + 1) << 34, 4 * s.capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1).to_pylist())):
                ids = memoryview(ids + end)
                for k, i in enumerate(range(0, len(ids), step)):
                    part = ids[i:i + step]
                    full = len(part) == step
                    for column, x in zip(out, (key, k, i // 4, len(part) // 4, zlib.crc32(part), sequence if full else None)):
                        column.append(x)
                    sequence += full
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 4))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null text is empty and has the end id alone. A row has at most one piece below a whole sequence, so the number of
    rows gives the number of groups; a group leaves about one sequence half empty. Equal lengths go by id, then by
    checksum, so a task that runs again packs the same. Repeated rows are packed as often as they come. Other columns
    of docs don't matter.
    """
    s = settings
    made = cut(pieces(docs, text, doc_id, s))
    part = made.filter(F.col("sequence_id").isNull())
    groups = max(1, math.ceil(part.count() / s.group))
    dealt = part.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins = BestFit(s.capacity)
        placed = [bins.put(n) for n in table.column("length").to_pylist()]
        base = (1 << 62) + (table.column("_group")[0].as_py() << 34)
        return pa.table({**{c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                         "sequence_id": pa.array([base + b for b, _ in placed], pa.int64()),
                         "offset": pa.array([at for _, at in placed], pa.int64())})

    packed = dealt.groupBy("_group").applyInArrow(fill, f"{PIECES}, offset long")
    return made.filter(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long")).unionByName(packed)
