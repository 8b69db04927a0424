"""Hierarchical Pitman-Yor language model, its restaurants seated by Gibbs sampling.

The word after a context is a customer of the context's restaurant; a table there is a customer of the parent, which all contexts
share; the parent's tables draw from a uniform base. A sample of the seating gives every word a predictive probability,
and the model's is the mean over samples.

How it is dealt out:

1. Documents become blocks of coded tokens. All later passes read these.
2. Words are routed by hash to slots, with the documents that hold them, and pairs of words by their context likewise. A
   context with a large share of all tokens is sliced by its words. A slot sums its part of every document's score, so no
   document travels and no slot sends anything but sums.
3. A round seats all context restaurants given the parent's predictive probabilities, sends the tables per word up, seats the
   parent and sends its part down. Inside a round customers leave and choose a table again: one by one in the
   largest dishes of a slot, all of a dish at once in the others. A word that followed its context once has a single table and needs no seat.
4. The last pass seats the contexts for each sample and scores the pairs.

Slots, blocks and messages grow with the corpus; the driver holds totals, sliced contexts and a list of frequent words that shortens
messages, each of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import discard, settled, trim

#: What stands for the end of a text, and for what comes before its first word; no word is white space.
END, START = b"\n", b"\n\n"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Settings:
    strength: float = 1.0       # of every restaurant
    rounds: int = 3             # seatings of the parent
    samples: int = 2            # the last rounds, whose predictions are averaged
    sweeps: int = 1             # over all customers of a restaurant in a round
    block_chars: int = 1 << 23  # of the texts of a block
    sliced: int = 4096          # a context with more than one of so many tokens may be sliced; so there are fewer of them
    frequent: int = 65535       # words with a short code in messages
    seed: int = 12


@dataclass
class Totals:
    """What all slots know of the whole corpus."""
    tokens: int = 0
    types: int = 0
    slots: int = 1
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def slices(self, contexts: np.ndarray) -> np.ndarray:
        """How many slots share each context."""
        out = np.ones(len(contexts), np.int64)
        at, known = _find(self.hot, contexts & _LOW)
        share = self.hot_counts[at[known]] / max(1, self.tokens)
        out[known] = np.maximum(1, np.ceil(2 * self.slots * share).astype(np.int64))
        return out


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are in a sorted table, and whether they are."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return at, (table[at] == values) if len(table) else np.zeros(len(values), bool)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    return x * _ODD


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, integers in as few bytes as their values need, compressed; first bytes lie by first bytes, second by second, and so on."""
    import zstandard

    small = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) if a.dtype.kind in "iu" and a.ndim == 1 else a for a in arrays]
    planes = [(a.dtype.str, a.shape, np.ascontiguousarray(a).view(np.uint8).reshape(-1, _width(a.dtype, a.shape)).T.tobytes()) for a in small]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def unpack(body: bytes) -> list[np.ndarray]:
    import zstandard

    parts = [(np.dtype(d), shape, planes) for d, shape, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(body))]
    return [np.frombuffer(planes, np.uint8).reshape(_width(d, shape), -1).T.copy("C").reshape(-1).view(d).reshape(shape)
            for d, shape, planes in parts]


def _width(dtype: np.dtype, shape: tuple) -> int:
    """Bytes of a value; those of _narrow() have a row each."""
    return max(1, shape[1]) if dtype == np.uint8 and len(shape) == 2 else dtype.itemsize


def _narrow(values: np.ndarray) -> np.ndarray:
    """The low 40 bits, five bytes each."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :5]


def _widen(bytes_: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(bytes_), 8), np.uint8)
    wide[:, :5] = bytes_
    return wide.view(np.uint64).ravel()


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, text: str, doc_id: str, train: Column, s: Settings) -> DataFrame:
    """A row per block: block, ids, head (tokens of each document, whether it is learnt from), body (words as hashes, the end first; codes)."""
    schema = f"block long, ids array<{docs.schema[doc_id].dataType.simpleString()}>, head binary, body binary"

    def made(number: int, ids: pa.Array, tokens: list, flags: list, index: _Index) -> pa.RecordBatch:
        import xxhash

        words = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        head = pack(np.array([len(t) for t in tokens], np.int64), np.array(flags, np.uint8))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed, pa.array([head], pa.binary()),
                                          pa.array([pack(words, np.concatenate(tokens))], pa.binary())], ["block", "ids", "head", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, tokens, flags, index, held = [], [], [], _Index({END: 0}), 0
        for batch in batches:
            for i, (t, learnt) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                codes = np.zeros(len(t) + 1, np.uint32)
                codes[:-1] = np.fromiter(map(index.__getitem__, t), np.uint32, len(t))
                tokens.append(codes)
                flags.append(bool(learnt))
                ids.append(batch.column(0).slice(i, 1))
                held += 6 * len(codes)
                if held >= s.block_chars:
                    yield made(number, pa.concat_arrays(ids), tokens, flags, index)
                    number += 1
                    ids, tokens, flags, index, held = [], [], [], _Index({END: 0}), 0
                    trim()
        if ids:
            yield made(number, pa.concat_arrays(ids), tokens, flags, index)

    return docs.select(F.col(doc_id), F.col(text), train.alias("learnt")).mapInArrow(run, schema)


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _documents(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse; whole numbers that leave room for their places are sorted together with them, which is much faster."""
    bits = np.uint64(max(1, len(values)).bit_length())
    if len(values) and int(values.max()).bit_length() + int(bits) > 64:
        return np.unique(values, return_inverse=True)
    both = (values.astype(np.uint64) << bits) | np.arange(len(values), dtype=np.uint64)
    both.sort()
    place, both = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits
    new = np.r_[True, both[1:] != both[:-1]] if len(both) else np.empty(0, bool)
    inverse = np.empty(len(both), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return both[new], inverse


def _order(small: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers that are far below 2 ** 32."""
    both = (small.astype(np.uint64) << np.uint64(32)) | np.arange(len(small), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _segments(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)


# --- words: counts, and the base score -------------------------------------------------------------------------------

_WORDS = [("slot", pa.int32()), ("block", pa.int64()), ("body", pa.binary())]


def word_messages(made: DataFrame, slots: int) -> DataFrame:
    """(slot, block, body) of each slot's words in a block: hashes, learnt tokens, documents per word, documents and tokens there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, head, body in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                (lengths, train), (words, codes) = unpack(head), unpack(body)
                docs = _documents(lengths)
                learnt = np.bincount(codes, weights=train[docs], minlength=len(words)).astype(np.int64)
                slot = (_mix(words.astype(np.uint64)) % np.uint64(slots)).astype(np.int64)
                by_slot = _order(slot)
                rank = np.empty(len(words), np.int64)
                rank[by_slot] = np.arange(len(words))
                both, times = np.unique(rank[codes] * len(lengths) + docs, return_counts=True)
                rank, doc = np.divmod(both, len(lengths))
                word = by_slot[rank]
                starts = np.r_[_segments(slot[word]), len(word)]
                rows = []
                for i, j in zip(starts[:-1], starts[1:]):
                    firsts = np.r_[_segments(word[i:j]), j - i]
                    own = word[i:j][firsts[:-1]]
                    rows.append((int(slot[own[0]]), block, pack(words[own], learnt[own], np.diff(firsts), doc[i:j], times[i:j])))
                yield from _rows(_WORDS, rows).to_batches()

    return made.select("block", "head", "body").mapInArrow(run, "slot int, block long, body binary")


def word_totals(messages: DataFrame, top: int) -> DataFrame:
    """(block, body, tokens, types, top) per slot: for each block documents with the sum of log10(c + 0.5) and known tokens of the slot's
    words; in a row without a block the learnt tokens, types, and most frequent words."""
    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table.column("body").to_pylist()]
        words, inverse = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(words))
        value, known, at, rows = np.log10(c + 0.5), c > 0, 0, []
        for block, p in zip(table.column("block").to_pylist(), parts):
            which = np.repeat(inverse[at:at + len(p[0])], p[2])
            at += len(p[0])
            sums = np.bincount(p[3], weights=value[which] * p[4])
            seen = np.bincount(p[3], weights=known[which] * p[4]).astype(np.int64)
            doc = np.unique(p[3])
            rows.append((block, pack(doc, sums[doc], seen[doc]), 0, 0, []))
        best = np.argsort(-c, kind="stable")[:top]
        best = best[c[best] > 0]
        rows.append((None, None, int(c.sum()), int(known.sum()),
                     [{"word": int(w), "n": int(n)} for w, n in zip(words[best].view(np.int64), c[best])]))
        return _rows([("block", pa.int64()), ("body", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()),
                      ("top", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))], rows)

    return messages.groupBy("slot").applyInArrow(
        merge, "block long, body binary, tokens long, types long, top array<struct<word: long, n: long>>")


def learn_totals(words: DataFrame, slots: int, s: Settings) -> Totals:
    import xxhash

    sums = words.agg(F.sum("tokens"), F.sum("types")).first()
    t = Totals(int(sums[0] or 0), int(sums[1] or 0), slots)
    top = words.filter(F.col("block").isNull()).select(F.explode("top").alias("_t")).select("_t.*")
    frequent = top.orderBy(F.desc("n"), "word").limit(s.frequent).select("word").toArrow().column("word").to_numpy()
    t.frequent = np.sort(frequent.view(np.uint64))
    hot = {np.uint64(r.word & 0xFFFFFFFFFFFFFFFF): r.n for r in top.filter(F.col("n") * s.sliced > t.tokens).collect()}
    end = np.uint64(xxhash.xxh64_intdigest(END))
    if end in hot:                      # every text has one end, and one start before it
        hot[np.uint64(xxhash.xxh64_intdigest(START))] = hot.pop(end)
    t.hot = np.array([k & _LOW for k in hot], np.uint64)
    order = np.argsort(t.hot)
    t.hot, t.hot_counts = t.hot[order], np.array(list(hot.values()), np.int64)[order]
    return t


# --- pairs -----------------------------------------------------------------------------------------------------------

def pair_messages(made: DataFrame, t: Totals, documents: bool) -> DataFrame:
    """(slot, block, body, docs) of each slot's pairs in a block. body: contexts (40 bits of the hash), pairs of each, their second words (a
    short code, or 40 bits too), learnt tokens. docs, if asked for: tokens of each pair and the documents they are in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        start = np.uint64(xxhash.xxh64_intdigest(START))
        for batch in batches:
            for block, head, body in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                (lengths, train), (words, codes) = unpack(head), unpack(body)
                words, docs, codes = np.r_[words.astype(np.uint64), start], _documents(lengths), codes.astype(np.uint64)
                before = np.empty_like(codes)
                before[1:] = codes[:-1]
                before[np.cumsum(lengths) - lengths] = len(words) - 1
                wide, deep = np.uint64(len(words).bit_length()), np.uint64(len(lengths).bit_length())
                assert 2 * int(wide) + int(deep) <= 64
                key = ((before << wide | codes) << deep) | docs.astype(np.uint64)   # pair and document in one number
                key.sort()
                docs, key = (key & ((np.uint64(1) << deep) - np.uint64(1))).astype(np.int64), key >> deep
                firsts = _segments(key)
                context, word = (key[firsts] >> wide).astype(np.int64), (key[firsts] & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
                times = np.diff(np.r_[firsts, len(key)])
                learnt = np.add.reduceat(train[docs].astype(np.int64), firsts)
                slices = t.slices(words)
                slice_ = (words[word] >> np.uint64(40)) % slices[context].astype(np.uint64)
                slot = (_mix(words[context] + slice_ * _ODD) % np.uint64(t.slots)).astype(np.int64)
                at, short = _find(t.frequent, words)
                codes16 = np.where(short, at, len(t.frequent))
                by = _order(slot)
                ends = np.r_[_segments(slot[by]), len(by)]
                rows = []
                for i, j in zip(ends[:-1], ends[1:]):
                    own = by[i:j]
                    c, w = context[own], word[own]
                    runs = np.r_[_segments(c), len(c)]
                    sent = pack(_narrow(words[c[runs[:-1]]]), np.diff(runs), codes16[w], _narrow(words[w[~short[w]]]), learnt[own])
                    held = pack(times[own], docs[_ranges(firsts[own], times[own])]) if documents else None
                    rows.append((int(slot[own[0]]), block, sent, held))
                del docs, codes, before, key, firsts, context, word, times, learnt, slice_, slot, codes16, by
                yield from _rows([*_WORDS, ("docs", pa.binary())], rows).to_batches()
                del rows
                trim()

    return made.select("block", "head", "body").mapInArrow(run, "slot int, block long, body binary, docs binary")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its length, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@dataclass
class Pairs:
    """The pairs of a slot: contexts and words (40 bits of each), both sorted, and for each pair their places and its learnt tokens."""
    contexts: np.ndarray
    words: np.ndarray
    context: np.ndarray
    word: np.ndarray
    c: np.ndarray
    inverse: np.ndarray     # of the messages' pairs, one after the other


def merged(bodies: list[bytes], frequent: np.ndarray) -> Pairs:
    contexts, lengths, words, learnt = [], [], [], []
    codes = frequent & _LOW
    for body in bodies:
        c, runs, short, rest, n = unpack(body)
        w = np.empty(len(short), np.uint64)
        is_short = short < len(codes)
        w[is_short] = codes[short[is_short]]
        w[~is_short] = _widen(rest)
        contexts.append(_widen(c))
        lengths.append(runs.astype(np.int64))
        words.append(w)
        learnt.append(n.astype(np.int64))
    own_c, context = np.unique(np.concatenate(contexts), return_inverse=True)
    own_w, word = _ranked(np.concatenate(words))
    pair, inverse = _ranked(np.repeat(context, np.concatenate(lengths)) * len(own_w) + word)
    c = np.bincount(inverse, weights=np.concatenate(learnt), minlength=len(pair)).astype(np.int64)
    context, word = np.divmod(pair.astype(np.int64), len(own_w))
    return Pairs(own_c, own_w, context, word, c, inverse)


# --- seating ---------------------------------------------------------------------------------------------------------

def seat(c: np.ndarray, p0: np.ndarray, restaurant: np.ndarray, tables: np.ndarray, live: np.ndarray, discount: float, s: Settings,
         rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after ``sweeps``: customers c (two or more) and the parent's probability p0 of each dish, its restaurant.

    tables: of each restaurant, kept up to date where ``live``. A customer takes a table of n with weight n - discount, a new one with
    (strength + discount * tables) * p0. The few largest dishes have their customers leave and sit again one by one; of the others
    all customers leave at once, and the number of tables they sit down to is drawn from its exact distribution.
    """
    out = np.ones(len(c), np.int64)
    two = np.flatnonzero(c == 2)    # two customers sit apart with a probability that is known outright
    a = (s.strength + discount * tables[restaurant[two]]) * p0[two]
    out[two] += rng.random(len(two)) * (a + 1 - discount) < a
    np.add.at(tables, restaurant[two], (out[two] - 1) * live[restaurant[two]])
    order = np.flatnonzero(c > 2)
    order = order[np.argsort(-c[order], kind="stable")]
    a = (s.strength + discount * tables[restaurant[order]]) * p0[order]
    # many customers with few chances of a new table come to 1 + Poisson(a / discount) tables
    near = a / discount * (1 - (1 + (c[order] - 1) / (1 - discount + a)) ** -discount)
    out[order] = np.minimum(1 + rng.poisson(np.minimum(near, 1e6)), c[order])
    np.add.at(tables, restaurant[order], (out[order] - 1) * live[restaurant[order]])
    few, rest = order[:_FEW], order[_FEW:][::-1]
    sizes = [_begin(int(c[k]), int(out[k]), rng) for k in few]
    for _ in range(s.sweeps):
        for k, size in zip(few, sizes):
            out[k] = _seat_dish(size, float(p0[k]), tables, restaurant[k], live, discount, s, rng)
        _seat_dishes(rest, out, c, p0, restaurant, tables, live, discount, s, rng)
    return out


_FEW = 8        # dishes of a slot whose customers move one by one; the numbers of tables of smaller ones are drawn
_CELLS = 1 << 17   # weights that are held at once
_NEVER = 60.0   # numbers of tables that are less likely by this power of e are left out


def _begin(c: int, tables: int, rng: np.random.Generator) -> list[int]:
    """The table of each customer, one at least at each."""
    share = rng.standard_exponential(tables)
    return np.r_[np.arange(tables), rng.choice(tables, c - tables, p=share / share.sum())].tolist()


def _chances(rng: np.random.Generator) -> Iterator[float]:
    while True:
        yield from rng.random(4096).tolist()


def _seat_dish(at: list[int], p0: float, tables, restaurant, live, discount, s, rng) -> int:
    """The tables of a dish after each customer, whose table ``at`` has, left and took one again.

    A table is taken with weight n - discount by following any of its n others with a chance of 1 - discount / n.
    """
    c, counted, total = len(at), int(live[restaurant]), int(tables[restaurant])
    size = np.bincount(at).tolist()
    free = [k for k, n in enumerate(size) if not n]
    used = len(size) - len(free)
    more = _chances(rng)
    for begin in range(0, c, 65536):
        for me, (u, v) in enumerate(rng.random((min(65536, c - begin), 2)).tolist(), begin):
            left = at[me]
            size[left] -= 1
            if not size[left]:
                free.append(left)
                used -= 1
                total -= counted
            joined, new = c - 1 - discount * used, (s.strength + discount * total) * p0
            if u * (joined + new) >= joined:
                if not free:
                    free.append(len(size))
                    size.append(0)
                taken = free.pop()
                used += 1
                total += counted
            else:
                other = int(v * (c - 1))
                taken = at[other + (other >= me)]
                while next(more) * size[taken] < discount:
                    other = int(next(more) * (c - 1))
                    taken = at[other + (other >= me)]
            size[taken] += 1
            at[me] = taken
    tables[restaurant] = total
    return used


def _seat_dishes(order, out, c, p0, restaurant, tables, live, discount, s, rng) -> None:
    """Draws the numbers of tables, out, of dishes in ascending order of c.

    t tables of c customers weigh S(c, t), the generalised Stirling number of the discount, times what opening them weighs. S follows
    from S(c - 1, t - 1) + (c - 1 - discount * t) * S(c - 1, t), so one pass up to the largest dish serves all; it is as wide as any
    dish here may need.
    """
    if not len(order):
        return
    opens = np.log(np.maximum((s.strength + discount * (tables[restaurant[order]] + c[order])) * p0[order], 1e-300))
    opens = np.maximum.accumulate(opens[::-1])[::-1]        # of any dish not yet reached
    row, n, i = np.zeros(1), 1, 0                           # log S(1, 1)
    rows, which, held = [], [], 0

    def draw() -> None:
        own, at = order[i - len(which):i], np.array(which)
        table = np.full((len(rows), max(map(len, rows))), -np.inf)
        for k, r in enumerate(rows):
            table[k, :len(r)] = r
        step = max(1, _CELLS // table.shape[1])
        for k in range(0, len(own), step):
            _draw(own[k:k + step], table[at[k:k + step]], out, p0, restaurant, tables, live, discount, s, rng)

    sizes = c[order]
    while i < len(order):
        while n < sizes[i]:
            same = np.r_[row + np.log(n - discount * np.arange(1, len(row) + 1)), -np.inf]
            same[1:] = np.logaddexp(same[1:], row)
            row = same
            n += 1
            if n & 15 == 0:
                weight = row + opens[i] * np.arange(len(row))
                row = row[:int(np.flatnonzero(weight >= weight.max() - _NEVER)[-1]) + 1]
        j = int(np.searchsorted(sizes, n, side="right"))
        rows.append(row)
        which += [len(rows) - 1] * (j - i)
        held += len(row) * (j - i + 1)
        i = j
        if held >= _CELLS or i == len(order):
            draw()
            rows, which, held = [], [], 0


def _draw(own, weight, out, p0, restaurant, tables, live, discount, s, rng) -> None:
    """Numbers of tables by their log Stirling numbers, and by the restaurants' other tables."""
    r, width = restaurant[own], np.arange(weight.shape[1])
    counted = live[r]
    others = tables[r] - out[own] * counted
    opened = s.strength + discount * (others[:, None] + width * counted[:, None])     # before each table
    weight = weight + np.cumsum(np.log(opened * p0[own, None]), axis=1)
    weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    now = 1 + np.minimum((weight <= (rng.random(len(own)) * weight[:, -1])[:, None]).sum(axis=1), weight.shape[1] - 1)
    np.add.at(tables, r, (now - out[own]) * counted)
    out[own] = now


def _contexts(p: Pairs, t: Totals, hot_tables: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers, tables (one per pair) and whether the slot holds all of it, of each context."""
    n = len(p.contexts)
    customers = np.bincount(p.context, weights=p.c, minlength=n).astype(np.int64)
    tables = np.bincount(p.context, weights=p.c > 0, minlength=n).astype(np.int64)
    live = t.slices(p.contexts) == 1
    for k in np.flatnonzero(~live):
        at = np.searchsorted(t.hot, p.contexts[k])
        customers[k] = t.hot_counts[at]
        tables[k] = hot_tables.get(int(p.contexts[k]), int(tables[k]))
    return customers, tables, live


@dataclass
class Parent:
    """Totals of the parent restaurant in a round, and tables of the sliced contexts."""
    round: int
    customers: int
    tables: int
    discount: float
    hot_tables: dict[int, int]

    def p0(self, part: np.ndarray, t: Totals, s: Settings) -> np.ndarray:
        """The parent's predictive probability from a word's customers less their discounts."""
        return (part + (s.strength + self.discount * self.tables) / (t.types + 1)) / (s.strength + self.customers)


def _rng(s: Settings, slot: int, round_: int, level: int) -> np.random.Generator:
    return np.random.default_rng([s.seed, slot, round_, level])


def _words_slot(words: np.ndarray, slots: int) -> np.ndarray:
    return (_mix(words) % np.uint64(slots)).astype(np.int64)


_UP = [("slot", pa.int32()), ("to", pa.int32()), ("body", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64()),
       ("hot", pa.list_(pa.struct([("context", pa.int64()), ("n", pa.int64())])))]
_UP_SCHEMA = "slot int, to int, body binary, ones long, twos long, hot array<struct<context: long, n: long>>"


def _hot_rows(p_contexts: np.ndarray, n: np.ndarray, live: np.ndarray) -> list[dict]:
    return [{"context": int(p_contexts[k].view(np.int64)), "n": int(n[k])} for k in np.flatnonzero(~live)]


def merge_slots(messages: DataFrame, t: Totals) -> DataFrame:
    """Of each slot a row (to null) with its pairs of two or more, and rows to the slots of its words: words, pairs of one, pairs of more."""
    def merge(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        p = merged(table.column("body").to_pylist(), t.frequent)
        customers, tables, live = _contexts(p, t, {})
        local = np.bincount(p.context, weights=p.c > 0, minlength=len(p.contexts)).astype(np.int64)
        some = p.c > 1
        single = np.bincount(p.word, weights=p.c == 1, minlength=len(p.words)).astype(np.int64)
        more = np.bincount(p.word[some], minlength=len(p.words)).astype(np.int64)
        keep = np.flatnonzero(more)
        used = np.unique(p.context[some])
        body = pack(p.contexts[used], customers[used], local[used], np.searchsorted(used, p.context[some]), p.words[keep],
                    np.searchsorted(keep, p.word[some]), p.c[some])
        rows = [(slot, None, body, int((p.c == 1).sum()), int((p.c == 2).sum()), _hot_rows(p.contexts, local, live))]
        to = _words_slot(p.words, t.slots)
        for k in np.unique(to):
            own = to == k
            rows.append((slot, int(k), pack(p.words[own], single[own], more[own]), 0, 0, []))
        return _rows(_UP, rows)

    return messages.select("slot", "body").groupBy("slot").applyInArrow(merge, _UP_SCHEMA)


def single_words(up: DataFrame) -> DataFrame:
    """(to, body, ones, twos): of each slot its words and in how many contexts they were once; words of one and of two contexts."""
    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table.column("body").to_pylist()]
        words, inverse = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        single, more = (np.bincount(inverse, weights=np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
        return _rows([("to", pa.int32()), ("body", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64())], [(
            table.column("to")[0].as_py(), pack(words, single), int((single + more == 1).sum()), int((single + more == 2).sum()))])

    return up.select("to", "body").groupBy("to").applyInArrow(merge, "to int, body binary, ones long, twos long")


def seat_parent(singles: DataFrame, up: DataFrame, t: Totals, round_: int, tables: int, discount: float, s: Settings) -> DataFrame:
    """(slot, to, body, customers, tables): of each slot of words, for every slot of pairs its words' customers less discounts, and a row (slot
    null) with all words."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_DOWN, [])
        to = left.column("to")[0].as_py()
        words, single = unpack(left.column("body")[0].as_py())
        words, c = words.astype(np.uint64), single.astype(np.int64)
        asked = [(k, unpack(b)) for k, b in zip(right.column("slot").to_pylist(), right.column("body").to_pylist())]
        for _, (w, n) in asked:
            np.add.at(c, np.searchsorted(words, w.astype(np.uint64)), n.astype(np.int64))
        seats = np.minimum(c, 1)
        some = np.flatnonzero(c > 1)
        if len(some):
            seats[some] = seat(c[some], np.full(len(some), 1 / (t.types + 1)), np.zeros(len(some), np.int64), np.array([tables]),
                               np.zeros(1, bool), discount, s, _rng(s, to, round_, 0))
        part = (c - discount * seats).astype(np.float32)
        rows = [(None, to, pack(words, part), int(c.sum()), int(seats.sum()))]
        rows += [(k, to, pack(part[np.searchsorted(words, w.astype(np.uint64))]), 0, 0) for k, (w, _) in asked]
        return _rows(_DOWN, rows)

    return singles.select("to", "body").groupBy("to").cogroup(up.select("to", "slot", "body").groupBy("to")).applyInArrow(
        run, "slot int, to int, body binary, customers long, tables long")


_DOWN = [("slot", pa.int32()), ("to", pa.int32()), ("body", pa.binary()), ("customers", pa.int64()), ("tables", pa.int64())]


def _gathered(replies: pa.Table, words: np.ndarray, slots: int, shape: tuple = ()) -> np.ndarray:
    """The replies to a slot's words, in their order."""
    to, out = _words_slot(words, slots), np.zeros((*shape, len(words)), np.float32)
    for k, body in zip(replies.column("to").to_pylist(), replies.column("body").to_pylist()):
        out[..., to == k] = unpack(body)[0]
    return out


def seat_contexts(kept: DataFrame, down: DataFrame, t: Totals, parent: Parent, discount: float, s: Settings) -> DataFrame:
    """Tables per word of each slot's pairs of two or more, as rows to the slots of the words, and those of sliced contexts."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_UP, [])
        slot = left.column("slot")[0].as_py()
        contexts, _, tables, context, words, word, c = unpack(left.column("body")[0].as_py())
        contexts, words = contexts.astype(np.uint64), words.astype(np.uint64)
        live = t.slices(contexts) == 1
        local = tables.astype(np.int64)
        tables = local.copy()
        for k in np.flatnonzero(~live):
            tables[k] = parent.hot_tables.get(int(contexts[k]), tables[k])
        p0 = parent.p0(_gathered(right, words, t.slots), t, s)
        seats = seat(c.astype(np.int64), p0[word], context.astype(np.int64), tables, live, discount, s, _rng(s, slot, parent.round, 1)) \
            if len(c) else np.empty(0, np.int64)
        now = local + np.bincount(context, weights=seats - 1, minlength=len(contexts)).astype(np.int64) if len(c) else local
        sums = np.bincount(word, weights=seats, minlength=len(words)).astype(np.int64)
        rows = [(slot, None, None, 0, 0, _hot_rows(contexts, now, live))]
        to = _words_slot(words, t.slots)
        for k in np.unique(to):
            rows.append((slot, int(k), pack(words[to == k], sums[to == k]), 0, 0, []))
        return _rows(_UP, rows)

    return kept.select("slot", "body").groupBy("slot").cogroup(down.select("slot", "to", "body").groupBy("slot")).applyInArrow(run, _UP_SCHEMA)


def _hot_tables(up: DataFrame, before: dict[int, int]) -> dict[int, int]:
    rows = up.filter(F.col("to").isNull()).select(F.explode("hot").alias("_h")).groupBy("_h.context").agg(F.sum("_h.n").alias("n")).collect()
    return before | {r.context & 0xFFFFFFFFFFFFFFFF: r.n for r in rows}


# --- scores ----------------------------------------------------------------------------------------------------------

def word_parts(asked: DataFrame, states: DataFrame) -> DataFrame:
    """(slot, to, body): for every slot of pairs its words' part in each sample. states: to, number, body."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("number").to_numpy())
        held = [unpack(right.column("body")[int(k)].as_py()) for k in order]
        rows = []
        for slot, body in zip(left.column("slot").to_pylist(), left.column("body").to_pylist()):
            at = np.searchsorted(held[0][0], unpack(body)[0].astype(np.uint64))
            rows.append((slot, left.column("to")[0].as_py(), pack(np.stack([h[1][at] for h in held]))))
        return _rows([("slot", pa.int32()), ("to", pa.int32()), ("body", pa.binary())], rows)

    return asked.select("to", "slot", "body").groupBy("to").cogroup(states.groupBy("to")).applyInArrow(run, "slot int, to int, body binary")


def pair_scores(messages: DataFrame, parts: DataFrame, t: Totals, parents: list[Parent], discount: float, s: Settings) -> DataFrame:
    """(block, body): documents with the sum over a slot's pairs of log10 of the mean probability."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([("block", pa.int64()), ("body", pa.binary())], [])
        slot = left.column("slot")[0].as_py()
        p = merged(left.column("body").to_pylist(), t.frequent)
        part = _gathered(right, p.words, t.slots, (len(parents),))
        some, mean = np.flatnonzero(p.c > 1), np.zeros(len(p.c))
        for k, parent in enumerate(parents):
            customers, tables, live = _contexts(p, t, parent.hot_tables)
            p0 = parent.p0(part[k], t, s)[p.word]
            seats = np.minimum(p.c, 1)
            if len(some):
                seats[some] = seat(p.c[some], p0[some], p.context[some], tables, live, discount, s, _rng(s, slot, parent.round, 1))
            mean += predictive(p.c, seats, customers[p.context], tables[p.context], p0, discount, s.strength) / len(parents)
        value, at, rows = np.log10(mean), 0, []
        for block, held in zip(left.column("block").to_pylist(), left.column("docs").to_pylist()):
            times, docs = unpack(held)
            which = np.repeat(p.inverse[at:at + len(times)], times)
            at += len(times)
            sums, doc = np.bincount(docs, weights=value[which]), np.unique(docs)
            rows.append((block, pack(doc, sums[doc])))
        return _rows([("block", pa.int64()), ("body", pa.binary())], rows)

    return messages.groupBy("slot").cogroup(parts.groupBy("slot")).applyInArrow(run, "block long, body binary")


def predictive(c, seats, customers, tables, p0, discount: float, strength: float):
    """Probability of a dish in a restaurant, from its customers and tables there and the parent's probability."""
    return (c - discount * seats + (strength + discount * tables) * p0) / (strength + customers)


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))


def score(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """A row per row of docs: doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities of the text).

    Rows for which ``train`` holds are learnt from (null: not). Tokens are words in lower case (A to Z alone) and an end; a null text
    has the end alone. Words are told apart by 64-bit hashes, in the seating and its scores by 40 bits. Repeated rows count as often
    as they come. With nothing to learn from every text has probability 1. An empty table gives none; other columns of docs don't matter.
    """
    s = settings
    made = settled(blocks(docs, text, doc_id, train, s))
    slots = max(1, made.count())
    words = settled(word_totals(word_messages(made, slots), max(s.sliced, 4 * s.frequent // slots)))
    t = learn_totals(words, slots, s)

    up = settled(merge_slots(pair_messages(made, t, False), t))
    kept, asked = up.filter(F.col("to").isNull()), up.filter(F.col("to").isNotNull())
    singles = settled(single_words(asked))
    pairs, types = up.agg(F.sum("ones"), F.sum("twos")).first(), singles.agg(F.sum("ones"), F.sum("twos")).first()
    lower, upper = _discount(pairs[0] or 0, pairs[1] or 0), _discount(types[0] or 0, types[1] or 0)

    sent, hot, tables = settled(_first_up(asked)), _hot_tables(up, {}), t.types
    parents, states, done = [], [], [singles, sent]
    for number in range(1, s.rounds + 1):
        down = settled(seat_parent(singles, sent, t, number, tables, upper, s))
        sums = down.agg(F.sum("customers"), F.sum("tables")).first()
        tables = int(sums[1] or 0)
        parent = Parent(number, int(sums[0] or 0), tables, upper, hot)
        if number > s.rounds - s.samples:
            parents.append(parent)
            states.append(down.filter(F.col("slot").isNull()).select("to", F.lit(number).alias("number"), "body"))
        else:
            done.append(down)
        if number < s.rounds:
            seated = settled(seat_contexts(kept, down.filter(F.col("slot").isNotNull()), t, parent, lower, s))
            sent, hot = seated.filter(F.col("to").isNotNull()), _hot_tables(seated, hot)
            done.append(seated)
    for table in done:      # nothing below reads them
        discard(table)
    state = states[0]
    for more in states[1:]:
        state = state.unionByName(more)
    parts = word_parts(asked, state)
    scored = settled(pair_scores(pair_messages(made, t, True), parts, t, parents, lower, s))
    return _per_document(made, words, scored, docs.schema[doc_id].dataType.simpleString(), doc_id, t)


def _first_up(asked: DataFrame) -> DataFrame:
    """The words of pairs of two or more, with one table for each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for b in batch.column("body").to_pylist():
                words, _, more = unpack(b)
                bodies.append(pack(words[more > 0], more[more > 0]))
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("to"), pa.array(bodies, pa.binary())], ["slot", "to", "body"])

    return asked.select("slot", "to", "body").mapInArrow(run, "slot int, to int, body binary")


def _per_document(made: DataFrame, words: DataFrame, scored: DataFrame, id_type: str, doc_id: str, t: Totals) -> DataFrame:
    sums = words.filter(F.col("block").isNotNull()).select("block", "body", F.lit(True).alias("base")).unionByName(
        scored.select("block", "body", F.lit(False).alias("base")))
    under = np.log10(t.tokens + 0.5 * (t.types + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, train = unpack(left.column("head")[0].as_py())
        base, known, model = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        for body, is_base in zip(right.column("body").to_pylist(), right.column("base").to_pylist()):
            held = unpack(body)
            if is_base:
                base[held[0]] += held[1]
                known[held[0]] += held[2]
            else:
                model[held[0]] += held[1]
        ids = left.column("ids").combine_chunks().flatten()
        n = lengths.astype(np.int64)
        return pa.table({doc_id: ids, "learnt": pa.array(train.astype(bool)), "n_tokens": pa.array(n), "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(n), t.tokens, np.int64)), "base_score": pa.array(base - n * under),
                         "score": pa.array(model)})

    return made.select("block", "ids", "head").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
        run, f"{doc_id} {id_type}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
