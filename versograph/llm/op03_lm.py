"""Language-model scores from an Elias-Fano n-gram trie.

The model has all n-grams up to ``ORDER`` of the training texts, none pruned.
Smoothing is hierarchical (Dirichlet): P(w | h) = (c(hw) + K P(w | h')) / (c(h) + K),
with h' the context without its first word and the add-½ unigram at the bottom; it
sums to one and needs the counts of n-grams only.

No task ever holds the whole model.  Texts are packed into blocks of bounded size
(a written table).  A block sends the sorted hashes of its distinct n-grams with its
own training counts to shards of the hash space, Elias-Fano coded; a shard adds the
counts of all blocks up and answers each block with the totals of the n-grams it
asked for.  What moves is one packed array per block and shard, pre-aggregated; a
shard of which a block has no n-gram gets no row, so there are never more rows than
distinct n-grams of blocks, however many blocks and shards there are.
The task of a block then builds the trie of the n-grams that its texts can meet
(a block's trie, of about ``BLOCK_BYTES`` of text, not the corpus's):

* a level is a monotone sequence in Elias-Fano form (low parts as bytes, high parts
  as unary bits) with monotone pointers to each node's successors;
* at the second level a key is the context's number times the number of words plus the
  word, at the third a word is coded relative to its context, as its place among the
  successors of the word before, so keys are small;
* log10 probabilities and back-off weights are quantised to ``LEVELS`` steps;
* the arrays lie in one anonymous memory map, so no folder of the machine is used, and
  stay packed: a directory has the value and the bit of every ``STEP``th entry, and a
  search unpacks only the steps that it comes to, one at a time.

A query looks a word up among the successors of its context by successor search and
backs off where it is missing.  The distinct n-grams of a block are asked in sorted
order, so a search goes through a level once.

N-gram hashes get as many bits as keep the rate of false matches near 2^-16 at any
corpus size; words keep 64 bits.

Results: null and empty texts have one token (the end); repeated rows count and are
scored each; without training texts all words are unknown.
"""

from __future__ import annotations

import math
import mmap
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.llm.common import held_out, table, written

ORDER, LEVELS = 3, 4096
#: Weight of the shorter context's estimate, by order.
WEIGHT = {2: 8.0, 3: 4.0}
BLOCK_BYTES, SHARD_NGRAMS, FALSE_MATCH_BITS = 5 << 20, 4_000_000, 16
#: Entries of a level between two of its directory.
STEP = 1 << 13
END = np.uint64(0x9E3779B97F4A7C15)  # the hash of the end of a text
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- Elias-Fano -------------------------------------------------------------


class Monotone:
    """A non-decreasing sequence below ``universe``: low bytes, and unary high parts; ``samples`` and ``bits`` are every STEPth value and its bit."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.low, self.high, self.n, self.width = low, high, n, width
        self.samples = self.bits = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> Monotone:
        n = len(values)
        width = min(range(0, 9), key=lambda b: 8 * b * n + n + (universe >> 8 * b))
        values = values.astype("<u8")
        low = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)
        top = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, dtype=np.int64)
        bits = np.zeros(n + int(top[-1] if n else 0) + 1, dtype=np.uint8)
        at = top + np.arange(n)
        bits[at] = 1
        out = cls(low, np.packbits(bits), n, width)
        out.samples, out.bits = values[::STEP].astype(np.int64), at[::STEP].copy()
        return out

    def values(self) -> np.ndarray:
        """All of it, unpacked."""
        return self._part(0, self.n, 0, 8 * len(self.high))

    def _part(self, a: int, b: int, bit: int, end: int) -> np.ndarray:
        """Entries a..b, whose bits stand in bit..end."""
        low = np.zeros((b - a, 8), dtype=np.uint8)
        low[:, : self.width] = np.asarray(self.low[a * self.width : b * self.width]).reshape(b - a, self.width)
        low = low.view("<u8").reshape(-1)
        if self.width == 8:
            return low
        ones = np.flatnonzero(np.unpackbits(self.high[bit >> 3 : (end >> 3) + 1])) + (bit >> 3 << 3)
        first = np.searchsorted(ones, bit)
        return low | (ones[first : first + b - a] - np.arange(a, b)).astype("<u8") << np.uint64(8 * self.width)

    def _steps(self, step: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray]]:
        """For each step in an ascending list: where it stands there, its first place, and its entries."""
        cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(step)] if len(step) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = int(step[a])
            end = int(self.bits[k + 1]) if k + 1 < len(self.bits) else 8 * len(self.high) - 1
            yield slice(a, b), k * STEP, self._part(k * STEP, min(self.n, (k + 1) * STEP), int(self.bits[k]), end).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The entries at ascending places."""
        out = np.empty(len(at), dtype=np.int64)
        for where, first, entries in self._steps(at // STEP):
            out[where] = entries[at[where] - first]
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where each of ascending numbers stands, -1 if it doesn't."""
        out, step = np.full(len(x), -1, dtype=np.int64), np.searchsorted(self.samples, x, side="right") - 1
        below = int(np.searchsorted(step, 0))  # before the first entry
        for where, first, entries in self._steps(step[below:]):
            ask = x[below:][where]
            place = np.searchsorted(entries, ask)
            hit = place < len(entries)
            hit[hit] = entries[place[hit]] == ask[hit]
            out[below:][where][hit] = first + place[hit]
        return out

    def pack(self) -> bytes:
        return (self.n << 4 | self.width).to_bytes(6, "little") + len(self.high).to_bytes(6, "little") + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[Monotone, memoryview]:
        head, size = int.from_bytes(data[:6], "little"), int.from_bytes(data[6:12], "little")
        n, width = head >> 4, head & 15
        a, b = 12 + n * width, 12 + n * width + size
        return cls(np.frombuffer(data[12:a], np.uint8), np.frombuffer(data[a:b], np.uint8), n, width), data[b:]


def packed_numbers(*parts: np.ndarray) -> bytes:
    """Numbers from 0, each part in the fewest bytes that hold its largest, pressed together, after the size of that and
    each part's length and width."""
    widths = [next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w) for x in parts]
    small = zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip(parts, widths, strict=True)))
    return b"".join(x.to_bytes(5, "little") for x in (len(small), *(len(x) << 4 | w for x, w in zip(parts, widths, strict=True)))) + small


def unpacked_numbers(data: memoryview, parts: int = 1) -> tuple:
    """So many parts, and what follows them."""
    size, *heads = [int.from_bytes(data[i : i + 5], "little") for i in range(0, 5 * parts + 5, 5)]
    a = 5 * parts + 5
    flat, out = memoryview(zstandard.ZstdDecompressor().decompress(data[a : a + size])), []
    for head in heads:
        n, width = head >> 4, head & 15
        out.append(np.frombuffer(flat[: n * width], dtype=f"<u{width}").astype(np.int64))
        flat = flat[n * width :]
    return *out, data[a + size :]


# --- blocks of texts --------------------------------------------------------


def packed_blocks(docs: DataFrame, holdout: int) -> DataFrame:
    """(block, ids, none, train, sizes, data, words): texts in blocks of about BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        rows: list[tuple] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal made, rows, held
            texts = [t for _, _, t in rows]
            cols = [
                [part << 32 | made], [np.array([i or 0 for i, _, _ in rows], dtype="<i8").tobytes()], [bytes(i is None for i, _, _ in rows)], [bytes(t for _, t, _ in rows)],
                [np.array(list(map(len, texts)), dtype="<i8").tobytes()], [press.compress(b"".join(texts))], [sum(len(t.split()) + 1 for t in texts)],
            ]
            made, rows, held = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *[pa.binary()] * 5, pa.int64()], strict=True)], names=["block", "ids", "none", "train", "sizes", "data", "words"])

        for batch in batches:
            for i, train, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((i, train, text or b""))
                held += len(text or b"") + 64
                if held >= BLOCK_BYTES:
                    yield block()
        if rows:
            yield block()

    chosen = docs.select(F.col("doc_id").cast("bigint"), ~held_out(holdout), F.col("text").cast("string").cast("binary"))
    return chosen.mapInArrow(run, "block long, ids binary, none binary, train binary, sizes binary, data binary, words long")


def numbered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys (of so many bits), each key's number among them, and the place of one of each."""
    place = max(1, (len(key) - 1).bit_length())
    if bits + place <= 64:  # sorted together with the places, which is much faster
        both = np.sort(key.astype(np.uint64) << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
        ranked, order = both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int64)
    else:
        order = np.argsort(key)
        ranked = key[order].astype(np.uint64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    own = np.empty(len(key), dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    return ranked[new], own, order[new]


class Block:
    """Tokens of a block's texts as word numbers from 1 (0: an end), and the distinct n-grams of each order.

    The n-grams of two and three words are numbered in the order of their words: ``grams``
    has, for each, the number of all but its last word (a word or a pair), its last
    word, and the number of all but its first.  ``own`` numbers the n-gram that ends at
    each token (-1 where the text is too short).
    """

    def __init__(self, row: dict, bits: int):
        data = zstandard.ZstdDecompressor().decompress(row["data"])
        sizes = np.frombuffer(row["sizes"], dtype="<i8")
        ends = np.cumsum(sizes).tolist()
        self.ids = [None if none else i for i, none in zip(np.frombuffer(row["ids"], dtype="<i8").tolist(), row["none"], strict=True)]
        train = np.frombuffer(row["train"], np.uint8)
        number: dict[bytes, int] = defaultdict(count(1).__next__)
        flat: list[int] = []
        first, at = [], 0
        for end in ends:
            first.append(len(flat))
            flat += map(number.__getitem__, data[at:end].lower().split())
            flat.append(0)
            at = end
        words = np.concatenate([[END], np.fromiter(map(xxhash.xxh64_intdigest, number), dtype=np.uint64, count=len(number))]).astype(np.uint64)
        self.token, self.first = np.array(flat, dtype=np.int32), np.array(first, dtype=np.int64)
        self.length = np.diff(np.append(self.first, len(flat)))
        self.train = np.repeat(train, self.length) > 0
        self.place = (np.arange(len(flat)) - np.repeat(self.first, self.length)).astype(np.int32)
        self.size, self.own, self.grams = len(words), [self.token], []
        full, self.hash = words, [words]
        for n in range(2, ORDER + 1):
            here = np.flatnonzero(self.place >= n - 1)
            before = self.own[-1][here - 1].astype(np.int64)
            key, own, at = numbered(before * self.size + self.token[here], (max(1, len(full)) * self.size).bit_length())
            context, last = np.divmod(key.astype(np.int64), self.size)
            self.grams.append((context, last, self.own[-1][here[at]]))
            self.own.append(np.full(len(flat), -1, dtype=np.int32))
            self.own[-1][here] = own
            full = mixed(full[context], words[last])
            self.hash.append(full >> np.uint64(64 - bits))
        self.bits = [64] + [bits] * (ORDER - 1)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the n-grams, and each n-gram's place among them."""
        keys, own, _ = numbered(self.hash[n - 1], self.bits[n - 1])
        return keys, own

    def counts(self, n: int) -> np.ndarray:
        """How often each n-gram occurs in the training texts of the block."""
        own = self.own[n - 1]
        return np.bincount(own[self.train & (own >= 0)], minlength=len(self.hash[n - 1]))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ a >> np.uint64(29)) * _MIX + b * _MIX2
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(31)


def _range(n: int, shard: int, shards: int, bits: int) -> int:
    """The smallest hash of a shard."""
    return -(-(shard << (64 if n == 1 else bits)) // shards)


def requests(blocks: DataFrame, shards: int, bits: int) -> DataFrame:
    """(block, shard, data): each block's distinct n-grams and training counts in that part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, bits)
                out, numbers, some = [bytearray() for _ in range(shards)], [[] for _ in range(shards)], np.zeros(shards, dtype=bool)
                for n in range(1, ORDER + 1):
                    keys, own = block.distinct(n)
                    counts = np.bincount(own, block.counts(n), minlength=len(keys)).astype(np.int64)
                    starts = [_range(n, s, shards, bits) for s in range(shards + 1)]
                    cuts = np.append(np.searchsorted(keys, np.array(starts[:-1], dtype=np.uint64)), len(keys)).tolist()
                    some |= np.diff(cuts) > 0
                    for s in range(shards):
                        a, b = cuts[s], cuts[s + 1]
                        out[s] += Monotone.of(keys[a:b] - np.uint64(starts[s]), starts[s + 1] - starts[s]).pack()
                        numbers[s].append(counts[a:b])
                kept = np.flatnonzero(some).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(kept)), pa.array(kept, pa.int32()), pa.array([bytes(out[s] + packed_numbers(*numbers[s])) for s in kept], pa.binary())], names=["block", "shard", "data"])

    return blocks.mapInArrow(run, "block long, shard int, data binary")


def totals(asked: DataFrame) -> DataFrame:
    """(block, shard, data, words, tokens): the corpus counts of what each block asked for; a shard's distinct
    training words and tokens stand in its first row."""

    def run(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        keys, counts = [[] for _ in range(ORDER)], [[] for _ in range(ORDER)]
        for data in map(memoryview, group.column("data").to_pylist()):
            for parts in keys:
                m, data = Monotone.unpack(data)
                parts.append(m)
            for parts, part in zip(counts, unpacked_numbers(data, ORDER)[:ORDER], strict=True):
                parts.append(part)
        out: list[list] = [[] for _ in blocks]
        words = tokens = 0
        for n in range(ORDER):
            _, own, _ = numbered(np.concatenate([m.values() for m in keys[n]]), 64)
            sums = np.zeros(int(own.max(initial=-1)) + 1, dtype=np.int64)
            np.add.at(sums, own, np.concatenate(counts[n]))
            if n == 0:
                words, tokens = int((sums > 0).sum()), int(sums.sum())
            for parts, part in zip(out, np.split(sums[own], np.cumsum([m.n for m in keys[n]])[:-1]), strict=True):
                parts.append(part)
        k = len(blocks)
        return pa.table({
            "block": pa.array(blocks, pa.int64()), "shard": group.column("shard"), "data": pa.array([packed_numbers(*x) for x in out], pa.binary()),
            "words": pa.array([words] + [0] * (k - 1), pa.int64()), "tokens": pa.array([tokens] + [0] * (k - 1), pa.int64()),
        })

    return asked.groupBy("shard").applyInArrow(run, "block long, shard int, data binary, words long, tokens long")


# --- the trie of a block ----------------------------------------------------


class Quantised:
    """Numbers as LEVELS equal steps between their extremes."""

    def __init__(self, x: np.ndarray):
        self.least = float(x.min(initial=0.0))
        self.step = max((float(x.max(initial=0.0)) - self.least) / (LEVELS - 1), 1e-12)
        self.codes = np.round((x - self.least) / self.step).astype(np.uint16)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[at]


class Trie:
    """Words 0..V-1 below the root; successors of words; successors of pairs.

    ``one``: counts of the words.  ``two``: first word, second word and count of the
    seen pairs, sorted.  ``three``: first pair, second pair (as places in ``two``) and
    count of the seen triples, sorted.
    """

    def __init__(self, one: np.ndarray, two: tuple, three: tuple, words: int, tokens: int):
        V = self.size = len(one)
        p1 = (one + 0.5) / (tokens + 0.5 * (words + 1))
        a, b, c2 = two
        pointers = np.searchsorted(a, np.arange(V + 1))
        self.level2, self.pointers2 = Monotone.of(a * V + b, max(1, V * V)), Monotone.of(pointers, len(a) + 1)
        p2 = (c2 + WEIGHT[2] * p1[b]) / (one[a] + WEIGHT[2])
        node, suffix, c3 = three
        fan = pointers[b + 1] - pointers[b]
        offsets = np.concatenate([[0], np.cumsum(fan)])
        self.offsets3 = Monotone.of(offsets, int(offsets[-1]) + 1)
        self.level3 = Monotone.of(offsets[node] + suffix - pointers[a[suffix]], int(offsets[-1]) + 1)
        p3 = (c3 + WEIGHT[3] * p2[suffix]) / (c2[node] + WEIGHT[3])
        self.p1, self.p2, self.p3 = Quantised(np.log10(p1)), Quantised(np.log10(p2)), Quantised(np.log10(p3))
        self.back2, self.back3 = Quantised(np.log10(WEIGHT[2] / (one + WEIGHT[2]))), Quantised(np.log10(WEIGHT[3] / (c2 + WEIGHT[3])))

    def mapped(self) -> Trie:
        """The same with all arrays in one memory map, as views of it."""
        parts = [(m, name) for m in (self.level2, self.pointers2, self.offsets3, self.level3) for name in ("low", "high")]
        parts += [(q, "codes") for q in (self.p1, self.p2, self.p3, self.back2, self.back3)]
        arrays = [np.ascontiguousarray(getattr(x, name)) for x, name in parts]
        starts = np.concatenate([[0], np.cumsum([-(-x.nbytes // 16) * 16 for x in arrays])]).tolist()
        area = mmap.mmap(-1, max(1, starts[-1]))
        for (owner, name), x, at in zip(parts, arrays, starts, strict=False):
            area[at : at + x.nbytes] = x.tobytes()
            setattr(owner, name, np.frombuffer(area, dtype=x.dtype, count=x.size, offset=at))
        return self

    def log10(self, pairs: tuple, triples: tuple) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of the last word after the one before, for sorted pairs of words; and after the two before, for
        triples given as first pair, last word and second pair (places in ``pairs``), sorted."""
        a, b = pairs[:2]
        node = self.level2.find(a * self.size + b)
        seen = node >= 0
        two = self.p1[b] + self.back2[a]
        two[seen] = self.p2[node[seen]]
        relative = node - self.pointers2[a]
        first, _, second = triples
        context = node[first]
        three = two[second]
        known = np.flatnonzero(context >= 0)
        three[known] += self.back3[context[known]]
        both = known[seen[second[known]]]
        found = self.level3.find(self.offsets3[context[both]] + relative[second[both]])
        hit = found >= 0
        three[both[hit]] = self.p3[found[hit]]
        return two, three


def scored(block: Block, counts: list[np.ndarray], words: int, tokens: int) -> list[list]:
    """Columns of the result for a block; ``counts`` are the corpus counts of its distinct n-grams, by order."""
    c1, c2, c3 = (counts[n - 1][block.distinct(n)[1]] for n in range(1, ORDER + 1))
    token, place = block.token, block.place
    unigram = np.log10((c1 + 0.5) / (tokens + 0.5 * (words + 1)))
    (a, b, _), (first, _, second) = pairs, triples = block.grams
    use = c2 > 0
    number = np.cumsum(use) - 1
    good = (c3 > 0) & use[first] & use[second]
    trie = Trie(c1, (a[use], b[use], c2[use]), (number[first[good]], number[second[good]], c3[good]), words, tokens).mapped()
    two, three = trie.log10(pairs, triples)
    each = trie.p1[token]
    for n, part in ((2, two), (3, three)):
        at = np.flatnonzero(place == 1 if n == 2 else place >= 2)
        each[at] = part[block.own[n - 1][at]]
    total = lambda x: np.add.reduceat(x, block.first).tolist()
    held = (~block.train[block.first]).tolist()
    return [block.ids, held, block.length.tolist(), total((c1[token] > 0).astype(np.int64)), [tokens] * len(held), total(unigram[token]), total(each)]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def score_documents(docs: DataFrame, holdout: int = 1) -> DataFrame:
    """Scores every document by a model of those whose fold isn't ``holdout``."""
    spark = docs.sparkSession
    blocks = written(packed_blocks(docs, holdout), "lm-blocks")
    size = blocks.agg(F.sum("words")).head()[0] or 0
    bits = min(64, max(24, math.ceil(math.log2(ORDER * size + 2)) + FALSE_MATCH_BITS))
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), ORDER * size // SHARD_NGRAMS)
    replies = written(totals(requests(blocks, shards, bits)), "lm-totals", free=True)  # the requests are the largest shuffle
    stats = replies.agg(F.sum("words"), F.sum("tokens")).head()
    words, tokens = stats[0] or 0, stats[1] or 0

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        made: list[list] = [[] for _ in _NAMES]
        for row in texts.to_pylist():
            data = [x for _, x in sorted(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True))]
            counts = [np.concatenate(x) for x in zip(*(unpacked_numbers(memoryview(x), ORDER)[:ORDER] for x in data), strict=True)]
            for col, new in zip(made, scored(Block(row, bits), counts, words, tokens), strict=True):
                col += new
        return pa.table([pa.array(c, t) for c, t in zip(made, _TYPES, strict=True)], names=_NAMES)

    return blocks.groupBy("block").cogroup(replies.select("block", "shard", "data").groupBy("block")).applyInArrow(run, RESULT)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
