"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters (A-Z lowered), digits and characters beyond ASCII.
Every pair of neighbouring words of a test item is a seed; a text holds it where the
two words stand next to each other or with one word in between.  Items of up to
``GRAM`` words are too short to be known by a part: they are their own only seed and
must be whole, although fewer of their words may reach ``MIN_SCORE``.  A first pass
over all documents counts in how many each seed occurs; an item leaves out the
commonest of its seeds, no more than half of the hits that a copy must have, so no
copy can be missed.  A second pass joins the kept seeds with the training texts,
takes the parts of the text where enough of them lie near each other, and aligns these
with the item word by word.  The score is the best local alignment against that of the
item with itself; from ``MIN_SCORE`` on the text holds the item, be it an exact,
edited or paraphrased copy.

How many hits a copy must have: let an item have n words, and an alignment m matches,
d item words replaced or left out, and x words put in.  From score >= n / 2 follows
x <= 2m - n - d, hence d <= n / 3 and a span of at most 2n words of the text.  Of the
m - 1 steps from match to match at most d pass over an item word and at most x / 2
over two words or more put in; the rest, at least n / 2 - 1 - d / 2 >= n / 3 - 1, are
hits of different seeds at different places.  This holds for the weights below.

Test items are handed to the tasks in blocks of at most ``BLOCK_CHARS`` characters,
each against all documents; texts are never shuffled.  A longer item is a block of its
own; with more than 1.3 million distinct words it is refused with an error.

Results: null texts count as empty and hold nothing; items without words are in
no document; each document and item appear once, with the best score (the leftmost
of equals).  Rows repeated in ``documents`` give repeated pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.llm.common import DOCUMENT_COLUMNS, map_texts, slices, table

GRAM, MIN_SCORE = 3, 0.5
PAIRS = 0  # in place of the length of a run: pairs of words at distance 1 or 2
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
BLOCK_CHARS, BATCH, CELLS, SLICE_BYTES = 4_000_000, 512, 1 << 18, 4 << 20
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
WORDS_ONLY = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS_ONLY).split()


class Items:
    """A block of test items: words as numbers from 1, and the seeds of each."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        rows = [(i, w) for i, t in rows if (w := words(t))]
        self.ids = [i for i, _ in rows]
        known = sorted(set(chain.from_iterable(w for _, w in rows)))
        self.number = {w: k + 1 for k, w in enumerate(known)}
        self.base = len(known) + 1
        if self.base ** GRAM * (GRAM + 1) >= 1 << 63:  # only with an item that is itself larger than a block
            raise ValueError(f"a block of test items has {len(known)} distinct words, too many for keys of {GRAM} words")
        self.words = [np.array([self.number[x] for x in w], dtype=np.int64) for _, w in rows]
        self.length = np.array(list(map(len, self.words)), dtype=np.int64)
        self.must = np.maximum(1, -(-self.length // 3) - 1)  # hits that a copy has at least
        seeds: Counter = Counter()
        for k, w in enumerate(self.words):
            if len(w) <= GRAM:
                seeds[len(w), self.key(w), k] += 1
            else:
                seeds.update((PAIRS, self.key(w[o : o + 2]), k) for o in range(len(w) - 1))
        self.seeds = dict(sorted(seeds.items()))  # (length of run or PAIRS, key, item): times in the item

    def key(self, run: np.ndarray) -> int:
        out = 0
        for x in run.tolist():
            out = out * self.base + x
        return out

    def places(self, without: set[tuple[int, int]] = frozenset()) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of run: sorted keys and items of the seeds (those not in ``without``)."""
        out = {}
        for g in range(PAIRS, GRAM + 1):
            own = [s for s in self.seeds if s[0] == g and (k_of(s), s[2]) not in without]
            if own:
                out[g] = tuple(np.array([s[i] for s in own], dtype=np.int64) for i in (1, 2))
        return out

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as numbers (0: in no item), a -1 after each text; and where each text begins."""
        get, found, begins, n = self.number.get, [], [], 0
        for t in texts:
            w = words(t)
            begins.append(n)
            n += len(w) + 1
            found.append(map(get, w, repeat(0)))
            found.append((-1,))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=n), np.array(begins, dtype=np.int64)

    def hits(self, flat: np.ndarray, places: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of run, and each distance of pairs: positions in the texts and the row of ``places`` where that key begins."""
        for g, (keys, _) in places.items():
            for steps in ((1,), (2,)) if g == PAIRS else ((*range(1, g),),):
                far = max(steps, default=0)
                ok = flat[: max(0, len(flat) - far)] > 0
                for o in range(1, far + 1):
                    ok = ok & (flat[o : o + len(ok)] > (0 if o in steps else -1))
                at = np.flatnonzero(ok)
                key = flat[at]
                for o in steps:
                    key = key * self.base + flat[at + o]
                row = np.searchsorted(keys, key)
                hit = (row < len(keys)) & (keys[np.minimum(row, len(keys) - 1)] == key)
                yield g, at[hit], row[hit]


def k_of(seed: tuple) -> int:
    """A seed's key with its length, as one number."""
    return seed[1] * (GRAM + 1) + seed[0]


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``items`` with that row of ``windows``, and the leftmost window position where it ends.

    Rows are padded with numbers that never match.  Gaps cost the same per word, so a
    whole row of the matrix comes from a running maximum.
    """
    n, width = windows.shape
    slope = -GAP * np.arange(width)
    before = np.zeros((n, width + 1))
    best, end = np.zeros(n), np.zeros(n, dtype=np.int64)
    for i in range(items.shape[1]):
        cell = before[:, :-1] + np.where(windows == items[:, i, None], MATCH, MISMATCH)
        np.maximum(cell, before[:, 1:] + GAP, out=cell)
        np.maximum(cell, 0, out=cell)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        before[:, 1:] = cell
        at = cell.argmax(axis=1)
        top = cell[np.arange(n), at]
        better = (top > best) | ((top == best) & (at < end))
        best[better], end[better] = top[better], at[better]
    return best, end


def near(items: Items, places: dict, must: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item, begin and end of the parts of ``flat`` where at least ``must`` hits of an item can be of one alignment."""
    size, codes = len(flat) + 1, [np.zeros(0, dtype=np.int64)]
    for g, at, row in items.hits(flat, places):
        keys, item = places[g]
        count = np.searchsorted(keys, keys[row], side="right") - row
        pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(row, count)
        at = np.repeat(at, count)
        doc = np.searchsorted(begins, at, side="right") - 1
        codes.append((doc * len(items.ids) + item[pick]) * size + at)
    code = np.unique(np.concatenate(codes))
    both, at = np.divmod(code, size)
    item = both % len(items.ids)
    i = np.arange(len(code))
    j = np.minimum(i + must[item] - 1, len(code) - 1)
    span = 2 * items.length[item]
    i = np.flatnonzero((j - i == must[item] - 1) & (both[j] == both) & (at[j] - at <= span))
    both, span, a, b = both[i], span[i], at[j[i]] - span[i], at[i] + span[i]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (both[1:] != both[:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1
    doc, item = np.divmod(both[first], len(items.ids))
    ends = np.append(begins[1:], len(flat)) - 1
    return doc, item, np.maximum(a[first], begins[doc]), np.minimum(b[last], ends[doc])


def found(items: Items, places: dict, must: np.ndarray, texts: list[bytes]) -> list[list[dict]]:
    """For each text: the items it holds, with score and span of words."""
    flat, begins = items.read(texts)
    doc, item, a, b = near(items, places, must, flat, begins)
    out: list[list[dict]] = [[] for _ in texts]
    best: dict[tuple[int, int], tuple] = {}
    by_size = np.lexsort((b - a, items.length[item]))
    at = 0
    while at < len(by_size):
        part = by_size[at : at + BATCH]
        part = part[: max(1, int((np.maximum.accumulate((b - a)[part]) * np.arange(1, len(part) + 1) <= CELLS).sum()))]
        at += len(part)
        it = padded([items.words[k] for k in item[part]], -1)
        win = padded([flat[x:y] for x, y in zip(a[part], b[part], strict=True)], -2)
        score, end = align(it, win)
        score /= items.length[item[part]] * MATCH
        good = np.flatnonzero(score >= MIN_SCORE)
        if len(good):
            _, back = align(padded([items.words[k][::-1] for k in item[part[good]]], -1), padded([flat[a[c] : a[c] + e + 1][::-1] for c, e in zip(part[good], end[good], strict=True)], -2))
            for g, e in zip(good.tolist(), back.tolist(), strict=True):
                c = part[g]
                d, k, shift = int(doc[c]), int(item[c]), int(a[c] - begins[doc[c]])
                stop = shift + int(end[g]) + 1
                entry = (-float(score[g]), stop - 1 - e, stop)
                if (d, k) not in best or entry < best[d, k]:
                    best[d, k] = entry
    for (d, k), (score, start, stop) in sorted(best.items()):
        out[d].append({"item_id": items.ids[k], "score": -score, "first_word": start, "end_word": stop})
    return out


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    size = np.array([len(r) for r in rows])
    out = np.full((len(rows), int(size.max(initial=1)) or 1), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(rows)
    return out


def rare_places(docs: DataFrame, items: Items) -> tuple[dict, np.ndarray]:
    """The seeds that items keep, without the commonest of each by the number of documents that hold them; and the hits that a copy still must have."""
    every = items.places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {g: np.zeros(len(p[0]), dtype=np.int64) for g, p in every.items()}
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                flat, begins = items.read([x or b"" for x in part.column(0).to_pylist()])
                for g, at, row in items.hits(flat, every):
                    doc = np.searchsorted(begins, at, side="right") - 1
                    both = np.unique(doc * len(every[g][0]) + row)
                    totals[g] += np.bincount(both % len(every[g][0]), minlength=len(totals[g]))
        for g, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(every[g][0][at] * (GRAM + 1) + g), pa.array(n[at])], names=["seed", "n"])

    counted = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    rarity = {r.seed: r.n for r in counted.collect()}  # as many rows as the block has seeds, at most
    own: dict[int, list[tuple[int, int, int]]] = {}
    for s, times in items.seeds.items():
        own.setdefault(s[2], []).append((rarity.get(k_of(s), 0), k_of(s), times))
    without, must = set(), items.must.copy()
    for k, seeds in own.items():
        spare = int(must[k]) // 2
        for _, key, times in sorted(seeds, reverse=True):
            if times > spare:
                break
            spare -= times
            must[k] -= times
            without.add((key, k))
    return items.places(without), must


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The test items in blocks of about BLOCK_CHARS characters."""
    chosen = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = chosen.agg(F.sum(F.length("text"))).head()[0] or 0
    count = int(size // BLOCK_CHARS) + 1
    for k in range(count):
        rows = chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect() if count > 1 else chosen.collect()
        items = Items(sorted(((r.item_id, bytes(r.text) if r.text is not None else None) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")))
        if items.seeds:
            yield items


FOUND = "found array<struct<item_id:bigint,score:double,first_word:int,end_word:int>>"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every document that holds an item."""
    parts = []
    for items in item_blocks(benchmark):
        model = docs.sparkSession.sparkContext.broadcast((items, *rare_places(docs, items)))  # a block of items
        parts.append(map_texts(docs, lambda texts, model=model: [found(*model.value, texts)], FOUND))
    if not parts:
        parts.append(map_texts(docs.limit(0), lambda texts: [[[] for _ in texts]], FOUND))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with the columns of documents."""
    out = docs.select(*DOCUMENT_COLUMNS)
    for items in item_blocks(benchmark):
        model = docs.sparkSession.sparkContext.broadcast((items, *rare_places(docs, items)))
        flagged = map_texts(out, lambda texts, model=model: [[bool(x) for x in found(*model.value, texts)]], "__leak boolean", carry=DOCUMENT_COLUMNS)
        out = flagged.where("NOT __leak").drop("__leak")
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
