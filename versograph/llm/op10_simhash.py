"""SimHash near-duplicates by a binary trie self-join.

The set of distinct fingerprints is joined with itself.  A trie over the bits is
traversed in pairs of nodes; a pair carries the number of bits in which its paths
differ and is dropped as soon as that exceeds the budget.  Nodes are ranges of a
sorted array, and a whole level of pairs is expanded at once.

To spread the join, the 64 bits are cut into blocks: with a budget of k, cutting
into k + c blocks leaves at least c blocks equal in any linked pair.  For each
choice of c blocks, the fingerprints that agree there form a bucket, and the trie
below such a root is one unit of work.  c follows from the number of distinct
fingerprints, so that an evenly filled bucket stays small; the links found are the
same for every c.  A bucket above ``BUCKET`` fingerprints is dealt into parts, and
every two parts are joined in a task of their own, so no task holds a large group.

Within a task, linked fingerprints are merged at once, and pairs of nodes that are
already in one class are dropped; a task returns each fingerprint's smallest
partner, never all pairs.  Classes across tasks follow by alternating large-star
and small-star steps over written tables.  A task goes through its units in order and
holds a bounded number of rows; keys with a large share of the rows (a class, a star,
a fingerprint) are joined by ``joined``, not gathered in one task.  A dense bucket of
n fingerprints makes n² / ``BUCKET`` rows, as every two of its parts must be compared.

Results: documents of equal fingerprints are one class; texts without words have
fingerprint zero and are linked like any other.  Null ids count for membership
only; a class without any id has a null component_id.  Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.llm.common import DOCUMENT_COLUMNS, joined, map_texts, stored, table, written

BITS, BUDGET, SHINGLE, SEED = 64, 4, 4, 42
#: Evenly filled buckets stay below EVEN; larger ones than BUCKET are dealt into parts.
EVEN, BUCKET = 500, 2000
#: Pairs of trie nodes expanded at once, and pairs of keys below which two nodes are compared directly.
CHUNK, LEAF = 1 << 19, 16
#: Rows of whole units that a task joins at once.
TASK_ROWS = 200_000
#: Ids of near-duplicates sent to every task when so few are to be dropped.
BROADCAST_DROPS = 500_000


def fingerprint(text: bytes) -> int:
    """The SimHash of 4-word shingles as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(size)
        starts = (ends - size).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(flat[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=False)], dtype=np.uint64)
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(texts: list[bytes]) -> list:
    return [[fingerprint(t) for t in texts]]


class Classes:
    """Union-find over positions 0..n-1 for arrays of pairs; ``root`` always points to the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self._changed()

    def _changed(self) -> None:
        self.border = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])]) if len(self.root) else self.root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root, moved = self.root, False
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y, moved = a[apart], b[apart], x[apart], y[apart], True
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root[:] = up
        if moved:
            self._changed()

    def open(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Which pairs of ranges hold more than one class."""
        one = self.border[a] == self.border[a_end - 1]
        one &= self.border[b] == self.border[b_end - 1]
        return ~(one & (self.root[a] == self.root[b]))


def _below(keys: np.ndarray, level: int, cache: dict) -> np.ndarray:
    """Ones at ``level`` (from the top) before each position of the sorted keys."""
    if level not in cache:
        cache[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - level) & np.uint64(1)).astype(np.int64))])
    return cache[level]


def trie_join(keys: np.ndarray, roots: list[tuple[int, int]], depth: int, classes: Classes, where: np.ndarray, part: np.ndarray | None = None, budget: int = BUDGET) -> None:
    """Merges linked keys in ``classes``.

    ``keys`` is sorted; each root is a range that agrees in its top ``depth`` bits,
    joined with itself.  ``where`` gives a key's number in ``classes``.
    """
    ones: dict[int, np.ndarray] = {}
    first = np.array(roots, dtype=np.int64).reshape(-1, 2)
    local = Classes(len(keys))
    stack = [(depth, first[:, 0], first[:, 1], first[:, 0], first[:, 1], np.zeros(len(first), dtype=np.int64))]
    while stack:
        level, a, ae, b, be, e = stack.pop()
        if len(a) > CHUNK:
            half = len(a) // 2
            stack.append((level, a[half:], ae[half:], b[half:], be[half:], e[half:]))
            stack.append((level, a[:half], ae[:half], b[:half], be[:half], e[:half]))
            continue
        use = local.open(a, ae, b, be)
        a, ae, b, be, e = a[use], ae[use], b[use], be[use], e[use]
        size = (ae - a) * (be - b)
        small = (size <= LEAF) | (level >= BITS)
        if small.any():
            sa, sb, width, count = a[small], b[small], (be - b)[small], size[small]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(width, count)
            i, j = np.repeat(sa, count) + at // width, np.repeat(sb, count) + at % width
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                local.join(i[near], j[near])
        rest = ~small
        if not rest.any():
            continue
        a, ae, b, be, e = a[rest], ae[rest], b[rest], be[rest], e[rest]
        below = _below(keys, level, ones)
        am, bm = ae - (below[ae] - below[a]), be - (below[be] - below[b])
        same = a == b
        out = [
            (a, am, bm, be, e + 1),  # zeros of one with ones of the other
            *[(x[~same] for x in (am, ae, b, bm, e + 1))],  # and the reverse, if they are not one node
            (a, am, b, bm, e),
            (am, ae, bm, be, e),
        ]
        pairs = [np.concatenate(x) for x in zip(*[tuple(x) for x in out], strict=True)]
        good = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)
        stack.append((level + 1, *[x[good] for x in pairs]))
    moved = np.flatnonzero(local.root != np.arange(len(keys)))
    if len(moved):
        classes.join(where[moved], where[local.root[moved]])


def blocks(count: int) -> list[tuple[int, int]]:
    """(offset from the right, width) of ``count`` blocks of the 64 bits."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def scheme(n: int) -> list[tuple[tuple[int, int], ...]]:
    """The choices of blocks for n distinct fingerprints."""
    for c in range(1, 5):
        cut = blocks(BUDGET + c)
        if n <= EVEN << sum(sorted(w for _, w in cut)[:c]) or c == 4:
            return list(combinations(cut, c))
    raise AssertionError


def permuted(keys: np.ndarray, chosen: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, int]:
    """The chosen blocks on top, the other bits below; and the width of the chosen."""
    out, depth = np.zeros_like(keys), 0
    taken = np.zeros(BITS, dtype=bool)
    for offset, width in chosen:
        out = out << np.uint64(width) | keys >> np.uint64(offset) & np.uint64((1 << width) - 1)
        taken[offset : offset + width] = True
        depth += width
    at = 0
    while at < BITS:
        end = at
        while end < BITS and taken[end] == taken[at]:
            end += 1
        if not taken[at]:
            out = out << np.uint64(end - at) | keys >> np.uint64(at) & np.uint64((1 << end - at) - 1)
        at = end
    return out, depth


def joined_task(fp: np.ndarray, choice: np.ndarray, unit: np.ndarray, choices: list) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with a smaller one of their class, over the units of work of one task."""
    known, where = np.unique(fp, return_inverse=True)
    classes = Classes(len(known))
    for c in np.unique(choice):
        own = choice == c
        keys, depth = permuted(fp[own].view(np.uint64), choices[c])
        place, units = where[own], unit[own]
        order = np.lexsort((keys, units))
        keys, place, units = keys[order], place[order], units[order]
        top = keys >> np.uint64(BITS - depth)
        cut = np.flatnonzero((units[1:] != units[:-1]) | (top[1:] != top[:-1])) + 1
        edges = np.concatenate([[0], cut, [len(keys)]])
        roots = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1]
        trie_join(keys, roots, depth, classes, place)
    moved = np.flatnonzero(classes.root != np.arange(len(known)))
    return known[moved], known[classes.root[moved]]


def links(distinct: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u > v: enough links between distinct fingerprints ``fp`` to connect all classes."""
    choices = scheme(n)

    def bits(chosen: tuple[tuple[int, int], ...]) -> F.Column:
        parts = [F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1)) for offset, width in chosen]
        return reduce(lambda x, y: F.shiftleft(x, y[1]).bitwiseOR(y[0]), [(p, w) for p, (_, w) in zip(parts[1:], chosen[1:], strict=True)], parts[0])

    rows = distinct.select("fp", F.posexplode(F.array(*[bits(c) for c in choices])).alias("choice", "key"))
    big = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bucket)
    big = written(big.select("choice", "key", "__n", F.ceil(F.col("__n") / bucket).cast("int").alias("parts")), "simhash-buckets")
    rows = joined(rows, big, ["choice", "key"], n * len(choices), "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(mine, j) * F.col("parts") + F.greatest(mine, j))
    rows = rows.select("fp", "choice", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(each)).alias("pair"))
    rows = rows.select("fp", "choice", F.xxhash64("choice", "key", "pair").alias("unit"))
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // TASK_ROWS)
    dealt = rows.repartition(tasks, "unit").sortWithinPartitions("unit")

    def merged(parts: list) -> pa.RecordBatch:
        u, v = joined_task(*(np.concatenate(x) for x in zip(*parts, strict=True)), choices)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if size >= TASK_ROWS and held:  # what came before the last unit is complete
                cut = int(np.searchsorted(part[2], part[2][-1])) if len(part[2]) else 0
                if cut or held[-1][2][-1] != part[2][-1]:
                    yield merged([*held, [x[:cut] for x in part]])
                    held, size = [], 0
                    part = [x[cut:] for x in part]
            if len(part[0]):
                held.append(part)
                size += len(part[0])
        if held:
            yield merged(held)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of a class except the smallest, with the smallest."""
    edges, drop = stored(edges, "simhash-links")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, drop_least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")).select("u", F.least("u", "m").alias("m"), "__n"), "simhash-least")
        total = 2 * edges.count()
        large, drop_large = stored(joined(both, least, ["u"], total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "simhash-large")
        drop(), drop_least()
        least, drop_least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")), "simhash-least")
        small = joined(large, least, ["u"], total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, drop = stored(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "simhash-classes")
        drop_large(), drop_least()
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).head()
        if now == seen or not now["n"]:
            return edges
        seen = now


def members(distinct: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint that is linked with another, as a written table."""
    found = components(links(distinct.select("fp"), distinct.count()))
    linked = found.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return written(linked.union(found.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()), "simhash-members")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id, __n: its rows) of every distinct fingerprint in ``prints`` (doc_id, fp), as a written table."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("__n")), "simhash-distinct")
    member = members(distinct)
    ids = member.join(distinct, "fp").groupBy("root").agg(F.min("m").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    linked = joined(member, written(ids, "simhash-ids"), ["root"], member.count()).select("fp", "component_id", F.lit(True).alias("linked"))
    found = distinct.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("m")).alias("component_id"), "__n")
    return written(found, "simhash-ids")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    prints = written(map_texts(docs, fingerprints, "fp long"), "simhash-prints")
    made = joined(prints, classes(prints), ["fp"], prints.count())
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of documents: the one with the smallest id (null last), then text.

    The texts are shuffled once, after rows of equal fingerprints have been reduced
    to one in each task.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), *DOCUMENT_COLUMNS)
    rows = map_texts(docs, fingerprints, "fp long", carry=DOCUMENT_COLUMNS)
    one = written(rows.groupBy("fp").agg(F.min(order).alias("d")).select("fp", "d.*"), "simhash-first")
    member = members(one.select("fp"))
    first = member.join(one.select("fp", "none", "doc_id"), "fp")  # both have a row per fingerprint
    keep = first.groupBy("root").agg(F.min(F.struct("none", "doc_id", "fp")).alias("k")).select(F.col("k.fp").alias("fp"))
    drops = written(member.select("fp").join(keep, "fp", "left_anti"), "simhash-drops")
    if drops.count() <= BROADCAST_DROPS:
        drops = F.broadcast(drops)
    return one.join(drops, "fp", "left_anti").select(*DOCUMENT_COLUMNS)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
