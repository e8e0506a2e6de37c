"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The distinct pre-tokens of a slice of texts stand one after the other in one array,
each symbol linked to its neighbours.  Pairs of neighbouring symbols wait in one
bucket per merge rank, as arrays of the left positions in the linked list.  A
two-level bitmap says which buckets are filled: find-first-set on the summary word,
then on the leaf word, gives the smallest waiting rank.  The whole bucket is merged
at once, from the left where its pairs overlap; an entry whose pair has changed since
it was queued is stale and skipped.  A pre-token of n bytes takes O(n log n), however
long it is, and equal ranks of all pre-tokens share a step.

Merging a bucket at once is the same as one pair after the other, unless a merge makes
a pair of a smaller rank than its own (``Merges.encode`` notices).  Such a pre-token is
encoded again alone by ``bpe``, one pair at a time with the same queue.

Results: a null text is encoded as the empty one (no ids, digests of nothing);
invalid UTF-8 is read as U+FFFD first.  Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from versograph.llm.common import map_texts, table

LEAF = 8  # a leaf word of the bitmap has 2**LEAF bits
LOW = (1 << LEAF) - 1
#: Bytes or characters of a key from which on it is not cached beyond its slice.
SHORT = 64
#: Bytes of the per-worker cache beyond which it is emptied after a slice.
CACHE = 96 << 20
#: Bytes of text whose new pre-tokens are encoded together.
SLICE = 8 << 20
_NONE, _MERGED = 1 << 30, -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Queue:
    """The waiting ranks: a bucket each, and two levels of bits over the filled ones."""

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.leaves: dict[int, int] = {}
        self.summary = 0

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, to be added to."""
        own = self.buckets.get(rank)
        if own is None:
            own = self.buckets[rank] = []
            word = rank >> LEAF
            self.leaves[word] = self.leaves.get(word, 0) | 1 << (rank & LOW)
            self.summary |= 1 << word
        return own

    def first(self) -> int:
        """The smallest waiting rank."""
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.leaves[word]
        return word << LEAF | (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> list:
        """Takes a rank's bucket out."""
        word = rank >> LEAF
        left = self.leaves[word] ^ 1 << (rank & LOW)
        if left:
            self.leaves[word] = left
        else:
            del self.leaves[word]
            self.summary ^= 1 << word
        return self.buckets.pop(rank)


def bpe(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token, a pair at a time; buckets are heaps of positions, so equal ranks merge from the left."""
    n, get, queue = len(piece), ranks.get, Queue()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [-1] * n  # the rank of the symbol at i joined with the next one

    def wait(i: int) -> None:
        k = after[i]
        pair[i] = get(piece[i : after[k]], -1) if k < n else -1
        if pair[i] >= 0:
            heappush(queue.bucket(pair[i]), i)

    for i in range(n):
        wait(i)
    while queue.summary:
        r = queue.first()
        i = heappop(queue.buckets[r])
        if not queue.buckets[r]:
            queue.close(r)
        if pair[i] != r:
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = -1
        if k < n:
            before[k] = i
        wait(i)
        if before[i] >= 0:
            wait(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Merges:
    """The ranks as a sorted table of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values(), default=0) + 2  # ids, and one for the gaps between pre-tokens
        self.gap = self.base - 1
        made = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    made[a * self.base + b] = rank
        self.keys = np.array(sorted(made), dtype=np.int64)
        self.made = np.array([made[k] for k in self.keys.tolist()] + [_NONE], dtype=np.int64)
        self.keys_end = np.append(self.keys, np.int64(1 << 62))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def pair(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """The rank that ids a and b make together, _NONE if there is none."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys_end[at] == key, self.made[at], _NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``pieces`` in a row and where those of each piece end, by one queue for all."""
        if not pieces:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.frombuffer(b"\0".join([b"", *pieces, b""]), dtype=np.uint8)
        starts = np.cumsum(sizes + 1) - sizes
        sym = self.single[flat]
        sym[starts - 1] = self.gap
        sym[-1] = self.gap
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1], before[0] = 0, n - 1
        pair = np.full(n, _NONE, dtype=np.int64)
        pair[:-1] = self.pair(sym[:-1], sym[1:])
        queue, again = Queue(), []
        self._wait(queue, np.flatnonzero(pair < _NONE), pair)
        while queue.summary:
            r = queue.first()
            got = queue.close(r)
            at = got[0] if len(got) == 1 else np.concatenate(got)
            at = at[pair[at] == r]  # the others are stale
            if not len(at):
                continue
            j = after[at]
            old = None
            if (pair[j] == r).any():  # pairs that overlap, or touch: every other one of a run merges
                at.sort()
                j = after[at]
                linked = np.flatnonzero(np.append(True, j[:-1] != at[1:]))
                run = np.arange(len(at)) - np.repeat(linked, np.diff(np.append(linked, len(at))))
                at = at[run % 2 == 0]
                j = after[at]
                old = sym[after[j]]
            k = after[j]
            pair[at], pair[j], sym[at], sym[j] = _MERGED, _NONE, r, -1
            after[at], before[k] = k, at
            p = before[at]
            p = p[pair[p] != _MERGED]
            pair[at] = self.pair(r, sym[k])
            if len(p):
                pair[p] = self.pair(sym[p], r)
                at = np.concatenate([at, p])
            rank = pair[at]
            if old is not None and (self.pair(r, old) < r).any():
                again.append(at)
            new = rank < _NONE
            at, rank = at[new], rank[new]
            if len(at):
                if rank.min() < r:
                    again.append(at[rank < r])
                self._wait(queue, at, pair)
        ids = sym[sym >= 0]
        edge = np.flatnonzero(ids == self.gap)
        ends = edge[1:] - np.arange(1, len(edge))
        ids = ids[ids != self.gap]
        if again:
            rows = np.split(ids, ends[:-1])
            for i in np.unique(np.searchsorted(starts, np.concatenate(again), side="right") - 1).tolist():
                rows[i] = np.array(bpe(pieces[i], self.ranks), dtype=np.int64)
            ids, ends = np.concatenate(rows), np.cumsum(list(map(len, rows)))
        return ids, ends

    @staticmethod
    def _wait(queue: Queue, at: np.ndarray, pair: np.ndarray) -> None:
        if len(at) <= 1:
            for i in at.tolist():
                queue.bucket(int(pair[i])).append(at)
            return
        rank = pair[at]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
        for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            queue.bucket(r).append(at[a:b])


class Codec:
    """Encodes and decodes whole texts; one per Python worker.

    The cache numbers pre-tokens (bytes) and chunks (str); ``shown`` and ``decoded``
    have the ids of each, as decimal text with a comma after every one, and the bytes
    that these ids decode to.
    """

    def __init__(self, rank_file: str, pattern: str):
        self.ranks = load_ranks(rank_file)
        self.merges = Merges(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.names = [b"%d," % i for i in range(len(self.bytes_of))]
        self.sizes = [np.array([*map(len, x), 0]) for x in (self.names, self.bytes_of)]
        self.findall = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Empties the cache, as the worker may serve other operators from now on."""
        self.number: dict[bytes | str, int] = {}
        self.shown: list[bytes] = []
        self.decoded: list[bytes] = []
        self.held = 0

    def _pieces(self, chunk: str) -> list[bytes] | None:
        """The pre-tokens of a space and what follows it up to the next space; None where that space may join another match."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk.isalpha():
            return [b" " + chunk.encode()]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [b" " + chunk[:-1].encode(), chunk[-1].encode()]
        return [x.encode() for x in self.findall(" " + chunk)]

    def _row(self, text: str, new: list[list[bytes]]) -> np.ndarray:
        """The text as numbers of the cache; what is not in it gets the next number and puts its pre-tokens in ``new``.

        A space between two other characters always starts a match, so what lies
        between such spaces can be cached; -1 stands for what can't.
        """
        number = self.number
        first, *chunks = text.split(" ")
        if chunks and first and not first[-1].isspace():
            found = list(map(number.get, chunks))
            if None in found:
                for i, n in enumerate(found):
                    if n is None:
                        x = chunks[i]
                        n = number.get(x)
                        if n is None:
                            pieces = self._pieces(x)
                            n = -1 if pieces is None else len(self.shown) + len(new)
                            number[x] = n
                            if n >= 0:
                                new.append(pieces)
                        found[i] = n
            if -1 not in found:
                return np.concatenate([self._plain(first, new), np.array(found, dtype=np.int32)])
        return self._plain(text, new)

    def _plain(self, text: str, new: list[list[bytes]]) -> np.ndarray:
        number, found = self.number, []
        for x in self.findall(text):
            key = x.encode()
            n = number.get(key)
            if n is None:
                n = number[key] = len(self.shown) + len(new)
                new.append([key])
            found.append(n)
        return np.array(found, dtype=np.int32)

    def _learn(self, new: list[list[bytes]]) -> None:
        """Encodes the pre-tokens of new entries together and adds the entries."""
        place: dict[bytes, int] = {}
        own = [[place.setdefault(x, len(place)) for x in pieces] for pieces in new]
        pieces, whole = list(place), list(map(self.ranks.get, place))
        ids, ends = self.merges.encode([x for x, r in zip(pieces, whole, strict=True) if r is None])
        for side, text, size in ((self.shown, self.names, self.sizes[0]), (self.decoded, self.bytes_of, self.sizes[1])):
            flat = b"".join(map(text.__getitem__, ids.tolist()))
            cuts = np.append(0, np.cumsum(size[ids]))[np.append(0, ends)].tolist()
            merged = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            made = [next(merged) if r is None else text[r] for r in whole]
            side += [made[x[0]] if len(x) == 1 else b"".join([made[i] for i in x]) for x in own]

    def entries(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids, as text with commas, and the decoded bytes of each text."""
        new: list[list[bytes]] = []
        rows = [self._row(t, new).tobytes() for t in texts]
        before = len(self.shown)
        self._learn(new)
        out = []
        for side in (self.shown, self.decoded):
            get = side.__getitem__
            out.append([b"".join(map(get, np.frombuffer(r, dtype=np.int32).tolist())) for r in rows])
            self.held += sum(map(len, side[before:]))
        self.held += 250 * len(new)
        if self.held > CACHE:
            self.forget()
        elif new and max(map(len, self.shown[before:])) > 8 * SHORT:
            for key in [k for k, n in self.number.items() if n >= before and len(k) > SHORT]:
                del self.number[key]
        return [x[:-1] for x in out[0]], out[1]

    def encode(self, text: str) -> list[int]:
        return numbers(self.entries([text])[0][0])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def numbers(shown: bytes) -> list[int]:
    return list(map(int, shown.split(b","))) if shown else []


@functools.lru_cache(2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, if asked for) and the SHA-256 of the ids and of the decoded bytes."""

    def run(texts: list[bytes]) -> list:
        shown, decoded = codec(rank_file, pattern).entries([t.decode("utf-8", "replace") for t in texts])
        n = [a.count(b",") + 1 if a else 0 for a in shown]
        rows = [[numbers(a) for a in shown]] if ids else []
        return [n, *rows, *[[hashlib.sha256(x).hexdigest() for x in side] for side in (shown, decoded)]]

    columns = "n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, run, columns, size=SLICE, done=lambda: codec(rank_file, pattern).forget())


def public_codec() -> tuple[str, str]:
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *public_codec(), ids=False)
