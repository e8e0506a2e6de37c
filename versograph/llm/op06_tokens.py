"""Token counts of a unigram segmentation, by dynamic programming shared over a trie.

A text's pre-tokens are its words (runs without the six ASCII space characters),
each with the word mark in front.  The distinct ones of a run of texts are put in a
trie, and the best segmentation into vocabulary pieces is scored once per node:
a node's best score is the best, over pieces that end there, of the score of the
ancestor where the piece begins plus the piece's own.  As a node stands for all
pre-tokens with that prefix, a shared prefix is scored once.  A node where a
pre-token ends stores its number of tokens; a text's count is the sum over its
pre-tokens.

The vocabulary file at hand is of a merge model, whose pieces are ordered but have no
probabilities, and tokenizers are not trained here.  So the pieces' probabilities are
those of Zipf's law, 1 / (r H) for the piece at rank r, with H the harmonic sum over the
vocabulary.  A segmentation's score is then the logarithm of its unigram probability.

A character in no piece costs the lowest score less ``PENALTY`` and stands as one
token per UTF-8 byte.  Among equally good segmentations the one with fewer tokens
counts.  Results: null and empty texts have no tokens; invalid UTF-8 is read as
U+FFFD; repeated rows are counted each.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession

from versograph.llm.common import map_texts, table

MARK, PENALTY = "▁", 10.0
#: Bytes of text whose distinct pre-tokens share a trie.
RUN_BYTES = 12 << 20


class Vocabulary:
    def __init__(self, pieces: dict[str, float]):
        self.by_length: list[tuple[int, dict[str, float]]] = []
        lengths: dict[int, dict[str, float]] = {}
        for p, s in pieces.items():
            lengths.setdefault(len(p), {})[p] = s
        self.by_length = sorted(lengths.items())
        self.singles = lengths.get(1, {})
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        #: Pieces by their last character, so that few lengths are tried at a node.
        self.ends: dict[str, list[tuple[int, dict[str, float]]]] = {}
        for n, own in self.by_length:
            for p, s in own.items():
                at = self.ends.setdefault(p[-1], [])
                if not at or at[-1][0] != n:
                    at.append((n, {}))
                at[-1][1][p] = s

    def count(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word (the mark is put in front here).

        Sorted words visit the trie depth first: the columns up to the common prefix
        with the word before are that node's ancestors and stay as they are.
        """
        ends, singles, unknown = self.ends, self.singles, self.unknown
        out: dict[str, int] = {}
        before, best, tokens = "", [0.0], [0]
        for word in sorted(set(words)):
            w = MARK + word
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for d in range(shared + 1, len(w) + 1):
                c = w[d - 1]
                if c in singles:
                    top, n = -1e300, 0
                else:
                    top, n = best[d - 1] + unknown, tokens[d - 1] + len(c.encode())
                for size, own in ends.get(c, ()):
                    if size > d:
                        break
                    s = own.get(w[d - size : d])
                    if s is not None:
                        s += best[d - size]
                        k = tokens[d - size] + 1
                        if s > top or s == top and k < n:
                            top, n = s, k
                best.append(top)
                tokens.append(n)
            out[word] = tokens[len(w)]
            before = w
        return out


def zipf(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces, the likeliest first."""
    whole = math.log(sum(1 / r for r in range(1, len(pieces) + 1))) if pieces else 0.0
    return {p: -math.log(r) - whole for r, p in enumerate(pieces, 1)}


@functools.lru_cache(2)
def vocabulary(model_file: str) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model, with log-probabilities by Zipf's law in the order of the file's scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ordinary = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i) or m.is_byte(i))]
    return Vocabulary(zipf([m.id_to_piece(i) for i in sorted(ordinary, key=lambda i: (-m.get_score(i), i))]))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words and n_tokens."""

    def run(texts: list[bytes]) -> list:
        split = [t.split() for t in texts]
        distinct = set().union(*split)
        shown = {w: w.decode("utf-8", "replace") for w in distinct}
        got = vocabulary(model_file).count(list(shown.values()))
        counts = {w: got[s] for w, s in shown.items()}
        return [[len(x) for x in split], [sum(map(counts.__getitem__, x)) for x in split]]

    return map_texts(docs, run, "n_words long, n_tokens long", size=RUN_BYTES)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))
