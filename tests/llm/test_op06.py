import math
import random

import public_tokenizers
import pytest

from tests.llm import helpers
from versograph.llm import op06_tokens as op


def brute(word, pieces, unknown):
    """Best (score, tokens) over all segmentations."""
    w = op.MARK + word
    best = [(0.0, 0)]
    for d in range(1, len(w) + 1):
        c = w[d - 1]
        options = [] if c in pieces else [(best[d - 1][0] + unknown, -(best[d - 1][1] + len(c.encode())))]
        options += [(best[a][0] + pieces[w[a:d]], -(best[a][1] + 1)) for a in range(d) if w[a:d] in pieces]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


@pytest.mark.parametrize("seed", range(5))
def test_shared_scores_match_brute_force(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abcé" + op.MARK) for _ in range(rng.randint(1, 4))): -float(rng.randint(0, 9)) for _ in range(40)}
    v = op.Vocabulary(pieces)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert v.count(words) == {w: brute(w, pieces, v.unknown) for w in words}


def test_documents(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = op.vocabulary(path)
    pieces = {p: s for _, own in v.by_length for p, s in own.items()}
    got = op.count_tokens(helpers.table(spark), path).collect()
    assert len(got) == len(helpers.ODD)
    for r, (doc_id, text, *_) in zip(got, helpers.ODD, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        counts = {w: brute(w, pieces, v.unknown) for w in set(words) if len(w) < 1000}
        if all(w in counts for w in words):
            assert (r.doc_id, r.n_words, r.n_tokens) == (doc_id, len(words), sum(counts[w] for w in words))
    assert op.count_tokens(helpers.table(spark, []), path).count() == 0


def test_zipf_scores_are_log_probabilities():
    v = op.zipf(["a", "b", "cd"])
    assert sum(math.exp(s) for s in v.values()) == pytest.approx(1) and v["a"] - v["cd"] == pytest.approx(math.log(3))
    whole = op.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert sum(math.exp(s) for _, own in whole.by_length for s in own.values()) == pytest.approx(1)
