import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import helpers
from versograph.llm import op05_bpe

FILE, PATTERN = op05_bpe.public_codec()
CODEC = op05_bpe.Codec(FILE, PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op05_bpe.load_ranks(FILE), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\x1c\x85\xa0aé'sß1²,.!　", max_size=40)))
def test_same_ids_as_library_and_round_trip(text):
    ids = CODEC.encode(text)
    assert ids == TRUE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 5000, "=" * 999 + " x", "é中" * 3000])
def test_very_long_pre_tokens(text):
    assert CODEC.encode(text) == TRUE.encode_ordinary(text)


def test_cache_generations_do_not_change_results(monkeypatch):
    monkeypatch.setattr(op05_bpe, "CACHE", 3)
    c = op05_bpe.Codec(FILE, PATTERN)
    for i in range(40):
        text = " ".join(f"word{j % 7} x{i}" for j in range(20))
        assert c.encode(text) == TRUE.encode_ordinary(text)


def test_rank_file_is_read_as_given():
    with open(FILE, "rb") as f:
        first = f.readline().split()
    assert CODEC.ranks[base64.b64decode(first[0])] == int(first[1])


def test_documents(spark):
    got = op05_bpe.encode_documents(helpers.table(spark), FILE, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(helpers.ODD)
    for r, (doc_id, text, *_) in zip(rows, helpers.ODD, strict=True):
        ids = TRUE.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (doc_id, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark):
    assert op05_bpe.encode_documents(helpers.table(spark, []), FILE, PATTERN).count() == 0


def test_one_queue_for_all_pieces_is_as_one_pair_at_a_time():
    import random

    r = random.Random(5)
    pieces = [bytes(r.choice(b"abcdehilnorst etion") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    pieces += [bytes(r.randrange(256) for _ in range(r.randint(1, 30))) for _ in range(1000)] + [b"a" * n for n in range(1, 40)] + [b"aab" * 30, b"\x00" * 9]
    ids, ends = CODEC.merges.encode(pieces)
    starts = [0, *ends.tolist()]
    for piece, a, b in zip(pieces, starts, ends.tolist(), strict=False):
        assert ids[a:b].tolist() == op05_bpe.bpe(piece, CODEC.ranks)


def test_merges_that_make_a_smaller_rank_are_done_again_alone():
    """Rank 259 (bc) makes abc of rank 257, which must come before the second bc."""
    ranks = {bytes([i]): i for i in range(256)} | {b"cd": 256, b"abc": 257, b"bcbc": 258, b"bc": 259}
    true = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    pieces = [b"abcbc", b"bcabc", b"bcbc", b"abcd", b"xbcabcbc", b"abcabcabc", b"bcdbcbcd"]
    ids, ends = op05_bpe.Merges(ranks).encode(pieces)
    starts = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(starts, ends.tolist(), strict=False)] == [true.encode_ordinary(p.decode()) for p in pieces]
