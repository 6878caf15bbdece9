"""Operators 2 and 8: exact tokens and round trips."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import bpe, rans
from tests.llm.conftest import sentence

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder.load(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_the_library_s(encoder, library):
    rng = random.Random(5)
    signs = "aabcst're llve'dm  \n\n\t.,'!0129é ñ中文🙂 　I'll don't we've ' 's<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["", " ", "\n", "a  b", " \n b ", "'tis", " 's", "x's", "''s", "'sabc", "'re", "'r e", "aaaa" * 99, "hahaha" * 40, "<|endoftext|>"]
    for (ids, off), part in zip(encoder.texts([pa.array(texts[:2000]), pa.array(texts[2000:])]), (texts[:2000], texts[2000:])):
        for i, t in enumerate(part):
            assert ids[off[i] : off[i + 1]].tolist() == library.encode_ordinary(t), t


def rows(rng):
    return [(1, None), (2, ""), (None, "null id"), (3, "Hello  world's\n"), (3, "Hello  world's\n"), (4, sentence(rng, 20000)), (5, "é中🙂 " * 50)] + [(i, sentence(rng, 40)) for i in range(10, 40)]


def test_encode_and_decode(documents, rng, library):
    data = rows(rng)
    got = bpe.encode(documents(data))
    out = got.collect()
    assert len(out) == len(data) and all(r.round_trip for r in out)
    texts = {d: t or "" for d, t in data}
    assert all(r.tokens == library.encode_ordinary(texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode()) for r in out)
    back = bpe.decoded(got.select("doc_id", "tokens"))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t in data)
    whole = bpe.encoded(documents(data))
    assert whole.columns == [*documents(data).columns, "tokens", "n_tokens"] and whole.count() == len(data)
    assert bpe.encode(documents(data).where("doc_id < 0")).collect() == []


def test_frequencies_add_up():
    for counts in ([5, 0, 1], [1] * 3000, [10**9] + [1] * 500):
        f = rans.frequencies(np.array(counts), 12)
        assert f.sum() == 1 << 12 and ((f > 0) == (np.array(counts) > 0)).all()


@pytest.mark.parametrize("n", [0, 1, 31, 33, 2000, 5000])
def test_round_trip_of_blocks(n):
    ids = np.random.default_rng(n).zipf(1.4, n) % 300
    freq = rans.frequencies(np.bincount(ids, minlength=300))
    made = list(rans.code(ids, freq, block=2048, every=16))
    assert [r["n_tokens"] for r in made] == [min(2048, n - i) for i in range(0, n, 2048)]
    for b, r in enumerate(made):
        part = ids[b * 2048 : (b + 1) * 2048]
        assert (rans.uncode(r, freq, every=16) == part).all()
        for k in range(1, -(-len(part) // (16 * rans.LANES))):
            assert (rans.uncode(r, freq, every=16, at=k) == part[k * 16 * rans.LANES :]).all()
    if n == 5000:
        entropy = -np.log2(freq[ids] / freq.sum()).sum()
        assert sum(len(r["stream"]) for r in made) * 8 <= entropy * 1.01 + 64 * rans.LANES * len(made)
        broken = made[0] | {"stream": made[0]["stream"][:-4] + b"\x01\x02\x03\x04"}
        with pytest.raises(ValueError):
            rans.uncode(broken, freq, every=16)


def test_corpus_round_trip(documents, rng):
    data = [r for r in rows(rng) if r[0] is not None]
    data = list(dict(data).items())
    coded = rans.blocks(documents(data), block=4096)
    got = {r.doc_id: r.tokens for r in rans.tokens(coded).collect()}
    assert got == {r.doc_id: r.tokens for r in bpe.encode(documents(data)).collect()}
    full = rans.blocks(documents(rows(rng)), block=4096)
    assert sum(len(r.doc_id) for r in full.where("part >= 0").collect()) >= len(rows(rng))
    empty = rans.blocks(documents(data).where("doc_id < 0"))
    assert [r.part for r in empty.collect()] == [-1]
