import pytest
from fixtures import documents, edge_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from vecloom.llm import bpe, token_counts
from vecloom.llm.queries import QUERIES

PATHS = [bpe.DEFAULT_VOCABULARY, bpe.DEFAULT_VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")]
LETTERS = st.text(alphabet=st.one_of(st.sampled_from("abcdeABCXYZ0129 \n\t'.,!?-_  éß日本ñ　😀"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=300, deadline=None)
@given(text=LETTERS)
def test_cuts_change_nothing(path, text):
    b = bpe.vocabulary(path)
    want = b.encoding.encode_ordinary(text)
    assert b.encode(text).tolist() == want and b.decode(want) == text
    for most in (1, 7):
        pieces = b.pieces(text, most)
        assert b"".join(pieces).decode() == text and sum((b.encoding.encode_ordinary(p.decode()) for p in pieces), []) == want


def test_cut_pairs_are_inside_no_token():
    b = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    pairs = {t[k] * 256 + t[k + 1] for t in b.bytes_of for k in range(len(t) - 1)}
    assert not any(b.cuts[p] for p in pairs) and b.cuts.sum() > 1000
    import random

    text = prose(random.Random(1), 300) + " zq[xj]qz" * 5
    assert len(b.boundaries(text.encode(), text)) > 0


def test_documents(spark):
    b = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.tokens == b.encoding.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens) and r.decoded_equal
    for r in QUERIES["op8_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(b.encoding.encode_ordinary(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode())


def test_edges(spark):
    b = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    rows = edge_rows()
    docs = documents(spark, rows)
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    want = sorted(((r[0], None if r[1] is None else b.encoding.encode_ordinary(r[1])) for r in rows), key=key)
    encoded = bpe.encode(docs)
    assert sorted(((r.doc_id, r.tokens) for r in encoded.collect()), key=key) == want
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(encoded).collect()), key=key)
    assert back == sorted(((r[0], r[1]) for r in rows), key=key)
    counts = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.n_tokens is None else r.n_tokens) for r in token_counts.count(docs, piece_bytes=1000, batch_bytes=5000).collect())
    assert counts == sorted((i is None, i or 0, -1 if t is None else len(t)) for i, t in want)
    for f in (bpe.encode, bpe.round_trip, token_counts.count):
        assert f(documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(0, 900), max_size=40))
def test_batches_are_bounded_and_balanced(sizes):
    got = token_counts.balanced(sizes, 500)
    assert sorted(k for g in got for k in g) == list(range(len(sizes))) or not any(sizes) and len(got) <= 1
    loads = [sum(sizes[k] for k in g) for g in got]
    assert all(n <= 500 or len(g) == 1 for n, g in zip(loads, got))


def test_batches():
    assert sorted(map(len, token_counts.balanced([6, 6, 6], 10))) == [1, 1, 1]
    assert token_counts.balanced([], 10) == []
    assert [len(g) for g in token_counts.balanced([5] * 40, 100)] == [20, 20]


def test_texts_without_spaces(spark):
    """Long texts of Chinese characters and of one line without spaces are cut, and batches are of bytes."""
    b = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    rng = __import__("random").Random(2)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(30_000))
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789,;:{}[]") for _ in range(60_000))
    for text in (cjk, line):
        got = b.pieces(text, 1000)
        assert len(got) > 20 and max(map(len, got)) < 3000 and b"".join(got).decode() == text
    rows = [(1, cjk), (2, line), (3, "z" * 50_000)]
    for r in token_counts.count(spark.createDataFrame(rows, "doc_id bigint, text string"), piece_bytes=1000, batch_bytes=4000).collect():
        text = dict(rows)[r.doc_id]
        assert (r.n_tokens, r.n_bytes) == (len(b.encoding.encode_ordinary(text)), len(text.encode()))
