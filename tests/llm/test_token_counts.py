import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidewater.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["", " ", "  two  spaces ", "a\nb\tc", "don't we'll I'd 's 'S", "a<|endoftext|>b", " <|endoftext|> ", "x <|endof text|>", "日本語 テキスト。次", "a  b　 c", "a\x85 b\x1c c", "👍🏽 zero​width", "\x00\x01 \x7f a", "x" * 300, " \n \r\n\n x", "1234 5678,9", "Straße ñandú œuvre", "a b'  c\n\n d"]
PARTS = st.one_of(st.sampled_from(NASTY), st.text(st.characters(codec="utf-8"), max_size=60), st.text("ab1 .'\n\t 　é", max_size=60))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(PARTS, st.lists(PARTS, max_size=4).map("".join)), max_size=6))
def test_counts_are_the_librarys(library, texts):
    c = T.counter(PATH)
    assert c.by_piece
    assert c.count(pa.array(texts, pa.string())).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_are_cut(library, monkeypatch):
    """Without white space, cuts are between letters and marks; pieces stay near the limit, and the sum is the whole text's."""
    monkeypatch.setattr(T, "LONG_BYTES", 64)
    texts = ["".join(f"日本{i}語、<|endoftext|>ab.cd" for i in range(200)), "x" * 5000, "word " * 2000]
    parts, n = T.pieces(pa.array(texts))
    assert "".join(parts.to_pylist()) == "".join(texts) and n[1] == 1 and n[0] > 20
    assert max(len(p.encode()) for p in parts.slice(0, int(n[0])).to_pylist()) < 200
    assert T.Counter(PATH).count(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_slices_nulls_and_kept_pieces(library, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    c, a = T.Counter(PATH), pa.array(["gone and gone", None, "", "a b c d e", "é è", None])
    for _ in range(3):
        assert c.count(a.slice(1)).tolist() == [0, 0, 5, len(library.encode("é è").ids), 0]
        assert len(c.known) <= 3
    assert c.count(pa.array([], pa.string())).tolist() == [] and c.count(pa.array([None, None], pa.string())).tolist() == [0, 0]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(name):
    path = public_tokenizers.path(name)
    c = T.Counter(path)
    texts = [t for t in NASTY] + ["Some more Words " * 50]
    if name.endswith(".model"):
        want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert not c.by_piece and c.count(pa.array(texts)).tolist() == want


def test_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(50, None), (51, "word " * 30_000), (51, "word " * 30_000), (None, "x")]
    docs = spark.createDataFrame([(*r, 5, "p", True) for r in rows], "doc_id long, text string, n_tokens int, _bytes string, over_limit boolean")
    out = T.token_counts(docs, PATH, ["doc_id", "n_tokens", "over_limit"])
    assert out.columns == ["doc_id", "n_tokens", "over_limit", "n_bytes", "counted_n_tokens", "counted_over_limit"]
    got = sorted(((r.doc_id, r.n_bytes, r.counted_n_tokens, r.counted_over_limit, r.n_tokens) for r in out.collect()), key=str)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 1024, 5) for i, t in rows), key=str)
    assert T.token_counts(docs.where(F.lit(False)), PATH, ["doc_id"]).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.op11_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert got == {r.doc_id: (len((r.text or "").encode()), want[r.doc_id], want[r.doc_id] > T.LIMIT) for r in docs}
    assert np.mean([v[2] for v in got.values()]) > 0
