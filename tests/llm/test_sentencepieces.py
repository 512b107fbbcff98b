import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
NASTY = ["", " ", "  two  spaces ", "a\nb\tc", "日本語 テキスト", "▁mark▁ ▁", "👍🏽 zero​width", "\x00\x01", "x" * 300, "ﬁ ligature Å", " \n ", "</s> <unk> <0x41>", "1234567890", "Straße ñandú œuvre"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.sampled_from(NASTY), st.text(st.characters(codec="utf-8"), max_size=80)), max_size=6))
def test_parity(library, texts):
    c = S.codec(PATH)
    for t, (ids, same, back) in zip(texts, c.encode(texts)):
        assert ids.tolist() == library.encode(t) == c.tokenizer.encode(t, add_special_tokens=False).ids and same
        assert c.decode(ids) == t.replace("▁", " ") and back == (c.decode(ids) == t)


def test_backend_itself_has_parity(library):
    c = S.codec(PATH)
    text = "The thonhation ofanin reonertion, ungheit lichkeit ésêtre ñciónadoó the theinhe erre 12:30 x=[1,2]; <b>ok</b> über Straße"
    assert all(ok for _, ok, _ in c.encode([text, *text.split()]))
    assert c.by_unit and len(c.model.pieces) == library.get_piece_size() and c.model.model_type == S.BPE and c.model.byte_fallback


def test_parses_a_unigram_model():
    """A hand-made model: unknown piece, normal ones with scores, byte pieces."""

    def message(*fields):
        out = b""
        for number, kind, value in fields:
            out += bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 0x7F | 0x80, number >> 4])
            out += (bytes([len(value)]) + value) if kind == 2 else value
        return out

    pieces = [("<unk>", 0.0, S.UNKNOWN), ("▁a", -1.0, S.NORMAL), ("b", -2.0, S.NORMAL), ("▁ab", -2.5, S.NORMAL), ("▁", -3.0, S.NORMAL)] + [(f"<0x{i:02X}>", 0.0, S.BYTE) for i in range(256)]
    data = b"".join(b"\x0a" + bytes([len(m)]) + m for m in (message((1, 2, p.encode()), (2, 5, np.float32(s).tobytes()), (3, 0, bytes([k]))) for p, s, k in pieces))
    trainer, norm = message((3, 0, b"\x01"), (35, 0, b"\x01")), message((3, 0, b"\x01"), (4, 0, b"\x00"), (5, 0, b"\x01"))
    data += b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(norm)]) + norm
    m = S.Model.parse(data)
    assert m.model_type == S.UNIGRAM and m.byte_fallback and m.dummy_prefix and not m.extra_spaces_go
    t = m.tokenizer()
    assert t.encode("ab a").ids == [3, 1] and t.encode("aé").ids == [1, 5 + 0xC3, 5 + 0xA9]


def test_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(50, None), (51, "word " * 30_000), (51, "word " * 30_000), (None, "x")]
    docs = spark.createDataFrame([(*r, 5, "p", True) for r in rows], "doc_id long, text string, ids int, n_tokens string, parity boolean")
    out = S.stage(spark, docs, "")
    assert out.columns == [*docs.columns, "piece_ids", "piece_n_tokens", "ids_crc32", "round_trip", "piece_parity"]
    got = sorted(((r.doc_id, r.text, r.piece_ids, r.ids_crc32, r.round_trip) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, t, ids, zlib.crc32(np.array(ids, "<i4").tobytes()), "▁" not in (t or "")))
    assert got == sorted(want, key=str)
    assert S.stage(spark, docs.where(F.lit(False)), "").count() == 0


def test_ids_are_the_backends(monkeypatch):
    c = S.Codec(PATH)
    right = c.encode(["some text"])[0]
    assert right[1] and right[2]
    c.units.known = c.units.known[:0]
    from tokenizers import normalizers

    c.tokenizer.normalizer = normalizers.Replace("e", "o")
    wrong = c.encode(["some text"])[0]
    assert wrong[0].tolist() != right[0].tolist() and not wrong[1] and not wrong[2]


def _as_unigram(data: bytes) -> bytes:
    """The model file as a unigram model: its pieces, with scores that make no ties."""

    def varint(n):
        out = b""
        while n > 0x7F:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])

    m, out = S.Model.parse(data), b""
    for i, (p, _, kind) in enumerate(m.pieces):
        score = np.float32(-np.sqrt(i + 2.0)).tobytes() if kind == S.NORMAL else bytes(4)
        body = b"\x0a" + varint(len(p.encode())) + p.encode() + b"\x15" + score + b"\x18" + bytes([kind])
        out += b"\x0a" + varint(len(body)) + body
    for number, value in S._fields(data):
        if number == 2:
            value = value + b"\x18\x01"  # of a field that comes twice the last counts: model type unigram
        if number != 1:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.sampled_from(NASTY), st.text(st.characters(codec="utf-8"), max_size=80), st.text("abcdefghilmnoprstu ", max_size=80)), min_size=1, max_size=6))
def test_full_unigram_model(tmp_path_factory, texts):
    if "unigram" not in _made:
        path = tmp_path_factory.mktemp("m") / "u.model"
        with open(PATH, "rb") as f:
            path.write_bytes(_as_unigram(f.read()))
        _made["unigram"] = S.Codec(str(path))
    c = _made["unigram"]
    assert c.model.model_type == S.UNIGRAM and len(c.model.pieces) == 32_000
    score = lambda ids: sum(c.model.pieces[i][1] for i in ids)
    for t, (ids, same, back) in zip(texts, c.encode(texts)):
        want = c.library.encode(t)
        # The same pieces in another order have the same score: either is right.
        assert same == (ids.tolist() == want) and back == ("▁" not in t)
        assert same or abs(score(ids) - score(want)) < 1e-2 and c.decode(ids) == t.replace("▁", " ")


def test_unigram_parity_of_texts_that_share_a_codec(tmp_path):
    """Letters and runs of one character, whose cuts nearly tie: parity is true just where the whole text's ids agree."""
    path = tmp_path / "u.model"
    with open(PATH, "rb") as f:
        path.write_bytes(_as_unigram(f.read()))
    c, rng = S.Codec(str(path)), np.random.default_rng(5)
    assert not c.by_unit
    differ = 0
    for _ in range(40):
        texts = ["".join(rng.choice(list("abcdefghilmnoprstu "), 60)), "x" * int(rng.integers(100, 300)), "x" * int(rng.integers(1, 90)) + " " + "x" * int(rng.integers(1, 90))]
        for t, (ids, same, _) in zip(texts, c.encode(texts)):
            want = c.library.encode(t)
            assert same == (ids.tolist() == want)
            differ += not same
    assert differ, "the texts hold no tie"


_made: dict = {}
