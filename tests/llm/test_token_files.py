import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
NASTY = ["", " ", "Hello, WORLD's 123", "a b c", "é ́x", "<|endoftext|>", "x<|endoftext|> y", "naïve Straße İstanbul ΟΔΟΣ", "日本語 テキスト", "a\r\n\tb\x0bc\x0c", "\x85next　wide", "'s't I'll", "👍🏽 ok", "\x1c\x1d\x1e\x1f sep", "​zero"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.sampled_from(NASTY), st.text(st.characters(codec="utf-8"), max_size=60)), max_size=8))
def test_encoding_is_the_librarys(library, texts):
    ids, n = T.encoder(PATH).encode(pa.array(texts, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]


def test_slices_and_capitals(library):
    texts = ["Ärger, UND x.", "<|ENDOFTEXT|> A.b,C", "x" * 50 + ".", "éa, Àb. İc,d"] * 5
    for i in range(len(texts)):
        ids, _ = T.encoder(PATH).encode(pa.array(texts).slice(i, 3))
        assert ids.tolist() == [x for t in texts[i : i + 3] for x in library.encode(t, add_special_tokens=False).ids]


def test_forgets_what_it_does_not_keep(library, monkeypatch):
    monkeypatch.setattr(T, "KEPT_RUNS", 3)
    e = T.Encoder(PATH)
    for texts in (["one two three four five"], ["six five four", "one seven"], ["two two nine"]):
        ids, _ = e.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]
        assert len(e.runs.known) == len(e.runs.length) == 3


@pytest.mark.parametrize("seed", range(4))
def test_repair_round_trip(monkeypatch, seed):
    monkeypatch.setattr(T, "RULE_BYTES", 4)
    rng = np.random.default_rng(seed)
    docs = [np.r_[np.tile(rng.integers(2, 30, 5), rng.integers(0, 30)), rng.integers(0, 12 if seed % 2 else 500, rng.integers(0, 200)), T.END_ID] for _ in range(40)] + [np.array([T.END_ID])] * 3
    ids = np.concatenate(docs)
    row = T.shard_row(0, list(range(len(docs))), np.array([len(d) for d in docs]), ids, 500)
    s = T.Shard(row)
    assert s.expanded(s.sequence).tolist() == ids.tolist()
    assert len(s.sequence) < len(ids) and len(s.rules)
    for i, d in enumerate(docs):
        assert s.document(i).tolist() == d.tolist()
    for _ in range(50):
        i, j = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert s.decoded_range(i, j).tolist() == ids[i:j].tolist()


def test_documents(spark, library, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TOKENS", 300)
    rows = [((i * 37) % 101, NASTY[i % len(NASTY)] * (i % 4)) for i in range(101)] + [(500, None), (501, "word " * 20_000), (502, "tie"), (502, "a"), (502, "a"), (None, "lost")]
    docs = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, shard int, start string, at int")
    path = T.new_path(spark, "t")
    T.shards(docs, PATH).write.parquet(path)
    got = [tuple(r) for r in T.documents(spark.read.parquet(path)).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert T.documents(T.shards(docs.where(F.lit(False)), PATH)).count() == 0


def test_repair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(3)
    for ids in (np.full(20_001, 7), rng.integers(2, 9, 5000), np.r_[np.tile([4, 4, 5], 900), rng.integers(2, 500, 3000)]):
        seq, rules, lengths = T.compressed(ids, 500)
        s = T.Shard(T.shard_row(0, [0], np.array([len(ids)]), ids, 500))
        assert s.expanded(s.sequence).tolist() == ids.tolist() and len(rules)
        pairs, n = np.unique(seq[:-1].astype(np.int64) << 32 | seq[1:], return_counts=True)
        assert n.max(initial=0) < T.RULE_BYTES // 2 + 1
    assert len(T.compressed(np.full(20_001, 7), 500)[0]) < 20
