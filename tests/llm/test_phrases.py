import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import phrases as P


def brute(rows, most=3, least=10, top=2000, cover=50):
    """The contract read plainly: rows (lang, text)."""
    f = Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            f.update((lang or "und" if lang is None else lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, p), a in f.items():
        n[lang] += a * (len(p) == 1)
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= cover * found[lang, p[i : i + m]]:
                    hidden.add((lang, p[i : i + m]))
    rest = []
    for (lang, p), a in found.items():
        if (lang, p) not in hidden:
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rest.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang], a, score))
    out, seen = [], Counter()
    for lang, _, _, p, l, r, total, a, score in sorted(rest):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], p.decode(), a, l, r, total, score))
    return sorted(out)


def result(docs, **options):
    return sorted(map(tuple, P.collocations(docs, **options).collect()))


TEXT = st.text(st.sampled_from(list("abAé \t,.\n\x01\x0b語")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_words_and_pieces(texts):
    words, piece, text = P.words_of(pa.array(["gone", *texts]).slice(1))
    got = {}
    for w, p, t in zip(words.to_pylist(), piece.tolist(), text.tolist()):
        got.setdefault((t, p), []).append(w)
    want = []
    for t, x in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in x)
        want += [(t, w) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low) if (w := re.findall("[^ \t]+", p))]
    assert [(t, w) for (t, _), w in sorted(got.items(), key=lambda x: x[0])] == want
    assert [t for t, _ in sorted(got)] == sorted(t for t, _ in got)


@settings(max_examples=100, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from(["b", "b\x01", "c", "é"]), st.sampled_from(["a", "b", "b\x01"]), st.sampled_from(["a", "d", ""]), st.integers(1, 9)), max_size=40), cut=st.integers(0, 40), least=st.integers(1, 12))
def test_growth_in_chunks_adds_up(rows, cut, least):
    """Phrases of two chunks, added and filtered, are those of one; edges are kept whatever their count."""
    runs = sorted((" ".join(x for x in r[:3] if x) + " ", r[3]) for r in rows)

    def found(part):
        words = np.full((len(part), 3), -1, np.int64)
        for i, (run, _) in enumerate(part):
            for k, w in enumerate(run.split()):
                words[i, k] = ["a", "b", "b\x01", "c", "d", "é"].index(w)
        out = []
        if part:
            P.grow(words, np.r_[0, np.cumsum([n for _, n in part])], 0, len(part), 0, least, (0, len(part)), out)
        c = Counter()
        for i, k, n in out:
            c[tuple(words[i, :k])] += n
        return c

    one, two = found(runs), found(runs[:cut]) + found(runs[cut:])
    assert {k: v for k, v in one.items() if v >= least} == {k: v for k, v in two.items() if v >= least}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 3)
    line = "New york city, New york\tState. new YORK city\nnew york"
    rows = [("en", line)] * 12 + [(None, "red wine " * 9)] * 2 + [("und", "Red wine")] * 2 + [("x", "a\x01 b a b a\x01 b. É é É é " * 15), ("", "in the " * 11), ("en", None), ("en", ""), ("y", "w" * 50_000 + " v")]
    docs = spark.createDataFrame([(*r, None, 3, "z") for r in rows], "lang string, text string, doc_id long, n int, phrase string")
    assert result(docs) == brute(rows)
    assert {r[0] for r in result(docs)} == {"en", "und", "x", ""}
    assert result(docs.where(F.lit(False))) == [] and result(docs.where("lang = 'y'")) == []


@pytest.mark.parametrize("options", [{"most": 2}, {"most": 4, "least": 3}, {"most": 3, "least": 2, "top": 5}, {"most": 5, "least": 4, "cover": 90, "top": None}])
def test_against_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(P, "CHUNK_ROWS", 40)
    for name in ("WORD_BITS", "RUN_BITS"):
        monkeypatch.setattr(P, name, 64)  # most infrequent words and runs pass the tables
    monkeypatch.setattr(P, "HELD_RUNS", 500)
    monkeypatch.setattr(P, "RANGE_RUNS", 300)
    rng = np.random.default_rng(7)
    common = ["the", "of", "b\x01", "b", "york", "new", "é", "city"]
    rows = []
    for i in range(60):
        w = rng.choice(common + [f"w{k}" for k in range(40)], 60, p=np.r_[np.full(8, 0.1), np.full(40, 0.005)])
        rows.append((["de", "en", None][i % 3], "".join(x + str(rng.choice([" ", "  ", ". ", ",", "\n"], p=[0.8, 0.05, 0.05, 0.05, 0.05])) for x in w)))
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = result(docs, **options)
    assert got == brute(rows, **{k: (10**9 if v is None else v) for k, v in options.items()}) and len(got) > 10


def test_a_hot_prefix_is_cut(spark, monkeypatch):
    """One first word before many others: its projections fill several chunks, and counts still are whole."""
    monkeypatch.setattr(P, "CHUNK_ROWS", 50)
    rows = [("en", ". ".join(f"hot pair x{a} hot y{b}" for a, b in product(range(k, k + 20), range(20)))) for k in range(0, 60, 20)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert result(docs) == brute(rows)


def test_scores_pass_64_bits(spark):
    """Counts of 2^40: a a passes 64 bits, the score is exact."""
    n = 1 << 40
    words = spark.createDataFrame([("e", "a", n + 1), ("e", "b", n + 3)], "lang string, word string, f long")
    found = spark.createDataFrame([("e", "a b", 2, n)], "lang string, phrase string, words int, a long")
    assert P.scored(found, words, 10).first().score == 1_000_000 * n * n // ((n + 1) * (n + 3))
