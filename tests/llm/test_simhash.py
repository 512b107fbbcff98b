import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import common, simhash
from tidewater.llm.common import connected_components, written

SCHEMA = "doc_id long, text string, id string, fp string, component_id string, a int"


def brute(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    label = np.array(ids)
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= 2) for x in fp]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_fingerprint_definition():
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of("") == simhash.fingerprint_of(" \t\n\x0b\x0c\r ") == 0
    import xxhash

    assert simhash.fingerprint_of("A  b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint_of("É x B c") == xxhash.xxh64_intdigest("É x b c".encode(), 42)  # only A-Z and ASCII white space
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in (b"a a a", b"a a a", b"a a b", b"a b c")]
    want = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) > 2)
    assert simhash.fingerprint_of("a a a A b c") == want


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    prints = {}
    for group in range(40):
        x = rng.getrandbits(64)
        for _ in range(60 if group < 3 else rng.randint(1, 6)):  # the first groups crowd their segments
            y = x
            for _ in range(rng.randint(0, 3)):
                y ^= 1 << rng.randrange(64)
            prints.setdefault(y, len(prints) * 7 + 3)
    prints |= {0: 1, (1 << 63): 2, (1 << 63) | (1 << 31): 4, (1 << 64) - 1: 5}
    rows = [(i, int(np.uint64(x).astype(np.int64))) for x, i in prints.items()]
    edges = simhash.fingerprint_links(spark.createDataFrame(rows, "id long, fp long"))
    got = {i: i for i in prints.values()} | {r.id: r.component for r in connected_components(edges).collect()}
    assert got == brute({i: x for x, i in prints.items()})


def test_segments_leave_out_a_quarter_each(spark):
    fp = 0xF123_4567_89AB_CDEF
    row = spark.createDataFrame([(fp - (1 << 64),)], "fp long").select(simhash.segments(F.col("fp")).alias("s")).first()
    quarters = [fp >> 16 * q & 0xFFFF for q in range(4)]
    assert row.s == [q << 48 | sum(x << 16 * i for i, x in enumerate(quarters[:q] + quarters[q + 1 :])) for q in range(4)]


def test_complete_distance_decides(spark):
    """Pairs that share a segment of 48 bits, or miss it by a bit, and lie 3 bits apart aren't linked; those 2 apart are, however the bits lie."""
    rng = random.Random(8)
    for bits, linked in ((3, False), (2, True), (1, True)):
        rows, want = [], set()
        for k in range(40):
            x, at = rng.getrandbits(64), 16 * rng.randrange(4)
            y = x
            for b in rng.sample(range(16), bits):  # within a quarter: the segment without it is the same
                y ^= 1 << at + b
            z = y ^ 1 << (at + 20) % 64  # and one bit of another quarter
            rows += [(3 * k, x), (3 * k + 1, y), (3 * k + 2, z)]
            want |= {(3 * k, 3 * k + 1)} if linked else set()
            want |= {(3 * k + 1, 3 * k + 2)} | ({(3 * k, 3 * k + 2)} if bits == 1 else set())
        prints = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows], "id long, fp long")
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.fingerprint_links(prints).collect()} == want


def test_crowded_entries_against_brute_force(spark, monkeypatch):
    """A large group around one fingerprint, another within one quarter of its bits: entries are cut, no link is lost, and links stay few."""
    monkeypatch.setattr(simhash, "MOST_MEMBERS", 4)
    rng = random.Random(9)
    prints = {}
    for k in range(700):
        y = 0x0123_4567_89AB_CDEF
        for _ in range(rng.randint(0, 4)):
            y ^= 1 << (rng.randrange(16) if k % 2 else rng.randrange(64))
        prints.setdefault(y, len(prints) * 3 + 1)
    rows = [(i, int(np.uint64(x).astype(np.int64))) for x, i in prints.items()]
    edges = simhash.fingerprint_links(spark.createDataFrame(rows, "id long, fp long"))
    got = {i: i for i in prints.values()} | {r.id: r.component for r in connected_components(edges).collect()}
    assert got == brute({i: x for x, i in prints.items()})
    assert edges.count() < 200 * len(prints)


def test_rows_in_rows_out(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(3, "x y z w"), (1, "x y z w"), (2, None), (9, ""), (None, "x y z w"), (4, "one"), (5, long), (6, long + " end"), (3, "x y z w"), (7, "alone in the world"), (7, "one")]
    docs = spark.createDataFrame([(*r, "i", "f", "c", 1) for r in rows], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 1), (1, 1), (2, 2), (9, 2), (None, None), (4, 4), (5, 5), (6, 5), (7, 4)}
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "x y z w"), (1, "x y z w"), (2, ""), (4, "one"), (5, long), (7, "alone in the world")]
    empty = docs.where(F.lit(False))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.stage(spark, empty, "").count() == 0


def test_chain_of_components(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 1999), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1999: 1999, 2000: 1999}


def test_stage_drops_near_copies(spark):
    """Texts with a few changed words, of which fingerprints differ in more than 2 bits, against all pairs."""
    rng = random.Random(8)
    rows = []
    for group in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(80 if group == 0 else rng.randint(1, 4)):  # the first group's shingles are common
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    sets = {i: {tuple(x) for x in zip(*(t.split()[k:] for k in range(5)))} for i, t in rows}
    ids = sorted(sets)
    near = {i: [j for j in ids if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in ids}
    label = {i: i for i in ids}
    while (new := {i: min(label[j] for j in near[i]) for i in ids}) != label:
        label = new
    docs = spark.createDataFrame([(*r, "i", "f", "c", 1) for r in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == label
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == sorted(set(label.values()))
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() > len(set(label.values()))  # the 2-bit rule keeps more


def test_wide_fingerprints_and_word_hashes():
    rng = random.Random(4)
    texts = ["", None, " one ", "Two  words\t", "É x B c"] + [" ".join(rng.choice("aB c d é".split()) + str(rng.randrange(60)) for _ in range(rng.choice([1, 3, 254, 255, 256, 2000]))) for _ in range(40)]
    column = pa.array(texts, pa.string())
    for begin in (0, 7):  # a slice too
        words, offsets = simhash.word_hashes(column.slice(begin))
        want = [[xxhash.xxh64_intdigest(w, 42) for w in (t or "").encode().lower().split()] for t in texts[begin:]]
        assert words.tolist() == [h for x in want for h in x] and np.diff(offsets).tolist() == [len(x) for x in want]
        shingles, at = simhash.shingle_hashes(words, offsets, 2)
        assert np.diff(at).tolist() == [max(1, len(x) - 1) for x in want]
        prints = simhash.wide_fingerprints(shingles, at).view(np.uint64)
        salts = simhash._mixed(np.arange(1, simhash.LANES + 1, dtype=np.uint64) << np.uint64(32))
        for i in range(len(want)):
            for lane, salt in enumerate(salts):
                h = [int(x) for x in simhash._mixed(shingles[at[i] : at[i + 1]] + salt)]
                assert int(prints[i, lane]) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_joins_are_not_broadcast(spark, monkeypatch):
    """Both sides of op4's joins grow with the input: none is built on the driver, however small Spark takes it to be."""
    seen = []

    def planned(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(simhash, "written", planned)
    monkeypatch.setattr(common, "written", planned)
    docs = spark.createDataFrame([(i, f"a b c {i // 2} {i % 2}", "i", "f", "c", 1) for i in range(40)], SCHEMA)
    got = simhash.near_duplicates(docs)
    seen.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in seen) >= 3 and not any("Broadcast" in p for p in seen)


def test_no_link_is_lost(spark):
    """A family whose members share one long passage and are similar in pairs only, just so: neither a named member nor the index leads to every partner."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for k in range(60):  # the ends of two pairs differ too much for a link, those within a pair in as many words as a link allows
        own = [f"f{k}_{i}" for i in range(32)]
        rows += [(len(rows) + 1, " ".join(passage + own)), (len(rows) + 2, " ".join(passage + own[:-16] + [f"g{k}_{i}" for i in range(16)]))]
    pairs = [(2 * k + 1, 2 * k + 2) for k in range(60)]
    for k in range(40):  # words changed all over
        words = list(passage)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows) + 1, " ".join(words)))
    sets = {i: {tuple(x) for x in zip(*(t.split()[k:] for k in range(5)))} for i, t in rows}
    label = {i: i for i in sets}
    near = {i: [j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    while (new := {i: min(label[j] for j in near[i]) for i in sets}) != label:
        label = new
    assert all(label[j] == i for i, j in pairs) and len(set(label.values())) > 60
    docs = spark.createDataFrame([(*r, "i", "f", "c", 1) for r in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == label


def test_prefixes_and_bounds_leave_out_nothing():
    """Similar sets share a shingle of both prefixes, before the first of which all shingles differ; bounds differ in no more bits than the sets."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64)
        sets += [np.unique(np.r_[base[rng.random(len(base)) > d], base[:1], rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)]) for d in (0, 0.05, 0.1, 0.3)]
    flat, at = np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])]
    some = np.unique(flat)[::3]
    for common in ((some, rng.integers(2, 9, len(some))), (np.zeros(0, np.uint64), np.zeros(0, np.int64))):
        first, upto = simhash.prefixes(flat, at, 0.8, common)
        bits, met = simhash.bounds(flat, at).view(np.uint64), 0
        for i in range(len(sets)):
            for j in range(i):
                shared, n = len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])
                assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= n - 2 * shared
                if shared >= 0.8 * (n - shared):
                    x, y = first[upto[i] : upto[i + 1]].tolist(), first[upto[j] : upto[j + 1]].tolist()
                    at_x = next(k for k, v in enumerate(x) if v in y)
                    assert at_x + y.index(x[at_x]) <= n - 2 * shared
                    met += 1
        assert met > 100
