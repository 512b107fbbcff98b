"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, one for each bit that is set in over half of the XXH64 hashes (seed 42) of the text's word
shingles. Two fingerprints link at no more than 2 differing bits. The index takes four overlapping segments of 48 bits, each all but
one quarter of the fingerprint. Of two fingerprints that link, the segment without a quarter in which they differ differs in one bit
at most. So a table is keyed by segment and value, each fingerprint looks for the values in the Hamming ball of radius 1 around its
own (of two values a bit apart, the one with the bit set looks for the other), and the complete distance of what it meets is verified.
An entry of the table holds at most 2^16 fingerprints, those that share 48 bits. Where one holds more than MOST_MEMBERS, its pairs aren't
compared: its members, and the fingerprints that look for it, meet in the points of the balls of radius 1 around whole fingerprints, where
all are within 2 bits of each other and a star of links does. Equal fingerprints count once; their rows share the search.

Defined results. Null or empty text, or no word: fingerprint 0, linked like any other. Fewer words than a shingle has: the
whole sequence is the one shingle. A null doc_id gets its fingerprint and no component. Repeated doc_ids share a component.
Very long texts are read whole, in slices. Ties: the smallest doc_id names a component. An empty table gives no rows. Other
columns are neither read nor returned.

The pipeline's stage has a rule of its own (similar_documents): 5-word shingles, Jaccard similarity of 0.8 or more. Its index
is the same method with wider fingerprints, see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import connected_components, in_bytes, shuffled, small_batches, table, written

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
#: Fingerprints of an entry that are compared one by one; larger entries have a way of their own.
MOST_MEMBERS = 32
#: The rule of the pipeline's stage: Jaccard similarity of the sets of shingles of so many words.
STAGE_SHINGLE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: Its index: fingerprints of 256 bits over distinct 2-word shingles, in segments of 32. Changed words touch fewer of these shingles than of longer ones.
INDEX_WORDS, SEGMENTS, SEGMENT_BITS = 2, 8, 32
LANES = SEGMENTS * SEGMENT_BITS // 64
#: The exact join's order of shingles, rarest first, is taken from one in SAMPLE_PART of the texts: of those that occur in it repeatedly, the FREQUENT commonest. It only steers the work.
SAMPLE_PART, FREQUENT = 16, 1 << 19
#: Bits, of 64 a lane, by which a pair's sets are bounded before they are read.
BOUND_LANES = 16


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < shingle_words:
        hashes = digest(b" ".join(words), SEED)
    else:
        hashes = b"".join([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle_words)))])
    counts = np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 65_536):  # a long text takes no more memory than this many shingles
        counts += np.add.reduce(np.unpackbits(rows[i : i + 65_536], axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def fingerprint_column(text, shingle_words: int = SHINGLE_WORDS):
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint_of(x.as_py(), shingle_words) for x in texts]  # one text in memory at a time, beside the batch
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return fingerprint(text)


def segments(fp: Column) -> Column:
    """The keys of a fingerprint's four segments: 48 bits, all but quarter q, and above them q."""
    keys = []
    for q in range(4):
        above = F.shiftleft(F.shiftrightunsigned(fp, 16 * (q + 1)), 16 * q) if q < 3 else F.lit(0).cast("long")
        keys.append(above.bitwiseOR(fp.bitwiseAND(F.lit((1 << 16 * q) - 1))).bitwiseOR(F.lit(q << 48)))
    return F.array(*keys)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of prints (id long, fp long; one row a fingerprint) at no more than 2 differing bits.

    They make the components that all pairs would make: pairs that meet in a crowded entry may be linked by others there.
    """
    keyed = prints.select("id", "fp", F.explode(segments(F.col("fp"))).alias("key"))
    members = F.collect_list(F.struct("id", "fp"))  # 2^16 at most
    entries, _ = written(keyed.groupBy("key").agg(members.alias("members")), "entries")
    few = F.when(F.size("members") <= MOST_MEMBERS, F.col("members"))
    flips = F.lit([0, *(1 << k for k in range(48))])
    looked = F.filter(flips, lambda x: (x == 0) | (F.col("key").bitwiseAND(x) != 0))
    asked = keyed.select("id", "fp", F.explode(F.transform(looked, lambda x: F.col("key").bitwiseXOR(x))).alias("key"))
    met, _ = written(asked.join(shuffled(entries.select("key", few.alias("members"))), "key").select("id", "fp", "members").where("members is null or size(members) > 1 or members[0].id <> id"), "met")
    near = met.select("id", "fp", F.inline("members").alias("b", "other")).where("id <> b and bit_count(fp ^ other) <= 2")
    crowd = met.where("members is null").select("id", "fp").union(entries.where(F.size("members") > MOST_MEMBERS).select(F.inline("members"))).distinct()
    return near.select(F.col("id").alias("a"), "b").union(_meeting_links(crowd))


def _meeting_links(prints: DataFrame) -> DataFrame:
    """Links of fingerprints to the smallest id of each point that their balls of radius 1 share."""
    flips = F.lit([0, *(1 << k for k in range(63)), -(1 << 63)])
    points = prints.select("id", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    met = points.withColumn("first", F.min("id").over(Window.partitionBy("point")))
    return met.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id that links lead to, a row for each row of docs."""
    small_batches(docs.sparkSession)
    prints, _ = written(docs.select("doc_id", fingerprint_column(F.col("text"), shingle_words).alias("fp")), "prints")
    distinct, _ = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    # Fingerprints that share their smallest doc_id (repeated ids) meet in one node of the graph by themselves.
    component = connected_components(fingerprint_links(distinct).union(_repeated(prints, distinct)))
    of_print = distinct.join(shuffled(component), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(shuffled(of_print), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _repeated(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links between the fingerprints of doc_ids that occur with several ones."""
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    node = prints.join(shuffled(several), "doc_id", "left_semi").join(shuffled(distinct), "fp").select("doc_id", "id")
    return node.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others (multiply and shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words and the end): A-Z lower, words by ASCII white space; null: no words."""
    texts = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts  # ascii_lower goes wrong on a slice
    lower = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    split = pc.ascii_split_whitespace(lower)
    words, offsets = split.flatten(), np.asarray(split.offsets, np.int64)
    offsets = offsets - offsets[0]
    real = np.asarray(pc.binary_length(words)) > 0  # white space at an end leaves an empty word
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    found = hashes[coded.indices.to_numpy()[real]] if len(words) else np.zeros(0, np.uint64)
    return found, np.r_[0, np.cumsum(real)][offsets]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, offsets of each text's shingles and the end); a text of fewer words has its whole sequence, one without words 0."""
    n = np.diff(offsets)
    count = np.maximum(n - size + 1, 1)
    upto = np.r_[0, np.cumsum(count)]
    at = np.arange(upto[-1]) + np.repeat(offsets[:-1] - upto[:-1], count)
    left = np.repeat(n, count)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = np.where(k < left, _mixed(out * np.uint64(3) + (words[np.minimum(at + k, len(words) - 1)] if len(words) else np.uint64(0))), out)
    return out, upto


def wide_fingerprints(shingles: np.ndarray, offsets: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """SimHash fingerprints of 64 x lanes bits, as signed longs: (texts, lanes).

    Eight bits of a hash at a time are counted in the eight bytes of a number, over stretches of at most 255 shingles, which no byte exceeds.
    """
    n = np.diff(offsets)
    stretches = -(-n // 255)
    first = np.r_[0, np.cumsum(stretches)]
    begins = np.repeat(offsets[:-1] - 255 * first[:-1], stretches) + 255 * np.arange(first[-1])
    ones, out = np.uint64(0x0101010101010101), np.zeros((len(n), lanes), np.uint64)
    for lane, salt in enumerate(_mixed(np.arange(1, lanes + 1, dtype=np.uint64) << np.uint64(32))):
        hashes = _mixed(shingles + salt)
        for k in range(8):
            counts = np.add.reduceat((hashes >> np.uint64(k)) & ones, begins).view(np.uint8).reshape(-1, 8)
            set_ = 2 * np.add.reduceat(counts, first[:-1], axis=0, dtype=np.int64) > n[:, None]
            out[:, lane] |= (set_.astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def shingle_sets(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct shingles of each text, sorted; their offsets and the end)."""
    sets = [np.unique(shingles[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.r_[0, np.cumsum([len(x) for x in sets], dtype=np.int64)]


def _set_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def common_shingles(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; how often each occurs) of the sample's commonest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_bytes(batches, "text"):
            found, counts = np.unique(shingle_sets(*shingle_hashes(*word_hashes(b.column("text")), shingle_words))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_PART)) == 0).select("text").mapInArrow(run, "shingle long, n long")
    most = sample.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingles, counts = (most.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], counts[order]


def prefixes(sets: np.ndarray, offsets: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the first shingles of each set in one order of all shingles, the rarest first; their offsets and the end).

    They are all but ceil(least * n) - 1 of a set of n: two sets of a Jaccard similarity of least share ceil(least * n) or more, so that one at least is among these, in both.
    """
    n = np.diff(offsets)
    seen = np.zeros(len(sets), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], sets), len(common[0]) - 1)
        seen = np.where(common[0][at] == sets, common[1][at], 0)
    order = np.lexsort((sets, seen, np.repeat(np.arange(len(n)), n)))
    count = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
    return sets[order][np.arange(len(sets)) - np.repeat(offsets[:-1], n) < np.repeat(count, n)], np.r_[0, np.cumsum(count)]


def bounds(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BOUND_LANES) longs in which each shingle of a set has turned one bit: those of two sets differ in no more bits than the sets in shingles, as shared ones cancel out."""
    n = np.diff(offsets)
    out = np.zeros(len(n) * BOUND_LANES, np.uint64)
    lane = np.repeat(np.arange(len(n)) * BOUND_LANES, n) + (sets >> np.uint64(6) & np.uint64(BOUND_LANES - 1)).astype(np.int64)
    np.bitwise_xor.at(out, lane, np.uint64(1) << (sets & np.uint64(63)))
    return out.view(np.int64).reshape(-1, BOUND_LANES)


def _prints(docs: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """doc_id, same (a hash of the text), key (of the shingle set), n (its size), index (fingerprint over INDEX_WORDS words), bits (bounds of the set), prefix (see prefixes)."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_bytes(batches, "text"):
            words, offsets = word_hashes(b.column("text"))
            wide = wide_fingerprints(*shingle_sets(*shingle_hashes(words, offsets, INDEX_WORDS)))
            sets, at = shingle_sets(*shingle_hashes(words, offsets, shingle_words))
            longs = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (wide, bounds(sets, at))]
            first, upto = prefixes(sets, at, least, common.value)
            prefix = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(first.view(np.int64)))
            keys = pa.array([_set_key(sets[i:j]) for i, j in zip(at[:-1], at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), keys, pa.array(np.diff(at)), *longs, prefix], ["doc_id", "same", "key", "n", "index", "bits", "prefix"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("same"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, same long, key long, n long, index array<long>, bits array<long>, prefix array<long>")


def _entries(prints: DataFrame) -> DataFrame:
    """(entry, key): the Hamming ball of radius 1 around each segment of the index's fingerprint; entry holds the segment's number and a point."""
    flips = F.lit([0, *(1 << k for k in range(SEGMENT_BITS))])
    values = F.flatten(F.transform("index", lambda x: F.array(F.shiftrightunsigned(x, SEGMENT_BITS), x.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))))
    entries = F.flatten(F.transform(values, lambda v, k: F.transform(flips, lambda x: v.bitwiseXOR(x) + k * F.lit(1 << SEGMENT_BITS))))
    return prints.select("key", F.explode(entries).alias("entry"))


def _may_link(x: str, y: str, least: float, apart: Column | None = None) -> Column:
    """Whether two sets can have the similarity by their sizes and the shingles that differ: apart at least, if given, and the bits of their bounds."""
    nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
    most = (nx + ny) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)
    bits = sum((F.bit_count(F.get(f"bits{x}", F.lit(k)).bitwiseXOR(F.get(f"bits{y}", F.lit(k)))) for k in range(BOUND_LANES)), F.lit(0))
    sizes = (nx >= least * ny - 1e-9) & (ny >= least * nx - 1e-9)
    return (sizes if apart is None else sizes & (apart <= most)) & (bits <= most)


def _nearest(prints: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of keys, two a key at most, if their sets may link.

    Of those that its entries of the index name, each key with the one with which it shares most; of its shingles' sets with the fewest rarer ones, with that of the fewest before both.
    """
    head = F.min(F.struct(F.xxhash64("key").alias("h"), "key")).over(Window.partitionBy("entry"))
    met = _entries(prints).withColumn("head", head["key"]).where("key <> head").groupBy("key", "head").agg(F.count("*").alias("times"))
    base = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "key", "pos", "n")).over(Window.partitionBy("shingle"))
    apart = ((F.col("pos") + F.col("base.pos")) / (F.col("n") + F.col("base.n"))).alias("apart")
    rare = entries.withColumn("base", base).where("key <> base.key").groupBy("key").agg(F.min(F.struct(apart, F.col("base.key").alias("head"))).alias("m")).select("key", "m.head")
    pairs, _ = written(met.groupBy("key").agg(F.max(F.struct("times", "head")).alias("m")).select("key", "m.head").union(rare).select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct(), "near")
    of = lambda c: shuffled(prints.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_may_link("a", "b", least)).select("a", "b")


def _apart(prints: DataFrame, entries: DataFrame, component: DataFrame, least: float) -> DataFrame:
    """Every pair (a, b) of keys in different components whose sets can have the similarity: none is left out.

    Such sets share a shingle of both prefixes; where they share the first one, all before it differ. Of a shingle's sets only those outside its largest component
    look for others, so that a group that lies together already isn't compared with itself.
    """
    shingle = Window.partitionBy("shingle")
    placed = entries.join(shuffled(component), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
    mixed = placed.withColumns({"lo": F.min("c").over(shingle), "hi": F.max("c").over(shingle)}).where("lo <> hi").drop("lo", "hi")
    mixed = mixed.withColumn("times", F.count("*").over(Window.partitionBy("shingle", "c"))).withColumn("main", F.max(F.struct("times", "c")).over(shingle)["c"]).drop("times")
    mixed, _ = written(mixed.join(shuffled(prints.select("key", "bits")), "key"), "mixed")
    side = lambda s: [F.col(c).alias(f"{c}{s}") for c in ("key", "n", "bits", "pos", "c")]
    x, y = mixed.where("c <> main").select("shingle", *side("x")), mixed.select("shingle", "main", *side("y"))
    once = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("keyx") < F.col("keyy")))
    pairs = x.join(shuffled(y), "shingle").where(once & _may_link("x", "y", least, F.col("posx") + F.col("posy")))
    return pairs.select(F.least("keyx", "keyy").alias("a"), F.greatest("keyx", "keyy").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """Of pairs (a, b) of keys those whose shingle sets have a Jaccard similarity of least or more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_bytes(batches, "text"):
            found, at = shingle_sets(*shingle_hashes(*word_hashes(b.column("text")), shingle_words))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(found[i:j]) for i, j in zip(at[:-1], at[1:])], pa.int64()), lists], ["key", "set"])

    pairs, _ = written(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    chosen = prints.join(shuffled(needed), "key", "left_semi").select("doc_id", "same")
    # One row has the text of a key; a repeated doc_id may come with several texts.
    texts = docs.join(chosen.withColumnRenamed("same", "_same"), "doc_id").where(F.xxhash64("text") == F.col("_same")).select("text")
    keyed, _ = written(texts.mapInArrow(sets, "key long, set array<long>"), "sets")
    keyed = keyed.dropDuplicates(["key"])
    of = lambda c, name: shuffled(keyed.select(F.col("key").alias(c), F.col("set").alias(name)))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _components(links: DataFrame) -> DataFrame:
    return written(connected_components(links).withColumnRenamed("id", "key"), "component")[0]


def similar_sets(docs: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """doc_id, same (hash of the text), component: a row for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows, _ = written(_prints(docs, shingle_words, least), "prints")
    one = rows.groupBy("key").agg(F.min(F.struct("doc_id", "same", "n", "index", "bits", "prefix")).alias("one"))
    prints, _ = written(one.select("key", "one.*"), "distinct")
    entries, _ = written(prints.select("key", "n", F.posexplode("prefix").alias("pos", "shingle")).withColumn("times", F.count("*").over(Window.partitionBy("shingle"))).where("times > 1").drop("times"), "entries")
    # The index joins most that belong together, by two pairs for each set at most; what then still lies apart is compared with all that it can be similar to.
    component = _components(_verified(_nearest(prints, entries, least), docs, prints, shingle_words, least))
    more = _verified(_apart(prints, entries, component, least), docs, prints, shingle_words, least)
    component = _components(more.union(component.select("key", "component")))
    return rows.select("doc_id", "same", "key").join(shuffled(component), "key", "left").select("doc_id", "same", F.coalesce("component", "key").alias("component"))


def similar_documents(docs: DataFrame, shingle_words: int = STAGE_SHINGLE_WORDS, least: float = STAGE_SIMILARITY) -> DataFrame:
    """doc_id, component_id, a row for each row of docs with a doc_id: the smallest doc_id that links lead to.

    Texts link at a Jaccard similarity of least or more between the sets of their shingles; equal sets count once. Multi-index hashing finds each set's nearest: of
    each of the SEGMENTS segments of a wide fingerprint the Hamming ball of radius 1 is entered in a table, and each set is compared with the one that it meets most.
    The groups found so are completed by an exact join (_apart): of sets in different groups, all that can be similar are compared, so that no link is lost.
    """
    rows, _ = written(similar_sets(docs.where("doc_id is not null").select("doc_id", "text"), shingle_words, least), "similar")
    least_id = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least_id, "component").select("doc_id", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar texts (similar_documents): the one with the smallest doc_id.

    Defined results. Null and empty texts and texts without words are one group. Repeated doc_ids: rows are told apart by their texts, so that unrelated texts with
    one doc_id both stay; of groups' rows with the smallest doc_id the one with the smallest text hash stays, of equal rows one, of rows that differ in
    other columns the first by their JSON. Rows without doc_id stay. Very long texts are compared whole. An empty table gives no rows. All columns are
    returned as they came, whatever their names.
    """
    rows, _ = written(similar_sets(docs.where("doc_id is not null").select("doc_id", "text"), STAGE_SHINGLE_WORDS, STAGE_SIMILARITY), "similar")
    # Rows of one group that share doc_id and text are counted, as only they need an order among themselves.
    row = rows.groupBy("component", "doc_id", "same").agg(F.count("*").alias("_times"))
    kept = row.groupBy("component").agg(F.min(F.struct("doc_id", "same", "_times")).alias("k")).select(F.col("k.doc_id").alias("_kept"), F.col("k.same").alias("_same"), "k._times")
    kept, _ = written(kept, "kept")
    match = lambda k: docs.join(k, (docs["doc_id"] == k["_kept"]) & (F.xxhash64(docs["text"]) == k["_same"]), "left_semi")
    several = match(kept.where("_times > 1"))
    nth = F.row_number().over(Window.partitionBy(several["doc_id"], F.xxhash64(several["text"])).orderBy(F.to_json(F.struct(*several.columns))))
    several = several.select(F.struct(*several.columns).alias("_row"), nth.alias("_nth")).where("_nth = 1").select("_row.*")
    return match(kept.where("_times = 1")).union(several).union(docs.where("doc_id is null"))
