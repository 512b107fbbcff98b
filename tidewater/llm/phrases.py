"""Phrase collocations by contiguous pattern growth in the manner of PrefixSpan.

Texts are cut into pieces and words; a phrase is a run of words within a piece. Growth never leaves frequent prefixes: a phrase is
frequent only if its first words are.

1. Words are counted by language; those with enough occurrences are the prefixes to grow. Then runs of two words, three and so on are
   counted by 64-bit hashes, each only where both runs of a word less in it are frequent: a task sends sorted hashes and counts for every
   range of hashes, and a range is added up at once. What is frequent goes to the workers as a table of bits of a fixed size for each
   length. A bit that is set by chance costs work, never a result.
2. Projection: in a batch of texts every occurrence of a frequent word is a pointer into the batch's words. It is followed to the right
   while the run is frequent, up to the piece's end or the longest phrase. Pointers with the same words behind them are counted, first in
   the batch, then over the table.
3. Growth: the counted projections are dealt to tasks by ranges of their words, so that a prefix's projections stand together in order.
   A task takes them in chunks of about CHUNK_ROWS and grows each prefix depth-first: it splits the prefix's range of pointers where
   the next word changes, and goes on with the extensions that are frequent. A prefix with more projections than a chunk holds is
   cut; what lies at a chunk's edge is kept whatever its count, and the parts are added. So no prefix, however common, gathers in one task.
4. Every cut of a phrase is scored from the counts of both parts, in decimals of 38 digits; phrases within a longer one that holds
   enough of their occurrences go; the first ones of each language are found within salts first, then among those.

Defined results. Null or empty text: no words. Null lang: und, as lang und. Null doc_ids and repeated rows count like any other; other
columns aren't read. Ties: the smallest first part among equal cuts; equal ranks by the phrase's bytes. A very long text is read whole,
in a batch of its own; an empty table, or one without a frequent phrase, gives no rows. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import in_bytes, remove, table, text_bytes, written

MOST_WORDS, LEAST, TOP, COVER = 3, 10, 2000, 50
#: Bits of the tables of frequent words and of frequent runs of each length; bytes of text in a worker's batch; projections in a chunk of growth; salts of the last ranking.
WORD_BITS, RUN_BITS, BATCH_BYTES, CHUNK_ROWS, SALTS = 1 << 23, 1 << 25, 4 << 20, 100_000, 64
#: Hashes of runs that a worker holds before it sends them on, and those of a range that are added up at once, on average at most.
HELD_RUNS, RANGE_RUNS = 1 << 21, 1 << 21
SEED = 42  # of Spark's xxhash64

#: By byte: 0 part of a word, 1 between words, 2 between pieces; and A-Z in lower case. Fixed values of the query's contract.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words of all texts in order, number of the piece of each, number of the text of each). Pieces are numbered over all texts."""
    at, raw = text_bytes(texts)
    kind = _KIND[raw]
    first = np.zeros(len(raw) + 1, bool)  # of a text
    first[at[:-1]] = True
    first = first[:-1]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    upto = np.cumsum(inside, dtype=np.int64 if len(raw) >> 31 else np.int32)
    offsets = np.r_[upto[starts] - 1, upto[-1] if len(upto) else 0].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
    piece = np.cumsum((kind == 2) | first, dtype=upto.dtype)[starts] if len(starts) else np.zeros(0, np.int64)
    return words.dictionary_encode(), piece, np.searchsorted(at, starts, side="right") - 1


def _by_lang(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    coded = batch.column("lang").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f long) of docs (lang, text), both not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_bytes(batches, "text", BATCH_BYTES):
            words, _, text = words_of(b.column("text"))
            langs, lang = _by_lang(b)
            n = len(words.dictionary)
            key, f = np.unique(lang[text].astype(np.int64) * max(n, 1) + words.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(key // max(n, 1))), words.dictionary.take(pa.array(key % max(n, 1))).cast(pa.string()), pa.array(f)], ["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _bits(slots: DataFrame, size: int) -> np.ndarray:
    """A table of size bits, as bytes, with those of slots (s long) set: at most size / 64 rows reach the driver."""
    rows = slots.groupBy(F.expr("cast(s div 64 as int)").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint8)


def frequent_words(words: DataFrame, least: int) -> np.ndarray:
    """The bits of words that are frequent in any language."""
    return _bits(words.where(F.col("f") >= least).select(F.pmod(F.xxhash64("word"), F.lit(WORD_BITS)).alias("s")), WORD_BITS)


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % np.uint64(len(bits) * 8)
    return bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def _levels(batch: pa.RecordBatch, tables: list[np.ndarray]) -> tuple:
    """(words, languages, language of each word, places and hashes of the runs of one word more than tables has, length of each word's run).

    tables: the bits of frequent runs of one word, of two, and so on. A run counts if both runs of a word less in it are frequent and it lies in one piece;
    a word's run is the longest frequent one that begins there.
    """
    words, piece, text = words_of(batch.column("text"))
    langs, lang = _by_lang(batch)
    code, of_word, h = words.indices.to_numpy(), lang[text], _hashes(words.dictionary)
    on, goes_on = _set(tables[0], h)[code], piece[1:] == piece[:-1]
    length = np.ones(len(code), np.int64)
    with np.errstate(over="ignore"):
        key = h[code] * np.uint64(0xC2B2AE3D27D4EB4F) + _hashes(langs)[of_word] * np.uint64(0x165667B19E3779F9)
        for k, bits in enumerate([*tables[1:], None], 2):
            at = np.flatnonzero(on[:-1] & on[1:] & goes_on)
            found = key[at] * np.uint64(0x9E3779B97F4A7C15) + h[code[at + k - 1]] * np.uint64(0xC2B2AE3D27D4EB4F)
            found ^= found >> np.uint64(29)
            if bits is None:
                return words, langs, of_word, at, found, length
            on = np.zeros(len(code), bool)
            good = _set(bits, found)
            on[at[good]] = True
            key[at] = found
            length[at[good]] = k


def frequent_runs(docs: DataFrame, tables: list[np.ndarray], least: int, total: int) -> np.ndarray:
    """The bits of runs, of one word more than tables has, that are frequent in their language. total: words of docs, from which the number of ranges of hashes follows."""
    held, ranges = docs.sparkSession.sparkContext.broadcast(tables), -(-max(total, 1) // RANGE_RUNS)
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)

    def sent(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        at = np.r_[0, np.searchsorted(key, edges), len(key)]
        rows = [(r, key[i:j].tobytes(), n[i:j].astype(np.int32).tobytes()) for r, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["range", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = [], 0
        for b in in_bytes(batches, "text", BATCH_BYTES):
            key = _levels(b, held.value)[-2]
            keys, size = [*keys, key], size + len(key)
            if size >= HELD_RUNS:
                yield sent(keys)
                keys, size = [], 0
        if size:
            yield sent(keys)

    def added(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(t["counts"].to_pylist()), np.int32)
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        frequent = key[first[np.add.reduceat(n, first) >= least]]
        return pa.table({"s": pa.array((frequent % np.uint64(RUN_BITS)).astype(np.int64))})

    rows = docs.mapInArrow(run, "range int, keys binary, counts binary")
    return _bits(rows.groupBy("range").applyInArrow(added, "s long"), RUN_BITS)


def projections(docs: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(lang, run, n long): runs of 2 words and more, each with a space behind it, and how many pointers have this frequent run and no longer one. tables: as _levels() has them, up to the longest phrase."""
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_bytes(batches, "text", BATCH_BYTES):
            words, langs, of_word, _, _, length = _levels(b, held.value)
            code, size, vocabulary = words.indices.to_numpy(), max(len(words.dictionary), 1), words.dictionary.cast(pa.string())
            for k in range(2, len(held.value) + 1):
                at = np.flatnonzero(length == k)
                key = of_word[at].astype(np.int64)
                for j in range(k):  # numbers of distinct beginnings, so that keys stay small whatever the length
                    key = key * size + code[at + j]
                    if j < k - 1:
                        key = np.unique(key, return_inverse=True)[1]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                at = at[first]
                parts = [vocabulary.take(pa.array(code[at + j])) for j in range(k)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(of_word[at])), pc.binary_join_element_wise(*parts, "", " "), pa.array(n)], ["lang", "run", "n"])

    return docs.mapInArrow(run, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def grow(words: np.ndarray, upto: np.ndarray, lo: int, hi: int, depth: int, least: int, edges: tuple[int, int], out: list[tuple[int, int, int]]) -> None:
    """Put (row, words, count) of each frequent extension of the prefix of depth words whose pointers are the rows lo to hi.

    words: codes of each row's words, -1 behind its last; rows with equal beginnings stand together. upto: sums of counts before each
    row. What touches one of the edges may go on in another chunk and is kept whatever its count.
    """
    if depth == words.shape[1]:
        return
    column = words[lo:hi, depth]
    starts = np.r_[0, np.flatnonzero(column[1:] != column[:-1]) + 1] + lo
    ends = np.r_[starts[1:], hi]
    total = upto[ends] - upto[starts]
    kept = (column[starts - lo] >= 0) & ((total >= least) | (starts == edges[0]) | (ends == edges[1]))
    for i, j, n in zip(starts[kept].tolist(), ends[kept].tolist(), total[kept].tolist()):
        if depth:
            out.append((i, depth + 1, n))
        grow(words, upto, i, j, depth + 1, least, edges, out)


def grown(runs: DataFrame, least: int, most: int = MOST_WORDS) -> DataFrame:
    """(lang, phrase, words int, a long) of every phrase of 2 to most words with at least least occurrences; runs: projections(), written."""

    def phrases_of(chunk: pa.Table) -> pa.RecordBatch:
        split = pc.split_pattern(chunk["run"].combine_chunks(), " ")
        offsets, flat = np.asarray(split.offsets, np.int64), split.flatten()
        coded = flat.dictionary_encode()
        code, count = coded.indices.to_numpy(), np.diff(offsets) - 1  # nothing stands behind the last space
        words = np.full((len(chunk), most + 1), -1, np.int64)
        words[:, 0] = chunk["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
        for k in range(most):
            has = np.flatnonzero(count > k)
            words[has, k + 1] = code[offsets[has] + k]
        upto, found = np.r_[0, np.cumsum(chunk["n"].to_numpy())], []
        for i, j in _segments(words[:, 0]):
            # A language's phrases grow by themselves; depth counts words, so the language isn't one.
            grow(words[:, 1:], upto, i, j, 0, least, (0, len(chunk)), found)
        rows, k, n = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        text = [pc.binary_join_element_wise(*(coded.dictionary.take(pa.array(words[at, j + 1])) for j in range(m)), " ") for m in range(2, most + 1) if len(at := rows[k == m])]
        at = np.concatenate([np.flatnonzero(k == m) for m in range(2, most + 1)])
        return pa.RecordBatch.from_arrays(
            [chunk["lang"].combine_chunks().take(pa.array(rows[at])), pa.concat_arrays(text).cast(pa.string()) if text else pa.array([], pa.string()), pa.array(k[at], pa.int32()), pa.array(n[at])],
            ["lang", "phrase", "words", "a"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.num_rows
            if size >= CHUNK_ROWS:
                yield phrases_of(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield phrases_of(pa.Table.from_batches(held))

    dealt = runs.repartitionByRange("lang", "run").sortWithinPartitions("lang", "run")
    parts = dealt.mapInArrow(run, "lang string, phrase string, words int, a long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _segments(x: np.ndarray) -> list[tuple[int, int]]:
    at = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def scored(found: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """found with l, r and score of its lowest-scoring cut. words: word_counts(). No part of a phrase is rarer than the phrase."""
    counts = found.select("lang", "phrase", F.col("a").alias("f")).unionByName(words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f"))
    parts = F.split("phrase", " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice(parts, 1, F.col("k")), " ").alias("_l"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("_r"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"]).join(counts.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    # 1000000 a a and l r stay below 38 digits for counts up to 10^16; the quotient is at most 1000000, as neither part is rarer than the phrase.
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def uncovered(found: DataFrame, cover: int) -> DataFrame:
    """found without the phrases that lie within a longer one of at least cover percent of their occurrences."""
    parts, n = F.split("phrase", " "), F.col("words")
    within = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice(parts, i, m), " "))))
    most = found.where("words > 2").select("lang", F.explode(within).alias("phrase"), F.col("a").alias("_a")).groupBy("lang", "phrase").agg(F.max("_a").alias("_a"))
    return found.join(most, ["lang", "phrase"], "left").where(F.col("_a").isNull() | (100 * F.col("_a") < cover * F.col("a"))).drop("_a")


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, top: int | None = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first top phrases of each language (None: all) of docs (lang, text)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    words, _ = written(word_counts(texts), "words")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total, tables = n.agg(F.sum("n")).first()[0] or 0, [frequent_words(words, least)]
    while len(tables) < most:
        tables.append(frequent_runs(texts, tables, least, total))
    runs, path = written(projections(texts, tables), "projections")
    found, _ = written(grown(runs, least, most), "phrases")
    remove(docs.sparkSession, path)
    rows = uncovered(scored(found, words, least), cover)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_salt")
        rows = rows.select("*", salt).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= top).drop("_n", "_salt")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
