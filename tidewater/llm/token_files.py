"""Token ids in Re-Pair compressed files.

Documents are range partitioned and sorted by doc_id; a task encodes its documents in order and closes a shard whenever
SHARD_TOKENS ids have come together. A shard is compressed by Re-Pair: frequent pairs of neighbouring ids are replaced by new ids
(nonterminals) until no pair occurs often enough to pay for its rule. Pairs are replaced in rounds of falling frequency; those of one
round don't overlap each other, and of a run of one id every other pair counts. Where the vocabulary is below 2^16, so are the
nonterminals: wider ids would cost more than further rules save. No rule reaches across the end of a document, so
a document is a range of the compressed sequence.

File format: Parquet, one row a shard, in the order of shard: shard, doc_ids, doc_tokens (ids of each document), doc_at (where each
begins in the sequence, and the end), vocab (nonterminals count from it), rules (pairs of uint32, a rule only has ids before its
own), rule_tokens (uint32 expansion lengths), wide (sequence of uint32, else uint16), sequence. Any stretch of ids can be decoded by
itself: sums of expansion lengths find its place (decoded_range).

Encoding takes each run of non-space characters once a task batch and keeps the commonest of a worker: the tokenizer drops white
space and never joins across it, which is checked when it is loaded.

Defined results. Null text: empty, just the end id. Rows go by doc_id, null first, then text; all rows stay, rows of one doc_id with
different beginnings in several tasks. A very long text is encoded as a whole and stays in one shard, however large. An empty
table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import Runs, in_bytes, new_path, small_batches, table

END_ID = 1
SHARD_TOKENS = 1 << 20
#: A rule takes 12 bytes: its pair and its expansion length. A pair pays from the occurrence on that saves more, at 2 or 4 bytes an id.
RULE_BYTES = 12
#: Each round takes pairs that are at least one FALL-th as frequent as those of the round before.
FALL = 4
#: Slots in which a round counts pairs: 2 to this power.
SLOT_BITS = 18
#: Runs that a worker keeps, and bytes of text that it encodes at once.
KEPT_RUNS, CHUNK_BYTES = 400_000, 8 << 20
#: The signs that byte-level models write for bytes that are no printable Latin-1 characters: from U+0100 on, in order.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Characters of a text that, beside doc_id, deal rows out.
BEGINNING = 32
SHARDS = "shard long, doc_ids array<long>, doc_tokens binary, doc_at binary, vocab int, rules binary, rule_tokens binary, wide boolean, sequence binary"


class Encoder:
    """Encodes texts through the tokenizers library, each distinct run of non-space characters once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if "'behavior': 'Removed', 'invert': True" not in str(spec["pre_tokenizer"]) or "\\s" not in str(spec["pre_tokenizer"]) or any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: its pre-tokenizer may join text across white space")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.lower = "Lowercase" in str(spec["normalizer"])
        # Lower-case letters of the scripts that every Unicode version knows go to the library's model as they are, if that is what the tokenizer does with them.
        self.direct = all(self._direct(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("plain", "straße", "naïve", "ήλιος", "слово", "x"))
        self.runs = Runs(self._new, KEPT_RUNS, np.uint32)

    def _direct(self, word: str) -> list[int]:
        """ids of one word of letters: its UTF-8 bytes, as the model writes them."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS))]

    def _new(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        letters, rest, ids, lengths = [], [], [], []
        for i, x in enumerate(runs):
            if self.direct and x.isalpha() and max(x) < "\u0500" and (x.isascii() or is_normalized("NFC", x)) and x == x.lower():
                letters.append(i)
                found = self._direct(x)
                ids += found
                lengths.append(len(found))
            else:
                rest.append(i)
        for e in self.tokenizer.encode_batch_fast([runs[i] for i in rest], add_special_tokens=False):
            found = e.ids
            ids += found
            lengths.append(len(found))
        return np.array(letters + rest), np.array(ids, np.uint32), np.array(lengths, np.int64), np.zeros((len(runs), 0), bool)

    def _prepared(self, texts: pa.Array) -> pa.Array:
        """With fewer distinct runs and the same ids: ASCII letters lower, as the tokenizer makes them, and ASCII punctuation (but apostrophes) off the letters and digits before it, where it cuts anyway."""
        if not self.lower or any(pc.any(pc.match_substring(texts, x, ignore_case=True)).as_py() for x in self.special):
            return texts
        return pc.ascii_lower(pc.replace_substring_regex(texts, r"([\pL\pN])([!-&(-/:-@\[-`{-~])", r"\1 \2"))  # in this order: ascii_lower goes wrong on a slice

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        split = pc.ascii_split_whitespace(self._prepared(pc.fill_null(texts.cast(pa.large_string()), "")))
        offsets = np.asarray(split.offsets, np.int64)
        offsets, words = offsets - offsets[0], split.flatten().dictionary_encode()
        numbers = self.runs.numbers(words.dictionary)
        ids, upto = self.runs.gathered(numbers[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64))
        self.runs.forget()
        return ids, np.diff(upto[offsets])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _apart(pairs: np.ndarray) -> list[int]:
    """Of pairs in order of preference those that can be replaced at once: no id is both the left one of a pair and the right one of another."""
    lefts, rights, chosen = set(), set(), []
    for i, (x, y) in enumerate(zip((pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist())):
        if x not in rights and y not in lefts and (x != y or x not in lefts):
            lefts.add(x)
            rights.add(y)
            chosen.append(i)
    return chosen


def compressed(ids: np.ndarray, vocab: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, expansion lengths) of ids; no rule holds end_id but as its last id."""
    seq = ids.astype(np.uint32)
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.ones(vocab, np.int64)
    last = np.arange(vocab) == end_id  # symbols that end a document
    pays = RULE_BYTES // (2 if vocab < 1 << 16 else 4) + 1
    limit, among = None, None
    while True:
        # Pairs are counted by slots of a hash first; what a slot holds is at least as many as each pair in it, so only full ones are looked into.
        # Once every pair that pays may be taken, only those that were looked into or lie beside a new symbol can still pay: among.
        left, right = (seq[:-1], seq[1:]) if among is None else (seq[among], seq[among + 1])
        slot = (((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
        held = np.bincount(slot, minlength=1 << SLOT_BITS)
        most = int(held.max())
        if most < pays:
            break
        limit = max(pays, most // FALL if limit is None else min(limit // FALL, most))
        places = np.flatnonzero((held >= limit)[slot])
        places = places[~last[left[places]]]
        pairs = (left[places].astype(np.uint64) << np.uint64(32)) | right[places]
        places = places if among is None else among[places]
        ordered = np.sort(pairs)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        counts = np.diff(first, append=len(ordered))
        often = np.flatnonzero(counts >= limit)
        if not len(often):
            if limit == pays:
                break
            continue
        found = ordered[first[often[np.argsort(-counts[often], kind="stable")]]]
        found = found[_apart(found)][: (1 << 16) - len(lengths) if vocab < 1 << 16 else None]
        if not len(found):  # ids of over 16 bits would cost more than further rules save
            break
        # A table without collisions finds their places: of pairs with one slot, one is replaced now and the others in a later round.
        slots, one = np.unique(_slots(found, SLOT_BITS), return_index=True)
        found, of_slot = found[one], np.zeros(1 << SLOT_BITS, np.int32)
        of_slot[slots] = np.arange(1, len(found) + 1)
        which = of_slot[_slots(pairs, SLOT_BITS)] - 1
        hit = np.flatnonzero(which >= 0)
        hit = hit[pairs[hit] == found[which[hit]]]
        at, by = places[hit], (len(lengths) + which[hit]).astype(np.uint32)
        twice = seq[at] == seq[at + 1]
        if twice.any():  # every other one of a run
            run = at[twice]
            begins = np.r_[True, run[1:] != run[:-1] + 1]
            place = np.arange(len(run)) - np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
            taken = np.ones(len(at), bool)
            taken[np.flatnonzero(twice)[place % 2 == 1]] = False
            at, by = at[taken], by[taken]
        made = np.stack([found >> np.uint64(32), found & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        seq[at] = by
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        if limit == pays:
            beside = np.zeros(len(seq), bool)
            beside[places] = beside[at] = beside[np.maximum(at, 1) - 1] = True
            among = np.flatnonzero(beside[keep][:-1])
        seq = seq[keep]
        rules.append(made)
        lengths = np.r_[lengths, lengths[made].sum(axis=1)]
        last = np.r_[last, last[made[:, 1]]]
    return seq, np.concatenate(rules), lengths[vocab:].astype(np.uint32)


class Shard:
    """A row of a file, decoded in part or in whole."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.vocab = row["vocab"]
        self.doc_tokens = np.frombuffer(row["doc_tokens"], np.uint32).astype(np.int64)
        self.doc_at = np.frombuffer(row["doc_at"], np.uint32)
        self.rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
        self.rule_tokens = np.frombuffer(row["rule_tokens"], np.uint32).astype(np.int64)
        self.sequence = np.frombuffer(row["sequence"], np.uint32 if row["wide"] else np.uint16)
        self.rule_at = np.r_[0, np.cumsum(self.rule_tokens)][:-1]
        self.flat = np.zeros(int(self.rule_tokens.sum()), np.uint32)  # every rule's expansion, one behind the other
        done = np.r_[np.ones(self.vocab, bool), np.zeros(len(self.rules), bool)]
        todo = np.arange(len(self.rules))
        while len(todo):  # rules whose ids are all known by now, together: as many steps as rules are nested
            ready = done[self.rules[todo]].all(axis=1)
            now, todo = todo[ready], todo[~ready]
            ids = self.expanded(self.rules[now].ravel())
            n = self.rule_tokens[now]
            self.flat[np.repeat(self.rule_at[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
            done[self.vocab + now] = True

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.vocab
        k = np.where(rule, symbols.astype(np.int64) - self.vocab, 0)
        if not len(self.rules):
            return symbols.astype(np.uint32)
        n = np.where(rule, self.rule_tokens[k], 1)
        upto = np.cumsum(n)
        out = self.flat[np.minimum(np.arange(upto[-1] if len(n) else 0) + np.repeat(self.rule_at[k] - (upto - n), n), len(self.flat) - 1)]
        out[(upto - n)[~rule]] = symbols[~rule]
        return out

    def decoded_range(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop of the shard, expanding no more of the sequence than holds them."""
        upto = np.cumsum(np.where(self.sequence >= self.vocab, np.r_[self.rule_tokens, 1][np.maximum(self.sequence.astype(np.int64) - self.vocab, -1)], 1))
        first, last = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left") + 1
        before = upto[first - 1] if first else 0
        return self.expanded(self.sequence[first:last])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.expanded(self.sequence[self.doc_at[i] : self.doc_at[i + 1]])


def shard_row(shard: int, doc_ids: list, doc_tokens: np.ndarray, ids: np.ndarray, vocab: int) -> dict:
    seq, rules, rule_tokens = compressed(ids, vocab)
    upto = np.cumsum(np.r_[np.ones(vocab, np.int64), rule_tokens][seq])
    doc_at = np.searchsorted(upto, np.r_[0, np.cumsum(doc_tokens)], side="right")
    wide = vocab + len(rules) > 1 << 16
    return {
        "shard": shard, "doc_ids": doc_ids, "doc_tokens": doc_tokens.astype(np.uint32).tobytes(), "doc_at": doc_at.astype(np.uint32).tobytes(), "vocab": vocab,
        "rules": rules.tobytes(), "rule_tokens": rule_tokens.tobytes(), "wide": wide, "sequence": seq.astype(np.uint32 if wide else np.uint16).tobytes(),
    }


def shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The rows of the file format for docs (doc_id, text). tokenizer: its file, where every executor finds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId() << 32, encoder(tokenizer)
        doc_ids, counts, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            row = shard_row(shard, doc_ids, np.concatenate(counts), np.concatenate(parts), encode.vocab)
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()), ("doc_at", pa.binary()), ("vocab", pa.int32()), ("rules", pa.binary()), ("rule_tokens", pa.binary()), ("wide", pa.bool_()), ("sequence", pa.binary())]))

        for b in in_bytes(batches, "text", CHUNK_BYTES):
            ids, n = encode.encode(b.column("text"))
            own = b.column("doc_id").to_pylist()
            ends, begin = np.cumsum(n + 1), 0
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            inner = np.ones(len(out), bool)
            inner[ends - 1] = False
            out[inner] = ids
            while begin < len(own):  # as many documents as complete the shard
                before = int(ends[begin - 1]) if begin else 0
                stop = min(len(own), int(np.searchsorted(ends, before + SHARD_TOKENS - held)) + 1)
                doc_ids += own[begin:stop]
                counts.append(n[begin:stop] + 1)
                parts.append(out[before : ends[stop - 1]])
                held += int(ends[stop - 1]) - before
                begin = stop
                if held >= SHARD_TOKENS:
                    yield closed()
                    shard += 1
                    doc_ids, counts, parts, held = [], [], [], 0
        if doc_ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # By beginnings too, so that rows of one doc_id, or without one, needn't meet in one task.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, BEGINNING)).sortWithinPartitions("doc_id", "text")
    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, SHARDS)


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row)
                ids = s.expanded(s.sequence)
                at = np.r_[0, np.cumsum(s.doc_tokens)]
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(crc)), pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(s.doc_tokens), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # The shards of a task are summed by themselves; one number a task is ordered as a whole.
    sums = files.select("shard", "doc_tokens").mapInArrow(_shard_sums, "shard long, tokens long").withColumn("task", F.shiftright("shard", 32))
    tasks = sums.groupBy("task").agg(F.sum("tokens").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("task_start"))
    within = F.sum("tokens").over(Window.partitionBy("task").orderBy("shard")) - F.col("tokens")
    starts = sums.withColumn("within", within).join(tasks, "task").select("shard", (F.col("task_start") + F.col("within")).alias("shard_start"))
    return found.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _shard_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array([int(np.frombuffer(x, np.uint32).sum(dtype=np.int64)) for x in b.column("doc_tokens").to_pylist()], pa.int64())], ["shard", "tokens"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).write.parquet(path)
    return documents(spark.read.parquet(path))
