"""SentencePiece encoding and decoding on the tokenizers library.

The model file (protobuf) is parsed here: pieces with scores and kinds, the trainer's model type and byte fallback, the
normaliser's character map and flags. From it the library's tokenizer is rebuilt: normaliser (character map, spaces to be dropped, dummy
prefix, marker for spaces), the model (unigram scores; or for a BPE model merges ranked by the score of the merged piece), byte
fallback and decoder. Batches are encoded with the library's threads; its ids are what is returned.

Where no piece has the marker behind another character, a text's ids are those of its units (markers and what follows up to the
next one) one after the other, so every distinct unit of a batch is encoded once, and decoded once. Parity: each distinct unit is
also encoded by the sentencepiece library when a worker first meets it; parity is false for a document with a unit whose ids differ.
That holds for BPE models, whose merges stay within a unit. A unigram model's search sums scores over a whole text, and its sums
break near-ties by what stands before: its texts are encoded whole by both libraries and compared whole. Several ways to cut a text
can have one score there (the same pieces in another order); the libraries may choose differently, and parity says so.

Defined results. Null text: no ids, decoded as empty. Empty text: no ids. Rows that repeat stay; ties don't arise. A very long text is
encoded whole, with memory in proportion to it. An empty table gives no rows. Text that holds the marker character itself decodes
to a space there (round_trip false), as in sentencepiece. Other columns come back as they were; where a name clashes with one of
the results, the result is called piece_ and that name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Runs, in_bytes, small_batches, table

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Score of pieces that no text is cut into.
NEVER = -1e7
#: Units that a worker keeps, and bytes of text that it encodes at once.
KEPT_UNITS, CHUNK_BYTES = 300_000, 8 << 20
#: New units that are encoded as one text.
JOINED = 128


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: varints as int, the others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_go: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                m.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                m.model_type, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                m.charsmap, m.dummy_prefix = f.get(2, b""), bool(f.get(3, 1))
                m.extra_spaces_go, m.escape_spaces = bool(f.get(4, 1)), bool(f.get(5, 1))
        return m

    def tokenizer(self):
        """The library's tokenizer for whole texts, and for their ids."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unknown = next(p for p, _, kind in self.pieces if kind == UNKNOWN)
        if self.model_type == UNIGRAM:
            unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
            # The unknown, byte and control pieces stand for no text of their own: nothing is ever cheaper by them.
            t = Tokenizer(models.Unigram([(p, s if kind in (NORMAL, USER) else NEVER) for p, s, kind in self.pieces], unk, self.byte_fallback))
        elif self.model_type == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER)}
            ranked = []
            for i, (p, score, kind) in enumerate(self.pieces):
                if kind == NORMAL:
                    ranked += [(-score, i, vocab[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            t = Tokenizer(models.BPE(vocab, [x[3:] for x in sorted(ranked)], unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            raise ValueError(f"model type {self.model_type} is neither unigram nor BPE")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.extra_spaces_go:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
        mark = MARK if self.escape_spaces else " "
        steps += [normalizers.Prepend(mark)] if self.dummy_prefix else []
        steps += [normalizers.Replace(" ", mark)]
        t.normalizer = normalizers.Sequence(steps)
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        t.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return t

    def splits_at_marks(self) -> bool:
        return self.escape_spaces and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


#: A unit: markers and what follows up to the next one, with the markers at the end of the text; or all of a text of markers.
_UNIT = re.compile(f"{MARK}*[^{MARK}]+(?:{MARK}+\\Z)?|{MARK}+")


class Codec:
    """Encodes and decodes batches; keeps the ids of units."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            data = f.read()
        self.model = Model.parse(data)
        self.tokenizer = self.model.tokenizer()
        self.library = SentencePieceProcessor(model_proto=data)
        self.by_unit = self.model.model_type == BPE and self.model.splits_at_marks() and self.model.dummy_prefix and not self.model.charsmap and not self.model.extra_spaces_go
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.units = Runs(self._new if self.by_unit else self._one_by_one, KEPT_UNITS if self.by_unit else 0, np.int32, 2)

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """(ids, parity, whether they decode to the text) of each text, from the rebuilt tokenizer."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        same = [a == b for a, b in zip(ids, self.library.encode(texts, num_threads=1))]
        back = [a == b for a, b in zip(self.tokenizer.decode_batch(ids, skip_special_tokens=False), texts)]
        return ids, same, back

    def _one_by_one(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, same, back = self._encoded(runs)
        return np.arange(len(runs)), np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64), np.array([same, back], bool).T

    def _new(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of new units. Those of one marker go in together, as one text: its ids that begin with a marker tell them apart."""
        simple = [i for i, u in enumerate(runs) if u and " " not in u and MARK not in u]
        groups = [simple[i : i + JOINED] for i in range(0, len(simple), JOINED)]
        order, ids, lengths, apart = [], [], [], set(range(len(runs)))
        for group, found, same, back in zip(groups, *self._encoded([" ".join([runs[i] for i in g]) for g in groups])):
            at = np.flatnonzero(self.begins[found])
            if same and back and len(at) == len(group) and at[0] == 0:  # else one by one
                order += group
                ids.append(np.array(found, np.int32))
                lengths.append(np.diff(at, append=len(found)))
                apart.difference_update(group)
        rest = sorted(apart)
        _, last_ids, last_lengths, flags = self._one_by_one([runs[i] for i in rest])
        return np.array(order + rest, np.int64), np.concatenate([*ids, last_ids]), np.concatenate([*lengths, last_lengths]), np.r_[np.ones((len(order), 2), bool), flags.reshape(-1, 2)]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids and the end, parity, round trip)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        rows = np.arange(len(texts))
        if self.by_unit:
            # Texts whose units are what single spaces part; of others, markers are gathered. A unit's key lacks its first marker.
            odd = np.zeros(len(texts), bool)
            for x in (pc.equal(texts, ""), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)):
                odd |= x.to_numpy(zero_copy_only=False)
            parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            units = [[u[1:].replace(MARK, " ") for u in _UNIT.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
            runs = pa.concat_arrays([parts.flatten().cast(pa.large_string()), pa.array([u for x in units for u in x], pa.large_string())])
            counts = np.r_[np.diff(np.asarray(parts.offsets, np.int64)), np.array([len(x) for x in units], np.int64)]
            rows = np.r_[rows[~odd], rows[odd]]
        else:
            runs, counts = texts, np.ones(len(texts), np.int64)
        coded = runs.dictionary_encode()
        numbers = self.units.numbers(coded.dictionary)[coded.indices.to_numpy()] if len(runs) else np.zeros(0, np.int64)
        ids, upto = self.units.gathered(numbers)
        flags = np.r_[np.zeros((1, 2), np.int64), np.cumsum(~self.units.flags[numbers], axis=0)]
        self.units.forget()
        upto, ends = upto[np.r_[0, np.cumsum(counts)]], np.r_[0, np.cumsum(counts)]
        good = flags[ends[1:]] == flags[ends[:-1]]
        place = np.empty_like(rows)
        place[rows] = np.arange(len(rows))
        n = np.diff(upto)[place]
        starts = np.r_[0, np.cumsum(n)]
        if len(ids) and (rows[:-1] > rows[1:]).any():
            ids = ids[np.repeat(upto[:-1][place] - starts[:-1], n) + np.arange(len(ids))]
        # Decoded units, with a space between them, are the decoded text: the text itself but for markers in it.
        back = good[place, 1] & ~pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        return ids, starts, good[place, 0], back

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        ids, at, same, back = self.encoded(pa.array(texts, pa.string()))
        return [(ids[i:j], bool(s), bool(b)) for i, j, s, b in zip(at[:-1], at[1:], same, back)]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, model: str, columns: list[str], keep_ids: bool) -> DataFrame:
    """columns of docs, then (ids array<int>) if keep_ids, n_tokens, ids_crc32 (of little-endian int32), round_trip, parity."""
    added = [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())]
    added = [("ids", pa.list_(pa.int32()))] * keep_ids + added
    names = [n for n, _ in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in in_bytes(batches, "_text", CHUNK_BYTES):
            ids, at, same, back = c.encoded(b.column("_text"))
            raw = memoryview(ids.astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            data = [pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(back), pa.array(same)]
            if keep_ids:
                data.insert(0, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            kept = [b.column(f"_{k}") for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, *data], [*(f"_{k}" for k in range(len(columns))), *names])

    # Numbered while Python has them: the table's own columns may be called like ours.
    rows = docs.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(columns)), F.col("text").alias("_text"))
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_crc32": "long", "round_trip": "boolean", "parity": "boolean"}
    schema = ", ".join([*(f"_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(columns)), *(f"{n} {kinds[n]}" for n in names)])
    small_batches(docs.sparkSession)
    out = rows.mapInArrow(run, schema)
    clash = set(columns)
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(columns)), *(F.col(n).alias(f"piece_{n}" if n in clash else n) for n in names))


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, parity of every whole text."""
    return encoded(table(spark, sf_dir, "documents"), _model(), ["doc_id"], keep_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of every row, the ids and what was verified of them; the module's docstring has the results of odd rows."""
    return encoded(docs, _model(), docs.columns, keep_ids=True)
