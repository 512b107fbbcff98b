"""Token counts: batches are encoded in Arrow functions that return lengths only.

Texts reach a worker in batches of about BATCH_BYTES, whatever their number of rows. Where the tokenizer cuts texts into words by
the byte-level pattern before it merges, a text's tokens are those of its pieces one after the other, if the pieces begin at safe
boundaries: white space behind a visible ASCII character always begins a new word of the pattern, which looks at nothing before it,
and no added token holds white space. So texts are cut at all of these, long pieces (over LONG_BYTES) also between a letter and a
digit or punctuation mark, and each distinct piece of a batch is encoded once, in library batches of LIBRARY_BYTES; a worker keeps the
lengths of the first KEPT pieces that it meets. Other tokenizers, and SentencePiece models, get the whole texts in the same batches.

Defined results. Null or empty text: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows each get a row, and ties don't arise.
A very long text is read whole; what can't be cut (no white space, no letter before a digit or mark) is encoded as one piece, with
memory in proportion to it. An empty table gives no rows. Other columns come back only if asked for; where the name of a kept column
clashes with one of the results, the result is called counted_ and that name. Strings of special tokens inside a text count as the
library's default has it (one token).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import in_bytes, table, text_bytes

#: Documents of more tokens than this are over the limit.
LIMIT = 1024
#: Bytes of text in a batch of a worker and in one call of the library; bytes from which a piece is cut further; pieces whose lengths a worker keeps.
BATCH_BYTES, LIBRARY_BYTES, LONG_BYTES, KEPT = 4 << 20, 1 << 20, 32 << 10, 300_000
#: ASCII white space, and by byte whether it is a visible ASCII character.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: A letter (Latin, kana, Han, Hangul) before a digit or mark: a word of the pattern ends there. No added token has such a place, see _cuts_words.
_LETTER_END = re.compile("(?<=[A-Za-zぁ-ゖァ-ヺ一-龥가-힣])(?=[0-9.,;:!?、。，])")


def _cuts_words(config: dict) -> bool:
    """Whether the tokenizer cuts words by the byte-level pattern, without a normaliser, and has no added token that a cut could split."""
    before, added = config.get("pre_tokenizer") or {}, config.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not config.get("normalizer") and not config.get("truncation")
    return bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) or _LETTER_END.search(t["content"]) for t in added)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts one after the other, number of pieces of each): cut where white space follows a visible ASCII character."""
    at, raw = text_bytes(texts)
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = _SPACE[raw[1:]] & _VISIBLE[raw[:-1]]
    cut[at[:-1]] |= True
    cut[len(raw)] = False  # where only empty texts begin
    starts = np.flatnonzero(cut)
    extra = _long_cuts(raw, starts)
    starts = np.union1d(starts, extra) if len(extra) else starts
    offsets = np.r_[starts, len(raw)].astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw))
    upto = np.searchsorted(starts, at)
    return found, np.diff(upto)


def _long_cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Further places to cut pieces of over LONG_BYTES, about that far apart."""
    ends, out = np.r_[starts[1:], len(raw)], []
    for k in np.flatnonzero(ends - starts > LONG_BYTES):
        text, last, place, seen = raw[starts[k] : ends[k]].tobytes().decode("utf-8", "surrogatepass"), 0, 0, 0
        for m in _LETTER_END.finditer(text):
            place, seen = place + len(text[seen : m.start()].encode("utf-8", "surrogatepass")), m.start()
            if place - last >= LONG_BYTES:
                out.append(starts[k] + place)
                last = place
    return np.array(out, np.int64)


class Counter:
    """Counts the tokens of batches of texts by a file of the tokenizers (.json) or sentencepiece (.model) library."""

    def __init__(self, path: str):
        self.by_piece = False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            library = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                config = f.read()
            library = Tokenizer.from_str(config)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_piece = _cuts_words(json.loads(config))
        self.known, self.known_n = pa.array([], pa.large_string()), np.zeros(0, np.int64)

    def encoded(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text, encoded as it is, in calls of about LIBRARY_BYTES."""
        upto = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))]
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + LIBRARY_BYTES, side="right")) - 1)
            out += self.lengths(texts.slice(i, j - i).to_pylist())
            i = j
        return np.array(out, np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.by_piece:
            return self.encoded(pc.fill_null(texts.cast(pa.large_string()), ""))
        parts, per_text = pieces(texts)
        coded = parts.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        n, new = np.zeros(len(at), np.int64), np.flatnonzero(at < 0)
        n[at >= 0] = self.known_n[at[at >= 0]]
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            n[new] = self.encoded(fresh)
            kept = fresh.slice(0, max(0, KEPT - len(self.known)))
            short = pc.less_equal(pc.binary_length(kept), 64)  # long pieces hardly recur, and would hold memory
            self.known_n = np.r_[self.known_n, n[new[: len(kept)]][short.to_numpy(zero_copy_only=False)]]
            self.known = pa.concat_arrays([self.known, kept.filter(short)])
        upto = np.r_[0, np.cumsum(n[coded.indices.to_numpy()] if len(parts) else n[:0])]
        ends = np.cumsum(per_text)
        return upto[ends] - upto[ends - per_text]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """columns of docs, then n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit) of every whole text."""
    names = [f"_{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in in_bytes(batches, "_text", BATCH_BYTES):
            text = b.column("_text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), size, pa.array(c.count(text))], [*names, "_bytes", "_tokens"])

    # Numbered while Python has them: the table's own columns may be called like ours.
    rows = docs.select(*(F.col(c).alias(x) for c, x in zip(columns, names)), F.col("text").alias("_text"))
    schema = ", ".join([*(f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(columns, names)), "_bytes long", "_tokens long"])
    found = {"n_bytes": F.col("_bytes"), "n_tokens": F.col("_tokens"), "over_limit": F.col("_tokens") > limit}
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(x).alias(c) for c, x in zip(columns, names)), *(x.alias(f"counted_{n}" if n in columns else n) for n, x in found.items()))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
