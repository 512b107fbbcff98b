"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes. Every byte has a learned input for the update gate, reset gate and candidate of a recurrent layer in each
direction; both directions' states give the position's label probabilities. Gates are piecewise linear (clip(x/4 + 1/2, 0, 1), candidates
clip(x, -1, 1)), which numpy does without transcendental functions. It is trained in numpy by backpropagation through time on
SNIPPETS snippets (more where there are over 187 labels) of SNIPPET bytes of a bounded sample of labelled rows.

A whole text is cut into windows of WINDOW bytes which the network reads side by side; every position of every window is labelled,
and a document's probabilities are the mean over all its positions.

Defined results, a row for each row of docs: lang_pred, score (its pooled probability). Null text, or text without a letter: 'und' and
score 1. Without any labelled row, or in a text whose windows say nothing: 'und', 0. With one label in the sample: that label. Ties
go to the first label by code point. Repeated rows get the same. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import in_bytes, small_batches, table, written

#: Labelled rows that training reads for each label, and for all together: every label has its share, but at least LEAST_ROWS.
SAMPLE_ROWS, TOTAL_ROWS, LEAST_ROWS = 400, 25_600, 32
SNIPPETS, SNIPPET = 6000, 64
HIDDEN, WINDOW = 8, 64
STEPS, BATCH, RATE = 500, 256, 0.02
#: Windows that are read side by side.
LANES = 4096
#: Bytes of text that are labelled at once.
CHUNK_BYTES = 2 << 20
#: In the place of a byte: the state stays as it is.
PAD = 256
UNDETERMINED = "und"
#: Documents whose best label has less of the probability are rejected by the pipeline's stage.
LEAST_SCORE = 0.3


@dataclass
class Network:
    """w: inputs by byte (256, 3H), u: recurrent weights (3H, H), both for the two directions; out: (labels, 2H) and its bias. 3H: update, reset, candidate."""

    labels: list[str]
    w: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        h = HIDDEN
        return cls(labels, rng.normal(size=(2, 256, 3 * h)).astype(np.float32) * 0.5, rng.normal(size=(2, 3 * h, h)).astype(np.float32) / np.float32(np.sqrt(h)), np.zeros((len(labels), 2 * h), np.float32), np.zeros(len(labels), np.float32))

    def states(self, x: np.ndarray, direction: int, kept: list | None = None) -> np.ndarray:
        """Hidden states (T, H, N) of byte windows x (T, N); what backpropagation needs goes into kept."""
        h, u = HIDDEN, self.u[direction]
        w = np.concatenate([self.w[direction].T, np.full((3 * h, 1), -1e9, np.float32)], axis=1)  # PAD: the update gate stays shut
        now, out = np.zeros((h, x.shape[1]), np.float32), np.empty((len(x), h, x.shape[1]), np.float32)
        for t in range(len(x)) if direction == 0 else range(len(x) - 1, -1, -1):
            given = np.take(w, x[t], axis=1)
            gates = u[: 2 * h] @ now
            gates += given[: 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            reset = gates[h:] * now
            candidate = u[2 * h :] @ reset
            candidate += given[2 * h :]
            np.clip(candidate, -1, 1, out=candidate)
            if kept is not None:
                kept.append((t, now, gates, reset, candidate))
            candidate -= now if kept is None else 0
            now = now + gates[:h] * (candidate if kept is None else candidate - now)
            out[t] = now
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, labels, N): of each position of each window."""
        z = np.matmul(self.out[:, :HIDDEN], self.states(x, 0))
        z += np.matmul(self.out[:, HIDDEN:], self.states(x, 1))
        z += self.bias[:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all positions, for w, u, out and bias. y: label of each window."""
        h, (steps, n) = HIDDEN, x.shape
        kept: list[list] = [[], []]
        states = [self.states(x, d, kept[d]) for d in (0, 1)]
        z = np.matmul(self.out[:, :h], states[0]) + np.matmul(self.out[:, h:], states[1]) + self.bias[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[:, y, np.arange(n)] -= 1
        z /= steps * n
        d_out = np.concatenate([np.einsum("tln,thn->lh", z, s, optimize=True) for s in states], axis=1)
        d_w, d_u = np.zeros_like(self.w), np.zeros_like(self.u)
        for d in (0, 1):
            u, back, into = self.u[d], np.zeros((h, n), np.float32), np.empty((steps, 3 * h, n), np.float32)
            for t, before, gates, reset, candidate in reversed(kept[d]):
                g = back + self.out[:, d * h : (d + 1) * h].T @ z[t]
                d_candidate = g * gates[:h] * (np.abs(candidate) < 1)
                d_reset = u[2 * h :].T @ d_candidate
                d_gates = np.concatenate([g * (candidate - before), d_reset * before]) * (0.25 * ((gates > 0) & (gates < 1)))
                back = g * (1 - gates[:h]) + d_reset * gates[h:] + u[: 2 * h].T @ d_gates
                d_u[d][: 2 * h] += d_gates @ before.T
                d_u[d][2 * h :] += d_candidate @ reset.T
                into[t, : 2 * h], into[t, 2 * h :] = d_gates, d_candidate
            flat = into.transpose(0, 2, 1).reshape(-1, 3 * h)
            order = np.argsort(x.ravel(), kind="stable")
            byte, first = np.unique(x.ravel()[order], return_index=True)
            d_w[d][byte] = np.add.reduceat(flat[order], first, axis=0)
        return [d_w, d_u, d_out.astype(np.float32), z.sum(axis=(0, 2))]


def trained(texts: list[str], labels: list[str], seed: int = 5) -> Network | None:
    """A network from labelled texts: Adam on random snippets, as many of each label."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    by = {k: [x for x, l in zip(texts, labels) if l == k and x.strip()] for k in names}
    names = [k for k in names if by[k]]
    if not names:
        return None
    net = Network.fresh(names, rng)
    if len(names) == 1:
        return net
    snippets = max(SNIPPETS, LEAST_ROWS * len(names))
    x, y = np.full((snippets, SNIPPET), 32, np.uint8), np.arange(snippets) % len(names)
    encoded = {k: [t.encode("utf-8", "replace") for t in v] for k, v in by.items()}
    for i in range(snippets):
        own = encoded[names[y[i]]]
        raw = own[rng.integers(len(own))]
        at = int(rng.integers(max(1, len(raw) - SNIPPET + 1)))
        piece = np.frombuffer(raw[at : at + SNIPPET], np.uint8)
        x[i, : len(piece)] = piece
    weights = [net.w, net.u, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    for step in range(1, STEPS + 1):
        at = rng.integers(snippets, size=BATCH)
        grads = net.gradients(np.ascontiguousarray(x[at].T), y[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / (STEPS + 1))
        for i, g in enumerate(grads):
            g = g / max(1.0, norm)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            weights[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text: (texts, labels); zeros for an empty one."""
    data = [t.encode("utf-8", "replace") for t in texts]
    n = np.array([len(d) for d in data], np.int64)
    windows = -(-n // WINDOW)
    sums = np.zeros((len(texts), len(net.labels)))
    if not windows.sum():
        return sums
    # Windows of each text, one behind the other; the last of each text is shorter.
    start = np.r_[0, np.cumsum(n)]
    owner = np.repeat(np.arange(len(texts)), windows)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    at, left = start[owner] + place, np.minimum(n[owner] - place, WINDOW)
    flat = np.frombuffer(b"".join(data) + b" " * WINDOW, np.uint8)
    order = np.argsort(-left, kind="stable")  # full ones first, so that lanes of equal length come together
    for i in range(0, len(order), LANES):
        lanes = order[i : i + LANES]
        size = left[lanes]
        x = flat[at[lanes] + np.arange(int(size[0]))[:, None]]
        inside = np.arange(int(size[0]))[:, None] < size
        if not inside.all():
            x = np.where(inside, x, np.int16(PAD))
        p = net.probabilities(x)
        got = p.sum(axis=0) if inside.all() else (p * inside[:, None, :]).sum(axis=0)
        for k in range(len(net.labels)):
            sums[:, k] += np.bincount(owner[lanes], got[k], len(texts))
    return sums / np.maximum(n, 1)[:, None]


def network(docs: DataFrame, learns: Column) -> Network | None:
    """Trained on every label of the rows that learns is true of, about SAMPLE_ROWS rows a label (fewer of many labels), drawn by a hash of text and doc_id."""
    rows = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts, _ = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    labels = counts.count()
    if not labels:
        return None
    share = min(SAMPLE_ROWS, max(LEAST_ROWS, TOTAL_ROWS // labels))
    drawn = F.pmod(F.xxhash64("text", "doc_id"), F.greatest("n", F.lit(share)))
    at = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - 2000, F.lit(1))).cast("int")
    found = rows.join(F.broadcast(counts), "lang").withColumn("_drawn", drawn).where(F.col("_drawn") < share).select("lang", F.substring("text", at, F.lit(2000)).alias("text"), "_drawn")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_drawn", "text"))  # repeated rows are drawn alike
    got = sorted((r.lang, r.text) for r in found.withColumn("_nth", nth).where(F.col("_nth") <= 2 * share).select("lang", "text").collect())
    return trained([t for _, t in got], [l for l, _ in got])


def labelled(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score, of the column text alone."""

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = []
            for b in in_bytes([pa.RecordBatch.from_arrays([column], ["text"])], "text", CHUNK_BYTES):
                texts = b.column(0).to_pylist()
                pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                score[~letters] = 1
                at = np.flatnonzero(letters)
                if net is not None and len(at):
                    p = pooled(net, [texts[i] for i in at])
                    best = p.argmax(axis=1)
                    pred[at] = np.array(net.labels, object)[best]
                    score[at] = np.clip(p[np.arange(len(p)), best], 0, 1)
                parts.append(pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    small_batches(docs.sparkSession)
    return docs.withColumn("_predicted", predict("text")).select(*docs.columns, F.col("_predicted.lang_pred").alias("lang_pred"), F.col("_predicted.score").alias("score"))


def held_out() -> Column:
    """Rows that nothing is learned from: a third by doc_id; null where that is."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = network(docs, ~F.coalesce(held_out(), F.lit(True)))
    out = labelled(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters go, and those of which no label has LEAST_SCORE of the probability."""
    net = network(docs, ~F.coalesce(held_out(), F.lit(True)))
    bare = docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).withColumn("text", F.col(f"_{docs.columns.index('text')}"))
    kept = labelled(bare, net).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
