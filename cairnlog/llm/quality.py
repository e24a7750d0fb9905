"""Document quality by a byte-level convolutional network in numpy.

The bytes of the whole text are embedded; learned filters over 8 bytes slide in steps of 4, are
rectified, and are max-pooled inside overlapping chunks that cover the document. The chunks' maxima
are combined, by their maximum and their mean, into one vector, and a small layer turns that into
the probability that the document is good. Neither the number of chunks nor the text's length is
limited; a text is worked through piece by piece.

The network is fitted on the driver on a bounded sample of labelled whole texts of any length (FIT_ROWS,
FIT_BYTES), never on the held-out fold, and has a few thousand weights, which go out with the tasks.

Defined results: a null text is an empty one, and an empty text has a score like any other; without
labelled rows of both kinds the score is the share of good ones (0.5 without any); repeated rows are
scored each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlog.llm.common import held_out, labelled_sample, small_batches

#: The sample that the network is fitted on: rows at most, and bytes of all its texts together after which no more are added.
FIT_ROWS, FIT_BYTES = 3000, 128 << 20
#: Passes over the sample; a small one's go on up to so many steps, or bytes of text gone through.
EPOCHS, LEAST_STEPS, LEAST_BYTES = 20, 800, 64 << 20
KEEP_AT = 0.3
EMBED, FILTERS, HIDDEN = 8, 24, 16
STEP = 4  # bytes from one position to the next; a filter sees two steps
UNIT = 32  # positions pooled first
CHUNK, STRIDE = 4, 3  # units of a chunk, and from one chunk to the next
PIECE = 1 << 18  # bytes that are embedded at a time


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each padded with zeros to whole units (one padded step at least), and the texts' units."""
    unit = STEP * UNIT
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    units = np.array([(len(r) + STEP) // unit + 1 if (len(r) + STEP) % unit else (len(r) + STEP) // unit for r in raw], np.int64)
    return np.frombuffer(b"".join(r.ljust(n * unit, b"\0") for r, n in zip(raw, units.tolist())), np.uint8), units


def chunk_starts(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every chunk the first unit and the last that its document has, and of every document its first chunk."""
    n = np.maximum(1, -(-(units - CHUNK) // STRIDE) + 1)
    first = np.cumsum(n) - n
    begin = np.cumsum(units) - units
    starts = np.repeat(begin, n) + STRIDE * (np.arange(n.sum()) - np.repeat(first, n))
    return starts, np.repeat(begin + units - 1, n), first


class ByteNet:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) * np.sqrt(2.0 / s[0])).astype(np.float32)
        self.p = {
            "E": (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
            "W1": w(STEP * EMBED, FILTERS), "W2": w(STEP * EMBED, FILTERS), "b": np.zeros(FILTERS, np.float32),
            "H": w(2 * FILTERS, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "o": w(HIDDEN, 1), "d": np.zeros(1, np.float32),
        }

    def _units(self, data: np.ndarray, units: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The rectified maxima of every unit and filter and, if asked for, their positions, computed piece by piece.

        A text's last step looks at nothing: its activations are 0. The last bits of an activation make room
        for its place in the unit, so that one maximum finds both; equal up to those bits, the first counts.
        """
        p, top, where = self.p, [], []
        last = np.cumsum(units) * UNIT - 1
        both = np.hstack([p["W1"], p["W2"]])
        back = np.arange(UNIT - 1, -1, -1, dtype=np.int32)[None, :, None]
        for i in range(0, len(data), PIECE):
            part = data[i : i + PIECE + STEP]  # one step more, which the last position looks at
            seen = np.take(p["E"], part, axis=0).reshape(-1, STEP * EMBED) @ both
            z = seen[:, :FILTERS] + p["b"]
            z[:-1] += seen[1:, FILTERS:]
            z = z[: min(PIECE, len(data) - i) // STEP]
            first = i // STEP
            z[last[np.searchsorted(last, first) : np.searchsorted(last, first + len(z))] - first] = 0
            z = np.maximum(z, 0, out=z).reshape(-1, UNIT, FILTERS)
            top.append(z.max(1))
            if places:
                code = z.astype(np.float32, copy=False).view(np.int32) & ~(UNIT - 1) | back
                where.append(UNIT - 1 - (code.max(1) & (UNIT - 1)) + first + UNIT * np.arange(len(z))[:, None])
        if not top:
            return np.empty((0, FILTERS), np.float32), np.empty((0, FILTERS), np.int64)
        return np.concatenate(top), np.concatenate(where) if places else np.empty((0, FILTERS), np.int64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        data, units = lay_out(texts)
        m, _ = self._units(data, units)
        starts, last, first = chunk_starts(units)
        c = m[starts]
        for k in range(1, CHUNK):
            np.maximum(c, m[np.minimum(starts + k, last)], out=c)
        n = np.diff(np.append(first, len(starts)))[:, None]
        x = np.hstack([np.maximum.reduceat(c, first), np.add.reduceat(c, first, dtype=np.float64) / n]).astype(np.float32)
        h = np.maximum(x @ self.p["H"] + self.p["c"], 0)
        y = (h @ self.p["o"] + self.p["d"])[:, 0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))

    def gradients(self, texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. Only the positions that won their chunk pass anything on, so memory is that of the chunks."""
        p = self.p
        data, units = lay_out(texts)
        m, where = self._units(data, units, places=True)
        starts, last, first = chunk_starts(units)
        options = np.minimum(starts[:, None] + np.arange(CHUNK), last[:, None])
        unit_of = np.take_along_axis(options, m[options].argmax(1), 1)  # [chunk, filter]
        c = np.take_along_axis(m, unit_of, 0)
        n = np.diff(np.append(first, len(starts)))
        doc = np.repeat(np.arange(len(texts)), n)
        top, mean = np.maximum.reduceat(c, first), np.add.reduceat(c, first) / n[:, None]
        x = np.hstack([top, mean])
        a = x @ p["H"] + p["c"]
        h = np.maximum(a, 0)
        y = (h @ p["o"] + p["d"])[:, 0]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dy = ((1 / (1 + np.exp(-np.clip(y, -30, 30)))) - labels).astype(np.float32)[:, None] / len(texts)
        g["o"], g["d"] = h.T @ dy, dy.sum(0)
        da = (dy @ p["o"].T) * (a > 0)
        g["H"], g["c"] = x.T @ da, da.sum(0)
        dx = da @ p["H"].T
        is_top = c == top[doc]
        ties = np.add.reduceat(is_top.astype(np.float32), first)
        dc = ((dx[:, FILTERS:] / n[:, None])[doc] + is_top * (dx[:, :FILTERS] / ties)[doc]) * (c > 0)
        g["b"] = dc.sum(0).astype(np.float32)
        # gradients by filter, byte of the window and its value: weights and embedding follow from these sums.
        # A position with a gradient is none of a text's last, so the step after it is the text's own.
        steps, slot = data.reshape(-1, STEP), np.arange(FILTERS)[:, None] * 2 * STEP + np.arange(2 * STEP)
        sums = np.zeros(slot.size * 256)
        position = np.take_along_axis(where, unit_of, 0)
        for i in range(0, len(dc), 8192):
            at = position[i : i + 8192]
            seen = np.concatenate([steps[at], steps[np.minimum(at + 1, len(steps) - 1)]], 2)
            sums += np.bincount((slot * 256 + seen).ravel(), np.repeat(dc[i : i + 8192].ravel(), 2 * STEP), len(sums))
        sums = sums.reshape(FILTERS, 2 * STEP, 256).astype(p["E"].dtype)
        for w, part in (("W1", sums[:, :STEP]), ("W2", sums[:, STEP:])):
            g[w] = (part @ p["E"]).transpose(1, 2, 0).reshape(STEP * EMBED, FILTERS)
            g["E"] += np.einsum("fsb,sdf->bd", part, p[w].reshape(STEP, EMBED, FILTERS), optimize=True)
        g["E"][0] = 0
        return g

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 3e-3, seed: int = 1):
        """Adam on the log loss."""
        r, labels = np.random.default_rng(seed), np.asarray(labels, np.float32)
        size = sum(len(t.encode("utf-8", "surrogatepass")) for t in texts)
        epochs = max(epochs, min(-(-LEAST_STEPS * batch // len(texts)), LEAST_BYTES // max(1, size)))
        self.p["E"][0] = 0  # padding
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        var = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                step += 1
                now = rate * (0.5 + 0.5 * np.cos(np.pi * step / steps))
                for k, v in self.gradients([texts[j] for j in some], labels[some]).items():
                    mean[k] += 0.1 * (v - mean[k])
                    var[k] += 0.001 * (v * v - var[k])
                    self.p[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
        return self


class Share:
    """Stands in where the labels are all of one kind or missing."""

    def __init__(self, labels: list[int]):
        self.value = (sum(labels) + 1) / (len(labels) + 2)

    def score(self, texts):
        return np.full(len(texts), self.value)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, total_bytes: int = FIT_BYTES):
    sample = labelled_sample(docs, labels, "quality", rows, total_bytes)
    y = [label for _, label in sample]
    if len(set(y)) < 2:
        return Share(y)
    return ByteNet().fit([text for text, _ in sample], y)


def scored(docs: DataFrame, model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _scores(model, b.column("text"))], ["doc_id", "score"])

    out = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted")
    )


def kept(docs: DataFrame, model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, whose text scores `keep_at` or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pc.greater_equal(_scores(model, b.column(at)), keep_at))

    return docs.mapInArrow(run, docs.schema)


def _scores(model, texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.string()).to_pylist()
    return pa.array(np.concatenate([model.score(texts[i : i + 64]) for i in range(0, len(texts), 64)] or [np.empty(0)]), pa.float64())
