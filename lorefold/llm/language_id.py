"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialise, pieces, seeded_bits, table

#: Training sample: documents of each language, the longest text in bytes among them, and the languages that are learned, those of most documents.
SAMPLE, SAMPLE_BYTES, LANGUAGES = 150, 32_768, 500
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 220, 96, 0.02, 2
#: A text goes through the network in windows of CORE bytes, whose labels count, after and before MARGIN bytes of context, whose labels are those of other windows' cores.
CORE, MARGIN = 448, 32
#: Windows that go through at once, and bytes of a training window.
AT_ONCE, SHORT = 768, 96


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the squashing function of the layer, much cheaper than tanh; gates are half of it plus a half."""
    return x / (1 + np.abs(x))


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """_soft() in place, with room for the divisors."""
    np.abs(x, out=room)
    room += 1
    x /= room


@dataclass
class Gated:
    """One direction of a gated recurrent layer over bytes: an input table in place of one-hot products, recurrent weights, and a bias on the candidate's recurrent part."""

    table: np.ndarray  # 257 x 3H: update, reset, candidate
    u: np.ndarray  # H x 3H
    b: np.ndarray  # H

    @staticmethod
    def start(hidden: int, rng: np.random.Generator) -> Gated:
        return Gated((rng.standard_normal((257, 3 * hidden)) * 0.3).astype("f4"), (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype("f4"), np.zeros(hidden, dtype="f4"))

    def forward(self, ids: np.ndarray, mask: np.ndarray):
        """States T x B x H for ids T x B; where the mask is 0 the state stays. Also what backward() needs."""
        h = np.zeros((ids.shape[1], len(self.b)), dtype="f4")
        n, states, cache = len(self.b), [], []
        for t in range(len(ids)):
            x, a = self.table[ids[t]], h @ self.u
            soft = _soft(x[:, : 2 * n] + a[:, : 2 * n])
            zr = 0.5 + 0.5 * soft
            z, r = zr[:, :n], zr[:, n:]
            inner = a[:, 2 * n :] + self.b
            c = _soft(x[:, 2 * n :] + r * inner)
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            cache.append((h, z, r, inner, c, m, 0.5 * (1 - np.abs(soft)) ** 2))
            states.append(new)
            h = new
        return np.stack(states), cache

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The states of forward() alone, in buffers that are used again."""
        steps, batch = ids.shape
        n = len(self.b)
        out = np.empty((steps, batch, n), dtype="f4")
        in_gates, in_candidate = np.ascontiguousarray(self.table[:, : 2 * n]), np.ascontiguousarray(self.table[:, 2 * n :])
        u_gates, u_candidate = np.ascontiguousarray(self.u[:, : 2 * n]), np.ascontiguousarray(self.u[:, 2 * n :])
        h = np.zeros((batch, n), dtype="f4")
        x, gates, wide = (np.empty((batch, 2 * n), dtype="f4") for _ in range(3))
        y, c, narrow = (np.empty((batch, n), dtype="f4") for _ in range(3))
        whole = mask.all(axis=1)
        for t in range(steps):
            np.take(in_gates, ids[t], axis=0, out=x, mode="clip")
            np.matmul(h, u_gates, out=gates)
            gates += x
            _squash(gates, wide)
            gates *= 0.5
            np.take(in_candidate, ids[t], axis=0, out=y, mode="clip")
            np.matmul(h, u_candidate, out=c)
            c += self.b
            np.add(gates[:, n:], 0.5, out=narrow)
            c *= narrow
            c += y
            _squash(c, narrow)
            c -= h
            np.subtract(0.5, gates[:, :n], out=narrow)
            c *= narrow
            if not whole[t]:
                c *= mask[t][:, None]
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def backward(self, ids: np.ndarray, cache: list, grad: np.ndarray) -> Gated:
        """Gradients, given those of the states, by backpropagation through time."""
        n = len(self.b)
        g = Gated(np.zeros_like(self.table), np.zeros_like(self.u), np.zeros_like(self.b))
        dh = np.zeros_like(grad[0])
        inputs = np.empty((*ids.shape, 3 * n), dtype="f4")
        for t in reversed(range(len(ids))):
            h, z, r, inner, c, m, slope = cache[t]
            dh = dh + grad[t]
            dc = dh * m * (1 - z) * (1 - np.abs(c)) ** 2
            dzr = np.concatenate([dh * m * (h - c), dc * inner], axis=1) * slope
            inputs[t, :, : 2 * n], inputs[t, :, 2 * n :] = dzr, dc
            da = np.concatenate([dzr, dc * r], axis=1)
            g.u += h.T @ da
            g.b += (dc * r).sum(axis=0)
            dh = dh * (1 - m * (1 - z)) + da @ self.u.T
        order = np.argsort(ids, axis=None, kind="stable")
        seen, first = np.unique(ids.ravel()[order], return_index=True)
        g.table[seen] = np.add.reduceat(inputs.reshape(-1, 3 * n)[order], first, axis=0)
        return g


def pad(spans: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids and mask, both T x B; 256 is padding."""
    longest = max(map(len, spans))
    raw = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in spans), dtype=np.uint8).reshape(len(spans), longest).T
    mask = (np.arange(longest)[:, None] < np.array([len(s) for s in spans])[None, :]).astype("f4")
    return np.where(mask > 0, raw, 256).astype(np.int64), mask


@dataclass
class Labeller:
    """Languages, both directions and the output layer."""

    languages: list[str]
    left: Gated
    right: Gated
    out: np.ndarray  # 2H x C
    bias: np.ndarray  # C

    def positions(self, ids: np.ndarray, mask: np.ndarray):
        """Probabilities T x B x C of every position, with what training needs."""
        a, left = self.left.forward(ids, mask)
        b, right = self.right.forward(ids[::-1], mask[::-1])
        both = np.concatenate([a, b[::-1]], axis=2)
        y = both @ self.out + self.bias
        p = np.exp(y - y.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True), both, left, right

    def sums(self, parts: Sequence[tuple[bytes, int, int]]) -> np.ndarray:
        """For each (window, first, end), the sums of the probabilities of the positions from `first` to before `end`."""
        out = np.zeros((len(parts), len(self.languages)))
        order = sorted(range(len(parts)), key=lambda i: len(parts[i][0]))
        n = len(self.left.b)
        for at in range(0, len(order), AT_ONCE):
            some = order[at : at + AT_ONCE]
            ids, mask = pad([parts[i][0] for i in some])
            a, b = self.left.states(ids, mask), self.right.states(ids[::-1], mask[::-1])[::-1]
            first, end = (np.array([parts[i][k] for i in some]) for k in (1, 2))
            for t in range(int(first.min()), int(end.max()), 32):
                u = min(t + 32, len(ids))
                y = a[t:u].reshape(-1, n) @ self.out[:n] + b[t:u].reshape(-1, n) @ self.out[n:] + self.bias
                p = np.exp(np.minimum(y, 80, out=y), out=y)
                at_t = np.arange(t, u)[:, None]
                inside = ((first <= at_t) & (at_t < end)).astype("f4").ravel()
                p *= (inside / (p @ np.ones(len(self.languages), dtype="f4")))[:, None]
                out[some] += p.reshape(u - t, len(some), -1).sum(axis=0)
        return out


def train(samples: Sequence[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Labeller:
    """Fit to (text, language) samples: every position of a window of SHORT bytes is to carry its text's language. Adam on the mean cross-entropy; languages, their texts and
    the places of windows are drawn evenly."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    of = [[s for s, lang in samples if lang == one] for one in languages]
    net = Labeller(languages, Gated.start(hidden, rng), Gated.start(hidden, rng), (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype("f4"), np.zeros(len(languages), dtype="f4"))
    weights = [net.left.table, net.left.u, net.left.b, net.right.table, net.right.u, net.right.b, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        texts = [of[k][rng.integers(0, len(of[k]))] for k in y]
        ids, mask = pad([t[(at := int(rng.integers(0, max(1, len(t) - SHORT)))) : at + SHORT] for t in texts])
        p, both, left, right = net.positions(ids, mask)
        p[:, np.arange(batch), y] -= 1
        p *= (mask / mask.sum())[:, :, None]
        dboth = p @ net.out.T
        gl, gr = net.left.backward(ids, left, dboth[:, :, :hidden]), net.right.backward(ids[::-1], right, dboth[::-1, :, hidden:])
        grads = [gl.table, gl.u, gl.b, gr.table, gr.u, gr.b, np.tensordot(both, p, axes=([0, 1], [0, 1])), p.sum(axis=(0, 1))]
        lr = rate * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return net


def windows_of(data: bytes) -> list[tuple[bytes, int, int]]:
    """A text's bytes as overlapping windows (bytes, first, end): each byte lies in [first, end) of one window, with up to MARGIN bytes around that."""
    out = []
    for at in range(0, len(data), CORE):
        low = max(0, at - MARGIN)
        out.append((data[low : at + CORE + MARGIN], at - low, min(at + CORE, len(data)) - low))
    return out


def _predict(net: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            parts: list[tuple[bytes, int, int]] = []
            ends = []
            for text, letters in zip(b.column("text").to_pylist(), b.column("letters").to_pylist(), strict=True):
                parts += windows_of(text.encode("utf-8", "surrogatepass")) if letters else []
                ends.append(len(parts))
            total = np.concatenate([np.zeros((1, len(net.languages))), np.cumsum(net.sums(parts), axis=0)])
            lang, score = [], []
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                p = total[end] - total[start]
                lang.append(net.languages[int(p.argmax())] if end > start else "und")
                score.append(float(min(1.0, max(0.0, p.max() / p.sum()))) if end > start else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> Labeller | None:
    """Train on at most `sample` documents (text, lang) of each language, the first by a seeded hash of doc_id among those of at most sample_bytes; null without any.

    The `languages` languages of most such documents are learned, ties going to the first by name; documents of others get the learned one that they resemble.
    So the driver holds sample * sample_bytes * languages bytes at most, at any size of docs. Hashes are ranked first, without texts; then only the chosen texts move.
    """
    h, same = seeded_bits(SEED, F.col("doc_id")).alias("h"), F.xxhash64("text").alias("same")
    known = docs.where(F.col("lang").isNotNull() & F.octet_length("text").between(1, sample_bytes)).select("text", "lang", F.struct(h, same).alias("at"))
    narrow = materialise(known.select("lang", "at"), "language-ranks")
    learned = narrow.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    order = Window.partitionBy("lang").orderBy("at")
    ranked = narrow.join(F.broadcast(learned), "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    last = ranked.groupBy("lang").agg(F.max("at").alias("last"))
    near = known.join(F.broadcast(last), "lang").where("at <= last").select("lang", "text", "at", "at.h")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    rows = sorted(chosen.select("lang", "h", "text").collect())
    samples = [(r["text"].encode("utf-8", "surrogatepass"), r["lang"]) for r in rows]
    return train(samples) if samples else None


def identify(docs: DataFrame, net: Labeller | None, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text).

    The network labels every byte of the whole text, with its state crossing white space (see windows_of); a document's probabilities are the mean over its
    positions, the score is the largest. A task works on a few megabytes of texts at a time, and the windows of a long text go through in turn.
    A text that is null or has no letter is `und` with score 0, and so is all without a trained language. Repeated rows are predicted alike;
    a null doc_id isn't held out. Extra columns play no part.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select("doc_id", "text", letters, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 5)
    return identify(docs, fit(docs.where(fold != 0)), fold == 0)


SQL: dict[str, str] = {}
