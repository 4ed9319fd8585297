"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in overlapping windows of bytes; in each, one GRU runs forward and one backward, and every position gets
language probabilities from both states, by the window in which it has context on both sides.  A document's
probabilities are the mean over all its positions.  The network is trained here, in numpy, by backpropagation through
time, on whole texts of a bounded sample of labelled documents, cut in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, crc32_text, table, texts_of

#: Bytes of a window, those at an inner edge that only give context, units of each direction, windows that run at once.
WINDOW, EDGE, UNITS, LANES = 128, 16, 8, 2048
STRIDE = WINDOW - 2 * EDGE
#: The training sample: whole texts of at most about so many documents, each of so many bytes at most.
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 1 << 20
#: Passes over the sample, and the fewest steps that a small sample gets.
EPOCHS, LEAST_STEPS, BATCH, RATE = 2, 160, 256, 0.02
UNDETERMINED = "und"

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace")))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class BiGRU:
    """Directions are the first axis of all weights.  Bytes have their gates' inputs in tables (embedding and weights in one)."""

    def __init__(self, langs: list[str], units: int = UNITS, seed: int = 7):
        rnd = np.random.default_rng(seed)
        c, h = len(langs), units
        self.langs = langs
        self.w = {
            "gates": rnd.normal(0, 0.4, (2, 256, 2 * h)), "cand": rnd.normal(0, 0.4, (2, 256, h)),
            "u_gates": rnd.normal(0, h**-0.5, (2, h, 2 * h)), "u_cand": rnd.normal(0, h**-0.5, (2, h, h)), "b_cand": np.zeros((2, 1, h)),
            "out": rnd.normal(0, h**-0.5, (2, h, c)), "bias": np.zeros(c),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (2, T, N, units) over bytes x (T, N), at index t for position t in either direction; with keep, what training needs."""
        w, (t_all, n) = self.w, x.shape
        h_units = w["u_cand"].shape[1]
        kind = w["bias"].dtype
        h = np.zeros((2, n, h_units), kind)
        states, kept = np.empty((2, t_all, n, h_units), kind), []
        gates, cand = np.zeros((2, n, 2 * h_units), kind), np.zeros((2, n, h_units), kind)
        for t in range(t_all):
            ends = x[t], x[t_all - 1 - t]
            for d in (0, 1):
                np.take(w["gates"][d], ends[d], axis=0, out=gates[d], mode="clip")
                np.take(w["cand"][d], ends[d], axis=0, out=cand[d], mode="clip")
            g = sigmoid(gates + h @ w["u_gates"])
            z, r = g[:, :, :h_units], g[:, :, h_units:]
            u = h @ w["u_cand"]
            u += w["b_cand"]
            c = r * u
            c += cand
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if keep:
                kept.append((h, g, u, c))
            h = new
            states[0, t], states[1, t_all - 1 - t] = h[0], h[1]
        return states, kept

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Language probabilities (T, N, languages) of every position."""
        p = states[0] @ self.w["out"][0]
        p += states[1] @ self.w["out"][1]
        p += self.w["bias"]
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients: cross entropy, mean over the positions that mask (T, N) has, of windows x with languages y."""
        w = self.w
        hs = w["u_cand"].shape[1]
        states, kept = self.run(x, keep=True)
        p = self.positions(states)
        weight = mask / max(1, mask.sum())
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0] + 1e-9) * weight).sum())
        d = p
        d[:, np.arange(len(y)), y] -= 1
        d *= weight[:, :, None].astype(d.dtype)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["bias"] = d.sum(axis=(0, 1))
        for k in (0, 1):
            grad["out"][k] = np.tensordot(states[k], d, ((0, 1), (0, 1)))
        into = np.stack([d @ w["out"][0].T, d @ w["out"][1].T])
        dh = np.zeros_like(kept[0][0])
        t_all = len(x)
        u_gates_t, u_cand_t = w["u_gates"].transpose(0, 2, 1), w["u_cand"].transpose(0, 2, 1)
        d_gates, d_cand = np.empty((t_all, 2, x.shape[1], 2 * hs), dh.dtype), np.empty((t_all, 2, x.shape[1], hs), dh.dtype)
        for t in range(t_all - 1, -1, -1):
            h, g, u, c = kept[t]
            z, r = g[:, :, :hs], g[:, :, hs:]
            dh[0] += into[0, t]
            dh[1] += into[1, t_all - 1 - t]
            dc = dh * (1 - z) * (1 - c * c)
            dg = np.concatenate([dh * (h - c), dc * u], 2) * g * (1 - g)
            du = dc * r
            d_gates[t], d_cand[t] = dg, dc
            grad["u_gates"] += h.transpose(0, 2, 1) @ dg
            grad["u_cand"] += h.transpose(0, 2, 1) @ du
            grad["b_cand"] += du.sum(axis=1, keepdims=True)
            dh = dh * z + dg @ u_gates_t + du @ u_cand_t
        for k in (0, 1):
            at = (x if k == 0 else x[::-1]).ravel()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
            for name, values in (("gates", d_gates), ("cand", d_cand)):
                grad[name][k][at[order][first]] = np.add.reduceat(values[:, k].reshape(len(at), -1)[order], first, axis=0)
        return loss, grad

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, size: int = BATCH, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over the shuffled windows of whole texts, with a falling rate; returns the losses."""
        windows = Windows(texts)
        count = len(windows.owner)
        rnd, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        epochs = max(epochs, -(-LEAST_STEPS // -(-count // size)))
        steps = epochs * -(-count // size)
        for _ in range(epochs):
            order = rnd.permutation(count)
            for at in range(0, count, size):
                pick = order[at : at + size]
                loss, grad = self.gradients(windows.bytes_of(pick), windows.mask_of(pick), labels[windows.owner[pick]])
                losses.append(loss)
                norm = np.sqrt(sum(float((a * a).sum()) for a in grad.values()))
                step += 1
                pace = rate * (1 - 0.9 * step / steps)
                for k, a in grad.items():
                    a = a * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (text, language); texts are whole, empty ones get zeros."""
        windows = Windows(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(windows.owner), LANES):
            pick = np.arange(at, min(at + LANES, len(windows.owner)))
            p = self.positions(self.run(windows.bytes_of(pick))[0])
            p *= windows.mask_of(pick)[:, :, None]
            np.add.at(total, windows.owner[pick], p.sum(axis=0, dtype=np.float64))
        return total / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


class Windows:
    """Overlapping windows of texts: owner is the text of each; a window answers for the positions low to high in it, so
    that each byte of a text is in exactly one window's share, EDGE bytes or more from an inner edge."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(x) for x in texts], np.int64)
        counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
        spans = np.where(counts > 0, (counts - 1) * STRIDE + WINDOW, 0)
        self.raw = np.frombuffer(b"".join(x.ljust(n, b"\0") for x, n in zip(texts, spans.tolist())), np.uint8)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        last = k == counts[self.owner] - 1
        self.start = (np.cumsum(spans) - spans)[self.owner] + k * STRIDE
        self.low = np.where(k == 0, 0, EDGE)
        self.high = np.where(last, sizes[self.owner] - k * STRIDE, WINDOW - EDGE)

    def bytes_of(self, pick: np.ndarray) -> np.ndarray:
        return self.raw[self.start[pick][None, :] + np.arange(WINDOW)[:, None]]

    def mask_of(self, pick: np.ndarray) -> np.ndarray:
        at = np.arange(WINDOW)[:, None]
        return ((at >= self.low[pick]) & (at < self.high[pick])).astype(np.float32)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, key: str, text: str, lang: str, most: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(language, whole text) of documents that aren't held out: as many of each language, most in all or so."""
    part = F.coalesce(~held_out(F.col(f"`{key}`")), F.lit(False))
    labelled = docs.filter(part).select(F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").cast("binary").alias("t")).filter("l is not null")
    labelled = labelled.filter(f"length(t) between 1 and {SAMPLE_BYTES}")
    counts = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most).collect()}
    if not counts:
        return []
    share = max(1, most // len(counts))
    # of each language the documents with the least hashes, about share of them, wherever in the table they are
    rate = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, share / n))))
    chosen = labelled.filter(F.col("l").isin(list(counts))).filter(F.pmod(F.xxhash64("k"), F.lit(1 << 52)) < rate[F.col("l")] * float(1 << 52))
    rows = sorted(((r.k, r.l, bytes(r.t)) for r in chosen.collect()), key=lambda x: (x[0], x[1], x[2]))
    return [(lang, x) for _, lang, x in rows if has_letter(x)]


def fit(pairs: list[tuple[str, bytes]]) -> BiGRU | None:
    if not pairs:
        return None
    langs = sorted({lang for lang, _ in pairs})
    net = BiGRU(langs)
    net.train([x for _, x in pairs], np.array([langs.index(lang) for lang, _ in pairs]))
    return net


def identify(docs: DataFrame, net: BiGRU | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per input row, map-side only.

    A null text, and one without any letter, is "und" with score 0, as is every text when there was nothing to learn
    from.  Of equal probabilities the first language by name wins.  held_out is null for a null key.  Repeated rows
    are each labelled; a long text is read whole; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [x if net and has_letter(x) else b"" for x in texts]
            best, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if net and any(texts):
                p = net.predict(texts)
                best = [net.langs[k] if x else UNDETERMINED for k, x in zip(p.argmax(axis=1).tolist(), texts)]
                score = np.clip(p.max(axis=1), 0, 1).tolist()
            yield batch(_OUT, b.column(0), [None if i is None else crc32_text(i) % 5 == 0 for i in ids], best, score)

    return texts_of(docs, key, text).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(sample(docs, "doc_id", "text", "lang")))
