"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verishelf.llm._common import raw_bytes

UNKNOWN = "und"
#: Bytes of a window: states start afresh in each, in both directions.
WINDOW = 192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Two gated recurrent layers, forward [0] and backward [1], and a softmax over both states.

    table: what a byte adds to the update, reset and candidate gates (2, 256, 3h);
    inner: the recurrent weights (2, h, 3h); out: (2, h, labels); bias: (labels).
    """

    labels: list[str]
    table: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
        return cls(labels, draw(0.3, 2, 256, 3 * hidden), draw(hidden**-0.5, 2, hidden, 3 * hidden), draw(hidden**-0.5, 2, hidden, len(labels)), np.zeros(len(labels), dtype=np.float32))

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time.

        windows: (batch, time) bytes; target: the label's index of each window.
        """
        batch, time = windows.shape
        h_n = self.inner.shape[1]
        seq = np.stack([windows, windows[:, ::-1]]).transpose(0, 2, 1)  # direction, time, batch
        h = np.zeros((time + 1, 2, batch, h_n), dtype=np.float32)
        z, r, n, gn = (np.empty((time, 2, batch, h_n), dtype=np.float32) for _ in range(4))
        for t in range(time):
            x = np.stack([self.table[d][seq[d, t]] for d in (0, 1)])
            g = h[t] @ self.inner
            zr = _sigmoid(x[..., : 2 * h_n] + g[..., : 2 * h_n])
            z[t], r[t], gn[t] = zr[..., :h_n], zr[..., h_n:], g[..., 2 * h_n :]
            n[t] = np.tanh(x[..., 2 * h_n :] + r[t] * gn[t])
            h[t + 1] = n[t] + z[t] * (h[t] - n[t])
        ahead, back = h[1:, 0], h[1:, 1][::-1]
        logits = ahead @ self.out[0] + back @ self.out[1] + self.bias
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        loss = -np.log(p[:, np.arange(batch), target] + 1e-12).mean()
        p[:, np.arange(batch), target] -= 1
        p /= batch * time
        d_out = np.stack([np.einsum("tbh,tbl->hl", s, p, optimize=True) for s in (ahead, back)])
        d_state = np.stack([p @ self.out[0].T, (p @ self.out[1].T)[::-1]], axis=1)
        d_x = np.empty((time, 2, batch, 3 * h_n), dtype=np.float32)
        d_inner, dh = np.zeros_like(self.inner), np.zeros((2, batch, h_n), dtype=np.float32)
        for t in range(time - 1, -1, -1):
            dh = dh + d_state[t]
            dn = dh * (1 - z[t]) * (1 - n[t] ** 2)
            dz = dh * (h[t] - n[t]) * z[t] * (1 - z[t])
            dr = dn * gn[t] * r[t] * (1 - r[t])
            d_x[t] = np.concatenate([dz, dr, dn], axis=-1)
            dg = np.concatenate([dz, dr, dn * r[t]], axis=-1)
            d_inner += h[t].transpose(0, 2, 1) @ dg
            dh = dh * z[t] + dg @ self.inner.transpose(0, 2, 1)
        d_table = np.zeros_like(self.table)
        for d in (0, 1):
            at = seq[d].ravel()
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            d_table[d][used] = np.add.reduceat(d_x[:, d].reshape(-1, 3 * h_n)[order], first, axis=0)
        return float(loss), [d_table, d_inner, d_out, p.sum(axis=(0, 1))]

    def train(self, windows: np.ndarray, target: np.ndarray, *, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam over batches drawn at random, with a rate that falls to zero."""
        rng = np.random.default_rng(seed)
        weights = [self.table, self.inner, self.out, self.bias]
        m, v = ([np.zeros_like(w) for w in weights] for _ in (0, 1))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            _, grads = self.gradients(windows[pick], target[pick])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            now = rate * (1 - (step - 1) / steps)
            for w, g, a, b in zip(weights, grads, m, v, strict=True):
                g = g / max(1.0, norm)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)

    def _states(self, seq: np.ndarray, d: int) -> np.ndarray:
        """What direction d adds to the logits at each step: (time, labels, batch). seq: (time, batch)."""
        h_n = self.inner.shape[1]
        table, inner, out = (np.ascontiguousarray(w[d].T) for w in (self.table, self.inner, self.out))
        h = np.zeros((h_n, seq.shape[1]), dtype=np.float32)
        logits = np.empty((seq.shape[0], len(self.labels), seq.shape[1]), dtype=np.float32)
        for t in range(seq.shape[0]):
            x = table.take(seq[t], axis=1)
            g = inner @ h
            zr = x[: 2 * h_n]
            zr += g[: 2 * h_n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            n = x[2 * h_n :]
            n += zr[h_n:] * g[2 * h_n :]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:h_n]
            h += n
            np.matmul(out, h, out=logits[t])
        return logits

    def positions(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities at every position: (time, labels, batch); positions past a window's size are 0.

        windows: (batch, time) bytes, those past the size arbitrary.
        """
        time = windows.shape[1]
        t = np.arange(time)[:, None]
        turned = np.where(t < sizes, sizes - 1 - t, t)
        seq = np.ascontiguousarray(windows.T).astype(np.intp)
        back = self._states(np.take_along_axis(seq, turned, axis=0), 1)
        p = self._states(seq, 0)
        p += np.take_along_axis(back, turned[:, None, :], axis=0)
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p *= (t < sizes)[:, None, :]
        return p

    def label_positions(self, text: bytes) -> list[str]:
        """The likeliest label of each byte of a text."""
        if not text:
            return []
        windows, sizes, _ = cut_windows([text])
        best = self.positions(windows, sizes).argmax(axis=1)
        return [self.labels[k] for i, n in enumerate(sizes) for k in best[:n, i]]

    def pooled(self, texts: list[bytes], slice_bytes: int = 1 << 20) -> np.ndarray:
        """The mean probabilities over all positions of each text; zeros for empty texts.

        Windows are made from slices of the texts, so that a very long text takes no more memory than its bytes.
        """
        out = np.zeros((len(texts), len(self.labels)))
        step = max(1, slice_bytes // WINDOW) * WINDOW
        pieces = [(i, t[at : at + step]) for i, t in enumerate(texts) for at in range(0, len(t), step)]
        block = max(64, 8192 // len(self.labels))
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi][1]) <= step):
                size += len(pieces[hi][1])
                hi += 1
            windows, sizes, owner = cut_windows([p for _, p in pieces[lo:hi]])
            owner = np.array([i for i, _ in pieces[lo:hi]])[owner]
            order = np.argsort(-sizes, kind="stable")
            for at in (order[k : k + block] for k in range(0, len(order), block)):
                sums = self.positions(windows[at, : sizes[at[0]]], sizes[at]).sum(axis=0, dtype=np.float64)
                np.add.at(out, owner[at], sums.T)
            lo = hi
        return out / np.maximum(1, [[len(t)] for t in texts])


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts as windows of at most WINDOW bytes: bytes, sizes, owners."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-lens // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    sizes = np.minimum(WINDOW, lens[owner] - number * WINDOW)
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), dtype=np.uint8)
    begins = np.repeat(np.cumsum(lens) - lens, count) + number * WINDOW
    return flat[begins[:, None] + np.arange(WINDOW)] if len(owner) else np.zeros((0, WINDOW), dtype=np.uint8), sizes, owner


def train_lang_id(docs: DataFrame, trainable: Column, *, hidden: int = 8, max_windows: int = 6000, width: int = 96, steps: int = 300, batch: int = 128, rate: float = 0.02, max_labels: int = 1000, seed: int = 1) -> Network:
    """A network for the lang values of the rows where trainable holds and text and lang are not null.

    It learns from at most max_windows windows of `width` bytes, two from each drawn row at
    hashed places of its whole text; rows are drawn by a hash of their text, rarer languages
    more often, so that languages come in about equal shares. Repeated windows of a language and
    repeated texts count once. Without such rows the network has
    no labels. More than max_labels different values raise an error.
    """
    rows = docs.select("text", "lang").where(trainable).where("text is not null and lang is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    labels = sorted(counts)
    if not labels:
        return Network.fresh([], hidden, seed)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(n))])
    place = lambda j: F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(j), "text"), F.greatest(F.length("text") - width, F.lit(1))) + 1).cast("int"), width)
    # how far turns go until there are four times as many windows: two a text, spread evenly up to the language's number of texts
    reach, left = 0.0, 4.0 * max_windows + 64
    for k, n in enumerate(sorted(counts.values())):
        reach = left / (2 * (len(counts) - k))
        if reach <= n:
            break
        left -= 2 * n
    drawn = rows.select("lang", F.explode(F.array(place(0), place(1))).alias("piece")).withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "piece"), F.lit(1 << 40)) * share[F.col("lang")])
    got = drawn.where(F.col("turn") <= reach * (1 << 40)).distinct().orderBy("turn", "piece", "lang").limit(max_windows).collect()
    target = np.array([labels.index(r["lang"]) for r in got])
    windows = np.stack([np.frombuffer((r["piece"].encode() * width)[:width], dtype=np.uint8) for r in got])
    network = Network.fresh(labels, hidden, seed)
    network.train(windows, target, steps=steps, batch=batch, rate=rate, seed=seed)
    return network


def identify_languages(docs: DataFrame, network: Network, *, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score, from the whole text alone.

    score is the mean probability of lang_pred over all bytes. Null texts, texts without a
    letter, and all texts if the network has no labels, give "und" and 0. Rows don't affect
    each other; an empty table gives none. Kept columns called lang_pred or score make way for the results.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(network)
    ready = docs.select(*keep, F.col("text").alias("_lang_text"))
    kinds = dict(ready.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            texts = [t or b"" for t in raw_bytes(batch.column("_lang_text"))]
            best, score = [], []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 21):
                    size += len(texts[hi])
                    hi += 1
                p = net.pooled(texts[lo:hi]) if net.labels else None
                for i in range(lo, hi):
                    if p is None or not any(map(str.isalpha, texts[i].decode("utf-8", "replace"))):
                        best.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        k = int(p[i - lo].argmax())
                        best.append(net.labels[k])
                        score.append(min(1.0, float(p[i - lo, k])))
                lo = hi
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return ready.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double"]))
