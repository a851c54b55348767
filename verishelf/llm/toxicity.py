"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.llm._common import cut, drawn, raw_bytes

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Characters that stand in for letters.
LEET = str.maketrans("013457@$!|€", "oieastasile")
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[33, 63]], _CLASS[[44, 45, 46, 58, 59, 34, 39, 40, 41]], _CLASS[[35, 36, 37, 38, 42, 64, 94, 126]] = 4, 5, 6
_CLASS[128:] = 2
STEMS = (4, 5, 6, 7)
N_FEATURES = 17


def core(token: str) -> str:
    return _EDGE.sub("", token).lower()


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word itself and its longer beginnings."""
    return [f"={word}", *(word[:n] for n in STEMS if len(word) > n)]


class Attributes(dict):
    """Token to the row of its attributes, worked out once for each token that comes up."""

    LIMIT = 300_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.table = lexicon, np.zeros((4096, 6))

    def weight(self, word: str) -> float:
        get = self.lexicon.get
        best = get(f"={word}", 0.0)
        for n in STEMS:
            if len(word) <= n:
                break
            best = max(best, get(word[:n], 0.0))
        return best

    def __missing__(self, token: str) -> int:
        word = core(token)
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        weight, plain = self.weight(word) if word else 0.0, ""
        odd = bool(word) and not word.isalpha() and any(map(str.isalpha, word)) and any(not c.isalpha() and c not in "'’-." for c in word)
        if odd:
            plain = "".join(c for c in word.translate(LEET) if c.isalpha())
        hidden = self.weight(plain) if plain else 0.0
        known = max((self.lexicon.get(f"={x}", 0.0) for x in (word, plain) if x), default=0.0) if weight or hidden else 0.0
        self.table[row] = weight, word in SECOND_PERSON, odd, hidden, len(token) > 2 and token.isupper(), known
        self[token] = row
        return row

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The features of a whole text, N_FEATURES numbers."""
        out = np.zeros(N_FEATURES)
        if not text:
            return out
        if len(self) > self.LIMIT:
            self.clear()
        tokens = text.decode("utf-8", "replace").split()
        kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7)
        letters = max(1, kinds[1] + kinds[2])
        out[9:13] = kinds[1] / letters, 100 * kinds[4] / len(text), 100 * kinds[5] / len(text), 100 * kinds[6] / len(text)
        out[13] = text.count(b"!!") / len(text) * 100
        if not tokens:
            return out
        get = self.__getitem__
        ids = np.fromiter(map(get, tokens), dtype=np.int64, count=len(tokens))
        seen = self.table[ids]
        n = len(tokens)
        strong = np.maximum(seen[:, 0], seen[:, 3])
        hit = strong > 0
        you = np.flatnonzero(seen[:, 1])
        at = np.flatnonzero(hit)
        near = 0
        if len(you) and len(at):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.maximum(k - 1, 0)]), np.abs(at - you[np.minimum(k, len(you) - 1)]))
            near = int((gap <= 5).sum())
        out[0] = 100 * hit.sum() / n
        out[1] = len(np.unique(ids[hit]))
        out[2] = strong.sum() / math.sqrt(n)
        out[3] = strong.max()
        out[4] = math.log1p(hit.sum())
        out[5] = 100 * len(you) / n
        out[6] = near
        out[7] = 100 * seen[:, 2].sum() / n
        out[8] = (seen[:, 3] > 0).sum()
        out[14] = 100 * seen[:, 4].sum() / n
        out[15] = math.log1p(n)
        out[16] = len(np.unique(ids[seen[:, 5] > 0]))
        return out


# ---- trees ----------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees in heap order: feature (-1 at a leaf), cut-off and value of each node."""

    base: float
    feature: np.ndarray
    cutoff: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, c, v in zip(self.feature, self.cutoff, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(len(f).bit_length() - 1):
                inner = f[at] >= 0
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] > c[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += v[at]
        return total


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Newton boosting of the log loss on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    base, size = math.log(p / (1 - p)), 2 ** (depth + 1) - 1
    margin = np.full(len(x), base)
    trees = []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, cutoff, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        groups = {0: np.arange(len(x))}
        for i in range(size):
            if i not in groups:
                continue
            rows = groups.pop(i)
            gs, hs = g[rows].sum(), h[rows].sum()
            value[i] = rate * gs / (hs + ridge)
            best = 1e-3
            if 2 * i + 2 < size:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[i], cutoff[i] = gain[k], j, e[k]
                        split = b[rows, j] > k
                if feature[i] >= 0:
                    j, k = feature[i], np.searchsorted(edges[feature[i]], cutoff[i])
                    split = b[rows, j] > k
                    groups[2 * i + 1], groups[2 * i + 2] = rows[~split], rows[split]
            if feature[i] < 0:
                margin[rows] += value[i]
        trees.append((feature, cutoff, value))
    return Boosted(base, *(np.stack([t[k] for t in trees]) for k in range(3)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the mean scores of the blocks and their rates, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][k] + a[k] for k in range(3)]
    n = np.array([b[2] for b in blocks])
    return np.array([b[0] for b in blocks]) / n, np.array([b[1] for b in blocks]) / n


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


# ---- Spark ----------------------------------------------------------------------------------


def _lexicon(pos: Counter, neg: Counter, n1: int, n0: int) -> dict[str, float]:
    """Units far likelier in toxic texts: weight is the log of the smoothed ratio of rates."""
    out = {}
    for u, c in pos.items():
        p1, p0 = (c + 0.5) / (n1 + 1), (neg.get(u, 0) + 0.5) / (n0 + 1)
        p = (c + neg.get(u, 0) + 0.5) / (n1 + n0 + 1)
        if c >= 3 and p1 >= 4 * p0 and p1 - p0 >= 4.5 * math.sqrt(p * (1 - p) * (1 / (n1 + 1) + 1 / (n0 + 1))):
            out[u] = math.log(p1 / p0)
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, trainable, *, max_rows: int = 16_000, max_units: int = 40_000) -> ToxicityModel:
    """A model of labels.toxic from at most max_rows labelled rows (those of least hash) for which
    trainable(doc_id column) holds.

    Only these rows' texts are read for it, whole. The lexicon (at most max_units candidates) is
    counted in Spark; features are computed there too, and the driver gets N_FEATURES numbers a
    row. Two folds by hash: lexicon and trees of one fold judge the other's rows, and these
    held-out margins fit the calibration. Rows with null doc_id, label or other labels than 0
    and 1 are left out, and so are documents with both labels; all rows of a labelled doc_id have its label.
    Without both labels the score is the rate of label 1, 0 if there are none. The order of rows doesn't
    matter: reruns give the same model.
    """
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(trainable(F.col("doc_id")))
    picked = cut(picked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most"))
    some = drawn(picked, max_rows + 4 * math.isqrt(max_rows) + 16, "doc_id")  # and the limit sees no more than these
    picked = cut(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int")))
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", "fold"))  # max_rows rows are broadcast
    sizes = {(r["y"], r["fold"]): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    n1, n0 = sum(v for (y, _), v in sizes.items() if y), sum(v for (y, _), v in sizes.items() if not y)
    prior = n1 / max(1, n0 + n1)
    if not n1 or not n0:
        return ToxicityModel({}, None, (np.zeros(1), np.zeros(1)), prior)
    spark = docs.sparkSession

    def counter(wanted):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            allowed = wanted.value if wanted else None
            for batch in batches:
                got = (Counter(), Counter())
                for t, fold in zip(raw_bytes(batch.column("text")), batch.column("fold").to_pylist(), strict=True):
                    own = {u for w in {core(x) for x in t.decode("utf-8", "replace").split()} if w for u in units(w)}
                    got[fold].update(own if allowed is None else own & allowed)
                yield pa.RecordBatch.from_arrays([pa.array([u for c in got for u in c], pa.string()), pa.array([f for f, c in enumerate(got) for _ in c], pa.int32()), pa.array([n for c in got for n in c.values()], pa.int64())], names=["unit", "fold", "n"])

        return run

    def collected(df: DataFrame) -> tuple[Counter, Counter]:
        got = (Counter(), Counter())
        for r in df.toLocalIterator():
            got[0][r["unit"]], got[1][r["unit"]] = r["a"], r["b"]
        return got

    def counted(part: DataFrame, wanted=None) -> DataFrame:
        df = part.select("text", "fold").mapInArrow(counter(wanted), "unit string, fold int, n long")
        return df.groupBy("unit").agg(*(F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((0, "a"), (1, "b"))))

    pos = collected(counted(rows.where("y = 1")).where(F.col("a") + F.col("b") >= max(3, n1 // 150)).orderBy((F.col("a") + F.col("b")).desc(), "unit").limit(max_units))
    neg = collected(counted(rows.where("y = 0"), spark.sparkContext.broadcast(set(pos[0]))))
    by_fold = [_lexicon(pos[k], neg[k], sizes.get((1, k), 0), sizes.get((0, k), 0)) for k in (0, 1)]
    whole = _lexicon(pos[0] + pos[1], neg[0] + neg[1], n1, n0)
    lexicons = spark.sparkContext.broadcast(by_fold)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [Attributes(x) for x in lexicons.value]
        for batch in batches:
            x = [makers[1 - f](t).tolist() for t, f in zip(raw_bytes(batch.column("text")), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["y", "fold", "x"])

    table = rows.mapInArrow(describe, "y int, fold int, x array<double>").toArrow()
    x, y, fold = np.array(table.column("x").to_pylist()), table.column("y").to_numpy().astype(float), table.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same order in every run
    x, y, fold = x[order], y[order], fold[order]
    out = np.zeros(len(y))
    for k in (0, 1):
        own = fold == k
        out[own] = boost(x[~own], y[~own]).margin(x[own]) if 0 < y[~own].sum() < (~own).sum() else 0.0
    return ToxicityModel(whole, boost(x, y), isotonic(out, y), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of docs and toxicity: a score from 0 to 1 of the whole text.

    Null and empty texts are scored like others: they have no hits. Rows don't affect each other.
    A kept column called toxicity makes way for the score; an empty table gives none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "toxicity"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("_toxicity_text"))
    kinds = {f.name: f for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Attributes(held.value.lexicon)
        for batch in batches:
            x = np.stack([maker(t) for t in raw_bytes(batch.column("_toxicity_text"))]) if batch.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(held.value.score(x))], names=[*keep, "toxicity"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return ready.mapInArrow(run, StructType([*(kinds[k] for k in keep), StructField("toxicity", DoubleType())]))
