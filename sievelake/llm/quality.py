"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `WIDTH` tokens; each passage is encoded from its own features, a gated attention
(tanh times sigmoid) learned from document labels alone weighs the encodings, and their weighted sum is scored. The network is
fitted on the driver over whole documents, at most `most` of them (a documented bound, drawn by hash); every whole text is scored
where it lies.

Defined results: null and empty texts are one empty passage, scored like any other; without labels of both kinds the score is the
share of good labels (0 without labels); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches, crc_mod
from sievelake.llm.labelled import labelled, sample

WIDTH = 50
NAMES = ("letters", "capitals", "digits", "signs", "bars", "exclaimed", "stops", "commas", "length", "sign_runs", "distinct", "short", "shouted", "one_sign", "repeated_lines", "tokens", "lines")
_SIGN_RUN = re.compile(r"[^\w\s]{2,}")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SIGNS = re.compile(r"[^\w\s.,]")


def passages(text: str | None) -> np.ndarray:
    """Features of each passage, the last two of them and the repeated lines those of the whole text."""
    tokens = (text or "").split()
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    whole = (1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(tokens)), len(lines) / max(1, len(tokens)))
    out = []
    for i in range(0, len(tokens), WIDTH):
        own = tokens[i : i + WIDTH]
        n, joined = len(own), "".join(own)
        size = len(joined)
        signs = len(_SIGNS.findall(joined))
        capitals = len(_CAPITALS.findall(joined))
        digits = sum(map(joined.count, "0123456789"))
        stops, commas = joined.count("."), joined.count(",")
        letters = max(1, size - signs - digits - stops - commas)
        out.append((
            letters / size, capitals / letters, digits / size, signs / size, joined.count("|") / n, joined.count("!") / n, stops / n, commas / n, size / n / 10,
            len(_SIGN_RUN.findall(" ".join(own))) / n, len(set(own)) / n, sum(len(w) < 4 for w in own) / n, sum(map(str.isupper, own)) / n, sum(len(w) == 1 and not w.isalnum() for w in own) / n, *whole,
        ))
    return np.array(out or [(0.0,) * len(NAMES)], np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class AttentionNetwork:
    """Encoder, gated attention and head, trained by Adam on bags of unequal size."""

    def __init__(self, features: int, hidden: int = 16, gate: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread, self.seed = np.zeros(features), np.ones(features), seed
        draw = lambda a, b: rng.normal(0, 1 / math.sqrt(a), (a, b))
        self.p = {"w": draw(features, hidden), "wb": np.zeros(hidden), "v": draw(hidden, gate), "vb": np.zeros(gate), "u": draw(hidden, gate), "ub": np.zeros(gate), "a": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "cb": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["w"] + p["wb"])
        t, s = np.tanh(h @ p["v"] + p["vb"]), _sigmoid(h @ p["u"] + p["ub"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return sizes, h, t, s, a, z, z @ p["c"] + p["cb"][0]

    def predict(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward((x - self.mean) / self.spread, starts)[-1])

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes, h, t, s, a, z, logit = self.forward(x, starts)
        d = (_sigmoid(logit) - y) / len(y)
        dz = np.repeat(d, sizes)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "wb": dh.sum(0), "v": h.T @ dt, "vb": dt.sum(0), "u": h.T @ ds, "ub": ds.sum(0), "a": (t * s).T @ de, "c": z.T @ d, "cb": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> None:
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(0), every.std(0) + 1e-3
        bags = [(b - self.mean) / self.spread for b in bags]
        rng = np.random.default_rng(self.seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                starts = np.cumsum([0, *(len(bags[i]) for i in own[:-1])])
                step += 1
                pace = rate * (1 - step / (steps + 1))
                for k, g in self.gradient(np.concatenate([bags[i] for i in own]), starts, y[own]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


class Model:
    def __init__(self, network: AttentionNetwork | None, share: float):
        self.network, self.share = network, share

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.share)
        bags = [passages(t) for t in texts]
        found = self.network.predict(np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])]))
        return np.round(found, 12)  # the last digits follow the batch's shape


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8000, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learn from the labelled ids whose crc32 modulo 5 is not 0."""
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            made = [passages(t).tobytes() for t in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(2), pa.array(made, pa.binary())], names=["i", "y", "x"])

    own = labelled(docs, sample(labels, label, crc_mod(id_column, 5) != 0, most, id_column), id_column, text_column)
    got = own.mapInArrow(run, "i long, y int, x binary").orderBy("i", "y", "x").collect()
    y = np.array([r.y for r in got], float)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(None, share)
    network = AttentionNetwork(len(NAMES))
    network.fit([np.frombuffer(r.x, np.float32).reshape(-1, len(NAMES)).astype(float) for r in got], y)
    return Model(network, share)


def score(docs: DataFrame, model: Model, *keep: str | Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The kept columns (the id by default) and score of every row."""
    batches(docs.sparkSession)
    rows = docs.select(*(keep or (id_column,)), F.col(text_column).cast("string").alias("_text"))
    names = [*rows.columns[:-1], "score"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([*frame.columns[:-1], pa.array(model.scores(frame.column(len(names) - 1).to_pylist()), pa.float64())], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double")
