"""Differentiable search for a preparation pipeline: every stage is a softmax mixture of its candidates, learned with a linear model.

A value goes through a mixture of fills (if it is null), of clamps and of scalings; the model's weights follow the gradient of the
loss on the training rows, the mixtures' weights that on the validation rows. Both gradients are sums over rows, so a step is one
aggregate whatever the number of candidates; the statistics of candidates are taken once, before. The strongest candidate of each
stage is the pipeline that is found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.quantiles import Quantiles
from sievelake.functions.stats import aggregated, hash_unit, number
from sievelake.operators.learners import summed
from sievelake.plans.shared import forget, written

FILLS, CLAMPS, SCALES = ("mean", "median", "zero"), ("none", "iqr", "sd3"), ("none", "zscore", "minmax", "robust")
STAGES = {"fill": FILLS, "clamp": CLAMPS, "scale": SCALES}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class Candidates:
    """Constants of every candidate by column: fills, bounds, and the middle and width of scalings."""

    fills: np.ndarray  # fills x columns
    bounds: np.ndarray  # clamps x 2 x columns
    middles: np.ndarray  # scales x columns
    widths: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, columns: list[str]) -> Candidates:
        exprs = {}
        for i, c in enumerate(columns):
            x = number(c)
            exprs |= {f"mean{i}": F.avg(x), f"sd{i}": F.stddev_pop(x), f"low{i}": F.min(x), f"high{i}": F.max(x), f"q{i}": Quantiles(x, [0.25, 0.5, 0.75])}
        s = aggregated(df, exprs)
        q = np.array([s[f"q{i}"] or [0.0] * 3 for i in range(len(columns))]).T
        mean, sd, low, high = (np.array([s[f"{k}{i}"] or 0.0 for i in range(len(columns))]) for k in ("mean", "sd", "low", "high"))
        one = lambda x: np.where(x > 0, x, 1.0)
        far = np.full(len(columns), np.inf)
        iqr = q[2] - q[0]
        bounds = np.stack([np.stack([-far, far]), np.stack([q[0] - 1.5 * iqr, q[2] + 1.5 * iqr]), np.stack([mean - 3 * sd, mean + 3 * sd])])
        return cls(np.stack([mean, q[1], np.zeros_like(mean)]), bounds, np.stack([np.zeros_like(mean), mean, low, q[1]]), np.stack([np.ones_like(mean), one(sd), one(high - low), one(iqr)]))


def loss_and_gradients(c: Candidates, logits: dict[str, np.ndarray], w: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over rows: loss (squared error halved), and its gradients by w (the intercept last) and by the weights of each mixture."""
    a, b, s = (softmax(logits[k]) for k in STAGES)
    gap = np.isnan(x)
    v = np.where(gap, a @ c.fills, x)
    clamped = np.clip(v[None], c.bounds[:, 0][:, None], c.bounds[:, 1][:, None])
    u = np.tensordot(b, clamped, 1)
    scaled = (u[None] - c.middles[:, None]) / c.widths[:, None]
    z = np.tensordot(s, scaled, 1)
    miss = z @ w[:-1] + w[-1] - y
    by_z = miss[:, None] * w[:-1]
    by_u = by_z * (s @ (1 / c.widths))
    inside = (v[None] >= c.bounds[:, 0][:, None]) & (v[None] <= c.bounds[:, 1][:, None])
    by_v = by_u * np.tensordot(b, inside, 1) * gap
    return {"loss": np.array([(miss**2).sum() / 2]), "n": np.array([float(len(y))]), "w": np.append(miss @ z, miss.sum()), "fill": (by_v[None] * c.fills[:, None]).sum((1, 2)), "clamp": (by_u[None] * clamped).sum((1, 2)), "scale": (by_z[None] * scaled).sum((1, 2))}


def through_softmax(logits: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    p = softmax(logits)
    return p * (gradient - p @ gradient)


@dataclass
class PipelineMixture:
    """`fit` learns; `chosen` is the candidate of each stage that weighs most, `shares` the weights, `losses` the validation loss by step."""

    columns: list[str]
    target: str
    key: list[str]
    steps: int = 60
    rate: float = 0.1
    seed: int = 42
    shares: dict[str, np.ndarray] = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> PipelineMixture:
        p = len(self.columns)
        known = df.where(F.col(self.target).isNotNull())
        middle, spread = known.agg(F.avg(number(self.target)), F.stddev_pop(number(self.target))).first()
        self.candidates = c = Candidates.of(known, self.columns)
        y = (number(self.target) - F.lit(middle or 0.0)) / F.lit(spread or 1.0)
        rows = written(known.select(*(number(x).alias(f"x{i}") for i, x in enumerate(self.columns)), y.alias("y"), (hash_unit(*self.key, F.lit("mixture"), seed=self.seed) < 0.3).alias("held")), "mixture")
        logits, w = {k: np.zeros(len(v)) for k, v in STAGES.items()}, np.zeros(p + 1)
        sizes = {"loss": (1,), "n": (1,), "w": (p + 1,), **{k: (len(v),) for k, v in STAGES.items()}}
        names = [f"{k}_{side}" for side in ("train", "held") for k in sizes]
        moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.losses = []

        def adam(name: str, value: np.ndarray, gradient: np.ndarray, t: int) -> np.ndarray:
            m, v = moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            moments[name] = m, v
            return value - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

        for t in range(1, self.steps + 1):

            def gather(stream, logits=logits, w=w) -> dict[str, np.ndarray]:
                out = {n: np.zeros(sizes[n.rpartition("_")[0]]) for n in names}
                for batch in stream:
                    x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]).astype(float)
                    label, held = batch.column(p).to_numpy(), batch.column(p + 1).to_numpy(zero_copy_only=False)
                    for side, own in (("train", ~held), ("held", held)):
                        if own.any():
                            for k, v in loss_and_gradients(c, logits, w, x[own], label[own]).items():
                                out[f"{k}_{side}"] += v
                return out

            got = summed(rows, gather, {n: sizes[n.rpartition("_")[0]] for n in names})
            n_train, n_held = max(1.0, float(got["n_train"][0])), max(1.0, float(got["n_held"][0]))
            self.losses.append(float(got["loss_held"][0]) / n_held)
            logits = {k: adam(k, v, through_softmax(v, got[f"{k}_held"] / n_held), t) for k, v in logits.items()}
            w = adam("w", w, got["w_train"] / n_train + 1e-3 * np.append(w[:-1], 0.0), t)
        forget(rows)
        self.weights, self.shares = w, {k: softmax(v) for k, v in logits.items()}
        return self

    @property
    def chosen(self) -> dict[str, str]:
        return {k: STAGES[k][int(v.argmax())] for k, v in self.shares.items()}
