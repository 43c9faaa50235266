"""Rewards of a prepared frame against the one it came from. Each is a number at the driver's boundary only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions.stats import numeric_columns
from sievelake.operators.distance import distortion, normalised_drift
from sievelake.operators.profile import duplicate_ratios


def completeness(df: DataFrame, n0: int | None = None) -> DataFrame:
    """One row: n, completeness (share of cells that are not null), retention against n0."""
    nulls = F.sum(sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0)))
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), (1 - F.coalesce(nulls / F.nullif(n * len(df.columns), F.lit(0)), F.lit(0.0))).alias("completeness"), (n / F.lit(n0 or 1)).alias("retention"))


class BaseReward:
    def reset(self, df: DataFrame) -> None:
        """The frame that later ones are measured against."""
        self.reference, self.n0 = df, df.count()

    def score(self, df: DataFrame) -> float:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> float:
        return self.score(df)


class CompletenessRetentionReward(BaseReward):
    """Completeness times the square root of retention; -1 for an empty frame."""

    def score(self, df):
        r = completeness(df, self.n0).first()
        return -1.0 if not r.n else r.completeness * math.sqrt(r.n / max(1, self.n0))


@dataclass
class RewardComponents:
    accuracy: float
    retention: float
    quality: float
    drift: float


class MultiObjectiveReward(BaseReward):
    """weights . (accuracy, retention, quality) - penalty * drift, within -1 and 1; the weights sum to 1."""

    def __init__(self, evaluator, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), penalty: float = 0.1, power: float = 1.0):
        total = sum(weights) or 1.0
        self.evaluator, self.weights, self.penalty, self.power = evaluator, tuple(w / total for w in weights), penalty, power

    def components(self, df: DataFrame) -> RewardComponents:
        r = completeness(df, self.n0).first()
        quality = r.completeness * (1 - duplicate_ratios(df).first().surplus)
        target = getattr(self.evaluator, "target", None)
        own = [c for c in numeric_columns(self.reference) if c in numeric_columns(df) and c != target]
        drift = normalised_drift(self.reference.select(own), df.select(own)).first()[0] if own else 0.0
        accuracy = self.evaluator.evaluate(df) if self.weights[0] and self.evaluator else 0.0
        return RewardComponents(accuracy, (r.n / max(1, self.n0)) ** self.power, quality, drift)

    def score(self, df):
        c = self.components(df)
        value = sum(w * v for w, v in zip(self.weights, (c.accuracy, c.retention, c.quality), strict=True)) - self.penalty * c.drift
        return max(-1.0, min(1.0, value))


class AccuracyReward(MultiObjectiveReward):
    def __init__(self, evaluator):
        super().__init__(evaluator, (1.0, 0.0, 0.0), 0.0)


class DriftPenaltyReward(MultiObjectiveReward):
    def __init__(self, evaluator):
        super().__init__(evaluator, (0.7, 0.2, 0.1), 0.5)


class ModelAwareReward(MultiObjectiveReward):
    """Retention counts by its square."""

    def __init__(self, evaluator, power: float = 2.0):
        super().__init__(evaluator, (0.50, 0.35, 0.15), 0.05, power)


class IncrementalGainReward(BaseReward):
    """Five times the change of another reward, within -1 and 1."""

    def __init__(self, inner: BaseReward, factor: float = 5.0):
        self.inner, self.factor = inner, factor

    def reset(self, df):
        super().reset(df)
        self.inner.reset(df)
        self.last = self.inner.score(df)

    def score(self, df):
        now = self.inner.score(df)
        change, self.last = now - self.last, now
        return max(-1.0, min(1.0, self.factor * change))


class DataDistortionReward(BaseReward):
    def __init__(self, evaluator=None, weight: float = 0.0):
        self.evaluator, self.weight = evaluator, weight

    def score(self, df):
        accuracy = self.evaluator.evaluate(df) if self.evaluator and self.weight else 0.0
        return max(-1.0, min(1.0, 1 - distortion(self.reference, df) + self.weight * accuracy))


class TieredAccuracyReward(BaseReward):
    """With nulls left at most 0.2, by completeness; without, 0.5 + accuracy times root retention; each step costs 0.005."""

    def __init__(self, evaluator):
        self.evaluator, self.steps = evaluator, 0

    def reset(self, df):
        super().reset(df)
        self.steps = 0

    def score(self, df):
        self.steps += 1
        r = completeness(df, self.n0).first()
        base = 0.2 * r.completeness if r.completeness < 1 else 0.5 + self.evaluator.evaluate(df) * math.sqrt(r.retention)
        return base - 0.005 * self.steps


@dataclass
class ExplainableReward(BaseReward):
    """Wraps a reward and keeps what each step changed."""

    inner: BaseReward
    history: list[dict[str, Any]] = field(default_factory=list)

    def reset(self, df):
        self.inner.reset(df)
        self.reference, self.n0 = df, self.inner.n0
        self.history, self.last = [], self.inner.score(df)

    def record(self, action: str, df: DataFrame) -> float:
        now = self.inner.score(df)
        self.history.append({"step": len(self.history), "action": action, "delta": now - self.last, "reward": now})
        self.last = now
        return now

    def score(self, df):
        return self.record("step", df)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(h["step"], h["action"], float(h["delta"]), float(h["reward"])) for h in self.history], "step int, action string, delta double, reward double")


def cumulative_rewards(history: DataFrame, by: list[str]) -> DataFrame:
    return history.withColumn("cumulative", F.sum("delta").over(Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


def action_ranking(history: DataFrame, action: str = "action", delta: str = "delta", most: int = 5, worst: bool = False) -> DataFrame:
    """The actions of largest (or smallest) mean change; ties by name."""
    by = history.groupBy(action).agg(F.avg(delta).alias("mean_delta"), F.sum(delta).alias("total_delta"), F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.asc("mean_delta") if worst else F.desc("mean_delta"), action).limit(most)
