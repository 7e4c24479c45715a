"""Named steps over DataFrames: in a row, by condition, side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.operators import diagram, vectorize
from filtra.operators.persistence import persistence

Step = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Steps (name, function) applied in order; the plan stays lazy."""

    def __init__(self, *steps: tuple[str, Step]):
        self.steps = list(steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.transform(s[1]), self.steps, df)

    def then(self, name: str, step: Step) -> Pipeline:
        return Pipeline(*self.steps, (name, step))


def conditional(test: bool, yes: Step, no: Step | None = None) -> Step:
    return lambda df: yes(df) if test else no(df) if no else df


def side_by_side(**branches: Step) -> Step:
    """Each branch on the same input; results in one table, named by `branch`, missing columns null."""
    return lambda df: reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [step(df).withColumn("branch", F.lit(name)) for name, step in branches.items()],
    )


def vr_pipeline(max_dim: int = 1, radius: float | None = None, least: float = 0.0) -> Pipeline:
    """Points to the diagram pairs that live at least `least`."""
    return Pipeline(("persistence", lambda p: persistence(p, max_dim, radius)), ("threshold", lambda d: diagram.threshold(d, least)))


def analysis_pipeline(max_dim: int = 1, method: str = "landscape", **options: object) -> Pipeline:
    """Points to one vector a cloud."""
    return vr_pipeline(max_dim).then("vector", lambda d: vectorize.to_vector(diagram.finite_pairs(d), method, **options))
