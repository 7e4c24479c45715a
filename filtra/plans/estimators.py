"""pyspark.ml stages around the operators, for ml Pipelines."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from filtra.operators import diagram, mapper, vectorize
from filtra.operators.persistence import persistence


class PersistenceTransformer(Transformer):
    """Clouds to diagrams, or to one vector a cloud if a method is named."""

    def __init__(self, max_dim: int = 1, radius: float | None = None, metric: str = "euclidean", infinite: str = "remove", normalise: str = "none", method: str | None = None, **options: object):
        super().__init__()
        self.max_dim, self.radius, self.metric = max_dim, radius, metric
        self.infinite, self.normalise, self.method, self.options = infinite, normalise, method, options

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d = persistence(dataset, self.max_dim, self.radius, self.metric)
        d = diagram.normalise(diagram.replace_infinite(d, self.infinite), self.normalise)
        return vectorize.to_vector(d, self.method, **self.options) if self.method else d


class VectorTransformer(Transformer):
    """Diagrams to vectors of one size."""

    def __init__(self, method: str = "landscape", size: int | None = None, **options: object):
        super().__init__()
        self.method, self.size, self.options = method, size, options

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = vectorize.to_vector(diagram.finite_pairs(dataset), self.method, **self.options)
        return vectorize.fixed_size(v, self.size) if self.size else v


class MapperTransformer(Transformer):
    """One cloud to the edges of its Mapper graph."""

    def __init__(self, lens: str = "pca", resolution: int = 10, overlap: float = 0.25, how: str = "connected", **options: float):
        super().__init__()
        self.lens, self.resolution, self.overlap, self.how, self.options = lens, resolution, overlap, how, options

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return mapper.mapper(dataset, self.lens, self.resolution, self.overlap, self.how, **self.options)[2]
