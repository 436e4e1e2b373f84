"""Logistic regression on hashed features: fitted on a small table, applied by SQL expressions.

A feature is a string; its weight lies at xxhash64(feature) modulo the number of buckets.
Fitting is meant for small labelled tables, of a few hundred rows, which it gathers once. The model is a few thousand numbers that go into the plan as literals, so
scoring stays inside the JVM and joins nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(buckets)).cast("int")


def grams(text: Column, n: int, mark: str = "") -> Column:
    """All character n-grams of a string, each with a mark before it; none if it is shorter."""
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def word_grams(words: Column, n: int) -> Column:
    """All word n-grams of an array of words, joined by spaces."""
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def literal(numbers: list[float]) -> Column:
    """An array of doubles as one constant of the plan."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


@dataclass(frozen=True)
class HashedLogistic:
    """Weights by class and bucket; one class stands for a binary model's positive class."""

    classes: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def margins(self, features: Column) -> list[Column]:
        """A class's intercept and the weights of all features, repeated ones included."""
        return [
            self._margin(features, literal(list(own)), len(own), start)
            for own, start in zip(self.weights, self.intercepts, strict=True)
        ]

    @staticmethod
    def _margin(features: Column, weights: Column, buckets: int, start: float) -> Column:
        return F.aggregate(features, F.lit(float(start)), lambda s, g: s + F.get(weights, bucket(g, buckets)))

    def probability(self, features: Column) -> Column:
        """Of the positive class, for a binary model."""
        (margin,) = self.margins(features)
        return 1.0 / (1.0 + F.exp(-margin))

    def probabilities(self, features: Column) -> Column:
        """array<double> by class, for several classes. Each step is computed once, inside lambdas too."""
        classes = list(zip(self.weights, self.intercepts, strict=True))

        def margins(hits: Column) -> Column:
            add = lambda w: lambda s, h: s + F.get(w, h)
            return F.array(*[F.aggregate(hits, F.lit(float(start)), add(literal(list(own)))) for own, start in classes])

        def shares(powers: Column) -> Column:
            return bound(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(powers, lambda e: e / total))

        def powers(m: Column) -> Column:
            return bound(F.array_max(m), lambda top: F.transform(m, lambda x: F.exp(x - top)))

        hits = F.transform(features, lambda g: bucket(g, len(self.weights[0])))
        return bound(hits, lambda h: bound(margins(h), lambda m: bound(powers(m), shares)))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def fit(labelled: DataFrame, classes: list[str], buckets: int, reg: float, iterations: int = 400) -> HashedLogistic:
    """labelled: features array<string>, label (a name in ``classes``). Two classes give a binary
    model whose positive class is the second.

    Minimises the mean cross entropy and reg / 2 times the squared weights, by steps that a quadratic bound of it
    gives; weights are sums over the rows, so a step costs a product of small matrices.
    """
    small = labelled.select(F.transform("features", lambda g: bucket(g, buckets)), "label").collect()
    x = np.zeros((len(small), buckets + 1))
    x[:, buckets] = 1.0  # the intercept
    for row, (hits, _) in enumerate(small):
        np.add.at(x[row], np.array(hits, np.int64), 1.0)
    target = np.eye(len(classes))[[classes.index(label) for _, label in small]]
    inner = x @ x.T
    bound_inverse = np.linalg.inv(inner / (2 * len(x)) + reg * np.eye(len(x)))
    share = np.zeros_like(target)  # of each row in the weights
    for _ in range(iterations):
        margin = inner @ share
        p = np.exp(margin - margin.max(1, keepdims=True))
        share -= bound_inverse @ ((p / p.sum(1, keepdims=True) - target) / len(x) + reg * share)
    weights = share.T @ x
    if len(classes) == 2:
        weights, classes = weights[1:] - weights[:1], classes[1:]
    return HashedLogistic(tuple(classes), tuple(tuple(w[:-1].tolist()) for w in weights), tuple(w[-1] for w in weights.tolist()))
