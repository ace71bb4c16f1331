"""Models as native column expressions: trees, boosted trees, centres and a multinomial table.

A fitted learner of a moderate size, or one given as plain numbers, becomes one
expression over the feature columns, so scoring is a projection that Catalyst
sees through and that any SQL engine could repeat:

* a tree is one nested CASE, a forest the mean of its trees' leaf shares;
* boosted trees add up weighted margins, read by the logistic link (MLlib's
  margin counts twice);
* a cluster is the arg-min of squared distances, ties to the smallest number;
* a class is the arg-max of linear margins, ties to the smallest number.

``trees_of`` reads the nodes of an MLlib tree model. An expression of some
thousand nodes outgrows one generated method and is then evaluated without
code generation; such models are better left to ``model.transform``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Rows with feature <= threshold go to ``low``."""
    feature: str
    threshold: float
    low: "Split | float"
    high: "Split | float"


Tree = Split | float  # a leaf is its value: a class share or a margin


def tree_column(tree: Tree) -> Column:
    if isinstance(tree, Split):
        return F.when(F.col(tree.feature) <= F.lit(tree.threshold), tree_column(tree.low)).otherwise(tree_column(tree.high))
    return F.lit(float(tree))


def _total(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def _first_best(values: Sequence[Column], least: bool) -> Column:
    """Number of the smallest (or largest) value, ties to the smallest number."""
    best, at = values[0], F.lit(0)
    for i, v in enumerate(values[1:], 1):
        better = v < best if least else v > best
        best, at = F.when(better, v).otherwise(best), F.when(better, F.lit(i)).otherwise(at)
    return at


@dataclass(frozen=True)
class Forest:
    """Leaves hold the share of class 1."""
    trees: tuple[Tree, ...]

    def probability(self) -> Column:
        return _total([tree_column(t) for t in self.trees]) / F.lit(float(len(self.trees)))


@dataclass(frozen=True)
class Boosting:
    """Leaves hold margins; a tree counts by its weight."""
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]

    def margin(self) -> Column:
        return _total([tree_column(t) * F.lit(float(w)) for t, w in zip(self.trees, self.weights)])

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(self.margin() * F.lit(-2.0)))


@dataclass(frozen=True)
class Centres:
    """Cluster centres over the same features."""
    features: tuple[str, ...]
    centres: tuple[tuple[float, ...], ...]

    def distances(self) -> list[Column]:
        """Squared distance to each centre."""
        return [_total([(F.col(f) - F.lit(c)) * (F.col(f) - F.lit(c)) for f, c in zip(self.features, centre)])
                for centre in self.centres]

    def cluster(self) -> Column:
        return _first_best(self.distances(), least=True)


@dataclass(frozen=True)
class Multinomial:
    """Linear margins: a row of coefficients and an intercept for each class."""
    features: tuple[str, ...]
    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def margins(self) -> list[Column]:
        return [_total([F.col(f) * F.lit(w) for f, w in zip(self.features, row)]) + F.lit(b)
                for row, b in zip(self.coefficients, self.intercepts)]

    def label(self) -> Column:
        """Number of the class with the largest margin."""
        return _first_best(self.margins(), least=False)


def trees_of(model, features: Sequence[str]) -> Forest | Boosting:
    """The trees of a fitted MLlib forest or boosting classifier over named features (continuous ones)."""
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")

    def read(node) -> Tree:
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            return Split(features[split.featureIndex()], float(split.threshold()), read(node.leftChild()), read(node.rightChild()))
        if boosted:
            return float(node.prediction())
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats))

    trees = tuple(read(t._call_java("rootNode")) for t in model.trees)
    return Boosting(trees, tuple(float(w) for w in model.treeWeights)) if boosted else Forest(trees)


def centres_of(model, features: Sequence[str]) -> Centres:
    """The centres of a fitted MLlib k-means model."""
    return Centres(tuple(features), tuple(tuple(float(x) for x in c) for c in model.clusterCenters()))


def multinomial_of(model, features: Sequence[str]) -> Multinomial:
    """The coefficients of a fitted MLlib multinomial logistic model."""
    return Multinomial(tuple(features), tuple(tuple(float(x) for x in row) for row in model.coefficientMatrix.toArray()),
                       tuple(float(x) for x in model.interceptVector))
