"""Search of expression trees, planned on the driver.

A tree's snapped weights take one child at each node, the left one unless they are trained, so it
compiles to one leaf: only the terminals and the constant are ever evaluated. They are scored once, in one
Spark plan, and each tree looks its leaf's score up.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.metrics import predictive


@dataclass(frozen=True)
class Node:
    """A leaf (``name``), or a pair of children."""

    name: str | None = None
    left: Node | None = None
    right: Node | None = None
    weight: float = 0.0  # the left child is taken where it is not negative

    @property
    def depth(self) -> int:
        return 0 if self.name is not None else 1 + max(self.left.depth, self.right.depth)

    @property
    def leaf(self) -> str:
        return self.name if self.name is not None else (self.left if self.weight >= 0 else self.right).leaf

    @property
    def leaves(self) -> list[str]:
        return [self.name] if self.name is not None else [*self.left.leaves, *self.right.leaves]

    def __str__(self) -> str:
        return self.name if self.name is not None else f"({self.left}, {self.right})"


def trees(terminals: list[str]) -> list[Node]:
    """All trees of depth 2 over the terminals and the constant 1.0."""
    leaves = [Node(t) for t in [*terminals, "1.0"]]
    pairs = [Node(None, a, b) for a, b in itertools.product(leaves, repeat=2)]
    return [t for t in (Node(None, a, b) for a, b in itertools.product(leaves + pairs, repeat=2)) if t.depth == 2]


def is_safe(expression: str, terminals: list[str]) -> bool:
    """A number or an allowed name."""
    return bool(re.fullmatch(r"-?\d+(\.\d+)?", expression)) or expression in terminals


def lower(expression: str, terminals: list[str]) -> Column:
    if not is_safe(expression, terminals):
        raise ValueError(f"not an allowed expression: {expression}")
    return F.col(expression) if expression in terminals else F.lit(float(expression))


def leaf_scores(features: DataFrame, terminals: list[str]) -> DataFrame:
    """expression, series_id and predictive metrics of each leaf against ``target``, in one plan."""
    every = F.explode(F.array(*[F.struct(F.lit(e).alias("expression"), lower(e, terminals).alias("signal")) for e in [*terminals, "1.0"]]))
    rows = features.select("series_id", "t", "target", every.alias("e")).select("series_id", "t", "target", "e.*")
    return predictive(rows, ["series_id", "expression"])


def search(features: DataFrame, terminals: list[str], top_k: int) -> list[tuple[str, str, float]]:
    """Tree, compiled expression and fitness (mean rank IC) of the best trees; first come first on ties."""
    scores = dict(leaf_scores(features, terminals).groupBy("expression").agg(F.avg("rank_ic")).collect())  # a row for each terminal
    ranked = sorted(trees(terminals), key=lambda n: -(scores.get(n.leaf) or 0.0))
    return [(str(n), n.leaf, scores.get(n.leaf) or 0.0) for n in ranked[:top_k]]


def random_tree(terminals: list[str], depth: int, rng: random.Random, least: int = 2) -> Node:
    """A tree of at most ``depth``, of ``least`` where that is possible, with random weights."""
    if depth == 0 or (least <= 0 and rng.random() < 0.3):
        return Node(rng.choice([*terminals, "1.0"]))
    return Node(None, random_tree(terminals, depth - 1, rng, least - 1), random_tree(terminals, depth - 1, rng, least - 1), rng.uniform(-1, 1))


def _soft(node: Node, scores: dict[str, float], heat: float) -> tuple[float, list[float]]:
    """The expected leaf score when each node takes its left child with probability sigmoid(weight / heat), and its gradient."""
    if node.name is not None:
        return scores.get(node.name) or 0.0, []
    (a, da), (b, db) = _soft(node.left, scores, heat), _soft(node.right, scores, heat)
    p = 1 / (1 + math.exp(-max(-60.0, min(60.0, node.weight / heat))))
    return p * a + (1 - p) * b, [(a - b) * p * (1 - p) / heat, *(p * g for g in da), *((1 - p) * g for g in db)]


def _with(node: Node, weights: list[float]) -> Node:
    """The tree with other weights, in preorder; takes them off the list."""
    if node.name is not None:
        return node
    w = weights.pop(0)
    return Node(None, _with(node.left, weights), _with(node.right, weights), w)


def _weights(node: Node) -> list[float]:
    return [] if node.name is not None else [node.weight, *_weights(node.left), *_weights(node.right)]


def train(node: Node, scores: dict[str, float], steps: int = 50, rate: float = 0.1, hot: float = 2.0, cold: float = 0.1) -> Node:
    """The tree after Adam steps on its soft score, with a temperature that falls from hot to cold."""
    w = _weights(node)
    m, v = [0.0] * len(w), [0.0] * len(w)
    for t in range(1, steps + 1):
        heat = hot * (cold / hot) ** (t / steps)
        _, g = _soft(_with(node, list(w)), scores, heat)
        for i, x in enumerate(g):
            m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
            w[i] += rate * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return _with(node, w)


def gradient_search(features: DataFrame, terminals: list[str], starts: int, top_k: int, depth: int = 4, seed: int = 42) -> list[tuple[str, str, float]]:
    """Tree, compiled expression and fitness of the best trained random trees; one for each expression."""
    scores = dict(leaf_scores(features, terminals).groupBy("expression").agg(F.avg("rank_ic")).collect())  # a row for each terminal
    rng, best = random.Random(seed), {}
    for _ in range(starts):
        n = train(random_tree(terminals, depth, rng), scores)
        best.setdefault(n.leaf, n)
    ranked = sorted(best.values(), key=lambda n: -(scores.get(n.leaf) or 0.0))
    return [(str(n), n.leaf, scores.get(n.leaf) or 0.0) for n in ranked[:top_k]]


#: Lag of a terminal, in rows; a name that begins with ``future_`` looks ahead.
DEFAULT_LAG = 1


def lags(node: Node, known: dict[str, int]) -> tuple[int, int, bool]:
    """Least and greatest lag of a tree's leaves, and whether one looks ahead."""
    if node.name is not None:
        lag = 0 if node.name.startswith("future_") else known.get(node.name, DEFAULT_LAG)
        return lag, lag, node.name.startswith("future_")
    a, b = lags(node.left, known), lags(node.right, known)
    return min(a[0], b[0]), max(a[1], b[1]), a[2] or b[2]


def safety_proof(node: Node, terminals: list[str], known: dict[str, int]) -> dict:
    """What a candidate must show before it is evaluated: an allowed expression and no look ahead."""
    low, high, ahead = lags(node, known)
    return {"expression": node.leaf, "is_safe": is_safe(node.leaf, terminals), "min_lag": low, "max_lag": high, "looks_ahead": ahead, "passed": is_safe(node.leaf, terminals) and not ahead}


def perturbed(base: float, lo: float, hi: float, share: float, n: int, integer: bool = False, log: bool = False) -> list[float]:
    """n values within ``share`` of ``base``, evenly or evenly in logarithm, held in [lo, hi]; integers once each."""
    a, b = max(lo, base * (1 - share)), min(hi, base * (1 + share))
    f = (lambda x: math.exp(math.log(a) + x * (math.log(b) - math.log(a)))) if log and a > 0 else (lambda x: a + x * (b - a))
    values = [f(i / (n - 1)) if n > 1 else base for i in range(n)]
    return sorted({float(round(v)) for v in values}) if integer else values


#: The standard parameters: base, least, most, share, whole numbers, even in logarithm.
STANDARD = {"window": (20, 5, 252, 0.30, True, False), "cutoff": (0.10, 0.01, 0.50, 0.30, False, False), "threshold": (0.50, 0.10, 0.90, 0.20, False, False), "vol_scale": (1.0, 0.5, 2.0, 0.25, False, True), "lookback": (60, 10, 504, 0.30, True, False), "norm_span": (252, 60, 756, 0.25, True, False)}


def standard_grid(names: list[str] | None = None, base: dict[str, float] | None = None, n: int = 5) -> dict[str, list[float]]:
    """The values of each parameter, for ``evidence.parameter_grid``. An unknown one varies by a fifth within half and twice its base."""
    base, out = base or {}, {}
    for name in names or list(STANDARD):
        b, lo, hi, share, whole, log = STANDARD.get(name, (1.0, None, None, 0.20, False, False))
        b = base.get(name, b)
        lo, hi = (b * 0.5, b * 2.0) if lo is None else (lo, hi)
        out[name] = perturbed(b, lo, hi, share, n, whole, log)
    return out
