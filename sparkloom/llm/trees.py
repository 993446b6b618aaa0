"""Small decision trees over coded features: grown with numpy on counts of feature patterns, applied as SQL expressions.

Every feature is a small integer code, so candidates fall into a bounded number of patterns and a grouped count holds all that
growing needs: no row leaves the executors but the pattern counts. Trees become nested conditions or, where there are many, constant arrays that are walked;
both run inside the JVM beside the rest of the plan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, columns: np.ndarray, least: float = 1.0, penalty: float = 1.0, rng: np.random.Generator | None = None, tries: int = 0) -> Node:
    """A tree whose leaves hold sum(gradient) / (sum(hessian) + penalty), split where that gains most: a boosting step with the
    losses' gradients and curvatures, or a mean with the labels and weights. With tries, each node sees that many features."""
    g, h = gradient.sum(), hessian.sum()
    node = Node(float(g / (h + penalty)))
    if depth == 0 or h < 2 * least:
        return node
    seen = rng.permutation(columns)[:tries] if tries else columns
    best = 1e-9
    for f in np.sort(seen):
        size = int(x[:, f].max()) + 1
        gs, hs = np.cumsum(np.bincount(x[:, f], gradient, size))[:-1], np.cumsum(np.bincount(x[:, f], hessian, size))[:-1]
        gain = gs**2 / (hs + penalty) + (g - gs) ** 2 / (h - hs + penalty) - g**2 / (h + penalty)
        gain[(hs < least) | (h - hs < least)] = 0
        if len(gain) and gain.max() > best:
            best, node.feature, node.cut = gain.max(), int(f), int(gain.argmax())
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = grow(x[low], gradient[low], hessian[low], depth - 1, columns, least, penalty, rng, tries)
        node.high = grow(x[~low], gradient[~low], hessian[~low], depth - 1, columns, least, penalty, rng, tries)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, predict(node.low, x), predict(node.high, x))


def expression(node: Node, names: list[str]) -> str:
    """SQL of a tree over columns of these names."""
    if node.feature < 0:
        return f"{node.value!r}D"
    return f"if({names[node.feature]} <= {node.cut}, {expression(node.low, names)}, {expression(node.high, names)})"


def forest(x: np.ndarray, positive: np.ndarray, total: np.ndarray, trees: int = 25, depth: int = 6, seed: int = 3) -> list[Node]:
    """Random forest of shares: bootstrap by Poisson weights of the patterns' rows, sqrt(features) at each node."""
    rng, out = np.random.default_rng(seed), []
    tries = max(2, round(x.shape[1] ** 0.5))
    for _ in range(trees):
        yes, no = rng.poisson(positive).astype(float), rng.poisson(total - positive).astype(float)
        out.append(grow(x, yes, yes + no, depth, np.arange(x.shape[1]), penalty=1e-6, rng=rng, tries=tries))
    return out


def boosted(x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Node]]:
    """Gradient boosting of the logistic loss: (base score, trees with the rate in their leaves)."""
    share = np.clip(positive.sum() / max(total.sum(), 1), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    score, out = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, positive - total * p, total * p * (1 - p), depth, np.arange(x.shape[1]))
        _scale(tree, rate)
        score += predict(tree, x)
        out.append(tree)
    return base, out


def _scale(node: Node, by: float) -> None:
    node.value *= by
    for part in (node.low, node.high):
        if part:
            _scale(part, by)


def _flat(node: Node, into: list[tuple]) -> int:
    """The number of a node in a table of (feature, cut, low, high, value); leaves lead to themselves."""
    at = len(into)
    into.append(())
    into[at] = (0, 0, at, at, node.value) if node.feature < 0 else (node.feature, node.cut, _flat(node.low, into), _flat(node.high, into), node.value)
    return at


def _depth(node: Node) -> int:
    return 0 if node.feature < 0 else 1 + max(_depth(node.low), _depth(node.high))


def forest_share(trees: list[Node], names: list[str]) -> Column:
    """The trees' mean. All nodes stand in constant arrays and each tree is walked by number, so the plan's code is small however many trees there are."""
    if not trees:
        return F.lit(0.0)
    nodes: list[tuple] = []
    roots = [_flat(t, nodes) for t in trees]
    column = lambda k: f"array({', '.join(f'{n[k]!r}D' if k == 4 else str(n[k]) for n in nodes)})"
    codes = f"array({', '.join(f'cast({n} as int)' for n in names)})"
    # what is looked up in is bound once; constants fold into literals
    walk = "aggregate(sequence(1, {depth}), r, (n, i) -> if(get(x.codes, get(x.feature, n)) <= get(x.cut, n), get(x.low, n), get(x.high, n)))"
    total = f"aggregate(array({', '.join(map(str, roots))}), 0D, (s, r) -> s + get(x.value, {walk.format(depth=max(1, max(map(_depth, trees))))}))"
    table = f"named_struct('codes', {codes}, 'feature', {column(0)}, 'cut', {column(1)}, 'low', {column(2)}, 'high', {column(3)}, 'value', {column(4)})"
    return F.expr(f"element_at(transform(array({table}), x -> {total}), 1) / {len(trees)}")


def boosted_score(base: float, trees: list[Node], names: list[str]) -> Column:
    return F.expr(f"1 / (1 + exp(-({base!r}D" + "".join(f" + {expression(t, names)}" for t in trees) + ")))")


def threshold(score: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """The least score at and above which the precision holds, counted from the top; above 1 if it holds nowhere."""
    order = np.argsort(-score, kind="stable")
    right, all_ = np.cumsum(positive[order]), np.cumsum(total[order])
    last = np.append(score[order][1:] < score[order][:-1], True)  # a whole tie counts
    good = last & (right >= precision * all_)
    return float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.1
