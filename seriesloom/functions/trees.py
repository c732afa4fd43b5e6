"""Regression trees of one series in numpy: the small learner that grouped jobs call for every series.

Features are cut at up to BINS - 1 values between their sorted distinct ones, so a node needs one count and one sum per feature
and bin, whatever the length of the series.
"""

from __future__ import annotations

import numpy as np

BINS, DEEPEST = 256, 64


def binned(x: np.ndarray) -> np.ndarray:
    """Bin of every value by column; a column with no more than BINS distinct values keeps them all apart."""
    codes = np.zeros(x.shape, np.int64)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > BINS:
            values = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="nearest"))
        codes[:, j] = np.searchsorted(values, x[:, j], side="right") - 1
    return np.maximum(codes, 0)


def best_split(codes: np.ndarray, y: np.ndarray, columns: np.ndarray, min_leaf: int):
    """(fall of the squared error, column, last bin on the left) of the best split; the first of equal ones."""
    n, width = len(y), int(codes[:, columns].max()) + 1
    if n < 2 * min_leaf or width < 2:
        return 0.0, -1, -1
    flat = (codes[:, columns] + width * np.arange(len(columns))).ravel()
    count = np.bincount(flat, minlength=width * len(columns)).reshape(len(columns), width).cumsum(1)[:, :-1]
    total = np.bincount(flat, np.repeat(y, len(columns)), width * len(columns)).reshape(len(columns), width).cumsum(1)
    left, right = total[:, :-1], total[:, -1:] - total[:, :-1]
    fine = (count >= min_leaf) & (n - count >= min_leaf)
    gain = np.where(fine, left**2 / np.maximum(count, 1) + right**2 / np.maximum(n - count, 1) - total[:, -1:]**2 / n, -1.0)
    k = int(gain.argmax())
    return float(gain.ravel()[k]), int(columns[k // (width - 1)]), k % (width - 1)


class Tree:
    """Grown depth first, or best first when ``leaves`` bounds their number. Node: (column, bin, left, right) or a leaf."""

    def __init__(self, codes, y, rows, min_leaf=1, depth=DEEPEST, mtry=None, random=None, min_gain=0.0, leaves=None):
        self.nodes: list[list] = []
        self.members: dict[int, np.ndarray] = {}
        p = codes.shape[1]

        def candidate(rows, level):
            node = len(self.nodes)
            self.nodes.append([-1, 0, 0, 0, float(y[rows].mean())])
            self.members[node] = rows
            columns = np.arange(p) if not mtry or mtry >= p else np.sort(random.choice(p, mtry, replace=False))
            gain, column, cut = best_split(codes[rows], y[rows], columns, min_leaf) if level < depth else (0.0, -1, -1)
            return gain, node, column, cut, level

        todo, count = [candidate(rows, 0)], 1
        while todo:
            at = max(range(len(todo)), key=lambda i: (todo[i][0], -i)) if leaves else len(todo) - 1
            gain, node, column, cut, level = todo.pop(at)
            if column < 0 or gain <= max(min_gain, 1e-12) or (leaves and count >= leaves):
                continue
            rows = self.members.pop(node)
            low = codes[rows, column] <= cut
            below = [candidate(rows[low], level + 1), candidate(rows[~low], level + 1)]
            self.nodes[node][:4] = column, cut, below[0][1], below[1][1]
            todo += below
            count += 1
        self.table = np.array([n[:4] for n in self.nodes], np.int64)
        self.value = np.array([n[4] for n in self.nodes])

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        while True:
            column = self.table[at, 0]
            inner = np.flatnonzero(column >= 0)
            if not len(inner):
                return at
            low = codes[inner, column[inner]] <= self.table[at[inner], 1]
            at[inner] = np.where(low, self.table[at[inner], 2], self.table[at[inner], 3])

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(codes)]


def forest(codes, y, known, trees: int, mtry: int, min_n: int, seed: int) -> list[Tree]:
    """Trees on bootstrap samples of the known rows; mtry features are tried at each split."""
    random, rows = np.random.default_rng(seed), np.flatnonzero(known)
    return [Tree(codes, y, random.choice(rows, len(rows)), max(1, min_n), mtry=mtry, random=random) for _ in range(trees)]


def forest_predict(model: list[Tree], codes) -> np.ndarray:
    return sum(t.predict(codes) for t in model) / len(model)


def boosted(codes, y, known, trees: int, depth: int, rate: float, min_n: int, mtry: int, min_gain: float, share: float,
            seed: int) -> np.ndarray:
    """Predictions of all rows by trees on what the sum of the ones before leaves over, on a share of the rows each."""
    random, rows = np.random.default_rng(seed), np.flatnonzero(known)
    out = np.full(len(y), y[rows].mean())
    for _ in range(trees):
        some = rows if share >= 1 else np.sort(random.choice(rows, max(2, int(share * len(rows))), replace=False))
        left_over = np.where(known, y - out, 0.0)
        if np.abs(left_over[rows]).max() < 1e-12:
            break
        tree = Tree(codes, left_over, some, max(1, min_n), depth, mtry, random, min_gain)
        out = out + rate * tree.predict(codes)
    return out


def _linear(x, y):
    mean, sd = x.mean(0), x.std(0)
    z = np.where(sd > 1e-12, (x - mean) / np.where(sd > 1e-12, sd, 1), 0.0)
    beta = np.linalg.solve(z.T @ z + 1e-3 * len(y) * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: y.mean() + np.where(sd > 1e-12, (new - mean) / np.where(sd > 1e-12, sd, 1), 0.0) @ beta


def rules(x, codes, y, known, most: int, committees: int, neighbours: int, min_leaf: int = 5) -> np.ndarray:
    """Rule model: a tree of at most ``most`` leaves with a linear model in each; every further committee member fits what
    makes up for the one before; predictions are moved by the residuals of the nearest ``neighbours`` known rows."""
    rows, target, total = np.flatnonzero(known), y.copy(), np.zeros(len(y))
    for _ in range(max(1, committees)):
        tree = Tree(codes, target, rows, min(min_leaf, max(1, len(rows) // 2)), leaves=max(1, most))
        at, guess = tree.leaf(codes), np.zeros(len(y))
        for k in np.unique(at):
            inside = rows[at[rows] == k]
            span = target[inside].min(), target[inside].max()
            room = (span[1] - span[0]) or 1.0
            guess[at == k] = np.clip(_linear(x[inside], target[inside])(x[at == k]), span[0] - room, span[1] + room)
        total += guess
        target = np.where(known, 2 * y - guess, 0.0)
    out = total / max(1, committees)
    if neighbours:
        sd = x[rows].std(0)
        z = x / np.where(sd > 1e-12, sd, np.inf)
        k = min(neighbours, len(rows))
        moved = np.empty(len(y))
        for a in range(0, len(y), 1024):
            far = ((z[a:a + 1024, None] - z[rows][None]) ** 2).sum(2)
            near = rows[np.argpartition(far, k - 1, axis=1)[:, :k]]
            moved[a:a + 1024] = (y[near] - out[near]).mean(1)
        out = out + moved
    return out
