"""A linear-chain conditional random field: training by likelihood gradient, decoding by Viterbi."""

from __future__ import annotations

import numpy as np


class LinearChainCRF:
    """Labels for sequences of feature sets.

    Features are strings; those not met in training weigh nothing. Training maximises the
    log-likelihood of the label sequences with AdaGrad and an L2 penalty, in a fixed order
    from zero weights, so the same pages always give the same model.
    """

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.features: dict[str, int] = {}
        self.state = np.zeros((0, len(labels)))
        self.step = np.zeros((len(labels), len(labels)))
        self.start = np.zeros(len(labels))

    def _rows(self, seq: list[list[str]]) -> list[np.ndarray]:
        get = self.features.get
        return [np.fromiter((i for f in fs if (i := get(f)) is not None), dtype=np.int64) for fs in seq]

    def _scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.state[r].sum(axis=0) if len(r) else np.zeros(len(self.labels)) for r in rows])

    def fit(self, pages: list[tuple[list[list[str]], list[str]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-4) -> LinearChainCRF:
        for seq, _ in pages:
            for fs in seq:
                for f in fs:
                    self.features.setdefault(f, len(self.features))
        k = len(self.labels)
        self.state = np.zeros((len(self.features), k))
        g_state, g_step, g_start = np.full(self.state.shape, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
        number = {x: i for i, x in enumerate(self.labels)}
        data = [(self._rows(seq), np.array([number[y] for y in ys])) for seq, ys in pages if seq]
        for _ in range(epochs):
            for rows, ys in data:
                node, edge = self._marginals(self._scores(rows))
                node[np.arange(len(ys)), ys] -= 1
                edge = edge.sum(axis=0) if len(edge) else np.zeros((k, k))
                np.subtract.at(edge, (ys[:-1], ys[1:]), 1)
                for t, r in enumerate(rows):
                    grad = node[t] + l2 * self.state[r]
                    g_state[r] += grad**2
                    self.state[r] -= rate * grad / np.sqrt(g_state[r])
                edge = edge + l2 * self.step
                g_step += edge**2
                self.step -= rate * edge / np.sqrt(g_step)
                g_start += node[0] ** 2
                self.start -= rate * node[0] / np.sqrt(g_start)
        return self

    def _marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward in probabilities scaled at each step."""
        n, k = s.shape
        psi = np.exp(s - s.max(axis=1, keepdims=True))
        move = np.exp(self.step - self.step.max())
        fwd, bwd = np.empty((n, k)), np.ones((n, k))
        fwd[0] = psi[0] * np.exp(self.start - self.start.max())
        fwd[0] /= fwd[0].sum()
        for t in range(1, n):
            fwd[t] = psi[t] * (fwd[t - 1] @ move)
            fwd[t] /= fwd[t].sum()
        for t in range(n - 2, -1, -1):
            bwd[t] = move @ (psi[t + 1] * bwd[t + 1])
            bwd[t] /= bwd[t].sum()
        node = fwd * bwd
        node /= node.sum(axis=1, keepdims=True)
        edge = fwd[:-1, :, None] * move * (psi[1:] * bwd[1:])[:, None, :]
        edge /= np.maximum(edge.sum(axis=(1, 2), keepdims=True), 1e-300)
        return node, edge

    def decode(self, seq: list[list[str]]) -> list[str]:
        """The most likely label sequence (Viterbi); ties go to the label listed first."""
        if not seq:
            return []
        get = self.features.get
        ids = [[i for f in fs if (i := get(f)) is not None] or [-1] for fs in seq]
        flat = np.fromiter((i for r in ids for i in r), dtype=np.int64)
        at = np.cumsum([0, *map(len, ids[:-1])])
        s = np.add.reduceat(np.where(flat[:, None] < 0, 0.0, self.state[flat]), at, axis=0)
        best, back = s[0] + self.start, []
        for t in range(1, len(s)):
            through = best[:, None] + self.step
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + s[t]
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return [self.labels[i] for i in reversed(y)]
