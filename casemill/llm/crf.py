"""A linear-chain conditional random field over binary features, in numpy.

A row is given by the numbers of its active features, as many for each row; the matrix of
features is never written out. Sequences lie end to end in one array. Forward, backward and Viterbi passes run in lockstep over
all sequences that are long enough for a step, so a step costs a few vector operations whatever
the number of sequences. Training maximises the penalised log likelihood by Adam, full batch and
from zero weights: the same rows give the same model.
"""

from __future__ import annotations

import numpy as np


class _Layout:
    """Which rows are step t of their sequences."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        order = np.argsort(-self.lengths, kind="stable")
        self.starts = starts[order][self.lengths[order] > 0]
        own = self.lengths[order][self.lengths[order] > 0]
        self.last = self.starts + own - 1
        self.order = order[: len(own)]
        # alive[t]: so many of the ordered sequences have a step t
        self.alive = len(own) - np.searchsorted(own[::-1], np.arange(1, (own[0] if len(own) else 0) + 1), "left")

    def rows(self, t: int) -> np.ndarray:
        return self.starts[: self.alive[t]] + t


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class LinearChainCRF:
    """Weights ``(features, labels)``, transitions ``(labels, labels)`` and starts."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.transitions, self.first = weights, transitions, first

    def _emit(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.weights.shape[1]))
        for k in range(x.shape[1]):
            out += self.weights[x[:, k]]
        return out

    def _passes(self, x: np.ndarray, lay: _Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        emit = self._emit(x)
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        for t in range(len(lay.alive)):
            r = lay.rows(t)
            ahead[r] = emit[r] + (self.first if t == 0 else _logsum(ahead[r - 1][:, :, None] + self.transitions, 1))
        for t in range(len(lay.alive) - 1, 0, -1):
            r = lay.rows(t)
            back[r - 1] = _logsum((emit[r] + back[r])[:, None, :] + self.transitions, 2)
        return emit, ahead, back

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each label at each row, by forward and backward passes."""
        lay = _Layout(lengths)
        if not len(x):
            return np.zeros((0, len(self.first)))
        _, ahead, back = self._passes(x, lay)
        both = ahead + back
        return np.exp(both - _logsum(both, 1)[:, None])

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest label sequence, by Viterbi."""
        lay = _Layout(lengths)
        best = self._emit(x)
        came = np.zeros(best.shape, np.int64)
        for t in range(len(lay.alive)):
            r = lay.rows(t)
            if t == 0:
                best[r] += self.first
            else:
                paths = best[r - 1][:, :, None] + self.transitions
                came[r] = paths.argmax(1)
                best[r] += paths.max(1)
        out = np.zeros(len(x), np.int64)
        out[lay.last] = best[lay.last].argmax(1)
        for t in range(len(lay.alive) - 1, 0, -1):
            r = lay.rows(t)
            out[r - 1] = came[r, out[r]]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, n: int, weight: np.ndarray | None = None, labels: int = 2, penalty: float = 1.0, rounds: int = 120, rate: float = 0.1) -> LinearChainCRF:
        """``n``: number of features; ``weight``: of each sequence (1 each if None); ``penalty``: of the squared weights."""

        def summed(p: np.ndarray) -> np.ndarray:
            """Sums of the rows of ``p`` by active feature."""
            return np.stack([sum(np.bincount(x[:, k], p[:, c], n) for k in range(x.shape[1])) for c in range(labels)], 1)

        lay = _Layout(lengths)
        of = np.ones(len(lengths)) if weight is None else np.asarray(weight, float)
        row_weight = np.repeat(of, lay.lengths)[:, None]
        total = max(of.sum(), 1e-9)
        theta = np.zeros(n * labels + labels * labels + labels)
        truth = np.eye(labels)[y]
        inner = np.ones(len(x), bool)
        inner[lay.starts] = False
        at = np.flatnonzero(inner)
        pairs = np.zeros((labels, labels))
        np.add.at(pairs, (y[at - 1], y[at]), row_weight[at, 0])
        seen = [summed(truth * row_weight), pairs, (truth * row_weight)[lay.starts].sum(0)]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            model = cls._of(theta, n, labels)
            emit, ahead, back = model._passes(x, lay)
            norm = np.zeros(len(x))
            z = _logsum(ahead[lay.last], 1)
            norm[lay.starts] = z
            norm = np.repeat(norm[np.cumsum(lay.lengths[lay.lengths > 0]) - lay.lengths[lay.lengths > 0]], lay.lengths[lay.lengths > 0])
            p = np.exp(ahead + back - norm[:, None]) * row_weight
            joint = np.exp(ahead[at - 1][:, :, None] + model.transitions + (emit + back)[at][:, None, :] - norm[at][:, None, None])
            want = [summed(p), (joint * row_weight[at][:, :, None]).sum(0), p[lay.starts].sum(0)]
            grad = np.concatenate([(w - s).ravel() for w, s in zip(want, seen, strict=True)]) / total + penalty / total * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls._of(theta, n, labels)

    @classmethod
    def _of(cls, theta: np.ndarray, n: int, labels: int) -> LinearChainCRF:
        a, b = n * labels, n * labels + labels * labels
        return cls(theta[:a].reshape(n, labels), theta[a:b].reshape(labels, labels), theta[b:])
