import itertools

import numpy as np
import pytest

from casemill.llm.crf import LinearChainCRF


def brute(model, x, lengths):
    """Marginals and best sequences by enumeration."""
    marginals, best, at = [], [], 0
    for n in lengths:
        e = sum(model.weights[x[at : at + n, k]] for k in range(x.shape[1]))
        total, own, top = 0.0, np.zeros((n, 2)), (-np.inf, None)
        for y in itertools.product(range(2), repeat=n):
            s = model.first[y[0]] + sum(e[i, c] for i, c in enumerate(y)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:]))  # noqa: B905
            total += np.exp(s)
            own[range(n), y] += np.exp(s)
            top = max(top, (s, y))
        marginals.append(own / total)
        best += top[1]
        at += n
    return np.concatenate(marginals), best


def test_passes_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 6, 2, 6])
    x = rng.integers(0, 7, (lengths.sum(), 3))
    model = LinearChainCRF(rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    marginals, best = brute(model, x, lengths)
    with_empty = np.array([0, 3, 1, 0, 6, 2, 6, 0])
    assert model.marginals(x, with_empty) == pytest.approx(marginals)
    assert model.decode(x, with_empty).tolist() == best
    assert len(model.decode(x[:0], np.array([0]))) == 0 and len(model.marginals(x[:0], np.array([], int))) == 0


def test_fitting_learns_the_chain():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9, 300)
    y = np.concatenate([np.cumsum(rng.random(n) < 0.15) % 2 for n in lengths])
    x = np.stack([np.where(rng.random(len(y)) < 0.75, y, 1 - y), 2 + rng.integers(0, 3, len(y))], 1)
    model = LinearChainCRF.fit(x, y, lengths, 5)
    assert (model.decode(x, lengths) == y).mean() > (x[:, 0] == y).mean() + 0.03
    assert model.transitions[0, 0] > model.transitions[0, 1]
