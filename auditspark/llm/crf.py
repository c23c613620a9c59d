"""A linear-chain conditional random field over two labels.

Sequences of many documents are laid end to end. A position's step is a 2 x 2 matrix,
and one that starts a document forgets what came before, so forward and backward
messages of all documents come out of one blocked scan: products within blocks of all
columns at once, a short walk over the blocks, and a second pass with known starts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _steps(gain: np.ndarray, start: np.ndarray, trans: np.ndarray, first: float) -> np.ndarray:
    """(n, 2, 2) matrices; gain is the score of label 1 over 0, trans and first are log weights."""
    up, down = 1 / (1 + np.exp(-gain)), 1 / (1 + np.exp(gain))
    w = np.exp(trans - trans.max())
    f1, f0 = 1 / (1 + np.exp(-first)), 1 / (1 + np.exp(first))
    m = np.empty((len(gain), 2, 2))
    for i in (0, 1):
        m[:, i, 0] = np.where(start, f0, w[i, 0]) * down
        m[:, i, 1] = np.where(start, f1, w[i, 1]) * up
    return m


def _scan(m: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_(t-1) m_t, each scaled to sum 1, from (1, 1)."""
    n = len(m)
    width = max(1, int(np.sqrt(n / 4)))
    rows = -(-n // width)
    padded = np.empty((rows * width, 2, 2))
    padded[:n] = m
    padded[n:] = np.eye(2)
    grid = padded.reshape(rows, width, 2, 2)
    total = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for k in range(width):
        x = grid[:, k]
        total = np.stack((total[:, :, 0] * x[:, None, 0, 0] + total[:, :, 1] * x[:, None, 1, 0], total[:, :, 0] * x[:, None, 0, 1] + total[:, :, 1] * x[:, None, 1, 1]), 2)
        total /= total.sum((1, 2), keepdims=True)
    v, before = (0.5, 0.5), np.empty((rows, 2))
    for r, t in enumerate(total.tolist()):
        before[r] = v
        a, b = v[0] * t[0][0] + v[1] * t[1][0], v[0] * t[0][1] + v[1] * t[1][1]
        v = (a / (a + b), b / (a + b))
    out = np.empty((rows, width, 2))
    a, b = before[:, 0], before[:, 1]
    for k in range(width):
        x = grid[:, k]
        c, d = a * x[:, 0, 0] + b * x[:, 1, 0], a * x[:, 0, 1] + b * x[:, 1, 1]
        s = c + d
        a, b = c / s, d / s
        out[:, k, 0], out[:, k, 1] = a, b
    return out.reshape(-1, 2)[:n]


@dataclass
class Chain:
    """Transition log weights (from, to) and the log weight of starting in label 1."""

    trans: np.ndarray
    first: float

    def messages(self, gain: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = _steps(np.clip(gain, -30, 30), start, self.trans, self.first)
        ahead = _scan(m)
        # Backward: beta_(t-1) = m_t beta_t, the transposed scan in reverse.
        back = np.full((len(m), 2), 0.5)
        if len(m) > 1:
            back[:-1] = _scan(m[:0:-1].transpose(0, 2, 1))[::-1]
        return m, ahead, back

    def marginals(self, gain: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The probability of label 1 at each position."""
        if not len(gain):
            return np.empty(0)
        _, ahead, back = self.messages(gain, start)
        both = ahead * back
        return both[:, 1] / both.sum(1)


def fit(gain_of, push, size: int, label: np.ndarray, start: np.ndarray, weight: np.ndarray, rounds: int = 80, rate: float = 0.15, l2: float = 1e-4) -> tuple[np.ndarray, Chain]:
    """Weights and chain of greatest penalised likelihood, by Adam steps.

    ``gain_of(w)`` gives the positions' gains, ``push(g)`` a gradient of the gains as one
    of the weights; ``label`` and ``weight`` are per position, ``start`` marks documents.
    """
    w, chain = np.zeros(size), Chain(np.zeros((2, 2)), 0.0)
    state = np.zeros((2, size + 5))
    total = weight.sum()
    y = label.astype(int)
    inner = ~start
    for step in range(1, rounds + 1):
        gain = gain_of(w)
        m, ahead, back = chain.messages(gain, start)
        both = ahead * back
        p = both[:, 1] / both.sum(1)
        grad = np.zeros(size + 5)
        grad[:size] = push((label - p) * weight) / total - l2 * w
        prev = np.concatenate(([0], np.flatnonzero(inner)[:] - 1))[1:] if inner.any() else np.empty(0, int)
        here = np.flatnonzero(inner)
        if len(here):
            pair = ahead[prev][:, :, None] * m[here] * back[here][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            want = np.zeros((2, 2))
            np.add.at(want, (y[prev], y[here]), weight[here])
            grad[size : size + 4] = ((want - (pair * weight[here][:, None, None]).sum(0)) / total).ravel()
        grad[size + 4] = ((label - p) * weight)[start].sum() / total
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w = w + move[:size]
        chain = Chain(np.clip(chain.trans + move[size : size + 4].reshape(2, 2), -6, 6), float(np.clip(chain.first + move[size + 4], -6, 6)))
    return w, chain


def all_zero(chain: Chain, gain: np.ndarray, start: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n documents the log probability that no position has label 1; the positions' marginals and pair marginals.

    By the chain rule: of the first position, and of each next one given that the one before has label 0.
    """
    m, ahead, back = chain.messages(gain, start)
    both = ahead * back
    p = both[:, 1] / both.sum(1)
    here = np.flatnonzero(~start)
    pair = ahead[here - 1][:, :, None] * m[here] * back[here][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    step = np.log(np.maximum(1 - p, 1e-300))
    step[here] = np.log(np.maximum(pair[:, 0, 0], 1e-300)) - np.log(np.maximum(pair[:, 0].sum(1), 1e-300))
    return np.bincount(number, weights=step, minlength=n), p, pair


def fit_latent(gain_of, push, size: int, marked: np.ndarray, start: np.ndarray, number: np.ndarray, noise: float, rounds: int = 80, rate: float = 0.1, l2: float | np.ndarray = 1e-4) -> tuple[np.ndarray, Chain]:
    """Weights and chain from labels of whole documents; those of the positions are latent.

    A document's mark says that at least one of its positions has label 1, and no mark that
    none has, but either is wrong with probability ``noise``. Adam steps, ever smaller, climb
    the likelihood of the marks: with q the probability of no label 1 and f the features, a
    document's gradient is a factor of q times f of the all-zero labelling less its expectation.
    """
    w, chain = np.zeros(size), Chain(np.zeros((2, 2)), 0.0)
    state = np.zeros((2, size + 5))
    here = np.flatnonzero(~start)
    inner = np.bincount(number[here], minlength=len(marked))
    for step in range(1, rounds + 1):
        logq, p, pair = all_zero(chain, gain_of(w), start, number, len(marked))
        q = np.exp(logq)
        seen = noise + (1 - 2 * noise) * np.where(marked, 1 - q, q)
        factor = np.where(marked, -1, 1) * (1 - 2 * noise) * q / seen / len(marked)
        own = factor[number]
        grad = np.zeros(size + 5)
        grad[:size] = push(-p * own) - l2 * w
        expected = (pair * own[here][:, None, None]).sum(0)
        expected[0, 0] -= (inner * factor).sum()
        grad[size : size + 4] = -expected.ravel()
        grad[size + 4] = -(p * own)[start].sum()
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        move = rate / (1 + step / 30) * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w = w + move[:size]
        chain = Chain(np.clip(chain.trans + move[size : size + 4].reshape(2, 2), -6, 6), float(np.clip(chain.first + move[size + 4], -6, 6)))
    return w, chain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Adam steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w, state = np.zeros(x.shape[1]), np.zeros((2, x.shape[1]))
    for step in range(1, rounds + 1):
        grad = x.T @ ((y - 1 / (1 + np.exp(-x @ w))) * weight) / weight.sum() - l2 * w
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        w = w + rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
    return w
