"""Linear-chain CRF kernels over batches of chains."""

from __future__ import annotations

import numpy as np


def forward_backward(scores: np.ndarray, real: np.ndarray, steps: np.ndarray):
    """scores (chains, length, labels) and real (chains, length) -> marginals, and
    the scaled messages, emissions and transitions they come from."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(steps - steps.max()).astype(np.float32)
    n, length, k = e.shape
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, length):
        a = (ahead[:, i - 1] @ t) * e[:, i]
        ahead[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(length - 2, -1, -1):
        b = (e[:, i + 1] * back[:, i + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        back[:, i] = np.where(real[:, i + 1, None], b, 1)
    both = ahead * back
    both /= both.sum(axis=2, keepdims=True)
    return both, ahead, back, e, t


def pair_expectations(ahead, back, e, t, real):
    """Expected label pairs, summed over chains, from what forward_backward returns."""
    left, right = ahead[:, :-1], (e * back)[:, 1:]
    z = np.einsum("nik,kl,nil->ni", left, t, right)
    weight = real[:, 1:] / np.maximum(z, 1e-30)
    return t * np.einsum("nik,nil,ni->kl", left, right, weight)


def viterbi_two(scores: list[float], steps) -> list[int]:
    """Best labels of one chain with labels 0 and 1, where label 0 scores zero; ties go to 0."""
    (a, b), (c, d) = steps
    zero = one = 0.0
    back = []
    for i, s in enumerate(scores):
        if i:
            from_one, to_one = one + c > zero + a, one + d > zero + b
            zero, one = (one + c if from_one else zero + a), (one + d if to_one else zero + b)
            back.append((from_one, to_one))
        one += s
    label = int(one > zero)
    out = [label] if scores else []
    for pair in reversed(back):
        label = int(pair[label])
        out.append(label)
    return out[::-1]
