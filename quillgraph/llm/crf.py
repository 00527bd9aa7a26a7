"""A linear-chain conditional random field in numpy: training and batched Viterbi.

A position's features are numbers of binary features; its score for a label is
the sum of their weights. Sequences are given end to end, with their starts.
"""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Crf:
    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    @classmethod
    def trained(cls, features: list[np.ndarray], labels: list[np.ndarray], n_features: int, n_labels: int, steps: int = 150, rate: float = 0.2, l2: float = 1e-3) -> Crf:
        """features: per sequence a matrix (positions, features a position) of feature numbers; labels: per sequence its labels.

        Full-batch gradient of the regularised log-likelihood, with Adam steps.
        """
        order = sorted(range(len(features)), key=lambda i: -len(features[i]))
        features, labels = [features[i] for i in order], [labels[i] for i in order]
        n = np.array([len(x) for x in labels])
        count, longest = len(n), int(n.max())
        f = np.zeros((longest, count, features[0].shape[1]), np.int64)
        y = np.zeros((longest, count), np.int64)
        for i, (a, b) in enumerate(zip(features, labels, strict=True)):
            f[: len(b), i], y[: len(b), i] = a, b
        mask = np.arange(longest)[:, None] < n
        valid = np.flatnonzero(mask.ravel())
        columns = [f[:, :, c].ravel()[valid] for c in range(f.shape[2])]
        emit, move, begin = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
        m = [np.zeros_like(x) for x in (emit, move, begin)]
        v = [np.zeros_like(x) for x in (emit, move, begin)]
        for step in range(1, steps + 1):
            score = emit[f].sum(2)
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[0] = score[0] + begin
            for t in range(1, longest):
                new = _logsumexp(alpha[t - 1][:, :, None] + move, 1) + score[t]
                alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
            for t in range(longest - 2, -1, -1):
                new = _logsumexp(move + (score[t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(mask[t + 1][:, None], new, 0.0)
            z = _logsumexp(alpha[-1], 1)
            p = np.exp(alpha + beta - z[:, None]) * mask[:, :, None]
            want = np.eye(n_labels)[y] * mask[:, :, None]
            grad = [l2 * count * x for x in (emit, move, begin)]
            d = (p - want).reshape(-1, n_labels)
            for c in range(f.shape[2]):
                for k in range(n_labels):
                    grad[0][:, k] += np.bincount(columns[c], weights=d[valid, k], minlength=n_features)
            for t in range(1, longest):
                on = mask[t]
                if not on.any():
                    break
                pair = np.exp(alpha[t - 1][on][:, :, None] + move + (score[t] + beta[t])[on][:, None, :] - z[on][:, None, None])
                grad[1] += pair.sum(0)
                np.add.at(grad[1], (y[t - 1][on], y[t][on]), -1.0)
            grad[2] += (p[0] - want[0]).sum(0)
            for i, x in enumerate((emit, move, begin)):
                g = grad[i] / count
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return cls(emit, move, begin)

    def decoded(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best labels, by Viterbi over all sequences at once, the longest first."""
        n = np.diff(starts)
        out = np.zeros(len(scores), np.int8)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        if not len(order):
            return out
        n, first = n[order], starts[:-1][order]
        best = scores[first] + self.begin
        back = np.zeros(scores.shape, np.int8)
        live = len(order)
        final = np.zeros(len(order), np.int64)
        t = 1
        while True:
            now = int(np.searchsorted(-n[:live], -t, "left"))  # sequences longer than t
            final[now:live] = best[now:live].argmax(1)
            live = now
            if not live:
                break
            at = first[:live] + t
            total = best[:live, :, None] + self.move
            arg = total.argmax(1)
            back[at] = arg
            best = np.take_along_axis(total, arg[:, None, :], 1)[:, 0] + scores[at]
            t += 1
        label = final
        for t in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, "left"))
            at = first[:live] + t
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return out
