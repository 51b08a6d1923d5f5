"""A linear-chain conditional random field with two labels, trained by gradient, decoded by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """``weights``: score of label 1 over label 0 per feature; ``moves[a, b]``: label a, then b."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]
    first: float  # score of label 1 over label 0 at the start

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi over the scores of label 1; ties go to label 0."""
        (m00, m01), (m10, m11) = self.moves
        zero, one = 0.0, self.first
        back: list[tuple[int, int]] = []
        for t, s in enumerate(scores):
            if t:
                from0 = int(one + m10 > zero + m00)
                from1 = int(one + m11 > zero + m01)
                zero, one = (one + m10 if from0 else zero + m00), (one + m11 if from1 else zero + m01) + s
                back.append((from0, from1))
            else:
                one += s
        label = int(one > zero) if scores else 0
        out = [label] if scores else []
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log Z in all, P(label 1) per place, and the expected number of each move.

    ``emit`` and ``mask`` are pages x places; a page's places come first, then padding.
    """
    n, length = emit.shape
    both = np.stack([np.zeros_like(emit), emit], axis=2)
    ahead = np.empty((n, length, 2))
    ahead[:, 0] = both[:, 0]
    for t in range(1, length):
        step = _logsum(ahead[:, t - 1, :, None] + moves, 1) + both[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    after = np.zeros((n, length, 2))
    for t in range(length - 2, -1, -1):
        step = _logsum(moves + (both[:, t + 1] + after[:, t + 1])[:, None, :], 2)
        after[:, t] = np.where(mask[:, t + 1, None], step, after[:, t + 1])
    log_z = _logsum(ahead[:, -1], 1)
    one = np.exp(ahead[:, :, 1] + after[:, :, 1] - log_z[:, None]) * mask
    pair = ahead[:, :-1, :, None] + moves + (both[:, 1:] + after[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
    expected = (np.exp(np.minimum(pair, 0.0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
    return float(log_z.sum()), one, expected


def train(
    pages: list[list[list[str]]], labels: list[list[int]], penalty: float = 1.0, rounds: int = 100, rate: float = 0.1
) -> Chain:
    """Maximise the penalised likelihood of ``labels``; a page is a list of feature lists.

    Full gradients from forward-backward sums over all pages, with Adam's step sizes.
    """
    kept = [(p, y) for p, y in zip(pages, labels, strict=True) if p]
    if not kept:
        return Chain({}, ((0.0, 0.0), (0.0, 0.0)), 0.0)
    names: dict[str, int] = {}
    sized: dict[int, list] = {}  # pages of like length together, so that padding at most doubles them
    for page in kept:
        sized.setdefault(len(page[0]).bit_length(), []).append(page)
    groups, at, slot, truths = [], [], [], []
    start = 0
    for group in sized.values():
        length = max(len(p) for p, _ in group)
        mask, truth = np.zeros((len(group), length), bool), np.zeros((len(group), length))
        for i, (page, y) in enumerate(group):
            mask[i, : len(page)] = True
            truth[i, : len(page)] = y
            for t, features in enumerate(page):
                for f in features:
                    at.append(start + i * length + t)
                    slot.append(names.setdefault(f, len(names)))
        groups.append((slice(start, start + mask.size), mask))
        truths.append(truth.ravel())
        start += mask.size
    truth = np.concatenate(truths)
    begins = np.concatenate([s.start + np.arange(0, m.size, m.shape[1]) for s, m in groups])
    at_, slot_ = np.asarray(at), np.asarray(slot)
    size = len(names)
    moved = np.zeros((2, 2))
    for _, y in kept:
        for a, b in zip(y, y[1:], strict=False):
            moved[a, b] += 1
    x = np.zeros(size + 5)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, moves, first = x[:size], x[size : size + 4].reshape(2, 2), x[-1]
        emit = np.bincount(at_, w[slot_], minlength=start)
        emit[begins] += first
        one, expected = np.empty(start), np.zeros((2, 2))
        for where, mask in groups:
            _, p, n = _marginals(emit[where].reshape(mask.shape), mask, moves)
            one[where] = p.ravel()
            expected += n
        rest = truth - one
        gradient = np.concatenate(
            [np.bincount(slot_, rest[at_], minlength=size), (moved - expected).ravel(), [rest[begins].sum()]]
        ) - penalty * x
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x = x + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    moves = x[size : size + 4]
    return Chain(
        {f: float(x[i]) for f, i in names.items()},
        ((float(moves[0]), float(moves[1])), (float(moves[2]), float(moves[3]))), float(x[-1]),
    )
