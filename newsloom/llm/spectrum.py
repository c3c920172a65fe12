"""Leading eigenvalues and vectors of a symmetric matrix by spectrum slicing.

The inertia of A - sI, read off an LDL' factorisation, counts the eigenvalues above s (Sylvester's law). Bisection on these counts
isolates every leading eigenvalue; Rayleigh quotient iteration then converges cubically to it, and counts on both sides of the
result certify its number. Eigenvalues too close to tell apart are one cluster, whose space is found by inverse
iteration on a block.
"""

from __future__ import annotations

import numpy as np

_BALANCE = (1 + 17**0.5) / 8
#: Of the matrix's norm: eigenvalues in an interval this narrow are a cluster.
TOGETHER = 1e-12
#: Of the norm: the residual under which a vector is taken once it improves no more.
SETTLED = 1e-13


def pivots(a: np.ndarray) -> tuple[int, int]:
    """Positive and negative eigenvalues of the block diagonal factor D of a = P L D L' P', with pivots of one or two rows."""
    a, n, k = a.copy(), len(a), 0
    positive = negative = 0
    while k < n:
        here, size, swap = abs(a[k, k]), 1, k
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            most = k + 1 + int(column.argmax())
            largest = column[most - k - 1]
            if here < _BALANCE * largest:
                row = np.abs(a[most, k:])
                row[most - k] = 0
                other = row.max()
                if here * other < _BALANCE * largest * largest:
                    swap, size = most, 1 if abs(a[most, most]) >= _BALANCE * other else 2
        at = k + size - 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        if size == 1:
            d = a[k, k]
            positive, negative = positive + (d > 0), negative + (d < 0)
            if d:
                left = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(left / d, left)
        else:
            # Such a block is always indefinite.
            positive, negative = positive + 1, negative + 1
            block, left = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= left @ np.linalg.solve(block, left.T)
        k += size
    return positive, negative


class Slices:
    """Counts of eigenvalues above shifts, each factorised once."""

    def __init__(self, a: np.ndarray):
        self.a = (a + a.T) / 2
        self.norm = float(np.abs(self.a).sum(1).max())
        self.known: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = pivots(self.a - shift * np.eye(len(self.a)))[0]
        return self.known[shift]

    def isolated(self, most: int) -> list[tuple[float, float, int, int]]:
        """(low, high, first, last): intervals, from the top, that hold eigenvalues number first to last; one, or a cluster."""
        bound, found = self.norm * (1 + 1e-9), []
        stack = [(-bound, bound)]
        while stack:
            low, high = stack.pop()
            first, last = self.above(high) + 1, self.above(low)
            if first > last or first > most:
                continue
            middle = (low + high) / 2
            if first == last or high - low <= TOGETHER * self.norm or not low < middle < high:
                found.append((low, high, first, last))
            else:
                stack += [(low, middle), (middle, high)]
        return found


def _orthogonal(block: np.ndarray, to: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = np.linalg.qr(block - to @ (to.T @ block))[0]
    return block


def _solved(a: np.ndarray, shift: float, right: np.ndarray, norm: float) -> np.ndarray:
    for k in range(20):
        try:
            out = np.linalg.solve(a - (shift + k * 1e-16 * norm) * np.eye(len(a)), right)
            if np.isfinite(out).all():
                return out / np.linalg.norm(out, axis=0)
        except np.linalg.LinAlgError:
            pass
    raise ArithmeticError("no shift near the eigenvalue can be solved for")


def _rayleigh(s: Slices, low: float, high: float, number: int, found: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, float, int, int]:
    """Eigenvalue ``number``, the only one in (low, high], its vector, a distance, and the first and last number within it.

    Where an iteration leaves the interval, or counts around its result do not have the number, the interval is halved.
    """
    while True:
        middle = (low + high) / 2
        v = _orthogonal(start[:, None], found)
        for _ in range(2):
            v = _orthogonal(_solved(s.a, middle, v, s.norm), found)
        best = None
        for _ in range(12):
            value = float((v.T @ s.a @ v)[0, 0])
            residual = float(np.linalg.norm(s.a @ v - value * v))
            settled = best and best[2] <= SETTLED * s.norm
            if not low <= value <= high or settled and residual >= best[2] / 2:
                break
            best = value, v, residual
            v = _orthogonal(_solved(s.a, value, v, s.norm), found)
        if best and best[2] <= SETTLED * s.norm:
            apart = max(2 * best[2], 64 * np.finfo(float).eps * s.norm)
            first, last = s.above(best[0] + apart) + 1, s.above(best[0] - apart)
            if first <= number <= last:
                return best[0], best[1], apart, first, last
        if not low < middle < high:
            raise ArithmeticError("an isolated eigenvalue was not found")
        low, high = (middle, high) if s.above(middle) > s.above(high) else (low, middle)


def _cluster(s: Slices, low: float, high: float, number: int, found: np.ndarray, random: np.random.Generator) -> np.ndarray:
    block = _orthogonal(random.normal(size=(len(s.a), number)), found)
    for _ in range(4):
        block = _orthogonal(_solved(s.a, (low + high) / 2, block, s.norm), found)
    return block


def leading(a: np.ndarray, most: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of ``a`` (all, if fewer), falling, and unit vectors as columns."""
    if not len(a) or not np.any(a):
        return np.zeros(min(most, len(a))), np.eye(len(a))[:, :most]
    s, random = Slices(a), np.random.default_rng(seed)
    values, vectors = [], np.zeros((len(a), 0))
    todo = s.isolated(most)[::-1]
    while todo:
        low, high, first, last = todo.pop()
        # A cluster found before may reach into this interval.
        first = max(first, len(values) + 1)
        if first > last:
            continue
        if first == last:
            value, vector, apart, first, last = _rayleigh(s, low, high, first, vectors, random.normal(size=len(a)))
            if first == last:
                values.append(value)
                vectors = np.hstack([vectors, vector])
                continue
            # Neighbours are closer than counts can tell: all of them are one cluster.
            low, high = value - apart, value + apart
            values, vectors = values[: first - 1], vectors[:, : first - 1]
        block = _cluster(s, low, high, last - first + 1, vectors, random)
        values += np.einsum("ij,ij->j", block, s.a @ block).tolist()
        vectors = np.hstack([vectors, block])
    order = np.argsort(-np.array(values), kind="stable")[:most]
    return np.array(values)[order], vectors[:, order]
