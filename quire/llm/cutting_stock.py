"""One-dimensional cutting stock by column generation.

Items come as a histogram over size classes 1..capacity. The master linear program covers every class's demand with
patterns (multisets of classes that fit the capacity) and minimises the number of patterns used; an unbounded
knapsack, solved by dynamic programming over the capacity, prices new patterns by the master's duals. Uses are
rounded down and what remains, fewer pieces than the basis holds, is packed first-fit decreasing. Work depends on the
number of classes, never on the number of items.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (class, copies)


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes (values[c - 1] for class c) that fits, and its copies of each class."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    useful = np.flatnonzero(values > 1e-12) + 1
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = useful[useful <= room]
        if len(fit):
            got = best[room - fit] + values[fit - 1]
            k = int(np.argmax(got))
            if got[k] > best[room] + 1e-12:
                best[room], take[room] = got[k], fit[k]
    copies = np.zeros(capacity, np.int64)
    room = capacity
    while room > 0:
        if take[room]:
            copies[take[room] - 1] += 1
            room -= int(take[room])
        else:
            room -= 1
    return float(best[capacity]), copies


def solve(demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold exactly ``demand[c - 1]`` items of class c."""
    classes = np.flatnonzero(demand) + 1
    m = len(classes)
    if not m:
        return []
    need = demand[classes - 1].astype(float)
    fit = capacity // classes
    columns = np.diag(fit).astype(float)  # of the basis
    inverse = np.diag(1.0 / fit)
    uses = need / fit
    values = np.zeros(capacity)
    for _ in range(rounds):
        duals = inverse.sum(0)
        values[classes - 1] = duals
        worth, copies = price(values, capacity)
        if worth <= 1 + 1e-7:
            break
        column = copies[classes - 1].astype(float)
        step = inverse @ column
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = uses[up] / step[up]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        uses = uses - step * ratio[out]
        uses[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
    counts = np.maximum(np.floor(uses + 1e-6), 0).astype(np.int64)
    shape = np.rint(columns).astype(np.int64)
    left = demand[classes - 1].astype(np.int64) - shape @ counts
    for j in np.flatnonzero(counts):  # rounding of floats may have used one too many
        while counts[j] and (short := left[shape[:, j] > 0]).size and short.min() < 0:
            counts[j] -= 1
            left = left + shape[:, j]
    found = [(tuple((int(classes[i]), int(shape[i, j])) for i in np.flatnonzero(shape[:, j])), int(counts[j])) for j in np.flatnonzero(counts)]
    bins: list[list[int]] = []
    room: list[int] = []
    for i in np.argsort(-classes):
        size = int(classes[i])
        for _ in range(int(left[i])):
            k = next((k for k, r in enumerate(room) if r >= size), None)
            if k is None:
                bins.append([])
                room.append(capacity)
                k = len(bins) - 1
            bins[k].append(size)
            room[k] -= size
    for b in bins:
        found.append((tuple((c, b.count(c)) for c in sorted(set(b))), 1))
    return found
