"""The packing plan: a configuration linear program over a histogram of lengths."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Slot:
    """Places of ``copies * times`` items of one length, whose ranks start at ``first``.

    Item number i of them goes to sequence ``sequence + i % times`` at ``offset + i // times * length``.
    """

    length: int
    first: int
    times: int
    copies: int
    sequence: int
    offset: int


def best_fill(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for each capacity up to ``capacity``: the best value, and the index of one item in it (-1: none).

    lengths ascends.
    """
    value, item = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = price[: fits[c]] + value[c - lengths[: fits[c]]]
        k = int(np.argmax(gain))
        if gain[k] > value[c - 1]:
            value[c], item[c] = gain[k], k
        else:
            value[c], item[c] = value[c - 1], -2  # as with one unit less
    return value, item


def _items(first: int, lengths: np.ndarray, item: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration that holds item ``first`` and fills what is left as the knapsack says: index to copies."""
    out, left = {first: 1}, capacity - int(lengths[first])
    while left > 0 and item[left] != -1:
        k = int(item[left])
        if k == -2:
            left -= 1
            continue
        out[k] = out.get(k, 0) + 1
        left -= int(lengths[k])
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 40, rate: float = 0.5) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """Columns of the covering linear program with their amounts, and a lower bound on its optimum.

    Multiplicative weights: every length has a price, at first its share of the capacity, that falls exponentially with
    the share of its items that is covered. Each round prices configurations by one knapsack run, takes, for each length
    still open, the best configuration holding it, and uses it as far as open amounts reach. Scaled prices are feasible
    in the dual, so every round bounds the optimum from below.
    """
    open_, columns, bound = counts.astype(float), [], 0.0
    for _ in range(rounds):
        alive = np.flatnonzero(open_ > 1e-9 * counts)
        if not len(alive):
            break
        covered = 1 - open_[alive] / counts[alive]
        price = lengths[alive] / capacity * np.exp(-rate * covered)
        value, item = best_fill(price, lengths[alive], capacity)
        if len(alive) == len(lengths):
            bound = max(bound, float(price @ counts[alive]) / value[capacity])
        moved = False
        for k in range(len(alive) - 1, -1, -1):
            if open_[alive[k]] <= 1e-9 * counts[alive[k]]:
                continue
            config = _items(k, lengths[alive], item, capacity)
            ids = alive[list(config)]
            copies = np.fromiter(config.values(), float)
            amount = float(np.min(open_[ids] / copies))
            if amount > 1e-9:
                open_[ids] -= amount * copies
                columns.append((amount, dict(zip(ids.tolist(), config.values(), strict=True))))
                moved = True
        if not moved:
            break
    return columns, bound


def fill_rest(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Configurations with how often each is used, for all items of a histogram: each the largest length left and then, again
    and again, the largest that fits.

    A configuration is used as often as counts reach, which uses up a length or leaves too few of it for the next one, so
    there are few however many items there are.
    """
    left = {n: c for n, c in left.items() if c}
    below = list(range(capacity + 1))  # the way down to the largest open length up to each, 0 for none

    def fitting(room: int) -> int:
        way = []
        while room and room not in left:
            way.append(room)
            room = below[room] if below[room] < room else room - 1
        for r in way:
            below[r] = room
        return room

    out = []
    while left:
        config, room, below_last = {}, capacity, capacity
        while n := fitting(min(room, below_last)):
            config[n] = min(left[n], room // n)
            room, below_last = room - n * config[n], n - 1
        times = min(left[n] // c for n, c in config.items())
        for n, c in config.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((times, config))
    return out


def plan(histogram: dict[int, int], capacity: int, passes: int = 3) -> tuple[list[Slot], int, float]:
    """Slots for all items, the number of sequences, and a lower bound on any packing's number of sequences.

    The fractional amounts are rounded down; what this leaves is solved again, ``passes`` times in all, and the rest
    is packed by the largest length that fits (:func:`fill_rest`). Equal configurations are one, whatever round or pass they come from. A round makes a configuration for each
    length at most, and a configuration has a slot for each of its lengths, so slots are bounded by the lengths, rounds and
    passes, whatever the counts.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    if not len(lengths):
        return [], 0, 0.0
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    left, bound = np.array([histogram[int(k)] for k in lengths], np.int64), 0.0
    taken: Counter[tuple[tuple[int, int], ...]] = Counter()
    for i in range(passes):
        alive = np.flatnonzero(left > 0)
        if not len(alive):
            break
        columns, low = fractional(lengths[alive], left[alive], capacity)
        bound = low if i == 0 else bound
        wanted: dict[tuple[tuple[int, int], ...], float] = {}
        for amount, config in columns:
            key = tuple(sorted((int(alive[k]), n) for k, n in config.items()))
            wanted[key] = wanted.get(key, 0.0) + amount
        for key, amount in wanted.items():
            times = min(int(amount + 1e-6), *(int(left[k] // n) for k, n in key))
            if times > 0:
                for k, n in key:
                    left[k] -= n * times
                taken[key] += times
    at = {int(v): k for k, v in enumerate(lengths)}
    for times, config in fill_rest({int(v): int(n) for v, n in zip(lengths, left, strict=True)}, capacity):
        taken[tuple(sorted((at[n], c) for n, c in config.items()))] += times

    used, slots, sequence = np.zeros(len(lengths), np.int64), [], 0
    for key, times in taken.items():
        offset = 0
        for k, copies in key:
            slots.append(Slot(int(lengths[k]), int(used[k]), times, copies, sequence, offset))
            used[k] += times * copies
            offset += int(lengths[k]) * copies
        sequence += times
    if any(used[k] != histogram[int(v)] for k, v in enumerate(lengths)):
        raise AssertionError("the plan must hold every item once")
    return slots, sequence, max(bound, sum(k * v for k, v in histogram.items()) / capacity)
