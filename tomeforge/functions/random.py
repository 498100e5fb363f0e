"""The seeded 64-bit stream that plans and bootstraps are drawn from."""

from __future__ import annotations

MASK = (1 << 64) - 1


def splitmix64(state: int) -> int:
    """One step of the public splitmix64 generator."""
    z = (state + 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return z ^ (z >> 31)


def mixed(seed: int, *parts: int) -> int:
    """A seed mixed with coordinates, each counted from 1."""
    state = splitmix64(seed)
    for p in parts:
        state = splitmix64((state + p + 1) & MASK)
    return state


def shuffled(n: int, seed: int) -> list[int]:
    """0 to n - 1 in an order drawn from the back."""
    order, state = list(range(n)), seed
    for i in reversed(range(1, n)):
        state = splitmix64(state)
        j = state % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order
