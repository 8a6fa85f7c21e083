"""Table counts in Pitman-Yor restaurants, drawn by Gibbs steps from their full conditionals.

A restaurant keeps, for each dish, its customers c and its tables t. A step takes all customers of a dish away and seats
them again given everybody else: t tables have the weight ``S(c, t) * prod(a + d j, j < t) * p**t``, where S are generalised
Stirling numbers, a is the strength plus the discount times the other dishes' tables, and p is the parent's probability.
Up to ``EXACT`` customers this is drawn exactly; beyond, by the saddle point of S. Noise comes from hashes of the dishes, so
draws don't depend on how dishes are dealt to tasks.
"""

from __future__ import annotations

import functools

import numpy as np

from .text import mix

DISCOUNT, STRENGTH = 0.75, 1.0
BURN_IN, KEPT = 3, 4
EXACT = 64
#: Cells of weights that are held at a time.
CELLS = 1 << 18


@functools.cache
def stirling(most: int) -> np.ndarray:
    """log S(c, t) for c and t up to most; S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(most):
            t = np.arange(1, c + 2)
            room = np.log(np.maximum(c - t * DISCOUNT, 0.0))
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], room + out[c, t])
    return out


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of dishes."""
    return ((mix(key + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def many(c: np.ndarray, a: np.ndarray, lp: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables of dishes with many customers: one, and others with the saddle point's mean and variance."""
    p = np.exp(lp)
    low, high = np.full(len(c), -600.0), np.zeros(len(c))
    for _ in range(60):  # the saddle: c = a p (1 - y) y**(d - 1) / (1 - p (1 - y**d))
        mid = (low + high) / 2
        y = np.exp(mid)
        over = np.log(a) + lp + np.log1p(-y) + (DISCOUNT - 1) * mid - np.log1p(-p * (1 - y**DISCOUNT)) > np.log(c)
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    y = np.exp((low + high) / 2)
    share = (1 - y**DISCOUNT) / DISCOUNT
    mean = a * p * share / (1 - DISCOUNT * p * share)
    bend = -1 / np.maximum(1 - y, 1e-12) + (DISCOUNT - 1) / y + y ** (DISCOUNT - 1) / np.maximum(share, 1e-12)
    curve = y ** (DISCOUNT - 1) / np.maximum(share, 1e-12) / (np.maximum(mean, 1e-300) * bend) - 1 / np.maximum(mean, 1e-300) + DISCOUNT / np.maximum(a + DISCOUNT * mean, 1e-300)
    more = np.minimum(mean, c - 1) * (c - 1) / c
    # few: by the binomial's distribution function; many: normally
    out = np.zeros(len(c))
    few = more < 30
    n, q = (c - 1)[few], np.clip(more[few] / (c - 1)[few], 0, 1 - 1e-9)
    term = np.exp(n * np.log1p(-q))
    total, k, left = term.copy(), np.zeros(len(n)), np.arange(len(n))
    while len(left):
        left = left[(u[few][left] > total[left]) & (k[left] < np.minimum(n[left], 200))]
        term[left] *= (n[left] - k[left]) / (k[left] + 1) * (q[left] / (1 - q[left]))
        k[left] += 1
        total[left] += term[left]
    out[few] = k
    wide = np.sqrt(-1 / np.minimum(curve, -1e-300))
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    out[~few] = np.round(more + np.minimum(wide, np.sqrt(more + 1)) * normal)[~few]
    return 1 + np.clip(out, 0, c - 1)


def draw(c: np.ndarray, a: np.ndarray, lp: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of dishes with c customers; lp is the natural logarithm of the parent's probability."""
    t = np.minimum(c, 1).astype(np.float64)
    u = uniform(key, salt)
    order = np.argsort(c, kind="stable")
    sizes = c[order]
    table = stirling(EXACT)
    for size in range(2, EXACT + 1):
        x, y = np.searchsorted(sizes, size), np.searchsorted(sizes, size, "right")
        step = max(1, CELLS // size)
        for at in range(x, y, step):
            own = order[at : min(y, at + step)]
            weight = np.cumsum(np.log(a[own][:, None] + DISCOUNT * np.arange(size)) + lp[own][:, None], 1) + table[size, 1 : size + 1]
            weight = np.exp(weight - weight.max(1, keepdims=True))
            total = np.cumsum(weight, 1)
            t[own] = np.minimum(size, 1 + (total < u[own][:, None] * total[:, -1:]).sum(1))
    own = order[np.searchsorted(sizes, EXACT, "right") :]
    if len(own):
        t[own] = many(c[own].astype(np.float64), a[own], lp[own], u[own], uniform(key[own], salt + 7919))
    return t


def sweep(room: np.ndarray, rooms: int, c: np.ndarray, t: np.ndarray, lp: np.ndarray, key: np.ndarray, salt: int, share: np.ndarray | float = 1.0) -> None:
    """One Gibbs sweep over restaurants' dishes, in place: half of the dishes at a time, given all others' tables.

    share is how many times the tables that are here a restaurant has.
    """
    seated = np.flatnonzero(c > 1)
    half = (mix(key[seated]) & np.uint64(1)).astype(bool)
    for k, own in enumerate((seated[half], seated[~half])):
        if len(own):
            total = np.bincount(room, t, rooms) * share
            a = STRENGTH + DISCOUNT * np.maximum(total[room[own]] - t[own], 0)
            t[own] = draw(c[own], a, lp[own], key[own], 2 * salt + k)
