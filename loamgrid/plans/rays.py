"""Rays from a cell to every cell of a raster's perimeter, in closed form.

Rays are numbered in sweep order: top and bottom row in turn by column, then left and right column in turn by row.  The
error-term walk exchanges the two extents: with row extent ``|dc|`` and column extent ``|dr|``, step k moves k cells along the
longer one and round-half-down(k * short / long) along the other.  So a cell is met at one step whatever the ray, and the
rays through it are a range of perimeter cells on each side.
"""

from __future__ import annotations

import numpy as np

FAR = np.int64(1) << 40


def directions(ray: np.ndarray, r0, c0, width: int, height: int) -> tuple[np.ndarray, ...]:
    """Signs of the row and column moves, whether rows are the longer extent, and the long and the short extent."""
    side = ray - 2 * width
    dr = np.where(side < 0, (ray % 2) * (height - 1), 1 + side // 2) - r0
    dc = np.where(side < 0, ray // 2, (side % 2) * (width - 1)) - c0
    rows, cols = np.abs(dc), np.abs(dr)
    return np.where(dr > 0, 1, -1), np.where(dc > 0, 1, -1), rows >= cols, np.maximum(rows, cols), np.minimum(rows, cols)


def offsets(k: np.ndarray, way: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column offset after ``k`` steps."""
    sr, sc, by_row, long, short = way
    minor = (2 * short * k + long - 1) // (2 * long)
    return sr * np.where(by_row, k, minor), sc * np.where(by_row, minor, k)


def _through(fixed: int, k: np.ndarray, m: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest extent that, beside the extent ``fixed``, puts step ``k`` at ``m`` cells across; ``more``
    if it is the longer of the two."""
    if more:
        most = np.where(m > 0, (2 * fixed * k - 1) // np.maximum(2 * m - 1, 1), FAR)
        return (2 * fixed * k - 1) // (2 * m + 1) + 1, most
    return -(-(fixed * (2 * m - 1) + 1) // np.maximum(2 * k, 1)), fixed * (2 * m + 1) // np.maximum(2 * k, 1)


def last_rays(y: np.ndarray, x: np.ndarray, r0: int, c0: int, width: int, height: int) -> np.ndarray:
    """The last ray through the cells at the offsets ``y, x``; -1 where there is none."""
    ay, ax = np.abs(y), np.abs(x)
    best = np.full(len(y), -1, np.int64)

    def side(fixed: int, along: np.ndarray, across: np.ndarray, more_k, more_m, less_k, less_m, tie: int, at: int, first: int, last: int, number) -> None:
        """``fixed`` is the signed distance of the side; ``along`` the offset on that axis, ``across`` on the other, where
        the perimeter cells are ``first..last`` around ``at``."""
        sign = 1 if fixed > 0 else -1
        fits = (along == 0) | (np.sign(along) == sign)
        f = abs(fixed)
        for more, k, m in ((True, more_k, more_m), (False, less_k, less_m)):
            lo, hi = _through(f, k, m, more)
            lo, hi = (np.maximum(lo, max(f + tie, 1)), hi) if more else (lo, np.minimum(hi, f - 1 + tie))
            for way in (1, -1):
                a, b = (max(1, first - at), last - at) if way > 0 else (max(0, at - last), at - first)
                low, high = np.maximum(lo, a), np.minimum(hi, b)
                ok = fits & (k > 0) & (low <= high) & ((across == 0) | (np.sign(across) == way))
                place = at + (high if way > 0 else -low)
                best[ok] = np.maximum(best[ok], number(place[ok]))

    for row, odd in ((0, 0), (height - 1, 1)):
        side(row - r0, y, x, ay, ax, ax, ay, 0, c0, 0, width - 1, lambda c, odd=odd: 2 * c + odd)
    if height > 2:
        for col, odd in ((0, 0), (width - 1, 1)):
            side(col - c0, x, y, ax, ay, ay, ax, 1, r0, 1, height - 2, lambda r, odd=odd: 2 * width + 2 * (r - 1) + odd)
    return best


def segments(ray: np.ndarray, steps: np.ndarray, r0: int, c0: int, width: int, height: int, reach: float, tile: int) -> tuple[np.ndarray, ...]:
    """Where rays cross tiles: ``ray, tr, tc, first step, last step``, as far as ``steps``, the raster and the reach go."""
    way = directions(ray, r0, c0, width, height)
    n = np.repeat(np.arange(len(ray)), steps)
    k = np.arange(len(n)) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    y, x = offsets(k, tuple(w[n] for w in way))
    r, c = r0 + y, c0 + x
    ok = (r >= 0) & (r < height) & (c >= 0) & (c < width) & (y * y + x * x <= reach * reach)
    n, k, tr, tc = n[ok], k[ok], r[ok] // tile, c[ok] // tile
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(n))[: len(at)] - 1
    return ray[n[at]], tr[at], tc[at], k[at], k[end]
