"""Plain sequential versions of the iterative operators, used only as test oracles."""

import heapq
import math

import numpy as np

D8 = [(0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32), (-1, 0, 64), (-1, 1, 128)]


def inside(a, r, c):
    return 0 <= r < a.shape[0] and 0 <= c < a.shape[1] and not np.isnan(a[r, c])


def fill(z, s, csx, csy):
    """Dijkstra form of the least surface."""
    f = np.full(z.shape, np.inf)
    heap = []
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if np.isnan(z[r, c]):
                continue
            if any(not inside(z, r + dr, c + dc) for dr, dc, _ in D8):
                f[r, c] = z[r, c]
                heapq.heappush(heap, (f[r, c], r, c))
    step = (csx + csy) / 2 * s
    while heap:
        v, r, c = heapq.heappop(heap)
        if v > f[r, c]:
            continue
        for dr, dc, _ in D8:
            if inside(z, r + dr, c + dc):
                d = step * math.sqrt(2) if dr and dc else step
                n = max(z[r + dr, c + dc], v + d)
                if n < f[r + dr, c + dc]:
                    f[r + dr, c + dc] = n
                    heapq.heappush(heap, (n, r + dr, c + dc))
    return f


def flow(z, csx, csy):
    fd = np.zeros(z.shape, int)
    down = {}
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if np.isnan(z[r, c]):
                continue
            best, at = -math.inf, None
            for dr, dc, code in D8:
                if not inside(z, r + dr, c + dc):
                    s, to = math.inf, None
                else:
                    s, to = (z[r, c] - z[r + dr, c + dc]) / math.hypot(dc * csx, dr * csy), (r + dr, c + dc)
                if s > best:
                    best, at = s, (code, to)
            if best > 0:
                fd[r, c] = at[0]
                down[r, c] = at[1]
            else:
                down[r, c] = None
    return fd, down


def accum(down):
    acc = dict.fromkeys(down, 1)
    indeg = dict.fromkeys(down, 0)
    for u, v in down.items():
        if v is not None:
            indeg[v] += 1
    queue = [u for u in down if indeg[u] == 0]
    while queue:
        u = queue.pop()
        v = down[u]
        if v is not None:
            acc[v] += acc[u]
            indeg[v] -= 1
            if indeg[v] == 0:
                queue.append(v)
    return acc


def reaches(down, acc, thr):
    """Sequential reach walk in order of accumulation."""
    ch = {u for u in down if acc[u] >= thr}
    up = dict.fromkeys(ch, 0)
    for u in ch:
        if down[u] in ch:
            up[down[u]] += 1
    label = {}
    for i in sorted(ch, key=lambda u: (acc[u], u)):
        if i in label:
            continue
        cur = i
        while cur not in label:
            label[cur] = i
            n = down[cur]
            if n not in ch or n in label:
                break
            if up[n] >= 2:
                label[n] = i
                break
            cur = n
    return ch, up, label


def strahler(down, ch):
    order = {}

    def get(u):
        ups = sorted((get(v) for v in feeds.get(u, [])), reverse=True)
        if not ups:
            return 1
        return ups[0] + 1 if len(ups) > 1 and ups[0] == ups[1] else ups[0]

    feeds = {}
    for u in ch:
        if down[u] in ch:
            feeds.setdefault(down[u], []).append(u)
    import sys

    sys.setrecursionlimit(100000)
    for u in ch:
        order[u] = get(u)
    return order


def viewshed(z, r0, c0, eye, tgt, csx, csy, radius, curvature):
    h, w = z.shape
    out = np.zeros(z.shape, int)
    out[r0, c0] = 1
    reach = radius / ((csx + csy) / 2) if radius > 0 else math.inf

    def trace(r1, c1):
        if (r1, c1) == (r0, c0):
            return
        r, c = r0, c0
        dr, dc = abs(r1 - r0), abs(c1 - c0)
        sr, sc = (1 if r1 > r0 else -1), (1 if c1 > c0 else -1)
        err = dr - dc
        top = -math.inf
        while True:
            e2 = 2 * err
            if e2 > -dc:
                err -= dc
                c += sc
            if e2 < dr:
                err += dr
                r += sr
            if not (0 <= r < h and 0 <= c < w):
                return
            if (c - c0) ** 2 + (r - r0) ** 2 > reach * reach:
                return
            if not np.isnan(z[r, c]):
                d = math.hypot((c - c0) * csx, (r - r0) * csy) or 0.001
                k = d * d / (2 * 6371000.0) * 0.87 if curvature else 0.0
                out[r, c] = int((z[r, c] + tgt - k - eye) / d >= top)
                top = max(top, (z[r, c] - k - eye) / d)
            if (r, c) == (r1, c1):
                return

    for c in range(w):
        trace(0, c)
        trace(h - 1, c)
    for r in range(1, h - 1):
        trace(r, 0)
        trace(r, w - 1)
    return out


def lee(nu):
    if nu < -0.7:
        return 0.0
    if nu < 0:
        j = 0.5 - 0.62 * nu
    elif nu < 1:
        j = 0.5 * math.exp(-0.95 * nu)
    elif nu < 2.4:
        j = 0.4 - math.sqrt(max(0.0, 0.1184 - (0.38 - 0.1 * nu) ** 2))
    else:
        j = 0.225 / nu
    return -20 * math.log10(max(j, 1e-10))


def profile_loss(dist, elev, eye, tgt, wavelength):
    """Edge by edge, as Epstein and Peterson describe."""
    last = len(dist) - 1
    height = lambda i: eye if i == 0 else (elev[i] + tgt if i == last else elev[i])
    edges = [0, last]
    for _ in range(20):
        best, at = 0.0, None
        for a, b in zip(edges, edges[1:]):
            for j in range(a + 1, b):
                los = height(a) + (dist[j] - dist[a]) / (dist[b] - dist[a]) * (height(b) - height(a))
                if elev[j] - los > best:
                    best, at = elev[j] - los, j
        if at is None:
            break
        edges = sorted(edges + [at])
    total = 0.0
    for a, b, c in zip(edges, edges[1:], edges[2:]):
        d1, d2 = dist[b] - dist[a], dist[c] - dist[b]
        los = height(a) + d1 / (d1 + d2) * (height(c) - height(a))
        total += lee((elev[b] - los) * math.sqrt(2 * (d1 + d2) / (wavelength * d1 * d2)))
    return total


def summits(z, search, smooth, min_relief, cutoff, count):
    h, w = z.shape
    def box(a, r, c, k):
        return a[max(0, r - k) : r + k + 1, max(0, c - k) : c + k + 1]

    s = np.full(z.shape, np.nan)
    for r in range(h):
        for c in range(w):
            b = box(z, r, c, smooth)
            if (~np.isnan(b)).any():
                s[r, c] = np.nansum(b) / (~np.isnan(b)).sum() if smooth else z[r, c]
    rel = max(search * 3, search + 4)
    inner = max(1, int(rel * 0.35))
    cand = []
    for r in range(h):
        for c in range(w):
            if np.isnan(z[r, c]) or np.isnan(s[r, c]):
                continue
            b = box(s, r, c, search)
            if s[r, c] < np.nanmax(b) - 0.05 or not (np.nanmin(b) < s[r, c] - 0.05):
                continue
            vals = []
            for rr in range(max(0, r - rel), min(h, r + rel + 1)):
                for cc in range(max(0, c - rel), min(w, c + rel + 1)):
                    d2 = (rr - r) ** 2 + (cc - c) ** 2
                    if inner * inner < d2 <= rel * rel and s[rr, cc] < s[r, c]:
                        vals.append(s[rr, cc])
            vals.sort()
            relief = s[r, c] - vals[int(len(vals) * 0.25)] if vals else 0.0
            if relief >= min_relief:
                cand.append((-(relief * 1e5 + z[r, c]), r, c, relief))
    cand.sort()
    taken, out = [], []
    for sc, r, c, relief in cand:
        if len(out) >= count:
            break
        if any(abs(r - a) <= search and abs(c - b) <= search for a, b in taken):
            continue
        taken.append((r, c))
        out.append((r, c, "peak" if relief >= cutoff else "hill", relief))
    return out


def rings(z, stride=1 << 31):
    """Least corner edge -> (value, is_hole, corners from it on, the first repeated), walking each side of each cell."""
    def same(r, c, v):
        return 0 <= r < z.shape[0] and 0 <= c < z.shape[1] and z[r, c] == v

    # sides 0..3 walk E, S, W, N with the cell on the right; a side faces the cell to the left of the walk
    go = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    end = [(0, 1), (1, 1), (1, 0), (0, 0)]
    left = {(r, c, k) for r, c in np.ndindex(z.shape) for k in range(4) if not np.isnan(z[r, c]) and not same(r + go[k - 1][0], c + go[k - 1][1], z[r, c])}
    out = {}
    while left:
        at = start = min(left)
        walk = []
        while True:
            left.discard(at)
            r, c, k = at
            v, (dr, dc), (sr, sc) = z[r, c], go[k], go[k - 1]
            if not same(r + dr, c + dc, v):
                at, turns = (r, c, (k + 1) % 4), True
            elif not same(r + dr + sr, c + dc + sc, v):
                at, turns = (r + dr, c + dc, k), False
            else:
                at, turns = (r + dr + sr, c + dc + sc, (k + 3) % 4), True
            if turns:
                walk.append(((r * stride + c) * 4 + k, (c + end[k][1], r + end[k][0])))
            if at == start:
                break
        i = walk.index(min(walk))
        pts = [p for _, p in walk[i:] + walk[: i + 1]]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:]))
        out[min(walk)[0]] = (z[start[:2]], area < 0, pts)
    return out
