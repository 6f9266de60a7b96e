"""Sums of costs from many sources over a long, narrow graph, by a sweep over its layers instead of a search a source.

Nodes in their order are cut into layers as wide as the farthest arc reaches, so arcs join a
layer with itself and its neighbours. What a source's costs to a layer are, less the least of
them, decides all beyond; sources that agree there go on as one state. Costs are whole numbers,
so states are compared and sums made without rounding.
"""

from __future__ import annotations

import numpy as np

INF = float("inf")
#: Widest layers, fewest sources and most states (each takes about 32 bytes) of a sweep; sources of a task.
MOST_WIDE, FEW, MOST_STATES, PART = 96, 1_000, 15_000_000, 6_000


def _closed(m: np.ndarray) -> np.ndarray:
    """Costs of the cheapest ways, from costs of steps."""
    np.fill_diagonal(m, 0.0)
    for b in range(len(m)):
        np.minimum(m, m[:, b : b + 1] + m[b], out=m)
    return m


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of a[i, j] + b[j, k] over j."""
    return np.concatenate([(a[i : i + 128, :, None] + b).min(1) for i in range(0, len(a), 128)]) if len(a) else a


class _Steps:
    """Arcs of one kind (x to y, within layers), a slice a layer: least costs of what comes before or after one of them."""

    def __init__(self, layer, x, y, w, layers: int, wide: int):
        order = np.lexsort((-w, y, x, layer))
        self.x, self.y, self.w, self.wide = x[order], y[order], w[order], wide
        self.start = np.searchsorted(layer[order], np.arange(layers + 1))

    def matrix(self, k: int) -> np.ndarray:
        s, out = slice(self.start[k], self.start[k + 1]), np.full((self.wide, self.wide), INF)
        out[self.x[s], self.y[s]] = self.w[s]  # the least of parallel ones comes last
        return out

    def before(self, k: int, m: np.ndarray) -> np.ndarray:
        """A step, then m."""
        s, out = slice(self.start[k], self.start[k + 1]), np.full((self.wide, m.shape[1]), INF)
        x = self.x[s]
        if len(x):
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            out[x[first]] = np.minimum.reduceat(m[self.y[s]] + self.w[s][:, None], first, axis=0)
        return out

    def after(self, k: int, m: np.ndarray) -> np.ndarray:
        """m, then a step."""
        s, out = slice(self.start[k], self.start[k + 1]), np.full((len(m), self.wide), INF)
        order = np.argsort(self.y[s], kind="stable")
        y = self.y[s][order]
        if len(y) and len(m):
            first = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
            out[:, y[first]] = np.minimum.reduceat(m[:, self.x[s][order]] + self.w[s][order], first, axis=1)
        return out


def _states(rows: np.ndarray):
    """(distinct rows, the place of each row among them)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    rows = np.ascontiguousarray(rows)
    _, first, back = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    return rows[first], back.ravel()


def reach(g, sources, backwards: bool, mirrored: bool, most_states: int = MOST_STATES):
    """(source, nodes, total, farthest) arrays over the nodes of a source's own and all later layers; mirrored: of earlier ones only.

    None where a sweep doesn't pay or isn't exact: wide layers, costs that aren't whole numbers
    above 0 or too large, or sources that don't go on alike.
    """
    tail, head, cost, n = np.array(g.tail, np.int64), np.array(g.head, np.int64), np.array(g.cost), g.n
    sources = np.unique(np.asarray(sources, np.int64))
    if not len(sources):
        return sources, sources, np.zeros(0), np.zeros(0)
    if not len(cost) or cost.min() <= 0 or (cost != np.floor(cost)).any() or n * cost.sum() > 2.0**53:
        return None
    wide = int(np.abs(tail - head).max())
    if not 0 < wide <= MOST_WIDE:
        return None
    if backwards:
        tail, head = head, tail
    if mirrored:
        tail, head, sources = n - 1 - tail, n - 1 - head, n - 1 - sources[::-1]
    layers = -(-n // wide)
    of, to = tail // wide, head // wide
    kind = lambda d: _Steps(np.minimum(of, to)[to - of == d], (tail % wide)[to - of == d], (head % wide)[to - of == d], cost[to - of == d], layers, wide)
    same, down, up = kind(0), kind(1), kind(-1)  # down and up: between a layer and the next
    # costs within a layer by ways that lead through it and later ones
    begin, end = int(sources[0]) // wide, int(sources[-1]) // wide
    later = np.empty((layers - begin, wide, wide))
    for k in range(layers - 1, begin - 1, -1):
        m = same.matrix(k)
        later[k - begin] = _closed(m if k == layers - 1 else np.minimum(m, up.after(k, down.before(k, later[k + 1 - begin]))))
    at = np.searchsorted(sources, np.arange(layers + 1) * wide)
    held, local, steps, begun, earlier, n_states = np.zeros((0, wide)), [], [], [], None, 0
    for k in range(layers):
        if k <= end:
            m = same.matrix(k)
            earlier = _closed(m if k == 0 else np.minimum(m, down.after(k - 1, up.before(k - 1, earlier))))
        if k < begin:
            continue
        rows = [_times(down.after(k - 1, held), later[k - begin])] if len(held) else [held]
        if at[k] < at[k + 1]:
            rows.append(_closed(np.minimum(earlier, later[k - begin]))[sources[at[k] : at[k + 1]] - k * wide])
        rows, old = np.concatenate(rows), len(held)
        least = rows.min(1) if len(rows) else np.zeros(0)
        live, place = np.isfinite(least), np.full(len(rows), -1)
        held, place[live] = _states(rows[live] - least[live, None])
        steps.append((place[:old].astype(np.int32), least[:old]))
        begun.append(place[old:])
        there = np.isfinite(held)
        some = np.where(there, held, 0.0)
        local.append((there.sum(1).astype(np.int32), some.sum(1), some.max(1) if len(some) else np.zeros(0)))
        n_states += len(held)
        if n_states > most_states:
            return None
    out, after = [], None
    for k in range(layers - 1, begin - 1, -1):
        here = local[k - begin]
        if after is None:
            beyond = np.zeros(len(here[0]), np.int64), np.zeros(len(here[0])), np.zeros(len(here[0]))
        else:
            place, least = steps[k + 1 - begin]
            gone, least = place < 0, np.where(place < 0, 0.0, least)
            count, total, most = (np.where(gone, 0, x[place]) if len(x) else np.zeros(len(place), x.dtype) for x in after)
            beyond = count, total + least * count, np.where(gone, 0.0, most + least)
        after = here[0] + beyond[0], here[1] + beyond[1], np.maximum(here[2], beyond[2])
        if len(begun[k - begin]):
            found = [x[begun[k - begin]] for x in (beyond if mirrored else after)]
            s = sources[at[k] : at[k + 1]]
            out.append((n - 1 - s if mirrored else s, *found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
