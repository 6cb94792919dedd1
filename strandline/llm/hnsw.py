"""A hierarchical navigable small-world graph over unit vectors, built and searched in numpy for many points at once."""

from __future__ import annotations

import numpy as np

WIDTH, BUILD_BEAM, TOP, BATCH = 16, 64, 128, 256


def levels(n: int, seed: int) -> np.ndarray:
    """How many points each layer has, the ground layer first; a layer keeps one point in WIDTH of the layer below."""
    u = np.random.default_rng(seed).random(n)
    height = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(WIDTH)).astype(int)
    sizes = [int((height >= h).sum()) for h in range(int(height.max(initial=0)) + 1)]
    return np.array([sizes[0], *(s for s in sizes[1:] if s)])


class Graph:
    """Rows of ``x`` (float32, unit length) are points; layer h holds the first ``sizes[h]`` of them.

    Rows must come in random order: which points stand in upper layers is then random too.
    """

    def __init__(self, x: np.ndarray, sizes: np.ndarray, near: list):
        self.x, self.sizes, self.near = x, sizes, near

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> Graph:
        sizes = levels(len(x), seed)
        while len(sizes) > 1 and sizes[-2] <= TOP:  # the top layer is searched outright
            sizes = sizes[:-1]
        g = cls(x, sizes, [None] * len(sizes))
        for h in range(len(sizes) - 1, -1, -1):
            g._layer(h)
        return g

    def _layer(self, h: int) -> None:
        width, n, x = WIDTH * (1 if h else 2), int(self.sizes[h]), self.x
        near = np.full((n, width), -1, np.int32)
        self.near[h] = near
        done = min(n, TOP)
        first = x[:done] @ x[:done].T
        np.fill_diagonal(first, -2)
        order = np.argsort(-first, 1, kind="stable")[:, :BUILD_BEAM].astype(np.int32)
        near[:done] = self._choose(order, np.take_along_axis(first, order, 1), width)
        while done < n:
            size = min(BATCH, done, n - done)
            new = np.arange(done, done + size, dtype=np.int32)
            ids, sims = self._beam(x[new], BUILD_BEAM, self._entries(x[new], h + 1, done), near)
            own = x[new] @ x[new].T
            own[np.triu_indices(size)] = -2  # those that came before in this batch
            both = np.concatenate([ids, np.broadcast_to(new, (size, size))], 1)
            score = np.concatenate([sims, own], 1)
            top = np.argsort(-score, 1, kind="stable")[:, :BUILD_BEAM]
            score = np.take_along_axis(score, top, 1)
            ids = np.where(score > -2, np.take_along_axis(both, top, 1), -1)
            near[new] = self._choose(ids, score, width)
            self._link_back(near, new, width)
            done += size

    def _entries(self, q: np.ndarray, h: int, done: int) -> np.ndarray:
        """Where to start in the layer below ``h``: [Q, E] points."""
        if h >= len(self.sizes):
            n = min(TOP, done)
            return np.argsort(-(q @ self.x[:n].T), 1, kind="stable")[:, :4].astype(np.int32)
        at = np.argsort(-(q @ self.x[: min(TOP, self.sizes[-1])].T), 1, kind="stable")[:, :4].astype(np.int32)
        for k in range(len(self.sizes) - 1, h - 1, -1):
            at = self._beam(q, 12, at, self.near[k])[0][:, :6]
        return at

    def _beam(self, q: np.ndarray, beam: int, start: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best points met from ``start``, best first; -1 and -2 fill up."""
        rows, x = np.arange(len(q))[:, None], self.x
        seen = np.zeros((len(q), len(near)), np.int16)
        start = np.where((start >= 0), start, 0)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -2, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        new = start
        while True:
            place = np.arange(1, new.shape[1] + 1, dtype=np.int16)
            fresh = (new >= 0) & (seen[rows, new] == 0)
            seen[rows, np.where(fresh, new, 0)] = np.where(fresh, place, seen[:, :1])
            fresh &= seen[rows, new] == place  # of a point met twice now, one counts
            got = np.where(fresh, np.matmul(x[new], q[:, :, None])[:, :, 0], -2)
            all_s = np.concatenate([sims, got], 1)
            all_i = np.concatenate([ids, np.where(fresh, new, -1)], 1)
            all_o = np.concatenate([open_, fresh], 1)
            top = np.argsort(-all_s, 1, kind="stable")[:, :beam]
            sims, ids, open_ = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_o))
            if not open_.any():
                return ids, sims
            take = np.argsort(~open_, 1, kind="stable")[:, :4]
            live = np.take_along_axis(open_, take, 1)
            np.put_along_axis(open_, take, False, 1)
            points = np.where(live, np.take_along_axis(ids, take, 1), -1)
            new = np.where(points[:, :, None] >= 0, near[points], -1).reshape(len(q), -1)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates, best first: those nearer to the point than to any chosen before, then the best of the rest."""
        out = np.full((len(ids), width), -1, np.int32)
        for k in range(0, len(ids), 128):
            i, s = ids[k : k + 128], sims[k : k + 128]
            c = self.x[i]
            between = np.matmul(c, c.transpose(0, 2, 1))
            ok = (i >= 0) & (s > -2)
            taken, most, count = np.zeros(i.shape, bool), np.full(i.shape, -2, np.float32), np.zeros(len(i), int)
            for j in range(i.shape[1]):
                pick = ok[:, j] & (count < width) & (most[:, j] <= s[:, j])
                taken[:, j] = pick
                count += pick
                most = np.where(pick[:, None], np.maximum(most, between[:, :, j]), most)
            order = np.argsort(np.where(taken, 0, np.where(ok, 1, 2)), 1, kind="stable")[:, :width]
            chosen = np.where(np.take_along_axis(ok, order, 1), np.take_along_axis(i, order, 1), -1)
            out[k : k + 128, : chosen.shape[1]] = chosen
        return out

    def _link_back(self, near: np.ndarray, new: np.ndarray, width: int) -> None:
        to, source = near[new].ravel(), np.repeat(new, near.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        point, first, n = np.unique(to, return_index=True, return_counts=True)
        cand = np.full((len(point), width + n.max(initial=0)), -1, np.int32)
        cand[:, :width] = near[point]
        cand[np.repeat(np.arange(len(point)), n), width + np.arange(len(to)) - np.repeat(first, n)] = source
        full = (cand >= 0).sum(1) > width
        order = np.argsort(cand < 0, 1, kind="stable")[:, :width]
        near[point[~full]] = np.take_along_axis(cand[~full], order[~full], 1)
        p, c = point[full], cand[full]
        s = np.where(c >= 0, np.matmul(self.x[c], self.x[p][:, :, None])[:, :, 0], -2)
        order = np.argsort(-s, 1, kind="stable")
        near[p] = self._choose(np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1), width)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best points for each query row, best first."""
        ids, sims = [], []
        for k in range(0, len(q), BATCH):
            part = q[k : k + BATCH]
            i, s = self._beam(part, beam, self._entries(part, 1, len(self.x)), self.near[0])
            ids.append(i), sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def audited_beam(self, least: float, q: np.ndarray, beam: int = BUILD_BEAM, recall: float = 1.0) -> tuple[int, float]:
        """Widen the beam until it finds ``recall`` of all links that brute force finds for the vectors ``q``; beyond all points it is brute force.

        A vector whose beam is full of links is found whole: whoever searches has to compare it with every point.
        """
        exact = q @ self.x.T >= least
        while True:
            beam = min(beam, len(self.x))
            ids, sims = self.search(q, beam)
            hit = np.zeros(exact.shape, bool)
            rows, cols = np.nonzero((ids >= 0) & (sims >= least))
            hit[rows, ids[rows, cols]] = True
            hit[sims[:, -1] >= least] = True
            due = exact.sum()
            got = (hit & exact).sum() / due if due else 1.0
            if got >= recall or beam >= len(self.x):
                return beam, float(got)
            beam *= 2
