"""Hierarchical navigable small-world graphs in numpy, built and searched many points at a time."""

from __future__ import annotations

import numpy as np

LINKS = 16
SLACK = 16
BUILD_WIDTH = 64
BATCH = 1024
EXPAND = 4


class Graph:
    """A graph over unit vectors, nearest by inner product; ``links[level]`` is a flat array of neighbours, -1 where none.

    Points come in batches: a batch is searched in the graph so far and compared within itself, every
    point links to a diverse choice of what is nearest, and is linked back. A list that
    overflows is cut back to a diverse choice. Each level above holds about a 16th of the points.
    """

    def __init__(self, x: np.ndarray, levels: np.ndarray | None = None, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.entry = np.ascontiguousarray(x, dtype=np.float32), entry
        if links is not None:
            self.links = links
            return
        n = len(x)
        rng = np.random.default_rng(n)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 4) if levels is None else levels
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, (2 * LINKS if i == 0 else LINKS) + SLACK), -1, dtype=np.int32) for i in range(top + 1)]
        start, size = 0, 256
        while start < n:
            self._insert(np.arange(start, min(start + size, n)), start)
            start += size
            size = min(BATCH, max(size, start // 2))

    def _insert(self, new: np.ndarray, done: int) -> None:
        q = self.x[new]
        near = q @ q.T
        at = np.full(len(new), self.entry)
        top = int(self.level[self.entry]) if done else -1
        for level in range(len(self.links) - 1, -1, -1):
            of = np.flatnonzero(self.level[new] >= level)
            ids = sims = None
            if level <= top:
                ids, sims = self._beam(level, q, at, BUILD_WIDTH if level == 0 else 16)
                at = ids[:, 0]
            if not len(of):
                continue
            own = near[np.ix_(of, of)].copy()
            np.fill_diagonal(own, -np.inf)
            most = min(BUILD_WIDTH if ids is None else LINKS, len(of))
            best = np.argpartition(-own, most - 1, axis=1)[:, :most]
            more_sims = np.take_along_axis(own, best, axis=1)
            more = np.where(np.isfinite(more_sims), new[of][best], -1)
            if ids is not None:
                more, more_sims = np.concatenate([ids[of], more], axis=1), np.concatenate([sims[of], more_sims], axis=1)
            width = self.links[level].shape[1] - SLACK
            chosen = self._diverse(more, more_sims, min(width, LINKS))
            self.links[level][new[of], : chosen.shape[1]] = chosen
            self._link_back(level, new[of], chosen, width)
        best = new[self.level[new].argmax()]
        if not done or self.level[best] > self.level[self.entry]:
            self.entry = int(best)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest ones that are nearer to the row than to any chosen before; then the nearest others."""
        width = min(BUILD_WIDTH, ids.shape[1])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = np.full((len(ids), most), -1, dtype=np.int32)
        for start in range(0, len(ids), BATCH):
            part, sim = ids[start : start + BATCH], sims[start : start + BATCH]
            v = self.x[part]
            between = v @ v.transpose(0, 2, 1)
            chosen = np.zeros(part.shape, dtype=bool)
            for j in range(part.shape[1]):
                chosen[:, j] = (part[:, j] >= 0) & ~((between[:, j] > sim[:, j, None]) & chosen).any(axis=1)
            rank = np.where(chosen, 0, np.where(part >= 0, 1, 2)) * width + np.arange(part.shape[1])
            first = np.argsort(rank, axis=1)[:, :most]
            got = np.take_along_axis(part, first, axis=1)
            out[start : start + BATCH, : got.shape[1]] = got
        return out

    def _link_back(self, level: int, new: np.ndarray, chosen: np.ndarray, width: int) -> None:
        links = self.links[level]
        to, source = chosen.ravel(), np.repeat(new, chosen.shape[1])
        order = np.argsort(to[to >= 0], kind="stable")
        to, source = to[to >= 0][order], source[to >= 0][order]
        nodes, first, adds = np.unique(to, return_index=True, return_counts=True)
        had = (links[nodes] >= 0).sum(axis=1)
        fits = had + adds <= links.shape[1]
        rank = np.arange(len(to)) - np.repeat(first, adds)
        ok = np.repeat(fits, adds)
        links[to[ok], (np.repeat(had, adds) + rank)[ok]] = source[ok]
        full = np.flatnonzero(~fits)
        for start in range(0, len(full), 256):
            part = full[start : start + 256]
            more = np.full((len(part), adds[part].max()), -1, dtype=np.int64)
            for row, i in enumerate(part):
                more[row, : adds[i]] = source[first[i] : first[i] + adds[i]]
            ids = np.concatenate([links[nodes[part]], more], axis=1)
            sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", self.x[nodes[part]], self.x[ids]), -np.inf)
            links[nodes[part]] = -1
            links[nodes[part], :width] = self._diverse(ids, sims, width)

    def _beam(self, level: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found for each query, nearest first; -1 where fewer."""
        n, links = len(q), self.links[level]
        ids = np.full((n, width), -1, dtype=np.int64)
        sims = np.full((n, width), -np.inf, dtype=np.float32)
        open_ = np.zeros((n, width), dtype=bool)
        seen = np.zeros((n, len(self.x)), dtype=bool)
        stamp = np.zeros((n, len(self.x)), dtype=np.int16)
        rows = np.arange(n)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("nd,nd->n", q, self.x[entry]), True
        seen[rows, entry] = True
        step = min(EXPAND, width)
        while len(rows):
            mine = rows[:, None]
            ahead = np.where(open_[rows], sims[rows], -np.inf)
            pick = np.argpartition(-ahead, step - 1, axis=1)[:, :step]
            valid = np.take_along_axis(ahead, pick, axis=1) > -np.inf
            open_[mine, pick] = False
            found = np.where(valid[:, :, None], links[ids[mine, pick]], -1).reshape(len(rows), -1)
            r, c = np.nonzero((found >= 0) & ~seen[mine, found])
            at = found[r, c]
            stamp[rows[r], at] = c
            first = stamp[rows[r], at] == c
            r, c, at = r[first], c[first], at[first]
            seen[rows[r], at] = True
            got = np.full(found.shape, -np.inf, dtype=np.float32)
            got[r, c] = np.einsum("nd,nd->n", q[rows[r]], self.x[at])
            all_sims = np.concatenate([sims[rows], got], axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[rows] = np.take_along_axis(all_sims, keep, axis=1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], got > -np.inf], axis=1), keep, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(got > -np.inf, found, -1)], axis=1), keep, axis=1)
            rows = rows[open_[rows].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Ids of the ``width`` nearest found for each query, nearest first; -1 where fewer."""
        out = np.full((len(q), width), -1, dtype=np.int64)
        for start in range(0, len(q), 256):
            part = np.ascontiguousarray(q[start : start + 256], dtype=np.float32)
            at = np.full(len(part), self.entry)
            for level in range(len(self.links) - 1, 0, -1):
                at = self._beam(level, part, at, 8)[0][:, 0]
            out[start : start + 256] = self._beam(0, part, at, width)[0]
        return out
