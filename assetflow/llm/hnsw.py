"""Hierarchical navigable small-world graphs of unit vectors, built and searched many vectors at once."""

from __future__ import annotations

import io

import numpy as np

DEGREE = 16
BATCH = 256


class Hnsw:
    """Nodes in order of falling level; ``layers[l]`` holds the neighbours of the first ``sizes[l]`` nodes."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = 48, seed: int = 7):
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum(-np.log(1 - rng.random(n)) / np.log(degree), 8).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(vectors[self.order], np.float32)
        self.degree = degree
        level = level[self.order]
        self.layers: list[np.ndarray] = []
        for lv in range(int(level[0]) if n else -1, -1, -1):
            size = int((level >= lv).sum())
            self._build(size, degree * (2 if lv == 0 else 1), beam)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, x=self.x, **{f"layer{k}": a for k, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Hnsw:
        held, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.order, self.x = held["order"], held["x"]
        self.layers = [held[f"layer{k}"] for k in range(len(held.files) - 2)]
        return self

    def _build(self, size: int, width: int, beam: int) -> None:
        """Add the layer of the first ``size`` nodes below the ones there are."""
        links = np.full((size, width), -1, np.int32)
        above = len(self.layers[-1]) if self.layers else 0
        done = 0
        while done < size:
            batch = np.arange(done, min(size, done + min(BATCH, max(32, done // 2))))
            q = self.x[batch]
            if done <= 2 * beam:
                ids = np.broadcast_to(np.arange(done, dtype=np.int32), (len(batch), done))
                sims = q @ self.x[:done].T
            else:
                entry = self._descend(q) if above else np.zeros((len(batch), 1), np.int32)
                ids, sims = search_layer(self.x[:done], links[:done], q, np.where(entry < done, entry, 0), beam)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            peers = min(len(batch) - 1, self.degree)
            if peers > 0:
                near = np.argpartition(-own, peers - 1, axis=1)[:, :peers]
                ids = np.concatenate([ids, batch[near].astype(np.int32)], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, near, axis=1)], axis=1)
            if ids.shape[1]:
                chosen = self._spread(ids, sims, min(self.degree, width))
                links[batch, : chosen.shape[1]] = chosen
                self._answer(links, batch, chosen)
            done = int(batch[-1]) + 1
        self.layers.append(links)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates up to ``keep``, nearest first, those nearer to the node than to one chosen before; then the rest."""
        width = min(ids.shape[1], 3 * keep)
        at = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, at, axis=1), np.take_along_axis(sims, at, axis=1)
        real = (ids >= 0) & np.isfinite(sims)
        v = self.x[np.where(real, ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for c in range(width):
            blocked = (chosen[:, :c] & (between[:, c, :c] >= sims[:, c, None])).any(axis=1) if c else np.zeros(len(ids), bool)
            chosen[:, c] = real[:, c] & ~blocked & (chosen.sum(axis=1) < keep)
        rank = np.where(chosen, 0, np.where(real, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :keep]
        return np.where(np.take_along_axis(real, best, axis=1), np.take_along_axis(ids, best, axis=1), -1)

    def _answer(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Add the links back to the batch, and thin out the lists that overflow."""
        row, col = np.nonzero(chosen >= 0)
        to, back = chosen[row, col], batch[row].astype(np.int32)
        known = (links[to] == back[:, None]).any(axis=1)
        to, back = to[~known], back[~known]
        if not len(to):
            return
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[to], self.x[back]), to))
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        width = links.shape[1]
        keep = place < width
        more = np.full((len(nodes), min(width, int(count.max()))), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), count)[keep], place[keep]] = back[keep]
        both = np.concatenate([links[nodes], more], axis=1)
        sims = np.einsum("ijk,ik->ij", self.x[np.where(both >= 0, both, 0)], self.x[nodes])
        sims[both < 0] = -np.inf
        full = (both >= 0).sum(axis=1) > width
        room = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
        links[nodes[~full]] = np.take_along_axis(both, room, axis=1)[~full]
        if full.any():
            links[nodes[full]] = self._spread(both[full], sims[full], width)

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """Entry nodes from all layers there are, coarse to fine."""
        entry = np.zeros((len(q), 1), np.int32)
        for links in self.layers:
            entry = search_layer(self.x[: len(links)], links, q, entry, 8)[0][:, :4]
            entry = np.where(entry >= 0, entry, entry[:, :1])
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given at building, -1: none) and similarities of about the ``beam`` nearest."""
        ids, sims = [], []
        for first in range(0, len(q), BATCH):
            part = q[first : first + BATCH]
            entry = np.zeros((len(part), 1), np.int32)
            for links in self.layers[:-1]:
                entry = search_layer(self.x[: len(links)], links, part, entry, 8)[0][:, :4]
                entry = np.where(entry >= 0, entry, entry[:, :1])
            found, near = search_layer(self.x, self.layers[-1], part, entry, beam)
            ids.append(np.where(found >= 0, self.order[found], -1))
            sims.append(near)
        return np.concatenate(ids), np.concatenate(sims)


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of q at once: ids (-1: none) and similarities, best first."""
    rows = len(q)
    beam = min(beam, len(x))
    ids = np.full((rows, beam), -1, np.int32)
    sims = np.full((rows, beam), -np.inf, np.float32)
    fresh = np.zeros((rows, beam), bool)
    seen = np.zeros((rows, len(x)), bool)

    def take(at: np.ndarray, new: np.ndarray) -> None:
        usable = (new >= 0) & ~seen[at[:, None], np.where(new >= 0, new, 0)]
        r, c = np.nonzero(usable)
        node = new[r, c]
        seen[at[r], node] = True
        value = np.full(new.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("ij,ij->i", x[node], q[at[r]])
        all_ids = np.concatenate([ids[at], np.where(usable, new, -1)], axis=1)
        all_sims = np.concatenate([sims[at], value], axis=1)
        all_fresh = np.concatenate([fresh[at], usable], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[at], sims[at], fresh[at] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_sims, all_fresh))

    everything = np.arange(rows)
    for col in range(entry.shape[1]):
        take(everything, entry[:, col : col + 1])
    active = everything
    while len(active):
        value = np.where(fresh[active], sims[active], -np.inf)
        pick = value.argmax(axis=1)
        going = np.isfinite(value[np.arange(len(active)), pick])
        active, pick = active[going], pick[going]
        if not len(active):
            break
        fresh[active, pick] = False
        take(active, links[ids[active, pick]])
    best = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
