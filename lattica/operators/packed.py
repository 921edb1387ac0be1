"""The kernels of community over links kept as 32-bit numbers, for components whose tables of weights no task should hold.

Nodes are visited in the same order and by the same rules, so clusters are the
same; weights toward labels are counted at each visit instead of kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lattica.operators import community
from lattica.operators.community import PASSES, SWEEPS, Weighted

#: Links that are taken up at once, besides the graph itself; links of a row on the way to a task.
STEP, CHUNK = 1_000_000, 512
#: Labels for each link of a node up to which it looks at all there are.
FEW = 4
#: Links of a node from which on arrays take less time than tables; less than any gain.
LONG, LOW = 100, np.iinfo(np.int64).min


def chunks(u: np.ndarray, v: np.ndarray) -> pa.Array:
    """Links as binary rows of up to CHUNK pairs of 32-bit numbers."""
    data = np.column_stack([u, v]).astype(np.int32).reshape(-1)
    ends = np.append(np.arange(0, len(u), CHUNK), len(u)) * 8
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def pairs_of(rows: pa.Array) -> np.ndarray:
    """The pairs in binary rows, none of which is null."""
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32).reshape(-1, 2).copy()


@dataclass
class Packed:
    """A weighted undirected graph over 0..n-1: the ends of each node's links from start on, in order, their weights (None: all 1), and the weight inside each node."""

    start: np.ndarray
    target: np.ndarray
    weight: np.ndarray | None
    inside: np.ndarray

    @staticmethod
    def of(parts: list[np.ndarray], n: int) -> Packed:
        """Of pairs, maybe repeated, which are taken out of the list."""
        keys, at = np.empty(2 * sum(map(len, parts)), np.int64), 0
        while parts:
            u, v = parts.pop().astype(np.int64).T
            keys[at : at + len(u)] = u * n + v
            keys[at + len(u) : at + 2 * len(u)] = v * n + u
            at += 2 * len(u)
        keys.sort()
        kept, last = 0, -1
        for k in range(0, len(keys), STEP):
            some = keys[k : k + STEP]
            new = some[np.diff(some, prepend=last) != 0]
            last = some[-1]
            keys[kept : kept + len(new)] = new
            kept += len(new)
        start = np.searchsorted(keys[:kept], np.arange(n + 1) * n)
        # In place: a target takes half of the room that its key took.
        target = keys.view(np.int32)
        for k in range(0, kept, STEP):
            target[k : k + STEP][: kept - k] = keys[k : min(k + STEP, kept)] % n
        del target
        keys.resize((kept + 1) // 2, refcheck=False)
        return Packed(start, keys.view(np.int32)[:kept], None, np.zeros(n, np.int64))

    def steps(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of nodes in their order, from about STEP links at a time: source, target, weight."""
        n = self.start[nodes + 1] - self.start[nodes]
        block = np.cumsum(n) // STEP
        for own in np.split(nodes, np.flatnonzero(np.diff(block)) + 1):
            n = self.start[own + 1] - self.start[own]
            at = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(own, n), self.target[at].astype(np.int64), np.ones(len(at), np.int64) if self.weight is None else self.weight[at]

    def degrees(self) -> np.ndarray:
        n = np.diff(self.start)
        if self.weight is None:
            return n + 2 * self.inside
        out = 2 * self.inside
        if len(self.weight):
            out[n > 0] += np.add.reduceat(self.weight, self.start[:-1][n > 0], dtype=np.int64)
        return out

    def _of_blocks(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], inside: np.ndarray) -> Packed:
        """Of ordered keys source * nodes + target and their weights, no more than there are links here."""
        n, counts, at = len(inside), np.zeros(len(inside), np.int64), 0
        target, weight = np.empty(len(self.target), np.int32), np.empty(len(self.target), np.int32)
        for keys, sums in blocks:
            target[at : at + len(keys)], weight[at : at + len(keys)] = keys % n, sums
            counts += np.bincount(keys // n, minlength=n)
            at += len(keys)
        target.resize(at, refcheck=False)
        weight.resize(at, refcheck=False)
        return Packed(np.append(0, np.cumsum(counts)), target, weight, inside)

    def contracted(self, label: np.ndarray) -> tuple[Packed, np.ndarray, np.ndarray]:
        """One node for each label, in the order of labels; each node's new number; and the labels."""
        known, to = np.unique(label, return_inverse=True)
        m = len(known)
        within = np.zeros(m, np.int64)

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            last = None
            for source, target, weight in self.steps(np.argsort(to, kind="stable")):
                a, b = to[source], to[target]
                apart = a != b
                np.add.at(within, a[~apart], weight[~apart])
                some = _added(a[apart] * m + b[apart], weight[apart])
                if not len(some[0]):
                    continue
                if last is not None and last[0][-1] // m == some[0][0] // m:
                    some = _added(*(np.concatenate(x) for x in zip(last, some, strict=True)))
                elif last is not None:
                    yield last
                last = some
            if last is not None:
                yield last

        above = self._of_blocks(blocks(), np.zeros(m, np.int64))
        np.add.at(above.inside, to, self.inside)
        # A link within a label is met from both ends.
        above.inside += within // 2
        return above, to, known

    def within(self, label: np.ndarray) -> Packed:
        """Without the links between different labels."""
        n = len(self.inside)

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for source, target, weight in self.steps(np.arange(n)):
                same = label[source] == label[target]
                yield source[same] * n + target[same], weight[same]

        return self._of_blocks(blocks(), self.inside)

    def rows(self) -> Iterator[list[tuple[int, int]]]:
        """For each node its neighbours with their weights."""
        begins = self.start.tolist()
        for a, b in zip(begins, begins[1:], strict=False):
            yield list(zip(self.target[a:b].tolist(), self.weight[a:b].tolist() if self.weight is not None else [1] * (b - a), strict=True))

    def cut(self, label: np.ndarray) -> int:
        """Links between different labels."""
        return sum(int((label[source] != label[target]).sum()) for source, target, _ in self.steps(np.arange(len(self.inside)))) // 2


def _added(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begin], np.add.reduceat(weight[order], begin) if len(begin) else weight[:0]


def local_moving(graph: Packed, total: int) -> np.ndarray:
    """community.local_moving but for the labels' numbers, which have the same order; a node of more than LONG links looks at all labels around it at once."""
    degrees = graph.degrees()
    degree, n = degrees.tolist(), len(degrees)
    begins, target, weight = graph.start.tolist(), graph.target, graph.weight
    label, held = np.arange(n), dict(enumerate(degree))
    # The same as held, for those that look at all labels at once.
    store = degrees.copy()
    fresh, long = n, LONG if total < 2**31 else len(target)
    for _ in range(SWEEPS):
        moves = 0
        for i in range(n):
            a, b = begins[i], begins[i + 1]
            home, k = int(label[i]), degree[i]
            near = label[target[a:b]]
            held[home] -= k
            store[home] -= k
            gain = least = None
            if b - a > long:
                some = None if weight is None else weight[a:b]
                if fresh <= FEW * (b - a):
                    labels, sums = None, np.bincount(near, some, fresh).astype(np.int64)
                    gains = sums * total - store[:fresh] * k
                    stay = int(gains[home])
                    gains[sums == 0] = LOW
                    gains[home] = LOW
                else:
                    labels, at = np.unique(near, return_inverse=True)
                    gains = np.bincount(at, some).astype(np.int64) * total - store[labels] * k
                    own = int(np.searchsorted(labels, home))
                    stay = -held[home] * k
                    if own < len(labels) and labels[own] == home:
                        stay = int(gains[own])
                        gains[own] = LOW
                best = int(gains.argmax())
                if gains[best] != LOW:
                    gain, least = int(gains[best]), best if labels is None else int(labels[best])
            else:
                if weight is None:
                    around = Counter(near.tolist())
                else:
                    around = {}
                    for c, w in zip(near.tolist(), weight[a:b].tolist(), strict=True):
                        around[c] = around.get(c, 0) + w
                stay = around.pop(home, 0) * total - held[home] * k
                for c, w in around.items():
                    g = w * total - held[c] * k
                    if gain is None or g > gain or g == gain and c < least:
                        gain, least = g, c
            if gain is None:
                gain = stay
            goal = home
            if gain > stay:
                goal = least
            if max(gain, stay) < 0:
                goal, fresh = fresh, fresh + 1
                if fresh > len(store):
                    store = np.append(store, np.zeros(len(store) + 1, np.int64))
            held[goal] = held.get(goal, 0) + k
            store[goal] += k
            if goal != home:
                moves += 1
                label[i] = goal
        if not moves:
            break
        # Labels are only compared, so those that are left are numbered anew in their order.
        known, label = np.unique(label, return_inverse=True)
        store, fresh = store[known], len(known)
        held = dict(enumerate(store.tolist()))
    return label


def merged_within(graph: Packed, coarse: np.ndarray) -> np.ndarray:
    """community.merged_within."""
    links = graph.within(coarse)
    degree = links.degrees()
    _, group = np.unique(coarse, return_inverse=True)
    total = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    np.add.at(total, group, degree)
    part = np.arange(len(coarse))
    for _ in range(PASSES):
        table, to, known = links.contracted(part)
        held = np.zeros(len(known), np.int64)
        np.add.at(held, to, degree)
        united = known[np.array(community._united(table.rows(), total[group[known]].tolist(), held.tolist()), np.int64)][to]
        if np.array_equal(united, part):
            break
        part = united
    return part


class PackedGraph:
    """What LocalGraph makes of all its nodes, over numbers: a label a node and each label's name, in the order of clusters.

    Aliases are in order; names and the parts of names are looked at by prefix and auto only.
    """

    def __init__(self, parts: list[np.ndarray], aliases: pa.Array, out_degree: np.ndarray, names: pa.Array, max_size: int):
        self.aliases, self.out_degree, self.names, self.max_size, self.decisions = aliases, out_degree, names, max_size, []
        self.graph = Packed.of(parts, len(aliases))

    def _named(self, label: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Clusters called by their members of highest out-degree."""
        order = np.lexsort((np.arange(len(label)), -self.out_degree, label))
        head = order[np.flatnonzero(np.diff(label[order], prepend=-1))]
        _, to = np.unique(label, return_inverse=True)
        place = np.empty(len(head), np.int64)
        place[np.argsort(head)] = np.arange(len(head))
        return place[to], self.aliases.take(pa.array(np.sort(head)))

    def louvain(self) -> tuple[np.ndarray, pa.Array]:
        total = int(self.graph.degrees().sum())
        above, to, _ = self.graph.contracted(local_moving(self.graph, total))
        return self._named(_moved(above, total)[to])

    def leiden(self) -> tuple[np.ndarray, pa.Array]:
        total = int(self.graph.degrees().sum())
        above, to, _ = self.graph.contracted(merged_within(self.graph, local_moving(self.graph, total)))
        return self._named(merged_within(above, _moved(above, total))[to])

    def prefix(self) -> tuple[np.ndarray, pa.Array]:
        groups: dict[str, list[int]] = {}
        cells = [(community._TOKEN.findall(name) or None) for name in self.names.to_pylist()]
        keys = [["".join(c[:k]) if c else a for c, a in zip(cells, self.aliases.to_pylist(), strict=True)] for k in (1, 2)]
        del cells
        for m, key in enumerate(keys[0]):
            groups.setdefault(key, []).append(m)
        made: list[tuple[bytes, int, str, list[int]]] = []
        for name, own in groups.items():
            finer: dict[str, list[int]] = {}
            for m in own:
                finer.setdefault(keys[1][m], []).append(m)
            chosen = finer if len(own) > self.max_size and len(finer) < len(own) else {name: own}
            made += [(k.encode(), ms[0], k, ms) for k, ms in chosen.items()]
        made.sort()
        label = np.empty(len(self.aliases), np.int64)
        for k, (_, _, _, ms) in enumerate(made):
            label[ms] = k
        return label, pa.array([name for _, _, name, _ in made], pa.string())

    def auto(self) -> tuple[np.ndarray, pa.Array]:
        options = {"prefix": self.prefix(), "leiden": self.leiden()}
        fits = {k: bool(np.bincount(label).max() <= self.max_size) for k, (label, _) in options.items()}
        cuts = {k: self.graph.cut(label) for k, (label, _) in options.items()}
        chosen = "leiden" if (not fits["leiden"], cuts["leiden"]) < (not fits["prefix"], cuts["prefix"]) else "prefix"
        self.decisions.append({"chosen": chosen, "size": len(self.aliases), "prefix_cut": cuts["prefix"], "leiden_cut": cuts["leiden"], "prefix_satisfies": fits["prefix"], "leiden_satisfies": fits["leiden"]})
        return options[chosen]

    def strategy(self, name: str) -> tuple[np.ndarray, pa.Array]:
        return getattr(self, name if name in ("prefix", "louvain", "leiden") else "auto")()


def _moved(above: Packed, total: int) -> np.ndarray:
    """local_moving with tables that are kept, which takes less time, where a task can hold them."""
    if len(above.target) > STEP:
        return local_moving(above, total)
    return community.local_moving(Weighted(np.repeat(np.arange(len(above.inside)), np.diff(above.start)), above.target.astype(np.int64), above.weight.astype(np.int64), above.inside), total)
