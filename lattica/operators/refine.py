"""Refinement of clusters to sizes within bounds: rounds of splitting and merging.

Splitting looks at one cluster at a time.  Merging needs no members, only the
quotient graph: sizes, names, and how many neighbours two clusters have in
each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

from lattica.operators.community import Clusters, LocalGraph, in_order
from lattica.options import MISC

#: Fixed value: rounds of splitting and merging.
ROUNDS = 5

Splitter = Callable[[list[str]], Clusters]
#: For each cluster the clusters next to it, with the number of neighbours and the first pair of them.
Links = list[dict[int, tuple[int, tuple[bytes, bytes]]]]


@dataclass
class Shared:
    """What a component's merging has to do with a misc that components share, taken to have no room.

    added: size and name of what went to misc, in order.  asked: of what would
    have joined misc as a neighbour instead of another cluster, if misc had room
    and the component's own part of it doesn't tell.  Clusters are taken up by
    size and name in all components, so these say how large misc is when.
    """

    added: list[tuple[int, str]] = field(default_factory=list)
    asked: list[tuple[int, str]] = field(default_factory=list)


def shared_holds(added: list[tuple[int, str]], asked: list[tuple[int, str]], max_size: int) -> bool:
    """Whether misc had no room whenever a component asked; of equal size and name nothing counts as added before."""
    events = sorted([(n, name.encode(), 1) for n, name in added] + [(n, name.encode(), 0) for n, name in asked])
    misc = 0
    for n, _, is_added in events:
        if not is_added and misc + n <= max_size:
            return False
        misc += n * is_added
    return True


def split_large(clusters: Clusters, max_size: int, splitter: Splitter, stuck: set[tuple[str, ...]]) -> Clusters:
    """Every cluster above max_size is split as long as the splitter makes smaller parts that cover it exactly.

    stuck remembers what could not be split.
    """
    out: Clusters = []
    todo = list(reversed(clusters))
    while todo:
        name, members = todo.pop()
        key = tuple(members)
        if len(members) <= max_size or key in stuck:
            out.append((name, members))
            continue
        parts = splitter(members)
        exact = sorted(m for _, ms in parts for m in ms) == sorted(members)
        if len(parts) < 2 or not exact or max(len(ms) for _, ms in parts) >= len(members):
            stuck.add(key)
            out.append((name, members))
        else:
            todo += reversed(parts)
    return out


def merge_quotient(names: list[str], sizes: list[int], links: Links, min_size: int, max_size: int, others: bool = False, shared: Shared | None = None) -> list[tuple[str, list[int]]]:
    """What clusters become, in order: a name and the numbers of the clusters in it, the one that the others joined first.

    The smallest cluster under min_size joins the neighbour with most links
    that has room, else misc; until none is left or one cluster is.  others:
    whether the graph has clusters besides these.  shared: they also go to misc.
    """
    names, sizes, links = list(names), list(sizes), [dict(x) for x in links]
    held: dict[int, list[int]] = {k: [k] for k in range(len(names))}
    misc = next((k for k, name in enumerate(names) if name == MISC), None)

    def entry(k: int) -> tuple[int, bytes, int]:
        return sizes[k], names[k].encode(), k

    queue = [entry(k) for k in held if names[k] != MISC and sizes[k] < min_size]
    heapq.heapify(queue)
    while queue and len(held) + others > 1:
        small = heapq.heappop(queue)
        k = small[2]
        if k not in held or small != entry(k):
            continue
        room = [(-n, names[j].encode(), first, j) for j, (n, first) in links[k].items() if sizes[j] + sizes[k] <= max_size and (shared is None or j != misc)]
        if shared is not None and room and misc in links[k] and sizes[misc] + sizes[k] <= max_size and (-links[k][misc][0], MISC.encode(), links[k][misc][1]) < min(room)[:3]:
            shared.asked.append((sizes[k], names[k]))
        if room:
            to = min(room)[3]
        else:
            if misc is None:
                misc = len(names)
                names.append(MISC)
                sizes.append(0)
                links.append({})
                held[misc] = []
            to = misc
            if shared is not None:
                shared.added.append((sizes[k], names[k]))
        sizes[to] += sizes[k]
        held[to] += held.pop(k)
        for j, (n, first) in links[k].items():
            back = links[j].pop(k)
            if j == to:
                continue
            for x, y, (more, pair) in ((to, j, (n, first)), (j, to, back)):
                known = links[x].get(y, (0, pair))
                links[x][y] = (known[0] + more, min(known[1], pair))
        links[k] = {}
        if names[to] != MISC and sizes[to] < min_size:
            heapq.heappush(queue, entry(to))
    return [(names[k], held[k]) for k in sorted(held)]


def quotient(clusters: Clusters, graph: LocalGraph) -> Links:
    """Members and neighbours are in order, so the first pair that is met is the least."""
    of = {m: k for k, (_, ms) in enumerate(clusters) for m in ms}
    links: Links = []
    for k, (_, ms) in enumerate(clusters):
        counts: dict[int, int] = {}
        first: dict[int, tuple[bytes, bytes]] = {}
        for m in ms:
            for v in graph.near.get(m, ()):
                j = of.get(v, k)
                if j in counts:
                    counts[j] += 1
                elif j != k:
                    counts[j], first[j] = 1, (m.encode(), v.encode())
        links.append({j: (n, first[j]) for j, n in counts.items()})
    return links


def _small(clusters: Clusters, min_size: int) -> bool:
    return any(name != MISC and len(ms) < min_size for name, ms in clusters)


def merge_small(clusters: Clusters, graph: LocalGraph, min_size: int, max_size: int, others: bool = False, shared: Shared | None = None) -> Clusters:
    """merge_quotient of clusters whose members are at hand."""
    if not _small(clusters, min_size):
        return [(name, sorted(ms, key=str.encode)) for name, ms in clusters]
    merged = merge_quotient([name for name, _ in clusters], [len(ms) for _, ms in clusters], quotient(clusters, graph), min_size, max_size, others, shared)
    return [(name, sorted((m for k in ks for m in clusters[k][1]), key=str.encode)) for name, ks in merged]


def refine_alone(clusters: Clusters, graph: LocalGraph, min_size: int, max_size: int, splitter: Splitter) -> Clusters | None:
    """What refine makes of a component's clusters in any graph, or None if that depends on the graph's other clusters.

    Clusters of different components have no links, so only misc joins them:
    a component where no cluster has that name, and none is left small, goes
    through the rounds by itself, and further rounds change nothing in it.
    """
    alone = True

    def watched(members: list[str]) -> Clusters:
        nonlocal alone
        parts = splitter(members)
        alone = alone and all(name != MISC for name, _ in parts)
        return parts

    if any(name == MISC for name, _ in clusters):
        return None
    out = refine(clusters, graph, min_size, max_size, watched, lambda now: alone and not _small(now, min_size) and all(name != MISC for name, _ in now))
    return out if alone and not _small(out, min_size) and all(name != MISC for name, _ in out) else None


def first_round(clusters: Clusters, graph: LocalGraph, min_size: int, max_size: int, splitter: Splitter) -> tuple[Clusters, Shared] | None:
    """The first round of refine in a component of a graph that has others, all of whose small clusters go to one misc; None if a cluster is called misc before."""
    if any(name == MISC for name, _ in clusters):
        return None
    parts, shared = split_large(clusters, max_size, splitter, set()), Shared()
    if any(name == MISC for name, _ in parts):
        return None
    return merge_small(parts, graph, min_size, max_size, True, shared), shared


def rest_of_rounds(misc: list[str], graph: LocalGraph, heads: dict[str, tuple[str, int]], of: dict[str, str], min_size: int, max_size: int, splitter: Splitter, over: bool) -> list[tuple[str, str | None, list[str]]]:
    """refine from the second round on, where misc alone can be split: a name, the head joined or None, and members of misc, for what these have become.

    heads: name and size of the clusters next to misc, all of which are large
    enough; of: the head of each node next to a member.  There are other
    clusters; over: whether one of them can't be split and is above max_size.
    """
    now: list[tuple[str, str | None, list[str]]] = [*((name, head, []) for head, (name, _) in heads.items()), (MISC, None, misc)]
    stuck: set[tuple[str, ...]] = set()
    before = None

    def size(c: tuple[str, str | None, list[str]]) -> int:
        return len(c[2]) + (heads[c[1]][1] if c[1] is not None else 0)

    for k in range(ROUNDS):
        if k:
            now = [x for c in now for x in ([c] if c[1] is not None else [(name, None, ms) for name, ms in split_large([(c[0], c[2])], max_size, splitter, stuck)])]
            few = {j for j, c in enumerate(now) if c[0] != MISC and size(c) < min_size}
            if few:
                number = {head: j for j, (_, head, _) in enumerate(now) if head is not None}
                own = {m: j for j, (_, _, ms) in enumerate(now) for m in ms}
                links: Links = [{} for _ in now]
                for j in few:
                    for m in now[j][2]:
                        for v in graph.near.get(m, ()):
                            to = own[v] if v in own else number[of[v]]
                            for a, b, pair in ((j, to, (m.encode(), v.encode())), (to, j, (v.encode(), m.encode()))) if to not in few else ((j, to, (m.encode(), v.encode())),):
                                if a != b:
                                    n, first = links[a].get(b, (0, pair))
                                    links[a][b] = (n + 1, min(first, pair))
                merged = merge_quotient([c[0] for c in now], [size(c) for c in now], links, min_size, max_size, True)
                now = [(name, now[js[0]][1], sorted((m for j in js for m in now[j][2]), key=str.encode)) for name, js in merged]
        state = {(name, head, tuple(ms)) for name, head, ms in now}
        if not over and all(size(c) <= max_size for c in now) or state == before:
            break
        before = state
    return [c for c in now if c[2]]


def refine(clusters: Clusters, graph: LocalGraph, min_size: int, max_size: int, splitter: Splitter, go_on: Callable[[Clusters], bool] = lambda now: True, others: bool = False) -> Clusters:
    """Split, then merge, until nothing is above max_size, a round changes nothing, or five rounds are over; or go_on says no."""
    stuck: set[tuple[str, ...]] = set()
    before = None
    for _ in range(ROUNDS):
        clusters = merge_small(split_large(clusters, max_size, splitter, stuck), graph, min_size, max_size, others)
        if not go_on(clusters):
            break
        now = {(name, tuple(ms)) for name, ms in clusters}
        if all(len(ms) <= max_size for _, ms in clusters) or now == before:
            break
        before = now
    return in_order(clusters)
