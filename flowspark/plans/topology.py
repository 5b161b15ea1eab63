"""The compartment graph: a DAG with a canonical order, layers and weakly connected parts. Graphs are driver-sized."""

from __future__ import annotations

import heapq
from collections import defaultdict


class TopologyError(ValueError):
    pass


class Topology:
    def __init__(self, finite: list[str], boundary: list[str], edges: list[tuple[str, str]]):
        every = [*finite, *boundary]
        if len(set(every)) != len(every):
            raise TopologyError("DuplicateEndpoint")
        if len(set(edges)) != len(edges):
            raise TopologyError("DuplicateConnection")
        if unknown := {e for pair in edges for e in pair} - set(every):
            raise TopologyError(f"UnknownConnectionEndpoint: {sorted(unknown)}")
        self.kinds = {e: "finite" for e in finite} | {e: "boundary" for e in boundary}
        self.edges = sorted(edges)
        self.order = topological_order(every, edges)
        self.rank = {e: k for k, e in enumerate(self.order)}

    def depths(self) -> dict[str, int]:
        """The longest path from a source to each endpoint."""
        depth = dict.fromkeys(self.order, 0)
        after = defaultdict(list)
        for a, b in self.edges:
            after[a].append(b)
        for a in self.order:
            for b in after[a]:
                depth[b] = max(depth[b], depth[a] + 1)
        return depth

    def parts(self, more: list[tuple[str, str]] = ()) -> dict[str, str]:
        """For each endpoint the least endpoint that edges, or more, connect it with; boundary accounts connect nothing."""
        root = {e: e for e in self.kinds}

        def find(e: str) -> str:
            while root[e] != e:
                root[e] = root[root[e]]
                e = root[e]
            return e

        for a, b in [*self.edges, *more]:
            if self.kinds[a] == self.kinds[b] == "finite":
                a, b = sorted((find(a), find(b)))
                root[b] = a
        return {e: find(e) for e in root}


def topological_order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Of the nodes that may come next, always the least; a cycle is an error that names the nodes it holds up."""
    waits, after = dict.fromkeys(nodes, 0), defaultdict(list)
    for a, b in edges:
        waits[b] += 1
        after[a].append(b)
    ready = [n for n, k in waits.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m in after[n]:
            waits[m] -= 1
            if not waits[m]:
                heapq.heappush(ready, m)
    if len(out) < len(waits):
        raise TopologyError(f"Cycle: {sorted(n for n, k in waits.items() if k)}")
    return out
