"""Plain-Python reference implementations for the iterative graph metrics.

Written from the textbook definitions (Dijkstra; Brandes 2001; power
iteration on I + A) to check the Spark operators on small graphs.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict


def adjacency(edges):
    """edges: [(u, v, w)] of a simple undirected graph."""
    adj = defaultdict(dict)
    nodes = set()
    for u, v, w in edges:
        nodes.update([u, v])
        adj[u][v] = w
        adj[v][u] = w
    return nodes, adj


def dijkstra(adj, s):
    dist = {s: 0.0}
    sigma = defaultdict(float)
    sigma[s] = 1.0
    preds = defaultdict(list)
    order = []
    seen = {s: 0.0}
    heap = [(0.0, s)]
    done = set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        dist[v] = d
        order.append(v)
        for w, wt in adj[v].items():
            if w == v or wt <= 0:
                continue
            nd = d + wt
            if w not in seen or nd < seen[w]:
                seen[w] = nd
                heapq.heappush(heap, (nd, w))
                sigma[w] = sigma[v]
                preds[w] = [v]
            elif nd == seen[w] and w not in done:
                sigma[w] += sigma[v]
                preds[w].append(v)
    return dist, sigma, preds, order


def closeness(edges):
    nodes, adj = adjacency(edges)
    n = len(nodes)
    out = {}
    for u in nodes:
        dist, *_ = dijkstra(adj, u)
        tot = sum(dist.values())
        r = len(dist)
        out[u] = ((r - 1) / tot) * ((r - 1) / (n - 1)) if tot > 0 and n > 1 else 0.0
    return out


def betweenness(edges):
    nodes, adj = adjacency(edges)
    n = len(nodes)
    b = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, preds, order = dijkstra(adj, s)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                b[w] += delta[w]
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {v: x * scale for v, x in b.items()}


def eigenvector(edges, max_iter=1000, tol=1e-6):
    nodes, adj = adjacency(edges)
    n = len(nodes)
    x = {v: 1.0 / n for v in nodes}
    for _ in range(max_iter):
        last = x
        x = dict(last)
        for v in x:
            for nbr, w in adj[v].items():
                x[nbr] += last[v] * w
        norm = math.sqrt(sum(t * t for t in x.values())) or 1.0
        x = {v: t / norm for v, t in x.items()}
        if sum(abs(x[v] - last[v]) for v in x) < n * tol:
            return x
    return dict.fromkeys(nodes, 0.0)


def degree(edges):
    nodes, _ = adjacency(edges)
    deg = defaultdict(int)
    for u, v, _w in edges:
        deg[u] += 1
        deg[v] += 1
    n = len(nodes)
    return {v: (deg[v] / (n - 1) if n > 1 else 1.0) for v in nodes}
