"""Plain models of the definitions, for comparison on small random inputs.

Events are tuples (event_id, microseconds, {key: value}).
"""
from itertools import combinations


def id_edges(events, window_us, key_order):
    """{(source, target): matched_on}; groups in the order in which their first events come."""
    events = sorted(events, key=lambda e: (e[1], e[0]))
    groups = {}
    for event in events:
        for key in sorted(event[2], key=key_order.index):
            groups.setdefault((key, event[2][key]), []).append(event)
    edges = {}
    for (key, _), members in groups.items():
        for a, b in combinations(members, 2):
            if b[1] - a[1] <= window_us:
                edges.setdefault((a[0], b[0]), key)
    return edges


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def bucket_of(times, width):
    """{time: start of its bucket}"""
    found, start = {}, None
    for t in sorted(set(times)):
        if start is None or t - start > width:
            start = t
        found[t] = start
    return found
