"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are first counted by membership pattern (the set of sources they
belong to). A flow then routes token capacity from patterns to source quotas; the
r-th repetition of a pattern's tokens costs ``r * r``, so repetitions are spread
before they are stacked. The network has one node per pattern and source, not
per document. Last, documents are laid out along each pattern's flow in a seeded
order, and each takes the stretch it covers.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small

#: Most membership patterns a mix may have; their sizes and flows are held on the driver.
MOST_PATTERNS = 1_000_000
#: The key of documents without a source.
NULL = "\0"
#: Documents of a pattern are ordered by hash in so many slices, summed apart.
SLICES = 4096


def targets(sizes: dict, weights: dict, total: int, copies: int) -> dict:
    """Shares of ``total`` by weight, none above ``copies`` times its source's size; the excess is reshared by weight."""
    capped, out = set(), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(copies * sizes[s] for s in capped)
        weight = sum(weights[s] for s in free)
        out = {s: float(copies * sizes[s]) for s in capped} | {s: float(weights[s] * rest) / float(weight) for s in free}
        over = {s for s in free if out[s] > copies * sizes[s]}
        if not over:
            return out
        capped |= over


def min_cost_flow(capacity: list[int], quota: list[int], member: list[list[int]], copies: int) -> list[dict[int, int]]:
    """Tokens from each pattern to each of its sources, at least total cost, filling quotas as far as possible.

    Successive shortest paths with potentials; an arc per pattern and repetition
    (capacity: the pattern's tokens, cost r * r), one per pattern and source, one
    per source (capacity: its quota).
    """
    n = len(capacity)
    source, sink = n + len(quota), n + len(quota) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for u, v, k, w in ((a, b, cap, c), (b, a, 0, -c)):
            graph[u].append(len(to))
            to.append(v)
            room.append(k)
            cost.append(w)
        return len(to) - 2

    routes = []
    for p in range(n):
        for r in range(copies):
            arc(source, p, capacity[p], r * r)
        routes.append({s: arc(p, n + s, copies * capacity[p], 0) for s in member[p]})
    for s, q in enumerate(quota):
        arc(n + s, sink, q, 0)
    potential = [0] * (sink + 1)
    while True:
        far, via, queue = [None] * (sink + 1), [-1] * (sink + 1), [(0, source)]
        far[source] = 0
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in graph[u]:
                v = to[e]
                if room[e] and (far[v] is None or d + cost[e] + potential[u] - potential[v] < far[v]):
                    far[v] = d + cost[e] + potential[u] - potential[v]
                    via[v] = e
                    heapq.heappush(queue, (far[v], v))
        if far[sink] is None:
            break
        most = max(x for x in far if x is not None)
        potential = [p + (most if f is None else f) for p, f in zip(potential, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [{s: room[e ^ 1] for s, e in r.items() if room[e ^ 1]} for r in routes]


def route(capacity: list[int], quota: list[int], member: list[list[int]], copies: int) -> list[dict[int, int]]:
    """``min_cost_flow``, solved apart for each group of patterns that sources connect.

    A pattern alone with its only source takes the quota, as far as its copies
    reach; so sources that don't overlap cost one step each.
    """
    head = list(range(len(quota)))

    def find(s: int) -> int:
        while head[s] != s:
            head[s] = head[head[s]]
            s = head[s]
        return s

    for m in member:
        for s in m[1:]:
            head[find(s)] = find(m[0])
    groups: dict[int, list[int]] = {}
    for p, m in enumerate(member):
        if m:
            groups.setdefault(find(m[0]), []).append(p)
    out: list[dict[int, int]] = [{} for _ in member]
    for patterns in groups.values():
        if len(patterns) == 1 and len(member[patterns[0]]) == 1:
            p, s = patterns[0], member[patterns[0]][0]
            out[p] = {s: min(quota[s], copies * capacity[p])}
            continue
        here = sorted({s for p in patterns for s in member[p]})
        place = {s: i for i, s in enumerate(here)}
        flows = min_cost_flow([capacity[p] for p in patterns], [quota[s] for s in here], [[place[s] for s in member[p]] for p in patterns], copies)
        for p, flow in zip(patterns, flows, strict=True):
            out[p] = {here[s]: x for s, x in flow.items()}
    return out


def source_key(name: Column) -> Column:
    """A source's name as the key of a map: null is U+0000, and a name that begins with U+0000 has one more."""
    return F.when(name.isNull(), NULL).when(F.startswith(name, F.lit(NULL)), F.concat(F.lit(NULL), name)).otherwise(name)


def order_key(seed: str, *columns: str | Column) -> Column:
    """A seeded random order that reruns and other engines repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def mix(docs: DataFrame, *, sources: str, size: str, key: str, weights, total: int | None = None, copies: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with ``source_sizes``, ``targets`` and ``taken`` (maps by source).

    ``sources`` is an array column of source names (null names count as a source
    of their own; ``source_key`` gives the key of a name), ``size`` the words
    of a document, ``key`` its id. Input columns of any other name come back as
    they are. ``weights`` maps the sorted source names to
    their weights. ``taken`` counts the words each source takes from a document,
    repetitions included, at most ``copies`` times its size in all. The mix takes
    whole documents in a seeded order; the document at a quota's end is cut there.

    Documents of size 0 take part with 0. A null size is 0, an empty or null
    source array takes nothing. Repeated rows are separate documents. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), source_key)))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    d = docs.select(row.alias("_row"), names.alias("_pattern"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"), F.col(key).alias("_key"))
    counted = d.groupBy("_pattern").agg(F.sum("_size").alias("tokens")).limit(MOST_PATTERNS + 1).collect()
    if len(counted) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    counted.sort(key=lambda r: r._pattern)
    order = sorted({s for r in counted for s in r._pattern}, key=lambda s: (s == NULL, s))
    sizes = dict.fromkeys(order, 0)
    for r in counted:
        for s in r._pattern:
            sizes[s] += r.tokens
    total = sum(r.tokens for r in counted) if total is None else total
    want = targets(sizes, weights(order), total, copies) if sizes and total else dict.fromkeys(order, 0.0)
    index = {s: i for i, s in enumerate(order)}
    flows = route([r.tokens for r in counted], [round(want[s]) for s in order], [[index[s] for s in r._pattern] for r in counted], copies)

    # stretches of each pattern's flow: where a source's part begins and ends
    rows = []
    for r, flow in zip(counted, flows, strict=True):
        at, parts = 0, []
        for s in r._pattern:
            parts.append((s, at, at + flow.get(index[s], 0), sizes[s], want[s]))
            at = parts[-1][2]
        rows.append((r._pattern, r.tokens, parts))
    plan = spark.createDataFrame(rows, "_pattern array<string>, _tokens long, _parts array<struct<source:string,lo:long,hi:long,size:long,target:double>>")

    # where a document begins in its pattern's order: a sum over slices, then inside the slice
    d = d.withColumn("_order", order_key(seed, F.col("_key").cast("string"))).withColumn("_slice", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    slices = d.groupBy("_pattern", "_slice").agg(F.sum("_size").alias("_sum"))
    before = slices.select("_pattern", "_slice", (F.sum("_sum").over(W.partitionBy("_pattern").orderBy("_slice")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_size").over(W.partitionBy("_pattern", "_slice").orderBy("_order", "_key", "_size").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    d = d.withColumn("_inside", inside).join(small(before), ["_pattern", "_slice"]).join(small(plan), "_pattern")
    start = F.col("_before") + F.col("_inside")

    def taken(part):
        lap = [F.greatest(F.lit(0), F.least(part.hi, start + i * F.col("_tokens") + F.col("_size")) - F.greatest(part.lo, start + i * F.col("_tokens"))) for i in range(copies)]
        return sum(lap[1:], lap[0])

    def by_source(value):
        return F.map_from_entries(F.transform("_parts", lambda p: F.struct(p.source, value(p))))

    new = {"source_sizes": by_source(lambda p: p.size), "targets": by_source(lambda p: p.target), "taken": by_source(taken)}
    return d.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def cycle_weights(order: list[str]) -> dict[str, int]:
    """1, 2, 3, repeating along the sorted sources."""
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def repeated(docs: DataFrame, taken: Column, size: Column) -> DataFrame:
    """Each document as often as the mix takes it (a begun copy counts), with ``copy`` from 0."""
    times = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    numbers = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return docs.withColumn("copy", F.explode(numbers))
