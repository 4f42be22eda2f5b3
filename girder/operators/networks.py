"""Activity networks, many at once: dates, order, the impact of events, and generated work breakdowns.

A network of up to LARGE rows is worked out by one task, which has its activities and links together after one shuffle
by network. Dates and order of networks of up to SMALL rows are worked out many at once, as arrays and level by level.
Those of more than LARGE rows go by rounds of joins over what has changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from . import schedule

#: Activities and links of a network that one task works out.
LARGE = 400_000
#: Rows of a network that is worked out together with others, rows that are so at once, and rows of a partition, about.
SMALL, TOGETHER, PART_ROWS = 512, 50_000, 2_000_000
AT_END, TO_END = ("FS", "FF"), ("FF", "SF")


class Network:
    """One network: ids by index, durations, and the links into and out of each activity."""

    def __init__(self, rows: list[tuple]):
        own = [r for r in rows if r[0] == 0]
        self.ids = [r[1] for r in own]
        self.durations = [r[4] for r in own]
        at = {a: i for i, a in enumerate(self.ids)}
        self.into: list[list[tuple]] = [[] for _ in own]
        self.out: list[list[tuple]] = [[] for _ in own]
        self.unknown = [0] * len(own)
        for _, pred, succ, kind, lag, *_ in (r for r in rows if r[0] == 1):
            if succ in at and pred in at:
                link = (at[pred], at[succ], kind, lag)
                self.into[at[succ]].append(link)
                self.out[at[pred]].append(link)
            elif succ in at:
                self.unknown[at[succ]] += 1
        self.events = [(at.get(a), a, n, e) for _, a, _, e, n, _ in sorted((r for r in rows if r[0] == 2), key=lambda r: r[5])]

    def weight(self, link: tuple) -> int:
        """The start of the later activity is at least that of the earlier one plus so much."""
        pred, succ, kind, lag = link
        return lag + self.durations[pred] * (kind in AT_END) - self.durations[succ] * (kind in TO_END)

    def levels(self, back: bool = False, among: set[int] | None = None) -> dict[int, int]:
        """The level of each activity whose predecessors all have one, peeled from those that have none (from the other end with ``back``)."""
        ahead, behind = (self.into, self.out) if back else (self.out, self.into)
        end = 0 if back else 1
        inside = among if among is not None else set(range(len(self.ids)))
        waits = {i: sum(link[1 - end] in inside for link in behind[i]) for i in inside}
        now, level, found = [i for i, n in waits.items() if not n], 0, {}
        while now:
            after = []
            for i in now:
                found[i] = level
                for link in ahead[i]:
                    j = link[end]
                    if j in waits:
                        waits[j] -= 1
                        if not waits[j]:
                            after.append(j)
            now, level = after, level + 1
        return found

    def order(self) -> list[int]:
        found = self.levels()
        if len(found) < len(self.ids):
            raise ValueError("a schedule network has a cycle")
        return sorted(found, key=found.__getitem__)

    def start(self, i: int, early: list[int]) -> int:
        return max((early[link[0]] + self.weight(link) for link in self.into[i]), default=0)

    def early(self, order: list[int]) -> list[int]:
        early = [0] * len(order)
        for i in order:
            early[i] = max(0, self.start(i, early))
        return early


def codes(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers that are equal where values are, nulls among them."""
    both = pa.concat_arrays(columns)
    if pa.types.is_integer(both.type) and not both.null_count:
        found = both.to_numpy().astype(np.int64)
    else:
        found = both.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    return np.split(found, np.cumsum([len(c) for c in columns])[:-1])


def begins(network: pa.Array) -> np.ndarray:
    """Where rows of another network begin; a network's name may be a struct."""
    if pa.types.is_struct(network.type):
        new = np.logical_or.reduce([begins(c) for c in network.flatten()])
    else:
        (own,) = codes(network)
        new = own[1:] != own[:-1]
        new = np.append(True, new) if len(own) else new
    return new


def levels_of(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The level of each of ``n`` activities whose sources all have one, and -1 of the others."""
    order = np.argsort(source, kind="stable")
    target, first = target[order], np.append(0, np.cumsum(np.bincount(source, minlength=n)))
    waits, level, now, k = np.bincount(target, minlength=n), np.full(n, -1), None, 0
    now = np.flatnonzero(waits == 0)
    while len(now):
        level[now] = k
        size = first[now + 1] - first[now]
        met = target[np.repeat(first[now] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        np.subtract.at(waits, met, 1)
        met = np.unique(met)
        now, k = met[waits[met] == 0], k + 1
    return level


class Networks:
    """Many small networks at once: their activities by index, and the links between them as arrays."""

    def __init__(self, rows: pa.RecordBatch):
        network, part, a, b, kind, n, _ = rows.columns
        own = np.cumsum(begins(network)) - 1
        part = part.to_numpy()
        (a_codes, b_codes), (acts, links) = codes(a, b), (np.flatnonzero(part == k) for k in (0, 1))
        name = np.unique(np.concatenate([a_codes, b_codes]), return_inverse=True)[1]
        width = name.max(initial=0) + 1
        key, to = own * width + name[: len(own)], own * width + name[len(own) :]
        if n.take(pa.array(np.concatenate([acts, links]))).null_count:
            raise ValueError("a duration or a lag is null")
        n = n.fill_null(0).to_numpy().astype(np.int64)
        acts = acts[np.argsort(key[acts], kind="stable")]
        self.rows, self.own, self.durations, keys = acts, own[acts], n[acts], key[acts]
        at = lambda wanted: np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        pred, succ = at(key[links]), at(to[links])
        known = [keys[i] == wanted[links] if len(keys) else np.zeros(len(links), bool) for i, wanted in ((pred, key), (succ, to))]
        self.unknown = np.bincount(succ[known[1] & ~known[0]], minlength=len(acts))
        links, pred, succ = (x[known[0] & known[1]] for x in (links, pred, succ))
        self.pred, self.succ = pred, succ
        named = lambda kinds: pc.fill_null(pc.is_in(kind, pa.array(kinds, kind.type)), False).to_numpy(zero_copy_only=False)[links]
        self.weights = n[links] + self.durations[pred] * named(AT_END) - self.durations[succ] * named(TO_END)
        self.names = a


def dated_together(rows: pa.RecordBatch) -> tuple[np.ndarray, list]:
    """(rows of the activities, columns after the activity's name), as ``dated`` tells them."""
    net = Networks(rows)
    pred, succ, w, n = net.pred, net.succ, net.weights, len(net.rows)
    level = levels_of(n, pred, succ)
    if (level < 0).any():
        raise ValueError("a schedule network has a cycle")
    order = np.argsort(level[pred], kind="stable")
    pred, succ, w = pred[order], succ[order], w[order]
    slices = [slice(lo, hi) for lo, hi in pairwise([*np.flatnonzero(np.diff(level[pred], prepend=-1)), len(pred)])]
    early = np.zeros(n, np.int64)
    for s in slices:
        np.maximum.at(early, succ[s], early[pred[s]] + w[s])
    finish = np.zeros(net.own.max(initial=0) + 1, np.int64)
    np.maximum.at(finish, net.own, early + net.durations)
    late = finish[net.own] - net.durations
    for s in reversed(slices):
        np.minimum.at(late, pred[s], late[succ[s]] - w[s])
    total, most = late - early, np.iinfo(np.int64).max
    free = np.full(n, most)
    np.minimum.at(free, pred, np.maximum(0, early[succ] - early[pred] - w))
    return net.rows, [net.durations, early, early + net.durations, late, late + net.durations, total, np.where(free == most, total, free), total <= 0]


def named_together(rows: pa.RecordBatch) -> tuple[np.ndarray, list]:
    """(rows of the activities, columns after the activity's name), as ``named`` tells them."""
    net = Networks(rows)
    n = len(net.rows)
    level = levels_of(n, net.pred, net.succ)
    lost = level < 0
    inner = lost[net.pred] & lost[net.succ]
    behind = levels_of(n, net.succ[inner], net.pred[inner]) >= 0
    spelt = net.names.take(pa.array(net.rows)).dictionary_encode(null_encoding="encode")
    words = spelt.dictionary.to_pylist()
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (words[i] is not None, words[i]))] = np.arange(len(words))
    seen = np.lexsort((rank[spelt.indices.to_numpy()], level, net.own))
    seen = seen[~lost[seen]]
    first = np.searchsorted(net.own[seen], net.own[seen])
    place = np.zeros(n, np.int64)
    place[seen] = np.arange(len(seen)) - first + 1
    problem = pa.array(np.where(behind, "behind a cycle", "cycle"), pa.string(), mask=~lost)
    return net.rows, [pa.array(level, pa.int32(), mask=lost), pa.array(place, pa.int32(), mask=lost), net.unknown, problem]


def in_batches(parts: DataFrame, solve: Callable, together: Callable, schema: StructType, n_rows: int) -> DataFrame:
    """As in_tasks, with ``together`` for the small networks; partitions grow with ``n_rows``, so that what a task sorts does not."""
    arrow = to_arrow_schema(schema)

    def told(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = np.append(np.flatnonzero(begins(rows.column(0))), rows.num_rows)
        size = np.diff(first)
        few = rows.filter(pa.array(np.repeat(size <= SMALL, size)))
        if few.num_rows:
            at, columns = together(few)
            at = pa.array(at)
            columns = [few.column(0).take(at), few.column(2).take(at), *columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        for lo, n in zip(first[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            one = rows.slice(lo, n)
            network, out = one.column(0)[0].as_py(), list(solve(list(zip(*(c.to_pylist() for c in one.columns[1:]), strict=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[network] * len(out), *zip(*out, strict=True)], arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest = [], 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < max(TOGETHER, 2 * rest):
                continue
            (whole,) = pa.Table.from_batches(held).combine_chunks().to_batches()
            last = int(np.flatnonzero(begins(whole.column(0)))[-1])
            yield from told(whole.slice(0, last)) if last else ()
            held, rest = [whole.slice(last)], whole.num_rows - last
        if sum(b.num_rows for b in held):
            (whole,) = pa.Table.from_batches(held).combine_chunks().to_batches()
            yield from told(whole)

    n = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PART_ROWS))
    return parts.repartition(n, "network").sortWithinPartitions("network", "part").mapInArrow(run, schema)


def in_tasks(parts: DataFrame, solve: Callable[[list[tuple]], Iterator[tuple]], schema: StructType) -> DataFrame:
    """What ``solve`` makes of the rows (part, a, b, kind, n, seq) of each network, with the network in front."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, started, out = None, [], False, []

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for network, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and network != now:
                    out += [(now, *r) for r in solve(held)]
                    held = []
                now, started = network, True
                held.append(tuple(row))
            if len(out) > 50_000:
                yield told()
                out = []
        if started:
            out += [(now, *r) for r in solve(held)]
        yield told()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "network").sortWithinPartitions("network", "part").mapInArrow(run, schema)


def parts_of(activities: DataFrame, edges: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Rows of all three kinds in one table; links default to FS without lag."""
    kind = activities.schema["activity"].dataType
    columns = lambda df, part, a, b, k, n, s: df.select(
        "network", F.lit(part).alias("part"), a.cast(kind).alias("a"), b.cast(kind).alias("b"), k.cast("string").alias("kind"), n.cast("long").alias("n"), s.cast("long").alias("seq")
    )
    none = F.lit(None)
    rows = columns(activities, 0, F.col("activity"), none, none, F.col("duration"), none).unionByName(columns(edges, 1, F.col("pred"), F.col("succ"), F.col("kind"), F.col("lag"), none))
    if events is None:
        return rows
    return rows.unionByName(columns(events, 2, F.col("activity"), none, F.col("event"), F.col("delay"), F.col("seq")))


def schema_of(activities: DataFrame, *fields: tuple) -> StructType:
    own = [StructField(c, activities.schema[c].dataType) for c in ("network", "activity")]
    return StructType([*own, *(StructField(name, kind) for name, kind in fields)])


def dated(rows: list[tuple]) -> Iterator[tuple]:
    net = Network(rows)
    order = net.order()
    early = net.early(order)
    finish = max((early[i] + net.durations[i] for i in order), default=0)
    late = [finish - d for d in net.durations]
    free: list[int | None] = [None] * len(order)
    for i in reversed(order):
        for link in net.out[i]:
            late[i] = min(late[i], late[link[1]] - net.weight(link))
            slack = max(0, early[link[1]] - early[i] - net.weight(link))
            free[i] = slack if free[i] is None else min(free[i], slack)
    for i, a in enumerate(net.ids):
        total, d = late[i] - early[i], net.durations[i]
        yield a, d, early[i], early[i] + d, late[i], late[i] + d, total, total if free[i] is None else free[i], total <= 0


def split_by_size(activities: DataFrame, edges: DataFrame) -> tuple[int, DataFrame | None]:
    """The number of rows, and (network) of those too large for a task; None where there are none."""
    rows = activities.select("network").unionByName(edges.select("network")).groupBy("network").count()
    total, most = rows.agg(F.sum("count"), F.max("count")).first()
    return total or 0, None if (most or 0) <= LARGE else schedule.cut(rows.where(F.col("count") > LARGE).select("network"))


def critical_path(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """Early and late dates, floats and criticality of (network, activity, duration) under (network, pred, succ, kind, lag).

    ``kind`` is FS, SS, FF or SF; lags may be negative; nothing starts before day 0. Links of unknown activities
    are dropped. Free float is the least slack to a successor, 0 at least, and the total float where there is none.
    Activities are named once in a network. Raises ValueError where a network has a cycle (``ordered`` names those).
    """
    names = ("duration", "early_start", "early_finish", "late_start", "late_finish", "total_float", "free_float")
    schema = schema_of(activities, *((n, LongType()) for n in names), ("is_critical", BooleanType()))
    n, large = split_by_size(activities, edges)
    if large is None:
        return in_batches(parts_of(activities, edges), dated, dated_together, schema, n)
    part = lambda df, how: df.join(large, "network", how)
    small = in_batches(parts_of(part(activities, "left_anti"), part(edges, "left_anti")), dated, dated_together, schema, n)
    return small.unionByName(schedule.critical_path(part(activities, "left_semi"), part(edges, "left_semi")))


def named(rows: list[tuple]) -> Iterator[tuple]:
    net = Network(rows)
    found = net.levels()
    blocked = set(range(len(net.ids))) - set(found)
    behind = net.levels(True, blocked)
    place = {i: k + 1 for k, i in enumerate(sorted(found, key=lambda i: (found[i], net.ids[i])))}
    for i, a in enumerate(net.ids):
        yield a, found.get(i), place.get(i), net.unknown[i], None if i in found else "behind a cycle" if i in behind else "cycle"


def peeled(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(network, activity, level) of the nodes whose sources all have a level, round by round; arcs are (network, source, target)."""
    need = arcs.groupBy("network", F.col("target").alias("activity")).agg(F.count("*").alias("need"))
    need = schedule.cut(nodes.join(need, ["network", "activity"], "left").select("network", "activity", F.coalesce("need", F.lit(0)).alias("need")))
    now = schedule.cut(need.where("need = 0").select("network", "activity", F.lit(0).alias("level")))
    found, met = now, None
    while not now.isEmpty():
        came = now.select("network", F.col("activity").alias("source"), "level").join(arcs, ["network", "source"]).groupBy("network", F.col("target").alias("activity")).agg(F.count("*").alias("met"), F.max("level").alias("level"))
        came = schedule.cut(came)
        # Of the counts of earlier rounds only those of the nodes that are met now are added up.
        met = came if met is None else met.unionByName(came)
        total = met.join(came.select("network", "activity"), ["network", "activity"], "left_semi").groupBy("network", "activity").agg(F.sum("met").alias("met"), F.max("level").alias("level"))
        now = schedule.cut(total.join(need, ["network", "activity"]).where("met = need").select("network", "activity", (F.col("level") + 1).alias("level")))
        found = found.unionByName(now)
    return found


def ordered(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """(network, activity, level, position, n_unknown, problem) of each activity.

    Activities are peeled by levels, and have positions by level, then by name. What can't be placed has a problem
    instead: it is in a cycle (or between two), or behind one; other networks and what stands before a cycle are
    placed as ever. ``n_unknown`` is the number of links from activities that the network doesn't have, which are left out.
    """
    plain = edges.withColumn("kind", F.lit("FS")).withColumn("lag", F.lit(0))
    schema = schema_of(activities, ("level", IntegerType()), ("position", IntegerType()), ("n_unknown", IntegerType()), ("problem", StringType()))
    acts = activities.withColumn("duration", F.lit(0))
    n, large = split_by_size(acts, plain)
    if large is None:
        return in_batches(parts_of(acts, plain), named, named_together, schema, n)
    part = lambda df, how: df.join(large, "network", how)
    small = in_batches(parts_of(part(acts, "left_anti"), part(plain, "left_anti")), named, named_together, schema, n)
    return small.unionByName(ordered_in_rounds(part(acts, "left_semi"), part(plain, "left_semi")).select(*small.columns))


def ordered_in_rounds(activities: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = schedule.cut(activities.select("network", "activity"))
    arcs = edges.select("network", F.col("pred").alias("source"), F.col("succ").alias("target"))
    known = lambda arcs, end: arcs.join(nodes.select("network", F.col("activity").alias(end)), ["network", end], "left_semi")
    lost = known(arcs, "target").join(nodes.select("network", F.col("activity").alias("source")), ["network", "source"], "left_anti").groupBy("network", F.col("target").alias("activity")).agg(F.count("*").cast("int").alias("n_unknown"))
    arcs = schedule.cut(known(known(arcs, "source"), "target"))
    placed = schedule.cut(peeled(nodes, arcs))
    blocked = schedule.cut(nodes.join(placed, ["network", "activity"], "left_anti"))
    inner = lambda arcs, end: arcs.join(blocked.select("network", F.col("activity").alias(end)), ["network", end], "left_semi")
    back = inner(inner(arcs, "source"), "target").select("network", F.col("target").alias("source"), F.col("source").alias("target"))
    behind = peeled(blocked, schedule.cut(back)).select("network", "activity", F.lit("behind a cycle").alias("behind"))
    # Positions: how many stand on lower levels, then the place among those of the level.
    per_level = placed.groupBy("network", "level").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("network").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("network", "level").orderBy("activity"))
    seated = placed.withColumn("place", place).join(per_level.withColumn("before", before), ["network", "level"]).select("network", "activity", "level", (F.col("before") + F.col("place")).cast("int").alias("position"))
    both = nodes.join(seated, ["network", "activity"], "left").join(behind, ["network", "activity"], "left").join(lost, ["network", "activity"], "left")
    problem = F.when(F.col("level").isNull(), F.coalesce("behind", F.lit("cycle")))
    return both.select("network", "activity", F.col("level").cast("int").alias("level"), "position", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), problem.alias("problem"))


def impacts(rows: list[tuple]) -> Iterator[tuple]:
    """Each event in turn lengthens its activity; only what that moves is dated anew."""
    net = Network(rows)
    order = net.order()
    place = {i: k for k, i in enumerate(order)}
    early = net.early(order)
    finish = max((early[i] + net.durations[i] for i in order), default=0)
    for i, activity, delay, event in net.events:
        before, moved = finish, 0
        if i is not None:
            net.durations[i] += delay
            queue, queued = [place[i]], {i}
            for link in net.out[i]:
                if link[1] not in queued:
                    queued.add(link[1])
                    queue.append(place[link[1]])
            heapq.heapify(queue)
            while queue:
                j = order[heapq.heappop(queue)]
                queued.discard(j)
                now = max(0, net.start(j, early))
                if now != early[j]:
                    early[j], moved = now, moved + 1
                    for link in net.out[j]:
                        if link[1] not in queued:
                            queued.add(link[1])
                            heapq.heappush(queue, place[link[1]])
            finish = max(early[k] + net.durations[k] for k in order)
        yield activity, event, delay, before, finish, finish - before, moved, None if i is None else net.durations[i]


def time_impact(activities: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """(network, activity, event, delay, finish_before, finish_after, impact, n_moved, duration) of each of (network, event, activity, delay, seq).

    Events are put into their network one after the other, by ``seq``, each as a delay of its activity; the finish after
    each is that of a whole rerun with all events so far, but only starts that change are worked out. ``n_moved`` counts
    those. Events of unknown activities change nothing. One task has a network and its events.
    """
    names = ("event", "delay", "finish_before", "finish_after", "impact", "n_moved", "duration")
    schema = schema_of(activities, *((n, StringType() if n == "event" else LongType()) for n in names))
    known = events.join(activities.select("network").distinct(), "network", "left_semi")
    return in_tasks(parts_of(activities, edges, known), impacts, schema)


def zone_counts(template: DataFrame, targets: DataFrame, most: int = 80) -> DataFrame:
    """(project, zones): the smallest number of zones with which a project's template has its target of activities, ``most`` at most."""
    sizes = template.groupBy("project").agg(F.count_if("zoneable").alias("zoned"), F.count_if(~F.col("zoneable")).alias("single"))
    wanted = F.when(F.col("zoned") > 0, F.ceil((F.col("target") - F.col("single")) / F.col("zoned"))).otherwise(F.lit(most))
    reached = F.when(F.col("zoned") + F.col("single") >= F.col("target"), 1).otherwise(wanted)
    return sizes.join(targets, "project").select("project", F.greatest(F.lit(1), F.least(F.lit(most), reached)).cast("int").alias("zones"))


def letters(n: str) -> str:
    """SQL for A to Z, then AA and on, for numbers from 0."""
    return f"CASE WHEN {n} < 26 THEN char(65 + {n}) ELSE concat(char(64 + CAST(floor({n} / 26) AS INT)), char(65 + {n} % 26)) END"


def work_breakdown(template: DataFrame, targets: DataFrame, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """(activities, links) of generated networks, as critical_path takes them.

    ``template`` has project, place (the order over all phases), phase, part, name, duration and zoneable; ``targets``
    project and target. A zoneable activity is repeated for each zone, a day longer in each next one, so that one zone
    is critical. Activities of a part that follow each other in zones are chains, zone by zone; everything else
    waits for all zones of what stands before it.
    """
    w = Window.partitionBy("project").orderBy("place")
    counted = template.join(zone_counts(template, targets, most), "project").withColumn("n", F.when(F.col("zoneable"), F.col("zones")).otherwise(F.lit(1)))
    code = F.concat_ws(".", "phase", "part", F.row_number().over(Window.partitionBy("project", "phase", "part").orderBy("place")).cast("string"))
    placed = counted.withColumn("code", code)
    for c in ("code", "n", "phase", "part"):
        placed = placed.withColumn(f"prev_{c}", F.lag(c).over(w))
    each = placed.withColumn("zone", F.explode(F.sequence(F.lit(1), F.col("n"))))
    name_of = lambda code, n, zone: F.when(n > 1, F.concat_ws(".", code, zone.cast("string"))).otherwise(code)
    acts = each.withColumn("activity", name_of(F.col("code"), F.col("n"), F.col("zone")))
    label = F.when(F.col("n") > 1, F.concat("name", F.lit(" - Hall "), F.expr(letters("(zone - 1)")))).otherwise(F.col("name"))
    chained = (F.col("n") > 1) & (F.col("prev_n") > 1) & (F.col("phase") == F.col("prev_phase")) & (F.col("part") == F.col("prev_part"))
    sources = F.when(chained, F.array("zone")).otherwise(F.sequence(F.lit(1), F.col("prev_n")))
    links = acts.where("prev_code IS NOT NULL").withColumn("from", F.explode(sources))
    pred = name_of(F.col("prev_code"), F.col("prev_n"), F.col("from"))
    return (
        acts.select(F.col("project").alias("network"), "activity", label.alias("name"), (F.col("duration") + F.when(F.col("n") > 1, F.col("zone") - 1).otherwise(0)).cast("long").alias("duration"), "phase"),
        links.select(F.col("project").alias("network"), pred.alias("pred"), F.col("activity").alias("succ"), F.lit("FS").alias("kind"), F.lit(0).cast("long").alias("lag")),
    )
