"""Networks: by task and by rounds, cycles, impacts against whole reruns, and generated breakdowns."""

import random

import pytest

from girder.operators import networks, schedule

ACTS = "network long, activity string, duration long"
EDGES = "network long, pred string, succ string, kind string, lag long"


def some_networks(seed, n=12, size=14):
    rng = random.Random(seed)
    acts, edges = [], []
    for network in range(n):
        names = [f"a{rng.randrange(1000):03d}-{i}" for i in range(rng.randint(1, size))]
        acts += [(network, a, rng.randint(0, 9)) for a in names]
        for j in range(len(names)):
            for i in range(j):
                if rng.random() < 0.25:
                    edges.append((network, names[i], names[j], rng.choice(["FS", "SS", "FF", "SF"]), rng.randint(-3, 4)))
        edges.append((network, "nobody", names[0], "FS", 0))
    return acts, edges


def both_ways(spark, acts, edges):
    return spark.createDataFrame(acts, ACTS).repartition(3), spark.createDataFrame(edges, EDGES).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_tasks_equal_rounds(spark, seed, monkeypatch):
    acts, edges = both_ways(spark, *some_networks(seed))
    by_task = sorted(map(tuple, networks.critical_path(acts, edges).collect()))
    assert by_task == sorted(map(tuple, schedule.critical_path(acts, edges).collect()))
    order = sorted(map(tuple, networks.ordered(acts, edges).collect()))
    monkeypatch.setattr(networks, "LARGE", 20)  # some networks by rounds, some in tasks
    assert by_task == sorted(map(tuple, networks.critical_path(acts, edges).collect()))
    assert order == sorted(map(tuple, networks.ordered(acts, edges).collect()))


@pytest.mark.parametrize("large", [400_000, 0])
def test_cycles_leave_the_rest_whole(spark, monkeypatch, large):
    monkeypatch.setattr(networks, "LARGE", large)
    acts = [(1, a, 1) for a in "abcdefg"] + [(2, a, 1) for a in "xyz"] + [(3, "s", 1), (3, "t", 1)]
    link = lambda n, p, s: (n, p, s, "FS", 0)
    edges = [link(1, *x) for x in ("ab", "bc", "cd", "db", "de", "fg", "?g", "gg")] + [link(2, "y", "x"), link(2, "z", "y"), link(2, "?", "y")] + [link(3, "s", "s")]
    got = {(r.network, r.activity): tuple(r)[2:] for r in networks.ordered(*both_ways(spark, acts, edges)).collect()}
    assert got == {
        (1, "a"): (0, 1, 0, None), (1, "b"): (None, None, 0, "cycle"), (1, "c"): (None, None, 0, "cycle"), (1, "d"): (None, None, 0, "cycle"), (1, "e"): (None, None, 0, "behind a cycle"),
        (1, "f"): (0, 2, 0, None), (1, "g"): (None, None, 1, "cycle"), (2, "z"): (0, 1, 0, None), (2, "y"): (1, 2, 1, None), (2, "x"): (2, 3, 0, None), (3, "s"): (None, None, 0, "cycle"), (3, "t"): (0, 1, 0, None),
    }
    with pytest.raises(Exception, match="cycle"):
        networks.critical_path(*both_ways(spark, acts, edges)).collect()


def test_impacts_equal_whole_reruns(spark):
    rng = random.Random(9)
    acts, edges = some_networks(9)
    events = [(n, f"e{k}", rng.choice([a for m, a, _ in acts if m == n] + ["nobody"]), rng.randint(-2, 6), k) for n in range(12) for k in range(rng.randint(0, 5))]
    told = networks.time_impact(*both_ways(spark, acts, edges), spark.createDataFrame([*events, (99, "e", "a", 1, 1)], "network long, event string, activity string, delay long, seq long"))
    got = {(r.network, r.event): r for r in told.collect()}
    assert len(got) == len(events)
    durations = {(n, a): d for n, a, d in acts}

    def finishes():
        rows = networks.critical_path(*both_ways(spark, [(n, a, d) for (n, a), d in durations.items()], edges)).collect()
        out, starts = {}, {}
        for r in rows:
            out[r.network] = max(out.get(r.network, 0), r.early_finish)
            starts[r.network, r.activity] = r.early_start
        return out, starts

    before, starts = finishes()
    for k in range(5):
        for n, _, a, delay, _ in (e for e in events if e[4] == k):
            if (n, a) in durations:
                durations[n, a] += delay
        after, now = finishes()
        for n, e, *_ in (x for x in events if x[4] == k):
            moved = sum(starts[x] != now[x] for x in now if x[0] == n)
            assert (got[n, e].finish_before, got[n, e].finish_after, got[n, e].n_moved) == (before[n], after[n], moved)
        before, starts = after, now


def test_breakdown_is_a_network(spark):
    rows = [("p", k, "1" if k < 5 else "2", str(k // 3), f"act {k}", 3, k % 4 != 0) for k in range(9)] + [("q", 0, "1", "1", "only", 2, False)]
    template = spark.createDataFrame(rows, "project string, place int, phase string, part string, name string, duration int, zoneable boolean")
    for target, zones in ((5, 1), (9, 1), (10, 2), (15, 2), (16, 3), (10_000, 80)):
        targets = spark.createDataFrame([("p", target), ("q", target)], "project string, target int")
        assert {r.project: r.zones for r in networks.zone_counts(template, targets).collect()} == {"p": zones, "q": 1 if target <= 1 else 80}
    acts, links = networks.work_breakdown(template, spark.createDataFrame([("p", 16), ("q", 1)], "project string, target int"))
    dated = {r.activity: r for r in networks.critical_path(acts, links).where("network = 'p'").collect()}
    assert len(dated) == 3 + 6 * 3 and {r.name for r in acts.collect()} >= {"act 1 - Hall A", "act 1 - Hall C", "act 4", "only"}
    # The last zone is critical; its chain is days longer than the others'.
    assert all(dated[a].is_critical == a.endswith(".3") for a in dated if a.count(".") == 3)
    assert not networks.ordered(acts, links).where("problem IS NOT NULL OR n_unknown > 0").count()


@pytest.mark.parametrize("together", [10, 50_000])
def test_networks_together_equal_one_by_one(spark, monkeypatch, together):
    """Dates and order of many networks as arrays against one network at a time; parts have a bounded number of rows."""
    acts, edges = both_ways(spark, *some_networks(7, n=60))
    loops = edges.unionByName(edges.where("network % 5 = 1 AND lag = 2").selectExpr("network", "succ AS pred", "pred AS succ", "kind", "lag"))
    monkeypatch.setattr(networks, "TOGETHER", together)
    told = lambda: (sorted(map(tuple, networks.critical_path(acts, edges).collect())), sorted(map(tuple, networks.ordered(acts, loops).collect()), key=str))
    many = told()
    monkeypatch.setattr(networks, "SMALL", 0)
    assert many == told() and {r[5] for r in many[1]} == {None, "cycle", "behind a cycle"}
    monkeypatch.setattr(networks, "PART_ROWS", 20)
    rows = acts.count() + edges.count()
    assert networks.critical_path(acts, edges).rdd.getNumPartitions() == -(-rows // 20)
