"""Architecture rules at their thresholds, cycles, incremental closure, simulation, summaries and budgets, each against a plain version."""

import random
from collections import defaultdict
from itertools import count

import pytest

from girder.operators import graph, incremental, project, simulation, summaries
from girder.plans.operator import REGISTRY


def run(spark, op, **frames):
    return sorted(tuple(r) for r in REGISTRY[op](spark, **frames).collect())


def modules(spark, locs):
    return spark.createDataFrame([(i, f"m{i}", f"src/m{i}.py", 0, loc) for i, loc in locs.items()], "id long, name string, path string, component long, loc long")


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, tgt long, n long")


def ab(spark, pairs):
    return spark.createDataFrame(list(pairs), "a long, b long")


def test_arc_002_fires_above_ten(spark):
    e = edges(spark, [(1, k) for k in range(10, 21)] + [(2, k) for k in range(10, 20)])
    assert run(spark, "arc_002_coupling", edges=e, modules=modules(spark, {k: 1 for k in range(30)})) == [(1, 11, "MEDIUM")]


def test_arc_003_both_conditions_and_just_below(spark):
    out = lambda m, n: [(m, 100 + k) for k in range(n)]
    into = lambda m, n: [(200 + k, m) for k in range(n)]
    e = edges(spark, out(1, 9) + into(1, 6) + out(2, 8) + into(2, 6) + out(3, 9) + into(3, 5) + out(4, 11) + out(5, 10) + out(6, 9) + into(6, 6) + out(7, 11))
    locs = {k: 1 for k in range(300)} | {1: 501, 2: 501, 3: 501, 4: 801, 5: 801, 6: 500, 7: 800}
    assert [(r[0], r[-1]) for r in run(spark, "arc_003_god_module", edges=e, modules=modules(spark, locs))] == [(1, "condition_1"), (4, "condition_2")]


def components(spark, pairs):
    nodes = sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, tgt long, weight long"), spark.createDataFrame([(c, c) for c in nodes], "id long, component long")


def test_arc_007_stable_on_unstable(spark):
    """core (1): Ca 7, Ce 3, I .3; experimental (2): Ca 3, Ce 7, I .7. One import less above or below ends it."""
    into = [(100 + k, 1) for k in range(7)]
    pairs = into + [(1, 2), (1, 11), (1, 12)] + [(20, 2), (21, 2)] + [(2, 30 + k) for k in range(7)]
    fires = lambda p: [r[:2] for r in run(spark, "arc_007_sdp_violation", **dict(zip(("component_edges", "modules"), components(spark, p), strict=True)))]
    assert fires(pairs) == [(1, 2)]
    assert fires(pairs[1:]) == [] and fires(pairs[:-1]) == []
    assert fires([(9, 1), (1, 2), (2, 3), (2, 4), (2, 5)]) == []  # one dependent only


def test_arc_006_needs_a_cycle_of_components(spark):
    got = graph.component_cycles(ab(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]))
    assert [tuple(r) for r in got.collect()] == [(1, 3)]
    assert graph.component_cycles(ab(spark, [(1, 2), (2, 3)])).count() == 0


def test_arc_009_gates(spark):
    star = [(k, 9) for k in (1, 2, 3, 4)] + [(9, k) for k in (5, 6, 7, 8)]
    files = lambda many: spark.createDataFrame([(c,) for c in range(1, 10) for _ in range(2 if c == 9 and many else 1)], "component long")
    hub = 16 / (8 * 7)  # ways through 9 of ordered pairs
    assert hub < graph.BETWEENNESS and graph.central_components(ab(spark, star), files(True)).count() == 0
    both = [(k, 9) for k in range(1, 9)] + [(9, k) for k in range(1, 9)]
    assert [tuple(r) for r in graph.central_components(ab(spark, both), files(True)).collect()] == [(9, 1.0, 2)]
    assert graph.central_components(ab(spark, both), files(False)).count() == 0  # one file
    few = [(1, 9), (9, 1), (2, 9), (9, 2), (3, 9), (9, 3)]
    assert graph.central_components(ab(spark, few), spark.createDataFrame([(c,) for c in (1, 2, 3, 9, 9)], "component long")).count() == 0  # four components


def plain_cycles(pairs):
    to, out = defaultdict(set), set()
    for a, b in pairs:
        to[a].add(b)

    def go(path):
        for n in to[path[-1]]:
            if n == path[0]:
                out.add(tuple(path))
            elif n > path[0] and n not in path:
                go([*path, n])

    for a in list(to):
        go([a])
    return {c for c in out if len(c) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_simple_cycles(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(11), r.randrange(11)) for _ in range(26)}
    got = {tuple(map(int, x["cycle"].split(">"))) for x in graph.simple_cycles(ab(spark, pairs)).collect()}
    assert got == plain_cycles(pairs)


def test_work_follows_the_cycles_of_a_layered_graph(spark, monkeypatch):
    """14 layers of three nodes have 3**13 ways from top to bottom and no way back but one edge from the second layer: no path goes further down."""
    layers = [[10 * k + i for i in range(3)] for k in range(14)]
    pairs = [(a, b) for one, two in zip(layers, layers[1:], strict=False) for a in one for b in two] + [(10, 0)]
    rows = []
    save = graph.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name.startswith("paths-"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(graph.Scratch, "save", counted)
    assert [x["cycle"] for x in graph.simple_cycles(ab(spark, pairs)).collect()] == ["0>10"]
    assert sum(rows) <= 2


def closure(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("seed", range(3))
def test_incremental_closure(spark, seed):
    r = random.Random(seed)
    old = {(r.randrange(14), r.randrange(14)) for _ in range(18)}
    gone = set(r.sample(sorted(old), 4))
    come = {(r.randrange(16), r.randrange(16)) for _ in range(4)} | {r.choice(sorted(old))}
    new = (old - gone) | come
    lost, gained, _ = incremental.changes(ab(spark, old), ab(spark, closure(old)), ab(spark, new - old), ab(spark, old - new))
    want = closure(new)
    assert {tuple(x) for x in lost.collect()} == closure(old) - want and {tuple(x) for x in gained.collect()} == want - closure(old)
    assert {tuple(x) for x in incremental.applied(ab(spark, closure(old)), lost, gained).collect()} == want


def test_incremental_closure_touches_what_changes(spark):
    chains = {(100 * c + k, 100 * c + k + 1) for c in range(40) for k in range(8)}
    all_pairs = closure(chains)
    lost, gained, touched = incremental.changes(ab(spark, chains), ab(spark, all_pairs), ab(spark, [(8, 9)]), ab(spark, [(107, 108)]))
    assert lost.count() == 8 and gained.count() == 9 and sum(touched.values()) <= 20 < len(all_pairs) / 50


def plain_simulation(pairs, mutations, affected):
    after = set(pairs)
    for action, a, b in mutations:
        if action == "REMOVE":
            after.discard((a, b))
    for action, a, b in mutations:
        if action == "ADD":
            after.add((a, b))
    before, then = plain_cycles(pairs), plain_cycles(after)

    def instability(n):
        ca, ce = len({a for a, b in after if b == n}), len({b for a, b in after if a == n})
        return ce / (ca + ce) if ca + ce else 0.0

    hits = lambda cs: [c for c in cs if set(c) & affected]
    gone = (bool(hits(before)) and not hits(then)) or (bool(before) and len(then) < len(before))
    sdp = sum(instability(a) < instability(b) for action, a, b in set(mutations) if action == "ADD" and (a, b) not in pairs)
    fine = not (then - before) and (gone or (not before and not then))
    return (len(before), len(then), len(then - before), gone, sdp, "VERIFIED_SIMULATION" if fine else "UNVERIFIED_SIMULATION")


def test_simulation_of_many_proposals(spark):
    r = random.Random(4)
    pairs = {(a, b) for a, b in ((r.randrange(10), r.randrange(10)) for _ in range(20)) if a != b}
    proposals = {p: [(("REMOVE", *r.choice(sorted(pairs))) if r.random() < 0.6 else ("ADD", *r.sample(range(12), 2))) for _ in range(r.randint(1, 4))] for p in range(12)}
    proposals[20] = [("REMOVE", 55, 56)]
    rows = [(p, *m) for p, ms in proposals.items() for m in ms]
    got = {x["p"]: tuple(x)[1:] for x in simulation.simulate(ab(spark, pairs), spark.createDataFrame(rows, "p long, action string, a long, b long")).collect()}
    assert got == {p: plain_simulation(pairs, ms, {x for _, a, b in ms for x in (a, b)}) for p, ms in proposals.items()}


def test_simulation_without_cycles(spark):
    got = simulation.simulate(ab(spark, [(1, 2), (2, 3)]), spark.createDataFrame([(1, "ADD", 1, 3), (2, "ADD", 3, 1)], "p long, action string, a long, b long")).collect()
    assert {x["p"]: (x["new_cycles"], x["status"]) for x in got} == {1: (0, "VERIFIED_SIMULATION"), 2: (1, "UNVERIFIED_SIMULATION")}


def test_simulation_stays_within_the_components_of_its_added_edges(spark, monkeypatch):
    """Nodes in a chain lead to each beginning of an added edge, and others lead away from its end; none of them is on a cycle, so none is walked."""
    r = random.Random(7)
    near = {(a, b) for a, b in ((r.randrange(6), r.randrange(6)) for _ in range(11)) if a != b}
    pairs = near | {(100 + i, 101 + i) for i in range(5)} | {(105, x) for x in range(6)} | {(x, 200) for x in range(6)} | {(200, 201)}
    proposals = {p: [("ADD", *r.sample(range(6), 2)) for _ in range(2)] + [("REMOVE", *r.choice(sorted(near)))] for p in range(3)}
    proposals[9] = [("ADD", 5, 104), ("ADD", 104, 201), ("REMOVE", 100, 101)]
    rows = [(p, *m) for p, ms in proposals.items() for m in ms]
    walked, save = [], simulation.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name.split("-")[0] in ("back", "ends", "paths") and "p" in out.columns:
            walked.extend(x["x"] for x in out.select("x").collect())
        return out

    monkeypatch.setattr(simulation.Scratch, "save", counted)
    got = {x["p"]: tuple(x)[1:] for x in simulation.simulate(ab(spark, pairs), spark.createDataFrame(rows, "p long, action string, a long, b long")).collect()}
    assert got == {p: plain_simulation(pairs, ms, {x for _, a, b in ms for x in (a, b)}) for p, ms in proposals.items()}
    # proposal 9 leads from the others' component to the last two nodes of the chain
    assert 104 in walked and set(walked) <= {*range(6), 104, 105}


@pytest.mark.parametrize("seed", range(2))
def test_summaries_against_a_plain_fixpoint(spark, seed):
    """On a cyclic call graph, with sanitised and returned calls."""
    r = random.Random(seed)
    calls = {(r.randrange(12), r.randrange(2), r.randrange(12), r.randrange(2)): (r.choice([0, 0, 1, 6, 15]), r.random() < 0.4) for _ in range(45)}
    own = {(r.randrange(12), r.randrange(2)): (r.choice([0, 1, 2, 12]), r.choice([0, 15, 5])) for _ in range(7)}
    sources = [(r.randrange(12), r.randrange(12), r.randrange(2), r.choice([0, 1, 8])) for _ in range(12)]
    mask = {k: s | rt << 4 for k, (s, rt) in own.items() if s | rt}
    depth = {(f, p, b): (0, f) for (f, p), (s, _) in own.items() for b in (1, 2, 4, 8) if s & b}
    for k in count(1):
        new, ways = dict(mask), {}
        for (cf, cp, tf, tp), (clean, returned) in calls.items():
            keep = 15 & ~clean
            if got := mask.get((tf, tp), 0) & (keep | (keep << 4 if returned else 0)):
                new[cf, cp] = new.get((cf, cp), 0) | got
            for b in (1, 2, 4, 8):
                if keep & b and depth.get((tf, tp, b), (None,))[0] == k - 1 and (cf, cp, b) not in depth:
                    ways[cf, cp, b] = min(ways.get((cf, cp, b), (k, 99)), (k, depth[tf, tp, b][1]))
        depth |= ways
        if new == mask:
            break
        mask = new
    cf = spark.createDataFrame([(*k, *v) for k, v in calls.items()], "caller long, from_param int, callee long, to_param int, clean int, returned boolean")
    ow = spark.createDataFrame([(*k, *v) for k, v in own.items()], "fn long, param int, sinks int, returns int")
    got, found = summaries.summaries(cf, ow)
    assert {(x["fn"], x["param"]): x["mask"] for x in got.collect()} == mask
    rows = found.collect()
    assert {(x["fn"], x["param"], x["bit"]): (x["depth"], x["sink"]) for x in rows} == depth and len(rows) == len(depth)
    by = {(x["fn"], x["param"], x["bit"]): x for x in rows}
    for x in rows:  # back pointers lead a call nearer each
        if x["depth"]:
            assert by[x["next_fn"], x["next_param"], x["bit"]]["depth"] == x["depth"] - 1
    want = {}
    for f, c, p, clean in sources:
        for b in (1, 2, 4, 8):
            if not clean & b and (c, p, b) in depth and depth[c, p, b][0] < summaries.MOST_CALLS:
                d, s = depth[c, p, b]
                want[f, c, b] = min(want.get((f, c, b), (9, 99)), (d + 1, s))
    _, near = summaries.summaries(cf, ow, summaries.MOST_CALLS - 1)
    hits = summaries.findings_across(spark.createDataFrame(sources, "fn long, callee long, to_param int, clean int"), near).collect()
    names = dict(zip((1, 2, 4, 8), summaries.CATEGORIES, strict=True))
    assert {(x["source_fn"], x["callee"], x["category"]): (x["depth"], x["sink_fn"]) for x in hits} == {(f, c, names[b]): v for (f, c, b), v in want.items()}


def test_budgets_against_a_sequential_scan(spark):
    r = random.Random(3)
    fns = [(f, f % 5, r.randrange(40)) for f in range(100)]
    calls = [(r.randrange(100), r.randrange(100), 0, k % 2) for k in range(400)]
    paths = [(r.randrange(100), k, "SQL") for k in range(90)]
    limits = (12, 50, 30, 7)
    files, kept, beyond = defaultdict(list), {}, {}
    for f, file, line in sorted(fns, key=lambda x: (x[1], x[2], x[0])):
        files[file].append(f)
    first = [f for file in sorted(files) for f in files[file][: limits[0]]]
    good = set(first[: limits[1]])
    c, p = [x for x in calls if {x[0], x[1]} <= good], [x for x in paths if x[0] in good]
    want = {("functions of a file", k): (min(len(v), limits[0]), max(0, len(v) - limits[0])) for k, v in files.items()}
    for name, n, most in (("functions", len(first), limits[1]), ("calls", len(c), limits[2]), ("paths", len(p), limits[3])):
        want[name, None] = (min(n, most), max(0, n - most))
    got = project.budgets(
        spark.createDataFrame(fns, "fn long, file_id int, line_start int"),
        spark.createDataFrame(calls, "caller long, callee long, from_param int, to_param int"),
        spark.createDataFrame(paths, "source_fn long, callee long, category string"),
        limits,
    )
    assert {(x["budget"], x["file_id"]): (x["kept"], x["beyond"]) for x in got.collect()} == want
