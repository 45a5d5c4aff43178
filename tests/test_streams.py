"""The job machine and the audit trail: against an ordered fold, and over failures and restarts."""

import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest

from girder.streaming import machine, trail


def fold(events):
    """A plain reading of the rules: one active job a repository, stale after 45 seconds, flags of an hour."""
    jobs, out = {}, []
    for repo, at, seq, kind in sorted(events, key=lambda e: (e[1], e[2])):
        j = jobs.setdefault(repo, {"n": 0, "status": None, "created": None, "flag": None})
        on = j["status"] in ("QUEUED", "RUNNING")
        if kind == "CREATE":
            if on and (at - j["created"]).total_seconds() <= 45:
                said = "EXISTING"
            else:
                said = "REPLACED" if on else "CREATED"
                j.update(n=j["n"] + 1, status="QUEUED", created=at, flag=None)
        elif not on or (kind == "COMPLETED" and j["status"] == "QUEUED"):
            said = "REFUSED"
        elif kind == "CANCEL":
            said, j["flag"] = "FLAGGED", at
        elif kind == "RUNNING":
            stop = j["flag"] is not None and (at - j["flag"]).total_seconds() < 3600
            said, j["status"] = ("STOPPED", "CANCELLED") if stop else ("MOVED", "RUNNING")
        else:
            said, j["status"] = "MOVED", kind
        out.append((repo, seq, kind, said, j["n"], j["status"]))
    return sorted(out)


def some_events(seed, n=150):
    r, at, out = random.Random(seed), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for seq in range(n):
        at += timedelta(seconds=r.choice([0, 5, 20, 50, 1500]))
        out.append((r.randrange(6), at, seq, r.choice(["CREATE", "CREATE", "RUNNING", "RUNNING", "COMPLETED", "FAILED", "CANCEL"])))
    return out


def test_machine_equals_the_fold_over_batches_and_restarts(spark, tmp_path):
    rows = some_events(1)
    df = spark.createDataFrame(rows, machine.EVENTS)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    machine.arrive(df.where("seq < 90"), source, 3)
    first = machine.run(spark, source, out, state)
    assert sorted(map(tuple, first.collect())) == fold(rows[:90])
    machine.arrive(df.where("seq >= 90"), source, 2)  # a new run goes on from the state
    assert sorted(map(tuple, machine.run(spark, source, out, state).collect())) == fold(rows)
    assert sorted(map(tuple, machine.run(spark, source, out, state).collect())) == fold(rows)  # nothing new


def test_step_by_step():
    s, said = machine.step(machine.NEW, "RUNNING", 0)
    assert (s, said) == (machine.NEW, "REFUSED")
    s, said = machine.step(s, "CREATE", 0)
    assert said == "CREATED" and machine.step(s, "COMPLETED", 1) == (s, "REFUSED")
    assert machine.step(s, "CREATE", 45)[1] == "EXISTING" and machine.step(s, "CREATE", 46)[1] == "REPLACED"
    flagged, _ = machine.step(s, "CANCEL", 10)
    assert machine.step(flagged, "RUNNING", 3609)[1] == "STOPPED" and machine.step(flagged, "RUNNING", 3610)[1] == "MOVED"


def chain(rows):
    out = []
    for c in sorted({r[0] for r in rows}):
        prev = "0" * 64
        for _, turn, role, text in sorted(r for r in rows if r[0] == c):
            h = hashlib.sha256(f"{turn}|{role}|{text}|{prev}".encode()).hexdigest()
            out.append((c, turn, prev, h))
            prev = h
    return out


@pytest.mark.parametrize("where", ["events", "heads", "ledger"])
def test_trail_is_the_same_after_a_failure_in_any_place(spark, tmp_path, where):
    rows = [(c, t, "user", f"text {c} {t}") for c in range(5) for t in range(9) if (c + t) % 4]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    df = spark.createDataFrame(rows, trail.EVENTS)
    for k in range(3):  # files arrive one after the other
        df.where(f"turn div 3 = {k}").coalesce(1).write.mode("append").parquet(source)
    made, seen = trail.Trail(spark, str(tmp_path / "trail")), []

    def fails(step):
        seen.append(step)
        if seen.count(where) == 2 and step == where:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        made.follow(source, state, between=fails)
    assert made.events().count() < len(rows)
    made.follow(source, state)
    assert sorted(map(tuple, made.events().collect())) == chain(rows)
    heads = {c: (h, n) for c, h, n in made.heads().collect()}
    assert heads == {c: (max((x for x in chain(rows) if x[0] == c), key=lambda x: x[1])[3], len([r for r in rows if r[0] == c])) for c in range(5)}
    assert trail.broken(made.events()).count() == 0
    made.follow(source, state)
    assert made.events().count() == len(rows)


def test_a_changed_event_breaks_the_chain(spark):
    rows = chain([(1, t, "user", "x") for t in range(4)])
    rows[1] = (*rows[1][:3], "f" * 64)
    assert [r["turn"] for r in trail.broken(spark.createDataFrame(rows, trail.CHAINED)).collect()] == [2]
