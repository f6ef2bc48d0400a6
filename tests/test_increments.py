"""Labels by runs equal labels of one run, also after a new minimum, a failed run, and a station that falls silent."""

from datetime import datetime, timedelta

from dockflow.contract import default_contract
from dockflow.operators import ledger
from dockflow.plans import increments
from dockflow.session import scratch_dir
from dockflow.sinks import tables

RULES = default_contract().labels
START = datetime(2024, 1, 1)


def panel(spark, net):
    """Flows of (station, first hour, net flows by hour)."""
    rows = [
        (station, START + timedelta(hours=first + i), max(n, 0), max(-n, 0), 0, 0, n)
        for station, first, flows in net
        for i, n in enumerate(flows)
    ]
    return spark.createDataFrame(
        rows, "station_id int, hour_ts timestamp_ntz, arr long, dep long, reb_in long, reb_out long, net_flow long"
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


def both(spark, parts):
    root, whole = scratch_dir(spark), None
    for part in parts:
        flows = panel(spark, part)
        increments.add_hours(flows, root, RULES)
        whole = flows if whole is None else whole.unionByName(flows)
        assert rows(increments.read_labels(spark, root)) == rows(ledger.labels_from_flows(whole, RULES))
    return root


def test_runs_equal_one_run(spark):
    wave = [(i * 7) % 5 - 2 for i in range(400)]
    # Station 1 reaches a new minimum late, 2 is silent in the second run, 3 opens in it.
    root = both(spark, [
        [(1, 0, [1, 2, *wave]), (2, 0, [5, -1, *wave[:30]])],
        [(1, 402, [-9, -9, *wave[:200]]), (3, 402, wave[:50])],
        [(1, 604, wave[:20]), (2, 32, [-7, *wave[:20]])],
    ])
    moved = {r.station_id: r.moved for r in tables.published(spark, f"{root}/state").collect()}
    assert moved[2] > 0 and moved[3] == 0


def test_a_run_that_failed_is_not_read_and_may_be_repeated(spark):
    root = both(spark, [[(1, 0, [1, -2, 3])]])
    more = panel(spark, [(1, 3, [-4, 1])])
    state = tables.published(spark, f"{root}/state")
    before = rows(increments.read_labels(spark, root))
    tables.write_table(increments.extended(more, state, RULES), f"{root}/hours/run=2")
    assert rows(increments.read_labels(spark, root)) == before
    tables.write_manifest(spark, f"{root}/state", 2, "")
    assert rows(increments.read_labels(spark, root)) == before
    assert increments.add_hours(more, root, RULES) == 3
    assert increments.add_hours(more, root, RULES) == 4
    whole = panel(spark, [(1, 0, [1, -2, 3, -4, 1])])
    assert rows(increments.read_labels(spark, root)) == rows(ledger.labels_from_flows(whole, RULES))


def test_a_run_reads_no_older_hours(spark):
    root = both(spark, [[(1, 0, [1, -2, 3])]])
    plan = increments.extended(panel(spark, [(1, 3, [1])]), tables.published(spark, f"{root}/state"), RULES)
    assert f"{root}/hours" not in "".join(plan.inputFiles())


def test_no_hours(spark):
    root = both(spark, [[], [(1, 0, [1, -2, 3])], []])
    assert increments.read_labels(spark, root).count() == 3
