"""Rebuilt cells are compared by as many tasks as their number needs."""

from jostle.operators import events as E
from jostle.operators import reconcile as R
from jostle.plans import staging

CELL = "source_id long, horizon long, t long, f long, n long"


def tasks(df):
    """The numbers of tasks that exchanges fix."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(line.split("), REPARTITION_BY_NUM")[0].rsplit(", ", 1)[1]) for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]


def test_tasks_grow_with_the_cells(rows, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 10)
    cells = [(s, 9, t, 0, 1) for s in range(20) for t in range(5)]
    labels = rows("source_id long, label long", [(s, 1) for s in range(20)])
    stored = rows(CELL, [*cells[1:], cells[5]])  # one is missing, one is there twice
    found = R.rebuild_check(rows(CELL, cells), rows(CELL, cells), stored, labels, labels)
    assert tasks(found) == [30]
    assert [tuple(r) for r in found.collect()] == [("implementations_differ", 0), ("stored_cells_differ", 2), ("labels_differ", 0)]


def test_dealt_events_give_the_same_cells(rows, table, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 10)
    events = rows("source_id long, us long, unit long", [(s, 10 * k * k + s, k % 3) for s in range(4) for k in range(30)])
    bounds = E.event_bounds(events, 100)
    plain = table(E.bin_events(events, bounds, 100))
    dealt, oracle = E.bin_events(events, bounds, 100, cells=100), E.bin_events_oracle(events, 100, cells=100)
    assert tasks(dealt) == tasks(oracle) == [10] and table(dealt) == table(oracle) == plain
