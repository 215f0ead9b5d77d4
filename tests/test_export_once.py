"""Report tables that are exported twice are computed once."""

from __spark_entry__ import queries


def test_tables_used_twice_are_staged(spark, rows, monkeypatch, tmp_path):
    queries()  # the catalog is loaded in its own order
    from jostle.catalog import files

    tiny = lambda s, f: rows("family string, test string, mean double, ci_low double, ci_high double, q_value double", [("transition_vs_preserved", "a", 1.0, 0.0, 2.0, 0.5)])
    for q in files.REPORTS.values():
        monkeypatch.setitem(files.QUERIES, q, tiny)
    seen, export = {}, files.S.export_tables
    monkeypatch.setattr(files.S, "export_tables", lambda tables, out: seen.update(tables) or export({k: seen[k] for k in ("table_08_restoration", "figure_04_contrasts")}, out))
    files.QUERIES["export_report_tables"](spark, str(tmp_path)).collect()
    assert set(seen) == set(files.REPORTS)
    assert seen["table_08_restoration"] is seen["figure_04_restoration"]
    assert seen["table_08_restoration"]._staged_table and seen["table_06_contrasts"]._staged_table


def test_a_table_is_written_before_the_next_is_built(spark, rows, monkeypatch, tmp_path):
    queries()
    from jostle.catalog import files

    done, write = [], files.S.export_tables
    one = rows("family string, test string, mean double, ci_low double, ci_high double, q_value double", [("transition_vs_preserved", "a", 1.0, 0.0, 2.0, 0.5)])
    monkeypatch.setattr(files, "REPORTS", {"table_02_metrics": "classification_metrics", "table_03_outcomes": "outcome_totals"})
    for q in files.REPORTS.values():
        monkeypatch.setitem(files.QUERIES, q, lambda s, f, q=q: done.append(("built", q)) or one)

    class Told(dict):
        pass

    def told(tables, out):
        for name, df in tables.items():
            done.append(("written", files.REPORTS[name]))
        return write(Told({"table_02_metrics": one, "table_03_outcomes": one}), out)

    monkeypatch.setattr(files.S, "export_tables", told)
    got = files.QUERIES["export_report_tables"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "table_02_metrics"), (1, "table_03_outcomes")]
    assert done == [(what, q) for q in files.REPORTS.values() for what in ("built", "written")]
