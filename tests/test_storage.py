"""Tables that a step of a longer job leaves behind."""

from pathlib import Path

from tickerloom.plans.storage import checkpoint_dir, passing, settle, stored


def tables(spark):
    return {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).glob("table-*")}


def test_only_settled_rows_outlive_a_step(spark):
    before = tables(spark)
    kept = stored(spark.range(7))
    with passing(spark):
        inner = stored(spark.range(100))
        assert len(tables(spark) - before) == 2
        total = settle(inner.groupBy().count())
    assert len(tables(spark) - before) == 1
    assert total.first()[0] == 100 and kept.count() == 7


def test_evidence_parts_leave_no_tables(spark, monkeypatch):
    from workload import q_models as qm

    before, open_at_once = tables(spark), []

    def part(s, sf):
        open_at_once.append(len(tables(spark) - before))
        return stored(spark.createDataFrame([("Weak",), ("weak",), (None,)], "classification string"))

    for names in qm.EVIDENCE.values():
        for name in names:
            monkeypatch.setitem(qm.QUERIES, name, part)
    rows = {r.area: r.latest_classification for r in qm.evidence_rollup(spark, "").collect()}
    assert set(open_at_once) == {0} and tables(spark) == before
    assert all(rows[a] == "weak" for a in qm.EVIDENCE)
