"""Challenge metrics of few groups and of a breakdown against metrics of repeated rows."""

import random

from tickerloom.operators import challenge as ch
from workload import fixtures as fx


def rates(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        fold, regime = i % 3, rng.choice(["up", "down", None])
        flat = [0.2 + 0.1 * fold, 0.3 if regime == "up" else 0.4, rng.choice([0.1, 0.6]), rng.choice([0.1, 0.5, 0.6])]
        actual = float(rng.random() < 0.4) if rng.random() > 0.05 else None
        rows.append((rng.choice(["a", "b"]), fold, f"2020-01-{i % 28 + 1:02d}", f"S{i % 13}", regime, actual, rng.choice([rng.random(), 0.5]), *flat, rng.random() < 0.5, False, True))
    return spark.createDataFrame(
        rows, f"label string, fold long, date string, ticker string, regime string, actual double, {', '.join(c + ' double' for c in ch.COMPARATORS)}, "
        "regime_fallback boolean, momentum_fallback boolean, regime_momentum_fallback boolean"
    ).repartition(5)


def same(a, b, keys):
    x, y = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (a, b))
    assert set(x) == set(y) and x
    for k, row in x.items():
        for c, v in row.items():
            assert y[k][c] == v or abs(y[k][c] - v) < 1e-9, (k, c, v, y[k][c])


def test_few_groups_equal_the_general_path(spark):
    df = rates(spark)
    for by in ([], ["label"]):
        same(ch.comparator_metrics(df, ch.COMPARATORS, by), ch.comparator_metrics(df, ch.COMPARATORS, by, few=True), [*by, "comparator"])


def test_breakdown_equals_repeated_rows(spark):
    df, by = rates(spark), ["label", "breakdown", "segment"]
    same(ch.comparator_metrics(ch.scoped(df), ch.COMPARATORS, by), ch.breakdown_metrics(df, ch.COMPARATORS, ["label"]), [*by, "comparator"])


def test_labels_share_the_exchange_of_the_features(spark, sf):
    plan = fx.panel(spark, sf, fx.RATE_INPUTS).select(*fx.RATE_INPUTS)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Window" not in above and "Repartition" not in above
    assert "open" not in plan[plan.index("MapInArrow") :].split("\n")[0]
