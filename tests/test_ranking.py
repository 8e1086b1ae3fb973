"""As-of lookups against brute force, on keys that crowd into few buckets."""

import random

from strandloom.operators import ranking as R


def made(df):
    """Most rows that a join of the plan that ran has put out."""
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            plan.append(node.plan())
            continue
        metrics = node.metrics()
        if "Join" in name and metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return most


def test_asof_does_not_pair_probes_with_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60, 900), i) for i in range(700)]
    probes = [(rng.randrange(0, 1000), rng.choice("xy")) for _ in range(400)] + [(None, "z"), (5000, "x")]
    df = R.asof(spark.createDataFrame(probes, "probe long, tag string"), "probe", spark.createDataFrame([*rows, (None, 9999)], "k long, id long"), "k", "id", "found", width=256)
    got = df.collect()
    best = lambda q: max((x for x in rows if q is not None and x[0] <= q), default=(None, None))[1]
    assert df.columns == ["probe", "tag", "found"]
    assert sorted(map(tuple, got), key=repr) == sorted(((q, tag, best(q)) for q, tag in probes), key=repr)
    assert made(df) <= len(probes) + 10
