"""Connected components: right on long chains and hot nodes, and few stages, as each costs memory of the driver."""
import random

from tideline.llm.graph import components


def brute(edges):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    return {x: root(x) for x in least}


def graph():
    rng = random.Random(3)
    chain = list(range(1000, 1200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:]))
    edges += [(5, x) for x in range(5000, 5400)] + [(9999, x) for x in range(7000, 7300)]
    edges += [(rng.randrange(20_000, 21_000), rng.randrange(20_000, 21_000)) for _ in range(700)]
    return edges + edges[:100] + [(b, a) for a, b in edges[100:200]] + [(1, 1), (-7, 5), (None, 3), (4, None)]


def run(spark, rows):
    return components(spark.createDataFrame(rows, "a bigint, b bigint"))


def test_components_are_the_smallest_reachable(spark):
    rows = graph()
    got = [tuple(r) for r in run(spark, rows).collect()]
    assert len(got) == len({n for n, _ in got})
    assert dict(got) == brute([e for e in rows if None not in e])
    assert run(spark, [(1, 1)]).collect() == run(spark, []).collect() == []


def test_a_round_has_few_stages(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "")
    run(spark, [(5, x) for x in range(10, 500)]).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = tracker.getJobIdsForGroup("components")
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 20, (len(jobs), len(stages))
