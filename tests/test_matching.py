"""Caliper matching against a walk over two sorted lists and against exhaustive matching."""

import random
from itertools import permutations

import pytest

from tallyspark.operators import matching


def brute(left, right, caliper):
    left, right = (sorted((s, i) for i, s in side if s is not None) for side in (left, right))
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i][0] - right[j][0] > caliper:
            j += 1
        elif right[j][0] - left[i][0] > caliper:
            i += 1
        else:
            out.append((left[i][1], right[j][1], left[i][0], right[j][0]))
            i, j = i + 1, j + 1
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "grid", "caliper", "parts"), [(1, 60, 20, 0.05, 4), (2, 80, 1000, 0.004, 9), (3, 50, 3, 0.0, 3), (4, 90, 200, 0.3, 7), (5, 40, 10, 2.0, 5)])
def test_pairs(spark, seed, n, grid, caliper, parts):
    r = random.Random(seed)
    side = lambda m: [(i, r.randrange(grid) / grid if r.random() < 0.95 else None) for i in range(m)]
    left, right = side(n), side(n - 7)
    make = lambda rows: spark.createDataFrame(rows, "id long, score double")
    got = sorted(map(tuple, matching.caliper_pairs(make(left), make(right), caliper, parts).collect()))
    assert got == brute(left, right, caliper)


def test_as_many_pairs_as_any_matching():
    r = random.Random(9)
    for _ in range(200):
        left, right = ([(i, r.randrange(8) / 8) for i in range(r.randint(0, 5))] for _ in range(2))
        small, large = sorted((left, right), key=len)
        most = max(sum(abs(a[1] - b[1]) <= 0.13 for a, b in zip(small, p)) for p in permutations(large, len(small)))
        counts = {}
        for k, rows in enumerate((left, right)):
            for _, s in rows:
                counts.setdefault(s, [0, 0])[k] += 1
        matched, _ = matching.walk(sorted((s, a, b) for s, (a, b) in counts.items()), [], 0.13)
        assert sum(n for (_, side), n in matched.items() if side == 0) == most == len(brute(left, right, 0.13))


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, score double")
    assert matching.caliper_pairs(none, none, 0.1).count() == 0
    assert matching.caliper_pairs(spark.createDataFrame([(1, 0.5)], "id long, score double"), none, 0.1).count() == 0


def test_base_filter_reaches_the_scan(spark):
    from tallyspark.plans import catalog

    for name in ("j_difficulty", "ag_difficulty"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        scans = plan.split("PushedFilters: [")[1:]
        assert scans and all("l_linestatus" in x.split("]")[0] and "l_returnflag" in x.split("]")[0] for x in scans), name
