"""N-grams of many rows at a time."""

import random
from collections import Counter

import numpy as np

from cuelake.operators import translation as T


def test_counts_of_ngrams_of_many_rows(spark):
    """Many rows counted together, with texts of every odd kind, against counters; one Arrow UDF and no shuffle."""
    r = random.Random(2)
    hyp = [[r.randrange(-3, 4) for _ in range(r.choice([0, 1, 3, 4, 60]))] for _ in range(80)]
    ref = [r.choice([h, h[::-1], h[1:], [], h + h]) for h in hyp]
    sides = [(np.array([x for t in s for x in t], np.int64), np.array([len(t) for t in s])) for s in (hyp, ref)]
    got = T._counted(sides, 4)
    for k, (h, f) in enumerate(zip(hyp, ref)):
        grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        want = [sum((grams(h, n) & grams(f, n)).values()) / max(1, len(h) - n + 1) for n in range(1, 5)]
        both = 2.0 * len(set(h) & set(f)) / max(1, len(set(h)) + len(set(f)))
        assert [x[k] for x in got] == [len(h), len(f), *want, both]
    assert [len(x) for x in T._counted([(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2, 4)] == [1] * 7
    rows = [(" ".join(map(str, h)), " ".join(map(str, f))) for h, f in zip(hyp, ref)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "hyp string, ref string").coalesce(1)
    out = [tuple(x["g"]) for x in df.select(T.ngram_precisions().alias("g")).collect()]
    assert len(out) == 82 and out[-2:] == [(0, 1, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    plan = df.select(T.ngram_precisions().alias("g"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan.replace("RoundRobin", "")
