"""Ball k-means against comparing with every centroid; fill-in-middle against slices of Python strings."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ball_kmeans, fill_in_middle, queries

SF = "/root/testdata/sf0.001"


# --- ball k-means -------------------------------------------------------------------------------


def lloyd(rows, dim, k, rounds, seed=2, scale=256):
    """The contract step by step: {(id, components): [(cluster, distance)]}."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i, nearest(v)[1], nearest(v)[0], centroids[nearest(v)[1]]) for i, v in kept)


def check_lloyd(spark, rows, dim=4, k=5, rounds=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("id", F.lit(0)).repartition(3)
    got = ball_kmeans.cluster(df, dim=dim, k=k, rounds=rounds).collect()
    want = lloyd(rows, dim, k, rounds)
    assert sorted((r.id, r.cluster, r.distance, r.centroid) for r in got) == want
    whole = sum(w[2] for w in want)
    assert all(r.inertia == whole and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)


def test_balls_match_lloyd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) / 4 + rng.integers(0, 3, 4)).tolist()) for i in range(400)]
    check_lloyd(spark, rows)
    check_lloyd(spark, [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)], k=12)  # many ties: lattice points


def test_balls_edges(spark):
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    same = [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(60)]  # equal vectors: clusters left empty keep their centroid
    check_lloyd(spark, same + bad + [(7, [0.5, -0.25, 0.0, 1.0]), (8, [3.0, 3.0, 3.0, 3.0])])
    check_lloyd(spark, [(1, [0.0, 0.0, 0.0, 0.1])] + bad)
    for rows in ([], bad):
        assert ball_kmeans.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=4).collect() == []
    with pytest.raises(Exception, match="squared distances"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e12, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>"), dim=4).collect()
    text = spark.createDataFrame([("b", [0.0, 1.0]), (None, [1.0, 0.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<float>")
    assert len(ball_kmeans.cluster(text, dim=2, k=3).collect()) == 3


def test_balls_leave_old_rounds_to_nobody(spark):
    before = {d for d in _tables(spark) if d.startswith("ball-")}
    ball_kmeans.cluster(spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id long, embedding array<double>"), dim=1, k=2).collect()
    assert len({d for d in _tables(spark) if d.startswith("ball-")} - before) == 1


def _tables(spark):
    root = f"{ball_kmeans.scratch(spark, 'x').rpartition('/')[0]}".removeprefix("file:")
    return os.listdir(root) if os.path.isdir(root) else []


def test_balls_compare_less_and_exactly():
    rng = np.random.default_rng(1)
    for span in (1000, ball_kmeans.MOST // 2):  # doubles, longs
        centroids = rng.integers(-span, span, (30, 16))
        x = centroids[rng.integers(0, 30, 3000)] + rng.integers(-span // 8, span // 8, (3000, 16))
        want = ball_kmeans.to_all(x, centroids)
        label = want[0].copy()
        label[:200] = rng.integers(0, 30, 200)  # any assignment may come from the last round
        new, best, _ = ball_kmeans.by_balls(x, label, centroids)
        assert (new == want[0]).all() and (best == want[1]).all()
        assert ball_kmeans.by_balls(x, want[0], centroids)[2] < len(x) * 8


# --- fill-in-middle -----------------------------------------------------------------------------


def middle(ident, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text, text)
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return (n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text)


def test_middle_matches_strings(spark):
    rng = np.random.default_rng(3)
    signs = list("ab <>PSM\n\r\t\0é́𝒳🤦‍♂ |\\QE$")
    rows = [(i, "".join(rng.choice(signs, rng.integers(0, 30)))) for i in range(600)]
    rows += [(None, None), (None, "ab"), (3, None), (4, ""), (4, "x"), (4, "x"), (5, "a<P>b"), (6, "<<S>>"), (7, "<M"), (8, "🤦" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("units", F.lit(1)).withColumn("id", F.lit("z")).withColumn("h1", F.lit(0))
    got = fill_in_middle.round_trip(df).collect()
    want = [(i, *middle(i, t)) for i, t in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.round_trip(df.limit(0)).collect() == []


def test_middle_options(spark):
    df = spark.createDataFrame([("k", "one two three")], "name string, body string")
    assert fill_in_middle.arranged(df, "name", "body", share=0).first().form == "plain"
    row = fill_in_middle.round_trip(df, "name", "body", share=100, suffix_first=100, sentinels=("[pre]", "[suf]", "[mid]")).first()
    assert row.form == "spm" and row.output.startswith("[suf]") and row.restored == "one two three"
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aXa", "q", "X")):
        with pytest.raises(ValueError):
            fill_in_middle.arranged(df, "name", "body", sentinels=bad)


def test_middle_stays_in_the_jvm(spark):
    plan = queries.op13_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
