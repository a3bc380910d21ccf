import numpy as np

from silkloom.llm import ann


def brute(vectors, ids, q, k=20):
    score = {}
    for i, v in zip(ids, vectors):
        if i != ids[q]:
            score[i] = max(score.get(i, -np.inf), float((np.asarray(v, float) * np.asarray(vectors[q], float)).sum()))
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, bucket string")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype("f4")
    x[300:700] = x[300] + 0.01 * rng.standard_normal((400, 16)).astype("f4")
    x[800:900] = x[800]
    ids = list(range(1500))
    got = {}
    for r in ann.search(frame(spark, [(i, v.tolist(), 0, "x") for i, v in zip(ids, x)]), lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        want, found = brute(x, ids, q), sorted(found)
        assert [r for r, *_ in found] == list(range(1, 21))
        assert found == [(n + 1, i, s) for n, (i, s) in enumerate(sorted([(i, s) for _, i, s in found], key=lambda t: (-t[1], t[0])))]
        exact = {i: float((x[i].astype(float) * x[q].astype(float)).sum()) for _, i, _ in found}
        assert all(abs(exact[i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for i, _ in want} & {i for _, i, _ in found}) / 20
    assert hits / len(got) >= 0.9
    assert [i for _, i, _ in sorted(got[800])] == [i for i, _ in brute(x, ids, 800)]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (20, [0.0, 2.0], 1, "x"), (1, None, 1, "x"), (2, [0.0, 0.0], 1, "x"), (3, [float("nan"), 1.0], 1, "x"), (4, [None, 1.0], 1, "x"), (5, [float("inf"), 1.0], 1, "x"), (6, [3.0, 4.0], None, None), (None, [1.0, 1.0], 1, "x"), (7, [1.0, 1.0, 1.0], 1, "x"), (8, [], 1, "x"), (6, [3.0, 4.0], 1, "x")]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame(spark, rows), lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 6, 3.0), (0, 2, 20, 0.0), (20, 1, 6, 8.0), (20, 2, 0, 0.0)]
    assert ann.search(frame(spark, []), lambda i: i % 20 == 0).count() == 0
    assert ann.search(frame(spark, [(1, [1.0], 1, "x")]), lambda i: i % 20 == 0).count() == 0


def test_repeated_ids(spark):
    rows = [(1, [1.0, n / 100], 0, "x") for n in range(60)] + [(i, [0.5, i / 100], 0, "x") for i in range(2, 40) if i != 20] + [(0, [1.0, 1.0], 0, "x")] * 3
    got = [(r["rank"], r.vec_id) for r in sorted(ann.search(frame(spark, rows), lambda i: i % 20 == 0).collect())]
    assert got == [(1, 1)] + [(n + 2, i) for n, i in enumerate([i for i in range(39, 1, -1) if i != 20][:19])]


def test_recall_on_embeddings(spark):
    """The registered query on the whole table against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id is not null").select("vec_id", "embedding").collect()
    rows = [r for r in rows if r.embedding and any(r.embedding) and all(c is not None and np.isfinite(c) for c in r.embedding)]
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    got = {}
    for r in ann.op6_multiprobe_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len({i for i, _ in brute(x, ids, q)} & got[ids[q]]) / 20 for q in range(len(ids)) if ids[q] % 20 == 0]
    assert len(hits) == len(got) and np.mean(hits) >= 0.9
