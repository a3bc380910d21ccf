import numpy as np
import xxhash

from silkloom.llm import cotrain

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.filter("doc_id % 3 = 0").collect()}
    model = cotrain.fit(docs, labels.filter("doc_id % 3 <> 0"))
    got = [(r.kept, held[r.doc_id] == 1) for r in cotrain.score(docs, model).select("row.doc_id", "kept").collect() if r.doc_id in held]
    assert np.mean([a == b for a, b in got]) > 0.93
    again = cotrain.fit(docs, labels.filter("doc_id % 3 <> 0"))
    assert np.allclose(model.text.w, again.text.w)


def test_edges(spark, make, edge_rows):
    docs = make(edge_rows, clash=True)
    for rows in ([], [(5, 1, 0)], [(5, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (77, 1, 0)]):
        out = cotrain.score(docs, cotrain.fit(docs, spark.createDataFrame(rows, LABELS))).collect()
        assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 for r in out)
    empty = make([])
    assert cotrain.score(empty, cotrain.fit(empty, spark.createDataFrame([], LABELS))).count() == 0


def test_confident_rows_are_those_with_the_smallest_hashes(spark, make, monkeypatch):
    """Pseudo-labels against a brute-force choice; repeated and null ids, and ids above 2**53."""
    good, bad = "a plain sentence with many words in it.", "$$$ 999 ### BUY NOW"
    rows = [(10_000 + i, (good if i % 2 else bad) + f" {i}") for i in range(300)]
    rows += [(1 << 60, good), ((1 << 60) + 1, bad), (1 << 60, good), (None, good), (5, None)]
    docs = make(rows)
    labels = spark.createDataFrame([(10_000 + i, i % 2, 0) for i in range(80)], LABELS)
    monkeypatch.setattr(cotrain, "GIVEN", 20)
    feats = cotrain.features(docs)
    model = cotrain.fit(docs, labels, rounds=0)
    used = [10_000 + i for i in range(80)]
    got = {(r.view, r.y, r.doc_id) for r in cotrain._confident(feats, model, used, 3).collect()}
    want = {}
    views = cotrain.Views()
    for ident, text in dict(rows).items():
        if ident is None or ident in used:
            continue
        p_text, p_meta, _ = model.scores([views.text(text)], [views.meta("a", "en", None if text is None else len(text))])
        for view, p in (("meta", p_text[0]), ("text", p_meta[0])):
            if max(p, 1 - p) >= cotrain.CONFIDENT:
                want.setdefault((view, float(p > 0.5)), []).append((xxhash.xxh64_intdigest(str(ident), 3) >> 1, ident))
    assert want and got == {(*key, i) for key, found in want.items() for _, i in sorted(found)[:20]}


def test_scores_equal_a_plain_version(make, spark):
    rows = [(i, " ".join(["word"] * (i % 7)) + "." * (i % 3), "ab"[i % 2]) for i in range(120)]
    docs, labels = make(rows), spark.createDataFrame([(i, int(i % 7 > 2), 0) for i in range(60)], LABELS)
    model, views = cotrain.fit(docs, labels), cotrain.Views()
    for r in cotrain.score(docs, model).collect():
        t, m = views.text(r.row.text), views.meta(r.row.source, "en", r.row.n_chars)
        z = [float(sum(w[i] * float(v) for i, v in zip(at, val)) + b) for w, b, (at, val) in ((model.text.w, model.text.b, t), (model.meta.w, model.meta.b, m))]
        zt, zm = z[0] * model.of_text[0] + model.of_text[1], z[1] * model.of_meta[0] + model.of_meta[1]
        whole = 1 / (1 + np.exp(-(zt * model.both[0] + zm * model.both[1] + model.both[2])))
        assert abs(whole - r.score) < 1e-9 and r.kept == (r.score >= cotrain.KEEP)
