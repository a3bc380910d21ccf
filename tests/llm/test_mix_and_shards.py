import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from silkloom.llm import mix, shards


def corpus(seed, n=400):
    r = random.Random(seed)
    return [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 20, 100, 300]))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)]


def test_mix_equals_sql(make, duck, table_rows):
    docs = make(corpus(1))
    cols = ["doc_id", "size", "source_size", "target", "copies"]
    for rows in (1, 7, 20_000):
        got = mix.mix(docs, carry=["doc_id"], bucket_rows=rows).select("row.doc_id", "size", "source_size", "target", "copies")
        assert table_rows(got, cols) == duck(mix.ORACLE_SQL["op2_mix_sources"], cols, documents=docs)


def test_mix_targets(make):
    rows = mix.mix(make(corpus(2))).select("row.source", "size", "source_size", "target", "copies").collect()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.copies <= 3
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(b[0].target for b in by.values()) - total) < 1e-6 * total
    for b in by.values():
        assert b[0].source_size == sum(r.size for r in b) and b[0].target <= 3 * b[0].source_size + 1e-9
        assert abs(sum(r.copies * r.size for r in b) - b[0].target) <= 2 * max(r.size for r in b)


def test_mix_edges(make, edge_rows, table_rows, spark):
    docs = make(edge_rows, clash=True)
    out = mix.mix(docs)
    assert out.count() == len(edge_rows)
    taken = mix.emitted(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in out.collect())
    assert mix.mix(make([])).count() == 0
    assert {r["size"] for r in mix.mix(make([(1, None), (2, "")])).collect()} == {0}


def test_shards(make, duck, table_rows):
    docs = make(corpus(3, 333))
    for rows in (5, 20_000):
        got = shards.interleave(docs, 16, bucket_rows=rows).select("row.doc_id", "row.source", "shard", "slot")
        sizes = Counter(r["shard"] for r in got.collect())
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
        slots = defaultdict(set)
        for r in got.collect():
            slots[r["shard"]].add(r["slot"])
        assert all(s == set(range(len(s))) for s in slots.values())
        of, per = Counter(r["source"] for r in got.collect()), Counter((r["source"], r["shard"]) for r in got.collect())
        assert all(abs(per[s, i] - n / 16) <= 2 for s, n in of.items() for i in range(16))
        want = duck(shards.ORACLE_SQL["op7_interleaved_shards"], ["doc_id", "shard", "slot"], documents=docs)
        assert table_rows(got, ["doc_id", "shard", "slot"]) == want


def test_shards_edges(make, edge_rows, spark):
    out = shards.interleave(make(edge_rows, clash=True), 16)
    assert out.count() == len(edge_rows) and out.filter(F.col("slot") != 0).count() == 0
    assert shards.interleave(make([]), 16).count() == 0
