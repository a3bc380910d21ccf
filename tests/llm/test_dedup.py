import random

import pytest
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
from silkloom.llm import linededup, neardup

LINES = ["doc_id", "text", "lines", "deleted"]
NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


def lines_corpus(seed, n=80):
    r = random.Random(seed)
    pool = [" ".join(f"t{r.randrange(60)}" for _ in range(r.choice([1, 3, 10, 20, 24, 25, 26, 49, 50, 60]))) for _ in range(25)]
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(r.choice(["", " ", *pool]) if r.random() < 0.9 else f"own line {i} {r.random()}" for _ in range(r.randint(0, 14)))))
    return rows + [(n, "\n".join(["short one"] * 80)), (n + 1, "\n".join(["short one"] * 80))]


def test_lines_equal_sql(make, duck, table_rows):
    for seed in (1, 2):
        docs = make(lines_corpus(seed))
        got = linededup.dedup_lines(docs).select("row.doc_id", "text", "lines", "deleted")
        assert table_rows(got, LINES) == duck(linededup.ORACLE_SQL["op8_line_winnowing"], LINES, documents=docs)


def test_lines_edges(make, edge_rows):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(3))
    rows = edge_rows + [(50, f"before\n{passage}\nafter"), (51, f"other\n{passage}"), (52, passage)]
    docs = make(rows, clash=True)
    out = linededup.dedup_lines(docs)
    got = {(r.row.doc_id, r.row.text): (r.text, r.deleted) for r in out.collect()}
    assert out.count() == len(rows) and got[1, None] == (None, 0) and got[51, f"other\n{passage}"] == ("other", 3) and got[50, f"before\n{passage}\nafter"][1] == 0
    kept = linededup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 52").count() == 0 and kept.filter("doc_id = 51").first().n_chars == 5
    assert kept.filter("doc_id < 50 OR doc_id IS NULL").count() == len(edge_rows)
    assert linededup.dedup_lines(make([])).count() == 0


def near_corpus(seed, n=150):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.7:
            words = r.choice(out)[1].split(" ")
            for _ in range(r.randint(0, max(1, len(words) // 8))):
                words[r.randrange(len(words))] = f"n{r.randrange(1000)}"
            out.append((i, " ".join(words)))
        else:
            out.append((i, " ".join(f"w{r.randrange(300)}" for _ in range(r.choice([1, 2, 8, 40, 120])))))
    r.shuffle(out)
    return out


def test_near_duplicates_equal_brute_force(make, duck, table_rows):
    for seed in (3, 4):
        docs = make(near_corpus(seed))
        got = neardup.near_duplicates(docs, 2, 80)
        assert table_rows(got, NEAR) == duck(neardup.ORACLE_SQL["op10_minhash_forest"], NEAR, documents=docs)


def test_large_group(make, duck, table_rows):
    """A group of near copies much larger than a window, and one of exact copies."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{r.randrange(10**6)}" if r.random() < 0.04 else w for w in base)) for i in range(600)] + [(1000 + i, "one and the same text") for i in range(300)]
    docs = make(rows)
    want = duck(neardup.ORACLE_SQL["op10_minhash_forest"], NEAR, documents=docs)
    assert table_rows(neardup.near_duplicates(docs, 2, 80), NEAR) == want


def template_corpus(seed, n, pairs):
    """Copies of a template, each pair a little less alike than 0.8, and planted partners that are just above it."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(600)]
    slots = range(1, 599, 2)

    def changed(tag, at):
        return {i: f"{tag}x{i}" for i in at}

    all_changes = [changed(f"a{k}", r.sample(slots, 21)) for k in range(n)]
    for k in range(pairs):
        shared = dict(r.sample(sorted(all_changes[k].items()), 5))
        all_changes.append(shared | changed(f"b{k}", r.sample([i for i in slots if i not in all_changes[k]], 16)))
    ids = r.sample(range(10 * n), len(all_changes))
    return [(i, " ".join(c.get(at, w) for at, w in enumerate(base))) for i, c in zip(ids, all_changes)]


def test_template_family(make, duck, table_rows):
    """Each linked text has many that are about as alike and link with nothing."""
    docs = make(template_corpus(5, 340, 60))
    want = duck(neardup.ORACLE_SQL["op10_minhash_forest"], NEAR, documents=docs)
    assert table_rows(neardup.near_duplicates(docs, 2, 80), NEAR) == want


def test_links_across_partitions(spark, make, duck, table_rows):
    """So many partitions that each row of an order is alone in one."""
    docs = make(near_corpus(6, 8))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        got = table_rows(neardup.near_duplicates(docs, 2, 80), NEAR)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = duck(neardup.ORACLE_SQL["op10_minhash_forest"], NEAR, documents=docs)
    assert got == want and any(not r[3] for r in want)


def test_near_edges(make, edge_rows):
    got = neardup.near_duplicates(make(edge_rows, clash=True), 5, 80).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append((x.n_shingles, x.component_id, x.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[5] == [(26, 5, True)] and by[6] == [(26, 5, False)] * 2 and by[7] == [(27, 5, False)]
    assert neardup.near_duplicates(make([]), 5, 80).count() == 0


def test_low_similarity_is_refused(make):
    with pytest.raises(ValueError):
        neardup.near_duplicates(make([(1, "a b c")]), 2, 60)


@pytest.mark.parametrize("stretch", [3, 7, 10_000])
def test_stretches_lose_no_block(stretch, monkeypatch):
    """Rows come whole to the blocks, wherever stretches and batches end."""
    monkeypatch.setattr(neardup, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    blocks = np.sort(rng.integers(0, 12, 60))
    n = len(blocks)
    names = ["node", "comp", "n_shingles", "region", "row_block", "col_block", "side"]
    side = np.concatenate([np.arange(c) % 2 for c in np.bincount(blocks)])
    order = np.lexsort((side, blocks))
    columns = [np.arange(n), np.arange(n), np.full(n, 9), blocks, np.zeros(n, int), np.zeros(n, int), side[order]]
    odd, even = "a b c d e", "f g h i j"  # links of rows of like parity only
    table = pa.table({**{k: v for k, v in zip(names, columns)}, "fine": [bytes(neardup.SKETCH)] * n, "heads": [bytes(8 * neardup.TREES)] * n, "text": [odd if i % 2 else even for i in range(n)]})
    got = [(a, b) for out in neardup._in_blocks(2, 80)(iter(table.to_batches(max_chunksize=4))) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    rows = list(zip(*(c.tolist() for c in columns)))
    want = {(min(x[0], y[0]), max(x[0], y[0])) for x in rows for y in rows if x[3] == y[3] and x[6] == 0 and y[6] == 1 and (x[0] - y[0]) % 2 == 0}
    assert set(got) <= want and parts(got) == parts(want)


def parts(links):
    """The components of links, as sets."""
    root = {i: i for pair in links for i in pair}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(i for i in root if find(i) == r) for r in root}
