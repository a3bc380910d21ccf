import hashlib
from collections import Counter

import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from silkloom.llm import bpe, linededup, mix, quality

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(docs, duck):
    """The pipeline on a data frame: naive rules, SQL for lines and mixing, all pairs for near duplicates, the library for tokens."""

    def keeps(text):
        n, chars, symbols, lines, dup, repeated, upper = quality.measured(text)
        return not (n < 20 or 100 * repeated > 30 * n or 10 * symbols > n or 10 * dup > 3 * lines or 10 * upper > 4 * n or chars < 2 * n or chars > 15 * n)

    docs = docs[[keeps(t) for t in docs.text]]
    cut = {r[0]: r[1:] for r in duck(linededup.ORACLE_SQL["op8_line_winnowing"], ["doc_id", "text", "deleted"], documents=docs)}
    docs = docs.assign(text=[cut[i][0] for i in docs.doc_id], deleted=[cut[i][1] for i in docs.doc_id])
    docs = docs[[d == 0 or bool(t.split()) for t, d in zip(docs.text, docs.deleted)]]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = sorted((i, shingles(t)) for i, t in zip(docs.doc_id, docs.text))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = docs[[find(i) == i for i in docs.doc_id]]
    copies = {r[0]: r[1] for r in duck(mix.ORACLE_SQL["op2_mix_sources"], ["doc_id", "copies"], documents=docs)}
    library = Tokenizer.from_file(bpe.default_path())
    out = Counter()
    for i, t in zip(docs.doc_id, docs.text):
        ids = library.encode(t, add_special_tokens=False).ids
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        out[i, len(ids), sha, back] = copies[i]
    return +out


def test_equals_brute_force(spark, duck):
    sf = "/root/testdata/sf0.001"
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == brute(pd.read_parquet(f"{sf}/documents.parquet"), duck)


def test_stages(spark, make, edge_rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    for rows in (edge_rows, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "unused")
            assert out.columns == DOCS if name != "bpe_encode" else out.count() == len(rows)
        near = corpus_pipeline.near_dedup(spark, docs, "unused")
        assert near.count() == (len(rows) - 3 if rows else 0)
