import re
from collections import Counter
from itertools import permutations
from math import log2

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from silkloom.llm import divergence, filteraudit, secretscan

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i}" for i in range(220))


def plain_masks(rows):
    """(id, part) and the failed filters of each row (id, text, part)."""
    least = {}
    for ident, text, _ in rows:
        if ident is not None:
            least[text or ""] = min(ident, least.get(text or "", ident))
    out = []
    for ident, text, part in rows:
        text = text or ""
        w = WORD.findall(text)
        failed = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
        failed.append(ident is not None and ident > least[text])
        out.append((ident, part or "", "".join(f for f, bad in zip("ABCDE", failed) if bad)))
    return out


def plain_audit(rows, labels):
    found = plain_masks(rows)
    out = {}
    for part in {p for _, p, _ in found}:
        mine = [(i, f) for i, p, f in found if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            live = list(mine)
            for step, name in enumerate(order, 1):
                removed = [(i, f) for i, f in live if name in f]
                live = [x for x in live if name not in x[1]]
                shapley[name] += len(removed)
                gone = [f for _, f in mine if name in f and any(x in f for x in order[: step - 1])]
                said = [labels.get(i, (None, None)) for i, _ in removed]
                out[part, "".join(order), step] = [len(live), len(removed), len(gone), sum(f == name for _, f in mine), sum(q == 1 for q, _ in said), sum(t == 1 for _, t in said)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


AUDITED = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "de"), (4, LONG, "en"), (5, LONG, "en"), (5, LONG, "en"), (3, LONG, "de"), (3, LONG, ""), (6, LONG + " $", "en"), (7, LONG.upper(), "en"),
    (8, "a b " * 300, "en"), (9, "a b " * 300, None), (None, LONG, "en"), (None, None, None), (10, "a b " * 30_000, "de"), (11, "É à\x85x " + LONG, "de"), (2, "other", "en"),
]


@pytest.mark.parametrize("key_of", [filteraudit.fingerprint, len, lambda text: 0])
def test_audit_equals_a_plain_one_even_if_all_fingerprints_collide(spark, key_of):
    rows = [*AUDITED, *[(100 + i % 7, "many copies", "en") for i in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS part", "1 AS bits", "2 AS n", "3 AS id").repartition(5)
    said = [(4, 1, 0), (5, None, 1), (5, 1, None), (7, 0, 1), (101, 1, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filteraudit.audit(docs, labels, key_of=key_of).collect()}
    assert got == plain_audit(rows, {4: (1, 0), 5: (1, 1), 7: (0, 1), 101: (1, 1)})
    assert sorted(r.doc_id for r in filteraudit.copies(docs).collect()) == sorted({i for i, _, f in plain_masks(rows) if "E" in f})


def test_audit_sends_on_what_it_holds(spark, monkeypatch):
    docs = [(i, f"text {i % 9} " * (i % 5 + 1), "en") for i in range(200)]
    for held, known in ((1, 1), (2000, 3)):
        monkeypatch.setattr(filteraudit, "HELD", held)
        monkeypatch.setattr(filteraudit, "KNOWN", known)
        sent = list(filteraudit.routed(docs, filteraudit.fingerprint))
        out = Counter()
        for row in filteraudit.settled(sent):
            out[row[:3]] += row[3]
        want = Counter((i, p, sum(filteraudit.BIT[x] for x in f)) for i, p, f in plain_masks(docs))
        assert out == want and sent == list(filteraudit.routed(docs, filteraudit.fingerprint))


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs, labels).collect() == []


KEYS = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7"


def plain_windows(run, kind):
    """Spans of a run by the entropy of each window, counted anew; entropies that close to a threshold are not in question."""
    hit = set()
    for i in range(len(run) - secretscan.WINDOW + 1):
        w = run[i : i + secretscan.WINDOW]
        entropy = -sum(n / len(w) * log2(n / len(w)) for n in Counter(w).values())
        if entropy >= kind.bits - 1e-6 and all(set(those) & set(w) for those in kind.needs):
            hit |= set(range(i, i + len(w)))
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    return [tuple(s) for s in spans]


@settings(max_examples=150, deadline=None)
@given(st.text("aaaaaab01c2dEFG3", min_size=1, max_size=90), st.sampled_from(secretscan.CLASSES))
def test_incremental_windows(run, kind):
    assert list(secretscan.windows(run, kind)) == plain_windows(run, kind)


def test_patterns():
    def kinds(text):
        return [(secretscan.KINDS[k], text[a:b]) for a, k, b in secretscan.base_spans(text)]

    assert kinds('My PASSWORD = "hunter22!" and api_key:abcdef') == [("assign", 'PASSWORD = "hunter22'), ("assign", "api_key:abcdef")]
    assert kinds("secret=token:abcdefgh") == []  # a match that is too short uses up what it covers
    assert kinds("paſsword=abcdefgh") == [] and kinds("toKen=abcdefgh") == []
    assert kinds("AKIA" + "A" * 15) == [] and kinds("xAKIA" + "A1" * 8) == [("access", "AKIA" + "A1" * 8)]
    assert kinds("f" * 23) == [] and kinds("G" + "f" * 30 + "F") == [("hex", "f" * 30)]
    assert kinds("token=" + "ab12" * 8) == [("assign", "token=" + "ab12" * 8), ("hex", "ab12" * 8)]


def test_entropy_spans_and_allow_list():
    def found(text):
        return [text[a:b] for a, _, b in secretscan.entropy_spans(text, secretscan.base_spans(text))]

    assert found(f"key {KEYS} end") == [KEYS] and found(f"é\n{KEYS}") == [KEYS]
    assert found("http://host/" + KEYS) == [] and found("sha256:" + KEYS) == [] and found("example" + KEYS) == []
    assert found("123e4567-E89b-12d3-a456-426614174000") == [] and found("a" * 5000) == []
    assert found("password=" + KEYS) == []  # an assignment holds it already
    assert found("Donaudampfschifffahrtsgesellschaft well-known-state-of-the-art/and/or") == []


def test_scan_edge_cases(make, edge_rows):
    rows = [*edge_rows, (20, ("x" * 100_000) + " " + KEYS + " token: abcdefgh"), (21, KEYS * 5_000)]
    out = secretscan.scan(make(rows, clash=True)).collect()
    assert len(out) == len(rows)
    by = {r.row.doc_id: r.spans for r in out}
    assert by[1] == by[2] == by[3] == [] and [secretscan.KINDS[s.kind] for s in by[20]] == ["entropy", "assign"]
    assert [(s.start, s.end) for s in by[21]] == [(0, len(KEYS) * 5_000)]
    assert secretscan.scan(make([])).count() == 0
    clean = {r.doc_id: r.text for r in secretscan.redacted(make([(1, f"a {KEYS} b password={KEYS} c"), (2, None), (3, "")])).collect()}
    assert clean == {1: "a [secret] b [secret] c", 2: None, 3: ""}


def test_secret_scan_sql(make, duck, table_rows, spark, tmp_path):
    texts = [None, "", "x\ny token = 'abc' secret=token:abcdefgh", f"éé {KEYS}\n{KEYS}x AKIA{'Q7' * 9}", "sha1 " + "0f" * 20 + " http://a/" + KEYS, KEYS * 3 + " " + "aF0" * 12]
    docs = make([(i, t) for i, t in enumerate(texts)] + [(None, KEYS)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = table_rows(secretscan.op12_secret_scan(spark, str(tmp_path)), columns)
    assert got == duck(secretscan.ORACLE_SQL["op12_secret_scan"], columns, documents=docs)
    assert sum("entropy" in r[-1] for r in got) >= 3


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_divergence(rows, least=10, ranks=10):
    rows = [[x or "" for x in r] for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), {}
        for text, x, source in rows:
            if x == lang:
                found = Counter(TERM.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text)))
                docs.update(found.keys())
                counts.setdefault(source, Counter()).update(found)
        kept = [t for t, n in docs.items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in counts if o != s]
            own = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= ranks:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("cells,held", [(1 << 20, 400_000), (6, 10)])
def test_divergence_equals_a_plain_one(spark, monkeypatch, cells, held):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = np.random.default_rng(3)
    vocabulary = ["Alpha", "beta", "Été", "été", "GAMMA", "d1e", "x-y", "中文", "z"] + [f"t{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 30)).tolist()), ["en", "de", None][rng.integers(3)], ["a", "b", "c", None, "é"][rng.integers(5)]) for _ in range(300)]
    rows += [(None, "xx", "only"), ("", "xx", "nothing"), ("rare words here", "yy", "a"), (" ".join(vocabulary * 2_000), "en", "long"), *[("same same", "en", "a")] * 50]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS block", "3 AS tag", "'y' AS part", "5 AS `rank`").repartition(4)
    got = [tuple(r) for r in divergence.divergence(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert divergence.divergence(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**12), st.integers(0, 10**12), st.integers(1, 10**9))
def test_shares_are_exact(count, others, vocabulary):
    n = count + others
    assert divergence.shares(np.int64(count), np.int64(n), vocabulary) == 1 + 10**9 * (count + 2) // (n + 2 * vocabulary)
