from hypothesis import given, settings
from hypothesis import strategies as st

from silkloom.llm import quality


def naive(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == naive(words)


def test_ledger(make, edge_rows):
    rows = quality.ledger(make(edge_rows, clash=True)).collect()
    assert len(rows) == len(edge_rows)
    by = {(r.row.doc_id, r.row.text): r for r in rows}
    for key in ((1, None), (2, ""), (3, " \n\t ")):
        assert by[key].m.n_words == 0 and by[key].failed == quality.BIT["few_words"]
    assert by[8, "One\nline\n\nand more"].m.n_lines == 3
    assert quality.ledger(make([])).count() == 0


def test_measures():
    text = "A # b\nA # b\n\n x\x85y\x1cz "
    n, chars, symbols, lines, dup, _, upper = quality.measured(text)
    assert (n, chars, symbols, lines, dup, upper) == (7, 11, 2, 3, 1, 2)


def test_policies_and_ablations(make):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (2, "few"), (3, " ".join(["a$"] * 5 + [f"w{i}$" for i in range(30)])), (4, good.upper()), (5, "\n".join([good, "x y", "x y", "x y"]))]
    docs = make(rows)
    assert {r.doc_id for r in quality.apply_policy(docs, "v1").collect()} == {1, 4}
    assert {r.doc_id for r in quality.apply_policy(docs).collect()} == {1}
    assert quality.apply_policy(docs).columns == docs.columns
    got = {r.rule: (r.failed, r.rejected_alone, r.kept_without) for r in quality.ablations(quality.ledger(docs)).collect()}
    book = [r.failed & quality.POLICIES["v2"] for r in quality.ledger(docs).collect()]
    for name, bit in quality.BIT.items():
        assert got[name] == (sum(b & bit != 0 for b in book), sum(b == bit for b in book), sum(b & ~bit == 0 for b in book))
