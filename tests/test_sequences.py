from collections import Counter

from pyspark.sql import functions as F

from silkloom.functions import sequences as fs
from silkloom.operators import kmers, sketch


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, "Straße", fs.letters) == "STRAE"
    assert one(spark, "ab c*\n", fs.formatted) == "ABC"
    assert one(spark, "AB1C", fs.formatted) is None and one(spark, "AB1C", fs.bad_characters) == 1
    assert one(spark, "ACGTN", fs.reverse_complement) == "NACGT"
    assert one(spark, "BJOUZX", fs.components_alphabet) == "AAAAAX"
    assert one(spark, "BZJOU", fs.greedy_alphabet) == "NEXXX"
    assert one(spark, "ACDEF", fs.word_code) == 10210
    assert one(spark, ">name_of_a_long_record more", fs.identifier) == ">name_of_a_long_reco"
    row = spark.createDataFrame([("XXXABC", "YYYLMN")], "a string, b string").select(fs.merged_pair(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == "NMLYYYXXXABC"


def seqs(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, seq string")


def test_words(spark):
    long = "ACDEFGHIKLMNPQRSTVWY" * 100
    got = {(r.seq_id, r.pos, r.word) for r in kmers.words(seqs(spark, [(1, long), (2, "ACD"), (3, "ACDEF"), (4, "")]), 5).collect()}
    assert got == {(1, i + 1, long[i : i + 5]) for i in range(len(long) - 4)} | {(3, 1, "ACDEF")}
    row = kmers.unmasked_words(seqs(spark, [(1, "ACNGT")]), 3).first()
    assert (row.kept, row.skipped) == (0, 3)


def test_profile(spark):
    row = kmers.profile(seqs(spark, [(i, "A" * n) for i, n in enumerate([10, 8, 5, 3, 2])])).first()
    assert (row.n50, row.total_letters, row.max_len, row.min_len, row.avg_len) == (8, 28, 10, 2, 5)


def test_rank_and_empty(spark):
    rows = [(3, "AAAA"), (1, "AA"), (2, "AAAA"), (4, "A")]
    assert [r.seq_id for r in kmers.length_rank(seqs(spark, rows)).orderBy("rank").collect()] == [2, 3, 1, 4]
    assert kmers.length_rank(seqs(spark, [])).count() == 0 and kmers.kmer_counts(seqs(spark, []), 5).count() == 0


def test_words_are_counted_where_they_lie(spark):
    rows = ["ACGTACGTAC" * 9, "AAAAAAA", "ACé#ACé#", "AC", "", None, "XNACGTN"]
    df = spark.createDataFrame(list(enumerate(rows)), "seq_id long, seq string").repartition(3)
    want = {i: Counter(t[j : j + 3] for j in range(len(t) - 2)) for i, t in enumerate(rows) if t and len(t) > 2}
    counts = kmers.kmer_counts(df, 3)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.seq_id, r.word): r.cnt for r in counts.collect()} == {(i, w): n for i, c in want.items() for w, n in c.items()}
    totals = kmers.word_totals(df, 3)
    assert "Generate" not in totals._jdf.queryExecution().executedPlan().toString()
    every = sum(want.values(), Counter())
    assert {r.word: (r.n, r.c) for r in totals.collect()} == {w: (sum(w in c for c in want.values()), n) for w, n in every.items()}
    masked = {r.seq_id: (r.kept, r.skipped) for r in kmers.unmasked_words(df, 3).collect()}
    assert masked == {i: (k := sum(n for w, n in c.items() if not set(w) - set("ACGT")), sum(c.values()) - k) for i, c in want.items()}
    lists = {(r.word, r.part): [tuple(x) for x in r.postings] for r in kmers.posting_lists(df, 3, 2).collect()}
    for w in every:
        order = sorted((-len(rows[i]), i) for i, c in want.items() if w in c)
        assert [x for p in range(-(-len(order) // 2)) for x in lists[w, p]] == [(i, want[i][w]) for _, i in order]


def test_sketches_hold_the_words_of_one_sequence(monkeypatch):
    seen = []
    cut, drawn = sketch.word_codes, sketch.samples
    monkeypatch.setattr(sketch, "word_codes", lambda *a: (seen.append("words"), cut(*a))[1])
    monkeypatch.setattr(sketch, "samples", lambda *a: (seen.append("sketch"), drawn(*a))[1])
    assert len(list(sketch._sketched(["ACDEFGH", "ACDACD", "AAAAAA"], 5, 10, 1, sketch.Memo(10, 1)))) == 3
    assert seen == ["words", "sketch"] * 3
