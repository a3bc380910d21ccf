import gzip
import random

import pytest
from pyspark.sql import functions as F

from silkloom.operators import candidates, index, report, wordsets
from silkloom.operators.candidates import best_match
from silkloom.operators.cluster import greedy_clusters
from silkloom.sources import datasource, records
from silkloom.streaming.incremental import assign_stream, greedy_stream


def test_fasta(spark, tmp_path):
    text = ">one first record\nACD\nEFG\n\n>two\nAC>D\n> three\tx\nMKV*\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    for name in ("a.fa", "b.fa.gz"):
        got = [(r.ordinal, r.name, r.comment, r.sequence) for r in records.read_fasta(spark, str(tmp_path / name)).orderBy("ordinal").collect()]
        assert got == [(0, "one", "first record", "ACDEFG"), (1, "two", "", "AC>D"), (2, "three", "x", "MKV*")]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@one c\nACGT\n+\n@III\n@two\nAC\nGT\n+two\nII\n@I\n")
    got = [(r.name, r.comment, r.sequence, r.quality) for r in records.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("ordinal").collect()]
    assert got == [("one", "c", "ACGT", "@III"), ("two", "", "ACGT", "II@I")]
    (tmp_path / "bad.fq").write_text("@one\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="shorter"):
        records.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def _fastq(r, n):
    """Records whose quality lines often begin with @ or +, some over several lines."""
    out = []
    for i in range(n):
        seq = "".join(r.choice("ACGT") for _ in range(r.choice([0, 1, 3, 30, 200, 900] if i % 50 else [6000])))
        quality = "".join(r.choice("@@@+I>") for _ in seq)
        cut = lambda t: "\n".join(t[j : j + 37] for j in range(0, len(t), 37)) if r.random() < 0.4 else t
        out.append((f"r{i}", seq, quality, f"@r{i} c\n{cut(seq)}\n+{'x' if i % 3 else ''}\n{cut(quality)}\n"))
    return out


@pytest.mark.parametrize("most", [records.BROADCAST_SPLITS, 0])
def test_splits_of_a_fastq_file_are_parsed_apart(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", most)
    r = random.Random(5)
    files = {name: _fastq(r, 300) for name in ("a.fq", "b.fq")}
    for name, rows in files.items():
        (tmp_path / name).write_text("".join(x[3] for x in rows))
    want = [(x[0], x[1], x[2]) for name in sorted(files) for x in files[name]]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("4k",) if most else ("9k",):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = records.read_fastq(spark, str(tmp_path / "*.fq")).orderBy("ordinal").collect()
            assert [(x.name, x.sequence, x.quality) for x in got] == want and [x.ordinal for x in got] == list(range(len(want)))
        assert spark.read.option("lineSep", "\n@").text(str(tmp_path / "*.fq")).rdd.getNumPartitions() >= 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert records._pieces(spark, str(tmp_path / "*.fq"), "\n@").rdd.getNumPartitions() > 20
        for bad in ("@x\nACGT\n", "@x\nACGT\n+\nIIIII\n", "@x\nACGT\n+\nII\n"):
            (tmp_path / "bad").mkdir(exist_ok=True)
            (tmp_path / "bad" / "c.fq").write_text("".join(x[3] for x in files["a.fq"]) + bad)
            with pytest.raises(Exception, match="quality"):
                records.read_fastq(spark, str(tmp_path / "bad" / "c.fq")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("split", [50])
def test_data_source_by_ranges(spark, tmp_path, monkeypatch, split):
    r = random.Random(2)
    texts = []
    for name in ("a.fa", "b.fa"):
        rows = [f">{name}{i} some > words\n" + "\n".join("A" + "".join(r.choice("ACGT>") for _ in range(r.choice([1, 5, 60]))) for j in range(r.randint(0, 4))) + "\n" for i in range(40)]
        texts += rows
        (tmp_path / name).write_text("".join(rows).replace("\n>", "\n>") if name == "a.fa" else "\n\n" + "".join(rows).rstrip("\n"))
    datasource.register(spark)
    got = spark.read.format("fasta").option("splitBytes", split).load(f"{tmp_path}/*.fa")
    want = records.read_fasta(spark, f"{tmp_path}/*.fa")
    columns = ["name", "comment", "sequence", "quality"]
    key = lambda df: sorted(tuple(str(x) for x in row) for row in df.select(*columns).collect())
    assert key(got) == key(want)
    assert got.rdd.getNumPartitions() > 50
    copied = {bytes(x.record).decode().rstrip("\n") for x in datasource.original(got).collect()}
    assert copied == {t.rstrip("\n") for t in texts}
    some = got.filter("letters > 60")
    assert some.count() == want.filter("length(sequence) > 60").count() == spark.read.format("fasta").option("minLength", 61).load(f"{tmp_path}/*.fa").count() > 0
    assert " Filter " not in some._jdf.queryExecution().executedPlan().toString()  # the reader applies it


def test_data_source_of_fastq(spark, tmp_path, monkeypatch):
    rows = _fastq(random.Random(3), 200)
    (tmp_path / "a.fq").write_text("".join(x[3] for x in rows))
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("".join(x[3] for x in rows))
    datasource.register(spark)
    monkeypatch.setattr(datasource, "CHUNK", 100)
    for name in ("a.fq", "b.fq.gz"):
        got = spark.read.format("fastq").load(str(tmp_path / name)).orderBy("offset")
        assert [(x.name, x.sequence, x.quality) for x in got.collect()] == [x[:3] for x in rows]
    plain = spark.read.format("fastq").load(str(tmp_path / "a.fq"))
    assert {bytes(x.record).decode() for x in datasource.original(plain).collect()} == {x[3] for x in rows}


def test_originals_of_paired_files_and_segments(spark, tmp_path):
    r = random.Random(6)
    base = ["".join(r.choice("ACDEFGHIKL") for _ in range(60)) for _ in range(4)]
    one = [f">s{i} note\r\n{s[:30].lower()}\n{s[30:]}\n\n" for i, s in enumerate([*base, *[b[:55] for b in base]])]
    two = [f"@s{i}\nACGT\n+\n@@@{i}\n" for i in range(8)]
    (tmp_path / "1.fa").write_bytes("".join(one).encode())
    (tmp_path / "2.fq").write_text("".join(two))
    datasource.register(spark)
    first, second = (spark.read.format(f).load(str(tmp_path / n)).withColumn("seq_id", F.substring("name", 2, 9).cast("long")) for f, n in (("fasta", "1.fa"), ("fastq", "2.fq")))
    clusters = greedy_clusters(first.select("seq_id", F.upper("sequence").alias("seq")), 3, 0.5)
    report.write_originals(clusters, (first, str(tmp_path / "o1")), (second, str(tmp_path / "o2")))
    for rows, name in ((one, "o1"), (two, "o2")):
        got = b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*")))
        assert got == "".join(rows[:4]).encode()
    seqs = first.select("seq_id", F.col("sequence").alias("seq"))
    cut = report.divided(seqs, 3)
    report.write_segments(cut, seqs, str(tmp_path / "parts"))
    back = records.read_fasta(spark, str(tmp_path / "parts/segment=*"))
    assert {(x.name, x.sequence) for x in back.collect()} == {(str(x.seq_id), x.seq) for x in seqs.collect()}
    of = {x.seq_id: x.segment for x in cut.collect()}
    for n in set(of.values()):
        assert {int(x.name) for x in records.read_fasta(spark, str(tmp_path / f"parts/segment={n}")).collect()} == {i for i, k in of.items() if k == n}


def test_clear_deletes_what_was_stored(spark):
    from silkloom.plans import storage

    df = storage.stored(spark.range(5), "five")
    assert df.count() == 5 and storage.clear(spark) >= 1 and storage.clear(spark) == 0
    with pytest.raises(Exception):
        df.count()


def test_pairs_and_kept(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">a\nXXXABC\n>b\nACDEFGHIKL\n")
    (tmp_path / "2.fa").write_text(">a\nYYYLMN\n>b\nA\n")
    (tmp_path / "3.fa").write_text(">a\nYYYLMN\n")
    one, two, three = (records.read_fasta(spark, str(tmp_path / f"{i}.fa")) for i in (1, 2, 3))
    got = {r.identifier: r.seq for r in records.paired(one, two).collect()}
    assert got == {"a": "NMLYYYXXXABC", "b": "AACDEFGHIKL"}
    with pytest.raises(ValueError):
        records.paired(one, three)
    assert [r.seq for r in records.kept_records(one, 6).collect()] == ["ACDEFGHIKL"]
    assert records.kept_records(one, 3, most=1).count() == 1


def test_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRS"), (2, "WYWYWYVVVTTSSRRQ")], "seq_id long, seq string")
    new = spark.createDataFrame([(10, "ACDEFGHIKLMNPQRT"), (11, "GGGGGGGGGG")], "seq_id long, seq string")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, seq string").parquet(str(tmp_path / "in"))
    assign_stream(stream, base, str(tmp_path / "out"), str(tmp_path / "check"), 5, 0.5).awaitTermination()
    got = {r.seq_id: r.root_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {10: 1, 11: None}
    assert best_match(base, new, 5, 0.5).count() == 1


def test_index_probes_do_not_shuffle_it(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, "".join(r.choice("ACDEF") for _ in range(r.randint(10, 40)))) for i in range(40)]
    rows += [(50 + i, s[:-2] + "KL") for i, s in rows[:15]]
    base, query = (spark.createDataFrame(x, "seq_id long, seq string") for x in (rows[:35], rows[35:]))
    made = index.build_index(base, 3, str(tmp_path / "i"))
    columns = ["src", "dst", "shared", "jaccard", "first_word"]
    key = lambda df: sorted(tuple(x) for x in df.select(*columns).collect())
    for tau in (0.5,):
        assert key(made.edges(tau)) == key(candidates.edges(base, 3, tau))
        assert key(made.matches(query, tau)) == key(candidates.between(base, query, 3, tau))
        index.build_index(query, 3, str(tmp_path / "i"))
    assert {x.seq_id for x in index.open_index(spark, str(tmp_path / "i")).sets.collect()} == {i for i, _ in rows[35:]}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made.probed(wordsets.word_sets(query, 3), 0.5)._jdf.queryExecution().executedPlan().toString()
        both = made._near(made.postings, made.postings, 0.5, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # what is read from the index goes to its join as it lies: no exchange by word but those of the queries' words
    assert plan.count("Exchange hashpartitioning(code") == 2 and "Exchange hashpartitioning(code" not in both


def test_greedy_stream_equals_the_whole(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for i in range(45):
        s = list(r.choice(rows)[1]) if rows and r.random() < 0.6 else [r.choice("ACDEFGHIKL") for _ in range(r.randint(20, 50))]
        s[r.randrange(len(s))] = r.choice("ACDEFGHIKL")
        rows.append((i, "".join(s)))
    rows.sort(key=lambda x: (-len(x[1]), x[0]))
    for n in range(2):
        spark.createDataFrame(rows[23 * n : 23 * n + 23], "seq_id long, seq string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    greedy_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/check", 3, 0.4).awaitTermination()
    read = lambda: {x.seq_id: x.root_id for x in spark.read.parquet(f"{tmp_path}/out/assigned").collect()}
    want = {x.seq_id: x.root_id for x in greedy_clusters(spark.createDataFrame(rows, "seq_id long, seq string"), 3, 0.4).collect()}
    assert read() == want and len(set(want.values())) < 40
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the last batch had been lost before it was committed
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    greedy_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/check", 3, 0.4).awaitTermination()
    assert read() == want
