"""Clustering: components and greedy commits on similarity edges, greedy clustering by identity, two collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Tables, stored, temporary
from .align import alignments
from .candidates import small_pairs, text_links
from .graph import assigned, components, greedy_commit
from .kmers import ranked
from .options import Options
from .search import Search, coded, scoring_of
from .sketch import DIMS, sketches, votes


def component_clusters(seqs: DataFrame, k: int = 5, tau: float = 0.36, small: bool = False, links: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """(seq_id, root_id): connected components of the edges with similarity at least tau; the root is the longest member, then the smallest id.

    Sequences shorter than k letters are alone. small: the pairwise way for at most ten sequences. links: edges made before, to be used again,
    and copies (seq_id, first): sequences that stand for themselves in no link, but belong to another one with the same text.
    """
    if links is None:
        links, copies = (small_pairs(seqs, k, tau), None) if small else text_links(seqs, k, tau, forest=True)
    parts = components(links.select("src", "dst"))
    order = _nodes(ranked(seqs).select("seq_id", "ord"), copies)
    placed = order.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    roots = placed.groupBy("c").agg(F.min("ord").alias("first")).select("c", F.col("first.seq_id").alias("root_id"))
    return placed.join(roots, "c").select("seq_id", "root_id")


def _nodes(rows: DataFrame, copies: DataFrame | None) -> DataFrame:
    """Adds node: the sequence that stands for the row's one in links."""
    if copies is None:
        return rows.withColumn("node", F.col("seq_id"))
    return rows.join(copies, "seq_id", "left").withColumn("node", F.coalesce("first", "seq_id")).drop("first")


def greedy_clusters(seqs: DataFrame, k: int = 5, tau: float = 0.5, links: DataFrame | None = None) -> DataFrame:
    """(seq_id, root_id): the greedy commit on the edges; members go to their first representative in the order longest first.

    Copies of a text go where the first of them goes: it is a representative of theirs, or one before it is, and then the same one for all.
    """
    copies = None
    if links is None:
        links, copies = text_links(seqs, k, tau)
    nodes = _nodes(ranked(seqs).select("seq_id", "ord"), copies)
    marked = greedy_commit(nodes.filter(F.col("seq_id") == F.col("node")).select("seq_id", "ord"), links)
    got = assigned(marked, links.select("src", "dst"), [F.col("rep_ord")])
    return got if copies is None else nodes.select("seq_id", "node").join(got.withColumnRenamed("seq_id", "node"), "node").select("seq_id", "root_id")


def minhash_clusters(seqs: DataFrame, k: int = 5, tau: float = 0.36, dims: int = DIMS) -> DataFrame:
    """greedy_clusters() on pairs whose sketches agree in at least tau of the dimensions."""
    links = votes(stored(sketches(seqs, k, dims), "sketches"), seqs, -int(-tau * dims // 1))
    return greedy_clusters(seqs, k, tau, links)


def _assigned(matches: DataFrame, reps: DataFrame, o: Options) -> DataFrame:
    """(seq_id, root_id, identity, distance, strand, span) of matched queries; reps: (seq_id, ord) of the representatives.

    A query goes to the match with the smallest shared word, then the first representative; with ``best``, to that of
    the highest identity (the least distance). Of nucleotides, a match on the other strand wins only if its
    representative comes before that of the query's own strand; the best at ties has the first representative.
    """
    rows = matches.join(reps.select(F.col("seq_id").alias("src"), F.col("ord").alias("rep_ord")), "src")
    told = F.struct("rep_ord", "src", "identity", "distance", "strand", "span")
    value = -F.col("identity") if o.distance is None else F.col("distance")
    seen = [F.col("first_code"), F.col("rep_ord")]
    if o.best:
        order = [value, *([F.col("rep_ord")] if o.nucleotide else seen)]
        best = rows.groupBy(F.col("dst").alias("seq_id")).agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("strand").alias("ks"), told.alias("m"))).alias("b")).select("seq_id", "b.m")
    else:
        first = lambda name: F.min(F.when(F.col("strand") == name, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(seen)], told.alias("m"))))
        best = rows.filter("strand = '+'").groupBy("dst").agg(first("+").alias("b")).select(F.col("dst").alias("seq_id"), "b.m")
        if o.nucleotide and o.both_strands:
            own = best.select(F.col("seq_id").alias("dst"), F.col("m").alias("own"))
            other = rows.filter("strand = '-'").join(own, "dst", "left").filter(F.col("own").isNull() | (F.col("rep_ord") < F.col("own.rep_ord")))
            other = other.groupBy(F.col("dst").alias("seq_id")).agg(first("-").alias("b")).select("seq_id", F.col("b.m").alias("o"))
            best = best.join(other, "seq_id", "full").select("seq_id", F.coalesce("o", "m").alias("m"))
    return best.select("seq_id", F.col("m.src").alias("root_id"), "m.identity", "m.distance", "m.strand", "m.span")


def _longer_than(seqs: DataFrame, o: Options) -> DataFrame:
    return seqs.select("seq_id", "seq").filter(F.length("seq") > o.min_length)


#: A stretch of ranks is settled as a whole if no more than so many meetings come to each of its undecided sequences, or if it is no longer than so many ranks.
MEETINGS, LEAST_STRETCH = 100_000, 512
#: Rounds in which only pairs with certain representatives are aligned, before all that is left of a stretch is; candidates of a sequence, on average, up to which all are aligned at once.
ROUNDS, CANDIDATES = 4, 2


def _unlike(pairs: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    """Pairs without those whose end is one of the ids."""
    return pairs.join(ids.select(F.col("seq_id").alias(end)), end, "left_anti")


def _settled(search: Search, pairs: DataFrame, here: DataFrame, rounds: int, tables: Tables) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(members, matches, aligned): the greedy scan of a stretch. pairs are among its undecided sequences ``here`` (seq_id, rank).

    A sequence with no undecided candidate before it is a representative; only pairs with such ones are aligned, and
    the pairs of members go unaligned. After some rounds the pairs that are left are aligned at once and committed.
    """
    ids = lambda df, c: df.select(F.col(c).alias("seq_id")).distinct()
    live, members, matches, aligned = pairs.select("src", "dst", "strand", "first_code"), [], [], []
    for turn in range(rounds + 1):
        if live.isEmpty():
            break
        now = live
        if turn < rounds:
            heads = tables(ids(live, "src").join(ids(live, "dst"), "seq_id", "left_anti"), "heads")
            now = tables(live.join(heads.select(F.col("seq_id").alias("src")), "src", "left_semi"), "now")
        got = search.matches(now)
        matches.append(got)
        aligned.append(now)
        if turn == rounds:
            marked = greedy_commit(here.select("seq_id", F.col("rank").alias("ord")), got.select("src", "dst"))
            members.append(tables(marked.filter("not is_rep").select("seq_id"), "members"))
            break
        out = tables(ids(got, "dst"), "members")
        members.append(out)
        live = tables(_unlike(_unlike(_unlike(live, heads, "src"), out, "src"), out, "dst"), "live")
    none = here.select("seq_id").limit(0)
    return reduce(DataFrame.unionByName, members, none), matches, aligned


def _greedy(search: Search, tables: Tables, stretches: int | None) -> tuple[DataFrame, DataFrame]:
    """(representatives (seq_id, ord), matches of later sequences with them): the greedy scan by stretches of ranks.

    The longest undecided stretch is settled inside, and its representatives alone are held against all that come later;
    what they match is never a representative. A stretch whose sequences would meet too often is cut, its first quarter
    goes first: the first of a large group of like sequences then takes the others out before they are paired.
    """
    o = search.o
    left = search.ranks
    n = left.count()
    cuts = [n * i // (stretches or 1) for i in range((stretches or 1) + 1)]
    todo = list(zip(cuts, cuts[1:]))[::-1]
    reps, matches = [], []
    # Of several matches that with the smallest word counts, so worse ones than a sequence has already need no alignment.
    pruned = not o.best and len(search.strands) == 1

    def worth(pairs: DataFrame, also: list[DataFrame]) -> DataFrame:
        """Pairs that could be the match that counts, without those aligned before."""
        for a in also:
            pairs = pairs.join(a.select("src", "dst", "strand"), ["src", "dst", "strand"], "left_anti")
        if not pruned or not matches:
            return pairs
        order = search.ranks.select(F.col("seq_id").alias("src"), "rank")
        key = F.struct("first_code", "rank")
        best = reduce(DataFrame.unionByName, matches).join(order, "src").groupBy("dst").agg(F.min(key).alias("best"))
        return pairs.join(order, "src").join(best, "dst", "left").filter(F.col("best").isNull() | (key < F.col("best"))).drop("rank", "best")

    while todo:
        lo, hi = todo.pop()
        here = left.filter((F.col("rank") >= lo) & (F.col("rank") < hi))
        size = here.count()
        if not size:
            continue
        if hi - lo > LEAST_STRETCH and search.meetings(here, lo, hi) > MEETINGS * size:
            cut = lo + max(LEAST_STRETCH, (hi - lo) // 4)
            todo += [(cut, hi), (lo, cut)]
            continue
        inside = search.pairs(here, lo, hi)
        whole = size == hi - lo  # none is decided yet
        undecided = inside if whole else tables(inside.join(here.select(F.col("seq_id").alias("dst")), "dst", "left_semi"), "undecided")
        rounds = ROUNDS if undecided.count() > CANDIDATES * size else 0
        members, got, aligned = _settled(search, undecided, here, rounds, tables)
        own = tables(here.join(members, "seq_id", "left_anti"), "representatives")
        named = own.select(F.col("seq_id").alias("src"))
        reps.append(own)
        matches += [m.join(named, "src", "left_semi") for m in got]
        late = []
        if rounds or not whole:
            rest = _unlike(inside.join(named, "src", "left_semi"), own, "dst")
            late.append(search.matches(tables(worth(rest, aligned), "rest")))
        if hi < n:
            later = search.pairs(own, hi)
            late.append(search.matches(tables(worth(later, []), "later")))
            found = late[-1].select(F.col("dst").alias("seq_id")).distinct()
            left = tables(left.filter(F.col("rank") >= hi).join(found, "seq_id", "left_anti"), "left")
        matches += late
    order = reduce(DataFrame.unionByName, reps, search.ranks.limit(0)).select("seq_id", F.col("rank").alias("ord"))
    found = reduce(DataFrame.unionByName, matches) if matches else search.matches(search.pairs(search.ranks.limit(0)))
    return order, found


def identity_clusters(seqs: DataFrame, options: Options = Options(), stretches: int | None = None) -> DataFrame:
    """(seq_id, root_id, identity, distance, strand, span): greedy clustering by alignment identity (or distance), longest first.

    Sequences of at most min_length letters are left out. A sequence is a representative unless a longer one (or equal,
    with a smaller id) that is a representative matches it; _assigned() tells which match a member goes to. The last
    four columns are null for representatives; span has the first and last letter in the member, then in the representative.
    stretches: into how many the ranks are cut at first; the result does not depend on it.
    """
    o = options.checked()
    with temporary(seqs.sparkSession) as tables:
        search = Search(_longer_than(seqs, o), None, o, tables)
        reps, matches = _greedy(search, tables, stretches)
        members = _assigned(matches, reps, o)
        none = [F.lit(None).cast(members.schema[c].dataType).alias(c) for c in ("identity", "distance", "strand", "span")]
        return stored(reps.select("seq_id", F.col("seq_id").alias("root_id"), *none).unionByName(members), "clusters")


def _first_matches(search: Search, pairs: DataFrame, tables: Tables) -> DataFrame:
    """The matches that can count of a collection's pairs: where the first in order counts, a query's candidates are aligned in this order, one in each round, until one matches."""
    if search.o.best or len(search.strands) > 1:
        return search.matches(pairs)
    order = search.ranks.select(F.col("seq_id").alias("src"), "rank")
    live, found = tables(pairs.join(order, "src").select("src", "dst", "strand", "first_code", "rank"), "live"), []
    for turn in range(ROUNDS + 1):
        if live.isEmpty():
            break
        key = F.struct("first_code", "rank")
        first = live.groupBy("dst").agg(F.min(key).alias("k")).select("dst", F.col("k.rank").alias("rank"))
        now = tables(live.join(first, ["dst", "rank"], "left_semi") if turn < ROUNDS else live, "now")
        found.append(search.matches(now))
        live = tables(_unlike(live.join(now.select("dst", "src"), ["dst", "src"], "left_anti"), found[-1].select(F.col("dst").alias("seq_id")), "dst"), "live")
    return reduce(DataFrame.unionByName, found) if found else search.matches(pairs)


def identity_matches(base: DataFrame, query: DataFrame, options: Options = Options()) -> DataFrame:
    """(seq_id, root_id, identity, distance, strand, span) for each query sequence: the sequence of base that it is assigned to, or nulls if it is novel.

    Every sequence of base is a representative. A query may be longer than its representative as length_ratio_2d and
    most_longer_2d allow. Sequences of at most min_length letters are left out on both sides.
    """
    o = options.checked()
    base, query = _longer_than(base, o), _longer_than(query, o)
    with temporary(base.sparkSession) as tables:
        search = Search(base, query, o, tables)
        matches = _first_matches(search, search.pairs(), tables)
        order = search.ranks.select("seq_id", F.col("rank").alias("ord"))
        return stored(search.query.select("seq_id").join(_assigned(matches, order, o), "seq_id", "left"), "matched")


def parents(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """(seq_id, root_id) for every sequence; those that clustering left out stand for themselves."""
    return seqs.select("seq_id").join(clusters.select("seq_id", "root_id"), "seq_id", "left").select("seq_id", F.coalesce("root_id", "seq_id").alias("root_id"))


def distance_matrix(pairs: DataFrame, seqs: DataFrame, options: Options = Options()) -> DataFrame:
    """(src, dst, distance) of pairs (src, dst): the smaller distance of both orientations, each aligned."""
    rows = coded(seqs, options)
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    got = alignments(both, rows, rows, scoring_of(options), options, filtered=False)
    return got.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("distance").alias("distance"))
