"""Exact-match search of patterns and reads in a doubled text.

One relation answers all queries: the profile of a place of a read, (rid, p, lcp, n): how many places of the text share
exactly `lcp` bases with the read from p on. The longest match is its largest lcp; the longest match with at least c
occurrences is the c-th largest; a match-length spectrum is its running count. A profile comes from one equi-join on the first
`seed` bases: equal stretches of text are counted before they meet the reads, so copies cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases
from . import scan
from .store import durable
from .text import Text, longest, small

#: Patterns shorter than this are looked up among all k-mers of the text, longer ones by their first bases.
SEED = 12
#: First bases by which suffixes are counted for lower bounds: at most 4^8 groups.
HEAD = 8
#: Bases of reads up to which every task gets them, to compare its tiles with.
FEW = 1 << 18


def queries_at(reads: DataFrame, seed: int) -> DataFrame:
    """rid, p, h, q: every place of reads (rid, seq) whose `seed` bases have no N; q: the read from there on, as bytes."""
    rows = reads.select("rid", "seq", F.posexplode(bases.windows("seq", seed)).alias("p", "h")).where(~F.contains("h", F.lit("N")))
    return rows.select("rid", "p", F.col("h").cast("binary").alias("h"), F.expr("substring(cast(seq as binary), p + 1)").alias("q"))


def profile(text: Text, queries: DataFrame, seed: int, most: int, reads: DataFrame | None = None, every: bool = True) -> DataFrame:
    """rid, p, lcp, n for queries (rid, p, h, q); lcp at least `seed`, at most `most` (the longest query). reads (seq): those that the queries are cut from, at
    every place or at the first; where they are few the text is compared with them in place."""
    given = None if reads is None else scan.few(reads, "seq", FEW)
    if given is None:
        found = text.suffixes(most, queries.select("h").distinct(), seed).groupBy("w").agg(F.count("*").alias("n"))
    else:  # what a place shares with any query is all that the next lines look at
        found = scan.matched(text, [(x, range(len(x) if every else 1)) for x in given], seed, most)
    met = queries.join(found.withColumn("h", F.substr("w", F.lit(1), F.lit(seed))), "h")
    return met.groupBy("rid", "p", bases.common_prefix(F.col("q"), F.col("w"), most).alias("lcp")).agg(F.sum("n").alias("n"))


def occurrences(prof: DataFrame) -> DataFrame:
    """rid, p, lcp, n, occ: how often the first lcp bases occur (the running count from the longest on)."""
    w = Window.partitionBy("rid", "p").orderBy(F.desc("lcp")).rowsBetween(Window.unboundedPreceding, 0)
    return prof.withColumn("occ", F.sum("n").over(w))


def longest_matches(prof: DataFrame) -> DataFrame:
    """rid, p, match_len, occ of the longest match at each place."""
    return prof.groupBy("rid", "p").agg(F.max(F.struct("lcp", "n")).alias("x")).select("rid", "p", F.col("x.lcp").alias("match_len"), F.col("x.n").alias("occ"))


def _given(patterns: DataFrame) -> DataFrame:
    rows = patterns.select("pattern").where("pattern is not null and pattern <> ''").distinct()
    return rows.withColumn("b", F.col("pattern").cast("binary"))


def _within(text: Text, given: DataFrame, k: int, most: int) -> DataFrame:
    """b, less, occ for patterns (b) of k bases and more: how many suffixes that share their first k bases sort before them, and
    how many begin with them. Few patterns meet the text where it lies and only counts are dealt. Many are put between
    the suffixes in order, inside each group of k first bases, and counts run over that order: no pairs are made."""
    q = given.select("b", F.substr("b", F.lit(1), F.lit(k)).alias("h"))
    if small(q):
        met = text.suffixes(most, q, k, True).where((F.col("w") < F.col("b")) | F.startswith("w", "b"))
        return met.groupBy("b").agg(F.count_if(F.col("w") < F.col("b")).alias("less"), F.count_if(F.col("w") >= F.col("b")).alias("occ"))
    mark = lambda end: F.concat("b", F.lit(end).cast("binary"))
    found = text.suffixes(most, q.select("h").distinct(), k).groupBy("w").agg(F.count("*").alias("n"))
    found = found.select(F.substr("w", F.lit(1), F.lit(k)).alias("h"), F.col("w").alias("x"), "n", F.lit(None).cast("binary").alias("b"), F.lit(None).cast("boolean").alias("upper"))
    probe = lambda x, upper: q.select("h", x.alias("x"), F.lit(0).cast("long").alias("n"), "b", F.lit(upper).alias("upper"))
    rows = found.unionByName(probe(F.col("b"), False)).unionByName(probe(mark("~"), True))
    # a pattern stands before the suffixes equal to it, its upper mark behind all that begin with it
    order = Window.partitionBy("h").orderBy("x", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0))).where("b is not null")
    lo, hi = (F.max(F.when(F.col("upper") == flag, F.col("below"))) for flag in (False, True))
    return sums.groupBy("b").agg(lo.alias("less"), (hi - lo).alias("occ"))


def _scanned(text: Text, patterns: list[bytes]) -> DataFrame:
    """bounds() of few patterns."""
    stand, ends = {}, {}
    for x in patterns:
        n = len(x) - len(x.lstrip(b"ACGT"))
        more = b"" if n == len(x) else b"".join(b[:1] for b in (b"A", b"C", b"G", b"T") if b > x[n : n + 1])[:1]
        # other letters than ACGT occur nowhere: such a pattern stands where its first one would
        stand[x] = x if n == len(x) else x[:n] + more if more else scan.successor(x[:n])
        ends[x] = scan.successor(x) if n == len(x) else stand[x]
    probes = sorted({*stand.values(), *ends.values()} - {None})
    below, total = scan.below(text, probes)
    known = dict(zip(probes, below.tolist())) | {None: total}
    rows = [(x.decode(), known[stand[x]] + 1, known[ends[x]] - known[stand[x]]) for x in patterns]
    return text.tiles.sparkSession.createDataFrame(rows, "pattern string, sa_start long, occ long")


def pattern_counts(text: Text, patterns: DataFrame) -> DataFrame:
    """pattern, occ for distinct patterns over ACGT (those that don't occur, or hold an N, have 0)."""
    given = _given(patterns)
    if (strings := scan.few(given, "b")) is not None:
        return _scanned(text, strings).select("pattern", "occ")
    sizes = sorted(r[0] for r in given.select(F.least(F.length("pattern"), F.lit(SEED))).distinct().collect())  # at most SEED numbers
    short = [m for m in sizes if m < SEED]
    counts = given.select("b", F.lit(0).cast("long").alias("occ")).limit(0)
    if short:
        mers = text.suffixes(short[-1]).groupBy("w").agg(F.count("*").alias("n"))
        heads = F.explode(F.filter(F.array(*map(F.lit, short)), lambda m: m <= F.octet_length("w"))).alias("m")
        mers = mers.select("n", "w", heads).select(F.substr("w", F.lit(1), F.col("m")).alias("b"), "n")
        counts = mers.join(given.select("b"), "b", "left_semi").groupBy("b").agg(F.sum("n").alias("occ"))
    if SEED in sizes:
        long = given.where(F.length("pattern") >= SEED)
        counts = counts.unionByName(_within(text, long, SEED, longest(long, "pattern")).select("b", "occ"))
    return given.join(counts, "b", "left").select("pattern", F.coalesce("occ", F.lit(0)).cast("long").alias("occ"))


def bounds(text: Text, patterns: DataFrame) -> DataFrame:
    """pattern, sa_start, occ: how many suffixes (the end marker's with them) sort before each distinct pattern, and how many
    begin with it. Few patterns are put among the suffixes in one pass. Many take two: one counts first bases, the other the suffixes under a pattern's
    first bases."""
    given = _given(patterns)
    if (strings := scan.few(given, "b")) is not None:
        return _scanned(text, strings)
    mark = F.substr("b", F.lit(1), F.lit(HEAD))
    heads = text.suffixes(HEAD).groupBy("w").agg(F.count("*").alias("n")).select(F.col("w").alias("b"), "n", F.lit(0).alias("probe"))
    # at most 4^HEAD text heads and as many pattern heads: one ordered pass over a constant number of rows
    both = heads.unionByName(given.select(mark.alias("b"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("probe")).distinct())
    order = Window.orderBy("b", F.desc("probe")).rowsBetween(Window.unboundedPreceding, -1)
    below = both.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)) + 1).where("probe = 1").select(F.col("b").alias("h"), "below")
    less = F.explode(F.sequence(F.lit(1), F.least(F.octet_length("b"), F.lit(HEAD - 1)))).alias("m")
    short = heads.select("b", "n", less).groupBy(F.substr("b", F.lit(1), F.col("m")).alias("b")).agg(F.lit(0).cast("long").alias("less"), F.sum("n").alias("occ"))
    long = given.where(F.octet_length("b") >= HEAD)
    inside = _within(text, long, HEAD, max(HEAD, longest(given, "pattern"))).unionByName(short)
    zero = F.lit(0).cast("long")
    rows = given.withColumn("h", mark).join(below, "h").join(inside, "b", "left")
    return rows.select("pattern", (F.col("below") + F.coalesce("less", zero)).cast("long").alias("sa_start"), F.coalesce("occ", zero).cast("long").alias("occ"))


def lower_bounds(text: Text, patterns: DataFrame) -> DataFrame:
    """pattern, sa_start: how many suffixes (the end marker's with them) sort before each distinct pattern."""
    return bounds(text, patterns).select("pattern", "sa_start")


def intervals(text: Text, patterns: DataFrame) -> DataFrame:
    """pattern, sa_start, occ; sa_start 0 where the pattern doesn't occur."""
    return bounds(text, patterns).select("pattern", F.when(F.col("occ") > 0, F.col("sa_start")).otherwise(0).cast("long").alias("sa_start"), "occ")


def kmer_exists(text: Text, patterns: DataFrame) -> DataFrame:
    return pattern_counts(text, patterns).select("pattern", (F.col("occ") > 0).alias("found"))


def prefixes(queries: DataFrame, most: int) -> DataFrame:
    """qid, m, pattern: the first 1 to `most` bases of queries (qid, seq), up to their first N."""
    n = F.least(F.position(F.lit("N"), F.concat("seq", F.lit("N"))) - 1, F.lit(most))
    m = F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("m")
    return queries.select(F.col("qid"), "seq", m).select("qid", "m", F.left("seq", "m").alias("pattern"))


def prefix_runs(text: Text, queries: DataFrame) -> DataFrame | None:
    """qid, lo, hi, occ, sa_start, place: match_counts() with where the first hi bases stand among the suffixes, and the first place that they are at, by one
    pass over the text; None if the queries (qid, seq) are not few."""
    if (given := scan.few(queries, "seq", FEW)) is None:
        return None
    heads = {x: x[: len(x) - len(x.lstrip(b"ACGT"))] for x in given}
    found = scan.prefix_runs(text, sorted({*heads.values()} - {b""}))
    rows = [(x.decode(), *run) for x in given for run in found.get(heads[x], [])]
    runs = text.tiles.sparkSession.createDataFrame(rows, "seq string, lo int, hi int, occ long, sa_start long, place long")
    return queries.select("qid", "seq").join(F.broadcast(runs), "seq").drop("seq")


def match_counts(text: Text, queries: DataFrame, table: DataFrame | None = None, k: int = 0) -> DataFrame:
    """qid, lo, hi, occ: the first lo to hi bases of a query (qid, seq) occur `occ` times; only where occ > 0.

    Few queries are answered by one pass. For many, under SEED bases each length is counted by itself, up to k bases from a k-mer table (m, w, lo, hi)
    where one is given, beyond by the profile.
    """
    if table is None and (runs := prefix_runs(text, queries)) is not None:
        return runs.drop("sa_start", "place")
    most = longest(queries)
    short = prefixes(queries, SEED - 1)
    if table is not None:
        known = short.where(F.col("m") <= k).withColumn("w", bases.lex_index("pattern")).join(table, ["m", "w"]).where("hi > lo")
        known = known.select("qid", F.col("m").alias("lo"), F.col("m").alias("hi"), (F.col("hi") - F.col("lo")).cast("long").alias("occ"))
        short = short.where(F.col("m") > k)
    counts = short.join(pattern_counts(text, short), "pattern").where("occ > 0").select("qid", F.col("m").alias("lo"), F.col("m").alias("hi"), "occ")
    counts = counts if table is None else counts.unionByName(known)
    if most < SEED:
        return counts
    b = F.col("seq").cast("binary")
    q = queries.where(~F.contains(F.left("seq", F.lit(SEED)), F.lit("N")) & (F.length("seq") >= SEED))
    q = q.select(F.col("qid").alias("rid"), F.lit(0).alias("p"), F.substr(b, F.lit(1), F.lit(SEED)).alias("h"), b.alias("q"))
    occ = occurrences(profile(text, q, SEED, most, queries, False))
    under = F.lead("lcp").over(Window.partitionBy("rid").orderBy(F.desc("lcp")))
    return counts.unionByName(occ.select(F.col("rid").alias("qid"), (F.coalesce(under, F.lit(SEED - 1)) + 1).alias("lo"), F.col("lcp").alias("hi"), "occ"))


def with_starts(text: Text, steps: DataFrame, queries: DataFrame) -> DataFrame:
    """steps (qid, match_len, ...) with sa_start of the query's first match_len bases."""
    rows = durable(steps.join(queries, "qid").withColumn("pattern", F.left("seq", "match_len")).drop("seq"))
    return rows.join(lower_bounds(text, rows), "pattern").drop("pattern")


def forward_spectrum(text: Text, queries: DataFrame, starts: bool = True, table: DataFrame | None = None, k: int = 0) -> DataFrame:
    """qid, step_no, sa_start, occ, match_len: a row for each count that prefixes of a query have, with the longest of them.
    table: the k-mer table of the text, which answers the first k lengths."""
    number = F.row_number().over(Window.partitionBy("qid").orderBy("match_len")) - 1
    if table is None and (runs := prefix_runs(text, queries)) is not None:
        steps = runs.withColumnRenamed("hi", "match_len").withColumn("step_no", number)
        return steps.select("qid", "occ", "match_len", "step_no", *["sa_start"] * starts)
    steps = match_counts(text, queries, table, k).groupBy("qid", "occ").agg(F.max("hi").alias("match_len"))
    steps = steps.withColumn("step_no", number)
    return with_starts(text, steps, queries) if starts else steps


def mem_search(text: Text, queries: DataFrame, starts: bool = False, most_occ: int | None = None) -> DataFrame:
    """qid, match_len, occ (and sa_start): the longest prefix of each query that occurs; zeros if none.

    most_occ: the count stops at most_occ + 1, and sa_start is null there.
    """
    runs = prefix_runs(text, queries)
    counts = match_counts(text, queries) if runs is None else runs
    known = ["hi", "occ"] + ["sa_start"] * (starts and runs is not None)
    best = counts.groupBy("qid").agg(F.max(F.struct(*known)).alias("x")).select("qid", "x.*").withColumnRenamed("hi", "match_len")
    if starts and runs is None:
        best = with_starts(text, best, queries)
    if most_occ is not None:
        best = best.withColumn("occ", F.least("occ", F.lit(most_occ + 1)))
        if starts:
            best = best.withColumn("sa_start", F.when(F.col("occ") <= most_occ, F.col("sa_start")))
    zero = F.lit(0).cast("long")
    out = queries.select("qid").join(best, "qid", "left").withColumn("match_len", F.coalesce("match_len", F.lit(0))).withColumn("occ", F.coalesce("occ", zero))
    return out.withColumn("sa_start", F.when(F.col("match_len") == 0, zero).otherwise(F.col("sa_start"))) if starts else out


def truncated(text: Text, queries: DataFrame, least_occ: int, anchor: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """qid, match_len, occ: the longest prefix with at least `least_occ` occurrences; not under `anchor`, whose count stands then. counts: those
    of match_counts(), where they are known (so for the next two)."""
    counts = match_counts(text, queries) if counts is None else counts
    good = counts.where((F.col("occ") >= least_occ) & (F.col("hi") >= anchor)).groupBy("qid").agg(F.max(F.struct("hi", "occ")).alias("x"))
    floor = counts.where((F.col("lo") <= anchor) & (F.col("hi") >= anchor)).select("qid", F.col("occ").alias("floor_occ"))
    rows = queries.select("qid").join(good, "qid", "left").join(floor, "qid", "left")
    return rows.select("qid", F.coalesce("x.hi", F.lit(anchor)).alias("match_len"), F.coalesce("x.occ", "floor_occ", F.lit(0)).cast("long").alias("occ"))


def truncate_below_maximal(text: Text, queries: DataFrame, least_occ: int, counts: DataFrame | None = None) -> DataFrame:
    """qid, match_len, occ: the longest prefix shorter than the maximal match with at least `least_occ` occurrences; no row if none."""
    counts = match_counts(text, queries) if counts is None else counts
    top = counts.groupBy("qid").agg(F.max("hi").alias("top"))
    rows = counts.join(top, "qid").withColumn("hi", F.least("hi", F.col("top") - 1)).where((F.col("hi") >= F.col("lo")) & (F.col("occ") >= least_occ))
    return rows.groupBy("qid").agg(F.max(F.struct("hi", "occ")).alias("x")).select("qid", F.col("x.hi").alias("match_len"), F.col("x.occ").alias("occ"))


def first_below(text: Text, queries: DataFrame, longer_than: int, fewer_than: int, counts: DataFrame | None = None) -> DataFrame:
    """qid, match_len, occ: the first length over `longer_than` with under `fewer_than` occurrences (0 too, within the query); no row if none."""
    counts = match_counts(text, queries) if counts is None else counts
    ends = counts.groupBy("qid").agg((F.max("hi") + 1).alias("lo"))
    size = F.position(F.lit("N"), F.concat("seq", F.lit("N"))) - 1
    none = queries.select("qid", size.alias("hi")).join(ends, "qid", "left").select("qid", F.coalesce("lo", F.lit(1)).alias("lo"), "hi", F.lit(0).cast("long").alias("occ"))
    rows = counts.unionByName(none).withColumn("lo", F.greatest("lo", F.lit(longer_than + 1))).where((F.col("lo") <= F.col("hi")) & (F.col("occ") < fewer_than))
    return rows.groupBy("qid").agg(F.min(F.struct("lo", "occ")).alias("x")).select("qid", F.col("x.lo").alias("match_len"), F.col("x.occ").alias("occ"))


def backwards(anchors: DataFrame) -> DataFrame:
    """qid, seq: what lies left of the end of each anchor (qid, seq, pivot, anchor), as its reverse complement: a left extension
    of an anchor is a right extension there, and both occur equally often in a doubled text."""
    return anchors.select("qid", bases.reverse_complement(F.left("seq", F.col("pivot") + F.col("anchor"))).alias("seq"))


def backward_spectrum(text: Text, anchors: DataFrame) -> DataFrame:
    """qid, step_no, match_len, occ: read[pivot - j : pivot + anchor] for j = 1, 2, ... while it occurs; a row for each j."""
    counts = match_counts(text, backwards(anchors)).join(anchors.select("qid", "anchor"), "qid")
    m = F.explode(F.sequence(F.greatest("lo", F.col("anchor") + 1), "hi")).alias("match_len")
    rows = counts.where(F.col("hi") > F.col("anchor")).select("qid", "anchor", "occ", m)
    return rows.select("qid", (F.col("match_len") - F.col("anchor") - 1).alias("step_no"), "match_len", "occ")


def mem_search_backward(text: Text, anchors: DataFrame) -> DataFrame:
    """qid, match_len, occ of the deepest left extension of each anchor; the anchor itself if none, zeros if it doesn't occur."""
    best = mem_search(text, backwards(anchors)).join(anchors.select("qid", "anchor"), "qid")
    short = F.col("match_len") < F.col("anchor")
    return best.select("qid", F.when(short, 0).otherwise(F.col("match_len")).alias("match_len"), F.when(short, 0).otherwise(F.col("occ")).cast("long").alias("occ"))


def _hinted(sa: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (hint) with pos, the place of the suffix of rank `hint`; none for rank 0 (the end marker's) and ranks that don't exist."""
    return rows.where("hint > 0").join(sa.select(F.col("rank").alias("hint"), "pos"), "hint")


def _hint_results(text: Text, rows: DataFrame, found: DataFrame, interval: bool) -> DataFrame:
    """qid, match_len (and sa_start, occ of the pattern) of found (qid, match_len, pattern); zeros for the other rows."""
    cols = ["match_len"]
    if interval:
        found = durable(found)
        found, cols = found.join(bounds(text, found.where("match_len > 0")), "pattern", "left"), ["match_len", "sa_start", "occ"]
    zero = F.lit(0).cast("long")
    return rows.select("qid").join(found, "qid", "left").select("qid", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in cols])


def from_hint(text: Text, sa: DataFrame, queries: DataFrame, interval: bool = False) -> DataFrame:
    """qid, match_len (and sa_start, occ of as many bases): how many bases each query (qid, seq, hint) shares with the suffix of
    rank `hint`. Where that suffix begins with the query's longest match this is what mem_search gives. Zeros without a hint."""
    most = longest(queries)
    shared = bases.common_prefix(F.col("seq").cast("binary"), F.col("w"), most)
    found = text.at(_hinted(sa, queries), most).select("qid", "seq", shared.alias("match_len"))
    return _hint_results(text, queries, found.select("qid", "match_len", F.left("seq", "match_len").alias("pattern")), interval)


def backward_from_hint(text: Text, sa: DataFrame, anchors: DataFrame, interval: bool = False) -> DataFrame:
    """qid, match_len (and sa_start, occ of the whole span): how far each anchor (qid, seq, pivot, anchor, hint) reaches to the left
    at the place of rank `hint`, its own bases counted. What lies left of a place is, turned round, what follows its mirror place."""
    rows = _hinted(sa, anchors).withColumn("pos", F.lit(text.total) - F.col("pos"))
    left = anchors.agg(F.coalesce(F.max("pivot"), F.lit(0))).first()[0]
    turned = bases.reverse_complement(F.left("seq", "pivot")).cast("binary")
    more = F.lit(0) if not left else bases.common_prefix(turned, F.col("w"), int(left))
    found = text.at(rows, max(int(left), 1)).withColumn("more", more).select("qid", (F.col("anchor") + F.col("more")).alias("match_len"), F.expr("substring(seq, pivot - more + 1, anchor + more)").alias("pattern"))
    return _hint_results(text, anchors, found, interval)


def range32(text: Text, reads: DataFrame, pivots: list[int]) -> DataFrame:
    """rid, pivot, occ: the 32-mer of each read at each pivot; 0 past the end or over an N."""
    rows = reads.select("rid", "seq", F.explode(F.array(*[F.lit(p) for p in pivots])).alias("pivot"))
    rows = rows.withColumn("w", F.expr("substring(seq, pivot + 1, 32)"))
    whole = rows.where((F.length("w") == 32) & ~F.contains("w", F.lit("N")))
    asked = whole.select(F.col("w").cast("binary").alias("w")).distinct()
    if (strings := scan.few(asked, "w")) is None:
        counts = text.windows(32).join(asked, "w", "left_semi").groupBy("w").agg(F.count("*").alias("occ"))
    else:
        counts = scan.matched(text, [(x, range(1)) for x in strings], 32, 32).withColumnRenamed("n", "occ")
    found = whole.join(counts.withColumn("w", F.col("w").cast("string")), "w").select("rid", "pivot", "occ")
    return rows.select("rid", "pivot").join(found, ["rid", "pivot"], "left").select("rid", "pivot", F.coalesce("occ", F.lit(0)).cast("long").alias("occ"))
