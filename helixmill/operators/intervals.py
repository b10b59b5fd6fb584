"""Interval joins and what is counted on them. Intervals are half-open and 0-based, on a contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.ranks import running_sums

#: Bins of level i are 128 * 8^i bases wide: 128, 1024, ... 2^34. An interval's own level is the lowest whose bins are as wide as it is long, so it touches two bins at most.
FIRST_SHIFT, SHIFT, LEVELS = 7, 3, 10


def level_of(start: str, end: str) -> Column:
    """The lowest level with bins no narrower than the interval; the last for all that are wider still."""
    size, out = F.col(end) - F.col(start), F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        out = F.when(size <= 1 << (FIRST_SHIFT + SHIFT * i), i).otherwise(out)
    return out


def bin_of(position: Column, level: Column) -> Column:
    return F.call_function("shiftright", position.cast("bigint"), (FIRST_SHIFT + SHIFT * level).cast("int"))


def levels_in(rows: DataFrame, start: str, end: str) -> DataFrame:
    """The levels that occur, as the column `there` of at most ten rows."""
    return rows.select(level_of(start, end).alias("there")).distinct()


def overlap_join(left: DataFrame, right: DataFrame, contig: str = "contig", l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("f_start", "f_end"), levels: tuple[list[int] | None, list[int] | None] = (None, None)) -> DataFrame:  # noqa: E741
    """Pairs of rows of the same contig that share a base, for intervals of any length.

    Two intervals meet at the level of the longer one, where each touches two bins at most. The longer one is sent to its own
    level only; the other to those levels above its own that the other side has at all. So an interval has at most two rows a
    level of the other side, and one of a chromosome's length no more than one of a read's. Which levels occur is read from
    both sides first (at most ten numbers each, broadcast with what is sent where); give `levels` where they are known
    (points: [0]).

    A pair meets in its first common bin only, so nothing repeats. It is an equi join on (contig, level, bin): a contig's rows
    spread over its bins, and Spark splits the partitions of deep bins (spark.sql.adaptive.skewJoin) on both sides. Empty
    intervals and null places meet nothing. The columns _own, _level and _bin are in the way.
    """
    spark = left.sparkSession
    sides = [(x.where(F.col(c[0]) < F.col(c[1])), c) for x, c in ((left, l), (right, r))]
    there = [levels_in(x, *c) if own is None else spark.createDataFrame([(i,) for i in own], "there int") for (x, c), own in zip(sides, levels)]

    def keyed(mine: int) -> DataFrame:
        """A row a (level and whose level it is, bin); equal levels meet on the right side's."""
        rows, (start, end) = sides[mine]
        own, theirs = F.col("_own"), F.col("there")
        above = theirs >= own if mine == 0 else theirs > own
        code = F.when(above, theirs * 2 + 1 - mine).otherwise(own * 2 + mine)
        sent = spark.range(LEVELS).select(F.col("id").cast("int").alias("_own")).crossJoin(F.broadcast(there[1 - mine])).select("_own", code.alias("_level")).distinct()
        rows = rows.withColumn("_own", level_of(start, end)).join(F.broadcast(sent), "_own").drop("_own")
        level = F.call_function("shiftright", F.col("_level"), F.lit(1))
        return rows.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), level), bin_of(F.col(end) - 1, level))))

    met = keyed(0).join(keyed(1), [contig, "_level", "_bin"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0])))
    return met.where(F.col("_bin") == bin_of(F.greatest(l[0], r[0]), F.call_function("shiftright", F.col("_level"), F.lit(1)))).drop("_level", "_bin")


def shared_bases(a0: str | Column = "start", a1: str | Column = "end", b0: str = "f_start", b1: str = "f_end") -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def strict_overlap(pairs: DataFrame, share: float) -> DataFrame:
    """Of the pairs of overlap_join, those that cover at least `share` of the left interval."""
    return pairs.where(shared_bases() / (F.col("end") - F.col("start")) >= share)


def places_of(marks: DataFrame, rows: DataFrame, places: dict[str, Column], contig: str = "contig") -> DataFrame:
    """(contig, at, sums of the marks' other columns): a row a place that a mark has or that the rows ask for."""
    sums = [c for c in marks.columns if c not in (contig, "at")]
    asked = rows.select(contig, F.explode(F.array(*(c.cast("bigint") for c in places.values()))).alias("at"), *(F.lit(0).cast("bigint").alias(c) for c in sums))
    both = marks.select(contig, F.col("at").cast("bigint").alias("at"), *(F.col(c).cast("bigint").alias(c) for c in sums)).unionByName(asked)
    return both.where(F.col(contig).isNotNull() & F.col("at").isNotNull()).groupBy(contig, "at").agg(*(F.sum(c).alias(c) for c in sums))


def read_off(rows: DataFrame, table: DataFrame, places: dict[str, Column], contig: str = "contig") -> DataFrame:
    """The rows with <place>_<column> of the table's row at each place; 0 where a place or the contig is null."""
    values = [c for c in table.columns if c not in (contig, "at")]
    for name, at in places.items():
        own = table.select(F.col(contig).alias("_on"), F.col("at").alias("_at"), *(F.col(c).alias(f"{name}_{c}") for c in values))
        rows = rows.join(own, (F.col(contig) == F.col("_on")) & (at.cast("bigint") == F.col("_at")), "left").drop("_on", "_at")
    return rows.withColumns({f"{n}_{c}": F.coalesce(f"{n}_{c}", F.lit(0).cast("bigint")) for n in places for c in values})


def sums_upto(marks: DataFrame, rows: DataFrame, places: dict[str, Column], contig: str = "contig") -> DataFrame:
    """The rows with <place>_<column>: the sum of the column over the marks (contig, at, columns) of the row's contig at the place or before it.

    Marks are combined a place first; the sums run in ranges of places (running_sums) and are looked up, so the work is that of sorting both sides.
    """
    table = places_of(marks, rows, places, contig)
    sums = [c for c in table.columns if c not in (contig, "at")]
    table = running_sums(table, [contig], "at", {f"_u{c}": c for c in sums}).select(contig, "at", *(F.col(f"_u{c}").alias(c) for c in sums))
    return read_off(rows, table, places, contig)


def overlap_counts(left: DataFrame, right: DataFrame, kinds: dict[str, Column], contig: str = "contig", l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("f_start", "f_end")) -> DataFrame:  # noqa: E741
    """Adds to each left row, for each kind, how many right rows of that kind (a condition) overlap_join would pair it with. No pair is made.

    All that start before a row's end meet it, less those that end at its start or before: two running counts, read off at two places.
    """
    end = lambda c, first: F.struct(F.col(c).alias("at"), *(F.coalesce(k.cast("bigint"), F.lit(0)).alias(f"{x}{i}") if x == first else F.lit(0).cast("bigint").alias(f"{x}{i}") for i, k in enumerate(kinds.values()) for x in "se"))
    marks = right.where(F.col(r[0]) < F.col(r[1])).select(contig, F.explode(F.array(end(r[0], "s"), end(r[1], "e"))).alias("_m")).select(contig, "_m.*")
    met = sums_upto(marks, left, {"_a": F.col(l[0]), "_b": F.col(l[1]) - 1}, contig)
    some = F.col(l[0]) < F.col(l[1])
    return met.select(*left.columns, *(F.when(some, F.col(f"_b_s{i}") - F.col(f"_a_e{i}")).otherwise(0).alias(k) for i, k in enumerate(kinds)))


def without_overlap(left: DataFrame, right: DataFrame, key: list[str], **kw) -> DataFrame:
    """Left rows less all whose key has a row that overlap_join would pair."""
    return left.join(overlap_counts(left, right, {"_met": F.lit(True)}, **kw).where("_met > 0").select(*key), key, "left_anti")


def merged(intervals: DataFrame, by: list[str] = ["contig"], start: str = "start", end: str = "end", width: int = 1 << 16) -> DataFrame:
    """Overlapping or touching intervals joined, per group.

    First inside bins of starts, then across: a bin's islands need only the furthest end and the last island's start of the bins before it,
    and only these two numbers a bin meet in one task of a group.
    """
    w = Window.partitionBy(*by, "_bin").orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(*by, start, end, F.floor(F.col(start) / width).alias("_bin")).withColumn("_far", far).withColumn("_new", F.when(F.col("_far").isNull() | (F.col(start) > F.col("_far")), 1).otherwise(0))
    small = marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*by, "_bin", "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    far_before = _of_bins_before(small, by, F.max(end), "_far")
    first = far_before.withColumn("_first", F.when(F.col("_far").isNull() | (F.col(start) > F.col("_far")), F.col(start)))
    known = _of_bins_before(first, by, F.max("_first"), "_last")
    own = F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("_at", F.coalesce(own, "_last")).groupBy(*by, "_at").agg(F.max(end).alias(end)).select(*by, F.col("_at").alias(start), end)


def _of_bins_before(rows: DataFrame, by: list[str], most: Column, out: str) -> DataFrame:
    """Adds the largest of an aggregate over the bins before a row's; null in the first."""
    keys = [f"_k{i}" for i in range(len(by))]
    bins = rows.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("_bin").alias("_b")).agg(most.alias(out))
    bins = bins.withColumn(out, F.max(out).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(bins, [F.col("_bin") == F.col("_b"), *(F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys))]).drop("_b", *keys)


def restrict_loci(loci: DataFrame, spans: DataFrame, least: int, key: list[str]) -> DataFrame:
    """Loci of at least `least` bases that meet the union of the spans."""
    union = merged(spans).withColumnsRenamed({"start": "f_start", "end": "f_end"})
    long = loci.where(F.col("end") - F.col("start") >= least)
    return long.join(overlap_join(long, union).select(*key).distinct(), key, "left_semi")


def has(flag: str, bit: int) -> Column:
    return F.col(flag).bitwiseAND(bit) != 0


def proper_pairs(alignments: DataFrame, qname: str = "qname", flag: str = "flag", keep: list[str] = ["contig", "start", "end"]) -> DataFrame:
    """One row per pair of first and second mates that are properly paired, primary and not supplementary."""
    good = alignments.where(has(flag, 2) & ~has(flag, 256) & ~has(flag, 2048))
    side = lambda bit, n: good.where(has(flag, bit)).select(qname, *(F.col(c).alias(f"{c}_{n}") for c in keep))
    return side(64, 1).join(side(128, 2), qname)


def five_prime_hits(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads whose ends lie in 5' windows, under three conventions: strand_matched (the read's 5' end, strands agree), position_matched (either end, the one at the window's own 5' side), either_end (once per read and gene).

    reads: read, contig, start, end, strand. windows: gene, contig, f_start, f_end, f_strand. Returns gene and three counts.

    Ends in a window are counted from running sums. A read with several ends there counts once under either_end: of its ends in
    order, each one that is in the window with the one before it is taken off again; such neighbours are combined by place before
    they meet windows. Genes of several windows take pairs of reads and windows.
    """
    sized = windows.withColumn("_n", F.count("*").over(Window.partitionBy("gene")))
    one, several = sized.where("_n = 1").drop("_n"), sized.where("_n > 1").drop("_n")
    point = lambda at, side: F.struct(at.cast("bigint").alias("at"), F.lit(side).alias("side"))
    ends = reads.select("read", "contig", "strand", F.explode(F.array(point(F.col("start"), "+"), point(F.col("end") - 1, "-"))).alias("e")).select("read", "contig", "strand", "e.*")
    own, plus = F.col("side") == F.col("strand"), F.col("side") == "+"
    flags = {"all": F.lit(True), "known": F.col("read").isNotNull(), "plus": plus, "minus": ~plus, "own_plus": own & plus, "own_minus": own & ~plus}
    marks = ends.select("contig", "at", *(F.coalesce(v.cast("bigint"), F.lit(0)).alias(k) for k, v in flags.items()))
    got = sums_upto(marks, one, {"_a": F.col("f_start") - 1, "_b": F.col("f_end") - 1})
    inside = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    on = lambda a, b: F.when(F.col("f_strand") == "+", inside(a)).when(F.col("f_strand") == "-", inside(b)).otherwise(0)
    got = got.where("f_start < f_end").select(*windows.columns, inside("all").alias("_all"), inside("known").alias("_known"), on("own_plus", "own_minus").alias("strand_matched"), on("plus", "minus").alias("position_matched")).where("_all > 0")
    # neighbours (p, q) among a read's ends on a contig, no wider apart than the widest window
    whole = reads.where(F.col("read").isNotNull() & F.col("contig").isNotNull()).groupBy("contig", "read").agg(F.array_sort(F.flatten(F.collect_list(F.array(F.col("start").cast("bigint"), (F.col("end") - 1).cast("bigint"))))).alias("_p"))
    near = whole.select("contig", F.explode(F.arrays_zip(F.slice("_p", F.lit(1), F.size("_p") - 1).alias("p"), F.slice("_p", F.lit(2), F.size("_p") - 1).alias("q"))).alias("_e")).select("contig", F.col("_e.p").alias("start"), (F.col("_e.q") + 1).alias("end"))
    widest = one.agg(F.max(F.col("f_end") - F.col("f_start")).alias("_widest"))
    near = near.crossJoin(F.broadcast(widest)).where(F.col("end") - F.col("start") <= F.col("_widest")).groupBy("contig", "start", "end").agg(F.count("*").alias("_pairs"))
    spans = one.where("f_start < f_end").select("contig", "f_start", "f_end").distinct()
    twice = overlap_join(near, spans).where((F.col("start") >= F.col("f_start")) & (F.col("end") <= F.col("f_end"))).groupBy("contig", "f_start", "f_end").agg(F.sum("_pairs").alias("_twice"))
    got = got.join(twice, ["contig", "f_start", "f_end"], "left").select("gene", "strand_matched", "position_matched", (F.col("_known") - F.coalesce("_twice", F.lit(0))).alias("either_end"))
    if not several.take(1):
        return got
    met = overlap_join(ends.select("read", "contig", "strand", F.col("at").alias("start"), (F.col("at") + 1).alias("end"), "side"), several, levels=([0], None))
    rest = met.groupBy("gene").agg(F.count_if(own & (F.col("f_strand") == F.col("strand"))).alias("strand_matched"), F.count_if(F.col("side") == F.col("f_strand")).alias("position_matched"), F.count_distinct("read").alias("either_end"))
    return got.unionByName(rest)


def cigar_blocks(df: DataFrame, cigar: str = "cigar", start: str = "start") -> DataFrame:
    """A row per aligned stretch (M, = or X) with b_start and b_end on the reference; D and N move on, the rest doesn't."""
    sizes = F.transform(F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+)[MIDNSHP=X]"), 1), lambda x: x.cast("int"))
    ops = F.regexp_extract_all(F.col(cigar), F.lit(r"\d+([MIDNSHP=X])"), 1)
    parts = df.select("*", F.posexplode(F.arrays_zip(sizes.alias("n"), ops.alias("op"))).alias("_i", "_p"), sizes.alias("_n"), ops.alias("_o"))
    moved = F.aggregate(F.slice(F.arrays_zip(F.col("_n").alias("n"), F.col("_o").alias("op")), F.lit(1), F.col("_i")), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0))
    out = parts.where(F.col("_p.op").isin("M", "=", "X")).withColumn("b_start", F.col(start) + moved)
    return out.withColumn("b_end", F.col("b_start") + F.col("_p.n")).drop("_i", "_p", "_n", "_o")


#: Reads of up to so many stretches have them added one by one in full_length; those of more go over theirs in a loop, which is slower.
FEW = 4


def full_length(reads: DataFrame, elements: DataFrame, share: float = 0.8, utr: int = 909) -> DataFrame:
    """(read, gene, covered, full): aligned bases of a read in an element; full if they are `share` of its body and the read's 5' end is in its first `utr` bases.

    All stretches of a read meet an element as one row, so a pair is made once and its bases are added inside it: reads and
    elements are shuffled, pairs are not. Rows of a read at one place count together, as do equal elements.
    """
    place, body = ["read", "contig", "strand", "r_start", "r_end"], ["gene", "contig", "f_start", "f_end", "f_strand"]
    blocks = cigar_blocks(reads).select("read", "contig", "strand", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "b_start", "b_end").where("b_start < b_end")
    whole = blocks.groupBy(*place).agg(F.collect_list(F.struct("b_start", "b_end")).alias("_b")).select(*place, F.col("_b.b_start").alias("_starts"), F.col("_b.b_end").alias("_ends"))
    whole = whole.withColumns({"_from": F.array_min("_starts"), "_to": F.array_max("_ends")})
    bodies = elements.groupBy(*body).agg(F.count("*").alias("_times"))
    inside = lambda a, b: shared_bases(a, b).cast("bigint")
    few = sum((F.when(F.size("_starts") > i, inside(F.get("_starts", F.lit(i)), F.get("_ends", F.lit(i)))).otherwise(0) for i in range(1, FEW)), inside(F.get("_starts", F.lit(0)), F.get("_ends", F.lit(0))))
    rest = lambda c: F.slice(c, F.lit(FEW + 1), F.size(c) - FEW)
    more = F.aggregate(F.zip_with(rest("_starts"), rest("_ends"), inside), F.lit(0).cast("bigint"), lambda n, x: n + x)
    # which levels reads may have: all up to that of the numbers of a CIGAR together, which no read is wider than; the rows are grouped once that way
    widest = reads.select(F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)"), 1), F.lit(0).cast("bigint"), lambda n, x: n + x.cast("bigint")).alias("_to"), F.lit(0).cast("bigint").alias("_from")).select(level_of("_from", "_to").alias("_l")).agg(F.max("_l"))
    levels = [*range(1 + (widest.first()[0] or 0))]
    met = overlap_join(whole, bodies, l=("_from", "_to"), levels=(levels, None))
    got = met.withColumn("covered", (few + F.when(F.size("_starts") > FEW, more).otherwise(0)) * F.col("_times")).where("covered > 0")
    five = F.when(F.col("strand") == "-", F.col("r_end") - 1).otherwise(F.col("r_start"))
    size = F.least(F.lit(utr), F.col("f_end") - F.col("f_start"))
    first = F.when(F.col("f_strand") == "+", (five >= F.col("f_start")) & (five < F.col("f_start") + size)).otherwise((five >= F.col("f_end") - size) & (five < F.col("f_end")))
    enough = F.col("covered") / (F.col("f_end") - F.col("f_start")) >= share
    return got.select("read", "gene", "covered", (enough & first & (F.col("strand") == F.col("f_strand"))).alias("full"))


def start_profile(reads: DataFrame, elements: DataFrame, bins: int = 20) -> DataFrame:
    """Where reads of an element's strand start along it: bin, n, and n over what even starts would give."""
    five = F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start"))
    points = reads.withColumn("start", five).withColumn("end", F.col("start") + 1)
    met = overlap_join(points, elements, levels=([0], None)).where(F.col("strand") == F.col("f_strand"))
    along = F.when(F.col("f_strand") == "+", F.col("start") - F.col("f_start")).otherwise(F.col("f_end") - 1 - F.col("start")) / (F.col("f_end") - F.col("f_start"))
    out = met.groupBy(F.least(F.floor(along * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = out.agg(F.sum("n").alias("_all"))
    return out.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") * bins / F.col("_all")).alias("enrichment"))


def track_flags(loci: DataFrame, elements: DataFrame, key: str, tracks: list[str], composites: dict[str, list[str]] = {}) -> DataFrame:
    """A flag per track that has an element on the locus, and composites that are true if any member is."""
    counts = overlap_counts(loci, elements, {f"_n{i}": F.col("track") == t for i, t in enumerate(tracks)})
    met = counts.groupBy(key).agg(*(F.bool_or(F.col(f"_n{i}") > 0).alias(f"in_{t}") for i, t in enumerate(tracks)))
    out = loci.join(met, key, "left").withColumns({f"in_{t}": F.coalesce(F.col(f"in_{t}"), F.lit(False)) for t in tracks})
    any_of = lambda ts: F.greatest(*(F.col(f"in_{t}") for t in ts)) if len(ts) > 1 else F.col(f"in_{ts[0]}")
    return out.withColumns({name: any_of(ts) for name, ts in composites.items()})


def coverage(features: DataFrame, reads: DataFrame, key: str, tile: int = 1 << 20) -> DataFrame:
    """Reads, covered bases and mean depth of each feature (key, contig, f_start, f_end), 0 without reads; a row a row of features.

    No pair is made: the bases of all reads before a place are a running sum of their starts and ends, and so are those of their
    islands, whose borders are where the depth leaves 0 or comes back to it. A feature takes the differences of its two places.
    `tile` has no effect any more: no sum goes over a pair's bases.
    """
    own = [key, "contig", "f_start", "f_end"]
    step = lambda c, s, e: F.struct(F.col(c).cast("bigint").alias("at"), F.lit(s).alias("starts"), F.lit(e).alias("ends"))
    marks = reads.where(F.col("start") < F.col("end")).select("contig", F.explode(F.array(step("start", 1, 0), step("end", 0, 1))).alias("_m")).select("contig", "_m.*")
    places = {"_a": F.col("f_start"), "_b": F.col("f_end")}
    at = F.col("at")
    table = places_of(marks, features, places).withColumn("moved", at * (F.col("starts") - F.col("ends")))
    table = running_sums(table, ["contig"], "at", {"s": "starts", "e": "ends", "m": "moved"})
    depth = F.col("s") - F.col("e")
    before = depth - F.col("starts") + F.col("ends")
    border = F.when((before == 0) & (depth > 0), 1).when((before > 0) & (depth == 0), -1).otherwise(0).cast("bigint")
    table = table.select("contig", "at", "starts", "s", "e", (at * depth - F.col("m")).alias("bases"), border.alias("border")).withColumn("moved", at * F.col("border"))
    table = running_sums(table, ["contig"], "at", {"i": "border", "m": "moved"})
    table = table.select("contig", "at", "starts", "s", "e", "bases", (at * F.col("i") - F.col("m")).alias("covered"))
    out, some = read_off(features.select(*own), table, places), F.col("f_start") < F.col("f_end")
    here = lambda n: F.when(some, n).otherwise(0)
    reads_in, grown = F.col("_b_s") - F.col("_b_starts") - F.col("_a_e"), lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    return out.select(*own, here(reads_in).alias("n_reads"), here(grown("covered")).alias("covered"), (here(grown("bases")) / (F.col("f_end") - F.col("f_start"))).alias("mean_depth"))


def element_coverage(features: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """A row a key, which several features may share: all their reads, their mean number of covered bases (effective length) and mean depth."""
    return coverage(features, reads, key).groupBy(key).agg(F.sum("n_reads").alias("count"), F.avg("covered").alias("effective_length"), F.avg("mean_depth").alias("coverage"))


def mean_insert(alignments: DataFrame, default: float = 500.0) -> DataFrame:
    """One row `insert`: the mean distance |tlen| of properly paired first mates (primary, not supplementary); the default if there are none or it is 0."""
    good = alignments.where(has("flag", 2) & has("flag", 64) & ~has("flag", 256) & ~has("flag", 2048) & (F.col("tlen") != 0))
    return good.agg(F.coalesce(F.avg(F.abs(F.col("tlen").cast("double"))), F.lit(default)).alias("insert"))


def fractional_counts(reads: DataFrame, features: DataFrame, key: str, qname: str = "qname") -> DataFrame:
    """Each of a read's n alignments adds 1 / n to the features that it meets."""
    n = reads.groupBy(qname).agg(F.count("*").alias("_n"))
    return overlap_join(reads.join(n, qname), features).groupBy(key).agg(F.sum(1 / F.col("_n")).alias("count"))


def all_counts(reads: DataFrame, features: DataFrame, key: str) -> DataFrame:
    return overlap_join(reads, features).groupBy(key).agg(F.count("*").alias("count"))


def annotation_density(loci: DataFrame, family: str, families: list[str]) -> DataFrame:
    """Loci per contig and family, 0 where none."""
    return loci.groupBy("contig").pivot(family, families).count().na.fill(0)


def forward_shares(alignments: DataFrame, bin_size: int, least: int) -> DataFrame:
    """(contig, bin, n, forward): the share of first mates on the forward strand, in bins that hold `least` of them."""
    kept = alignments.where(has("flag", 64) & ~has("flag", 256) & ~has("flag", 2048) & ~has("flag", 4))
    return kept.groupBy("contig", F.floor(F.col("start") / bin_size).alias("bin")).agg(F.count("*").alias("n"), F.avg((~has("flag", 16)).cast("double")).alias("forward")).where(F.col("n") >= least)


def strandedness(alignments: DataFrame, bin_size: int = 10_000, least: int = 50) -> DataFrame:
    """Forward share of first mates in bins of at least `least`: number of bins, mean, sd, share of central and of extreme bins, verdict.

    Central: 0.4 to 0.6; extreme: at most 0.15 or at least 0.85. Unstranded if over 0.80 are central and under 0.05 extreme,
    stranded if over 0.30 are extreme, else ambiguous, also without bins.
    """
    f = F.col("forward")
    out = forward_shares(alignments, bin_size, least).agg(F.count("*").alias("n_bins"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("sd"), F.avg(f.between(0.4, 0.6).cast("double")).alias("central"), F.avg(((f <= 0.15) | (f >= 0.85)).cast("double")).alias("extreme"))
    unstranded = (F.col("central") > 0.80) & (F.col("extreme") < 0.05)
    return out.withColumn("verdict", F.when(unstranded, "unstranded").when(F.col("extreme") > 0.30, "stranded").otherwise("ambiguous"))


def strand_histogram(alignments: DataFrame, bin_size: int = 10_000, least: int = 50) -> DataFrame:
    """(bucket, n): bins by tenths of their forward share, all ten buckets; a share of 1 is in the last."""
    own = forward_shares(alignments, bin_size, least).groupBy(F.least(F.floor(F.col("forward") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = alignments.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return every.join(own, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def subsequences(tiles: DataFrame, intervals: DataFrame, key: str, tile: int) -> DataFrame:
    """Bases of each interval, reverse-complemented on the minus strand. tiles: contig, tile (number), seq (of `tile` bases)."""
    from helixmill.functions.seq import reverse_complement

    parts = intervals.where(F.col("start") < F.col("end")).select("*", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("tile")).join(tiles, ["contig", "tile"])
    a, b = F.greatest(F.col("start") - F.col("tile") * tile, F.lit(0)), F.least(F.col("end") - F.col("tile") * tile, F.lit(tile))
    cut = parts.withColumn("_a", a.cast("int")).withColumn("_b", b.cast("int")).withColumn("_part", F.expr("substring(seq, _a + 1, _b - _a)"))
    whole = cut.groupBy(key, "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "_part"))), lambda x: x["_part"]), "").alias("seq"))
    return whole.select(key, F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def membership_fractions(reads: DataFrame, loci: DataFrame, read: str, classes: list[str], divided: list[str] | None = None, unique_only: bool = False) -> DataFrame:
    """Per read, hits in each class over all its hits (classes outside `divided` keep raw counts); hits of other classes count below the line only.

    loci: target and family. L1PA2, L1HS, other L1PA*, then any LINE family, then NEGATIVE.
    """
    t = F.col("target")
    cls = F.when(t == "L1PA2", "L1PA2").when(t == "L1HS", "L1HS").when(t.startswith("L1PA"), "L1PA").when(F.col("family").startswith("LINE"), "LINE/L1").otherwise("NEGATIVE")
    kinds = {"_n": F.lit(True)} | {f"_{c}": cls == c for c in classes}
    hits = overlap_counts(reads, loci, kinds).where("_n > 0").groupBy(read).agg(*(F.sum(n).alias(n) for n in kinds))
    if unique_only:
        hits = hits.where("_n = 1")
    divided = classes if divided is None else divided
    return hits.select(read, *((F.col(f"_{c}") / F.col("_n")).alias(c) if c in divided else F.col(f"_{c}").cast("double").alias(c) for c in classes))
