"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Two lines within an edit distance of t agree wholly in one of the t + 1 segments of either. So each distinct line is filed
under the segments of its own length, and looks up, for each length it may match, the substrings that can stand for a
segment. Only keys that meet go on; their lines get a fingerprint of character counts, in which an edit changes at most two
bits, and two lines of a key are a pair only if their fingerprints allow it. Pairs are verified by an automaton of 2 t + 1
diagonals and t + 1 rows of errors, whose bits move together, one step a character; what both lines begin or end with
is left out before, and a pair that cannot match any more takes no further steps.

Every distinct line is known by its first place (document, number), which travels instead of its bytes. The keys that meet
are written and read again, so that their search runs once and its shuffle files go; it takes the texts by document, and
one more shuffle of the texts serves the fingerprints, the lines of pairs and the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import free_name, stored, table, texts_changed, with_row_ids

DISTANCE = 2
#: Near matches only: in a shorter line two edits are over a tenth of it and make another line of it (a number, a short word).
LEAST_CHARS = 20


def _segment(n: Column, i: int, t: int) -> tuple[Column, Column]:
    """Where segment i of a line of n characters starts, from 0, and its size; the last ones take what is left over."""
    size = F.floor(n / (t + 1)).cast("int")
    longer = F.greatest(F.lit(0), i - (t + 1) + (n - size * (t + 1)))
    return size * i + longer, size + F.when(n - size * (t + 1) > t - i, 1).otherwise(0)


def keys(n: Column, t: int) -> list[tuple[Column, Column, Column, Column]]:
    """(length of the match, segment, start, size): the t + 1 segments that a line is filed under, which it looks up as well, then
    the other substrings that it looks up for matches that are up to t shorter: the starts that leave enough errors on either side."""
    own = [(n, F.lit(i), *_segment(n, i, t)) for i in range(t + 1)]
    out = []
    for less in range(t + 1):
        for i in range(t + 1):
            start, size = _segment(n - less, i, t)
            for d in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                if less or d:
                    out.append((n - less, F.lit(i), start + d, size))
    return own + out


def key_rows(lines: DataFrame, t: int) -> DataFrame:
    """(key, [doc, 2 no + whether filed]) for each segment and substring of `keys` that lies inside the line. lines: id (doc, no), line, n.

    The hashes are columns of one projection before they are exploded, so that all of it is compiled.
    """
    wanted = keys(F.col("n"), t)
    hashes = [F.when((at >= 0) & (size >= 1) & (at + size <= F.col("n")), F.xxhash64(m, i, F.substring("line", at + 1, size))).alias(f"_h{j}") for j, (m, i, at, size) in enumerate(wanted)]
    wide = lines.select("id", *hashes).select("id", F.posexplode(F.array(*(f"_h{j}" for j in range(len(hashes))))).alias("_j", "key"))
    return wide.where(F.col("key").isNotNull()).select("key", F.array(F.col("id.doc"), F.shiftleft(F.col("id.no").cast("long"), 1).bitwiseOR((F.col("_j") <= t).cast("long"))).alias("_v"))


def fingerprint(line: Column) -> Column:
    """Counts of characters in 32 classes, modulo 4, in Gray code of two bits each: one more or less of a character changes one bit."""
    ones = F.transform(F.split(line, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), 2 * (F.ascii(c) % 32)))
    sums = F.aggregate(ones, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x).bitwiseXOR(F.shiftleft(s.bitwiseAND(x), 1)))
    return F.aggregate(F.array(sums), F.lit(0).cast("long"), lambda _, s: s.bitwiseXOR(F.shiftrightunsigned(s, 1).bitwiseAND(F.lit(0x5555555555555555))))


STEP = 16


def _alike_blocks(x: Column, y: Column) -> Column:
    """How many characters two arrays of blocks have in common at their starts, in blocks."""
    n = F.least(F.size(x), F.size(y))
    count = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: F.when((s == i) & (F.get(x, i) == F.get(y, i)), s + 1).otherwise(s))
    return count * STEP


def _blocks(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once; a filter that moves below a projection would repeat the projection's columns."""
    return F.get(F.transform(F.array(value), body), 0)


def stripped(x: Column, y: Column) -> Column:
    """Both texts, reversed, as a struct (x, y), less the blocks that both begin with and then those that both end with; their edit distance stays the same."""

    def start(x: Column, y: Column) -> Column:
        blocks = F.struct(x.alias("x"), y.alias("y"), _blocks(x).alias("p"), _blocks(y).alias("q"))
        rest = lambda v, n: F.struct(*(F.reverse(F.substring(v[c], n + 1, F.length(v[c]))).alias(c) for c in ("x", "y")))
        return let(blocks, lambda v: let(_alike_blocks(v["p"], v["q"]), lambda n: rest(v, n)))

    return let(start(x, y), lambda v: let(start(v["x"], v["y"]), lambda w: F.struct(F.reverse(w["x"]).alias("x"), F.reverse(w["y"]).alias("y"))))


def within(a: Column, b: Column, t: int) -> Column:
    """Whether two texts are within edit distance t (at most STEP).

    The state has a row for each number of errors e, with a bit for each diagonal d = -t .. t: i characters of a and i + d of b
    agree with at most e errors. A block of a is divided into characters, with the blocks of b around it, only while a
    diagonal is left.
    """
    full = F.lit((1 << (2 * t + 1)) - 1).cast("long")

    def step(s: Column, m: Column) -> Column:
        new = [F.get(s, 0).bitwiseAND(m)]
        for e in range(1, t + 1):
            old = F.get(s, e - 1)
            new.append(F.get(s, e).bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(full))
        return F.array(*new)

    def block(s: Column, k: Column, x: Column, y: Column) -> Column:
        around = F.concat(*(F.coalesce(F.get(y, k + j), F.lit("")) for j in (-1, 0, 1)))
        chars = F.array(F.struct(F.split(F.get(x, k), "").alias("own"), F.split(around, "").alias("other"), F.when(k > 0, STEP).otherwise(0).alias("at")))  # an argument of a lambda is worked out once
        bit = lambda v, c, i, d: F.when(F.get(v["other"], v["at"] + i + d) == c, 1 << (d + t)).otherwise(0).cast("long")
        masks = F.transform(chars, lambda v: F.transform(v["own"], lambda c, i: sum((bit(v, c, i, d) for d in range(-t, t + 1)), F.lit(0).cast("long"))))
        return F.when(F.get(s, t) == 0, s).otherwise(F.aggregate(F.get(masks, 0), s, step))

    start = F.array(*(F.lit(sum(1 << (d + t) for d in range(e + 1))).cast("long") for e in range(t + 1)))

    def found(v: Column) -> Column:
        x, y, apart = v["x"], v["y"], v["m"] - v["n"]
        end = F.aggregate(F.when(v["n"] > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>")), start, lambda s, k: block(s, k, x, y))
        return (F.abs(apart) <= t) & (F.call_function("shiftright", F.get(end, t), F.greatest(apart + t, F.lit(0))).bitwiseAND(F.lit(1)) == 1)

    return let(stripped(a, b), lambda s: let(F.struct(_blocks(s["x"]).alias("x"), _blocks(s["y"]).alias("y"), F.length(s["x"]).alias("n"), F.length(s["y"]).alias("m")), found))


def meeting_pairs(lines: DataFrame, with_text: Callable[[DataFrame], DataFrame], t: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """Pairs of ids (a, b), a < b, of lines that share a key and whose fingerprints allow t edits, and the texts of the lines that share keys.

    lines: distinct texts `line` known by `id`. with_text: gives a table of ids back with column line.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = key_rows(lines.withColumn("n", F.length("line")), t).repartition(n, "key")
    # all readers take the array whole and filter after a join only, so one exchange serves them
    filed = F.element_at("_v", 2).bitwiseAND(F.lit(1))
    shared = rows.groupBy("key").agg(F.count("*").alias("_n"), F.max(filed).alias("_f")).where("_n > 1 and _f = 1").select("key")
    id_ = F.struct(F.element_at("_v", 1).alias("doc"), F.shiftright(F.element_at("_v", 2), 1).cast("int").alias("no"))
    met = stored(rows.join(shared.hint("shuffle_hash"), "key").select("key", id_.alias("id"), filed.alias("filed")), "lines")
    texts = with_text(met.select("id").distinct())
    # inside the array the optimizer cannot prune, so one exchange serves the fingerprints and both sides of the pairs
    texts = texts.select("id", F.array(F.struct("line", F.length("line").alias("n"), fingerprint(F.col("line")).alias("print"))).alias("_v")).repartition(n, "id")
    known = texts.select("id", F.element_at("_v", 1).getField("n").alias("n"), F.element_at("_v", 1).getField("print").alias("print"))
    told = met.join(known, "id")
    filed = told.withColumn("n", F.when(F.col("filed") == 1, F.col("n"))).where("n is not null").select("key", "id", "n", "print")
    asked = told.select("key", F.col("id").alias("other"), F.col("n").alias("m"), F.col("print").alias("signs"))
    allowed = (F.col("id") != F.col("other")) & F.col("m").between(F.col("n"), F.col("n") + t) & (F.bit_count(F.col("print").bitwiseXOR(F.col("signs"))) <= 2 * t - (F.col("m") - F.col("n")))
    pairs = filed.join(asked, "key").where(allowed).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return pairs, texts.select("id", F.element_at("_v", 1).getField("line").alias("line"))


def docs_by_key(docs: DataFrame, key: str) -> DataFrame:
    """Rows as _key and an array with the whole row, dealt by key. Inside the array the optimizer cannot prune, so the same exchange serves all readers."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_key"), F.array(F.struct(*docs.columns)).alias("_rows")).repartition(n, "_key")


def dedup_lines(docs: DataFrame, t: int = DISTANCE, least: int = LEAST_CHARS, key: str = "doc_id", text: str = "text", least_exact: int | None = 1) -> DataFrame:
    """`docs` with text less each line that repeats an earlier one or is within edit distance t of one; and counts.

    Lines are what \\n divides. Earlier: in a document of a smaller key, or before in the same one. A line goes if its text
    came before, or if a text within t characters first came before; it is judged on the input, also if that text goes
    itself. Lines of fewer than `least` characters have no near ones (`least` is over t, and t at most 16). Their repeats go from `least_exact` characters on, if
    they hold a letter or digit (blank lines and lines of signs give a text its form); with None they stay. Added: n_lines, n_exact and n_near (removed lines of either kind).
    Null text stays null, with no lines. Rows that repeat key and text are judged alike; different texts of one key, null
    as well, are documents of their own in order of their hashes. Null is before all others. Other columns stay, but for clashing names of the counts. An empty table gives an empty result.
    """
    if not 0 < t <= min(least - 1, STEP):
        raise ValueError(f"the distance must be positive, under the least length and at most {STEP}")
    names = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    id_ = free_name(names, "_id")
    docs = with_row_ids(docs.select(*names), key, text, id_)
    lines = docs.select(F.col(id_).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))
    long = F.length("line") >= least
    short = F.lit(False) if least_exact is None else (F.length("line") >= least_exact) & F.col("line").rlike(r"[\p{L}\p{N}]")
    places = lines.where(long | short).select("doc", "no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(t), "line").alias("g"), long.alias("long"))
    firsts = places.groupBy("h", "g").agg(F.min(F.struct("doc", "no")).alias("id"), F.max("long").alias("long"))
    own = docs_by_key(docs, id_)
    split = F.split(F.element_at("_rows", 1).getField(text), "\n")

    def with_text(ids: DataFrame) -> DataFrame:
        """ids: structs (doc, no); their lines, from the documents where they first stand."""
        wanted = ids.groupBy(F.col("id.doc").alias("_key")).agg(F.collect_set("id.no").alias("_nos"))
        one = own.join(wanted, "_key").select("_key", split.alias("_lines"), "_nos")
        one = one.select("_key", "_lines", F.explode("_nos").alias("_no"))
        return one.select(F.struct(F.col("_key").alias("doc"), F.col("_no").alias("no")).alias("id"), F.get("_lines", F.col("_no")).alias("line"))

    pairs, texts = meeting_pairs(with_text(firsts.where("long").select("id")), with_text, t)
    left, right = (texts.select(F.col("id").alias(c), F.col("line").alias(f"{c}_line")) for c in ("a", "b"))
    near = pairs.join(left, "a").join(right, "b").where(within(F.col("a_line"), F.col("b_line"), t)).select(F.col("b").alias("id")).distinct().withColumn("near", F.lit(True))
    judged = firsts.join(near, "id", "left")
    gone = places.join(judged, ["h", "g"]).select("doc", "no", F.struct("doc", "no").eqNullSafe(F.col("id")).alias("first"), "near", judged["long"]).where(~F.col("first") | (F.col("near") & F.col("long")))
    cuts = gone.groupBy(F.col("doc").alias("_key")).agg(F.collect_set(F.when(~F.col("first"), F.col("no"))).alias("exact"), F.collect_set(F.when(F.col("first"), F.col("no"))).alias("nears"))
    both = own.join(cuts, "_key", "left").select(F.element_at("_rows", 1).alias("_row"), split.alias("_lines"), *(F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("exact", "nears")))
    all_ = F.when(F.size("_lines") > 0, F.sequence(F.lit(0), F.size("_lines") - 1))
    left_over = F.array_except(F.array_except(all_, F.col("exact")), F.col("nears"))
    kept = F.when(F.col("_lines").isNotNull(), F.array_join(F.transform(left_over, lambda i: F.get("_lines", i)), "\n"))
    return both.select(*(kept.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("exact").cast("long").alias("n_exact"), F.size("nears").cast("long").alias("n_near"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs`, their texts less the lines that repeat an earlier one or nearly do, as dedup_lines has it. Columns stay whatever their names."""
    return texts_changed(docs, dedup_lines)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
