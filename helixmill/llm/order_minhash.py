"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers of words are numbered by occurrence, so a k-mer that comes twice is two items. One hash deals the items to
slots and ranks them there (one permutation for all slots); each slot takes its two smallest items, puts them back in text
order and hashes the pair. So two texts agree in a slot only where the same k-mers stand in the same order.
Everything is worked out inside a row, on sorted arrays of packed numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import table

#: Bits of a packed number that hold a word's place. More words than 2^28 do not fit into one array of numbers in any case.
PLACE = 28
SLOTS = 64
#: Steps by which the start of a run of equal k-mers is found.
STEPS = [1 << i for i in range(PLACE - 1, -1, -1)]


def slots_of(frame: DataFrame, text: str, out: str, k: int = 3, slots: int = SLOTS) -> DataFrame:
    """Adds the array `out` of filled slots, each the slot's number (high 32 bits) and the hash of its ordered pair.

    A text of fewer than k words is one k-mer; one without words has no slots. Words: runs without ASCII white space.
    """
    bits = slots.bit_length() - 1
    if slots != 1 << bits:
        raise ValueError("slots must be a power of two")
    rank_bits = 63 - bits - PLACE
    low = (1 << PLACE) - 1
    place = lambda x: x.bitwiseAND(F.lit(low))
    mer = lambda x: F.shiftright(x, PLACE)
    slot = lambda x: F.shiftright(x, 63 - bits)
    f = frame.withColumn("_w", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+"), ""))
    heads = F.slice("_w", 1, F.when(F.size("_w") == 0, 0).otherwise(F.greatest(F.size("_w") - (k - 1), F.lit(1))))
    f = f.withColumn("_g", F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get("_w", i + j) for j in range(1, k))).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low))))).drop("_w")
    f = f.withColumn("_s", F.sort_array("_g"))
    same = lambda x, i: (i >= 0) & (mer(F.get("_s", i)) == mer(x))
    before = lambda x, i: F.when(same(x, i - 1), F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda o, b: F.when(same(x, i - o - b), o + b).otherwise(o))).otherwise(F.lit(0))

    def item(x: Column, i: Column) -> Column:
        y = F.xxhash64(mer(x), before(x, i))
        return F.shiftleft(y.bitwiseAND(F.lit(slots - 1)), 63 - bits).bitwiseOR(F.shiftleft(F.shiftrightunsigned(y, 64 - rank_bits), PLACE)).bitwiseOR(place(x))

    f = f.withColumn("_t", F.sort_array(F.transform("_s", item))).drop("_s")
    first = F.filter(F.transform("_t", lambda x, i: F.when((i == 0) | (slot(x) != slot(F.get("_t", i - 1))), F.struct(x.alias("a"), F.get("_t", i + 1).alias("b")))), lambda x: x.isNotNull())
    at = lambda x: mer(F.get("_g", x.cast("int")))

    def pair(x: Column) -> Column:
        a, b = place(x["a"]), F.when(slot(x["b"]) == slot(x["a"]), place(x["b"]))
        both = F.xxhash64(at(F.least(a, b)), at(F.greatest(a, b)), F.coalesce(b, F.lit(-1)) >= 0)
        return F.shiftleft(slot(x["a"]), 32).bitwiseOR(both.bitwiseAND(F.lit(0xFFFFFFFF)))

    return f.withColumn("_f", first).withColumn(out, F.transform("_f", pair)).drop("_f", "_g", "_t")


def fingerprint_text(slots: Column) -> Column:
    """Ten hexadecimal digits for each filled slot; empty for no slots."""
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots, 0 to 1; two texts without words are alike."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def order_minhash(docs: DataFrame, k: int = 3, slots: int = SLOTS, text: str = "text") -> DataFrame:
    """`docs` with a column fingerprint. Equal texts have equal fingerprints; null is an empty text."""
    out = slots_of(docs.withColumn("_text", F.col(text)), "_text", "_slots", k, slots)
    return out.withColumn("fingerprint", fingerprint_text(F.col("_slots"))).drop("_slots", "_text")


def below(cuts: list[int], x: Column) -> Column:
    """How many of the ascending cuts are <= x, by bisection."""
    if not cuts:
        return F.lit(0)
    held, steps = F.array(*map(F.lit, cuts)), [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda o, b: F.when((o + b <= len(cuts)) & (F.get(held, o + b - 1) <= x), o + b).otherwise(o))


def with_next(docs: DataFrame, key: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Adds next: the struct of `columns` of the row with the next larger key; after the last row comes the first.

    Rows go to ranges of keys, and the first row of each range to the range before it as well, so one shuffle is enough.
    Equal keys follow each other in the order of `columns`; a null key comes first.
    """
    n = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    cuts, lowest = docs.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 20 * n), F.min("_k")).first()
    if lowest is None:
        return docs.withColumn("next", F.struct(*columns)).drop("_k")
    cuts = sorted(set(cuts) - {lowest})
    own = below(cuts, F.col("_k"))
    edges = F.array_contains(F.array(*map(F.lit, cuts)), F.col("_k")) if cuts else F.lit(False)
    homes = F.array(F.struct(own.alias("range"), F.lit(0).alias("ghost")), F.when(F.col("_k") == lowest, F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("ghost"))), F.when(edges, F.struct((own - 1).alias("range"), F.lit(1).alias("ghost"))))
    dealt = docs.select("*", F.explode(F.array_compact(homes)).alias("_at")).select("*", "_at.range", "_at.ghost").drop("_at")
    w = Window.partitionBy("range").orderBy("ghost", "_k", *columns)
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("ghost = 0").drop("range", "ghost", "_k")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(slots_of(docs, "text", "own"), "doc_id", ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("next.own").alias("nxt"), F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"))
    got = slots_of(both, "edited", "changed")
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("nxt")).alias("near_next"))
