"""Labels of fragments, splits without leakage, samples, set operations and data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.seq import class_of, keyed_uniform
from helixmill.operators.kmers import exact_rank
from helixmill.operators.ranks import quantiles


def ranked(label: Column, order: list[str]) -> Column:
    """The label's place in `order`; labels outside it come last."""
    out = F.lit(len(order))
    for i, x in reversed(list(enumerate(order))):
        out = F.when(label == x, i).otherwise(out)
    return out


def best_label(reads: DataFrame, key: str, label: str, order: list[str], record: str) -> DataFrame:
    """One label per fragment: the first in `order` of its reads' labels; unlisted ones rank last, earlier records first on ties."""
    return reads.groupBy(key).agg(F.min_by(label, F.struct(ranked(F.col(label), order).alias("r"), F.col(record).alias("i"))).alias(label))


def dominant_label(reads: DataFrame, key: str, label: str, record: str) -> DataFrame:
    """The most common label of each key; the one that came first on ties."""
    counts = reads.groupBy(key, label).agg(F.count("*").alias("n"), F.min(record).alias("first"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias(label))


def frequent_classes(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Rows whose class has at least `least` of them."""
    return rows.join(rows.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi")


def label_histogram(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(counts per label, their quartiles)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    q = quantiles(counts, [], "n", [0.25, 0.5, 0.75])
    return counts, q.select(*(F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))))


def class_weights(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """N / (C * n) of each class, 0 for an absent one, and the majority's size over the class's."""
    spark = rows.sparkSession
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(c,) for c in classes], [label]).join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = grid.agg(F.sum("n").alias("_N"), F.max("n").alias("_most"))
    n = F.nullif("n", F.lit(0))
    return grid.crossJoin(F.broadcast(total)).select(label, "n", F.coalesce(F.col("_N") / (len(classes) * n), F.lit(0.0)).alias("weight"), (F.col("_most") / n).alias("imbalance"))


def fragment_classes(strict: DataFrame, clear: DataFrame, every: DataFrame, key: str, family: str, order: list[str] = ["L1HS", "L1PA", "NEGATIVE"]) -> DataFrame:
    """Class of each fragment: the best of its strict hits' families, NEGATIVE if nothing overlaps it, else DROP; OTHER and DROP go.

    strict: (key, family) of strict hits. clear: keys that overlap nothing. every: all keys.
    """
    best = strict.groupBy(key).agg(F.min(ranked(class_of(F.col(family)), order)).alias("_r"))
    names = F.array(*map(F.lit, [*order, "OTHER"]))
    out = every.join(best, key, "left").join(clear.select(key).distinct().withColumn("_clear", F.lit(True)), key, "left")
    label = F.when(F.col("_r").isNotNull(), F.get(names, F.col("_r"))).when(F.col("_clear"), "NEGATIVE").otherwise("DROP")
    return out.select(key, label.alias("label")).where(~F.col("label").isin("OTHER", "DROP"))


def keep_ids(reads: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return reads.join(ids.select(key), key, "left_semi")


def group_split(rows: DataFrame, group: str, label: str, record: str, test: float, val: float, seed: str = "0") -> DataFrame:
    """Adds split: all rows of a group in one, classes (dominant label of a group) shared out alike.

    Of a class's n groups in keyed order max(1, round(n * test)) go to test, max(1, round(n * val)) to eval if val is not 0,
    the rest to train. If none is left for train: 1 test, 1 eval, n - 2 train for three groups or more and val; 1 test and
    n - 1 train for two or more; else all train.
    """
    groups = dominant_label(rows.select(group, label, record), group, label, record)
    u = keyed_uniform(F.col(group).cast("string"), F.lit(seed))
    g = exact_rank(groups.withColumn("_u", u), [label], "_u", group).withColumnsRenamed({"_total": "_n", "_rank": "_i"})
    n = F.col("_n")
    t, v = F.greatest(F.lit(1), F.bround(n * test)).cast("int"), (F.greatest(F.lit(1), F.bround(n * val)).cast("int") if val else F.lit(0))
    short = n - t - v < 1
    t2 = F.when(~short, t).when(n >= 2, 1).otherwise(0)
    v2 = F.when(~short, v).when((n >= 3) & F.lit(bool(val)), 1).otherwise(0)
    g = g.select(group, F.when(F.col("_i") <= t2, "test").when(F.col("_i") <= t2 + v2, "eval").otherwise("train").alias("split"))
    return rows.join(g, group)


def row_split(rows: DataFrame, key: str, label: str, test: float, seed: str = "0") -> DataFrame:
    """Adds split: round(n * test) rows of each class in keyed order are test."""
    r = exact_rank(rows.withColumn("_u", keyed_uniform(F.col(key).cast("string"), F.lit(seed))), [label], "_u", key)
    return r.withColumn("split", F.when(F.col("_rank") <= F.bround(F.col("_total") * test), "test").otherwise("train")).drop("_u", "_rank", "_total")


def capped(rows: DataFrame, key: str, label: str, most: int | Column, seed: str = "0") -> DataFrame:
    """At most `most` rows of each class, in keyed order."""
    r = exact_rank(rows.withColumn("_u", keyed_uniform(F.col(key).cast("string"), F.lit(seed))), [label], "_u", key)
    return r.where(F.col("_rank") <= most).drop("_u", "_rank", "_total")


def to_priors(rows: DataFrame, key: str, label: str, priors: dict, seed: str = "0") -> DataFrame:
    """The largest sample whose class shares are the priors': the class with the least rows for its prior sets the scale."""
    spark, total = rows.sparkSession, sum(priors.values())
    shares = spark.createDataFrame([(c, p / total) for c, p in priors.items() if p > 0], [label, "_p"])
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    scale = shares.join(counts, label, "left").agg(F.min(F.coalesce("_n", F.lit(0)) / F.col("_p")).alias("_s"))
    target = shares.crossJoin(F.broadcast(scale)).select(label, F.bround(F.col("_p") * F.col("_s")).alias("_t"))
    return capped(rows.join(F.broadcast(target), label), key, label, F.col("_t"), seed).drop("_t")


def same_mix(rows: DataFrame, key: str, label: str, target: int, seed: str = "0") -> DataFrame:
    """About `target` rows with the classes' shares kept, at least one of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_all"))
    want = counts.crossJoin(F.broadcast(total)).select(label, F.greatest(F.lit(1), F.bround(F.col("_c") * target / F.col("_all"))).alias("_t"))
    return capped(rows.join(F.broadcast(want), label), key, label, F.col("_t"), seed).drop("_t")


def within_budget(rows: DataFrame, key: str, cost: str, budget: int, pinned: Column | None = None, seed: str = "0", ranges: int = 4096) -> DataFrame:
    """Rows in keyed order while their cost adds up to the budget at most, the first always; pinned ones come first and take half of it at most."""
    rows = rows.withColumn("_pin", F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)).withColumn("_u", keyed_uniform(F.col(key).cast("string"), F.lit(seed)))

    def running(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("_range", F.floor(F.col("_u") * ranges).cast("int"))
        sums = df.groupBy("_range").agg(F.sum(cost).alias("_s"))
        w = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
        inside = F.sum(cost).over(Window.partitionBy("_range").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("_in", inside).join(F.broadcast(sums), "_range").withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")

    first = running(rows.where("_pin"), "_sum").where(F.col("_sum") <= budget // 2)
    used = first.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("_used"))
    rest = running(rows.where("not _pin"), "_sum").crossJoin(F.broadcast(used))
    rest = rest.where((F.col("_sum") + F.col("_used") <= budget) | ((F.col("_sum") == F.col(cost)) & (F.col("_used") == 0))).drop("_used")
    return first.unionByName(rest).drop("_pin", "_u", "_sum")


def halves(rows: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """Adds half: fit for the N // 2 smallest keyed numbers, report for the rest."""
    r = exact_rank(rows.withColumn("_u", keyed_uniform(F.col(key).cast("string"), F.lit(seed))), [], "_u", key)
    return r.withColumn("half", F.when(F.col("_rank") <= F.floor(F.col("_total") / 2), "fit").otherwise("report")).drop("_u", "_rank", "_total")


def depth_matched(pairs: DataFrame, key: str, target: int, seed: str = "0") -> DataFrame:
    """About `target` pairs: each stays with chance target / N, both mates together, as they are one row."""
    total = pairs.agg(F.count("*").alias("_n"))
    return pairs.crossJoin(F.broadcast(total)).where(keyed_uniform(F.col(key).cast("string"), F.lit(seed)) < target / F.col("_n")).drop("_n")


def unpaired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side; a reader raises an error if there are any."""
    x, y = (f.select(key).withColumn("_s", F.lit(True)) for f in (a, b))
    return x.withColumnRenamed("_s", "_a").join(y.withColumnRenamed("_s", "_b"), key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(key, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("side"))


def require_empty(bad: DataFrame, what: str) -> None:
    """An error that names the first rows, if there are any."""
    if rows := bad.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def id_range(rows: DataFrame, ids: str, label: str, vocabulary: int, classes: int) -> DataFrame:
    """Smallest and largest token id and label, and whether all are within bounds."""
    out = rows.agg(F.min(F.array_min(ids)).alias("min_id"), F.max(F.array_max(ids)).alias("max_id"), F.min(label).alias("min_label"), F.max(label).alias("max_label"))
    return out.withColumn("ok", (F.col("min_id") >= 0) & (F.col("max_id") < vocabulary) & (F.col("min_label") >= 0) & (F.col("max_label") < classes))


def leaks(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each named rule; a null is a break. All rules in one pass."""
    return rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    if missing := [c for c in names if c not in rows.columns]:
        raise ValueError(f"columns missing: {missing}")
    return rows


def shared_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Names on both sides, as contigs of a BED file and of a reference must have."""
    return a.select(name).intersect(b.select(name))


def without_empty(rows: DataFrame, method: str, value: str) -> DataFrame:
    """Rows less the methods whose values add up to 0."""
    return rows.join(rows.groupBy(method).agg(F.sum(value).alias("_s")).where(F.coalesce("_s", F.lit(0)) == 0).select(method), method, "left_anti")


def split_counts(rows: DataFrame, expected: list[str], split: str = "split") -> DataFrame:
    """Rows of each expected split, 0 if it is missing."""
    names = rows.sparkSession.createDataFrame([(x,) for x in expected], [split])
    return names.join(rows.groupBy(split).agg(F.count("*").alias("n")), split, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
