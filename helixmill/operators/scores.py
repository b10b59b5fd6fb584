"""Class scores: decisions, aggregation, calibration, operating points and metrics. Probabilities are arrays in class order."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.ranks import running_sums
from helixmill.operators.surfaces import f1_surface


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    z = F.transform(logits, lambda x: x / temperature)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(p: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def weighted(p: Column, weights: Column | list[float]) -> Column:
    w = F.array(*map(F.lit, weights)) if isinstance(weights, list) else weights
    return F.zip_with(p, w, lambda a, b: a * b)


def soft_vote(a: Column, b: Column, alpha: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: alpha * x + (1 - alpha) * y)


def reweighted(p: Column, at: int, beta: float) -> Column:
    """One class scaled by beta, then normalized again."""
    q = F.transform(p, lambda x, i: F.when(i == at, x * beta).otherwise(x))
    return F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda a, y: a + y))


def logits_of(p: Column) -> Column:
    return F.transform(p, lambda x: F.ln(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12))))


def collapsed(p: Column, negative: int) -> Column:
    """[1 - p, p] of the negative class."""
    return F.array(1 - p[negative], p[negative])


def below_threshold(scores: DataFrame, negative: str, tau: float, key: str = "id") -> DataFrame:
    """Ids whose NEGATIVE score is under tau; on Parquet the comparison is pushed down to the scan."""
    return scores.where(F.col(negative) < tau).select(key)


def mean_scores(rows: DataFrame, key: str, label: str, score: str, classes: list[str]) -> DataFrame:
    return rows.groupBy(key).pivot(label, classes).agg(F.avg(score))


def one_hot(scores: DataFrame, classes: list[str]) -> DataFrame:
    """1.0 in every class that equals the row's largest, ties included."""
    top = F.greatest(*classes)
    return scores.withColumns({f"_{c}": (F.col(c) == top).cast("double") for c in classes}).drop(*classes).withColumnsRenamed({f"_{c}": c for c in classes})


def by_chromosome(reads: DataFrame, scores: DataFrame, key: str, chrom: str, classes: list[str]) -> DataFrame:
    """Scores of aligned reads added up per chromosome."""
    return reads.select(key, chrom).join(scores, key).groupBy(chrom).agg(*(F.sum(c).alias(c) for c in classes))


def class_counts(rows: DataFrame, p: str, n: int) -> DataFrame:
    """class, soft (sum of probabilities) and hard (first largest) count; classes without reads are there."""
    long = rows.select(F.posexplode(p).alias("class", "_p"), argmax(F.col(p)).alias("_top"))
    return long.groupBy("class").agg(F.sum("_p").alias("soft"), F.count_if(F.col("_top") == F.col("class")).alias("hard"))


def confusion(rows: DataFrame, label: str, pred: str, n: int, by: list[str] = []) -> DataFrame:
    """by, label, pred, n of every pair of classes, 0 where none."""
    spark = rows.sparkSession
    counts = rows.groupBy(*by, label, pred).agg(F.count("*").alias("n"))
    grid = spark.range(n).select(F.col("id").cast("int").alias(label)).crossJoin(spark.range(n).select(F.col("id").cast("int").alias(pred)))
    if by:
        grid = rows.select(*by).distinct().crossJoin(grid)
    return grid.join(counts, [*by, label, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(grid: DataFrame, label: str, pred: str, by: list[str] = []) -> DataFrame:
    """by, class, support, precision, recall, f1 of a confusion grid; 0 for a zero division."""
    sides = grid.select(*by, F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("is_label")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("is_label")))).alias("s"), label, pred, "n")
    g = sides.groupBy(*by, "s.class").agg(
        F.sum(F.when(F.col("s.is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_label") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("s.is_label") == 1) & (F.col(label) == F.col(pred)), F.col("n")).otherwise(0)).alias("tp"),
    )
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, s, q = F.col("tp"), F.col("support"), F.col("predicted")
    return g.select(*by, "class", "support", zero(tp, q).alias("precision"), zero(tp, s).alias("recall"), zero(2 * tp, s + q).alias("f1"))


def macro_f1(grid: DataFrame, label: str, pred: str, by: list[str]) -> DataFrame:
    return per_class(grid, label, pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def metrics(grid: DataFrame, label: str, pred: str) -> DataFrame:
    """accuracy, balanced accuracy, Matthews correlation, kappa, macro and weighted scores, all from the confusion grid."""
    pc = per_class(grid, label, pred)
    n = F.col("_n")
    margin = grid.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("t")).join(grid.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("p")), "class")
    cross = margin.agg(F.sum(F.col("t").cast("double") * F.col("p")).alias("_tp"), F.sum(F.col("t").cast("double") ** 2).alias("_tt"), F.sum(F.col("p").cast("double") ** 2).alias("_pp"))
    whole = grid.agg(F.sum("n").cast("double").alias("_n"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).cast("double").alias("_c"))
    parts = pc.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")))
    out = whole.crossJoin(cross).crossJoin(parts)
    c = F.col("_c")
    chance = F.col("_tp") / (n * n)
    out = out.withColumns({"accuracy": c / n, "kappa": F.coalesce((c / n - chance) / F.nullif(1 - chance, F.lit(0.0)), F.lit(0.0)), "mcc": F.coalesce((c * n - F.col("_tp")) / F.nullif(F.sqrt((n * n - F.col("_pp")) * (n * n - F.col("_tt"))), F.lit(0.0)), F.lit(0.0))})
    return out.drop("_n", "_c", "_tp", "_tt", "_pp")


def one_vs_rest(rows: DataFrame, label: str, p: str) -> DataFrame:
    """class, auc, average_precision; null for a class without rows of either kind. Works on counts per distinct score, so ties are one step, and adds them in ranges of scores."""
    long = rows.select(label, F.posexplode(p).alias("class", "s"))
    steps = long.groupBy("class", "s").agg(F.count_if(F.col(label) == F.col("class")).alias("tp"), F.count("*").alias("n"))
    c = running_sums(steps, ["class"], "s", {"c_tp": "tp", "c_n": "n"}, descending=True)
    c = c.withColumns({"all_pos": F.col("total_c_tp"), "all_neg": F.col("total_c_n") - F.col("total_c_tp")})
    fp = F.col("n") - F.col("tp")
    above = F.col("c_n") - F.col("n") - (F.col("c_tp") - F.col("tp"))  # negatives with a larger score
    wins = F.sum(F.col("tp") * (F.col("all_neg") - above - 0.5 * fp))
    return c.groupBy("class").agg((wins / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))).alias("auc"), (F.sum(F.col("tp") * F.col("c_tp") / F.col("c_n")) / F.nullif(F.max("all_pos"), F.lit(0))).alias("average_precision"))


def calibration_error(rows: DataFrame, label: str, p: str, bins: int = 15) -> DataFrame:
    """Weighted mean distance of confidence and accuracy over equal bins (lo, hi] of the largest probability."""
    top = rows.select(F.array_max(p).alias("c"), (argmax(F.col(p)) == F.col(label)).cast("double").alias("ok"))
    b = top.groupBy(F.ceil(F.col("c") * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("conf"), F.avg("ok").alias("acc"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def concordance(x: str, y: str) -> Column:
    """Lin's coefficient with population moments; 1 where both are constant and equal."""
    down = F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2)
    return F.when(down > 0, 2 * F.covar_pop(x, y) / F.nullif(down, F.lit(0.0))).otherwise(1.0)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Null on a constant side."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def recovery(rows: DataFrame, by: list[str], truth: str, estimate: str) -> DataFrame:
    e = F.col(estimate) - F.col(truth)
    return rows.groupBy(*by).agg(pearson(truth, estimate).alias("pearson"), concordance(truth, estimate).alias("ccc"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def nll_grid(rows: DataFrame, label: str, logits: str, temperatures: list[float]) -> DataFrame:
    """temperature, nll: mean negative log likelihood of the labels under each temperature."""
    grid = rows.select(label, logits, F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    p = F.get(softmax(F.col(logits), F.col("temperature")), F.col(label))
    return grid.groupBy("temperature").agg((-F.avg(F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))).alias("nll"))


def fit_temperature(rows: DataFrame, label: str, logits: str, lo: float = 0.05, hi: float = 10.0, points: int = 24, rounds: int = 4) -> float:
    """The temperature of smallest loss, by a grid that shrinks around the best point; one pass a round."""
    for _ in range(rounds):
        step = (hi - lo) / (points - 1)
        best = nll_grid(rows, label, logits, [lo + i * step for i in range(points)]).agg(F.min_by("temperature", "nll")).first()[0]
        lo, hi = max(lo, best - step), min(hi, best + step)
    return best


def f1_grid(rows: DataFrame, label: str, pred: Column, grid: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, macro_f1 for each row of a small grid joined to the rows; `pred` may use the grid's columns. Counts are combined before the shuffle."""
    got = rows.crossJoin(F.broadcast(grid)).withColumn("_pred", pred)
    counts = got.groupBy(*by, label, "_pred").agg(F.count("*").alias("n"))
    hits = lambda c: F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)), lambda c: F.sum(F.when(F.col("_pred") == c, F.col("n")).otherwise(0)), lambda c: F.sum(F.when((F.col(label) == c) & (F.col("_pred") == c), F.col("n")).otherwise(0))
    s, q, tp = hits
    f1 = [F.coalesce(2 * tp(c) / F.nullif(s(c) + q(c), F.lit(0)), F.lit(0.0)) for c in range(n)]
    return counts.groupBy(*by).agg((reduce(lambda a, b: a + b, f1) / n).alias("macro_f1"))


def first_best(grid: DataFrame, order: list[str]) -> DataFrame:
    """The row of the largest macro_f1, the first in order on ties."""
    return grid.orderBy(F.desc("macro_f1"), *order).limit(1)


def geometric(lo: float, hi: float, n: int) -> list[float]:
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]


def weight_search(rows: DataFrame, label: str, p: str, n: int, negative: int, free: tuple[int, int], points: int = 25, fine: int = 17) -> dict:
    """Weights of two classes that give the best macro F1 of the weighted argmax, the others' weight being 1: a wide grid, then a fine one, a pass over the rows each."""
    best: dict = {}
    for sides in ("wide", "fine"):
        axes = [geometric(0.25, 4.0, points)] * 2 if sides == "wide" else [geometric(best[c] / 1.6, best[c] * 1.6, fine) for c in ("wa", "wb")]
        wa, wb, f1 = max(f1_surface(rows, label, p, n, *free, *axes), key=lambda x: (x[2], -x[0], -x[1]))
        if not best or f1 >= best["macro_f1"]:
            best = {"wa": wa, "wb": wb, "macro_f1": f1}
    return best


def threshold_counts(rows: DataFrame, p_negative: Column, positive: Column, steps: int) -> DataFrame:
    """tau, kept positives and negatives (p < tau), and the totals, for tau = 0, 1/steps ... 1: counts per step, then running sums."""
    spark = rows.sparkSession
    binned = rows.select((F.floor(p_negative * steps) + 1).cast("int").alias("i"), positive.alias("pos"))
    counts = binned.groupBy("i").agg(F.count_if("pos").alias("a"), F.count_if(~F.col("pos")).alias("b"))
    grid = spark.range(steps + 2).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").na.fill(0)
    w = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.select("i", (F.col("i") / steps).alias("tau"), F.sum("a").over(w).alias("kept_pos"), F.sum("b").over(w).alias("kept_neg"), F.sum("a").over(Window.partitionBy(F.lit(0))).alias("n_pos"), F.sum("b").over(Window.partitionBy(F.lit(0))).alias("n_neg"))
    return out.where(F.col("i") <= steps).drop("i")


def negative_threshold(rows: DataFrame, p_negative: Column, positive: Column, steps: int = 200) -> DataFrame:
    """tau and macro F1 of the first best cut of the binary decision."""
    t = threshold_counts(rows, p_negative, positive, steps)
    f = lambda tp, fp, fn: F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    kp, kn, p, n = (F.col(c) for c in ("kept_pos", "kept_neg", "n_pos", "n_neg"))
    return first_best(t.select("tau", ((f(kp, kn, p - kp) + f(n - kn, p - kp, kn)) / 2).alias("macro_f1")), ["tau"])


def purity_yield(rows: DataFrame, p_negative: Column, positive: Column, steps: int) -> DataFrame:
    t = threshold_counts(rows, p_negative, positive, steps)
    kp, kn, p, n = (F.col(c) for c in ("kept_pos", "kept_neg", "n_pos", "n_neg"))
    return t.select("tau", (kp / F.nullif(p, F.lit(0))).alias("yield"), (kp / F.nullif(kp + kn, F.lit(0))).alias("purity"), ((kp + kn) / (p + n)).alias("kept_share"))


def yield_at_purity(curve: DataFrame, target: float) -> DataFrame:
    return curve.agg(F.max(F.when(F.col("purity") >= target, F.col("yield"))).alias("yield"))


def masked_token_metrics(rows: DataFrame, labels: str, preds: str, losses: str) -> DataFrame:
    """Accuracy over masked tokens (label not -100) and exp of their mean loss."""
    t = rows.select(F.explode(F.arrays_zip(F.col(labels).alias("l"), F.col(preds).alias("p"), F.col(losses).alias("x"))).alias("t")).where("t.l <> -100")
    return t.agg(F.count("*").alias("n"), F.avg((F.col("t.l") == F.col("t.p")).cast("double")).alias("accuracy"), F.exp(F.avg("t.x")).alias("perplexity"))


def sparse_vectors(buckets: DataFrame, key: str, bucket: str, count: str, size: int, norm: int = 1) -> DataFrame:
    """(key, features): counts of buckets as a sparse vector of length 1 in the given norm. Only the last step, from sorted pairs to ML's type, is Python."""
    total = F.sum(count).over(Window.partitionBy(key)) if norm == 1 else F.sqrt(F.sum(F.col(count) * F.col(count)).over(Window.partitionBy(key)))
    pairs = buckets.withColumn("_v", F.col(count) / total).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(bucket).cast("int").alias("i"), F.col("_v").alias("v")))).alias("_p"))
    build = F.udf(lambda p: Vectors.sparse(size, [x["i"] for x in p], [x["v"] for x in p]), VectorUDT())
    return pairs.select(key, build("_p").alias("features"))
