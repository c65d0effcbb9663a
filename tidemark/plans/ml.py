"""Training, evaluation, comparison, scoring and drift, on Spark throughout."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import inf, nextafter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRIFT_FLOOR, MODERATE, SIGNIFICANT = 1e-4, 0.1, 0.25
#: Into how many ranges of its quantiles a number is cut for the trees.
BINS = 32
FLOORS, GUARDRAILS = {"roc_auc": 0.70}, {"roc_auc": -0.01, "brier": 0.005}


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Numbers as doubles with a flag where missing, categories as text with ``unknown`` where missing."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric}
    return df.withColumns(flags | {c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categorical})


def train(prepared: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, seed: int = 7, iterations: int = 30):
    """A pipeline of imputer, ranges of quantiles, encoders and boosted trees, fitted on the cluster.

    A tree asks no more of a number than its range, as boosted trees on Spark do anyway (a quantile itself is a range of its own
    here, so that a frequent value is told from those around it). All rows count: those that agree in every range, flag, category
    and label are one row with their number as its weight, so the passes of the boosting do not grow with the table.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    filled, ranged = [f"{c}_filled" for c in numeric], [f"{c}_range" for c in numeric]
    stages = [Imputer(inputCols=list(numeric), outputCols=filled).fit(prepared)]
    shares = [i / BINS for i in range(1, BINS)]
    edges = stages[0].transform(prepared).agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in filled)).first()  # one row of fixed size
    splits = [[-inf, *sorted({x for e in edges[c] or [] for x in (e, nextafter(e, inf))} - {-inf, inf}), inf] for c in filled]
    splits = [s if len(s) > 2 else [-inf, 0.0, inf] for s in splits]  # a number without values
    stages.append(Bucketizer(splitsArray=splits, inputCols=filled, outputCols=ranged))
    inputs = ranged + [f"{c}_missing" for c in numeric]
    told = list(inputs)
    if categorical:
        indexed, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep").fit(prepared))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot).fit(PipelineModel(stages).transform(prepared)))
        told, inputs = told + indexed, inputs + hot
    alike = PipelineModel(stages[:3]).transform(prepared).groupBy(*told, label).agg(F.count("*").cast("double").alias("_weight"))
    alike = alike.withColumns({c: F.col(c).alias(c, metadata={}) for c in ranged})  # numbers in order, no categories
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    trees = GBTClassifier(labelCol=label, weightCol="_weight", seed=seed, maxIter=iterations, maxDepth=4, maxBins=2 * BINS)
    stages.append(assembler)
    return PipelineModel([*stages, trees.fit(assembler.transform(PipelineModel(stages[3:-1]).transform(alike)))])


def running(rows: DataFrame, by: Sequence[str], at: str, sums: Sequence[str], ranges: int = 64) -> DataFrame:
    """``rows`` with ``before_<x>`` for each x in ``sums``: its sum over the group's rows of smaller ``at``, which is distinct in a group.

    Each group is cut into ranges of ``at``; a window runs inside each range, on top of the sums of the ranges before it. So a
    group with many rows takes as many tasks as it has ranges.
    """
    edges = rows.groupBy(*by).agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 1000).alias("_edges"))  # a row a group
    placed = rows.join(edges, list(by)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(at)))).drop("_edges")
    totals = placed.groupBy(*by, "_range").agg(*(F.sum(x).alias(f"_{x}") for x in sums))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows a group as there are ranges
    totals = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"_{x}") for x in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(totals, [*by, "_range"])
    return joined.withColumns({f"before_{x}": F.col(f"_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums}).drop("_range", *(f"_{x}" for x in sums))


def metrics(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", tie: str | None = None) -> DataFrame:
    """ROC AUC, average precision, log loss, Brier score, top-decile lift and base rate for each group of ``by``.

    Rows are first counted by score, and sums run along the distinct scores by ``running``; ties share their average rank. The
    top decile are the first ``ceil(0.1 n)`` rows by falling score; of rows with one score those with the smallest ``tie``
    come first, or, without it, the score's average share of positives counts.
    """
    by = list(by)
    group = [*by, "_g"]
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, F.lit(1).alias("_g"), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("p"), *([F.col(tie).alias("tie")] if tie else []))
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    counted = rows.groupBy(*group, "p").agg(F.sum("y").alias("pos"), F.count("*").cast("double").alias("n"), F.sum(loss).alias("loss"), F.sum((F.col("p") - F.col("y")) ** 2).alias("brier"))
    whole = counted.groupBy(*group).agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "pos")))
    seen = running(counted, group, "p", ["n", "pos"]).join(whole, group)
    above, hits = F.col("all_n") - F.col("before_n") - F.col("n"), F.col("all_pos") - F.col("before_pos")
    top = F.greatest(F.lit(1.0), F.ceil(F.col("all_n") * 0.1).cast("double"))
    seen = seen.withColumns({"top": top, "inside": F.greatest(F.lit(0.0), F.least(F.col("n"), top - above))})
    cut = seen.where("inside > 0 and inside < n").select(*group, "p", F.col("inside").alias("take"))  # a score a group at most
    sums = seen.groupBy(*group).agg(
        F.sum("n").alias("total"), F.sum("pos").alias("positive"), F.sum(F.col("pos") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum(F.col("pos") * hits / (above + F.col("n"))).alias("ap"),
        F.sum("loss").alias("loss"), F.sum("brier").alias("brier"), F.sum(F.when(F.col("inside") < F.col("n"), F.col("pos") / F.col("n") * F.col("inside")).otherwise(F.when(F.col("inside") > 0, F.col("pos")).otherwise(0.0))).alias("shared"),
        F.sum(F.when(F.col("inside") >= F.col("n"), F.col("pos")).otherwise(0.0)).alias("certain"), F.max("top").alias("top"),
    )
    if tie:
        tied = rows.join(cut, [*group, "p"]).groupBy(*group, "take", "tie").agg(F.sum("y").alias("pos"), F.count("*").cast("double").alias("n"))
        first = running(tied, group, "tie", ["n"]).withColumn("in", F.greatest(F.lit(0.0), F.least(F.col("n"), F.col("take") - F.col("before_n"))))
        sums = sums.join(first.groupBy(*group).agg(F.sum(F.col("pos") / F.col("n") * F.col("in")).alias("of_tied")), group, "left").withColumn("shared", F.col("certain") + F.coalesce("of_tied", F.lit(0.0)))
    pos, n = F.col("positive"), F.col("total")
    neg = n - pos
    return sums.select(
        *by, n.cast("long").alias("test_rows"),
        F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / (pos * neg)).alias("roc_auc"), F.when(pos > 0, F.col("ap") / pos).alias("pr_auc"),
        (F.col("loss") / n).alias("log_loss"), (F.col("brier") / n).alias("brier"), F.when(pos > 0, F.col("shared") / F.col("top") / (pos / n)).alias("top_decile_lift"), (pos / n).alias("base_rate"),
    )


def agree(one: dict, two: dict, within: float = 0.01) -> bool:
    """Whether two trainings on the same rows came to the same metrics, counts exactly.

    Sums of doubles depend on the order in which blocks arrive at a task, so that two equally good splits may swap places.
    """
    near = lambda a, b: a == b if a is None or b is None or isinstance(a, int) else abs(a - b) <= within * max(1.0, abs(a))
    return one.keys() == two.keys() and all(near(one[k], two[k]) for k in one)


def compare(evaluated: DataFrame, role: str = "role", min_gain: float = 0.0) -> DataFrame:
    """(promote, reasons): whether the challenger replaces the champion, from a row of metrics for each role."""
    pick = lambda r, m: F.max(F.when(F.col(role) == r, F.col(m))).alias(f"{r}_{m}")
    one = evaluated.agg(*(pick(r, m) for r in ("challenger", "champion") for m in ("roc_auc", "pr_auc", "brier")))
    new, old = (lambda m: F.col(f"challenger_{m}")), (lambda m: F.col(f"champion_{m}"))
    has = old("pr_auc").isNotNull()
    reasons = [F.when(F.coalesce(new(m) < v, F.lit(True)), F.lit(f"{m} below floor")) for m, v in FLOORS.items()]
    reasons.append(F.when(has & (new("pr_auc") - old("pr_auc") < min_gain), F.lit("pr_auc gain too small")))
    reasons.append(F.when(has & (new("roc_auc") - old("roc_auc") < GUARDRAILS["roc_auc"]), F.lit("roc_auc worse than allowed")))
    reasons.append(F.when(has & (new("brier") - old("brier") > GUARDRAILS["brier"]), F.lit("brier worse than allowed")))
    found = one.withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    return found.select((F.size("reasons") == 0).alias("promote"), "reasons")


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], keep: Sequence[str], schema: str, output: str = "score") -> DataFrame:
    """Any Python scorer over Arrow batches: ``load()`` runs once a task, empty batches are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            if len(batch):
                yield batch[list(keep)].assign(**{output: scorer(batch)})

    return df.mapInPandas(run, schema)


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def quantiles(tall: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(feature, edges): the distinct quantiles of each feature's values (feature, v), interpolated, exact.

    Values are counted, and counts run along them by ``running``; each value picks the places that it holds.
    """
    counted = tall.where("v is not null and not isnan(v)").groupBy("feature", "v").agg(F.count("*").alias("n"))
    total = counted.groupBy("feature").agg(F.sum("n").alias("total"))
    along = running(counted, ["feature"], "v", ["n"]).join(total, "feature")
    place = lambda q: (F.col("total") - 1) * F.lit(float(q))
    ends = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), end(place(q)).cast("long").alias("at"), place(q).alias("place")) for i, q in enumerate(shares) for side, end in ((0, F.floor), (1, F.ceil))))
    held = F.filter(ends, lambda e: (e["at"] >= F.col("before_n")) & (e["at"] < F.col("before_n") + F.col("n")))
    picked = along.select("feature", "v", F.explode(held).alias("e")).groupBy("feature", "e.i").agg(F.max("e.place").alias("place"), *(F.max(F.when(F.col("e.side") == s, F.col("v"))).alias(name) for s, name in ((0, "low"), (1, "high"))))
    share = F.col("place") - F.floor("place")
    value = F.when((share == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high"))
    return picked.groupBy("feature").agg(F.array_sort(F.collect_set(value)).alias("edges"))  # a row a feature, as many edges as shares


def psi(baseline: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, psi, status): population stability over the baseline's quantile bins, with a bin for missing values."""
    long = lambda df, tag: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select("x.*", F.lit(tag).alias("side"))
    tall = quantiles(long(baseline, "base"), [i / bins for i in range(bins + 1)])
    none = F.array().cast("array<double>")  # of a feature without any value
    both = long(baseline, "base").unionByName(long(current, "now")).join(F.broadcast(tall), "feature", "left").withColumn("edges", F.coalesce("edges", none))
    value = F.when(F.isnan("v"), None).otherwise(F.col("v"))
    inner = F.size(F.filter("edges", lambda e: e <= F.col("_v")))  # how many edges are at or below
    place = F.least(F.greatest(inner, F.lit(1)), F.greatest(F.size("edges") - 1, F.lit(1)))
    counted = both.withColumn("_v", value).withColumn("bin", F.when(F.col("_v").isNull(), -1).otherwise(place)).groupBy("feature", "bin").agg(F.sum((F.col("side") == "base").cast("double")).alias("b"), F.sum((F.col("side") == "now").cast("double")).alias("c"))
    w = Window.partitionBy("feature")
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(w), F.lit(DRIFT_FLOOR))
    shares = counted.select("feature", "bin", share("b").alias("e"), share("c").alias("a"))
    out = shares.groupBy("feature").agg(F.round(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))), 6).alias("psi"))
    return out.withColumn("status", drift_status(F.col("psi")))


def drift_status(value: Column) -> Column:
    return F.when(value > SIGNIFICANT, "significant").when(value > MODERATE, "moderate").otherwise("stable")
