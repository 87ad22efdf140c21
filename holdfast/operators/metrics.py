"""Scores of label sequences against truth: by frame, by segment, by dataset; audits and rankings of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import integer_segments, islands, ranked


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pred: str = "pred", gt: str = "gt") -> list[Column]:
    p, g = F.col(pred), F.col(gt)
    hits = {"tp": (p == 1) & (g == 1), "fp": (p == 1) & (g == 0), "tn": (p == 0) & (g == 0), "fn": (p == 0) & (g == 1)}
    return [F.count_if(v).alias(k) for k, v in hits.items()]


def accuracy(pred: str = "pred", gt: str = "gt") -> Column:
    return F.coalesce(F.avg((F.col(pred) == F.col(gt)).cast("int")), F.lit(0.0)).alias("accuracy")


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes from tp, fp, tn, fn; 0 where there is nothing to divide by."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    df = df.withColumns({"positive_precision": _rate(tp, tp + fp), "positive_recall": _rate(tp, tp + fn), "negative_precision": _rate(tn, tn + fn), "negative_recall": _rate(tn, tn + fp), "positive_support": tp + fn, "negative_support": tn + fp})
    f1 = lambda k: _rate(2.0 * F.col(f"{k}_precision") * F.col(f"{k}_recall"), F.col(f"{k}_precision") + F.col(f"{k}_recall"))
    df = df.withColumns({"positive_f1": f1("positive"), "negative_f1": f1("negative")})
    return df.withColumns({"macro_f1": (F.col("positive_f1") + F.col("negative_f1")) / 2, "accuracy": _rate(tp + tn, tp + fp + tn + fn)})


RATES = ("accuracy", "positive_precision", "positive_recall", "positive_f1", "negative_precision", "negative_recall", "negative_f1", "macro_f1")
COUNTS = ("tp", "fp", "tn", "fn")


def by_dataset(df: DataFrame, keys: list[str]) -> DataFrame:
    return rates(df.groupBy(*keys).agg(*confusion()))


def micro(datasets: DataFrame) -> DataFrame:
    """All datasets' frames as one: their confusions added, the rates anew."""
    return rates(datasets.agg(*[F.sum(k).alias(k) for k in COUNTS]))


def macro(datasets: DataFrame) -> DataFrame:
    """Means of the datasets' rates, sums of their counts."""
    return datasets.agg(*[F.avg(k).alias(k) for k in RATES], *[F.sum(k).alias(k) for k in COUNTS], F.count("*").alias("n_datasets"))


def segments(df: DataFrame, keys: list[str], order: str, label: str, background: tuple = (0,)) -> DataFrame:
    """(label, start, end) of runs that aren't background, numbered in order; end is exclusive."""
    found = islands(df, keys, order, label, step=None).where(~F.col(label).isin(*background)) if background else islands(df, keys, order, label, step=None)
    w = Window.partitionBy(*keys).orderBy("first")
    return found.select(*keys, F.col(label).alias("label"), F.col("first").alias("start"), (F.col("last") + 1).alias("end"), (F.row_number().over(w) - 1).alias("nth"))


#: Frames of a stretch of time: segments meet only those of the stretches that they touch.
STRETCH = 256


def segmental_f1(pred: DataFrame, gt: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """F1 by overlap of segments: a prediction's best truth of its label counts once for each threshold its overlap reaches.

    Thresholds are above 0, so that only segments that overlap need to meet.
    """
    place = lambda c: F.floor(c / STRETCH)
    p, g = (df.withColumn("stretch", F.explode(F.sequence(place(F.col("start")), place(F.col("end") - 1)))).alias(name) for df, name in ((pred, "p"), (gt, "g")))
    on = [F.col(f"p.{k}") == F.col(f"g.{k}") for k in [*keys, "label", "stretch"]]
    inter = F.least("p.end", "g.end") - F.greatest("p.start", "g.start")
    union = F.greatest("p.end", "g.end") - F.least("p.start", "g.start")
    once = F.col("p.stretch") == place(F.greatest("p.start", "g.start"))  # the first stretch that both touch
    over = inter / union
    best = p.join(g, on).where(once & (inter > 0)).groupBy(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.nth").alias("nth")).agg(F.min_by(F.struct(over.alias("iou"), F.col("g.nth").alias("gt")), F.struct(-over, F.col("g.nth"))).alias("b"))
    hits = best.groupBy(*keys).agg(*[F.count_distinct(F.when(F.col("b.iou") >= t, F.col("b.gt"))).alias(f"tp_{round(t * 100)}") for t in thresholds])
    n = pred.groupBy(*keys).agg(F.count("*").alias("n_pred")).join(gt.groupBy(*keys).agg(F.count("*").alias("n_gt")), keys, "full")
    out = n.join(hits, keys, "left").fillna(0)
    return out.select(*keys, "n_pred", "n_gt", *[(F.coalesce(F.try_divide(2.0 * F.col(f"tp_{round(t * 100)}"), F.col("n_pred") + F.col("n_gt")), F.lit(0.0)) * 100).alias(f"f1_{round(t * 100)}") for t in thresholds])


def edit_score(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """100 x (1 - Levenshtein distance of the segments' labels / the longer's number); both empty: 0.

    A label becomes one character, the place of its kind among a sequence's kinds of labels, so that it is one step whatever its
    name. Null is a label of its own.
    """
    names = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "label"))), lambda s: F.coalesce(F.concat(F.lit("="), s.label.cast("string")), F.lit("null"))).alias(name))
    none = F.array().cast("array<string>")
    both = names(pred, "a").join(names(gt, "b"), keys, "full").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    both = both.withColumn("kinds", F.array_distinct(F.concat("a", "b")))
    letter = lambda x: F.decode(F.unhex(F.hex(F.lit(0x4E00) + F.array_position(F.col("kinds"), x))), "UTF-16BE")
    both = both.withColumns({c: F.array_join(F.transform(c, letter), "") for c in ("a", "b")})
    longer = F.greatest(F.length("a"), F.length("b"))
    return both.select(*keys, F.when(longer > 0, (1 - F.levenshtein("a", "b") / longer) * 100).otherwise(0.0).alias("edit"))


def evaluate(df: DataFrame, keys: list[str], order: str, thresholds: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """The bundle for sequences with pred and gt; predictions may be probabilities, 1 from .5 on."""
    df = df.withColumn("pred", (F.col("pred") >= 0.5).cast("int"))
    p, g = (segments(df, keys, order, c) for c in ("pred", "gt"))
    base = df.groupBy(*keys).agg(accuracy(), F.count("*").alias("n_frames"), *confusion())
    return base.join(segmental_f1(p, g, keys, thresholds), keys, "left").join(edit_score(p, g, keys), keys, "left").fillna(0)


def batch_summary(datasets: DataFrame, key: str, rates_: list[str], counts: list[str], frames: str) -> DataFrame:
    """The datasets' rows, rounded, and below them __macro__ and __weighted__ (by frames), computed from the rounded rows."""
    rounded = datasets.select(F.col(key).cast("string").alias(key), frames, *[F.round(c, 4).alias(c) for c in rates_], *counts)
    sums = [F.sum(frames).cast("bigint").alias(frames)]
    tail = [F.sum(c).cast("bigint").alias(c) for c in counts]
    mean = rounded.agg(*sums, *[F.round(F.avg(c), 4).alias(c) for c in rates_], *tail).select(F.lit("__macro__").alias(key), frames, *rates_, *counts)
    weighted = [F.round(F.try_divide(F.sum(F.col(c) * F.col(frames)), F.sum(frames).cast("double")), 4).alias(c) for c in rates_]
    share = rounded.agg(*sums, *weighted, *tail).select(F.lit("__weighted__").alias(key), frames, *rates_, *counts)
    return rounded.unionByName(mean).unionByName(share)


def summary_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    named = {"count": F.count(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": F.median(v), "std": F.stddev_pop(v)}
    return df.groupBy(*keys).agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in named.items()])


def heatmap(df: DataFrame, keys: list[str], x: Column, y: Column, bins: int) -> DataFrame:
    """Counts on a grid over the unit square, its last bins closed; places outside are dropped."""
    cell = lambda c: F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    return df.where(x.between(0, 1) & y.between(0, 1)).groupBy(*keys, cell(x).alias("bin_x"), cell(y).alias("bin_y")).agg(F.count("*").alias("n"))


def entropy(cells: DataFrame, keys: list[str]) -> DataFrame:
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return cells.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy_bits"), F.count("*").alias("occupied"))


def coverage(pred: DataFrame, gt: DataFrame, key: str, frame: str) -> DataFrame:
    """Per dataset how frames of predictions and truth cover each other."""
    both = pred.select(key, frame).distinct().withColumn("p", F.lit(True)).join(gt.select(key, frame).distinct().withColumn("g", F.lit(True)), [key, frame], "full")
    p, g = F.coalesce("p", F.lit(False)), F.coalesce("g", F.lit(False))
    out = both.groupBy(key).agg(
        F.count_if(p).alias("pred_n"), F.count_if(g).alias("gt_n"), F.count_if(p & g).alias("overlap_n"), F.count_if(p & ~g).alias("missing_gt"), F.count_if(g & ~p).alias("missing_pred"),
        F.min(F.when(p, F.col(frame))).alias("pred_min"), F.max(F.when(p, F.col(frame))).alias("pred_max"), F.min(F.when(g, F.col(frame))).alias("gt_min"), F.max(F.when(g, F.col(frame))).alias("gt_max"),
        F.min(F.when(p & ~g, F.col(frame))).alias("first_missing"),
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return out.withColumns({"gt_over_pred": share("overlap_n", "pred_n"), "pred_over_gt": share("overlap_n", "gt_n"), "missing_tail_only": F.coalesce(F.col("first_missing") > F.col("gt_max"), F.lit(False))}).drop("first_missing")


def missing_segments(pred: DataFrame, gt: DataFrame, key: str, frame: str) -> DataFrame:
    """Per dataset the runs of frames that only predictions have (missing_gt_segments), and only the truth (missing_pred_segments),
    each as JSON of [first, last, length]; an empty list without any. Null frames are none; a null dataset is one.

    Runs are found by windows; what is gathered are runs, not frames.
    """
    p, g = (df.where(F.col(frame).isNotNull()).select(key, frame).distinct() for df in (pred, gt))
    both = p.withColumn("p", F.lit(1)).withColumn("g", F.lit(0)).unionByName(g.withColumn("p", F.lit(0)).withColumn("g", F.lit(1))).groupBy(key, frame).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    alone = both.where("p <> g").withColumn("side", F.col("p"))
    found = integer_segments(alone, [key, "side"], frame)
    lists = found.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.array("first", "last", "length")))).alias(n) for s, n in ((1, "missing_gt_segments"), (0, "missing_pred_segments"))])
    known = both.select(key).distinct()
    out = known.join(lists.withColumnRenamed(key, "__key"), known[key].eqNullSafe(F.col("__key")), "left")
    return out.select(key, *[F.coalesce(F.to_json(n), F.lit("[]")).alias(n) for n in ("missing_gt_segments", "missing_pred_segments")])


def coverage_gates(audit: DataFrame, least: float, tail_only: bool = True) -> DataFrame:
    """Datasets that the audit refuses: coverage below ``least``, or missing frames other than a tail."""
    bad = F.coalesce(F.col("gt_over_pred") < least, F.lit(True))
    return audit.where(bad | ((F.col("missing_gt") > 0) & ~F.col("missing_tail_only")) if tail_only else bad)


def coverage_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n"), F.sum("pred_n").cast("bigint").alias("pred_n"), F.sum("overlap_n").cast("bigint").alias("overlap_n"), F.round(F.avg("gt_over_pred"), 6).alias("macro"), F.round(F.sum("overlap_n") / F.sum("pred_n"), 6).alias("weighted"), F.count_if("missing_tail_only").alias("n_tail_only"))


def with_baseline(strict: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each dataset's strict scores beside the baseline's and their difference; a dataset without a baseline run has nulls."""
    other = baseline.select(key, *[F.col(c).alias(f"baseline_{c}") for c in columns], F.lit(True).alias("has_baseline"))
    out = strict.join(other, key, "left").withColumns({f"delta_{c}": F.col(c) - F.col(f"baseline_{c}") for c in columns})
    return out.withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))


def diagnostics(df: DataFrame) -> DataFrame:
    """Rates of a run's errors; null where there is nothing to divide by."""
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, tn, fn = (F.col(k) for k in COUNTS)
    return df.withColumns({
        "mismatch": fp + fn, "pred_pos": tp + fp, "gt_pos": tp + fn, "fp_rate": share(fp, tp + fp), "fn_rate": share(fn, tp + fn),
        "density": share(F.col("n_aligned"), F.col("n_gt")), "aligned_share": share(F.col("n_aligned"), F.col("n_selected")), "gt_pos_rate": share(tp + fn, F.col("n_aligned")),
    })


def priorities(df: DataFrame) -> DataFrame:
    """Datasets by how much they need a look: failures, low accuracy, mismatches, few samples, low coverage."""
    parts = [
        F.when(F.col("status") != "success", 1000.0).otherwise(0.0), F.coalesce((1 - F.col("accuracy")) * 50, F.lit(50.0)), (F.col("fp") + F.col("fn")) * 10.0,
        F.when(F.col("n_aligned") < 5, 20.0).otherwise(0.0), F.coalesce((1 - F.col("aligned_share")) * 20, F.lit(0.0)),
    ]
    scored = df.withColumn("priority_score", sum(parts[1:], parts[0]))
    return ranked(scored, [], [F.desc("priority_score"), F.col("dataset_key")], "priority_rank").withColumn("priority_rank", F.col("priority_rank") + 1)


def segment_durations(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Own definition (the original's formula isn't public): nth segments of one label are paired; mean absolute and mean
    signed difference of their lengths, and how many segments of either side have no partner."""
    def nth(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys, "label").orderBy("start")
        return df.select(*keys, "label", F.row_number().over(w).alias("k"), (F.col("end") - F.col("start")).alias(name))

    both = nth(pred, "a").join(nth(gt, "b"), [*keys, "label", "k"], "full")
    d = F.col("a") - F.col("b")
    return both.groupBy(*keys, "label").agg(F.avg(F.abs(d)).alias("maed"), F.avg(d).alias("msde"), F.count_if(F.col("a").isNull()).alias("missed"), F.count_if(F.col("b").isNull()).alias("extra"))


def label_precision(df: DataFrame, label: str, gt: str) -> DataFrame:
    """For each label how many frames have it, how many rightly, and the share."""
    right = F.count_if(F.col(label) == F.col(gt))
    return df.groupBy(label).agg(F.count("*").alias("n"), right.alias("right"), (right / F.count("*")).alias("precision"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by an order that names a unique key last."""
    return df.orderBy(*order).limit(n)
