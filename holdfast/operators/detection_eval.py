"""Average precision of detections: VOC-like with constraints, and COCO-like over thresholds, areas and crowds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import box
from ..staging import discard, shuffle_partitions, staged
from . import coco, curves
from .filters import same_object
from .matching import overlaps
from .runs import prefix_sums


def voc_hits(dets: DataFrame, truths: DataFrame, keys: list[str], threshold: float = 0.5, qualifies: Column | None = None) -> DataFrame:
    """``dets`` (keys, det_id, box, confidence) with tp and fp.

    A detection's best truth must overlap by more than ``threshold``. The first detection by confidence that also ``qualifies``
    (a condition on columns of both, truths' prefixed with gt_) takes it; others are false. A difficult truth counts neither way.
    """
    df = _taken(dets, truths, keys, threshold, {"": F.lit(True) if qualifies is None else qualifies})
    return df.withColumnsRenamed({"tp_": "tp", "fp_": "fp"})


def _taken(dets: DataFrame, truths: DataFrame, keys: list[str], threshold: float, tests: dict[str, Column]) -> DataFrame:
    """``dets`` with tp_<name> and fp_<name> under each of the named conditions: one match and one window for all."""
    extra = [c for c in truths.columns if c not in (*keys, "gt_id", "gt_x1", "gt_y1", "gt_x2", "gt_y2")]
    over = F.coalesce(F.col("overlap") > threshold, F.lit(False))
    good = {f"__good_{k}": over & F.coalesce(v, F.lit(False)) for k, v in tests.items()}
    df = overlaps(dets, truths, keys, extra=tuple(extra)).withColumns({**good, "__hard": over & F.coalesce(F.col("gt_difficult"), F.lit(False))})
    upto = Window.partitionBy(*keys, "gt_id").orderBy(F.desc("confidence"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.select(*dets.columns, "gt_id", "overlap", *extra, "__hard", *good, *[F.sum(F.col(g).cast("int")).over(upto).alias(g.replace("__good", "__nth")) for g in good])
    tp = {f"tp_{k}": (F.col(f"__good_{k}") & (F.col(f"__nth_{k}") == 1) & ~F.col("__hard")).cast("int") for k in tests}
    fp = {f"fp_{k}": (~F.col("__hard") & (F.col(f"tp_{k}") == 0)).cast("int") for k in tests}
    return df.withColumns(tp).withColumns(fp).drop("__hard", *good, *[g.replace("__good", "__nth") for g in good])


def precision_curve(hits: DataFrame, truths: DataFrame, by: list[str]) -> DataFrame:
    """Recall and precision after each detection in order of confidence, and the precision's envelope.

    Sums over a class run through ranges of confidence; so does the envelope, the best precision from here on.
    """
    # Ranges come from a sample: only what is summed and sorted is written before, so that hits are formed once.
    rows = staged(hits.join(_positives(truths, by), by).select(*by, "confidence", "det_id", "tp", "fp", "npos"), "hits")
    return _enveloped(prefix_sums(rows, by, [F.desc("confidence"), F.col("det_id")], {"ctp": "tp", "cfp": "fp"}), by).drop("__task", "__at")


def _positives(truths: DataFrame, by: list[str]) -> DataFrame:
    return truths.where(~F.coalesce(F.col("gt_difficult"), F.lit(False))).groupBy(*by).agg(F.count("*").alias("npos"))


def _enveloped(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with running sums ctp and cfp with recall, precision and its envelope."""
    df = df.withColumns({"recall": F.col("ctp") / F.col("npos"), "precision": F.col("ctp") / F.greatest(F.col("ctp") + F.col("cfp"), F.lit(2.0**-52))})
    # A running maximum from the other end: a frame that shrinks would be computed anew for each row.
    back = Window.partitionBy(*by, "__task").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*by).orderBy(F.desc("__task")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = df.groupBy(*by, "__task").agg(F.max("precision").alias("__most")).select(*by, "__task", F.max("__most").over(later).alias("__beyond"))
    out = df.withColumn("envelope", F.max("precision").over(back)).join(beyond, [*by, "__task"])
    return out.withColumn("envelope", F.greatest("envelope", "__beyond")).drop("__beyond")


def average_precision_of_tests(dets: DataFrame, truths: DataFrame, keys: list[str], by: list[str], tests: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """(name, by, ap) under each named condition on a detection and its truth (see ``voc_hits``); ``by`` are columns of detections.

    Detections are matched and sorted once for all conditions. Precision rises only at true positives, so these alone are kept by
    condition for the envelope.
    """
    n = {k: f"{i}" for i, k in enumerate(tests)}
    hits = _taken(dets, truths.drop(*by), keys, threshold, {n[k]: v for k, v in tests.items()})
    counts = [f"{c}_{i}" for i in n.values() for c in ("tp", "fp")]
    rows = staged(hits.join(_positives(truths, by), by).select(*by, "confidence", "det_id", "npos", *[F.col(c).cast("tinyint").alias(c) for c in counts]), "hits")
    sums = prefix_sums(rows, by, [F.desc("confidence"), F.col("det_id")], {f"c{c}": c for c in counts})
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"tp_{i}").alias("tp"), F.col(f"ctp_{i}").alias("ctp"), F.col(f"cfp_{i}").alias("cfp")) for k, i in n.items()])
    found = sums.select(*by, "npos", "__task", "__at", F.inline(F.filter(each, lambda x: x.tp == 1)))
    ap = average_precision(_enveloped(found, ["name", *by]), ["name", *by])
    groups = rows.select(*by).distinct().withColumn("name", F.explode(F.array(*map(F.lit, tests))))
    return groups.join(ap, ["name", *by], "left").fillna(0.0, ["ap"])


def average_precision(curve: DataFrame, by: list[str], eleven: bool = False) -> DataFrame:
    """Area below the envelope, or the mean of the best precisions at eleven recalls."""
    if eleven:
        points = [F.coalesce(F.max(F.when(F.col("recall") >= i * 0.1, F.col("precision"))), F.lit(0.0)) for i in range(11)]
        return curve.groupBy(*by).agg((sum(points[1:], points[0]) / 11).alias("ap"))
    return curve.groupBy(*by).agg(F.sum(F.when(F.col("tp") == 1, F.col("envelope") / F.col("npos")).otherwise(0.0)).alias("ap"))


def hit_blocks(hits: DataFrame, by: list[str], scored: bool = False) -> DataFrame:
    """``hits`` (by, confidence, det_id, tp, fp) in order of confidence as blocks (see ``curves``), with their confidences if ``scored``.

    Detections are sorted once, by ranges, and leave their task as bits.
    """
    order = [*map(F.col, by), F.desc("confidence"), F.col("det_id")]
    # Ranges come from a sample: only what is summed and sorted is written before, so that hits are formed once.
    rows = staged(hits.select(*by, "confidence", "det_id", *[F.col(c).cast("tinyint").alias(c) for c in ("tp", "fp")]), "hits")
    ranges = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    types = {"task": T.IntegerType(), "no": T.LongType(), "n": T.LongType(), "hit": T.BinaryType(), "miss": T.BinaryType(), "hits": T.LongType(), "misses": T.LongType()}
    if scored:
        types["confidences"] = T.ArrayType(rows.schema["confidence"].dataType)
    schema = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(k, t) for k, t in types.items()]])
    out = staged(ranges.select(*by, "tp", "fp", *(["confidence"] if scored else [])).mapInArrow(curves.blocks(by, scored), schema), "blocks")
    discard(rows)
    return out


def _placed(blocks: DataFrame, npos: DataFrame, by: list[str]) -> DataFrame:
    """``blocks`` of classes in ``npos`` (by, npos) with what stands before each, which is written."""
    earlier = Window.partitionBy(*by).orderBy("task", "no").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("hits", "misses")}
    before = staged(blocks.select(*by, "task", "no", "hits", "misses").join(npos, by).withColumns(sums).select("task", "no", *sums, "npos"), "before")
    return blocks.join(before, ["task", "no"])


def average_precision_of_blocks(blocks: DataFrame, npos: DataFrame, by: list[str], eleven: bool = False) -> DataFrame:
    """(by, ap) of blocks (see ``hit_blocks``) and truths (by, npos): ``average_precision`` of their ``precision_curve``, of which no row is formed."""
    of, placed = [blocks.schema[c] for c in by], _placed(blocks, npos, by)
    if eleven:
        found = placed.mapInArrow(curves.best_at_recalls(by, [i * 0.1 for i in range(11)]), T.StructType([*of, T.StructField("best", T.ArrayType(T.DoubleType()))]))
        points = [F.max(F.get("best", F.lit(i))) for i in range(11)]
        return found.groupBy(*by).agg((sum(points[1:], points[0]) / 11).alias("ap"))
    later = Window.partitionBy(*by).orderBy(F.desc("task"), F.desc("no")).rowsBetween(Window.unboundedPreceding, -1)
    most = placed.mapInArrow(curves.best(by), T.StructType([*of, T.StructField("task", T.IntegerType()), T.StructField("no", T.LongType()), T.StructField("best", T.DoubleType())]))
    beyond = most.select("task", "no", F.coalesce(F.max("best").over(later), F.lit(0.0)).alias("beyond"))
    return placed.join(beyond, ["task", "no"]).mapInArrow(curves.areas(by), T.StructType([*of, T.StructField("ap", T.DoubleType())])).groupBy(*by).agg(F.sum("ap").alias("ap"))


def average_precision_of_hits(hits: DataFrame, truths: DataFrame, by: list[str], eleven: bool = False) -> DataFrame:
    """(by, ap): ``average_precision`` of the ``precision_curve`` of ``hits``, of which no row is formed."""
    return average_precision_of_blocks(hit_blocks(hits, by), _positives(truths, by), by, eleven)


#: The names of constraints on a hand's true positive.
CONSTRAINTS = ("", "handstate", "handside", "objectbbox", "all")


def constraint(name: str, least: float = 0.5) -> Column:
    """What a detected hand must share with its truth (gt_): contact state, side, the linked object's box (object_x1.., see ``same_object``), or all three."""
    if name not in CONSTRAINTS:
        raise ValueError(f"unknown constraint {name!r}; choices: {CONSTRAINTS}")
    tests = {"handstate": F.col("contact_state") == F.col("gt_state"), "handside": F.col("hand_side") == F.col("gt_side"), "objectbbox": same_object(box("object_"), box("gt_object_"), least)}
    some = list(tests.values()) if name == "all" else [tests[name]] if name else [F.lit(True)]
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in some])


def class_average_precision(dets: DataFrame, truths: DataFrame, key: str, threshold: float = 0.5, same_case: bool = False, eleven: bool = False) -> DataFrame:
    """(class, npos, ap) of every class that truths or detections name; 0 where there are no truths or no detections.

    Detections meet truths of their own class only. Names are compared in lower case and without blanks at their ends, or as they
    stand if ``same_case``. A truth with several names (attributes) comes as several rows.
    """
    name = (lambda c: F.col(c)) if same_case else (lambda c: F.lower(F.trim(c)))
    d, g = (df.withColumn("class", name("class")) for df in (dets, truths))
    g = g if "gt_difficult" in g.columns else g.withColumn("gt_difficult", F.lit(False))
    blocks = hit_blocks(voc_hits(d, g, [key, "class"], threshold), ["class"])
    n = staged(g.groupBy("class").agg(F.count_if(~F.coalesce(F.col("gt_difficult"), F.lit(False))).alias("npos")), "truths")
    ap = average_precision_of_blocks(blocks, n.where("npos > 0"), ["class"], eleven)
    classes = blocks.select("class").unionAll(n.select("class")).distinct()
    return classes.join(n, "class", "left").join(ap, "class", "left").fillna({"npos": 0, "ap": 0.0})


def best_threshold(curve: DataFrame, by: list[str]) -> DataFrame:
    """The score where (precision x recall) / (precision + recall) is largest; classes with one truth or none take the mean of the others."""
    p, r = F.col("precision"), F.col("recall")
    return _best_threshold(curve.withColumn("f", F.coalesce(F.try_divide(p * r, p + r), F.lit(0.0))), by)


def best_threshold_of_hits(hits: DataFrame, truths: DataFrame, by: list[str]) -> DataFrame:
    """``best_threshold`` of the ``precision_curve`` of ``hits``, of which no row is formed."""
    blocks = hit_blocks(hits, by, True)
    schema = T.StructType([*[blocks.schema[c] for c in by], T.StructField("npos", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("confidence", hits.schema["confidence"].dataType)])
    return _best_threshold(_placed(blocks, _positives(truths, by), by).mapInArrow(curves.best_scores(by), schema), by)


def _best_threshold(scores: DataFrame, by: list[str]) -> DataFrame:
    out = scores.groupBy(*by).agg(F.max("npos").alias("npos"), F.max_by("confidence", F.struct("f", "confidence")).alias("t"))
    out = out.withColumn("t", F.when(F.col("npos") > 1, F.col("t")).otherwise(0.0))
    mean = out.agg(F.avg(F.when(F.col("t") != 0, F.col("t"))).alias("mean"))
    return out.join(F.broadcast(mean)).select(*by, "npos", F.when(F.col("t") != 0, F.col("t")).otherwise(F.col("mean")).alias("threshold"))


AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def _kinds(areas: dict[str, tuple[float, float]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for k, (low, high) in areas.items()]))


def coco_folded(dets: DataFrame, truths: DataFrame, areas: dict[str, tuple[float, float]], thresholds: tuple[float, ...] = THRESHOLDS, most: int = 100) -> DataFrame:
    """image_id, category_id, det_id, score, rank, matched and ignored: one row a detection, a bit a combination (see ``coco``).

    The choice depends on what was taken before, so an image and category is one array, with at most ``most`` detections; many
    arrays are folded at once, rank by rank, for all combinations.
    """
    keys, box = ["image_id", "category_id"], [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]
    d = dets.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "det_id", *box, "score"))), 1, most).alias("ds"))
    ignored = (F.col("iscrowd") == 1) | (F.col("gt_ignore") == 1)
    g = truths.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gt_id", *box, F.col("area").cast("double").alias("area"), (F.col("iscrowd") == 1).alias("crowd"), ignored.alias("ignored")))).alias("gs"))
    both = d.join(g, keys, "left").withColumn("gs", F.coalesce("gs", F.expr("slice(gs, 1, 0)"), F.array().cast(g.schema["gs"].dataType)))
    kinds = [dets.schema[c].dataType.simpleString() for c in ("det_id", "score")]
    of = [both.schema[c].dataType.simpleString() for c in keys]
    low, high = ([float(r[i]) for r in areas.values()] for i in (0, 1))
    return both.select(*keys, "ds", "gs").mapInArrow(coco.folding(low, high, list(thresholds)), f"image_id {of[0]}, category_id {of[1]}, det_id {kinds[0]}, score {kinds[1]}, rank int, matched array<bigint>, ignored array<bigint>")


def coco_match(dets: DataFrame, truths: DataFrame, areas: dict[str, tuple[float, float]] | None = None, thresholds: tuple[float, ...] = THRESHOLDS, most: int = 100) -> DataFrame:
    """Detections (image_id, category_id, det_id, x, y, w, h, score) against truths (.., x, y, w, h, area, iscrowd, gt_ignore).

    In order of score a detection takes the free truth of largest overlap (of equals the last), one that counts before an ignored
    one; a crowd is always free. Truths that are crowds, ignored or out of the area range are ignored, and so are unmatched
    detections out of the range, for each of ``areas`` (all, by default) and thresholds.

    Returns kind (of area), image_id, category_id, det_id, score, rank, threshold, matched, ignored.
    """
    areas = areas or {"all": AREAS["all"]}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("threshold"), F.lit(i).alias("i")) for i, (k, t) in enumerate((k, t) for k in areas for t in thresholds)]))
    bit = lambda c: F.expr(f"getbit({c}[c.i div 64], c.i % 64) = 1").alias(c)
    return coco_folded(dets, truths, areas, thresholds, most).withColumn("c", each).select("c.kind", "image_id", "category_id", "det_id", "score", "rank", "c.threshold", bit("matched"), bit("ignored"))


def _counted(truths: DataFrame, areas: dict[str, tuple[float, float]]) -> DataFrame:
    """(kind, category_id, npos): truths that count."""
    each = truths.where((F.col("iscrowd") == 0) & (F.col("gt_ignore") == 0)).select("category_id", "area", _kinds(areas).alias("k"))
    return each.where(F.col("area").between(F.col("k.low"), F.col("k.high"))).groupBy(F.col("k.kind").alias("kind"), "category_id").agg(F.count("*").alias("npos"))


def _named(df: DataFrame, areas: dict[str, tuple[float, float]], thresholds: tuple[float, ...]) -> DataFrame:
    """``df`` with the kind and threshold of its combination."""
    k, t = (F.array(*map(F.lit, x)) for x in (areas, thresholds))
    n = len(thresholds)
    return df.withColumns({"kind": F.get(k, F.floor(F.col("combination") / n)), "threshold": F.get(t, F.col("combination") % n)}).drop("combination")


def coco_precision(folded: DataFrame, npos: DataFrame, areas: dict[str, tuple[float, float]], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(kind, category_id, threshold, recall index 0..100, precision): the best precision at or beyond each recall; 0 beyond the last.

    ``folded`` is sorted once for all combinations, by ranges, and its rows leave their task in blocks with their sums; what stands
    before a block is a window over blocks. Ranges come from a sample of ``folded``: stage it before.
    """
    by, n = ["kind", "category_id", "threshold"], len(areas) * len(thresholds)
    order = [F.col("category_id"), F.desc("score"), F.col("image_id"), F.col("rank")]
    rows = folded.where("category_id is not null").repartitionByRange(shuffle_partitions(folded.sparkSession), *order).sortWithinPartitions(*order)
    of = folded.schema["category_id"].dataType.simpleString()
    blocks = staged(rows.select("category_id", "matched", "ignored").mapInArrow(coco.blocks(n), f"category_id {of}, task int, no bigint, hit binary, miss binary, hits array<bigint>, misses array<bigint>"), "blocks")
    earlier = Window.partitionBy("category_id", "i").orderBy("task", "no").rowsBetween(Window.unboundedPreceding, -1)
    each = blocks.select("category_id", "task", "no", F.posexplode(F.concat("hits", "misses")).alias("i", "n"))
    before = each.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy("category_id", "task", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x.n).alias("before"))
    truths = npos.groupBy("category_id").agg(F.concat(*[F.array_repeat(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("npos"))), F.lit(0)), len(thresholds)) for k in areas]).alias("npos"))
    best = blocks.join(before, ["category_id", "task", "no"]).join(truths, "category_id").select("category_id", "hit", "miss", "before", "npos")
    best = best.mapInArrow(coco.best_of_blocks(n), f"category_id {of}, combination int, at int, precision double").groupBy("category_id", "combination", "at").agg(F.max("precision").alias("precision"))
    grid = npos.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).select(*by, F.explode(F.sequence(F.lit(0), F.lit(100))).alias("at"))
    after = Window.partitionBy(*by).orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    return grid.join(_named(best, areas, thresholds), [*by, "at"], "left").select(*by, "at", F.coalesce(F.max("precision").over(after), F.lit(0.0)).alias("precision"))


def coco_recall(folded: DataFrame, npos: DataFrame, areas: dict[str, tuple[float, float]], firsts: tuple[int, ...] = (1, 10, 100), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(kind, category_id, threshold, recall_k ...): the share of truths that the first k detections of each image and category find."""
    by, n = ["kind", "category_id", "threshold"], len(areas) * len(thresholds)
    of = folded.schema["category_id"].dataType.simpleString()
    parts = folded.where("category_id is not null").select("category_id", "rank", "matched", "ignored").mapInArrow(coco.hits_of_firsts(n, firsts), f"category_id {of}, combination int, " + ", ".join(f"hits_{k} bigint" for k in firsts))
    hits = _named(parts.groupBy("category_id", "combination").agg(*[F.sum(f"hits_{k}").alias(f"hits_{k}") for k in firsts]), areas, thresholds)
    grid = npos.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return grid.join(hits, by, "left").select(*by, *[(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("npos")).alias(f"recall_{k}") for k in firsts])


def _mean(value: str, *conditions: Column) -> Column:
    """-1 marks what isn't there."""
    return F.coalesce(F.avg(F.when(reduce(lambda a, b: a & b, conditions), F.col(value))), F.lit(-1.0))


def coco_means(dets: DataFrame, truths: DataFrame) -> DataFrame:
    """One row of the twelve means: precision over all, at .50 and at .75, by area; recall with 1, 10 and 100 detections, by area."""
    m, npos = staged(coco_folded(dets, truths, AREAS), "matches"), _counted(truths, AREAS)
    kind = lambda name: F.col("kind") == name
    at = lambda t: F.col("threshold") == t
    rest = [k for k in AREAS if k != "all"]
    p = coco_precision(m, npos, AREAS).agg(_mean("precision", kind("all")).alias("ap"), _mean("precision", kind("all"), at(0.5)).alias("ap50"), _mean("precision", kind("all"), at(0.75)).alias("ap75"), *[_mean("precision", kind(k)).alias(f"ap_{k}") for k in rest])
    r = coco_recall(m, npos, AREAS).agg(*[_mean(f"recall_{k}", kind("all")).alias(f"ar_{k}") for k in (1, 10, 100)], *[_mean("recall_100", kind(k)).alias(f"ar_{k}") for k in rest])
    return p.crossJoin(r)  # one row each


def coco_means_by_category(dets: DataFrame, truths: DataFrame) -> DataFrame:
    """category_id, ap, ap_small, ap_medium, ap_large: mean precision over all thresholds; -1 marks what isn't there."""
    p = coco_precision(staged(coco_folded(dets, truths, AREAS), "matches"), _counted(truths, AREAS), AREAS)
    means = [_mean("precision", F.col("kind") == k).alias("ap" if k == "all" else f"ap_{k}") for k in AREAS]
    return p.groupBy("category_id").agg(*means, F.count_if(F.col("kind") == "all").alias("n")).where("n > 0").drop("n")
