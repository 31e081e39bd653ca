"""Evaluation of answers and of label parsing; the publish gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grocerlake.sources.tables import store

# Metrics by direction, and the gate's limits.
HIGHER = ["route_accuracy", "abstain_accuracy", "source_recall_at_3", "mean_reciprocal_rank", "required_fact_coverage"]
LOWER = ["retrieval_latency_mean_ms", "retrieval_latency_p50_ms", "retrieval_latency_p95_ms"]
THRESHOLDS = {
    "route_accuracy": 1.0, "abstain_accuracy": 1.0, "source_recall_at_3": 0.8,
    "mean_reciprocal_rank": 0.7, "required_fact_coverage": 0.9, "retrieval_latency_p95_ms": 250.0,
}
PLACEHOLDER_CODE = "12345678"
#: Ranges in which a round of a search for a place counts.
RANGES = 256


def effective_barcode(barcode: Column, expected_route: Column) -> Column:
    """A mixed case without a barcode is asked with a placeholder."""
    return F.when((expected_route == "mixed") & (F.coalesce(F.length(barcode), F.lit(0)) == 0), PLACEHOLDER_CODE).otherwise(barcode)


def infer_slice() -> Column:
    source = F.get(F.coalesce("expected_sources", F.array().cast("array<string>")), F.lit(0))
    inferred = (
        F.when(F.coalesce("should_abstain", F.lit(False)), "abstention")
        .when(F.col("expected_route").isin("product", "mixed"), "product_grounding")
        .otherwise(F.coalesce(F.regexp_replace(source, r"\.md$", ""), F.lit("general")))
    )
    return F.coalesce(F.col("slice"), inferred)


def case_metrics(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Metrics of each case against its answer (id, route, abstained, answer, sources, retrieval_ms).

    What a case does not expect is null for recall, rank and facts, and right for route and abstention.
    """
    both = cases.withColumn("slice", infer_slice()).join(answers, "id")
    expected, sources = F.coalesce("expected_sources", F.array().cast("array<string>")), F.coalesce("sources", F.array().cast("array<string>"))
    found = F.filter(F.transform(sources, lambda s, i: F.when(F.array_contains(expected, s), i + 1)), lambda r: r.isNotNull())
    facts = F.coalesce("required_facts", F.array().cast("array<string>"))
    held = F.size(F.filter(facts, lambda f: F.contains(F.lower(F.col("answer")), F.lower(f))))
    has_sources, has_facts = F.size(expected) > 0, F.size(facts) > 0
    return both.select(
        "id", "slice",
        F.coalesce(F.col("route") == F.col("expected_route"), F.lit(True)).alias("route_correct"),
        F.coalesce(F.col("abstained") == F.col("should_abstain"), F.lit(True)).alias("abstain_correct"),
        F.when(has_sources, F.size(F.array_intersect(sources, expected)) / F.size(expected)).alias("source_recall"),
        F.when(has_sources, F.coalesce(F.lit(1.0) / F.get(found, F.lit(0)), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(has_facts, F.round(held / F.size(facts), 4)).alias("required_fact_coverage"),
        F.coalesce("retrieval_ms", F.lit(0.0)).alias("retrieval_ms"),
    )


def _mean(c: str) -> Column:
    return F.coalesce(F.round(F.avg(F.col(c).cast("double")), 4), F.lit(0.0))


def order_statistics(rows: DataFrame, column: str, quantiles: dict[str, float], *groups: str) -> DataFrame:
    """(groups, name, value) of named quantiles: the value whose place, from 0, is q of the way up, places rounded half to even; nulls and NaN do not count.

    Values are never ordered or gathered.  A round counts the values of each group in RANGES ranges between the least and greatest that can still be meant,
    and goes on in the range that holds the place, with its least and greatest value, until these are equal.  All groups and quantiles go together; what
    is kept between rounds is a row for each.
    """
    held = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    held = store(held.select(F.struct(*groups, F.lit(0).alias("_")).alias("_g"), F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.col(column).cast("double"))).alias("v")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
    state = held.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("*", F.explode(wanted).alias("w"))
    state = store(state.select("_g", "w.name", "lo", "hi", F.bround((F.col("n") - 1) * F.col("w.q"), 0).cast("long").alias("place")))
    done = state.where("lo = hi")
    while not (state := state.where("lo < hi")).isEmpty():
        s, h = state.alias("s"), held.alias("h")
        inside = h.join(s, F.col("h._g").eqNullSafe(F.col("s._g")) & (F.col("h.v") >= F.col("s.lo")) & (F.col("h.v") <= F.col("s.hi")))
        part = F.least(F.lit(RANGES - 1), F.floor((F.col("v") / 4 - F.col("lo") / 4) / (F.col("hi") / 4 - F.col("lo") / 4) * RANGES))
        counts = inside.groupBy("s._g", "name", "place", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # at most RANGES rows a group and quantile
        up = Window.partitionBy("_g", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("n").over(up)).where((F.col("place") < F.col("_upto")) & (F.col("place") >= F.col("_upto") - F.col("n")))
        state = store(counts.select("_g", "name", "lo", "hi", (F.col("place") - F.col("_upto") + F.col("n")).alias("place")))
        done = done.unionByName(state.where("lo = hi"))
    return done.select(*[F.col("_g")[g].alias(g) for g in groups], "name", F.col("lo").alias("value"))


def accuracy_aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("case_count"), *[_mean(c).alias(n) for c, n in (("route_correct", HIGHER[0]), ("abstain_correct", HIGHER[1]), ("source_recall", HIGHER[2]), ("reciprocal_rank", HIGHER[3]))]]


def aggregate_metrics(cases: DataFrame) -> DataFrame:
    """One row of means, and of the latency's median (the mean of the two middle values) and 95 % place."""
    r2 = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    row = cases.agg(*accuracy_aggregates(), _mean("required_fact_coverage").alias(HIGHER[4]), r2(F.avg("retrieval_ms")).alias(LOWER[0]))
    # the middle places of n values, n even, are rounded down and up from (n - 1) / 2, which half to even gives only one of
    n = cases.where("retrieval_ms is not null").count()
    low, high = (n - 1) // 2, n // 2
    places = {"low": low / max(1, n - 1), "high": high / max(1, n - 1), "p95": 0.95}
    found = order_statistics(cases, "retrieval_ms", places)
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    ranks = found.agg(r2((value("low") + value("high")) / 2).alias(LOWER[1]), r2(value("p95")).alias(LOWER[2]))
    return row.crossJoin(ranks)  # one row each


def slice_metrics(cases: DataFrame) -> DataFrame:
    return cases.groupBy("slice").agg(*accuracy_aggregates())


def wilson_interval(successes: Column, total: Column, z: float = 1.96) -> Column:
    """struct(lower, upper), clamped to 0 and 1, to four places; zeros without trials."""
    n = F.greatest(total, F.lit(1)).cast("double")
    p = successes / n
    scale = 1 + z * z / n
    center, margin = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    bound = lambda v: F.when(total > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 4)).otherwise(0.0)
    return F.struct(bound(center - margin).alias("lower"), bound(center + margin).alias("upper"))


def _unpivot(metrics: DataFrame, names: list[str], value: str) -> DataFrame:
    there = metrics.columns
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(n).cast("double") if n in there else F.lit(0.0)).alias(value)) for n in names])
    return metrics.select(F.explode(rows).alias("r")).select("r.metric", F.coalesce(f"r.{value}", F.lit(0.0)).alias(value))


def compare_metrics(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, candidate, baseline, delta, regressed) of two one-row tables; a missing metric is 0."""
    names = sorted(HIGHER + LOWER)
    both = _unpivot(candidate, names, "candidate").join(_unpivot(baseline, names, "baseline"), "metric")
    delta = F.round(F.col("candidate") - F.col("baseline"), 4)
    return both.withColumn("delta", delta).withColumn("regressed", F.when(F.col("metric").isin(*HIGHER), F.col("delta") < 0).otherwise(F.col("delta") > 0))


def metric_trend(runs: DataFrame, metric: str) -> DataFrame:
    """Runs (id, dataset_name, dataset_hash, created_at, metric) with the metric of the run before on the same data, and the difference."""
    w = Window.partitionBy("dataset_name", "dataset_hash").orderBy("created_at", "id")
    return runs.withColumn("previous", F.lag(metric).over(w)).withColumn("delta", F.round(F.col(metric) - F.col("previous"), 4))


def gate(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row: passed, failed; failures).  Metrics in milliseconds must not exceed their limit, others must reach it."""
    limits = thresholds or THRESHOLDS
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    judged = _unpivot(metrics, list(limits), "actual").withColumn("threshold", table[F.col("metric")])
    is_time = F.endswith(F.col("metric"), F.lit("_ms"))
    judged = judged.withColumn("operator", F.when(is_time, "<=").otherwise(">=")).withColumn("failed", F.when(is_time, F.col("actual") > F.col("threshold")).otherwise(F.col("actual") < F.col("threshold")))
    decision = judged.agg(F.count_if("failed").alias("failures")).select((F.col("failures") == 0).alias("passed"), "failures")
    return decision, judged.where("failed").drop("failed")


def field_metrics(pairs: DataFrame) -> DataFrame:
    """Rows of expected and actual nutriments (maps of doubles) and allergens to precision, recall, F1, numeric accuracy and allergen recall.

    A number is right within 2 % or 0.01.  Without common fields the numeric accuracy is 0.
    """
    e, a = F.coalesce("expected", F.create_map().cast("map<string,double>")), F.coalesce("actual", F.create_map().cast("map<string,double>"))
    base = pairs.withColumns({"_e": e, "_a": a})
    common = F.array_intersect(F.map_keys("_e"), F.map_keys("_a"))
    close = F.filter(common, lambda k: F.abs(F.col("_a")[k] - F.col("_e")[k]) <= F.greatest(F.lit(0.01), F.abs(F.col("_e")[k]) * 0.02))
    base = base.withColumns({"_n": F.size(common), "_close": F.size(close)})
    p, r = F.col("_n") / F.greatest(F.lit(1), F.size("_a")), F.col("_n") / F.greatest(F.lit(1), F.size("_e"))
    wanted, got = F.col("expected_allergens"), F.coalesce("actual_allergens", F.array().cast("array<string>"))
    return base.withColumns(
        {
            "field_precision": F.round(p, 4), "field_recall": F.round(r, 4), "field_f1": F.round(2 * p * r / F.greatest(F.lit(1e-9), p + r), 4),
            "numeric_accuracy": F.round(F.col("_close") / F.greatest(F.lit(1), F.col("_n")), 4),
            "allergen_recall": F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, got)) / F.size(wanted), 4)),
        }
    ).drop("_e", "_a", "_n", "_close")


def provider_cer(cases: DataFrame) -> DataFrame:
    """(id, provider, cer) of each provider's text of a case (ground_truth_text, ocr_text_by_provider)."""
    from grocerlake.functions.text import cer

    rows = cases.select("id", "ground_truth_text", F.explode("ocr_text_by_provider").alias("provider", "text"))
    return rows.select("id", "provider", cer(F.col("ground_truth_text"), F.col("text")).alias("cer"), "text")


def best_provider(cers: DataFrame) -> DataFrame:
    """The provider of each case with the least error rate; of equal ones the first by name."""
    best = cers.groupBy("id").agg(F.min(F.struct("cer", "provider", "text")).alias("b"))
    return best.select("id", F.col("b.provider").alias("best_provider"), F.col("b.cer").alias("cer"), F.col("b.text").alias("text"))


def ocr_case_metrics(cases: DataFrame, parsed: DataFrame) -> DataFrame:
    """Cases (id, expected, expected_allergens, ...) with what was parsed (id, actual, actual_allergens)."""
    return field_metrics(cases.join(parsed, "id", "left"))


def correction_metrics(extractions: DataFrame) -> DataFrame:
    """Predictions of confirmed extractions against the corrections: the same measures."""
    shown = extractions.where("confirmed_nutriments is not null")
    renamed = {"confirmed_nutriments": "expected", "nutriments": "actual", "confirmed_allergens": "expected_allergens", "allergens": "actual_allergens"}
    return field_metrics(shown.withColumnsRenamed(renamed))


def ocr_aggregate(cases: DataFrame, least_cases: int = 200, least_f1: float = 0.85) -> DataFrame:
    """One row of means, without nulls, and readiness."""
    m = cases.agg(F.count(F.lit(1)).alias("case_count"), *[_mean(c).alias(c) for c in ("field_precision", "field_recall", "field_f1", "numeric_accuracy", "allergen_recall")])
    return m.withColumn("ready", (F.col("case_count") >= least_cases) & (F.col("field_f1") >= least_f1))
