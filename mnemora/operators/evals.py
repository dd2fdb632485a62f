"""Evaluation and benchmark aggregates over result tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVAL_TOLERANCE, BENCH_TOLERANCE, LEAST_SAMPLES, LEAST_CASES = 0.02, 0.20, 5, 10
LOWER_IS_BETTER = ("false_refusal_rate",)


def retrieval_metrics(results: DataFrame) -> DataFrame:
    """One row over results (hit_rank, cleared, refusal_correct, hop_coverage): recall, grounded recall, MRR, hop coverage, refusal accuracy; null where no case says."""
    answerable, refusal = F.col("refusal_correct").isNull(), F.col("refusal_correct").isNotNull()

    def rate(hit: Column, of: Column) -> Column:
        return F.avg(F.when(of, F.when(hit, 1.0).otherwise(0.0)))

    return results.agg(
        F.count("*").alias("cases"),
        F.count_if(answerable).alias("answerable"),
        F.count_if(refusal).alias("refusal_cases"),
        rate(F.col("hit_rank").isNotNull(), answerable).alias("recall_at_k"),
        rate(F.col("cleared"), answerable).alias("grounded_recall"),
        F.avg(F.when(answerable, F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))).alias("mrr"),
        F.avg("hop_coverage").alias("hop_coverage"),
        rate(F.col("refusal_correct"), refusal).alias("refusal_accuracy"),
    )


def agent_metrics(answers: DataFrame) -> DataFrame:
    """One row over answers (refusal case, refused, cited, keywords found of all): citation rate and keyword coverage of answered cases, false refusals, refusal accuracy."""
    case, refused = F.col("refusal"), F.col("refused")
    answered = ~case & ~refused
    return answers.agg(
        F.count("*").alias("cases"),
        F.avg(F.when(answered, F.col("cited").cast("double"))).alias("citation_rate"),
        F.avg(F.when(answered & (F.col("keywords") > 0), F.col("found") / F.col("keywords"))).alias("keyword_coverage"),
        F.avg(F.when(~case, refused.cast("double"))).alias("false_refusal_rate"),
        F.avg(F.when(case, refused.cast("double"))).alias("refusal_accuracy"),
    )


def calibration_curve(results: DataFrame, low: int = 30, high: int = 80) -> DataFrame:
    """t (hundredths), gr, ra: grounded recall and refusal accuracy at every threshold; 1 without cases. One pass over the results: counts per score are accumulated over the thresholds."""
    counts = [F.count_if(F.col("refusal_correct").isNull() & F.col("hit_score").isNotNull()).alias("answerable"), F.count_if(F.col("refusal_correct").isNotNull()).alias("refusals")]
    for t in range(low, high + 1):
        counts.append(F.count_if(F.col("refusal_correct").isNull() & (F.col("hit_score") >= t / 100)).alias(f"g{t}"))
        counts.append(F.count_if(F.col("refusal_correct").isNotNull() & (F.col("top_score") < t / 100)).alias(f"r{t}"))
    one = results.agg(*counts)
    points = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"g{t}").alias("g"), F.col(f"r{t}").alias("r")) for t in range(low, high + 1)])
    rows = one.select("answerable", "refusals", F.explode(points).alias("p"))
    share = lambda n, of: F.when(F.col(of) > 0, F.round(F.col(n) / F.col(of), 3)).otherwise(1.0)
    return rows.select("p.t", share("p.g", "answerable").alias("gr"), share("p.r", "refusals").alias("ra"), "answerable", "refusals")


def calibrate(results: DataFrame, floor: float = 0.90) -> DataFrame:
    """threshold, plateau_low, plateau_high, floor_met, thin: the middle of the best thresholds that keep the floor, else the safest."""
    curve = calibration_curve(results).withColumn("ok", F.col("ra") >= floor).withColumn("objective", F.round((F.col("ra") + F.col("gr")) / 2, 6))
    best = curve.agg(F.max(F.when(F.col("ok"), F.col("objective"))).alias("best"), F.max(F.struct("ra", "t")).alias("safe"), F.first("answerable").alias("answerable"), F.first("refusals").alias("refusals"))
    plateau = curve.crossJoin(F.broadcast(best)).where(F.col("ok") & (F.abs(F.col("objective") - F.col("best")) < 1e-9))  # best: one row
    edges = plateau.agg(F.min("t").alias("low"), F.max("t").alias("high"))
    middle = plateau.crossJoin(F.broadcast(edges)).agg(F.min(F.struct(F.abs(2 * F.col("t") - F.col("low") - F.col("high")).alias("off"), "t")).alias("m"))
    t = F.coalesce("m.t", "safe.t")
    return best.crossJoin(edges).crossJoin(middle).select(
        (t / 100).alias("threshold"),
        (F.coalesce("low", "safe.t") / 100).alias("plateau_low"),
        (F.coalesce("high", "safe.t") / 100).alias("plateau_high"),
        F.col("best").isNotNull().alias("floor_met"),
        ((F.col("answerable") < LEAST_CASES) | (F.col("refusals") < LEAST_CASES)).alias("thin"),
    )


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """samples, p50 (median), p95 (the sample at the rounded rank), mean, min, max of each group.

    The rank is taken with window counts, so a group's samples are sorted by the
    engine and spill; they are never collected into one row.
    """
    kept = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    at = kept.withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy(value)) - 1)
    p95 = F.bround(0.95 * (F.col("__n") - 1), 0).cast("int")
    middle = (F.col("__k") == F.expr("(__n - 1) div 2")) | (F.col("__k") == F.expr("__n div 2"))
    return at.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.avg(F.when(middle, F.col(value))).alias("p50"),
        F.max(F.when(F.col("__k") == F.least(p95, F.col("__n") - 1), F.col(value))).alias("p95"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def stage_summary(timings: DataFrame) -> DataFrame:
    """stage, the percentiles of its milliseconds, share of the summed medians; timings: stages (map of name to ms)."""
    each = timings.select(F.explode("stages").alias("stage", "ms"))
    out = percentiles(each, "ms", ["stage"])
    return out.withColumn("share", F.col("p50") / F.sum("p50").over(Window.partitionBy(F.lit(1))))  # a row per stage


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new, delta, regressed of two (metric, value) tables, absolute tolerance."""
    both = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full_outer")
    delta = F.round(F.col("new") - F.col("old"), 3)
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -delta).otherwise(delta)
    return both.select("metric", "old", "new", delta.alias("delta"), F.coalesce(better < -EVAL_TOLERANCE, F.lit(False)).alias("regressed"))


def compare_bench(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, change, gated, regressed of two (metric, value, samples) tables: relative tolerance, too few samples never fail."""
    both = old.select("metric", F.col("value").alias("old"), F.col("samples").alias("n0")).join(new.select("metric", F.col("value").alias("new"), F.col("samples").alias("n1")), "metric")
    change = F.col("new") / F.nullif("old", F.lit(0.0)) - 1
    gated = F.least("n0", "n1") >= LEAST_SAMPLES
    return both.select("metric", change.alias("change"), gated.alias("gated"), F.coalesce(gated & (change > BENCH_TOLERANCE), F.lit(False)).alias("regressed"))


def throughput(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overall: runs, documents, docs_per_min; per source: docs_per_min median, samples) of runs (source, ingested, started_at, ended_at) of a second or more."""
    seconds = F.unix_micros(F.col("ended_at")) / 1e6 - F.unix_micros(F.col("started_at")) / 1e6
    kept = runs.withColumn("seconds", seconds).where("ended_at is not null and coalesce(ingested, 0) > 0 and seconds >= 1")
    overall = kept.agg(F.count("*").alias("runs"), F.sum("ingested").alias("documents"), (F.sum("ingested") / (F.sum("seconds") / 60)).alias("docs_per_min"))
    per_source = percentiles(kept.withColumn("rate", F.col("ingested") / (F.col("seconds") / 60)), "rate", ["source"])
    return overall, per_source.select("source", F.col("p50").alias("docs_per_min"), "samples")


CASE = "id string, question string, uris array<string>, keywords array<string>, refusal boolean, hops array<string>"


def _document(path: str) -> dict:
    """A JSON file, or a YAML one where its library is there."""
    said = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(said) or {}
    return json.loads(said) or {}


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, question, uris, keywords, refusal, hops of an evaluation set ({name, cases: [{id, question, expect}]}); an empty one is an error."""
    rows = []
    for case in _document(path).get("cases") or ():
        expect = case.get("expect") or {}
        listed = [[str(x) for x in expect.get(k) or ()] for k in ("uris", "keywords", "hops")]
        rows.append((str(case.get("id") or case["question"][:48]), str(case["question"]), listed[0], listed[1], bool(expect.get("refusal", False)), listed[2]))
    if not rows:
        raise ValueError(f"{path} holds no cases")
    return spark.createDataFrame(rows, CASE)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """place, query of a query pack ({queries: [...]}), or the questions of an evaluation set."""
    data = _document(path)
    asked = [str(q) for q in data.get("queries") or ()] or [str(c["question"]) for c in data.get("cases") or () if c.get("question")]
    if not asked:
        raise ValueError(f"{path} holds no queries")
    return spark.createDataFrame(list(enumerate(asked)), "place int, query string")


def measured(spark: SparkSession, stages: dict[str, Callable[[DataFrame], DataFrame]], queries: DataFrame, repeats: int = 3, warmup: int = 1) -> DataFrame:
    """repeat, stages (milliseconds), total_ms of running the stages over a pack, each on the result of the one before; warm-up runs are not reported, and a stage without rows to work on is not timed."""
    rows = []
    for repeat in range(-warmup, max(1, repeats)):
        took, now = {}, queries
        for name, stage in stages.items():
            began = time.perf_counter()
            now = stage(now)
            now.write.format("noop").mode("overwrite").save()
            took[name] = (time.perf_counter() - began) * 1000
            if now.isEmpty():
                break
        if repeat >= 0:
            rows.append((repeat, took, sum(took.values())))
    return spark.createDataFrame(rows, "repeat int, stages map<string, double>, total_ms double")


def embed_throughput(spark: SparkSession, embedder, sample: str, batch: int = 32, repeats: int = 3, warmup: int = 1) -> DataFrame:
    """model, batch, batch_ms (median), ms_per_chunk, chunks_per_sec of embedding one text again and again in one task."""
    rows = embedder.passages(spark.range(batch, numPartitions=1).select(F.lit(sample).alias("text")))
    times = []
    for k in range(-warmup, max(1, repeats)):
        began = time.perf_counter()
        rows.write.format("noop").mode("overwrite").save()
        if k >= 0:
            times.append((embedder.model, batch, (time.perf_counter() - began) * 1000))
    timed = percentiles(spark.createDataFrame(times, "model string, batch int, ms double"), "ms", ["model", "batch"])
    return timed.select("model", "batch", F.col("p50").alias("batch_ms"), F.round(F.col("p50") / F.col("batch"), 4).alias("ms_per_chunk"), F.round(F.col("batch") / (F.col("p50") / 1000), 1).alias("chunks_per_sec"))


def agent_summary(timings: DataFrame) -> DataFrame:
    """One row over answers (first_token_ms, answer_ms, rounds, tool_calls, prompt_tokens, completion_tokens, cached_tokens): medians, means, totals and the share of prompt tokens that were cached (null without any)."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    prompt, cached = F.sum("prompt_tokens"), F.sum("cached_tokens")
    return timings.agg(
        F.count("*").alias("answers"),
        F.median("answer_ms").alias("answer_ms_p50"),
        F.median("first_token_ms").alias("first_token_ms_p50"),
        F.count("first_token_ms").alias("streamed"),
        F.round(F.avg("rounds"), 2).alias("rounds_per_answer"),
        F.round(F.avg("tool_calls"), 2).alias("tool_calls_per_answer"),
        F.median(tokens).alias("tokens_p50"),
        prompt.alias("prompt_tokens_total"),
        F.sum("completion_tokens").alias("completion_tokens_total"),
        cached.alias("cached_tokens_total"),
        F.round(F.when(prompt > 0, cached / prompt), 3).alias("cache_hit_rate"),
    )
