"""Queries over append-only tables: model outputs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioquarry.sources.tables import table

BUDGET = 20_000  # tokens of a budget window


def delivered_once(candidates: DataFrame) -> DataFrame:
    """Rows delivered more than once (same id) count once."""
    return candidates.dropDuplicates(["id"])


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return delivered_once(table(spark, folder, "candidates"))


def a1_job_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs, segments, tokens and cost of each job; missing counts are 0."""
    return _candidates(spark, folder).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("outputs"), F.count_distinct("segment_id").alias("segments"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"))


def a13_usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Usage by provider, model and stage with all subtotals."""
    return _candidates(spark, folder).rollup("provider", "model", "stage").agg(F.count(F.lit(1)).alias("outputs"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.grouping_id().cast("bigint").alias("level"))


def a2_repaired_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).where("stage = 'repair'").groupBy("job_id").agg(F.count_distinct("segment_id").alias("segments"))


def a3_json_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Conditional counts on a path of the events' JSON."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(k >= 50).alias("large"), F.count_if(k.isNull()).alias("without"), F.sum(k).alias("total_k"))


def a20_latest_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """The latest output of each model for each segment."""
    first = F.row_number().over(Window.partitionBy("segment_id", "provider", "model").orderBy(F.desc("created_at"), F.desc("id")))
    return _candidates(spark, folder).withColumn("n", first).where("n = 1").select("segment_id", "provider", "model", F.col("id").alias("candidate_id"))


def t2_latest_output(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).groupBy("segment_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("candidate_id"), F.count(F.lit(1)).alias("outputs"))


def u6_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The term base after its own aliases are upserted as terms: the latest row of (project, source) wins."""
    t = table(spark, folder, "terms", "id", "project_id", "source", "target", "aliases", "created_at")
    both = t.select("id", "project_id", "source", "target", "created_at").unionByName(t.select(F.concat("id", F.lit("+")).alias("id"), "project_id", F.explode("aliases").alias("source"), "target", (F.col("created_at") + F.expr("INTERVAL 1 SECOND")).alias("created_at")))
    return both.groupBy("project_id", "source").agg(F.max_by("target", F.struct("created_at", "id")).alias("target"), F.max_by("id", F.struct("created_at", "id")).alias("id"))


def z4_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of each job up to the one that uses up the token budget."""
    order = Window.partitionBy("job_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).over(order), F.lit(0))
    return _candidates(spark, folder).withColumn("used", used).where(F.col("used") < BUDGET).groupBy("job_id").agg(F.count(F.lit(1)).alias("within"), F.max("used").alias("used_before_last"))


def w14_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """How far each book is translated without a gap: the last ordinal before the first open segment."""
    s = table(spark, folder, "segments", "document_id", "ordinal", "status")
    first_open = s.groupBy("document_id").agg(F.min(F.when(F.col("status") == "source", F.col("ordinal"))).alias("open"))
    return s.join(first_open, "document_id").where("open IS NULL OR ordinal < open").groupBy("document_id").agg(F.max("ordinal").cast("bigint").alias("checkpoint"), F.count(F.lit(1)).alias("segments"))


def u2_missing_extra(spark: SparkSession, folder: str) -> DataFrame:
    """Per job the segments that a draft lacks though repaired, and those drafted but never repaired."""
    per = _candidates(spark, folder).groupBy("job_id").agg(F.collect_set(F.when(F.col("stage") == "draft", F.col("segment_id"))).alias("d"), F.collect_set(F.when(F.col("stage") == "repair", F.col("segment_id"))).alias("r"))
    return per.select("job_id", F.size(F.array_except("r", "d")).cast("bigint").alias("missing"), F.size(F.array_except("d", "r")).cast("bigint").alias("extra"))


def z11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """One fingerprint of each job's inputs, by which a run that was done before is told."""
    per = _candidates(spark, folder).groupBy("job_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("segment_id")), ","), 256).alias("fingerprint"))
    return per.groupBy("fingerprint").agg(F.min("job_id").alias("first_job"), F.count(F.lit(1)).alias("jobs"))


QUERIES = {f.__name__: f for f in (a1_job_usage, a13_usage_rollup, a2_repaired_segments, a3_json_counts, a20_latest_by_model, t2_latest_output, u6_upsert, z4_budget, w14_checkpoint, u2_missing_extra, z11_fingerprints)}
_C = "c AS (SELECT DISTINCT * FROM candidates)"
ORACLE = {
    "a1_job_usage": f"WITH {_C} SELECT job_id, count(*) AS outputs, count(DISTINCT segment_id) AS segments, CAST(sum(coalesce(prompt_tokens,0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens,0)) AS BIGINT) AS completion_tokens, round(sum(coalesce(cost_usd,0)), 6) AS cost_usd FROM c GROUP BY job_id",
    "a13_usage_rollup": f"WITH {_C} SELECT provider, model, stage, count(*) AS outputs, CAST(sum(coalesce(prompt_tokens,0)) AS BIGINT) AS prompt_tokens, CAST(grouping(provider, model, stage) AS BIGINT) AS level FROM c GROUP BY ROLLUP (provider, model, stage)",
    "a2_repaired_segments": f"WITH {_C} SELECT job_id, count(DISTINCT segment_id) AS segments FROM c WHERE stage = 'repair' GROUP BY job_id",
    "a3_json_counts": "SELECT event_type, count(*) AS events, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS large, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS without, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type",
    "a20_latest_by_model": f"WITH {_C} SELECT segment_id, provider, model, arg_max(id, (created_at, id)) AS candidate_id FROM c GROUP BY ALL",
    "t2_latest_output": f"WITH {_C} SELECT segment_id, arg_max(id, (created_at, id)) AS candidate_id, count(*) AS outputs FROM c GROUP BY segment_id",
    "u6_upsert": "WITH b AS (SELECT id, project_id, source, target, created_at FROM terms UNION ALL SELECT id || '+', project_id, unnest(aliases), target, created_at + INTERVAL 1 SECOND FROM terms) SELECT project_id, source, arg_max(target, (created_at, id)) AS target, arg_max(id, (created_at, id)) AS id FROM b GROUP BY project_id, source",
    "z4_budget": f"WITH {_C}, u AS (SELECT *, coalesce(sum(coalesce(prompt_tokens,0) + coalesce(completion_tokens,0)) OVER (PARTITION BY job_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c) SELECT job_id, count(*) AS within, CAST(max(used) AS BIGINT) AS used_before_last FROM u WHERE used < {BUDGET} GROUP BY job_id",
    "w14_checkpoint": "WITH o AS (SELECT document_id, min(ordinal) FILTER (status = 'source') AS open FROM segments GROUP BY 1) SELECT document_id, CAST(max(ordinal) AS BIGINT) AS checkpoint, count(*) AS segments FROM segments JOIN o USING (document_id) WHERE open IS NULL OR ordinal < open GROUP BY document_id",
    "u2_missing_extra": f"""WITH {_C}, d AS (SELECT DISTINCT job_id, segment_id FROM c WHERE stage = 'draft'), r AS (SELECT DISTINCT job_id, segment_id FROM c WHERE stage = 'repair')
        SELECT job_id, (SELECT count(*) FROM r WHERE r.job_id = j.job_id AND (job_id, segment_id) NOT IN (SELECT * FROM d)) AS missing, (SELECT count(*) FROM d WHERE d.job_id = j.job_id AND (job_id, segment_id) NOT IN (SELECT * FROM r)) AS extra FROM (SELECT DISTINCT job_id FROM c) j""",
    "z11_fingerprints": f"WITH {_C} SELECT fingerprint, min(job_id) AS first_job, count(*) AS jobs FROM (SELECT job_id, sha256(string_agg(segment_id, ',' ORDER BY segment_id)) AS fingerprint FROM (SELECT DISTINCT job_id, segment_id FROM c) GROUP BY job_id) GROUP BY fingerprint",
}
