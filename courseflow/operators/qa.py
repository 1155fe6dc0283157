"""Before/after question benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseflow.functions import text as fx


def pass_results(answers: DataFrame) -> DataFrame:
    """(benchmark_id, stage, correct_count, total, accuracy)."""
    per = answers.groupBy("benchmark_id", "stage").agg(F.count_if("is_correct").alias("correct_count"), F.count("*").alias("total"))
    return per.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct_count") / F.col("total")).otherwise(0.0))


def improvement(answers: DataFrame) -> DataFrame:
    """Both passes side by side and the gain in correct answers; a missing pass counts as zero."""
    at = lambda stage: F.count_if((F.col("stage") == stage) & F.col("is_correct"))
    return answers.groupBy("benchmark_id").agg(at("before").alias("before_correct"), at("after").alias("after_correct")).withColumn("delta", F.col("after_correct") - F.col("before_correct"))


def handoff(answers: DataFrame) -> DataFrame:
    """Per benchmark, the questions still wrong in the after pass."""
    wrong = (F.col("stage") == "after") & ~F.col("is_correct")
    item = F.when(wrong, F.col("question_id"))
    return answers.groupBy("benchmark_id").agg(F.count_if(wrong).alias("unresolved_count"), F.array_sort(F.collect_list(item)).alias("items"))


#: What is said of a question that stays wrong.
ISSUE_TYPES = ["incorrect_after_support", "content_revision_candidate"]
REASON = "Student still answered incorrectly after QA support in the after pass."
SUGGESTION = "Revise the related slide content to address the missed concepts, then regenerate or update the question support materials."
FAILURE = "Student still answered incorrectly after QA support."
FOLLOW_UP = "Update the slide explanation, add a clearer worked example, and tighten terminology around the missed concepts."


def handoff_items(answers: DataFrame) -> DataFrame:
    """One row for each question still wrong in the after pass, with what a reviser needs."""
    wrong = answers.where("stage = 'after' and not is_correct")
    return wrong.select("benchmark_id", F.lit("high").alias("priority"), F.col("question_id").alias("target_ref"), F.array(*[F.lit(x) for x in ISSUE_TYPES]).alias("issue_types"), F.array("student_profile").alias("affected_profiles"), F.lit(REASON).alias("reason"), F.lit(SUGGESTION).alias("suggestion"), "question_id", "prompt", "student_answer", "correct_answer", F.lit(FAILURE).alias("failure_reason"), "missed_concepts", F.lit(FOLLOW_UP).alias("recommended_followup"), F.col("evidence_slide_refs").alias("slide_refs"))


def normalized_answers(raw: DataFrame) -> DataFrame:
    """Answers with confidence in 0..1, text, missed concepts and slides filled in by the rules."""
    concepts = F.when(F.col("is_correct"), F.array().cast("array<string>")).otherwise(fx.or_else(F.col("missed_concepts"), fx.or_else(F.col("concept_tags"), F.array(F.lit("concept_gap")))))
    return raw.withColumns({"confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5)))), "student_answer": F.when(fx.is_given(fx.trim_ws(F.col("student_answer"))), fx.trim_ws(F.col("student_answer"))).otherwise("No answer returned."), "missed_concepts": concepts, "evidence_slide_refs": fx.or_else(F.col("evidence_slide_refs"), fx.or_else(F.col("slide_refs"), F.array("first_slide")))})
