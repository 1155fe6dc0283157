"""Cohort signals from evaluation runs. Every count carries ``first_seen``, the place of its first
occurrence, so that ties break by first insertion whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.functions import text as fx

PROFILES = ("weak", "average", "strong")
TASKS = ("explain_back", "short_qa", "confusion_report", "coverage_check")
#: What is said of a slide to revise.
TARGET_REASON = "Slide %s appears in %d issue-linked run(s)."
TARGET_SUGGESTION = "Clarify %s with prerequisite reminders, tighter definitions, and at least one worked example."
TARGET_LABEL = "[P%d] slide:%s - %s"


def answered(runs: DataFrame) -> DataFrame:
    return runs.where("answer is not null")


def tag_occurrences(runs: DataFrame) -> DataFrame:
    """(deck_id, student_profile, kind, tag, first_seen): every tag of every answered run. Kind
    ``weak_topic`` repeats the weak profile's confusion tags and missed prerequisites."""
    lists = [("confusion", "confusion_tags", 0), ("prerequisite", "missed_prerequisites", 1), ("misconception", "misconception_flags", 2)]
    tagged = lambda kind, column, place: F.transform(f"answer.{column}", lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("tag"), F.struct(F.col("run_seq"), F.lit(place).alias("list_pos"), i.alias("pos")).alias("first_seen")))
    weak = [F.when(F.col("student_profile") == "weak", tagged("weak_topic", c, p)).otherwise(F.slice(tagged("weak_topic", c, p), 1, 0)) for _, c, p in lists[:2]]
    every = F.concat(*[tagged(k, c, p) for k, c, p in lists], *weak)
    return answered(runs).select("deck_id", "student_profile", F.explode(every).alias("t")).select("deck_id", "student_profile", "t.*")


def tag_counts(runs: DataFrame) -> DataFrame:
    """(deck_id, kind, tag, n, first_seen)."""
    return tag_occurrences(runs).groupBy("deck_id", "kind", "tag").agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"))


def tag_counts_by_profile(runs: DataFrame) -> DataFrame:
    rows = tag_occurrences(runs).where("kind <> 'weak_topic'")
    return rows.groupBy("deck_id", "student_profile", "kind", "tag").agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"))


def tag_counts_all_levels(runs: DataFrame) -> DataFrame:
    """Counts of a deck and of each of its profiles in one pass; ``student_profile`` is null for the deck."""
    rows = tag_occurrences(runs).where("kind <> 'weak_topic'")
    sets = rows.groupingSets([[F.col("deck_id"), F.col("kind"), F.col("tag")], [F.col("deck_id"), F.col("student_profile"), F.col("kind"), F.col("tag")]], "deck_id", "student_profile", "kind", "tag")
    return sets.agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"))


def top_labels(counts: DataFrame, limit: int = 5) -> DataFrame:
    """(deck_id, kind, labels): the most common, ``tag (n)``; the empty tag is dropped after the limit."""
    order = W.partitionBy("deck_id", "kind").orderBy(F.desc("n"), "first_seen")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    label = F.when(F.col("tag") != "", F.struct("rank", F.concat("tag", F.lit(" ("), "n", F.lit(")")).alias("label")))
    return best.groupBy("deck_id", "kind").agg(F.transform(F.array_sort(F.collect_list(label)), lambda x: x["label"]).alias("labels"))


def cited_slides(runs: DataFrame) -> DataFrame:
    """Slides of each run for counting: those of the evidence, or else the run's own."""
    refs = fx.or_else(F.col("answer.evidence_slide_refs"), F.col("slide_refs"))
    return answered(runs).select("deck_id", "run_seq", F.posexplode(refs).alias("pos", "slide_id"))


def slide_issue_counts(runs: DataFrame, slides: DataFrame) -> DataFrame:
    """(deck_id, slide_id, slide_title, n, rank)."""
    return ranked_slides(cited_slides(runs).groupBy("deck_id", "slide_id").agg(F.count("*").alias("n"), F.min(F.struct("run_seq", "pos")).alias("first_seen")), slides)


def ranked_slides(counts: DataFrame, slides: DataFrame) -> DataFrame:
    """Counts of slides (deck_id, slide_id, n, first_seen) with their titles and ranks."""
    titles = slides.groupBy("deck_id", "slide_id").agg(F.max_by("title", "slide_pos").alias("title"))
    order = W.partitionBy("deck_id").orderBy(F.desc("n"), "first_seen")
    return counts.join(titles, ["deck_id", "slide_id"], "left").select("deck_id", "slide_id", F.coalesce("title", "slide_id").alias("slide_title"), "n", F.row_number().over(order).alias("rank"))


def slide_evidence(runs: DataFrame) -> DataFrame:
    """(deck_id, slide_id, issue_types, affected_profiles) over the runs whose evidence cites the slide."""
    rows = answered(runs).select("deck_id", "student_profile", "run_seq", "answer", F.explode(F.array_distinct("answer.evidence_slide_refs")).alias("slide_id"))
    types = F.array_sort(F.array_compact(F.array(*[F.when(F.bool_or(F.size(f"answer.{c}") > 0), k) for k, c in (("confusion", "confusion_tags"), ("misconception", "misconception_flags"), ("prerequisite", "missed_prerequisites"))])))
    # Profiles come in the order in which the deck's runs first show them.
    first = answered(runs).groupBy("deck_id", "student_profile").agg(F.min("run_seq").alias("profile_seq"))
    per = rows.groupBy("deck_id", "slide_id").agg(types.alias("issue_types"))
    profiles = rows.select("deck_id", "slide_id", "student_profile").distinct().join(first, ["deck_id", "student_profile"])
    listed = profiles.groupBy("deck_id", "slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("profile_seq", "student_profile"))), lambda x: x["student_profile"]).alias("affected_profiles"))
    return per.join(listed, ["deck_id", "slide_id"])


def revision_targets(runs: DataFrame, slides: DataFrame, limit: int = 5) -> DataFrame:
    return targets_of(slide_issue_counts(runs, slides), slide_evidence(runs), limit)


def targets_of(ranked: DataFrame, evidence: DataFrame, limit: int = 5) -> DataFrame:
    none = F.array().cast("array<string>")
    top = ranked.where(F.col("rank") <= limit).join(evidence, ["deck_id", "slide_id"], "left")
    reason = F.format_string(TARGET_REASON, "slide_title", "n")
    return top.select("deck_id", "slide_id", "rank", F.col("n").alias("priority"), F.coalesce("issue_types", none).alias("issue_types"), F.coalesce("affected_profiles", none).alias("affected_profiles"), reason.alias("reason"), F.format_string(TARGET_SUGGESTION, "slide_title").alias("suggestion"), F.format_string(TARGET_LABEL, "n", "slide_id", reason).alias("label"))


def evidence_score() -> Column:
    a = "answer."
    tags = F.size(a + "confusion_tags") + F.size(a + "missed_prerequisites") + F.size(a + "misconception_flags")
    return 100 * tags + F.length(fx.truncate_answer(F.col(a + "main_answer"))) + 20 * F.size(a + "evidence_slide_refs")


def representative_evidence(runs: DataFrame) -> DataFrame:
    """The run of best score for each deck and profile, the earliest of equals; aggregated map-side."""
    rows = answered(runs).withColumn("score", evidence_score())
    best = F.max_by(F.struct("run_id", "run_seq", "task_type", "answer", "score"), F.struct("score", -F.col("run_seq")))
    per = rows.groupBy("deck_id", "student_profile").agg(best.alias("b"), F.min("run_seq").alias("first_seq"))
    order = W.partitionBy("deck_id").orderBy("first_seq")
    return per.select("deck_id", "student_profile", "b.run_id", "b.task_type", "b.score", fx.truncate_answer(F.col("b.answer.main_answer")).alias("main_answer"), F.col("b.answer.evidence_slide_refs").alias("evidence_slide_refs"), F.row_number().over(order).alias("position"))


def evidence_refs(runs: DataFrame) -> DataFrame:
    """(deck_id, run_seq, pos, run_id, slide_refs, …): a run's references, or one made from its answer."""
    made = F.array(F.struct("run_id", fx.or_else(F.col("answer.evidence_slide_refs"), F.col("slide_refs")).alias("slide_refs"), "task_type", "student_profile"))
    return answered(runs).select("deck_id", "run_seq", F.posexplode(fx.or_else(F.col("evidence_refs"), made)).alias("pos", "ref")).select("deck_id", "run_seq", "pos", "ref.*")


def cohort_signal(runs: DataFrame, slides: DataFrame) -> DataFrame:
    """One row a deck: top labels of every kind, revision target labels, the runs that represent its profiles, and the
    number of answered runs. The evidence itself, of every run, is ``evidence_refs`` in flat rows."""
    counted = answered(runs).groupBy("deck_id").agg(F.count("*").alias("n_runs"))
    return assembled(counted, top_labels(tag_counts(runs)), revision_targets(runs, slides), representative_evidence(runs))


def assembled(counted: DataFrame, tops: DataFrame, targets: DataFrame, representative: DataFrame) -> DataFrame:
    labels = tops.groupBy("deck_id").pivot("kind", ["weak_topic", "confusion", "misconception", "prerequisite"]).agg(F.first("labels"))
    targets = targets.groupBy("deck_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("recommended_revision_targets"))
    best = representative.groupBy("deck_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "run_id"))), lambda x: x["run_id"]).alias("representative_run_ids"))
    none = F.array().cast("array<string>")
    joined = counted.join(labels, "deck_id", "left").join(targets, "deck_id", "left").join(best, "deck_id", "left")
    named = {"weak_topic": "weak_topics", "confusion": "repeated_confusion_points", "misconception": "misconception_clusters", "prerequisite": "missing_prerequisite_patterns"}
    lists = {**named, "recommended_revision_targets": "recommended_revision_targets", "representative_run_ids": "representative_run_ids"}
    return joined.select("deck_id", F.concat(F.lit("signal_"), "deck_id").alias("signal_id"), *[F.coalesce(k, none).alias(v) for k, v in lists.items()], "n_runs")


def deck_slides(slides: DataFrame) -> DataFrame:
    """(deck_id, slide_refs): the slides of each deck in order."""
    return slides.groupBy("deck_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slide_pos", "slide_id"))), lambda x: x["slide_id"]).alias("slide_refs"))


def evaluation_grid(slides: DataFrame, profiles: tuple[str, ...] = PROFILES, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Slide by profile by task, coverage checks for the strong profile only; 12 rows a slide at most."""
    grid = slides.withColumn("student_profile", F.explode(F.array(*[F.lit(p) for p in profiles]))).withColumn("task_type", F.explode(F.array(*[F.lit(t) for t in tasks])))
    return grid.where("task_type <> 'coverage_check' or student_profile = 'strong'")


def select_requested(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested names (request_id, names) that exist, in request order, repeats kept."""
    each = requested.select("request_id", F.posexplode("names").alias("pos", key))
    return each.join(known, key).select("request_id", "pos", key)


def structured_slides(lines: DataFrame) -> DataFrame:
    """Slides from (deck_id, slide_id, lines): title, key points, terms, examples, raw text."""
    body = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    example = F.filter(body, lambda x: F.lower(x).contains("example") | F.lower(x).contains("e.g."))
    return lines.select("deck_id", "slide_id", F.coalesce(F.get("lines", F.lit(0)), F.concat(F.lit("Slide "), "slide_id")).alias("title"), F.slice(body, 1, 5).alias("key_points"), fx.extract_terms(F.col("lines")).alias("terms"), F.slice(example, 1, 3).alias("examples"), F.array_join("lines", "\n").alias("raw_text"))


def rule_tags(grid: DataFrame) -> DataFrame:
    """The rule-based tags of each grid row of structured slides."""
    blob = F.lower(F.concat_ws(" ", "title", F.array_join("key_points", " "), F.array_join("terms", " "), F.array_join("examples", " "), "raw_text"))
    weak, average, strong = (F.col("student_profile") == p for p in PROFILES)
    task = F.col("task_type")
    tags = lambda *pairs: F.array_distinct(F.filter(F.array_compact(F.array(*[F.when(c, v) for c, v in pairs])), lambda t: t != ""))
    confusion = tags((blob.contains("supervised"), F.lit("label_usage")), (blob.contains("pattern"), F.lit("pattern_definition")), ((task == "confusion_report") & ~blob.contains("example"), F.lit("needs_worked_example")), (weak, F.lit("terminology_overload")), (average, F.lit("pace_jump")))
    missed = tags((blob.contains("model") | blob.contains("algorithm"), F.lit("basic_statistics")), (weak, F.get("terms", F.lit(0))))
    wrong = tags((task == "coverage_check", F.lit("missing_boundary_conditions")), (strong, F.lit("oversimplified_explanation")), (strong & (F.size("examples") == 0), F.lit("missing_counterexample")))
    return grid.select("deck_id", "slide_id", "student_profile", "task_type", confusion.alias("confusion_tags"), missed.alias("missed_prerequisites"), wrong.alias("misconception_flags"))


def flatten_runs(runs: DataFrame) -> DataFrame:
    """Answer fields on the run row, with one reference to its evidence; a run that failed or has no answer says so."""
    evidence = fx.or_else(F.col("answer.evidence_slide_refs"), F.col("slide_refs"))
    ref = F.struct("run_id", evidence.alias("slide_refs"), "task_type", "student_profile")
    message = F.when(F.col("status") == "failed", F.coalesce("answer.main_answer", F.lit("Run failed."))).when(F.col("answer").isNull(), "No answer yet.")
    return runs.select("run_id", "run_seq", "deck_id", "status", F.col("answer.main_answer").alias("answer_text"), "answer.confusion_tags", "answer.missed_prerequisites", "answer.misconception_flags", evidence.alias("evidence_slides"), F.array(ref).alias("evidence_refs"), message.alias("error_message"))


def job_status(runs: DataFrame, job: str = "deck_id") -> DataFrame:
    """A job is complete when each of its runs is completed or failed."""
    return runs.groupBy(job).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_and(F.col("status").isin("completed", "failed")).alias("complete"))


def job_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of each job (job_id, run_ids), in the order of its ids; unknown ids are skipped."""
    return jobs.select("job_id", F.posexplode("run_ids").alias("pos", "run_id")).join(runs, "run_id")


def tag_shares(counts: DataFrame) -> DataFrame:
    """Bar lengths: the count in percent of the deck's largest of that kind."""
    most = F.max("n").over(W.partitionBy("deck_id", "kind"))
    return counts.select("deck_id", "kind", "tag", "n", (F.col("n") * 100.0 / F.greatest(most, F.lit(1))).alias("bar"), F.least(F.lit(1.0), 0.25 + 0.18 * F.col("n")).alias("heat"))
