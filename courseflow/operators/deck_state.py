"""What a deck's signal needs of its runs, as rows that add up.

The state of two sets of runs is that of each, combined: counts are added, first places and best runs compared. So new runs
are counted without reading the earlier ones. A deck has as many rows as it has different tags, slides and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from courseflow.functions import text as fx
from courseflow.operators import signals

STATE = "deck_id string, kind string, name string, part string, n bigint, first_seen struct<run_seq: bigint, list_pos: int, pos: int>, best struct<score: int, earlier: bigint, run_id: string>"
KEY = ("deck_id", "kind", "name", "part")
TAGS = (("confusion", "confusion_tags"), ("prerequisite", "missed_prerequisites"), ("misconception", "misconception_flags"))


def schema() -> T.StructType:
    return T.StructType.fromDDL(STATE)


def state(runs: DataFrame) -> DataFrame:
    """One pass over answered runs. ``kind`` and ``part`` are a kind of tag and the run's profile; ``slide`` (counted as
    cited, or else the run's own), ``cited_for`` an issue type and ``cited_by`` a profile (slides of the evidence alone);
    ``profile`` with its best run."""
    seen = lambda place, pos: F.struct(F.col("run_seq").alias("run_seq"), F.lit(place).alias("list_pos"), pos.cast("int").alias("pos"))
    no_run = F.lit(None).cast(schema()["best"].dataType)
    fact = lambda kind, name, part, first, best=no_run: F.struct(F.lit(kind).alias("kind"), name.alias("name"), part.cast("string").alias("part"), first.alias("first_seen"), best.alias("best"))
    profile, nothing = F.col("student_profile"), F.lit("")
    given = lambda condition, facts: F.when(condition, facts).otherwise(F.slice(facts, 1, 0))
    none = F.array().cast("array<string>")
    listed = lambda column: F.coalesce(F.col(f"answer.{column}"), none)

    facts = lambda values, kind, part, place=0: F.transform(values, lambda v, i: fact(kind, v, part, seen(place, i)))
    tags = [facts(listed(c), k, profile, p) for p, (k, c) in enumerate(TAGS)]
    weak = [given(profile == "weak", facts(listed(c), "weak_topic", profile, p)) for p, (_, c) in enumerate(TAGS[:2])]
    slides = facts(fx.or_else(F.col("answer.evidence_slide_refs"), F.col("slide_refs")), "slide", nothing)
    cited = F.array_distinct(listed("evidence_slide_refs"))
    cited_for = [given(F.size(listed(c)) > 0, facts(cited, "cited_for", F.lit(k))) for k, c in TAGS]
    cited_by = facts(cited, "cited_by", profile)
    best = F.struct(signals.evidence_score().cast("int").alias("score"), (-F.col("run_seq")).alias("earlier"), F.col("run_id").alias("run_id"))
    own = F.array(fact("profile", profile, nothing, seen(0, F.lit(0)), best))
    each = signals.answered(runs).select("deck_id", F.explode(F.concat(*tags, *weak, F.coalesce(slides, F.slice(own, 1, 0)), *cited_for, cited_by, own)).alias("f"))
    return _combined(each.select("deck_id", "f.*", F.lit(1).cast("bigint").alias("n")))


def _combined(rows: DataFrame) -> DataFrame:
    found = rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("best").alias("best"))
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema()])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of the runs of both."""
    return _combined(old.unionByName(new))


def tag_counts(found: DataFrame) -> DataFrame:
    """``signals.tag_counts`` of the runs that the state has seen."""
    tags = found.where(F.col("kind").isin(*[k for k, _ in TAGS], "weak_topic"))
    return tags.groupBy("deck_id", "kind", F.col("name").alias("tag")).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def _of(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("kind") == kind)


def slide_ranks(found: DataFrame, slides: DataFrame) -> DataFrame:
    """``signals.slide_issue_counts`` of the runs that the state has seen."""
    return signals.ranked_slides(_of(found, "slide").select("deck_id", F.col("name").alias("slide_id"), "n", F.struct("first_seen.run_seq", "first_seen.pos").alias("first_seen")), slides)


def slide_evidence(found: DataFrame) -> DataFrame:
    """``signals.slide_evidence`` of the runs that the state has seen."""
    cited = _of(found, "cited_by").select("deck_id", F.col("name").alias("slide_id"), F.col("part").alias("student_profile"))
    first = _of(found, "profile").select("deck_id", F.col("name").alias("student_profile"), F.col("first_seen.run_seq").alias("profile_seq"))
    profiles = cited.join(first, ["deck_id", "student_profile"]).groupBy("deck_id", "slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("profile_seq", "student_profile"))), lambda x: x["student_profile"]).alias("affected_profiles"))
    types = _of(found, "cited_for").groupBy("deck_id", F.col("name").alias("slide_id")).agg(F.array_sort(F.collect_set("part")).alias("issue_types"))
    return profiles.join(types, ["deck_id", "slide_id"], "left")


def cohort_signal(found: DataFrame, slides: DataFrame) -> DataFrame:
    """``signals.cohort_signal`` of the runs that the state has seen. ``found`` is read several times; it should be a table."""
    profiles = _of(found, "profile")
    position = F.row_number().over(W.partitionBy("deck_id").orderBy("first_seen"))
    best = profiles.select("deck_id", F.col("best.run_id").alias("run_id"), position.alias("position"))
    counted = profiles.groupBy("deck_id").agg(F.sum("n").alias("n_runs"))
    targets = signals.targets_of(slide_ranks(found, slides), slide_evidence(found))
    return signals.assembled(counted, signals.top_labels(tag_counts(found)), targets, best)


def signal_fields(found: DataFrame, slides: DataFrame) -> DataFrame:
    """(deck_id, field, profile, position, label, n): the counted fields of a signal in full, as flat rows. Counts of
    tags of all runs and of each profile, and slides with issues, the most frequent first, ties by first appearance;
    ``profile`` is empty for all runs."""
    tags = found.where(F.col("kind").isin(*[k for k, _ in TAGS]))
    named = lambda df, field, profile: df.select("deck_id", field.alias("field"), profile.alias("profile"), F.col("tag").alias("label"), "n", "first_seen")
    whole = named(tag_counts(found), F.when(F.col("kind") == "weak_topic", "weak_topic_counts").otherwise(F.concat("kind", F.lit("_tag_counts"))), F.lit(""))
    split = named(tags.withColumnRenamed("name", "tag"), F.concat("kind", F.lit("_by_profile")), F.col("part"))
    order = W.partitionBy("deck_id", "field", "profile").orderBy(F.desc("n"), "first_seen")
    counts = whole.unionByName(split).withColumn("position", F.row_number().over(order)).drop("first_seen")
    slide = slide_ranks(found, slides).select("deck_id", F.lit("slide_issue_counts").alias("field"), F.lit("").alias("profile"), F.col("slide_id").alias("label"), "n", F.col("rank").alias("position"))
    return counts.unionByName(slide)
