"""Issues, recommendations and proposals from cohort signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.functions import text as fx

#: First action of each issue type, weight of each action.
FIRST_ACTION = {"missing_prerequisite": "add_prerequisite_slide", "misconception": "add_misconception_warning", "confusion": "add_example", "concept_confusion": "rewrite_explanation", "weak_mathematical_foundation": "add_prerequisite_slide", "expression_unclear": "rewrite_explanation", "pacing_mismatch": "split_dense_slide", "theory_practice_gap": "add_example"}
ACTION_WEIGHT = {"add_prerequisite_slide": 95, "rewrite_explanation": 90, "add_misconception_warning": 85, "add_example": 80, "split_dense_slide": 70, "regenerate_deck_section": 65, "mark_for_kb_review": 60}
LISTS = [("weak_topic", "weak_topics", None), ("confusion", "repeated_confusion_points", 75), ("misconception", "misconception_clusters", 80), ("missing_prerequisite", "missing_prerequisite_patterns", 88)]
#: What is said of an issue of each kind, and of a whole section.
RATIONALE = {"weak_topic": "Topic '%s' appears in weak_topics and is repeatedly problematic.", "confusion": "Students repeatedly confused about: %s", "misconception": "Recurring misconception: %s", "missing_prerequisite": "Missing prerequisite knowledge: %s"}
SECTION_RATIONALE = "Multiple issue types across same section."
#: What a signal may bring along: the evidence list of a stored one, or the runs that represent its profiles.
CARRIED = ("evidence_refs", "representative_run_ids")


def _carried(df: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in df.columns]


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def _related(topic: Column, items: str) -> Column:
    return F.exists(items, lambda i: F.lower(i).contains(F.lower(topic)))


def _topic_of(text: Column) -> Column:
    hits = F.filter("weak_topics", lambda t: F.lower(text).contains(F.lower(t)))
    return F.coalesce(F.get(hits, F.lit(0)), F.get("weak_topics", F.lit(0)), F.lit("unknown"))


def issues(signals: DataFrame, decks: DataFrame | None = None) -> DataFrame:
    """(deck_id, issue_type, topic, issue_text, score, severity, rank, …): the four lists of each signal, exploded in one
    pass, by score, ties in list order. Every issue carries all slides of its deck (``decks``: deck_id, slide_refs)
    and what the signal brings along of ``CARRIED``; all evidence of its deck is in ``evidence_of``."""
    none = F.array().cast("array<string>")
    of = lambda seq, kind, column: F.transform(column, lambda t, i: F.struct(F.lit(kind).alias("issue_type"), F.lit(column).alias("source_field"), F.lit(seq).alias("kind_seq"), i.alias("pos"), t.alias("issue_text")))
    tagged = [of(seq, kind, column) for seq, (kind, column, _) in enumerate(LISTS)]
    with_slides = signals if decks is None else signals.join(decks.select("deck_id", "slide_refs"), "deck_id", "left")
    slides = F.coalesce("slide_refs", none) if "slide_refs" in with_slides.columns else none
    e = with_slides.select("*", F.explode(F.concat(*tagged)).alias("i"))
    text, kind = F.col("i.issue_text"), F.col("i.issue_type")
    score = 60 + F.when(_related(text, "repeated_confusion_points"), 10).otherwise(0) + F.when(_related(text, "misconception_clusters"), 10).otherwise(0) + F.when(F.size("missing_prerequisite_patterns") > 0, 5).otherwise(0)
    said = F.lit(None).cast("string")
    for name, _, fixed in LISTS:
        score = F.when(kind == name, fixed).otherwise(score) if fixed else score
        said = F.when(kind == name, F.format_string(RATIONALE[name], text)).otherwise(said)
    rows = e.select("deck_id", "i.*", F.when(kind == "weak_topic", text).otherwise(_topic_of(text)).alias("topic"), score.cast("int").alias("score"), F.slice("recommended_revision_targets", 1, 3).alias("targets"), slides.alias("slide_refs"), *[F.coalesce(c, none).alias(c) for c in _carried(signals)], said.alias("rationale"))
    rank = F.row_number().over(W.partitionBy("deck_id").orderBy(F.desc("score"), "kind_seq", "pos"))
    return rows.select("*", fx.severity(F.col("score")).alias("severity"), rank.alias("rank"), _issue_id(rank).alias("issue_id"))


def _issue_id(rank: Column) -> Column:
    return F.format_string("ISS_%03d", rank)


def recommendations(found: DataFrame) -> DataFrame:
    """The best recommendation of each action, first of equals; order by score, ties by the action's
    first appearance. A deck of four issues or more also gets one for its whole section, last in line; the
    deck's fourth issue brings it along, so the issues are read once."""
    action = _lookup(FIRST_ACTION, F.col("issue_type"), "mark_for_kb_review")
    none = F.array().cast("array<string>")
    score = F.least(F.lit(100), F.col("score") + F.floor(_lookup(ACTION_WEIGHT, action, 50) / 10)).cast("int")

    def row(action, score, seq, priority, slides, targets, ids, rationale):
        return F.struct(action.alias("action"), score.alias("score"), seq.alias("seq"), priority.alias("priority"), slides.alias("target_slide_refs"), targets.alias("target_knowledge_ids"), ids.alias("source_issue_ids"), rationale.alias("rationale"), *_carried(found))

    own = row(action, score, F.col("rank"), fx.priority(score), F.col("slide_refs"), F.col("targets"), F.array("issue_id"), F.col("rationale"))
    section = row(F.lit("regenerate_deck_section"), F.lit(68), F.lit(2**31 - 1), F.lit("medium"), F.col("targets"), none, F.array(*[_issue_id(F.lit(i)) for i in (1, 2, 3)]), F.lit(SECTION_RATIONALE))
    every = found.select("deck_id", F.explode(F.array_compact(F.array(own, F.when(F.col("rank") == 4, section)))).alias("r"))
    best = every.groupBy("deck_id", "r.action").agg(F.max_by("r", F.struct("r.score", -F.col("r.seq"))).alias("b"), F.min("r.seq").alias("first_seq"))
    fields = ("score", "priority", "target_slide_refs", "target_knowledge_ids", "source_issue_ids", "rationale", *_carried(found))
    flat = best.select("deck_id", "action", *[f"b.{c}" for c in fields], "first_seq")
    return flat.withColumn("rank", F.row_number().over(W.partitionBy("deck_id").orderBy(F.desc("score"), "first_seq")))


def proposals(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("priority").isin("high", "critical")).select("deck_id", F.col("action").alias("recommended_action"), F.col("priority").alias("suggested_priority"), "score", F.col("source_issue_ids").alias("based_on_issue_ids"), "target_knowledge_ids", "rationale", *_carried(recs))


def evidence_of(rows: DataFrame, key: str, refs: DataFrame, salts: int = 16) -> DataFrame:
    """(deck_id, ``key``, run_id, pos, slide_refs, task_type, student_profile): issues, recommendations or proposals of a deck,
    each with every evidence reference of the deck's runs (``signals.evidence_refs``). A deck has few rows of ``key`` (20
    issues at most) and may have a third of all runs, so its runs are dealt over ``salts`` parts and its keys sent to each."""
    few = rows.groupBy("deck_id").agg(F.array_sort(F.collect_set(key)).alias("_keys")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = refs.withColumn("_salt", F.pmod(F.xxhash64("run_seq", "pos"), F.lit(salts)).cast("int"))
    return dealt.join(few, ["deck_id", "_salt"]).select("deck_id", F.explode("_keys").alias(key), "run_id", "pos", "slide_refs", "task_type", "student_profile")


def issue_clusters(found: DataFrame) -> DataFrame:
    """Topics, slides and issue types (concepts) that two or more issues of a deck share."""
    one = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
    keys = F.concat(F.array(one("T", F.col("topic")), one("C", F.col("issue_type"))), F.transform(F.array_distinct("slide_refs"), lambda s: one("S", s)))
    keyed = found.select("deck_id", "issue_id", F.explode(keys).alias("k")).select("deck_id", "issue_id", "k.*")
    groups = keyed.groupBy("deck_id", "dimension", "value").agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_list("issue_id")).alias("issue_ids")).where("n_issues >= 2")
    number = F.row_number().over(W.partitionBy("deck_id", "dimension").orderBy(F.desc("n_issues"), "value"))
    return groups.withColumn("cluster_id", F.format_string("CLU_%s_%03d", "dimension", number))


def profile_coverage(runs: DataFrame) -> DataFrame:
    """Which profiles raise each confusion tag of a deck, and in how many runs."""
    tags = runs.where("answer is not null").select("deck_id", "student_profile", "run_id", F.explode(F.array_distinct("answer.confusion_tags")).alias("tag"))
    raised = F.array_sort(F.collect_set("student_profile"))
    label = F.when(F.size("profiles") == 3, "all profiles").when((F.size("profiles") == 1) & F.array_contains("profiles", "weak"), "weak only").otherwise(F.array_join(F.reverse("profiles"), " + "))
    return tags.groupBy("deck_id", "tag").agg(raised.alias("profiles"), F.countDistinct("run_id").alias("runs")).withColumn("coverage", label)


def normalized_issues(found: DataFrame) -> DataFrame:
    """One row for each distinct normalized text of a deck's issues: type and topic of the first, slides and evidence
    of all, numbered in the order of their first."""
    keyed = found.withColumn("norm", fx.normalize_topic(F.col("issue_text")))
    per = keyed.groupBy("deck_id", "norm").agg(F.array_sort(F.collect_list(F.struct("kind_seq", "pos", "issue_type", "topic", "issue_text", "slide_refs", *_carried(found)))).alias("all"))
    first = F.get("all", F.lit(0))
    union = lambda name: F.array_distinct(F.flatten(F.transform("all", lambda x: x[name])))
    number = F.row_number().over(W.partitionBy("deck_id").orderBy(first["kind_seq"], first["pos"]))
    return per.select("deck_id", _issue_id(number).alias("issue_id"), "norm", first["issue_type"].alias("issue_type"), first["topic"].alias("topic"), first["issue_text"].alias("description"), union("slide_refs").alias("affected_slides"), F.array_distinct(F.concat(F.array().cast("array<string>"), *[union(c) for c in _carried(found)])).alias("source_evidence"), F.size("all").cast("long").alias("merged"))


def regenerate_hints(recs: DataFrame) -> DataFrame:
    """One hint for each slide and action of the promoted recommendations."""
    each = recs.where("priority in ('high', 'critical')").select("deck_id", "action", F.explode("target_slide_refs").alias("target_slide")).distinct()
    return each.withColumn("hint", F.format_string("Apply %s to %s.", F.replace("action", F.lit("_"), F.lit(" ")), "target_slide"))


def cohort_insight(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per deck: topics by best score, concept clusters with their numbers of issues, missing prerequisites and affected
    slides, each in the order of the ranked issues. A deck has few issues, so they fit one row."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "topic", "score", "severity", "issue_type", "issue_text", "slide_refs")))
    per = found.groupBy("deck_id").agg(rows.alias("all"))
    topics = F.transform(F.array_distinct(F.transform("all", lambda x: x["topic"])), lambda t: F.element_at(F.filter("all", lambda x: x["topic"] == t), 1))
    ranking = F.transform(topics, lambda x: F.struct(x["topic"].alias("topic"), x["severity"].alias("severity"), x["score"].alias("score")))
    missing = F.array_distinct(F.transform(F.filter("all", lambda x: x["issue_type"] == "missing_prerequisite"), lambda x: x["issue_text"]))
    slides = F.array_distinct(F.flatten(F.transform("all", lambda x: x["slide_refs"])))
    label = F.struct("cluster_id", F.col("value").alias("label"), F.col("n_issues").alias("issue_count"))
    grouped = clusters.where("dimension = 'C'").groupBy("deck_id").agg(F.array_sort(F.collect_list(label)).alias("c"))
    insight = per.select("deck_id", ranking.alias("weak_topic_rankings"), missing.alias("missing_prerequisites"), slides.alias("affected_slide_refs")).join(grouped, "deck_id", "left")
    return insight.withColumn("confusion_clusters", F.coalesce("c", F.array().cast("array<struct<cluster_id: string, label: string, issue_count: bigint>>"))).drop("c")


def export_documents(signals: DataFrame, found: DataFrame, recs: DataFrame) -> DataFrame:
    """(deck_id, document): issues, recommendations and proposals of each deck as one JSON document."""
    def listed(df: DataFrame, order: str, name: str) -> DataFrame:
        body = [c for c in df.columns if c not in ("deck_id", order)]
        return df.groupBy("deck_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*body).alias("row")))), lambda x: x["row"]).alias(name))

    kept = recs.drop("first_seq")
    parts = [listed(found.drop("kind_seq", "pos", "targets"), "rank", "issues"), listed(kept, "rank", "recommendations"), listed(proposals(recs.select("*")).join(recs.select("deck_id", F.col("action").alias("recommended_action"), "rank"), ["deck_id", "recommended_action"]), "rank", "proposal_candidates")]
    every = signals.select("deck_id")
    for part in parts:
        every = every.join(part, "deck_id", "left")
    return every.select("deck_id", F.to_json(F.struct("deck_id", "issues", "recommendations", "proposal_candidates")).alias("document"))


def completeness(signals: DataFrame) -> DataFrame:
    return signals.select("deck_id", *[(F.size(c) > 0).alias(f"has_{c}") for _, c, _ in LISTS])


def unknown_actions(recs: DataFrame) -> DataFrame:
    return recs.where(~F.col("action").isin(*ACTION_WEIGHT))


def trace_totals(results: DataFrame) -> DataFrame:
    """Elapsed time and tokens over the steps of each result's ``trace`` array."""
    return results.select("deck_id", F.explode("trace").alias("t")).groupBy("deck_id").agg(F.sum("t.elapsed").alias("elapsed"), F.sum("t.prompt_tokens").alias("prompt_tokens"), F.sum("t.completion_tokens").alias("completion_tokens"))
