"""Incremental jobs: what a second run or batch adds, replaces or leaves alone."""

import pytest

from pyspark.sql import functions as F

from courseflow.operators import deck_state, signals
from courseflow.sources import tables
from courseflow.streaming import incremental, unit_store, versions


def _rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def test_only_new_files_become_sources(spark, tmp_path):
    files, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    files.mkdir()
    for names in (["a.txt"], ["b.py", "c d.pdf"], []):
        for name in names:
            (files / name).write_text(name)
        query = incremental.stream_sources(spark, str(files), out, checkpoint, "m", "tester")
        query.awaitTermination()
    found = spark.read.parquet(out)
    assert sorted(r[0] for r in found.select("source_type").collect()) == ["code", "pdf", "text"]
    assert found.select("source_id").distinct().count() == 3


def test_units_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "units")
    batch = spark.createDataFrame([("s", 1, "k1", "One", None), ("s", 2, "k2", "Two", "k1")], "source_id string, unit_index int, key string, title string, prerequisite_key string")
    spark.createDataFrame([(["s"], "One")], "source_ref array<string>, title string").write.parquet(path)
    for _ in range(2):
        incremental.append_new_units(batch, path)
    assert _rows(spark.read.schema("source_ref array<string>, title string").parquet(path), "title") == [("One",), ("Two",)]


def test_sources_with_chunks_are_left_out(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert _rows(incremental.unchunked(texts, spark.createDataFrame([("a",), ("a",)], "source_id string")), "source_id") == [("b",)]


RECORD = "id string, document string, write_seq long"


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_records_are_replaced_by_id(spark, tmp_path):
    path = str(tmp_path / "records")
    schema = _records(spark, []).schema
    assert incremental.stored_records(spark, path, schema).count() == 0
    incremental.upsert_records(_records(spark, [(f"i{i}", "old", 1) for i in range(50)]), path, 8)
    incremental.upsert_records(_records(spark, [("i3", "new", 2), ("i50", "new", 2), ("i4", "late", 0)]), path, 8)
    incremental.upsert_records(_records(spark, []), path, 8)
    want = [(f"i{i}", "new" if i in (3, 50) else "old", 2 if i in (3, 50) else 1) for i in range(51)]
    assert _rows(incremental.stored_records(spark, path, schema), "id", "document", "write_seq") == sorted(want)
    number, told = versions.newest(spark, path)
    assert number == 2 and len(set(told.values())) == 2  # buckets without a new record stay as they are


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "records")
    schema = _records(spark, []).schema
    incremental.upsert_records(_records(spark, [("a", "old", 1), ("b", "old", 1)]), path, 2)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", stop)
        with pytest.raises(RuntimeError):
            incremental.upsert_records(_records(spark, [("a", "new", 2)]), path, 2)
    (tmp_path / "records" / "manifest" / "000000000002.json").write_text("{\"0\": ")  # a manifest that was not finished
    assert _rows(incremental.stored_records(spark, path, schema), "id", "document") == [("a", "old"), ("b", "old")]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "records")
    incremental.upsert_records(_records(spark, [("a", "old", 1)]), path, 2)

    def slow(old, new):
        incremental.upsert_records(_records(spark, [("a", "first", 2)]), path, 2)
        return incremental.tables.upsert(old, new)

    with pytest.raises(versions.Conflict):
        versions.merge(_records(spark, [("a", "second", 3)]), path, "id", slow, 2)
    assert _rows(incremental.stored_records(spark, path, _records(spark, []).schema), "document") == [("first",)]


RUN = "run_seq long, run_id string, deck_id string, student_profile string, task_type string, status string, slide_refs array<string>, answer " + tables.ANSWER


def _made_runs(first, last):
    """Runs of a deck with every other run and of six more; now and then no answer, no evidence, a null list or an empty tag."""
    for n in range(first, last):
        answer = {"main_answer": "x" * (n % 9), "confidence": 0.5, "confusion_tags": ["a", "b", ""][: n % 4], "missed_prerequisites": None if n % 11 == 0 else [f"p{n % 3}"][: n % 2], "misconception_flags": [f"m{n % 2}"][: n % 3], "evidence_slide_refs": [f"s{n % 4}", f"s{n % 3}"][: n % 3]}
        yield (n, f"r{n}", "hot" if n % 2 else f"d{n % 6}", ["strong", "weak", "average"][n // 3 % 3], "short_qa", "completed", [f"s{n % 5}"], None if n % 13 == 0 else answer)


def _slides(spark):
    return spark.createDataFrame([(d, f"s{i}", f"Slide {i}", i) for d in ("hot", "d0", "d2", "d4") for i in range(3)], "deck_id string, slide_id string, title string, slide_pos int")


def _said(signals_):
    return sorted((r.deck_id, r.weak_topics, r.repeated_confusion_points, r.misconception_clusters, r.missing_prerequisite_patterns, r.recommended_revision_targets, r.representative_run_ids, r.n_runs) for r in signals_.collect())


def _without_null_lists(runs):
    lists = ("confusion_tags", "missed_prerequisites", "misconception_flags", "evidence_slide_refs")
    none = F.array().cast("array<string>")
    return runs.withColumn("answer", F.when(F.col("answer").isNotNull(), F.struct("answer.main_answer", "answer.confidence", *[F.coalesce(f"answer.{c}", none).alias(c) for c in lists]))).withColumn("evidence_refs", F.lit(None))


def test_two_batches_make_the_signal_of_all_runs(spark, tmp_path):
    files, state, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    slides = _slides(spark)
    batches = [spark.createDataFrame(list(_made_runs(*b)), RUN) for b in ((0, 150), (150, 260))]
    clean = [_without_null_lists(b) for b in batches]
    for batch in clean:
        files.mkdir()
        batch.drop("evidence_refs").coalesce(1).write.parquet(str(files / "part"))
        source = spark.readStream.schema(RUN).option("recursiveFileLookup", True).parquet(str(files))
        query = source.writeStream.foreachBatch(lambda df, n: incremental.update_decks(df, n, state, 4)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        files.rename(tmp_path / f"read-{len(list(tmp_path.iterdir()))}")  # what has been read is gone
    want = _said(signals.cohort_signal(clean[0].unionByName(clean[1]), slides))
    assert len(want) == 4 and _said(incremental.deck_signals(state, slides)) == want
    only = spark.createDataFrame([("hot",), ("none",)], "deck_id string")
    assert _said(incremental.deck_signals(state, slides, only, 4)) == [w for w in want if w[0] == "hot"]


def test_a_batch_that_comes_again_is_not_counted_again(spark, tmp_path):
    path, slides = str(tmp_path / "state"), _slides(spark)
    runs = spark.createDataFrame(list(_made_runs(0, 40)), RUN)
    for n in (0, 0, 1, 0):
        incremental.update_decks(runs.where(f"run_seq % 2 = {n}"), n, path, 4)
    got = _said(incremental.deck_signals(path, slides))
    whole = deck_state.state(runs)
    assert got == _said(deck_state.cohort_signal(whole, slides)) and sum(g[-1] for g in got) == runs.where("answer is not null").count()
    incremental.update_decks(runs.where("false"), 2, path, 4)
    assert _said(incremental.deck_signals(path, slides)) == got


def test_state_adds_up_in_any_order(spark):
    runs = spark.createDataFrame(list(_made_runs(0, 90)), RUN)
    parts = [deck_state.state(runs.where(f"pmod(run_seq, 3) = {i}")) for i in range(3)]
    rows = lambda df: sorted(map(repr, df.collect()))
    whole = rows(deck_state.state(runs))
    assert rows(deck_state.merged(deck_state.merged(parts[2], parts[0]), parts[1])) == whole
    assert rows(deck_state.merged(parts[0], deck_state.merged(parts[1], parts[2]))) == whole
    assert deck_state.state(runs.where("false")).count() == 0


def test_unseen_titles_leave_the_store_in_place(spark, tmp_path):
    name = "units_" + tmp_path.name.replace("-", "_")
    unit_store.open_store(spark, name, str(tmp_path / "store"), "key STRING, body STRING", 4)
    batch = lambda rows: spark.createDataFrame(rows, "source_id string, title string, key string, body string, source_ref array<string>")
    first = batch([("s1", "One", "k1", "b1", None), ("s1", "Two", "k2", "b2", ["s1", "s2"]), ("s3", "One", "k3", "b3", ["s4"]), ("s1", None, "k4", "b4", [])])
    for _ in range(2):  # the second delivery stores nothing but what has no title
        unit_store.append_unseen(first.where("title is not null"), name)
    unit_store.append_unseen(batch([("s2", "Two", "k5", "", None), ("s2", "Three", "k6", "", None), ("s4", "One", "k7", "", None), ("s9", "One", "k8", "", None)]), name)
    spark.sql(f"DROP TABLE {name}")
    unit_store.open_store(spark, name, str(tmp_path / "store"), "key STRING, body STRING", 4)  # as a new session would
    assert _rows(unit_store.stored(spark, name), "key", "body") == [("k1", "b1"), ("k2", "b2"), ("k3", "b3"), ("k6", ""), ("k8", "")]
    executed = unit_store.unseen(first, name)._jdf.queryExecution().executedPlan().toString()
    stored_side = executed[executed.rindex("+- Sort"):]
    assert executed.count("Exchange") == 1 and "Exchange" not in stored_side and "Bucketed: true" in stored_side and "SelectedBucketsCount: 4 out of 4" in stored_side
    assert "part" in stored_side[stored_side.index("PartitionFilters"):stored_side.index("PushedFilters")]
    spark.sql(f"DROP TABLE {name}")
