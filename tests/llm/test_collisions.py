"""Words, windows and vectors that a weak hash or a narrow integer would confuse."""

import brute
import pyarrow as pa

from courseflow.llm import jaccard_join, quality_rules, sketch, substring_dedup, textblock, topk_search

_SIGNS = [bin(i).count("1") % 2 for i in range(2048)]
ONE, OTHER = ("".join("ab"[b ^ flip] for b in _SIGNS) for flip in (0, 1))  # equal under every polynomial modulo 2**64 with an odd base


def test_spans_of_opposite_signs_have_different_hashes():
    for n in (16, 64, 512, 1024, 2048):
        words = textblock.Words(*textblock.texts(pa.array([f"{ONE[:n]} {OTHER[:n]}"])))
        for seed in (0, 1):
            h = textblock.span_hash(words.raw, words.start, words.end, seed)
            assert h[0] != h[1]


def test_hash_depends_on_the_bytes_alone():
    texts = ["x" * i + " " + "word" + "y" * n for i in range(9) for n in (0, 3, 4, 5, 12, 600)]
    words = textblock.Words(*textblock.texts(pa.array(texts)))
    by_word = {}
    for a, b, h in zip(words.start, words.end, words.hash):
        assert by_word.setdefault(bytes(words.raw[a:b]), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_jaccard_join_keeps_them_apart(spark):
    rows = [(1, ONE), (2, OTHER), (3, ONE), (4, f"{ONE} a b c"), (5, f"{OTHER} a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.components(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_substring_dedup_keeps_them_apart(spark):
    twelve = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{ONE} {twelve}"), (2, f"{OTHER} {twelve}"), (3, f"{OTHER} {twelve}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.substring_digest(df).collect())) == sorted(brute.op7(rows))


def test_quality_rules_keep_them_apart(spark):
    eight, other = f"{ONE} " + "a b c d e f g", f"{OTHER} " + "a b c d e f g"
    rows = [(1, f"{eight}\n{other}"), (2, f"{eight}\n{eight}")]
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: (0, 0), 2: (1, 16)}


def test_wide_vectors_are_ranked_exactly(spark):
    rows = [(i, [float(i % 7), 1.0, -2.5]) for i in range(120)]
    rows += [(200, [70_000.0, 1.0, 0.0]), (250, [-70_000.0, 3.0, 9.0]), (251, [70_000.00390625, 1.0, 0.0]), (300, [3e38, -3e38, 1.0]), (301, [3e38, -3e38, 1.5]), (302, [1e38, 0.0, 0.0]), (350, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fits = lambda s: s if abs(s) < 1 << 63 else None
    want = [(q, r, v, fits(s)) for q, r, v, s in brute.op2(rows)]
    assert sorted(map(tuple, topk_search.top_k(df).collect()), key=str) == sorted(want, key=str)


def test_scores_sort_as_texts():
    scores = [-(10**40), -(10**18) - 1, -100, -99, -10, -9, -1, 0, 1, 9, 10, 11, 99, 100, 10**18, 10**40]
    keys = [topk_search.sort_key(s) for s in scores]
    assert keys == sorted(keys)


def test_counts_of_any_size_are_sent(spark):
    """One word repeated in one partition: its window is hot, however large ``hot`` is."""
    df = spark.createDataFrame([("same " * 20_000,)], "text string").repartition(1)

    def hashes(batch):
        words = textblock.Words(*textblock.texts(batch.column("text")))
        yield words.window_hash(words.windows(13), 13)

    for hot, found in ((300, 1), (19_988, 1), (19_989, 0)):
        bits = sketch.repeated(df, hashes, 2, 20, hot)
        assert int(sum(b.bit_count() for b in bits[-1].tolist())) == found


def test_a_third_of_the_rows_in_one_task_are_hot_too(spark):
    rows = [(d, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen") for d in range(1, 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        assert len(substring_dedup.repeated_windows(df.repartition(parts)).where("size(marks) = 2").collect()) == 5998
