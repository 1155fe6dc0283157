"""Clashing column names, very long texts, hot groups, and the pipeline against a plain version of its stages."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from courseflow.llm import chat_format, jaccard_join, mixing, piece_sampling, quality_rules, sketch, substring_dedup, surrogates, textblock, token_store, topk_search, warc
from courseflow.llm.queries import tokenizer_path

DRAW = random.Random(11)
VOCABULARY = [f"word{i}" for i in range(900)] + ["The", "a", "é", "über"]


def _text(n, draw=DRAW):
    return " ".join(draw.choices(VOCABULARY, k=n))


#: Names that operators use for columns of their own, and some of them with what is added to make them free.
NAMES = ["_s", "_b", "_n", "_p", "_c", "_gone", "doc_id_gone", "_dedup_id", "dedup_id", "dedup_marks", "nth_row", "mix_rank", "mix_key", "mix_key_", "mix_source", "mix_bucket", "mix_nth", "mix_position", "mix_copy", "pii_row", "pii_pairs", "quality_rules", "substring_dedup", "key", "node", "component", "size", "hash", "bucket", "rep", "n", "row", "entity", "target", "taken", "position", "copy"]


def test_clashing_column_names(spark):
    passage = _text(60)
    rows = [(1, _text(30) + " " + passage, "x", 5), (2, passage + " " + _text(30), "y", 6), (3, "Mr Smith wrote to ann@corp.example.org. " + _text(30), None, 7), (4, None, "x", 8), (None, _text(30), "y", 9)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    odd = plain.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for apply in (jaccard_join.keep_one, mixing.mixed, substring_dedup.remove_passages, surrogates.pseudonymise, lambda d: quality_rules.keep_good(d, labels)):
        got = apply(odd)
        assert got.columns == odd.columns
        want = Counter(map(tuple, apply(plain).collect()))
        assert Counter(tuple(r)[:4] for r in got.collect()) == want
        assert all(r["_p"] == (None if r.doc_id is None else f"_p{r.doc_id}") for r in got.collect())
    assert mixing.mix_digest(odd).count() == len(rows) and jaccard_join.components(odd).count() == len(rows)
    assert substring_dedup.substring_digest(odd).count() == len(rows)


def _digest(rows):
    segments = chat_format.chat_segments(rows)
    return chat_format.chat_digest(chat_format.chat_turns(segments), chat_format.chat_examples(segments))


def test_extra_columns_and_empty_tables(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0], "x", 1, 2) for i in range(60)], "vec_id long, embedding array<float>, score string, rank int, query_id int")
    assert sorted(map(tuple, topk_search.top_k(vectors).collect())) == sorted(brute.op2([(i, [float(i % 7), 1.0]) for i in range(60)]))
    pages = spark.createDataFrame([(1, "u", "x", "a", 3), (2, "u", "x", "b", 4)], "page_id long, url string, html string, record_type string, offset int")
    assert sorted(tuple(r)[:5] for r in warc.warc_round_trip(pages).collect()) == sorted(brute.op6([(1, "x"), (2, "x")]))
    turns = spark.createDataFrame([(1, 0, "user", "a", "p", 5), (1, 1, "assistant", "b", "q", 6)], "conv_id long, turn long, role string, text string, piece string, start long")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in _digest(turns).collect()} == brute.op4([(1, 0, "user", "a"), (1, 1, "assistant", "b")])
    assert _digest(turns.limit(0)).count() == 0


LONG = [(1, _text(22_000)), (2, "字" * 30_000), (3, "x" * 60_000), (4, "line of words\n" * 6_000), (5, "ann@corp.example.org " * 3_000), (6, _text(22_000) + " tail")]


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    rows = [*LONG, (7, LONG[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.components(df).collect())) == brute.op5(rows)
    assert sorted(map(tuple, substring_dedup.substring_digest(df).collect())) == sorted(brute.op7(rows))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(df, labels).collect()}
    assert got == {d: brute.op3(t) for d, t in rows}
    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in token_store.token_store_digest(df, path).collect()} == brute.op1(rows, lambda x: t.encode(x, add_special_tokens=False).ids)
    sampled = piece_sampling.sampled_pieces(df, tokenizer_path("piece_bpe_32k.model")).collect()
    assert Counter(r.doc_id for r in sampled) == {d: 1 if d == 2 else 2 for d, _ in rows} and all(r.decoded for r in sampled)  # one character has one way
    hidden = {r.doc_id: (r.text, r.n) for r in surrogates.pseudonymise(df, count_as="n").collect()}
    assert hidden[5][1] == 3_000 and "ann@" not in hidden[5][0] and all(hidden[d] == (x, 0) for d, x in rows if d != 5)


def test_hot_cells_are_found_in_few_tasks(spark):
    text = _text(40)
    df = spark.range(0, 3000, 1, 4).selectExpr(f"'{text}' as text").union(spark.createDataFrame([(_text(200),)], "text string"))

    def hashes(batch):
        words = textblock.Words(*textblock.texts(batch.column("text")))
        yield words.window_hash(words.windows(13), 13)

    bits = sketch.repeated(df, hashes, 2, 20, 200)
    words = textblock.Words(*textblock.texts(pa.array([text])))
    assert sketch.may_be_hot(words.window_hash(words.windows(13), 13), bits[-1]).all()
    assert np.unpackbits(bits[-1]).sum() == 28


def test_hot_windows_are_judged_alike(spark):
    passage = _text(20)
    rows = [(d, f"{_text(3)} {passage} {_text(2)}") for d in range(700)] + [(5, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.substring_digest(df).collect())) == sorted(brute.op7(rows))


def test_a_large_group_of_near_copies_and_chains(spark):
    base, rows = _text(120).split(), []
    for i in range(400):  # each a few edits from the base, many too far from each other
        mine = list(base)
        for j in DRAW.sample(range(120), i % 5):
            mine[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(mine)))
    chain = _text(100).split()
    for i in range(60):  # each close to the one before, the ends far apart
        chain = [*chain[1:], f"next{i}"]
        rows.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k, percent in ((4, 85), (5, 80)):
        assert sorted(map(tuple, jaccard_join.components(df, k, percent).collect())) == brute.op5(rows, k, percent)


def test_tiles_give_the_overlaps_of_all_columns():
    sets = [sorted(DRAW.sample(range(300), DRAW.randint(1, 120))) for _ in range(90)] + [list(range(100))] * 150
    columns = [np.array(x, np.int64) * 7919 for x in sets]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[{"node": i, "n": len(x), "component": i, "grams": x.tolist()} for i, x in enumerate(columns)]], pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("grams", pa.list_(pa.int64()))])))], ["tile", "rows"])
    packed = next(jaccard_join._packed(iter([batch]))).column("rows")[0].as_py()
    tile = jaccard_join.Tile(packed)
    found = tile.overlaps(tile)
    assert all(found[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(len(sets)) for j in range(len(sets)))
    root = dict(zip(*[x.tolist() for x in tile.links(tile, 85)[::-1]]))
    assert {root[i] for i in range(91, 240)} == {90} and 90 not in root


def test_mixing_positions_and_order(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, _text(1 + i % 17) if i % 8 else None) for i in range(120)] + [(3, "s3", _text(4)), (None, "s1", "no key")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute.mix_plan(rows)
    got = [r for r in mixing.placements(df).collect() if r.copy is not None]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.copy, r.taken) for r in got) == sorted((d is None, d or 0, c, n) for _, c, d, n in want)
    assert all(math.isclose(a, b[0], abs_tol=1e-9) for a, b in zip(sorted(r.position for r in got), want))
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert [r.doc_id for r in mixing.mixed(df).collect()] == [d for _, _, d, _ in brute.mix_plan(rows, whole=True)]


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k, "a" if k else None, f"w{i} x y") for i in range(12) for k in (7, None)]
    orders = [spark.createDataFrame(r, "doc_id long, source string, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 3), (rows[5:] + rows[:5], 2))]
    got = [[tuple(r) for r in mixing.mixed(df).collect()] for df in orders]
    assert got[0] == got[1] == got[2] and len(got[0]) >= len(rows)


def test_a_null_key_is_a_key_of_its_own(spark):
    text = "several words of which each has many segmentations"
    rows = [(-1, text), (None, text), (-1, text), (None, text), (0, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {}
    for r in piece_sampling.sampled_pieces(df, tokenizer_path("piece_bpe_32k.model")).collect():
        got.setdefault(r.doc_id, set()).add((r["sample"], r.perturbed))
    assert len(got[None]) == len(got[-1]) == piece_sampling.SAMPLES  # repeated rows repeat their samples
    assert not got[None] & got[-1] and not got[None] & got[0] and not got[-1] & got[0]


@pytest.fixture
def corpus(spark, tmp_path):
    draw = random.Random(23)
    rows = []
    for i in range(90):
        good = _text(draw.randint(30, 90), draw)
        if i % 3 == 0:
            rows.append((i, " ".join(w + "###" for w in good.split())))
        elif i % 10 == 1:
            words = next((t for _, t in reversed(rows) if "#" not in t), good).split()
            words[len(words) // 2] = "changed"
            rows.append((i, " ".join(words)))
        elif i % 7 == 2:
            rows.append((i, good + f" Mail ann{i % 2}@corp.example.org or Mr John Smith, 536-555-87{i % 2}2."))
        else:
            rows.append((i, good))
    rows += [(200, rows[1][1]), (201, rows[1][1] + " end"), (202, None), (203, ""), (204, "too short"), (205, "again and again we say it " * 9)]
    rows = [(d, t, ("en", "de")[d % 2], f"source{d % 3}", len(t or "")) for d, t in rows]
    labels = [(i, int(i % 3 != 0), 0) for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_pipeline_equals_a_plain_version_of_its_stages(spark, corpus):
    import corpus_pipeline

    path, rows = corpus
    docs, labels = (spark.read.parquet(f"{path}/{x}.parquet") for x in ("documents", "labels"))
    model = quality_rules.train(docs, labels)
    assert model is not None
    kept = []
    for r in rows:  # one text at a time
        verdict = quality_rules._judge(pa.array([r[1]], pa.string()), model)[0].as_py()
        assert verdict["base_failed"] == brute.op3(r[1])[-1]
        if verdict["kept"]:
            kept.append(r)
    assert 20 < len(kept) < len(rows) and not any("###" in r[1] for r in kept)
    group = {d: c for d, _, c in brute.op5([(r[0], r[1]) for r in kept], 5, 80)}
    unique = [r for r in kept if group[r[0]] == r[0]]
    assert len(unique) < len(kept)
    # Surrogates depend on all entities at once; what they replace and keep is known.
    hidden = {r.doc_id: r.text for r in surrogates.pseudonymise(spark.createDataFrame(unique, docs.schema).coalesce(1)).collect()}
    personal = re.compile(r"ann\d@corp|John Smith|536-555")
    for d, text, *_ in unique:
        assert (hidden[d] == text) == (personal.search(text) is None) and not personal.search(hidden[d])
    mix = brute.mix_plan([(r[0], r[3], hidden[r[0]]) for r in unique], whole=True)
    pieces = piece_sampling.Pieces(tokenizer_path("piece_bpe_32k.model"))
    want = Counter()
    for _, _, d, _ in mix:
        lattice, samples = piece_sampling.sample_texts([hidden[d]], np.array([d]), pieces, 2, piece_sampling.SEED)
        for j, s in enumerate(samples):
            ids, _ = piece_sampling._expand(lattice, pieces, s)
            want[d, j + 1, zlib.crc32(ids.astype("<i4").tobytes())] += 1
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.sample, r.ids_crc32) for r in got) == want and all(r.decoded for r in got)


def test_links_across_size_bands_and_untested_pairs(spark, monkeypatch):
    """Rows that share a key: sizes that allow a link only just are compared, others are not, nor are pairs compared before."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    docs, at = [], 0
    for n in (17, 34, 51, 85, 170, 289, 340):  # n of m n-grams is 85 % sharp, a band apart or near its edge
        m = n * 20 // 17
        for length in (n, m, m + 1):
            docs.append((at := at + 1, " ".join([f"x{n}_{i}" for i in range(length + 3)])))
    for i in range(24):  # one run of words in texts of all sizes
        docs.append((at := at + 1, " ".join([*base[:8], *[f"y{i}_{j}" for j in range(draw.randint(5, 600))]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    across = jaccard_join._across

    def nothing_met_before(shared, joined, sets, tested, percent):
        alone = shared.select("node").distinct().withColumn("component", shared["node"])
        late = across(shared, alone, sets, tested.limit(0), percent)
        kept = across(shared, alone, sets, tested, percent)
        seen.append(({tuple(r) for r in late.collect()}, {tuple(r) for r in kept.collect()}))
        return across(shared, joined, sets, tested, percent)

    monkeypatch.setattr(jaccard_join, "_across", nothing_met_before)
    got = sorted(map(tuple, jaccard_join.components(df, 4, 85).collect()))
    assert got == brute.op5(docs, 4, 85)
    linked = {d for d, _, c in got if d != c}
    (late, kept), = seen
    assert {b for _, b in late} == linked and linked  # every link is found without the hubs' help
    assert kept <= late

    sizes = spark.createDataFrame([(1, n) for n in range(1, 3000)], "key long, n long")
    for percent in (85, 80, 60, 100):
        bands = {}
        for r in jaccard_join._banded(sizes, percent).collect():
            bands.setdefault(r.n, set()).add(r.key)
        for n in range(1, 3000):
            for m in (n, n * 100 // percent):
                assert m >= 3000 or bands[n] & bands[m]
        assert not bands[10] & bands[100]


def test_marks_bound_the_overlap():
    sets = jaccard_join.Sets(pa.array([" ".join(DRAW.sample("abcdefghijklmnopqrstuvwxyz", n % 26 + 1) * (1 + n % 5) + [f"w{n // 4}_{i}" for i in range(n * n // 7)]) for n in range(60)]), 2)
    rows = [(int(sets.n[i]), np.frombuffer(m, "<u8"), set(sets.hash[sets.first[i] : sets.first[i + 1]].tolist())) for i, m in enumerate(sets.marks().to_pylist())]
    assert all(len(x) * 64 == jaccard_join.mark_width(n) for n, x, _ in rows)
    for n, x, a in rows:
        for m, y, b in rows:
            most = jaccard_join._at_most(n, m, jaccard_join._folded(x, len(y)), jaccard_join._folded(y, len(x)))
            assert most >= len(a & b) and (a != b or most == n)


def test_columns_of_rows_that_cannot_link_are_not_read(spark, monkeypatch):
    """Each text shares half of its words with the next one, so all have common keys; only one pair is near."""
    half = [_text(60) for _ in range(41)]
    rows = [(i, f"{half[i]} {half[(i + 1) % 40]}") for i in range(40)] + [(40, f"{half[0]} {half[1]} end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    read, write = [], jaccard_join.materialise

    def noted(df, name):
        out = write(df, name)
        if name == "sets":
            read.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", noted)
    assert sorted(map(tuple, jaccard_join.components(df).collect())) == brute.op5(rows)
    assert sum(read) == 2
