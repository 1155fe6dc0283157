"""SimHash, clustering and the manifest against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from courseflow.llm import centroid_clustering, merkle_manifest, simhash_dedup

random.seed(11)
WORDS = [f"w{i}" for i in range(40)] + ["É", "a", "B"]


def _same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def texts():
    base = [random.choices(WORDS, k=60) for _ in range(6)]
    near = [(i, " ".join(w if random.random() > 0.02 else "x" for w in base[i % 6])) for i in range(60)]
    odd = [(None, "a b c"), (None, None), (300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (305, " one\ttwo "), (1, "quite another text here"), (1, None), (306, "a b c " * 5000), (307, "词 语 b"), (308, "x" * 200_000)]
    return near + odd + near[:3]


@pytest.mark.parametrize("most", [simhash_dedup.BUCKET, 4])
def test_simhash(spark, texts, most):
    """With small buckets every bucket is split down to the last level."""
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"fp": F.lit(1), "used": F.lit("x"), "bucket": F.lit(2), "rep": F.lit(0)})
    _same(simhash_dedup.components(df, most=most).collect(), brute.op11(texts))


def test_simhash_keeps_one_of_each_component(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("component_id", F.lit("own"))
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    gone = {d for d, _, c in brute.op11(texts) if d is not None and c != d}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in texts if d is not None and d not in gone)
    assert simhash_dedup.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices_count_distances(radius):
    x = np.random.default_rng(1).integers(0, 2**63, 700, dtype=np.uint64)
    x[100:200], x[200:250] = x[:100] ^ np.uint64(5), x[:50] ^ np.uint64(1 << 63 | 6)
    planes = simhash_dedup.Planes(x)
    row, word = np.repeat(np.arange(700), 11), np.tile(np.arange(11), 700)
    item, other, read = planes.near(x[row], word, radius)
    want = {(a, b) for a in range(700) for b in range(700) if int(x[a] ^ x[b]).bit_count() <= radius}
    assert set(zip(row[item].tolist(), other.tolist())) == want
    assert read < len(row) * 40  # most words are abandoned before their last plane


def test_split_masks_leave_a_common_stretch():
    for mask in simhash_dedup.split_mask(0):
        finer = simhash_dedup.split_mask(mask)
        assert len(finer) == 3 and all(m & mask == mask for m in finer)
        assert finer[0] & finer[1] == mask and (finer[0] | finer[1] | finer[2]) == 2**64 - 1


def _vector(spread=1.0):
    return [random.gauss(0, spread) for _ in range(64)]


def _vectors(name):
    if name == "groups":
        base = [_vector() for _ in range(5)]
        rows = [(i, [x + random.gauss(0, 0.1) for x in base[i % 5]]) for i in range(200)]
        return rows + [(None, _vector()), (1, None), (2, [None] * 64), (3, [float("nan"), *_vector()[1:]]), (4, _vector()[1:]), (5, [1.0] * 64), (5, [1.0] * 64), (6, [0.0] * 64), (7, [float("inf")] * 64), (8, [])]
    if name == "equal":
        return [(i, [1.0] * 64) for i in range(20)]
    if name == "few":
        return [(i, _vector()) for i in range(3)]
    if name == "null ids":
        return [(None, _vector()) for _ in range(4)] + [(9, _vector())]
    return [(i, _vector(10.0 ** (i % 9 * 3))) for i in range(50)] + [(100, [1e308] * 64), (101, [-1.7e308] + [0.0] * 63), (102, [70000.0] * 64), (103, [5e-324] * 64)]


@pytest.mark.parametrize("name", ["groups", "equal", "few", "null ids", "wide"])
def test_clusters(spark, name):
    rows = _vectors(name)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit(7), "distance": F.lit("x"), "x": F.lit(1)})
    _same(centroid_clustering.cluster(df).collect(), brute.op12(rows))
    assert centroid_clustering.cluster(df.limit(0)).count() == 0


def test_simplex_bounds_hold_and_filter():
    draw = np.random.default_rng(5)
    base = draw.integers(-3000, 3000, (8, 64))
    v = np.repeat(base, 200, axis=0) + draw.integers(-200, 200, (1600, 64))
    simplex = centroid_clustering.Simplex([*base.tolist(), base[0].tolist(), ((base[0] + base[1]) // 2).tolist()])
    assert len(simplex.pivots) == 8  # the last two lie in the span of the others
    centroids = v[::200].tolist()
    squared = lambda rows: centroid_clustering._squared(rows, simplex.pivots).astype(float)
    x, c = simplex.apexes(squared(v)), simplex.apexes(squared(np.array(centroids)))
    lower, upper = centroid_clustering.bounds(x, c)
    true = np.sqrt(((v[:, None].astype(float) - np.array(centroids)[None]) ** 2).sum(2))
    assert (lower <= true).all() and (true <= upper).all()
    nearest = centroid_clustering.Nearest(centroids, simplex)
    found, distance = nearest.narrow(v, x)
    assert nearest.filtered > 0.8 * true.size
    want = ((v[:, None] - np.array(centroids)[None]) ** 2).sum(2)
    assert (found == want.argmin(1)).all() and (distance == want.min(1)).all()


@pytest.mark.parametrize("x", [0, 1, -1, 2**32, -(2**32), 2**70 + 5, -(2**70) - 5])
def test_limbs_add_up(x):
    assert sum(limb << (32 * place) for place, limb in centroid_clustering.limbs(x)) == x


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def _documents(name):
    if name == "one":
        return [(1, "a", "en", 3, "x\ny")]
    if name == "one source":
        return [(i, "a", None, 3, "x\ny" * i) for i in range(28)]
    if name == "sources of one row":
        return [(i, f"s{i}", "en", i, f"t\n{i}") for i in range(11)]
    mixed = [(i if i % 7 else None, [None, "a", "é", "b", ""][i % 5 if i < 40 else 1], None, i, "x\ny" * (i % 4) if i % 3 else None) for i in range(120)]
    return mixed + [(1, "a", "en", 1, "t")] * 4 + [(9, "only", "en", 1, "t\n"), (10, "b", "en", 10**6, "long \n" * 50_000)]


@pytest.mark.parametrize("name", ["one", "one source", "sources of one row", "mixed"])
def test_manifest(spark, name):
    rows = _documents(name)
    df = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "p": F.lit(1), "root": F.lit(2)})
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    _same(merkle_manifest.manifest(df, changed).drop("proof").collect(), brute.op13(rows))
    whole = merkle_manifest.manifest(df)
    assert whole.where("not verified").count() == 0
    assert merkle_manifest.manifest(df.limit(0)).count() == 0
