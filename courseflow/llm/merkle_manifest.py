"""Merkle manifest of a table: a tree of three-way runs a source, a tree over the sources, and a proof a row.

A leaf is the hash of a row's fields. Rows are numbered within their source from a range-sorted table (the
number of rows before a partition's first one, plus the place within it), so a source of any share of the
rows is spread over tasks. A level of all trees is one grouping of at most three rows a group.

Proofs are made by pointer jumping. Every node holds the segment of sibling hashes towards an ancestor, at
first its parent. A self-join of the nodes on that ancestor appends the ancestor's own segment, which doubles
the distance; the runs of leaves, which carry their (at most three) leaves along, take the same jumps, until
all are at the root. A node is kept for the jumps of a distance only if a run can stand on it then.

Defined cases: a null field counts as ``-``; rows with a null doc_id come first in their source, those with a
null source are a source of their own; rows that share a doc_id follow each other in the order of their leaf
hashes; rows that are equal in all fields have equal leaves and a proof each; empty and very long texts are
fields like others; an empty table gives no rows; further columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.llm.shared import materialise

FIELDS, ARITY = ("doc_id", "source", "lang", "n_chars", "text"), 3
TOP, SPENT = -1, -2  # the tree over the sources; what finished rows are joined on, which no node has
PATH = "array<struct<l: binary, r: binary>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def framed(field: Column) -> Column:
    said = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """(doc_id, source, leaf, other): the leaf of each row, and its leaf with ``changed`` as its text."""
    leaf = lambda text: F.unhex(digest(*[framed(text if c == "text" else F.col(c)) for c in FIELDS]))
    rows = docs.select(*FIELDS, changed.alias("changed"))
    own = leaf(F.col("text"))
    return rows.select("doc_id", "source", own.alias("leaf"), F.when(F.col("text").eqNullSafe(F.col("changed")), own).otherwise(leaf(F.col("changed"))).alias("other"))


def ordered(df: DataFrame, by: list[str], group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` in the order of ``by`` (which begins with ``group``), with ``part`` and ``at``, a row's partition and
    place in it; and of each part and group (part, group, first, before, total): its first place, the number of the
    group's rows in earlier parts, and in all. The latter has a row a part and group, whatever the number of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    rows = materialise(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", number), "ordered").withColumn("part", F.shiftright("at", 33))
    keys = [group] if group else []
    spans = rows.groupBy("part", *keys).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    within = W.partitionBy(*keys)
    before = F.coalesce(F.sum("rows").over(within.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows, materialise(spans.select("part", *keys, "first", before.alias("before"), F.sum("rows").over(within).alias("total")), "spans")


def placed_leaves(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(tree, p, n, doc_id, leaf, other): each leaf's source by rank, its place there, and the source's size; with the
    number of sources and the size of the largest."""
    rows, spans = ordered(rows, ["source", "doc_id", "leaf", "other"], "source")
    sources, starts = ordered(spans.groupBy("source").agg(F.max("total").alias("n")), ["source"])
    ranked = sources.join(starts, "part").select(F.col("source").alias("of"), (F.col("before") + F.col("at") - F.col("first")).alias("tree"))
    known = spans.join(ranked, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("in_part"), "of", "tree", "first", "before", F.col("total").alias("n"))
    placed = rows.join(known, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    count, most = spans.groupBy("source").agg(F.max("total").alias("n")).agg(F.count("*"), F.max("n")).first()
    return placed.select("tree", (F.col("before") + F.col("at") - F.col("first")).alias("p"), "n", "doc_id", "leaf", "other"), count, most or 0


def depth(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def node_id(tree: Column, level: Column, p: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), p.cast("long").alias("p"))


def _step(hashes: Column, i: Column) -> Column:
    """The siblings before and after the i-th of hashes in hex, as hex."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("l"), F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("r"))


def climb(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """From the nodes (tree, p, n, h, id, sub) of one level, in trees of more than one: the nodes above, and the links
    (node, anc, path, sub) to them."""
    each = F.struct("p", "h", "id", "sub")
    runs = materialise(nodes.groupBy("tree", F.expr(f"p div {ARITY}").alias("up"), "n").agg(F.array_sort(F.collect_list(each)).alias("run")), "runs")
    up = node_id(F.col("tree"), F.lit(level + 1), F.col("up"))
    hashes = F.transform("run", lambda x: _hex(x["h"]))
    above = runs.select("tree", F.col("up").alias("p"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.unhex(F.sha2(F.array_join(hashes, ""), 256)).alias("h"), up.alias("id"), F.lit(None).cast("binary").alias("sub"))
    one = runs.select(F.posexplode("run").alias("i", "x"), up.alias("anc"), hashes.alias("hashes")).select("x", "anc", _step(F.col("hashes"), F.col("i")).alias("s"))
    return above, one.select(F.col("x.id").alias("node"), "anc", F.array(F.struct(F.unhex("s.l").alias("l"), F.unhex("s.r").alias("r"))).alias("path"), F.col("x.sub").alias("sub"))


def grow(nodes: DataFrame, levels: int, first: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The roots of all trees, and the links below them; ``levels`` are those of the largest tree."""
    roots, links = nodes.where("n = 1"), None
    for level in range(first, levels):
        nodes, made = climb(nodes.where("n > 1"), level)
        roots, links = roots.unionByName(nodes.where("n = 1")), made if links is None else links.unionByName(made)
    return roots, links


def jump(rows: DataFrame, links: DataFrame, root: Column) -> DataFrame:
    """``rows`` (anc, path, sub, …) with the ancestor's own ancestor and the path to it. Rows at the root have nothing to
    join; their keys are dealt evenly."""
    done = F.col("anc") == root
    key = F.when(done, node_id(F.lit(SPENT), F.lit(0), F.monotonically_increasing_id())).otherwise(F.col("anc"))
    to = links.select(F.col("node").alias("to"), F.col("anc").alias("far"), F.col("path").alias("more"), F.col("sub").alias("its"))
    met = rows.withColumn("key", key).join(to, F.col("key") == F.col("to"), "left")
    kept = [c for c in rows.columns if c not in ("anc", "path", "sub")]
    return met.select(*kept, F.coalesce("far", "anc").alias("anc"), F.concat("path", F.coalesce("more", F.array().cast(PATH))).alias("path"), F.coalesce("sub", "its").alias("sub"))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of each row. ``proof`` has the hex of the
    siblings before and after, by level; ``folded_root`` is what the row with ``changed`` as its text gives with it."""
    table, sources, most = placed_leaves(materialise(leaves(docs, F.col("text") if changed is None else changed), "leaves"))
    schema = "doc_id string, leaf string, subroot string, root string, proof array<struct<l: string, r: string>>, proof_sha256 string, folded_root string, verified boolean"
    if not sources:
        return docs.sparkSession.createDataFrame([], schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    nil = F.lit(None).cast("binary")
    leaf = F.struct("p", "doc_id", "leaf", "other")
    runs = materialise(table.groupBy("tree", F.expr(f"p div {ARITY}").alias("up"), "n").agg(F.array_sort(F.collect_list(leaf)).alias("run")), "leaf-runs").withColumn("lone", F.col("n") == 1)
    hashes = F.transform("run", lambda x: _hex(x["leaf"]))
    own = F.when(F.col("lone"), F.get("run", F.lit(0))["leaf"]).otherwise(F.unhex(F.sha2(F.array_join(hashes, ""), 256)))
    first = node_id(F.col("tree"), F.when(F.col("lone"), 0).otherwise(1), F.col("up"))
    nodes = runs.select("tree", F.col("up").alias("p"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), own.alias("h"), first.alias("id"), nil.alias("sub"))
    subroots, links = grow(nodes, depth(most), 1)
    subroots = materialise(subroots, "subroots")
    top, above = grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("p"), F.lit(sources).cast("long").alias("n"), "h", "id", F.col("h").alias("sub")), depth(sources))
    root_row = top.select("h", "id.*").first()
    root_id = node_id(F.lit(root_row["tree"]), F.lit(root_row["level"]), F.lit(root_row["p"]))
    root = F.lit(bytes(root_row["h"]).hex())
    rows = runs.select("tree", "lone", "run", first.alias("anc"), F.array().cast(PATH).alias("path"), nil.alias("sub"))
    both = [x for x in (links, above) if x is not None]
    hops, far = depth(most) + depth(sources), 1  # a lone leaf's run stands on level 0, which is a source's root
    if both:
        links = materialise(both[0] if len(both) == 1 else both[0].unionByName(both[1]), "links")
        while far <= hops:  # runs now stand ``far`` levels above their leaves, and links reach as far
            rows = jump(rows, links, root_id)
            far *= 2
            if far <= hops:
                reach = (F.col("node.tree") == TOP) | (F.col("node.level") >= far)
                links = materialise(jump(links.where(reach), links, root_id), "links")
    each = rows.select(F.posexplode("run").alias("i", "x"), F.transform("run", lambda x: _hex(x["leaf"])).alias("hashes"), "lone", "path", "sub")
    above = F.transform("path", lambda s: F.struct(_hex(s["l"]).alias("l"), _hex(s["r"]).alias("r")))
    proof = F.concat(F.when(F.col("lone"), F.array().cast("array<struct<l: string, r: string>>")).otherwise(F.array(_step(F.col("hashes"), F.col("i")))), above)
    proven = each.select(F.col("x.doc_id").alias("doc_id"), _hex(F.col("x.leaf")).alias("leaf"), _hex(F.col("x.other")).alias("other"), F.coalesce(_hex(F.col("sub")), root).alias("subroot"), proof.alias("proof"))
    folded = F.aggregate("proof", F.col("other"), lambda h, s: digest(s["l"], h, s["r"]))
    done = proven.withColumn("folded_root", folded)
    return done.select("doc_id", "leaf", "subroot", root.alias("root"), "proof", F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["l"], s["r"])), ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
