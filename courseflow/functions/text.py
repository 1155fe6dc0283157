"""Column functions on text, tags, scores and JSON lists. All are built-in expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64

#: Line breaks of Python's splitlines, words that make no tag, patterns of page marks.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"
STOP_WORDS = "a an and as for from in into of on or other the to with".split()
GENERIC_TAGS = "chapter classification classifying learning machine model models regression summary using".split()
PAGE_MARK = r"^\[\s*[ivxlcdmIVXLCDM0-9]+\s*\]$"
BOILERPLATE = [r"(?i)^copyright ©", r"(?i)^created from "]
CAUTION = "advantage|disadvantage|limitation|bias|variance"
EXAMPLE = "using|applying|training|classifying|classification with|regression with|visualizing|installing|performing"
INTRODUCTORY = "fundamental|introduction|basics"
PUBLISHER_MARK = r"^Publishing, Limited, 2017\.\s*"
DIFFICULTY = "intro_undergrad"
SOURCE_TYPES = {"pdf": "pdf", "image": "image png jpg jpeg webp", "code": "code py ipynb js ts java cpp c go rs", "text": "text txt md json csv"}
EXTENSIONS = {"pdf": "pdf", "image": "png jpg jpeg webp", "code": "py ipynb js ts java cpp c go rs", "text": "txt md json csv"}


def trim_ws(x: Column) -> Column:
    """Both ends without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def rtrim_ws(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+\z", "")


def or_else(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where the list ``a`` is null or empty."""
    return F.when(F.size(a) > 0, a).otherwise(b)


def is_given(x: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(x, F.lit("")) != ""


def sanitize_filename(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^A-Za-z0-9._-]+", "_")
    return F.when(is_given(name), name).otherwise("upload.bin")


def infer_source_type(name: Column, provided: Column | None = None) -> Column:
    given = F.lower(trim_ws(F.coalesce(provided, F.lit("")))) if provided is not None else F.lit("")
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = F.lit("unknown")
    for kind, names in reversed(EXTENSIONS.items()):
        out = F.when(extension.isin(names.split()), kind).otherwise(out)
    for kind, names in reversed(SOURCE_TYPES.items()):
        out = F.when(given.isin(names.split()), kind).otherwise(out)
    return out


def prefixed_id(prefix: str, *natural: Column, digits: int = 16) -> Column:
    """A deterministic id from a natural key."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *natural), 256), 1, digits))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256_"), F.sha2(content, 256))


def normalize_topic(x: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(""))


def topic_tokens(normal: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normal, " ")), lambda t: t != "")


def topic_match_score(query: Column, candidates: Column) -> Column:
    """Least of 0 (equal), 1 (contained) and 2 (all words) over the candidates; null if none matches."""
    q = normalize_topic(query)
    words = topic_tokens(q)

    def one(c: Column) -> Column:
        n = normalize_topic(c)
        return F.when(n == "", None).when(n == q, 0).when(n.contains(q), 1).when(F.size(F.array_except(words, topic_tokens(n))) == 0, 2)

    return F.when(q == "", 0).otherwise(F.array_min(F.transform(candidates, one)))


def scope_score(scope: Column, title: Column, tags: Column) -> Column:
    """Least over the topics of the title's score and the tags' score plus 3."""
    best = lambda t: F.least(topic_match_score(t, F.array(title)), topic_match_score(t, tags) + 3)
    return F.array_min(F.transform(scope, best))


def in_scope(scope: Column, candidates: Column) -> Column:
    return (F.size(scope) == 0) | F.exists(scope, lambda t: topic_match_score(t, candidates).isNotNull())


def parse_scope(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), trim_ws), lambda t: t != "")


def dump_list(x: Column) -> Column:
    return F.to_json(F.coalesce(x, F.array().cast("array<string>")))


def load_list(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def collapse(x: Column) -> Column:
    return trim_ws(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_line(line: Column, noise: list[str] = BOILERPLATE) -> Column:
    flat = collapse(line)
    drop = flat.rlike(PAGE_MARK)
    for pattern in noise:
        drop = drop | flat.rlike(pattern)
    return F.when(drop, "").otherwise(flat)


def clean_lines(lines: Column, noise: list[str] = BOILERPLATE) -> Column:
    """Cleaned lines that are not empty, joined by line feeds."""
    return F.array_join(F.filter(F.transform(lines, lambda x: clean_line(x, noise)), lambda x: x != ""), "\n")


def clean_block(text: Column, noise: list[str] = BOILERPLATE) -> Column:
    return clean_lines(F.split(text, LINE_BREAKS), noise)


def slugify(x: Column) -> Column:
    slug = F.array_join(F.slice(F.regexp_extract_all(F.lower(x), F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 10), "_")
    return F.when(slug == "", "unit").otherwise(slug)


def truncate_words(x: Column, most: int) -> Column:
    s = trim_ws(x)
    clipped = trim_ws(F.regexp_replace(F.substring(s, 1, most), r" [^ ]*\z", ""))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(clipped, F.lit("...")))


def summary(x: Column) -> Column:
    flat = collapse(x)
    two = F.array_join(F.slice(F.split(flat, r"(?<=[.!?])\s+"), 1, 2), " ")
    return F.when(flat == "", "Auto-generated summary is unavailable.").otherwise(truncate_words(two, 360))


def pedagogical_role(title: Column, kind: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike(CAUTION), "caution").when(t.rlike(EXAMPLE), "example").when((kind == "chapter") & t.rlike(INTRODUCTORY), "prerequisite").otherwise("concept")


def topic_tags(title: Column, chapter: Column | None = None) -> Column:
    words = F.transform(F.regexp_extract_all(F.lower(title), F.lit("[A-Za-z0-9][A-Za-z0-9-]+"), F.lit(0)), lambda w: F.replace(w, F.lit("-"), F.lit("_")))
    fit = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS, *GENERIC_TAGS))
    slugs = F.array(slugify(title)) if chapter is None else F.array_compact(F.array(F.when(is_given(title), slugify(title)), F.when(is_given(chapter), slugify(chapter))))
    return F.slice(F.array_distinct(F.concat(slugs, fit)), 1, 6)


def is_heading(line: Column) -> Column:
    return line.rlike(r"^#{1,6}\s+(.+)$") | line.rlike(r"^[A-Z][A-Za-z0-9 ,:()/_-]{2,88}$")


def heading_title(line: Column) -> Column:
    return F.when(line.rlike(r"^#{1,6}\s+(.+)$"), F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1))).otherwise(line)


def embedding_text(title: Column, summary_: Column, body: Column, tags: Column, role: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Summary: "), summary_), F.concat(F.lit("Body: "), F.substring(body, 1, 3000)), F.concat(F.lit("Topic Tags: "), F.array_join(tags, ", ")), F.concat(F.lit("Pedagogical Role: "), role))


def _hashed(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[float] | None:
        if text is None:
            return None
        state, raw = hashlib.sha256(text.encode()), b""
        for i in range(DIMENSIONS):
            h = state.copy()
            h.update(i.to_bytes(2, "big"))
            raw += h.digest()[:4]
        v = np.frombuffer(raw, ">u4") / 2.0**32
        return (v / (np.linalg.norm(v) or 1.0)).tolist()

    return texts.map(one)


def embedding(text: Column, embed: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """The vector of each text by ``embed``, a function of one batch of texts (the hook for a real model); by
    default a unit vector of the first four bytes of SHA-256(text, index) for each index. That hash's state
    is shared by all indices, which built-in functions cannot do: ``plain_hash_embedding`` takes 40 ms a row,
    this 0.1."""
    f = embed or _hashed

    def vectors(texts: pd.Series) -> pd.Series:
        return f(texts)

    vectors.__annotations__ = {"texts": pd.Series, "return": pd.Series}  # not the names of types
    return F.pandas_udf(vectors, T.ArrayType(T.DoubleType()))(text)


def hash_embedding(text: Column) -> Column:
    return embedding(text)


def plain_hash_embedding(text: Column) -> Column:
    """The same vector in built-in functions."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(F.encode(text, "utf-8"), F.unhex(F.lpad(F.hex(i), 4, "0"))), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    v = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(DIMENSIONS - 1).cast("long")), part)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x))
    return F.when(text.isNotNull(), F.transform(v, lambda x: x / length))


def query_text(module: Column, week: Column, topics: Column, target: Column) -> Column:
    parts = F.array(F.coalesce(module, F.lit("")), F.coalesce(week, F.lit("")), F.array_join(topics, ", "), F.coalesce(target, F.lit("")))
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def severity(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 75, "high").when(score >= 65, "medium").otherwise("low")


def priority(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 70, "medium").otherwise("low")


def truncate_answer(x: Column, most: int = 300) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(rtrim_ws(F.substring(x, 1, most - 3)), F.lit("...")))


def extract_terms(lines: Column) -> Column:
    """First six terms of a slide's lines: four letters or more, first spelling wins."""
    tokens = F.split(F.replace(F.array_join(lines, " "), F.lit("/"), F.lit(" ")), r"(?U)\s+")
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[ ,.:;()]+|[ ,.:;()]+$", ""))
    fit = F.filter(bare, lambda t: (F.length(t) >= 4) & t.rlike(r"^[\p{L}\p{N}]"))
    new = lambda seen, t: F.when((F.size(seen) >= 6) | F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.concat(seen, F.array(t)))
    return F.slice(F.aggregate(fit, F.array().cast("array<string>"), new), 1, 6)
