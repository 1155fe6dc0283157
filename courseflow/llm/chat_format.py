"""Chat formatting by prefix-target expansion, in built-in functions only.

A conversation becomes one stream of turns, ``<|turn|>role<|text|>text<|end|>``. Every assistant turn is
exploded into an example of its own (``chat_examples``), written out as a string: all turns before it are
context, only its text is trainable. A conversation that does not end with a reply has a closing example, its
whole stream without trainable text, so that no turn is left out. All that the digest says is read back from
these strings. Their size grows with the square of a conversation's turns, as the method has it; no row is
larger than its conversation, and examples are made one after the other, never all of a conversation at once.
``chat_turns`` is the stream itself, each turn once with its place.

Control strings inside roles and texts are escaped with a backslash after their first character,
backslashes are doubled; ``unescape`` undoes both.

Defined cases: null role or text counts as empty; equal turn numbers are ordered by role, then text; a
null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table gives no rows;
further columns are ignored. The digest needs all text of one conversation in one row, as its SHA-256 does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from courseflow.llm.shared import scratch

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What starts a control string in common chat templates.
_CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, piece, start, example): one row a turn; ``start`` is the piece's place in the
    stream; ``example`` is null unless the turn is a reply, else its number, its context's length and
    the span of its trainable text in the stream."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), F.concat(head, escape(text), F.lit(END)).alias("piece"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reply = F.col("role") == "assistant"
    placed = rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "piece", before.cast("long").alias("start"), F.length("head").alias("skip"), reply.alias("reply"), F.sum(reply.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("number"))
    example = F.struct("number", F.col("start").alias("context_chars"), (F.col("start") + F.col("skip")).alias("target_start"), (F.col("start") + F.length("piece") - len(END)).alias("target_end"))
    return placed.select("conv_id", "pos", "piece", "start", F.when(F.col("reply"), example).alias("example"))


def chat_turns(segments: DataFrame) -> DataFrame:
    """(conv_id, pos, piece, start): the stream, one row a turn."""
    return segments.select("conv_id", "pos", "piece", "start")


def chat_examples(segments: DataFrame) -> DataFrame:
    """(conv_id, number, pos, context_chars, target_start, target_end, whole, text): one row an assistant turn, ``text`` being all
    turns up to it; ``whole`` tells that these are all turns. A closing example has no number and no target."""
    turn = F.struct("pos", "piece", "start", "example")
    full = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    full = full.select("conv_id", F.transform("turns", lambda t: t["piece"]).alias("pieces"), F.filter("turns", lambda t: t["example"].isNotNull() | (t["pos"] == F.size("turns") - 1)).alias("ends"))
    # Texts are made after the explode: an array of them would hold all examples of a conversation at once.
    place = F.transform("ends", lambda t: F.struct(t["pos"].alias("pos"), F.coalesce(t["example"]["context_chars"], t["start"]).alias("context_chars"), *[t["example"][c].alias(c) for c in ("number", "target_start", "target_end")]))
    rows = full.select("conv_id", "pieces", F.explode(place).alias("e"))
    text = F.array_join(F.slice("pieces", F.lit(1), (F.col("e.pos") + 1).cast("int")), "")
    return rows.select("conv_id", "e.number", "e.pos", "e.context_chars", "e.target_start", "e.target_end", (F.col("e.pos") == F.size("pieces") - 1).alias("whole"), text.alias("text"))


def written(examples: DataFrame) -> DataFrame:
    """``examples``, written as JSON lines and read back: a row at a time, since Parquet's reader would hold 4,096
    strings at once. gzip finds most of what an example repeats of the one before it."""
    path = scratch(examples.sparkSession, "chat-examples")
    examples.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)
    return examples.sparkSession.read.schema(examples.schema).option("mode", "FAILFAST").json(path)


def _prefixes(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """``examples`` with ``said``, the turns up to each one's place, from the stream, and ``begins``, where its last turn does."""
    full = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "start"))).alias("turns"))
    joined = examples.alias("s").join(full.alias("f"), F.expr("s.conv_id <=> f.conv_id"))
    said = F.array_join(F.transform(F.slice("turns", F.lit(1), (F.col("pos") + 1).cast("int")), lambda t: t["piece"]), "")
    return joined.select("s.*", said.alias("said"), F.get("turns", F.col("pos").cast("int"))["start"].alias("begins"))


def expanded(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, number, text, target_start, target_end): each example that has a target, its string made from the stream."""
    return _prefixes(turns, examples.where("number is not null")).select("conv_id", "number", F.col("said").alias("text"), "target_start", "target_end")


def role_and_text(turn: Column) -> tuple[Column, Column]:
    """What a formatted turn, without its end, says."""
    inner = F.substring(turn, F.lit(len(TURN) + 1), F.length(turn))
    role = F.substring_index(inner, TEXT, 1)
    return unescape(role), unescape(F.substring(inner, F.length(role) + len(TEXT) + 1, F.length(inner)))


def example_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, the digest columns of what the examples say: roles and texts from the one that holds all turns, the
    trainable texts from each one's own target span."""
    target = unescape(F.substring("text", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")))
    said = F.when(F.col("whole"), F.col("text"))
    rows = examples.select("conv_id", said.alias("stream"), F.when(F.col("number").isNotNull(), F.struct("number", target.alias("target"))).alias("e"))
    rows = rows.groupBy("conv_id").agg(F.collect_list("stream")[0].alias("stream"), F.array_sort(F.collect_list("e")).alias("examples"))
    pieces = F.split("stream", END.replace("|", r"\|"))  # an end in what was said is escaped
    rows = rows.select("conv_id", F.length("stream").cast("long").alias("formatted_chars"), F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("turns"), "examples")
    said = F.array_join(F.flatten(F.transform("turns", lambda t: F.transform(F.array(F.struct(*[x.alias(n) for x, n in zip(role_and_text(t), ("role", "text"))])), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))), "")
    loss = F.array_join(F.transform("examples", lambda e: e["target"]), "")
    done = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), "formatted_chars", F.size("examples").cast("long").alias("n_examples"))
    return done.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def chat_digest(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """``example_digest`` and ``contexts_fit``: whether each example's string is the stream up to its turn, and its context all before that."""
    fit = (F.col("text") == F.col("said")) & (F.col("context_chars") == F.col("begins"))
    fits = _prefixes(turns, examples).groupBy("conv_id").agg(F.bool_and(fit).alias("contexts_fit"))
    return example_digest(examples).alias("d").join(fits.alias("f"), F.expr("d.conv_id <=> f.conv_id"), "left").select("d.*", "contexts_fit")
