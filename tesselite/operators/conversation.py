"""Roll-ups of conversations into facts: every n-th turn, the last messages, whole sessions, mirrored writes.

Messages are rows conv_id, turn, role, content. Defined results: NULL or blank contents and roles other
than user and assistant are left out of summaries; a user message without a following answer is no
turn; a conversation without a usable message gives no row; turns are counted per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselite.functions.tags import decode, encode

# fixed values: lengths, and the mark of a cut
TURN_CHARS, MESSAGE_CHARS, LAST_MESSAGES = 1200, 500, 10
CUT = "\n…(truncated)"


def messages_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """conv_id, turn, role, content of transcripts whose turns begin with `User:` or `Assistant:`."""
    marked = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(^|\n)(User|Assistant): ", "\u0001$2: ")
    parts = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("conv_id"), F.posexplode(F.split(marked, "\u0001")).alias("turn", "part"))
    parts = parts.where(F.col("part").rlike("^(User|Assistant): "))
    role = F.when(F.col("part").startswith("User: "), "user").otherwise("assistant")
    return parts.select("conv_id", "turn", role.alias("role"), F.regexp_replace(F.regexp_replace("part", "^(User|Assistant): ", ""), r"\s+$", "").alias("content"))


def session_tags(*names: str) -> Column:
    return encode(F.array(*[F.lit(n) for n in names], F.concat(F.lit("session:"), F.col("conv_id").cast("string"))))


def retained_turns(messages: DataFrame, every: int = 1, chars: int = TURN_CHARS) -> DataFrame:
    """conv_id, turn_no, text, category, tags of every `every`-th completed turn of a conversation."""
    if every < 1:
        raise ValueError("every must be at least 1")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("reply", F.lead("content").over(order)).withColumn("next_role", F.lead("role").over(order))
    turns = rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).withColumn("turn_no", F.row_number().over(order))
    text = F.concat(F.lit("User: "), F.substring(F.coalesce("content", F.lit("")), 1, chars), F.lit("\nAssistant: "), F.substring(F.coalesce("reply", F.lit("")), 1, chars))
    return turns.where(F.col("turn_no") % every == 0).select("conv_id", "turn_no", text.alias("text"), F.lit("conversation").alias("category"), session_tags("conversation").alias("tags"))


def _summary(messages: DataFrame, most: int) -> DataFrame:
    """The usable messages of each conversation in order, as far as `most` characters reach and the message that passes them.

    Running lengths cut a conversation before it is gathered, so one of any length costs a bounded row.
    """
    usable = messages.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("content", 1, MESSAGE_CHARS))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    lines = usable.select("conv_id", "turn", line.alias("line")).withColumn("_before", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "line")))
    return lines.where(F.col("_before") <= most).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def compression_summaries(messages: DataFrame) -> DataFrame:
    """conv_id, text, category, tags: the last messages of any role, of which the usable ones are kept."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= LAST_MESSAGES)
    return _summary(last, LAST_MESSAGES * (MESSAGE_CHARS + 20)).select("conv_id", "text", F.lit("compression").alias("category"), session_tags("compression").alias("tags"))


def session_summaries(messages: DataFrame, chars: int = TURN_CHARS) -> DataFrame:
    """conv_id, text, category, tags: all usable messages, cut at four turns' length, with a mark where cut."""
    most = max(4 * chars, 4000)
    text = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(CUT))).otherwise(F.col("text"))
    return _summary(messages, most + 1).select("conv_id", text.alias("text"), F.lit("conversation").alias("category"), session_tags("session-end", "conversation").alias("tags"))


def to_remember(facts: DataFrame) -> DataFrame:
    """text, category, tags as arrays, of facts with encoded tags."""
    return facts.select("text", "category", decode("tags").alias("tags"))


def mirrored_writes(writes: DataFrame) -> DataFrame:
    """The facts of memory writes (action, target, content and other columns): additions with a content."""
    kept = writes.where((F.col("action") == "add") & (F.coalesce("content", F.lit("")) != ""))
    return kept.withColumn("category", F.when(F.col("target") == "user", "user_pref").otherwise("general"))


def prefetch_text(hits: DataFrame, chars: int = 4000, title: str = "## memory") -> DataFrame:
    """context: the hits (rank, hit) in order under a title, cut at `chars`; no row without a hit."""
    joined = hits.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"]), "\n\n").alias("text"))
    cut = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit(CUT))).otherwise(F.col("text"))
    return joined.where(F.length("text") > 0).select(F.concat(F.lit(title + "\n"), cut).alias("context"))
