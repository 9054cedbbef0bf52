"""Conversations, short- and long-term memory, profiles and personality as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped
from .retrieval import cosine


def latest(df: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key: an upsert over an append-only log."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in ties])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_n(messages: DataFrame, n: int, by: str = "session_id", at: str = "turn") -> DataFrame:
    """The last n messages of each session, numbered from the oldest."""
    newest = Window.partitionBy(by).orderBy(F.col(at).desc())
    kept = messages.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(at)))


def long_term(memories: DataFrame, queries: DataFrame, k: int = 5, window: int = 100, space: str | None = None, by_user: bool = False) -> DataFrame:
    """(query_id, memory_id, score, rank): cosine times importance over the newest `window` memories of the same space and size.

    Without by_user the window is over everyone's memories, as one short list; with it, over each user's own."""
    m = memories if space is None else memories.where(F.col("embedding_space_id") == space)
    if by_user:
        w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("memory_id").desc())
        m = m.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= window).drop("_nth")
    else:
        m = m.orderBy(F.col("timestamp").desc(), F.col("memory_id").desc()).limit(window)
    q = queries.select("query_id", F.col("embedding").alias("qv"), *(["user_id"] if by_user else []))
    both = (m.join(q, "user_id") if by_user else q.crossJoin(F.broadcast(m))).where(F.size("qv") == F.size("embedding"))
    scored = both.withColumn("score", cosine(F.col("qv"), F.col("embedding")) * F.col("importance"))
    r = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "memory_id")
    return scored.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= k).select("query_id", "memory_id", "score", "rank")


def stored_interactions(turns: DataFrame, by: str = "session_id", at: str = "turn", every: int = 2) -> DataFrame:
    """Every second interaction of a session goes to long-term memory."""
    w = Window.partitionBy(by).orderBy(at)
    return turns.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") % every == 0).drop("_nth")


def conversation_list(messages: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Conversations by last update, newest first."""
    got = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("updated_at"), F.min_by("text", "turn").alias("title"))
    return got.orderBy(F.col("updated_at").desc(), "conv_id").offset(offset).limit(limit)


def conversation_search(messages: DataFrame, word: str) -> DataFrame:
    """Distinct conversations with a message that holds the word; letters' case is ignored, wildcards are literal."""
    return messages.where(F.contains(F.lower("text"), F.lit(word.lower()))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("turn").alias("first_turn"))


def without(messages: DataFrame, gone: DataFrame, key: str = "conv_id") -> DataFrame:
    """Messages of conversations that were not deleted: deletion cascades."""
    return messages.join(gone.select(key).distinct(), key, "left_anti")


def profile(messages: DataFrame, by: str = "session_id", at: str = "turn", text: str = "text") -> DataFrame:
    """Name and role said in the text; the first mention stands."""
    found = lambda p: F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit(""))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col(at).alias("at"), c.alias("v"))))["v"]
    return messages.groupBy(by).agg(first(found(r"叫([^，。\s]+)")).alias("name"), first(found(r"是([^，。\s]+)")).alias("role"))


#: The texts that thresholds of a personality switch on.
STYLE = [
    ("warmth > 70", "语气热情友好，多使用亲切的表达，可以适当加入表情符号，不用太严肃。"),
    ("warmth < 30", "保持简洁直接，不过分热情，专注于回答问题，不用多余的寒暄。"),
    ("expertise > 80", "回答要专业深入，可以包含技术术语和详细解释，适合有一定专业基础的用户。"),
    ("expertise < 40", "用通俗易懂的语言解释，避免专业术语，把复杂问题讲简单，适合新手。"),
    ("humor > 60", "适当加入幽默元素，用轻松的语气回答，比如加入简单的调侃、生活化的比喻。"),
    ("empathy > 70", "多关注用户的情绪，表达理解和共情，比如用户说难，就安慰鼓励，不要只讲知识点。"),
]
NEUTRAL = "保持自然专业的语气，贴合用户的专业背景，回答准确、实用。"


def style_instructions() -> Column:
    said = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(text)) for rule, text in STYLE]))
    return F.when(F.size(said) == 0, F.lit(NEUTRAL)).otherwise(F.array_join(said, "\n"))


def adjusted(personality: DataFrame, changes: DataFrame, keys: str = "user_id") -> DataFrame:
    """Traits after their changes, kept within 0 and 100. changes: user_id, trait, delta."""
    sums = changes.groupBy(keys).pivot("trait", ["warmth", "expertise", "humor", "empathy"]).sum("delta")
    both = personality.alias("p").join(sums.alias("s"), keys, "left")
    return both.select(keys, *[clamped(F.col(f"p.{t}") + F.coalesce(F.col(f"s.{t}"), F.lit(0))).alias(t) for t in ("warmth", "expertise", "humor", "empathy")])
