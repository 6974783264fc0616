"""Stored conversations and sessions: creation, ordinal ids, views with tool calls, similar ones, context for an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import deterministic_uuid
from weftgraph.operators.retrieval import history_hits, rag_score
from weftgraph.operators.segments import running_sums
from weftgraph.operators.turns import last_n, within_budget
from weftgraph.semantics import cosine


def create_conversations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations with new ones added as active; a known id is not added again."""
    fresh = new.join(stored.select("conversation_id"), "conversation_id", "left_anti").withColumn("status", F.lit("active"))
    return stored.unionByName(fresh, allowMissingColumns=True)


def set_status(conversations: DataFrame, ids: DataFrame, status: str, now: Column | None = None) -> DataFrame:
    """The given conversations get the status, and ``updated_at`` where the table has it; unknown ids do nothing."""
    hit = ids.select(F.col("conversation_id").alias("_i")).distinct().withColumn("_hit", F.lit(True))
    j = conversations.join(hit, F.col("conversation_id") == F.col("_i"), "left")
    new = {"status": F.lit(status), "updated_at": now if now is not None else F.current_timestamp()}
    return j.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in conversations.columns))


def find_conversations(conversations: DataFrame, tags: Sequence[str] = (), status: str | None = None, limit: int | None = None) -> DataFrame:
    """Conversations with any of the tags and the status, latest update first (ties by id)."""
    df = conversations
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if status is not None:
        df = df.where(F.col("status") == status)
    return df if limit is None else df.orderBy(F.col("updated_at").desc_nulls_last(), "conversation_id").limit(limit)


def message_ids(messages: DataFrame, place: str = "place", key: str = "conversation_id") -> DataFrame:
    """Messages with ``ordinal`` (from 0 within the conversation) and an ``id`` made of conversation and ordinal."""
    got = running_sums(messages, [key], [place], {"_n": F.lit(1)}).withColumn("ordinal", F.col("_n") - 1).drop("_n")
    return got.withColumn("id", deterministic_uuid(F.concat_ws(":", F.col(key), F.col("ordinal").cast("string"))))


def messages_with_tools(messages: DataFrame, calls: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Messages with ``tools``, the list of their calls in order of ``call_id``, each with its result's ``output`` if there
    is one; empty where there is no call. ``calls(uuid, call_id, tool_name)``, ``results(call_id, output)``."""
    c = calls.where("call_id is not null")
    if results is not None:
        one = results.groupBy("call_id").agg(F.max("output").alias("output"))
        c = c.join(one, "call_id", "left")
    else:
        c = c.withColumn("output", F.lit(None).cast("string"))
    lists = c.groupBy(F.col("uuid").alias("_u")).agg(F.array_sort(F.collect_list(F.struct("call_id", "tool_name", "output"))).alias("tools"))
    j = messages.join(lists, F.col("uuid") == F.col("_u"), "left").drop("_u")
    empty = F.array().cast(dict((f.name, f.dataType) for f in j.schema.fields)["tools"])
    return j.withColumn("tools", F.coalesce("tools", empty))


def session_view(sessions: DataFrame, messages: DataFrame, calls: DataFrame, session: str = "conversation_id") -> DataFrame:
    """``session, n_messages, n_calls, first_ts, last_ts, tool_names`` of every session, also of those without messages."""
    m = messages.groupBy(session).agg(F.count(F.lit(1)).alias("n_messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    c = calls.join(messages.select("uuid", session), "uuid").groupBy(session).agg(F.count(F.lit(1)).alias("n_calls"), F.array_sort(F.collect_set("tool_name")).alias("tool_names"))
    j = sessions.select(session).distinct().join(m, session, "left").join(c, session, "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return j.select(session, zero("n_messages"), zero("n_calls"), "first_ts", "last_ts", F.coalesce("tool_names", F.array().cast("array<string>")).alias("tool_names"))


def sessions_of(sessions: DataFrame, domain: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions of a domain, latest first (ties by id)."""
    df = sessions if domain is None else sessions.where(F.col("domain") == domain)
    return df if limit is None else df.orderBy(F.col("updated_at").desc_nulls_last(), "session_id").limit(limit)


def similar_conversations(summaries: DataFrame, query: Column, minimum: float = 0.0, limit: int | None = 10) -> DataFrame:
    """``conversation_id, score``: the best score over a conversation's summaries (``conversation_id, vec``), above the minimum."""
    s = summaries.where("vec is not null").select("conversation_id", cosine(F.col("vec"), query).alias("score")).where(F.col("score") > minimum)
    best = s.groupBy("conversation_id").agg(F.max("score").alias("score"))
    return best if limit is None else best.orderBy(F.col("score").desc(), "conversation_id").limit(limit)


def similar_messages(messages: DataFrame, conversation: str, query: Column, minimum: float = 0.0, limit: int | None = 10) -> DataFrame:
    """``uuid, score`` of a conversation's messages (``uuid, vec``) above the minimum, best first (ties by uuid)."""
    m = messages.where((F.col("conversation_id") == conversation) & F.col("vec").isNotNull())
    s = m.select("uuid", cosine(F.col("vec"), query).alias("score")).where(F.col("score") > minimum)
    return s if limit is None else s.orderBy(F.col("score").desc(), "uuid").limit(limit)


def summary_sizes(summaries: DataFrame) -> DataFrame:
    """``conversation_id, level, n, chars, start_turn, end_turn``: summaries, their characters and the turns they cover."""
    return summaries.groupBy("conversation_id", "level").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.min("start_turn").alias("start_turn"), F.max("end_turn").alias("end_turn")
    )


def ranked_history(turns: DataFrame, summaries: DataFrame, needle: str, limit: int | None = 20) -> DataFrame:
    """``id, level, score``: turns and summaries of both levels that contain a text, best first (ties by id)."""
    hits = history_hits(turns, summaries, needle)
    return hits if limit is None else hits.orderBy(F.col("score").desc(), "id").limit(limit)


def enriched_context(
    messages: DataFrame, summaries: DataFrame, code: DataFrame, conversation: str, query: Column, *, max_context: int = 100_000, recent_limit: int | None = None,
    results: int = 20, minimum: float = 0.3, code_chars: int | None = None,
) -> dict[str, DataFrame]:
    """What an answer in a conversation may draw on, each part a table:

    ``queries``: its newest user messages, and ``recent``: its newest messages, within a twentieth of the context each;
    ``history``: messages and summaries of any conversation by similarity, weighed by level; ``code``: the most similar
    code within a tenth of the context; ``open``: its first-level summaries that no second-level one covers.
    ``messages(uuid, conversation_id, role, place, chars, vec, ts)``, ``summaries(id, conversation_id, level, covered, vec,
    ts)``, ``code(id, vec, chars)``.
    """
    own = messages.where(F.col("conversation_id") == conversation)
    share = max_context // 20
    recent = within_budget(own, "chars", share)
    if recent_limit is not None:
        recent = last_n(recent.drop("running"), recent_limit).drop("position")
    said = messages.select(F.col("uuid").alias("id"), F.lit(0).alias("level"), "vec", "ts").unionByName(summaries.select("id", "level", "vec", "ts"))
    scored = said.where("vec is not null").withColumn("score", cosine(F.col("vec"), query))
    history = rag_score(scored, minimum, {0: 1.0, 1: 0.7, 2: 0.5}).select("id", "level", "score").orderBy(F.col("score").desc(), "id").limit(results)
    best = code.where("vec is not null").withColumn("score", cosine(F.col("vec"), query)).where(F.col("score") >= minimum)
    best = best.withColumn("_place", F.struct("score", "id")).withColumn("_all", F.lit(1))
    fits = within_budget(best, "chars", code_chars if code_chars is not None else max_context // 10, key="_all", place="_place")
    return {
        "queries": within_budget(own.where("role = 'user'"), "chars", share).select("uuid", "place"),
        "recent": recent.select("uuid", "place"),
        "history": history,
        "code": fits.select("id", "score", "chars"),
        "open": summaries.where((F.col("conversation_id") == conversation) & (F.col("level") == 1) & ~F.coalesce("covered", F.lit(False))).select("id"),
    }
