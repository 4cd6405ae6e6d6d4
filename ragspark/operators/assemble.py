"""Assembly of contexts, fused answers, session transcripts and final records.

Whatever is gathered into one record is bounded by construction: the agents of a question, the turns of
a session plan (five at most), or the k hits of a question.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.ranking import top_k
from ragspark.functions.sizing import broadcast_if_small, settled_broadcast
from ragspark.functions.text import excerpt, label_of, reading_time
from ragspark.lexicons import (
    AGENT_NAMES,
    AGENT_TYPES,
    DEBATE_PLANS,
    DEFAULT_PROFILE,
    PROFILES,
    UNKNOWN_AGENT_TYPE,
)

# Wording of the fallbacks.
NO_RESPONSE = "抱歉，暂时没有找到相关信息。"
NO_SYNTHESIS = "无法生成回答。"
EVIDENCE_TITLES = {"craft_expert": "\n【相关文档资料】", "history_expert": "\n【相关历史文献】",
                   "heritage_expert": "\n【相关文档资料】"}
NO_CONTEXT = {"craft_expert": "没有找到相关的技艺资料。", "history_expert": "没有找到相关的历史资料。",
              "heritage_expert": "没有找到相关的传承信息。"}


# ---- facts ----

def class_facts(keys: DataFrame, facts: DataFrame, key: str = "class") -> DataFrame:
    """Facts of each key; unknown keys keep null facts."""
    return keys.join(broadcast_if_small(facts), key, "left")


def timeline(keys: DataFrame, timelines: DataFrame, key: str = "class") -> DataFrame:
    """(…, pos, period, stage, description) in order; a key without timeline gives no row."""
    return keys.join(broadcast_if_small(timelines), key).select(
        *keys.columns, F.posexplode("events").alias("pos", "e")).select(
        *keys.columns, F.col("pos").cast("long").alias("pos"), "e.period", "e.stage", "e.description")


def level_rows(keys: DataFrame, status: DataFrame, key: str = "class") -> DataFrame:
    """(…, level, names): the entries of the level map as rows."""
    return keys.join(broadcast_if_small(status.select(key, "levels")), key).select(
        *keys.columns, F.explode("levels").alias("level", "names"))


def status_lookup(keys: DataFrame, status: DataFrame, key: str = "class", unknown: str = "未知") -> DataFrame:
    """Status with the default for unknown keys, and the learning paths (empty map when unknown)."""
    empty = F.create_map().cast("map<string,array<string>>")
    return keys.join(broadcast_if_small(status.select(key, "status", "paths")), key, "left").select(
        *keys.columns, F.coalesce("status", F.lit(unknown)).alias("status"), F.coalesce("paths", empty).alias("paths"))


def craft_block(name: Column, process: Column, materials: Column, tools: Column, feature: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("【"), name, F.lit("技艺基本信息】")),
        F.concat(F.lit("主要工艺流程："), F.array_join(process, " → ")),
        F.concat(F.lit("主要材料："), F.array_join(materials, ", ")),
        F.concat(F.lit("主要工具："), F.array_join(tools, ", ")),
        F.concat(F.lit("特点："), feature),
    )


def history_block(name: Column, origin: Column, events: Column, meaning: Column, people: Column) -> Column:
    lines = F.transform(events, lambda e: F.concat(
        F.lit("  • "), e["period"], F.lit("（"), e["stage"], F.lit("）："), e["description"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("【"), name, F.lit("历史沿革】")),
        F.concat(F.lit("起源："), origin),
        F.concat(F.lit("\n发展脉络：\n"), F.array_join(lines, "\n")),
        F.concat(F.lit("\n文化意义："), meaning),
        F.when(F.size(people) > 0, F.concat(F.lit("代表人物："), F.array_join(people, ", "))),
    )


def status_block(name: Column, protection: Column, status: Column, levels: Column, area: Column, measures: Column,
                 paths: Column, resources: Column) -> Column:
    level_lines = F.transform(F.map_entries(levels), lambda e: F.concat(
        F.lit("  • "), e["key"], F.lit("："), F.array_join(e["value"], ", ")))
    measure_lines = F.transform(measures, lambda m, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), m))
    path_lines = F.transform(F.map_entries(paths), lambda e: F.concat(
        F.lit("  • "), e["key"], F.lit("："), F.array_join(e["value"], ", ")))
    resource_lines = F.transform(resources, lambda r: F.concat(
        F.lit("  • "), r["name"], F.lit("（"), r["type"], F.lit("）- "), r["source"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("【"), name, F.lit("传承现状】")),
        F.concat(F.lit("保护等级："), protection),
        F.concat(F.lit("濒危程度："), status),
        F.concat(F.lit("\n传承人信息：\n"), F.array_join(level_lines, "\n")),
        F.concat(F.lit("\n分布区域："), area),
        F.concat(F.lit("\n保护措施：\n"), F.array_join(measure_lines, "\n")),
        F.concat(F.lit("\n学习途径：\n"), F.array_join(path_lines, "\n")),
        F.when(F.size(resources) > 0, F.concat(F.lit("\n【推荐学习资源】\n"), F.array_join(resource_lines, "\n"))),
    )


def context_block(asked: DataFrame, blocks: DataFrame, hits: DataFrame, docs: DataFrame, content: str = "content",
                  k: int = 3, chars: int = 300) -> DataFrame:
    """(query_id, category, context) for `asked` (query_id, category, entity).

    The fact block of (category, entity), then the k best documents cut to `chars`, numbered; a fixed
    sentence when there is neither. `hits` are (query_id, category, doc_id, rank).
    """
    best = settled_broadcast(hits.where(F.col("rank") <= k))
    texts = docs.select("doc_id", excerpt(F.col(content), chars, always=True).alias("_x")).join(best, "doc_id")
    line = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), "_x").alias("line"))
    evidence = texts.groupBy("query_id", "category").agg(F.sort_array(F.collect_list(line)).alias("_l"))
    titled = F.concat(label_of(F.col("category"), EVIDENCE_TITLES), F.lit("\n"), F.array_join(F.col("_l.line"), "\n"))
    return (
        asked.join(broadcast_if_small(blocks.select("category", "entity", "block")), ["category", "entity"], "left")
        .join(evidence, ["query_id", "category"], "left")
        .select(
            "query_id",
            "category",
            F.coalesce(
                F.nullif(F.concat_ws("\n", "block", F.when(F.col("_l").isNotNull(), titled)), F.lit("")),
                label_of(F.col("category"), NO_CONTEXT),
            ).alias("context"),
        )
    )


# ---- responses ----

def response_counts(responses: DataFrame) -> DataFrame:
    """(question_id, successes, total)."""
    return responses.groupBy("question_id").agg(
        F.count_if("success").alias("successes"), F.count(F.lit(1)).alias("total"))


def one_per_agent(responses: DataFrame, order: str = "ord") -> DataFrame:
    """The last response of each agent of a question; repeats are reduced map-side."""
    return responses.groupBy("question_id", "agent_name").agg(
        F.max_by("content", order).alias("content"), F.min(order).alias(order))


def fuse_responses(questions: DataFrame, responses: DataFrame, names: dict[str, str] = AGENT_NAMES,
                   order: str = "ord") -> DataFrame:
    """(question_id, fused): an apology without responses, `[name]\\n\\ntext` for a single one, else the
    responses of the listed agents in their fixed order."""
    single = one_per_agent(responses, order)
    texts = [F.max(F.when(F.col("agent_name") == a, F.col("content"))).alias(a) for a in names]
    grouped = single.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first("agent_name").alias("_agent"), F.first("content").alias("_text"), *texts)
    parts = [
        F.when(F.col(a).isNotNull(), F.concat(F.lit(f"[{shown}]\n\n"), F.col(a), F.lit("\n"))) for a, shown in names.items()
    ]
    alone = F.concat(F.lit("["), label_of(F.col("_agent"), names), F.lit("]\n\n"), F.col("_text"))
    return questions.select("question_id").join(grouped, "question_id", "left").select(
        "question_id",
        F.when(F.col("_n").isNull(), NO_RESPONSE).when(F.col("_n") == 1, alone).otherwise(F.concat_ws("\n", *parts)).alias("fused"),
    )


def annotate_sources(responses: DataFrame, names: dict[str, str] = AGENT_NAMES, types: dict[str, str] = AGENT_TYPES,
                     order: str = "ord") -> DataFrame:
    """(question_id, source_agents): per agent id, display name and type, in order of first response."""
    single = one_per_agent(responses, order)
    entry = F.struct(
        F.col(order).alias("ord"),
        F.col("agent_name").alias("id"),
        label_of(F.col("agent_name"), names).alias("name"),
        label_of(F.col("agent_name"), types, F.lit(UNKNOWN_AGENT_TYPE)).alias("type"),
    )
    listed = single.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("_a"))
    return listed.select("question_id", F.transform(
        "_a", lambda a: F.struct(a["id"].alias("id"), a["name"].alias("name"), a["type"].alias("type"))).alias("source_agents"))


# ---- debate sessions ----

def plan_turns(mode: Column, plans: dict = DEBATE_PLANS) -> Column:
    """The turns of a mode as an array of (seq, round_num, agent_name, role)."""
    def turns(rows) -> Column:
        return F.array(*[
            F.struct(F.lit(i).cast("long").alias("seq"), F.lit(r).cast("long").alias("round_num"),
                     F.lit(a).alias("agent_name"), F.lit(role).alias("role"))
            for i, (r, a, role) in enumerate(rows, 1)
        ])

    out = turns(plans["simple"])
    for name, rows in plans.items():
        if name != "simple":
            out = F.when(mode == name, turns(rows)).otherwise(out)
    return out


def debate_plan(questions: DataFrame, mode: str = "mode", plans: dict = DEBATE_PLANS) -> DataFrame:
    """A row per planned turn: (…, seq, round_num, agent_name, role). Unknown modes give the simple plan."""
    return questions.select("*", F.explode(plan_turns(F.col(mode), plans)).alias("_t")).select(*questions.columns, "_t.*")


def _turn(text: Column, names: dict[str, str]) -> Column:
    return F.concat(F.lit("【"), label_of(F.col("agent_name"), names), F.lit(" - "), F.col("role"), F.lit("】\n"), text, F.lit("\n"))


def debate_history(turns: DataFrame, names: dict[str, str] = AGENT_TYPES, cut: int | None = None) -> DataFrame:
    """Adds `history`: the earlier turns of the session, in order, as one text.

    Opening turns of a `parallel` session (round 1) see none. With `cut`, earlier turns are shortened to
    that many characters and always end in `...` (the cross-examination digest).
    """
    frame = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("content") if cut is None else excerpt(F.col("content"), cut, always=True)
    opening = (F.col("mode") == "parallel") & (F.col("round_num") == 1)
    seen = F.array_join(F.collect_list(_turn(text, names)).over(frame), "\n")
    return turns.withColumn("history", F.when(opening, "").otherwise(seen))


def session_text(turns: DataFrame, line: Column, sep: str, name: str) -> DataFrame:
    """One text per session from its turns in order; a session has the few turns of its plan."""
    gathered = turns.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("_l"))
    return gathered.select("session_id", F.array_join(F.col("_l.line"), sep).alias(name))


def synthesize(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, final_synthesis): all turns joined by a blank line, an apology for an empty session."""
    joined = session_text(turns, F.col("content"), "\n\n", "final_synthesis")
    return sessions.select("session_id").join(joined, "session_id", "left").withColumn(
        "final_synthesis", F.coalesce("final_synthesis", F.lit(NO_SYNTHESIS)))


def insight_digest(turns: DataFrame, chars: int = 300) -> DataFrame:
    """(session_id, digest): `agent(role): first characters...` per turn."""
    line = F.concat("agent_name", F.lit("("), "role", F.lit("): "), excerpt(F.col("content"), chars, always=True))
    return session_text(turns, line, "\n", "digest")


def sessions_nested(turns: DataFrame) -> DataFrame:
    """(session_id, rounds): the session as one nested record."""
    entry = F.struct("seq", "round_num", "agent_name", "role", "content", "references")
    return turns.groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("rounds"))


def history_citations(messages: DataFrame) -> DataFrame:
    """A row per citation of every assistant message: (conv_id, turn, pos, citation)."""
    return messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode("citations").alias("pos", "citation")).withColumn("pos", F.col("pos").cast("long"))


def history_insights(messages: DataFrame, k: int = 5) -> DataFrame:
    """The first k insights of every conversation, in message order."""
    rows = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode("insights").alias("pos", "insight"))
    first = top_k(rows, ["conv_id"], [F.asc("turn"), F.asc("pos")], k)
    return first.select("conv_id", F.col("rank").cast("long"), "insight")


# ---- profiles and the final record ----

def profile_table(spark, profiles: Sequence[tuple] = PROFILES) -> DataFrame:
    rows = [(i, n, d, depth, (lo, hi), list(focus)) for i, n, d, depth, lo, hi, focus in profiles]
    return spark.createDataFrame(
        rows, "id string, name string, description string, depth string, "
              "length_range struct<min:int,max:int>, focus array<string>")


def adapt_profile(answers: DataFrame, profiles: DataFrame, column: str = "user_profile", text: str = "content",
                  default: str = DEFAULT_PROFILE) -> DataFrame:
    """Adds profile_name, depth, length_range, focus and length_ok; an unknown profile takes the default."""
    fields = F.struct(F.col("name").alias("profile_name"), "depth", "length_range", "focus")
    fallback = profiles.where(F.col("id") == default).agg(F.first(fields)).scalar()
    dim = profiles.select(F.col("id").alias(column), fields.alias("_own"))
    found = answers.join(broadcast_if_small(dim), column, "left").withColumn("_p", F.coalesce("_own", fallback))
    return found.select(*answers.columns, "_p.*").withColumn(
        "length_ok", F.length(text).between(F.col("length_range.min"), F.col("length_range.max")))


def finalize(answers: DataFrame, text: str = "content", report: str = "report") -> DataFrame:
    """The answer, a blank line and the report if there is one, with its reading time."""
    final = F.concat_ws("\n\n", text, F.nullif(F.col(report), F.lit("")))
    return answers.withColumn("answer", final).withColumn("reading_time", reading_time(F.col("answer")))
