"""Classification, coverage, assembly and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions.text import extract_references, label_of
from ragspark.lexicons import COVERAGE_LABELS, DEBATE_PLANS
from ragspark.operators import assemble as A
from ragspark.operators import classify as C
from ragspark.operators import coverage as V
from ragspark.plans import answers as plans
from ragspark.plans.retrieval import retrieve, routed_retrieve
from workload import bindings as B
from workload import params as P
from workload import retrieval as R
from workload.texts import CATS, NAMES, NL


def _routed(spark, sf):
    return C.route(B.user_turns(spark, sf), routes=P.ROUTES)


def question_route(spark, sf):
    return _routed(spark, sf).select("query_id", "intent_analysis", F.array_join("required_experts", "|").alias("experts"), "reasoning", "complexity")


def entity_identify(spark, sf):
    """Entities supplied with the question are its words."""
    name = C.identify_entity(F.col("question"), P.ENTITIES, F.split("question", r"\s+"))
    return B.user_turns(spark, sf).select("query_id", F.coalesce(name, F.lit("-")).alias("entity"))


def entity_in_answer(spark, sf):
    """A user turn together with the turn that follows it."""
    turns = B.table(spark, sf, "conversations")
    follow = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = turns.where("role = 'user'").join(follow, ["conv_id", "turn"], "left")
    name = C.identify_entity(F.col("text"), P.ENTITIES, extra=F.col("answer"))
    return rows.select("conv_id", "turn", F.coalesce(name, F.lit("-")).alias("entity"))


def debate_mode(spark, sf):
    mode = C.debate_mode(F.col("question"), F.col("required_experts"), F.col("complexity"), P.ENTITIES, P.DEBATE)
    return _routed(spark, sf).select("query_id", mode.alias("mode"))


def narrative_flag(spark, sf):
    flag = C.narrative_flag(F.col("question"), F.col("query_id") % 7 == 0, P.NARRATIVE)
    return B.user_turns(spark, sf).select("query_id", flag.alias("narrative"))


# ---- coverage ----

def _hits(spark, sf):
    return retrieve(B.questions(spark, sf), B.tagged_documents(spark, sf), threshold=0.6, stopwords=P.STOP)


def _covered(spark, sf):
    return V.coverage(B.questions(spark, sf), _hits(spark, sf))


def coverage_rule(spark, sf):
    gaps = F.array_join(F.transform("identified_gaps", lambda g: F.concat_ws("/", g["aspect"], g["description"], g["suggestion"])), "|")
    return _covered(spark, sf).select("query_id", "coverage_level", "relevant_documents", "coverage_score", "can_answer", "confidence", "reasoning", gaps.alias("gaps"))


def gap_report(spark, sf):
    return V.with_report(_covered(spark, sf)).select("query_id", "report")


def _stored_confidence():
    return F.when(F.col("query_id") % 2 == 0, 0.5).otherwise(F.col("confidence"))


def retry_flag(spark, sf):
    return _covered(spark, sf).select("query_id", V.retry_flag(F.col("coverage_level"), _stored_confidence()).alias("retry"))


def followup_queries(spark, sf):
    asked = F.explode(V.followup_queries(F.col("question"), F.col("identified_gaps"))).alias("followup")
    return _covered(spark, sf).select("query_id", asked)


def gap_batch(spark, sf):
    out = plans.gap_batch(B.questions(spark, sf), B.tagged_documents(spark, sf), threshold=0.6, stopwords=P.STOP)
    return out.select("query_id", "coverage_level", "relevant_documents", "report", F.array_join("suggestions", "|").alias("suggestions"))


def evidence_digest(spark, sf):
    return V.evidence_digest(B.questions(spark, sf), _hits(spark, sf), B.documents(spark, sf))


def coverage_replies(spark, sf):
    """Stored coverage replies per question: fenced with a gap, without fields, or malformed."""
    reply = (
        F.when(F.col("query_id") % 3 == 0, F.lit('```json\n{"coverage_level": "partial", "coverage_score": 0.4, "identified_gaps": [{"aspect": "a", "description": "d", "suggestion": "s"}], "can_answer": false, "confidence": 0.2, "reasoning": "r"}\n```'))
        .when(F.col("query_id") % 3 == 1, F.lit("{}")).otherwise(F.lit("{broken")))
    out = V.coverage_from_replies(B.questions(spark, sf).withColumn("reply", reply), _hits(spark, sf))
    return out.select("query_id", "coverage_level", "relevant_documents", "coverage_score", "can_answer", "confidence", "reasoning",
                      F.array_join(F.transform("identified_gaps", lambda g: g["suggestion"]), "|").alias("gaps"))


# ---- facts ----

def _keys(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("class"))


def _facts(spark):
    return spark.createDataFrame(P.FACTS, "class string, process array<string>, materials array<string>, tools array<string>, feature string")


def class_facts(spark, sf):
    out = A.class_facts(_keys(spark, sf), _facts(spark))
    return out.select("doc_id", "class", *[F.coalesce(F.array_join(c, "|"), F.lit("-")).alias(c) for c in ("process", "materials", "tools")], F.coalesce("feature", F.lit("-")).alias("feature"))


def _timelines(spark):
    return spark.createDataFrame(P.TIMELINES, "class string, events array<struct<period:string,stage:string,description:string>>")


def timeline(spark, sf):
    return A.timeline(_keys(spark, sf), _timelines(spark))


def _status(spark):
    return spark.createDataFrame(P.STATUS, "class string, status string, levels map<string,array<string>>, paths map<string,array<string>>")


def level_rows(spark, sf):
    return A.level_rows(_keys(spark, sf), _status(spark)).select("doc_id", "class", "level", F.array_join("names", "|").alias("names"))


def status_lookup(spark, sf):
    paths = F.array_join(F.array_sort(F.transform(F.map_entries("paths"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";")
    return A.status_lookup(_keys(spark, sf), _status(spark)).select("doc_id", "class", "status", paths.alias("paths"))


def context_block(spark, sf):
    """Facts (crafts, history, status) of the language an entity belongs to, and the routed hits, per question and category."""
    routes = R.routed(spark, sf)
    asked = routes.select("query_id", F.explode("required_experts").alias("category"), C.identify_entity(F.col("question"), P.ENTITIES).alias("entity"))
    names = spark.createDataFrame([("that", "en"), ("with", "en"), ("nicht", "de"), ("pour", "fr")], "entity string, class string")
    facts = names.join(_facts(spark), "class")
    name = F.col("entity")
    craft = facts.select(F.lit("craft_expert").alias("category"), "entity", A.craft_block(
        name, F.col("process"), F.col("materials"), F.col("tools"), F.col("feature")).alias("block"))
    history = facts.join(_timelines(spark), "class").select(F.lit("history_expert").alias("category"), "entity", A.history_block(
        name, F.col("events")[0]["period"], F.col("events"), F.col("feature"), F.filter("tools", lambda t: F.col("class") == "fr")).alias("block"))
    found = F.transform("tools", lambda t: F.struct(t.alias("name"), F.lit("tool").alias("type"), F.col("class").alias("source")))
    status = facts.join(_status(spark), "class").select(F.lit("heritage_expert").alias("category"), "entity", A.status_block(
        name, F.col("feature"), F.col("status"), F.col("levels"), F.col("class"), F.col("process"), F.col("paths"),
        F.filter(found, lambda r: r["source"] == "en")).alias("block"))
    blocks = craft.unionByName(history).unionByName(status)
    hits = routed_retrieve(routes, R.category_docs(spark, sf), threshold=0.3, stopwords=P.STOP)
    return A.context_block(asked, blocks, hits, B.documents(spark, sf))


# ---- responses ----

def _conversations(spark, sf):
    return B.table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id")).distinct()


def _answered(spark, sf):
    from ragspark.operators.filters import usable_responses

    return usable_responses(B.responses(spark, sf))


def response_counts(spark, sf):
    return A.response_counts(B.responses(spark, sf))


def response_fusion(spark, sf):
    return A.fuse_responses(_conversations(spark, sf), _answered(spark, sf))


def source_annotations(spark, sf):
    out = A.annotate_sources(B.responses(spark, sf))
    shown = F.transform("source_agents", lambda a: F.concat_ws("/", a["id"], a["name"], a["type"]))
    return out.select("question_id", F.array_join(shown, "|").alias("sources"))


# ---- sessions ----

def debate_plan(spark, sf):
    return A.debate_plan(B.sessions(spark, sf))


def _said(spark, sf):
    planned = A.debate_plan(B.sessions(spark, sf))
    return planned.join(B.session_turns(spark, sf).select("session_id", "seq", "content"), ["session_id", "seq"]).withColumn(
        "references", extract_references(F.col("content"), P.REFERENCE_PATTERNS))


def debate_history(spark, sf):
    return A.debate_history(_said(spark, sf)).select("session_id", "seq", "history")


def cross_digest(spark, sf):
    return A.debate_history(_said(spark, sf), cut=500).select("session_id", "seq", "history")


def session_synthesis(spark, sf):
    return A.synthesize(B.sessions(spark, sf), _said(spark, sf))


def insight_digest(spark, sf):
    return A.insight_digest(_said(spark, sf))


def _round_text():
    return F.array_join(F.transform("rounds", lambda r: F.concat_ws(
        "/", r["seq"].cast("string"), r["round_num"].cast("string"), r["agent_name"], r["role"], F.length(r["content"]).cast("string"), F.array_join(r["references"], "+"))), "|").alias("rounds")


def session_nested(spark, sf):
    return A.sessions_nested(_said(spark, sf)).select("session_id", _round_text())


def full_session(spark, sf):
    out = plans.full_session(B.sessions(spark, sf), B.session_turns(spark, sf), P.REFERENCE_PATTERNS)
    return out.select("session_id", "mode", _round_text(), "digest", "final_synthesis")


def _messages(spark, sf):
    sentences = F.array_remove(F.split("text", r"\.\s*"), "")
    return B.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", extract_references(F.col("text"), P.REFERENCE_PATTERNS).alias("citations"), sentences.alias("insights"))


def history_citations(spark, sf):
    return A.history_citations(_messages(spark, sf))


def history_insights(spark, sf):
    return A.history_insights(_messages(spark, sf))


# ---- profiles and final record ----

def _profiled(spark, sf):
    """Conversation turns as answers; the reader's profile comes from the role, `system` being unknown."""
    profile = F.when(F.col("role") == "user", "learner").when(F.col("role") == "assistant", "researcher").otherwise("expert")
    return B.table(spark, sf, "conversations").select("conv_id", "turn", profile.alias("user_profile"), F.col("text").alias("content"))


def profile_adapt(spark, sf):
    out = A.adapt_profile(_profiled(spark, sf), A.profile_table(spark))
    return out.select("conv_id", "turn", "user_profile", "profile_name", "depth", F.col("length_range.min").cast("long").alias("low"),
                      F.array_join("focus", "|").alias("focus"), "length_ok")


def final_response(spark, sf):
    """Per question: its text as the answer, and its gap report."""
    covered = V.with_report(_covered(spark, sf))
    out = A.finalize(covered.withColumn("content", F.col("question")))
    return out.select("query_id", "answer", "reading_time", (~F.col("can_answer")).alias("has_gaps"))


def coverage_labels(spark, sf):
    return _covered(spark, sf).select("query_id", label_of(F.col("coverage_level"), COVERAGE_LABELS).alias("label"))


QUERIES = {f.__name__: f for f in (
    question_route, entity_identify, entity_in_answer, debate_mode, narrative_flag, coverage_rule, gap_report, retry_flag, followup_queries,
    gap_batch, evidence_digest, coverage_replies, class_facts, timeline, level_rows, status_lookup, context_block, response_counts,
    response_fusion, source_annotations, debate_plan, debate_history, cross_digest, session_synthesis, insight_digest, session_nested,
    full_session, history_citations, history_insights, profile_adapt, final_response, coverage_labels)}

ENT = "CASE " + " ".join(f"WHEN contains({{0}}, {P.text(e)}) THEN {P.text(e)}" for e in P.ENTITIES) + " ELSE '-' END"
ENT2 = "CASE " + " ".join(f"WHEN contains(a.text, {P.text(e)}) OR coalesce(contains(b.text, {P.text(e)}), false) THEN {P.text(e)}" for e in P.ENTITIES) + " ELSE '-' END"
HITS = B.KEYWORD + """,
hr AS (SELECT query_id, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM kw_hits WHERE similarity >= 0.6) WHERE rank <= 5),
cv AS (SELECT query_id, question, n, CASE WHEN n >= 3 THEN 'sufficient' WHEN n >= 1 THEN 'partial' ELSE 'missing' END AS level
  FROM (SELECT q.query_id, q.question, count(h.doc_id) AS n FROM qs q LEFT JOIN hr h USING (query_id) GROUP BY ALL)),
gp AS (SELECT *, CASE level WHEN 'sufficient' THEN [] WHEN 'partial' THEN ['详细信息', '仅找到' || n || '条相关文档，可能不够全面', '建议补充更多相关文献和资料']
  ELSE ['全部内容', '知识库中未找到相关信息', '需要收集该领域的系统资料'] END AS gap FROM cv)"""
REPORT = f"""CASE WHEN level = 'sufficient' THEN '' ELSE '⚠️ 知识缺口提示' || {NL} || {NL} || '针对您的问题「' || question || '」，当前知识库覆盖情况：' || {NL} || {NL}
  || '覆盖程度：' || CASE level WHEN 'partial' THEN '⚠️ 部分覆盖' ELSE '❌ 缺失' END || {NL} || '相关文档：' || n || '条' || {NL} || {NL} || '识别到的知识缺口：' || {NL} || {NL}
  || '1. ' || gap[1] || {NL} || '   描述：' || gap[2] || {NL} || '   建议：' || gap[3]
  || CASE WHEN n >= 1 THEN '' ELSE {NL} || {NL} || '💡 温馨提示：由于知识库信息不足，回答可能不够完整，' || {NL} || '   建议参考上述建议方向补充相关资料。' END END"""
FOLLOW = "CASE WHEN len(gap) > 0 THEN [gap[3]] ELSE [question || '的历史背景', question || '的制作技艺', question || '的传承现状'] END"
PLAN = "pl AS (SELECT * FROM " + P.values([(m, i, r, a, role) for m, rows in DEBATE_PLANS.items() for i, (r, a, role) in enumerate(rows, 1)]) + " t(mode, seq, round_num, agent_name, role))"
REFS = "list_concat(" + ", ".join(f"regexp_extract_all({{0}}, {P.text(p)}, 1)" for p in P.REFERENCE_PATTERNS) + ")[1:5]"
SAID = B.SESSIONS + ",\n" + PLAN + f""",
said AS (SELECT t.session_id, t.seq, m.mode, p.round_num, p.agent_name, p.role, t.content, {REFS.format('t.content')} AS refs FROM st t JOIN sm m USING (session_id) JOIN pl p ON p.mode = m.mode AND p.seq = t.seq)"""
TYPE = "CASE {0} WHEN 'craft_expert' THEN '技艺知识专家' WHEN 'history_expert' THEN '历史文化专家' WHEN 'heritage_expert' THEN '传承现状专家' ELSE {1} END"
SHOWN = "CASE {0} WHEN 'craft_expert' THEN '技艺知识Agent' WHEN 'history_expert' THEN '历史文化Agent' WHEN 'heritage_expert' THEN '传承现状Agent' ELSE {0} END"
HISTORY = f"""SELECT session_id, seq, CASE WHEN mode = 'parallel' AND round_num = 1 THEN '' ELSE coalesce(string_agg('【' || {TYPE.format('agent_name', 'agent_name')} || ' - ' || role || '】' || {NL} || {{0}} || {NL}, {NL})
  OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS history FROM said"""
ROUNDS = "string_agg(seq || '/' || round_num || '/' || agent_name || '/' || role || '/' || length(content) || '/' || array_to_string(refs, '+'), '|' ORDER BY seq)"
DIGEST = f"string_agg(agent_name || '(' || role || '): ' || left(content, 300) || '...', {NL} ORDER BY seq)"
SYNTH = f"string_agg(content, {NL} || {NL} ORDER BY seq)"
USABLE = B.RESPONSES + """,
ok AS (SELECT question_id, agent_name, arg_max(content, ord) AS content, min(ord) AS ord FROM rs WHERE success AND length(content) > 0 GROUP BY ALL),
al AS (SELECT question_id, agent_name, min(ord) AS ord FROM rs GROUP BY ALL)"""
FACT_ROWS = P.values([(c, list(a), list(b), list(t), f) for c, a, b, t, f in P.FACTS]) + " t(class, process, materials, tools, feature)"
EVENTS = P.values([(c, i, *e) for c, es in P.TIMELINES for i, e in enumerate(es)]) + " t(class, pos, period, stage, description)"
LEVELS = P.values([(c, k, "|".join(v)) for c, _, levels, _ in P.STATUS for k, v in levels.items()]) + " t(class, level, names)"
STATUS_LINES = P.values([(c, s, *["~".join(f"  • {k}：{', '.join(v)}" for k, v in listed.items()) for listed in (levels, paths)])
                         for c, s, levels, paths in P.STATUS]) + " t(class, status, levels, paths)"
STATUS_ROWS = P.values([(c, s, ";".join(sorted(f"{k}={','.join(v)}" for k, v in paths.items()))) for c, s, _, paths in P.STATUS]) + " t(class, status, paths)"

ORACLES = {
    "question_route": f"""WITH {B.USER_TURNS}, c AS (SELECT query_id, {CATS} AS cats FROM us)
SELECT query_id, '根据关键词分析，该问题涉及' || array_to_string(list_transform(cats, lambda x: {NAMES}), '、') || '领域' AS intent_analysis, array_to_string(cats, '|') AS experts,
  '问题中检测到相关领域关键词，因此分配' || len(cats) || '个专家Agent处理' AS reasoning, (['simple', 'medium', 'complex'])[len(cats)] AS complexity FROM c""",
    "entity_identify": f"""WITH {B.USER_TURNS}, w AS (SELECT *, string_split_regex(question, '\\s+') AS ws FROM us),
s AS (SELECT *, list_filter(ws, lambda x: list_contains({P.texts(P.ENTITIES)}, x)) AS sup FROM w)
SELECT query_id, CASE WHEN len(sup) > 0 THEN sup[1] ELSE {ENT.format('question')} END AS entity FROM s""",
    "entity_in_answer": f"SELECT a.conv_id, a.turn, {ENT2} AS entity FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'",
    "debate_mode": f"""WITH {B.USER_TURNS}, c AS (SELECT *, lower(question) AS low, len({CATS}) AS n, {' + '.join(f"contains(question, {P.text(e)})::INT" for e in P.ENTITIES)} AS named FROM us)
SELECT query_id, CASE WHEN NOT {P.any_of('low', P.DEBATE['how'])} AND n = 1 THEN '' WHEN {P.any_of('low', P.DEBATE['why'])} THEN 'progressive' WHEN named >= 2 THEN 'parallel'
  WHEN {P.any_of('low', P.DEBATE['future'])} AND n >= 2 THEN 'multi_perspective' WHEN n = 3 THEN 'multi_perspective' ELSE '' END AS mode FROM c""",
    "narrative_flag": f"WITH {B.USER_TURNS} SELECT query_id, query_id % 7 = 0 OR {P.any_of('question', P.NARRATIVE)} AS narrative FROM us",
    "coverage_rule": f"""WITH {HITS} SELECT query_id, level AS coverage_level, n AS relevant_documents, CASE level WHEN 'sufficient' THEN 0.85 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS coverage_score,
  n >= 1 AS can_answer, CASE level WHEN 'sufficient' THEN 0.9 WHEN 'partial' THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence,
  CASE level WHEN 'sufficient' THEN '检索到' || n || '条相关文档，覆盖度良好' WHEN 'partial' THEN '检索到' || n || '条相关文档，存在一定缺口' ELSE '未检索到任何相关文档' END AS reasoning, array_to_string(gap, '/') AS gaps FROM gp""",
    "gap_report": f"WITH {HITS} SELECT query_id, {REPORT} AS report FROM gp",
    "retry_flag": f"WITH {HITS} SELECT query_id, level = 'missing' OR (level = 'partial' AND query_id % 2 = 0) AS retry FROM gp",
    "followup_queries": f"WITH {HITS} SELECT query_id, unnest({FOLLOW}) AS followup FROM gp",
    "gap_batch": f"WITH {HITS} SELECT query_id, level AS coverage_level, n AS relevant_documents, {REPORT} AS report, array_to_string({FOLLOW}, '|') AS suggestions FROM gp",
    "evidence_digest": f"""WITH {HITS} SELECT q.query_id, coalesce(d.digest, '无') AS digest FROM qs q LEFT JOIN (SELECT query_id, string_agg('文档' || rank || ': ' || left(text, 500), {NL} ORDER BY rank) AS digest
  FROM hr JOIN documents USING (doc_id) GROUP BY 1) d USING (query_id)""",
    "coverage_replies": f"""WITH {HITS} SELECT query_id, CASE WHEN query_id % 3 <= 1 THEN 'partial' ELSE level END AS coverage_level, n AS relevant_documents,
  CASE query_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.5 ELSE CASE level WHEN 'sufficient' THEN 0.85 WHEN 'partial' THEN 0.5 ELSE 0.0 END END::DOUBLE AS coverage_score,
  CASE query_id % 3 WHEN 0 THEN false WHEN 1 THEN n >= 3 ELSE n >= 1 END AS can_answer,
  CASE query_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 ELSE CASE level WHEN 'sufficient' THEN 0.9 WHEN 'partial' THEN 0.7 ELSE 0.95 END END::DOUBLE AS confidence,
  CASE query_id % 3 WHEN 0 THEN 'r' WHEN 1 THEN '' ELSE CASE level WHEN 'sufficient' THEN '检索到' || n || '条相关文档，覆盖度良好' WHEN 'partial' THEN '检索到' || n || '条相关文档，存在一定缺口' ELSE '未检索到任何相关文档' END END AS reasoning,
  CASE query_id % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE coalesce(gap[3], '') END AS gaps FROM gp""",
    "class_facts": f"""SELECT doc_id, lang AS class, coalesce(array_to_string(process, '|'), '-') AS process, coalesce(array_to_string(materials, '|'), '-') AS materials, coalesce(array_to_string(tools, '|'), '-') AS tools,
  coalesce(feature, '-') AS feature FROM documents LEFT JOIN {FACT_ROWS} ON class = lang""",
    "timeline": f"SELECT doc_id, lang AS class, pos::BIGINT AS pos, period, stage, description FROM documents JOIN {EVENTS} ON class = lang",
    "level_rows": f"SELECT doc_id, lang AS class, level, names FROM documents JOIN {LEVELS} ON class = lang",
    "status_lookup": f"SELECT doc_id, lang AS class, coalesce(status, '未知') AS status, coalesce(paths, '') AS paths FROM documents LEFT JOIN {STATUS_ROWS} ON class = lang",
    "context_block": f"""WITH {R.ROUTED}, names AS (SELECT * FROM (VALUES ('that', 'en'), ('with', 'en'), ('nicht', 'de'), ('pour', 'fr')) t(entity, class)),
bl AS (SELECT 'craft_expert' AS category, entity, '【' || entity || '技艺基本信息】' || {NL} || '主要工艺流程：' || array_to_string(process, ' → ') || {NL} || '主要材料：' || array_to_string(materials, ', ') || {NL}
  || '主要工具：' || array_to_string(tools, ', ') || {NL} || '特点：' || feature AS block FROM names JOIN (SELECT * FROM {FACT_ROWS}) f USING (class)
  UNION ALL SELECT 'history_expert', entity, '【' || entity || '历史沿革】' || {NL} || '起源：' || first_period || {NL} || {NL} || '发展脉络：' || {NL} || lines || {NL} || {NL} || '文化意义：' || feature
    || CASE WHEN class = 'fr' THEN {NL} || '代表人物：' || array_to_string(tools, ', ') ELSE '' END
  FROM names JOIN (SELECT * FROM {FACT_ROWS}) f USING (class)
    JOIN (SELECT class, arg_min(period, pos) AS first_period, string_agg('  • ' || period || '（' || stage || '）：' || description, {NL} ORDER BY pos) AS lines FROM {EVENTS} GROUP BY class) e USING (class)
  UNION ALL SELECT 'heritage_expert', entity, '【' || entity || '传承现状】' || {NL} || '保护等级：' || feature || {NL} || '濒危程度：' || status || {NL} || {NL} || '传承人信息：' || {NL}
    || replace(levels, '~', {NL}) || {NL} || {NL} || '分布区域：' || class || {NL} || {NL} || '保护措施：' || {NL}
    || array_to_string(list_transform(process, lambda m, i: '  ' || i || '. ' || m), {NL}) || {NL} || {NL} || '学习途径：' || {NL} || replace(paths, '~', {NL})
    || CASE WHEN class = 'en' THEN {NL} || {NL} || '【推荐学习资源】' || {NL} || array_to_string(list_transform(tools, lambda t: '  • ' || t || '（tool）- en'), {NL}) ELSE '' END
  FROM names JOIN (SELECT * FROM {FACT_ROWS}) f USING (class) JOIN (SELECT * FROM {STATUS_LINES}) s USING (class)),
ask AS (SELECT query_id, category, {ENT.format('question')} AS entity FROM rc JOIN qs USING (query_id)),
ev AS (SELECT query_id, category, string_agg(rank || '. ' || left(text, 300) || '...', {NL} ORDER BY rank) AS lines FROM routed JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL),
ctx AS (SELECT a.query_id, a.category, concat_ws({NL}, bl.block, CASE WHEN ev.lines IS NOT NULL THEN {NL} || CASE WHEN a.category = 'history_expert' THEN '【相关历史文献】' ELSE '【相关文档资料】' END || {NL} || ev.lines END) AS c
  FROM ask a LEFT JOIN bl ON bl.entity = a.entity AND bl.category = a.category LEFT JOIN ev ON ev.query_id = a.query_id AND ev.category = a.category)
SELECT query_id, category, CASE WHEN c <> '' THEN c WHEN category = 'craft_expert' THEN '没有找到相关的技艺资料。' WHEN category = 'history_expert' THEN '没有找到相关的历史资料。' ELSE '没有找到相关的传承信息。' END AS context FROM ctx""",
    "response_counts": f"WITH {B.RESPONSES} SELECT question_id, count(*) FILTER (success) AS successes, count(*) AS total FROM rs GROUP BY 1",
    "response_fusion": f"""WITH {USABLE}, g AS (SELECT question_id, count(*) AS n, any_value(agent_name) AS agent, any_value(content) AS content,
  string_agg('[' || {SHOWN.format('agent_name')} || ']' || {NL} || {NL} || content || {NL}, {NL} ORDER BY list_position(['craft_expert', 'history_expert', 'heritage_expert'], agent_name)) FILTER (agent_name <> 'guest_expert') AS many FROM ok GROUP BY 1)
SELECT c.question_id, CASE WHEN n IS NULL THEN '抱歉，暂时没有找到相关信息。' WHEN n = 1 THEN '[' || {SHOWN.format('agent')} || ']' || {NL} || {NL} || content ELSE coalesce(many, '') END AS fused
  FROM (SELECT DISTINCT conv_id AS question_id FROM conversations) c LEFT JOIN g USING (question_id)""",
    "source_annotations": f"WITH {USABLE} SELECT question_id, string_agg(agent_name || '/' || {SHOWN.format('agent_name')} || '/' || {TYPE.format('agent_name', chr(39) + '未知专家' + chr(39))}, '|' ORDER BY ord) AS sources FROM al GROUP BY 1",
    "debate_plan": f"WITH {B.SESSIONS}, {PLAN} SELECT session_id, mode, seq::BIGINT AS seq, round_num::BIGINT AS round_num, agent_name, role FROM sm JOIN pl USING (mode)",
    "debate_history": f"WITH {SAID} " + HISTORY.format("content"),
    "cross_digest": f"WITH {SAID} " + HISTORY.format("left(content, 500) || '...'"),
    "session_synthesis": f"WITH {SAID} SELECT session_id, {SYNTH} AS final_synthesis FROM said GROUP BY 1",
    "insight_digest": f"WITH {SAID} SELECT session_id, {DIGEST} AS digest FROM said GROUP BY 1",
    "session_nested": f"WITH {SAID} SELECT session_id, {ROUNDS} AS rounds FROM said GROUP BY 1",
    "full_session": f"WITH {SAID} SELECT session_id, any_value(mode) AS mode, {ROUNDS} AS rounds, {DIGEST} AS digest, {SYNTH} AS final_synthesis FROM said GROUP BY 1",
    "history_citations": f"SELECT conv_id, turn, (unnest(range(0, len(c))))::BIGINT AS pos, unnest(c) AS citation FROM (SELECT conv_id, turn, {REFS.format('text')} AS c FROM conversations WHERE role = 'assistant')",
    "history_insights": """WITH m AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\.\\s*'), lambda x: x <> '') AS s FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS pos, unnest(s) AS insight FROM m)
SELECT conv_id, rank, insight FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS rank FROM e) WHERE rank <= 5""",
    "profile_adapt": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'learner' WHEN 'assistant' THEN 'researcher' ELSE 'expert' END AS user_profile,
  CASE role WHEN 'user' THEN '学习者' WHEN 'assistant' THEN '研究者' ELSE '好奇者' END AS profile_name, CASE role WHEN 'user' THEN 'medium' WHEN 'assistant' THEN 'deep' ELSE 'shallow' END AS depth,
  CASE role WHEN 'user' THEN 800 WHEN 'assistant' THEN 2000 ELSE 300 END::BIGINT AS low,
  CASE role WHEN 'user' THEN '完整知识体系|操作要点|练习建议' WHEN 'assistant' THEN '完整技术细节|历史文献|统计数据' ELSE '基本概念|趣味点|简单历史' END AS focus,
  CASE role WHEN 'user' THEN length(text) BETWEEN 800 AND 1500 WHEN 'assistant' THEN length(text) BETWEEN 2000 AND 5000 ELSE length(text) BETWEEN 300 AND 500 END AS length_ok FROM conversations""",
    "final_response": f"""WITH {HITS}, r AS (SELECT query_id, n, question || CASE WHEN level = 'sufficient' THEN '' ELSE {NL} || {NL} || ({REPORT}) END AS answer FROM gp)
SELECT query_id, answer, greatest(1, length(answer) // 400) AS reading_time, n = 0 AS has_gaps FROM r""",
    "coverage_labels": f"WITH {HITS} SELECT query_id, CASE level WHEN 'sufficient' THEN '✅ 充足' WHEN 'partial' THEN '⚠️ 部分覆盖' ELSE '❌ 缺失' END AS label FROM cv",
}
