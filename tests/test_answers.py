import pytest
from pyspark.sql import functions as F

from ragspark.operators import assemble as A
from ragspark.operators import classify as C
from ragspark.operators import coverage as V
from ragspark.plans.answers import full_session, gap_batch
from tests.conftest import rows

TEXT = "query_id long, question string"


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), TEXT)


def test_routing_priority_default_and_complexity(spark):
    got = C.route(ask(spark, "景泰蓝的制作流程是什么？", "苏绣起源于哪个朝代？", "如何学习龙泉青瓷？", "你好", "制作的历史与传承")).orderBy("query_id").collect()
    assert [r.required_experts for r in got] == [
        ["craft_expert"], ["history_expert"], ["heritage_expert"], ["craft_expert"], ["craft_expert", "history_expert", "heritage_expert"]]
    assert [r.complexity for r in got] == ["simple"] * 4 + ["complex"]
    assert got[4].intent_analysis == "根据关键词分析，该问题涉及技艺知识Agent、历史文化Agent、传承现状Agent领域"


@pytest.mark.parametrize("text, experts, complexity, mode", [
    ("景泰蓝是什么", 1, "simple", ""),
    ("景泰蓝为什么有名", 1, "simple", "progressive"),
    ("景泰蓝和苏绣如何区别", 1, "simple", "parallel"),
    ("景泰蓝和苏绣", 1, "simple", ""),
    ("苏绣的传承面临哪些挑战", 2, "medium", "multi_perspective"),
    ("苏绣", 3, "complex", "multi_perspective"),
    ("苏绣如何", 1, "simple", ""),
])
def test_debate_rules_apply_in_order(spark, text, experts, complexity, mode):
    categories = F.array(*[F.lit(f"e{i}") for i in range(experts)])
    assert ask(spark, text).select(C.debate_mode(F.col("question"), categories, F.lit(complexity)).alias("m")).first().m == mode


def test_narrative(spark):
    frame = spark.createDataFrame([("x", True), ("师傅讲讲景泰蓝", False), ("景泰蓝", False)], "question string, flag boolean")
    assert [r.n for r in frame.select(C.narrative_flag(F.col("question"), F.col("flag")).alias("n")).collect()] == [True, True, False]


def test_entity_from_the_supplied_list_the_text_or_the_answer(spark):
    frame = spark.createDataFrame([("苏绣与景泰蓝", ["x", "蜀锦"], ""), ("苏绣与景泰蓝", [], ""), ("没有", ["x"], "讲苏绣"), ("没有", [], None)],
                                  "q string, s array<string>, a string")
    assert [r.e for r in frame.select(C.identify_entity(F.col("q"), supplied=F.col("s"), extra=F.col("a")).alias("e")).collect()] == ["蜀锦", "景泰蓝", "苏绣", None]


def test_reply_without_categories_takes_the_rule(spark):
    frame = spark.createDataFrame([(0, "历史", '{"required_experts": []}'), (1, "历史", '```json\n{"required_experts": ["x"]}\n```'), (2, "历史", None)], TEXT + ", reply string")
    got = C.parse_analysis(frame).orderBy("query_id").collect()
    assert [r.required_experts for r in got] == [["history_expert"], ["x"], ["history_expert"]]
    assert [r.complexity for r in got] == ["simple", "medium", "simple"]


@pytest.mark.parametrize("n, level, score, answer, confidence", [
    (5, "sufficient", 0.85, True, 0.9), (3, "sufficient", 0.85, True, 0.9), (2, "partial", 0.5, True, 0.7), (0, "missing", 0.0, False, 0.95)])
def test_coverage_counts(spark, n, level, score, answer, confidence):
    hits = spark.createDataFrame([(0, i) for i in range(n)], "query_id long, doc_id long")
    r = V.with_report(V.coverage(ask(spark, "问"), hits)).first()
    assert (r.coverage_level, r.coverage_score, r.can_answer, r.confidence, r.relevant_documents) == (level, score, answer, confidence, n)
    assert (r.report == "") == (level == "sufficient")
    assert ("温馨提示" in r.report) == (n == 0)


def test_report_wording(spark):
    hits = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, doc_id long")
    assert V.with_report(V.coverage(ask(spark, "问"), hits)).first().report == (
        "⚠️ 知识缺口提示\n\n针对您的问题「问」，当前知识库覆盖情况：\n\n覆盖程度：⚠️ 部分覆盖\n相关文档：2条\n\n识别到的知识缺口：\n\n1. 详细信息\n"
        "   描述：仅找到2条相关文档，可能不够全面\n   建议：建议补充更多相关文献和资料")


@pytest.mark.parametrize("level, confidence, retry", [("missing", 0.9, True), ("partial", 0.5, True), ("partial", 0.6, False), ("sufficient", 0.1, False)])
def test_retry(spark, level, confidence, retry):
    assert spark.range(1).select(V.retry_flag(F.lit(level), F.lit(confidence)).alias("r")).first().r is retry


def test_followups_and_digest(spark):
    hits = spark.createDataFrame([(0, 7, 2), (0, 8, 1), (0, 9, 3)], "query_id long, doc_id long, rank long")
    docs = spark.createDataFrame([(7, "b" * 600), (8, "a"), (9, "c")], "doc_id long, content string")
    q = ask(spark, "问", "空")
    assert [r.f for r in V.coverage(q, hits).orderBy("query_id").select(V.followup_queries(F.col("question"), F.col("identified_gaps")).alias("f")).collect()] == [
        ["问的历史背景", "问的制作技艺", "问的传承现状"], ["需要收集该领域的系统资料"]]
    assert rows(V.evidence_digest(q, hits, docs)) == [(0, "文档1: a\n文档2: " + "b" * 500 + "\n文档3: c"), (1, "无")]


def test_gap_batch_keeps_questions_without_hits(spark):
    docs = spark.createDataFrame([(i, "red clay", []) for i in range(4)], "doc_id long, content string, keywords array<string>")
    got = {r.question: (r.coverage_level, r.suggestions) for r in gap_batch(ask(spark, "red clay", "zzz"), docs).collect()}
    assert got["red clay"][0] == "sufficient" and got["zzz"] == ("missing", ["需要收集该领域的系统资料"])


RESPONSE = "question_id long, agent_name string, content string, success boolean, ord long"


def test_fusion_of_none_one_and_many(spark):
    data = [(1, "history_expert", "h", True, 0), (2, "heritage_expert", "e", True, 0), (2, "craft_expert", "c", True, 1), (2, "craft_expert", "c2", True, 2), (2, "guest", "g", True, 3),
            (3, "guest", "g", True, 0)]
    q = spark.createDataFrame([(0,), (1,), (2,), (3,)], "question_id long")
    assert rows(A.fuse_responses(q, spark.createDataFrame(data, RESPONSE))) == [
        (0, "抱歉，暂时没有找到相关信息。"), (1, "[历史文化Agent]\n\nh"), (2, "[技艺知识Agent]\n\nc2\n\n[传承现状Agent]\n\ne\n"), (3, "[guest]\n\ng")]
    sources = A.annotate_sources(spark.createDataFrame(data, RESPONSE)).where("question_id = 2").first().source_agents
    assert [tuple(s) for s in sources] == [
        ("heritage_expert", "传承现状Agent", "传承现状专家"), ("craft_expert", "技艺知识Agent", "技艺知识专家"), ("guest", "guest", "未知专家")]


def test_plans_have_four_five_five_and_one_turns(spark):
    frame = spark.createDataFrame([("progressive",), ("parallel",), ("multi_perspective",), ("other",)], "mode string")
    got = {r.mode: r["count"] for r in A.debate_plan(frame).groupBy("mode").count().collect()}
    assert got == {"progressive": 4, "parallel": 5, "multi_perspective": 5, "other": 1}


def test_history_of_parallel_openings_is_empty(spark):
    sessions = spark.createDataFrame([(0, "q", "parallel"), (1, "q", "progressive"), (2, "q", "simple")], "session_id long, question string, mode string")
    turns = spark.createDataFrame([(s, i, f"t{i}\n来源：r{i}") for s in (0, 1) for i in range(1, 6)], "session_id long, seq long, content string")
    said = A.debate_plan(sessions).join(turns, ["session_id", "seq"])
    got = {(r.session_id, r.seq): r.history for r in A.debate_history(said).collect()}
    assert [got[(0, i)] == "" for i in range(1, 6)] == [True, True, True, False, False]
    assert got[(1, 2)] == "【技艺知识专家 - 主答】\nt1\n来源：r1\n" and got[(1, 3)].count("【") == 2
    cut = {(r.session_id, r.seq): r.history for r in A.debate_history(said, cut=2).collect()}
    assert cut[(1, 2)] == "【技艺知识专家 - 主答】\nt1...\n"
    whole = {r.session_id: r for r in full_session(sessions, turns).collect()}
    assert len(whole[1].rounds) == 4 and whole[1].rounds[0].references == ["r1"]
    assert whole[2].rounds is None and whole[2].final_synthesis == "无法生成回答。"


def test_profiles_and_final_answer(spark):
    frame = spark.createDataFrame([("learner", "x" * 900, "gap"), ("invalid", "x", "")], "user_profile string, content string, report string")
    got = A.adapt_profile(frame, A.profile_table(spark)).orderBy("profile_name").collect()
    assert [(r.profile_name, r.length_ok) for r in got] == [("好奇者", False), ("学习者", True)]
    final = A.finalize(frame).collect()
    assert [(r.answer, r.reading_time) for r in final] == [("x" * 900 + "\n\ngap", 2), ("x", 1)]


def test_context_falls_back_to_a_sentence(spark):
    asked = spark.createDataFrame([(0, "craft_expert", "景泰蓝"), (1, "history_expert", None), (2, "craft_expert", None)], "query_id long, category string, entity string")
    blocks = spark.createDataFrame([("craft_expert", "景泰蓝", "facts")], "category string, entity string, block string")
    hits = spark.createDataFrame([(0, "craft_expert", 5, 1), (1, "history_expert", 5, 1)], "query_id long, category string, doc_id long, rank long")
    docs = spark.createDataFrame([(5, "y" * 400)], "doc_id long, content string")
    got = {r.query_id: r.context for r in A.context_block(asked, blocks, hits, docs).collect()}
    assert got == {0: "facts\n\n【相关文档资料】\n1. " + "y" * 300 + "...", 1: "\n【相关历史文献】\n1. " + "y" * 300 + "...", 2: "没有找到相关的技艺资料。"}
