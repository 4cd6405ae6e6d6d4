"""Coverage of questions by their hits, and the reports made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.sizing import settled_broadcast
from ragspark.functions.replies import parsed_object
from ragspark.functions.text import fenced_json, label_of
from ragspark.lexicons import COVERAGE_LABELS

# Fixed values of the rule and its wording.
ENOUGH = 3
RETRY_CONFIDENCE = 0.6


def _gap(aspect: Column, description: Column, suggestion: Column) -> Column:
    return F.struct(aspect.alias("aspect"), description.alias("description"), suggestion.alias("suggestion"))


def rule_fields(n: Column) -> dict[str, Column]:
    count = n.cast("string")
    sufficient, partial = n >= ENOUGH, (n >= 1) & (n < ENOUGH)
    part_gap = _gap(
        F.lit("详细信息"),
        F.concat(F.lit("仅找到"), count, F.lit("条相关文档，可能不够全面")),
        F.lit("建议补充更多相关文献和资料"),
    )
    full_gap = _gap(F.lit("全部内容"), F.lit("知识库中未找到相关信息"), F.lit("需要收集该领域的系统资料"))
    none = F.array().cast("array<struct<aspect:string,description:string,suggestion:string>>")
    return {
        "coverage_level": F.when(sufficient, "sufficient").when(partial, "partial").otherwise("missing"),
        "relevant_documents": n,
        "coverage_score": F.when(sufficient, 0.85).when(partial, 0.5).otherwise(0.0),
        "identified_gaps": F.when(sufficient, none).when(partial, F.array(part_gap)).otherwise(F.array(full_gap)),
        "can_answer": n >= 1,
        "confidence": F.when(sufficient, 0.9).when(partial, 0.7).otherwise(0.95),
        "reasoning": F.when(sufficient, F.concat(F.lit("检索到"), count, F.lit("条相关文档，覆盖度良好")))
        .when(partial, F.concat(F.lit("检索到"), count, F.lit("条相关文档，存在一定缺口")))
        .otherwise("未检索到任何相关文档"),
    }


def hit_counts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with their number of hits; questions without any hit stay, with 0."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return questions.join(counts, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def coverage(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds coverage_level, relevant_documents, coverage_score, identified_gaps, can_answer, confidence
    and reasoning, by the number of hits."""
    counted = hit_counts(questions, hits)
    fields = rule_fields(F.col("n_hits"))
    return counted.select("*", *[v.alias(k) for k, v in fields.items()]).drop("n_hits")


REPLY_FIELDS = ("coverage_level STRING, coverage_score DOUBLE, identified_gaps ARRAY<STRUCT<aspect: STRING, "
                "description: STRING, suggestion: STRING>>, can_answer BOOLEAN, confidence DOUBLE, reasoning STRING")


def coverage_from_replies(questions: DataFrame, hits: DataFrame, reply: str = "reply", threshold: int = ENOUGH) -> DataFrame:
    """The coverage held in stored replies, with defaults per field; malformed replies take the rule."""
    counted = hit_counts(questions, hits).withColumn("_r", parsed_object(fenced_json(F.col(reply)), REPLY_FIELDS))
    rule = rule_fields(F.col("n_hits"))
    defaults = {
        "coverage_level": F.lit("partial"),
        "relevant_documents": F.col("n_hits"),
        "coverage_score": F.lit(0.5),
        "identified_gaps": F.array().cast("array<struct<aspect:string,description:string,suggestion:string>>"),
        "can_answer": F.col("n_hits") >= threshold,
        "confidence": F.lit(0.7),
        "reasoning": F.lit(""),
    }
    given = F.col("_r").isNotNull()
    columns = []
    for name, value in rule.items():
        stored = defaults[name] if name == "relevant_documents" else F.coalesce(F.col("_r")[name], defaults[name])
        columns.append(F.when(given, stored).otherwise(value).alias(name))
    return counted.select("*", *columns).drop("_r", "n_hits")


def gap_report(question: Column, level: Column, n: Column, gaps: Column, can_answer: Column,
               labels: dict[str, str] = COVERAGE_LABELS) -> Column:
    """The report as text; empty when coverage is sufficient."""
    listed = F.array_join(
        F.transform(
            gaps,
            lambda g, i: F.concat(
                F.lit("\n"), (i + 1).cast("string"), F.lit(". "), g["aspect"],
                F.lit("\n   描述："), g["description"], F.lit("\n   建议："), g["suggestion"],
            ),
        ),
        "\n",
    )
    text = F.concat(
        F.lit("⚠️ 知识缺口提示\n\n针对您的问题「"), question, F.lit("」，当前知识库覆盖情况：\n\n覆盖程度："),
        label_of(level, labels), F.lit("\n相关文档："), n.cast("string"), F.lit("条"),
        F.when(F.size(gaps) > 0, F.concat(F.lit("\n\n识别到的知识缺口：\n"), listed)).otherwise(""),
        F.when(~can_answer, F.lit("\n\n💡 温馨提示：由于知识库信息不足，回答可能不够完整，\n   建议参考上述建议方向补充相关资料。"))
        .otherwise(""),
    )
    return F.when(level == "sufficient", "").otherwise(text)


def with_report(covered: DataFrame, text: str = "question") -> DataFrame:
    return covered.withColumn("report", gap_report(
        F.col(text), F.col("coverage_level"), F.col("relevant_documents"), F.col("identified_gaps"), F.col("can_answer")))


def retry_flag(level: Column, confidence: Column) -> Column:
    return (level == "missing") | ((level == "partial") & (confidence < RETRY_CONFIDENCE))


def followup_queries(question: Column, gaps: Column) -> Column:
    """The suggestions of the gaps, else three general follow-ups."""
    general = F.array(*[F.concat(question, F.lit(s)) for s in ("的历史背景", "的制作技艺", "的传承现状")])
    return F.when(F.size(gaps) > 0, F.transform(gaps, lambda g: g["suggestion"])).otherwise(general)


def evidence_digest(questions: DataFrame, hits: DataFrame, docs: DataFrame, content: str = "content",
                    k: int = 5, chars: int = 500) -> DataFrame:
    """(query_id, digest): the first characters of each of the k hits, numbered by rank.

    `hits` carry a rank; at most k short excerpts per question are ever gathered.
    """
    best = settled_broadcast(hits.where(F.col("rank") <= k))
    pieces = docs.select("doc_id", F.left(content, F.lit(chars)).alias("_x")).join(best, "doc_id")
    line = F.struct(F.col("rank"), F.concat(F.lit("文档"), F.col("rank").cast("string"), F.lit(": "), "_x").alias("line"))
    lines = pieces.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("_l"))
    return questions.select("query_id").join(lines, "query_id", "left").select(
        "query_id", F.coalesce(F.array_join(F.col("_l.line"), "\n"), F.lit("无")).alias("digest"))


