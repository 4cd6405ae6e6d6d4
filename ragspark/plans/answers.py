"""Coverage batches and whole debate sessions as single plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.text import extract_references
from ragspark.lexicons import REFERENCE_PATTERNS
from ragspark.operators.assemble import debate_plan, insight_digest, sessions_nested, synthesize
from ragspark.operators.coverage import coverage, followup_queries, with_report
from ragspark.plans.retrieval import TOP_K, retrieve


def gap_batch(questions: DataFrame, docs: DataFrame, k: int = TOP_K, **options) -> DataFrame:
    """One record per question: coverage of its top-k hits, the follow-up queries and the report."""
    hits = retrieve(questions, docs, k, **options)
    covered = with_report(coverage(questions, hits))
    return covered.withColumn("suggestions", followup_queries(F.col("question"), F.col("identified_gaps")))


def full_session(sessions: DataFrame, turns: DataFrame, patterns=REFERENCE_PATTERNS) -> DataFrame:
    """One nested record per session (session_id, question, mode).

    `turns` (session_id, seq, content) hold what was said; the mode's plan gives each turn its round,
    agent and role, so only planned turns enter, at most five per session.
    """
    said = (
        debate_plan(sessions.select("session_id", "mode"))
        .join(turns.select("session_id", "seq", "content"), ["session_id", "seq"])
        .withColumn("references", extract_references(F.col("content"), patterns))
    )
    return (
        sessions.join(sessions_nested(said), "session_id", "left")
        .join(insight_digest(said), "session_id", "left")
        .join(synthesize(sessions, said), "session_id", "left")
    )
