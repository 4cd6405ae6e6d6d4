"""Question classification by keyword rules. Lexicons are short fixed lists, so the rules are plain
column expressions: one pass over the questions, no join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.replies import parsed_object
from ragspark.functions.text import contains_any, fenced_json, label_of
from ragspark.lexicons import AGENT_NAMES, DEBATE_WORDS, ENTITIES, NARRATIVE_WORDS, ROUTES

Routes = Sequence[tuple[str, Sequence[str]]]


def _strings(*cols: Column) -> Column:
    return F.array(*cols).cast("array<string>")


def routed_categories(text: Column, routes: Routes = ROUTES) -> Column:
    """Categories with a keyword in the text, in priority order; the first category when there is none."""
    legs = [F.when(contains_any(text, words), _strings(F.lit(c))).otherwise(_strings()) for c, words in routes]
    found = F.concat(*legs)
    return F.when(F.size(found) > 0, found).otherwise(_strings(F.lit(routes[0][0])))


def analysis_of(categories: Column, display: dict[str, str] = AGENT_NAMES) -> dict[str, Column]:
    # The sentences are fixed values.
    n = F.size(categories)
    shown = F.array_join(F.transform(categories, lambda c: label_of(c, display)), "、")
    return {
        "intent_analysis": F.concat(F.lit("根据关键词分析，该问题涉及"), shown, F.lit("领域")),
        "required_experts": categories,
        "reasoning": F.concat(F.lit("问题中检测到相关领域关键词，因此分配"), n.cast("string"), F.lit("个专家Agent处理")),
        "key_entities": _strings(),
        "complexity": F.when(n == 1, "simple").when(n == 2, "medium").otherwise("complex"),
    }


def route(questions: DataFrame, text: str = "question", routes: Routes = ROUTES,
          display: dict[str, str] = AGENT_NAMES) -> DataFrame:
    """Adds intent_analysis, required_experts, reasoning, key_entities and complexity."""
    routed = questions.withColumn("_c", routed_categories(F.col(text), routes))
    fields = analysis_of(F.col("_c"), display)
    return routed.select("*", *[value.alias(name) for name, value in fields.items()]).drop("_c")


ANALYSIS_FIELDS = ("intent_analysis STRING, required_experts ARRAY<STRING>, reasoning STRING, "
                   "key_entities ARRAY<STRING>, complexity STRING")


def parse_analysis(questions: DataFrame, reply: str = "reply", text: str = "question", routes: Routes = ROUTES,
                   display: dict[str, str] = AGENT_NAMES) -> DataFrame:
    """The analysis held in a stored reply; a malformed reply, or one without categories, is routed by rule."""
    ruled = questions.withColumn("_c", routed_categories(F.col(text), routes)).withColumn(
        "_r", parsed_object(fenced_json(F.col(reply)), ANALYSIS_FIELDS))
    usable = F.coalesce(F.size("_r.required_experts"), F.lit(0)) > 0
    ruled = ruled.withColumn("from_reply", F.col("_r").isNotNull() & usable)
    rule = analysis_of(F.col("_c"), display)
    default = {"intent_analysis": F.lit(""), "reasoning": F.lit(""), "key_entities": _strings(), "complexity": F.lit("medium")}
    columns = [
        F.when(F.col("from_reply"), F.coalesce(F.col("_r")[name], default.get(name, rule[name])))
        .otherwise(rule[name]).alias(name)
        for name in rule
    ]
    return ruled.select("*", *columns).drop("_c", "_r")


def identify_entity(text: Column, names: Sequence[str] = ENTITIES, supplied: Column | None = None,
                    extra: Column | None = None) -> Column:
    """The first supplied entity that is known, else the first name, in lexicon order, in the text or in
    the extra text; null when there is none."""
    legs: list[Column] = []
    if supplied is not None:
        legs.append(F.try_element_at(F.filter(supplied, lambda e: e.isin(list(names))), F.lit(1)))
    for name in names:
        hit = F.contains(text, F.lit(name))
        if extra is not None:
            hit = hit | F.coalesce(F.contains(extra, F.lit(name)), F.lit(False))
        legs.append(F.when(hit, F.lit(name)))
    return F.coalesce(*legs)


def debate_mode(text: Column, categories: Column, complexity: Column, names: Sequence[str] = ENTITIES,
                words: dict[str, Sequence[str]] = DEBATE_WORDS) -> Column:
    """progressive, parallel, multi_perspective, or the empty string for no debate; the rules apply in order."""
    lowered = F.lower(text)
    n = F.size(categories)
    named = sum((F.contains(text, F.lit(name)).cast("int") for name in names[1:]), F.contains(text, F.lit(names[0])).cast("int"))
    return (
        F.when(~contains_any(lowered, words["how"]) & (n == 1) & (complexity == "simple"), "")
        .when((n >= 1) & contains_any(lowered, words["why"]), "progressive")
        .when(named >= 2, "parallel")
        .when(contains_any(lowered, words["future"]) & (n >= 2), "multi_perspective")
        .when((complexity == "complex") & (n >= 2), "multi_perspective")
        .otherwise("")
    )


def narrative_flag(text: Column, explicit: Column | None = None, words: Sequence[str] = NARRATIVE_WORDS) -> Column:
    spoken = contains_any(text, words)
    return spoken if explicit is None else F.coalesce(explicit, F.lit(False)) | spoken
