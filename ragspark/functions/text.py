"""Text, array and map scalars. Everything here is a built-in expression, so it stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace stripped from both ends of a line or of a text.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"

WORD_BREAK = r"[^\p{L}\p{N}]+"
HAN_RUN = r"(\p{IsHan}+)"


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(col, f"^{BLANKS}+|{BLANKS}+$", "")


def clean_text(col: Column) -> Column:
    """Strip each line, drop blank lines, join the rest with a newline."""
    lines = F.transform(F.split(col, "\n"), strip)
    return F.array_join(F.array_remove(lines, ""), "\n")


def char_count(col: Column) -> Column:
    return F.length(col).cast("long")


def line_count(col: Column) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1).cast("long")


def extract_keywords(col: Column, stopwords: Iterable[str]) -> Column:
    """Whitespace words of two or more characters that are not stop words; repeats are kept."""
    words = F.split(strip(col), f"{BLANKS}+")
    stop = list(stopwords)
    if stop:
        return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stop))
    return F.filter(words, lambda w: F.length(w) >= 2)


def tokenize(col: Column, mode: str = "mixed") -> Column:
    """Lower-cased runs of letters and digits.

    In `mixed` mode runs of Han characters become overlapping two-character tokens; rows without such
    characters take the plain path.
    """
    lowered = F.lower(col)
    words = F.array_remove(F.split(lowered, WORD_BREAK), "")
    if mode == "words":
        return words
    spaced = F.array_remove(F.split(F.regexp_replace(lowered, HAN_RUN, " $1 "), WORD_BREAK), "")
    bigrams = F.flatten(
        F.transform(
            spaced,
            lambda t: F.when(
                t.rlike(r"^\p{IsHan}{2,}$"),
                F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))),
            ).otherwise(F.array(t)),
        )
    )
    return F.when(lowered.rlike(r"\p{IsHan}"), bigrams).otherwise(words)


def occurrence_count(col: Column, term: Column) -> Column:
    """How often `term` occurs, overlapping occurrences included (one linear pass)."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(term) > 0, F.regexp_count(col, quoted)).otherwise(0).cast("long")


def first_positions(col: Column, term: Column, n: int = 5) -> Column:
    """Zero-based start positions of the first n, possibly overlapping, occurrences."""

    def step(found: Column, _: Column) -> Column:
        start = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(-1)) + 2
        at = F.call_function("locate", term, col, start)
        return F.when(at > 0, F.concat(found, F.array(at - 1))).otherwise(found)

    empty = F.array().cast("array<int>")
    return F.when(F.length(term) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(n)), empty, step)).otherwise(empty)


def excerpt(col: Column, n: int, always: bool = False) -> Column:
    """The first n characters, with `...` when the text was cut, or always."""
    cut = F.concat(F.left(col, F.lit(n)), F.lit("..."))
    return cut if always else F.when(F.length(col) > n, cut).otherwise(col)


def reading_time(col: Column, chars_per_minute: int = 400) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col) / chars_per_minute)).cast("long")


def toc_entries(col: Column) -> Column:
    """Heading-like lines: they start with `#` or a digit, are longer than 3, cut to 50; the first ten."""
    lines = F.transform(F.split(col, "\n"), strip)
    heads = F.filter(lines, lambda l: l.rlike(r"^(#|\p{Nd})") & (F.length(l) > 3))
    return F.slice(F.transform(heads, lambda l: F.left(l, F.lit(50))), 1, 10)


def add_toc(col: Column, profile: Column, profiles: Iterable[str] = ("learner", "researcher")) -> Column:
    entries = toc_entries(col)
    listing = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e)), "\n")
    headed = F.concat(F.lit("## 目录\n"), listing, F.lit("\n\n---\n\n"), col)
    return F.when(profile.isin(list(profiles)) & (F.size(entries) > 0), headed).otherwise(col)


def fenced_json(col: Column) -> Column:
    """Body of the first ```json fence, else of the first plain fence, else the text itself.

    An opening fence that is never closed yields null, which the reply parser treats as malformed.
    """
    tagged = F.regexp_extract(col, r"(?s)```json(.*?)```", 1)
    plain = F.regexp_extract(col, r"(?s)```(.*?)```", 1)
    closed_tagged = col.rlike(r"(?s)```json.*?```")
    closed_plain = col.rlike(r"(?s)```.*?```")
    return (
        F.when(F.contains(col, F.lit("```json")), F.when(closed_tagged, strip(tagged)))
        .when(F.contains(col, F.lit("```")), F.when(closed_plain, strip(plain)))
        .otherwise(col)
    )


def strip_fences(col: Column) -> Column:
    """Remove one leading and one trailing fence, keeping everything between."""
    opened = F.regexp_replace(strip(col), r"^```(json)?", "")
    return strip(F.regexp_replace(opened, r"```$", ""))


def extract_references(col: Column, patterns: Iterable[str], limit: int = 5) -> Column:
    """Matches of each pattern in turn (group 1), the first `limit` of them."""
    found = [F.regexp_extract_all(col, F.lit(p), F.lit(1)) for p in patterns]
    return F.slice(F.concat(*found), 1, limit)


def label_of(col: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Look a code up in a fixed small dictionary; the default is the code itself."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), col if default is None else default)


def bibliography(sources: Column, untitled: str = "未知来源") -> Column:
    """Numbered `title - author` lines from an array of structs (title, author)."""
    lines = F.transform(
        sources,
        lambda s, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". "),
            F.coalesce(s["title"], F.lit(untitled)),
            F.when(F.coalesce(F.length(s["author"]), F.lit(0)) > 0, F.concat(F.lit(" - "), s["author"])).otherwise(""),
        ),
    )
    return F.array_join(lines, "\n")


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when one of a fixed short word list occurs in the text."""
    words = list(words)
    if not words:
        return F.lit(False)
    flag = F.contains(col, F.lit(words[0]))
    for word in words[1:]:
        flag = flag | F.contains(col, F.lit(word))
    return flag
