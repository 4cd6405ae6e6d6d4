"""Parameters shared by the Spark queries and their SQL: lexicons that occur in the given texts."""

from __future__ import annotations

STOP = ["the", "and", "of", "der", "die", "und", "les", "que"]
CLASS_KEYWORDS = {
    "en": ["that", "tion", "thble", "from"],
    "fr": ["pour", "ment", "elle"],
    "de": ["nicht", "keit", "eine"],
    "es": ["para", "ción", "mente"],
}
CLASS_NAMES = {"en": "English", "fr": "Français", "de": "Deutsch"}
ROUTES = [
    ("craft_expert", ["tion", "keit"]),
    ("history_expert", ["eau", "that"]),
    ("heritage_expert", ["with", "para", "ment"]),
]
ENTITIES = ["that", "with", "nicht", "pour", "para", "from"]
DEBATE = {"how": ["est", "for"], "why": ["que", "this"], "future": ["sch", "ther"]}
NARRATIVE = ["elle", "ung"]
SYNONYMS = [
    ("tion", ["thon", "ther", "than"]),
    ("eau", ["ment", "elle"]),
    ("keit", ["heit", "lich", "eine"]),
    ("that", ["this", "thes"]),
    ("para", ["mente", "ción"]),
    ("with", ["from", "then"]),
]
REFERENCE_PATTERNS = [r"with\s*(.+?)(?:\n|$)", r"nicht\s*(.+?)(?:\n|$)", r"pour\s*(.+?)(?:\n|$)"]
# class, process, materials, tools, feature
FACTS = [
    ("en", ["draw", "cut", "join"], ["oak", "ash"], ["saw"], "plain"),
    ("fr", ["spin", "weave"], ["silk"], ["loom", "comb"], "fine"),
    ("de", ["cast", "forge", "file"], ["iron", "coal"], ["hammer", "anvil"], "hard"),
]
# class, events (period, stage, description)
TIMELINES = [
    ("en", [("1200", "start", "first guild"), ("1500", "peak", "export")]),
    ("fr", [("1100", "start", "abbey"), ("1600", "peak", "court"), ("1900", "late", "revival")]),
]
# class, status, levels, paths
STATUS = [
    ("en", "stable", {"national": ["Ann", "Bob"], "local": ["Cid"]}, {"school": ["A", "B"], "master": ["C"]}),
    ("de", "rare", {"national": ["Dora"]}, {"school": ["E"]}),
]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def values(rows) -> str:
    """Rows of text, number and list cells as a SQL VALUES list."""
    def cell(v):
        if isinstance(v, str):
            return text(v)
        if isinstance(v, (list, tuple)):
            return texts(v)
        return str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(c) for c in row) + ")" for row in rows) + ")"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"
