"""The Merkle manifest as DuckDB SQL: one step per level, for groups of up to 3 ** 14 leaves and up to 3 ** 8 groups."""

LEAF_LEVELS, GROUP_LEVELS = 14, 8

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _digest(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in COLUMNS) + ")"


# CRC-32 of the decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""


def _levels(name: str, first: str, most: int) -> list[str]:
    """Tables {name}0 .. of the nodes (g, p, h) of every level; a group with one node left keeps it."""
    tables = [f"{name}0 AS ({first})"]
    for k in range(most):
        tables.append(f"""{name}{k + 1} AS (SELECT g, p // 3 AS p, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, p // 3)""")
    return tables


def _steps(name: str, most: int) -> list[str]:
    """{name}s: for each level and run its nodes in order; a group with one node has no runs any more."""
    return [f"{name}s AS (" + " UNION ALL ".join(
        f"SELECT g, {k} AS l, p // 3 AS r, list(h ORDER BY p) AS hs FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) WHERE n > 1 GROUP BY g, p // 3"
        for k in range(most)) + ")"]


def _climb(name: str, source: str, leaf: str, position: str, group: str, most: int) -> list[str]:
    """Tables {name}0 .. with proof (siblings so far) and folded, a level at a time."""
    tables, before = [], source
    for k in range(most):
        at = f"(({position} // {3 ** k}) % 3)"
        tables.append(f"""{name}{k} AS (SELECT b.* REPLACE (
  CASE WHEN s.g IS NULL THEN b.proof ELSE b.proof || array_to_string(s.hs[:{at}], '') || array_to_string(s.hs[{at} + 2:], '') END AS proof,
  CASE WHEN s.g IS NULL THEN b.folded ELSE sha256(array_to_string(s.hs[:{at}], '') || b.folded || array_to_string(s.hs[{at} + 2:], '')) END AS folded)
  FROM {before} b LEFT JOIN {leaf} s ON s.g = b.{group} AND s.l = {k} AND s.r = b.{position} // {3 ** (k + 1)})""".replace(f"(({position}", f"((b.{position}"))
        before = f"{name}{k}"
    return tables


def manifest_sql() -> str:
    tables = [
        f"""d AS (SELECT doc_id, coalesce('+' || source, '!') AS g, {_digest('text')} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {_digest("replace(text, chr(10), '')")} ELSE {_digest('text')} END AS folded FROM documents)""",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS proof FROM d)",
        *_levels("n", "SELECT g, p, leaf AS h FROM l", LEAF_LEVELS), *_steps("n", LEAF_LEVELS),
        *_levels("m", f"SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS p, h FROM n{LEAF_LEVELS}", GROUP_LEVELS), *_steps("m", GROUP_LEVELS),
        f"t AS (SELECT g, 0 AS z, row_number() OVER (ORDER BY g) - 1 AS q, h AS subroot FROM n{LEAF_LEVELS})",
        "x AS (SELECT l.*, t.z, t.q, t.subroot FROM l JOIN t USING (g))",
        *_climb("c", "x", "ns", "p", "g", LEAF_LEVELS), *_climb("e", f"c{LEAF_LEVELS - 1}", "ms", "q", "z", GROUP_LEVELS),
    ]
    return "WITH " + ",\n".join(tables) + f"""
SELECT doc_id, leaf, subroot, m{GROUP_LEVELS}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m{GROUP_LEVELS}.h AS verified
FROM e{GROUP_LEVELS - 1}, m{GROUP_LEVELS}"""
