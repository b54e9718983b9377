"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import FIRST_BAD, ROUNDS, RULES, SMOOTH, STOP_WORDS
from .sharding import SHARDED_SQL

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

CONTAMINATION = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, {_PLAIN}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, {_PLAIN}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[i:i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.g = x.g),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover c ON c.doc_id = w.doc_id LEFT JOIN items i ON i.doc_id = w.doc_id
"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
c AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS before FROM s JOIN f ON s.g = f.g WHERE f.first < s.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM spans),
per AS (SELECT g.doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(d.h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a) AS kept, max(z) AS last
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(p.n_removed, 0) AS n_removed, coalesce(p.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN p.doc_id IS NULL THEN d.h ELSE p.kept || substr(d.h, CAST(2 * p.last + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN per p ON p.doc_id = d.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept FROM d JOIN root r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _quality() -> str:
    votes = [f"v{j}" for j in range(len(RULES))]
    n_bad = " + ".join(f"CASE WHEN {v} < 0 THEN 1 ELSE 0 END" for v in votes)
    steps = [f"e0 AS MATERIALIZED (SELECT *, CASE {n_bad} WHEN 0 THEN {FIRST_BAD[0]} WHEN 1 THEN {FIRST_BAD[1]} ELSE {FIRST_BAD[2]} END AS bad FROM patterns)"]
    for r in range(1, ROUNDS + 1):
        weights = ", ".join(
            f"ln(((sum(CASE WHEN {v} = {x} THEN n * (1 - bad) ELSE 0 END) + {SMOOTH}) / (sum(n * (1 - bad)) + {3 * SMOOTH})) / ((sum(CASE WHEN {v} = {x} THEN n * bad ELSE 0 END) + {SMOOTH}) / (sum(n * bad) + {3 * SMOOTH}))) AS {v}_{x + 1}"
            for v in votes for x in (-1, 0, 1)
        )
        odds = "prior + " + " + ".join(f"CASE {v} WHEN -1 THEN {v}_0 WHEN 0 THEN {v}_1 ELSE {v}_2 END" for v in votes)
        steps.append(f"m{r} AS MATERIALIZED (SELECT ln((sum(n * (1 - bad)) + {SMOOTH}) / (sum(n * bad) + {SMOOTH})) AS prior, {weights} FROM e{r - 1})")
        steps.append(f"e{r} AS MATERIALIZED (SELECT p.*, 1 - 1 / (1 + exp(-({odds}))) AS bad FROM patterns p CROSS JOIN m{r})")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    same = " AND ".join(f"f.{v} = e.{v}" for v in votes)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, {_SPACED})] AS lines FROM documents),
tri AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM often) GROUP BY 1),
figures AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.r, 0) AS n_repeat_words,
  len(lines) AS n_lines, len([x for x in w if x IN ({stop})]) AS n_stop_words, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks
  FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
voted AS MATERIALIZED (SELECT *, {", ".join(f"{sql} AS v{j}" for j, (_, sql) in enumerate(RULES))} FROM figures),
patterns AS MATERIALIZED (SELECT {", ".join(votes)}, count(*) AS n FROM voted GROUP BY ALL),
{", ".join(steps)}
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.n_words < 50 OR 100 * f.n_repeat_words > 50 * f.n_words AS base_failed,
  NOT (f.n_words < 50 OR 100 * f.n_repeat_words > 50 * f.n_words) AND e.bad <= 0.5 AS kept FROM voted f JOIN e{ROUNDS} e ON {same}
"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text, byte by byte; ``crc`` is a one-row relation with the table of its bytes."""
    return f"(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen({text}) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT))"


_CRC_TABLE = "SELECT list_transform(range(0, 256), lambda b: list_reduce(list_concat([b::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t"


def _merkle(depth: int = 16) -> str:
    """Trees of up to 3 ** depth rows, level by level."""

    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    def level(nodes: str, above: str) -> str:
        grouped = f"{above}g AS MATERIALIZED (SELECT tree, pos // 3 AS pos, list(h ORDER BY pos) AS hs, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) GROUP BY ALL)"
        return f"{grouped},\n{above} AS MATERIALIZED (SELECT tree, pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {above}g)"

    def folds(of: str, tree: str, pos: str) -> list[str]:
        """Each row's proof and folded hash, one level more at a time."""
        out = []
        for k in range(depth):
            slot, up = f"(r.{pos} // {3**k} % 3)", f"g.pos = r.{pos} // {3 ** (k + 1)}"
            left, right = f"array_to_string(g.hs[1:{slot}], '')", f"array_to_string(g.hs[{slot} + 2:], '')"
            both = f"CASE WHEN g.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN g.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold"
            out.append(f"{of}p{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (proof, fold), {both} FROM {of}p{k} r JOIN {of}{k + 1}g g ON g.tree IS NOT DISTINCT FROM r.{tree} AND {up})")
        return out

    changed = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed"
    steps = [
        f"crc AS ({_CRC_TABLE})",
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed')} AS changed FROM (SELECT documents.*, {changed} FROM documents, crc))",
        "r0 AS MATERIALIZED (SELECT doc_id, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf, changed FROM d)",
        "a0 AS MATERIALIZED (SELECT tree, pos, leaf AS h FROM r0)",
        *[level(f"a{k}", f"a{k + 1}") for k in range(depth)],
        f"b0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h, tree AS source FROM a{depth})",
        *[level(f"b{k}", f"b{k + 1}") for k in range(depth)],
        "ap0 AS MATERIALIZED (SELECT r0.*, '' AS proof, changed AS fold FROM r0)",
        *folds("a", "tree", "pos"),
        f"bp0 AS MATERIALIZED (SELECT r.*, 0 AS top, t.pos AS place, t.h AS subroot FROM ap{depth} r JOIN b0 t ON t.source IS NOT DISTINCT FROM r.tree)",
        *folds("b", "top", "place"),
    ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.h AS verified FROM bp{depth} r, b{depth} b"


JACCARD_JOIN = NEAR_DUPLICATES.replace("w[i:i + 4]", "w[i:i + 3]").replace("len(w) - 4", "len(w) - 3").replace(", d.doc_id = r.component_id AS kept", "")

SPELLING = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("(doc_id || ':' || run)")} END AS h FROM runs, crc),
spoilt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT d.word AS a, d.n AS n_a, w.word AS b, w.n AS n_b FROM dels d JOIN words w ON w.word = d.rest),
near AS MATERIALIZED (SELECT a, b, n_b FROM shorter UNION ALL SELECT b, a, n_a FROM shorter UNION ALL SELECT x.word, y.word, y.n FROM dels x JOIN dels y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'less': -n_b, 'other': b}}) AS best FROM near GROUP BY 1),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= 2 * w.n THEN b.best.other END AS form, CASE WHEN -b.best.less >= 2 * w.n THEN -b.best.less END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways(word, reached, form) AS (SELECT word, word, form FROM found UNION ALL SELECT y.word, f.word, f.form FROM ways y JOIN found f ON f.word = y.form)
SELECT f.word, f.form, y.reached AS root, f.n, f.n_near, f.form_n FROM found f JOIN ways y ON y.word = f.word AND y.form IS NULL
"""


ORACLES = {"op1_decontamination": CONTAMINATION, "op3_repeated_substrings": REPEATED_BYTES, "op6_quality_rules": _quality(), "op7_near_duplicates": NEAR_DUPLICATES, "op8_sharding": SHARDED_SQL, "op11_merkle_manifest": _merkle(), "op12_jaccard_join": JACCARD_JOIN, "op13_spelling_variants": SPELLING}
