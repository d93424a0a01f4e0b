"""SQL, for DuckDB, of what the lexer and the clone pipeline give."""

from __future__ import annotations

from twinweave.config import ScanConfig
from twinweave.operators.lexer import BASES, M61
from twinweave.sources.languages import languages


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def language_table() -> str:
    """VALUES of (ext, name, style, keywords); style tells comment marks apart."""
    rows = []
    for x in languages():
        style = {"//": "c", "#": "p", "": "h"}[x.line_comment]
        kws = "[" + ", ".join(map(_text, x.keywords)) + "]::VARCHAR[]"
        rows += [f"({_text(e)}, {_text(x.name)}, '{style}', {kws})" for e in x.extensions]
    return "(VALUES " + ", ".join(rows) + ") AS l(ext, name, style, kws)"


_STRINGS = "|".join(rf"{q}(?:\\[\s\S]|[^{q}\\])*(?:{q}|\\?\z)" for q in ("\"", "''", "`"))
_REST = rf"{_STRINGS}|[0-9][0-9A-Za-z._]*|[\p{{L}}_][\p{{L}}\p{{N}}_]*|[\s\S]"
_SPACE = r"[\s\x{0b}\x{85}\p{Z}]+"
_STYLES = {"c": rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "p": r"#[^\n]*", "h": r"<!--[\s\S]*?(?:-->|\z)"}

FILE_EXTENSION = r"lower(regexp_extract(replace(path, '\', '/'), '(?:^|/)[^/]+\.([^./]+)$', 1))"


def ctes(config: ScanConfig) -> str:
    """files, tokens, kgrams and fingerprints of source_files, as common table expressions (without WITH)."""
    keep = "content IS NOT NULL" + "".join(f" AND NOT contains(path, {_text(p)})" for p in config.ignore_patterns)
    if config.languages:
        keep += " AND l.name IN (" + ", ".join(map(_text, config.languages)) + ")"
    lex = " UNION ALL ".join(f"SELECT file_idx, kws, style, regexp_extract_all(content, '{_SPACE}|{p}|{_REST}') AS ls FROM files WHERE style = '{s}'" for s, p in _STYLES.items())
    text = "4096 + ('0x' || substr(md5(lex), 1, 12))::BIGINT"
    free = lambda n: str(n) if config.detect_type2 else text
    k, w = config.k, config.w
    hashed = ", ".join(f"list_reduce(g, lambda a, x: (a * {b}::HUGEINT + x) % {M61}::HUGEINT)::BIGINT AS h{i + 1}" for i, b in enumerate(BASES))
    return rf"""
    files AS (SELECT f.file_idx, f.content, l.name, l.style, l.kws FROM source_files f JOIN {language_table()} ON l.ext = {FILE_EXTENSION} WHERE {keep}),
    lexed AS ({lex}),
    lexemes AS (SELECT file_idx, kws, style, unnest(ls) AS lex, unnest(range(len(ls))) AS i FROM lexed),
    placed AS (
        SELECT file_idx, i, lex, kws,
            CASE WHEN regexp_matches(lex, '^{_SPACE}$') THEN NULL
                 WHEN style = 'c' AND (starts_with(lex, '//') OR starts_with(lex, '/*')) OR style = 'p' AND starts_with(lex, '#') OR style = 'h' AND starts_with(lex, '<!--') THEN NULL
                 WHEN left(lex, 1) IN ('"', '''', '`') THEN 'string'
                 WHEN regexp_matches(lex, '^[0-9]') THEN 'number'
                 WHEN regexp_matches(lex, '^[\p{{L}}_]') THEN CASE WHEN list_contains(kws, lex) THEN 'keyword' ELSE 'identifier' END
                 ELSE 'punctuation' END AS kind,
            1 + coalesce(sum(length(lex) - length(replace(lex, chr(10), ''))) OVER before, 0) AS line_start,
            1 + coalesce(sum(length(lex) - length(replace(lex, chr(10), ''))) OVER upto, 0) AS line_end,
            coalesce(sum(strlen(lex)) OVER before, 0) AS byte_offset
        FROM lexemes
        WINDOW before AS (PARTITION BY file_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY file_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    tokens AS MATERIALIZED (
        SELECT file_idx, CAST(row_number() OVER (PARTITION BY file_idx ORDER BY i) - 1 AS INTEGER) AS pos, kind,
            CASE kind WHEN 'identifier' THEN {free(1)} WHEN 'string' THEN {free(2)} WHEN 'number' THEN {free(3)} WHEN 'keyword' THEN 999 + list_position(kws, lex) ELSE 2000 + (unicode(lex) & 255) END::BIGINT AS tok,
            CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(byte_offset AS BIGINT) AS byte_offset
        FROM placed WHERE kind IS NOT NULL),
    framed AS (
        SELECT file_idx, pos, list(tok::HUGEINT) OVER f AS g, line_start, last_value(line_end) OVER f AS line_end, byte_offset
        FROM tokens WINDOW f AS (PARTITION BY file_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
    kgrams AS MATERIALIZED (SELECT file_idx, pos, {hashed}, line_start, line_end, byte_offset FROM framed WHERE len(g) = {k}),
    sized AS (
        SELECT *, count(*) OVER (PARTITION BY file_idx) AS n, max(CASE WHEN pos = 0 THEN row(h1, h2) END) OVER (PARTITION BY file_idx) AS s0, max(CASE WHEN pos = {w - 1} THEN row(h1, h2) END) OVER (PARTITION BY file_idx) AS sw FROM kgrams),
    floored AS (SELECT *, CASE WHEN n >= {w} AND sw <= s0 THEN {w - 1} ELSE 0 END AS low FROM sized),
    keyed AS (SELECT *, CASE WHEN pos >= low THEN row(h1, h2, -pos) END AS key FROM floored),
    least AS (SELECT file_idx, pos, n, low, CASE WHEN n < {w} THEN min(key) OVER (PARTITION BY file_idx) ELSE min(key) OVER (PARTITION BY file_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) END AS m FROM keyed),
    chosen AS (SELECT DISTINCT file_idx, -m[3] AS pos FROM least WHERE n < {w} OR (pos <= n - {w} AND NOT (low = 0 AND pos = 0))),
    prints AS MATERIALIZED (SELECT k.* FROM kgrams k JOIN chosen c ON c.file_idx = k.file_idx AND c.pos = k.pos)"""


def pair_ctes(config: ScanConfig, where: str = "true") -> str:
    """raw and merged pairs, of which where holds, and clone pairs; to follow ctes() in WITH RECURSIVE."""
    k = config.k
    self_ = "OR (a.file_idx = b.file_idx AND a.pos < b.pos AND (a.line_start > b.line_end OR b.line_start > a.line_end))" if config.scan_self else ""
    span = lambda f, s, e: f"(SELECT count(*) FROM tokens t WHERE t.file_idx = i.{f} AND t.line_start >= i.{s} AND t.line_end <= i.{e})"
    return f"""
    raw AS MATERIALIZED (
        SELECT a.file_idx AS file_a, a.pos AS pos_a, a.line_start AS start_a, a.line_end AS end_a, b.file_idx AS file_b, b.pos AS pos_b, b.line_start AS start_b, b.line_end AS end_b, a.h1, a.h2
        FROM prints a JOIN prints b ON a.h1 = b.h1 AND a.h2 = b.h2 WHERE (a.file_idx < b.file_idx {self_}) AND {where}),
    numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file_a, file_b ORDER BY start_a, start_b, end_a, end_b, h1, h2) AS rn FROM raw),
    fold AS (
        SELECT file_a, file_b, rn, 1 AS isle, start_a, end_a, start_b, end_b, h1, h2 FROM numbered WHERE rn = 1
        UNION ALL
        SELECT p.file_a, p.file_b, n.rn, CASE WHEN ok THEN isle ELSE isle + 1 END, CASE WHEN ok THEN p.start_a ELSE n.start_a END, CASE WHEN ok THEN greatest(p.end_a, n.end_a) ELSE n.end_a END,
            CASE WHEN ok THEN p.start_b ELSE n.start_b END, CASE WHEN ok THEN greatest(p.end_b, n.end_b) ELSE n.end_b END, CASE WHEN ok THEN p.h1 ELSE n.h1 END, CASE WHEN ok THEN p.h2 ELSE n.h2 END
        FROM fold p JOIN numbered n ON n.file_a = p.file_a AND n.file_b = p.file_b AND n.rn = p.rn + 1,
            LATERAL (SELECT n.start_a <= p.end_a + 3 AND n.start_b <= p.end_b + 3 AND NOT (p.file_a = p.file_b AND CASE WHEN p.start_a <= p.start_b THEN greatest(p.end_a, n.end_a) >= p.start_b ELSE greatest(p.end_b, n.end_b) >= p.start_a END) AS ok)),
    merged AS MATERIALIZED (SELECT file_a, file_b, start_a, end_a, start_b, end_b, h1, h2, n_raw FROM (SELECT *, count(*) OVER g AS n_raw, row_number() OVER (PARTITION BY file_a, file_b, isle ORDER BY rn DESC) AS r FROM fold WINDOW g AS (PARTITION BY file_a, file_b, isle)) WHERE r = 1),
    counted AS MATERIALIZED (SELECT i.*, {span("file_a", "start_a", "end_a")} AS tokens_a, {span("file_b", "start_b", "end_b")} AS tokens_b FROM merged i),
    found AS (
        SELECT fa.path AS file_a, start_a AS start_line_a, end_a AS end_line_a, fb.path AS file_b, start_b AS start_line_b, end_b AS end_line_b, greatest({k}, least(tokens_a, tokens_b)) AS token_count, CAST(1.0 AS DOUBLE) AS similarity,
            printf('%x-%x', c.h1, c.h2) AS fragment_hash, 'Exact' AS clone_type, CAST(NULL AS VARCHAR) AS author_a, CAST(NULL AS VARCHAR) AS author_b
        FROM counted c JOIN source_files fa ON fa.file_idx = c.file_a JOIN source_files fb ON fb.file_idx = c.file_b WHERE greatest({k}, least(tokens_a, tokens_b)) >= {config.min_tokens}
        QUALIFY row_number() OVER (PARTITION BY c.file_a, c.file_b, start_a, end_a, start_b, end_b ORDER BY c.h1, c.h2) = 1)"""
