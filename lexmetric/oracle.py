"""DuckDB twins of the stand-in frames (see ``lexmetric.standins``).

Each constant is the body of a CTE; ``with_ctes`` strings them together.
The word split uses the same ASCII whitespace class as the Spark side.
"""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r ]"

LANGS_SQL = "['fr', 'es', 'ar', 'de', 'en', 'ja']"

CTES: dict[str, str] = {
    "samples": r"""
        SELECT doc_id AS sample_id, doc_id AS pos, text, source AS sem_type, lang AS language,
               list_filter(string_split_regex(text, '""" + WS + r"""+'), lambda x: x <> '') AS tokens,
               array_to_string(list_filter(string_split_regex(text, '""" + WS + r"""+'),
                                           lambda x: x <> ''), ' ') AS label
        FROM documents""",
    "preds": r"""
        SELECT s.*, tokens AS ref_tokens,
               list_filter(tokens, lambda x, i: (i - 1 + sample_id) % 7 <> 0) AS hyp_tokens,
               array_to_string(list_filter(tokens, lambda x, i: (i - 1 + sample_id) % 7 <> 0), ' ')
                   AS generated
        FROM samples s""",
    "codes": "SELECT doc_id AS pos, CAST(quality AS VARCHAR) AS code FROM labels",
    "scored": r"""
        SELECT p.*, c.code,
               CASE WHEN generated = label THEN 1 ELSE 0 END AS correct,
               CASE WHEN len(ref_tokens) > 0 THEN
                   greatest(len(list_filter(range(1, len(ref_tokens) + 1),
                                            lambda i: ref_tokens[i] = hyp_tokens[i]))
                            - greatest(len(ref_tokens) - len(hyp_tokens), 0), 0)::DOUBLE
                   / len(ref_tokens) END AS partial
        FROM preds p LEFT JOIN codes c USING (pos)""",
    "hyps": """
        SELECT l_orderkey AS sample_id, l_linenumber AS beam, l_partkey AS tie1, l_suppkey AS tie2,
               -l_extendedprice / 1000 AS score, l_quantity AS length
        FROM lineitem""",
    "cands": """
        SELECT l_orderkey AS sample_id, l_linenumber AS step, l_partkey AS token_id,
               l_suppkey AS model, -(10 * l_discount + 1) AS lprob
        FROM lineitem""",
    "model_cands": """
        SELECT l_orderkey AS sample_id, l_linenumber AS step, l_partkey AS token_id, m.model,
               CASE WHEN m.model = 0 THEN -(10 * l_discount + 1)
                    WHEN m.model = 1 THEN -(10 * l_discount + 1) - l_tax
                    WHEN l_partkey % 3 = 0 THEN '-inf'::DOUBLE ELSE -(10 * l_discount + 1) / 2 END AS lprob
        FROM lineitem, (VALUES (0), (1), (2)) m(model)""",
    "broken": """
        SELECT sample_id, step, CAST(token_id % 5 AS BIGINT) AS token_id, token_id AS part, model,
               CASE WHEN model % 4 = 0 THEN 'nan'::DOUBLE WHEN model % 4 = 1 THEN '-inf'::DOUBLE ELSE lprob END AS lprob,
               CASE WHEN step <= 3 THEN CAST(step % 5 AS BIGINT) END AS forced
        FROM cands""",
    "tlog": """
        SELECT 'events' AS run, event_type AS split,
               CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS epoch, value AS loss, event_id,
               row_number() OVER (ORDER BY ts, event_id) - 1 AS step
        FROM events""",
    "attn": """
        SELECT CAST(label AS BIGINT) AS sample_id, vec_id % 2 AS model, vec_id AS head,
               CAST((i - 1) // 8 AS INTEGER) AS tgt_pos, CAST((i - 1) % 8 AS INTEGER) AS src_pos,
               CAST(x AS DOUBLE) AS attn
        FROM (SELECT vec_id, label, unnest(embedding) AS x,
                     generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "vecs": """
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id + 1)) AS vec
        FROM embeddings""",
    "memory": """
        SELECT DISTINCT text AS src_text, language, language || ':' || text AS translated
        FROM (SELECT text, unnest(""" + LANGS_SQL + """) AS language FROM documents
              WHERE doc_id % 5 <> 0)""",
    "expanded": """
        SELECT s.sample_id, s.pos * 6 + l.k - 1 AS pos, s.text, s.label, s.sem_type, l.language
        FROM samples s, (VALUES (1, 'fr'), (2, 'es'), (3, 'ar'), (4, 'de'), (5, 'en'), (6, 'ja'))
                        l(k, language)""",
    "localized": """
        SELECT e.sample_id, e.pos, e.label, e.sem_type, e.language,
               CASE WHEN e.language = 'en' THEN e.text ELSE m.translated END AS text
        FROM expanded e LEFT JOIN memory m
          ON e.text = m.src_text AND e.language = m.language AND e.language <> 'en'""",
    "pairs": """
        SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS pos, u.conv_id, u.turn,
               u.text AS src, coalesce(n.text, '') AS tgt
        FROM conversations u LEFT JOIN conversations n
          ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
        WHERE u.role = 'user'""",
    "vocab": """
        SELECT * FROM (VALUES (0, '<s>', 0, true), (1, '<pad>', 0, true), (2, '</s>', 0, true),
                              (3, '<unk>', 0, true)) v(token_id, token, n, is_special)
        UNION ALL
        SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER), token, n, false
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM samples)
              GROUP BY token HAVING token NOT IN ('<s>', '<pad>', '</s>', '<unk>'))""",
    "exploded": """
        SELECT sample_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM samples""",
    "encoded": """
        SELECT s.sample_id, s.pos, coalesce(e.ids, []::INTEGER[]) AS ids
        FROM samples s LEFT JOIN (
            SELECT x.sample_id, list(coalesce(v.token_id, 3) ORDER BY x.p) AS ids
            FROM exploded x LEFT JOIN vocab v ON x.token = v.token AND NOT v.is_special
            GROUP BY x.sample_id) e USING (sample_id)""",
}

# Which CTEs each CTE needs, so a query names only what it uses.
DEPS: dict[str, list[str]] = {
    "preds": ["samples"],
    "scored": ["preds", "codes"],
    "broken": ["cands"],
    "expanded": ["samples"],
    "localized": ["expanded", "memory"],
    "vocab": ["samples"],
    "exploded": ["samples"],
    "encoded": ["vocab", "exploded"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH a AS (...), b AS (...)`` for the named stand-ins (and extras)."""
    parts = [f"{n} AS ({CTES[n]})" for n in _closure(list(names))]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
