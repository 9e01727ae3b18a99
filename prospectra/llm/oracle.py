"""SQL that the queries of this package are held against, where SQL can express them."""

from __future__ import annotations


def vector_codes_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds over all parts and entries, in integers; a distance and its entry are one number, so that ties go to the lower."""
    steps = [
        """kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS MATERIALIZED (
            SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM kept, range(4) AS t(part))""",
        "book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts QUALIFY entry < 256)",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
            SELECT vec_id, part, any_value(x) AS x,
                   min((list_inner_product(x::DOUBLE[], x::DOUBLE[]) - 2 * list_inner_product(x::DOUBLE[], c::DOUBLE[]) + list_inner_product(c::DOUBLE[], c::DOUBLE[]))::BIGINT * 256 + entry) AS best
            FROM parts JOIN book{k} USING (part) GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
                SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY j) AS c
                FROM (SELECT part, best % 256 AS entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS j) GROUP BY ALL)
                GROUP BY ALL)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    return f"""
        WITH {', '.join(steps)},
        coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


SOURCE_DIVERGENCE = r"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (
        SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM docs),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
    counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, any_value(total) AS total FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
    langs AS (SELECT lang, coalesce(kept_terms, 0) AS v, coalesce(occurrences, 0) AS lang_n
              FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS kept_terms, sum(total) AS occurrences FROM kept GROUP BY lang) USING (lang)),
    groups AS MATERIALIZED (SELECT lang, source, v, lang_n, coalesce(n, 0) AS group_n
              FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) USING (lang, source)),
    shares AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (group_n + v)::HUGEINT AS p,
               1 + 1000000000::HUGEINT * (k.total + 1) // (lang_n + v)::HUGEINT AS q
        FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (
        SELECT g.lang, g.source, o.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
        LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                   FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
    terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms QUALIFY rank <= 200"""
