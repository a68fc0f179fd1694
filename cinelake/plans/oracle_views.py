"""The fixture views of ``views.py`` as DuckDB SQL, for the oracle queries.

``with_views(body)`` finds the ``v_*`` names a query body uses and prefixes
the needed definitions (transitively, in dependency order) as CTEs.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_ratings_raw": """
        SELECT o.o_custkey AS user_id, l.l_suppkey AS item_id,
               CAST(floor((l.l_quantity - 1) / 5) * 0.5 + 0.5 AS DOUBLE) AS rating,
               l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "v_ratings": """
        SELECT user_id, item_id, rating FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                                       ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS rn_
          FROM v_ratings_raw) WHERE rn_ = 1""",
    "v_titles": """
        SELECT p_partkey AS item_id,
          (CASE WHEN p_partkey % 23 = 0 THEN '  ' ELSE '' END) || p_name
          || (CASE p_partkey % 4 WHEN 0 THEN ', The' WHEN 1 THEN ', A' WHEN 2 THEN ', An' ELSE '' END)
          || (CASE WHEN p_partkey % 17 = 3 THEN ' (a.k.a. ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ')'
                   WHEN p_partkey % 17 = 5 THEN ' (a.k.a. ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
                                                || ') (a.k.a. ' || upper(split_part(p_name, ' ', 1)) || ')'
                   ELSE '' END)
          || (CASE WHEN p_partkey % 50 = 7 THEN '' ELSE ' (' || CAST(1930 + p_partkey % 90 AS VARCHAR) || ')' END)
          || (CASE WHEN p_partkey % 23 = 0 THEN '  ' ELSE '' END) AS title,
          CAST(p_partkey * 7919 AS VARCHAR) AS imdb_raw
        FROM part""",
    "v_clean_titles": """
        SELECT item_id,
          (CASE WHEN ends_with(nm_, ', The') THEN 'The ' || left(nm_, length(nm_) - 5)
                WHEN ends_with(nm_, ', A') THEN 'A ' || left(nm_, length(nm_) - 3)
                WHEN ends_with(nm_, ', An') THEN 'An ' || left(nm_, length(nm_) - 4)
                ELSE nm_ END) || ' ' || right(t_, 6) AS title,
          year,
          'tt' || (CASE WHEN length(imdb_raw) >= 7 THEN imdb_raw ELSE lpad(imdb_raw, 7, '0') END) AS imdb_id
        FROM (
          SELECT item_id, t_, imdb_raw, left(t_, greatest(length(t_) - 7, 0)) AS nm_,
                 CAST(nullif(regexp_extract(t_, '\\((\\d{4})\\)$', 1), '') AS INTEGER) AS year
          FROM (SELECT item_id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS t_, imdb_raw FROM v_titles))
        WHERE year IS NOT NULL""",
    "v_movies": """
        SELECT c.item_id, c.title, c.year, c.imdb_id, p.popularity,
               row_number() OVER (ORDER BY p.popularity DESC, c.item_id) AS pop_rank
        FROM v_clean_titles c JOIN (SELECT item_id, count(*) AS popularity FROM v_split WHERE split = 'train' GROUP BY item_id) p
          ON c.item_id = p.item_id""",
    "v_titled": "SELECT * FROM v_ratings WHERE item_id IN (SELECT item_id FROM v_clean_titles)",
    "v_active": """
        SELECT * FROM v_titled WHERE user_id IN (
          SELECT user_id FROM v_titled WHERE item_id IN (SELECT item_id FROM v_clean_titles WHERE year >= 2015))""",
    "v_popular": "SELECT * FROM v_active WHERE item_id IN (SELECT item_id FROM v_active GROUP BY item_id HAVING count(*) >= 20)",
    "v_test_users": """
        SELECT user_id FROM (SELECT user_id FROM v_popular GROUP BY user_id HAVING count(*) >= 25)
        ORDER BY md5(CAST(user_id AS VARCHAR) || ':42'), user_id LIMIT 1000""",
    "v_split": """
        SELECT user_id, item_id, rating,
               CASE WHEN user_id IN (SELECT user_id FROM v_test_users) THEN 'test' ELSE 'train' END AS split
        FROM v_popular""",
    "v_tags": """
        SELECT row_number() OVER (ORDER BY tag) AS id, tag FROM (SELECT DISTINCT p_name AS tag FROM part)""",
    "v_tag_count": """
        SELECT l.l_suppkey AS item_id, t.id AS tag_id, count(*) AS num
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN v_tags t ON p.p_name = t.tag
        GROUP BY l.l_suppkey, t.id""",
    "v_requests": """
        SELECT c_custkey AS request_id, c_custkey AS user_id,
               CASE WHEN c_custkey % 70 = 0 THEN 'n/a' ELSE CAST(c_custkey % 121 - 10 AS VARCHAR) END AS importance
        FROM customer""",
    "v_request_ratings": """
        SELECT q.request_id,
               CAST(row_number() OVER (PARTITION BY q.request_id ORDER BY r.item_id) AS INTEGER) AS pos,
               r.item_id, r.rating
        FROM v_ratings r JOIN v_requests q ON r.user_id = q.user_id
        WHERE q.request_id % 7 <> 0""",
    "v_request_tags": """
        SELECT DISTINCT request_id, (request_id * 5 + k * 13) % (SELECT count(*) FROM v_tags) + 1 AS tag_id
        FROM v_requests, (VALUES (0), (1), (2), (3)) ks(k) WHERE request_id % 11 <> 0""",
    "v_form_ratings": """
        SELECT request_id, pos,
          CASE WHEN m_ = 0 THEN '-' || CAST(item_id AS VARCHAR)
               WHEN m_ = 1 THEN CAST(item_id + 100000 AS VARCHAR)
               ELSE CAST(item_id AS VARCHAR) END AS movie_id,
          CASE WHEN m_ = 2 THEN '4.5' WHEN m_ = 3 THEN '7' WHEN m_ = 4 THEN ''
               ELSE CAST(CAST(ceil(rating) AS BIGINT) AS VARCHAR) END AS rating
        FROM (SELECT *, (request_id // 10 + pos) % 9 AS m_ FROM v_request_ratings)
        UNION ALL
        SELECT request_id, CAST(pos + 1000 AS INTEGER), CAST(item_id AS VARCHAR),
               CAST(5 - CAST(ceil(rating) AS BIGINT) % 5 AS VARCHAR)
        FROM v_request_ratings WHERE pos % 4 = 0""",
    "v_form_tags": """
        SELECT request_id, CAST(tag_id AS VARCHAR) AS tag_id FROM v_request_tags
        UNION ALL
        SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'x1' ELSE '99999' END FROM v_requests WHERE request_id % 3 = 0
        UNION ALL
        SELECT request_id, CAST(tag_id AS VARCHAR) FROM v_request_tags WHERE tag_id % 5 = 0""",
    "v_answers": """
        SELECT row_number() OVER (ORDER BY conv_id, turn) AS answer_id, conv_id AS user_id,
          CASE WHEN conv_id % 7 = 0 THEN lft_
               WHEN conv_id % 7 = 1 THEN lft_ || ' --- ' || prefs_ || ' --- more'
               WHEN conv_id % 7 = 2 THEN '<EMPTY> --- ' || prefs_
               WHEN conv_id % 7 = 3 THEN lft_ || ' --- <EMPTY>.'
               WHEN conv_id % 7 = 4 THEN n1_ || ': good;;;' || n2_ || ': ' || r2_ || ' --- ' || prefs_
               ELSE lft_ || chr(10) || '---' || chr(10) || ' ' || prefs_ || ' ' END AS answer
        FROM (
          SELECT *, n1_ || ': ' || r1_ || ';;;' || n2_ || ': ' || r2_ AS lft_,
                 'I want something like ' || split_part(n1_, ' ', 1) || '. ' || text AS prefs_
          FROM (
            SELECT c.conv_id, c.turn, c.text,
              split_part(left(a.title, greatest(length(a.title) - 7, 0)), ' (a.k.a. ', 1) AS n1_,
              split_part(left(b.title, greatest(length(b.title) - 7, 0)), ' (a.k.a. ', 1) AS n2_,
              CAST((c.conv_id + c.turn) % 5 + 1 AS VARCHAR) AS r1_,
              CAST((c.conv_id * 3 + c.turn) % 5 + 1 AS VARCHAR) AS r2_
            FROM conversations c
            JOIN v_clean_titles a ON (c.conv_id * 13 + c.turn) % (SELECT count(*) FROM part) = a.item_id
            JOIN v_clean_titles b ON (c.conv_id * 7 + c.turn * 3 + 1) % (SELECT count(*) FROM part) = b.item_id
            WHERE c.role = 'assistant'))""",
    "v_transcripts": """
        SELECT conv_id, string_agg(text, '<LINEBREAK>' ORDER BY turn) || '<LINEBREAK>' AS transcript
        FROM conversations GROUP BY conv_id""",
    "v_rating_events": """
        SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_key,
               CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
               CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INTEGER) AS rating
        FROM events""",
    "v_posters": """
        SELECT source || '/' || CAST(doc_id // 1000 AS VARCHAR) AS item, lang AS iso_639_1, n_chars % 50 AS vote_count,
               CAST(doc_id % 10 AS DOUBLE) AS vote_average, '/p/' || CAST(doc_id AS VARCHAR) || '.jpg' AS file_path, doc_id AS pos
        FROM documents""",
    "v_links": """
        SELECT imdb_ AS imdbId, CAST(p_partkey + 100000 AS VARCHAR) AS tmdbId, p_partkey * 2 AS line FROM (
          SELECT p_partkey, CASE WHEN length(CAST(p_partkey * 7919 AS VARCHAR)) >= 7 THEN CAST(p_partkey * 7919 AS VARCHAR)
                                 ELSE lpad(CAST(p_partkey * 7919 AS VARCHAR), 7, '0') END AS imdb_
          FROM part WHERE p_partkey % 11 <> 0)
        UNION ALL
        SELECT imdb_, CAST(p_partkey + 200000 AS VARCHAR), p_partkey * 2 + 1 FROM (
          SELECT p_partkey, CASE WHEN length(CAST(p_partkey * 7919 AS VARCHAR)) >= 7 THEN CAST(p_partkey * 7919 AS VARCHAR)
                                 ELSE lpad(CAST(p_partkey * 7919 AS VARCHAR), 7, '0') END AS imdb_
          FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 = 0)""",
    "v_plots": """
        SELECT b.item_id AS plot_id, b.year,
               CASE WHEN b.item_id % 7 = 1 THEN b.short_ || ' (aka ' || upper(b.short_) || ')' ELSE b.short_ END AS title,
               d.text AS plot
        FROM (SELECT item_id, year,
                     substring(split_part(left(title, greatest(length(title) - 7, 0)), ' (a.k.a. ', 1),
                               CAST(1 + item_id % 5 AS INTEGER)) AS short_
              FROM v_clean_titles WHERE item_id % 3 <> 0) b
        JOIN documents d ON b.item_id % (SELECT count(*) FROM documents) = d.doc_id""",
    "v_search_terms": """
        SELECT id AS term_id,
          CASE WHEN id % 16 = 1 THEN '  '
               WHEN id % 16 = 2 THEN substring(split_part(tag, ' ', 1), 1, 1) || '%' || substring(split_part(tag, ' ', 2), 1, 1)
               WHEN id % 16 = 3 THEN tag
               WHEN id % 16 = 4 THEN upper(substring(split_part(tag, ' ', 2), 2, 3))
               ELSE substring(split_part(tag, ' ', 1), 1, 3) END AS term
        FROM v_tags""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS]


def with_views(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for every fixture view it (transitively) uses.

    ``extra`` are query-local CTEs (name, sql) placed after the views.
    """
    order: list[str] = []
    seen: set[str] = set()

    def visit(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for dep in _deps(VIEWS[name]):
            visit(dep)
        order.append(name)

    texts = [body] + [sql for _, sql in (extra or [])]
    for t in texts:
        for n in _deps(t):
            visit(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in (extra or [])]
    if not ctes:
        return body
    head = "WITH RECURSIVE " if any("(" in n for n, _ in (extra or [])) else "WITH "
    return head + ",\n".join(ctes) + "\n" + body
