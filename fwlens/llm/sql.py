"""SQL counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

import re

from fwlens.llm import quality_rules, sharding

_RULES = quality_rules.LineRules()
_CLOSED = rf"[{quality_rules.MARKS}][{re.escape(quality_rules.CLOSERS)}]*$".replace("'", "''")

_FAR = 1 << 50
CRC_TABLE = """crc_table AS (
    SELECT list(c ORDER BY b) AS t
    FROM (SELECT b, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS c
          FROM (SELECT b::BIGINT AS b FROM range(256) r(b))))"""


OP2 = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + {_RULES.window - 1}], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - {_RULES.window - 2})) AS i FROM docs WHERE len(words) >= {_RULES.window})),
again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT doc_id, sum(least({_RULES.window}, coalesce(next_i - i, {_RULES.window}))) AS n_repeat_words
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i FROM again) GROUP BY doc_id),
line_rows AS (
    SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
    FROM (SELECT doc_id, unnest(lines) AS line FROM docs)),
line_facts AS (
    SELECT doc_id, line, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n,
           len(regexp_extract_all(line, '[#*$%&<>!~=^_]')) AS marks, len(regexp_extract_all(line, '[|»•·]')) AS separators
    FROM line_rows),
kept_lines AS (
    SELECT doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS kept_chars
    FROM line_facts
    WHERE regexp_matches(t, '{_CLOSED}')
      AND marks * 100 <= n * {_RULES.marks_per_100_words} AND separators * 100 <= n * {_RULES.separators_per_100_words}
      AND NOT (n <= {_RULES.boilerplate_max_words} AND regexp_matches(lower(line), '{"|".join(quality_rules.BOILERPLATE)}'))
    GROUP BY doc_id),
counts AS (
    SELECT d.doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(k.kept_chars, 0)::BIGINT AS kept_chars
    FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN kept_lines k USING (doc_id)),
failed AS (
    SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars * 100 >= word_chars * {100 - _RULES.lost_percent} AS kept, kept_chars
FROM failed
"""


def _shard_sql(shards: int = 8, seed: int = sharding.SEED) -> str:
    keys = sharding.round_keys(seed)
    factor, summand = ([pair[i] for pair in keys] for i in (0, 1))
    last = len(keys)
    return f"""
WITH RECURSIVE
{CRC_TABLE},
docs AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
           xor(list_reduce(
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
               lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM documents, crc_table),
counted AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no, count(*) OVER () AS n FROM docs),
sided AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE ceil(sqrt(n))::BIGINT END AS wide FROM counted),
steps AS (
    SELECT row_no, n, wide, (n + wide - 1) // wide AS high, row_no % wide AS l, row_no // wide AS r, 0 AS i FROM sided
    UNION ALL
    SELECT row_no, n, wide, high, r,
           (l + xor(r * ({factor}::BIGINT[])[i % {last} + 1] + ({summand}::BIGINT[])[i % {last} + 1],
                    (r * ({factor}::BIGINT[])[i % {last} + 1] + ({summand}::BIGINT[])[i % {last} + 1]) >> 16))
           % (CASE WHEN i % 2 = 1 THEN high ELSE wide END), i + 1
    FROM steps WHERE i = 0 OR i % {last} > 0 OR l + wide * r >= n),
done AS (SELECT row_no, l + wide * r AS position FROM steps WHERE i > 0 AND i % {last} = 0 AND l + wide * r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position % {shards})::INTEGER AS shard, position // {shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, row_no
FROM counted JOIN done USING (row_no)
"""


OP13 = rf"""
WITH RECURSIVE
{CRC_TABLE},
keyed AS (
    SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (
    SELECT *, xor(list_reduce(
                list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda x: ('0x' || x)::BIGINT),
                lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS d
    FROM keyed, crc_table),
hit AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
           CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
    FROM dealt WHERE d <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM ordered),
faulted AS (
    SELECT *, left(role, 1) AS c,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3 WHEN seen > 1 THEN 2
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS fault
    FROM placed),
paired AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS c_before FROM faulted),
counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 3) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
           count(*) FILTER (WHERE fault = 1) AS truncated,
           count(*) FILTER (WHERE c_before IS NOT NULL AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal
    FROM paired GROUP BY conv_id),
back AS (
    SELECT conv_id, n + 1 AS i, 0::BIGINT AS v0, 10::BIGINT AS v1, 5::BIGINT AS v2, 0::BIGINT AS v3 FROM counted
    UNION ALL
    SELECT conv_id, i, least(p0, 5 + p2, 10 + p3), least(p1, 5 + p2, 10 + p3), least(p2, 5 + p3), least(p3, 5 + p2)
    FROM (
        SELECT b.conv_id, f.i,
               least(2 + v0, e + least(1 + v2, CASE c WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE {_FAR} END)) AS p0,
               least(2 + v1, e + least(1 + v2, CASE c WHEN 'u' THEN v2 ELSE {_FAR} END)) AS p1,
               least(2 + v2, e + least(1 + v3, CASE c WHEN 'a' THEN v3 ELSE {_FAR} END)) AS p2,
               least(2 + v3, e + least(1 + v2, CASE c WHEN 'u' THEN v2 ELSE {_FAR} END)) AS p3
        FROM back b
        JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE {_FAR} END AS e FROM faulted) f
          ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)),
vectors AS (SELECT conv_id, i, [v0, v1, v2, v3] AS v, lead([v0, v1, v2, v3]) OVER (PARTITION BY conv_id ORDER BY i) AS w FROM back),
steps AS (
    SELECT g.conv_id, g.i, g.v, g.w, f.c, f.role, f.text, CASE f.fault WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE {_FAR} END AS e
    FROM vectors g LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i),
walk AS (
    SELECT conv_id, 1::BIGINT AS i, 0 AS s, '' AS audit, '' AS body, false AS stop FROM counted
    UNION ALL
    SELECT conv_id, CASE WHEN edit = 'I' OR edit = '' THEN i ELSE i + 1 END,
           CASE WHEN edit IN ('D', '') THEN s WHEN edit = 'K' THEN kept ELSE onward END, audit || edit,
           CASE WHEN edit IN ('D', '') THEN body ELSE body || CASE WHEN audit = repeat('D', length(audit)) THEN '' ELSE chr(10) END
               || CASE WHEN edit = 'K' THEN role WHEN onward = 2 THEN 'user' ELSE 'assistant' END || ':'
               || CASE WHEN edit = 'I' THEN '' ELSE text END END,
           edit = ''
    FROM (
        SELECT *, CASE WHEN w IS NULL THEN CASE WHEN s IN (0, 3) THEN '' ELSE 'I' END
                       WHEN v[s + 1] = 2 + w[s + 1] THEN 'D' WHEN v[s + 1] = 5 + v[onward + 1] THEN 'I'
                       WHEN kept IS NOT NULL AND v[s + 1] = e + w[kept + 1] THEN 'K' ELSE 'R' END AS edit
        FROM (
            SELECT k.conv_id, k.i, k.s, k.audit, k.body, t.v, t.w, t.e, t.role, t.text, CASE k.s WHEN 2 THEN 3 ELSE 2 END AS onward,
                   CASE WHEN t.c = 's' AND k.s = 0 THEN 1 WHEN t.c = 'u' AND k.s <> 2 THEN 2 WHEN t.c = 'a' AND k.s = 2 THEN 3 END AS kept
            FROM walk k JOIN steps t ON t.conv_id IS NOT DISTINCT FROM k.conv_id AND t.i = k.i
            WHERE NOT k.stop)))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.v0, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
LEFT JOIN walk k ON k.conv_id IS NOT DISTINCT FROM o.conv_id AND k.stop
"""


def _components(nodes: str, links: str) -> str:
    """``components``: node and its smallest reachable node, from ``nodes(id)`` and ``links(a, b)``."""
    return f"""
either AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
reached AS (
    SELECT id, id AS least FROM {nodes}
    UNION
    SELECT b, least FROM reached JOIN either ON either.a = reached.id WHERE least < b),
components AS (SELECT id, min(least) AS component_id FROM reached GROUP BY id)"""


OP1 = f"""
WITH RECURSIVE
vectors AS (
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT p.id AS a, q.id AS b FROM vectors p JOIN vectors q ON p.id < q.id AND len(p.v) = len(q.v)
    WHERE list_cosine_similarity(p.v, q.v) >= 0.9),
{_components("vectors", "links")},
counted AS (SELECT a AS id, count(*) AS n FROM either GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id = vec_id, true) AS kept
FROM embeddings LEFT JOIN components c ON c.id = vec_id LEFT JOIN counted t ON t.id = vec_id
"""


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP6 = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(i, i + 20)) AS place FROM later)),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
kept AS (
    SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.place) AS body
    FROM placed p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.place = p.place WHERE c.place IS NULL GROUP BY p.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


OP9 = f"""
WITH RECURSIVE
docs AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id AS id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
{_components("sizes", "links")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id = doc_id, true) AS kept,
       CASE WHEN n IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(words, ' ')) END AS class_id
FROM docs LEFT JOIN sizes ON sizes.id = doc_id LEFT JOIN components c ON c.id = doc_id
"""


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sized),
held AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
weighted AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, docs),
damped AS (SELECT r, doc_id, 25 + (75 * n * docs) // words AS m FROM sized, totals),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scored AS (
    SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weighted USING (term) JOIN held USING (term) JOIN damped USING (r) GROUP BY q, item_id, doc_id, r),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


ORACLES = {"op1_pca_tiles": OP1, "op2_quality_rules": OP2, "op6_prefix_trees": OP6, "op9_minhash": OP9, "op10_feistel_shards": _shard_sql(), "op11_geometric_blocks": OP11,
           "op13_conversation_repair": OP13}
