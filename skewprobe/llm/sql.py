"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

# A-Z only; the white space that ends a word.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH parts AS (
  SELECT page_id,
    {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(r_host, r_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT p.page_id, p.host, p.path,
    (SELECT max_by(struct_pack(rule := r_host || r_path, action := action), length(r_host || r_path))
     FROM rules
     WHERE (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)) AS best
  FROM parts p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""

OP5 = rf"""
WITH docs AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source
), filled AS (
  SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS "full",
    CAST(sum(source_size) OVER () AS DOUBLE) AS wanted
  FROM sizes
), levels AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER ahead, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0.0)) AS level
  FROM filled
  WINDOW ahead AS (ORDER BY "full" NULLS LAST, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT *, CASE WHEN lvl IS NULL OR "full" <= lvl THEN CAST(cap AS DOUBLE) ELSE weight * lvl END AS target
  FROM (SELECT *, (SELECT arg_min(level, ("full", source)) FROM levels WHERE level < "full") AS lvl FROM levels)
), ratios AS (
  SELECT *, floor(ratio) AS whole, greatest(target - floor(ratio) * source_size, 0.0) AS rest, ratio - floor(ratio) AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM plan)
), drawn AS (
  SELECT doc_id, d.source, size, source_size, target, whole, rest,
    CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS quotient
  FROM (SELECT *, (CAST('0x' || substr(md5('0|' || coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
               / 4503599627370496.0::DOUBLE AS u FROM docs) d
  JOIN ratios r ON d.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY quotient, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM drawn
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN quotient IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ranked
"""

# The control strings of the template in their fixed order.
_CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(text: str) -> str:
    text = f"replace({text}, '~', '~0')"
    for code, control in zip("abcdefgh", _CONTROL, strict=True):
        text = f"replace({text}, '{control}', '~{code}')"
    return text


OP6 = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), near AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last_role FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")})
    + CASE WHEN last_role = role THEN 8 ELSE 11 + length({_escaped("role")}) END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, " + _SPACES + ")")} AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.u LEFT JOIN counts c ON e.vec_id = c.u
"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), spans AS (
  SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS start
  FROM words, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size
), counts AS (
  SELECT lang, list_slice(w, start, start + size - 1) AS phrase, size, CAST(count(*) AS BIGINT) AS a
  FROM spans GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r,
    CAST((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM counts WHERE size > 1) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = list_slice(c.phrase, 1, k)
  JOIN counts r ON r.lang = c.lang AND r.phrase = list_slice(c.phrase, k + 1, c.size)
), best AS (
  SELECT lang, phrase, size, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut FROM cuts GROUP BY ALL
), around AS (
  SELECT lang, list_slice(phrase, start, start + part - 1) AS phrase, max(a) AS a
  FROM (SELECT *, unnest(generate_series(1, size - part + 1)) AS start
        FROM (SELECT *, unnest(generate_series(2, size - 1)) AS part FROM counts WHERE size > 2))
  GROUP BY ALL
), kept AS (
  SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, b.a, b.cut.l AS l, b.cut.r AS r, b.cut.score AS score
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

# The failure conditions of the five filters, in their fixed order.
_FAILS = (
    "len(w) < 50",
    "100 * len(list_distinct(w)) < 65 * len(w)",
    "100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)",
    "regexp_matches(text, '[#$%&*|]')",
    "doc_id > min(doc_id) OVER (PARTITION BY text)",
)
OP12 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
), marks AS (
  SELECT doc_id, part, {", ".join(f"({c}) AS {n}" for n, c in zip("ABCDE", _FAILS, strict=True))} FROM texts
), known AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * coalesce(E, false)::INT AS mask, count(*) AS n,
    count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM marks LEFT JOIN known USING (doc_id) GROUP BY ALL
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(x),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(x),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS filter,
    CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS one,
    CAST(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> '']) AS INT) AS before
  FROM orders, generate_series(1, 5) AS s(step)
), counts AS (
  SELECT part, filter_order, step, filter,
    CAST(sum(n) FILTER (WHERE mask & (coalesce(before, 0) | one) = 0) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & one <> 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (WHERE mask & coalesce(before, 0) <> 0 AND mask & one <> 0) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (WHERE mask = one) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & one <> 0) AS BIGINT) AS good_lost,
    CAST(sum(toxic) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & one <> 0) AS BIGINT) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
  coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM counts
"""

ORACLE = {
    "op1_url_filter": OP1,
    "op5_mixing": OP5,
    "op6_chat_format": OP6,
    "op7_line_dedup": OP7,
    "op8_vector_groups": OP8,
    "op11_phrases": OP11,
    "op12_filter_audit": OP12,
}
