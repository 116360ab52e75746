"""SQL twins of those corpus queries that SQL can express."""

from __future__ import annotations

from .phrases import WINDOW
from .url_templates import LIMIT, RULES, SUPPORT, VARIABLE, WEIGHT, Z2

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
 reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""

_JSON = r"""(CASE WHEN role IS NULL THEN '""' ELSE CAST(to_json(role) AS VARCHAR) END)"""


def _escaped(x: str) -> str:
    """Length of x with a backslash for each control string and each backslash."""
    return rf"(2 * length({x}) - length(replace({x}, '\', '')) + (length({x}) - length(replace({x}, '<|', ''))) // 2 + len(regexp_extract_all({x}, '</?s>')) + len(regexp_extract_all({x}, '\[/?INST\]')) + len(regexp_extract_all({x}, '<</?SYS>>')))"


CHATS = rf"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, sum({len("<|turn|><|end|>") + 1} + {_escaped(_JSON)} + {_escaped("text")}) AS formatted_chars FROM c GROUP BY conv_id)
 SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
 t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c > 1) GROUP BY doc_id),
 m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_marks FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > 3 * greatest(n_words, 1) OR (n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)) OR 100 * n_dup_lines > 50 * greatest(n_lines, 1) OR 100 * n_marks > 30 * greatest(n_words, 1)) AS kept FROM b"""

PHRASES = rf"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
 t AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM (SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w))),
 gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM t WHERE r > 1)),
 each AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
 kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
 SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def urls() -> str:
    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    ranked = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ranked) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in ranked) + " END"
    return rf"""WITH RECURSIVE p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
 marks AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
 folded AS (SELECT host, path, CAST(count(bad) AS DOUBLE) AS labelled, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS parts FROM u LEFT JOIN marks USING (page_id) GROUP BY host, path),
 tree(host, path, labelled, bad, parts, template, level) AS (SELECT *, '', 0 FROM folded UNION ALL
  SELECT host, path, labelled, bad, parts, template || '/' || CASE WHEN NOT regexp_matches(parts[level + 1], '{VARIABLE}') AND n >= {SUPPORT} AND (b * all_n - n * all_b) * (b * all_n - n * all_b) * all_n > CAST({Z2} AS DOUBLE) * (n * (all_n - n) * (all_b * (all_n - all_b))) THEN parts[level + 1] ELSE '*' END, level + 1
  FROM (SELECT *, sum(labelled) OVER (PARTITION BY host, template, parts[level + 1]) AS n, sum(bad) OVER (PARTITION BY host, template, parts[level + 1]) AS b, sum(labelled) OVER (PARTITION BY host, template) AS all_n, sum(bad) OVER (PARTITION BY host, template) AS all_b FROM tree WHERE len(parts) > level)),
 t AS (SELECT host, path, labelled, bad, template FROM tree WHERE len(parts) = level),
 rate AS (SELECT coalesce((sum(labelled) - sum(bad)) / nullif(sum(labelled), 0), 1.0) AS r FROM t),
 x AS (SELECT host, template FROM t GROUP BY host, template HAVING (sum(labelled) - sum(bad) + {WEIGHT} * (SELECT r FROM rate)) / (sum(labelled) + {WEIGHT}) < {LIMIT})
 SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN x.template IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, template FROM u JOIN t USING (host, path) LEFT JOIN x USING (host, template)"""


_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)  # noqa: E731  letters in either case, ASCII only
_KINDS = (("assign", rf"""({"|".join([*map(_ANY, ("password", "passwd", "secret", "token")), _ANY("api") + "_?" + _ANY("key")])})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 k AS ({" UNION ALL ".join(f"SELECT doc_id, {o} AS o, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, {least} AS least FROM d" for o, (kind, pattern, group, least) in enumerate(_KINDS))}),
 s AS (SELECT doc_id, o, kind, list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k) WHERE length(v[i]) >= least),
 g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (o = {o}) AS n_{kind}" for o, (kind, *_) in enumerate(_KINDS))}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id)
 SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"secret_base": SECRETS, "op4_reply_trees": CHATS, "op6_epsilon_grid": EMBEDDINGS, "op7_quality_cascade": QUALITY, "op9_phrase_automata": PHRASES, "op10_url_templates": urls()}
