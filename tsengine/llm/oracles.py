"""SQL (DuckDB) for the queries that it can express."""

from __future__ import annotations

from tsengine.llm.common import LOWER, UPPER
from tsengine.llm.decontamination import Windows
from tsengine.llm.host_rules import RULES, Limits
from tsengine.llm.mixing import WEIGHTS, Plan
from tsengine.llm.near_duplicates import Spec
from tsengine.plans.catalog.fragments import nested, stirred
from tsengine.llm.url_filter import HOST_WORDS, RULES as URL_RULES, URL

WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str = WORD, lower: bool = False) -> str:
    value = f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text
    return f"coalesce(regexp_extract_all({value}, '{pattern}'), CAST([] AS VARCHAR[]))"


def decontaminate(spec: Windows = Windows()) -> str:
    k = spec.size
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_words("text", ITEM_WORD, True)} AS w FROM documents
), items AS (
  SELECT item_id, {_words("text", ITEM_WORD, True)} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1:s + {k}], ' ') AS win, least(len(w), {k}) AS k
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {k}, 0) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM windows
), places AS (
  SELECT rid, k, s, array_to_string(w[s + 1:s + k], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM docs JOIN sizes ON len(w) >= k)
), hits AS (
  SELECT DISTINCT p.rid, p.s, p.k, i.item_id FROM places p JOIN windows i ON p.win = i.win
), covered AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS place FROM hits) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""


def host_rules(limits: Limits = Limits()) -> str:
    few, many = limits.word_chars
    tests = {
        "short": f"n_words < {limits.min_words}",
        "repeats": f"100 * n_repeat_words > {limits.repeat_percent} * n_words",
        "symbols": f"100 * n_symbols > {limits.symbol_percent} * n_words",
        "dup_lines": f"100 * n_dup_lines > {limits.dup_line_percent} * n_lines",
        "word_length": f"word_chars < {few} * n_words OR word_chars > {many} * n_words",
    }
    flags = ", ".join(f"({tests[r]}) AS fails_{r}" for r in RULES)
    sums = ", ".join(f"sum(CAST(fails_{r} AS INT)) AS k_{r}" for r in RULES)
    means = ", ".join(f"least(greatest(sum(k_{r}) / sum(n), 1e-6), 1 - 1e-6) AS p_{r}" for r in RULES)
    shares = ", ".join(
        f"sum(n * power(k_{r} / n - m_{r}, 2)) / any_value(docs) / (any_value(p_{r}) * (1 - any_value(p_{r}))) AS v_{r}" for r in RULES
    )
    raw = ", ".join(f"sum(k_{r}) / sum(n) AS m_{r}" for r in RULES)
    thin = "(hosts / docs)"
    tie = {
        r: f"CASE WHEN {thin} < 1 THEN least(greatest((v_{r} - {thin}) / (1 - {thin}), 1e-4), 0.999) ELSE 0.5 END" for r in RULES
    }
    rates = [f"(k_{r} + p_{r} * (1 / t_{r} - 1)) / (n + (1 / t_{r} - 1))" for r in RULES]
    return rf"""
WITH worded AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, {_words("text")} AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
), repeated AS (
  SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT place) AS n_repeat_words FROM repeated GROUP BY rid
), counted AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
         coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(list_distinct(lines)), 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM worded LEFT JOIN covered USING (rid)
), flagged AS (
  SELECT *, {flags} FROM counted
), hosts AS (
  SELECT source, count(*) AS n, {sums} FROM flagged GROUP BY source
), overall AS (
  SELECT sum(n) AS docs, count(*) AS hosts, {means}, {raw} FROM hosts
), spread AS (
  SELECT {shares} FROM hosts CROSS JOIN overall
), ties AS (
  SELECT *, {", ".join(f"{tie[r]} AS t_{r}" for r in RULES)} FROM overall CROSS JOIN spread
), verdicts AS (
  SELECT source, greatest({", ".join(rates)}) <= {limits.host_rate} AS host_ok FROM hosts CROSS JOIN ties
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_short OR fails_repeats AS base_failed,
       NOT ({" OR ".join(f"fails_{r}" for r in RULES)}) AND host_ok AS kept
FROM flagged f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""


def near_duplicates(spec: Spec = Spec()) -> str:
    k = spec.shingle
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {_words("text", WORD, True)} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1:s + {k}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {k}, 0) + 1)) AS s FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {spec.percent} * (p.n + q.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y
), lowest AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN lowest USING (doc_id)
"""


REVISITS = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), headers AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM payloads
), latest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM headers
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM latest
"""


def mix(plan: Plan = Plan(), seed: int = 17) -> str:
    b = plan.block
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    group_mark = "CAST('0x' || substr(mark, 1, 8) AS BIGINT)"
    stages, place = stirred("x", "a", "b", "key")
    fields = "source_no, n_blocks, a, b, key"
    return f"""
WITH RECURSIVE counted AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len({_words("text")}) AS size, md5(text) AS text_md5 FROM documents
), sized AS (
  SELECT *, md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), text_md5)) AS mark FROM counted
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM totals
), weighted AS (
  SELECT *, CAST({weights}[(source_no - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, {plan.most} * source_size AS most FROM numbered
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (
               ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), filled AS (
  SELECT source, source_no, source_size, least(CAST(most AS DOUBLE), weight * max(level) OVER ()) AS target,
         (source_size + {b - 1}) // {b} AS n_blocks
  FROM levels
), sources AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(round(target * n_blocks / source_size) AS BIGINT), {plan.most} * n_blocks) ELSE 0 END AS n_draws
  FROM filled
), grouped AS (
  SELECT d.*, s.* EXCLUDE (source), {group_mark} % greatest(1, ((SELECT count(*) FROM documents) + {plan.rows - 1}) // {plan.rows}) AS grp
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source_no ORDER BY grp, mark, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM grouped
), draws AS (
  SELECT source_no, n_blocks, j % n_blocks AS x, '{seed}/' || source_no || '/' || (j // n_blocks) AS key, ceil(sqrt(n_blocks::DOUBLE))::BIGINT AS a
  FROM (SELECT source_no, n_blocks, unnest(range(0, n_draws)) AS j FROM sources)
), walk AS (
  SELECT {fields}, {place} AS x, 1 AS times FROM {nested(stages, "(SELECT *, ceil(n_blocks / a)::BIGINT AS b FROM draws)")}
  UNION ALL
  SELECT {fields}, {place}, times + 1 FROM {nested(stages, "(SELECT * FROM walk WHERE x >= n_blocks)")}
), used AS (
  SELECT source_no, x AS idx, count(*) AS times FROM walk WHERE x < n_blocks GROUP BY ALL
), pieces AS (
  SELECT rid, source_no, idx, least(start + size, (idx + 1) * {b}) - greatest(start, idx * {b}) AS words
  FROM (SELECT rid, source_no, start, size, unnest(range((start // {b})::BIGINT, ((start + size - 1) // {b})::BIGINT + 1)) AS idx
        FROM placed WHERE size > 0)
), sums AS (
  SELECT rid, sum(words * times)::BIGINT AS taken FROM pieces JOIN used USING (source_no, idx) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN sums USING (rid)
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit (the reversed polynomial is a fixed value)."""
    bits = "list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {chars}), lambda crc, byte: {bits}), 4294967295)"


def merkle(arity: int = 3) -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"

    def levels(name: str, start: str) -> str:
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, idx // {arity}, (any_value(n) + {arity - 1}) // {arity}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {arity}
), {name}_sides AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lefts,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rights
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // {arity} = b.idx // {arity}
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx
)"""

    def climb(name: str, sides: str, start: str) -> str:
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT c.rid, c.tree, c.level + 1, c.idx // {arity}, (c.n + {arity - 1}) // {arity}, sha256(s.lefts || c.digest || s.rights), c.proof || s.lefts || s.rights
  FROM {name} c JOIN {sides} s ON c.tree = s.tree AND c.level = s.level AND c.idx = s.idx
)"""

    return f"""
WITH RECURSIVE made AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS tampered
  FROM documents
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM made
), {levels("below", "SELECT tree, 0 AS level, idx, n, leaf AS digest FROM ordered")}, sources AS (
  SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM below WHERE n = 1
), {levels("above", "SELECT 'all' AS tree, 0 AS level, place AS idx, n, subroot AS digest FROM sources")},
{climb("inner_", "below_sides", "SELECT rid, tree, 0 AS level, idx, n, tampered AS digest, '' AS proof FROM ordered")},
{climb("outer_", "above_sides", "SELECT i.rid, 'all' AS tree, 0 AS level, s.place AS idx, s.n, i.digest, i.proof FROM inner_ i JOIN sources s ON i.tree = s.source WHERE i.n = 1")}
SELECT o.doc_id, o.leaf, s.subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM ordered o JOIN sources s ON o.tree = s.source JOIN outer_ e ON e.rid = o.rid AND e.n = 1
CROSS JOIN (SELECT digest FROM above WHERE n = 1) r
"""


def url_filter() -> str:
    rules = ", ".join(f"('{key}', '{verdict}')" for key, verdict in URL_RULES)
    words = ", ".join(f"'{w}'" for w in HOST_WORDS)
    return f"""
WITH rules AS (
  SELECT key, verdict, split_part(key, '/', 1) AS rule_host, substr(key, strpos(key, '/')) AS rule_path FROM (VALUES {rules}) t(key, verdict)
), urls AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages
), best AS (
  SELECT rid, arg_max(key, length(key)) AS rule, arg_max(verdict, length(key)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(list_intersect(string_split(replace(host, '-', '.'), '.'), [{words}])) > 0
       THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN best USING (rid)
"""


ORACLES = {
    "op1_decontaminate": decontaminate(),
    "op3_host_rules": host_rules(),
    "op4_near_duplicates": near_duplicates(),
    "op9_revisits": REVISITS,
    "op10_mix": mix(),
    "op12_url_filter": url_filter(),
    "op13_merkle": merkle(),
}
