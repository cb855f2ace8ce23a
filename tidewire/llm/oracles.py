"""DuckDB SQL for the corpus queries that SQL can express.

Packing, the two tokenizer queries, weighted MinHash, SimHash and periodic runs have none;
tests hold them against brute force.
"""

from __future__ import annotations

from tidewire.llm.quality import MEASURES, SIZES, TWO_SIDED
from tidewire.llm.secrets import BASE, RULES

DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def _quality(least: int = 30, reach: float = 3.0) -> str:
    quantiles = [f"quantile_disc({m}, {x}) AS {m}_{i}" for m, of in MEASURES.items() for i, x in (("low", round(1 - of.sound, 4)), ("mid", 0.5), ("high", of.sound))] + [f"quantile_disc({c}, 0.5) AS {c}_mid" for c in SIZES]
    level = lambda name, keys: f"{name} AS (SELECT {', '.join([*keys, 'count(*) AS n', *quantiles])} FROM measured WHERE NOT base_failed" + (f" GROUP BY {', '.join(keys)}" if keys else "") + ")"
    pick = lambda c: f"(CASE WHEN s.n >= {least} THEN s.{c} WHEN l.n >= {least} THEN l.{c} ELSE a.{c} END)::double"
    odd = []
    for m, of in MEASURES.items():
        value = f"m.{of.count}::double / greatest(m.{of.size}::double, {pick(of.size + '_mid')})" if of.count else f"m.{m}"
        by_chance = f" + {of.cases}::double / {pick(of.size + '_mid')}" if of.count else ""
        odd.append(f"{value} > {pick(m + '_high')} + {reach}::double * ({pick(m + '_high')} - {pick(m + '_mid')}){by_chance}")
        if m in TWO_SIDED:
            odd.append(f"{value} < {pick(m + '_low')} - {reach}::double * ({pick(m + '_mid')} - {pick(m + '_low')})")
    return rf"""WITH {DOCS}, w AS (SELECT *, regexp_extract_all(t, '{WORD}+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
 grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, words[i:i+7] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8))),
 reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
 counted AS (SELECT w.doc_id, lang, source, len(words)::bigint AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
  len(lines)::bigint AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN reps ON w.doc_id = reps.doc_id),
 measured AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_symbols::double / nullif(n_words, 0), 0) AS symbol_rate, coalesce(word_chars::double / nullif(n_words, 0), 0) AS word_length,
  coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_repeat_words::double / nullif(n_words, 0), 0) AS repeat_share FROM counted),
 {level('by_source', ['lang', 'source'])}, {level('by_lang', ['lang'])}, {level('overall', [])}
 SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({' OR '.join(odd)}, false) AS kept, {', '.join('m.' + m for m in MEASURES)}
 FROM measured m LEFT JOIN by_source s ON m.lang = s.lang AND m.source = s.source LEFT JOIN by_lang l ON m.lang = l.lang CROSS JOIN overall a"""


def _secrets() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace(")*+", ")*").replace("'", "''")  # nothing behind a possessive group here needs what it has taken
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, gaps, judged, {r.least} AS least FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', {r.group}) AS judged FROM docs WHERE regexp_matches(t, '{p}'))""")
    size = lambda c, to: f"coalesce(list_sum(list_transform({c}[1:{to}], lambda x: length(x))), 0)::bigint"
    spans = f"spans AS (SELECT doc_id, rank, kind, {size('gaps', 'i')} + {size('m', 'i - 1')} AS b, {size('gaps', 'i')} + {size('m', 'i')} AS e FROM ({' UNION ALL '.join(parts)}) WHERE length(judged[i]) >= least)"
    text = lambda most: f"coalesce(string_agg(concat(kind, ':', b::varchar, ':', e::varchar), ',' ORDER BY b, rank) FILTER (rank < {most}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"WITH {DOCS}, {spans} SELECT docs.doc_id, {counts}, sha256({text(len(BASE))}) AS base_sha256, {text(len(RULES))} AS spans FROM docs LEFT JOIN spans ON docs.doc_id = spans.doc_id GROUP BY docs.doc_id"


BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::bigint + 1, 1)), '')"

WARC = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS best FROM p)
 SELECT page_id, strlen(html)::bigint AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to, url FROM r"""

EXACT = f"""WITH {DOCS}, n AS (SELECT doc_id, length(t) AS c, sha256(regexp_replace(t, '{SPACE}', '', 'g')) AS text_sha256 FROM docs),
 g AS (SELECT text_sha256, first(doc_id ORDER BY c DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.text_sha256 FROM n JOIN g ON n.text_sha256 = g.text_sha256"""

SUFFIX = f"""WITH {DOCS}, b AS (SELECT doc_id, hex(encode(t)) AS h FROM docs),
 hashes AS (SELECT doc_id, list_transform(range(length(h) // 2 - 49), lambda i: md5_number_lower(substr(h, 2 * i + 1, 100))) AS gs FROM b WHERE length(h) >= 100),
 each AS (SELECT doc_id, unnest(range(len(gs))) AS i, unnest(gs) AS g FROM hashes), least AS (SELECT g, min(doc_id) AS first FROM each GROUP BY g HAVING min(doc_id) < max(doc_id)),
 win AS (SELECT doc_id, i, first FROM each JOIN least ON each.g = least.g),
 gone AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM win WHERE first < doc_id),
 spans AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone) GROUP BY doc_id, k),
 cuts AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, sum(e - s)::bigint AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
 kept AS (SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN ss IS NULL THEN h ELSE array_to_string(list_transform(range(len(ss) + 1), lambda k: substr(h, 2 * CASE WHEN k = 0 THEN 0 ELSE es[k] END + 1, 2 * (CASE WHEN k = len(ss) THEN length(h) // 2 ELSE ss[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE es[k] END))), '') END AS rest
  FROM b LEFT JOIN cuts ON b.doc_id = cuts.doc_id)
 SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""

LINES = f"""WITH {DOCS}, l AS (SELECT doc_id, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '{WORD}+'))) AS ws FROM (SELECT doc_id, string_split(t, chr(10)) AS lines FROM docs)),
 spots AS (SELECT *, CASE WHEN ws[s] >= 50 THEN 1 WHEN s < len(lines) AND ws[s] + ws[s + 1] >= 50 THEN 2 WHEN s + 1 < len(lines) THEN 3 END AS k FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS s FROM l)),
 runs AS (SELECT doc_id, s, k, md5(array_to_string(list_transform(lines[s:s+k-1], lambda x: md5(trim(x))), '')) AS g FROM spots WHERE k IS NOT NULL),
 later AS (SELECT doc_id, s, k FROM (SELECT doc_id, s, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM runs) WHERE n > 1),
 gone AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + k)))) AS spots FROM later GROUP BY doc_id),
 kept AS (SELECT l.doc_id, len(lines)::bigint AS n_lines, len(coalesce(spots, []))::bigint AS n_removed, array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(coalesce(spots, []), i)), lambda i: lines[i]), chr(10)) AS rest FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id)
 SELECT doc_id, n_lines, n_removed, sha256(rest) AS text_sha256 FROM kept"""

# CRC-32 by its table of 256 entries; words one change apart have an equal variant without one character.
SPELLING = rf"""WITH RECURSIVE {DOCS}, crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
 runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM docs),
 each AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs WHERE length(r) >= 6 GROUP BY ALL),
 hashed AS (SELECT w, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT w, n, hex(encode(concat(doc_id, ':', w))) AS x FROM each), crc),
 words AS (SELECT word, sum(n)::bigint AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
 cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
 near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.v = b.word),
 best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
 judged AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
 led AS (SELECT word, word AS root, 0 AS steps FROM judged UNION ALL SELECT led.word, form, steps + 1 FROM led JOIN judged ON led.root = judged.word WHERE form IS NOT NULL),
 ends AS (SELECT word, arg_max(root, steps) AS root FROM led GROUP BY word)
 SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN ends ON judged.word = ends.word"""

ORACLES: dict[str, str] = {
    "op2_quality": _quality(),
    "op4_secrets": _secrets(),
    "op5_warc": WARC,
    "op7_exact": EXACT,
    "op9_suffix": SUFFIX,
    "op10_lines": LINES,
    "op13_spelling": SPELLING,
}
