"""DuckDB SQL for the rows of those queries that SQL can express, written without their indexes."""

from __future__ import annotations

from recollect.llm import decontaminate, licenses, mixing, url_filter

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def op3() -> str:
    masks = decontaminate.MASKS
    ahead = max(m[-1] for m in masks)
    least, longest = decontaminate.MIN_WORDS, decontaminate.SHORT

    def seeds(table: str) -> str:
        near = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, ahead + 1))
        wide = f"SELECT id, m, pos, w AS w0, {near} FROM {table} WINDOW o AS (PARTITION BY id ORDER BY pos)"
        shapes = [(m, "") for m in masks]
        shapes += [(m, f" AND EXISTS (SELECT 1 FROM short WHERE short.m = {n})") for n in range(least, longest + 1) for m in decontaminate.all_but_one(n)]
        shapes += [(tuple(range(n)), f" AND m = {n}" if table == "iw" else "") for n in range(1, least)]
        one = lambda k, m, when: f"SELECT id, pos, {k} AS shape, concat_ws(' ', {', '.join(f'w{o}' for o in m)}) AS seed FROM ({wide}) WHERE w{m[-1]} IS NOT NULL{when}"
        return " UNION ALL ".join(one(k, m, when) for k, (m, when) in enumerate(shapes))

    words = "regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
WITH d AS (SELECT doc_id AS id, {words} AS ws FROM documents), i AS (SELECT item_id AS id, {words} AS ws FROM benchmark),
dw AS (SELECT id, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
iw AS (SELECT id, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM i),
short AS (SELECT DISTINCT m FROM iw WHERE m <= {longest}),
ds AS ({seeds("dw")}), si AS ({seeds("iw")}),
diagonal AS (SELECT DISTINCT ds.id AS doc_id, si.id AS item_id, ds.pos - si.pos AS start FROM ds JOIN si USING (shape, seed)),
same AS (
  SELECT g.doc_id, g.item_id, g.start, iw.m, iw.pos, CASE WHEN dw.w = iw.w THEN 1 ELSE 0 END AS eq
  FROM diagonal g JOIN iw ON iw.id = g.item_id LEFT JOIN dw ON dw.id = g.doc_id AND dw.pos = g.start + iw.pos
),
windows AS (
  SELECT *, least(m, 10) AS size, sum(eq) OVER (PARTITION BY doc_id, item_id, start ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS inside,
    sum(eq) OVER (PARTITION BY doc_id, item_id, start) AS total
  FROM same
),
good AS (SELECT doc_id, item_id, start, max(m) AS m, max(total) AS total FROM windows WHERE pos <= m - size AND inside >= ceil(size * 0.8) GROUP BY ALL)
SELECT doc_id, item_id, max(m)::BIGINT AS item_words, arg_max(greatest(start, 0), total * 1000000000 - start)::BIGINT AS first_word, max(total)::BIGINT AS matched_words
FROM good GROUP BY doc_id, item_id"""


OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM ok),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.node = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id"""


def op5() -> str:
    rules = ", ".join(f"('{r['host']}', '{r['path']}', '{r['verdict']}')" for r in url_filter.RULES)
    words = lambda x: f"unnest([{', '.join(repr(w) for w in x)}])"
    plain = "list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.')"
    fold = f"list_reduce([[]::VARCHAR[]] || list_transform({plain}, lambda x: [x]), lambda done, x: CASE WHEN x = ['..'] THEN done[1:greatest(len(done) - 1, 0)] ELSE done || x END)"
    return rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
plain AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(host, '^(?s:.*)@', ''), ':[0-9]*$', ''), '\.+$', '') AS host, array_to_string({fold}, '/') AS path FROM p
),
a AS (SELECT {words(url_filter.LISTED_FIRST)} AS a), b AS (SELECT {words(url_filter.LISTED_SECOND)} AS b), e AS (SELECT {words(url_filter.LISTED_ENDS)} AS e),
listed AS (SELECT a || '-' || b || CASE WHEN m > 0 THEN m::VARCHAR ELSE '' END || '.example.' || e AS h FROM a, b, e, range({url_filter.LISTED_MIRRORS}) r(m)),
fits AS (
  SELECT page_id, 1 AS is_rule, h || q AS entry, verdict FROM p JOIN (VALUES {rules}) AS r(h, q, verdict) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  UNION ALL SELECT page_id, 0, h || '/', 'block' FROM plain JOIN listed ON host = h OR ends_with(host, '.' || h)
),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY is_rule DESC, length(entry) DESC, entry DESC) AS nth FROM fits)
SELECT p.page_id, host, path, CASE WHEN is_rule = 1 THEN entry END AS rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN is_rule = 0 THEN entry END AS listed
FROM p LEFT JOIN best ON best.page_id = p.page_id AND nth = 1"""


def _permuted(table: str, out: str, value: str, size: str, seed: str) -> str:
    p = mixing.PRIME
    sql = f"SELECT *, ({value})::BIGINT AS {out}, ({size})::BIGINT AS _n, ({seed})::BIGINT AS _s FROM {table}"
    for r in range(mixing.ROUNDS):
        a, b = 1103515245 + 7919 * r, 12345 + 104729 * r
        high = f"(((_s * {2 * r + 1} + {b}) % {p}) * {a} % {p})"
        key = f"({high} * {1 << 30} + ({high} * {a} + {b}) % {p} % {1 << 30}) % _n"
        sql = f"SELECT *, (({key}) - {out} + _n) % _n AS _p FROM ({sql})"
        sql = f"SELECT *, (greatest({out}, _p) % {p} + greatest({out}, _p) // {p} * 7 + _s + {b}) % {p} AS _z FROM ({sql})"
        sql = f"SELECT * REPLACE (CASE WHEN ((_z * _z % {p}) * {a} + {b}) % {p} < {p // 2} THEN _p ELSE {out} END AS {out}) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (_p, _z) FROM ({sql})"
    return f"SELECT * EXCLUDE (_n, _s) FROM ({sql})"


def op8() -> str:
    b, bucket, p, rows = mixing.BLOCK, mixing.BUCKET, mixing.PRIME, mixing.BUCKET_ROWS
    mix = lambda v, x, y: f"SELECT * EXCLUDE (u, v), v AS u, (v * v % {p} + v * {x} + {y}) % {p} AS v FROM ({v})"
    start = f"SELECT i, all_slots, 0::BIGINT AS u, ((i % {p} + i // {p} * 7 + {mixing.seed_start(mixing.SEED)}) % {p})::BIGINT AS v FROM (SELECT all_slots, unnest(range(all_slots)) AS i FROM (SELECT max(all_slots) AS all_slots FROM slotted))"
    fallen = mix(mix(mix(start, 1103515245, 12345), 747796405, 104729), 1566083941, 7919)
    n = f"ceil(all_slots / ceil(all_slots / greatest(1, least({mixing.SHARD}, ceil(all_slots / {mixing.SHARDS})))))::BIGINT"
    line = f"floor(slots::DOUBLE * (shard * {n})::DOUBLE / all_slots::DOUBLE + 0.5)::BIGINT"
    draw = _permuted("k_slots", "block", "k % blocks", "blocks", f"({mixing.SEED} + source_rank * 31 + (k // blocks) * 17) % {p}")
    return rf"""
WITH sized AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS copy
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM sized GROUP BY source),
dealt AS (
  SELECT d.*, ((((coalesce(doc_id, 0) % {p}) + {p}) % {p}) * 7919 + size % {p} * 104729 + copy % {p} * 31) % {p} % ceil(greatest(greatest(source_size, 1) / {bucket}, source_rows / {rows}))::BIGINT AS bucket
  FROM sized d JOIN sizes s ON d.source IS NOT DISTINCT FROM s.source
),
placed AS (
  SELECT *, row_number() OVER o AS nth, (sum(size) OVER (PARTITION BY source, bucket ORDER BY doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM dealt WINDOW o AS (PARTITION BY source, bucket ORDER BY doc_id NULLS FIRST, size, copy)
),
counted AS (SELECT source, bucket, sum(size)::BIGINT AS words, ceil(sum(size) / {b})::BIGINT AS blocks FROM placed GROUP BY ALL),
filled AS (SELECT *, (sum(blocks) OVER (PARTITION BY source ORDER BY bucket ROWS UNBOUNDED PRECEDING))::BIGINT - blocks AS first_block FROM counted),
bysource AS (SELECT source, sum(words)::BIGINT AS source_size, sum(blocks)::BIGINT AS blocks FROM filled GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM bysource),
weighed AS (SELECT *, (source_rank % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM levels),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN least(round(target * blocks / source_size)::BIGINT, blocks * 3) ELSE 0 END AS slots FROM targets),
slotted AS (SELECT *, (sum(slots) OVER (ORDER BY source_rank ROWS UNBOUNDED PRECEDING))::BIGINT - slots AS low, (sum(slots) OVER ())::BIGINT AS all_slots FROM shares),
thrown AS (SELECT i // {n} AS shard, (u * {1 << 30} + v % {1 << 30}) % all_slots AS u FROM ({fallen})),
drawn AS (SELECT source_rank, shard, count(*) AS drawn FROM thrown JOIN slotted s ON thrown.u >= low AND thrown.u < low + slots GROUP BY ALL),
reached AS (
  SELECT source_rank, shard, {line} + drawn AS up FROM drawn JOIN slotted USING (source_rank)
  UNION ALL SELECT source_rank, shard, {line} FROM (SELECT *, ceil(all_slots / {n})::BIGINT - 1 AS shard FROM slotted WHERE slots > 0)
),
tops AS (SELECT source_rank, shard, max(up) AS up FROM reached GROUP BY source_rank, shard),
highest AS (SELECT source_rank, shard, max(up) OVER (PARTITION BY source_rank ORDER BY shard ROWS UNBOUNDED PRECEDING) AS now FROM tops),
stepped AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY source_rank ORDER BY shard), 0) AS before FROM highest),
numbered AS (SELECT source, source_rank, blocks, shard, least(before, blocks * 3) AS first, least(now, blocks * 3) - least(before, blocks * 3) AS slots FROM stepped JOIN (SELECT source, source_rank, blocks FROM slotted) USING (source_rank)),
k_slots AS (SELECT source, source_rank, blocks, shard, first + unnest(range(slots)) AS k FROM numbered),
uses AS (SELECT source, block, count(*) AS uses FROM ({draw}) GROUP BY ALL),
parts AS (
  SELECT p.*, first_block, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS own
  FROM placed p JOIN filled f ON p.source IS NOT DISTINCT FROM f.source AND p.bucket = f.bucket WHERE size > 0
),
taken AS (
  SELECT p.source, p.bucket, p.nth, sum((least((own + 1) * {b}, start + size) - greatest(own * {b}, start)) * coalesce(uses, 0))::BIGINT AS taken
  FROM parts p LEFT JOIN uses u ON p.source IS NOT DISTINCT FROM u.source AND first_block + own = u.block GROUP BY ALL
)
SELECT doc_id, p.source, size, t.source_size, round(t.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON p.source IS NOT DISTINCT FROM k.source AND p.bucket = k.bucket AND p.nth = k.nth"""


def op9() -> str:
    phrases = licenses.PHRASES
    half, window = licenses.WINDOW // 2, licenses.WINDOW
    at = lambda p: f"list_filter(range(0, greatest(len(ws) - {len(p.split()) - 1}, 0)), lambda i: " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())) + ")"
    places = ", ".join(f"{at(p)} AS p{k}" for k, p in enumerate(phrases))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(phrases.values()))
    rows = ", ".join(f"({k}, '{label}', {sorted(set(text.split()))}, {-int(-(licenses.THRESHOLD * len(set(text.split())) - 1e-9) // 1)})" for k, (label, text) in enumerate(licenses.TEMPLATES))
    every = " || ".join(f"p{k}" for k in range(len(phrases)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
templates(template, label, tokens, need) AS (VALUES {rows}),
blocks AS (SELECT nth, unnest(list_transform(range(0, len(ws), {half}), lambda b: list_distinct(ws[b + 1:b + {window}]))) AS content FROM d),
met AS (SELECT nth, label, len(list_intersect(tokens, content)) / len(tokens) AS contained FROM blocks, templates WHERE len(list_intersect(tokens, content)) >= need),
more AS (SELECT nth, list(DISTINCT label) AS more, max(contained) AS contained FROM met GROUP BY nth),
placed AS (SELECT nth, doc_id, len(ws) AS n_words, {places} FROM d),
found AS (SELECT nth, doc_id, n_words, {every} AS every, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM placed)
SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ','), '') AS labels,
  CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0)::DOUBLE END AS score
FROM found LEFT JOIN more USING (nth)"""


OP10 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth, role, text,
    '<|' || coalesce(role, '') || '|>' || chr(10) AS head, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
),
pairs AS (SELECT conv_id // 2 AS pair_id, max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN conv_id % 2 = 1 THEN conv_id END) AS rejected_id FROM t GROUP BY 1),
sides AS (
  SELECT pair_id, chosen_id AS conv_id, (SELECT count(*) FROM t WHERE t.conv_id = chosen_id) AS n FROM pairs
  UNION ALL SELECT pair_id, rejected_id, (SELECT count(*) FROM t WHERE t.conv_id = rejected_id) FROM pairs
),
odd AS (
  SELECT pair_id, min(c.nth) AS nth FROM pairs JOIN t c ON c.conv_id = chosen_id JOIN t r ON r.conv_id = rejected_id AND r.nth = c.nth
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1
),
cut AS (SELECT s.pair_id, least(min(n), coalesce(min(odd.nth) - 1, min(n))) AS prompt_turns FROM sides s LEFT JOIN odd ON odd.pair_id = s.pair_id GROUP BY 1),
rest AS (
  SELECT s.pair_id, t.*, (sum(length(line)) OVER (PARTITION BY t.conv_id ORDER BY nth))::BIGINT AS stop, length(head) AS lead
  FROM sides s JOIN cut ON cut.pair_id = s.pair_id JOIN t ON t.conv_id = s.conv_id AND nth > prompt_turns
),
done AS (
  SELECT conv_id, string_agg(line, '' ORDER BY nth) AS body,
    string_agg(CASE WHEN role = 'assistant' THEN (stop - length(line) + lead)::VARCHAR || '-' || stop::VARCHAR END, ',' ORDER BY nth) AS spans
  FROM rest GROUP BY 1
),
heads AS (SELECT pairs.pair_id, string_agg(line, '' ORDER BY nth) AS prompt FROM pairs JOIN cut ON cut.pair_id = pairs.pair_id JOIN t ON t.conv_id = chosen_id AND nth <= prompt_turns GROUP BY 1)
SELECT pairs.pair_id, chosen_id, rejected_id, prompt_turns::BIGINT AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected,
  coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM pairs JOIN cut ON cut.pair_id = pairs.pair_id LEFT JOIN heads ON heads.pair_id = pairs.pair_id
LEFT JOIN done c ON c.conv_id = chosen_id LEFT JOIN done r ON r.conv_id = rejected_id"""


OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS nth, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.nth AS anchor, a.vec_id AS anchor_id, b.vec_id, b.nth, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.nth <> b.nth AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor, same ORDER BY score DESC, vec_id NULLS LAST, nth) AS place FROM scores),
positives AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, place FROM ranked WHERE same AND place <= 5),
fits AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST, n.nth) AS rank
  FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 5"""


#: What the contract asks of pages laid out as the given ones are; the model knows nothing of it.
OP12 = r"""
WITH p AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS parts FROM pages),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS parts FROM p),
read AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(x, '&quot;', '"'), '&quot', '"'), '&amp;', '&'), '&amp', '&')) AS parts FROM plain),
shown AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM read)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text, length(coalesce(array_to_string(parts, chr(10) || chr(10)), ''))::BIGINT AS n_chars FROM shown"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": op3(),
        "op4_embedding_near_dedup": OP4,
        "op5_url_filter": op5(),
        "op8_mix_sources": op8(),
        "op9_license_scan": op9(),
        "op10_preference_format": OP10,
        "op11_hard_negatives": OP11,
        "op12_html_extraction": OP12,
    }
