"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

import calendar
import re

from recollect.functions.temporal import AGO, IN_MONTH, IN_YEAR, MONTHS, NEAR, NUMBERS, PAST, UNITS
from recollect.functions.text import LEAST, STOPWORDS, SUFFIXES
from recollect.operators.evaluation import DATE_WORDS
from recollect.operators.stats import T975, Z975

SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ends(w: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"ends_with({w}, '{s}')" for s in suffixes) + ")"


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _singular(w: str) -> str:
    return (
        f"CASE WHEN {_ends(w, 'ies')} AND length({w}) - 3 >= {LEAST} THEN {_cut(w, 3)} || 'y' "
        f"WHEN {_ends(w, 'es')} AND length({w}) - 2 >= {LEAST} THEN CASE WHEN {_ends(w, 'ses', 'xes', 'zes', 'ches', 'shes')} THEN {_cut(w, 2)} ELSE {_cut(w, 1)} END "
        f"WHEN {_ends(w, 's')} AND NOT {_ends(w, 'ss', 'us', 'is')} AND length({w}) > {LEAST} THEN {_cut(w, 1)} ELSE {w} END"
    )


def _uninflected(w: str) -> str:
    out = f"CASE WHEN {_ends(w, 'ied')} AND length({w}) - 3 >= {LEAST} THEN {{'root': {_cut(w, 3)} || 'y', 'suffix': 'ied'}} "
    for s in SUFFIXES:
        root = _cut(w, len(s))
        if s in ("ing", "ed"):
            root = f"CASE WHEN length({root}) > {LEAST} AND right({root}, 1) = left(right({root}, 2), 1) AND right({root}, 1) NOT IN ('l', 's', 'z', 'e', 'o') THEN {_cut(root, 1)} ELSE {root} END"
        out += f"WHEN {_ends(w, s)} AND length({w}) - {len(s)} >= {LEAST} THEN {{'root': {root}, 'suffix': '{s}'}} "
    return out + f"ELSE {{'root': {w}, 'suffix': ''}} END"


def terms(text: str) -> str:
    words = f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+(?:''[a-z]+)?'), lambda w: regexp_replace(w, '''s$', ''))"
    kept = f"list_filter({words}, lambda w: w NOT IN ({', '.join(map(quoted, STOPWORDS))}))"
    single = f"list_transform({kept}, lambda w: {{'word': w, 'one': {_singular('w')}}})"
    rooted = f"list_transform({single}, lambda s: {{'word': s.word, 'u': {_uninflected('s.one')}}})"
    bare = f"CASE WHEN NOT starts_with(s.u.suffix, 'ed') AND ends_with(s.u.root, 'e') AND length(s.u.root) > {LEAST} THEN {_cut('s.u.root', 1)} ELSE s.u.root END"
    return f"list_transform({rooted}, lambda s: CASE WHEN length(s.word) <= {LEAST} OR regexp_full_match(s.word, '[0-9]+') THEN s.word ELSE {bare} END)"


def tokens(text: str, v: str = "p") -> str:
    cost = f"CASE WHEN regexp_matches({v}, '^[A-Za-z]') THEN CASE WHEN length({v}) <= 8 THEN 1 ELSE 1 + (length({v}) - 4) // 5 END WHEN regexp_matches({v}, '^[0-9]') THEN (length({v}) + 2) // 3 ELSE 1 END"
    return f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[0-9]+|[^{SPACE}A-Za-z0-9]'), lambda {v}: {cost})), 0)::BIGINT"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE}]+'), lambda w: w <> '')"


def key(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[{SPACE}]+', ' ', 'g'))"


def header(session: str, ts: str) -> str:
    return f"'[session ' || {session} || ' - ' || strftime({ts}, '%Y-%m-%d %H:%M (%A)]')"


def truncated(text: str, most: int) -> str:
    ws = words(text)
    prefix = f"list_max(list_filter(range(0, len({ws}) + 1), lambda n: {tokens(f'array_to_string({ws}[1:n], chr(32))')} + 1 <= {most}))"
    return f"CASE WHEN {tokens(text)} <= {most} THEN {text} ELSE array_to_string({ws}[1:coalesce({prefix}, 0)], ' ') || ' …' END"


def split_of(cluster: str) -> str:
    return f"CASE WHEN list_sum(list_transform(string_split(sha256({cluster}), ''), lambda d: ('0x' || d)::INT)) % 5 = 0 THEN 'dev' ELSE 'test' END"


def t975(df: str) -> str:
    z = Z975
    table = "[" + ", ".join(map(str, T975)) + "]::DOUBLE[]"
    return f"CASE WHEN {df} <= {len(T975)} THEN ({table})[({df})::INT] ELSE {z} + {z**3 + z!r}::DOUBLE / (4 * {df}) + {5 * z**5 + 16 * z**3 + 3 * z!r}::DOUBLE / (96 * {df} * {df}) END"


def _case(table: dict[str, int], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


def window(question: str, now: str) -> str:
    """struct(lo, hi) or null, of a column named by ``question``."""
    q = f"lower({question})"
    g = lambda pattern, k: f"regexp_extract({q}, {quoted(pattern)}, {k})"
    number = lambda p: f"coalesce({_case(NUMBERS, g(p, 1))}, TRY_CAST({g(p, 1)} AS INT))"
    days = lambda n: f"to_days(({n})::INT)"
    w = lambda lo, hi: f"{{'lo': {lo}, 'hi': {hi}}}"
    ago, past = _case(UNITS, g(AGO, 2)), _case(UNITS, g(PAST, 2))
    phrase = g(NEAR, 1)
    unit = _case(UNITS, f"split_part({phrase}, ' ', 2)")
    near = (
        f"CASE WHEN {phrase} IN ('yesterday', 'last night') THEN {w(f'{now} - {days(2)}', now)} WHEN {phrase} IN ('today', 'this morning', 'tonight') THEN {w(f'{now} - {days(1)}', f'{now} + {days(1)}')} "
        f"WHEN split_part({phrase}, ' ', 1) IN ('this', 'past') THEN {w(f'{now} - {days(f'{unit} + 1')}', f'{now} + {days(1)}')} ELSE {w(f'{now} - {days(f'{unit} * 2 + 1')}', now)} END"
    )
    month = _case(MONTHS, g(IN_MONTH, 1))
    year = f"coalesce(TRY_CAST(nullif({g(IN_MONTH, 2)}, '') AS INT), CASE WHEN {month} <= month({now}) THEN year({now}) ELSE year({now}) - 1 END)"
    start = f"make_timestamp({year}, {month}, 1, 0, 0, 0)"
    whole = f"TRY_CAST({g(IN_YEAR, 1)} AS INT)"
    m = lambda p: f"regexp_matches({q}, {quoted(p)})"
    return (
        f"CASE WHEN {m(AGO)} THEN {w(f'{now} - {days(f'{number(AGO)} * {ago}')} - {days(f'greatest({ago}, 2)')}', f'{now} - {days(f'{number(AGO)} * {ago}')} + {days(f'greatest({ago}, 2)')}')} "
        f"WHEN {m(PAST)} THEN {w(f'{now} - {days(f'{number(PAST)} * {past} + 1')}', f'{now} + {days(1)}')} WHEN {m(NEAR)} THEN {near} "
        f"WHEN {m(IN_MONTH)} THEN {w(f'{start} - {days(3)}', f'{start} + INTERVAL 1 MONTH + {days(3)}')} "
        f"WHEN {m(IN_YEAR)} THEN {w(f'make_timestamp({whole}, 1, 1, 0, 0, 0)', f'make_timestamp({whole} + 1, 1, 1, 0, 0, 0)')} END"
    )


_SCORE = "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _bm25(docs: str) -> str:
    """(qid, history_id, doc_id, score) from a CTE (history_id, doc_id, ts_) against qterms."""
    return f"""SELECT qid, history_id, doc_id, sum({_SCORE}) AS score FROM (
  SELECT q.qid, p.history_id, p.doc_id, p.tf, len(d.ts_)::DOUBLE AS dl, c.avgdl, ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) AS idf
  FROM qterms q JOIN (SELECT history_id, doc_id, term, count(*) AS tf FROM (SELECT history_id, doc_id, unnest(ts_) AS term FROM {docs}) GROUP BY ALL) p USING (history_id, term)
  JOIN (SELECT history_id, term, count(*) AS df FROM (SELECT DISTINCT history_id, doc_id, unnest(ts_) AS term FROM {docs}) GROUP BY ALL) f USING (history_id, term)
  JOIN (SELECT history_id, count(*) AS n, avg(len(ts_)) AS avgdl FROM {docs} GROUP BY 1) c USING (history_id)
  JOIN {docs} d ON d.history_id = p.history_id AND d.doc_id = p.doc_id) GROUP BY ALL"""


def bm25_by_question(docs: str) -> str:
    """As ``_bm25``, from a CTE (qid, history_id, doc_id, ts_) of the documents that each question may see."""
    return f"""SELECT qid, history_id, doc_id, sum({_SCORE}) AS score FROM (
  SELECT q.qid, p.history_id, p.doc_id, p.tf, len(d.ts_)::DOUBLE AS dl, c.avgdl, ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) AS idf
  FROM qterms q JOIN (SELECT qid, history_id, doc_id, term, count(*) AS tf FROM (SELECT qid, history_id, doc_id, unnest(ts_) AS term FROM {docs}) GROUP BY ALL) p USING (qid, history_id, term)
  JOIN (SELECT qid, term, count(*) AS df FROM (SELECT DISTINCT qid, doc_id, unnest(ts_) AS term FROM {docs}) GROUP BY ALL) f USING (qid, term)
  JOIN (SELECT qid, count(*) AS n, avg(len(ts_)) AS avgdl FROM {docs} GROUP BY 1) c USING (qid)
  JOIN {docs} d ON d.qid = p.qid AND d.doc_id = p.doc_id) GROUP BY ALL"""


PER, EPOCH = 10, "TIMESTAMP '2024-01-01 09:00:00'"

CTES: dict[str, str] = {
    "turns": f"SELECT conv_id // {PER} AS history_id, conv_id || ':' || turn AS id, conv_id::VARCHAR AS session_id, {EPOCH} + to_days(conv_id::INT) AS ts, role AS speaker, text, turn AS seq FROM conversations",
    "pos": "SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY ts, session_id, seq) - 1 AS position, count(*) OVER (PARTITION BY history_id) AS n_turns FROM turns",
    "questions": f"""SELECT 'q' || conv_id AS qid, 'conversations' AS dataset, conv_id // {PER} AS history_id, ['single-hop', 'multi-hop', 'temporal', 'knowledge-update'][conv_id % 4 + 1] AS qtype,
  ['', 'last week ', '3 days ago ', 'in january 2024 ', 'yesterday '][conv_id % 5 + 1] || array_to_string(string_split(text, ' ')[1:12], ' ') AS question,
  array_to_string(string_split(text, ' ')[1:3], ' ') AS answer, {EPOCH} + to_days((last + 1)::INT) AS now, conv_id || ':' || turn AS turn_id, conv_id::VARCHAR AS session_id,
  'h' || (conv_id // {PER}) AS cluster, {split_of(f"('h' || (conv_id // {PER}))")} AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'user') JOIN (SELECT conv_id // {PER} AS h, max(conv_id) AS last FROM conversations GROUP BY 1) ON h = conv_id // {PER} WHERE nth = 1""",
    "qterms": f"SELECT DISTINCT qid, history_id, unnest({terms('question')}) AS term FROM questions",
    "tdocs": f"SELECT history_id, id AS doc_id, {terms(chr(40) + 'speaker || ' + quoted(' ') + ' || text' + chr(41))} AS ts_ FROM turns",
    "sdocs": "SELECT t.history_id, t.session_id AS doc_id, flatten(list(d.ts_)) AS ts_ FROM turns t JOIN tdocs d ON d.history_id = t.history_id AND d.doc_id = t.id GROUP BY ALL",
    "tscore": _bm25("tdocs"),
    "sscore": _bm25("sdocs"),
    "tfull": "SELECT s.*, p.position, p.session_id, p.ts, q.now, q.question FROM tscore s JOIN pos p ON p.history_id = s.history_id AND p.id = s.doc_id JOIN questions q USING (qid)",
    "windows": f"SELECT qid, {window('question', 'now')} AS w FROM questions",
    "store": """SELECT qid, history_id, id, position, session_id, ts, (score / top + 0.3 * coalesce(s, 0)) * (0.5 + 0.5 * pow(0.5, greatest(epoch_us(now) - epoch_us(ts), 0) / 86400000000.0 / 365.0))
  * CASE WHEN coalesce(w.lo <= ts AND ts < w.hi, false) THEN 2 ELSE 1 END AS score
  FROM (SELECT *, doc_id AS id, max(score) OVER (PARTITION BY qid) AS top FROM tfull) t JOIN windows USING (qid)
  LEFT JOIN (SELECT qid AS q2, doc_id AS s2, score / max(score) OVER (PARTITION BY qid) AS s FROM sscore) ON q2 = qid AND s2 = session_id""",
    "rank_store": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, position) AS rank FROM store",
    "rank_turns": "SELECT *, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, position) AS rank FROM tfull",
    "priced": f"SELECT history_id, id, session_id, ts, seq, speaker, text, {tokens('(speaker || chr(58) || chr(32) || text)')} AS line_tokens, {tokens(chr(40) + header('session_id', 'ts') + chr(41))} AS header_tokens FROM turns",
    "arrivals": "SELECT event_id AS id, 'user_' || user_id AS subject, event_type AS attribute, floor(value / 10)::BIGINT::VARCHAR AS value, ts AS valid_from, (user_id % 100) || ':0' AS source_turn FROM events",
    "facts": "SELECT * EXCLUDE (before) FROM (SELECT *, lag(value) OVER (PARTITION BY subject, attribute ORDER BY id) AS before FROM arrivals) WHERE before IS DISTINCT FROM value",
    "chain": "SELECT *, lead(id) OVER (PARTITION BY subject, attribute ORDER BY valid_from, id) AS superseded_by FROM facts",
}


def assemble(final: str, **extra: str) -> str:
    """The final SELECT after those of the common table expressions that it needs."""
    have = CTES | extra
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\w+", sql):
            if name in have and name not in order and have[name] is not sql:
                need(have[name])
                if name not in order:
                    order.append(name)

    need(final)
    head = ", ".join(f"{n} AS ({have[n]})" for n in order)
    recursive = "RECURSIVE " if any("UNION ALL" in have[n] and re.search(rf"\b{n}\b", have[n]) for n in order) else ""
    return f"WITH {recursive}{head} {final}" if order else final


def jackknife(rows: str, by: str, value: str = "value") -> str:
    """(by, mean, lo, hi, n, clusters) of a relation with a cluster and a value."""
    names = [b.strip() for b in by.split(",")]
    on = " AND ".join(f"s.{b} = t.{b}" for b in names)
    return f"""SELECT {by}, mean, CASE WHEN clusters < 2 THEN mean ELSE greatest(mean - half, least) END AS lo, CASE WHEN clusters < 2 THEN mean ELSE least(mean + half, most) END AS hi, n, clusters FROM (
  SELECT {by}, any_value(total) / any_value(n) AS mean, any_value(n)::BIGINT AS n, any_value(clusters)::BIGINT AS clusters, any_value(least) AS least, any_value(most) AS most,
    {t975('greatest(any_value(clusters) - 1, 1)')} * sqrt((any_value(clusters) - 1) * var_pop(loo)) AS half FROM (
    SELECT {', '.join(f's.{b}' for b in names)}, total, n, clusters, t.least, t.most, CASE WHEN n > c THEN (total - s_) / (n - c) END AS loo
    FROM (SELECT {by}, cluster, sum({value}) AS s_, count(*) AS c FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL) s
    JOIN (SELECT {by}, sum({value}) AS total, count(*) AS n, count(DISTINCT cluster) AS clusters, min({value}) AS least, max({value}) AS most FROM {rows} WHERE {value} IS NOT NULL GROUP BY {by}) t ON {on}
  ) GROUP BY {by})"""


def date_words() -> str:
    names = " ".join([*calendar.month_name[1:], *calendar.month_abbr[1:], *calendar.day_name]) + " " + DATE_WORDS
    return terms(quoted(names))
