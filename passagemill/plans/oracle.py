"""SQL that states the catalog's results for DuckDB, from shared fragments."""

from __future__ import annotations

from passagemill.functions.answers import NOT_FOUND
from passagemill.functions.text import BREAKING, NAMED
from passagemill.functions.titles import STOP_WORDS
from passagemill.options import TUNING

_T = TUNING
SPACE = r"[\s\p{Z}\x{FEFF}]+"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def plain(x: str) -> str:
    """html_to_text; the test tables hold no numeric entities but &#39;."""
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</(?:{'|'.join(BREAKING)})[^>]*>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?i)<br\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for name, sign in NAMED:
        x = f"replace({x}, {quote(name)}, {quote(sign)})"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({x}, ' *\\n *', chr(10), 'g')")


def heading(html: str) -> str:
    line = strip(f"regexp_replace({plain(f'regexp_extract({html}, {quote("(?is)<h1[^>]*>(.*?)</h1>")}, 1)')}, '{SPACE}', ' ', 'g')")
    return f"(SELECT CASE WHEN length(l) BETWEEN 1 AND 120 THEN l END FROM (SELECT {line} AS l))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) BETWEEN 1 AND 40)"


def tail(x: str) -> str:
    r = f"right({x}, {_T.overlap_chars})"
    return f"CASE WHEN length({x}) <= {_T.overlap_chars} THEN {x} WHEN instr({r}, ' ') = 0 THEN {r} ELSE substr({r}, instr({r}, ' ') + 1) END"


def chunk_array(x: str) -> str:
    b, step = _T.chunk_chars, _T.chunk_chars - _T.overlap_chars
    flush = f"(a.cur <> '' AND length(a.cur) + length(x.cur) + 1 > {b})"
    n = f"CAST(greatest(0, ceil((length(c) - {b * 3 // 2}) / {step}.0)) AS BIGINT)"
    folded = f"""list_reduce(list_concat([{{'cur': '', 'out': CAST([] AS VARCHAR[])}}],
        list_transform(list_filter(list_transform(regexp_split_to_array({x}, '\\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: {{'cur': p, 'out': CAST([] AS VARCHAR[])}})),
        lambda a, x: list_transform([CASE WHEN {flush} THEN {tail('a.cur')} ELSE a.cur END], lambda k:
          list_transform([CASE WHEN k = '' THEN x.cur ELSE k || chr(10) || x.cur END], lambda c:
            {{'cur': substr(c, {n} * {step} + 1),
              'out': list_concat(CASE WHEN {flush} THEN list_concat(a.out, [a.cur]) ELSE a.out END, list_transform(range(0, {n}), lambda i: substr(c, i * {step} + 1, {b})))}})[1])[1])"""
    return f"(SELECT CASE WHEN {strip('f.cur')} <> '' THEN list_concat(f.out, [f.cur]) ELSE f.out END FROM (SELECT {folded} AS f))"


def chunks(chapters: str) -> str:
    """CTEs of chunks(id, chapter, ord, chunk_index, text) from a query of (title, ord, text)."""
    return f"""chap AS ({chapters}), cut AS (SELECT title, ord, {chunk_array('text')} AS o FROM chap),
ix AS (SELECT *, unnest(range(len(o))) AS chunk_index FROM cut),
chunks AS (SELECT ord || '-' || chunk_index AS id, title AS chapter, ord, CAST(chunk_index AS INTEGER) AS chunk_index, o[chunk_index + 1] AS text FROM ix)"""


DOCUMENT_CHAPTERS = "SELECT lang || '/' || source AS title, '' AS href, doc_id AS ord, text FROM documents"
PAGE_TITLE = f"coalesce({heading('html')}, url, CAST(page_id AS VARCHAR))"
PAGE_CHAPTERS = f"SELECT title, href, row_number() OVER (ORDER BY page_id) - 1 AS ord, text FROM (SELECT page_id, {PAGE_TITLE} AS title, coalesce(url, '') AS href, {plain('html')} AS text FROM pages) WHERE length(text) >= {_T.least_page_chars}"
BENCHMARK_QUESTIONS = f"q AS (SELECT item_id AS qid, {strip('text')} AS question FROM benchmark)"
PAGE_QUESTIONS = f"q AS (SELECT ord AS qid, {strip(quote('Tell me about ') + ' || title || ' + quote('.'))} AS question FROM chap)"


def bm25(name: str, k: int, scope: str = "", prefix: str = "") -> str:
    """CTEs ending in name(qid, id, score, rank) from q(qid, question) and chunks."""
    return f"""{prefix}tok AS (SELECT id, {words('text')} AS w FROM chunks),
{prefix}st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM {prefix}tok WHERE len(w) > 0),
{prefix}tf AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {prefix}tok) GROUP BY ALL),
{prefix}df AS (SELECT term, count(*) AS df FROM {prefix}tf GROUP BY term),
{prefix}qt AS (SELECT qid, unnest(list_distinct({words('question')})) AS term FROM q),
{prefix}sc AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
  FROM {prefix}qt JOIN {prefix}df USING (term) JOIN {prefix}tf USING (term) {scope}, {prefix}st GROUP BY qid, id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {prefix}sc) WHERE rank <= {k})"""


def bag(x: str) -> str:
    counts = f"list_transform(range(0, 64), lambda b: CAST(len(list_filter(list_transform({words(x)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64), lambda p: p = b)) AS DOUBLE))"
    return f"(SELECT list_transform(c, lambda y: y / greatest(sqrt(list_sum(list_transform(c, lambda z: z * z))), 1e-300)) FROM (SELECT {counts} AS c))"


def near(name: str, k: int, question: str = "question") -> str:
    """CTEs ending in name(qid, id, distance, rank) by hashed bags of words."""
    d = "round(greatest(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))), 0), 6)"
    return f"""vq AS (SELECT qid, {bag(question)} AS v FROM q), vr AS (SELECT id, {bag('text')} AS v FROM chunks),
{name} AS (SELECT * FROM (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (SELECT qid, id, {d} AS distance FROM vq a, vr b)) WHERE rank <= {k})"""


WORD = "[A-Za-z0-9_]"
_DISTINCTIVE = lambda t: f"(regexp_matches({t}, '[0-9]') OR len(regexp_extract_all({t}, '[A-Z]')) >= 2)"
DISTINCTIVE = _DISTINCTIVE
PATTERN = lambda t: f"(CASE WHEN {_DISTINCTIVE(t)} THEN '(?i)' ELSE '' END || '\\b' || regexp_replace({t}, '([\\\\^$.|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') || '\\b')"
_STOP = ", ".join(quote(w) for w in STOP_WORDS)
NEAR_TOKENS = lambda t: f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9_]+'), lambda w: w NOT IN ({_STOP}))"
SNAKE = r"\b_?[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CAPS = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
SYMBOLS = lambda t: f"regexp_extract_all({t}, {quote(SNAKE + '|' + CAPS)})"
COVERS = "(q = t OR (length(q) >= 4 AND length(t) >= 4 AND (starts_with(q, t) OR starts_with(t, q))) OR (length(q) >= 6 AND length(t) >= 6 AND abs(length(q) - length(t)) <= 1 AND damerau_levenshtein(q, t) <= 1))"

#: CTEs over q(qid, question) and lst(chapter, pos).
MATCHED = f"matched AS (SELECT qid, chapter, pos FROM q, lst WHERE regexp_matches(question, {PATTERN('chapter')}))"
NEAR_TITLES = f"""qtok AS (SELECT DISTINCT qid, unnest({NEAR_TOKENS('question')}) AS q FROM q),
ttok AS (SELECT DISTINCT chapter, unnest({NEAR_TOKENS('chapter')}) AS t FROM lst WHERE len({NEAR_TOKENS('chapter')}) >= 2),
cov AS (SELECT DISTINCT x.q, y.t FROM (SELECT DISTINCT q FROM qtok) x, (SELECT DISTINCT t FROM ttok) y WHERE {COVERS}),
hitq AS (SELECT qid, chapter, count(DISTINCT t) AS n FROM qtok JOIN cov USING (q) JOIN ttok USING (t) GROUP BY qid, chapter),
need AS (SELECT chapter, count(*) AS n FROM ttok GROUP BY chapter),
nearly AS (SELECT h.qid, h.chapter, l.pos FROM hitq h JOIN need USING (chapter, n) JOIN lst l USING (chapter))"""
CHAPTER_LIST = "lst AS (SELECT chapter, min({'o': ord, 'c': chunk_index}) AS pos FROM chunks WHERE chapter IS NOT NULL GROUP BY chapter)"
_LONG = lambda src, n: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(chapter) DESC, pos, chapter) AS title_rank FROM {src}) WHERE title_rank <= {n})"
TITLE_SEARCH = f"""{CHAPTER_LIST}, {MATCHED}, {NEAR_TITLES},
named AS {_LONG('matched', _T.named_titles)},
also AS {_LONG('(SELECT * FROM nearly ANTI JOIN named USING (qid, chapter))', _T.near_titles)},
scope AS (SELECT qid, chapter FROM named UNION ALL SELECT qid, chapter FROM also),
inside AS (SELECT qid, id, ord, chunk_index, text FROM scope JOIN chunks USING (chapter)),
{bm25('tfts', _T.title_k, 'SEMI JOIN inside USING (qid, id)', 't_')},
sy AS (SELECT DISTINCT qid, unnest({SYMBOLS('question')}) AS symbol FROM q),
hs AS (SELECT DISTINCT qid, id, ord, chunk_index FROM inside JOIN sy USING (qid) WHERE text LIKE '%' || symbol || '%'),
branch AS (SELECT qid, id, 1 AS source, rank AS place FROM tfts
  UNION ALL SELECT * FROM (SELECT qid, id, 2, row_number() OVER (PARTITION BY qid ORDER BY ord, chunk_index, id) AS place FROM hs) WHERE place <= {_T.symbol_k}
  UNION ALL SELECT * FROM (SELECT qid, id, 3, row_number() OVER (PARTITION BY qid ORDER BY ord, chunk_index, id) AS place FROM inside ANTI JOIN (SELECT qid FROM tfts GROUP BY qid HAVING count(*) >= {_T.title_k}) USING (qid)) WHERE place <= {_T.title_k}),
named_hits AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY spot, id) AS rank FROM (SELECT qid, id, min({{'s': source, 'p': place}}) AS spot FROM branch GROUP BY qid, id)) WHERE rank <= {_T.title_k + _T.title_extra})"""
POOL = f"""{near('vec', _T.vector_k)}, {bm25('fts', _T.text_k)}, {TITLE_SEARCH},
pool AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY spot, id) AS INTEGER) AS pos FROM
  (SELECT qid, id, min({{'s': source, 'r': rank}}) AS spot FROM (SELECT qid, id, 0 AS source, rank FROM vec UNION ALL SELECT qid, id, 1, rank FROM fts UNION ALL SELECT qid, id, 2, rank FROM named_hits) GROUP BY qid, id))"""


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / CAST(len({a}) AS DOUBLE) ELSE 0 END"


def pairs(x: str) -> str:
    return f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"


def cheap() -> str:
    return f"""feat AS (SELECT qid, id, pos, chapter, ord, text, {words('question')} AS qw, {words('text')} AS pw FROM pool JOIN chunks USING (id) JOIN q USING (qid)),
feats AS (SELECT *, list_distinct(qw) AS qd, list_distinct(pw) AS pd, {pairs('qw')} AS q2, {pairs('pw')} AS p2 FROM feat),
judged AS (SELECT qid, id, pos, chapter, ord, text, round({share('qd', 'pd')}, 6) AS cheap, round(10 * ({share('qd', 'pd')}) + 2 * ({share('q2', 'p2')}) - 6, 6) AS score FROM feats),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cheap DESC, pos) AS cheap_rank FROM judged) WHERE cheap_rank <= {_T.prefilter_keep}),
scored AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM pre)"""


KEPT = f"""alltitles AS {_LONG('matched', 1 << 30)},
sym AS (SELECT qid, {SYMBOLS('question')} AS symbols FROM q),
r1 AS (SELECT s.*, a.title_rank, len(list_filter(symbols, lambda y: contains(s.text, y))) > 0 AS has_symbol FROM scored s LEFT JOIN alltitles a USING (qid, chapter) JOIN sym USING (qid) WHERE score >= {_T.threshold}),
r2 AS (SELECT *, row_number() OVER (PARTITION BY qid, chapter ORDER BY score DESC, pos) AS crn, row_number() OVER (PARTITION BY qid, chapter ORDER BY has_symbol DESC, score DESC, pos) AS srn FROM r1),
k0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS place FROM r2 WHERE title_rank IS NOT NULL OR crn = 1) WHERE place <= {_T.keep}),
pins AS (SELECT * FROM r2 ANTI JOIN k0 USING (qid, chapter) WHERE title_rank <= {_T.named_titles} AND srn = 1),
kept AS (SELECT qid, id, pos, chapter, ord, text, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY pinned, place) AS INTEGER) AS kept_rank, pinned
  FROM (SELECT qid, id, pos, chapter, ord, text, score, place, false AS pinned FROM k0 UNION ALL SELECT qid, id, pos, chapter, ord, text, score, title_rank, true FROM pins))"""


def hybrid(corpus: str) -> str:
    """CTEs up to kept, of the documents with benchmark questions or of the pages with questions about their titles."""
    head = f"{BENCHMARK_QUESTIONS}, {chunks(DOCUMENT_CHAPTERS)}" if corpus == "documents" else f"{chunks(PAGE_CHAPTERS)}, {PAGE_QUESTIONS}"
    return f"WITH {head}, {POOL}, {cheap()}, {KEPT}"


NORMAL = lambda x: f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
REFUSAL = lambda x: f"starts_with({NORMAL(x)}, {NORMAL(quote(NOT_FOUND))})"
