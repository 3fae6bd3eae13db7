"""Building blocks of the oracle SQL (DuckDB): relations and BM25 as CTEs."""

from __future__ import annotations

from tessera.config import GENERIC

STOP = "[" + ", ".join(f"'{w}'" for w in GENERIC.stop) + "]"


def toks(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def qtoks(x: str) -> str:
    return f"({toks(f'substr({x}, 1, 2000)')})[1:24]"


DOCS = """docs AS (SELECT d.doc_id AS id, d.lang AS doc_type, d.source AS issuer, substr(string_split(d.text, chr(10))[1], 1, 250) AS title,
  d.doc_id::VARCHAR || '-' || d.source AS doc_number,
  CASE WHEN d.doc_id % 4 <= 1 THEN d.lang || ' ' || substr(string_split(d.text, chr(10))[1], 1, 250) END AS title_vi,
  CASE WHEN d.doc_id % 4 <= 1 THEN d.doc_id::VARCHAR || '/' || (1990 + d.doc_id % 40)::VARCHAR || '/QH' || (d.doc_id % 7)::VARCHAR END AS number_vi,
  (d.doc_id % 4)::INT AS tier, CASE WHEN d.doc_id % 10 <> 7 THEN (1990 + d.doc_id % 40)::INT END AS year, coalesce(l.toxic, 0) AS expired, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
QUERIES = "queries AS (SELECT item_id AS qid, text FROM benchmark)"
TITLE_QUERIES = """queries AS (SELECT id AS qid, CASE WHEN id % 300 = 0 THEN 'en ' || number_vi
  ELSE array_to_string(string_split(title, ' ')[1:4], ' ') END AS text FROM docs WHERE id % 100 = 0)"""
BODIES = """bodies AS (SELECT doc_id AS ref, 'body' AS field, text, 1.0 AS w FROM documents
  UNION ALL SELECT doc_id, 'heading', substr(string_split(text, chr(10))[1], 1, 250), 1.0 FROM documents)"""
QA = """qa AS (SELECT conv_id * 100000 + turn AS ref, text AS question, answer FROM
  (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
  WHERE role = 'user' AND nr = 'assistant')"""
TERMS = "terms AS (SELECT p_partkey AS ref, p_name AS term, p_type AS definition FROM part)"
GOLD = "gold AS (SELECT item_id AS qid, doc_id AS ref FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def units(name: str, src: str, ref: str, weights: dict[str, float]) -> str:
    arms = " UNION ALL ".join(f"SELECT {ref} AS ref, '{f}' AS field, {f} AS text, {w!r}::DOUBLE AS w FROM {src}" for f, w in weights.items())
    return f"{name} AS ({arms})"


def index(u: str) -> str:
    """{u}_t, {u}_p (postings), {u}_len, {u}_st, {u}_df."""
    return f"""{u}_t AS (SELECT ref, field, w, {toks('text')} AS t FROM {u}),
{u}_p AS (SELECT ref, field, w, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM {u}_t),
{u}_len AS (SELECT ref, sum(len(t)) AS len FROM {u}_t GROUP BY ref),
{u}_st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM {u}_len),
{u}_df AS (SELECT tok, count(DISTINCT ref) AS df FROM {u}_p GROUP BY tok)"""


def pairs(u: str) -> str:
    """{u}_b: bigram postings."""
    return f"""{u}_b AS (SELECT ref, field, w, tok || ' ' || nxt AS tok FROM
  (SELECT *, lead(tok) OVER (PARTITION BY ref, field ORDER BY pos) AS nxt FROM {u}_p) WHERE nxt IS NOT NULL)"""


def score(out: str, u: str, posts: str, terms: str) -> str:
    return f"""{out}_tf AS (SELECT ref, tok, sum(w) AS f FROM {posts} WHERE tok IN (SELECT tok FROM {terms}) GROUP BY ref, tok),
{out}_d AS (SELECT tok, count(*) AS df FROM {out}_tf GROUP BY tok),
{out}_s AS (SELECT t.ref, t.tok, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
   * t.f * 2.2 / (t.f + 1.2 * (0.25 + 0.75 * l.len / avgdl)) AS part
  FROM {out}_tf t JOIN {out}_d USING (tok) JOIN {u}_len l USING (ref) CROSS JOIN {u}_st),
{out} AS (SELECT qid, ref, count(*) AS hits, -sum(part * times) AS score FROM {terms} JOIN {out}_s USING (tok) GROUP BY qid, ref)"""


OR_TERMS = f"or_terms AS (SELECT DISTINCT qid, unnest({qtoks('text')}) AS tok, 1 AS times FROM queries)"
FILTERED = f"""filtered AS (SELECT qid, CASE WHEN len(f) = 0 THEN t ELSE f END AS t FROM
  (SELECT qid, t, list_filter(t, lambda x: NOT list_contains({STOP}, x)) AS f FROM (SELECT qid, {qtoks('text')} AS t FROM queries)))"""
AND_TERMS = "and_terms AS (SELECT qid, len(list_distinct(t)) AS n, unnest(list_distinct(t)) AS tok, 1 AS times FROM filtered)"


def phrases(u: str) -> str:
    """{u}_ph: the chosen phrases; {u}_pt: phrases as terms."""
    return f"""{u}_ph AS (SELECT * FROM (SELECT qid, i - 1 AS i, a, b, least(coalesce(da.df, 0), coalesce(db.df, 0)) AS min_df,
    row_number() OVER (PARTITION BY qid ORDER BY least(coalesce(da.df, 0), coalesce(db.df, 0)), i) AS r
  FROM (SELECT qid, i, t[i] AS a, t[i + 1] AS b FROM (SELECT qid, t, unnest(range(1, len(t))) AS i FROM filtered WHERE len(t) >= 2))
  LEFT JOIN {u}_df da ON da.tok = a LEFT JOIN {u}_df db ON db.tok = b) WHERE r <= 4),
{u}_pt AS (SELECT qid, a || ' ' || b AS tok, count(*) AS times FROM {u}_ph GROUP BY ALL)"""


def cascade(out: str, u: str, limit: int) -> str:
    """Needs index(u), pairs(u), phrases(u), AND_TERMS."""
    return f"""{score(out + '_and', u, u + '_p', 'and_terms')},
{score(out + '_or', u, u + '_b', u + '_pt')},
{out}_all AS (SELECT qid, ref, 1 AS stage, score FROM {out}_and JOIN (SELECT DISTINCT qid, n FROM and_terms) USING (qid) WHERE hits = n
  UNION ALL SELECT qid, ref, 2, score FROM {out}_or),
{out}_one AS (SELECT qid, ref, min(stage) AS stage, arg_min(score, stage) AS score FROM {out}_all GROUP BY qid, ref),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, round(score, 9), ref) AS pos FROM {out}_one) WHERE pos <= {limit})"""


def whole(u: str) -> str:
    return f"{index(u)},\n{pairs(u)},\n{phrases(u)}"


def top(scored: str, limit: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), ref) AS pos FROM {scored}) WHERE pos <= {limit}"


MARKS = lambda x: f"replace(strip_accents(lower(coalesce({x}, ''))), 'đ', 'd')"


def doc_rank(out: str, src: str, limit: int) -> str:
    """Boosted ranking of {src} (qid, ref, score) over docs."""
    q, k, t = MARKS("q.text"), MARKS("d.doc_type"), MARKS("d.title")
    return f"""{out}_f AS (SELECT c.qid, c.ref, d.doc_type, d.year, c.score * (1.0 + 0.18 * (3 - coalesce(d.tier, 3))) * (1.0
   + CASE WHEN {q} <> '' AND {k} <> '' AND contains({q}, {k}) THEN 0.12 ELSE 0 END
   + CASE WHEN NOT regexp_matches(q.text, '\\b(19|20)\\d\\d\\b') AND coalesce(d.year, 0) <> 0 THEN least(greatest(d.year - 1990, 0), 40) * 0.006 ELSE 0 END
   - CASE WHEN coalesce(d.expired, 0) <> 0 THEN 0.30 ELSE 0 END
   - CASE WHEN (starts_with({t}, 'sua doi') OR starts_with({t}, 'bai bo') OR starts_with({t}, 'dinh chinh') OR starts_with({t}, 'huong dan'))
       AND NOT contains({q}, 'sua doi') THEN 0.28 ELSE 0 END) AS final
  FROM {src} c JOIN docs d ON d.id = c.ref JOIN queries q USING (qid)),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9), ref) AS pos FROM {out}_f) WHERE pos <= {limit})"""


KEY = "nullif(substr(regexp_replace(lower(substr(coalesce({0}, ''), 1, 220)), '[^0-9a-z\\x{{00e0}}-\\x{{1ef9}}]+', '', 'g'), 1, 160), '')"
PAYLOAD = """pay AS (SELECT 'chunk' AS kind, id AS ref, text, expired, year FROM docs UNION ALL SELECT 'doc', id, '', expired, year FROM docs
  UNION ALL SELECT 'qa', ref, answer, 0, NULL FROM qa UNION ALL SELECT 'term', ref, term || ': ' || definition, 0, NULL FROM terms),
ti AS (SELECT 'chunk' AS kind, id AS ref, title FROM docs UNION ALL SELECT 'doc', id, title FROM docs UNION ALL SELECT 'qa', ref, question FROM qa UNION ALL SELECT 'term', ref, term FROM terms)"""


def fused(p: str, lists: str) -> str:
    """{p}_ranked (qid, kind, ref, rk, key, text, score): RRF of ``lists`` (qid, list_no, pos, kind, ref), first sight wins ties; texts
    with one key become the most authoritative in the first one's place; valid before expired, by score."""
    return f"""{p}_lists AS ({lists}),
{p}_f AS (SELECT qid, kind, ref, sum(1.0 / (60 + pos)) AS score, min(list_no * 1000 + pos) AS first FROM {p}_lists GROUP BY ALL),
{p}_g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, kind, ref) AS pos FROM {p}_f),
{p}_l AS (SELECT qid, kind, ref, pos, score, {KEY.format('text')} AS key, expired, text,
  expired * 1000000 + 80000 + 9999 - coalesce(year, 0) AS authority FROM {p}_g JOIN pay USING (kind, ref)),
{p}_k AS (SELECT *, coalesce(key, chr(1) || pos::VARCHAR) AS kk FROM {p}_l),
{p}_m AS (SELECT *, min(authority) OVER (PARTITION BY qid, kk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(pos) OVER (PARTITION BY qid, kk) AS first_pos, arg_min(score, pos) OVER (PARTITION BY qid, kk) AS first_score FROM {p}_k),
{p}_won AS (SELECT qid, kk, arg_max(kind, pos) AS kind, arg_max(ref, pos) AS ref, any_value(key) AS key, arg_max(expired, pos) AS expired, arg_max(text, pos) AS text,
  any_value(first_pos) AS first_pos, any_value(first_score) AS score FROM {p}_m WHERE before IS NULL OR authority < before GROUP BY qid, kk),
{p}_dd AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN key IS NULL THEN 1 ELSE 0 END, first_pos) AS pos FROM {p}_won),
{p}_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY expired, round(score, 12) DESC, pos) AS rk FROM {p}_dd)"""


def plain(p: str, top: int) -> str:
    """{p}_out without reranking: the first ``top`` as they stand, texts with no key among them."""
    return f"{p}_out AS (SELECT qid, kind, ref, rk AS p, score FROM {p}_ranked WHERE rk <= {top})"


def reranked(p: str, top: int, candidates: int = 32) -> str:
    """{p}_out with the lexical scorer over the first candidates; texts without a key go to the end."""
    return f"""{p}_sc AS (SELECT r.qid, r.kind, r.ref, r.rk, r.key, list_distinct({toks('q.text')}) AS qd, list_distinct({toks("substr(coalesce(title, '') || chr(10) || coalesce(r.text, ''), 1, 800)")}) AS td
  FROM {p}_ranked r JOIN ti USING (kind, ref) JOIN queries q USING (qid) WHERE rk <= {candidates}),
{p}_sd AS (SELECT *, CASE WHEN len(qd) > 0 THEN len(list_intersect(qd, td)) * 1.0 / len(qd) ELSE 0 END AS sim FROM {p}_sc),
{p}_se AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, rk) AS rp FROM {p}_sd),
{p}_out AS (SELECT qid, kind, ref, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN key IS NULL THEN 1 ELSE 0 END, rp) AS p, sim AS score FROM {p}_se WHERE rp <= {top})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
