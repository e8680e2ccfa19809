"""DuckDB SQL of the queries: dense and literal, independent of the Spark plans."""

from __future__ import annotations

from shortlist import constants as C
from workload import views
from workload.queries import COMBINED


def lit(text: str) -> str:
    """SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


def texts(values) -> str:
    """SQL list of text literals."""
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(r'^[\s\p{Z}]+|[\s\p{Z}]+$')}, '', 'g')"


def fold(x: str) -> str:
    blanks = f"regexp_replace(lower({x}), {lit(r'[\p{Z}\r]')}, ' ', 'g')"
    signs = f"regexp_replace({blanks}, {lit(r'[^\x00-\x7F\p{L}\p{N}]')}, '|', 'g')"
    return f"regexp_replace({signs}, {lit(r'[^\x00-\x7F]')}, '_', 'g')"


def found(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def any_of(x: str, patterns) -> str:
    return "(" + " OR ".join(found(x, p) for p in patterns) + ")"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def digest(x: str) -> str:
    return f"md5(coalesce(array_to_string(list_transform({x}, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ','), ''))"


WORD = lit(r"[\p{L}\p{N}]+")
STOP = "(" + ", ".join(lit(w) for w in C.STOP_WORDS) + ")"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {WORD})"


def stem(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN left({w}, length({w}) - 3)"
        f" WHEN {w} LIKE '%ed' AND length({w}) >= 5 THEN left({w}, length({w}) - 2)"
        f" WHEN {w} LIKE '%ies' AND length({w}) >= 5 THEN left({w}, length({w}) - 2)"
        f" WHEN {w} LIKE '%ss' THEN {w}"
        f" WHEN {w} LIKE '%s' AND length({w}) >= 4 THEN left({w}, length({w}) - 1)"
        f" ELSE {w} END"
    )


def encoded(rows: str, key: str, text: str, dim: int) -> str:
    """Hashed term counts of unit length; texts without terms have no row."""
    return f"""places AS (
  SELECT key, ('0x' || left(md5({stem("w")}), 8))::BIGINT % {dim} AS place, count(*) AS n
  FROM (SELECT {key} AS key, unnest({words(text)}) AS w FROM {rows}) WHERE w NOT IN {STOP} GROUP BY ALL),
encoded AS (
  SELECT key, list_transform(range({dim}), lambda i: (coalesce(counts[i], 0) / norm)::FLOAT) AS vector
  FROM (SELECT key, map(list(place), list(n)) AS counts, sqrt(sum(n * n)) AS norm FROM places GROUP BY key))"""


def zeros(dim: int) -> str:
    return f"list_transform(range({dim}), lambda i: 0::FLOAT)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


CATALOG = """catalog AS (
  SELECT d.doc_id AS id, p_name || ' ' || p_brand AS name,
    coalesce(g.url, 'https://catalog.example.com/view/' || d.doc_id || '/') AS url,
    CASE WHEN d.doc_id % 10 = 9 THEN []::VARCHAR[]
      WHEN d.doc_id % 3 = 0 THEN [substr('ABCDEKPS', d.doc_id % 8 + 1, 1), substr('ABCDEKPS', (d.doc_id + 3) % 8 + 1, 1)]
      ELSE [substr('ABCDEKPS', d.doc_id % 8 + 1, 1)] END AS test_types,
    d.text AS description,
    CASE WHEN d.doc_id % 13 = 0 THEN '' WHEN d.doc_id % 17 = 0 THEN 'Variable'
      WHEN d.doc_id % 19 = 0 THEN '30-45 minutes' WHEN d.doc_id % 23 = 0 THEN NULL
      ELSE p_size || ' minutes' END AS duration,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 7 = 0 THEN [level, 'Executive'] ELSE [level] END AS job_levels,
    coalesce(quality = 1, false) AS remote_testing, p_size % 2 = 0 AS adaptive, e.embedding
  FROM documents d JOIN (
    SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'Entry-Level' WHEN 'SMALL' THEN 'Graduate'
      WHEN 'MEDIUM' THEN 'Mid-Professional' WHEN 'STANDARD' THEN 'Professional Individual Contributor'
      WHEN 'LARGE' THEN 'Manager' ELSE 'Director' END AS level FROM part) p ON p_partkey = d.doc_id
  LEFT JOIN pages g ON page_id = d.doc_id
  LEFT JOIN embeddings e ON vec_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

MINUTES = "TRY_CAST(regexp_replace(duration, '[^0-9]', '', 'g') AS INTEGER)"

FLAT = f"""id, name, url, {joined("test_types")} AS test_types, md5(description) AS description_md5, duration,
  {joined("job_levels")} AS job_levels, remote_testing, adaptive, {digest("embedding")} AS embedding_md5"""
FLAT_FULL = FLAT.replace("duration,", "coalesce(duration, '') AS duration,").replace(
    joined("job_levels"), f"coalesce({joined('job_levels')}, '')"
)

# Keyword index.
INDEX = f"""item_terms AS (
  SELECT id, {stem("w")} AS term FROM (SELECT id, unnest({words("name || ' ' || description")}) AS w FROM catalog)
  WHERE w NOT IN {STOP}),
postings AS (SELECT id, term, count(*) AS tf FROM item_terms GROUP BY id, term),
lengths AS (SELECT c.id, count(term) AS length FROM catalog c LEFT JOIN item_terms t ON t.id = c.id GROUP BY c.id),
term_stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
corpus AS (SELECT count(*) AS n_items, avg(length) AS avg_length FROM lengths)"""

NO_FILTERS = """NULL::VARCHAR[] AS f_type, NULL::VARCHAR[] AS f_level, NULL::BOOLEAN AS f_remote,
  NULL::BOOLEAN AS f_adaptive, NULL::INTEGER AS f_minutes"""
FILTERS = """CASE WHEN item_id % 6 = 1 THEN ['K'] END AS f_type,
  CASE WHEN item_id % 6 = 2 THEN ['Manager', 'Director'] END AS f_level,
  CASE WHEN item_id % 6 = 5 THEN true END AS f_remote,
  CASE WHEN item_id % 6 = 3 THEN true WHEN item_id % 6 = 5 THEN false END AS f_adaptive,
  CASE WHEN item_id % 6 = 4 THEN 30 END AS f_minutes"""


def bench(filters: str = NO_FILTERS, text: str = "text") -> str:
    return f"""q AS (SELECT item_id AS query_id, {text} AS text, embedding AS vector, {filters}
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""


ELIGIBLE = f"""eligible AS (
  SELECT q.query_id, c.id FROM q JOIN catalog c ON
    (f_type IS NULL OR coalesce(list_has_any(c.test_types, f_type), false))
    AND (f_level IS NULL OR coalesce(list_has_any(c.job_levels, f_level), false))
    AND (f_remote IS NULL OR c.remote_testing = f_remote)
    AND (f_adaptive IS NULL OR c.adaptive = f_adaptive)
    AND (f_minutes IS NULL OR coalesce({MINUTES} <= f_minutes, false)))"""

RAW = f"""q_terms AS (
  SELECT DISTINCT query_id, {stem("w")} AS term FROM (SELECT query_id, unnest({words("text")}) AS w FROM q)
  WHERE w NOT IN {STOP}),
n_terms AS (SELECT query_id, count(*) AS n FROM q_terms GROUP BY query_id),
raw AS (
  SELECT query_id, id, count(*) AS matched,
    sum(ln(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS raw
  FROM q_terms JOIN postings USING (term) JOIN lengths USING (id) JOIN term_stats USING (term), corpus
  GROUP BY query_id, id)"""

SCORED = """dense AS (
  SELECT e.query_id, e.id, coalesce(raw, 0) AS raw,
    list_cosine_similarity(c.embedding::DOUBLE[], q.vector::DOUBLE[]) AS cosine
  FROM eligible e JOIN q USING (query_id) JOIN catalog c ON c.id = e.id
  LEFT JOIN raw r ON r.query_id = e.query_id AND r.id = e.id),
bounds AS (SELECT query_id, max(raw) AS high, min(raw) AS low FROM dense GROUP BY query_id),
scored AS (
  SELECT query_id, id, raw, CASE WHEN high = 0 THEN 0.0
      WHEN high = low THEN CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END
      ELSE (raw - low) / (high - low) END AS bm25, cosine
  FROM dense JOIN bounds USING (query_id))"""


def fused(alpha: float = C.LEXICAL_WEIGHT, k: int = 10, name: str = "ranked") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM (SELECT query_id, id, bm25, coalesce(cosine, 0) AS cosine,
      {alpha} * bm25 + {1.0 - alpha} * coalesce(cosine, 0) AS score FROM scored))
  WHERE rank <= {k})"""


HYBRID_OUT = f"""query_id, rank, id, {r6("score")} AS score, {r6("bm25")} AS bm25_score, {r6("cosine")} AS cosine_score"""


def hybrid(q: str) -> str:
    return with_(CATALOG, INDEX, q, ELIGIBLE, RAW, SCORED, fused())


def best_words(where: str) -> str:
    return (
        with_(CATALOG, INDEX, bench(FILTERS), ELIGIBLE, RAW)
        + f"""SELECT query_id, rank, id, {r6("raw")} AS bm25_score FROM (
  SELECT query_id, id, raw, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank
  FROM raw JOIN n_terms USING (query_id) JOIN eligible USING (query_id, id) WHERE {where}) WHERE rank <= 10"""
    )


def nearest(q: str, extra: str = "", where: str = "true") -> str:
    return (
        with_(CATALOG, q, ELIGIBLE, *([extra] if extra else []))
        + f"""SELECT query_id, rank, id, {r6("cosine")} AS cosine_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM (
    SELECT e.query_id, e.id, list_cosine_similarity(c.embedding::DOUBLE[], q.vector::DOUBLE[]) AS cosine
    FROM eligible e JOIN q USING (query_id) JOIN catalog c ON c.id = e.id
    WHERE c.embedding IS NOT NULL AND q.vector IS NOT NULL AND {where}))
WHERE rank <= 10"""
    )


CELLS = """cells AS (
  SELECT label, list(mean ORDER BY pos) AS centre FROM (
    SELECT label, pos, avg(embedding[pos]::DOUBLE) AS mean FROM catalog JOIN embeddings USING (embedding), range(1, 65) r(pos)
    WHERE id = vec_id GROUP BY label, pos) GROUP BY label),
probes AS (
  SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id
    ORDER BY round(list_cosine_similarity(centre, vector::DOUBLE[]), 9) DESC, label) AS n FROM q, cells) WHERE n <= 3)"""
CELLS = CELLS.replace("JOIN embeddings USING (embedding)", "c JOIN embeddings v ON v.vec_id = c.id").replace(
    "avg(embedding[pos]", "avg(v.embedding[pos]"
).replace("WHERE id = vec_id ", "")
IN_PROBED = (
    "EXISTS (SELECT 1 FROM probes p JOIN embeddings v ON v.label = p.label"
    " WHERE v.vec_id = c.id AND p.query_id = e.query_id)"
)

ASKED = """asked AS (
  SELECT p_partkey AS ref,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://catalog.example.com/view/' || (p_partkey * 3) || '/' END AS url,
    CASE p_partkey % 6 WHEN 0 THEN upper(full_name) WHEN 1 THEN substr(full_name, 3, 12) WHEN 2 THEN substr(full_name, 4, 5)
      WHEN 3 THEN substr(upper(full_name), 2, 2) WHEN 4 THEN ' ' ELSE full_name || '%' END AS name
  FROM (SELECT *, p_name || ' ' || p_brand AS full_name FROM part))"""


def resolve(names: str, out: str) -> str:
    """Lowest id with an equal name, else lowest id with a name that contains it."""
    return f"""{out} AS (
  SELECT needle, coalesce(
      (SELECT min(id) FROM catalog c WHERE lower(c.name) = needle),
      (SELECT min(id) FROM catalog c WHERE contains(lower(c.name), needle))) AS id
  FROM (SELECT DISTINCT lower(name) AS needle FROM {names}) WHERE {strip("needle")} != '')"""


# Conversations.
def chats(copies: int = 1) -> str:
    n = len(views.PHRASES)
    said = f"""SELECT conv_id, turn, role, CASE
    WHEN role = 'user' THEN ({texts(views.PHRASES)})[(conv_id * 5 + turn) % {n} + 1] || ' ' || text
    WHEN role = 'assistant' AND conv_id % 3 = 0 THEN {lit(views.MARKED + " ")} || text
    WHEN role = 'assistant' THEN {lit(views.NEUTRAL + " ")} || text ELSE text END AS text FROM conversations"""
    if copies == 1:
        return f"chats AS ({said})"
    return f"""chats AS (SELECT conv_id, turn * {copies} + copy AS turn, role, text
  FROM ({said}), range({copies}) r(copy) WHERE copy = 0 OR role = 'user')"""


PROBE_CHATS = f"""chats AS (
  SELECT conv_id, unnest(range(CASE WHEN kind = {len(views.PROBES) - 1} THEN {views.LONG_TALK} ELSE 1 END)) AS turn,
    'user' AS role, {texts(p for _, p, _ in views.PROBES)}[kind + 1] || ' ' || text AS text
  FROM (SELECT conv_id, conv_id % {len(views.PROBES)} AS kind, arg_min(text, turn) AS text FROM conversations
    WHERE role = 'user' GROUP BY conv_id))"""


MARKS = " OR ".join(f"contains(lower(text), {lit(m)})" for m in (*C.PRIOR_MARKERS, *views.SITE))
LEVELS = ", ".join(f"CASE WHEN {found('f', p)} THEN {lit(level)} END" for level, p in C.LEVEL_RULES)


def signal(pattern: str) -> str:
    return f"{found('f', pattern)}::INT"


FACTS = f"""facts AS (
  SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user,
    bool_and(role IN ('user', 'assistant')) AS roles_ok, arg_max(role, turn) = 'user' AS user_last,
    arg_min(role, turn) FILTER (role NOT IN ('user', 'assistant')) AS wrong_role,
    coalesce(bool_or(role = 'assistant' AND ({MARKS})), false) AS prior,
    coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS said
  FROM chats GROUP BY conv_id),
heard AS (
  SELECT *, n_user > {C.MAX_USER_TURNS} AS over_limit, said AS mine,
    {strip("lower(coalesce(mine[-1], ''))")} AS latest,
    array_to_string(mine, ' ') AS context FROM facts),
folded AS (SELECT *, {fold("latest")} AS g, {fold("context")} AS f FROM heard),
flags AS (
  SELECT *, {any_of("g", C.REFUSE_PATTERNS)} AS refuse, {any_of("g", C.COMPARE_PATTERNS)} AS compare,
    {any_of("g", C.REFINE_PATTERNS)} AS refine, {any_of("g", C.CONFIRM_PATTERNS)} AS confirm,
    {" + ".join(signal(p) for p in C.CONTEXT_SIGNALS)} AS score,
    list_filter([{LEVELS}], lambda x: x IS NOT NULL) AS levels,
    CASE WHEN {found("f", C.ADAPTIVE_PATTERN)} THEN true END AS adaptive,
    TRY_CAST(nullif(regexp_extract(f, {lit(C.DURATION_PATTERN)}, 1), '') AS INTEGER) AS duration_max,
    CASE WHEN len(mine) > 1 THEN context || ' ' || mine[-1] ELSE context END AS search_query FROM folded),
state AS (
  SELECT * REPLACE (CASE WHEN len(levels) > 0 THEN levels END AS levels), CASE WHEN latest = '' THEN 'CLARIFY' WHEN refuse THEN 'REFUSE' WHEN compare THEN 'COMPARE'
    WHEN prior AND refine THEN 'REFINE'
    WHEN n_messages >= 3 AND NOT prior AND score >= 1 THEN 'RECOMMEND'
    WHEN n_user <= 1 AND score >= 3 THEN 'RECOMMEND' WHEN n_user > 1 AND score >= 2 THEN 'RECOMMEND'
    WHEN prior AND confirm THEN 'RECOMMEND' ELSE 'CLARIFY' END AS intent,
    CASE WHEN over_limit THEN 'LIMIT' ELSE intent END AS route FROM flags),
valid AS (SELECT * FROM state WHERE roles_ok AND user_last)"""

CHAT_QUERIES = f"""asking AS (
  SELECT conv_id, route, search_query, levels, adaptive, duration_max,
    CASE WHEN route = 'CLARIFY' THEN {C.CLARIFY_TOP_K} ELSE {C.RETRIEVAL_TOP_K} END AS k FROM valid
  WHERE route IN ('RECOMMEND', 'REFINE', 'COMPARE')
    OR (route = 'CLARIFY' AND length(search_query) > {C.CLARIFY_MIN_QUERY_CHARS})),
{encoded("asking", "conv_id", "search_query", views.CHAT_DIM)},
q AS (
  SELECT conv_id AS query_id, search_query AS text, vector, NULL::VARCHAR[] AS f_type,
    CASE WHEN route IN ('RECOMMEND', 'REFINE') THEN levels END AS f_level, NULL::BOOLEAN AS f_remote,
    CASE WHEN route IN ('RECOMMEND', 'REFINE') THEN asking.adaptive END AS f_adaptive,
    CASE WHEN route IN ('RECOMMEND', 'REFINE') THEN duration_max END AS f_minutes
  FROM asking LEFT JOIN encoded ON key = conv_id)"""

CODES = "array_to_string(test_types, ', ')"
CHAT_HITS = f"""hits AS (
  SELECT query_id, rank, c.* FROM ranked JOIN asking ON conv_id = query_id AND rank <= k
  JOIN catalog c ON c.id = ranked.id),
retrieved AS (
  SELECT query_id AS conv_id, count(*) AS n, string_agg(name || '~' || url || '~' || {CODES}, '|' ORDER BY rank) AS recs
  FROM hits WHERE rank <= {C.MAX_RECOMMENDATIONS} GROUP BY query_id)"""


def chat_search(talks: str = chats()) -> list[str]:
    return [
        CATALOG, INDEX, talks, FACTS, CHAT_QUERIES, ELIGIBLE, RAW, SCORED,
        fused(k=C.RETRIEVAL_TOP_K), CHAT_HITS,
    ]


YES_NO = "CASE WHEN {} THEN 'Yes' ELSE 'No' END"
CONTEXTS = f"""contexts AS (
  SELECT asking.conv_id, coalesce(string_agg(block, {lit(chr(10) * 2)} ORDER BY rank), {lit(C.NO_HITS_TEXT)}) AS context
  FROM asking LEFT JOIN (
    SELECT query_id, rank, concat_ws(chr(10), rank || '. ' || name, '   URL: ' || url, '   Test Type: ' || {CODES},
      CASE WHEN description != '' THEN '   Description: ' || CASE WHEN length(description) > 200
        THEN left(description, 200) || '...' ELSE description END END,
      CASE WHEN duration != '' THEN '   Duration: ' || duration END,
      CASE WHEN len(job_levels) > 0 THEN '   Job Levels: ' || array_to_string(job_levels, ', ') END,
      '   Remote Testing: ' || {YES_NO.format("remote_testing")},
      '   Adaptive/IRT: ' || {YES_NO.format("adaptive")}) AS block FROM hits) b ON b.query_id = asking.conv_id
  GROUP BY asking.conv_id)"""
CONTEXTS = CONTEXTS.replace(lit(chr(10) * 2), "chr(10) || chr(10)")

# Raw model texts and their cleaning.
RAW_TEXTS = r"""raw_texts AS (
  SELECT conv_id, CASE kind
    WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || replace(body, '": false}', '": true}') || chr(10) || '```'
    WHEN 2 THEN 'Sure: ' || body || ' Bye.' WHEN 3 THEN replace(body, '"', '''')
    WHEN 4 THEN replace(body, '], ', ',], ') WHEN 5 THEN '  No list for ' || conv_id || ' today. '
    WHEN 6 THEN '{"response": "Other ' || conv_id || '", "assessments": [{"name": "' || name || '", "url": "' || url
      || '", "test_types": "P"}], "end": true}'
    WHEN 7 THEN '{"reply": "' || CASE WHEN conv_id % 20 = 17 THEN ' ' ELSE '' END || '", "recommendations": null, "end_of_conversation": "false"}'
    WHEN 8 THEN head || array_to_string(list_transform(range(12), lambda n: CASE WHEN n IN (3, 7) THEN '{"name": "No url"}'
      ELSE '{"name": "' || name || ' #' || n || '", "url": "' || url || '", "test_type": "K"}' END), ', ') || tail
    ELSE head || '{"name": "' || upper(name) || '", "url": "https://wrong.example.com/x", "test_type": "K"}' || tail
    END AS raw
  FROM (SELECT *, head || '{"name": "' || name || '", "url": "' || url || '", "test_type": "K"}' || tail AS body FROM (
    SELECT conv_id, conv_id % 10 AS kind, coalesce(name, '') AS name, coalesce(url, '') AS url, '{"reply": "Answer ' || conv_id || '", "recommendations": [' AS head,
      '], "end_of_conversation": false}' AS tail
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN catalog ON id = conv_id * 9)))"""

FENCED = lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```")


def is_json(x: str) -> str:
    loose = lit(r",\s*[}\]]")
    return f"(coalesce(json_valid({x}), false) AND NOT regexp_matches({x}, {loose}))"


CLEANED = f"""attempts AS (
  SELECT *, CASE WHEN regexp_matches(t, {FENCED}) THEN {strip(f"regexp_extract(t, {FENCED}, 1)")} END AS fenced,
    nullif(regexp_extract(t, {lit(r"(?s){.*}")}), '') AS braced,
    regexp_replace(replace(t, '''', '"'), {lit(r",\s*([}\]])")}, '\\1', 'g') AS mended
  FROM (SELECT *, {strip("raw")} AS t FROM raw_texts)),
tried AS (
  SELECT *, CASE WHEN {is_json("t")} THEN 1 WHEN {is_json("fenced")} THEN 2 WHEN {is_json("braced")} THEN 3
    WHEN {is_json("mended")} THEN 4 END AS attempt FROM attempts),
parsed AS (
  SELECT *, CASE attempt WHEN 1 THEN t WHEN 2 THEN fenced WHEN 3 THEN braced WHEN 4 THEN mended END::JSON AS doc FROM tried),
recs AS (
  SELECT conv_id, pos, name, url, test_type, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS place FROM (
    SELECT conv_id, pos, item->>'name' AS name, item->>'url' AS url,
      coalesce(item->>'test_type', item->>'test_types', '') AS test_type
    FROM (SELECT conv_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
      SELECT conv_id, CASE WHEN json_type(r) = 'ARRAY' THEN (r->'$[*]') END AS items
      FROM (SELECT conv_id, coalesce(doc->'recommendations', doc->'assessments') AS r FROM parsed))))
  WHERE coalesce(name, '') != '' AND coalesce(url, '') != ''
  QUALIFY place < {C.MAX_RECOMMENDATIONS}),
lists AS (
  SELECT conv_id, count(*) AS n, string_agg(name || '~' || url || '~' || test_type, '|' ORDER BY place) AS recs
  FROM recs GROUP BY conv_id),
normal AS (
  SELECT parsed.conv_id, raw, t, attempt, doc, coalesce(json_type(doc) = 'OBJECT', false) AS is_object,
    coalesce(doc->>'reply', doc->>'response', '') AS reply, coalesce(lists.recs, '') AS recommendations,
    coalesce(coalesce(doc->'end_of_conversation', doc->'end')::VARCHAR NOT IN ('false', 'null', '0', '""', '[]', '{{}}'), false)
      AS end_of_conversation
  FROM parsed LEFT JOIN lists USING (conv_id)),
shown AS (
  SELECT conv_id, CASE WHEN attempt IS NULL THEN t WHEN NOT is_object THEN {lit(C.APOLOGY_REPLY)}
      WHEN reply = '' THEN {lit(C.EMPTY_REPLY)} ELSE reply END AS reply, recommendations, end_of_conversation FROM normal)"""

REPAIRED = f"""{resolve("recs", "by_name")},
repaired AS (
  SELECT conv_id, count(*) AS n, string_agg(name || '~' || url || '~' || test_type, '|' ORDER BY place) AS recs FROM (
    SELECT r.conv_id, r.place, CASE WHEN u.url IS NOT NULL THEN r.name ELSE c.name END AS name,
      CASE WHEN u.url IS NOT NULL THEN r.url ELSE c.url END AS url,
      CASE WHEN u.url IS NOT NULL THEN r.test_type ELSE {CODES} END AS test_type
    FROM recs r LEFT JOIN (SELECT DISTINCT url FROM catalog) u ON u.url = r.url
    LEFT JOIN by_name b ON b.needle = lower(r.name) LEFT JOIN catalog c ON c.id = b.id
    WHERE u.url IS NOT NULL OR c.id IS NOT NULL) GROUP BY conv_id)"""

PLAIN_ANSWERS = f"""answers AS (
  SELECT v.conv_id, route, CASE WHEN route = 'LIMIT' THEN {lit(C.LIMIT_REPLY)} ELSE {lit(C.APOLOGY_REPLY)} END AS reply,
    CASE WHEN route IN ('RECOMMEND', 'REFINE') THEN coalesce(n, 0) ELSE 0 END AS n,
    CASE WHEN route IN ('RECOMMEND', 'REFINE') THEN coalesce(recs, '') ELSE '' END AS recommendations,
    route = 'LIMIT' AS end_of_conversation FROM valid v LEFT JOIN retrieved r ON r.conv_id = v.conv_id)"""

GIVEN_ANSWERS = f"""answers AS (
  SELECT v.conv_id, route, CASE WHEN route = 'LIMIT' THEN {lit(C.LIMIT_REPLY)} ELSE s.reply END AS reply,
    CASE WHEN l.n > 0 AND route IN ('RECOMMEND', 'REFINE', 'COMPARE') THEN coalesce(p.n, 0)
      WHEN route IN ('RECOMMEND', 'REFINE') THEN coalesce(r.n, 0) ELSE 0 END AS n,
    CASE WHEN l.n > 0 AND route IN ('RECOMMEND', 'REFINE', 'COMPARE') THEN coalesce(p.recs, '')
      WHEN route IN ('RECOMMEND', 'REFINE') THEN coalesce(r.recs, '') ELSE '' END AS recommendations,
    CASE WHEN route = 'LIMIT' THEN true ELSE s.end_of_conversation END AS end_of_conversation
  FROM valid v JOIN shown s USING (conv_id) LEFT JOIN lists l USING (conv_id)
  LEFT JOIN repaired p USING (conv_id) LEFT JOIN retrieved r USING (conv_id))"""

ANSWERED = [RAW_TEXTS, CLEANED, REPAIRED, GIVEN_ANSWERS]
CLEAN = with_(CATALOG, RAW_TEXTS, CLEANED)

TRUTH = """truth AS (
  SELECT DISTINCT item_id AS query_id, c.url FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  JOIN catalog c ON c.id = d.doc_id)"""
HIT_TABLE = """predicted AS (SELECT query_id, rank, c.url FROM ranked JOIN catalog c USING (id)),
hit_table AS (
  SELECT t.query_id, t.url, p.url IS NOT NULL AS hit FROM truth t
  LEFT JOIN (SELECT DISTINCT query_id, url FROM predicted WHERE rank <= 10) p ON p.query_id = t.query_id AND p.url = t.url),
recalls AS (
  SELECT q.query_id, count(t.url) AS n_expected, count(t.url) FILTER (hit) AS n_hits,
    CASE WHEN count(t.url) = 0 THEN 1.0 ELSE (count(t.url) FILTER (hit))::DOUBLE / count(t.url) END AS recall
  FROM q LEFT JOIN hit_table t ON t.query_id = q.query_id GROUP BY q.query_id)"""
JUDGED = with_(CATALOG, INDEX, bench(), ELIGIBLE, RAW, SCORED, fused(), TRUTH, HIT_TABLE)

ITEM_ERRORS = "\n".join(
    f"""UNION ALL SELECT conv_id, 10 + pos * 10 + {n}, 'recommendations[' || pos || ']: no {key}'
  FROM entries WHERE json_type(item) = 'OBJECT' AND NOT json_exists(item, '{key}')"""
    for n, key in enumerate(("name", "url", "test_type"))
)
SCHEMA_ERRORS = f"""docs AS (SELECT conv_id, coalesce(doc, '{{}}'::JSON) AS doc FROM parsed),
entries AS (
  SELECT conv_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM (
    SELECT conv_id, doc->'$.recommendations[*]' AS items FROM docs WHERE json_type(doc, 'recommendations') = 'ARRAY')),
errors AS (
  SELECT conv_id, 0 AS n, 'reply: missing' AS error FROM docs WHERE NOT json_exists(doc, 'reply')
  UNION ALL SELECT conv_id, 0, 'reply: not a string' FROM docs WHERE json_type(doc, 'reply') NOT IN ('VARCHAR')
  UNION ALL SELECT conv_id, 0, 'reply: empty' FROM docs WHERE json_type(doc, 'reply') = 'VARCHAR' AND trim(doc->>'reply') = ''
  UNION ALL SELECT conv_id, 1, 'recommendations: missing' FROM docs WHERE NOT json_exists(doc, 'recommendations')
  UNION ALL SELECT conv_id, 1, 'recommendations: not a list' FROM docs WHERE json_type(doc, 'recommendations') NOT IN ('ARRAY')
  UNION ALL SELECT conv_id, 10 + pos * 10, 'recommendations[' || pos || ']: not an object' FROM entries WHERE json_type(item) != 'OBJECT'
  {ITEM_ERRORS}
  UNION ALL SELECT conv_id, 1000, 'end_of_conversation: missing' FROM docs WHERE NOT json_exists(doc, 'end_of_conversation')
  UNION ALL SELECT conv_id, 1000, 'end_of_conversation: not a boolean' FROM docs
    WHERE json_type(doc, 'end_of_conversation') NOT IN ('BOOLEAN'))"""


def chat_state(select: str, copies: int = 1) -> str:
    return with_(chats(copies), FACTS) + select


def given_errors() -> str:
    return """wrong AS (SELECT conv_id AS query_id, place + 1 AS rank, url FROM recs
  WHERE url != '' AND url NOT IN (SELECT url FROM catalog))"""


def summary(answers: str) -> str:
    """Errors and recall of answers whose recommendations are one text."""
    return f"""SELECT count(*) AS n_traces, (count(*) FILTER (trim(reply) = ''))::BIGINT AS n_schema_errors,
  coalesce(sum(n_wrong), 0)::BIGINT AS n_url_errors, {r6("avg(recall)")} AS mean_recall FROM (
  SELECT a.reply, (SELECT count(*) FROM (SELECT split_part(unnest(string_split(nullif(a.recommendations, ''), '|')), '~', 2) AS url)
      WHERE url NOT IN (SELECT url FROM catalog)) AS n_wrong,
    CASE WHEN c.url IS NULL THEN 1.0 WHEN contains(a.recommendations || '|', '~' || c.url || '~') THEN 1.0 ELSE 0.0 END AS recall
  FROM {answers} a LEFT JOIN catalog c ON c.id = a.conv_id * {views.ITEM_STEP})"""


TYPES = texts(COMBINED["test_type"])
JOB_LEVELS = texts(COMBINED["job_level"])

ORACLES = {
    "catalog_scan": with_(CATALOG) + f"SELECT {FLAT} FROM catalog",
    "catalog_ingest": with_(CATALOG, encoded("catalog", "id", "name || ' ' || description", views.CHAT_DIM))
    + f"""SELECT {FLAT_FULL} FROM (SELECT * REPLACE (CASE WHEN id % 3 != 0 AND embedding IS NOT NULL THEN embedding
    ELSE coalesce(vector, {zeros(views.CHAT_DIM)}) END AS embedding) FROM catalog LEFT JOIN encoded ON key = id)""",
    "conversation_fold": with_(chats())
    + """SELECT conv_id, count(*) AS n, md5(string_agg(role || '~' || text, '|' ORDER BY turn)) AS messages_md5
FROM chats GROUP BY conv_id""",
    "catalog_coerce": with_(CATALOG) + f"SELECT {FLAT_FULL} FROM catalog",
    "recommendation_view": with_(CATALOG) + f"SELECT name, url, {CODES} AS test_type FROM catalog",
    "detail_view": with_(CATALOG)
    + f"""SELECT name, url, {joined("test_types")} AS test_types, md5(description) AS description,
  coalesce(duration, '') AS duration, coalesce({joined("job_levels")}, '') AS job_levels, remote_testing, adaptive FROM catalog""",
    "catalog_urls": with_(CATALOG) + "SELECT DISTINCT url FROM catalog",
    "filter_test_type": with_(CATALOG) + "SELECT id, name FROM catalog WHERE list_has_any(test_types, ['K', 'P'])",
    "filter_job_level": with_(CATALOG) + "SELECT id, name FROM catalog WHERE list_has_any(job_levels, ['Executive'])",
    "filter_remote": with_(CATALOG) + "SELECT id, name FROM catalog WHERE remote_testing",
    "filter_adaptive": with_(CATALOG) + "SELECT id, name FROM catalog WHERE NOT adaptive",
    "filter_duration": with_(CATALOG) + f"SELECT id, name FROM catalog WHERE {MINUTES} <= 30",
    "filter_combined": with_(CATALOG)
    + f"""SELECT id, name FROM catalog WHERE list_has_any(test_types, {TYPES}) AND list_has_any(job_levels, {JOB_LEVELS})
  AND NOT remote_testing AND adaptive AND {MINUTES} <= 40""",
    "filter_per_query": with_(CATALOG, bench(FILTERS), ELIGIBLE)
    + """SELECT q.query_id, count(e.id) AS n_eligible FROM q LEFT JOIN eligible e ON e.query_id = q.query_id
GROUP BY q.query_id""",
    "lexical_tokens": f"""SELECT doc_id, coalesce(len(terms), 0) AS n, md5(coalesce(array_to_string(terms, ' '), '')) AS terms_md5 FROM (
  SELECT doc_id, list_transform(list_filter({words("text")}, lambda w: w NOT IN {STOP}), lambda w: {stem("w")}) AS terms
  FROM documents)""",
    "lexical_index": with_(CATALOG, INDEX) + "SELECT id, term, tf, length FROM postings JOIN lengths USING (id)",
    "lexical_term_stats": with_(CATALOG, INDEX) + "SELECT term, df FROM term_stats",
    "lexical_score": with_(CATALOG, INDEX, bench(), RAW) + f"SELECT query_id, id, {r6('raw')} AS raw FROM raw",
    "lexical_match_all": with_(CATALOG, INDEX, bench(), RAW)
    + f"SELECT query_id, id, {r6('raw')} AS raw FROM raw JOIN n_terms USING (query_id) WHERE matched = n",
    "search_lexical": best_words("matched = n"),
    "search_lexical_stored": best_words("matched = n"),
    "search_lexical_any": best_words("true"),
    "vector_normalize": f"""SELECT vec_id, place, {r6("x")} AS x, {r6("norm")} AS norm FROM (
  SELECT vec_id, unnest(u) AS x, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS place,
    sqrt(list_inner_product(u, u)) AS norm FROM (
  SELECT vec_id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS u FROM (
    SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3)) AS v FROM embeddings))))""",
    "text_encode": with_(encoded("documents", "doc_id", "text", C.EMBEDDING_DIM))
    + f"""SELECT doc_id AS query_id, {digest(f"coalesce(vector, {zeros(C.EMBEDDING_DIM)})")} AS vector_md5
FROM documents LEFT JOIN encoded ON key = doc_id""",
    "vector_cosine": f"""SELECT a.vec_id, {r6("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "search_vector": nearest(bench()),
    "search_vector_filtered": nearest(bench(FILTERS)),
    "search_vector_grid": nearest(bench(FILTERS)),
    "search_vector_cells": nearest(bench(FILTERS), CELLS, IN_PROBED),
    "search_vector_stored_cells": nearest(bench(FILTERS), CELLS, IN_PROBED),
    "hybrid_minmax": with_(CATALOG, INDEX, bench(FILTERS), ELIGIBLE, RAW, SCORED)
    + f"SELECT query_id, id, {r6('bm25')} AS bm25_score FROM scored WHERE raw > 0",
    "search_hybrid": hybrid(bench()) + f"SELECT {HYBRID_OUT} FROM ranked",
    "search_hybrid_filtered": hybrid(bench(FILTERS)) + f"SELECT {HYBRID_OUT} FROM ranked",
    "search_hybrid_sparse": hybrid(bench(FILTERS)) + f"SELECT {HYBRID_OUT} FROM ranked",
    "search_hybrid_alpha": with_(
        CATALOG, INDEX, bench(FILTERS), ELIGIBLE, RAW, SCORED, fused(0.0, name="vec"), fused(1.0, name="lex")
    )
    + f"SELECT {HYBRID_OUT}, 0.0 AS alpha FROM vec UNION ALL SELECT {HYBRID_OUT}, 1.0 AS alpha FROM lex",
    "lookup_url": with_(CATALOG, ASKED)
    + f"""SELECT a.url, c.id, name, {joined("test_types")} AS test_types FROM (SELECT DISTINCT url FROM asked) a
LEFT JOIN (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1) c ON c.url = a.url""",
    "lookup_name_exact": with_(CATALOG, ASKED)
    + f"""SELECT lower(a.name) AS needle, min(c.id) AS id FROM asked a JOIN catalog c ON lower(c.name) = lower(a.name)
WHERE {strip("a.name")} != '' GROUP BY 1""",
    "lookup_name": with_(CATALOG, ASKED, resolve("asked", "by_name"))
    + f"""SELECT n.needle, c.id, c.name, c.url, {joined("c.test_types")} AS test_types
FROM (SELECT DISTINCT lower(name) AS needle FROM asked) n LEFT JOIN by_name b USING (needle) LEFT JOIN catalog c ON c.id = b.id""",
    "invalid_urls": with_(CATALOG, ASKED)
    + "SELECT ref, url FROM asked WHERE url != '' AND url NOT IN (SELECT url FROM catalog)",
    "valid_urls": with_(CATALOG, ASKED) + "SELECT ref, url FROM asked WHERE url IN (SELECT url FROM catalog)",
    "repair_recommendations": with_(CATALOG, RAW_TEXTS, CLEANED, REPAIRED)
    + """SELECT conv_id, coalesce(n, 0) AS n, coalesce(recs, '') AS recommendations
FROM raw_texts LEFT JOIN repaired USING (conv_id)""",
    "conversation_validate": chat_state(
        """SELECT conv_id, roles_ok AND user_last AS valid, CASE
  WHEN NOT roles_ok THEN 'invalid role ''' || wrong_role || ''': must be ''user'' or ''assistant'''
  WHEN NOT user_last THEN 'the last message must be from the user' END AS reason FROM facts"""
    ),
    "latest_user_message": chat_state("SELECT conv_id, latest FROM heard"),
    "user_context": chat_state("SELECT conv_id, coalesce(context, '') AS context FROM heard"),
    "turn_limit": chat_state("SELECT conv_id, n_user, over_limit FROM heard", 3),
    **{
        f"flag_{name}": chat_state(f"SELECT conv_id, {name} FROM flags")
        for name in ("refuse", "compare", "refine", "confirm")
    },
    "flag_prior": chat_state("SELECT conv_id, prior FROM facts"),
    "context_score": chat_state("SELECT conv_id, score FROM flags"),
    "classify_intent": chat_state("SELECT conv_id, intent FROM state"),
    "intent_counts": chat_state("SELECT intent, count(*) AS n FROM state GROUP BY intent"),
    "search_query": chat_state("SELECT conv_id, coalesce(search_query, '') AS search_query FROM state"),
    "extract_levels": chat_state(f"SELECT conv_id, {joined('levels')} AS job_level FROM state"),
    "extract_adaptive": chat_state("SELECT conv_id, adaptive FROM state"),
    "extract_duration": chat_state("SELECT conv_id, duration_max FROM state"),
    "extract_filters": chat_state(
        f"""SELECT conv_id, NULL::VARCHAR AS test_type, {joined("levels")} AS job_level, NULL::BOOLEAN AS remote_testing,
  adaptive, duration_max FROM state"""
    ),
    "user_context_long": chat_state("SELECT conv_id, context FROM heard", 3),
    "context_score_long": chat_state("SELECT conv_id, score FROM flags", 3),
    "classify_intent_long": chat_state("SELECT conv_id, intent FROM state", 3),
    "search_query_long": chat_state("SELECT conv_id, search_query FROM state", 3),
    "extract_filters_long": chat_state(
        f"SELECT conv_id, {joined('levels')} AS job_level, adaptive, duration_max FROM state", 3
    ),
    "process_turns": with_(*chat_search(), PLAIN_ANSWERS) + "SELECT * FROM answers",
    "process_turns_answered": with_(*chat_search(), *ANSWERED) + "SELECT * FROM answers",
    "stream_process_turns": with_(*chat_search(), PLAIN_ANSWERS) + "SELECT * FROM answers",
    "route_counts": chat_state("SELECT route, count(*) AS n FROM valid GROUP BY route", 3),
    "catalog_context": with_(*chat_search(), CONTEXTS) + "SELECT conv_id, context FROM contexts",
    "prompt_messages": with_(*chat_search(), CONTEXTS)
    + f"""SELECT conv_id, turn, role, md5(content) AS content FROM (
  SELECT conv_id, -1 AS turn, 'system' AS role, {lit(views.INSTRUCTION)} AS content FROM valid
  UNION ALL
  SELECT c.conv_id, turn, role, CASE WHEN turn < last_turn THEN text
    WHEN x.context IS NOT NULL THEN text || chr(10) || chr(10) || {lit(C.CONTEXT_HEADER)} || chr(10) || x.context || chr(10)
      || {lit(C.CONTEXT_FOOTER)} || chr(10) || chr(10) || {lit(C.JSON_REMINDER)}
    ELSE text || chr(10) || chr(10) || {lit(C.JSON_REMINDER)} END
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM chats) c JOIN valid v ON v.conv_id = c.conv_id
  LEFT JOIN contexts x ON x.conv_id = c.conv_id)""",
    "recover_json": CLEAN
    + "SELECT conv_id, attempt, coalesce(doc->>'reply', doc->>'response') AS reply FROM parsed",
    "normalize_response": CLEAN
    + "SELECT conv_id, is_object, reply, recommendations, end_of_conversation FROM normal",
    "response_fallback": CLEAN + "SELECT * FROM shown",
    "response_emit": CLEAN
    + """SELECT conv_id, '{"reply":' || to_json(reply) || ',"recommendations":[' || coalesce((
    SELECT string_agg('{"name":' || to_json(name) || ',"url":' || to_json(url) || ',"test_type":' || to_json(test_type) || '}',
      ',' ORDER BY place) FROM recs WHERE recs.conv_id = shown.conv_id), '')
  || '],"end_of_conversation":' || end_of_conversation || '}' AS response FROM shown""",
    "eval_schema_errors": with_(CATALOG, RAW_TEXTS, CLEANED, SCHEMA_ERRORS)
    + """SELECT d.conv_id, coalesce(string_agg(error, '|' ORDER BY n), '') AS errors
FROM docs d LEFT JOIN errors e ON e.conv_id = d.conv_id GROUP BY d.conv_id""",
    "eval_url_errors": with_(CATALOG, RAW_TEXTS, CLEANED, given_errors()) + "SELECT * FROM wrong",
    "eval_recall": JUDGED + f"SELECT query_id, n_expected, n_hits, {r6('recall')} AS recall FROM recalls",
    "eval_mean_recall": JUDGED + f"SELECT {r6('avg(recall)')} AS mean_recall FROM recalls",
    "eval_hits": JUDGED + "SELECT query_id, url FROM hit_table WHERE hit",
    "eval_misses": JUDGED + "SELECT query_id, url FROM hit_table WHERE NOT hit",
    "eval_hit_table": JUDGED + "SELECT * FROM hit_table",
    "eval_probes": with_(*chat_search(PROBE_CHATS), PLAIN_ANSWERS)
    + f"""SELECT {texts(n for n, _, _ in views.PROBES)}[kind + 1] AS probe, count(*) FILTER (CASE {texts(r for _, _, r in views.PROBES)}[kind + 1]
  WHEN 'ended' THEN end_of_conversation WHEN 'some_recommendations' THEN n > 0 ELSE n = 0 END) AS n_passed, count(*) AS n_total
FROM (SELECT *, conv_id % {len(views.PROBES)} AS kind FROM answers) GROUP BY 1""",
    "eval_summary": with_(*chat_search(), *ANSWERED) + summary("answers"),
    "eval_summary_unrepaired": CLEAN + summary("shown"),
}

_PAIRS = (
    with_(CATALOG, INDEX, bench(FILTERS), ELIGIBLE, RAW, SCORED)
    + """, near AS (
  SELECT query_id, id, cosine FROM scored WHERE cosine IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) <= 10),
words AS (
  SELECT query_id, id, bm25 FROM scored WHERE raw > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) <= 10),
pairs AS (
  SELECT query_id, id, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine
  FROM (SELECT query_id, id FROM near UNION SELECT query_id, id FROM words)
  LEFT JOIN scored USING (query_id, id))
"""
)
ORACLES["hybrid_join"] = (
    _PAIRS + f"SELECT query_id, id, {r6('bm25')} AS bm25_score, {r6('cosine')} AS cosine_score FROM pairs"
)
ORACLES["hybrid_fuse"] = _PAIRS + f"SELECT query_id, id, {r6('0.4 * bm25 + 0.6 * cosine')} AS score FROM pairs"
# The same lookups from stored names.
ORACLES["lookup_name_stored"] = ORACLES["lookup_name"]
ORACLES["repair_recommendations_stored"] = ORACLES["repair_recommendations"]

# Of each 13 model texts one never comes and one comes too late.
ORACLES["stream_process_turns_answered"] = (
    with_(*chat_search(), PLAIN_ANSWERS.replace("answers AS", "unheard AS"), *ANSWERED)
    + """SELECT * FROM answers WHERE conv_id % 13 > 1
UNION ALL BY NAME SELECT * FROM unheard WHERE conv_id % 13 <= 1"""
)
