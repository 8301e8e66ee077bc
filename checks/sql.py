"""The registered queries in SQL for DuckDB, written independently of the DataFrame code.

Shared steps are named common table expressions; `statement` puts the ones a query needs in front.
"""
from __future__ import annotations

import re

from checks.fixed import KIND_RULES, MODEL_BLOCK, B, C, L, P, Q, V, X

HAN = "㐀-䶿一-鿿" + chr(0xF900) + "-" + chr(0xFAFF)
JOIN = "_·‐-―‧/\\\\-"
WS = "E'\\t\\n\\x0B\\f\\r '"
END = "[。！？；：、）】」”!?;:]$"


def r6(x: str, digits: int = 6) -> str:
    return f"floor(({x})*1e{digits}+0.5)/1e{digits}"


def r3(x: str) -> str:
    return r6(x, 3)


def case_map(column: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def tokens(text: str) -> str:
    low = f"lower({text})"
    return f"""list_concat(regexp_extract_all({low}, '[0-9a-z]+'),
        list_transform(regexp_extract_all({low}, '[0-9a-z]+(?:[{JOIN}]+[0-9a-z]+)+'), lambda w: regexp_replace(w, '[{JOIN}]+', '', 'g')),
        regexp_extract_all({low}, '[{HAN}]'),
        flatten(list_transform(regexp_extract_all({low}, '[{HAN}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"""


def flat(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^0-9a-z{HAN}]', '', 'g')"


def kind_of(x: str) -> str:
    arms = []
    for kind, pattern in KIND_RULES:
        arms.append(f"WHEN regexp_matches({x}, '{pattern}', 'i') THEN '{kind}'")
    return f"CASE {' '.join(arms)} END"


def model_of(cte: str, column: str, least: int) -> str:
    """(doc_id, model) by counting candidates as rows."""
    block = "|".join(MODEL_BLOCK)
    return f"""SELECT doc_id, model FROM (
        SELECT doc_id, model, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(nth)) AS rn, count(*) AS n FROM (
            SELECT doc_id, regexp_replace(m, '[-\\s_]', '', 'g') AS model, nth FROM (
                SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS nth
                FROM (SELECT doc_id, regexp_extract_all({column}, '\\b[A-Z]{{2,4}}[-\\s_]?\\d{{3,5}}[A-Z]?\\b') AS ms FROM {cte}))
            WHERE NOT regexp_matches(m, '^(?:{block})[-\\s_]?\\d'))
        GROUP BY doc_id, model) WHERE rn = 1 AND n >= {least}"""


TS = "TIMESTAMP '2024-01-01'"
PRINTABLE = r"[^\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}A-Za-z0-9\p{P}\s]"

CTE: dict[str, str] = {
    "raw": f"""SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.doc_id AS number,
        d.source || ' ' || upper(d.lang) || '-' || d.doc_id || CASE d.lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.docx' WHEN 'de' THEN '.md' ELSE '.txt' END AS name,
        CASE d.lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'word' WHEN 'de' THEN 'md' ELSE 'txt' END AS type,
        [d.lang, d.source] AS tags, coalesce(l.toxic = 1, false) AS pinned,
        CASE l.quality WHEN 1 THEN 'reviewed' WHEN 0 THEN 'draft' END AS category,
        CAST(strlen(d.text) AS BIGINT) AS size, {TS} + to_minutes(d.doc_id) AS created_at,
        d.lang, d.source, l.quality, l.toxic, d.text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "hashes": "SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) || '-' || length(text) END AS hash FROM raw",
    "name_models": model_of("raw", "name", 1),
    "text_models": model_of("raw", "text", 2),
    "labelled": f"""SELECT r.*, coalesce(n.model, x.model) AS model, coalesce({kind_of('r.name')}, {kind_of('r.text')}) AS kind
        FROM raw r LEFT JOIN name_models n USING (doc_id) LEFT JOIN text_models x USING (doc_id)""",
    "paras": "SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) AS p FROM (SELECT doc_id, string_split_regex(text, '\\n{2,}') AS ps FROM raw)",
    "textlines": f"""SELECT doc_id, p, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM (
        SELECT doc_id, p, list_filter(list_transform(string_split(para, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') AS ls FROM paras)""",
    "flagged": f"""SELECT *, regexp_matches(s, '{END}') AS ends FROM textlines""",
    "hards": """SELECT *, (ends OR coalesce(lead(length(s) < 12 AND NOT ends) OVER (PARTITION BY doc_id, p ORDER BY i), false)) AS hard FROM flagged""",
    "segments": """SELECT *, coalesce(sum(hard::INT) OVER (PARTITION BY doc_id, p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM hards""",
    "longs": "SELECT *, min(CASE WHEN length(s) >= 38 THEN i END) OVER (PARTITION BY doc_id, p, seg) AS fl FROM segments",
    "keyed": "SELECT *, CASE WHEN fl IS NULL OR i < fl THEN i ELSE fl END AS k FROM longs",
    "joints": f"""SELECT *, CASE WHEN regexp_matches(lag(s) OVER w, '[{HAN}）】」”]$') AND regexp_matches(s, '^[{HAN}（【「“]') THEN '' ELSE ' ' END AS joint
        FROM keyed WINDOW w AS (PARTITION BY doc_id, p, seg, k ORDER BY i)""",
    "blocks": f"SELECT doc_id, p, k, trim(string_agg(joint || s, '' ORDER BY i), {WS}) AS block FROM joints GROUP BY doc_id, p, seg, k",
    "pieces": """SELECT doc_id, p, k, unnest(cs) AS content, generate_subscripts(cs, 1) AS c FROM (
        SELECT doc_id, p, k, list_transform(range(1, length(block) + 1, 800), lambda b: substr(block, b, 800)) AS cs FROM blocks)""",
    "chunks": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k, c) - 1 AS INT) AS seq, content FROM pieces",
    "cases": f"""SELECT doc_id AS case_id, name AS title, CASE WHEN toxic = 0 THEN source ELSE '' END AS problem,
        CASE WHEN lang <> 'en' THEN upper(lang) || '-' || doc_id END AS product, lang AS environment,
        CASE WHEN quality = 1 THEN source END AS root_cause, text AS final_fix,
        CASE WHEN quality = 1 AND toxic = 0 THEN 'success' WHEN quality = 1 THEN 'partial' ELSE 'fail' END AS outcome,
        CASE WHEN toxic = 1 THEN 'toxic' END AS notes, tags, toxic = 0 AS verified,
        CASE WHEN quality = 1 THEN created_at END AS occurred_at, {TS} + to_minutes(number + 1440) AS created_at
        FROM raw WHERE quality IS NOT NULL""",
    "casetexts": f"""SELECT case_id, {case_map('outcome', L.CASE_HEADER, "'" + L.CASE_HEADER_UNKNOWN + "'")} || title
        || coalesce(chr(10) || nullif(concat_ws('{C.FIELD_GAP}', '{C.FIELD_PRODUCT}' || product, '{C.FIELD_ENVIRONMENT}' || environment), ''), '')
        || CASE WHEN problem <> '' THEN chr(10) || '{C.FIELD_PROBLEM}' || problem ELSE '' END
        || coalesce(chr(10) || '{C.FIELD_CAUSE}' || root_cause, '')
        || chr(10) || CASE WHEN outcome = 'fail' THEN '{L.FIX_LABEL_FAILED}' ELSE '{L.FIX_LABEL}' END || '：' || final_fix
        || chr(10) || '{C.FIELD_OUTCOME}' || {case_map('outcome', L.OUTCOME_LABEL, 'outcome')}
        || coalesce(chr(10) || '{C.FIELD_NOTES}' || notes, '')
        || chr(10) || '{C.FIELD_TAGS}' || array_to_string(tags, ' ')
        || chr(10) || '{C.FIELD_DATE}' || strftime(coalesce(occurred_at, created_at), '%Y-%m-%d') AS content FROM cases""",
    "casecorpus": "SELECT 'case:' || case_id AS doc_id, 0 AS seq, content FROM casetexts JOIN cases USING (case_id) WHERE verified AND final_fix <> ''",
    "corpus": "SELECT doc_id, seq, content FROM chunks UNION ALL SELECT doc_id, seq, content FROM casecorpus",
    "names": f"""SELECT doc_id, name FROM raw UNION ALL SELECT 'case:' || case_id, '{L.CASE_NAME_PREFIX}' || title FROM cases WHERE verified AND final_fix <> ''""",
    "asked": "SELECT item_id AS query_id, text FROM benchmark",
    "scoped": """SELECT item_id AS query_id, text, length(text) < 150 AS only_pinned, CASE WHEN length(text) > 280 THEN 'reviewed' END AS scope_category,
        CASE WHEN contains(text, 'the') THEN ['en', 'fr'] END AS scope_tags FROM benchmark""",
    "vecs": "SELECT CAST(vec_id AS VARCHAR) AS doc_id, 0 AS seq, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    "turns": "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE role END AS role, text FROM conversations",
    "quoted": """SELECT a.conv_id, a.turn, a.conv_id || '-' || a.turn AS msg_id, q.n, r.doc_id, r.name AS doc_name, r.text FROM turns a
        CROSS JOIN (VALUES (1), (2)) q(n) JOIN raw r ON r.number = CASE q.n WHEN 1 THEN a.conv_id ELSE a.conv_id + a.turn END WHERE a.role = 'ai'""",
    "people": f"""SELECT c_custkey AS id, c_name AS username, CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' ELSE 'user' END AS role, c_acctbal < 0 AS disabled,
        {TS} + to_minutes(c_custkey) AS created_at FROM customer""",
    "creds": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'api' ELSE 'app' END AS kind,
        sha256('secret-' || o_orderkey) AS secret_hash, substr('secret-' || o_orderkey, 1, 12) AS prefix,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 365 DAY END AS expires_at, o_orderstatus = 'F' AS revoked,
        CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders""",
    "replies": f"""SELECT doc_id AS reply_id, CASE WHEN lang <> 'en' THEN upper(lang) || doc_id ELSE '{P.UNKNOWN_MODEL}' END AS model, name, source, quality, toxic,
        NOT (quality = 0 AND toxic = 1) AS usable FROM raw WHERE quality IS NOT NULL""",
    "items": """SELECT reply_id, model, source AS about, 0 AS n, 'quality|score' AS item, '1' AS required, CAST(quality AS VARCHAR) AS actual, CASE quality WHEN 1 THEN 'ok' ELSE 'no' END AS verdict, name AS source, false AS no_data FROM replies WHERE usable
        UNION ALL SELECT reply_id, model, source, 1, 'toxic', '1', CASE toxic WHEN 1 THEN '资料未提供' ELSE '0' END, 'warn', name, toxic = 1 FROM replies WHERE usable""",
    "trimmed": f"""SELECT *, trim(text, {WS}) AS t, CAST(length(text) // 3000 + 1 AS INT) AS n_pages,
        least(1.0, length(regexp_replace(trim(text, {WS}), '{PRINTABLE}', '', 'g')) / greatest(length(trim(text, {WS})), 1)) AS ratio FROM raw""",
    "measured": """SELECT *, CASE type WHEN 'pdf' THEN length(t) >= 20 AND length(t) / n_pages >= 10 WHEN 'word' THEN length(t) >= 10 ELSE t <> '' END AS readable,
        ratio * least(1.0, length(t) / n_pages / 200) AS density FROM trimmed""",
    "parsed": f"""SELECT doc_id, number, name, type, CASE WHEN type = 'pdf' THEN n_pages END AS pages, CASE WHEN readable THEN t END AS txt,
        CASE WHEN type = 'pdf' THEN {r6('density', 2)} WHEN NOT readable THEN 0.0 WHEN type = 'word' THEN {r6('ratio', 2)} ELSE 1.0 END AS quality,
        CASE WHEN type = 'pdf' AND NOT readable THEN '{Q.NOTE_NO_TEXT_LAYER}' WHEN type = 'pdf' AND density < 0.4 THEN '{Q.NOTE_LOW_QUALITY}' WHEN type = 'word' AND NOT readable THEN '{Q.NOTE_EMPTY_BODY}' END AS note FROM measured""",
    "words": """SELECT doc_id, line, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS w FROM (
        SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, string_split(unnest(ls), ' ') AS ws FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM raw))""",
    "spanned": f"""SELECT doc_id, w * 60.0::DOUBLE AS x0, w * 60.0 + least(length(text) * 6.0, 58.0) AS x1, line * 14.0::DOUBLE + CASE WHEN length(text) > 6 THEN 2.0 ELSE 0.0 END + 6.0 AS mid, text
        FROM words WHERE trim(text, {WS}) <> ''""",
    # All spans are 12 points high, so reading order is the order of their middles, and lines lie farther apart than a row reaches.
    "spanrows": """SELECT *, sum(CASE WHEN mid - before > 7.2 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY mid, x0 ROWS UNBOUNDED PRECEDING) AS row_no
        FROM (SELECT *, lag(mid) OVER (PARTITION BY doc_id ORDER BY mid, x0) AS before FROM spanned)""",
}


def ranking(corpus: str, source: str, prefix: str) -> dict[str, str]:
    """BM25 of the queries in `source` (query_id, text) over `corpus`, as CTEs named with `prefix`."""
    p = prefix
    return {
        f"{p}tok": f"SELECT doc_id, seq, unnest({tokens('content')}) AS term FROM {corpus}",
        f"{p}tf": f"SELECT doc_id, seq, term, count(*) AS tf FROM {p}tok GROUP BY ALL",
        f"{p}dl": f"SELECT c.doc_id, c.seq, greatest(coalesce(n, 0), 1) AS dl, {flat('c.content')} AS flat FROM {corpus} c LEFT JOIN (SELECT doc_id, seq, sum(tf) AS n FROM {p}tf GROUP BY ALL) USING (doc_id, seq)",
        f"{p}size": f"SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dl",
        f"{p}df": f"SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM {p}size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {p}tf GROUP BY term",
        f"{p}qt": f"""SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos
            FROM (SELECT query_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS ts FROM {source})) GROUP BY ALL""",
        f"{p}raw": f"""SELECT query_id, doc_id, seq, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm
            FROM {p}qt JOIN {p}df USING (term) JOIN {p}tf USING (term) JOIN {p}dl USING (doc_id, seq), {p}size GROUP BY ALL""",
        f"{p}scored": f"""SELECT s.query_id, s.doc_id, s.seq, bm + CASE WHEN length({flat('q.text')}) >= 2 AND contains(l.flat, {flat('q.text')}) THEN 2.5 ELSE 0 END AS raw
            FROM {p}raw s JOIN {source} q USING (query_id) JOIN {p}dl l USING (doc_id, seq)""",
    }


def ranked(prefix: str, scored: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r6('raw', 9)} DESC, starts_with(doc_id, 'case:'), doc_id, seq) AS rank,
        {r3('1 - 1 / (1 + raw)')} AS score FROM {scored}"""


CTE |= ranking("corpus", "scoped", "k_") | ranking("chunks", "asked", "b_")
CTE["k_ranked"] = ranked("k_", "k_scored")
CTE["b_ranked"] = ranked("b_", "b_scored")
CTE["visible"] = """SELECT q.query_id, r.doc_id FROM scoped q JOIN raw r ON (NOT q.only_pinned OR r.pinned)
    AND (q.scope_category IS NULL OR coalesce(r.category = q.scope_category, false)) AND (q.scope_tags IS NULL OR list_has_any(r.tags, q.scope_tags))"""
CTE["ks_scored"] = """SELECT * FROM k_scored s WHERE starts_with(doc_id, 'case:') OR EXISTS (SELECT 1 FROM visible v WHERE v.query_id = s.query_id AND v.doc_id = s.doc_id)"""
CTE["ks_ranked"] = ranked("k_", "ks_scored")
CTE["sims"] = """SELECT q.item_id AS query_id, v.doc_id, v.seq, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v.vec) AS raw
    FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id CROSS JOIN vecs v"""
SHORT = "CASE WHEN {n} % 3 = 0 THEN CAST({v} AS DOUBLE[])[1:32] ELSE CAST({v} AS DOUBLE[]) END"
CTE["mixed_sims"] = f"""SELECT query_id, doc_id, seq, list_cosine_similarity(a, b) AS raw FROM (
    SELECT q.item_id AS query_id, v.doc_id, v.seq, {SHORT.format(n='q.item_id', v='e.embedding')} AS a, {SHORT.format(n='CAST(v.doc_id AS BIGINT)', v='v.vec')} AS b
    FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id CROSS JOIN vecs v WHERE (q.item_id % 3 = 0) = (CAST(v.doc_id AS BIGINT) % 3 = 0))"""
CTE["chunk_sims"] = "SELECT s.* FROM sims s SEMI JOIN corpus c ON c.doc_id = s.doc_id AND c.seq = s.seq WHERE raw > 0"
CTE["v_ranked"] = ranked("v_", "chunk_sims")
CTE["vs_ranked"] = ranked("v_", "(SELECT s.* FROM chunk_sims s JOIN visible v ON v.query_id = s.query_id AND v.doc_id = s.doc_id)")


def fusion(prefix: str, keyword: str, semantic: str, depth: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}lists": f"""SELECT query_id, doc_id, seq, CASE WHEN starts_with(doc_id, 'case:') THEN 1 ELSE 2 END AS list_no, rank FROM {keyword} WHERE rank <= {depth}
            UNION ALL SELECT query_id, doc_id, seq, 3, rank FROM {semantic} WHERE rank <= {depth}""",
        f"{p}placed": f"SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, list_no ORDER BY rank) AS rank FROM {p}lists",
        f"{p}hits": f"""SELECT l.*, c.doc_id || '::' || c.seq AS hit, c.content FROM {p}placed l JOIN corpus c USING (doc_id, seq)""",
        f"{p}fused": f"""SELECT query_id, hit, sum(CASE list_no WHEN 1 THEN 2.5 ELSE 1.0 END / (60 + rank)) AS rrf, arg_min(doc_id, list_no * 100000 + rank) AS doc_id,
            arg_min(seq, list_no * 100000 + rank) AS seq, arg_min(content, list_no * 100000 + rank) AS content, min(list_no * 100000 + rank) AS first,
            array_to_string(list_transform(list_sort(list(DISTINCT list_no)), lambda x: CASE x WHEN 1 THEN 'case' WHEN 2 THEN 'keyword' ELSE 'semantic' END), '+') AS sources FROM {p}hits GROUP BY query_id, hit""",
        f"{p}order": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r6('rrf', 12)} DESC, first) AS place, {r3('rrf / max(rrf) OVER (PARTITION BY query_id)')} AS score FROM {p}fused""",
    }


def final(prefix: str, top_k: int) -> dict[str, str]:
    p, budget = prefix, max(2, -(-top_k // 3))
    return {
        f"{p}pins": f"""SELECT *, doc_id || '::' || seq AS hit, row_number() OVER (ORDER BY doc_id, seq) AS place FROM corpus SEMI JOIN (SELECT doc_id FROM raw WHERE pinned) USING (doc_id) ORDER BY doc_id, seq LIMIT {budget}""",
        f"{p}pinned": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY place) AS nth FROM {p}pins) WHERE nth = 1",
        f"{p}all": f"""SELECT a.query_id, p.hit, p.doc_id, p.seq, p.content, 1.0 AS score, 'pinned' AS sources, p.place, true AS pinned FROM asked a CROSS JOIN {p}pinned p
            UNION ALL SELECT query_id, hit, doc_id, seq, content, score, sources, place, false FROM {p}order o WHERE hit NOT IN (SELECT hit FROM {p}pinned)""",
        f"{p}ranked": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, place) AS rank, count(*) FILTER (WHERE pinned) OVER (PARTITION BY query_id) AS n_pinned FROM {p}all""",
        f"{p}final": f"""SELECT f.*, coalesce(n.name, '{L.DELETED_NAME}') AS doc_name, CASE WHEN starts_with(f.doc_id, 'case:') THEN 'case' ELSE 'doc' END AS kind,
            CASE WHEN starts_with(f.doc_id, 'case:') THEN substr(f.doc_id, 6) END AS case_id, c.outcome
            FROM {p}ranked f LEFT JOIN names n USING (doc_id) LEFT JOIN cases c ON 'case:' || c.case_id = f.doc_id WHERE rank <= {top_k} + n_pinned""",
    }


CTE |= fusion("f_", "k_ranked", "v_ranked", "24")
CTE |= fusion("h_", "ks_ranked", "vs_ranked", "24") | final("h_", 8)
CTE |= fusion("g_", "ks_ranked", "vs_ranked", "36") | final("g_", 12)
SHOWN = "query_id, CAST(rank AS INT) AS rank, doc_id, doc_name, seq, score, pinned, sources, kind, case_id, outcome"

BLOCKS = f"""SELECT query_id, rank, '[来源' || rank || '] ' || CASE WHEN kind = 'case' THEN '【' || {case_map('outcome', L.CASE_SOURCE, "''")} || '】' || substr(doc_name, {len(L.CASE_NAME_PREFIX) + 1})
    ELSE '《' || doc_name || '》' || CASE WHEN pinned THEN '{X.PINNED_MARK}' ELSE '' END END || chr(10) || content AS block FROM """
CTE["h_blocks"], CTE["g_blocks"] = BLOCKS + "h_final", BLOCKS + "g_final"
CTE["w_blocks"] = """SELECT environment AS query_id, rank, '[来源' || rank || '] 《' || title || '》' || chr(10) || final_fix AS block FROM (
    SELECT *, row_number() OVER (PARTITION BY environment ORDER BY length(final_fix), case_id) AS rank FROM cases)"""


def context(blocks: str) -> str:
    return f"""SELECT query_id, CASE WHEN count(*) FILTER (WHERE NOT fits) > 0 THEN '{X.CUT_HEAD}' || count(*) FILTER (WHERE NOT fits) || '{X.CUT_TAIL}' ELSE '' END
        || string_agg(CASE WHEN fits THEN block WHEN rank = 1 THEN substr(block, 1, 12000) || '{X.CUT_BLOCK}' END, chr(10) || chr(10) ORDER BY rank) AS context,
        CAST(count(*) FILTER (WHERE fits OR rank = 1) AS INT) AS n_used, count(*) FILTER (WHERE NOT fits) AS n_cut
        FROM (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(block) <= 12000 AS fits FROM {blocks})
        GROUP BY query_id"""


CTE["h_context"] = context("h_blocks")
CTE["g_context"] = context("g_blocks")
CTE["w_context"] = context("w_blocks")
CTE["answered"] = """SELECT conv_id, turn, (SELECT arg_max(u.text, u.turn) FROM turns u WHERE u.conv_id = a.conv_id AND u.turn < a.turn AND u.role = 'user') AS question, text AS answer FROM turns a WHERE role = 'ai'"""
CTE["copies"] = "SELECT r.doc_id, r.name, r.category, hash, row_number() OVER (PARTITION BY hash ORDER BY r.created_at, r.doc_id) AS nth FROM raw r JOIN hashes USING (doc_id)"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


SQL: dict[str, str] = {
    "S1_file_types": "SELECT name, size, type FROM raw",
    "S2_route_files": "SELECT name, type, CASE WHEN txt IS NULL THEN 'none' ELSE 'local' END AS source, quality, pages, note, md5(txt) AS text_md5, CAST(length(txt) AS INT) AS chars FROM parsed",
    "S3_import": """SELECT doc_id, name, type, CASE WHEN txt IS NULL THEN 'partial' ELSE 'indexed' END AS status, model, kind, 'inbox' AS category, parse_quality, CAST(coalesce(length(txt), 0) AS INT) AS chars FROM (
        SELECT l.*, txt, p.quality AS parse_quality, row_number() OVER (PARTITION BY coalesce(sha256(txt), l.doc_id) ORDER BY l.number) AS nth FROM labelled l JOIN parsed p USING (doc_id)) WHERE nth = 1""",
    "S4_folder_sync": """SELECT count(*) FILTER (WHERE isnew) AS added, count(*) FILTER (WHERE NOT isnew) AS skipped, (SELECT count(*) FROM parsed WHERE txt IS NULL) AS unreadable FROM (
        SELECT row_number() OVER (PARTITION BY txt ORDER BY number) = 1 AND txt NOT IN (SELECT text FROM raw WHERE category = 'reviewed') AS isnew FROM parsed WHERE txt IS NOT NULL)""",
    "S5_corpus_scan": "SELECT doc_id, seq, name, content FROM chunks JOIN raw USING (doc_id)",
    "S6_upsert": """SELECT r.doc_id, coalesce(c.outcome, r.name) AS name, CASE WHEN c.case_id IS NULL THEN r.category ELSE c.environment END AS category FROM raw r LEFT JOIN cases c ON c.case_id = r.doc_id""",
    "S7_delete_document": """SELECT 'documents' AS part, count(*) AS n FROM raw WHERE NOT pinned UNION ALL SELECT 'chunks', count(*) FROM chunks JOIN raw USING (doc_id) WHERE NOT pinned
        UNION ALL SELECT 'vectors', count(*) FROM vecs LEFT JOIN raw USING (doc_id) WHERE NOT coalesce(pinned, false)""",
    "S6_merge_on_disk": """SELECT r.doc_id, coalesce(c.outcome, r.name) AS name, CASE WHEN c.case_id IS NULL THEN r.category ELSE c.environment END AS category FROM raw r LEFT JOIN cases c ON c.case_id = r.doc_id""",
    "S7_delete_on_disk": """SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks JOIN raw USING (doc_id) WHERE NOT pinned GROUP BY doc_id""",
    "S8_compliance_csv": f"""SELECT reply_id, '{P.CSV_HEAD}' || chr(10) || string_agg('"' || item || '","' || required || '","' || actual || '","' || {case_map('verdict', L.VERDICT_LABEL, "''")} || '","' || source || '"', chr(10) ORDER BY n)
        || chr(10) || chr(10) || '结论,"see ""' || any_value(about) || '""' || '",模型,"' || any_value(model) || '"' AS text, 'csv' AS ext FROM items GROUP BY reply_id""",
    "S9_compliance_markdown": f"""SELECT reply_id, '{P.MARKDOWN_HEAD}' || chr(10) || string_agg('| ' || replace(item, '|', '\\|') || ' | ' || required || ' | ' || actual || ' | ' || {case_map('verdict', L.VERDICT_LABEL, "''")} || ' | ' || source || ' |', chr(10) ORDER BY n)
        || chr(10) || chr(10) || '**结论**：see "' || any_value(about) || '"' || chr(10) || chr(10) || '模型：' || any_value(model) AS text, 'md' AS ext FROM items GROUP BY reply_id""",
    "S10_conversation_markdown": f"""SELECT t.conv_id, t.turn AS part, CASE role WHEN 'user' THEN '{V.HEAD_USER}' ELSE '{V.HEAD_AI}' END || chr(10) || chr(10) || CASE WHEN text = '' THEN '{V.NO_TEXT}' ELSE text END || chr(10)
        || coalesce(chr(10) || '引用来源：' || chr(10) || q.lines || chr(10), '') AS markdown FROM (SELECT * FROM turns WHERE role IN ('user', 'ai')) t LEFT JOIN (
            SELECT conv_id, turn, string_agg('- [' || n || '] 《' || doc_name || '》：' || substr(text, 1, 160), chr(10) ORDER BY n) AS lines FROM quoted GROUP BY ALL) q USING (conv_id, turn)
        UNION ALL SELECT conv_id, -1, '# ' || CASE WHEN coalesce(q, '') = '' THEN '{V.NEW_TITLE}' WHEN length(q) > 14 THEN substr(q, 1, 14) || '…' ELSE q END || chr(10)
        FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q FROM turns GROUP BY conv_id)""",
    "S11_cases_markdown": f"""SELECT CAST(place AS INT) AS place, case_id, '## ' || place || '. ' || title || chr(10) || chr(10) || '- 结果：' || {case_map('outcome', L.OUTCOME_LABEL, 'outcome')} || CASE WHEN verified THEN '' ELSE '（未参与检索）' END
        || coalesce(chr(10) || '- 产品 / 型号：' || product, '') || chr(10) || '- 环境：' || environment || CASE WHEN problem <> '' THEN chr(10) || '- 问题 / 现象：' || problem ELSE '' END
        || coalesce(chr(10) || '- 根因：' || root_cause, '') || chr(10) || '- ' || CASE outcome WHEN 'fail' THEN '{L.FIX_LABEL_FAILED}' ELSE '{L.FIX_LABEL}' END || '：' || final_fix
        || coalesce(chr(10) || '- 注意：' || notes, '') || chr(10) || '- 标签：' || array_to_string(tags, '、') || chr(10) || '- 记录时间：' || strftime(coalesce(occurred_at, created_at), '%Y-%m-%d') || chr(10) AS markdown
        FROM (SELECT *, row_number() OVER (ORDER BY coalesce(occurred_at, created_at) DESC, case_id) AS place FROM cases)""",
    "F1_classify": "SELECT doc_id, model, kind FROM labelled",
    "F2_pick_model": "SELECT r.doc_id, m.model, n.model AS name_model FROM raw r LEFT JOIN cap_models m USING (doc_id) LEFT JOIN name_models n USING (doc_id)",
    "F3_pick_kind": "SELECT doc_id, kind FROM labelled",
    "F4_reclassify": """SELECT r.doc_id, coalesce(l.model, r.category) AS model, coalesce(l.kind, CASE WHEN r.pinned THEN 'other' END) AS kind,
        coalesce(r.category, l.model) AS model_filled, coalesce(CASE WHEN r.pinned THEN 'other' END, l.kind) AS kind_filled FROM raw r JOIN relabelled l USING (doc_id)""",
    "F5_resolve_scope": """SELECT query_id, count(DISTINCT (r.pinned, r.category, r.lang, r.source)) AS signatures, count(*) AS documents FROM visible v JOIN scoped s USING (query_id) JOIN raw r USING (doc_id)
        WHERE only_pinned OR scope_category IS NOT NULL OR scope_tags IS NOT NULL GROUP BY query_id""",
    "F6_library_filter": "SELECT doc_id, name, pinned, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM labelled WHERE list_contains(tags, 'fr') OR model = 'fr'",
    "F7_case_gate": "SELECT case_id, outcome FROM cases WHERE verified AND final_fix <> ''",
    "F8_case_list": """SELECT case_id, title FROM cases WHERE outcome = 'fail' AND contains(lower(concat_ws(' ', title, nullif(problem, ''), root_cause, final_fix, product, environment, notes, array_to_string(tags, ' '))), 'the')""",
    "F9_case_validation": f"""SELECT case_id, CASE WHEN trim(final_fix, {WS}) = '' THEN CASE outcome WHEN 'fail' THEN '{C.ERROR_FIX_FAILED}' ELSE '{C.ERROR_FIX}' END
        WHEN length(final_fix) > 8000 THEN '「' || CASE outcome WHEN 'fail' THEN '{L.FIX_LABEL_FAILED}' ELSE '{L.FIX_LABEL}' END || '」过长（上限 8000 字）' END AS error FROM cases""",
    "F10_complete_case": """SELECT case_id, CASE WHEN problem <> '' THEN substr(problem, 1, 80) ELSE title END AS title, nullif(problem, '') AS problem, CAST(NULL AS VARCHAR) AS notes, verified,
        strftime(created_at - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS created_at FROM cases""",
    "F11_bulk_edits": """SELECT doc_id, pinned OR coalesce(category = 'draft', false) AS pinned, CASE WHEN category = 'draft' THEN NULL ELSE category END AS category,
        CASE WHEN pinned THEN 'kept' WHEN category = 'draft' THEN array_to_string(list_concat(tags, CASE WHEN lang = 'en' THEN ['new'] ELSE ['en', 'new'] END), ',') ELSE array_to_string(tags, ',') END AS tags FROM raw""",
    "F12_rename_category": """SELECT CASE category WHEN 'draft' THEN 'attic' ELSE category END AS category, count(*) AS n, CASE WHEN category = 'draft' THEN count(*) END AS stale FROM raw GROUP BY category""",
    "F13_service_quality": """SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 WHEN length(text) / greatest(ceil(length(text) / 900), 1) < 60 THEN 0.3
        ELSE """ + r6("CAST(printf('%.2f', least(1.0, 0.88 + length(text) / greatest(ceil(length(text) / 900), 1) / 20000)) AS DOUBLE)") + """ END AS quality FROM raw""",
    "F14_local_quality": f"""SELECT doc_id, CASE WHEN n > 0 THEN {r6('least(1.0, ratio) * least(1.0, n / pages / 200)', 2)} ELSE 0.0 END AS quality, n >= 20 AND n / pages >= 10 AS has_text,
        CASE WHEN NOT (n >= 20 AND n / pages >= 10) THEN '{Q.NOTE_NO_TEXT_LAYER}' WHEN least(1.0, ratio) * least(1.0, n / pages / 200) < 0.4 THEN '{Q.NOTE_LOW_QUALITY}' END AS note,
        CASE WHEN n >= 10 THEN {r6('least(1.0, ratio)', 2)} ELSE 0.0 END AS flow_quality
        FROM (SELECT doc_id, length(text) AS n, ceil(length(text) / 150) AS pages, length(regexp_replace(text, '{PRINTABLE}', '', 'g')) / length(text) AS ratio FROM raw)""",
    "F15_url_class": r"""SELECT page_id, host, host <> '' AND (host IN ('localhost', '127.0.0.1', '::1') OR regexp_matches(host, '^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.)')
        OR ends_with(host, '.local') OR ends_with(host, '.lan') OR ends_with(host, '.internal') OR NOT contains(host, '.')) AS private
        FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?\[?([^\]/:?#]+)\]?', 1)) AS host FROM pages)""",
    "J1_chunks_of_pinned": "SELECT name, count(*) AS n, CAST(sum(length(content) + 1) AS BIGINT) AS chars FROM chunks JOIN raw USING (doc_id) WHERE pinned GROUP BY name",
    "J2_name_lookup": f"SELECT v.doc_id, label, coalesce(r.name, '{L.DELETED_NAME}') AS name FROM vecs v LEFT JOIN (SELECT * FROM raw WHERE NOT pinned) r USING (doc_id)",
    "J3_restrict_ids": "SELECT doc_id, seq, content FROM chunks WHERE doc_id IN (SELECT doc_id FROM raw WHERE pinned)",
    "J4_known_hashes": "SELECT doc_id FROM copies WHERE category IS NULL AND (hash IS NULL OR hash NOT IN (SELECT hash FROM copies WHERE category = 'reviewed' AND hash IS NOT NULL))",
    "J5_query_postings": "SELECT query_id, term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS uses, CAST(max(tf) AS INT) AS most FROM b_qt JOIN b_tf USING (term) GROUP BY ALL",
    "J6_same_size_vectors": f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, {r6('raw')} AS score FROM ({ranked('', 'mixed_sims')}) WHERE rank <= 5 AND raw > 0",
    "J7_vectors_with_chunk": "SELECT doc_id, seq, label, CAST(length(content) AS INT) AS chars FROM vecs JOIN chunks USING (doc_id, seq)",
    "J8_case_outcomes": "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, outcome FROM k_ranked LEFT JOIN cases ON 'case:' || case_id = doc_id WHERE rank <= 20",
    "J9_delete_users": "SELECT kind, count(*) AS n, (SELECT count(*) FROM people WHERE NOT disabled) AS users FROM creds WHERE user_id NOT IN (SELECT id FROM people WHERE disabled) GROUP BY kind",
    "J10_citation_quotes": r"""SELECT a.conv_id || '-' || a.turn AS msg_id, c.place AS "at", c.n, coalesce(regexp_replace(q.doc_name, '\.[a-z0-9]+$', '', 'i'), '来源' || c.n) AS label
        FROM turns a CROSS JOIN (VALUES (0, 1), (1, 2), (2, 9)) c(place, n) LEFT JOIN quoted q ON q.conv_id = a.conv_id AND q.turn = a.turn AND q.n = c.n WHERE a.role = 'ai'""",
    "A1_index_terms": f"SELECT term, df, CAST(sum(tf) AS BIGINT) AS uses, {r6('any_value(idf)')} AS idf FROM k_tf JOIN k_df USING (term) GROUP BY term, df",
    "A1_index_size": f"SELECT count(*) AS n, {r6('avg(dl)')} AS avgdl, CAST(sum(dl) AS BIGINT) AS tokens FROM k_dl",
    "A2_case_outcomes": "SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'partial') AS partial, count(*) FILTER (WHERE outcome = 'fail') AS fail FROM cases",
    "A3_case_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM cases) GROUP BY tag",
    "A4_case_totals": "SELECT count(*) AS total, count(*) FILTER (WHERE verified) AS verified FROM cases",
    "A5_chunks_in_scope": "SELECT s.query_id, count(c.doc_id) AS n FROM scoped s LEFT JOIN visible v USING (query_id) LEFT JOIN chunks c USING (doc_id) GROUP BY s.query_id",
    "A6_fingerprint": "SELECT count(*) AS n, CAST(sum(length(content) + 1) AS BIGINT) AS chars, count(*) || ':' || CAST(sum(length(content) + 1) AS BIGINT) AS fingerprint FROM corpus",
    "A7_embedding_stats": "SELECT 'given' AS model, CAST(len(embedding) AS INT) AS dim, count(*) AS n FROM embeddings GROUP BY ALL",
    "A7_embedding_coverage": "SELECT (SELECT count(*) FROM vecs) AS embedded, (SELECT count(*) FROM chunks) AS total",
    "A9_category_counts": "SELECT category, count(*) AS n FROM raw GROUP BY category",
    "A9_unclassified": "SELECT count(*) FILTER (WHERE model IS NULL) AS model, count(*) FILTER (WHERE kind IS NULL) AS kind, CAST(0 AS BIGINT) AS category, count(*) FILTER (WHERE len(tags) = 0) AS tag FROM labelled",
    "A10_by_model": f"SELECT coalesce(model, '{L.UNGROUPED}') AS label, model IS NULL AS ungrouped, count(*) AS n FROM labelled GROUP BY ALL",
    "A10_by_kind": f"SELECT coalesce({case_map('kind', L.KIND_LABEL, 'NULL')}, '{L.UNGROUPED}') AS label, kind IS NULL AS ungrouped, count(*) AS n FROM labelled GROUP BY ALL",
    "A10_by_category": f"SELECT coalesce(category, '{L.UNGROUPED}') AS label, category IS NULL AS ungrouped, count(*) AS n FROM raw GROUP BY ALL",
    "A10_by_tag": "SELECT lang AS label, false AS ungrouped, count(*) AS n FROM raw GROUP BY ALL",
    "A11_tags": "SELECT DISTINCT unnest(tags) AS tag FROM raw",
    "A11_tags_and_models": "SELECT unnest(tags) AS label FROM raw UNION SELECT model FROM labelled WHERE model IS NOT NULL",
    "A12_credentials_per_user": """SELECT p.id, username, role, disabled, count(c.id) FILTER (WHERE c.kind = 'app' AND NOT revoked) AS tokens, count(c.id) FILTER (WHERE c.kind = 'api' AND NOT revoked) AS api_keys
        FROM people p LEFT JOIN creds c ON c.user_id = p.id GROUP BY ALL""",
    "A13_store_counts": "SELECT (SELECT count(*) FROM people) AS users, count(*) FILTER (WHERE kind = 'app') AS tokens, count(*) FILTER (WHERE kind = 'api') AS api_keys FROM creds",
    "A13_other_admins": "SELECT count(*) AS n FROM people WHERE role = 'admin' AND NOT disabled AND id <> 0",
    "A14_verdicts": "SELECT model, verdict, count(*) AS n, count(*) FILTER (WHERE no_data) AS no_data FROM items GROUP BY model, verdict",
    "W1_rank_in_lists": """SELECT query_id, list, CAST(row_number() OVER (PARTITION BY query_id, list ORDER BY rank) AS INT) AS rank, doc_id, seq
        FROM (SELECT *, CASE WHEN starts_with(doc_id, 'case:') THEN 'case' ELSE 'keyword' END AS list FROM k_ranked WHERE rank <= 20)""",
    "W2_chunks": "SELECT doc_id, seq, content, 'para' AS ctype FROM chunks",
    "W4_first_copies": "SELECT doc_id, name FROM copies WHERE nth = 1",
    "W5_nearest_question": "SELECT conv_id, turn, question, answer FROM answered",
    "W8_span_rows": "SELECT doc_id, 1 AS page, count(*) AS rows, max(n) AS widest, sum(top) AS tops FROM (SELECT doc_id, row_no, count(*) AS n, min(mid) AS top FROM spanrows GROUP BY ALL) GROUP BY doc_id",
    "T1_bm25_top": f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, seq, {r6('raw')} AS raw FROM b_ranked WHERE rank <= 3",
    "T2_depth": """SELECT query_id, k AS top_k, greatest(3 * k, 20) AS depth, greatest(2, CAST(ceil(k / 3) AS INT)) AS pinned
        FROM (SELECT query_id, CASE WHEN length(text) / 20 > 0 THEN CAST(floor(length(text) / 20) AS INT) ELSE 8 END AS k FROM asked)""",
    "T3_pinned_chunks": """SELECT query_id, CAST(place - 1 AS INT) AS place, doc_id, seq FROM (
        SELECT query_id, doc_id, seq, place, row_number() OVER (PARTITION BY query_id, doc_id, seq ORDER BY place) AS nth FROM (
            SELECT query_id, greatest(2, CAST(ceil(CAST(floor(length(text) / 20) AS INT) / 3) AS INT)) AS budget FROM asked) a
        JOIN (SELECT c.*, row_number() OVER (ORDER BY doc_id, seq) AS place FROM chunks c JOIN raw r USING (doc_id) WHERE r.pinned) p ON p.place <= a.budget) WHERE nth = 1""",
    "T5_cases_by_time": "SELECT case_id, strftime(coalesce(occurred_at, created_at), '%Y-%m-%d %H:%M:%S') AS at FROM cases",
    "T6_newest_conversations": "SELECT conv_id, max(turn) AS last_turn FROM turns GROUP BY conv_id ORDER BY conv_id DESC LIMIT 30",
    "T6_newest_per_owner": "SELECT conv_id, last_turn FROM (SELECT *, row_number() OVER (PARTITION BY last_turn ORDER BY conv_id DESC) AS nth FROM (SELECT conv_id, max(turn) AS last_turn FROM turns GROUP BY conv_id)) WHERE nth <= 30",
    "T8_newest_documents": "SELECT doc_id, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM raw",
    "X1_corpus": "SELECT doc_id, seq, content FROM corpus",
    "X2_list_union": """SELECT query_id, CASE list_no WHEN 1 THEN 'case' WHEN 2 THEN 'keyword' ELSE 'semantic' END AS list, count(*) AS n, CAST(max(rank) AS INT) AS last, CASE list_no WHEN 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM f_placed GROUP BY query_id, list_no""",
    "X3_tag_union": "SELECT doc_id, array_to_string(list_concat(tags, CASE lang WHEN 'en' THEN ['all'] ELSE ['en', 'all'] END), ',') AS tags FROM raw",
    "X5_unseen_rows": "SELECT doc_id, hash IS NULL OR nth = 1 AS is_new FROM copies",
    "R1_tokens": "SELECT doc_id, seq, CAST(sum(tf) AS BIGINT) AS n, count(*) AS kinds, CAST(sum(tf * length(term)) AS BIGINT) AS chars, max(term) AS last FROM k_tf GROUP BY doc_id, seq",
    "R2_flatten": f"SELECT doc_id, md5({flat('text')}) AS flat FROM raw",
    "R3_idf": f"SELECT query_id, term, df, {r6('idf')} AS idf FROM b_qt JOIN b_df USING (term)",
    "R4_phrase_boost": f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, seq, {r6('raw')} AS raw FROM b_ranked WHERE rank <= 5",
    "R6_keyword_search": f"""SELECT s.query_id, CAST(s.rank AS INT) AS rank, s.doc_id, s.seq, coalesce(n.name, '{L.DELETED_NAME}') AS name, s.score, m.matched FROM ks_ranked s LEFT JOIN names n USING (doc_id)
        JOIN (SELECT query_id, doc_id, seq, string_agg(term, ' ' ORDER BY idf DESC, pos) FILTER (WHERE nth <= 6) AS matched FROM (
            SELECT s.query_id, s.doc_id, s.seq, t.term, d.idf, t.pos, row_number() OVER (PARTITION BY s.query_id, s.doc_id, s.seq ORDER BY d.idf DESC, t.pos) AS nth
            FROM ks_ranked s JOIN k_qt t USING (query_id) JOIN k_tf f ON f.doc_id = s.doc_id AND f.seq = s.seq AND f.term = t.term JOIN k_df d ON d.term = t.term WHERE s.rank <= 10) GROUP BY ALL) m
        ON m.query_id = s.query_id AND m.doc_id = s.doc_id AND m.seq = s.seq WHERE s.rank <= 10""",
    "R7_cosine": f"""SELECT v.doc_id, v.label, {r6('list_cosine_similarity(v.vec, m.mean)')} AS score FROM vecs v JOIN (
        SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vecs) GROUP BY label, i) GROUP BY label) m USING (label)""",
    "R8_semantic_search": f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, seq, {r6('raw')} AS score FROM vs_ranked WHERE rank <= 10",
    "R9_rrf": f"SELECT query_id, CAST(place AS INT) AS place, doc_id, seq, {r6('rrf')} AS rrf, score, sources FROM f_order",
    "W6_share_of_best": "SELECT query_id, max(score) AS best, min(score) AS least, count(*) AS n FROM f_order GROUP BY query_id",
    "R10_hybrid": f"SELECT {SHOWN} FROM h_final",
    "T4_compliance_hits": f"SELECT {SHOWN} FROM g_final",
    "R11_name_search": f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, {r6('score')} AS score FROM name_ranked WHERE rank <= 30",
    "R13_case_text": "SELECT case_id, content FROM casetexts",
    "R14_context": f"""SELECT a.query_id, coalesce(c.context, '{X.EMPTY_CONTEXT}') || coalesce(chr(10) || chr(10) || '{X.ATTACHMENTS_HEAD.strip()}' || chr(10) || '《' || r.name || '》' || chr(10) || r.text, '') AS context,
        coalesce(n_used, 0) AS n_used, coalesce(n_cut, 0) AS n_cut FROM asked a LEFT JOIN h_context c USING (query_id) LEFT JOIN raw r ON r.number = a.query_id AND r.pinned""",
    "W3_context_budget": "SELECT query_id, n_used, n_cut, md5(context) AS context FROM w_context",
    "R15_quotes": f"SELECT query_id, CAST(rank AS INT) AS rank, doc_id, doc_name, substr(content, 1, 160) AS snippet, {r6('score', 2)} AS score, kind, CASE WHEN kind = 'case' THEN outcome END AS outcome FROM h_final",
    "R16_badges": f"""SELECT query_id, CAST(rank AS INT) AS rank, CASE WHEN kind = 'case' AND outcome = 'fail' THEN '{X.BADGE_FAILED}' WHEN kind = 'case' THEN '{X.BADGE_CASE}' WHEN pinned THEN '{X.BADGE_PINNED}'
        WHEN sources = 'keyword+semantic' THEN '{X.BADGE_BOTH}' WHEN sources = 'semantic' THEN '{X.BADGE_SEMANTIC}' WHEN sources = 'keyword' THEN '{X.BADGE_KEYWORD}' ELSE '' END AS badge FROM h_final""",
    "A8_retrieval_stats": """SELECT s.query_id, s.n AS total, count(f.rank) AS hits, count(*) FILTER (WHERE contains(f.sources, 'keyword')) AS kw, count(*) FILTER (WHERE contains(f.sources, 'semantic')) AS sem,
        count(*) FILTER (WHERE f.pinned) AS pinned, count(*) FILTER (WHERE f.kind = 'case') AS cases FROM (SELECT s.query_id, count(c.doc_id) AS n FROM scoped s LEFT JOIN visible v USING (query_id) LEFT JOIN chunks c USING (doc_id) GROUP BY s.query_id) s
        LEFT JOIN h_final f USING (query_id) GROUP BY s.query_id, s.n""",
    "R17_citations": r"""SELECT a.conv_id || '-' || a.turn AS msg_id, coalesce(regexp_replace(q1.doc_name, '\.[a-z0-9]+$', '', 'i'), '来源1') || a.text || '见' || coalesce(regexp_replace(q2.doc_name, '\.[a-z0-9]+$', '', 'i'), '来源2') || '，来源9。' AS text
        FROM turns a LEFT JOIN quoted q1 ON q1.conv_id = a.conv_id AND q1.turn = a.turn AND q1.n = 1 LEFT JOIN quoted q2 ON q2.conv_id = a.conv_id AND q2.turn = a.turn AND q2.n = 2 WHERE a.role = 'ai'""",
    "R18_embed_corpus": """SELECT doc_id, seq, 'hashing' AS model, 16 AS dim, CAST(len(list_filter(string_split(content, ''), lambda ch: ord(ch) % 16 = 0)) AS DOUBLE) AS first, CAST(length(content) AS DOUBLE) AS total FROM chunks""",
    "N1_compat_fold": "SELECT doc_id, '用工，' || text || '（隆）' AS text FROM raw",
    "N2_content_hash": "SELECT doc_id, hash FROM hashes",
    "N3_split_tags": "SELECT doc_id, source || '|' || lang || '|new|tag' AS tags, source || '|' || lang || '|' || source || ' new tag' AS tags_inner FROM raw",
    "N4_paragraphs": """SELECT doc_id, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY p), '') AS text FROM (
        SELECT doc_id, p, string_agg(CASE WHEN prev IS NOT NULL AND regexp_matches(prev, '[A-Za-z0-9]$') AND regexp_matches(s, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || s, '' ORDER BY i) AS para
        FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id, p ORDER BY i) AS prev FROM w_lines) GROUP BY doc_id, p) GROUP BY doc_id""",
    "N5_titles": f"""SELECT conv_id, CASE WHEN coalesce(q, '') = '' THEN '{V.NEW_TITLE}' WHEN length(q) > 14 THEN substr(q, 1, 14) || '…' ELSE q END AS title FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q FROM turns GROUP BY conv_id)""",
    "N6_drafts": f"""SELECT a.conv_id, a.turn, CASE WHEN coalesce(q, '') = '' THEN '{V.NO_QUESTION}' WHEN length(q) > 30 THEN substr(q, 1, 30) || '…' ELSE q END AS title, coalesce(q, '') AS problem,
        b AS ai_advice, d.doc_ids FROM (SELECT conv_id, turn, {_strip('question')} AS q, {_strip('answer')} AS b FROM answered) a
        LEFT JOIN (SELECT conv_id, turn, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS doc_ids FROM quoted GROUP BY ALL) d USING (conv_id, turn)""",
    "N7_meta_line": f"""SELECT doc_id, sz AS size, concat_ws(' · ', model, {case_map('kind', L.KIND_LABEL, 'NULL')}, nullif(sz, ''), CASE WHEN length(text) > 0 THEN '{B.SOURCE_LABEL['local']} ' || length(text) || '字' ELSE '{B.SOURCE_NONE}' END) AS line
        FROM (SELECT *, CASE WHEN size = 0 THEN '' WHEN size >= 1048576 THEN printf('%.1f MB', floor(size / 1048576 * 10 + 0.5) / 10) WHEN size >= 1024 THEN CAST(floor(size / 1024 + 0.5) AS BIGINT) || ' KB' ELSE size || ' B' END AS sz FROM labelled)""",
    "N8_span_lines": f"""SELECT doc_id, CAST(1 AS BIGINT) AS pages, string_agg(line, chr(10) ORDER BY row_no) AS text FROM (
        SELECT doc_id, row_no, trim(string_agg(CASE WHEN x0 - lag_x1 > 12 * 0.45 THEN ' ' ELSE '' END || text, '' ORDER BY x0), {WS}) AS line
        FROM (SELECT *, lag(x1) OVER (PARTITION BY doc_id, row_no ORDER BY x0) AS lag_x1 FROM spanrows) GROUP BY doc_id, row_no) GROUP BY doc_id""",
    "N9_parse_reply": """SELECT reply_id, model, n, item, required, actual, verdict, source, no_data FROM items
        UNION ALL SELECT reply_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM replies WHERE NOT usable""",
    "N10_prompt": "SELECT query_id, '" + P.PROMPT_OPEN.replace("'", "''") + "' || text || '" + P.PROMPT_CONTEXT + f"' || coalesce(context, '{X.EMPTY_CONTEXT}') || '" + P.PROMPT_CLOSE + "' AS prompt FROM asked LEFT JOIN g_context USING (query_id)",
    "N11_chat_history": f"""SELECT conv_id, turn, CASE role WHEN 'ai' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN {_strip('text')} = '' THEN '{V.SEE_ATTACHMENT}' ELSE text END AS content
        FROM turns WHERE role IN ('user', 'ai') AND NOT (role = 'ai' AND starts_with(text, '{V.ERROR_MARK}'))""",
    "L1_case_labels": f"""SELECT case_id, {case_map('outcome', L.CASE_HEADER, "''")} AS header, {case_map('outcome', L.CASE_SOURCE, "''")} AS source,
        CASE outcome WHEN 'fail' THEN '{L.FIX_LABEL_FAILED}' ELSE '{L.FIX_LABEL}' END AS fix, {case_map('outcome', L.OUTCOME_VERDICT, "''")} AS verdict FROM cases""",
    "D0_expiry": "SELECT id, CASE kind WHEN 'api' THEN strftime(created_at + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') END AS ends FROM creds",
    "C1_credential_status": """SELECT request_id, status, CASE WHEN status = 'ok' THEN user_id END AS user_id FROM (
        SELECT 'o' || c.id AS request_id, c.user_id, CASE WHEN revoked THEN 'revoked' WHEN expires_at < TIMESTAMP '2000-01-01' THEN 'expired' WHEN coalesce(p.disabled, true) THEN 'disabled' ELSE 'ok' END AS status
        FROM creds c LEFT JOIN people p ON p.id = c.user_id UNION ALL SELECT 'c' || id, NULL, CASE WHEN disabled THEN 'missing' ELSE 'unknown' END FROM people)""",
    "C2_credential_list": f"""SELECT c.id, c.user_id, coalesce(p.username, '{L.UNKNOWN_NAME}') AS username, prefix, revoked, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at
        FROM creds c LEFT JOIN (SELECT * FROM people WHERE NOT disabled) p ON p.id = c.user_id WHERE kind = 'api'""",
    "D1_dedupe": """SELECT doc_id, hash IS NULL OR (hash NOT IN (SELECT hash FROM copies WHERE category = 'reviewed' AND hash IS NOT NULL) AND nth = 1) AS is_new
        FROM (SELECT doc_id, hash, row_number() OVER (PARTITION BY hash ORDER BY created_at, doc_id) AS nth FROM raw JOIN hashes USING (doc_id) WHERE category IS NULL)""",
    "D2_repeated_sync": """SELECT count(*) AS documents, count(DISTINCT hash) AS contents, (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM copies WHERE nth = 1)) AS chunks, CAST(0 AS BIGINT) AS added_again FROM copies WHERE nth = 1""",
}

# Names with codes, for R11 and R12.
CTE["caps"] = """SELECT doc_id, upper(lang) || ' ' || doc_id || ' ' || upper(source) || ' QX- QX-' || doc_id || ' QX' || doc_id || chr(10) || upper(text) AS code FROM raw"""
CTE["cap_models"] = model_of("caps", "code", 2)
CTE["openings"] = "SELECT doc_id, string_agg(content, chr(10) ORDER BY seq) AS opening FROM chunks GROUP BY doc_id"
CTE["opening_models"] = model_of("openings", "opening", 2)
CTE["relabelled"] = f"""SELECT r.doc_id, coalesce(n.model, x.model) AS model, coalesce({kind_of('r.name')}, {kind_of("coalesce(o.opening, '')")}) AS kind
    FROM raw r LEFT JOIN openings o USING (doc_id) LEFT JOIN name_models n USING (doc_id) LEFT JOIN opening_models x USING (doc_id)"""
CTE["coded"] = "SELECT item_id AS query_id, concat_ws(' ', 'src' || item_id, 'FR', 'pdf', 'de-' || item_id, text) AS text FROM benchmark"
CTE["long_asked"] = "SELECT item_id AS query_id, 'src1 en ' || text AS text FROM benchmark"


def name_ranking(prefix: str, source: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}name_terms": f"SELECT DISTINCT query_id, unnest({tokens('text')}) AS term FROM {source}",
        f"{p}name_toks": f"SELECT DISTINCT doc_id, created_at, unnest({tokens('name')}) AS term FROM raw",
        f"{p}name_hits": f"""SELECT query_id, doc_id, created_at, count(*) AS n_hits, count(*) / any_value(n) * 3.0 + count(*) * 0.2 AS score FROM {p}name_terms JOIN {p}name_toks USING (term)
            JOIN (SELECT query_id, count(*) AS n FROM {p}name_terms GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id, created_at""",
        f"{p}name_ranked": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r6('score', 9)} DESC, created_at DESC, doc_id) AS rank FROM {p}name_hits",
    }


CTE |= name_ranking("", "coded") | name_ranking("l_", "long_asked") | ranking("corpus", "long_asked", "l_")
CTE["l_ranked"] = ranked("l_", "l_scored")
CTE["found"] = """SELECT query_id, 'doc' AS kind, doc_id, upper(r.type) || ' 文档' AS snippet, score, 0 AS part, rank AS place FROM l_name_ranked JOIN raw r USING (doc_id) WHERE rank <= 30
    UNION ALL SELECT query_id, CASE WHEN starts_with(doc_id, 'case:') THEN 'case' ELSE 'chunk' END, doc_id, content, score, 1, rank FROM l_ranked JOIN corpus USING (doc_id, seq) WHERE rank <= 30"""
SQL["R12_search_all"] = f"""SELECT query_id, CAST(rank AS INT) AS rank, kind, doc_id, coalesce(n.name, '{L.DELETED_NAME}') AS doc_name, md5(snippet) AS snippet, {r6('score')} AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r6('score', 9)} DESC, part, place) AS rank FROM found) LEFT JOIN names n USING (doc_id) WHERE rank <= 30"""
CTE["w_paras"] = r"SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) AS p FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\. ', E'.\n\n ', 'g'), '\n{2,}') AS ps FROM raw)"
CTE["w_lines"] = CTE["textlines"].replace("FROM paras", "FROM w_paras")
CTE["case_asked"] = "SELECT CAST(case_id AS BIGINT) AS query_id, content AS text FROM casecorpus JOIN (SELECT case_id, 'case:' || case_id AS doc_id FROM cases) USING (doc_id) UNION ALL SELECT item_id, text FROM benchmark"
CTE["case_runs"] = f"SELECT query_id, text, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT query_id, text, regexp_extract_all(lower(text), '[0-9a-z{JOIN}]+|[{HAN}]+') AS rs FROM case_asked)"
CTE["case_toks"] = f"""SELECT query_id, text, i, unnest(ts) AS term, generate_subscripts(ts, 1) AS j FROM (SELECT query_id, text, i, CASE WHEN regexp_matches(r, '^[{HAN}]$') THEN [r]
    WHEN regexp_matches(r, '^[{HAN}]') THEN list_transform(range(1, length(r)), lambda k: substr(r, k, 2)) ELSE {tokens('r')} END AS ts FROM case_runs)"""
SQL["R1_query_tokens"] = """SELECT query_id, string_agg(term, ' ' ORDER BY i, j) AS tokens FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, text, term ORDER BY i, j) AS nth FROM case_toks) WHERE nth = 1 GROUP BY query_id, text"""


def statement(name: str) -> str:
    """The SQL of a query with the common table expressions it uses, in order of dependence."""
    needed: dict[str, str] = {}

    def add(sql: str) -> None:
        for word in re.findall(r"[a-z]\w*", re.sub(r"'(?:[^']|'')*'", "''", sql)):
            if word in CTE and word not in needed and word not in adding:
                adding.add(word)
                add(CTE[word])
                needed[word] = CTE[word]

    adding: set[str] = set()
    add(SQL[name])
    if not needed:
        return SQL[name]
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in needed.items()) + "\n" + SQL[name]
