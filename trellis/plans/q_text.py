"""Queries of texts, conversations, messages and visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from ..operators import ingest as I
from .registry import query

c = F.col


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EXCHANGES = "SELECT conv_id AS id, string_agg((CASE role WHEN 'user' THEN 'Human: ' ELSE 'A: ' END) || text, chr(10) ORDER BY turn, role, text) AS t FROM turns GROUP BY 1"


def exchanges(t):
    one = F.struct("turn", "role", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(F.when(x["role"] == "user", "Human: ").otherwise("A: "), x["text"])), "\n")
    return t.turns.groupBy(c("conv_id").alias("id")).agg(text.alias("t"))


query("txt_01_content_type", lambda t: K.classified(t.documents, "text").select(c("doc_id").alias("id"), "content_type"), K.oracle_sql("SELECT doc_id AS id, text AS t FROM documents"))
query("txt_01_exchange_type", lambda t: K.classified(exchanges(t), "t").select("id", "content_type"), K.oracle_sql(EXCHANGES))
query("txt_02_signals", lambda t: t.documents.select("text", F.lower("text").alias("lower")).select(*(F.count_if(x).alias(name) for name, x in K.rules(c("text"), c("lower")).items())))
query("txt_05_tiers", lambda t: t.nodes.where("is_item").groupBy(K.tier(c("content_type")).alias("tier")).agg(F.count("*").alias("n")), "SELECT CASE WHEN content_type IN ('insight', 'exploration', 'synthesis', 'question', 'planning', 'concept', 'decision', 'paper', 'bookmark') OR content_type ILIKE 'code_%' THEN 'visible' WHEN content_type IN ('investigation', 'discussion', 'reference', 'creative') THEN 'supporting' WHEN content_type IN ('debug', 'code', 'paste', 'trivial') THEN 'hidden' END AS tier, count(*) AS n FROM nodes WHERE is_item GROUP BY 1")
WORDS = f"WITH w AS (SELECT regexp_replace(unnest(regexp_split_to_array(trim(lower(title)), '\\s+')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word FROM nodes), k AS (SELECT word, count(*) AS n FROM w WHERE strlen(word) >= 3 AND word NOT IN {_in(X.KEYWORD_STOP)} AND NOT regexp_matches(word, '^\\p{{N}}+$') GROUP BY 1)"
query("txt_06_title_words", lambda t: X.title_words(t.nodes), WORDS + " SELECT word, n FROM k")
query("txt_06_top_keywords", lambda t: X.top_keywords(t.nodes, 4), WORDS + ", b AS (SELECT * FROM k ORDER BY n DESC, word LIMIT 4) SELECT string_agg(upper(word[1]) || word[2:], ', ' ORDER BY n DESC, word) AS keywords FROM b")
query("txt_07_common_words", lambda t: X.common_words(t.nodes.where("is_item"), share=0.3), f"WITH w AS (SELECT id, unnest(list_distinct(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'))) AS word FROM nodes WHERE is_item) SELECT word, count(*) AS n FROM w WHERE strlen(word) > 2 AND word NOT IN {_in(X.COMMON_STOP)} GROUP BY 1 HAVING count(*) > (SELECT floor(count(*) * 0.3) FROM nodes WHERE is_item)")
query("txt_08_generic_names", lambda t: t.nodes.where(X.is_generic_name(F.coalesce("cluster_label", "title"))).select("id"), f"WITH w AS (SELECT id, list_filter(regexp_split_to_array(trim(lower(coalesce(cluster_label, title))), '\\s+'), lambda x: x <> '') AS ws FROM nodes), g AS (SELECT id, len(ws) AS n, len(list_filter(ws, lambda x: len(list_filter({list(X.GENERIC)}, lambda y: contains(x, y))) > 0)) AS k FROM w) SELECT id FROM g WHERE k > 0 AND k >= (n + 1) // 2")
query("txt_09_capitalised", lambda t: X.capitalised(t.nodes.where("not is_item")).select("word", "n"), "WITH w AS (SELECT id, unnest(list_distinct(regexp_extract_all(title, '\\p{Lu}[\\p{L}\\p{N}]{2,}'))) AS word FROM nodes WHERE NOT is_item) SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3")
query("txt_10_ascii", lambda t: X.ascii_share(t.documents, "text"), "SELECT sum(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / sum(length(text)) > 0.9 AS english FROM documents")
query("txt_11_fts_query", lambda t: t.nodes.select("id", X.fts_query(c("title")).alias("q")), f"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(title), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')), lambda w: strlen(w) >= 3 AND lower(w) NOT IN {_in(X.QUERY_STOP)}), ' OR ') AS q FROM nodes")
BM = "WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS ws FROM documents), k AS (SELECT id, len(ws) AS n, len(list_filter(ws, lambda w: w = 'the')) AS a, len(list_filter(ws, lambda w: w = 'clown')) AS b FROM d), g AS (SELECT count(*) AS docs, avg(n) AS mean, count_if(a > 0) AS da, count_if(b > 0) AS db FROM k) SELECT id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM k, g WHERE "
query("txt_12_bm25_any", lambda t: X.bm25(t.documents.select(c("doc_id").alias("id"), "text"), ["the", "clown"], c("text")), BM + "a > 0 OR b > 0")
query("txt_12_bm25_all", lambda t: X.bm25(t.documents.select(c("doc_id").alias("id"), "text"), ["the", "clown"], c("text"), every=True), BM + "a > 0 AND b > 0")
query("txt_13_resolve", lambda t: X.resolve(t.nodes, "NATION_1"), "WITH f AS (SELECT id FROM nodes WHERE title ILIKE '%NATION_1%') SELECT id, CASE WHEN (SELECT count(*) FROM f) > 1 THEN 'ambiguous' ELSE 'title' END AS how FROM f ORDER BY id LIMIT 10")
query("txt_14_strip_html", lambda t: t.pages.select("page_id", F.md5(X.strip_html(c("html"))).alias("h")), "WITH a AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages) SELECT page_id, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS h FROM a")
GARBAGE = "(strlen(trim(title)) < 5 OR regexp_matches(trim(title), '^[0-9\\s.\\-]*$') OR coalesce((trim(abstract) <> '' AND strlen(trim(abstract)) < 50) OR regexp_matches(trim(abstract), '^[0-9\\s.\\-]*$'), false))"
HASH = "substr(sha256(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) || '|' || coalesce(trim(regexp_replace(lower(abstract), '\\s+', ' ', 'g')), '')), 1, 32)"
query("txt_16_garbage", lambda t: t.papers.where(X.is_garbage(c("title"), c("abstract"))).select("node_id"), f"SELECT node_id FROM papers WHERE {GARBAGE}")
query("txt_17_content_hash", lambda t: t.papers.select("node_id", X.content_hash(c("title"), c("abstract")).alias("hash")), f"SELECT node_id, {HASH} AS hash FROM papers")
query("txt_18_first_line", lambda t: t.documents.select("doc_id", X.first_line_title(c("text")).alias("title")), "WITH l AS (SELECT doc_id, trim(regexp_extract(trim(text), '^([^\\n]*)', 1)) AS line FROM documents) SELECT doc_id, CASE WHEN length(line) > 60 THEN substr(line, 1, 57) || '...' ELSE line END AS title FROM l")
query("txt_18_sentence_title", lambda t: t.messages.where("body is not null").select("id", X.sentence_title(c("body")).alias("title")), "SELECT id, CASE WHEN regexp_matches(substr(body, 1, 80), '(?s)^.[^.!?]*[.!?]') THEN regexp_extract(substr(body, 1, 80), '(?s)^(.[^.!?]*[.!?])', 1) ELSE trim(body) END AS title FROM messages WHERE body IS NOT NULL")
query("txt_19_urls", lambda t: t.pages.select("page_id", X.normalise_url(c("url")).alias("url"), X.domain(c("url")).alias("domain"), X.url_id(c("url"), 12).alias("uid")), "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[.,)\\]]+$', ''), '#.*$', ''), '/$', '') AS url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS domain, substr(sha256(url), 1, 12) AS uid FROM pages")
query("txt_20_agreements", lambda t: I.agreements(t.messages, 40 * 60_000).select("proposal", "id"), f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, id) AS rn FROM messages), x AS (SELECT a.id, p.id AS proposal, row_number() OVER (PARTITION BY a.id ORDER BY p.rn DESC) AS k FROM m a JOIN m p ON p.conversation_id = a.conversation_id AND p.rn BETWEEN a.rn - 10 AND a.rn - 1 AND p.sent_at >= a.sent_at - 2400000 AND p.author <> a.author WHERE regexp_matches(a.body, {_lit(X.AGREES)}) AND regexp_matches(p.body, {_lit(X.PROPOSES)})) SELECT proposal, id FROM x WHERE k = 1")
query("txt_20_decisions", lambda t: I.decisions(t.messages, 400 * 60_000))
query("txt_21_message_tier", lambda t: t.messages.select("id", X.message_tier(F.lit(None).cast("string"), c("body"), F.lit(False)).alias("tier")), "SELECT id, CASE WHEN body IS NULL THEN 'skip' WHEN contains(body, '://') THEN 'full' WHEN strlen(body) < 15 THEN 'skip' ELSE 'full' END AS tier FROM messages")
query("txt_22_call_edges", lambda t: X.call_edges(t.nodes.where("is_item").select("id", F.get_json_object("tags", "$.file_path").alias("name"), F.concat(F.lit("x = Doc("), "title", F.lit(") + len ("), "id", F.lit(")")).alias("code")).withColumn("name", F.when(c("name").isNotNull(), "Doc"))), "SELECT n.id AS caller, (SELECT max(id) FROM nodes WHERE is_item AND json_extract_string(tags, '$.file_path') IS NOT NULL AND tags LIKE '{%') AS callee FROM nodes n WHERE is_item AND n.id <> (SELECT max(id) FROM nodes WHERE is_item AND tags LIKE '{%')")
query("txt_24_json_reply", lambda t: t.nodes.select("id", X.json_reply(F.concat(F.lit('Sure: ```json {"id": "'), "id", F.lit('", "score": 0.5,} ```')), "id string, score double").alias("r")).select("id", "r.score"), "SELECT id, 0.5::DOUBLE AS score FROM nodes")
query("txt_26_identifiers", lambda t: t.papers.select("node_id", X.arxiv_id(F.concat(F.lit("arXiv:2101."), F.lpad(F.expr("substring(node_id, 3)"), 5, "0"))).alias("arxiv"), X.pmc_id(F.concat(F.lit("see pmc"), F.expr("substring(node_id, 3)"))).alias("pmc")), "SELECT node_id, '2101.' || CASE WHEN strlen(substr(node_id, 3)) > 5 THEN substr(node_id, 3, 5) ELSE lpad(substr(node_id, 3), 5, '0') END AS arxiv, 'PMC' || substr(node_id, 3) AS pmc FROM papers")
query("txt_27_durations", lambda t: t.nation.select("n_nationkey", X.duration_ms(F.concat(c("n_nationkey").cast("string"), F.element_at(F.array(*map(F.lit, "mhdwx")), c("n_nationkey") % 5 + 1))).alias("ms")), "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_nationkey * 60000 WHEN 1 THEN n_nationkey * 3600000 WHEN 2 THEN n_nationkey::BIGINT * 86400000 WHEN 3 THEN n_nationkey::BIGINT * 604800000 END AS ms FROM nation")
query("mnt_01_name_similarity", lambda t: t.nodes.where("is_item").select("id", X.jaccard(c("title"), F.concat_ws(" ", c("ai_title"), c("title"))).alias("j")), "WITH w AS (SELECT id, list_distinct(list_filter(list_transform(regexp_split_to_array(trim(lower(title)), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: x <> '')) AS a, list_distinct(list_filter(list_transform(regexp_split_to_array(trim(lower(concat_ws(' ', ai_title, title))), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: x <> '')) AS b FROM nodes WHERE is_item) SELECT id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS j FROM w")
query("key_20_public_urls", lambda t: t.pages.select("page_id", X.is_public_url(c("url")).alias("ok")), "SELECT page_id, regexp_matches(lower(url), '^https?://') AND contains(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '.') AS ok FROM pages")

# ---- conversations and messages
query("ing_01_alternate_pairs", lambda t: I.alternate_pairs(t.turns).select("conv_id", "turn", F.md5(F.coalesce("question", F.lit(""))).alias("q"), F.md5("answer").alias("a")), "WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt, lag(role) OVER w AS lr FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN text ELSE '' END) AS q, md5(CASE WHEN role = 'user' THEN nt ELSE text END) AS a FROM t WHERE (role = 'user' AND nr = 'assistant') OR (role <> 'user' AND NOT (role = 'assistant' AND coalesce(lr, '') = 'user'))")
query("ing_02_block_pairs", lambda t: I.block_pairs(t.turns).select("conv_id", "turn", F.md5("answer").alias("a")), "WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS b FROM turns WHERE role IN ('user', 'assistant')) SELECT conv_id, min(turn) FILTER (role = 'user') AS turn, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (role = 'assistant')) AS a FROM t WHERE b > 0 GROUP BY conv_id, b HAVING count_if(role = 'assistant') > 0")
query("ing_04_new_papers", lambda t: I.new_papers(t.papers, t.papers.where("lang = 'fr'")).select("node_id", "verdict", "in_batch"), f"WITH p AS (SELECT node_id, lower(doi) AS doi, lang, {HASH} AS h, {GARBAGE} AS bad FROM papers), f AS (SELECT * FROM p WHERE lang = 'fr') SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM f) THEN 'id' WHEN doi IS NOT NULL AND doi IN (SELECT doi FROM f WHERE doi IS NOT NULL) THEN 'doi' WHEN bad THEN 'garbage' WHEN h IN (SELECT h FROM f) THEN 'hash' ELSE 'new' END AS verdict, row_number() OVER (PARTITION BY h ORDER BY node_id) > 1 AS in_batch FROM p")
GAPS = "WITH g AS (SELECT *, sent_at - lag(sent_at) OVER w AS gap, author = lag(author) OVER w AS same FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY sent_at, id))"
query("win_05_message_gaps", lambda t: I.message_gaps(t.messages).select("id", "gap_ms", "same_author"), GAPS + " SELECT id, gap AS gap_ms, same AS same_author FROM g")
query("ing_07_threads", lambda t: I.threads(t.messages, 3_600_000, 600_000), GAPS + " SELECT id, conversation_id, sum((NOT coalesce(gap <= 3600000 AND (same OR gap < 600000), false))::INT) OVER (PARTITION BY conversation_id ORDER BY sent_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS thread FROM g")
query("ing_08_thread_edges", lambda t: I.thread_edges(t.messages, 3_600_000, 600_000), GAPS + " SELECT id, weight FROM (SELECT id, round(CASE WHEN same AND gap < 600000 THEN 1.0 ELSE greatest(0, 1 - gap / 3600000) END, 9) AS weight FROM g WHERE gap IS NOT NULL) WHERE weight >= 0.3")
query("ing_06_shared_links", lambda t: I.shared_links(t.messages), "SELECT 'https://site.org/a/' || id AS url, count(*) AS n, min(id) AS first_id FROM messages WHERE contains(body, '://') GROUP BY 1")
query("str_01_page_state", lambda t: I.pages_visited(t.visits).select("url", "visits", "first_seen", "last_seen", "dwell_ms"), "WITH v AS (SELECT *, lag(dwell_ms) OVER (PARTITION BY tab_id ORDER BY seen_at, url, dwell_ms) AS p FROM visits) SELECT url, count(*) AS visits, min(seen_at) AS first_seen, max(seen_at) AS last_seen, sum(coalesce(p, 0))::BIGINT AS dwell_ms FROM v GROUP BY 1")
query("str_04_session_items", lambda t: I.session_items(t.visits), "SELECT session_id, url, row_number() OVER w - 1 AS ordinal, lag(url) OVER w AS previous FROM visits WINDOW w AS (PARTITION BY session_id ORDER BY seen_at, url)")
query("str_06_merge_sessions", lambda t: I.merge_sessions(t.visits, "s-3", "s-4"), "SELECT url, seen_at, row_number() OVER (ORDER BY CASE WHEN session_id = 's-3' THEN 0 ELSE 1 END, seen_at, url) - 1 AS ordinal FROM visits WHERE session_id IN ('s-3', 's-4')")
query("str_02_gap_sessions", lambda t: I.gap_sessions(t.visits, 1_800_000), "WITH v AS (SELECT *, coalesce(seen_at - lag(seen_at) OVER w > 1800000, true)::INT AS new FROM visits WINDOW w AS (PARTITION BY tab_id ORDER BY seen_at, url)), k AS (SELECT *, sum(new) OVER (PARTITION BY tab_id ORDER BY seen_at, url ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM v) SELECT tab_id, session, count(*) AS visits, min(seen_at) AS start FROM k GROUP BY 1, 2")
query("str_09_delta_sync", lambda t: t.nodes.where("updated_at > 900000000000").select("id", "updated_at").unionByName(t.edges.where("created_at > 900000000000").select("id", c("created_at").alias("updated_at"))), "SELECT id, updated_at FROM nodes WHERE updated_at > 900000000000 UNION ALL SELECT id, created_at FROM edges WHERE created_at > 900000000000")
