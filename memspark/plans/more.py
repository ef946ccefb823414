"""More operators' queries: single writes, row constructors, code functions, folds with exact neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import code, scoring, text
from ..functions.hashing import hash_embed
from ..operators import code_index, cycle, dml, folds, graph, layers, metrics, scan, search, stats
from ..schema import L5, Config, MemoryState
from . import views
from .queries import _FILES, _NEXT, DIM, _next_nations, query
from .views import NOW, sql, table


def _facts_state(spark, d) -> MemoryState:
    return MemoryState.empty(spark, memories=layers.memory_rows(views.facts(spark, d).drop("doc_id"), NOW))


# --- scans


@query(sql("vectors", body="SELECT id FROM vectors WHERE id % 5 <> 0"))
def searchable(spark, d):
    v = views.vectors(spark, d)
    return scan.with_vectors(v.withColumn("embedding", F.when(F.col("id") % 5 != 0, F.col("embedding"))), DIM).select("id")


@query(sql("vectors", body="SELECT count(*) AS n FROM vectors WHERE id % 5 <> 0 AND id % 7 <> 0"))
def index_remove_size(spark, d):
    v = views.vectors(spark, d).withColumn("embedding", F.when(F.col("id") % 5 != 0, F.col("embedding")))
    return search.size(search.remove(v, v.where("id % 7 = 0").select("id")))


@query(f"WITH {_FILES} SELECT path || ':' || (i * 40 + 1) AS memory_id, i * 40 + 1 AS line_start FROM (SELECT path, lines, unnest(range(0, (len(lines) - 1) // 40 + 1)) AS i FROM c) WHERE path = (SELECT min(url) FROM pages)")
def symbols_of_file(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    s = code_index.chunks(p).select(F.col("path").alias("file_path"), F.col("line_start").cast("long").alias("line_start"), F.concat_ws(":", "path", "line_start").alias("memory_id"))
    return scan.symbols_of_file(s, p.agg(F.min("path")).first()[0]).select("memory_id", "line_start")


@query("SELECT 'known' AS asked, (SELECT n_regionkey::VARCHAR FROM nation WHERE n_nationkey = 7) AS value UNION ALL SELECT 'unknown', ''")
def meta_value(spark, d):
    n = table(spark, d, "nation")
    m = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    known = n.where("n_nationkey = 7").first()["n_name"]
    return scan.meta_value(m, known).select(F.lit("known").alias("asked"), "value").unionAll(scan.meta_value(m, "no such key").select(F.lit("unknown").alias("asked"), "value"))


@query(sql("facts", body="SELECT id FROM facts WHERE workspace = 'ws1'"))
def tenant_rows(spark, d):
    return scan.tenant(views.facts(spark, d), scan.authorise("", "ws1")).select("id")


@query(sql("facts", body="SELECT id FROM facts WHERE doc_id % 3 <> 0"))
def live_rows(spark, d):
    n = F.col("doc_id") % 3
    marks = F.when(n == 0, F.lit('{"superseded_by":"x"}')).when(n == 1, F.lit('{"superseded":false}')).otherwise(F.lit("{}"))
    return scan.live(views.facts(spark, d).withColumn("metadata", marks)).select("id")


# --- writes


@query("SELECT 'e-' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def put_edges_checked(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"))
    state = MemoryState.empty(spark, memories=layers.memory_rows(c.unionAll(o), NOW, layer="L2_semantic", type="fact"))
    return dml.put_edges(state, views.edges(spark, d)).edges.select("id")


@query(f"WITH {_NEXT} SELECT src_symbol, dst_symbol, 2::BIGINT AS n FROM r")
def append_refs(spark, d):
    r = _next_nations(spark, d).withColumn("ref_kind", F.lit("calls")).withColumn("workspace", F.lit("ws")).withColumn("file_path", F.lit("f"))
    return dml.append_refs(MemoryState.empty(spark, refs=r), r).refs.groupBy("src_symbol", "dst_symbol").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS value FROM nation UNION ALL SELECT 'fresh', 'new'")
def put_meta(spark, d):
    n = table(spark, d, "nation")
    state = MemoryState.empty(spark, meta=n.select(F.col("n_name").alias("key"), F.lit("old").alias("value")))
    rows = n.where("n_regionkey = 1").select(F.col("n_name").alias("key"), F.lit("new").alias("value"))
    return dml.put_meta(state, rows.unionAll(spark.createDataFrame([("fresh", "new")], "key string, value string"))).meta


@query("SELECT n_name AS username, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE 'ws' || n_regionkey END AS workspace FROM nation WHERE n_regionkey <> 2")
def users_crud(spark, d):
    def rows(n, workspace: Column):
        return n.select(F.col("n_name").alias("username"), F.lit("x").alias("password_hash"), workspace.alias("workspace"), F.lit(False).alias("admin"), F.lit(NOW).alias("created_at"))

    n = table(spark, d, "nation")
    state = MemoryState.empty(spark, users=rows(n, F.concat(F.lit("ws"), F.col("n_regionkey").cast("string"))))
    state = dml.put_users(state, rows(n.where("n_regionkey = 1"), F.lit("moved")))
    state = dml.drop_users(state, n.where("n_regionkey = 2").select(F.col("n_name").alias("username")))
    return scan.users(state.users).select("username", "workspace")


@query("SELECT 'p-' || p_partkey AS id FROM part WHERE NOT (p_partkey % 4 = 1 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey < 3))")
def delete_by_symbol(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("ws"), (F.col("p_partkey") % 4).cast("string")).alias("workspace"), "p_brand", "p_partkey")
    symbols = p.select(F.col("id").alias("memory_id"), F.lit("f").alias("file_path"), F.lit("class").alias("symbol_kind"), F.col("p_brand").alias("qualified_name"), F.lit("").alias("signature"), F.lit("").alias("docstring"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("c").alias("language"))
    state = MemoryState.empty(spark, memories=layers.memory_rows(p, NOW, layer="L2_semantic", type="code_symbol"))
    state = dml.put_symbols(state, symbols)
    return dml.delete_by_symbol(state, p.where("p_partkey < 3").select(F.col("p_brand").alias("qualified_name")), "ws1").memories.select("id")


@query(sql("facts", body="SELECT id, length(content)::BIGINT AS value FROM facts"))
def reembed(spark, d):
    m = _facts_state(spark, d).memories
    return dml.reembed(m, F.array(F.length("content").cast("float"))).select("id", F.col("embedding")[0].cast("long").alias("value"))


# --- rows of the layers

_TURN = "conv_id || '_' || turn"


@query(f"SELECT {_TURN} AS id, 'L2_semantic' AS layer, 'fact' AS type, CASE WHEN turn % 2 = 1 AND coalesce(role, '') <> '' THEN role ELSE substr(coalesce(text, ''), 1, 80) END AS summary FROM conversations")
def fact_rows(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("summary"))
    return layers.facts(c, NOW).select("id", "layer", "type", "summary")


@query("SELECT 'f' || page_id AS id, 'page ' || page_id AS content, 'page ' || page_id AS summary, 'code,html' AS tags, url AS file_path FROM pages")
def code_file_rows(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("file_summary"), F.lit("html").alias("language"))
    return layers.code_files(p, NOW).select("id", "content", "summary", F.array_join("tags", ",").alias("tags"), F.get_json_object("metadata", "$.file_path").alias("file_path"))


@query("SELECT p_partkey::VARCHAR AS id, p_name || chr(10) || '```' || p_brand || chr(10) || p_type || chr(10) || '```' AS content, 'snippet,' || p_brand AS tags FROM part")
def snippet_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("code"), F.col("p_brand").alias("code_language"))
    return layers.snippets(p, NOW).select("id", "content", F.array_join("tags", ",").alias("tags"))


@query("SELECT p_partkey::VARCHAR AS id, p_name || chr(10) || '1. ' || p_brand || chr(10) || '2. ' || p_type AS content, p_name AS summary, p_brand || ',playbook' AS tags, p_type AS step FROM part")
def playbook_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("steps"), F.array("p_brand").alias("tags"))
    return layers.playbooks(p, NOW).select("id", "content", "summary", F.array_join("tags", ",").alias("tags"), F.get_json_object("metadata", "$.steps[1]").alias("step"))


# --- functions


@query("SELECT o_orderkey, round(greatest(0.05, o_totalprice / 1000000 * 0.5 / (o_orderkey % 3 + 1)), 6) AS s FROM orders")
def expanded_similarity(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(scoring.expanded_similarity(F.col("o_totalprice") / 1000000, F.col("o_orderkey") % 3 + 1, 0.5), 6).alias("s"))


@query(f"""SELECT {_TURN} AS id, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_lines, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags,
    '{{"a": ' || conv_id || '}}' AS object FROM (SELECT *, coalesce(text, '') AS t FROM conversations)""")  # fmt: skip
def text_parts(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    reply = F.concat(F.lit('yes: {"a": '), F.col("conv_id").cast("string"), F.lit("} so"))
    return c.select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.size(text.split_lines("t")).cast("long").alias("n_lines"), F.array_join(text.split_tags("t"), "|").alias("tags"), text.json_object(reply).alias("object"))


_EXT = (".py", ".js", ".go", ".rs", ".java", ".c", ".kt", ".PY", ".xyz", ".index.ts")
_LANG = ("python", "javascript", "go", "rust", "java", "c", "kotlin", "python", "", "typescript")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_brand, p_type, ({list(_EXT)})[p_partkey % 10 + 1] AS ext, ({list(_LANG)})[p_partkey % 10 + 1] AS language FROM part),
    m AS (SELECT *, 'src.' || k || CASE WHEN k % 10 IN (6, 7, 8) THEN ext ELSE '' END AS module, CASE WHEN k % 2 = 0 THEN p_brand ELSE 'n' || k END AS name FROM p)
    SELECT k, language, module, CASE WHEN k % 3 = 0 THEN 'Outer.' || name ELSE module || '.' || name END AS qualified, k % 2 = 1 AS is_name, k % 4 = 0 AS skipped, 'a' || chr(10) || name AS head FROM m""")  # fmt: skip
def code_names(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("k"), "p_brand", F.concat(F.lit("src/"), k.cast("string"), F.element_at(F.array(*[F.lit(e) for e in _EXT]), (k % 10 + 1).cast("int"))).alias("path"))
    p = p.withColumn("name", F.when(F.col("k") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("n"), F.col("k").cast("string")))).withColumn("module", code.module_name("path"))
    parent = F.when(F.col("k") % 3 == 0, "Outer").otherwise("")
    deep = F.concat(F.when(F.col("k") % 4 == 0, "node_modules/").otherwise("lib/"), F.col("path"))
    body = F.concat(F.lit("a\n"), "name", F.lit("\nc\nd"))
    return p.select("k", F.coalesce(code.language("path"), F.lit("")).alias("language"), "module", code.qualify("module", parent, "name").alias("qualified"), code.is_identifier("name").alias("is_name"), code.ignored(deep).alias("skipped"), code.first_lines(body, 2).alias("head"))


# --- code index


@query("""WITH s AS (SELECT n_regionkey AS p, n_nationkey AS seq, 'f' || (n_nationkey % 4) AS nm, 'q' || n_nationkey AS q FROM nation), l AS (SELECT p, nm, arg_max(q, seq) AS dst FROM s GROUP BY p, nm)
    SELECT DISTINCT s.q AS src_symbol, l.dst AS dst_symbol, s.p::VARCHAR AS file_path FROM s JOIN l ON s.p = l.p AND l.nm = 'f' || ((s.seq + 1) % 4)""")  # fmt: skip
def call_refs(spark, d):
    n = F.col("n_nationkey")
    f = lambda k: F.concat(F.lit("f"), (k % 4).cast("string"))
    s = table(spark, d, "nation").select(F.lit("ws").alias("workspace"), F.col("n_regionkey").cast("string").alias("path"), n.alias("seq"), f(n).alias("name"), F.concat(F.lit("q"), n.cast("string")).alias("qualified_name"), F.array(f(n + 1), f(n), F.lit("g")).alias("calls"))
    return code_index.call_refs(s).select("src_symbol", "dst_symbol", "file_path")


_KIND = "page_id % 3"


@query(f"""WITH {_FILES}, n AS (SELECT {_KIND} AS k, (len(string_split(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(10))) - 1) // 40 + 1 AS chunks FROM pages)
    SELECT count(*) AS files_seen, count(*) FILTER (k = 2) AS files_skipped_unsupported, 0::BIGINT AS files_skipped_unchanged, count(*) FILTER (k < 2) AS files_indexed, (sum(chunks) FILTER (k < 2))::BIGINT AS symbols_written, 0::BIGINT AS refs_written FROM n""")  # fmt: skip
def index_report(spark, d):
    ext = F.element_at(F.array(F.lit(".html"), F.lit(".css"), F.lit(".xyz")), (F.col("page_id") % 3 + 1).cast("int"))
    files = table(spark, d, "pages").select(F.lit("ws").alias("workspace"), F.concat(F.lit("p"), F.col("page_id").cast("string"), ext).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    _, report = code_index.index_code(MemoryState.empty(spark), files, NOW, lambda c: hash_embed(c, DIM), Config(dim=DIM))
    return report.select("files_seen", "files_skipped_unsupported", "files_skipped_unchanged", "files_indexed", "symbols_written", "refs_written")


# --- statistics and metrics


@query("""SELECT CASE event_type WHEN 'view' THEN '/api/recall' ELSE '/api/' || event_type END AS path, count(*) AS requests, count(*) FILTER (event_id % 5 <> 0) AS errors,
    (SELECT round(avg(value), 4) FROM events WHERE event_type = 'view') AS recall_avg_ms FROM events WHERE event_type <> 'click' GROUP BY event_type""")  # fmt: skip
def request_metrics(spark, d):
    path = F.when(F.col("event_type") == "view", "/api/recall").when(F.col("event_type") == "click", "/static").otherwise(F.concat(F.lit("/api/"), "event_type"))
    ends, mean = stats.request_metrics(table(spark, d, "events").select(path.alias("path"), (F.lit(200) + F.col("event_id") % 5 * 100).alias("status"), F.col("value").alias("ms")))
    return ends.crossJoin(mean.select(F.round("recall_avg_ms", 4).alias("recall_avg_ms")))  # one row


@query(sql("facts", "edges", "tokens", body="""SELECT (SELECT count(*) FROM facts) AS total, (SELECT count(*) FROM facts) AS n_facts, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS code_symbols,
    (SELECT string_agg(workspace, ',' ORDER BY workspace) FROM (SELECT DISTINCT workspace FROM facts)) AS workspaces, (SELECT round(sum(len(t)) / count(*), 6) FROM tokens) AS avg_tokens"""))  # fmt: skip
def store_stats(spark, d):
    s = stats.stats(_facts_state(spark, d).with_(edges=views.edges(spark, d)))
    return s.select(F.col("total_memories").alias("total"), F.element_at("by_type", F.lit("fact")).alias("n_facts"), "edges", "code_symbols", F.array_join("workspaces", ",").alias("workspaces"), F.round("avg_tokens_per_memory", 6).alias("avg_tokens"))


@query("SELECT conv_id AS question_id, string_agg(conv_id || '_' || turn, ',' ORDER BY conv_id || '_' || turn) AS gold FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id")
def gold_turns(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_idx"), (F.col("turn") % 2 == 0).alias("has_answer"))
    return metrics.gold_turns(t).select("question_id", F.array_join("gold", ",").alias("gold"))


_BY_PRICE = "SELECT o_custkey AS c, o_orderkey AS o, o_orderpriority AS p, o_totalprice AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders"


def _by_price(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w))


@query(f"SELECT c || CASE WHEN c % 3 = 0 THEN '_abs' ELSE '' END AS query_id, string_agg(p, '|' ORDER BY r) AS context, c % 3 = 0 AND max(t) < 300000 AS abstain FROM ({_BY_PRICE}) WHERE r <= 10 GROUP BY c")
def answerable(spark, d):
    name = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, "_abs").otherwise(""))
    hits = _by_price(spark, d).select(name.alias("query_id"), "rank", (F.col("o_totalprice") / 1000000).alias("score"), F.col("o_orderpriority").alias("content"))
    return metrics.answerable(hits, 0.3).select("query_id", F.array_join("context", "|").alias("context"), "abstain")


@query(f"SELECT c AS query_id, string_agg(s, ',' ORDER BY f) AS sessions FROM (SELECT c, s, f, row_number() OVER (PARTITION BY c ORDER BY f) AS k FROM (SELECT c, p AS s, min(r) AS f FROM ({_BY_PRICE}) GROUP BY c, p)) WHERE k <= 2 GROUP BY c")
def strip_turns(spark, d):
    turn = F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string"))
    q = _by_price(spark, d).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", turn.alias("t")))), lambda x: x["t"]).alias("recalled"))
    return q.select(F.col("o_custkey").alias("query_id"), F.array_join(metrics.strip_turns("recalled", None, 2), ",").alias("sessions"))


@query("SELECT round(avg(c_custkey % 2), 4) AS hit, round(avg(c_custkey % 5), 4) AS gain FROM customer WHERE c_custkey % 3 <> 0")
def mean_metrics(spark, d):
    c = table(spark, d, "customer")
    name = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "_abs").otherwise(""))
    return metrics.mean_metrics(c.select(name.alias("query_id"), (F.col("c_custkey") % 2).cast("double").alias("hit"), (F.col("c_custkey") % 5).cast("double").alias("gain")))


# --- maintenance and folds


def _episodes(spark, d):
    return views.events(spark, d).select("id", "workspace", "agent", "action", "observation", "outcome", "created_at", "last_access_at", "access_count")


@query(sql("episodes", body="SELECT count(*) AS examined, count(*) FILTER (1706745600.0 - last_access_at >= 1209600 AND 0.3 * pow(0.5, greatest(1706745600.0 - last_access_at, 0) / 604800.0) < 0.06) AS forgotten FROM episodes"))
def decay_report(spark, d):
    state = MemoryState.empty(spark, memories=layers.episodes(_episodes(spark, d), NOW))
    return cycle.decay(state, NOW, 1209600.0, 0.06, workspace=None, dry_run=True)[1].select("examined", "forgotten")


@query(sql("facts", body="SELECT id FROM facts WHERE doc_id % 10 > 3"))
def abstractable(spark, d):
    f = views.facts(spark, d)
    models = spark.range(5).select(F.concat(F.lit("m-"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") == 4, '{"superseded":true}').otherwise("{}").alias("metadata"))
    memories = layers.memory_rows(f, NOW).unionByName(layers.memory_rows(models, NOW, layer=L5, type="mental_model"))
    links = f.where("doc_id % 10 < 5").select(F.concat(F.lit("m-"), (F.col("doc_id") % 10).cast("string")).alias("src_id"), F.lit("abstracts").alias("relation"), F.col("id").alias("dst_id"))
    return cycle.abstractable(MemoryState.empty(spark, memories=memories, edges=dml.link(links, NOW))).select("id")


@query(sql("episodes", body="SELECT workspace, id, r AS place FROM (SELECT workspace, id, row_number() OVER (PARTITION BY workspace ORDER BY created_at, id) AS r FROM episodes WHERE created_at >= 1704412800.0) WHERE r <= 100"))
def ordered_episodes(spark, d):
    return folds.ordered_episodes(views.events(spark, d), since=1704412800.0, cap=100).select("workspace", "id", F.col("place").cast("long").alias("place"))


@query(sql("episodes", body="SELECT workspace, count(*) FILTER (event_id % 3 = 0) AS n_add, count(*) FILTER (event_id % 3 = 1) AS n_update, 0::BIGINT AS n_delete, count(*) FILTER (event_id % 3 = 2) AS n_noop FROM episodes GROUP BY workspace"))
def action_counts(spark, d):
    log = views.events(spark, d).select("workspace", F.element_at(F.array(F.lit("ADD"), F.lit("UPDATE"), F.lit("NOOP")), (F.col("event_id") % 3 + 1).cast("int")).alias("action"))
    return folds.action_counts(log).select("workspace", F.col("ADD").alias("n_add"), F.col("UPDATE").alias("n_update"), F.col("DELETE").alias("n_delete"), F.col("NOOP").alias("n_noop"))


def _axis(k: Column, dim: int) -> Column:
    """The unit vector of an axis: rows of one axis are alike, all others are not."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == k, 1.0).otherwise(0.0)).cast("array<float>")


def _consolidation(spark, d) -> tuple[MemoryState, Config]:
    """Every event as an episode; users that share an axis have the same vector, so what an episode meets is the fact that earlier ones left."""
    e = views.events(spark, d).withColumn("id", F.concat(F.lit("x-"), F.col("event_id").cast("string"))).withColumn("observation", F.lit(""))
    episodes = layers.episodes(e.select("id", "workspace", "agent", "action", "observation", "outcome", "created_at", "last_access_at", "access_count"), NOW)
    axis = F.regexp_extract("content", "user_([0-9]+)", 1).cast("int") % 64
    return MemoryState.empty(spark, memories=graph.written(episodes.withColumn("embedding", _axis(axis, 64)), "memories")), Config(dim=64)


#: All episodes of a workspace in order; a fact of an axis is what the episode before it left.
_CHAIN = """x AS (SELECT *, 'x-' || event_id AS xid, user_id % 64 AS axis, concat_ws(' | ', 'agent=' || agent, 'action=' || action, CASE WHEN outcome <> '' THEN 'outcome=' || outcome END) AS text FROM episodes),
    l AS (SELECT *, lag(text) OVER w AS before FROM x WINDOW w AS (PARTITION BY workspace, axis ORDER BY created_at, xid)),
    a AS (SELECT *, CASE WHEN before IS NULL THEN 'ADD' WHEN before = text THEN 'NOOP' ELSE 'UPDATE' END AS action_ FROM l),
    chain AS (SELECT xid, action_ AS action, CASE WHEN before IS NULL THEN 0 ELSE 1 END::BIGINT AS n_similar,
        CASE WHEN action_ = 'UPDATE' THEN last_value(CASE WHEN action_ <> 'NOOP' THEN xid END IGNORE NULLS) OVER (PARTITION BY workspace, axis ORDER BY created_at, xid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS replaces FROM a)"""


@query(sql("episodes", body="SELECT 1").rsplit("\n", 1)[0] + ",\n" + _CHAIN + "\nSELECT xid AS episode_id, action, n_similar, replaces FROM chain")
def consolidate_decisions(spark, d):
    """Decisions that depend on earlier ones: an UPDATE names the episode whose fact it replaces."""
    state, config = _consolidation(spark, d)
    log = folds.consolidation_log(state, config, cap=None)
    made = log.where("new_id is not null").select(F.col("new_id").alias("target_id"), F.col("episode_id").alias("replaces"))
    return log.join(made, "target_id", "left").select("episode_id", "action", F.col("n_similar").cast("long").alias("n_similar"), "replaces")


@query(sql("episodes", body="SELECT 1").rsplit("\n", 1)[0] + ",\n" + _CHAIN + """\nSELECT 'L1_episodic' AS layer, false AS retired, count(*) AS n FROM episodes
    UNION ALL SELECT 'L2_semantic', true, count(*) FILTER (action = 'UPDATE') FROM chain UNION ALL SELECT 'L2_semantic', false, count(*) FILTER (action = 'ADD') FROM chain""")  # fmt: skip
def consolidate_state(spark, d):
    from ..functions import meta

    state, config = _consolidation(spark, d)
    after, _ = folds.consolidate(state, NOW, lambda c: hash_embed(c, 64), config, cap=None)
    return after.memories.groupBy("layer", meta.retired("metadata").alias("retired")).agg(F.count(F.lit(1)).alias("n"))


_SUCCESS = """o AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY created_at, id) AS place FROM episodes),
    s AS (SELECT *, user_id % 64 AS g, action || CASE WHEN coalesce(observation, '') <> '' THEN ' — ' || observation ELSE '' END AS step FROM o WHERE outcome IN ('success', 'ok', 'done')),
    c AS (SELECT workspace, g, count(*) AS size, arg_min(id, place) AS anchor_id FROM s GROUP BY workspace, g HAVING count(*) >= 3),
    v AS (SELECT workspace, g, action FROM (SELECT workspace, g, action, row_number() OVER (PARTITION BY workspace, g ORDER BY count(*) DESC, min(place)) AS r FROM s GROUP BY workspace, g, action) WHERE r = 1),
    t AS (SELECT workspace, g, count(*) AS n_steps, string_agg(i || '. ' || step, chr(10) ORDER BY i) AS steps FROM (SELECT workspace, g, step, row_number() OVER (PARTITION BY workspace, g ORDER BY min(place)) AS i FROM s GROUP BY workspace, g, step) GROUP BY workspace, g),
    a AS (SELECT workspace, g, string_agg(agent, ',' ORDER BY f) AS agents FROM (SELECT workspace, g, agent, min(place) AS f FROM s GROUP BY workspace, g, agent) GROUP BY workspace, g)"""


@query(
    sql("episodes", body="SELECT 1").rsplit("\n", 1)[0] + ",\n" + _SUCCESS
    + """\nSELECT c.workspace, anchor_id, c.size, v.action AS action_verb, n_steps, agents, md5('How to ' || v.action || ' (' || c.size || ' episodes)' || chr(10) || steps) AS content_md5
    FROM c JOIN v ON c.workspace = v.workspace AND c.g = v.g JOIN t ON c.workspace = t.workspace AND c.g = t.g JOIN a ON c.workspace = a.workspace AND c.g = a.g"""
)
def playbooks_of_clusters(spark, d):
    e = layers.episodes(_episodes(spark, d), NOW)
    e = e.withColumn("embedding", _axis((F.regexp_extract("source", "[0-9]+$", 0).cast("int") % 64), 64))
    got = folds.playbook_candidates(MemoryState.empty(spark, memories=graph.written(e, "memories")))
    return got.select("workspace", "anchor_id", "size", "action_verb", F.size("steps").cast("long").alias("n_steps"), F.array_join("preconditions", ",").alias("agents"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(sql("vectors", body="SELECT workspace, label, min(id) AS anchor_id, count(*) AS size FROM vectors GROUP BY workspace, label HAVING count(*) >= 3"))
def greedy_clusters_of_axes(spark, d):
    from pyspark.sql import Window

    v = views.vectors(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("workspace").orderBy("id")))
    got = folds.greedy_clusters(v.select("workspace", "id", "place", _axis(F.col("label").cast("int"), 64).alias("embedding")), 0.9, 3)
    return got.join(v.select("id", "label"), "id").select("workspace", "label", "anchor_id", "size").distinct()
