"""Queries over the catalog: documents as items (id doc_id, name source, doc text), and over texts of requests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, text
from ..operators.dedupe import exact_dedupe
from ..operators.ranks import first_of, numbered
from ..sources import store
from . import prompts
from .registry import Tables, query


def likes(col: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def cases(col: str, table, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {likes(col, p)} THEN '{n}'" for n, p in table) + f" ELSE {other} END"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("scan_documents", "SELECT lang, source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY lang, source")
def scan_documents(t: Tables):
    return t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("snapshot_roundtrip", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def snapshot_roundtrip(t: Tables):
    root = f"{store.shared_dir(t.spark).rstrip('/')}/snapshots-{__import__('uuid').uuid4().hex}"
    path = store.write_snapshot({"nodes": t("customer").select("c_custkey", "c_name", "c_nationkey")}, root)
    return store.read_snapshot(t.spark, path, "nodes")


CACHE_SQL = "WITH c AS (SELECT DISTINCT sha256('m::' || text) AS key FROM benchmark), d AS (SELECT doc_id, sha256('m::' || text) AS key FROM documents) SELECT doc_id FROM d WHERE key {} (SELECT key FROM c)"


def _keys(t: Tables):
    cache = t("benchmark").select(store.cache_key("m", F.col("text")).alias("key")).distinct()
    return t("documents").select("doc_id", store.cache_key("m", F.col("text")).alias("key")), cache


@query("cache_hits", CACHE_SQL.format("IN"))
def cache_hits(t: Tables):
    docs, cache = _keys(t)
    return docs.join(cache, "key", "left_semi").select("doc_id")


@query("cache_misses", CACHE_SQL.format("NOT IN"))
def cache_misses(t: Tables):
    docs, cache = _keys(t)
    return docs.join(cache, "key", "left_anti").select("doc_id")


@query("cache_shard_histogram", "SELECT substr(sha256('m::' || text), 1, 2) AS shard, count(*) AS n FROM documents GROUP BY 1")
def cache_shard_histogram(t: Tables):
    return t("documents").groupBy(store.shard(store.cache_key("m", F.col("text"))).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_items", "SELECT 'item_' || substr(sha256('item:' || source || ':' || doc_id), 1, 8) AS id, doc_id, source AS name, coalesce(text, '') AS doc, 'compute' AS default_class FROM documents")
def normalize_items(t: Tables):
    ident = F.concat(F.lit("item_"), F.substring(F.sha2(F.concat_ws(":", F.lit("item"), "source", "doc_id"), 256), 1, 8))
    return t("documents").select(ident.alias("id"), "doc_id", F.col("source").alias("name"), F.coalesce("text", F.lit("")).alias("doc"), F.lit("compute").alias("default_class"))


@query("side_effect_class", f"SELECT doc_id, {cases('low', text.SIDE_EFFECTS, chr(39) + 'compute' + chr(39))} AS side_effect FROM (SELECT doc_id, lower(source || ' ' || text) AS low FROM documents)")
def side_effect_class(t: Tables):
    return t("documents").select("doc_id", text.side_effect(F.col("source"), F.col("text")).alias("side_effect"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 12) AS short_hash FROM documents")
def content_hash(t: Tables):
    h = F.sha2(F.col("text"), 256)
    return t("documents").select("doc_id", h.alias("hash"), F.substring(h, 1, 12).alias("short_hash"))


@query("stable_ids", "SELECT doc_id, 'group_' || substr(sha256('group:' || source || ':' || row_number() OVER (PARTITION BY source ORDER BY doc_id)), 1, 8) AS id FROM documents")
def stable_ids(t: Tables):
    rows = numbered(t("documents").select("doc_id", "source"), ["source"], ["doc_id"], "n")
    return rows.select("doc_id", F.concat(F.lit("group_"), F.substring(F.sha2(F.concat_ws(":", F.lit("group"), "source", F.col("n") + 1), 256), 1, 8)).alias("id"))


@query("item_content_hash", """SELECT p_partkey, sha256('{"doc": "' || p_type || '", "examples": [], "name": "' || p_name || '", "signature": "' || p_brand || '"}') AS hash FROM part""")
def item_content_hash(t: Tables):
    body = F.format_string('{"doc": "%s", "examples": [], "name": "%s", "signature": "%s"}', *[F.regexp_replace(c, r'(["\\])', r"\\$1") for c in ("p_type", "p_name", "p_brand")])
    return t("part").select("p_partkey", F.sha2(body, 256).alias("hash"))


KEYWORDS_SQL = f"list_filter(regexp_extract_all(lower({{0}}), '[a-zA-Z][a-zA-Z_0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({listed(text.STOP_WORDS)}))"
FIRST_ORDER = "list_filter(ks, lambda w, i: list_position(ks, w) = i)"


@query("keywords", f"SELECT doc_id, {FIRST_ORDER} AS keywords FROM (SELECT doc_id, {KEYWORDS_SQL.format('text')} AS ks FROM documents)")
def keywords(t: Tables):
    return t("documents").select("doc_id", text.keywords(F.col("text")).alias("keywords"))


@query("token_counts", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n_distinct FROM documents")
def token_counts(t: Tables):
    got = t("documents").select("doc_id", text.tokens(F.col("text")).alias("k"))
    return got.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query("verb_noun", f"""WITH n AS (SELECT event_id, event_type || '_' || user_id AS name, ['get','click'] AS x FROM events),
p AS (SELECT event_id, name, list_filter(regexp_split_to_array(lower(name), '[_\\-\\.\\s]+'), lambda w: w IN ({listed(text.VERBS)})) AS parts,
  list_filter([{listed(text.VERBS)}], lambda v: starts_with(lower(name), v)) AS begun FROM n)
SELECT event_id, coalesce(parts[1], begun[1], 'perform') AS verb FROM p""")
def verb_noun(t: Tables):
    name = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    return t("events").select("event_id", text.verb_of(name).alias("verb"))


@query("fence_strip", "SELECT page_id, trim(url) AS inner FROM pages")
def fence_strip(t: Tables):
    fenced = F.concat(F.lit("```json\n"), F.trim("url"), F.lit("\n```"))
    return t("pages").select("page_id", text.without_fence(fenced).alias("inner"))


@query("summarize_text", "SELECT doc_id, CASE WHEN length(line) > 140 THEN rtrim(substr(line, 1, 139)) || '...' ELSE line END AS summary FROM (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents)")
def summarize_text(t: Tables):
    return t("documents").select("doc_id", text.summary(F.col("text"), 140).alias("summary"))


@query("cluster_member_block", "SELECT source, string_agg('- ' || doc_id, chr(10) ORDER BY doc_id) AS block FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 10 GROUP BY source")
def cluster_member_block(t: Tables):
    members = first_of(t("documents"), ["source"], "doc_id", "doc_id", 10)
    return members.select("source", text.member_block(F.transform("items", lambda x: x.cast("string"))).alias("block"))


@query("parse_subqueries", "SELECT event_id, [event_type, '7', 'true'] AS parts FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, [event_type] FROM events WHERE event_id % 2 = 1")
def parse_subqueries(t: Tables):
    good = F.concat(F.lit('```json\n[" '), "event_type", F.lit(' ", 7, "", true, {"a": 1}, null]\n```'))
    raw = F.when(F.col("event_id") % 2 == 0, good).otherwise('{"not": "a list"}')
    return t("events").select("event_id", text.parse_strings(raw, F.col("event_type")).alias("parts"))


@query("parse_plan_steps", "SELECT event_id, pos, text, expected_tools FROM events, (VALUES (1, 'a', 8), (2, 'b', 1), (3, 'c', 1)) AS v(pos, text, expected_tools)")
def parse_plan_steps(t: Tables):
    steps = text.parse_steps(F.lit('[{"text": " a ", "expected_tools": 99}, {"text": "b", "expected_tools": "x"}, "c", {"no": 1}, []]'), F.lit("q"))
    got = t("events").select("event_id", F.posexplode(steps).alias("pos", "s"))
    return got.select("event_id", (F.col("pos") + 1).alias("pos"), "s.text", "s.expected_tools")


ENRICH_SQL = f"""WITH k AS (SELECT doc_id, {KEYWORDS_SQL.format("source || ' ' || text")} AS ks FROM documents),
n AS (SELECT doc_id, coalesce(list_filter(ks, lambda w: w NOT IN ({listed(text.VERBS)}))[1], 'record') AS noun FROM k)"""


def enrichment(docs):
    """(doc_id, intent, input_kind, output_kind, queries) by templates, as the offline provider gives them."""
    n = docs.select("doc_id", text.verb_of(F.col("source")).alias("v"), text.noun_of(text.keywords(F.concat_ws(" ", "source", "text"))).alias("n"))
    v, noun = F.col("v"), F.col("n")
    queries = F.array(*[F.concat(*p) for p in ((v, F.lit(" the "), noun), (F.lit("please "), v, F.lit(" a "), noun, F.lit(" for me")), (F.lit("how do I "), v, F.lit(" a "), noun), (text.sibling(v), F.lit(" "), noun, F.lit(" in the system")), (F.lit("can you "), v, F.lit(" this "), noun))])
    return n.select("doc_id", F.concat(v, F.lit(" a "), noun).alias("intent"), F.concat(noun, F.lit(" specification")).alias("input_kind"), F.concat(F.lit("resulting "), noun).alias("output_kind"), queries.alias("queries"))


@query("enrich_items", ENRICH_SQL + " SELECT doc_id, 'perform a ' || noun AS intent, noun || ' specification' AS input_kind, 'resulting ' || noun AS output_kind, ['perform the ' || noun, 'please perform a ' || noun || ' for me', 'how do I perform a ' || noun, 'perform ' || noun || ' in the system', 'can you perform this ' || noun] AS queries FROM n")
def enrich_items(t: Tables):
    return enrichment(t("documents"))


@query("parse_enrichment", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'do ' || event_type ELSE '' END AS intent_phrase, CASE WHEN event_id % 3 = 0 THEN 'input' WHEN event_id % 3 = 1 THEN 'row' ELSE '' END AS input_kind, CASE WHEN event_id % 3 = 0 THEN [event_type] WHEN event_id % 3 = 1 THEN ['a', event_type] ELSE []::VARCHAR[] END AS example_queries FROM events")
def parse_enrichment(t: Tables):
    """Replies of a provider: no JSON, a fenced object, and an object without the keys asked for."""
    good = F.concat(F.lit('```json\n{"intent_phrase": "do '), "event_type", F.lit('", "input_kind": "row", "output_kind": "o", "other": [1], "example_queries": ["a", "'), "event_type", F.lit('"]}\n```'))
    raw = F.when(F.col("event_id") % 3 == 0, "sorry").when(F.col("event_id") % 3 == 1, good).otherwise('{"x": 1}')
    return t("events").select("event_id", text.parse_enrichment(raw, F.col("event_type")).alias("e")).select("event_id", "e.intent_phrase", "e.input_kind", "e.example_queries")


@query("leaf_text", ENRICH_SQL + " SELECT doc_id, 'perform a ' || noun || chr(10) || 'input: ' || noun || ' specification' || chr(10) || 'output: resulting ' || noun || chr(10) || 'queries: perform the ' || noun || ' | please perform a ' || noun || ' for me | how do I perform a ' || noun || ' | perform ' || noun || ' in the system | can you perform this ' || noun AS leaf FROM n")
def leaf_text(t: Tables):
    e = enrichment(t("documents"))
    return e.select("doc_id", F.concat_ws("\n", "intent", F.concat(F.lit("input: "), "input_kind"), F.concat(F.lit("output: "), "output_kind"), F.concat(F.lit("queries: "), F.array_join("queries", " | "))).alias("leaf"))


REQUEST = "'You must check it by Friday; then sort ' || event_type || ' by date, and then hash that or fetch the API URL. Without ' || user_id || ' errors you should MUST check it by Friday'"


def requests(t: Tables):
    """Requests made of events: text with markers of sequence, verbs, constraints and pronouns."""
    return t("events").select("event_id", F.concat(F.lit("You must check it by Friday; then sort "), "event_type", F.lit(" by date, and then hash that or fetch the API URL. Without "), F.col("user_id").cast("string"), F.lit(" errors you should MUST check it by Friday")).alias("text"))




@query("extract_constraints", f"SELECT event_id, list_filter(cs, lambda x, i: list_position(list_transform(cs, lambda y: lower(y)), lower(x)) = i) AS constraints FROM (SELECT event_id, {' || '.join(f'list_transform(regexp_extract_all(q, {chr(39)}(?i){p}{chr(39)}), lambda x: trim(x))' for p in text.CONSTRAINTS)} AS cs FROM (SELECT event_id, {REQUEST} AS q FROM events))")
def extract_constraints(t: Tables):
    return requests(t).select("event_id", text.constraints(F.col("text")).alias("constraints"))


@query("ambiguity_flags", f"SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(text, '(?i){text.PRONOUNS}') THEN 'query contains unresolved pronouns' END, CASE WHEN contains(lower(text), ' or ') THEN 'query may contain branching choices' END], lambda x: x IS NOT NULL) AS notes FROM conversations")
def ambiguity_flags(t: Tables):
    return t("conversations").select("conv_id", "turn", text.ambiguities(F.col("text")).alias("notes"))


PARTS_SQL = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '[.?!](\\s+[A-Z]|\\s*$)', ';\\1', 'g'), '\\bthen\\b|\\band then\\b|\\bafter that\\b|\\bfinally\\b|;|\\n'), lambda p: trim(p, ' ,.')), lambda p: p <> '')[1:8]"


@query("split_query", f"SELECT event_id, {PARTS_SQL.format('q')} AS parts FROM (SELECT event_id, {REQUEST} AS q FROM events)")
def split_query(t: Tables):
    return requests(t).select("event_id", text.split_steps(F.col("text")).alias("parts"))


@query("step_kind", f"SELECT conv_id, turn, {cases('low', text.STEP_KINDS, chr(39) + 'reason' + chr(39))} AS kind, {cases('low', text.CAPABILITY_HINTS, 'NULL')} AS hint FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations)")
def step_kind(t: Tables):
    return t("conversations").select("conv_id", "turn", text.first_class(F.col("text"), text.STEP_KINDS, "reason").alias("kind"), text.first_class(F.col("text"), text.CAPABILITY_HINTS, None).alias("hint"))


@query("interpret_goal", "SELECT conv_id, turn, cleaned, rtrim(cleaned, '.') AS objective FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM conversations)")
def interpret_goal(t: Tables):
    got = t("conversations").select("conv_id", "turn", text.one_line(F.col("text")).alias("cleaned"))
    return got.withColumn("objective", F.rtrim(F.col("cleaned"), F.lit(".")))


@query("build_plan", f"""WITH r AS (SELECT event_id, {PARTS_SQL.format('q')} AS parts FROM (SELECT event_id, {REQUEST} AS q FROM events)),
s AS (SELECT event_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM r)
SELECT event_id, 'step_' || i AS step_id, CASE WHEN i > 1 THEN 'step_' || (i - 1) END AS dep, {cases('lower(part)', text.STEP_KINDS, chr(39) + 'reason' + chr(39))} AS kind FROM s
UNION ALL SELECT event_id, 'validate_response', 'step_' || len(parts), 'validate' FROM r""")
def build_plan(t: Tables):
    from ..operators.planner import build_plan as plan

    return plan(requests(t), "event_id", "text").select("event_id", "step_id", "dep", "kind")


RULES_SQL = f"rules AS (SELECT * FROM (VALUES {rules.sql()}) AS v(pos, name, intent, pattern, needs))"


def rule_hits(table: str, key: str, text_sql: str) -> str:
    return f"""{RULES_SQL}, asked AS (SELECT {key}, {text_sql} AS q FROM {table}),
hits AS (SELECT {key}, q, pos, name, intent FROM asked, rules WHERE regexp_matches(q, pattern, 'i') AND len(list_filter(needs, lambda p: NOT regexp_matches(q, p, 'i'))) = 0)"""


@query("rule_matches", f"WITH {rule_hits('events', 'event_id', REQUEST)} SELECT event_id, CAST(pos AS INTEGER) AS pos, name FROM hits")
def rule_matches(t: Tables):
    return requests(t).select("event_id", F.explode(rules.fired(F.col("text"))).alias("r")).select("event_id", "r.pos", "r.name")


@query("multi_intent", f"SELECT event_id, regexp_matches(q, '(?i){text.SEQUENCE}') AND len(list_distinct(list_transform(regexp_extract_all(q, '(?i){text.ACTIONS}'), lambda x: lower(x)))) >= 2 AS many FROM (SELECT event_id, {REQUEST} AS q FROM events)")
def multi_intent(t: Tables):
    return requests(t).select("event_id", text.many_intents(F.col("text")).alias("many"))


@query("inject_subqueries", f"""WITH {rule_hits('events', 'event_id', REQUEST)},
first AS (SELECT event_id, intent, min(pos) AS pos FROM hits WHERE lower(trim(intent)) <> lower(trim(q)) GROUP BY event_id, intent)
SELECT a.event_id, [a.q] || coalesce((SELECT list(f.intent ORDER BY f.pos) FROM first f WHERE f.event_id = a.event_id), []) AS parts FROM asked a""")
def inject_subqueries(t: Tables):
    return requests(t).select("event_id", rules.inject(F.array("text"), F.col("text")).alias("parts"))


@query("exact_dedupe", "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedupe_query(t: Tables):
    return exact_dedupe(t("documents").select("doc_id", "text"), ["text"], "doc_id")


PERTURBED = "SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents WHERE doc_id % 13 = 0"
DIFF_SQL = f"WITH prev AS (SELECT doc_id AS name, sha256(text) AS hash FROM documents), new AS ({PERTURBED}), diff AS (SELECT coalesce(n.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN p.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status FROM prev p FULL JOIN new n ON p.name = n.name)"


def _diff(t: Tables):
    from ..operators.incremental import diff

    docs = t("documents").select(F.col("doc_id").alias("name"), "text")
    h = F.sha2("text", 256)
    new = docs.filter("name % 11 <> 0").select("name", F.when(F.col("name") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(h).alias("hash"))
    new = new.unionByName(docs.filter("name % 13 = 0").select((F.col("name") + 1_000_000_000).alias("name"), h.alias("hash")))
    return diff(docs.select("name", h.alias("hash")), new)


@query("catalog_diff", DIFF_SQL + " SELECT name, status FROM diff")
def catalog_diff(t: Tables):
    return _diff(t)


@query("reenrich_set", DIFF_SQL + " SELECT name FROM diff WHERE status IN ('added', 'changed')")
def reenrich_set(t: Tables):
    return _diff(t).filter(F.col("status").isin("added", "changed")).select("name")


@query("rebuild_decision", DIFF_SQL + ", c AS (SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM diff) SELECT *, (added + changed + removed + unchanged = 0) OR (added + changed + removed) / (added + changed + removed + unchanged) >= 0.3 AS full_rebuild FROM c")
def rebuild_decision(t: Tables):
    from ..operators.incremental import decide

    return decide(_diff(t))


@query("affected_groups", DIFF_SQL + " SELECT DISTINCT d.source FROM documents d JOIN diff f ON d.doc_id = f.name WHERE f.status IN ('changed', 'removed')")
def affected_groups(t: Tables):
    hit = _diff(t).filter(F.col("status").isin("changed", "removed")).select(F.col("name").alias("doc_id"))
    return t("documents").join(hit, "doc_id", "left_semi").select("source").distinct()


@query("cluster_labels", f"""WITH k AS (SELECT source, doc_id, unnest({FIRST_ORDER}) AS w, generate_subscripts({FIRST_ORDER}, 1) AS i FROM (SELECT source, doc_id, {KEYWORDS_SQL.format('text')} AS ks FROM documents)),
f AS (SELECT source, w, min(doc_id * 1000000 + i) AS at FROM k GROUP BY source, w), n AS (SELECT w, count(*) AS holders FROM f GROUP BY w),
r AS (SELECT f.source, f.w, row_number() OVER (PARTITION BY f.source ORDER BY (n.holders > 1)::INT, f.at) AS rank, (n.holders > 1)::INT AS common FROM f JOIN n USING (w)),
m AS (SELECT source, min(common) AS least FROM r GROUP BY source)
SELECT r.source, 'Tools focused on ' || string_agg(w, ', ' ORDER BY rank) AS label FROM r JOIN m USING (source) WHERE rank <= 3 AND common = least GROUP BY r.source""")
def cluster_labels(t: Tables):
    """The first three keywords of each source that no other source has; the first three at all where there are none."""
    k = t("documents").select("source", "doc_id", F.posexplode(text.keywords(F.col("text"))).alias("i", "w"))
    at = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("i")  # a number, so that it is hashed and not sorted
    first = k.groupBy("source", "w").agg(F.min(at).alias("at"))
    holders = first.groupBy("w").agg(F.when(F.count(F.lit(1)) > 1, 1).otherwise(0).alias("common"))
    r = first.join(holders, "w").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("common", F.asc_nulls_last("at")))).filter("rank <= 3")
    least = r.groupBy("source").agg(F.min("common").alias("least"), F.array_sort(F.collect_list(F.struct("rank", "common", "w"))).alias("ws"))
    return least.select("source", F.concat(F.lit("Tools focused on "), F.array_join(F.transform(F.filter("ws", lambda s: s["common"] == F.col("least")), lambda s: s["w"]), ", ")).alias("label"))


@query("open_questions", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS questions FROM events GROUP BY user_id")
def open_questions(t: Tables):
    return t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("questions"))


@query("dedupe_children", "SELECT user_id, child, event_id FROM (SELECT user_id, lower(trim(event_type)) AS child, event_id, row_number() OVER (PARTITION BY user_id, lower(trim(event_type)) ORDER BY event_id) AS n FROM events WHERE lower(trim(event_type)) NOT IN ('', 'click')) WHERE n = 1")
def dedupe_children(t: Tables):
    child = t("events").select("user_id", F.lower(F.trim("event_type")).alias("child"), "event_id").filter(~F.col("child").isin("", "click"))
    return child.groupBy("user_id", "child").agg(F.min("event_id").alias("event_id"))


@query("subquery_source", """WITH a AS (SELECT conv_id, lower(role) AS q, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
l AS (SELECT conv_id, lower(role) AS q, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn < 3)
SELECT a.conv_id, a.turn, CASE WHEN l.n IS NULL THEN 'injected' ELSE 'llm' END AS source FROM a LEFT JOIN l ON a.conv_id = l.conv_id AND a.q = l.q AND a.n = l.n""")
def subquery_source(t: Tables):
    c = t("conversations").withColumn("q", F.lower("role"))
    w = Window.partitionBy("conv_id", "q").orderBy("turn")
    given = c.filter("turn < 3").select("conv_id", "q", F.row_number().over(w).alias("n"), F.lit(True).alias("own"))
    return c.withColumn("n", F.row_number().over(w)).join(given, ["conv_id", "q", "n"], "left").select("conv_id", "turn", F.when(F.col("own"), "llm").otherwise("injected").alias("source"))


@query("decomposition_stats", "SELECT avg(n) AS mean_parts, avg(last + 1) AS mean_circles FROM (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id)")
def decomposition_stats(t: Tables):
    per = t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    return per.agg(F.avg("n").alias("mean_parts"), F.avg(F.col("last") + 1).alias("mean_circles"))


@query("decompose", f"SELECT event_id, i AS sub_idx, part FROM (SELECT event_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT event_id, {PARTS_SQL.format('q')} AS parts FROM (SELECT event_id, {REQUEST} AS q FROM events)))")
def decompose(t: Tables):
    got = requests(t).select("event_id", F.posexplode(text.split_steps(F.col("text"))).alias("i", "part"))
    return got.select("event_id", (F.col("i") + 1).cast("long").alias("sub_idx"), "part")


TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SLOTS_SQL = f"WITH tok AS (SELECT doc_id, unnest({TOKENS}) AS tok FROM documents), slots AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS BIGINT) AS slot, count(*) AS n FROM tok GROUP BY 1, 2)"


def hash_slots(docs, dim: int = 64):
    """(doc_id, slot, n): tokens counted by the first four bytes of their MD5, modulo dim; partial sums by task."""
    tok = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("tok"))
    return tok.groupBy("doc_id", (F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("long") % dim).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("hash_embed_slots", SLOTS_SQL + " SELECT doc_id, slot, n FROM slots")
def hash_embed_slots(t: Tables):
    return hash_slots(t("documents"))


@query("hash_embed", SLOTS_SQL + ", norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM slots GROUP BY doc_id) SELECT s.doc_id, slot, round(n / norm, 6) AS x FROM slots s JOIN norms USING (doc_id)")
def hash_embed(t: Tables):
    s = hash_slots(t("documents"))
    return s.select("doc_id", "slot", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id"))), 6).alias("x"))


@query("tool_vectors", "SELECT doc_id, i - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def tool_vectors(t: Tables):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query("batches", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def batches(t: Tables):
    rows = numbered(t("documents").select("doc_id", "source"), ["source"], ["doc_id"], "n")
    return rows.select("doc_id", F.floor(F.col("n") / 32).cast("long").alias("batch"))


@query("prompt_block", "SELECT conv_id, turn, concat(chr(10), coalesce(text, ''), chr(10)) AS members FROM conversations")
def prompt_block(t: Tables):
    """What a labelling prompt says of its members, found again in the prompt."""
    asked = t("conversations").select("conv_id", "turn", prompts.describe(F.col("text"), F.lit("(none)")).alias("p"))
    return asked.select("conv_id", "turn", prompts.block(F.col("p"), "MEMBERS:").alias("members"))
