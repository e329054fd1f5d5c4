"""Queries over strings, arrays and JSON that the driver's tables don't hold as such: inputs are derived from whole tables by one SQL
text that both engines run; what is tested differs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import html as hx
from folioforge.functions import text as tx
from folioforge.operators import cdc, cluster, crawl, library as lib, provenance, revisions, sites, telemetry
from folioforge.queries.tables import derived, duck, table
from folioforge.queries.web import _clean

W = tx.WS

PATHS = """SELECT doc_id AS id, concat(CASE doc_id % 6 WHEN 0 THEN 'x/.git/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'A/b c/' ELSE 'd/' END,
  CASE doc_id % 7 WHEN 0 THEN '~$' WHEN 1 THEN '.' ELSE '' END, source, '-', doc_id, CASE doc_id % 11 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' WHEN 3 THEN '.tmp'
  WHEN 4 THEN '' WHEN 5 THEN '.JPeG' WHEN 6 THEN '.xlsx' WHEN 7 THEN '.md' WHEN 8 THEN '.wps' WHEN 9 THEN '.zip' ELSE '.doc' END) AS path FROM {documents}"""
NAMES = "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '   ' WHEN 1 THEN concat('a:', source, '?.txt') WHEN 2 THEN concat('A_', source, '_.TXT') ELSE concat(source, '.', lang) END AS name FROM {documents}"
HEADS = "SELECT doc_id AS id, concat(CASE doc_id % 4 WHEN 0 THEN '504B0304' WHEN 1 THEN 'D0CF11E0' WHEN 2 THEN '25504446' ELSE '' END, upper(md5(text))) AS head FROM {documents}"
URLS = "SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN concat('  ', upper(url), ' ') WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN 'https://' WHEN 3 THEN '' ELSE url END AS url FROM {pages}"
TWICE = "SELECT page_id * 2 AS id, url FROM {pages} UNION ALL SELECT page_id * 2 + 1 AS id, concat(' ', url, '//') AS url FROM {pages}"
TOPICS = """SELECT id, w1, w2, CASE id % 3 WHEN 0 THEN concat('请撰写，标题为“', w1, '”，包括“', w2, '”') WHEN 1 THEN concat('标题为“', w1, '“，要求详实') ELSE concat('  写一段 ', w1, ' 发展 ') END AS q
  FROM (SELECT doc_id AS id, concat(CASE WHEN doc_id % 2 = 0 THEN '教育' ELSE '道路' END, substring(md5(text), 1, 4)) AS w1, substring(md5(text), 5, 5) AS w2 FROM {documents}) t"""
MARKED = "SELECT doc_id AS id, concat('【矛盾#', doc_id % 4, '】', text, '【矛盾#', doc_id % 15, '】【矛盾#99999999999999999999】') AS t FROM {documents}"
TAGGED = "SELECT doc_id AS id, concat(CASE doc_id % 3 WHEN 0 THEN concat('[tag:', source, '] [tag:x] ') WHEN 1 THEN '' ELSE '[tag:c]' END, text) AS t FROM {documents}"
MARKDOWN = "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), concat(chr(10), '## ')) WHEN 1 THEN concat('### ', lang, chr(10), replace(text, chr(10), repeat(chr(10), 4))) ELSE text END AS t FROM {documents}"
REFS = "SELECT o_orderkey AS id, concat('see #', o_custkey % 12, ' and #', o_orderkey % 9, ', #1 of ', o_orderpriority, ' #', o_orderkey % 3, ' not #99999999999999999999') AS t FROM {orders}"
REPLIES = """SELECT event_id AS id, props, CASE event_id % 6 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('so ', props, ' it is') WHEN 2 THEN 'no json'
  WHEN 3 THEN concat('list: [', event_id, ', 2] end') WHEN 4 THEN props ELSE concat('{', props) END AS t FROM {events}"""
OUTPUTS = """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN concat('{"title": "T', event_id, '", "content": "', event_type, '", "error": null}')
  WHEN 1 THEN concat('{"title": null, "content": null, "error": "missing ', user_id, '"}') WHEN 2 THEN event_type WHEN 3 THEN concat('```json', chr(10), '{"title": " T', event_id, ' ", "content": "', event_type, ' ", "error": "  "}', chr(10), '```')
  WHEN 4 THEN '{"title": 12, "content": "x"}' WHEN 5 THEN concat('so {"title": "T', event_id, '", "error": {"a": 1}, "content": "', event_type, '"} end') ELSE '[{"title": "T", "content": "c"}]' END AS t, event_type, user_id FROM {events}"""
STREAM = """SELECT conv_id AS id, turn * 2 AS n, concat('data: {"choices":[{"delta":{"content":"', substring(md5(text), 1, 6), '"}}]}') AS line FROM {conversations}
  UNION ALL SELECT conv_id AS id, turn * 2 + 1 AS n, CASE turn % 2 WHEN 0 THEN ': ping' ELSE 'data: [DONE]' END AS line FROM {conversations}"""
CALLS = """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 500 WHEN 4 THEN 404 WHEN 5 THEN 200 END AS s,
  CASE WHEN event_id % 3 = 0 THEN concat('{"error": {"message": "', repeat(event_type, 40), '"}}') ELSE concat('{"choices": [{"message": {"content": "', event_type, '"}}]}') END AS body FROM {events}"""
SECRETS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('{"apiKey": "', event_type, '", "n": ', event_id, '}') WHEN 1 THEN concat('{"x": {"auth_token":', user_id, ', "y": 2}, "Password" : "a b"}')
  WHEN 2 THEN concat('{"note": "key", "n": ', event_id, '}') ELSE concat('{"props": ', props, ', "list": [{"secretKey": {"a": [1, 2]}}, [[["deep"]]]], "n": ', event_id, '}') END AS j FROM {events}"""
ATTEMPTS = "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE concat(l_returnflag, l_suppkey) END AS r FROM {lineitem}"
SETTINGS = "SELECT event_id AS n, concat(event_type, user_id % 5) AS key, CASE WHEN event_id % 7 = 0 THEN 'bad!' WHEN value >= 100 THEN cast(event_id AS varchar(20)) END AS value FROM {events}"
SKILLS = "SELECT concat(n_name, ' rule') AS name, n_regionkey AS category, [concat(substring(md5(n_name), 1, 2), '7'), concat(n_regionkey, n_nationkey)] AS tags FROM {nation}"


DISPUTED = "SELECT o_orderkey AS contradiction_id, o_custkey AS draft_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM {orders}"
SAYINGS = "SELECT l_orderkey AS contradiction_id, l_orderkey * 10 + l_linenumber AS variant_id, min(l_shipdate) AS position FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
PLACES = """SELECT o_custkey AS draft_id, n * 1000000 + o_orderkey AS nth, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY o_custkey, n ORDER BY o_orderkey) + o_orderkey % 2 END AS seq,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(o_orderpriority, n) END AS quote, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS merged, o_orderkey % 5 AS v1, concat('a', o_orderkey, n) AS t1, n AS v2, concat('b', o_orderkey, n) AS t2
  FROM {orders}, (SELECT 1 AS n UNION ALL SELECT 2 AS n) k"""


def by_id(df, **columns):
    return df.select(F.col("id").cast("bigint").alias("id"), *[c.alias(k) for k, c in columns.items()])


def joined(a, sep=","):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def ext_dispatch(spark, d):
    return by_id(derived(spark, d, PATHS), parser=F.coalesce(cdc.parser_of(F.col("path")), F.lit("PARSE_UNSUPPORTED")))


def ignored_paths(spark, d):
    return by_id(derived(spark, d, PATHS), ignored=cdc.ignored(F.col("path")))


def safe_rename(spark, d):
    return by_id(cdc.safe_names(derived(spark, d, NAMES), "name", "id"), safe_name=F.col("safe_name"))


def magic_dispatch(spark, d):
    return by_id(derived(spark, d, HEADS), kind=cdc.container_of(F.unhex("head")))


def url_validate(spark, d):
    return by_id(derived(spark, d, URLS), valid=hx.valid_url(F.col("url")))


def idempotent_create(spark, d):
    return by_id(lib.create_once(derived(spark, d, TWICE), lib.normalised_url(F.col("url")), "id"), name_key=F.col("name_key"))


def topic_terms(spark, d):
    return by_id(derived(spark, d, TOPICS), terms=F.array_join(tx.topic_terms(F.col("q")), "|"))


def term_expand(spark, d):
    t = derived(spark, d, TOPICS).withColumn("terms", tx.topic_terms(F.col("q")))
    return by_id(t, terms=F.array_join(F.array_union("terms", tx.expand_terms(F.col("terms"))), "|"))


def match_any(spark, d):
    return by_id(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), hit=tx.matches_any(F.col("text"), F.array(F.lit("xq zk"), F.lit("ñáb"))))


def article_prefilter(spark, d):
    """First lines stand for titles; terms come from an instruction."""
    terms = tx.topic_terms(F.lit("请撰写，标题为“xqz”，包括“ñáb”"))
    terms = F.array_union(terms, tx.expand_terms(terms))
    return table(spark, d, "documents").where(tx.matches_any(F.regexp_extract("text", "^[^\n]*", 0), terms)).select("doc_id")


def md_segments(spark, d):
    return by_id(tx.markdown_segments(derived(spark, d, MARKDOWN), "id", "t"), ordering=F.col("ordering"), heading=F.col("heading"), hash=F.sha2("content", 256))


def apply_edit(spark, d):
    t = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    edit = lambda a, r: F.struct(a.alias("anchor"), F.lit(r).alias("replacement"))
    other = F.when(F.col("id") % 3 == 0, "no such anchor").otherwise(F.substring("text", 1, 3))
    return by_id(t, hash=F.sha2(tx.apply_edits(F.col("text"), F.array(edit(F.substring("text", 5, 6), "X"), edit(other, "YY"))), 256))


def marker_extract(spark, d):
    return by_id(derived(spark, d, MARKED), seqs=joined(tx.marker_numbers(F.col("t"))))


def marker_remove(spark, d):
    return by_id(derived(spark, d, MARKED), hash=F.sha2(F.replace("t", tx.marker(F.lit(1)), F.lit("")), 256))


def strip_tag_prefix(spark, d):
    """All titles as a migration leaves them: those with tags in front lose them, the others stay."""
    return by_id(derived(spark, d, TAGGED), hash=F.sha2(tx.without_tags(F.col("t")), 256))


def tag_split(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.tag_list(F.concat_ws("，", "p_name", "p_brand", "p_type")), "|").alias("tags"))


def resolve_refs(spark, d):
    valid = F.array(*[F.lit(i).cast("bigint") for i in range(1, 6)])
    return by_id(derived(spark, d, REFS), refs=joined(provenance.ref_tokens(F.col("t"), valid)), tokens=F.array_join(F.transform(provenance.split_refs(F.col("t"), valid), lambda x: F.concat(F.when(x["ref"].isNull(), "t:").otherwise("r:"), x["text"])), "|"))


def json_repair(spark, d):
    return by_id(derived(spark, d, REPLIES), json=telemetry.json_candidate(F.col("t")))


def parse_outputs(spark, d):
    read = derived(spark, d, OUTPUTS).select("id", telemetry.draft_output(F.col("t")).alias("x"))
    return by_id(read, kind=F.when(F.col("x.error").isNotNull(), "error").when(F.col("x.title").isNotNull(), "draft").otherwise("null"), title=F.col("x.title"), content=F.coalesce("x.content", "x.error"))


def sse_extract(spark, d):
    return by_id(telemetry.delta_text(derived(spark, d, STREAM), "id", "n", "line"), content=F.col("content"))


def error_classify(spark, d):
    return by_id(derived(spark, d, CALLS), code=telemetry.error_code(F.col("s")), retry=telemetry.retryable(F.col("s")), message=telemetry.error_message(F.col("body")), reply=telemetry.reply_text(F.col("body")))


def mask_secrets(spark, d):
    return by_id(derived(spark, d, SECRETS), j=tx.masked(F.col("j")))


def first_nonempty(spark, d):
    rows = derived(spark, d, ATTEMPTS).withColumn("at", F.struct("n", "part", "r"))
    return by_id(telemetry.first_non_empty(rows, "id", "at", "r"), r=F.col("r"))


def settings_map(spark, d):
    return lib.apply_settings(derived(spark, d, SETTINGS.replace("varchar(20)", "string")), "key", "value", "n", F.col("value").rlike("^[0-9]+$"))


def _skills(spark, d):
    return derived(spark, d, SKILLS.replace("[concat", "array(concat").replace("] AS tags", ") AS tags"))


def skill_match(spark, d):
    titles = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.substring(F.md5("text"), 1, 8), F.substring(F.md5("text"), 9, 24)).alias("title"))
    return lib.match_skills(titles, _skills(spark, d), "title", "name", "tags").select("doc_id", "name")


def skill_counts(spark, d):
    return _skills(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def array_fk_titles(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("id")).alias("x"))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias("ids"))
    titles = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sid"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("title"))
    return lib.array_titles(rows, titles, "l_orderkey", "ids", "sid", "title").select("l_orderkey", F.array_join("titles", "|").alias("titles"))


def valid_ids(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("x"))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l_suppkey"]).alias("ids"))
    valid = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("sid"))
    return lib.valid_ids(rows, valid, "l_orderkey", "ids", "sid").select("l_orderkey", joined(F.col("ids")).alias("valid"))


def scope_resolve(spark, d):
    c = table(spark, d, "customer")
    bridge, sources = c.select(F.col("c_nationkey").alias("tag_id"), F.col("c_custkey").alias("source_id")), c.select(F.col("c_custkey").alias("source_id"))
    found = [lib.resolve_scope(sources, bridge, s).select(F.lit(n).alias("scope"), "source_id") for n, s in (("all", {"all": True}), ("ids", {"sourceIds": [5, 3, 5]}), ("tags", {"tagIds": [1, 2, 99]}))]
    return found[0].union(found[1]).union(found[2])


def lookup_url_scope(spark, d):
    """Pages of a task's cache and of the library under one URL."""
    pages = table(spark, d, "pages")
    both = pages.select("page_id", "url", F.when(F.col("page_id") % 2 == 1, F.lit("task")).alias("task_id")).union(pages.select("page_id", "url", F.lit("task")))
    url = pages.agg(F.min("url")).first()[0]
    return lib.lookup_url_scope(both, url, None).unionByName(lib.lookup_url_scope(both, url, "task")).select("page_id", "url", F.coalesce("task_id", F.lit("library")).alias("scope"))


def seed_skills(spark, d):
    """Presets replace a table of presets, and leave one that holds a row of a user's own."""
    skills = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") < 0).alias("own"))
    presets = table(spark, d, "region").select(F.col("r_name").alias("n_name"), F.lit(True).alias("preset"))
    kept = lib.seed_if_untouched(skills.select("n_name", F.col("own").alias("preset")), presets, "preset")
    wiped = lib.seed_if_untouched(skills.select("n_name", (~F.col("own")).alias("preset")), presets, "preset")
    return kept.select(F.lit("kept").alias("which"), "n_name").union(wiped.select(F.lit("wiped"), "n_name"))


def append_rows(spark, d):
    base = table(spark, d, "labels").withColumn("created_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    new = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"))
    found = lib.append(base, new, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    return found.groupBy(F.year("created_at").cast("bigint").alias("year"), "quality", "toxic").agg(F.count("*").alias("n"))


def legacy_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "url").otherwise("file").alias("kind"), F.when(F.col("doc_id") % 4 < 2, F.col("doc_id") % 4 == 0).alias("workspace"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("file_path"))
    return lib.legacy_files(docs).select("doc_id", "file_path")


def _groups(spark, d):
    text = F.when(F.col("l_suppkey") % 5 == 0, "  ").otherwise(F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).cast("string")))
    refs = F.array(F.concat(F.lit("#"), F.col("l_suppkey").cast("string")), F.concat(F.lit("#"), (F.col("l_suppkey") + 3).cast("string")))
    v = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(text.alias("text"), refs.alias("sourceRefs")).alias("v"))
    variants = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(v)), lambda x: x["v"]).alias("variants"))
    kind = F.element_at(F.array(F.lit("data"), F.lit("time"), F.lit("odd"), F.lit("place")), (F.col("id") % 4 + 1).cast("int"))
    topic = F.when(F.col("id") % 10 == 0, " ").otherwise(F.col("o_orderpriority"))
    return variants.join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), "id").select("id", F.col("o_custkey").alias("draft"), topic.alias("topic"), kind.alias("kind"), "variants")


def scan_validate(spark, d):
    return cluster.valid_groups(_groups(spark, d)).select("id", "topic", F.size("variants").cast("bigint").alias("n"))


def contradiction_groups(spark, d):
    refs = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("#"), F.col("s_suppkey").cast("string")).alias("ref"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"))
    g = cluster.contradiction_groups(cluster.valid_groups(_groups(spark, d)), refs, "id", "draft")
    return g.select("draft", "seq", "topic", "kind", "variant", "text", F.array_join("sources", ",").alias("sources"))


def merge_groups(spark, d):
    g = cluster.merge_groups(cluster.valid_groups(_groups(spark, d)), "draft", "id")
    return g.select("draft", "nr", "topic", F.size("variants").cast("bigint").alias("n_texts"), F.expr("aggregate(variants, 0L, (a, v) -> a + size(v.sourceRefs))").alias("n_refs"))


def locate_validate(spark, d):
    x = F.struct(F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 3).alias("variantIndex"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("text"))
    j = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list(x)).alias("j"))
    items = F.from_json(F.when(F.col("id") % 7 == 0, F.concat(F.lit("broken "), "j")).otherwise(F.col("j")), "array<struct<seq:bigint,variantIndex:bigint,text:string>>")
    good = F.filter(items, lambda x: x["seq"].isNotNull() & (x["variantIndex"] >= 1) & (x["text"] != ""))
    return by_id(j, n=F.greatest(F.lit(0), F.coalesce(F.size(good), F.lit(0))).cast("bigint"))


SITE = """SELECT concat('http://s', doc_id % 11, '.org/p', doc_id) AS url, concat('<a href="http://a b/x">z</a><a href="/p', doc_id + 11, '">n</a> <a href="p', doc_id + 33, '"><b>m</b></a> <a href="http://s', doc_id % 11, '.org/p', doc_id + 22,
  '">o</a><a href="#x">x</a> <a href="/gone', doc_id, '">g</a> <a href="http://other.org/b.html">b</a> <a href="javascript:x()">j</a> <a href="/a', doc_id + 11, '.html">A', doc_id, '</a>',
  '<a href="https://s', doc_id % 11, '.org/a', doc_id, '.html?y=1"></a><a href="/a', doc_id + 22, '.html">B', doc_id, '</a>') AS html FROM {documents}"""


def _site(spark, d):
    pages = derived(spark, d, SITE)
    return crawl.discover(pages, table(spark, d, "documents").groupBy((F.col("doc_id") % 11).alias("h")).agg(F.min("doc_id").alias("i")).select(F.concat(F.lit("http://s"), F.col("h").cast("string"), F.lit(".org/p"), F.col("i").cast("string")).alias("url")), 2, 6)


def crawl_bfs(spark, d):
    return _site(spark, d)[0]


def crawl_articles(spark, d):
    return _site(spark, d)[1]


#: Lists of articles from an earlier sync, with titles of then; pages of articles, of which some can't be fetched; what a task has.
LISTED = "SELECT doc_id % 11 AS site_id, concat('http://s', doc_id % 11, '.org/a', doc_id, '.html') AS url, concat('on ', doc_id) AS title, doc_id AS discovered_at FROM {documents} WHERE doc_id % 2 = 0"
BODIES = "SELECT concat('http://s', doc_id % 11, '.org/a', doc_id, '.html') AS url, concat('<p>', CASE doc_id % 3 WHEN 0 THEN 'sta<b>tion</b> ' ELSE 'x' END, md5(text), '</p>') AS html FROM {documents} WHERE doc_id % 4 <> 1"
HAD = "SELECT concat('http://s', doc_id % 11, '.org/a', doc_id, '.html') AS url, CASE WHEN doc_id % 5 = 0 THEN 't1' END AS task_id FROM {documents} WHERE doc_id % 10 IN (0, 2, 5)"
ASKED = "标题为“A1”，包括“tion”"


def _sites(spark, d):
    first = table(spark, d, "documents").groupBy((F.col("doc_id") % 11).alias("site_id")).agg(F.min("doc_id").alias("i"))
    root = F.concat(F.lit("http://s"), F.col("site_id").cast("string"), F.lit(".org/p"), F.col("i").cast("string"))
    return first.select("site_id", root.alias("root_url"), F.lit(0).cast("timestamp").alias("created_at"))


def _synced(spark, d):
    return sites.sync(_sites(spark, d), derived(spark, d, LISTED), derived(spark, d, SITE), F.lit(-1).cast("bigint"), 2, 6)


def site_sync(spark, d):
    """The lists of all sites after a crawl, and how many articles it added to each."""
    changed, state = _synced(spark, d)
    after = lib.upsert(derived(spark, d, LISTED).select(*changed.columns), changed, ["site_id", "url"])
    return after.join(state, "site_id").select("site_id", "url", "title", "discovered_at", "added")


def site_related(spark, d):
    """Articles of the lists after a crawl that an instruction asks for, with the rows that a task gets."""
    listed = lib.upsert(derived(spark, d, LISTED), _synced(spark, d)[0], ["site_id", "url"])
    found, added = sites.related(_sites(spark, d), listed.withColumn("discovered_at", F.col("discovered_at").cast("timestamp")), derived(spark, d, HAD), derived(spark, d, BODIES), ASKED, "t1", F.current_timestamp())
    return found.join(added, "url", "left").select("site_id", "url", "title", F.sha2("text", 256).alias("hash"))


def places_kept(spark, d):
    """Replies about places in drafts (a customer's orders as contradictions, their lines as variants) as changes of both tables."""
    items = derived(spark, d, PLACES).withColumn("replacements", F.array(F.struct(F.col("v1").alias("variant"), F.col("t1").alias("text")), F.struct(F.col("v2").alias("variant"), F.col("t2").alias("text"))))
    quotes, replaced = revisions.place(derived(spark, d, DISPUTED), derived(spark, d, SAYINGS), items, ["position"])
    rows = derived(spark, d, SAYINGS).join(quotes, "contradiction_id", "left").join(replaced, "variant_id", "left")
    return rows.select("variant_id", "quote", "merged", "in_draft", "replacement")


def web_recall(spark, d):
    """Two-level recall for an instruction's terms, saved to a task that has some pages already."""
    pages = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    found = crawl.recall(pages, "标题为“enthe”，包括“chder”", "title", "html")
    stored = pages.where("page_id % 5 = 0").select("url", F.when(F.col("page_id") % 2 == 0, "t1").alias("task_id"))
    return crawl.save_to_task(found, stored, "t1")


def embed_chunks(spark, d):
    """A stub model in place of a real one: it fails where a batch holds a long text, and its fallback where it holds a very long one."""
    def model(texts):
        if max(map(len, texts)) > 400:
            raise ValueError("too long")
        return [[len(t), t.count("a")] for t in texts]

    def fallback(texts):
        if max(map(len, texts)) > 3000:
            raise ValueError("too long")
        return [[-len(t), 0] for t in texts]

    rows = table(spark, d, "documents").select("doc_id", "text")
    found = telemetry.embed(rows, "text", model, fallback, batch=1)
    return found.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("first"))


def float_bytes(spark, d):
    """Vectors stored as little-endian 32-bit floats; the bytes are written here as the hex of each component."""
    from folioforge.operators import retrieval

    e = table(spark, d, "embeddings").select("vec_id", "embedding", retrieval.float_bytes(F.col("embedding")).alias("blob"))
    back = retrieval.float_vector(F.col("blob"))
    return e.select("vec_id", F.octet_length("blob").cast("bigint").alias("n_bytes"), (back == F.col("embedding")).alias("same"))


def summarise_pending(spark, d):
    """Documents without a label, summarised by a stub client."""
    pending = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", F.coalesce("source", F.lit("")).alias("t"))
    reply = lambda p, t: '```json\n{"summary": "about %s", "keywords": ["%s", ""], "entities": []}\n```' % (p, p) if t > 0 else "no json"
    return telemetry.summarise(pending, "doc_id", "t", lambda p, t: reply(p, 1.0)).select("doc_id", "summary", F.array_join("keywords", ",").alias("keywords"), F.size("entities").cast("bigint").alias("n_entities"))


def model_calls(spark, d):
    """A stub client in place of a model: the second attempt answers."""
    found = telemetry.call_model(table(spark, d, "benchmark"), "item_id", "text", lambda p, t: p[::-1] if t > 0 else "")
    return found.select("item_id", F.sha2("reply", 256).alias("hash"), F.col("attempts").cast("bigint").alias("attempts"), "error", "input_chars", "status")


def prompt_render(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("place"), "text")
    m = telemetry.render_materials(c, "conv_id", ["turn"], "conv_id", "role", "place", "text")
    return m.select("conv_id", F.sha2(telemetry.render_prompt(F.concat(F.lit("标题为"), F.col("conv_id").cast("string")), F.lit(""), F.col("materials")), 256).alias("hash"))


QUERIES = {f.__name__: f for f in (ext_dispatch, ignored_paths, safe_rename, magic_dispatch, url_validate, idempotent_create, topic_terms, term_expand, match_any, article_prefilter, md_segments, apply_edit, marker_extract, marker_remove, strip_tag_prefix, tag_split, resolve_refs, json_repair, parse_outputs, sse_extract, error_classify, mask_secrets, first_nonempty, settings_map, skill_match, skill_counts, array_fk_titles, valid_ids, scope_resolve, lookup_url_scope, seed_skills, append_rows, legacy_files, scan_validate, contradiction_groups, merge_groups, locate_validate, places_kept, crawl_bfs, crawl_articles, site_sync, site_related, web_recall, embed_chunks, float_bytes, summarise_pending, model_calls, prompt_render)}


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '{W}+', '', 'g')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _edit(t: str, a: str, r: str) -> str:
    return f"CASE WHEN {a} <> '' AND instr({t}, {a}) > 0 THEN substring({t}, 1, (instr({t}, {a}) - 1)::BIGINT) || '{r}' || substring({t}, (instr({t}, {a}) + length({a}))::BIGINT) END"


_TERMS = f"SELECT id, w1, CASE id % 3 WHEN 0 THEN w1 || '|' || w2 WHEN 1 THEN w1 ELSE '写一段' || w1 || '发展' END AS terms FROM ({duck(TOPICS)})"
_first = "regexp_extract(text, '^[^\\n]*', 0)"
_v = """v AS (SELECT l_orderkey AS id, o_custkey AS draft, o_orderpriority AS topic, CASE l_orderkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'time' WHEN 2 THEN 'other' ELSE 'place' END AS kind,
  l_returnflag || l_linestatus || (l_partkey % 3) AS text, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 5 <> 0 AND l_orderkey % 10 <> 0),
g AS (SELECT * FROM v WHERE id IN (SELECT id FROM v GROUP BY id HAVING count(*) >= 2))"""
_site_sql = f"""WITH p AS (SELECT doc_id AS i, doc_id % 11 AS h FROM documents), l(step, place) AS (VALUES (11, 1), (33, 2), (22, 3)),
r AS (SELECT h, min(i) AS r FROM p GROUP BY h),
d0 AS (SELECT h, r AS i, 0 AS depth, 1 AS visited FROM r),
q1 AS (SELECT d.h, d.i + step AS i, min(d.visited * 100 + place) AS o FROM d0 d, l GROUP BY ALL),
d1 AS (SELECT h, i, 1 AS depth, 1 + row_number() OVER (PARTITION BY h ORDER BY o) AS visited FROM q1 SEMI JOIN p USING (h, i) ANTI JOIN d0 USING (h, i) QUALIFY 1 + row_number() OVER (PARTITION BY h ORDER BY o) <= 6),
q2 AS (SELECT d.h, d.i + step AS i, min(d.visited * 100 + place) AS o FROM d1 d, l GROUP BY ALL),
d2 AS (SELECT h, i, 2 AS depth, n + row_number() OVER (PARTITION BY h ORDER BY o) AS visited FROM q2 SEMI JOIN p USING (h, i) ANTI JOIN (SELECT h, i FROM d0 UNION ALL SELECT h, i FROM d1) USING (h, i) JOIN (SELECT h, 1 + count(*) AS n FROM d1 GROUP BY h) USING (h) QUALIFY n + row_number() OVER (PARTITION BY h ORDER BY o) <= 6),
s AS (SELECT 'http://s' || s.h || '.org/p' || r AS root, s.h, i, depth::BIGINT AS depth, visited::BIGINT AS visited FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) s JOIN r USING (h))"""
_title = _bare("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_body = _bare(f"left(regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || chr(10) || {_clean('html')}, 12000)")
_found = f"len(list_filter(['enthe', 'chder', 'en', 'nt', 'th', 'he', 'ch', 'hd', 'de', 'er'], lambda g: contains({_title}, g))) > 0 AND (contains({_body}, 'enthe') OR contains({_body}, 'chder'))"

#: Articles that the crawl finds (f), the lists before it (o) and after (a).
_listed_sql = f"""fa AS (SELECT h, i + 11 AS n, '' AS tail, 'http' AS scheme, 'A' || i AS title, visited * 100 + 6 AS o FROM s UNION ALL SELECT h, i, '?y=1', 'https', NULL, visited * 100 + 7 FROM s UNION ALL SELECT h, i + 22, '', 'http', 'B' || i, visited * 100 + 8 FROM s),
fk AS (SELECT h, scheme || '://s' || h || '.org/a' || n || '.html' || tail AS url, title, o FROM fa), f AS MATERIALIZED (SELECT h, url, coalesce(title, url) AS title FROM fk QUALIFY row_number() OVER (PARTITION BY url ORDER BY o) = 1),
o AS MATERIALIZED ({LISTED}), a AS MATERIALIZED (SELECT coalesce(site_id, h) AS site_id, url, coalesce(f.title, o.title) AS title, coalesce(discovered_at, -1) AS discovered_at FROM o FULL JOIN f USING (url))"""

ORACLES = {name: duck(sql) for name, sql in {
    "ext_dispatch": f"WITH e AS (SELECT id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS e FROM ({PATHS})) SELECT id, CASE WHEN e IN ('txt', 'md') THEN 'text' WHEN e IN ('png', 'jpg', 'jpeg', 'bmp') THEN 'image' WHEN e IN ('xls', 'xlsx') THEN 'sheet' WHEN e IN ('pdf', 'docx', 'doc', 'wps') THEN e ELSE 'PARSE_UNSUPPORTED' END AS parser FROM e",
    "ignored_paths": f"SELECT id, contains(path, '/.git/') OR starts_with(path, 'node_modules/') OR contains(path, '/~$') OR contains(path, '/.') OR path LIKE '%.tmp' AS ignored FROM ({PATHS})",
    "safe_rename": f"WITH s AS (SELECT id, coalesce(nullif(trim(regexp_replace(name, '[<>:\"/|?*]', '_', 'g')), ''), '未命名') AS s FROM ({NAMES})), n AS (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY id) AS n FROM s) SELECT id, CASE WHEN n = 1 THEN s ELSE regexp_extract(s, '^(.*?)(\\.[^.]*)?$', 1) || ' (' || (n - 1) || ')' || regexp_extract(s, '^(.*?)(\\.[^.]*)?$', 2) END AS safe_name FROM n",
    "magic_dispatch": f"SELECT id, CASE left(head, 8) WHEN '504B0304' THEN 'docx' WHEN 'D0CF11E0' THEN 'ole' ELSE 'PARSE_UNSUPPORTED' END AS kind FROM ({HEADS})",
    "url_validate": f"SELECT id, regexp_matches(trim(url), '(?i)^https?://.+') AS valid FROM ({URLS})",
    "idempotent_create": f"SELECT min(id) AS id, regexp_replace(trim(url), '/+$', '') AS name_key FROM ({TWICE}) GROUP BY 2",
    "topic_terms": f"SELECT id, terms FROM ({_TERMS})",
    "term_expand": f"SELECT id, terms || CASE WHEN contains(w1, '教育') THEN '|学前|幼儿园|幼儿|保育|托育|入园|幼教' ELSE '' END AS terms FROM ({_TERMS})",
    "match_any": f"SELECT doc_id AS id, b <> '' AND len(list_filter(['xqzk', 'xq', 'qz', 'zk', 'ñá', 'áb'], lambda g: contains(b, g))) > 0 AS hit FROM (SELECT doc_id, {_bare('text')} AS b FROM documents)",
    "article_prefilter": f"SELECT doc_id FROM (SELECT doc_id, {_bare(_first)} AS b FROM documents) WHERE len(list_filter(['xqz', 'xq', 'qz', 'ñáb', 'ñá', 'áb'], lambda g: contains(b, g))) > 0",
    "md_segments": f"""WITH l AS (SELECT id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS x FROM ({MARKDOWN})), n AS (SELECT *, sum((x LIKE '#_%')::INT) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM l),
s AS (SELECT id, s, nullif({_trim("coalesce(max(CASE WHEN x LIKE '#_%' THEN regexp_extract(x, '^(#{1,6})[ \\t]*(.+)', 2) END), '')")}, '') AS heading, coalesce(string_agg(CASE WHEN x LIKE '#_%' THEN NULL ELSE x END, chr(10) ORDER BY i), '') AS c FROM n GROUP BY id, s),
k AS (SELECT id, s, heading, {_trim("regexp_replace(c, '\\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM s)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS ordering, heading, sha256(content) AS hash FROM k WHERE content <> '' OR heading IS NOT NULL""",
    "apply_edit": f"WITH e AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'no such anchor' ELSE substring(text, 1, 3) END AS b, {_edit('text', 'substring(text, 5, 6)', 'X')} AS t FROM documents) SELECT id, sha256({_edit('t', 'b', 'YY')}) AS hash FROM e",
    "marker_extract": f"SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '【矛盾#([0-9]+)】', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x > 0), ',') AS seqs FROM ({MARKED})",
    "marker_remove": f"SELECT id, sha256(replace(t, '【矛盾#1】', '')) AS hash FROM ({MARKED})",
    "strip_tag_prefix": f"SELECT id, sha256(CASE WHEN starts_with(t, '[tag:') THEN trim(regexp_replace(t, '^(?:\\[tag:[^\\]\\r\\n]+\\][ \\t\\n\\r\\f\\v]*)+', ''), '{tx.WS_CHARS}') ELSE t END) AS hash FROM ({TAGGED})",
    "tag_split": f"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name || '，' || p_brand || '，' || p_type, '[,，、 \\t\\n]+'), lambda x: x <> ''), '|') AS tags FROM part",
    "resolve_refs": f"SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '#([0-9]+)', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x BETWEEN 1 AND 5), ',') AS refs, array_to_string(list_transform(list_filter(string_split(regexp_replace(t, '(#[1-5])\\b', '|\\1|', 'g'), '|'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^#[1-5]$') THEN 'r:' ELSE 't:' END || x), '|') AS tokens FROM ({REFS})",
    "json_repair": f"SELECT id, CASE WHEN id % 6 IN (0, 1, 4) THEN props WHEN id % 6 = 3 THEN regexp_extract(t, '\\[.*\\]') END AS json FROM ({REPLIES})",
    "parse_outputs": f"SELECT id, CASE WHEN id % 7 IN (0, 3, 5) THEN 'draft' WHEN id % 7 = 1 THEN 'error' ELSE 'null' END AS kind, CASE WHEN id % 7 IN (0, 3, 5) THEN 'T' || id END AS title, CASE WHEN id % 7 IN (0, 3, 5) THEN event_type WHEN id % 7 = 1 THEN 'missing ' || user_id END AS content FROM ({OUTPUTS})",
    "sse_extract": f"SELECT id, string_agg(json_extract_string(substr(line, 6), '$.choices[0].delta.content'), '' ORDER BY n) AS content FROM (SELECT * FROM ({STREAM}) WHERE line LIKE 'data: {{%') GROUP BY id".replace("{{", "{"),
    "error_classify": f"SELECT id, CASE WHEN s IN (401, 403) THEN 'LLM_UNAUTHORIZED' WHEN s = 429 THEN 'LLM_RATE_LIMIT' WHEN s IS NULL THEN 'LLM_NETWORK' WHEN s >= 400 THEN 'LLM_PROVIDER_ERROR' END AS code, coalesce(s = 429 OR s >= 500, true) AS retry, left(json_extract_string(body, '$.error.message'), 200) AS message, json_extract_string(body, '$.choices[0].message.content') AS reply FROM ({CALLS})",
    "mask_secrets": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"apiKey":"***","n":' || event_id || '}' WHEN 1 THEN '{"x":{"auth_token":"***","y":2},"Password":"***"}' WHEN 2 THEN '{"note":"key","n":' || event_id || '}'
  ELSE '{"props":' || json(props) || ',"list":[{"secretKey":"***"},[["[…]"]]],"n":' || event_id || '}' END AS j FROM events""",
    "first_nonempty": f"SELECT id, r FROM ({ATTEMPTS}) WHERE r <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, part, r) = 1",
    "settings_map": f"SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS i FROM ({SETTINGS}) WHERE value IS NULL OR value <> 'bad!') WHERE i = 1 AND value IS NOT NULL",
    "skill_match": f"WITH s AS ({SKILLS}), t AS (SELECT doc_id, md5(text) AS b FROM documents) SELECT doc_id, name FROM t, s WHERE contains(b, name) OR contains(b, tags[1]) OR contains(b, tags[2])",
    "skill_counts": f"SELECT category, count(*) AS n FROM ({SKILLS}) GROUP BY category",
    "array_fk_titles": "SELECT l_orderkey, string_agg(CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE l_suppkey::VARCHAR END, '|' ORDER BY l_linenumber, l_partkey, l_suppkey::VARCHAR) AS titles FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey",
    "valid_ids": "WITH o AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), f AS (SELECT l_orderkey, l_suppkey, min(i) AS i FROM o GROUP BY ALL) SELECT l_orderkey, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY i), '') AS valid FROM f LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = l_suppkey GROUP BY l_orderkey",
    "scope_resolve": "SELECT 'all' AS scope, c_custkey AS source_id FROM customer UNION ALL SELECT 'ids', unnest([5, 3, 5]) UNION ALL SELECT 'tags', c_custkey FROM customer WHERE c_nationkey IN (1, 2, 99)",
    "lookup_url_scope": "WITH u AS (SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)) SELECT page_id, url, CASE WHEN page_id % 2 = 1 THEN 'task' ELSE 'library' END AS scope FROM u UNION ALL SELECT page_id, url, 'task' FROM u",
    "seed_skills": "SELECT 'kept' AS which, n_name FROM nation UNION ALL SELECT 'wiped', r_name FROM region",
    "append_rows": "SELECT year, quality, toxic, count(*) AS n FROM (SELECT 2024 AS year, quality, toxic FROM labels UNION ALL SELECT 2025, 1, NULL FROM documents WHERE doc_id % 2 = 0) GROUP BY ALL",
    "legacy_files": "SELECT doc_id, source AS file_path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0",
    "scan_validate": f"WITH {_v} SELECT id, topic, count(*) AS n FROM g GROUP BY ALL",
    "contradiction_groups": f"WITH {_v}, k AS (SELECT g.*, s.s_suppkey FROM g JOIN supplier s ON s.s_suppkey IN (l_suppkey, l_suppkey + 3) AND s.s_suppkey % 2 = 0), w AS (SELECT id, draft, topic, kind, text, i, string_agg(DISTINCT 's' || s_suppkey, ',' ORDER BY 's' || s_suppkey) AS sources FROM k GROUP BY ALL), t AS (SELECT id, draft FROM k GROUP BY id, draft HAVING count(DISTINCT i) >= 2 AND count(DISTINCT s_suppkey) >= 2), n AS (SELECT id, row_number() OVER (PARTITION BY draft ORDER BY id) AS seq FROM t) SELECT draft, seq, topic, kind, row_number() OVER (PARTITION BY id ORDER BY i) AS variant, text, sources FROM w JOIN n USING (id)",
    "merge_groups": f"WITH {_v}, r AS (SELECT draft, topic, id, text, unnest([l_suppkey, l_suppkey + 3]) AS ref FROM g), m AS (SELECT draft, topic, min(id) AS first, count(DISTINCT text) AS n_texts, count(DISTINCT (text, ref)) AS n_refs FROM r GROUP BY draft, topic) SELECT draft, row_number() OVER (PARTITION BY draft ORDER BY first) AS nr, topic, n_texts, n_refs FROM m",
    "locate_validate": "SELECT l_orderkey AS id, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE count_if(l_suppkey % 3 >= 1 AND l_returnflag <> 'N') END::BIGINT AS n FROM lineitem GROUP BY l_orderkey",
    "crawl_bfs": f"{_site_sql} SELECT root, 'http://s' || h || '.org/p' || i AS url, depth, visited FROM s",
    "crawl_articles": f"{_site_sql}, a AS (SELECT root, h, i + 11 AS n, '' AS tail, 'http' AS scheme, 'A' || i AS title, visited * 100 + 6 AS o FROM s UNION ALL SELECT root, h, i, '?y=1', 'https', NULL, visited * 100 + 7 FROM s UNION ALL SELECT root, h, i + 22, '', 'http', 'B' || i, visited * 100 + 8 FROM s), k AS (SELECT root, 's' || h || '.org/a' || n || '.html' || tail AS key, scheme, title, o FROM a) SELECT root, key, scheme || '://' || key AS url, coalesce(title, scheme || '://' || key) AS title FROM k QUALIFY row_number() OVER (PARTITION BY root, key ORDER BY o) = 1",
    "site_sync": f"""{_site_sql}, {_listed_sql}, ad AS (SELECT h AS site_id, count(*) FILTER (WHERE url NOT IN (SELECT url FROM o)) AS added FROM f GROUP BY h)
SELECT site_id, url, title, discovered_at, coalesce(added, 0)::BIGINT AS added FROM a JOIN (SELECT DISTINCT doc_id % 11 AS site_id FROM documents) USING (site_id) LEFT JOIN ad USING (site_id)""",
    "site_related": f"""{_site_sql}, {_listed_sql}, had AS (SELECT url FROM ({HAD}) WHERE task_id = 't1'), b AS (SELECT url, CASE WHEN contains(html, 'tion') THEN 'station ' ELSE 'x' END || regexp_extract(html, '([0-9a-f]{{{{32}}}})', 1) AS body FROM ({BODIES})),
c AS (SELECT site_id, url, title FROM a WHERE len(list_filter(['A1', 'tion', 'ti', 'io', 'on'], lambda g: contains(replace(title, ' ', ''), g))) > 0)
SELECT site_id, url, NULL AS title, NULL AS hash FROM c SEMI JOIN had USING (url) UNION ALL SELECT site_id, url, title, sha256(body) FROM c JOIN b USING (url) ANTI JOIN had USING (url) WHERE contains(title, 'A1') OR contains(body, 'tion')""".replace("{{", "{").replace("}}", "}"),
    "places_kept": f"""WITH c AS MATERIALIZED ({DISPUTED}), h AS MATERIALIZED (SELECT contradiction_id, p.* FROM ({PLACES}) p JOIN c USING (draft_id, seq)),
q AS (SELECT contradiction_id, arg_max({{'q': nullif(quote, ''), 'm': coalesce(merged, false)}}, nth) AS x FROM h GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY contradiction_id ORDER BY position, variant_id) AS n FROM ({SAYINGS})),
r AS (SELECT contradiction_id, n, arg_max(t, o) AS t FROM (SELECT contradiction_id, v1 AS n, t1 AS t, nth * 2 AS o FROM h UNION ALL SELECT contradiction_id, v2, t2, nth * 2 + 1 FROM h) GROUP BY ALL)
SELECT variant_id, x.q AS quote, x.m AS merged, CASE WHEN x IS NOT NULL THEN x.q IS NOT NULL END AS in_draft, t AS replacement FROM s LEFT JOIN q USING (contradiction_id) LEFT JOIN r USING (contradiction_id, n)""",
    "web_recall": f"WITH s AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN 't1' END AS task_id FROM pages WHERE page_id % 5 = 0) SELECT * FROM s UNION ALL SELECT DISTINCT url, 't1' FROM pages WHERE {_found} AND url NOT IN (SELECT url FROM s WHERE task_id = 't1')",
    "embed_chunks": "SELECT doc_id, CASE WHEN length(text) <= 400 THEN length(text) WHEN length(text) <= 3000 THEN -length(text) END::DOUBLE AS first FROM documents",
    "float_bytes": "SELECT vec_id, len(embedding) * 4 AS n_bytes, true AS same FROM embeddings",
    "summarise_pending": "SELECT doc_id, 'about ' || source AS summary, source AS keywords, 0::BIGINT AS n_entities FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "model_calls": "SELECT item_id, sha256(array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '')) AS hash, 2::BIGINT AS attempts, NULL::VARCHAR AS error, length(text) AS input_chars, 'ok' AS status FROM benchmark",
    "prompt_render": "WITH m AS (SELECT conv_id, string_agg('[' || n || ']（sourceId: ' || conv_id || '，标题：《' || role || '》，位置：turn ' || turn || '）' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS m FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id) SELECT conv_id, sha256(concat_ws(chr(10), '【用户要求】', '标题为' || conv_id, '', '【写作规范】', '（未匹配到本小节的部类细则规范）', '', '【参考材料】', m, '', '请严格遵守【写作规范】中的部类细则要求，依据以上材料撰写这一小节的连贯志书正文。')) AS hash FROM m",
}.items()}
