"""Registered queries of the landed-record readers, over JSON and pages that follow from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import report, trend
from ..sources import landed, sinks
from ..sources.views import AS_OF, posts, sql, table
from ..values import BOILERPLATE
from . import events as ev
from .events import events


def _i():
    return F.col("doc_id")


def _raw(s, d):
    i = _i()
    return posts(s, d).select(
        "doc_id", "title", "content", F.when(i % 2 == 0, "").otherwise(F.col("platform")).alias("source_platform"), "platform", F.concat(F.lit("http://x/"), i.cast("string")).alias("url"), F.when(i % 3 == 0, F.col("source")).alias("source"),
        F.when(i % 4 == 0, None).otherwise(F.col("author")).alias("author"), F.when(i % 2 == 0, "2024-05-06 07:08:09").otherwise(F.col("publish_s").cast("string")).alias("publish_time"), F.when(i % 5 == 0, F.col("verification_type")).alias("verification_type"), F.col("like_count").cast("string").alias("likes_count"),
    )


def _cards(s, d):
    """One search page for every twenty documents, with a card for each and its neighbour's post in the group."""
    i = _i()
    blog = lambda k: F.struct(F.concat(F.lit("m"), (k % 700).cast("string")).alias("mblogid"), F.struct(F.when(k % 13 == 0, "").otherwise((k % 50).cast("string")).alias("id"), F.when(k % 17 == 0, "新华社").otherwise("x").alias("screen_name"), (k % 9).cast("int").alias("verified_type")).alias("user"))
    card = F.struct(blog(i).alias("mblog"), F.array(F.struct(blog(i + 1).alias("mblog"))).alias("card_group"))
    return posts(s, d).groupBy(F.floor(i / 20).alias("page")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("k"), card.alias("c")))), lambda x: x["c"])).alias("json"))


_CARDS = """WITH b AS (SELECT doc_id AS k, doc_id // 20 AS page, doc_id % 20 AS card, 0 AS pos FROM documents UNION ALL SELECT doc_id + 1, doc_id // 20, doc_id % 20, 1 FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY k % 700 ORDER BY page, card, pos) AS rn FROM b WHERE k % 13 <> 0)
SELECT 'https://weibo.com/' || (k % 50)::VARCHAR || '/m' || (k % 700)::VARCHAR AS url, 'm' || (k % 700)::VARCHAR AS post_id, (k % 50)::VARCHAR AS uid,
 CASE WHEN k % 17 = 0 THEN '官方平台' WHEN k % 9 = 0 THEN '认证个人' ELSE '认证机构' END AS verification_type FROM x WHERE rn = 1"""


def _result_pages(s, d):
    i = _i()
    link = lambda k: F.concat(F.lit("<a href='https://weibo.com/"), (k % 50).cast("string"), F.lit("/p"), (k % 600).cast("string"), F.lit("'>x</a>"))
    return posts(s, d).select(i.alias("page_id"), F.concat(F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('<div class="from" id=1>\n'), link(i), F.lit("</div>"))), link(i + 5)).alias("html"))


def _social_comments(s, d):
    i = _i()
    c = F.struct(i.cast("string").alias("id"), F.concat(F.col("content"), F.lit("​")).alias("text_raw"), F.when(i % 2 == 0, "来自北京").otherwise("上海").alias("source"), F.lit("Mon Jul 01 08:30:00 +0800 2024").alias("created_at"), F.when(i % 3 > 0, i % 23).alias("like_counts"), F.struct((i % 9).cast("string").alias("id"), F.col("author").alias("screen_name")).alias("user"))
    return posts(s, d).select(F.to_json(F.array(c)).alias("json"))


def _answers_search(s, d):
    i = _i()
    kind = F.when(i % 4 == 0, "answer").when(i % 4 == 1, "article").when(i % 4 == 2, "question").otherwise("ad")
    author = F.struct(F.lit("a").alias("id"), F.when(i % 8 == 0, "某官方").alias("headline"), F.when(i % 12 == 0, "org").otherwise("people").alias("type"), F.when(i % 16 == 0, F.array(F.struct(F.lit("identity").alias("type")))).alias("badge"))
    return posts(s, d).select(i.alias("page"), F.to_json(F.array(F.struct(F.struct(kind.alias("type"), i.cast("string").alias("id"), F.struct((i * 2).cast("string").alias("id")).alias("question"), author.alias("author")).alias("object")))).alias("json"))


def _expanded(s, d):
    c = landed.flat_zhihu_search(_answers_search(s, d))
    i = _i()
    answers = posts(s, d).where(i % 4 == 2).where(i % 3 > 0).select(i.cast("string").alias("question_id"), F.posexplode(F.sequence(F.lit(1).cast("long"), i % 5 + 1)).alias("pos", "a")).select("question_id", "pos", F.concat("question_id", F.lit("-"), F.col("a").cast("string")).alias("id"))
    return landed.expand_questions(c, answers)


def _answer_comments(s, d):
    i = _i()
    c = F.struct(i.cast("string").alias("id"), F.concat(F.lit("<p>"), F.col("content"), F.lit("</p>")).alias("content"), F.col("publish_s").alias("created_time"), (i % 7).alias("vote_count"), F.struct(F.struct(F.lit("9").alias("id"), F.col("author").alias("name")).alias("member")).alias("author"))
    return posts(s, d).select((i % 30).cast("string").alias("answer_id"), F.to_json(F.array(c)).alias("json"))


def _renmin(s, d):
    i = _i()
    r = F.struct(F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("http://r/"), i.cast("string"))).alias("url"), F.concat(F.lit("<em>"), F.col("title"), F.lit("</em>")).alias("title"), F.col("content").alias("content"), F.col("author").alias("author"), (F.col("publish_s") * 1000 + 7).alias("displayTime"), F.when(i % 4 == 0, "新华社").alias("originName"), F.when(i % 5 == 0, "要闻").alias("belongsName"))
    return posts(s, d).select(F.to_json(F.struct(F.struct(F.array(r).alias("records")).alias("data"))).alias("json"))


def _thepaper(s, d):
    i = _i()
    r = F.struct(F.when(i % 6 > 0, i.cast("string")).alias("contId"), F.col("title").alias("name"), F.col("content").alias("summary"), F.lit("2天前").alias("pubTime"))
    return posts(s, d).select(F.to_json(F.struct(F.when(i % 10 == 0, 500).otherwise(200).alias("code"), F.struct(F.array(r).alias("list")).alias("data"))).alias("json"))


def _sina(s, d):
    i = _i()
    r = F.struct(F.concat(F.lit("http://s/"), (i % 400).cast("string")).alias("url"), F.col("title").alias("title"), F.col("publish_s").cast("string").alias("ctime"), F.col("platform").alias("media_show"))
    return posts(s, d).select(F.to_json(F.struct(F.struct(F.array(r).alias("list")).alias("data"))).alias("json"))


def _data_pages(s, d):
    i = F.col("page_id")
    detail = F.when(i % 3 == 0, '{"pubTime":"2024-03-05 08:30"}').when(i % 3 == 1, F.concat(F.lit('{"publishTime":'), (F.lit(1704067200000) + i * 1000).cast("string"), F.lit("}"))).otherwise("{}")
    article = F.concat(F.lit('{"'), i.cast("string"), F.lit('":{"voteupCount":'), (i % 50).cast("string"), F.lit(',"commentCount":'), (i % 7).cast("string"), F.lit(',"created":'), (F.lit(1704067200) + i).cast("string"), F.lit("}}"))
    html = F.concat(F.col("html"), F.lit('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"detailData":{"contentDetail":'), detail, F.lit('}}}}</script><script id="js-initialData">{"initialState":{"entities":{"articles":'), article, F.lit("}}}</script>"))
    return table(s, d, "pages").select("page_id", F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), F.when(i % 4 > 0, i.cast("string")).otherwise("0")).alias("url"), html.alias("html"))


def _statuses(s, d):
    i = _i()
    x = F.struct(i.cast("string").alias("id"), F.when(i % 5 == 0, "").otherwise(F.concat(F.col("content"), F.lit("​"))).alias("text_raw"), F.lit("Mon Jul 01 08:30:00 +0800 2024").alias("created_at"), F.struct(F.lit("1").alias("id"), F.lit("x").alias("screen_name"), F.lit(220).alias("verified_type")).alias("user"), (i % 11).alias("reposts_count"), (i % 23).alias("attitudes_count"))
    return posts(s, d).select(i.alias("key"), F.to_json(x).alias("json"))


def _answers(s, d):
    i = _i()
    x = F.struct(F.concat(F.lit("<p>"), F.col("content"), F.lit("</p>")).alias("content"), F.col("publish_s").alias("created_time"), (i % 9).alias("voteup_count"), F.struct(F.when(i % 2 == 0, F.col("source")).alias("title")).alias("question"), F.struct(F.lit("org").alias("type")).alias("author"))
    return posts(s, d).select(i.alias("key"), F.to_json(x).alias("json"))


def _built(s, d):
    i = _i()
    raw = posts(s, d).select(F.concat(F.lit("http://u/"), i.cast("string")).alias("url"), "platform", F.concat(F.lit(f"&lt;b&gt; &mdash; {BOILERPLATE['新浪新闻'][-1]}\n"), "content").alias("content"), "author", F.lit("某报").alias("media_show"), F.when(i % 3 == 0, F.col("publish_s")).alias("ctime_s"), F.when(i % 3 == 1, F.col("publish_s") + 60).alias("page_s"))
    return landed.build_doc(raw, AS_OF, F.lit("XX")).select("doc_id", "author", "publish_s", F.md5("content").alias("content"))


def _reports(s, d):
    """Nested reports of all events."""

    def rows(df, name, *columns):
        return df.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    p, daily = posts(s, d), trend.daily_trend(posts(s, d))
    text = lambda df: df.withColumn("date", F.col("date").cast("string"))
    words = ev.keywords(s, d).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "weight"))), lambda x: F.struct(x["word"], x["weight"])).alias("keywords"))
    shares = report.platform_dist(p).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "platform", "ratio"))), lambda x: F.struct(x["platform"], x["ratio"])).alias("platforms"))
    out = trend.heat(p, AS_OF).join(report.event_title(p), "event_id").join(words, "event_id", "left").join(shares, "event_id", "left")
    return out.join(rows(text(daily), "trend", "date", "cnt"), "event_id", "left").join(rows(text(trend.forecast(daily)), "future", "date", "predict_count"), "event_id", "left")


def _report_rows(s, d):
    t = sinks.report_tables(_reports(s, d))
    rows = [t["event_keywords"].select(F.lit("keyword").alias("kind"), "event_id", F.col("word").alias("name"), F.col("weight").alias("value")), t["event_platforms"].select(F.lit("platform"), "event_id", "platform", "ratio"), t["event_trend_daily"].select(F.when(F.col("is_predicted"), "predicted").otherwise("actual"), "event_id", "date", "count")]
    return rows[0].union(rows[1]).union(rows[2])


def _items(s, d):
    return posts(s, d).select("doc_id", "title", F.col("source").alias("keywords"), F.lit(None).cast("string").alias("summary"))


def _long_words(s, d):
    """The long words of all titles, as keywords."""
    return posts(s, d).select(F.explode(tx.tokenize(F.col("title"))).alias("keyword")).where("length(keyword) >= 12").distinct()


QUERIES = {
    "src_records": lambda s, d: landed.normalize_records(_raw(s, d)).select("doc_id", F.md5(F.concat("title", "content")).alias("text"), "publish_s", "platform", "url", "source", "author", "verification_type", "like_count"),
    "src_tabular_posts": lambda s, d: landed.tabular_posts(posts(s, d).select(F.col("doc_id").cast("string").alias("comment_id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("title")).alias("title"), "content")).select("doc_id", "title"),
    "src_labeled": lambda s, d: landed.labelled(table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, " POS ").otherwise("1")).otherwise("Neg").alias("label"))).select("doc_id", "label"),
    "prep_corpus": lambda s, d: landed.prep_corpus(table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 9 == 0, 2).otherwise(F.col("quality")).alias("label"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise("x").alias("review"))).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "flat_weibo_cards": lambda s, d: landed.flat_weibo_cards(_cards(s, d)),
    "flat_weibo_html": lambda s, d: landed.flat_weibo_html(_result_pages(s, d)),
    "flat_weibo_comments": lambda s, d: landed.flat_weibo_comments(_social_comments(s, d)),
    "flat_zhihu_search": lambda s, d: landed.flat_zhihu_search(_answers_search(s, d)).drop("page", "pos"),
    "expand_questions": lambda s, d: _expanded(s, d).drop("page"),
    "flat_zhihu_comments": lambda s, d: landed.flat_zhihu_comments(_answer_comments(s, d)),
    "flat_renmin": lambda s, d: landed.flat_renmin(_renmin(s, d)),
    "flat_thepaper": lambda s, d: landed.flat_thepaper(_thepaper(s, d)),
    "flat_sina": lambda s, d: landed.flat_sina(_sina(s, d)),
    "cand_dedup": lambda s, d: landed.cand_dedup(landed.flat_sina(_sina(s, d)), "url", "ctime", "title"),
    "cand_keyword_match": lambda s, d: landed.cand_keyword_match(_items(s, d), "SRC1").select("doc_id"),
    "cand_cap": lambda s, d: landed.cand_cap(posts(s, d).select("doc_id", "platform", "event_id"), ["platform", "event_id"], ["doc_id"], 3),
    "html_article": lambda s, d: landed.html_article(table(s, d, "pages")).select("page_id", "title", F.md5("body").alias("body"), "publish_s"),
    "cand_keyword_matches": lambda s, d: landed.cand_keyword_matches(_items(s, d), _long_words(s, d)),
    "html_embedded_date": lambda s, d: landed.html_embedded_date(_data_pages(s, d)),
    "html_embedded_counts": lambda s, d: landed.html_embedded_counts(_data_pages(s, d)),
    "json_status_doc": lambda s, d: landed.json_status_doc(_statuses(s, d)),
    "json_answer_doc": lambda s, d: landed.json_answer_doc(_answers(s, d)),
    "build_doc": _built,
    "sink_report_tables": _report_rows,
    "sink_export": lambda s, d: sinks.export_events(events(s, d).select("event_id", "heat", (F.length("event_id") % 2).alias("file_ix"), F.col("event_id").alias("pos")), 0.01).select("event_id", F.col("export_id").cast("long").alias("export_id")),
}

_STRIP = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"
def _article_sql() -> str:
    """``html_article`` in SQL; the fixed lists are the operator's."""

    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    clean = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in landed.NO_CONTENT:
        clean = f"regexp_replace({clean}, {q(rf'(?is)<{tag}{chr(92)}b[^>]*>.*?</{tag}{chr(92)}s*>')}, ' ', 'g')"
    for tag in landed.MARKED:
        marked = rf"""(?is)<{tag}\b[^>]*\b(?:class|id)\s*=\s*["'](?:[^"']*[\s_-])?(?:{landed.MARKS})(?:[\s_-][^"']*)?["'][^>]*>.*?</{tag}\s*>"""
        clean = f"regexp_replace({clean}, {q(marked)}, ' ', 'g')"
    inner = lambda tag: f"regexp_extract(clean, '(?is)<{tag}\\b[^>]*>(.*)</{tag}\\s*>', 1)"
    strip = _STRIP.format
    title = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
    heading = strip("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")
    linked = strip("array_to_string(regexp_extract_all(b, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), ' ')")
    return f"""WITH cleaned AS (SELECT page_id, coalesce(nullif({title}, ''), {heading}) AS title, {clean} AS clean FROM pages),
mains AS (SELECT page_id, title, CASE WHEN length({strip(inner("article"))}) >= 30 THEN {inner("article")} WHEN length({strip(inner("main"))}) >= 30 THEN {inner("main")} ELSE clean END AS main FROM cleaned),
blocks AS (SELECT page_id, title, list_filter(list_transform(regexp_split_to_array(main, '(?i)</?(?:{landed.BLOCK_TAGS})\\b[^>]*>'), lambda b: {{'text': {strip("b")}, 'linked': length({linked})}}), lambda b: b.text <> '') AS b FROM mains),
longs AS (SELECT *, list_transform(b, lambda x: length(x.text) >= {landed.LONG_BLOCK} AND x.linked * {landed.LINK_SHARE} <= length(x.text)) AS long FROM blocks),
bodies AS (SELECT page_id, title, array_to_string(list_transform(list_filter(b, lambda x, i: long[i] OR (length(x.text) < {landed.LONG_BLOCK} AND x.linked = 0 AND (coalesce(CASE WHEN i > 1 THEN long[i - 1] END, false) OR coalesce(long[i + 1], false)))), lambda x: x.text), chr(10)) AS body FROM longs)
SELECT page_id, title, md5(body) AS body, NULL::BIGINT AS publish_s FROM bodies WHERE length(body) >= 30"""


_ARTICLE = _article_sql()

ORACLE = {
    "src_records": sql(["posts"], f"""SELECT doc_id::VARCHAR AS doc_id, md5({_STRIP.format('title')} || {_STRIP.format('content')}) AS text, CASE WHEN doc_id % 2 = 0 THEN epoch(TIMESTAMP '2024-05-06 07:08:09')::BIGINT ELSE publish_s END AS publish_s, platform, 'http://x/' || doc_id::VARCHAR AS url,
 CASE WHEN doc_id % 3 = 0 THEN source ELSE platform END AS source, author, coalesce(CASE WHEN doc_id % 5 = 0 THEN verification_type END, CASE WHEN platform IN ('新浪新闻', '人民网', '澎湃新闻') THEN '官方平台' END) AS verification_type, like_count FROM posts"""),
    "src_tabular_posts": sql(["posts"], "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 OR title = '' THEN left(content, 30) ELSE title END AS title FROM posts"),
    "src_labeled": "SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label FROM labels",
    "prep_corpus": "SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, count(*) AS n FROM labels WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0 GROUP BY 1",
    "flat_weibo_cards": _CARDS,
    "flat_weibo_html": """WITH b AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 5 ELSE doc_id END AS k FROM documents), x AS (SELECT *, row_number() OVER (PARTITION BY k % 600 ORDER BY page_id) AS rn FROM b)
 SELECT 'https://weibo.com/' || (k % 50)::VARCHAR || '/p' || (k % 600)::VARCHAR AS url, 'p' || (k % 600)::VARCHAR AS post_id, (k % 50)::VARCHAR AS uid FROM x WHERE rn = 1""",
    "flat_weibo_comments": sql(["posts"], f"SELECT doc_id::VARCHAR AS comment_id, replace(content, chr(8203), '') AS content, author, (doc_id % 9)::VARCHAR AS user_id, epoch(TIMESTAMP '2024-07-01 08:30:00')::BIGINT AS publish_s, CASE WHEN doc_id % 3 > 0 THEN doc_id % 23 ELSE 0 END AS likes_count, CASE WHEN doc_id % 2 = 0 THEN '北京' ELSE '上海' END AS commenter_ip, 'https://weibo.com/comment/' || doc_id::VARCHAR AS source_url FROM posts"),
    "flat_zhihu_search": """SELECT CASE doc_id % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'article' ELSE 'question' END AS kind, doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 0 THEN (doc_id * 2)::VARCHAR WHEN 2 THEN doc_id::VARCHAR END AS question_id,
 CASE doc_id % 4 WHEN 0 THEN 'https://www.zhihu.com/question/' || (doc_id * 2)::VARCHAR || '/answer/' || doc_id::VARCHAR WHEN 1 THEN 'https://zhuanlan.zhihu.com/p/' || doc_id::VARCHAR ELSE 'https://www.zhihu.com/question/' || doc_id::VARCHAR END AS url,
 CASE WHEN doc_id % 4 = 2 THEN '普通用户' WHEN doc_id % 16 = 0 THEN '认证个人' WHEN doc_id % 8 = 0 THEN '官方平台' WHEN doc_id % 12 = 0 THEN '认证机构' ELSE '普通用户' END AS verification_type FROM documents WHERE doc_id % 4 < 3""",
    "expand_questions": """SELECT CASE doc_id % 4 WHEN 0 THEN 'answer' ELSE 'article' END AS kind, doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 0 THEN (doc_id * 2)::VARCHAR END AS question_id, CASE doc_id % 4 WHEN 0 THEN 'https://www.zhihu.com/question/' || (doc_id * 2)::VARCHAR || '/answer/' || doc_id::VARCHAR ELSE 'https://zhuanlan.zhihu.com/p/' || doc_id::VARCHAR END AS url FROM documents WHERE doc_id % 4 < 2
 UNION ALL SELECT 'answer', doc_id::VARCHAR || '-' || a::VARCHAR, doc_id::VARCHAR, 'https://www.zhihu.com/question/' || doc_id::VARCHAR || '/answer/' || doc_id::VARCHAR || '-' || a::VARCHAR FROM documents, range(1, 4) t(a) WHERE doc_id % 4 = 2 AND doc_id % 3 > 0 AND a <= doc_id % 5 + 1""",
    "flat_zhihu_comments": sql(["posts"], f"SELECT doc_id::VARCHAR AS comment_id, regexp_replace(content, '<[^>]+>', '', 'g') AS content, author, '9' AS user_id, publish_s, doc_id % 7 AS likes_count, '' AS commenter_ip, 'https://www.zhihu.com/answer/' || (doc_id % 30)::VARCHAR || '/comment/' || doc_id::VARCHAR AS source_url FROM posts"),
    "flat_renmin": sql(["posts"], "SELECT 'http://r/' || doc_id::VARCHAR AS url, regexp_replace(title, '<[^>]+>', '', 'g') AS title, regexp_replace(content, '<[^>]+>', '', 'g') AS content, publish_s AS ctime_s, nullif(author, '') AS author, CASE WHEN doc_id % 4 = 0 THEN '新华社' WHEN doc_id % 5 = 0 THEN '要闻' ELSE '人民网' END AS media_show FROM posts WHERE doc_id % 6 > 0"),
    "flat_thepaper": sql(["posts"], "SELECT 'https://www.thepaper.cn/newsDetail_forward_' || doc_id::VARCHAR AS url, title, content, '2天前' AS ctime, '澎湃新闻' AS media_show FROM posts WHERE doc_id % 6 > 0 AND doc_id % 10 > 0"),
    "flat_sina": sql(["posts"], "SELECT 'http://s/' || (doc_id % 400)::VARCHAR AS url, title, publish_s::VARCHAR AS ctime, platform AS media_show FROM posts"),
    "cand_dedup": sql(["posts"], "SELECT url, title, ctime, media_show FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ctime, title) AS rn FROM (SELECT 'http://s/' || (doc_id % 400)::VARCHAR AS url, title, publish_s::VARCHAR AS ctime, platform AS media_show FROM posts)) WHERE rn = 1"),
    "cand_keyword_matches": sql(["posts"], f"SELECT DISTINCT doc_id, keyword FROM posts JOIN kws ON contains(lower(title || chr(0) || source || chr(0)), lower(keyword))", "kws AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(title, '[\\p{L}\\p{N}_]+'), lambda t: len(t) >= 12 AND regexp_matches(t, '[A-Za-z]'))) AS keyword FROM posts)"),
    "cand_keyword_match": sql(["posts"], "SELECT doc_id FROM posts WHERE contains(lower(title), 'src1') OR contains(lower(source), 'src1')"),
    "cand_cap": sql(["posts"], "SELECT doc_id, platform, event_id FROM (SELECT *, row_number() OVER (PARTITION BY platform, event_id ORDER BY doc_id) AS rn FROM posts) WHERE rn <= 3"),
    "html_article": _ARTICLE,
    "html_embedded_date": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN epoch(TIMESTAMP '2024-03-05 08:30:00')::BIGINT WHEN 1 THEN 1704067200::BIGINT + page_id END AS publish_s FROM pages",
    "html_embedded_counts": "SELECT page_id, CASE WHEN page_id % 4 > 0 OR page_id = 0 THEN page_id % 50 END AS like_count, CASE WHEN page_id % 4 > 0 OR page_id = 0 THEN page_id % 7 END AS comment_count, CASE WHEN page_id % 4 > 0 OR page_id = 0 THEN 1704067200::BIGINT + page_id END AS publish_s FROM pages",
    "json_status_doc": sql(["posts"], f"SELECT doc_id AS key, left(content, 50) AS title, content, '头部认证个人' AS verification_type, epoch(TIMESTAMP '2024-07-01 08:30:00')::BIGINT AS publish_s, doc_id % 11 AS repost_count, doc_id % 23 AS like_count, NULL::BIGINT AS comment_count FROM posts WHERE doc_id % 5 > 0 AND content <> ''"),
    "json_answer_doc": sql(["posts"], f"SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN source ELSE left(c, 50) END AS title, c AS content, '认证机构' AS verification_type, publish_s, doc_id % 9 AS like_count, NULL::BIGINT AS comment_count FROM (SELECT *, trim(regexp_replace(content, '<[^>]+>', '', 'g')) AS c FROM posts) WHERE len(c) >= 10"),
    "build_doc": sql(
        ["posts"],
        f"""SELECT 'XX' || strftime(make_timestamp(t * 1000000), '%Y%m%d%H%M%S') || left(md5('http://u/' || doc_id::VARCHAR), 8) AS doc_id, CASE WHEN platform IN ('微博', '知乎') THEN nullif(author, '') ELSE '某报' END AS author, t AS publish_s,
 md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^[ \\t\\r\\f]+', '', 'g'), '(?m)[ \\t\\r\\f]+$', '', 'g'), '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '')) AS content
 FROM (SELECT *, '<b> — ' || CASE WHEN platform = '新浪新闻' THEN '' ELSE '{BOILERPLATE["新浪新闻"][-1]}' END || chr(10) || replace(replace(replace(replace(replace(replace(content, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS z, CASE doc_id % 3 WHEN 0 THEN publish_s WHEN 1 THEN publish_s + 60 ELSE {AS_OF}::BIGINT END AS t FROM posts)""",
    ),
}


def _rest():
    ORACLE["sink_report_tables"] = sql(
        ["posts"],
        "SELECT 'keyword' AS kind, event_id, word AS name, weight AS value FROM kw WHERE word <> '' UNION ALL SELECT 'platform', event_id, platform, ratio FROM plat UNION ALL SELECT 'actual', event_id, date::VARCHAR, cnt::DOUBLE FROM pdaily UNION ALL SELECT 'predicted', event_id, date::VARCHAR, predict_count FROM pfut",
        *ev._KW, ev._PLAT, ev._PDAYS,
    )
    ORACLE["sink_export"] = sql(["posts"], "SELECT event_id, row_number() OVER (ORDER BY len(event_id) % 2, event_id) AS export_id FROM heats WHERE heat >= 0.01", ev._HEAT)


_rest()
