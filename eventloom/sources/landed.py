"""Landed records, JSON and pages to canonical rows.

Everything is declared as DataFrame functions over a text column; schemas are stated, so
nothing is inferred, and each reader works on files of any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import automaton
from ..functions import text as tx
from ..functions import times as tm
from ..functions import values as vl
from ..operators.dedup import simhash64, unsigned
from ..values import BOILERPLATE, LABEL_ALIASES

_some = lambda c: F.nullif(F.col(c), F.lit(""))


def normalize_records(raw: DataFrame) -> DataFrame:
    """Records with either set of names to the canonical columns."""

    def pick(*names: str) -> Column:
        return F.coalesce(*[_some(n) for n in names if n in raw.columns], F.lit(None).cast("string"))

    platform = pick("source_platform", "platform")
    count = lambda *names: vl.to_int_count(pick(*names))
    return raw.select(
        F.col("doc_id").cast("string").alias("doc_id"), tx.strip_boilerplate(F.coalesce(pick("title"), F.lit(""))).alias("title"), tx.strip_boilerplate(F.coalesce(pick("content"), F.lit(""))).alias("content"),
        tm.parse_publish_time(pick("publish_time")).alias("publish_s"), platform.alias("platform"), pick("source_url", "url").alias("url"), F.coalesce(pick("source"), platform).alias("source"),
        F.coalesce(pick("author"), F.lit("")).alias("author"), vl.tier_default(pick("verification_type"), platform).alias("verification_type"), count("repost_count").alias("repost_count"),
        count("like_count", "likes_count").alias("like_count"), count("comment_count").alias("comment_count"),
    )


def read_tabular(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Posts and comments from CSV files with a header; a file with ``comment_id`` has comments."""
    posts = comments = None
    for path in paths:
        df = tabular_posts(spark.read.csv(path, header=True))
        if "comment_id" in df.columns:
            comments = df if comments is None else comments.unionByName(df, allowMissingColumns=True)
        else:
            posts = df if posts is None else posts.unionByName(df, allowMissingColumns=True)
    return posts, comments


def tabular_posts(df: DataFrame) -> DataFrame:
    """``doc_id`` from ``comment_id`` where it is missing; a blank title is the start of the content."""
    if "doc_id" not in df.columns and "comment_id" in df.columns:
        df = df.withColumn("doc_id", F.col("comment_id"))
    title = F.coalesce(_some("title"), F.substring("content", 1, 30)) if "title" in df.columns else F.substring("content", 1, 30)
    return df.withColumn("title", title)


def labelled(df: DataFrame) -> DataFrame:
    """label and text with the aliases of labels resolved; an unknown label is an error."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_ALIASES.items() for x in pair])
    found = F.get(F.array(F.element_at(known, F.lower(F.trim(F.col("label").cast("string"))))), F.lit(0))
    return df.withColumn("label", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col("label").cast("string"), F.lit("null")))).cast("string")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return labelled(spark.read.csv(path, header=True, sep="\t" if path.lower().endswith(".tsv") else ",", multiLine=True, escape='"').select("label", "text"))


def prep_corpus(raw: DataFrame) -> DataFrame:
    """``label`` 0 or 1 and ``review`` to named labels; other rows and blank texts are dropped."""
    good = raw.where((F.length(F.trim(F.coalesce("review", F.lit("")))) > 0) & F.col("label").isin(0, 1))
    return good.withColumn("label", F.when(F.col("label") == 1, "positive").otherwise("negative")).withColumnRenamed("review", "text")


USER = "struct<id:string,screen_name:string,verified_type:int,verified_type_ext:int>"
BLOG = f"struct<mblogid:string,user:{USER}>"


def flat_weibo_cards(landed: DataFrame, column: str = "json") -> DataFrame:
    """Candidates of search cards: posts on the card or in its group; the first of each post."""
    cards = landed.select("page", F.posexplode(F.from_json(F.col(column), f"array<struct<mblog:{BLOG},card_group:array<struct<mblog:{BLOG}>>>>")).alias("card", "c"))
    blogs = F.concat(F.array("c.mblog"), F.coalesce(F.transform("c.card_group", lambda g: g["mblog"]), F.array().cast(f"array<{BLOG}>")))
    rows = cards.select("page", "card", F.posexplode(blogs).alias("pos", "b")).where("b.mblogid <> '' and b.user.id <> ''")
    w = Window.partitionBy("b.mblogid").orderBy("page", "card", "pos")
    firsts = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    url = F.concat(F.lit("https://weibo.com/"), F.col("b.user.id"), F.lit("/"), F.col("b.mblogid"))
    return firsts.select(url.alias("url"), F.col("b.mblogid").alias("post_id"), F.col("b.user.id").alias("uid"), vl.tier_social(F.col("b.user.screen_name"), F.col("b.user.verified_type"), F.col("b.user.verified_type_ext")).alias("verification_type"))


def flat_weibo_html(pages: DataFrame, column: str = "html") -> DataFrame:
    """Post links of result pages: from the blocks of class "from", from the whole page only if they have none; the first of each post."""
    link = r"weibo\.com/(\d+/[a-zA-Z0-9]+)"
    blocks = F.regexp_extract_all(F.col(column), F.lit(r'(?s)<div class="from"[^>]*>(.*?)</div>'), 1)
    own = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(link), 1)))
    found = F.when(F.size(own) > 0, own).otherwise(F.regexp_extract_all(F.col(column), F.lit(link), 1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "x")).select("page_id", "pos", F.split_part("x", F.lit("/"), F.lit(1)).alias("uid"), F.split_part("x", F.lit("/"), F.lit(2)).alias("post_id"))
    w = Window.partitionBy("post_id").orderBy("page_id", "pos")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.concat(F.lit("https://weibo.com/"), "uid", F.lit("/"), "post_id").alias("url"), "post_id", "uid")


def flat_weibo_comments(landed: DataFrame, column: str = "json") -> DataFrame:
    rows = landed.select(F.explode(F.from_json(F.col(column), f"array<struct<id:string,text_raw:string,source:string,created_at:string,like_counts:long,user:{USER}>>")).alias("c"))
    source = F.coalesce("c.source", F.lit(""))
    return rows.select(
        F.col("c.id").alias("comment_id"), F.regexp_replace(F.coalesce("c.text_raw", F.lit("")), "​", "").alias("content"), F.coalesce("c.user.screen_name", F.lit("")).alias("author"), F.coalesce("c.user.id", F.lit("")).alias("user_id"),
        tm.parse_publish_time(tm.parse_weibo_time(F.col("c.created_at"))).alias("publish_s"), F.coalesce("c.like_counts", F.lit(0)).alias("likes_count"),
        F.when(source.startswith("来自"), F.substr(source, F.lit(3))).otherwise(source).alias("commenter_ip"), F.concat(F.lit("https://weibo.com/comment/"), "c.id").alias("source_url"),
    )


ANSWERER = "struct<id:string,name:string,headline:string,type:string,badge:array<struct<type:string>>>"


def _tier(author: str) -> Column:
    return vl.tier_answers(F.transform(f"{author}.badge", lambda b: b["type"]), F.col(f"{author}.headline"), F.col(f"{author}.type"))


def flat_zhihu_search(landed: DataFrame, column: str = "json") -> DataFrame:
    """Answers, articles and questions of a search, each with its URL; others are dropped."""
    rows = landed.select("page", F.posexplode(F.from_json(F.col(column), f"array<struct<object:struct<type:string,id:string,question:struct<id:string>,author:{ANSWERER}>>>")).alias("pos", "x")).select("page", "pos", F.col("x.object").alias("o"))
    kind, site = F.col("o.type"), "https://www.zhihu.com/question/"
    url = (
        F.when(kind == "answer", F.concat(F.lit(site), "o.question.id", F.lit("/answer/"), "o.id")).when(kind == "article", F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), "o.id")).when(kind == "question", F.concat(F.lit(site), "o.id"))
    )
    question = F.when(kind == "answer", F.coalesce("o.question.id", F.lit(""))).when(kind == "question", F.col("o.id"))
    return rows.where(kind.isin("answer", "article", "question")).select("page", "pos", kind.alias("kind"), F.col("o.id").alias("id"), question.alias("question_id"), url.alias("url"), F.when(kind == "question", "普通用户").otherwise(_tier("o.author")).alias("verification_type"))


def expand_questions(candidates: DataFrame, answers: DataFrame, most: int = 3) -> DataFrame:
    """Question rows replaced by their first answers (``question_id``, ``pos``, ``id``); those without answers are dropped."""
    w = Window.partitionBy("question_id").orderBy("pos", "id")
    top = answers.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    asked = candidates.where("kind = 'question'").select("question_id", "page")
    found = asked.join(top, "question_id").select("page", F.lit("answer").alias("kind"), "id", "question_id", F.concat(F.lit("https://www.zhihu.com/question/"), "question_id", F.lit("/answer/"), "id").alias("url"))
    return candidates.where("kind <> 'question'").select("page", "kind", "id", "question_id", "url").unionByName(found)


def flat_zhihu_comments(landed: DataFrame, column: str = "json") -> DataFrame:
    rows = landed.select("answer_id", F.explode(F.from_json(F.col(column), "array<struct<id:string,content:string,created_time:long,vote_count:long,address_text:string,author:struct<member:struct<id:string,name:string>>>>")).alias("c"))
    return rows.select(
        F.col("c.id").alias("comment_id"), F.regexp_replace(F.coalesce("c.content", F.lit("")), "<[^>]+>", "").alias("content"), F.coalesce("c.author.member.name", F.lit("")).alias("author"), F.coalesce("c.author.member.id", F.lit("")).alias("user_id"),
        F.col("c.created_time").alias("publish_s"), F.coalesce("c.vote_count", F.lit(0)).alias("likes_count"), F.coalesce("c.address_text", F.lit("")).alias("commenter_ip"), F.concat(F.lit("https://www.zhihu.com/answer/"), "answer_id", F.lit("/comment/"), "c.id").alias("source_url"),
    )


def flat_renmin(landed: DataFrame, column: str = "json") -> DataFrame:
    """url, title, content, ctime_s, author, media_show; rows without a URL are skipped."""
    r = landed.select(F.explode(F.from_json(F.get_json_object(column, "$.data.records"), "array<struct<url:string,title:string,content:string,author:string,displayTime:long,originName:string,originalName:string,belongsName:string>>")).alias("r")).select("r.*")
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    media = F.coalesce(_some("originName"), _some("originalName"), _some("belongsName"), F.lit("人民网"))
    return r.where("url <> ''").select("url", strip("title").alias("title"), strip("content").alias("content"), F.floor(F.col("displayTime") / 1000).alias("ctime_s"), F.nullif(strip("author"), F.lit("")).alias("author"), media.alias("media_show"))


def flat_thepaper(landed: DataFrame, column: str = "json") -> DataFrame:
    good = landed.where(F.get_json_object(column, "$.code") == "200")
    r = good.select(F.explode(F.from_json(F.get_json_object(column, "$.data.list"), "array<struct<contId:string,name:string,summary:string,pubTime:string>>")).alias("r")).select("r.*").where("contId <> ''")
    return r.select(F.concat(F.lit("https://www.thepaper.cn/newsDetail_forward_"), "contId").alias("url"), F.coalesce("name", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("content"), F.coalesce("pubTime", F.lit("")).alias("ctime"), F.lit("澎湃新闻").alias("media_show"))


def flat_sina(landed: DataFrame, column: str = "json") -> DataFrame:
    return landed.select(F.explode(F.from_json(F.get_json_object(column, "$.data.list"), "array<struct<url:string,title:string,ctime:string,media_show:string>>")).alias("r")).select("r.*")


def cand_dedup(candidates: DataFrame, key: str, *order: str) -> DataFrame:
    """The first sighting of each key."""
    return candidates.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def cand_keyword_match(items: DataFrame, keyword: str) -> DataFrame:
    """Items with the keyword in title, keywords or summary, in any case."""
    held = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower())) for c in ("title", "keywords", "summary")]
    return items.where(held[0] | held[1] | held[2])


def cand_keyword_matches(items: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, keyword: every keyword (``keyword``) that an item holds in title, keywords or summary, in any case; one pass over each item, however many keywords there are."""
    # No keyword reaches over from one field into the next.
    text = F.lower(F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) for c in ("title", "keywords", "summary")]))
    lowered = keywords.select("keyword", F.lower("keyword").alias("word"))
    found = automaton.matches(items.select(F.col(key).alias("key"), text.alias("text")), lowered)
    return found.join(lowered, "word").select(F.col("key").alias(key), "keyword").distinct()


def cand_cap(candidates: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows for each key; a report's limit, by rank within the key."""
    return candidates.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= most).drop("__rn")


#: Elements that hold no content, names that mark such ones, tags that end a block, and what makes a block content.
NO_CONTENT = ["script", "style", "head", "noscript", "template", "nav", "footer", "aside", "header", "form", "button", "select", "iframe", "svg"]
MARKED, MARKS = ["div", "section", "ul", "ol", "p", "span"], "ad|ads|advert|advertisement|banner|breadcrumb|comments?|cookie|copyright|footer|menu|nav|navbar|pagination|related|share|sidebar|sponsor"
BLOCK_TAGS = "p|div|article|section|main|h[1-6]|ul|ol|li|dl|dt|dd|table|tbody|tr|td|th|blockquote|pre|br|hr|figure|figcaption|body|html"
LONG_BLOCK, LINK_SHARE = 25, 3


def html_article(pages: DataFrame, least: int = 30) -> DataFrame:
    """page_id, url, title, body and publish_s of pages whose main content has at least so many characters.

    Scripts, navigation, footers and elements marked as advertising and the like go first. Of the
    page's article, or main part, or of all, blocks between block tags are content if
    they are long and at most a third of them is links; short ones without a link if they
    stand next to such. The time is that of meta and time tags, else that of embedded data.
    """
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", " ")
    for tag in NO_CONTENT:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    for tag in MARKED:
        html = F.regexp_replace(html, rf"""(?is)<{tag}\b[^>]*\b(?:class|id)\s*=\s*["'](?:[^"']*[\s_-])?(?:{MARKS})(?:[\s_-][^"']*)?["'][^>]*>.*?</{tag}\s*>""", " ")

    def inner(tag: str) -> Column:
        return F.regexp_extract("clean", rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)

    def enough(part: str) -> Column:
        return F.when(F.length(tx.strip_boilerplate(F.col(part))) >= least, F.col(part))

    def parts(block: Column) -> Column:
        links = F.array_join(F.regexp_extract_all(block, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), 1), " ")
        return F.struct(tx.strip_boilerplate(block).alias("text"), F.length(tx.strip_boilerplate(links)).alias("linked"))

    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = tx.strip_boilerplate(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    told = {f"told{n}": F.regexp_extract("html", way, 1) for n, way in enumerate(TIME_WAYS)}
    rows = _once(pages, ["page_id", "url"], name=title, heading=heading, data=_embedded(F.col("html")), clean=html, **told)
    rows = _once(rows, ["page_id", "url", "clean"], title=F.coalesce(F.nullif("name", F.lit("")), "heading"), publish_s=_page_time(), article=inner("article"), part=inner("main"))
    rows = _once(rows, ["page_id", "url", "title", "publish_s"], main=F.coalesce(enough("article"), enough("part"), "clean"))
    rows = _once(rows, ["page_id", "url", "title", "publish_s"], blocks=F.filter(F.transform(F.split("main", rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"), parts), lambda b: b["text"] != ""))
    rows = _once(rows, ["page_id", "url", "title", "publish_s", "blocks"], long=F.transform("blocks", lambda b: (F.length(b["text"]) >= LONG_BLOCK) & (b["linked"] * LINK_SHARE <= F.length(b["text"]))))
    beside = lambda i: F.coalesce(F.get("long", i - 1), F.lit(False)) | F.coalesce(F.get("long", i + 1), F.lit(False))
    kept = F.filter("blocks", lambda b, i: F.get("long", i) | ((F.length(b["text"]) < LONG_BLOCK) & (b["linked"] == 0) & beside(i)))
    rows = _once(rows, ["page_id", "url", "title", "publish_s"], body=F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
    return rows.select("page_id", "url", "title", "body", "publish_s").where(F.length("body") >= least)


def _once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and new columns, each worked out once a row: no filter and no later column takes their expressions in."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


#: Names of meta properties that tell when a page was published.
TIME_NAMES = "article:published_time|datePublished|pubdate|publishdate|og:published_time|date"


def _ways() -> list[str]:
    quoted = """["']([^"']+)["']"""
    name = rf"""(?:property|name|itemprop)\s*=\s*["'](?:{TIME_NAMES})["']"""
    return [rf"(?is)<meta\b[^>]*{name}[^>]*\bcontent\s*=\s*{quoted}", rf"(?is)<meta\b[^>]*\bcontent\s*=\s*{quoted}[^>]*{name}", rf"(?is)<time\b[^>]*\bdatetime\s*=\s*{quoted}"]


TIME_WAYS = _ways()


def _page_time() -> Column:
    """Epoch seconds of the first meta or time tag that tells them (``told0`` and so on), in the page's own clock; else of embedded ``data``."""
    found = [tm.parse_publish_time_lenient(F.regexp_extract(F.trim(f"told{n}"), r"^(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)", 1)) for n in range(len(TIME_WAYS))]
    return F.coalesce(*found, _embedded_time(F.col("data")))


def _embedded(html: Column) -> Column:
    return F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def _embedded_time(data: Column) -> Column:
    at = "$.props.pageProps.detailData.contentDetail."
    clock = tm.parse_publish_time_lenient(F.get_json_object(data, at + "pubTime"))
    return F.coalesce(clock, F.floor(F.get_json_object(data, at + "publishTime").try_cast("double") / 1000))


def html_embedded_date(pages: DataFrame) -> DataFrame:
    """page_id, publish_s from the page's embedded data: the formatted time, else the milliseconds."""
    return pages.select("page_id", _embedded_time(_embedded(F.col("html"))).alias("publish_s"))


def html_embedded_counts(pages: DataFrame) -> DataFrame:
    """page_id, like_count, comment_count, publish_s of a column page's own article."""
    article = F.regexp_extract("url", r"/p/(\d+)", 1)
    data = F.regexp_extract("html", r'(?s)<script id="js-initialData"[^>]*>(.*?)</script>', 1)
    entries = F.from_json(F.get_json_object(data, "$.initialState.entities.articles"), "map<string,struct<voteupCount:long,commentCount:long,created:long>>")
    own = F.element_at(entries, article)
    return pages.select("page_id", own["voteupCount"].alias("like_count"), own["commentCount"].alias("comment_count"), own["created"].alias("publish_s"))


def json_status_doc(landed: DataFrame, column: str = "json") -> DataFrame:
    """Status JSON to a document; the title is the text's start; empty texts are dropped."""
    x = landed.select("key", F.from_json(F.col(column), f"struct<id:string,text_raw:string,created_at:string,user:{USER},reposts_count:long,attitudes_count:long,comments_count:long>").alias("x")).where("x.id is not null")
    content = F.regexp_replace(F.coalesce("x.text_raw", F.lit("")), "​", "")
    return x.withColumn("content", content).where("content <> ''").select(
        "key", F.substring("content", 1, 50).alias("title"), "content", vl.tier_social(F.col("x.user.screen_name"), F.col("x.user.verified_type"), F.col("x.user.verified_type_ext")).alias("verification_type"),
        tm.parse_publish_time(tm.parse_weibo_time(F.col("x.created_at"))).alias("publish_s"), F.col("x.reposts_count").alias("repost_count"), F.col("x.attitudes_count").alias("like_count"), F.col("x.comments_count").alias("comment_count"),
    )


def json_answer_doc(landed: DataFrame, column: str = "json", least: int = 10) -> DataFrame:
    """Answer JSON to a document; short ones are dropped; the title is the question's, else the text's start."""
    x = landed.select("key", F.from_json(F.col(column), f"struct<content:string,created_time:long,voteup_count:long,comment_count:long,question:struct<title:string>,author:{ANSWERER}>").alias("x"))
    x = x.withColumn("content", F.trim(F.regexp_replace(F.coalesce("x.content", F.lit("")), "<[^>]+>", ""))).where(F.length("content") >= least)
    return x.select("key", F.coalesce(F.nullif("x.question.title", F.lit("")), F.substring("content", 1, 50)).alias("title"), "content", _tier("x.author").alias("verification_type"), F.col("x.created_time").alias("publish_s"), F.col("x.voteup_count").alias("like_count"), F.col("x.comment_count").alias("comment_count"))


def build_doc(raw: DataFrame, as_of: int, code: Column, boilerplate: dict[str, list[str]] = BOILERPLATE) -> DataFrame:
    """Keyed documents: id from the code, the time and the URL; time from the candidate, the page or ``as_of``; authors of social posts only.

    The content is cleaned of its platform's boilerplate; ``content_hash`` is its fingerprint as an unsigned number.
    """
    t = F.coalesce("ctime_s", "page_s", F.lit(as_of))
    days, rest = F.date_from_unix_date(F.floor(t / 86400).cast("int")).cast("string"), F.pmod(t, F.lit(86400))
    clock = F.concat(*[F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, F.pmod(rest, F.lit(3600)) / 60, F.pmod(rest, F.lit(60)))])
    author = F.when(F.col("platform").isin("微博", "知乎"), _some("author")).otherwise(_some("media_show"))
    return raw.withColumns({"publish_s": t, "author": author, "doc_id": F.concat(code, F.regexp_replace(days, "-", ""), clock, F.substring(F.md5("url"), 1, 8)), "content": tx.clean_content(F.col("content"), F.col("platform"), boilerplate)}).withColumn("content_hash", unsigned(simhash64(F.col("content"))))
