"""Registered queries of the column functions, over inputs that follow from the posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times as tm
from ..functions import values as vl
from ..operators import dedup
from ..sources.tables import spread
from ..sources.views import posts, sql, table
from ..values import BOILERPLATE, KEYWORD_GROUPS, KEYWORD_REST

_RAW_TIME_SQL = """CASE doc_id % 6 WHEN 0 THEN (45000 + doc_id % 300)::VARCHAR WHEN 1 THEN (1704067200 + doc_id)::VARCHAR WHEN 2 THEN '2024-0' || (doc_id % 9 + 1)::VARCHAR || '-15 08:30:05'
 WHEN 3 THEN '2024-0' || (doc_id % 9 + 1)::VARCHAR || '-15T08:30:05' WHEN 4 THEN '2024-0' || (doc_id % 9 + 1)::VARCHAR || '-15' ELSE 'soon' END"""
_MONTHS = "['" + "','".join(tm.MONTHS) + "']"

_HTMLISH_SQL = "'&lt;' || title || '&gt; &amp;amp; “—''…© ≂̸ € \ufffd \ufffd ¬hing; ©x a&b &;' || chr(8203) || chr(10) || chr(10) || chr(10) || chr(10) || '  声明：本文内容仅代表作者个人观点，与新浪网无关。 ' || content || '  ' || chr(10)"


def _q(*columns, source=posts):
    return lambda s, d: source(s, d).select("doc_id", *columns)


def _case(column: str, values: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


_TOKENS = "list_filter(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'), lambda t: len(t) >= 2 AND regexp_matches(t, '[A-Za-z]'))"
_RATIO_SQL = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN (doc_id % 101) / 100.0::DOUBLE ELSE (doc_id % 101)::DOUBLE END"
_WORDS = [w for words in KEYWORD_GROUPS.values() for w in words] + ["其他"]

def _simhash(texts):
    # Both forms are equal (tested); SQL is too slow for whole texts.
    return texts.select("doc_id", dedup.simhash64(F.col("text")).alias("fingerprint"))


def _built():
    """The queries by name; columns can be built only once a session is there."""
    I = F.col("doc_id")  # noqa: E741
    #: Times in all accepted forms, chosen by the id.
    _RAW_TIME = F.when(I % 6 == 0, (F.lit(45000) + I % 300).cast("string")).when(I % 6 == 1, (F.lit(1704067200) + I).cast("string")).when(I % 6 == 2, F.concat(F.lit("2024-0"), (I % 9 + 1).cast("string"), F.lit("-15 08:30:05"))).when(
        I % 6 == 3, F.concat(F.lit("2024-0"), (I % 9 + 1).cast("string"), F.lit("-15T08:30:05"))
    ).when(I % 6 == 4, F.concat(F.lit("2024-0"), (I % 9 + 1).cast("string"), F.lit("-15"))).otherwise("soon")
    _HTMLISH = F.concat(F.lit("&lt;"), F.col("title"), F.lit("&gt; &amp;amp; &#8220;&mdash;&#x27;&hellip;&copy &NotEqualTilde; &#128; &#0; &#x110000; &nothing; &copyx a&b &;​\n\n\n\n  声明：本文内容仅代表作者个人观点，与新浪网无关。 "), F.col("content"), F.lit("  \n"))
    _RATIO = F.when(I % 5 == 0, None).when(I % 5 == 1, (I % 101) / 100.0).otherwise((I % 101).cast("double"))
    return {
        "strip_boilerplate": _q(F.md5(tx.strip_boilerplate(F.concat(F.lit("<p>"), F.col("title"), F.lit("</p> <b>x</b>  "), F.col("content")))).alias("clean")),
        "clean_content": _q(F.md5(tx.clean_content(_HTMLISH, F.col("platform"), BOILERPLATE)).alias("clean")),
        "parse_publish_time": _q(tm.parse_publish_time(_RAW_TIME).alias("publish_s")),
        "parse_publish_time_lenient": _q(tm.parse_publish_time_lenient(F.when(I % 7 == 0, "20240105083005").when(I % 7 == 1, "2024-03-05 08:30").otherwise(_RAW_TIME)).alias("publish_s")),
        "parse_weibo_time": _q(tm.parse_weibo_time(F.when(I % 3 == 0, "just now").otherwise(F.concat(F.lit("Mon Jul "), F.lpad((I % 28 + 1).cast("string"), 2, "0"), F.lit(" 08:30:00 +0800 2024")))).alias("time")),
        "to_int_count": _q(vl.to_int_count(F.when(I % 5 == 0, None).when(I % 5 == 1, "").when(I % 5 == 2, F.concat((I % 50).cast("string"), F.lit(".9"))).when(I % 5 == 3, "n/a").otherwise((25 - I % 50).cast("string"))).alias("n")),
        "text_type": _q(vl.text_type(F.col("platform")).alias("kind")),
        "auto_text_type": _q(vl.auto_text_type(F.col("content")).alias("kind")),
        "tier_weibo": _q(vl.tier_social(F.when(I % 13 == 0, "新华社").otherwise(F.col("author")), F.when(I % 4 == 0, 0).when(I % 4 == 1, (I % 10).cast("int")).when(I % 4 == 2, 220).cast("int"), (I % 3).cast("int")).alias("tier")),
        "tier_zhihu": _q(vl.tier_answers(F.when(I % 5 == 0, F.array(F.lit("identity"))).when(I % 5 == 1, F.array(F.lit("identity"), F.lit("high_salt"))), F.when(I % 7 == 0, "某某官方帐号"), F.when(I % 3 == 0, "org").otherwise("people")).alias("tier")),
        "tier_default": _q(vl.tier_default(F.col("verification_type"), F.col("platform")).alias("tier")),
        "tokenize": lambda s, d: posts(s, d).select("doc_id", tx.tokenize(F.col("content")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens")),
        "shingles4": lambda s, d: posts(s, d).select("doc_id", tx.shingles(F.col("content")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("shingles")),
        "hamming": _q(dedup.hamming(I * 2654435761, I * 40503).cast("long").alias("distance")),
        "sentences": lambda s, d: posts(s, d).select("doc_id", tx.sentences(F.col("content")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("sentences")),
        "char_bigrams": _q(F.md5(F.array_join(tx.char_bigrams(F.col("content")), "|")).alias("bigrams")),
        "combined_text": _q(F.md5(tx.combined_text(F.col("title"), F.when(I % 3 > 0, F.col("source")), F.lit(None).cast("string"), keywords=F.array("platform", "source"))).alias("text")),
        "influence": _q(F.round(vl.influence(F.col("repost_count"), F.col("comment_count"), F.col("like_count")), 4).alias("influence")),
        "snippet": _q(tx.snippet(F.when(I % 3 == 0, "").otherwise(F.col("title")), F.col("content")).alias("snippet"), F.coalesce(F.nullif("author", F.lit("")), F.lit("匿名")).alias("author")),
        "event_title_clean": _q(tx.event_title_clean(F.concat(F.lit("https://a.example/x "), F.col("title"))).alias("title")),
        "risk_level": _q(vl.risk_level((I % 60).cast("double"), (I % 11) / 10.0).alias("risk")),
        "duplicate_rate": _q(vl.duplicate_rate(I % 7, I % 13).alias("rate")),
        "authenticity_level": _q(vl.authenticity_level(F.when(I % 9 > 0, (I % 101) / 100.0)).alias("level")),
        "ratio_tone": lambda s, d: posts(s, d).select("doc_id", F.expr("stack(2, 'official_ratio', 'plain_user_ratio')").alias("topic"), vl.ratio_percent(_RATIO).alias("ratio")).select(
            "doc_id", "topic", "ratio", F.when(F.col("topic") == "plain_user_ratio", vl.ratio_tone(F.col("ratio"), True)).otherwise(vl.ratio_tone(F.col("ratio"))).alias("tone")
        ),
        "percent_norm": _q(vl.percent_norm(_RATIO).alias("percent")),
        "code_labels": _q(
            vl.risk_label(F.when(I % 4 == 0, "high").when(I % 4 == 1, "mid_high").when(I % 4 == 2, "odd")).alias("risk"), vl.stage_label(F.when(I % 3 == 0, "peak").when(I % 3 == 1, "decline")).alias("stage")
        ),
        "time_label": _q(vl.display_time(F.concat(F.date_from_unix_date((I % 400 + 19000).cast("int")).cast("string"), F.lit("T08:30:05"))).alias("display"), vl.trend_label(F.when(I % 2 == 0, F.date_from_unix_date((I % 400 + 19000).cast("int")).cast("string")).otherwise("2024-01-01T08:30:05")).alias("label")),
        "people_text": _q(vl.people_text(F.array("author", F.lit(None).cast("string"), F.col("source"))).alias("people")),
        "keyword_category": _q(vl.keyword_category(F.element_at(F.array(*map(F.lit, _WORDS)), (I % len(_WORDS) + 1).cast("int"))).alias("category")),
        "sources_variant": _q(F.array_join(vl.sources_variant(F.when(I % 3 == 0, F.to_json(F.array("source", "platform"))).when(I % 3 == 1, F.to_json(F.struct(F.array("source").alias("source_names")))).otherwise(F.col("source"))), ",").alias("sources")),
        "label_from_proba": _q(vl.label_from_proba((I % 101) / 100.0, 1 - (I % 101) / 100.0).alias("label")),
        "label_from_model": _q(vl.label_from_model(F.when(I % 3 == 0, "LABEL_1").when(I % 3 == 1, "neg").otherwise("odd"), (I % 101) / 100.0).alias("label")),
        "lexicon_hit": lambda s, d: posts(s, d).select("doc_id", tx.tokenize(F.col("content")).alias("t")).select("doc_id", tx.contains_any(F.col("t"), ["tion", "heit"]).alias("hits")),
        "set_overlap": _q(F.arrays_overlap(tx.tokenize(F.col("title")), tx.tokenize(F.substr("content", F.length("title") + 1))).alias("overlap")),
        "simhash64": lambda s, d: spread(posts(s, d).select("doc_id", F.col("content").alias("text")), "doc_id").transform(_simhash),
    }


_LENIENT = f"CASE doc_id % 7 WHEN 0 THEN '20240105083005' WHEN 1 THEN '2024-03-05 08:30' ELSE {_RAW_TIME_SQL} END"
_CLOCKED = "epoch(try_cast(replace(t, 'T', ' ') AS TIMESTAMP))::BIGINT"


def _p(columns: str) -> str:
    return sql(["posts"], f"SELECT doc_id, {columns} FROM posts")


_SENTS = "list_filter(list_transform(regexp_split_to_array({}, '[。！？!?；;\\n]+'), lambda s: trim(s)), lambda s: len(s) >= 6)"
_CHR = "chr(8203) || '-' || chr(8207) || chr(65279)"

ORACLE = {
    "strip_boilerplate": _p("md5(trim(regexp_replace(regexp_replace('<p>' || title || '</p> <b>x</b>  ' || content, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))) AS clean"),
    "clean_content": _p(
        "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        + "CASE WHEN platform = '新浪新闻' THEN replace(z, '声明：本文内容仅代表作者个人观点，与新浪网无关。', '') ELSE z END"
        + ", '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)^[ \\t\\r\\f]+', '', 'g'), '(?m)[ \\t\\r\\f]+$', '', 'g'), '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '')) AS clean"
    ).replace("FROM posts", f"FROM (SELECT doc_id, platform, regexp_replace(replace(replace(replace({_HTMLISH_SQL}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[' || {_CHR} || ']', '', 'g') AS z FROM posts)"),
    "parse_publish_time": f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN t::BIGINT * 86400 - 2209161600 WHEN 1 THEN t::BIGINT WHEN 5 THEN NULL ELSE {_CLOCKED} END AS publish_s FROM (SELECT doc_id, {_RAW_TIME_SQL} AS t FROM documents)",
    "parse_publish_time_lenient": f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN epoch(TIMESTAMP '2024-01-05 08:30:05')::BIGINT WHEN doc_id % 7 = 1 THEN epoch(TIMESTAMP '2024-03-05 08:30:00')::BIGINT WHEN doc_id % 6 IN (0, 1) THEN t::BIGINT WHEN doc_id % 6 = 5 THEN NULL ELSE {_CLOCKED} END AS publish_s FROM (SELECT doc_id, {_LENIENT} AS t FROM documents)",
    "parse_weibo_time": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'just now' ELSE '2024-07-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 08:30:00' END AS time FROM documents",
    "to_int_count": "SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN doc_id % 50 WHEN 4 THEN greatest(25 - doc_id % 50, 0) ELSE 0 END AS n FROM documents",
    "text_type": _p("CASE WHEN platform IN ('微博', '知乎') THEN 'comment' WHEN platform IN ('新浪新闻', '澎湃新闻') THEN 'article' ELSE 'auto' END AS kind"),
    "auto_text_type": _p("CASE WHEN len(content) > 200 THEN 'article' ELSE 'comment' END AS kind"),
    "tier_weibo": """SELECT doc_id, CASE WHEN n = '新华社' THEN '官方平台' WHEN (t = 0 AND e = 2) OR t IN (200, 220) THEN '头部认证个人' WHEN t = 0 THEN '认证个人' WHEN t BETWEEN 1 AND 8 THEN '认证机构' ELSE '普通用户' END AS tier
 FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '新华社' ELSE '' END AS n, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN doc_id % 10 WHEN 2 THEN 220 ELSE -1 END AS t, doc_id % 3 AS e FROM documents)""",
    "tier_zhihu": "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN '头部认证个人' WHEN doc_id % 5 = 0 THEN '认证个人' WHEN doc_id % 7 = 0 THEN '官方平台' WHEN doc_id % 3 = 0 THEN '认证机构' ELSE '普通用户' END AS tier FROM documents",
    "tier_default": _p("coalesce(verification_type, CASE WHEN platform IN ('新浪新闻', '人民网', '澎湃新闻') THEN '官方平台' END) AS tier"),
    "tokenize": sql(["posts"], f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM posts)"),
    "shingles4": sql(["posts"], "SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS shingles FROM (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: substr(w, i, 4)) WHEN len(w) > 0 THEN [w] ELSE [] END AS t FROM (SELECT doc_id, regexp_replace(content, '[ \\t\\n\\v\\f\\r]+', '', 'g') AS w FROM posts))"),
    "hamming": "SELECT doc_id, bit_count(xor(doc_id * 2654435761::BIGINT, doc_id * 40503::BIGINT))::BIGINT AS distance FROM documents",
    "sentences": sql(["posts"], f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS sentences FROM (SELECT doc_id, {_SENTS.format('content')} AS t FROM posts)"),
    "char_bigrams": sql(["posts"], "SELECT doc_id, md5(array_to_string(list_transform(range(1, len(w)), lambda i: substr(w, i, 2)), '|')) AS bigrams FROM (SELECT doc_id, trim(content) AS w FROM posts)"),
    "combined_text": _p("md5(title || ' ' || CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END || '  ' || platform || ' ' || source) AS text"),
    "influence": _p("round(repost_count * 1.0::DOUBLE + comment_count * 0.5::DOUBLE + like_count * 0.3::DOUBLE, 4) AS influence"),
    "snippet": _p("left(CASE WHEN doc_id % 3 = 0 OR title = '' THEN content ELSE title END, 40) AS snippet, CASE WHEN author = '' THEN '匿名' ELSE author END AS author"),
    "event_title_clean": _p("trim(title) AS title"),
    "risk_level": "SELECT doc_id, CASE WHEN s >= 40 THEN 'high' WHEN s >= 15 THEN 'mid_high' WHEN s >= 5 THEN 'mid' ELSE 'low' END AS risk FROM (SELECT doc_id, (doc_id % 60)::DOUBLE * (1 + 2 * ((doc_id % 11)::DOUBLE / 10.0::DOUBLE)) AS s FROM documents)",
    "duplicate_rate": "SELECT doc_id, CASE WHEN doc_id % 7 + doc_id % 13 > 0 THEN round((doc_id % 7)::DOUBLE / (doc_id % 7 + doc_id % 13), 3) ELSE 0 END AS rate FROM documents",
    "authenticity_level": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 101 >= 80 THEN 'high' WHEN doc_id % 101 >= 50 THEN 'medium' ELSE 'low' END AS level FROM documents",
    "ratio_tone": f"SELECT doc_id, topic, r AS ratio, CASE WHEN r IS NULL THEN 'pending' WHEN topic = 'plain_user_ratio' THEN CASE WHEN r <= 30 THEN 'ok' WHEN r <= 60 THEN 'warn' ELSE 'danger' END WHEN r >= 60 THEN 'ok' WHEN r >= 20 THEN 'warn' ELSE 'danger' END AS tone FROM (SELECT doc_id, topic, CASE WHEN v IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN v > 0 AND v <= 1 THEN floor(v * 100 + 0.5::DOUBLE) ELSE floor(v + 0.5::DOUBLE) END)) END AS r FROM (SELECT doc_id, {_RATIO_SQL} AS v FROM documents), (VALUES ('official_ratio'), ('plain_user_ratio')) t(topic))",
    "percent_norm": f"SELECT doc_id, CASE WHEN v > 0 AND v <= 1 THEN floor(v * 1000 + 0.5::DOUBLE) / 10.0::DOUBLE ELSE v END AS percent FROM (SELECT doc_id, coalesce({_RATIO_SQL}, 0) AS v FROM documents)",
    "code_labels": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '高' WHEN 1 THEN '中高' WHEN 2 THEN 'odd' ELSE '中' END AS risk, CASE doc_id % 3 WHEN 0 THEN '高潮期' WHEN 1 THEN '衰退期' ELSE '成长期' END AS stage FROM documents",
    "time_label": "SELECT doc_id, d || ' 08:30' AS display, CASE WHEN doc_id % 2 = 0 THEN substr(d, 6, 5) ELSE '08:30' END AS label FROM (SELECT doc_id, (DATE '1970-01-01' + (doc_id % 400 + 19000)::INTEGER)::VARCHAR AS d FROM documents)",
    "people_text": _p("CASE WHEN author = '' THEN source ELSE author || '、' || source END AS people"),
    "keyword_category": "SELECT doc_id, ['" + "','".join([g for g, w in KEYWORD_GROUPS.items() for _ in w] + [KEYWORD_REST]) + f"'][doc_id % {len(_WORDS)} + 1] AS category FROM documents",
    "sources_variant": _p("CASE WHEN doc_id % 3 = 0 THEN source || ',' || platform ELSE source END AS sources"),
    "label_from_proba": "SELECT doc_id, CASE WHEN greatest(p, 1 - p) < 0.6::DOUBLE THEN 'neutral' WHEN p > 1 - p THEN 'positive' ELSE 'negative' END AS label FROM (SELECT doc_id, (doc_id % 101)::DOUBLE / 100.0::DOUBLE AS p FROM documents)",
    "label_from_model": "SELECT doc_id, CASE WHEN doc_id % 101 < 65 THEN 'neutral' WHEN doc_id % 3 = 0 THEN 'positive' WHEN doc_id % 3 = 1 THEN 'negative' ELSE 'neutral' END AS label FROM documents",
    "lexicon_hit": sql(["posts"], f"SELECT doc_id, len(list_filter({_TOKENS}, lambda t: regexp_matches(t, 'tion|heit')))::BIGINT AS hits FROM posts"),
    "set_overlap": sql(["posts"], f"SELECT doc_id, list_has_any({_TOKENS.replace('content', 'title')}, {_TOKENS.replace('content', 'substr(content, len(title) + 1)')}) AS overlap FROM posts"),
}

QUERIES = {name: lambda s, d, name=name: _built()[name](s, d) for name in [*ORACLE, "simhash64"]}
