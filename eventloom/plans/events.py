"""Registered queries on events: reports, vectors, lists and details."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..operators import dedup, lookups, ml, report, trend, vectors
from ..sources.tables import shared_folder, spread, stash
from ..sources.views import AS_OF, START, comments, posts, sql, table
from .scalars import _TOKENS

#: Parts of words stand in for a sentiment lexicon: hits within words are what counts.
POS, NEG = ["tion", "heit", "mente"], ["ing", "ung", "eux"]
DAY = 86400


def tokens(s, d):
    return spread(posts(s, d).select("doc_id", "event_id", "platform", "content"), "doc_id").select("doc_id", "event_id", "platform", tx.tokenize(F.col("content")).alias("tokens"))


def counts(s, d):
    """Terms of each document, written: texts are read and cut once, however often the counts are used."""
    return stash(vectors.term_counts(tokens(s, d), "event_id", "doc_id"), "counts")


def _doc_keywords(s, d, k):
    totals = posts(s, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("total"))
    return vectors.bag_keywords(stash(vectors.term_bags(tokens(s, d), "event_id", "doc_id"), "bags"), totals, k)


def keywords(s, d, k=8):
    """Written, as a few rows an event are joined to much else."""
    return stash(vectors.event_keywords(_doc_keywords(s, d, k), k), "keywords")


def sentiment(s, d):
    return report.sentiment_dist(report.sentiment_dict(tokens(s, d), POS, NEG))


def events(s, d):
    """One row an event: title, heat, sentiment, risk, span and count."""
    columns = ["event_id", "seq", "platform", "title", "publish_s"]
    labelled = report.sentiment_dict(spread(posts(s, d).select(*columns, "content"), "seq").select(*columns, tx.tokenize(F.col("content")).alias("tokens")), POS, NEG)
    found = [trend.heat_column(AS_OF), *report.sentiment_columns(), report.title_column(), *trend.span_columns(), F.count(F.lit(1)).alias("report_count")]
    out = labelled.groupBy("event_id").agg(*found).withColumn("risk_level", vl.risk_level(F.col("heat"), F.col("negative")))
    return stash(out, "events")


def _facts(s, d):
    """Counts and heat by event, platform and day, written: a few rows that stand for all posts."""
    return stash(trend.day_facts(posts(s, d), AS_OF), "facts")


def hot_list(s, d):
    w_order = [F.desc("heat"), F.asc("event_id")]
    facts = _facts(s, d)
    top = report.platforms_of(facts).where("rank = 0").select("event_id", F.col("platform").alias("top_platform"))
    peak = trend.event_time(trend.daily_of(facts))
    return events(s, d).join(top, "event_id").join(peak, "event_id").select("event_id", "title", "heat", "risk_level", "positive", "neutral", "negative", "report_count", "top_platform", "event_time").orderBy(*w_order)


def _weights(s, d):
    """The terms of each document and their idf, written."""
    bags = stash(vectors.term_bags(tokens(s, d), "doc_id"), "bags")
    return bags, stash(vectors.idf(bags.select(F.explode("terms.term").alias("term")), posts(s, d).agg(F.count(F.lit(1)).alias("total")), kept=["df"]), "idf")


def _vectors(s, d, weights=None):
    """Unit vectors of whole texts, a row a document, written."""
    return stash(vectors.bag_vectors(*(weights or _weights(s, d)), "doc_id"), "vectors")


def _assignment(s, d):
    return posts(s, d).select("doc_id", (F.col("doc_id") % 9).alias("cluster_id"))


def _centroids(s, d, rows=None):
    """The mean vectors of the clusters, written; ``rows``: the documents' vectors."""
    rows = _vectors(s, d) if rows is None else rows
    return stash(vectors.centroid_mean(rows, _assignment(s, d)), "centroids")


def _cosines(s, d):
    weights = _weights(s, d)
    rows = _vectors(s, d, weights)
    return vectors.bag_cosines(rows, _centroids(s, d, rows), weights[1], "doc_id", "cluster_id")


def _assigned(s, d):
    """Comments to the centroids of posts, both weighted by the posts' idf."""
    weights = _weights(s, d)
    c = vectors.term_counts(spread(comments(s, d), "comment_id").select("comment_id", tx.tokenize(F.col("content")).alias("tokens")), "comment_id")
    return vectors.assign_nearest(vectors.tfidf_vector(c, weights[1].drop("df"), "comment_id"), _centroids(s, d, _vectors(s, d, weights)), comments(s, d))


def _with_topic(s, d):
    c = _centroids(s, d)
    return c, c.where("cluster_id = 0").select("term", "w")


def _event_texts(s, d, words=None):
    """Title and keywords of each event as bigrams, written."""
    words = keywords(s, d) if words is None else words
    found = report.event_title(posts(s, d)).join(words.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words")), "event_id").select(
        "event_id", tx.char_bigrams(tx.combined_text(F.col("title"), keywords=F.col("words"))).alias("tokens")
    )
    return stash(found, "event-texts")


def _round(df, column="w", places=6):
    return df.withColumn(column, F.round(column, places))


def _detail(s, d, words=None):
    words, facts = keywords(s, d) if words is None else words, _facts(s, d)
    daily = trend.daily_of(facts)
    future = trend.forecast(daily).withColumn("date", F.col("date").cast("string"))
    return lookups.event_detail(trend.heat_of(facts), words, report.platforms_of(facts), daily.withColumn("date", F.col("date").cast("string")), future)


def _detail_flat(s, d):
    x = _detail(s, d)
    return x.select(
        "event_id", "heat",
        F.array_join(F.transform("keywords", lambda k: F.concat(k["word"], F.lit("="), F.format_number(k["weight"], 3))), ";").alias("keywords"),
        F.array_join(F.transform("platforms", lambda k: F.concat(k["platform"], F.lit("="), F.format_number(k["ratio"], 3))), ";").alias("platforms"),
        F.size("trend_daily").cast("long").alias("n_days"), F.array_join(F.transform("trend_daily", lambda t: F.concat(t["date"], F.lit("="), F.format_string("%.1f", t["count"]))), ";").alias("trend_daily"),
    )


def _reasons(s, d):
    """Why each event and its most similar ones are alike: by their titles, keywords and whole contents' first posts."""
    words = keywords(s, d)
    # Only the first posts' texts are cut into words.
    seqs = stash(posts(s, d).groupBy("event_id").agg(F.min("seq").alias("seq")), "first-posts")
    first = posts(s, d).join(seqs, ["event_id", "seq"]).groupBy("event_id").agg(F.min(F.struct("title", "content")).alias("p"))
    found = first.select("event_id", tx.tokenize(F.col("p.title")).alias("title_tokens"), tx.tokenize(F.col("p.content")).alias("content_tokens"))
    t = stash(found.join(words.groupBy("event_id").agg(F.array_sort(F.collect_set("word")).alias("keyword_tokens")), "event_id"), "reasons")
    b = t.select(F.col("event_id").alias("other"), *[F.col(c).alias(f"{c}_b") for c in t.columns[1:]])
    pairs = vectors.similar_events(_event_texts(s, d, words)).select("event_id", "other")
    return lookups.similar_reason(pairs.join(t, "event_id").join(b, "other")).select("event_id", "other", "reason")


def length_rule(batch):
    """Stands in for a pretrained classifier: label and score follow from the length."""
    import pandas as pd

    return pd.DataFrame({"label": ["LABEL_1" if len(t) % 2 else "LABEL_0" for t in batch], "score": [0.5 + (len(t) % 50) / 100 for t in batch]})


def _texts(s, d):
    return spread(posts(s, d).select("doc_id", "event_id", "platform", F.col("content").alias("text")), "doc_id")


def _messages(s, d):
    return lookups.conv_history(table(s, d, "conversations"))


def _filtered_by_index(s, d):
    """As ``list_filter``, by stored indexes of titles and keywords."""
    found, words, path = events(s, d), keywords(s, d), f"{shared_folder(s)}/eventloom-grams-{uuid.uuid4().hex}"
    lookups.save_grams(lookups.grams_of(found, "event_id", "title"), f"{path}/titles")
    lookups.save_grams(lookups.grams_of(words, "word", "word"), f"{path}/words")
    return lookups.list_filter(found, words, None, "tio%n", title_grams=s.read.parquet(f"{path}/titles"), word_grams=s.read.parquet(f"{path}/words")).select("event_id", "title", "risk_level")


def _pending(s, d):
    return lookups.pending_batch(posts(s, d).withColumn("clean_status", F.when(F.col("doc_id") % 3 == 0, "raw").otherwise("enriched"))).select("doc_id", "publish_s")


def _profiles(s, d):
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    prefs = users.where("user_id % 3 = 0").select("user_id", F.array(F.lit("food"), (F.col("user_id") % 7).cast("string")).alias("fields"))
    sources = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 4 == 0, "limited").otherwise("normal").alias("status"))
    return lookups.profile_prefs(users, prefs, sources).withColumn("fields", F.array_join("fields", ","))


def _results(s, d):
    i = F.col("doc_id")
    return posts(s, d).select("platform", F.concat(F.lit("k"), (i % 4).cast("string")).alias("keyword"), F.when(i % 5 == 0, "skip").when(i % 11 == 0, "fail").otherwise("success").alias("status"))


def _labelled(s, d):
    l = table(s, d, "labels")  # noqa: E741
    return l.select(F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"), F.when(F.col("doc_id") % 10 < 7, F.when(F.col("quality") == 1, "positive").otherwise("negative")).otherwise("positive").alias("predicted"), (F.col("doc_id") % 2).alias("kind"))


def _sim_prints(s, d):
    """Fingerprints, written: they are made once, however often they are used."""
    return stash(spread(posts(s, d).select("seq", "event_id", "content"), "seq").select("seq", "event_id", dedup.simhash64(F.col("content")).alias("fingerprint")), "prints")


def _near_pairs(s, d):
    """Pairs of the first rows of each fingerprint, and each copy with its first."""
    prints = _sim_prints(s, d)
    return dedup.near_dup_pairs(prints).unionByName(dedup.copies_of(prints))


def _stored(s, d):
    prints = _sim_prints(s, d)
    return dedup.dedup_store(prints.where("seq % 2 = 1"), prints.where("seq % 2 = 0")).select("seq")


QUERIES = {
    "hot_list": hot_list,
    "platform_dist": lambda s, d: report.platform_dist(posts(s, d)),
    "sources_set": lambda s, d: report.sources_set(posts(s, d).withColumn("event_id", F.col("platform"))).withColumn("sources", F.array_join("sources", ",")),
    "sentiment_dict": lambda s, d: report.sentiment_dict(tokens(s, d), POS, NEG).select("doc_id", "label", F.round("score", 4).alias("score")),
    "sentiment_dist": sentiment,
    "sentiment_route": lambda s, d: ml.sentiment_route(_texts(s, d), POS, NEG, length_rule).select("doc_id", "method", "label"),
    "method_compare": lambda s, d: sentiment(s, d).join(report.sentiment_dist(ml.batch_infer(_texts(s, d), length_rule)).select("event_id", *[F.col(c).alias(f"{c}_b") for c in ("positive", "neutral", "negative")]), "event_id"),
    "authenticity": lambda s, d: report.authenticity(posts(s, d), posts(s, d).groupBy("event_id").agg((F.count_if(F.col("doc_id") % 3 == 0) / F.count(F.lit(1))).alias("dup_rate"))).select(
        "event_id", "credibility_score", "official_ratio", "verified_ratio", "plain_user_ratio", F.array_join("factors", ",").alias("factors"), F.array_join(F.transform(F.map_entries("verification_dist"), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 3))), ",").alias("dist")
    ),
    "event_title": lambda s, d: report.event_title(posts(s, d)),
    "key_nodes": lambda s, d: report.key_nodes(posts(s, d)),
    "top_influencers": lambda s, d: report.top_influencers(posts(s, d)),
    "platform_chain": lambda s, d: report.platform_chain(posts(s, d)),
    "propagation_path": lambda s, d: report.propagation_path(report.key_nodes(posts(s, d)), report.platform_chain(posts(s, d))),
    "summary": lambda s, d: report.summary(posts(s, d), keywords(s, d)),
    "cause": lambda s, d: report.cause(posts(s, d), keywords(s, d)),
    "idf": lambda s, d: _round(_weights(s, d)[1].drop("df"), "idf"),
    "tfidf_vector": lambda s, d: _round(_vectors(s, d).select("doc_id", F.inline("terms"))),
    "tf_relative": lambda s, d: _round(vectors.tf_relative(counts(s, d), "doc_id"), "tf"),
    "doc_keywords": lambda s, d: _round(_doc_keywords(s, d, 5), "score", 4),
    "event_keywords": keywords,
    "centroid_mean": lambda s, d: _round(_centroids(s, d)),
    "cosine_sparse": lambda s, d: _round(_cosines(s, d), "score"),
    "cosine_full": lambda s, d: _round(vectors.cosine_full(_centroids(s, d), "cluster_id"), "score"),
    "similar_events": lambda s, d: vectors.similar_events(_event_texts(s, d)),
    "similar_reason": _reasons,
    "assign_nearest": _assigned,
    "topic_relevance_filter": lambda s, d: vectors.topic_relevance_filter(*_with_topic(s, d), _assignment(s, d).select("cluster_id").distinct(), 0.5),
    "purity": lambda s, d: vectors.purity(posts(s, d), "source", "platform").select(F.round("purity", 6).alias("purity")),
    "comments_of_docs": lambda s, d: lookups.comments_of_docs(comments(s, d), posts(s, d).where("platform = '知乎'")).select("comment_id", "parent_post_id"),
    "event_detail": _detail_flat,
    "list_filter": lambda s, d: lookups.list_filter(events(s, d), keywords(s, d), None, "th").select("event_id", "title", "risk_level"),
    "list_filter_index": _filtered_by_index,
    "list_filter_demo": lambda s, d: lookups.list_filter_demo(events(s, d).withColumns({"category": F.col("event_id"), "location": F.lit(None).cast("string")}), "src1", "high", AS_OF - 2 * DAY).select("event_id", "risk_level"),
    "high_risk": lambda s, d: lookups.high_risk(events(s, d)).select("event_id", "risk_level", "heat", F.col("pos").cast("long").alias("pos")),
    "min_heat": lambda s, d: lookups.min_heat(events(s, d)).select("event_id", "heat"),
    "list_events": lambda s, d: lookups.list_events(events(s, d), keywords(s, d), 2, 6).select("event_id", "heat", "total", "total_pages", F.array_join("keywords", ",").alias("keywords")),
    "conv_history": lambda s, d: _messages(s, d).select("conv_id", F.md5("history").alias("history")),
    "pending_batch": _pending,
    "profile_prefs": _profiles,
    "child_ranks": lambda s, d: keywords(s, d).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w")).select("event_id", F.posexplode("w").alias("rank", "word")),
    "union_files": lambda s, d: lookups.union_all(posts(s, d).select("doc_id", "platform"), comments(s, d).select(F.col("comment_id").alias("doc_id"), "parent_post_id")),
    "union_trend": lambda s, d: lookups.union_trend(trend.daily_trend(posts(s, d)).select("event_id", F.col("date").cast("string").alias("date"), F.col("cnt").cast("double").alias("n")), trend.forecast(trend.daily_trend(posts(s, d))).select("event_id", F.col("date").cast("string").alias("date"), F.col("predict_count").alias("n"))).withColumn("pos", F.col("pos").cast("long")),
    "union_platforms": lambda s, d: lookups.union_all(*[posts(s, d).where(F.col("platform") == p).select("doc_id", "platform") for p in ("微博", "知乎", "人民网")]),
    "run_stats": lambda s, d: lookups.run_stats(_results(s, d)),
    "zero_streaks": lambda s, d: lookups.zero_streaks(posts(s, d).select("platform", F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 50 < 20, 0).otherwise(1).alias("n"))),
    "classif_metrics": lambda s, d: lookups.classif_metrics(_labelled(s, d)),
    "accuracy_by": lambda s, d: lookups.accuracy_by(_labelled(s, d)),
    "near_dup_pairs": _near_pairs,
    "near_dup_greedy": lambda s, d: dedup.near_dup_greedy(_sim_prints(s, d), 3, "event_id").select("seq", "kept"),
    "dedup_store": _stored,
    "comment_dup_count": lambda s, d: dedup.comment_dup_count(_sim_prints(s, d)).select("seq", F.col("duplicate_count").cast("long").alias("duplicate_count")),
    "dedup_url": lambda s, d: dedup.dedup_url(posts(s, d).select("seq", F.concat(F.lit("u"), (F.col("doc_id") % 300).cast("string")).alias("source_url")), posts(s, d).select(F.concat(F.lit("u"), (F.col("doc_id") * 7 % 150).cast("string")).alias("source_url"))),
    "set_difference": lambda s, d: lookups.new_rows(posts(s, d), posts(s, d).where("platform = '微博'"), "source", "platform"),
}

# SQL twins
_T = f"tok AS (SELECT doc_id, event_id, platform, title, {_TOKENS} AS tokens FROM posts)"
_C = "cnt AS (SELECT event_id, doc_id, term, count(*) AS n FROM (SELECT event_id, doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL)"
_E = "evn AS (SELECT event_id, count(*) AS total FROM posts GROUP BY event_id)"
_I = "eidf AS (SELECT event_id, term, ln((total + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM cnt JOIN evn USING (event_id) GROUP BY event_id, term, total)"


def _dk(k):
    return f"dkw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM (SELECT event_id, doc_id, term, n * idf AS score FROM cnt JOIN eidf USING (event_id, term))) WHERE rank <= {k})"


_K = "kw AS (SELECT event_id, term AS word, round(score / max(score) OVER (PARTITION BY event_id), 3) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 6) DESC, term) - 1 AS rank FROM (SELECT event_id, term, sum(score) AS score FROM dkw GROUP BY ALL)) WHERE rank < 8)"
_KW = [_T, _C, _E, _I, _dk(8), _K]


def _lab(name, pos, neg):
    hit = lambda w: f"len(list_filter(tokens, lambda t: regexp_matches(t, '{'|'.join(w)}')))"
    return f"{name} AS (SELECT doc_id, event_id, platform, CASE WHEN p + q > 0 THEN (p - q)::DOUBLE / (p + q) ELSE 0 END AS score, CASE WHEN p > q THEN 'positive' WHEN p < q THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT *, {hit(pos)} AS p, {hit(neg)} AS q FROM tok))"


def _dist(name, of):
    return f"{name} AS (SELECT event_id, " + ", ".join(f"round(count(*) FILTER (label = '{k}') / count(*)::DOUBLE, 3) AS {k}" for k in ("positive", "neutral", "negative")) + f" FROM {of} GROUP BY event_id)"


#: ``length_rule`` with what ``batch_infer`` makes of it.
_MODEL = "CASE WHEN len(content) % 50 < 15 THEN 'neutral' WHEN len(content) % 2 = 1 THEN 'positive' ELSE 'negative' END"
_S = [_T, _lab("lab", POS, NEG), _dist("sent", "lab")]
_TITLE = "titles AS (SELECT event_id, trim(regexp_replace(arg_min(title, (length(trim(title)) = 0, platform NOT IN ('新浪新闻', '澎湃新闻'), length(trim(title)) < 8, length(trim(title)), seq)), 'https?://\\S+', '', 'g')) AS title FROM posts GROUP BY event_id)"
_HEAT = f"heats AS (SELECT event_id, round(sum(exp(-ln(2.0::DOUBLE) * greatest({AS_OF} - publish_s, 0) / 3600.0 / 24)), 3) AS heat, min(publish_s) AS time_start_s, max(publish_s) AS time_end_s, count(*) AS report_count FROM posts GROUP BY event_id)"
_EV = "ev AS (SELECT h.*, s.positive, s.neutral, s.negative, t.title, CASE WHEN heat * (1 + 2 * negative) >= 40 THEN 'high' WHEN heat * (1 + 2 * negative) >= 15 THEN 'mid_high' WHEN heat * (1 + 2 * negative) >= 5 THEN 'mid' ELSE 'low' END AS risk_level FROM heats h JOIN sent s USING (event_id) JOIN titles t USING (event_id))"
_EVENTS = [*_S, _TITLE, _HEAT, _EV]
_PLAT = "plat AS (SELECT event_id, platform, round(n / sum(n) OVER (PARTITION BY event_id), 3) AS ratio, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, platform) - 1 AS rank FROM (SELECT event_id, platform, count(*) AS n FROM posts GROUP BY ALL))"
_PDAYS = """pdays AS (SELECT event_id, publish_s // 86400 AS day, count(*) AS cnt FROM posts GROUP BY ALL),
pdaily AS (SELECT g.event_id, g.day - g.first AS ix, (DATE '1970-01-01' + g.day::INTEGER) AS date, coalesce(cnt, 0) AS cnt FROM (SELECT event_id, min(day) AS first, unnest(range(min(day), max(day) + 1)) AS day FROM pdays GROUP BY event_id) g LEFT JOIN pdays d ON g.event_id = d.event_id AND g.day = d.day),
pfut AS (SELECT event_id, (last_date + step::INTEGER) AS date, round(greatest(0, latest + (latest - oldest)::DOUBLE / greatest(n - 1, 1) * step), 1) AS predict_count FROM (SELECT event_id, max(date) AS last_date, arg_max(cnt, ix) AS latest, arg_min(cnt, ix) AS oldest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ix DESC) AS rn FROM pdaily) WHERE rn <= 3 GROUP BY event_id), range(1, 4) t(step))"""
_PTIME = "ptime AS (SELECT event_id, arg_min(date, (-cnt, ix))::VARCHAR || 'T12:00:00' AS event_time FROM pdaily GROUP BY event_id)"
_INF = "repost_count * 1.0::DOUBLE + comment_count * 0.5::DOUBLE + like_count * 0.3::DOUBLE"
_NODES = f"""rows AS (SELECT *, coalesce(verification_type, '普通用户') AS tier, {_INF} AS influence, left(CASE WHEN title = '' THEN content ELSE title END, 40) AS snippet FROM posts),
picked AS (SELECT event_id, coalesce(arg_min(seq, (publish_s, seq)) FILTER (tier = '普通用户'), arg_min(seq, (publish_s, seq))) AS r0, arg_min(seq, (publish_s, seq)) FILTER (tier IN ('头部认证个人', '认证机构')) AS r1,
  arg_min(seq, (publish_s, seq)) FILTER (tier IN ('官方平台', '官方机构')) AS r2, arg_min(seq, (-influence, seq)) FILTER (influence > 0) AS r3 FROM rows GROUP BY event_id),
roles AS (SELECT event_id, seq, min(pr) AS pr FROM (SELECT event_id, unnest([r0, r1, r2, r3]) AS seq, unnest([1, 2, 3, 4]) AS pr FROM picked) WHERE seq IS NOT NULL GROUP BY ALL),
nodes AS (SELECT r.event_id, row_number() OVER (PARTITION BY r.event_id ORDER BY publish_s, pr) - 1 AS pos, ['初始爆料', '首次大V发声', '首次官方媒体介入', '传播高峰'][pr] AS role, doc_id, CASE WHEN author = '' THEN '匿名' ELSE author END AS author, platform, tier AS verification_type, publish_s, round(influence, 1) AS influence, snippet FROM roles r JOIN rows USING (event_id, seq))"""
_PATH = """named AS (SELECT *, role || ' · ' || CASE WHEN author <> '匿名' THEN author ELSE platform END AS name FROM nodes)"""
_GC = "gcnt AS (SELECT doc_id, term, sum(n) AS n FROM cnt GROUP BY ALL)"
_GI = "gidf AS (SELECT term, ln(((SELECT count(*) FROM posts) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM gcnt GROUP BY term)"
_V = "vec AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term, n * idf AS raw FROM gcnt JOIN gidf USING (term)))"
_CEN = "cen AS (SELECT cluster_id, term, sum(w) / any_value(size) AS w FROM (SELECT *, doc_id % 9 AS cluster_id FROM vec) JOIN (SELECT doc_id % 9 AS cluster_id, count(*) AS size FROM posts GROUP BY 1) USING (cluster_id) GROUP BY ALL)"
_VEC = [_T, _C, _GC, _GI, _V]
_WORDS = "words AS (SELECT event_id, list(word ORDER BY rank) AS words FROM kw GROUP BY event_id)"
_SIM = [
    *_KW, _WORDS, _TITLE,
    "st AS (SELECT event_id, trim(title || ' ' || array_to_string(words, ' ')) AS t FROM titles JOIN words USING (event_id))",
    "sc AS (SELECT event_id, term, count(*) AS n FROM (SELECT event_id, unnest(list_transform(range(1, len(t)), lambda i: substr(t, i, 2))) AS term FROM st) GROUP BY ALL)",
    "si AS (SELECT term, ln(((SELECT count(*) FROM st) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM sc GROUP BY term)",
    "sw AS (SELECT event_id, term, n / sum(n) OVER (PARTITION BY event_id) * idf AS w FROM sc JOIN si USING (term))",
    "sunit AS (SELECT event_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w FROM sw)",
    "sim AS (SELECT event_id, other, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, other) AS rank FROM (SELECT a.event_id, b.event_id AS other, round(sum(a.w * b.w), 4) AS score FROM sunit a JOIN sunit b ON a.term = b.term AND a.event_id <> b.event_id GROUP BY ALL) WHERE score > 0) WHERE rank <= 5)",
]
_SENTS = "list_filter(list_transform(regexp_split_to_array({}, '[。！？!?；;\\n]+'), lambda s: trim(s)), lambda s: len(s) >= 6)"

ORACLE = {
    "hot_list": sql(["posts"], "SELECT e.event_id, title, heat, risk_level, positive, neutral, negative, report_count, p.platform AS top_platform, event_time FROM ev e JOIN plat p ON e.event_id = p.event_id AND p.rank = 0 JOIN ptime t ON t.event_id = e.event_id", *_EVENTS, _PLAT, _PDAYS, _PTIME),
    "platform_dist": sql(["posts"], "SELECT * FROM plat", _PLAT),
    "sources_set": sql(["posts"], "SELECT platform AS event_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM posts GROUP BY platform"),
    "sentiment_dict": sql(["posts"], "SELECT doc_id, label, round(score, 4) AS score FROM lab", *_S),
    "sentiment_dist": sql(["posts"], "SELECT * FROM sent", *_S),
    "sentiment_route": sql(["posts"], f"SELECT doc_id, CASE WHEN l.platform IN ('新浪新闻', '澎湃新闻') THEN 'dict' ELSE 'model' END AS method, CASE WHEN l.platform IN ('新浪新闻', '澎湃新闻') THEN label ELSE {_MODEL} END AS label FROM lab l JOIN posts p USING (doc_id)", *_S),
    "method_compare": sql(["posts"], "SELECT a.*, b.positive AS positive_b, b.neutral AS neutral_b, b.negative AS negative_b FROM sent a JOIN sent2 b USING (event_id)", *_S, f"lab2 AS (SELECT event_id, {_MODEL} AS label FROM posts)", _dist("sent2", "lab2")),
    "authenticity": sql(
        ["posts"],
        """SELECT event_id, round(greatest(0, least(1, raw * (1 - 0.3::DOUBLE * dup))), 3) AS credibility_score, o AS official_ratio, v AS verified_ratio, pl AS plain_user_ratio,
 array_to_string(list_filter([CASE WHEN o < 0.10 THEN 'official_absent' END, CASE WHEN pl > 0.70 THEN 'mostly_unverified' END, CASE WHEN dup > 0.30 THEN 'high_duplicate_rate' END, CASE WHEN v > 0.5 AND o > 0.2 THEN 'well_sourced' END], lambda x: x IS NOT NULL), ',') AS factors, dist
 FROM (SELECT event_id, sum(w * n) / sum(n) AS raw, sum(d3) / sum(n) AS dup, round(sum(CASE WHEN tier IN ('官方平台', '官方机构') THEN n ELSE 0 END) / sum(n), 3) AS o, round(sum(CASE WHEN tier <> '普通用户' THEN n ELSE 0 END) / sum(n), 3) AS v,
 round(sum(CASE WHEN tier = '普通用户' THEN n ELSE 0 END) / sum(n), 3) AS pl, string_agg(tier || '=' || format('{:.3f}', round(n / t, 3)), ',' ORDER BY tier) AS dist
 FROM (SELECT *, sum(n) OVER (PARTITION BY event_id)::DOUBLE AS t, CASE tier WHEN '官方平台' THEN 1.0::DOUBLE WHEN '官方机构' THEN 1.0 WHEN '认证机构' THEN 0.75 WHEN '头部认证个人' THEN 0.5 WHEN '认证个人' THEN 0.3 ELSE 0.1 END AS w FROM (SELECT event_id, coalesce(verification_type, '普通用户') AS tier, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS d3 FROM posts GROUP BY ALL)) GROUP BY event_id)""",
    ),
    "event_title": sql(["posts"], "SELECT * FROM titles", _TITLE),
    "key_nodes": sql(["posts"], "SELECT * FROM nodes", _NODES),
    "top_influencers": sql(["posts"], f"SELECT event_id, rank, doc_id, CASE WHEN author = '' THEN '匿名' ELSE author END AS author, platform, round(influence, 1) AS influence FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY influence DESC, seq) AS rank FROM (SELECT *, {_INF} AS influence FROM posts) WHERE influence > 0) WHERE rank <= 5"),
    "platform_chain": sql(["posts"], "SELECT event_id, platform, count, first_seen_s, row_number() OVER w - 1 AS pos, lead(platform) OVER w AS target, lead(count) OVER w AS value FROM (SELECT event_id, platform, count(*) AS count, min(publish_s) AS first_seen_s, min((publish_s, seq)) AS f FROM posts GROUP BY event_id, platform) WINDOW w AS (PARTITION BY event_id ORDER BY f)"),
    "propagation_path": sql(["posts"], """SELECT event_id, pos, name, (CASE WHEN role = '初始爆料' THEN 0 WHEN role = '传播高峰' THEN 3 WHEN role = '首次大V发声' THEN 1 ELSE 2 END)::BIGINT AS category,
 round(CASE WHEN influence <= 0 THEN greatest(34.0::DOUBLE, 48 - pos * 2) ELSE least(72.0::DOUBLE, greatest(38.0::DOUBLE, 34 + sqrt(influence))) END, 4) AS size, lead(name) OVER (PARTITION BY event_id ORDER BY pos) AS target FROM named""", _NODES, _PATH),
    "summary": sql(["posts"], f"""SELECT event_id, CASE WHEN len(s) > 0 THEN array_to_string(s[1:3], '。') || '。' ELSE b.title END AS summary FROM (SELECT event_id, b, CASE WHEN len({_SENTS.format('b.content')}) > 0 THEN {_SENTS.format('b.content')} ELSE {_SENTS.format('b.title')} END AS s
 FROM (SELECT event_id, arg_max({{'title': title, 'content': content}}, (platform IN ('新浪新闻', '澎湃新闻'), len(list_filter(words, lambda k: contains(left(title || '。' || content, 300), k))), length(content), -seq)) AS b FROM posts JOIN words USING (event_id) GROUP BY event_id))""", *_KW, _WORDS),
    "cause": sql(["posts"], f"""SELECT event_id, coalesce(CASE WHEN any_art THEN of_art ELSE of_all END || '。', e.s || '。', e.t) AS cause FROM (SELECT event_id, bool_or(art) AS any_art, arg_min(fit, (publish_s, seq)) FILTER (art AND fit IS NOT NULL) AS of_art, arg_min(fit, (publish_s, seq)) FILTER (fit IS NOT NULL) AS of_all, arg_min({{'s': coalesce(sents[1], tsents[1]), 't': title}}, (publish_s, seq)) AS e
 FROM (SELECT *, list_filter(sents[1:2], lambda s: len(s) >= 12 AND len(list_filter(words, lambda k: contains(s, k))) > 0)[1] AS fit FROM (SELECT *, platform IN ('新浪新闻', '澎湃新闻') AS art, {_SENTS.format('content')} AS sents, {_SENTS.format('title')} AS tsents FROM posts JOIN words USING (event_id))) GROUP BY event_id)""", *_KW, _WORDS),
    "idf": sql(["posts"], "SELECT term, round(idf, 6) AS idf FROM gidf", *_VEC),
    "tfidf_vector": sql(["posts"], "SELECT doc_id, term, round(w, 6) AS w FROM vec", *_VEC),
    "tf_relative": sql(["posts"], "SELECT doc_id, term, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS tf FROM gcnt", _T, _C, _GC),
    "doc_keywords": sql(["posts"], "SELECT event_id, doc_id, term, round(score, 4) AS score, rank FROM dkw", _T, _C, _E, _I, _dk(5)),
    "event_keywords": sql(["posts"], "SELECT * FROM kw", *_KW),
    "centroid_mean": sql(["posts"], "SELECT cluster_id, term, round(w, 6) AS w FROM cen", *_VEC, _CEN),
    "cosine_sparse": sql(["posts"], "SELECT doc_id, cluster_id, round(sum(v.w * c.w), 6) AS score FROM vec v JOIN cen c USING (term) GROUP BY ALL", *_VEC, _CEN),
    "cosine_full": sql(["posts"], "SELECT a.cluster_id, b.cluster_id AS other, round(sum(a.w * b.w), 6) AS score FROM unit a JOIN unit b ON a.term = b.term AND a.cluster_id <> b.cluster_id GROUP BY ALL", *_VEC, _CEN, "unit AS (SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)) AS w FROM cen)"),
    "similar_events": sql(["posts"], "SELECT * FROM sim", *_SIM),
    "similar_reason": sql(
        ["posts"],
        "SELECT event_id, other, CASE WHEN r = '' THEN '文本特征相似' ELSE r || '相似' END AS reason FROM (SELECT sim.event_id, sim.other, concat_ws('、', CASE WHEN list_has_any(a.x, b.x) THEN '标题' END, CASE WHEN list_has_any(a.words, b.words) THEN '关键词' END, CASE WHEN list_has_any(a.z, b.z) THEN '内容' END) AS r FROM sim JOIN ef a ON a.event_id = sim.event_id JOIN ef b ON b.event_id = sim.other)",
        *_SIM,
        f"ef AS (SELECT * FROM (SELECT event_id, arg_min({_TOKENS.replace('content', 'title')}, seq) AS x, arg_min({_TOKENS}, seq) AS z FROM posts GROUP BY event_id) JOIN words USING (event_id))",
    ),
    "assign_nearest": sql(
        ["posts", "comments"],
        "SELECT comment_id, coalesce(arg_min(cluster_id, (-round(score, 9), cluster_id)) FILTER (score IS NOT NULL), 0)::BIGINT AS cluster_id FROM comments LEFT JOIN (SELECT comment_id, cluster_id, sum(v.w * c.w) AS score FROM cvec v JOIN cen c USING (term) GROUP BY ALL) USING (comment_id) GROUP BY comment_id",
        *_VEC, _CEN,
        f"ccnt AS (SELECT comment_id, term, count(*) AS n FROM (SELECT comment_id, unnest({_TOKENS}) AS term FROM comments) GROUP BY ALL)",
        "cvec AS (SELECT comment_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY comment_id)) AS w FROM (SELECT comment_id, term, n * idf AS raw FROM ccnt JOIN gidf USING (term)))",
    ),
    "topic_relevance_filter": sql(["posts"], "SELECT cluster_id, round(score, 4) AS score, score >= 0.5 AS relevant FROM (SELECT a.cluster_id, sum(a.w * b.w) AS score FROM cen a JOIN cen b ON a.term = b.term AND b.cluster_id = 0 GROUP BY a.cluster_id)", *_VEC, _CEN),
    "purity": sql(["posts"], "SELECT round(sum(m) / sum(s), 6) AS purity FROM (SELECT source, max(n) AS m, sum(n) AS s FROM (SELECT source, platform, count(*) AS n FROM posts GROUP BY ALL) GROUP BY source)"),
    "comments_of_docs": sql(["posts", "comments"], "SELECT comment_id, parent_post_id FROM comments WHERE parent_post_id IN (SELECT doc_id FROM posts WHERE platform = '知乎')"),
    "event_detail": sql(
        ["posts"],
        """SELECT h.event_id, heat, k.keywords, p.platforms, t.n_days, t.trend_daily FROM heats h LEFT JOIN (SELECT event_id, string_agg(word || '=' || format('{:.3f}', weight), ';' ORDER BY rank) AS keywords FROM kw GROUP BY 1) k USING (event_id)
 LEFT JOIN (SELECT event_id, string_agg(platform || '=' || format('{:.3f}', ratio), ';' ORDER BY rank) AS platforms FROM plat GROUP BY 1) p USING (event_id)
 LEFT JOIN (SELECT event_id, count(*) AS n_days, string_agg(date::VARCHAR || '=' || format('{:.1f}', c), ';' ORDER BY f, date) AS trend_daily FROM (SELECT event_id, date, cnt::DOUBLE AS c, false AS f FROM pdaily UNION ALL SELECT event_id, date, predict_count, true FROM pfut) GROUP BY 1) t USING (event_id)""",
        *_KW, _HEAT, _PLAT, _PDAYS,
    ),
    "list_filter_index": sql(["posts"], "SELECT event_id, title, risk_level FROM ev WHERE title LIKE '%tio%n%' OR event_id IN (SELECT event_id FROM kw WHERE word LIKE '%tio%n%')", *_EVENTS, _C, _E, _I, _dk(8), _K),
    "list_filter": sql(["posts"], "SELECT event_id, title, risk_level FROM ev WHERE title LIKE '%th%' OR event_id IN (SELECT event_id FROM kw WHERE word LIKE '%th%')", *_EVENTS, _C, _E, _I, _dk(8), _K),
    "list_filter_demo": sql(["posts"], f"SELECT event_id, risk_level FROM ev WHERE (contains(title, 'src1') OR contains(event_id, 'src1')) AND risk_level IN ('high', 'mid_high') AND time_end_s >= {AS_OF - 2 * DAY}", *_EVENTS),
    "high_risk": sql(["posts"], "SELECT event_id, risk_level, heat, row_number() OVER (ORDER BY CASE WHEN risk_level = 'high' THEN 0 ELSE 1 END, heat DESC, event_id) AS pos FROM ev WHERE risk_level IN ('high', 'mid_high')", *_EVENTS),
    "min_heat": sql(["posts"], "SELECT event_id, heat FROM ev WHERE heat >= 5", *_EVENTS),
    "list_events": sql(["posts"], "SELECT event_id, heat, (SELECT count(*) FROM ev) AS total, ceil((SELECT count(*) FROM ev) / 6.0)::BIGINT AS total_pages, (SELECT string_agg(word, ',' ORDER BY rank) FROM kw WHERE kw.event_id = e.event_id AND rank < 8) AS keywords FROM (SELECT * FROM ev ORDER BY heat DESC NULLS LAST, event_id LIMIT 6 OFFSET 6) e", *_EVENTS, _C, _E, _I, _dk(8), _K),
    "conv_history": "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS history FROM conversations GROUP BY conv_id",
    "pending_batch": sql(["posts"], "SELECT doc_id, publish_s FROM posts WHERE doc_id % 3 = 0 ORDER BY publish_s, doc_id LIMIT 100"),
    "profile_prefs": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'food,' || (c_custkey % 7)::VARCHAR ELSE '' END AS fields, count(o_orderkey) FILTER (o_orderkey % 4 <> 0) AS n_normal, count(o_orderkey) FILTER (o_orderkey % 4 = 0) AS n_limited, count(o_orderkey) AS n_sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "child_ranks": sql(["posts"], "SELECT event_id, rank::BIGINT AS rank, word FROM kw", *_KW),
    "union_files": sql(["posts", "comments"], "SELECT doc_id, platform, NULL::BIGINT AS parent_post_id FROM posts UNION ALL SELECT comment_id, NULL, parent_post_id FROM comments"),
    "union_trend": sql(["posts"], "SELECT event_id, date::VARCHAR AS date, n, is_predicted, row_number() OVER (PARTITION BY event_id ORDER BY is_predicted, date) AS pos FROM (SELECT event_id, date, cnt::DOUBLE AS n, false AS is_predicted FROM pdaily UNION ALL SELECT event_id, date, predict_count, true FROM pfut)", _PDAYS),
    "union_platforms": sql(["posts"], "SELECT doc_id, platform FROM posts WHERE platform IN ('微博', '知乎', '人民网')"),
    "run_stats": "SELECT platform, keyword, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skip') AS skip, count(*) FILTER (status = 'fail') AS fail, grouping_id(platform, keyword)::BIGINT AS level FROM (" + sql(["posts"], "SELECT platform, 'k' || (doc_id % 4)::VARCHAR AS keyword, CASE WHEN doc_id % 5 = 0 THEN 'skip' WHEN doc_id % 11 = 0 THEN 'fail' ELSE 'success' END AS status FROM posts") + ") GROUP BY ROLLUP (platform, keyword)",
    "zero_streaks": sql(["posts"], "SELECT platform, pos, streak FROM (SELECT platform, pos, row_number() OVER (PARTITION BY platform, g ORDER BY pos) AS streak FROM (SELECT platform, doc_id AS pos, doc_id % 50 < 20 AS z, sum(CASE WHEN doc_id % 50 < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY platform ORDER BY doc_id) AS g FROM posts) WHERE z) WHERE streak >= 3"),
    "classif_metrics": """WITH x AS (SELECT quality = 1 AS y, CASE WHEN doc_id % 10 < 7 THEN quality = 1 ELSE true END AS p FROM labels), m AS (SELECT l, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS pred, count(*) FILTER (y = l AND p = l) AS hit FROM x, (VALUES (true), (false)) t(l) GROUP BY l),
 r AS (SELECT *, CASE WHEN pred > 0 THEN hit / pred::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS rc FROM m) SELECT CASE WHEN l THEN 'positive' ELSE 'negative' END AS label, support, round(pr, 4) AS precision, round(rc, 4) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 4) AS f1, round((SELECT count(*) FILTER (y = p) / count(*)::DOUBLE FROM x), 4) AS accuracy FROM r""",
    "accuracy_by": "SELECT doc_id % 2 AS kind, round(avg(CASE WHEN doc_id % 10 < 7 OR quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM labels GROUP BY 1",
    "dedup_url": "SELECT min(doc_id) AS seq, 'u' || (doc_id % 300)::VARCHAR AS source_url FROM documents WHERE doc_id % 300 NOT IN (SELECT doc_id * 7 % 150 FROM documents) GROUP BY doc_id % 300",
    "set_difference": sql(["posts"], "SELECT source, platform FROM posts EXCEPT SELECT source, platform FROM posts WHERE platform = '微博'"),
}
