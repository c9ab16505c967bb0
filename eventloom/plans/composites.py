"""Registered composite jobs: clustering, whole reports, briefs, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import values as vl
from ..operators import cluster, dedup, entities, lookups, ml, report, trend, vectors
from ..sources import sinks
from ..sources.tables import shared_folder, spread, stash
from ..sources.views import AS_OF, SPAN, START, activity, comments, posts, sql, table
from ..streaming import jobs
from . import events as ev
from .scalars import _TOKENS
from .trends import BUCKETS, DAILY, STAGE


def _docs(s, d):
    return spread(posts(s, d).select("doc_id", "seq", "publish_s", "event_id", "content"), "doc_id").withColumn("tokens", tx.tokenize(F.col("content"))).drop("content")


def analyze_events(posts_: DataFrame, as_of: int, positive: list[str], negative: list[str], gazetteer: DataFrame, k: int = 3, days: float = 45, introducers: list[str] = (), surnames: str = "", translit: str = "") -> DataFrame:
    """One nested row an event: counts, heat, risk, sentiment, keywords, platforms, credibility, trend, lifecycle, propagation, extracts, places and people.

    ``posts_``: the columns of the posts view; ``gazetteer``: word, tag. Near duplicates within an event are dropped
    first; timelines use the recent window, the rest all kept posts.
    """
    prints = stash(spread(posts_, "seq").withColumn("fingerprint", dedup.simhash64(F.concat("title", "content"))), "printed")
    marked = stash(dedup.near_dup_greedy(prints, k, "event_id"), "analysed")
    kept = marked.where("kept").drop("kept", "fingerprint")
    sizes = marked.groupBy("event_id").agg(F.count_if("kept").alias("report_count"), F.count_if(~F.col("kept")).alias("duplicate_count"))
    # Texts are cut once: terms and the words of sentiment are counted in one pass.
    tokens = kept.select("event_id", "doc_id", tx.tokenize(F.concat_ws(" ", "title", "content")).alias("tokens"))
    bags = stash(vectors.term_bags(tokens, "event_id", "doc_id", hits={"pos": positive, "neg": negative}), "bags")
    totals = kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("total"))
    words = stash(vectors.event_keywords(vectors.bag_keywords(bags, totals)), "keywords")
    recent = trend.recent_window(kept, days)
    daily = stash(trend.daily_trend(recent), "daily")
    buckets = stash(trend.bucket_counts(recent), "buckets")
    life = trend.lifecycle_proba(trend.lifecycle_stage(buckets))
    named = stash(entities.entity_counts(recent, gazetteer, introducers, surnames), "entities")
    points = trend.changepoints(buckets).join(buckets, ["event_id", "ix"])

    def rows(df, name, *columns):
        return df.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    parts = [
        trend.heat(kept, as_of), report.sentiment_dist(report.sentiment_of(bags)), report.event_title(kept), report.sources_set(kept), trend.time_span(recent), trend.event_time(daily),
        report.authenticity(kept, sizes.select("event_id", vl.duplicate_rate(F.col("duplicate_count"), F.col("report_count")).alias("dup_rate"))), life,
        rows(words, "keywords", "rank", "word", "weight"), rows(report.platform_dist(kept), "platform_distribution", "rank", "platform", "ratio"), rows(daily, "trend", "ix", "date", "cnt"), rows(trend.forecast(daily), "future_trend", "step", "date", "predict_count"),
        rows(points, "key_timepoints", "ix", "start_s"), rows(report.key_nodes(recent), "key_nodes", "pos", "role", "doc_id", "influence"), rows(report.top_influencers(recent), "top_influencers", "rank", "author", "influence"), rows(report.platform_chain(recent), "platform_chain", "pos", "platform", "count", "target"),
        report.summary(recent, words), report.cause(recent, words), entities.location(named), entities.people(named, surnames=surnames, translit=translit, keywords=words),
    ]
    out = sizes
    for part in parts:
        out = out.join(part, "event_id", "left")
    out = out.withColumns({"risk_level": vl.risk_level(F.col("heat"), F.col("negative")), "people": F.coalesce("people", F.array().cast("array<string>"))})
    return stash(out, "reports")


def group_reports(posts_: DataFrame, *args, **options) -> DataFrame:
    """The reports of all events, the hottest first."""
    return analyze_events(posts_, *args, **options).orderBy(F.desc("heat"), "event_id")


def two_stage(posts_: DataFrame, comments_: DataFrame, threshold: float, as_of: int, positive, negative, gazetteer: DataFrame, refresh_risk: bool = False) -> DataFrame:
    """Posts to clusters, comments to the nearest, then reports; sentiment is the comments' where there are any.

    The risk level stays that of the posts' sentiment unless ``refresh_risk``.
    """
    # Posts are cut into words once; their idf weighs the comments too.
    tokens = spread(posts_.select("seq", "publish_s", "content"), "seq").select("seq", "publish_s", tx.tokenize(F.col("content")).alias("tokens"))
    assigned, centroids, ids = cluster.single_pass_idf(tokens, threshold)
    centroids = stash(centroids, "centroids")
    named = posts_.drop("event_id").join(assigned.select("seq", F.concat(F.lit("cluster-"), F.col("cluster_id").cast("string")).alias("event_id")), "seq")
    ctok = stash(spread(comments_, "comment_id").select("comment_id", tx.tokenize(F.col("content")).alias("tokens")), "stage-comments")
    nearest = cluster.assign_nearest(stash(vectors.term_bags(ctok, "comment_id"), "comment-bags"), ids, centroids, ctok)
    by_event = ctok.join(stash(nearest, "nearest"), "comment_id").withColumn("event_id", F.concat(F.lit("cluster-"), F.col("cluster_id").cast("string")))
    labelled = report.sentiment_dict(by_event, positive, negative)
    theirs = report.sentiment_dist(labelled).select("event_id", *[F.col(c).alias(f"c_{c}") for c in ("positive", "neutral", "negative")])
    n = by_event.groupBy("event_id").agg(F.count(F.lit(1)).alias("comment_count"))
    out = analyze_events(named, as_of, positive, negative, gazetteer).join(theirs, "event_id", "left").join(n, "event_id", "left")
    out = out.withColumns({c: F.coalesce(f"c_{c}", c) for c in ("positive", "neutral", "negative")} | {"comment_count": F.coalesce("comment_count", F.lit(0))}).drop("c_positive", "c_neutral", "c_negative")
    return out.withColumn("risk_level", vl.risk_level(F.col("heat"), F.col("negative"))) if refresh_risk else out


def dashboard_brief(events: DataFrame, size: int = 10) -> DataFrame:
    """The brief's lines: totals, the hottest events, those of high risk, and a conclusion."""
    total = events.count()
    order = [F.desc("heat"), F.asc("event_id")]
    # So many rows at most are numbered in one place.
    page = stash(events.orderBy(*order).limit(size), "page")
    w = Window.orderBy(*order)
    page = page.withColumn("pos", F.row_number().over(w))
    hot = page.select(F.lit("hot").alias("section"), "pos", F.format_string("%d. %s heat %.1f", "pos", "event_id", "heat").alias("line"))
    risky = page.where(F.col("risk_level").isin("high", "mid_high")).withColumn("pos", F.row_number().over(w)).where("pos <= 8").select(F.lit("risk").alias("section"), "pos", F.concat_ws(" ", "event_id", "risk_level").alias("line"))
    n = page.agg(F.count_if(F.col("risk_level").isin("high", "mid_high")).alias("n"), F.count(F.lit(1)).alias("m"))
    head = n.select(F.lit("total").alias("section"), F.lit(0).alias("pos"), F.format_string(f"{total} events, %d of %d at high risk", "n", "m").alias("line"))
    return hot.unionByName(risky).unionByName(head)


def fact_sheet(detail: DataFrame) -> DataFrame:
    """event_id, facts: one block of text an event; blanks are skipped."""
    words = F.array_join(F.transform(F.slice("keywords", 1, 12), lambda k: k["word"]), "、")
    platforms = F.array_join(F.transform(F.slice("platforms", 1, 8), lambda p: F.concat(p["platform"], F.lit(" "), F.format_number(vl.percent_norm(p["ratio"]), 1), F.lit("%"))), "、")
    last = F.slice("trend_daily", F.greatest(F.size("trend_daily") - 9, F.lit(1)), 10)
    days = F.array_join(F.transform(last, lambda t: F.concat(t["date"], F.lit(":"), F.format_number(t["count"], 1))), ", ")
    lines = [F.when(F.length(x) > 0, F.concat(F.lit(f"{label}: "), x)) for label, x in (("heat", F.format_number("heat", 3)), ("keywords", words), ("platforms", platforms), ("trend", days))]
    return detail.select("event_id", F.concat_ws("\n", *lines).alias("facts"))


def event_brief(detail: DataFrame, nodes: DataFrame, influencers: DataFrame, chain: DataFrame) -> DataFrame:
    """event_id, section, pos, line: up to five key nodes, three influencers and the path of platforms."""
    a = nodes.where("pos < 5").select("event_id", F.lit("node").alias("section"), "pos", F.concat_ws(" ", "role", "author", "platform").alias("line"))
    b = influencers.where("rank <= 3").select("event_id", F.lit("influencer").alias("section"), F.col("rank").alias("pos"), F.concat_ws(" ", "author", F.format_number("influence", 1)).alias("line"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "platform"))), lambda x: x["platform"]), " → ")
    c = chain.groupBy("event_id").agg(path.alias("line")).select("event_id", F.lit("path").alias("section"), F.lit(0).alias("pos"), "line")
    m = detail.select("event_id", F.lit("heat").alias("section"), F.lit(0).alias("pos"), F.format_number("heat", 3).alias("line"))
    return a.unionByName(b).unionByName(c).unionByName(m)


def advice_prompt(facts: DataFrame, similar: DataFrame) -> DataFrame:
    """event_id, prompt: the event's facts and its three most similar events."""
    near = similar.where("rank <= 3").groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ", ").alias("near"))
    return facts.join(near, "event_id", "left").select("event_id", F.concat_ws("\n", "facts", F.concat(F.lit("similar: "), F.coalesce("near", F.lit("none")))).alias("prompt"))


def _lifecycle_block(s, d):
    a = activity(s, d)
    buckets = trend.bucket_counts(a)
    n = trend.changepoints(buckets).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_points"))
    last = trend.forecast(trend.daily_trend(a)).where("step = 3").select("event_id", "predict_count")
    return trend.lifecycle_stage(buckets).select("event_id", "stage").join(n, "event_id", "left").join(last, "event_id").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def _gazetteer(s, d):
    """The commonest words of the titles, tagged by a hash, as a gazetteer."""
    words = posts(s, d).select(F.explode(tx.tokenize(F.col("title"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    tag = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("long") % 3
    return words.select("word", F.when(tag == 0, "person").when(tag == 1, "place").otherwise("org").alias("tag"))


def _entities(s, d):
    """Of titles and the first 500 characters, as in the SQL; whole reports read whole texts."""
    return entities.entity_counts(posts(s, d), _gazetteer(s, d), ["the"], chars=500)


def _segments(s, d):
    """Whole texts by the short words of the titles."""
    lexicon = posts(s, d).select(F.explode(tx.tokenize(F.col("title"))).alias("word")).where("length(word) <= 5").distinct()
    return entities.dict_segment(spread(posts(s, d).select("doc_id", F.col("content").alias("text")), "doc_id"), stash(lexicon, "lexicon"))


def _single_pass(s, d):
    assigned, _ = cluster.single_pass(_docs(s, d), 0.04)
    return assigned


def _two_stage(s, d):
    return two_stage(posts(s, d), comments(s, d), 0.04, AS_OF, ev.POS, ev.NEG, stash(_gazetteer(s, d), "gazetteer")).select("event_id", "report_count", "duplicate_count", "comment_count", "heat", "risk_level", "positive", "neutral", "negative", "stage", "title")


def _analysis(s, d):
    return analyze_events(posts(s, d), AS_OF, ev.POS, ev.NEG, stash(_gazetteer(s, d), "gazetteer"), introducers=["the"])


def _grouped(s, d):
    out = group_reports(posts(s, d), AS_OF, ev.POS, ev.NEG, stash(_gazetteer(s, d), "gazetteer"), introducers=["the"])
    return out.select("event_id", "heat", "risk_level", "report_count", "duplicate_count", "title", "stage", "location", F.array_join("people", ",").alias("people"), "summary", "cause")


def _labelled_posts(s, d):
    return posts(s, d).join(table(s, d, "labels"), "doc_id").select("doc_id", "platform", F.col("content").alias("text"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))


def _model_store(s, d):
    """A store with a model for comments, trained on the labelled social posts."""
    folder = f"{shared_folder(s)}/eventloom-models-{uuid.uuid4().hex}"
    kind, model, scores = ml.train_and_choose(_labelled_posts(s, d).where(vl.text_type(F.col("platform")) != "article").drop("platform"))
    ml.save_model(model, s, folder, "comment")
    return folder, kind, scores


def _train_scores(s, d):
    """Both models' held-out accuracy on social posts, and which one went into the store."""
    folder, best, scores = _model_store(s, d)
    path, _ = ml.newest_model(s, folder, "comment")
    return s.createDataFrame([(k, round(v, 4), k == best, path.split("/")[-1] if k == best else None) for k, v in sorted(scores.items())], "kind string, accuracy double, chosen boolean, stored string")


def _raw(s, d):
    """Posts appended to a table by platform, and read again."""
    path = f"{shared_folder(s)}/eventloom-raw-{uuid.uuid4().hex}"
    sinks.save_raw(posts(s, d).select("doc_id", "platform", "content", "publish_s"), path, "platform")
    return s.read.parquet(path).select("doc_id", "platform", F.md5("content").alias("content"), "publish_s")


def _json(s, d):
    """Events written as JSON, and read again."""
    path = f"{shared_folder(s)}/eventloom-json-{uuid.uuid4().hex}"
    sinks.save_json(trend.heat(posts(s, d), AS_OF).join(ev.keywords(s, d).groupBy("event_id").agg(F.sort_array(F.collect_set("word")).alias("words")), "event_id"), path)
    return s.read.schema("event_id string, heat double, words array<string>").json(path).withColumn("words", F.array_join("words", ","))


def _trained(s, d):
    """All posts by the newest stored model for their kind of text; that for comments stands in for articles."""
    folder, _, _ = _model_store(s, d)
    return ml.predict_stored(folder, spread(posts(s, d).select("doc_id", F.col("content").alias("text")), "doc_id")).select("doc_id", "label", F.round("p_positive", 4).alias("p_positive"))


def _domain_shift(s, d):
    """The model for comments on labelled social posts, which it was trained on, and on articles."""
    folder, _, _ = _model_store(s, d)
    rows, article = _labelled_posts(s, d), vl.text_type(F.col("platform")) == "article"
    found = [("comment", kind, *ml.domain_shift(folder, "comment", rows.where(part).drop("platform"))) for kind, part in (("comment", ~article), ("article", article))]
    return s.createDataFrame([(m, k, round(a, 4), n) for m, k, a, n in found], "model_type string, data_type string, accuracy double, n long")


def _stream(s, d, make, schema_of="events"):
    """A stream over the table's files, run to its end into a table of the shared folder."""
    folder = f"{shared_folder(s)}/eventloom-stream-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/{schema_of}.parquet").schema
    stream = jobs.ingest(s, f"{d}/{schema_of}.parquet*", schema)  # a pattern: the table may be a folder or one file
    jobs.run_available(make(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return s.read.parquet(f"{folder}/out")


def _timed(stream):
    return stream.withColumn("publish_time", F.col("ts").cast("timestamp")).withColumn("event_id", F.concat(F.lit("e"), (F.col("user_id") % 40).cast("string")))


def _st_ingest(s, d):
    return _stream(s, d, lambda x: x.select(F.col("event_id").alias("id"), "event_type"))


def _st_dedup(s, d):
    return _stream(s, d, lambda x: jobs.dedup_url(_timed(x).withColumn("source_url", F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string"))), delay="3650 days").select("source_url"))


def _batched(s, d, make, apply, of="events", mode="append"):
    """A stream over the table's files, run to its end through a function of batches; gives the folder that this one writes to."""
    folder = f"{shared_folder(s)}/eventloom-stream-{uuid.uuid4().hex}"
    stream = jobs.ingest(s, f"{d}/{of}.parquet*", s.read.parquet(f"{d}/{of}.parquet").schema)
    jobs.run_batches(make(stream), apply(f"{folder}/out"), f"{folder}/checkpoint", mode).awaitTermination()
    return f"{folder}/out"


def _st_late(s, d):
    path = _batched(s, d, lambda x: _timed(x).select("publish_time", F.col("event_type").alias("kind"), "user_id"), lambda p: jobs.keep_recent(s, p, 10))
    return s.read.parquet(f"{path}/rows").select("kind", "user_id")


def _in_files(s, d, n=5):
    """The events' table as files by ranges of time, so that a stream takes several batches."""
    events = table(s, d, "events")
    bounds = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / n for k in range(1, n)], 10_000).alias("b")).first().b or []
    folder, at = f"{shared_folder(s)}/eventloom-events-{uuid.uuid4().hex}", F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = events.where(F.lit(True) if low is None else at >= low).where(F.lit(True) if high is None else at < high)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def _st_bucket(s, d):
    folder = f"{shared_folder(s)}/eventloom-stream-{uuid.uuid4().hex}"
    source = _in_files(s, d)
    stream = jobs.ingest(s, source, s.read.parquet(source).schema, files_a_batch=1)
    jobs.run_batches(jobs.event_buckets(_timed(stream).select("event_id", "publish_time")), jobs.keep_batches(f"{folder}/out"), f"{folder}/checkpoint", "update").awaitTermination()
    return jobs.bucket_table(s, f"{folder}/out")


def _printed(stream):
    return stream.select(F.col("doc_id").alias("seq"), dedup.simhash64(F.col("text")).alias("fingerprint"))


def _st_comment_dup(s, d):
    path = _batched(s, d, _printed, lambda p: jobs.comment_dup(s, p), "documents")
    return jobs.comment_counts(s, path).select("seq", "duplicate_count")


def _st_cluster(s, d):
    idf = ev._weights(s, d)[1].drop("df")
    shape = lambda x: x.select(F.col("doc_id").alias("seq"), (F.lit(START).cast("long") + F.col("doc_id") * 2220 % SPAN).alias("publish_s"), tx.tokenize(F.col("text")).alias("tokens"))
    return jobs.clusters_of(s, _batched(s, d, shape, lambda p: jobs.live_clusters(s, p, idf), "documents"))


def _st_report(s, d):
    every = stash(posts(s, d).select("event_id", "publish_s"), "posts")
    path = _batched(s, d, lambda x: x.select(F.col("source").alias("event_id")), lambda p: jobs.report(s, every.stashed_at, p, lambda x: trend.heat(x, AS_OF)), "documents")
    return s.read.parquet(path).select("event_id", "heat")


def _advice(s, d):
    words = ev.keywords(s, d)
    return advice_prompt(fact_sheet(ev._detail(s, d, words)), vectors.similar_events(ev._event_texts(s, d, words)))


QUERIES = {
    "lifecycle_block": _lifecycle_block,
    "dict_segment": _segments,
    "entity_counts": _entities,
    "location": lambda s, d: entities.location(_entities(s, d)),
    "people": lambda s, d: entities.people(_entities(s, d)).withColumn("people", F.array_join("people", ",")),
    "single_pass": _single_pass,
    "discover_events": lambda s, d: cluster.discover_events(_docs(s, d), 0.04).select("doc_id", "event_id"),
    "analyze_event": lambda s, d: _analysis(s, d),
    "two_stage": _two_stage,
    "dashboard_brief": lambda s, d: dashboard_brief(ev.events(s, d)),
    "event_fact_sheet": lambda s, d: fact_sheet(ev._detail(s, d)),
    "event_brief": lambda s, d: event_brief(trend.heat(posts(s, d), AS_OF), report.key_nodes(posts(s, d)), report.top_influencers(posts(s, d)), report.platform_chain(posts(s, d))),
    "advice_prompt": _advice,
    "sent_predict": _trained,
    "batch_infer": lambda s, d: ml.batch_infer(posts(s, d).select("doc_id", F.col("content").alias("text")), ev.length_rule).select("doc_id", "label"),
    "st_ingest": _st_ingest,
    "st_dedup_url": _st_dedup,
    "st_late": _st_late,
    "st_bucket": _st_bucket,
    "st_comment_dup": _st_comment_dup,
    "st_cluster": _st_cluster,
    "st_report": _st_report,
    "sink_raw": _raw,
    "sink_json": _json,
    "sent_train": _train_scores,
    "domain_shift": _domain_shift,
    "group_reports": _grouped,
}
_FACTS = f"""WITH k AS (SELECT event_id, string_agg(word, '、' ORDER BY rank) AS words FROM ({ev.ORACLE["event_keywords"]}) WHERE rank < 12 GROUP BY event_id),
p AS (SELECT event_id, string_agg(platform || ' ' || format('{{:,.1f}}', CASE WHEN ratio > 0 AND ratio <= 1 THEN floor(ratio * 1000 + 0.5::DOUBLE) / 10 ELSE ratio END) || '%', '、' ORDER BY rank) AS platforms FROM ({ev.ORACLE["platform_dist"]}) WHERE rank < 8 GROUP BY event_id),
d AS ({sql(["posts"], "SELECT event_id, date, cnt::DOUBLE AS c, false AS f FROM pdaily UNION ALL SELECT event_id, date, predict_count, true FROM pfut", ev._PDAYS)}),
t AS (SELECT event_id, string_agg(date::VARCHAR || ':' || format('{{:,.1f}}', c), ', ' ORDER BY f, date) AS days FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY f DESC, date DESC) AS back FROM d) WHERE back <= 10 GROUP BY event_id)
SELECT h.event_id, concat_ws(chr(10), 'heat: ' || format('{{:,.3f}}', heat), 'keywords: ' || words, 'platforms: ' || platforms, 'trend: ' || days) AS facts
FROM ({sql(["posts"], "SELECT event_id, heat FROM heats", ev._HEAT)}) h LEFT JOIN k USING (event_id) LEFT JOIN p USING (event_id) LEFT JOIN t USING (event_id)"""
_ENTITIES = sql(
    ["posts"],
    "SELECT event_id, word, " + ", ".join(f"count(*) FILTER (t = '{t}') AS {t}" for t in ("person", "place", "org", "storm", "other")) + " FROM (SELECT *, CASE WHEN before = 'the' THEN 'storm' ELSE tag END AS t FROM placed JOIN gaz USING (word) WHERE len(word) >= 2) GROUP BY event_id, word",
    f"gaz AS (SELECT word, ['person', 'place', 'org'][('0x' || substr(md5(word), 1, 4))::BIGINT % 3 + 1] AS tag FROM (SELECT unnest({_TOKENS.replace('content', 'title')}) AS word FROM posts) GROUP BY word HAVING count(*) >= 5)",
    "cutw AS (SELECT event_id, doc_id, regexp_extract_all(concat_ws(' ', title, left(content, 500)), '[\\p{L}\\p{N}_]+') AS ws FROM posts)",
    "placed AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT event_id, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM cutw))",
)
ORACLE = {
    "lifecycle_block": sql(
        ["activity"],
        "SELECT s.event_id, s.stage, coalesce(c.n, 0) AS n_points, p.predict_count FROM stages s LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT *, count(*) OVER w AS n, avg(diff) OVER w AS m, stddev_pop(diff) OVER w AS sd FROM (SELECT *, cnt - lag(cnt) OVER (PARTITION BY event_id ORDER BY ix) AS diff FROM buckets) WINDOW w AS (PARTITION BY event_id)) WHERE n >= 3 AND sd > 0 AND abs(diff - m) / sd >= 1.5 GROUP BY event_id) c USING (event_id) JOIN (SELECT event_id, round(greatest(0, latest + (latest - oldest)::DOUBLE / greatest(n - 1, 1) * 3), 1) AS predict_count FROM (SELECT event_id, arg_max(cnt, ix) AS latest, arg_min(cnt, ix) AS oldest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ix DESC) AS rn FROM daily) WHERE rn <= 3 GROUP BY event_id)) p USING (event_id)",
        BUCKETS, STAGE, DAILY,
    ),
    "batch_infer": "SELECT doc_id, CASE WHEN n % 50 < 15 THEN 'neutral' WHEN n % 2 = 1 THEN 'positive' ELSE 'negative' END AS label FROM (SELECT doc_id, len(text) AS n FROM documents)",
    "st_ingest": "SELECT event_id AS id, event_type FROM events",
    "st_dedup_url": "SELECT DISTINCT 'u' || (user_id % 25)::VARCHAR AS source_url FROM events",
    "entity_counts": _ENTITIES,
    "people": f"""WITH g AS (SELECT *, max(person) OVER (PARTITION BY event_id) AS most FROM ({_ENTITIES}) WHERE person > 0 AND person::DOUBLE / (person + place + org + storm + other) >= 0.6 AND place + org + storm = 0)
SELECT event_id, string_agg(word, ',' ORDER BY rn) AS people FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY person DESC, word) AS rn FROM g WHERE most < 2 OR person >= 2) WHERE rn <= 5 GROUP BY event_id""",
    "event_fact_sheet": _FACTS,
    "advice_prompt": f"SELECT f.event_id, facts || chr(10) || 'similar: ' || coalesce(near, 'none') AS prompt FROM ({_FACTS}) f LEFT JOIN (SELECT event_id, string_agg(other, ', ' ORDER BY rank) AS near FROM ({ev.ORACLE['similar_events']}) WHERE rank <= 3 GROUP BY event_id) USING (event_id)",
    "event_brief": f"""SELECT event_id, 'node' AS section, pos, concat_ws(' ', role, author, platform) AS line FROM ({ev.ORACLE["key_nodes"]}) WHERE pos < 5
 UNION ALL SELECT event_id, 'influencer', rank, author || ' ' || format('{{:,.1f}}', influence) FROM ({ev.ORACLE["top_influencers"]}) WHERE rank <= 3
 UNION ALL SELECT event_id, 'path', 0, string_agg(platform, ' → ' ORDER BY pos) FROM ({ev.ORACLE["platform_chain"]}) GROUP BY event_id
 UNION ALL SELECT event_id, 'heat', 0, format('{{:,.3f}}', heat) FROM ({sql(["posts"], "SELECT event_id, heat FROM heats", ev._HEAT)})""",
    "st_late": "SELECT event_type AS kind, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY",
    "st_bucket": sql(["activity"], "SELECT event_id, ix, start_s, cnt FROM buckets", BUCKETS),
    "st_report": sql(["posts"], "SELECT event_id, heat FROM heats", ev._HEAT),
    "sink_raw": sql(["posts"], "SELECT doc_id, platform, md5(content) AS content, publish_s FROM posts"),
    "sink_json": sql(["posts"], "SELECT event_id, heat, words FROM heats JOIN (SELECT event_id, array_to_string(list_sort(list(word)), ',') AS words FROM kw GROUP BY event_id) USING (event_id)", *ev._KW, ev._HEAT),
    "dashboard_brief": sql(
        ["posts"],
        "SELECT 'hot' AS section, pos, format('{}. {} heat {:.1f}', pos, event_id, heat) AS line FROM pg UNION ALL SELECT 'risk', row_number() OVER (ORDER BY heat DESC, event_id), event_id || ' ' || risk_level FROM (SELECT * FROM pg WHERE risk_level IN ('high', 'mid_high') ORDER BY heat DESC, event_id LIMIT 8) UNION ALL SELECT 'total', 0, format('{} events, {} of {} at high risk', (SELECT count(*) FROM ev), count(*) FILTER (risk_level IN ('high', 'mid_high')), count(*)) FROM pg",
        *ev._EVENTS,
        "pg AS (SELECT *, row_number() OVER (ORDER BY heat DESC, event_id) AS pos FROM ev QUALIFY pos <= 10)",
    ),
}
