"""Per-event aggregates: keywords, sentiment, platforms, credibility, titles, propagation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import values as vl
from ..sources.tables import stash
from ..values import BIG_V, OFFICIAL, PLAIN, ROLE_BEGINS, ROLE_LEADS, ROLE_PEAKS, ROLE_SPEAKS, ROLES, TIER_WEIGHTS, TIERS_LEAD, TIERS_SPEAK


def platform_dist(posts: DataFrame) -> DataFrame:
    """event_id, platform, ratio, rank by share (the name on a tie)."""
    return platforms_of(posts.groupBy("event_id", "platform").agg(F.count(F.lit(1)).alias("n")))


def platforms_of(facts: DataFrame) -> DataFrame:
    """``platform_dist`` of counts ``n`` by event_id, platform and perhaps more."""
    n = facts.groupBy("event_id", "platform").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("event_id")
    return n.select("event_id", "platform", F.round(F.col("n") / F.sum("n").over(w), 3).alias("ratio"), (F.row_number().over(w.orderBy(F.desc("n"), "platform")) - 1).alias("rank"))


def sources_set(posts: DataFrame) -> DataFrame:
    return posts.groupBy("event_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def sentiment_dict(texts: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """``texts`` (with ``tokens``) and their label and score by how many tokens hold a word of each list."""
    p, n = tx.contains_any(F.col("tokens"), positive), tx.contains_any(F.col("tokens"), negative)
    return sentiment_of(texts.withColumns({"pos": p, "neg": n}))


def sentiment_of(scored: DataFrame) -> DataFrame:
    """``sentiment_dict`` of texts with the numbers ``pos`` and ``neg`` of such tokens."""
    score = F.when(F.col("pos") + F.col("neg") > 0, (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg"))).otherwise(0.0)
    return scored.withColumn("score", score).withColumn("label", F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").otherwise("neutral"))


def sentiment_dist(labelled: DataFrame) -> DataFrame:
    """Share of each label by event; all three are always there."""
    return labelled.groupBy("event_id").agg(*sentiment_columns())


def sentiment_columns() -> list[Column]:
    """The aggregates of ``sentiment_dist``, so that they can share a pass with others."""
    return [F.round(F.count_if(F.col("label") == k) / F.count(F.lit(1)), 3).alias(k) for k in ("positive", "neutral", "negative")]


def authenticity(posts: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Credibility score, ratios by tier, their distribution and factors; ``rates``: event_id, dup_rate."""
    tier = F.coalesce(F.nullif("verification_type", F.lit("")), F.lit(PLAIN))
    known = posts.select("event_id", tier.alias("tier")).groupBy("event_id", "tier").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(TIER_WEIGHTS[PLAIN])
    for t, w in TIER_WEIGHTS.items():
        weight = F.when(F.col("tier") == t, w).otherwise(weight)
    known = known.withColumns({"w": weight, "total": F.sum("n").over(Window.partitionBy("event_id"))})
    verified = [t for t in TIER_WEIGHTS if t != PLAIN]
    out = known.groupBy("event_id").agg(
        (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("raw"),
        F.round(F.sum(F.when(F.col("tier").isin(OFFICIAL), F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("official_ratio"),
        F.round(F.sum(F.when(F.col("tier").isin(verified), F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("verified_ratio"),
        F.round(F.sum(F.when(F.col("tier").isin(verified), 0).otherwise(F.col("n"))) / F.sum("n"), 3).alias("plain_user_ratio"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", F.round(F.col("n") / F.col("total"), 3).alias("share"))))).alias("verification_dist"),
    )
    out = out.join(rates, "event_id", "left") if rates is not None else out.withColumn("dup_rate", F.lit(0.0))
    rate = F.coalesce("dup_rate", F.lit(0.0))
    factors = [
        F.when(F.col("official_ratio") < 0.10, "official_absent"),
        F.when(F.col("plain_user_ratio") > 0.70, "mostly_unverified"),
        F.when(rate > 0.30, "high_duplicate_rate"),
        F.when((F.col("verified_ratio") > 0.5) & (F.col("official_ratio") > 0.2), "well_sourced"),
    ]
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") * (1 - 0.3 * rate))), 3)
    return out.select("event_id", score.alias("credibility_score"), "official_ratio", "verified_ratio", "plain_user_ratio", "verification_dist", F.filter(F.array(*factors), lambda x: x.isNotNull()).alias("factors"))


def event_title(posts: DataFrame) -> DataFrame:
    """The shortest title, of articles if any, of eight characters or more if any; the earlier post on a tie."""
    return posts.groupBy("event_id").agg(title_column())


def title_column() -> Column:
    """The aggregate of ``event_title``."""
    t = F.trim("title")
    key = F.struct((F.length(t) == 0).alias("a"), (vl.text_type(F.col("platform")) != "article").alias("b"), (F.length(t) < 8).alias("c"), F.length(t).alias("d"), F.col("seq").alias("e"))
    return tx.event_title_clean(F.min_by(F.col("title"), key)).alias("title")


# Propagation


def _influence() -> Column:
    return vl.influence(F.col("repost_count"), F.col("comment_count"), F.col("like_count"))


def key_nodes(posts: DataFrame) -> DataFrame:
    """The first plain user's post (else the first post), the first of a well-known account, the first official one and the most influential; each post has one role."""
    tier = F.coalesce(F.nullif("verification_type", F.lit("")), F.lit(PLAIN))
    rows = posts.withColumns({"tier": tier, "influence": _influence()})
    order = F.struct("publish_s", "seq")
    node = F.struct("seq", "doc_id", "author", "platform", "tier", "publish_s", "influence", tx.snippet(F.col("title"), F.col("content")).alias("snippet"))
    # The aggregates sort rows by event, so texts are left behind first.
    rows = rows.select("event_id", "tier", "influence", "seq", node.alias("node"), order.alias("order"))
    node, order = F.col("node"), F.col("order")
    top = rows.groupBy("event_id").agg(
        F.coalesce(F.min_by(F.when(F.col("tier") == PLAIN, node), F.when(F.col("tier") == PLAIN, order)), F.min_by(node, order)).alias("r0"),
        F.min_by(F.when(F.col("tier").isin(BIG_V), node), F.when(F.col("tier").isin(BIG_V), order)).alias("r1"),
        F.min_by(F.when(F.col("tier").isin(OFFICIAL), node), F.when(F.col("tier").isin(OFFICIAL), order)).alias("r2"),
        F.min_by(F.when(F.col("influence") > 0, node), F.when(F.col("influence") > 0, F.struct(-F.col("influence"), F.col("seq")))).alias("r3"),
    )
    found = top.select("event_id", F.posexplode(F.array("r0", "r1", "r2", "r3")).alias("priority", "node")).where("node is not null")
    w = Window.partitionBy("event_id", "node.seq").orderBy("priority")
    found = found.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("priority") + 1)
    o = Window.partitionBy("event_id").orderBy("node.publish_s", "priority")
    return found.select(
        "event_id", (F.row_number().over(o) - 1).alias("pos"), role.alias("role"), F.col("node.doc_id").alias("doc_id"),
        F.coalesce(F.nullif("node.author", F.lit("")), F.lit("匿名")).alias("author"), "node.platform", F.col("node.tier").alias("verification_type"), "node.publish_s", F.round("node.influence", 1).alias("influence"), "node.snippet",
    )


def top_influencers(posts: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy(F.desc("influence"), "seq")
    top = posts.withColumn("influence", _influence()).where("influence > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("event_id", "rank", "doc_id", F.coalesce(F.nullif("author", F.lit("")), F.lit("匿名")).alias("author"), "platform", F.round("influence", 1).alias("influence"))


def platform_chain(posts: DataFrame) -> DataFrame:
    """Platforms by first appearance, each with the link to the next."""
    p = posts.groupBy("event_id", "platform").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("publish_s", "seq")).alias("first"))
    w = Window.partitionBy("event_id").orderBy("first")
    return p.select("event_id", "platform", "count", F.col("first.publish_s").alias("first_seen_s"), (F.row_number().over(w) - 1).alias("pos"), F.lead("platform").over(w).alias("target"), F.lead("count").over(w).alias("value"))


def propagation_path(nodes: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Key nodes as they are shown: name, category, size and the link to the next one; events without any show their chain of platforms."""
    role, tier = F.col("role"), F.col("verification_type")
    category = (
        F.when(role.rlike(ROLE_BEGINS), 0).when(role.rlike(ROLE_PEAKS), 3).when(role.rlike(ROLE_LEADS) | tier.rlike(TIERS_LEAD), 1)
        .when(role.rlike(ROLE_SPEAKS) | tier.rlike(TIERS_SPEAK), 2).when(F.col("pos") == 0, 0).otherwise(4)
    )
    subject = F.when(F.col("author") != "匿名", F.col("author")).otherwise(F.col("platform"))
    size = F.when(F.col("influence") <= 0, F.greatest(F.lit(34.0), 48.0 - F.col("pos") * 2)).otherwise(F.least(F.lit(72.0), F.greatest(F.lit(38.0), 34 + F.sqrt("influence"))))
    named = nodes.withColumn("name", F.concat(role, F.lit(" · "), subject))
    path = named.select("event_id", "pos", "name", category.alias("category"), F.round(size, 4).alias("size"), F.lead("name").over(Window.partitionBy("event_id").orderBy("pos")).alias("target"))
    if chain is None:
        return path
    reach = F.least(F.lit(66.0), F.greatest(F.lit(34.0), 34 + F.sqrt("count") * 2))
    rest = chain.join(nodes.select("event_id").distinct(), "event_id", "left_anti")
    return path.unionByName(rest.select("event_id", "pos", F.col("platform").alias("name"), F.when(F.col("pos") == 0, 0).otherwise(3).alias("category"), F.round(reach, 4).alias("size"), "target"))


# Extracts


def summary(posts: DataFrame, keywords: DataFrame, most: int = 3) -> DataFrame:
    """The first sentences of the article that names most keywords in its lead; of any post if there is no article."""
    words = keywords.groupBy("event_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    # The post is chosen by its lead and length; only the chosen ones' texts are read again.
    leads = posts.select("event_id", "seq", (vl.text_type(F.col("platform")) == "article").alias("a"), F.substring(F.concat("title", F.lit("。"), "content"), 1, 300).alias("lead"), F.length("content").alias("l"))
    hits = F.size(F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda k: F.contains("lead", k)))
    ranked = leads.join(words, "event_id", "left").select("event_id", F.struct("a", hits.alias("h"), "l", (-F.col("seq")).alias("s")).alias("r"))
    chosen = ranked.groupBy("event_id").agg(F.max("r").alias("top")).select("event_id", (-F.col("top.s")).alias("seq"))
    # Written, so that their size is known and texts aren't exchanged for few of them.
    chosen = stash(chosen, "chosen")
    best = posts.join(chosen, ["event_id", "seq"]).groupBy("event_id").agg(F.min(F.struct("title", "content")).alias("b"))
    own, title = tx.sentences(F.col("b.content")), tx.sentences(F.col("b.title"))
    sents = F.when(F.size(own) > 0, own).otherwise(title)
    return best.select("event_id", F.when(F.size(sents) > 0, F.concat(F.array_join(F.slice(sents, 1, most), "。"), F.lit("。"))).otherwise(F.col("b.title")).alias("summary"))


def cause(posts: DataFrame, keywords: DataFrame, least: int = 12) -> DataFrame:
    """The earliest article's early sentence with a keyword; else the first sentence of the earliest post."""
    words = keywords.groupBy("event_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    article = (vl.text_type(F.col("platform")) == "article").cast("int")
    # Of texts only early sentences go on.
    rows = posts.select("event_id", article.alias("article"), F.struct("publish_s", "seq").alias("order"), "title", tx.first_sentences(F.col("content"), 2).alias("sents")).join(words, "event_id", "left")
    named = F.coalesce("words", F.array().cast("array<string>"))
    fit = F.get(F.filter("sents", lambda s: (F.length(s) >= least) & F.exists(named, lambda k: F.contains(s, k))), F.lit(0))
    first = F.coalesce(F.get("sents", F.lit(0)), F.get(tx.first_sentences(F.col("title"), 1), F.lit(0)))
    rows = rows.select("event_id", "article", "order", fit.alias("fit"), first.alias("first"), F.when(F.size("sents") > 0, None).otherwise(F.col("title")).alias("title"))
    order, fit = F.col("order"), F.col("fit")
    g = rows.groupBy("event_id").agg(
        F.max("article").alias("any"),
        F.min_by(F.when((F.col("article") == 1) & fit.isNotNull(), fit), F.when((F.col("article") == 1) & fit.isNotNull(), order)).alias("of_articles"),
        F.min_by(F.when(fit.isNotNull(), fit), F.when(fit.isNotNull(), order)).alias("of_all"),
        F.min_by(F.struct(F.col("first").alias("sentence"), "title"), order).alias("earliest"),
    )
    found = F.when(F.col("any") == 1, F.col("of_articles")).otherwise(F.col("of_all"))
    return g.select("event_id", F.coalesce(F.concat(found, F.lit("。")), F.concat("earliest.sentence", F.lit("。")), "earliest.title").alias("cause"))
