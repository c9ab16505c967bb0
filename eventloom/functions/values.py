"""Column functions on labels, counts and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import KEYWORD_GROUPS, KEYWORD_REST, NEWS_PLATFORMS, OFFICIAL_ACCOUNTS, OFFICIAL_HEADLINE, PLAIN, PLATFORM_TEXT_TYPES, RISK_LABELS, STAGE_LABELS, TOP_BADGES


def lookup(column: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in reversed(list(values.items())):
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def to_int_count(value: Column) -> Column:
    """Whole part of a number in any form; 0 for null, blank, bad and negative ones."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0)).cast("long"))


def text_type(platform: Column) -> Column:
    return lookup(platform, PLATFORM_TEXT_TYPES, F.lit("auto"))


def auto_text_type(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, "article").otherwise("comment")


def tier_social(screen_name: Column, verified_type: Column, verified_ext: Column) -> Column:
    """Credibility tier of a microblog account."""
    kind, ext = F.coalesce(verified_type, F.lit(-1)), F.coalesce(verified_ext, F.lit(-1))
    return (
        F.when(screen_name.isin(OFFICIAL_ACCOUNTS), "官方平台")
        .when(((kind == 0) & (ext == 2)) | kind.isin(200, 220), "头部认证个人")
        .when(kind == 0, "认证个人")
        .when(kind.between(1, 8), "认证机构")
        .otherwise(PLAIN)
    )


def tier_answers(badges: Column, headline: Column, kind: Column) -> Column:
    """Credibility tier of an account on a question-and-answer site."""
    badges = F.coalesce(badges, F.array().cast("array<string>"))
    return (
        F.when(F.arrays_overlap(badges, F.array(*map(F.lit, TOP_BADGES))), "头部认证个人")
        .when(F.array_contains(badges, "identity"), "认证个人")
        .when(F.coalesce(headline, F.lit("")).rlike(OFFICIAL_HEADLINE), "官方平台")
        .when(kind == "org", "认证机构")
        .otherwise(PLAIN)
    )


def tier_default(tier: Column, platform: Column) -> Column:
    return F.coalesce(F.nullif(tier, F.lit("")), F.when(platform.isin(NEWS_PLATFORMS), F.lit("官方平台")))


def influence(reposts: Column, comments: Column, likes: Column) -> Column:
    return reposts * 1.0 + comments * 0.5 + likes * 0.3


def risk_level(heat: Column, negative: Column) -> Column:
    score = heat * (1 + 2 * F.coalesce(negative, F.lit(0.0)))
    return F.when(score >= 40, "high").when(score >= 15, "mid_high").when(score >= 5, "mid").otherwise("low")


def duplicate_rate(duplicates: Column, reports: Column) -> Column:
    return F.when(duplicates + reports > 0, F.round(duplicates / (duplicates + reports), 3)).otherwise(0.0)


def authenticity_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score.isNotNull(), "low")


def ratio_percent(ratio: Column) -> Column:
    """A share or percentage as a whole percentage from 0 to 100; null stays null."""
    return F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when((ratio > 0) & (ratio <= 1), F.floor(ratio * 100 + 0.5)).otherwise(F.floor(ratio + 0.5)).cast("double"))))


def ratio_tone(ratio: Column, plain: bool = False) -> Column:
    """``ratio``: from ``ratio_percent``. Few plain users are well; so are many official or verified ones."""
    if plain:
        return F.when(ratio.isNull(), "pending").when(ratio <= 30, "ok").when(ratio <= 60, "warn").otherwise("danger")
    return F.when(ratio.isNull(), "pending").when(ratio >= 60, "ok").when(ratio >= 20, "warn").otherwise("danger")


def percent_norm(value: Column) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return F.when((v > 0) & (v <= 1), F.floor(v * 1000 + 0.5) / 10).otherwise(v)


def risk_label(code: Column) -> Column:
    return lookup(code, RISK_LABELS, F.coalesce(code, F.lit("中")))


def stage_label(code: Column) -> Column:
    return lookup(code, STAGE_LABELS, F.coalesce(code, F.lit("成长期")))


def display_time(value: Column) -> Column:
    return F.substring(F.coalesce(F.replace(value, F.lit("T"), F.lit(" ")), F.lit("")), 1, 16)


def trend_label(value: Column) -> Column:
    """HH:mm if there is one, else MM-dd, else the text itself."""
    clock, day = F.regexp_extract(value, r"(\d{2}:\d{2})", 1), F.regexp_extract(value, r"^\d{4}-(\d{2}-\d{2})", 1)
    return F.coalesce(F.nullif(clock, F.lit("")), F.nullif(day, F.lit("")), value, F.lit(""))


def people_text(people: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(people, lambda p: p.isNotNull() & (p != "")), "、"), F.lit(""))


def keyword_category(word: Column) -> Column:
    out = F.lit(KEYWORD_REST)
    for name, words in reversed(list(KEYWORD_GROUPS.items())):
        out = F.when(word.isin(words), F.lit(name)).otherwise(out)
    return out


def sources_variant(value: Column) -> Column:
    """Source names from a JSON list, an object with ``source_names``, or a plain text."""
    listed = F.from_json(value, "array<string>", {"mode": "PERMISSIVE"})
    named = F.from_json(F.get_json_object(value, "$.source_names"), "array<string>")
    return F.when(value.startswith("["), listed).when(value.startswith("{"), named).when(F.length(value) > 0, F.array(value)).otherwise(F.array().cast("array<string>"))


def label_from_proba(positive: Column, negative: Column, threshold: float = 0.6) -> Column:
    return F.when(F.greatest(positive, negative) < threshold, "neutral").when(positive > negative, "positive").otherwise("negative")


def label_from_model(label: Column, score: Column, threshold: float = 0.65) -> Column:
    raw = F.lower(label)
    named = (
        F.when(raw.isin("positive", "pos", "label_1", "1", "positive (stars 4 and 5)"), "positive").when(raw.isin("negative", "neg", "label_0", "0", "negative (stars 1, 2 and 3)"), "negative").otherwise("neutral")
    )
    return F.when(score < threshold, "neutral").otherwise(named)
