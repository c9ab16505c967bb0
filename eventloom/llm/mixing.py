"""Mixing sources to target weights by iterative proportional fitting.

The corpus is summed to cells (source, language, topic). The cells' token weights are
raked: scaled to the target of each dimension in turn until all marginals hold. A cell's
weight over its tokens, scaled so that the largest ratio is 1, is the probability with
which its documents are kept. Only cells take part in the fitting, so its cost does not depend
on the number of documents.

A hash of the id puts a cell's documents in a chance order, and those before a threshold are
kept: the one up to which the cell has its share of tokens. It is found by counting tokens by
more and more bits of the hash, so no cell is sorted or lies in one task. The one document in
which a share ends is kept systematically: over the cells of one language and topic, by source, the parts of
such documents are added up, and where the sum passes a whole number and a half, one is kept.

Targets are shares given for the values of a dimension, or follow from its token counts.
Topics come from the corpus: of each language the words that most documents hold which are
not in nearly all, the first ones of all languages one topic, the second ones the next; a
document's topic is that of the word among them that it has most often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hidden, stash, unstash

#: Where no shares are given, a value's is in proportion to its tokens to this power: below 1 lifts what is rare, 0 makes all equal.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.8}
#: Such a share is at most so many times the value's own before all are scaled to 1: what is very rare can't be
#: lifted to much without most of the rest being thrown away.
LIFT = 2.0
#: A word of a topic: letters alone. Terms of each language, those of all, and the share of a language's documents that a term is in at most.
WORD = r"\p{L}{4,}"
TERMS, MOST_TERMS, COMMON = 5, 64, 0.3
#: Shares that the registered query asks for; what they leave is tempered.
TARGETS = {"lang": {"en": 0.5, "de": 0.2}, "source": {"src0": 0.08, "src1": 0.02}}
OTHER = "other"
TOLERANCE, MAX_ROUNDS, ROUNDS_A_JOB = 1e-6, 240, 8
#: Cells up to so many are fitted in one partition.
FEW_CELLS = 10_000
#: Cells up to so many go to all executors, more are joined by exchange.
MAX_BROADCAST = 100_000
SEED = "mix"
#: Bits of the hash, and of one round of counting.
HASH_BITS, ROUND_BITS = 52, 13
#: Sums of parts are rounded to so many places before they are held against whole numbers.
PLACES = 6


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic_terms(docs: DataFrame, *, text_col: str = "text") -> dict[str, str]:
    """The topics' words in the corpus (``text``, ``lang``) and their topics: at most ``MOST_TERMS`` words, the commonest first."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"({WORD})"), 1)).alias("words"))
    counts = rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    sizes = rows.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("n"))
    few = counts.join(sizes, F.col("lang").eqNullSafe(F.col("__lang"))).where(F.col("df") <= COMMON * F.col("n"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "word"))).where(F.col("rank") <= TERMS)
    return {r.word: f"topic{r.rank}" for r in ranked.groupBy("word").agg(F.max("df").alias("df"), F.min("rank").alias("rank")).orderBy(F.desc("df"), "word").limit(MOST_TERMS).collect()}


def topic(text: Column, terms: dict[str, str]) -> Column:
    """The topic of the term that the text has most often as a word, of the earlier one on a tie; ``other`` without any."""
    if not terms:
        return F.lit(OTHER)

    def times(found: Column, term: str) -> Column:
        return F.size(F.filter(found, lambda w: w == term))

    def most(found: Column) -> Column:
        return F.array(*[times(found, t) for t in terms])

    def named(hits: Column) -> Column:
        best = F.array_max(hits)
        return F.when(best > 0, F.element_at(F.array(*map(F.lit, terms.values())), F.array_position(hits, best).cast("int"))).otherwise(F.lit(OTHER))

    # Bound once by arrays of one, as each is used more than once.
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1), lambda w: w.isin(list(terms)))
    hits = F.transform(F.array(found), most)
    return F.get(F.transform(hits, named), F.lit(0))


def _checked(targets: dict[str, dict[str, float]], dims: list[str]) -> None:
    for d, shares in targets.items():
        if d not in dims:
            raise ValueError(f"no dimension {d}: there are {', '.join(dims)}")
        if any(x < 0 for x in shares.values()) or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"shares of {d} must be 0 or more and add up to 1 at most")


def with_targets(cells: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` with a target of tokens for each value of each dimension, ``target_<dimension>``; each dimension's add up to all tokens.

    Values with a given share get it; what shares leave goes to the other values by the
    tempered counts, none to more than ``LIFT`` times its own share. Values without tokens
    get nothing, and the rest is scaled up for it.
    """
    targets = targets or {}
    _checked(targets, list(temper))
    out = cells
    whole = cells.agg(F.sum("tokens").alias("total"))  # one row of one number, as those below
    for d, power in temper.items():
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("sum")).join(F.broadcast(whole))
        given = F.lit(None).cast("double")
        for value, share in targets.get(d, {}).items():
            given = F.when(F.col(d).eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(given)
        rest = max(0.0, 1 - sum(targets.get(d, {}).values()))
        # Values without tokens have no part in it, power 0 included.
        free = F.when(F.col("given").isNull() & (F.col("sum") > 0), F.pow("sum", F.lit(power))).otherwise(0.0)
        sums = sums.withColumn("given", given).withColumn("free", free)
        frees = sums.agg(F.sum("free").alias("frees"))
        lifted = F.least(F.col("free") / F.col("frees"), LIFT * F.col("sum") / F.col("total"))
        sums = sums.join(F.broadcast(frees)).withColumn("free", F.when(F.col("frees") > 0, lifted).otherwise(0.0)).drop("frees")
        frees = sums.agg(F.sum("free").alias("frees"))
        own = F.when(F.col("sum") > 0, F.coalesce("given", F.when(F.col("frees") > 0, rest * F.col("free") / F.col("frees")).otherwise(0.0))).otherwise(0.0)
        shares = sums.join(F.broadcast(frees)).withColumn("share", own)
        scale = shares.agg(F.sum("share").alias("scale"))
        shares = shares.join(F.broadcast(scale)).select(F.col(d).alias("value"), F.when(F.col("scale") > 0, F.col("share") / F.col("scale") * F.col("total")).otherwise(0.0).alias(f"target_{d}"))
        out = out.join(shares, out[d].eqNullSafe(shares["value"])).drop("value")
    return out


def rake(cells: DataFrame, dims: list[str], *, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` (dimensions, tokens, target_<dimension>) with the fitted ``weight`` and whether the fit ``converged``.

    Stops when no marginal is off by more than ``tolerance`` of its target (looked at every
    ``ROUNDS_A_JOB`` rounds), or after ``max_rounds``: then ``converged`` is false, as targets
    that no weights of the cells can meet never hold all at once. Cells without tokens keep
    weight 0. The targets of all dimensions add up to the same total.
    """
    fitted = stash(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    few = fitted.count() <= FEW_CELLS
    done = False
    for _ in range(0, max_rounds, ROUNDS_A_JOB):
        # Few cells lie in one partition, where sums over any dimension need no exchange.
        step = fitted.coalesce(1) if few else fitted
        for _ in range(ROUNDS_A_JOB):
            for d in dims:
                held = F.sum("weight").over(Window.partitionBy(d))
                step = step.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"target_{d}") / held).otherwise(0.0))
        fitted, old = stash(step, "cells"), fitted
        unstash(old)
        gaps = fitted.coalesce(1) if few else fitted
        for d in dims:
            gaps = gaps.withColumn(f"off_{d}", F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"target_{d}")) / F.greatest(F.col(f"target_{d}"), F.lit(1e-300)))
        worst = gaps.agg(*[F.max(f"off_{d}").alias(d) for d in dims]).first()
        done = all((x or 0.0) <= tolerance for x in worst)
        if done:
            break
    return fitted.withColumn("converged", F.lit(done))


def keep_probabilities(docs: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The cells of ``docs`` (dimensions and ``n_tokens``) with ``weight``, ``keep_prob`` and ``converged``; cells without tokens have 0."""
    cells = stash(docs.groupBy(*temper).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = rake(with_targets(cells, temper, targets), list(temper))
    fitted = fitted.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    top = fitted.agg(F.max("rate").alias("top"))
    out = fitted.join(F.broadcast(top)).select(*temper, "weight", F.when(F.col("top") > 0, F.col("rate") / F.col("top")).otherwise(0.0).alias("keep_prob"), "converged")
    return stash(out, "cells")


def chance(id_column: Column, seed: str = SEED) -> Column:
    """A number of ``HASH_BITS`` bits that follows from the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _joined(rows: DataFrame, cells: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Rows with what their cell has; ``dims``: the rows' columns and those of the cells."""
    own = {d: hidden(rows, f"cell_{k}") for k, d in enumerate(dims.values())}
    cells = cells.withColumnsRenamed(own)
    if cells.count() <= MAX_BROADCAST:
        cells = F.broadcast(cells)
    on = None
    for mine, d in dims.items():
        same = F.col(mine).eqNullSafe(F.col(own[d]))
        on = same if on is None else on & same
    return rows.join(cells, on).drop(*own.values())


def with_thresholds(marked: DataFrame, cells: DataFrame, dims: list[str]) -> DataFrame:
    """``cells`` (dimensions, ``keep_prob``) with ``below``: documents (dimensions, ``n_tokens``, ``chance``) whose number is less are kept.

    Rounds of counting: each splits the part of a cell's numbers in which its share of tokens
    ends. In the end that is one number, kept by the sum of parts over the cells of the other dimensions.
    """
    sums = marked.groupBy(*dims).agg(F.sum("n_tokens").alias("sum"))
    same = {d: d for d in dims}
    state = stash(_joined(sums, cells, same).select(*dims, "keep_prob", (F.col("keep_prob") * F.col("sum")).alias("goal"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("had"), F.lit(0).cast("long").alias("own")), "draw")
    for shift in range(HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
        here = _joined(marked.select(*dims, "n_tokens", "chance"), state.select(*dims, "prefix"), same).where(F.shiftright("chance", shift + ROUND_BITS) == F.col("prefix"))
        found = here.groupBy(*dims, F.shiftright("chance", shift).alias("at")).agg(F.sum("n_tokens").alias("n"))
        # At most 2^ROUND_BITS rows a cell.
        before = F.sum("n").over(Window.partitionBy(*dims).orderBy("at")) - F.col("n")
        last = _joined(found.withColumn("before", before), state.select(*dims, "goal", "had", "keep_prob"), same)
        ends = last.where((F.col("had") + F.col("before") + F.col("n") >= F.col("goal")))
        state, old = stash(ends.groupBy(*dims).agg(F.min(F.struct("at", "before", "n", "goal", "had", "keep_prob")).alias("e")).select(*dims, "e.keep_prob", "e.goal", F.col("e.at").alias("prefix"), (F.col("e.had") + F.col("e.before")).alias("had"), F.col("e.n").alias("own")), "draw"), state
        unstash(old)
    part = F.when(F.col("own") > 0, (F.col("goal") - F.col("had")) / F.col("own")).otherwise(0.0)
    state, old = state.withColumn("part", part), state
    upto = F.round(F.sum("part").over(Window.partitionBy(*dims[1:]).orderBy(dims[0])), PLACES)
    state = state.withColumn("upto", upto)
    passed = F.floor(F.col("upto") + 0.5) > F.floor(F.round(F.col("upto") - F.col("part"), PLACES) + 0.5)
    below = F.when(passed, F.col("prefix") + 1).otherwise(F.col("prefix"))
    out = stash(_joined(cells, state.select(*dims, below.alias("below")), same), "thresholds")
    unstash(old)
    return out


def _marked(docs: DataFrame, terms: dict[str, str], seed: str, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    dims = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic(text, terms).alias("topic")]
    return stash(docs.select(F.col(id_col).alias("doc_id"), *dims, tokens(text).alias("n_tokens"), chance(F.col(id_col), seed).alias("chance")), "mix")


def mix(docs: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, topics: dict[str, str] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, keep_prob, ``kept`` and ``converged`` of every row of ``docs``.

    ``targets``: shares of tokens by dimension (source, lang, topic) and value; what they leave
    is split by ``temper`` (see ``with_targets``). ``topics``: words and their topics, else those of the corpus. ``converged`` is false in all rows if the
    targets could not all be met. A null source or language is a value of its own; empty and null texts have no tokens
    and are not kept. Rows with the same id share their draw. Further
    columns are not read; an empty table gives no rows.
    """
    dims = list(temper)
    marked = _marked(docs, topic_terms(docs, text_col=text_col) if topics is None else topics, seed, id_col, text_col)
    cells = with_thresholds(marked, keep_probabilities(marked, temper, targets), dims)
    out = _joined(marked, cells, {d: d for d in dims})
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "keep_prob", ((F.col("chance") < F.col("below")) & (F.col("n_tokens") > 0)).alias("kept"), "converged")


def sample(docs: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, topics: dict[str, str] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with its columns; nulls, ties, repeated rows and empty tables as there."""
    terms = topic_terms(docs, text_col=text_col) if topics is None else topics
    marked = _marked(docs, terms, seed, id_col, text_col)
    cells = with_thresholds(marked, keep_probabilities(marked, temper, targets), list(temper))
    unstash(marked)
    text = F.col(text_col).cast("string")
    names = {d: hidden(docs, d) for d in temper}
    own = {d: c for d, c in (("source", F.col("source").cast("string")), ("lang", F.col("lang").cast("string")), ("topic", topic(text, terms)))}
    rows = docs.withColumns({names[d]: own[d] for d in temper})
    below = hidden(docs, "below")
    found = _joined(rows, cells.select(*temper, F.col("below").alias(below)), {names[d]: d for d in temper})
    return found.where((chance(F.col(id_col), seed) < F.col(below)) & (tokens(text) > 0)).select(*docs.columns)


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.withColumn("keep_prob", F.round("keep_prob", 6))


def _oracle() -> str:
    found = "regexp_extract_all(t, '\\p{L}{4,}')"
    targets = ", ".join(f"(SELECT target FROM sum_{d} WHERE v IS NOT DISTINCT FROM cells.{d}) AS t_{d}" for d in TEMPER)

    def sums(d: str, power: float) -> str:
        given = TARGETS.get(d, {})
        case = "CASE " + " ".join(f"WHEN {d} = '{v}' THEN {x}::DOUBLE" for v, x in given.items()) + " END" if given else "NULL::DOUBLE"
        return f"""sum_{d} AS (
  SELECT v, CASE WHEN scale > 0 THEN own / scale * total ELSE 0 END AS target FROM (SELECT *, sum(own) OVER () AS scale FROM (
  SELECT *, CASE WHEN s > 0 THEN coalesce(given, CASE WHEN sum(lifted) OVER () > 0 THEN {1 - sum(given.values())}::DOUBLE * lifted / sum(lifted) OVER () ELSE 0 END) ELSE 0 END AS own FROM (
  SELECT *, CASE WHEN sum(free) OVER () > 0 THEN least(free / sum(free) OVER (), {LIFT} * s / total) ELSE 0 END AS lifted FROM (
  SELECT *, CASE WHEN given IS NULL AND s > 0 THEN pow(s, {power}) ELSE 0 END AS free FROM (
  SELECT {d} AS v, {case} AS given, sum(tokens) AS s, (SELECT sum(tokens) FROM cells) AS total FROM cells GROUP BY {d}))))))"""

    carry = "source, lang, topic, tokens, t_source, t_lang, t_topic"
    off = "greatest(" + ", ".join(f"abs(sum(w) OVER (PARTITION BY it, {d}) - t_{d}) / greatest(t_{d}, 1e-300)" for d in TEMPER) + ")"
    inner = f"SELECT {carry}, it, w FROM fit WHERE it < {MAX_ROUNDS}"
    for d in TEMPER:
        inner = f"SELECT {carry}, it, CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM ({inner})"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT lang, w, count(*) AS df FROM (SELECT lang, unnest(list_distinct({found})) AS w FROM d) GROUP BY ALL
), ranked AS (
  SELECT w, df, row_number() OVER (PARTITION BY lang ORDER BY df DESC, w) AS rank FROM words JOIN (SELECT lang AS l, count(*) AS n FROM d GROUP BY 1) ON lang IS NOT DISTINCT FROM l WHERE df <= {COMMON} * n
  QUALIFY rank <= {TERMS}
), terms AS (
  SELECT w, 'topic' || rank AS topic, row_number() OVER (ORDER BY df DESC, w) AS pos FROM (SELECT w, max(df) AS df, min(rank) AS rank FROM ranked GROUP BY w) QUALIFY pos <= {MOST_TERMS}
), hits AS (
  SELECT rid, topic, pos, count(*) AS n FROM (SELECT rid, unnest({found}) AS w FROM d) JOIN terms USING (w) GROUP BY ALL
), best AS (
  SELECT rid, topic FROM hits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, pos) = 1
), marked AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(topic, '{OTHER}') AS topic, len(regexp_extract_all(t, '[^ \t\n\r]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':{SEED}')), 1, {HASH_BITS // 4}))::BIGINT AS chance
  FROM d LEFT JOIN best USING (rid)
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM marked GROUP BY ALL
), {", ".join(sums(d, p) for d, p in TEMPER.items())}, fit AS (
  SELECT source, lang, topic, tokens, {targets}, 0 AS it, tokens AS w FROM cells
  UNION ALL
  SELECT {carry}, it + 1, w FROM ({inner})
), ended AS (
  SELECT coalesce(min(it), {MAX_ROUNDS}) AS last, min(it) IS NOT NULL AS converged FROM (SELECT it, max(off) AS off FROM (SELECT it, {off} AS off FROM fit) GROUP BY it) WHERE it > 0 AND it % {ROUNDS_A_JOB} = 0 AND off <= {TOLERANCE}
), rated AS (
  SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS rate FROM fit WHERE it = (SELECT last FROM ended)
), prob AS (
  SELECT source, lang, topic, CASE WHEN max(rate) OVER () > 0 THEN rate / max(rate) OVER () ELSE 0 END AS p, tokens FROM rated
), placed AS (
  SELECT m.*, p, p * tokens AS goal,
    sum(n_tokens) OVER (PARTITION BY m.source, m.lang, m.topic ORDER BY chance) AS upto,
    sum(n_tokens) OVER (PARTITION BY m.source, m.lang, m.topic, chance) AS own
  FROM marked m JOIN prob c ON m.source IS NOT DISTINCT FROM c.source AND m.lang IS NOT DISTINCT FROM c.lang AND m.topic = c.topic
), ending AS (
  SELECT source AS s, lang AS l, topic AS tp, min(chance) AS last, arg_min(CASE WHEN own > 0 THEN (goal - (upto - own)) / own ELSE 0 END, chance) AS part FROM placed WHERE upto >= goal GROUP BY ALL
), passing AS (
  SELECT *, round(sum(part) OVER (PARTITION BY l, tp ORDER BY s NULLS FIRST), {PLACES}) AS parts FROM ending
)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS keep_prob,
  n_tokens > 0 AND (chance < last OR (chance = last AND floor(parts + 0.5) > floor(round(parts - part, {PLACES}) + 0.5))) AS kept, (SELECT converged FROM ended) AS converged
FROM placed JOIN passing ON source IS NOT DISTINCT FROM s AND lang IS NOT DISTINCT FROM l AND topic = tp
"""


ORACLE_SQL = _oracle()
