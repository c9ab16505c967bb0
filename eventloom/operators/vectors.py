"""Sparse term vectors in long form (key, term, weight): weights, similarity, keywords, nearest centroids.

Texts are projected away before terms become rows, which are counted within a document;
similarities come from joins on the term, so only vectors that share a term meet, and of
these, where there are many, only pairs that bounds don't rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from ahocorasick import Automaton
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.automaton import automaton
from ..sources.tables import stash


def _runs(tokens: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """Rows and a column of them, the array of the terms and how often they are there."""
    ordered = tokens.select(*keys, F.sort_array("tokens").alias("__t"))
    starts = F.array_compact(F.transform("__t", lambda t, i: F.when((i == 0) | (F.get("__t", i - 1) != t), i)))
    found = F.transform("__s", lambda s, k: F.struct(F.get("__t", s).alias("term"), (F.coalesce(F.get("__s", k + 1), F.size("__t")) - s).cast("long").alias("n")))
    return ordered.withColumn("__s", starts), found


def term_bags(tokens: DataFrame, *keys: str, hits: dict[str, list[str]] | None = None) -> DataFrame:
    """keys, terms (array of term and n) of a table with an array ``tokens``; each row is a document of its own, so terms are counted within the row. To be stored before it is taken apart.

    ``hits``: further columns, and the lists of words of which their counted tokens hold one.
    """
    kinds, hits = dict(tokens.dtypes), hits or {}
    fields = [*(f"`{k}` {kinds[k]}" for k in keys), "terms array<struct<term:string,n:bigint>>", *(f"`{name}` bigint" for name in hits)]
    return tokens.select(*keys, "tokens").mapInArrow(_bagged(hits), ", ".join(fields))


def _bagged(hits: dict[str, list[str]]) -> Callable[[Iterator], Iterator]:
    """Of batches (keys, tokens) the keys, the terms of each row in their order, and how many tokens hold one of some words. A word is looked at once in a few rows."""

    def rows(batches: Iterator) -> Iterator:
        lexicons = [(automaton([w for w in words if "\n" not in w]), "" in words) for words in hits.values()]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                tokens = part.column(part.num_columns - 1)
                ends, none = tokens.offsets.to_numpy(), tokens.is_null()
                found = tokens.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode("encode")
                order = pc.sort_indices(found.dictionary)
                words = found.dictionary.take(order)
                place = np.empty(len(words), np.int64)
                place[order.to_numpy()] = np.arange(len(words))
                of = np.repeat(np.arange(part.num_rows), np.diff(ends))
                cells, n = np.unique(of * len(words) + place[found.indices.to_numpy()], return_counts=True)
                row, term = np.divmod(cells, max(len(words), 1))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                bags = pa.StructArray.from_arrays([words.take(pa.array(term)), pa.array(n)], ["term", "n"])
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), bags, mask=none)]
                for lexicon, every in lexicons:
                    held = np.ones(len(words), bool) if every else _holding(lexicon, words)
                    counts = np.bincount(row, n * held[term], part.num_rows).astype(np.int64)
                    columns.append(pa.array(counts, mask=none.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "terms", *hits])

    return rows


def _holding(lexicon: Automaton, words: pa.Array) -> np.ndarray:
    """Which words hold one of the lexicon, by one pass over all of them, a line each."""
    out = np.zeros(len(words), bool)
    if len(lexicon) and len(words):
        lines = pc.fill_null(pc.replace_substring(words, "\n", "\r"), "")
        ends = np.cumsum(pc.utf8_length(lines).to_numpy() + 1)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()
        out[np.searchsorted(ends, np.fromiter((at for at, _ in lexicon.iter(text)), np.int64), "right")] = True
    return out


def term_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys, term, n: the ``term_bags`` as rows; only distinct terms become rows."""
    runs, found = _runs(tokens, *keys)
    # Of an array with a name Spark would first ask for its size, and count for each of its terms again.
    return runs.select(*keys, F.inline(found))


def idf(counts: DataFrame, totals: DataFrame, scope: list[str] = (), kept: list[str] = ()) -> DataFrame:
    """scope, term, idf = ln((N + 1) / (df + 1)) + 1 and, if ``kept`` names it, df; ``counts`` has each term once a document, ``totals`` the N of each scope."""
    df = counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(totals, list(scope)) if scope else df.join(F.broadcast(totals))  # a single row
    return joined.select(*scope, "term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"), *kept)


def tfidf_vector(counts: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """key, term, w of unit length; terms without an idf are left out."""
    raw = counts.join(idfs, "term").select(key, "term", (F.col("n") * F.col("idf")).alias("raw"))
    return raw.select(key, "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).alias("w"))


def bag_vectors(bags: DataFrame, idfs: DataFrame, key: str, heads: int | None = None) -> DataFrame:
    """key, terms (array of term and w): ``tfidf_vector`` of ``term_bags`` with a row a key. ``idfs``: term, idf, df.

    Tasks are told the idf of the commonest terms; only the others become rows that are joined with theirs.
    """
    cut = _cut(idfs, F.col("df"), heads if heads is not None else HEADS)
    known = {r[0]: r[1] for r in idfs.where(F.col("df") >= cut).select("term", "idf").toLocalIterator()}
    kind = dict(bags.dtypes)[key]
    parts = stash(bags.select(key, "terms").mapInArrow(_told(bags.sparkSession.sparkContext.broadcast(known)), f"`{key}` {kind}, terms array<struct<term:string,raw:double>>, squares double, rest array<struct<term:string,n:bigint>>"), "told")
    rest = parts.select(key, F.inline("rest")).join(idfs, "term").select(key, "term", (F.col("n") * F.col("idf")).alias("raw"))
    rest = rest.groupBy(key).agg(F.collect_list(F.struct("term", "raw")).alias("terms"), F.sum(F.col("raw") * F.col("raw")).alias("squares"))
    raw = parts.drop("rest").unionByName(rest).groupBy(key).agg(F.flatten(F.collect_list("terms")).alias("terms"), F.sum("squares").alias("squares"))
    return raw.select(key, F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["raw"] / F.sqrt("squares")).alias("w"))).alias("terms"))


#: Rows that are looked up at once in a task.
ROWS = 256


def _slices(batches: Iterator) -> Iterator:
    """Of batches (key, terms) parts of few rows: keys, offsets from 0 and the columns of all terms."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ends = part.column(1).offsets.to_numpy()
            yield part.column(0), ends - ends[0], part.column(1).values.slice(ends[0], ends[-1] - ends[0]).flatten()


def _lists(ends: np.ndarray, kept: np.ndarray, *columns: pa.Array, names: list[str]) -> pa.Array:
    """Lists of structs of the values that are kept; ``ends``: offsets of all."""
    count = np.concatenate([[0], np.cumsum(kept)])[ends]
    return pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.StructArray.from_arrays([c.filter(pa.array(kept)) for c in columns], names))


def _told(known: Broadcast) -> Callable[[Iterator], Iterator]:
    def rows(batches: Iterator) -> Iterator:
        for keys, ends, (terms, n) in _slices(batches):
            idf = np.fromiter(map(known.value.get, terms.to_pylist(), repeat(np.nan)), float, len(terms))
            told = ~np.isnan(idf)
            raw = n.to_numpy() * idf
            squares = np.bincount(np.repeat(np.arange(len(keys)), np.diff(ends))[told], raw[told] ** 2, len(keys)).astype(float)  # of nothing, counts are whole numbers
            columns = [keys, _lists(ends, told, terms, pa.array(raw), names=["term", "raw"]), pa.array(squares), _lists(ends, ~told, terms, n, names=["term", "n"])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "terms", "squares", "rest"])

    return rows


def tf_relative(counts: DataFrame, key: str) -> DataFrame:
    return counts.select(key, "term", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("tf"))


def doc_keywords(counts: DataFrame, totals: DataFrame, k: int = 8, scope: str = "event_id", key: str = "doc_id", idfs: DataFrame | None = None) -> DataFrame:
    """Top terms of each document by tf-idf within its event; the term decides ties. ``idfs``, if given, are those of all counts, and ``counts`` may lack terms that can't be among the top ones."""
    idfs = idf(counts, totals, [scope]) if idfs is None else idfs
    scored = counts.join(idfs, [scope, "term"]).withColumn("score", F.col("n") * F.col("idf"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(scope, key, "term", "score", "rank")


#: The commonest terms of the scopes whose idf all tasks are told, at most so many pairs of scope and term.
HEADS = 1 << 18


def _cut(rows: DataFrame, df: Column, most: int) -> int:
    """The least count of documents (``df``) that no more than so many rows reach."""
    told, cut = 0, 1
    # Few rows: n different counts take n * n / 2 rows of terms.
    for r in rows.groupBy(df.alias("df")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("df")).collect():
        told += r.m
        if told > most:
            cut = r.df + 1
            break
    return cut


def bag_keywords(bags: DataFrame, totals: DataFrame, k: int = 8, scope: str = "event_id", key: str = "doc_id", heads: int = HEADS) -> DataFrame:
    """``doc_keywords`` of stored ``term_bags`` (scope, key, terms); ``totals``: the number of documents of each scope.

    Tasks are told the idf of the commonest terms. All others' lies between that of the rarest of these and that of a
    term of one document, so a document's k-th score is bounded from below, and only terms that can reach it become rows.
    """
    # Written, so that its size is known and bags aren't exchanged by scope for few of them.
    totals = stash(totals, "totals")
    idfs = stash(idf(bags.select(scope, F.explode("terms.term").alias("term")), totals, [scope], kept=["df"]), "idfs")
    cut = max(_cut(idfs, F.col("df"), heads), 2)
    told = idfs.where(F.col("df") >= cut).select(scope, "term", "idf").toArrow().combine_chunks()  # of bounded size
    told = told.take(pc.sort_indices(told.column(scope)))
    begins = [0, *(np.flatnonzero(np.diff(told.column(scope).combine_chunks().dictionary_encode().indices.to_numpy())) + 1).tolist(), told.num_rows]
    known = {told.column(scope)[a].as_py(): (told.column("term")[a:b].combine_chunks(), told.column("idf")[a:b].to_numpy()) for a, b in zip(begins, begins[1:]) if b > a}
    ratio = lambda df: F.log((F.col("total") + 1) / F.lit(df)) + 1
    bounded = bags.join(totals, scope).select(scope, key, "terms", F.greatest(ratio(cut), F.lit(1.0)).alias("low"), ratio(2).alias("high"))
    types = {f.name: f.dataType.simpleString() for f in bags.schema}
    likely = bounded.mapInArrow(_likely(bags.sparkSession.sparkContext.broadcast(known), k), f"`{scope}` {types[scope]}, `{key}` {types[key]}, term string, n long")
    return doc_keywords(likely, totals, k, scope, key, idfs.drop("df"))


def _likely(known: Broadcast, k: int) -> Callable[[Iterator], Iterator]:
    """Of batches (scope, key, terms, low, high) the rows of the terms whose upper bound reaches the k-th of the document's lower bounds."""

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            bags, scopes = batch.column(2), batch.column(0).to_pylist()
            lows, highs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            at, terms, counts = bags.offsets.to_numpy(), bags.values.field("term"), bags.values.field("n").to_numpy()
            kept, idf = [np.empty(0, np.int64)], _known_idf(known.value, scopes, at, terms)
            for i in range(len(scopes)):
                n = counts[at[i] : at[i + 1]]
                if len(n) <= k:
                    kept.append(np.arange(at[i], at[i + 1]))
                    continue
                told = idf[at[i] - at[0] : at[i + 1] - at[0]]
                unknown = np.isnan(told)
                least = np.partition(n * np.where(unknown, lows[i], told), len(n) - k)[len(n) - k]
                # Scores are rounded to 9 places before they decide.
                kept.append(at[i] + np.flatnonzero(n * np.where(unknown, highs[i], told) >= least * (1 - 1e-9) - 1e-8))
            of = np.repeat(np.arange(len(scopes)), [len(x) for x in kept[1:]])
            found = np.concatenate(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), terms.take(pa.array(found)), pa.array(counts[found])], [*batch.schema.names[:2], "term", "n"])

    return rows


def _known_idf(known: dict, scopes: list, at: np.ndarray, terms: pa.Array) -> np.ndarray:
    """The told idf of the terms of all rows, each row's from ``at`` on; NaN where none is. All of a scope's terms are looked up at once."""
    out, own = np.full(at[-1] - at[0], np.nan), {}
    for i, scope in enumerate(scopes):
        if scope in known:
            own.setdefault(scope, []).append(i)
    for scope, rows in own.items():
        words, values = known[scope]
        places = np.concatenate([np.arange(at[i], at[i + 1]) for i in rows])
        found = pc.fill_null(pc.index_in(terms.take(pa.array(places)), words), -1).to_numpy()
        out[places - at[0]] = np.where(found < 0, np.nan, values[found])
    return out


def event_keywords(doc_terms: DataFrame, k: int = 8) -> DataFrame:
    """Top terms of each event by the sum of their documents' scores, weighted by the best."""
    s = doc_terms.groupBy("event_id", "term").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("event_id").orderBy(F.desc(F.round("score", 6)), "term")
    # Spark keeps k rows an event and task before the exchange.
    top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("event_id", F.col("term").alias("word"), F.round(F.col("score") / F.max("score").over(Window.partitionBy("event_id")), 3).alias("weight"), (F.col("rank") - 1).alias("rank"))


def cosine_sparse(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Dot products of unit vectors of two tables (``w``), for pairs that share a term."""
    right = b.select(F.col(key_b), "term", F.col("w").alias("w_b"))
    return a.join(right, "term").groupBy(key_a, key_b).agg(F.sum(F.col("w") * F.col("w_b")).alias("score"))


#: Weights of the commonest terms in the second table that all tasks are told, at most so many.
WEIGHTS = 1 << 19


def bag_cosines(bags: DataFrame, b: DataFrame, idfs: DataFrame, key_a: str, key_b: str, weights: int | None = None) -> DataFrame:
    """``cosine_sparse`` of ``bag_vectors`` and a table in long form; ``idfs``: term, idf, df. Tasks are told the weights of the commonest terms and add up their products within a row; only other terms become rows."""
    placed = stash(b.select(key_b, "term", "w").join(idfs.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), "placed")
    cut = _cut(placed, F.col("df"), weights if weights is not None else WEIGHTS)
    told = placed.where(F.col("df") >= cut).select(key_b, "term", "w").toArrow()
    others = sorted(set(told.column(0).to_pylist()))
    column, row = {k: i for i, k in enumerate(others)}, {t: i for i, t in enumerate(dict.fromkeys(told.column(1).to_pylist()))}
    cells = [np.array([of[v] for v in told.column(c).to_pylist()], np.int64) for c, of in ((1, row), (0, column))]
    known = bags.sparkSession.sparkContext.broadcast((row, others, *cells, told.column(2).to_numpy()))
    kinds = dict(bags.dtypes) | dict(b.dtypes)
    out = f"`{key_a}` {kinds[key_a]}, scores array<struct<other:{kinds[key_b]},score:double>>, rest array<struct<term:string,w:double>>"
    parts = stash(bags.select(key_a, "terms").mapInArrow(_products_told(known, placed.select(key_b).schema), out), "products")
    right = placed.where(F.col("df") < cut).select(F.col(key_b), "term", F.col("w").alias("w_b"))
    rest = parts.select(key_a, F.inline("rest")).join(right, "term").select(key_a, key_b, (F.col("w") * F.col("w_b")).alias("score"))
    sums = parts.select(key_a, F.inline("scores")).withColumnRenamed("other", key_b)
    return sums.unionByName(rest).groupBy(key_a, key_b).agg(F.sum("score").alias("score"))


def _products_told(known: Broadcast, schema: StructType) -> Callable[[Iterator], Iterator]:
    kind = to_arrow_schema(schema).field(0).type

    def rows(batches: Iterator) -> Iterator:
        row, others, at, column, weight = known.value
        order = np.lexsort((column, at))
        at, column, weight = at[order], column[order], weight[order]
        first = np.searchsorted(at, np.arange(len(row) + 1))
        for keys, ends, (terms, w) in _slices(batches):
            where = np.fromiter(map(row.get, terms.to_pylist(), repeat(-1)), np.int64, len(terms))
            told, w_a = where >= 0, w.to_numpy()
            of = np.repeat(np.arange(len(keys)), np.diff(ends))[told]
            # Each told term meets the rows of the second table that have it.
            begin, many = first[where[told]], np.diff(first)[where[told]]
            met = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
            cell = np.repeat(of, many) * max(len(others), 1) + column[met]
            found, back = np.unique(cell, return_inverse=True)
            sums = np.bincount(back, np.repeat(w_a[told], many) * weight[met], len(found)).astype(float)
            starts = np.searchsorted(found, np.arange(len(keys) + 1) * max(len(others), 1))
            other = pa.array([others[c] for c in found % max(len(others), 1)], kind)
            scores = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.StructArray.from_arrays([other, pa.array(sums)], ["other", "score"]))
            yield pa.RecordBatch.from_arrays([keys, scores, _lists(ends, ~told, terms, w, names=["term", "w"])], ["key", "scores", "rest"])

    return rows


def cosine_full(vectors: DataFrame, key: str) -> DataFrame:
    """Cosine of each pair of vectors of one table (any length, ``w``) that shares a term: key, other, score.

    Made for few long-lived vectors (events); a term's vectors meet pairwise.
    """
    unit = vectors.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))))
    other = unit.select(F.col(key).alias("other"), "term", F.col("w").alias("w_b"))
    return unit.join(other, "term").where(F.col(key) != F.col("other")).groupBy(key, "other").agg(F.sum(F.col("w") * F.col("w_b")).alias("score"))


#: Products of single terms up to which all pairs that share a term are simply scored; beyond it, a search by bounds. The results are the same.
FEW_PRODUCTS = 20_000_000
#: A vector's heaviest terms, and the heaviest vectors of each, that first guesses come from.
PROBES, CHAMPIONS = 8, 32


def _products(vectors: DataFrame, index: DataFrame, key: str, other: str) -> DataFrame:
    return vectors.join(index, "term").groupBy(key, other).agg(F.sum(F.col("w") * F.col("w_o")).alias("score"))


def most_similar(vectors: DataFrame, index: DataFrame, key: str, other: str, k: int, slack: float = 1e-8, itself: bool = True) -> DataFrame:
    """key, other, score: all pairs whose dot product is within ``slack`` of the key's k-th largest or above it; without those of a key and itself unless ``itself``.

    ``vectors``: key, term, w; ``index``: other, term, w_o; weights are above 0. A key's heaviest
    terms and their heaviest vectors give first pairs, whose scores bound the k-th one from below. A
    term's weight times its largest in the index bounds what it can add: terms that together
    can't reach the k-th score are never looked up, and of what the others bring only pairs are
    scored whose part so far could still reach it.
    """
    reach = index.groupBy("term").agg(F.max("w_o").alias("most"), F.count(F.lit(1)).alias("df"))
    bounded = stash(vectors.join(reach, "term").select(key, "term", "w", (F.col("w") * F.col("most")).alias("b"), "df"), "bounded")
    apart = F.lit(True) if itself else F.col(key) != F.col(other)
    if bounded.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] <= FEW_PRODUCTS:
        return _products(bounded.select(key, "term", "w"), index, key, other).where(apart)
    by_bound = Window.partitionBy(key).orderBy(F.desc("b"), "term")
    probes = bounded.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= PROBES).select(key, "term")
    champions = index.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w_o"), other))).where(F.col("r") <= CHAMPIONS).select("term", other)
    guessed = probes.join(champions, "term").where(apart).select(key, other).distinct()

    def scored(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        return pairs.join(terms, key).join(index, [other, "term"]).groupBy(key, other).agg(F.sum(F.col("w") * F.col("w_o")).alias("score"))

    first = scored(guessed, bounded.select(key, "term", "w"))
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), other))).where(F.col("r") == k).select(key, (F.col("score") - slack).alias("least"))
    rising = Window.partitionBy(key).orderBy("b", "term").rowsBetween(Window.unboundedPreceding, 0)
    parted = bounded.join(kth, key, "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("sum", F.sum("b").over(rising))
    parted = stash(parted.withColumn("tail", F.col("sum") < F.col("least")), "parted")
    rest = parted.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("tail"), F.col("sum"))), F.lit(0.0)).alias("rest"), F.max("least").alias("least"))
    heads = parted.where("not tail").select(key, "term", "w").join(index, "term").where(apart).groupBy(key, other).agg(F.sum(F.col("w") * F.col("w_o")).alias("head"))
    hopeful = stash(heads.join(rest, key).where(F.col("head") + F.col("rest") >= F.col("least")).select(key, other, "head", "least"), "hopeful")
    tails = scored(hopeful.select(key, other), parted.where("tail").select(key, "term", "w"))
    out = hopeful.join(tails, [key, other], "left").withColumn("score", F.col("head") + F.coalesce("score", F.lit(0.0)))
    return out.where(F.col("score") >= F.col("least")).select(key, other, "score")


def similar_events(texts: DataFrame, k: int = 5, key: str = "event_id") -> DataFrame:
    """The k most similar events of each by tf-idf over ``tokens`` (character bigrams); scores above 0, to 4 places."""
    counts = stash(term_counts(texts, key), "event-terms")
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    weighted = tf_relative(counts, key).join(idf(counts, total), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    unit = stash(weighted.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("w")), "event-vectors")
    index = unit.select(F.col(key).alias("other"), "term", F.col("w").alias("w_o"))
    scored = most_similar(unit, index, key, "other", k, slack=1e-4, itself=False).withColumn("score", F.round("score", 4)).where("score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "other")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assign_nearest(vectors: DataFrame, centroids: DataFrame, keys: DataFrame, key: str = "comment_id") -> DataFrame:
    """key, cluster_id: the centroid with the largest product, the smaller id on ties; 0 without a shared term."""
    index = centroids.select("cluster_id", "term", F.col("w").alias("w_o"))
    scored = most_similar(vectors, index, key, "cluster_id", 1)
    best = scored.groupBy(key).agg(F.max_by("cluster_id", F.struct(F.round("score", 9), -F.col("cluster_id"))).alias("cluster_id"))
    return keys.select(key).join(best, key, "left").select(key, F.coalesce("cluster_id", F.lit(0)).cast("long").alias("cluster_id"))


def centroid_mean(vectors: DataFrame, assignment: DataFrame, key: str = "doc_id") -> DataFrame:
    """cluster_id, term, w: mean vector; a vector without the term counts 0. ``vectors`` are in long form or have an array ``terms`` a row."""
    sizes = assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    placed = vectors.join(assignment, key)
    placed = placed.select("cluster_id", F.inline("terms")) if "terms" in vectors.columns else placed
    sums = placed.groupBy("cluster_id", "term").agg(F.sum("w").alias("s"))
    return sums.join(sizes, "cluster_id").select("cluster_id", "term", (F.col("s") / F.col("size")).alias("w"))


def topic_relevance_filter(centroids: DataFrame, topic: DataFrame, clusters: DataFrame, threshold: float = 0.02) -> DataFrame:
    """cluster_id, score (4 places), relevant: whether the centroid's product with the topic's vector meets the threshold."""
    scored = centroids.join(topic.select("term", F.col("w").alias("w_t")), "term").groupBy("cluster_id").agg(F.sum(F.col("w") * F.col("w_t")).alias("score"))
    out = clusters.join(scored, "cluster_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select("cluster_id", F.round("score", 4).alias("score"), (F.col("score") >= threshold).alias("relevant"))


def purity(pairs: DataFrame, predicted: str, true: str) -> DataFrame:
    """Share of rows that carry their cluster's most frequent true label; 0 for an empty table."""
    n = pairs.groupBy(predicted, true).agg(F.count(F.lit(1)).alias("n")).groupBy(predicted).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return n.agg(F.coalesce(F.sum("most") / F.sum("all"), F.lit(0.0)).alias("purity"))
