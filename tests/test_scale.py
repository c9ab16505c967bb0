"""What keeps queries right and in bounds on larger tables."""

import hashlib
import random
import re
import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import cluster, dedup, entities, report, trend, vectors
from eventloom.plans import catalog
from eventloom.sources import landed, views
from eventloom.streaming import jobs


def test_details_of_days_of_over_a_thousand_posts(spark, tmp_path):
    # Ids 43,200 apart are posted at the same time.
    rows = [(k * 43200, f"title words of post {k}\ntext", "en", "src1", 10) for k in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in catalog.queries()["event_detail"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert found == db.sql(catalog.oracle_sql()["event_detail"]).fetchall()
    assert "=1200.0" in found[0][-1]


def test_segments_go_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(entities, "CUT_CHARS", 100)
    texts = [None, "", "ab cd " * 10] * 10 + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    out = list(entities._segments(["ab", "cd"], [-1.0, -1.0], -5.0)(iter([batch])))
    assert len(out) == 5 and max(b.num_rows for b in out) == 40
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, 3 * k + 1, "cd" if k % 2 else "ab") for i in range(2, 30, 3) for k in range(20)]


def test_pages_are_cleaned_once(spark):
    pages = spark.createDataFrame([(1, "u", "<p>text</p>")], "page_id int, url string, html string")
    plan = landed.html_article(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--.*?-->") == 1


def test_remembered_shingles_give_the_same_fingerprints():
    rng = random.Random(4)
    letters = "abcdefgh\x00￿ é台风 \n"
    texts = ["".join(rng.choices(letters, k=rng.randrange(900))) for _ in range(200)] + ["", " ", "abc", "abcd", "a\U0001f600bcdef", "\x00" * 9, "￿" * 9, "\ud800abcd"]
    for bits in (1, 4, 20):
        memo = dedup.Shingles(bits)
        assert [memo.fingerprint(t) for t in texts + texts] == [dedup._fingerprint(t) for t in texts + texts]


def test_shingles_are_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(dedup.hashlib, "md5", lambda b, of=hashlib.md5: hashed.append(b) or of(b))
    memo = dedup.Shingles()
    for _ in range(50):
        memo.fingerprint("words that come again and again " * 20)
    assert len(hashed) <= len(set(hashed)) + 2


def test_every_round_of_single_pass_takes_a_whole_batch(spark, monkeypatch, caplog):
    """Also with more clusters than a list holds; by lists, where products have no room, results are the same."""
    monkeypatch.setattr(cluster, "LISTED", 1)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, i, rng.choices(words, k=rng.randrange(0, 9))) for i in range(150)]
    docs = spark.createDataFrame(rows, "seq long, publish_s long, tokens array<string>")
    monkeypatch.setattr(cluster, "CHUNK", 10)
    with caplog.at_level("INFO", "eventloom.operators.cluster"):
        found = {r.seq: r.cluster_id for r in cluster.single_pass(docs, 0.3, batch=50)[0].collect()}
    assert len([r for r in caplog.records if r.getMessage().startswith("round")]) == 3
    assert len(set(found.values())) > 10
    monkeypatch.setattr(cluster, "LISTED", 64)
    monkeypatch.setattr(cluster, "CELLS", 1)
    assert {r.seq: r.cluster_id for r in cluster.single_pass(docs, 0.3, batch=50)[0].collect()} == found


def test_single_pass_takes_many_documents_a_round(spark, monkeypatch, caplog):
    """Thousands of documents are one round, and rounds, pieces and matrices of any size give the same."""
    rng = random.Random(9)
    rows = [(i, i % 700, [f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.choice([0, 1, 6, 12]))]) for i in range(5000)]
    docs = spark.createDataFrame(rows, "seq long, publish_s long, tokens array<string>")
    found = []
    for batch in (None, 1300):
        caplog.clear()
        with caplog.at_level("INFO", "eventloom.operators.cluster"):
            assigned, centroids = cluster.single_pass(docs, 0.2, batch=batch)
        assert len([r for r in caplog.records if r.getMessage().startswith("round")]) == (4 if batch else 1)
        found.append(({r.seq: r.cluster_id for r in assigned.collect()}, {(r.cluster_id, r.term): round(r.w, 9) for r in centroids.collect()}))
        for name, value in (("CHUNK", 100), ("ENTRIES", 50), ("LISTED", 2), ("COLUMNS", 7), ("RARE", 3), ("HEADS", 20)):
            monkeypatch.setattr(cluster, name, value)
    assert found[0] == found[1] and len(set(found[0][0].values())) > 100


def test_nearest_centroids_are_found_in_tasks_or_by_joins(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i % 150, [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(160)]  # some ids twice
    docs = spark.createDataFrame([*rows, (500, None), (None, ["w1"])], "comment_id int, tokens array<string>").cache()
    ids = cluster.term_ids(vectors.idf(vectors.term_counts(docs, "comment_id"), docs.agg(F.count(F.lit(1)).alias("total"))))
    centroids = spark.createDataFrame([(c, f"w{k}", rng.random()) for c in range(0, 40, 2) for k in rng.sample(range(60), 9)], "cluster_id long, term string, w double")
    want = vectors.assign_nearest(vectors.tfidf_vector(vectors.term_counts(docs, "comment_id"), ids.select("term", "idf"), "comment_id"), centroids, docs)
    for told in (1 << 22, 10):
        monkeypatch.setattr(cluster, "TOLD", told)
        out = cluster.assign_nearest(vectors.term_bags(docs, "comment_id").cache(), ids, centroids, docs)
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
        monkeypatch.setattr(cluster, "HEADS", 5)
        monkeypatch.setattr(cluster, "CHUNK", 7)


def test_live_clusters_go_on_from_what_batches_added(spark, tmp_path):
    """Batches of a stream, with the sums of those before, settle as one pass does."""
    rng = random.Random(10)
    rows = [(i, i, rng.choices([f"w{k}" for k in range(50)], k=rng.randrange(0, 9))) for i in range(120)]
    docs = spark.createDataFrame(rows, "seq long, publish_s long, tokens array<string>").cache()
    counts = vectors.term_counts(docs, "seq")
    idf = vectors.idf(counts, docs.agg(F.count(F.lit(1)).alias("total")))
    apply = jobs.live_clusters(spark, str(tmp_path), idf, 0.3)
    for k in range(3):
        apply(docs.where(f"seq >= {k * 40} and seq < {k * 40 + 40}"), k)
    want = {r.seq: r.cluster_id for r in cluster.single_pass(docs, 0.3)[0].collect()}
    assert {r.seq: r.cluster_id for r in jobs.clusters_of(spark, str(tmp_path)).collect()} == want


def test_words_without_letters_are_passed_over_once(spark):
    texts = ["é1 12 _a 1a a1b aé é ab洪水ca 洪cb 𝒜a 𝒜𝒜b ²³x a 1 x洪", "1" * 100_000 + " ab", "é" * 100_000 + "a", "", None]
    began = time.time()
    out = [r.t for r in spark.createDataFrame([(t,) for t in texts], "text string").select(tx.tokenize(F.col("text")).alias("t")).collect()]
    assert out == [["_a", "1a", "a1b", "aé", "ab", "ca", "cb", "𝒜a", "𝒜𝒜b", "²³x", "洪水"], ["ab"], ["é" * 100_000 + "a"], [], None]
    assert time.time() - began < 10


def test_only_terms_that_can_be_keywords_become_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"e{i % 3}", i % 280, [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([0, 1, 5, 60, 200]))]) for i in range(300)]  # some ids twice
    docs = spark.createDataFrame([*rows, ("e0", 500, None), (None, 501, ["a"]), ("none", 502, ["a"])], "event_id string, doc_id int, tokens array<string>")
    totals = docs.where("event_id <> 'none'").groupBy("event_id").agg(F.count(F.lit(1)).alias("total"))
    bags, seen, join = vectors.term_bags(docs, "event_id", "doc_id").cache(), [], vectors.doc_keywords
    everything = vectors.term_counts(docs, "event_id", "doc_id").count()
    want = sorted(map(tuple, join(vectors.term_counts(docs, "event_id", "doc_id"), totals, 4).collect()))
    monkeypatch.setattr(vectors, "doc_keywords", lambda counts, *a: seen.append(counts.count()) or join(counts, *a))
    for heads in (0, 20, 1 << 18):
        assert sorted(map(tuple, vectors.bag_keywords(bags, totals, 4, heads=heads).collect())) == want
    assert seen[2] <= seen[1] <= seen[0] < everything and seen[1] < everything / 2


def test_keywords_are_made_once_a_query(spark, sf, monkeypatch):
    made, make = [], vectors.event_keywords
    monkeypatch.setattr(vectors, "event_keywords", lambda *a: made.append(1) or make(*a))
    for k, name in enumerate(["advice_prompt", "similar_reason"]):
        catalog.queries()[name](spark, sf)
        assert len(made) == k + 1, name


def test_vectors_and_products_by_row_equal_joins(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i % 90, [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(100)]  # some ids twice
    docs = spark.createDataFrame([*rows, (500, None), (501, ["a"])], "doc_id int, tokens array<string>")
    bags, counts, totals = vectors.term_bags(docs, "doc_id").cache(), vectors.term_counts(docs, "doc_id").cache(), docs.agg(F.count(F.lit(1)).alias("total"))
    idfs = vectors.idf(counts, totals, kept=["df"]).cache()
    plain = vectors.tfidf_vector(counts, idfs.drop("df"), "doc_id").cache()
    other = plain.where("doc_id < 50 or doc_id = 501").groupBy((F.col("doc_id") % 7).alias("cluster_id"), "term").agg(F.avg("w").alias("w")).cache()
    close = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    monkeypatch.setattr(vectors, "ROWS", 7)
    for most in (0, 20, 1 << 18):
        found = vectors.bag_vectors(bags, idfs, "doc_id", heads=most).cache()
        assert close(found.select("doc_id", F.inline("terms"))) == close(plain)
        out = vectors.bag_cosines(found, other, idfs, "doc_id", "cluster_id", weights=most)
        assert close(out) == close(vectors.cosine_sparse(plain, other, "doc_id", "cluster_id"))


def test_terms_are_counted_once_a_row(spark):
    plan = vectors.term_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.split("text", " ").alias("tokens")), "doc_id").join(spark.range(3).select(F.col("id").cast("string").alias("term")), "term")
    assert "size(transform" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_shingles_of_many_texts_are_looked_at_together(monkeypatch):
    rng = random.Random(5)
    letters = "abcdefgh\x00￿ é台风 \n\U0001f600\ud800"
    texts = ["".join(rng.choices(letters, [9] * 16 + [1, 1], k=rng.choice([0, 1, 3, 4, 5, 300, 900, 3000]))) for _ in range(200)]
    want = [dedup._fingerprint(t) for t in texts]
    for chars in (1, 50, 1 << 17):
        monkeypatch.setattr(dedup, "TOGETHER", chars)
        assert dedup.Shingles(8).fingerprints(texts) == want
    looked, look = [], dedup.Shingles._hashed
    monkeypatch.setattr(dedup.Shingles, "_hashed", lambda *a: looked.append(1) or look(*a))
    assert dedup.Shingles().fingerprints(texts) == want and len(looked) < 9


def test_texts_are_not_exchanged_for_the_last_posts(spark, sf):
    rows = views.posts(spark, sf)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the texts have
    try:
        plan = trend.recent_window(rows, 10)._jdf.queryExecution().executedPlan().toString()
        buckets = trend.bucket_counts(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.search(r"hashpartitioning\(event_id#\d+L?, \d+\)", buckets)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_terms_and_sentiment_are_counted_in_one_pass(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(vectors, "ROWS", 7)
    rows = [(i % 50, rng.choices(["good day", "bad\nday", "gut", "schlecht", "é洪水", "b"], k=rng.randrange(6))) for i in range(90)]
    docs = spark.createDataFrame([*rows, (500, None)], "doc_id int, tokens array<string>")
    for lists in ((["good", "gu"], ["bad", "洪"]), ([], [""]), ([f"w{k}" for k in range(80)] + ["day"], ["chle", "gut"])):
        out = vectors.term_bags(docs, "doc_id", hits=dict(zip(("pos", "neg"), lists)))
        want = report.sentiment_dict(docs, *lists).select("doc_id", F.when(F.col("tokens").isNotNull(), F.struct("pos", "neg")), "score", "label")
        assert sorted(map(tuple, report.sentiment_of(out).select("doc_id", F.when(F.col("terms").isNotNull(), F.struct("pos", "neg")), "score", "label").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    bags = [(r.doc_id, None if r.terms is None else [tuple(t) for t in r.terms]) for r in out.collect()]
    assert bags == [*((i, sorted((t, ts.count(t)) for t in set(ts))) for i, ts in rows), (500, None)]


def test_first_sentences_are_those_of_the_whole_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abc 洪。!\n", [5, 5, 5, 3, 5, 1, 1, 1], k=rng.randrange(90))) for _ in range(300)] + ["", "。", "a" * 60, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (1, 2, 3):
        for chars in (1, 20, 1000):
            found = df.select(tx.first_sentences(F.col("t"), most, chars=chars).alias("a"), F.slice(tx.sentences(F.col("t")), 1, most).alias("b")).collect()
            assert [r.a for r in found] == [r.b for r in found]


def test_words_are_counted_before_they_meet_the_gazetteer(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["e1", "e2", None]), i, " ".join(rng.choices(["the", "Ann", "a", "Rome", "人民网"], k=rng.randrange(4))), " ".join(rng.choices(["the", "Ann", "Rome", "x1"], k=rng.randrange(5)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "event_id string, doc_id long, title string, content string")
    tags = {"Ann": "person", "Rome": "place", "人民网": "person", "a": "org"}
    want = {}
    for event, _, title, content in rows:
        words = f"{title} {content}".split()
        for before, word in zip([None, *words], words):
            if word in tags and len(word) > 1:
                tag = "storm" if before == "the" else "other" if word == "人民网" else tags[word]
                counts = want.setdefault((event, word), dict.fromkeys(["person", "place", "org", "storm", "other"], 0))
                counts[tag] += 1
    out = entities.entity_counts(docs, spark.createDataFrame(list(tags.items()), "word string, tag string"), ["the"])
    assert {(r.event_id, r.word): {t: r[t] for t in ("person", "place", "org", "storm", "other")} for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_many_places_are_not_held_against_each_other(spark):
    rows = [("e", "Springfield", 9), ("e", "Spring", 8), ("e", "Rome", 7), ("e", "Rome2", 7), ("e", "Oslo", 2)]
    counts = spark.createDataFrame(rows, "event_id string, word string, place long")
    many = spark.range(30_000).select(F.lit("e").alias("event_id"), F.format_string("p%05d", "id").alias("word"), F.lit(1).cast("long").alias("place"))
    began = time.time()
    assert [r.location for r in entities.location(counts.unionByName(many)).collect()] == ["Springfield、Rome、Oslo"]
    assert time.time() - began < 8


def test_entities_of_reports_come_from_whole_texts(spark, tmp_path):
    docs = spark.createDataFrame([("e", 1, "title", "x " * 400 + "the Rome Rome 王 明明 王")], "event_id string, doc_id long, title string, content string")
    tags = spark.createDataFrame([("Rome", "place"), ("明明", "person"), ("王", "person")], "word string, tag string")
    for surnames in ("", "王"):
        found = {r.word: (r.person, r.place, r.storm) for r in entities.entity_counts(docs, tags, ["the"], surnames).collect()}
        assert found == {"Rome": (0, 1, 1), "明明": (1, 0, 0)}
    assert entities.entity_counts(docs, tags, ["the"], chars=500).count() == 0
    # Two places of the titles, the second of which stands more often behind the first 500 characters.
    a, b = [w for w in (f"place{k}" for k in range(100)) if int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 3 == 1][:2]
    rows = [(k, f"{a if k % 2 else b} {' '.join(rng.choices('abcdefgh', k=9))}\n" + " ".join(f"{k}{w}" for w in rng.choices("pqrstuvwxyz", k=300)) + f" {b}" * 2, "en", "src1", 10) for rng in [random.Random(1)] for k in range(1, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("analyze_event", "group_reports"):
        assert [r.location for r in catalog.queries()[name](spark, str(tmp_path)).collect()] == [f"{b}、{a}"]
