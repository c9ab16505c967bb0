"""Small cases of text, dedup, credibility, propagation, clustering and lookups."""

import html
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import automaton
from eventloom.functions import text as tx
from eventloom.functions import times as tm
from eventloom.functions import values as vl
from eventloom.operators import cluster, dedup, entities, lookups, ml, report, vectors
from eventloom.sources import landed


def one(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in inputs.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, seconds",
    [("45292", 1704067200), ("1704067200", 1704067200), ("2024-01-01 00:00:00", 1704067200), ("2024-01-01T00:00:01", 1704067201), ("2024-01-01", 1704067200), ("soon", None), ("2024-13-01", None), (None, None)],
)
def test_publish_time(spark, text, seconds):
    assert one(spark, tm.parse_publish_time(F.col("t")), t=text) == seconds


def test_times_of_other_forms(spark):
    assert one(spark, tm.parse_publish_time_lenient(F.col("t")), t="20240101000000") == 1704067200
    assert one(spark, tm.parse_publish_time_lenient(F.col("t")), t="99999999999999") is None
    assert one(spark, tm.parse_weibo_time(F.col("t")), t="Mon Jul 01 08:30:00 +0800 2024") == "2024-07-01 08:30:00"
    with pytest.raises(Exception, match="unknown publish time"):
        one(spark, tm.parse_publish_time(F.col("t"), strict=True), t="soon")


def test_tokens(spark):
    assert one(spark, tx.tokenize(F.col("t"), ["暴雨"]), t="洪水 暴雨预警 2024 a go 12") == ["go", "洪水", "雨预", "预警"]
    assert one(spark, tx.shingles(F.col("t")), t="a b") == ["ab"]
    assert one(spark, tx.shingles(F.col("t")), t=" ") == []
    assert one(spark, tx.char_bigrams(F.col("t")), t="a") == []
    assert one(spark, tx.sentences(F.col("t")), t="第一句话很长。短。第二句话也很长！") == ["第一句话很长", "第二句话也很长"]


def test_clean_content(spark):
    from eventloom.values import BOILERPLATE

    t = "&lt;b&gt;​ x \n\n\n\n  声明：本文内容仅代表作者个人观点，与新浪网无关。y  "
    assert one(spark, tx.clean_content(F.col("t"), F.lit("新浪新闻"), BOILERPLATE), t=t) == "<b> x\n\ny"
    assert one(spark, tx.clean_content(F.col("t")), t=None) == ""


def test_labels(spark):
    assert [one(spark, vl.label_from_proba(F.col("p"), 1 - F.col("p")), p=p) for p in (0.55, 0.8, 0.1)] == ["neutral", "positive", "negative"]
    assert [one(spark, vl.to_int_count(F.col("v")), v=v) for v in ("3.9", "-2", "x", "", None)] == [3, 0, 0, 0, 0]
    assert one(spark, vl.percent_norm(F.col("v")), v=0.123) == pytest.approx(12.3)
    rows = spark.createDataFrame([(" POS ",), ("0",)], "label string")
    assert [r.label for r in landed.labelled(rows).collect()] == ["positive", "negative"]
    with pytest.raises(Exception, match="unknown label"):
        landed.labelled(spark.createDataFrame([("good",)], "label string")).collect()


def test_simhash_forms_agree_and_near_texts_are_near(spark):
    texts = ["the river rose over the banks and the town was cut off " * 3, "the river rose over the banks and the village was cut off " * 3, "a new phone was shown on stage with three cameras " * 3, "ab", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    fast = {r.doc_id: r.f for r in df.select("doc_id", dedup.simhash64(F.col("text")).alias("f")).collect()}
    native = {r.doc_id: r.fingerprint for r in dedup.simhash64_native(df).collect()}
    assert {k: v for k, v in fast.items() if v is not None} == native and fast[4] is None and fast[5] is None

    def far(a, b):
        return bin((a ^ b) & (2**64 - 1)).count("1")

    assert far(fast[0], fast[1]) < far(fast[0], fast[2]) / 2


def test_greedy_dedup_equals_the_rule(spark):
    random.seed(7)
    base = [random.getrandbits(63) for _ in range(12)]
    prints = []
    for i in range(90):
        f = random.choice(base)
        for _ in range(random.randint(0, 4)):
            f ^= 1 << random.randint(0, 62)
        prints.append((i, f))
    kept = []
    for i, f in prints:
        if all(bin(f ^ g).count("1") > 3 for _, g in kept):
            kept.append((i, f))
    df = spark.createDataFrame(prints, "seq long, fingerprint long")
    assert sorted(r.seq for r in dedup.near_dup_greedy(df).where("kept").collect()) == [i for i, _ in kept]
    counts = dedup.comment_dup_count(df).collect()
    assert sum(r.duplicate_count for r in counts) == len(prints) and len(counts) == len(kept)
    assert dedup.near_dup_greedy(df.limit(0)).count() == 0


def test_store_and_url(spark):
    new = spark.createDataFrame([(1, 0b1111, "a"), (2, 1 << 40, "b"), (3, (1 << 40) | 1, "b")], "seq long, fingerprint long, source_url string")
    old = spark.createDataFrame([(0b111, "a")], "fingerprint long, source_url string")
    assert [r.seq for r in dedup.dedup_store(new, old).collect()] == [2]
    assert [r.seq for r in dedup.dedup_url(new, old).collect()] == [2]


def propagation_posts(spark):
    rows = [
        ("p1", 1, 8, "知乎", "普通用户", 0, 0, 0),
        ("p2", 2, 33, "微博", "头部认证个人", 100, 500, 0),
        ("p3", 3, 58, "新浪新闻", "官方平台", 0, 0, 0),
        ("p4", 4, 44, "微博", "普通用户", 2000, 9000, 800),
    ]
    df = spark.createDataFrame(rows, "doc_id string, seq int, publish_s long, platform string, verification_type string, repost_count int, like_count int, comment_count int")
    return df.withColumns({"event_id": F.lit("e"), "author": F.lit(""), "title": F.lit("t"), "content": F.lit("c")})


def test_propagation(spark):
    p = propagation_posts(spark)
    roles = {r.doc_id: r.role for r in report.key_nodes(p).collect()}
    assert roles == {"p1": "初始爆料", "p2": "首次大V发声", "p3": "首次官方媒体介入", "p4": "传播高峰"}
    chain = [(r.platform, r.target) for r in report.platform_chain(p).orderBy("pos").collect()]
    assert chain == [("知乎", "微博"), ("微博", "新浪新闻"), ("新浪新闻", None)]
    assert [r.doc_id for r in report.top_influencers(p).orderBy("rank").collect()] == ["p4", "p2"]
    assert report.key_nodes(p.limit(0)).count() == 0


def test_authenticity(spark):
    r = report.authenticity(propagation_posts(spark)).first()
    assert r.credibility_score == pytest.approx((0.1 + 0.5 + 1 + 0.1) / 4, abs=1e-3)
    assert (r.official_ratio, r.verified_ratio, r.plain_user_ratio) == (0.25, 0.5, 0.5)


def test_purity_and_metrics(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 0, 1, 1], ["a", "a", "b", "b", "b"])), "p int, t string")
    assert vectors.purity(rows, "p", "t").first().purity == pytest.approx(0.8)
    assert vectors.purity(rows.limit(0), "p", "t").first().purity == 0
    m = lookups.classif_metrics(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string"))
    assert {r.label: (r.precision, r.recall) for r in m.collect()} == {"a": (1.0, 0.5), "b": (0.5, 1.0)}


TOPICS = {"flood": "river flood rescue bank water rain town evacuate", "phone": "phone camera launch screen battery price chip stage", "food": "canteen kitchen hygiene student meal price inspect fine"}


def planted(spark):
    random.seed(3)
    rows = []
    for i in range(60):
        name = random.choice(list(TOPICS))
        rows.append((i, i, random.choices(TOPICS[name].split(), k=9), name))
    return spark.createDataFrame(rows, "seq long, publish_s long, tokens array<string>, name string")


def test_single_pass_finds_planted_events(spark):
    docs = planted(spark)
    assigned, centroids = cluster.single_pass(docs, 0.2)
    out = docs.join(assigned, "seq")
    assert out.count() == 60 and vectors.purity(out, "cluster_id", "name").first().purity >= 0.95
    assert assigned.select("cluster_id").distinct().count() <= 9
    assert centroids.select("cluster_id").distinct().count() == assigned.select("cluster_id").distinct().count()


def one_after_another(rows, threshold):
    """The rule as a loop: each document in order of time joins the nearest centroid or opens a cluster."""
    n, df = len(rows), Counter(t for _, tokens in rows for t in set(tokens))
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    sums, sizes, out = [], [], {}
    for seq, tokens in rows:
        v = {t: k * idf[t] for t, k in Counter(tokens).items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        v = {t: x / length for t, x in v.items()}
        scores = [sum(x * s.get(t, 0.0) for t, x in v.items()) / k for s, k in zip(sums, sizes)]
        at = max(range(len(scores)), key=lambda i: (scores[i], -i), default=None)
        if at is None or scores[at] < threshold or scores[at] <= 0:
            sums.append(Counter()), sizes.append(0)
            at = len(sums) - 1
        sums[at].update(v)
        sizes[at] += 1
        out[seq] = at
    return out


@pytest.mark.parametrize("batch, listed", [(2048, 64), (7, 64), (11, 2), (16, 1)])
def test_single_pass_is_the_rule(spark, monkeypatch, batch, listed):
    """Whatever the size of batches and lists; documents without a token and equal ones included."""
    monkeypatch.setattr(cluster, "LISTED", listed)
    monkeypatch.setattr(cluster, "RARE", 3)
    rows = [(r.seq, r.tokens) for r in planted(spark).orderBy("seq").collect()]
    rows += [(60, []), (61, rows[3][1]), (62, []), (63, ["alone"]), (64, rows[3][1]), (65, ["alone", "alone"])]
    docs = spark.createDataFrame([(a, a, t) for a, t in rows], "seq long, publish_s long, tokens array<string>")
    for threshold in (0.2, 0.45):
        found, centroids = cluster.single_pass(docs, threshold, batch=batch)
        assert {r.seq: r.cluster_id for r in found.collect()} == one_after_another(rows, threshold)
    assert centroids.count() > 0


def test_single_pass_is_the_rule_on_texts(spark, caplog):
    """All documents of a larger table, in few rounds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("publish_s"), tx.tokenize(F.col("text")).alias("tokens"))
    rows = [(r.seq, r.tokens) for r in docs.orderBy("seq").collect()]
    with caplog.at_level("INFO", "eventloom.operators.cluster"):
        found = {r.seq: r.cluster_id for r in cluster.single_pass(docs, 0.04, batch=256)[0].collect()}
    assert found == one_after_another(rows, 0.04) and len([r for r in caplog.records if r.getMessage().startswith("round")]) < 50


def test_single_pass_without_rows(spark):
    found, centroids = cluster.single_pass(spark.createDataFrame([], "seq long, publish_s long, tokens array<string>"))
    assert found.count() == centroids.count() == 0


def test_products_of_a_batch():
    rng = random.Random(2)
    entries = sorted({(rng.randrange(30), min(rng.randrange(400), rng.randrange(400))): rng.random() for _ in range(2000)}.items())
    entries += [((d, 999), 0.5) for d in range(30)]
    d, t, w = (np.array(x) for x in ([e[0][0] for e in entries], [e[0][1] for e in entries], [e[1] for e in entries]))
    dense = np.zeros((30, 1000))
    dense[d, t] = w
    out = cluster.gram(d, t, w, 30)
    off = ~np.eye(30, dtype=bool)
    assert np.allclose(out[off], (dense @ dense.T)[off])


def test_rows_are_numbered_in_order(spark):
    random.seed(5)
    values = [random.randrange(50) for _ in range(500)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    out = {r.i: r.pos for r in lookups.numbered(rows, F.desc("v"), "i").collect()}
    assert [i for i, _ in sorted(out.items(), key=lambda x: x[1])] == [i for _, i in sorted((-v, i) for i, v in enumerate(values))]
    assert sorted(out.values()) == list(range(1, 501))
    assert lookups.numbered(rows.limit(0), "v").count() == 0


def test_character_references(spark):
    texts = ["&#8220;x&#x27;&#X41; &mdash;&hellip; &lt;b&gt; &amp;amp; &NotEqualTilde;", "&copy &copyx a&b &; & &nothing; &#; &#x; &#xZ;", "&#128;&#150;&#0;&#x110000;&#xD800;", "none", "", "&"]
    out = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(tx.html_unescape(F.col("t")).alias("u")).collect()
    assert [r.u for r in out] == [*map(html.unescape, texts), None]


def test_events_without_nodes_show_their_platforms(spark):
    p = propagation_posts(spark)
    chain = report.platform_chain(p.withColumn("event_id", F.lit("other")))
    out = report.propagation_path(report.key_nodes(p), chain).where("event_id = 'other'").orderBy("pos").collect()
    assert out and [r.category for r in out] == [0] + [3] * (len(out) - 1)
    assert [r.target for r in out] == [r.name for r in out[1:]] + [None] and all(34 <= r.size <= 66 for r in out)


def test_keywords_prefer_distinctive_terms(spark):
    docs = spark.createDataFrame([("e", 1, ["rain", "rain", "town"]), ("e", 2, ["town", "phone"]), ("e", 3, ["town"])], "event_id string, doc_id int, tokens array<string>")
    totals = docs.groupBy("event_id").agg(F.count(F.lit(1)).alias("total"))
    top = vectors.event_keywords(vectors.doc_keywords(vectors.term_counts(docs, "event_id", "doc_id"), totals, 2)).orderBy("rank").first()
    assert top.word == "rain" and top.weight == 1.0


def test_list_events_pages(spark):
    ev = spark.createDataFrame([(f"e{i}", float(i) if i else None) for i in range(5)], "event_id string, heat double")
    kw = spark.createDataFrame([("e4", "w", 0)], "event_id string, word string, rank int")
    rows = lookups.list_events(ev, kw, 1, 2).orderBy(F.desc("heat")).collect()
    assert [r.heat for r in rows] == [4.0, 3.0] and rows[0].total == 5 and rows[0].total_pages == 3 and rows[1].keywords == []
    assert lookups.list_events(ev, kw, 3, 2).first().heat is None


def test_dictionary_and_entities(spark):
    docs = spark.createDataFrame([(1, "台风美莎克登陆台州市")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("台风",), ("登陆",), ("台州",), ("台州市",)], "word string")
    assert [r.word for r in entities.dict_segment(docs, lexicon).orderBy("pos").collect()] == ["台风", "登陆", "台州市"]
    counts = spark.createDataFrame([("e", "广西", 0, 5, 0, 0, 0), ("e", "广西南宁", 0, 3, 0, 0, 0), ("e", "王明", 3, 0, 0, 0, 0), ("e", "贵港", 0, 2, 0, 0, 0)], "event_id string, word string, person int, place int, org int, storm int, other int")
    assert entities.location(counts).first().location == "广西、贵港"
    assert entities.people(counts, surnames="王李").first().people == ["王明"]
    words = spark.createDataFrame([("e", "王明")], "event_id string, word string")
    assert entities.people(counts, surnames="王李", keywords=words).count() == 0


def test_pieces_of_names_are_one_person(spark):
    docs = spark.createDataFrame([("e", 1, "", "斯卡 洛尼 王明 李丽 斯卡 洛尼 x 新华社")], "event_id string, doc_id int, title string, content string")
    tags = spark.createDataFrame([(w, "person") for w in ("斯卡", "洛尼", "王明", "李丽", "新华社")], "word string, tag string")
    out = {r.word: (r.person, r.other) for r in entities.entity_counts(docs, tags, surnames="王李").collect()}
    assert out == {"斯卡洛尼": (2, 0), "王明": (1, 0), "李丽": (1, 0), "新华社": (0, 1)}


def test_models(spark):
    rows = [(i, f"good great fine day number {i}" if i % 2 else f"bad awful poor day number {i}", "positive" if i % 2 else "negative") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    kind, model, scores = ml.train_and_choose(df)
    assert scores[kind] >= 0.9
    out = ml.predict(model, df.select("doc_id", "text"))
    assert {r.label for r in out.collect()} <= {"positive", "negative", "neutral"}
    with pytest.raises(Exception, match="only positive and negative"):
        ml.train(df.withColumn("label", F.lit("neutral")))


def test_landed_json(spark):
    cards = '[{"mblog":{"mblogid":"a","user":{"id":1,"screen_name":"新华社"}},"card_group":[{"mblog":{"mblogid":"b","user":{"id":2,"verified_type":0}}},{"mblog":{"mblogid":"c","user":{}}}]},{"mblog":{"mblogid":"a","user":{"id":1}}}]'
    out = landed.flat_weibo_cards(spark.createDataFrame([(1, cards)], "page int, json string")).orderBy("post_id").collect()
    assert [(r.post_id, r.verification_type) for r in out] == [("a", "官方平台"), ("b", "认证个人")]


def test_pairs_and_copies_are_all_near_rows(spark, sf):
    """Pairs of first rows and copies with their firsts, against all pairs."""
    prints = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), dedup.simhash64(F.col("text")).alias("fingerprint")).cache()
    rows = sorted((r.seq, r.fingerprint & (1 << 64) - 1) for r in prints.collect() if r.fingerprint is not None)
    first = {}
    for seq, p in rows:
        first.setdefault(p, seq)
    expected = {(first[p], seq, 0) for seq, p in rows if first[p] != seq}
    kinds = sorted((seq, p) for p, seq in first.items())
    expected |= {(a, b, (x ^ y).bit_count()) for i, (b, y) in enumerate(kinds) for a, x in kinds[:i] if (x ^ y).bit_count() <= 3}
    got = dedup.near_dup_pairs(prints).unionByName(dedup.copies_of(prints)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    # The greedy rule by a loop.
    kept = []
    for seq, p in rows:
        if not any((p ^ q).bit_count() <= 3 for _, q in kept):
            kept.append((seq, p))
    found = {r.seq for r in dedup.near_dup_greedy(prints).where("kept and fingerprint is not null").collect()}
    assert found == {seq for seq, _ in kept}


@pytest.mark.parametrize("small", [False, True])
def test_greedy_rule_in_large_near_groups(spark, monkeypatch, small):
    """Thousands of fingerprints within three bits of one centre, chains and scopes, against the loop; no row a pair comes out."""
    if small:
        for name, value in (("RIGHT_ROWS", 50), ("LEFT_ROWS", 90), ("TILE", 7), ("SETTLED", 200)):
            monkeypatch.setattr(dedup, name, value)
    rng = random.Random(11)
    centre, rows = rng.getrandbits(64), []
    for i in range(600 if small else 6000):
        p = centre
        for bit in rng.sample(range(64), rng.randrange(4)):
            p ^= 1 << bit
        rows.append((i, ("a", "b", "b", None)[i % 4], p - (1 << 64) if p >> 63 else p))
    chain = 0
    for i in range(200):
        chain ^= 1 << (i % 60)
        rows.append((10_000 + i, "c", chain))
    rows += [(20_000, "a", None), (20_001, None, None), (20_002, "d", 5)]
    df = spark.createDataFrame(rows, "seq long, event_id string, fingerprint long")
    for scope in (None, "event_id"):
        kept, of = {}, {}
        for seq, name, p in rows:
            if p is not None:
                own = kept.setdefault(name if scope else 0, [])
                near = [s for s, q in own if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3]
                if near:
                    of[seq] = near[0]
                else:
                    own.append((seq, p))
        want = {s for own in kept.values() for s, _ in own} | {20_000, 20_001}
        assert {r.seq for r in dedup.near_dup_greedy(df, 3, scope).where("kept").collect()} == want
        if not scope:
            counts = Counter(of.values())
            assert {r.seq: r.duplicate_count for r in dedup.comment_dup_count(df).collect()} == {s: 1 + counts[s] for s in want}
    left, right = df.where("seq % 2 = 0"), df.where("seq % 3 = 0 and event_id <> 'b'")
    for earlier in (True, False):
        want = {}
        for seq, _, p in rows:
            near = [s for s, name, q in rows if s % 3 == 0 and name in ("a", "c", "d") and None not in (p, q) and s != seq and (s < seq or not earlier) and ((p ^ q) & (1 << 64) - 1).bit_count() <= 3] if small and seq % 2 == 0 else []
            if near:
                want[seq] = near[0]
        if small:
            assert {r.seq: r.of for r in dedup.first_near(left, right, 3, earlier=earlier).collect()} == want


def test_terms_are_counted_within_a_row(spark):
    rows = [(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["x"]), (5, list("zyxzyz"))]
    out = vectors.term_counts(spark.createDataFrame(rows, "doc_id int, tokens array<string>"), "doc_id")
    assert out.dtypes == [("doc_id", "int"), ("term", "string"), ("n", "bigint")]
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "b", 3), (4, "x", 1), (5, "x", 1), (5, "y", 2), (5, "z", 3)]


def test_bounded_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FEW_PRODUCTS", 0)
    rng = random.Random(9)
    texts = [(i, rng.choices([f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(60)], k=25)) for i in range(300)] + [(300, []), (301, ["only"]), (302, ["t1"] * 9)]
    texts += [(400 + i, texts[i][1]) for i in range(20)]
    df = spark.createDataFrame(texts, "event_id long, tokens array<string>")
    small = sorted(map(tuple, vectors.similar_events(df).select("event_id", "other", "score", "rank").collect()))
    n, df_ = len(texts), Counter(t for _, tokens in texts for t in set(tokens))
    unit = {}
    for i, tokens in texts:
        v = {t: k * (math.log((n + 1) / (df_[t] + 1)) + 1) for t, k in Counter(tokens).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        unit[i] = {t: x / length for t, x in v.items()}
    want = []
    for i, v in unit.items():
        found = sorted((-math.floor(sum(x * u.get(t, 0) for t, x in v.items()) * 1e4 + 0.5) / 1e4, j) for j, u in unit.items() if j != i)
        want += [(i, j, -s, r + 1) for r, (s, j) in enumerate(found[:5]) if s < 0]
    assert len(small) == len(want)
    assert {(a[0], a[3]): a[2] for a in small} == pytest.approx({(a[0], a[3]): a[2] for a in want}, abs=1.01e-4)
    # Comments to the nearest of many clusters; ties go to the smaller id, nothing shared to 0.
    index = spark.createDataFrame([(i, t, w) for i, v in unit.items() for t, w in v.items()], "cluster_id long, term string, w double")
    comments = spark.createDataFrame([(1000 + i, t, w) for i, v in list(unit.items())[::3] for t, w in v.items()] + [(5000, "none", 1.0)], "comment_id long, term string, w double")
    keys = comments.select("comment_id").distinct()
    found = {r.comment_id: r.cluster_id for r in vectors.assign_nearest(comments, index, keys).collect()}
    for i, v in list(unit.items())[::3]:
        best = max((round(sum(x * u.get(t, 0) for t, x in v.items()), 9), -j) for j, u in unit.items())
        assert not v or found[1000 + i] == (-best[1] if best[0] > 0 else 0)
    assert found[5000] == 0


def test_few_pairs_are_scored(spark, monkeypatch):
    """20,000 events of skewed terms: what bounds leave is under a twentieth of all pairs."""
    seen = []
    plain = vectors.stash

    def counted(df, label):
        out = plain(df, label)
        if label == "hopeful":
            seen.append(out.count())
        return out

    monkeypatch.setattr(vectors, "stash", counted)
    rng = random.Random(4)
    rows = []
    for i in range(20_000):
        theme = rng.randrange(2000)
        rows.append((i, [f"c{int(rng.paretovariate(0.8)) % 3000}" for _ in range(12)] + [f"s{theme}_{rng.randrange(8)}" for _ in range(6)]))
    out = vectors.similar_events(spark.createDataFrame(rows, "event_id long, tokens array<string>"))
    assert out.count() > 90_000 and seen and seen[0] < 0.05 * 20_000 * 19_999


def test_split_is_exact_by_label(spark):
    rows = [(i, f"text {i % 40}", "positive" if i % 3 else "negative") for i in range(503)] + [(7000, "same", "negative")] * 90
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    fit, held = ml.split(df)
    again = ml.split(df.repartition(5))[1]
    n = Counter(r[2] for r in rows)
    assert Counter(r.label for r in held.collect()) == {k: int(0.2 * v + 0.5) for k, v in n.items()}
    assert sorted(map(tuple, fit.unionByName(held).collect())) == sorted(rows) and sorted(map(tuple, again.collect())) == sorted(map(tuple, held.collect()))
    for few in (df.limit(0), df.limit(1)):
        assert sum(part.count() for part in ml.split(few)) == few.count()
    # One label whose rows are all equal.
    fit, held = ml.split(df.where("doc_id = 7000"))
    assert (fit.count(), held.count()) == (72, 18)


def test_models_are_kept_by_kind(spark, tmp_path):
    rows = [(i, f"good great fine day number {i}" if i % 2 else f"bad awful poor day number {i}", "positive" if i % 2 else "negative") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        ml.newest_model(spark, folder, "article")
    first, second = ml.train(df, "nb"), ml.train(df.withColumn("label", F.when(F.col("label") == "positive", "negative").otherwise("positive")), "lr")
    assert ml.save_model(first, spark, folder, "comment").endswith("text_type=comment/version=00000001")
    assert ml.newest_model(spark, folder, "article") == (f"{folder}/text_type=comment/version=00000001", True)
    assert ml.domain_shift(folder, "article", df)[0] >= 0.9
    # The newest one counts: this one was taught the opposite.
    ml.save_model(second, spark, folder, "comment")
    assert ml.newest_model(spark, folder, "comment") == (f"{folder}/text_type=comment/version=00000002", False)
    assert ml.domain_shift(folder, "comment", df)[0] <= 0.1 and ml.domain_shift(folder, "comment", df.limit(0)) == (0.0, 0)
    ml.save_model(first, spark, folder, "article")
    long_text = df.withColumn("text", F.concat("text", F.repeat(F.lit(" number"), 40)))
    both = df.unionByName(long_text.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(spark.createDataFrame([(999, None, "positive")], df.schema))
    out = {r.doc_id: r.label for r in ml.predict_stored(folder, both.drop("label"), threshold=0.0).collect()}
    assert len(out) == 121 and all(out[i] == ("negative" if i % 2 else "positive") for i in range(60)) and sum(out[100 + i] == ("positive" if i % 2 else "negative") for i in range(60)) >= 50
    for bad in ("novel", "auto"):
        with pytest.raises(ValueError):
            ml.newest_model(spark, folder, bad)
    with pytest.raises(ValueError):
        ml.save_model(first, spark, folder, "novel")


def test_many_words_in_one_pass(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"] + ["ab", "", "洪水"]
    texts = [(i, "".join(rng.choice("abcdefgh 洪水\n") for _ in range(rng.randrange(120)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(texts, "key long, text string")
    want = {(i, w) for i, t in texts for w in words if w and w in (t or "")}
    lexicon = spark.createDataFrame([(w,) for w in [*words, "ab"]], "word string")
    for chars in (None, 200):
        assert sorted(map(tuple, automaton.matches(df, lexicon, chars).collect())) == sorted(want)
    assert automaton.matches(df, lexicon.limit(0)).count() == automaton.matches(df.limit(0), lexicon).count() == 0
    tokens = df.select("key", F.split("text", " ").alias("t"))
    out = tokens.select("key", tx.contains_any(F.col("t"), words[1:-2]).alias("many"), F.size(F.filter("t", lambda x: F.rlike(x, F.lit("|".join(words[1:-2]))))).alias("few")).where("key < 60").collect()
    assert all(r.many == r.few for r in out) and sum(r.many for r in out) > 20
    items = spark.createDataFrame([(1, "The FLOOD came", "x", None), (2, "no", None, "a flood"), (3, "flo", "od", None)], "doc_id int, title string, keywords string, summary string")
    keys = spark.createDataFrame([("Flood",), ("no",), ("CAME",), ("lood c",)], "keyword string")
    assert sorted(map(tuple, landed.cand_keyword_matches(items, keys).collect())) == [(1, "CAME"), (1, "Flood"), (1, "lood c"), (2, "Flood"), (2, "no")]


def test_segmentation_is_the_most_likely_path(spark):
    rng = random.Random(12)
    freq = {"".join(rng.choice("台风登陆州市") for _ in range(rng.randrange(2, 5))): rng.randrange(1, 50) for _ in range(60)}
    texts = [(i, "".join(rng.choice("台风登陆州市 x") for _ in range(rng.randrange(60)))) for i in range(50)] + [(50, None), (51, "")]
    total = sum(freq.values())
    want = []
    for i, t in texts:
        t = t or ""
        best, to = [0.0] * (len(t) + 1), [0] * len(t)
        for x in range(len(t) - 1, -1, -1):
            ways = [(best[x + 1] - math.log(total), x + 1)] + [(math.log(freq[t[x:y]] / total) + best[y], y) for y in range(x + 2, len(t) + 1) if t[x:y] in freq]
            best[x], to[x] = max(ways)
        x = 0
        while x < len(t):
            want += [(i, x + 1, t[x : to[x]])] if to[x] - x > 1 else []
            x = to[x]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    lexicon = spark.createDataFrame(list(freq.items()) + [("台", 9), ("无", 0)], "word string, n int")
    for chars in (10**6, 1):
        assert sorted(map(tuple, entities.dict_segment(docs, lexicon, chars).collect())) == sorted(want)
    assert entities.dict_segment(docs, lexicon.limit(0)).count() == 0
    plan = entities.dict_segment(docs, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_index_of_grams_finds_what_like_finds(spark, tmp_path):
    rng = random.Random(6)
    events = [(f"e{i}", "".join(rng.choice("abc_%") for _ in range(rng.randrange(14))), "high") for i in range(300)] + [("x", None, "low")]
    words = [(f"e{rng.randrange(320)}", "".join(rng.choice("abc") for _ in range(6)), 0) for _ in range(200)]
    ev, kw = spark.createDataFrame(events, "event_id string, title string, risk_level string"), spark.createDataFrame(words, "event_id string, word string, rank int")
    for name, table in (("t", lookups.grams_of(ev, "event_id", "title")), ("w", lookups.grams_of(kw, "word", "word"))):
        lookups.save_grams(table, f"{tmp_path}/{name}")
    t, w = (spark.read.parquet(f"{tmp_path}/{name}") for name in "tw")
    for q, escape in (("abc", False), ("ab%ca", False), ("abca_b", False), ("a_bc%", True), ("ab", False), ("cabca", True), ("a\\_bca", False), ("zzzz", False)):
        plain = sorted(r.event_id for r in lookups.list_filter(ev, kw, None, q, escape).collect())
        assert sorted(r.event_id for r in lookups.list_filter(ev, kw, None, q, escape, t, w).collect()) == plain
    # A search reads the folders of its grams only.
    assert len(lookups.gram_search(t, "abc").inputFiles()) >= 1 and "part" in lookups.gram_search(t, "abca")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_main_content_of_pages(spark):
    para = "A paragraph of the article that is long enough to be content, with <a href='#'>one link</a> in it."
    page = f"""<html><head><title> T </title><meta property="article:published_time" content="2024-05-06T07:08:09+08:00"></head><body>
<nav><p>Home, a long enough line of navigation text here</p></nav><header>Site of long names and more</header><div class="main-ad big">Buy this long advertised thing now or never</div>
<div id="content"><h1>Title</h1><p>{para}</p><p>Short.</p><p>{para}</p><ul><li><a href=1>a list of links that goes on</a></li><li><a href=2>another list of links here</a></li></ul></div>
<div class="related links">Related: a long text of other things to read</div><p>lone</p><footer>All rights reserved, a long line of text</footer></body></html>"""
    plain = "A paragraph of the article that is long enough to be content, with one link in it."
    rows = [
        (1, page), (2, "<body><p>too short</p></body>"), (3, None), (4, ""),
        (5, f"<h1>Only heading</h1><main><p>{para}</p></main><p>Outside of the main part, a long text too</p><time datetime='2024-01-01'>"),
        (6, f"<article><p>{para}</p></article><div>Outside of the article there is a long text</div><meta content='2024-01-01 10:00' name='pubdate'>"),
    ]
    out = {r.page_id: (r.title, r.body, r.publish_s) for r in landed.html_article(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id int, url string, html string")).collect()}
    assert out == {1: ("T", f"Title\n{plain}\nShort.\n{plain}", 1714979289), 5: ("Only heading", plain, 1704067200), 6: ("", plain, 1704103200)}
