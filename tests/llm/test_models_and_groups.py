"""Classifiers, URL filters, near-duplicates, mixing and the pipeline."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

BASE = [f"w{k}x" for k in range(400)]


def prose(rng, n=60):
    return " ".join(rng.choices(BASE, k=n))


def corpus(spark, n=400):
    """Documents and labels: every fifth toxic, every seventh shouting."""
    rng, docs, labels = random.Random(5), [], []
    for k in range(n):
        text = prose(rng)
        toxic, bad = k % 5 == 0, k % 7 == 0
        if toxic:
            text += " vilewordish " + rng.choice(["nastything", "horridone"])
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(1000, None), (1001, ""), (None, "text"), (1002, "long " * 100_000)]


def test_toxicity_held_out(spark):
    from tapeworks.llm import toxicity

    docs, labels = corpus(spark)
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    got = toxicity.with_toxicity(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    odd = toxicity.with_toxicity(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert odd[0].score == odd[1].score
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert toxicity.with_toxicity(docs, none).where("predicted = 1").count() == 0
    assert toxicity.with_toxicity(docs.limit(0), model).collect() == []


def test_negative_risk_is_corrected():
    from tapeworks.llm.toxicity import fit

    rng = np.random.default_rng(1)
    noise = lambda: rng.choice(np.arange(100, 400), 20, replace=False)
    positive = [np.append(noise(), 7) for _ in range(60)]
    unlabelled = [np.append(noise(), 7) if k % 10 == 0 else noise() for k in range(600)]
    w, b = fit(positive, unlabelled, 0.1)
    assert w[7] + b > 0 > b and (w >= 0).all()


def test_toxicity_where_much_is_toxic(spark):
    """A third of the rows are copies of one toxic text, and a tenth are other toxic ones: clean rows stay."""
    from tapeworks.llm import toxicity

    rng, rows = random.Random(8), []
    copied = prose(rng) + " vilewordish nastything"
    for k in range(1500):
        kind = 2 if k % 3 == 0 else int(k % 10 == 1)
        rows.append((k, copied if kind == 2 else prose(rng) + (" vilewordish horridone" if kind else ""), int(kind > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"), ~toxicity.held_out(F.col("doc_id")))
    got = toxicity.with_toxicity(docs, model).collect()
    assert sum(r.toxic for r in got) / len(got) > 0.38
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97


def test_toxicity_scores_by_brute_force(spark):
    """Scores by a loop over every substring of every word; equal texts and repeated ids score alike."""
    import math
    import zlib

    from tapeworks.llm import toxicity

    docs, labels = corpus(spark)
    model = toxicity.learn(docs.union(docs), labels.union(labels), F.lit(True))
    again = toxicity.learn(docs.repartition(7), labels, F.lit(True))
    assert model.weights.keys() and model.weights == again.weights
    rows = [(k, r.text) for k, r in enumerate(docs.limit(60).collect())] + ODD + [(5, "VileWordish2vilewordish_horridone " + "y" * 300)]
    for r in toxicity.with_toxicity(spark.createDataFrame(rows, "doc_id long, text string").withColumn("x.y", F.lit(0)), model).collect():
        grams = set()
        for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split():
            m = f"<{w}>"
            grams |= {m} | {m[i:j] for i in range(len(m)) for j in range(i + 3, min(i + 5, len(m)) + 1)}
        ids = {zlib.crc32(g.encode()) % 2**toxicity.BITS for g in grams}
        z = model.bias + math.fsum(model.weights.get(i, 0) for i in ids)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_quality_held_out(spark):
    from tapeworks.llm import quality

    docs, labels = corpus(spark)
    space = quality.learn(docs, labels, ~quality.held_out(F.col("doc_id")))
    got = quality.with_quality(docs, space).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    odd = quality.with_quality(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("predicted", F.lit("clash")), space).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score
    empty = quality.learn(docs, labels.limit(0), F.lit(True))
    assert [r.score for r in quality.with_quality(docs.limit(2), empty).collect()] == [0.5, 0.5]


def test_labelled_sample(spark):
    from tapeworks.llm import quality

    assert quality.shares({0: 10, 1: 20}, 100) == {0: 10, 1: 20}
    assert quality.shares({0: 100, 1: 99_900}, 4000) == {0: 100, 1: 3900}
    assert quality.shares({0: 5_000, 1: 95_000}, 4000) == {0: 1000, 1: 3000}
    docs, labels = corpus(spark)
    gone = docs.where("doc_id % 2 = 1")
    space = quality.learn(gone.union(gone), labels.union(labels), F.lit(True), most=100)
    assert len(space.labels) == 100 and 25 <= (space.labels == 0).sum() <= 40
    long = "ab1" * 100_000
    assert quality._shape(long + "?")[-1] == "?" and quality._shape("Ab" * 200 + "9") != quality._shape("Ab" * 200 + "b")
    one = quality.with_quality(spark.createDataFrame([(1, "Same text"), (1, "Same text"), (2, "Same text")], "doc_id long, text string"), space).collect()
    assert len({r.score for r in one}) == 1 and len(one) == 3


def test_votes_by_brute_force():
    from tapeworks.llm.quality import SHARPNESS, Space

    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(4096, 30, replace=False)).astype(np.int32), rng.random(30).astype(np.float32)) for _ in range(80)]
    space = Space(rows, rng.integers(0, 2, 80), 20)
    v = space.vector(rows[:10])
    for x, got in zip(v, space.vote(v, 7)):
        cos = space.vectors @ x
        near = np.argsort(-cos)[:7]
        w = np.maximum(cos[near], 0) ** SHARPNESS
        assert abs((w * space.labels[near]).sum() / w.sum() - got) < 1e-5


def test_url_rules_and_trees(spark):
    from tapeworks.llm import urls

    model = urls.UrlModel(urls.labelled_urls(spark))
    cases = {
        "https://x.example.org/es/1": "example.org/es/", "http://example.org/en/12?q": "example.org/en/1", "http://EXAMPLE.org/fr/": "org/", "http://badexample.org/es/": "org/",
        "ftp://a.com/fr/x": "com/fr/", "http://a.com/de/#t": "com/de/", "http://a.com/de": None, "http://org": None, "http://www.cheap-pills.example.net/en/1": None,
        "http://garden.example.net/en/1": None, "no scheme": None, "": None, "http://a.com:80/fr/": None,
    }
    rows = [(k, u) for k, u in enumerate(cases)] + [(98, None), (None, "http://x.org/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), urls.RULES, model).collect()}
    assert [got[k].rule for k in range(len(cases))] == list(cases.values())
    assert got[0].verdict == "block" and got[2].verdict == "allow" and got[5].verdict == "block"
    assert got[8].verdict == "block" and got[9].verdict == "allow" and got[98].host == got[98].path == ""
    assert got[3].path == "/es/" and got[2].host == "example.org" and got[None].rule == "org/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), [], urls.UrlModel(urls.labelled_urls(spark).limit(0))).collect() == []


def test_case_expressions_are_the_fitted_trees(spark):
    """The probability of the expression equals that of Spark's own model, and held-out URLs of the rule are told."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from tapeworks.llm import urls

    known = urls.labelled_urls(spark)
    train, test = known.where("pmod(hash(url), 4) > 0").cache(), known.where("pmod(hash(url), 4) = 0")
    model = urls.UrlModel(train)
    frame = lambda df: urls.with_features(df, model.rates, model.base).withColumn("label", F.col("blocked").cast("double"))
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in urls.FEATURES], outputCol="features")
    fitted = GBTClassifier(maxIter=urls.TREES, maxDepth=urls.DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(rows.transform(frame(train.orderBy(F.xxhash64("url")).limit(urls.MOST_LABELLED))).select("features", "label").coalesce(1))
    odd = spark.createDataFrame([("x" * 20_000, 0), ("", 0), ("http://a", 1), ("http://a", 1)], "url string, blocked long")
    got = fitted.transform(rows.transform(frame(test.union(odd)).withColumn("own", model.score()))).select("own", "probability", "blocked", "prediction").collect()
    assert all(abs(r.own - r.probability[1]) < 1e-9 for r in got)
    assert sum(r.prediction == r.blocked for r in got) / len(got) > 0.95
    pages = odd.select(F.lit(1).cast("long").alias("page_id"), "url", F.lit(2).alias("score"), F.lit(3).alias("a.b"))
    assert urls.judge(pages, urls.RULES, model).count() == 4


def near_corpus():
    rng, rows = random.Random(9), []
    for g in range(6):
        base = [rng.choice(BASE) + str(rng.randrange(50)) for _ in range(150)]
        for _ in range((1, 2, 5, 12, 30, 3)[g]):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, rows[3][1].upper() + "!") for k in range(3)]
    return rows + [(900, None), (901, None), (902, ""), (903, ""), (904, "two words"), (905, "Two, words"), (None, rows[1][1]), (7, rows[7][1])]


def all_pairs(texts, threshold=0.8, share=1 / 1000):
    """(pairs at the threshold, TF-IDF vectors) by the definition alone: shingles as tuples of words, all pairs with one in common."""
    import math
    import re

    vectors, frequency, n = [], Counter(), len(texts)
    for t in texts:
        ws = re.findall(r"[^\x00-\x2f:-`{-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        vectors.append(Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else Counter())
        frequency.update(vectors[-1].keys())
    idf = {x: math.log(1 + n / max(1, f, share * n)) for x, f in frequency.items()}
    vectors = [{x: k * idf[x] for x, k in v.items()} for v in vectors]
    weight = [sum(v.values()) for v in vectors]
    holders = defaultdict(list)
    for k, v in enumerate(vectors):
        for x in v:
            holders[x].append(k)
    pairs = set()
    for k, v in enumerate(vectors):
        common = Counter()
        for x, w in v.items():
            for j in holders[x]:
                if j < k:
                    common[j] += min(w, vectors[j][x])
        pairs.update((j, k) for j, c in common.items() if c / (weight[j] + weight[k] - c) >= threshold)
    return pairs


def classes_of(n, pairs):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(k) for k in range(n)]


def test_near_duplicates_by_brute_force(spark):
    from tapeworks.llm import neardup

    rows = near_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    texts = [t for _, t in rows]
    equal = {(a, b) for b in range(len(rows)) for a in range(b) if texts[a] is not None and texts[a] == texts[b]}
    groups = defaultdict(list)
    for k, x in enumerate(classes_of(len(rows), all_pairs(texts) | equal)):
        groups[x].append(k)
    want = Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        want.update((str(rows[k][0]), min(ids), len(members)) for k in members)
    assert Counter((str(r.doc_id), r.class_id, r.class_size) for r in got) == want
    kept = neardup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_no_link_is_lost_among_two_thousand_texts(spark):
    """Groups from two to hundreds, a passage that many texts share, IDF from 1 in 2 to 1 in 2000: classes equal those of all pairs."""
    from tapeworks.llm import neardup

    rng, rows = random.Random(33), []
    passage = [f"p{k}" for k in range(80)]
    for size in [400, 120, 40, 15, *[4] * 30, *[2] * 150]:
        base = [rng.choice(BASE) + str(rng.randrange(50)) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    while len(rows) < 1600:
        rows.append(" ".join(passage + [f"{rng.choice(BASE)}{rng.randrange(30)}" for _ in range(rng.randrange(10, 60))]))
    while len(rows) < 2000:
        rows.append(" ".join(f"{rng.choice(BASE)}{rng.randrange(30)}" for _ in range(60)))
    pairs = all_pairs(rows)
    want = classes_of(len(rows), pairs)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(pairs) > 3000 and len(set(want)) > 600
    assert got == dict(enumerate(want))


def test_frequencies_are_exact(spark):
    from tapeworks.llm import neardup
    from tapeworks.llm.common import words

    rng = random.Random(4)
    rows = [(k, " ".join([f"c{j}" for j in range(12)][: 4 + k % 9] + rng.choices(BASE, k=8))) for k in range(90)] + [(90, None), (91, "")]
    w = neardup.frequencies(spark.createDataFrame(rows, "doc_id long, text string"), share=1 / 10)
    count = Counter(x for _, t in rows for x in neardup.shingles(words(t))[0].tolist())
    assert {x: np.log1p(92 / n) for x, n in count.items() if n >= 9.2} == pytest.approx(dict(zip(w.common.tolist(), w.idf.tolist())))
    assert len(w.common) >= 3 and w.rare == pytest.approx(np.log1p(10))


def test_pairs_in_large_buckets_by_brute_force(spark, monkeypatch):
    """Texts of one template, mostly unlike each other, all in one bucket; without rounds, so that none hides a loss."""
    from tapeworks.llm import neardup

    rng, rows = random.Random(21), []
    template = [f"t{k}" for k in range(100)]
    for k in range(60):
        own = [f"u{k}q{j}" for j in range(25 + k % 7)]
        rows.append((len(rows), " ".join(template + own)))
        if k % 3 == 0:
            rows.append((len(rows), " ".join(template + own[: -(k % 6) or None] + [f"e{k}q{j}" for j in range(rng.randrange(1, 3))])))
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    sketched = neardup.sketched
    monkeypatch.setattr(neardup, "sketched", lambda *a: sketched(*a).withColumn("__bands", F.array(F.lit(0).cast("long"))))
    want = classes_of(len(rows), all_pairs([t for _, t in rows]))
    assert 20 < len(set(want)) < len(rows) - 8
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == dict(enumerate(want))


def test_samples_collide_as_often_as_weights_overlap():
    from tapeworks.llm.neardup import Sampler, similarity

    rng, s, hits, want = np.random.default_rng(4), Sampler(), 0, 0.0
    for _ in range(80):
        h = np.sort(rng.integers(0, 1 << 63, 120, np.uint64))
        a, b = rng.integers(1, 5, 120).astype(float), rng.integers(1, 5, 120).astype(float)
        hits += (s(h, a) == s(h, b)).mean()
        want += similarity((h, a), (h, b))
    assert abs(hits - want) / 80 < 0.03


def test_components_of_paths_and_stars(spark):
    from tapeworks.llm.neardup import components

    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.row: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in range(100, 130)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pfair_lag_is_less_than_a_block():
    from tapeworks.llm.mixing import period, plan, whole

    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randint(1, 9) for _ in range(rng.randint(1, 7))]
        slots = period(w)
        assert sorted(x for s in slots for x in s) == list(range(sum(w)))
        assert all(abs(sum(x < t for x in s) - Fraction(w[k] * t, sum(w))) < 1 for t in range(sum(w) + 1) for k, s in enumerate(slots))
        blocks = [rng.randint(0, 20) for _ in w]
        placed = [start + (i - a) // len(s) * p + s[(i - a) % len(s)] for _, a, e, start, p, s in plan(blocks, w) for i in range(a, e)]
        assert sorted(placed) == list(range(sum(blocks)))
    assert whole([Fraction(1, 3), Fraction(2, 3)]) == [1, 2]


def test_weights_are_rounded_by_largest_remainders(spark):
    from tapeworks.llm.mixing import LONGEST_PERIOD, mixed, whole

    w = [Fraction(1, 100003), Fraction(3, 7), Fraction(1, 9973), Fraction(2, 11)]
    got = whole(w)
    assert sum(got) == LONGEST_PERIOD and got[0] >= 1
    assert all(abs(Fraction(g, sum(got)) - x / sum(w)) < Fraction(1, LONGEST_PERIOD) for g, x in zip(got, w))
    docs = spark.createDataFrame([(k, "t", f"s{k % 2}") for k in range(40)], "doc_id long, text string, source string")
    assert mixed(docs, {"s0": 0.00001}, block=4).count() == 40


def test_mixing_takes_any_columns(spark):
    from tapeworks.llm import mixing

    docs = spark.createDataFrame([(k % 9, None if k % 5 else "t", "s", k, 1, 2, 3, 4) for k in range(60)], ["doc_id", "text", "source", "a.b", "__key", "__hash", "__rank", "range"])
    got = mixing.mixed(docs, {}, block=8)
    assert got.columns[:8] == docs.columns and sorted(r["a.b"] for r in got.collect()) == list(range(60))
    assert sorted((r.mix_slot, r.mix_place) for r in got.collect()) == [(k // 8, k % 8) for k in range(60)]


def test_mixing_places_every_row_once(spark, monkeypatch):
    from tapeworks.llm import mixing

    monkeypatch.setattr(mixing, "RANKED", 50)
    rows = [(k, f"t{k}", "hot" if k % 3 == 0 else None if k % 11 == 0 else f"s{k % 5}") for k in range(700)] + [(None, None, "s1"), (3, "t3", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_slot", F.lit("clash"))
    got = mixing.mixed(docs, {"hot": 2, "s1": 0.5}, block=8).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((a, c) for a, _, c in rows)
    places = Counter((r.mix_slot, r.mix_place) for r in got)
    assert max(places.values()) == 1
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r.mix_slot].add((r.source, r.mix_block))
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(x) == 1 for x in by_slot.values())
    assert mixing.mixed(docs.limit(0), {}).collect() == []
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"hot": 0})


def plain_pipeline(docs, toxic, good, items):
    """The ids that the pipeline must keep, by plain loops: a score for each row, all pairs, every window."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2f:-`{-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [r for r in docs if not toxic(r.text)]
    rows = [r for r in rows if good(r.text)]
    equal = {(a, b) for b in range(len(rows)) for a in range(b) if rows[a].text is not None and split(rows[a].text) == split(rows[b].text) and (split(rows[a].text) or rows[a].text == rows[b].text)}
    label = classes_of(len(rows), all_pairs([r.text for r in rows]) | equal)
    rows = [min((r for r, x in zip(rows, label) if x == k), key=lambda r: (r.doc_id is None, r.doc_id)) for k in sorted(set(label))]
    windows = set()
    for t in items:
        ws = split(t)
        windows.update(tuple(ws[k : k + 10]) for k in range(max(1, len(ws) - 9)) if ws)
    leaks = lambda ws: any(tuple(ws[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(ws)))
    return [r.doc_id for r in rows if not leaks(split(r.text))]


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tapeworks.llm import mixing, neardup, quality, toxicity

    docs, labels = corpus(spark)
    extra = [(2000, "copy of it", "en", "s1", 1), (2001, "copy of it", "en", "s2", 1), (2002, " ".join(BASE[:12]), "en", "s2", 1), (2003, None, None, None, None), (2004, "", "en", "hot", 0), (2005, "", "en", "hot", 0), (None, "no id at all here", "en", "hot", 3), (3, "long " * 50_000, "en", "hot", 3)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("a.b", F.lit(1)).withColumn("__keep", F.lit("mine")).withColumn("score", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    items = [" ".join(BASE[:11]), None, "!"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "mix_block", "mix_slot", "mix_place"]
    got = got.collect()
    # The models are the stages' own, their scores are by single rows; the rest is plain.
    where, known = lambda m: ~m.held_out(F.col("doc_id")), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(docs, known, where(toxicity))
    clean = toxicity.with_toxicity(docs, model, only=False)
    space, terms = quality.learn(clean, known, where(quality)), quality.Terms()
    want = plain_pipeline(docs.collect(), lambda t: model.score(t) >= 0.3, lambda t: space.vote(space.vector([terms(t)]))[0] >= 0.3, items)
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in got)
    assert 2000 in want and 2001 not in want and 2002 not in want and 2005 not in want
    assert sum(k % 5 and k % 7 and 1 or 0 for k in want if k is not None and k < 400) > 0.97 * sum(1 for k in range(400) if k % 5 and k % 7)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got) and all(r["__keep"] == "mine" for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
    assert mixing.BLOCK and neardup.THRESHOLD == 0.8


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(spark, 10)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
