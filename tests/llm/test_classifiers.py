"""Toxicity, quality and URL classifiers: held-out accuracy, exact marginals, contracts."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import common, quality, toxicity, urls


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    syllables = ["ba", "do", "ki", "lu", "ne", "so", "ti", "va"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Vexum", "GRONK", "grix" + word()])
        if not good:
            words = [w + rng.choice(["###", "$$", "!!"]) for w in words]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(9001, None, "en"), (9002, "", "en"), (None, "no id here", "en"), (9003, "kiba " * 40_000, "en"), (3, docs[3][1], "en")]
    return spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("y", F.lit("clash")), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), {i: (g, t) for i, g, t in labels}


@pytest.mark.parametrize("module, which, folds, held", [(quality, 0, 5, 0), (toxicity, 1, 4, 2)])
def test_held_out_accuracy(tables, module, which, folds, held):
    docs, labels, truth = tables
    rows = module.judged(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][which] for r in unseen) / len(unseen) > 0.93


def test_marginals_are_those_of_all_paths():
    field = toxicity.Field()
    field.pairs, field.bias = np.array([[0.7, -0.5], [-0.3, 0.9]]), -1.0
    field._ready()
    n, places, evidence = 7, [1, 2, 5], [1.5, -0.7, 3.0]
    total, marked = 0.0, [0.0] * 3
    for path in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(field.pairs[a, b] for a, b in zip(path, path[1:])) + sum(s * field.bias for s in path) + sum(x for p, x in zip(places, evidence) if path[p]))
        total += weight
        for k, p in enumerate(places):
            marked[k] += weight * path[p]
    assert field.marginals(n, places, evidence) == pytest.approx([m / total for m in marked])


def test_evidence_is_the_sum_of_all_weights():
    field = toxicity.Field()
    field.weights = {"=bad": 1.0, "bad": 0.5, "badl": 0.25, "=é": 2.0, "=ab": 3.0, "abc": -1.0, "straß": 0.125}
    field._ready()
    tokens = ["bad", "BAD", "badly", "ba", "b", "É", "é", "ab", "abcd", "ABX", "Straßen", "İbad", "", "xbad"]
    assert [field.evidence(t) for t in tokens] == [sum(field.weights.get(f, 0.0) for f in toxicity.features(t)) for t in tokens]
    assert field.evidence("Badly") == 0.75 and field.evidence("AB") == 3.0


def test_every_labelled_sequence_trains_the_field_even_the_last():
    pad = ["kiba", "solu", "neva"] * 8
    texts = [[*pad[:10], "vexum" if i < 1600 else "gronk", *pad[:13], *pad] for i in range(1700)]
    tags = [[int(t in ("vexum", "gronk")) for t in tokens] for tokens in texts]
    chosen = toxicity.windows(texts, tags)
    assert sum(any(own) for _, own in chosen) == 1700 and sum(not any(own) for _, own in chosen) >= 850
    assert toxicity.Field().fit(chosen).evidence("gronk") > 0


def test_spans_are_offsets_of_the_text(tables):
    docs, labels, _ = tables
    field = toxicity.train(docs, labels)
    text = "Baki vexum gronk, doti\nvexum"
    _, places, marginals = field.tag(text)
    assert [text[s["start"] : s["end"]] for s in field.spans(text, places, marginals)] == ["vexum gronk", "vexum"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {r.doc_id for r in toxicity.judged(docs, labels).collect() if r.predicted}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_rows(tables, module):
    docs, labels, _ = tables
    assert module.judged(docs.limit(0), labels.limit(0)).count() == 0
    assert all(0 <= r.score <= 1 for r in module.judged(docs.limit(5), labels.limit(0)).collect())


def test_attention_learns_from_the_passage_that_matters():
    rng = np.random.default_rng(3)
    bags, labels = [], []
    for _ in range(400):
        bag = rng.normal(size=(rng.integers(1, 6), quality.FEATURES)).astype(np.float32)
        bad = rng.random() < 0.5
        if bad:
            bag[rng.integers(len(bag)), 0] = 6
        bags.append(bag)
        labels.append(float(not bad))
    model = quality.AttentionModel().fit(bags[:300], np.array(labels[:300]), steps=300)
    scores, _ = model.score(bags[300:])
    assert ((scores > 0.5) == np.array(labels[300:])).mean() > 0.9


def plain_score(model, bag):
    """The forward pass of one document, passage by passage."""
    p, n = model.p, len(bag)
    h = [[math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(quality.HIDDEN)] for x in bag]
    along = lambda m, row, k: sum(row[j] * p[m][j, k] for j in range(quality.HIDDEN))
    a = [sum(p["w"][k] * math.tanh(along("V", row, k)) / (1 + math.exp(-along("U", row, k))) for k in range(quality.ATTENTION)) for row in h]
    total = sum(math.exp(x) for x in a)
    weights = [math.exp(x) / total for x in a]
    z = [sum(weights[i] * h[i][j] for i in range(n)) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(c * x for c, x in zip(p["c"], z)) + p["d"][0]))), weights


def test_attention_is_that_of_a_plain_loop_and_its_gradients_those_of_differences():
    rng = np.random.default_rng(4)
    model = quality.AttentionModel(7)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    scores, weights = model.score(bags)
    plain = [plain_score(model, b) for b in bags]
    assert scores == pytest.approx([s for s, _ in plain]) and weights == pytest.approx([w for _, ws in plain for w in ws])
    x, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        logit = model._forward(x, starts)["logit"]
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)

    found = model.gradients(x, starts, labels)
    for name, value in model.p.items():
        for at in [tuple(rng.integers(s) for s in value.shape) for _ in range(6)]:
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert np.asarray(found[name])[at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_hashed_triples_are_those_of_a_plain_loop():
    text = b"Abc de. " * 70 + b"Xyz"
    words = text.split()
    got = quality.passages(text)[:, -quality.HASHED :]
    joined = b" " + b" ".join(words).lower() + b" "
    owner = [k // quality.PASSAGE for k, w in enumerate(words) for _ in range(len(w) + 1)]
    want = np.zeros((owner[-1] + 1, quality.HASHED))
    n = np.zeros(len(want))
    for i in range(len(joined) - 2):
        h = (int.from_bytes(joined[i : i + 3], "little") * 0x9E3779B1 % (1 << 32) >> 16) % (2 * quality.HASHED)
        want[owner[i], h % quality.HASHED] += 1 if h < quality.HASHED else -1
        n[owner[i]] += 1
    assert got == pytest.approx(want / np.sqrt(n)[:, None], abs=1e-5)


def test_training_takes_slices_of_long_texts_and_one_label_a_document(spark):
    words = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(i, words if i % 2 else "short text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i in range(40) for y in (0, 1)] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    sample = common.labelled_sample(docs, labels, "quality", folds=5, held=0, rows=1000)
    rows = sample.select("doc_id", "y", common.spread(F.col("text"), F.col("doc_id"), 4000).alias("t")).collect()
    assert {r.y for r in rows} == {1} and {r.doc_id for r in rows} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    for r in rows:
        parts = r.t.split("\n")
        assert (r.t == "short text") if r.doc_id % 2 == 0 else len(r.t) <= 4004 and all(f" {p} " in f" {words} " for p in parts)
    quarters = [int(r.t.split()[-1][1:]) for r in rows if r.doc_id % 2]
    assert min(quarters) > 9000 / 2  # the end of a text is reached


def test_spans_run_through_tokens_without_evidence():
    field = toxicity.Field()
    field.pairs, field.bias = np.array([[2.0, -2.0], [-2.0, 3.0]]), -0.5
    field.weights = {"=bad": 4.0}
    field._ready()
    text = "so it was bad and bad to me " + "fine " * 30
    largest, places, marginals = field.tag(text)
    assert [text[s["start"] : s["end"]] for s in field.spans(text, places, marginals)][0].count("bad") == 2
    tokens = toxicity.TOKEN.findall(text)
    everywhere = field.marginals(len(tokens), list(range(len(tokens))), [field.evidence(t) for t in tokens])
    assert marginals == pytest.approx([everywhere[p] for p in places]) and {p for p, m in enumerate(everywhere) if m >= 0.5} <= set(places)
    assert largest == pytest.approx(max(everywhere))


PAGES = ["http://a.com/x", "https://WWW.Example.com/en/1?x=1", "https://sub.www.example.com/en/", "http://example.com/en/2", "http://m.example.com/de/2", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/en/1", "http://x.org/en/1", "http://com/", "http://notexample.com/en/", None, "", "nourl", "a://b?c", "x://y://z/w", "http://é.net/es/q#f"]


def plain_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, rest[cut:].split("?")[0].split("#")[0]


def test_rules_and_parts(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, url string").withColumn("label", F.lit("clash")).withColumn("host", F.lit("clash"))
    for r in urls.judge(df).collect():
        host, path = plain_parts(PAGES[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule[0])


def plain_tree(rows, depth):
    """The best split by trying every one, on (bins, label share of the gradient, curvature, number)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    gains = {}
    for f in range(len(urls.FEATURES)):
        for cut in sorted({r[0][f] for r in rows})[:-1]:
            low, high = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
            if min(sum(r[3] for r in low), sum(r[3] for r in high)) >= urls.LEAST_ROWS:
                part = lambda x: sum(r[1] for r in x) ** 2 / (sum(r[2] for r in x) + 1)
                gains[f, cut] = part(low) + part(high) - part(rows)
    if not depth or not gains or max(gains.values()) <= 1e-6:
        return {"leaf": urls.RATE * g / (h + 1)}, None
    return None, gains


def test_trees_split_where_brute_force_gains_most():
    rng = random.Random(7)
    counted = [(tuple(rng.randrange(4) for _ in urls.FEATURES), rng.randrange(2), rng.randrange(1, 5)) for _ in range(150)]
    counted = [(b, int(b[3] > 1 and b[5] < 3 or y and b[0] == 0), n) for b, y, n in counted]
    prior = 0.3
    model = urls.Trees(prior, {}).grow(counted)
    margins = {i: math.log(prior / (1 - prior)) for i in range(len(counted))}
    counted = sorted(counted)

    def walk(node, rows, depth):
        leaf, gains = plain_tree(rows, depth)
        if leaf:
            assert node["leaf"] == pytest.approx(leaf["leaf"])
            return
        assert gains[node["feature"], node["bin"]] == pytest.approx(max(gains.values()))
        walk(node["low"], [r for r in rows if r[0][node["feature"]] <= node["bin"]], depth - 1)
        walk(node["high"], [r for r in rows if r[0][node["feature"]] > node["bin"]], depth - 1)

    assert len(model.trees) == urls.TREES
    for tree in model.trees:
        p = {i: 1 / (1 + math.exp(-m)) for i, m in margins.items()}
        walk(tree, [(b, n * (y - p[i]), n * p[i] * (1 - p[i]), n) for i, (b, y, n) in enumerate(counted)], urls.DEPTH)
        margins = {i: m + urls.leaf_of(tree, counted[i][0]) for i, m in margins.items()}


def test_scores_are_those_of_the_trees_over_plain_bins(spark):
    hosts = ["casino-win.com", "blog.example.org", "downloads.example.com", "trackandfield.org", "my-bets.net", "é.net"]
    pages = [(i, f"http://{h}/{'x' * (i % 7)}?a={i}") for i, h in enumerate(hosts * 12)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    parts = df.withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    labels = {r.host: r.label for r in urls.word_labels(parts).collect()}
    assert labels == {"casino-win.com": 1, "blog.example.org": 0, "downloads.example.com": 0, "trackandfield.org": 0, "my-bets.net": 1, "é.net": 0}
    model = urls.train(urls.sampled(urls.word_labels(parts)))
    rows = model.with_suffix_rate(urls.features(parts)).collect()
    for r in rows:
        host = r.host
        shares = [host.count(c) / len(host) for c in set(host)]
        assert (r.f_length, r.f_host_length, r.f_labels, r.f_hyphens) == (len(r.url), len(host), host.count(".") + 1, host.count("-"))
        assert r.f_entropy == pytest.approx(-sum(s * math.log2(s) for s in shares)) and r.f_parameters == 1
    bins = {r.page_id: tuple(sum(r[f] > c for c in model.cuts[f]) for f in urls.FEATURES) for r in rows}
    for r in urls.judge(df).collect():
        margin = math.log(model.prior / (1 - model.prior)) + sum(urls.leaf_of(t, bins[r.page_id]) for t in model.trees)
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)))


def test_long_repeated_and_badly_labelled_urls(spark):
    long = "http://a-b.example.org/" + "x" * 200_000 + "?y"
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://x.org/")], "page_id long, url string")
    got = urls.judge(df).collect()
    assert len(got) == 3 and {len(r.path) for r in got if r.page_id == 1} == {200_001}
    labelled = spark.createDataFrame([("http://x.org/", 7), ("http://x.org/", None), (None, 1)], "url string, label int")
    assert urls.judge(df, labelled).count() == 3
    many = spark.range(60_000).selectExpr("concat('http://h', id, '.org/') AS url", "CAST(id % 2 AS int) AS label")
    assert 15_000 < urls.sampled(many).count() < 25_000


def test_trees_separate_labelled_urls(spark):
    rng = random.Random(2)
    rows = [(f"http://{'-'.join(rng.choices(['win', 'big', 'now'], k=3)) + str(rng.randrange(99)) if bad else rng.choice(['blog', 'news', 'wiki'])}.org/{rng.randrange(99)}", int(bad)) for bad in (rng.random() < 0.4 for _ in range(300))]
    labelled = spark.createDataFrame(rows[:200], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[200:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows[200:])) >= 95
    assert urls.judge(pages.limit(0)).count() == 0
