"""Exact dedup, mixing, sharding and rules against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import common, exact_dedup, mixing, rules, sharding

SCHEMA = "doc_id long, text string, source string"


def table(spark, rows):
    clash = spark.createDataFrame(rows, SCHEMA)
    return clash.withColumns({c: F.lit("clash") for c in ("size", "n", "digest", "kept", "shard", "bits", "copies", "place", "target", "t", "w", "lines", "salt")})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_fuse_filter_has_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    made = exact_dedup.FuseFilter.load(exact_dedup.FuseFilter.build(keys).dump())
    assert made.has(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert made.has(others).mean() < (0.02 if n else 1.01)


def texts(seed=3, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(["a", "b", "c", "dd"], k=rng.randrange(4))) for _ in range(12)] + ["x" * 50_000, "ä\u00a0b"]
    rows = [(i, rng.choice(base).replace(" ", rng.choice([" ", "\n", " \t ", "\x0b"])), rng.choice(["s1", "s2", "s0", None])) for i in range(n)]
    return rows + [(None, "a b", "s1"), (None, None, None), (None, "only without id", "s1"), (5, rows[5][1], rows[5][2]), (7, "", "s2"), (200, None, "s2")]


def plain_dedup(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, norm):
        groups[t].append(i)
    return sorted(((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(rows, norm)), key=str)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_groups(spark, share):
    rows = texts()
    got = exact_dedup.assign(table(spark, rows), share).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_dedup(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_digests_of_different_texts_are_found(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    groups = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), 2) for t in "ab"], "digest string, n long")
    assert exact_dedup.unequal_digests(docs, groups).count() == 0
    by_text = exact_dedup._assign_by_text(docs, groups.select("digest")).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in by_text) == [(1, 1, True), (2, 2, True), (3, 2, False)]


def without_broadcasts(monkeypatch):
    """As if there were too many ids, keys or sources to broadcast."""
    for module, name in ((common, "BROADCAST_IDS"), (exact_dedup, "BROADCAST_IDS"), (mixing, "BROADCAST_SOURCES")):
        monkeypatch.setattr(module, name, -1)


@pytest.mark.parametrize("few", [True, False])
def test_one_of_each_text_stays_with_all_columns(spark, few, monkeypatch):
    if not few:
        without_broadcasts(monkeypatch)
    rows = texts()
    out = exact_dedup.drop_copies(table(spark, rows))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        least.setdefault(norm(t), i)
    assert out.columns == table(spark, rows).columns and sorted(((r.doc_id, norm(r.text)) for r in out.collect()), key=str) == sorted(((i, t) for t, i in least.items()), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_byte_check_with_and_without_broadcast(spark, few, monkeypatch):
    if not few:
        without_broadcasts(monkeypatch)
    docs = spark.createDataFrame([(i, "same  text") for i in range(50)] + [(99, "other")], "doc_id long, text string")
    groups = exact_dedup._grouped(exact_dedup.digested(docs))
    assert exact_dedup.unequal_digests(docs, groups).count() == 0
    assert {r.group_size for r in exact_dedup.assign(docs).collect()} == {50, 1}


def test_a_stored_snapshot_screens_later_batches(spark, tmp_path):
    rows = texts()
    old, new = [r for r in rows if r[0] is not None and r[0] < 60], [r for r in rows if r[0] is None or r[0] >= 60]
    path = str(tmp_path / "snapshot")
    exact_dedup.Snapshot.write(exact_dedup.digested(table(spark, old)), path)
    snapshot = exact_dedup.Snapshot(spark, path)
    want = [x for x in plain_dedup(rows) if x[0] is None or x[0] >= 60]
    for _ in range(2):  # it stays as it is
        got = exact_dedup.assign_batch(table(spark, new), snapshot, table(spark, old)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        assert not any(r.kept for r in got if r.keep_id is not None and r.keep_id < 60)


def plain_targets(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, live = 1.5 * sum(sizes.values()), {}, set(names)
    while live:
        level = left / sum(weight[s] for s in live)
        full = {s for s in live if weight[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in live}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        live -= full
    return sizes, target


@pytest.mark.parametrize("few", [True, False])
def test_mix_meets_targets(spark, few, monkeypatch):
    if not few:
        without_broadcasts(monkeypatch)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["b", "b", "b", "a", "ä", "c", None])) for i in range(600)] + [(None, None, "a"), (None, "x y", "b"), (1, "w", "empty"), (3, "", "nothing")]
    got = mixing.mix(table(spark, rows)).collect()
    sizes, target = plain_targets(rows)
    taken, largest, source = Counter(), Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
    by_id = {(i, len(re.findall(r"\S+", t or ""))): s for i, t, s in rows}
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table(spark, rows).repartition(7)).collect()))


def test_mixed_documents_come_as_often_as_they_are_taken(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 7 == 0]) for i in range(200)]
    times = {r.doc_id: r.copies for r in mixing.mix(table(spark, rows)).collect()}
    out = mixing.mixed_documents(table(spark, rows))
    assert out.columns == table(spark, rows).columns and Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in times.items() if n})


def test_budgets_are_nested(spark):
    df = spark.createDataFrame([(i, "s", i % 13 + 1) for i in range(300)], "doc_id long, source string, size long").withColumn("place", mixing.place(F.col("doc_id"), F.lit("")))
    cut = lambda target: mixing.thresholds(df, spark.createDataFrame([("s", 2076, float(target))], "source string, source_size long, target double")).first().below
    cuts = [cut(t) for t in (0, 10, 500, 1500, 2075)]
    assert cuts == sorted(cuts) and cuts[0] == 0


@pytest.mark.parametrize("limit", [1, 40, 400, 10**9])
def test_shards_fit_and_none_splits_needlessly(spark, limit):
    rows = [r for r in texts(5, 150) if len(r[1] or "") < 1000]
    got = sharding.shard(table(spark, rows), limit).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t, _ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, own in shards.items():
        assert own[0].depth == len(name) and own[0].shard_bytes == sum(r.n_bytes for r in own) and own[0].shard_docs == len(own)
        if own[0].shard_bytes > limit:
            assert len({(r.doc_id, r.n_bytes) for r in own}) == 1  # one hash only
        if name:  # its parent was too large
            assert sum(r.n_bytes for r in got if r.shard.startswith(name[:-1])) > limit


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_columns(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ab \n#|ä\x0b.", weights=[5, 2, 4, 1, 1, 1, 1, 1, 1], k=rng.randrange(120))), "s") for i in range(150)] + [(None, None, None), (900, "", ""), (901, "a b c a b c", ""), (902, "x y z " * 20_000, ""), (903, "one two", "")]
    got = {r.doc_id: r for r in rules.clean(table(spark, rows)).collect()}
    for i, t, _ in rows:
        r, base = got[i], plain_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)


def test_repeats_without_hashes_are_the_same(spark):
    df = spark.createDataFrame([("a b c a b c a",), ("a b",), ("q w e r q w e",), ("",)], "t string").withColumn("w", rules._words(F.col("t")))
    got = df.select(rules.repeated_words(F.col("w")).alias("a"), rules._covered(rules._repeats_by_words(F.col("w"))).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(7, 7), (0, 0), (6, 6), (0, 0)]


def test_lines_that_fail_go_and_documents_that_lose_too_much(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{good}\nHome | About | Contact\nAll rights reserved.", "s"), (2, f"{good}\n" + "\n".join(f"### $$$ %%% a{i} b{i} c{i}" for i in range(40)), "s"), (3, good, "s")]
    got = {r.doc_id: r for r in rules.clean(table(spark, rows)).collect()}
    assert got[1].clean_text == good and got[1].kept and not got[2].kept and got[3].clean_text == good


def test_line_ends_and_languages(spark):
    duckdb = pytest.importorskip("duckdb")
    good = " ".join(f"word{i}" for i in range(60))
    menus = ["home\r", "Home | About\r", "MENÜ", "à propos\r", "Iniciar Sesión", "Zurück » Weiter", "home again\r", "Kontaktlinsen", "Suche\x0b", "ALLE RECHTE VORBEHALTEN.\r", "Política de Privacidad", "\u017fuche", "all right\u017f re\u017ferved", "prİvacy policy"]
    rows = [(i, f"{good}\r\n{m}\n", "s") for i, m in enumerate(menus)] + [(90, "\r\n\r\n", "s"), (91, None, "s")]
    got = {r.doc_id: r for r in rules.clean(table(spark, rows)).collect()}
    assert [m for i, m in enumerate(menus) if m in got[i].clean_text] == ["home again\r", "Kontaktlinsen", "Suche\x0b", "prİvacy policy"]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = db.execute(rules.ORACLE_SQL).fetchall()
    names = [c[0] for c in db.description]
    assert sorted(want) == sorted(tuple(got[w[0]][n] for n in names) for w in want)


@pytest.mark.parametrize("run", [exact_dedup.assign, mixing.mix, mixing.mixed_documents, sharding.shard, rules.clean, exact_dedup.drop_copies])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).count() == 0
