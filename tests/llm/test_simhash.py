"""SimHash near-duplicates against brute force."""

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talweg.llm import common, simhash


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    out = simhash.near_groups(df).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÄß \t\n\x0b\x1c\xa0.", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            if len(copy) > 100:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, "w1 w2 w3"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (900, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    assert result(df) == plain_components(rows)


def test_crowded_blocks_are_divided(spark):
    rng = random.Random(2)
    values = list({0x123456789ABCDEF0 ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6]))) for _ in range(300)})
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    rows = simhash._divided(simhash._blocked(fps, simhash.block_masks()), 150, 3)
    roots = {r.node: r.root for r in simhash.connected_components(simhash._links(rows, 3)).collect()}
    seen = {}
    for v in values:
        seen.setdefault(roots.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
    left, groups = set(values), []
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            near = {w for w in left if (w ^ queue[-1]).bit_count() <= 3}
            queue.pop()
            left -= near
            group |= near
            queue += near
        groups.append(group)
    assert sorted(map(sorted, seen.values())) == sorted(map(sorted, groups))


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("few", [True, False])
def test_one_of_each_group_stays(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(common, "BROADCAST_IDS", -1)
    text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(3, text), (1, text + " z"), (1, text + " z"), (2, "other words here now"), (None, "alone and without id"), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0 for r in simhash.drop_near_copies(df).collect())) == [0, 0, 1, 2]
