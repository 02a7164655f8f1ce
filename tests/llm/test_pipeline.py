"""The pipeline, stage by stage, against a brute-force version on a small table."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_dedup_mix_shard import plain_targets
from tests.llm.test_simhash import plain_components


def folder(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["ba", "do", "ki", "lu", "ne"], k=3))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(30, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            words[3] = rng.choice(["gronk", "vexum"])
        docs.append((i, " ".join(words), "en", rng.choice("abc")))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[i][1].replace(" ", "\n"), "en", "a") for i in range(20)] + [(400 + i, docs[i + 30][1] + " end", "en", "b") for i in range(20)]
    docs += [(500, None, "en", None), (501, "", "en", None), (None, "no id at all", None, "c"), (7, docs[7][1], "en", docs[7][3])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_do_what_they_say(spark, tmp_path):
    sf_dir = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], sf_dir).write.parquet(str(tmp_path / f"out{k}"))
        steps.append(spark.read.parquet(str(tmp_path / f"out{k}")))
    rows = [[(r.doc_id, r.text, r.source) for r in s.collect()] for s in steps[:-1]]
    assert all(s.columns == docs.columns for s in steps[:-1])

    clean = [r for r in rows[0] if not re.search("gronk|vexum", r[1] or "")]
    assert Counter(rows[1]) == Counter(clean)

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in rows[1]:
        key = norm(r[1])
        if key not in least or (r[0] is None, r[0] or 0) < (least[key][0] is None, least[key][0] or 0):
            least[key] = r
    assert Counter(rows[2]) == Counter(least.values())

    groups = {(d, f): c for d, f, c in plain_components([(d, t) for d, t, _ in rows[2]])}
    stay = {d for (d, _), c in groups.items() if d == c}
    assert Counter(rows[3]) == Counter(r for r in rows[2] if r[0] in stay)

    _, target = plain_targets(rows[3])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert set(rows[4]) <= set(rows[3]) and max(Counter(rows[4]).values()) <= 2
    for s in target:
        taken = sum(size(t) for _, t, x in rows[4] if x == s)
        assert abs(taken - target[s]) <= max(size(t) for _, t, x in rows[3] if x == s)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, _ in rows[4]:
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, steps[-1].collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want


def test_names_and_number_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
