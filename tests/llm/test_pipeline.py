"""The corpus pipeline, stage by stage, on a small table against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from folioguard.llm import pii, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.settle(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = stages["toxicity"]
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in before}
    known = sorted((r["doc_id"], r["toxic"]) for r in labels if not held(r["doc_id"]) and len(texts[r["doc_id"]]) <= toxicity.MOST_CHARS)
    every = Counter(r["toxic"] for r in labels if not held(r["doc_id"]))
    model = toxicity.trained([texts[i] for i, _ in known], [y for _, y in known], (every[0], every[1]))
    assert Counter(after) == Counter(r for r in before if model.score(r["text"]) < 0.5)
    assert 0.9 * len(before) < len(after) < len(before)


def test_copies_go(stages):
    before, after = stages["near_dedup"]
    assert not Counter(after) - Counter(before)
    assert len({r["text"] for r in after}) == len(after)
    least = {}
    for r in before:
        least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    assert all(least[r["text"]] == r["doc_id"] for r in after)
    assert {r["doc_id"] for r in after} == kept_by_brute_force(before)


def kept_by_brute_force(rows):
    """The smallest id of each group of texts whose sets of five-word shingles have a
    similarity of 0.8 or more, over all texts, however long."""
    sets = {}
    for r in rows:
        words = simhash.words_of(r["text"])
        sets[r["doc_id"]] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    order = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}


def test_personal_data_is_redacted(stages):
    before, after = stages["pii"]
    model = pii.fit()
    want = {r["doc_id"]: pii.redact_text(r["text"], pii.find_spans(r["text"], model)) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want and len(before) == len(after)
    assert all(r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"]) for r in after)


def test_mix_meets_targets(stages):
    before, after = stages["mix"]
    words = lambda rows: Counter({s: sum(len(r["text"].split()) for r in rows if r["source"] == s) for s in {r["source"] for r in before}})
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    have, got = words(before), words(after)
    assert 1.4 * sum(have.values()) < sum(got.values()) < 1.6 * sum(have.values())


def test_encoding(stages):
    before, after = stages["encode"]
    assert len(before) == len(after) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0
