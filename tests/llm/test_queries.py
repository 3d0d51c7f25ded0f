"""The registered queries over whole small tables, against brute force or SQL."""

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from folioguard.llm import queries as q
from tests.llm import test_fingerprints, test_licenses, test_pii, test_simhash, test_variants

SF = "/root/testdata/sf0.001"


def read(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in read("documents")}


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def run(name):
        if name not in made:
            made[name] = [r.asDict() for r in q.queries()[name](spark, SF).collect()]
        return made[name]

    return run


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(result, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "pages"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    want = sorted((repr(dict(sorted(zip(columns, r, strict=True)))) for r in got.fetchall()))
    assert sorted(repr(dict(sorted(r.items()))) for r in result(name)) == want


def test_op1(result, docs):
    prints = {i: test_simhash.plain_print(r["text"]) for i, r in docs.items()}
    ids = sorted(docs)
    roots = test_simhash.plain_roots([prints[i] for i in ids], 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op1_simhash_near_dedup")} == {i: (f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, roots, strict=True)}


def test_op2(result, docs):
    for r in result("op2_pii_spans"):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in test_pii.plain(docs[r["doc_id"]]["text"]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(list(filter(None, base.split(","))))


def test_op4(result, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in result("op4_bpe_round_trip"):
        ids = library.encode(docs[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5(result, docs):
    rows = result("op5_toxicity")
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op6(result, docs):
    size = {i: len(test_simhash.simhash.words_of(r["text"])) for i, r in docs.items()}
    total = defaultdict(int)
    for i, r in docs.items():
        total[r["source"]] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    left, open_, want = 1.5 * sum(total.values()), set(total), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        want |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(2.0 * total[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in result("op6_mix_sources"):
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in total)


def test_op7(result, docs):
    slots = defaultdict(list)
    for r in result("op7_rendezvous_shards"):
        raw = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key") and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(docs)


def test_op9(result, docs):
    for r in result("op9_license_scan"):
        n, places, first, last, base = test_licenses.plain(docs[r["doc_id"]]["text"])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, ",".join(base))
        assert set(base) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op10(result):
    rows = read("embeddings")
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        got = {r["vec_id"]: r["score"] for r in result("op10_nearest_neighbours") if r["query_id"] == ids[i]}
        assert len(got) == 10 and all(abs(s - d[np.flatnonzero(ids == n)[0]]) < 1e-12 for n, s in got.items())
        d[i] = np.inf
        hits.append(len(set(got) & set(ids[np.lexsort((ids, d))[:10]])) / 10)
    assert np.mean(hits) >= 0.9


def test_op11(result, docs):
    counts = test_variants.damaged([(i, r["text"]) for i, r in docs.items()])
    assert {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in result("op11_spelling_variants")} == test_variants.plain(counts)


def test_op12(result, docs):
    want = test_fingerprints.plain([(i, r["text"]) for i, r in docs.items()])
    assert sorted(map(repr, ((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in result("op12_fingerprints")))) == sorted(map(repr, want))
