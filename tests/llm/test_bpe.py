"""BPE against the tokenizers library: whole texts, cut texts, round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioguard.llm.bpe import TEXT, decode_column, encode, load

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n \n", "a", "Don't we'll 'sss !'s '''ve", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>", "\u0085  x ​᠎\x1c\x1d\x1fz",
       "日本語テキスト、改行。" * 20, "🙂🙃👩‍👩‍👧" * 30, "é" * 50, "12345678901234567890" * 9, "\t\t  \tx\r\n\r\ny  ", "ſpecial İı ß ǅ", "\x00\x01\x7f", "�﻿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def mixed(seed: int) -> str:
    rng = random.Random(seed)
    alphabets = ["abcdefghi", "0123456789", " ", "!?'.-", "\n\t ", "éüñß", "日本語", "🙂é", "'s", "aaaa"]
    return "".join("".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 2, 5, 40]))) for _ in range(rng.choice([3, 30])))


def test_whole_texts_match_the_library(library):
    bpe = load(PATH)
    for text in [*ODD, *map(mixed, range(400))]:
        assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("most", [3, 7, 20])
def test_pieces_and_joins_match_the_library(library, most):
    bpe = load(PATH)
    runs = ["a" * 333, "the" * 99, "\n" * 77 + "x", " " * 64, "日本" * 60, "🙂" * 50, "=-" * 80, "0123456789" * 20, "'" * 40 + "s" * 40, "internationalization" * 12]
    for text in [*ODD, *runs, *map(mixed, range(1000, 1300))]:
        pieces = bpe.pieces(text, most)
        assert "".join(p for p, _ in pieces) == text
        ids = bpe.assemble([bpe.encode(p) for p, _ in pieces], [m for _, m in pieces])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_tables_with_nulls_repeats_and_clashing_names(spark, library):
    texts = [None, "", "short", "short", "word " * 50, "z" * 500, "<|endoftext|>" * 9, *ODD]
    df = spark.createDataFrame([(i, t, "x", [i]) for i, t in enumerate(texts)], "doc_id long, text string, ids string, `row` array<int>")
    out = encode(df, PATH, long=40).withColumn("back", decode_column_of("ids"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["back"] == (t or "")
        assert got[i]["row"] == [i] and got[i]["text"] == t


def decode_column_of(name):
    return decode_column(F.col(name), PATH)


def test_decoding_of_odd_ids(spark, library):
    rows = [(0, [0, 1, 2]), (1, []), (2, None), (3, [None, 50256, 999999, 220]), (4, [149, 150, 151])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    got = {r["i"]: r["t"] for r in df.select("i", decode_column_of("ids").alias("t")).collect()}
    assert got[0] == library.decode([0, 1, 2], skip_special_tokens=False) and got[1] == "" and got[2] is None
    assert got[3] == "<|endoftext|> " and got[4] == library.decode([149, 150, 151], skip_special_tokens=False)


def test_checked_ids(spark, library):
    texts = [None, "", "word " * 50, "z" * 500, *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ok", F.lit("theirs"))
    got = {r["doc_id"]: r for r in encode(df, PATH, checked="ok", long=40).collect()}
    assert all(got[i]["ok"] is True and got[i]["ids"] == library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_ordinary_long_texts_are_halved_anywhere_and_joined(library):
    """Prose over the limit is cut within words, and the joins mend that."""
    rng, bpe = random.Random(4), load(PATH)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".\n"]) for _ in range(9000))
    pieces = bpe.pieces(text, 4000)
    assert sum(m == TEXT for _, m in pieces) >= 8 and any(p[-1:].isalpha() and q[:1].isalpha() for (p, _), (q, _) in zip(pieces, pieces[1:], strict=False))
    ids = bpe.assemble([bpe.encode(p) for p, _ in pieces], [m for _, m in pieces])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_of_pieces_are_not_collected_unless_asked_for(spark, library):
    """What puts a long text's ids together gets no text: it goes by a digest."""
    texts = ["word " * 50, "z" * 500, *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = encode(df, PATH, checked="ok", long=40).select("doc_id", "ids", "ok")
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    collected = [line for line in plan if "collect_list" in line]
    assert collected and not any("piece" in line for line in collected)
    assert {(r["doc_id"], tuple(r["ids"]), r["ok"]) for r in out.collect()} == {(i, tuple(library.encode(t, add_special_tokens=False).ids), True) for i, t in enumerate(texts)}


def test_ids_of_another_text_do_not_pass_the_check():
    bpe, digest = load(PATH), hashlib.sha256("é word".encode()).hexdigest()
    assert bpe.decodes_to(bpe.encode("é word"), digest)
    assert not bpe.decodes_to(bpe.encode("é wore"), digest) and not bpe.decodes_to(bpe.encode(""), digest)
