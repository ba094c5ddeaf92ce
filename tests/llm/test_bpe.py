import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul", "ΣΑΣ Σ", "it's they'll WE'RE 'tis ''s --'s don'ts o'dd 'v 'vec", "a<|endoftext|>b<|startoftext|>", "<|endoftext|>", "<|end", "é Å ẛ̣", "中文 ok 123 ٣٤ Ⅷ ½", "a b c\x85d\x1ce", "😀👍🏽 !?", "‍﻿", "Ə Ɓ Ɗ Ɛ Ɔ", "a" * 3000, "'" * 50 + "s", "\U0003fffd x", ""]


@pytest.fixture(scope="module")
def model():
    return bpe.WordBpe(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def agree(model, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for t, (ids, decoded), w in zip(texts, model.run(texts), want, strict=True):
        assert ids.tolist() == w, t
        assert decoded.decode() == library.decode(w, skip_special_tokens=False), t


def test_every_code_point_among_letters_and_digits(model, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [f"a{c} {c}1 {c}{c}'s x{c}" for c in every]
    step = 20_000
    for k in range(0, len(texts), step):
        agree(model, library, texts[k : k + step])


def test_odd_texts(model, library):
    agree(model, library, ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.sampled_from("'strevmld 1<|>́İΣ")), max_size=40), max_size=5))
def test_ids_are_the_library_s(model, library, texts):
    agree(model, library, texts)


def test_merges_do_not_depend_on_the_batch(model):
    words = [b"banana", b"", b"aaaaaaa", b"the", b"\xff\xfe"]
    ids, at = model.table.encode(words)
    for i, w in enumerate(words):
        assert model.table.encode([w])[0].tolist() == ids[at[i] : at[i + 1]].tolist()


def test_query_columns_against_the_library(spark, library):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["Grüße", "they're", "x1", "naïve", "THE", "¿qué?", "Ɛ"], k=r.randrange(0, 80)))) for i in range(120)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(700, None), (701, "long text's " * 400_000), (701, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")).repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode_digests(df, PATH).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)
    plain = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_decode(df.where("doc_id = 502"), PATH).collect()}
    ids = library.encode(ODD[2], add_special_tokens=False).ids
    assert plain == {502: (ids, library.decode(ids, skip_special_tokens=False))}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode_digests(df, PATH).collect() == [] and bpe.encode_decode(df, PATH).collect() == []
