import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotweave.llm import alignment, queries
from spotweave.llm.bpe import byte_alphabet

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
ODD = ["", "a", " ", "  two   spaces\n\n\tand tabs ", "İstanbul ΣΑΣ ß", "中文 ok 123 ٣٤ Ⅷ ½", "😀👍🏽 !?‍﻿", "a<|endoftext|>b<s></s><unk><0x41>", "has ▁ mark", "nul \0 byte", "é Å", "a" * 3000, "'" * 50 + "s it's", "\r\nx y", "é combining", "ﬁ ligature", "퟿"]


class Library:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
        self.a.encode_special_tokens = True
        self.letters = {c: b for b, c in enumerate(byte_alphabet())}

    def tokens(self, text):
        """(id, bytes) lists of both, or none where either doesn't spell the text."""
        if not text:
            return [], []
        want = (" " + text).encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def ranges(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    """All pairs of occurrences tried."""
    lib, held, count = Library(), [], Counter()
    for key, text in rows:
        a, b = (ranges(t) for t in lib.tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        count.update(links)
        held.append((key, a, b, links))
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    out = []
    for key, a, b, links in held:
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in t if low <= s and e <= c) for t in (a, b)))
            low = c
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((key, len(a), len(b), len(cuts), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), text))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "tokenization", "naïve", "unbelievable", "x", "12345", "3.14", "don't", "élève", "foo_bar", "—", "中"]
    return [" ".join("".join(r.choices("etaoinshrdlué", k=r.randrange(1, 12))) if r.random() < 0.5 else r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("links", [8_000_000, 300])
def test_alignment_matches_brute_force(spark, links):
    """Texts in one block a task, and in many."""
    rows = list(enumerate([*ODD[:-1], None, *texts(1, 40), *["the same text again"] * 30], start=7))
    rows += [rows[-1], (None, "no id"), (8, "another text of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("block", F.lit("b")).withColumn("pair", F.lit(2)).repartition(3)
    got = alignment.align_tokens(df, *PATHS, block_links=links).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@given(st.lists(st.integers(1, 4), min_size=0, max_size=60), st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_links_and_groups_of_any_ends(sizes, seed, lane, probe):
    """Second ends are the first's with some taken out and some put in."""
    r = random.Random(seed)
    a = np.cumsum(np.array(sizes, np.int64))
    top = int(a[-1]) if len(a) else 0
    b = np.array(sorted({int(x) for x in a if r.random() < 0.8} | {r.randrange(1, top + 1) for _ in range(r.randrange(0, 6)) if top} | ({top} if top else set())), np.int64)
    la, lb, ca, cb = alignment.align(a, b, lane, probe)
    begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = sorted((i, j) for i in range(len(a)) for j in range(len(b)) if begin_a[i] < b[j] and begin_b[j] < a[i])
    assert sorted(zip(la.tolist(), lb.tolist())) == want
    common = set(a.tolist()) & set(b.tolist())
    assert [x in common for x in a.tolist()] == ca.tolist() and [x in common for x in b.tolist()] == cb.tolist()


def test_empty_table_and_only_empty_texts(spark):
    df = spark.createDataFrame([("k", ""), ("l", None)], "doc_id string, text string")
    assert alignment.align_tokens(df.where("false"), *PATHS).collect() == []
    assert sorted(map(tuple, alignment.align_tokens(df, *PATHS).collect())) == [("k", *[0] * 6, ""), ("l", *[0] * 6, "")]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()]
    got = {r[0]: tuple(r) for r in queries.op11_token_alignment(spark, sf).select(*COLUMNS).collect()}
    for want in brute(rows):  # corpus-wide counts are those of all texts, so only the texts' own are held here
        assert got[want[0]][:5] == want[:5] and got[want[0]][7] == want[7]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
