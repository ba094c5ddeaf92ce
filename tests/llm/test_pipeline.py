import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases among clean ones, and labels."""
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(800)]
    text = lambda k: " ".join(r.choices(vocab, k=k))
    docs = {i: text(r.randrange(60, 150)) for i in range(200)}
    labels = []
    for i in range(200, 320):  # toxic
        w = text(80).split()
        for _ in range(6):
            w.insert(r.randrange(len(w)), r.choice(["vile", "rotten", "grubby"]))
        docs[i] = " ".join(w)
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(0, 200, 2)]
    docs[400] = docs[10]  # exact copy
    near = docs[11].split()
    near[30] = "other"
    docs[401] = " ".join(near)
    passage = text(70)
    docs[20] += " " + passage
    docs[402] = text(90) + " " + passage + " " + text(5)
    docs[403] = text(60) + " mail bob.12@mail3.example.com call +1 (017) 555-7713"
    docs[404], docs[405] = "", None
    base = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, docs, passage


def test_stages(spark, folder):
    base, docs, passage = folder
    frame = spark.read.parquet(f"{base}/documents.parquet")
    columns = frame.columns
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, frame, base)
        if k < 4:
            assert out.columns == columns
            frame = cp.settle(out, name)
            seen[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
        else:
            packed = out.collect()
    clean = set(range(200)) | {402, 403, 404, 405}
    tox = seen["toxicity"]
    assert len(set(tox) & set(range(200, 320))) <= 2 and clean | {400, 401} <= set(tox)
    near = seen["ngram_jaccard_join"]
    assert 400 not in near and 401 not in near and clean <= set(near)
    cut = seen["suffix_array_dedup"]
    assert clean <= set(cut) and passage in cut[20] and passage not in cut[402]
    assert all(cut[i] == docs[i] for i in clean - {402})
    private = seen["pii"]
    assert "bob.12@" not in private[403] and "555-7713" not in private[403] and "@mail3.example.com" in private[403]
    assert {i for i in private if private[i] != cut[i]} == {403}
    assert {p["doc_id"] for p in packed} == set(private)
    assert max(p["offset"] + p["length"] for p in packed) <= 2048


def test_run(spark, folder):
    assert cp.run(spark, folder[0]).select("doc_id").distinct().count() >= 200
