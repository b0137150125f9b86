"""The pipeline's stages by hand on a small corpus: what each takes out, and what it leaves alone."""

import random

import pytest

import corpus_pipeline as cp
from quillspan.llm import pieces
from quillspan.llm.queries import tokenizer_path

random.seed(11)
VOCAB = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "nrst"]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(30)
    rows = [[i, prose(60), "en", f"src{i % 3}"] for i in range(300)]
    for i in range(0, 300, 6):
        ws = rows[i][1].split()
        for _ in range(3):
            ws[random.randrange(60)] = "scumbag"
        rows[i][1] = " ".join(ws)
    rows[7][1] = rows[1][1]
    rows[8][1] = " ".join([*rows[2][1].split()[:59], "other"])
    rows[9][1] += " " + item
    rows[10][1] += " password = hunter2222"
    rows = [(*r, len(r[1])) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r[1] for r in rows}


def test_stages(spark, corpus):
    d, text = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        if name != "pieces":
            assert out.columns == docs.columns
        out = out.cache()
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    clean = {i for i in text if i % 6}
    assert set(seen["toxicity"]) == clean
    assert set(seen["near_duplicates"]) == clean - {7, 8}
    assert set(seen["decontamination"]) == clean - {7, 8, 9}
    masked = seen["secrets"]
    assert masked[10]["text"].endswith(" [SECRET]") and masked[10]["n_chars"] == len(masked[10]["text"])
    assert all(r["text"] == text[i] for i, r in masked.items() if i != 10)
    codec = pieces.PieceCodec(pieces.read_model(tokenizer_path("piece_bpe_32k.model")))
    assert all(codec.decode(r["ids"]) == masked[i]["text"] for i, r in seen["pieces"].items())


def test_run(spark, corpus):
    d, _ = corpus
    assert cp.run(spark, d).count() == 247
