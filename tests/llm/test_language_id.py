from zlib import crc32

import numpy as np
from corpus import EDGES, edge_documents

from siftlog.llm import language_id


def test_edges(spark):
    docs = edge_documents(spark)
    rows = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(rows) == len(EDGES)
    for row in rows:
        assert row.held_out == (crc32(str(row.doc_id).encode() if row.doc_id is not None else b"") % 4 == 2)
        assert 0 <= row.score <= 1
        assert row.lang_pred in ("en", "fr", "und")
    texts = {row.doc_id: row for row in rows}
    assert texts[3].lang_pred == texts[4].lang_pred == texts[5].lang_pred == "und"
    assert texts[3].score == 0
    assert texts[7].lang_pred != "und"


def test_nothing_to_learn(spark):
    docs = edge_documents(spark, [(1, "some text", None, "a")])
    assert [row.lang_pred for row in language_id.predict(docs, language_id.fit(docs)).collect()] == ["und"]
    assert language_id.predict(edge_documents(spark, []), language_id.fit(edge_documents(spark, []))).count() == 0


def test_scores_against_plain_sums():
    """Long texts, cut into pieces and batches, score like the sum over all n-grams at once."""
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c"], np.log(rng.dirichlet(np.ones(language_id.BUCKETS), 3).T).astype(np.float32), np.log(np.array([0.5, 0.3, 0.2])))
    texts = ["Hello,  World 42!", None, "123", "x" * 5, "Été 中文 " * 50]
    names, scores = language_id.text_scores(texts, model)
    for text, name, score in zip(texts, names, scores):
        if not any(map(str.isalpha, text or "")):
            assert (name, score) == ("und", 0)
            continue
        letters = "".join(char.lower() if char.isalpha() else " " for char in text)
        codes = np.array([ord(char) for char in " " + " ".join(letters.split()) + " " * (not text[-1].isalpha())], dtype=np.uint32)
        total = model.weights[language_id.gram_buckets(codes)].sum(axis=0, dtype=float) + model.priors
        assert name == model.languages[int(total.argmax())]
        assert abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_pieces_have_each_gram_once(monkeypatch):
    text = "ab, cd. " * 40 + "Zz e"

    def grams():
        return np.sort(np.concatenate([language_id.gram_buckets(*piece) for piece in language_id.pieces(text)])).tolist()

    whole = grams()
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(language_id, "PIECE", size)
        assert grams() == whole


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).filter("held_out")
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(joined) > 200
    assert sum(row.lang_pred == row.lang for row in joined) >= 0.98 * len(joined)
