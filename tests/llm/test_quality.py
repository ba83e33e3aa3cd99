import numpy as np
import pyarrow as pa
from corpus import EDGES, base_features, edge_documents
from pyspark.sql import functions as F

from siftlog.llm import common, quality

LABELS = "doc_id long, quality int, toxic int"


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 1)], LABELS)
    found = quality.score(edge_documents(spark), labels).collect()
    expected = sorted((str(doc), *base_features(text)) for doc, text, *_ in EDGES)
    assert sorted((str(row.doc_id), *(row[name] for name in quality.FEATURES), row.base_failed) for row in found) == expected
    assert all(not (row.kept and row.base_failed) for row in found)


def test_features_of_odd_texts():
    texts = ["", None, "a" * 50, "x y z\n" * 40, "\n\n", "é#é\né#é\n é#é", "# $ <b>|", "a b c d e f g h i a b c d e f g h", " ", "end", "start\x0bmid\x0cend"]
    got = []
    for chunk in common.chunks(pa.array(texts, pa.string())):
        made = quality.features(chunk, chunk.word_hashes())
        got += list(zip(*(made[name].tolist() for name in quality.FEATURES)))
    assert got == [base_features(text)[:5] for text in texts]


def test_ratio_against_plain_counts(spark):
    rows = [(i, f"good word{i % 7} and word{(i * 3) % 5} follow here", "en", "s") for i in range(40)] + [(100 + i, f"bad|{i % 7} ## junk{i % 3} ##", "en", "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], LABELS)
    docs = edge_documents(spark, rows)
    corpus, trusted = quality.corpus_counts(docs, labels)

    def buckets(text):
        chunk = next(common.chunks(pa.array([text])))
        return quality.ngram_buckets(chunk, chunk.word_hashes())[0]

    for kept, counts in ((rows, corpus), (rows[:10], trusted)):
        plain = np.zeros(quality.BUCKETS)
        for _, text, *_ in kept:
            np.add.at(plain, buckets(text), 1)
        assert (plain == counts).all()
    weights = quality.log_ratios(corpus, trusted)
    for row in quality.score(docs, labels).collect():
        text = next(text for doc, text, *_ in rows if doc == row.doc_id)
        assert abs(row.ratio - weights[buckets(text)].mean()) < 1e-6
    ratios = {row.doc_id: row.ratio for row in quality.score(docs, labels).collect()}
    assert min(ratios[i] for i in range(40)) > max(ratios[100 + i] for i in range(20))


def test_junk_goes_and_good_rows_stay(spark):
    """With the production threshold, on labelled rows of the given tables that pass the base rules."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rated = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id")
    shares = {row.quality: row.share for row in rated.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.999
    assert shares[0] < 0.2


def test_kept_rows_and_empty(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = edge_documents(spark)
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(row.doc_id) for row in kept.collect()) == sorted(str(doc) for doc, text, *_ in EDGES if not base_features(text)[-1])
    assert quality.score(edge_documents(spark, []), labels).count() == 0
