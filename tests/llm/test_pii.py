import time

from corpus import EDGES, base_spans, edge_documents, sha256
from pyspark.sql import functions as F

from siftlog.llm import pii

TEXTS = [
    None,
    "",
    "mail a.b@c.de, x@y z@w.q.r. me%@h-1.io;b@c.d@e.f a@b.c%d@e.f",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 9999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111 5105105105105100x",
    "+1 (017) 555-7713 +49 30 1234 567. +123 +1234567890123456 ++44 20 7946 0958)",
    "é\U0001f600 a@b.co \U0001f600 4111111111111111 1.1.1.1\n+1 234 567 890",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000",
    'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" password="hunter2" api_key: \'ABCDEFGHIJKLMNOPQRST\'',
    "9" * 3000 + "@" + "1." * 500 + "x" + "a" * 3000,
    "+1" + "(" * 3000 + "2345678",
    "a@" + "b." * 3000 + "c",
    "1-2 3 4" * 300,
]


def spans(spark, rows):
    found = pii.find(edge_documents(spark, rows))
    return found.select("_row.doc_id", "_row.text", pii.joined_spans(pii.BASE).alias("base"), pii.joined_spans().alias("all"), *[pii.count_of(kind).alias(kind) for kind in pii.BASE]).collect()


def test_base_spans(spark):
    rows = [(i, text, "en", "s") for i, text in enumerate(TEXTS)] + EDGES
    found = spans(spark, rows)
    assert len(found) == len(rows)
    for row in found:
        expected = base_spans(row.text)
        assert row.base == ",".join(expected), row.text[:80]
        assert [row[kind] for kind in pii.BASE] == [sum(span.startswith(f"{kind}:") for span in expected) for kind in pii.BASE]


def test_added_spans(spark):
    found = {row.doc_id: row["all"] for row in spans(spark, [(i, text, "en", "s") for i, text in enumerate(TEXTS)])}

    def texts(i, kind):
        places = [span.split(":") for span in found[i].split(",") if span]
        return [TEXTS[i][int(a) : int(b)] for name, a, b in places if name == kind]

    assert texts(7, "iban") == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert texts(8, "secret") == ['token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "api_key: 'ABCDEFGHIJKLMNOPQRST'"]


def test_long_secrets_are_whole(spark):
    texts = [f'x token="{"eyJhbGciOi" * n}.{"aB3_-" * n}" y' for n in (8, 40, 20_000)] + ['token="' + "a" * 3000 + " "]
    found = {row.doc_id: row["all"] for row in spans(spark, [(i, text, "en", "s") for i, text in enumerate(texts)])}
    assert found == {**{i: f"secret:2:{len(texts[i]) - 2}" for i in range(3)}, 3: ""}


def test_context_raises_the_score(spark):
    docs = edge_documents(spark, [(1, "call +1 234 567 890", "en", "s"), (2, "nothing +1 234 567 890", "en", "s")])
    scores = {row.doc_id: row["_spans"][0].score for row in pii.find(docs).select("_row.doc_id", "_spans").collect()}
    assert scores == {1: 0.8, 2: 0.6}


def test_context_decides_on_numbers_without_a_checksum(spark):
    number = "DE88 3704 0044 0532 0130 00"
    texts = [f"my account {number} is", f"part {number} is", f"{number} {number} account {number}", "account " + "x" * 40 + f" {number}"]
    found = {row.doc_id: row["all"] for row in spans(spark, [(i, text, "en", "s") for i, text in enumerate(texts)])}
    assert found == {0: "iban:11:38", 1: "", 2: "iban:64:91", 3: ""}


def test_many_spans_take_time_in_proportion(spark):
    """What one row takes grows with its spans, not with their square."""

    def seconds(n):
        docs = edge_documents(spark, [(1, "é a.b@c.de or 10.0.0.1, " * n, "en", "s")]).cache()
        docs.count()
        start = time.perf_counter()
        counts = pii.find(docs).select(F.size("_spans"), F.sha2(pii.joined_spans(), 256)).first()
        assert counts[0] == 2 * n
        return time.perf_counter() - start

    seconds(100)
    small = seconds(4_000)
    assert seconds(32_000) < 24 * small + 2


def test_redact(spark):
    docs = edge_documents(spark, [(1, "é to a@b.co, 1.1.1.1 end", "en", "s"), (2, None, "en", "s")])
    done = pii.redact(docs)
    assert done.columns == docs.columns
    assert {row.doc_id: row.text for row in done.collect()} == {1: "é to <email>, <ip> end", 2: None}


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find(docs).select("_row.text", F.sha2(pii.joined_spans(pii.BASE), 256).alias("sha")).collect()
    assert all(row.sha == sha256(",".join(base_spans(row.text))) for row in found)


def test_empty(spark):
    assert pii.find(edge_documents(spark, [])).count() == 0
