import collections
import random
import re
import tracemalloc
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from corpus import EDGES, edge_documents

from siftlog.llm import phrases

BREAK, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=100, top=2000, percent=100):
    """The result from all counts at once."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in BREAK.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {gram: a for gram, a in f.items() if len(gram) > 2 and a >= least}
    held = collections.Counter()
    for (lang, *words), a in found.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words):
                    part = (lang, *words[i:j])
                    held[part] = max(held[part], a)
    out = collections.defaultdict(list)
    for gram, a in found.items():
        lang, *words = gram
        cuts = [(1000 * a * n[lang] // (f[gram[: k + 1]] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if 100 * held[gram] < percent * a:
            out[lang].append((-score, -a, " ".join(words).encode(), f[gram[: k + 1]], f[(lang, *words[k:])]))
    return sorted((lang, rank, phrase.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1))


def check(spark, rows, **figures):
    found = phrases.collocations(edge_documents(spark, rows))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain(rows, **figures)
    assert sorted(map(tuple, found.collect())) == expected
    return expected


def repeated(seed, rows, langs=("en", "fr", None, "und")):
    draw = random.Random(seed)
    stock = ["New", "york", "\x01", "a!b", "été", "of", "the", "end", "\U0001f600", "x\x02y"]
    fixed = ["new york of the end", "the end\tof  new york", "été \x01 été"]
    signs = [" ", " ", " ", "\t", ", ", ".", "\n", "\v"]

    def text():
        return "".join((draw.choice(fixed) if draw.random() < 0.2 else draw.choice(stock[: draw.randint(2, 10)])) + draw.choice(signs) for _ in range(60))

    return [(i, text(), draw.choice(langs), "s") for i in range(rows)]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (20, 7)])
def test_against_plain_counts(spark, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "LEAST_COUNT", least)
    monkeypatch.setattr(phrases, "TOP", top)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    found = check(spark, repeated(least, 120), least=least, top=top)
    assert len(found) > 20 and {row[0] for row in found} == {"en", "fr", "und"}


def test_filters_that_let_too_much_through(spark, monkeypatch):
    """Filters of 64 bits are full, and stop nothing."""
    monkeypatch.setattr(phrases, "LEAST_COUNT", 4)
    monkeypatch.setattr(phrases, "FIELD_BITS", 6)
    assert check(spark, repeated(9, 60), least=4)


def test_a_share_of_the_shorter_phrase(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_COUNT", 5)
    monkeypatch.setattr(phrases, "HELD_PERCENT", 60)
    check(spark, repeated(4, 80), least=5, percent=60)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_COUNT", 2)
    assert check(spark, EDGES * 2, least=2)


def test_empty(spark):
    assert phrases.collocations(edge_documents(spark, [])).collect() == []
    assert phrases.collocations(edge_documents(spark)).collect() == plain(EDGES)


def test_scores_beyond_64_bits():
    rows = [("en", words, f, 0, None) for words, f in [([], 3 * 10**15), (["a"], 10**9), (["a", "b"], 10**6 + 7)]]
    (_, words, a, longer, _, chain), *_ = phrases.in_step(iter(rows))
    assert (words, a, longer, chain) == (["a", "b"], 10**6 + 7, 0, [3 * 10**15, 10**9])
    assert 1000 * a * chain[0] > 1 << 64


def test_words_do_not_cross_rows_or_marks():
    data = np.frombuffer("Ab c.d\te".encode() + b"f g", np.uint8)
    words = phrases.Words(data, np.array([0, 8, 8, 11]))
    assert words.texts().to_pylist() == [b"ab", b"c", b"d", b"e", b"f", b"g"]
    assert words.row.tolist() == [0, 0, 0, 0, 2, 2]
    assert words.windows(2).tolist() == [True, False, True, False, True]
    assert words.windows(9).tolist() == []


def test_counts_are_combined_before_the_shuffle(spark, monkeypatch):
    texts = ["a b c. A  b"] * 120 + ["x y"] * 3
    docs = spark.createDataFrame([("en" if i % 2 else None, text) for i, text in enumerate(texts)], "lang string, text string")
    docs = docs.selectExpr("coalesce(lang, 'und') as lang", "text").repartition(3)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 4)
    monkeypatch.setattr(phrases, "LEAST_COUNT", 50)
    fields = [np.full((1 << phrases.FIELD_BITS) // 8, 255, np.uint8)] * 3
    counted = phrases.counts(docs, fields)
    plan = counted._jdf.queryExecution().explainString(counted._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.index("partial_sum") > plan.index("Exchange")
    found = {(row.lang, tuple(row.words)): row.f for row in counted.collect()}
    odd = [text for i, text in enumerate(texts) if i % 2]
    assert found["en", ()] == sum(2 if text == "x y" else 5 for text in odd)
    assert {words: f for (lang, words), f in found.items() if lang == "en" and words} == {("a",): 120, ("b",): 120, ("c",): 60, ("a", "b"): 120, ("b", "c"): 60, ("a", "b", "c"): 60}


def rows_made(df, name):
    """Rows that the plan's nodes of this name have made, once `df` has run."""
    waiting, made = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        if node.nodeName() == name:
            made += node.metrics().apply("pythonNumRowsReceived").value()
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return made


def test_rows_of_counts_do_not_go_by_chunks_or_splits(spark, monkeypatch):
    """Every task makes one row for a phrase, however often it combines, and more splits make no more tasks."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 10)
    monkeypatch.setattr(phrases, "LEAST_COUNT", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([("en", "a b c. A  b")] * 4000, "lang string, text string").repartition(64)
        fields = [np.full((1 << phrases.FIELD_BITS) // 8, 255, np.uint8)] * 3
        counted = phrases.counts(docs, fields)
        found = {tuple(row.words): row.f for row in counted.collect()}
        assert found == {(): 20000, ("a",): 8000, ("b",): 8000, ("c",): 4000, ("a", "b"): 8000, ("b", "c"): 4000, ("a", "b", "c"): 4000}
        tasks = phrases.COUNTING_TASKS * spark.sparkContext.defaultParallelism
        assert len(found) < rows_made(counted, "MapInArrow") <= tasks * len(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_more_phrases_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 300)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 25)
    monkeypatch.setattr(phrases, "LEAST_COUNT", 5)
    assert len(check(spark, repeated(5, 120), least=5)) > 20


def test_a_task_keeps_phrases_in_few_bytes(spark):
    """Numbers stand for phrases, so between batches a task holds no phrase's words."""
    draw, held = random.Random(3), []
    stock = [f"{i:02d}" * 20 for i in range(40)]

    def batches():
        for _ in range(20):
            held.append(pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0])
            yield pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(draw.choices(stock, k=2000))]})
        held.append(pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0])

    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast = lambda value: SimpleNamespace(value=value)
    docs.sparkSession.sparkContext.defaultParallelism = docs.rdd.getNumPartitions.return_value = 1
    phrases.counts(docs, [np.full((1 << phrases.FIELD_BITS) // 8, 255, np.uint8)] * 5)
    task = docs.coalesce.return_value.mapInArrow.call_args.args[0]
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in task(batches()))
    finally:
        tracemalloc.stop()
    assert rows > 100_000
    # The helpers' own tables are there after the first batch.
    assert held[-1] - held[1] < 64 * rows


def test_phrases_keep_their_numbers_from_chunk_to_chunk():
    tallies = phrases.Tallies([np.full((1 << phrases.FIELD_BITS) // 8, 255, np.uint8)] * 3)

    def add(*rows):
        texts = pa.array([text for _, text in rows], pa.string())
        tallies.add(phrases.Words(*phrases.text_buffers(texts)), [lang for lang, _ in rows])

    def listed():
        batches = [*tallies.batches()]
        assert sum(batch.num_rows for batch in batches) <= len(tallies)
        return {(row["lang"], row["phrase"]): row["f"] for batch in batches for row in batch.to_pylist()}

    add(("fr", "m n"), ("en", None))
    add(("en", "n m. b"), ("fr", "\u00e9 m n"), ("de", ""))
    add(("en", "a m b"))
    assert listed() == {
        ("fr", ""): 5, ("en", ""): 6, ("fr", "m"): 2, ("fr", "n"): 2, ("fr", "\u00e9"): 1, ("fr", "m n"): 2, ("fr", "\u00e9 m"): 1, ("fr", "\u00e9 m n"): 1,
        ("en", "n"): 1, ("en", "m"): 2, ("en", "b"): 2, ("en", "a"): 1, ("en", "n m"): 1, ("en", "a m"): 1, ("en", "m b"): 1, ("en", "a m b"): 1,
    }
    tallies.clear()
    add(("en", "b"))
    assert listed() == {("en", ""): 1, ("en", "b"): 1}


def test_no_task_takes_two_workers(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_COUNT", 2)
    found = phrases.candidates(edge_documents(spark, EDGES))
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    steps = re.findall("Exchange|MapInArrow", plan)
    assert steps.count("MapInArrow") == 2 and "MapInArrow MapInArrow" not in " ".join(steps)
