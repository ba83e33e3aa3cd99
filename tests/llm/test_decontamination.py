import random

import numpy as np
import pytest
from corpus import EDGES, edge_documents

from siftlog.llm import decontamination as D

ITEMS = "item_id long, text string, words string, score double"


def plain_score(window, item):
    rows = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (D.MATCH if a == b else D.MISMATCH), rows[i - 1][j] + D.GAP, rows[i][j - 1] + D.GAP)
    return max(map(max, rows))


def test_alignment(monkeypatch):
    rng = np.random.default_rng(4)
    windows = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(80)]
    items = [rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(80)]
    expected = [plain_score(a.tolist(), b.tolist()) for a, b in zip(windows, items)]
    assert D.align(windows, items).tolist() == expected
    monkeypatch.setattr(D, "CELLS", 64)
    assert D.align(windows, items).tolist() == expected


def vocabulary(draw, n):
    return ["".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(n)]


def corpus(seed=7):
    """Clean documents, exact and edited copies of items in new surroundings."""
    draw = random.Random(seed)
    vocab = vocabulary(draw, 3000)
    say = lambda n: [draw.choice(vocab) for _ in range(n)]
    items = [(i, say(draw.randint(14, 60))) for i in range(20)]
    items.append((20, items[0][1][:10] + say(300)))
    rows, planted = [], set()
    for doc in range(200):
        rows.append((doc, " ".join(say(draw.randint(5, 300))), "en", "s"))
    for doc in range(200, 320):
        item, words = draw.choice(items)
        words = list(words)
        for _ in range(int(len(words) * draw.choice([0, 0, 0.05, 0.1, 0.15]))):
            at = draw.randrange(len(words))
            edit = draw.choice("sid")
            words[at : at + (edit != "i")] = [] if edit == "d" else [draw.choice(vocab)]
        text = say(draw.randint(0, 80)) + [word.upper() if draw.random() < 0.2 else word + draw.choice(["", "", ",", "!"]) for word in words] + say(draw.randint(0, 80))
        rows.append((doc, draw.choice([" ", "\n"]).join(text), "en", "s"))
        planted.add((doc, item))
    # One passage in many documents.
    for doc in range(400, 500):
        rows.append((doc, " ".join(say(20) + items[3][1] + say(20)), "en", "s"))
        planted.add((doc, 3))
    return rows, [(i, " ".join(words), "own", 0.0) for i, words in items], planted


def test_planted_copies(spark):
    rows, items, planted = corpus()
    found = D.contaminated(edge_documents(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    pairs = {(row.doc_id, row.item_id) for row in found}
    assert planted <= pairs
    assert {doc for doc, _ in pairs} == {doc for doc, _ in planted}
    assert all(0.5 <= row.score <= 1 for row in found)


def test_scores_are_those_of_whole_texts(spark):
    rows, items, planted = corpus(11)
    texts, by_id = {doc: text for doc, text, *_ in rows}, {i: text for i, text, *_ in items}
    plain = lambda text: "".join(c if c.isalnum() else " " for c in text.lower()).split()
    for row in D.contaminated(edge_documents(spark, rows), spark.createDataFrame(items, ITEMS)).collect()[:60]:
        item = plain(by_id[row.item_id])
        assert row.n_words == len(item)
        assert row.score == pytest.approx(plain_score(plain(texts[row.doc_id]), item) / len(item))


def test_edges(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame([(1, EDGES[0][1].split("\n")[1], None, None), (2, None, None, None), (3, "", None, None), (4, "two words", None, None), (None, EDGES[0][1].split("\n")[2], None, None)], ITEMS)
    found = {(row.doc_id, row.item_id) for row in D.contaminated(docs, items).collect()}
    item = EDGES[0][1].split("\n")[1].split()
    near = {doc for doc, text, *_ in EDGES if text and len(text) < 10_000 and plain_score(text.split(), item) >= D.LEAST_SCORE * len(item)}
    assert found == {(doc, 1) for doc in near} >= {(1, 1), (None, 1)}
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str((row.doc_id, row.text)) for row in kept.collect()) == sorted(str((doc, text)) for doc, text, *_ in EDGES if doc not in near or text is None)
    assert D.contaminated(edge_documents(spark, []), items).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_every_pair_that_reaches_the_least_score_is_found(spark):
    """Edited passages that stand in many documents, and copies with a word put in after every second one."""
    draw = random.Random(3)
    vocab = vocabulary(draw, 3000)
    say = lambda n: [draw.choice(vocab) for _ in range(n)]
    items = [(i, [f"x{i}q{k}" for k in range(n)]) for i, n in enumerate([12, 12, 16, 4, 20, 30, 12])]
    edited = list(items[0][1])
    edited[4], edited[8] = "other", "words"
    texts = [say(30) + edited + say(30) for _ in range(12)] + [say(9) + edited]
    for _, words in items:
        spaced = [part for k, word in enumerate(words) for part in ([word, "in"] if k % 2 and k < len(words) - 1 else [word])]
        texts += [say(draw.randint(0, 40)) + spaced + say(draw.randint(0, 40)) for _ in range(6)]
        for share in (0.1, 0.2, 0.25, 0.3, 0.4):
            texts.append(say(5) + [draw.choice(vocab) if draw.random() < share else word for word in words] + say(50))
    rows = [(i, " ".join(text), "en", "s") for i, text in enumerate(texts)]
    found = D.contaminated(edge_documents(spark, rows), spark.createDataFrame([(i, " ".join(words), "own", 0.0) for i, words in items], ITEMS)).collect()
    scores = {(doc, i): plain_score(text, words) / len(words) for doc, text in enumerate(texts) for i, words in items}
    expected = {pair: score for pair, score in scores.items() if score >= D.LEAST_SCORE}
    assert len(expected) > 40
    assert {(row.doc_id, row.item_id): row.score for row in found} == pytest.approx(expected)
