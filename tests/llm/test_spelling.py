import collections
import random
import re
import zlib

import numpy as np
import pytest
from corpus import EDGES, edge_documents

from siftlog.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """The result over all pairs."""
    counts = collections.Counter()
    for doc, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            sum_ = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if sum_ % 31 == 0:
                at = sum_ % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {word: n for word, n in counts.items() if n >= 2}
    near = {word: [other for other in words if one_edit(word, other)] for word in words}
    best = {word: min(found, key=lambda other: (-words[other], other)) for word, found in near.items() if found}
    form = {word: other for word, other in best.items() if words[other] >= 10 * words[word]}

    def root(word):
        while word in form:
            word = form[word]
        return word

    return sorted((word, form.get(word), root(word), n, len(near[word]), words.get(form.get(word))) for word, n in words.items())


def check(spark, rows):
    found = spelling.variants(edge_documents(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, found.collect()), key=lambda row: row[0])
    assert got == plain(rows)
    return got


def planted(seed, words, rows):
    """Texts with words of a small alphabet, many of them one edit apart, some in chains of forms."""
    draw = random.Random(seed)
    stock = ["".join(draw.choices("abé", k=draw.randint(7, 9))) for _ in range(words)]
    stock += [word[:i] + draw.choice(["", "ÿ", "ab"]) + word[i + 1 :] for word in stock for i in draw.sample(range(len(word)), 2)]
    weights = [1 / (1 + i) ** 1.6 for i in range(len(stock))]
    signs = [" ", ", ", "\n", "1", "Ā", "×-"]
    chain = [(rows, " ".join(["chainaab"] * 3 + ["chainabb"] * 40 + ["chainbbb"] * 500), "en", "s")]
    return chain + [(i, "".join(word.capitalize() if draw.random() < 0.2 else word + draw.choice(signs) for word in draw.choices(stock, weights, k=200)), "en", "s") for i in range(rows)]


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_planted_variants_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rows = planted(block, 60, 40)
    found = check(spark, rows)
    assert sum(row[1] is not None for row in found) > 20
    assert ("chainaab", "chainabb", "chainbbb") in {row[:3] for row in found}


def test_edges(spark):
    check(spark, EDGES)


def test_long_and_alike_words(spark):
    """Words that share long prefixes, very long ones, and ties."""
    long = "ab" * 3000
    rows = [(i, " ".join(["a" * n for n in range(7, 40)] + [long, long + "c", "x" + long, long[:2000] + "b" + long[2000:], "Banane bänane banane"]), "en", "s") for i in range(3)]
    rows += [(9, "worduber worduber wordabcr wordubcr wordubcr", None, None)]
    found = {row[0]: row for row in check(spark, rows)}
    assert found["a" * 20][4] == 2


def test_empty(spark):
    assert spelling.variants(edge_documents(spark, [])).collect() == []
    assert spelling.variants(edge_documents(spark, [(1, "short words only", "en", "s")])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_scan_against_all_pairs(seed):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choices("ab" if seed % 2 else "abcd", k=draw.randint(1, 8))) for _ in range(250)})
    queries = words + ["".join(draw.choices("abc", k=draw.randint(1, 9))) for _ in range(100)]
    heads = [draw.randint(0, len(query)) for query in queries]
    own = np.array([*range(len(words)), *(words.index(query) if query in words else -1 for query in queries[len(words) :])])
    found = set(zip(*(part.tolist() for part in spelling.SortedWords(words).neighbours(queries, heads, own))))
    expected = {(q, w) for q, query in enumerate(queries) for w, word in enumerate(words) if one_edit(query, word) and word[: heads[q]] == query[: heads[q]]}
    assert found == expected


def test_prefix_reach():
    draw = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            out = [i + 1]
            for j, y in enumerate(b):
                out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
            row = out
        return row

    for _ in range(3000):
        prefix, key = ("".join(draw.choices("ab", k=draw.randint(0, 6))) for _ in range(2))
        assert spelling.prefix_reach(prefix, key) == min(2, min(distance(prefix, key)))
