import random

import pytest
from corpus import EDGES, edge_documents, words

from siftlog.llm import mixing


def targets(sizes):
    """Source sizes to targets: shares by weight, raised until the words are given out."""
    names = sorted((name for name in sizes if name is not None), key=lambda name: name.encode()) + [None] * (None in sizes)
    weight = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    full = set()
    while True:
        rest = [name for name in names if name not in full]
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[name] for name in full)) / (sum(weight[name] for name in rest) or 1)
        above = {name for name in rest if level * weight[name] >= 2 * sizes[name]}
        if not above:
            return {name: 2.0 * sizes[name] if name in full else level * weight[name] for name in names}
        full |= above


def check(spark, rows):
    found = mixing.mix(edge_documents(spark, rows)).collect()
    assert sorted((str(row.doc_id), str(row.source), row.size) for row in found) == sorted((str(doc), str(source), len(words(text))) for doc, text, _, source in rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    expected = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for row in found:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(expected[row.source])
        assert 0 <= row.taken <= 2 * row.size
        assert int(row.target / row.source_size if row.source_size else 0) * row.size <= row.taken
        taken[row.source] += row.taken
    for source in sizes:
        assert abs(taken[source] - expected[source]) <= 1
    return sorted((str(row.doc_id), row.size, row.taken) for row in found)


def test_edges(spark):
    check(spark, EDGES)


def test_many_groups_and_levels(spark, monkeypatch):
    """Small groups, so that the tree has several levels; reruns agree."""
    monkeypatch.setattr(mixing, "GROUP", 6)
    draw = random.Random(5)
    rows = [(i, " ".join(["w"] * int(draw.lognormvariate(3, 1.2))), "en", draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(250)]
    first = check(spark, rows)
    assert first == check(spark, rows[::-1])


def test_copies_keep_their_expected_value(spark):
    """Over many equal documents, the share that gets a copy more is the fraction."""
    rows = [(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(2000)]
    found = mixing.mix(edge_documents(spark, rows)).collect()
    for source in "ab":
        own = [row for row in found if row.source == source]
        assert sum(row.taken for row in own) == pytest.approx(own[0].target, abs=1)
        assert {row.copies for row in own} <= {int(own[0].target / own[0].source_size), int(own[0].target / own[0].source_size) + 1}


def test_repeated_rows_and_empty(spark):
    check(spark, [(1, "a b c", "en", "s")] * 7 + [(2, "a b", "en", "t"), (3, "", "en", "u")])
    assert mixing.mix(edge_documents(spark, [])).count() == 0
