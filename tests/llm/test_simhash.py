import random
from itertools import combinations

import numpy as np
from corpus import EDGES, classes, edge_documents, fingerprint

from siftlog.llm import simhash


def test_every_pair_within_the_radius_meets_in_a_mask():
    masks = simhash.masks()
    assert len(set(masks)) == 7
    for bits in [(), *combinations(range(64), 1), *combinations(range(64), 2)]:
        differing = sum(1 << bit for bit in bits)
        assert any(not mask & differing for mask in masks)


def test_bit_counts_over_long_runs():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bounds = np.array([0, 1, 256, 2000])
    plain = [[sum(int(h) >> bit & 1 for h in hashes[a:b]) for bit in range(64)] for a, b in zip(bounds[:-1], bounds[1:])]
    assert simhash.bit_counts(hashes, bounds).tolist() == plain


def test_edges_against_all_pairs(spark):
    rows = simhash.near_duplicates(edge_documents(spark)).collect()
    assert len(rows) == len(EDGES)
    prints = [fingerprint(text) for _, text, _, _ in EDGES]
    roots = classes(len(EDGES), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {}
    for i, (doc, *_) in enumerate(EDGES):
        if doc is not None:
            least[roots[i]] = min(doc, least.get(roots[i], doc))
    expected = sorted((str(doc), f"{prints[i]:016x}", least.get(roots[i])) for i, (doc, *_) in enumerate(EDGES))
    assert sorted((str(row.doc_id), f"{row.fingerprint % (1 << 64):016x}", row.component_id) for row in rows) == expected


def test_links_of_planted_fingerprints(spark):
    """Chains, a large group within few bits, and noise: the classes of all pairs."""
    draw = random.Random(3)
    values = {draw.getrandbits(64) for _ in range(300)}
    chain = draw.getrandbits(64)
    for step in range(12):
        values.add(chain)
        chain ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
    centre = draw.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(20, 40)}
    values = sorted(value - (1 << 64) if value >> 63 else value for value in values)
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long")))
    roots = {row.node: row.root for row in found.collect()}
    expected = classes(len(values), lambda i, j: ((values[i] ^ values[j]) % (1 << 64)).bit_count() <= 2)
    assert [roots.get(v, v) for v in values] == [values[i] for i in expected]


def test_one_of_each_group_stays(spark):
    docs = edge_documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(row.doc_id, row.text) for row in kept.collect()]
    assert [doc for doc, _ in rows].count(1) == 1
    assert (None, EDGES[0][1]) not in rows
    assert len(rows) == len(set(rows)) == len({fingerprint(text) for _, text, _, _ in EDGES})


def test_empty(spark):
    assert simhash.near_duplicates(edge_documents(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(edge_documents(spark, [])).count() == 0
