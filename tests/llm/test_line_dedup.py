from corpus import EDGES, edge_documents

from siftlog.llm import line_dedup


def plain(rows):
    """Texts after the removal, row by row; rows equal in id and text are one document."""
    order = sorted({(doc is None, doc or 0, text) for doc, text, *_ in rows if text is not None}, key=lambda key: key[:2])
    seen, cut = {}, {}
    held = {key: [(i, line.strip(" \t\n\v\f\r")) for i, line in enumerate(key[2].split("\n")) if line.strip(" \t\n\v\f\r")] for key in order}
    for key in order:
        for place in range(len(held[key]) - 2):
            window = tuple(line for _, line in held[key][place : place + 3])
            if seen.setdefault(window, (key, place)) != (key, place):
                cut.setdefault(key, set()).update(i for i, _ in held[key][place : place + 3])
    return [text if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in cut.get((doc is None, doc or 0, text), ())) for doc, text, *_ in rows]


def check(spark, rows):
    docs = edge_documents(spark, rows)
    done = line_dedup.dedup_lines(docs)
    assert line_dedup.counts_name(docs) == "___lines"
    assert done.columns == [*docs.columns, "___lines"]
    assert {row["_lines"] for row in done.select("_lines").collect()} <= {"own _lines"}
    found = done.collect()
    key = lambda pair: (str(pair[0]), pair[1] is None, pair[1] or "")
    assert sorted(((row.doc_id, row.text) for row in found), key=key) == sorted(zip([row[0] for row in rows], plain(rows)), key=key)
    return {(row.doc_id, row.text): row["___lines"] for row in found}


def test_edges(spark):
    check(spark, EDGES)


def test_overlapping_windows_merge(spark):
    lines = "a b c d e".split()
    rows = [(1, "\n".join(["x", *lines, "y"]), "en", "s"), (2, "\n".join(["p", " a ", "", "b", "c\t", "d", "e", "q"]), "en", "s"), (3, "a\nb\nz\nb\nc", "en", "s"), (4, "r\nr\nr\nr\nr", "en", "s")]
    found = check(spark, rows)
    assert found[(2, "p\n\nq")].removed == 5
    assert found[(3, "a\nb\nz\nb\nc")].removed == 0
    assert found[(4, "r")].removed == 4


def test_empty(spark):
    assert line_dedup.dedup_lines(edge_documents(spark, [])).count() == 0


def test_char_counts(spark):
    docs = spark.createDataFrame([("abc", 9), (None, 9)], "text string, n_chars long")
    assert sorted(line_dedup.with_char_counts(docs).collect(), key=str) == [("abc", 3), (None, None)]
    assert line_dedup.with_char_counts(docs.drop("n_chars")).columns == ["text"]
