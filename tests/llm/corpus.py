"""Small tables for the corpus tests, and plain versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCES = [f"{a} {b} {c} went over the {d} hill and saw {e} rivers" for a, b, c, d, e in zip("one two six ten".split() * 9, "red blue grey".split() * 12, "fox cat dog owl".split() * 9, "high low green far old new".split() * 6, "many few nine broad deep".split() * 7)]
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(60_000))
# Null and empty values in every column, ties, repeated rows, a very long text.
EDGES = [
    (1, "\n".join(SENTENCES[:6]), "en", "a"),
    (1, "\n".join(SENTENCES[:6]), "en", "a"),
    (2, "\n".join(SENTENCES[2:9]), "en", None),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\n\n ", "en", ""),
    (6, LONG, "en", "a"),
    (7, "12 34 !! éè \U0001f600 中文", "fr", "b"),
    (None, "\n".join(SENTENCES[:6]), "en", "a"),
    (None, None, None, None),
    (8, "one", "fr", "z"),
    (8, "two words", "fr", "z"),
]
CLASHES = ("_row", "_doc", "_text", "_key", "_id", "fingerprint", "group", "text_key", "size", "taken", "kept", "lines", "places", "first", "wrapper", "host", "seed", "_lines", "__lines", "words", "word", "lang_", "ids", "text_key_", "part", "range", "chain", "f", "n", "a")
DOCUMENTS = "doc_id long, text string, lang string, source string"


def edge_documents(spark, rows=EDGES):
    """`documents` with columns named like those that the operators make."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCUMENTS)
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHES})


def words(text):
    return WORD.findall(text or "")


def base_features(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a text."""
    text = text or ""
    found, seen, repeated = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    counts, covered = collections.Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered.update(range(i, i + 8))
    n = len(found)
    return n, sum(map(len, found)), sum(text.count(sign) for sign in "#*$%&|<>"), repeated, len(covered), n < 20 or 100 * len(covered) > 30 * n


def fingerprint(text):
    found = words(re.sub("[A-Z]", lambda sign: sign[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """The least place reachable from each place, over all pairs."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in _KINDS.items():
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(part) <= 255 for part in match[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{match.start()}:{match.end()}")
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
