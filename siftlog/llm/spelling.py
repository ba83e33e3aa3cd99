"""Groups of spelling variants: words one edit apart, by dynamic programming over a sorted list.

Of a word and its neighbour, one edit apart, either the first half of the word stands
at the start of the neighbour or the rest of it stands at the end. So each word looks
for neighbours twice: in the sorted vocabulary, among the words with its first half,
and in the sorted list of reversed words, among those with its rest reversed.

The list is scanned as ranges that share a prefix (the LCPs of adjacent words bound
them). A word's edit matrix has one row per prefix, and three cells of it count at one
edit; the row of a prefix is made once for all words of its range and from the row of the
prefix one shorter. Where all three cells exceed one edit, the range is skipped. Many words
look at once, as arrays.

The lists are cut into blocks of about BLOCK_WORDS. A word goes to the blocks that hold
its half, which are few; a block whose shared prefix already exceeds one edit is left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import ready
from siftlog.session import stage

# A word is a run of these, of this many code points and occurrences at least.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_CHARS, LEAST_COUNT = 7, 2
# One occurrence in so many, by a checksum, loses a code point; a form is so many times as frequent as its variant.
NOISE, FORM_RATIO = 31, 10
BLOCK_WORDS = 20_000
# Words that look for neighbours at once, and sampled words for each border of blocks.
WORDS_AT_ONCE, SAMPLED = 4096, 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOP = "\U0010ffff"


def occurrences(docs: DataFrame) -> DataFrame:
    """Each `word` of the texts, as often as it occurs there, A-Z in lower case, with a few damaged by rule.

    A run whose checksum with the doc_id divides by NOISE loses one code point. A null
    doc_id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"))
    lower = runs.select("doc", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    sums = lower.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("sum"))
    at = (F.col("sum") % F.length("run")).cast("int")
    damaged = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = sums.select(F.when(F.col("sum") % NOISE == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_CHARS)


def vocabulary(docs: DataFrame) -> DataFrame:
    """`word` and its occurrences `n` over all documents, for words that occur often enough."""
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _half(word: str, side: int) -> int:
    """Code points of a key that its neighbours of a side share: the first half, or the rest of the reversed word."""
    return len(word) // 2 if side == 0 else len(word) - len(word) // 2


def prefix_reach(prefix: str, key: str) -> int:
    """The least number of edits, up to 2, between `prefix` and any beginning of `key`."""
    low, middle, high = 2, 0, 1
    for i, sign in enumerate(prefix):
        # Distances to the first i, i + 1 and i + 2 code points of the key.
        low = min(low + (key[i - 1 : i] != sign), middle + 1, 2) if i <= len(key) else 2
        middle = min(middle + (key[i : i + 1] != sign), high + 1, low + 1, 2) if i + 1 <= len(key) else 2
        high = min(high + (key[i + 1 : i + 2] != sign), middle + 1, 2) if i + 2 <= len(key) else 2
    return min(low, middle, high)


class SortedWords:
    """A sorted list of distinct words that finds the neighbours of words in it."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.codes, self.starts, lengths = _codes(words, 0)
        n = len(words)
        # lcp[i]: code points that words i - 1 and i share; the borders of the list share none.
        self.lcp = np.zeros(n + 1, np.int64)
        self.lcp[[0, n]] = -1
        active = np.arange(1, n)
        depth = 0
        while len(active):
            own = self.codes[self.starts[active] + depth]
            active = active[(own == self.codes[self.starts[active - 1] + depth]) & (own != 0) & (lengths[active - 1] > depth)]
            self.lcp[active] += 1
            depth += 1

    def neighbours(self, queries: list[str], heads: list[int], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of places, for words one edit from the query with the same first `heads` code points.

        `own` has the place of a query in the list, or -1.
        """
        codes, starts, lengths = _codes(queries, 2)
        low = np.array([bisect_left(self.words, query[:head]) for query, head in zip(queries, heads)], np.int64)
        high = np.array([bisect_left(self.words, query[:head] + _TOP) for query, head in zip(queries, heads)], np.int64)
        head = np.array(heads, np.int64)
        pending = np.argsort(head, kind="stable")
        pending = pending[(high > low)[pending]]
        query = lo = hi = np.zeros(0, np.int64)
        rows = np.zeros((3, 0), np.int8)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        depth = int(head[pending[0]]) if len(pending) else 0
        while len(query) or len(pending):
            if len(pending) and not len(query):
                depth = max(depth, int(head[pending[0]]))
            new, pending = pending[head[pending] == depth], pending[head[pending] != depth]
            if len(new):
                # The row of a prefix that the query has too.
                first = np.empty((3, len(new)), np.int8)
                first[0], first[1], first[2] = (1 if depth else 2), 0, np.where(depth + 1 <= lengths[new], 1, 2)
                query, lo, hi, rows = np.concatenate([query, new]), np.concatenate([lo, low[new]]), np.concatenate([hi, high[new]]), np.concatenate([rows, first], axis=1)
            # Ranges that share one code point more.
            borders = np.flatnonzero(self.lcp <= depth)
            a = np.searchsorted(borders, lo)
            n = np.searchsorted(borders, hi) - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            lo, hi = borders[at], borders[at + 1]
            query, rows = np.repeat(query, n), np.repeat(rows, n, axis=1)
            sign = self.codes[self.starts[lo] + depth]
            ended = sign == 0
            if ended.any():
                cell = lengths[query] - depth + 1
                near = ended & (cell >= 0) & (cell <= 2)
                near[near] = rows[cell[near], np.flatnonzero(near)] == 1
                hits.append((query[near], lo[near]))
            alone = (hi - lo == 1) & (lo == own[query])
            open_ = ~ended & ~alone
            query, lo, hi, sign, rows = query[open_], lo[open_], hi[open_], sign[open_], rows[:, open_]
            rows = self._next(rows, sign, codes, starts[query], lengths[query], depth)
            keep = rows.min(axis=0, initial=2) <= 1
            query, lo, hi, rows = query[keep], lo[keep], hi[keep], rows[:, keep]
            depth += 1
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *part]) for part in zip(*hits)) if hits else (empty, empty)

    @staticmethod
    def _next(rows: np.ndarray, sign: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
        """The rows of prefixes one code point longer: distances to the query's first depth, depth + 1 and depth + 2."""
        at = starts + np.minimum(depth, lengths + 1)
        differs = [(codes[at + k] != sign).astype(np.int8) for k in (-1, 0, 1)]
        low = np.minimum(rows[0] + differs[0], rows[1] + 1)
        low[depth > lengths] = 2
        middle = np.minimum(np.minimum(rows[1] + differs[1], rows[2] + 1), low + 1)
        middle[depth + 1 > lengths] = 2
        high = np.minimum(rows[2] + differs[2], middle + 1)
        high[depth + 2 > lengths] = 2
        return np.minimum(np.stack([low, middle, high]), 2).astype(np.int8)


def _codes(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each with a zero behind it (and `pad` more, one of them before), where they start, and lengths."""
    before, after = "\0" * (pad > 0), "\0" * (1 + pad)
    codes = np.frombuffer("".join([f"{before}{word}{after}" for word in words]).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sizes = lengths + len(before) + len(after)
    return codes, np.cumsum(sizes) - sizes + len(before), lengths


class _Block:
    """The list of a block and what its words have found."""

    def __init__(self, side: int, keys: list[str], counts: np.ndarray) -> None:
        self.side, self.counts = side, counts
        self.sorted = SortedWords(keys)
        self.words = keys if side == 0 else [key[::-1] for key in keys]
        rank = np.empty(len(keys), np.int64)
        rank[sorted(range(len(keys)), key=self.words.__getitem__)] = np.arange(len(keys))
        self.rank = rank

    def look(self, keys: list[str], own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(keys), WORDS_AT_ONCE):
            some = keys[first : first + WORDS_AT_ONCE]
            query, word = self.sorted.neighbours(some, [_half(key, self.side) for key in some], own[first : first + WORDS_AT_ONCE])
            originals = some if self.side == 0 else [key[::-1] for key in some]
            if self.side == 1 and len(query):
                # Those with the first half as well were found in the other list.
                new = np.array([not self.words[w].startswith(originals[q][: len(originals[q]) // 2]) for q, w in zip(query.tolist(), word.tolist())])
                query, word = query[new], word[new]
            if not len(query):
                continue
            order = np.lexsort((self.rank[word], -self.counts[word], query))
            query, word = query[order], word[order]
            firsts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            columns = [
                pa.array([originals[q] for q in query[firsts].tolist()], pa.string()),
                pa.array(np.diff(np.append(firsts, len(query)))),
                pa.array(self.counts[word[firsts]]),
                pa.array([self.words[w] for w in word[firsts].tolist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def _look_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of block, kind (0 listed, 1 only looking) and key; listed words look in their block as well."""
    now: tuple[int, int] | None = None
    keys: list[str] = []
    counts: list[np.ndarray] = []
    block: _Block | None = None

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal block
        block = _Block(now[1], keys, np.concatenate(counts)) if keys else None
        if block:
            yield from block.look(keys, np.arange(len(keys)))

    for batch in batches:
        ids = np.stack([batch.column(name).to_numpy() for name in ("block", "side", "kind")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            number, side, kind = ids[:, a].tolist()
            if now != (number, side):
                if block is None and keys:
                    yield from closed()
                now, keys, counts, block = (number, side), [], [], None
            part = batch.slice(a, b - a)
            some = part.column("key").to_pylist()
            if kind == 0:
                keys.extend(some)
                counts.append(part.column("n").to_numpy())
                continue
            if block is None and keys:
                yield from closed()
            if block:
                yield from block.look(some, np.full(len(some), -1))
    if block is None and keys:
        yield from closed()


def _shared(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def _borders(words: DataFrame, total: int, blocks: int) -> list[list[str]]:
    """Borders of the blocks of both lists, from about SAMPLED words a block chosen by hash."""
    share = min(1.0, SAMPLED * blocks / max(total, 1))
    chosen = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("word")
    sample = [row.word for row in chosen.toLocalIterator()]
    out = []
    for keys in (sorted(sample), sorted(word[::-1] for word in sample)):
        out.append(sorted({keys[len(keys) * i // blocks] for i in range(1, blocks)}) if keys else [])
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """`word`, how many words of the table are one edit away (`n_near`), and the most frequent of them.

    `words` has distinct words in `word` and their number in `n`, and is read more
    than once. Ties go to the word first in code-point order. Words without a
    neighbour have no row.
    """
    spark = words.sparkSession
    total = words.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BLOCK_WORDS))
    # Strings in number as SAMPLED times the blocks at most come to the driver; the borders are one a block.
    shared = spark.sparkContext.broadcast(_borders(words, total, blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for side, borders in enumerate(lists):
                    key = word if side == 0 else word[::-1]
                    half = key[: _half(key, side)]
                    home = bisect_right(borders, key)
                    rows.append((home, side, 0, key, n))
                    for number in range(bisect_right(borders, half), bisect_left(borders, half + _TOP) + 1):
                        inner = 0 < number < len(borders)
                        if number != home and not (inner and prefix_reach(_shared(borders[number - 1], borders[number]), key) > 1):
                            rows.append((number, side, 1, key, n))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["block", "side", "kind", "key", "n"])

    routed = words.select("word", "n").mapInArrow(route, "block int, side int, kind int, key string, n long")
    placed = routed.repartitionById(2 * blocks, F.col("side") * blocks + F.col("block")).sortWithinPartitions("block", "side", "kind", "key")
    found = placed.mapInArrow(_look_in_blocks, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def _last(pairs: DataFrame) -> DataFrame:
    """`word` and the end of its chain of forms, `root`, from rows (word, root) of one step.

    Each round doubles the steps; the number of rounds is the logarithm of the longest chain.
    """
    now = stage(pairs, "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stage(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Every word of the vocabulary with its `form`, the `root` of its forms, and figures.

    Columns `word`, `form`, `root`, `n`, `n_near`, `form_n`. The form is the most frequent
    word one edit away if it is FORM_RATIO times as frequent, else null; `root` is the
    last of the forms of forms, the word itself if it has none. A form is far more
    frequent than its variant, so chains end.

    Null and empty texts have no word, rows that repeat count as often as they are
    there, other columns are not read. Words of any length count. An empty table gives none.
    """
    ready(docs.sparkSession)
    words = stage(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    near = neighbours(words)
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = words.join(near, "word", "left").select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = stage(rows, "variants")
    roots = _last(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", _or_word("root"), "n", "n_near", "form_n")


def _or_word(name: str) -> Column:
    return F.coalesce(name, "word").alias(name)
