"""Phrase collocations from sorted streams of counts.

Phrases are counted level by level: one of k words can only be frequent if both
phrases of k - 1 words inside it are. The levels use hashes, as filters that may let too
much through; the counts that stay are made from the words themselves.

All counts of frequent phrases then form one stream of (language, words, count). In prefix
order, a phrase follows all its beginnings and precedes all that continue it, so one
pass with a stack of open phrases gives the counts of its beginnings, and the
largest count of a phrase one word longer. In suffix order, which is the same with the
words reversed, a second pass gives the counts of its endings and the longer phrases
to the left. The first pass' results flow through the second: the streams are merged in
step, and no count is looked up by a hash.

Streams are cut into ranges. A phrase whose continuations reach into later ranges goes to
these as well; a range border lies inside at most as many phrases as a phrase has words.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlog.llm.common import hash_ranges, long_array, mix, ready, rolled, text_buffers
from siftlog.session import stage

# The contract's figures: words of a phrase, its least count, the factor of the score, and rows per language.
MOST_WORDS, LEAST_COUNT, SCALE, TOP = 5, 100, 1000, 2000
# A phrase goes if one that holds it has this share, in percent, of its occurrences.
HELD_PERCENT = 100
NO_LANGUAGE = "und"
# Bits of the filter of a level; it takes 8 MB whatever the data.
FIELD_BITS = 26
# Tasks for each core that count phrases, and the most splits of one. Every task hands on a row for nearly every frequent phrase, so few make fewer rows.
COUNTING_TASKS, MOST_SPLITS = 2, 16
# Text bytes worked on at once, hashes kept before equal ones are combined, different phrases that a task keeps, phrases spelt out at once, sampled phrases for each border of ranges.
CHUNK_BYTES, HELD_HASHES, HELD_PHRASES, HANDED_ROWS, SAMPLED = 1 << 19, 1 << 18, 400_000, 20_000, 32
# Parts of a language's phrases that are ranked alone first.
SALTS = 16

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*range(10, 14), *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts, in order, with the number of the piece they stand in."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        kind = _KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        self.data = _LOWER[data]
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(bounds, self.starts, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts] + self.row

    def windows(self, n: int) -> np.ndarray:
        """Whether the `n` words from each word on are there and in one piece."""
        last = len(self.starts) - n + 1
        return self.piece[:last] == self.piece[n - 1 :] if last > 0 else np.zeros(0, dtype=bool)

    def hashes(self, languages: np.ndarray) -> np.ndarray:
        """A hash of each word and its text's language."""
        return mix(hash_ranges(self.data, self.starts, self.ends) + languages[self.row])

    def texts(self) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.inside])])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """Words of some whole rows, and the rows' languages."""
    data, offsets = text_buffers(batch.column("text"))
    languages = batch.column("lang").to_pylist()
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield Words(data[int(offsets[first]) : int(offsets[last])], offsets[first : last + 1] - offsets[first]), languages[first:last]
        first = last


def release() -> None:
    """Give back what Arrow keeps of freed memory: an executor's idle workers would hold it from task to task."""
    pa.default_memory_pool().release_unused()


def _language_hashes(languages: list[str]) -> np.ndarray:
    known = {name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in set(languages)}
    return np.array([known[name] for name in languages], np.uint64)


def _in_field(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FIELD_BITS)
    return (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return hashes if n == 1 else rolled(hashes, n)


def _field(texts: DataFrame, order: int, shorter: np.ndarray | None) -> np.ndarray:
    """A filter that passes the hash of every phrase of `order` words that is frequent.

    `shorter` is the filter for one word less; phrases that it stops aren't counted.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def combined() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([long_array(values), pa.array(counts)], ["gram", "n"])

        for batch in batches:
            for words, languages in _chunks(batch):
                hashes = words.hashes(_language_hashes(languages))
                grams, whole = _gram_hashes(hashes, order), words.windows(order)
                if order > 1:
                    passed = _in_field(shared.value, _gram_hashes(hashes, order - 1))
                    whole = whole & passed[:-1] & passed[1:] if len(whole) else whole
                held.append(grams[whole])
                if sum(map(len, held)) > HELD_HASHES:
                    yield combined()
            release()
        if held:
            yield combined()

    counted = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    at = F.shiftrightunsigned("gram", 64 - FIELD_BITS) + 1
    frequent = counted.filter(F.col("n") >= LEAST_COUNT).select(at.alias("at"))
    maps = frequent.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    # As many rows of 4,096 bytes as the filter has room for, at most.
    field = np.zeros((1 << FIELD_BITS) // 8, np.uint8)
    for row in maps.toLocalIterator():
        first = (row.part - 1) * 4096
        field[first : first + 4096] = np.frombuffer(bytes(row.bits), np.uint8)[: len(field) - first]
    return field


class Tallies:
    """Counts of phrases that pass the filters, and of all words of a language as the empty phrase.

    A phrase is the number of its beginning and that of its last word, so it takes the
    same few bytes whatever its length. It is spelt out when it is handed on.
    """

    def __init__(self, fields: list[np.ndarray]) -> None:
        self.fields = fields
        self.clear()

    def clear(self) -> None:
        self.languages: dict[str, int] = {}
        self.totals = np.zeros(0, np.int64)
        self.words = pa.array([], pa.large_binary())
        # For each order: sorted keys of beginning and last word, the phrases' numbers in that order, and the counts by number.
        self.keys = [np.zeros(0, np.int64) for _ in self.fields]
        self.numbers = [np.zeros(0, np.int64) for _ in self.fields]
        self.counts = [np.zeros(0, np.int64) for _ in self.fields]

    def __len__(self) -> int:
        return len(self.languages) + sum(map(len, self.keys))

    def add(self, words: Words, languages: list[str]) -> None:
        """Count the phrases of some whole rows."""
        row_codes = np.array([self.languages.setdefault(name, len(self.languages)) for name in languages], np.int64)
        beginnings = row_codes[words.row]
        totals = np.bincount(beginnings, minlength=len(self.languages)).astype(np.int64)
        totals[: len(self.totals)] += self.totals
        self.totals = totals
        if not len(words.starts):
            return
        hashes = words.hashes(_language_hashes(languages))
        lasts = self._word_numbers(words, _in_field(self.fields[0], hashes))
        for order, field in enumerate(self.fields, 1):
            whole = np.flatnonzero(words.windows(order))
            # What a filter lets through by chance may have a beginning or a last word that was stopped.
            passed = _in_field(field, _gram_hashes(hashes, order)[whole]) & (beginnings[whole] >= 0) & (lasts[whole + order - 1] >= 0)
            whole = whole[passed]
            if not len(whole):
                return
            keys, inverse, counts = np.unique(beginnings[whole] << 32 | lasts[whole + order - 1], return_inverse=True, return_counts=True)
            numbers = self._phrase_numbers(order - 1, keys)
            self.counts[order - 1][numbers] += counts
            beginnings = np.full(len(words.starts), -1, np.int64)
            beginnings[whole] = numbers[inverse]

    def _word_numbers(self, words: Words, passed: np.ndarray) -> np.ndarray:
        """The number of each word that passed the filter in one of its places, else -1."""
        coded = words.texts().dictionary_encode()
        codes = coded.indices.to_numpy()
        used = np.unique(codes[passed])
        listed = coded.dictionary.take(pa.array(used))
        found = pc.index_in(listed, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = found < 0
        found[new] = len(self.words) + np.arange(np.count_nonzero(new))
        self.words = pa.concat_arrays([self.words, listed.filter(pa.array(new))])
        numbers = np.full(len(coded.dictionary), -1, np.int64)
        numbers[used] = found
        return numbers[codes]

    def _phrase_numbers(self, level: int, keys: np.ndarray) -> np.ndarray:
        """The numbers of phrases with these sorted keys; new ones get the next."""
        known = self.keys[level]
        places = np.searchsorted(known, keys)
        old = places < len(known)
        old[old] = known[places[old]] == keys[old]
        numbers = np.empty(len(keys), np.int64)
        numbers[old] = self.numbers[level][places[old]]
        new = ~old
        numbers[new] = len(known) + np.arange(np.count_nonzero(new))
        self.keys[level] = np.insert(known, places[new], keys[new])
        self.numbers[level] = np.insert(self.numbers[level], places[new], numbers[new])
        self.counts[level] = np.concatenate((self.counts[level], np.zeros(np.count_nonzero(new), np.int64)))
        return numbers

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Language, phrase and number `f`."""
        names = pa.array(list(self.languages), pa.string())
        there = np.flatnonzero(self.totals)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(there)), pa.array([""] * len(there), pa.string()), pa.array(self.totals[there])], _TALLY)
        own, spelt = np.arange(len(names)), []
        for keys, numbers, counts in zip(self.keys, self.numbers, self.counts):
            by_number = np.empty_like(keys)
            by_number[numbers] = keys
            beginnings = by_number >> 32
            own, spelt = own[beginnings], [*(words[beginnings] for words in spelt), by_number & 0xFFFFFFFF]
            for first in range(0, len(counts), HANDED_ROWS):
                part = slice(first, first + HANDED_ROWS)
                parts = [self.words.take(pa.array(words[part])) for words in spelt]
                phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own[part])), phrases, pa.array(counts[part])], _TALLY)


_TALLY = ["lang", "phrase", "f"]


def counts(docs: DataFrame, fields: list[np.ndarray]) -> DataFrame:
    """`lang`, `words` and count `f` of every frequent phrase; the empty phrase counts all words of a language.

    A few tasks for each core read all texts. They keep their phrases as numbers and hand
    them on once there are more than HELD_PHRASES different ones; Spark combines what is
    left of a task before the shuffle.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tallies(shared.value)
        for batch in batches:
            for words, languages in _chunks(batch):
                tallies.add(words, languages)
                if len(tallies) > HELD_PHRASES:
                    yield from tallies.batches()
                    tallies.clear()
            release()
        if len(tallies):
            yield from tallies.batches()
        release()

    tasks = max(COUNTING_TASKS * context.defaultParallelism, -(-docs.rdd.getNumPartitions() // MOST_SPLITS))
    counted = docs.coalesce(tasks).mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    return counted.filter((F.col("f") >= LEAST_COUNT) | (F.col("phrase") == "")).select("lang", words.alias("words"), "f")


_STREAM = {"lang": pa.string(), "words": pa.list_(pa.string()), "f": pa.int64(), "longer": pa.int64(), "first": pa.list_(pa.int64()), "chain": pa.list_(pa.int64())}
_STREAM_DDL = "lang string, words array<string>, f long, longer long, first array<long>, chain array<long>"


def in_step(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Merge a sorted stream of (lang, words, f, longer, first) with its own beginnings.

    Adds the counts of all proper beginnings, the empty one first, and raises `longer`
    to the largest count of a phrase one word longer. Equal phrases become one.
    """
    stack: list[list] = []

    def close() -> tuple:
        lang, words, f, longer, first = stack.pop()
        if stack:
            stack[-1][3] = max(stack[-1][3], f)
        return lang, words, f, longer, first, [entry[2] for entry in stack]

    for lang, words, f, longer, first in rows:
        while stack and (stack[-1][0] != lang or stack[-1][1] != words[: len(stack[-1][1])]):
            yield close()
        if stack and stack[-1][1] == words:
            stack[-1][3] = max(stack[-1][3], longer)
            continue
        stack.append([lang, words, f, longer, first])
    while stack:
        yield close()


def scan(rows: DataFrame, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, ddl: str | None = None) -> DataFrame:
    """Send a stream (`lang`, `words`, `f`, `longer`, `first`) through `in_step`, range by range; adds `chain`.

    A phrase that reaches into several ranges has a row from each, alike but for `longer`.
    `then` makes rows of `ddl` from these in the same worker; a second Python step would take
    a second worker for each core, which stays and holds memory.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * parts / max(rows.count(), 1))
    chosen = rows.filter(F.pmod(F.xxhash64("lang", "words"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # About SAMPLED phrases for each range come to the driver.
    sample = sorted((row.lang, row.words) for row in chosen.select("lang", "words").toLocalIterator())
    shared = spark.sparkContext.broadcast([sample[len(sample) * i // parts] for i in range(1, parts)] if sample else [])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value
        for batch in batches:
            places, repeats = [], []
            for row, (lang, words) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist())):
                number = bisect_right(borders, (lang, words))
                places.append(number)
                repeats.append(row)
                # Later ranges that begin inside this phrase.
                while number < len(borders) and borders[number][0] == lang and borders[number][1][: len(words)] == words:
                    number += 1
                    places.append(number)
                    repeats.append(row)
            whole = batch.take(pa.array(repeats, pa.int64()))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(places, pa.int32())], [*whole.schema.names, "range"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(_STREAM)[:-1]
        stream = (row for batch in batches for row in zip(*(batch.column(name).to_pylist() for name in names)))
        held = []
        for row in in_step(stream):
            held.append(row)
            if len(held) == 10_000:
                yield then(_batch(held)) if then else _batch(held)
                held = []
        if held:
            yield then(_batch(held)) if then else _batch(held)

    narrow = rows.select("lang", "words", "f", "longer", "first")
    routed = narrow.mapInArrow(route, _STREAM_DDL.replace(", chain array<long>", ", range int"))
    placed = routed.repartitionById(parts, F.col("range")).sortWithinPartitions("lang", "words")
    return placed.mapInArrow(merge, ddl or _STREAM_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _STREAM.values())], list(_STREAM))


_SCORED_DDL = "lang string, words array<string>, a long, l long, r long, n long, score long, longer long"


def _scored(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Score each phrase of two words or more by its lowest cut, in whole numbers of any size."""
    out = []
    for lang, words, a, longer, left, right in zip(*(batch.column(name).to_pylist() for name in ("lang", "words", "f", "longer", "first", "chain"))):
        size = len(words)
        if size < 2:
            continue
        # left[k] counts the first k words, right[k] the last k.
        n = left[0]
        score, cut = min((SCALE * a * n // (left[k] * right[size - k]), k) for k in range(1, size))
        out.append((lang, words[::-1], a, left[cut], right[size - cut], n, score, longer))
    kinds = [pa.string(), pa.list_(pa.string()), *[pa.int64()] * 6]
    columns = list(zip(*out)) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], ["lang", "words", "a", "l", "r", "n", "score", "longer"])


def candidates(docs: DataFrame) -> DataFrame:
    """All phrases of two to MOST_WORDS words with LEAST_COUNT occurrences, with `lang`, `words`, `a`, `l`, `r`, `n`, `score` and `longer`.

    `longer` is the largest count of a frequent phrase one word longer that holds it, 0 if there is none.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    fields: list[np.ndarray] = []
    for order in range(1, MOST_WORDS + 1):
        fields.append(_field(texts, order, fields[-1] if fields else None))
    grams = stage(counts(texts, fields), "grams")
    opened = grams.select("lang", "words", "f", F.lit(0).cast("long").alias("longer"), F.lit(None).cast("array<long>").alias("first"))
    by_prefix = stage(scan(opened).select("lang", F.reverse("words").alias("words"), "f", "longer", F.col("chain").alias("first")), "prefixes")
    by_suffix = scan(by_prefix, _scored, _SCORED_DDL)
    same = [F.max(name).alias(name) for name in ("a", "l", "r", "n", "score", "longer")]
    return by_suffix.groupBy("lang", "words").agg(*same)


def collocations(docs: DataFrame) -> DataFrame:
    """The first TOP phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Order: score and count descending, then the phrase by its bytes. A phrase inside a
    longer one that is as frequent is left out. A null lang counts as NO_LANGUAGE, null
    and empty texts have no words, repeated rows count as often as they are there, and
    other columns are not read. An empty table gives none.
    """
    ready(docs.sparkSession)
    found = candidates(docs).filter(100 * F.col("longer") < HELD_PERCENT * F.col("a"))
    rows = found.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # A language's first rows are among the first of its parts.
    early = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= TOP).drop("part", "place")
    ranked = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
