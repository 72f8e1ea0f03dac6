"""Spelling variants: words one edit apart, by dynamic programming over the sorted vocabulary.

The vocabulary is sorted; neighbours share prefixes, and the banded rows of the edit matrix
that a shared prefix gave are kept for all words that have it (the band is three cells wide,
as one edit allows no more). The scan goes level by level: a range of words with a common
prefix, a query that is still within one edit of it, and the row reached. Ranges come from
the common prefixes of neighbours, the next level computes one row for each distinct prefix,
and a range whose prefix is already more than one edit away from a query is skipped whole
for it. All ranges of a depth are worked together.

1. Words are counted per task, then over the corpus.
2. Words of length m and m + 1 form a group. A group of more than `BLOCK` words is split at
   the middle: pairs that agree in the first half meet under that half, all others agree in
   the last half and meet under it, and each pair in one of the two only. Splits repeat, on
   the part between the halves, until groups fit or two characters are left.
3. Groups stream through tasks in blocks, where the scan finds the pairs.
4. A word's form is its near word of largest count, if that is large enough; roots come from
   doubling the steps along the forms, a join a round.

Defined cases: null text has no words; a row without id changes runs as one whose id is
empty; repeated rows count again; ties between near words go to the least in the order of
code points; a word without form is its own root; forms have larger counts than their words,
so no cycle exists; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package, small_side, stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form's count is at least so many times the word's.
FORM_TIMES = 2
#: One in so many (document, run) hashes deletes a code point.
NOISE_ONE_IN = 97
#: Words of one group that are scanned in one task, and words of a block.
BLOCK = 4_000
BLOCK_WORDS = 8_000
#: States of the scan that are worked at once.
STATES = 1 << 20
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 200_000
PIECE_BYTES = 4 << 20

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_CUT = re.compile(rb"[^a-z\x80-\xff]")
_FREE = 1 << 30


def _runs(data: bytes) -> Iterator[Counter]:
    """Counts of the lower-case runs of a text, a piece at a time; pieces end between runs."""
    low, at = data.lower(), 0
    while at < len(low):
        cut = _CUT.search(low, at + PIECE_BYTES)
        stop = cut.start() if cut else len(low)
        yield Counter(_RUN.findall(low[at:stop].decode()))
        at = stop


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words, stored; runs that the hash picks lose a code point first."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shape = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{id_.as_py()}:".encode())
                for runs in _runs(text.as_py() or b""):
                    for word, n in runs.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % NOISE_ONE_IN == 0:
                            gone = h % len(word)
                            word = word[:gone] + word[gone + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    counted = slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= LEAST_COUNT), "vocabulary")


def near_pairs(words: list[str], groups: np.ndarray, shorter: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of words that are one edit apart, the earlier word first.

    Words are sorted in their groups; a group holds words of `shorter` and of one character
    more, and two of the longer ones are no pair. Pairs share fewer than `limits` first characters.
    """
    n = len(words)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    codes = np.append(codes, -1)

    def char(word: np.ndarray, place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < sizes[word])
        return np.where(inside, codes[np.where(inside, starts[word] + place, 0)], -1)

    shared = _common_prefixes(words, groups)
    heads = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    ends = np.append(heads[1:], n)
    query = np.arange(n)
    number = np.cumsum(np.concatenate(([True], groups[1:] != groups[:-1]))) - 1
    low, high = heads[number], ends[number]
    left, here, right = np.full(n, 2, np.uint8), np.zeros(n, np.uint8), np.ones(n, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # states that wait, by depth; the deepest go first, so that few wait at a time
    waiting = [(0, low, high, query, left, here, right)]
    starts_of: dict[int, np.ndarray] = {}
    while waiting:
        depth, low, high, query, left, here, right = waiting.pop()
        useful = (low < query) & ~((here == 0) & (limits[query] <= depth))
        low, high, query, left, here, right = (x[useful] for x in (low, high, query, left, here, right))
        # words that end here: the cell of the query's length is the distance
        over = sizes[low] == depth
        gap = sizes[query] - depth
        cell = np.where(gap == -1, left, np.where(gap == 0, here, right))
        both_long = (sizes[query] > shorter[query]) & (sizes[low] > shorter[low])
        hit = over & (np.abs(gap) <= 1) & (cell == 1) & ~both_long
        if hit.any():
            found.append((low[hit], query[hit]))
        if not len(low):
            continue
        if depth not in starts_of:
            starts_of[depth] = np.append(np.flatnonzero(shared <= depth), n)
        at = starts_of[depth]
        first, last = np.searchsorted(at, low), np.searchsorted(at, high)
        first = first + over  # the word that ends here has no next character
        children = last - first
        total = int(children.sum())
        if total > STATES and len(low) > 1:
            half = len(low) // 2
            parts = [tuple(x[s] for x in (low, high, query, left, here, right)) for s in (slice(0, half), slice(half, None))]
            waiting += [(depth, *p) for p in parts]
            continue
        state = np.repeat(np.arange(len(low)), children)
        child = np.arange(total) + np.repeat(first - (np.cumsum(children) - children), children)
        low, high, query = at[child], np.minimum(at[child + 1], high[state]), query[state]
        a, b, c = left[state], here[state], right[state]
        new = codes[starts[low] + depth]
        depth += 1
        here = np.minimum(b + (new != char(query, depth - 1)), c + 1)
        left = np.minimum(a + (new != char(query, depth - 2)), b + 1)
        here = np.minimum(here, left + 1)
        right = np.minimum(c + (new != char(query, depth)), here + 1)
        alive = np.minimum(np.minimum(left, here), right) <= 1
        if alive.any():
            waiting.append((depth, *(x[alive].astype(x.dtype) for x in (low, high, query)), *(np.minimum(x[alive], 2).astype(np.uint8) for x in (left, here, right))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _common_prefixes(words: list[str], groups: np.ndarray) -> np.ndarray:
    """Characters that a word shares with the one before it; -1 at the first of a group."""
    out = np.full(len(words), -1, dtype=np.int64)
    for i in range(1, len(words)):
        if groups[i] == groups[i - 1]:
            a, b = words[i - 1], words[i]
            most, k = min(len(a), len(b)), 0
            while k < most and a[k] == b[k]:
                k += 1
            out[i] = k
    return out


_GROUP = ["least", "head", "tail", "bound"]


def _split(rows: DataFrame) -> DataFrame:
    """The two halves under which pairs of a large group meet; see `_groups`."""
    middle, bound = F.col("middle"), F.col("bound")
    size = F.length(middle)
    h = F.floor((F.col("least") - F.length("head") - F.length("tail")) / 2).cast("int")
    ahead = rows.select(
        "least", F.concat("head", F.substring(middle, F.lit(1), h)).alias("head"), F.substring(middle, h + 1, size).alias("middle"),
        "tail", F.when(bound < _FREE, bound - h).otherwise(bound).alias("bound"),
    ).where("bound > 0")
    behind = rows.select(
        "least", "head", F.substring(middle, F.lit(1), size - h).alias("middle"),
        F.concat(F.substring(middle, size - h + 1, h), F.col("tail")).alias("tail"), F.least(bound, h).alias("bound"),
    )
    return ahead.unionByName(behind)


def _groups(vocabulary: DataFrame) -> DataFrame:
    """(least, head, middle, tail, bound): the words of each group, split until groups fit, stored.

    A word is head, middle and tail. Words of a group share head and tail, and their middles
    differ within the first `bound` characters.
    """
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= LEAST_LENGTH)).alias("least")
    rows = vocabulary.select(lengths, F.lit("").alias("head"), F.col("word").alias("middle"), F.lit("").alias("tail"), F.lit(_FREE).alias("bound"))
    done = None
    while True:
        rows = stored(rows, "word-groups")
        sizes = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"))
        between = F.col("least") - F.length("head") - F.length("tail")
        large = stored(sizes.where((F.col("n") > BLOCK) & (between >= 2)).select(*_GROUP, F.lit(True).alias("large")), "word-groups-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(small_side(large, 120), _GROUP, "left")
        rest = marked.where("large IS NULL").drop("large")
        done = rest if done is None else done.unionByName(rest)
        rows = _split(marked.where("large").drop("large"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near): all pairs of words that are one edit apart, each once, stored."""
    ship_package(vocabulary.sparkSession)
    shape = pa.schema([("word", pa.string()), ("near", pa.string())])

    def work(block: list[tuple]) -> pa.RecordBatch:
        numbers: dict[tuple, int] = {}
        keys = np.array([numbers.setdefault((r[0], r[1], r[3], r[4]), len(numbers)) for r in block], dtype=np.int64)
        shorter = np.array([r[0] - len(r[1]) - len(r[3]) for r in block], dtype=np.int64)
        one, other = near_pairs([r[2] for r in block], keys, shorter, np.array([r[4] for r in block], dtype=np.int64))
        whole = [r[1] + r[2] + r[3] for r in block]
        return pa.record_batch([pa.array([whole[i] for i in side.tolist()], pa.string()) for side in (one, other)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # whole groups leave once they fill a block
                if len(block) >= BLOCK_WORDS and (row[:2], row[3:]) != (block[-1][:2], block[-1][3:]):
                    yield work(block)
                    block = []
                block.append(row)
        if block:
            yield work(block)

    rows = _groups(vocabulary).select("least", "head", "middle", "tail", "bound")
    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "middle")
    return stored(dealt.mapInArrow(run, "word string, near string"), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of `forms` (word, form), stored: the last of its chain of forms."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # words that have no form end a chain
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def _best(near: Column, n: Column) -> Column:
    """Largest count first, then the least word."""
    return F.min(F.struct((-n).alias("n"), near.alias("word")))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, form, form_n, n_near, root of the words of a corpus."""
    vocabulary = word_counts(docs, id_col, text_col)
    pairs = near_words(vocabulary)
    count = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    met = both.join(count, "near").groupBy("word").agg(F.count("*").alias("n_near"), _best(F.col("near"), F.col("near_n")).alias("best"))
    large = -F.col("best.n") >= FORM_TIMES * F.col("n")
    judged = stored(
        vocabulary.join(met, "word", "left").select(
            "word", "n", F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")
        ),
        "judged-words",
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
