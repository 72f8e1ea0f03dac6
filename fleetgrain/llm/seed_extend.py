"""Removal of repeated word strings: seeds shared by documents are extended both ways.

A window is `WINDOW` consecutive words. Its seed is the gram of `SEED` words with the least
hash in it, the first one if it stands there twice; so equal windows share seed and place
of the seed, and every window has one (winnowing). Neighbouring windows with one seed form
an occurrence of it: the seed with at most eight words on either side. Occurrences are all
that is shuffled, one for about five words.

1. Seeds that only one document has are dropped after an aggregation that combines per task.
2. Occurrences with equal surroundings are one: they match the earliest document's as far
   as windows reach, so all later ones are covered whole. Aggregation and a join that AQE
   can split decide that, so a passage in a third of all documents is a row per task.
3. Different occurrences of one seed are extended together, a word at a time to the left and
   to the right; those that still agree stay in one class. A window is covered if a smaller
   document is in the class of its left and its right end. Groups stream through tasks in
   blocks of bounded size.
4. A seed with more than `BLOCK` different occurrences is not gathered: each occurrence is
   extended to its full windows at once, and these meet by aggregation.
5. Covered windows of a document that overlap or touch unite to its maximal repeats, none
   shorter than a window, and are cut from the whole text.

Lists of occurrences and of repeats grow with the corpus, so texts meet them in shuffled joins
at every size.

Defined cases: null text has no words; texts below `WINDOW` words are kept whole; repeats
inside one document only are kept; rows without id come after all ids, which are below
2 ** 62, in the order of a hash of their texts; rows that repeat an id never cut each other
and are told apart by 24 bits of their texts' hashes; equal rows get equal results; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package, small_side, stored
from fleetgrain.llm.ngram_join import mix

WINDOW = 13
SEED = 5
#: Words that a window has besides its seed, so the farthest that an occurrence reaches.
REACH = WINDOW - SEED
#: Different occurrences of one seed that are extended in one task, and rows of a block.
BLOCK = 2_000
BLOCK_ROWS = 20_000
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 2 << 20
#: Least number of a row without id.
NO_ID = 1 << 62

_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: A place packs the first word's index, windows, words left of the seed and 24 bits of the text's hash.
_AT, _COUNT, _LEFT, _HASH_BITS = 32, 28, 24, 24


def word_hashes(data: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word of `data`, which ends with a blank."""
    blank = _BLANK[data]
    before = np.concatenate(([True], blank[:-1]))
    begins, ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return begins, mix((sums[ends] - sums[begins]) * down[begins])


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    pair = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        line = np.full(size, np.uint64(base), dtype=np.uint64)
        line[0] = 1
        pair.append(np.multiply.accumulate(line))
    return pair[0], pair[1]


def occurrences(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seed occurrences in texts whose word hashes lie in `words` between `bounds`.

    Text, first word in it, windows, words left of the seed, seed and content hash of each.
    """
    counts = np.maximum(np.diff(bounds) - (WINDOW - 1), 0)
    total = int(counts.sum())
    if not total:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(total) - (np.cumsum(counts) - counts)[text]
    at = bounds[:-1][text] + inside
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    grams = mix((sums[SEED:] - sums[:-SEED]) * down[: len(words) - SEED + 1])
    least = grams[at].copy()
    for k in range(1, REACH + 1):
        np.minimum(least, grams[at + k], out=least)
    left = np.zeros(total, dtype=np.int64)
    for k in range(REACH, -1, -1):
        left[grams[at + k] == least] = k
    spot = at + left
    first = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (text[1:] != text[:-1]))))
    number = np.diff(np.append(first, total))
    a = at[first]
    shape = (number * 16 + left[first]).astype(np.uint64)
    content = mix((sums[a + number + WINDOW - 1] - sums[a]) * down[a] + mix(shape + np.uint64(1)))
    return text[first], inside[first], number, left[first], least[first], content


def pieces(data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text with the index of their first word; neighbours share a window less a word."""
    at = index = 0
    while len(data) - at > size:
        stop, tail = at + size, []
        while len(tail) < WINDOW:
            blank = _NEXT_BLANK.search(data, stop)
            stop = blank.start() if blank else len(data)
            tail = data[at:stop].rsplit(None, WINDOW - 1)
            if blank is None:
                break
            stop = stop if len(tail) >= WINDOW else min(len(data), stop + size)
        if stop >= len(data):
            break
        yield index, data[at:stop]
        index += len(tail[0].split())
        at += len(tail[0])
    yield index, data[at:]


def _chunks(texts: pa.Array) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """About CHUNK_BYTES of texts, each followed by a blank: bytes, ends, rows and first words."""
    held, ends, rows, firsts, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        for first, part in pieces(text.as_py() or b"", CHUNK_BYTES):
            held.append(part)
            size += len(part) + 1
            ends.append(size)
            rows.append(row)
            firsts.append(first)
            if size >= CHUNK_BYTES:
                yield b" ".join([*held, b""]), ends, rows, firsts
                held, ends, rows, firsts, size = [], [], [], [], 0
    if held:
        yield b" ".join([*held, b""]), ends, rows, firsts


def _first_seen(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> pa.RecordBatch:
    """Rows whose id and mark, the first two columns, no earlier row of the task has."""
    keep = []
    for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        if key not in seen:
            seen.add(key)
            keep.append(row)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def seeded(slim: DataFrame) -> DataFrame:
    """(seed, content, doc, place) of every occurrence."""
    shape = pa.schema([(c, pa.int64()) for c in ("seed", "content", "doc", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = powers(1 << 12)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = _first_seen(batch, seen)
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for joined, ends, rows, firsts in _chunks(batch.column(2)):
                data = np.frombuffer(joined, dtype=np.uint8)
                if len(up) < len(data) + 1:
                    up, down = powers(2 * len(data))
                begins, words = word_hashes(data, up, down)
                bounds = np.concatenate(([0], np.searchsorted(begins, ends)))
                text, start, number, left, seed, content = occurrences(words, bounds)
                row = np.array(rows, dtype=np.int64)[text]
                start += np.array(firsts, dtype=np.int64)[text]
                place = (start << _AT) | (number << _COUNT) | (left << _LEFT) | marks[row]
                yield pa.record_batch([pa.array(c) for c in (seed.view(np.int64), content.view(np.int64), docs[row], place)], schema=shape)

    return slim.mapInArrow(run, "seed bigint, content bigint, doc bigint, place bigint")


def _field(place: Column, shift: int, bits: int) -> Column:
    return F.shiftright(place, shift).bitwiseAND((1 << bits) - 1)


def _power(bits: Column | str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(bits) if isinstance(bits, str) else bits)


def _gather(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, content, doc, n, left, words): the words of the occurrences that a document's row lists."""
    shape = pa.schema([("seed", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("left", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch, rows = _first_seen(batch, seen), []
            for doc, text, asked in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                words, doc = text.as_py().split(), doc.as_py()
                for one in asked.as_py():
                    at, n, left = one["place"] >> _AT, (one["place"] >> _COUNT) & 15, (one["place"] >> _LEFT) & 15
                    rows.append((one["seed"], one["content"], doc, n, left, b" ".join(words[at : at + n + WINDOW - 1]).decode()))
                if len(rows) >= BLOCK_ROWS:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    joined = slim.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "asked")
    return joined.mapInArrow(run, "seed bigint, content bigint, doc bigint, n bigint, left bigint, words string")


def covered(group: np.ndarray, docs: np.ndarray, number: np.ndarray, left: np.ndarray, texts: list[list[str]]) -> np.ndarray:
    """For each occurrence a bit for each of its windows that a smaller document of its group has.

    Classes are refined by one word at a time, outward from the seed.
    """
    rows = len(texts)
    ids: dict[str, int] = {}
    span = REACH * 2 + SEED
    # column REACH is the seed's first word; 0 stands where an occurrence does not reach
    table = np.zeros((rows, span), dtype=np.int64)
    for i, words in enumerate(texts):
        begin = REACH - int(left[i])
        table[i, begin : begin + len(words)] = [ids.setdefault(w, len(ids) + 1) for w in words]

    def refine(classes: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.unique(classes * (len(ids) + 1) + column, return_inverse=True)[1]

    core = np.unique(group, return_inverse=True)[1]
    for k in range(SEED):
        core = refine(core, table[:, REACH + k])
    to_left, to_right = [core], [core]
    for k in range(REACH):
        to_left.append(refine(to_left[-1], table[:, REACH - 1 - k]))
        to_right.append(refine(to_right[-1], table[:, REACH + SEED + k]))
    bits = np.zeros(rows, dtype=np.int64)
    for k in range(REACH + 1):
        window = left - k  # index of the window with k words left of the seed
        has = np.flatnonzero((window >= 0) & (window < number))
        if len(has) < 2:
            continue
        key = to_left[k][has] * rows + to_right[REACH - k][has]
        by = np.lexsort((docs[has], key))
        key, who = key[by], has[by]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.repeat(docs[who][head], np.diff(np.append(head, len(key))))
        later = who[docs[who] > least]
        bits[later] |= np.int64(1) << window[later]
    return bits


def _extend(gathered: DataFrame) -> DataFrame:
    """(seed, content, mask) of the occurrences with covered windows; rows come sorted by seed."""
    shape = pa.schema([("seed", pa.int64()), ("content", pa.int64()), ("mask", pa.int64())])

    def work(block: list[tuple]) -> pa.RecordBatch:
        seed, content, docs, number, left = (np.array(c, dtype=np.int64) for c in list(zip(*block, strict=True))[:5])
        mask = covered(seed, docs, number, left, [row[5].split(" ") for row in block])
        hit = mask > 0
        return pa.record_batch([pa.array(c[hit]) for c in (seed, content, mask)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # whole groups leave once they fill a block
                if len(block) >= BLOCK_ROWS and row[0] != block[-1][0]:
                    yield work(block)
                    block = []
                block.append(row)
        if block:
            yield work(block)

    return gathered.select("seed", "content", "doc", "n", "left", "words").mapInArrow(run, "seed bigint, content bigint, mask bigint")


def _by_windows(gathered: DataFrame) -> DataFrame:
    """(seed, content, mask) as `_extend` gives it, by aggregation of full windows."""
    words = F.split("words", " ")
    one = gathered.select("seed", "content", "doc", words.alias("words"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    one = one.select("seed", "content", "doc", "k", F.md5(F.array_join(F.slice("words", F.col("k") + 1, WINDOW), " ")).alias("window"))
    one = stored(one, "full-windows")
    least = stored(one.groupBy("seed", "window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("seed", "window", "first"), "window-firsts")
    hit = one.join(least, ["seed", "window"]).where("doc > first")
    return hit.groupBy("seed", "content").agg(F.bit_or(_power("k")).alias("mask"))


def repeats(slim: DataFrame) -> DataFrame:
    """(doc, mark, spans): the maximal repeats of each document that has any, in word indices, stored."""
    rows = seeded(slim)
    ends = rows.groupBy("seed").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = stored(ends.where("low < high").select("seed"), "seeds-shared")
    met = stored(rows.join(shared, "seed"), "seed-occurrences")
    groups = stored(
        met.groupBy("seed", "content").agg(F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("last")).select("seed", "content", "first.doc", "first.place", "last"),
        "seed-contents",
    )
    several = stored(groups.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "seeds-several")
    place = F.col("place")
    asked = groups.join(several.select("seed"), "seed").select("doc", _field(place, 0, _HASH_BITS).alias("mark"), F.struct("seed", "content", "place").alias("one"))
    wanted = stored(asked.groupBy("doc", "mark").agg(F.collect_list("one").alias("asked")), "seeds-wanted")
    gathered = _gather(slim, wanted.hint("merge"))
    hot = several.where(F.col("n") > BLOCK).select("seed", F.lit(True).alias("hot"))
    gathered = stored(gathered.join(small_side(hot, 16), "seed", "left"), "seed-surroundings")
    dealt = gathered.where("hot IS NULL").repartition("seed").sortWithinPartitions("seed")
    found = _extend(dealt).unionByName(_by_windows(gathered.where("hot")))
    masks = stored(found.groupBy("seed", "content").agg(F.bit_or("mask").alias("mask")), "seed-masks")
    verdicts = stored(
        groups.join(masks, ["seed", "content"], "left").where("doc < last OR mask > 0").select("seed", "content", F.col("doc").alias("first"), F.coalesce("mask", F.lit(0)).alias("mask")),
        "seed-verdicts",
    )
    at, n = F.shiftright(place, _AT), _field(place, _COUNT, 4)
    whole = _power(n.cast("int")) - 1
    hit = met.join(verdicts, ["seed", "content"]).select("doc", _field(place, 0, _HASH_BITS).alias("mark"), at.alias("at"), F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("mask")).alias("mask"))
    hit = hit.where("mask > 0").withColumn("k", F.explode(_runs(F.col("mask"))))
    windows = hit.select("doc", "mark", (F.col("at") + F.col("k.low")).alias("begin"), (F.col("at") + F.col("k.high") + WINDOW).alias("end"))
    line = Window.partitionBy("doc", "mark").orderBy("begin")
    so_far = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    # equal rows of the table bring every window again; they fall into the same run
    runs = windows.withColumn("fresh", F.when(F.col("begin") <= so_far, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(line))
    merged = runs.groupBy("doc", "mark", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return stored(merged.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")), "repeats")


def _runs(mask: Column) -> Column:
    """Runs of set bits, first and last, of a mask of at most REACH + 1 bits."""
    bit = lambda k: F.expr(f"(mask >> ({k})) & 1")
    out = []
    for low in range(REACH + 1):
        starts = (bit(low) == 1) & (bit(low - 1) == 0 if low else F.lit(True))
        last = F.lit(REACH)
        for high in range(REACH, low, -1):
            last = F.when(bit(high) == 0, F.lit(high - 1)).otherwise(last)
        out.append(F.when(starts, F.struct(F.lit(low).alias("low"), last.alias("high"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of every row; `with_kept` adds the kept text."""
    ship_package(docs.sparkSession)
    own, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    number = F.coalesce(own, F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(NO_ID - 1))
    slim = docs.select(number.alias("doc"), F.xxhash64(text).bitwiseAND((1 << _HASH_BITS) - 1).alias("mark"), text.cast("binary").alias("text"), own.alias("own"))
    spans = repeats(slim.select("doc", "mark", "text"))
    shape = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        + ([("kept", pa.string())] if with_kept else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in shape]
            for doc, text, runs in zip(*(batch.column(k) for k in range(3)), strict=True):
                words, kept, at, n = text.as_py().split(), [], 0, 0
                for r in runs.as_py() or ():
                    kept += words[at : r["begin"]]
                    at, n = r["end"], n + 1
                kept += words[at:]
                rest = b" ".join(kept)
                row = (doc.as_py(), len(words), len(words) - len(kept), n, hashlib.sha256(rest).hexdigest(), rest.decode() if with_kept else None)
                for column, value in zip(columns, row, strict=False):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    joined = slim.join(spans.hint("merge"), ["doc", "mark"], "left").select("own", "text", "spans")
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if with_kept else "")
    return joined.mapInArrow(run, ddl)
