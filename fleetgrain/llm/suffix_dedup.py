"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every string of `LENGTH` bytes is routed by the least hash among its grams of `GRAM`
bytes, so equal strings always meet. Neighbouring strings with one route form a stretch;
stretches are all that is shuffled, one row for about 35 bytes of text.

1. Routes that one stretch alone takes are dropped after a count that combines per task,
   unless the route's gram occurs twice in it, as in periodic text.
2. Of equal stretches, all but the earliest are removed whole; hashes decide that, by
   aggregation and a join that AQE can split.
3. Different stretches of one route, and those of periodic text, are compared: their bytes are gathered in blocks of
   bounded size, the block's suffixes are sorted and transformed, and breadth-first
   backward extension gives the common prefixes of neighbours by increasing value: an
   interval of suffixes that start with w is extended by the characters before it, and a
   boundary that is reached for the first time with len(w) has that common prefix. The
   expansion stops at `LENGTH`; boundaries not reached by then join equal strings.
   All but the earliest string of such a class are removed.
4. A route with more different stretches than a block holds is dealt to several blocks;
   the earliest strings of their classes are then compared by aggregation.

Removed spans are merged per document. Texts are joined with their spans by document, so
a task holds one document at a time.

Defined cases: null text is empty; texts below `LENGTH` bytes are kept whole; overlaps
with the text itself count; of equal strings the one of the smallest doc_id and start
stays; ids are unique (rows that repeat an id with its text are treated alike); rows with null
ids are texts of their own and come first; ids lie above those rows' numbers, which count
up from the least bigint; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package, small_side, stored
from fleetgrain.llm.ngram_join import mix

LENGTH = 100
GRAM = 32
#: Different stretches of one route in a block, and bytes that a block gathers.
BLOCK_STRETCHES = 20_000
BLOCK_BYTES = 1 << 20
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(size, np.uint64(_BASE), dtype=np.uint64)
    down = np.full(size, np.uint64(inverse), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(_MASK), dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of the documents that lie in `data` between `bounds`.

    Returns document, first start in it, number of strings, route, content hash and
    whether the route's gram occurs again in the stretch, so that the stretch may hold
    one string twice.
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(data) < LENGTH:
        return none
    up, down = _powers(1 << (len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    routes = _window_minima(grams, LENGTH - GRAM + 1)
    counts = np.maximum(np.diff(bounds) - (LENGTH - 1), 0)
    total = int(counts.sum())
    if not total:
        return none
    docs = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    inside = np.arange(total) - begins[docs]
    at = bounds[:-1][docs] + inside
    route = routes[at]
    new = np.ones(total, dtype=bool)
    new[1:] = (route[1:] != route[:-1]) | (inside[1:] == 0)
    # long runs of one route, as in repetitive text, are cut to the usual size
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, total))
    most = LENGTH - GRAM + 1
    if (lengths > most).any():
        run = np.repeat(first, lengths)
        new |= (np.arange(total) - run) % most == 0
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, total))
    a = at[first]
    content = mix((sums[a + lengths + LENGTH - 1] - sums[a]) * down[a] + lengths.astype(np.uint64))
    value, seen = route[first], np.zeros(len(first), dtype=np.int64)
    for k in range(2 * most - 1):
        here = np.minimum(a + k, len(grams) - 1)
        seen += (grams[here] == value) & (k < lengths + most - 1)
    return docs[first], inside[first], lengths, value, content, seen > 1


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Suffixes of a sequence in order; its unique codes end every comparison.

    Doubling, in which only suffixes that still have equals are sorted again. Also gives
    the first codes of each suffix in that order, packed to one number, how many
    and the bits of each.
    """
    n = len(codes)
    bits = int(codes.max() + 1).bit_length()
    step = max(1, min(62 // bits, n))
    packed = np.zeros(n, dtype=np.int64)
    for k in range(step):
        packed <<= bits
        packed[: n - k] += codes[k:] + 1
    width = step
    order = np.argsort(packed)
    packed = packed[order]
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    active, key = order, packed
    while True:
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(key)))
        rank[active] = np.repeat(slots[heads], sizes)
        again = np.repeat(sizes > 1, sizes)
        if not again.any():
            return order, packed, width, bits
        active, slots = active[again], slots[again]
        further = np.where(active + step < n, rank[np.minimum(active + step, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + further
        by = np.argsort(key)
        active, key = active[by], key[by]
        order[slots] = active
        step *= 2


def equal_strings(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal substrings of `length` bytes: class, text and start of each member.

    Only classes of two or more.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    # codes: text ends are unique and least, in the order of the texts
    codes = np.empty(n, dtype=np.int64)
    body = np.ones(n, dtype=bool)
    body[ends] = False
    codes[ends] = np.arange(len(texts))
    codes[body] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + len(texts)
    order, packed, width, bits = suffix_order(codes)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    head = codes[order]
    extends = (order > 0) & body[order - 1]  # the character before is no text end
    step_back = rank[order - 1]  # where the suffix one longer stands

    # the sorting key already shows the prefixes below its width; expansion starts there
    packed >>= bits * max(0, width - length)
    width = min(width, length)
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = reached[n] = True
    lows = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    highs = np.append(lows[1:], n)
    reached[highs] = True
    # boundaries with shorter common prefixes were reached before this width
    less = packed >> bits
    newly = np.append(less, -1)[highs] == less[highs - 1]
    lows, highs = lows[newly], highs[newly]
    for _ in range(width, length):
        if not len(lows):
            break
        sizes_ = highs - lows
        total = int(sizes_.sum())
        place = np.arange(total) + np.repeat(lows - (np.cumsum(sizes_) - sizes_), sizes_)
        owner = np.repeat(np.arange(len(lows)), sizes_)
        valid = extends[place]
        target, owner = step_back[place[valid]], owner[valid]
        if not len(target):
            break
        by = np.argsort(target)
        target, owner = target[by], owner[by]
        split = np.ones(len(target), dtype=bool)
        split[1:] = (target[1:] != target[:-1] + 1) | (owner[1:] != owner[:-1]) | (head[target[1:]] != head[target[:-1]])
        first = np.flatnonzero(split)
        low, high = target[first], target[np.append(first[1:], len(target)) - 1] + 1
        news = ~reached[high]
        lows, highs = low[news], high[news]
        reached[highs] = True
    number = np.cumsum(reached[:n]) - 1
    shared = np.bincount(number)[number] > 1
    where = order[shared]
    text = np.searchsorted(ends, where)
    return number[shared], text, where - (ends[text] - sizes[text])


#: A stretch's place packs its start, whether its route occurs again in it, and its number of strings.
_COUNT_BITS, _PLACE_BITS = 7, 8


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as bytes, about CHUNK_BYTES at a time: data, bounds, row and offset of each piece.

    A long text is several pieces that overlap by one string less a byte.
    """
    held: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0

    def out():
        bounds = np.concatenate(([0], np.cumsum([len(h) for h in held], dtype=np.int64)))
        return np.frombuffer(b"".join(held), dtype=np.uint8), bounds, np.array(rows, dtype=np.int64), np.array(offsets, dtype=np.int64)

    for row, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK_BYTES):
            piece = data[at : at + CHUNK_BYTES + LENGTH - 1]
            held.append(piece)
            rows.append(row)
            offsets.append(at)
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield out()
                held, rows, offsets, size = [], [], [], 0
    if held:
        yield out()


def _found(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start, number of strings, route and content of the stretches of many texts, and the pieces."""
    for data, bounds, rows, offsets in _pieces(texts):
        piece, start, count, route, content, again = stretches(data, bounds)
        yield rows[piece], start + offsets[piece], count, route, content, again, data, bounds[piece] + start


def routed(slim: DataFrame) -> DataFrame:
    """(doc_id, place, route, content) of every stretch; place packs start and number of strings."""
    shape = pa.schema([(c, pa.int64()) for c in ("doc_id", "place", "route", "content")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, start, count, route, content, again, _, _ in _found(batch.column(1)):
                place = (start << _PLACE_BITS) | (again.astype(np.int64) << _COUNT_BITS) | count
                yield pa.record_batch([ids.take(pa.array(row)), pa.array(place), pa.array(route.view(np.int64)), pa.array(content.view(np.int64))], schema=shape)

    return slim.mapInArrow(run, "doc_id bigint, place bigint, route bigint, content bigint")


def _start(place):
    return F.shiftright(place, _PLACE_BITS)


def _again(place):
    return F.shiftright(place, _COUNT_BITS).bitwiseAND(1) == 1


def _end(place):
    return _start(place) + place.bitwiseAND((1 << _COUNT_BITS) - 1) + (LENGTH - 1)


def _gather(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(route, doc_id, start, body): bytes of the stretches whose starts a document's row lists."""
    shape = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = batch.column(0), batch.column(2)
            lists = [np.asarray(s.as_py(), dtype=np.int64) for s in starts]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            # one number for row and start, to look all stretches up at once
            asked = np.sort((owner.astype(np.int64) << 40) | np.concatenate(lists)) if lists else np.zeros(0, np.int64)
            for row, start, count, route, _, _, data, at in _found(batch.column(1)):
                mark = (row << 40) | start
                spot = np.searchsorted(asked, mark)
                keep = np.flatnonzero((spot < len(asked)) & (asked[np.minimum(spot, len(asked) - 1)] == mark)) if len(asked) else []
                body = [data[a : a + n + LENGTH - 1].tobytes() for a, n in zip(at[keep].tolist(), count[keep].tolist(), strict=True)]
                yield pa.record_batch([pa.array(route[keep].view(np.int64)), ids.take(pa.array(row[keep])), pa.array(start[keep]), pa.array(body, pa.binary())], schema=shape)

    return slim.join(wanted, "doc_id").select("doc_id", "text", "starts").mapInArrow(run, "route bigint, doc_id bigint, start bigint, body binary")


def block_repeats(docs: np.ndarray, starts: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of a block that are not the earliest of their class: text number, first and end byte of runs."""
    number, text, inside = equal_strings(bodies)
    doc, start = docs[text], starts[text] + inside
    by = np.lexsort((start, doc, number))
    later = np.concatenate(([False], number[by][1:] == number[by][:-1])) if len(by) else np.zeros(0, bool)
    text, inside = text[by][later], inside[by][later]
    by = np.lexsort((inside, text))
    text, inside = text[by], inside[by]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(text)) - 1 if len(first) else first
    return text[first], inside[first], inside[last] + LENGTH


def _compare(gathered: DataFrame) -> DataFrame:
    """Repeats inside each (route, part): spans to remove, and for split routes the strings that stay.

    Rows: doc_id, begin, end and, for the strings that stay, two halves of their hash.
    """
    import xxhash

    shape = pa.schema([(c, pa.int64()) for c in ("doc_id", "begin", "end", "h1", "h2")])

    def work(block: list[tuple]) -> pa.RecordBatch:
        docs = np.array([b[0] for b in block], dtype=np.int64)
        starts = np.array([b[1] for b in block], dtype=np.int64)
        bodies = [b[2] for b in block]
        text, begin, end = block_repeats(docs, starts, bodies)
        out = [list((starts[text] + begin).tolist()), list((starts[text] + end).tolist())]
        ids, h1, h2 = docs[text].tolist(), [None] * len(text), [None] * len(text)
        if any(b[3] for b in block):
            gone: dict[int, set] = {}
            for t, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
                gone.setdefault(t, set()).update(range(a, b - LENGTH + 1))
            for t, (doc, start, body, split) in enumerate(block):
                for s in range(len(body) - LENGTH + 1) if split else ():
                    if s not in gone.get(t, ()):
                        h = xxhash.xxh3_128_intdigest(body[s : s + LENGTH])
                        ids.append(doc)
                        out[0].append(start + s)
                        out[1].append(start + s + LENGTH)
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & _MASK) - (1 << 63))
        return pa.record_batch([pa.array(c, pa.int64()) for c in (ids, *out, h1, h2)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        key, size = None, 0
        for batch in batches:
            for route, part, split, doc, start, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (route, part) != key:
                    # whole groups leave once they fill a block; one group is never cut
                    if size >= BLOCK_BYTES:
                        yield work(block)
                        block, size = [], 0
                    key = (route, part)
                block.append((doc, start, body, split))
                size += len(body)
        if block:
            yield work(block)

    return gathered.select("route", "part", "split", "doc_id", "start", "body").mapInArrow(run, "doc_id bigint, begin bigint, end bigint, h1 bigint, h2 bigint")


def removed_spans(slim: DataFrame) -> DataFrame:
    """(doc_id, spans): the maximal runs of bytes to remove of each document that has any, stored."""
    rows = routed(slim)
    shared = stored(rows.groupBy("route").agg(F.count("*").alias("n"), F.max(_again(F.col("place"))).alias("again")).where("n > 1 OR again").select("route"), "routes")
    met = stored(rows.join(shared, "route"), "stretches")
    earliest = F.min(F.struct("doc_id", "place"))
    groups = stored(met.groupBy("route", "content").agg(earliest.alias("first"), F.count("*").alias("n")), "stretch-groups")
    repeated = stored(groups.where("n > 1").select("route", "content", "first"), "stretch-repeats")
    copies = met.join(repeated, ["route", "content"]).where(F.struct("doc_id", "place") != F.col("first"))
    whole = copies.select("doc_id", _start(F.col("place")).alias("begin"), _end(F.col("place")).alias("end"))

    in_groups = groups.groupBy("route").agg(F.count("*").alias("n"), F.max(_again(F.col("first.place"))).alias("again"))
    several = stored(in_groups.where("n > 1 OR again").select("route", "n"), "routes-several")
    different = groups.join(several.select("route"), "route").select("first.doc_id", _start(F.col("first.place")).alias("start"))
    wanted = stored(different.groupBy("doc_id").agg(F.collect_list(F.col("start").cast("int")).alias("starts")), "stretch-starts")
    parts = stored(
        several.where(F.col("n") > BLOCK_STRETCHES).select("route", F.ceil(F.col("n") / BLOCK_STRETCHES).cast("int").alias("parts")), "routes-split"
    )
    bytes_ = wanted.agg(F.sum(F.size("starts") * 4 + 40).alias("b")).first()["b"] or 0
    gathered = _gather(slim, small_side(wanted, max(1, bytes_ // max(1, wanted.count()))))
    gathered = gathered.join(small_side(parts, 32), "route", "left").select(
        "route", F.coalesce(F.pmod(F.xxhash64("doc_id", "start"), "parts"), F.lit(0)).alias("part"), F.col("parts").isNotNull().alias("split"), "doc_id", "start", "body"
    )
    dealt = gathered.repartition("route", "part").sortWithinPartitions("route", "part")
    compared = stored(_compare(dealt), "stretch-compared")
    within = compared.where("h1 IS NULL").select("doc_id", "begin", "end")
    stay = compared.where("h1 IS NOT NULL")
    best = stored(
        stay.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"), "string-firsts"
    )
    across = stay.join(best, ["h1", "h2"]).where(F.struct("doc_id", "begin") != F.col("first")).select("doc_id", "begin", "end")
    spans = whole.unionByName(within).unionByName(across)
    # one running union per task before the rows meet
    merged = spans.groupBy("doc_id").agg(_union(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    return stored(merged, "spans")


def _union(spans):
    """Sorted disjoint runs; runs that touch are one."""
    start = F.struct(
        F.lit(None).cast("bigint").alias("begin"), F.lit(None).cast("bigint").alias("end"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("done")
    )

    def step(acc, s):
        joins = s["begin"] <= acc["end"]
        closed = F.when(acc["begin"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end"))))
        )
        return F.struct(
            F.when(joins, acc["begin"]).otherwise(s["begin"]).alias("begin"),
            F.when(joins, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
            F.when(joins, acc["done"]).otherwise(closed).alias("done"),
        )

    return F.aggregate(
        F.array_sort(spans), start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end"))))
    )


def cut(data: bytes, spans) -> bytes:
    """`data` without the spans, which are sorted and disjoint."""
    out, at = [], 0
    for begin, end in spans:
        out.append(data[at:begin])
        at = end
    out.append(data[at:])
    return b"".join(out)


def _numbered(slim: DataFrame) -> DataFrame:
    """doc_id, text, own_id: rows without id, which are stored for it, get numbers below all ids."""
    least = F.lit(-(1 << 63)).cast("bigint")
    number = least + F.monotonically_increasing_id()
    nameless = stored(slim.where("doc_id IS NULL").select(number.alias("doc_id"), "text", F.col("doc_id").alias("own_id")), "nameless")
    return slim.where("doc_id IS NOT NULL").select("doc_id", "text", F.col("doc_id").alias("own_id")).unionByName(nameless)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; `with_kept` adds the bytes that stay."""
    ship_package(docs.sparkSession)
    slim = _numbered(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    spans = removed_spans(slim.select("doc_id", "text"))
    size = spans.agg(F.sum(F.size("spans") * 32 + 40).alias("b")).first()["b"] or 0
    shape = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        + ([("kept", pa.binary())] if with_kept else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in shape]
            for doc, text, runs in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                held = [(r["begin"], min(r["end"], len(data))) for r in runs.as_py() or ()]
                kept = cut(data, held)
                row = (doc.as_py(), len(data), len(data) - len(kept), len(held), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(columns, row, strict=False):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    joined = slim.join(small_side(spans, max(1, size // max(1, spans.count()))), "doc_id", "left").select(F.col("own_id").alias("doc_id"), "text", "spans")
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else "")
    return joined.mapInArrow(run, ddl)
