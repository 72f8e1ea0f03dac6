"""Hard-negative mining with full exact scores by the method of Four Russians.

Vectors have integer components. A candidate's components are cut into bit planes (two's
complement), and each plane of eight dimensions is packed into a byte. For an anchor, the
sums of all subsets of its eight components are tabulated for each group of eight dimensions,
so a byte looks up what its plane adds to the inner product; planes are joined by shift and
add, from the sign plane down. All anchors of a block are looked up by one byte at a time.

1. Equal rows are taken once; the packed candidates are written once, in chunks sorted by label.
2. Anchors are the stated query set. They go out in rounds of at most `ROUND_BYTES`, so what
   is sent to the executors does not grow with the table; each round meets all candidates.
3. Positives: scores of the same label, the best of each chunk, then the best of the anchor.
4. Negatives: scores of all other labels; for each positive, those between the two bounds,
   the best of each chunk, then the best of the pair.

Nothing is approximated and no candidate is left out; a chunk hands on a bounded number of rows
for each anchor, and the ranking drops the rest per task before it shuffles.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take
no part; equal rows count once; a row never meets rows of its own id; rows without id are no
anchors and stand after all ids among ties; components are clipped to +-2 ** 23, so that sums
of 2 ** 16 dimensions fit into a bigint; of vectors of different lengths the shorter one ends
in zeros; anchors without positives and positives without negatives give no rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package, stored

POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least so many hundredths of the positive.
LOW_PCT = 80
CLIP = 1 << 23
#: Candidates of a task, and those that are scored at once.
TASK_ROWS = 4096
CHUNK_ROWS = 1024
#: Anchors whose tables are in use at once, and bytes of anchors of a round.
BLOCK_ANCHORS = 128
ROUND_BYTES = 16 << 20
NO_ID = (1 << 63) - 1


def whole_vectors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double, clipped; null if one is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector, lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.floor(scale * x.cast("double")))).cast("int"))
    return F.when(finite, scaled)


def planes_of(vectors: np.ndarray) -> np.ndarray:
    """Bytes (plane, group of eight dimensions, row) of a matrix of integers; the last plane is the sign."""
    rows, width = vectors.shape
    groups = max(1, -(-width // 8))
    padded = np.zeros((rows, groups * 8), dtype=np.int64)
    padded[:, :width] = vectors
    bits = max(int(padded.max(initial=0)).bit_length(), int(~padded.min(initial=0)).bit_length()) + 1
    out = np.empty((bits, groups, rows), dtype=np.uint8)
    for b in range(bits):
        plane = ((padded >> b) & 1).astype(np.uint8).reshape(rows, groups, 8)
        out[b] = np.packbits(plane, axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors: np.ndarray, groups: int, kind: type) -> np.ndarray:
    """(group, byte, anchor): the sum of the components whose bits the byte has."""
    count, width = anchors.shape
    padded = np.zeros((count, groups * 8), dtype=kind)
    padded[:, : min(width, groups * 8)] = anchors[:, : groups * 8]
    table = np.zeros((groups, 256, count), dtype=kind)
    for g in range(groups):
        for j in range(8):
            table[g, 1 << j : 2 << j] = table[g, : 1 << j] + padded[:, 8 * g + j]
    return table


def scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner products (row, anchor) from a chunk's planes and the anchors' tables."""
    bits, groups, rows = planes.shape
    total = np.zeros((rows, table.shape[2]), dtype=table.dtype)
    looked = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(table[g], planes[b, g], axis=0, out=looked)
            if b == bits - 1:
                total -= looked
            else:
                total += looked
    return total


def _kind(planes: np.ndarray, anchors: np.ndarray) -> type:
    """32 bits if no sum can pass them."""
    largest = int(np.abs(anchors).sum(axis=1).max(initial=0))
    return np.int32 if largest << planes.shape[0] < 1 << 30 else np.int64


def _packed(rows: DataFrame) -> DataFrame:
    """Chunks of candidates: planes and groups, their bytes, ids and labels."""
    shape = pa.schema([("bits", pa.int32()), ("groups", pa.int32()), ("body", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary())])

    def chunk(held: list[tuple]) -> dict:
        held.sort(key=lambda r: (r[1], r[0]))
        width = max(len(r[2]) for r in held)
        vectors = np.zeros((len(held), width), dtype=np.int64)
        for i, r in enumerate(held):
            vectors[i, : len(r[2])] = r[2]
        planes = planes_of(vectors)
        ids, labels = (np.array([r[k] for r in held], dtype=np.int64).tobytes() for k in (0, 1))
        return {"bits": planes.shape[0], "groups": planes.shape[1], "body": planes.tobytes(), "ids": ids, "labels": labels}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= CHUNK_ROWS:
                    yield pa.RecordBatch.from_pylist([chunk(held)], schema=shape)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([chunk(held)], schema=shape)

    return rows.select("id", "label", "vector").mapInArrow(run, "bits int, groups int, body binary, ids binary, labels binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            planes = np.frombuffer(r["body"], dtype=np.uint8).reshape(r["bits"], r["groups"], -1)
            yield planes, np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["labels"], dtype=np.int64)


def _first(k: int, key: np.ndarray, score: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The first `k` rows of each key by score, then in the given order: key, score and the others."""
    by = np.lexsort((-score, key))
    key = key[by]
    head = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(head)
    place = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    kept = place < k
    by = by[kept]
    return [key[kept], score[by], *(x[by] for x in others)]


def _positives(packed: DataFrame, block, count: int) -> DataFrame:
    """(anchor, score, id): candidates of the anchor's label, the best `count` of a chunk."""
    shape = pa.schema([("anchor", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, vectors = block.value
        for planes, ids, labels in _chunks(batches):
            kind = _kind(planes, vectors)
            for label in np.unique(labels):
                rows = slice(*np.searchsorted(labels, [label, label + 1]))
                own = np.flatnonzero(anchor_labels == label)
                for at in range(0, len(own), BLOCK_ANCHORS):
                    who = own[at : at + BLOCK_ANCHORS]
                    score = scores(planes[:, :, rows], subset_sums(vectors[who], planes.shape[1], kind)).T.astype(np.int64)
                    other = anchor_ids[who][:, None] != ids[rows][None, :]
                    a, c = np.nonzero(other)
                    key, value, place = _first(count, a, score[a, c], c)
                    yield pa.record_batch([pa.array(who[key].astype(np.int32)), pa.array(value), pa.array(ids[rows][place])], schema=shape)

    return packed.mapInArrow(run, "anchor int, score bigint, id bigint")


def _negatives(packed: DataFrame, block, bounds, count: int, low_pct: int) -> DataFrame:
    """(anchor, place, score, id): candidates of other labels in the bounds of a positive, the best `count` of a chunk."""
    shape = pa.schema([("anchor", pa.int32()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
    least = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, vectors = block.value
        highs = bounds.value
        lows = -(-highs * low_pct // 100)
        valid = lows <= highs
        for planes, ids, labels in _chunks(batches):
            kind = _kind(planes, vectors)
            for at in range(0, len(vectors), BLOCK_ANCHORS):
                who = np.arange(at, min(at + BLOCK_ANCHORS, len(vectors)))
                who = who[valid[who].any(axis=1)]
                if not len(who):
                    continue
                score = scores(planes, subset_sums(vectors[who], planes.shape[1], kind)).T
                low = np.where(valid[who], lows[who], least).min(axis=1)
                high = np.where(valid[who], highs[who], -least).max(axis=1)
                near = (score >= low[:, None]) & (score <= high[:, None])
                near &= (labels[None, :] != anchor_labels[who][:, None]) & (ids[None, :] != anchor_ids[who][:, None])
                a, c = np.nonzero(near)
                value = score[a, c].astype(np.int64)
                # equal scores go by id, not by label
                by = np.argsort(ids[c], kind="stable")
                a, c, value = a[by], c[by], value[by]
                for place in range(highs.shape[1]):
                    fits = valid[who[a], place] & (value >= lows[who[a], place]) & (value <= highs[who[a], place])
                    key, best, spot = _first(count, a[fits], value[fits], c[fits])
                    n = len(key)
                    if n:
                        columns = (who[key].astype(np.int32), np.full(n, place, np.int32), best, ids[spot])
                        yield pa.record_batch([pa.array(x) for x in columns], schema=shape)

    return packed.mapInArrow(run, "anchor int, place int, score bigint, id bigint")


def _ranked(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= count)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and vector (integers, see `whole_vectors`); `anchors` is a
    condition on them.
    """
    spark = rows.sparkSession
    ship_package(spark)
    part = rows.where("label IS NOT NULL AND vector IS NOT NULL")
    slim = part.select(
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("label").cast("bigint").alias("label"), "vector",
        (F.coalesce(anchors, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"),
    )
    slim = stored(slim.dropDuplicates(["id", "label", "vector", "anchor"]), "vectors")
    total = slim.agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    packed = stored(_packed(slim.repartition(max(1, -(-total["n"] // TASK_ROWS)), "id", "vector")), "vectors-packed")
    rounds = max(1, -(-total["anchors"] * (total["width"] * 8 + 32) // ROUND_BYTES))
    out = []
    for k in range(rounds):
        mine_ = slim.where("anchor").where(F.pmod(F.xxhash64("id", "vector"), F.lit(rounds)) == k).select("id", "label", "vector")
        held = mine_.orderBy("id", "label", "vector").collect()
        vectors = np.zeros((len(held), total["width"]), dtype=np.int64)
        for i, r in enumerate(held):
            vectors[i, : len(r["vector"])] = r["vector"]
        block = spark.sparkContext.broadcast((np.array([r["id"] for r in held], dtype=np.int64), np.array([r["label"] for r in held], dtype=np.int64), vectors))
        best = stored(_ranked(_positives(packed, block, positives), ["anchor"], positives), "positives")
        # no score stands at these bounds
        highs = np.full((len(held), positives), -1, dtype=np.int64)
        for r in best.collect():
            highs[r["anchor"], r["rank"] - 1] = r["score"]
        bounds = spark.sparkContext.broadcast(highs)
        worst = _ranked(_negatives(packed, block, bounds, negatives, low_pct), ["anchor", "place"], negatives)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(held)], "anchor int, anchor_id bigint")
        pairs = best.join(names, "anchor").select("anchor", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = worst.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "place"])
        shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        out.append(stored(found.select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score"), "hard-negatives"))
        block.unpersist()
        bounds.unpersist()
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
