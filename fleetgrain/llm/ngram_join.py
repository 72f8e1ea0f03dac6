"""Jaccard join of word shingle sets by vertical partitioning of the n-gram order.

The global order of the n-grams is that of their hashes, and it is cut into fragments. A
`Rule` tells the words of an n-gram and the least similarity. At 85 %, two sets that link
differ in at most 3/17 of the smaller one (0.15 / 0.85), so with a third more fragments
than that, about a quarter are equal in both. Fragments become
signatures of the n-grams in them; only signatures that two different sets share leave
the counting pass. A set with fewer of them than a link needs is out, and pairs come from
the rarest ones alone, so many that two sets which share enough share one of those. How many fragments there are depends
on a size class; a set takes part in its own class and in those of possible smaller
partners. The few sets that leave most fragments empty, so that the equal fragment could
be an empty one, also give their prefix in the global order, which links must share.

The overlap of a candidate pair is counted exactly: for each fragment of the verification
a (pair, fragment) row holds the overlap there, and the rows are summed for the pair.

Candidates need no pairs of all members of a group. First every member of a group that
shares a signature meets one pivot. Groups that still hold several components are merged
by pivot and compared with a base, the n-grams that more than half of their members hold.
A member is then its difference to the base, and two members that link either have
differences so small that both link to the member nearest to the base, which is known
without a comparison, or their differences share n-grams, at least so many as their sizes
tell. So pairs come from the rarest n-grams of the differences only, never from what the
copies have in common, and members whose n-grams of their own exceed half of what a link
may spoil do not meet one another. A group of n near copies costs about n rows, and every
pair that could join two components is compared.

Sets are nodes, named by a hash, so equal sets are one node from the start and ids play no
part until the end. Signatures, counts and minima combine on the map side, joins at hot
keys are split by AQE.

Defined cases: null or empty text, or one without words, has an empty set and its own
component; a text of fewer than `n` words has its whole sequence as one n-gram; repeated
rows are one node, equal ids with different texts are several; rows with null ids link like
all others and take the least id that links reach, or null if there is none; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetgrain.llm.common import ship_package, small_side, stored

WORDS = 4
LEAST_PCT = 85
#: Size classes grow by this ratio.
RATIO = 1.5
#: One fragment more for so many that may differ. Links then share several signatures.
SPARE = 3
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 2 << 20
#: Bits of an n-gram that tell the fragment in which the overlap of a pair is counted.
PART_BITS = 3


@dataclass(frozen=True)
class Rule:
    """N-grams of so many words; sets link if 100 * intersection >= percent * union."""

    words: int = WORDS
    percent: int = LEAST_PCT

    def __post_init__(self):
        if self.words < 1 or not 1 <= self.percent <= 100:
            raise ValueError(f"no rule for a join: {self}")

    @property
    def whole(self) -> int:
        """Sets a and b link if whole * |a ^ b| <= alike * (|a| + |b|)."""
        return 100 + self.percent

    @property
    def alike(self) -> int:
        return 100 - self.percent

    def most_different(self, smaller: int) -> int:
        """N-grams in which a linked pair can differ, by the size of its smaller set."""
        return self.alike * smaller // self.percent

    def least_partner(self, n: int) -> int:
        """Size of the smallest set that a set of n n-grams can link with."""
        return -(-self.percent * n // 100)


RULE = Rule()

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all other bytes as they are; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    raw = np.frombuffer(data, dtype=np.uint8)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(low.tobytes())], offset=texts.offset)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, a slice of the texts at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for k, length in enumerate(sizes.tolist()):
        size += length
        if size >= SLICE_BYTES:
            yield from _slice_sets(texts.slice(begin, k + 1 - begin), n)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield from _slice_sets(texts.slice(begin), n)


def _slice_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    lists = pc.ascii_split_whitespace(lower_ascii(texts))
    # splitting keeps an empty word at a blank end
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    real = np.array([bool(w) for w in words], dtype=bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    flat, solid = (hashed[codes], real[codes]) if len(codes) else (np.zeros(0, np.uint64), np.zeros(0, bool))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        w = flat[a:b][solid[a:b]]
        if not len(w):
            yield w
            continue
        size = min(n, len(w))
        gram = np.full(len(w) - size + 1, np.uint64(size), dtype=np.uint64)
        for k in range(size):
            gram = mix(gram * _STEP + w[k : len(w) - size + 1 + k])
        yield np.unique(gram)


def size_class(n: int, rule: Rule = RULE) -> tuple[int, int]:
    """Number of the class that holds sets of n n-grams, and the fragments it has."""
    k, high = 0, 2
    while n >= high:
        k, high = k + 1, max(high + 1, int(high * RATIO))
    different = rule.most_different(high - 1)
    return k, different + 1 + different // SPARE


def signatures(grams: np.ndarray, rule: Rule = RULE) -> tuple[np.ndarray, int, int]:
    """Signatures of a set, of which two linked sets share at least one.

    Also the number of filled fragments in the set's own class, and how many signatures
    it must share with any partner at least, whichever class they meet in.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, dtype=np.uint64), 0, 0
    least_partner = rule.least_partner(n)
    classes = {size_class(m, rule) for m in (n, least_partner)}
    low, high = min(c[0] for c in classes), max(c[0] for c in classes)
    if high - low > 1:
        classes |= {size_class(m, rule) for m in range(least_partner, n + 1)}
    mixed, out = mix(grams ^ _STEP), []
    own, filled = size_class(n, rule)[0], {}
    for number, fragments in sorted(classes):
        place = (grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        filled[number] = len(starts)
        tag = np.uint64(number) << np.uint64(48)
        out.append(mix(np.add.reduceat(mixed, starts) ^ mix(place[starts] ^ tag)))
        if len(starts) <= rule.most_different(n):
            prefix = grams[: n - least_partner + 1]
            out.append(mix(mix(prefix ^ tag) + _STEP))
    return np.concatenate(out), filled[own], max(1, min(filled.values()) - rule.most_different(n))


def set_name(grams: np.ndarray) -> int:
    """One number for the whole set."""
    return int(mix(np.array([np.sum(mix(grams + _STEP)) + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, rule: Rule = RULE) -> bool:
    """Whether two sets at hand link, counted by fragment as `verify` counts stored ones."""
    if not len(a) or not len(b):
        return False
    need = -(-rule.percent * (len(a) + len(b)) // rule.whole)  # 100 i >= percent (a + b - i)
    edges = np.arange(1, 1 << PART_BITS, dtype=np.uint64) << np.uint64(64 - PART_BITS)
    parts = zip(np.split(a, np.searchsorted(a, edges)), np.split(b, np.searchsorted(b, edges)), strict=True)
    return sum(len(np.intersect1d(x, y, assume_unique=True)) for x, y in parts) >= need


def _sets(slim: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, row, key, n_shingles, filled, needed, node and signatures of every row, stored."""
    kind = slim.schema["doc_id"].dataType
    numbers = ("row", "key", "n_shingles", "filled", "needed", "node")
    shape = pa.schema([("doc_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in numbers], ("sigs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, filled, needed, names, sigs = [], [], [], [], []
            for grams in shingle_sets(batch.column("text"), rule.words):
                made, own, least = signatures(grams, rule)
                sizes.append(len(grams))
                filled.append(own)
                needed.append(least)
                names.append(set_name(grams) if len(grams) else None)
                sigs.append(made.view(np.int64))
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in sigs], dtype=np.int64))).astype(np.int32)
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
            made = [pa.array(c, pa.int64()) for c in (sizes, filled, needed, names)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("row"), batch.column("key"), *made, pa.ListArray.from_arrays(pa.array(bounds), flat)], schema=shape
            )

    rows = slim.withColumn("row", F.monotonically_increasing_id())
    return stored(rows.mapInArrow(run, f"doc_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in numbers)}, sigs array<bigint>"), "ngram-sets")


def _fragments(slim: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(node, part, grams) of the wanted (node, key) rows, a stored table, stored.

    The key only finds the texts; the name of a set is made again and must be the node's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parts, lists = [], [], []
            for node, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), rule.words), strict=True):
                if not len(grams) or set_name(grams) != node:
                    continue
                place = grams >> np.uint64(64 - PART_BITS)
                starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                nodes += [node] * len(starts)
                parts += place[starts].tolist()
                lists += np.split(grams.view(np.int64), starts[1:])
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int32)
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.record_batch(
                [pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), flat)], names=["node", "part", "grams"]
            )

    texts = stored(slim.join(small_side(wanted, 24), "key").groupBy("node").agg(F.min("text").alias("text")), "ngram-texts")
    return stored(texts.mapInArrow(run, "node bigint, part int, grams array<bigint>"), "ngram-fragments")


def _key_of(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, key) of distinct nodes, stored."""
    return stored(nodes.distinct().join(facts.select("node", "key"), "node"), "ngram-wanted")


def verify(pairs: DataFrame, fragments: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The (a, b) pairs that link: overlaps by fragment, summed for each pair.

    `pairs` has a, b and the sizes n_a and n_b.
    """
    one = fragments.select(F.col("node").alias("a"), "part", F.col("grams").alias("grams_a"))
    two = fragments.select(F.col("node").alias("b"), "part", F.col("grams").alias("grams_b"))
    partial = pairs.join(one, "a").join(two, ["b", "part"]).select("a", "b", "n_a", "n_b", "part", F.size(F.array_intersect("grams_a", "grams_b")).alias("here"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("here").alias("both"))
    return stored(summed.where(100 * F.col("both") >= rule.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), "ngram-links")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with the least node that links reach, stored.

    Every round takes the least label among neighbours, then the label's own label, so
    chains shorten by half.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ngram-edges")
    labels = stored(nodes.select("node", F.col("node").alias("component")), "ngram-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        moved = stored(moved, "ngram-moved")
        own = moved.select(F.col("node").alias("label"), F.col("component").alias("further"))
        after = stored(moved.join(own, moved["component"] == own["label"], "left").select("node", F.coalesce("further", "component").alias("component"), "old"), "ngram-labels")
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels


def _possible(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs with their sizes, filled fragments and the number of signatures they share."""
    columns = ("n", "filled", "sigs")
    one = held.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    two = held.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    shared = F.size(F.array_intersect("sigs_a", "sigs_b")).alias("shared")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "filled_a", "filled_b", shared)


def _allowed(rule: Rule) -> Column:
    """Whether the numbers of `_possible` allow a link.

    With sizes x and y a link at p percent has at most x + y - 2 * ceil(p (x + y) / (100 + p))
    n-grams in one set only; each spoils at most one filled fragment of the smaller set's class.
    """
    x, y = F.col("n_a"), F.col("n_b")
    different = x + y - 2 * F.ceil(rule.percent * (x + y) / F.lit(rule.whole))
    filled = F.when(x <= y, F.col("filled_a")).otherwise(F.col("filled_b"))
    return (100 * F.least(x, y) >= rule.percent * F.greatest(x, y)) & (F.col("shared") >= filled - different)


def _linked(pairs: DataFrame, held: DataFrame, slim: DataFrame, rule: Rule) -> DataFrame | None:
    """Those of the candidate pairs that link, or None if none can."""
    possible = stored(_possible(pairs, held).where(_allowed(rule)).select("a", "b", "n_a", "n_b"), "ngram-possible")
    if possible.isEmpty():
        return None
    wanted = _key_of(possible.select(F.col("a").alias("node")).union(possible.select("b")), held)
    return verify(possible, _fragments(slim, wanted, rule), rule)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, linked by `rule`."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    sets = _sets(slim, rule)
    least = [F.min(c).alias(c) for c in ("row", "key", "filled", "needed")]
    named = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n_shingles").alias("n"), *least)
    nodes = stored(named, "ngram-nodes")
    copies = small_side(stored(nodes.where("copies > 1").select(F.col("node").alias("c_node"), F.col("row").alias("c_row")), "ngram-copies"), 16)
    single = sets.join(copies, F.col("node") == F.col("c_node"), "left").where("node IS NOT NULL AND (c_row IS NULL OR row = c_row)")
    sigs = single.select("node", F.explode("sigs").alias("sig"))
    shared = stored(sigs.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "ngram-shared")
    met = sigs.join(shared, "sig").groupBy("sig", "node").agg(F.max("n").alias("n"))
    grouped = stored(met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("ranked")), "ngram-met")
    # a set that shares too few signatures with all others together links with none; of
    # two sets that share t, both hold one of these among all but the t - 1 most frequent
    rarest = F.slice("ranked.sig", F.lit(1), (F.size("ranked") - F.col("needed") + 1).cast("int"))
    enough = grouped.join(nodes, "node").where(F.size("ranked") >= F.col("needed"))
    held = stored(enough.select("node", "key", "n", "filled", F.col("ranked.sig").alias("sigs"), rarest.alias("rarest")), "ngram-held")
    labels = _link(slim, held, rule)

    placed = stored(nodes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "ngram-placed")
    ends = placed.groupBy("component").agg(F.min("first").alias("end"))
    ended = stored(placed.join(ends, "component").select("node", "end"), "ngram-ends")
    return sets.join(ended, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("end")).alias("component_id"))


def _link(slim: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """Labels of the held sets: pivots of the groups first, then what pivots left apart."""
    members = stored(held.select("node", "n", F.explode("rarest").alias("sig")), "ngram-members")
    least = F.min(F.struct("node", "n")).alias("p")
    pivots = stored(members.groupBy("sig").agg(least, F.count("*").alias("k")).where("k > 1").select("sig", F.col("p.node").alias("pivot"), F.col("p.n").alias("size")), "ngram-pivots")
    fits = 100 * F.least("n", "size") >= rule.percent * F.greatest("n", "size")
    met = members.join(pivots, "sig").where((F.col("node") != F.col("pivot")) & fits)
    pairs = stored(met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "ngram-pairs")
    names = held.select("node")
    links = _linked(pairs, held, slim, rule)
    labels = stored(names.select("node", F.col("node").alias("component")), "ngram-labels") if links is None else components(names, links)

    placed = members.join(labels, "node")
    several = placed.groupBy("sig").agg(F.count("*").alias("k"), F.min("component").alias("x"), F.max("component").alias("y")).where("k > 2 AND x <> y").select("sig")
    groups = stored(placed.join(several, "sig").join(pivots, "sig").select("pivot", "node").distinct(), "ngram-groups")
    if groups.isEmpty():
        return labels
    near, differences = _differences(groups, slim, held, rule)
    if not near.isEmpty():
        links = near if links is None else links.unionByName(near)
        labels = components(names, links)
    pairs = stored(_apart(differences, labels, rule).join(pairs, ["a", "b"], "left_anti"), "ngram-pairs")
    found = _linked(pairs, held, slim, rule)
    if found is None or found.isEmpty():
        return labels
    return components(names, found if links is None else links.unionByName(found))


def _differences(groups: DataFrame, slim: DataFrame, held: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links that the bases of the groups prove, and the members as differences to the base.

    The weight of a member is whole * |difference| - alike * |set|, with the rule's numbers. As the difference of
    two members is at most the sum of theirs, weights whose sum is not positive prove a link.
    The centre of a group is its member of least weight.
    """
    fragments = _fragments(slim, _key_of(groups.select("node"), held), rule)
    sets = fragments.groupBy("node").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    rows = stored(groups.join(stored(sets, "ngram-whole"), "node"), "ngram-grouped")
    sizes = groups.groupBy("pivot").agg(F.count("*").alias("k"))
    often = rows.select("pivot", F.explode("grams").alias("gram")).groupBy("pivot", "gram").agg(F.count("*").alias("c"))
    # at most twice the mean size of the members
    bases = often.join(stored(sizes, "ngram-sizes"), "pivot").where("2 * c > k").groupBy("pivot").agg(F.collect_list("gram").alias("base"))
    based = rows.join(stored(bases, "ngram-bases"), "pivot", "left").withColumn("base", F.coalesce("base", F.array().cast("array<bigint>")))
    apart = based.select("pivot", "node", F.size("grams").alias("n"), F.concat(F.array_except("grams", "base"), F.array_except("base", "grams")).alias("grams"))
    weighed = stored(apart.withColumn("weight", F.lit(rule.whole) * F.size("grams") - F.lit(rule.alike) * F.col("n")), "ngram-differences")
    centres = weighed.groupBy("pivot").agg(F.min(F.struct("weight", "node")).alias("c")).select("pivot", F.col("c.node").alias("centre"), F.col("c.weight").alias("least"))
    whole = stored(weighed.join(stored(centres, "ngram-centres"), "pivot"), "ngram-weighed")
    near = whole.where("node <> centre AND weight + least <= 0").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return stored(near.distinct(), "ngram-near"), whole


def _apart(differences: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components whose differences to their base share enough.

    Two members that link but not through the centre share at least (sum of their weights) /
    (2 * whole) n-grams of their differences. The partner of a member weighs at least
    as much as the centre, or as the least outside if the member is of the centre's component.
    """
    own = labels.withColumnsRenamed({"node": "centre", "component": "central"})
    placed = stored(differences.join(labels, "node").join(own, "centre"), "ngram-placed")
    outer = placed.where("component <> central").groupBy("pivot").agg(F.min("weight").alias("outer"))
    open_rows = placed.join(stored(outer, "ngram-outer"), "pivot")
    partner = F.when(F.col("component") == F.col("central"), F.col("outer")).otherwise(F.col("least"))
    largest = F.floor(F.lit(100) * F.col("n") / F.lit(rule.percent))
    shares = F.greatest(F.lit(1), F.ceil((F.col("weight") + partner) / F.lit(2 * rule.whole)), F.ceil((F.col("weight") - rule.alike * largest) / F.lit(rule.whole)))
    open_rows = open_rows.select("pivot", "node", "n", "component", "grams", shares.alias("shares")).where(F.size("grams") >= F.col("shares"))
    open_rows = stored(open_rows, "ngram-open")
    grams = open_rows.select("pivot", "node", F.explode("grams").alias("gram"))
    common = stored(grams.groupBy("pivot", "gram").agg(F.count("*").alias("c")).where("c > 1"), "ngram-common")
    ranked = grams.join(common, ["pivot", "gram"]).groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("ranked"))
    facts = open_rows.join(ranked, ["pivot", "node"]).withColumn("v", F.size("ranked")).withColumn("u", F.size("grams") - F.col("v")).where("v >= shares")
    facts = facts.withColumn("light", 2 * rule.whole * F.col("u") <= rule.alike * (F.col("n") + F.floor(F.lit(100) * F.col("n") / F.lit(rule.percent))))
    prefix = F.slice("ranked.gram", F.lit(1), (F.col("v") - F.col("shares") + 1).cast("int"))
    rows = stored(facts.select("pivot", "node", "n", "component", "v", "u", "light", F.explode(prefix).alias("gram")), "ngram-prefixes")
    light = rows.where("light").drop("light")
    other = rows.select("pivot", "gram", "light", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "component", "v", "u")])
    spoiled = F.col("u") + F.col("u_b") + F.abs(F.col("v") - F.col("v_b"))
    fits = (F.col("component") != F.col("component_b")) & (rule.whole * spoiled <= rule.alike * (F.col("n") + F.col("n_b"))) & (~F.col("light") | (F.col("node") < F.col("node_b")))
    met = light.join(other, ["pivot", "gram"]).where(fits)
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
