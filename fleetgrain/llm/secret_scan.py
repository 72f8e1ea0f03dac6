"""Secret scan: spans by kind, and how widely each candidate value is copied.

Spans come from native functions only. `split` and `regexp_extract_all` by one pattern
walk the same matches, so the pieces between matches and the matches themselves give
every start and end by running sums; only texts that hold a match take that path.

Ownership frequency: the hash of every candidate value is aggregated over the corpus by
distinct repositories and owners. A value held by one owner is live-looking; one that
several owners hold is a widely copied example. Rows are combined per (hash, repository,
owner) before they are shuffled, so a value in a third of all texts stays small, and
neither text nor value leaves its row: only hashes travel.

Defined cases: null or empty text has no spans; kinds are independent, so spans of
different kinds may overlap; null owners count as one owner; repeated rows count once
per owner; rows with null ids are told apart by a hash of their text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import let, small_side, stored


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value and the least length of that group.

    Matches whose value is shorter are dropped after matching; they still consume
    their text. `probe` is found in every text that has a kept match.
    """

    name: str
    pattern: str
    probe: str
    group: int = 0
    least: int = 1


BASE = (
    Kind(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
        group=2,
        least=12,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", least=18),
    Kind("hex", r"[0-9a-f]+", r"[0-9a-f]{16}", least=16),
)
#: Kinds that the method adds.
ADDED = (
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
KINDS = BASE + ADDED
SPAN = "array<struct<start:int,kind:int,end:int,value:bigint>>"
#: A value that more owners than this hold is a widely copied example.
MOST_OWNERS = 2


def _spans(text: Column, kind: Kind, place: int) -> Column:
    """Matches of one kind as (start, kind, end, value hash), code points, end exclusive.

    The text before match k is piece k of the split, so starts are running sums of the
    lengths of pieces and matches.
    """
    pattern = F.lit(kind.pattern)

    def build(pieces: Column, found: Column, values: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            begin = acc["at"] + F.length(F.get(pieces, k))
            end = begin + F.length(F.get(found, k))
            value = F.get(values, k)
            one = F.array(
                F.struct(begin.alias("start"), F.lit(place).alias("kind"), end.alias("end"), F.xxhash64(value).alias("value"))
            )
            return F.struct(
                end.alias("at"), F.when(F.length(value) >= kind.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans")
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["spans"])

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group))
    walk = let(F.split(text, kind.pattern, -1), lambda p: let(found, lambda f: let(values, lambda v: build(p, f, v))))
    return F.when(text.rlike(kind.probe), walk).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, k, i) for i, k in enumerate(kinds)]))


def _key(id_: Column, text: Column) -> Column:
    """What tells rows with null ids apart; null for all others."""
    return F.when(id_.isNull(), F.xxhash64(text))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Spans of every row with its owner and repository hashes, stored: doc_id, key, owner, repo, spans."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        _key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.xxhash64(F.col(owner_col)).alias("owner"),
        F.xxhash64(*[F.col(c) for c in repo_cols]).alias("repo"),
    )
    return stored(slim.select("doc_id", "key", "owner", "repo", all_spans(F.col("text")).alias("spans")), "secret-spans")


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """How many repositories and owners hold each candidate value: value, n_repos, n_owners, live.

    Rows are made distinct per task before they are shuffled.
    """
    held = found.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value"), "repo", "owner")
    pairs = held.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one"))
    return pairs.groupBy("value").agg(
        F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners")
    ).withColumn("live", F.col("n_owners") <= most_owners)


def verdicts(found: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """Live-looking and example values of each document that holds any: doc_id, key, live_values, n_live, n_example."""
    values = found.select("doc_id", "key", F.explode(F.transform("spans", lambda s: s["value"])).alias("value")).distinct()
    judged = values.join(ownership(found, most_owners), "value")
    return judged.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("live"), F.col("value")))).alias("live_values"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )


def spans_text(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    shown = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(shown, ",")


def scan(docs: DataFrame, **columns) -> DataFrame:
    """A row per document: doc_id, spans, n_live, n_example."""
    found = find(docs, **columns)
    judged = verdicts(found).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "n_live", "n_example")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("key").eqNullSafe(F.col("__key"))
    return found.select("doc_id", "key", "spans").join(judged, same, "left").select(
        "doc_id", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example")
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every stretch that spans cover replaced by `mark`; spans are sorted and may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **columns) -> DataFrame:
    """`docs` with live-looking secrets replaced in the text; all other rows and columns stay.

    Widely copied examples stay as they are. `length_col` is set to the code points of
    the texts that change.
    """
    judged = verdicts(find(docs, id_col, text_col, **columns)).where("n_live > 0")
    live = judged.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("live_values").alias("__live"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = F.filter(all_spans(text), lambda s: F.array_contains(F.col("__live"), s["value"]))
    same = docs[id_col].eqNullSafe(F.col("__id")) & _key(docs[id_col], text).eqNullSafe(F.col("__key"))
    joined = docs.join(small_side(stored(live, "secret-live"), 200), same, "left")
    joined = joined.withColumn("__new", F.when(F.col("__live").isNotNull(), redact(text, hit)))
    changed = {text_col: F.coalesce("__new", text_col)}
    if length_col is not None:
        changed[length_col] = F.coalesce(F.length("__new").cast(docs.schema[length_col].dataType), F.col(length_col))
    return joined.withColumns(changed).select(*docs.columns)
