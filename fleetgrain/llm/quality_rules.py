"""Quality rules: a threshold table compiled into one projection of native expressions.

A rule states the least and greatest value of one metric, and from how many words on
it applies. `compile_rules` turns the table into one boolean per rule and the verdict;
all metrics come from built-in functions over the whole text, in one pass, without a
shuffle, so every row is judged by itself.

Defined cases: a null or empty text has no words, all counts are 0 and it fails; rows
are judged one by one, so repeated rows get equal verdicts; an empty table gives an
empty table; only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import let, words_of

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PCT = 20

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "are", "be", "this",
    "by", "at", "from", "or", "an", "not",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur",
    "au", "pas", "avec",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein",
    "eine", "auch",
    "el", "los", "y", "se", "del", "las", "por", "con", "no", "para", "su", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """`low <= metric <= high`, for texts of at least `from_words` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Production thresholds. Ratios are per word or per line.
RULES = (
    Rule("length", "n_words", low=LEAST_WORDS),
    Rule("word_length", "mean_word_length", low=2.0, high=12.0, from_words=20),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_word_ratio", low=0.02, from_words=50),
    Rule("capitals", "capital_ratio", high=0.5, from_words=20),
    Rule("repeated_lines", "dup_line_ratio", high=0.5, from_words=20),
)


def _windows(words: Column) -> Column:
    """One hash for each run of WINDOW words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        ),
    )


def _covered(words: Column) -> Column:
    """Words in windows that occur twice or more, by the words themselves.

    Sorting (window, place) puts equal windows side by side; the places of those with
    an equal neighbour, in order, each cover WINDOW words up to the next one's start.
    """
    pairs = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
            lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )

    def places(s: Column) -> Column:
        same = lambda k: (
            ((k > 0) & (F.get(s, k - 1)["w"] == F.get(s, k)["w"]))
            | ((k < F.size(s) - 1) & (F.get(s, k + 1)["w"] == F.get(s, k)["w"]))
        )
        kept = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.lit(False)))
        return F.array_sort(F.transform(kept, lambda k: F.get(s, k)["i"]))

    def total(p: Column) -> Column:
        steps = F.zip_with(
            p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return let(let(pairs, places), total)


def repeated_words(words: Column) -> Column:
    """Words in runs of WINDOW found twice or more in the text, the first included.

    Most texts have no equal hashes and stop there; the others are counted exactly.
    """
    none = F.lit(0)
    return let(
        _windows(words),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(words)),
    ).cast("long")


def text_metrics(text: Column, words: Column) -> dict[str, Column]:
    """Counts of one text; `words` is the column of its words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    counted = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (
            F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>", ""))
        ).cast("long"),
        "lines": counted,
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_capital_words": F.size(
            F.filter(words, lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))
        ).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One boolean column `ok_<name>` for each rule over the metric columns."""
    out = {}
    for rule in rules:
        value, holds = F.col(rule.metric), F.lit(True)
        if rule.low is not None:
            holds = holds & (value >= F.lit(rule.low))
        if rule.high is not None:
            holds = holds & (value <= F.lit(rule.high))
        out[f"ok_{rule.name}"] = F.coalesce(holds, F.lit(False)) | (F.col("n_words") < rule.from_words)
    return out


def _judged(slim: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`slim` (doc_id, text and columns to carry) without its text, with counts and verdicts."""
    carried = [c for c in slim.columns if c != "text"]
    counts = (
        slim.withColumn("words", words_of(F.col("text")))
        .select(*carried, *[c.alias(k) for k, c in text_metrics(F.col("text"), F.col("words")).items()])
        .withColumns({"n_lines": F.col("lines")["n"].cast("long"), "n_dup_lines": F.col("lines")["dup"].cast("long")})
        .drop("lines")
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    ratios = counts.withColumns(
        {
            "mean_word_length": per_word("word_chars"),
            "symbol_ratio": per_word("n_symbols"),
            "stop_word_ratio": per_word("n_stop_words"),
            "capital_ratio": per_word("n_capital_words"),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * F.col("n_words")),
        }
    )
    checks = compile_rules(rules)
    verdict = ~F.col("base_failed")
    for name in checks:
        verdict = verdict & F.col(name)
    return ratios.withColumns(checks).withColumn("kept", verdict)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the base verdict, each rule's verdict and `kept` for every row."""
    return _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns; each row is judged where it is."""
    slim = docs.select(F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # a filter is not pushed below a row number, so the verdict's parts are computed once
    numbered = _judged(slim, rules).withColumn("at", F.monotonically_increasing_id())
    return numbered.where("kept AND at >= 0").select("row.*")
