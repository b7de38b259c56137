"""Quality rules as a short-circuit cascade, DataFrame functions only.

Every rule's rejection rate and cost are estimated on a seeded sample: the cost counts the characters and words that the
rule and the signals it needs go over, so it is the same in every run. A row then meets the rules in the order of
rejection per cost and leaves at the first that rejects it. The order changes the work, never the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, read_table

SYMBOLS = "[#*$%&|<>]"
#: Part of the rows that estimates the rules, and the sample's seed.
SAMPLE, SEED = 0.005, 11


@dataclass(frozen=True)
class Rule:
    """A rule rejects a row where `fails` is true; null counts as no rejection. `work` counts what it goes over itself."""

    name: str
    fails: Column
    work: Column
    needs: tuple[str, ...] = ("words",)


def default_rules() -> list[Rule]:
    """Whole-number forms of common web-text heuristics over the signals."""
    c, one, chars = F.col, F.lit(1), F.char_length("__text")
    return [
        Rule("symbol_ratio", c("n_symbols") * 10 > c("n_words"), one, ("words", "symbols")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")), one),
        Rule("dup_lines", c("n_dup_lines") * 2 > c("n_lines"), one, ("lines",)),
        Rule("few_letters", F.regexp_count("__text", F.lit(r"\p{L}")) * 10 < 6 * c("word_chars"), chars),
        Rule("ellipsis_lines", F.regexp_count("__text", F.lit(r"(?m)(\.\.\.|…)[\x20\t]*$")) * 10 > 3 * c("n_lines"), chars, ("lines",)),
        Rule("vocabulary", (c("n_words") >= 200) & (F.size(F.array_distinct("__words")) * 20 < c("n_words")), F.when(c("n_words") >= 200, c("n_words")).otherwise(1)),
    ]


def base_rules(min_words: int = 50) -> list[Rule]:
    """Rows of under `min_words` words, or with over half of the words in repeated three-word windows."""
    return [
        Rule("few_words", F.col("n_words") < min_words, F.lit(1)),
        Rule("repetition", F.col("n_repeat_words") * 100 > F.col("n_words") * 50, F.lit(1), ("words", "windows")),
    ]


def _words(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("__words", F.filter(F.split("__text", BLANKS), lambda w: w != ""))
    return docs.withColumns({"n_words": F.size("__words").cast("long"), "word_chars": F.char_length(F.array_join("__words", "")).cast("long")})


def _symbols(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_symbols", F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"))


def _lines(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return docs.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__lines")


def _windows(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("__windows", F.expr("IF(size(__words) < 4, CAST(array() AS array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"))
    docs = docs.withColumn("__sorted", F.expr("IF(size(array_distinct(__windows)) = size(__windows), NULL, sort_array(transform(__windows, (h, i) -> struct(h, i))))"))
    # a window found twice stands beside its equal in sorted order
    docs = docs.withColumn("__repeated", F.expr("transform(filter(__sorted, (x, i) -> x.h = get(__sorted, i - 1).h OR x.h = get(__sorted, i + 1).h), x -> x.i)"))
    n = F.expr("IF(__repeated IS NULL, 0, size(array_distinct(flatten(transform(__repeated, p -> array(p, p + 1, p + 2))))))").cast("long")
    return docs.withColumn("n_repeat_words", n).drop("__windows", "__sorted", "__repeated")


#: The signals' groups: what adds them, and what this goes over. A window is hashed and sorted.
SIGNALS = {
    "words": (_words, lambda: F.char_length("__text")),
    "symbols": (_symbols, lambda: F.char_length("__text")),
    "lines": (_lines, lambda: F.char_length("__text")),
    "windows": (_windows, lambda: 12 * F.size("__words")),
}


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `n_words`, `word_chars`, `n_symbols`, `n_lines`, `n_dup_lines`, `n_repeat_words`, and for rules __text, __words.

    Null and empty texts have no words and zero everywhere.
    """
    docs = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for add, _ in SIGNALS.values():
        docs = add(docs)
    return docs


def estimates(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[dict[str, float], dict[str, float]]:
    """Rejected parts of the sample by rule, and mean work by rule and by group of signals, in one pass over the sample."""
    rated = with_signals(docs.select(F.col(text).alias("text")).sample(fraction=SAMPLE, seed=SEED))
    work = {r.name: r.work for r in rules} | {g: made() for g, (_, made) in SIGNALS.items()}
    row = rated.agg(
        F.count("*").alias("n"),
        *[F.sum(F.coalesce(r.fails, F.lit(False)).cast("long")).alias(f"no_{r.name}") for r in rules],
        *[F.avg(w).alias(f"work_{name}") for name, w in work.items()],
    ).first()
    n = row["n"]
    return {r.name: ((row[f"no_{r.name}"] or 0) + 0.5) / (n + 1) for r in rules}, {name: row[f"work_{name}"] or 1.0 for name in work}


def ordered(rules: list[Rule], rejected: dict[str, float], work: dict[str, float], have: set[str]) -> list[Rule]:
    """The rules by rejection per cost; signals that an earlier rule needs, or in `have`, cost nothing more."""
    have, rest, out = set(have), list(rules), []
    while rest:
        best = max(rest, key=lambda r: rejected[r.name] / (work[r.name] + sum(work[g] for g in r.needs if g not in have)))
        rest.remove(best)
        have.update(best.needs)
        out.append(best)
    return out


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the row, else null; later rules are then not evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.fails, F.lit(rule.name)) if out is None else out.when(rule.fails, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", min_words: int = 50) -> DataFrame:
    """All columns of `docs` with all signals, `base_failed`, `rejected_by` and `kept`.

    base_failed: under `min_words` words, or over half of the words in repeated three-word windows. Such rows are
    rejected before the cascade. Null or empty text: no words, base_failed. Columns of `docs` that have the name of an
    added one are replaced. Repeated rows are judged one by one.
    """
    rules = default_rules() if rules is None else rules
    rules = ordered(rules, *estimates(docs, rules, text), set(SIGNALS))
    failed = base_rules(min_words)[0].fails | base_rules(min_words)[1].fails
    return (
        with_signals(docs, text).withColumn("base_failed", failed)
        .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules)))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("__words", "__text")
    )


def passing(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", min_words: int = 50) -> DataFrame:
    """The rows that `quality` keeps, with the columns of `docs`. Signals are computed only for rows that no earlier rule
    has rejected, base rules included."""
    rules = base_rules(min_words) + (default_rules() if rules is None else rules)
    out, have = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), set()
    names = {name: f"__own_{name}" for name in docs.columns if name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    out = out.withColumnsRenamed(names)
    for rule in ordered(rules, *estimates(docs, rules, text), have):
        for group in rule.needs:
            if group not in have:
                out = SIGNALS[group][0](out)
                have.add(group)
        # the row number keeps the optimiser from copying the signals into the filter
        out = out.withColumn("__row", F.monotonically_increasing_id()).where(F.coalesce(~rule.fails, F.lit(True)) & (F.col("__row") >= 0)).drop("__row")
    return out.drop("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), s AS (
  SELECT doc_id, text, words, lines, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM s WHERE n_words >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c >= 2)
  GROUP BY doc_id
), r AS (
  SELECT s.*, coalesce(rep.n, 0) AS n_repeat_words FROM s LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR n_dup_lines * 2 > n_lines
            OR len(regexp_extract_all(text, '\p{L}')) * 10 < 6 * word_chars
            OR len(regexp_extract_all(text, '(?m)(\.\.\.|…)[\x20\t]*$')) * 10 > 3 * n_lines
            OR (n_words >= 200 AND len(list_distinct(words)) * 20 < n_words)) AS kept
FROM f
"""
