"""Quality rules as a short-circuit cascade of native expressions.

A rule is a condition that rejects a document. The cost of each rule (seconds) and its
rejection rate among the documents that reach it are measured on a bounded sample, rules are
ordered by rejections per cost, and the cascade is one CASE expression: what stands after the first rule that rejects is not
evaluated for that row. The order changes the work, never the verdict. No Python runs on the
executors.

Nulls and edge cases: a null text has no words and fails the base rule, as an empty one
does; rows with a null id and repeated rows are judged like any other; an empty table gives
an empty result (rules keep their given order, as they do if the base rule rejects the whole
sample); other columns are carried only if named in keep, which may not name a column of the result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, check_keep, let, stash, unstash

#: The sample that the order of rules is estimated on: documents, about, and the most characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 100_000
#: Characters that a rule is timed on, about, and how often.
SAMPLE_WORK, PASSES = 8_000_000, 2
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """reject: true where a document fails. It may read the columns of measures() and text."""

    name: str
    reject: Column


def measures(text: Column) -> Column:
    """A struct of longs: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""

    def over_text(t: Column) -> Column:
        def over_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
            )

        return let(F.regexp_extract_all(t, F.lit(f"({WORD})")), over_words)

    return let(F.coalesce(text, F.lit("")), over_text)


def repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that are found twice or more, the first found
    included. Windows are compared by a 64-bit hash; those that share one are then compared
    word by word with the neighbour of the same hash, so a collision adds nothing."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def count(h: Column) -> Column:
        def marked(s: Column) -> Column:
            """s: (hash, place) in order. Places of windows equal to a neighbour's, in order."""

            def same(a: Column, b: Column) -> Column:
                return (a["h"] == b["h"]) & (F.slice(words, a["i"], WINDOW) == F.slice(words, b["i"], WINDOW))

            def found(x: Column, k: Column) -> Column:
                before = F.when(k > 0, same(F.get(s, k - 1), x)).otherwise(F.lit(False))
                after = F.when(k < F.size(s) - 1, same(x, F.get(s, k + 1))).otherwise(F.lit(False))
                return before | after

            return F.array_sort(F.transform(F.filter(s, found), lambda x: x["i"]))

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i")))
        places = let(F.sort_array(pairs), marked)
        covered = let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered)

    return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(hashes, count))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules beyond the base, in the spirit of published web-corpus filters."""
    n, t = F.col("n_words"), F.coalesce(F.col("text"), F.lit(""))
    lines = lambda where: F.size(F.filter(F.split(t, "\n"), where))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.size(F.split(t, "\n")))),
        Rule("few_letters", 10 * F.regexp_count(t, F.lit(r"\p{L}")) < 6 * F.col("word_chars")),
        Rule("shouting", 10 * F.regexp_count(t, F.lit(r"(?:^|[\x20\x09-\x0D])\p{Lu}{2,}")) > 3 * n),
        Rule("bullets", 10 * lines(lambda x: F.regexp_like(x, F.lit(r"^[\x20\x09]*[-*•]"))) > 9 * lines(lambda x: F.lit(True))),
        Rule("ellipses", 10 * lines(lambda x: F.regexp_like(x, F.lit(r"(?:\.\.\.|…)[\x20\x09\x0D]*\z"))) > 3 * lines(lambda x: F.lit(True))),
    ]


def sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """About sample_rows texts of at most SAMPLE_CHARS characters from all of the table, drawn
    by a fixed seed, with their measures; those the base rule rejects are left out."""
    n = rows.count()
    few = rows.select("text") if n <= sample_rows else rows.select("text").sample(sample_rows / n, 11)
    few = few.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    few = few.select("text", measures(F.col("text")).alias("m")).select("text", "m.*").where(~base_failed())
    return stash(few.repartition(1), "sample")


def order_rules(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost, rejection rate) in the order of the cascade. rows: text.

    Cost is the time a rule takes on a written sample, over and above a pass that reads it
    and judges nothing; every text is judged so often that this is most of the time, and the
    least of several passes counts. The first rule is that of most rejections per cost, the
    next that of most rejections per cost among the texts which are then left, and so on; the
    rate is of those texts.
    """
    sample = sampled(rows, sample_rows)
    rejects = [F.coalesce(rule.reject, F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]
    left = [tuple(r) for r in sample.select(*rejects).collect()]  # a sample's booleans
    if not left or not rules:
        unstash(sample)
        return [(r, 0.0, 0.0) for r in rules]
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 1
    often = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(1000, SAMPLE_WORK // chars))))))

    def took(reject: Column) -> float:
        least = float("inf")
        for _ in range(PASSES):
            began = time.perf_counter()
            often.agg(F.count_if(reject)).first()
            least = min(least, time.perf_counter() - began)
        return least

    # what differs from copy to copy cannot be worked out once for all of them
    turn = F.col("_again") > 0
    empty = min(took(turn & (F.length("text") < 0)) for _ in range(2))
    costs = [max(took(turn & rule.reject) - empty, empty / 50) for rule in rules]
    out, todo = [], list(range(len(rules)))
    while todo:
        rate = {i: sum(r[i] for r in left) / max(1, len(left)) for i in todo}
        best = max(todo, key=lambda i: (rate[i] / costs[i], -costs[i]))
        out.append((rules[best], costs[best], rate[best]))
        left = [r for r in left if not r[best]]
        todo.remove(best)
    unstash(sample)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed boolean, kept boolean, and keep."""
    check_keep(keep, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    measured = rows.withColumn("m", measures(F.col("text"))).select("*", "m.*").drop("m")
    ordered = order_rules(rows, default_rules() if rules is None else rules)
    verdict = F.when(base_failed(), F.lit(False))
    for rule, _, _ in ordered:
        verdict = verdict.when(F.coalesce(rule.reject, F.lit(False)), F.lit(False))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select("doc_id", *names, base_failed().alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])
