"""Quality rules: a ledger of failure bits and measurements, versioned policies and ablations.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit
per failed rule, so a new policy is a new mask over stored bits and an ablation is one
aggregation of masks; neither reads a text again.  Everything here is a DataFrame expression:
no Python runs on the executors and nothing is shuffled until an ablation counts bit patterns.

Defined results: a null text counts as empty (no word, so it fails ``few_words``); a null id
stays null; repeated ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_shouted",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that the text holds twice or more.

    Windows compare by their 64-bit hash.  Only texts with some repeated hash are sorted; the
    union of the flagged windows is one pass over their ordered starts.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            size = F.size(s)
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | ((k + 1 < size) & same(x, k + 1)), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(let(ordered, starts), zero, step, lambda a: a["n"].cast("long"))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, some))


def without(text: Column, pattern: str) -> Column:
    """Code points that a pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measures(text: Column) -> Column:
    """``MEASURES`` of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def counted(w: Column) -> list[Column]:
        return [
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            repeated_words(w).alias("n_repeat_words"),
            without(text, "\\p{Lu}+").alias("n_upper"),
            without(text, "[0-9]+").alias("n_digits"),
            F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_shouted"),
        ]

    def with_lines(w: Column, x: Column) -> Column:
        lines = [F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")]
        return F.struct(*counted(w), *lines)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(words_of(text), lambda w: let(lines, lambda x: with_lines(w, x)))


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


#: Bits are never reused: a changed condition gets a new rule at the end.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", lambda m: 5 * m["n_symbols"] > m["n_words"]),
    Rule("upper_case", lambda m: 10 * m["n_upper"] > 4 * m["word_chars"]),
    Rule("shouting", lambda m: 3 * m["n_shouted"] > m["n_words"]),
    Rule("digits", lambda m: 2 * m["n_digits"] > m["word_chars"]),
    Rule("duplicate_lines", lambda m: (m["n_lines"] > 3) & (2 * m["n_dup_lines"] > m["n_lines"])),
)

BASE = ("few_words", "repeats")

#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "upper_case"),
    "v2": tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(m, fail_bits): the measures and the failure bits, every measure and rule computed once."""

    def bits(m: Column) -> Column:
        found = F.lit(0).cast("long")
        for i, rule in enumerate(rules):
            found = found + F.when(rule.fails({n: m[n] for n in MEASURES}), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        return F.struct(m.alias("m"), found.alias("fail_bits"))

    return let(measures(text), bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: bit i is set if rules[i] fails.

    Write it before filtering on it more than once: a filter on a lazy ledger judges the texts again.
    """
    entries = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text").cast("string"), rules).alias("j"))
    return entries.select("doc_id", *(F.col(f"j.m.{m}").alias(m) for m in MEASURES), "j.fail_bits")


def apply_policy(entries: DataFrame, names: tuple[str, ...], column: str = "kept") -> DataFrame:
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask(names))) == 0)


def ablation(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents, rejected by the policy, failing the rule, and kept again without the rule.

    Documents are first counted by bit pattern, so at most 2**len(rules) rows are compared.
    """
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(mask(names)).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit")) for p, names in policies.items() for i, r in enumerate(rules) if r.name in names]
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n")).withColumn("c", F.explode(F.array(*cases)))
    failed = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return patterns.groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule")).agg(
        F.sum("n").alias("documents"),
        total(failed != 0).alias("rejected"),
        total(F.col("fail_bits").bitwiseAND(F.col("c.bit")) != 0).alias("failing"),
        total(failed == F.col("c.bit")).alias("only_this_rule"),
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["v2"])
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def reject(docs: DataFrame, names: tuple[str, ...] = POLICIES["v2"], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that a policy keeps, all columns unchanged.  Judged row by row, without a join."""
    failed = judged(docs["text"].cast("string"), rules)["fail_bits"].bitwiseAND(F.lit(mask(names, rules)))
    return docs.where(failed == 0)


_SPLIT = r"[\x20\x09-\x0D]+"

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPLIT}'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPLIT}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) AS n_digits,
        len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shouted FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT + 8 * (10 * n_upper > 4 * word_chars)::INT
        + 16 * (3 * n_shouted > n_words)::INT + 32 * (2 * n_digits > word_chars)::INT + 64 * (n_lines > 3 AND 2 * n_dup_lines > n_lines)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
