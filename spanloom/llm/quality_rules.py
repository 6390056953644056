"""Rule bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

All of it is DataFrame functions. The ledger keeps one bit for each failed rule in ``bits`` and
the measurements behind them; applying another policy, or asking what one rule costs, reads the
bits only and never the texts again.

Edge cases: a null or empty text has no words and fails ``few_words``; columns of the input
other than the id and the text are never read, so their names cannot clash; repeated rows give
repeated rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import WS, let, materialize, words_of


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules in bit order; new ones go to the end so that stored bits keep their meaning."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 50),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > 2 * c("n_words")),
        Rule("duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule("word_length", (c("word_chars") > 14 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        Rule("upper_case", 2 * c("n_upper") > c("word_chars")),
    ]


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "upper_case")

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "2025.1": RULE_NAMES,
}


def mask(policy: str) -> int:
    return sum(1 << RULE_NAMES.index(r) for r in POLICIES[policy])


def repeat_words(words: Column) -> Column:
    """Number of words that stand in a three-word window occurring at least twice in the text.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """

    def covered(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        twice = F.filter(
            sorted_windows,
            lambda e, j: ((j > 0) & (sorted_windows[F.greatest(j - 1, F.lit(0))]["w"] == e["w"]))
            | ((j < last) & (sorted_windows[F.least(j + 1, last)]["w"] == e["w"])),
        )
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("prev"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("prev"), (a["n"] + F.least(F.lit(3), x - a["prev"])).alias("n")),
            lambda a: a["n"],
        )

    def of_windows(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(pairs, covered))

    def of_hashes(h: Column) -> Column:
        win = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))
        return F.when(F.size(h) < 4, F.lit(0)).otherwise(let(win, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """One row a document: the measurements all rules share; ``carry`` comes along as ``_row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = [] if carry is None else [carry.alias("_row")]
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), *extra)
    along = [F.col("_row")] if extra else []
    split = base.select(
        "doc_id",
        *along,
        "_t",
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    return split.select(
        "doc_id",
        *along,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WS, "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Measurements and ``bits``: bit k is set when rule k fails."""
    bits = F.lit(0).cast("long")
    for k, r in enumerate(rules()):
        bits = bits + F.when(r.fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(docs, id_col, text_col, carry).withColumn("bits", bits)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written once to the shared folder: policies and ablations read it, not the texts."""
    return materialize(ledger(docs, id_col, text_col), "rule-ledger")


def apply_policy(book: DataFrame, policy: str = "2025.1") -> DataFrame:
    """Add ``base_failed`` and ``kept``; both come from the stored bits alone."""
    failed = F.col("bits").bitwiseAND(F.lit(mask("base"))) != 0
    return book.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("bits").bitwiseAND(F.lit(mask(policy))) == 0)
    )


def kept_rows(docs: DataFrame, policy: str = "2025.1") -> DataFrame:
    """The whole rows of ``docs`` that a policy keeps, in one pass and without a join."""
    book = ledger(docs, carry=F.struct(*[F.col(c) for c in docs.columns]))
    return apply_policy(book, policy).where("kept").select("_row.*")


def ablation(book: DataFrame, policy: str = "2025.1") -> DataFrame:
    """What each rule of a policy costs: documents failing it, failing only it, and kept without it.

    The ledger is first counted by distinct bit pattern, at most 2 ** rules rows.
    """
    spark, m = book.sparkSession, mask(policy)
    patterns = book.groupBy("bits").agg(F.count(F.lit(1)).alias("docs"))
    policy_rules = spark.createDataFrame(
        [(policy, r, 1 << RULE_NAMES.index(r)) for r in POLICIES[policy]], "policy string, rule string, bit long"
    )
    rule_bits = F.array(*[F.lit(1 << RULE_NAMES.index(r)).cast("long") for r in POLICIES[policy]])
    each = patterns.select("bits", "docs", F.explode(rule_bits).alias("bit"))
    rest = F.col("bits").bitwiseAND(F.lit(m)).bitwiseAND(F.bitwise_not("bit"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    counted = each.groupBy("bit").agg(
        F.sum(F.when(hit, F.col("docs")).otherwise(0)).alias("failing"),
        F.sum(F.when(hit & (rest == 0), F.col("docs")).otherwise(0)).alias("failing_only"),
        F.sum(F.when(rest == 0, F.col("docs")).otherwise(0)).alias("kept_without"),
    )
    return policy_rules.join(counted, "bit", "left").select(
        "policy", "rule", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("failing", "failing_only", "kept_without")]
    )
