"""Rule bitmask ledger: every rule is evaluated once, policies are masks over its bits.

``build_ledger`` measures each text and stores one bit per failed rule. A policy is a named,
versioned set of rules; applying it is one bitwise AND, so a changed policy never reads the
texts again. ``ablations`` answers what each rule of a policy costs from counts per distinct
bit pattern, of which there are at most 2 to the number of rules.

Only column functions are used. Cases: a NULL text has no words; a NULL key is kept as it is;
equal rows give equal rows; an empty table gives an empty ledger; columns other than the key
and the text are not carried, so their names cannot clash; a text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.words import SPACE_CHARS, trimmed, words_of_trimmed

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; NULL counts as passed."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that it enforces."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[name] for name in self.rules)


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("stutter", "5 * n_stutter > n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(r.name for r in RULES))


def _repeated(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from the words ``_w``.

    A window stands for its 64-bit hash. Texts without an equal pair, which is most of them,
    are settled by one distinct count; only the others sort their windows.
    """
    n = F.size("_w")
    hashes = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes)
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(placed)),
    ).drop("_h")
    s = F.col("_s")
    again = F.filter(
        s,
        lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_s")
    p, m = F.col("_p"), F.size("_p")
    steps = F.zip_with(
        F.slice(p, F.lit(1), m - 1), F.slice(p, F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and what the rules look at, one row per text."""
    df = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_trim", trimmed(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = df.select(
        "_key", "_trim", words_of_trimmed(F.col("_trim")).alias("_w"), lines.alias("_lines"),
        F.regexp_count("_trim", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_trim", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
    )
    n = F.size("_w")
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("_w", F.lit(1), rest), F.slice("_w", F.lit(2), rest), lambda a, b: a == b
    )
    df = df.select(
        "_key", "_w", "n_symbols", "n_upper", n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(pairs, lambda same: same)).cast("long").alias("n_stutter"),
    )
    return _repeated(df).drop("_w").withColumnRenamed("_key", key)


def build_ledger(
    df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Measurements and ``fail_bits`` (bit i is set where ``rules[i]`` fails), one row per text."""
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(
            F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        )
    return measure(df, key, text).withColumn("fail_bits", bits)


def passes(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policies(
    ledger: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES
) -> DataFrame:
    """The ledger with a column ``kept_<version>`` per policy."""
    return ledger.withColumns({f"kept_{p.version}": passes(p, rules) for p in policies})


def ablations(
    ledger: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Per policy and rule: texts that fail it, that fail it alone, and kept with and without it."""
    counts = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(
            F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
            F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"),
        )
        for p in policies for i, r in enumerate(rules) if r.name in p.rules
    ]
    failed = F.col("fail_bits").bitwiseAND(F.col("c.mask"))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    return (
        counts.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c"))
        .groupBy(F.col("c.version").alias("version"), F.col("c.rule").alias("rule"))
        .agg(
            total(F.col("fail_bits").bitwiseAND(F.col("c.bit")) != 0).alias("failed"),
            total(failed == F.col("c.bit")).alias("failed_alone"),
            total(failed == 0).alias("kept"),
            total(failed.bitwiseAND(F.bitwise_not(F.col("c.bit"))) == 0).alias("kept_without"),
        )
    )


def verdicts(df: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under ``policy``; the base always holds."""
    base = ~passes(BASE)
    return build_ledger(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(policy)).alias("kept"),
        "n_lines", "n_upper", "n_stutter", "fail_bits",
    )
