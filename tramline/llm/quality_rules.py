"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once a document.  The ledger stores one bit for each failed rule and
the measurements behind it, so that policies (named, versioned sets of rules) and ablations
(what a rule alone rejects) need no second pass over the texts.  DataFrame functions only.

Nulls and empty texts have no words and measure 0 everywhere.  Repeated rows are judged one by
one, ties cannot occur, an empty table gives an empty ledger, and columns other than the id
and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import BLANKS, let

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: As a regular expression, a run of what parts words.
GAP = "[ \\t-\\r]+"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once a ledger is stored."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)"),
    Rule("capitals", 5, "10 * n_capitals > 4 * word_chars AND word_chars > 0"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(r.name for r in RULES))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeats(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are compared as 64-bit hashes of their words.  Most texts have no such window and
    stop after the hash set; the others sort (hash, place) pairs, so no text costs more than
    n log n.
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def places(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
        return F.sort_array(
            F.transform(
                F.filter(
                    F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), (same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0))))).alias("twice"))),
                    lambda p: p["twice"],
                ),
                lambda p: p["i"],
            )
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, places), covered))

    return F.when(n < 3, 0).otherwise(let(hashes, count))


def measure(text: Column) -> dict[str, Column]:
    """The measurements of a text; a null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))
    bare = _without(text, BLANKS)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    by_words = let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.struct(F.lit(0).alias("n"), F.lit(0).alias("rep"))).otherwise(
            let(F.split(t, GAP, -1), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("rep")))
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return {
        "words": by_words,
        "lines": by_lines,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_capitals": (F.length(text) - F.length(_without(text, CAPITALS))).cast("long"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: its id, the measurements and ``failure_bits`` (long)."""
    m = measure(F.col(text_col))
    out = docs.select(F.col(id_col), *(c.alias(k) for k, c in m.items()))
    out = out.select(
        id_col,
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("words.rep").cast("long").alias("n_repeat_words"),
        "n_capitals",
    )
    bits = " | ".join(f"IF({r.fails}, {1 << r.bit}L, 0L)" for r in rules)
    return out.withColumn("failure_bits", F.expr(bits))


def judge(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, as_col: str = "kept") -> DataFrame:
    """A stored ledger with the verdict of a policy; reads bits only."""
    return entries.withColumn(as_col, F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablate(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it rejects.

    The ledger is first counted by its bits: at most 2 ** len(rules) rows leave the scan.
    """
    mask = policy.mask(rules)
    counts = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules)))
    return (
        counts.select("bits", "n", named.alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        )
        .withColumn("policy", F.lit(policy.version))
    )


def by_group(entries: DataFrame, group: str) -> DataFrame:
    """Which rules any, and all, documents of a group fail, through bitwise aggregation."""
    return entries.groupBy(group).agg(F.bit_or("failure_bits").alias("any_bits"), F.bit_and("failure_bits").alias("all_bits"), F.count("*").alias("n"))


def keep(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, all columns as they were."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = ledger(inner.withColumn("text_", F.col(f"row.`{text_col}`")), "row", "text_")
    return judge(rows, policy, as_col="kept").filter("kept").select("row.*")
