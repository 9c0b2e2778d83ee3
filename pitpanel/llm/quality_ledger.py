"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the bits.

`ledger` gives one row per input row: doc_id, the measurements and fail_bits (bit k set: rule k failed).
`judged` adds the verdict of a versioned policy, which is a mask over the bits. `ablation` tells what each
rule of a policy removes alone and what the policy would keep without it, from counts per bit pattern.
Everything is DataFrame expressions; no text leaves the JVM.

Defined cases. Null or empty text: no words, so only `few_words` fails. Null id: passed through. Repeated rows:
one result each. Empty table: no rows. Other columns of the input are ignored. A policy version that does not
exist raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ASCII white space, the characters counted as symbols, the rules' limits.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "many_symbols": "n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
}
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "short_words", "long_words", "many_symbols", "duplicate_lines"),
}
BIT = {rule: 1 << k for k, rule in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice; windows are compared by a 64-bit hash within the text."""

    def places(sorted_windows: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(sorted_windows, i)["h"] == x["h"], F.lit(False))
        hit = F.filter(sorted_windows, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        found = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)
        )
        return F.when(F.size(w) < 4, 0).otherwise(let(windows, found))

    return let(words, of)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    values = {"n_words": "w.n_words", "n_lines": "l.n_lines", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words"}
    rows = measured.select("doc_id", *[F.col(c).cast("long").alias(n) for n, c in values.items()])
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("fail_bits", bits)


def mask(version: int) -> int:
    if version not in POLICIES:
        raise ValueError(f"no policy {version}; there are {sorted(POLICIES)}")
    return sum(BIT[r] for r in POLICIES[version])


def judged(rows: DataFrame, version: int) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("long")) == 0)


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """rule, n_failed, n_only (rows that fail this rule alone), n_kept, n_kept_without: one row per rule of the policy."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        patterns.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit").groupBy("rule")
        .agg(
            count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            count(F.col("bits") == F.col("bit")).alias("n_only"),
            count(F.col("bits") == 0).alias("n_kept"),
            count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
        )
    )
