"""Operator 5: quality rules as a bitmask ledger, in native expressions only.

``measure`` takes each text's measurements in one scan without a shuffle; ``ledger`` evaluates every rule once and sets the
failures as bits beside the measurements; ``write_ledger`` stores that, once, without the texts. A policy is a version's mask of rules: ``apply_policy`` drops what
fails one of them, without touching a text again, and ``ablation`` says, from counts of bit patterns of the stored ledger alone, what each rule of a policy drops that no
other does and what would be kept without it; ``ablations`` does so for every policy.

Words are runs of characters other than space and U+0009-U+000D. Repeated five-word windows are found inside the row: hashes of
all windows (64 bits, chained over five words) are compared in sorted order, O(n log n), and only for texts whose set of
hashes is smaller than their list.

Rows: a null or blank text has no words, no lines, and all measurements 0; repeated rows are measured each; very long texts
are one row of work, linear but for the sort. Extra columns are kept by ``measure`` unless they clash with a measurement, which then
replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path

# Characters of a break between words, counted symbols, and the window's length.
BREAKS = " \t\n\x0b\f\r"
BREAK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules by bit: name and SQL over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 AND word_chars > 60 * n_words"),
)
#: Policies by version: the rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_positions(hashes: Column) -> Column:
    """Sorted positions (from 0) of the values that occur more than once in an array."""
    order = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))

    def marked(s: Column) -> Column:
        at = lambda k: F.get(s, k)
        twin = lambda k, other: F.coalesce(at(k)["h"] == at(other)["h"], F.lit(False))
        return F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(twin(k, k - 1) | twin(k, k + 1), at(k)["i"]))

    return F.sort_array(F.array_compact(_let(order, marked)))


def covered(starts: Column, length: int) -> Column:
    """How many positions the windows of ``length`` from these sorted starts cover."""
    add = lambda a, x: F.struct((x + length).alias("end"), (a["total"] + x + length - F.greatest(x, a["end"])).alias("total"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), add, lambda a: a["total"])


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and without the text."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [c for c in df.columns if c != text and c not in names]
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(BREAKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{BREAK}+", -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BREAKS)) != "")
    out = df.select(
        *keep,
        words.alias("__words"),
        lines.alias("__lines"),
        F.length(F.regexp_replace(t, f"{BREAK}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    word = lambda i: F.get(F.col("__words"), i)
    windows = F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*(word(i + k) for k in range(WINDOW)))))
    out = out.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("__windows"),
    )
    again = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), covered(repeated_positions(F.col("__windows")), WINDOW)).otherwise(0)
    return out.select(*keep, *names[:5], again.cast("long").alias("n_repeat_words"))


def ledger(df: DataFrame, text: str = "text", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The measurements and ``failed``, a long whose bit i is set if rule i fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(df, text).withColumn("failed", failed)


def write_ledger(df: DataFrame, text: str = "text", rules: tuple[tuple[str, str], ...] = RULES, path: str | None = None) -> DataFrame:
    """The ledger, written (to the shared folder, if no path is given) and read back: what policies and ablations work on."""
    entries = ledger(df, text, rules)
    path = path or new_path(df.sparkSession, "ledger")
    entries.write.parquet(path)
    return df.sparkSession.read.schema(entries.schema).parquet(path)


def mask(policy: str | tuple[str, ...], rules: tuple[tuple[str, str], ...] = RULES) -> int:
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << i for i, (name, _) in enumerate(rules) if name in chosen)


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The ledger's rows with ``kept``."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def ablation(entries: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """A row a rule of the policy: rule, failed (documents), only (dropped by no other rule), kept_without (kept if the rule is left out)."""
    return ablations(entries, {"": POLICIES[policy] if isinstance(policy, str) else policy}, rules).drop("version")


def ablations(entries: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The ablation of each policy, in one aggregation of the ledger's bit patterns: version, rule, failed, only, kept_without."""
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(mask(p, rules)).cast("long").alias("whole"), F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for v, p in policies.items() for i, (name, _) in enumerate(rules) if name in p))
    rows = patterns.select("failed", "n", F.explode(names).alias("r")).select("n", "r.*", F.col("failed").bitwiseAND(F.col("r.whole")).alias("bits"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    has, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return rows.groupBy("version", "rule").agg(total(has).alias("failed"), total(has & (rest == 0)).alias("only"), total(rest == 0).alias("kept_without"))
