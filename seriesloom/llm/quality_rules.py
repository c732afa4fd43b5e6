"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations are bitwise.

The ledger has, for each document, its measurements (whole numbers) and one long whose bit i says that it fails rule i. A
policy is a named and numbered set of rules, that is a mask: a document is kept when ``failures & mask`` is zero, so a new
policy, or the same one without a rule, never reads a text again. Ablations come from the histogram of the bit patterns (at
most two to the number of rules of them), which Spark sums in the map tasks first. All of it is DataFrame expressions: each
text is measured inside its row, no text is shuffled, and the work on a text of n words is n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.text import let
from seriesloom.llm.common import query, table, without

#: Blanks between words, and the symbols that are counted.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: Rules by bit: a document fails a rule when its SQL condition on the measurements holds.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "few_letters": "10 * n_letter_words < 8 * n_words",
}

#: Policies by (name, version): the rules that a kept document must not fail.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("prose", 1): ("few_words", "repeated_windows", "many_symbols"),
    ("prose", 2): tuple(RULES),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words"]


def mask(rules: tuple[str, ...] | list[str]) -> int:
    """The bits of rules; unknown names are refused."""
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def policy_mask(name: str, version: int) -> int:
    if (name, version) not in POLICIES:
        raise ValueError(f"unknown policy: {name} {version}")
    return mask(POLICIES[name, version])


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more. Windows are compared by their words; the hash only
    comes first in the order, as it tells most windows apart at once."""
    windows = F.transform(hashes, lambda h, i: F.struct(
        h.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"),
        i.alias("at")))

    def same(x, y):
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def places(s):
        seen = F.transform(s, lambda x, k: F.when(same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)), x["at"]))
        return F.sort_array(F.filter(seen, lambda p: p.isNotNull()))

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    return let(F.sort_array(windows), lambda s: let(places(s), covered))


def measured(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the measurements of each text."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    rows = df.select(*keep, F.btrim(body, F.lit(BLANKS)).alias("_sl_t"), body.alias("_sl_whole"))
    blank, nothing = r"[\x20\x09-\x0D]", F.array().cast("array<string>")
    lines = F.filter(F.split("_sl_whole", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    names = [c for c in rows.columns if c not in ("_sl_t", "_sl_whole")]
    bare = F.translate("_sl_t", BLANKS, "")
    rows = rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col("_sl_t") == "", nothing).otherwise(F.split("_sl_t", f"{blank}+")).alias("_sl_words"),
        lines.alias("_sl_lines"), F.length(bare).cast("long").alias("word_chars"),
        (F.length("_sl_t") - F.length(F.translate("_sl_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count("_sl_t", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")).cast("long")
        .alias("n_letter_words"))
    words = F.col("_sl_words")
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(
        w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.select("*", hashes.alias("_sl_hashes"))
    some = F.size(F.array_distinct("_sl_hashes")) < F.size("_sl_hashes")
    made = {
        "n_words": F.size(words), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_lines": F.size("_sl_lines"), "n_dup_lines": F.size("_sl_lines") - F.size(F.array_distinct("_sl_lines")),
        "n_repeat_words": F.when(some, _repeat_words(words, F.col("_sl_hashes"))).otherwise(F.lit(0)),
        "n_letter_words": F.col("n_letter_words")}
    return rows.select(*[F.col(f"`{c}`") for c in names], *[made[m].cast("long").alias(m) for m in MEASURES])


def failures() -> Column:
    """The bits of all rules from the measurements."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: the id, its measurements and ``failures``.

    Words are runs of anything but blanks (space, tab to carriage return). A null text counts as empty: no words, and it
    fails ``few_words`` only. Null and repeated ids stay, each row is judged by its own text; an empty table gives an empty
    ledger. Other columns of the input do not reach the ledger, whatever their names. A line counts when it has a word.
    """
    rows = measured(df, F.col(f"`{text}`"), [F.col(f"`{id}`").alias("_sl_id")])
    return rows.select(F.col("_sl_id").alias(id), *MEASURES, failures().alias("failures"))


def passes(bits: Column, rules_mask: int) -> Column:
    return bits.bitwiseAND(F.lit(rules_mask).cast("long")) == 0


def verdicts(entries: DataFrame, policies: list[tuple[str, int]]) -> DataFrame:
    """The ledger with one boolean for each policy, named like ``kept_prose_2``; clashing columns are replaced."""
    made = {f"kept_{name}_{version}": passes(F.col("failures"), policy_mask(name, version)) for name, version in policies}
    return without(entries, list(made)).withColumns(made)


def kept(df: DataFrame, policy: tuple[str, int] = ("prose", 2), text: str = "text") -> DataFrame:
    """The rows of the input that a policy keeps, with its columns; rows are judged one by one."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = measured(df, F.col(f"`{text}`"), [whole.alias("_sl_row")]).where(passes(failures(), policy_mask(*policy)))
    return rows.select(*[F.col(f"_sl_row.c{i}").alias(c) for i, c in enumerate(df.columns)])


def ablations(entries: DataFrame, policies: list[tuple[str, int]] | None = None) -> DataFrame:
    """For each policy and each of its rules: how many documents fail the rule, fail no other rule of the policy, are kept,
    and would be kept without the rule. An empty ledger gives zeros."""
    rows = [(name, version, rule, policy_mask(name, version), mask([rule]))
            for name, version in (policies or list(POLICIES)) for rule in POLICIES[name, version]]
    spark = entries.sparkSession
    asked = spark.createDataFrame(rows, "policy string, version int, rule string, mask long, bit long")
    patterns = entries.groupBy("failures").agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows
    gathered = patterns.agg(F.collect_list(F.struct("failures", "n")).alias("patterns"))
    every = asked.withColumn("_one", F.lit(1)).join(F.broadcast(gathered.withColumn("_one", F.lit(1))), "_one")

    def total(condition):
        hit = F.filter("patterns", condition)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda s, p: s + p["n"])

    m, b = F.col("mask"), F.col("bit")
    return every.select(
        "policy", "version", "rule",
        total(lambda p: p["failures"].bitwiseAND(b) != 0).alias("failed"),
        total(lambda p: p["failures"].bitwiseAND(m) == b).alias("failed_alone"),
        total(lambda p: p["failures"].bitwiseAND(m) == 0).alias("kept"),
        total(lambda p: p["failures"].bitwiseAND(m.bitwiseXOR(b)) == 0).alias("kept_without"))


@query("op13_quality_rules", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM tri WHERE n > 1)
        GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_letter_words
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * n_letter_words < 8 * n_words) AS kept,
       (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
       + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 15 * n_words)::BIGINT
       + 32 * (2 * n_dup_lines > n_lines)::BIGINT + 64 * (10 * n_letter_words < 8 * n_words)::BIGINT AS failures
FROM b
""")
def op13(spark, sf_dir):
    entries = ledger(table(spark, sf_dir, "documents"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~passes(F.col("failures"), policy_mask("base", 1))).alias("base_failed"),
                          passes(F.col("failures"), policy_mask("prose", 2)).alias("kept"), "failures")
