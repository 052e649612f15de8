"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; its failure is one bit of ``fail_bits``
and what it measured stays beside it. Policies are versioned masks over these bits,
so verdicts and ablations are bitwise operations on the ledger, not new scans of text.

Everything is a DataFrame expression inside one projection: no shuffle, no Python.
Null texts have no words. Repeated rows are judged alike, each on its own. Empty
tables give empty ledgers. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Rules in the order of their bits: (name, condition on the measures m under which a document fails).
RULES = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 2 * m["n_symbols"] > m["n_words"]),
    ("dup_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
)

# Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "dup_lines", "short_words", "long_words"),
}


def words_of(text: Column) -> Column:
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPLIT)))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice in the list.

    Windows are sorted by their words; equal neighbours are repeats; the starts that
    repeat, in order, cover three words each, less what the next one covers.
    """
    def count(w):
        at = F.sequence(F.lit(0), F.size(w) - 3)
        windows = F.transform(at, lambda i: F.struct(F.get(w, i).alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.alias("i")))
        same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])

        def repeats(s):
            near = lambda x, k: F.coalesce(same(x, F.get(s, k)), F.lit(False))
            return F.transform(F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"])
        starts = F.sort_array(let(F.sort_array(windows), repeats))
        cover = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(starts, cover))
    return let(words, count)


def measures(text: Column) -> Column:
    """A struct of MEASURES, each a long."""
    def of(t):
        words = words_of(t)
        lines = F.split(t, "\n", -1)
        return let(words, lambda w: let(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda ls: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )))
    return let(F.coalesce(text, F.lit("")), of)


def mask(names, rules=RULES) -> int:
    order = [n for n, _ in rules]
    return sum(1 << order.index(n) for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, MEASURES..., fail_bits): bit k is set if the document fails rules[k]."""
    m = docs.select(F.col(id_col), measures(F.col(text_col)).alias("_m"))
    return m.select(F.col(id_col), "_m.*", bits(F.col("_m"), rules).alias("fail_bits"))


def bits(m: Column, rules=RULES) -> Column:
    total = F.lit(0).cast("bigint")
    for k, (_, fails) in enumerate(rules):
        total = total.bitwiseOR(F.when(fails(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return total


def keeps(fail_bits: Column, policy: str, rules=RULES) -> Column:
    """Verdict of a policy on the failure bits."""
    return fail_bits.bitwiseAND(F.lit(mask(POLICIES[policy], rules)).cast("bigint")) == 0


def ablation(led: DataFrame, policy: str, rules=RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay without it.

    One map-side combined aggregate over the ledger; the text is not read again.
    """
    at = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules)).cast("bigint"))
    names = POLICIES[policy]
    aggs = []
    for k, name in enumerate(names):
        rest = [x for x in names if x != name]
        aggs += [F.count_if(at([name]) != 0).alias(f"failed{k}"), F.count_if((at([name]) != 0) & (at(rest) == 0)).alias(f"alone{k}"),
                 F.count_if(at(rest) == 0).alias(f"stay{k}")]
    cells = [F.struct(F.lit(n).alias("rule"), F.col(f"failed{k}").alias("failed"), F.col(f"alone{k}").alias("failed_alone"),
                      F.col(f"stay{k}").alias("kept_without")) for k, n in enumerate(names)]
    return led.agg(*aggs).select(F.inline(F.array(*cells)))


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    name = free_name(docs, "_ledger")
    led = docs.withColumn(name, let(measures(F.col(text_col)), lambda m: bits(m)))
    return led.filter(keeps(F.col(name), policy)).drop(name)
