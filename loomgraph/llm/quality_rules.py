"""Quality rules as a bitmask ledger, with DataFrame functions only.

ledger() evaluates every rule once for each document and keeps the measurements and one bit for each rule that failed.
A policy is a named, versioned set of rules; applying one is a bitwise and, and so is asking what each rule costs
(ablation): no text is read again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5



def rules() -> dict[str, Column]:
    """Rule names in bit order, and when a document fails them."""
    return {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": F.col("n_symbols") > 0.5 * F.col("n_words"),
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "long_words": F.col("word_chars") > 25 * F.col("n_words"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
    }


BASE = ("few_words", "repeated_words")
#: Policies by name and version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "strict-1": (*BASE, "symbols", "repeated_lines", "long_words", "short_words"),
}


def mask(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(x) for x in names)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(**columns: Column) -> Column:
    """The columns as a generator of one row: a later filter on them is not moved below and computed again."""
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words that the text has twice or more.

    Windows are 64-bit hashes. If all differ, that is all. Otherwise they are sorted with their places; those equal to
    a neighbour are repeated, and each repeated window adds the words up to the next one's start.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j, d: F.coalesce(F.get(s, j + d)["h"] == x["h"], F.lit(False))
        twice = _let(ordered, lambda s: F.filter(s, lambda x, j: F.when(j > 0, same(s, x, j, -1)).otherwise(False) | same(s, x, j, 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    covered = lambda h: _let(
        places(h), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    )
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words for every row; a null text has none.

    carry: and the row itself, as the struct `row`.
    """
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    also = ["row"] if carry else []
    text = F.col("text")
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACES}]")))
    return (
        docs.select(*row, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .select(*also, "doc_id", _once(words=words, lines=lines, n_symbols=(F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")))
        .select(
            *also,
            "doc_id",
            _once(
                n_words=F.size("words").cast("long"),
                word_chars=F.char_length(F.array_join("words", "")).cast("long"),
                n_symbols=F.col("n_symbols"),
                n_lines=F.size("lines").cast("long"),
                n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
                n_repeat_words=_repeated(F.col("words")),
            ),
        )
    )


def ledger(docs: DataFrame, **columns) -> DataFrame:
    """The measurements and `failures`, the bits of the rules that failed, for every row, without a shuffle.

    A null text counts as empty; null ids and repeated rows stay as they are, an empty table gives an empty result, and
    other columns of docs are left out, whatever their names. A very long text is measured whole, in its row.
    """
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(rules().values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, **columns).withColumn("failures", total)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """With `kept`: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def kept_rows(docs: DataFrame, policy: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, that pass the policy; of repeated rows all or none.

    A null text counts as empty; rows with null ids stay or go by their text; a very long text is measured whole; an
    empty table gives an empty result.
    """
    return apply_policy(ledger(docs, id_col=id_col, text_col=text_col, carry=True), policy).filter("kept").select("row.*")


def ablation(book: DataFrame, policies: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule of it: rows, rejected (by the policy), failed (the rule), only_this (kept but for it).

    The ledger is first counted by its bits, so at most 2^rules rows meet the policies, whatever the input. Every row
    of the ledger counts, those of null ids and texts and repeated ones too; an empty ledger gives an empty result; no
    text is read, so long ones cost nothing, and other columns of the ledger don't matter.
    """
    patterns = book.groupBy("failures").agg(F.count("*").alias("n"))
    plans = []
    for name, chosen in (policies or POLICIES).items():
        whole = mask(tuple(chosen))
        plans += [F.struct(F.lit(name).alias("policy"), F.lit(rule).alias("rule"), F.lit(whole).alias("whole"), F.lit(mask((rule,))).alias("bit")) for rule in chosen]
    rows = patterns.select("failures", "n", F.explode(F.array(*plans)).alias("p")).select("failures", "n", "p.*")
    hit = F.col("failures").bitwiseAND(F.col("whole"))
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    return rows.groupBy("policy", "rule").agg(F.sum("n").alias("rows"), count(hit != 0, "rejected"), count(F.col("failures").bitwiseAND(F.col("bit")) != 0, "failed"), count(hit == F.col("bit"), "only_this"))
