"""URL filters by association rules, with DataFrame functions and Spark's FP-growth only.

A URL is a set of tokens: the labels of its host, the folders of its path, whether it names a number or a page, the
names in its query. FP-growth finds the token sets that labelled URLs share often; together with a label, such a set is
a rule if its support and confidence suffice, unless the same set less one token is at least as sure. Rules are listed
under their rarest token, so a URL meets only the rules of tokens it has, and each is then tested whole.

Fixed rules (host and path) come before mined ones: the longest that fits decides.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LABELS = ("allow", "block")


class Fixed(NamedTuple):
    """A rule for a host, its subdomains and all paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


FIXED = (
    Fixed("allow", "com", "/"),
    Fixed("block", "example.com", "/en/"),
    Fixed("allow", "www.example.com", "/en/"),
    Fixed("block", "net", "/es/"),
    Fixed("block", "net", "/fr/"),
)
#: The share (and number) of labelled URLs that a rule's tokens and label need, and the share of those with its tokens
#: that have the label.
SUPPORT, LEAST, CONFIDENCE = 0.002, 3, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for a null, or without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: h:label, p:folder, p:# for digits, p:.ending, q:name."""
    some = lambda x: F.filter(x, lambda v: v != "")
    labels = F.transform(some(F.split(host, "\\.")), lambda v: F.concat(F.lit("h:"), v))
    steps = some(F.split(path, "/"))
    ending = F.filter(F.transform(steps, lambda v: F.regexp_extract(v, "(\\.[^.]+)\\z", 1)), lambda v: v != "")
    plain = F.transform(steps, lambda v: F.regexp_replace(F.regexp_replace(v, "\\.[^.]+\\z", ""), "[0-9]+", "#"))
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    names = some(F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, "^([^=]*)", 1)))
    marked = lambda kind, x: F.transform(some(x), lambda v: F.concat(F.lit(kind), v))
    return F.array_sort(F.array_distinct(F.concat(labels, marked("p:", plain), marked("p:", ending), marked("q:", names))))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, tokens."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), url.cast("string").alias("url"), host.alias("host"), path.alias("path"))
    return split.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def fixed_verdict(rules: Sequence[Fixed]) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits columns host and path; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    choose = lambda value: functools.reduce(lambda rest, r: F.when(r.fits(F.col("host"), F.col("path")), value(r)).otherwise(rest), reversed(longest), F.lit(None).cast("string"))
    return choose(lambda r: r.name), choose(lambda r: r.verdict)


def mine(labelled: DataFrame, *, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules of labelled rows (tokens, label): rule_tokens, verdict, n, confidence, rarest.

    Every row counts as often as it comes; rows without tokens or with a null label are left out. No row and no label
    gives no rule. A rule's tokens are a frequent set; n is how many rows have them and the label, and a rule with
    another of one token less, the same label and no smaller confidence is dropped. The size of the result is bounded
    by 2^(tokens of a URL) / support, whatever the number of rows.
    """
    rows = labelled.where((F.size("tokens") > 0) & F.col("label").isin(*LABELS))
    marked = rows.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("label")))).alias("items"))
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "rule_tokens array<string>, verdict string, n long, confidence double, rarest string")
    enough = (max(least, math.ceil(support * n)) - 0.5) / n  # rounding can't move it to another number of rows
    sets = stored(FPGrowth(itemsCol="items", minSupport=min(enough, 1.0)).fit(marked).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "itemsets")
    label = F.filter("items", lambda x: x.startswith("="))
    bare = sets.where(F.size(label) == 0).select(F.col("items").alias("rule_tokens"), F.col("n").alias("all"))
    told = sets.where((F.size(label) == 1) & (F.size("items") > 1)).select(F.array_except("items", label).alias("rule_tokens"), F.substring(label[0], 2, 9).alias("verdict"), "n")
    sure = told.join(bare, "rule_tokens").select("rule_tokens", "verdict", "n", (F.col("n") / F.col("all")).alias("confidence"))
    smaller = sure.select("verdict", "confidence", F.explode(F.transform("rule_tokens", lambda x: F.array_remove("rule_tokens", x))).alias("part"), "rule_tokens")
    known = sure.select("verdict", F.col("rule_tokens").alias("part"), F.col("confidence").alias("known"))
    beaten = smaller.join(known, ["verdict", "part"]).where(F.col("known") >= F.col("confidence")).select("verdict", "rule_tokens").distinct()
    kept = sure.where(F.col("confidence") >= confidence).join(beaten, ["verdict", "rule_tokens"], "left_anti")
    often = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("n").alias("often"))
    listed = kept.withColumn("token", F.explode("rule_tokens")).join(often, "token")
    return listed.groupBy("rule_tokens", "verdict", "n", "confidence").agg(F.min(F.struct("often", "token"))["token"].alias("rarest"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, verdict of every token set that a rule fits: by confidence, then n, then more tokens, then the names.

    The inverted index is the rules by their rarest token; a set meets them at its tokens.
    """
    index = rules.select(F.col("rarest").alias("token"), "rule_tokens", "verdict", "n", "confidence")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("n"), -F.size("rule_tokens"), "verdict", "rule_tokens")
    return fits.groupBy("tokens").agg(F.min(order).alias("best")).select("tokens", F.col("best.verdict").alias("mined"))


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    *,
    fixed: Sequence[Fixed] = FIXED,
    default: str = "allow",
    support: float = SUPPORT,
    least: int = LEAST,
    confidence: float = CONFIDENCE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    labelled (url, label: allow or block) is what rules are mined from, each URL once for each label; without it, the
    pages' own URLs that fixed rules judge, with their verdicts. A URL that no fixed and no mined rule fits has the
    default verdict. A null URL, or one without `://`, has empty host and path; its query still counts. Null ids,
    repeated rows and very long URLs stay as they are, an empty table gives an empty result, and other columns of pages
    are left out, whatever their names. Equal token sets are matched once, so that copies of a URL cost a join's row.
    """
    name, verdict = fixed_verdict(fixed)
    rows = stored(parsed(pages, id_col, url_col).select("*", name.alias("rule"), verdict.alias("verdict")), "urls")
    if labelled is None:
        told = rows.where("verdict is not null").select("url", F.col("verdict").alias("label"), "tokens").distinct()
    else:
        own = parsed(labelled.select(F.lit(None).cast("long").alias("page_id"), F.col("url"), F.col("label")), "page_id", "url").select("url", "tokens")
        told = labelled.select("url", "label").distinct().join(own.distinct(), "url")
    rules = stored(mine(told, support=support, least=least, confidence=confidence), "url-rules")
    left = rows.where("verdict is null")
    found = stored(match(left.select("tokens").distinct(), rules), "url-verdicts")
    mined = left.join(found, "tokens", "left").withColumn("verdict", F.coalesce("mined", F.lit(default)))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return rows.where("verdict is not null").select(columns).unionAll(mined.select(columns))
