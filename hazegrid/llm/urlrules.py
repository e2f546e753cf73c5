"""URL filtering by association rules.

Frequent combinations of URL tokens are mined with Spark's FP-growth from
labelled pages, for each kind of label apart; a combination with which the label
``block`` is more frequent than by chance becomes a rule.  Rules are kept in an inverted
index under their rarest token, so a token that nearly every address has brings
up a rule only if the rule has nothing rarer.  Stated host and path rules come
before the mined ones.

Everything runs inside Spark's own functions and its FP-growth; no Python code
touches a row.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

MIN_LIFT = 1.5
#: a combination needs so many blocked pages, whatever their share
MIN_ROWS = 20
#: chance that labels which do not depend on the address give any rule at all
ALPHA = 0.05
BLOCK = "block"
ALLOW = "allow"
_LABEL = "label="


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path in one string) and verdict of the longest of the ``rules`` that fits, else NULL.

    A rule (verdict, host, path) fits its host and all subdomains if the path
    starts with the rule's.  Equally long rules count in the order given.
    """
    label = verdict = F
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        label, verdict = label.when(fits, rule_host + rule_path), verdict.when(fits, what)
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return label.otherwise(None), verdict.otherwise(None)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of an address: host labels and words, path parts, names in the query, a fragment.

    Numbers become ``<n>``; a NULL address has no tokens.
    """
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)

    def parts(text: Column, cut: str, mark: str) -> Column:
        clean = F.regexp_replace(F.lower(text), r"\d+", "<n>")
        return F.transform(F.filter(F.split(clean, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("query:"), F.lower(F.split_part(x, F.lit("="), F.lit(1)))))
    fragment = F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("fragment"))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        parts(host, r"\.", "host:"), parts(host, r"[.-]", "word:"), parts(path, r"[/.]", "path:"), names, fragment))


def mine_rules(labelled: DataFrame, min_rows: int = MIN_ROWS, min_lift: float = MIN_LIFT,
               alpha: float = ALPHA) -> DataFrame:
    """Rules from ``labelled`` (``tokens``, ``label``): ``rule_tokens``, ``confidence``, ``lift``, ``support``.

    A combination on ``min_rows`` blocked pages is a rule if ``block`` is
    ``min_lift`` times as frequent with it as on all labelled pages and the
    Chernoff bound on the chance of that, times the number of combinations
    tried, is at most ``alpha``.  One of whose parts alone predicts it as well is
    dropped.  Rows without label or tokens are passed over; without any blocked
    row there are no rules.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where("label IS NOT NULL AND size(tokens) > 0").select("tokens", "label"), "baskets")
    total, blocked = rows.agg(F.count("*"), F.count_if(F.col("label") == BLOCK)).first()
    if blocked < min_rows:
        return spark.createDataFrame([], "rule_tokens array<string>, confidence double, lift double, support double")
    # tokens of every page say nothing; the others are few enough to name, for each page has some of them
    everywhere = [r["token"] for r in rows.select(F.explode("tokens").alias("token")).groupBy("token").count().where(
        F.col("count") == total).select("token").collect()]
    items = F.array_except("tokens", F.array(*[F.lit(t) for t in everywhere]).cast("array<string>"))
    baskets = rows.select(F.when(F.col("label") == BLOCK, F.array_append(items, F.lit(_LABEL + BLOCK))).otherwise(
        items).alias("items")).where("size(items) > 0")
    # each partition grows the trees of its own items; the table of baskets alone may have few
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / baskets.count(), numPartitions=parts).fit(baskets)
    is_label = F.array_contains("items", _LABEL + BLOCK)
    sets = stored(model.freqItemsets.select(
        F.sort_array(F.filter("items", lambda x: x != _LABEL + BLOCK)).alias("rule_tokens"), "freq", is_label.alias("_hit")
    ).where("size(rule_tokens) > 0"), "itemsets")
    tried = sets.where("_hit").select("rule_tokens", F.col("freq").alias("_k")).join(
        sets.where("NOT _hit").select("rule_tokens", F.col("freq").alias("_n")), "rule_tokens")
    m = sets.where("_hit").count()
    base = blocked / total
    c = F.col("_k") / F.col("_n")
    rest = F.when(c < 1, (1 - c) * F.log((1 - c) / F.lit(max(1 - base, 1e-300)))).otherwise(0.0)
    gain = F.col("_n") * (c * F.log(c / F.lit(base)) + rest)
    found = tried.where((c / F.lit(base) >= min_lift) & (gain >= F.lit(math.log(max(m, 1) / alpha)))).select(
        "rule_tokens", c.alias("confidence"), (c / F.lit(base)).alias("lift"), (F.col("_k") / F.lit(total)).alias("support"))
    rules = stored(found, "rules")
    # a rule is redundant beside one with a token less and no less confidence
    shorter = rules.select(F.col("rule_tokens").alias("_part"), F.col("confidence").alias("_c"))
    parts = rules.where(F.size("rule_tokens") > 1).select("rule_tokens", "confidence", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("rule_tokens")),
        lambda i: F.filter("rule_tokens", lambda x, k: k != i - 1))).alias("_part"))
    redundant = parts.join(shorter, "_part").where("_c >= confidence").select("rule_tokens").distinct()
    return rules.join(redundant, "rule_tokens", "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best mined rule of each distinct ``tokens``: ``tokens``, ``rule_tokens``, ``confidence``.

    Candidates come from an inverted index: each rule stands under the one of its
    tokens that the fewest token sets have; ties go to the first in order.
    """
    sets = token_sets.where("size(tokens) > 0").select("tokens").distinct()
    words = sets.select("tokens", F.explode("tokens").alias("token"))
    often = words.groupBy("token").count()
    index = (
        rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("token")).join(often, "token")
        .groupBy("rule_tokens", "confidence").agg(F.min(F.struct("count", "token")).alias("_rarest"))
        .select("rule_tokens", "confidence", F.col("_rarest.token").alias("token"))
    )
    hits = words.join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.transform("rule_tokens", lambda x: x).alias("rule_tokens")))
    return hits.groupBy("tokens").agg(best.alias("_b")).select("tokens", "_b.rule_tokens", "_b.confidence")


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]],
          kinds: Sequence[str] = (), min_rows: int = MIN_ROWS, alpha: float = ALPHA) -> DataFrame:
    """Verdict on every row of ``pages`` (``page_id``, ``url``).

    ``labelled`` holds ``url`` and ``label`` (``block`` or ``allow``), and may hold
    a ``kind`` of label out of ``kinds``; rules are mined for each kind apart.  Returns
    ``page_id``, ``host``, ``path``, ``rule`` (the stated rule that decided, else
    NULL), ``verdict``, ``mined`` (tokens of the mined rule that applied, else
    NULL).  A stated rule decides first; else a mined rule blocks; else the page
    is allowed.  NULL addresses and such without ``://`` have empty host and
    path and are allowed.  Repeated rows each get their verdict.
    """
    at = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                      tokens_of(F.col("url")).alias("tokens"))
    apart = [labelled.where(F.col("kind") == k) for k in kinds] or [labelled]
    mined = [mine_rules(one.select(tokens_of(F.col("url")).alias("tokens"), "label"), min_rows, alpha=alpha / len(apart))
             for one in apart]
    matched = match_rules(at, stored(reduce(DataFrame.union, mined), "mined"))
    label, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    return at.join(matched, "tokens", "left").select(
        "page_id", "host", "path", label.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rule_tokens").isNotNull(), BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.concat_ws(" ", "rule_tokens").alias("_m"), F.col("rule_tokens").isNotNull().alias("_has"),
    ).select("page_id", "host", "path", "rule", "verdict", F.when(F.col("_has"), F.col("_m")).alias("mined"))
