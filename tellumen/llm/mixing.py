"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A token budget goes down the tree: at each node it is shared among the
children by weight, no child gets more than its subtree holds (tokens times epochs), and what a child cannot take
goes to its siblings; only what all siblings cannot take is missing from the parent's own share, which the
parent's siblings have then received, because a parent's capacity bounds its share in the same way one level up.
The sharing has a closed form: sorted by capacity per weight, the saturated children are a prefix.
A leaf's documents are ordered in seeded epochs (an md5 order for each epoch); the leaf takes the longest prefix
within its budget. Prefix sums are made in two levels (by order bucket, then inside buckets), so that a leaf with
a third of all rows is never sorted in one task.

Defined results: null text has no tokens and costs nothing, so that a leaf without tokens is taken in all epochs; null lang or source is 'unknown'; sources without
digits are in domain 'other'; repeated rows are ranked by doc_id, then tokens; null doc_ids share one place in each
epoch's order and are ranked by tokens there, in one task; children of weight 0 get nothing; a text's length does
not matter beyond its tokens; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellumen.llm.common import table, written

SEED, EPOCHS, SHARE = 42, 2, 0.9
#: Target weights: domains by number, languages by name, sources alike.
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]{1,15}", 0)
    return F.when(digits == "", "other").otherwise(F.concat(F.lit("domain"), (F.try_to_number(digits, F.lit("9" * 15)).cast("long") % 4).cast("string")))


def default_weight(level: str) -> Column:
    if level == "domain":
        n = F.regexp_extract("domain", "([0-3])$", 1)
        return F.when(n == "", 1.0).otherwise(F.ascii(n) - 47.0)
    if level == "lang":
        out = F.lit(1.0)
        for k, v in LANG_WEIGHTS.items():
            out = F.when(F.col("lang") == k, float(v)).otherwise(out)
        return out
    return F.lit(1.0)


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: parent columns, name, budget (the parent's), w, cap. Adds `alloc`."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    children = children.filter("w > 0").withColumn("ratio", F.col("cap") / F.col("w"))
    up = by.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    down = by.orderBy("ratio", name).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down)
    children = children.withColumn("full", F.col("ratio") <= level)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(by)
    rest = F.col("w") * ((F.col("budget") - taken) / open_w)
    return children.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(rest)).drop("ratio", "full")


def budgets(leaves: DataFrame, total: Column, weight=default_weight) -> DataFrame:
    """leaves: domain, lang, source, cap (double). Returns leaves with `leaf_budget` (long)."""
    at = None
    for k, name in enumerate(LEVELS):
        parent = list(LEVELS[:k])
        nodes = leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(at, parent) if parent else nodes.crossJoin(F.broadcast(leaves.agg(total.alias("budget"))))
        at = share(nodes.withColumn("w", weight(name)), parent, name).select(*LEVELS[: k + 1], F.col("alloc").alias("budget"))
    return at.select(*LEVELS, F.floor("budget").cast("long").alias("leaf_budget"))


def mix_sources(docs: DataFrame, seed: int = SEED, epochs: int = EPOCHS, portion: float = SHARE, bucket_rows: int = 4096, weight=default_weight) -> DataFrame:
    """doc_id, th (the text's hash), epoch, domain, lang, source, tokens, cum_tokens, leaf_budget: one row per document
    and epoch taken. weight: a level's name -> the target weight of its nodes, a column over the node's columns."""
    src = F.coalesce("source", F.lit("unknown"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        src.alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long").alias("tokens"),
    )
    rows = written(rows, "mix-tokens")
    leaf = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_docs")).withColumn("cap", F.col("leaf_tokens") * float(epochs))
    plan = budgets(leaf, F.floor(F.sum("leaf_tokens") * portion).cast("double"), weight)
    leaf = written(leaf.join(plan, list(LEVELS)).withColumn("buckets", F.floor(F.col("leaf_docs") / bucket_rows) + 1).drop("cap"), "mix-leaves")
    # Only epochs that the budget reaches into are laid out.
    need = F.when(F.col("leaf_tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("leaf_budget") / F.col("leaf_tokens")).cast("int") + 1)).otherwise(epochs)
    one = rows.join(leaf, list(LEVELS)).withColumn("epoch", F.explode(F.sequence(F.lit(0), need - 1)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    one = one.withColumn("u", F.conv(F.substring(key, 1, 13), 16, 10).cast("long"))
    one = one.withColumn("bucket", F.floor(F.col("u") / F.lit(float(2**52)) * F.col("buckets")).cast("long"))
    place = [*LEVELS, "epoch", "bucket"]
    sums = one.groupBy(*place).agg(F.sum("tokens").alias("bt"))
    before = F.coalesce(F.sum("bt").over(Window.partitionBy(*LEVELS).orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).drop("bt")
    inside = F.sum("tokens").over(Window.partitionBy(*place).orderBy("u", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("inside", inside).join(sums, place).withColumn("cum_tokens", F.col("before") + F.col("inside"))
    return one.filter("cum_tokens <= leaf_budget").select("doc_id", "th", "epoch", *LEVELS, "tokens", "cum_tokens", "leaf_budget")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("th")


def _level_sql(k: int) -> str:
    name, cols = LEVELS[k], ", ".join(LEVELS[: k + 1])
    parent = ", ".join(LEVELS[:k]) or "1"
    w = {"domain": "CASE WHEN right(domain, 1) IN ('0','1','2','3') THEN ascii(right(domain, 1)) - 47.0 ELSE 1.0 END::DOUBLE", "lang": "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::DOUBLE", "source": "1::DOUBLE"}[name]
    up = f"PARTITION BY {parent} ORDER BY ratio, {name} ROWS BETWEEN"
    join = "JOIN a{0} USING ({1})".format(k - 1, ", ".join(LEVELS[:k])) if k else "CROSS JOIN root"
    return f"""
n{k} AS (SELECT *, cap / w AS ratio FROM (SELECT {cols}, sum(cap) AS cap, {w} AS w FROM leaf GROUP BY ALL) {join}),
f{k} AS (SELECT *, ratio <= (budget - coalesce(sum(cap) OVER ({up} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({up} CURRENT ROW AND UNBOUNDED FOLLOWING) AS sat FROM n{k}),
a{k} AS (SELECT {cols}, CASE WHEN sat THEN cap ELSE w * ((budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER (PARTITION BY {parent}), 0)) / sum(CASE WHEN NOT sat THEN w END) OVER (PARTITION BY {parent})) END AS budget FROM f{k})"""


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '[0-9]{{1,15}}') = '' THEN 'other'
      ELSE 'domain' || (regexp_extract(source, '[0-9]{{1,15}}')::BIGINT % 4) END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS leaf_tokens, sum(tokens)::DOUBLE * {EPOCHS} AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(leaf_tokens) * {SHARE}::DOUBLE) AS budget FROM leaf),
{_level_sql(0)},{_level_sql(1)},{_level_sql(2)},
o AS (SELECT d.*, e.epoch, floor(a2.budget)::BIGINT AS leaf_budget,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY e.epoch, ('0x' || substr(md5('{SEED}|' || e.epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT, doc_id, tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_tokens
  FROM d JOIN a2 USING (domain, lang, source) CROSS JOIN (SELECT unnest(range({EPOCHS}))::INTEGER AS epoch) e)
SELECT doc_id, epoch, domain, lang, source, tokens, cum_tokens, leaf_budget FROM o WHERE cum_tokens <= leaf_budget
"""
