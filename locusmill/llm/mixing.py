"""Mixing sources to target weights by hierarchical budgets (operator 10, DataFrame functions only).

A tree of levels, here domain, language and source, holds the documents in its leaves. The
budget of the root flows down: a node's children share its budget in proportion to their
weights, no child beyond its capacity (the tokens below it times ``max_epochs``), and what
a short child leaves goes to its siblings; only what a whole subtree can't take reaches
the siblings of its ancestors. All sums are whole tokens, rounded down.

A leaf's budget is ``full`` whole epochs and a rest. The last epoch has an order of its own,
by md5 of seed, epoch, doc_id and text, and the rest takes the longest prefix of documents
that fits. The prefix is found by sums over the first two, then four hexadecimal digits of the
order key, and only documents that share all four with the boundary are ranked, so a leaf
with a third of all rows meets no single task.

Defined cases: null and empty texts hold no token and are never chosen; a null in a level
is a value of its own; a null doc_id orders as an empty one; only rows of equal doc_id and
text tie, and each is a document; an empty table gives an empty result; further columns of
any name pass through ``mix_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Four domains by the number that ends a source's name; the documents name none themselves."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "d-").otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


@dataclass(frozen=True)
class MixParams:
    """``share``: budget of the root in percent of all tokens. Weights: whole numbers; 1 where none is given."""

    seed: int = 17
    share: int = 60
    max_epochs: int = 2
    weights: tuple[dict[str, int], ...] = field(default=({"d0": 3, "d1": 3, "d2": 2, "d3": 2}, {"en": 5, "fr": 2, "de": 2, "es": 1}, {"src0": 2}))


def _weight(level: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(level == value, F.lit(w)).otherwise(out)
    return out.cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _share_out(children: DataFrame, parents: list[str], own: str, weights: dict[str, int]) -> DataFrame:
    """children (parents..., own, capacity, budget of the parent) -> with the child's budget.

    Children are sorted by capacity for each unit of weight; those filled to capacity are a
    prefix of that order, and the rest share what the prefix leaves.
    """
    c = children.withColumn("w", _weight(F.col(own), weights)).withColumn("ratio", F.col("capacity").cast("double") / F.col("w"))
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy("ratio", F.asc_nulls_first(own))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = c.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("left", F.sum("w").over(after))
    c = c.withColumn("full", _wide(F.col("capacity")) * _wide(F.col("left")) <= _wide(F.col("w")) * _wide(F.col("budget") - F.col("used")))
    c = c.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)))
    c = c.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(group), F.lit(1)))
    part = F.expr("cast(cast(w as decimal(19,0)) * cast(greatest(rest, 0) as decimal(19,0)) div cast(open as decimal(19,0)) as bigint)")
    return c.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part)).select(*parents, own, "capacity", "budget")


def leaf_budgets(leaves: DataFrame, levels: list[str], params: MixParams) -> DataFrame:
    """leaves (levels..., tokens) -> levels..., tokens, budget."""
    sums = leaves.withColumn("capacity", F.col("tokens") * params.max_epochs)
    above = None
    for depth in range(len(levels)):
        path = levels[: depth + 1]
        nodes = sums.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if above is None:
            everything = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumn("budget", F.expr(f"{params.share} * sum(tokens) over (partition by 0) div 100"))
        else:
            same = [nodes[c].eqNullSafe(above[c]) for c in levels[:depth]]
            on = same[0]
            for s in same[1:]:
                on = on & s
            nodes = nodes.join(above, on).select(*[nodes[c] for c in path], nodes["capacity"], above["budget"])
        above = _share_out(nodes, levels[:depth], levels[depth], params.weights[depth] if depth < len(params.weights) else {})
    above = above.select(*[F.col(c).alias(f"b_{c}") for c in levels], "budget")
    on = F.lit(True)
    for c in levels:
        on = on & leaves[c].eqNullSafe(above[f"b_{c}"])
    return leaves.join(above, on).select(*levels, "tokens", "budget")


def _prefix(sums: DataFrame, digits: str, taken: str) -> DataFrame:
    """The first value of ``digits`` in each leaf where the running sum passes the rest, and the sum before it."""
    w = Window.partitionBy("_leaf").orderBy(digits)
    run = sums.withColumn("run", F.sum("t").over(w)).filter(F.col(taken) + F.col("run") > F.col("_rest"))
    first = run.groupBy("_leaf").agg(F.min(F.struct(digits, F.col(taken) + F.col("run") - F.col("t"))).alias("m"))
    return first.select("_leaf", F.col(f"m.{digits}").alias(f"_at{digits}"), F.col("m.col2").alias(f"_sum{digits}"))


def _leaf_name(levels: list[Column]) -> Column:
    """One string for a path; null differs from every value."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in levels])


def _identity(doc_id: Column, text: Column) -> Column:
    """What orders a row in its leaf, besides the epoch: equal only for rows of equal doc_id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def _limits(base: DataFrame, names: list[str], params: MixParams) -> DataFrame:
    """One row a leaf: whole epochs, the rest of the last one, and the digits and sum where the rest's prefix ends."""
    leaves = base.groupBy("_leaf", *names).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves.drop("_leaf"), names, params).withColumn("_leaf", _leaf_name([F.col(c) for c in names]))
    plan = materialise(plan.select("_leaf", F.expr("budget div tokens").alias("_full"), F.expr("budget % tokens").alias("_rest")), "mix-plan")
    keyed = materialise(_keyed(base.select("_leaf", "_id", "n_tokens"), plan, params), "mix-keyed")
    sums = keyed.groupBy("_leaf", "_rest", "_2").agg(F.sum("n_tokens").alias("t")).withColumn("_none", F.lit(0).cast("long"))
    first = materialise(_prefix(sums, "_2", "_none"), "mix-first")
    inside = keyed.join(first, "_leaf").filter(F.col("_2") == F.col("_at_2"))
    fine = inside.groupBy("_leaf", "_rest", "_4", "_sum_2").agg(F.sum("n_tokens").alias("t"))
    return materialise(plan.join(_prefix(fine, "_4", "_sum_2"), "_leaf", "left"), "mix-limits")


def _keyed(rows: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(params.seed)), F.col("_full").cast("string"), F.col("_id")))
    return rows.join(plan, "_leaf").withColumn("_key", key).withColumn("_2", F.substring("_key", 1, 2)).withColumn("_4", F.substring("_key", 1, 4))


def _copies(keyed: DataFrame, out: list[str], n_tokens: Column, ties: list[Column]) -> DataFrame:
    """Rows out... with copies: by comparison of digits, and by rank for those that share the boundary's."""
    clear = keyed.filter(F.col("_at_4").isNull() | (F.col("_4") != F.col("_at_4")))
    clear = clear.withColumn("copies", F.col("_full") + F.coalesce(F.col("_4") < F.col("_at_4"), F.lit(False)).cast("int"))
    w = Window.partitionBy("_leaf", "_4").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = keyed.filter(F.col("_4") == F.col("_at_4")).withColumn("_run", F.sum(n_tokens).over(w))
    edge = edge.withColumn("copies", F.col("_full") + (F.col("_sum_4") + F.col("_run") <= F.col("_rest")).cast("int"))
    done = [*out, F.col("copies").cast("int").alias("copies")]
    return clear.select(*done).unionByName(edge.select(*done)).filter("copies > 0")


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _base(docs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    base = docs.select("doc_id", *[levels[c].alias(c) for c in levels], _tokens(F.col("text")).alias("n_tokens"), _identity(F.col("doc_id"), F.col("text")).alias("_id")).filter("n_tokens > 0")
    return materialise(base.withColumn("_leaf", _leaf_name([F.col(c) for c in levels])), "mix-docs")


def choose(docs: DataFrame, levels: dict[str, Column], params: MixParams = MixParams()) -> DataFrame:
    """Rows (doc_id, levels..., n_tokens, copies) of all documents that the budgets choose."""
    base = _base(docs, levels)
    keyed = _keyed(base, _limits(base, list(levels), params), params)
    return _copies(keyed, ["doc_id", *levels, "n_tokens"], F.col("n_tokens"), [])


def document_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source").cast("string")), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The chosen documents with their own columns, a row for each copy.

    A row's copies follow from its own key and its leaf's limits, so no text is shuffled but
    those of the few rows at the boundary of a leaf's prefix.
    """
    levels = document_levels()
    limits = _limits(_base(docs, levels), list(levels), params)
    rows = docs.filter(F.col("text").rlike(WORD)).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _leaf_name(list(levels.values())).alias("_leaf"), _identity(F.col("doc_id"), F.col("text")).alias("_id"))
    chosen = _copies(_keyed(rows, limits, params), ["row"], _tokens(F.col("row.text")), [F.xxhash64("row")])
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op10_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return choose(docs, document_levels())


def _share_sql(source: str, name: str, parents: list[str], own: str, weights: dict[str, int]) -> str:
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
{name}_a AS (SELECT *, CASE {own} {case} ELSE 1 END AS w FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY capacity::DOUBLE / w, {own} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER ({part} ORDER BY capacity::DOUBLE / w, {own} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM {name}_a),
{name}_c AS (SELECT *, capacity::HUGEINT * lft <= w * (budget::HUGEINT - used) AS is_full FROM {name}_b),
{name}_d AS (SELECT *, greatest(budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({part}), 0), 0) AS rest, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({part}), 1) AS opn FROM {name}_c),
{name} AS (SELECT {', '.join([*parents, own])}, capacity, (CASE WHEN is_full THEN capacity ELSE (w * rest::HUGEINT) // opn END)::BIGINT AS budget FROM {name}_d)"""


def _sql(p: MixParams = MixParams()) -> str:
    w = p.weights
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'd-' ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4) END AS domain,
  lang, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
docs AS (SELECT * FROM d WHERE n_tokens > 0),
n1 AS (SELECT domain, sum(n_tokens) * {p.max_epochs} AS capacity, ({p.share} * sum(sum(n_tokens)) OVER ()) // 100 AS budget FROM docs GROUP BY domain),
{_share_sql('n1', 's1', [], 'domain', w[0])},
n2 AS (SELECT domain, lang, sum(n_tokens) * {p.max_epochs} AS capacity, any_value(s1.budget) AS budget FROM docs JOIN s1 USING (domain) GROUP BY domain, lang),
{_share_sql('n2', 's2', ['domain'], 'lang', w[1])},
n3 AS (SELECT docs.domain, docs.lang, source, sum(n_tokens) * {p.max_epochs} AS capacity, any_value(s2.budget) AS budget
  FROM docs JOIN s2 ON docs.domain = s2.domain AND docs.lang IS NOT DISTINCT FROM s2.lang GROUP BY docs.domain, docs.lang, source),
{_share_sql('n3', 's3', ['domain', 'lang'], 'source', w[2])},
plan AS (SELECT domain, lang, source, budget // (capacity // {p.max_epochs}) AS whole, budget % (capacity // {p.max_epochs}) AS rest FROM s3),
k AS (SELECT docs.*, whole, rest, md5('{p.seed}:' || whole::BIGINT || ':' || id) AS ord FROM docs JOIN plan
  ON docs.domain = plan.domain AND docs.lang IS NOT DISTINCT FROM plan.lang AND docs.source IS NOT DISTINCT FROM plan.source),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + CASE WHEN run <= rest THEN 1 ELSE 0 END)::INTEGER AS copies
FROM r WHERE whole + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0"""


OP10_SQL = _sql()
