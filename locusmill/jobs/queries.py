"""The registered queries of the association library and their SQL, over the derived study."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import align, assoc, blocked, mixed, nullmodel, variants
from ..operators.components import connected_components
from ..operators.shared import materialise, shared_dir
from ..operators.tallskinny import independent, r_factor
from ..sources.bgenindex import read_indexed, write_index
from ..sources.genotype import genotypes, write_genotypes
from ..streaming.landing import associate_stream, run_until_done
from . import cohort as C
from . import sqlforms, study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {C.SQL_VIEWS.strip()}" + (f",\n{sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"\n{sql.strip()}")) if views else sql
        return f

    return add


def r(c, digits: int = 6):
    """Rounded, without a negative zero, for comparison between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _ready(spark: SparkSession, sf: str) -> DataFrame:
    """Complete cohort: sample_id, n_orders, nation, month."""
    return C.covariates(spark, sf).dropna()


# ---- association


@query("""
WITH n AS (SELECT count(*) AS n_all FROM cov),
a AS (SELECT sample_id, n_orders, y FROM cov JOIN phe USING (sample_id) WHERE pheno = 'balance'),
fit AS (SELECT regr_slope(y, n_orders) AS b, regr_intercept(y, n_orders) AS a, count(y) AS n FROM a),
res AS (SELECT sample_id, coalesce((y - fit.a - fit.b * n_orders) * n_all / (fit.n - 2), 0) AS r FROM a, fit, n),
proj AS (SELECT variant_id, regr_slope(dosage, n_orders) AS b, regr_intercept(dosage, n_orders) AS a FROM dos JOIN cov USING (sample_id) GROUP BY variant_id),
g AS (SELECT variant_id, sample_id, dosage - a - b * n_orders AS g FROM dos JOIN cov USING (sample_id) JOIN proj USING (variant_id)),
s AS (SELECT variant_id, corr(g, r) AS rho, stddev_pop(g) AS sd_g, stddev_pop(r) AS sd_r FROM g JOIN res USING (sample_id) GROUP BY variant_id)
SELECT variant_id, round(rho * sd_r / sd_g, 3) + 0.0 AS beta,
  round(sqrt((1 - rho * rho) / (n_all - 2)) * sd_r / sd_g / sqrt(n_all::DOUBLE / (n_all - 1)), 3) + 0.0 AS se,
  round(rho / sqrt((1 - rho * rho) / (n_all - 2)) * sqrt(n_all::DOUBLE / (n_all - 1)), 5) + 0.0 AS t FROM s, n""")
def assoc_simple(spark, sf):
    """One trait, one covariate, unrelated samples: aggregates and joins only."""
    cov = C.covariates(spark, sf).select("sample_id", "n_orders")
    y = C.phenotypes(spark, sf).filter("pheno = 'balance'").select("sample_id", "y")
    a = cov.join(y, "sample_id")
    fit = a.agg(F.regr_slope("y", "n_orders").alias("b"), F.regr_intercept("y", "n_orders").alias("a"), F.count("y").alias("n"), F.count("*").alias("n_all"))
    res = a.join(F.broadcast(fit)).select("sample_id", "n_orders", "n_all", F.coalesce((F.col("y") - F.col("a") - F.col("b") * F.col("n_orders")) * F.col("n_all") / (F.col("n") - 2), F.lit(0.0)).alias("r"))
    d = C.dosages(spark, sf).select("variant_id", "sample_id", "dosage").join(res, "sample_id")
    # residualising by one covariate needs only sums of products, so one aggregation does both regressions
    s = d.groupBy("variant_id").agg(
        F.covar_pop("dosage", "r").alias("gr"), F.covar_pop("dosage", "n_orders").alias("gx"), F.covar_pop("r", "n_orders").alias("rx"),
        F.var_pop("n_orders").alias("xx"), F.var_pop("dosage").alias("gg"), F.var_pop("r").alias("rr"), F.max("n_all").alias("n"),
    )
    s = s.withColumn("vg", F.col("gg") - F.col("gx") ** 2 / F.col("xx")).withColumn("cov", F.col("gr") - F.col("gx") * F.col("rx") / F.col("xx"))
    rho, c2 = F.col("cov") / F.sqrt(F.col("vg") * F.col("rr")), F.col("n") / (F.col("n") - 1)
    beta = F.col("cov") / F.col("vg")
    se = F.sqrt((1 - rho * rho) / (F.col("n") - 2)) * F.sqrt(F.col("rr") / F.col("vg")) / F.sqrt(c2)
    return s.select("variant_id", r(beta, 3).alias("beta"), r(se, 3).alias("se"), r(beta / se, 5).alias("t"))


def _geno(spark, sf) -> DataFrame:
    return assoc.dosage_arrays(C.dosages(spark, sf))


def _traits(spark, sf, covariates: list[str], phenos: list[str]) -> assoc.Traits:
    samples = C.samples(spark, sf).join(C.covariates(spark, sf).select("sample_id", *covariates), "sample_id")
    pheno = C.phenotypes(spark, sf).filter(F.col("pheno").isin(phenos))
    resid, c2, _ = study.fit_null(samples.select("sample_id", *covariates), pheno, covariates)
    return study.traits_of(samples, resid, c2, covariates)


_MULTI_SQL = """
WITH n AS (SELECT count(*) AS n_all FROM cov),
a AS (SELECT sample_id, pheno, n_orders, y FROM cov JOIN phe USING (sample_id) WHERE pheno IN ('balance', 'spend')),
fit AS (SELECT pheno, regr_slope(y, n_orders) AS b, regr_intercept(y, n_orders) AS a, count(y) AS n FROM a GROUP BY pheno),
res AS (SELECT sample_id, pheno, coalesce((y - fit.a - fit.b * n_orders) / s2 * n_all * s2 / (fit.n - 2), 0) AS r FROM a JOIN fit USING (pheno)
  JOIN (SELECT pheno, regr_syy(y, n_orders) * (1 - regr_r2(y, n_orders)) / (count(y) - 2) AS s2 FROM a GROUP BY pheno) USING (pheno), n),
proj AS (SELECT variant_id, regr_slope(dosage, n_orders) AS b, regr_intercept(dosage, n_orders) AS a FROM dos JOIN cov USING (sample_id) GROUP BY variant_id),
g AS (SELECT variant_id, sample_id, dosage - a - b * n_orders AS g FROM dos JOIN cov USING (sample_id) JOIN proj USING (variant_id)),
s AS (SELECT variant_id, pheno, corr(g, r) AS rho, stddev_pop(g) AS sd_g, stddev_pop(r) AS sd_r FROM g JOIN res USING (sample_id) GROUP BY variant_id, pheno)
"""


@query(_MULTI_SQL + """SELECT variant_id, pheno, round(rho * sd_r / sd_g, 3) + 0.0 AS beta, round(rho / sqrt((1 - rho * rho) / (n_all - 2)) * sqrt(n_all::DOUBLE / (n_all - 1)), 5) + 0.0 AS t FROM s, n""")
def assoc_multi(spark, sf):
    """Two traits at once by the array kernel: one matrix product a batch."""
    t = _traits(spark, sf, ["n_orders"], ["balance", "spend"])
    return assoc.associate(_geno(spark, sf), t).select("variant_id", "pheno", r("beta", 3).alias("beta"), r("t", 5).alias("t"))


@query(_MULTI_SQL + """SELECT variant_id, max(CASE WHEN pheno = 'balance' THEN round(rho * sd_r / sd_g, 3) + 0.0 END) AS "balance_BETA",
  max(CASE WHEN pheno = 'spend' THEN round(rho * sd_r / sd_g, 3) + 0.0 END) AS "spend_BETA" FROM s GROUP BY variant_id""")
def assoc_wide(spark, sf):
    """The wide result: three columns a trait, here the effects."""
    t = _traits(spark, sf, ["n_orders"], ["balance", "spend"])
    wide = assoc.widen(assoc.associate(_geno(spark, sf), t), t.names)
    return wide.select("variant_id", r("balance_BETA", 3).alias("balance_BETA"), r("spend_BETA", 3).alias("spend_BETA"))


@query(_MULTI_SQL + """SELECT variant_id, pheno, round(rho * sd_r / sd_g, 3) + 0.0 AS beta FROM s""")
def assoc_streaming(spark, sf):
    """The same results from a stream of landing Parquet files."""
    t = _traits(spark, sf, ["n_orders"], ["balance", "spend"])
    from ..operators.shared import shared_dir
    import uuid

    base = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    _geno(spark, sf).repartition(5).write.parquet(f"{base}/in")
    run_until_done(associate_stream(spark, f"{base}/in", t), f"{base}/out", f"{base}/state")
    out = spark.read.schema(assoc._LONG).parquet(f"{base}/out")
    return out.select("variant_id", "pheno", r("beta", 3).alias("beta"))


@query(_MULTI_SQL + """SELECT variant_id, pheno, round(rho * sd_r / sd_g, 3) + 0.0 AS beta, round(sqrt((1 - rho * rho) / (n_all - 2)) * sd_r / sd_g / sqrt(n_all::DOUBLE / (n_all - 1)), 3) + 0.0 AS se,
  round(rho / sqrt((1 - rho * rho) / (n_all - 2)) * sqrt(n_all::DOUBLE / (n_all - 1)), 5) + 0.0 AS t FROM s, n""")
def assoc_blocked(spark, sf):
    """Two traits by sums of sample blocks: nothing of the size of the samples is broadcast or collected."""
    rows = C.samples(spark, sf).join(C.covariates(spark, sf).select("sample_id", "n_orders"), "sample_id")
    pheno = C.phenotypes(spark, sf).filter(F.col("pheno").isin("balance", "spend"))
    resid, c2, _ = study.fit_null(rows.select("sample_id", "n_orders"), pheno, ["n_orders"])
    blocks = blocked.dosage_blocks(C.dosages(spark, sf))
    out = blocked.associate_blocks(blocks, blocked.cohort_of(rows, resid, c2, ["n_orders"]))
    return out.select("variant_id", "pheno", r("beta", 3).alias("beta"), r("se", 3).alias("se"), r("t", 5).alias("t"))


@query(f"""WITH n AS (SELECT count(*) AS n_all FROM cov),
d AS (SELECT sample_id, 1.0::DOUBLE AS x0, n_orders AS x1, nation AS x2, y FROM cov JOIN phe USING (sample_id) WHERE pheno = 'positive'),
{sqlforms.logistic("d", 3)},
e AS MATERIALIZED (SELECT sample_id, x0, x1, x2, y - mu AS s, mu * (1 - mu) AS w FROM (SELECT d.*, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2))) AS mu FROM d, beta)),
c AS MATERIALIZED (SELECT n_all / (sum(w) - ({" + ".join(f"max(i{i}_{j}) * sum(w * w * x{i} * x{j})" for i in range(3) for j in range(3))})) AS c1, sum(s * s) AS ss FROM e, beta, n GROUP BY n_all),
xg AS MATERIALIZED (SELECT variant_id, {", ".join([f"sum(x{i} * x{j}) AS m{i}_{j}" for i in range(3) for j in range(3)] + [f"sum(x{i} * dosage) AS m{i}_3" for i in range(3)])} FROM dos JOIN d USING (sample_id) GROUP BY variant_id),
{sqlforms.solve("u", "xg", 3, 1, ("variant_id",))},
g AS (SELECT variant_id, dosage - m0_3 * x0 - m1_3 * x1 - m2_3 * x2 AS g, c1 * s AS r FROM dos JOIN e USING (sample_id) JOIN u USING (variant_id), c),
q AS (SELECT variant_id, corr(g, r) AS rho, stddev_pop(r) / stddev_pop(g) AS ratio FROM g GROUP BY variant_id),
t AS MATERIALIZED (SELECT variant_id, rho * ratio AS beta, sqrt((1 - rho * rho) / (n_all - 2)) * ratio / sqrt(c1 * ss / (n_all - 1)) AS se FROM q, n, c)
SELECT variant_id, round(beta, 5) + 0.0 AS beta, round(se, 5) + 0.0 AS se, round(-log10({sqlforms.two_sided("z")}), 5) + 0.0 AS neg_log10_p FROM (SELECT *, beta / se AS z FROM t)""")
def assoc_p_values(spark, sf):
    """-log10 p of a binary trait with three covariates, logistic null model."""
    cov = ["n_orders", "nation"]
    t = _traits(spark, sf, cov, ["positive"])
    return assoc.associate(_geno(spark, sf), t).select("variant_id", r("beta", 5).alias("beta"), r("se", 5).alias("se"), r("neg_log10_p", 5).alias("neg_log10_p"))


@query("""
WITH rows_ AS (SELECT o_custkey AS sample_id, (day(o_orderdate) % 7)::DOUBLE AS x, o_totalprice AS y FROM orders),
j AS (SELECT sample_id, count(*)::DOUBLE AS c, sum(x) AS x, sum(y) AS y FROM rows_ GROUP BY sample_id),
m AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM rows_),
gs AS (SELECT variant_id, sum(dosage * c) AS g1, sum(dosage * j.x) AS gx FROM dos JOIN j USING (sample_id) GROUP BY variant_id),
u AS (SELECT variant_id, (sxx * g1 - sx * gx) / (n * sxx - sx * sx) AS a, (n * gx - sx * g1) / (n * sxx - sx * sx) AS b FROM gs, m),
p AS (SELECT variant_id, dosage - (a * c + b * j.x) / c AS g, c FROM dos JOIN j USING (sample_id) JOIN u USING (variant_id))
SELECT variant_id, round(sum(g * c), 3) + 0.0 AS weighted_sum, round(var_pop(g), 6) + 0.0 AS variance FROM p GROUP BY variant_id""")
def residualise_repeated(spark, sf):
    """Dosages less what repeated-measure covariates explain: per-sample sums over orders."""
    rows = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), (F.dayofmonth("o_orderdate") % 7).cast("double").alias("x"))
    sums, project = study.repeated_setup(rows, ["x"])
    local = sums.orderBy("sample_id").select("sample_id", "n").toArrow()
    order, repeats = local["sample_id"].to_numpy(), local["n"].to_numpy().astype(float)
    shared = spark.sparkContext.broadcast((order, repeats, project))

    def run(batches):
        import pyarrow as pa

        at, c, residualise = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("dosage").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)[:, at]
            res = residualise(g)
            yield pa.record_batch([b.column("variant_id"), pa.array((res * c).sum(axis=1)), pa.array(res.var(axis=1))], ["variant_id", "weighted_sum", "variance"])

    out = _geno(spark, sf).mapInArrow(run, "variant_id string, weighted_sum double, variance double")
    return out.select("variant_id", r("weighted_sum", 3).alias("weighted_sum"), r("variance").alias("variance"))


# ---- variants


@query("""SELECT variant_id, count(dosage) AS n_samples, round(avg(dosage) / 2, 6) AS af, round(var_pop(dosage), 6) AS gv_pop, round(var_samp(dosage), 6) AS gv_samp FROM dos GROUP BY variant_id""")
def variant_summary(spark, sf):
    s = variants.summarise_long(C.dosages(spark, sf))
    return s.select("variant_id", "n_samples", *[r(c).alias(c) for c in ("af", "gv_pop", "gv_samp")])


@query("""SELECT variant_id, count(dosage) AS n_samples, round(avg(dosage) / 2, 6) AS af, round(var_samp(dosage), 6) AS gv FROM dos WHERE sample_id % 11 <> 0 GROUP BY variant_id HAVING avg(dosage) / 2 BETWEEN 0.43 AND 0.57""")
def variant_maf_filter(spark, sf):
    """Array summaries with missing dosages, then the frequency filter."""
    d = C.dosages(spark, sf).withColumn("dosage", F.when(F.col("sample_id") % 11 != 0, F.col("dosage")))
    g = assoc.dosage_arrays(d)
    return variants.maf_filter(variants.summarise(g), 0.43).select("variant_id", "n_samples", r("af").alias("af"), r("gv").alias("gv"))


@query("""SELECT variant_id, round(sum(dosage), 3) AS total FROM dos WHERE variant_id IN (SELECT p_brand FROM part WHERE p_size > 45 GROUP BY p_brand HAVING count(*) % 2 = 0) GROUP BY variant_id""")
def variant_include_filter(spark, sf):
    include = C.table(spark, sf, "part").filter("p_size > 45").groupBy(F.col("p_brand").alias("variant_id")).count().filter("count % 2 = 0")
    return variants.include_filter(C.dosages(spark, sf), include).groupBy("variant_id").agg(r(F.sum("dosage"), 3).alias("total"))


@query("""SELECT variant_id, CAST(dosage AS INTEGER) AS dosage, count(*) AS n FROM dos GROUP BY variant_id, dosage""")
def packed_codes(spark, sf):
    """Dosages packed four to a byte and unpacked again by bit operations."""
    d = C.dosages(spark, sf).withColumn("code", F.when(F.col("dosage") == 2, 0).when(F.col("dosage") == 1, 2).otherwise(3))
    packed = d.groupBy("variant_id", F.floor(F.col("sample_idx") / 4).alias("b")).agg(F.sum(F.expr("shiftleft(code, cast(2 * (sample_idx % 4) as int))")).cast("int").alias("byte"), F.count("*").alias("k"))
    out = packed.select("variant_id", "byte", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("i"))
    code = F.expr("shiftright(byte, 2 * i) & 3")
    return out.select("variant_id", stats.dosage_of_code(code).cast("int").alias("dosage")).groupBy("variant_id", "dosage").agg(F.count("*").alias("n"))


# ---- alignment


@query("""SELECT c_custkey AS sample_id, o_orderkey AS row_id, o_totalprice AS x FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 9 <> 0""")
def align_inner(spark, sf):
    """One sample to many complete covariate rows."""
    rows = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("x"))
    return align.inner_by_id(C.samples(spark, sf).select("sample_id"), rows, ["x"])


@query("""SELECT c_custkey AS sample_id FROM customer WHERE c_custkey IN (SELECT sample_id FROM cov WHERE month IS NOT NULL)""")
def align_semi(spark, sf):
    return align.with_complete_covariates(C.samples(spark, sf).select("sample_id"), C.covariates(spark, sf), ["month"])


@query("""
WITH l AS (SELECT o_custkey AS sample_id, o_orderkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS occurrence FROM orders),
q AS (SELECT o_custkey AS sample_id, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS occurrence FROM orders)
SELECT l.sample_id, l.occurrence, a, b FROM l JOIN q ON l.sample_id = q.sample_id AND l.occurrence = q.occurrence""")
def align_zip(spark, sf):
    """The k-th phenotype row of a sample with its k-th covariate row."""
    o = C.table(spark, sf, "orders")
    left = o.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("a"))
    right = o.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("b"), F.struct("o_totalprice", "o_orderkey").alias("ord"))
    out = align.zip_by_occurrence(left, right, "a", "ord")
    return out.select("sample_id", F.col("occurrence").cast("long").alias("occurrence"), "a", "b")


@query("""
WITH rw AS (SELECT c_custkey AS sample_id, c_custkey AS row_idx FROM customer WHERE c_custkey % 5 <> 0),
pr AS (SELECT least(a.row_idx, b.row_idx) AS i, greatest(a.row_idx, b.row_idx) AS j, edge_idx, value FROM edge JOIN rw a ON a.sample_id = id1 JOIN rw b ON b.sample_id = id2)
SELECT i, j, arg_min(value, edge_idx) AS value FROM pr GROUP BY i, j""")
def kinship_expand(spark, sf):
    """Edges with both ends in the cohort; of repeated unordered pairs the first counts."""
    rows = C.samples(spark, sf).filter("sample_id % 5 <> 0").select("sample_id", F.col("sample_idx").alias("row_idx"))
    return align.kinship_pairs(C.kinship_edges(spark, sf), rows)


@query("""
WITH rw AS (SELECT c_custkey AS i FROM customer),
p AS (SELECT least(id1, id2) AS i, greatest(id1, id2) AS j, arg_min(value, edge_idx) AS value FROM edge GROUP BY 1, 2),
m AS (SELECT i, j, value FROM p UNION ALL SELECT j, i, value FROM p WHERE i <> j UNION ALL SELECT i, i, 1.0 FROM rw)
SELECT i, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT i, j, sum(value) AS v FROM m GROUP BY i, j) GROUP BY i""")
def kinship_rows(spark, sf):
    """Row sums of the assembled sparse matrix."""
    rows = C.samples(spark, sf).select("sample_id", F.col("sample_idx").alias("row_idx"))
    m = align.kinship_matrix(align.kinship_pairs(C.kinship_edges(spark, sf), rows), rows)
    return m.groupBy("i").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query("""SELECT c_custkey AS node, (c_custkey // 4) * 4 AS component FROM customer WHERE (SELECT count(*) FROM customer c2 WHERE c2.c_custkey // 4 = customer.c_custkey // 4) > 1""")
def kinship_families(spark, sf):
    """Connected components of the kinship graph."""
    return connected_components(C.kinship_edges(spark, sf), "id1", "id2")


@query("""SELECT sample_id, coalesce(max(CASE WHEN pheno = 'balance' THEN round(y, 2) END), 0) AS balance, coalesce(max(CASE WHEN pheno = 'spend' THEN round(y, 2) END), 0) AS spend FROM phe GROUP BY sample_id""")
def residuals_zero_filled(spark, sf):
    long = C.phenotypes(spark, sf).filter("y is not null").select("sample_id", "pheno", F.col("y").alias("resid"))
    out = align.zero_filled(C.samples(spark, sf), long, ["balance", "spend"])
    return out.select("sample_id", r("balance", 2).alias("balance"), r("spend", 2).alias("spend"))


@query("""SELECT w.c_custkey AS sample_id, w.c_custkey * 2 AS place, coalesce(o.c_custkey, -1) AS own_idx FROM customer w LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1) o ON o.c_custkey = w.c_custkey""")
def genotype_permutation(spark, sf):
    """Where each wanted sample stands in a genotype file; -1 where it is absent."""
    s = C.samples(spark, sf)
    return align.column_order(s.select("sample_id", (F.col("sample_idx") * 2).alias("place")), s.filter("sample_id % 3 <> 1"))


@query("""SELECT o_custkey AS sample_id, count(*) AS n_rows, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY o_custkey""")
def incidence_sums(spark, sf):
    rows = C.table(spark, sf, "orders").withColumnRenamed("o_custkey", "sample_id")
    return align.sums_by_sample(rows, ["o_totalprice"]).withColumn("o_totalprice", r("o_totalprice", 2))


@query("""SELECT o_custkey AS sample_id, count(*) AS n, min(o_orderkey) AS first_idx FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def duplicated_samples(spark, sf):
    rows = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderkey")
    return align.duplicated_ids(rows).join(align.first_seen_ids(rows, "o_orderkey"), "sample_id")


@query("""SELECT c_custkey AS sample_id, c_name AS name, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_idx FROM customer""")
def row_numbers(spark, sf):
    """Dense numbers in a given order, without one sorting task."""
    c = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("b"))
    out = align.with_row_index(c, ["b", "sample_id"], parts=8)
    return out.select("sample_id", "name", F.col("row_idx").cast("long").alias("row_idx"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT 'both' AS kind, count(*) AS n, sum(id)::BIGINT AS total FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'first_only', count(*), sum(id)::BIGINT FROM (SELECT id FROM a EXCEPT SELECT id FROM b)""")
def index_sets(spark, sf):
    """Intersection and difference of index lists."""
    o = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderstatus")
    a, b = o.filter("o_orderpriority like '1%'").select("id"), o.filter("o_orderstatus = 'F'").select("id")
    total = lambda df, kind: df.agg(F.count("*").alias("n"), F.sum("id").alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
    return total(a.intersect(b), "both").unionByName(total(a.exceptAll(a.join(b, "id", "left_semi")).distinct(), "first_only"))


# ---- cells, columns and traits


@query("""SELECT sample_id, pheno, round(y, 1) + 0.0 AS y FROM phe JOIN cov USING (sample_id) WHERE y IS NOT NULL AND month IS NOT NULL""")
def drop_missing(spark, sf):
    """Every trait with its own samples, complete covariates only."""
    full = align.drop_incomplete(C.covariates(spark, sf), ["month"]).select("sample_id")
    return C.phenotypes(spark, sf).filter("y is not null").join(full, "sample_id").select("sample_id", "pheno", r("y", 1).alias("y"))


@query("""SELECT pheno, count(DISTINCT y) AS n_values, CASE WHEN count(DISTINCT y) = 2 THEN 'binomial' WHEN count(DISTINCT y) < 2 THEN 'constant' ELSE 'gaussian' END AS family FROM phe WHERE y IS NOT NULL GROUP BY pheno""")
def trait_families(spark, sf):
    return align.binary_traits(C.phenotypes(spark, sf))


@query("""
WITH s AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS v FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders UNION SELECT 'day', (day(o_orderdate) % 9)::VARCHAR FROM orders UNION SELECT 'key', o_orderkey::VARCHAR FROM orders)
SELECT name, count(*) AS n_values, string_agg(v, ',' ORDER BY try_cast(v AS DOUBLE) NULLS FIRST, v) AS levels FROM s GROUP BY name HAVING count(*) <= 10""")
def categorical_covariates(spark, sf):
    """Columns with few values, numbers in numeric order."""
    o = C.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.dayofmonth("o_orderdate") % 9).alias("day"), F.col("o_orderkey").alias("key"))
    return align.categorical_columns(o, ["o_orderstatus", "o_orderpriority", "day", "key"])


@query("""SELECT o_orderkey AS id, CASE WHEN trim(replace(replace(cell, chr(13), ''), '"', '')) IN ('', 'NA') THEN NULL ELSE trim(replace(replace(cell, chr(13), ''), '"', '')) END AS cell,
  try_cast(trim(replace(replace(cell, chr(13), ''), '"', '')) AS DOUBLE) AS number, coalesce(nullif(tag, ''), 'NA') AS tag, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi
  FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '"' || o_custkey || '"' || chr(13) WHEN 2 THEN '' ELSE o_orderstatus END AS cell, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS tag FROM orders)""")
def cell_functions(spark, sf):
    """Cleaning of cells, numbers from text, defaults and order-independent keys."""
    k = F.col("o_orderkey")
    cell = F.when(k % 4 == 0, "NA").when(k % 4 == 1, F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"\r'))).when(k % 4 == 2, "").otherwise(F.col("o_orderstatus"))
    o = C.table(spark, sf, "orders").withColumn("cell", stats.strip_cell(cell)).withColumn("tag", F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")))
    pair = stats.pair_key(k, F.col("o_custkey"))
    return o.select(k.alias("id"), F.when(~F.col("cell").isin("", "NA"), F.col("cell")).alias("cell"), stats.number(F.col("cell")).alias("number"), stats.or_default(F.col("tag")).alias("tag"), pair["lo"].alias("lo"), pair["hi"].alias("hi"))


@query("""SELECT sample_id, round(1 / (1 + exp(-nation / 10)), 8) AS logit, round(exp(nation / 10), 6) AS log_link, round(nation / 10 * nation / 10, 6) AS sqrt_link,
  round(1 / (1 + exp(-nation / 10)) * (1 - 1 / (1 + exp(-nation / 10))), 8) AS slope, CAST(sign(nation - 12) AS INTEGER) AS sign FROM cov""")
def link_functions(spark, sf):
    eta = F.col("nation") / 10
    mu = stats.inverse_link(eta, "binomial", "logit")
    return C.covariates(spark, sf).select("sample_id", r(mu, 8).alias("logit"), r(stats.inverse_link(eta, link="log")).alias("log_link"), r(stats.inverse_link(eta, link="sqrt")).alias("sqrt_link"), r(stats.mean_slope(mu, "binomial", "logit"), 8).alias("slope"), F.signum(F.col("nation") - 12).cast("int").alias("sign"))


# ---- null models


@query("""SELECT 'gram' AS kind, count(*) AS n, round(sum(n_orders), 4) AS sx, round(sum(n_orders * n_orders), 4) AS sxx, round(sum(n_orders * month), 3) AS sxm, round(sum(nation * month), 3) AS snm FROM cov WHERE month IS NOT NULL""")
def gram_matrix(spark, sf):
    """Sums of products in one aggregation."""
    rows, names = nullmodel.design(_ready(spark, sf), ["n_orders", "nation", "month"])
    g = nullmodel.gram(rows, names)
    row = rows.agg(F.count("*").alias("n"))
    return row.select(F.lit("gram").alias("kind"), "n", *[r(F.lit(float(g[i, j])), d).alias(a) for i, j, d, a in ((0, 1, 4, "sx"), (1, 1, 4, "sxx"), (1, 3, 3, "sxm"), (2, 3, 3, "snm"))])


@query("""
WITH n AS (SELECT count(*) AS n_all FROM cov), a AS (SELECT * FROM cov JOIN phe USING (sample_id) WHERE pheno IN ('balance', 'spend') AND y IS NOT NULL),
f AS (SELECT pheno, regr_slope(y, n_orders) AS b, regr_intercept(y, n_orders) AS a, count(*) AS n FROM a GROUP BY pheno)
SELECT a.pheno, a.sample_id, round((y - f.a - b * n_orders) * n_all / (f.n - 2), 3) + 0.0 AS resid, round(n_all::DOUBLE / (n_all - 1), 8) AS c2 FROM a JOIN f ON a.pheno = f.pheno, n""")
def null_gaussian(spark, sf):
    """Corrected residuals and c2 of two Gaussian traits."""
    resid, c2, _ = study.fit_null(C.covariates(spark, sf).select("sample_id", "n_orders"), C.phenotypes(spark, sf).filter("pheno <> 'positive'"), ["n_orders"])
    pick = F.create_map(*[x for k, v in c2.items() for x in (F.lit(k), F.lit(v))])
    return resid.select("pheno", "sample_id", r("resid", 3).alias("resid"), r(pick[F.col("pheno")], 8).alias("c2"))


@query("""
WITH a AS (SELECT n_orders AS x, nation AS z, y FROM cov JOIN phe USING (sample_id) WHERE pheno = 'balance' AND y IS NOT NULL),
s AS (SELECT covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM a),
b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, mx, mz, my FROM s)
SELECT 'intercept' AS name, round(my - bx * mx - bz * mz, 4) + 0.0 AS estimate FROM b UNION ALL SELECT 'n_orders', round(bx, 4) + 0.0 FROM b UNION ALL SELECT 'nation', round(bz, 4) + 0.0 FROM b""")
def null_coefficients(spark, sf):
    """Least squares with two covariates and a collinear third one, which is dropped."""
    rows = C.covariates(spark, sf).withColumn("copy", F.col("n_orders") * 2 + 3).join(C.phenotypes(spark, sf).filter("pheno = 'balance'"), "sample_id")
    fit = nullmodel.fit_gaussian(rows, ["n_orders", "nation", "copy"], pheno="balance")
    n = rows.agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(float(b)).alias("b")) for a, b in zip(fit.names, fit.coef)])).alias("c")
    return n.select(table).select("c.name", r("c.b", 4).alias("estimate"))


@query(f"""WITH d AS (SELECT 1.0::DOUBLE AS x0, n_orders AS x1, nation AS x2, month AS x3, y FROM cov JOIN phe USING (sample_id) WHERE pheno = 'positive' AND month IS NOT NULL),
{sqlforms.logistic("d", 4)},
c AS (SELECT unnest([{", ".join(f"{{'name': '{n}', 'b': b{i}, 'se': sqrt(i{i}_{i})}}" for i, n in enumerate(("intercept", "n_orders", "nation", "month")))}], recursive := true) FROM beta)
SELECT 'positive' AS pheno, name, round(b, 5) + 0.0 AS estimate, round(se, 5) + 0.0 AS se, round(z, 5) + 0.0 AS z, round({sqlforms.two_sided("z")}, 5) + 0.0 AS p FROM (SELECT *, b / se AS z FROM c)""")
def null_logistic(spark, sf):
    """Coefficients of the logistic null model with standard errors and Wald p."""
    rows = _ready(spark, sf).join(C.phenotypes(spark, sf).filter("pheno = 'positive'"), "sample_id")
    fit = nullmodel.fit_logistic(rows, ["n_orders", "nation", "month"], pheno="positive")
    out = spark.createDataFrame(fit.report(), "pheno string, name string, estimate double, se double, z double, p double")
    return out.select("pheno", "name", *[r(c, 5).alias(c) for c in ("estimate", "se", "z", "p")])


def _mixed_input(spark, sf, pheno: str = "balance"):
    """(rows, kinship matrix) of a trait."""
    rows = C.samples(spark, sf).select("sample_id", F.col("sample_idx").alias("row_idx")).join(C.covariates(spark, sf).select("sample_id", "n_orders"), "sample_id").join(C.phenotypes(spark, sf).filter(F.col("pheno") == pheno).select("sample_id", "y"), "sample_id")
    index = rows.select("sample_id", "row_idx")
    k = materialise(align.kinship_matrix(align.kinship_pairs(C.kinship_edges(spark, sf), index), index), "kinship")
    return materialise(rows, "cohort"), k


@query("""WITH a AS (SELECT sample_id, sample_id // 4 AS f, n_orders AS x, y FROM cov JOIN phe USING (sample_id) WHERE pheno = 'balance' AND y IS NOT NULL),
t AS (SELECT 6e6 + 2e6 AS a, 2e6 AS b),
fam AS MATERIALIZED (SELECT f, any_value(t.a) AS a, count(*) AS m, any_value(t.b) / (any_value(t.a) + count(*) * any_value(t.b)) AS h, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM a, t GROUP BY f),
e AS MATERIALIZED (SELECT sum((m - h * m * m) / a) AS e11, sum((sx - h * m * sx) / a) AS e1x, sum((sxx - h * sx * sx) / a) AS exx, sum((sy - h * m * sy) / a) AS e1y, sum((sxy - h * sx * sy) / a) AS exy,
  sum((m - 1) * 0.5 / a + (1 - h * m) / a * (0.5 + 0.5 * m)) AS tr,
  sum((0.5 * (m - 2 * h * m * m + m * h * h * m * m) + 0.5 * m * m * (1 - h * m) ** 2) / a ** 2) AS k11,
  sum((0.5 * (sx - 2 * h * m * sx + m * h * h * m * sx) + 0.5 * m * sx * (1 - h * m) ** 2) / a ** 2) AS k1x,
  sum((0.5 * (sxx - 2 * h * sx * sx + m * h * h * sx * sx) + 0.5 * sx * sx * (1 - h * m) ** 2) / a ** 2) AS kxx FROM fam),
c AS MATERIALIZED (SELECT (e1y * exx - exy * e1x) / (e11 * exx - e1x * e1x) AS b0, (exy * e11 - e1y * e1x) / (e11 * exx - e1x * e1x) AS b1,
  (SELECT count(*) FROM cov) / (tr - (exx * k11 - 2 * e1x * k1x + e11 * kxx) / (e11 * exx - e1x * e1x)) AS c1 FROM e),
r AS (SELECT sample_id, (y - b0 - b1 * x - h * (sy - b0 * m - b1 * sx)) / fam.a AS py, c1 FROM a JOIN fam USING (f), c),
c2 AS (SELECT max(c1) * sum(py * py) / ((SELECT count(*) FROM cov) - 1) AS c2 FROM r)
SELECT sample_id, round(c1 * py, 3) + 0.0 AS resid, round(c2, 6) AS c2 FROM r, c2""")
def mixed_corrections(spark, sf):
    """Corrected residuals and c2 of a mixed model at given variance components."""
    rows, k = _mixed_input(spark, sf)
    fit, resid = mixed.mixed_at(rows, [k], ["n_orders"], [6e6, 4e6])
    return resid.select(F.col("row_idx").alias("sample_id"), r("resid", 3).alias("resid"), r(F.lit(fit.c2)).alias("c2"))


@query(f"""WITH a AS (SELECT sample_id, sample_id // 4 AS f, n_orders / 10 AS x, y FROM cov JOIN phe USING (sample_id) WHERE pheno = 'positive'),
{sqlforms.pql_families("a", 0.8, 14)},
u AS (SELECT pql.f AS f, d * (1 - g * sd) AS u1, d * (x - g * sx) AS ux, d - g * d * d AS sii FROM pql JOIN pqlf USING (f)),
uf AS (SELECT f, sum(u1) AS t1, sum(ux) AS tx, sum(u1 * u1) AS q11, sum(u1 * ux) AS q1x, sum(ux * ux) AS qxx, sum(sii) AS tii FROM u GROUP BY f),
z AS (SELECT sum(tii + t1) / 2 AS tr, sum(q11 + t1 * t1) / 2 AS k11, sum(q1x + t1 * tx) / 2 AS k1x, sum(qxx + tx * tx) / 2 AS kxx FROM uf),
e AS (SELECT sum(sd - g * sd * sd) AS e11, sum(sx - g * sd * sx) AS e1x, sum(sxx - g * sx * sx) AS exx FROM pqlf),
cor AS (SELECT (SELECT count(*) FROM a) / (tr - (exx * k11 - 2 * e1x * k1x + e11 * kxx) / (e11 * exx - e1x * e1x)) AS c1 FROM z, e)
SELECT sample_id, round(eta, 5) + 0.0 AS predictor, round(c1 * (y - mu), 5) + 0.0 AS resid FROM pql, cor""")
def mixed_binary(spark, sf):
    """Penalised quasi-likelihood of a binary trait with kinship at a given component: linear predictors and corrected residuals."""
    rows, k = _mixed_input(spark, sf, "positive")
    rows = rows.select("row_idx", F.array("y").alias("y"), (F.col("n_orders") / 10).alias("x"))
    stacks = mixed.Stacks(rows, [k], ["x"])
    fits, resid = mixed.fit_mixed(stacks, [mixed.Trait(0, [0, 1], True, np.zeros(2))], tau=[[1.0, 0.8]], tol=1e-10)
    mu = F.explode("y").alias("y")
    out = resid.join(rows.select("row_idx", mu), "row_idx").withColumn("p", F.col("y") - F.col("resid") / fits[0].c1)
    return out.select(F.col("row_idx").alias("sample_id"), r(F.log(F.col("p") / (1 - F.col("p"))), 5).alias("predictor"), r("resid", 5).alias("resid"))


@query("""WITH a AS (SELECT o_custkey AS sample_id, (day(o_orderdate) % 7)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders),
s AS MATERIALIZED (SELECT sample_id, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, 5000.0 + 2000.0 * count(*) AS v, 2000.0 / (5000.0 + 2000.0 * count(*)) AS h FROM a GROUP BY sample_id),
e AS MATERIALIZED (SELECT sum(m - h * m * m) / 5000 AS e11, sum(sx - h * m * sx) / 5000 AS e1x, sum(sxx - h * sx * sx) / 5000 AS exx, sum(sy - h * m * sy) / 5000 AS e1y, sum(sxy - h * sx * sy) / 5000 AS exy,
  sum(m / v) AS tr, sum((m / v) ** 2) AS k11, sum(m * sx / v ** 2) AS k1x, sum((sx / v) ** 2) AS kxx, count(*) AS n FROM s),
c AS (SELECT (e1y * exx - exy * e1x) / (e11 * exx - e1x * e1x) AS b0, (exy * e11 - e1y * e1x) / (e11 * exx - e1x * e1x) AS b1, n, n / (tr - (exx * k11 - 2 * e1x * k1x + e11 * kxx) / (e11 * exx - e1x * e1x)) AS c1 FROM e),
r AS (SELECT sample_id, (sy - b0 * m - b1 * sx) / v AS py, c1, n FROM s, c)
SELECT sample_id, round(c1 * py, 5) + 0.0 AS resid, round(c1 * (SELECT sum(py * py) FROM r) / (n - 1), 6) AS c2 FROM r""")
def mixed_repeated(spark, sf):
    """Corrected residuals of repeated measures, summed by sample: orders are the rows, customers the samples, at given components."""
    orders = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderkey", (F.dayofmonth("o_orderdate") % 7).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    rows = materialise(align.with_row_index(orders, ["sample_id", "o_orderkey"]), "rows")
    stacks = mixed.Stacks(rows.select("row_idx", F.col("sample_id").alias("subject"), F.array("y").alias("y"), "x"), [mixed.SAME_SUBJECT], ["x"])
    fits, resid = mixed.fit_mixed(stacks, [mixed.Trait(0, [0, 1])], tau=[[5000.0, 2000.0]])
    return resid.join(rows.select("row_idx", "sample_id"), "row_idx").select("sample_id", r("resid", 5).alias("resid"), r(F.lit(fits[0].c2)).alias("c2"))


@query()
def null_mixed(spark, sf):
    """AI-REML with a kinship of families: variance components, correction and residual sums."""
    rows, k = _mixed_input(spark, sf)
    fit, resid = mixed.fit_reml(rows, [k], ["n_orders"])
    total = resid.agg(F.count("*").alias("n"), F.sum(F.col("resid") * F.col("resid")).alias("ss"))
    values = [F.lit(float(x)) for x in (*fit.tau, fit.c1, fit.c2)]
    return total.select("n", r("ss", 2).alias("ss"), *[r(v, 4).alias(a) for v, a in zip(values, ("tau_residual", "tau_kinship", "c1", "c2"))])


@query("""SELECT 'text' AS kind, count(*) AS n, round(sum(coalesce(y, 0)), 2) AS total FROM phe WHERE pheno = 'spend'""")
def text_round_trip(spark, sf):
    """Correction table written as text and read again."""
    from ..operators.shared import shared_dir
    from ..sources.text import read_corrections
    import uuid

    path = f"{shared_dir(spark)}/corrections-{uuid.uuid4().hex}"
    resid = C.phenotypes(spark, sf).filter("pheno = 'spend' and y is not null").select("sample_id", "pheno", F.col("y").alias("resid"))
    study.write_corrections(C.samples(spark, sf), resid, {"spend": 1.5}, path)
    _, back = read_corrections(spark, path)
    return back.agg(F.count("*").alias("n"), r(F.sum("resid"), 2).alias("total")).select(F.lit("text").alias("kind"), "n", "total")


def _files_sql(keep: str) -> str:
    return f"""
WITH d AS (SELECT variant_id, CASE WHEN sample_id % 11 <> 5 THEN dosage END AS dosage FROM dos),
v AS (SELECT variant_id, row_number() OVER (ORDER BY variant_id) - 1 AS i FROM (SELECT DISTINCT variant_id FROM dos))
SELECT variant_id AS rsid, i::BIGINT AS variant_idx, CASE WHEN i % 2 = 0 THEN '1' ELSE 'X' END AS chr, (100 * i + 1)::BIGINT AS pos, 'A' AS non_effect, 'G' AS effect,
  count(dosage) AS n_samples, round(avg(dosage) / 2, 6) AS af, round(var_samp(dosage), 6) AS gv FROM d JOIN v USING (variant_id){keep} GROUP BY variant_id, i"""


def _written_files(spark, sf: str, kind: str) -> str:
    """The folder of genotype files of the study's dosages, every 11th sample missing."""
    import uuid

    d = C.dosages(spark, sf).withColumn("dosage", F.when(F.col("sample_id") % 11 != 5, F.col("dosage")))
    g = align.with_row_index(assoc.dosage_arrays(d), ["variant_id"], "variant_idx")
    i = F.col("variant_idx")
    g = g.select(i, F.col("variant_id").alias("rsid"), F.when(i % 2 == 0, "1").otherwise("X").alias("chr"), (100 * i + 1).alias("pos"), F.lit("A").alias("non_effect"), F.lit("G").alias("effect"), "dosage")
    path = f"{shared_dir(spark)}/study-{uuid.uuid4().hex}.{kind}"
    write_genotypes(g, path)
    return path


def _summary(geno: DataFrame) -> DataFrame:
    return variants.summarise(geno).select("rsid", "variant_idx", "chr", "pos", "non_effect", "effect", "n_samples", r("af").alias("af"), r("gv").alias("gv"))


def _through_files(spark, sf: str, kind: str) -> DataFrame:
    return _summary(genotypes(spark, _written_files(spark, sf, kind)))


@query(_files_sql(""))
def bed_round_trip(spark, sf):
    """Packed genotype files written by the tasks, read back and summarised."""
    return _through_files(spark, sf, "bed")


@query(_files_sql(" WHERE i % 3 = 0"))
def bgen_include_list(spark, sf):
    """Probabilistic genotype files written by the tasks and read back for every third variant of an include list, all of which must be there."""
    back = _through_files(spark, sf, "bgen")
    include = align.with_row_index(C.table(spark, sf, "part").select(F.col("p_brand").alias("rsid")).distinct(), ["rsid"], "i").filter("i % 3 = 0").select("rsid")
    variants.check_included(back, include, "rsid")
    return variants.include_filter(back, include, "rsid")


@query(_files_sql(" WHERE i % 2 = 0 AND i >= 6"))
def bgen_region(spark, sf):
    """Variants of a region through a kept index: only their blocks are read."""
    path = _written_files(spark, sf, "bgen")
    write_index(spark, path, f"{path}.index")
    return _summary(read_indexed(spark, f"{path}.index", region=("1", 601, None)))


# ---- tables and designs


@query("""SELECT sample_id, round(sum(y), 2) AS total, count(y) AS n, min(i) AS first FROM (
  SELECT c_custkey AS sample_id, CASE WHEN i % 7 = 3 OR i % 5 = 2 THEN NULL ELSE o_totalprice END AS y, i FROM (
    SELECT o_custkey AS c_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)) WHERE i % 7 <> 3 GROUP BY sample_id""")
def ragged_rows(spark, sf):
    """A written table with short rows, empty cells and quotes: widths and the file's order survive the tasks."""
    import uuid

    from ..sources.text import read_delimited

    path = f"{shared_dir(spark)}/ragged-{uuid.uuid4().hex}"
    rows = align.with_row_index(C.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("y")), ["o_orderkey"])
    i = F.col("row_idx")
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"')), F.when(i % 7 == 3, F.lit(None)).when(i % 5 == 2, F.when(i % 2 == 0, "").otherwise("NA")).otherwise(F.col("y")), F.when(i % 7 == 3, F.lit(None)).otherwise(i.cast("string")))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("row_idx"), F.lit("IID,y,i").alias("value"))
    head.unionByName(rows.select("row_idx", line.alias("value"))).repartitionByRange(4, "row_idx").sortWithinPartitions("row_idx").select("value").write.text(path)
    back = align.with_row_index(read_delimited(spark, path, order="place"), ["place"])
    back = back.filter("IID is not null").select(F.col("IID").cast("long").alias("sample_id"), F.col("y").cast("double").alias("y"), "row_idx", F.col("i").cast("long").alias("i"))
    # the place in the file and the number that was written into it must agree
    return back.filter("row_idx = i").groupBy("sample_id").agg(r(F.sum("y"), 2).alias("total"), F.count("y").alias("n"), F.min("row_idx").alias("first"))


@query("""SELECT count(*) AS n, round(sqrt(count(*)), 4) AS r11, round(sum(n_orders) / sqrt(count(*)), 4) AS r12, round(sum(nation) / sqrt(count(*)), 4) AS r13,
  round(sqrt(regr_sxx(n_orders, n_orders)), 4) AS r22, round(regr_sxy(nation, n_orders) / sqrt(regr_sxx(n_orders, n_orders)), 4) + 0.0 AS r23,
  round(sqrt(regr_syy(nation, n_orders) * (1 - regr_r2(nation, n_orders))), 4) AS r33, 'n_orders,nation' AS independent FROM cov""")
def design_factor(spark, sf):
    """R of the design by a tree of QR factorisations, and the columns that add something."""
    d = C.covariates(spark, sf).select(F.lit(1.0).alias("one"), "n_orders", "nation")
    factor = r_factor(d, d.columns)
    kept = independent(d.withColumn("twice", F.col("n_orders") * 2 - F.col("nation")), ["n_orders", "nation", "twice"])
    values = [F.lit(float(factor[i, j])) for i in range(3) for j in range(i, 3)]
    out = d.agg(F.count(F.lit(1)).alias("n"))
    return out.select("n", *[r(v, 4).alias(f"r{i + 1}{j + 1}") for v, (i, j) in zip(values, ((i, j) for i in range(3) for j in range(i, 3)))], F.lit(",".join(kept)).alias("independent"))
