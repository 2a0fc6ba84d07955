"""Registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import diagnostics as dg
from causeway.operators import estimators as es
from causeway.operators import likelihood as lk
from causeway.operators import prep
from causeway.operators.independence import kernel_test
from causeway.operators.moments import moments
from causeway.operators.ranks import order_statistics
from causeway.operators.results import rounded
from causeway.plans import discovery as ds
from causeway.plans import engine, graph
from causeway.roles import CausalQuery
from causeway.sources.tables import profile

#: Test views with planted effects, in SQL that both engines read.
VIEWS = {
    "priced": "SELECT CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS t, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y FROM lineitem",
    "confounded": "SELECT l_orderkey AS id, s, CASE WHEN l_partkey % 10 < 3 + 2 * s THEN 1e0 ELSE 0e0 END AS t, l_discount AS x1, l_tax AS x2, CAST(l_suppkey % 5 AS INT) AS fold, CAST(l_partkey % 3 AS INT) AS fold3, 2e0 * CASE WHEN l_partkey % 10 < 3 + 2 * s THEN 1 ELSE 0 END + 1.5e0 * s + l_extendedprice / 1e5 AS y FROM (SELECT *, CAST(floor(l_quantity / 17e0) AS INT) AS s FROM lineitem) q",
    "instrumented": "SELECT *, 2e0 * t + 3e0 * u + x / 1e2 AS y FROM (SELECT CAST(l_linenumber % 2 AS DOUBLE) AS z1, CAST(l_suppkey % 3 AS DOUBLE) AS z2, l_tax * 25e0 AS u, l_quantity AS x, 0.5e0 * (l_linenumber % 2) + 0.25e0 * (l_suppkey % 3) + l_tax * 25e0 + l_discount AS t FROM lineitem) q",
    "panel": "SELECT CAST(user_id AS DOUBLE) AS g, p, CASE WHEN user_id % 2 = 0 AND p >= 2 THEN 1e0 ELSE 0e0 END AS t, 3e0 * CASE WHEN user_id % 2 = 0 AND p >= 2 THEN 1 ELSE 0 END + user_id * 1e-1 + p * 5e-1 + avg(value) / 1e3 AS y FROM (SELECT user_id, value, CAST(floor((EXTRACT(DAY FROM ts) - 1) / 7e0) AS INT) AS p FROM events) e GROUP BY user_id, p",
    "cutoff": "SELECT o_orderkey AS id, o_totalprice / 1e5 AS run, CASE WHEN o_totalprice >= 250000 THEN 1e0 ELSE 0e0 END AS t, CAST(o_custkey % 7 AS DOUBLE) AS c1, 2e0 * CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END + o_totalprice / 1e5 + (o_custkey % 100) / 1e2 AS y FROM orders",
    "mediated": "SELECT s, t, 1.5e0 * t + d * 1e1 AS m, CAST(floor(1.5e0 * t + d * 3e1) AS INT) AS m2, 2e0 * (1.5e0 * t + d * 1e1) + 1.5e0 * s + x AS y FROM (SELECT l_discount AS d, l_tax AS x, s, CASE WHEN l_partkey % 10 < 3 + 2 * s THEN 1e0 ELSE 0e0 END AS t FROM (SELECT *, CAST(floor(l_quantity / 17e0) AS INT) AS s FROM lineitem) q) r",
    "dirty": "SELECT p_partkey AS id, p_name, p_brand, p_type, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_size % 2 = 0 THEN ' Yes' ELSE 'no' END AS yn, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS reg0, CASE WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS reg1, CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END AS reg2, p_retailprice AS price, 2e0 * p_retailprice AS price_copy FROM part",
    "conditional": "SELECT *, 2e0 * t + 3e0 * x + 3e0 * u AS y FROM (SELECT x + l_linenumber / 3e0 AS z, x, u, x + l_linenumber / 3e0 + u + l_discount * 1e1 AS t FROM (SELECT l_linenumber, l_discount, l_quantity / 25e0 AS x, l_tax * 25e0 AS u FROM lineitem) q) r",
    "hidden": "SELECT a, d, f, b, c, e FROM (SELECT *, a + d + l_discount * 1e1 AS b, a + d + l_discount * 1e1 + u + l_linenumber / 7e0 AS c, f + u + (l_orderkey % 32) / 16e0 AS e FROM (SELECT *, l_quantity / 25e0 AS a, l_tax * 25e0 AS d, (l_partkey % 13) / 6e0 AS f, (l_suppkey % 7) / 2e0 AS u FROM lineitem) q) r",
    "parts": "SELECT p_partkey AS id, p_size AS x1, p_retailprice / 1e3 AS x2, CASE WHEN p_partkey % 10 < 2 + p_size / 1e1 THEN 1e0 ELSE 0e0 END AS t, 2e0 * CASE WHEN p_partkey % 10 < 2 + p_size / 1e1 THEN 1 ELSE 0 END + p_size / 25e0 + p_retailprice / 1e3 AS y FROM part",
    "heavy": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE p_type END AS kind FROM part",
}
TABLES = {"priced": "lineitem", "confounded": "lineitem", "instrumented": "lineitem", "panel": "events", "cutoff": "orders", "mediated": "lineitem", "dirty": "part", "heavy": "part", "conditional": "lineitem", "hidden": "lineitem", "parts": "part"}
#: Edges between rows of the tables, in SQL that both engines read.
PLACES = "SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey"
CUSTOMERS = f"{PLACES} UNION ALL SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer"
QUESTIONS = "SELECT r_name, 'What is the effect of the discount on the extended price of orders from ' || r_name || '?' AS question FROM region"
DIVISIONS = ["id % 5", *[f"CAST(floor(id / {5**k}e0) AS INT) % 5" for k in range(1, 5)]]
PROFILE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = TABLES[name]
    spark.read.parquet(f"{sf}/{table}.parquet").createOrReplaceTempView(f"causeway_{table}")
    return spark.sql(VIEWS[name].replace(f"FROM {table}", f"FROM causeway_{table}"))


def tables(spark: SparkSession, sf: str, sql: str, *names: str) -> DataFrame:
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(f"causeway_{n}")
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 causeway_{n}", sql)
    return spark.sql(sql)


# ---- SQL by successive residualisation (Frisch, Waugh and Lovell)


def swept(name: str, sweep: list[str], keep: list[str], weight: str = "", base: str = "", centre: bool = True) -> str:
    """WITH ... of a view whose columns of keep have an intercept and the columns of sweep taken out, as table r."""
    w = f"{weight} * " if weight else ""
    total = f"sum({weight}) OVER ()" if weight else "count(*) OVER ()"
    carry = [weight] if weight else []
    ctes = [f"v AS ({base or VIEWS[name]})"]
    columns = [*sweep, *keep]
    mean = lambda c: f"{c} - sum({w}{c}) OVER () / {total} AS {c}" if centre else c
    ctes.append("c0 AS (SELECT " + ", ".join([mean(c) for c in columns] + carry) + " FROM v)")
    for i, s in enumerate(sweep):
        rest = [*sweep[i + 1 :], *keep]
        ctes.append(f"c{i + 1} AS (SELECT " + ", ".join([f"{c} - {s} * (sum({w}{s} * {c}) OVER () / nullif(sum({w}{s} * {s}) OVER (), 0)) AS {c}" for c in rest] + carry) + f" FROM c{i})")
    return "WITH " + ", ".join(ctes) + f", r AS (SELECT * FROM c{len(sweep)})"


def effect_sql(name: str, method: str, estimand: str, term: str, t: str, y: str, sweep: list[str], se: bool = True, weight: str = "", base: str = "", df: str = "", centre: bool = True, where: str = "") -> str:
    w = f"{weight} * " if weight else ""
    b = f"sum({w}{t} * {y}) / sum({w}{t} * {t})"
    free = df or f"(count(*) - {len(sweep) + 2})"
    error = f"round(sqrt((sum({w}{y} * {y}) - sum({w}{t} * {y}) * sum({w}{t} * {y}) / sum({w}{t} * {t})) / {free} / sum({w}{t} * {t})), 6)" if se else "CAST(NULL AS DOUBLE)"
    return f"{swept(name, sweep, [t, y], weight, base, centre)} SELECT '{method}' AS method, '{estimand}' AS estimand, '{term}' AS term, round({b}, 6) AS estimate, {error} AS std_error, CAST(count(*) AS BIGINT) AS n FROM r"


def t_sql(name: str, test: str, t: str, y: str, sweep: list[str], base: str = "") -> str:
    k = len(sweep) + 2
    b, rss = f"sum({t} * {y}) / sum({t} * {t})", f"(sum({y} * {y}) - sum({t} * {y}) * sum({t} * {y}) / sum({t} * {t}))"
    statistic = f"{b} / sqrt({rss} / (count(*) - {k}) / sum({t} * {t}))"
    return f"{swept(name, sweep, [t, y], base=base)} SELECT '{test}' AS test, round({statistic}, 6) AS statistic, CAST(count(*) - {k} AS DOUBLE) AS df2, abs({statistic}) < {critical_t(f'(count(*) - {k})')} AS passed FROM r"


def critical_t(df: str) -> str:
    """The value that |t| exceeds with probability 0.05, for many degrees of freedom."""
    return f"(1.959963985e0 + (1.959963985e0 + pow(1.959963985e0, 3)) / 4 / {df})"


def stat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("test", "statistic", "passed", *columns)


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# ---- queries


def q_scan_profile(spark, sf):
    return profile(spark.read.parquet(f"{sf}/lineitem.parquet")).select("column", "rows", "missing")


def q_prep_corr_drop(spark, sf):
    return rows(spark, [(c,) for c in prep.correlated_columns(prep.drop_missing(view(spark, sf, "dirty")).select("reg0", "reg1", "reg2", "price", "price_copy"))], "column string")


def q_prep_dummy_drop(spark, sf):
    return rows(spark, [(c,) for c in prep.drop_dummies(view(spark, sf, "dirty")).columns], "column string")


def q_prep_corr_matrix(spark, sf):
    got = prep.correlations(prep.drop_missing(view(spark, sf, "dirty")).select("size", "reg0", "reg1", "price", "price_copy"))
    return rows(spark, [(a, b, rounded(r)) for a, b, r in got], "a string, b string, r double")


def q_likelihood_mle(spark, sf):
    got = lk.mle(view(spark, sf, "cutoff").select("run"), "run")
    return got.select("column", "family", F.round("loc", 6).alias("loc"), F.round("scale", 6).alias("scale"))


def q_likelihood_sse(spark, sf):
    return rows(spark, [(f, rounded(e)) for f, e in lk.table_errors(view(spark, sf, "cutoff"), "run").items()], "family string, sse double")


def q_likelihood_ad_stat(spark, sf):
    return rows(spark, [(f, round(x, 3)) for f, x in lk.table_anderson_darling(view(spark, sf, "cutoff"), "run").items()], "family string, statistic double")


def q_quantiles(spark, sf):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    return rows(spark, [(s, rounded(x)) for s, x in zip(shares, order_statistics(view(spark, sf, "cutoff"), "run", shares=shares), strict=True)], "share double, value double")


def q_likelihood_report(spark, sf):
    got = lk.detect_family(view(spark, sf, "confounded").select("s", "t", "x1", "x2", "y"))
    return rows(spark, [(c, f, rounded(p), got.majority, rounded(got.share), got.trusted) for c, (f, p) in got.per_column.items()], "column string, family string, p_value double, majority string, share double, trusted boolean")


def q_pc_fisherz_stats(spark, sf):
    m = moments(view(spark, sf, "confounded"), ["s", "t", "y"])
    out = []
    for a, b, c in (("s", "t", "y"), ("s", "y", "t"), ("t", "y", "s")):
        out += [(a, b, "", rounded(ds.fisher_z(m, a, b, [])[0])), (a, b, c, rounded(ds.fisher_z(m, a, b, [c])[0]))]
    return rows(spark, out, "a string, b string, given string, z double")


def q_ges_local_bic(spark, sf):
    m = moments(view(spark, sf, "confounded"), ["s", "t", "x1", "y"])
    return rows(spark, [("y", ",".join(p), round(ds.local_bic(m, "y", p), 3)) for p in ([], ["s"], ["s", "t"], ["s", "t", "x1"])], "node string, parents string, score double")


def q_lingam_moments(spark, sf):
    df = view(spark, sf, "confounded")
    m = moments(df, ["t", "y"])
    out = []
    for c in ("t", "y"):
        sd = math.sqrt(float(m.part([c], [c])[0, 0]) / m.n)
        u = (F.col(c) - float(m.mean([c])[0])) / sd
        row = df.agg(F.avg(F.log(F.cosh(u))).alias("a"), F.avg(u * F.exp(-u * u / 2)).alias("b")).first()
        out.append((c, rounded(row["a"]), rounded(row["b"])))
    return rows(spark, out, "column string, log_cosh double, gauss double")


def q_cov_matrix(spark, sf):
    names = ["s", "t", "x1", "x2", "y"]
    m = moments(view(spark, sf, "confounded"), names)
    cov = m.covariance()
    return rows(spark, [(a, b, rounded(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], "a string, b string, cov double")


def q_mmd_rbf(spark, sf):
    df = view(spark, sf, "cutoff")
    return rows(spark, [tuple(map(rounded, ds.mmd_features(df.select("run"), df.select("y"))))], "mmd double, std_error double")


def q_pc_chisq_stats(spark, sf):
    df, out = view(spark, sf, "confounded"), []
    for given in ((), ("fold3",), ("fold", "fold3")):
        statistic, free, p = ds.chi_square(df, "s", "t", given)
        out.append((",".join(given), rounded(statistic), free, p > 0.05))
    return rows(spark, out, "given string, statistic double, df int, independent boolean")


def q_kernel_independence(spark, sf):
    df, out = view(spark, sf, "hidden"), []
    for a, b, given in (("a", "d", ()), ("a", "c", ()), ("a", "c", ("b",)), ("c", "e", ("b", "f"))):
        statistic, p, n = kernel_test(df, a, b, given)
        out.append((a, b, ",".join(given), rounded(statistic), rounded(p), n))
    return rows(spark, out, "a string, b string, given string, statistic double, p_value double, n long")


def discovered(algorithm: str, name: str, columns: list[str]):
    def q(spark, sf):
        return ds.ALGORITHMS[algorithm](view(spark, sf, name).select(*columns), columns).edge_table(spark)

    return q


def q_lingam_order(spark, sf):
    return rows(spark, list(enumerate(ds.lingam_order(view(spark, sf, "instrumented"), ["u", "x", "y"])[0])), "place int, column string")


def q_graph_closure(spark, sf):
    return graph.closure(tables(spark, sf, CUSTOMERS, "region", "nation", "customer"))


def q_dsep_table(spark, sf):
    return graph.separation_table(spark, graph.CausalGraph.from_table(tables(spark, sf, PLACES, "region", "nation")), most=1)


def q_est_did_2x2(spark, sf):
    df = view(spark, sf, "panel")
    return es.did_2x2(df, F.col("g") % 2 == 0, F.col("p") >= 2, "y")


def q_intent(spark, sf):
    asked = tables(spark, sf, QUESTIONS, "region").collect()  # one question for each region
    found = [(r["r_name"], engine.resolve(r["question"], list(PROFILE))) for r in asked]
    return rows(spark, [(name, q.treatment, q.outcome) for name, q in found], "r_name string, treatment string, outcome string")


def q_answer(spark, sf):
    """Discovery is skipped by a given graph; preparation, plan and estimate run."""
    g = graph.CausalGraph.from_edges([("s", "t"), ("s", "y"), ("t", "y")])
    return engine.answer(view(spark, sf, "confounded").select("s", "t", "y"), CausalQuery("t", "y"), g).effect


def q_engine_iv(spark, sf):
    """No instrument is named: the plan finds z, valid given x."""
    g = graph.CausalGraph.from_edges(["x -> z", "x -> y", "z -> t", "u -> t", "u -> y", "t -> y"], latent=["u"])
    return engine.answer(view(spark, sf, "conditional").select("x", "z", "t", "y"), CausalQuery("t", "y"), g).effect


def q_engine_did(spark, sf):
    """The graph names a bad control, w; the plan leaves it and the identifiers out."""
    g = graph.CausalGraph.from_edges(["g -> y", "p -> y", "t -> y", "h -> w", "h -> y", "t -> v", "v -> w"], latent=["h", "v"])
    df = view(spark, sf, "panel").withColumn("w", F.col("y") + F.col("t"))
    return engine.answer(df, CausalQuery("t", "y", time="p", group="g", algorithm="DiD"), g).effect


def q_engine_rdd(spark, sf):
    g = graph.CausalGraph.from_edges(["run -> t", "run -> y", "t -> y", "c1 -> y"])
    return engine.answer(view(spark, sf, "cutoff").select("run", "t", "y", "c1"), CausalQuery("t", "y", running="run", cutoff=2.5), g).effect


def q_prep_full(spark, sf):
    got = prep.full_preprocess(view(spark, sf, "dirty").select("id", "p_name", "p_brand", "p_type", "size", "yn", "reg0", "reg1", "reg2", "price", "price_copy"), keep=["id", "price"])[0]
    return got.select(*[F.col(c).cast("string" if c in ("p_name", "p_brand", "p_type") else "double").alias(c) for c in got.columns])


def q_diag_all(spark, sf):
    return dg.run_all(view(spark, sf, "instrumented"), "t", "y", ["x"], instruments=["z1", "z2"]).select("test", "statistic", "passed")


def strata(spark, sf):
    return es.strata_propensity(view(spark, sf, "confounded"), "t", ["s"])


QUERIES = {
    "scan_profile": q_scan_profile,
    "prep_missing_profile": lambda s, d: prep.missing_profile(view(s, d, "dirty")),
    "prep_drop_missing": lambda s, d: prep.drop_missing(view(s, d, "dirty")).select("id", "size", "p_brand", "yn"),
    "prep_impute_mean": lambda s, d: prep.impute_mean(view(s, d, "heavy")).select("id", F.round("size", 6).alias("size")),
    "prep_impute_mode": lambda s, d: prep.impute_mode(view(s, d, "heavy")).select("id", "kind"),
    "prep_handle_missing": lambda s, d: prep.handle_missing(view(s, d, "heavy")).select("id", F.round("size", 6).alias("size"), "kind"),
    "prep_cardinality": lambda s, d: prep.cardinality(view(s, d, "dirty")).select("column", "distinct_values", F.round("share", 6).alias("share"), "encode"),
    "prep_bool_encode": lambda s, d: prep.bool_encode(view(s, d, "dirty"), ["yn"]).select("id", "yn"),
    "prep_label_encode": lambda s, d: prep.label_encode(view(s, d, "dirty"), ["p_type"]).select("id", "p_type"),
    "prep_codebook": lambda s, d: prep.codebook(view(s, d, "dirty"), ["p_type", "p_brand"]),
    "prep_corr_matrix": q_prep_corr_matrix,
    "prep_corr_drop": q_prep_corr_drop,
    "prep_dummy_drop": q_prep_dummy_drop,
    "prep_full": q_prep_full,
    "likelihood_sample": lambda s, d: lk.sample(view(s, d, "cutoff"), ["id"]).select("id"),
    "likelihood_mle": q_likelihood_mle,
    "likelihood_sse": q_likelihood_sse,
    "likelihood_ad_stat": q_likelihood_ad_stat,
    "likelihood_quantiles": q_quantiles,
    "likelihood_report": q_likelihood_report,
    "pc_fisherz_stats": q_pc_fisherz_stats,
    "pc_chisq_stats": q_pc_chisq_stats,
    "kernel_independence": q_kernel_independence,
    "pc_edges": discovered("PC", "confounded", ["s", "t", "y"]),
    "fci_edges": discovered("FCI", "hidden", ["a", "b", "c", "d", "e", "f"]),
    "ges_local_bic": q_ges_local_bic,
    "ges_edges": discovered("GES", "confounded", ["s", "t", "y"]),
    "lingam_moments": q_lingam_moments,
    "lingam_order": q_lingam_order,
    "lingam_edges": discovered("LiNGAM", "instrumented", ["u", "x", "y"]),
    "cov_matrix": q_cov_matrix,
    "notears_edges": discovered("NOTEARS", "confounded", ["s", "t", "y"]),
    "mmd_rbf": q_mmd_rbf,
    "cgnn_edges": discovered("CGNN", "instrumented", ["u", "t", "y"]),
    "dsep_table": q_dsep_table,
    "graph_closure": q_graph_closure,
    "intent_rule_based": q_intent,
    "est_ols": lambda s, d: es.ols(view(s, d, "priced"), "t", "y", ["x1", "x2", "x3"]),
    "est_rct": lambda s, d: es.rct(view(s, d, "priced"), "t", "y"),
    "est_iv_wald": lambda s, d: es.iv_wald(view(s, d, "instrumented"), "t", "y", "z1"),
    "est_iv_2sls": lambda s, d: es.iv_2sls(view(s, d, "instrumented"), "t", "y", ["z1", "z2"], ["x"]),
    "est_did_2x2": q_est_did_2x2,
    "est_did_twfe": lambda s, d: es.did(view(s, d, "panel"), "t", "y", "g", "p"),
    "est_rdd_linear": lambda s, d: es.rdd(view(s, d, "cutoff"), "run", "y", 2.5),
    "est_rdd_triangular": lambda s, d: es.rdd(view(s, d, "cutoff"), "run", "y", 2.5, bandwidth=0.5, kernel="triangular"),
    "rdd_diagnose_stats": lambda s, d: dg.rdd_diagnose(view(s, d, "cutoff"), "run", "t", "y", 2.5, ["c1"]).select("test", "statistic"),
    "est_ipw": lambda s, d: es.ipw(strata(s, d), "t", "y"),
    "est_ipw_hajek": lambda s, d: es.ipw_hajek(strata(s, d), "t", "y"),
    "est_ipw_logit": lambda s, d: es.ipw(es.logistic_propensity(view(s, d, "confounded"), "t", ["s", "x1"]), "t", "y"),
    "est_dml_linear": lambda s, d: es.dml_linear(view(s, d, "confounded"), "t", "y", ["s"], F.col("fold"), 5),
    "est_dml_rf": lambda s, d: es.dml_forest(view(s, d, "parts"), "t", "y", ["x1", "x2"], ["id"], 10),
    "est_aipw": lambda s, d: es.aipw_strata(view(s, d, "confounded"), "t", "y", ["s"], F.col("fold"), 5),
    "est_gcomp_ate": lambda s, d: es.gcomp(view(s, d, "confounded"), "t", "y", ["s"]),
    "est_gcomp_att": lambda s, d: es.gcomp(view(s, d, "confounded"), "t", "y", ["s"], "ATT"),
    "est_frontdoor_linear": lambda s, d: es.frontdoor_linear(view(s, d, "mediated"), "t", "y", ["m"]),
    "est_frontdoor_plugin": lambda s, d: es.frontdoor_plugin(view(s, d, "mediated"), "t", "y", "m2"),
    "diag_reset": lambda s, d: stat(dg.reset(view(s, d, "confounded"), "y", ["s", "x1"]), "df2"),
    "diag_dwh": lambda s, d: stat(dg.durbin_wu_hausman(view(s, d, "instrumented"), "t", "y", ["x"], ["z1", "z2"]), "df2"),
    "diag_positivity": lambda s, d: stat(dg.positivity(strata(s, d))),
    "diag_lead_interactions": lambda s, d: stat(dg.lead_interactions(view(s, d, "panel"), "t", "y", "g", ["p"]), "df2"),
    "diag_no_anticipation": lambda s, d: stat(dg.no_anticipation(view(s, d, "panel"), "t", "y", "g", ["p"]), "df2"),
    "diag_rdd_continuity": lambda s, d: stat(dg.rdd_continuity(view(s, d, "cutoff"), "run", "y", 2.5), "df2"),
    "diag_iv_first_stage_f": lambda s, d: stat(dg.iv_first_stage(view(s, d, "instrumented"), "t", ["x"], ["z1", "z2"]), "df2"),
    "diag_sargan": lambda s, d: stat(dg.sargan(view(s, d, "instrumented"), "t", "y", ["x"], ["z1", "z2"])),
    "diag_mediation": lambda s, d: stat(dg.mediation(view(s, d, "mediated"), "t", "y", ["m"], ["s"]), "df2"),
    "diag_mediator_backdoor": lambda s, d: stat(dg.mediator_backdoor(view(s, d, "mediated"), ["m"], ["m", "s"]), "df2"),
    "diag_dml_stability": lambda s, d: stat(dg.dml_stability(view(s, d, "confounded"), "t", "y", ["s"], [F.expr(e) for e in DIVISIONS])),
    "diag_gcomp_rmse": lambda s, d: stat(dg.gcomp_rmse(view(s, d, "confounded"), "y", ["s", "t"])),
    "diag_all": q_diag_all,
    "engine_answer": q_answer,
    "engine_iv": q_engine_iv,
    "engine_did": q_engine_did,
    "engine_rdd": q_engine_rdd,
}


def _dml_sql(fold: str, base: str = "") -> str:
    sums = "count(*) AS n, sum(s) AS s1, sum(t) AS t1, sum(y) AS y1, sum(s * s) AS ss, sum(s * t) AS st, sum(s * y) AS sy"
    rest = ", ".join(f"(SELECT sum({c}) FROM f) - {c} AS {c}" for c in ("n", "s1", "t1", "y1", "ss", "st", "sy"))
    return (
        f"v AS (SELECT CAST(s AS DOUBLE) AS s, t, y, {fold} AS k FROM ({base or VIEWS['confounded']}) a), f AS (SELECT k, {sums} FROM v GROUP BY k), o AS (SELECT k, {rest} FROM f), "
        "b AS (SELECT k, s1 / n AS ms, y1 / n AS my, t1 / n AS mt, (sy - s1 * y1 / n) / (ss - s1 * s1 / n) AS cy, (st - s1 * t1 / n) / (ss - s1 * s1 / n) AS ct FROM o), "
        "e AS (SELECT y - my - cy * (s - ms) AS u, t - mt - ct * (s - ms) AS v FROM v JOIN b USING (k)), h AS (SELECT sum(u * v) / sum(v * v) AS th FROM e)"
    )


def _lead_sql(test: str) -> str:
    out = []
    for k in range(1, 5):
        base = f"SELECT y, g, l, l * g AS x FROM (SELECT y, g, coalesce(lead(t, {k}) OVER (PARTITION BY g ORDER BY p), 0e0) AS l FROM ({VIEWS['panel']}) a) q"
        out.append("SELECT * FROM (" + t_sql("", f"{test}_lead{k}", "x", "y", ["g", "l"], base) + f") q{k}")
    return " UNION ALL ".join(out)


def _ad_sql() -> str:
    best = {"norm": "(x - m) / s1", "expon": "(x - lo) / (m - lo)", "laplace": "(x - md) / d"}
    head = f"WITH o AS (SELECT run AS x FROM ({VIEWS['cutoff']}) a), md AS (SELECT median(x) AS md FROM o), k AS (SELECT count(*) AS tot, avg(x) AS m, stddev_samp(x) AS s1, min(x) AS lo, any_value(md) AS md, avg(abs(x - md)) AS d FROM o, md), c AS (SELECT x, n, sum(n) OVER (ORDER BY x) - n AS r FROM (SELECT x, count(*) AS n FROM o GROUP BY x) q)"
    each = []
    for f, z in best.items():
        u = f"SELECT n, r, tot, greatest({lk.LEAST_TAIL!r}, least({1 - lk.LEAST_TAIL!r}, {lk.cdf_sql(f)})) AS u FROM (SELECT n, r, tot, {z} AS z FROM c, k) q"
        each.append(f"SELECT '{f}' AS family, round(-any_value(tot) - sum(CAST(n AS DOUBLE) * (2 * r + n) * ln(u) + CAST(n AS DOUBLE) * (2 * tot - 2 * r - n) * ln(1 - u)) / any_value(tot), 3) AS statistic FROM ({u}) w")
    return f"{head} " + " UNION ALL ".join(each)


def _mmd_sql() -> str:
    w = ds.frequencies(1)[:, :, 0]
    values = ", ".join(f"({i}, {j}, {x!r})" for i, row in enumerate(w.tolist()) for j, x in enumerate(row))
    return (
        f"WITH o AS (SELECT run AS a, y AS b FROM ({VIEWS['cutoff']}) q), w(i, j, w) AS (VALUES {values}), d AS (SELECT i, j, pow(avg(cos(w * a)) - avg(cos(w * b)), 2) + pow(avg(sin(w * a)) - avg(sin(w * b)), 2) AS d FROM o, w GROUP BY i, j) "
        "SELECT round(sum(m), 6) AS mmd, round(sqrt(sum(v)), 6) AS std_error FROM (SELECT avg(d) AS m, var_samp(d) / count(*) AS v FROM d GROUP BY i) q"
    )


def _chisq_sql(given: tuple[str, ...]) -> str:
    z = ", ".join(given) or "0"
    name = "_".join(given) or "none"
    body = (
        f"SELECT a, b, z, coalesce(n, 0) AS n, na * nb / CAST(nz AS DOUBLE) AS e, (ka - 1) * (kb - 1) / (ka * kb)::DOUBLE AS f FROM (SELECT a, z, sum(n) AS na FROM c GROUP BY a, z) r JOIN (SELECT b, z, sum(n) AS nb FROM c GROUP BY b, z) k USING (z) "
        "JOIN (SELECT z, sum(n) AS nz, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c GROUP BY z) t USING (z) LEFT JOIN c USING (a, b, z)"
    )
    stat = f"WITH c AS (SELECT s AS a, t AS b, ROW({z}) AS z, count(*) AS n FROM ({VIEWS['confounded']}) v GROUP BY ALL) SELECT sum(pow(n - e, 2) / e) AS q, CAST(round(sum(f)) AS INT) AS df FROM ({body}) g"
    # Wilson and Hilferty's normal approximation is far from deciding at these statistics
    return f"SELECT * FROM (SELECT '{','.join(given)}' AS given, round(q, 6) AS statistic, df, (pow(q / df, 1 / 3e0) - 1 + 2 / (9e0 * df)) / sqrt(2 / (9e0 * df)) < 1.644853627e0 AS independent FROM ({stat}) s_{name}) q_{name}"


def _bic_sql() -> str:
    out = []
    for i, p in enumerate(([], ["s"], ["s", "t"], ["s", "t", "x1"])):
        out.append(f"SELECT * FROM ({swept('confounded', p, ['y'])} SELECT 'y' AS node, '{','.join(p)}' AS parents, round(-(count(*) / 2e0) * ln(sum(y * y) / count(*)) - {len(p)} / 2e0 * ln(count(*)), 3) AS score FROM r) q{i}")
    return " UNION ALL ".join(out)


def oracle() -> dict[str, str]:
    v = VIEWS
    corr_columns = ["size", "reg0", "reg1", "price", "price_copy"]
    complete = f"SELECT * FROM ({v['dirty']}) a WHERE size IS NOT NULL"
    encoded = lambda c: f"CASE WHEN (SELECT count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) FROM ({complete}) q) <= 0.05 THEN CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS VARCHAR) ELSE {c} END AS {c}"
    x, dx, d = "run - 2.5e0", "CASE WHEN run >= 2.5e0 THEN run - 2.5e0 ELSE 0e0 END", "CASE WHEN run >= 2.5e0 THEN 1e0 ELSE 0e0 END"
    rdd = f"SELECT {x} AS x, {dx} AS dx, {d} AS d, y FROM ({v['cutoff']}) a"
    tri = f"SELECT * FROM (SELECT {x} AS x, {dx} AS dx, {d} AS d, y, greatest(0e0, 1 - abs({x}) / 0.5e0) AS w FROM ({v['cutoff']}) a WHERE abs({x}) <= 0.5e0) b WHERE w > 0"
    scored = f"SELECT *, greatest(1e-3, least(1 - 1e-3, avg(t) OVER (PARTITION BY s))) AS p FROM ({v['confounded']}) a"
    weeks = ", ".join(f"CASE WHEN p = {k} THEN 1e0 ELSE 0e0 END AS p{k}" for k in range(1, 5))
    demeaned = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY g) AS {c}" for c in ("y", "t", "p1", "p2", "p3", "p4"))
    twfe = f"SELECT {demeaned} FROM (SELECT g, t, y, {weeks} FROM ({v['panel']}) a) b"
    groups = f"(SELECT count(DISTINCT g) FROM ({v['panel']}) a)"
    iv = f"{swept('instrumented', ['x'], ['z1', 'z2', 't', 'y'])}, k AS (SELECT z1, t, y, z2 - z1 * (sum(z1 * z2) OVER () / sum(z1 * z1) OVER ()) AS z2 FROM r), h AS (SELECT *, z1 * (sum(z1 * t) OVER () / sum(z1 * z1) OVER ()) + z2 * (sum(z2 * t) OVER () / sum(z2 * z2) OVER ()) AS f FROM k), e AS (SELECT *, y - t * (sum(f * y) OVER () / sum(f * t) OVER ()) AS e FROM h)"
    pairs = lambda names: [(a, b) for j, b in enumerate(names) for a in names[:j]]
    ols_t = lambda sweep, y: f"{swept('mediated', sweep, ['q', 'y'], base=y)} SELECT sum(q * y) / sum(q * q) AS b, (sum(y * y) - sum(q * y) * sum(q * y) / sum(q * q)) / (count(*) - {len(sweep) + 2}) / sum(q * q) AS v, count(*) AS n FROM r"
    a_sql, b_sql = ols_t([], f"SELECT t AS q, m AS y FROM ({v['mediated']}) a"), ols_t(["t"], f"SELECT t, m AS q, y FROM ({v['mediated']}) a")
    bins = "SELECT run AS x, min(run) OVER () AS lo, max(run) OVER () AS hi, avg(run) OVER () AS m, stddev_pop(run) OVER () AS s, median(run) OVER () AS md FROM o"
    stats = f"o AS (SELECT run FROM ({v['cutoff']}) a), q AS ({bins}), l AS (SELECT avg(abs(x - md)) AS d FROM q), g AS (SELECT i, any_value(lo) lo, any_value(hi) hi, any_value(m) m, any_value(s) s, any_value(md) md FROM q, range(100) t(i) GROUP BY i), c AS (SELECT least(99, CAST(floor((x - lo) / (hi - lo) * 100) AS INT)) AS i, count(*) AS n FROM q GROUP BY 1), f AS (SELECT lo + (g.i + 0.5e0) * (hi - lo) / 100 AS x, lo, m, s, md, d, coalesce(n, 0) / ((SELECT count(*) FROM o) * (hi - lo) / 100) AS h FROM g LEFT JOIN c ON g.i = c.i, l)"
    fisher = lambda a, b, c: f"SELECT '{a}' AS a, '{b}' AS b, '' AS given, round(sqrt(n - 3) * atanh(r{a}{b}), 6) AS z FROM k UNION ALL SELECT '{a}', '{b}', '{c}', round(sqrt(n - 4) * atanh((r{a}{b} - r{min(a, c)}{max(a, c)} * r{min(b, c)}{max(b, c)}) / sqrt((1 - r{min(a, c)}{max(a, c)} * r{min(a, c)}{max(a, c)}) * (1 - r{min(b, c)}{max(b, c)} * r{min(b, c)}{max(b, c)}))), 6) FROM k"
    cov_names = ["s", "t", "x1", "x2", "y"]
    out = {
        "scan_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS missing FROM lineitem" for c in PROFILE),
        "prep_missing_profile": f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(size) AS BIGINT) AS n_missing, (count(*) - count(size)) / CAST(count(*) AS DOUBLE) AS share FROM ({v['dirty']}) a",
        "prep_drop_missing": f"SELECT id, size, p_brand, yn FROM ({complete}) a",
        "prep_impute_mean": f"SELECT id, round(coalesce(CAST(size AS DOUBLE), avg(size) OVER ()), 6) AS size FROM ({v['heavy']}) a",
        "prep_impute_mode": f"WITH v AS ({v['heavy']}), m AS (SELECT kind AS mode FROM v WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) SELECT id, coalesce(kind, mode) AS kind FROM v, m",
        "prep_handle_missing": f"WITH v AS ({v['heavy']}), m AS (SELECT kind AS mode FROM v WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) SELECT id, round(coalesce(CAST(size AS DOUBLE), avg(size) OVER ()), 6) AS size, coalesce(kind, mode) AS kind FROM v, m",
        "prep_cardinality": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) AS share, count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) <= 0.05 AS encode FROM ({v['dirty']}) a" for c in ("p_name", "p_brand", "p_type", "yn")),
        "prep_bool_encode": f"SELECT id, CASE WHEN lower(trim(yn)) = 'yes' THEN 1 ELSE 0 END AS yn FROM ({v['dirty']}) a",
        "prep_label_encode": f"SELECT id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS p_type FROM ({v['dirty']}) a",
        "prep_codebook": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (SELECT DISTINCT {c} AS value FROM part) q_{c}" for c in ("p_type", "p_brand")),
        "prep_corr_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ({complete}) a" for a, b in pairs(corr_columns)),
        "prep_corr_drop": f"SELECT DISTINCT b AS \"column\" FROM ({' UNION ALL '.join(f"SELECT '{b}' AS b, abs(corr({a}, {b})) AS r FROM ({complete}) a" for a, b in pairs(['reg0', 'reg1', 'reg2', 'price', 'price_copy']))}) q WHERE r > 0.9",
        "prep_dummy_drop": "SELECT * FROM (VALUES ('id'), ('p_name'), ('p_brand'), ('p_type'), ('size'), ('yn'), ('price'), ('price_copy')) q(\"column\")",
        "prep_full": f"SELECT CAST(id AS DOUBLE) AS id, {encoded('p_name')}, {encoded('p_brand')}, {encoded('p_type')}, CAST(size AS DOUBLE) AS size, CASE WHEN lower(trim(yn)) = 'yes' THEN 1e0 ELSE 0e0 END AS yn, CAST(price AS DOUBLE) AS price FROM ({complete}) a",
        "likelihood_mle": f"WITH v AS (SELECT run AS x, median(run) OVER () AS md FROM ({v['cutoff']}) a), k AS (SELECT avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(md) AS md, avg(abs(x - md)) AS d FROM v) SELECT 'run' AS \"column\", 'norm' AS family, round(m, 6) AS loc, round(s, 6) AS scale FROM k UNION ALL SELECT 'run', 'expon', round(lo, 6), round(m - lo, 6) FROM k UNION ALL SELECT 'run', 'laplace', round(md, 6), round(d, 6) FROM k",
        "likelihood_sse": f"WITH {stats} SELECT 'norm' AS family, round(sum(pow(exp(-(x - m) * (x - m) / (2 * s * s)) / (s * sqrt(2 * pi())) - h, 2)), 6) AS sse FROM f UNION ALL SELECT 'expon', round(sum(pow(CASE WHEN x >= lo THEN exp(-(x - lo) / (m - lo)) / (m - lo) ELSE 0 END - h, 2)), 6) FROM f UNION ALL SELECT 'laplace', round(sum(pow(exp(-abs(x - md) / d) / (2 * d) - h, 2)), 6) FROM f",
        "pc_fisherz_stats": f"WITH k AS (SELECT count(*) AS n, corr(s, t) AS rst, corr(s, y) AS rsy, corr(t, y) AS rty FROM ({v['confounded']}) a) " + " UNION ALL ".join(fisher(*e) for e in (("s", "t", "y"), ("s", "y", "t"), ("t", "y", "s"))),
        "ges_local_bic": _bic_sql(),
        "lingam_moments": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(ln((exp(u) + exp(-u)) / 2)), 6) AS log_cosh, round(avg(u * exp(-u * u / 2)), 6) AS gauss FROM (SELECT ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS u FROM ({v['confounded']}) a) q{c}" for c in ("t", "y")),
        "cov_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS cov FROM ({v['confounded']}) q" for i, a in enumerate(cov_names) for b in cov_names[i:]),
        "likelihood_ad_stat": _ad_sql(),
        "likelihood_quantiles": " UNION ALL ".join(f"SELECT {q}e0 AS share, round(quantile_cont(run, {q}), 6) AS value FROM ({v['cutoff']}) q" for q in (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)),
        "mmd_rbf": _mmd_sql(),
        "pc_chisq_stats": " UNION ALL ".join(_chisq_sql(z) for z in ((), ("fold3",), ("fold", "fold3"))),
        "graph_closure": f"WITH RECURSIVE e AS ({CUSTOMERS}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c",
        "dsep_table": f"WITH e AS ({PLACES}), n AS (SELECT DISTINCT src AS x, src AS root FROM e UNION ALL SELECT dst, src FROM e), z AS (SELECT '' AS given UNION ALL SELECT x FROM n) SELECT a.x AS x, b.x AS y, given, a.root <> b.root OR (given = a.root AND a.x <> a.root AND b.x <> b.root) AS separated FROM n a JOIN n b ON a.x < b.x JOIN z ON given NOT IN (a.x, b.x)",
        "intent_rule_based": f"SELECT r_name, 'l_discount' AS treatment, 'l_extendedprice' AS outcome FROM ({QUESTIONS}) q",
        "est_ols": effect_sql("priced", "OLS", "ATE", "t", "t", "y", ["x1", "x2", "x3"]),
        "est_rct": effect_sql("priced", "RCT", "ATE", "t", "t", "y", []),
        "est_iv_wald": f"SELECT 'IV' AS method, 'LATE' AS estimand, 't' AS term, round(covar_pop(z1, y) / covar_pop(z1, t), 6) AS estimate, CAST(NULL AS DOUBLE) AS std_error, CAST(count(*) AS BIGINT) AS n FROM ({v['instrumented']}) a",
        "est_iv_2sls": f"{iv} SELECT 'IV' AS method, 'LATE' AS estimand, 't' AS term, round(sum(f * y) / sum(f * t), 6) AS estimate, round(sqrt(sum(e * e * f * f)) / sum(f * f), 6) AS std_error, CAST(count(*) AS BIGINT) AS n FROM e",
        "est_did_2x2": f"SELECT 'DiD' AS method, 'ATT' AS estimand, 'treated:after' AS term, round((avg(y) FILTER (g % 2 = 0 AND p >= 2) - avg(y) FILTER (g % 2 = 0 AND p < 2)) - (avg(y) FILTER (g % 2 = 1 AND p >= 2) - avg(y) FILTER (g % 2 = 1 AND p < 2)), 6) AS estimate, CAST(NULL AS DOUBLE) AS std_error, CAST(count(*) AS BIGINT) AS n FROM ({v['panel']}) a",
        "est_did_twfe": effect_sql("", "DiD", "ATT", "t", "t", "y", ["p1", "p2", "p3", "p4"], base=twfe, df=f"(count(*) - {groups} - 5)"),
        "est_rdd_linear": effect_sql("", "RDD", "LATE", "above", "d", "y", ["x", "dx"], base=rdd),
        "est_rdd_triangular": effect_sql("", "RDD", "LATE", "above", "d", "y", ["x", "dx"], base=tri, weight="w"),
        "rdd_diagnose_stats": f"WITH v AS (SELECT *, run - 2.5e0 AS x, stddev_samp(run) OVER () AS sd FROM ({v['cutoff']}) a), k AS (SELECT avg(t) FILTER (x >= 0) AS t1, avg(t) FILTER (x < 0) AS t0, avg(CASE WHEN x >= 0 THEN 1e0 ELSE 0e0 END) AS s, avg(t) AS mt, CAST(count(*) FILTER (x >= 0 AND x < 0.02 * sd) AS DOUBLE) AS b1, CAST(count(*) FILTER (x < 0 AND x >= -0.02 * sd) AS DOUBLE) AS b0, CAST(count(*) FILTER (abs(x) <= 0.25 * sd) AS DOUBLE) AS near, count(*) FILTER (x >= 0) AS n1, count(*) FILTER (x < 0) AS n0, avg(c1) FILTER (x >= 0) AS m1, avg(c1) FILTER (x < 0) AS m0, var_samp(c1) FILTER (x >= 0) AS v1, var_samp(c1) FILTER (x < 0) AS v0 FROM v) SELECT 'sharpness' AS test, round(abs(t1 - t0), 6) AS statistic FROM k UNION ALL SELECT 'assigned_minus_treated', round(abs(s - mt), 6) FROM k UNION ALL SELECT 'bunching', round(CASE WHEN greatest(b1, b0) > 0 THEN abs(b1 - b0) / greatest(b1, b0) ELSE 0e0 END, 6) FROM k UNION ALL SELECT 'rows_near_cutoff', near FROM k UNION ALL SELECT 'balance_c1', round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1e0 / n1 + 1e0 / n0)), 6) FROM k",
        "est_ipw": f"WITH v AS ({scored}), e AS (SELECT t, t * y / p - (1 - t) * y / (1 - p) AS a, (t - p) * y / p AS r, (t - (1 - t) * p / (1 - p)) * y AS w FROM v), k AS (SELECT *, sum(w) OVER () / sum(t) OVER () AS th, avg(t) OVER () AS sh FROM e) SELECT 'Propensity Score' AS method, 'ATE' AS estimand, 't' AS term, round(avg(a), 6) AS estimate, round(stddev_samp(a) / sqrt(count(*)), 6) AS std_error, CAST(count(*) AS BIGINT) AS n FROM k UNION ALL SELECT 'Propensity Score', 'ATT', 't', round(any_value(th), 6), round(sqrt(avg(pow(w - th * t, 2)) / pow(any_value(sh), 2) / count(*)), 6), CAST(count(*) AS BIGINT) FROM k UNION ALL SELECT 'Propensity Score', 'ATT_ref', 't', round(avg(r), 6), round(stddev_samp(r) / sqrt(count(*)), 6), CAST(count(*) AS BIGINT) FROM k",
        "est_ipw_hajek": effect_sql("", "Propensity Score", "ATE_hajek", "t", "t", "y", [], base=f"SELECT t, y, t / p + (1 - t) / (1 - p) AS w FROM ({scored}) b", weight="w"),
        "est_dml_linear": f"WITH {_dml_sql('fold')} SELECT 'DML' AS method, 'ATE' AS estimand, 't' AS term, round(any_value(th), 6) AS estimate, round(sqrt(avg(pow(v * (u - th * v), 2)) / pow(avg(v * v), 2) / count(*)), 6) AS std_error, CAST(count(*) AS BIGINT) AS n FROM e, h",
        "est_aipw": f"WITH v AS ({v['confounded']}), c AS (SELECT s, fold, count(*) AS n, sum(t) AS n1, sum(t * y) AS y1, sum((1 - t) * y) AS y0 FROM v GROUP BY s, fold), o AS (SELECT s, fold, sum(n) OVER w - n AS n, sum(n1) OVER w - n1 AS n1, sum(y1) OVER w - y1 AS y1, sum(y0) OVER w - y0 AS y0 FROM c WINDOW w AS (PARTITION BY s)), e AS (SELECT y1 / n1 - y0 / (n - n1) + t * (y - y1 / n1) / greatest(1e-3, least(1 - 1e-3, n1 / n)) - (1 - t) * (y - y0 / (n - n1)) / (1 - greatest(1e-3, least(1 - 1e-3, n1 / n))) AS psi FROM v JOIN o USING (s, fold)) SELECT 'AIPW' AS method, 'ATE' AS estimand, 't' AS term, round(avg(psi), 6) AS estimate, round(stddev_samp(psi) / sqrt(count(*)), 6) AS std_error, CAST(count(*) AS BIGINT) AS n FROM e",
        "est_gcomp_ate": effect_sql("confounded", "G Computation", "ATE", "t", "t", "y", ["s"], se=False),
        "est_gcomp_att": f"SELECT method, 'ATT' AS estimand, term, estimate, std_error, (SELECT CAST(sum(t) AS BIGINT) FROM ({v['confounded']}) b) AS n FROM ({effect_sql('confounded', 'G Computation', 'ATT', 't', 't', 'y', ['s'], se=False)}) a",
        "est_frontdoor_linear": f"SELECT 'Frontdoor Adjustment' AS method, 'ATE' AS estimand, 't' AS term, round(a.b * c.b, 6) AS estimate, round(sqrt(a.b * a.b * c.v + c.b * c.b * a.v), 6) AS std_error, CAST(a.n AS BIGINT) AS n FROM ({a_sql}) a, ({b_sql}) c",
        "est_frontdoor_plugin": f"WITH v AS ({v['mediated']}), k AS (SELECT sum(t) AS n1, count(*) - sum(t) AS n0, count(*) AS n FROM v), c AS (SELECT m2, sum(t) AS c1, count(*) - sum(t) AS c0, avg(y) FILTER (t = 1) AS y1, avg(y) FILTER (t = 0) AS y0 FROM v GROUP BY m2) SELECT 'Frontdoor Adjustment' AS method, 'ATE_plugin' AS estimand, 't' AS term, round(sum((c1 / n1 - c0 / n0) * (coalesce(y1, y0) * n1 / n + coalesce(y0, y1) * n0 / n)), 6) AS estimate, CAST(NULL AS DOUBLE) AS std_error, CAST(any_value(n) AS BIGINT) AS n FROM c, k",
        "diag_positivity": f"SELECT 'positivity' AS test, round(avg(CASE WHEN p BETWEEN 0.05 AND 0.95 THEN 1e0 ELSE 0e0 END), 6) AS statistic, avg(CASE WHEN p BETWEEN 0.05 AND 0.95 THEN 1e0 ELSE 0e0 END) > 0.9 AS passed FROM ({scored}) a",
        "diag_lead_interactions": _lead_sql("parallel_trends"),
        "diag_no_anticipation": _lead_sql("no_anticipation"),
        "diag_rdd_continuity": t_sql("", "rdd_continuity", "d", "y", ["x", "dx"], rdd),
        "diag_iv_first_stage_f": f"{swept('instrumented', ['x'], ['z1', 'z2', 't'])}, k AS (SELECT z1, t, z2 - z1 * (sum(z1 * z2) OVER () / sum(z1 * z1) OVER ()) AS z2 FROM r), s AS (SELECT pow(sum(z1 * t), 2) / sum(z1 * z1) + pow(sum(z2 * t), 2) / sum(z2 * z2) AS ess, sum(t * t) AS rss, count(*) - 4 AS df FROM k) SELECT 'iv_strength' AS test, round(ess / 2 / ((rss - ess) / df), 6) AS statistic, CAST(df AS DOUBLE) AS df2, ess / 2 / ((rss - ess) / df) > 10 AS passed FROM s",
        "diag_sargan": f"SELECT 'iv_overid' AS test, statistic, statistic < 3.841458821e0 AS passed FROM ({iv} SELECT round(count(*) * (pow(sum(z1 * e), 2) / sum(z1 * z1) + pow(sum(z2 * e), 2) / sum(z2 * z2)) / sum(e * e), 6) AS statistic FROM e) q",
        "diag_mediation": t_sql("mediated", "complete_mediation", "t", "y", ["m", "s"]),
        "diag_mediator_backdoor": t_sql("", "mediator_backdoor_m_s", "q", "y", [], f"SELECT CAST(s AS DOUBLE) AS q, m AS y FROM ({v['mediated']}) a"),
        "diag_dml_stability": "SELECT 'dml_stability' AS test, round(stddev_pop(th), 6) AS statistic, stddev_pop(th) < 0.1 AS passed FROM (" + " UNION ALL ".join(f"SELECT * FROM (WITH {_dml_sql(e)} SELECT th FROM h) a{i}" for i, e in enumerate(DIVISIONS)) + ") c",
        "diag_gcomp_rmse": f"{swept('confounded', ['s', 't'], ['y'])} SELECT 'gcomp_rmse' AS test, round(sqrt(sum(y * y) / count(*)), 6) AS statistic, sqrt(sum(y * y) / count(*)) < 0.5 * (SELECT stddev_samp(y) FROM ({v['confounded']}) a) AS passed FROM r",
        "engine_iv": f"{swept('conditional', ['x'], ['z', 't', 'y'])}, h AS (SELECT *, z * (sum(z * t) OVER () / sum(z * z) OVER ()) AS f FROM r), e AS (SELECT *, y - t * (sum(f * y) OVER () / sum(f * t) OVER ()) AS e FROM h) SELECT 'IV' AS method, 'LATE' AS estimand, 't' AS term, round(sum(f * y) / sum(f * t), 6) AS estimate, round(sqrt(sum(e * e * f * f)) / sum(f * f), 6) AS std_error, CAST(count(*) AS BIGINT) AS n FROM e",
        "engine_did": effect_sql("", "DiD", "ATT", "t", "t", "y", ["p1", "p2", "p3", "p4"], base=twfe, df=f"(count(*) - {groups} - 5)"),
        "engine_rdd": effect_sql("", "RDD", "LATE", "above", "d", "y", ["x", "dx"], base=rdd),
        "engine_answer": effect_sql("confounded", "OLS", "ATE", "t", "t", "y", ["s"]),
    }
    # squared predictions of the first regression, swept of its columns like the residual
    out["diag_reset"] = (
        f"WITH v AS (SELECT CAST(s AS DOUBLE) AS s, x1, y, y AS e FROM ({v['confounded']}) a), c0 AS (SELECT s - avg(s) OVER () AS s, x1 - avg(x1) OVER () AS x1, y - avg(y) OVER () AS y, e - avg(e) OVER () AS e FROM v), "
        "c1 AS (SELECT s, x1 - s * (sum(s * x1) OVER () / sum(s * s) OVER ()) AS x1, y, e - s * (sum(s * e) OVER () / sum(s * s) OVER ()) AS e FROM c0), c2 AS (SELECT s, x1, y, e - x1 * (sum(x1 * e) OVER () / sum(x1 * x1) OVER ()) AS e FROM c1), "
        "d0 AS (SELECT s, x1, e, pow(y - e, 2) - avg(pow(y - e, 2)) OVER () AS q FROM c2), d1 AS (SELECT x1, e, q - s * (sum(s * q) OVER () / sum(s * s) OVER ()) AS q FROM d0), d2 AS (SELECT e, q - x1 * (sum(x1 * q) OVER () / sum(x1 * x1) OVER ()) AS q FROM d1), "
        "k AS (SELECT pow(sum(q * e), 2) / sum(q * q) AS ess, sum(e * e) AS rss, count(*) - 4 AS df FROM d2) SELECT 'linearity' AS test, round(ess / ((rss - ess) / df), 6) AS statistic, CAST(df AS DOUBLE) AS df2, sqrt(ess / ((rss - ess) / df)) < " + critical_t("df") + " AS passed FROM k"
    )
    out["diag_dwh"] = (
        f"WITH v AS ({v['instrumented']}), a0 AS (SELECT x - avg(x) OVER () AS x, z1 - avg(z1) OVER () AS z1, z2 - avg(z2) OVER () AS z2, t - avg(t) OVER () AS t, y - avg(y) OVER () AS y FROM v), "
        "a1 AS (SELECT " + ", ".join(f"{c} - x * (sum(x * {c}) OVER () / sum(x * x) OVER ()) AS {c}" for c in ("z1", "z2", "t", "y")) + " FROM a0), "
        "a2 AS (SELECT z1, t, y, z2 - z1 * (sum(z1 * z2) OVER () / sum(z1 * z1) OVER ()) AS z2 FROM a1), a3 AS (SELECT t, y, t - z1 * (sum(z1 * t) OVER () / sum(z1 * z1) OVER ()) - z2 * (sum(z2 * t) OVER () / sum(z2 * z2) OVER ()) AS w FROM a2), "
        "r AS (SELECT w - t * (sum(t * w) OVER () / sum(t * t) OVER ()) AS w, y - t * (sum(t * y) OVER () / sum(t * t) OVER ()) AS y FROM a3) "
        "SELECT 'exogeneity' AS test, round(t, 6) AS statistic, CAST(df AS DOUBLE) AS df2, abs(t) < " + critical_t("df") + " AS passed FROM (SELECT count(*) - 4 AS df, sum(w * y) / sum(w * w) / sqrt((sum(y * y) - pow(sum(w * y), 2) / sum(w * w)) / (count(*) - 4) / sum(w * w)) AS t FROM r) q"
    )
    return out
