"""Registered feature, statistics and model queries, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions import names
from fundlens.ml import anomaly, drift, evaluate, features, isotonic, model, preprocess, reduce, resample, select, sparse_svd, trees
from fundlens.operators import ordering
from fundlens.operators.fold import consolidate
from fundlens.plans import views
from fundlens.plans.oracle_views import ORDER, ORGANIZATIONS, PROJECTS, SCORED, VOCABULARY
from fundlens.plans.views import table
from fundlens.session import materialize, run_dir, spread
from fundlens.sources import tables
from fundlens.text.documents import confidence, predicted_label

SMALL = model.Params(trees=10, depth=3, rate=0.1, pos_weight=2.0)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(views.store(spark, sf_dir), lists=features.MODEL_LISTS)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.prepare_features(_wide(spark, sf_dir))


def features_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepared(spark, sf_dir)
    lists = [c for c in features.MULTILABEL if c != "euroSciVoc_intermediate"]
    return df.select(
        "id", "label", "title", "objective", "durationDays", "n_partners", "n_country", "n_sme",
        *[F.array_join(c, "|").alias(c) for c in lists],
    )


def features_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("id", F.explode("euroSciVoc_intermediate").alias("level"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.labelled(views.projects(spark, sf_dir)).withColumn(
        "durationDays", F.datediff("endDate", "startDate")
    )


AMOUNTS = ["totalCost", "ecMaxContribution", "durationDays"]


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.exact_medians(materialize(_amounts(spark, sf_dir).select(*AMOUNTS)), AMOUNTS)


def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(_amounts(spark, sf_dir).select("id", *AMOUNTS))
    fitted = preprocess.fit_preprocessor(df, AMOUNTS, [], [])
    scaled = fitted.scaled(df).select("id", *AMOUNTS)
    return ordering.melt(scaled, AMOUNTS, ["id"]).withColumn("value", F.round("value", 6))


def stored_preprocessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scaled amounts by fitted steps that were written and read again."""
    df = materialize(_amounts(spark, sf_dir).select("id", *AMOUNTS))
    path = f"{run_dir(spark)}/preprocessor_{uuid.uuid4().hex}"
    preprocess.fit_preprocessor(df, AMOUNTS, [], []).save(spark, path)
    scaled = preprocess.load_preprocessor(spark, path).scaled(df).select("id", *AMOUNTS)
    return ordering.melt(scaled, AMOUNTS, ["id"]).withColumn("value", F.round("value", 6))


def training_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared features, written as CSV (lists as JSON text) and read again."""
    lists = [c for c in features.MULTILABEL if c != "euroSciVoc_intermediate"]
    plain = ["id", "label", "title", "objective", "durationDays", "n_partners", "n_country", "n_sme"]
    df = _prepared(spark, sf_dir).select(*plain, *lists)
    path = f"{run_dir(spark)}/snapshot_{uuid.uuid4().hex}"
    tables.write_csv(df, path)
    kinds = ", ".join(f"`{f.name}` {'string' if f.name in lists else f.dataType.simpleString()}" for f in df.schema.fields)
    read = spark.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    text = lambda c: F.array_join(F.from_json(c, "array<string>"), "|").alias(c)
    return read.select(*plain, *[text(c) for c in lists])


def isotonic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of returned lines as an increasing function of the quantity."""
    lines = table(spark, sf_dir, "lineitem")
    blocks = isotonic.fit_blocks(lines, F.col("l_quantity"), (F.col("l_returnflag") == "R").cast("int"))
    return blocks.select("low", "high", F.round("value", 9).alias("share"), F.col("weight").cast("long").alias("n_lines"))


def onehot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set entries per one-hot column of the assembled vector."""
    df = _amounts(spark, sf_dir)
    fitted = preprocess.fit_preprocessor(df, [], features.CATEGORICAL, [])
    return _entry_counts(fitted, df)


def _entry_counts(fitted: preprocess.Preprocessor, df: DataFrame) -> DataFrame:
    """Sums of all columns in one pass; only the one result row is taken apart."""
    sums = fitted.transform(df).select(Summarizer.metrics("sum").summary(F.col("features")).alias("s"))
    pairs = sums.select(F.inline(trees.named_pairs(vector_to_array("s.sum"), fitted.names)))
    return pairs.select(F.col("name").alias("feature"), F.col("value").cast("long").alias("n"))


def multilabel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(_prepared(spark, sf_dir))
    return _entry_counts(preprocess.fit_preprocessor(df, [], [], features.MULTILABEL), df)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.labelled(views.projects(spark, sf_dir)).select("id", "label")
    shares = [1 - model.TEST_SHARE, model.TEST_SHARE]
    return ordering.stratified_slices(df, "id", "label", shares, model.SEED)


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.with_folds(features.labelled(views.projects(spark, sf_dir)).select("id", "label"))


def _vector_rows(spark: SparkSession, sf_dir: str, constants: bool = False) -> DataFrame:
    """Embedding vectors with label 1 for class 0; ``constants`` appends two constant entries."""
    rows = table(spark, sf_dir, "embeddings")
    values = F.col("embedding").cast("array<double>")
    if constants:
        values = F.concat(values, F.array(F.lit(0.0), F.lit(1.0)))
    return rows.select(
        F.col("vec_id").alias("id"),
        (F.col("label") == 0).cast("int").alias("label"),
        array_to_vector(values).alias("features"),
    )


def _dims(n: int) -> list[str]:
    return [f"d{i}" for i in range(n)]


def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = select.ranking(spark, _vector_rows(spark, sf_dir, True), _dims(66))
    return ranked.filter("variance > 0").select("feature", F.round("variance", 9).alias("variance"))


def anova_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vector_rows(spark, sf_dir, True)
    kept = select.chosen_names(_dims(66), select.choose(df, 20))
    ranked = select.ranking(spark, df, _dims(66)).filter(F.col("feature").isin(kept))
    return ranked.select("feature", F.round("f", 6).alias("f"))


def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = evaluate.report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rated.select(
        "class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


def readable_feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of table values, in each of the forms that the feature steps produce."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    joined = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    kind = F.replace("p_name", F.lit(" "), F.lit("_"))
    made = F.array(
        joined("cat__p_type__", kind),
        joined("num__n_", kind),
        joined("mlb_list_", F.col("p_type"), "__list_", F.col("p_type"), "_", kind),
        joined("mlb_list_", F.col("p_type"), "__list_", kind),
        joined("mlb_", kind, "__", F.col("p_brand")),
        joined("mlb_list_", kind),
        joined("cat__", F.col("p_brand")),
        joined(kind, "__", F.col("p_brand")),
    )
    raw = part.select(F.explode(made).alias("raw")).unionByName(
        orders.select(joined("cat__fundingScheme_", F.col("o_orderpriority")).alias("raw"))
    )
    return raw.distinct().select("raw", names.readable_name("raw").alias("name"))


def top6_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six line-item measures that lie farthest from a fixed middle, out of eight."""
    lines = table(spark, sf_dir, "lineitem")
    measures = {
        "quantity": F.col("l_quantity") - 25,
        "price": F.col("l_extendedprice") / 1000 - 50,
        "discount": F.col("l_discount") * 100 - 5,
        "tax": F.col("l_tax") * 100 - 4,
        "line": F.col("l_linenumber") - 4.0,
        "part": F.col("l_partkey") % 101 - 50.0,
        "supplier": F.col("l_suppkey") % 41 - 20.0,
        "order": F.col("l_orderkey") % 31 - 15.0,
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in measures.items()])
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *names.top_contributions(pairs))


def displayed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.projects(spark, sf_dir).select("id", *views.scored_columns())
    return scored.select(
        "id", predicted_label().alias("label"), F.round(confidence(), 6).alias("confidence")
    )


def finished_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored stand-in table with readable names and rounded numbers."""
    scored = views.projects(spark, sf_dir).select("id", *views.scored_columns())
    noisy = scored.withColumn("predicted_prob", F.col("predicted_prob") + 0.00001).withColumn(
        "title_embed_0", F.lit(1.0)
    )
    return names.finish_scored(noisy)


def _two_periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.filter(day), orders.filter(~day)


def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = drift.ks_test(*_two_periods(spark, sf_dir), ["o_totalprice", "o_custkey"])
    return tests.select("feature", F.round("statistic", 9).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def drift_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = drift.chi2_test(*_two_periods(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])
    return tests.select(
        "feature", F.round("statistic", 6).alias("statistic"), "freedom", F.round("p_value", 6).alias("p_value")
    )


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _two_periods(spark, sf_dir)
    ks = drift.ks_test(before, after, ["o_totalprice", "o_custkey"]).select("feature", "p_value")
    chi = drift.chi2_test(before, after, ["o_orderstatus", "o_orderpriority"]).select("feature", "p_value")
    return drift.verdict(ks.unionByName(chi))


def drift_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.wasserstein(*_two_periods(spark, sf_dir), ["o_totalprice", "o_custkey"])
    return found.select("feature", F.round("distance", 4).alias("distance"))


def drift_jensen_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.jensen_shannon(*_two_periods(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])
    return found.select("feature", F.round("distance", 9).alias("distance"))


def sparse_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each document's TF-IDF in the 50 leading directions of 65,536 columns."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    rows = sparse_svd.with_components(docs, "text", sparse_svd.fit_sparse_basis(docs, "text"))
    length = F.sqrt(F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("id", F.round(length, 6).alias("length"))


def svd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = views.projects(spark, sf_dir).select("id", "title")
    return reduce.add_text_features(projects, reduce.fit_text_bases(projects, ["title"], 10)).drop("title")


def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vector_rows(spark, sf_dir)
    forest = anomaly.fit_forest(rows)
    score = forest.score_column("features")
    return rows.select("id", score.alias("score")).select("id", "score", (F.col("score") > 0).alias("outlier"))


def adasyn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vector_rows(spark, sf_dir).select("id", "label", vector_to_array("features").alias("embedding"))
    return resample.oversample(rows).select("id", "copy", "label", F.get("embedding", F.lit(0)).alias("first"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_vector_rows(spark, sf_dir).withColumn("selected", F.col("features")))


def train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the training split, report on the test split."""
    train, test = model.split(_selected(spark, sf_dir))
    params = model.Params(trees=20, depth=3, rate=0.2, pos_weight=8.0)
    fitted = model.classifier(params).fit(model.weighted(train, params))
    return evaluate.report(fitted.transform(test))


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = model.split(_selected(spark, sf_dir))
    fitted = model.fit_calibrated(train, SMALL)
    return fitted.transform(test).select("id", "label", "predicted_prob", "predicted_label")


def explain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six strongest contributions, and their full sum, for every row."""
    rows = _selected(spark, sf_dir)
    fitted = model.classifier(SMALL).fit(model.weighted(rows, SMALL))
    values = trees.contribution_column(fitted, vector_to_array("selected"))
    explained = rows.select("id", values.alias("contributions"))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return explained.select(
        "id", total.alias("total"), *names.top_contributions(trees.named_pairs("contributions", _dims(64)))
    )


def tuned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-validated F1 per sampled setting."""
    trials = [
        model.Params(trees=5, depth=2, rate=0.1, pos_weight=4.0),
        model.Params(trees=5, depth=3, rate=0.2, pos_weight=8.0),
    ]
    _, means = model.tune(_selected(spark, sf_dir), trials)
    rows = [(p.trees, p.depth, p.rate, p.pos_weight, float(m)) for p, m in zip(trials, means)]
    return spark.createDataFrame(rows, "trees int, depth int, rate double, pos_weight double, f1 double")


def status_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: train on finished projects, score every project, readable explanations."""
    wide = materialize(_wide(spark, sf_dir))
    training = model.train_status_model(wide, [model.Params(5, 3, 0.1, 2.0)], components=5, k=50, trees=50)
    scored = model.score_and_clean(wide, training.model)
    top = [c for i in range(1, 7) for c in (f"top{i}_feature", f"top{i}_shap")]
    return scored.select("id", "status", "predicted_label", "predicted_prob", *top)


def model_queries() -> dict:
    return {
        "features_prepared": features_prepared,
        "features_levels": features_levels,
        "feature_medians": medians,
        "impute_scale": impute_scale,
        "stored_preprocessor": stored_preprocessor,
        "training_snapshot": training_snapshot,
        "isotonic_shares": isotonic_shares,
        "onehot_counts": onehot_counts,
        "multilabel_counts": multilabel_counts,
        "stratified_split": stratified_split,
        "fold_assignment": fold_assignment,
        "variance_filter": variance_filter,
        "anova_topk": anova_topk,
        "confusion_counts": confusion_counts,
        "confusion_report": confusion_report,
        "readable_feature_names": readable_feature_names,
        "top6_contributions": top6_contributions,
        "displayed_confidence": displayed_confidence,
        "finished_scores": finished_scores,
        "drift_ks": drift_ks,
        "drift_chi2": drift_chi2,
        "drift_report": drift_report,
        "drift_wasserstein": drift_wasserstein,
        "drift_jensen_shannon": drift_jensen_shannon,
        "svd_features": svd_features,
        "sparse_components": sparse_components,
        "anomaly_scores": anomaly_scores,
        "adasyn_rows": adasyn_rows,
        "train_eval": train_eval,
        "calibrated_scores": calibrated_scores,
        "explain_scores": explain_scores,
        "tuned_search": tuned_search,
        "status_scores": status_scores,
    }


def _title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), "
        "lambda r: upper(r[1]) || r[2:]), '')"
    )


def model_oracles() -> dict[str, str]:
    labelled = (
        ", m AS (SELECT *, CASE WHEN status='CLOSED' THEN 0 ELSE 1 END AS label, "
        "datediff('day', startDate, endDate) AS durationDays FROM projects WHERE status IN ('CLOSED','TERMINATED'))"
    )
    base = "WITH " + ",".join([PROJECTS, ORGANIZATIONS, VOCABULARY]) + labelled
    text = lambda col, name: f"string_agg(upper({col}), '|' ORDER BY {ORDER}) AS {name}"
    lang = "CASE WHEN l_linenumber%3=0 THEN 'en,fr' WHEN l_linenumber%3=1 THEN 'de' END"
    lists = f""", o AS (SELECT projectID, count(*) AS n, CAST(count(*) FILTER (WHERE SME) AS BIGINT) AS n_sme,
  {text('country', 'list_country')}, {text('activityType', 'list_activityType')} FROM organizations GROUP BY 1),
v AS (SELECT projectID, {text('euroSciVocTitle', 'list_euroSciVocTitle')} FROM vocabulary GROUP BY 1),
w AS (SELECT l_orderkey, {text('l_returnflag', 'list_deliverableType')},
  replace({text(lang, 'x')[:-5]}, ',', '|') AS list_availableLanguages FROM lineitem GROUP BY 1)"""
    amounts = " UNION ALL ".join(f"SELECT id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM m" for c in AMOUNTS)
    classes = " UNION ALL ".join(
        f"SELECT 'cat__{c}_' || coalesce({c}, 'missing') AS feature FROM m" for c in features.CATEGORICAL
    )
    pair = lambda c, child, value: (
        f"SELECT DISTINCT id, 'mlb_{c}__{c}_' || upper({value}) AS feature FROM m JOIN {child} ON projectID=id "
        f"WHERE {value} IS NOT NULL"
    )
    lines = "(SELECT l_orderkey AS projectID, * FROM lineitem)"
    multi = " UNION ALL ".join(
        [
            pair("list_country", "organizations", "country"),
            pair("list_activityType", "organizations", "activityType"),
            pair("list_deliverableType", lines, "l_returnflag"),
            pair("list_availableLanguages", f"(SELECT l_orderkey AS projectID, unnest(string_split({lang}, ',')) AS x FROM lineitem)", "x"),
            pair("list_euroSciVocTitle", "vocabulary", "euroSciVocTitle"),
            pair("euroSciVoc_intermediate", "(SELECT projectID, unnest([split_part(euroSciVocPath,'/',2), split_part(euroSciVocPath,'/',3)]) AS x FROM vocabulary)", "x"),
        ]
    )
    ranked = (
        "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}-' || id), id) - 1 AS r, "
        "count(*) OVER (PARTITION BY label) AS n FROM m"
    )
    third = lambda i: f"round(n*({i}/3.0::DOUBLE))"
    vec = """WITH x AS (SELECT vec_id AS id, CAST(label=0 AS INT) AS label, unnest(list_concat(embedding::DOUBLE[], [0.0, 1.0]::DOUBLE[])) AS v,
  unnest(range(66)) AS d FROM embeddings)"""
    anova = """, g AS (SELECT d, label, count(*) AS n, avg(v) AS m, sum(v) AS s FROM x GROUP BY 1,2),
t AS (SELECT d, avg(v) AS gm, count(*) AS n FROM x GROUP BY 1),
b AS (SELECT g.d, sum(g.n*(g.m-t.gm)*(g.m-t.gm)) AS ssb FROM g JOIN t USING (d) GROUP BY 1),
w AS (SELECT x.d, sum((v-g.m)*(v-g.m)) AS ssw FROM x JOIN g ON x.d=g.d AND x.label=g.label GROUP BY 1),
f AS (SELECT d, ssb/(ssw/(t.n-2)) AS f FROM b JOIN w USING (d) JOIN t USING (d) WHERE ssb+ssw > 1e-12)"""
    measures = [
        ("quantity", "l_quantity-25"), ("price", "l_extendedprice/1000-50"),
        ("discount", "l_discount*100-5"), ("tax", "l_tax*100-4"),
        ("line", "l_linenumber-4.0"), ("part", "l_partkey%101-50.0"),
        ("supplier", "l_suppkey%41-20.0"), ("order", "l_orderkey%31-15.0"),
    ]
    structs = ", ".join(f"{{'s': -abs(({v})::DOUBLE), 'n': '{n}', 'v': ({v})::DOUBLE}}" for n, v in measures)
    top = ", ".join(f"b[{i}].n AS top{i}_feature, b[{i}].v AS top{i}_shap" for i in range(1, 7))
    spaced = lambda x: f"replace({x}, '_', ' ')"
    after = lambda x, p: f"CASE WHEN starts_with({x}, '{p}') THEN substr({x}, {len(p) + 1}) ELSE {x} END"
    readable = f"""
CASE WHEN starts_with(raw, 'cat__') THEN {_title(spaced("split_part(substr(raw, 6), '__', 1)"))} ||
   CASE WHEN strpos(substr(raw, 6), '__')>0 THEN ': ' || {_title(spaced("substr(substr(raw, 6), strpos(substr(raw, 6), '__')+2)"))} ELSE '' END
 WHEN starts_with(raw, 'num__') THEN replace({spaced('substr(raw, 6)')}, 'n ', 'Number of ')
 WHEN starts_with(raw, 'mlb_') THEN 'List ' || {_title(spaced('inner_name'))} ||
   CASE WHEN val='' THEN '' ELSE ': ' || {_title(spaced("CASE WHEN starts_with(val, 'list_' || inner_name || '_') THEN substr(val, length(inner_name)+7) ELSE " + after('val', 'list_') + " END"))} END
 ELSE {_title(spaced("replace(raw, '__', ': ')"))} END AS name"""
    kind = "replace(p_name, ' ', '_')"
    steps = """WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, count(*) AS n, count(*) FILTER (WHERE l_returnflag='R') AS r
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1),
c AS (SELECT x, n, sum(n) OVER w AS cn, sum(r) OVER w AS cr, sum(r) OVER w - r AS br, sum(n) OVER w - n AS bn FROM p WINDOW w AS (ORDER BY x)),
m AS (SELECT i.x AS i, j.x AS j, (j.cr - i.br)::DOUBLE / (j.cn - i.bn)::DOUBLE AS mean FROM c i JOIN c j ON i.x <= j.x),
l AS (SELECT k.x, m.i, min(m.mean) AS least FROM c k JOIN m ON m.i <= k.x AND m.j >= k.x GROUP BY 1, 2),
v AS (SELECT x, max(least) AS value FROM l GROUP BY 1)
SELECT min(x) AS low, max(x) AS high, round(value, 9) AS share, CAST(sum(n) AS BIGINT) AS n_lines FROM v JOIN p USING (x) GROUP BY value"""
    periods = ", ".join(
        f"{n} AS (SELECT * FROM orders WHERE o_orderdate {op} TIMESTAMP '1998-01-01')" for n, op in (("ra", "<"), ("rb", ">="))
    )
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, {r} AS ref, {1 - r} AS cur FROM {t}"
        for c in ("o_totalprice", "o_custkey") for t, r in (("ra", 1), ("rb", 0))
    )
    cats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS k, {r} AS ref, {1 - r} AS cur FROM {t}"
        for c in ("o_orderstatus", "o_orderpriority") for t, r in (("ra", 1), ("rb", 0))
    )
    root = "sqrt(na*nb/(na+nb)::DOUBLE)"
    ks_tests = f"""l AS ({long}), c AS (SELECT feature, v, sum(ref) AS ref, sum(cur) AS cur FROM l GROUP BY 1,2),
d AS (SELECT feature, sum(ref) OVER w AS a, sum(cur) OVER w AS b, sum(ref) OVER t AS na, sum(cur) OVER t AS nb FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY feature)),
s AS (SELECT feature, na, nb, max(abs(a/na::DOUBLE - b/nb::DOUBLE)) AS st FROM d GROUP BY 1,2,3),
x AS (SELECT feature, st, ({root}+0.12+0.11/{root})*st AS x FROM s),
ks AS (SELECT feature, st, CASE WHEN x<0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
  (SELECT sum(CASE WHEN j%2=1 THEN 2.0 ELSE -2.0 END * exp(-2.0*j*j*x*x)) FROM range(1,101) AS g(j)))) END AS p FROM x)"""
    chi_tests = f"""cl AS ({cats}), cc AS (SELECT feature, k, sum(ref) AS ref, sum(cur) AS cur FROM cl GROUP BY 1,2),
ct AS (SELECT *, sum(ref) OVER (PARTITION BY feature)::DOUBLE AS na, sum(cur) OVER (PARTITION BY feature)::DOUBLE AS nb FROM cc),
ce AS (SELECT *, (ref+cur)*na/(na+nb) AS ea, (ref+cur)*nb/(na+nb) AS eb FROM ct),
cs AS (SELECT feature, sum((ref-ea)*(ref-ea)/ea + (cur-eb)*(cur-eb)/eb) AS st, count(*)-1 AS freedom FROM ce GROUP BY 1),
chi AS (SELECT feature, st, freedom, (SELECT exp(-st/2) * sum((st/2)**i / factorial(i::INT)) FROM range(0, 10) AS g(i) WHERE i < freedom/2) AS p FROM cs)"""
    finished = ", ".join(
        f"replace(replace(substr(top{i}_feature, 6), '_', ' '), 'n ', 'Number of ') AS top{i}_feature, "
        f"round(top{i}_shap::DOUBLE, 4) AS top{i}_shap" for i in range(1, 7)
    )
    oracles = {
        "isotonic_shares": steps,
        "features_prepared": base + lists + """
SELECT id, label, title, objective, durationDays, coalesce(n, 0) AS n_partners, coalesce(n, 0) AS n_country,
  coalesce(n_sme, 0) AS n_sme, coalesce(list_country, '') AS list_country, coalesce(list_activityType, '') AS list_activityType,
  coalesce(list_deliverableType, '') AS list_deliverableType, coalesce(list_availableLanguages, '') AS list_availableLanguages,
  coalesce(list_euroSciVocTitle, '') AS list_euroSciVocTitle
FROM m LEFT JOIN o ON o.projectID=id LEFT JOIN v ON v.projectID=id LEFT JOIN w ON l_orderkey=id""",
        "features_levels": base + """ SELECT DISTINCT id, upper(level) AS level FROM m JOIN
(SELECT projectID, unnest([split_part(euroSciVocPath,'/',2), split_part(euroSciVocPath,'/',3)]) AS level FROM vocabulary) ON projectID=id""",
        "feature_medians": base + f" SELECT feature, median(value) AS median FROM ({amounts}) GROUP BY 1",
        "impute_scale": base + f""", a AS ({amounts}),
f AS (SELECT id, feature, coalesce(value, median(value) OVER (PARTITION BY feature)) AS value FROM a)
SELECT id, feature, round((value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature), 6) AS value FROM f""",
        "onehot_counts": base + f" SELECT feature, count(*) AS n FROM ({classes}) GROUP BY 1",
        "multilabel_counts": base + f" SELECT feature, count(*) AS n FROM ({multi}) GROUP BY 1",
        "stratified_split": base
        + f" SELECT id, label, CAST(r >= round(n*0.8::DOUBLE) AS INT) AS slice FROM ({ranked.format(seed=model.SEED)})",
        "fold_assignment": base
        + f" SELECT id, label, CAST(r >= {third(1)} AS INT) + CAST(r >= {third(2)} AS INT) AS fold FROM ({ranked.format(seed=model.SEED + 1)})",
        "variance_filter": vec + " SELECT 'd' || d AS feature, round(var_pop(v), 9) AS variance FROM x GROUP BY d HAVING var_pop(v) > 0",
        "anova_topk": vec + anova + " SELECT 'd' || d AS feature, round(f, 6) AS f FROM f ORDER BY f.f DESC LIMIT 20",
        "confusion_counts": "SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1,2",
        "confusion_report": """
WITH c AS (SELECT unnest([0,1]) AS class),
s AS (SELECT class, count(*) FILTER (WHERE quality=class AND toxic=class) AS tp, count(*) FILTER (WHERE toxic=class) AS pp,
  count(*) FILTER (WHERE quality=class) AS support FROM c, labels GROUP BY 1),
r AS (SELECT class, tp/pp::DOUBLE AS p, tp/support::DOUBLE AS r, support FROM s)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END, 9) AS f1, support FROM r""",
        "readable_feature_names": f"""
WITH raws AS (SELECT DISTINCT unnest([
  'cat__p_type__' || {kind}, 'num__n_' || {kind}, 'mlb_list_' || p_type || '__list_' || p_type || '_' || {kind},
  'mlb_list_' || p_type || '__list_' || {kind}, 'mlb_' || {kind} || '__' || p_brand, 'mlb_list_' || {kind},
  'cat__' || p_brand, {kind} || '__' || p_brand]) AS raw FROM part
  UNION SELECT DISTINCT 'cat__fundingScheme_' || o_orderpriority FROM orders),
h AS (SELECT raw, split_part(substr(raw, 5), '__', 1) AS col, split_part(substr(raw, 5), '__', 2) AS val FROM raws),
p AS (SELECT raw, val, {after('col', 'list_')} AS inner_name FROM h)
SELECT raw, {readable} FROM p""",
        "top6_contributions": f"""
WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, list_sort([{structs}]) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {top} FROM z""",
        "displayed_confidence": "WITH " + PROJECTS + "," + SCORED + """
SELECT id, CASE WHEN predicted_label=1 THEN 'TERMINATED' ELSE 'CLOSED' END AS label,
  round(CASE WHEN predicted_label=1 THEN predicted_prob::DOUBLE ELSE 1-predicted_prob::DOUBLE END, 6) AS confidence FROM scored""",
        "finished_scores": "WITH " + PROJECTS + "," + SCORED
        + f" SELECT id, predicted_label, round(predicted_prob::DOUBLE + 0.00001::DOUBLE, 4) AS predicted_prob, {finished} FROM scored",
        "drift_ks": f"WITH {periods}, {ks_tests} SELECT feature, round(st, 9) AS statistic, round(p, 6) AS p_value FROM ks",
        "drift_chi2": f"WITH {periods}, {chi_tests} SELECT feature, round(st, 6) AS statistic, freedom, round(p, 6) AS p_value FROM chi",
        "drift_wasserstein": f"""WITH {periods}, l AS ({long}),
c AS (SELECT feature, v, sum(ref) AS ref, sum(cur) AS cur FROM l GROUP BY 1,2),
d AS (SELECT feature, v, lead(v) OVER w AS up, abs(sum(ref) OVER w / sum(ref) OVER t::DOUBLE - sum(cur) OVER w / sum(cur) OVER t::DOUBLE) AS gap FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature))
SELECT feature, round(sum(gap * (up - v)), 4) AS distance FROM d WHERE up IS NOT NULL GROUP BY 1""",
        "drift_jensen_shannon": f"""WITH {periods}, cl AS ({cats}), cc AS (SELECT feature, k, sum(ref) AS ref, sum(cur) AS cur FROM cl GROUP BY 1,2),
ct AS (SELECT feature, ref/sum(ref) OVER (PARTITION BY feature)::DOUBLE AS p, cur/sum(cur) OVER (PARTITION BY feature)::DOUBLE AS q FROM cc)
SELECT feature, round(sqrt(sum(CASE WHEN p>0 THEN p*log2(2*p/(p+q)) ELSE 0 END + CASE WHEN q>0 THEN q*log2(2*q/(p+q)) ELSE 0 END)/2), 9) AS distance
FROM ct GROUP BY 1""",
        "drift_report": f"""WITH {periods}, {ks_tests}, {chi_tests}, a AS (SELECT p FROM ks UNION ALL SELECT p FROM chi)
SELECT count(*) AS columns, CAST(count(*) FILTER (WHERE p<0.05) AS BIGINT) AS drifted,
  CAST(count(*) FILTER (WHERE p<0.05)/count(*)::DOUBLE >= 0.5 AS INT) AS table_drift FROM a""",
    }
    return oracles | {"stored_preprocessor": oracles["impute_scale"], "training_snapshot": oracles["features_prepared"]}
