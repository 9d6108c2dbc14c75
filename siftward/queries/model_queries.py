"""Queries over scores and models."""

from functools import reduce
from itertools import product

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from siftward.functions.risk import risk_tier, verdict
from siftward.functions.text import text_features
from siftward.functions.distance import name_distance_features
from siftward.models.encode import category_table, encoder, feature_places, standardised
from siftward.models.calibrate import platt_targets
from siftward.models.evaluate import accuracy, classification_report, recall, roc_auc, roc_points
from siftward.models.pruning import Tree, path_rows, weakest_links
from siftward.models.split import stratified_split
from siftward.models.train import (
    MEASURES,
    SEARCHES,
    VOTERS,
    Budget,
    Settings,
    compare_models,
    ensemble_scores,
    feature_importances,
    spam_probability,
    split_features,
    train_ensemble,
)
from siftward.operators.popularity import download_counts
from siftward.operators.releases import latest_release
from siftward.plans.features import feature_table
from siftward.plans.offline import TextModels, enrich
from siftward.plans.scan import download_rows, numeric_values, offline_values, scan_packages
from siftward.queries.package_queries import DOWNLOAD_COUNTS, columns, sql_nearest
from siftward.queries.registry import query
from siftward.queries.tables import DOWNLOADS_AS_OF, ORDER
from siftward.session import cut_lineage
from siftward.sources.writers import json_record
from siftward import config

SCORED = """SELECT doc_id, toxic AS label, CASE WHEN doc_id % 50 = 7 THEN NULL
    ELSE ((n_chars * 7 + toxic * 300) % 1000) / 1000.0D END AS score
    FROM {labels} JOIN {documents} USING (doc_id)"""
ORACLE_SCORED = "(" + SCORED.format(labels="labels", documents="documents").replace(
    "1000.0D", "1000.0::DOUBLE") + ")"


def scored(t):
    return t.spark.sql(SCORED, labels=t.labels, documents=t.documents)


# A missing score counts as 0.
ORACLE_FILLED = f"(SELECT doc_id, label, coalesce(score, 0) AS score FROM {ORACLE_SCORED})"


def filled(t):
    return scored(t).fillna(0.0, ["score"])


@query(
    "risk_tier",
    f"""SELECT doc_id, score, CASE WHEN score IS NULL THEN 'Unknown' WHEN score < 0.2 THEN 'Low'
      WHEN score < 0.5 THEN 'Moderate' WHEN score < 0.8 THEN 'High' ELSE 'Critical' END AS risk_tier,
      CASE WHEN coalesce(score, 0) > 0.8 THEN 'DANGEROUS' ELSE 'SAFE' END AS verdict
    FROM {ORACLE_SCORED}""",
)
def _(t):
    return scored(t).select(
        "doc_id", "score", risk_tier("score").alias("risk_tier"), verdict("score").alias("verdict")
    )


ROC = f"""SELECT score AS threshold, count(*) FILTER (label = 1) AS n_pos,
      count(*) FILTER (label = 0) AS n_neg
    FROM {ORACLE_FILLED} GROUP BY score"""


@query(
    "roc_curve",
    f"""SELECT *, true_pos / sum(n_pos) OVER () AS tpr, false_pos / sum(n_neg) OVER () AS fpr FROM (
      SELECT *, CAST(sum(n_pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS true_pos,
        CAST(sum(n_neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS false_pos FROM ({ROC}))""",
)
def _(t):
    return roc_points(filled(t))


@query(
    "roc_auc",
    f"""SELECT round(sum(p.n_pos * n.n_neg * CASE WHEN p.threshold > n.threshold THEN 1.0
        WHEN p.threshold = n.threshold THEN 0.5 ELSE 0 END)
      / ((SELECT sum(n_pos) FROM ({ROC})) * (SELECT sum(n_neg) FROM ({ROC}))), 9) AS auc
    FROM ({ROC}) p CROSS JOIN ({ROC}) n""",
)
def _(t):
    return roc_auc(roc_points(filled(t))).select(F.round("auc", 9).alias("auc"))


@query(
    "class_report",
    f"""WITH rows AS (SELECT label, CAST(score > 0.5 AS BIGINT) AS said FROM {ORACLE_FILLED}),
    counts AS (SELECT c AS class, count(*) FILTER (label = c AND said = c) AS hits,
        count(*) FILTER (said = c) AS claimed, count(*) FILTER (label = c) AS support
        FROM rows, (SELECT unnest([0, 1]) AS c) GROUP BY c),
    each AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(hits / nullif(claimed, 0), 0) AS precision,
        coalesce(hits / nullif(support, 0), 0) AS recall,
        coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1, support FROM counts),
    report AS (SELECT * FROM each
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM each
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
        sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
        CAST(sum(support) AS BIGINT) FROM each)
    SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
    FROM report""",
)
def _(t):
    rows = filled(t).withColumn("prediction", (F.col("score") > 0.5).cast("long"))
    report = classification_report(rows)
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "accuracy",
    f"""SELECT round(avg(CAST(label = CAST(score > 0.5 AS BIGINT) AS DOUBLE)), 9) AS accuracy,
      round(coalesce(count(*) FILTER (label = 1 AND score > 0.5)
        / nullif(count(*) FILTER (label = 1), 0), 0), 9) AS recall
    FROM {ORACLE_FILLED}""",
)
def _(t):
    rows = filled(t).withColumn("prediction", (F.col("score") > 0.5).cast("long"))
    return rows.agg(F.round(accuracy(), 9).alias("accuracy"), F.round(recall(), 9).alias("recall"))


@query(
    "stratified_split",
    """SELECT doc_id, toxic AS is_spam, row_number() OVER (PARTITION BY toxic
        ORDER BY md5('42:' || doc_id), doc_id) <= round(0.2 * count(*) OVER (PARTITION BY toxic)) AS is_test
    FROM labels""",
)
def _(t):
    labels = t.labels.select("doc_id", F.col("toxic").alias("is_spam"))
    return stratified_split(labels, "doc_id")


def training_rows(t):
    """A few features of the labelled documents."""
    shape = text_features(F.split_part("text", F.lit("\n"), F.lit(1)), "text")
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("pkg_name"),
        "lang",
        *columns(shape),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").alias("is_spam"),
    )


@query(
    "one_hot",
    """SELECT CAST(doc_id AS VARCHAR) AS pkg_name, lang,
      CAST(lang = 'en' AS DOUBLE) AS lang_en,
      CAST(lang = 'es' AS DOUBLE) AS lang_es, CAST(lang = 'fr' AS DOUBLE) AS lang_fr
    FROM documents JOIN labels USING (doc_id)""",
)
def _(t):
    rows = training_rows(t).select("pkg_name", "lang")
    encoding = encoder(rows, scale=False)
    # Four languages in these tables.
    names = [r["feature"] for r in feature_places(encoding).orderBy("place").collect()]
    entries = vector_to_array("features")
    return encoding.transform(rows).select("pkg_name", "lang", *(entries[i].alias(n) for i, n in enumerate(names)))


@query(
    "category_numbers",
    """SELECT c, value, dense_rank() OVER (PARTITION BY c ORDER BY value) - 1 AS number, count(*) AS n FROM (
      SELECT 0 AS c, source AS value FROM documents UNION ALL SELECT 1, md5(text) FROM documents)
    WHERE value IS NOT NULL GROUP BY c, value""",
)
def _(t):
    # As many categories as different texts, beside a few.
    return category_table(t.documents.select("source", F.md5("text").alias("digest")), ["source", "digest"])


STANDARDISED = ("n_desc_len", "n_desc_lines", "pct_non_ascii_desc")


@query(
    "standardise",
    f"""SELECT pkg_name, {", ".join(
        f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS {c}"
        for c in STANDARDISED)}
    FROM (SELECT CAST(doc_id AS VARCHAR) AS pkg_name, length(text) AS n_desc_len,
      len(string_split(text, chr(10))) AS n_desc_lines,
      (strlen(text) - length(text)) / greatest(strlen(text), 1) AS pct_non_ascii_desc
      FROM documents JOIN labels USING (doc_id))""",
)
def _(t):
    rows = training_rows(t)
    scaled = standardised(rows, {c: f"CAST(`{c}` AS DOUBLE)" for c in STANDARDISED})
    return rows.select(
        "pkg_name", *(F.round(F.expr(sql), 6).alias(name) for name, sql in scaled.items())
    )


@query(
    "unpivot_features",
    f"""SELECT pkg_name, feature, CAST(value AS DOUBLE) AS value FROM (
      SELECT name AS pkg_name, {sql_nearest('name', config.TOP_PACKAGES)} AS n_lev_dist_to_top1,
        {sql_nearest('name', config.BRAND_ALIASES)} AS n_lev_dist_to_alias
      FROM part_names) UNPIVOT (value FOR feature IN (n_lev_dist_to_top1, n_lev_dist_to_alias))""",
    ("part_names",),
)
def _(t):
    rows = t.part_names.select(
        F.col("name").alias("pkg_name"),
        *columns(name_distance_features("name")),
        F.lit("evening").alias("t_time_of_day"),
        F.lit(1).alias("n_versions"),
    )
    return numeric_values(offline_values(rows))


@query(
    "download_rows",
    f"""SELECT pkg_name, '7d' AS window, CAST(n_downloads_7d AS DOUBLE) AS downloads FROM ({DOWNLOAD_COUNTS})
    UNION ALL SELECT pkg_name, '30d', CAST(n_downloads_30d AS DOUBLE) FROM ({DOWNLOAD_COUNTS})""",
    ("downloads",),
)
def _(t):
    return download_rows(download_counts(t.downloads, DOWNLOADS_AS_OF))


@query(
    "scan_json",
    """SELECT name AS package, '{"name":"' || name || '","p_partkey":' || p_partkey || ',"upload_time":"'
      || strftime(upload_time, '%Y-%m-%dT%H:%M:%S') || '","license":' ||
      CASE WHEN license IS NULL THEN 'null' ELSE '"' || license || '"' END || ',"project_urls":' ||
      coalesce('["' || replace(array_to_string(project_urls, '","'), '/', '/') || '"]', 'null') || '}' AS raw_data
    FROM newest""",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["p_partkey", "upload_time", "license", "project_urls"], ORDER)
    return rows.select(F.col("name").alias("package"), json_record(rows).alias("raw_data"))


@query(
    "event_json",
    """SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END
      || '"}' AS record FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "ts")
    return rows.select("event_id", json_record(rows).alias("record"))


# --- models ------------------------------------------------------------------
# Solvers differ, so no oracle states a score. What it states is which rows are judged and that what is
# said of them holds together; a feature that gives the label away has a known answer.

TEST_ROWS = """SELECT package_name AS pkg_name, CAST(is_spam AS DOUBLE) AS label FROM (
      SELECT *, row_number() OVER (PARTITION BY is_spam ORDER BY md5('42:' || package_name), package_name)
        <= round(0.2 * count(*) OVER (PARTITION BY is_spam)) AS is_test FROM ground_truth) WHERE is_test"""


def finished_rows(t):
    """Finished feature rows of the labelled packages, with their text models and raw rows."""
    raw = cut_lineage(
        feature_table(t.dist, t.downloads, t.ground_truth, DOWNLOADS_AS_OF, ORDER, "all")
    )
    texts = TextModels.fit(raw)
    return cut_lineage(enrich(raw, texts, distance=texts.own_distance())), texts, raw


@query(
    "train_score",
    f"SELECT pkg_name, label, TRUE AS is_mean, TRUE AS is_said, TRUE AS is_tier FROM ({TEST_ROWS})",
    ("ground_truth",),
)
def _(t):
    train, test = split_features(finished_rows(t)[0])
    scores = ensemble_scores(train_ensemble(train), test)
    mean = sum((spam_probability(v) for v in VOTERS), F.lit(0.0)) / len(VOTERS)
    score = F.col("prediction_score")
    low = F.when(score < 0.2, "Low").when(score < 0.5, "Moderate").when(score < 0.8, "High")
    return scores.select(
        "pkg_name",
        "label",
        ((F.abs(score - mean) < 1e-9) & score.between(0, 1)).alias("is_mean"),
        (F.col("prediction") == (score > 0.5).cast("double")).alias("is_said"),
        (risk_tier("prediction_score") == low.otherwise("Critical")).alias("is_tier"),
    )


@query(
    "train_report",
    f"""WITH rows AS ({TEST_ROWS})
    SELECT class, support, TRUE AS holds FROM (
      SELECT CAST(CAST(label AS BIGINT) AS VARCHAR) AS class, count(*) AS support FROM rows GROUP BY label
      UNION ALL SELECT unnest(['macro avg', 'weighted avg']), count(*) FROM rows)""",
    ("ground_truth",),
)
def _(t):
    train, test = split_features(finished_rows(t)[0])
    judged = cut_lineage(
        ensemble_scores(train_ensemble(train), test).select("label", "prediction")
    )
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    share = judged.select(right).scalar()
    report = classification_report(judged)
    # The weighted recall is the accuracy.
    holds = F.when(F.col("class") == "weighted avg", F.abs(F.col("recall") - share) < 1e-9)
    fair = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return report.select("class", "support", (holds.otherwise(True) & fair).alias("holds"))


@query(
    "known_answer",
    """SELECT doc_id, CAST(toxic AS DOUBLE) AS label, CAST(toxic AS DOUBLE) AS decision_tree,
      CAST(toxic AS DOUBLE) AS log_reg, CAST(toxic AS DOUBLE) AS random_forest, CAST(toxic AS DOUBLE) AS svm,
      CAST(toxic AS DOUBLE) AS boosting, CAST(toxic AS DOUBLE) AS vote
    FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR))
      <= round(0.2 * count(*) OVER (PARTITION BY toxic)) AS is_test FROM labels) WHERE is_test""",
)
def _(t):
    rows = training_rows(t).withColumn("tells", F.col("is_spam") * 10 - 5)
    train, test = split_features(rows.select("pkg_name", "lang", "n_desc_len", "tells", "is_spam"))
    voters = (*VOTERS, "boosting")
    said = ensemble_scores(train_ensemble(train, Settings(voters=voters)), test, voters)
    return said.select(
        F.col("pkg_name").cast("long").alias("doc_id"),
        "label",
        *(F.col(f"{v}_prediction").alias(v) for v in voters),
        F.col("prediction").alias("vote"),
    )


@query(
    "model_comparison",
    """SELECT unnest(['decision_tree', 'log_reg', 'random_forest', 'svm', 'boosting']) AS model, TRUE AS in_bounds""",
)
def _(t):
    train, test = split_features(finished_rows(t)[0])
    table = compare_models(train, test)
    inside = [F.col(m).between(0, 1) for m in MEASURES]
    return table.select("model", reduce(lambda a, b: a & b, inside).alias("in_bounds"))


@query(
    "tuned_comparison",
    """SELECT unnest(['decision_tree', 'random_forest', 'boosting']) AS model, TRUE AS in_bounds""",
)
def _(t):
    train, test = split_features(training_rows(t))
    table = compare_models(train, test, tuple(SEARCHES), budget=Budget())
    inside = [F.col(m).between(0, 1) for m in MEASURES]
    return table.select("model", reduce(lambda a, b: a & b, inside).alias("in_bounds"))


@query("importances", "SELECT 15 AS n_features, 15 AS n_named, TRUE AS in_order, TRUE AS sums_to_one")
def _(t):
    train, _ = split_features(finished_rows(t)[0])
    top = feature_importances(train)
    every = feature_importances(train, top=100_000)
    known = set(train.columns)
    categories = [c for c, kind in train.dtypes if kind == "string"]
    named = F.col("feature").isin(*known)
    for c in categories:
        named = named | F.col("feature").startswith(f"{c}_")
    total = every.select(F.sum("importance")).scalar()
    shares = F.transform(F.array_sort(F.collect_list("importance")), lambda x: x)
    return top.agg(
        F.count("*").cast("int").alias("n_features"),
        F.count_if(named).cast("int").alias("n_named"),
        (F.element_at(shares, 1) >= 0).alias("in_order"),
        (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
    )


@query(
    "scan_packages",
    """SELECT name AS package, TRUE AS is_score, TRUE AS is_tier, TRUE AS is_verdict, name AS raw_name, name AS feature_name,
      requires AS raw_requires FROM (SELECT n.name, coalesce(len(n.requires_dist), 0) AS requires FROM newest n
        WHERE n.name NOT IN (SELECT package_name FROM ground_truth))""",
    ("newest", "ground_truth"),
)
def _(t):
    finished, texts, raw = finished_rows(t)
    train, _ = split_features(finished)
    model = train_ensemble(train)
    records = scan_packages(
        t.dist, t.downloads, t.unlabelled_names, DOWNLOADS_AS_OF, texts, model, ORDER, owners=raw
    )
    said = F.col("prediction")
    return records.select(
        "package",
        said.between(0, 1).alias("is_score"),
        (F.col("risk_tier") == risk_tier("prediction")).alias("is_tier"),
        (F.col("verdict") == F.when(said > config.VERDICT_THRESHOLD, "DANGEROUS").otherwise("SAFE")).alias("is_verdict"),
        F.get_json_object("raw_data", "$.pkg_name").alias("raw_name"),
        F.get_json_object("features", "$.pkg_name").alias("feature_name"),
        F.get_json_object("raw_data", "$.n_requires").cast("long").alias("raw_requires"),
    )


# A tree of four fixed tests over the labelled documents, as a node table in depth-first order. The oracle looks at
# every one of its 677 subtrees.
TESTS = ("lang = 'en'", "n_chars > 600", "n_chars > 200", "quality = 1")
_BITS = " || ".join(f"CASE WHEN {x} THEN '1' ELSE '0' END" for x in TESTS)
_LEVELS = "".join(
    f""", s{d} AS (SELECT prefix, cost, 1 AS leaves FROM nodes WHERE depth = {d}"""
    + ("" if d == 4 else f""" UNION ALL SELECT n.prefix, l.cost + r.cost, l.leaves + r.leaves FROM nodes n
      JOIN s{d + 1} l ON l.prefix = n.prefix || '0' JOIN s{d + 1} r ON r.prefix = n.prefix || '1' WHERE n.depth = {d}""")
    + ")"
    for d in (4, 3, 2, 1, 0)
)


@query(
    "pruning_path",
    f"""WITH bits AS (SELECT {_BITS} AS b, toxic FROM documents JOIN labels USING (doc_id)),
    grid AS (SELECT '' AS prefix, 0 AS depth UNION ALL SELECT lpad(bin(v), d::INTEGER, '0'), d
      FROM (SELECT unnest(range(1, 5)) AS d), (SELECT unnest(range(0, 16)) AS v) WHERE v < 2 ** d),
    nodes AS (SELECT prefix, depth, coalesce(2.0::DOUBLE * sum(toxic) * (count(b) - sum(toxic)) / nullif(count(b), 0)
        / (SELECT count(*) FROM bits), 0) AS cost
      FROM grid LEFT JOIN bits ON starts_with(b, prefix) GROUP BY prefix, depth)
    {_LEVELS},
    best AS (SELECT leaves, min(cost) AS cost FROM s0 GROUP BY leaves),
    ends AS (SELECT b.leaves, b.cost,
        greatest(0, coalesce(max((b.cost - o.cost) / (o.leaves - b.leaves)) FILTER (o.leaves > b.leaves), 0)) AS low,
        coalesce(min((o.cost - b.cost) / (b.leaves - o.leaves)) FILTER (o.leaves < b.leaves), 1e9) AS high
      FROM best b, best o GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY leaves DESC) - 1 AS step, round(low, 9) AS strength, leaves::BIGINT AS n_leaves,
      round(cost, 9) AS cost FROM ends WHERE low < high - 1e-12""",
)
def _(t):
    known = t.documents.join(t.labels, "doc_id")
    bits = F.concat(*(F.when(F.expr(x), "1").otherwise("0") for x in TESTS))
    cells = known.select(bits.alias("b"), "toxic").groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")
    )
    found = cells.select(
        F.explode(F.array(*(F.substring("b", 1, d) for d in range(5)))).alias("prefix"), "n", "pos"
    ).groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # In the order of the prefixes, a node comes before its children and the left before the right.
    order = {p: k for k, p in enumerate(sorted("".join(p) for d in range(5) for p in product("01", repeat=d)))}
    places = [(k, p, order.get(p + "0", -1), order.get(p + "1", -1)) for p, k in order.items()]
    nodes = t.spark.createDataFrame(places, "id int, prefix string, left int, right int").join(found, "prefix", "left")
    share = F.coalesce(F.col("pos") / F.col("n"), F.lit(0.0))
    nodes = nodes.select(
        "id", "left", "right", F.coalesce("n", F.lit(0)).cast("double").alias("n_rows"),
        (2 * share * (1 - share)).alias("impurity"), (share > 0.5).cast("double").alias("prediction"),
    )
    path = path_rows(t.spark, weakest_links(Tree.of_rows(nodes)))
    return path.withColumns({c: F.round(c, 9) for c in ("strength", "cost")})


@query(
    "platt_targets",
    """SELECT doc_id, toxic::DOUBLE AS label, (('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 5)::INTEGER AS fold,
      CASE WHEN toxic = 1 THEN (pos + 1) / (pos + 2)::DOUBLE ELSE 1 / (neg + 2)::DOUBLE END AS target
    FROM labels, (SELECT count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM labels)""",
)
def _(t):
    return platt_targets(t.labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
