"""Physical plans: what is read, what is shuffled, what stays in the JVM."""

from urlrisk.operators import features, gate, matching, ranking, scoring, sketches
from urlrisk.plans import lineage
from urlrisk.queries import queries
from urlrisk.queries import relations as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_narrow_pass_over_two_columns(spark, sf_dir):
    scored = scoring.predict_b(features.extract_features(spark.read.parquet(f"{sf_dir}/pages.parquet"), "B"))
    text = plan(scored.select("url", "label"))
    assert "Exchange" not in text and "Python" not in text and "BatchEval" not in text
    assert "ReadSchema: struct<url:string>" in text


def test_top_k_does_not_sort_everything(spark, sf_dir):
    scored = scoring.fallback_probability(features.extract_features(R.corpus(spark, sf_dir), "A"))
    assert "TakeOrderedAndProject" in plan(ranking.top_k(ranking.with_rank(scored), 5))


def test_shipped_filter_probe_has_no_join(spark, sf_dir):
    shape = sketches.Shape.plain()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    probed = sketches.probe_plain(pages, "url", sketches.build_plain(pages, "url", shape), shape)
    text = plan(probed)
    assert "Join" not in text and "Exchange" not in text.split("Subquery")[0]


def test_gate_filters_after_the_cut(spark, sf_dir):
    forwarded, _ = gate.split(gate.gate(R.corpus(spark, sf_dir).select("url")))
    text = plan(forwarded)
    assert "Scan ExistingRDD" in text and "md5" not in text


def test_checkpoint_folder_comes_from_the_session(spark):
    configured = spark.conf.get(lineage.CHECKPOINT_CONF, None)
    assert configured is None or configured in lineage.shared_dir(spark)


def test_no_query_runs_python_per_row(spark, sf_dir):
    for name in ("c_features_a", "g1_gate", "f3_bloom_probe", "t_visit_features", "i6_hop_risk"):
        assert "Python" not in plan(queries()[name](spark, sf_dir))


def test_list_verdict_reads_the_log_once(spark, sf_dir):
    listed = spark.range(9).selectExpr("concat('h', id, '.com') pattern")
    log = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "concat('h', user_id, '.com') domain")
    for judged in (matching.match_verdict(log, listed, listed), matching.not_listed(log, listed)):
        assert plan(judged).count("Scan parquet") == 1


def test_trigram_similarity_shuffles_urls_once(spark, urls):
    text = plan(sketches.trigram_similarity(urls(["http://a.com/"]), urls(["http://b.com/"])))
    assert "_words" not in text and "hashpartitioning(gram" not in text
    grouped = text.split("Generate")[0]
    assert grouped.count("hashpartitioning(url") == 1  # that of the join; the distinct below serves the grouping
