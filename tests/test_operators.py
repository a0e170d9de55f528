import json
import math

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import labels, text
from reviewloom.operators import canonical, classify, index, labeling, metrics, profile, retrieval, stopwords
from reviewloom.sources import files
from reviewloom.streaming import labels as stream


def profile_json(doctor_id, comments, reviews=None):
    return {"doctor_profile": {"doctor_id": doctor_id, "specialty": "s", "reviews_count": reviews}, "comments": comments}


def test_raw_profiles_to_canonical_tables(spark, tmp_path):
    c = {"text": "خوب", "rate": 5.0, "label": 1, "date": "۱۴۰۴/۱۲/۰۳"}
    for name, content in {"a.json": profile_json("1", [c]), "b.json": profile_json("1", [c, c]), "c.json": profile_json("2", []), "d.json": profile_json("2", [])}.items():
        (tmp_path / name).write_text(json.dumps(content, ensure_ascii=False))
    (tmp_path / "e.json").write_text("{ broken")
    raw = files.read_profiles(spark, str(tmp_path)).cache()
    assert raw.filter("failed").select("source_file").first()[0] == "e.json"
    doctors, comments = files.flatten_profiles(raw)
    best, kept = canonical.canonicalize(doctors, comments)
    got = {r.doctor_id: r for r in best.collect()}
    assert {k: (v.selected_source_file, v.all_source_files, v.source_files_count) for k, v in got.items()} == {"1": ("b.json", "a.json | b.json", 2), "2": ("c.json", "c.json | d.json", 2)}
    assert [(r.source_file, r.comment_index_in_file) for r in kept.orderBy("comment_index_in_file").collect()] == [("b.json", 0), ("b.json", 1)]
    raw.unpersist()


def test_csv_lines_and_word_lists(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,t\n1,"a\nb"\n2,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "t.csv"), "id int, t string").collect()
    assert [(r.id, r.t) for r in rows] == [(1, "a\nb"), (2, "")]
    (tmp_path / "w.txt").write_text("# note\n\nمطب\nدو کلمه\nMRI\n", encoding="utf-8")
    assert {r.token for r in files.read_stopwords(spark, str(tmp_path / "w.txt")).collect()} == {"مطب", "mri"}
    log = [("a", 1, 0.9, 90, "m", "ok", "b1", "2024-01-01"), ("a", 0, 0.9, 90, "m", "ok", "b2", "2024-01-02"), ("b", None, None, None, "m", "failed", "b1", "2024-01-01")]
    log = spark.createDataFrame(log, files.LOG)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    assert sorted(r.item_id for r in files.still_to_do(items, log).collect()) == ["b", "c"]
    assert [(r.item_id, r.label_llm) for r in files.latest(log).collect()] == [("a", 0)]


def test_label_log_as_a_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    row = {"item_id": "a", "label_llm": 1, "status": "ok", "batch_id": "1", "ts_utc": "2024-01-01"}
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in (row, row | {"label_llm": 0, "ts_utc": "2024-01-02"})) + "\nnot json\n")
    q = stream.read_log(spark, str(source)).writeStream.foreachBatch(stream.latest_sink(str(target))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.item_id, r.label_llm) for r in stream.read_latest(spark, str(target)).collect()] == [("a", 0)]


DOCS = [("d0", 0, "سنگ کلیه درد"), ("d1", 0, "کلیه عفونت"), ("d2", 0, "پوست لک"), ("d3", 0, "قلب فشار")]


def test_plain_tf_idf_against_hand_computation(spark):
    df = spark.createDataFrame(DOCS, "doc string, i int, text string")
    config = index.IndexConfig(min_df=1, max_df=1.0, bigrams=False, sublinear=False)
    postings, terms = index.fit(index.row_terms(df, "doc", "i", text.tokens(F.col("text")), bigrams=False), config)
    idf = {t: math.log(5 / (1 + n)) + 1 for t, n in {"سنگ": 1, "کلیه": 2, "درد": 1, "عفونت": 1}.items()}
    q = spark.createDataFrame([("q", "سنگ کلیه")], "query string, text string")
    sims = {r.doc: r.sim for r in retrieval.similarities(retrieval.query_vectors(retrieval.query_terms(q, "query", text.tokens(F.col("text"))), terms, False), postings).collect()}
    unit = math.hypot(idf["سنگ"], idf["کلیه"])
    assert abs(sims["d0"] - unit / math.sqrt(unit**2 + idf["درد"] ** 2)) < 1e-5
    assert abs(sims["d1"] - idf["کلیه"] ** 2 / (unit * math.hypot(idf["کلیه"], idf["عفونت"]))) < 1e-5
    assert set(sims) == {"d0", "d1"}
    norms = postings.groupBy("doc").agg(F.sum(F.col("w") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_bigrams_cross_rows_in_order(spark):
    df = spark.createDataFrame([("d", 2, "cc dd"), ("d", 1, "aa bb"), ("d", 3, ""), ("d", 4, "ee")], "doc string, i int, text string")
    got = {r.term for r in index.row_terms(df, "doc", "i", text.tokens(F.col("text"))).collect()}
    assert got == {"aa", "bb", "cc", "dd", "ee", "aa bb", "bb cc", "cc dd", "dd ee"}


def test_top_k_fills_with_zeros(spark):
    sims = spark.createDataFrame([("q", "b", 0.5), ("r", "a", 0.1)], "query string, doc string, sim double")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc string")
    got = {(r.query, r.rank): (r.doc, r.sim) for r in retrieval.top_k(sims, 2, docs).collect()}
    assert got == {("q", 1): ("b", 0.5), ("q", 2): ("a", 0.0), ("r", 1): ("a", 0.1), ("r", 2): ("b", 0.0)}


def test_ranks_with_ties(spark):
    sims = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5), ("q", "c", 0.2), ("p", "a", 0.3)], "query string, doc string, sim double")
    truth = spark.createDataFrame([("q", "b"), ("p", "z")], "query string, doc string")
    got = {r.query: r["rank"] for r in retrieval.true_ranks(sims, truth, truth.select("query")).collect()}
    assert got == {"q": 1, "p": 2}


def test_rerank_smoothing(spark):
    pairs = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "b", 0.4, 2)], "query string, doc string, sim double, rank int")
    found = spark.createDataFrame([("q", "b", 50, 45)], "query string, doc string, q_support long, q_recommend long")
    got = {r.doc: r for r in retrieval.rerank(pairs, found).collect()}
    assert got["b"]["rank"] == 1
    assert got["b"].q_recommend_smooth == 0.884615
    assert (got["a"].final_score, got["a"].q_recommend_smooth) == (0.0, 0.5)


def test_evidence_keeps_case(spark):
    pairs = spark.createDataFrame([("q", "a")], "query string, doc string")
    terms = spark.createDataFrame([("q", "mri"), ("q", "درد گردن")], "query string, term string")
    comments = spark.createDataFrame([("a", 1, "MRI گرفتم", 5.0), ("a", 2, "درد گردن داشتم", 5.0), ("a", 3, "درد گردنم", 5.0), ("a", 4, "mri", None), ("a", 5, "mri درد گردن", 1.0), ("a", 6, None, 5.0)], "doc string, i int, t string, rate double")
    r = retrieval.evidence(pairs, terms, comments, "doc", "i", F.col("t"), F.col("rate")).first()
    assert (r.q_support, r.q_recommend) == (3, 1)
    o = retrieval.overall(comments, "doc", F.col("rate")).first()
    assert (o.overall_support, o.overall_recommend_pct) == (6, 66.666667)


def test_stopwords_with_reasons(spark):
    c = spark.createDataFrame([("x",), ("mri",), ("درد",), ("خوب",)], "token string")
    final, out = stopwords.finalize(c, seed=["سلام"])
    assert {r.token for r in final.collect()} == {"خوب", "سلام"}
    assert {r.token: r.reason for r in out.collect()} == {"x": "too_short", "mri": "latin_allowlist", "درد": "high_risk_keep"}


def test_entropy_of_one_facet_is_zero(spark):
    rows = [("g1", "f1", "a"), ("g2", "f1", "a"), ("g1", "f1", "b"), ("g2", "f2", "b")]
    got = {r.token: round(r.entropy_norm, 6) for r in profile.spread(spark.createDataFrame(rows, "group string, facet string, token string"), "group").collect()}
    assert got == {"a": 0.0, "b": 1.0}


def test_splits_are_disjoint_and_sized(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100 + i, 2) for i in range(4)], "id int, y int")
    s = labeling.stratified_split(df, "y", "id")
    got = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {(0, "train"): 16, (0, "dev"): 2, (0, "test"): 2, (1, "train"): 16, (1, "dev"): 2, (1, "test"): 2, (2, "train"): 4}
    assert labeling.leaks(labeling.group_split(df, "y"), "y").count() == 0


def test_capped_sample_keeps_caps(spark):
    df = spark.createDataFrame([(i, "g" if i < 30 else "", "f") for i in range(40)], "id int, g string, f string")
    got = labeling.capped_sample(df, 100, 1, "id", "g", 5, "f", 12).collect()
    assert len(got) == 12
    assert sum(r.g == "g" for r in got) <= 5


def test_pool_has_its_size_and_unique_rows(spark):
    words = ["افتضاح بود واقعا", "عالی و حاذق بود ممنون", "نوبت دیر شد متاسفانه", "آزمایش دادم امروز"]
    df = spark.createDataFrame([(i, f"d{i % 7}", "s", words[i % 4], float(i % 6)) for i in range(120)], "id int, doctor string, spec string, t string, rate double")
    config = labeling.PoolConfig(total_size=60, n_high_neg=10, n_service_neg=10, n_rate_neg=10, n_mid_neg=5, n_mixed=5, n_random=10, n_high_pos=5)
    pool = labeling.build_pool(labeling.pool_scores(labeling.usable(df, F.col("t")), F.col("t"), F.col("rate")), "id", "doctor", "spec", config).collect()
    assert len(pool) == 60 == len({r.id for r in pool})
    assert sorted(r.item_id for r in pool) == [f"sent_{i:06d}" for i in range(60)]


def test_batches_by_items_and_characters(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 9, 20, 1, 1, 1])], "id int, n int")
    got = {r.id: r.batch_no for r in labeling.greedy_batches(df, "id", F.col("n"), 3, 12).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3}


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (-1, 1)], "t int, p int")
    cells = metrics.confusion(df, "t", "p")
    assert cells.count() == 9
    r = {x.name: x for x in metrics.report(cells).collect()}
    assert r["accuracy"].f1 == 0.5
    assert (r["1"].precision, r["1"].recall, r["1"].support) == (0.5, 0.5, 2)
    assert r["-1"].f1 == 0.0
    assert r["macro"].f1 == round((0.5 + 2 / 3) / 3, 6)


def test_grid_takes_the_first_best(spark):
    rows = [(i, y, t) for i, (y, t) in enumerate([(1, "عالی حاذق بود دکتر"), (-1, "افتضاح بود این مطب"), (0, "سلام وقت بخیر دوستان"), (1, "عالی و ماهر بود"), (-1, "مزخرف بود این دکتر")])]
    gold = spark.createDataFrame(rows, "id int, y int, t string").withColumns(labels.weak_features(F.col("t")))
    scored = metrics.weak_grid(gold, "y", "id", {"neg_th": (1.6, 2.0), "pos_th": (1.6, 2.0)}, folds=1)
    best = metrics.best_params(scored).first()
    assert scored.count() == 4
    assert (best.param_id, best.macro_f1) == (0, 1.0)


def test_classifier_learns_a_word(spark):
    rows = [(i, "good fine day" if i % 2 else "bad awful day", float(2 * (i % 2))) for i in range(40)]
    df = classify.features(spark.createDataFrame(rows, "id int, t string, class_id double"), F.col("t"))
    for kind in ("mlp", "logistic"):
        out = classify.predict(classify.fit(df, buckets=64, kind=kind, max_iter=20), df)
        assert out.filter("predicted + 1 != class_id").count() == 0


def test_bins_keep_zeros(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (None,)], "r double")
    assert [(r.bin, r.n) for r in profile.bins(df, F.col("r")).orderBy("bin_no").collect()] == [("eq_0", 1), ("(0,1]", 0), ("(1,2]", 0), ("(2,3]", 0), ("(3,4]", 0), ("(4,5]", 1)]


def test_preprocessing_to_retriever_input(spark):
    from reviewloom.operators import preprocess

    df = spark.createDataFrame([(-1, "عدم رضایت"), (1, "دکتر عاااالی درد گردن MRI"), (1, "  "), (1, "واقعا نه"), (0, None)], "label int, text string")
    rows = preprocess.retriever_input(df, F.col("label"), stopwords=["واقعا", "نه"]).collect()
    assert [r.for_index for r in rows] == [False, True, False, True, False]
    assert rows[1].text_for_tfidf == "دکتر عاالی درد گردن MRI"
    assert rows[1].text_for_tfidf_medical == "عاالی درد گردن MRI"
    assert rows[3].text_for_tfidf == "نه"
    q = preprocess.query_tokens(spark.createDataFrame([("درحال درمان MRI فوقالعاده",)], "q string"), "q").first().tokens
    assert q == ["در", "حال", "درمان", "mri"]


def test_columns_and_configs(spark):
    from reviewloom.config import HybridConfig
    from reviewloom.operators import columns

    df = spark.createDataFrame([(1,)], "b int")
    assert columns.pick(df, "a", "b") == "b"
    assert columns.pick(df, "c") is None
    assert columns.ensure(df, a="x", b=2).first().asDict() == {"b": 1, "a": "x"}
    assert columns.project(df, "z", "b").first().asDict() == {"z": None, "b": 1}
    assert HybridConfig.from_env(env={"HYB_GOLD_REPEAT": "5", "HYB_CONF_TH_NEG": "0.5"}) == HybridConfig(conf_th_neg=0.5, gold_repeat=5)


def test_audit_wants_one_row_a_key(spark):
    weak = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "id int, label_weak int")
    answers = spark.createDataFrame([(1, 1), (2, -1), (3, 1), (4, 0)], "id int, label_llm int")
    assert {r.id: r.changed for r in labeling.audit(weak, answers, "id").collect()} == {1: False, 2: True, 3: True}
    with pytest.raises(Exception, match="not unique"):
        labeling.audit(weak.union(weak), answers, "id").collect()


def test_training_rows_of_bert_are_not_blank(spark):
    df = spark.createDataFrame([(" a b ", 1.0), ("  ", 1.0), (None, 0.0)], "t string, y double")
    assert [tuple(r) for r in labeling.bert_dataset(df, "t", "y").collect()] == [("a b", 1)]


def test_index_is_stored_and_searched(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc string, i int, text string")
    built = index.fit(index.row_terms(df, "doc", "i", text.tokens(F.col("text"))), index.IndexConfig(min_df=1, max_df=1.0))
    index.save(*built, str(tmp_path))
    q = spark.createDataFrame([("q", "درد کلیه")], "query string, text string")
    found = [[tuple(r) for r in retrieval.search(q, "query", text.tokens(F.col("text")), *i, k=3).orderBy("rank").collect()] for i in (built, index.load(spark, str(tmp_path)))]
    assert found[0] == found[1]
    assert found[0][0][1] == "d0"


def test_document_digests_hold_no_document(spark, tmp_path):
    """Groups are read as streams, over several batches, and equal the statement: nulls, blanks, groups without text."""
    import duckdb

    from reviewloom.plans.queries import ORACLE_SQL, QUERIES

    rows = [(i, [f"  Worté {i} \n x ", "", None, "中 \t b"][i % 4], ["a", "b", None, "c"][i % 7 % 4]) for i in range(700)]
    rows += [(1000, None, "no text"), (1001, None, "no text"), (1002, " ", "blank"), (1003, None, "late"), (1004, "y", "late")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = QUERIES["group_documents"](spark, str(tmp_path))
        got = {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(ORACLE_SQL["group_documents"]).fetchall())
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()
