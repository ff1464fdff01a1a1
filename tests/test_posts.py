"""Ingest, text features, classifiers, votes, ensemble and metrics."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from checks import queries as registered
from origintrace.constants import CLASS_ORDER, TWEET_COLUMNS
from origintrace.operators import classify, clean, ensemble, features, metrics, naive_bayes, votes
from origintrace.plans import post_level
from origintrace.sources import dumps, fixtures
from origintrace.sources.schemas import TWEET_DUMP, text_schema


def test_ingest_reads_every_file_and_quarantines_bad_rows(spark, tmp_path):
    def line(i, text):
        cells = {c: "" for c in TWEET_COLUMNS} | {"tweetid": str(i), "userid": "u", "tweet_text": text, "tweet_language": "en"}
        return ",".join('"' + cells[c].replace('"', '""') + '"' for c in TWEET_COLUMNS)

    header = ",".join(TWEET_COLUMNS)
    (tmp_path / "iran_082019_tweets_csv_hashed.csv").write_text("\n".join([header, line(1, 'say "hi", all\nof you'), "1,2"]) + "\n")
    (tmp_path / "venezuela_linked_tweets_csv_hashed.csv").write_text("\n".join([header, line(2, "été")]) + "\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    rows = dumps.read_dumps(spark, str(tmp_path), TWEET_DUMP)
    good = {r.tweetid: r for r in dumps.accepted(rows).collect()}
    assert good["1"].tweet_text == 'say "hi", all\nof you'
    assert (good["1"].sponsoring_country, good["1"].release) == ("iran", "201908")
    assert (good["2"].table_name, good["2"].release, good["2"].tweet_text) == (
        "venezuela_201901_2_tweets_csv_hashed", "201901", "été")
    bad = dumps.quarantined(rows).collect()
    assert [(r.table_name, r.raw.strip()) for r in bad] == [("iran_201908_tweets_csv_hashed", "1,2")]
    listed = {r.table_name for r in dumps.list_dumps(spark, str(tmp_path)).collect()}
    assert listed == {"iran_082019_tweets_csv_hashed", "venezuela_linked_tweets_csv_hashed"}


def test_write_table_overwrites_and_keeps_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 3):
        dumps.write_table(spark.range(n).withColumn("is_validation", F.col("id") == 0), path, ["is_validation"])
    table = spark.read.schema("id bigint, is_validation boolean").parquet(path)
    assert [r.id for r in table.where("is_validation").collect()] == [0] and table.count() == 3


def test_jdbc_options_come_from_the_session(spark):
    with pytest.raises(ValueError):
        dumps.jdbc_options(spark, "t", "id", 0, 9, 4)
    spark.conf.set("origintrace.jdbc.url", "jdbc:x")
    spark.conf.set("origintrace.jdbc.user", "me")
    options = dumps.jdbc_options(spark, "t", "id", 0, 9, 4)
    assert options == {"url": "jdbc:x", "user": "me", "dbtable": "t", "partitionColumn": "id", "lowerBound": "0",
                       "upperBound": "9", "numPartitions": "4", "fetchsize": "10000"}


def test_combine_tags_and_filters_language(spark):
    columns = ["userid", "tweet_language"]
    a = spark.createDataFrame([("1", "en"), ("2", "fr")], text_schema(columns))
    b = spark.createDataFrame([("1", "en"), ("3", None)], text_schema(columns))
    got = clean.combine([("iran", "201908", a), ("china", "201911", b)], columns).collect()
    assert sorted(map(tuple, got)) == [("china", "201911", "1", "en"), ("iran", "201908", "1", "en")]
    assert clean.combine([("iran", "x", a), ("china", "y", b)], ["userid"], None).count() == 4


POSTS = "tweetid string, tweet_text string, is_validation boolean"


def test_prepare_text_stops_on_stems_or_words(spark):
    df = spark.createDataFrame([("1", "RT this, having cats. https://t.co/x1 (ok)", False)], POSTS)
    parity = features.prepare_text(df).first().ntokens
    assert parity == ["thi", "cat", "(", "ok", ")"]  # "having" stems to "have", a stop word; "this" does not
    on_words = features.prepare_text(df, stop_after_stemming=False).first().ntokens
    assert "thi" not in on_words and "cat" in on_words
    plain = features.prepare_text(df, stemmed=False).first().ntokens
    assert "cats" in plain and "https://t.co/x1" not in plain and "." not in plain


def test_tfidf_terms_equal_brute_force_with_and_without_heavy_terms(spark):
    texts = {str(i): " ".join(f"w{j}" for j in range(20) if (i * 7 + j * 3) % (j + 2) == 0) + " the the" for i in range(30)}
    df = spark.createDataFrame([(k, v, False) for k, v in texts.items()], POSTS)
    tf = {k: Counter(v.split()) for k, v in texts.items()}
    seen = Counter(t for c in tf.values() for t in c)
    expected = {(k, t): (n * math.log(31 / (seen[t] + 1)) if seen[t] >= 5 else 0.0) for k, c in tf.items() for t, n in c.items()}
    for heavy in (1, 4096):
        got = features.tfidf_terms(features.term_frequency(df), F.lit(30), heavy=heavy).collect()
        assert len(got) == len(expected)
        assert {(r.tweetid, r.term): r.tfidf for r in got} == pytest.approx(expected)


def test_terms_are_counted_where_texts_are_read(spark):
    """Counts of one row's text are not shuffled; those of an id in several rows, null among them, are added up."""
    texts = [("1", "b a, B! ß b2"), ("2", ""), ("3", None), ("4", "..."), ("5", "x x"), ("5", "y X"), (None, "z z"), (None, "z"), ("6", "x")]
    tf = features.term_frequency(spark.createDataFrame(texts, "tweetid string, tweet_text string"))
    assert tf.dtypes == [("tweetid", "string"), ("term", "string"), ("tf", "bigint")]
    got = tf.collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "a", 1), ("1", "b", 2), ("1", "b2", 1), ("1", "ß", 1), ("5", "x", 3), ("5", "y", 1), (None, "z", 3), ("6", "x", 1)], key=str)
    union = tf._jdf.queryExecution().optimizedPlan()
    once, again = (union.children().apply(i).toString() for i in (0, 1))
    assert "Aggregate" not in once and again.count("Aggregate") == 1


def test_document_frequencies_are_counted_once(spark, monkeypatch):
    """Both look-ups, that by broadcast and that by shuffle, read the same staged counts."""
    staged, write = [], features.stage
    monkeypatch.setattr(features, "stage", lambda df, name: staged.append(name) or write(df, name))
    tf = spark.createDataFrame([(str(i), f"w{j}", 1) for i in range(6) for j in range(i + 1)], "tweetid string, term string, tf long")
    for heavy in (6, 1):
        weighted = features.tfidf_terms(tf, F.lit(6), heavy=heavy)
        got = {(r.tweetid, r.term): r.tfidf for r in weighted.collect()}
        assert got == pytest.approx({(str(i), f"w{j}"): math.log(7 / (7 - j)) if j < 2 else 0 for i in range(6) for j in range(i + 1)})
        assert "Aggregate" not in weighted._jdf.queryExecution().optimizedPlan().toString()
    assert staged == ["document-frequency"] * 2


def test_hashed_weights_can_be_fitted_on_training_posts_alone(spark):
    df = spark.createDataFrame([(str(i), None, i % 2 == 0, ["a", "b"] if i % 2 else ["a"]) for i in range(20)],
                               POSTS + ", ntokens array<string>")
    everything = features.hashed_model(df).stages[-1]
    training = features.hashed_model(df, fit_on="train").stages[-1]
    assert everything.numDocs == 20 and training.numDocs == 10
    parts = features.sparse_parts(features.hashed_model(df).transform(df).select("tweetid", "tf"), "tf").collect()
    assert {len(r["indices"]) for r in parts} == {1, 2} and all(set(r["values"]) == {1.0} for r in parts)


def murmur3(data, h=42):
    """32-bit MurmurHash3, as a signed number."""
    turn = lambda x, n: (x << n | x >> 32 - n) & 0xFFFFFFFF
    mix = lambda k: turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (turn(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= (mix(int.from_bytes(data[whole:], "little")) if data[whole:] else 0) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_slots_are_the_indices_of_the_vectors(spark):
    words = [f"word{i}" for i in range(60)] + ["é", "日本語", "a", "ab", "abc"]
    df = spark.createDataFrame([("1", None, False, words + ["word1"]), ("2", None, True, [])], POSTS + ", ntokens array<string>")
    vectors = features.hashed_model(df, dimensions=13, min_doc_freq=1).transform(df)
    parts = {r.tweetid: dict(zip(r["indices"], r["values"])) for r in features.sparse_parts(vectors.select("tweetid", "tf"), "tf").collect()}
    place = lambda w: murmur3(w.encode()) % 13
    assert parts == {"1": dict(Counter(map(place, [*words, "word1"]))), "2": {}}
    terms = spark.createDataFrame([("1", w, 1) for w in words] + [("2", "word1", 1)], "tweetid string, term string, tf long")
    met = {r.slot: (r.terms, r.posts, r.lost) for r in features.slot_collisions(terms, 13).collect()}
    by_slot = {}
    for w in words:
        by_slot.setdefault(place(w), []).append(1 + (w == "word1"))
    assert met == {k: (len(v), sum(v), sum(v) - max(v)) for k, v in by_slot.items()}
    rows = features.hashed_terms(terms, F.lit(2), dimensions=13, min_doc_freq=1, heavy=3).where("tweetid = '1'").collect()
    assert {r.slot: r.tf for r in rows} == Counter(map(place, words))


def test_stemmed_terms_count_the_prepared_tokens(spark, small):
    docs = fixtures.docs(spark, small)
    want = Counter((r.tweetid, t) for r in features.prepare_text(docs).select("tweetid", "ntokens").collect() for t in r.ntokens)
    for heavy in (5, 4096):
        got = features.stemmed_terms(docs, heavy=heavy).collect()
        assert {(r.tweetid, r.term): r.tf for r in got} == dict(want) and len(got) == len(want)


def test_stemmed_terms_shuffle_tokens_once(spark, monkeypatch):
    staged, write = [], features.stage
    monkeypatch.setattr(features, "stage", lambda df, name: staged.append(df) or write(df, name))
    texts = [("1", "Running runs, RUNNING"), ("1", "runs the ponies"), ("2", None), (None, "ponies")]
    got = features.stemmed_terms(spark.createDataFrame(texts, "tweetid string, tweet_text string")).collect()
    assert {(r.tweetid, r.term): r.tf for r in got} == {("1", "run"): 4, ("1", "poni"): 1, (None, "poni"): 1} and len(got) == 3
    plan = staged[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(staged) == 1 and "Join" not in plan and plan.count("Aggregate") == 1


@pytest.mark.parametrize("heavy", [2, 4096])
def test_naive_bayes_equals_mllib(spark, heavy):
    """The same weighted rows as vectors over the same vocabulary."""
    rng = random.Random(5)
    classes, words = ["a", "b", "c"], [f"w{i}" for i in range(30)]
    data = [(str(i), classes[i % 5 % 3], "u", i % 4 == 0, " ".join(rng.choices(words[i % 5 % 3 * 8:], k=i % 9))) for i in range(200)]
    posts = spark.createDataFrame(data, "tweetid string, sponsoring_country string, userid string, is_validation boolean, tweet_text string")
    heads = classify.with_weight_and_label(posts)
    tf = features.term_frequency(heads, keep=("label", "is_validation"))
    rows = features.tfidf_terms(tf, F.lit(len(data)))
    model = naive_bayes.fit(rows, heads)
    got = {r.tweetid: r for r in naive_bayes.score(model, rows.where("is_validation"), heads.where("is_validation"), heavy=heavy).collect()}
    assert len(got) == 50

    weights = {}
    for r in rows.collect():
        weights.setdefault(r.tweetid, {})[r.term] = r.tfidf
    used = sorted({t for w in weights.values() for t in w})
    vectors = spark.createDataFrame([
        (r.tweetid, r.label, r.weight, r.is_validation, Vectors.sparse(len(used), sorted((used.index(t), x) for t, x in weights.get(r.tweetid, {}).items())))
        for r in heads.collect()], ["tweetid", "label", "weight", "is_validation", "tfidf"])
    plain = classify.classifier("nb").fit(vectors.where("not is_validation")).transform(vectors.where("is_validation"))
    for r in plain.select("tweetid", "prediction", "rawPrediction").collect():
        best, second = sorted(r.rawPrediction, reverse=True)[:2]
        assert got[r.tweetid].prediction == r.prediction or best - second < 1e-9
        assert got[r.tweetid].log_score == pytest.approx(max(r.rawPrediction))


def test_naive_bayes_of_little(spark):
    schema = "tweetid string, sponsoring_country string, userid string, is_validation boolean, tweet_text string"
    rows = [("1", "a", "u", False, "x y"), ("2", "b", "u", False, ""), ("3", "b", "u", True, None), ("4", "a", "u", True, "never seen"), ("5", "new", "u", True, "x")]
    got = {r.tweetid: r for r in post_level.nb_term_predictions(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"3", "4", "5"} and {r.result for r in got.values()} <= {"a", "b"}
    assert post_level.nb_term_predictions(spark.createDataFrame([], schema)).count() == 0


def test_class_weights_balance_and_labels_follow_frequency(spark, small):
    docs = fixtures.docs(spark, small)
    rows = classify.class_weights(docs).collect()
    total = docs.count()
    assert sum(r.weight * r.n for r in rows) == pytest.approx(total)
    labels = {r.sponsoring_country: r.label for r in classify.label_index(docs).collect()}
    counts = {r.sponsoring_country: r.n for r in rows}
    assert sorted(counts, key=lambda c: (-counts[c], c)) == sorted(labels, key=labels.get)


@pytest.mark.parametrize("kind", ["clf_lr", "clf_ovr_lr", "clf_ovr_svc", "clf_nb", "clf_nb_terms"])
def test_classifiers_tell_languages_apart(spark, small, kind):
    rows = registered.queries()[kind](spark, small)
    score = metrics.weighted_f1(rows, "label", "prediction").first().f1
    assert score > 0.7
    assert rows.where("result is null").count() == 0


def test_embedding_classifier_predicts_validation_vectors(spark, small):
    rows = registered.clf_embeddings(spark, small)
    assert rows.count() > 0 and rows.where("prediction not between 0 and 9").count() == 0


def test_embedding_classifier_learns_what_embeddings_tell(spark):
    """Ten classes around ten points: a floor on F1, which the classes of the test table (unrelated to its vectors) cannot give."""
    rng = random.Random(1)
    centres = [[rng.gauss(0, 3) for _ in range(16)] for _ in range(10)]
    data = [(str(c), str(i), str(i), [x + rng.gauss(0, 1) for x in centres[c]], i % 7 == 0) for i in range(1500) for c in [rng.randrange(10)]]
    rows = spark.createDataFrame(data, "sponsoring_country string, tweetid string, userid string, embedding array<float>, is_validation boolean")
    found = classify.predict_embeddings(rows, epochs=40)
    assert found.count() == sum(d[-1] for d in data)
    assert metrics.weighted_f1(found.withColumn("one", F.get("result", F.lit(0))), "sponsoring_country", "one").first().f1 > 0.8


def test_weighted_f1_equals_the_evaluator_of_mllib(spark):
    data = [(float(i % 4), float((i * i) % 5 % 4)) for i in range(200)] + [(3.0, 1.0), (2.0, 2.0)]
    df = spark.createDataFrame(data, "label double, prediction double")
    ours = metrics.weighted_f1(df, "label", "prediction").first()
    assert ours.f1 == pytest.approx(MulticlassClassificationEvaluator(metricName="f1").evaluate(df))
    assert ours.n == len(data)


VOTES = "sponsoring_country string, userid string, result array<string>"


def test_vote_shares(spark):
    df = spark.createDataFrame([
        ("iran", "u", ["iran"]), ("iran", "u", ["china"]), ("iran", "u", ["mars"]), ("iran", "u", []),
        ("china", "u", ["china"]), ("iran", "none", []), ("iran", "none", None),
    ], VOTES)
    got = {(r.sponsoring_country, r.userid): r.probability for r in votes.post_vote_probability(df).collect()}
    assert got["iran", "u"] == pytest.approx([0, 1 / 3, 1 / 3, 0])
    assert got["china", "u"] == [0, 1, 0, 0] and got["iran", "none"] is None


PREDICTIONS = "sponsoring_country string, userid string, prediction string"


def test_pivot_has_a_column_for_a_class_never_predicted(spark):
    df = spark.createDataFrame([("iran", "u", "iran"), ("iran", "u", "russia")], PREDICTIONS)
    row = votes.pivot_predictions(df).first()
    assert (row.votes_iran, row.votes_russia, row.votes_china, row.votes_venezuela) == (1, 1, 0, 0)
    assert row.share_iran == 0.5 and row.share_china == 0.0


def test_ensembles(spark):
    predictions = spark.createDataFrame(
        [("iran", "u", "iran"), ("iran", "u", "china"), ("china", "v", "china"), ("iran", "v", "china")], PREDICTIONS)
    users = spark.createDataFrame([("u", [0.1, 0.5, 0.3, 0.1])], "userid string, probability array<double>")
    left = {r.userid: r for r in ensemble.ensemble_left(predictions, votes.pivot_predictions(predictions), users).collect()}
    assert left["u"].prediction == "china" and left["u"].prob_china == 0.5
    assert left["v"].prediction == "china" and left["v"].prob_china == 1.0  # no account-level row
    assert left["v"].label == "china"  # the smallest of two labels
    shares = votes.post_vote_probability(predictions.withColumn("result", F.array("prediction")))
    inner = ensemble.ensemble_inner(shares, users).collect()
    assert [(r.sponsoring_country, r.userid, r.result) for r in inner] == [("iran", "u", "china")]
    assert CLASS_ORDER == ["russia", "china", "iran", "venezuela"]


def test_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "t string, p string")
    assert tuple(metrics.accuracy(df, "t", "p").first()) == (3, 1, pytest.approx(1 / 3))
    assert metrics.accuracy(df.where("t = 'z'"), "t", "p").first().accuracy is None


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """While tokens are staged, a batch has 1,000 rows at most; afterwards the session's settings are as they were."""
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    write = post_level.stage
    monkeypatch.setattr(post_level, "stage", lambda df, name: (seen.append(int(spark.conf.get(setting))), write(df, name))[1])
    posts = spark.createDataFrame([("iran", "1", "u", False, "Dogs running")], "sponsoring_country string, tweetid string, userid string, is_validation boolean, tweet_text string")
    assert [r.ntokens for r in post_level.prepared(posts).collect()] == [["dog", "run"]]
    assert seen and max(seen) <= 1000 and spark.conf.get(setting) == before
