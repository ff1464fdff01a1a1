"""The registered queries: operators on the test tables, rounded and flattened for comparison."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.oracle import DOC_CLASSES, N_TABLES
from origintrace.constants import CLASS_ORDER, USER_COLUMNS
from origintrace.functions import text as txt
from origintrace.functions.tokens import concat_arrays, drop_link_tokens, normalized_list
from origintrace.operators import (
    classify, clean, ensemble, features, metrics, minhash, profiles, scores, similarity, split, votes,
)
from origintrace.plans import post_level, user_level
from origintrace.sources import catalog, dumps, fixtures
from origintrace.sources.schemas import CORRUPT, text_schema
from origintrace.sources.staging import new_folder, stage

ROUND = 6


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in columns})


def _vector(column: str, name: str, classes: list[str] = CLASS_ORDER) -> list[Column]:
    return [F.round(F.get(column, F.lit(i)), ROUND).alias(f"{name}_{c}") for i, c in enumerate(classes)]


def _joined(column, name: str, by: str = ", ") -> Column:
    return F.array_join(column, by).alias(name)


# --- names, ingest, union, cleaning ----------------------------------------------------------
def catalog_route(spark, d):
    routed = catalog.route_tables(fixtures.dump_names(spark, d), "tweets")
    return routed.groupBy("corrected_name", "sponsoring_country", "release").agg(F.count("*").alias("n_posts"))


def normalize_release(spark, d):
    name = catalog.corrected_name(F.col("table_name"))
    country = catalog.country_of(F.col("corrected_name"))
    return (
        fixtures.dump_names(spark, d)
        .select("o_orderkey", name.alias("corrected_name"))
        .withColumn("sponsoring_country", country)
        .withColumn("release", catalog.release_of(F.col("corrected_name"), F.col("sponsoring_country")))
    )


def combine_posts(spark, d):
    """One raw table per country and release, tagged and united again; the tags come to the posts before their texts do."""
    return fixtures.posts(spark, d, normalize_release(spark, d).select("o_orderkey", "release"))


def union_releases(spark, d):
    """One table per country, as (country, release, table), united with both as columns."""
    posts = fixtures.posts(spark, d)
    countries = [*CLASS_ORDER, "spain"]
    tables = [(c, f"2019{i + 1:02}", posts.where(F.col("sponsoring_country") == c)) for i, c in enumerate(countries)]
    return clean.combine(tables, ["tweetid", "userid", "tweet_language", "hashtags", "urls", "user_mentions"])


def filter_lang(spark, d):
    return clean.in_language(fixtures.posts(spark, d))


def clean_posts(spark, d):
    return clean.clean_posts(fixtures.posts(spark, d))


INGESTED = ["tweetid", "userid", "tweet_text", "tweet_language", "hashtags", "urls", "user_mentions"]


def _write_dumps(rows: DataFrame, folder: str, **options) -> None:
    """One folder of CSV files per ``table_name``, added to what is there."""
    writer = rows.write.mode("append").partitionBy("table_name").option("header", True).option("escape", '"')
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(folder)


def _by_table(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt by ``table_name``, so that each dump gets few files."""
    return rows.hint("rebalance", "table_name")


def ingest_csv(spark, d):
    """Posts written as one CSV dump per raw table name, compressed, then read back as dumps are.

    By the length of their name, some dumps have their columns in another order and one more, some lack one.
    """
    heads = stage(fixtures.post_heads(spark, d, fixtures.dump_names(spark, d)), "post-heads")
    folder, rule = new_folder(spark, "dumps"), F.length("table_name") % 3
    # Texts are by far the most bytes: they join the posts of a third of the dumps in the tasks that write them.
    posts = lambda which: fixtures.with_texts(spark, d, heads.where(rule == which)).select(*INGESTED, "table_name")
    _write_dumps(posts(0), folder, compression="gzip")
    _write_dumps(posts(1).select(*INGESTED[::-1], F.lit("x, y").alias("note"), "table_name"), folder, compression="gzip")
    _write_dumps(posts(2).drop("urls"), folder, compression="gzip")
    rows = dumps.read_dumps(spark, folder, text_schema(INGESTED))
    return dumps.accepted(rows).select("table_name", "sponsoring_country", "release", *INGESTED)


def combined_users(spark, d):
    """Account and post dumps in one folder; the rows of all account dumps."""
    folder = new_folder(spark, "dumps")
    _write_dumps(_by_table(fixtures.accounts(spark, d)), folder)
    orders = fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("tweetid"), F.col("o_custkey").alias("userid"), "o_orderkey")
    routed = catalog.route_tables(fixtures.dump_names(spark, d), "tweets").select("o_orderkey", "table_name")
    _write_dumps(_by_table(orders.join(routed, "o_orderkey").drop("o_orderkey")), folder)
    rows = dumps.accepted(dumps.ingest(spark, folder).rows["users"])
    return clean.united(rows, USER_COLUMNS, language=None)


def _delivered(spark, folder: str) -> str:
    """A copy of the compressed dumps of a folder, some with the beginning of one more part and then nothing."""
    copies = new_folder(spark, "delivered")

    def copy(batches):
        from pyarrow import fs

        for batch in batches:
            for path, table in zip(batch["path"], batch["table_name"]):
                system, where = fs.FileSystem.from_uri(path)
                out, place = fs.FileSystem.from_uri(f"{copies}/table_name={table}")
                out.create_dir(place, recursive=True)
                with system.open_input_stream(where, compression=None) as source, out.open_output_stream(
                    f"{place}/{path.rsplit('/', 1)[1]}", compression=None
                ) as sink:
                    while piece := source.read(1 << 20):
                        sink.write(piece)
                    if len(table) % 2 == 0:
                        sink.write(gzip.compress(b"1,2,3\n" * 1000)[:20])
            yield batch[["path"]]

    dumps.list_dumps(spark, folder).select("path", "table_name").mapInPandas(copy, "path string").write.format("noop").mode("overwrite").save()
    return copies


def ingest_manifest(spark, d):
    """Compressed dumps of both kinds, some cut off, some with other columns: what each file is, and the rows read of it."""
    names = fixtures.dump_names(spark, d)
    orders = fixtures.table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("tweetid"), F.col("o_custkey").alias("userid"))
    rows = stage(orders.join(names, "o_orderkey").withColumns({"tweet_language": F.lit("en"), "account_language": F.lit("fr")}), "orders")
    folder, post = new_folder(spark, "dumps"), F.col("table_name").like("%tweets%")
    other = F.length("table_name") % 3 == 1
    _write_dumps(_by_table(rows.where(post & ~other).select("tweetid", "userid", "tweet_language", "table_name")), folder, compression="gzip")
    _write_dumps(_by_table(rows.where(post & other).select("userid", F.lit("x").alias("note"), "tweetid", "table_name")), folder, compression="gzip")
    _write_dumps(_by_table(rows.where(~post).select("account_language", "userid", "table_name")), folder, compression="gzip")
    kinds = {"tweets": text_schema(["tweetid", "userid", "tweet_language"]), "users": text_schema(["userid", "account_language"])}
    found = dumps.ingest(spark, _delivered(spark, folder), kinds)
    files = found.manifest.groupBy("table_name", "sponsoring_country", "release").agg(
        F.bool_or(F.col("error").isNotNull()).alias("damaged"), F.array_join(F.max("kinds"), " ").alias("kinds"),
        F.array_join(F.max("missing"), " ").alias("missing"), F.array_join(F.max("extra"), " ").alias("extra"),
    )
    count = lambda kind, value: found.rows[kind].groupBy("table_name").agg(
        F.count("*").alias("n"), F.count(CORRUPT).alias("rejected"), F.sum(F.col(value).cast("long")).alias("total")
    )
    return files.join(count("tweets", "tweetid").unionByName(count("users", "userid")), "table_name", "left")


def ingest_quarantine(spark, d):
    """Orders as dump lines, with a cell too few where the order is of status P; rejected lines by table."""
    names = fixtures.dump_names(spark, d)
    orders = fixtures.table(spark, d, "orders").select(
        "o_orderkey",
        F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") != "P", "u"), F.lit("en")).alias("value"),
    )
    folder = new_folder(spark, "damaged")
    orders.join(names, "o_orderkey").select("table_name", "value").hint("rebalance", "table_name").write.partitionBy("table_name").text(folder)
    rows = dumps.read_dumps(spark, folder, text_schema(["tweetid", "userid", "tweet_language"]), header=False, multiline=False)
    return rows.groupBy("table_name").agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("accepted"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rejected")
    )


# --- split --------------------------------------------------------------------------------------
def tweets_per_user(spark, d):
    return split.posts_per_user(clean_posts(spark, d))


def split_users(spark, d):
    return split.split_users(tweets_per_user(spark, d))


def split_counts(spark, d):
    return split_users(spark, d).groupBy("sponsoring_country", "is_validation").agg(
        F.count("*").alias("users"), F.sum("n_posts").alias("posts")
    )


def _account_posts(spark, d) -> DataFrame:
    return user_level.account_posts(fixtures.posts(spark, d))


# --- profiles -------------------------------------------------------------------------------------
def normalize_tokens(spark, d):
    return clean_posts(spark, d).select("tweetid", _joined(normalized_list(F.col("hashtags")), "tokens"))


def concat_arrays_query(spark, d):
    lists = [F.split(c, ", ") for c in ("hashtags", "urls", "user_mentions")]
    return clean_posts(spark, d).select("tweetid", _joined(concat_arrays(*lists), "joined"))


def user_profiles(spark, d):
    return profiles.user_profiles(_account_posts(spark, d))


def user_token_counts(spark, d):
    return profiles.token_counts(profiles.user_tokens(_account_posts(spark, d)))


# --- similarity --------------------------------------------------------------------------------------
def _exact(channel: str):
    def query(spark, d):
        pairs = user_level.similar_accounts(_account_posts(spark, d), [channel])
        return _rounded(pairs.drop("channel"), "similarity")

    return query


def similarity_edges(spark, d):
    edges = scores.similarity_edges(user_level.similar_accounts(_account_posts(spark, d)))
    return _rounded(edges, "similarity")


def minhash_signatures(spark, d):
    return minhash.signatures(user_level.sets_of(_account_posts(spark, d)), N_TABLES)


def _lsh(channel: str):
    def query(spark, d):
        pairs = user_level.similar_accounts_by_minhash(_account_posts(spark, d), [channel], N_TABLES)
        return _rounded(pairs.drop("channel"), "similarity")

    return query


# --- scores ------------------------------------------------------------------------------------------
def neighbour_scores(spark, d):
    return _rounded(user_level.neighbour_scores(_account_posts(spark, d)), "similarity")


def similarity_scores(spark, d):
    return user_level.score_vectors(_account_posts(spark, d)).select("userid", *_vector("score", "score"))


def normalized_scores(spark, d):
    return user_level.normalized(_account_posts(spark, d)).select("userid", *_vector("score", "score"))


def softmax_scores(spark, d):
    return user_level.probabilities(_account_posts(spark, d)).select("userid", *_vector("probability", "prob"))


def _docs(spark, d) -> DataFrame:
    return fixtures.docs(spark, d)


# --- text ----------------------------------------------------------------------------------------------
def sentence_counts(spark, d):
    return _docs(spark, d).select("tweetid", F.size(txt.sentences(F.col("tweet_text"))).alias("n_sentences"))


def _tokens(of):
    def query(spark, d):
        words = _docs(spark, d).select("tweetid", of(txt.tokens(F.col("tweet_text"))).alias("words"))
        return words.select("tweetid", F.size("words").alias("n_tokens"), _joined("words", "tokens", " "))

    return query


def prepare_text(spark, d):
    prepared = features.prepare_text(_docs(spark, d), stemmed=False)
    return prepared.select("sponsoring_country", "tweetid", "userid", "is_validation", _joined("ntokens", "ntokens", " "))


def prepare_text_stemmed(spark, d):
    prepared = features.prepare_text(_docs(spark, d))
    return prepared.select("sponsoring_country", "tweetid", "userid", "is_validation", _joined("ntokens", "ntokens", " "))


def stem_vocabulary(spark, d):
    return features.stem_vocabulary(_docs(spark, d))


def term_frequency(spark, d):
    return features.term_frequency(_docs(spark, d))


def tfidf_terms(spark, d):
    docs = _docs(spark, d)
    weighted = features.tfidf_terms(
        stage(features.term_frequency(docs), "term-frequency"), docs.agg(F.count("*")).scalar()
    )
    return _rounded(weighted, "tfidf")


def stemmed_terms(spark, d):
    return features.stemmed_terms(_docs(spark, d))


def _hashed(column: str):
    def query(spark, d):
        """The vectors of the model as rows, one for each index that is not zero."""
        tokens = post_level.prepared(fixtures.docs(spark, d))
        parts = features.sparse_parts(features.hashed_model(tokens).transform(tokens).select("tweetid", column), column)
        return parts.select("tweetid", F.posexplode("indices").alias("at", "slot"), "values").select(
            "tweetid", "slot", F.round(F.get("values", F.col("at")), ROUND).alias(column)
        )

    return query


def hashed_terms(spark, d):
    """The same vectors, without vectors."""
    docs = _docs(spark, d)
    return _rounded(features.hashed_terms(features.stemmed_terms(docs), F.lit(docs.count())), "tfidf")


def slot_collisions(spark, d):
    return features.slot_collisions(features.stemmed_terms(_docs(spark, d)))


# --- classifiers ---------------------------------------------------------------------------------------
def _classified(kind: str):
    def query(spark, d):
        return post_level.predictions(post_level.featured(post_level.prepared(fixtures.docs(spark, d))), kind)

    return query


def clf_nb_terms(spark, d):
    predicted = post_level.nb_term_predictions(fixtures.docs(spark, d))
    return predicted.withColumn("log_score", F.round("log_score", 3))


def clf_embeddings(spark, d):
    vec_id = F.col("vec_id").cast("string")
    rows = fixtures.table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("sponsoring_country"), vec_id.alias("tweetid"), vec_id.alias("userid"),
        "embedding",
        (F.substring(F.md5(vec_id), 1, 1) == "0").alias("is_validation"),
    )
    return classify.predict_embeddings(rows).withColumn("result", _joined("result", "result"))


def class_weights(spark, d):
    return _rounded(classify.class_weights(_docs(spark, d)), "weight")


def label_index(spark, d):
    return classify.label_index(_docs(spark, d))


def _doc_votes(spark, d):
    predicted = fixtures.rule_prediction(F.col("tweetid"), F.col("sponsoring_country"), DOC_CLASSES)
    return _docs(spark, d).withColumn("prediction", predicted)


def weighted_f1(spark, d):
    return _rounded(metrics.weighted_f1(_doc_votes(spark, d), "sponsoring_country", "prediction"), "f1")


# --- votes and ensemble -----------------------------------------------------------------------------------
def _post_votes(flagged: DataFrame) -> DataFrame:
    predicted = fixtures.rule_prediction(F.col("tweetid"), F.col("sponsoring_country"), CLASS_ORDER)
    return flagged.select(
        "sponsoring_country", "tweetid", "userid", "is_validation", predicted.alias("prediction"),
        F.array(predicted).alias("result"),
    )


def _vote_shares(flagged: DataFrame) -> DataFrame:
    return votes.post_vote_probability(_post_votes(flagged).where("is_validation"))


def post_vote_probability(spark, d):
    return _vote_shares(_account_posts(spark, d)).select("sponsoring_country", "userid", *_vector("probability", "share"))


def pivot_predictions(spark, d):
    return _rounded(votes.pivot_predictions(_post_votes(_account_posts(spark, d))), *[f"share_{c}" for c in CLASS_ORDER])


def ensemble_inner(spark, d):
    flagged = _account_posts(spark, d)
    return ensemble.ensemble_inner(_vote_shares(flagged), user_level.probabilities(flagged))


def ensemble_left(spark, d):
    flagged = _account_posts(spark, d)
    predictions = _post_votes(flagged)
    blended = ensemble.ensemble_left(
        predictions, votes.pivot_predictions(predictions), user_level.probabilities(flagged)
    )
    return _rounded(blended, *[f"prob_{c}" for c in CLASS_ORDER])


def accuracy(spark, d):
    return _rounded(metrics.accuracy(ensemble_inner(spark, d), "sponsoring_country", "result"), "accuracy")


def queries():
    return {
        "catalog_route": catalog_route,
        "normalize_release": normalize_release,
        "combine_posts": combine_posts,
        "union_releases": union_releases,
        "ingest_csv": ingest_csv,
        "ingest_quarantine": ingest_quarantine,
        "ingest_manifest": ingest_manifest,
        "combined_users": combined_users,
        "filter_lang": filter_lang,
        "clean_posts": clean_posts,
        "tweets_per_user": tweets_per_user,
        "split_users": split_users,
        "split_counts": split_counts,
        "normalize_tokens": normalize_tokens,
        "concat_arrays": concat_arrays_query,
        "user_profiles": user_profiles,
        "user_token_counts": user_token_counts,
        "exact_jaccard_combined": _exact("combined"),
        "exact_jaccard_users": _exact("users"),
        "similarity_edges": similarity_edges,
        "minhash_signatures": minhash_signatures,
        "lsh_similarity_combined": _lsh("combined"),
        "lsh_similarity_users": _lsh("users"),
        "neighbour_scores": neighbour_scores,
        "similarity_scores": similarity_scores,
        "normalized_scores": normalized_scores,
        "softmax_scores": softmax_scores,
        "sentence_counts": sentence_counts,
        "tokenize": _tokens(lambda w: w),
        "stopword_filter": _tokens(txt.without_stop_words),
        "drop_url_tokens": _tokens(drop_link_tokens),
        "prepare_text": prepare_text,
        "prepare_text_stemmed": prepare_text_stemmed,
        "stem_vocabulary": stem_vocabulary,
        "term_frequency": term_frequency,
        "tfidf_terms": tfidf_terms,
        "stemmed_terms": stemmed_terms,
        "hashing_tf": _hashed("tf"),
        "tfidf_hashed": _hashed("tfidf"),
        "hashed_terms": hashed_terms,
        "slot_collisions": slot_collisions,
        "class_weights": class_weights,
        "label_index": label_index,
        "clf_lr": _classified("lr"),
        "clf_ovr_lr": _classified("ovr_lr"),
        "clf_ovr_svc": _classified("ovr_svc"),
        "clf_nb": _classified("nb"),
        "clf_nb_terms": clf_nb_terms,
        "clf_embeddings": clf_embeddings,
        "weighted_f1": weighted_f1,
        "post_vote_probability": post_vote_probability,
        "pivot_predictions": pivot_predictions,
        "ensemble_inner": ensemble_inner,
        "ensemble_left": ensemble_left,
        "accuracy": accuracy,
    }
