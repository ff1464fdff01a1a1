"""Text preparation and term weights."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame, functions as F, types as T

from origintrace.constants import HASH_DIMENSIONS, MIN_DOC_FREQ
from origintrace.functions import text as txt
from origintrace.functions.porter import with_stems
from origintrace.functions.stemming import stems
from origintrace.functions.tokens import drop_link_tokens
from origintrace.sources.staging import stage, staged_path

HEAVY_TERMS = 4096  # terms in the most documents, broadcast with all a model knows of them; a fixed row bound
COUNTED_TERMS = 1 << 18  # the same where a term brings only its count, so a row is some 60 bytes


def prepare_text(
    posts: DataFrame, text: str = "tweet_text", output: str = "ntokens", stemmed: bool = True,
    stop_after_stemming: bool = True,
) -> DataFrame:
    """Tokens ready for features: tokenised, stemmed, without stop words, ``.`` and short links.

    Stop words are matched on stems, or on the words themselves with ``stop_after_stemming=False``.
    """
    words = txt.tokens(F.col(text))
    if not stemmed:
        kept = txt.without_stop_words(words)
    elif stop_after_stemming:
        kept = txt.without_stop_words(stems(words))
    else:
        kept = stems(txt.without_stop_words(words))
    return posts.withColumn(output, drop_link_tokens(kept))


def stem_vocabulary(posts: DataFrame, text: str = "tweet_text") -> DataFrame:
    """Distinct lower-case words with their number of uses and their stem."""
    words = posts.select(F.explode(txt.tokens(F.col(text))).alias("word"))
    return with_stems(words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("uses")), "word", "stem")


def stemmed_terms(posts: DataFrame, text: str = "tweet_text", keep: tuple[str, ...] = (), heavy: int = COUNTED_TERMS) -> DataFrame:
    """(tweetid, *keep, term, tf): how often each token of ``prepare_text`` is in each post.

    Words are counted within their text, where it is read, and every different word gets its stem once. The ``heavy`` words
    of most posts are looked up by broadcast, the others by shuffle; then uses are added up by stem. The result is staged.
    """
    key = ["tweetid", *keep]
    words = posts.select(*key, F.sort_array(F.transform(txt.tokens(F.col(text)), lambda t: F.lower(t))).alias("words"))
    ended = words.select(*key, "words", txt.run_ends(F.col("words")).alias("ends"))
    counted = ended.select(*key, F.inline(txt.runs(F.col("words"), F.col("ends"))))
    uses = stage(counted.select(*key, F.col("term").alias("word"), F.col("tf").alias("uses")), "word-uses")
    kept = F.size(drop_link_tokens(txt.without_stop_words(F.array("term")))) > 0
    vocabulary = with_stems(uses.groupBy("word").agg(F.count("*").alias("posts")), "word", "term")
    stems_of = vocabulary.withColumn("term", F.when(kept, F.col("term")))
    top = stems_of.orderBy(F.desc("posts"), "word").limit(heavy).select("word", "term", F.lit(True).alias("frequent"))
    first = uses.join(F.broadcast(top), "word", "left")
    rest = first.where(F.col("frequent").isNull()).drop("term", "frequent").join(stems_of.drop("posts"), "word")
    named = first.where("frequent").drop("frequent").unionByName(rest).where(F.col("term").isNotNull())
    return stage(named.groupBy(*key, "term").agg(F.sum("uses").alias("tf")), "stemmed-terms")


def with_heavy_apart(rows: DataFrame, table: DataFrame, key: str, weight: str, heavy: int = HEAVY_TERMS) -> DataFrame:
    """``rows`` joined with ``table``, one row per ``key``, whose column ``weight`` says in how many rows a key is.

    The ``heavy`` keys of most rows are looked up by broadcast. The others join by shuffle, where none of them is
    frequent enough to fill a task. ``weight`` is left out of the result.
    """
    top = F.broadcast(table.orderBy(F.desc(weight), key).limit(heavy))
    rest = table.join(top.select(key), key, "left_anti")
    frequent = rows.join(top, key)
    others = rows.join(top.select(key), key, "left_anti").join(rest, key)
    return frequent.unionByName(others).drop(weight)


def term_frequency(posts: DataFrame, text: str = "tweet_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(tweetid, *keep, term, tf); terms are counted within their text, where it is read.

    Only the counts of an id that several rows have are shuffled, to be added up.
    """
    key = ["tweetid", *keep]
    ids = posts.groupBy(F.col("tweetid").alias("repeated")).agg(F.count("*").alias("n")).where("n > 1").select("repeated")
    repeated = stage(ids, "repeated-ids")
    same = F.col("tweetid").eqNullSafe(F.col("repeated"))

    def counted(rows: DataFrame) -> DataFrame:
        words = rows.select(*key, F.sort_array(txt.terms(F.col(text))).alias("words"))
        ended = words.select(*key, "words", txt.run_ends(F.col("words")).alias("ends"))
        return ended.select(*key, F.inline(txt.runs(F.col("words"), F.col("ends"))))

    again = counted(posts.join(repeated, same, "left_semi")).groupBy(*key, "term").agg(F.sum("tf").alias("tf"))
    return counted(posts.join(repeated, same, "left_anti")).unionByName(again)


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_terms(
    tf: DataFrame, n_documents, min_doc_freq: int = MIN_DOC_FREQ, heavy: int = COUNTED_TERMS, fit_on: str = "all"
) -> DataFrame:
    """Exact TF-IDF on terms; terms in fewer than ``min_doc_freq`` documents weigh 0.

    With ``fit_on="train"``, only rows whose ``is_validation`` is false count as documents of a term.
    ``n_documents`` is a column, such as a scalar subquery. The terms of most documents hold a
    large part of all rows, so they are looked up by broadcast, at most ``heavy`` of them; the
    others join by shuffle, where none of them is frequent enough to fill a task.
    """
    basis = tf if fit_on == "all" else tf.where(~F.col("is_validation"))
    df = stage(document_frequency(basis).where(F.col("df") >= min_doc_freq), "document-frequency")
    top = df.orderBy(F.desc("df"), "term").limit(heavy)
    idf = F.log((n_documents + 1) / (F.col("df") + 1))
    first = tf.join(F.broadcast(top), "term", "left")
    frequent = first.where(F.col("df").isNotNull())
    others = first.where(F.col("df").isNull()).drop("df")
    rest = others.join(df, "term", "left")
    return frequent.unionByName(rest).select(*tf.columns, F.coalesce(F.col("tf") * idf, F.lit(0.0)).alias("tfidf"))


def with_slots(vocabulary: DataFrame, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """A table with each ``term`` once, with ``slot``: the index ``hashed_model`` gives the term.

    That is the 32-bit MurmurHash3 of its UTF-8 bytes (seed 42), as a signed number, modulo ``dimensions``.
    """
    alone = vocabulary.withColumn("alone", F.array("term"))
    hashed = HashingTF(numFeatures=dimensions, inputCol="alone", outputCol="place").transform(alone).drop("alone")
    return sparse_parts(hashed, "place").withColumn("slot", F.get("indices", F.lit(0))).drop("indices", "values")


def slot_collisions(terms: DataFrame, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """(slot, terms, posts, lost): what meets in each slot of ``terms`` (tweetid, term, ...).

    ``terms`` counts the different terms of a slot, ``posts`` the (post, term) rows, and ``lost`` those rows whose
    term is not the slot's most frequent one.
    """
    vocabulary = with_slots(terms.groupBy("term").agg(F.count("*").alias("n")), dimensions)
    return vocabulary.groupBy("slot").agg(
        F.count("*").alias("terms"), F.sum("n").alias("posts"), (F.sum("n") - F.max("n")).alias("lost")
    )


def hashed_terms(
    tf: DataFrame, n_documents, dimensions: int = HASH_DIMENSIONS, min_doc_freq: int = MIN_DOC_FREQ, heavy: int = HEAVY_TERMS
) -> DataFrame:
    """(tweetid, slot, tf, tfidf): the vectors of ``hashed_model`` as rows; a slot's terms are added up."""
    vocabulary = with_slots(tf.groupBy("term").agg(F.count("*").alias("posts")), dimensions)
    placed = with_heavy_apart(tf, vocabulary, "term", "posts", heavy)
    by_slot = stage(placed.groupBy("tweetid", F.col("slot").alias("term")).agg(F.sum("tf").alias("tf")), "slots")
    return tfidf_terms(by_slot, n_documents, min_doc_freq, heavy).withColumnRenamed("term", "slot")


def hashed_model(
    prepared: DataFrame, tokens: str = "ntokens", dimensions: int = HASH_DIMENSIONS,
    min_doc_freq: int = MIN_DOC_FREQ, fit_on: str = "all",
) -> PipelineModel:
    """HashingTF and IDF fitted on all posts, or on ``train`` posts alone."""
    stages = [
        HashingTF(numFeatures=dimensions, inputCol=tokens, outputCol="tf"),
        IDF(minDocFreq=min_doc_freq, inputCol="tf", outputCol="tfidf"),
    ]
    rows = prepared if fit_on == "all" else prepared.where(~F.col("is_validation"))
    return Pipeline(stages=stages).fit(rows)


def sparse_parts(vectors: DataFrame, column: str) -> DataFrame:
    """A sparse vector column as ``indices`` and ``values`` arrays.

    Parquet holds a vector as a struct, so a written table read under that type gives the parts
    without widening every row to all dimensions.
    """
    path = staged_path(vectors, "vectors")
    parts = T.StructType([
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ])
    schema = T.StructType([
        T.StructField(f.name, parts if f.name == column else f.dataType) for f in vectors.schema.fields
    ])
    return vectors.sparkSession.read.schema(schema).parquet(path).select(
        *[c for c in vectors.columns if c != column], f"{column}.*"
    )
