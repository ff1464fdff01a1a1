"""Column expressions on literal frames, with their odd cases."""

import math

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from origintrace.constants import CLASS_ORDER, STOP_WORDS
from origintrace.functions import porter, probability as prob, stemming, text as txt, tokens as tok
from origintrace.sources import catalog, fixtures


def one(spark, value, schema, expression):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, expected", [
    (None, []), ("", []), ("a, A,  a ", ["a"]), ("' a'", [" a"]), ("'', b", ["b"]), (" x\t, 'y'", ["x", "y"]),
    ("a,b", ["a,b"]),
])
def test_normalized_list(spark, value, expected):
    assert one(spark, value, "string", tok.normalized_list) == expected


@pytest.mark.parametrize("value, expected", [
    ("[]", None), ("[a, b]", "a, b"), ("[[a]]", "a"), ("]a[", "]a["), (None, None), ("a", "a"), ("[", ""),
])
def test_bare_list(spark, value, expected):
    assert one(spark, value, "string", tok.bare_list) == expected


def test_concat_arrays_takes_null_as_empty_and_keeps_duplicates(spark):
    df = spark.createDataFrame([(["a"], None, ["a", "b"])], "x array<string>, y array<string>, z array<string>")
    assert df.select(tok.concat_arrays(*map(F.col, "xyz"))).first()[0] == ["a", "a", "b"]


def test_drop_link_tokens(spark):
    words = [".", "..", "https://t.co/x", "http://t.co/", "https://t.com/x", "HTTPS://t.co/x", "word"]
    assert one(spark, words, "array<string>", tok.drop_link_tokens) == ["..", "https://t.com/x", "HTTPS://t.co/x", "word"]


@pytest.mark.parametrize("text, expected", [
    ("Hello, world!", ["Hello", "world", "!"]),
    ('("quoted") text...', ['("', "quoted", '")', "text", "..."]),
    ("a-b@c;d=e>f<g", list("abcdefg")),
    ("see https://t.co/Ab1. now", ["see", "https://t.co/Ab1", ".", "now"]),
    ("3.5 U.S. (x (y", ["3.5", "U.S", ".", "(", "x", "(", "y"]),
    ("", []), ("...", ["..."]), ("a\nb\tc", ["a", "b", "c"]), ("a. .b ?", ["a", ".", ".", "b", "?"]),
])
def test_tokens(spark, text, expected):
    assert one(spark, text, "string", txt.tokens) == expected


@pytest.mark.parametrize("text, n", [("One. Two! Three?", 3), ("No end", 1), ("v1.2 is out. Yes", 2), ("", 0), ("Hello there. ", 1),
                                      ("Dr. Smith left. So did Mr. Jones.", 2), (" \n ", 0)])
def test_sentences(spark, text, n):
    assert len(one(spark, text, "string", txt.sentences)) == n


def test_stop_words_are_those_of_mllib_and_rt(spark):
    assert STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english") + ["rt"]
    assert one(spark, ["The", "RT", "cat", "don't"], "array<string>", txt.without_stop_words) == ["cat"]


# Pairs printed in Porter's paper.
PUBLISHED = dict(pair.split(":") for pair in """
caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail
filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit
digitizer:digit radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic
operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit
sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope
goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust
defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog
communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat
rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil
""".split())


def test_stems_match_the_published_examples(spark):
    got = porter.with_stems(spark.createDataFrame([(w,) for w in PUBLISHED], "word string"), "word", "stem").collect()
    assert {r.word: r.stem for r in got} == PUBLISHED
    assert {w: stemming.stem_word(w) for w in PUBLISHED} == PUBLISHED


def test_both_stemmers_agree(spark, small):
    """On all words of the documents, and on words around the rules for y, doubled letters and short stems."""
    odd = "yyyy sayyyed yying hoppying fly say syzygy by ying yed eed ed ing ss s ies sses feed agreed bling a ab É ÉTÉ sion tion ational ﬁsh 😀s".split()
    words = fixtures.docs(spark, small).select(F.explode(txt.tokens(F.col("tweet_text"))).alias("word")).distinct()
    words = words.unionByName(spark.createDataFrame([(w,) for w in [*odd, None]], "word string")).withColumn("n", F.lit(1))
    got = porter.with_stems(words, "word", "stem").collect()
    assert len(got) > 1000 and all(r.stem == (r.word and stemming.stem_word(r.word)) for r in got)


def test_stems_of_arrays_keep_null_and_order(spark):
    df = spark.createDataFrame([(["Cats", "is", "running"],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in df.select(stemming.stems("x")).collect()] == [["cat", "is", "run"], None, []]
    many = spark.range(0, 5000, 1, 1).select(F.when(F.col("id") % 7 != 0, F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: F.when(
        i != 3, F.concat(F.lit("cats"), i.cast("string"), F.lit("s"))))).alias("x"))
    for r in many.select("x", stemming.stems("x").alias("y")).collect():
        assert r.y == (r.x and [w and w[:-1] for w in r.x])


def test_softmax(spark):
    assert one(spark, [0.0] * 4, "array<double>", prob.softmax) == [0.25] * 4
    huge = one(spark, [800.0, 0.0, -800.0, 1.0], "array<double>", prob.softmax)
    assert huge[0] == 1.0 and not any(map(math.isnan, huge))


@pytest.mark.parametrize("vector, expected", [
    ([0.1, 0.5, 0.5, 0.0], "china"), ([0.0] * 4, "russia"), ([0.0, 0.0, 0.0, 0.2], "venezuela"), (None, None),
])
def test_best_class_first_of_equals_wins(spark, vector, expected):
    assert one(spark, vector, "array<double>", lambda v: prob.best_class(v, CLASS_ORDER)) == expected


def test_blend_with_a_missing_side(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], None), (None, [0.2, 0.8]), (None, None)],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(prob.blend(F.col("a"), F.col("b"))).collect()]
    assert got == [[0.5, 0.5], [1.0, 0.0], [0.2, 0.8], None]


@pytest.mark.parametrize("name, expected", [
    ("saudi_arabia_201912_tweets_csv_hashed", ("saudi_arabia_201912_tweets_csv_hashed", "saudi_arabia", "201912")),
    ("bangladesh_linked_tweets_csv_hashed", ("bangladesh_201901_tweets_csv_hashed", "bangladesh", "201901")),
    ("venezuela_linked_tweets_csv_hashed", ("venezuela_201901_2_tweets_csv_hashed", "venezuela", "201901")),
    ("china_082019_1_tweets_csv_hashed", ("china_201908_1_tweets_csv_hashed", "china", "201908")),
    ("uae_112019_tweets_csv_hashed", ("uae_201911_tweets_csv_hashed", "uae", "201911")),
])
def test_table_names(spark, name, expected):
    df = spark.createDataFrame([(name,)], "table_name string")
    row = catalog.route_tables(df, "tweets").first()
    assert (row.corrected_name, row.sponsoring_country, row.release) == expected


def test_route_matches_as_like_does(spark):
    names = ["iran_201906_users_csv_hashed", "iran_201906_tweets_csv_hashed", "atlantis_1_tweets", "iran2_tweets"]
    df = spark.createDataFrame([(n,) for n in names], "table_name string")
    got = {r.table_name: (r.sponsoring_country, r.release) for r in catalog.route_tables(df, "tweets").collect()}
    assert got == {"iran_201906_tweets_csv_hashed": ("iran", "201906"), "iran2_tweets": ("iran", "")}


def test_tables_like(spark):
    spark.range(1).createOrReplaceTempView("iran_082019_tweets")
    spark.range(1).createOrReplaceTempView("iran_users")
    assert [r.table_name for r in catalog.tables_like(spark, "%082019%").collect()] == ["iran_082019_tweets"]
