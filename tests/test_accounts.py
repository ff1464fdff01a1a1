"""Split, profiles, similarity joins and scores against brute force on small inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from origintrace.constants import CLASS_ORDER
from origintrace.operators import blocks, clean, minhash, profiles, scores, similarity, split
from origintrace.plans import user_level
from origintrace.sources import fixtures

USERS = "sponsoring_country string, userid string, n_posts bigint"


def key(country, user):
    return hashlib.md5(f"{country}|{user or ''}|42".encode()).hexdigest()


def brute_split(users, share=0.1):
    by_country = defaultdict(list)
    for c, u, n in users:
        by_country[c].append((key(c, u), u, n))
    flags = {}
    for c, rows in by_country.items():
        cap, total = int(share * sum(r[2] for r in rows)), 0
        for i, (_, u, n) in enumerate(sorted(rows)):
            flags[c, u] = i == 0 or total < cap
            total += n
    return flags


@pytest.mark.parametrize("users", [
    [("a", str(i), 1 + i % 7) for i in range(500)] + [("b", str(i), 0 if i % 3 else 5) for i in range(200)],
    [("a", str(i), 1) for i in range(9)],  # cap 0 still takes one account
    [("a", "x", 1_000_000)] + [("a", str(i), 1) for i in range(100)],  # one account holds nearly all
])
@pytest.mark.parametrize("digits", [1, 3])
def test_split_equals_walking_the_accounts_in_order(spark, users, digits):
    df = spark.createDataFrame(users, USERS)
    cuts = split.cut_keys(df, bucket_digits=digits)
    got = {(r[0], r[1]): r.is_validation for r in split.flag_validation(df, cuts).collect()}
    assert got == brute_split(users)


def test_split_properties(spark, small):
    users = split.posts_per_user(clean.clean_posts(fixtures.posts(spark, small)))
    rows = split.split_users(users).collect()
    for country in CLASS_ORDER:
        mine = [r for r in rows if r.sponsoring_country == country]
        taken = [r.n_posts for r in mine if r.is_validation]
        cap = int(0.1 * sum(r.n_posts for r in mine))
        assert taken and cap <= sum(taken) and sum(taken) - max(taken) < cap + max(taken)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        again = split.split_users(users).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(rows) == sorted(again)


def test_an_account_without_id_is_training(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", "x", 5)], USERS)
    flags = {r.userid: r.is_validation for r in split.split_users(df).collect()}
    assert flags[None] is False


POST = "is_validation boolean, sponsoring_country string, " + ", ".join(
    f"{c} string" for c in ["tweetid", "userid", "user_profile_url", "in_reply_to_userid", "in_reply_to_tweetid",
                            "quoted_tweet_tweetid", "retweet_userid", "retweet_tweetid", "hashtags", "urls", "user_mentions"])


def test_profiles(spark):
    df = spark.createDataFrame([
        (False, "iran", "1", "u", "http://p/a, b", None, None, None, None, "9", "X, 'y'", None, "m, u"),
        (False, "iran", "2", "u", "http://p/a, b", "r", "7", "8", "q", None, "x", "w, w", None),
    ], POST)
    found = {}
    for r in profiles.user_profiles(df).collect():
        found.setdefault(r.kind, set()).add(r.token)
    assert found == {
        "hashtags": {"x", "y"}, "urls": {"http://p/a, b", "w"},  # a profile link with ", " stays whole
        "related_tweetids": {"1", "2", "7", "8", "9"}, "related_userids": {"m", "q", "r", "u"},
    }


def test_profiles_of_a_busy_account_are_rows_like_any_other(spark):
    posts = [(False, "iran", str(i), "busy", None, None, None, None, None, None, None, None, None) for i in range(500)]
    posts += [(True, "iran", f"x{i}", f"calm{i}", None, None, None, None, None, None, None, None, None) for i in range(1000)]
    rows = profiles.user_profiles(spark.createDataFrame(posts, POST)).collect()
    busy = [r.token for r in rows if r.userid == "busy" and r.kind == "related_tweetids"]
    assert sorted(busy) == sorted(str(i) for i in range(500))
    assert sum(r.userid == "busy" and r.kind == "related_userids" for r in rows) == 1
    assert sum(r.userid == "calm7" for r in rows) == 2


def test_tokens_of_an_account_end_in_one_task_unless_it_is_busy(spark):
    """Whatever the bound, the same rows as brute force; up to it, an account's rows are in one partition."""
    rng = random.Random(3)
    some = lambda values: rng.choice([None, "", *values])
    lists = ["A, b, 'a'", "b", " c , , B", "[]"]
    posts = [(u % 3 == 0, rng.choice(["iran", "china", None]), some([str(i)]), None if u == 5 else f"u{u}", some(["http://p/x, y"]), some(["r"]),
              some(["7"]), None, some(["q", " Q'"]), some(["9"]), some(lists), some(lists), some(lists)) for u in range(12) for i in range(6)]
    names = [f.split()[0] for f in POST.split(", ")]
    expected = set()
    for row in (dict(zip(names, p)) for p in posts):
        for kind, columns in profiles.KIND_COLUMNS.items():
            for c in columns:
                values = [] if row[c] is None else row[c].split(", ") if c in profiles.LIST_COLUMNS else [row[c]]
                expected |= {(row["is_validation"], row["sponsoring_country"], row["userid"], kind, t)
                             for t in (v.lower().strip().strip("'") for v in values) if t}
    df = spark.createDataFrame(posts, POST)
    for busy in (0, 3, 1000):
        got = profiles._tokens(df, "kind", {k: k for k in profiles.KIND_COLUMNS}, busy).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = profiles.channel_sets(df).select(*profiles.ACCOUNT, F.spark_partition_id().alias("at")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(Counter(tuple(r)[:3] for r in placed).values()) == 1 and len({r["at"] for r in placed}) > 1


SETS = "is_validation boolean, sponsoring_country string, userid string, channel string, token string"


def random_sets(seed, n_users=60, hot=6, cold=80):
    rng = random.Random(seed)
    rows = set()
    for u in range(n_users):
        val = u % 4 == 0
        country = CLASS_ORDER[u % 3]
        for channel in ("combined", "users"):
            tokens = {f"own{u}"} | {f"hot{h}" for h in range(hot) if rng.random() < 0.4}
            tokens |= {f"cold{rng.randrange(cold)}" for _ in range(rng.randrange(0, 12))}
            if u % 10 == 0:
                tokens |= {f"long{u}-{i}" for i in range(60)}
            if u % 7 == 0:
                tokens = {"hot0", "hot1"}  # copies of one set
            rows |= {(val, country, f"u{u}", channel, t) for t in tokens}
    return sorted(rows)


def brute_pairs(rows):
    sets = defaultdict(set)
    for val, country, user, channel, token in rows:
        sets[val, channel, country, user].add(token)
    out = {}
    for (v1, ch1, c1, u1), a in sets.items():
        for (v2, ch2, c2, u2), b in sets.items():
            if not v1 and v2 and ch1 == ch2 and 10 * len(a & b) > len(a | b):
                out[ch1, c1, u1, c2, u2] = len(a & b) / len(a | b)
    return out


SETTINGS = [
    similarity.Settings(),
    similarity.Settings(words=1, hot_pairs=0, cell=3),
    similarity.Settings(words=2, sketch=1, hot_pairs=20, cell=1),
    similarity.Settings(words=1, sketch=2, hot_pairs=10**9, cell=2048),
    similarity.Settings(words=3, hot_pairs=0, cold_pairs=0, cell=5),
    similarity.Settings(words=3, hot_pairs=0, cold_pairs=1),
]


@pytest.mark.parametrize("settings", SETTINGS, ids=str)
def test_similar_pairs_and_scores_equal_brute_force_at_any_setting(spark, settings):
    rows = random_sets(1)
    expected = brute_pairs(rows)
    indexed = similarity.index_sets(spark.createDataFrame(rows, SETS), settings)
    got = similarity.similar_pairs(indexed).collect()
    assert len(got) == len(expected)
    assert {tuple(r)[:5]: r.similarity for r in got} == pytest.approx(expected)

    sums, counts = Counter(), Counter()
    for (_, country, _, _, user), value in expected.items():
        sums[user, country] += value
        counts[user, country] += 1
    scored = similarity.neighbour_scores(indexed).collect()
    assert {(r.userid, r.country): r.neighbours for r in scored} == dict(counts)
    assert {(r.userid, r.country): r.similarity for r in scored} == pytest.approx(dict(sums))
    of_edges = scores.scores_of_edges(scores.similarity_edges(similarity.similar_pairs(indexed))).collect()
    assert {(r.userid, r.country): r.similarity for r in of_edges} == pytest.approx(dict(sums))


@pytest.mark.parametrize("settings", [similarity.Settings(), similarity.Settings(words=3, hot_pairs=0, cold_pairs=0, block=(7, 3))], ids=str)
@pytest.mark.parametrize("by_blocks", [True, False])
def test_scores_by_blocks_and_by_bits_equal_brute_force(spark, settings, by_blocks):
    rows = random_sets(4, hot=70)
    sums, counts = Counter(), Counter()
    for (_, country, _, _, user), value in brute_pairs(rows).items():
        sums[user, country] += value
        counts[user, country] += 1
    scored = similarity.neighbour_scores(similarity.index_sets(spark.createDataFrame(rows, SETS), settings), by_blocks).collect()
    assert {(r.userid, r.country): r.neighbours for r in scored} == dict(counts)
    assert {(r.userid, r.country): r.similarity for r in scored} == pytest.approx(dict(sums))


def test_scores_meet_in_blocks_where_all_accounts_share_much(spark):
    """60 accounts with the same 30 tokens each and two of their own: 45 * 15 pairs, behind 27 bits or more."""
    rows = [(u % 4 == 0, "iran", f"u{u}", "users", t) for u in range(60) for t in [f"t{i}" for i in range(30 + u % 7)] + [f"own{u}"]]
    indexed = similarity.index_sets(spark.createDataFrame(rows, SETS), similarity.Settings(hot_pairs=0))
    text = similarity.neighbour_scores(indexed)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in text
    chosen, never = (sorted(map(tuple, similarity.neighbour_scores(indexed, b).collect())) for b in (None, False))
    assert [r[:3] for r in chosen] == [r[:3] for r in never] and [r[3] for r in chosen] == pytest.approx([r[3] for r in never])


@pytest.mark.parametrize("cold_pairs, hot", [(0, 70), (10**6, 6)])
def test_pairs_are_not_shuffled_to_be_counted_and_blocks_are_many(spark, cold_pairs, hot):
    """Seven blocks of training and three of validation accounts or more, with hot tokens as bits and without."""
    rows = random_sets(5, hot=hot)
    settings = similarity.Settings(words=2, hot_pairs=0, cold_pairs=cold_pairs, pair_block=(6, 6))
    indexed = similarity.index_sets(spark.createDataFrame(rows, SETS), settings)
    for found in (similarity.similar_pairs(indexed), minhash.minhash_pairs(spark.createDataFrame(rows, SETS), 20, by_tables=False)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert "Aggregate" not in above and "Join" not in above and "Repartition" not in above
    got = similarity.similar_pairs(indexed).collect()
    want = brute_pairs(rows)
    assert len(got) == len(want) and {tuple(r)[:5]: r.similarity for r in got} == pytest.approx(want)


def test_blocks_count_what_is_shared_at_any_cut(monkeypatch):
    """Accounts of several rows, in batches of any size, and pieces of few tokens."""
    rng = random.Random(6)
    tokens = {i: rng.sample(range(40), rng.randrange(1, 25)) for i in range(30)}
    rows = []
    for block in (0, 1):
        for val in (True, False):
            for i in range(30):
                if (i % 3 == 0) == val:
                    for part in (0, 1, 2):
                        held = [t for t in tokens[i] if t % 3 == part]
                        rows.append((block, val, i, "users", len(tokens[i]) + block, 0, "iran", f"u{i}", held))
    names = ["block", "is_validation", "id", "channel", "n", "m0", "sponsoring_country", "userid", "tokens"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    want = {(b, i, j): len(set(tokens[i]) & set(tokens[j])) for b in (0, 1) for i in tokens if i % 3 for j in tokens if j % 3 == 0}
    want = {k: v for k, v in want.items() if v}
    for met in (1, 7, 1 << 21):
        monkeypatch.setattr(blocks, "MET", met)
        for size in (1, 4, 1000):
            got, order = {}, iter([0, 1])
            last = None
            for held, train in blocks._sides(iter(table.to_batches(max_chunksize=size)), ["m0"]):
                if held is not last:
                    last, block = held, next(order)
                for _, _, (mine, place, shared) in held.met(train):
                    got |= {(block, int(train.ids[m]), int(held.ids[p])): int(c) for m, p, c in zip(mine, place, shared)}
            assert got == want


def test_threshold_is_strict(spark):
    a, b = [f"t{i}" for i in range(5)], ["t0"] + [f"o{i}" for i in range(5)]  # 1 of 10
    rows = [(False, "iran", "a", "users", t) for t in a] + [(True, "iran", "b", "users", t) for t in b]
    assert similarity.similar_pairs(similarity.index_sets(spark.createDataFrame(rows, SETS))).count() == 0
    rows.pop()  # 1 of 9
    assert similarity.similar_pairs(similarity.index_sets(spark.createDataFrame(rows, SETS))).count() == 1


def test_as_many_tokens_are_hot_as_their_pairs_call_for(spark):
    """200 tokens that all accounts of a group share, more pairs behind the first ones; and accounts that share nothing."""
    rows = [(u % 4 == 0, "iran", f"u{u}", "users", f"t{t}") for u in range(60) for t in range(200) if u % (t // 40 + 1) == 0]
    rows += [(False, "iran", f"alone{u}", "users", f"own{u}-{t}") for u in range(100) for t in range(20)]
    df = spark.createDataFrame(rows, SETS)
    words = lambda **more: similarity.index_sets(df, similarity.Settings(hot_pairs=4, **more)).settings.words
    assert words(cold_pairs=10**6) == 1 and words(cold_pairs=0) == 4 and words(cold_pairs=0, words=2) == 2
    assert 1 <= words(cold_pairs=5) <= words(cold_pairs=1) <= 4
    with_hot, without = (similarity.index_sets(df, similarity.Settings(hot_pairs=h, cold_pairs=0)) for h in (4, 10**9))
    pairs = lambda x: sorted(map(tuple, similarity.similar_pairs(x).collect()))
    assert pairs(with_hot) == pairs(without)


def agreeing(rows, n_tables, seed=42):
    """The exact pairs whose minima agree in a table, by the definition."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % minhash.PRIME
    sets = defaultdict(set)
    for val, country, user, channel, token in rows:
        sets[val, channel, country, user].add(number(token))
    tables = minhash.coefficients(n_tables, seed)
    minima = {k: [min((x * a + b) % minhash.PRIME for x in v) for a, b in tables] for k, v in sets.items()}
    return {
        k: v for k, v in brute_pairs(rows).items()
        if any(x == y for x, y in zip(minima[False, k[0], k[1], k[2]], minima[True, k[0], k[3], k[4]]))
    }


@pytest.mark.parametrize("by_tables", [True, False, None])
@pytest.mark.parametrize("settings", [similarity.Settings(), similarity.Settings(words=1, sketch=1, hot_pairs=0, cell=2)], ids=str)
def test_minhash_pairs_are_the_exact_ones_that_agree(spark, by_tables, settings):
    rows = random_sets(2)
    df, exact = spark.createDataFrame(rows, SETS), brute_pairs(rows)
    for n_tables, seed in ((20, 42), (1, 7)):
        want = agreeing(rows, n_tables, seed)
        got = minhash.minhash_pairs(df, n_tables, seed, settings, by_tables).collect()
        assert len(got) == len(want) and {tuple(r)[:5]: r.similarity for r in got} == pytest.approx(want)
        assert n_tables == 1 or len(want) > 0.9 * len(exact)


def test_minhash_looks_at_fewer_pairs_where_large_sets_share_little(spark):
    """Sets of 100 of 2,000 tokens: any two share a few, and hardly any two are similar but the planted copies."""
    rng = random.Random(3)
    rows = []
    for u in range(150):
        tokens = rng.sample(range(2000), 100) if u % 10 != 1 else tokens[:90] + rng.sample(range(2000, 3000), 10)
        rows += [(u % 10 == 1, "iran", f"u{u}", "users", f"t{t}") for t in tokens]
    df = spark.createDataFrame(rows, SETS)
    indexed = similarity.index_sets(df)
    _, cells = minhash._bucketed(indexed, minhash.signatures(df, 20), 20)
    assert cells.agg(F.sum("pairs")).first()[0] * 2 < indexed.cost
    got = {tuple(r)[:5]: r.similarity for r in minhash.minhash_pairs(df, 20).collect()}
    assert got == pytest.approx(agreeing(rows, 20)) and len(got) >= 15


def test_score_vectors_have_one_slot_per_class_and_zero_without_neighbours(spark):
    users = spark.createDataFrame([("u",), ("v",), ("v",)], "userid string")
    found = spark.createDataFrame([("u", "iran", 2.0), ("u", "atlantis", 9.0)], "userid string, country string, similarity double")
    vectors = scores.score_vectors(users, found)
    assert {r.userid: r.score for r in vectors.collect()} == {"u": [0.0, 0.0, 2.0, 0.0], "v": [0.0] * 4}
    sizes = scores.class_sizes(spark.createDataFrame([("iran",), ("iran",), ("china",)], "sponsoring_country string"))
    normal = scores.normalized_scores(vectors, sizes)
    assert {r.userid: r.score for r in normal.collect()} == {"u": [0.0, 0.0, 1.0, 0.0], "v": [0.0] * 4}
    p = {r.userid: r.probability for r in scores.softmax_scores(normal).collect()}
    assert p["v"] == [0.25] * 4 and sum(p["u"]) == pytest.approx(1.0)


def test_class_size_can_count_training_accounts(spark, small):
    posts = user_level.account_posts(fixtures.posts(spark, small))
    by_val = {r.userid: r.score for r in user_level.normalized(posts).collect()}
    by_train = {r.userid: r.score for r in user_level.normalized(posts, size_of="training").collect()}
    assert by_val.keys() == by_train.keys() and by_val != by_train
