"""Accounts as sets of tokens, kept as rows (account, kind, token).

A busy account is many rows like any other account, and never one big value: only the tokens of accounts of few posts
meet in arrays on the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from origintrace.constants import CHANNEL_KINDS, KIND_COLUMNS, LIST_COLUMNS
from origintrace.functions.tokens import concat_arrays, normalized
from origintrace.sources.staging import broadcast_if_small

ACCOUNT = ["is_validation", "sponsoring_country", "userid"]
BUSY = 1000  # posts of an account up to which its tokens meet as arrays in one task


def _rows(posts: DataFrame, label: str, label_of: dict[str, str]) -> DataFrame:
    """``_tokens`` of accounts of any size: every token is a row before it is compared."""
    sources = []
    for kind, columns in KIND_COLUMNS.items():
        if kind not in label_of:
            continue
        for c in columns:
            values = F.split(F.col(c), ", ") if c in LIST_COLUMNS else F.array(F.col(c))
            sources.append(F.struct(F.lit(label_of[kind]).alias(label), values.alias("values")))
    return (
        posts.select(*ACCOUNT, F.inline(F.array(*sources)))
        .select(*ACCOUNT, label, F.explode("values").alias("token"))
        .withColumn("token", normalized(F.col("token")))
        .where(F.col("token") != "")
        .distinct()
    )


def _gathered(posts: DataFrame, label: str, label_of: dict[str, str]) -> DataFrame:
    """``_tokens`` of accounts of few posts: the posts are shuffled, not their tokens, and an account stays in one task."""
    columns = {l: [c for k, some in KIND_COLUMNS.items() if label_of.get(k) == l for c in some] for l in label_of.values()}
    needed = dict.fromkeys([*ACCOUNT, *[c for some in columns.values() for c in some]])
    listed = lambda c: F.split(F.col(c), ", ") if c in LIST_COLUMNS else F.array(F.col(c))
    # Shuffled as they came, before any array: arrays are larger, and would be gathered for each file first.
    dealt = posts.select(*needed).repartition(*ACCOUNT)
    lists = dealt.select(*ACCOUNT, *[concat_arrays(*map(listed, some)).alias(f"list{i}") for i, some in enumerate(columns.values())])
    together = lists.groupBy(*ACCOUNT).agg(
        *[F.array_distinct(F.flatten(F.collect_list(f"list{i}"))).alias(f"list{i}") for i in range(len(columns))]
    )
    sets = F.array(*[F.struct(F.lit(l).alias(label), F.col(f"list{i}").alias("values")) for i, l in enumerate(columns)])
    return (
        together.select(*ACCOUNT, F.inline(sets))
        .select(*ACCOUNT, label, F.explode(F.array_distinct(F.transform("values", normalized))).alias("token"))
        .where(F.col("token") != "")
    )


def _tokens(posts: DataFrame, label: str, label_of: dict[str, str], busy: int = BUSY) -> DataFrame:
    """Distinct (account, label, token); ``label_of`` gives the label of a kind.

    Accounts of more than ``busy`` posts are kept apart, as rows from the start. The others end as rows of one task, so
    what is then grouped by account is combined before it is shuffled.
    """
    names = {c: f"busy_{c}" for c in ACCOUNT}
    counted = posts.groupBy(*ACCOUNT).agg(F.count("*").alias("n")).where(F.col("n") > busy)
    found = broadcast_if_small(counted.select(*[F.col(c).alias(n) for c, n in names.items()]), "busy-accounts")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    few, many = posts.join(found, same, "left_anti"), posts.join(found, same, "left_semi")
    return _gathered(few, label, label_of).unionByName(_rows(many, label, label_of))


def user_tokens(posts: DataFrame) -> DataFrame:
    """Distinct (account, kind, token) of flagged posts."""
    return _tokens(posts, "kind", {k: k for k in KIND_COLUMNS})


def channel_sets(posts: DataFrame, channels: list[str] = list(CHANNEL_KINDS)) -> DataFrame:
    """Distinct (account, channel, token): the sets the similarity joins compare."""
    return _tokens(posts, "channel", {k: c for c in channels for k in CHANNEL_KINDS[c]})


def token_counts(tokens: DataFrame) -> DataFrame:
    """Distinct tokens per account and kind."""
    return tokens.groupBy(*ACCOUNT, "kind").agg(F.count("*").alias("n_tokens"))


def user_profiles(posts: DataFrame) -> DataFrame:
    """The profile of every account as rows (account, kind, token), each token once.

    An account with a third of all posts is many rows like any other, never one value.
    """
    return user_tokens(posts).select(*ACCOUNT, "kind", "token")
