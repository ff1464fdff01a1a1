"""Union of dumps and cleaning of posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from origintrace.constants import DATASET_COLUMNS, LANGUAGE, LIST_COLUMNS, MODELLED_COUNTRIES
from origintrace.functions.tokens import bare_list


def combine(tables: list[tuple[str, str, DataFrame]], columns: list[str], language: str | None = LANGUAGE) -> DataFrame:
    """UNION ALL of raw tables given as (country, release, table), tagged with both.

    ``language`` keeps posts in one language; pass None for account tables.
    """
    tagged = [
        df.select(F.lit(country).alias("sponsoring_country"), F.lit(release).alias("release"), *columns)
        for country, release, df in tables
    ]
    union = reduce(DataFrame.unionByName, tagged)
    return in_language(union, language) if language else union


def united(rows: DataFrame, columns: list[str], language: str | None = LANGUAGE) -> DataFrame:
    """The same from dumps that were read as one table, with country and release by file name."""
    kept = rows if language is None else in_language(rows, language)
    return kept.where(F.col("sponsoring_country").isNotNull()).select("sponsoring_country", "release", *columns)


def in_language(posts: DataFrame, language: str = LANGUAGE) -> DataFrame:
    return posts.where(F.col("tweet_language") == language)


def clean_posts(posts: DataFrame, countries: list[str] = MODELLED_COUNTRIES) -> DataFrame:
    """Posts with text from the modelled countries, lists without brackets."""
    kept = posts.where(F.col("sponsoring_country").isin(countries) & F.col("tweet_text").isNotNull())
    return kept.select(*[bare_list(F.col(c)).alias(c) if c in LIST_COLUMNS else F.col(c) for c in DATASET_COLUMNS])
