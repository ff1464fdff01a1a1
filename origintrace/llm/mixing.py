"""Mixing sources to target weights by temperature, with DataFrame operations only.

A source with share p of all tokens gets weight p**a / sum(p**a). The exponent a is searched between 0 (all
sources alike) and 1 (as found) for a target entropy or for the flattest mix within a limit of repetitions.
Weights become token budgets, and a budget becomes whole passes over the source's documents plus the beginning
of one more, in the order of a seeded hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from origintrace.llm.columns import fresh, quoted
from origintrace.sources.staging import stage

#: Points at which one job tries the exponent, and rounds of such jobs: the interval shrinks to SECTIONS**-ROUNDS.
SECTIONS, ROUNDS = 32, 6
#: Hash blocks of one source that one round tells apart when it looks for the end of a partial pass, as bits.
BLOCK_BITS, BLOCK_ROUNDS = 10, 3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """Either ``entropy`` (nats, of the weights) or ``repeats`` (the most passes over any source).

    ``budget`` is the number of tokens to give out. Without it, the least budget is taken that gives every
    source one whole pass, so nothing is lost.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: int | None = None
    seed: int = 42


def token_count(text: str | Column) -> Column:
    """Words of a text, at least 1, so that an empty or null text has a cost too."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))).cast("long")


def source_key(source: str) -> Column:
    """A source as a key that is never null; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _order(seed: int, id_column: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_column))


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for ``sources`` (key, tokens): one small job per round, two numbers per point tried."""
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("state either an entropy or a limit of repetitions")
    total = sources.agg(F.sum("tokens")).first()[0]
    share, low, high = F.col("tokens") / F.lit(float(total)), 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        columns = []
        for i, a in enumerate(points):
            power, lift = F.pow(share, F.lit(a)), F.pow(share, F.lit(a - 1))
            columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"l{i}"), F.max(lift).alias(f"most{i}"), F.min(lift).alias(f"least{i}")]
        row = sources.agg(*columns).first()
        if target.entropy is not None:  # falls as the exponent grows
            fits = [math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"] >= target.entropy for i, a in enumerate(points)]
            last = max((i for i, ok in enumerate(fits) if ok), default=None)
            if last is None:
                return 0.0
            if last == SECTIONS:
                return high
            low, high = points[last], points[last + 1]
        else:  # repetitions fall as the exponent grows
            passes = [
                row[f"most{i}"] / row[f"least{i}"] if target.budget is None else target.budget / total * row[f"most{i}"] / row[f"z{i}"]
                for i in range(len(points))
            ]
            first = next((i for i, x in enumerate(passes) if x <= target.repeats), None)
            if first is None:
                return 1.0
            if first == 0:
                return low
            low, high = points[first - 1], points[first]
    return low if target.entropy is not None else high


def _budgets(sources: DataFrame, target: Target, a: float) -> DataFrame:
    """(key, tokens, weight, budget, passes, rest) for every source."""
    total = sources.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(total))
    z, least = sources.agg(F.sum(F.pow(share, F.lit(a))), F.min(F.pow(share, F.lit(a - 1)))).first()
    lift = F.pow(share, F.lit(a - 1))
    weight = F.pow(share, F.lit(a)) / F.lit(z)
    budget = F.round(F.col("tokens") * lift / F.lit(least)) if target.budget is None else F.round(weight * F.lit(float(target.budget)))
    return sources.select("key", "tokens", weight.alias("weight"), budget.cast("long").alias("budget")).select(
        "*", F.floor(F.col("budget") / F.col("tokens")).alias("passes"), (F.col("budget") % F.col("tokens")).alias("rest")
    )


def _cuts(costs: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, cut): the greatest hash up to which the documents of a source fit into ``rest`` tokens.

    Each round adds up tokens by hash block, at most 2**BLOCK_BITS blocks a source, finds the block that
    holds the end and looks into it alone; at last the few documents of one small block are added up.
    """
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # keeps the order of the signed hash as one of bit patterns
    state = plan.where("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("prefix"))
    for depth in range(1, BLOCK_ROUNDS + 1):
        shift, parent = 64 - BLOCK_BITS * depth, 64 - BLOCK_BITS * (depth - 1)
        inside = costs.join(state, "key")
        if depth > 1:
            inside = inside.where(F.shiftrightunsigned(unsigned, parent) == F.col("prefix"))
        blocks = (
            inside.groupBy("key", "rest", F.shiftrightunsigned(unsigned, shift).alias("prefix"))
            .agg(F.sum("cost").alias("cost"))
        )
        running = F.sum("cost").over(Window.partitionBy("key").orderBy("prefix"))
        found = blocks.select("key", "prefix", "rest", "cost", running.alias("upto")).where("upto > rest")
        first = found.groupBy("key").agg(F.min(F.struct("prefix", (F.col("rest") - (F.col("upto") - F.col("cost"))).alias("rest"))).alias("s"))
        state = stage(first.select("key", "s.rest", "s.prefix"), "cut-blocks")
    last = 64 - BLOCK_BITS * BLOCK_ROUNDS
    inside = costs.join(state, "key").where(F.shiftrightunsigned(unsigned, last) == F.col("prefix"))
    upto = F.sum("cost").over(Window.partitionBy("key").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    fitting = inside.select("key", "h", "rest", upto.alias("upto")).where("upto <= rest").groupBy("key").agg(F.max("h").alias("h"))
    start = F.shiftleft(F.col("prefix"), last).bitwiseXOR(F.lit(-(1 << 63)))
    return state.join(fitting, "key", "left").select("key", F.coalesce("h", start - 1).alias("cut"))


def mix(
    documents: DataFrame, target: Target, id_column: str = "doc_id", source: str = "source", text: str = "text", epoch: str = "mix_epoch",
) -> DataFrame:
    """The rows of ``documents``, each as often as its source's budget asks for, with the pass as ``epoch`` (from 0).

    A row's copies are ``passes`` of its source, plus one if its hash lies in the partial pass. Rows with the
    same id have the same hash and enter the partial pass together or not at all; it never goes over its budget.
    A null source is a source of its own; null and empty texts cost one token; an empty table stays empty.
    """
    h = _order(target.seed, id_column)
    costs = stage(documents.select(source_key(source).alias("key"), h.alias("h"), token_count(F.col(text)).alias("cost")), "costs")
    sources = stage(costs.groupBy("key").agg(F.sum("cost").alias("tokens")), "sources")
    if sources.isEmpty():
        return documents.withColumn(epoch, F.lit(0))
    plan = stage(_budgets(sources, target, exponent(sources, target)), "budgets")
    plan = stage(plan.join(_cuts(costs, plan), "key", "left").select("key", "passes", "cut"), "plan")
    key, place = fresh(documents, "mix_source"), fresh(documents, "mix_place")
    keyed = documents.withColumns({key: source_key(source), place: h})
    copies = (plan["passes"] + F.when(keyed[place] <= plan["cut"], 1).otherwise(0)).cast("int")
    repeated = F.sequence(F.lit(1), copies)
    return (
        keyed.join(plan, keyed[key] == plan["key"]).where(copies > 0)
        .select(*[keyed[c] for c in quoted(documents)], F.explode(repeated).alias(epoch)).withColumn(epoch, F.col(epoch) - 1)
    )


def permutation(id_column: str, seed: int = 42, epoch: str = "mix_epoch") -> Column:
    """A row's place: rows sorted by it are a new permutation of every source in each epoch."""
    return F.xxhash64(F.lit(seed), F.col(epoch), F.col(id_column))
