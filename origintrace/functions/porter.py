"""English suffix stripping (Porter, 1980) as expressions over a table of words.

Every step is one projection, so no expression is copied into the next. A word goes along with its shape, a string of
``c`` and ``v`` for consonants and vowels. The shape of a beginning is the beginning of the shape, and what a step
puts in the place of a suffix has a shape of its own, so shapes are worked out once and then cut and joined like words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from origintrace.functions.stemming import STEP_2, STEP_3, STEP_4, VOWELS
from origintrace.sources.staging import stage

#: Name of the column with the shape of a word, as long as it is needed.
SHAPE = "shape of the stem"


def shape(word: Column) -> Column:
    """``v`` for each vowel, ``c`` for each other character; y is a vowel after a consonant."""
    plain = F.regexp_replace(F.regexp_replace(word, f"[^{VOWELS}y]", "c"), f"[{VOWELS}]", "v")
    # Only words with y need to be read letter by letter.
    read = F.aggregate(
        F.split(plain, ""), F.lit(""),
        lambda seen, x: F.concat(seen, F.when(x != "y", x).when(seen.endswith("c"), F.lit("v")).otherwise(F.lit("c"))),
    )
    return F.when(F.contains(plain, F.lit("y")), read).otherwise(plain)


def measure(shape: Column) -> Column:
    """How many runs of vowels are followed by consonants."""
    return F.length(shape) - F.length(F.replace(shape, F.lit("vc"), F.lit("c")))


def _has_vowel(shape: Column) -> Column:
    return F.contains(shape, F.lit("v"))


def _short_end(word: Column, shape: Column) -> Column:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return shape.endswith("cvc") & ~word.rlike("[wxy]$")


def _cut(column: Column, n: int | Column) -> Column:
    return F.left(column, F.length(column) - n)


def _when(words: DataFrame, stem: str, *rules: tuple[Column, Column, Column]) -> DataFrame:
    """The word and shape of the first rule (condition, word, shape) that holds, or those there are."""
    word, shape_ = F.when(F.lit(False), F.col(stem)), F.when(F.lit(False), F.col(SHAPE))
    for condition, new_word, new_shape in rules:
        word, shape_ = word.when(condition, new_word), shape_.when(condition, new_shape)
    return words.withColumns({stem: word.otherwise(F.col(stem)), SHAPE: shape_.otherwise(F.col(SHAPE))})


def _replace(words: DataFrame, stem: str, table: dict[str, str], least: int, condition: Column | None = None) -> DataFrame:
    """The longest suffix in ``table`` becomes what it stands for, if the measure before it is over ``least``.

    ``condition`` may use the columns ``suffix`` and ``before``. A match at the end that starts first is the longest.
    """
    found = words.withColumn("suffix", F.regexp_extract(stem, f"({'|'.join(table)})$", 1))
    cut = found.withColumn("before", _cut(F.col(stem), F.length("suffix"))).withColumn("shape before", _cut(F.col(SHAPE), F.length("suffix")))
    lookup = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("suffix")]
    shapes = [(k, "".join("v" if c in VOWELS else "c" for c in v)) for k, v in table.items()]
    goes = (F.col("suffix") != "") & (measure(F.col("shape before")) > least)
    goes = goes if condition is None else goes & condition
    new = (goes, F.concat("before", lookup(table.items())), F.concat("shape before", lookup(shapes)))
    return _when(cut, stem, new).drop("suffix", "before", "shape before")


def with_stems(words: DataFrame, word: str, stem: str) -> DataFrame:
    """``words`` with a column ``stem``, the stem of ``word`` in lower case.

    Words of one or two letters stay and null stays null. Meant for a table with each word once. The result is
    staged, as a filter on stems would else be pushed down through the steps, where every one repeats the last.
    """
    w, s = F.col(stem), F.col(SHAPE)
    drop = lambda n: (_cut(w, n), _cut(s, n))
    t = words.withColumn(stem, F.lower(word)).withColumn(SHAPE, shape(F.col(stem)))
    # 1a, plurals.
    t = _when(t, stem, (w.rlike("(sses|ies)$"), *drop(2)), (w.endswith("ss"), w, s), (w.endswith("s"), *drop(1)))
    # 1b, eed, ed and ing, and the mending of what the last two leave.
    eed, ed, ing = w.endswith("eed"), w.endswith("ed") & _has_vowel(_cut(s, 2)), w.endswith("ing") & _has_vowel(_cut(s, 3))
    t = t.withColumn("mend", ~eed & (ed | ing))
    t = _when(t, stem, (eed & (measure(_cut(s, 3)) > 0), *drop(1)), (eed, w, s), (ed, *drop(2)), (ing, *drop(3)))
    with_e, mend = (F.concat(w, F.lit("e")), F.concat(s, F.lit("v"))), F.col("mend")
    t = _when(
        t, stem, (mend & w.rlike("(at|bl|iz)$"), *with_e), (mend & w.rlike(r"([^lsz])\1$") & s.endswith("cc"), *drop(1)),
        (mend & (measure(s) == 1) & _short_end(w, s), *with_e),
    ).drop("mend")
    # 1c, y.
    t = _when(t, stem, (w.endswith("y") & _has_vowel(_cut(s, 1)), F.concat(_cut(w, 1), F.lit("i")), F.concat(_cut(s, 1), F.lit("v"))))
    # 2 to 4, suffixes.
    t = _replace(t, stem, STEP_2, 0)
    t = _replace(t, stem, STEP_3, 0)
    t = _replace(t, stem, dict.fromkeys(STEP_4, ""), 1, (F.col("suffix") != "ion") | F.col("before").rlike("[st]$"))
    # 5, e and ll.
    m = measure(_cut(s, 1))
    t = _when(t, stem, (w.endswith("e") & ((m > 1) | ((m == 1) & ~_short_end(_cut(w, 1), _cut(s, 1)))), *drop(1)))
    t = _when(t, stem, (w.endswith("ll") & (m > 1), *drop(1)))
    return stage(t.withColumn(stem, F.when(F.length(word) <= 2, F.lower(word)).otherwise(w)).drop(SHAPE), "stems")
