"""Which of many patterns stand in a text, by an Aho-Corasick automaton: one walk over the text, whatever the number of patterns.

Patterns are any texts, of any length and with any signs, and count wherever they stand, inside of words too. The automaton is built once in each worker
process and run over Arrow batches. What a text holds is told once for each pattern, so a result is as long as the patterns at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of one automaton; more go in several passes over the texts.
PATTERNS = 100_000


@lru_cache(maxsize=2)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        out.add_word(p, i)
    out.make_automaton()
    return out


machine = _automaton


def contained(c: Column, patterns: list[str]) -> Column:
    """The patterns (empty ones never) that the text contains, in their order; none for a null text."""
    wanted = tuple(dict.fromkeys(p for p in patterns if p))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(wanted) if wanted else None
        for batch in texts:
            yield pd.Series([[wanted[i] for i in sorted({i for _, i in machine.iter(t)})] if machine and t else [] for t in batch], index=batch.index, dtype=object)

    return found(c.cast("string"))


def pattern_blocks(patterns: DataFrame, size: int | None = None) -> Iterator[list[str]]:
    """The distinct texts of a one-column frame in lists of about `size`, so that the driver never holds all of a large set."""
    own = patterns.toDF("p").filter("p is not null and p <> ''").distinct()
    n = max(1, -(-own.count() // (size or PATTERNS)))
    for i in range(n):
        yield sorted(r["p"] for r in own.filter(F.pmod(F.xxhash64("p"), F.lit(n)) == i).collect())


def matches(texts: DataFrame, key: list[str], text: str, patterns: DataFrame, size: int | None = None) -> DataFrame:
    """(key, pattern): the patterns of a one-column frame that each text contains."""
    passes = [texts.select(*key, F.explode(contained(F.col(text), block)).alias("pattern")) for block in pattern_blocks(patterns, size)]
    return reduce(DataFrame.unionByName, passes)
