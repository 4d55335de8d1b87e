"""Exact candidates of a Jaccard join by prefix and position filters, in DataFrame operations.

The tokens of each set are ordered rarest first. Two sets of the wanted similarity must share one of their first n - ceil(t * n) + 1
tokens, and at the first token that they share enough tokens must be left in both for the overlap that the similarity needs. So sets that share only
what is common everywhere never meet, however many they are; no pair that is similar enough is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencia.llm.components import extended

#: Bits of a token's hash that stay beside its count; equal tokens stay equal, so that fewer bits can only add candidates.
TOKEN_BITS, MOST_TIMES = 43, 1 << 19


def rows(tokens: DataFrame, per_cent: int, keep) -> DataFrame:
    """(id, n, token, rest): the first tokens of each set, and how many follow, from rows (id, n, token); n is the size of the set.

    `keep` writes an intermediate table (common.scratch). Tokens of a set are different.
    """
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    key = F.shiftleft(F.least("times", F.lit(MOST_TIMES)), TOKEN_BITS).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)))
    listed = tokens.join(often, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(key)).alias("t"))
    # tokens that stand alone match nothing, but come first in the order
    alone = (F.col("n") - F.size("t")).alias("alone")
    length = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1 - alone
    prefix = listed.select("id", "n", alone, F.posexplode(F.slice("t", 1, F.greatest(length, F.lit(0)).cast("int"))).alias("at", "token"))
    return keep(prefix.select("id", "n", "token", (F.col("n") - F.col("alone") - F.col("at") - 1).alias("rest")), "prefixes")


def candidates(prefix: DataFrame, known: DataFrame, per_cent: int, one_of_each: bool) -> DataFrame:
    """(a, b), a < b: ids of different components whose sets can have that similarity; all of them, or one of each two components that share a token."""
    placed = prefix.join(known, "id", "left").withColumn("c", F.coalesce("component", "id")).select("id", "n", "token", "rest", "c")
    if one_of_each:
        one = F.max_by(F.struct("id", "n", "rest"), F.struct("rest", "id")).alias("one")
        placed = placed.groupBy("token", "c").agg(one).select("token", "c", "one.*")
    left = placed.select("token", *(F.col(x).alias(y) for x, y in (("id", "a"), ("c", "ca"), ("n", "na"), ("rest", "ra"))))
    right = placed.select("token", *(F.col(x).alias(y) for x, y in (("id", "b"), ("c", "cb"), ("n", "nb"), ("rest", "rb"))))
    sizes = 100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb")
    enough = (100 + per_cent) * (1 + F.least("ra", "rb")) >= per_cent * (F.col("na") + F.col("nb"))
    return left.join(right, "token").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes & enough).select("a", "b").distinct()


def connect(tokens: DataFrame, known: DataFrame, verify, per_cent: int, keep) -> DataFrame:
    """(id, component) after all sets of `tokens` in different components of `known` (id, component) that are similar are linked.

    verify() leaves the similar ones of pairs (a, b). One pair of each two components is tried first, so that two large
    ones that belong together do not meet in all their members; then all that are left.
    """
    prefix = rows(tokens, per_cent, keep)
    for one_of_each in (True, False):
        found = keep(verify(candidates(prefix, known, per_cent, one_of_each)), "missed")
        known = extended(known, found)
    return known
