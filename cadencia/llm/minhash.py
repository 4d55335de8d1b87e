"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its 5-word shingles. Two small collections of `width` band hashes (each of `rows` minhashes)
give width * width tables: the key of table (i, j) joins band i of the first collection with band j of the second, so
that many tables cost only the square root of their minhashes. Exact copies of a set are one class and
appear once in the tables. In each bucket members are ordered so that those that agree in most further bands stand side by side,
in another order in each table, and meet the next few; pairs whose bands agree too seldom to be similar are left out at first.
Candidates are confirmed on full shingle sets, in rounds that skip pairs already known to be connected. Links and classes
meet in distributed connected components. The members of buckets that hold several components by then go through an exact join
(prefix and position filters over their rarest shingles, see prefixes.py), so that what stays to chance is only that two
similar documents share none of the tables.

Sets are held as 64-bit hashes of their shingles. Buckets that a sample shows to be very large are dealt in parts, along their order, to find neighbours.

Defined results: texts without a word have an empty set and link with nothing; rows with the same id are one node; a
null id is never linked (component null, kept); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common, prefixes
from cadencia.llm.components import connected_components, extended

WORDS = 5
SIMILARITY = 75  # per cent
WIDTH, ROWS = 10, 2
NEIGHBOURS = 2
#: Pairs of at least this similarity count as near misses; each is tried once more against the HUBS most typical members of the other side's
#: component, as copies of one text are often nearer to it than to each other.
NEAR, HUBS = 60, 32
#: Buckets with this many members in a 1-in-SAMPLE sample of documents are dealt in PARTS.
SAMPLE, HOT, PARTS = 256, 64, 64
#: A 64-bit outline of a class holds FIELD bits of each band. Pairs of which fewer than LEAST_FIELDS fields are equal are not similar
#: enough: at 75 % 12 of 20 fields are equal on average, and fewer than 7 in 4 of 1000 tables' worth of chances.
FIELD, LEAST_FIELDS = 3, 7
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(29).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of all texts, n + 1 offsets), repeats included."""
    raw, offs = common.text_bytes(column)
    n, raw = len(offs) - 1, _LOWER[raw]
    blank = _BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    begin = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1 if len(raw) else begin
    word = common.segment_hashes(common.BYTE_MIX[raw], begin, end - begin)
    count = np.diff(np.searchsorted(begin, offs))
    first = np.cumsum(count) - count
    each = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    out_at = np.r_[0, np.cumsum(each)]
    owner = np.repeat(np.arange(n), each)
    at = np.arange(len(owner)) - out_at[owner] + first[owner]
    size = np.minimum(count, words)[owner]
    h = size.astype(np.uint64)
    for j in range(words):
        h = np.where(j < size, h * _Q + word[np.minimum(at + j, max(len(word) - 1, 0))], h) if len(word) else h
    return _mix(h), out_at


def _sketch(df: DataFrame, id_col: str, text_col: str, width: int, rows: int, words: int) -> DataFrame:
    """(id, n_shingles, f1, f2, bands): set size, fingerprint of the set, and 2 * width band hashes (null for empty sets)."""
    by = _multipliers(2 * width * rows)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, text_col):
                h, at = shingles(b.column(1), words)
                n = len(at) - 1
                sizes, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                full = np.flatnonzero(np.diff(at))
                bands = np.zeros((n, 2 * width), np.uint64)
                for d in full:
                    own = np.unique(h[at[d] : at[d + 1]])
                    sizes[d], f1[d], f2[d] = len(own), own.sum(), np.bitwise_xor.reduce(own * _Q)
                if len(full):
                    for k, m in enumerate(by):
                        least = np.minimum.reduceat((h * m) >> np.uint64(32), at[full])
                        bands[full, k // rows] = _mix(bands[full, k // rows] * _Q + least)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((sizes > 0) * 2 * width)], pa.int32()), pa.array(bands[full].ravel().view(np.int64)))
                listed = pc.if_else(pa.array(sizes > 0), listed, pa.scalar(None, listed.type))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), listed], names=schema.names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, schema)


def _keys(width: int):
    return F.expr(f"flatten(transform(slice(bands, 1, {width}), (u, i) -> transform(slice(bands, {width + 1}, {width}), (v, j) -> xxhash64(u, v, i, j))))")


def _outline(width: int):
    """FIELD bits of every band in one number."""
    parts = F.transform("bands", lambda x, i: F.call_function("shiftleft", x.bitwiseAND((1 << FIELD) - 1), (i * FIELD).cast("int")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _equal_fields(x, y, width: int):
    """In how many bands two outlines agree."""
    d = x.bitwiseXOR(y)
    for k in range(1, FIELD):
        d = d.bitwiseOR(F.shiftright(x.bitwiseXOR(y), k))
    ones = sum(1 << (FIELD * i) for i in range(2 * width))
    return F.bit_count(F.bitwise_not(d).bitwiseAND(F.lit(ones)))


def _mates(classes: DataFrame, width: int, neighbours: int) -> DataFrame:
    """(key, id, near): the members of buckets of several classes, and their neighbours there that agree in enough bands.

    A bucket is ordered by the outline, turned so that another band leads in each table: classes that agree in most further
    bands stand side by side in some of the tables that they share.
    """
    bits = FIELD * 2 * width
    if bits > 62:
        raise ValueError("the outline of so many bands does not fit 64 bits")
    # few files hold many classes: dealt anew, so that all cores make the tables
    dealt = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    rows = dealt.select("id", _outline(width).alias("outline"), F.posexplode(_keys(width)).alias("table", "key"))
    # a bounded sample of documents finds the very large buckets; their number is bounded by its size over HOT
    hot = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT).select("key", F.lit(PARTS).alias("parts"))
    hot = common.materialize(hot, "hot")
    turn = (F.col("table") * 7 % (2 * width)) * FIELD
    turned = F.call_function("shiftright", F.col("outline"), turn.cast("int")).bitwiseOR(F.call_function("shiftleft", F.col("outline"), (bits - turn).cast("int")).bitwiseAND(F.lit((1 << bits) - 1)))
    rows = rows.select("id", "key", "outline", turned.alias("turned"))
    part, dealt = F.lit(0), F.lit(False)
    if hot.count():
        # very large buckets are cut where the turned outline changes, so neighbours stay together
        rows = rows.join(hot, "key", "left")
        part, dealt = F.pmod(F.shiftright("turned", bits - 12), F.coalesce("parts", F.lit(1))), F.col("parts").isNotNull()
    w = Window.partitionBy("key", part).orderBy("turned", "id")
    near = F.array(*(F.when(_equal_fields(F.col("outline"), F.lag("outline", k).over(w), width) >= LEAST_FIELDS, F.lag("id", k).over(w)) for k in range(1, neighbours + 1)))
    mate = F.lag("id", 1).over(w).isNotNull() | F.lead("id", 1).over(w).isNotNull() | dealt
    return rows.select("key", "id", F.array_compact(near).alias("near"), mate.alias("mate")).filter("mate").drop("mate")


def _pairs(mates: DataFrame) -> DataFrame:
    """(a, b, shared): neighbours, and in how many buckets."""
    pairs = mates.select("id", F.explode("near").alias("other"))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _mixed(mates: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of the members of buckets that hold several components."""
    placed = mates.join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("key")
    return placed.join(several, "key", "left_semi").select("id").distinct()


def _tokens(sets: DataFrame) -> DataFrame:
    """(id, n, token) of packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "hashes"):
                sizes = np.array([len(x) // 8 for x in b.column(1).to_pylist()], np.int64)
                token = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.repeat(sizes, sizes)), pa.array(token)], names=["id", "n", "token"])

    return sets.select("id", "hashes").mapInArrow(run, "id long, n long, token long")


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingle set as sorted 64-bit hashes) of the wanted ids, from the texts.

    A bit map of fixed size (2**26 bits, whatever the number of ids) keeps most other texts out of the join.
    """
    bits, page = 1 << 26, 8 * 4096
    place = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(bits)) + 1
    pages = wanted.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    table = np.zeros(bits // 8 + page, np.uint8)
    for r in pages:
        at = (r["page"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for whole in batches:
            p = whole.column(2).to_numpy() - 1
            whole = whole.filter(pa.array((flags[p >> 3] >> (p & 7)) & 1 == 1))
            for b in common.slices(whole, text_col):
                h, at = shingles(b.column(1), words)
                packed = [np.unique(h[at[d] : at[d + 1]]).tobytes() for d in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["id", "hashes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).filter(F.col("id").isNotNull()).withColumn("p", place)
    return rows.mapInArrow(run, "id long, hashes binary").join(wanted, "id", "left_semi")


def _compared(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, linked) of those pairs whose sets are similar enough, or nearly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, linked = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < NEAR * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= NEAR * (len(both) - shared))
                if keep[-1]:
                    linked.append(100 * shared >= per_cent * (len(both) - shared))
            kept = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    joined = first.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def _hub_pairs(classes: DataFrame, tried: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): ends of near misses against the most typical members of the component on the other side; known is (id, component) by the links of tried.

    A member is as typical as its band hashes are frequent in its component.
    """
    known = common.materialize(known.unionByName(known.select(F.col("component").alias("id"), "component").distinct()), "known")
    side = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    misses = tried.filter(~F.col("linked")).join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = misses.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    asks = apart.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("cb").alias("component")), F.struct(F.col("b").alias("id"), F.col("ca").alias("component")))).alias("s")).select("s.*").filter(F.col("component").isNotNull()).distinct()
    asks = common.materialize(asks, "asks")
    members = known.join(asks.select("component").distinct(), "component", "left_semi").join(classes, "id").select("id", "component", F.posexplode("bands").alias("band", "value"))
    common_values = members.groupBy("component", "band", "value").agg(F.count(F.lit(1)).alias("n"))
    typical = members.join(common_values, ["component", "band", "value"]).groupBy("component", "id").agg(F.sum("n").alias("weight"))
    best = Window.partitionBy("component").orderBy(F.desc("weight"), "id")
    hubs = typical.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= HUBS).select("component", F.col("id").alias("hub"))
    return asks.join(hubs, "component").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components of known."""
    left = pairs.join(known.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    both = left.join(known.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "shared")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, per_cent: int = SIMILARITY, width: int = WIDTH, rows: int = ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of df."""
    sketches = common.materialize(_sketch(df, id_col, text_col, width, rows, words), "sketches")
    full = sketches.filter(F.col("n_shingles") > 0)
    heads = full.filter(F.col("id").isNotNull()).groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("head"))
    classes = common.materialize(full.join(heads, ["f1", "f2", "n_shingles"]).filter(F.col("id") == F.col("head")).select("id", "bands").dropDuplicates(["id"]), "classes")
    with common.scratch() as keep:
        mates = keep(_mates(classes, width, neighbours), "mates")
        pairs = keep(_pairs(mates), "pairs")
        sets = keep(_sets(df, id_col, text_col, mates.select("id").distinct(), words), "sets")
        tried, known, left = None, None, pairs
        # first the likeliest partner of each class, then a few, then whatever is not connected by then, then typical members
        for most in (1, 4, None):
            turn = left
            if most is not None:
                likeliest = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
                ranked = left.withColumn("nth", F.row_number().over(likeliest))
                turn, left = ranked.filter(F.col("nth") <= most), ranked.filter(F.col("nth") > most).select("a", "b", "shared")
            found = keep(_compared(turn.select("a", "b"), sets, per_cent), "tried")
            tried = found if tried is None else tried.unionByName(found)
            linked = found.filter("linked").select("a", "b")
            known = connected_components(linked) if known is None else extended(known, linked)
            if most is not None:
                left = keep(_apart(left, known), "left")
        # whoever stands in a near miss or a component has a neighbour, so the sets are known
        known = extended(known, keep(_compared(_hub_pairs(classes, tried, known), sets, per_cent).filter("linked").select("a", "b"), "links"))
        # what neighbours, outlines and typical members missed
        apart = sets.join(keep(_mixed(mates, known), "mixed"), "id", "left_semi")
        verify = lambda some: _compared(some, sets, per_cent).filter("linked").select("a", "b")
        known = prefixes.connect(keep(_tokens(apart), "tokens"), known, verify, per_cent, keep)
        # rows that share an id are one node: their classes are linked too
        twins = full.join(heads, ["f1", "f2", "n_shingles"]).filter(F.col("id") != F.col("head")).select(F.col("head").alias("a"), F.col("id").alias("b"))
        component = extended(known, _repeated(twins))
    placed = sketches.join(heads, ["f1", "f2", "n_shingles"], "left").withColumn("node", F.coalesce("head", "id"))
    out = placed.join(component.select(F.col("id").alias("node"), "component"), "node", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def _repeated(twins: DataFrame) -> DataFrame:
    """Links between classes that hold rows of one repeated id."""
    return twins.join(twins.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b"), "b", "left_semi").select("a", "b")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))
