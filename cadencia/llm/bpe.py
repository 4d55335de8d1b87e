"""BPE encoding and decoding through a table of distinct words.

Documents are split into words in Spark; every distinct word of the corpus is encoded once; the ids come back to the
documents by position. Work goes in blocks of documents. A block's distinct words, numbered by falling frequency, travel to
the word table, which is dealt by the words' hash; their ids travel back to the block. There they meet the
block's documents, which travel as word numbers only, so that neither texts nor one row for each word move. For decoding, the distinct ids of
each block are joined with the table of pieces (one row for each id of the vocabulary, so it is broadcast), and the pieces come to the block with the
ids: its documents look theirs up by position. decode_ids() does the same for ids that come from elsewhere.

Blocks are cut by the scan's partitions, which both passes over the texts read alike. A block's name is a digest of its
list of words, in which a word is known by two independent 64-bit hashes; a block that was cut differently finds no list and raises an error rather
than a wrong result.

Defined results: null and empty texts have no ids; repeated rows are encoded each; special tokens' strings in a text count as
these tokens; an empty table gives no rows; columns other than doc_id and text are not read; decode_ids() gives null for null ids and raises on ids that the vocabulary does not have.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.llm import common, tokens

BLOCK_CHARS = 24_000_000
_SLICE_BYTES = 1_500_000
_DOCS_A_ROW = 256
#: Parts of the word table that a task goes through one after the other.
PARTS_A_TASK = 4
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CHECK = np.uint64(0xA24BAED4963EE407)


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = _SPACE
    return out


@functools.cache
def _mixes() -> np.ndarray:
    return np.random.default_rng(41).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _second(mixed: np.ndarray) -> np.ndarray:
    """Other numbers for the same characters, so that sums of these are independent of sums of the first."""
    return (mixed ^ (mixed >> np.uint64(29))) * _CHECK


def split_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where a word begins, by tokens.SPLIT_PATTERN, in texts that begin at `first` (the last is the end)."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    head, tail = edge[:-1], edge[1:]  # first and last place of each text
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last of a run of white space before a word: a blank joins the word, another one is a word by itself
    before_word = space & ~tail
    before_word[:-1] &= ~space[1:]
    start |= before_word
    joins = np.flatnonzero(before_word & (code == 32)) + 1
    start[joins] = False
    quote = np.flatnonzero(start & (code == 39) & ~tail)
    if len(quote):
        left = np.searchsorted(first, quote, "right")
        left = first[left] - quote  # characters from the quote to the end of its text
        a = code[quote + 1]
        b = code[np.minimum(quote + 2, n - 1)]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = (left > 2) & (((b == ord("e")) & np.isin(a, [ord("r"), ord("v")])) | ((a == ord("l")) & (b == ord("l"))))
        for width, on in ((2, two), (3, three & ~two)):
            at = quote[on]
            start[at + 1] = False
            after = at + width
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


def _segments(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces of texts, text of each, whether each is a special token's string): these stand alone."""
    if not any(s in t for t in texts for s in special):
        return texts, np.arange(len(texts)), np.zeros(len(texts), bool)
    out, owner = [], []
    for i, text in enumerate(texts):
        parts = [text]
        for s in special:
            parts = [p for x in parts for p in _between(x, s, special)]
        out += parts
        owner += [i] * len(parts)
    return out, np.array(owner), np.isin(out, special)


def _between(text: str, mark: str, special: list[str]) -> list[str]:
    if text in special:
        return [text]
    bits = text.split(mark)
    return [x for b in bits for x in (b, mark)][:-1]


def split_words(texts: list[str], special: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all text, word starts, word lengths, text of each word, word hashes)."""
    pieces, owner, alone = _segments(texts, special)
    sizes = np.array([len(p) for p in pieces], np.int64)
    joined = "".join(pieces)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.r_[0, np.cumsum(sizes)]
    starts = split_starts(code, first)
    if alone.any():  # inside of a special token's string there are no words
        whole = np.flatnonzero(alone)
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, first[whole] + 1, 1)
        np.add.at(inside, first[whole + 1], -1)
        starts = starts[np.cumsum(inside)[starts] == 0]
    lengths = np.diff(np.r_[starts, len(code)])
    hashes = common.segment_hashes(_mixes()[code], starts, lengths)
    return joined, starts, lengths, owner[np.searchsorted(first, starts, "right") - 1] if len(starts) else starts, hashes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the first of each key, number of the key of each row, in the order of the keys) of keys of two hashes each."""
    _, first, kind = np.unique(keys[:, 0], return_index=True, return_inverse=True)
    if (keys[:, 1] != keys[first[kind], 1]).any():  # two words with one first hash
        _, first, kind = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return first, kind.ravel()


class _Block:
    """Documents and their words, until the block is full."""

    def __init__(self, special: list[str], with_words: bool) -> None:
        self.special, self.with_words = special, with_words
        self.chars, self.keys, self.counts, self.codes, self.words, self.docs, self.ids = 0, [], [], [], [], [], []

    def add(self, texts: list[str], ids: pa.Array) -> None:
        joined, starts, lengths, owner, hashes = split_words(texts, self.special)
        check = common.segment_hashes(_second(_mixes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]), starts, lengths)
        keys = np.stack([hashes, check], axis=1)
        at, inverse = _distinct(keys)
        if self.with_words:
            self.words += [joined[a:z].encode() for a, z in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)]
        else:
            self.codes.append(inverse.astype(np.uint32))
            self.docs.append(np.bincount(owner, minlength=len(texts)))
            self.ids.append(ids)
        self.keys.append(keys[at])
        self.counts.append(np.bincount(inverse, minlength=len(at)))
        self.chars += len(joined)

    def ranked(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
        """(keys of distinct words by falling frequency, place of each in self.words, number of each word of each slice, the block's name)."""
        keys = np.concatenate(self.keys)
        first, kind = _distinct(keys)
        times = np.bincount(kind, np.concatenate(self.counts), len(first))
        order = np.lexsort((keys[first, 1], keys[first, 0], -times))
        rank = np.empty(len(first), np.uint32)
        rank[order] = np.arange(len(first), dtype=np.uint32)
        cuts = np.cumsum([len(k) for k in self.keys])[:-1]
        name = int.from_bytes(hashlib.sha256(np.ascontiguousarray(keys[first][order]).tobytes()).digest()[:8], "little", signed=True)
        return keys[first][order], first[order], np.split(rank[kind], cuts), name


def _blocks(batches: Iterator[pa.RecordBatch], special: list[str], with_words: bool) -> Iterator[_Block]:
    block = _Block(special, with_words)
    for whole in batches:
        for b in common.slices(whole, "text", _SLICE_BYTES):
            block.add(common.text_array(b.column("text")).to_pylist(), b.column(0))
            if block.chars >= BLOCK_CHARS:
                yield block
                block = _Block(special, with_words)
    if block.keys:
        yield block


def _word_rows(df: DataFrame, path: str, parts: int) -> DataFrame:
    """(part, block, numbers, words): a block's distinct words for one part of the word table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = [t.decode() for t in tokens.load(path)[1].values()]
        for block in _blocks(batches, special, True):
            keys, place, _, name = block.ranked()
            part = (keys[:, 0] % np.uint64(parts)).astype(np.int64)
            rows = []
            for p in range(parts):
                mine = np.flatnonzero(part == p)
                words = [block.words[i] for i in place[mine].tolist()]
                sizes = np.array([len(w) for w in words], np.uint32)
                rows.append((p, name, common.planes(np.diff(mine, prepend=0)), common.planes(sizes), zlib.compress(b"".join(words), 1)))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.binary()) for x in c[2:])], names=["part", "block", "numbers", "sizes", "words"])

    return df.select("doc_id", "text").mapInArrow(run, "part int, block long, numbers binary, sizes binary, words binary")


def _encode_words(rows: DataFrame, path: str) -> DataFrame:
    """The rows of the word table with ids in place of words, and the distinct ids among them; each distinct word of a part is encoded once.

    Rows of a part come together; only one part's words are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for b in batches:
            counts, ids, own = [], [], []
            for part, sizes, words in zip(*(b.column(c).to_pylist() for c in ("part", "sizes", "words")), strict=True):
                if part != now:
                    now, known = part, {}
                ends = np.cumsum(common.unplaned(sizes)).tolist()
                raw, at, found = zlib.decompress(words), 0, []
                for end in ends:
                    word = raw[at:end]
                    at = end
                    if (got := known.get(word)) is None:
                        got = known[word] = tokens.encode(path, word.decode()).astype("<u4").tobytes()
                    found.append(got)
                counts.append(common.planes(np.array([len(x) // 4 for x in found], np.uint32)))
                flat = np.frombuffer(b"".join(found), "<u4")
                ids.append(common.planes(flat))
                own.append(np.unique(flat).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("numbers"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["block", "numbers", "sizes", "ids", "own"])

    return rows.mapInArrow(run, "block long, numbers binary, sizes binary, ids binary, own array<long>")


def _document_rows(df: DataFrame, path: str) -> DataFrame:
    """(block, docs, doc_sizes, codes): documents as word numbers."""
    id_type = df.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(id_type)), T.StructField("doc_sizes", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = [t.decode() for t in tokens.load(path)[1].values()]
        for block in _blocks(batches, special, False):
            _, _, ranks, name = block.ranked()
            codes = np.concatenate([r[c] for r, c in zip(ranks, block.codes, strict=True)])
            sizes, ids = np.concatenate(block.docs), pa.concat_arrays(block.ids)
            ends = np.r_[0, np.cumsum(sizes)]
            for a in range(0, len(sizes), _DOCS_A_ROW):
                z = min(a + _DOCS_A_ROW, len(sizes))
                one = pa.array([0, z - a], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.ListArray.from_arrays(one, ids.slice(a, z - a)), pa.ListArray.from_arrays(one, pa.array(sizes[a:z], pa.int64())), pa.array([common.planes(codes[ends[a] : ends[z]])], pa.binary())], names=schema.names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


class _Pieces:
    """The pieces of a block's ids, looked up by position."""

    def __init__(self, ids: np.ndarray, pieces: list[bytes]) -> None:
        order = np.argsort(ids)
        self.ids = ids[order]
        self.size = np.array([len(p) for p in pieces], np.int64)[order]
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces[i] for i in order.tolist()), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (not len(self.ids) or (self.ids[np.minimum(at, len(self.ids) - 1)] != ids).any()):
            raise ValueError("an id is not in the vocabulary")
        return self.flat[common.ragged(self.first[at], self.size[at])].tobytes().decode("utf-8", "replace")


def piece_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary."""
    table = tokens.piece_table(path)
    return spark.createDataFrame(pa.table({"id": pa.array(list(table), pa.int64()), "piece": pa.array(list(table.values()), pa.binary())}))


def _pieces_of(own: DataFrame, pieces: DataFrame) -> DataFrame:
    """(block, used, pieces): the ids that a block uses and their pieces, from rows (block, own); at most as many as the vocabulary has."""
    ids = own.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")).select("block", F.explode("own").alias("id"))
    found = ids.join(F.broadcast(pieces), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("p"))
    return found.select("block", F.col("p.id").alias("used"), F.col("p.piece").alias("pieces"))


def _meet(rows: DataFrame, id_type: T.DataType, decode: bool) -> DataFrame:
    """(doc_id, ids[, decoded]): word numbers become ids, by position in the block's list of words."""
    fields = [T.StructField("doc_id", id_type), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields if decode else fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, table, pieces = None, [], None, None
        for b in batches:
            for r in range(b.num_rows):
                block, kind = b.column("block")[r].as_py(), b.column("kind")[r].as_py()
                if block != now:
                    now, lists, table, pieces = block, [], None, _Pieces(np.zeros(0, np.int64), [])
                if kind == 0:
                    number = np.cumsum(common.unplaned(b.column("numbers")[r].as_py()).astype(np.int64))
                    lists.append((number, common.unplaned(b.column("sizes")[r].as_py()).astype(np.int64), common.unplaned(b.column("ids")[r].as_py())))
                    continue
                if kind == 1:
                    pieces = _Pieces(b.column("used")[r].values.to_numpy(), b.column("pieces")[r].as_py())
                    continue
                if table is None:
                    if not lists:
                        raise ValueError("a block was cut differently in the two passes")
                    number, size, ids = (np.concatenate([x[i] for x in lists]) for i in range(3))
                    order = np.unique(number, return_index=True)[1]  # blocks of the same words have the same list
                    table, lists = ((np.cumsum(size) - size)[order], size[order], ids), []
                first, size, ids = table
                word = common.unplaned(b.column("codes")[r].as_py())
                out = ids[common.ragged(first[word], size[word])]
                words = np.array(b.column("doc_sizes")[r].as_py(), np.int64)
                ends = np.r_[0, np.cumsum(size[word])][np.r_[0, np.cumsum(words)]]
                each = [out[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
                made = [b.column("docs")[r].values, pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())]
                if decode:
                    made.append(pa.array([pieces.text(x) for x in each], pa.string()))
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return rows.mapInArrow(run, schema)


def encode_documents(df: DataFrame, path: str | None = None, decode: bool = False, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(doc_id, ids): ids of each text as little-endian 32-bit numbers in one binary value; with `decode` also decoded, the text of these ids.

    With `decode` the result is written before the word table is deleted; `finish` says what of it is needed.
    """
    path = path or tokens.default_path()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = _word_rows(df, path, partitions * PARTS_A_TASK).repartition(partitions, "part").sortWithinPartitions("part")
    docs = _document_rows(df, path)
    empty = {"numbers": "binary", "sizes": "binary", "ids": "binary", "used": "array<long>", "pieces": "array<binary>", "docs": docs.schema["docs"].dataType, "doc_sizes": "array<long>", "codes": "binary"}
    shaped = lambda rows, kind: rows.select("block", F.lit(kind).alias("kind"), *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    with common.scratch() as keep:
        words = _encode_words(sent, path)
        if decode:
            words = keep(words, "encoded-words")
        both = shaped(words, 0).unionByName(shaped(docs, 2))
        if decode:
            both = both.unionByName(shaped(_pieces_of(words, piece_rows(df.sparkSession, path)), 1))
        met = _meet(both.repartition(partitions, "block").sortWithinPartitions("block", "kind"), df.schema["doc_id"].dataType, decode)
        return common.materialize(finish(met), "encoded") if decode else finish(met)


def decode_ids(df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """df with decoded: the text of the ids, by a join of the ids that a block of rows uses with the table of pieces."""
    path = path or tokens.default_path()
    kept = [f for f in df.schema.fields if f.name != "decoded"]
    row = T.StructType(kept)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("own", T.ArrayType(T.LongType())), T.StructField("row", row)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_row = to_arrow_type(row)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = common.block_numbers()
        for whole in batches:
            for b in common.slices(whole, ids_col, 4 * _SLICE_BYTES):
                number = next(numbers)
                raw = b"".join(x or b"" for x in b.column(ids_col).to_pylist())
                own = np.unique(np.frombuffer(raw, "<u4")).astype(np.int64)
                head = [pa.array([number]), pa.array([1], pa.int32()), pa.array([own], pa.list_(pa.int64())), pa.nulls(1, arrow_row)]
                yield pa.RecordBatch.from_arrays(head, schema=None, names=schema.names)
                rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow_row, strict=True)], fields=list(arrow_row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number)), pa.array(np.full(b.num_rows, 2), pa.int32()), pa.nulls(b.num_rows, pa.list_(pa.int64())), rows], names=schema.names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, None
        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if block[lo] != now:
                    now, pieces = block[lo], _Pieces(np.zeros(0, np.int64), [])
                if kind[lo] == 1:
                    pieces = _Pieces(b.column("used")[lo].values.to_numpy(), b.column("pieces")[lo].as_py())
                    continue
                rows = b.column("row").slice(lo, hi - lo).flatten()
                ids = rows[[f.name for f in kept].index(ids_col)].to_pylist()
                told = [None if x is None else pieces.text(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(told, pa.string())], names=[*(f.name for f in kept), "decoded"])

    with common.scratch() as keep:
        blocks = keep(df.select(*(f"`{f.name}`" for f in kept)).mapInArrow(cut, schema), "ids-in-blocks")
        pieces = _pieces_of(blocks.filter("kind = 1").select("block", "own"), piece_rows(df.sparkSession, path)).withColumn("kind", F.lit(1))
        rows = blocks.filter("kind = 2").select("block", "kind", "row").unionByName(pieces, allowMissingColumns=True)
        met = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(meet, T.StructType([*kept, T.StructField("decoded", T.StringType())]))
        return common.materialize(met, "decoded")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    digests = lambda both: both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return encode_documents(common.read_table(spark, sf_dir, "documents"), decode=True, finish=digests)
