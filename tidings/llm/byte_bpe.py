"""Operator 11: byte-level BPE encoding and decoding by a shuffle of distinct words.

Encoding takes three steps. Tasks split their texts into pre-tokens; each
block of texts numbers its distinct pre-tokens in order of
first appearance and keeps every text as the sequence of those numbers (the
positions). The (block, number, word) rows are shuffled by word and sorted, so
that equal words of the whole corpus meet in one place: each is merged by rank
once, and its ids go back to all blocks that asked. Last, blocks meet their
ids, and every text is reassembled by position. A word of every text travels
once per block, not once per occurrence, so frequent words make no large group.
The positions are staged as a table in buckets of the block (its name is in the
session's catalog until the session ends), so that they are never shuffled.

Decoding joins the token-byte table to the ids. The table is as long as the
vocabulary, however long the corpus is; it is sent to the tasks and an
id's bytes are taken from it a batch at a time, without a shuffle.

Special tokens are not known: their strings are ordinary text.

Edge cases: a null or empty text has no ids and decodes to no bytes; equal rows
are encoded alike and all kept; an empty table gives an empty one; a text of any
length is one row, and a pre-token of any length is merged through a heap (n log
n); columns beside the text are carried along whatever their names, only one
named ``ids`` (encoding) or like the output (decoding) is replaced; a null list of
ids decodes to null, an id outside the vocabulary is an error; a vocabulary
without some single byte is refused.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import table
from tidings.session import checkpoint_root

#: UTF-8 bytes of text after which a block ends.
BLOCK_BYTES = 32 << 20
#: Positions that are unpacked at a time.
PIECE = 1 << 19
#: Words that a task gathers before it sends their ids to the blocks.
CHUNK_WORDS = 1 << 18

_CODEC = "zstd"

# Letters and numbers of Unicode versions after the one that the public library
# knows; to it they are neither, and the splitting package must see them so.
NEWER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
_STAND_IN = "\ue000"  # neither letter, number nor blank


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary of lines "base64 rank"; a token's rank is its id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} has no token for some bytes")
    return ranks


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours of the lowest rank are merged, leftmost first."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # the part that starts at i ends at end[i]; 0: merged away
    before = list(range(-1, n))
    waiting: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            stop = end[end[i]]
            rank = ranks.get(word[i:stop])
            if rank is not None:
                heappush(waiting, (rank, i, stop))

    for i in range(n - 1):
        offer(i)
    while waiting:
        _, i, stop = heappop(waiting)
        middle = end[i]
        if not middle or middle == n or end[middle] != stop:
            continue  # one of its parts has changed since
        end[i], end[middle] = stop, 0
        before[stop] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """What splits a text into pre-tokens as the public library does."""
    split = regex.compile(pattern)
    ranges = [[int(x, 16) for x in r.split("-")] for r in NEWER.split()]
    newer = regex.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in ranges) + "]")

    def pieces(text: str) -> list[str]:
        if text.isascii() or not newer.search(text):
            return split.findall(text)
        return [text[m.start():m.end()] for m in split.finditer(newer.sub(_STAND_IN, text))]

    return pieces


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed bytes, the lowest byte of all first."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), _CODEC, asbytes=True)


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, _CODEC, asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def pack(numbers: np.ndarray, known: int = 0) -> bytes:
    """First-appearance numbers, of which those below ``known`` have appeared before,
    squeezed with 0 for a new number, else the number plus one."""
    latest = np.maximum.accumulate(np.r_[known - 1, numbers.astype(np.int64)])
    return squeeze(np.where(latest[1:] > latest[:-1], 0, numbers + 1))


def unpack(blob: bytes, n: int, known: int = 0) -> np.ndarray:
    codes = unsqueeze(blob, n)
    return np.where(codes == 0, np.cumsum(codes == 0, dtype=np.uint32) + np.uint32(known), codes) - np.uint32(1)


def _stage_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written below the shared folder as a table in buckets of ``key``, so that grouping by it needs no shuffle."""
    spark = df.sparkSession
    path = checkpoint_root(spark, name)
    known = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").option("path", path).option("compression", _CODEC).bucketBy(buckets, key).saveAsTable(known)
    return spark.table(known)


def _blocks(docs: DataFrame, text: str, pattern: str, block_bytes: int, piece: int) -> DataFrame:
    """Each text is a row (block, seq, row, n) of ``n`` pre-tokens. Their positions
    follow for several texts at a time as (block, seq of the first, n, blob); a
    block's distinct pre-tokens, in order of number, are a row (block, words)."""
    others = [c for c in docs.columns if c not in (text, "ids")]
    kept = docs.select(F.struct(*others, F.lit(0).alias("_none")).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("row", kept.schema["row"].dataType), T.StructField("n", T.LongType()),
        T.StructField("blob", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        block = TaskContext.get().partitionId() << 32
        number: dict[str, int] = defaultdict(count().__next__)
        flats: list[np.ndarray] = []
        seq = first = known = waiting = size = 0

        def row(n: int, at: list, rows: pa.Array, many: list, blob: bytes | None, words: list[str] | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block), pa.int64()), pa.array(at, pa.int32()), rows, pa.array(many, pa.int64()),
                pa.array([blob] * n, pa.binary()), pa.array([words] * n, pa.list_(pa.string()))], schema.names)

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = part.column(1).to_pylist()
                found = [np.fromiter(map(number.__getitem__, split(t)), np.uint32) for t in texts]
                flats += found
                n, none = len(texts), pa.nulls(1, part.column(0).type)
                many = list(map(len, found))
                yield row(n, list(range(seq, seq + n)), part.column(0), many, None, None)
                seq += n
                waiting += sum(many)
                size += sum(map(len, texts))
                if waiting >= piece or size >= block_bytes:
                    yield row(1, [first], none, [waiting], pack(np.concatenate(flats), known), None)
                    flats.clear()
                    first, known, waiting = seq, len(number), 0
                if size >= block_bytes:
                    yield row(1, [None], none, [None], None, list(number))
                    number = defaultdict(count().__next__)
                    block += 1
                    seq = first = known = size = 0
        if flats:
            yield row(1, [first], none, [waiting], pack(np.concatenate(flats), known), None)
        if seq:
            yield row(1, [None], none, [None], None, list(number))

    return _stage_bucketed(kept.mapInArrow(run, schema), "pre-tokens", "block")


def _word_ids(words: DataFrame, ranks) -> DataFrame:
    """(block, n, places, sizes, ids), squeezed, from rows (block, place, word) in which
    equal words follow each other: each distinct word is encoded once. Places
    ascend and are kept as steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, ids = ranks.value, None, []
        blocks: list[np.ndarray] = []
        places: list[np.ndarray] = []
        found: list[list[int]] = []

        def send() -> pa.RecordBatch:
            by, place = np.concatenate(blocks), np.concatenate(places)
            order = np.lexsort((place, by))
            by, place = by[order], place[order]
            lists = [found[k] for k in order]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
            at = np.flatnonzero(np.r_[True, by[1:] != by[:-1], True])
            ends = np.r_[0, np.cumsum(sizes)]
            blocks.clear(), places.clear(), found.clear()
            spans = list(zip(at[:-1], at[1:]))
            return pa.RecordBatch.from_arrays([
                pa.array(by[at[:-1]]), pa.array([b - a for a, b in spans], pa.int64()),
                pa.array([squeeze(np.diff(place[a:b], prepend=0)) for a, b in spans], pa.binary()),
                pa.array([squeeze(sizes[a:b]) for a, b in spans], pa.binary()),
                pa.array([squeeze(flat[ends[a]:ends[b]]) for a, b in spans], pa.binary())], ["block", "n", "places", "sizes", "ids"])

        for b in batches:
            blocks.append(b.column(0).to_numpy(zero_copy_only=False))
            places.append(b.column(1).to_numpy(zero_copy_only=False))
            for w in b.column(2).to_pylist():
                if w != last:
                    last, ids = w, encode_word(w.encode(), table)
                found.append(ids)
            if len(found) >= CHUNK_WORDS:
                yield send()
        if found:
            yield send()

    return words.mapInArrow(run, "block long, n long, places binary, sizes binary, ids binary")


def _answers(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block's words one after another, and by number of the word where they start and how many they are."""
    places, sizes, ids = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], [np.empty(0, np.int32)]
    for a in right.to_pylist():
        places.append(np.cumsum(unsqueeze(a["places"], a["n"])))
        sizes.append(unsqueeze(a["sizes"], a["n"]))
        ids.append(unsqueeze(a["ids"], int(sizes[-1].sum())).astype(np.int32))
    place, many = np.concatenate(places).astype(np.int64), np.concatenate(sizes).astype(np.int64)
    start, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    start[place], size[place] = np.cumsum(many) - many, many
    return np.concatenate(ids), start, size


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str, block_bytes: int, piece: int,
             then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, columns: str = "ids array<int>") -> DataFrame:
    """``row`` and ``columns`` of all texts: their ids, or what ``then`` makes of record batches (row, ids), where they are."""
    blocks = _blocks(docs, text, pattern, block_bytes, piece)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    words = blocks.where("words IS NOT NULL").select("block", F.posexplode("words").alias("place", "word"))
    answers = _word_ids(words.repartition("word").sortWithinPartitions("word"), ranks)
    texts = blocks.where("words IS NULL").select("block", "seq", "row", "n", "blob")
    schema = T.StructType([texts.schema["row"], *T.StructType.fromDDL(columns).fields])

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, start, size = _answers(right)
        is_text = pc.is_null(left.column("blob"))
        rows = left.filter(is_text).sort_by("seq").combine_chunks()
        pieces = left.filter(pc.invert(is_text)).sort_by("seq")
        firsts = pieces.column("seq").to_pylist()
        kept, many, known, out = rows.column("row").combine_chunks(), rows.column("n").to_numpy(), 0, []
        for a, b, n, blob in zip(firsts, [*firsts[1:], len(rows)], pieces.column("n").to_pylist(), pieces.column("blob"), strict=True):
            numbers = unpack(blob.as_py(), n, known)
            known = max(known, int(numbers.max()) + 1) if n else known
            tokens = size[numbers]
            ends = np.r_[0, np.cumsum(tokens)]
            ids = flat[np.repeat(start[numbers] - ends[:-1], tokens) + np.arange(ends[-1])]
            offsets = ends[np.r_[0, np.cumsum(many[a:b])]]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            batch = pa.RecordBatch.from_arrays([kept.slice(a, b - a), lists], ["row", "ids"])
            out += [then(batch.slice(k, 64)) for k in range(0, b - a, 64)] if then else [batch]
        return pa.Table.from_batches(out)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(reassemble, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text. ``vocabulary``: a
    file that :func:`read_ranks` reads; ``pattern``: what splits texts into pre-tokens."""
    return _encoded(docs, vocabulary, pattern, text, block_bytes, piece).select("row.*", "ids").drop("_none")


def token_bytes(vocabulary: str) -> pa.Array:
    """The token-byte table: the bytes of token ``i`` at place ``i``."""
    ranks = read_ranks(vocabulary)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def join_bytes(known: pa.Array, lists: pa.ListArray) -> list[bytes | None]:
    """The token-byte table joined to lists of ids: the bytes of each list."""
    tokens = known.take(lists.flatten())
    if tokens.null_count:
        raise ValueError("an id is not in the vocabulary")
    sizes = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)])
    at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:][sizes] if len(tokens) else sizes
    data = tokens.buffers()[2].to_pybytes() if len(tokens) else b""
    return [data[a:b] if ok else None for a, b, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with ``out`` (binary), the bytes that the ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))
    kept = [c for c in docs.columns if c != out]
    source = docs.select(F.struct(*kept).alias("row"), F.col(ids).alias("ids"))
    schema = T.StructType([source.schema["row"], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(join_bytes(shared.value, part.column(1)), pa.binary())], schema.names)

    return source.mapInArrow(run, schema).select("row.*", out)


def digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256): every text is encoded, its ids
    decoded, and both digested where they are, so that neither is sent on."""
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column(1)
        as_text = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), pc.cast(lists.flatten(), pa.string()))
        return pa.RecordBatch.from_arrays([
            part.column(0), pc.cast(pc.list_value_length(lists), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(as_text, ",").to_pylist()], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in join_bytes(shared.value, lists)], pa.string())], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, vocabulary, pattern, text, block_bytes, piece, digest, columns)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, vocabulary, public_tokenizers.PATTERN).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
