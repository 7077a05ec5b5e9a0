"""Operators 5 and 10: greedy word-piece counts, and byte-level BPE in overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise, takewhile

import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._spark import batches_of, durable

#: Bytes of a piece up to which all its neighbours are looked through for each merge.
LOOKED_THROUGH = 64
#: Words remembered by a worker; beyond that the memory is emptied.
REMEMBERED = 200_000


def vocabulary(path: str) -> bytes:
    """The bytes of a rank file (under a few MB, fixed by the tokenizer, not by the data)."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}


# ---- greedy longest match -------------------------------------------------------------------------------------------


class LongestMatch:
    """Counts greedy longest-match pieces of a byte string in linear time.

    A trie over the vocabulary; each node's failure link leads to the node where matching goes on after the
    pieces that its string certainly yields have been popped, and their number is kept with the link. Every single byte
    must be a piece.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: dict[int, int] = {}
        ends = bytearray(1)
        size = 1
        for piece in pieces:
            at = 0
            for b in piece:
                to = self.next.get(at << 8 | b)
                if to is None:
                    to = self.next[at << 8 | b] = size
                    size += 1
                    ends.append(0)
                at = to
            ends[at] = 1
        if not all(ends[self.next[b]] if b in self.next else 0 for b in range(256)):
            raise ValueError("every single byte must be in the vocabulary")
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.next.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        self.fail, self.popped = [-1] * size, [0] * size
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for b, to in below.get(at, ()):
                if ends[to]:
                    self.fail[to], self.popped[to] = 0, 1
                else:
                    link, count = self.fail[at], self.popped[at]
                    while link >= 0 and (link << 8 | b) not in self.next:
                        count += self.popped[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[to], self.popped[to] = self.next[link << 8 | b], count
                queue.append(to)

    def count(self, data: bytes) -> int:
        step, fail, popped, at, n = self.next, self.fail, self.popped, 0, 0
        for b in data:
            to = step.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = fail[at]
                to = step.get(at << 8 | b)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


def piece_counts(df: DataFrame, vocabulary_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The id, n_words and n_tokens of each whole text.

    Words are runs of characters other than ASCII white space; each, with a leading space, is cut into the longest
    pieces of the vocabulary from the left. The automaton counts them without building them. A null or empty text has 0;
    repeated rows give repeated rows; a table without rows gives none; other columns are left out.
    """
    spark = df.sparkSession
    file = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    batches_of(2_000, spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = _machine(file.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column(1):
                total, found = 0, (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                for w in found:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = machine.count(b" " + w)
                        if len(w) <= 64:
                            known[w] = n
                    total += n
                n_words.append(len(found))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    kind = df.schema[doc_id].dataType.simpleString()
    out = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", doc_id)


@lru_cache(2)
def _machine(file: bytes) -> tuple[LongestMatch, dict[bytes, int]]:
    return LongestMatch(ranks_of(file)), {}


# ---- byte-level BPE -------------------------------------------------------------------------------------------------


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a byte string: of all neighbours, those whose union has the least rank are merged, the leftmost of equal ones first, until none has a rank."""
    if len(piece) > LOOKED_THROUGH:
        return _merged_by_heap(piece, ranks)
    n, get, none = len(piece), ranks.get, 1 << 62
    at, rank = list(range(n + 1)), [get(piece[k : k + 2], none) for k in range(n - 1)]  # where parts begin, and the rank of each with its next
    while rank:
        least = min(rank)
        if least == none:
            break
        k = rank.index(least)
        del at[k + 1], rank[k]
        if k < len(rank):
            rank[k] = get(piece[at[k] : at[k + 2]], none)
        if k:
            rank[k - 1] = get(piece[at[k - 1] : at[k + 1]], none)
    return [ranks[piece[a:b]] for a, b in pairwise(at)]


def _merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in the time of a sort: the parts are a linked list by their ends; a heap holds the unions, of which those out of date are passed over."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place; end is 0 where none does
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapify(heap)
    while heap:
        _, k, stop = heappop(heap)
        middle = end[k]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[k], end[middle] = stop, 0
        if stop < n:
            before[stop] = k
            if (r := ranks.get(piece[k : end[stop]])) is not None:
                heappush(heap, (r, k, end[stop]))
        if (left := before[k]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k : end[k]]])
        k = end[k]
    return ids


class Known(dict[str, tuple[int, ...]]):
    """The ids of pre-tokens by the ranks: those met before are remembered, up to a number."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        ids = (self.ranks[data],) if data in self.ranks else tuple(merged(data, self.ranks))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """Encodes pre-tokens by the ranks, and remembers their ids."""

    def __init__(self, file: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.known = Known(ranks_of(file))

    def encode(self, pieces: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))


@lru_cache(2)
def _pieces(file: bytes) -> list[bytes]:
    ranks = ranks_of(file)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


@lru_cache(2)
def _coder(file: bytes, pattern: str) -> Coder:
    return Coder(file, pattern)


def chunks_of(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk): chunks of ``size`` and ``overlap`` more characters; the last is not shorter than the overlap, if there are others."""
    return [(at, text[at : at + size + overlap]) for at in range(0, max(len(text) - overlap, 1), size)]


def spans(pattern: regex.Pattern, text: str, start: int, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Where the pre-tokens from ``start`` on begin and end, up to those that begin at ``end``."""
    return takewhile(lambda x: end is None or x[0] < end, (m.span() for m in pattern.finditer(text, start)))


def scanned(pattern: regex.Pattern, at: int, chunk: str, size: int, overlap: int) -> tuple[list[str], list[int], list[int], list[int]]:
    """The pre-tokens of a chunk as if it began a text, where they end, and which of these boundaries may be stitched to the chunk before and to the next.

    The last two boundaries may be there only because the chunk ends.
    """
    found = pattern.findall(chunk)
    ends = list(accumulate(map(len, found), initial=at))[1:]
    if chunk and ends[-1:] != [at + len(chunk)]:
        raise ValueError("the pattern must match every character")
    return found, ends, ends[: bisect_left(ends, at + overlap)], ends[bisect_left(ends, at + size) : -2]


def pre_tokens(pattern: regex.Pattern, text: str, size: int, overlap: int) -> list[str]:
    """The pre-tokens of a text, from overlapping chunks that are scanned each by itself and stitched where two scans first agree on a boundary.

    Where two don't agree within the overlap, the scan before goes on, over the text itself, until it meets a boundary of the next one.
    """
    chunks = chunks_of(text, size, overlap)
    found, ends, _, tails = scanned(pattern, *chunks[0], size, overlap)
    out, upto = [], 0  # what is certain, and the boundary where it ends
    for k in range(1, len(chunks)):
        at, chunk = chunks[k]
        next_found, next_ends, heads, next_tails = scanned(pattern, at, chunk, size, overlap)
        met = min(set(tails) & set(heads), default=None)
        if met is not None:
            out += found[bisect_right(ends, upto) : bisect_right(ends, met)]
        else:
            mine, on = set(next_ends if k + 1 == len(chunks) else next_ends[:-2]), []
            for a, b in spans(pattern, text, upto):
                on.append(text[a:b])
                if b in mine or b >= at + len(chunk):
                    met = b if b in mine else None
                    break
            if met is None:  # past that chunk; the one after it comes next
                tails = []
                continue
            out += on
        found, ends, tails, upto = next_found, next_ends, next_tails, met
    return out + found[bisect_right(ends, upto) :]


def encode_documents(
    df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", chunk: int = 4_096, overlap: int = 256, together: int = 64, decoded: bool = False
) -> DataFrame:
    """The id and the ids (array<int>) of each whole text, as encoding it at once without special tokens gives them.

    Texts are cut into overlapping chunks, which are pre-tokenised each by itself; where two scans first
    agree on a boundary within the overlap they are stitched, and the pre-tokens between stitches are encoded. The chunks of a text
    of ``together`` chunks or less are scanned in one task; longer texts are dealt in parts of so many chunks to many tasks, and those parts stitched in the same way.
    With ``decoded`` the ids are decoded again in the same task, to a column ``data`` as decode_documents() gives it: one Python worker for both.
    The pattern must match every character, look back at nothing and ahead at no more than two characters. A null text is taken as
    empty: no ids; repeated rows stay apart; a table without rows gives none; other columns are left out.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be from 1 to the size of a chunk")
    spark = df.sparkSession
    file = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    batches_of(2_000, spark)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = chunk * together

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(file.value, pattern)
        for batch in batches:
            for few in _few(batch):
                ids = [coder.encode(pre_tokens(coder.pattern, t.as_py(), chunk, overlap)) for t in few.column(1)]
                more = {"data": pa.array([_decoded(x, file.value) for x in ids], pa.binary())} if decoded else {}
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(ids, pa.list_(pa.int32())), *more.values()], ["id", "ids", *more])

    done = rows.where(F.length("text") <= part + overlap).mapInArrow(here, f"id {kind}, ids array<int>" + ", data binary" * decoded)
    parts = _long_parts(rows.where(F.length("text") > part + overlap), file, pattern, part, overlap)
    whole_ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]))
    joined = parts.groupBy("id", "row").agg(whole_ids.alias("ids")).select("id", "ids")  # a text at a time
    joined = decode_documents(joined, vocabulary_path) if decoded else joined
    return done.unionByName(joined).withColumnRenamed("id", doc_id)


def _few(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with not much over ``most_bytes`` of text each, so that results leave a worker soon."""
    at, held = 0, 0
    sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
    for k, n in enumerate(sizes):
        held += n or 0
        if held >= most_bytes:
            yield batch.slice(at, k + 1 - at)
            at, held = k + 1, 0
    if at < len(sizes):
        yield batch.slice(at)


def _long_parts(rows: DataFrame, file: Broadcast, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for n, (at, piece) in enumerate(chunks_of(batch.column(2)[k].as_py(), chunk, overlap)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([n], pa.int32()), pa.array([at], pa.int64()), pa.array([piece])], ["id", "row", "part", "at", "chunk"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for at, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                *_, head, tail = scanned(found, at, t, chunk, overlap)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["row", "part", "heads", "tails"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(file.value, pattern)
        for batch in batches:
            ids = []
            for chunks, start, end in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                t, first = "".join(c["chunk"][: chunk if k + 1 < len(chunks) else None] for k, c in enumerate(chunks)), chunks[0]["at"]
                # What follows the end stays in sight of the pattern.
                ids.append(coder.encode(t[a:b] for a, b in spans(coder.pattern, t, start - first, None if end is None else end - first)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], ["id", "row", "part", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    numbered = rows.select("id", F.monotonically_increasing_id().alias("row"), "text")
    pieces = durable(numbered.mapInArrow(cut, f"id {kind}, row long, part int, at long, chunk string").repartition(F.col("row"), F.col("part")))
    scans = pieces.select("row", "part", "at", "chunk").mapInArrow(scan, "row long, part int, heads array<long>, tails array<long>")
    nexts = scans.select("row", (F.col("part") - 1).alias("part"), "heads")
    meet = F.array_min(F.array_intersect("tails", "heads"))
    stitched = scans.drop("heads").join(nexts, ["row", "part"], "left").select("row", "part", meet.alias("to"), F.col("heads").isNotNull().alias("more"))
    upto = Window.partitionBy("row").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    stitched = stitched.withColumn("to", F.when(~F.max(F.col("more") & F.col("to").isNull()).over(upto), F.col("to")))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    runs = stitched.select("row", "part", "to", F.coalesce(F.count("to").over(before), F.lit(0)).cast("int").alias("run"), F.coalesce(F.max("to").over(before), F.lit(0)).alias("from"))
    groups = pieces.join(runs, ["row", "part"]).groupBy("id", "row", "run").agg(F.sort_array(F.collect_list(F.struct("part", "at", "chunk"))).alias("chunks"), F.min("from").alias("from"), F.max("to").alias("to"))
    return groups.mapInArrow(code, f"id {kind}, row long, part int, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` with ``data``, the concatenated bytes of its column ``ids``."""
    spark = encoded.sparkSession
    file = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    batches_of(2_000, spark)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: _decoded(x.tolist(), file.value))

    return encoded.withColumn("data", decode("ids"))


def _decoded(ids: list[int], file: bytes) -> bytes:
    return b"".join(map(_pieces(file).__getitem__, ids))


def coded_digests(df: DataFrame, vocabulary_path: str, pattern: str, **options: int) -> DataFrame:
    """The id, n_tokens, ids_sha256 and decoded_sha256 of each row of encode_documents()."""
    out = encode_documents(df, vocabulary_path, pattern, decoded=True, **options)
    return out.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), "decoded_sha256": F.sha2(F.col("data"), 256)}
    ).drop("ids", "data")
