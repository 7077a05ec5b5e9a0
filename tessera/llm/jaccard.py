"""Operator 9: size-aware heavy-light Jaccard join on word shingles, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._spark import batches_of, discard, durable
from tessera.llm._words import U, mix, shingles

#: Largest sets whose fixed-size subsets may be enumerated (a few hundred subsets each at most).
LARGEST_SMALL = 16
#: CPU time of one posting in an inverted list against that of one subset's row, both from the first pass to the links.
LIST_COST = 6.0
#: Sets up to this size list all their elements; larger ones a hashed part of them.
LISTED_WHOLE = 128
#: An element that so many sets of one Arrow batch list is known to be shared, and isn't dealt out to be counted.
OFTEN = 8
#: Ids up to this number (under 100 bytes each) are sent to the tasks that read the texts; more are joined by a shuffle.
FEW_IDS = 300_000
#: Cells in which a set's elements are counted, by their hash.
CELLS = 128
#: Rows of an Arrow batch that a task sends back: a few MB, however many elements the texts of a batch have.
SENT = 1 << 16
#: A list longer than this is paired in blocks of about this size.
BLOCK = 256

# Kinds of the first pass's rows: a text; a subset of a set as the smaller or the larger one; a posting, plus bits.
TEXT, SMALLER, LARGER, POSTING = 0, 1, 2, 8
LATE, SHARED, WHOLE = 1, 2, 4  # beyond the hashed part; shared within a batch; of a set that lists all
_WHOLE_SALT = U(0x5851F42D4C957F2D)
_ROWS = "kind byte, n long, node long, low long, token long"


def least_overlap(a: int, b: int, percent: int) -> int:
    """The overlap that sets of a and b elements need for a Jaccard similarity of ``percent`` %."""
    return -(-percent * (a + b) // (100 + percent))


@lru_cache(None)
def _partners(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(smaller size, larger size, overlap) for all sizes that a set of n can be linked with."""
    sizes = (b for b in range(-(-percent * n // 100), 100 * n // percent + 1) if b)
    return tuple((min(n, b), max(n, b), least_overlap(n, b, percent)) for b in sizes if least_overlap(n, b, percent) <= min(n, b))


def subset_signatures(tokens: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Hashes of all subsets that have just the overlap which a partner size asks for.

    The first list is for pairs in which the set is the smaller one (or of equal size), the second for those in which it is
    the larger one. Sets of sizes a <= b share a hash of (a, b) exactly if they are linked.
    """
    small, large = [], []
    total = int(tokens.sum(dtype=np.uint64))
    values = [int(x) for x in tokens]
    for a, b, c in _partners(len(values), percent):
        salt = a << 8 | b
        rest = [total - sum(out) for out in combinations(values, len(values) - c)]
        keys = mix(np.array([x & 0xFFFFFFFFFFFFFFFF for x in rest], dtype=np.uint64) ^ mix(np.array([salt], dtype=np.uint64)))
        (small if len(values) == a else large).extend(keys.view(np.int64).tolist())
    return small, large


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for *_, c in _partners(n, percent))


def prefix_length(n: int, percent: int) -> int:
    """So many first elements, in any order common to all, hold one of a linked set."""
    return n - -(-percent * n // 100) + 1


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of element hashes; 0 for the empty set."""
    return int(mix((mix(s) ^ (s >> U(7))).sum(dtype=np.uint64, keepdims=True) + U(len(s)))[0].view(np.int64)) if len(s) else 0


def _first_pass(df: DataFrame, words: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """Rows of the kinds above: id, n, node (hash of the set) and low of each text; and, once a task for each set, its subsets and postings.

    ``low`` is the number of elements in the hashed part, which is a little larger than a prefix; where it is not, the rest of the
    prefix comes as LATE postings, in the order of the hashes.
    """
    part = np.uint64(min(int(1.25 * (100 - percent) / 100 * 2**64), 2**64 - 1))
    whole_to = 100 * LISTED_WHOLE // percent  # what a set that lists all may be linked with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["id", "kind", "n", "node", "low", "token"]
        for batch in batches:
            heads, kinds, tokens = [], [], []  # of a posting or subset: its kind, and its set's place in heads
            for k, value in enumerate(batch.column(1)):
                s = shingles(value.as_py(), words)
                n, node = len(s), set_hash(s)
                low = int(np.searchsorted(s, part, side="right")) if n else 0
                heads.append((n, node, low))
                if not n or node in seen:
                    continue
                if len(seen) < 500_000:  # of memory; a set that is listed twice comes once into the lists all the same
                    seen.add(node)
                if n <= LARGEST_SMALL:
                    for kind, found in zip((SMALLER, LARGER), subset_signatures(s, percent), strict=True):
                        kinds.append((kind, k, len(found)))
                        tokens.append(np.array(found, dtype=np.int64).view(np.uint64))
                if n <= whole_to:
                    kinds.append((POSTING | WHOLE, k, n))
                    tokens.append(s ^ _WHOLE_SALT)
                if n > LISTED_WHOLE:
                    kinds += [(POSTING, k, low), (POSTING | LATE, k, max(prefix_length(n, percent) - low, 0))]
                    tokens.append(s[: max(low, prefix_length(n, percent))])
            sizes = np.array([c for *_, c in kinds], dtype=np.int64)
            token = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
            kind = np.repeat(np.array([x for x, *_ in kinds], dtype=np.int8), sizes)
            at = np.repeat(np.array([k for _, k, _ in kinds], dtype=np.int64), sizes)
            if len(token):
                _, place, count = np.unique(token, return_inverse=True, return_counts=True)
                kind |= np.where((kind >= POSTING) & (count[place] >= OFTEN), np.int8(SHARED), np.int8(0))
            n, node, low = (np.array(x, dtype=np.int64) for x in zip(*heads, strict=True)) if heads else (np.zeros(0, dtype=np.int64),) * 3
            texts = [np.full(len(n), TEXT, dtype=np.int8), n, node, low, np.zeros(len(n), dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, texts)], names)
            for k in range(0, len(token), SENT):
                few, of = slice(k, k + SENT), at[k : k + SENT]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(of), batch.column(0).type), *map(pa.array, (kind[few], n[of], node[of], low[of], token[few].view(np.int64)))], names)

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {_ROWS}")


def prefix_lists(postings: DataFrame, nodes: DataFrame, percent: int, owner: Sequence[str] = ("node", "n")) -> DataFrame:
    """token, key, n, rank, alone: for each set, the elements of its prefix that a set of another ``owner`` lists too; rarest first.

    ``postings`` are the first pass's; ``nodes`` has node, n, low and key, one row a set, and so have the lists for each element. The elements of the hashed part are ordered
    by how many sets list them, those that are shared within a batch last, and precede the others, which stand in the order of their hashes.
    ``alone`` is the share of a set's elements that no other owner lists. Every posting that isn't known to be shared is shuffled once, by its element; those that
    are known to be shared (all those of frequent elements, but for a few a batch) are not.
    """
    has = lambda bit: F.col("kind").bitwiseAND(F.lit(bit)) > 0
    known = postings.where(has(SHARED)).select("token", "node", "n", "kind")
    every = Window.partitionBy("token")
    differ = reduce(lambda a, b: a | b, (F.min(c).over(every) != F.max(c).over(every) for c in owner))
    counted = postings.where(~has(SHARED)).select("token", "kind", *dict.fromkeys(("node", "n", *owner))).repartition("token").select("*", F.count("*").over(every).alias("df"), differ.alias("_shared"))
    counted = counted.join(known.select("token", F.lit(True).alias("_known")).distinct(), "token", "left").where("_shared or _known")
    rows = counted.select("token", "node", "n", "kind", F.when(F.col("_known"), F.lit(2**62)).otherwise(F.col("df")).alias("df")).unionByName(known.withColumn("df", F.lit(2**62)))
    rows = rows.repartition("node", "n").withColumn("_whole", has(WHOLE)).join(nodes, ["node", "n"])
    late = has(LATE)
    unsigned = F.col("token").bitwiseXOR(F.lit(-(2**63)))
    order = Window.partitionBy("node", "n", "_whole").orderBy(late, F.when(late, 0).otherwise(F.col("df")), unsigned)
    # A set that several tasks list has equal rows, which share a place.
    rows = rows.withColumn("_place", F.dense_rank().over(order))
    shared_low = F.coalesce(F.max(F.when(~late, F.col("_place"))).over(Window.partitionBy("node", "n", "_whole")), F.lit(0))
    hashed = F.when(F.col("_whole"), F.col("n")).otherwise(F.col("low"))
    rows = rows.withColumn("rank", hashed - shared_low + F.col("_place") - 1).withColumn("alone", (hashed - shared_low) / F.col("n"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    return rows.where(F.col("rank") < prefix).dropDuplicates(["node", "n", "token"]).select("token", "key", "n", "rank", "alone")


def _may_link(a: str, b: str, percent: int):
    """Sizes and ranks of a common element still allow a link, if it is the first common one."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.rank"), F.col(f"{b}.rank")
    need = F.ceil((n + m) * percent / F.lit(100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (1 + F.least(n - i - 1, m - j - 1) >= need)


def _texts(df: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key, text and the other columns of ``wanted``, for its keys; the ids are sent to the tasks if they are few."""
    few = wanted.count() <= FEW_IDS
    return df.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "key")


def _whole_sets(df: DataFrame, wanted: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """key, tokens and cells (how many elements fall in each of CELLS ranges of the hash) of the ``wanted`` sets (key, node, n), made again from the texts with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found, cells = [], [], []
            for k, (value, node, n) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s = shingles(value.as_py(), words)
                if len(s) == n and set_hash(s) == node:  # an id may stand at other texts too
                    keep.append(k)
                    found.append(s.view(np.int64))
                    cells.append(np.bincount((s >> U(64 - CELLS.bit_length() + 1)).astype(np.int64), minlength=CELLS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(found, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32()))], ["key", "tokens", "cells"])

    kind = df.schema[doc_id].dataType.simpleString()
    return _texts(df, wanted, text, doc_id).select("key", "text", "node", "n").mapInArrow(run, f"key {kind}, tokens array<long>, cells array<int>")


def _whole_postings(df: DataFrame, wanted: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """Postings of all elements of the ``wanted`` sets (key, node, n, component): kind, n, node, component and token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at = [], []
            for k, (value, node, n) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                s = shingles(value.as_py(), words)
                if len(s) == n and set_hash(s) == node:
                    tokens.append(s.view(np.int64))
                    at.append(np.full(n, k))
            if not tokens:
                continue
            token, at = np.concatenate(tokens), np.concatenate(at)
            _, owner = np.unique(batch.column(3).to_numpy(zero_copy_only=False), return_inverse=True)
            _, place, count = np.unique(token, return_inverse=True, return_counts=True)
            low, high = np.full(len(count), len(owner)), np.full(len(count), -1)
            np.minimum.at(low, place, owner[at])
            np.maximum.at(high, place, owner[at])
            kind = np.where((count >= OFTEN) & (low < high), POSTING | WHOLE | SHARED, POSTING | WHOLE)[place].astype(np.int8)
            for k in range(0, len(token), SENT):
                few = slice(k, k + SENT)
                part = batch.select(["n", "node", "component"]).take(pa.array(at[few]))
                yield pa.RecordBatch.from_arrays([pa.array(kind[few]), *part.columns, pa.array(token[few])], ["kind", "n", "node", "component", "token"])

    kind = df.schema[doc_id].dataType.simpleString()
    return _texts(df, wanted, text, doc_id).select("text", "node", "n", "component").mapInArrow(run, f"kind byte, n long, node long, component {kind}, token long")


def _verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, words: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """Those of the pairs (lo, hi), written by durable(), that are linked, by their whole sets."""
    both_ends = lambda p: p.select(F.explode(F.array("lo", "hi")).alias("key")).distinct()
    wanted = durable(both_ends(pairs).join(nodes.select("key", "node", "n"), "key"))
    sets = durable(_whole_sets(df, wanted, words, text, doc_id))
    linked = lambda i, n: i * 100 >= (n - i) * percent

    def with_ends(p: DataFrame, of: DataFrame, column: str) -> DataFrame:
        for end in ("hi", "lo"):
            p = p.join(of.select(F.col("key").alias(end), F.col(column).alias(f"_{end}")), end)
        return p

    # No more elements can be common than the smaller counts of the cells add up to: most pairs end here, by a few bytes each.
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    near = with_ends(pairs, sets, "cells").where(linked(total(F.zip_with("_lo", "_hi", lambda x, y: F.least(x, y))), total(F.zip_with("_lo", "_hi", lambda x, y: x + y))))
    near = durable(near.select("lo", "hi"))
    both = with_ends(near, sets.join(both_ends(near), "key", "left_semi"), "tokens")
    out = durable(both.where(linked(F.size(F.array_intersect("_lo", "_hi")), F.size("_lo") + F.size("_hi"))).select("lo", "hi").distinct())
    discard(pairs, wanted, sets, near)
    return out


def components(links: DataFrame) -> DataFrame:
    """(key, component) for the ends of the links (lo, hi): component is the smallest key reachable.

    Rounds of large and small stars, each written to the shared folder, until nothing changes.
    """
    edges = durable(links.where("lo < hi").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.col("m").alias("lo"), F.col("hi")).unionByName(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo < hi").distinct()
        after = durable(small)
        discard(edges)
        edges = after
    named = durable(edges.select(F.col("hi").alias("key"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("key"), F.col("lo").alias("component"))).distinct())
    discard(edges)
    return named


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))


def _boundary(nodes: DataFrame, percent: int) -> int:
    """Sets up to this size are joined by subsets: the size with the least estimated work, from the numbers of sets of each size."""
    sizes = dict(nodes.where(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect())  # at most LARGEST_SMALL rows
    by_lists = lambda n: LIST_COST * n  # noqa: E731  small sets list all their elements

    def work(b: int) -> float:
        both = -(-percent * (b + 1) // 100)  # sets from this size on may be linked with larger ones
        return sum(k * (subset_count(n, percent) * (n <= b) + by_lists(n) * (n > b or n >= both)) for n, k in sizes.items())

    return min(range(LARGEST_SMALL + 1), key=work)


def _subset_links(rows: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Links of sets up to the limit: the members of a subset's group with its least smaller-side member."""
    small = rows.where(F.col("kind").isin(SMALLER, LARGER) & (F.col("n") <= limit)).select("node", "n", F.col("token").alias("x"), (F.col("kind") == SMALLER).alias("s"))
    small = small.join(nodes.select("node", "n", "key"), ["node", "n"]).select("key", "x", "s").distinct()
    heads = small.groupBy("x").agg(F.min(F.when(F.col("s"), F.col("key"))).alias("head"), F.count("*").alias("k")).where("head is not null and k > 1")
    return small.join(heads, "x").where("key != head").select(F.least("key", "head").alias("lo"), F.greatest("key", "head").alias("hi"))


def _may_yet_link(lists: DataFrame, percent: int) -> DataFrame:
    """key and component of the sets that stand in a list with one of another component and of a size that allows a link."""
    sized = lists.withColumn("_c", F.floor(F.log("n") / log(100 / percent + 1e-9)))  # sizes that allow a link lie in the same class or beside it
    per = sized.groupBy("token", "_c").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
    near = per.select("token", "_a", "_b", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_c")).groupBy("token", "_c").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).where("_a < _b")
    return sized.join(near, ["token", "_c"]).select("key", "component").distinct()


def _pairs_apart(lists: DataFrame, apart, percent: int) -> DataFrame:
    """Pairs of different components that stand in one list and may be linked; long lists are paired in blocks, each block with each in a group of its own."""
    sizes = lists.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_k")).where("_a < _b").select("token", F.ceil(F.col("_k") / BLOCK).cast("int").alias("_blocks"))
    mine = durable(lists.join(sizes, "token").withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")))
    left = mine.withColumn("_other", F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1))).withColumn("_first", F.col("_block"))
    right = mine.withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("_block")))).withColumn("_other", F.col("_block"))
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a._first") == F.col("b._first")) & (F.col("a._other") == F.col("b._other"))
    once = F.when(F.col("a._first") == F.col("a._other"), F.col("a.key") < F.col("b.key")).otherwise(F.col("a.key") != F.col("b.key"))
    found = left.alias("a").join(right.alias("b"), same & once & (F.col("a.component") != F.col("b.component")) & apart & _may_link("a", "b", percent))
    out = durable(found.select(F.least("a.key", "b.key").alias("lo"), F.greatest("a.key", "b.key").alias("hi")).distinct())
    discard(mine)
    return out


def similar_components(df: DataFrame, words: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id", boundary: int | None = None) -> DataFrame:
    """The id, n_shingles and component_id of each row: the connected components of all links between shingle sets.

    Two sets are linked at a Jaccard similarity of ``percent`` % or more (1 to 100). Sets up to the boundary (0 to LARGEST_SMALL) enumerate their subsets
    of just the size that a partner needs to share: a common one is a link. Larger sets meet in inverted lists of their
    prefixes, rarest elements first. The boundary is chosen by estimated work unless given. In each
    list one leader, the set with the fewest elements of its own, is compared with all; what it links becomes one
    component. Sets that share a list with another component after that are listed again, by all their elements, of which those
    that stand in one component only come first; and only pairs of different components are compared. Sets are told apart, and equal ones
    merged, by 64-bit hashes with their sizes.

    A text without words, or null, has no shingles and is its own component; so is a row without an id (component null).
    Rows with the same text are linked; of rows that share an id and not the text, each has the component of its text. A table without rows gives none; other columns are left out.
    """
    if not 1 <= percent <= 100 or boundary is not None and not 0 <= boundary <= LARGEST_SMALL:
        raise ValueError(f"percent must be 1 to 100, and boundary 0 to {LARGEST_SMALL}")
    batches_of(1_000, df.sparkSession)
    rows = durable(_first_pass(df.where(F.col(doc_id).isNotNull()), words, percent, text, doc_id))
    made = durable(rows.where(F.col("kind") == TEXT).select("id", "n", "node", "low"))
    nodes = durable(made.where("n > 0").groupBy("node", "n").agg(F.min("id").alias("key"), F.min("low").alias("low")))
    limit = _boundary(nodes, percent) if boundary is None else boundary
    links = durable(_subset_links(rows, nodes, limit))
    # Large sets, and those small ones that a large one may be linked with.
    least = -(-percent * (limit + 1) // 100)
    lists = durable(prefix_lists(rows.where((F.col("kind") >= POSTING) & (F.col("n") >= least)), nodes, percent))
    discard(rows)
    leaders = lists.groupBy("token").agg(F.min(F.struct("alone", "key", "n", "rank")).alias("h"), F.count("*").alias("k")).where("k > 1").select("token", "h.key", "h.n", "h.rank")
    apart = F.greatest(F.col("a.n"), F.col("b.n")) > limit
    led = leaders.alias("a").join(lists.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.key") != F.col("b.key")) & apart & _may_link("a", "b", percent))
    led = durable(led.select(F.least("a.key", "b.key").alias("lo"), F.greatest("a.key", "b.key").alias("hi")).distinct())
    led = _verified(led, df, nodes, words, percent, text, doc_id)
    both = led.unionByName(links)
    labels = components(both)
    # Of the sets that have not met all in their lists, all elements are listed, those of one component only as if they were of one set.
    rest = durable(_may_yet_link(_with_component(lists, labels), percent).join(nodes.select("key", "node", "n"), "key"))
    lists_2 = prefix_lists(_whole_postings(df, rest, words, text, doc_id), rest.select("key", "node", "n", F.col("n").alias("low")), percent, ("component",))
    lists_2 = durable(lists_2.join(rest.select("key", "component").distinct(), "key"))
    more = _verified(_pairs_apart(lists_2, apart, percent), df, nodes, words, percent, text, doc_id)
    if more.limit(1).count():
        discard(labels)
        labels = components(both.unionByName(more))
    named = durable(_with_component(nodes, labels).select("node", "n", "component"))
    whole = made.where("n > 0").select("id", "n", "node").join(named, ["node", "n"]).select("id", "n", "component")
    out = whole.unionByName(made.where("n = 0").select("id", "n", F.col("id").alias("component")))
    if df.where(F.col(doc_id).isNull()).limit(1).count():
        none = _first_pass(df.where(F.col(doc_id).isNull()), words, percent, text, doc_id).where(F.col("kind") == TEXT)
        out = out.unionByName(none.select("id", "n", F.col("id").alias("component")))
    out = durable(out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))
    discard(made, nodes, lists, led, links, rest, lists_2, more, labels, named)
    return out


def deduplicated(df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one document, that of the smallest id, of each component; rows that share an id stay or go together.

    The ids of what goes are sent to the tasks if they are few, so that texts aren't shuffled.
    """
    found = similar_components(df, words, percent, text, doc_id)
    gone = durable(found.where(F.col("component_id") != F.col(doc_id)).select(doc_id).distinct())
    discard(found)
    return df.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, doc_id, "left_anti").select(*df.columns)
