"""Best-fit packing of tokenised documents into sequences, by bin completion on the histogram of lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.llm.similarity import text_slices
from cellgrove.llm.text import whole
from cellgrove.scratch import materialize

CAPACITY, END_ID = 2_048, 0
#: Vocabulary of the tokenizer, and the same as ranks, among the public files.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces of one length are counted off in groups of some so many, so that no task orders all pieces of a length.
GROUP_ROWS = 2_000
#: Nodes that a search for fewer sequences opens, and completions that it tries at each.
NODES, TRIED = 2_000, 6
#: What a sequence holds, as (length, number) pairs.
Pattern = tuple[tuple[int, int], ...]


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _encoder(pattern: str, ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_pieces(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of each text and ``end_id``, cut to pieces of at most ``capacity``.

    Only longer documents are cut, and then the first piece is the one that may be shorter. ``ids`` holds little-endian unsigned 32-bit numbers. The
    vocabulary is a file of ranks that the driver reads and sends to the tasks (under 2 MB); strings of special tokens in a text are
    ordinary text. Null text is empty, a document of ``end_id`` alone. A very long text is encoded whole, its pieces are rows of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with open(ranks or vocabulary_file(RANKS), "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pattern, table.value)
        for b in text_slices(batches):
            of, piece, start, length, ids = [], [], [], [], []
            for row, t in enumerate(b.column("text")):
                found = np.r_[encoder.encode_to_numpy(t.as_buffer().to_pybytes().decode(), disallowed_special=()), np.uint32(end_id)].astype("<u4")
                first = len(found) % capacity or min(len(found), capacity)
                cuts = [0, *range(first, len(found), capacity), len(found)]
                for k, (at, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    of.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    ids.append(found[at:end].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", whole().cast("binary").alias("text")).mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids binary")


def lower_bound(counts: np.ndarray) -> int:
    """No packing of ``counts`` (by length, up to the capacity) needs fewer sequences.

    For every k, pieces longer than capacity - k meet none of k or more; those over half the capacity lie alone among themselves; what those
    of k up to half the capacity need beyond the room left beside the latter needs sequences of its own. k = 0 is the sum of lengths.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * sizes)]
    half = capacity // 2
    k = np.arange(half + 1)
    long_ = number[capacity - k + 1]
    alone, beside = number[-1] - long_, long_ - number[half + 1]
    room = beside * capacity - (total[capacity - k + 1] - total[half + 1])
    more = -(-(total[half + 1] - total[k] - room) // capacity)
    return int((alone + beside + np.maximum(0, more)).max())


def best_fit(counts: np.ndarray) -> list[tuple[int, Pattern]]:
    """(times, pattern) by best fit, longest pieces first; a pattern is (length, number) pairs.

    Sequences that hold the same are one entry, so the work depends on the lengths and not on the number of pieces: the next length goes to
    the sequences with the least room that it fits in, as often as it fits, which is where single pieces would go one by one.
    """
    capacity = len(counts) - 1
    rooms: dict[int, list[tuple[int, Pattern]]] = {}
    done: list[tuple[int, Pattern]] = []
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in rooms if r >= length):
            if not left:
                break
            fits, entries = room // length, rooms.pop(room)
            while entries and left:
                times, pattern = entries.pop()
                filled = min(times, left // fits)
                if filled < times:
                    some = left - filled * fits if filled * fits < left else 0
                    keep = times - filled - (1 if some else 0)
                    if keep:
                        entries.append((keep, pattern))
                    if some:
                        rooms.setdefault(room - some * length, []).append((1, (*pattern, (length, some))))
                    left -= some
                if filled:
                    rooms.setdefault(room - fits * length, []).append((filled, (*pattern, (length, fits))))
                    left -= filled * fits
            if entries:
                rooms.setdefault(room, []).extend(entries)
        fits = capacity // length
        if left // fits:
            rooms.setdefault(capacity - fits * length, []).append((left // fits, ((length, fits),)))
        if left % fits:
            rooms.setdefault(capacity - left % fits * length, []).append((1, ((length, left % fits),)))
    for entries in rooms.values():
        done += entries
    return done


def completions(counts: np.ndarray, room: int, waste: int, tried: int = TRIED) -> list[Pattern]:
    """Undominated ways to fill ``room`` from ``counts`` that leave at most ``waste`` of it, those that leave least first.

    A way is dominated if other pieces are as long as groups of its own: one piece that fills the room is better than any other way, so it is the only one; a
    pair is only worth trying if it fills more than the longest single piece; longer ways begin with a piece or pair and go on by best fit.
    """
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return [()] if room <= waste else []
    longest = int(sizes[-1])
    if longest == room:
        return [((room, 1),)]

    def rest(chosen: dict[int, int], left: int) -> Pattern:
        while True:
            can = sizes[(sizes <= left)]
            can = can[counts[can] > np.array([chosen.get(int(s), 0) for s in can])] if len(can) else can
            if not len(can):
                return tuple(sorted(chosen.items(), reverse=True))
            chosen[int(can[-1])] = chosen.get(int(can[-1]), 0) + 1
            left -= int(can[-1])

    found: dict[Pattern, int] = {}
    starts = [{longest: 1}]
    partner = np.searchsorted(sizes, room - sizes, "right") - 1  # the longest that fits beside each
    ok = partner >= 0
    ok[ok] &= (sizes[partner[ok]] <= sizes[ok]) & ((sizes[partner[ok]] != sizes[ok]) | (counts[sizes[ok]] > 1))
    pairs = np.flatnonzero(ok)
    fill = sizes[pairs] + sizes[partner[pairs]]
    for p in pairs[np.argsort(-fill, kind="stable")][: 4 * tried]:
        a, b = int(sizes[p]), int(sizes[partner[p]])
        if a + b > longest:
            starts.append({a: 2} if a == b else {a: 1, b: 1})
    starts += [{int(s): 1} for s in sizes[::-1][:tried]]
    for chosen in starts:
        pattern = rest(dict(chosen), room - sum(k * n for k, n in chosen.items()))
        found[pattern] = room - sum(k * n for k, n in pattern)
    ways = sorted((w, sum(n for _, n in p), p) for p, w in found.items() if w <= waste)
    return [p for _, _, p in ways[:tried]]


def pack(counts: np.ndarray, *, nodes: int = NODES, tried: int = TRIED) -> list[tuple[int, Pattern]]:
    """(times, pattern) that hold all pieces of ``counts`` (by length, up to the capacity) in as few sequences as are found.

    Best fit gives the first incumbent. Unless that meets the lower bound, a branch-and-bound search completes sequences about the longest piece that
    is left, as many at a time as the counts allow, with each undominated filling in turn. A branch ends where what it has wasted, or the bound of what
    is left, leaves no way to fewer sequences than the incumbent, and what best fit makes of its rest may be the next incumbent. The search ends at the bound, when no branch is
    left, or after ``nodes`` nodes.
    """
    counts = np.array(counts, dtype=np.int64)
    capacity, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    incumbent = best_fit(counts)
    fewest, bound = sum(t for t, _ in incumbent), lower_bound(counts)
    opened, stack = 0, [(counts, (), 0, 0)]
    while stack and fewest > bound and opened < nodes:
        left, made, used, wasted = stack.pop()
        opened += 1
        allowed = (fewest - 1) * capacity - total  # room that all sequences of a better packing waste
        if wasted > allowed or used + lower_bound(left) >= fewest:
            continue
        if opened > 1 and made:
            tail = best_fit(left)
            if used + sum(t for t, _ in tail) < fewest:
                chain, node = [], made
                while node:
                    chain.append(node[1])
                    node = node[0]
                fewest, incumbent = used + sum(t for t, _ in tail), chain[::-1] + tail
                allowed = (fewest - 1) * capacity - total
        if not left.any() or fewest <= bound:
            continue
        longest = int(np.flatnonzero(left)[-1])
        own = left.copy()
        own[longest] -= 1
        branches = []
        for filling in completions(own, capacity - longest, allowed - wasted, tried):
            pattern: dict[int, int] = {longest: 1}
            for k, n in filling:
                pattern[k] = pattern.get(k, 0) + n
            waste = capacity - sum(k * n for k, n in pattern.items())
            times = min(int(left[k]) // n for k, n in pattern.items())
            times = min(times, (allowed - wasted) // waste) if waste else times
            for some in {times, 1}:
                after = left.copy()
                for k, n in pattern.items():
                    after[k] -= some * n
                branches.append((waste, -some, (after, (made, (some, tuple(sorted(pattern.items(), reverse=True)))), used + some, wasted + some * waste)))
        stack += [b for *_, b in sorted(branches, key=lambda x: x[:2], reverse=True)]  # the best filling is opened first
    return incumbent


def _places(plan: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, number, sequence, offset) of a plan.

    Pieces of a length with ranks from ``from`` to before ``to`` lie ``number`` to a sequence, the first in ``sequence``, from ``offset`` on.
    """
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, pattern in plan:
        offset = 0
        for length, number in pattern:
            at = used.get(length, 0)
            out.append((length, at, at + times * number, number, sequence, offset))
            used[length] = at + times * number
            offset += length * number
        sequence += times
    return out


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None, pattern: str | None = None, nodes: int = NODES) -> DataFrame:
    """Put the pieces of all documents into as few sequences of at most ``capacity`` tokens as are found.

    Adds sequence_id and offset (places in a sequence have no gap) to the columns of `token_pieces`, and ids_crc32. Pieces of one
    length can stand for each other, so the packing is found for the counts of lengths, ``capacity`` numbers however many
    documents there are, and pieces take their places by their rank within their length. Ranks are counted off in groups by hash: those before a group
    are known from counts, and only a group is put in order.

    Null and empty texts are a document of one token. Rows that repeat take a place each. Ties in the order are rows that are equal, or ordered by
    their ids. Very long texts are many pieces. An empty table gives no rows; other columns aren't read.
    """
    pieces = token_pieces(docs, capacity=capacity, end_id=end_id, ranks=ranks, pattern=pattern).withColumn("ids_crc32", F.crc32("ids"))
    pieces = materialize(pieces, "token-pieces")
    spark = docs.sparkSession
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in found.items():
        counts[length] = n
    places = spark.createDataFrame(_places(pack(counts, nodes=nodes)), "length long, first long, last long, number long, sequence long, at long")
    groups = spark.createDataFrame([(k, -(-n // GROUP_ROWS)) for k, n in found.items()], "length long, _groups long")

    small = pieces.join(F.broadcast(groups), "length").withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_groups")))
    sizes = small.groupBy("length", "_group").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("length").orderBy("_group")) - F.col("_rows")
    starts = sizes.select("length", "_group", before.alias("_before"))
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = small.withColumn("_in", F.row_number().over(order) - 1).join(starts, ["length", "_group"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    placed = ranked.join(F.broadcast(places), "length").filter("_rank >= first AND _rank < last")  # a row for each length and pattern, bounded by the capacity
    step = F.col("_rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("number"))).alias("sequence_id"), (F.col("at") + F.pmod(step, F.col("number")) * F.col("length")).alias("offset"))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the sequences of `pack_documents`, with their ids in order and the document of each piece."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # no more pieces than a sequence has tokens
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return out.select("sequence_id", "length", joined.alias("ids"), F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
