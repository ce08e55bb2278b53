"""What the similarity operators share: word-shingle sets as hashes, buckets of signatures, verified links and classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.components import connected_components
from cellgrove.scratch import at_most, materialize

SHINGLE_WORDS = 5
#: Texts, and bytes of texts unless one alone is longer, whose words a task holds at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2_000, 4_000_000
_COEFFICIENTS = np.random.default_rng(20240).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A random value for each byte: the same for A-Z and a-z, none for ASCII white space.
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
#: Weights of byte positions are powers of an odd number, so modulo 2^64 each has an inverse.
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)

#: Sets of a group, and hashes of all of them, that a task compares with each other; larger groups are dealt to blocks by hash.
BLOCK_SETS, BLOCK_HASHES = 2_000, 2_000_000
#: Cells of a matrix of sets by hashes that a task fills at once.
CELLS = 4_000_000
#: Groups of several blocks: a table of up to so many (under 10 MB) is broadcast, a longer one is joined by shuffle.
BROADCAST_GROUPS = 100_000

SIGNATURES = "p long, sig long, sk long, hub long"


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most ROWS_AT_ONCE texts (binary) and BYTES_AT_ONCE bytes, or one longer text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + ROWS_AT_ONCE, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right"))))
            yield b.slice(at, stop - at)
            at = stop


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 texts (binary, no nulls), A-Z lower-cased, and where each text's words begin and the last's end.

    A word's hash is the mixed sum of its bytes' values times weights by position. Weights are taken from the place in the
    whole array and divided by that of the word's first byte.
    """
    spans = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[spans[0] : spans[-1]]
    spans = spans - spans[0]
    values = _BYTES[data]
    begins = values != 0
    begins[1:] &= values[:-1] == 0
    first_bytes = spans[:-1][spans[:-1] < spans[1:]]
    begins[first_bytes] = values[first_bytes] != 0
    starts = np.flatnonzero(begins)
    ends = np.searchsorted(starts, spans)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), ends
    room = 1 << max(20, (len(data) - 1).bit_length())
    values *= _powers(_POWER, room)[: len(data)]
    return mix(np.add.reduceat(values, starts) * _powers(_INVERSE, room)[starts]), ends


def shingle_hashes(w: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Of each k-word shingle, in order; of the whole sequence if it is shorter; none without words."""
    k = min(k, len(w))
    if not k:
        return w
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h += w[i : i + n] * _COEFFICIENTS[i]
    return mix(h)


def signature_rows(sig: np.ndarray, sk: np.ndarray) -> dict[str, np.ndarray]:
    """Rows for `shared_stars` from the signatures of a batch of sets.

    Sets of the batch that share a signature send one row for it to the shuffle, that of the smallest set key (their
    hub); the others keep to themselves, with the hub beside them. So a signature that a third of all
    sets have meets in one task only once a batch. Rows come by set, so that their keys compress.
    """
    order = np.lexsort((sk, sig))
    sig, sk = sig[order], sk[order]
    new_sig = np.r_[True, sig[1:] != sig[:-1]]
    keep = new_sig | np.r_[True, sk[1:] != sk[:-1]]
    sig, sk, new_sig = sig[keep], sk[keep], new_sig[keep]
    hub = sk[np.maximum.accumulate(np.where(new_sig, np.arange(len(sig)), 0))]
    none = np.zeros(len(sig), dtype=np.uint64)
    rows = {"p": np.where(new_sig, sig, mix(sig ^ mix(sk))), "sig": np.where(new_sig, none, sig), "sk": sk, "hub": np.where(new_sig, none, hub)}
    by_set = np.argsort(sk, kind="stable")
    return {k: v[by_set].view(np.int64) for k, v in rows.items()}


def shared_stars(rows: DataFrame) -> DataFrame:
    """(hub, sk) for every signature that two or more sets have, from `signature_rows`: the smallest set key of the signature, and each other one.

    Any two sets that share a signature are then in one star: they have the same hub, or one of them is it.
    """
    local = F.col("sig") != 0
    bucket = Window.partitionBy("p").orderBy(local, "sk", "sig", "hub")
    # Batches that hold equal sets send equal rows: these lie side by side in a bucket, and one of them stays.
    row = F.struct("sig", "sk", "hub")
    met = rows.withColumns({"first": F.first("sk").over(bucket), "again": F.coalesce(F.lag(row).over(bucket) == row, F.lit(False))})
    met = materialize(met.filter(~F.col("again") & (local | (F.col("first") != F.col("sk")))).drop("again"), "shared-signatures")
    roots = met.filter(~local).select(F.col("p").alias("sig"), F.col("sk").alias("hub"), "first")
    # A set that kept to its batch follows the hub there to the hub of all batches.
    followers = met.filter(local).select("sig", "hub", "sk").join(roots, ["sig", "hub"], "left").select(F.coalesce("first", "hub").alias("hub"), "sk")
    return materialize(roots.select(F.col("first").alias("hub"), F.col("hub").alias("sk")).union(followers).filter("hub <> sk").distinct(), "stars")


def bin_counts(a: np.ndarray) -> bytes:
    """How many hashes of a sorted set fall in each of 2^k equal ranges, two to four times as many ranges as hashes.

    Counts take two bits; what is above 3, summed up over all ranges, is in the first four bytes.
    """
    bits = min(17, max(7, len(a).bit_length() + 1))
    full = np.bincount((a >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    c = np.minimum(full, 3).astype(np.uint8)
    return np.uint32((full - c).sum()).tobytes() + (c[::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def _unpack(bins: bytes) -> tuple[int, np.ndarray]:
    """The sum of what is above 3, and the counts up to 3, of `bin_counts`."""
    packed = np.frombuffer(bins, np.uint8, offset=4)
    return int(np.frombuffer(bins, np.uint32, 1)[0]), ((packed[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).ravel()


def _can_link(na: int, nb: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * common >= num * (na + nb - common)


def with_partner(n: np.ndarray, bins: list[bytes], num: int, den: int) -> np.ndarray:
    """Which sets of a group have a partner in it that sizes and bin counts don't rule out.

    The sum of the lesser counts, and of what is above 3, bounds an intersection from above. With equal ranges what is above
    3 in both counts as the lesser sum, since a range above 3 in one set alone is bounded by the other's count. Where
    the larger set has finer ranges, several of its counts make one of the other's, and both sums count.
    """
    opened = [_unpack(b) for b in bins]
    over, width = np.array([o for o, _ in opened]), np.array([len(c) for _, c in opened])
    found = np.zeros(len(n), dtype=bool)
    order = np.argsort(n, kind="stable")
    n_sorted = n[order]
    stops = np.searchsorted(n_sorted, den * n_sorted // num, "right")
    own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in np.unique(width).tolist():
        rows = order[width[order] == k]
        own[k] = rows, np.stack([opened[i][1] for i in rows])
    rank = np.empty(len(n), dtype=np.int64)
    rank[order] = np.arange(len(n))
    for k, (rows, counts) in own.items():
        finer = [(larger, c.reshape(len(c), k, -1).sum(axis=2, dtype=np.uint16)) for w, (larger, c) in own.items() if w > k]
        for r, i in enumerate(rows):
            stop = stops[rank[i]]
            for larger, c, fine in ((rows[r + 1 :], counts[r + 1 :], False), *((x, y, True) for x, y in finer)):
                last = np.searchsorted(rank[larger], stop)
                if last:
                    j = larger[:last]
                    most = np.minimum(counts[r], c[:last]).sum(axis=1, dtype=np.int64) + (over[i] + over[j] if fine else np.minimum(over[i], over[j]))
                    hits = j[_can_link(n[i], n[j], most, num, den)]
                    found[hits], found[i] = True, found[i] or len(hits) > 0
    return found


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each two sorted sets (the diagonal doesn't count), as products of matrices of sets by those hashes that two sets or more have."""
    m = len(sets)
    flat, of = np.concatenate(sets), np.repeat(np.arange(m), [len(a) for a in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    shared = ~new
    shared[:-1] |= ~new[1:]
    column, of = np.cumsum(new[shared]) - 1, of[shared]
    out = np.zeros((m, m), dtype=np.float32)  # whole numbers up to 2^24 are exact
    step = max(1, CELLS // m)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [at, at + step])
        part = np.zeros((m, min(step, int(column[j - 1]) + 1 - at)), dtype=np.float32)
        part[of[i:j], column[i:j] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different ``comp`` that connect whatever such links connect: fewer than there are sets."""
    n = np.array([len(a) for a in sets])
    common = common_counts(sets)
    linked = (den * common >= num * (n[:, None] + n[None, :] - common)) & (comp[:, None] != comp[None, :])
    free, out = np.ones(len(sets), dtype=bool), []
    for root in range(len(sets)):
        reached, free[root] = [root] if free[root] else [], False
        while reached:
            x = reached.pop()
            new = np.flatnonzero(linked[x] & free)
            free[new] = False
            out += [(x, y) for y in new.tolist()]
            reached += new.tolist()
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows in tables that break no group of equal ``keys``, and where groups begin and the last ends; rows come sorted by keys."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held)
        g = np.stack([t.column(c).to_numpy() for c in keys])
        return t, np.r_[np.flatnonzero(np.r_[True, (g[:, 1:] != g[:, :-1]).any(axis=0)]), t.num_rows]

    for b in batches:
        if b.num_rows:
            g = np.stack([b.column(c).to_numpy() for c in keys])
            begins = np.flatnonzero(np.r_[True, (g[:, 1:] != g[:, :-1]).any(axis=0)])
            goes_on = held and [held[-1].column(c)[-1].as_py() for c in keys] == g[:, 0].tolist()
            if held and (len(begins) > 1 or not goes_on):
                first = int(begins[1]) if goes_on else 0
                if first:
                    held.append(b.slice(0, first))
                yield table()
                held, b, begins = [], b.slice(first), begins[begins >= first] - first
            if len(begins) > 1:
                last = int(begins[-1])
                held = [b.slice(0, last)]
                yield table()
                held = [b.slice(last)]
            else:
                held.append(b)
    if held:
        yield table()


def _arrays(values: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in values]


def hash_rows(keys: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (sk, n, hashes) of sets, with the sorted hashes as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(a) for a in sets], pa.int64()), pa.array([a.tobytes() for a in sets], pa.binary())], ["sk", "n", "hashes"])


SETS = "sk long, n long, hashes binary"


def _links_in_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what can be connected within each block of ``rows`` (g, x, y, sk, comp, hashes), at most a row a set."""
    keys = ["g", "x", "y"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole_groups(batches, keys):
            sk, comp = t.column("sk").to_numpy(), t.column("comp").to_numpy()
            out: list[tuple[int, int]] = []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if (comp[i:j] != comp[i]).any():
                    _, once = np.unique(sk[i:j], return_index=True)
                    own = t.column("hashes").slice(i, j - i).take(pa.array(once))
                    out += [(int(sk[i + once[a]]), int(sk[i + once[b]])) for a, b in spanning_links(_arrays(own), comp[i + once], num, den)]
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(find, "a long, b long")


def _possible_members(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The (g, sk) of ``rows`` (g, sk, n, bins; groups of one block) that have a possible partner in their group."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole_groups(batches, ["g"]):
            n, bins = t.column("n").to_numpy(), t.column("bins").to_pylist()
            keep = np.concatenate([with_partner(n[i:j], bins[i:j], num, den) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield from t.select(["g", "sk"]).filter(pa.array(keep)).to_batches()

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(find, "g long, sk long")


def linked_classes(stars: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, num: int, den: int, bounds: DataFrame | None = None, block_sets: int = BLOCK_SETS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """(node, comp): the components of all links between sets that share a signature.

    ``stars`` has (hub, sk) from `shared_stars`; ``fetch`` gives the sets (sk, n, hashes) of a table of keys (sk); ``bounds``
    (sk, n, bins), if given, tells which sets have no possible partner before any set is fetched.

    A star is compared as a whole in one task, which gives no more links than it has sets. A star too large for that is dealt to
    blocks by hash, its hub to each of them. What links a large star has are mostly found within its blocks; if components are left
    in it, the sets outside its largest one meet each other and those inside it, block by block: all pairs of different components.
    """
    groups = stars.select(F.col("hub").alias("g"), "sk").union(stars.select(F.col("hub").alias("g"), F.col("hub").alias("sk")).distinct())
    sets = None
    if bounds is None:
        sets = bounds = fetch(groups.select("sk").distinct())
    columns = ["n", *(["bins"] if sets is None else [])]
    sized = groups.join(bounds.select("sk", *columns), "sk")
    count = lambda c, n: F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum(n) / block_hashes)).cast("int").alias(c)
    large = materialize(sized.groupBy("g").agg(count("blocks", "n")).filter("blocks > 1"), "large-groups")
    has_large = not large.isEmpty()
    large = F.broadcast(large) if at_most(large, BROADCAST_GROUPS) else large
    if sets is None:
        small = sized.join(large, "g", "left_anti") if has_large else sized
        possible = _possible_members(small, num, den)
        groups = materialize(possible.union(sized.join(large, "g", "left_semi").select("g", "sk")) if has_large else possible, "possible-members")
        sets = fetch(groups.select("sk").distinct())
    members = groups.select("g", "sk").withColumns({"x": F.lit(0), "y": F.lit(0)})
    if has_large:
        own = F.pmod(F.xxhash64("sk"), F.col("blocks")).cast("int")
        dealt = groups.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        members = dealt.withColumn("x", F.explode(F.when(F.col("g") == F.col("sk"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))).withColumn("y", F.col("x")).select("g", "sk", "x", "y")
    links = materialize(_links_in_blocks(members.join(sets.select("sk", "hashes"), "sk").withColumn("comp", F.col("sk")), num, den), "links")
    comps = materialize(connected_components(links), "components")
    if not has_large:
        return comps

    inside = groups.join(large.select("g"), "g", "left_semi").join(comps.withColumnRenamed("node", "sk"), "sk", "left").withColumn("comp", F.coalesce("comp", "sk"))
    inside = materialize(inside.join(sets.select("sk", "n"), "sk").select("g", "sk", "comp", "n"), "large-members")
    parts = inside.groupBy("g", "comp").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    main = parts.groupBy("g").agg(F.count("*").alias("several"), F.max_by(F.struct("comp", "sets", "n"), F.struct("sets", "comp")).alias("m"), F.sum("sets").alias("sets"), F.sum("n").alias("n")).filter("several > 1")
    blocks = lambda sets, n: F.greatest(F.ceil(sets / block_sets), F.ceil(n / block_hashes)).cast("int")
    main = main.select("g", F.col("m.comp").alias("main"), blocks(F.col("m.sets"), F.col("m.n")).alias("ins"), blocks(F.col("sets") - F.col("m.sets"), F.col("n") - F.col("m.n")).alias("outs"))
    main = materialize(main, "open-groups")
    if main.isEmpty():
        return comps
    main = F.broadcast(main) if at_most(main, BROADCAST_GROUPS) else main
    placed = inside.join(main, "g")
    # Blocks of the largest component have negative numbers; each meets the others, which meet each other too.
    is_in = F.col("comp") == F.col("main")
    own = F.when(is_in, -1 - F.pmod(F.xxhash64("sk"), F.col("ins"))).otherwise(F.pmod(F.xxhash64("sk"), F.col("outs"))).cast("int")
    others = F.when(is_in, F.sequence(F.lit(0), F.col("outs") - 1)).otherwise(F.sequence(-F.col("ins"), F.col("outs") - 1))
    met = placed.withColumn("own", own).withColumn("other", F.explode(others)).select("g", "sk", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    more = materialize(_links_in_blocks(met.join(sets.select("sk", "hashes"), "sk"), num, den), "links")
    return comps if more.isEmpty() else materialize(connected_components(links.union(more)), "components")
