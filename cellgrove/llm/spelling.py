"""Grouping of spelling variants: words one edit apart, found by Gram matrices of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm.text import ascii_lower, whole
from cellgrove.scratch import at_most, materialize

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: One of so many (document, word) pairs loses a letter.
NOISE = 199
#: Letters are dealt to so many classes; a block is the words with the same number of letters of each class, so of one length.
CLASSES = 4
#: Words of up to 64 letters that a task compares at once with as many others; longer words count for more.
TILE, TILE_LETTERS = 2_048, 64
#: Counts of letters by code, letters with the same remainder together: fewer dimensions only make distances smaller.
DIMENSIONS = 32
#: A table of blocks of up to so many rows (under 10 MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_BLOCKS = 200_000
#: Every letter a word can have, each one byte in Latin-1.
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))


def noisy_words(docs: DataFrame, *, min_chars: int = MIN_CHARS, noise: int = NOISE) -> DataFrame:
    """(word): each run of letters of ``min_chars`` or more, A-Z lower-cased, of the whole texts; one of ``noise`` distinct words of a document lacks a letter.

    Which ones, and which letter, is drawn by the CRC-32 of ``doc_id:word``. Shorter results are left out.
    """
    runs = F.regexp_extract_all(ascii_lower(whole()), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    at = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_id"), F.explode(runs).alias("_run"))
    h, run = F.col("_h"), F.col("_run")
    cut = F.pmod(h, F.length(run)).cast("int")
    word = F.when(F.pmod(h, F.lit(noise)) == 0, F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))).otherwise(run)
    return at.withColumn("_h", F.crc32(F.concat("_id", "_run").cast("binary"))).select(word.alias("word")).filter(F.length("word") >= min_chars)


def _class_letters(i: int, classes: int) -> str:
    return "".join(c for c in LETTERS if ord(c) % classes == i)


def _targets(classes: int) -> Column:
    """Blocks in which a word meets those of which it may be an edit, with the part it takes there.

    0: as a word of the block; 1: as another word of its own block; 2: of a block where one letter is of another class; 3: of a
    block with one letter less. Each pair of blocks occurs once.
    """
    own = [F.col(f"c{i}") for i in range(classes)]
    moved = lambda change: F.struct(*[(c + change.get(i, 0)).alias(f"k{i}") for i, c in enumerate(own)])
    part = lambda role, change: F.struct(moved(change).alias("k"), F.lit(role).alias("role"))
    swaps = [part(2, {i: -1, j: 1}) for i in range(classes) for j in range(i + 1, classes)]
    return F.array(part(0, {}), part(1, {}), *swaps, *[part(3, {i: -1}) for i in range(classes)])


def letter_counts(words: np.ndarray) -> np.ndarray:
    """Counts of letters, a row a word, of a matrix of Latin-1 bytes; single precision where squares of counts are exact in it."""
    m, length = words.shape
    flat = (np.arange(m)[:, None] * DIMENSIONS + words % DIMENSIONS).ravel()
    return np.bincount(flat, minlength=m * DIMENSIONS).reshape(m, DIMENSIONS).astype(np.float32 if length < 2_000 else np.float64)


def one_replaced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words of equal lengths differ in exactly one place, and whether the first has the smaller letter there."""
    differ = a != b
    where = differ.argmax(axis=1)
    rows = np.arange(len(a))
    return differ.sum(axis=1) == 1, a[rows, where] < b[rows, where]


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each longer word of ``b`` is that of ``a`` with one letter put in."""
    heads, tails = a != b[:, :-1], (a != b[:, 1:])[:, ::-1]
    lengths = [np.where(x.any(axis=1), x.argmax(axis=1), a.shape[1]) for x in (heads, tails)]
    return lengths[0] + lengths[1] >= a.shape[1]


def edits(left: np.ndarray, right: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of ``left``, rows of ``right``) that are one edit apart.

    The product of the matrices of letter counts gives all squared distances at once; only pairs at two or less can be one edit
    apart, and these are compared letter by letter.
    """
    a, b = letter_counts(left), letter_counts(right)
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(d2 <= 2)
    found = []
    step = max(1, 4_000_000 // left.shape[1])
    for at in range(0, len(i), step):
        x, y = left[i[at : at + step]], right[j[at : at + step]]
        if role == 3:
            found.append(one_inserted(x, y))
        else:
            replaced, first = one_replaced(x, y)
            found.append(replaced & first if role == 1 else replaced)  # in one block a pair comes both ways round
    ok = np.concatenate(found) if found else np.zeros(0, dtype=bool)
    return i[ok], j[ok]


def _letters(words: pa.Array) -> np.ndarray:
    """Words (binary) of one length as a matrix of bytes."""
    spans = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data = np.frombuffer(words.buffers()[2], np.uint8)[spans[0] : spans[-1]]
    return data.reshape(len(words), -1)


def _compare(classes: int):
    keys = [*[f"k{i}" for i in range(classes)], "tile"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left, counts = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(c).to_numpy() for c in [*keys, "role"]])
            runs = np.r_[np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)]), b.num_rows]
            for at, stop in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                key, role = tuple(marks[:-1, at].tolist()), int(marks[-1, at])
                words, n = _letters(b.column("letters").slice(at, stop - at)), b.column("n").slice(at, stop - at).to_numpy()
                if role == 0:
                    if key != group:
                        group, left, counts = key, [], []
                    left.append(words)
                    counts.append(n)
                    continue
                if key != group:  # no word of the block was dealt to this tile
                    continue
                own, own_n = left[0] if len(left) == 1 else np.concatenate(left), np.concatenate(counts)
                left, counts = [own], [own_n]
                step = max(1, TILE * TILE_LETTERS // max(TILE_LETTERS, words.shape[1]))
                for k in range(0, len(words), step):
                    i, j = edits(own, words[k : k + step], role)
                    if len(i):
                        other = words[k : k + step]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([own[x].tobytes() for x in i], pa.binary()), pa.array(own_n[i]), pa.array([other[x].tobytes() for x in j], pa.binary()), pa.array(n[k : k + step][j])],
                            ["a", "n_a", "b", "n_b"])

    return find


def near_words(vocabulary: DataFrame, *, classes: int = CLASSES, tile: int = TILE) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words (word, n) that are one insertion, deletion or replacement apart, each pair once.

    Words are distinct, and of the letters of `noisy_words`. Only blocks whose class counts allow one edit meet: the same block, one letter of another class,
    or one letter more. A block of many words is dealt to tiles by hash; each tile meets all words of its own and the neighbouring blocks, which
    stream past it, so a task holds one tile however large a block is.
    """
    counts = {f"c{i}": F.length("word") - F.length(F.translate("word", _class_letters(i, classes), "")) for i in range(classes)}
    words = vocabulary.select("n", F.encode("word", "ISO-8859-1").alias("letters"), *[v.alias(k) for k, v in counts.items()])
    keys = [f"k{i}" for i in range(classes)]
    total = sum((F.col(k) for k in keys[1:]), F.col(keys[0]))
    tiles = F.ceil(F.col("_n") * F.greatest(F.lit(1.0), total / float(TILE_LETTERS)) / tile).cast("int")
    blocks = words.groupBy(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    blocks = materialize(blocks.select(*keys, tiles.alias("tiles")), "blocks")
    blocks = F.broadcast(blocks) if at_most(blocks, BROADCAST_BLOCKS) else blocks
    rows = words.select("n", "letters", F.inline(_targets(classes))).select("n", "letters", "role", "k.*").join(blocks, keys)
    own = F.pmod(F.xxhash64("letters"), F.col("tiles")).cast("int")
    dealt = rows.withColumn("tile", F.explode(F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))).drop("tiles")
    met = dealt.repartition(*keys, "tile").sortWithinPartitions(*keys, "tile", "role")
    found = met.mapInArrow(_compare(classes), "a binary, n_a long, b binary, n_b long")
    text = lambda c: F.decode(c, "ISO-8859-1").alias(c)
    return found.select(text("a"), "n_a", text("b"), "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by jumps that double."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        state = materialize(state.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if state.filter("_moved").isEmpty():
            return state.select("word", "root")


def spelling_variants(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """Words of a corpus with the more frequent word that each is probably a variant of.

    Words are runs of letters, A-Z lower-cased, of at least ``min_chars`` code points and ``min_count`` occurrences; one in ``noise`` distinct words of a
    document loses a letter first. Two words are near if one insertion, deletion or replacement of a code point
    leads from one to the other. A word's form is its most frequent near word (of several the first in code point order) if that
    is at least ``ratio`` times as frequent, and its root the end of the chain of forms.

    Returns word, form, root, n, n_near and form_n. Null and empty texts have no words; a very long text is read whole, and a very long word is one word. Rows that
    repeat count again. A null doc_id is drawn for as an empty one. An empty table gives no rows; other columns aren't read. Counts are added up before
    the shuffle, so a very common word is no hot group.
    """
    counted = noisy_words(docs, min_chars=min_chars, noise=noise).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    words = materialize(counted, "vocabulary")
    pairs = near_words(words)
    way = lambda *names: F.struct(*[F.col(c).alias(k) for c, k in zip(names, ("word", "n", "other", "n_other"), strict=True)])
    both = F.array(way("a", "n_a", "b", "n_b"), way("b", "n_b", "a", "n_a"))
    best = F.min(F.when(F.col("n_other") >= ratio * F.col("n"), F.struct((-F.col("n_other")).alias("n"), "other")))
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    near = materialize(near.select("word", "n_near", F.col("_best.other").alias("form"), (-F.col("_best.n")).alias("form_n")), "near-words")
    roots = _roots(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_CRC32 = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"
OP11_SQL = r"""
WITH RECURSIVE crc_rows AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(0, 256) t(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (SELECT run, times, @CRC AS h FROM (SELECT *, id || ':' || run AS keyed FROM runs), crc_rows),
vocabulary AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(0, length(word))) AS i FROM vocabulary)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS n_other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cuts c JOIN vocabulary v ON c.cut = v.word
  UNION SELECT v.word, v.n, c.word, c.n FROM cuts c JOIN vocabulary v ON c.cut = v.word),
near AS (SELECT word, n, count(DISTINCT other) AS n_near, first(other ORDER BY n_other DESC, other) AS best, max(n_other) AS best_n FROM pairs GROUP BY ALL),
forms AS (SELECT word, best AS form, best_n AS form_n FROM near WHERE best_n >= 5 * n),
chain AS (SELECT word, form AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms))
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(m.n_near, 0)::BIGINT AS n_near, f.form_n
FROM vocabulary v LEFT JOIN near m ON m.word = v.word LEFT JOIN forms f ON f.word = v.word LEFT JOIN roots r ON r.word = v.word
""".replace("@CRC", _CRC32.format("keyed"))
