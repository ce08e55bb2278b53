"""Fill-in-the-middle transformation, with a learned rank index of the places where a text may be cut."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm.similarity import text_slices
from cellgrove.llm.text import whole

SEED = 7
#: Shares of documents, in hundredths, that are transformed at all, and of those that put the suffix first.
RATE, SPM_RATE = 100, 50
#: The farthest, in code points, that a segment's line may be from a boundary, so that a residual fits in a byte.
ERROR = 100
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Boundaries that a segment is tried on at first; the number doubles while the line holds.
WINDOW = 64


def boundaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bytes) at which the lines of a UTF-8 text begin, and its end.

    A line is what a line feed ends, and what follows the last one if that is not empty.
    """
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.r_[ends, len(data)]
    at = np.r_[0, ends].astype(np.int64)
    first = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
    return first[at].astype(np.int64), at


class RankIndex:
    """From a rank among sorted offsets to the offset: straight segments whose error is bounded, and what each offset is off.

    A segment goes on as long as one line through its first offset is within ``error`` of all others (the cone of slopes that
    allow this shrinks from offset to offset). Residuals of up to 127 take one byte each, and make every answer exact.
    """

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            window, stop, slope = WINDOW, at + 1, 0.0
            while stop < len(offsets):
                ranks = np.arange(1, min(window, len(offsets) - at))
                rise = offsets[at + 1 : at + 1 + len(ranks)] - offsets[at]
                low, high = np.maximum.accumulate((rise - error) / ranks), np.minimum.accumulate((rise + error) / ranks)
                out = np.flatnonzero(low > high)
                holds = int(out[0]) if len(out) else len(ranks)
                stop, slope = at + 1 + holds, (low[holds - 1] + high[holds - 1]) / 2
                if len(out):
                    break
                window *= 2
            starts.append(at)
            slopes.append(slope)
            at = stop
        self.starts, self.slopes, self.bases = np.array(starts), np.array(slopes), offsets[np.array(starts)]
        off = offsets - self.predict(np.arange(len(offsets)))
        self.residuals = off.astype(np.int8 if np.abs(off).max() < 128 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets as the segments have them."""
        s = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[s] + np.rint(self.slopes[s] * (ranks - self.starts[s])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets themselves."""
        return self.predict(ranks) + self.residuals[ranks]


def draws(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the SHA-256 of seed and doc_id."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def boundary_index(docs: DataFrame, *, error: int = ERROR) -> DataFrame:
    """(doc_id, n, segments, residuals): the rank index over the line boundaries of each text, as a table.

    ``segments`` has the first rank, the offset there (code points) and the slope of each; ``residuals`` one byte a boundary, or eight if some are
    larger. Null and empty texts have one boundary, 0. Texts are indexed whole; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = [RankIndex(boundaries(np.frombuffer(t.as_buffer(), np.uint8))[0], error) for t in b.column("text")]
            segments = [[{"rank": int(r), "base": int(o), "slope": float(s)} for r, o, s in zip(x.starts, x.bases, x.slopes, strict=True)] for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x.residuals) - 1 for x in found], pa.int64()), pa.array(segments, pa.list_(pa.struct([("rank", pa.int64()), ("base", pa.int64()), ("slope", pa.float64())]))), pa.array([x.residuals.tobytes() for x in found], pa.binary())],
                ["doc_id", "n", "segments", "residuals"])

    return docs.select("doc_id", whole().cast("binary").alias("text")).mapInArrow(index, f"doc_id {kind}, n long, segments array<struct<rank: long, base: long, slope: double>>, residuals binary")


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, error: int = ERROR, carry: list[str] | None = None) -> DataFrame:
    """Cut each text in prefix, middle and suffix between lines, and put the middle last.

    The SHA-256 of ``seed:doc_id`` draws two ranks among the boundaries of lines, and the form: ``psm`` is <P>prefix<S>suffix<M>middle,
    ``spm`` is <S>suffix<P>prefix<M>middle, and ``plain`` the text itself, for empty texts, those that hold one of the marks, and all but
    ``rate`` of 100. Cuts are predicted by a rank index over all boundaries of the text and put right by its residuals.

    Returns doc_id and the columns in ``carry``, with n (lines), form, prefix_chars and middle_chars (code points; null if plain), cut_bytes (the two cuts in
    UTF-8; null if plain) and output. Null text is empty, and a null doc_id is drawn for as an empty one. Rows with one doc_id and text have one
    result. A very long text is cut whole, several times its size in one task's memory. An empty table gives no rows; other columns aren't read, and of
    those in ``carry`` none may have the name of a result.
    """
    kinds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "cut_bytes": "array<long>", "output": "binary"}
    kept = ["doc_id", *[c for c in carry or [] if c != "doc_id"]]
    if clash := {c.lower() for c in kept} & {*kinds, "text", "_id"}:
        raise ValueError(f"columns named like a result: {sorted(clash)}")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for b in text_slices(batches):
            out: dict[str, list] = {k: [] for k in kinds}
            for t, doc_id in zip(b.column("text"), b.column("_id").to_pylist(), strict=True):
                text = t.as_buffer().to_pybytes()
                chars, at = boundaries(np.frombuffer(text, np.uint8))
                n = len(chars) - 1
                one, two, drawn, order = draws(doc_id, seed)
                out["n"].append(n)
                if not text or any(m in text for m in marks) or drawn % 100 >= rate:
                    form, prefix, middle, cuts, output = "plain", None, None, None, text
                else:
                    ranks = np.array(sorted((one % (n + 1), two % (n + 1))))
                    prefix, end = RankIndex(chars, error).offsets(ranks).tolist()
                    cuts, middle = at[np.searchsorted(chars, (prefix, end))].tolist(), end - prefix
                    form = "spm" if order % 100 < spm_rate else "psm"
                    head, mid, tail = marks[0] + text[: cuts[0]], marks[2] + text[cuts[0] : cuts[1]], marks[1] + text[cuts[1] :]
                    output = tail + head + mid if form == "spm" else head + tail + mid
                for k, v in (("form", form), ("prefix_chars", prefix), ("middle_chars", middle), ("cut_bytes", cuts), ("output", output)):
                    out[k].append(v)
            types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "cut_bytes": pa.list_(pa.int64()), "output": pa.binary()}
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(out[k], types[k]) for k in kinds]], [*kept, *kinds])

    rows = docs.select(*kept, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), whole().cast("binary").alias("text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], *[f"{k} {v}" for k, v in kinds.items()]])
    return rows.mapInArrow(transform, schema).withColumn("output", F.decode("output", "UTF-8"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(one, two)], '') AS pre, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS mid,
    array_to_string(units[greatest(one, two) + 1:], '') AS suf FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM parts
"""
