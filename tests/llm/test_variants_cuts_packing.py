"""Spelling variants, fill-in-the-middle and packing against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.llm import fill_in_middle, packing, spelling

SCHEMA = "doc_id long, text string, n string, form string, length string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 6, 7, 8, 12]))) for _ in range(40)]

    def variant(w):
        i, c = rng.randrange(len(w)), rng.choice("abcÿÉ")
        return rng.choice([w, w, w, w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])

    def text():
        return rng.choice(["", "\n"]) + "".join(variant(rng.choice(stems[: rng.choice([3, 40])])) + rng.choice([" ", " ", "\n", ", ", "1"]) for _ in range(rng.choice([1, 5, 60, 200])))

    texts = [text() for _ in range(80)]
    texts += texts[:5] + [None, "", "\n", "\n\n\n", "a", "no line feed", "has <P> in it\nand more", "é\n日本\n😀😀\nx", "x" * 9000 + "\ny", "Ab" * 4000, "line\n" * 5000, "only\n", "<|endoftext|> marks\n", "ZZZZZZ ZZZZZZ zzzzzz\n" * 3 + "zzzzzy " * 2]
    out = [(i, t, "clash", None, "7") for i, t in enumerate(texts)]
    return [*out, (3, texts[3], "clash", None, "7"), (None, "null id\nof " + "abcdef " * 9, "clash", None, "7"), (None, None, "clash", None, "7")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_spelling_variants(docs, rows, empty):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            counts[w] += len(w) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    assert got == {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}
    assert any(form.values()) and any("é" in w for w in n) and max(map(len, n)) < 100
    assert spelling.spelling_variants(empty).collect() == []


def test_blocks_of_many_tiles_and_very_long_words(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abey") for _ in range(6)) for _ in range(700)}
    long_ = "q" * 5000
    words |= {long_, "q" * 4999, long_[:700] + "w" + long_[701:], long_ + "w", "q" * 5002}
    vocabulary = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    wanted = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if one_edit(a, b)}
    for tile in (5, 2048):
        got = [tuple(sorted((r.a, r.b))) for r in spelling.near_words(vocabulary, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_chains_of_forms_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5"), ("y", "z")], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(forms).collect()} == {**{f"w{i}": "w13" for i in range(13)}, "x": "w13", "y": "z"}


def test_fill_in_middle(docs, rows, empty):
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        t, key = text or "", "" if doc_id is None else str(doc_id)
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
        if not t or re.search("<[PSM]>", t):
            wanted[(doc_id, len(units), "plain", None, None, t)] += 1
        elif h4 % 100 < 50:
            wanted[(doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")] += 1
        else:
            wanted[(doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")] += 1
    out = fill_in_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == wanted
    assert collections.Counter((r.doc_id, r.back) for r in got) == collections.Counter((i, t or "") for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        if r.form != "plain":
            b = r.back.encode()
            assert len(b[: r.cut_bytes[0]].decode()) == r.prefix_chars and len(b[r.cut_bytes[0] : r.cut_bytes[1]].decode()) == r.middle_chars
    assert fill_in_middle.fill_in_middle(empty).collect() == []
    assert {r.form for r in fill_in_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert "spm" not in {r.form for r in fill_in_middle.fill_in_middle(docs, spm_rate=0).collect()}
    with pytest.raises(ValueError, match="named like"):
        fill_in_middle.fill_in_middle(docs, carry=["form"])
    assert fill_in_middle.fill_in_middle(docs, carry=["length"]).filter("length = '7'").count() == len(rows)


@pytest.mark.parametrize("error", [0, 3, 100])
def test_rank_index_is_exact_and_segments_keep_their_error(error):
    rng = np.random.default_rng(4)
    for gaps in ([], [5], rng.integers(1, 90, 3000), np.full(5000, 17), np.r_[np.full(900, 3), 10**6, np.full(900, 50)], rng.pareto(0.7, 4000).astype(int) + 1):
        offsets = np.r_[0, np.cumsum(gaps)].astype(np.int64)
        index = fill_in_middle.RankIndex(offsets, error)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all() and np.abs(index.residuals.astype(int)).max() <= error + 1
        assert error < 100 or index.residuals.dtype == np.int8
    assert len(fill_in_middle.RankIndex(np.arange(5001) * 17, error).starts) == 1


def test_index_of_boundaries_as_a_table(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n, len(r.segments) > 0) for r in fill_in_middle.boundary_index(docs).collect())
    assert got == collections.Counter((i, len(re.findall(r"[^\n]*\n|[^\n]+", t or "")), True) for i, t, *_ in rows)
    assert fill_in_middle.boundary_index(empty).collect() == []


def fewest(counts):
    """The least number of sequences, by trying every filling around the longest piece."""
    capacity = len(counts) - 1

    @functools.lru_cache(None)
    def solve(left):
        longest = next((k for k in range(capacity, 0, -1) if left[k]), 0)
        if not longest:
            return 0
        left = list(left)
        left[longest] -= 1
        best = sum(left) + 1

        def fill(room, at):
            nonlocal best
            if not any(left[k] for k in range(1, room + 1)):  # full fillings are enough
                best = min(best, 1 + solve(tuple(left)))
                return
            for k in range(min(at, room), 0, -1):
                if left[k]:
                    left[k] -= 1
                    fill(room - k, k)
                    left[k] += 1
            if not any(left[k] for k in range(1, min(at, room) + 1)):
                best = min(best, 1 + solve(tuple(left)))

        fill(capacity - longest, capacity)
        return best

    return solve(tuple(int(c) for c in counts))


def test_packing_finds_the_fewest_sequences():
    rng = np.random.default_rng(6)
    better = 0
    for _ in range(150):
        counts = np.zeros(31, dtype=np.int64)
        np.add.at(counts, rng.integers(4, 20, 11), 1)
        plan, held = packing.pack(counts), np.zeros(31, dtype=np.int64)
        for times, pattern in plan:
            assert times > 0 and sum(k * n for k, n in pattern) <= 30
            for k, n in pattern:
                held[k] += times * n
        best, found = fewest(counts), sum(t for t, _ in plan)
        assert (held == counts).all() and packing.lower_bound(counts) <= best == found
        better += found < sum(t for t, _ in packing.best_fit(counts))
    assert better  # the search improves on best fit
    assert packing.pack(np.zeros(9)) == []


def test_packing_of_very_many_pieces_takes_no_longer():
    counts = np.zeros(2049, dtype=np.int64)
    counts[[2048, 1500, 548, 1348, 700]] = 10**9
    assert sum(t for t, _ in packing.pack(counts)) == 3 * 10**9


def test_pack_documents(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_file(packing.TOKENIZER))
    tokenizer.encode_special_tokens = True
    capacity = 64
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity
        cuts = [0, *([head] if head else []), *range(head + capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            wanted[(doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes())] += 1
    out = packing.pack_documents(docs, capacity=capacity)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == wanted
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))] and sum(r.length for r in s) <= capacity
        for r in s:
            counts[r.length] += 1
    assert len(sequences) == packing.lower_bound(counts)
    packed = {r.sequence_id: (r.length, bytes(r.ids), r.doc_ids) for r in packing.packed_sequences(out).collect()}
    assert packed == {k: (sum(r.length for r in s), b"".join(bytes(r.ids) for r in s), [r.doc_id for r in s]) for k, s in sequences.items()}
    assert packing.pack_documents(empty).collect() == []


def test_hot_length_is_counted_off_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    docs = spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") < 150, F.lit("same text")).otherwise(F.repeat(F.lit("a b "), F.col("id").cast("int"))).alias("text"))
    got = packing.pack_documents(docs.union(docs.limit(3)), capacity=256).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got) and sum(r.length for r in got if r.doc_id == "0") % 3 == 0
    assert len({r.sequence_id for r in got}) * 256 - sum(r.length for r in got) < 256
