"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they leave."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrove.llm.text import whole

#: The kinds of the base patterns, and one that only the model finds: keys and tokens that give access.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Documents that the model is fitted on, at most (those with the smallest hashes among documents with a digit or @), and their islands.
TRAIN_DOCS, TRAIN_ISLANDS, EPOCHS = 2_000, 600, 6
#: An entity that the model finds has at most so many tokens and characters; a longer run of letters and digits counts as several tokens.
MAX_TOKENS, MAX_CHARS = 12, 64
#: A span of the model counts if its score exceeds that of plain text by so much.
MARGIN = 2.0

#: Tokens whose segments are scored at once when a long stretch is decoded.
TOKENS_AT_ONCE = 1_000

Span = tuple[int, int, int]  # kind, start, end

TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(rf"[^\W_]{{1,{MAX_CHARS}}}|[^\w\s]|_")
#: Strings that are certainly secrets, by the name before them: labels to fit the model with.
NAMED_SECRET = re.compile(r"(?i:token|secret|key|password|passwd|pwd)[\"']?[ ]?[:=][ ]?[\"']?((?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,64})(?![A-Za-z0-9])")
MIXED = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}")
HEX = re.compile(r"[0-9A-Fa-f]{16,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: From the start of a run of digits alone: a later start in the run would fail where the first one does.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    """Whether a number, of however many digits, is at most 255."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern, by start and kind; matches that fail their check are dropped."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(_is_byte(x) for x in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity: neighbouring words with a digit or @, as far as MAX_CHARS around those."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in TRIGGER.finditer(text):
        p = m.start()
        if p < end:
            continue
        begin = p
        while begin > end and p - begin < MAX_CHARS and not text[begin - 1].isspace():
            begin -= 1
        stop = p + 1
        while stop < len(text) and stop - p < MAX_CHARS and not text[stop].isspace():
            stop += 1
        if out and begin - out[-1][1] <= 1 and (begin == out[-1][1] or text[begin - 1] == " "):
            out[-1] = (out[-1][0], stop)
        else:
            out.append((begin, stop))
        end = stop
    return out


#: Upper ends of the classes of digit counts and of lengths.
DIGIT_CLASSES, LENGTH_CLASSES = (0, 3, 6, 9, 11, 13, 15, 16, 19), (4, 7, 12, 16, 20, 32)
GROUPS = re.compile(r"\d+")
#: How many features a span can have.
N_FEATURES = 1 + len(DIGIT_CLASSES) + 1 + len(LENGTH_CLASSES) + 1 + 5 + 21


def span_features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that the whole span text[start:end] has."""
    s = text[start:end]
    d = digits_of(s)
    found = [0]
    at = 1
    found.append(at + sum(len(d) > c for c in DIGIT_CLASSES))
    at += len(DIGIT_CLASSES) + 1
    found.append(at + sum(len(s) > c for c in LENGTH_CLASSES))
    at += len(LENGTH_CLASSES) + 1
    found.append(at + min(4, s.count(".")))
    at += 5
    parts, groups = s.split("."), [len(g) for g in GROUPS.findall(s)]
    local, _, domain = s.partition("@")
    before, after = text[start - 1 : start], text[end : end + 1]
    facts = (
        s.count("@") == 1 and local[:1].isalnum() and "." in domain.strip("."),
        s.count("@") > 1 or s.startswith("@"),
        domain.rpartition(".")[2].isalpha() and len(domain.rpartition(".")[2]) > 1,
        s.startswith("+"),
        "(" in s and s.count("(") == s.count(")"),
        s.count("(") != s.count(")"),
        "-" in s,
        " " in s,
        any(c.isalpha() for c in s),
        s.isdigit(),
        14 <= len(d) <= 19 and luhn(d),
        len(parts) == 4 and all(p.isascii() and p.isdecimal() and _is_byte(p) for p in parts),
        groups[-3:] == [3, 3, 4],
        groups == [4, 4, 4, 4],
        not (s[0].isalnum() or s[0] in "+("),
        not s[-1].isalnum(),
        before.isalnum() or after.isalnum() or before == "." or (after == "." and text[end + 1 : end + 2].isdigit()),
        MIXED.fullmatch(s) is not None,
        HEX.fullmatch(s) is not None,
        any(c in text[max(0, start - 4) : start] for c in "=:"),
        before == after != "" and before in "\"'`",
    )
    found += [at + i for i, f in enumerate(facts) if f]
    return found


class Segments:
    """Candidate segments that begin at the tokens ``low`` to ``high`` (exclusive): tokens as plain text (label 0) and bounded spans (labels 1 and up)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], low: int, high: int) -> None:
        rows, first, last, plain, trigger = [], [], [], [], []
        for i in range(low, high):
            a, hit = tokens[i][0], False
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                z = tokens[j][1]
                if z - a > MAX_CHARS:
                    break
                hit = hit or TRIGGER.search(text, tokens[j][0], z) is not None
                if j == i or hit:
                    first.append(i), last.append(j + 1), plain.append(j == i), trigger.append(hit)
                    rows.append(span_features(text, a, z))
        self.features = np.zeros((len(rows), N_FEATURES), dtype=np.float32)
        for r, x in enumerate(rows):
            self.features[r, x] = 1
        self.first, self.last, self.plain = np.array(first, dtype=int), np.array(last, dtype=int), np.array(plain, dtype=bool)
        self.barred = np.full((len(rows), 1 + len(KINDS)), -np.inf)
        self.barred[self.plain, 0] = 0
        self.barred[np.array(trigger, dtype=bool), 1:] = 0


def tokens_of(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Runs of letters and digits, cut at MAX_CHARS so that each fits an entity, and single other signs but white space."""
    return [(m.start(), m.end()) for m in TOKEN.finditer(text, begin, end)]


class Lattice(Segments):
    """All candidate segments of one short stretch."""

    def __init__(self, text: str, begin: int, end: int) -> None:
        self.tokens = tokens_of(text, begin, end)
        n = len(self.tokens)
        super().__init__(text, self.tokens, 0, n)
        self.ending = [np.flatnonzero(self.last == j) for j in range(n + 1)]
        self.starting = [np.flatnonzero(self.first == i) for i in range(n + 1)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top[~np.isfinite(top)] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def log_likelihood_gradient(x: Lattice, gold: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log probability of the segmentation ``gold`` (segments by labels, 0/1) and its gradients, by forward-backward sums over all segmentations."""
    n, k = len(x.tokens), moves.shape[0]
    score = x.features @ weights.T + x.barred
    alpha, into = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    alpha[0, 0] = 0
    into[0] = moves[0]
    for j in range(1, n + 1):
        s = x.ending[j]
        alpha[j] = _log_sum(into[x.first[s]] + score[s], 0)
        into[j] = _log_sum(alpha[j][:, None] + moves, 0)
    total = _log_sum(alpha[n], 0)
    beta, out = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)
    for i in range(n - 1, -1, -1):
        s = x.starting[i]
        out[i] = _log_sum(score[s] + beta[x.last[s]], 0)
        beta[i] = _log_sum(moves + out[i][None, :], 1)
    chance = np.exp(into[x.first] + score + beta[x.last] - total)
    step = np.exp(alpha[:n, :, None] + moves[None] + out[:n, None, :] - total).sum(axis=0)
    taken = np.zeros_like(moves)
    path = sorted((x.first[r], y) for r, y in zip(*np.nonzero(gold), strict=True))
    for (_, a), (_, b) in zip([(0, 0), *path[:-1]], path, strict=True):
        taken[a, b] += 1
    value = float((gold * np.where(gold > 0, score, 0)).sum() + (taken * moves).sum() - total)
    return value, (gold - chance).T @ x.features, taken - step


def decode(text: str, begin: int, end: int, weights: np.ndarray, moves: np.ndarray) -> list[Span]:
    """The best segmentation's spans: boundaries and types are chosen together.

    Segments are scored for TOKENS_AT_ONCE tokens at a time, so that a stretch may be as long as the text.
    """
    tokens = tokens_of(text, begin, end)
    n, k = len(tokens), moves.shape[0]
    best, came_from, came_by = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k), dtype=np.int32), np.zeros((n + 1, k), dtype=np.int8)
    best[0, 0] = 0
    for low in range(0, n, TOKENS_AT_ONCE):
        high = min(n, low + TOKENS_AT_ONCE)
        x = Segments(text, tokens, low, high)
        score = x.features @ weights.T + x.barred
        score[:, 1:] -= MARGIN
        bounds = np.searchsorted(x.first, np.arange(low, high + 1))
        for i in range(low, high):
            into = best[i][:, None] + moves
            before = into.argmax(axis=0)
            rows = slice(bounds[i - low], bounds[i - low + 1])
            found, at = into[before, np.arange(k)] + score[rows], x.last[rows]
            better = found > best[at]
            best[at], came_from[at], came_by[at] = np.where(better, found, best[at]), np.where(better, i, came_from[at]), np.where(better, before, came_by[at])
    j, y, out = n, int(best[n].argmax()), []
    while j:
        i, before = int(came_from[j, y]), int(came_by[j, y])
        if y:
            out.append((y - 1, tokens[i][0], tokens[j - 1][1]))
        j, y = i, before
    return out[::-1]


def fit(examples: list[tuple[str, list[Span]]], *, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (label x feature) and moves (label x label) by gradient ascent on (text, spans) examples."""
    k = 1 + len(KINDS)
    weights, moves = np.zeros((k, N_FEATURES)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    lattices = []
    for text, spans in examples:
        x = Lattice(text, 0, len(text))
        where = {(x.tokens[i][0], x.tokens[j - 1][1]): r for r, (i, j) in enumerate(zip(x.first, x.last, strict=True))}
        gold, covered = np.zeros((len(x.first), k)), np.zeros(len(x.tokens), dtype=bool)
        for kind, a, b in spans:
            r = where.get((a, b))
            if r is not None and not covered[x.first[r] : x.last[r]].any():
                gold[r, kind + 1] = 1
                covered[x.first[r] : x.last[r]] = True
        for r in np.flatnonzero(x.plain):
            if not covered[x.first[r]]:
                gold[r, 0] = 1
        if x.tokens:
            lattices.append((x, gold))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(lattices)):
            _, gw, gm = log_likelihood_gradient(*lattices[i], weights, moves)
            gw -= 1e-3 * weights
            seen_w += gw**2
            seen_m += gm**2
            weights += 0.3 * gw / np.sqrt(seen_w)
            moves += 0.3 * gm / np.sqrt(seen_m)
    return weights, moves


#: Signs before an island that features of its first span look at.
LOOK_BACK = 4


def training_examples(text: str) -> list[tuple[str, list[Span]]]:
    """The islands of a text, with LOOK_BACK signs before and one after, with their base spans and named secrets.

    Those with a phone number come again without its country prefix, as a phone all the same.
    """
    spans, out = base_spans(text), []
    taken = {i for _, s, e in spans for i in range(s, e)}
    spans += [(KINDS.index("secret"), m.start(1), m.end(1)) for m in NAMED_SECRET.finditer(text) if not taken & set(range(m.start(1), m.end(1)))]
    for a, b in islands(text):
        a, b = max(0, a - LOOK_BACK), min(len(text), b + 1)
        inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
        out.append((text[a:b], inside))
        for k, s, e in inside:
            if k == 3 and len(inside) == 1 and (m := re.match(r"\+[0-9]{1,3}[ -]", text[a + s : a + e])):
                cut = m.end()
                out.append((text[a : a + s] + text[a + s + cut : b], [(3, s, e - cut)]))
    return out


def find_spans(text: str, weights: np.ndarray, moves: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans). The model decodes what of the islands base spans leave."""
    base = base_spans(text)
    added: list[Span] = []
    for a, b in islands(text):
        free, at = [], a
        for _, s, e in (x for x in base if x[1] < b and x[2] > a):
            if s > at:
                free.append((at, s))
            at = max(at, e)
        if at < b:
            free.append((at, b))
        for s, e in free:
            if TRIGGER.search(text, s, e):
                added += decode(text, s, e, weights, moves)
    return base, sorted([*base, *added], key=lambda x: (x[1], x[0], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, spans string, n_spans long"


def fit_on(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, train_islands: int = TRAIN_ISLANDS) -> tuple[np.ndarray, np.ndarray]:
    """Fit the model on a bounded sample of texts, with the base spans and named secrets as labels.

    Islands of more than 4 * MAX_CHARS signs don't serve as examples; they are decoded all the same.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, joined(s)) for text in b.column("text").to_pylist() for t, s in training_examples(text) if len(t) <= 4 * MAX_CHARS]
            yield pa.RecordBatch.from_pydict({"island": pa.array([x[0] for x in found], pa.string()), "spans": pa.array([x[1] for x in found], pa.string())})

    texts = docs.select(whole().alias("text")).filter(F.col("text").rlike("[0-9@]"))
    cut = texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(train_docs)
    sample = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(cut), "h").dropDuplicates(["h"]).select("text")  # at most `train_docs` rows
    rows = sample.mapInArrow(examples, "island string, spans string").orderBy(F.xxhash64("island", "spans"), "island", "spans").limit(train_islands).collect()
    parse = lambda s: [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return fit([(r["island"], parse(r["spans"])) for r in rows])


def with_pii(docs: DataFrame, **options) -> DataFrame:
    """Add counts of base spans by kind, ``base`` and ``spans`` ("kind:start:end,...", code points), ``base_sha256`` (of ``base``) and ``n_spans``.

    Null or empty texts have no spans. Very long texts are read once and decoded stretch by stretch, whatever they
    consist of; an entity has at most MAX_CHARS characters for the model. Repeated rows have equal results; an empty table gives
    no rows. Columns named like an added one are replaced; others pass through.
    """
    added = [c.split()[0] for c in RESULT.split(", ")]
    docs = docs.drop(*added)
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, **options))
    names = docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = model.value
        for b in batches:
            counts, texts, n_spans = [[] for _ in BASE_KINDS], [[], [], []], []
            for text in b.column("text").to_pylist():
                base, every = find_spans(text, weights, moves) if text else ([], [])
                for k, c in enumerate(counts):
                    c.append(sum(x[0] == k for x in base))
                n_spans.append(len(every))
                line = joined(base)
                for c, v in zip(texts, (hashlib.sha256(line.encode()).hexdigest(), line, joined(every)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int64()) for c in counts], *[pa.array(c, pa.string()) for c in texts], pa.array(n_spans, pa.int64())], [*names, *added])

    schema = T.StructType(list(docs.schema.fields))
    for c in RESULT.split(", "):
        schema.add(*c.split())
    return docs.mapInArrow(find, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
