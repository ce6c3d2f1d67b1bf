"""Toxicity by compression distance to two zstandard dictionaries.

A window is one word or four neighbouring words (without punctuation, each width in its own
row of windows), followed by a fixed anchor that both dictionaries end with, so that a few
bytes are compressible at all. It is compressed with a dictionary trained on toxic text and
with one trained on ordinary text; the ordinary length less the toxic one is its margin in
bytes.

The first dictionaries are trained on the whole texts of each class. In toxic texts most
windows are ordinary all the same, so in PASSES more rounds the toxic dictionary is trained
on those windows of the toxic texts whose margin under the pair so far is above a threshold
that is calibrated on the ordinary texts (RARE of their windows are at or below it).
A document has its counts of windows at each margin, as logarithms and as rates that
RATE_WORDS more windows dampen in short texts, and a logistic fit calibrates these to a
probability. One in PARTS rows of each class is kept from the dictionaries for that fit, which
weights the rows to the classes' true numbers.

Training takes whole labelled documents of the training folds in the order of a hash of their
id, at most SAMPLE rows and SAMPLE_BYTES of each class; a text that doesn't fit into what is
left of the bytes is passed over. Near copies of one label among them count once (Jaccard
similarity of runs of SHINGLE words of SIMILAR or more, compared exactly).

Scoring keeps no state between documents but a bounded cache of single words' margins; texts are read whole, in pieces of bounded size.

Defined results: NULL and empty texts have no windows and get the fit's value for that; equal
texts get equal scores; an empty table gives an empty result; labels of several rows count as
their largest, and an id with several texts trains with its smallest; without toxic or ordinary
training rows all scores are 0. Only the text is an input of a score. Columns of docs are all
carried, whatever their names; only one called like the score is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fresh, plain

SHINGLE, SIMILAR, PIECE = 5, 0.8, 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
SAMPLE, SAMPLE_BYTES = 12_000, 6 << 20
#: Bytes of the dictionaries (first toxic, later toxic, ordinary) and the segment lengths they are made of.
FIRST_BYTES, TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, TOXIC_SEGMENT = 16_384, 2048, 65_536, 16, 16
PASSES, WIDTHS, MARGINS, RATE_WORDS, RARE, PARTS, ENOUGH = 3, (1, 4), range(9), 50, 0.99, 3, 0.7
#: Characters of a piece; words of pieces that are compressed together; single words whose margins are held; rows that are scored together.
SLICE, HELD, CACHE, ROWS = 1 << 20, 1 << 15, 100_000, 256
#: A run of distinct bytes: one match for the compressor.
ANCHOR = b"|0123456789~abcdef#ZYXW|"
_EDGE = b".,;:!?()[]{}\"'*$%#&|"


def words(text: str) -> list[bytes]:
    """Lower-case words without punctuation at their edges."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode().split()) if w]


def pieces(text: str, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of whole windows except for the last, from slices of about size characters."""
    at, left = 0, []
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        got = left + words(text[at:end])
        at = end
        left = got[len(got) - len(got) % WIDTHS[-1] :]
        if len(got) > len(left):
            yield got[: len(got) - len(left)]
    if left:
        yield left


def windows(found: list[bytes], width: int) -> list[bytes]:
    """Neighbouring words, width at a time."""
    if width == 1:
        return [b" %b " % w for w in found]
    return [b" %b " % b" ".join(found[i : i + width]) for i in range(0, len(found), width)]


class Pair:
    """Compressors with the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        p = zs.ZstdCompressionParameters.from_level(9, window_log=20, hash_log=16, chain_log=16, min_match=4, strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
        self.ordinary, self.toxic = (zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d + ANCHOR, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p) for d in (ordinary, toxic))

        self._known: dict[bytes, int] = {}

    def _lengths(self, found: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        if not found:
            return np.zeros(0, np.int64)
        size = np.fromiter(map(len, found), np.uint64, len(found)) + np.uint64(len(ANCHOR))
        segments = np.stack([np.cumsum(size) - size, size], axis=1).astype("<u8").tobytes()
        data = zs.BufferWithSegments(ANCHOR.join(found) + ANCHOR, segments)
        a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(data)), np.int64, len(found)) for c in (self.ordinary, self.toxic))
        return a - b

    def margins(self, found: list[bytes]) -> np.ndarray:
        """The same for windows that repeat, as single words do; what was asked is held for later calls, up to CACHE windows."""
        known = self._known
        if len(known) > CACHE:
            known.clear()
        new = [w for w in dict.fromkeys(found) if w not in known]
        known.update(zip(new, self._lengths(new).tolist()))
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def histograms(self, texts: list[str]) -> np.ndarray:
        """For each text and width, how many windows reach each of MARGINS, and how many there are. Small texts share calls."""
        out = np.zeros((len(texts), len(WIDTHS), len(MARGINS) + 1), np.int64)
        held: list[tuple[int, list[bytes]]] = []
        room = HELD
        for i, t in enumerate(texts):
            for part in pieces(t):
                held.append((i, part))
                room -= len(part)
                if room <= 0:
                    self._count(held, out)
                    held, room = [], HELD
        self._count(held, out)
        return out

    def _count(self, held: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        for j, width in enumerate(WIDTHS):
            each = [windows(p, width) for _, p in held]
            m = np.clip((self.margins if width == 1 else self._lengths)([w for e in each for w in e]), -1, len(MARGINS) - 1)
            text = np.repeat([i for i, _ in held], [len(e) for e in each])
            # windows by text and margin, then how many reach each margin
            table = np.bincount(text * (len(MARGINS) + 1) + m + 1, minlength=len(out) * (len(MARGINS) + 1)).reshape(len(out), -1) if len(m) else 0
            if len(m):
                down = table[:, ::-1].cumsum(axis=1)[:, ::-1]
                out[:, j] += np.concatenate([down[:, 1:], down[:, :1]], axis=1)


def features(counts: np.ndarray) -> np.ndarray:
    c, n = counts[:, :-1], counts[:, -1:]
    return np.r_[np.log1p(c).ravel(), (c * RATE_WORDS / (n + RATE_WORDS)).ravel(), np.log1p(n[0]), 1.0]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state
        self.__post_init__()

    def scores(self, texts: list[str]) -> list[float]:
        if not self.weights:
            return [0.0] * len(texts)
        if self._pair is None:
            self._pair = Pair(self.ordinary, self.toxic)
        w = np.array(self.weights)  # a product for each text, so that equal texts get equal sums
        return [float(1 / (1 + np.exp(-np.clip(features(c) @ w, -500, 500)))) for c in self._pair.histograms(texts)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words, or of all the words if there are fewer."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words(text)), np.uint64)
    size = min(SHINGLE, len(h))
    out = np.zeros(max(0, len(h) - size + 1) if size else 0, np.uint64)
    for k in range(size):
        out = out * _MULT + h[k : k + len(out)]
    return np.unique(out)


def distinct(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies: those whose shingles have a Jaccard similarity of SIMILAR or more to an earlier kept row of the same label.

    Two such rows share one of their rarest shingles, as many as may be missing and one more,
    so only rows that meet in these are compared, and none of them is left out.
    """
    sets = [shingles(t) for t, _ in rows]
    flat = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    cut = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    n = np.diff(np.r_[cut, len(flat)])
    often, n = flat[cut][n > 1], n[n > 1]
    del flat, cut
    met: dict[tuple[int, int], list[int]] = {}
    blank: set[int] = set()
    out = []
    for i, (text, y) in enumerate(rows):
        s = sets[i]
        if not len(s):
            if y not in blank:
                blank.add(y)
                out.append((text, y))
            continue
        at = np.searchsorted(often, s)
        known = at < len(often)
        known[known] = often[at[known]] == s[known]
        spare = len(s) - math.ceil(SIMILAR * len(s) - 1e-9) + 1 - int((~known).sum())  # shingles of one row only come first
        rare = []
        if spare > 0:
            at, s_known = at[known], s[known]
            rare = s_known[np.lexsort((s_known, n[at]))[:spare]].tolist()
        near = {j for h in rare for j in met.get((h, y), ()) if SIMILAR * len(s) <= len(sets[j]) * (1 + 1e-9) and SIMILAR * len(sets[j]) <= len(s) * (1 + 1e-9)}
        for j in near:
            both = len(np.intersect1d(s, sets[j], assume_unique=True))
            if both >= SIMILAR * (len(s) + len(sets[j]) - both) - 1e-9:
                break
        else:
            for h in rare:
                met.setdefault((h, y), []).append(i)
            out.append((text, y))
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Trained content. Few samples are made more by giving them again; if they are too uniform to train on, they are the content."""
    if not any(samples):
        return b" "
    again = max(1, math.ceil(64 / len(samples)), math.ceil(8 * segment * 8 / max(1, sum(map(len, samples)))))
    try:
        return zs.train_dictionary(size, samples * again, k=segment, d=6).as_bytes()
    except zs.ZstdError:
        return b" ".join(samples)[:size]


def _pieces(texts: list[list[bytes]]) -> list[bytes]:
    """All words of the texts, in distinct pieces that are put in the order of a hash: the trainer goes through its input part by part and gives up in a long stretch of one repeated word."""
    found = dict.fromkeys(b" ".join(x[i : i + PIECE]) for x in texts for i in range(0, len(x), PIECE))
    return sorted(found, key=lambda x: (xxhash.xxh64_intdigest(x, 3), x))


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from the whole texts of both classes."""
    t, o = [words(x) for x in toxic], [words(x) for x in ordinary]
    base = _dictionary(_pieces(o), ORDINARY_BYTES, SEGMENT)
    marked = _dictionary(_pieces(t), FIRST_BYTES, SEGMENT)
    usual_windows = windows([w for x in o for w in x], 1)
    for _ in range(PASSES if usual_windows else 0):
        pair = Pair(base, marked)
        usual = max(0, int(np.quantile(pair.margins(usual_windows), RARE, method="lower")))
        samples = [[w for w, m in zip(x, pair.margins(windows(x, 1)).tolist()) if m > usual] for x in t]
        marked = _dictionary(_pieces(samples), TOXIC_BYTES, TOXIC_SEGMENT)
    return base, marked


def fit(rows: list[tuple[str, int]], true: tuple[int, int] | None = None) -> Model:
    """A model from (text, label) rows; true gives the numbers of ordinary and toxic rows that these stand for."""
    rows = distinct(rows)
    if len({y for _, y in rows}) < 2:
        return Model(b" ", b" ", [])
    seen, learn, calibrate = [0, 0], [], []
    for row in rows:  # each class is dealt out evenly
        (calibrate if seen[row[1]] % PARTS == PARTS - 1 else learn).append(row)
        seen[row[1]] += 1
    if len({y for _, y in calibrate}) < 2:
        learn = calibrate = rows
    ordinary, toxic = dictionaries([t for t, y in learn if y], [t for t, y in learn if not y])
    pair = Pair(ordinary, toxic)
    x = np.array([features(c) for c in pair.histograms([t for t, _ in calibrate])])
    y = np.array([label for _, label in calibrate], float)
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = np.array(true if true and all(true) else n) / n
    by_row = np.where(y == 1, share[1], share[0]) * len(y) / (share @ n)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (by_row * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (by_row * (y - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(toxic, ordinary, w.tolist())


def fold(key, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents whose fold isn't 1. At most sample rows and sample_bytes of each class reach the driver."""
    marked = labels.filter(F.col(label).isNotNull() & (fold(key, 3) != 1)).groupBy(F.col(key).alias("_k")).agg((F.max(label) > 0).cast("int").alias("_y"))
    true = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [marked.filter(F.col("_y") == y).orderBy(F.xxhash64("_k", F.lit(11)), "_k").limit(sample) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("_d"), plain(f"`{text}`").alias("_t"))

    def of(chosen: DataFrame) -> DataFrame:  # 2 * sample bounds the broadcast
        found = texts.join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
        return found.groupBy("_k").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))

    sizes = of(first[0].union(first[1])).select("_k", "_y", F.octet_length("_t").alias("n"), F.xxhash64("_k", F.lit(11)).alias("h")).collect()
    room, chosen = [sample_bytes, sample_bytes], []
    for r in sorted(sizes, key=lambda r: (r["h"], r["_k"])):
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            chosen.append((r["_k"], r["_y"]))
    if not chosen:
        return fit([])
    kind = docs.schema[key].dataType.simpleString()
    # From an Arrow table: a list would be turned into rows by Python workers of the executors, which stay beside those that score.
    picked = docs.sparkSession.createDataFrame(pa.table({"_k": [k for k, _ in chosen], "_y": [y for _, y in chosen]}))
    rows = of(picked.select(F.col("_k").cast(kind).alias("_k"), F.col("_y").cast("int").alias("_y"))).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["_k"]).encode()), r["_k"]))
    return fit([(r["_t"], r["_y"]) for r in rows], (true.get(0, 0), true.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The columns of docs and the score (a column of that name is replaced)."""
    names = [c for c in docs.columns if c.lower() != name.lower()]
    mine = next((c for c in names if c.lower() == text.lower() and docs.schema[c].dataType == StringType()), None)  # carried already, so it is sent once
    raw = mine or fresh(docs, "_t")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [x for i in range(0, b.num_rows, ROWS) for x in m.scores([t or "" for t in b.column(raw).slice(i, ROWS).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(got, pa.float64())], names=[*names, name])

    kept_ = docs.select(*[F.col(f"`{n}`") for n in names], *([] if mine else [plain(f"`{text}`").alias(raw)]))
    return kept_.mapInArrow(run, kept_.select(*[F.col(f"`{n}`") for n in names]).schema.add(name, "double"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", enough: float = ENOUGH) -> DataFrame:
    """The documents that score below enough, with their own columns."""
    name = fresh(docs, "_score")
    scored = score(docs, train(docs, labels, key, text), text, name)
    return scored.filter(F.col(name) < enough).select(*[F.col(f"`{c}`") for c in docs.columns])
