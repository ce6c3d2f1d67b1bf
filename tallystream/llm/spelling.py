"""Spelling variants of words, by an even-partition pigeonhole join.

words counts the distinct words of all texts: each task folds the runs of letters in stretches of
SLICE bytes to partial counts, which a grouped sum merges.

links finds all pairs of words one edit apart. A word of length D is cut into two even segments (their
places hang on D alone); one edit leaves one of them whole. So each word is indexed under both its
segments, and probes those of its own length and, for an inserted letter, of length D - 1: the first
segment at the same place, the second one shifted to the word's end. Words that meet under a segment
are candidates, and one edit is verified on them, in the join itself.

A segment that very many words share (over HOT) is not joined. Its words go to the next round, where
the part that they needn't share, the other segment, is cut into two even halves, and they are keyed by
the segment with either half. A single edit leaves one half whole, so nothing is lost; each round halves
what is open, and once it is a single letter a group holds no more words than there are letters. So no
group is large, whatever the vocabulary, and there are about log2(longest word) rounds at most, as
many as hot groups last.

variants gives each word its form, the most frequent near word if that is at least RATIO times as
frequent, and its root, by pointer doubling over the forms: counts grow by RATIO along them, so chains
are short and have no cycles. Words that have reached their root leave the rounds.

Defined results: a NULL text has no words, a NULL id is spelled as an empty one; repeated rows count
each; text that is empty or without letters gives none; ties go to the smaller word by code points; an
empty table gives an empty result. Whole texts are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crc
from .common import kept, plain, slices

LEAST_LETTERS, LEAST_COUNT, RATIO, TYPO = 5, 3, 2, 97
SLICE, HOT = 4 << 20, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # the lead byte of all of U+00C0 to U+00FF


def _without(word: bytes, place: int) -> str:
    s = word.decode()
    return s[:place] + s[place + 1 :]


def counted(keys: list[str], texts: pa.Array, least: int = LEAST_LETTERS, typo: int | None = TYPO) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts and their counts. If typo divides the CRC-32 of <key>:<word>, the word loses the letter at CRC % length."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = (edges - edges[0]).astype(np.int64)
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lead = data == _LEAD
    kept_ = _LETTER[data] | lead
    kept_[1:] |= lead[:-1]
    bounds = np.zeros(len(data) + 1, bool)  # where a run may begin anew
    bounds[edges] = True
    first = np.flatnonzero(kept_ & (~np.r_[False, kept_[:-1]] | bounds[:-1]))
    last = np.flatnonzero(kept_ & (~np.r_[kept_[1:], False] | bounds[1:])) + 1
    letters = np.r_[0, np.cumsum(kept_ & ~lead)]  # a character of two bytes counts at its second one
    long = np.flatnonzero(letters[last] - letters[first] >= least)
    first, last = first[long], last[long]
    size = last - first
    offsets = np.r_[0, np.cumsum(size)]
    folded = _LOWER[data][np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
    enc = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(folded)).dictionary_encode()
    which, doc = enc.indices.to_numpy().astype(np.int64), np.searchsorted(edges, first, side="right") - 1
    n = np.bincount(which, minlength=len(enc.dictionary))
    if typo is None or not len(which):
        return enc.dictionary, n
    raw = enc.dictionary.cast(pa.binary()).to_pylist()
    pair, times = np.unique(doc * len(raw) + which, return_counts=True)
    doc, word = pair // len(raw), pair % len(raw)
    ahead = crc.of_each([f"{k}:".encode() for k in keys])
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    h = crc.joined(ahead[doc], crc.of_each(raw)[word], length[word])
    hit = np.flatnonzero(h % np.uint32(typo) == 0)
    np.subtract.at(n, word[hit], times[hit])
    chars = pc.utf8_length(enc.dictionary).to_numpy().astype(np.int64)
    less = [_without(raw[w], int(x) % int(chars[w])) for w, x in zip(word[hit].tolist(), h[hit].tolist())]
    on = np.array([i for i, w in enumerate(less) if len(w) >= least], np.int64)
    names = pa.concat_arrays([enc.dictionary, pa.array([less[i] for i in on], pa.string())])
    n = np.concatenate([n, times[hit][on]])
    return names.filter(pa.array(n > 0)), n[n > 0]


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo: int | None = TYPO) -> DataFrame:
    """(word, n) of the words with at least so many letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, 1):
            names, n = counted(part.column(0).to_pylist(), part.column(1), least, typo)
            yield pa.RecordBatch.from_arrays([names, pa.array(n.astype(np.int64))], names=["word", "n"])

    base = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"), plain(f"`{text}`").alias("_t"))
    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _key(length: Column, low: Column, high: Column, extra: Column) -> Column:
    """Names what a word shares with others under a segment: all but the open part, from low to high in an indexed word (extra more in a probe)."""
    ahead, behind = F.substring("word", F.lit(1), low), F.substring("word", high + extra + 1, length - high)
    return F.xxhash64(length, low, high, ahead, behind)


def _halved(rows: DataFrame) -> DataFrame:
    """Two rows for each: either even half of the open part stays open, and the other is shared."""
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    parts = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    cut = rows.withColumn("_p", F.explode(parts)).select("word", "n", "size", "extra", "_p.low", "_p.high")
    return cut.withColumn("k", _key(F.col("size"), F.col("low"), F.col("high"), F.col("extra")))


def links(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, near, n, near_n): each pair of words that differ by one inserted, deleted or replaced code point, once, from (word, n) with distinct words."""
    length = F.length("word")
    sizes = F.array(F.struct(length.alias("size"), F.lit(0).alias("extra")), F.struct((length - 1).alias("size"), F.lit(1).alias("extra")))
    rows = vocabulary.withColumn("_s", F.explode(sizes)).select("word", "n", "_s.size", "_s.extra").filter("size > 0")
    rows = kept(_halved(rows.withColumns({"low": F.lit(0), "high": F.col("size")})))
    found: list[DataFrame] = []
    while True:
        # A group's work is its indexed words times all its words; the hot ones with something left to share are cut on.
        groups = rows.groupBy(F.col("k").alias("_k")).agg(F.count(F.when(F.col("extra") == 0, F.lit(1))).alias("_own"), F.count(F.lit(1)).alias("_all"), F.max(F.col("high") - F.col("low")).alias("_open"))
        paired = groups.filter("_own > 0 AND _all > 1")
        is_hot = (F.col("_own") * F.col("_all") > hot * hot) & (F.col("_open") > 1)
        dealt = kept(rows.join(paired.select("_k", is_hot.alias("_hot")), F.col("k") == F.col("_k")).drop("_k"))
        small = dealt.filter("NOT _hot")
        left = small.filter("extra = 0").select(F.col("k").alias("_k"), F.col("word").alias("_w"), F.col("n").alias("_n"))
        near = (F.col("extra") == 1) | (F.col("word") > F.col("_w"))
        met = small.join(left, (F.col("k") == F.col("_k")) & near & (F.levenshtein("word", "_w", 1) == 1))
        found.append(met.select(F.col("_w").alias("word"), F.col("word").alias("near"), F.col("_n").alias("n"), F.col("n").alias("near_n")))
        if dealt.filter("_hot").isEmpty():
            break
        rows = kept(_halved(dealt.filter("_hot").drop("_hot")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()  # a pair may share both segments, or halves in several rounds


def variants(vocabulary: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n)."""
    vocabulary = kept(vocabulary)
    pairs = links(vocabulary, hot)
    both = F.explode(F.array(F.struct("word", F.col("near").alias("near"), F.col("near_n").alias("near_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = pairs.select(both.alias("x")).groupBy(F.col("x.word").alias("_w")).agg(F.min(F.struct((-F.col("x.near_n")).alias("less"), F.col("x.near").alias("near"))).alias("best"), F.count(F.lit(1)).alias("n_near"))
    with_near = vocabulary.join(best, F.col("word") == F.col("_w"), "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = kept(with_near.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    pending = ahead = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    done: DataFrame | None = None
    while True:
        # A word whose root so far has no form is done; each other one takes its root's.
        jump = ahead.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        step = kept(pending.join(jump, F.col("root") == F.col("_w"), "left").select("word", "root", "_next"))
        ended = step.filter("_next IS NULL").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        pending = step.filter("_next IS NOT NULL").select("word", F.col("_next").alias("root"))
        if pending.isEmpty():
            break
        ahead = pending.unionByName(done)
    roots = done.select(F.col("word").alias("_w"), "root")
    return found.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
