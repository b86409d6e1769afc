"""Quality rules: stated text rules, then perplexity bands by language.

Spark counts character n-grams of all documents by ``lang`` (null: a language of its own)
and by the half that a hash of the text puts them in; a modified Kneser-Ney model of each
half scores the documents of the other, so no document is scored by a model that saw its
text. A language's band is its median log perplexity plus and minus a number of robust
deviations (from the quartiles of all its documents that pass the stated rules); outside
lies junk of too high or boilerplate of too low perplexity.

Null text has no words and fails. A language whose documents all lie in one half has no
model for them: all have the same perplexity and none is rejected for it. Repeated rows
repeat. Extra columns are ignored by ``judge`` and kept by ``keep_good``, whatever their
names. A text that is longer than a slice is handled whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gaitframe.llm import charmodel as cm
from gaitframe.llm.shared import Hashes, byte_slices, few, mix, settle, sums_by_row, words_of

NO_LANG = "\x00none"
#: Characters of a text at which chance in the text varies as much as texts do.
SPREAD = 1000
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, sums array<double>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether (group, value) stands elsewhere too, and whether earlier."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    again, earlier = np.zeros(len(v), bool), np.zeros(len(v), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    earlier[order[1:][same]] = True  # lexsort is stable
    return again, earlier


def measure(data: np.ndarray, off: np.ndarray, window: int = 8) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a run."""
    n = len(off) - 1
    start, end, row = words_of(data, off)
    h = Hashes(data)
    n_words = np.bincount(row, minlength=n)
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, start, 1)
    np.add.at(solid, end, -1)
    inside = np.cumsum(solid[:-1]).astype(bool)
    chars = sums_by_row(inside & ((data & 0xC0) != 0x80), off)
    signs = sums_by_row(_SYMBOL[data], off)
    # lines with a word
    breaks = np.flatnonzero(data == 10)
    first = np.unique(np.r_[breaks + 1, off[:-1]])
    first = first[first < len(data)]
    row_end = off[np.searchsorted(off, first, "right")]
    last = np.minimum(np.r_[breaks, len(data)][np.searchsorted(breaks, first)], row_end)
    full = np.searchsorted(start, last) > np.searchsorted(start, first)
    first, last = first[full], last[full]
    line_row = np.searchsorted(off, first, "right") - 1
    _, earlier = _repeats(line_row, mix(h.of(first, last) + (last - first).astype(np.uint64)))
    dup_lines = np.bincount(line_row[earlier], minlength=n)
    # words in windows that stand twice
    repeated = np.zeros(n, np.int64)
    if len(start) >= window:
        wh = mix(h.of(start, end) + (end - start).astype(np.uint64))
        k = len(start) - window + 1
        v = np.zeros(k, np.uint64)
        for j in range(window):
            v = v * np.uint64(0x100000001B3) + wh[j : j + k]
        whole = np.flatnonzero(row[:k] == row[window - 1 :])
        again, _ = _repeats(row[whole], v[whole])
        step = np.zeros(len(start) + 1, np.int64)
        np.add.at(step, whole[again], 1)
        np.add.at(step, whole[again] + window, -1)
        repeated = np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=n)
    return n_words, chars, signs, dup_lines, repeated


def _half(text):
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("string")


def _score_key(lang: str | None, half: str) -> str:
    return f"{NO_LANG if lang is None else lang}\x00{half}"


def _measured(docs: DataFrame, names: list[str], lower: bool = False) -> DataFrame:
    """The named columns of ``docs`` as c0, c1, ... and the stated measures with the log perplexity a character; written.

    A task gets each text once: a text that is to be kept is given back from what was scored.
    """
    types = [docs.schema[c].dataType for c in names]
    again = [c.lower() == "text" and isinstance(t, StringType) for c, t in zip(names, types, strict=True)]
    text, lang = F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    other = F.when(_half(text) == "0", "1").otherwise("0")
    counts = cm.count_ngrams(docs.select(F.concat(lang, F.lit("\x00"), _half(text)).alias("key"), text.alias("text")), lower)
    # the n-grams of one half are looked up in the model of the other
    flip = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.when(F.col("key").endswith("0"), "1").otherwise("0"))
    asked = settle(counts.select(flip.alias("key"), "gram"), "asked")
    table = cm.resolve(asked, cm.levels(counts), modified=True)
    slices = cm.Slices(table.select(F.col("key").alias("salt"), "gram", F.lit(0).alias("col"), "logp"), 1)
    kept = ", ".join(f"c{i} {t.simpleString()}" for i, t in enumerate(types))

    def make(shared, first):
        def rows(batches):
            for b in batches:
                keys, texts = b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2)
                salt = {k: cm.salt_of(k) for k in set(keys)}
                for lo, hi, data, off in byte_slices(texts):
                    sym, chars = cm.symbols(data, off, lower)
                    sums = cm.score(shared.value, sym, chars, np.array([salt[k] for k in keys[lo:hi]], np.uint64))
                    some = [*map(pa.array, measure(data, off)), pa.array(np.diff(chars))] if first else [pa.nulls(hi - lo, pa.int64())] * 6
                    rest = iter(b.columns)
                    mine = [texts if a else next(rest) for a in again]
                    mine = [c.slice(lo, hi - lo) if first else pa.nulls(hi - lo, c.type) for c in mine]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1), pa.int32()), pa.array(sums.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(b.num_columns - 1).slice(lo, hi - lo), *mine, *some, lists], ["rid", *(f"c{i}" for i in range(len(mine))), *(x.split()[0] for x in MEASURES.split(", "))])

        return rows

    laid = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if not again[i]], F.concat(lang, F.lit("\x00"), other).alias("score_key"), text.alias("score_text"))
    out = slices.over(laid, make, ", ".join(x for x in (kept, MEASURES) if x), "sums")
    ppl = -F.try_divide(F.col("sums")[0], F.col("n_chars"))
    out = settle(out.withColumn("log_ppl", F.coalesce(ppl, F.lit(0.0))).drop("sums"), "quality")
    slices.release()
    return out


def measures(docs: DataFrame, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, the stated measures and base_failed of every document, without any model."""
    names = ["doc_id", *(x.split()[0] for x in MEASURES.split(", ")[:5])]

    def rows(batches):
        for b in batches:
            for lo, hi, data, off in byte_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, measure(data, off))], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(rows, ", ".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))


def _judged(docs: DataFrame, names: list[str], low: float, high: float, min_words: int, max_repeat: int) -> DataFrame:
    """What ``_measured`` gives, with base_failed and kept; the names hold lang."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    lang = F.coalesce(F.col(f"c{names.index('lang')}").cast("string"), F.lit(NO_LANG))
    m = _measured(docs, names).withColumns({"base_failed": failed, "band_key": lang})
    band = m.where("NOT base_failed").groupBy("band_key").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000).alias("q"))
    width = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.01))
    band = few(band.select("band_key", F.col("q")[1].alias("middle"), width.alias("width")))
    most = F.col("width") * F.sqrt(1 + F.try_divide(F.lit(SPREAD), F.col("n_chars")))
    inside = F.col("log_ppl").between(F.col("middle") - low * most, F.col("middle") + high * most)
    return m.join(band, "band_key", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def judge(docs: DataFrame, low: float = 5.0, high: float = 5.0, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, lang, measures, log_ppl, base_failed and kept of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = _judged(slim, ["doc_id", "lang"], low, high, min_words, max_repeat)
    return out.select(F.col("c0").alias("doc_id"), F.col("c1").alias("lang"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "base_failed", "kept")


def keep_good(docs: DataFrame, low: float = 5.0, high: float = 5.0, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """The documents that pass, with their columns as they are; texts are written once and never shuffled."""
    out = _judged(docs, docs.columns, low, high, min_words, max_repeat).where("kept")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
