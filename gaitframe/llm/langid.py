"""Language identification by character models.

For each language an interpolated Kneser-Ney model of character n-grams is learned from
the documents of the training fold; a text's language is the one with the lowest
cross-entropy a character. The score is the winner's share after a softmax of the
differences; ``rejected`` marks texts whose cross-entropy lies above the language's own
99.9th percentile. That is calibrated on a fifth of the training documents, which no
model learned from.

Null text, and text without a letter, is ``und`` with score 0, and so is everything when
nothing could be learned. Ties go to the first language by name. Repeated rows repeat;
extra columns are ignored; ids may be null (their fold is that of an empty text). The
driver holds the languages' names, and the values of one slice of n-grams at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm import charmodel as cm
from gaitframe.llm.shared import byte_slices, few, settle

#: Characters of a model's n-grams.
ORDER = 5
SCORES = "doc_id long, fold int, lang string, letter boolean, n_chars long, sums array<double>"


def fold(folds: int = 5):
    """0: held out; 1: calibrates; others: teach the models."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def _letters(sym: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Rows with a letter."""
    u, which = np.unique(sym, return_inverse=True)
    yes = np.array([chr(c).isalpha() for c in u], bool)[which]
    out = np.zeros(len(chars) - 1, bool)
    out[np.searchsorted(chars, np.flatnonzero(yes), "right") - 1] = True
    return out


def score(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[str], cm.Slices]:
    """Log probabilities of every document under every language (sums, by name), the names, and the models."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("fold"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    taught = F.when(F.col("fold") > 1, F.col("lang"))
    counts = cm.count_ngrams(slim.select(taught.alias("key"), "text"), lower=True, order=order)
    lev = cm.levels(counts, order)
    names = sorted(r["key"] for r in lev.where("k = 1").select("key").distinct().collect())  # a row a language
    col = F.posexplode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))
    asked = settle(counts.select("gram").distinct().select("gram", col.alias("col", "key")), "asked")
    table = cm.resolve(asked.select("key", "gram"), lev, modified=False, order=order)
    place = F.array_position(F.array(*map(F.lit, names or [""])), F.col("key")) - 1
    slices = cm.Slices(table.select(F.lit("").alias("salt"), "gram", place.cast("int").alias("col"), "logp"), max(len(names), 1), order)

    def make(shared, first):
        def rows(batches):
            for b in batches:
                for lo, hi, data, off in byte_slices(b.column(3)):
                    n = hi - lo
                    sym, chars = cm.symbols(data, off, lower=True)
                    sums = cm.score(shared.value, sym, chars, np.full(n, cm.salt_of(""), np.uint64), order)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                    mine = [c.slice(lo, n) for c in b.columns[:3]] + [pa.array(_letters(sym, chars)), pa.array(np.diff(chars))]
                    mine = mine if first else [pa.nulls(n, c.type) for c in mine]
                    yield pa.RecordBatch.from_arrays([b.column(4).slice(lo, n), *mine, lists], ["rid", "doc_id", "fold", "lang", "letter", "n_chars", "sums"])

        return rows

    return slices.over(slim, make, SCORES, "sums"), names, slices


def identify(docs: DataFrame, reject: float = 0.999, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected of every document."""
    scored, names, slices = score(docs, order)
    h = F.transform("sums", lambda x: -x / F.col("n_chars"))
    some = F.col("letter") & F.lit(bool(names))
    out = scored.withColumn("h", F.when(some, h)).withColumn("least", F.array_min("h"))
    # evidence grows with the text, as if every tenth character were independent
    shares = F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(-(x - F.col("least")) * (F.col("n_chars") / 10 + 1)))
    named = F.get(F.array(*map(F.lit, names or [""])), F.array_position("h", F.col("least")).cast("int") - 1)
    out = out.select(
        "doc_id", "fold", "lang",
        F.coalesce(named, F.lit("und")).alias("lang_pred"),
        F.coalesce(1 / shares, F.lit(0.0)).alias("score"),
        (F.col("least") / F.log(F.lit(2.0))).alias("bits"),
    )
    out = settle(out, "langid")
    slices.release()
    own = out.where("fold = 1 AND lang = lang_pred")
    limit = few(own.groupBy("lang_pred").agg(F.percentile_approx("bits", reject, 10_000).alias("most")))
    out = out.join(limit, "lang_pred", "left")
    return out.select("doc_id", (F.col("fold") == 0).alias("held_out"), "lang_pred", "score", "bits", F.coalesce(F.col("bits") > F.col("most"), F.lit(True)).alias("rejected"))
