"""Fill-in-middle documents: texts cut at two line ends and laid out in a new order.

A text is counted once, block after block: its units are lines with their line feed. On
the way a checkpoint is kept every ``every`` units, with the unit's number, its first byte
and its first code point. A cut at a unit is found by binary search among the checkpoints,
and a short scan from there (at most ``every`` units). So an index is a few numbers for
each ``every`` lines, whatever the text's length, and a text is never split into a list.

Draws depend on seed and id only, so reruns agree. Null text is empty, and an empty text
stays plain; so does one that holds a mark, as its output could not be read back. A null
id draws like an empty one. Repeated rows repeat; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.shared import byte_slices

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units between checkpoints.
EVERY = 64
_BLOCK = 1 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Checkpoints:
    """Places of every ``every``-th unit of a text, for cuts at any unit."""

    def __init__(self, data: np.ndarray, every: int = EVERY, block: int = _BLOCK):
        self.data, self.every = data, every
        units, points, at_byte, at_point = 0, 0, [0], [0]
        for lo in range(0, len(data), block):
            part = data[lo : lo + block]
            ends = np.flatnonzero(part == 10)  # a unit ends behind its line feed
            lead = (part & 0xC0) != 0x80
            # the ends in this block at which a multiple of ``every`` units is complete
            pick = ends[(-units - 1) % every :: every] + 1
            if len(pick):
                before = np.cumsum(lead)
                at_byte += (lo + pick).tolist()
                at_point += (points + before[pick - 1]).tolist()
            units += len(ends)
            points += int(np.count_nonzero(lead))
        if len(data) and data[-1] != 10:
            units += 1
        self.units, self.points = units, points
        self.at_byte, self.at_point = np.array(at_byte), np.array(at_point)
        self.at_unit = np.arange(len(at_byte)) * every

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which unit number ``unit`` starts (the end, beyond the last one)."""
        if unit >= self.units:
            return len(self.data), self.points
        k = int(np.searchsorted(self.at_unit, unit, "right")) - 1
        at, left = int(self.at_byte[k]), unit - int(self.at_unit[k])
        start, width = at, 4096
        while left:
            ends = np.flatnonzero(self.data[at : at + width] == 10)
            if len(ends) >= left:
                at, left = at + int(ends[left - 1]) + 1, 0
            else:
                at, left, width = at + width, left - len(ends), width * 2
        return at, int(self.at_point[k]) + int(np.count_nonzero((self.data[start:at] & 0xC0) != 0x80))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers below 2**32 from seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, every: int = EVERY, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    ``rate`` percent of the documents are laid out anew, of those ``spm`` percent with the
    suffix first (spm), the others with the prefix first (psm).
    """
    p, s, m = (x.encode() for x in marks)
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(seed, F.col("doc_id")), 1)])

    def rows(batches):
        for b in batches:
            draw = np.stack([c.to_numpy() for c in b.columns[2:]], 1) if b.num_rows else None
            for lo, hi, data, off in byte_slices(b.column(1)):
                n, form, chars, out = [], [], ([], []), []
                for i in range(hi - lo):
                    one = data[off[i] : off[i + 1]]
                    raw, h = one.tobytes(), draw[lo + i]
                    index = Checkpoints(one, every)
                    n.append(index.units)
                    if not raw or h[2] % 100 >= rate or any(x in raw for x in (p, s, m)):
                        form.append("plain")
                        chars[0].append(None)
                        chars[1].append(None)
                        out.append(raw)
                        continue
                    u, v = sorted(int(x) % (index.units + 1) for x in h[:2])
                    (a, a_point), (z, z_point) = index.cut(u), index.cut(v)
                    form.append("spm" if h[3] % 100 < spm else "psm")
                    chars[0].append(a_point)
                    chars[1].append(z_point - a_point)
                    first, last = p + raw[:a], s + raw[z:]
                    out.append((last + first if form[-1] == "spm" else first + last) + m + raw[a:z])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form, pa.string()), *(pa.array(c, pa.int64()) for c in chars), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return laid.mapInArrow(rows, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A text with a mark is plain, so each mark is met once."""
    p, s, m = (F.lit(x) for x in marks)

    def between(start: Column | None, end: Column | None) -> Column:
        at = F.lit(1) if start is None else F.instr(output, start) + F.length(start)
        return F.substring(output, at, (F.instr(output, end) if end is not None else F.length(output) + 1) - at)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
