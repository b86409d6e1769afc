"""Runs of a period in the words of a text, by factors and the runs that cross their borders.

1. Words are numbered. Each word of a run of at least ``least`` words and ``times`` periods
   lies in a string of k = least - least / times words that the text holds twice, so only
   stretches of words under such strings go on (in ordinary text: none).
2. A suffix automaton of the stretch gives its factors: each is the longest string that
   also starts earlier, or a new word.
3. A run that meets a border of two factors reaches left of it by less than twice the
   factor before and once the factor after. For all periods at once, common prefixes and
   suffixes of what lies left and right of the border give those runs.
4. Any other run lies within a factor, and is one of those at the factor's earlier place,
   moved. Runs are kept by their end for that.

Time and memory follow the words of the longest text (some 60 bytes a word of a stretch,
beside the words). Null text has no words. Repeated rows repeat; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.shared import byte_slices, mix

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, starts array<long>, lengths array<long>, periods array<long>"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Automaton:
    """The suffix automaton of a list of numbers. Most states have one way on, held in arrays; others have a dict."""

    def __init__(self, s: list[int]):
        n = 2 * len(s) + 2
        self.sym, self.to, self.first_end = (array("i", [-1]) * n for _ in range(3))
        self.more: dict[int, dict[int, int]] = {0: {}}
        sym, to, first_end, more = self.sym, self.to, self.first_end, self.more
        link, length = array("i", [-1]) * n, array("i", [0]) * n
        size, last = 1, 0
        for i, c in enumerate(s):
            cur, size = size, size + 1
            length[cur] = length[last] + 1
            first_end[cur] = i
            p, q = last, -1
            while p >= 0:
                if sym[p] == c:
                    q = to[p]
                    break
                ways = more.get(p)
                if ways is None:
                    if sym[p] < 0:
                        sym[p], to[p] = c, cur
                    else:
                        more[p] = {c: cur}
                elif c in ways:
                    q = ways[c]
                    break
                else:
                    ways[c] = cur
                p = link[p]
            if q < 0:
                link[cur] = 0
            elif length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin, size = size, size + 1
                length[twin], link[twin], first_end[twin] = length[p] + 1, link[q], first_end[q]
                sym[twin], to[twin] = sym[q], to[q]
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if sym[p] == c:
                        if to[p] != q:
                            break
                        to[p] = twin
                    else:
                        ways = more.get(p)
                        if ways is None or ways.get(c) != q:
                            break
                        ways[c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
            last = cur

    def factors(self, s: list[int]) -> list[tuple[int, int, int]]:
        """start, end and an earlier start (-1: a new word) of each factor."""
        sym, to, first_end, more = self.sym, self.to, self.first_end, self.more
        out, i, n = [], 0, len(s)
        while i < n:
            state, at = 0, i
            while at < n:
                c = s[at]
                nxt = to[state] if sym[state] == c else more.get(state, {}).get(c, -1)
                if nxt < 0 or first_end[nxt] >= at:
                    break
                state, at = nxt, at + 1
            out.append((i, at, first_end[state] + 1 - (at - i)) if at > i else (i, i + 1, -1))
            i = max(at, i + 1)
        return out


def prefixes(s: list[int]) -> list[int]:
    """For each place, the length of the longest string there that also starts ``s``."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def crossing(s: list[int], border: int, left: int, right: int, least: int, times: int):
    """(start, end, period) of repetitions in s[left:right] that meet the border; not always whole runs."""
    t, v = s[left:border], s[border:right]
    nt, nv = len(t), len(v)
    # periods whose second copy lies behind the border: how far they go on and back
    on = prefixes(v)
    back = prefixes(t[::-1] + [-1] + v[::-1] + t[::-1])
    for p in range(1, nv + 1):
        ahead = on[p] if p < nv else 0
        behind = back[nt + 1 + nv - p]
        n = behind + ahead + p
        if n >= least and n >= times * p:
            yield border - behind, border + p + ahead, p
    # periods whose first copy lies before it
    on = prefixes(v + [-1] + t + v)
    back = prefixes(t[::-1])
    for p in range(1, nt + 1):
        behind = back[p] if p < nt else 0
        ahead = on[nv + 1 + nt - p]
        n = behind + ahead + p
        if n >= least and n >= times * p:
            yield border - p - behind, border + ahead, p


def runs_of(s: list[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of a list of numbers (none negative), by start and period.

    A run has its smallest period, at least ``least`` places and ``times`` (at least 2) periods.
    """
    n = len(s)
    if n < least:
        return []
    factors = Automaton(s).factors(s)
    found: dict[tuple[int, int], int] = {}
    ends: list[tuple[int, int]] = []  # (end, start) of the runs that are found

    def keep(a: int, z: int, p: int) -> bool:
        new = (a, z) not in found
        if new or p < found[a, z]:  # a whole number of periods is met as well
            found[a, z] = p
        return new

    before = 0
    for lo, hi, source in [*factors, (n, n, -1)]:
        size = hi - lo
        if 2 * (before + size) >= least:
            # a run that ends in this factor lies in this range; one that goes on is met again later
            for a, z, p in crossing(s, lo, max(0, lo - 2 * before - size), hi, least, times):
                while a > 0 and s[a - 1] == s[a - 1 + p]:
                    a -= 1
                while z < n and s[z] == s[z - p]:
                    z += 1
                if keep(a, z, p):
                    ends.append((z, a))
        if source >= 0 and size >= least:
            # runs strictly inside the factor, from its earlier place; that may overlap it, so copies are copied too
            ends.sort()
            ahead = lo - source
            queue = [(z, a) for z, a in ends[bisect_left(ends, (source + least, 0)) : bisect_left(ends, (source + size, 0))] if a > source]
            while queue:
                z, a = heappop(queue)
                if keep(a + ahead, z + ahead, found[a, z]):
                    ends.append((z + ahead, a + ahead))
                    if z + ahead < source + size:
                        heappush(queue, ends[-1])
        before = size
    return sorted((a, z, p) for (a, z), p in found.items())


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of words that lie under strings of k words that are there twice; only these can hold runs."""
    k = max(1, least - -(-least // times))
    if len(ids) < least:
        return []
    key = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    gram = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        gram = gram * np.uint64(0xD1342543DE82EF95) + key[i : i + len(gram)]
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(len(gram) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.flatnonzero(np.diff(np.r_[False, twice]))
    out: list[tuple[int, int]] = []
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        z += k - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return [(a, z) for a, z in out if z - a >= least]


def _one(words: list[bytes], least: int, times: int):
    """Runs as (start, length, period), and the numbers of dropped words as a mask (None: none dropped)."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    runs = []
    for a, z in stretches(np.array(ids, np.int64), least, times):
        runs += [(a + lo, hi - lo, p) for lo, hi, p in runs_of(ids[a:z], least, times)]
    if not runs:
        return runs, None
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return runs, gone


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Runs of every document: all of them as lists, the one of the greatest exponent, and what is left without repeats.

    The greatest exponent is exact (ties: smallest start, then period). What is left is all
    words but those that follow the first period of a run, joined by one space.
    """

    def rows(batches):
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, off in byte_slices(b.column(1)):
                raw, out = data.tobytes(), []
                for i in range(hi - lo):
                    words = raw[off[i] : off[i + 1]].split()  # at space and \x09-\x0D, as of bytes
                    runs, gone = _one(words, least, times)
                    best = None
                    for r in runs:
                        if best is None or r[1] * best[2] > best[1] * r[2]:
                            best = r
                    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
                    kept = words if gone is None else [words[j] for j in np.flatnonzero(~gone).tolist()]
                    rest = hashlib.sha256(b" ".join(kept))
                    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    out.append((len(words), len(runs), *shown, listed.hexdigest(), rest.hexdigest(), *([r[j] for r in runs] for j in range(3))))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)
