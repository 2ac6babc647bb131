"""Removal of repeated passages by suffix arrays with two-stage sorting.

A byte goes when it lies in a ``length``-byte window that also starts earlier
(smaller document, or same document and earlier start).

Sharding. Each window has an anchor: the k-byte string of least hash in it, so
equal windows have equal anchors. Consecutive windows with the same anchor
position form a fragment (the bytes from the first window's start to the last
one's end), and every window is in exactly one fragment. Windows can only
repeat if their anchor does. Hence:

1. One scan lists every fragment's place, anchor hash and content hash.
2. Anchors that occur once are dropped (counted by a partial aggregate).
3. Equal fragments: all but the first are repeats as a whole.
4. Different fragments of the same anchor are fetched. An anchor with more
   than ``MAX_FRAGMENTS`` of them (a common line in ever new contexts) is
   refined by content: a window that holds the anchor has at least half of
   its other bytes on one side of it, so the fragment is split into the
   windows with more to the right and those with more to the left, and the
   anchor grows by these bytes. Equal windows get equal grown anchors. Steps 2
   and 3 follow again, until no anchor is too common; a fragment ends as a
   single window at the latest, when all that are left are equal. So no group
   is unbounded, no window is left out, and each round at most doubles rows.
5. Fragments are sorted into shards by anchor; a shard's suffix array is built
   by two-stage sorting, and equal windows are neighbours with a common prefix
   of at least ``length``.
6. Spans meet their documents, which are cut.

Two-stage sorting: only suffixes smaller than their successors are sorted
directly (by their first bytes); all others are induced by scanning the
buckets of first bytes in order.

Defined results: null reads as empty. Texts shorter than ``length`` keep all.
Rows that repeat a document (doc_id and text) are one document: they lose the
same bytes, not each other's. A null doc_id orders last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, id_or_null, map_arrow, small_batches

LENGTH = 100
ANCHOR = 32              # bytes, a power of two
MAX_FRAGMENTS = 8_000    # different fragments of one anchor
SHARD_BYTES = 512 * 1024
_CHUNK = 1 << 20         # windows looked at at a time
_FENCE = 0xFF            # never occurs in UTF-8


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def anchors(data: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every window's anchor; the leftmost of equals."""
    h, step, power = data.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while step < k:
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % 2**64
        step *= 2
    low = _mix(h)
    at = np.arange(len(low), dtype=np.int64)
    w, have = length - k + 1, 1
    while have < w:
        step = min(have, w - have)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        have += step
    return low, at


def fragments(texts: list[bytes], length: int = LENGTH, k: int = ANCHOR):
    """(text number, first window, windows, anchor hash) of all fragments, as arrays."""
    out: list[tuple[np.ndarray, ...]] = []
    todo, size = [], 0

    def work():
        data = np.frombuffer(b"".join(texts[j][s:s + n + length - 1] for j, s, n in todo), np.uint8)
        low, at = anchors(data, length, k)
        n = np.array([x[2] for x in todo], np.int64)
        ends = np.cumsum(n + length - 1)
        starts = ends - (n + length - 1)
        number = np.repeat(np.arange(len(todo)), n)  # windows that lie in one text
        place = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
        window = starts[number] + place
        anchor = at[window]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1]))))
        count = np.diff(np.append(new, len(number)))
        part = number[new]
        out.append((np.array([x[0] for x in todo])[part], place[new] + np.array([x[1] for x in todo])[part], count,
                    low[window[new]].view(np.int64)))
    for j, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, _CHUNK):
            n = min(_CHUNK, len(t) - length + 1 - s)
            if size and size + n > _CHUNK:
                work()
                todo, size = [], 0
            todo.append((j, s, n))
            size += n + length - 1
    if todo:
        work()
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of ``t`` (uint8) ordered by their suffixes' first ``depth`` bytes."""
    n = len(t)
    # type: True if the suffix is smaller than its successor; equal bytes take the next one's type
    differs = np.flatnonzero(np.append(t[:-1] != t[1:], True))
    nxt = differs[np.searchsorted(differs, np.arange(n))]
    smaller = np.append(t, np.uint8(0))[nxt + 1] > t
    smaller[nxt == n - 1] = False
    # first stage: sort these directly
    pick = np.flatnonzero(smaller).astype(np.int32)
    pick = pick[np.argsort(t[pick], kind="stable")]
    cuts = np.searchsorted(t[pick], np.arange(257))
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(depth, np.uint8)]), depth)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # one bucket's keys at a time
        if b - a > 1:
            keys = np.ascontiguousarray(wide[pick[a:b]]).view(f"S{depth}").ravel()
            pick[a:b] = pick[a:b][np.argsort(keys, kind="stable")]
    # second stage: each suffix in order puts its larger predecessor next in the predecessor's bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[t[n - 1]].append(np.array([n - 1], np.int32))  # before the end comes nothing smaller
    out = []
    for c in range(256):
        induced = waiting[c]
        k = 0
        while k < len(induced):
            p = induced[k] - 1
            p = p[p >= 0]
            p = p[(t[p] == c) & ~smaller[p]]
            if len(p):
                induced.append(p)
            k += 1
        bucket = np.concatenate([*induced, pick[cuts[c]:cuts[c + 1]]]) if induced else pick[cuts[c]:cuts[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket - 1
        p = p[p >= 0]
        p = p[~smaller[p] & (t[p] > c)]
        if len(p):
            first = t[p]
            order = np.argsort(first, kind="stable")
            p, first = p[order], first[order]
            edge = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(edge, np.append(edge[1:], len(p)), strict=True):
                waiting[first[a]].append(p[a:b])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], up to ``most``."""
    lcp = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(most):
        if not len(live):
            break
        live = live[t[a[live] + k] == t[b[live] + k]]
        lcp[live] = k + 1
    return lcp


def first_windows(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fragments in corpus order: (fragment, offset, repeats) of every
    window; ``repeats`` where the window also starts earlier."""
    fence = bytes([_FENCE])
    t = np.frombuffer(fence.join(parts) + fence, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    n = sizes - length + 1
    number = np.repeat(np.arange(len(parts)), n)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
    window = np.full(len(t), -1, np.int64)
    window[starts[number] + offset] = np.arange(len(number))
    sa = suffix_array(t, length)
    sa = sa[window[sa] >= 0]
    same = common_prefix(t, sa[:-1], sa[1:], length) >= length
    group = np.cumsum(np.concatenate(([True], ~same))) - 1
    low = np.full(group[-1] + 1 if len(group) else 0, len(t), np.int64)
    np.minimum.at(low, group, sa)
    repeats = np.zeros(len(number), bool)
    repeats[window[sa]] = sa != low[group]
    return number, offset, repeats


def places(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h, f, key, a, n): anchor hash, content hash, and windows [a, a + n) of every fragment."""
    def run(batch):
        d, hk = (np.asarray(batch.column(i).to_numpy()) for i in (0, 1))
        texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 4 * _CHUNK):
                size += len(texts[upto])
                upto += 1
            j, a, n, h = fragments(texts[at:upto], length, k)
            j = j + at
            full = xxhash.xxh3_64_intdigest
            f = np.array([full(texts[x][s:e]) for x, s, e in zip(j.tolist(), a.tolist(), (a + n + length - 1).tolist(), strict=True)],
                         np.uint64).view(np.int64)
            yield {"h": h, "f": f, KEY_D: d[j], KEY_H: hk[j], "a": a, "n": n.astype(np.int32)}
            at = upto
    return map_arrow(doc_texts(docs), run, f"h long, f long, {KEY_D} long, {KEY_H} long, a long, n int")


_PART = f"h long, f long, {KEY_D} long, {KEY_H} long, a long, part binary, core int, size int"
_PART_COLUMNS = ["h", "f", *KEYS, "a", "part", "core", "size"]


def _fetched(docs: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """``wanted(h, f, key, a, n)`` with the fragments' bytes; ``core`` and
    ``size`` say where in them the anchor lies."""
    per_doc = wanted.groupBy(*KEYS).agg(F.collect_set(F.struct("h", "f", "a", "n")).alias("parts"))

    def run(batch):
        for d, hk, text, parts in zip(*(batch.column(i) for i in range(4)), strict=True):
            raw, d, hk, parts = text.as_py().encode("utf-8", "surrogatepass"), d.as_py(), hk.as_py(), parts.as_py()
            yield {"h": [p["h"] for p in parts], "f": [p["f"] for p in parts], KEY_D: [d] * len(parts),
                   KEY_H: [hk] * len(parts), "a": [p["a"] for p in parts],
                   "part": [raw[p["a"]:p["a"] + p["n"] + length - 1] for p in parts],
                   "core": [-1] * len(parts), "size": [k] * len(parts)}
    return map_arrow(doc_texts(docs).join(per_doc, KEYS).select(*KEYS, "text", "parts"), run, _PART)


def grown(part: bytes, core: int, size: int, length: int) -> list[tuple[int, bytes, int, int, bytes]]:
    """A fragment split by the side on which its windows have more bytes:
    (offset, bytes, core, size, core bytes) with the core grown to that side."""
    rest, n = length - size, len(part) - length + 1
    right = -(-rest // 2)
    left = rest - right + 1
    edge = core - rest + right  # windows from here on have at least `right` bytes behind the core
    out = []
    for lo, hi, start, more in ((max(0, edge), n, core, right), (0, min(n, edge), core - left, left)):
        if lo < hi:
            end = start + size + more
            out.append((lo, part[lo:hi - 1 + length], start - lo, size + more, part[start:end]))
    return out


def _refined(hot: DataFrame, length: int, k: int) -> DataFrame:
    def run(batch):
        out = {c: [] for c in _PART_COLUMNS}
        for h, _, d, hk, a, part, core, size in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if core < 0:
                core = int(anchors(np.frombuffer(part[:length], np.uint8), length, k)[1][0])
            for at, sub, c, z, grew in grown(part, core, size, length):
                name = h.to_bytes(8, "little", signed=True) + z.to_bytes(4, "little") + bytes([c == core - at]) + grew
                for col, v in zip(_PART_COLUMNS, (int.from_bytes(xxhash.xxh3_64_digest(name), "little", signed=True),
                                                  int.from_bytes(xxhash.xxh3_64_digest(sub), "little", signed=True),
                                                  d, hk, a + at, sub, c, z), strict=True):
                    out[col].append(v)
        return out
    return map_arrow(hot.select(*_PART_COLUMNS), run, _PART)


def _not_too_common(parts: DataFrame, scratch: Scratch, length: int, k: int) -> tuple[DataFrame, DataFrame | None]:
    """``parts`` with every too common anchor refined, and the spans of
    fragments that turned out equal on the way."""
    spans, turn = None, 0
    while True:
        hot = scratch.save(parts.groupBy("h").count().where(F.col("count") > MAX_FRAGMENTS).select("h"), f"hot{turn}")
        if hot.isEmpty():
            return parts, spans
        fine = scratch.save(_refined(parts.join(hot, "h"), length, k), f"fine{turn}")
        pos = F.struct(*KEYS, "a")
        first = scratch.save(fine.groupBy("h", "f").agg(F.min(pos).alias("first")), f"first{turn}")
        mixed = first.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
        kept = (fine.join(first, ["h", "f"]).where(pos == F.col("first")).join(mixed, "h", "left_semi").select(*_PART_COLUMNS))
        again = fine.join(first, ["h", "f"]).where(pos != F.col("first")).select(
            *KEYS, F.col("a").alias("s"), (F.col("a") + F.octet_length("part")).alias("e"))
        again = scratch.save(again, f"again{turn}")
        spans = again if spans is None else spans.unionByName(again)
        cold = parts.join(hot, "h", "left_anti").select(*_PART_COLUMNS)
        turn += 1
        parts = scratch.save(cold.unionByName(kept), f"parts{turn}")
        scratch.drop(f"fine{turn - 1}", f"first{turn - 1}", f"parts{turn - 1}")


def _sorted_shards(parts: DataFrame, length: int) -> DataFrame:
    """Spans (key, s, e) of windows that repeat within their shard."""
    names = (KEY_D, KEY_H, "s", "e")

    def solve(rows):
        rows = sorted({(r[1], r[2], r[3], r[4]): r for r in rows}.values(), key=lambda r: r[1:4])  # corpus order
        number, offset, repeats = first_windows([r[4] for r in rows], length)
        out = {c: [] for c in names}
        hit = np.flatnonzero(repeats)
        if len(hit):
            new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(number[hit]) > 0)))
            first = hit[new]
            last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                _, d, hk, a, _ = rows[number[i]]
                for c, v in zip(names, (d, hk, a + int(offset[i]), a + int(offset[j]) + length), strict=True):
                    out[c].append(v)
        return out

    def run(batches):
        import pyarrow as pa

        arrow = pa.schema([(c, pa.int64()) for c in names])
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if r[0] != last and size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pydict(solve(rows), schema=arrow)
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[4])
        if rows:
            yield pa.RecordBatch.from_pydict(solve(rows), schema=arrow)
    small_batches(parts.sparkSession)
    together = parts.repartition("h").sortWithinPartitions("h")
    return together.select("h", *KEYS, "a", "part").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(key, s, e): byte ranges to remove; they may overlap."""
    place = scratch.save(places(docs, length, k), "places")
    often = (place.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("f").alias("lo"), F.max("f").alias("hi"))
             .where("c > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    # stored first: the join then has an exchange on both sides, which Spark can split at a common anchor,
    # and the aggregate's shuffle is gone before the join's begins
    multi = scratch.save(place.join(scratch.save(often, "often"), "h"), "multi")
    scratch.drop("places", "often")
    pos = F.struct(*KEYS, "a")
    reps = scratch.save(multi.groupBy("h", "f", "n", "mixed").agg(F.min(pos).alias("first")), "reps")
    copies = (multi.join(reps.select("h", "f", "n", "first"), ["h", "f", "n"]).where(pos != F.col("first"))
              .select(*KEYS, F.col("a").alias("s"), (F.col("a") + F.col("n") - 1 + length).alias("e")))
    copies = scratch.save(copies, "copies")
    scratch.drop("multi")
    wanted = reps.where("mixed").select("h", "f", "first.*", "n")
    parts = scratch.save(_fetched(docs, wanted, length, k), "parts0")
    parts, equal = _not_too_common(parts, scratch, length, k)
    found = scratch.save(_sorted_shards(parts, length), "found")
    scratch.drop("reps")
    out = copies.unionByName(found)
    return out if equal is None else out.unionByName(equal)


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_documents(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Per document row: doc_id, spans (merged byte ranges) and kept (the bytes that are left)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch, length, k)
    per_doc = scratch.save(spans.groupBy(*KEYS).agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    scratch.drop("copies", "found")

    def run(batch):
        spans, kept, n = [], [], []
        for text, got in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            runs = merged((x["s"], x["e"]) for x in got.as_py() or ())
            edges = [0, *(x for r in runs for x in r), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw)
            spans.append([{"s": s, "e": e} for s, e in runs])
            n.append(len(raw))
        return {KEY_D: batch.column(0), "n_bytes": n, "spans": spans, "kept": kept}
    joined = doc_texts(docs).join(per_doc, KEYS, "left").select(KEY_D, "text", "spans")
    return map_arrow(joined, run, f"{KEY_D} long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary").withColumn(
        "doc_id", id_or_null(F.col(KEY_D))).drop(KEY_D)


def removal_report(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document row."""
    cut = cut_documents(docs, length, k)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
