"""Fuzzy line deduplication by MinHash over character shingles.

1. Every line gets a 128-bit content hash; equal lines collapse by a partial
   aggregate (their first position and how often they occur).
2. A line's signature is one-permutation MinHash over its character shingles
   (empty bins are filled from other bins), cut into bands. At a similarity
   of 0.8 two lines share at least one of 7 bands of 3 rows with probability
   0.993, at 0.9 with 0.9999.
3. All lines of a band bucket are compared with each other. Buckets of
   ordinary size are one cell each (buckets with the same lines share it). A
   larger bucket is dealt into blocks by the line's hash. A first pass compares
   the lines within each block, and each block with a few glue lines of the
   bucket. Of a bucket whose lines are then in several components, a second
   pass compares every two lines of different components, block by block; lines
   already in one component need no further link. So a cell's size is bounded,
   and a large group of near copies costs a number of pairs linear in its size.
4. Pairs are verified by exact Jaccard similarity on the lines' shingle sets.
5. Verified links go through distributed connected components, and each
   component keeps the line that comes first (doc_id, then line number).
   Every other line of it is removed from its document.

Defined results: lines are split at \\n; lines of white space only are never
removed. Null texts stay null; a text all of whose lines go becomes empty.
Lines shorter than a shingle are their own only shingle. Rows that repeat a
document (doc_id and text) lose the same lines. A null doc_id orders last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, keyed, map_arrow
from .components import connected

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 7, 3
MOST, MOST_CHARS = 1000, 1 << 18  # lines and characters of a block (on average)
GLUE_LINES = 8
WHOLE = 2  # the side of lines that are compared with every line of their cell
_CHUNK = 1 << 16  # characters hashed at a time: the arrays stay in the processor's cache
_EMPTY = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _rolled(code: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k codes: powers of two double, then they are put together."""
    power, width, part = 0x9E3779B97F4A7C15, 1, code
    done, have = None, 0
    while width <= k:
        if k & width:
            if done is None:
                done, have = part, width
            else:
                m = len(code) - have - width + 1
                done, have = part[:m] * np.uint64(pow(0x9E3779B97F4A7C15, have, 2**64)) + done[width:width + m], have + width
        if width * 2 <= k:
            part = part[:-width] * np.uint64(power) + part[width:]
            power = power * power % 2**64
        width *= 2
    return done


def band_keys(lines: list[str], k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(len(lines), bands) bucket keys; equal shingle sets have equal keys."""
    out = np.empty((len(lines), bands), np.int64)
    at = 0
    while at < len(lines):
        upto, chars = at, 0
        while upto < len(lines) and (upto == at or chars + len(lines[upto]) <= _CHUNK):
            chars += max(k, len(lines[upto]))
            upto += 1
        out[at:upto] = _band_keys(lines[at:upto], k, bands, rows)
        at = upto
    return out


def _band_keys(lines, k, bands, rows):
    bins = bands * rows
    padded = [x if len(x) >= k else x + "\n" * (k - len(x)) for x in lines]  # no line holds \n
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lens)
    h = _mix(_rolled(code, k))
    slot = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    # shingles that reach into the next line go to a slot of their own
    slot += np.repeat(np.arange(len(lines), dtype=np.uint64) * np.uint64(bins), lens)[:len(h)]
    over = (ends - k + 1)[:-1, None] + np.arange(k - 1)
    slot[over.ravel()] = len(lines) * bins
    low = np.full(len(lines) * bins + 1, _EMPTY)
    np.minimum.at(low, slot.view(np.int64), h)
    low = low[:-1].reshape(-1, bins)
    for turn in range(1, 4 * bins):  # fill empty bins from bins picked by a fixed hash
        r, c = np.nonzero(low == _EMPTY)
        if not len(r):
            break
        pick = _mix(np.arange(bins, dtype=np.uint64) * np.uint64(1000) + np.uint64(turn)) % np.uint64(bins)
        low[r, c] = low[r, pick[c].astype(np.int64)] if turn < 3 * bins else low[r, (c + turn) % bins]
    keys = np.zeros((len(lines), bands), np.uint64)
    for j in range(rows):
        keys = _mix(keys + low[:, j::rows] + np.arange(bands, dtype=np.uint64))
    return keys.view(np.int64)


def shingles(line: str, k: int = SHINGLE) -> frozenset[str]:
    return frozenset(line[i:i + k] for i in range(max(1, len(line) - k + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _eights(raw: bytes) -> np.ndarray:
    """Every run of eight bytes as a number, without copies."""
    return np.ndarray((len(raw) - 7,), np.uint64, raw, 0, (1,))


def packed(line: str, k: int = SHINGLE) -> tuple[bool, frozenset]:
    """(narrow, shingle set). For k = 8 and code points below 256 a shingle
    is exactly a 64-bit number, which is quicker to make than a string."""
    if k == 8 and len(line) >= k:
        try:
            return True, frozenset(_eights(line.encode("latin-1")).tolist())
        except UnicodeEncodeError:
            return False, shingles(line, k)
    return False, shingles(line, k)


def similar(x: str, a: tuple, y: str, b: tuple, k: int, least: float) -> bool:
    """Exact: the Jaccard similarity of lines x and y, packed as a and b, is at least ``least``."""
    if min(len(a[1]), len(b[1])) < least * max(len(a[1]), len(b[1])):
        return False
    if a[0] != b[0]:
        return jaccard(shingles(x, k), shingles(y, k)) >= least
    return jaccard(a[1], b[1]) >= least


def _ids128(lines: list[str]) -> np.ndarray:
    """(len(lines), 2) content hashes."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x.encode("utf-8", "surrogatepass")) for x in lines]), "<i8").reshape(-1, 2)


def _lines_of(batch, most: int = 1000):
    """Parts of a batch: (key values, line numbers, lines) of lines that are not blank."""
    d, h, texts = (batch.column(i).to_pylist() for i in range(3))
    for at in range(0, len(texts), most):
        ds, hs, numbers, lines = [], [], [], []
        for j, t in enumerate(texts[at:at + most], at):
            split = t.split("\n")
            keep = [no for no, x in enumerate(split) if x and not x.isspace()]
            ds += [d[j]] * len(keep)
            hs += [h[j]] * len(keep)
            numbers += keep
            lines += [split[no] for no in keep]
        yield ds, hs, numbers, lines


def places(docs: DataFrame) -> DataFrame:
    """(l1, l2, key, line_no) of every line that is not blank."""
    def run(batch):
        for ds, hs, numbers, lines in _lines_of(batch):
            ids = _ids128(lines)
            yield {"l1": ids[:, 0], "l2": ids[:, 1], KEY_D: ds, KEY_H: hs, "line_no": numbers}
    return map_arrow(doc_texts(docs), run, f"l1 long, l2 long, {KEY_D} long, {KEY_H} long, line_no int")


def distinct_lines(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(l1, l2, first, last, size, b0, b1, ...): every distinct line with its first
    and last place, its length and its band keys. Lines repeated within a part of a batch
    leave it once."""
    names = [f"b{i}" for i in range(BANDS)]

    def run(batch):
        for ds, hs, numbers, lines in _lines_of(batch):
            known: dict[str, int] = {}
            of = np.fromiter((known.setdefault(x, len(known)) for x in lines), np.int64, len(lines))
            place = np.array(ds, np.int64), np.array(hs, np.int64), np.array(numbers, np.int32)
            order = np.lexsort(place[::-1])  # the places in order: a line's first and last are its ends there
            first, last = np.empty((2, len(known)), np.int64)
            first[of[order[::-1]]] = order[::-1]
            last[of[order]] = order
            different = list(known)
            ids = _ids128(different)
            keys = band_keys(different, k) if known else np.empty((0, BANDS), np.int64)
            cols = {"l1": ids[:, 0], "l2": ids[:, 1], "size": list(map(len, different)),
                    **{n: np.ascontiguousarray(keys[:, i]) for i, n in enumerate(names)}}
            for name, at in (("first", first), ("last", last)):
                cols[name] = pa.StructArray.from_arrays([pa.array(x[at]) for x in place], [KEY_D, KEY_H, "line_no"])
            yield cols
    place = f"struct<{KEY_D}:long,{KEY_H}:long,line_no:int>"
    rows = map_arrow(doc_texts(docs), run, f"l1 long, l2 long, first {place}, last {place}, size int, "
                     + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("l1", "l2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("size").alias("size"),
                                        *[F.max(n).alias(n) for n in names])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) for ``wanted(line, key, line_no)``; only these lines leave their documents."""
    per_doc = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("line_no", "line")).alias("lines"))

    def run(batch):
        out = {"line": [], "text": []}
        for text, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            split = text.split("\n")
            for x in lines:
                out["line"].append(x["line"])
                out["text"].append(split[x["line_no"]])
        return out
    return map_arrow(doc_texts(docs).join(per_doc, KEYS).select("text", "lines"), run, "line long, text string")


def _codes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): each line's different shingles as numbers, equal for equal shingles."""
    parts = []
    if k == 8 and min(map(len, texts)) >= k:
        try:
            parts = [np.unique(_eights(x.encode("latin-1"))) for x in texts]
        except UnicodeEncodeError:
            parts = []
    if parts:
        codes = np.unique(np.concatenate(parts), return_inverse=True)[1]
    else:
        known: dict[str, int] = {}
        parts = [[known.setdefault(x, len(known)) for x in shingles(t, k)] for t in texts]
        codes = np.concatenate(parts)
    return codes, np.cumsum([0, *map(len, parts)])


def cell_links(line: list[int], root: list[int], side: list[int], texts: list[str], k: int, least: float) -> list[tuple]:
    """Verified links that join all lines of a cell which a chain of links
    joins. Lines of equal ``root`` are joined already, and lines of one
    ``side`` are not compared unless it is WHOLE."""
    n, out = len(line), []
    if n <= 8:
        sets, comp = [packed(t, k) for t in texts], list(root)
        for x in range(n):
            for y in range(x + 1, n):
                if comp[x] != comp[y] and (side[x] != side[y] or side[x] == WHOLE) and similar(
                        texts[x], sets[x], texts[y], sets[y], k, least):
                    out.append((line[x], line[y]))
                    comp = [comp[x] if c == comp[y] else c for c in comp]
        return out
    codes, start = _codes(texts, k)
    size, side = np.diff(start), np.array(side)
    comp = np.unique(np.array(root), return_inverse=True)[1]
    held = np.zeros(int(codes.max()) + 1, bool)
    for x in range(n - 1):
        if out and (comp == comp[0]).all():
            break
        s = size[x + 1:]
        ok = (comp[x + 1:] != comp[x]) & (np.minimum(s, size[x]) >= least * np.maximum(s, size[x]))
        if side[x] != WHOLE:
            ok &= side[x + 1:] != side[x]
        y = np.flatnonzero(ok) + x + 1
        if not len(y):
            continue
        mine = codes[start[x]:start[x + 1]]
        held[mine] = True
        if 8 * len(y) > n - x:
            both = np.add.reduceat(held[codes[start[x + 1]:]], start[x + 1:n] - start[x + 1], dtype=np.int64)[y - x - 1]
        else:
            both = np.array([np.count_nonzero(held[codes[start[j]:start[j + 1]]]) for j in y])
        held[mine] = False
        match = y[both / (size[x] + size[y] - both) >= least]
        if len(match):
            other, at = np.unique(comp[match], return_index=True)
            out += [(line[x], line[j]) for j in match[at]]
            comp[np.isin(comp, other)] = comp[x]
    return out


def _cell_links(cells: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Links (a, b) within ``cells`` (cell, line, root, side)."""
    whole = cells.join(texts, "line").groupBy("cell").agg(F.collect_list(F.struct("line", "root", "side", "text")).alias("lines"))

    def run(batch):
        a, b, at = [], [], 0
        rows = batch.column(0).flatten()
        cols = [rows.field(i).to_pylist() for i in range(4)]
        for n in batch.column(0).value_lengths().to_pylist():
            kept = {cols[0][i]: i for i in range(at, at + n)}  # a glue line may come twice
            order = [kept[x] for x in sorted(kept)]
            at += n
            for x, y in cell_links(*([c[i] for i in order] for c in cols), k, least):
                a.append(x)
                b.append(y)
        return {"a": a, "b": b}
    return map_arrow(whole.select("lines"), run, "a long, b long")


def _blocks(n, chars) -> F.Column:
    """How many blocks hold so many lines and characters."""
    return F.greatest(F.ceil(n / F.lit(MOST)), F.ceil(chars / F.lit(MOST_CHARS))).cast("int")


def near_lines(docs: DataFrame, lines: DataFrame, scratch: Scratch, k: int, least: float) -> DataFrame:
    """Verified links (a, b) that join the distinct ``lines`` (line, first, size, bands)
    of each component of the links between lines that share a bucket."""
    member = lines.select("line", "size", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("bucket"))
    counts = scratch.save(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).where("n > 1")
                          .select("bucket", _blocks(F.col("n"), F.col("chars")).alias("parts")), "counts")
    held = scratch.save(member.join(counts, "bucket"), "held")
    wanted = held.select("line").distinct().join(lines.select("line", "first.*"), "line")
    texts = scratch.save(_texts_of(docs, wanted).dropDuplicates(["line"]), "texts")
    groups = (held.where("parts = 1").groupBy("bucket").agg(F.array_sort(F.collect_list("line")).alias("group"))
              .select("group").distinct())
    one = groups.select(F.xxhash64("group").alias("cell"), F.explode("group").alias("line"))
    large = held.where("parts > 1")
    glue = large.groupBy("bucket", "parts").agg(F.array(*[F.min(F.struct(F.xxhash64(F.lit(i), "line"), "line"))["line"]
                                                          for i in range(GLUE_LINES)]).alias("line"))
    glue = (glue.withColumn("line", F.explode(F.array_distinct("line")))
            .select("bucket", "line", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block")))
    dealt = large.select("bucket", "line", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int").alias("block")).unionByName(glue)
    cells = one.unionByName(dealt.select(F.xxhash64("bucket", "block").alias("cell"), "line"))
    links = scratch.save(_cell_links(cells.select("cell", "line", F.col("line").alias("root"), F.lit(WHOLE).alias("side")),
                                     texts, k, least), "links0")
    if large.isEmpty():
        return links
    return _across(large, links, texts, scratch, k, least)


def _across(large: DataFrame, links: DataFrame, texts: DataFrame, scratch: Scratch, k: int, least: float) -> DataFrame:
    """``links`` and those between lines of a large bucket that lie in different components of ``links``."""
    parts = scratch.save(connected(links, Scratch(large.sparkSession, "lines0")), "parts0")
    placed = scratch.save(large.join(parts.withColumnRenamed("node", "line"), "line", "left")
                          .select("bucket", "line", "size", F.coalesce("root", "line").alias("root")), "placed0")
    roots = scratch.save(placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")), "roots0")
    several = roots.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("bucket")
    roots = roots.join(several, "bucket").withColumn("own", _blocks(F.col("n"), F.col("chars")))
    # a component of more than one block has its own blocks; the others of a bucket are dealt into mixed blocks (solid -1)
    mixed = roots.where("own = 1").groupBy("bucket").agg(_blocks(F.sum("n"), F.sum("chars")).alias("mixed"))
    dealt = scratch.save(roots.join(scratch.save(mixed, "mixed"), "bucket", "left").select(
        "bucket", "root", F.when(F.col("own") > 1, F.col("root")).otherwise(F.lit(-1)).alias("solid"),
        F.when(F.col("own") > 1, F.col("own")).otherwise(F.col("mixed")).alias("of")), "dealt")
    number = F.pmod(F.xxhash64(F.when(F.col("solid") < 0, F.col("root")).otherwise(F.col("line"))), F.col("of")).cast("int")
    placed = scratch.save(placed.join(dealt, ["bucket", "root"]).select("bucket", "line", "root", "solid", number.alias("i")), "placed")
    blocks = (dealt.select("bucket", "solid", "of").distinct()
              .select("bucket", "solid", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i")))
    x, y = (blocks.select("bucket", F.struct("solid", "i").alias(name)) for name in "xy")
    met = scratch.save(x.join(y, "bucket").where("x <= y and (x.solid < 0 or x.solid != y.solid)")
                       .withColumn("cell", F.xxhash64("bucket", "x", "y")), "met")
    ends = (met.select("bucket", "cell", "x.*", F.when(F.expr("x = y"), WHOLE).otherwise(0).alias("side"))
            .unionByName(met.where("x != y").select("bucket", "cell", "y.*", F.lit(1).alias("side"))))
    cells = placed.join(ends, ["bucket", "solid", "i"]).select("cell", "line", "root", "side")
    more = scratch.save(_cell_links(cells, texts, k, least), "links1")
    scratch.drop("placed0", "roots0", "mixed", "dealt", "placed", "met")
    return parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def removals(docs: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """(key, gone): the numbers of the lines to remove from each document."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    lines = scratch.save(distinct_lines(docs, k).withColumn("line", F.monotonically_increasing_id()), "lines")
    links = near_lines(docs, lines, scratch, k, least)
    parts = scratch.save(connected(links, scratch), "parts")
    ids = lines.select("l1", "l2", "line", "first", (F.col("first") != F.col("last")).alias("twice"))
    in_part = ids.join(parts.withColumnRenamed("node", "line"), "line").select("l1", "l2", "root", "first")
    kept = scratch.save(in_part.groupBy("root").agg(F.min("first").alias("keep")), "kept")
    fuzzy = in_part.select("l1", "l2", "root").join(kept, "root").select("l1", "l2", "keep")
    exact = (ids.where("twice").join(parts.select(F.col("node").alias("line")), "line", "left_anti")
             .select("l1", "l2", F.col("first").alias("keep")))
    keep = scratch.save(fuzzy.unionByName(exact), "keep")
    scratch.drop("lines", "texts", "counts", "held")
    pos = F.struct(KEY_D, KEY_H, "line_no")
    gone = places(docs).join(keep, ["l1", "l2"]).where(pos != F.col("keep"))
    return scratch.save(gone.groupBy(*KEYS).agg(F.collect_set("line_no").alias("gone")), "gone")


def _rebuilt(docs: DataFrame, k: int, least: float) -> DataFrame:
    """``docs`` with new text and the counts ``__llm_lines``, ``__llm_gone``."""
    gone = removals(docs, k, least).withColumnRenamed("gone", "__llm_numbers")
    joined = keyed(docs).join(gone, KEYS, "left").drop(*KEYS)
    docs_cols = docs.columns
    at = docs_cols.index("text")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]
                          + [T.StructField(c, T.LongType()) for c in ("__llm_lines", "__llm_gone")])

    def run(batch):
        n, removed, text = [], [], []
        for t, gone in zip(batch.column(at).to_pylist(), batch.column(len(docs_cols)).to_pylist(), strict=True):
            split = [] if t is None else t.split("\n")
            gone = set(gone or ())
            n.append(len(split))
            removed.append(len(gone))
            text.append("\n".join(x for i, x in enumerate(split) if i not in gone) if gone else t)
        cols = {c: batch.column(i) for i, c in enumerate(docs_cols)}
        return {**cols, "text": text, "__llm_lines": n, "__llm_gone": removed}
    return map_arrow(joined, run, schema)


def dedup_lines(docs: DataFrame, k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines removed; ``n_chars``, if there, follows the text."""
    own = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    out = _rebuilt(docs, k, least).select(*own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own)


def line_report(docs: DataFrame, k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed and the text that is left."""
    out = _rebuilt(docs.select("doc_id", "text"), k, least)
    return out.select("doc_id", F.col("__llm_lines").alias("n_lines"), F.col("__llm_gone").alias("n_removed"), "text")
