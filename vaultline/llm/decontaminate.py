"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. For each pattern length
m the scan looks at the block of words that ends at the current position: the
shift table tells how far to move when no pattern can end there; at shift zero
the block's bucket gives the candidate patterns, which are told apart by a
hash of their first words and confirmed by direct comparison.

Patterns are searched in blocks of at most ``block`` windows: each block's
tables are broadcast (their size is bounded by the block, not by the
benchmark) and scanned against all documents. Hits of the blocks meet by
document key; the documents themselves are not shuffled.

Defined results: null or wordless texts have no words and no hits. A null
item_id is ignored; repeated items count once. An empty benchmark hits nothing.
Repeated document rows each return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, id_or_null, keyed, map_arrow

WINDOW = 10
BLOCK = 50_000
# bytes: A-Z to a-z, everything below 0x80 that is not a letter or digit to a space
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
    for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Tables:
    """Shift table and buckets for patterns of one length m."""

    def __init__(self, m: int, patterns: dict[tuple, frozenset]):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for p, items in patterns.items():
            for end in range(self.b, m + 1):
                block = p[end - self.b:end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.buckets.setdefault(p[m - self.b:], {}).setdefault(p[:self.b], []).append((p, items))

    def find(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        m, b, shift, default, n = self.m, self.b, self.shift, self.default, len(words)
        i = m
        while i <= n:
            block = tuple(words[i - b:i])
            s = shift.get(block, default)
            if s:
                i += s
                continue
            for p, items in self.buckets[block].get(tuple(words[i - m:i - m + b]), ()):
                if p == tuple(words[i - m:i]):
                    yield i - m, items
            i += 1


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window: words joined by a space, items) for every distinct window."""
    def run(batch):
        ids, win = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words_of(text)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                ids.append(item)
                win.append(b" ".join(w[i:i + size]))
        return {"item": ids, "win": win}
    src = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").dropna()
    return map_arrow(src, run, "item string, win binary").groupBy("win").agg(F.collect_set("item").alias("items"))


def _load(rows) -> list[Tables]:
    by_len: dict[int, dict] = {}
    for r in rows:
        p = tuple(bytes(r["win"]).split(b" "))
        by_len.setdefault(len(p), {})[p] = tuple(r["items"])
    return [Tables(m, ps) for m, ps in sorted(by_len.items())]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(key, n_words, times, spans, items) per distinct document: ``spans`` are
    the (start, end) word ranges covered by occurrences, merged; ``times`` is
    how many rows list the document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    wins = scratch.save(windows(benchmark, window), "windows")
    n_blocks = max(1, -(-wins.count() // block))
    text = doc_texts(docs)
    parts = None
    for k in range(n_blocks):
        rows = wins.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(_load(rows))

        def run(batch, shared=shared, first=k == 0):
            out = {c: [] for c in (KEY_D, KEY_H, "n_words", "spans", "items")}
            for d, h, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = words_of(t)
                found = [(s, s + tab.m, items) for tab in shared.value for s, items in tab.find(w)]
                if not first and not found:
                    continue
                out[KEY_D].append(d)
                out[KEY_H].append(h)
                out["n_words"].append(len(w) if first else None)
                out["spans"].append([{"start": s, "end": e} for s, e in merged((s, e) for s, e, _ in found)])
                out["items"].append(sorted({i for _, _, items in found for i in items}))
            return out
        part = map_arrow(text, run, f"{KEY_D} long, {KEY_H} long, n_words long, "
                                    "spans array<struct<start:int,end:int>>, items array<string>")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*KEYS).agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("times"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    def run(batch):
        spans = batch.column(3).to_pylist()
        hit = [sum(e - s for s, e in merged((x["start"], x["end"]) for x in row)) for row in spans]
        return {**{c: batch.column(i) for i, c in ((0, KEY_D), (1, "n_words"), (2, "times"), (4, "items"))}, "n_hit": hit}
    h = hits(docs, benchmark, window, block).select(KEY_D, "n_words", "times", "spans", "items")
    per_doc = map_arrow(h, run, f"{KEY_D} long, n_words long, times long, items array<string>, n_hit long")
    return per_doc.select(
        id_or_null(F.col(KEY_D)).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("row")).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    bad = hits(docs, benchmark, window, block).where(F.size("spans") > 0).select(*KEYS)
    return keyed(docs).join(bad, KEYS, "left_anti").drop(*KEYS)


# DuckDB form of contamination(); the word classes match the contract's bytes.
SQL = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM fold, sizes WHERE len(w) >= m),
hit AS (SELECT p.doc_id, p.s, p.m, v.item_id FROM pos p JOIN win v ON v.m = p.m AND v.t = array_to_string(p.w[p.s:p.s + p.m - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(d.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(d.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM fold f LEFT JOIN covered c ON c.doc_id = f.doc_id LEFT JOIN named d ON d.doc_id = f.doc_id
"""
