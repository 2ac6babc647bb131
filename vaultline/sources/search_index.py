"""Substring search without a full scan: trigram postings over stored rows.

A ``SearchIndex`` keeps rows in segments (ranges of a sort order, each of about
``segment_rows`` rows and in its own folder), and for every three-character
piece of a searched column the blocks of rows that have it:

    rows/g=<n>/_seg=<s>/       the rows of a segment, with their block number
    postings/g=<n>/_b=<x>/     (gram, g, seg, blocks), sorted by gram; <x> is a
                               hash of the gram's first character
    changes/g=<n>/             keys that the generation adds, replaces, removes
    manifest/g=<n>/            its segments; written last, so it is the commit

A search looks up the text's pieces, keeps the blocks that have all of them,
opens only the segments of these blocks and checks the text itself there, so
the rows are exactly those of a whole scan. A posting row lists the blocks of
one segment, at most ``segment_rows / block`` numbers however frequent the
piece; only segment numbers, a part of the file listing, reach the driver. A
value ends in two end marks, so that each of its characters starts a piece: a
text of one or two characters is looked up as the beginning of pieces. Pieces
are taken from a block's values joined; those across two values only add
candidates. A task that builds postings holds one segment, whatever the number
of segments.

``add`` writes a generation. A row of a later one replaces the row of the same
key in earlier ones, and removed keys go; found rows are checked against the
changed keys. ``compact`` folds all generations into one. The key must be
unique within a generation and not null. A generation that did not commit is
not read, and the next ``add`` overwrites it.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import contains_any, like_any
from ..session import scratch_path
from ..streaming.deltas import drop_folder, hadoop_path, numbered

GRAM = 3
END = "\0"
SPREAD = 256  # folders of the postings of a generation
POSTINGS = "gram string, g int, seg int, blocks array<int>"
SEGMENTS_AT_ONCE = 8  # segments whose postings' rows a task sorts
SEG, BLOCK, GEN, LAST = "_seg", "_block", "_g", "_last"


def _spread(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(SPREAD)).cast("int")


def _text(columns) -> Column:
    """All searched columns of a row, each with its end marks."""
    return F.concat(*[F.concat(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(END * (GRAM - 1))) for c in columns])


def _grams(text: Column) -> Column:
    """The distinct pieces of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def like_runs(text: str) -> list[str]:
    """The literal runs of a LIKE pattern, split at wildcards and escapes."""
    return [r for r in re.split(r"(?s)\\.?|[%_]", text.lower()) if r]


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, columns: list[str],
                 segment_rows: int = 100_000, block: int = 32):
        self.spark, self.path, self.schema, self.key, self.columns = spark, path.rstrip("/"), schema, key, columns
        self.segment_rows, self.block = segment_rows, block
        self._rows_schema = T.StructType([*schema.fields, T.StructField(GEN, T.IntegerType()), T.StructField(BLOCK, T.IntegerType())])

    # -- writing ------------------------------------------------------------

    def add(self, rows: DataFrame, order: list[str], removed: DataFrame | None = None, base: bool = False) -> int:
        """Commit ``rows`` (new ones, or new images of stored ones) and the
        keys in ``removed`` as the next generation; returns its number. With
        ``base`` it stands for everything before it. ``order`` decides which
        rows lie together: name first what searches tend to hit together, and
        end with the key."""
        g = (numbered(self.spark, f"{self.path}/manifest", "g=") or [-1])[-1] + 1
        folder = f"{self.path}/rows/g={g}"
        given, found = scratch_path(self.spark, "rows"), scratch_path(self.spark, "postings")
        # written first: they are counted, sampled for the ranges and dealt, and may come from a join
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.parquet(given)
        rows = self.spark.read.schema(self.schema).parquet(given)
        segments = max(1, ceil(rows.count() / self.segment_rows))
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        (rows.withColumn(GEN, F.lit(g))
         .repartitionByRange(segments, *order).sortWithinPartitions(*order)
         .withColumn(BLOCK, (place / self.block).cast("int")).withColumn(SEG, F.spark_partition_id())
         .write.mode("overwrite").partitionBy(SEG).parquet(folder))
        stored = self.spark.read.schema(T.StructType([*self._rows_schema.fields, T.StructField(SEG, T.IntegerType())])).parquet(folder)
        texts = stored.select(SEG, BLOCK, _text(self.columns).alias("text")).repartitionById(segments, SEG)
        blocks = texts.groupBy(SEG, BLOCK).agg(F.array_join(F.collect_list("text"), "").alias("text"))
        (blocks.select(SEG, F.col(BLOCK).alias("block"), F.explode(_grams(F.col("text"))).alias("gram"))
         .groupBy(SEG, "gram").agg(F.collect_list("block").alias("blocks"))
         .select("gram", F.lit(g).alias("g"), F.col(SEG).alias("seg"), "blocks", _spread(F.col("gram")).alias("_b"))
         .write.parquet(found))
        (self.spark.read.schema(f"{POSTINGS}, _b int").parquet(found)
         .repartitionByRange(ceil(segments / SEGMENTS_AT_ONCE), "_b", "gram", "seg").sortWithinPartitions("_b", "gram", "seg")
         .write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/postings/g={g}"))
        keys = stored.select(self.key)
        if removed is not None:
            keys = keys.unionByName(removed.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)))
        keys.withColumn(GEN, F.lit(g)).write.mode("overwrite").parquet(f"{self.path}/changes/g={g}")
        mark = self.spark.range(1).select(F.lit(g).alias("g"), F.lit(-1).alias("seg"), F.lit(0).cast("bigint").alias("n_rows"))
        counted = stored.groupBy(F.lit(g).alias("g"), F.col(SEG).alias("seg")).agg(F.count(F.lit(1)).alias("n_rows"))
        (mark.unionByName(counted).withColumn("base", F.lit(base or g == 0))
         .write.mode("overwrite").parquet(f"{self.path}/manifest/g={g}"))
        for path in (given, found):
            drop_folder(self.spark, path)
        return g

    def compact(self, order: list[str]) -> int:
        """Write the live rows as one generation and delete those before it.
        Let no search run that began before."""
        g = self.add(self.read(), order, base=True)
        for n in numbered(self.spark, f"{self.path}/manifest", "g="):
            if n < g:
                for kind in ("manifest", "changes", "postings", "rows"):
                    drop_folder(self.spark, f"{self.path}/{kind}/g={n}")
        return g

    # -- reading ------------------------------------------------------------

    def manifest(self) -> dict[int, list[int]]:
        """Generation -> its segments, from the last base on."""
        found = numbered(self.spark, f"{self.path}/manifest", "g=")
        if not found:
            return {}
        rows = self.spark.read.schema("g int, seg int, n_rows bigint, base boolean").parquet(
            *[f"{self.path}/manifest/g={g}" for g in found]).collect()
        base = max(r.g for r in rows if r.base)
        return {g: sorted(r.seg for r in rows if r.g == g and r.seg >= 0) for g in found if g >= base}

    def read(self) -> DataFrame:
        """All live rows."""
        live = self.manifest()
        return self._live(live, [(g, s) for g, segs in live.items() for s in segs], F.lit(True))

    def find(self, text: str | None) -> DataFrame:
        """Rows with the text (trimmed, literal, case-insensitive) in one of
        the columns; all rows for an empty text."""
        t = (text or "").strip()
        return self._search([t.lower()], contains_any(self.columns, t)) if t else self.read()

    def find_like(self, text: str | None) -> DataFrame:
        """Like ``find``, but ``%`` and ``_`` in the text are wildcards."""
        t = (text or "").strip()
        return self._search(like_runs(t), like_any(self.columns, t)) if t else self.read()

    def _search(self, runs: list[str], predicate: Column) -> DataFrame:
        live = self.manifest()
        return self._live(live, self.candidates(runs, live), predicate)

    def candidates(self, runs: list[str], live: dict[int, list[int]] | None = None) -> list[tuple[int, int]]:
        """(generation, segment) of every segment with a block that has all
        pieces of ``runs``. Runs shorter than a piece count only where there
        is no longer one; without any run, all segments are candidates."""
        live = self.manifest() if live is None else live
        whole = sorted({r[i:i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})
        starts = sorted({r for r in runs if r and not any(o != r and o.startswith(r) for o in runs)})
        terms = whole or starts
        if not terms:
            return [(g, s) for g, segs in live.items() for s in segs]
        names = self.spark.createDataFrame([(t,) for t in terms], "t string").select(_spread(F.col("t"))).distinct()
        folders = [f"_b={r[0]}" for r in names.collect()]
        paths = []
        for g in live:
            fs, p = hadoop_path(self.spark, f"{self.path}/postings/g={g}")
            there = {s.getPath().getName() for s in fs.listStatus(p)}
            if there.issuperset(folders):  # else some piece does not occur at all
                paths += [f"{p.toString()}/{name}" for name in folders]
        if not paths:
            return []
        postings = self.spark.read.schema(POSTINGS).parquet(*paths)
        gram = F.col("gram")
        each = ("gram", "g", "seg", F.explode("blocks").alias("block"))
        if whole:
            held = postings.filter(gram.isin(whole)).select(*each)
        else:  # no term begins another, so a piece belongs to one of them
            held = postings.withColumn("gram", F.coalesce(*[F.when(gram.startswith(t), F.lit(t)) for t in starts])) \
                .filter(gram.isNotNull()).select(*each).distinct()
        both = held.groupBy("g", "seg", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms))
        return sorted(tuple(r) for r in both.select("g", "seg").distinct().collect())

    def _live(self, live: dict[int, list[int]], segments: list[tuple[int, int]], predicate: Column) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._rows_schema).parquet(
            *[f"{self.path}/rows/g={g}/{SEG}={s}" for g, s in segments]).filter(predicate)
        later = sorted(live)[1:]
        if later:
            last = self.spark.read.schema(T.StructType([self.schema[self.key], T.StructField(GEN, T.IntegerType())])).parquet(
                *[f"{self.path}/changes/g={g}" for g in later]).groupBy(self.key).agg(F.max(GEN).alias(LAST))
            rows = rows.join(last, self.key, "left").filter(F.col(LAST).isNull() | (F.col(GEN) >= F.col(LAST)))
        return rows.select(*self.schema.fieldNames())
