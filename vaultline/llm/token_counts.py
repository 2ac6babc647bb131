"""Token counts from pre-token counts, without materialising token ids.

The vocabulary is a sentencepiece BPE whose pieces never hold a non-space
followed by a space mark, nor a newline (checked when it is loaded). Merges
therefore never cross these borders, and a text's token count is the sum over
its pre-tokens: runs of space marks with what follows, and newlines.

1. Each task emits the distinct pre-tokens of its rows; they meet in one
   aggregate, and the pieces of each distinct pre-token are counted once.
2. Per-document pre-token frequencies join these counts. The most frequent
   pre-tokens ("head", at most ``head`` entries of bounded length) are joined
   inside the scan from a broadcast table; this keeps every frequent key out
   of the shuffle. All others are joined by an equi-join on the pre-token.
3. Frequencies times counts are summed per document.

Defined results: null reads as empty, which has no bytes and no tokens.
Repeated rows each return. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, id_or_null, map_arrow

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
HEAD = 200_000
HEAD_CHARS = 64  # longer pre-tokens are never in the head: the broadcast has a fixed bound
_MARK = "▁"
_PRE = re.compile(f"{_MARK}+[^{_MARK}\n]*|\n|[^{_MARK}\n]+")
_FLUSH = 200_000


def load(model: str = MODEL):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(re.search(f"[^{_MARK}]{_MARK}", p) or "\n" in p for p in pieces) or sp.encode(" a", out_type=str)[0] != _MARK:
        raise ValueError(f"{model}: pieces cross pre-token borders")
    return sp


def pre_tokens(text: str) -> list[str]:
    """The text with its leading space mark, cut where no merge can cross."""
    return _PRE.findall(_MARK + text.replace(" ", _MARK)) if text else []


def count_pieces(sp, pre: list[str]) -> list[int]:
    """Tokens of each pre-token as part of a longer text. The library adds one
    space mark to every input, so a leading mark is left out, or a newline
    (two tokens with that mark) is put in front."""
    marked = sp.encode([p[1:] if p[0] == _MARK else "\n" + p for p in pre], num_threads=1)
    return [1 if p == _MARK else len(x) - (0 if p[0] == _MARK else 2) for p, x in zip(pre, marked, strict=True)]


def vocabulary(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(pre, places, pieces) of every distinct pre-token; ``places`` is how
    often it occurs."""
    def distinct(batch):
        seen: Counter = Counter()
        for t in batch.column(2).to_pylist():
            seen.update(pre_tokens(t))
            if len(seen) >= _FLUSH:
                yield {"pre": list(seen), "n": list(seen.values())}
                seen.clear()
        yield {"pre": list(seen), "n": list(seen.values())}
    made = []

    def count(batch):
        if not made:
            made.append(load(model))
        return {"pre": batch.column(0), "places": batch.column(1), "pieces": count_pieces(made[0], batch.column(0).to_pylist())}
    once = map_arrow(doc_texts(docs), distinct, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("places"))
    return map_arrow(once, count, "pre string, places long, pieces long")


def most_frequent(vocab: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the most frequent ones: all whose frequency class
    (a sixteenth of a power of two) is above the cut that a histogram of the
    classes gives. Only these rows are ever collected, from any number of tasks."""
    level = F.floor(16 * F.log2("places")).cast("int")
    total, cut = 0, None
    for r in sorted(vocab.groupBy(level.alias("level")).count().collect(), reverse=True):  # about a thousand classes
        total += r["count"]
        if total > most:
            break
        cut = r["level"]
    return vocab.where(F.lit(False) if cut is None else level >= cut)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document row."""
    spark = docs.sparkSession
    vocab = Scratch(spark, "tokens").save(vocabulary(docs, model), "vocabulary")
    top = most_frequent(vocab.where(F.char_length("pre") <= HEAD_CHARS), head).select("pre", "pieces").toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(top["pre"], top["pieces"].tolist(), strict=True)))

    def frequencies(batch):
        known = shared.value
        d, h, texts = (batch.column(i).to_pylist() for i in range(3))
        for at in range(0, len(texts), 2000):
            rows = {c: [] for c in (KEY_D, KEY_H, "n_bytes", "n_tokens", "pre", "n")}

            def add(j, n_bytes, n_tokens, pre, n, rows=rows):
                for c, v in ((KEY_D, d[j]), (KEY_H, h[j]), ("n_bytes", n_bytes), ("n_tokens", n_tokens), ("pre", pre), ("n", n)):
                    rows[c].append(v)
            for j in range(at, min(at + 2000, len(texts))):
                here = 0
                for pre, n in Counter(pre_tokens(texts[j])).items():
                    pieces = known.get(pre)
                    if pieces is None:
                        add(j, None, None, pre, n)
                    else:
                        here += n * pieces
                # no pre-token starts with a newline and goes on: this key finds no count and spreads the rows
                add(j, len(texts[j].encode()), here, f"\n{d[j]}:{h[j]}", None)
            yield rows
    per_doc = map_arrow(doc_texts(docs), frequencies, f"{KEY_D} long, {KEY_H} long, n_bytes long, n_tokens long, pre string, n long")
    counted = per_doc.join(vocab.select("pre", "pieces"), "pre", "left").select(
        *KEYS, "n_bytes", F.coalesce("n_tokens", F.col("n") * F.col("pieces")).alias("n_tokens"))
    # a document listed r times adds each of its counts r times
    sums = counted.groupBy(*KEYS).agg(
        F.count("n_bytes").alias("r"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("all"))
    n = F.expr("`all` div r")
    return sums.select(id_or_null(F.col(KEY_D)).alias("doc_id"), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"),
                       F.explode(F.array_repeat(F.lit(1), F.col("r").cast("int"))).alias("row")).drop("row")
