"""Each operator against a plain rewrite of its contract, on awkward and real rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vaultline.llm import decontaminate, langid, line_dedup, packing, quality, simhash, suffix_dedup, token_counts, warc

from .conftest import identity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "real"])
def case(request, odd_docs, odd_rows, real_docs, real_rows):
    return (odd_docs, odd_rows) if request.param == "odd" else (real_docs, real_rows)


# -- token counts --------------------------------------------------------------

def test_token_counts(case):
    import sentencepiece
    df, rows = case
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = [len(sp.encode(r[1] or "")) for r in rows]
    want = sorted(((r[0], len((r[1] or "").encode()), k, k > 4096) for r, k in zip(rows, n, strict=True)), key=repr)
    got = token_counts.token_counts(df, head=50)  # a small head: most pre-tokens take the join
    assert tuples(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


# -- SimHash ---------------------------------------------------------------------

def simple_fingerprint(t: str) -> int:
    w = WORD.findall(fold(t))
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    c = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(sh)) if sh else 0


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in linked:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_simhash_groups(case, bits):
    df, rows = case
    fps = [simple_fingerprint(r[1] or "") for r in rows]
    nodes = sorted(set(fps))
    comp = groups(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= bits])
    low: dict = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            low[comp[f]] = min(low.get(comp[f], r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", low.get(comp[f])) for r, f in zip(rows, fps, strict=True)), key=repr)
    assert tuples(simhash.near_duplicates(df, max_bits=bits), "doc_id", "fingerprint", "component_id") == want


def test_simhash_keep_first(odd_docs, odd_rows):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    fps = [simple_fingerprint(r[1] or "") for r in odd_rows]
    nodes = sorted(set(fps))
    comp = groups(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    first: dict = {}
    for r, f in zip(odd_rows, fps, strict=True):
        k = comp[f]
        if k not in first or identity(r) < identity(first[k]):
            first[k] = r
    assert tuples(kept, "doc_id", "text") == sorted(((r[0], r[1]) for r in first.values()), key=repr) or \
        sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in kept.collect()) == \
        sorted((r[0] is None, r[0], r[1] or "") for r in first.values())


# -- suffix-array dedup ------------------------------------------------------------

def simple_removal(rows, length):
    seen, out = set(), {}
    for r in sorted({identity(r): r for r in rows}.values(), key=identity):
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        spans = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[identity(r)] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *out[identity(r)]) for r in rows), key=repr)


@pytest.mark.parametrize("most", [8000, 1])
def test_suffix_removal(case, most, monkeypatch):
    """most=1 refines every contested anchor down to single windows."""
    df, rows = case
    monkeypatch.setattr(suffix_dedup, "MAX_FRAGMENTS", most)
    got = tuples(suffix_dedup.removal_report(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == simple_removal(rows, 100)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 2), (50, 1), (300, 2), (300, 26), (2000, 4)):
        t = rng.integers(97, 97 + letters, size).astype(np.uint8)
        b = t.tobytes()
        assert suffix_dedup.suffix_array(t, 2100).tolist() == sorted(range(size), key=lambda i: b[i:])


# -- decontamination ---------------------------------------------------------------

def simple_hits(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, t in items:
        w = word.findall(fold(t or ""))
        if w and item is not None:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                wins[tuple(w[i:i + n])].add(str(item))
    out = []
    for r in rows:
        w, hit, ids = word.findall(fold(r[1] or "")), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    ids |= wins[tuple(w[i:i + n])]
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [50_000, 7])
def test_decontamination(spark, odd_docs, odd_rows, block):
    text = odd_rows[10][1].split()
    items = [(3, " ".join(text[5:30])), (12, " ".join(text[20:32]).upper()), (12, " ".join(text[20:32])), (4, None), (5, ""),
             (None, " ".join(text[40:60])), (6, "Two"), (7, "x" * 5000), (8, odd_rows[14][1]), (9, "nowhere to be found " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = tuples(decontaminate.contamination(odd_docs, bench, block=block),
                 "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = simple_hits(odd_rows, items)
    assert got == want
    kept = decontaminate.drop_contaminated(odd_docs, bench, block=block)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(w[0] for w in want if not w[5])


# -- quality -----------------------------------------------------------------------

def simple_counts(t):
    w = WORD.findall(t)
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {i + j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_quality_counts(spark, case):
    df, rows = case
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(3, None, None), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality(df, labels)
    want = sorted(((r[0], *(c := simple_counts(r[1] or "")), c[0] < 10 or 100 * c[4] > 20 * c[0]) for r in rows), key=repr)
    assert tuples(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]


def test_quality_trees_are_monotonic_and_accurate(spark):
    rows = quality.measured(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(labels, rows["__llm_d"] == labels["doc_id"]).toPandas()
    x, y = np.array(got["stats"].tolist()), got["quality"].to_numpy(float)
    held = got["doc_id"].to_numpy() % 3 == 0
    trees = quality.fit(x[~held], y[~held], list(quality.FEATURES.values()))
    assert ((trees.score(x[held]) >= 0.5) == y[held]).mean() > 0.95
    for j, (name, sign) in enumerate(quality.FEATURES.items()):
        more = x.copy()
        more[:, j] += 0.05
        if sign:
            assert (trees.score(more) <= trees.score(x) + 1e-12).all(), name


# -- language ID -------------------------------------------------------------------

def test_language_id(spark, odd_docs, odd_rows):
    def has_letter(t):
        return t is not None and any(c.isalpha() for c in t)
    got = langid.language_id(odd_docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"] != "und") for r in got) == Counter(
        (r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2, has_letter(r[1])) for r in odd_rows)
    assert {r["lang_pred"] for r in got} == {"xx", "yy", "und"}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(r[1] for r in odd_rows if r[1] and any(c.isalpha() for c in r[1]))


def test_words_are_letters_with_their_marks(spark):
    for text in ("½", "²", "Ⅷ", "①", "12 ³", "_ 7 \u0301", "٣", ""):
        assert langid.words_of(text) == [], text
    assert langid.words_of("हिन्दी Été e\u0301te\u0301 x²y 漢字7_a ª") == ["हिन्दी", "été", "e\u0301te\u0301", "x", "y", "漢字", "a", "ª"]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("plain words", "xx"), ("autres mots", "yy")] * 20 + [
        ("½ ²", "xx"), ("Ⅷ", None), ("mots", None)])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(docs).collect()}
    assert got[40] == got[41] == "und" and got[42] == "yy"
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_identified(docs).collect()}
    assert 40 not in kept and 41 not in kept and kept[42] == "yy" and kept[0] == "xx"  # a missing label is filled in


def test_language_scores_by_hand(spark):
    """Counts, backoff and score of every document in plain Python, with a small vocabulary that is dealt over the languages."""
    rnd = random.Random(9)
    stems = {"aa": ["kal", "mor", "tip"], "bb": ["sen", "wul", "grak"], "cc": ["ixo", "ezu", "kal"]}
    rows = []
    for i in range(240):
        lang = "aa" if i % 4 else "bb" if i % 8 else "cc"
        rows.append((i, " ".join(rnd.choice(stems[lang]) + rnd.choice(["", "a", "om", "isti"]) for _ in range(rnd.randint(1, 30))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_words=15, max_grams=30)
    langs = ["aa", "bb", "cc"]

    def top(counts, most):
        kept = set()
        for c in counts.values():
            order = sorted(c.values(), reverse=True)
            bound = next((n for n in sorted(set(order)) if sum(x >= n for x in order) <= most // len(langs)), 2**62)
            kept |= {g for g, n in c.items() if n >= bound}
        total = {lang: sum(counts[lang][g] + .5 for g in kept) + .5 for lang in langs}
        return {g: [np.log((counts[lang][g] + .5) / total[lang]) for lang in langs] for g in kept}
    words = {lang: Counter() for lang in langs}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            words[lang].update(text.split())
    known, grams = top(words, 15), {}
    for n in langid.GRAMS:
        c = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, times in words[lang].items():
                x = f"<{w}>" if n > 1 else w
                for k in range(len(x) - n + 1):
                    c[lang][x[k: k + n]] += times
        grams[n] = top(c, 30)
    assert set(model.words) == set(known) and all(set(model.grams[n][0]) == set(grams[n]) for n in langid.GRAMS)
    for _, text, _ in [*rows, (0, "kalxyz qqq senna", None)]:
        score, w = np.zeros(3), text.split()
        for x in w:
            if x in known:
                score += known[x]
                continue
            for n in langid.GRAMS:
                y = f"<{x}>" if n > 1 else x
                hits = [grams[n][y[k: k + n]] for k in range(len(y) - n + 1) if y[k: k + n] in grams[n]]
                if hits:
                    score += np.mean(hits, axis=0)
                    break
        p = np.exp((score - score.max()) * min(len(w), 20) / len(w))
        lang, s = model.predict(text)
        assert lang == langs[int(score.argmax())] and abs(s - 1 / p.sum()) < 1e-9


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98


# -- line dedup --------------------------------------------------------------------

def simple_lines(rows, k=line_dedup.SHINGLE, least=line_dedup.SIMILARITY):
    lines, occ = {}, defaultdict(list)
    for r in sorted({identity(r): r for r in rows}.values(), key=identity):
        for no, x in enumerate((r[1] or "").split("\n")):
            if x.strip():
                occ[x].append((*identity(r), no))
                lines.setdefault(x, line_dedup.shingles(x, k))
    names = list(lines)
    linked = []
    for i, a in enumerate(names):
        for b in names[:i]:
            m, n = len(lines[a]), len(lines[b])
            if min(m, n) >= least * max(m, n) and line_dedup.jaccard(lines[a], lines[b]) >= least:
                linked.append((a, b))
    comp = groups(names, linked)
    keep: dict = {}
    for x, places in occ.items():
        keep[comp[x]] = min([keep.get(comp[x], places[0]), *places])
    gone = {p for x, places in occ.items() for p in places if p != keep[comp[x]]}
    out = []
    for r in rows:
        t = r[1]
        split = [] if t is None else t.split("\n")
        left = [x for no, x in enumerate(split) if (*identity(r), no) not in gone]
        out.append((r[0], len(split), len(split) - len(left), None if t is None else "\n".join(left)))
    return sorted(out, key=repr)


def test_line_dedup(case):
    df, rows = case
    got = tuples(line_dedup.line_report(df), "doc_id", "n_lines", "n_removed", "text")
    assert got == simple_lines(rows)


def test_line_dedup_keeps_columns(odd_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where("n_chars <> char_length(text)").count() == 0


def test_band_recall():
    """Lines at a similarity just above 0.8 share a band bucket almost always."""
    rng = np.random.default_rng(3)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choice(list("abcdefghij"), 200))
        b = list(a)
        for i in rng.choice(200, rng.integers(1, 4), replace=False):
            b[i] = "z"
        b = "".join(b)
        if line_dedup.jaccard(line_dedup.shingles(a), line_dedup.shingles(b)) >= 0.8:
            pairs.append((a, b))
    x, y = (line_dedup.band_keys([p[i] for p in pairs]) for i in (0, 1))
    assert (x == y).any(1).mean() >= 0.98


def edited(rng, line, n):
    out = list(line)
    for i in rng.choice(len(line), n, replace=False):
        out[i] = "z"
    return "".join(out)


def letters(rng, n):
    return "".join(rng.choice(list("abcdefghij"), n))


@pytest.mark.parametrize("most", [1000, 4])
def test_line_dedup_stars_and_chains(spark, most, monkeypatch):
    """Groups that hang together only through lines that are neither first nor last of a bucket."""
    monkeypatch.setattr(line_dedup, "MOST", most)
    rng = np.random.default_rng(5)
    lines = []
    for _ in range(6):
        template = letters(rng, 200)
        lines += [template, *(edited(rng, template, 2) for _ in range(30))]
        chain = [letters(rng, 200)]
        for _ in range(20):
            chain.append(edited(rng, chain[-1], 2))
        lines += chain
    order = rng.permutation(len(lines))
    rows = [(i, "\n".join(lines[j] for j in order[i::40]), None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = tuples(line_dedup.line_report(docs), "doc_id", "n_lines", "n_removed", "text")
    want = simple_lines(rows)
    assert sum(w[2] for w in want) >= 290
    missed = sum(w[2] for w in want) - sum(g[2] for g in got)
    assert missed <= 2 and all(set(w[3].split("\n")) <= set(g[3].split("\n")) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("most", [1000, 40])
def test_line_dedup_hot_mixed_bucket(spark, most, monkeypatch):
    """Lines with common boilerplate that share one bucket only, in several batches: all true pairs are found."""
    from vaultline.llm.common import Scratch
    monkeypatch.setattr(line_dedup, "MOST", most)
    rng = np.random.default_rng(6)
    common = letters(rng, 80)
    lines = []
    for _ in range(150):
        x = common + letters(rng, 120)
        lines += [x, edited(rng, x, 1)]
    lines = [lines[i] for i in rng.permutation(300)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::10])) for i in range(10)], "doc_id long, text string").repartition(3)
    names = [f"b{i}" for i in range(line_dedup.BANDS)]
    held = line_dedup.distinct_lines(docs).withColumn("line", F.monotonically_increasing_id())
    held = held.withColumns({n: F.lit(0).cast("long") if n == "b3" else F.xxhash64("line", F.lit(n)) for n in names})
    scratch = Scratch(spark, "lines")
    held = scratch.save(held, "lines")
    number = {r["line"]: lines[r["doc_id"]::10][r["line_no"]] for r in
              held.select("line", F.col("first.__llm_d").alias("doc_id"), "first.line_no").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        links = [(number[r["a"]], number[r["b"]]) for r in line_dedup.near_lines(
            docs, held, scratch, line_dedup.SHINGLE, line_dedup.SIMILARITY).select("a", "b").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = {x: line_dedup.shingles(x) for x in lines}
    true = [(x, y) for i, x in enumerate(lines) for y in lines[:i] if line_dedup.jaccard(sets[x], sets[y]) >= 0.8]
    assert len(true) >= 140
    got = groups(lines, links)
    assert [p for p in true if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) == len(set(groups(lines, true).values()))


# -- WARC --------------------------------------------------------------------------

def page_rows():
    big, small = "<p>" + "payload é " * 200, "<p>tiny"
    return [(1, "http://a.example/1", big), (2, "http://a.example/2", big), (9, None, big), (4, "http://b.example/", small),
            (5, "bad url\r\nX: y", small), (6, "u", None), (7, "u", ""), (8, "u", "x" * 300_000), (3, "u", "x" * 300_000),
            (9, None, big), (None, "n", big), (None, "n", "y" * 2000)]


@pytest.mark.parametrize("frame, bundle", [(128 * 1024, 8 << 20), (500, 3000)])
def test_warc_round_trip(spark, frame, bundle, tmp_path):
    from vaultline.llm.common import Scratch
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    bundles = warc.write_bundles(pages, Scratch(spark, "warc"), frame_bytes=frame, bundle_bytes=bundle)
    got = [r.asDict() for r in warc.read_bundles(bundles).collect()]
    top: dict = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            top[raw] = max(top.get(raw, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = top.get(raw)
        again = first is not None and first != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None,
                     None if again else raw))
    assert sorted(((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"],
                    None if g["payload"] is None else bytes(g["payload"])) for g in got), key=repr) == sorted(want, key=repr)
    for row in bundles.collect():  # each record by its place, and the whole file as a plain stream
        for x in row["index"]:
            head, _ = warc.parse(warc.read_record(row["content"], x["frame"], x["offset"], x["length"]))
            assert head["WARC-Record-ID"] == f"<urn:page:{'' if x['page_id'] is None else x['page_id']}>"
        warc.export(row, str(tmp_path / row["bundle"]))
        import zstandard
        with open(tmp_path / row["bundle"], "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == len(row["index"])


# -- packing -----------------------------------------------------------------------

@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(case, capacity):
    from tokenizers import Tokenizer
    df, rows = case
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s:s + capacity], "<u4").tobytes()
            want.append((r[0], k, s, len(part) // 4, zlib.crc32(part)))
    out = packing.pack(df, capacity=capacity).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out), key=repr) == sorted(want, key=repr)
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    best = -(-sum(w[3] for w in want) // capacity)
    assert len(seqs) <= best * 1.05 + 1


def test_plan_uses_patterns_and_covers_everything():
    rng = np.random.default_rng(2)
    hist = np.zeros(257, np.int64)
    np.add.at(hist, rng.integers(1, 257, 20_000), 1)
    plan = packing.Plan(hist, 256)
    used = np.zeros_like(hist)
    fill = np.zeros(plan.n_sequences, np.int64)
    for length, _, n, seq, offset in sorted(plan.runs, key=lambda r: r[4]):
        used[length] += n
        assert (fill[seq:seq + n] == offset).all()
        fill[seq:seq + n] += length
    assert (used == hist).all() and fill.max() <= 256
    assert plan.n_sequences <= -(-int((hist * np.arange(257)).sum()) // 256) * 1.02


def test_words_beyond_the_first_plane():
    """Emoji separate words and texts without letters beyond the first plane are cut by its ranges alone."""
    whole, first = langid._word(0x10FFFF), langid._word(0xFFFF)
    assert len(first.pattern) < len(whole.pattern) and first.findall("a\U00010428b") == ["a", "b"]
    for text in ("a\U0001f600b \U0001f600 Été", "\U00010400x \U0001f600y\U00010428", "x\U0001e8d0y", "\U00020000漢 हिन्दी\U0001f600", "\U0001f600", "plain words, no more"):
        assert langid.words_of(text) == whole.findall(text.lower()), text
