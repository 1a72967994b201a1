"""Training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meristem.llm import decontaminate as dec
from meristem.llm import language_id, line_dedup, matroska, near_dedup, packing, pii, quality, token_counts, warc
from meristem.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

LOWER = {k: k + 32 for k in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, texts, **more):
    rows = [(i, t, None, "src") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    stock = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(words)]
    return " ".join(rng.choice(stock, n))


# FM-index -------------------------------------------------------------------------------------------------------------


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        text = rng.integers(0, 4, n)
        seps = np.flatnonzero(text == 0)
        order = {int(p): k for k, p in enumerate(seps)}
        key = lambda i: [(0, order[j]) if text[j] == 0 else (1, int(text[j])) for j in range(i, n)]  # noqa: B023, E731
        assert suffix_array(text).tolist() == sorted(range(n), key=key)
        tree = WaveletMatrix(text, 4)
        for c in range(4):
            assert tree.rank(np.full(n + 1, c), np.arange(n + 1)).tolist() == [int((text[:i] == c).sum()) for i in range(n + 1)]


def test_search_and_locate():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 5, 400)
    index = FMIndex(text, 5, sample=4)
    for length in (1, 2, 3):
        pattern = rng.integers(1, 5, (20, length))
        lo, hi = index.search(pattern, np.full(20, length))
        for p, a, b in zip(pattern, lo, hi):
            want = [i for i in range(401 - length) if text[i : i + length].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# Decontamination ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontaminate(spark, block_bytes):
    items = [("a", prose(1, 30)), ("b", prose(2, 12)), ("c", "only four words here"), ("d", ""), ("e", None), (None, "lost row text"), ("a", prose(1, 30))]
    passage = items[0][1].split()
    texts = [None, "", prose(5, 300), "x " + " ".join(passage[3:16]).upper() + " y", "Only, FOUR words; here! é only four words hereé", prose(6, 50) + " " + items[1][1] + " tail " + items[1][1], " ".join(passage[:9]), "word " * 20000 + items[1][1]]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("n_hit", F.lit(7))
    found = {r["doc_id"]: r for r in dec.decontaminate(docs(spark, texts), bench, block_bytes=block_bytes).collect()}
    windows = defaultdict(set)
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER)) if item else []
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[i : i + 10])].add(item)
    for i, text in enumerate(texts):
        w = WORDS.findall((text or "").translate(LOWER))
        hit, own = np.zeros(len(w), bool), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = True
                    own |= windows[tuple(w[k : k + n])]
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), int(hit.sum()), sorted(own)), i
        assert sum(len(WORDS.findall(text[s["start"] : s["end"]].translate(LOWER))) for s in r["spans"]) == r["n_hit"]
    assert dec.decontaminate(docs(spark, texts), bench.where("false")).where("n_hit > 0").isEmpty()
    assert dec.decontaminate(docs(spark, texts).where("false"), bench).isEmpty()


# Lines ----------------------------------------------------------------------------------------------------------------


def test_dedup_lines(spark):
    texts = ["A shared line here\nown zero\nA shared line here", None, "", "  a SHARED line here\t\nshort\nunique line number three", "short\nA shared line here\nÉéééééééé1 words", "éÉéééééééé1 words\nÉéééééééé1 words\n\n"]
    df = docs(spark, texts).unionAll(spark.createDataFrame([(3, "A shared line here\nsecond row of three", None, "s"), (None, "A shared line here", None, "s")], docs(spark, []).schema))
    got = line_dedup.dedup_lines(df, batches=3).collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "A shared line here\nsecond row of three")]
    for i, t in sorted(rows, key=lambda r: r[0]):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owner.setdefault(key(x), i)
    want = sorted((i, "\n".join(x for x in (t or "").split("\n") if owner.get(key(x), i) == i), len((t or "").split("\n"))) for i, t in rows)
    assert sorted((r["doc_id"], r["text"] or "", r["__n_lines"]) for r in got if r["doc_id"] is not None) == want
    assert [r["text"] for r in got if r["doc_id"] is None] == ["A shared line here"] and got[0].asDict().keys() >= {"lang", "source"}
    assert line_dedup.dedup_lines(df.where("false")).isEmpty()


def test_line_store_levels(spark):
    store = line_dedup.LineStore(spark, fanout=2, buckets=2)
    for b in range(5):
        store.add(spark.createDataFrame([(h, 0, b) for h in range(b, b + 4)], "h1 bigint, h2 bigint, doc_id bigint"))
    assert sorted((r.h1, r.doc_id) for r in store.owners().collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4)]
    assert [len(x) for x in store.levels] == [1, 0, 1]
    store.drop()


# Near duplicates ------------------------------------------------------------------------------------------------------


def brute_components(rows, least=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= least * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("small", [512, 6])
def test_near_duplicates(spark, small):
    rng = np.random.default_rng(3)
    base = [prose(k, 120).split() for k in range(3)]
    texts = [None, "", "  \n", "one two three", "ONE two\tthree", "one two three four five", "lonely", prose(99, 4000)]
    for b in base:
        for _ in range(25):
            w = list(b)
            for at in rng.integers(0, len(w), rng.integers(0, 7)):
                w[at] = f"edit{rng.integers(1e6)}"
            texts.append(" ".join(w))
        texts += [" ".join(b)] * 3
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df.withColumn("kept", F.lit("clash")), small=small).collect()}
    want = brute_components(list(enumerate(texts)))
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_duplicates_repeated_ids_and_empty(spark):
    a, b = prose(1, 60), prose(2, 60)
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (2, b), (None, a), (9, "solo words of its own")], "doc_id int, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1), (2, 2), (5, 2), (5, 2), (7, 2), (9, 9)]
    assert near_dedup.near_duplicates(df.where("false")).isEmpty()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "a bigint, b bigint")
    got = {r.v: r.c for r in near_dedup.components(links, "path").collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


# Packing --------------------------------------------------------------------------------------------------------------


def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "Hello world's it'll 1/2 ... Straße", "ΣΑΣ \x85 x\x1fy", prose(1, 30), prose(1, 30), prose(4, 9000)] + [prose(k, 7) for k in range(40)]
    rows = packing.pack(docs(spark, texts), capacity=256).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    used = 0
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
        used += 1
    assert rows.length.sum() / used / 256 > 0.9 or used <= 2
    assert packing.pack(docs(spark, []), capacity=256).isEmpty()


@pytest.mark.parametrize("text", ["end <|endoftext|> start", "<|startoftext|>x", "\u4e2d <|endoftext|>", "<|ENDOFTEXT|> a", *(f"a{chr(i)}b" for i in (0x130, 0x181, 0x186, 0x18F, 0x190, 0x193, 0x23A, 0x24E))])
def test_pack_ids_of_added_tokens_and_capitals(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
    (row,) = packing.pack(docs(spark, [text]), capacity=256).collect()
    assert (row["length"], row["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_histogram_patterns_hold_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(30):
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 20), rng.integers(1, 50, 20))}
        patterns = packing.pack_histogram(h, 64)
        placed = defaultdict(int)
        for p, n in patterns:
            assert sum(p) <= 64
            for k in p:
                placed[k] += n
        assert placed == h


# Language and quality -------------------------------------------------------------------------------------------------


def test_language(spark):
    a, b = ["the cat and the dog", "over the hills they went", "this is what that was"], ["der hund und die katze", "über alle berge gingen sie", "das ist was jenes war"]
    rows = [(i, a[i % 3] + f" {i}", "en", "en") for i in range(60)] + [(100 + i, b[i % 3] + f" {i}", "de", "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, __x string")
    model = language_id.train(df)
    asked = spark.createDataFrame([(0, "the dog and the cat"), (1, "die katze und der hund"), (2, None), (3, ""), (4, "12 !? 34"), (5, "der hund " * 30000)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["__lang"], r["__score"]) for r in language_id.predict(asked, model).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "de"] and got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.train(df.where("false"))
    assert {r["__lang"] for r in language_id.predict(asked, empty).collect()} == {"und"}


def test_quality(spark):
    good, bad = [prose(k, 40) for k in range(60)], [" ".join(w + "%%%" for w in prose(k, 40).split()) for k in range(30)] + ["spam " * 40] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id bigint, label int")
    model = quality.train(df, lab)
    asked = spark.createDataFrame([(0, prose(500, 50)), (1, "x%%% y%%% z%%% w%%%"), (2, "echo " * 50), (3, None), (4, "")], "doc_id bigint, text string")
    s = {r["doc_id"]: r["__score"] for r in quality.score(asked, model).collect()}
    assert s[0] > 0.5 > s[1] and s[2] < 0.5 and s[3] == s[4] and all(0 <= x <= 1 for x in s.values())
    one = quality.train(df, lab.where("label = 1"))
    assert len({round(r["__score"], 9) for r in quality.score(asked, one).collect()}) == 1


# Personal data --------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_pii_base_and_added_spans(spark):
    texts = [None, "", "a@b.c-x_y@d.e.f 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "+1 (2) 34.56-78 é😀 +12345678901234567 x@y.z", "é" * 50 + "+1 (743) 555-3824", "0001.002.3.255 1.2.3", "x@y..z @a.b a@b", "9" * 30000, "1 " * 20000, "a." * 20000 + "@b", "a@b.c@d.e.f"]
    texts += ["call me: write to john [at] mail (dot) com or phone 415 555 1234 please"] + [f"reach +1 (415) 555-{1000 + k} or u{k}@mail.example.com or 10.0.{k}.7" for k in range(40)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], t or "") if passes(k, m.group())]
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[i]["base"]] == want, i
        assert {tuple(s) for s in got[i]["base"]} <= {tuple(s) for s in got[i]["spans"]}
    extra = [texts[13][s["start"] : s["end"]] for s in got[13]["spans"]]
    assert "john [at] mail (dot) com" in extra
    assert pii.find(docs(spark, [])).isEmpty()


# Token counts ---------------------------------------------------------------------------------------------------------


def test_token_tree_edits():
    split, count = token_counts.counter()
    rng = np.random.default_rng(4)
    bits = ["a", " ", "  ", "\n", "\n\n", "'s", "x1", "é", "...", "   y", "the "]
    for start in ("", "word", prose(1, 300), "a b  c\n\n d" * 40):
        tree = token_counts.TokenTree(start, split, count)
        for _ in range(60):
            tree.edit(int(rng.integers(0, len(tree.text) + 3)), int(rng.choice([0, 1, 2, 5, 40, 300])), "".join(rng.choice(bits, int(rng.choice([0, 1, 3, 10])))))
            parts = split(tree.text)
            assert [s for b in tree.sizes for s in b] == list(map(len, parts))
            assert tree.total == sum(map(count, parts)) and tree.chars[1] == len(tree.text)


def test_edited_counts(spark):
    df = docs(spark, [None, "", prose(1, 100)])
    e = F.array(F.struct(F.lit(3).alias("start"), F.lit(2).alias("length"), F.lit(" new ").alias("insert")), F.lit(None))
    got = {r["doc_id"]: r for r in token_counts.edited_counts(df, e, ["doc_id"]).collect()}
    split, count = token_counts.counter()
    for r in got.values():
        assert r["tokens_after"] == sum(map(count, split(r["text_after"])))
    assert got[0]["tokens_before"] == 0 and got[2]["n_encoded"] < 20
    assert token_counts.edited_counts(df.where("false"), e, ["doc_id"]).isEmpty()


def test_stored_trees_take_batch_after_batch(spark):
    split, count = token_counts.counter()
    texts = {0: None, 1: "", 2: prose(3, 2000), 3: prose(4, 30), 4: "same", 5: "same"}
    rows = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id bigint, text string").withColumn("blocks", F.lit("clash"))
    trees = token_counts.tree_table(rows.drop("blocks"), ["doc_id"])
    now = {i: t or "" for i, t in texts.items()}
    for turn in range(3):
        batch = spark.createDataFrame([(2, [(5, 3, " new words here"), (900, 700, "")]), (3, [(0, 0, "Start "), None]), (1, [(9, 9, "x y")]), (5, None)], f"doc_id bigint, edits {token_counts.EDITS}")
        for i, edits in ((2, [(5, 3, " new words here"), (900, 700, "")]), (3, [(0, 0, "Start ")]), (1, [(9, 9, "x y")])):
            for a, n, new in edits:
                now[i] = now[i][: min(a, len(now[i]))] + new + now[i][min(a, len(now[i])) + n :]
        done = token_counts.edited_trees(trees, batch, ["doc_id"])
        got = done.collect()
        assert len(got) == 7
        for r in got:
            assert r["text"] == r["text_after"] == now[r["doc_id"]] and r["tokens_after"] == sum(map(count, split(now[r["doc_id"]])))
            assert r["n_encoded"] < 60 and np.frombuffer(r["sums"], "<u4")[1] == r["tokens_after"]
        trees = spark.createDataFrame(done.select("doc_id", *token_counts.TREE).collect(), trees.select("doc_id", *token_counts.TREE).schema)


# Fixity ---------------------------------------------------------------------------------------------------------------


def test_audit_finds_every_fault(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 3, "clash") for i in range(600)] + [(None, "x", "y", ""), (601, None, None, ""), (602, "u", "<é>" * 100_000, "")], "page_id bigint, url string, html string, slot string")
    store = warc.lay_out(pages)
    damaged = pages.where("page_id IS NULL OR page_id <> 300").withColumn("html", F.when(F.col("page_id") == 5, "<p>X</p>").otherwise(F.col("html")))
    copy = warc.lay_out(damaged.unionAll(spark.createDataFrame([(700, "new", "n", "")], pages.schema)))
    copy = copy.withColumn("record", F.when(F.col("page_id") == 602, F.expr("substring(record, 1, 500)")).otherwise(F.col("record")))
    got = {r["file"]: r for r in warc.audit(store, copy).collect()}
    assert [[x.split(":")[0] for x in got[f]["bad"].split(",")] for f in (0, 1, 2)] == [["changed"], ["lost"], ["torn", "extra"]]
    # A shorter or a lost record moves all that follow it in its file.
    assert [(got[f]["n_records"], got[f]["n_moved"]) for f in (0, 1, 2)] == [(256, 250), (256, 211), (90, 0)]
    at = {r["page_id"]: r["record"] for r in store.where("page_id < 4").collect()}
    offset, length = (sum(len(at[i]) for i in range(3)), len(at[3]))
    one = warc.audit(store, store.withColumn("record", F.when(F.col("page_id") == 3, F.expr("overlay(record PLACING cast('!' AS binary) FROM 9)")).otherwise(F.col("record"))))
    assert {r["file"]: (r["bad"], r["n_nodes"], r["n_moved"]) for r in one.where("NOT matches").collect()} == {0: (f"changed:{offset}+{length}", 1, 0)}
    assert all(r["matches"] and r["n_bad"] == 0 for r in warc.audit(store, store).collect())
    assert warc.audit(store.where("false"), store.where("false")).isEmpty()


def test_repeated_record_ids_share_a_leaf(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (2, "u", "a")], "page_id int, url string, html string")
    (row,) = warc.audit(warc.lay_out(pages), warc.lay_out(pages.orderBy(F.desc("html")))).collect()
    assert row["matches"] and row["n_records"] == 2
    (row,) = warc.audit(warc.lay_out(pages), warc.lay_out(pages.where("html = 'a'"))).collect()
    assert row["n_bad"] == 1 and row["bad"].startswith("changed:0+")


# Matroska -------------------------------------------------------------------------------------------------------------


def test_matroska_round_trip(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 191, 192, 193, 1536, 3000, 25000, 120000):
        raw = rng.bytes(n)
        payload = matroska.payload_of(raw)
        media = matroska.parse(data := matroska.mux(payload))
        assert media.error is None and b"".join(data[o : o + s] for _, _, o, s, _, _ in media.packets) == payload
        assert [p for _, _, p in media.cues] == media.clusters and len(media.tracks) == 1
        for cut in range(0, len(data), max(1, len(data) // 40)):
            matroska.parse(data[:cut])
    texts = [None, "", "é" * 700, prose(1, 30000)]
    stored = matroska.store(docs(spark, texts), "text")
    for r in matroska.features(stored, ["doc_id"]).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(matroska.payload_of(raw)).hexdigest(), zlib.crc32(raw[-16:]))
    packets = matroska.packet_table(stored, "__media", ["doc_id"])
    assert packets.where("doc_id = 3").agg(F.sum("size")).first()[0] == len(matroska.payload_of(texts[3].encode()))
    assert packets.where("error IS NOT NULL").isEmpty()
    broken = matroska.packet_table(stored.withColumn("__media", F.expr("substring(__media, 1, length(__media) - 7)")), "__media", ["doc_id"])
    assert broken.where("error IS NOT NULL").count() == 4


def test_matroska_unknown_sizes():
    m = matroska
    block = m._element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + b"abc")
    head = m._HEADER + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m._TRACKS
    cluster = lambda t: m.CLUSTER.to_bytes(4, "big") + b"\xff" + m._uint(m.TIMESTAMP, t) + block
    media = m.parse(head + cluster(0) + m._element(0xEC, b"\x00" * 9) + block + cluster(50))
    assert media.error is None and len(media.clusters) == 2 and [p[1] for p in media.packets] == [0, 0, 50_000_000]


def test_arrow_views():
    from meristem.llm._shared import utf8_views

    data, offsets = utf8_views(pa.array(["ab", None, "é"]).slice(1))
    assert data.tobytes().decode() == "é" and offsets.tolist() == [0, 0, 2]
