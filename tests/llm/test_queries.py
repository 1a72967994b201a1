"""The opN queries' columns against brute force on the smallest tables, and the trained models against plain versions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from meristem.llm import language_id, matroska, pii, quality, queries, word_tokens

LOWER = {k: k + 32 for k in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, small, name):
    return queries.queries()[name](spark, small).collect()


def test_op1(spark, small, texts):
    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    # The contract's base patterns.
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rows = result(spark, small, "op1_pii")
    assert len(rows) == len(texts)
    for r in rows:
        spans = [(k, m.start(), m.end()) for k in base for m in re.finditer(base[k], texts[r["doc_id"]] or "") if passes(k, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in base] == [sum(s[0] == k for s in spans) for k in base]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(","))


def test_op2(spark, small, texts):
    items = {}
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = WORDS.findall((r["text"] or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            items.setdefault(tuple(w[i : i + 10]), set()).add(str(r["item_id"]))
    sizes = {len(x) for x in items}
    for r in result(spark, small, "op2_decontaminate"):
        w = WORDS.findall((texts[r["doc_id"]] or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := items.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_op6(spark, small, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and top[a] != top[b]:
                lo, hi = sorted((top[a], top[b]))
                top = {i: lo if c == hi else c for i, c in top.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result(spark, small, "op6_near_dedup")} == {i: (len(sets[i]), c, i == c) for i, c in top.items()}


def test_op7(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = result(spark, small, "op7_packing")
    own, used = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_every_code_point_of_the_fast_path():
    import public_tokenizers

    t = word_tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(1, 0x250):
        c = chr(i)
        for text in (f"a{c}b", f" {c} ", f"x{c}", f"{c}y's 12{c}3", f"{c}{c}"):
            assert t.encode(text) == t.whole(text), (i, text)


def test_op8_and_op9(spark, small, texts):
    for name, folds, kept in (("op8_language_id", 3, 1), ("op9_quality", 5, 0)):
        rows = result(spark, small, name)
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == kept) and 0 <= r["score"] <= 1
            if name == "op9_quality":
                assert r["predicted"] == int(r["score"] >= 0.3)
            elif not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
                assert r["lang_pred"] == "und"


def test_op10(spark, small, texts):
    for r in result(spark, small, "op10_matroska"):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(raw[-16:]))


def test_op10_tail_is_of_the_payload_read_back(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, "a" * 191), (3, "b" * 192), (4, "é" * 97), (5, "tail   ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["tail_crc32"] for r in queries.op10_matroska(spark, str(tmp_path)).collect()}
    assert got == {i: zlib.crc32(matroska.payload_of((t or "").encode())[-16:]) for i, t in rows}


def test_matroska_faults_end_in_an_error():
    head = matroska._element(matroska.EBML, b"")
    nested = b""
    for _ in range(3000):
        nested = matroska._element(matroska.SEGMENT, nested)
    assert "nested" in matroska.parse(head + nested).error
    block = matroska._element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + b"x" * 8)
    cluster = matroska._element(matroska.CLUSTER, matroska._uint(matroska.TIMESTAMP, 1 << 40) + block)
    info = matroska._element(matroska.INFO, matroska._uint(matroska.TIMESTAMP_SCALE, 1 << 40))
    assert "64 bits" in matroska.parse(head + matroska._element(matroska.SEGMENT, info + cluster)).error


def test_em_over_counts_equals_em_over_candidates():
    rng = np.random.default_rng(8)
    votes = [tuple(int(x) for x in rng.integers(-1, 2, pii.LABELERS)) for _ in range(12)]
    patterns = sorted({(int(rng.integers(0, 4)), v, float(rng.integers(1, 6))) for v in votes})
    got, rates = pii.em(patterns, rounds=15)
    kind = np.concatenate([[k] * int(n) for k, _, n in patterns])
    v = np.concatenate([[x] * int(n) for _, x, n in patterns])
    p = np.clip(0.5 + 0.2 * v.sum(axis=1), 0.05, 0.95)
    for _ in range(15):
        table = np.zeros((pii.LABELERS, 2, 3))
        for k in range(pii.LABELERS):
            for x in (-1, 0, 1):
                mine = v[:, k] == x
                table[k, 1, x + 1], table[k, 0, x + 1] = p[mine].sum(), (1 - p)[mine].sum()
            table[k] += [[4, 4, 1], [1, 4, 4]]
            table[k] /= table[k].sum(axis=1, keepdims=True)
        prior = {k: (p[kind == k].sum() + 1) / ((kind == k).sum() + 2) for k in set(kind.tolist())}
        like = lambda truth: np.prod([table[k, truth][v[:, k] + 1] for k in range(pii.LABELERS)], axis=0)  # noqa: B023, E731
        one, none = np.array([prior[k] for k in kind.tolist()]) * like(1), np.array([1 - prior[k] for k in kind.tolist()]) * like(0)
        p = one / (one + none)
    at = np.cumsum([0, *(int(n) for _, _, n in patterns)])[:-1]
    assert np.allclose(got, p[at], atol=1e-9) and np.allclose(rates, table, atol=1e-9)


def test_span_classifier_follows_its_labels():
    terms = np.array([pii._terms(3, (1, 1, 3, 1, 0)), pii._terms(3, (2, 2, 0, 2, 0))])
    w = pii.fit_classifier(terms, np.array([0.95, 0.05]), np.array([200.0, 300.0]))
    q = 1 / (1 + np.exp(-w[terms].sum(axis=1)))
    assert abs(q[0] - 0.95) < 0.03 and abs(q[1] - 0.05) < 0.03


def test_ftrl_equals_a_dense_version():
    rng = np.random.default_rng(1)
    dims, classes, alpha, beta, l1, l2 = 12, 3, 0.5, 1.0, 1e-3, 1e-4
    rows = []
    for _ in range(40):
        i = np.sort(rng.choice(dims, 4, replace=False))
        rows.append((i, rng.random(4), int(rng.integers(0, classes))))
    w, b = language_id.fit_ftrl(rows, dims, classes, epochs=2)
    x = np.zeros((40, dims + 1))
    for k, (i, v, _) in enumerate(rows):
        x[k, i], x[k, dims] = v, 0.3
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    solve = lambda: np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(40):
            own = solve()
            p = np.exp(x[k] @ own)
            g = np.outer(x[k], p / p.sum() - np.eye(classes)[rows[k][2]])
            z, n = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * own, n + g * g
    assert np.allclose(w, solve()[:dims]) and np.allclose(b, solve()[dims] * 0.3)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.random((30, 6))
    y = np.where(x[:, 0] + 0.3 * rng.random(30) > 0.6, 1.0, -1.0)
    cost = np.full(30, 1.0)
    w = quality.fit_svm([(np.arange(6), r) for r in x], y, 6, cost, epochs=400)
    full = np.column_stack([x, np.ones(30)]) * y[:, None]
    q, a = full @ full.T, np.zeros(30)
    for _ in range(60_000):  # projected gradient on the dual
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, cost)
    loss = lambda u: 0.5 * u @ u + np.maximum(0, 1 - full @ u).sum()
    # Descent stops where no dual gradient is above 1e-3, which bounds the gap by that for each row's cost.
    assert loss(w) <= loss(full.T @ a) + 1e-3 * cost.sum()


@pytest.mark.parametrize("name", ["op2_decontaminate", "op6_near_dedup"])
def test_twins(spark, small, name):
    con = duckdb.connect()
    for f in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{small}/{f}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in result(spark, small, name)) == sorted(want.fetchall())


def test_words_are_cut_into_pre_tokens_once():
    import public_tokenizers

    t = word_tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), cache_words=50)
    text = "It's  x's, ''s ..'s\tdon't 12a3 \n(the) the the, " + "a,b" * 40
    assert t.encode(text) == t.whole(text)
    # The words between white space are cached as they are, so a second text needs no cutting; the bound holds for all entries.
    assert {"x's,", "(the)", "the,"} <= set(t.ids.__self__) and "a,b" * 40 not in t.ids.__self__
    assert t.encode(" ".join(f"w{i}," for i in range(500))) == t.whole(" ".join(f"w{i}," for i in range(500))) and len(t.ids.__self__) <= 50
