"""Token alignment, secret scans and ranked search against brute force on small tables, edge cases included."""
import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check import compare, duck
from tideline.llm import alignment, best_position, secret_scan
from tideline.llm.common import start

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
ROWS = [
    (1, "The quick brown fox, the LAZY dog.", "x"), (2, None, None), (3, "", "y"), (4, " \n\t  ", "z"), (5, LONG, "x"), (5, LONG, "x"), (6, f"{LONG} Ä tail", "x"),
    (7, "emoji \U0001f600\U0001f468‍\U0001f469 中文字 ß ▁ <|endoftext|> <s> <0x41>", "x"), (8, f'password = "{KEY}" API_KEY:{KEY} ſecret={KEY} toKen=short', "x"), (9, f"é AKIA{'Z9' * 8} {KEY}{KEY}", "x"),
    (None, "secret : 'abcdefghij.l='", "x"), (10, "one two three one", "x"), (11, "one two three one", "x"), (12, "ONE\x00two", "x"), (13, "a b c\u0085d", "x"), (14, "apikey='{}'".format("q" * 11), "x"),
]
SCHEMA = "doc_id bigint, text string, lang string"
EXTRA = ["score", "rank", "item_id", "chunk", "docs", "links", "pairs", "counts", "spans", "kind", "n", "at", "pair", "top", "terms", "n_terms", "item"]


@pytest.fixture(scope="module")
def docs(spark):
    start(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(c).alias(c) for c in EXTRA))


def own(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


# --- token alignment

def paths():
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path, _ = paths()
    a_own, b_own = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a_own.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    texts, totals = [], Counter()
    for doc, text in rows:
        a = b = []
        if text:
            ids = a_own.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(byte[c] for c in a_own.id_to_token(i))) for i in ids]
            b = [(i, bytes([int(b_own.id_to_piece(i)[3:5], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode()) for i in b_own.encode(text)]
            raw = (" " + text).encode()
            if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
                a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        holder = [j for j, (_, lo, hi) in enumerate(spans[1]) for _ in range(lo, hi)]
        links = [(spans[0][i][0], spans[1][j][0]) for i, (_, lo, hi) in enumerate(spans[0]) for j in sorted(set(holder[lo:hi]))]
        totals.update(links)
        ends = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        low, groups, shared = 0, [], 0
        starts = [{lo: k for k, (_, lo, _) in enumerate(s)} for s in spans]
        for end in ends:
            parts = []
            for s, where in zip(spans, starts):
                k, part = where[low], []
                while k < len(s) and s[k][2] <= end:
                    part.append(s[k][0])
                    k += 1
                parts.append(part)
            groups.append("|".join(",".join(map(str, p)) for p in parts))
            shared += len(parts[0]) * len(parts[1])
            low = end
        texts.append((doc, len(a), len(b), len(ends), links, shared, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, b), n in totals.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((d, na, nb, ng, len(ls), sh, sum(totals[x] == best[x[1]] for x in ls), sum(totals[x] for x in ls), s) for d, na, nb, ng, ls, sh, s in texts)


@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
def test_alignment_equals_brute_force(request, name, monkeypatch):
    table = request.getfixturevalue(name)
    got = Counter(tuple(r[c] for c in alignment.COLUMNS) for r in alignment.align(table, *paths()).collect())
    assert got == brute_alignment(own(table))


def test_alignment_of_a_small_corpus(spark):
    start(spark)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in alignment.COLUMNS) for r in alignment.align(spark.read.parquet(f"{SF}/documents.parquet"), *paths()).collect())
    assert got == brute_alignment(rows)


def test_both_readers_of_the_byte_level_vocabulary_agree():
    a_path, _, ranks = paths()
    both = alignment.ByteLevel(a_path, ranks)
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(1, 0x250, 300))) for _ in range(300)] + ["a" * 5000, " " * 1900 + "x", "x" + "\n" * 1999, "é" * 3000, "'re's'LL 12345 $$$ -- €"]
    assert all(alignment.PLAIN.fullmatch(t) for t in texts)
    assert both(texts) == [e.ids for e in both.own.encode_batch(texts, add_special_tokens=False)]


def test_sparse_product_equals_dense():
    rng = np.random.default_rng(2)
    for rows, inner, cols in [(7, 9, 5), (1, 1, 1), (4, 6, 8)]:
        dense = [rng.integers(0, 3, s) * (rng.random(s) < 0.5) for s in ((rows, inner), (inner, cols))]
        sparse = [alignment.Csr(np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))]), np.nonzero(d)[1], d.shape[1], d[d != 0]) for d in dense]
        got = alignment.product(*sparse)
        back = np.zeros((rows, cols), np.int64)
        back[got.row, got.indices] = got.values
        assert (back == dense[0] @ dense[1]).all()
        t = sparse[0].transposed()
        back = np.zeros((inner, rows), np.int64)
        back[t.row, t.indices] = t.values
        assert (back == dense[0].T).all()


def test_alignment_links(docs):
    plain = alignment.links(docs.where("doc_id in (1, 7)"), *paths()).collect()
    shared = alignment.links(docs.where("doc_id in (1, 7)"), *paths(), shared=True).collect()
    key = lambda r: (r["doc_id"], r["a_at"], r["b_at"], r["a_id"], r["b_id"], r["n_bytes"])
    assert set(map(key, plain)) == {key(r) for r in shared if r["n_bytes"]} and len(shared) > 0
    assert sum(r["n_bytes"] for r in plain if r["doc_id"] == 1) == len(ROWS[0][1]) + 1


# --- secret scans

PATTERNS = [
    (re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12),
    (re.compile("(AKIA[A-Z0-9]+)"), 18), (re.compile("([0-9a-f]+)"), 16)]


def brute_base(text):
    found = [(m.start(), k, m.end()) for k, (p, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[1]) >= least]
    shown = ",".join(f"{secret_scan.KINDS[k]}:{lo}:{hi}" for lo, k, hi in sorted(found))
    return tuple(sum(k == j for _, k, _ in found) for j in range(3)) + (hashlib.sha256(shown.encode()).hexdigest(),)


@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
def test_secret_patterns_equal_brute_force(request, name):
    table = request.getfixturevalue(name)
    rows = secret_scan.digest(secret_scan.scan(table, secret_scan.fit(table))).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == Counter((d, *brute_base(t)) for d, t in own(table))


def test_secret_patterns_of_a_small_corpus(spark):
    rows = entry.queries()["op12_secret_scan"](spark, SF).collect()
    texts = own(spark.read.parquet(f"{SF}/documents.parquet"))
    assert Counter((r["doc_id"], r["base_sha256"]) for r in rows) == Counter((d, brute_base(t)[-1]) for d, t in texts)


def test_models_find_random_strings_and_leave_identifiers(spark):
    start(spark)
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    syllables = ["read", "write", "buffer", "count", "Index", "node", "_size", "Of", "_max", "get", "Token", "_from", "List", "value"]
    ident = lambda: "".join(rng.choice(syllables, 5))
    secret = lambda n=32: "".join(rng.choice(letters, n))
    rows, planted = [], {}
    for i in range(400):
        words = [ident() for _ in range(30)]
        if i % 2:
            words[5] = f"token={secret()}"
        elif i % 8 == 0:
            words[9] = planted.setdefault(i, secret(40))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = secret_scan.fit(docs)
    found = {r["doc_id"]: [s["secret"] for s in r["spans"] if s["kind"] == "random"] for r in secret_scan.scan(docs, model).collect()}
    assert model.missed < 0.05 and model.cut < 40
    assert sum(any(len(s) >= 16 and s in p for s in found[i]) for i, p in planted.items()) >= 0.98 * len(planted)
    assert sum(bool(v) for i, v in found.items() if i not in planted) <= 2


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x = rng.normal(size=(3, 12))
        score, lo, hi = secret_scan.Model.best(x)
        brute = max(x[c, a:b].sum() for c in range(3) for a in range(13) for b in range(a, 13))
        assert math.isclose(score, brute, abs_tol=1e-9) and any(math.isclose(x[c, lo:hi].sum(), score, abs_tol=1e-9) for c in range(3))


# --- ranked search

def brute_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(d, Counter(terms(t))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for i, ts in wanted.items():
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out |= {(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


ITEMS = [(1, "quick fox w7919"), (2, "one two"), (2, "three"), (3, None), (4, ""), (None, "ONE"), (5, "nowhere to be seen"), (6, " ".join(f"w{x}" for x in range(300))), (2, "one two")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_search_equals_brute_force(spark, docs, clash, empty, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for table in (docs, clash, empty):
        got = {tuple(r) for r in best_position.search(table, items, block_bytes=block_bytes).collect()}
        assert got == brute_search(own(table), ITEMS)
    assert best_position.search(docs, items.limit(0)).count() == 0


def test_search_ties_across_tasks(spark):
    start(spark)
    rng = np.random.default_rng(1)
    rows = [(int(d), " ".join(f"t{x}" for x in rng.integers(0, 30, 6))) for d in rng.permutation(3000)]
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 30, 4))) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {tuple(r) for r in best_position.search(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute_search(rows, items)


def test_lists_stop_early_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(best_position, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(9)
    n, terms = 4000, 12
    ptr = np.arange(n + 1) * 4
    term = np.concatenate([rng.choice(terms, 4, replace=False) for _ in range(n)])
    impact = (rng.pareto(1.0, 4 * n) * 50).astype(np.int64) + 1
    lists = best_position.ImpactLists(np.arange(n)[::-1].copy(), ptr, term, impact, terms)
    scored = []
    for _ in range(30):
        want = rng.choice(terms, 3, replace=False)
        best, met = lists.search(want, [], 10)
        full = [(-int(impact[4 * r:4 * r + 4][np.isin(term[4 * r:4 * r + 4], want)].sum()), n - 1 - r) for r in range(n)]
        assert best == sorted(x for x in full if x[0])[:10]
        scored.append(met)
    assert np.mean(scored) < n / 20
    assert not lists.read.any() and not lists.known.any() and not lists.wanted.any()


def test_search_sql_with_edge_cases(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    assert compare(best_position.search(docs, items), con, best_position.SQL) is None


def test_search_equals_sql(spark):
    assert compare(entry.queries()["op13_best_position_search"](spark, SF), duck(SF), entry.oracle_sql()["op13_best_position_search"]) is None

