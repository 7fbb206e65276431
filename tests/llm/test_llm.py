"""Operators of the training-data package on small tables: edge cases, brute force, round trips, held-out accuracy."""
import hashlib
import math
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check import compare, duck
from tideline.llm import classifier, compact_windows, decontamination, language_model, minhash, packing, quality_rules, suffix_dedup, toxicity, wordpiece
from tideline.llm.common import start, stash
from tideline.llm.queries import word_vocabulary

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil green tea under an old oak near our river bank every rainy morning"
COPY = "copies of this text are found four times in the table and nothing else in it is like this text at all , as they say"
#: (doc_id, text, lang, n_words): nulls in every column, empty and very long texts, repeated rows, ties, clashing names.
ROWS = [
    (1, PROSE, "en", 1), (2, PROSE + " again", "en", 2), (3, None, None, None), (4, "", "en", 4), (5, "  \n\t ", None, 5), (6, LONG, "en", 6), (6, LONG, "en", 6), (7, LONG + " Ä tail", "de", 7),
    (8, COPY, "en", 8), (9, COPY, "en", 9), (10, COPY.upper(), "en", 10), (None, COPY, "en", 11), (11, "one", "fr", 12), (12, "one", "fr", 13), (13, "ein \U0001f600 ß", None, 14),
]
SCHEMA = "doc_id bigint, text string, lang string, n_words int"
EXTRA = ["score double", "row bigint", "node bigint", "spans string", "hits string", "items string", "key string", "label int", "marks int", "signature string", "component int"]


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

    return docs.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (8, 0, 1), (9, None, None), (None, 1, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def pattern_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def own(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


# --- near-duplicates

def brute_components(rows, percent=85):
    sets = []
    for doc, text in rows:
        w = pattern_words(text)
        sets.append(set() if not w else {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if a is not None and rows[j][0] is not None and (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) or a == rows[j][0]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return Counter((a, len(s), least.get(root(i)), a is None or a == least[root(i)]) for i, ((a, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
def test_minhash_equals_brute_force(request, name):
    table = request.getfixturevalue(name)
    got = Counter(tuple(r) for r in minhash.deduplicated(table).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_components(own(table))


def test_minhash_chain_and_threshold(spark):
    start(spark)
    rng = np.random.default_rng(3)
    rows, base = [], [f"v{x}" for x in rng.integers(0, 10**6, 300)]
    for i in range(120):  # edits add up along the chain, so that links are few and components long
        base = list(base)
        for _ in range(rng.integers(1, 5)):
            base[rng.integers(0, 300)] = f"e{rng.integers(0, 10**9)}"
        rows.append((int(1000 - i), " ".join(base)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter(tuple(r) for r in minhash.deduplicated(table).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_components(rows)


def test_near_duplicates_keep_columns(docs):
    kept = minhash.remove_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 6, 8, 11, 13]


def test_chunks_without_a_value_find_every_pair_in_reach():
    rng = np.random.default_rng(1)
    n = minhash.CHUNKS * minhash.WIDTH
    for _ in range(200):  # fewer than 2 * CHUNKS errors leave a chunk with one at most
        wrong = np.zeros(n, bool)
        wrong[rng.choice(n, 2 * minhash.CHUNKS - 1, replace=False)] = True
        assert (wrong.reshape(minhash.CHUNKS, -1).sum(axis=1) <= 1).any()


# --- quality rules

@pytest.mark.parametrize("name", ["docs", "empty"])
def test_quality_rules_edges(request, name, labels, no_labels):
    table = request.getfixturevalue(name)
    for known in (labels, no_labels):
        rows = quality_rules.judged(table, known).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in own(table))
        for r in rows:
            assert r["kept"] is (not r["base_failed"]) or r["rejected_by"]
            if r["doc_id"] in (3, 4, 5):
                assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) == (0, 0, 0, 0, False)


def test_repeat_words_and_lines(spark):
    start(spark)
    text = "a b c d e x a b c d e f\nline one\n\nline one\nLine one\n  \n  "
    r = quality_rules.measured(spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, lang string")).first()
    assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["n_lines"]) == (18, 10, 1, 4)
    r = quality_rules.measured(spark.createDataFrame([(1, "z " * 9, None)], "doc_id bigint, text string, lang string")).first()
    assert r["n_repeat_words"] == 9


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    for n, k, p in [(50, 0, 0.01), (500, 2, 0.01), (5000, 30, 0.01), (200_000, 1900, 0.01)]:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p).alias("p")).first()["p"]
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-7)


def test_cutoff_needs_evidence(spark):
    """A signal that only bad documents reach is certified with enough good ones, not with few."""
    start(spark)
    for good, found in ((60, False), (3000, True)):
        rows = [(i, f"plain words number {i} in a clean text of some length", "en") for i in range(good)] + [(10**6 + i, "bad### words### here### " * 3, "en") for i in range(50)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        labels = spark.createDataFrame([(i, int(i < 10**6)) for i, *_ in rows], "doc_id bigint, quality int")
        assert ("symbols" in {r["signal"] for r in quality_rules.cutoffs(quality_rules.measured(docs), labels).collect()}) is found


# --- packing

@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
def test_packing_round_trip(request, name):
    from tokenizers import Tokenizer

    table = request.getfixturevalue(name)
    rows = packing.pack(table, word_vocabulary()).collect()
    tok = Tokenizer.from_file(word_vocabulary())
    want = Counter((d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in own(table))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    got = Counter()
    for d, pieces in by_doc.items():
        for start_ in {p["start"] for p in pieces}:
            assert len({p["doc_tokens"] for p in pieces}) == 1
        copies = sum(p["start"] == 0 for p in pieces)
        if copies == 1:
            got[d, b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"]))] += 1
        else:  # repeated rows: all ids as often
            assert Counter(np.frombuffer(b"".join(bytes(p["ids"]) for p in pieces), "<u4").tolist()) == Counter({k: copies * n for k, n in Counter(np.frombuffer(next(w for x, w in want if x == d), "<u4").tolist()).items()})
            got[d, next(w for x, w in want if x == d)] += copies
    assert got == want
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == pieces[0]["sequence_tokens"] <= 2048 and at & (at - 1) == 0


def test_words_encode_as_whole_texts():
    texts = ["it's İstanbul ΟΔΟΣ naïve x́ ́a <|endoftext|>b don't 12ab3 a\x1cb ÿÝ µm × a×b ß ẞ a_b `` Ǆ ﬁ 日本語 I'm'll ªº ½ 's", "¡hola! ÅNGSTRÖM, the... (ok) x y"]
    encode = packing.WordEncoder(word_vocabulary())
    for text, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_cache_is_given_back_when_no_task_follows():
    encode = packing.WordEncoder(word_vocabulary())
    want = encode([b"some words, (again) some words"])
    encode.rest(0.05)
    encode.work()
    encode.timer.join()
    assert encode.cache and encode.parts
    encode.rest(0.05)
    encode.timer.join()
    assert not encode.cache and not encode.parts
    assert encode([b"some words, (again) some words"]) == want


# --- passages

def test_passages_of_copies_and_inserts(spark, docs, empty, clash):
    start(spark)
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(70)
    edited = list(passage)
    edited[35] = "changed"
    rows = [(i, " ".join(fresh(80) + (passage if i < 3 else edited if i == 3 else []) + fresh(90))) for i in range(8)]
    found = {(r["doc_id"], r["source_doc_id"]): r for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {(1, 0), (2, 0), (3, 0)} <= set(found) and {d for d, _ in found} == {1, 2, 3} and {s for _, s in found} <= {0, 1, 2}
    assert (found[1, 0]["start"], found[1, 0]["end"], found[1, 0]["source_start"], found[1, 0]["similarity"]) == (80, 150, 80, 1.0)
    assert 0.8 <= found[3, 0]["similarity"] < 1
    assert compact_windows.repeated_passages(empty).count() == 0
    for table in (docs, clash):
        assert {(r["doc_id"], r["source_doc_id"]) for r in compact_windows.repeated_passages(table).collect()} == {(7, 6)}


def test_near_passages_are_connected_whatever_leads(spark):
    """Triples A < B < C: B and C have a passage at 0.8 without 50 equal words, A a variant of it under the similarity to both."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        passage = [f"p{w}" for w in rng.integers(0, 1 << 40, 100)]
        for j, edits in enumerate(((12, 37, 62, 87), (31,), (66,))):
            body = [f"x{k}.{j}.{at}" if at in edits else w for at, w in enumerate(passage)]
            rows.append((3 * k + j, " ".join(body + [f"f{w}" for w in rng.integers(0, 1 << 40, 40)])))
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert all(r["source_doc_id"] // 3 == r["doc_id"] // 3 and r["similarity"] >= 0.8 for r in found)
    linked = {(r["source_doc_id"], r["doc_id"]) for r in found}
    assert sum((3 * k + 1, 3 * k + 2) in linked for k in range(60)) >= 58  # 0.2 ** 4 of such pairs share no minimum


def test_passages_are_found_between_documents_that_others_connect(spark):
    """Triples as above, where A shares another passage word for word with B, and one with C."""
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"f{w}" for w in rng.integers(0, 1 << 40, n)]
    rows = []
    for k in range(60):
        passage, one, two = fresh(100), fresh(70), fresh(70)
        for j, (edits, more) in enumerate((((12, 37, 62, 87), one + fresh(30) + two), ((31,), one), ((66,), two))):
            rows.append((3 * k + j, " ".join([f"x{k}.{j}.{at}" if at in edits else w for at, w in enumerate(passage)] + fresh(60) + more)))
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    pairs = {(r["source_doc_id"], r["doc_id"]) for r in found if r["start"] < 40 and r["end"] > 60 and r["source_start"] < 40}
    assert sum((3 * k + 1, 3 * k + 2) in pairs for k in range(60)) >= 58
    assert {(3 * k, 3 * k + j) for k in range(60) for j in (1, 2)} <= {(r["source_doc_id"], r["doc_id"]) for r in found}
    assert len(found) == len({(r["doc_id"], r["source_doc_id"], r["start"], r["end"], r["source_start"]) for r in found})


def test_prints_leave_room_for_a_passage():
    rng = np.random.default_rng(14)
    one, two = (rng.integers(0, 1 << 16, 6000).astype(np.uint16) for _ in range(2))
    assert compact_windows.common([one, two])[0, 1] > 400 and not compact_windows.room(one, two, 46, 0.88)
    two[3000:3046] = one[100:146]
    assert compact_windows.room(one, two, 46, 0.88)


def test_common_counts_elements_of_every_pair():
    lists = [np.array(x, np.uint16) for x in ([1, 1, 2], [1, 3], [4], [])]
    assert compact_windows.common(lists).tolist() == [[3, 2, 0, 0], [1, 2, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_passages_are_connected_whatever_leads(spark, parts):
    """Triples A < B < C: B and C share a passage word for word, A is a variant of it under the similarity."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(80):
        passage = [f"p{w}" for w in rng.integers(0, 1 << 40, 60)]
        variant = list(passage)
        for at in rng.choice(60, 2 + k % 3, replace=False):
            variant[at] = f"x{at}"
        for j, body in enumerate((variant, passage, passage)):
            pad = [[f"f{w}" for w in rng.integers(0, 1 << 40, rng.integers(0, 90))] for _ in range(2)]
            rows.append((3 * k + j, " ".join(pad[0] + body + pad[1])))
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()
    words_of = {d: t.split() for d, t in rows}
    group = {d: d for d in words_of}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["source_doc_id"])):
        assert r["source_doc_id"] // 3 == r["doc_id"] // 3 and r["source_doc_id"] < r["doc_id"]
        if r["similarity"] == 1.0 and r["end"] - r["start"] == r["source_end"] - r["source_start"]:
            assert words_of[r["doc_id"]][r["start"]:r["end"]] == words_of[r["source_doc_id"]][r["source_start"]:r["source_end"]]
        one, two = group[r["doc_id"]], group[r["source_doc_id"]]
        group = {d: min(one, two) if g in (one, two) else g for d, g in group.items()}
    assert all(group[3 * k + 1] == group[3 * k + 2] for k in range(80))


def test_codes_of_runs_are_those_of_their_values():
    code = np.random.default_rng(3).integers(0, 3, 400).astype(np.uint64)
    codes = compact_windows.run_codes(code, 4)
    assert len(codes) == 397 and len(compact_windows.run_codes(code[:3], 4)) == 0
    places: dict[bytes, set] = {}
    for k, c in enumerate(codes):
        places.setdefault(code[k:k + 4].tobytes(), set()).add(int(c))
    assert all(len(v) == 1 for v in places.values()) and len(set.union(*places.values())) == len(places)


def test_reordered_passages_are_all_found():
    rng = np.random.default_rng(21)
    for trial in range(60):
        passages = [rng.integers(1, 1 << 62, n).astype(np.uint64) for n in rng.integers(60, 90, rng.integers(2, 5))]

        def laid(order):
            at, parts, places = 0, [], {}
            for k in order:
                fill = rng.integers(1, 1 << 62, rng.choice([0, 4, 90])).astype(np.uint64)
                places[k] = at + len(fill), at + len(fill) + len(passages[k])
                parts += [fill, passages[k]]
                at = places[k][1]
            return np.concatenate(parts), places

        one, first = laid(range(len(passages)))
        two, second = laid(rng.permutation(len(passages)))
        found = compact_windows.verified(one, two, 46, 0.8)
        for k in range(len(passages)):
            assert any(a <= first[k][0] and first[k][1] <= b and c <= second[k][0] and second[k][1] <= d for a, b, c, d, _ in found), (trial, k)
        for a, b, c, d, jaccard in found:
            x, y = set(one[a:b].tolist()), set(two[c:d].tolist())
            assert jaccard == len(x & y) / len(x | y) >= 0.8


def test_compact_windows_are_the_cartesian_tree():
    value = np.random.default_rng(4).integers(0, 30, 200).astype(np.uint64)
    offs = np.array([0, 90, 90, 93, 200])
    got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(value, offs, 5))))
    want = set()
    for a, b in zip(offs[:-1], offs[1:]):
        for c in range(a, b):
            lo, hi = c, c + 1
            while lo > a and value[lo - 1] > value[c]:
                lo -= 1
            while hi < b and value[hi] >= value[c]:
                hi += 1
            if hi - lo >= 5:
                want.add((lo, c, hi))
    assert got == want


# --- token counts

@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
def test_word_pieces_are_greedy(request, name):
    table = request.getfixturevalue(name)
    pieces = set(wordpiece.pieces_of(word_vocabulary()))
    most = max(map(len, pieces))

    def greedy(word):
        s, at, n = (*word, wordpiece.END), 0, 0
        while at < len(s):
            k = next((k for k in range(min(most, len(s) - at), 0, -1) if s[at:at + k] in pieces), 0)
            if not k:
                return None
            at, n = at + k, n + 1
        return n

    known = {}
    for d, t in own(table):
        ns = [greedy(w.encode()) for w in pattern_words(t)]
        known[d] = (len(ns), sum(n or 1 for n in ns), sum(n is None for n in ns))
    rows = wordpiece.token_counts(table, word_vocabulary()).collect()
    assert len(rows) == table.count()
    for r in rows:
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == known[r["doc_id"]]


def test_automaton_on_a_small_vocabulary():
    def of(*words):
        return [tuple(w.encode()) if not w.endswith("$") else (*w[:-1].encode(), wordpiece.END) for w in words]

    pieces = of("a", "ab", "abcd", "b", "c", "bc", "d", "$", "cd$", "zzz")
    machine, known = wordpiece.Automaton(pieces), set(pieces)
    for word in ["a", "ab", "abc", "abcd", "abcde", "abcabcd", "bcd", "z", "zzzz", "zzz", "dcba"]:
        s, at, n = (*word.encode(), wordpiece.END), 0, 0
        while at < len(s) and n is not None:
            k = next((k for k in range(len(s) - at, 0, -1) if s[at:at + k] in known), 0)
            at, n = (at + k, n + 1) if k else (len(s), None)
        raw = np.frombuffer(word.encode(), np.uint8)
        assert machine.counts(raw, np.array([0]), np.array([len(raw)]))[0] == (wordpiece.NONE if n is None else n), word


# --- classifiers

@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifier_edges(which, docs, clash, empty, labels, no_labels):
    for table in (docs, clash, empty):
        for known in (labels, no_labels):
            if which == "quality":
                rows = classifier.score(table, classifier.fit(table, known)).collect()
            else:
                rows = toxicity.score(table, toxicity.fit(table, known)).collect()
            assert len(rows) == table.count()
            assert all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) <= 1


def held_out(spark, name, column, cut):
    con = duckdb.connect()
    known = dict(con.sql(f"SELECT doc_id, {column} FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = [r for r in entry.queries()[name](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= cut) for r in rows)
    return sum(r["predicted"] == known[r["doc_id"]] for r in rows) / len(rows)


def test_held_out_accuracy(spark):
    assert held_out(spark, "op6_quality_classifier", "quality", 0.3) > 0.95
    assert held_out(spark, "op9_toxicity", "toxic", 0.5) > 0.9


def test_grammar_verdicts():
    lexicon, grammar = toxicity.Lexicon(["abcx", "rude$"]), toxicity.Grammar()

    def verdict(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        counts = toxicity.clause_counts(raw, np.array([0, len(raw)]), lexicon, grammar)[0]
        return {k for k in range(1, toxicity.REPORTED + 1) if counts[k]}

    assert verdict("what a lovely day") == set()
    assert verdict("some idiot here") == {toxicity.PLAIN}
    assert verdict("you idiot") == verdict("Idiot, you know") == {toxicity.TARGETED}
    assert verdict("this is not stupid") == {toxicity.NEGATED}
    assert verdict("he said the plan was trash") == {toxicity.REPORTED}
    assert verdict("I will hurt you") == {toxicity.THREATENING}
    assert verdict("it can hurt a bit") == set()
    assert verdict("moron and loser") == {toxicity.REPEATED}
    assert verdict("not today. some idiot") == {toxicity.PLAIN}
    assert verdict("not so very much of an idiot") == {toxicity.PLAIN}
    assert verdict("abcxyz") == verdict("rude") == {toxicity.PLAIN} and verdict("rudely abc") == set()


# --- decontamination

def test_decontamination_edges(spark, docs, clash, empty):
    items = [(1, "Quick brown fox JUMPS over the lazy dog while seven wizards"), (2, "one"), (3, ""), (4, None), (5, "one"), (None, "zzz"), (6, " ".join(LONG.split()[100:130])), (7, "lazy dog over")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for table in (docs, clash):
        got = {r["doc_id"]: r for r in decontamination.digest(decontamination.matches(table, bench)).collect()}
        assert (got[1]["n_hit"], got[1]["n_items"], got[1]["items_sha256"]) == (11, 1, hashlib.sha256(b"1").hexdigest())
        assert (got[11]["n_hit"], got[11]["items_sha256"]) == (1, hashlib.sha256(b"2,5").hexdigest())
        assert (got[6]["n_hit"], got[6]["n_items"], got[3]["n_words"], got[3]["contaminated"]) == (180, 1, 0, False)  # the words come round six times
        blocks = {r["doc_id"]: r for r in decontamination.digest(decontamination.matches(table, bench, block_bytes=20)).collect()}
        assert blocks == got  # small blocks of items change nothing
    assert decontamination.digest(decontamination.matches(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontamination.digest(decontamination.matches(empty, bench)).count() == 0
    assert {r["doc_id"] for r in decontamination.remove_contaminated(docs, bench).collect()} == {3, 4, 5, 8, 9, 10, None, 13}


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op2_quality_rules", "op7_decontamination"])
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None


# --- substring dedup

def brute_spans(rows):
    docs = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in docs:
        for k in range(len(b) - 49):
            if d is not None:
                first[b[k:k + 50]] = min(first.get(b[k:k + 50], d), d)
    out = Counter()
    for d, b in docs:
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if d is not None and first[b[k:k + 50]] < d:
                mask[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out[d, len(b), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def spans_of(table):
    return Counter(tuple(r) for r in suffix_dedup.digested(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_substrings_equal_brute_force(spark, docs, clash, empty):
    start(spark)
    for table in (docs, clash, empty):
        assert spans_of(table) == brute_spans(own(table))
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(rng.choice(list("abcd é\n"), n))
    shared = [letters(n) for n in (49, 50, 51, 64, 90, 300)]
    rows = [(int(d), "".join(shared[j] + letters(rng.integers(0, 80)) for j in rng.integers(0, 6, 4))) for d in rng.permutation(60)]
    rows += [(100, "x" * 500), (101, "x" * 50), (102, "x" * 49), (103, "ab" * 200), (104, "ba" * 30)]
    assert spans_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == brute_spans(rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_adjacent_copies_of_a_row_are_cut_alike(spark, parts):
    rows = [(1, COPY + " " + PROSE), *[(2, "ahead of it " + COPY)] * 3, (3, PROSE + " " + COPY), (3, PROSE + " " + COPY)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    table = table if parts == 1 else table.repartition(parts, "doc_id")
    assert spans_of(table) == brute_spans(rows)


@pytest.mark.parametrize("parts", [2, 40])
def test_marks_are_a_row_a_document_in_any_number_of_shards(spark, parts):
    rng = np.random.default_rng(4)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 900))
    rows = [(d, d, text if d % 2 else text[::-1]) for d in range(24)]
    table = spark.createDataFrame(rows, "doc_id bigint, row bigint, text string").repartition(3)
    found = suffix_dedup.marks(table, parts).collect()
    assert sorted(r["row"] for r in found) == list(range(2, 24))
    assert {len(r["marks"]) for r in found} == {len(suffix_dedup.anchors(suffix_dedup.Prefix(b), np.array([0, len(b)]))[0]) for b in (np.frombuffer(t.encode(), np.uint8) for t in (text, text[::-1]))}
    assert {len(r["shards"]) // 4 for r in found} <= set(range(1, parts + 1))


def test_matching_statistics():
    rng = np.random.default_rng(8)
    text = lambda n: bytes(int(x) for x in rng.choice(list(b"ab"), n))
    strings, asked = [text(n) for n in (30, 12, 45, 45)], [text(n) for n in (20, 33, 1)] + [b"abz"]
    index = suffix_dedup.RunIndex(strings, np.arange(4), 5)
    lengths, places = index.matching_statistics(asked)
    joined = b"\0".join(strings)
    for i, q in enumerate(asked):
        for k in range(len(q)):
            col = lengths.shape[1] - len(q) + k
            want = max(n for n in range(len(q) - k + 1) if q[k:k + n] in joined)
            assert lengths[i, col] == want
            at = places[i, col]
            assert not want or joined[at:at + want] == q[k:k + want]


def test_cut_texts(docs):
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns
    assert cut[9]["text"] == "" and cut[8]["text"] == COPY and cut[3]["text"] is None and cut[7]["text"] == "Ä tail" and cut[None]["text"] == COPY


# --- language model

@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
@pytest.mark.parametrize("head_words", [0, 1 << 19])
def test_language_model_base(request, name, head_words):
    table = request.getfixturevalue(name)
    rows = own(table)
    held = {d: d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    tokens = {d: [*pattern_words(t), None] for d, t in rows}
    counts = Counter()
    for d, t in rows:
        if not held[d]:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    got = language_model.score(table, filter_bits=1 << 20, head_words=head_words).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    for r in got:
        own_tokens = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own_tokens), sum(counts[w] > 0 for w in own_tokens), n)
        assert r["base_score"] == pytest.approx(math.fsum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own_tokens))
        assert r["score"] <= 1e-9


def test_filter_keeps_every_key():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)
    counts = np.minimum(rng.geometric(0.3, 5000) ** 2, 400)
    bits = language_model.filled((keys[:3000], counts[:3000]), (keys[3000:], counts[3000:]), 1 << 20)
    filter_ = language_model.Filter(bits[None, :], 1)
    level = language_model.levels(counts)
    found = filter_.count(keys)
    assert (found >= level).all() and (found == level).mean() > 0.9
    assert (filter_.count(rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)) > 0).mean() < 0.05


def test_filter_grows_with_its_keys():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)
    counts = rng.geometric(0.3, 5000) ** 2
    bits = language_model.filled((keys[:3000], counts[:3000]), (keys[3000:], counts[3000:]), 64)
    assert (language_model.Filter(bits[None, :], 1).count(keys) >= language_model.levels(counts)).all()


def test_every_learned_ngram_is_in_the_model(spark):
    rows = [(1, PROSE), (2, COPY), (3, "one two three " * 9)]
    model, ones = language_model.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), filter_bits=64)
    for _, text in rows:
        codes, at = language_model.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert (model.ngrams.count(codes) > 0).all() and (model.ngrams.count(language_model.bigrams(codes, at)[0]) > 0).all()


def test_model_beats_its_base_on_held_out(spark):
    rows = [r for r in entry.queries()["op10_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# --- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stash(stage(spark, seen[-1], SF)))
    for before, after in zip(seen[:5], seen[1:5]):
        assert after.columns == before.columns
    ids = [sorted(r["doc_id"] for r in t.collect()) for t in seen[:5]]
    good = {r["doc_id"] for r in classifier.score(docs, classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.3").collect()}
    assert ids[1] == sorted(good)
    assert ids[2] == sorted(k[0] for k, n in brute_components(own(seen[1]), 80).items() if k[3])
    texts, cut = dict(own(seen[2])), dict(own(seen[3]))
    assert ids[3] == ids[2]
    want = {k[0]: k[4] for k in brute_spans(list(texts.items()))}
    for d, t in cut.items():
        assert "�" in (t or "") or hashlib.sha256((t or "").encode()).hexdigest() == want[d]
    con = duckdb.connect()
    con.register("documents", seen[3].toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    assert ids[4] == sorted(r[0] for r in con.sql(decontamination.SQL).filter("NOT contaminated").fetchall())
    packed = seen[5].collect()
    assert {r["doc_id"] for r in packed} == set(ids[4])
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_columns_of_any_name_pass_through_the_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ["row", "cut", "score", "n_words", "hits", "items", "node", "component", "component_id", "kept", "spans", "marks", "rest", "starts"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        given = stash(stage(spark, given, SF))
        assert given.columns == [*docs.columns, *names] and dict(given.dtypes).keys() >= set(names)
        rows = given.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
    assert corpus_pipeline.STAGES[4][1](spark, given, SF).count() >= len(rows)


def test_other_modules_do_not_need_this_package():
    assert not [m for m in sys.modules if m.startswith("tideline.") and not m.startswith("tideline.llm") and "llm" in getattr(sys.modules[m], "__dict__", {})]
