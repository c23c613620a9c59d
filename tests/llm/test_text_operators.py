"""Deduplication, packing, decontamination, quality rules and byte strings against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.llm import bytetext as B
from auditspark.llm import fmindex, induced, minhash, packing, quality_rules, suffix_dedup
from auditspark.llm.queries import OP1, tokenizer_path
from auditspark.llm.storage import Scratch
from support import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute_components(items, size, percent):
    sets = {}
    for i, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def found_components(spark, df, p):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df, p).collect()}


def test_components_of_odd_texts(spark, docs, odd_texts):
    assert found_components(spark, docs, OP1) == brute_components([(i, t) for i, t, *_ in odd_texts], 3, 85)


def test_components_of_chains_and_groups(spark, monkeypatch):
    r = random.Random(4)
    base = [str(r.randrange(10**6)) for _ in range(150)]
    items = []
    for k in range(40):  # a chain: neighbours are near, ends are not
        base = base[:]
        for _ in range(2):
            base[r.randrange(150)] = f"n{r.randrange(10**6)}"
        items.append((k, " ".join(base)))
    items += [(100 + k, items[3][1]) for k in range(30)] + [(200 + k, " ".join(str(r.randrange(50)) for _ in range(12))) for k in range(30)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    want = brute_components(items, 5, 80)
    assert found_components(spark, df, minhash.MinMaxHash(miss=1e-7)) == want
    # Without the shortcut of testing all pairs, pivots alone, then the rest.
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", 0)
    assert found_components(spark, df, minhash.MinMaxHash(miss=1e-7, pivot_rounds=2)) == want


def test_components_of_nothing_and_of_repeated_rows(spark, empty, docs):
    assert minhash.near_duplicates(spark, empty, OP1).count() == 0
    twice = docs.union(docs).withColumn("kept", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert minhash.near_duplicates(spark, twice, OP1).count() == 2 * docs.count()
    kept = minhash.deduplicate(spark, docs.union(docs), OP1)
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()
    nameless = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert minhash.near_duplicates(spark, nameless, OP1).where("kept").count() == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1), st.just(30))
def test_plan_is_best_fit_decreasing(counts, capacity):
    lengths = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)
    bins: list[int] = []
    for n in lengths:
        fit = [b for b in bins if b >= n]
        if fit:
            bins[bins.index(min(fit))] -= n
        else:
            bins.append(capacity - n)
    runs, placed = defaultdict(list), defaultdict(list)
    for run in packing.plan(counts, capacity):
        runs[run[0]].append(run)
    for n, k in counts.items():
        for rank in range(k):
            _, first, each, at, offset = max(r for r in runs[n] if r[1] <= rank)
            placed[at + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    for items in placed.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(placed) == len(bins)


def test_packing_of_odd_texts(spark, docs, odd_texts, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, text, *_ in odd_texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    rows = packing.packed(spark, docs, tokenizer_path()).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for items in used.values():
        ends = [o + n for o, n in sorted(items)]
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert packing.packed(spark, empty, tokenizer_path()).count() == 0


def test_packing_of_whole_tables_repeats_and_clashing_columns(spark):
    """Every text of the smallest documents against the plain tokenizer; rows that repeat are packed as often as they come."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    given = whole.union(whole.where("doc_id < 20")).union(spark.createDataFrame([(None, "an id is missing")] * 2, "doc_id long, text string"))
    clash = given.withColumns({"piece": F.lit("x"), "length": F.lit(None), "sequence_id": F.lit(0), "rank": F.lit(1), "salt": F.lit(2)})
    want = Counter()
    for i, text in given.collect():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    rows = packing.packed(spark, clash, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False)) and max(o + n for _, o, n in places) <= 4096
    rooms: list[int] = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(4096 - n)
    assert len({s for s, *_ in places}) == len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abXZ .,\n'’s1é́İΣ中<|\x0b\x85", max_size=25), max_size=4))
def test_encoder_is_exact(texts):
    e = packing.encoder(tokenizer_path())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode([t.encode() for t in texts])] == want


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    w, hit, found = ITEM_WORD.findall(ascii_lower(text or "")), set(), set()
    for item, t in items:
        v = ITEM_WORD.findall(ascii_lower(t or ""))
        for k in range(max(1, len(v) - window + 1) if v else 0):
            part = v[k : k + window]
            for p in range(len(w) - len(part) + 1):
                if w[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_contamination_against_brute_force(spark, docs, odd_texts, monkeypatch, block):
    base = odd_texts[6][1].split()
    items = [(1, " ".join(base[5:30])), (2, "ONE two"), (10, None), (11, ""), (3, "one"), (4, " ".join(base[5:16])), (5, "never seen words here at all in any of the texts")]
    monkeypatch.setattr(fmindex, "ITEM_BLOCK", block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = docs.withColumn("items", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in fmindex.contamination(spark, clash, bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t, *_ in odd_texts}
    clean = {r.doc_id: r.text for r in fmindex.decontaminate(spark, docs, bench).collect()}
    for i, t, *_ in odd_texts:
        n, hit, _ = got[i]
        assert clean[i] == t if not hit else len(ITEM_WORD.findall(ascii_lower(clean[i]))) == n - hit
    # However many blocks, the documents are read in one pass.
    plan = fmindex.contamination(spark, clash, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.contamination(spark, docs, nothing).where("n_hit > 0").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_all_places(symbols, pattern):
    index = fmindex.FMIndex(np.array(symbols), 5)
    padded = np.zeros((1, len(pattern)), np.int64)
    padded[0] = pattern
    low, high = index.search(padded, np.array([len(pattern)]))
    places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert places == [p for p in range(len(symbols)) if symbols[p : p + len(pattern)] == pattern]


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics_and_verdicts(spark, docs, odd_texts, empty, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST", 20)
    r = random.Random(5)
    plain = [(1000 + k, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(50, 90))), "en", "s", 1) for k in range(120)]
    junk = [(2000 + k, " ".join(f"w{r.randrange(999)}###" for _ in range(60)), "en", "s", 1) for k in range(6)]
    df = docs.union(spark.createDataFrame(plain + junk, docs.schema))
    found = {x.doc_id: x for x in quality_rules.judged(spark, df.withColumn("kept", F.lit(0)), ["doc_id"]).collect()}
    for i, t, *_ in odd_texts + plain + junk:
        x = found[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_stats(t), i
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept)
    assert all(found[i].kept for i, *_ in plain) and not any(found[i].kept for i, *_ in junk)
    assert quality_rules.judged(spark, empty, ["doc_id"]).count() == 0


def exact_step(x, mean, inverse):
    """The estimate from the nearest share of the rows x, taken one by one in order of distance."""
    d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
    near = x[np.lexsort((*x.T[::-1], d))][: int(np.ceil(quality_rules.SUPPORT * len(x)))]
    m, p, logdet = quality_rules.moments(np.array([len(near)]), near.sum(0)[None], (near.T @ near)[None])
    return m[0], p[0], logdet[0]


def exact_estimate(x, starts):
    """The smallest determinant that concentration from these starts (mean, inverse) leads to."""
    found = []
    for mean, inverse in starts:
        for _ in range(quality_rules.FIRST):
            mean, inverse, logdet = exact_step(x, mean, inverse)
        found.append((logdet, mean, inverse))
    logdet, mean, inverse = min(found, key=lambda f: f[0])
    while True:
        m, p, new = exact_step(x, mean, inverse)
        if logdet - new <= quality_rules.STILL:
            return mean, inverse, logdet
        mean, inverse, logdet = m, p, new


def square(row):
    out = np.zeros((6, 6))
    for i, j in quality_rules._PAIRS:
        out[i, j] = out[j, i] = row[f"p{i}{j}"]
    return out


def test_least_determinant_against_exact_steps_and_all_subsets(spark):
    r = np.random.default_rng(5)
    groups = {"a": r.normal(size=(80, 6)), "b": r.normal(size=(45, 6)) * 3, "few": r.normal(size=(10, 6)), "same": np.ones((30, 6))}
    groups["a"][:15] += 9
    groups["a"][40:60] = groups["a"][40]
    groups["few"][:2] -= 30
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "g string, " + ", ".join(f"x{i} double" for i in range(6)))
    scratch = Scratch(spark, "t")
    begun = {}
    for s in quality_rules.starts(rows).collect():
        begun.setdefault(s.g, []).append((s.k, np.array([s[f"m{i}"] for i in range(6)]), square(s)))
    found = {f.g: f for f in quality_rules.least_determinant(rows, scratch).collect()}
    assert found.keys() == groups.keys() and {k for k, *_ in begun["a"]} == {0, 1, 2, 3}
    for g, x in groups.items():
        mean, inverse, logdet = exact_estimate(x, [(m, p) for _, m, p in sorted(begun[g], key=lambda b: b[0])])
        assert found[g].logdet == pytest.approx(logdet, abs=1e-6), g
        assert np.allclose([found[g][f"m{i}"] for i in range(6)], mean, atol=1e-6) and np.allclose(square(found[g]), inverse, rtol=1e-4, atol=1e-6)
    x = groups["few"]
    subsets = [x[list(c)] for c in combinations(range(10), 8)]
    assert found["few"].logdet == pytest.approx(min(quality_rules.moments(np.array([8]), s.sum(0)[None], (s.T @ s)[None])[2][0] for s in subsets), abs=1e-6)


def test_verdicts_against_exact_estimates(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    for k in range(260):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(30, 90))]
        if k % 13 == 0:
            words = [f"{w.upper()}###" for w in words]
        rows.append((k, " ".join(words), None if k % 29 == 0 else "ab"[k % 2], None if k % 29 == 0 else f"s{k % 10 // 6}"))
    rows += [(1000, rows[1][1], "a", "s0")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality_rules.statistics(df, ["doc_id", "lang", "source"])
    x = {(v.doc_id, v.lang, v.source): np.array(v[-6:]) for v in stats.select("doc_id", "lang", "source", *quality_rules.transformed()).collect()}
    own, of = Counter((lang, source) for _, _, lang, source in rows), Counter(lang for _, _, lang, _ in rows)
    group = {key: key[1:] if own[key[1:]] >= 40 else key[1] if of[key[1]] >= 40 else "all" for key in x}
    members = defaultdict(list)
    for i, _, lang, source in rows:
        for g in ((lang, source), lang, "all"):
            members[g].append(x[i, lang, source])
    estimates = {}
    _, judging = quality_rules._grouped(stats.select("*", *(c.alias(f"x{i}") for i, c in enumerate(quality_rules.transformed()))), 40, 30)
    begun = defaultdict(list)
    for s in sorted(quality_rules.starts(judging).collect(), key=lambda s: s.k):
        key = json.loads(s.g) if s.g != "all" else None
        g = "all" if key is None else tuple(v[1:] or None for v in key.values()) if "s" in key else key["l"][1:] or None
        begun[g].append((np.array([s[f"m{i}"] for i in range(6)]), square(s)))
    for g in set(group.values()):
        v = np.array(members[g])
        mean, inverse, _ = exact_estimate(v, begun[g])
        d = np.sort(np.einsum("ni,ij,nj->n", v - mean, inverse, v - mean))
        estimates[g] = mean, inverse, max(1.0, d[(len(d) - 1) // 2] / quality_rules.CHI2_MEDIAN)
    found = quality_rules.judged(spark, df, ["doc_id", "lang", "source"], least=40).collect()
    assert len(found) == len(rows) and {"all"} < set(map(str, group.values()))
    for f in found:
        mean, inverse, scale = estimates[group[f.doc_id, f.lang, f.source]]
        v = x[f.doc_id, f.lang, f.source] - mean
        want = v @ inverse @ v / scale
        assert f.distance == pytest.approx(want, rel=0.02, abs=0.05), f.doc_id
        assert f.kept == (not f.base_failed and want <= quality_rules.CHI2_CUTOFF) or abs(want - quality_rules.CHI2_CUTOFF) < 1
    assert {f.kept for f in found if f.doc_id % 13 == 0 and f.doc_id < 1000} == {False}
    monkeypatch.setattr(quality_rules, "SENT_GROUPS", -1)
    again = quality_rules.judged(spark, df, ["doc_id", "lang", "source"], least=40).collect()
    assert sorted((f.doc_id, f.kept) for f in again) == sorted((f.doc_id, f.kept) for f in found)


def brute_removed(items, length):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in items]
    for _, t in raw:
        seen.update(t[s : s + length] for s in range(len(t) - length + 1))
    out = {}
    for i, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("letters", ["abcd ", "\0ab\n", "\0\x01"])
def test_byte_strings_against_brute_force(spark, hot, letters):
    r = random.Random(6)
    common = "abcdefghijklmnopqrstuvwxyz0123\x00456789" * 2
    items = [(100, None), (101, ""), (102, "é" * 60), (103, "é" * 60), (104, "short"), (105, "\0" * 90), (106, "\0" * 40)]
    for i in range(50):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 80)))
        t += common[: r.randint(30, 60)] + "".join(r.choice(letters[:2]) for _ in range(r.randint(0, 40))) if i % 2 else ""
        items.append((i, t + "xyxy" * r.randint(5, 30) * (i % 7 == 0)))
    copy = "".join(r.choice("abcdef") for _ in range(200))
    items += [(200 + i, copy + "".join(r.choice("abcdef") for _ in range(i % 3 * 30))) for i in range(40)]
    # Rows repeated as they are, and a period met once in one text and often in another.
    items += [(300, copy[:80])] * 3 + [(301, "0123456789" * 12), (302, "0123456789" * 3)]
    df = spark.createDataFrame(items, "doc_id long, text string").withColumn("n_removed", F.lit("x"))
    found = suffix_dedup.deduplicated(spark, df, ["doc_id", "n_removed"], length=24, gram=6, hot=hot).withColumn("s", F.sha2("kept_bytes", 256))
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.s) for x in found.collect()} == brute_removed(items, 24)


def test_byte_strings_of_texts_beyond_a_chunk(spark):
    r = random.Random(8)
    long_ = "".join(r.choice("abcdefgh \n") for _ in range(B.CHUNK_BYTES + 5000))
    items = [(1, long_ + long_[7:900]), (2, "x" + long_[B.CHUNK_BYTES - 100 : B.CHUNK_BYTES + 600]), (3, "y" * 500), (4, long_[:399])]
    found = suffix_dedup.deduplicated(spark, spark.createDataFrame(items, "doc_id long, text string"), ["doc_id"]).withColumn("s", F.sha2("kept_bytes", 256))
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.s) for x in found.collect()} == brute_removed(items, 400)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes((0, 10, 97)[x % 3] for x in b)), min_size=1, max_size=6))
def test_repeated_windows_of_any_bytes(parts):
    seen = Counter(p[k : k + 3] for p in parts for k in range(len(p) - 2))
    want = {(i, k) for i, p in enumerate(parts) for k in range(len(p) - 2) if seen[p[k : k + 3]] > 1}
    assert {(i, k) for i, a, b in suffix_dedup.repeated_windows(parts, 3) for k in range(a, b + 1)} == want


def test_byte_strings_of_nothing(spark, empty, docs):
    assert suffix_dedup.deduplicated(spark, empty, ["doc_id"]).count() == 0
    twice = suffix_dedup.deduplicated(spark, docs.union(docs), ["doc_id"])
    assert twice.where("n_bytes >= 400 and n_removed <> n_bytes").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes((0, 97, 255)[x % 3] for x in b)))
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    sa = induced.suffix_array(data)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    if len(text):
        phi, common = induced.permuted_lcp(data, sa, np.full(len(text), len(text)), np.arange(len(text)), 9)
        at = {p: k for k, p in enumerate(sa.tolist())}
        for p in range(len(text)):
            q = sa[at[p] - 1] if at[p] else -1
            n = 0
            while q >= 0 and n < 9 and max(p, q) + n < len(text) and text[p + n] == text[q + n]:
                n += 1
            assert (phi[p], common[p]) == (q, n)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes((0, 10, 97)[x % 3] for x in b)), min_size=1, max_size=8))
def test_suffixes_of_segments_tie_at_separators(parts):
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size + 1) - 1
    sa = induced.suffix_array(data, end[:-1])
    assert sorted(sa.tolist()) == list(range(len(data)))
    rest = [p[k:] for p in parts for k in range(len(p) + 1)][: len(data)]
    apart = set(end[:-1].tolist())
    got = [rest[i] for i in sa.tolist() if i not in apart]
    assert got == sorted(got)
    if len(data):
        ends, at = np.repeat(end, size + 1)[: len(data)], np.array([i for i in range(len(data)) if i not in apart], np.int64)
        phi, common = induced.permuted_lcp(data, sa, ends, at, 5)
        for least in (1, 3, 5):
            again, reached = induced.permuted_lcp(data, sa, ends, at, 5, least)
            assert again.tolist() == phi.tolist() and reached.tolist() == np.where(common >= least, common, 0).tolist()


def test_work_of_the_suffix_array_a_byte(monkeypatch):
    r = random.Random(5)
    kinds = [bytes(r.choice(b"abcdefgh \n") for _ in range(600)) for _ in range(40)]
    parts = [k for k in kinds for _ in range(12)]
    work = Counter()
    sort, raw = np.argsort, B.ByteHash.raw

    def counted_sort(a, *args, **kw):
        # Keys of 16 bits are sorted by their digits.
        work["compared"] += a.size if a.dtype.itemsize > 2 else 0
        return sort(a, *args, **kw)

    def counted_raw(self, start, end):
        work["hashed"] += len(start)
        return raw(self, start, end)

    monkeypatch.setattr(np, "argsort", counted_sort)
    monkeypatch.setattr(B.ByteHash, "raw", counted_raw)
    assert suffix_dedup.repeated_windows(parts, 400) == [(i, 0, 200) for i in range(len(parts))]
    size = sum(map(len, parts))
    assert work["compared"] < 4 * size and work["hashed"] < 2 * size, {k: v / size for k, v in work.items()}


def test_hashes_tell_ranges_apart():
    c = B.Chunk([b"abc abd", b"abc", b""], lower=True)
    start, end, doc = c.words(B.NOT_SPACE)
    h = c.hash.of(start, end)
    assert doc.tolist() == [0, 0, 1] and h[0] == h[2] != h[1]
