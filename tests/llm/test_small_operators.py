"""Fingerprints, shards, URL rules, tokenizer, packing: brute force and edge cases on small tables."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import best_fit, bpe_automaton, kd_shards, lz_fingerprint, url_rules
from millrace.llm.queries import ALLOW, BLOCK

WORDS = "the of and to in a is that für über été niño 漢字 x1 b2".split()


def texts(n, seed=1, most=60):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(0, most))) for _ in range(n)]


def edge(spark):
    rows = [(1, None), (None, "abc"), (2, ""), (3, "x" * 3000), (3, "x" * 3000), (4, "tie"), (5, "tie"), (6, " \n\t ")]
    return spark.createDataFrame([(i, t, "lang", "src", 0, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")


# ---- op1


def lz78(s):
    seen, w = set(), ""
    for c in s:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen


@given(st.text(alphabet="abü漢 ", max_size=200))
@settings(max_examples=200, deadline=None)
def test_phrases_are_those_of_the_plain_rule(s):
    seen = set()
    lz_fingerprint.parse(s, 0, seen, len(s), [], [])
    assert seen == lz78(s)


def test_shared_parse_equals_two_parses():
    h = lz_fingerprint.Hasher()
    t = [*texts(40), "", "a", "ab" * 50]
    for a, b in zip(t, t[1:] + t[:1], strict=True):
        x, y, e = lz_fingerprint.with_edited(a, b, h)
        assert (x == lz_fingerprint.fingerprint(a)).all() and (y == lz_fingerprint.fingerprint(e)).all()


def test_likeness_estimates_jaccard():
    h, worst = lz_fingerprint.Hasher(), 0
    t = texts(30, most=400)
    for a, b in zip(t, t[1:], strict=False):
        p, q = lz78(a), lz78(a[: len(a) // 2] + b)
        true = len(p & q) / max(1, len(p | q))
        worst = max(worst, abs(true - lz_fingerprint.likeness(lz_fingerprint.fingerprint(a, h), lz_fingerprint.fingerprint(a[: len(a) // 2] + b, h))))
    assert worst < 0.3


def test_fingerprint_table_against_brute_force(spark):
    t = list(enumerate(texts(90)))
    random.Random(2).shuffle(t)
    d = spark.createDataFrame(t, "doc_id long, text string").repartition(5)
    for parts in (1, 4, 40):
        got = {r.doc_id: r for r in lz_fingerprint.fingerprints(d, parts).collect()}
        s = sorted(t)
        assert len(got) == len(s)
        for k, (i, x) in enumerate(s):
            n = s[(k + 1) % len(s)][1]
            h = len(x) // 2
            e = x[: len(x) - h] + n[:h]
            f = lz_fingerprint.fingerprint
            assert got[i].n_chars == len(x) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert got[i].fingerprint == lz_fingerprint.as_text(f(x)) and got[i].near_next == lz_fingerprint.likeness(f(x), f(n))
            assert got[i].near_edited == lz_fingerprint.likeness(f(x), f(e))


def test_rows_that_share_or_lack_an_id_are_dealt_over_parts(spark):
    t = texts(240, seed=4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, x) for i, x in enumerate(t)] + [(7, t[1])] * 20 + [(None, None)] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for parts in (1, 30):
        got = lz_fingerprint.fingerprints(d, parts).collect()
        assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, lz_fingerprint.as_text(lz_fingerprint.fingerprint(x))) for i, x in rows)
        if parts > 1:
            order = d.select("doc_id", "text", lz_fingerprint.F.xxhash64(lz_fingerprint.F.coalesce("text", lz_fingerprint.F.lit(""))).bitwiseAND((1 << 53) - 1).alias("h")).collect()
            order = sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h if r.doc_id in (None, 7) else 0, r.text is not None, r.text or ""))
        else:
            order = sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, 0, r.text is not None, r.text or ""))
        want = []
        for k, r in enumerate(order):
            x, n = r.text or "", order[(k + 1) % len(order)].text or ""
            h = len(x) // 2
            want.append((r.doc_id or -1, hashlib.sha256((x[: len(x) - h] + n[:h]).encode()).hexdigest()))
        assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted(want)
    # no part holds more than a few of the distinct rows of one id
    bounds = lz_fingerprint._bounds([7] * 10 + [50, 90], 9)
    assert bounds == sorted(set(bounds)) and len(bounds) == 8 + 10 + 2


def test_fingerprint_edges(spark):
    got = lz_fingerprint.fingerprints(edge(spark)).collect()
    assert len(got) == 8 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert lz_fingerprint.fingerprints(edge(spark).limit(0)).count() == 0
    one = lz_fingerprint.fingerprints(edge(spark).where("doc_id = 4")).first()
    assert one.near_next == 1.0


# ---- op2


def test_shards_keep_law_slots_and_copies(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(0, 300) + str(i), r.choice(["en", "de"]), r.choice(["s1", "s2", None])) for i in range(3000)]
    rows += [(3000 + i, "copy " * 20, "en", "s1") for i in range(1500)]  # a third of all rows is one text
    rows += [(5000 + i, f"pair {i // 2}", "en", f"s{i % 7}") for i in range(200)]
    got = kd_shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).toPandas()
    by = got.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "count"), top=("slot", "max"), distinct=("slot", "nunique"))
    assert len(got) == len(rows) and len(by) == 8
    assert (by.n == by.top + 1).all() and (by.n == by.distinct).all()
    assert by.bytes.max() < 1.02 * by.bytes.mean() and by.bytes.min() > 0.98 * by.bytes.mean()
    text = {i: t for i, t, *_ in rows}
    assert all(s == len(text[i].encode()) + 16 and c == zlib.crc32(text[i].encode()) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    pairs = got[got.doc_id >= 5000].assign(k=lambda d: d.doc_id.map(text)).groupby("k").shard.nunique()
    assert (pairs == 1).all()


def plain_tree(units, first, shards):
    """Bytes of each shard: units (w, keys) split at the weighted quantile of the widest dimension."""
    if shards == 1 or not units:
        return {first: sum(w for w, _ in units)} if units else {}
    dim = max(range(4), key=lambda i: (max(k[i] for _, k in units) - min(k[i] for _, k in units), -i))
    weight = {}
    for w, k in units:
        weight[k[dim]] = weight.get(k[dim], 0) + w
    want, before = sum(weight.values()) * (shards // 2) / shards, 0
    for key in sorted(weight):
        if before + weight[key] >= want:
            break
        before += weight[key]
    split = key + (before + weight[key] - want < want - before)
    half = shards // 2
    return plain_tree([u for u in units if u[1][dim] < split], first, half) | plain_tree([u for u in units if u[1][dim] >= split], first + half, shards - half)


def test_shards_equal_a_plain_kd_tree(spark, monkeypatch):
    r, grow, seen = random.Random(8), kd_shards._grow, []
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0)

    def spy(units, shards, total):
        seen[:] = [(u.w, (u.k0, u.k1, u.k2, u.k3)) for u in units.collect()]
        return grow(units, shards, total)

    monkeypatch.setattr(kd_shards, "_grow", spy)
    rows = [(r.randint(-50, 5000), "x" * r.randint(0, 400) + str(i % 700), r.choice(["en", "de", None]), f"one long prefix {r.randint(1, 9)}") for i in range(900)]
    for shards in (2, 5, 8):
        got = kd_shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards).toPandas()
        assert got.groupby("shard")["size"].sum().to_dict() == plain_tree(seen, 0, shards)
        assert len({k[1] for _, k in seen}) > 2 and len({k[2] >> 40 for _, k in seen}) == 9


def test_shards_edges(spark):
    got = kd_shards.shard(edge(spark), 3).collect()
    assert len(got) == 8 and {r.law for r in got} == {"bytes"} and all(0 <= r.shard < 3 for r in got)
    assert kd_shards.shard(edge(spark).limit(0), 3).count() == 0
    assert kd_shards.shard(edge(spark), 1).where("shard <> 0").count() == 0


# ---- op3


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rules in (("block", BLOCK), ("allow", ALLOW)):
        for r in rules:
            h, _, p = r.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
                best = (r, verdict)
    return host, path, *(best or (None, "allow"))


def test_url_rules_against_brute_force(spark):
    r = random.Random(3)
    urls = [None, "", "nothing", "://", "http://", "http://NET/", "a://b://c/"]
    for _ in range(600):
        host = ".".join(r.choice(["net", "org", "com", "example", "EXAMPLE", "a", ""]) for _ in range(r.randint(1, 4)))
        urls.append(r.choice(["http://", "https://", ""]) + host + r.choice(["", "/", "?", "#"]) + r.choice(["", "en/", "de/x", "fr/", "fr", "/en/"]) + r.choice(["", "?q=/en/", "#t"]))
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge(d, BLOCK, ALLOW).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls)}
    assert url_rules.judge(d.limit(0), BLOCK, ALLOW).count() == 0
    assert {x.verdict for x in url_rules.judge(d, [], []).collect()} == {"allow"}


def test_rule_paths_may_end_within_a_segment():
    t = url_rules.RuleTrie(["a.b/x/ab"], ["a.b/x/", "b"])
    assert t.match("c.a.b", "/x/abc") == ("block", "a.b/x/ab")
    assert t.match("a.b", "/x/ac") == ("allow", "a.b/x/")
    assert t.match("a.b", "") == ("allow", "b") and t.match("ab", "/x/ab") is None
    assert url_rules.RuleTrie(["a/x"], ["a/x"]).match("a", "/x") == ("block", "a/x")


# ---- op6


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return path, lib.Tokenizer.from_file(path), bpe_automaton.Encoder(json.load(f))


ALPHABET = "aabbeetthhiinnÀéßΣσς漢字İı'’́😀  \x1c\x85\n\t12٣½<|>endoftext.,!-_sSdtT"


@given(st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "<|startoftext|>", "'re", "the "]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_encoding_equals_the_library(tokenizer, s):
    _, lib, own = tokenizer
    want = lib.encode(s, add_special_tokens=False).ids
    ids = own.encode(s)
    assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_encode_table(spark, tokenizer):
    path, lib, _ = tokenizer
    got = bpe_automaton.encode_decode(edge(spark), path).collect()
    assert len(got) == 8
    for t, r in [("", next(x for x in got if x.doc_id == 2)), ("x" * 3000, next(x for x in got if x.doc_id == 3))]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_automaton.encode_decode(edge(spark).limit(0), path).count() == 0


def test_automaton_spells_each_word_by_one_path():
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab", "ba"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a")]
    auto, token = bpe_automaton.Automaton(vocab, merges), {i: t for t, i in vocab.items()}

    def plain(word):
        parts, rank = list(word), {m: i for i, m in enumerate(merges)}
        while True:
            best = min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(99, 0))
            if best[0] == 99:
                return parts
            pair = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append("".join(pair))
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    for n in range(1, 11):
        for k in range(1 << n):
            w = "".join("ab"[k >> i & 1] for i in range(n))
            assert [token[i] for i in auto.encode(w)] == plain(w)
    # the gadgets once more, on an automaton with all its arcs written out
    out, leads = [{"a", "b"}], {"a": 0, "b": 0}
    for u, v in merges:
        x = u + v
        if v in out[leads[u]]:
            for arcs in out:
                arcs |= {x} if u in arcs else set()
        leads[x] = leads[v]
        out.append(out[leads[u]] - {v} - ({x} if u == v else set()))
        leads[u] = len(out) - 1
    for t in vocab:
        for x in vocab:
            assert auto.arc(auto.state[vocab[t]], vocab[x]) == (x in out[leads[t]]), (t, x)


# ---- op9


def one_by_one(counts, capacities, permitted):
    bins, mass = [], sum(k * n for k, n in counts.items())
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [b for b in bins if b[0] >= length]
            if fit:
                b = min(fit, key=lambda x: x[0])
            else:
                after = mass - length
                c = min((c for c in permitted if c >= length), key=lambda c: ((c + best_fit.OVERHEAD) / (length + min(c - length, after)), c))
                bins.append(b := [c, 0])
            b[0] -= length
            b[1] += length
            mass -= length
    return sum(next(c for c in capacities if c >= b[1]) + best_fit.OVERHEAD for b in bins)


def test_plan_equals_packing_one_by_one():
    r, caps = random.Random(3), (8, 16, 32, 64)
    for _ in range(60):
        counts = {r.randint(1, 64): r.randint(1, 60) for _ in range(r.randint(1, 25))}
        sets = [tuple(c for j, c in enumerate(caps) if j == 3 or i >> j & 1) for i in range(8)]
        costs = [one_by_one(counts, caps, s) for s in sets]
        assert [best_fit.Plan(counts, caps, s).cost for s in sets] == costs
        assert best_fit.plan(counts, caps).cost == min(costs)


def test_pack_table_is_whole_and_fits(spark):
    r = random.Random(6)
    rows = [(i, "y" * r.choice([0, 5, 5, 5, 5, r.randint(0, 200)])) for i in range(800)] + [(None, None), (7, "y" * 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = best_fit.pack(d, (16, 32, 64)).toPandas()
    assert got.length.sum() == sum(len(t or "") + 1 for _, t in rows)
    counts = got.groupby("length").size().to_dict()
    assert best_fit.plan(counts, (16, 32, 64)).cost == got.groupby("bin_id").bin_capacity.first().add(best_fit.OVERHEAD).sum()
    for _, b in got.sort_values(["bin_id", "bin_offset"]).groupby("bin_id"):
        at = 0
        for o, n in zip(b.bin_offset, b.length, strict=True):
            assert o == at
            at += n
        assert at == b.bin_used.iloc[0] <= b.bin_capacity.iloc[0] and b.bin_capacity.nunique() == 1
        assert all(c >= b.bin_capacity.iloc[0] or c < at for c in (16, 32, 64))


def test_pack_edges(spark):
    assert best_fit.pack(edge(spark)).count() == 8
    assert best_fit.pack(edge(spark).limit(0)).count() == 0
    whole = best_fit.pack(edge(spark).where("doc_id = 3"), (64, 128)).toPandas()
    assert sorted(whole.start.unique()) == list(range(0, 3001, 128)) and whole.length.sum() == 2 * 3001
