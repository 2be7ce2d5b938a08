"""Language ID, personal data, rotated codes, language model, near duplicates, pipeline: brute force and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bottom_k, interpolated_lm, language_id, personal_data, rotated_codes
from tests.llm.test_small_operators import edge

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))


# ---- op4


def synthetic(n, seed=1):
    r = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "er", "ü"], "cc": ["éa", "ou", "tion", "le"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang, f"s{i % 3}", 0))
    return rows


def test_gradients_equal_differences():
    m = language_id.BiGRU(["a", "b", "c"], hidden=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (5, 6)), np.array([0, 1, 2, 1, 0])
    _, g = m.gradients(x, y)
    for k, p in m.p.items():
        at = (x[0, 2], 5) if k in ("fx", "bx") else tuple(r.integers(0, s) for s in p.shape)
        old, e = p[at], 1e-3
        p[at] = old + e
        up = m.gradients(x, y)[0]
        p[at] = old - e
        down = m.gradients(x, y)[0]
        p[at] = old
        assert (up - down) / 2 / e == pytest.approx(g[k][at], rel=0.2, abs=2e-6)


def test_held_out_accuracy_and_fold(spark):
    rows = synthetic(500)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = language_id.identify(d).collect()
    lang = {i: k for i, _, k, *_ in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_every_position_is_labelled_and_pooled():
    m = language_id.BiGRU(["a", "b"])
    p = m.positions(np.frombuffer("wörter".encode(), np.uint8).reshape(1, -1))
    assert p.shape == (1, 7, 2) and np.allclose(p.sum(axis=2), 1)
    label, score = language_id.Reader(m).texts(["Wörter 123", "123 ...", None])
    assert label[1:] == ["und", "und"] and score[1:] == [0.0, 0.0]
    assert score[0] == pytest.approx(p.mean(axis=1).max(), abs=1e-5)


def test_language_edges(spark):
    got = language_id.identify(edge(spark)).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (1, 2, 6)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"lang"}
    assert language_id.identify(edge(spark).limit(0)).count() == 0
    none = edge(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}


# ---- op5

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for k, rule in RULES.items():
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 13 <= len(d) <= 19 and personal_data.luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


@given(st.text(alphabet="a@.0123 +-(9%b", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_plain_rules(t):
    assert personal_data.base_spans(t) == plain_spans(t)


def test_luhn_and_cards():
    t = "card 4539 5787 6362 1486, not 4539578763621487"
    assert [t[s:e] for k, s, e in personal_data.base_spans(t)] == ["4539 5787 6362 1486"]


def test_patterns_discover_unseen_identifiers(spark):
    r, w = random.Random(2), "the of and to in".split()
    rows = [(i, " ".join(r.choice(w) for _ in range(5)) + f" reach him at a{i}@b.com and call desk +1 555 000 1{i:03d} end") for i in range(40)]
    rows += [(100, "please reach him at bob [at] foo [dot] com now"), (101, "please call desk 555 123 4567 ok"), (102, "page 555 123 4567"), (103, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in personal_data.detect(d).collect()}
    assert got[100].spans == "email:20:42" and got[101].spans == "phone:17:29" and got[102].spans == "" == got[103].spans
    for i, t in rows:
        base = plain_spans(t or "")
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for x, *_ in base) for k in RULES]
        assert set(filter(None, personal_data.render(base).split(","))) <= set(got[i].spans.split(","))
    full = d.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    masked = {x.doc_id: x for x in personal_data.redact(full).collect()}
    assert masked[100].text == "please reach him at <email> now" and masked[101].text == "please call desk <phone> ok"
    assert masked[102].text == "page 555 123 4567" and masked[103].text is None
    assert masked[0].n_chars == len(masked[0].text) and "@" not in masked[0].text


def test_keys_and_swallowed_numbers_are_discovered(spark):
    r = random.Random(4)
    digits = lambda n, a: "".join(r.choice(a) for _ in range(n))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, f'{word()} {word()} token = "{digits(40, "0123456789abcdef")}" {word()} call +1 (555) 555-{1000 + i} {word()} {word()} 5123{i:03d}') for i in range(30)]
    late = [(50, 'x token = "zq81XkPw93LmNt02Vb77" y'), (51, f"commit {digits(40, '0123456789abcdef')} done"), (52, "call +1 (555) 555-4444 10.20.30.40 ok"), (53, "version zq81XkPw93LmNt02Vb77 here")]
    d = spark.createDataFrame(rows + late, "doc_id long, text string")
    got = {x.doc_id: x for x in personal_data.detect(d).collect()}
    text = dict(rows + late)
    cut = lambda i: [(k, text[i][int(s) : int(e)]) for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x)]
    assert all([k for k, _ in cut(i)] == ["phone", "secret"] and cut(i)[1][1] == t.split('"')[1] for i, t in rows)
    assert cut(50) == [("secret", "zq81XkPw93LmNt02Vb77")] and cut(51) == [] == cut(53)
    assert cut(52) == [("ip", "10.20.30.40"), ("phone", "+1 (555) 555-4444")] and (got[52].n_phone, got[52].added) == (0, 1)


def plain_confidences(edges):
    """The rounds of the pattern graph on plain dicts; edges are (kind, role, instance, pattern, weight)."""
    total, seeds, values = Counter(), Counter(), defaultdict(set)
    for k, role, x, p, w in edges:
        total[p] += w
        if role in ("seed", "strict"):
            seeds[p, k] += w
            values[p, k].add((role, x))
    sure = {pk: n / (total[pk[0]] + personal_data.SMOOTHING) for pk, n in seeds.items() if len(values[pk]) >= 2}
    for _ in range(personal_data.ROUNDS):
        miss = defaultdict(lambda: 1.0)
        loose = [(k, x, p, w) for k, role, x, p, w in edges if role == "loose" and (p, k) in sure]
        for k, x, p, _ in loose:
            miss[k, x] *= 1 - min(sure[p, k], 0.999)
        gained = Counter()
        for k, x, p, w in loose:
            gained[p, k] += w * (1 - miss[k, x])
        sure = {(p, k): (seeds[p, k] + gained[p, k]) / (total[p] + personal_data.SMOOTHING) for p, k in sure}
    return sure


def test_pattern_graph_against_brute_force(spark):
    r = random.Random(6)
    edges = {}
    for _ in range(400):
        role = r.choice(["seed", "strict", "loose", "loose", "other"])
        key = ("" if role == "other" else r.choice(personal_data.ALL_KINDS), role, None if role == "other" else f"v{r.randint(0, 30)}", f"p{r.randint(0, 12)}")
        edges[key] = r.randint(1, 9)
    rows = [(*k, w) for k, w in edges.items()]
    d = spark.createDataFrame(rows, "kind string, role string, instance string, pattern string, w long")
    got = {(x.pattern, x.kind): x.confidence for x in personal_data._confidences(d).collect()}
    want = plain_confidences(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_scanning_is_linear():
    import time

    for t in ("x" * 500_000 + "1" + "y" * 500_000, "[" * 300_000, "a1" * 500_000, "1 " * 300_000, "@a" * 300_000, "+1 " * 200_000, ".5" * 300_000):
        began = time.process_time()
        found = personal_data.candidates(t, personal_data.base_spans(t))
        words = [m.span() for m in personal_data._WORD.finditer(t)]
        for _, s, e, _ in found[:1000]:
            personal_data._patterns(t, words, [w[0] for w in words[:1]], s, e)
        assert time.process_time() - began < 8, t[:10]


def test_personal_edges(spark):
    got = personal_data.detect(edge(spark)).collect()
    assert len(got) == 8 and {r.spans for r in got} == {""}
    assert personal_data.detect(edge(spark).limit(0)).count() == 0


# ---- op7


def nearest(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted(((-float(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in ok if j != i))
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def test_search_against_brute_force_and_recall(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(600)]
    rows[7] = (7, rows[6][1])  # a tie
    bad = [(601, None), (602, [0.0] * 8), (603, [float("nan")] * 8), (604, [None] * 8), (None, [1.0] * 8), (606, [1.0]), (620, [float("inf")] * 8)]
    d = spark.createDataFrame([(i, v, "x") for i, v in [*rows, rows[5], *bad]], "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for x in rotated_codes.search(d, 20, 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    want = nearest(rows, 20, 5)
    assert set(got) == set(want)
    assert sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) >= 0.99 * 5 * len(want)
    assert all(abs(s - dict(want[q])[j]) < 1e-12 for q in want for j, s in got[q] if j in dict(want[q]))


def test_search_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert rotated_codes.search(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, -1.0])], schema)
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in rotated_codes.search(few).orderBy("rank").collect()] == [(0, 1, 1, 5.0), (0, 2, 2, -2.0)]
    assert rotated_codes.search(few.where("vec_id > 0")).count() == 0
    assert rotated_codes.search(few.where("vec_id = 0")).count() == 0


def test_bounds_hold_for_most_pairs():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 32)) + 0.3
    c = rotated_codes.Coder(x.mean(axis=0), 32)
    bits, norm, agree, base = c.codes(x)
    e, err = c.bounds(x[:50], bits, norm, agree, base)
    assert (np.abs(e - x[:50] @ x.T) <= err).mean() > 0.95


# ---- op8


def plain_lm(rows, binned):
    """Plain counts and estimates; the maximisation on each bigram's own values, or on the means of bins."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    tok = [words_of(t) + ["\n"] for _, t in rows]
    c, c2 = Counter(), Counter()
    for h, t in zip(held, tok, strict=True):
        if not h:
            c.update(t)
            c2.update(zip(["^", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    start = c["\n"]
    ctx = lambda w: start if w == "^" else c[w]
    at = lambda p: math.floor(-8 * math.log2(p)) if p > 0 else -1
    by = defaultdict(lambda: defaultdict(list))
    for (a, b), k in c2.items():
        p2, p1 = (k - 1) / (ctx(a) - 1) if ctx(a) > 1 else 0, (c[b] - 1) / max(n - 1, 1)
        by[int(math.log2(ctx(a)))][(at(p2), at(p1)) if binned else (a, b)].append((k, p2, p1, 1 / (v + 1)))
    weights = {}
    for b in range(max(by, default=-1) + 1):
        if b not in by:
            weights[b] = weights[b - 1] if b else np.array([0, 0, 1.0])
            continue
        r = np.array([[sum(x[0] for x in g), *(sum(x[0] * x[i] for x in g) / sum(x[0] for x in g) for i in (1, 2, 3))] for g in by[b].values()])
        x = np.full(3, 1 / 3)
        for _ in range(interpolated_lm.ROUNDS):
            m = r[:, 1:] * x
            new = (r[:, :1] * m / m.sum(1, keepdims=True)).sum(0) / r[:, 0].sum()
            moved, x = np.abs(new - x).max(), new
            if moved <= interpolated_lm.STILL:
                break
        weights[b] = x
    out = []
    for h, t in zip(held, tok, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        s = 0.0
        for a, b in zip(["^", *t[:-1]], t, strict=True):
            x = weights.get(min(int(math.log2(max(ctx(a), 1))), max(weights, default=0)), np.array([0, 0, 1.0]))
            s += math.log10(x[0] * c2[a, b] / max(ctx(a), 1) + x[1] * c[b] / max(n, 1) + x[2] / (v + 1))
        out.append((h, len(t), sum(c[w] > 0 for w in t), n, base, s))
    return out


def test_language_model_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(300)] + [(300, None), (300, "W1 w1\tw1"), (None, "w2")]
    rows += [(400 + i, " ".join(r.choice(vocabulary) for _ in range(700))) for i in range(2)]  # longer than a chunk
    d = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").coalesce(1)
    for chunk, bucket in ((50, 100), (1_500_000, 1_000_000)):
        monkeypatch.setattr(interpolated_lm, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(interpolated_lm, "BUCKET_TOKENS", bucket)
        got = sorted(map(tuple, interpolated_lm.score(d).collect()), key=repr)
        for binned, rel in ((True, 1e-9), (False, 2e-3)):
            want = sorted(((i, *x) for (i, _), x in zip(rows, plain_lm(rows, binned), strict=True)), key=repr)
            assert len(got) == len(want)
            for a, b in zip(got, want, strict=True):
                assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=rel)


def test_language_model_edges(spark):
    got = interpolated_lm.score(edge(spark)).collect()
    assert len(got) == 8 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 6)} == {1}
    assert interpolated_lm.score(edge(spark).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = interpolated_lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only.train_tokens, only.n_known, only.n_tokens, only.score, only.base_score) == (0, 0, 3, 0.0, 0.0)


def test_key_and_count_packing():
    k = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (interpolated_lm.unpack_keys(*interpolated_lm.pack_keys(k)) == k).all()
    c = np.array([0, 1, 254, 255, 256, 10**12])
    assert (interpolated_lm.unpack_counts(interpolated_lm.pack_counts(c)) == c).all()


# ---- op10


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in g]
    return out


def near_rows(seed=3):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 5000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 6, 30, 150, 400]))]
        for _ in range(r.choice([1, 2, 3, 40])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(80)]  # a passage many documents share
    rows += ["the same text over and over again"] * 60 + ["", None, "one two", "One  two"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long").repartition(4)
    got = sorted(tuple(r)[:4] for r in bottom_k.near_duplicates(d).collect())
    assert got == sorted(plain_components(rows))


def test_chains_and_hot_near_copies(spark):
    # a chain whose ends are far apart, and copies that differ from the base by more and more
    base = [f"t{i}" for i in range(200)]
    rows = [" ".join(base[:k] + [f"x{i}" for i in range(k)] + base[k:]) for k in range(0, 60, 4)]
    r = random.Random(1)
    for i in range(250):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(200)] = f"y{i}_{r.randint(0, 99)}"
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in bottom_k.near_duplicates(d).collect()) == sorted(plain_components(rows))


def test_near_duplicate_edges(spark):
    got = bottom_k.near_duplicates(edge(spark)).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id == 2] == [(0, 2, True)]
    assert bottom_k.near_duplicates(edge(spark).limit(0)).count() == 0
    stays = bottom_k.keep_one(edge(spark)).collect()
    assert sorted((r.doc_id or 0) for r in stays) == [0, 1, 2, 3, 4, 6] and stays[0].asDict().keys() == edge(spark).first().asDict().keys()


def test_keep_one_judges_rows_not_ids(spark):
    y, x, z = ("y " * 9 + "end one two three", "x " * 9 + "other words here", "z " * 9 + "third text now")
    rows = [(3, y), (5, x), (5, y), (7, z), (None, z), (None, "only nulls"), (None, "only nulls"), (8, ""), (8, "")]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, value int")
    got = sorted(((r.doc_id, r.text) for r in bottom_k.keep_one(d).collect()), key=repr)
    assert got == sorted([(3, y), (5, x), (7, z), (None, "only nulls"), (8, ""), (8, "")], key=repr)


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    # no star rounds: the last round alone must find every component, whatever the size of a block
    monkeypatch.setattr(bottom_k, "BLOCK", 7)
    rows = near_rows(5)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for stars in (0, 1):
        monkeypatch.setattr(bottom_k, "STARS", stars)
        assert sorted(tuple(r)[:4] for r in bottom_k.near_duplicates(d).collect()) == sorted(plain_components(rows))


# ---- pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows = synthetic(120, 5)
    rows += [(1000, rows[0][1], "aa", "s", 0), (1001, "12345 !!! ...", "aa", "s", 0), (1002, None, None, None, None), (1003, "kalo mitu kami write to me@mail.example.com kalo tumi", "aa", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "personal_data", "packing"]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if i + 1 < len(names):
            assert docs.columns == d.columns
    gone = {r[0] for r in rows} - {r.doc_id for r in seen["language_id"]}
    assert gone == {1001, 1002}
    want = {i for i, _, least, kept in plain_components([(i, t) for i, t, *_ in rows if i not in gone]) if kept}
    assert {r.doc_id for r in seen["near_dedup"]} == want and 1000 not in want
    text = {r.doc_id: r.text for r in seen["personal_data"]}
    assert "<email>" in text[1003] and "@" not in text[1003]
    assert {r.doc_id for r in seen["packing"]} == want and sum(r.length for r in seen["packing"]) == sum(len(t) + 1 for t in text.values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(whole, key=key) == sorted(seen["packing"], key=key)
    empty = docs.sparkSession.createDataFrame([], d.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_every_word_of_a_training_text_is_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.BiGRU, "fit", lambda self, words: seen.extend(words))
    texts = {n: " ".join(f"w{i}" for i in range(n)) for n in (40, 100, 150, 199, 1234) if zlib.crc32(str(n).encode()) % 5}
    language_id.train(spark.createDataFrame([(n, t, "en") for n, t in texts.items()], "doc_id long, text string, lang string"))
    assert sorted(w for w, _ in seen) == sorted(w.encode() for t in texts.values() for w in t.split()) and len(texts) > 2


def plain_bigru(m, word):
    """The network position by position and number by number, without arrays over time or words."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for d in "fb":
        state, run = [0.0] * m.h, {}
        for i in range(len(word)) if d == "f" else reversed(range(len(word))):
            a = m.p[d + "x"][word[i]]
            b = [sum(state[k] * float(m.p[d + "u"][k][j]) for k in range(m.h)) for j in range(3 * m.h)]
            z = [sig(float(a[j]) + b[j]) for j in range(m.h)]
            r = [sig(float(a[m.h + j]) + b[m.h + j]) for j in range(m.h)]
            c = [math.tanh(float(a[2 * m.h + j]) + r[j] * b[2 * m.h + j]) for j in range(m.h)]
            state = [c[j] + z[j] * (state[j] - c[j]) for j in range(m.h)]
            run[i] = state
        states[d] = run
    out = []
    for i in range(len(word)):
        both = states["f"][i] + states["b"][i]
        s = [math.exp(sum(x * float(m.p["o"][k][j]) for k, x in enumerate(both)) + float(m.p["c"][j])) for j in range(len(m.labels))]
        out.append([x / sum(s) for x in s])
    return out


def test_predictions_against_a_plain_forward_pass():
    m = language_id.BiGRU(["a", "b", "c"], hidden=5, seed=3)
    texts = ["Wörter und mehr 123", "x" * 80 + " kurz", "eins", "a b c d e f g", "12 ab 34"]
    labels, scores = language_id.Reader(m).texts(texts)
    for t, label, score in zip(texts, labels, scores, strict=True):
        each = [p for w in t.lower().split() if language_id.has_letter(w) for part in language_id.windows(w) for p in plain_bigru(m, part)]
        mean = [sum(p[j] for p in each) / len(each) for j in range(3)]
        assert score == pytest.approx(max(mean), abs=1e-5) and label == m.labels[mean.index(max(mean))]


def test_the_estimate_keeps_a_pair_six_deviations_low(spark):
    from pyspark.sql import functions as F

    from millrace.llm import bottom_k

    shared = list(range(28))  # of the 64 smallest values of the union
    d = spark.createDataFrame([(shared + list(range(100, 218, 2)), shared + list(range(101, 219, 2)))], "x array<long>, y array<long>")
    got = d.select(bottom_k._estimate("x", "y", 64).alias("keep"), F.size(F.array_union("x", "y")).alias("n")).first()
    assert got.n >= 64 and got.keep
