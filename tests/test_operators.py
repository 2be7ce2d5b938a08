"""Operators on literal fixtures with hand-computed results."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, citations, dedup, evaluation, graph, registry, retrieval, sampling, stats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_filter_audit(spark):
    d = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, n int")
    a = audit.filter_audit(d, "len", ("missing", F.col("n").isNull()), ("short", F.col("n") < 10))
    assert rows(a.kept) == [(3, 50)]
    assert rows(a.manifest("id")) == [("len", 1, False, "short"), ("len", 2, False, "missing"), ("len", 3, True, None)]
    assert rows(a.counts()) == [("missing", 1), ("short", 1)]
    assert rows(a.rollup()) == [("len", 3, 1, 2)]


def test_span_violations(spark):
    d = spark.createDataFrame([("abc", 0, 2, "ab"), ("abc", 0, 2, "xx"), ("abc", 2, 9, "c"), ("abc", None, 1, "a")], "t string, s int, e int, m string")
    got = [r[0] for r in d.select(audit.span_violations(d, "t", "s", "e", "m")).collect()]
    assert got == [[], ["span_text_mismatch"], ["invalid_span"], ["invalid_span"]]


def test_rules_require_and_veto(spark):
    rules = spark.createDataFrame([("a", "regex", "veto", "[0-9]", "digits"), ("b", "marker", "require", "PLEASE", "rude")], "rule_id string, kind string, mode string, pattern string, reason string")
    d = spark.createDataFrame([(1, "please go"), (2, "go 1")], "id int, t string")
    assert rows(audit.rule_reasons(d, rules, "id", "t")) == [(1, []), (2, ["digits", "rude"])]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c c c c")], "id int, t string")
    q = spark.createDataFrame([(9, "a")], "q int, t string")
    n, avgdl, df, tf, dl = 3, 3.0, 1, 2, 3
    idf = math.log((n - df + 0.5) / (df + 0.5))
    want = idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    got = rows(retrieval.bm25(docs, "id", "t", q, "q", "t"))
    assert got[0][:2] == (9, 1) and got[0][2] == pytest.approx(want)


def test_rrf_counts_a_branch_once_and_drops_zero_scores(spark):
    hits = spark.createDataFrame(
        [("q", "a", "x", 1, 3.0), ("q", "a", "x", 2, 2.0), ("q", "b", "x", 3, 1.0), ("q", "b", "y", 1, 0.0)],
        "query_id string, branch string, candidate_id string, rank int, score double",
    )
    got = rows(retrieval.reciprocal_rank_fusion(hits, {"a": 1.1, "b": 1.0}).select("candidate_id", "rrf_score"))
    assert len(got) == 1 and got[0][1] == pytest.approx(1.1 / 61 + 1 / 63)


def test_min_max_without_spread_is_one(spark):
    d = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("q", "b", 3.0)], "query_id string, branch string, score double")
    assert rows(retrieval.min_max(d, "score", "query_id", "branch").select("branch", "normalized")) == [("a", 1.0), ("b", 0.0), ("b", 1.0)]


def test_selection_and_abstention(spark):
    d = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("q", "c", -5.0), ("z", "a", -1.0)], "query_id string, candidate_id string, logit double")
    s = retrieval.select_evidence(d, 0.55, 1)
    assert rows(s.select("query_id", "candidate_id", "reason")) == [("q", "a", "selected"), ("q", "b", "over_limit"), ("q", "c", "below_floor"), ("z", "a", "below_floor")]
    assert rows(retrieval.abstentions(s)) == [("z", "no_candidate_above_floor")]


def test_prefix_budget_never_skips(spark):
    d = spark.createDataFrame([("g", 1, 5), ("g", 2, 10), ("g", 3, 1)], "g string, o int, n int")
    assert [r.o for r in retrieval.prefix_budget(d, "g", ["o"], "n", 6).collect()] == [1]


def test_graph_paths_are_simple_and_edges_known(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "x", "zz")], "source_id string, type string, target_id string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    near = graph.adjacency(e, n)
    assert near.count() == 6
    seeds = spark.createDataFrame([("q", "a")], "query_id string, node string")
    p = graph.expand(seeds, near, 2)
    assert rows(p.select(F.array_join("nodes", ">"))) == [("a",), ("a>b",), ("a>b>c",), ("a>c",), ("a>c>b",)]
    assert rows(graph.reach(p, 0.5).select("node", "hop", "score", "n_paths"), "node") == [("a", 0, 1.0, 1), ("b", 1, 0.5, 2), ("c", 1, 0.5, 2)]
    assert rows(graph.dangling(e, n)) == [("c", "x", "zz")]
    assert dict(rows(graph.degree(e)))["c"] == 3


def test_label_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 8)], "a int, b int")
    got = dict(rows(graph.label_components(nodes, edges)))
    assert [got[i] for i in range(12)] == [0] * 7 + [7, 8, 8, 10, 11]


def test_catalog_acronyms_need_one_partner(spark):
    d = spark.createDataFrame(
        [("corpus", "organisation", "WHO"), ("corpus", "organisation", "World Health Organization"), ("corpus", "organisation", "ABC"), ("corpus", "organisation", "Alpha Beta Co"), ("corpus", "organisation", "Array Base Code"), ("corpus", "unknown", "who")],
        "namespace string, entity_type string, label string",
    )
    got = {r.canonical_name: r.aliases for r in registry.entity_catalog(d).collect()}
    assert got["World Health Organization"] == ["who", "world health organization"]
    assert len(got) == 4 and got["ABC"] == ["abc"]


def test_registry_and_overlays(spark):
    f = spark.createDataFrame([("documents/a/x.pdf", "h1"), ("documents/b/x.pdf", "h1"), ("documents/y.pdf", "h2")], "relative_path string, content_sha256 string")
    got = registry.content_registry(f).orderBy("content_sha256").collect()
    assert got[0].relative_paths == ["documents/a/x.pdf", "documents/b/x.pdf"] and got[0].copies == 2
    r = spark.createDataFrame([(1, "H2", None), (2, None, "a/x.pdf"), (3, None, "other/x.pdf")], "ord int, sha256 string, path string")
    assert rows(registry.overlay_match(f, r)) == [("documents/a/x.pdf", 2, "path"), ("documents/y.pdf", 1, "hash")]


def test_contained_text(spark):
    long = "a long enough passage that other rows may well contain whole"
    d = spark.createDataFrame([("d", 1, long), ("d", 2, long), ("d", 3, long.upper() + " and more"), ("d", 4, "short"), ("d", 5, "short text")], "g string, o int, t string")
    assert [r.o for r in dedup.contained(d, "g", "o", "t").orderBy("o").collect()] == [3, 4, 5]


def test_near_pairs_against_brute_force(spark):
    import random

    r = random.Random(4)
    base = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven", "ab c d"]
    texts = [" ".join(w if r.random() > 0.12 else w[::-1] for w in base[i % 3].split()) for i in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tf = []
    for t in texts:
        g = {}
        for w in t.split():
            p = f" {w} "
            grams = [p] if len(p) <= 3 else []
            for n in (3, 4, 5):
                if n > 3 and len(p) == n:
                    grams.append(p)
                elif len(p) > n:
                    grams += [p[k : k + n] for k in range(len(p) - n + 1)]
            for x in grams:
                g[x] = g.get(x, 0) + 1
        tf.append(g)
    n = len(texts)
    df = {}
    for g in tf:
        for x in g:
            df[x] = df.get(x, 0) + 1
    vec = []
    for g in tf:
        v = {x: c * (math.log((1 + n) / (1 + df[x])) + 1) for x, c in g.items()}
        z = math.sqrt(sum(a * a for a in v.values()))
        vec.append({x: a / z for x, a in v.items()})
    want = {(a, b) for b in range(n) for a in range(b) if sum(x * vec[b].get(k, 0) for k, x in vec[a].items()) >= 0.8}
    got = {(x.prior_index, x.current_index) for x in dedup.near_pairs(d, "i", "t", 0.8).collect()}
    assert got == want and want


def test_greedy_accept():
    assert dedup.greedy_accept([1, 2, 3], [(1, 2), (2, 3)]) == [1, 3]


def test_sampling(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id int, s string")
    split = sampling.stratified_split(d, "id", ["s"], "1")
    assert rows(split.groupBy("s", "split").count()) == [("a", "dev", 4), ("a", "test", 2), ("a", "train", 14), ("b", "dev", 4), ("b", "test", 2), ("b", "train", 14)]
    assert rows(split.select("id", "split")) == rows(sampling.stratified_split(d.orderBy(F.desc("id")), "id", ["s"], "1").select("id", "split"))
    assert rows(sampling.stride_shard(d, "id", 3).select("id", "shard")) == [(i, i % 3) for i in range(40)]
    assert rows(sampling.round_robin(d, "id", "s", 5, "x").groupBy("s").count()) == [("a", 3), ("b", 2)]
    events = spark.createDataFrame([("a", None), (None, ["a", "b"])], "request_id string, request_ids array<string>")
    schedule = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    r = sampling.retry_counts(schedule, events)
    assert rows(r) == [("a", 2), ("b", 1), ("c", 0)] and rows(sampling.over_budget(r, 1)) == [("a", 2)]


def test_statistics_by_hand(spark):
    p = spark.createDataFrame([(1, 0.9, 0.7), (2, 0.6, 0.8)], "id int, a double, b double")
    s = stats.paired_summary(p).first()
    assert s.n == 2 and s.win_rate == 0.5 and s.loss_rate == 0.5 and abs(s.mean_difference) < 1e-12
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0)], "g string, v double")
    assert stats.exact_sign_permutation(d, "g", "v").first().p_value == pytest.approx(2 / 8)
    q = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    assert [r.q_value for r in stats.benjamini_hochberg(q, "p", "i").orderBy("i").collect()] == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]
    k = spark.createDataFrame([(1, 1), (2, 2), (1, 2), (3, None)], "a int, b int")
    assert stats.weighted_kappa(k, "a", "b").first().kappa == pytest.approx(1 - 1 * 3 / (2 * 2 + 1 * 1))
    same = spark.createDataFrame([(1, 1)], "a int, b int")
    assert stats.weighted_kappa(same, "a", "b").first().kappa == 1.0
    r = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 2), (2, "y", 2), (3, "x", 1)], "u int, r string, s int")
    assert stats.ordinal_alpha(r, "u", "r", "s").first().alpha == pytest.approx(1 - 2 * 3 / (2 * (4 * 13 - 49)))
    assert stats.monte_carlo_sign_permutation([1.0] * 20, 99) == pytest.approx(0.01)


def test_chrf_and_rouge(spark):
    d = spark.createDataFrame([("abcdef", "abcdef"), ("abc", "xyz"), ("ab", "abb"), (None, "x"), ("", "x")], "r string, h string")
    got = [x[0] for x in d.select(stats.chrf(F.col("r"), F.col("h"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[3] is None and got[4] == 0.0
    f1 = 5 * (2 / 3) * 1.0 / (4 * (2 / 3) + 1.0)
    f2 = 5 * 0.5 * 1.0 / (4 * 0.5 + 1.0)
    assert got[2] == pytest.approx((f1 + f2) / 2)
    l = spark.createDataFrame([("a b c d", "a c d"), ("a", None)], "r string, h string").select(stats.rouge_l("r", "h")).collect()
    assert l[0][0] == pytest.approx(6 / 7) and l[1][0] is None


def test_citation_support(spark):
    c = spark.createDataFrame([("r", 0, True, ["E1", "E2"]), ("r", 1, True, []), ("r", 2, False, [])], "response_id string, claim_index int, is_factual boolean, known_ids array<string>")
    s = spark.createDataFrame([("r", 0, ["E2", "E1"], 0.9), ("r", 0, ["E1"], 0.8), ("r", 0, ["E2"], 0.1)], "response_id string, claim_index int, premise_ids array<string>, score double")
    got = citations.support(c, s, 0.5).first()
    assert (got.factual, got.supported, got.necessary, got.overcitations) == (2, 1, 1, 1)
    assert got.claim_recall == 0.5 and got.citation_precision == 0.5


def test_fit_prompt_prefers_the_first_payload(spark):
    d = spark.createDataFrame([("g", p, b, k, n) for p, b in ((0, 50), (1, 10)) for k, n in ((0, 0), (1, 20), (2, 100))], "g string, payload int, base int, place int, size int")
    assert tuple(citations.fit_prompt(d, "g", 80).first()) == ("g", 0, 1, 70)
    assert tuple(citations.fit_prompt(d, "g", 45).first()) == ("g", 1, 1, 30)
    assert citations.fit_prompt(d, "g", 5).count() == 0


def test_every_fiftieth_vector_asks_all_vectors(spark, tmp_path):
    import random

    from millrace.plans import catalog

    r = random.Random(5)
    vecs = [[r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) / 2 for _ in range(4)] for _ in range(160)]
    vecs[7] = vecs[130] = vecs[3]
    spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    top, want = {}, set()
    for i, q in enumerate(vecs):
        if i % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in enumerate(vecs) if j != i)[:12]
        top[i] = [-x for x, _ in s]
        want |= {(i, j, n) for n, (x, j) in enumerate(s, 1) if -x >= 0.25}
    known = catalog.queries()
    got = {(x.query_id, x.candidate_id, x.rank) for x in known["dense_topk"](spark, str(tmp_path)).collect()}
    assert got == want and {x[0] for x in got} <= {0, 50, 100, 150} and max(x[1] for x in got) > 100
    chosen = known["evidence_select"](spark, str(tmp_path)).collect()
    assert len(chosen) == 4 * 12
    none = {i for i, s in top.items() if 1 / (1 + math.exp(3 - 10 * s[0])) < 0.55}
    assert {x.query_id for x in known["evidence_abstentions"](spark, str(tmp_path)).collect()} == none


def test_no_group_of_differences_is_lost(spark):
    d = [("a", 1.0), ("a", 2.0), ("a", 3.0)] + [("b", 1.0)] * 17 + [("c", float(i % 7 - 3) + i / 64) for i in range(5000)] + [("z", 0.0)] * 20
    d += [("m", x) for x in (5.0, 4.0, 3.0, 2.5, -1.0, 1.5, 0.5, -0.25, 1.25, -2.0, 1.0, 0.75, -0.5, 2.0, 1.75, 0.1, -3.0)]
    got = {r.g: (r.n, r.p_value) for r in stats.sign_permutation(spark.createDataFrame(d, "g string, v double").repartition(7), "g", "v").collect()}
    assert {k: n for k, (n, _) in got.items()} == {"a": 3, "b": 17, "c": 5000, "z": 20, "m": 17}
    assert got["a"][1] == pytest.approx(2 / 8) and got["z"][1] == 1.0
    assert got["b"][1] < 0.001 and got["c"][1] == pytest.approx(1 / 10_001)
    sums = [0.0]
    for _, x in d[-17:]:
        sums = [s + y for s in sums for y in (x, -x)]
    exact = sum(abs(s) >= abs(sum(x for _, x in d[-17:])) - 1e-12 for s in sums) / len(sums)
    assert got["m"][1] == pytest.approx(exact, abs=5 * math.sqrt(exact * (1 - exact) / 10_000))


def test_chrf_pairs_scores_whole_texts(spark, tmp_path):
    from millrace.plans import catalog

    same = "the same sixty characters begin both of these texts, so that a cut would hide "
    spark.createDataFrame([(1, same + "this"), (2, same + "QQQQ zzzz"), (3, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dict(tuple(r) for r in catalog.queries()["chrf_pairs"](spark, str(tmp_path)).collect())
    assert set(got) == {1, 2} and 0.8 < got[1] < 0.99


def test_near_dup_pairs_covers_documents_and_collapses_copies(spark, tmp_path):
    from millrace.plans import catalog

    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron upsilon"
    texts = [long, long.upper(), long + " omega", "one two three four five six seven", long, "", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.kind, r.prior_index, r.current_index) for r in catalog.queries()["near_dup_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("near", 0, 2), ("copy", 0, 1), ("copy", 0, 4)}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r.prior_index, r.current_index) for r in dedup.near_pairs(d, "doc_id", "text", 0.8).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}


def test_bootstrap_uses_the_reference_number_of_resamples(spark):
    import inspect

    assert inspect.signature(stats.bootstrap_mean_ci).parameters["resamples"].default == 10_000
    d = spark.createDataFrame([(float(i % 10),) for i in range(1000)] + [(None,)], "v double")
    r = stats.bootstrap_mean_ci(d, "v").first()
    half = 1.96 * math.sqrt(8.25 / 1000)
    assert r.mean == 4.5 and r.low == pytest.approx(4.5 - half, abs=0.02) and r.high == pytest.approx(4.5 + half, abs=0.02)


def test_metric_family_keeps_the_whole_grid_and_one_correction(spark):
    values = {"a": [3.0, 4.0, 5.0, 6.0], "b": [1.0, 2.0, 3.0, 4.0], "c": [None, None, None, None]}
    long = [(str(i), v, x[i], -x[i] if x[i] is not None else None, "scored" if i else "missing") for v, x in values.items() for i in range(4)]
    d = spark.createDataFrame(long, "id string, v string, good double, loss double, loss_status string")
    f = {(r.comparison, r.metric): r for r in stats.metric_family(d, "id", "v", ["good", "loss"], [("a", "b"), ("a", "c")], ["loss"]).collect()}
    assert len(f) == 4
    good, loss = f["a_vs_b", "good"], f["a_vs_b", "loss"]
    assert (good.n, good.mean_difference, good.win_rate, good.p_value, good.direction) == (4, 2.0, 1.0, 2 / 16, "higher")
    assert (loss.n, loss.mean_difference, loss.win_rate, loss.p_value, loss.direction) == (3, 2.0, 1.0, 2 / 8, "lower")
    assert (good.q_value, loss.q_value) == (0.25, 0.25)
    none = f["a_vs_c", "good"]
    assert (none.n, none.status, none.p_value, none.q_value) == (0, "insufficient_pairs", None, None)
    empty = stats.metric_family(d.limit(0), "id", "v", ["good"], [("a", "b")]).collect()
    assert [(r.n, r.status) for r in empty] == [(0, "insufficient_pairs")]


def test_agreement_report(spark):
    d = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 2), (2, "y", 2), (3, "x", 3), (3, "y", 3), (3, "z", None), (4, "z", 1)], "u int, r string, s int")
    got = stats.agreement_report(d, "u", "r", "s").first()
    assert (got.distinct_raters, got.unit_count, got.overlap_count, got.observed_cells, got.expected_cells, got.missingness_count, got.status) == (3, 4, 3, 7, 12, 5, "scored")
    pairs, size = [(1, 2), (2, 2), (3, 3)], 2
    agree = lambda a, b: 1 - ((a - b) / size) ** 2
    seen = sum(agree(a, b) for a, b in pairs) / 3
    chance = sum(agree(a, b) for a, _ in pairs for _, b in pairs) / 9
    assert got.kappa["x_vs_y"] == pytest.approx((seen - chance) / (1 - chance))
    assert got.kappa["x_vs_z"] is None and got.kappa["y_vs_z"] is None
    apart = stats.agreement_report(spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "u int, r string, s int"), "u", "r", "s").first()
    assert (apart.status, apart.overlap_count, apart.alpha) == ("insufficient_overlap", 0, None)
    for bad in ([(1, "x", 1), (1, "x", 1), (1, "y", 1)], [(1, "x", 1)], [(1, None, 1), (1, "y", 1), (2, "x", 2)]):
        with pytest.raises(Exception, match="rater|duplicate"):
            stats.agreement_report(spark.createDataFrame(bad, "u int, r string, s int"), "u", "r", "s").collect()


def test_record_evaluation_states(spark):
    data = [
        ("ok", "in", "ref", "hyp", "English"), ("noref", "in", None, "hyp", "en"), ("nohyp", "in", "ref", " ", "eng"), ("hindi", "hi", "hi r", "hi h", "hin"),
        ("mismatch", "in", "ref", "hi h", "en"), ("french", "in", "ref", "hyp", "fr"), ("unknown", None, "ref", "hyp", None), ("blank", "", "ref", "hyp", "en"), (None, "in", "bad", "hyp", None),
    ]
    d = spark.createDataFrame(data, "i string, t string, r string, h string, l string")
    seen = {"rouge_l": lambda r, h: F.when(r == "bad", float("nan")).when(r.isNotNull(), 0.5), "detoxify": lambda r, h: F.when(h.isNotNull(), 0.1)}
    got = {x.ID: x for x in evaluation.evaluate_records(d, "i", "t", "r", "h", "l", lambda x: F.when(F.startswith(x, F.lit("hi")), "HINDI").otherwise("English"), seen).collect()}
    of = lambda i, m: tuple(got[i].metrics[m])
    assert {i: x.language_status for i, x in got.items()} == {"ok": "scored", "noref": "scored", "nohyp": "scored", "hindi": "scored", "mismatch": "mismatch", "french": "unsupported_language", "unknown": "unavailable", "blank": "unavailable", "": "scored"}
    assert of("ok", "rouge_l") == (0.5, "scored", None) and of("ok", "detoxify") == (0.1, "scored", None)
    assert of("ok", "meteor") == (None, "unavailable", "meteor_scorer_unavailable") and of("ok", "bertscore")[1] == "unavailable"
    assert of("noref", "rouge_l") == (None, "excluded_missing_reference", "missing_reference") and of("noref", "detoxify") == (0.1, "scored", None)
    assert of("noref", "chrf") == (None, "excluded_missing_reference", "missing_reference") and got["noref"].reference_available is False
    assert of("nohyp", "rouge_l") == (None, "missing_hypothesis", "missing_hypothesis") and of("nohyp", "detoxify") == (None, "invalid_score", "nonfinite_metric_value")
    assert of("hindi", "rouge_l") == (None, "unsupported_language", "english_only_metric") and of("hindi", "bertscore")[1] == "unavailable"
    assert of("mismatch", "bertscore") == (None, "language_mismatch", "detected_language_mismatch") and of("mismatch", "chrf")[1] == "scored"
    assert of("french", "bertscore") == (None, "unsupported_language", "language_not_supported")
    assert of("", "rouge_l") == (None, "invalid_score", "nonfinite_metric_value")
    assert (got["ok"].language_match, got["mismatch"].language_match, got["unknown"].language_match) == (True, False, None)
    plain = {x.ID: x for x in evaluation.evaluate_records(d, "i", "t", "r", "h", "l").collect()}
    assert plain["ok"].language_status == "unavailable" and plain["ok"].metrics["chrf"].value == pytest.approx(0.0)
    assert evaluation.evaluate_records(d.limit(0), "i", "t", "r", "h", "l").collect() == []


def test_near_pairs_of_many_blocks_meet_without_a_shuffle(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(dedup, "BLOCK", 8)
    words = [f"word{i * 7919 % 97}" for i in range(97)]
    texts = [" ".join(words[i // 4 * 3 : i // 4 * 3 + 24]) + " é" * (i % 4) for i in range(64)]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    grams = [Counter(g for w in t.split() for g in dedup.word_grams(w)) for t in texts]
    df = Counter(g for x in grams for g in x)
    rows = [{g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in x.items()} for x in grams]
    norm = [math.sqrt(sum(x * x for x in r.values())) for r in rows]
    score = {(i, j): sum(x * rows[j].get(g, 0) for g, x in rows[i].items()) / norm[i] / norm[j] for j in range(64) for i in range(j)}
    near = dedup.representative_pairs(d, "i", "t", 0.8)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    got = {(r.prior_index, r.current_index): r.score for r in near.collect()}
    want = {k: pytest.approx(x) for k, x in score.items() if x >= 0.8}
    assert len(want) > 64 and got == want


def test_benjamini_hochberg_of_many_tests_is_linear(spark):
    d = [(i, [0.001 * (i % 400), 1.0, float("nan"), None][0 if i % 3 else 1 + i % 7 % 3]) for i in range(2000)]
    family = sorted(((p, i) for i, p in d if p is not None), key=lambda x: (math.isnan(x[0]), 0 if math.isnan(x[0]) else x[0], x[1]))
    want, least = {i: None for i, p in d if p is None}, 1.0
    for r in range(len(family), 0, -1):
        p, i = family[r - 1]
        least = min(least, p * len(family) / r) if p == p else least
        want[i] = least
    q = stats.benjamini_hochberg(spark.createDataFrame(d, "i int, p double"), "p", "i")
    assert {r.i: r.q_value for r in q.collect()} == want
    # a frame that ends at the last row is computed anew for every row
    assert "currentrow$(), unboundedfollowing" not in q._jdf.queryExecution().executedPlan().toString().lower()


def test_lexical_top_gives_on_only_what_may_be_best(spark, monkeypatch):
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu"]
    texts = [" ".join(words[(i * j + j) % 7] for j in range(1, 3 + i % 5)) for i in range(300)] + ["ant bee"] * 100 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3).cache()
    asked = spark.createDataFrame([("p", "ant bee bee"), ("q", "the fox"), ("r", "zebra"), ("s", None)], "q string, t string")
    plain = {"bm25": retrieval.bm25, "overlap": retrieval.overlap}
    monkeypatch.setattr(retrieval, "CELLS", 64)

    def best(df):
        return {(r.query_id, r.candidate_id, r.rank): r.score for r in retrieval.top_k(df.withColumn("score", F.round("score", 9)), 3).collect()}

    top = retrieval.lexical_top(docs, "id", "t", asked, "q", "t", 3)
    assert top.count() < 200  # of more than a thousand scores
    want = {b: best(f(docs, "id", "t", asked, "q", "t")) for b, f in plain.items()}
    assert {b: best(top.where(F.col("branch") == b)) for b in plain} == want
    monkeypatch.setattr(retrieval, "ASKED", 2)  # more terms than that: by joins
    joined = retrieval.lexical_top(docs, "id", "t", asked, "q", "t", 3)
    assert joined.count() > 500 and {b: best(joined.where(F.col("branch") == b)) for b in plain} == want
    twice = retrieval.lexical_top(docs.unionAll(docs.where("id = 1")), "id", "t", asked, "q", "t", 3)
    assert twice.count() > 500


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    from millrace.plans import catalog

    spark.createDataFrame([(i, f"é {i % 700}") for i in range(3000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, used in (("10000", "1000"), ("77", "77")):
            spark.conf.set(key, own)
            assert rows(catalog.queries()["duplicate_stats"](spark, str(tmp_path))) == [(3000, 700, 2300)]
            assert spark.conf.get(key) == used
    finally:
        spark.conf.set(key, before)


def test_record_evaluation_keeps_a_missing_id_null(spark, tmp_path):
    from millrace.plans import catalog

    spark.createDataFrame([(1, "a text", "en", "s"), (None, "other", None, "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["record_evaluation"](spark, str(tmp_path)).collect()
    assert {r.ID for r in got} == {"1", None} and len(got) == 10
