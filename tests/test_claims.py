"""Claim validation, the claim graph, seeded expansion, gates and lineage on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import claims, expansion, gates, lineage

TEXT = "Alpha causes beta."
GOOD = dict(document_uid="d", chunk_id="c", text=TEXT, claim_index=0, claim_id="x", mentions=[("m1", "Alpha", 0, 5, "ENT:a", "canonical", "Alpha"), ("m2", "beta", 13, 17, "ENT:b", "canonical", "Beta")], subject="m1", object=("m2", None, None), predicate="causes", polarity="affirmed", polarity_scope=None, modality="asserted", attribution=None, evidence_stance="supports", model_confidence=0.9)


def table(spark, *changes):
    rows = [tuple({**GOOD, "claim_index": i, **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, claims.CLAIM.replace("\n", " "))


def test_validation_reasons_and_routes(spark):
    m = GOOD["mentions"]
    cases = [
        ({}, "accepted", []),
        ({"evidence_stance": "quotes"}, "reviewed", ["quoted_only"]),
        ({"mentions": [m[0], ("m2", "beta", 13, 17, None, "nil", "Beta")]}, "reviewed", ["unresolved_entity"]),
        ({"mentions": [("m1", "Alpha", 1, 6, "ENT:a", "canonical", "A"), m[1]]}, "quarantined", ["mention_span_mismatch", "subject_endpoint_missing"]),
        ({"mentions": [m[0], m[1], m[1]]}, "quarantined", ["duplicate_mention_id"]),
        ({"mentions": []}, "quarantined", ["mentions_not_nonempty_list", "object_endpoint_missing", "subject_endpoint_missing"]),
        ({"mentions": None}, "quarantined", ["mentions_not_nonempty_list", "object_endpoint_missing", "subject_endpoint_missing"]),
        ({"predicate": "likes"}, "quarantined", ["unknown_predicate"]),
        ({"polarity": "negated"}, "quarantined", ["missing_polarity_scope"]),
        ({"polarity": "negated", "polarity_scope": ("causes", 6, 12)}, "accepted", []),
        ({"polarity_scope": ("causes", 5, 11)}, "quarantined", ["polarity_scope_mismatch"]),
        ({"model_confidence": 1.5}, "quarantined", ["invalid_model_confidence"]),
        ({"object": (None, "", "text")}, "quarantined", ["object_value_invalid"]),
        ({"object": (None, "5", "int")}, "accepted", []),
        ({"object": None}, "quarantined", ["object_not_object"]),
        ({"mentions": [("m1", "Alpha", 0, 5, "NIL:q", "canonical", "A"), m[1]]}, "quarantined", ["invalid_entity_id", "subject_endpoint_missing"]),
    ]
    got = claims.validate(table(spark, *[c for c, *_ in cases])).orderBy("claim_index").collect()
    for r, (change, route, reasons) in zip(got, cases, strict=True):
        assert (r.route, r.reasons) == (route, reasons), change
    assert got[2].mentions[1].entity_id.startswith("NIL:")
    assert claims.extraction_status(claims.validate(table(spark, {}, {"predicate": "likes"}))).first().status == "partial"


def chunks(spark, **change):
    row = dict(document_uid="d", chunk_id="c", text=TEXT, text_sha256=None, factual_index_allowed=True, status="accepted", source_type="review", authority_score=0.8, ord=0) | change
    return spark.createDataFrame([tuple(row.values())], "document_uid string, chunk_id string, text string, text_sha256 string, factual_index_allowed boolean, status string, source_type string, authority_score double, ord int")


def test_provenance(spark):
    for change, want in [({}, []), ({"text": "stale"}, ["chunk_text_mismatch"]), ({"chunk_id": "z"}, ["missing_chunk_provenance"]), ({"source_type": "harmful_examples"}, ["harmful_source_type"]), ({"text_sha256": "bad"}, ["chunk_hash_mismatch"]), ({"factual_index_allowed": None, "status": "x"}, ["chunk_status_not_accepted", "factual_index_policy_missing_or_denied"])]:
        assert claims.provenance(table(spark, {}), chunks(spark, **change)).first().provenance == want
    two = chunks(spark, text="old").unionAll(chunks(spark, ord=1))
    assert claims.last_chunks(two).first().text == TEXT


def test_graph_merges_equal_claims_and_has_no_dangling_edges(spark):
    ok = claims.validate(table(spark, {}, {"model_confidence": 0.5, "evidence_stance": "refutes"}, {"object": (None, "5", "int")})).where("route = 'accepted'")
    g = claims.build_graph(ok, chunks(spark))
    rows = {r.object_value: r for r in g["Claim"].collect()}
    assert set(rows) == {None, "5"}
    assert rows[None].model_confidences == [0.9, 0.5] and rows[None].evidence_stances == ["supports", "refutes"] and rows[None].stance == "supports"
    count = {r.type: r["count"] for r in g["edges"].groupBy("type").count().collect()}
    assert count == {"has_subject": 2, "has_object": 2, "supports": 2, "refutes": 1, "from_document": 3, "evidenced_by": 3}
    assert g["Entity"].count() == 2 and g["Mention"].count() == 6 and g["quarantined"].count() == 0
    known = [r[0] for k, c in (("Claim", "claim_id"), ("Entity", "entity_id"), ("EvidenceChunk", "evidence_chunk_id"), ("Document", "document_uid")) for r in g[k].select(c).collect()]
    assert all(r.source_id in known and (r.target_id in known or r.target_type == "value") for r in g["edges"].collect())


def test_expansion_gates_and_components(spark):
    g = {
        "EvidenceChunk": spark.createDataFrame([("e1", "d", "c1", 0.5, "accepted"), ("e2", "d", "c2", 2.0, "reviewed"), ("e3", "d", "c3", 1.0, "accepted")], "evidence_chunk_id string, document_uid string, chunk_id string, authority_score double, status string"),
        "Claim": spark.createDataFrame([("k", "ENT:a", None, "causes", "affirmed", "asserted", "supports", 0.9)], "claim_id string, subject_entity_id string, object_entity_id string, predicate string, polarity string, modality string, stance string, model_confidence double"),
        "Entity": spark.createDataFrame([("ENT:a",)], "entity_id string"),
        "edges": spark.createDataFrame([("e1", "supports", "k"), ("e2", "supports", "k"), ("k", "has_subject", "ENT:a"), ("e1", "from_document", "d")], "source_id string, type string, target_id string"),
    }
    sig = spark.createDataFrame([("q", ["ENT:a"], [], ["affirmed"], [], []), ("r", ["ENT:z"], [], ["affirmed"], [], [])], "query_id string, entity_ids array<string>, predicates array<string>, polarities array<string>, modalities array<string>, stances array<string>")
    seeds = spark.createDataFrame(
        [("q", "dense", 0.9, "e1", None, None), ("q", "dense", 0.1, "e2", None, None), ("q", "bm25", 2.0, None, "d", "c3"), ("q", "bm25", 0.0, "e2", None, None), ("q", "bm25", 1.0, "nope", "d", "c2"), ("r", "bm25", 1.0, "e1", None, None)],
        "query_id string, branch string, raw_score double, evidence_chunk_id string, document_uid string, chunk_id string",
    )
    got = expansion.graph_hits(seeds, sig, g, expansion.Settings()).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.candidate_id, r.hop) for r in got] == [("q", "e1", 0), ("q", "e2", 2), ("r", "e2", 2)]
    part = {c.name: c.value for c in got[0].components}
    assert part == pytest.approx({"query_entity": 1, "predicate": 0, "polarity": 1, "modality": 0, "stance": 0, "review_state": 1, "authority": 0.5, "extraction_confidence": 0.9, "seed_score": 1, "hop_decay": 1})
    assert {c.name: c.value for c in got[1].components}["authority"] == 1.0
    with pytest.raises(ValueError):
        expansion.Settings(max_hops=9)


def test_signatures(spark):
    payload = spark.createDataFrame([("q", "m", 0), ("q", "m", 5), ("r", "m", None)], "query_id string, mention_id string, candidate_index int")
    cand = spark.createDataFrame([("m", 1, "ENT:a")], "mention_id string, rank int, entity_id string")
    got = {r.query_id: (r.entity_ids, r.reasons) for r in claims.resolve_signature(payload, cand).collect()}
    assert got == {"q": (["ENT:a"], ["candidate_index_out_of_range"]), "r": ([], ["missing_candidate_index"])}
    cat = spark.createDataFrame([("ENT:a", "corpus"), ("TGT:b", "target")], "entity_id string, namespace string")
    s = spark.createDataFrame([("q", ["ENT:a", "TGT:b", "X"])], "query_id string, entity_ids array<string>")
    assert tuple(claims.ids_in_catalog(s, cat).first()) == ("q", 1, 1, 1)


def test_gates(spark):
    d = spark.createDataFrame([(1, "en", "a"), (2, "en", "a"), (3, "de", "b")], "i int, lang string, l string")
    r = gates.rate_gate(d, F.col("l") == "a", 0.5).first()
    assert (r.n, r.n_accepted, r.passed) == (3, 2, True)
    assert gates.rate_gate(d.limit(0), F.col("l") == "a", 0.5).first().passed is False
    assert gates.availability_gate(d, F.col("l") == "a", 3, 0.1).first().passed is False
    assert {tuple(x) for x in gates.mode_label(d, "lang", "l", "i").collect()} == {("en", "a"), ("de", "b")}
    ids = spark.createDataFrame([("1.0", "x"), (None, "y"), ("2", " ")], "ID string, t string")
    assert [tuple(x) for x in gates.required(ids, "ID", "t").collect()] == [("1", "x")]
    a, b = gates.identities({"x": 1, "run_name": "r"}, ["b", "a"], 0, 2), gates.identities({"x": 1, "run_name": "s"}, ["a", "b"], 1, 2)
    assert a["config"] == b["config"] and a["split"] == b["split"] and a["run"] != b["run"]
    assert gates.shard_run_name("run", 1, 4) == "run__shard-1-of-4"
    with pytest.raises(ValueError):
        gates.shard_run_name("a b", 0, 1)


def test_lineage(spark):
    m = spark.createDataFrame([("d1", "c1", "e1"), ("d1", "c1", "e1"), ("d1", "c2", "e1"), ("d2", "c3", None)], "document string, chunk string, entity string")
    nodes, edges = lineage.build(m)
    assert {r.id: r.degree for r in nodes.collect()} == {"document:d1": 2, "document:d2": 1, "chunk:c1": 2, "chunk:c2": 2, "chunk:c3": 1, "entity:e1": 2}
    assert edges.count() == 5
    assert {r.id for r in lineage.neighbourhood(edges, "entity:e1", 1).collect()} == {"entity:e1", "chunk:c1", "chunk:c2"}
    assert [r.id for r in lineage.select(nodes, ["chunk"], 2, "C2").collect()] == ["chunk:c2"]


def test_linkage_gate(spark):
    c = spark.createDataFrame([("accepted", "E1", None), ("accepted", "X", "E1"), ("accepted", "T", "D"), ("rejected", "E1", None)], "review_status string, subject_entity_id string, object_entity_id string")
    cat = spark.createDataFrame([("E1", "corpus", True, True, "linked"), ("T", "target", True, True, "linked"), ("D", "corpus", True, None, "linked"), ("U", "corpus", True, True, "pending")], "entity_id string, namespace string, factual_identity_allowed boolean, retrieval_allowed boolean, link_status string")
    s = spark.createDataFrame([("a", ["E1", "T"]), ("b", ["T"]), ("c", ["T", "U"]), ("d", ["E1", "E1"]), ("e", None), ("f", [])], "query_id string, entity_ids array<string>")
    got = claims.linkage_gate(c, cat, s).first()
    assert (got.accepted_claims, got.linked_claims, got.total_queries, got.linked_queries, got.target_anchor_only, got.passed) == (3, 2, 6, 1, 1, True)
    assert claims.linkage_gate(c, cat, s, {"linked_query_rate": 0.2}).first().passed is False
    none = claims.linkage_gate(c.limit(0), cat, s.limit(0)).first()
    assert (none.accepted_claims, none.graph_linked_claim_rate, none.linked_query_rate, none.passed) == (0, 0.0, 0.0, False)
