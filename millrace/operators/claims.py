"""Claim extractions: validation and routing, provenance, and the typed graph they make (FL9-FL13, FL17, GR1, WN4, JN3).

An extraction table has one row per claim: document_uid, chunk_id, text, claim_index and the claim's fields as typed
columns (see ``CLAIM``). All checks are array expressions over one row; nothing is joined to validate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ids import nil_entity_id, stable_id

# The closed vocabularies of a claim.
PREDICATES = ["associated_with", "calls_for", "causes", "contains", "describes", "denies", "excludes", "has_property", "includes", "is", "opposes", "supports", "targets"]
POLARITIES = ["affirmed", "negated", "uncertain", "mixed"]
MODALITIES = ["asserted", "conditional", "necessary", "possible", "prohibited", "recommended", "reported"]
STANCES = ["supports", "refutes", "quotes", "contextualizes"]
STATUSES = ["canonical", "ambiguous", "nil"]
ENTITY_ID = r"^[A-Za-z][A-Za-z0-9+._:/?#%=-]{1,255}$"

CLAIM = """document_uid string, chunk_id string, text string, claim_index int, claim_id string,
mentions array<struct<mention_id: string, text: string, start: int, end: int, entity_id: string, entity_status: string, canonical_name: string>>,
subject string, object struct<mention_id: string, value: string, value_type: string>, predicate string, polarity string,
polarity_scope struct<text: string, start: int, end: int>, modality string, attribution string, evidence_stance string, model_confidence double"""


def _in(x: Column, values: list[str]) -> Column:
    return F.coalesce(x.isin(values), F.lit(False))


def _blank(x: Column) -> Column:
    return x.isNull() | (x == "")


def _slice_fails(text: Column, s: Column, e: Column, surface: Column) -> Column:
    bad = s.isNull() | e.isNull() | (s < 0) | (e <= s) | (e > F.length(text))
    return bad | F.coalesce(F.substr(text, s + 1, e - s) != surface, F.lit(True))


def _pick(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hold, F.lit(why)) for why, hold in rules]))


def _mention_reasons(m: Column, text: Column) -> Column:
    """Reasons of one mention; the first of the early ones ends its check."""
    nil = F.startswith(m["entity_id"], F.lit("NIL-")) | F.startswith(m["entity_id"], F.lit("NIL:"))
    open_ = _in(m["entity_status"], ["ambiguous", "nil"])
    late = _pick(
        ("unknown_entity_status", ~_in(m["entity_status"], STATUSES)),
        ("invalid_entity_id", m["entity_id"].isNotNull() & (~F.regexp_like(m["entity_id"], F.lit(ENTITY_ID)) | (nil & (m["entity_status"] == "canonical")))),
        ("missing_canonical_entity_id", (m["entity_status"] == "canonical") & _blank(m["entity_id"])),
        ("unresolved_entity_id_must_be_nil", open_ & m["entity_id"].isNotNull() & ~nil),
        ("invalid_canonical_name", _blank(m["canonical_name"])),
    )
    early = (
        F.when(_blank(m["mention_id"]), F.lit("invalid_mention_id"))
        .when(_blank(m["text"]), F.lit("mention_text_not_string"))
        .when(m["start"].isNull() | m["end"].isNull(), F.lit("mention_offsets_not_integer"))
        .when(_slice_fails(text, m["start"], m["end"], m["text"]), F.lit("mention_span_mismatch"))
    )
    return F.when(early.isNotNull(), F.array(early)).otherwise(late)


def validate(claims: DataFrame) -> DataFrame:
    """The claims with ``route`` (accepted, reviewed, quarantined) and sorted ``reasons`` (FL8, FL9).

    A repeated mention id is a duplicate if an earlier mention with it is valid; unresolved mentions get NIL ids.
    """
    text = F.col("text")
    checked = claims.withColumn("__own", F.transform("mentions", lambda m: _mention_reasons(m, text)))
    numbered = F.transform("mentions", lambda m, i: F.struct(i.alias("i"), m["mention_id"].alias("id"), F.get("__own", i).alias("own")))
    checked = checked.withColumn("__m", numbered)
    repeated = F.transform("__m", lambda x: F.exists("__m", lambda y: (y["i"] < x["i"]) & (y["id"] == x["id"]) & (F.size(y["own"]) == 0)))
    good = F.transform(F.filter("__m", lambda x: F.size(x["own"]) == 0), lambda x: x["id"])
    scope, obj = F.col("polarity_scope"), F.col("object")
    has_ref = obj["mention_id"].isNotNull()
    reasons = F.concat(
        F.flatten(F.coalesce("__own", F.array())),
        F.when(F.exists(F.coalesce(repeated, F.array().cast("array<boolean>")), lambda x: x), F.array(F.lit("duplicate_mention_id"))).otherwise(F.array().cast("array<string>")),
        _pick(
            ("mentions_not_nonempty_list", F.coalesce(F.size("mentions"), F.lit(0)) <= 0),
            ("unknown_predicate", ~_in(F.col("predicate"), PREDICATES)),
            ("unknown_polarity", ~_in(F.col("polarity"), POLARITIES)),
            ("unknown_modality", ~_in(F.col("modality"), MODALITIES)),
            ("unknown_evidence_stance", ~_in(F.col("evidence_stance"), STANCES)),
            ("invalid_model_confidence", ~F.coalesce(F.col("model_confidence").between(0, 1), F.lit(False))),
            ("subject_endpoint_missing", F.coalesce(~F.array_contains(good, F.col("subject")), F.lit(True))),
            ("object_not_object", obj.isNull()),
            ("object_endpoint_missing", has_ref & F.coalesce(~F.array_contains(good, obj["mention_id"]), F.lit(True))),
            ("object_value_invalid", obj.isNotNull() & ~has_ref & (_blank(obj["value"]) | obj["value_type"].isNull())),
            ("missing_polarity_scope", _in(F.col("polarity"), ["negated", "uncertain", "mixed"]) & scope.isNull()),
            ("polarity_scope_mismatch", scope.isNotNull() & _slice_fails(text, scope["start"], scope["end"], scope["text"])),
        ),
    )
    unresolved = F.exists("mentions", lambda m: _in(m["entity_status"], ["ambiguous", "nil"]))
    review = _pick(("unresolved_entity", unresolved), ("quoted_only", F.col("evidence_stance") == "quotes"))
    named = F.transform("mentions", lambda m: m.withField("entity_id", F.coalesce(m["entity_id"], nil_entity_id(F.col("document_uid"), F.col("chunk_id"), m["mention_id"], m["text"]))))
    out = checked.withColumn("__r", F.array_sort(F.array_distinct(reasons)))
    route = F.when(F.size("__r") > 0, "quarantined").when(F.size(review) > 0, "reviewed").otherwise("accepted")
    out = out.withColumn("route", route).withColumn("reasons", F.when(F.size("__r") > 0, F.col("__r")).otherwise(review))
    claim_id = F.coalesce(F.nullif("claim_id", F.lit("")), F.concat(F.lit("claim-"), stable_id(F.lit("claim"), "claim_index", "chunk_id")))
    return out.withColumn("claim_id", claim_id).withColumn("mentions", F.when(F.col("route") == "quarantined", F.col("mentions")).otherwise(named)).drop("__own", "__m", "__r")


def extraction_status(routed: DataFrame) -> DataFrame:
    """document_uid, chunk_id, status: the route all claims share, else ``partial``."""
    return routed.groupBy("document_uid", "chunk_id").agg(F.when(F.countDistinct("route") == 1, F.min("route")).otherwise("partial").alias("status"))


def last_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (document_uid, chunk_id); the last by ``ord`` wins (JN3)."""
    return chunks.groupBy("document_uid", "chunk_id").agg(F.max_by(F.struct(*[c for c in chunks.columns if c not in ("document_uid", "chunk_id")]), "ord").alias("__c")).select("document_uid", "chunk_id", "__c.*")


def provenance(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """The claims with their chunk's fields (prefixed ``chunk_``) and sorted ``provenance`` reasons (FL13)."""
    c = last_chunks(chunks)
    c = c.select("document_uid", "chunk_id", *[F.col(x).alias(f"chunk_{x}") for x in ("text", "text_sha256", "factual_index_allowed", "status", "source_type", "authority_score")], F.lit(True).alias("__found"))
    j = claims.join(c, ["document_uid", "chunk_id"], "left")
    actual = F.sha2("chunk_text", 256)
    reasons = _pick(
        ("missing_chunk_text", F.col("chunk_text").isNull()),
        ("chunk_text_mismatch", F.col("chunk_text") != F.col("text")),
        ("factual_index_policy_missing_or_denied", ~F.coalesce("chunk_factual_index_allowed", F.lit(False))),
        ("chunk_status_not_accepted", ~_in(F.col("chunk_status"), ["accepted", "validated"])),
        ("harmful_source_type", F.col("chunk_source_type") == "harmful_examples"),
        ("chunk_hash_mismatch", F.col("chunk_text_sha256").isNotNull() & (F.col("chunk_text_sha256") != actual)),
    )
    return j.withColumn("provenance", F.when(F.col("__found").isNull(), F.array(F.lit("missing_chunk_provenance"))).otherwise(F.array_sort(reasons))).drop("__found")


def _key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def build_graph(accepted: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Document, EvidenceChunk, Mention, Entity, Claim, edges, quarantined of accepted claims (GR1).

    Claims with the same document and semantic signature are one node; order is (document_uid, chunk_id,
    claim_index): the first occurrence gives a node its stance and confidence.
    """
    j = provenance(accepted, chunks)
    quarantined = j.where(F.size("provenance") > 0).select("document_uid", "chunk_id", "claim_id", F.col("provenance").alias("reasons"))
    ok = j.where(F.size("provenance") == 0)

    def mention(ref: Column) -> Column:
        return F.get(F.filter("mentions", lambda m: m["mention_id"] == ref), F.lit(0))

    ok = ok.withColumn("s", mention(F.col("subject"))).withColumn("o", mention(F.col("object")["mention_id"]))

    def entity_key(m: Column) -> Column:
        return F.when(F.startswith(m["entity_id"], F.lit("NIL-")), F.concat(F.lit("entity-name:"), _key(F.coalesce(m["canonical_name"], m["text"])))).otherwise(F.concat(F.lit("entity:"), m["entity_id"]))

    object_key = F.when(F.col("o").isNotNull(), entity_key(F.col("o"))).otherwise(F.concat(F.lit("value:"), _key(F.col("object")["value"])))
    ok = ok.withColumn("object_key", object_key).withColumn("evidence_id", stable_id(F.lit("evidence"), "document_uid", "chunk_id"))
    signature = F.to_json(F.array(entity_key(F.col("s")), "predicate", "object_key", "polarity", "modality", "attribution"))
    ok = ok.withColumn("node", F.concat(F.lit("CLM-"), stable_id(F.lit("claim"), F.col("document_uid"), signature)))
    ok = ok.withColumn("occurrence_id", stable_id(F.lit("occurrence"), "document_uid", "chunk_id", "claim_index", "claim_id"))
    order = F.struct("chunk_id", "claim_index")

    def first(c: str | Column, name: str) -> Column:
        return F.min_by(c, order).alias(name)

    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "claim_index", "model_confidence", "evidence_stance", "occurrence_id")))
    claims = ok.groupBy(F.col("node").alias("claim_id"), "document_uid").agg(
        first(F.col("s")["entity_id"], "subject_entity_id"), first("predicate", "predicate"), first(F.col("o")["entity_id"], "object_entity_id"),
        first(F.when(F.col("o").isNull(), F.col("object")["value"]), "object_value"), first("model_confidence", "model_confidence"), first("polarity", "polarity"),
        first("modality", "modality"), first("attribution", "attribution"), first("evidence_stance", "stance"), ordered.alias("l"),
    )
    runs = F.filter("l", lambda x, i: (i == 0) | (x["model_confidence"] != F.get("l", i - 1)["model_confidence"]))
    claims = claims.select(
        *[c for c in claims.columns if c != "l"],
        F.transform(runs, lambda x: x["model_confidence"]).alias("model_confidences"),
        F.array_distinct(F.transform("l", lambda x: x["evidence_stance"])).alias("evidence_stances"),
        F.transform("l", lambda x: x["occurrence_id"]).alias("evidence_occurrence_ids"),
        F.lit("accepted").alias("review_status"),
    )
    m = ok.select("document_uid", "evidence_id", "occurrence_id", "chunk_id", "claim_index", F.posexplode("mentions").alias("at", "m"))
    mentions = m.select(stable_id(F.lit("mention"), F.col("occurrence_id"), F.col("m.mention_id")).alias("mention_id"), "document_uid", F.col("evidence_id").alias("evidence_chunk_id"), F.col("occurrence_id").alias("claim_occurrence_id"), "m.text", "m.start", "m.end", "m.entity_id", "m.entity_status").dropDuplicates(["mention_id"])
    seen = F.struct("document_uid", "chunk_id", "claim_index", "at")
    entities = m.groupBy(F.col("m.entity_id").alias("entity_id")).agg(F.min_by("m.canonical_name", seen).alias("canonical_name"), F.min_by("m.entity_status", seen).alias("entity_status"))
    evidence = ok.groupBy(F.col("evidence_id").alias("evidence_chunk_id"), "document_uid", "chunk_id").agg(F.first("text").alias("text"), F.first("chunk_authority_score").alias("authority_score"), F.first("chunk_source_type").alias("source_type"), F.first("chunk_status").alias("status"))
    documents = evidence.groupBy("document_uid").agg(F.min_by("source_type", "chunk_id").alias("source_type"), F.min_by("authority_score", "chunk_id").alias("authority_score"))

    def edge(df: DataFrame, s: str, kind: Column, d: Column, to: str, occurrence: Column) -> DataFrame:
        return df.select(F.col(s).alias("source_id"), kind.alias("type"), d.alias("target_id"), F.lit(to).alias("target_type"), occurrence.alias("occurrence_id"))

    none = F.lit(None).cast("string")
    once = ok.groupBy("node", "document_uid").agg(first(F.col("s")["entity_id"], "se"), first(F.col("o")["entity_id"], "oe"), first("object_key", "object_key"))
    value = F.concat(F.lit("VAL-"), stable_id(F.lit("value"), F.col("document_uid"), F.col("object_key")))
    edges = (
        edge(once, "node", F.lit("has_subject"), F.col("se"), "entity", none)
        .unionAll(edge(once.where("oe IS NOT NULL"), "node", F.lit("has_object"), F.col("oe"), "entity", none))
        .unionAll(edge(once.where("oe IS NULL"), "node", F.lit("has_object"), value, "value", none))
        .unionAll(edge(ok, "evidence_id", F.col("evidence_stance"), F.col("node"), "claim", F.col("occurrence_id")))
        .unionAll(edge(ok, "evidence_id", F.lit("from_document"), F.col("document_uid"), "document", F.col("occurrence_id")))
        .unionAll(edge(ok, "node", F.lit("evidenced_by"), F.col("evidence_id"), "evidence", F.col("occurrence_id")))
    )
    return {"Document": documents, "EvidenceChunk": evidence, "Mention": mentions, "Entity": entities, "Claim": claims, "edges": edges, "quarantined": quarantined}


def resolve_signature(payload: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, entity_ids, reasons: candidate indexes of a query's mentions to entity ids (FL11, FL17).

    ``payload`` (query_id, mention_id, candidate_index), ``candidates`` (mention_id, rank from 1, entity_id).
    """
    j = payload.join(candidates, (payload["mention_id"] == candidates["mention_id"]) & (F.col("candidate_index") + 1 == F.col("rank")), "left")
    bad = F.when(F.col("candidate_index").isNull(), "missing_candidate_index").when(F.col("entity_id").isNull(), "candidate_index_out_of_range")
    return j.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"), F.array_sort(F.collect_set(bad)).alias("reasons"))


def ids_in_catalog(signatures: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, linked, target_only, invalid: the ids of each signature by what the catalog says (FL17, AG20)."""
    e = signatures.select("query_id", F.explode("entity_ids").alias("entity_id")).join(catalog.select("entity_id", "namespace"), "entity_id", "left")
    kind = F.when(F.col("namespace").isNull(), "invalid").when(F.col("namespace") == "target", "target_only").otherwise("linked")
    return e.groupBy("query_id").agg(*[F.count_if(kind == k).alias(k) for k in ("linked", "target_only", "invalid")])


# The linkage gate's least counts and rates.
LINKAGE = {"linked_claims": 1, "graph_linked_claim_rate": 0.02, "linked_queries": 1, "linked_query_rate": 0.02}


def linkage_gate(claims: DataFrame, catalog: DataFrame, signatures: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row: accepted_claims, linked_claims, graph_linked_claim_rate, total_queries, linked_queries,
    linked_query_rate, target_anchor_only, passed (AG20).

    ``claims`` (review_status, subject_entity_id, object_entity_id), ``catalog`` (one row per entity_id with namespace,
    factual_identity_allowed, retrieval_allowed, link_status), ``signatures`` (query_id, entity_ids). A claim is linked
    if either end may be used as a corpus fact. A signature with a null or repeated id links nothing.
    """
    limits = LINKAGE | (limits or {})

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    usable = yes("retrieval_allowed") & F.coalesce(F.col("link_status") == "linked", F.lit(False))
    named = catalog.select("entity_id", usable.alias("usable"), F.col("namespace").eqNullSafe(F.lit("target")).alias("target"), yes("factual_identity_allowed").alias("factual"), F.col("namespace").eqNullSafe(F.lit("corpus")).alias("corpus"))
    facts = named.where("usable AND factual AND corpus").select("entity_id").distinct()
    c = claims.where(F.col("review_status") == "accepted").select("subject_entity_id", "object_entity_id")
    for end in ("subject", "object"):
        c = c.join(facts.select(F.col("entity_id").alias(f"{end}_entity_id"), F.lit(True).alias(end)), f"{end}_entity_id", "left")
    graph = c.agg(F.count("*").alias("accepted_claims"), F.count_if(yes("subject") | yes("object")).alias("linked_claims"))

    sound = F.col("entity_ids").isNotNull() & ~F.exists("entity_ids", F.isnull) & (F.size("entity_ids") == F.size(F.array_distinct("entity_ids")))
    s = signatures.select("query_id", F.explode_outer(F.when(sound, F.col("entity_ids"))).alias("entity_id"))
    s = s.join(named, "entity_id", "left")
    kind = F.when(F.col("entity_id").isNull(), None).when(~yes("usable"), "invalid").when(F.col("target") | ~F.col("factual"), "target").otherwise("linked")
    q = s.groupBy("query_id").agg(*[F.count_if(kind == k).alias(k) for k in ("linked", "target", "invalid")])
    asked = q.agg(F.count("*").alias("total_queries"), F.count_if(F.col("linked") > 0).alias("linked_queries"), F.count_if((F.col("linked") == 0) & (F.col("target") > 0) & (F.col("invalid") == 0)).alias("target_anchor_only"))
    one = graph.crossJoin(asked)  # one row each
    one = one.withColumn("graph_linked_claim_rate", F.col("linked_claims") / F.greatest("accepted_claims", F.lit(1)))
    one = one.withColumn("linked_query_rate", F.col("linked_queries") / F.greatest("total_queries", F.lit(1)))
    passed = F.lit(True)
    for name, least in limits.items():
        passed = passed & (F.col(name) >= least)
    return one.withColumn("passed", passed)


def ranked_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key in order (WN4)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
