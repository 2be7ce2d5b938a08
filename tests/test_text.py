"""TX*, ID*, spans: hand-computed values."""

import hashlib
import json

from pyspark.sql import functions as F

from millrace.functions import ids, spans, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


def test_stable_id_is_the_hash_of_a_compact_json_array(spark):
    for a, b in [("x", "y"), ('q"uo\\te', "line\nbreak"), ("தமிழ்", "😀"), ("", "\x01")]:
        want = hashlib.sha256(json.dumps([a, b], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:20]
        assert one(spark, ids.stable_id("a", "b"), a=a, b=b) == want


def test_unit_interval_bounds(spark):
    x = [r[0] for r in spark.range(200).select(ids.unit_interval(F.col("id").cast("string"), "s")).collect()]
    assert 0 <= min(x) < 0.1 and 0.9 < max(x) <= 1


def test_text_projections(spark):
    c = F.col("v")
    for f, v, want in [
        (text.optional_text, "   ", None),
        (text.optional_text, " nan ", "nan"),
        (text.normalized, "  A  b\n", "a b"),
        (text.dedup_key, "It’s  OK", "it's ok"),
        (text.path_key, ".//A\\b//C/", "a/b/c"),
        (text.basename, "x/Y.PDF", "y.pdf"),
        (text.label_key, "Review (2020), peer", "review 2020 peer"),
        (text.source_id, "see src12 and SRC13", "SRC12"),
        (text.source_id, "SRCX", None),
        (text.tokens, "Ab_1, c'd தமிழ்", ["ab_1", "c", "d", "தம", "ழ"]),
        (text.initials, "World of the Health Organization", "who"),
        (text.claim_text, "Some claim [E1] , here [E2].", "some claim, here"),
        (text.script_bucket, "abc", "latin"),
        (text.script_bucket, "abc தமிழ்", "mixed"),
        (text.script_bucket, "123", "unknown"),
        (text.citations, "a [E1] b [E02] [E10]", ["E1", "E10"]),
        (text.json_object, 'say {"a": {"b": 1}} end', '{"a": {"b": 1}}'),
        (text.json_object, "none", None),
        (text.score_status, "", "missing"),
        (text.score_status, "x", "invalid"),
        (text.score_status, "NaN", "nonfinite"),
        (text.score_status, "0.5", "valid"),
    ]:
        assert one(spark, f(c), v=v) == want, (f.__name__, v)
    assert one(spark, text.document_title(F.lit("a/SRC1_my_file.pdf"), F.lit("SRC1"))) == "my file"
    assert one(spark, text.script_match(F.lit("mixed"), F.lit("mixed"))) is False
    assert one(spark, text.script_match(F.lit("latin"), F.lit("unknown"))) is None
    assert one(spark, text.language_match(F.lit("EN"), F.lit("english"))) is True
    assert one(spark, text.language_match(F.lit("xx"), F.lit("english"))) is None
    assert one(spark, text.nfkc(c), v="ﬁ²") == "fi2"


def test_think_split_states(spark):
    for raw, want in [
        ("<think> a </think> b", ("complete", "a", "b")),
        ("a </think> b", ("closing_only", "a", "b")),
        ("b <THINK>a", ("truncated", "a", "b")),
        ("b", ("none", "", "b")),
    ]:
        d = spark.createDataFrame([(raw,)], "raw string")
        assert tuple(d.select(*text.think_split(F.col("raw")).values()).first()) == want


def test_sentences_and_windows():
    t = "One. Two!  Three?\nFour। Five."
    assert [t[s:e] for s, e in spans.sentences(t)] == ["One.", "Two!", "Three?", "Four।", "Five."]
    for most in (5, 8, 12, 100):
        w = spans.windows(t, most)
        assert all(e - s <= most for s, e, *_ in w)
        assert "".join(t[s:e] for s, e, *_ in w).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")
    long = "word " * 30
    assert all(not w[4] for w in spans.windows(long.strip(), 20))
    assert spans.windows("", 10) == [] and spans.windows("   ", 10) == []


def test_windows_start_afresh_after_a_long_sentence():
    t = "Short one. " + "word " * 12 + "end. Tail a. Tail b."
    w = spans.windows(t, 25)
    assert [t[s:e] for s, e, *_ in w] == ["Short one.", " word word word word word", " word word word word word", " word word end.", " Tail a. Tail b."]
    assert [x[4] for x in w] == [True, False, False, False, True]
    assert [(x[2], x[3]) for x in w[1:4]] == [(10, 75)] * 3 and w[0][2:4] == (0, 10) and w[4][2:4] == w[4][:2]
    assert {x[5] for x in w if x[4]} == {None} and {x[5] for x in w if not x[4]} == {"oversized_sentence"}


def test_normal_forms_scripts_and_acronyms(spark):
    c = F.col("v")
    assert one(spark, text.dedup_key(c), v="Straße \ufb01 X") == "strasse fi x"
    assert one(spark, text.dedup_key(c), v="It’s  A") == "it's a"
    assert one(spark, text.optional_text(c), v=" \u2460 ") == "1" and one(spark, text.optional_text(c), v="  ") is None
    for v, want in (("ಕನ್ನಡ", "kannada"), ("മല", "malayalam"), ("ݐ", "arabic"), ("ᄀ", "hangul"), ("ԑ", "unknown"), ("かな", "japanese"), ("aб", "mixed"), ("12", "unknown")):
        assert one(spark, text.script_bucket(c), v=v) == want
    for v, want in (("WHO", "who"), ("W.H.O.", "who"), ("abcd", "abcd"), ("abcde", None), ("ABCDE", "abcde"), ("w h", None), ("a", None), ("ABCDEFGHI", None)):
        assert one(spark, text.acronym_key(c), v=v) == want
    assert one(spark, text.acronym_of(F.lit("WHO"), F.lit("World of the Health Organisation"))) is True
    assert one(spark, text.acronym_of(F.lit("who"), F.lit("whole"))) is False


def test_window_table_handles_nulls_and_no_rows(spark):
    d = spark.createDataFrame([("a", None), (None, "Hi there.")], "k string, t string")
    assert [(r.key, r.text) for r in spans.window_table(d, "k", "t", 50).collect()] == [(None, "Hi there.")]
    assert spans.window_table(d.limit(0), "k", "t", 50).count() == 0


def test_acronym_initials_reads_whole_texts(spark, tmp_path):
    from millrace.plans import catalog

    words = [f"{chr(97 + i % 26)}word{i}" for i in range(60)]
    spark.createDataFrame([(1, " ".join(words)), (2, "World of Health")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(tuple(r) for r in catalog.queries()["acronym_initials"](spark, str(tmp_path)).collect())
    assert got == {1: "".join(w[0] for w in words), 2: "wh"}


def test_safe_abstentions(spark):
    yes = [*text.ABSTENTIONS, "I cannot verify\tthis from\n the available evidence ！", "Ｉ cannot verify this from the available evidence"]
    no = [None, "", "I cannot verify this.", text.ABSTENTIONS[0] + " [E1]", "[E2] " + text.ABSTENTIONS[0], "so " + text.ABSTENTIONS[0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(yes + no)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(text.safe_abstention(F.col("x"))).collect()] == [True] * len(yes) + [False] * len(no)
