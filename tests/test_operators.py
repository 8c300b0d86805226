"""Hand-computed cases: ties, boundaries, malformed input."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ragweave.config import AnswerConfig, ChunkConfig, IngestConfig, RerankPolicy, RetrievalConfig
from ragweave.functions import measures as M
from ragweave.functions import text as X
from ragweave.operators import chunking, evaluation, guardrails, ingest, ranking, routing
from ragweave.sources import catalog, stores
from ragweave.streaming import ingest as streaming


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], kinds).select(column.alias("x")).head()["x"]


def text(spark, value, fn):
    return one(spark, fn(F.col("t")), t=(value, "string"))


@pytest.mark.parametrize(("value", "want"), [("कॉर्पोरेशन क्या है?", "क र प र शन क य ह".split()), ("Straße_2 ABC", ["strasse", "2", "abc"]), ("", []), (None, [])])
def test_tokens(spark, value, want):
    assert text(spark, value, X.tokens) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("One. Two!  Three", ["One.", "Two!", "Three"]), ("यह एक है। दूसरा वाक्य।", ["यह एक है।", "दूसरा वाक्य।"]), ("  ", []), (None, []), ("a… b", ["a…", "b"])],
)
def test_sentences(spark, value, want):
    assert text(spark, value, X.sentences) == want


def test_claims_keep_the_ellipsis(spark):
    assert text(spark, "a… b. c", X.claims) == ["a… b.", "c"]


@pytest.mark.parametrize(("value", "want"), [(". what is it?", "what is it?"), ("  a b ", "a b"), ("...", None), (None, None)])
def test_cleaned(spark, value, want):
    assert text(spark, value, lambda c: X.cleaned(c, leading=True)) == want


def test_nfc(spark):
    assert text(spark, "é", lambda c: X.cleaned(c, compose=True)) == "é"


@pytest.mark.parametrize(("value", "want"), [("what is it", "en"), ("कॉर्पोरेशन क्या है?", "hi"), ("ab கதகதக", "ta"), ("12 ?", "und"), (None, "und"), ("ab вг", "en")])
def test_script_language(spark, value, want):
    assert text(spark, value, X.script_language) == want


def test_uuid(spark):
    import uuid

    want = str(uuid.uuid5(uuid.UUID(X.POINT_NAMESPACE), "1102432:0:en:structure:0"))
    assert text(spark, "1102432:0:en:structure:0", X.name_uuid) == want


@pytest.mark.parametrize(
    ("value", "route", "kind"),
    [
        ("what is a corporation?", "FAST", "factual"),
        ("How is a corporation formed under commercial law?", "ACCURATE", "explanation"),
        ("What is a corporation, and how does it differ from a partnership, and which is better?", "DEEP", "multi_part"),
        ("कॉर्पोरेशन क्या है?", "FAST", "factual"),
        ("एक। दो।", "DEEP", "multi_part"),
        ("", "FAST", "other"),
    ],
)
def test_routes(spark, value, route, kind):
    r = routing.features(spark.createDataFrame([(value,)], "text string")).head()
    assert (r["route"], r["query_type"]) == (route, kind)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 8])
def test_sliding(spark, n):
    got = one(spark, chunking.sliding(F.col("n"), ChunkConfig()), n=(n, "int"))
    want, start = [], 0
    while start < n:
        want.append((start, min(n - 1, start + 3)))
        if want[-1][1] >= n - 1:
            break
        start += 2
    assert [(s["first"], s["last"]) for s in got] == want


def test_structure(spark):
    short, long = "Ab cd ef.", "x" * 950 + "."
    df = spark.createDataFrame([(1, " ".join([short] * 5)), (2, f"{short} {long} {short}"), (3, short)], "query_id long, text string")
    rows = chunking.chunks(chunking.passages(df), "structure").orderBy("query_id", "chunk_index").collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["query_id"], []).append((r["start_sentence"], r["end_sentence"]))
    assert spans == {1: [(0, 2), (2, 4)], 2: [(0, 0), (1, 1), (2, 2)], 3: [(0, 0)]}
    assert rows[0]["chunk_id"] == "1:0::structure:0" and rows[0]["sentence_count"] == 3


def test_semantic_and_adaptive(spark):
    a = "The cat sat on the mat with the cat and the mat of the cat at home."
    b = "Quarterly dividends exceeded projections throughout fiscal turmoil yesterday."
    df = chunking.passages(spark.createDataFrame([(1, f"{a} {a} {b} {b}"), (2, "One."), (3, "tiny. " * 9)], "query_id long, text string"))
    spans = {r["query_id"]: [(s["first"], s["last"]) for s in r["spans"]] for r in chunking.with_spans(df, "semantic").collect()}
    assert spans[1] == [(0, 1), (2, 3)] and spans[2] == [(0, 0)]
    assert {r["query_id"]: r["reason"] for r in chunking.with_spans(df, "adaptive").collect()} == {1: "semantic:topic_shift", 2: "structure:short_passage", 3: "structure:short_passage"}


def test_malformed_passages(spark):
    df = spark.createDataFrame([("1", "a."), ("x", "a."), (None, "a."), ("2", "  "), ("3", None)], "query_id string, text string")
    assert [r["document_id"] for r in chunking.passages(df).collect()] == ["1:0:"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a d e"), (4, " ")], "doc_id long, text string")
    hits = ranking.LexicalIndex.build(docs).search(spark.createDataFrame([(1, "a b b")], "query_id long, text string")).collect()
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1}.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)  # "a" is in more than half of the documents
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (8 / 3)))
    want = {1: floor * part(2, 3) + 2 * idf["b"] * part(1, 3), 2: floor * part(1, 2), 3: floor * part(1, 3)}
    want = {k: round(v, 6) for k, v in want.items() if v > 0}
    assert {h["doc_id"]: h["score"] for h in hits} == pytest.approx(want)


def test_dense_metrics(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = v.where("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    top = lambda m: [r["doc_id"] for r in ranking.dense_search(v, q, 3, m, block=1).orderBy("rank").collect()]
    assert top("cosine") == [1, 4, 3] and top("dot") == [3, 1, 4] and top("euclid") == [1, 4, 2]
    with pytest.raises(ValueError, match="metric"):
        ranking.dense_search(v, q, 3, "manhattan")


def test_fusion_ties(spark):
    kind = "query_id long, doc_id string, score double, rank int"
    dense = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "c2", 0.8, 2)], kind)
    bm25 = spark.createDataFrame([(1, "c1", 3.0, 1), (1, "c3", 2.0, 2), (1, "", 1.0, 3)], kind)
    got = ranking.fuse([("dense", dense), ("bm25", bm25)]).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["c1", "c2", "c3"]
    assert got[0]["rrf"] == pytest.approx(2 / 61) and got[1]["bm25_score"] is None


@pytest.mark.parametrize(
    ("route", "scores", "applied"),
    [("ACCURATE", [0.04, 0.01], False), ("ACCURATE", [0.019, 0.0185], True), ("FAST", [0.016, 0.0159], False), ("ACCURATE", [0.035], False), ("DEEP", [0.02, 0.019], True), ("DEEP", [0.045, 0.01], False), ("DEEP", [], True)],
)
def test_policy(spark, route, scores, applied):
    hits = spark.createDataFrame([(1, s) for s in scores], "query_id long, rrf double")
    asked = spark.createDataFrame([(1, route)], "query_id long, route string")
    r = ranking.decisions(asked.join(ranking.signals(hits), "query_id", "left"), RerankPolicy()).head()
    assert r["applied"] is applied


def test_evidence_limits(spark):
    words = lambda *w: " ".join(w)
    rows = [(1, "a", words("x", "y", "z"), 1), (1, "b", words("z", "y", "x"), 2), (1, "c", "p" * 20, 3), (1, "d", words("q", "r"), 4)]
    hits = spark.createDataFrame([(*r[:3], "en", 1.0, r[3]) for r in rows], "query_id long, doc_id string, text string, language string, score double, rank int")
    r = guardrails.evidence(hits, AnswerConfig(max_evidence_chars=22)).head()
    assert [i["doc_id"] for i in r["items"]] == ["a"] and r["dropped"] == 1 and r["truncated"]
    r = guardrails.evidence(hits, AnswerConfig(max_evidence=2)).head()
    assert [i["doc_id"] for i in r["items"]] == ["a", "c"] and r["truncated"]
    # The first item is taken whatever its size.
    r = guardrails.evidence(hits.where("doc_id = 'c'"), AnswerConfig(max_evidence_chars=5)).head()
    assert [i["doc_id"] for i in r["items"]] == ["c"] and not r["truncated"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"answer": "A.", "status": "grounded", "sources": [{"chunk_id": "c"}]}', ("A.", "grounded", ["c"])),
        ('```json\n{"answer": " A ", "sources": ["c", "d"]}\n```', ("A", "grounded", ["c", "d"])),
        ('noise {"answer": "A", "status": "insufficient_CONTEXT"} noise', ("A", "insufficient_context", [])),
        ('{"answer": "  "}', (None, "llm_error", [])),
        ('{"answer": 5}', (None, "llm_error", [])),
        ("[1, 2]", (None, "llm_error", [])),
        ("not json", (None, "llm_error", [])),
        ("", (None, "llm_error", [])),
        (None, (None, "llm_error", [])),
    ],
)
def test_parsed(spark, raw, want):
    r = text(spark, raw, guardrails.parsed)
    assert (r["answer"], r["status"], list(r["sources"])) == want


@pytest.mark.parametrize(("rows", "reason"), [([], "no_hits"), ([("corp law", "en", 0.001)], "low_score"), ([("zzz", "hi", 0.02)], "ok_cross_lingual"), ([("zzz", "en", 0.02)], "low_lexical_overlap"), ([("a corp", "en", 0.02)], "ok")])
def test_gate(spark, rows, reason):
    q = spark.createDataFrame([(1, "what is a corp", "en")], "query_id long, text string, language string")
    h = spark.createDataFrame([(1, *r) for r in rows], "query_id long, text string, language string, score double")
    assert guardrails.gate(q, h).head()["gate_reason"] == reason


def test_grounding(spark):
    item = "array<struct<rank:int,doc_id:string,language:string,score:double,text:string>>"
    ev = [(1, "c", "en", 1.0, "a corporation is a legal entity")]
    rows = [(1, "A corporation is legal.", "en", ev, ["c"]), (2, "Bananas ripen quickly.", "en", ev, ["c"]), (3, "कुछ।", "hi", ev, []), (4, "कुछ।", "hi", ev, ["other"]), (5, "", "en", ev, [])]
    df = spark.createDataFrame([(*r, None) for r in rows], f"query_id int, answer string, language string, items {item}, sources array<string>, strict_overlap double")
    got = {r["query_id"]: (r["verified"], r["confidence"]) for r in guardrails.grounded(df).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0), 3: (True, 0.6), 4: (False, 0.0), 5: (False, 0.0)}


@pytest.mark.parametrize(
    ("lists", "n", "selected"),
    [((["a", "b"], ["x", "y", "z"], ["1", "0"]), 2, [True, False]), (([], ["x", "y"], ["2", None, "1"]), 3, [False, False, True]), (([], [], []), 0, []), ((None, ["x"], None), 1, [False])],
)
def test_aligned(spark, lists, n, selected):
    got = one(spark, ingest.aligned(F.col("e"), F.col("t"), F.col("s")), e=(lists[0], "array<string>"), t=(lists[1], "array<string>"), s=(lists[2], "array<string>"))
    assert len(got) == n and [r["selected"] for r in got] == selected


def raw(spark, *rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", catalog.RAW).alias("r")).select("r.*", F.lit("hi").alias("shard_lang"), F.lit("validation").alias("split"))


def test_examples(spark):
    row = {"query_id": "1102432", "source_lang": "eng_Latn", "target_lang": "hin_Deva", "query": "निगम क्या है?", "Eng_Query": ". what is a corporation?", "Answer": "", "passages": {"English_passages": ["One.", "Two."], "Translated_passages": ["एक।", "दो।"], "is_selected": ["1", "0"]}}
    df = ingest.examples(raw(spark, row, row | {"query_id": "x"}, row | {"query_id": "2", "query": " ", "Eng_Query": "..."}))
    r = df.collect()
    assert len(r) == 1 and len(r[0]["passages"]) == 4 and r[0]["gold_document_ids"] == ["1102432:0:en", "1102432:0:hi"]
    assert r[0]["eng_query"] == "what is a corporation?" and r[0]["answer"] is None
    only = ingest.examples(raw(spark, row), IngestConfig(include_translated=False)).head()
    assert [p["language"] for p in only["passages"]] == ["en", "en"]
    twice = ingest.deduped(ingest.examples(raw(spark, row, row | {"query_id": "3"}))).orderBy("query_id").collect()
    assert [len(x["passages"]) for x in twice] == [0, 4] or [len(x["passages"]) for x in twice] == [4, 0]
    assert ingest.examples(raw(spark, row), IngestConfig(drop_empty_answers=True)).count() == 0
    with pytest.raises(ValueError, match="left out"):
        IngestConfig(include_english=False, include_translated=False)


def test_gold_set(spark):
    row = {"query_id": "1", "query": "निगम क्या है?", "Eng_Query": "what is it?", "passages": {"English_passages": ["One."], "Translated_passages": ["एक।"], "is_selected": ["1"]}}
    ex = ingest.examples(raw(spark, row, row | {"query_id": "2", "passages": {"English_passages": ["N."], "Translated_passages": [], "is_selected": ["0"]}}))
    rows = evaluation.gold_set(ex).orderBy("query_source").collect()
    assert [r["query_source"] for r in rows] == ["english", "indic"]
    indexed = spark.createDataFrame([("1:0:en",)], "doc_id string")
    assert {tuple(r["gold_document_ids"]) for r in evaluation.gold_set(ex, indexed).collect()} == {("1:0:en",)}


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)] + [(float("nan"),)], "v double")
    assert tuple(df.agg(*M.latency(F.col("v"))).head()) == (25.0, 25.0, 31.0, 40.0)
    rows = [("a", float(x)) for x in (10, 20, 30, 40)] + [("a", None), ("b", None), (None, 1.0), (None, 1.0), (None, 9.0)]
    by = spark.createDataFrame(rows, "g string, v double")
    got = M.at_indexes(by, ["g"], {"n": ("v", M.nearest(90)), "i": ("v", M.cut(0.5)), "z": ("v", M.cut(0.99))}).collect()
    assert {tuple(r) for r in got} == {("a", 40.0, 30.0, 40.0), (None, 9.0, 1.0, 9.0)}


def test_catalog(spark, tmp_path):
    paths = [("x/train/hintrain.parquet",), ("validation/tamval.parquet",), ("train/xyztrain.parquet",), ("other/hin.parquet",)]
    s = catalog.shards(spark.createDataFrame(paths, "path string"))
    assert {(r["split"], r["lang"]) for r in s.collect()} == {("train", "hi"), ("validation", "ta")}
    assert catalog.resolve(s, "ta", "validation").endswith("tamval.parquet")
    with pytest.raises(KeyError, match="hi"):
        catalog.resolve(s, "ta", "train")
    assert catalog.missing_languages(["hi", "bn"], s, "train") == ["bn"]
    assert catalog.reported_shards('{"shards": {"train": {"hi": "p"}}}') == {"train": {"hi": "p"}} and catalog.reported_shards(None) is None
    (tmp_path / "p.jsonl").write_text('{"query_id": "1", "text": "A."}\nbroken\n{"query_id": "2", "text": "B."}\n')
    assert catalog.read_passages(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        catalog.read_strict(spark, str(tmp_path), "query_id string, text string").collect()


def test_upsert(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 0)], "k int, v string, s int")
    once = catalog.upsert(have, new, "k", F.col("s")).drop("s")
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in catalog.upsert(once, new.drop("s").where("v != 'c'"), "k").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    with pytest.raises(Exception, match="another size"):
        catalog.checked_dimension(spark.createDataFrame([([1.0],)], "embedding array<float>"), 2).collect()


def test_index_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "blue sky")], "doc_id long, text string")
    ranking.LexicalIndex.build(docs).write(str(tmp_path / "index"))
    q = spark.createDataFrame([(7, "pear")], "query_id long, text string")
    hits = ranking.LexicalIndex.read(spark, str(tmp_path / "index"), RetrievalConfig()).search(q).collect()
    assert [(h["query_id"], h["doc_id"]) for h in hits] == [(7, 2)]


@pytest.mark.parametrize("every", [1, 2, 16])
def test_stream(spark, tmp_path, every):
    folder, table, marks = (str(tmp_path / n) for n in ("in", "table", "marks"))
    (tmp_path / "in").mkdir()
    batches = [
        ['{"query_id": "1", "text": "One. Two.", "language": "en"}'],
        ['{"query_id": "1", "text": "Changed.", "language": "en"}', '{"query_id": "2", "text": "New.", "language": "en"}'],
        ['{"query_id": "2", "text": "Newer.", "language": "en"}'],
    ]
    assert streaming.current(spark, table) is None
    for n, lines in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines) + "\n")
        streaming.start(spark, folder, table, marks, compact_every=every).awaitTermination()
    assert sorted((r["chunk_id"], r["text"]) for r in streaming.current(spark, table).collect()) == [("1:0:en:structure:0", "Changed."), ("2:0:en:structure:0", "Newer.")]
    left = [v for kind in ("base", "delta") for v in stores.versions(spark, f"{table}/{kind}")]
    assert left == ([2] if every == 1 else [1, 2] if every == 2 else [0, 1, 2])


def test_environment(monkeypatch):
    monkeypatch.setenv("RAGWEAVE_TOP_K", "3")
    monkeypatch.setenv("RAGWEAVE_K1", " ")
    assert RetrievalConfig.from_env() == RetrievalConfig(top_k=3)


def test_composition(spark):
    """Decomposed letters are composed everywhere before anything is compared, also inside the arrays."""
    decomposed, composed = "क़ café", "क़ café"
    row = {"query_id": "1", "query": f"{decomposed}?", "Eng_Query": f". {decomposed}", "Answer": "é", "Eng_Answer": None, "passages": {"English_passages": [decomposed, "plain", None], "Translated_passages": [composed, decomposed, "x"], "is_selected": ["1", "0", "0"]}}
    r = ingest.examples(raw(spark, row)).head()
    assert (r["query"], r["eng_query"], r["answer"], r["eng_answer"]) == (f"{composed}?", composed, "é", None)
    assert [p["text"] for p in r["passages"]] == [composed, composed, "plain", composed, "x"]
    got = spark.createDataFrame([(t,) for t in ("가", "é", "é", "a", "", None, "̈́", "Ω")], "t string").select(X.nfc(F.col("t")).alias("n")).collect()
    assert [x["n"] for x in got] == ["가", "é", "é", "a", "", None, "̈́", "Ω"]


def test_stripped_ends(spark):
    texts = [" \t a b　\x1c", "​a", "x\x85", "\x1f", "", None, "  y\n" + " " * 50_000 + "z "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.squeeze_ends(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [t if t is None else t.strip() for t in texts]


def test_holding(spark, monkeypatch):
    import random

    r = random.Random(4)
    words = ["Ab", "cd", "e", "fg.", "(h", "i-j", "ß", "K"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(60)]
    asked = []
    for _ in range(60):
        t = r.choice(texts)
        a = r.randrange(len(t) + 1)
        asked.append(t[a : a + r.randint(1, 25)])
    asked += ["cd", "zz zz zz zz", "cd e", "d e f", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    want = sorted((i, j) for i, x in enumerate(asked) if x is not None for j, t in enumerate(texts) if x in t)
    assert sorted(tuple(x) for x in evaluation.holding(d, q).collect()) == want
    monkeypatch.setattr(ranking, "BROADCAST_QUERIES", 3)
    assert sorted(tuple(x) for x in evaluation.holding(d, q).collect()) == want


def test_ingest_report(spark):
    good = {"query_id": "1", "query": "q", "Eng_Query": "q", "Answer": "a", "passages": {"English_passages": ["One.", "Two."], "Translated_passages": ["एक।", "दो।"], "is_selected": ["1", "0"]}}
    rows = [good, good | {"query_id": "2", "Answer": " "}, good | {"query_id": "none"}, good | {"query_id": "3", "query": " ", "Eng_Query": None}]
    r = ingest.report(raw(spark, *rows), IngestConfig(dedupe=True)).head()
    assert (r["records_processed"], r["records_skipped"], r["unusable_ids"], r["empty_queries"], r["records_emitted"]) == (4, 2, 1, 1, 2)
    assert (r["empty_answers"], r["passages_emitted"], r["passages_deduped"], r["without_passages"]) == (1, 4, 4, 1)
    found = {(x["dimension"], x["value"]): x["n"] for x in ingest.distributions(ingest.examples(raw(spark, *rows))).collect()}
    assert found["language", "hi"] == 2


def test_gold_report(spark):
    row = {"query_id": "1", "query": "निगम क्या है?", "Eng_Query": "why is it so?", "passages": {"English_passages": ["One."], "Translated_passages": ["एक।"], "is_selected": ["1"]}}
    none = row | {"query_id": "2", "passages": {"English_passages": ["N."], "Translated_passages": [], "is_selected": ["0"]}}
    ex = ingest.examples(raw(spark, row, none, row | {"query_id": "3"}))
    indexed = spark.createDataFrame([("1:0:en",)], "doc_id string")
    r = evaluation.gold_report(ex, indexed).head()
    assert (r["examples_seen"], r["examples_without_gold"], r["dropped_no_indexed_gold"], r["indic_emitted"], r["english_emitted"]) == (3, 1, 1, 1, 1)
