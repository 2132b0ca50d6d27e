"""Small cases with known results."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone import store
from lodestone.functions import hashing, scoring
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import answers, chunking, context, facts, filters, fusion, maintenance, media, metrics, rerank, search, sessions, state, surrogates, text_search
from lodestone.sources import files, git, snapshots


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(expression.alias("x")).first()["x"]


def ranked(spark, lists):
    data = [(1, f, r, name, w) for name, (w, ids) in lists.items() for r, f in enumerate(ids, 1)]
    return spark.createDataFrame(data, "query_id long, frame_id long, rank long, lane string, weight double")


@pytest.mark.parametrize("lists,count,first", [({"t": (0.5, [0, 1, 2]), "v": (0.5, [3, 4, 5])}, 6, 0), ({"t": (0.5, [0, 1]), "v": (0.5, [1, 2])}, 3, 1), ({"t": (1.0, [0]), "v": (0.0, [1])}, 1, 0), ({"t": (0.0, [0]), "v": (1.0, [1])}, 1, 1)])
def test_fusion(spark, lists, count, first):
    got = fusion.fuse(ranked(spark, lists)).orderBy("position").collect()
    assert len(got) == count and got[0].frame_id == first


def test_fusion_ignores_lane_order(spark):
    lists = {"a": (1.0, [1, 2, 3, 4]), "b": (0.5, [3, 4, 5]), "c": (0.25, [2, 6])}
    shuffled = dict(random.Random(1).sample(list(lists.items()), 3))
    order = lambda x: [(r.frame_id, r.score) for r in fusion.fuse(ranked(spark, x)).orderBy("position").collect()]
    assert order(lists) == order(shuffled)


def test_fusion_ties_by_id(spark):
    lanes = ranked(spark, {"text": (0.21, [7]), "vector": (0.21, [3])})
    got = fusion.diagnostics(fusion.fuse(lanes), lanes).orderBy("position").collect()
    assert [r.frame_id for r in got] == [3, 7] and got[1].reason == "frame_id"


def frames(spark, rows):
    base = {"timestamp_ms": 0, "kind": "note", "role": "document", "status": "active", "superseded_by": None, "parent_id": None, "chunk_index": None, "chunk_count": None, "search_text": None, "metadata": {}, "tags": [], "labels": []}
    return spark.createDataFrame([Row(**{f.name: {**base, **r}[f.name] for f in store.FRAMES}) for r in rows], store.FRAMES)


def test_timeline(spark):
    f = frames(spark, [{"frame_id": i, "timestamp_ms": 1_000_000 + i * 1000, "status": "deleted" if i == 2 else "active"} for i in range(10)])
    ids = lambda df: [r.frame_id for r in df.collect()]
    assert ids(filters.timeline(f, 3)) == [9, 8, 7]
    assert ids(filters.timeline(f, 3, newest_first=False)) == [0, 1, 3]
    assert ids(filters.timeline(f, 9, newest_first=False, include_deleted=True))[:3] == [0, 1, 2]
    assert ids(filters.timeline(f, 9, after_ms=1_004_000, before_ms=1_005_000)) == [4]


@pytest.mark.parametrize("valid,system,hits", [((0, None), (10, None), {10: 1, 9: 0}), ((100, 200), (100, None), {100: 1, 200: 0, 99: 0}), ((0, None), (0, 50), {60: 0, 49: 1})])
def test_as_of(spark, valid, system, hits):
    fact = spark.createDataFrame([(1, 1, 1, 1, "x", None, None)], "fact_id long, subject_id long, predicate_id long, object_kind int, object_text string, object_int long, object_entity_id long")
    span = spark.createDataFrame([(1, 1, *valid, *system)], "span_id long, fact_id long, valid_from_ms long, valid_to_ms long, system_from_ms long, system_to_ms long")
    none = spark.createDataFrame([], "span_id long, fact_id long, source_frame_id long, confidence double, asserted_at_ms long")
    memory = store.Facts(spark.createDataFrame([(1, "a:b", "k")], "entity_id long, key string, kind string"), None, spark.createDataFrame([(1, "p")], "predicate_id long, key string"), fact, span, none)
    for at, n in hits.items():
        assert facts.facts_as_of(memory, at, at).count() == n


def test_retract_is_idempotent(spark):
    span = spark.createDataFrame([(1, 0, None)], "fact_id long, system_from_ms long, system_to_ms long")
    at = spark.createDataFrame([(1, 50)], "fact_id long, at_ms long")
    once = facts.retract(span, at)
    assert once.first().system_to_ms == 50
    assert facts.retract(once, spark.createDataFrame([(1, 70)], "fact_id long, at_ms long")).first().system_to_ms == 50


def test_replay(spark):
    f = spark.createDataFrame([(1, "active", None), (2, "active", None)], "frame_id long, status string, superseded_by long")
    log = spark.createDataFrame([(1, "put", 3, None), (2, "supersede", 1, 2), (3, "supersede", 2, 3), (4, "delete", 1, None)], "sequence long, op string, frame_id long, other_id long")
    assert {tuple(r) for r in state.replay(f, log).collect()} == {(1, "deleted", 2), (2, "active", 3), (3, "active", None)}
    bad = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 9), (5, 2, 7)], "sequence long, frame_id long, other_id long")
    assert {r.sequence: r.problem for r in state.supersede_errors(f, bad).collect()} == {1: "self", 3: "reversed", 4: "unknown", 5: "unknown"}


def test_dense_ids(spark):
    got = state.dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], 5)
    assert sorted((r.k, r.frame_id) for r in got.collect()) == [(i, i + 5) for i in range(1000)]


@pytest.mark.parametrize("query,kind", [("When did it happen", "temporal"), ("what is a frame", "factual"), ("explain this", "semantic"), ("red bicycles", "exploratory")])
def test_query_class(spark, query, kind):
    assert one(spark, tx.query_class(F.col("q")), q=query) == kind


def test_terms(spark):
    assert one(spark, tx.terms(F.col("q")), q="The cities moved, testing BOXES and cars") == ["city", "mov", "test", "box", "cars"]
    assert one(spark, tx.entity_terms(F.col("q")), q="did Person 18 move to Paris with atlas10") == ["atlas10", "paris", "person", "person18"]
    assert one(spark, tx.date_keys(F.col("q")), q="March 4, 2025; 5 Apr 2024, 2023/1/2 and 2023-02-30") == ["2023-01-02", "2024-04-05", "2025-03-04"]
    assert one(spark, tx.intents(F.col("q")), q="where and when is the launch") == ["date", "location", "multi_hop"]
    assert one(spark, tx.quoted_phrases(F.col("q")), q="find \"Red Box\" and 'blue' and \"red box\"") == ["Red Box", "blue"]
    assert one(spark, tx.byte_preview(F.col("q"), 2), q="aé") is None
    assert one(spark, tx.minute_second(F.col("q")), q=61_999) == "01:01"
    assert [one(spark, tx.literal_kind(F.col("q")), q=x) for x in ("1", "1.5", "true", "x")] == ["int", "double", "bool", "string"]
    assert one(spark, tx.valid_identifier(F.col("q"), True), q="a:b.c") and not one(spark, tx.valid_identifier(F.col("q")), q="a b")


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.magnitude(a)) == 5 and one(spark, vx.normalize(a)) == [0.6, 0.8]
    assert one(spark, vx.normalize(b)) == [0, 0] and one(spark, vx.cosine(a, b)) == 0
    assert one(spark, vx.score("l2", a, b)) == -25 and one(spark, vx.subtract(a, b)) == [3, 4]


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "frame_id long, search_text string")
    got = chunking.word_chunks(df, 10, 3).orderBy("chunk_index").collect()
    assert got[1].text.split()[0] == "w7" and got[-1].text.split()[-1] == "w29" and {r.frame_id for r in got} == {1}
    assert chunking.word_chunks(df, 10, 10).orderBy("chunk_index").collect()[1].text.split()[0] == "w10"


def test_line_windows():
    text = "\n".join("x" * 40 for _ in range(10))
    got = list(chunking.line_windows(text, 30, 10))
    assert got[0][:2] == (1, 3) and got[1][0] == 3 and got[-1][1] == 10
    assert all(a[0] < b[0] for a, b in zip(got, got[1:]))


def test_segments(spark):
    v = spark.createDataFrame([(1, 10_000)], "video_id long, duration_ms long")
    assert [(r.start_ms, r.end_ms) for r in media.segments(v, 4000, 1000).orderBy("index").collect()] == [(0, 4000), (3000, 7000), (6000, 10000), (9000, 10000)]


def test_budgets(spark):
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("tokens")) for i, t in enumerate((5, 9, 4, 1))])
    assert [x.i for x in one(spark, context.greedy(items, 10))] == [0, 2, 3]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((5, 9, 4, 1))], "query_id long, rank long, tokens long")
    assert context.prefix(df, 10).count() == 1


def test_context_holds_its_budget(spark):
    f = frames(spark, [{"frame_id": i, "search_text": "word " * 50 * (i + 1)} for i in range(6)])
    hits = spark.createDataFrame([(1, i, i + 1, "word " * 20) for i in range(6)], "query_id long, frame_id long, rank int, preview string")
    got = context.build_context(hits, f, context.ContextOptions(max_tokens=120, expansion_tokens=60)).collect()
    assert got and sum(r.tokens for r in got) <= 120 and got[0].kind == "expanded"


def test_summary(spark):
    text = "Alpha beta gamma delta one. Alpha beta gamma delta one. Something else entirely: 42 things! Short. Short."
    got = surrogates.summarize(frames(spark, [{"frame_id": 1, "search_text": text}])).first()
    assert got.micro in text and len(got.full) >= len(got.gist) >= len(got.micro)
    assert surrogates.select_diverse([("aaa bbb", 5.0), ("aaa bbb", 5.0), ("ccc ddd", 1.0)], 2) == [0, 2]


def test_surrogates(spark):
    f = frames(spark, [{"frame_id": 1, "role": "chunk", "search_text": "One two three four. Five six."}, {"frame_id": 2, "kind": "surrogate", "metadata": {"source_frame_id": "1"}, "search_text": "old"}, {"frame_id": 3, "kind": "surrogate", "metadata": {"source_frame_id": "1"}, "search_text": "new"}])
    assert surrogates.latest_surrogates(f).first().search_text == "new"
    made = surrogates.refresh(f).collect()
    assert [r.source_frame_id for r in made] == [1]
    assert one(spark, surrogates.tier_text(F.col("p"), F.lit("micro")), p=made[0].search_text) and one(spark, surrogates.tier_text(F.col("p"), F.lit("gist")), p="plain") == "plain"


def test_search_prefers_the_move(spark):
    texts = ["Person18 moved to Lisbon in spring", "Person18 is allergic to peanuts", "Person18 prefers written updates"]
    f = frames(spark, [{"frame_id": i, "search_text": t} for i, t in enumerate(texts)])
    q = spark.createDataFrame([(1, "Which city did Person18 move to", None)], "query_id long, query string, vector array<double>")
    got = search.unified_search(search.Request(mode="text", rerank=True), q, f, text_search.build_index(f)).orderBy("rank").collect()
    assert [r.frame_id for r in got][0] == 0 and len(got) == 3


def test_postings_upsert(spark):
    f = spark.createDataFrame([(1, "a b"), (2, "b c")], "frame_id long, search_text string")
    ops = spark.createDataFrame([(1, 1, "x"), (2, 1, "y y"), (3, 2, " ")], "sequence long, frame_id long, text string")
    postings, lengths = text_search.upsert_postings(text_search.build_index(f), ops)
    assert [(r.term, r.frame_id, r.tf) for r in postings.collect()] == [("y", 1, 2)] and lengths.count() == 1


@pytest.mark.parametrize("query,text,answer", [("When is my dentist appointment?", "Your dentist appointment is March 4, 2025 at 9:00 AM.", "March 4, 2025 at 9:00 AM"), ("Which city did Ann move to?", "Ann moved to Lisbon.", "Lisbon"), ("what am I allergic to", "You are allergic to peanuts.", "allergic to peanuts"), ("who owns billing", "Mara Lind owns billing.", "Mara Lind")])
def test_answers(spark, query, text, answer):
    q = spark.createDataFrame([(1, query), (2, "anything")], "query_id long, query string")
    items = spark.createDataFrame([(1, 1, "Nothing here.", 0.1), (1, 2, text, 0.2)], "query_id long, position long, text string, score double")
    got = {r.query_id: r.answer for r in answers.extract_answers(q, items).collect()}
    assert got == {1: answer, 2: ""}


def test_rerank_moves_the_head_only(spark):
    q = spark.createDataFrame([(1, "Which city did Person18 move to")], "query_id long, query string")
    hits = spark.createDataFrame([(1, i, 1.0 - i / 100, ["text"], "x" if i != 35 else "Person18 moved to Rome", i + 1) for i in range(40)], "query_id long, frame_id long, score double, sources array<string>, preview string, rank int")
    got = [r.frame_id for r in rerank.intent_rerank(hits, q, 20).orderBy("rank").collect()]
    assert got[32:] == list(range(32, 40))


def test_scoring_and_hashes(spark):
    assert one(spark, scoring.importance(F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("long"))) == 1
    assert one(spark, scoring.tier_by_importance(F.lit(0.59), F.lit(1.0))) == "full" and one(spark, scoring.tier_by_age(F.lit(10 * 86400000), F.lit(0))) == "gist"
    assert hashing.fold(" Zoë  ＡＢ ") == "zoe ab" and hashing.fnv1a(b"") == hashing.FNV_OFFSET
    assert abs(sum(x * x for x in hashing.hash_embedding("a b c d")) - 1) < 1e-9
    df = spark.createDataFrame([("Foo", "p", 1, "É"), ("foo", "P", 1, "e")], "s string, p string, k int, v string")
    assert df.select(hashing.fact_hash("s", "p", "k", "v").alias("h")).distinct().count() == 1


def test_sessions_and_maintenance(spark):
    f = frames(spark, [{"frame_id": 1, "metadata": {"session_id": "a"}, "search_text": "x"}, {"frame_id": 2, "metadata": {}, "search_text": "yy"}])
    assert {r.frame_id: r.metadata["session_id"] for r in sessions.tag_session(f, "b").collect()} == {1: "a", 2: "b"}
    assert sessions.handoff_text("hi", ["a"]).endswith("- a")
    log = spark.createDataFrame([(i, 100_000) for i in range(1, 6)], "sequence long, bytes long")
    assert [r.commit_due for r in maintenance.auto_commit(log, 500_000).orderBy("sequence").collect()] == [False, False, False, True, True]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 5, 2), (2, 9, 1)], "query_id long, frame_id long, rank int")
    want = spark.createDataFrame([(1, 5), (2, 8), (3, 1)], "query_id long, frame_id long")
    got = metrics.retrieval(hits, want, 10).first()
    assert (got.recall, got.mrr, got.queries) == (round(1 / 3, 6), round(0.5 / 3, 6), 3)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_text("  ")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "Build").mkdir()
    (tmp_path / "Build" / "d.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("hello", None) and got["b.md"] == (None, "empty") and got["c.txt"] == (None, "encoding")
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_folder(spark, str(tmp_path)).collect()] == ["a.txt", "b.md", "c.txt"]
    page = spark.createDataFrame([(1, "u", "<p>a&amp;b</p><script>x</script> c")], "page_id long, url string, html string")
    assert files.html_pages(page).first().text == "a&b c"


def test_git_log(spark):
    text = "COMMIT:abc|a|Ann|2024|fix | this\nbody line\nDIFF:\ndiff --git a b\n+x\nCOMMIT:def|d|Bob|2025|next\n"
    got = git.parse_log(spark.createDataFrame([(text,)], "text string")).orderBy("hash").collect()
    assert [(r.hash, r.subject, r.body) for r in got] == [("abc", "fix | this", "body line"), ("def", "next", "")]
    assert [r.changed_files for r in metrics.changed_files(spark.createDataFrame(got)).orderBy("hash").collect()] == [1, 0]


def test_code_facts(spark):
    text = '#include "Core.h"\nUCLASS(Blueprintable, Abstract)\nclass GAME_API AHero : public ACharacter {\nUPROPERTY(EditAnywhere)\nint Health;'
    got = {(r.subject, r.predicate, r.object) for r in chunking.code_facts(spark.createDataFrame([("1", text)], "chunk_id string, text string")).collect()}
    assert {("AHero", "inherits", "ACharacter"), ("", "includes", "Core.h"), ("AHero", "declared_as", "class")} <= got
    assert ("Health", "uproperty.specifier", "EditAnywhere") in got


def test_snapshots(spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert s.version() == 0
    s.commit(spark.createDataFrame([(1, "active", None, "t")], "frame_id long, status string, superseded_by long, search_text string"))
    s.apply(spark.createDataFrame([(1, "put", 2, None), (2, "delete", 1, None)], "sequence long, op string, frame_id long, other_id long"))
    assert s.version() == 2 and {(r.frame_id, r.status, r.search_text) for r in s.read().collect()} == {(1, "deleted", "t"), (2, "active", None)}
    assert s.read(1).count() == 1


def test_streaming_access(spark, tmp_path):
    from lodestone.streaming import jobs

    spark.createDataFrame([(1, 10), (1, 30), (2, 20)], "frame_id long, at_ms long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("frame_id long, at_ms long").parquet(str(tmp_path / "in"))
    q = jobs.access_stats(stream).writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("stats").collect()} == {(1, 2, 10, 30), (2, 1, 20, 20)}


def test_small_functions(spark):
    assert one(spark, tx.metadata_of(F.col("j")), j='{"a": 1, "b": "x"}') == {"a": "1", "b": "x"}
    assert one(spark, tx.wants_full_text(F.col("q"), F.lit("p"), F.lit("full")), q="where is it") == "full"
    assert one(spark, tx.cue_tags(F.col("t"), 2), t="river river stone stone stone boat") == ["stone", "river"]
    df = spark.createDataFrame([("1", 'Sure: [{"subject": "A", "predicate": "is", "object": "B"}, {"subject": "12", "predicate": "p", "object": "o"}]'), ("2", "none")], "chunk_id string, answer string")
    assert [tuple(r) for r in chunking.parsed_triples(df).collect()] == [("1", "A", "is", "B")]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.5, 0.9), (1, 0.0, 0.0, 0.1, 0.1, 0.99)], "photo_id long, x double, y double, w double, h double, confidence double")
    assert chunking.regions(boxes).count() == 1


def test_fnv_of_many():
    from lodestone.functions import hashing

    values = [b"", b"a", b"foobar", b"a" * 300, "é".encode(), b"foobar"]
    assert hashing.fnv1a_all(values).tolist() == [hashing.fnv1a(v) for v in values] and len(hashing.fnv1a_all([])) == 0


def test_small_row_functions(spark):
    from lodestone.functions import text as tx
    from lodestone.functions import vectors as vx
    from lodestone.operators import chunking, context, fusion, media, metrics, state

    one = spark.range(1)
    row = one.select(
        tx.code_tokens(F.lit("a = b(c);")).alias("code"), tx.byte_cap(F.lit("aé"), 2).alias("cap"), vx.blend(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), 0.5).alias("mix"),
        media.closed_to_half_open(F.lit(9)).alias("end"), tx.phrase_terms(F.lit("see \"The Red  Fox\" and 'the of' or \"red fox\"")).alias("phrases"), tx.literal_value(F.lit("1.5")).alias("value"),
    ).first()
    assert (row.code, row.cap, row.end, row.phrases) == (7, "a", 10, ["red fox"]) and abs(row.mix[0] - row.mix[1]) < 1e-12
    assert (row.value.kind, row.value.real, row.value.whole) == ("double", 1.5, None)
    hits = spark.createDataFrame([(1, 5, 0.5, "b", ["text"]), (1, 5, 0.9, "a", ["vector"])], "query_id int, frame_id int, score double, preview string, sources array<string>")
    merged = fusion.merge_duplicates(hits).first()
    assert (merged.score, merged.preview, merged.sources) == (0.9, "a", ["text", "vector"])
    log = spark.createDataFrame([(1, "embed", 7), (5, "embed", 7), (6, "put", 8), (9, "embed", 9)], "sequence int, op string, frame_id int")
    assert sorted((r.sequence, r.frame_id) for r in state.pending_since(log, 2).collect()) == [(5, 7), (9, 9)]
    texts = spark.createDataFrame([("0f" * 16,), ("ab",), ("some text",)], "text string")
    assert [r[0] for r in texts.where(~chunking.useless_chunk()).collect()] == ["some text"]
    items = spark.createDataFrame([(1, 2, "two"), (1, 1, "one")], "query_id int, position int, text string")
    asked = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id int, query string")
    assert {r.query_id: r.prompt for r in context.prompt(items, asked).collect()} == {1: "[1] one\n[2] two\n\nQuestion: why?", 2: "\n\nQuestion: who?"}
    assert context.query_vectors(asked, "never").first().vector is None
    with pytest.raises(ValueError):
        context.query_vectors(asked, "always")
    assert metrics.mean_judgement(spark.createDataFrame([(1.0,), (0.0,), (None,)], "score double")).first() == (0.5, 2)


def test_photo_texts(spark):
    from lodestone.operators import media

    blocks = spark.createDataFrame([(1, 2, "Exit  here", 0.9), (1, 1, "Menu", 0.8), (1, 3, "menu", 0.7), (1, 4, " ", 0.9)], "photo_id int, position int, text string, confidence double")
    assert media.ocr_summary(blocks).first().text == "Menu\nExit here"
    said = spark.range(1).select(media.photo_summary(F.lit("a cat"), F.lit(" "), F.lit(None).cast("string"), F.lit("May")).alias("x"), media.photo_summary(*[F.lit(None).cast("string")] * 4).alias("y")).first()
    assert (said.x, said.y) == ("Caption: a cat\nTaken: May", "Photo")
    frames = spark.createDataFrame([(1, None, "photo", "x", "active"), (2, 1, "photo.caption", "old", "active"), (3, 1, "photo.caption", "new", "active"), (4, 1, "photo.region", "r", "active"), (5, 1, "photo.tags", "t", "deleted")], "frame_id int, parent_id int, kind string, search_text string, status string")
    got = media.derived(frames).first()
    assert (got.root_id, got.caption, got.tags, len(got.regions)) == (1, "new", None, 1)


def test_stored_index_answers_alike(spark, tmp_path):
    from lodestone.operators import text_search

    f = spark.createDataFrame([(1, "red fox runs"), (2, "the fox is red"), (3, None), (4, "fox fox red")], "frame_id int, search_text string")
    q = spark.createDataFrame([(1, 'a "red fox"'), (2, "fox red"), (3, "the")], "query_id int, query string")
    index = text_search.build_index(f)
    kept = text_search.write_index(index, str(tmp_path / "index"))
    for how in ({}, {"phrases": True}, {"keep_stops": True}):
        a, b = (sorted(map(tuple, text_search.search(i, q, 10, **how).collect())) for i in (index, kept))
        assert a == b and a
    phrased = text_search.search(kept, q.where("query_id = 1"), 10, phrases=True).where("tier = 0").collect()
    assert [r.frame_id for r in phrased] == [1]


def executed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_keeps_k_hits_a_task_and_is_exact(spark, monkeypatch):
    """Blocks of a few frames, copies that tie, frames with all terms and with one, against the ranks of all scores."""
    from pyspark.sql import Window

    monkeypatch.setattr(text_search, "BLOCK_TERMS", 120)  # several passes over the frames
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 30))) for _ in range(300)] + ["w1 w2 w30"] * 40 + ["", None]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "frame_id long, search_text string").repartition(3)
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*texts[:20], "w1 w30", "w39", "zz", "", None, "the of"])], "query_id string, query string")
    index = text_search.build_index(f)
    kept = spark.createDataFrame([(i,) for i in range(0, 342, 3)], "frame_id long")
    for only, k in ((None, 7), (kept, 60)):
        got = text_search.search(index, q, k, only)
        hits = text_search.bm25(index, q)
        hits = hits if only is None else hits.join(only, "frame_id", "left_semi")
        tier = F.when(F.col("all_terms"), 0).otherwise(1)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(tier, F.desc("score"), "frame_id"))
        wanted = hits.select("query_id", "frame_id", "score", tier.alias("tier"), rank.alias("rank")).where(F.col("rank") <= k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    plan = executed(got)
    assert "Aggregate [query_id" not in plan and "MapInArrow" in plan  # no row for each query and frame


def test_search_blocks_are_cut_between_frames():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    frame = np.sort(rng.integers(0, 200, 5000))
    columns = [frame, frame % 7 + 20, rng.integers(0, 9, 5000).astype(np.int32), np.ones(5000, np.int64)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 37]) for c in columns], names=["frame_id", "len", "tid", "tf"]) for i in range(0, 5000, 37)]

    def run(uses):
        best = text_search._Best(np.array([0, 3, 5]), np.array([0, 1, 2, 7, 8]), np.linspace(0.1, 2, 9), 21.0, 10)
        old, text_search.BLOCK_USES = text_search.BLOCK_USES, uses
        try:
            return [tuple(r.values()) for b in text_search._scored(batches, best, pa.array([4, 5])) for r in b.to_pylist()]
        finally:
            text_search.BLOCK_USES = old

    assert len(run(1 << 20)) == 20 and run(1 << 20) == run(100) == run(10)


def test_phrases_are_looked_up_in_one_pass(spark):
    texts = ["red fox red fox red", "fox red", "a red fox. Red\nfox", "red red red", "", None, "red"]
    f = spark.createDataFrame(list(enumerate(texts)), "frame_id long, search_text string")
    index = text_search.build_index(f)
    phrases = spark.createDataFrame([("red fox",), ("red red",), ("fox red fox",), ("no such",)], "term string")
    got = text_search._phrase_postings(index, phrases, True)
    assert sorted((r.term, r.frame_id, r.tf, r.len) for r in got.collect()) == [("fox red fox", 0, 1, 5), ("fox red fox", 2, 1, 5), ("red fox", 0, 2, 5), ("red fox", 2, 2, 5), ("red red", 3, 2, 3)]
    assert executed(got).count("Join ") == 1  # texts are not joined with pairs of phrase and frame


def test_phrase_search_splits_texts_once(spark):
    """Phrases at ends, over each other, of one to eight words and of words that nothing else asks for, against all scores."""
    texts = ["red fox red fox red", "fox red", "a red fox. Red\nfox", "red red red red", "", None, "red", "one two three four five six seven eight", "two three one two"]
    f = spark.createDataFrame(list(enumerate(texts)), "frame_id long, search_text string").repartition(2)
    asked = ['"red fox" red', '"red red" fox', '"fox red fox" none', '"one two three four five six seven eight" "three one" two', '"red"', '"no such" eight', '"fox a"']
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = text_search.build_index(f)
    got = text_search.search(index, q, 20, phrases=True)
    rows = {(r.query_id, r.frame_id): (r.score, r.tier == 0) for r in got.collect()}
    assert rows == {(r.query_id, r.frame_id): (r.score, r.all_terms) for r in text_search.bm25(index, q, phrases=True).collect()}
    assert len(rows) > 20 and rows[3, 7][1] is False and rows[0, 0][1]
    assert executed(got).count("regexp_extract_all") == 1


def test_frames_are_counted_across_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    frames = [[-1, *rng.integers(0, 6, rng.integers(0, 12)).tolist()] for _ in range(50)]
    tid, length = [t for f in frames for t in f], [len(f) for f in frames for _ in f]
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(length[i : i + step]), pa.array(length[i : i + step]), pa.array(tid[i : i + step], pa.int32())], names=["frame_id", "len", "tid"]) for i in range(0, len(tid), step)]
        got = {r["tid"]: (r["n"], r["length"]) for b in text_search._frame_counts(batches, 6) for r in b.to_pylist()}
        assert got == {-1: (50, sum(map(len, frames)))} | {t: (sum(t in f for f in frames), 0) for t in range(6)}


def test_approximate_search_moves_no_pairs(spark):
    import numpy as np

    from lodestone.operators import vector_search

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 5)).tolist() + [[0.0] * 5]
    e = spark.createDataFrame(list(enumerate(v)), "frame_id long, vector array<double>")
    q = e.where("frame_id % 10 = 0").withColumnRenamed("frame_id", "query_id")
    planes = [np.random.default_rng(9).standard_normal((12, 5))[i * 4 : i * 4 + 4] for i in range(3)]
    codes = [[tuple(np.array(x) @ p.T > 0) for p in planes] for x in v]
    wanted = {(a, b) for a in range(0, 61, 10) for b in range(61) if any(x == y for x, y in zip(codes[a], codes[b], strict=True))}
    how = {"tables": 3, "bits": 4, "seed": 9}
    near = vector_search.approximate(vector_search.hyperplane_index(e, 5, **how), q, 61, 5, **how)
    exact = {(r.query_id, r.frame_id): r.score for r in vector_search.exact(e, q, 61).collect()}
    assert {(r.query_id, r.frame_id): r.score for r in near.collect()} == {p: exact[p] for p in wanted}
    assert "Join" not in executed(near)
