"""Texts, conversations, messages, readers and streams on small inputs."""

from __future__ import annotations

import json
import math
import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions import classify as K
from trellis.functions import text as X
from trellis.operators import ingest as I
from trellis.operators import vectors as V
from trellis.plans.q_sources import associations
from trellis.sources import exports, readers
from trellis.streaming import incremental as S

c = F.col


def apply(spark, f, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", f(c("v")).alias("out")).orderBy("k").collect()]


FILL = " and so the days went by without much to tell about them, as days do in such a place"


def test_classifier(spark):
    talk = "Human: tell me more.\nA: of course." + FILL
    cases = {
        "ok": "trivial",
        "thanks, got it, that is all I need to hear from you for today and it is all clear to me now, really it is": "trivial",
        talk + " I realized the key insight was the root of it": "insight",
        talk + " to summarize, it works": "synthesis",
        talk + " the todo list and the roadmap are here": "planning",
        talk + " what if we try? I wonder": "exploration",
        "Human: how does it work? why is it so?" + FILL: "question",
        talk + " figured out the bug after testing": "investigation",
        "error: it failed to start, exit code 1" + FILL: "debug",
        "see\n```py\n" + "x = compute(y)\n" * 30 + "```\n" + FILL: "code",
        "word " * 400: "paste",
        "A plain text of some length" + FILL + FILL: "exploration",
    }
    assert apply(spark, K.content_type, *cases) == list(cases.values())


def test_fts_query(spark):
    got = apply(spark, X.fts_query, "Add the flag to a function for parsing", "go do run fast", "the a of", "", "generate_task_file() function, (tool.rs)")
    assert got == ["Add OR flag OR function OR parsing", "run OR fast", "", "", "generate_task_file OR function OR tool.rs"]


def test_urls(spark):
    full = "https://example.com/path"
    assert apply(spark, X.normalise_url, full + "/", full + ".", full + "#section", full + "),", "www.example.com", "ftp://x/y") == [full, full, full, full, "https://www.example.com", "ftp://x/y"]
    assert apply(spark, X.urls, "see https://a.org/b, or docs.dev/x) now") == [["https://a.org/b,", "docs.dev/x"]]


def test_message_tiers(spark):
    rows = [(None, None, False), ("keychange", "a long enough message", False), (None, "yes", False), (None, "agreed", True), (None, "this is a long message", False), (None, "https://a.org", False), (None, "\U0001f600\U0001f600", False), (None, "\U0001f600", True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, body string, quoted boolean")
    got = [r.t for r in df.select("k", X.message_tier(c("kind"), c("body"), c("quoted")).alias("t")).orderBy("k").collect()]
    assert got == ["skip", "skip", "skip", "metadata", "full", "full", "skip", "metadata"]


def test_patterns(spark):
    agree = lambda v: v.rlike(X.AGREES)
    propose = lambda v: v.rlike(X.PROPOSES)
    assert apply(spark, agree, "agreed", "Sounds good", "let's do it", "LGTM", "ship it", "I'm not sure about this") == [True] * 5 + [False]
    assert apply(spark, propose, "should we go", "how about it", "I think we should", "let's try it", "a plain statement") == [True] * 4 + [False]


def test_titles_names_and_identifiers(spark):
    assert apply(spark, X.sentence_title, "", "One. Two.", "x" * 30 + " " + "y" * 60, "z" * 90) == ["Empty message", "One.", "x" * 30 + " " + "y" * 49 + "...", "z" * 80 + "..."]
    assert apply(spark, X.is_generic_name, "Empty Cluster", "Rust Development", "Various") == [True, False, True]
    assert apply(spark, X.duration_ms, "30m", "2h", "7d", "1w", "soon") == [1_800_000, 7_200_000, 604_800_000, 604_800_000, None]
    assert apply(spark, X.arxiv_id, "arXiv:2101.00001v2", "hep-th/9901001", "none") == ["2101.00001", "hep-th/9901001", None]
    assert apply(spark, X.strip_html, "<p>a &amp; b</p>\n <i>c</i>") == ["a & b c"]
    assert apply(spark, lambda v: X.is_garbage(v, F.lit(None).cast("string")), "abc", "12345", "A fine title") == [True, True, False]
    assert apply(spark, lambda v: X.json_reply(v, "a int, b string"), '```json\n{"a": 1, "b": "x",}\n```', "no")[0].a == 1


def test_pairs(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hello"), (1, 1, "assistant", "Hi"), (1, 2, "user", "How are you?"), (1, 3, "assistant", "Well"), (1, 4, "assistant", "Thanks"), (1, 5, "user", "bye"), (2, 0, "system", "s"), (2, 1, "user", "u")], "conv_id long, turn long, role string, text string")
    a = {(r.conv_id, r.turn): (r.question, r.answer) for r in I.alternate_pairs(turns).collect()}
    assert a == {(1, 0): ("Hello", "Hi"), (1, 2): ("How are you?", "Well"), (1, 4): (None, "Thanks"), (2, 0): (None, "s")}
    b = {r.turn: r.answer for r in I.block_pairs(turns).collect()}
    assert b == {0: "Hi", 2: "Well\n\nThanks"}


def messages(spark, rows):
    return spark.createDataFrame([(k, 1, a, t * 1000, body) for k, (a, t, body) in enumerate(rows)], "id long, conversation_id long, author string, sent_at long, body string")


def test_threads_and_weights(spark):
    m = messages(spark, [("x", 0, "a"), ("x", 150, "b"), ("y", 160, "c"), ("y", 500, "d"), ("y", 1000, "e")])
    assert [r.thread for r in I.threads(m).orderBy("id").collect()] == [1, 1, 1, 2, 3]
    w = {r.id: r.weight for r in I.thread_edges(m, least=0.0).collect()}
    assert w == {1: 0.5, 2: pytest.approx(1 - 10 / 300), 3: 0.0, 4: 0.0}
    q = m.withColumn("quote_id", F.when(c("id") == 4, 0).cast("long"))
    assert [r.thread for r in I.quoted_threads(q).orderBy("id").collect()] == [1, 1, 1, 2, 1]


def test_decisions(spark):
    m = messages(spark, [("a", 0, "should we ship it"), ("b", 10, "agreed"), ("c", 20, "sounds good"), ("a", 30, "lgtm"), ("d", 5000, "agreed")])
    assert {(r.proposal, r.id) for r in I.agreements(m).collect()} == {(0, 1), (0, 2)}
    assert [(r.proposal, r.agreers) for r in I.decisions(m).collect()] == [(0, 2)]


def test_vectors(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ("o", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ("n", [1.0, 2.0], [-1.0, -2.0]), ("m", [1.0], [1.0, 2.0]), ("z", [0.0], [0.0])], "id string, a array<float>, b array<float>")
    got = {r.id: r.s for r in df.select("id", V.cosine(c("a"), c("b")).alias("s")).collect()}
    assert got == {"s": pytest.approx(1), "o": 0, "n": pytest.approx(-1), "m": 0, "z": 0}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.5, 0.5])], "id string, embedding array<float>")
    near = V.nearest(v, [1.0, 0.0], 2, exclude="a", least=0.0).collect()
    assert [r.id for r in near] == ["b", "d"]


def test_blocks_give_all_pairs(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(f"v{k:02d}", [float(x) for x in r]) for k, r in enumerate(m)], "id string, embedding array<float>")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expect = {(f"v{i:02d}", f"v{j:02d}") for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 6) >= 0.4}
    assert {(r.a, r.b) for r in V.similar_pairs(v, 0.4, block_rows=7).collect()} == expect
    exact = V.nearest_of_many(v, v.where("id < 'v10'"), 5)
    found = V.CellIndex(v, 6).search(v.where("id < 'v10'"), 5, 6)
    assert {(r.query, r.id) for r in exact.collect()} == {(r.query, r.id) for r in found.collect()}


def _vectors(spark, n, seed, dims=6):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dims)).astype(np.float32)
    m[n // 2 : n // 2 + 25] = m[0]  # one vector many times
    u = m.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    frame = spark.createDataFrame([(f"v{k:03d}", [float(x) for x in r], k) for k, r in enumerate(m)], "id string, embedding array<float>, k int")
    return frame, np.round(u @ u.T, 6)


def test_cells_are_searched_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_ROWS", 20)
    v, sims = _vectors(spark, 200, 3)
    found = V.CellIndex(v, 4).search(v.where("k % 5 = 0"), 7, 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    expect = {(f"v{i:03d}", f"v{j:03d}", r + 1) for i in range(0, 200, 5) for r, j in enumerate(sorted((j for j in range(200) if j != i), key=lambda j: (-sims[i, j], j))[:7])}
    assert {(r.query, r.id, r["rank"]) for r in found.collect()} == expect == {(r.query, r.id, r["rank"]) for r in V.nearest_of_many(v, v.where("k % 5 = 0"), 7).collect()}


def test_similarity_edges_keep_the_best_of_each_end(spark, monkeypatch):
    monkeypatch.setattr(V, "similar_pairs", lambda *a, **b: pytest.fail("all pairs become rows"))
    monkeypatch.setattr(V, "LEAST_ROWS", 20)
    v, sims = _vectors(spark, 120, 5)
    item, kin = [k % 4 != 0 for k in range(120)], [None if k % 6 == 0 else f"p{k % 7}" for k in range(120)]
    more = spark.createDataFrame([(f"v{k:03d}", item[k], kin[k]) for k in range(120)], "id string, is_item boolean, parent_id string")
    expect = set()
    for i in range(120):
        fit = [j for j in range(120) if j != i and (sims[i, j] >= 0.5 or (sims[i, j] >= 0.3 and not item[i] and not item[j]))]
        best = sorted(fit, key=lambda j: (-round(sims[i, j] + (0.2 if kin[i] and kin[i] == kin[j] else 0.0), 6), j))[:4]
        expect |= {(f"v{min(i, j):03d}", f"v{max(i, j):03d}", float(sims[i, j])) for j in best}
    assert {(r.source_id, r.target_id, r.weight) for r in V.semantic_edges(v.join(more, "id"), 0.5, 4).collect()} == expect


def test_associations_keep_one_idea_of_each_item(spark, monkeypatch):
    monkeypatch.setattr(V, "similar_pairs", lambda *a, **b: pytest.fail("all pairs become rows"))
    monkeypatch.setattr(V, "LEAST_ROWS", 10)
    v, sims = _vectors(spark, 150, 4)
    table = v.select(F.col("k").cast("long").alias("vec_id"), "embedding", F.lit(0).alias("label"))
    expect = {}
    for i in range(150):
        scores = [(math.floor((0.7 * sims[i, j] + 0.3 / (1 + abs(i - j))) * 1e6 + 0.5) / 1e6, f"v-{j}") for j in range(0, 150, 3) if i % 3 and i % 5 == j % 5]
        if scores and max(scores)[0] > 0.3:
            expect[f"v-{i}"] = max(scores)
    got = {r.id: (r.score, r.idea_id) for r in associations(SimpleNamespace(embeddings=table)).collect()}
    assert got == expect and len(got) > 50
    assert V._half_up(np.array([0.6959605, -0.6959605])).tolist() == [0.695961, -0.695961]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"uuid": "u", "name": "n", "created_at": "2024", "chat_messages": [{"uuid": "m", "sender": "human", "text": "q", "created_at": ""}, {"uuid": "m2", "sender": "assistant", "text": "r", "created_at": ""}]}]))
    assert [(r.turn, r.role, r.text) for r in readers.chat_turns_a(spark, str(tmp_path / "a.json")).collect()] == [(0, "user", "q"), (1, "assistant", "r")]
    said = lambda role, text: {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}}
    tree = {"r": {"parent": None, "children": ["q"]}, "q": {"parent": "r", "children": ["x", "y"], "message": said("user", "hi")}, "x": {"parent": "q", "children": [], "message": said("assistant", "no")}, "y": {"parent": "q", "children": [], "message": said("assistant", "yes")}}
    (tmp_path / "b.json").write_text(json.dumps([{"id": "c1", "title": "t", "mapping": tree, "current_node": "y"}]))
    assert [(r.role, r.text) for r in readers.chat_turns_b(spark, str(tmp_path / "b.json")).orderBy("turn").collect()] == [("user", "hi"), ("assistant", "yes")]
    (tmp_path / "x.md").write_text("intro\n# The Title\ntext")
    assert readers.markdown(spark, str(tmp_path / "x.md")).first().title == "The Title"
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("Takeout/Keep/1.json", json.dumps({"title": "T", "listContent": [{"text": "milk", "isChecked": True}], "createdTimestampUsec": 5_000_000}))
        z.writestr("Takeout/Keep/2.json", json.dumps({"title": "gone", "isTrashed": True}))
    assert [tuple(r) for r in readers.notes(spark, str(tmp_path / "k.zip")).collect()] == [("T", "- [x] milk", 5000, False)]
    src = tmp_path / "src"
    src.mkdir()
    (src / "m.py").write_text("def f():\n    return g()\n\nclass C:\n    pass\n")
    (src / "l.rs").write_text("pub fn run() {\n}\nstruct S {\n}\n")
    items = {(r.language, r.kind, r.name) for r in readers.code(spark, str(src)).collect()}
    assert items == {("python", "function", "f"), ("python", "class", "C"), ("rust", "function", "run"), ("rust", "struct", "S")}


def test_paper_pages(spark):
    page = {"results": [{"id": "p", "mainTitle": "T", "descriptions": ["d1", "d2"], "pids": [{"scheme": "pmid", "value": "1"}, {"scheme": "doi", "value": "10.1/x"}], "authors": [{"fullName": "A B", "pid": {"id": {"scheme": "orcid", "value": "0"}}}], "instances": [{"accessRight": {"label": "OPEN"}, "urls": ["http://a", "http://b.PDF"]}, {"accessRight": {"label": "CLOSED"}, "urls": ["http://c.pdf"]}]}, {"id": None, "mainTitle": "skipped"}]}
    r = readers.papers(spark.createDataFrame([(json.dumps(page),)], "json string")).collect()
    assert len(r) == 1 and (r[0].description, r[0].doi, r[0].pdf_urls, r[0].access_right, r[0].authors[0].orcid) == ("d1", "10.1/x", ["http://b.PDF"], "UNKNOWN", "0")


def test_exports(spark):
    n = spark.createDataFrame([("root", None, 'A "b" <c>', None, False), ("i1", "root", "I", None, True)], "id string, parent_id string, title string, ai_title string, is_item boolean")
    text = "\n".join(r.value for r in exports.dot(n).orderBy("part", "value").collect())
    assert text.startswith("digraph G {") and '"root" -> "i1"' in text and '\\"b\\"' in text and text.endswith("}")
    assert "&lt;c&gt;" in "".join(r.value for r in exports.graphml(n).collect())


def test_streams(spark, tmp_path):
    rows = [(1, 10, "u1", "clicked", None, 5), (1, 20, "u2", "pause", None, 5), (1, 30, "u1", "resume", None, 5), (2, 15, "u3", "clicked", "mine", 5)]
    spark.createDataFrame(rows, "tab_id long, seen_at long, url string, kind string, session_id string, dwell_ms long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tab_id long, seen_at long, url string, kind string, session_id string, dwell_ms long").parquet(str(tmp_path / "in"))
    q = S.assign_sessions(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.tab_id, r.seen_at, r.session, r.ordinal) for r in spark.table("live").collect()} == {(1, 10, "1-1", 0), (1, 20, "1-1", 1), (1, 30, "1-1", 2), (2, 15, "mine", 0)}
    sink = S.HighWaterImport(str(tmp_path / "out"), time="seen_at", mark=12)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert (sink.imported, sink.late, sink.mark) == (3, 1, 30) and spark.read.parquet(str(tmp_path / "out")).count() == 3
