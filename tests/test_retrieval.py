import math

import pytest
from pyspark.sql import functions as F

from tesselite.functions import tags, text, vectors
from tesselite.operators import conversation, identity, maintenance, ranking, recall, source_code, syntax

MATH = '''def add(a: int, b: int) -> int:
    """Add two numbers together."""
    return a + b


def subtract(a: int, b: int) -> int:
    """Subtract b from a."""
    return a - b


class Calculator:
    """A simple calculator class."""

    def multiply(self, a: int, b: int) -> int:
        """Multiply two numbers."""
        return a * b

    def divide(self, a: int, b: int) -> float:
        """Divide a by b."""
        if b == 0:
            raise ValueError("Cannot divide by zero")
        return a / b
'''


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("camelCase snake_case",), ("add_numbers(a, b)",), ("",), (None,), ("3d über",)], "t string")
    got = [r[0] for r in df.select(text.tokens("t")).collect()]
    assert got == [["hello", "world"], ["camelcase", "snake_case"], ["add_numbers", "a", "b"], [], None, ["d", "ber"]]


def _brute(docs, query, k1=1.5, b=0.75):
    toks = {i: ranking.query_tokens(t) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    asked = ranking.query_tokens(query)
    out = {}
    for i, own in toks.items():
        score = 0.0
        for q in asked:
            df = sum(q in x for x in toks.values())
            tf = own.count(q)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / avg))
        if score:
            out[i] = score
    return out


def test_bm25_matches_formula(spark):
    docs = [(1, "def add(a, b): add two numbers"), (2, "def subtract(a, b): numbers"), (3, "class Calculator: numbers numbers"), (4, ""), (5, "def add(a, b): add two numbers")]
    df = ranking.tokenized(spark.createDataFrame([(i, t, None) for i, t in docs] + [(6, None, None)], "id long, text string, symbol string"))
    want = _brute([*docs, (6, "")], "add two numbers numbers")
    got = {r.id: r.score for r in ranking.bm25(df, "add two numbers numbers").collect()}
    assert got == {i: pytest.approx(s, abs=1e-6) for i, s in want.items()}
    top = ranking.bm25(df, "add two numbers numbers", 2).orderBy("rank").collect()
    assert [r.id for r in top] == [1, 5]  # equal scores by id
    assert ranking.bm25(df, "absent").count() == 0 and ranking.bm25(df, " ?! ").count() == 0
    assert ranking.bm25(df.limit(0), "add").count() == 0
    queries = spark.createDataFrame([(7, "add two numbers numbers"), (8, None), (9, "absent")], "query_id long, query_text string")
    batch = {(r.query_id, r.id): r.score for r in ranking.bm25_batch(df, queries, 10).collect()}
    assert batch == {(7, i): pytest.approx(s, abs=1e-6) for i, s in want.items()}


def test_symbol_counts_for_bm25(spark):
    df = spark.createDataFrame([(1, "x", "load_config"), (2, "load_config x y z", None), (3, "x", "")], "id long, text string, symbol string")
    assert {r.id for r in ranking.bm25(ranking.tokenized(df), "load_config").collect()} == {1, 2}


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "id long, rank int")
    got = {r.id: round(r.rrf, 6) for r in ranking.rrf(a, b).collect()}
    assert got == {2: 0.032522, 3: 0.032002, 1: 0.016393, 4: 0.015873}
    assert ranking.rrf(a, b, 1).where("id = 1").first().rrf == pytest.approx(0.5)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 0.0])], "id long, embedding array<float>")
    got = [(r.id, r.cosine, r["rank"]) for r in ranking.vector_topk(df, [1.0, 0.0], 10).collect()]
    assert got == [(1, 1.0, 1), (7, 1.0, 2), (2, 0.0, 3)]
    q = spark.createDataFrame([(9, [0.0, 1.0]), (10, None)], "query_id long, query array<float>")
    assert [r.id for r in ranking.vector_topk_batch(df, q, 1).collect()] == [2]
    assert ranking.quantized_topk(df, [1.0, 0.0], 1).first().id == 1
    texts = spark.createDataFrame([("abc",)], "t string").select(vectors.hash_embedding("t")).first()[0]
    assert texts == pytest.approx(vectors.hash_embed("abc"))


def test_tags(spark):
    df = spark.createDataFrame([(1, '["a", " b ", ""]'), (2, "broken["), (3, None), (4, '"a"'), (5, "[]")], "id long, tags string")
    assert [r[0] for r in df.orderBy("id").select(tags.decode("tags")).collect()] == [["a", " b "], [], [], [], []]
    assert [r.id for r in df.where(tags.overlap("tags", ["b"])).collect()] == [1]
    assert df.where(tags.overlap("tags", [" ", ""])).count() == 5 and df.where(tags.overlap("tags", None)).count() == 5
    enc = spark.createDataFrame([([" a", "a", "", "b"],), ([],), (None,)], "t array<string>").select(tags.encode("t"))
    assert [r[0] for r in enc.collect()] == ['["a","b"]', None, None]


def test_chunks(spark):
    files = spark.createDataFrame([("m.py", MATH), ("n.js", "const a = 1\n"), ("e", ""), ("x", None), ("w", "intro\r\nfn f() {\r\n}\r\nexport async class C {")], "path string, text string")
    got = {(r.path, r.symbol, r.start_line, r.end_line) for r in source_code.chunks(files, "path").collect()}
    assert got == {("m.py", "add", 1, 6), ("m.py", "subtract", 6, 11), ("m.py", "Calculator", 11, 23), ("n.js", None, 1, 1), ("e", None, 1, 1), ("w", "f", 2, 4), ("w", "C", 4, 4)}
    sizes = {r.symbol: len(r.text) for r in source_code.chunks(files.where("path = 'm.py'"), "path").collect()}
    assert sizes == {"add": 87, "subtract": 85, "Calculator": 331}
    many = spark.createDataFrame([("many", "".join(f"def f{i}():\n" for i in range(250)))], "path string, text string")
    assert source_code.chunks(many, "path").count() == 200


def test_call_edges(spark):
    js = "function helper(x) {\n  return x\n}\n\nfunction run() {\n  return helper(1)\n}\n"
    files = spark.createDataFrame([("m.py", MATH), ("c.js", js), ("c.go", "func helper() {}\nfunc run() {\n  helper()\n  run()\n}"), ("A.java", "void f() { g() }"), ("n.py", None)], "path string, text string")
    got = {(r.path, r.caller_symbol, r.callee, r.caller_start_line, r.callee_line) for r in source_code.call_edges(files, "path").collect()}
    assert got == {("m.py", "subtract", "multiply", 6, 14), ("m.py", "subtract", "divide", 6, 18), ("m.py", "subtract", "ValueError", 6, 21), ("c.js", "run", "helper", 5, 6), ("c.go", "run", "helper", 2, 3)}
    edges = spark.createDataFrame([("p", "m.py", "run", "helper", 1, 2, 1), ("p", "m.py", "run", "helper", 1, 2, 1)], "project_id string, path string, caller_symbol string, callee string, caller_start_line int, caller_end_line int, callee_line int")
    assert source_code.edges_of(edges, "helper").count() == 2 and source_code.edges_of(edges, "run", "callees").count() == 2
    assert source_code.edges_of(edges, "helper", project_id="q").count() == 0
    with pytest.raises(ValueError):
        source_code.edges_of(edges, "x", "sideways")


def test_syntax(spark):
    text = "@wrap\ndef outer(x):\n    def inner():\n        return outer(deep(1))\n    return a.b.inner()\n\n\nclass C:\n    async def m(self):\n        (lambda: 1)()\n        self.m()\nC()\n"
    files = spark.createDataFrame([("m.py", text), ("bad.py", "def f(:\n  g()\ndef h():\n  k()\n"), ("c.js", "function run() {\n  return helper(1)\n}\n"), ("e.py", "x = 1\n"), ("n.py", None), (None, "def z():\n")], "path string, text string").withColumn("_text", F.lit("clash"))
    got = {(r.path, r.symbol, r.start_line, r.end_line) for r in syntax.chunks(files, "path").collect()}
    assert got == {("m.py", "outer", 2, 5), ("m.py", "inner", 3, 4), ("m.py", "C", 8, 11), ("m.py", "m", 9, 11), ("bad.py", "f", 1, 3), ("bad.py", "h", 3, 5), ("c.js", None, 1, 3), ("e.py", None, 1, 1), (None, "z", 1, 2)}
    assert [r.symbol for r in syntax.chunks(files.where("path = 'm.py'"), "path").orderBy("chunk_no").collect()] == ["outer", "inner", "C", "m"]
    edges = {(r.path, r.caller_symbol, r.callee, r.caller_start_line, r.caller_end_line, r.callee_line) for r in syntax.call_edges(files, "path").collect()}
    assert edges == {("m.py", "inner", "outer", 3, 4, 4), ("m.py", "outer", "inner", 2, 5, 5), ("m.py", "m", "m", 9, 11, 11), ("bad.py", "f", "g", 1, 2, 2), ("bad.py", "h", "k", 3, 4, 4), ("c.js", "run", "helper", 1, 2, 2)}
    assert syntax.chunks(files.limit(0), "path").count() == 0
    chosen = {"javascript": lambda t: ([("whole", 1, 1)], [])}  # another language's parser
    assert {r.symbol for r in syntax.chunks(files.where("path = 'c.js'"), "path", parsers=chosen).collect()} == {"whole"}


def test_scope(spark):
    files = spark.createDataFrame([("a/B.PY", 512000), ("a/c.py", 512001), ("node_modules/x.js", 1), ("x.min.js", 1), ("tmp/x.go", 1), ("tmp/keep.go", 1), ("deep/a_skip.py", 1), ("README", 1), (".env.py", 1), ("s/.env.py", 1)], "path string, n_bytes long")
    got = {r.path for r in source_code.in_scope(files, ["tmp/*", "!tmp/keep.go", "*_skip.py", "# x", ""]).collect()}
    assert got == {"a/B.PY", "tmp/keep.go", "s/.env.py"}


def test_language_gate(spark):
    e = spark.createDataFrame([(1, "code", "p", "src/Dummy.java", "Foo"), (2, "code", "p", "src/a.py", "bar"), (3, "experience", "p", None, None)], "id long, entry_type string, project_id string, path string, symbol string")
    assert tuple(source_code.call_language(e, "Foo").first()[2:]) == ("java", False)
    assert tuple(source_code.call_language(e, "A.PY").first()[2:]) == ("python", True)
    assert source_code.call_language(e, "Foo", "q").count() == 0


def test_filters_and_listing(spark):
    e = spark.createDataFrame(
        [(1, "experience", "p", "old", "general", '["topic:auth"]', "2025-01-01 00:00:00"), (2, "experience", None, "new", None, None, "2025-01-02 00:00:00"), (3, "code", "p", "c", None, None, "2025-01-03 00:00:00"), (4, "experience", "p", "x" * 300, "conversation", "bad[", "2025-01-02 00:00:00")],
        "id long, entry_type string, project_id string, text string, category string, tags string, created_at string",
    )
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(recall.selected(e)) == {1, 2, 3, 4}
    assert ids(recall.selected(e, project_id="p", types=["experience"], exclude_categories=["conversation"])) == {1}
    assert ids(recall.selected(e, exclude_categories=["conversation"])) == {1, 2, 3}
    assert ids(recall.selected(e, tags=["topic:auth", "x"])) == {1}
    listed = recall.list_experiences(e, 2).collect()
    assert [r.id for r in listed] == [4, 2] and len(listed[0].text) == 200 and listed[1].line == "- #2 [general] new"
    assert recall.limit_of(0) == 8 and recall.limit_of(None) == 8
    with pytest.raises(ValueError):
        recall.limit_of(-1)


def test_hit_text(spark):
    e = spark.createDataFrame([(1, "code", "p", "body" * 200, None, "src/mod.py", "my_function", 10, 25), (2, "experience", None, "fact", None, None, None, None, None), (3, "code", None, None, None, None, None, None, None)], "id long, entry_type string, project_id string, text string, category string, path string, symbol string, start_line int, end_line int")
    hits = spark.createDataFrame([(1, 0.0625, True, 1), (2, 0.5, False, 2), (3, 1.0, False, 3), (9, 1.0, False, 4)], "id long, cosine double, is_low boolean, rank int")
    full = {r.id: r.hit for r in recall.rendered(hits, e).collect()}
    assert full[1] == "[code | p | score 0.063 [LOW-CONFIDENCE]]\nmy_function @ src/mod.py:10-25\n" + "body" * 100
    assert full[2] == "[experience | general | score 0.500]\nfact" and 9 not in full and full[3].startswith("[code | unknown | score 1.000]\n(file) @")
    peek = {r.id: r.hit for r in recall.rendered(hits, e, peek=True).collect()}
    assert peek[1].endswith("my_function @ src/mod.py:10-25") and peek[2].endswith("(peek)")


def test_maintenance(spark, rows):
    state = spark.createDataFrame([("p", "same", "AA"), ("p", "same", "aa"), ("p", "old", "1"), ("p", "gone", "2"), ("p", "bad", "3")], "project_id string, path string, content_hash string")
    scan = spark.createDataFrame([("p", "same", "aA"), ("p", "old", "9"), ("p", "new", "5"), ("p", "bad", None)], "project_id string, path string, content_hash string")
    ch = maintenance.diff(scan, state)
    assert {(r.path, r.change) for r in ch.collect()} == {("same", "unchanged"), ("old", "changed"), ("gone", "gone"), ("new", "added"), ("bad", "unreadable")}
    assert {(r.path, r.content_hash) for r in maintenance.next_hashes(state, ch).collect()} >= {("old", "9"), ("new", "5"), ("gone", "2"), ("bad", "3")}
    e = spark.createDataFrame([(1, "p", "same"), (2, "p", "old"), (3, "p", None)], "id long, project_id string, path string")
    new = spark.createDataFrame([(9, "p", "old"), (8, "p", "same")], "id long, project_id string, path string")
    assert {r.id for r in maintenance.replaced(e, new, ch).collect()} == {1, 3, 9}
    assert {r.id for r in maintenance.replaced(e, new, ch, force=True).collect()} == {3, 8, 9}


def test_newest_sighting_holds(spark, rows, tmp_path):
    from tesselite.plans import retrieval

    # the newest hash is not the greatest, comes first or late, or is NULL; equal times go by scan_id; rows come twice
    seen = [(2, "back", "1", 9), (1, "back", "F", 5), (3, "fwd", "f", 1), (4, "fwd", "0", 2), (5, "bad", "3", 1), (6, "bad", None, 2), (8, "tie", "a", 4), (7, "tie", "b", 4), (8, "tie", "A", 4)]
    spark.createDataFrame([(i, "p", f, h, t) for i, f, h, t in seen], "scan_id long, project_id string, path string, content_hash string, seen_at_s long").selectExpr("*", "timestamp_seconds(seen_at_s) AS seen_at").write.parquet(f"{tmp_path}/file_scans.parquet")
    spark.createDataFrame([("p", "back", "f"), ("p", "fwd", "0"), ("p", "bad", "3"), ("p", "tie", "A")], "project_id string, path string, content_hash string").write.parquet(f"{tmp_path}/file_hashes.parquet")
    d = str(tmp_path)
    assert rows(retrieval.incremental_diff(spark, d)) == {("p", "back", "changed"), ("p", "fwd", "unchanged"), ("p", "bad", "unreadable"), ("p", "tie", "unchanged")}
    assert rows(retrieval.index_counters(spark, d)) == {("changed", 1), ("unchanged", 2), ("unreadable", 1)}
    assert rows(retrieval.apply_increment(spark, d).select("path", "content_hash")) == {("back", "1"), ("fwd", "0"), ("bad", "3"), ("tie", "a")}


def test_health(spark, rows):
    e = spark.createDataFrame([(1, "p", "code", "a"), (2, "p", "code", "gone"), (3, "p", "experience", None), (4, "q", "experience", None), (5, None, "experience", None)], "id long, project_id string, entry_type string, path string")
    h = spark.createDataFrame([("p", "a"), ("p", "gone"), ("p", "lost"), ("q", "z")], "project_id string, path string")
    c = spark.createDataFrame([("p", "gone", "f"), ("p", "gone", "f"), ("p", "a", "g"), ("q", "z", "h")], "project_id string, path string, callee string")
    pr = spark.createDataFrame([("p",), ("q",)], "project_id string")
    out = maintenance.health(e, h, c, pr, h.where("path = 'a'"), pr.where("project_id = 'p'"))
    assert tuple(out["report"].first()) == (1, 2, 2, 1)
    assert {r.id for r in out["entries"].collect()} == {1, 3, 5}
    assert rows(out["file_hashes"].select("project_id", "path")) == {("p", "a")} and rows(out["projects"]) == {("p",)}
    assert maintenance.report_text(out["report"]).first()[0] == "Index health check complete. Removed 1 stale Code Entries, 2 orphaned file hashes, 2 stale call graph edges, 1 absent project(s) removed."
    calm = maintenance.health(e.limit(0), h.limit(0), c.limit(0), pr.limit(0), h, pr)
    assert maintenance.report_text(calm["report"]).first()[0].endswith("no stale entries found.")


MESSAGES = [(1, 0, "system", "s"), (1, 1, "user", "one"), (1, 2, "assistant", "two"), (1, 3, "user", "three"), (1, 4, "assistant", "four"), (1, 5, "user", "open"), (2, 0, "user", None), (2, 1, "assistant", " ")]


def test_conversations(spark):
    m = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, content string")
    one = {(r.conv_id, r.turn_no): r.text for r in conversation.retained_turns(m, 1).collect()}
    assert one[1, 1] == "User: one\nAssistant: two" and set(one) == {(1, 1), (1, 2), (2, 1)}
    assert {(r.conv_id, r.turn_no) for r in conversation.retained_turns(m, 2).collect()} == {(1, 2)}
    assert {r.conv_id: r.text for r in conversation.compression_summaries(m).collect()} == {1: "User: one\nAssistant: two\nUser: three\nAssistant: four\nUser: open"}
    long = spark.createDataFrame([(1, i, "user", "x" * 600) for i in range(20)], "conv_id long, turn long, role string, content string")
    assert conversation.compression_summaries(long).first().text.count("\n") == 9
    whole = conversation.session_summaries(long).first()
    assert whole.text.endswith("\n…(truncated)") and len(whole.text) == 4800 + 13 and whole.tags == '["session-end","conversation","session:1"]'
    w = spark.createDataFrame([("add", "user", "c"), ("add", "x", "c"), ("remove", "user", "c"), ("add", "user", ""), ("add", "user", None)], "action string, target string, content string")
    assert sorted(r.category for r in conversation.mirrored_writes(w).collect()) == ["general", "user_pref"]
    docs = spark.createDataFrame([(1, "User: a\nb\n\nAssistant: c\r\n"), (2, None), (3, "no turns")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in conversation.messages_of(docs).orderBy("turn").collect()] == [("user", "a\nb"), ("assistant", "c")]


def test_prefetch(spark):
    hits = spark.createDataFrame([(2, "second"), (1, "first")], "rank int, hit string")
    assert conversation.prefetch_text(hits).first()[0] == "## memory\nfirst\n\nsecond"
    assert conversation.prefetch_text(hits, 4).first()[0] == "## memory\nfirs\n…(truncated)"
    assert conversation.prefetch_text(hits.limit(0)).count() == 0


def test_identity(spark):
    df = spark.createDataFrame([("https://H.x/A/b.git",), (" git@h:o/r.git",), ("ssh://git@h/x",), (None,), ("",)], "u string")
    got = [r[0] for r in df.select(identity.project_id(F.lit("/root/x"), "u")).collect()]
    assert got == ["git:h.x/a/b", "git:h:o/r", "git:git@h/x", "local:/root/x", "local:/root/x"]
