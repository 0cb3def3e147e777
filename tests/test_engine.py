import json
import subprocess

import pytest

from pyspark.sql import functions as F

from tesselite import config, provider, tools
from tesselite.engine import Engine
from tesselite.functions.keys import project_key_of
from tesselite.functions.vectors import codes, packed, unpacked
from tesselite.operators import ranking
from tesselite.sources import files
from tesselite.sources.store import Store
from tesselite.sources.words import Words


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("def helper(x):\n    return x\n\n\ndef run():\n    return helper(1)\n")
    (root / "b.py").write_text("def other():\n    return 2\n")
    (root / "bad.py").write_bytes(b"\xff\xfe\xff")
    (root / "node_modules" / "c.js").write_text("function f() {}\n")
    (root / "skip_me.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("skip_*.py\n")
    return root


def test_scan_without_git(spark, checkout):
    got = {r.path: r.text for r in files.scan(spark, str(checkout)).collect()}
    assert set(got) == {"a.py", "b.py", "bad.py"} and got["bad.py"] is None


def _counts(rows):
    r = rows.first()
    return r.added, r.skipped, r.removed


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """An engine over a checkout of two projects, for tests that read."""
    base = tmp_path_factory.mktemp("indexed")
    for name, other in (("one", "other"), ("two", "second")):
        (base / name).mkdir()
        (base / name / "a.py").write_text("def helper(x):\n    return x\n\n\ndef run():\n    return helper(1)\n")
        (base / name / "b.py").write_text(f"def {other}():\n    return 2\n")
        (base / name / "c.java").write_text("class Shape {\n}\n")
    e = Engine(spark, config.Config(data_dir=str(base / "store")))
    e.index_codebase(str(base / "one"))
    e.index_codebase(str(base / "two"))
    return e, base


def test_index_changes_only_what_changed(spark, checkout, tmp_path):
    e = Engine(spark, config.Config(data_dir=str(tmp_path / "store")))
    assert "The catalog is empty" in e.tool("code_recall", {"query": "helper"})
    assert _counts(e.index_codebase(str(checkout))) == (3, 1, 0)
    assert _counts(e.index_codebase(str(checkout))) == (0, 3, 0)
    (checkout / "a.py").write_text("def helper(x):\n    return x\n\n\ndef walk():\n    return helper(1)\n")
    assert _counts(e.index_codebase(str(checkout))) == (2, 2, 2)
    code = e.store.read("entries")
    assert {r.symbol for r in code.collect()} == {"helper", "walk", "other"} and code.count() == 3
    assert code.select("id").distinct().count() == 3 == e.store.read("vectors").count()
    assert {r.term for r in e.store.read("postings").collect()} == {"def", "helper", "x", "return", "walk", "other"}
    assert tuple(e.store.read("corpus").selectExpr("sum(n)", "sum(n_tokens)").first()) == (3, sum(len(ranking.query_tokens(f"{r.symbol} {r.text}")) for r in code.collect()))
    assert "3 chunks added, 1 files skipped, 3 chunks removed" in e.tool("index_codebase", {"path": str(checkout), "force": True})
    assert "error" in json.loads(e.tool("index_codebase", {"path": "/no/such/root"})) and "error" in json.loads(e.tool("index_codebase"))
    before = [r for r in e.store.read("entries").orderBy("id").collect()]
    e.compact()
    assert e.store.read("entries").orderBy("id").collect() == before
    assert e.store.read("corpus").count() == 1 and len([r for r in e.store.manifest() if r[1] == "entries"]) == 1


def test_stored_words_rank_as_texts_do(spark, indexed):
    e, _ = indexed
    code = e.store.read("entries")
    for query in ("helper return helper", "def", "nothing_like_it", ""):
        stored = ranking.bm25_stored(e.store.read("postings"), e.store.read("corpus"), query, 10).orderBy("rank").collect()
        assert stored == ranking.bm25(ranking.tokenized(code), query, 10).orderBy("rank").collect()
    project = code.select("project_id").first()[0]
    own = ranking.bm25_stored(e.store.read("postings"), e.store.read("corpus"), "other second", None, project_key_of(project)).collect()
    assert own == ranking.bm25(ranking.tokenized(code.where(F.col("project_id") == project)), "other second").collect() and len(own) == 1
    plan = e.store.read("postings").where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_words_grow_and_shrink(spark, tmp_path):
    words = Words(Store(spark, str(tmp_path / "w")))
    assert words.n_docs() == 0 and words.search("alpha").count() == 0
    rows = spark.createDataFrame([(1, "p", "alpha", "beta beta"), (2, "P.git", None, "alpha gamma"), (3, None, "", None)], "id long, project_id string, symbol string, text string")
    words.add(rows.where("id = 1"))
    words.add(rows.where("id > 1"))
    assert words.n_docs() == 3 and [r.id for r in words.search("alpha").orderBy("rank").collect()] == [2, 1]
    assert words.search("alpha", project="p").count() == 2
    words.remove(rows.where("id = 2"))
    assert words.n_docs() == 2 and [r.id for r in words.search("alpha gamma").collect()] == [1]
    words.clear()
    assert words.n_docs() == 0 and words.search("alpha").count() == 0


def test_tool_code_recall_and_peek(indexed):
    e, base = indexed
    said = e.tool("code_recall", {"query": "other"})
    assert "other @ b.py:1-3" in said and "return 2" in said
    assert "return 2" not in e.tool("code_peek", {"query": "other"})
    assert "second @" in e.tool("code_peek", {"query": "second", "project_path": str(base / "two")})
    assert "second @" not in e.tool("code_peek", {"query": "second", "project_path": str(base / "one")})
    assert e.tool("code_recall", {"query": " "}) == "The query is empty." and "error" in json.loads(e.tool("code_peek"))
    assert e.code_recall("  ").count() == 0 and e.recall("").count() == 0


def test_tool_code_recall_guards(spark, indexed):
    e, base = indexed
    other = Engine(spark, config.Config(data_dir=e.store.path, bit_width=8))
    assert "bit_width" in other.tool("code_recall", {"query": "x"})


def test_tool_code_call_graph(indexed):
    e, base = indexed
    assert "Callers:\n  run @ a.py:5-6" in e.tool("code_call_graph", {"name": "helper", "project_path": str(base / "one")})
    assert "Callees:\n  helper @ a.py:6" in e.tool("code_call_graph", {"name": "run", "direction": "callees"})
    assert e.tool("code_call_graph", {"name": "nobody"}) == "No callers found for 'nobody'."
    assert "language: java" in e.tool("code_call_graph", {"name": "Shape"})
    assert "direction" in json.loads(e.tool("code_call_graph", {"name": "x", "direction": "up"}))["error"] and "error" in json.loads(e.tool("code_call_graph"))


def test_tool_memory_store(spark, checkout, tmp_path):
    e = Engine(spark, config.Config(data_dir=str(tmp_path / "store"), auto_index=True))
    assert "error" in json.loads(e.tool("memory_store", {"action": "retain"})) and "error" in json.loads(e.tool("memory_store"))
    assert e.tool("memory_store", {"action": "list"}) == "No facts are stored."
    # the project is indexed on its first use, so its chunks take the first ids
    assert "Remembered #4 for project local:" in e.tool("memory_store", {"action": "retain", "text": " deploy on friday ", "tags": ["topic:deploy"], "project_path": str(checkout)})
    files = {f for f in (tmp_path / "store" / "entries").rglob("*.parquet")}
    assert "Remembered #5." in e.tool("memory_store", {"action": "retain", "text": "tea at five"})
    new = {f for f in (tmp_path / "store" / "entries").rglob("*.parquet")} - files
    assert sum(spark.read.parquet(str(f)).count() for f in new) == 1  # only the fact is written
    said = e.tool("memory_store", {"action": "recall", "query": "deploy on friday"})
    assert said.startswith("[experience") and "deploy on friday" in said and "[code" not in said
    assert "tea" not in e.tool("memory_store", {"action": "recall", "query": "tea", "tags": ["topic:deploy"]})
    assert "error" in json.loads(e.tool("memory_store", {"action": "recall", "query": " "}))
    assert "#4 [general]" in e.tool("memory_store", {"action": "list", "tags": ["topic:deploy"]}) and "No facts have" in e.tool("memory_store", {"action": "list", "tags": ["x"]})
    assert "error" in json.loads(e.tool("memory_store", {"action": "forget"}))


def test_tools_of_the_catalog(indexed):
    e, base = indexed
    assert e.tool("list_code_projects").count("- local:") == 2
    assert "Code entries: 8" in e.tool("index_status") and "Code entries: 4" in e.tool("index_status", {"project_path": str(base / "one")})
    assert "not in the catalog" in e.tool("index_status", {"project_id": "local:/nowhere"})
    assert "entries: 8 rows" in e.tool("index_metrics")
    assert "(cached: false)" in e.tool("preload_models") and "16 dimensions (cached: true)" in e.tool("preload_models")
    log = e.tool("index_logs", {"category": "index", "level": "info", "limit": 1})
    assert "INFO [index] local:" in log and log.count("\n") == 0 and e.tool("index_logs", {"level": "ERROR"}) == "The log is empty."
    assert "error" in json.loads(e.tool("nothing"))
    assert {s["name"] for s in tools.schemas()} == tools.TOOL_NAMES and len(tools.TOOL_NAMES) == 11


def test_tool_index_health_check(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text("def f():\n    return g()\n")
        (tmp_path / name / "b.py").write_text("def h():\n    return 1\n")
    e = Engine(spark, config.Config(data_dir=str(tmp_path / "store")))
    for name in ("one", "two"):
        e.index_codebase(str(tmp_path / name))
    assert "no stale entries" in e.tool("index_health_check")
    for name in ("one", "two"):
        (tmp_path / name / "a.py").unlink()
    assert "Removed 1 stale Code Entries, 1 orphaned file hashes, 1 stale call graph edges." in e.tool("index_health_check", {"project_path": str(tmp_path / "one")})
    assert e.store.read("entries").count() == 3 == e.store.read("vectors").count()
    (tmp_path / "two" / "b.py").unlink()
    (tmp_path / "two").rmdir()
    assert "1 absent project(s) removed" in e.tool("index_health_check")
    assert [r.symbol for r in e.store.read("entries").collect()] == ["h"] and e.store.read("file_hashes").count() == 1 and e.store.read("call_edges").isEmpty()
    assert e.store.read("corpus").selectExpr("sum(n)").first()[0] == 1


def test_settings_of_the_whole_store_stay(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text("x = 1\n")
        Engine(spark, config.Config(data_dir=str(tmp_path / "store"))).index_codebase(str(tmp_path / name))
    other = Engine(spark, config.Config(data_dir=str(tmp_path / "store"), bit_width=8))
    other.index_codebase(str(tmp_path / "one"), force=True)
    assert {r.key for r in other.config_mismatch().collect()} == {"bit_width"}  # the other project was built with 4


def test_auto_index(spark, checkout, tmp_path):
    store = str(tmp_path / "store")
    assert not Engine(spark, config.Config(data_dir=store)).auto_index(str(checkout))
    e = Engine(spark, config.Config(data_dir=store, auto_index=True))
    assert "other @ b.py" in e.tool("code_recall", {"query": "other", "project_path": str(checkout)})
    assert not e.auto_index(str(checkout))


def test_quantized_from_stored_codes(spark, indexed):
    e, _ = indexed
    v = e.store.read("vectors")
    query = list(v.orderBy("id").first().embedding)
    stored = ranking.quantized_topk(v, query, 3).collect()
    assert stored == ranking.quantized_topk(v.drop("codes"), query, 3).collect() and stored[0].cosine == 1.0
    for bits in (3, 4, 8):
        got = v.select(codes("embedding", bits).alias("a"), unpacked(packed(codes("embedding", bits), bits), bits).alias("b")).collect()
        assert all(r.a == r.b for r in got)


def test_provider(spark, tmp_path):
    p = provider.Provider(spark)
    assert p.is_available() and p.prefetch("x") == "" and "error" in json.loads(p.handle_tool_call("index_metrics", {}))
    assert {s["key"] for s in p.get_config_schema()} == {"auto_retain_turns", "recall_max_chars", "retain_max_chars", "retain_every_n_turns"}
    p.save_config({"retain_every_n_turns": "2", "auto_retain_turns": "true"}, str(tmp_path))
    assert config.load(str(tmp_path)).retain_every_n_turns == 2
    with pytest.raises(ValueError):
        p.save_config({"nonsense": 1}, str(tmp_path))
    p.initialize("s", str(tmp_path), agent_context="helper")
    assert p.engine is None
    p.initialize("s1", str(tmp_path))
    assert p.sync_turn("first question", "first answer") is None  # every second turn
    p.sync_turn("which day", "on friday").result()
    p.on_pre_compress([{"role": "user", "content": "old"}, {"role": "tool", "content": "x"}, {"role": "assistant", "content": None}]).result()
    p.on_memory_write("add", "user", "likes tea")
    p.on_memory_write("remove", "user", "likes milk")
    p.on_session_end([{"role": "user", "content": "hello"}, {"role": "assistant", "content": "there"}])
    facts = {(r.category, r.text, r.tags) for r in p.engine.store.read("entries").collect()}
    assert facts == {
        ("conversation", "User: which day\nAssistant: on friday", '["conversation","session:s1"]'), ("compression", "User: old", '["compression","session:s1"]'),
        ("user_pref", "likes tea", None), ("conversation", "User: hello\nAssistant: there", '["session-end","conversation","session:s1"]'),
    }
    p.queue_prefetch("tea").result()
    assert "likes tea" in p.prefetch("anything") and "which day" not in p.prefetch("anything")
    assert p.get_tool_schemas() and p.name in p.system_prompt_block()
    p.shutdown()
    assert p.engine is None and p.prefetch("tea") == "" and p.sync_turn("a", "b") is None

    class Context:
        def register_memory_provider(self, given):
            self.given = given

    context = Context()
    provider.register(context, spark)
    assert context.given.name == "tesselite"


def test_scan_with_git(spark, checkout):
    subprocess.run(["git", "init", "-q", str(checkout)], check=True)
    subprocess.run(["git", "-C", str(checkout), "add", "-f", "b.py", "skip_me.py"], check=True)
    assert {r.path for r in files.scan(spark, str(checkout)).collect()} == {"b.py", "skip_me.py"}


def test_store_keeps_the_last_complete_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read("projects").count() == 0 and s.version() == 0 and s.next_id() == 1
    row = spark.createDataFrame([("p", "/r", None, None)], "project_id string, root_path string, git_remote string, indexed_at timestamp")
    s.append("projects", row)
    s.append("projects", row)
    (tmp_path / "s" / "manifest" / "v3").mkdir()  # broken off: no success mark
    assert s.read("projects").count() == 2
    with pytest.raises(RuntimeError), s.change() as c:  # a change that fails leaves nothing
        c.add("projects", row)
        raise RuntimeError
    assert s.read("projects").count() == 2
    s.append("projects", row)
    assert s.read("projects").count() == 3 and s.version() == 3
    with s.change() as c:
        c.upsert("projects", row.withColumn("project_id", F.lit("P.git")))
    assert [r.project_id for r in s.read("projects").collect()] == ["P.git"]
    s.append("projects", row)
    s.compact("projects")
    assert s.read("projects").count() == 2 and len(list((tmp_path / "s" / "manifest").iterdir())) == 2
    s.write("projects", row)
    s.write("projects", row)
    assert len(list((tmp_path / "s" / "projects").iterdir())) == 2  # folders that no kept manifest names are gone


def test_config(tmp_path):
    assert config.load(str(tmp_path)).default_limit == 8
    c = config.Config(data_dir=str(tmp_path), default_limit=12, bit_width=8)
    config.save(c)
    assert config.load(str(tmp_path)) == c
    (tmp_path / "config.yaml").write_text("retain_every_n_turns: 0\n")
    assert config.load(str(tmp_path)).retain_every_n_turns == 1
    (tmp_path / "config.yaml").write_text("nonsense: 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))


def test_batch_embedder(spark):
    from tesselite.functions.vectors import batch_embedder

    embed = batch_embedder(lambda texts: [[float(len(t)), 0.0, 3.0] for t in texts])
    got = spark.createDataFrame([("aaaa",), (None,)], "t string").select(embed("t").alias("v")).collect()
    assert [round(x, 3) for x in got[0].v] == [0.8, 0.0, 0.6] and got[1].v is None


def test_live_files(spark, checkout):
    projects = spark.createDataFrame([("p", str(checkout)), ("gone", "/no/such/root"), ("none", None)], "project_id string, root_path string")
    found, present = files.live(spark, projects)
    assert {r.project_id for r in present.collect()} == {"p"} and {r.path for r in found.collect()} >= {"a.py", "b.py", "node_modules/c.js"}
