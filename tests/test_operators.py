"""Edge cases of the core operators: nulls, repeated rows, ties, empty tables, extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrata.engine import QueryEngine
from lodestrata.functions.models import hash_embedding
from lodestrata.operators import chunks, graph, hierarchy, index, references, resolve, retrieval, tables
from lodestrata.operators.substrings import containing
from lodestrata.session import cut, table
from lodestrata.sources import extract, tree
from lodestrata.sources.scripts import script_entities, script_imports
from lodestrata.streaming import changes

ENTITY = (
    "entity_id long, project_name string, file_path string, type string, name string, qualified_name string, signature string, docstring string, code string, start_line int, end_line int, "
    "parent_class string, base_classes array<string>, calls array<string>, indexed_at timestamp, deleted_at timestamp, ingested_at timestamp, extra string"
)


def entity(entity_id, name, kind="function", project="p", bases=None, calls=None, deleted=None, arrived="2025-01-02 00:00:00", module="m"):
    import datetime as dt

    at = lambda s: dt.datetime.fromisoformat(s) if s else None
    return (entity_id, project, f"/srv/repos/{project}/{module}.py", kind, name.rpartition(".")[2], f"{project}.{module}.{name}", None, None, "x", 1, 2, None, bases, calls, at("2025-01-05 00:00:00"), at(deleted), at(arrived), "salt")


def test_hierarchy_against_walk(spark):
    import random

    rng = random.Random(3)
    parent = {i: (rng.randrange(0, i) if i % 17 else None) for i in range(1, 400)}
    parent |= {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {1100 + i: 1000 + i % 7 for i in range(20)} | {1200: 1200, 1201: 1200}
    parent |= {2000 + i: 1999 + i for i in range(1, 150)} | {2000: None, 0: None, 5000: 99999}
    rows = [(i, p, "x") for i, p in parent.items()] + [(5, parent[5], "again"), (None, 3, "no id")]
    got = {r.id: (r.root, r.depth, r.path) for r in hierarchy.resolve_hierarchy(spark.createDataFrame(rows, "id long, parent long, root string"), with_path=True).collect()}
    for i in parent:
        path, seen = [i], {i}
        while parent.get(path[-1]) is not None and parent[path[-1]] in parent:
            above = parent[path[-1]]
            if above in seen:
                path = None
                break
            seen.add(above)
            path.append(above)
        assert got.pop(i) == ((path[-1], len(path) - 1, path[::-1]) if path else (-1, -1, None)), i
    assert not got


def test_hierarchy_of_nothing_and_star(spark):
    empty = spark.createDataFrame([], "id long, parent long")
    assert hierarchy.resolve_hierarchy(empty, True).count() == 0
    star = spark.range(1, 3000).select("id", F.lit(0).cast("long").alias("parent")).union(spark.createDataFrame([(0, None)], "id long, parent long"))
    counts = {r.depth: r["count"] for r in hierarchy.resolve_hierarchy(star).groupBy("depth").count().collect()}
    assert counts == {0: 1, 1: 2999}


def test_descendants(spark):
    resolved = hierarchy.resolve_hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long"), True)
    assert sorted(map(tuple, hierarchy.descendants(resolved).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_entity_parents(spark):
    rows = [
        entity(1, "A", "class"), entity(1, "A", "class", arrived="2025-02-01 00:00:00"), entity(2, "B", "class", bases=["dict", "A"]), entity(3, "B.run", "method"),
        entity(4, "C", "class", bases=["p.m.B", "A"]), entity(5, "D", "class", bases=None), entity(6, "E", "class", bases=["A"], module="n"), entity(7, "Gone.run", "method"), entity(8, "f"),
    ]
    got = dict(map(tuple, hierarchy.entity_parents(spark.createDataFrame(rows, ENTITY)).collect()))
    assert got == {1: None, 2: 1, 3: 2, 4: 2, 5: None, 6: None, 7: None}


def test_orphans(spark):
    rows = [
        entity(1, "f", calls=["p.m.g", "p.m.g", "p.m.old", "p.m.late", "p.m.never", "print", None, "q.m.g"], bases=["p.m.X"]),
        entity(1, "f", calls=["p.m.g", "p.m.g", "p.m.old", "p.m.late", "p.m.never", "print", None, "q.m.g"], bases=["p.m.X"], arrived="2025-03-01 00:00:00"),
        entity(2, "g"), entity(3, "old", deleted="2025-01-05 00:00:00"), entity(4, "late", arrived="2025-01-03 00:00:00"), entity(5, "h", calls=None, project=None),
    ]
    df = spark.createDataFrame(rows, ENTITY)
    got = sorted((r.entity_id, r.field, r.target, r.reason) for r in references.find_orphans(df).collect())
    assert got == [(1, "base_classes", "p.m.X", "missing"), (1, "calls", "p.m.late", "late"), (1, "calls", "p.m.never", "missing"), (1, "calls", "p.m.old", "deleted")]
    assert references.find_orphans(spark.createDataFrame([], ENTITY)).count() == 0


def test_key_runs_against_set(spark):
    import datetime as dt

    names = [f"p.m.n{i}" for i in range(500)]
    rows = [(i, "p", f"p.m.n{i}", dt.datetime(2025, 1, 1 + i % 9), None) for i in range(500) if i % 3] * 2 + [(999, "p", None, None, None), (998, None, "p.m.n0", None, None)]
    there = spark.createDataFrame(rows, "entity_id long, project_name string, qualified_name string, ingested_at timestamp, deleted_at timestamp")
    asked = [("p", n, i, "calls", None, None) for i, n in enumerate(names[::2])] * 2 + [("q", "p.m.n1", 1, "calls", None, None)]
    wanted = spark.createDataFrame(asked, "project string, target string, entity_id long, field string, seen timestamp, indexed timestamp")
    # few keys put many names into one run, many leave each name alone; the answer is the same
    for bits, most, least in ((5, 32, 300), (9, 500, 2), (62, 500, 1)):
        runs = references.parent_runs(there, bits).cache()
        assert runs.count() <= most and runs.agg(F.sum(F.size("members"))).first()[0] == 333
        assert runs.agg(F.max(F.size("members"))).first()[0] >= (least if bits != 5 else 8)
        assert runs.where("run_end < run_start or next_start <= run_end + 1").count() == 0
        matched = references.match_runs(wanted, runs, bits).collect()
        assert len(matched) == len(asked)
        assert {(r.project, r.target): r.beyond for r in matched} == {("p", n): i % 3 == 0 for i, n in enumerate(names) if i % 2 == 0} | {("q", "p.m.n1"): True}
        assert all(r.arrived == dt.datetime(2025, 1, 1 + int(r.target[5:]) % 9) for r in matched if not r.beyond)


def test_trails_use_an_edge_once(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a"), ("p", "b", "c")], "project string, src string, dst string")
    got = sorted(">".join(r.path) for r in graph.trails(edges, 3).collect())
    assert got == ["a>b", "a>b>a", "a>b>c", "b>a", "b>a>b", "b>a>b>c", "b>c"]
    with pytest.raises(ValueError):
        graph.trails(edges, 0)


IMPORT = "project_name string, file_path string, name string, alias string, source string, line_number int"


def test_resolution_order(spark):
    rows = [entity(1, "helper", calls=["helper", "print", "imp", "p.m.Base", "nothing_here", "JSON.parse"]), entity(2, "Base", "class"), entity(3, "imp", module="other")]
    imports = spark.createDataFrame([("p", "/srv/repos/p/m.py", "imp", None, "p.other", 1), ("p", "/srv/repos/p/m.py", "gone", "print", "q", 1)], IMPORT)
    got = {r.call: (r.strategy, r.target) for r in resolve.resolve_calls(spark.createDataFrame(rows, ENTITY), imports).collect()}
    assert got == {"helper": ("module", "p.m.helper"), "print": ("builtin", "builtins.print"), "imp": ("import", "p.other.imp"), "p.m.Base": ("qualified", "p.m.Base"), "nothing_here": ("none", None), "JSON.parse": ("none", None)}


def test_golden_cases_of_call_resolution(spark):
    method = lambda i, name, module, calls=None: entity(i, name, "method", calls=calls, module=module)
    view_calls = [
        "helper", "print", "user.get_name", "user.delete", "user.save", "UserService.get_user", "process_data", "nonexistent_function", "super()", "User().save", "User().delete", "Unknown().x", "Star", "unit.go",
    ]
    rows = [
        entity(1, "User", "class", module="models", bases=["p.base.BaseModel"]), entity(2, "Post", "class", module="models", bases=["p.base.BaseModel"]), entity(3, "BaseModel", "class", module="base"),
        entity(4, "UserService", "class", module="services"), entity(5, "helper", module="utils"), entity(6, "process_data", module="utils"),
        method(7, "User.__init__", "models", ["super()", "super().save", "super().missing"]), method(8, "User.get_name", "models"), method(9, "User.save", "models"), method(10, "Post.__init__", "models"),
        method(11, "BaseModel.__init__", "base"), method(12, "BaseModel.save", "base"), method(13, "BaseModel.delete", "base"), method(14, "UserService.get_user", "services"),
        entity(15, "view", module="views", calls=view_calls), entity(16, "Star", "class", module="stars"), entity(17, "helper", module="far"),
    ]
    file = "/srv/repos/p/views.py"
    imports = [("p", file, "User", None, "p.models", 1), ("p", file, "helper", None, ".utils", 2), ("p", file, "UserService", None, "p.services", 3), ("p", file, "*", None, "p.stars", 4)]
    types = spark.createDataFrame([("p", "p.views.view", "user", "User")], "project string, caller string, variable string, type string")
    df = spark.createDataFrame(rows, ENTITY)
    every = {(r.caller, r.call): (r.strategy, r.target) for r in resolve.resolve_calls(df, spark.createDataFrame(imports, IMPORT), types).collect()}
    got = {call: every["p.views.view", call] for call in view_calls}
    assert got == {
        "helper": ("import", "p.utils.helper"), "print": ("builtin", "builtins.print"), "user.get_name": ("import", "p.models.User.get_name"), "user.delete": ("import", "p.base.BaseModel.delete"), "user.save": ("import", "p.models.User.save"),
        "UserService.get_user": ("import", "p.services.UserService.get_user"), "process_data": ("simple", "p.utils.process_data"), "nonexistent_function": ("none", None), "super()": ("none", None), "User().save": ("chain", "p.models.User.save"),
        "User().delete": ("chain", "p.base.BaseModel.delete"), "Unknown().x": ("none", None), "Star": ("import", "p.stars.Star"), "unit.go": ("none", None),
    }
    inside = {call: target for (caller, call), (_, target) in every.items() if caller == "p.models.User.__init__"}
    assert inside == {"super()": "p.base.BaseModel.__init__", "super().save": "p.base.BaseModel.save", "super().missing": None}


def test_script_builtins_and_calls_in_place(spark):
    calls = ["console.log", "JSON.parse", "Array", "go.bind", "Math.pow", "iife_func_3_4", "print"]
    rows = [(*entity(1, "run", calls=calls)[:2], "/srv/repos/p/m.ts", *entity(1, "run", calls=calls)[3:]), entity(2, "iife_func_3_4")]
    got = {r.call: (r.strategy, r.target) for r in resolve.resolve_calls(spark.createDataFrame(rows, ENTITY), spark.createDataFrame([], IMPORT)).collect()}
    assert got == {
        "console.log": ("builtin", "builtin.console.log"), "JSON.parse": ("builtin", "builtin.JSON.parse"), "Array": ("builtin", "builtin.Array"), "go.bind": ("builtin", "builtin.Function.prototype.bind"),
        "Math.pow": ("builtin", "builtin.Math.pow"), "iife_func_3_4": ("iife", "p.m.iife_func_3_4"), "print": ("none", None),
    }


def test_import_maps(spark):
    py, js = "/srv/repos/p/views/index.py", "/srv/repos/p/views/index.ts"
    rows = [
        ("p", py, "os.path", None, None, 1), ("p", py, "numpy.linalg", "la", "", 2), ("p", py, "x", None, "..pkg", 3), ("p", py, "*", None, "p.models", 4), ("p", py, "y", "z", ".", 5),
        ("p", js, "a", None, "./utils", 1), ("p", js, "b", "c", "../models", 2), ("p", js, "debounce", None, "lodash/debounce", 3), ("p", js, "*", "all", "react", 4), ("p", js, "a", None, "./late", 9), ("p", js, None, None, "side", 5),
    ]
    imports = spark.createDataFrame(rows, IMPORT)
    got = {(r.file_path[-2:], r.local): r.target for r in resolve.import_map(imports).collect()}
    assert got == {
        ("py", "os"): "os.path", ("py", "la"): "numpy.linalg", ("py", "x"): "p.pkg.x", ("py", "*p.models"): "p.models", ("py", "z"): "p.views.y",
        ("ts", "a"): "p.views.late.a", ("ts", "c"): "p.models.b", ("ts", "debounce"): "lodash.debounce.debounce", ("ts", "all"): "react",
    }
    names = spark.createDataFrame([("p", py, "User"), ("p", py, "Nobody"), ("p", py, "la")], "project string, file_path string, name string")
    known = spark.createDataFrame([entity(1, "User", "class", module="models")], ENTITY)
    assert {r.name: r.target for r in resolve.resolve_name(names, imports, known).collect()} == {"User": "p.models.User", "Nobody": None, "la": "numpy.linalg"}


def test_nearest_name_against_brute_force(spark):
    import random

    rng = random.Random(8)
    name = lambda: "p." + ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    known = sorted({f"{name()}.{rng.choice(['run', 'get'])}" for _ in range(60)} | {"p.a.run", "p.a.run.run"})
    modules = sorted({name() for _ in range(30)} | {"p.a.run"})

    def far(a, b):
        a, b = a.split("."), b.split(".")
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return len(a) + len(b) - 2 * common - (2 if len(b) > len(a) == common else 0)

    left = spark.createDataFrame([("p", m, t) for m in modules for t in ("run", "get", "none")], "project string, module string, tail string")
    right = spark.createDataFrame([("p", q.rpartition(".")[2], q) for q in known], "project string, tail string, qn string")
    got = {(r.module, r.tail): (r.far, r.target) for r in resolve.nearest_named(left, right).collect()}
    assert got == {(m, t): min((far(m, q), q) for q in known if q.endswith("." + t)) for m in modules for t in ("run", "get")}


def test_diamond_order(spark):
    rows = [entity(1, "A", "class"), entity(2, "B", "class", bases=["A"]), entity(3, "C", "class", bases=["A"]), entity(4, "D", "class", bases=["B", "C"]), entity(5, "A.run", "method")]
    df = spark.createDataFrame(rows, ENTITY)
    order = sorted((r.depth, r.ord, r.ancestor) for r in resolve.ancestors(df).where("class = 'p.m.D'").collect())
    assert [x[2] for x in order] == ["p.m.D", "p.m.B", "p.m.C", "p.m.A"]
    assert resolve.inherited_methods(df).where("class = 'p.m.D'").first().defined_in == "p.m.A"


def test_merge_fold_keeps_order(spark):
    rows = spark.createDataFrame([("k", "1", 0.5, "graph"), ("k", "2", 0.7, "vector"), ("k", "3", 0.1, "graph"), ("o", "1", 0.4, "graph")], "key string, ord string, score double, source string")
    got = {r.key: (round(r.score, 9), r.source) for r in retrieval.merge_scores(rows, ["key"]).collect()}
    assert got == {"k": (round(((0.5 + 0.7) / 2 * 1.1 + 0.1) / 2 * 1.1, 9), "hybrid"), "o": (0.4, "graph")}


def test_caps_and_min_max(spark):
    rows = spark.createDataFrame([("g", "f", float(i), f"{i:02d}") for i in range(9)], "g string, file string, score double, first_ord string")
    assert sorted(r.score for r in retrieval.cap_results(rows, ["g"], "file").collect()) == [4.0, 5.0, 6.0, 7.0, 8.0]
    same = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, s double")
    assert sorted((r.g, r.normalized) for r in retrieval.min_max(same, "s", "g").collect()) == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0)]


def test_upsert_and_versions(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    updates = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k long, v string, t long")
    assert sorted((r.k, r.v) for r in tables.upsert(base, updates, ["k"], [F.desc("t")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    old = spark.createDataFrame([("a", 4), ("b", None)], "id string, version int")
    assert sorted(map(tuple, tables.versioned_upsert(old, spark.createDataFrame([("b",), ("c",), ("c",)], "id string"), "id").collect())) == [("a", 4), ("b", 1), ("c", 1)]


def test_tree_keeps_init_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_bytes(b"x = 1\n\xff")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "a.js").write_text("1")
    (tmp_path / "top.tsx").write_text("a\nb")
    (tmp_path / "note.md").write_text("no")
    deep = tmp_path / "a" / "b" / "node_modules"
    deep.mkdir(parents=True)
    (deep / "no.py").write_text("1")
    (deep.parent / "yes.py").write_text("1\n2\n")
    (tmp_path / "empty").mkdir()
    got = {r.relative_path: (r.language, r.line_count) for r in tree.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {os.path.join("pkg", "__init__.py"): ("python", 2), "top.tsx": ("tsx", 2), os.path.join("a", "b", "yes.py"): ("python", 3)}
    with pytest.raises(ValueError):
        tree.scan_tree(spark, str(tmp_path / "none"))


def test_python_extraction():
    found = extract.python_entities("@deco\nasync def f(a, *, b=1):\n    '''Doc.'''\n    return g(a.h())\n\nclass K(Base, metaclass=M):\n    @staticmethod\n    def m(): pass\n\nif x:\n    def hidden(): pass\n")
    assert [(e["local_name"], e["type"], e["start_line"], e["is_async"]) for e in found] == [("f", "function", 1, True), ("K", "class", 6, False), ("K.m", "method", 7, False)]
    assert found[0]["calls"] == ["a.h", "g"] and found[1]["base_classes"] == ["Base"] and found[2]["is_static"]
    assert extract.python_entities("def (") == []


def test_script_extraction():
    text = (
        "import a, { b as c, type d } from './x';\nimport * as n from \"y\";\nimport 'side';\nimport type { T } from 't';\nimport {\n  e,\n  f,\n} from '../z';\nconst { g, h: i } = require('lib');\n// import no from 'no'\n"
        "/** Says. */\nexport async function go<T>(a: { x: (y: number) => void }, b = '}'): Promise<{ z: T }> {\n  const s = `}`;\n  return n.run(c(a)).then(x => this.stop(x));\n}\n"
        "export abstract class K<T> extends Base<T> implements One, Two.Three {\n  static async m(a) {\n    super.m(a);\n    if (a) { new Map(); }\n  }\n\n  /** Stays. */\n  private at = (x: number): void => {\n    go(x);\n  };\n  get size() { return 1; }\n  constructor() { super(); }\n  field = 3;\n}\n"
        "interface I extends J, K<L> { a(): void }\ntype U<T> = { v: T } | null;\nconst twice = (x) => x * f(2);\nlet plain = 5;\nif (a) { function hidden() {} }\n"
    )
    found = {e["local_name"]: e for e in script_entities(text)}
    assert {n: (e["type"], e["start_line"], e["end_line"]) for n, e in found.items()} == {
        "go": ("function", 12, 15), "K": ("class", 16, 29), "K.m": ("method", 17, 20), "K.at": ("method", 23, 25), "K.size": ("method", 26, 26), "K.constructor": ("method", 27, 27),
        "I": ("interface", 30, 30), "U": ("type_alias", 31, 31), "twice": ("function", 32, 32),
    }
    assert found["go"]["docstring"].strip() == "Says." and found["go"]["is_async"] and found["K.m"]["is_static"] and found["K.m"]["is_async"] and found["K.at"]["docstring"].strip() == "Stays."
    assert found["K"]["base_classes"] == ["Base", "One", "Two.Three"] and found["I"]["base_classes"] == ["J", "K"]
    assert found["go"]["calls"] == ["c", "n.run", "this.stop"] and found["K.m"]["calls"] == ["Map", "super.m"] and found["twice"]["calls"] == ["f"]
    assert found["go"]["signature"].startswith("async function go<T>(a: { x") or found["go"]["signature"].startswith("export async function go")
    assert script_imports(text) == [
        ("a", None, "./x", False, 1), ("b", "c", "./x", False, 1), ("d", None, "./x", False, 1), ("*", "n", "y", True, 2), (None, None, "side", True, 3), ("T", None, "t", True, 4),
        ("e", None, "../z", False, 5), ("f", None, "../z", False, 5), ("g", None, "lib", True, 9), ("h", "i", "lib", True, 9),
    ]
    assert script_entities("function f( {") is not None and script_entities("") == [] and script_imports("") == []


def test_extraction_equals_the_tables(spark, data):
    """What is found in the texts are the entities and imports that the tables have for them, line by line."""
    files = table(spark, data, "files")
    paths = files.select("file_id", F.col("path").alias("file_path")).distinct()
    found = extract.extract_script(files).join(paths, "file_id").select("file_path", "type", "local_name", "start_line", "end_line")
    script = F.col("file_path").rlike(r"\.[jt]sx?$")
    held = files.where("content is not null").select(F.col("path").alias("file_path")).distinct()
    local = F.when(F.col("type") == "method", F.substring_index("qualified_name", ".", -2)).otherwise(F.substring_index("qualified_name", ".", -1))
    wanted = table(spark, data, "code_entities").where(script).join(held, "file_path", "left_semi").select("file_path", "type", local.alias("local_name"), "start_line", "end_line")
    assert wanted.count() > 100 and wanted.join(found, ["file_path", "type", "local_name", "start_line", "end_line"], "left_anti").count() == 0
    imports = extract.extract_script_imports(files).join(paths, "file_id").select("file_path", "name", "source", "line_number")
    wanted = table(spark, data, "imports").where(script).join(held, "file_path", "left_semi").select("file_path", "name", "source", "line_number").distinct()
    assert wanted.count() > 50 and wanted.subtract(imports).count() == 0


def test_a_language_that_only_the_path_tells(spark):
    rows = [(1, None, "/a/b.py", "def f(): pass\n"), (1, None, "/a/b.py", "def f(): pass\n"), (2, None, "/a/b.TS", "class K {}\n"), (3, "python", "/a/c", "class P: pass\n"), (4, None, "/a/d.md", "def no(): pass\n"), (5, None, None, "x")]
    df = spark.createDataFrame(rows, "file_id long, language string, path string, content string")
    assert sorted((r.file_id, r.name) for r in extract.extract_entities(df).collect()) == [(1, "f"), (2, "K"), (3, "P")]


def test_chunks_cover_all_lines():
    lines = [f"word{i} and {i}" for i in range(50)] + ["x " * 40] + ["end"]
    windows = chunks.pack_lines(lines, 20, 6)
    assert windows[0][0] == 0 and windows[-1][1] == len(lines)
    assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(windows, windows[1:]))
    assert chunks.pack_lines([], 20, 6) == [] and chunks.count_tokens("<|endoftext|>") > 1
    with pytest.raises(ValueError):
        chunks.pack_lines(["a"], 5, 5)


FILE = "file_id long, project_name string, path string, relative_path string, language string, content_hash string, content string, ingested_at timestamp"


def file_row(file_id, name, content, day=1, digest=None):
    import datetime as dt

    return (file_id, "p", f"/srv/repos/p/{name}", name, None, digest or f"h{content}", content, dt.datetime(2025, 1, day))


def test_chunks_and_their_index(spark):
    files = spark.createDataFrame([file_row(1, "m.py", "x"), file_row(1, "m.py", "x", 2), file_row(2, "bare.ts", "let a = 1;\nlet b = 2;\n"), file_row(3, "none.py", None), file_row(4, "blank.py", " \n")], FILE)
    entities = spark.createDataFrame([entity(1, "f"), entity(1, "f"), (*entity(2, "g")[:8], "\n".join(f"line {i} of g" for i in range(60)), *entity(2, "g")[9:])], ENTITY)
    made = chunks.chunk_files(files, entities, 60, 10).cache()
    got = {(r.entity_name, r.entity_type, r.language): (r.start_line, r.end_line) for r in made.collect()}
    assert got["p.m.f", "function", "python"] == (1, 2) and got["bare.ts", "file", "typescript"] == (1, 3)
    assert len([n for n, _, _ in got if n.startswith("p.m.g_part")]) > 4 and len(got) == made.count()
    built = index.build_index(made).cache()
    best = index.code_search(built, "line 59 of g", 1, language="python", project="p").first()
    assert best.entity_name.startswith("p.m.g_part") and index.code_search(built, "x", 5, entity_type="class").count() == 0
    stale = files.unionByName(spark.createDataFrame([file_row(5, "new.py", "y")], FILE))
    # files without a chunk, for want of content, are asked about again
    assert sorted(r.path.rpartition("/")[2] for r in index.stale_files(stale, made).collect()) == ["blank.py", "new.py", "none.py"]
    near = index.similar_excluding_file(built, built.where("entity_name = 'p.m.f'"), 3).join(built.select(F.col("chunk_id").alias("vec_id"), "file_path"), "vec_id").collect()
    assert {r.file_path for r in near} == {"/srv/repos/p/bare.ts"}
    fresh = built.where("entity_type = 'file'").withColumn("content", F.lit("changed"))
    swapped = index.replace_files(built, fresh, fresh.select("project_name", F.col("file_path").alias("path")))
    assert swapped.count() == built.count() and swapped.where("content = 'changed'").count() == 1
    wanted = spark.createDataFrame([("p", "/srv/repos/p/bare.ts", 2, 9), ("p", "/srv/repos/p/none.py", 1, 1)], "project_name string, path string, start_line int, end_line int")
    assert [r.snippet for r in index.snippet(files, wanted).collect()] == ["let b = 2;\n"]


def test_search_of_queries_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    before, retrieval.BLOCK_ROWS, retrieval.BLOCK_QUERIES = (retrieval.BLOCK_ROWS, retrieval.BLOCK_QUERIES), 25, 2
    got = {(r.query_id, r.place): r.vec_id for r in retrieval.vector_top_of_queries(df, asked, 4).collect()}
    retrieval.BLOCK_ROWS, retrieval.BLOCK_QUERIES = before
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in (0, 50, 100):
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))
        assert [got[q, place] for place in range(1, 5)] == order[:4]


def test_block_of_search_is_whole_and_quick():
    import time

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    whole = np.round(rng.normal(size=(20_000, 8)))
    whole[rng.random(len(whole)) < 0.01] = 0
    vectors = pd.DataFrame({"vec_id": rng.permutation(len(whole)), "embedding": list(whole), "file_path": [f"/srv/repos/p/{i}.py" for i in rng.integers(0, 40, len(whole))], "label": rng.integers(0, 3, len(whole))})
    queries = vectors[:2000].rename(columns={"vec_id": "query_id", "embedding": "query", "file_path": "asked_file_path", "label": "asked_label"})
    began = time.process_time()
    found = retrieval._best_of_block(5, "label", "file_path")(vectors, queries)
    # ten CPU seconds when names of files were compared pair by pair and all rows of a query were sorted
    assert (took := time.process_time() - began) < 5, took
    assert set(found.groupby("query_id").size()) == {5} and found["query_id"].nunique() == len(queries)
    lengths = np.linalg.norm(whole, axis=1)
    for at in (*range(0, 2000, 100), *np.flatnonzero(lengths[:2000] == 0)[:3]):
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.floor(np.abs(d := whole @ whole[at] / (lengths * lengths[at])) * 1e6 + 0.5) / 1e6 * np.sign(d)
        own = vectors.iloc[at]
        rows = pd.DataFrame({"vec_id": vectors["vec_id"], "score": score})[(vectors["label"] == own["label"]) & (vectors["file_path"] != own["file_path"])]
        best = rows.sort_values(["score", "vec_id"], ascending=[False, True], na_position="last")[:5]
        mine = found[found["query_id"] == own["vec_id"]].sort_values(["score", "vec_id"], ascending=[False, True], na_position="last")
        assert list(mine["vec_id"]) == list(best["vec_id"]) and np.allclose(mine["score"], best["score"], equal_nan=True)


def test_shortest_paths_and_reach(spark):
    names = [f"n{i}" for i in range(9)]
    pairs = list(zip(names, names[1:])) + [("n0", "x"), ("x", "n2"), ("n8", "n0"), ("n3", "n3")]
    edges = spark.createDataFrame([("p", a, b, "CALLS") for a, b in pairs], "project string, src string, dst string, kind string")
    got = {(r.origin, r.reached): (r.depth, r.route) for r in graph.shortest_paths(edges, 10).collect()}
    assert got["n0", "n8"] == (8, ">".join(names)) and got["n0", "n2"] == (2, "n0>n1>n2") and got["n1", "n0"] == (8, ">".join(names[1:]) + ">n0") and ("n3", "n3") not in got
    assert {k for k, (d, _) in got.items() if d > 3} and len(graph.shortest_paths(edges, 3).where("depth > 3").collect()) == 0
    origins = spark.createDataFrame([("p", "n4")], "project string, qn string")
    assert {(r.reached, r.depth) for r in graph.reach(edges, origins, 3).collect()} == {("n5", 1), ("n6", 2), ("n7", 3)}
    assert {(r.reached, r.depth) for r in graph.reach(edges, origins, 3, forward=False).collect()} == {("n3", 1), ("n2", 2), ("n1", 3), ("x", 3)}
    assert {(r.reached, r.distance) for r in graph.related(edges, origins, 2).collect()} == {("n5", 1), ("n3", 1), ("n6", 2), ("n2", 2)}
    with pytest.raises(ValueError):
        graph.shortest_paths(edges, 11)


def test_questions_are_answered_by_intent(spark, data):
    engine = QueryEngine(spark, data)
    method = graph.class_with_methods(engine.entities).orderBy(F.desc("methods"), "qn").first()
    plan = engine.plan(f"what is the hierarchy of `{method.qn}`")
    assert plan.intent == "find_hierarchy" and engine.primary(plan).first().qn == method.qn
    kinds = {r.bucket for r in engine.gather(engine.plan(f"how does `{method.qn}` work"), engine.primary(plan)).collect()}
    assert {"primary", "method"} <= kinds
    part = method.qn.rpartition(".")[2][:-2]
    fuzzy = engine.primary(engine.plan(f"where is `{part}`"))
    assert fuzzy.where(F.col("qn") == method.qn).count() == 1
    edge = graph.call_edges(engine.entities).orderBy("src", "dst").first()
    assert {r.qn for r in engine.chain(edge.src, edge.dst).collect()} >= {edge.src, edge.dst}
    found = engine.search(f"who calls `{edge.dst}`").collect()
    assert edge.dst in {r.qn for r in found} and edge.src in {r.qn for r in found} and len(found) <= 15
    with pytest.raises(ValueError):
        engine.plan("  ")


def test_embedding_is_a_unit_vector():
    vector = hash_embedding("ParseToken parse_token")
    assert abs(sum(x * x for x in vector) - 1) < 1e-9 and hash_embedding("parse token") == pytest.approx(vector)
    assert set(hash_embedding(None)) == {0.0}


def test_a_stream_that_starts_again_goes_on(spark, tmp_path):
    schema = "key long, ts string, action string, payload string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted(tuple(r) for r in changes.run_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "state")).collect())
    put([(1, "2024-01-01", "changed", "a"), (2, "2024-01-01", "changed", "b")])
    assert run() == [(1, "2024-01-01", "a"), (2, "2024-01-01", "b")]
    put([(3, "2024-01-02", "changed", "c"), (2, "2024-01-03", "deleted", "d")])
    assert run() == [(1, "2024-01-01", "a"), (3, "2024-01-02", "c")]
    assert run() == [(1, "2024-01-01", "a"), (3, "2024-01-02", "c")]
    put([(2, "2024-01-02", "changed", "late")])
    assert run() == [(1, "2024-01-01", "a"), (3, "2024-01-02", "c")]


def test_the_file_index_follows_changes(spark, tmp_path):
    schema = spark.createDataFrame([], FILE).schema
    put = lambda *rows: spark.createDataFrame(list(rows), FILE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = []

    def lines(df):
        made.extend(r.path for r in df.select("path").collect())
        return df.select("path", F.explode(F.split("content", "\n")).alias("line"))

    def run():
        made.clear()
        rows = changes.run_index(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "state"), lines)["rows"]
        return sorted((r.path.rpartition("/")[2], r.line) for r in rows.collect())

    put(file_row(1, "a.py", "x\ny"), file_row(2, "b.ts", "z"), file_row(3, "node_modules/c.js", "no"), file_row(4, "d.md", "no"))
    assert run() == [("a.py", "x"), ("a.py", "y"), ("b.ts", "z")]
    put(file_row(1, "a.py", "w", 2), file_row(2, "b.ts", "z", 2))
    assert run() == [("a.py", "w"), ("b.ts", "z")] and set(made) == {"/srv/repos/p/a.py"}
    put(file_row(2, "b.ts", None, 3, "gone"))
    assert run() == [("a.py", "w")]


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2024-01-01", "changed", "a"), (1, "2024-01-03", "deleted", "b"), (2, "2024-01-01", "changed", "c"), (2, "2024-01-02", "changed", "d"), (3, "2024-01-01", "deleted", "e"), (1, "2024-01-02", "changed", "late")]
    schema = "key long, ts string, action string, payload string"
    for part in range(3):
        spark.createDataFrame(rows[part * 2 : part * 2 + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in changes.run_changes(stream, str(tmp_path / "state")).collect()] == [(2, "2024-01-02", "d")]


def test_cut_reads_from_the_checkpoint_folder(spark):
    df = cut(spark.range(10).withColumn("k", F.col("id") % 3), "k")
    assert df.count() == 10 and "RDD" in df._jdf.queryExecution().toString()


def test_core_does_not_import_llm():
    from pathlib import Path

    import lodestrata

    root = Path(lodestrata.__file__).parent
    for source in root.rglob("*.py"):
        if "llm" not in source.relative_to(root).parts:
            assert "lodestrata.llm" not in source.read_text()


def test_parameter_types(spark):
    rows = [entity(1, "UserStore", "class"), entity(2, "Store", "class"), entity(3, "f"), entity(4, "Remote", "class", module="n"), entity(5, "Cart", "class", module="n"), entity(6, "rd", "class"), entity(7, "Ord", "class")]
    rows[2] = (*rows[2][:6], "def f(store, user_store: dict[str, Store] = (1, other), *items, remoteApi=None, userstorex, card, none, e)", *rows[2][7:])
    imports = spark.createDataFrame([("p", "/srv/repos/p/m.py", "Remote", "remoteApi", "p.n", 1), ("p", "/srv/repos/p/m.py", "gone", None, "q", 1)], "project_name string, file_path string, name string, alias string, source string, line_number int")
    df = spark.createDataFrame(rows, ENTITY)
    got = {r.parameter: (r["class"], r.score) for r in resolve.parameter_types(df, imports).collect()}
    assert got == {"store": ("Store", 100), "user_store": ("Store", 90), "items": (None, 0), "remoteApi": ("remoteApi", 100), "userstorex": ("UserStore", 72), "card": ("rd", 90), "none": (None, 0), "e": ("Store", 90)}
    assert resolve.parameter_types(df.limit(0), imports).count() == 0


def test_containing_against_brute_force(spark):
    import random

    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice("abA.é_") for _ in range(n))
    texts = [(i, rng.choice("pq"), piece(rng.randrange(0, 14))) for i in range(200)] + [(300, "p", None), (301, None, "ab"), (302, "p", "aaaaaaa"), (303, "p", "aaaaaaa")]
    words = [(rng.choice("pq"), piece(rng.randrange(0, 6))) for _ in range(80)] + [("p", None), ("p", ""), (None, "a"), ("p", "aaa"), ("p", "aaa")]
    left = spark.createDataFrame(texts, "id long, scope string, text string")
    right = spark.createDataFrame(words, "scope string, word string")
    got = sorted((r.word, r.id) for r in containing(left, right.drop("scope")).collect())
    assert got == sorted((w, i) for w in {w for _, w in words if w} for i, _, t in texts if t is not None and w in t)
    got = sorted((r.word, r.id) for r in containing(left, right, ["scope"]).collect())
    assert got == sorted((w, i) for s, w in {(s, w) for s, w in words if w and s} for i, scope, t in texts if t is not None and scope == s and w in t)
    assert containing(left, right.limit(0)).count() == 0 and containing(left.limit(0), right).count() == 0


def test_ranks_of_a_name_search(spark):
    rows = [entity(i, name) for i, name in enumerate(["load", "LOAD", "loadAll", "reload", "reloading", "x.Loader"])] + [entity(9, "other", module="loaders")]
    words = spark.createDataFrame([("load",), ("p.m.load",), (None,), ("",)], "word string")
    got = {(r.word, r.qn): r.match_score for r in graph.name_search(spark.createDataFrame(rows, ENTITY), words).collect()}
    assert {q: s for (w, q), s in got.items() if w == "load"} == {"p.m.load": 0, "p.m.LOAD": 2, "p.m.loadAll": 3, "p.m.reload": 4, "p.m.reloading": 5, "p.m.x.Loader": 6, "p.loaders.other": 6}
    assert got["p.m.load", "p.m.load"] == 1 and got["p.m.load", "p.m.loadAll"] == 6


def test_inheritance_of_any_depth(spark):
    import random

    rng = random.Random(4)
    bases = {f"C{i}": [f"C{i - 1}"] for i in range(1, 30)} | {"C0": [], "C40": ["C29", "C7"], "C41": ["C40", "C28"]}
    bases |= {"L0": ["L1"], "L1": ["L2", "C3"], "L2": ["L0", "L1"], "L3": ["L0"], "L4": ["L3", "L1"], "S": ["S"], "T": ["S", "L4"]}
    bases |= {f"R{i}": [f"R{j}" for j in rng.sample(range(i), min(i, 2))] for i in range(12)}
    rows = [entity(i, name, "class", bases=above) for i, (name, above) in enumerate(bases.items())] + [entity(999, "C0.run", "method"), entity(998, "C1.stop", "method"), entity(997, "C20.run", "method")]
    df = spark.createDataFrame(rows + rows[:3], ENTITY)
    depths, paths = {}, {}
    for name in bases:
        seen, line = {name: 0}, [name]
        for at in line:
            for above in bases[at]:
                if above not in seen:
                    seen[above] = seen[at] + 1
                    line.append(above)
        depths |= {(name, above): depth for above, depth in seen.items()}
        trails = [(name, frozenset())]
        for at, used in trails:
            for above in bases[at]:
                if (at, above) not in used:
                    trails.append((above, used | {(at, above)}))
                    paths[above, name] = paths.get((above, name), 0) + 1
    short = lambda qn: qn.rpartition(".")[2]
    got = [((short(r["class"]), short(r.ancestor)), r.depth) for r in resolve.ancestors(df).collect()]
    assert len(got) == len(depths) and dict(got) == depths and max(depths.values()) > 20
    got = [((short(r["class"]), short(r.subclass)), r.paths) for r in resolve.subclass_paths(df).collect()]
    assert len(got) == len(paths) and dict(got) == paths
    inherited = {(short(r["class"]), r.method): short(r.defined_in) for r in resolve.inherited_methods(df).collect()}
    assert inherited["C19", "run"] == "C0" and inherited["C29", "stop"] == "C1" and inherited["C41", "run"] == "C0" and inherited["C28", "run"] == "C20" and inherited["C40", "stop"] == "C1"
    assert resolve.ancestors(df.limit(0)).count() == 0 and resolve.subclass_paths(df.limit(0)).count() == 0
