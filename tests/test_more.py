import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import hashing, text
from memspark.operators import code_index, cycle, grammars, scan, search
from memspark.schema import MemoryState
from memspark.sources import store

SOURCES = {
    "go": ("package a\n// Add adds.\nfunc Add(a, b int) int {\n\treturn mul(a, b)\n}\ntype T struct { x int }\nfunc (t *T) Do() { Add(1, 2); print(\"func X() {\") }\n", [("function", "Add", ""), ("class", "T", ""), ("method", "Do", "")]),
    "javascript": ("// hi\nexport function f(a, {b}) { return g(a) }\nconst g = async (x) => { return f(x) };\nclass A extends B { constructor(x) { super(x); } run() { if (x) { g(1) } } }\nconst h = x => x + 1\n", [("function", "f", ""), ("function", "g", ""), ("class", "A", ""), ("method", "constructor", "A"), ("method", "run", "A"), ("function", "h", "")]),
    "typescript": ("interface I { a: string }\ntype U = string;\nexport class C { private m(x: number): void { this.n(x) } n(y) { return 1 } }", [("class", "I", ""), ("class", "U", ""), ("class", "C", ""), ("method", "m", "C"), ("method", "n", "C")]),
    "rust": ("/// doc\npub fn a<T>(x: &'a str) -> i32 { b(x) }\nstruct S { x: i32 }\nimpl S { pub fn new() -> S { S { x: 1 } } fn z(&self) { a(1) } }\nmod m { fn inner() {} }", [("function", "a", ""), ("class", "S", ""), ("function", "new", "S"), ("function", "z", "S"), ("function", "inner", "")]),
    "java": ("package x;\npublic class A {\n  int x;\n  public A(int x) { this.x = x; }\n  @Override public String toString() { return fmt(x); }\n  private static String fmt(int y) { if (y > 0) { return \"{\"; } return \"\"; }\n}", [("class", "A", ""), ("method", "A", "A"), ("method", "toString", "A"), ("method", "fmt", "A")]),
    "c": ("struct P { int x; };\nstatic int add(int a, int b)\n{\n  if (a) { return mul(a, b); }\n  return 0;\n}\nint main(void) { return add(1, 2); }", [("class", "P", ""), ("function", "add", ""), ("function", "main", "")]),
    "cpp": ("namespace n {\nclass K : public B { public: K(int a) : x(a) {} void go() const { run(); } int x; };\nvoid K2::f(int a) { g(a); }\n}", [("class", "K", ""), ("method", "K", "K"), ("method", "go", "K"), ("function", "K2::f", "")]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_symbols_of_each_language(language):
    source, want = SOURCES[language]
    got = grammars.symbols(source, language)
    assert [(s["symbol_kind"], s["name"], s["parent"]) for s in got] == want
    assert all(source.split("\n")[s["line_start"] - 1].find(s["name"].split("::")[-1]) >= 0 for s in got)
    assert grammars.symbols("", language) == [] and grammars.symbols("{ ( \" ' /* `", language) is not None


def test_symbol_details():
    go = grammars.symbols(SOURCES["go"][0], "go")
    assert (go[0]["signature"], go[0]["docstring"], go[0]["line_start"], go[0]["line_end"], go[0]["calls"]) == ("func Add(a, b int) int", "Add adds.", 3, 5, ["mul"])
    js = grammars.symbols(SOURCES["javascript"][0], "javascript")
    assert js[2]["signature"] == "class A" and js[2]["calls"] == ["g"]


def test_extract_brace_languages(spark):
    rows = [("ws", f"f{k}", lang, source) for k, (lang, (source, _)) in enumerate(SOURCES.items())] + [("ws", "empty", "go", "")]
    got = code_index.extract(spark.createDataFrame(rows, "workspace string, path string, language string, content string"))
    n = {r["path"]: r["n"] for r in got.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {**{f"f{k}": len(w) for k, (_, w) in enumerate(SOURCES.values())}, "empty": 1}
    line = code_index.file_summaries(got).where("path = 'f0'").first()["file_summary"]
    assert line == "f0 (go): 1 class, 1 function, 1 method. Top symbols: Add, T, Do."


def test_store_commits_by_marker(spark, tmp_path):
    root = str(tmp_path / "store")
    meta = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    assert store.current_version(spark, root) is None
    assert store.commit(MemoryState.empty(spark, meta=meta("a")), root) == 1
    os.makedirs(f"{root}/v=2/meta")  # a writer that died
    assert store.current_version(spark, root) == 1 and store.load(spark, root).meta.first()["value"] == "a"
    assert store.commit(MemoryState.empty(spark, meta=meta("b")), root) == 2
    assert store.load(spark, root).meta.first()["value"] == "b" and store.load(spark, root, 1).meta.first()["value"] == "a"


def test_lock_and_lease(spark, tmp_path):
    root = str(tmp_path)
    with store.writer(spark, root):
        with pytest.raises(store.IndexLocked):
            with store.writer(spark, root):
                pass
        with store.writer(spark, root, lease=-1):  # taken for dead
            pass


def test_named_embedding_and_routing(spark):
    hashing.register("lengths", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(hashing.named("lengths")("t")).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(KeyError):
        hashing.named("nobody")
    a, b = cycle.FakeProvider({}), cycle.FakeProvider({})
    routing = cycle.ModelRouting(default=a, l5_mental_model=b)
    assert cycle.provider_for(routing, "l5_mental_model") is b and cycle.provider_for(routing, "consolidate") is a and cycle.provider_for(a, "any") is a


def test_authorise():
    assert scan.authorise("", "own") == "own" and scan.authorise("own", "own") == "own" and scan.authorise("x", "own", True) == "x"
    with pytest.raises(PermissionError):
        scan.authorise("other", "own")


def test_best_with_ties():
    r = np.random.default_rng(0)
    for n in (3, 10, 200):
        sims, ids = r.integers(0, 4, (7, n)).astype(float), r.permutation(n)
        want = [sorted(range(n), key=lambda c, row=row: (-row[c], ids[c]))[:5] for row in sims]
        assert search._best(sims, ids, 5).tolist() == want


def test_split_tags(spark):
    assert spark.range(1).select(text.split_tags(F.lit(" a, b ,,c "))).first()[0] == ["a", "b", "c"]
