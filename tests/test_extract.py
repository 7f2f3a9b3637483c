from sparkloom.operators import extract

PY = '''import os, json as j
from a.b import c as d

class Store:
    def load(self, name):
        # open("x") is no call here
        return j.loads(os.read(name))

def main():
    Store().load("f(")
'''
TS = '''import React, { useState as us } from "react";
export interface Shape { area(): number }
class Circle implements Shape {
  area() {
    return compute(this.r);
  }
}
const go = async (x: number) => { us(x); };
'''
RUST = '''use std::{fs, io::{self, Read as R}};
struct P { x: i32 }
impl P {
    fn len(&self) -> i32 { self.x.abs() }
}
fn main() { let p = P::new(1); println(p); }
'''


def test_python():
    s = {x.name: x for x in extract.symbols(PY, "python")}
    assert (s["Store"].kind, s["load"].parent, s["main"].start) == ("class", "Store", 9)
    r = extract.references(PY, "python")
    assert {(x.name, x.alias) for x in r if x.kind == "import"} == {("os", None), ("json", "j"), ("a.b.c", "d")}
    calls = {(x.name, x.context) for x in r if x.kind == "call"}
    assert {("loads", "j"), ("read", "os"), ("Store", None)} <= calls and not any(n in ("open", "f") for n, _ in calls)


def test_typescript():
    s = {x.name: x for x in extract.symbols(TS, "typescript")}
    assert s["Circle"].end == 7 and s["area"].parent in ("Circle", "Shape") and s["go"].kind == "function"
    r = extract.references(TS, "typescript")
    assert ("react/useState", "us") in {(x.name, x.alias) for x in r}
    assert ("compute", None) in {(x.name, x.context) for x in r if x.kind == "call"}


def test_rust():
    s = {x.name: x for x in extract.symbols(RUST, "rust")}
    assert s["P"].kind == "class" and s["len"].parent == "P"
    r = extract.references(RUST, "rust")
    assert {("std::fs", None), ("std::io", None), ("std::io::Read", "R")} == {(x.name, x.alias) for x in r if x.kind == "import"}
    assert {("abs", "self.x"), ("new", "P")} <= {(x.name, x.context) for x in r if x.kind == "call"}


def test_other_languages():
    assert [x.name for x in extract.symbols("package m\ntype T struct{}\nfunc (t T) Do() {}\nfunc Run() {}\n", "go")] == ["T", "Do", "Run"]
    assert [x.name for x in extract.symbols("class A\n  def b\n  end\nend\n", "ruby")] == ["A", "b"]
    assert "<stdio.h>" in {x.name for x in extract.references("#include <stdio.h>\nint main() { printf(\"x\"); }\n", "c")}
    assert [x.name for x in extract.symbols("int main() {\n  return f(1);\n}\n", "c")] == ["main"]
    j = "import a.b.C;\nclass X {\n  void run() {\n    go();\n  }\n}\n"
    assert {x.name for x in extract.symbols(j, "java")} == {"X", "run"} and {x.name for x in extract.references(j, "java")} == {"a.b.C", "go"}
    assert extract.references("x", "none") == []


def test_chunks_cover_the_text():
    text = PY + "\n".join(f"def f{i}():\n    return {'x' * 50!r}\n" for i in range(60))
    cs = extract.chunks(text, "python", 300)
    joined = "".join(c.text for c in cs)
    assert "".join(joined.split()) == "".join(text.split())
    assert all(extract._size(c.text) <= 300 for c in cs) and len(cs) > 5
    assert extract.chunks("", "python") == []


def test_token_limit():
    c = extract.Chunk("One sentence here. " * 200, 1, 1, "text", ())
    parts = extract.limit_tokens(c, 50, 10)
    assert all(extract.count_tokens(x.text) <= 50 and x.text in c.text for x in parts) and len(parts) > 3
    assert len(extract.limit_tokens(c, 50, 10, "truncate")) == 1
    assert extract.limit_tokens(extract.Chunk("a b", 1, 1, "t", ()), 50)[0].text == "a b"


def test_outline_and_item():
    assert "  F: load (L5-L7)" in extract.outline(extract.symbols(PY, "python"))
    assert extract.code_item(PY, "python", "Store.load").startswith("    def load")
    assert extract.code_item(PY, "python", "Other.load") is None


def test_literals_that_hold_quotes_and_braces():
    from sparkloom.operators.extract import mask, references, symbols

    js = 'const s = /"/; function c() { d(); }\nconst t = x / 2 / y; const u = a.replace(/[/"]+\\//g, `n${f(`in${g(1)}`)} }`);\nfunction e() { return /}/; }\nfunction h() {}\n'
    assert len(mask(js, "javascript")) == len(js)
    assert {(s.name, s.start, s.end) for s in symbols(js, "javascript")} == {("c", 1, 1), ("e", 3, 3), ("h", 4, 4)}
    assert {r.name for r in references(js, "javascript")} >= {"d", "f", "g", "replace"}
    rust = 'fn a() { let s = r#"x " } fn no() {"#; b(s); }\nfn c<\'a>(x: &\'a str) { let y = br"\\"; }\nfn d() {}\n'
    assert [s.name for s in symbols(rust, "rust")] == ["a", "c", "d"] and {r.name for r in references(rust, "rust")} == {"b"}


def test_query_mode_has_every_definition(spark):
    from sparkloom.operators.extract import extract_chunks, extract_errors

    text = "import os\n\nclass A:\n    def run(self):\n        return 1\n"
    f = spark.createDataFrame([("a.py", "python", text), ("b.py", "python", "def ("), ("c.txt", "text", "x")], "path string, language string, content string")
    got = {(r["node_type"], r["start_line"], r["end_line"], r["content"]) for r in extract_chunks(f, ast=False).collect()}
    assert got == {("class", 3, 5, "class A:\n    def run(self):\n        return 1\n"), ("function", 4, 5, "    def run(self):\n        return 1\n")}
    assert {r["path"] for r in extract_errors(f).collect()} == {"b.py", "c.txt"}
