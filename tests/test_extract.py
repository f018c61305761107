"""Extraction from source text, on hand-written files."""

from quern.functions import extract
from quern.functions import lines as L


def _parse(path, text):
    row = extract.parse(path, text)
    assert row["error"] is None, row["error"]
    return row


def _functions(row):
    return {f["name"]: f for f in row["functions"]}


def test_languages_and_tests_by_path():
    assert [extract.language(p) for p in ("a.ts", "b/c.TSX", "d.mjs", "e.pyi", "f.go", "g.rs", "noext", ".ts")] == ["typescript", "typescript", "javascript", "python", "go", "unknown", "unknown", "typescript"]
    assert all(map(L.is_test, ["tests/a.ts", "src/__tests__/b.ts", "a.test.tsx", "b.spec.mjs", "test_x.py", "pkg/x_test.go", "e2e/z.ts"]))
    assert not any(map(L.is_test, ["src/a.ts", "contest/a.ts", "testing/x.ts", "latest.py"]))


def test_source_lines_skip_blanks_and_comments():
    text = ["/* one", "two */", "code()", "", "  // note", " * doc", "/* in one line */", "x = 1 /* tail */"]
    assert L.sloc(text, ("//",)) == 2
    assert L.sloc(["# a", "b", ""], ("#",)) == 1


def test_python():
    row = _parse("services/orders.py", '''import os, sys
from .db import client
from app.models import (A, B)

def load(items=[], *, key=None):
    """doc"""
    for i in items:
        if i and key:
            while True:
                pass
    return 1

class Thing:
    async def run(self, a, b):
        try:
            return a
        except:
            global STATE
            return b

def _hidden():
    pass
''')
    assert [(i["raw"], i["line"]) for i in row["imports"]] == [("os", 1), ("sys", 1), (".db", 2), ("app.models", 3)]
    f = _functions(row)
    assert (f["load"]["line"], f["load"]["end_line"], f["load"]["complexity"], f["load"]["params"]) == (5, 11, 5, 3)
    assert f["load"]["max_nesting"] == 3 and f["run"]["params"] == 2 and f["run"]["end_line"] == 19
    assert row["exports"] == ["load", "Thing"]
    assert [(m["kind"], m["line"]) for m in row["markers"]] == [("mutable-default", 5), ("bare-except", 17), ("global-state", 18)]


def test_go():
    row = _parse("cmd/main.go", '''package main

import (
\t"fmt"
\tst "example.com/shop/internal/store"
)
import "os"

func Run(a int, b string) error {
\tif a > 0 && b != "" {
\t\tfor i := 0; i < a; i++ {
\t\t\tfmt.Println(i)
\t\t}
\t}
\t_ = os.Remove(b)
\tv, _ := st.Open(b)
\t// _ = os.Remove(b)
\treturn v
}

func (s *T) small() {}
''')
    assert [i["raw"] for i in row["imports"]] == ["fmt", "example.com/shop/internal/store", "os"] and row["package"] == "main"
    f = _functions(row)
    assert (f["Run"]["line"], f["Run"]["end_line"], f["Run"]["complexity"], f["Run"]["params"], f["Run"]["max_nesting"]) == (9, 19, 4, 2, 2)
    assert f["small"]["lines"] == 1 and row["exports"] == ["Run"]
    assert [m["line"] for m in row["markers"]] == [15, 16]


def test_script_imports():
    row = _parse("a.ts", '''import './side';
import React, { useState as s, type FC } from "react";
import * as fs from 'node:fs';
import type { A } from './types';
import { type B, type C } from './more';
import def from './def';
export { x as y, z } from './barrel';
export * from './all';
export * as ns from './ns';
export type { T } from './t';
const lazy = await import('./lazy');
const built = import(`./pages/${name}`);
const old = require("old-lib");
const text = "import { no } from './no'"; // import './no'
''')
    got = [(i["raw"], i["kind"], i["type_only"], i["names"], i["wildcard"], i["computed"], i["line"]) for i in row["imports"]]
    assert got == [
        ("./side", "import", False, None, True, False, 1),
        ("react", "import", False, ["default", "useState", "FC"], False, False, 2),
        ("node:fs", "import", False, None, True, False, 3),
        ("./types", "import", True, ["A"], False, False, 4),
        ("./more", "import", True, ["B", "C"], False, False, 5),
        ("./def", "import", False, ["default"], False, False, 6),
        ("./barrel", "export-from", False, ["x", "z"], False, False, 7),
        ("./all", "export-from", False, None, True, False, 8),
        ("./ns", "export-from", False, None, True, False, 9),
        ("./t", "export-from", True, ["T"], False, False, 10),
        ("./lazy", "dynamic", False, None, True, False, 11),
        ("`./pages/${name}`", "dynamic", False, None, False, True, 12),
        ("old-lib", "require", False, None, True, False, 13),
    ]
    assert row["server_only"] == ["node:fs"]


def test_script_exports():
    row = _parse("a.ts", '''export const a = 1, b: Map<string, number> = new Map();
export function c() {}
export default class D {}
export interface E { x: number }
export type G = string;
export enum H { X }
export { i, j as k };
export abstract class L {}
const hidden = 1;
export async function* m() {}
''')
    assert row["exports"] == ["a", "b", "c", "D", "E", "G", "H", "i", "k", "L", "m"]
    assert _parse("b.ts", "export default () => 1;\n")["exports"] == ["default"]
    assert _parse("c.ts", "export default function () {}\n")["exports"] == []


def test_script_functions_and_their_names():
    row = _parse("a.ts", '''function declared(a: number, { b, c }: X, ...rest: string[]): Promise<{ x: number }> {
  return 1;
}
const arrow = (a: Record<string, number>, b = 2) => a;
const short = x => x + 1;
const typed: Handler = async (req, res): Promise<void> => { await go(); };
const obj = {
  method(a) { return a; },
  prop: function () { return 1; },
  lambda: () => 2,
  get size() { return 3; },
};
class K<T> extends Base {
  field = () => 1;
  constructor(private a: number) { super(); }
  static async load<U>(u: U): Promise<U> { return u; }
  get name() { return ''; }
  #secret() { if (a) { return 1; } }
  abstract none(): void;
}
export default (z) => z;
const wrapped = memo(function Inner() { return 1; });
items.map((i) => i).filter(Boolean);
type Fn = (a: number) => void;
interface I { call(a: number): void; cb: (x: string) => void }
declare function ambient(a: number): void;
''')
    got = [(f["name"], f["params"]) for f in row["functions"]]
    assert got == [("declared", 3), ("arrow", 2), ("short", 1), ("typed", 2), ("method", 1), ("prop", 0), ("lambda", 0), ("size", 0), ("field", 0), ("constructor", 1), ("load", 1), ("name", 0), ("#secret", 0), ("default", 1), ("memo(...)", 0), ("items.map(...)", 1)]


def test_script_complexity_and_nesting():
    row = _parse("a.ts", '''function f(a, b?: string) {
  if (a) {
    for (const x of a) {
      while (x) { try { go(); } catch (e) { stop(); } }
    }
  } else if (b) {
    do { a--; } while (a > 0);
  }
  switch (a) { case 1: break; case 2: break; default: }
  const inner = () => { if (a && b) { return 1; } };
  return a ? b : a && b || (b ?? a);
}
''')
    f = _functions(row)
    # if, for, while, catch, else if, do, two cases, ?:, &&, ||, ??
    assert f["f"]["complexity"] == 13 and f["f"]["max_nesting"] == 4
    assert f["inner"]["complexity"] == 3 and f["inner"]["max_nesting"] == 1
    assert (f["f"]["line"], f["f"]["end_line"]) == (1, 12)


def test_components_return_elements():
    row = _parse("a.tsx", '''"use client";
import { useEffect } from 'react';
export function Card({ title }: Props) {
  useEffect(() => { go(); });
  useEffect(() => { go(); }, []);
  const label = title ? <b>it's "quoted" {title && <i/>}</b> : null;
  return <div className="a" onClick={() => { if (title) open(); }}>Don't stop // here {label}</div>;
}
const List = <T,>(items: T[]) => items.length;
export const helper = (a: number) => a < 3 && a > 1;
''')
    f = _functions(row)
    assert f["Card"]["is_component"] and f["Card"]["end_line"] == 8 and not f["helper"]["is_component"]
    assert row["use_client"] and not row["use_server"] and row["effects"] == [4] and row["has_jsx"]
    assert f["helper"]["line"] == 10 and "List" in f


def test_markers_and_directives():
    row = _parse("a.ts", '''// @ts-ignore
const a: any = 1;
const b = "// @ts-ignore";
/* @ts-expect-error because */
/** mentions @ts-ignore in prose */
function f(x: any[], y: Array<any>): any { return x as any; }
const c = d as number;
const e = d as unknown as string;
const g = { any: 1 }; g.any;
// eslint-disable-next-line no-console
import { h as any2 } from './x';
''')
    kinds = [(m["kind"], m["line"]) for m in row["markers"]]
    assert [k for k in kinds if k[0] == "any"] == [("any", 2), ("any", 6), ("any", 6), ("any", 6), ("any", 6)]
    assert [k for k in kinds if k[0] == "unsafe-assertion"] == [("unsafe-assertion", 6), ("unsafe-assertion", 8)]
    assert [k for k in kinds if k[0] not in ("any", "unsafe-assertion")] == [("ts-ignore", 1), ("ts-expect-error", 4), ("eslint-disable", 10)]
    assert _parse("a.js", "const a = b;\n// @ts-ignore\n")["markers"] == [{"kind": "ts-ignore", "line": 2, "text": "// @ts-ignore"}]


def test_signals():
    row = _parse("a.ts", '''const u = process.env.DATABASE_URL;
const v = process.env['API_KEY'] ?? process.env.DATABASE_URL;
const w = my.process.env.NO;
const p = ["./setup/jest.ts", '/sw.js', "<rootDir>/x/y.ts", "no path"];
const re = /['"]\\/[a-z]/g;
''')
    assert row["env_reads"] == [{"name": "DATABASE_URL", "line": 1}, {"name": "API_KEY", "line": 2}]
    assert row["path_literals"] == ["setup/jest.ts", "sw.js", "x/y.ts"]


def test_broken_and_missing_texts_are_rows():
    assert extract.parse("a.ts", None)["error"] == "could not be read"
    for text in ("", "function (", "const a = `${", "<div", "}}}}", "/* open", "import", "export {", "class {"):
        for path in ("a.ts", "a.tsx", "a.py", "a.go", "a.txt"):
            assert extract.parse(path, text)["error"] is None


def test_rows_of_a_table(spark):
    texts = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.ts", None)], "path string, text string")
    rows = {r.path: r for r in extract.parse_files(texts).collect()}
    assert rows["a.py"].functions[0].name == "f" and rows["a.py"].lines == 3 and rows["b.ts"].error
    assert extract.warnings(extract.parse_files(texts)).collect() == [("b.ts", "could not be read")]


def test_plain_tokens_are_those_told_apart_one_by_one(monkeypatch):
    import re

    from quern.functions import script

    text = "import a from './a';\n'use client'\nconst é = /x[/]\\/y/g.test(`t${ {k: `u${v}`}.k }`) ? .5 : 1.e3;\n// any\n#p; x?.y; x?.5:z; a /b/ c; [...d]; \\ @e\x1cf<T>(g)\n<A b='}'>{h && <B/>}</A>\n'open\n\"q\\\"\" 0x1Fn >>>= "
    for jsx in (False, True):
        plain = script.Lexer(text, jsx)
        with monkeypatch.context() as m:
            m.setattr(script, "_PLAIN", re.compile(r"(?!)"))
            single = script.Lexer(text, jsx)
        assert plain.tokens == single.tokens and plain.comments == single.comments
    s = script.Script("a.tsx", text)
    assert [i for i, _ in s._sought("import", "any", "(")] == [i for i, t in enumerate(s.t) if t.text in ("import", "any", "(") and t.kind in ("name", "sign")]


def test_plain_imports_in_front_are_read_without_tokens():
    from quern.functions.script import Script

    heads = ["import { a, b$ } from './a';", "import type { T } from \"../t\";", "import d from 'pkg/x';", "import type E from './e';"]
    others = ["import { any, q } from './q';", "import { a as z } from './z';", "import * as n from 'n';", "import type from 'odd';", "import k, { l } from 'm'"]
    body = "export const f = async (x: any) => { if (x) { go() } };\n(function () { return 1 })();\n"
    for text in ("\n".join([*heads, body]), "'use client';\n" + "\n".join([*heads, *others, heads[0], body]), "\n".join([*others, *heads, body])):
        one, other = _parse("src/a.ts", text), _parse("src/a.ts", text.replace("\n", " //\n", 1))  # a comment behind the first line: by tokens
        assert {k: v for k, v in one.items() if k != "hash"} == {k: v for k, v in other.items() if k != "hash"}
    assert [(i["raw"], i["line"], i["type_only"], i["names"]) for i in _parse("src/a.ts", "\n".join(heads) + "\n")["imports"]] == [("./a", 1, False, ["a", "b$"]), ("../t", 2, True, ["T"]), ("pkg/x", 3, False, ["default"]), ("./e", 4, True, ["default"])]
    assert [t.text for t in Script("src/a.ts", "\n".join(heads) + "\ngo();").t] == [";", "go", "(", ")", ";"]
