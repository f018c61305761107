"""Analyses of small projects: graph, rules, scores and reports, with results worked out by hand."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quern import open_project
from quern.operators import layers as L
from quern.operators import resolve
from quern.plans import analysis as A
from quern.plans import findings as R
from quern.plans import reports_project as Q
from quern.plans import settings as S
from quern.plans import words as W
from quern.sources import project as PR
from quern.sources import state as ST


def _analysis(spark, files, settings=None, **info):
    texts = spark.createDataFrame(list(files.items()), "path string, text string")
    known = sorted(files)
    base = {"languages": ("typescript",), "has_typescript": True, "file_count": len(files), "aliases": (PR.Alias("@/", ("src", "app", "")),), "source_roots": tuple(r for r in PR.SOURCE_ROOTS if any(k.startswith(r + "/") for k in known))}
    return A.from_texts(spark, texts, PR.ProjectInfo(**(base | info)), settings)


def _found(a, *rules):
    return a.findings_of(*rules) if rules else a.findings


def _ids(a, *rules):
    return sorted(((r.id, r.file) for r in _found(a, *rules).collect()), key=str)


def _edges(a):
    return sorted((r.src, r.dst, r.line, r.type_only) for r in a.edges.collect())


SHOP = {
    "components/Orders.tsx": "import { orders } from '../lib/db/client';\nexport const Orders = () => orders;\n",
    "services/orders.ts": "import { client } from '../lib/db/client';\nexport const load = () => client;\n",
    "lib/db/client.ts": "import { Orders } from '../../components/Orders';\nexport const client = 1, orders = Orders;\n",
}


@pytest.fixture(scope="module")
def shop(spark):
    settings = S.resolve({"architecture": {"layers": {"ui": ["components"], "application": ["services"], "infrastructure": ["lib/db"]}}})
    return _analysis(spark, SHOP, settings)


def test_edges_and_layer_rules(shop):
    assert _edges(shop) == [("components/Orders.tsx", "lib/db/client.ts", 1, False), ("lib/db/client.ts", "components/Orders.tsx", 1, False), ("services/orders.ts", "lib/db/client.ts", 1, False)]
    found = _ids(shop)
    assert ("architecture/layer-skip", "components/Orders.tsx") in found and ("architecture/layer-violation", "lib/db/client.ts") in found
    assert ("architecture/circular-dependency", "components/Orders.tsx") in found
    assert shop.stats.select("cycles", "layerViolations", "layerSkips", "layeredFiles", "files").first() == (1, 1, 1, 3, 3)
    assert shop.metrics.first().architecture == 83


def test_fingerprints_are_of_rule_file_and_key(shop):
    import hashlib

    skip = shop.findings.where("id = 'architecture/layer-skip'").first()
    want = hashlib.sha1(b"architecture/layer-skip components/Orders.tsx lib/db/client.ts 1").hexdigest()[:12]
    assert skip.fingerprint == want and skip.detail == ["found:    ui -> infrastructure", "expected: ui -> application -> infrastructure"]
    loop = shop.findings.where("id = 'architecture/circular-dependency'").first()
    assert loop.fingerprint == hashlib.sha1(b"architecture/circular-dependency components/Orders.tsx components/Orders.tsx lib/db/client.ts").hexdigest()[:12]
    assert loop.detail == ["components/Orders.tsx -> lib/db/client.ts -> components/Orders.tsx"]


def test_resolution(spark):
    files = {
        "src/a.ts": "import './b';\nimport '@/util';\nimport 'lib/x';\nimport './c.js';\nimport './dir';\nimport './style.css';\nimport './nope';\nimport '@/gone';\nimport lodash from 'lodash/fp';\nimport x from '@scope/pkg/deep';\nimport 'node:fs';\nimport './a';\nimport '../src/b';\nimport 'bootstrap/dist/b.css';\nimport(`./${x}`);\n",
        "src/b.ts": "", "src/util.ts": "", "lib/x.ts": "", "src/lib/x.tsx": "", "src/c.ts": "", "src/dir/index.tsx": "",
    }
    a = _analysis(spark, files)
    assert [(e[1], e[2]) for e in _edges(a)] == [("src/b.ts", 1), ("src/c.ts", 4), ("src/dir/index.tsx", 5), ("src/lib/x.tsx", 3), ("src/util.ts", 2)]
    assert sorted(r.package for r in a.external.collect()) == ["@scope/pkg", "bootstrap", "lodash", "node:fs"]
    assert sorted(r.specifier for r in a.unresolved.collect()) == ["./nope", "@/gone"]


def test_python_and_go_resolution(spark):
    files = {
        "api/routes.py": "from services.orders import load\nfrom .helpers import x\nfrom ..top import y\nimport fastapi.params\nfrom . import z\n",
        "api/__init__.py": "", "api/helpers.py": "", "services/orders.py": "def load(items=[]):\n    global A\n    try:\n        pass\n    except:\n        pass\n", "top.py": "",
        "cmd/main.go": 'package main\nimport (\n"fmt"\n"example.com/shop/internal/store"\n"github.com/x/y"\n)\nfunc Run() {\n_ = store.Open(1)\n}\n',
        "internal/store/store.go": "package store\n", "internal/store/more.go": "package store\n", "internal/store/s_test.go": "package store\n",
    }
    a = _analysis(spark, files, go_module="example.com/shop", languages=("go", "python"), source_roots=())
    assert [(x, y) for x, y, *_ in _edges(a)] == [("api/routes.py", "api/__init__.py"), ("api/routes.py", "api/helpers.py"), ("api/routes.py", "services/orders.py"), ("cmd/main.go", "internal/store/more.go"), ("cmd/main.go", "internal/store/store.go")]
    assert sorted((r.path, r.package) for r in a.external.collect()) == [("api/routes.py", "fastapi"), ("cmd/main.go", "github.com/x/y")]
    found = _ids(a, "python/bare-except", "python/mutable-default", "python/global-state", "go/ignored-error")
    assert all((f"python/{k}", "services/orders.py") in found for k in ("bare-except", "mutable-default", "global-state")) and ("go/ignored-error", "cmd/main.go") in found


def test_type_only_and_package_init_loops(spark):
    typed = {"a.ts": "import type { B } from './b';\n", "b.ts": "import './a';\n"}
    assert _analysis(spark, typed).cycles.count() == 0
    package = {"p/__init__.py": "from .x import a\n", "p/x.py": "from p import b\n", "q/y.py": "from q.z import a\n", "q/z.py": "from q.y import b\n"}
    a = _analysis(spark, package, languages=("python",), source_roots=())
    assert a.cycles.count() == 2 and [f for _, f in _ids(a, "architecture/circular-dependency")] == ["q/y.py"]


def test_complexity_rules(spark):
    big = "export function huge(a, b, c, d, e, f) {\n" + "  if (a) { go(); }\n" * 150 + "}\n"
    deep = "export function deep(a) {\n" + "if (a) {" * 6 + "}" * 6 + "\n}\n"
    view = "export function Card() {\n" + "  go();\n" * 60 + "  return <b>x</b>;\n}\n"
    settings = S.resolve({"thresholds": {"maxFileLines": 100, "maxFunctionLines": 50, "maxComponentLines": 40}})
    found = _ids(_analysis(spark, {"a.ts": big, "d.ts": deep, "v.tsx": view, "a.test.ts": big}, settings), *[r.id for r in R.RULES if r.category == "complexity"])
    want = [("complexity/deep-nesting", "d.ts"), ("complexity/high-complexity", "a.ts"), ("complexity/large-component", "v.tsx"), ("complexity/large-file", "a.ts"), ("complexity/large-function", "a.ts"), ("complexity/too-many-params", "a.ts")]
    assert [f for f in found if f[0].startswith("complexity")] == want


def test_duplicate_blocks_merge_into_regions(spark):
    block = "".join(f"const value{i} = compute(source{i}, target{i});\n" for i in range(20))
    files = {"a.ts": "start();\n" + block, "b.ts": "begin();\n" + block + "ending();\n", "c.test.ts": block}
    a = _analysis(spark, files)
    got = [r.asDict() for r in a.findings_of("maintainability/duplicate-block").collect()]
    assert len(got) == 1 and got[0]["title"] == "A block of 20 lines occurs 2 times" and got[0]["detail"] == ["a.ts:2", "b.ts:2"] and got[0]["current"] == "2"
    two = {"a.ts": block + "middle();\n" * 9 + block.replace("value", "other"), "b.ts": block.replace("value", "other") + "between();\n" + block}
    assert _analysis(spark, two).findings_of("maintainability/duplicate-block").count() >= 2


def test_overlapping_windows_of_one_file_count_once(spark):
    same = spark.createDataFrame([("a", "\n".join(["repeated line here"] * 10))], "path string, text string")
    assert [(r.files, r.lines) for r in R.duplicate_regions(same, 4).collect()] == [(["a", "a"], [1, 5])]


def test_type_rules(spark):
    many = "// @ts-ignore\n" + "let x: any = 1;\n" * 12
    a = _analysis(spark, {"m.ts": many, "one.ts": "let x: any = 1;\n", "u.ts": "const a = b as any;\nconst c = d as unknown as E;\n", "old.js": "go();\n", "jest.config.js": "", "public/sw.js": "", "x.cjs": ""})
    got = {r.id: r for r in a.findings_of(*[r.id for r in R.RULES if r.category == "type-safety"]).collect()}
    assert got["type-safety/explicit-any"].file == "m.ts" and got["type-safety/explicit-any"].current_num == 12
    assert got["type-safety/suppression"].line == 1 and got["type-safety/unsafe-assertion"].current_num == 2
    assert got["type-safety/js-in-ts-project"].detail == ["old.js"]


def test_patterns(spark):
    helper = "export function formatDate(a) {\n  return a;\n}\n"
    three = "".join(f"export function {n}(a) {{\n  return a;\n}}\n" for n in ("createUser", "deleteUser", "updateUser"))
    base = {"x/a.ts": helper, "x/b.ts": helper, "y/a.ts": three, "y/b.ts": three, "t/w.ts": "import { real } from './real';\nexport function wrap(a) { return real(a); }\n", "t/real.ts": "export const real = 1;\n", "t/use.ts": "import './w';\n"}
    strict = S.resolve({"strictness": "strict"})
    patterns = [r.id for r in R.RULES if r.id.startswith("patterns/")]
    found = _ids(_analysis(spark, base, strict), *patterns)
    assert ("patterns/duplicate-helper", "x/a.ts") in found and ("patterns/parallel-implementations", "y/a.ts") in found and ("patterns/thin-wrapper", "t/w.ts") in found
    chosen = base | {"y/pick.ts": "import './a';\nimport './b';\n"}
    assert not [f for f in _ids(_analysis(spark, chosen, strict), *patterns) if f[0] == "patterns/parallel-implementations"]
    tiny = {f"m/p{i}.ts": f"export const c{i} = {i};\n" for i in range(9)} | {"main.ts": "".join(f"import './m/p{i}';\n" for i in range(9))}
    assert ("patterns/abstraction-growth", "m/p0.ts") in _ids(_analysis(spark, tiny, strict), *patterns)


def test_client_boundary(spark):
    files = {
        "app/Card.tsx": "'use client';\nimport { user } from '../lib/user';\nimport { long } from '../lib/long';\n",
        "lib/user.ts": "import { db } from './db';\nexport const user = db;\n",
        "lib/long.ts": "import { user } from './user';\nexport const long = user;\n",
        "lib/db.ts": "export const db = process.env.DATABASE_URL;\n",
        "app/Safe.tsx": "'use client';\nimport { act } from '../lib/act';\nimport type { T } from '../lib/db';\nconst k = process.env.NEXT_PUBLIC_KEY;\n",
        "lib/act.ts": "'use server';\nimport { db } from './db';\nexport const act = db;\n",
        "app/Raw.tsx": "'use client';\nimport fs from 'fs';\nimport './files';\n",
        "app/files.ts": "import pg from 'pg';\n",
        "app/server.tsx": "import '../lib/db';\n",
    }
    a = _analysis(spark, files)
    got = sorted((r.client, r.target, r.chain) for r in a.leaks.collect())
    assert got == [("app/Card.tsx", "lib/db.ts", ["app/Card.tsx", "lib/user.ts", "lib/db.ts"]), ("app/Raw.tsx", "app/Raw.tsx", ["app/Raw.tsx"])]
    rules = [r.id for r in R.RULES if r.id.startswith("next/")]
    found = _ids(a, *rules)
    assert ("next/secret-in-client-bundle", "app/Card.tsx") in found and ("next/server-import-in-client", "app/Raw.tsx") in found
    del files["app/Raw.tsx"]
    files["app/Raw.tsx"] = "'use client';\nimport './files';\n"
    assert ("next/server-module-in-client-bundle", "app/Raw.tsx") in _ids(_analysis(spark, files), *rules)


def test_features_forbidden_and_depth(spark):
    chain = {f"src/m{i}.ts": f"import './m{i + 1}';\n" for i in range(12)} | {"src/m12.ts": ""}
    files = chain | {"src/features/a/x.ts": "import '../b/y';\n", "src/features/b/y.ts": ""}
    a = _analysis(spark, files, S.resolve({"architecture": {"forbidden": [["features/a/**", "features/b/**"], ["none/**", "x"]]}}))
    found = _ids(a, "architecture/cross-feature-import", "architecture/forbidden-dependency")
    assert ("architecture/cross-feature-import", "src/features/a/x.ts") in found and ("architecture/forbidden-dependency", "src/features/a/x.ts") in found
    deep = a.findings_of("architecture/deep-import-chain").collect()
    assert [(r.file, r.current_num) for r in deep] == [("src/m0.ts", 12)]
    assert len(L.dead_patterns(a.settings, a.files, a.layers)) == 2


def test_layer_inference_and_coverage(spark):
    files = {f"src/services/s{i}.ts": "" for i in range(5)} | {f"src/components/c{i}.ts": "" for i in range(6)} | {f"src/misc/m{i}.ts": "" for i in range(20)}
    a = _analysis(spark, files)
    assert a.layers.folders == {"ui": ["components"], "application": ["services"]} and a.coverage.first().layered == 11
    assert [tuple(r) for r in a.unplaced.collect()] == [("src/misc", 20)]
    assert ("architecture/unlayered-code", None) in _ids(a, "architecture/unlayered-code")
    one = _analysis(spark, {"src/services/s.ts": ""})
    assert not one.layers.folders and one.findings_of("architecture/unlayered-code").where("title = 'No layers to hold imports against'").count() == 1
    counts = dict.fromkeys(ST.STATS, 0) | {"files": 31, "layeredFiles": 11}
    both = spark.createDataFrame([counts, counts | {"layeredFiles": 0}], ", ".join(f"{k} long" for k in ST.STATS))
    assert [r.architecture for r in A.scores(both, True).collect()] == [78, 100]  # 50 * (0.8 - 11 / 31) points are withheld


def test_dependency_rules(spark):
    files = {"a.ts": "import React from 'react';\n"}
    before = spark.createDataFrame([("react", "^17.0.0")], "package string, version string")
    a = _analysis(spark, files, dependencies={"react": "^18.2.0", "lodash": "1.0.0", "@types/node": "20"}, dev_dependencies={"lodash": "1.0.0"})
    a.base_packages = before
    got = {r.id: r for r in a.findings_of(*[r.id for r in R.RULES if r.category == "dependencies"]).collect()}
    assert json.loads(got["dependencies/unused-dependency"].current) == ["lodash"] and json.loads(got["dependencies/duplicate-dependency"].current) == ["lodash"]
    assert got["dependencies/major-version-change"].title == "react goes from major 17 to 18"
    assert got["dependencies/new-dependency"].detail == ["@types/node@20", "lodash@1.0.0"]
    report = Q.dependency_report(a)
    assert report == {"declared": 3, "imported": 1, "undeclared": [], "unused": ["lodash"], "implicit": 1}


def test_a_rule_that_fails_leaves_a_finding(spark, monkeypatch):
    def broken(a):
        raise ValueError("no")

    monkeypatch.setattr(R, "RULES", [R.Rule("complexity/large-file", "complexity", "", broken)])
    a = _analysis(spark, {"a.ts": ""})
    assert [(r.id, r.severity) for r in R.run_all(a).collect()] == [("internal/rule-error", "info")]


def test_order_and_numbers(shop):
    f = shop.findings
    ranked = [r.id for r in A.numbered(f).orderBy("number").collect()]
    assert ranked[0] == "architecture/circular-dependency" and ranked[1] == "architecture/layer-violation"
    assert [r.number for r in A.numbered(f).orderBy("number").collect()] == list(range(1, f.count() + 1))
    skip = f.where("id = 'architecture/layer-skip'")
    full = {r.fingerprint: r.number for r in A.numbered(f).collect()}
    assert [r.number for r in A.with_numbers(skip, f).collect()] == [full[skip.first().fingerprint]]
    assert [r.number for r in A.with_numbers(f, skip).orderBy("number").collect()] == list(range(1, f.count() + 1))
    assert [r.severity for r in A.sorted_findings(f).collect()][:2] == ["error", "error"]
    assert A.pick(A.numbered(f), 2).count() == 2


REPORT = {
    "src/app/page.ts": "import { load } from '../services/orders';\nexport default load;\n",
    "src/services/orders.ts": "import { client } from '../lib/db/client';\nimport Stripe from 'stripe';\nexport function load(a) {\n  if (a) {\n    return client;\n  }\n  return a;\n}\nexport function discount(a) {\n  if (a) {\n    return 1;\n  }\n  return 2;\n}\n",
    "src/lib/db/client.ts": "export const client = 1;\nexport const forgotten = 2;\n",
    "src/lib/old.ts": "export const nobody = 1;\n",
    "src/lib/named.ts": "export const byPath = 1;\n",
    "src/lib/barrel.ts": "export { kept } from './part';\n",
    "src/lib/part.ts": "export const kept = 1;\n",
    "src/lib/user.ts": "import { other } from './barrel';\nconst p = './lib/named.ts';\n",
    "tests/orders.test.ts": "import { load } from '../src/services/orders';\ntest('load', () => load(1));\n",
}


@pytest.fixture(scope="module")
def report(spark):
    return _analysis(spark, REPORT)


def test_impact(report):
    got = Q.impact(report, ["src/lib/db/client.ts"])
    assert [(r["path"], r["distance"], r["level"]) for r in got["impacted"]] == [("src/services/orders.ts", 1, "high"), ("src/app/page.ts", 2, "medium"), ("tests/orders.test.ts", 2, "medium")]
    assert got["tests"] == ["tests/orders.test.ts"] and got["routes"] == ["src/app/page.ts"] and got["risk"] == "medium" and not got["truncated"]
    assert Q.impact(report, ["src/app/page.ts"])["risk"] == "low"
    assert [Q.risk(12, 12, 0, 100), Q.risk(1, 1, 0, 3), Q.risk(5, 0, 0, 20)] == ["high", "low", "high"]


def test_dead_code(report):
    found, entries = Q.dead_code(report)
    got = {r.path: (r.confidence, r.reasons[0]) for r in found.collect()}
    assert got["src/lib/old.ts"] == ("medium", "nothing in the project imports it") and got["src/lib/part.ts"][1].startswith("only re-exported by src/lib/barrel.ts")
    assert "src/lib/named.ts" not in got and "src/lib/named.ts" in {r.path for r in entries.collect()}
    unused = {r.path: r.names for r in Q.unused_exports(report).collect()}
    assert unused["src/lib/db/client.ts"] == ["forgotten"] and unused["src/services/orders.ts"] == ["discount"]


def test_test_gaps(report):
    got = {r.path: (r.coverage, r.untested, r.reached_by) for r in Q.test_gaps(report).collect()}
    assert got["src/services/orders.ts"] == ("partial", ["discount"], ["tests/orders.test.ts"]) and got["src/lib/old.ts"][0] == "skipped"
    assert [r.path for r in Q.test_gaps(report, ["src/services/orders.ts"]).collect()] == ["src/services/orders.ts"]


def test_sidecar_tests(spark):
    logic = "export function pay(a) {\n  if (a) {\n    return 1;\n  }\n}\n"
    a = _analysis(spark, {"src/pay.ts": logic, "src/pay.test.ts": "pay()", "src/cart.ts": logic.replace("pay", "cart"), "src/__tests__/cart.unit.test.ts": "", "src/none.ts": logic.replace("pay", "none")})
    got = {r.path: (r.coverage, r.reason) for r in Q.test_gaps(a).collect()}
    assert got == {"src/pay.ts": ("covered", "1 function with logic"), "src/cart.ts": ("covered", "1 function with logic"), "src/none.ts": ("none", "1 function with logic")}


def test_map(report):
    got = Q.project_map(report)
    assert got["entryPoints"] == ["src/app/page.ts"] and got["external"][0]["name"] == "Stripe" and got["central"][0]["path"] == "src/services/orders.ts"
    assert got["startHere"][0] == "src/app/" and got["totals"]["files"] == len(REPORT)
    area = {x["path"]: x for x in got["areas"]}
    assert (area["src/lib"]["files"], area["src/lib"]["incoming"], area["src/services"]["outgoing"]) == (6, 1, 1)


def test_words(report, shop):
    issue = A.numbered(shop.findings).where("number = 1").first().asDict(recursive=True)
    assert W.related_files(issue, shop)[0] == ("lib/db/client.ts", "part of the same loop") and "↓" in W.flow(issue, shop)
    brief = W.issue_brief(issue, shop)
    assert "## Issue #1" in brief and "### Acceptance criteria" in brief and "### If this finding is wrong" in brief
    assert W.terms_in("many companies; a circular dependency in a layer") == ["circular dependency", "layer"] and W.terms_in("uses `any`") == ["any"]
    big = {"id": "complexity/large-file", "file": "a.ts", "baseline_num": 800.0, "current_num": 900.0}
    assert json.loads(W.dismissal(big)["snippet"]) == {"thresholds": {"maxFileLines": 900}} and "fixtures" in W.dismissal(big | {"file": "x/fixtures/a.ts"})["snippet"]
    assert [W.verdict({"total": 0, "critical": 0, "important": 0})[:7], W.listed(0), W.listed(9), W.location({"file": "a", "line": 3})] == ["Nothing", 3, 5, "a:3"]
    js = W.check_json(shop)
    assert js["counts"]["error"] == 2 and js["findings"][0]["number"] == 1 and all("line" not in f for f in js["findings"] if f["id"] == "architecture/circular-dependency")
    f = shop.spark.createDataFrame([("x", "src/services/orders.ts", 5), ("y", "src/services/orders.ts", 99)], "fingerprint string, file string, line int")
    assert [tuple(r) for r in W.enclosing_functions(f, report.functions).collect()] == [("x", "load()")]


def test_status_gate_and_drift():
    assert [Q.status(1, 0, 0, 0), Q.status(0, 0, 5, 0), Q.status(0, 1, 0, 0), Q.status(0, 0, 1, 0), Q.status(0, 0, 0, 2), Q.status(0, 9, 9, 0, False), Q.status(0, 0, 0, 0)] == ["degraded", "degraded", "needs-review", "needs-review", "needs-review", "healthy", "healthy"]
    assert Q.gate({"error": 1, "warning": 0}, 6)["reasons"] == ["1 error-level finding", "overall score dropped 6 points (limit 5)"]
    assert Q.gate({"error": 0, "warning": 2}, 0) == {"passed": True, "reasons": [], "exitCode": 0}
    assert Q.explain_drift(dict.fromkeys(Q.DRIFT_WORDS, 1), dict.fromkeys(Q.DRIFT_WORDS, 1) | {"cycles": 2, "anyUsages": 0}) == ["+1 circular dependency", "-1 `any` usage"]


def test_settings():
    s = S.resolve({"strictness": "strict", "ignore": ["!**/dist/**", "gen/**"], "rules": {"go/large-package": "off"}, "thresholds": {"maxParams": 9}})
    assert s.thresholds["maxParams"] == 9 and s.thresholds["maxFileLines"] == 400 and "**/dist/**" not in s.ignore and s.ignore[-1] == "gen/**" and s.rules["go/large-package"] == "off"
    assert S.base("relaxed").layer_policy == "downward" and S.did_you_mean("strictnes", ["strictness", "scope"]) == "strictness" and S.did_you_mean("zzz", ["scope"]) is None
    wrong = S.validate({"strictnes": 1, "rules": {"go/large-pakage": "off", "go/ignored-error": "loud"}, "ci": {"failOn": "info"}, "architecture": {"forbidden": [["a"]]}})
    assert len(wrong) == 5 and 'did you mean "strictness"' in wrong[0]
    assert S.fingerprint(S.base()) == S.fingerprint(S.resolve({"ci": {"failOn": "never"}})) != S.fingerprint(S.resolve({"thresholds": {"maxParams": 9}}))


def _git(root, *args):
    subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@example.org", *args], cwd=root, check=True, capture_output=True)


def test_commands_on_a_folder(spark, tmp_path):
    root = tmp_path / "shop"
    for path, text in (REPORT | {"node_modules/x/index.js": "skip", "dist/a.ts": "skip", "package.json": json.dumps({"name": "shop", "dependencies": {"stripe": "^1.0.0"}, "scripts": {"test": "vitest"}}), "tsconfig.json": '{ // note\n "compilerOptions": {"paths": {"~/*": ["./src/*"]}} }', ".gitignore": "secret\n"}).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    _git(root, "init", "-b", "main") if not (root / ".git").exists() else None
    _git(root, "add", "-A"), _git(root, "commit", "-m", "add orders because customers asked")
    p = open_project(spark, str(root))
    assert PR.scan(str(root), S.base())[0] == sorted(REPORT) and PR.aliases(str(root))[0] == PR.Alias("~/", ("src",))
    made = p.init()
    assert made["metrics"]["overall"] > 0 and (root / "STRUCTURE.md").exists() and p.baseline(record=False)["metrics"]["overall"] == made["metrics"]["overall"]
    _git(root, "add", "-A"), _git(root, "commit", "-m", "state")
    first = p.check()
    assert first["project"]["name"] == "shop" and first["project"]["packageManager"] == "npm" and not first["truncated"]
    (root / "src/lib/db/client.ts").write_text("import { load } from '../../services/orders';\nexport const client = load;\nexport const forgotten = 2;\n")
    review, said = p.review(scope=["src/services/**"])
    assert said["status"] == "degraded" and [f["id"] for f in said["newFindings"] if f["severity"] == "error"] and said["drift"]["architecture"] < 0
    assert said["scope"]["outOfScope"] == ["src/lib/db/client.ts"] or said["scope"] is not None
    assert "1. Open the loop src/lib/db/client.ts" in W.prompt(review, "compact") and not p.ci()["ci"]["passed"] and p.compare()[0]["id"] == 1
    out = p.verify()
    assert {r["outcome"] for r in out["issues"]} >= {"introduced"} and p.check()["counts"]["error"] >= 1
    assert "## Issue #1" in p.fix(1) and p.explain_issue(1)["related"]
    (root / "src/lib/db/client.ts").write_text(REPORT["src/lib/db/client.ts"])
    assert [r["outcome"] for r in p.verify(1)["issues"] if r["number"] == 1][:1] == ["resolved"]
    past = p.explain("src/services/orders.ts")
    assert past["evidence"] == "strong" and past["authors"][0]["commits"] == 1 and past["coChanged"]
    names = [c["name"] for c in p.doctor()]
    assert names[:3] == ["Runtime", "Project type", "Git"] and len(names) >= 10 and p.config()["rules"][0]["severity"] == "error" and len(p.config()["rules"]) == 36
    assert p.commands() == {"test": "npm run test", "typecheck": "npx tsc --noEmit"} and p.impact(["src/lib/db/client.ts"])["externals"] == []
    assert p.architecture()["coverage"]["total"] == 8 and p.dependencies()["unused"] == []


def test_packages_of_specifiers(spark):
    df = spark.createDataFrame([(x,) for x in ("./a", "/b", "@/c", "@s/p/q", "@s", "lodash/fp", "node:fs")], "raw string")
    assert [r[0] for r in df.select(resolve.package_of(F.col("raw"))).collect()] == [None, None, None, "@s/p", "@s", "lodash", "node:fs"]


def test_a_block_in_many_files_has_rows_of_bounded_size(spark, monkeypatch):
    from quern.operators import marks

    block = "\n".join(f"register(thing{i}, other{i});" for i in range(8))
    texts = [(f"f{i:03}", f"const own{i} = start({i});\n" * (i % 3 + 1) + block + ("\nextra(line, number, one);" if i < 40 else "")) for i in range(120)]
    whole = sorted(tuple(r) for r in R.duplicate_regions(spark.createDataFrame(texts, "path string, text string"), 6).select("n", "span", "files", "lines").collect())
    # all files hold eight lines, the first 40 nine, and both start where the file's own lines end
    assert [(n, span, len(files)) for n, span, files, _ in whole] == [(40, 6, 40), (120, 8, 120)]
    assert whole[1][2] == [p for p, _ in texts] and whole[1][3] == [i % 3 + 2 for i in range(120)]
    monkeypatch.setattr(marks, "MANY", 10)
    some = sorted(tuple(r) for r in R.duplicate_regions(spark.createDataFrame(texts, "path string, text string"), 6).select("n", "span", "files", "lines").collect())
    assert some == [(n, span, files[:10], lines[:10]) for n, span, files, lines in whole]


def test_marks_tell_sets_apart_whatever_their_order(spark):
    from quern.operators import marks

    sets = {"a": [1, 2, 3], "b": [3, 2, 1], "c": [1, 2, 4], "d": [1, 2, 3, 3], "e": [2, 3], "f": [1, 1, 2, 3]}
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "k string, x long").repartition(3)
    got = {r.k: tuple(r.m) for r in rows.groupBy("k").agg(marks.sums("x").alias("m")).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 5


def test_points_in_ranges_equal_brute_force(spark):
    import random

    from quern.operators.intervals import within

    rng = random.Random(5)
    ranges = [(rng.choice("ab"), i, x, x + rng.choice([0, 0, 1, 5, 63, 64, 1000, -3])) for i in range(200) for x in [rng.randrange(1500)]]
    points = [(rng.choice("abc"), rng.randrange(1600)) for _ in range(150)]
    p = spark.createDataFrame([*points, (None, 5), ("a", None)], "f string, at int")
    r = spark.createDataFrame([*ranges, (None, 999, 0, 9)], "f string, id int, x int, z int")
    assert sorted((t.f, t.at, t.id) for t in within(p, r, "f", "at", "x", "z").collect()) == sorted((f, at, i) for f, at in points for g, i, x, z in ranges if f == g and x <= at <= z)
    assert within(p, r.limit(0), "f", "at", "x", "z").count() == 0


def test_one_file_of_many_functions(spark):
    # 100,000 functions of three lines inside one of all lines: a finding meets two functions, not all
    f = spark.range(100_000).selectExpr("'a' as path", "cast(id + 1 as int) as ordinal", "concat('f', id) as name", "cast(id * 3 + 2 as int) as line", "cast(id * 3 + 4 as int) as end_line")
    f = f.unionByName(spark.createDataFrame([("a", 0, "all", 1, 300_002)], f.schema))
    found = spark.range(1000).selectExpr("cast(id as string) as fingerprint", "'a' as file", "cast(id * 300 + 3 as int) as line")
    got = W.enclosing_functions(found, f).collect()
    assert len(got) == 1000 and {r.function for r in got} == {"all()"}
    inner = W.enclosing_functions(found, f.where("name <> 'all'")).collect()
    assert {(r.fingerprint, r.function) for r in inner} == {(str(i), f"f{i * 100}()") for i in range(1000)}


def test_walks_from_many_clients_over_a_hub(spark):
    # 2,000 clients import a hub that leads to 50 modules, two of which read secrets; chains exist for hits alone
    from quern.operators import boundary, graph

    starts = spark.range(2000).selectExpr("concat('c', id) as client")
    pairs = [("hub", f"m{i}", i + 1) for i in range(50)] + [(f"m{i}", "deep", 1) for i in (7, 3, 9)] + [("deep", "s2", 1), ("m5", "s1", 1), ("s1", "beyond", 1)]
    steps = starts.selectExpr("client as src", "'hub' as dst", "1 as line").union(spark.createDataFrame(pairs, "src string, dst string, line int"))
    ends = spark.createDataFrame([("s1",), ("s2",)], "node string")
    known = graph.cut(boundary.walks(starts, steps, ends))
    assert known.where("node = 'beyond'").isEmpty() and known.count() == 2000 * (1 + 1 + 50 + 2 + 1)
    got = {r.node: (r.n, r.chains) for r in boundary.chains(known.select("client", "node").join(ends, "node", "left_semi"), known).groupBy("node").agg(F.count("*").alias("n"), F.collect_set(F.array_join(F.slice("chain", 2, 9), " ")).alias("chains")).collect()}
    assert got == {"s1": (2000, ["hub m5 s1"]), "s2": (2000, ["hub m3 deep s2"])}


def test_clients_walk_along_imports_that_lead_to_a_hit(spark, monkeypatch):
    from quern.operators import boundary

    monkeypatch.setattr(boundary, "MAX_VISITS", 8)
    # near: a secret one step away; far: behind two; wide: behind a hub of ten, so its visits end first; idle: a long chain without one
    pairs = [("near", "s", 2), ("near", "b", 1), ("far", "a", 2), ("far", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "s", 1), ("s", "near", 1), ("wide", "hub", 1), ("hub", "c", 99)]
    pairs += [("hub", f"h{i}", i) for i in range(10)] + [("idle", "i0", 1)] + [(f"i{i}", f"i{i + 1}", 1) for i in range(12)]
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    files = spark.createDataFrame([(n, [("S_TOKEN", 7)] if n == "s" else [], [], False, n in ("near", "far", "wide", "idle"), False) for n in names], "path string, env_reads array<struct<name:string,line:int>>, server_only array<string>, use_server boolean, use_client boolean, is_test boolean")
    edges = spark.createDataFrame([(*p, False) for p in pairs], "src string, dst string, line int, type_only boolean")
    walked, walks = [], boundary.walks
    monkeypatch.setattr(boundary, "walks", lambda starts, steps, ends, most: walked.append((sorted(r.client for r in starts.collect()), steps.count())) or walks(starts, steps, ends, most))
    got = {(r.client, r.target, " ".join(r.chain), r.line) for r in boundary.client_leaks(files, edges).collect()}
    # a step of the whole walk ends with the visits before it: wide has met 12 modules before it asks c
    assert got == {("near", "s", "near s", 7), ("far", "s", "far b c s", 7)}
    # nine imports lead to s; those behind other modules are walked to again
    assert walked == [(["far", "idle", "near", "wide"], 9), (["far", "wide"], len(pairs))]


def test_indexed_patterns_equal_asking_each(spark):
    from quern.functions import globs
    from quern.operators import patterns

    paths = ["src/a/x.ts", "src/a/b/y.ts", "lib/x.ts", "x.ts", "src/db", "src/db/q.ts", "db/q.ts", "source/db/q.ts", "dbx/q.ts", "src/b.c/z.ts", "b+c/z.ts"]
    given = ["src/a/**", "**/x.ts", "x.ts", "db", "src/db", "*.ts", "src/*/y.ts", "{src,lib}/x.ts", "src/{a/b,db}/*.ts", "b?c/**", "./src/a/", "**", "src/b.c/z.ts"]
    pairs = [(x, y) for x in given for y in given]
    edges = [(x, y, 1) for x in paths for y in paths]
    got = {(r.src, r.dst, r.pair) for r in patterns.forbidden_edges(spark.createDataFrame(edges, "src string, dst string, line int"), pairs).collect()}
    spelled = lambda path, glob: any(globs.admits(path, [g]) for g in globs.project_globs(glob))
    assert got == {(x, y, f"{a} -> {b}") for x, y, _ in edges for a, b in pairs if spelled(x, a) and spelled(y, b)}


def test_an_import_is_a_row_for_what_it_spells_and_finds_the_first_file(spark):
    # every file that ./x could mean, in the order that is tried
    for base, said in (("src/x", "./x"), ("src/x.js", "./x.js")):
        bare = base.removesuffix(".js")
        order = [base, *(base + e for e in resolve.EXTENSIONS), *(f"{base}/index{e}" for e in resolve.EXTENSIONS), *([bare + e for e in resolve.EXTENSIONS] if bare != base else [])]
        order = list(dict.fromkeys(order))
        for first in (0, 1, 2, 8, 9, len(order) - 1):
            a = _analysis(spark, {p: "" for p in order[first:]} | {"src/main.ts": f"import {{ x }} from '{said}';\n"})
            assert [(r.path, r.target) for r in a.resolved.collect()] == [("src/main.ts", order[first])]
    files = {f"src/f{i}.ts": f"import './f{i + 1}';\nimport p from 'pkg';\nimport '../gone';\n" for i in range(20)}
    rows = []
    resolve.build_graph(_analysis(spark, files).files, PR.ProjectInfo(source_roots=("src",)), lambda df: rows.append(df) or df)
    plan = rows[0]._jdf.queryExecution().optimizedPlan().toString()
    # candidates are never dealt out: the extensions stand in no generated rows of imports
    assert "explode" in plan and "posexplode(flatten" not in plan and rows[0].count() == 60
    # an import and its file in one table: 19 found, packages and lost ones without target
    assert rows[0].where("target is not null").count() == 19


def test_paths_and_blocks_need_no_parse(spark, monkeypatch):
    def never(*_):
        raise AssertionError("parsed")

    from quern.plans import project_queries

    monkeypatch.setattr(project_queries.A, "from_texts", never)
    monkeypatch.setattr(project_queries, "_KEPT", {})
    d = "/root/testdata/sf0.001"
    assert project_queries.project_paths(spark, d).where("first = 'services' and area = 'src/services'").count() == spark.read.parquet(f"{d}/orders.parquet").count()
    assert project_queries.project_duplicate_blocks(spark, d).count() > 0


def test_without_dynamic_imports_nothing_is_resolved_for_dead_code(spark, monkeypatch):
    from quern.operators import resolve
    from quern.plans import analysis, reports_project

    texts = lambda more: spark.createDataFrame([("src/a.ts", "import { b } from './b';\nconst r = 'src/named.ts';\n"), ("src/b.ts", "export const b = 1;\n"), ("src/named.ts", "export const n = 1;\n"), *more], "path string, text string")
    a = analysis.from_texts(spark, texts([]))
    a.edges
    asked, tables = [], resolve.tables
    monkeypatch.setattr(resolve, "tables", lambda *more: asked.append(more[0]) or tables(*more))
    assert reports_project.dynamic_gaps(a).isEmpty() and not asked
    assert {r.path for r in reports_project.named_in_source(a).collect()} == {"src/named.ts"}
    b = analysis.from_texts(spark, texts([("src/c.ts", "import(x);\nimport('./b');\n"), ("src/d.ts", "import('./b');\n")]))
    assert {r.path for r in reports_project.dynamic_gaps(b).collect()} == {"src/c.ts"} and asked == [("resolved",)]
