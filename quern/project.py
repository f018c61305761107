"""The commands of a project as functions: each returns tables or plain values, and writes only where its name says so."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import layers
from quern.plans import analysis as A
from quern.plans import findings as R
from quern.plans import reports_project as Q
from quern.plans import settings as S
from quern.plans import words as W
from quern.sources import git
from quern.sources.project import commands, scan, skipped_samples
from quern.sources.state import State
from quern.streaming import watch as T


@dataclass
class Project:
    """A folder under analysis; while its files and settings stay the same, commands share one analysis."""

    spark: SparkSession
    root: str
    _kept: tuple | None = None

    @property
    def state(self) -> State:
        return State(self.spark, self.root)

    def analyze(self, changes: git.Changes | None = None, settings: S.Settings | None = None, progress: Callable[[str], None] = lambda s: None) -> A.Analysis:
        settings = settings or S.load(self.root)
        state = self._signature(settings), changes and changes.base
        if self._kept is None or self._kept[0] != state:
            self._kept = state, A.analyze(self.spark, self.root, settings, changes=changes, progress=progress)
        return self._kept[1]

    def _signature(self, settings: S.Settings) -> tuple:
        """Times and sizes of the sources and of the files that say what the project is."""
        paths, _ = scan(self.root, settings)
        said = [*paths, "package.json", "tsconfig.json", "go.mod", "requirements.txt", "pyproject.toml"]
        found = [os.path.join(self.root, p) for p in said]
        return S.fingerprint(settings), tuple((p, os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in found if os.path.exists(p))

    def init(self, strictness: str = "balanced", force: bool = False) -> dict:
        """Write settings with the layers found, a baseline and the briefing; settings that are there stay."""
        a = self.analyze(settings=S.base(strictness))
        path = S.find(self.root)
        if path is None or force:
            path = S.write(self.root, {"strictness": strictness, "architecture": {"layers": a.layers.folders} if a.layers.usable else {}})
        a = self.analyze()
        self._record(a)
        return {"config": path, "agentFile": W.write_agent_file(a, force)[0], "metrics": a.metrics.first().asDict(), "skipped": skipped_samples(self.root, a.settings)}

    def _record(self, a: A.Analysis) -> None:
        self.state.write_baseline(self.state.build_baseline(a.metrics, a.stats, a.settings), a.findings, A.file_metrics(a.files))

    def check(self) -> dict:
        """The findings, counts and scores, kept as the last run."""
        began = time.time()
        a = self.analyze()
        self.state.write_snapshot("check", A.numbered(a.findings))
        return W.check_json(a, elapsed_ms=int(1000 * (time.time() - began)))

    def _issue(self, number: int) -> tuple[A.Analysis, dict | None]:
        """The current finding that had a number in the last run."""
        a = self.analyze()
        asked = self.state.snapshot().where(F.col("number") == number).select("fingerprint")
        hit = A.numbered(a.findings).join(asked, "fingerprint", "left_semi").drop("number").limit(1).collect()
        return a, hit[0].asDict(recursive=True) | {"number": number} if hit else None

    def explain_issue(self, number: int) -> dict | None:
        """One issue with its guidance, related files, flow and how to dismiss it."""
        a, issue = self._issue(number)
        if issue is None:
            return None
        return {"issue": issue, "location": W.location(issue), "guidance": W.guidance(issue), "related": W.related_files(issue, a), "flow": W.flow(issue, a), "dismissal": None if issue["id"] in W.NEVER_DISMISSED else W.dismissal(issue)}

    def explain(self, path: str) -> dict:
        return Q.explain_file(self.analyze(), path)

    def fix(self, number: int) -> str | None:
        a, issue = self._issue(number)
        return issue and W.issue_brief(issue, a)

    def verify(self, number: int | None = None) -> dict:
        """What became of the last run's issues; the exit code says whether the asked one is gone."""
        before = self.state.snapshot()
        rows = [r.asDict() for r in before.collect()]  # an issue list: read before the run overwrites it
        if not rows:
            raise LookupError("no earlier run to compare with; run check first")
        if number is not None and all(r["number"] != number for r in rows):
            raise LookupError(f"the last run has no issue {number}")
        a = self.analyze()
        current = A.numbered(a.findings)
        out = [r.asDict() for r in Q.verify(self.spark.createDataFrame(rows, before.schema), current, number).orderBy("number").collect()]
        self.state.write_snapshot("check", current)
        left = sum(r["outcome"] == "remaining" for r in out)
        return {"issues": out, "metrics": a.metrics.first().asDict(), "exitCode": int(number is not None and left > 0)}

    def prompt(self, style: str = "full", everything: bool = False, most: int | None = None) -> str:
        return W.prompt(self.review()[0], style, most, everything)

    def agent(self, force: bool = False) -> tuple[str, bool]:
        return W.write_agent_file(self.analyze(), force)

    def review(self, base: str | None = None, scope: list[str] | None = None) -> tuple[Q.Review, dict]:
        """The change against the baseline, with its contract; remembered in the history."""
        changes = git.detect_changes(self.spark, self.root, base)
        r = Q.review(self.analyze(changes), self.state, changes, scope)
        said = W.review_json(r)
        counts = said["counts"]
        self.state.append_history({"at": _now(), "kind": "review", "commit": git.head_commit(self.root), "branch": git.current_branch(self.root), "status": r.status, "baseline_overall": r.baseline and r.baseline["metrics"]["overall"], "errors": counts["error"], "warnings": counts["warning"], "infos": counts["info"], "note": None} | said["metrics"])
        return r, said

    def watch(self, stream: DataFrame, checkpoint: str, **options) -> tuple[T.Session, object]:
        """Follow a stream of changed paths."""
        from quern.sources.project import read_texts

        session = T.Session.start(self.analyze())
        return session, T.watch(stream, session, lambda paths: read_texts(self.spark, self.root, paths), checkpoint, **options)

    def baseline(self, record: bool = True) -> dict | None:
        """Record a baseline, or show the one there is."""
        if record:
            self._record(self.analyze())
        row = self.state.baseline()[0].first()
        return row and row.asDict(recursive=True)

    def compare(self, last: int = 10) -> list[dict]:
        """The last reviews, each with how its overall score moved."""
        rows = [r.asDict() for r in self.state.history(last).collect()]
        for old, new in zip([None, *rows], rows):
            d = 0 if old is None else new["overall"] - old["overall"]
            new["trend"] = "first" if old is None else "up" if d > 0 else "down" if d < 0 else "flat"
        return rows

    def map(self) -> dict:
        return Q.project_map(self.analyze())

    def impact(self, changed: list[str] | None = None) -> dict:
        """What the named files, or the present change, can reach."""
        changes = None if changed else git.detect_changes(self.spark, self.root)
        return Q.impact(self.analyze(), changed or Q.changed_paths(changes) or [])

    def dead_code(self, include_tests: bool = False, min_confidence: str = "low") -> dict[str, DataFrame]:
        a = self.analyze()
        found, entries = Q.dead_code(a, include_tests, min_confidence)
        return {"candidates": found, "unusedExports": Q.unused_exports(a), "entryPoints": entries}

    def tests(self, changed_only: bool = False) -> DataFrame:
        only = Q.changed_paths(git.detect_changes(self.spark, self.root)) if changed_only else None
        return Q.test_gaps(self.analyze(), only)

    def architecture(self) -> dict:
        a = self.analyze()
        return {"layers": a.layers.folders, "files": Q.files_by_layer(a), "coverage": a.coverage.first().asDict(), "unplaced": a.unplaced, "violations": Q.layer_pairs(a), "cycles": a.cycles, "leaks": a.leaks}

    def dependencies(self) -> dict:
        return Q.dependency_report(self.analyze())

    def ci(self, base: str | None = None, fail_on: str | None = None, max_drop: int | None = None, everything: bool = False) -> dict:
        """Whether a build passes."""
        r, said = self.review(base)
        own = r.analysis.settings.ci
        new_only = not everything and own["newFindingsOnly"] and r.baseline is not None
        counts = A.severity_counts(r.new if new_only else r.findings).first().asDict()
        drop = -(r.drift or {}).get("overall", 0)
        verdict = Q.gate(counts, drop, fail_on or own["failOn"], own["maxOverallDrop"] if max_drop is None else max_drop)
        return said | {"ci": verdict | {"newFindingsOnly": new_only, "truncated": r.analysis.truncated}}

    def config(self) -> dict:
        """The settings as resolved, what is wrong with them, and the rules."""
        s = S.load(self.root)
        return {"settings": S.as_dict(s), "fingerprint": S.fingerprint(s), "warnings": list(s.warnings), "rules": [{"id": r.id, "category": r.category, "severity": R.severity_of(r.id, s.rules), "description": r.description} for r in R.RULES]}

    def doctor(self) -> list[dict]:
        began = time.time()
        a = self.analyze()
        return Q.doctor(a, self.state, int(1000 * (time.time() - began)))

    def commands(self) -> dict[str, str]:
        return commands(self.analyze().info)

    def dead_patterns(self) -> list[str]:
        a = self.analyze()
        return layers.dead_patterns(a.settings, a.files, a.layers)


def _now() -> str:
    from quern.sources.state import now

    return now()


def open_project(spark: SparkSession, root: str) -> Project:
    return Project(spark, os.path.abspath(root))
