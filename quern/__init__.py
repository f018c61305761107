"""Code-health analytics and corpus preparation on Spark.

>>> from quern import open_project
>>> open_project(spark, "/path").check()

Names load on first use, so that a worker that needs one module loads only that.
"""

import importlib

_WHERE = {
    "Analysis": "quern.plans.analysis",
    "analyze": "quern.plans.analysis",
    "from_texts": "quern.plans.analysis",
    "RULES": "quern.plans.findings",
    "by_id": "quern.plans.findings",
    "SEVERITIES": "quern.plans.settings",
    "Settings": "quern.plans.settings",
    "define": "quern.plans.settings",
    "load": "quern.plans.settings",
    "resolve": "quern.plans.settings",
    "Project": "quern.project",
    "open_project": "quern.project",
}
__all__ = ["known_rules", *_WHERE]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(_WHERE[name]), name)


def known_rules() -> list[str]:
    """Ids of all rules."""
    from quern.plans.settings import SEVERITIES

    return list(SEVERITIES)
