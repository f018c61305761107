"""The layer model of a project, and the layer, feature and relation of its files as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import globs
from quern.functions import paths as P
from quern.plans.settings import Settings

# Folder names that stand for a layer, folders that hold features, shares.
CONVENTIONAL = {
    "ui": ["app", "pages", "components", "views", "screens", "ui", "widgets", "templates"],
    "application": ["services", "application", "usecases", "use-cases", "actions", "controllers", "handlers", "api"],
    "domain": ["domain", "entities", "models", "core", "business"],
    "infrastructure": ["infrastructure", "infra", "repositories", "adapters", "db", "database", "data", "persistence", "clients"],
}
FEATURE_ROOTS = ("features", "modules", "domains", "packages")
NEEDED = 2
TARGET = 0.8


@dataclass(frozen=True)
class Layers:
    """Layers from top to bottom with their folders; ``inferred`` where the settings name none."""

    folders: dict[str, list[str]]
    policy: str = "adjacent"
    inferred: bool = True
    feature_root: str | None = None

    @property
    def order(self) -> list[str]:
        return list(self.folders)

    @property
    def usable(self) -> bool:
        return len(self.folders) >= NEEDED

    @property
    def chain(self) -> str:
        return " -> ".join(self.order) or "no layers detected"

    def after(self, layer: str) -> str:
        i = self.order.index(layer) + 1
        return self.order[i] if i < len(self.order) else "the next layer"


def infer(files: DataFrame, policy: str = "adjacent") -> Layers:
    """Layers by conventional folder names among the first two segments; fewer than two are none.

    What reaches the driver are conventional names only, a few dozen at any size.
    """
    parts = P.meaningful_segments("path")
    front = F.slice(parts, F.lit(1), F.lit(2))
    which = lambda names: F.get(F.filter(front, lambda x: x.isin(*names)), F.lit(0))
    found = reduce(lambda so_far, kv: so_far.when(which(kv[1]).isNotNull(), F.concat(F.lit(kv[0] + "/"), which(kv[1]))), CONVENTIONAL.items(), F.when(F.lit(False), F.lit("")))
    root = F.get(parts, F.lit(0))
    rows = files.select(found.alias("found"), F.when(root.isin(*FEATURE_ROOTS), root).alias("root")).distinct().collect()
    roots = {r.root for r in rows}
    named = sorted({tuple(r.found.split("/", 1)) for r in rows if r.found})
    folders = {layer: [d for x, d in named if x == layer] for layer in CONVENTIONAL if any(x == layer for x, _ in named)}
    return Layers(folders if len(folders) >= NEEDED else {}, policy, True, next((r for r in FEATURE_ROOTS if r in roots), None))


def model(settings: Settings, files: DataFrame) -> Layers:
    """The layers that the settings name, or inferred ones."""
    if settings.layers:
        return Layers(dict(settings.layers), settings.layer_policy, False, settings.feature_root)
    got = infer(files, settings.layer_policy)
    return Layers(got.folders, got.policy, True, settings.feature_root or got.feature_root)


def claims(path: Column | str, folder: str) -> Column:
    """Whether a layer's folder holds the file, spelled with or without a wrapper folder."""
    path = F.col(path) if isinstance(path, str) else path
    if "*" in folder:
        return globs.matches(path, [folder])
    regex = _claim(folder)
    return path.rlike(regex) if regex else F.lit(False)


_WRAPPED = f"^/*(?:(?:{'|'.join(globs.WRAPPERS)})/+)?"


def _claim(folder: str) -> str | None:
    """A regex for the paths in a folder: a single name counts among the first two segments, a longer path at the front."""
    own = [re.escape(p) for p in folder.split("/") if p]
    own = own[1:] if own and own[0] in globs.WRAPPERS else own
    if not own:
        return None
    return _WRAPPED + ("(?:[^/]+/+)?" if len(own) == 1 else "") + "/+".join(own) + "(?:/|$)"


def layer_of(path: Column | str, m: Layers) -> Column:
    """The layer of a file: routes of an API first, then the first layer with a folder that holds it; null outside."""
    path = F.col(path) if isinstance(path, str) else path
    api = next((x for x, dirs in m.folders.items() if "api" in dirs), m.order[1] if len(m.order) > 1 else m.order[0] if m.order else None)
    out = F.when(path.rlike(_WRAPPED + "(app|pages)/+api/") & F.lit(api is not None), F.lit(api))
    for layer, dirs in m.folders.items():
        # a layer's plain folders are one expression
        plain = [r for r in (_claim(d) for d in dirs if "*" not in d) if r]
        if plain:
            out = out.when(path.rlike("|".join(plain)), F.lit(layer))
        for d in dirs:
            if "*" in d:
                out = out.when(claims(path, d), F.lit(layer))
    return out


def relation(a: Column, b: Column, m: Layers) -> Column:
    """same, ok, inverted, skip or unknown, from the layers of an import's two ends."""
    if not m.order:
        return F.lit("unknown")
    rank = F.create_map(*[x for i, layer in enumerate(m.order) for x in (F.lit(layer), F.lit(i))])
    i, j = F.try_element_at(rank, a), F.try_element_at(rank, b)
    skip = (j - i > 1) & F.lit(m.policy == "adjacent")
    return F.when(i.isNull() | j.isNull(), "unknown").when(a == b, "same").when(j < i, "inverted").when(skip, "skip").otherwise("ok")


def feature_of(path: Column | str, m: Layers) -> Column:
    """The feature a file belongs to, below the folder of features."""
    path = F.col(path) if isinstance(path, str) else path
    if not m.feature_root:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(path, _WRAPPED + re.escape(m.feature_root) + "/+([^/]+)", 1), F.lit(""))


def unplaced_label(path: Column | str) -> Column:
    """The folder a file outside the model would be declared under: two segments below the wrapper."""
    parts, own = P.segments(path), P.meaningful_segments(path)
    prefix = F.when(F.size(parts) > F.size(own), F.concat(F.get(parts, F.lit(0)), F.lit("/"))).otherwise("")
    deep = F.concat(prefix, F.array_join(F.slice(own, F.lit(1), F.least(F.lit(2), F.size(own) - 1)), "/"))
    shallow = F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit("")), F.lit("."))
    return F.when(F.size(parts) <= 1, ".").when(F.size(own) <= 1, shallow).otherwise(deep)


def coverage(files: DataFrame, m: Layers) -> DataFrame:
    """One row: applicable, layered, total, share of the files that are no tests."""
    inside = layer_of("path", m).isNotNull() if m.usable else F.lit(False)
    row = files.where("not is_test").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(inside, 1)).alias("layered"))
    applicable = F.lit(m.usable) & (F.col("total") > 0)
    return row.select(applicable.alias("applicable"), F.when(applicable, F.col("layered")).otherwise(0).alias("layered"), "total", F.when(applicable, F.col("layered") / F.nullif("total", F.lit(0))).otherwise(1.0).alias("share"))


def unplaced(files: DataFrame, m: Layers) -> DataFrame:
    """(directory, files) outside every layer, most first."""
    outside = files.where(~F.col("is_test") & (layer_of("path", m).isNull() if m.usable else F.lit(False)))
    return outside.groupBy(unplaced_label("path").alias("directory")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "directory")


def dead_patterns(settings: Settings, files: DataFrame, m: Layers) -> list[str]:
    """Folders and patterns of the settings that match no file, in words; one pass over the paths."""
    asked = [(f'architecture.layers.{layer}: "{d}" matches no file, so that layer is smaller than declared.', claims("path", d)) for layer, dirs in settings.layers.items() for d in dirs] if not m.inferred else []
    for pair in settings.forbidden:
        asked += [(f'architecture.forbidden: the {side} pattern "{g}" matches no file, so the rule never fires.', globs.matches_project("path", g)) for side, g in zip(("from", "to"), pair)]
    if not asked:
        return []
    row = files.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"c{i}") for i, (_, c) in enumerate(asked)]).first()
    return [said for i, (said, _) in enumerate(asked) if row.n and not row[f"c{i}"]]
