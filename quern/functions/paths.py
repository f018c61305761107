"""Path functions as columns: directories, names, extensions, segments, areas, routes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.globs import WRAPPERS


def _col(path) -> Column:
    return F.col(path) if isinstance(path, str) else path


def directory(path) -> Column:
    """What comes before the last slash; empty for a bare name."""
    return F.regexp_replace(_col(path), "/?[^/]*$", "")


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path) -> Column:
    """The last dot of the name and what follows; a name that only starts with a dot has none."""
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def posix(path) -> Column:
    return F.translate(_col(path), "\\", "/")


def segments(path) -> Column:
    return F.filter(F.split(_col(path), "/"), lambda s: s != "")


def meaningful_segments(path) -> Column:
    """Segments without a wrapper folder in front."""
    parts = segments(path)
    return F.when(F.get(parts, F.lit(0)).isin(*WRAPPERS), F.slice(parts, 2, 1 << 20)).otherwise(parts)


def meaningful_path(path) -> Column:
    return F.array_join(meaningful_segments(path), "/")


def joined(base: Column, relative: Column) -> Column:
    """``relative`` from the folder ``base``, without . and .. segments; .. above the root stay."""
    whole = F.concat_ws("/", F.when(base != "", base), relative)

    def step(so_far: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(so_far) > 0) & (F.element_at(so_far, -1) != "..")
        return F.when((part == "") | (part == "."), so_far).when(up, F.slice(so_far, 1, F.greatest(F.size(so_far) - 1, F.lit(0)))).otherwise(F.array_append(so_far, part))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(parts, "/"), F.when(relative.endswith("/"), "/").otherwise(""))


def area(path) -> Column:
    """The folder a file counts for: its first segment, or two below src, lib or packages; a dot at the root."""
    parts = segments(directory(path))
    depth = F.when(F.get(parts, F.lit(0)).isin("src", "lib", "packages"), 2).otherwise(1)
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), depth), "/"))


def two_segment_area(path) -> Column:
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/")).otherwise(".")


def is_route(path) -> Column:
    return base_name(path).rlike(r"^(page|route|layout|index)\.[cm]?[jt]sx?$") | _col(path).rlike("(^|/)(routes|pages|views|screens)/")


def route_label(path) -> Column:
    """The address a routed file serves: its folder without the router's root and (groups)."""
    cut = F.regexp_replace(directory(path), r"^(src/)?(app|pages|routes)/?", "")
    cut = F.regexp_replace(F.regexp_replace(cut, r"/?\([^/]*\)", ""), "^/+", "")
    return F.concat(F.lit("/"), F.regexp_replace(cut, "/$", ""))
