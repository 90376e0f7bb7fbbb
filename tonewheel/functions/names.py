"""File-name facts as column expressions: tokens, classes, recording keys, paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed once per row, whatever reads them later.

    Plain projections are merged, and long name parsing then repeats inside every expression that
    uses it until the generated code no longer compiles. A one-row generator keeps them apart.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix."""
    base = basename(path)
    kept = F.length(base) - F.length(F.substring_index(base, ".", -1)) - 1
    return F.when(kept > 0, F.substring(base, F.lit(1), kept)).otherwise(base)


def last_parts(path: Column, n: int) -> Column:
    return F.substring_index(path, "/", -n)


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def tokens(name: Column) -> Column:
    return F.split(name, "_")


def token(parts: Column, i: int) -> Column:
    """Token ``i`` from 0, NULL past the end."""
    return F.get(parts, F.lit(i))


def tail(parts: Column, start: int) -> Column:
    """Tokens from ``start`` on, joined again."""
    return F.array_join(F.slice(parts, start + 1, F.greatest(F.size(parts) - start, F.lit(0))), "_")


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def layout_sections_by_id(name: Column, dataset: str = "dcase20") -> dict[str, Column]:
    """``<status>_id_<sec>_...``: one domain, no attributes."""
    t = tokens(stem(name))
    return {
        "sec": token(t, 2).try_cast("int"),
        "domain": F.lit(0),
        "status": flag(token(t, 0) == "anomaly"),
        "attri": F.lit(f"noAttribute_{dataset}"),
    }


def _positional(name: Column) -> tuple[Column, dict[str, Column]]:
    t = tokens(stem(name))
    return t, {
        "sec": token(t, 1).try_cast("int"),
        "domain": flag(token(t, 2) == "target"),
        "status": flag(token(t, 4) == "anomaly"),
    }


def layout_optional_attributes(name: Column, dataset: str = "dcase21") -> dict[str, Column]:
    """``section_<sec>_<domain>_<split>_<status>_<n>[_attributes]``."""
    t, facts = _positional(name)
    text = F.when(F.size(t) > 6, tail(t, 6)).otherwise("noAttribute")
    return facts | {"attri": F.concat(text, F.lit(f"_{dataset}"))}


def layout_attributes(name: Column, dataset: str) -> dict[str, Column]:
    """As above, with the attribute text always taken, also if empty."""
    t, facts = _positional(name)
    return facts | {"attri": F.concat(tail(t, 6), F.lit(f"_{dataset}"))}


def layout_by_membership(name: Column, dataset: str = "dcase25") -> dict[str, Column]:
    """Domain and status by the presence of a token, wherever it stands."""
    t = tokens(stem(name))
    return {
        "sec": token(t, 1).try_cast("int"),
        "domain": flag(F.array_contains(t, "target")),
        "status": flag(F.array_contains(t, "anomaly")),
        "attri": F.concat(F.when(F.size(t) > 6, tail(t, 6)).otherwise("noAttribute"), F.lit(f"_{dataset}")),
    }


# Pattern of supplementary file names.
SUPPLEMENTARY = r"^section_\d+_(\D*)_\d+(.*).wav"


def layout_supplementary(name: Column, dataset: str = "dcase25") -> dict[str, Column]:
    base = basename(name)
    fits = F.rlike(base, F.lit(SUPPLEMENTARY))
    rest = F.regexp_replace(F.regexp_extract(base, SUPPLEMENTARY, 2), "^_+", "")
    return {
        "type": F.when(fits, F.regexp_extract(base, SUPPLEMENTARY, 1)),
        "sec": F.lit(0),
        "attri": F.when(fits, F.concat(rest, F.lit(f"_sup_{dataset}"))),
    }


def yearly_layout(dataset: str, name: Column) -> dict[str, Column]:
    if dataset == "dcase20":
        return layout_sections_by_id(name, dataset)
    if dataset == "dcase21":
        return layout_optional_attributes(name, dataset)
    if dataset == "dcase25":
        return layout_by_membership(name, dataset)
    return layout_attributes(name, dataset)


def layout_compressed_air(rel: Column) -> dict[str, Column]:
    """``<leak>/<noise>/<session>/<x>_<state>_<knob>_<mic>_..``; the last token numbers the segment."""
    parts = F.split(rel, "/")
    base = basename(rel)
    t = tokens(base)
    leak, status = token(parts, 0), F.when(token(t, 1) == "niO", "leak").otherwise("noleak")
    whole = F.concat(F.regexp_replace(base, "_[^_]*$", ""), F.lit("."), F.substring_index(base, ".", -1))
    return {
        "leak": leak,
        "noise": token(parts, 1),
        "session": token(parts, 2),
        "knob": token(t, 2),
        "mic": token(t, 3),
        "status": status,
        "scene": F.concat_ws("_", leak, status),
        "ori": F.concat_ws("/", token(parts, 0), token(parts, 1), token(parts, 2), whole),
    }


def layout_engine(rel: Column) -> dict[str, Column]:
    """``<sett>_cut/<n>_<class>/file``; other top directories are not part of the set."""
    parts = F.split(rel, "/")
    return {
        "sett": token(tokens(token(parts, 0)), 0),
        "scene": token(tokens(token(parts, 1)), 1),
        "used": F.contains(token(parts, 0), F.lit("cut")),
    }


def first_prefix(name: Column, classes: Sequence[str]) -> Column:
    """First class of the list the name starts with; NULL if none."""
    return F.coalesce(*[F.when(F.startswith(name, F.lit(c)), F.lit(c)) for c in classes])


def first_substring(name: Column, classes: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(name, F.lit(c)), F.lit(c)) for c in classes])


def status_of(scene: Column, healthy: str) -> Column:
    return F.when(scene == healthy, "normal").when(scene.isNotNull(), "anomaly")


def recording_key(name: Column, drop: int, suffix: str = "") -> Column:
    """Name without its last ``drop`` tokens: the recording a segment was cut from."""
    key = F.regexp_replace(name, "(^|_)[^_]*" + "_[^_]*" * (drop - 1) + "$", "") if drop else name
    return F.concat(key, F.lit(suffix)) if suffix else key


def duration(frames: Column, rate: Column, decimals: int | None = None) -> Column:
    d = frames / F.nullif(rate.cast("double"), F.lit(0.0))
    return d if decimals is None else F.bround(d, decimals)


def all_equal(conditions: Mapping[str, object]) -> Column:
    """Conjunction of ``column = value``; no conditions keep every row."""
    return reduce(and_, [F.col(k) == F.lit(v) for k, v in conditions.items()], F.lit(True))


def path_holds(path: Column, parts: Sequence[str]) -> Column:
    """All substrings occur, and the folder of the file is a train or test folder."""
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return reduce(and_, [F.contains(path, F.lit(p)) for p in parts], folder.isin("train", "test"))


def kept_names(path: Column, suffixes: Sequence[str], without: Sequence[str] = ()) -> Column:
    base = basename(path)
    ends = reduce(lambda a, b: a | b, [F.endswith(base, F.lit(s)) for s in suffixes])
    return reduce(and_, [~F.contains(base, F.lit(w)) for w in without], ends)


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def from_bytes(data: Column) -> Column:
    """UTF-8 text without the zero padding around it."""
    return F.regexp_replace(F.decode(data, "UTF-8"), "^\x00+|\x00+$", "")
