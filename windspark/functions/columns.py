"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def case_id(path: Column, root: str = "") -> Column:
    """Path relative to ``root`` without extension, separators as double underscores."""
    rel = F.regexp_replace(path, r"\\", "/")
    if root:
        rel = F.when(F.startswith(rel, F.lit(root.rstrip("/") + "/")), F.substring(rel, F.lit(len(root.rstrip("/")) + 2), F.length(rel))).otherwise(rel)
    return F.replace(without_extension(F.ltrim(rel, F.lit("/"))), F.lit("/"), F.lit("__"))


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``, whatever way the scheme of either is written."""
    import re

    bare = r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+"
    base = re.sub(bare, "", root).rstrip("/") + "/"
    rest = F.regexp_replace(path, bare, "")
    return F.when(F.startswith(rest, F.lit(base)), F.substring(rest, F.lit(len(base) + 1), F.length(rest))).otherwise(rest)


def stem(path: Column) -> Column:
    return without_extension(F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1))


def design_key(seed, ref_height, speed, turbulence, yaw, shear) -> Column:
    """Case stem of an experiment row; all parts are taken as text."""
    s = [c.cast("string") for c in (seed, ref_height, speed, turbulence, yaw, shear)]
    return F.concat(F.lit("wind_"), s[0], F.lit("_"), s[1], F.lit("m_"), s[2], F.lit("mps_TI"), s[3], F.lit("_Yaw"), s[4], F.lit("_Shear"), s[5])


#: Both generations of stems: wind[_seed]_90m_4.01mps_TI0_Yaw5[_Shear0.2].
STEM = r"^wind_(?:([0-9]+)_)?([0-9.]+)m_([0-9.]+)mps_TI([^_]+)_Yaw(-?[0-9.]+)(?:_Shear(-?[0-9.]+))?$"


def parse_stem(df: DataFrame, col: str = "stem") -> DataFrame:
    """Adds seed, ref_height, speed, turbulence, yaw, shear; null where a part is missing or the stem is not one."""
    part = lambda k: F.nullif(F.regexp_extract(F.col(col), STEM, k), F.lit(""))
    number = lambda k: part(k).try_cast("double")
    return df.withColumns(
        {"seed": part(1).try_cast("long"), "ref_height": number(2), "speed": number(3), "turbulence": part(4), "yaw": number(5), "shear": number(6)}
    )


def unique_names(names: Column) -> Column:
    """Array of names in which the second, third ... use of a name becomes n_1, n_2 ..."""
    return F.transform(
        names,
        lambda x, i: F.when(
            F.size(F.filter(F.slice(names, 1, i), lambda y: y == x)) > 0,
            F.concat(x, F.lit("_"), F.size(F.filter(F.slice(names, 1, i), lambda y: y == x)).cast("string")),
        ).otherwise(x),
    )


def key_hash(seed, *cols) -> Column:
    """Order for seeded shuffles and samples: md5 of ``seed:key``, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
