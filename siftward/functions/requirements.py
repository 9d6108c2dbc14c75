"""Requirement strings and how near their names come to known brands."""

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import as_column, constants, flag, text_list
from siftward.functions.distance import nearest_distance

_BLANKS = " \t\n\r\f\v"


def required_name(requirement: Column | str) -> Column:
    """Leading name of a requirement, null when there is none."""
    return F.regexp_substr(as_column(requirement), F.lit(config.REQUIRED_NAME))


def base_name(requirement: Column | str) -> Column:
    """Requirement without marker and version; extras in brackets stay."""
    unmarked = F.split_part(as_column(requirement), F.lit(";"), F.lit(1))
    versionless = F.regexp_extract(F.btrim(unmarked, F.lit(_BLANKS)), "^[^<>=!~ ]*", 0)
    return F.btrim(versionless, F.lit(_BLANKS))


def base_names(requirements: Column | str) -> Column:
    """Base names of all requirements that are present."""
    present = F.filter(text_list(requirements), lambda r: r.isNotNull())
    return F.transform(present, base_name)


def requirement_features(requirements) -> dict[str, Column]:
    requirements = text_list(requirements)
    return {
        "n_requires": F.size(requirements).cast("long"),
        "has_extras": flag(
            F.exists(requirements, lambda r: F.lower(r).rlike(config.EXTRA_MARKER))
        ),
    }


def brand_features(requirements) -> dict[str, Column]:
    names = F.filter(base_names(requirements), lambda n: n != "")
    lowered = F.transform(names, F.lower)
    brands = config.BRAND_PACKAGES + config.BRAND_ALIASES
    nearest = F.array_min(F.transform(names, lambda n: nearest_distance(n, brands)))
    return {
        "has_dependency_to_top_brand": flag(
            F.arrays_overlap(lowered, constants(b.lower() for b in config.BRAND_PACKAGES))
        ),
        "min_dep_lev_to_brand": nearest.cast("double"),
        "has_dependency_lev_close_to_brand": flag(nearest <= config.CLOSE_DISTANCE),
    }
