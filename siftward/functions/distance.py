"""Edit distance of a name to lists of known names."""

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import text


def nearest_distance(name: Column | str, known: list[str]) -> Column:
    """Smallest edit distance to any known name, ignoring case.

    A missing name is compared as empty text; without known names the
    distance is infinite.
    """
    if not known:
        return F.lit(float("inf"))
    lowered = F.lower(text(name))
    distances = [F.levenshtein(lowered, F.lit(k.lower())) for k in known]
    nearest = F.least(*distances) if len(distances) > 1 else distances[0]
    return nearest.cast("long")


def nearest_within(name: Column | str, known: list[str], threshold: int) -> Column:
    """Distance together with whether it is within the threshold."""
    distance = nearest_distance(name, known)
    return F.struct(
        distance.alias("distance"), (distance <= threshold).alias("is_close")
    )


def name_distance_features(name: Column | str) -> dict[str, Column]:
    return {
        "n_lev_dist_to_top1": nearest_distance(name, config.TOP_PACKAGES),
        "n_lev_dist_to_alias": nearest_distance(name, config.BRAND_ALIASES),
    }
