"""Who owns a package, from its author and maintainer addresses."""

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import as_column, flag, text_list


def all_addresses(authors, maintainers) -> Column:
    """Both lists one after the other, repeats kept."""
    return F.concat(text_list(authors), text_list(maintainers))


def distinct_addresses(authors, maintainers) -> Column:
    return F.array_distinct(all_addresses(authors, maintainers))


def owner_features(authors, maintainers) -> dict[str, Column]:
    addresses = all_addresses(authors, maintainers)
    free = F.filter(addresses, lambda a: a.rlike(config.FREE_MAIL))
    share = F.try_divide(F.size(free).cast("double"), F.size(addresses).cast("double"))
    return {
        "n_maintainers": F.size(addresses).cast("long"),
        "pct_free_email_domains": F.coalesce(share, F.lit(0.0)),
        "has_disposable_email": flag(
            F.exists(addresses, lambda a: a.rlike(config.DISPOSABLE_MAIL))
        ),
        "has_missing_author": flag(F.size(text_list(authors)) == 0),
    }


def list_length(values: Column | str) -> Column:
    return F.coalesce(F.size(as_column(values)), F.lit(0)).cast("long")
