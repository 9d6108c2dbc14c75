"""Links and licence declared by a release."""

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import as_column, contains_any, flag, text, text_list


def link_surface(home_page, project_urls, download_url) -> Column:
    """All declared links as one lower-case text."""
    listed = F.array_join(as_column(project_urls), ",")
    return F.lower(F.concat_ws(" ", text(home_page), text(listed), text(download_url)))


def repo_host(surface: Column | str) -> Column:
    surface = as_column(surface)
    host = F
    for domain, label in config.REPO_HOSTS:
        host = host.when(surface.contains(domain), label)
    return host.otherwise("unknown")


def link_features(home_page, surface) -> dict[str, Column]:
    surface = as_column(surface)
    domains = [domain for domain, _ in config.REPO_HOSTS]
    return {
        "has_homepage": flag(F.lower(text(home_page)).rlike(config.HOME_PAGE)),
        "has_repo_url": flag(contains_any(surface, domains)),
        "cat_repo_host": repo_host(surface),
        "has_issue_tracker": flag(contains_any(surface, config.ISSUE_TRACKERS)),
        "has_docs_url": flag(surface.rlike(config.DOCS)),
    }


def classifier_text(classifiers: Column | str) -> Column:
    return F.array_join(text_list(classifiers), " | ")


def has_license(license: Column | str, classifiers: Column | str) -> Column:
    stated = F.trim(text(license)) != ""
    classified = F.lower(classifier_text(classifiers)).rlike(config.LICENSE_CLASSIFIER)
    return flag(stated | classified)


def license_family(license: Column | str, classifiers: Column | str) -> Column:
    """First family named by the classifiers or the licence text."""
    named = F.lower(F.concat(classifier_text(classifiers), F.lit(" "), text(license)))
    family = F
    for label, phrases in config.LICENSE_FAMILIES:
        family = family.when(contains_any(named, phrases), label)
    return family.otherwise(config.NO_LICENSE_FAMILY)


def license_features(license, classifiers) -> dict[str, Column]:
    joined = classifier_text(classifiers)
    return {
        "has_license": has_license(license, classifiers),
        "cat_license_family": license_family(license, classifiers),
        "n_classifiers": F.size(text_list(classifiers)).cast("long"),
        "has_prog_lang_classifier": flag(joined.contains(config.LANGUAGE_CLASSIFIER)),
        "has_typing_classifier": flag(joined.contains(config.TYPING_CLASSIFIER)),
    }
