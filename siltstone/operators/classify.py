"""Management class and clean-up risk of a path, relative to its scan root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of each class, in the order they are tried.
CONTENT_ADDRESSED = ["/.git/objects/", "/nix/store/", "/var/lib/docker/overlay2/", "/var/lib/containers/storage/", "/cas/"]
SYSTEM_CRITICAL = ["/boot/", "/etc/", "/bin/", "/sbin/", "/lib/", "/lib32/", "/lib64/", "/windows/", "/windows/system32/"]
PACKAGE_MANAGED = ["/usr/", "/var/lib/dpkg/", "/var/lib/rpm/", "/var/lib/pacman/", "/var/cache/apt/", "/var/cache/dnf/", "/var/cache/pacman/"]
APPLICATION_MANAGED = [
    "/.steam/", "/steamapps/", "/flatpak/", "/.var/app/", "/snap/", "/appdata/", "/program files/", "/program files (x86)/", "/programdata/", "/jetbrains/", "/pycharm", "/node_modules/", "/site-packages/",
]

#: The reason given for each class.
REASONS = {
    "unclassified": "classification disabled",
    "content-addressed": "path matches a content-addressed or container storage area",
    "system-critical": "path is inside an operating-system or boot-critical area",
    "package-managed": "path is inside a package-manager or system package area",
    "application-managed": "path matches an application-managed runtime, cache, or installation area",
    "user-managed": "path does not match a known managed-content area",
}


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def management(relative_path: Column, enabled: bool = True) -> Column:
    """struct(management_class, confidence, cleanup_risk, reason)"""

    def result(name: str, confidence: str, risk: Column | str) -> Column:
        return F.struct(F.lit(name).alias("management_class"), F.lit(confidence).alias("confidence"), (F.lit(risk) if isinstance(risk, str) else risk).alias("cleanup_risk"), F.lit(REASONS[name]).alias("reason"))

    if not enabled:
        return result("unclassified", "none", "medium")
    path = F.concat(F.lit("/"), F.lower(relative_path))
    contains = lambda marks: _any([F.contains(path, F.lit(m)) for m in marks])
    starts = lambda marks: _any([F.startswith(path, F.lit(m)) for m in marks])
    return (
        F.when(contains(CONTENT_ADDRESSED), result("content-addressed", "high", "high"))
        .when(starts(SYSTEM_CRITICAL) | (path == "/boot"), result("system-critical", "high", "critical"))
        .when(starts(PACKAGE_MANAGED), result("package-managed", "high", F.when(F.startswith(path, F.lit("/usr/")), "critical").otherwise("high")))
        .when(contains(APPLICATION_MANAGED), result("application-managed", "medium", "high"))
        .otherwise(result("user-managed", "medium", "low"))
    )
