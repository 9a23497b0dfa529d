"""A small registry to start with: the documents of seventeen packages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Mail addresses of the handles.
MAILS = {
    "sindresorhus": "sindre@example.com", "qix": "qix@example.com", "dfcreative": "df@example.com", "dougwilson": "doug@example.com", "enterprise-org": "dev@corp.com", "dashboard-team": "team@dash.io", "sec-team": "sec@corp.com",
    "pay-team": "pay@corp.com", "admin-team": "admin@corp.com", "dominictarr": "dominic@example.com", "right9ctrl": "right9ctrl@example.com", "larhpa": "lasse@example.com", "jia-tan": "jiatan@example.com",
}
# Maintainers of each package.
MAINTAINERS = {
    "chalk": ("sindresorhus",), "ansi-styles": ("sindresorhus",), "color-convert": ("qix",), "color-name": ("dfcreative",), "supports-color": ("sindresorhus",), "has-flag": ("sindresorhus",), "express": ("dougwilson",), "accepts": ("dougwilson",),
    "body-parser": ("dougwilson",), "api-gateway": ("enterprise-org",), "web-dashboard": ("dashboard-team",), "auth-service": ("sec-team",), "payment-api": ("pay-team",), "admin-portal": ("admin-team",), "event-stream": ("dominictarr", "right9ctrl"),
    "flatmap-stream": ("right9ctrl",), "xz-utils-embedded": ("larhpa", "jia-tan"),
}
# Releases (package, version, day, publisher, dependencies, unpacked size, files).
RELEASES = (
    ("chalk", "4.1.0", "2020-04-10", "sindresorhus", {"ansi-styles": "^4.1.0", "supports-color": "^7.1.0"}, 31000, 7),
    ("chalk", "4.1.2", "2021-08-01", "sindresorhus", {"ansi-styles": "^4.1.0", "supports-color": "^7.1.0"}, 32000, 7),
    ("ansi-styles", "4.3.0", "2020-05-15", "sindresorhus", {"color-convert": "^2.0.1"}, 15000, 5),
    ("color-convert", "2.0.1", "2019-06-01", "qix", {"color-name": "~1.1.4"}, 27000, 8),
    ("color-name", "1.1.4", "2018-02-01", "dfcreative", {}, 5000, 3),
    ("supports-color", "7.2.0", "2020-09-01", "sindresorhus", {"has-flag": "^4.0.0"}, 8000, 4),
    ("has-flag", "4.0.0", "2019-04-01", "sindresorhus", {}, 4000, 3),
    ("express", "4.18.2", "2022-10-08", "dougwilson", {"accepts": "~1.3.8", "body-parser": "1.20.1", "chalk": "^4.1.0"}, 210000, 30),
    ("accepts", "1.3.8", "2022-01-20", None, {}, 18000, 5),
    ("body-parser", "1.20.1", "2022-10-01", None, {}, 48000, 12),
    ("api-gateway", "2.0.0", "2023-01-01", None, {"express": "^4.18.0"}, 50000, 10),
    ("web-dashboard", "1.5.0", "2023-02-01", None, {"express": "4.18.2", "chalk": "^4.1.0"}, 85000, 15),
    ("auth-service", "3.1.0", "2023-03-01", None, {"express": "^4.17.0"}, 40000, 8),
    ("payment-api", "1.0.0", "2023-04-01", None, {"api-gateway": "^2.0.0"}, 60000, 12),
    ("admin-portal", "1.2.0", "2023-05-01", None, {"web-dashboard": "^1.5.0"}, 75000, 14),
    ("event-stream", "3.3.4", "2016-01-10", "dominictarr", {}, 28000, 10),
    ("event-stream", "3.3.5", "2018-09-05", "right9ctrl", {}, 29000, 10),
    ("event-stream", "3.3.6", "2018-09-10", "right9ctrl", {"flatmap-stream": "0.1.1"}, 30000, 10),
    ("flatmap-stream", "0.1.1", "2018-09-09", "right9ctrl", {}, 65000, 4),
    ("xz-utils-embedded", "5.4.0", "2022-12-01", "larhpa", {}, 1200000, 150),
    ("xz-utils-embedded", "5.6.0", "2024-02-24", "jia-tan", {}, 1800000, 165),
    ("xz-utils-embedded", "5.6.1", "2024-03-09", "jia-tan", {}, 1850000, 165),
)
# Packages whose releases are attested, and scripts that run at install time.
ATTESTED = ("chalk", "ansi-styles")
SCRIPTS = {"flatmap-stream": {"preinstall": "node test/data.js"}}


def packuments(spark: SparkSession, observed_at: str = "2024-06-01 00:00:00") -> DataFrame:
    """(content, observed_at): one registry text for each package, as ``packuments.parse`` takes them."""
    docs: dict[str, dict] = {}
    for package, version, day, publisher, needs, size, files in RELEASES:
        doc = docs.setdefault(package, {"name": package, "maintainers": [{"name": h, "email": MAILS[h]} for h in MAINTAINERS[package]], "time": {}, "versions": {}})
        doc["time"][version] = f"{day}T12:00:00Z"
        body = {"name": package, "version": version, "dependencies": needs, "dist": {"unpackedSize": size, "fileCount": files} | ({"attestations": True} if package in ATTESTED else {})}
        body |= {"_npmUser": {"name": publisher, "email": MAILS[publisher]}} if publisher else {}
        doc["versions"][version] = body | ({"scripts": SCRIPTS[package]} if package in SCRIPTS else {})
    return spark.createDataFrame([(json.dumps(d),) for d in docs.values()], "content string").selectExpr("content", f"TIMESTAMP '{observed_at}' AS observed_at")
