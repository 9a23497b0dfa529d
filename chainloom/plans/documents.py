"""Small lockfiles and bills of materials, and the rows they must give."""

from __future__ import annotations

import json

NPM2 = {
    "name": "shop", "lockfileVersion": 2,
    "packages": {
        "": {"dependencies": {"express": "^4.18.2"}},
        "node_modules/express": {"version": "4.18.2", "integrity": "sha512-abc", "dependencies": {"chalk": "^4.1.0"}},
        "node_modules/chalk": {"version": "4.1.2"},
        "node_modules/express/node_modules/chalk": {"version": "3.0.0"},
    },
}
NPM1 = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0"}, "c": {}}}, "d": {"integrity": "sha256-x"}}}
CYCLONEDX = {"components": [{"name": "lodash", "version": "4.17.21", "bom-ref": "r1"}, {"name": "debug", "version": "4.3.4"}], "dependencies": [{"ref": "r1", "dependsOn": ["r2", "r3"]}]}
SPDX = {"packages": [{"name": "left", "versionInfo": "1.0"}, {"name": "right"}]}
YARN = '# yarn lockfile v1\n\n"@scope/x@^1.0.0":\n  version "1.2.0"\n  dependencies:\n    chalk "^4.1.0"\n\nchalk@^4.1.0, chalk@^4.0.0:\n  version "4.1.2"\n\nchalk@^3.0.0:\n  version "3.0.0"\n'
PNPM = "importers:\n  .:\n    dependencies:\n      chalk: 4.1.2\npackages:\n  /chalk@4.1.2:\n    dependencies:\n      ansi-styles: 4.3.0\n  '@scope/y@2.0.0': {}\n  plain: {}\n"

FILES = {
    "npm": [("p1", json.dumps(NPM2)), ("p2", json.dumps(NPM1)), ("p3", "not json")],
    "cyclonedx": [("p1", json.dumps(CYCLONEDX))],
    "spdx": [("p1", json.dumps(SPDX))],
    "yarn": [("p1", YARN)],
    "pnpm": [("p1", PNPM), ("p2", ": bad : yaml :")],
}

EXPECTED = {
    "npm": [
        ("p1", "express", "4.18.2", True, "chalk ^4.1.0", "sha512-abc"), ("p1", "chalk", "3.0.0", False, "", None),
        ("p2", "a", "1.0.0", True, "b 2.0.0, c *", None), ("p2", "d", "0.0.0", True, "", "sha256-x"),
    ],
    "cyclonedx": [("p1", "lodash", "4.17.21", False, "r2 *, r3 *", None), ("p1", "debug", "4.3.4", False, "", None)],
    "spdx": [("p1", "left", "1.0", False, "", None), ("p1", "right", "0.0.0", False, "", None)],
    "yarn": [("p1", "@scope/x", "1.2.0", True, "chalk ^4.1.0", None), ("p1", "chalk", "4.1.2", True, "", None)],
    "pnpm": [("p1", "chalk", "4.1.2", True, "ansi-styles 4.3.0", None), ("p1", "@scope/y", "2.0.0", False, "", None), ("p1", "plain", "0.0.0", False, "", None)],
}


def expected_sql(name: str) -> str:
    value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in EXPECTED[name])
    return f"SELECT project_id, name, version, is_direct, needs, integrity::VARCHAR AS integrity FROM (VALUES {rows}) t(project_id, name, version, is_direct, needs, integrity)"
