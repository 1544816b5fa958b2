"""Column types of observations, canonical routes and graphs, and the fixed values of the domain."""

from __future__ import annotations

PART = "struct<kind:string,value:string,source:string>"
SEGMENT = "struct<kind:string,value:string,name:string,constraint:string,source:string>"

ROUTE_OBS = (
    "route_id long, file string, language string, line int, style string, methods array<string>, path_kind string, "
    f"path_value string, path_parts array<{PART}>, receiver string, handler string"
)
CLIENT_OBS = (
    "client_id long, file string, language string, line int, enclosing string, method string, url_kind string, "
    f"url_value string, url_parts array<{PART}>"
)
NODES = "id long, kind string, name string, file string, line int"
EDGES = "id long, source long, target long, kind string, confidence float, provenance string, evidence string, file string, line int"

# Fixed values.
#: HTTP verbs that a method hint can name.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: Confidence by provenance; FLOAT arithmetic throughout.
CONFIDENCE = {
    "lsp-reference": 1.00,
    "route-matcher": 0.98,
    "open-api-spec": 0.98,
    "static-import-resolution": 0.90,
    "constant-propagation": 0.80,
    "partial-template": 0.65,
    "model-inference": 0.45,
}
#: Confidence by how the paths of client and route agree, and the factor where a method is not declared.
MATCH_CONFIDENCE = {"exact-static": 0.98, "parameter-bound": 0.90, "variable-aligned": 0.80, "wildcard-suffix": 0.65}
UNDECLARED_METHOD = 0.8
FLOAT_EPSILON = 1.1920929e-07
#: Directories that a walk does not enter, besides hidden ones.
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "coverage", "target", "__pycache__", "site-packages", "venv", ".venv", "migrations")
EXTENSIONS = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "pyi": "python"}
