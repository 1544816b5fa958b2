"""A whole run over a small project: its edges, counters and document."""

import json

from edgewright.operators import run
from edgewright.plans.whole_run import API, CLIENT, MODEL, PAGE
from edgewright.sources import files


def test_whole_run(spark):
    fill = lambda text: text.replace("@@", "7").replace("PATH", "/items").replace("TABLE", '__tablename__ = "alpha_7"').replace("FROM", "api7")
    rows = [("api/s7.py", fill(API)), ("app/m7.py", fill(MODEL)), ("web/api7.ts", fill(CLIENT)), ("web/page7.ts", fill(PAGE)), ("bad.py", b"\xc3\x28"), ("torn.ts", "f(\n")]
    made = run.analyse(files.from_rows(spark, rows))
    names = {r["id"]: r["name"] for r in made.nodes.collect()}
    assert sorted(names) == list(range(len(names)))
    edges = made.edges.orderBy("id").collect()
    assert [(r["id"], r["kind"], names[r["source"]], names[r["target"]]) for r in edges] == [
        (0, "http-call", "load7", "get_item7"), (1, "call", "page7", "load7"), (2, "queries", "Alpha7", "alpha_7"), (3, "orm-access", "get_item7", "Alpha7"),
    ]
    totals = made.totals.first().asDict()
    want = {"files": 6, "files_clean": 4, "files_with_diagnostics": 1, "files_failed": 1, "routes": 1, "routes_composed": 1, "http_observations": 1, "strong": 1, "exact": 0, "dynamic_partial": 1, "orm_models": 1, "orm_tables": 1, "edges": 4, "http_call_edges": 1, "client_call_edges": 1, "orm_edges": 2, "cross_language_edges": 1}
    assert {k: totals[k] for k in want} == want
    document = json.loads(run.envelope(made, "match").first()["json"])
    assert document["schema_version"] == "1.0" and document["summary"]["edges"] == 4 and [e["id"] for e in document["edges"]] == [0, 1, 2, 3]
    assert "file" not in next(n for n in document["nodes"] if n["kind"] == "table")
