"""A store in the browser: a page, a JSON interface, a static copy."""

from __future__ import annotations

import base64
import html
import json
import mimetypes
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from pyspark.sql import functions as F

from rootline.operators import graph, search, views
from rootline.schema import ArtifactNotFoundError, NodeNotFoundError, StoreError

#: Images up to this size go into a static page.
INLINE_BYTES = 256 * 1024

#: Rows that a page or an answer may hold; more are refused, as they pass through the driver and a browser.
MAX_SHOWN = 200_000

PAGE = """<!doctype html><meta charset="utf-8"><title>Lineage</title>
<style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{padding:2px 10px;text-align:left;border-bottom:1px solid #ddd}}.failed{{color:#b00}}img{{max-width:20em}}</style>
<h1>Lineage</h1><p>{summary}</p><input id="q" placeholder="search"><table id="runs"><thead><tr><th>level<th>node<th>step<th>parents<th>created<th>metadata</tr></thead><tbody></tbody></table>{images}
<script>const data={payload};
const body=document.querySelector("tbody");
function show(term){{body.textContent="";for(const n of data.nodes){{const text=JSON.stringify(n).toLowerCase();if(term&&!text.includes(term.toLowerCase()))continue;
const tr=document.createElement("tr");if(!n.healthy)tr.className="failed";for(const v of [n.level,n.node_id,n.step_type,n.parents.join(", "),n.created,n.entries]){{const td=document.createElement("td");td.textContent=v;tr.append(td)}}body.append(tr)}}}}
document.querySelector("#q").oninput=e=>show(e.target.value);show("");</script>"""


def script_safe(value) -> str:
    """JSON that can't end the script it stands in."""
    return json.dumps(value).replace("</", "<\\/")


def _shown(rows) -> list:
    found = rows.limit(MAX_SHOWN + 1).collect()
    if len(found) > MAX_SHOWN:
        raise StoreError(f"more than {MAX_SHOWN} rows to show; search for fewer, or query the frames")
    return found


def graph_payload(store) -> dict:
    """Nodes and edges to draw."""
    frames = store.frames()
    nodes = [{"id": r.node_id, "label": r.label, "step_type": r.step_type, "healthy": r.healthy, "level": r.level} for r in _shown(graph.skeleton(frames).orderBy("created_epoch_seconds", "node_id"))]
    edges = [{"from": r["from"], "to": r["to"]} for r in _shown(graph.edge_list(frames).orderBy("created_epoch_seconds", "to", "ordinal"))]
    return {"nodes": nodes, "edges": edges}


def runs_payload(store) -> dict:
    """One row per run with all metrics, oldest first."""
    runs = views.runs_table(store.frames()).orderBy("created_epoch_seconds", "node_id")
    return {"columns": runs.columns, "rows": [r.asDict() for r in _shown(runs)]}


def node_payload(store, node_id: str) -> dict:
    """All that is known of a node, by section."""
    if store.get(node_id) is None:
        raise NodeNotFoundError(node_id)
    out: dict[str, dict] = {}
    for r in views.detail(store.frames(), node_id).collect():
        out.setdefault(r.section, {})[r["name"]] = r.value
    return {"node_id": node_id, "sections": out}


def render(store, images: bool = False) -> str:
    """The page with all nodes; with images their small ones are part of it."""
    frames = store.frames()
    level = graph.node_levels(frames).select(F.col("node").alias("node_id"), "level")
    entries = views.entries(frames).where(~F.col("section").isin("Node", "Provenance")).groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), "  ").alias("entries"))
    from rootline.operators.find import records

    rows = records(frames, frames.node).join(level, "node_id").join(entries, "node_id", "left").orderBy("created_epoch_seconds", "node_id")
    nodes = [{"node_id": r.node_id, "step_type": r.step_type, "level": r.level, "parents": r.parents, "created": r.created_utc, "healthy": r.healthy, "entries": r.entries or ""} for r in _shown(rows)]
    shown = ""
    if images:
        for r in frames.artifact.where(F.lower("relpath").rlike(r"\.(png|jpe?g|gif|svg|webp)$") & (F.col("size") <= INLINE_BYTES)).orderBy("node_id", "relpath").toLocalIterator():
            kind = mimetypes.guess_type(r.relpath)[0] or "application/octet-stream"
            content = base64.b64encode(store.artifact_path(r.node_id, r.relpath).read_bytes()).decode()
            shown += f'<figure><img src="data:{kind};base64,{content}"><figcaption>{html.escape(r.node_id)}/{html.escape(r.relpath)}</figcaption></figure>'
    totals = ", ".join(f"{k.replace('_', ' ')}: {v}" for k, v in store.stats().items())
    return PAGE.format(summary=html.escape(totals), payload=script_safe({"nodes": nodes}), images=shown)


def export(store, dest: str | Path | None = None, include_artifacts: bool = True) -> Path:
    """Write the page as one file that needs nothing else."""
    dest = Path(dest or store.root / "lineage.html")
    dest.write_text(render(store, include_artifacts))
    return dest


def answer(store, path: str) -> tuple[int, str, bytes]:
    """(status, type, content) for a path of the interface."""
    url = urllib.parse.urlsplit(path)
    parts = [urllib.parse.unquote(p) for p in url.path.strip("/").split("/")]
    asked = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
    try:
        if parts == [""]:
            return 200, "text/html; charset=utf-8", render(store).encode()
        match parts:
            case ["api", "graph"]:
                found = graph_payload(store)
            case ["api", "runs"]:
                found = runs_payload(store)
            case ["api", "search"]:
                found = {"ids": [r.node_id for r in _shown(search.search(store.frames(), asked.get("q", "")).orderBy("created_epoch_seconds", "node_id").select("node_id"))]}
            case ["api", "diff"]:
                if not {"a", "b"} <= asked.keys():
                    return 400, "application/json", b'{"error": "a and b are needed"}'
                if missing := [i for i in (asked["a"], asked["b"]) if store.get(i) is None]:
                    raise NodeNotFoundError(missing[0])
                found = {"rows": store.diff(asked["a"], asked["b"])}
            case ["api", "node", node_id]:
                found = node_payload(store, node_id)
            case ["api", "artifact", node_id, *rel] | [node_id, *rel] if rel:
                file = store.artifact_path(node_id, "/".join(rel))
                return 200, mimetypes.guess_type(file.name)[0] or "application/octet-stream", file.read_bytes()
            case _:
                return 404, "application/json", b'{"error": "no such path"}'
        return 200, "application/json", json.dumps(found, default=str).encode()
    except (NodeNotFoundError, ArtifactNotFoundError) as e:
        return 404, "application/json", json.dumps({"error": str(e)}).encode()
    except Exception as e:  # noqa: BLE001
        return 500, "application/json", json.dumps({"error": repr(e)[:500]}).encode()


def serve(store, port: int = 0, block: bool = False) -> HTTPServer:
    """Answer on 127.0.0.1; in a thread of its own unless it is to block."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, content = answer(store, self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def log_message(self, *_) -> None:
            pass

    server = HTTPServer(("127.0.0.1", port), Handler)
    if block:
        server.serve_forever()
    else:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
