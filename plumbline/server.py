"""A JSON-RPC 2.0 tool server over text streams, one message a line."""

from __future__ import annotations

import json
from collections.abc import Callable

from . import api
from .sources.readers import ParseError

TEXT = {"type": "string"}
#: Tools: what they need, and what they may be given.
TOOLS: dict[str, tuple[str, list[str], list[str]]] = {
    "validate_graphs": ("Validate a data graph against shapes and return the report.", ["data", "shapes"], ["data_format", "shapes_format", "output"]),
    "validate_graphs_conforms": ("Whether a data graph conforms to shapes.", ["data", "shapes"], ["data_format", "shapes_format"]),
    "lint_graph": ("Check that a text is in an RDF grammar.", ["text"], ["fmt"]),
    "parse_shapes_graph": ("The shapes of a shapes graph.", ["text"], ["fmt"]),
}


def call(name: str, given: dict, spark: Callable):
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    _, needed, allowed = TOOLS[name]
    if missing := [k for k in needed if k not in given]:
        raise ValueError(f"missing: {', '.join(missing)}")
    given = {k: v for k, v in given.items() if k in (*needed, *allowed)}
    if name.startswith("validate"):
        return getattr(api, name)(spark(), **given)
    if name == "lint_graph":
        return api.lint_graph(**given) or "ok"
    return [s.as_dict() for s in api.parse_shapes_graph(**given)]


def answer(request: dict, spark: Callable) -> dict | None:
    """The response to one message; None for a notification."""
    method, params, id_ = request.get("method"), request.get("params") or {}, request.get("id")
    if id_ is None:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "plumbline", "version": "1"}}
        elif method == "tools/list":
            result = {
                "tools": [
                    {"name": n, "description": d, "inputSchema": {"type": "object", "properties": dict.fromkeys([*need, *may], TEXT), "required": need}}
                    for n, (d, need, may) in TOOLS.items()
                ]
            }
        elif method == "tools/call":
            out = call(params.get("name"), params.get("arguments") or {}, spark)
            result = {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)}]}
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"unknown method: {method}"}}
    except (ParseError, ValueError) as e:
        result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def serve(lines, out) -> int:
    started = []

    def spark():
        if not started:
            from .__main__ import session

            started.append(session())
        return started[0]

    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line), spark)
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
    return 0
