"""Line-delimited JSON-RPC over standard input and output: the three memory tools for an agent."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

TOOLS = [
    {"name": "recall", "description": "Evidence from past sessions", "inputSchema": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "top_k": {"type": "integer"}, "exclude_session": {"type": "string"}}}},
    {"name": "stats", "description": "Sizes of the memory", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "forget_session", "description": "Forget a session", "inputSchema": {"type": "object", "required": ["session_id"], "properties": {"session_id": {"type": "string"}}}},
]


def _needed(args: dict, name: str) -> str:
    if not isinstance(args.get(name), str):
        raise ValueError(f"the argument {name} is missing")
    return args[name]


def _call(engine, name: str, args: dict):
    if name == "recall":
        return engine.query(_needed(args, "query"), args.get("top_k"), args.get("exclude_session"))
    if name == "stats":
        return engine.stats()
    if name == "forget_session":
        return {"removed": engine.delete_session(_needed(args, "session_id"))}
    raise ValueError(f"no tool {name}")


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def answer(engine, line: str, before=None) -> dict | None:
    """The reply to one request line; none to a notification or to a line that is no JSON object. ``before`` is called
    before each tool, to bring in what waits in a spool."""
    try:
        request = json.loads(line)
    except ValueError:
        return None
    if not isinstance(request, dict) or "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), _dict(request.get("params"))
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "mnemoflow", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        try:
            if before is not None:
                before()
            text, failed = json.dumps(_call(engine, params.get("name"), _dict(params.get("arguments"))), ensure_ascii=False), False
        except Exception as e:  # a tool's failure is its result
            text, failed = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(engine, lines: Iterable[str], before=None) -> Iterator[str]:
    for line in lines:
        if line.strip() and (reply := answer(engine, line, before)) is not None:
            yield json.dumps(reply, ensure_ascii=False)
