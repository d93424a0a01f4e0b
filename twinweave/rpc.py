"""JSON-RPC requests, one a line, for tools that ask for scans."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from twinweave import __version__
from twinweave.config import ScanConfig
from twinweave.plans.report import json_document
from twinweave.plans.scan import run, scan
from twinweave.sources.files import read_directory

TOOL = {
    "name": "scan_codebase",
    "description": "Find duplicated code in a directory",
    "inputSchema": {"type": "object", "properties": {"directory": {"type": "string"}, "min_tokens": {"type": "integer"}, "enable_git_blame": {"type": "boolean"}}},
}


def _config(args: dict) -> ScanConfig:
    n = args.get("min_tokens")
    return ScanConfig(str(args.get("directory", ".")), n if type(n) is int and n >= 0 else 50, enable_git_blame=args.get("enable_git_blame") is True)


def answer(line: str, work: Callable[[ScanConfig], str]) -> dict:
    """The response to a request line; work gives a scan's JSON."""
    try:
        request = json.loads(line)
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"Parse error: {e}"}}
    request = request if isinstance(request, dict) else {}
    reply: dict = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "twinweave", "version": __version__}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [TOOL]}}
    if method == "tools/call" and params.get("name") == TOOL["name"]:
        try:
            return reply | {"result": {"content": [{"type": "text", "text": work(_config(params.get("arguments") or {}))}]}}
        except Exception as e:
            return reply | {"error": {"code": -32603, "message": str(e)}}
    return reply | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def main() -> None:
    from twinweave.session import local_session

    spark = local_session()
    for line in sys.stdin:
        if line.strip():
            print(json.dumps(answer(line, lambda c: json_document(run(scan(spark, read_directory(spark, c.directory), c))))), flush=True)


if __name__ == "__main__":
    main()
