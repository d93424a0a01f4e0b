"""HTTP: GET /api/health and POST /api/scan with a configuration of all seven fields."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from twinweave import __version__
from twinweave.config import ScanConfig


def respond(method: str, path: str, body: bytes, work: Callable[[ScanConfig], str]) -> tuple[int, str]:
    """(status, JSON) of a request; work gives a scan's JSON."""
    if (method, path) == ("GET", "/api/health"):
        return 200, json.dumps({"status": "ok", "version": __version__})
    if (method, path) == ("POST", "/api/scan"):
        try:
            config = ScanConfig.from_json(body.decode("utf-8"), strict=True)
        except (ValueError, TypeError) as e:
            return 422, json.dumps({"error": str(e)})
        try:
            return 200, work(config)
        except Exception as e:
            return 500, json.dumps({"error": str(e)})
    return 404, json.dumps({"error": "not found"})


def server(port: int, work: Callable[[ScanConfig], str]) -> ThreadingHTTPServer:
    """A server on this machine only."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, text = respond(method, self.path.split("?")[0], body, work)
            data = text.encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Headers", "*")
            self.end_headers()

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(port: int = 7331) -> None:
    from twinweave.plans.report import json_document
    from twinweave.plans.scan import run, scan
    from twinweave.session import local_session
    from twinweave.sources.files import read_directory

    spark = local_session()
    server(port, lambda c: json_document(run(scan(spark, read_directory(spark, c.directory), c)))).serve_forever()


if __name__ == "__main__":
    main()
