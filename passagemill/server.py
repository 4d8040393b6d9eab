"""A thin HTTP shell over the same plan: GET /health and POST /query."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def respond(method: str, path: str, body: bytes, run: Callable[[str], dict]) -> tuple[int, dict | str]:
    """Status and JSON (or text) of a request."""
    path = path.split("?")[0]
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    if (method, path) == ("POST", "/query"):
        question = json.loads(body or b"{}").get("q")
        question = question.strip() if isinstance(question, str) else ""
        return (200, run(question)) if question else (400, {"error": 'missing "q"'})
    return 404, "Not found"


def serve(run: Callable[[str], dict], port: int = 3000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _go(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, out = respond(self.command, self.path, self.rfile.read(size), run)
            data = out.encode() if isinstance(out, str) else json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(out, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _go

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
