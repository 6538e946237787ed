"""A small HTTP receiver that lands POST bodies as files for a streaming file source."""

from __future__ import annotations

import base64
import hmac
import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyarrow import fs


def authorized(header: str | None, auth: dict | None) -> bool:
    """Basic or bearer authentication."""
    if not auth:
        return True
    if auth["type"] == "basic":
        want = "Basic " + base64.b64encode(f"{auth['username']}:{auth['password']}".encode()).decode()
    else:
        want = f"Bearer {auth['token']}"
    return hmac.compare_digest((header or "").encode(), want.encode())


class Receiver:
    """POST to `path` with a JSON body: 200, and the body is a file in `landing`, a folder of any store that pyarrow knows; 401, 404 or
    400 otherwise. cors: pages of any origin may send."""

    def __init__(self, landing: str, path: str = "/", host: str = "127.0.0.1", port: int = 0, auth: dict | None = None, cors: bool = False):
        store, folder = fs.FileSystem.from_uri(landing)
        store.create_dir(folder, recursive=True)

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                if self.path != path:
                    return self.answer(404)
                if not authorized(self.headers.get("Authorization"), auth):
                    return self.answer(401)
                try:
                    text = json.dumps(json.loads(body))
                except ValueError:
                    return self.answer(400)
                name = uuid.uuid4().hex
                with store.open_output_stream(f"{folder}/.{name}") as out:
                    out.write((text + "\n").encode())
                store.move(f"{folder}/.{name}", f"{folder}/{name}.json")  # whole files only
                return self.answer(200)

            def do_OPTIONS(self) -> None:
                self.answer(204 if cors and self.path == path else 404)

            def answer(self, code: int) -> None:
                self.send_response(code)
                if cors:
                    for key, value in (("Origin", "*"), ("Methods", "POST, OPTIONS"), ("Headers", "Authorization, Content-Type")):
                        self.send_header(f"Access-Control-Allow-{key}", value)
                self.end_headers()

            def log_message(self, *args: object) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def start(self) -> Receiver:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
