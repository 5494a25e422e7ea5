"""A small receiver of telemetry over HTTP on the loopback, which lands records where the live reader follows."""

from __future__ import annotations

import ipaddress
import json
import os
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

MAX_BODY, MAX_HEADERS = 8 << 20, 256


class Malformed(ValueError):
    pass


def decode_body(body: bytes) -> list[str]:
    """The JSON lines of a body: an array's elements, one value, or one a line; any line that is no JSON rejects all."""
    try:
        text = body.decode().strip()
        if not text:
            return []
    except UnicodeDecodeError as e:
        raise Malformed from e
    compact = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        out = []
        for line in filter(None, map(str.strip, text.split("\n"))):
            try:
                json.loads(line)
            except (ValueError, RecursionError) as e:
                raise Malformed from e
            out.append(line)
        return out
    return [compact(x) for x in whole] if isinstance(whole, list) else [compact(whole)]


class Receiver:
    """Takes POSTs and gives the records of each to take(lines, peer) before it answers; a slow taker holds its sender back."""

    def __init__(self, take: Callable[[list[str], str], None], host: str = "127.0.0.1", port: int = 0):
        if not ipaddress.ip_address(host).is_loopback:
            raise ValueError("only the loopback is served")

        class Handler(BaseHTTPRequestHandler):
            timeout = 10

            def answer(self, code: int, body: dict) -> None:
                data = json.dumps(body, separators=(",", ":")).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.send_header("Connection", "close")
                self.end_headers()
                self.wfile.write(data)

            def do_POST(self) -> None:
                length = self.headers.get("Content-Length", "0").strip()
                if not length.isdigit() or len(self.headers) > MAX_HEADERS:
                    return self.answer(400, {"error": "malformed request"})
                if int(length) > MAX_BODY:
                    return self.answer(413, {"error": "body too large"})
                body = self.rfile.read(int(length))
                try:
                    if len(body) < int(length):
                        raise Malformed
                    lines = decode_body(body)
                except Malformed:
                    return self.answer(400, {"error": "malformed body"})
                take(lines, f"otlp://{self.client_address[0]}:{self.client_address[1]}")
                return self.answer(200, {"accepted": len(lines)})

            def refuse(self) -> None:
                self.answer(405, {"error": "POST only"})

            do_GET = do_PUT = do_DELETE = do_HEAD = do_PATCH = do_OPTIONS = refuse

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.server.daemon_threads = True
        self.address = self.server.server_address

    def serve(self) -> None:
        self.server.serve_forever(poll_interval=0.1)

    def start(self) -> Receiver:
        threading.Thread(target=self.serve, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def landing(folder: str) -> Callable[[list[str], str], None]:
    """A taker that appends records to otlp.jsonl in a folder, one writer at a time."""
    os.makedirs(folder, exist_ok=True)
    lock = threading.Lock()

    def take(lines: list[str], peer: str) -> None:
        with lock, open(os.path.join(folder, "otlp.jsonl"), "a", encoding="utf-8") as out:
            out.writelines(line + "\n" for line in lines)

    return take
