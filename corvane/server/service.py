"""python -m corvane.server.service PORT NAME=PATH...: answers queries over TCP.

A bounded pool of workers serves the connections, each until it ends; others wait. Spark runs the workers' jobs side by
side. Closing the service lets the workers finish what they are answering. A result is collected to the driver and sent as
one frame, so the frame's length limits it (an error beyond), and max_rows if it is given.
"""

from __future__ import annotations

import socketserver
import sys
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from pathlib import PurePath
from socket import SHUT_RD
from threading import Lock

from ..engine import Engine
from ..errors import QueryError
from ..session import session
from ..sources.wire import ERROR, LONGEST, REQUEST, RESULT, ResultSet, WireError, encode_result, frame, read_frame
from ..types import Kind

WORKERS = 8


def answer(engine: Engine, sql: str, max_rows: int | None = None) -> bytes:
    """The frame that answers a query."""
    try:
        node = engine.plan(sql)
        opaque = [o.name for o in node.output if o.kind is Kind.OPAQUE]
        if opaque:
            raise QueryError(f"column {opaque[0]} has a type that can't be sent")
        result = engine.sql(sql)
        rows = [tuple(r) for r in (result if max_rows is None else result.limit(max_rows + 1)).collect()]
        if max_rows is not None and len(rows) > max_rows:
            raise QueryError(f"the result has more than {max_rows} rows")
        payload = encode_result(ResultSet([o.name for o in node.output], [o.kind for o in node.output], rows))
        if len(payload) + 2 > LONGEST:
            raise QueryError(f"the result is longer than a frame of {LONGEST} bytes")
        return frame(RESULT, payload)
    except QueryError as e:
        return frame(ERROR, str(e).encode())
    except Exception as e:  # whatever Spark raises while it runs the query
        return frame(ERROR, str(e).split("\n", 1)[0].encode())


class Service(socketserver.TCPServer):
    allow_reuse_address = True
    request_queue_size = 128

    def __init__(self, address: tuple[str, int], engine: Engine, max_rows: int | None = None, workers: int = WORKERS):
        super().__init__(address, _Connection)
        self.engine, self.max_rows = engine, max_rows
        self.pool, self.open, self.lock = ThreadPoolExecutor(workers), set(), Lock()

    def process_request(self, request, client_address) -> None:
        with self.lock:
            self.open.add(request)
        self.pool.submit(self._serve, request, client_address)

    def _serve(self, request, client_address) -> None:
        try:
            self.finish_request(request, client_address)
        except OSError:  # the client has gone
            pass
        finally:
            with self.lock:
                self.open.discard(request)
            self.shutdown_request(request)

    def server_close(self) -> None:
        super().server_close()
        with self.lock:
            for request in self.open:  # no further requests are read; answers still go out
                with suppress(OSError):
                    request.shutdown(SHUT_RD)
        self.pool.shutdown(wait=True)


class _Connection(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        while True:
            try:
                got = read_frame(self.rfile.read)
            except (WireError, OSError):
                return
            if got is None:
                return
            kind, payload = got
            if kind == REQUEST:
                self.wfile.write(answer(self.server.engine, payload.decode(errors="replace"), self.server.max_rows))


def main(args: list[str]) -> None:
    engine = Engine(session())
    for arg in args[1:]:
        name, _, path = arg.rpartition("=")
        engine.register(name or PurePath(path).stem, path)
    with Service(("127.0.0.1", int(args[0])), engine) as service:
        service.serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
