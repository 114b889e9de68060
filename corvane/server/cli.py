"""python -m corvane.server.cli HOST PORT [SQL]: one query, or a prompt until a blank line."""

from __future__ import annotations

import socket
import sys
from typing import TextIO

from ..sources.wire import ERROR, REQUEST, ResultSet, decode_result, frame, read_frame


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def shown(result: ResultSet) -> str:
    lines = [" | ".join(result.names), *(" | ".join(map(cell, r)) for r in result.rows)]
    n = len(result.rows)
    return "\n".join([*lines, f"({n} row{'' if n == 1 else 's'})"])


class Client:
    def __init__(self, host: str, port: int):
        self.socket = socket.create_connection((host, port))
        self.file = self.socket.makefile("rb")

    def query(self, sql: str) -> ResultSet | str:
        """The result, or the error's text."""
        self.socket.sendall(frame(REQUEST, sql.encode()))
        got = read_frame(self.file.read)
        if got is None:
            raise ConnectionError("the service has hung up")
        kind, payload = got
        return payload.decode() if kind == ERROR else decode_result(payload)

    def close(self) -> None:
        self.file.close()
        self.socket.close()


def run(client: Client, sql: str, out: TextIO, err: TextIO) -> None:
    got = client.query(sql)
    print(f"ERROR: {got}" if isinstance(got, str) else shown(got), file=err if isinstance(got, str) else out)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print("usage: cli HOST PORT [SQL]", file=sys.stderr)
        return 1
    client = Client(args[0], int(args[1]))
    if len(args) > 2:
        run(client, args[2], sys.stdout, sys.stderr)
    else:
        while line := input("> ").strip():
            run(client, line, sys.stdout, sys.stderr)
    client.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
