"""A bound on what the tasks of all executors do at once, kept by the driver.

A task asks over a connection of its own before it begins and says when it is done; a lost connection counts as done. So a stage can have
as many tasks as its data need, however few of them may work at a time.
"""

from __future__ import annotations

import secrets
import socket
import socketserver
import threading
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, suppress
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import SparkSession

KEY_BYTES = 32


class _Task(socketserver.BaseRequestHandler):
    """One task's connection: its key, then a byte to ask, answered when a permit is free, and a byte to give it back, again and again."""

    def handle(self) -> None:
        line = self.request
        with suppress(OSError):
            line.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
            free = self.server.free.get(line.recv(KEY_BYTES, socket.MSG_WAITALL))
            while free and line.recv(1):
                with free:
                    line.sendall(b"!")
                    line.recv(1)


class _Server(socketserver.ThreadingTCPServer):
    daemon_threads, request_queue_size = True, 1024

    def __init__(self, host: str):
        super().__init__((host, 0), _Task)
        self.free: dict[bytes, threading.Semaphore] = {}
        threading.Thread(target=self.serve_forever, daemon=True).start()


_server = cache(_Server)


@dataclass(frozen=True)
class Permits:
    """What tasks need to ask; the key is known to nobody else."""

    host: str
    port: int
    key: bytes = field(repr=False)

    @contextmanager
    def asked(self) -> Iterator[Callable[[], AbstractContextManager]]:
        """For the time of a task: a function whose contexts each hold one permit, after waiting for it."""
        with socket.create_connection((self.host, self.port), timeout=60) as line:
            line.settimeout(None)
            line.sendall(self.key)

            @contextmanager
            def held() -> Iterator[None]:
                line.sendall(b"?")
                if not line.recv(1):
                    raise ConnectionError("the driver gives no more permits")
                try:
                    yield
                finally:
                    line.sendall(b".")

            yield held


def permits(spark: SparkSession, n: int) -> Permits:
    """n permits for the tasks of one table, served from the address that executors reach the driver at, as long as the driver lives."""
    conf = spark.sparkContext.getConf()
    host = conf.get("spark.driver.host")
    server = _server(conf.get("spark.driver.bindAddress") or host)
    server.free[key := secrets.token_bytes(KEY_BYTES)] = threading.Semaphore(n)
    return Permits(host, server.server_address[1], key)
