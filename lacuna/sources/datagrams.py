"""UDP as a streaming source, and a fire-and-forget sink."""

from __future__ import annotations

import socket
import time

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def join_groups(sock: socket.socket, groups: list[str]) -> int:
    """Subscribe to multicast addresses; how many took it, the others are left out."""
    taken = 0
    for g in groups:
        try:
            sock.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, socket.inet_aton(g) + socket.inet_aton("0.0.0.0"))
            taken += 1
        except OSError:
            pass
    return taken


class DatagramSource(DataSource):
    """``spark.readStream.format("datagrams").option("port", ...)``: what came to a port between two triggers.

    Options: ``host`` to bind (this machine's loopback if not given), ``groups`` of multicast, comma-separated, and
    ``maxRowsPerBatch``.
    """

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "datagram binary, peer string, seen double"

    def simpleStreamReader(self, schema):
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.port, self.most = int(options.get("port", 0)), int(options.get("maxRowsPerBatch", 10_000))
        self.host, self.groups = options.get("host", "127.0.0.1"), [g.strip() for g in options.get("groups", "").split(",") if g.strip()]
        self.sock = None
        self.log: dict[int, list] = {}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        if self.sock is None:
            self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.sock.bind((self.host, self.port))
            join_groups(self.sock, self.groups)
            self.sock.setblocking(False)
        rows = []
        while len(rows) < self.most:
            try:
                data, peer = self.sock.recvfrom(65535)
            except BlockingIOError:
                break
            rows.append((data, f"{peer[0]}:{peer[1]}", time.time()))
        at = start["at"]
        self.log[at] = rows
        return iter(rows), {"at": at + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.log.get(start["at"], []))

    def commit(self, end: dict) -> None:
        self.log = {k: v for k, v in self.log.items() if k >= end["at"]}


def send(df: DataFrame, host: str, port: int) -> None:
    """Datagrams to one address from the executors; errors are ignored as the network would."""

    def out(rows):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for r in rows:
                try:
                    s.sendto(bytes(r.datagram), (host, port))
                except OSError:
                    pass

    df.select("datagram").foreachPartition(out)
