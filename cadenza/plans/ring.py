"""Sums over the tasks of a barrier stage, by a ring of sockets between them.

Tasks tell each other where they listen by one barrier message; after that numbers go from neighbour to
neighbour: in W - 1 turns each task comes to hold the whole sum of its share, and in W - 1 more each gets the
others' shares. A task sends and receives about twice the numbers, however many tasks there are, and
nothing passes the driver. All tasks get the same sums, to the last bit, so they stay in step.
"""

from __future__ import annotations

import hmac
import secrets
import socket
import struct
import threading
from types import TracebackType

import numpy as np

#: Seconds until a task that hears nothing gives up, so that a lost task fails the stage, which then runs again.
PATIENCE = 600


class Ring:
    """The tasks of a barrier stage; sum() is called by all of them the same number of times."""

    def __init__(self) -> None:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        self.rank, own = context.partitionId(), context.getTaskInfos()
        self.size = len(own)
        if self.size == 1:
            return
        host = own[self.rank].address.rsplit(":", 1)[0]
        door = socket.create_server((host, 0))
        door.settimeout(PATIENCE)
        # the word of the ring: a connection that does not begin with it is not a task's
        told = [m.split(" ") for m in context.allGather(f"{host} {door.getsockname()[1]} {secrets.token_hex(16)}")]
        word = told[0][2].encode()
        there, port, _ = told[(self.rank + 1) % self.size]
        self.next = socket.create_connection((there, int(port)), PATIENCE)
        self.next.sendall(word)
        while True:
            self.last, _ = door.accept()
            self.last.settimeout(PATIENCE)
            if hmac.compare_digest(self.received(len(word)), word):
                break
            self.last.close()
        door.close()
        for s in (self.next, self.last):
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __enter__(self) -> Ring:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if self.size > 1:
            self.next.close()
            self.last.close()

    def received(self, n: int) -> bytes:
        parts = bytearray()
        while len(parts) < n:
            some = self.last.recv(min(1 << 20, n - len(parts)))
            if not some:
                raise ConnectionError("a neighbour is gone")
            parts += some
        return bytes(parts)

    def passed(self, numbers: np.ndarray) -> np.ndarray:
        """Send to the next task, and what the last one sends meanwhile."""
        raw = numbers.tobytes()
        failed: list[BaseException] = []

        def send() -> None:
            try:
                self.next.sendall(struct.pack("<q", len(raw)) + raw)
            except OSError as e:
                failed.append(e)

        # both directions at once, or else all would wait for room to send
        sender = threading.Thread(target=send, daemon=True)
        sender.start()
        (n,) = struct.unpack("<q", self.received(8))
        got = np.frombuffer(self.received(n), np.float64)
        sender.join()
        if failed:
            raise failed[0]
        return got

    def sum(self, numbers: np.ndarray) -> np.ndarray:
        """The sum of all tasks' numbers, in every task."""
        if self.size == 1:
            return numbers
        parts = [p.copy() for p in np.array_split(np.asarray(numbers, np.float64), self.size)]
        for turn in range(self.size - 1):
            parts[(self.rank - turn - 1) % self.size] += self.passed(parts[(self.rank - turn) % self.size])
        for turn in range(self.size - 1):
            parts[(self.rank - turn) % self.size] = self.passed(parts[(self.rank + 1 - turn) % self.size])
        return np.concatenate(parts)
