"""Strong components by messages between the tasks of one barrier stage (worker side).

Every node belongs to one task, which keeps its edges in and out. In a turn every
node gets a colour of its own, and two labels: the smallest colour that reaches it,
and the smallest that it reaches. Labels pass along the edges step by step; only
those that fell in the step before are sent. If both labels of a node are one
colour, it is in the component of the node of that colour; edges whose ends differ
in a label lie on no cycle and go, as do those of nodes without edges in or out. The
turns end when no edge is left. Nodes of a component of one aren't returned.

Messages travel over sockets from task to task, never through the driver, so a
step costs some milliseconds. A step ends when every task has heard from every other.
"""

from __future__ import annotations

import queue
import secrets
import socket
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext

from archlake.functions.source_text import mix64

#: seconds without a word from another task after which it is taken for lost
TIMEOUT = 900
#: steps of peeling in every turn
PEELS = 3
Parts = list[tuple[np.ndarray, ...]]


class Mesh:
    """One connection between every two tasks of a barrier stage."""

    def __init__(self, context: BarrierTaskContext):
        hosts = [x.address.rsplit(":", 1)[0].strip("[]") for x in context.getTaskInfos()]
        self.me, self.size = context.partitionId(), len(hosts)
        self.peers: dict[int, socket.socket] = {}
        self.todo: queue.SimpleQueue = queue.SimpleQueue()
        own, token = hosts[self.me], secrets.token_bytes(16)
        with socket.create_server((own, 0), family=socket.AF_INET6 if ":" in own else socket.AF_INET, backlog=self.size) as server:
            server.settimeout(TIMEOUT)
            known = [x.split() for x in context.allGather(f"{server.getsockname()[1]} {token.hex()}")]
            for q in range(self.me):
                self.peers[q] = socket.create_connection((hosts[q], int(known[q][0])), TIMEOUT)
                self.peers[q].sendall(bytes.fromhex(known[q][1]) + self.me.to_bytes(4, "little"))
            while len(self.peers) < self.size - 1:
                peer, _ = server.accept()
                peer.settimeout(TIMEOUT)
                hello = _take(peer, 20)
                if not secrets.compare_digest(bytes(hello[:16]), token):
                    peer.close()
                    continue
                self.peers[int.from_bytes(hello[16:], "little")] = peer
        for peer in self.peers.values():
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.sender = threading.Thread(target=self._send, daemon=True)
        self.sender.start()

    def _send(self) -> None:
        """In a thread of its own: all tasks send at once, and none may wait for another to read."""
        try:
            while (item := self.todo.get()) is not None:
                peer, arrays = item
                peer.sendall(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))
        except OSError:
            self.close()  # this task and whoever waits for it learn of it

    def exchange(self, parts: Parts) -> Parts:
        """parts[q] (64-bit arrays, equally many for every task) goes to task q; returns what each task sent to this one."""
        for q, peer in self.peers.items():
            self.todo.put((peer, parts[q]))
        got = list(parts)
        for q, peer in self.peers.items():
            sizes = np.frombuffer(_take(peer, 8 * len(parts[q])), np.int64)
            got[q] = tuple(np.frombuffer(_take(peer, 8 * int(n)), np.int64) for n in sizes)
        return got

    def total(self, n: int) -> int:
        return sum(int(x[0][0]) for x in self.exchange([(np.array([n], np.int64),)] * self.size))

    def end(self) -> None:
        """Sends what is left, then closes."""
        self.todo.put(None)
        self.sender.join()
        self.close()

    def close(self) -> None:
        for peer in self.peers.values():
            try:
                peer.shutdown(socket.SHUT_RDWR)
            except OSError:
                pass
            peer.close()


def _take(peer: socket.socket, n: int) -> bytearray:
    data = bytearray(n)
    view, at = memoryview(data), 0
    while at < n:
        got = peer.recv_into(view[at:])
        if not got:
            raise ConnectionError("another task of the stage is gone")
        at += got
    return data


class _Share:
    """The nodes of one task, and their edges by the task of the other end, in the same order in both tasks."""

    def __init__(self, mesh: Mesh, s: np.ndarray, f: np.ndarray, t: np.ndarray, peer: np.ndarray):
        self.mesh = mesh
        order = np.argsort(peer, kind="stable")
        to = np.split(order, np.searchsorted(peer[order], np.arange(1, mesh.size)))
        got = mesh.exchange([(s[e], t[e]) for e in to])
        all_s, all_v = np.concatenate([s, *[g[0] for g in got]]), np.concatenate([f, *[g[1] for g in got]])
        by = np.lexsort((all_v, all_s))
        x, y = all_s[by], all_v[by]
        new = np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        self.snapshot, self.node = x[new], y[new]
        index = np.empty(len(by), np.int64)
        index[by] = np.cumsum(new) - 1
        tails = index[: len(f)]
        #: per task: own ends and the other ends' places there, of edges from here and of edges to here
        self.tail = [tails[e] for e in to]
        self.head = np.split(index[len(f) :], np.cumsum([len(g[0]) for g in got])[:-1])
        got = mesh.exchange(list(zip(self.tail, self.head)))
        self.their_tail, self.their_head = [g[0] for g in got], [g[1] for g in got]

    def edges(self) -> int:
        """Of all tasks."""
        return self.mesh.total(sum(map(len, self.tail)))

    def keep(self, out: list[np.ndarray], into: list[np.ndarray]) -> None:
        self.tail, self.their_head = [a[k] for a, k in zip(self.tail, out)], [a[k] for a, k in zip(self.their_head, out)]
        self.head, self.their_tail = [a[k] for a, k in zip(self.head, into)], [a[k] for a, k in zip(self.their_tail, into)]

    def peel(self) -> None:
        """Drops edges from nodes without an edge in, and to nodes without an edge out."""
        n = len(self.node)
        has_in, has_out = np.zeros(n, bool), np.zeros(n, bool)
        for a in self.head:
            has_in[a] = True
        for a in self.tail:
            has_out[a] = True
        out, into = [has_in[a] for a in self.tail], [has_out[a] for a in self.head]
        got = self.mesh.exchange([(o.astype(np.int64), i.astype(np.int64)) for o, i in zip(out, into)])
        self.keep([o & (g[1] > 0) for o, g in zip(out, got)], [i & (g[0] > 0) for i, g in zip(into, got)])

    def labels(self, turn: int) -> np.ndarray:
        """Per node the smallest colour that reaches it and the smallest that it reaches. Colours are ids, shuffled one to one."""
        seed = np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        label = np.repeat(mix64(self.node.view(np.uint64) + seed).view(np.int64), 2)  # one at 2 x place, the other after it
        source = np.concatenate([np.concatenate([2 * t, 2 * h + 1]) for t, h in zip(self.tail, self.head)])
        target = np.concatenate([np.concatenate([2 * h, 2 * t + 1]) for h, t in zip(self.their_head, self.their_tail)])
        peer = np.repeat(np.arange(self.mesh.size), [len(t) + len(h) for t, h in zip(self.tail, self.head)])
        by = np.argsort(source, kind="stable")
        source, target, peer = source[by], target[by], peer[by]
        first = np.searchsorted(source, np.arange(len(label) + 1))
        fresh = np.unique(source)
        while True:
            many = first[fresh + 1] - first[fresh]
            at = np.repeat(first[fresh] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = at[np.argsort(peer[at], kind="stable")]
            cuts = np.searchsorted(peer[at], np.arange(1, self.mesh.size))
            parts = zip(np.split(target[at], cuts), np.split(label[source[at]], cuts))
            got = self.mesh.exchange([(*p, np.array([len(fresh)])) for p in parts])
            if not sum(int(g[2][0]) for g in got):
                return label.reshape(-1, 2)
            place, value = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            less = value < label[place]
            place, value = place[less], value[less]
            np.minimum.at(label, place, value)
            fresh = np.unique(place)

    def turn(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and colours of the nodes whose component of several nodes is found in this turn; drops their edges and those on no cycle."""
        label = self.labels(turn)
        mine = [(label[t], label[h]) for t, h in zip(self.tail, self.head)]
        got = self.mesh.exchange([(a[:, 0].copy(), a[:, 1].copy(), b[:, 0].copy(), b[:, 1].copy()) for a, b in mine])
        out = [(a[:, 0] == g[2]) & (a[:, 1] == g[3]) for (a, _), g in zip(mine, got)]
        into = [(b[:, 0] == g[0]) & (b[:, 1] == g[1]) for (_, b), g in zip(mine, got)]
        found = label[:, 0] == label[:, 1]
        members = np.unique(np.concatenate([a[k & found[a]] for a, k in zip([*self.tail, *self.head], [*out, *into])]))
        self.keep([k & ~found[a] for a, k in zip(self.tail, out)], [k & ~found[a] for a, k in zip(self.head, into)])
        return members, label[members, 0]


def spread_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """snapshot_id, v, turn, c of the nodes in components of several: equal (snapshot_id, turn, c) mean one component.

    ``batches``: snapshot_id, f, t and peer (task of ``t``) of the edges whose ``f`` belongs to this task. All tasks of the stage run this.
    """
    rows = list(batches)
    columns = [np.concatenate([np.zeros(0, np.int64), *[b.column(k).to_numpy(zero_copy_only=False) for b in rows]]) for k in range(4)]
    del rows
    mesh = Mesh(BarrierTaskContext.get())
    try:
        share, turn = _Share(mesh, *columns), 0
        del columns
        while True:
            for _ in range(PEELS):
                share.peel()
            if not share.edges():
                break
            members, colour = share.turn(turn)
            if len(members):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(share.snapshot[members]), pa.array(share.node[members]), pa.array(np.full(len(members), turn, np.int32)), pa.array(colour)], ["snapshot_id", "v", "turn", "c"]
                )
            turn += 1
        mesh.end()
    finally:
        mesh.close()
