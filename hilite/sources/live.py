"""Live chat: its wire format, its messages, and a streaming source of them."""

import json
import socket
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The type of a client's message, and the keys of the two kinds of chat in the order of the result.
CLIENT = 0x2B1
KEYS = {"chatmsg": ("rid", "uid", "nn", "txt", "cid", "level"), "chatmessage": ("rid", "sender", "snick", "content", "chatmsgid", "level")}
COLUMNS = ("rid", "uid", "nn", "txt", "cid", "level")


def unescaped(text: Column) -> Column:
    """``@A`` is ``@`` and then ``@S`` is ``/``."""
    return F.replace(F.replace(text, F.lit("@A"), F.lit("@")), F.lit("@S"), F.lit("/"))


def framed(body: str) -> bytes:
    """A message as it goes over the wire: its length twice, its type, the body and a zero byte."""
    data = body.encode() + b"\0"
    return struct.pack("<IIHH", len(data) + 8, len(data) + 8, CLIENT, 0) + data


def unframed(data: bytes) -> tuple[list[str], bytes]:
    """The bodies of the whole messages in data, and what is left of the last."""
    out = []
    while len(data) >= 4:
        size = struct.unpack_from("<I", data)[0] + 4
        if size < 13 or len(data) < size:
            break
        out.append(data[12 : size - 1].decode("utf-8", "ignore"))
        data = data[size:]
    return out, data


def parsed(messages: DataFrame, raw: str, received: str) -> DataFrame:
    """(recv_time, rid, uid, nn, txt, cid, level) of chat messages; other kinds, and messages that lack a key, are left out."""
    kind = F.regexp_extract(raw, r"(?:^|/)type@=([^/]*)", 1)

    def value(i: int) -> Column:
        out = None
        for name, keys in KEYS.items():
            pattern = rf"(?:^|/){keys[i]}@=([^/]*)"
            got = F.when(F.col(raw).rlike(pattern), unescaped(F.regexp_extract(raw, pattern, 1)))
            out = F.when(kind == name, got) if out is None else out.when(kind == name, got)
        return out

    rows = messages.select(F.col(received).cast("double").alias("recv_time"), *(value(i).alias(c) for i, c in enumerate(COLUMNS)))
    complete = F.lit(True)
    for c in COLUMNS:
        complete = complete & F.col(c).isNotNull()
    return rows.where(complete)


class Spool:
    """Messages in files of a folder, each named by the numbers of its first message and of the one after its last."""

    def __init__(self, folder: str):
        self.fs, self.folder = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.fs.create_dir(self.folder)

    def files(self) -> list[tuple[int, int, str]]:
        found = self.fs.get_file_info(FileSelector(self.folder))
        names = [f.path for f in found if f.path.endswith(".json")]
        return sorted((*map(int, n.rsplit("/", 1)[1][:-5].split("-")), n) for n in names)

    def append(self, first: int, messages: list[tuple[float, str]]) -> int:
        """Write messages, whole or not at all, and give the number after the last."""
        end = first + len(messages)
        name = f"{self.folder}/{first:020d}-{end:020d}.json"
        with self.fs.open_output_stream(name + ".part") as out:
            out.write("\n".join(json.dumps(m) for m in messages).encode())
        self.fs.move(name + ".part", name)
        return end

    def parts(self, start: int, end: int) -> list["Part"]:
        """The files' parts that make up the messages from start to before end; an error if any of these is gone."""
        parts, at = [], start
        for first, last, name in self.files():
            if first <= at < last and at < end:
                parts.append(Part(self.folder, name, at - first, min(last, end) - first))
                at = min(last, end)
        if at < end:
            raise ValueError(f"messages {at} to {end} of the chat are no longer there")
        return parts

    def drop(self, end: int) -> None:
        """Delete files of messages before end; the last stays, as it tells the next number."""
        for _, last, name in self.files()[:-1]:
            if last <= end:
                self.fs.delete_file(name)


@dataclass
class Part(InputPartition):
    """Messages from one place to before another in a file of a spool."""

    folder: str
    name: str
    begin: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.address = options.get("host", "127.0.0.1"), int(options.get("port", "8601"))
        self.hello = [x for x in options.get("hello", "").split("|") if x]
        self.wait, self.most = float(options.get("wait", "0.5")), int(options.get("most", "100000"))
        if not options.get("spool"):
            raise ValueError("the option spool must name a folder that outlives the driver and that all executors share")
        self.folder = options["spool"] if "://" in options["spool"] else f"file://{options['spool']}"
        self.socket: socket.socket | None = None
        self.rest, self.beat, self.end = b"", 0.0, None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _connected(self) -> socket.socket:
        if self.socket is None:
            self.socket, self.rest = socket.create_connection(self.address, 10), b""
            for x in self.hello:
                self.socket.sendall(framed(x))
        if time.time() - self.beat > 40:
            self.beat = time.time()
            self.socket.sendall(framed(f"type@=keeplive/tick@={int(self.beat)}/"))
        return self.socket

    def _receive(self) -> list[tuple[float, str]]:
        """What comes within wait seconds, most messages at most. A connection that ends is made again the next time."""
        out, until = [], time.time() + self.wait
        try:
            while len(out) < self.most and (left := until - time.time()) > 0:
                connection = self._connected()
                connection.settimeout(left)
                data = connection.recv(65536)
                if not data:
                    raise ConnectionError
                bodies, self.rest = unframed(self.rest + data)
                out += [(time.time(), b) for b in bodies]
        except TimeoutError:
            pass
        except OSError:
            if self.socket:
                self.socket.close()
            self.socket = None
        return out

    def latestOffset(self) -> dict:
        spool = Spool(self.folder)
        if self.end is None:
            self.end = max((last for _, last, _ in spool.files()), default=0)
        if got := self._receive():
            self.end = spool.append(self.end, got)
        return {"n": self.end}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return Spool(self.folder).parts(start["n"], end["n"])

    def read(self, partition: Part) -> Iterator[tuple]:
        with Spool(self.folder).fs.open_input_stream(partition.name) as f:
            lines = f.read().decode().split("\n")
        return iter([tuple(json.loads(x)) for x in lines[partition.begin : partition.end]])

    def commit(self, end: dict) -> None:
        Spool(self.folder).drop(end["n"])


class LiveChat(DataSource):
    """spark.dataSource.register(LiveChat); spark.readStream.format("livechat") with options host, port, spool, hello (messages divided by |), wait and most.

    Messages are written to spool, a folder that outlives the driver and that all executors share, before their offset
    is told; they are read from there, by the executors, also again after a failure or a restart, and deleted once they
    are committed. A batch takes what comes in wait seconds, most messages at most, so a busy chat ends none of them.
    A connection that is closed is made again. Messages that are no longer there are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "livechat"

    def schema(self) -> str:
        return "recv_time double, raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
