"""Map files of nodes and ways in blocks (OSM PBF): blocks are found by their headers, decoded in parallel, and ways get their paths by a join.

Files are opened by pyarrow, so they lie in a store that it knows.  Relations are passed over.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import Message, fields, packed, steps, sums, unpacked, unzigzag
from ..operators.durable import written
from .files import opened, saved

#: Units of a degree in a file, entities of a block, and bytes of a header and of a block at most (fixed values of the format).
PER_DEGREE, BLOCK, HEADER_BYTES, BLOCK_BYTES = 10_000_000, 8000, 64 << 10, 32 << 20
ELEMENT = "kind string, id bigint, tags map<string, string>, lon double, lat double, refs array<bigint>"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path of every map file in a folder, by Spark's own listing; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pbf").load(folder).select("path")


def blob_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, at, size of each data block: only the headers are read, and the blocks skipped."""
    for batch in batches:
        for path in batch["path"]:
            with opened(path) as file:
                at, end, found = 0, file.size(), []
                while at + 4 <= end:
                    file.seek(at)
                    n = struct.unpack(">I", file.read(4))[0]
                    if n > HEADER_BYTES:
                        raise ValueError(f"{path} is no map file: a header of {n} bytes at {at}")
                    header = dict(fields(file.read(n)))
                    size = header[3]
                    if bytes(header[1]) == b"OSMData":
                        found.append((path, at + 4 + n, size))
                    at += 4 + n + size
            yield pd.DataFrame(found, columns=["path", "at", "size"])


def content(blob: bytes) -> bytes:
    """A block, packed or plain."""
    parts = dict(fields(blob))
    if 1 in parts:
        return bytes(parts[1])
    if 3 in parts:
        return zlib.decompress(bytes(parts[3]))
    raise ValueError("only plain and zlib blocks are read")


def all_of(message, field: int) -> list:
    return [v for k, v in fields(message) if k == field]


def numbers(message: dict, field: int) -> np.ndarray:
    return unpacked(bytes(message.get(field, b"")))


def elements_of(block: bytes) -> Iterator[tuple]:
    """(kind, id, tags, lon, lat, refs) of a block's nodes and ways."""
    parts = dict(fields(block))
    words = [bytes(w).decode("utf-8", "replace") for w in all_of(parts[1], 1)]
    unit, lat0, lon0 = parts.get(17, 100), signed64(parts.get(19, 0)), signed64(parts.get(20, 0))
    degrees = lambda v, origin: (origin + unit * v.astype(np.float64)) / 1e9
    tagged = lambda m: {words[k]: words[v] for k, v in zip(numbers(m, 2).tolist(), numbers(m, 3).tolist(), strict=True)}
    for group in all_of(block, 2):
        for kind, body in fields(group):
            if kind == 1:
                m = dict(fields(body))
                lat, lon = (float(degrees(unzigzag(np.array([m[f]], np.uint64)), o)[0]) for f, o in ((8, lat0), (9, lon0)))
                yield "node", int(unzigzag(np.array([m[1]], np.uint64))[0]), tagged(m), lon, lat, None
            elif kind == 2:
                m = dict(fields(body))
                ids, lats, lons = (sums(bytes(m.get(f, b""))) for f in (1, 8, 9))
                tags = dense_tags(numbers(m, 10).tolist(), words, len(ids))
                yield from zip(["node"] * len(ids), ids.tolist(), tags, degrees(lons, lon0).tolist(), degrees(lats, lat0).tolist(), [None] * len(ids), strict=True)
            elif kind == 3:
                m = dict(fields(body))
                yield "way", m[1], tagged(m), None, None, sums(bytes(m.get(8, b""))).tolist()


def signed64(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def dense_tags(said: list[int], words: list[str], n: int) -> list[dict]:
    """Key and value numbers of one node after the other, each ended by a 0; none at all if no node has tags."""
    out, own, at = [], {}, 0
    while at < len(said):
        if said[at]:
            own[words[said[at]]] = words[said[at + 1]]
            at += 2
        else:
            out.append(own)
            own, at = {}, at + 1
    return out or [{}] * n


def read_raw(paths: DataFrame) -> DataFrame:
    """kind (node, way), id, tags, lon, lat, refs of the map files at path; blocks are dealt out, so one large file is read by all tasks."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at, size in batch[["path", "at", "size"]].itertuples(index=False):
                with opened(path) as file:
                    file.seek(at)
                    block = content(file.read(size))
                yield pd.DataFrame(elements_of(block), columns=["kind", "id", "tags", "lon", "lat", "refs"])

    places = paths.select("path").mapInPandas(blob_places, "path string, at bigint, size bigint")
    # A number of its own: places are so few bytes that adaptive execution would bring them all into one task.
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(tasks, "path", "at").mapInPandas(decode, ELEMENT)


def read_elements(paths: DataFrame) -> DataFrame:
    """kind, id, tags, path, lon, lat, center (null), whole: nodes with tags, and ways with the places of their nodes in order.

    whole tells that no node of the way is missing from the files.  Of a node or way that is repeated one counts.
    """
    raw = written(read_raw(paths), "map-elements")
    nodes = raw.where("kind = 'node'").dropDuplicates(["id"])
    ways = raw.where("kind = 'way'").dropDuplicates(["id"])
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    at = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref", "left")
    paths_of = at.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("lon").isNotNull(), F.struct("pos", F.col("lon").alias("lng"), "lat")))).alias("v"), F.count_if(F.col("lon").isNull()).alias("lost"))
    path = F.transform(F.coalesce("v", F.array()), lambda v: F.struct(v["lng"].alias("lng"), v["lat"].alias("lat")))
    none = "array<struct<lng: double, lat: double>>"
    center = F.lit(None).cast("struct<lng: double, lat: double>").alias("center")
    drawn = ways.join(paths_of, "id", "left").select("kind", "id", "tags", path.alias("path"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), center, (F.coalesce("lost", F.lit(0)) == 0).alias("whole"))
    alone = nodes.where("size(tags) > 0").select("kind", "id", "tags", F.array().cast(none).alias("path"), "lon", "lat", center, F.lit(True).alias("whole"))
    return drawn.unionByName(alone)


class Words:
    """The text table of a block; number 0 is no text."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}

    def of(self, texts) -> list[int]:
        return [self.number.setdefault(t, len(self.number)) for t in texts]

    def message(self) -> Message:
        out = Message()
        for t in self.number:
            out.text(1, t)
        return out


def block_of(part: pd.DataFrame) -> bytes:
    """A block of up to BLOCK nodes, densely, and ways."""
    words, group = Words(), Message()
    nodes, ways = part[part["kind"] == "node"], part[part["kind"] == "way"]
    if len(nodes):
        units = lambda c: np.rint(nodes[c].to_numpy(dtype=np.float64) * PER_DEGREE).astype(np.int64)
        said = [n for tags in nodes["tags"] for n in (*(x for k, v in (tags or {}).items() for x in words.of((k, v))), 0)]
        group.data(2, Message().data(1, steps(nodes["id"])).data(8, steps(units("lat"))).data(9, steps(units("lon"))).data(10, packed(said)))
    for id_, tags, refs in zip(ways["id"], ways["tags"], ways["refs"], strict=True):
        keys, values = words.of(tags or {}), words.of((tags or {}).values())
        group.data(3, Message().number(1, int(id_)).data(2, packed(keys)).data(3, packed(values)).data(8, steps(refs)))
    return Message().data(1, words.message()).data(2, group).bytes()


def blocks_of(part: pd.DataFrame) -> Iterator[bytes]:
    """One block, or as many as it takes for none to be too long."""
    body = block_of(part)
    if len(body) <= BLOCK_BYTES or len(part) == 1:
        yield body
    else:
        half = len(part) // 2
        yield from blocks_of(part.iloc[:half])
        yield from blocks_of(part.iloc[half:])


def framed(kind: str, body: bytes) -> bytes:
    """A block with its header in front."""
    if len(body) > BLOCK_BYTES:
        raise ValueError(f"an element of {len(body)} bytes fits no block")
    blob = Message().number(2, len(body)).data(3, zlib.compress(body)).bytes()
    header = Message().text(1, kind).number(3, len(blob)).bytes()
    return struct.pack(">I", len(header)) + header + blob


def write(elements: DataFrame, folder: str) -> int:
    """Write elements (kind, id, tags, lon, lat, refs) as one map file a task, in blocks; gives how many elements.

    A file has the number of its task, so a task that runs again replaces its own file.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        with saved(f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.osm.pbf") as out:
            out.write(framed("OSMHeader", Message().text(4, "OsmSchema-V0.6").text(4, "DenseNodes").bytes()))
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    for body in blocks_of(batch.iloc[at : at + BLOCK]):
                        out.write(framed("OSMData", body))
                n += len(batch)
        yield pd.DataFrame({"n": [n]})

    rows = elements.select("kind", "id", "tags", "lon", "lat", "refs")
    return rows.mapInPandas(save, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
