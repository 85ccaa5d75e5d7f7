"""A Spark data source of header-plus-binary recordings, split by ranges of frames.

``spark.read.format("binary_frames").option("path", folder).option("blockSize", n)``
reads the headers of a folder on the driver; a recording becomes as many
partitions as ``partitionBytes`` asks for (or ``partitions``), each of whole
blocks, and each reads only its own bytes: one range of a multiplexed file, one
range per channel of a vectorized one.  A worker holds one block at a time, so
recordings may have any size.  Paths go to the file systems that pyarrow knows
(local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "recording string, sfreq double, start long, channels array<string>, data array<array<double>>"
#: Fixed values of the header format.
SAMPLE_TYPES = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}
VOLTS = {"V": 1.0, "mV": 1e-3, "µV": 1e-6, "uV": 1e-6, "nV": 1e-9, "": 1e-6}


def parse_header(text: str) -> dict:
    """The fields of a header that reading needs."""
    sections: dict[str, dict[str, str]] = {}
    own: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            own = sections.setdefault(line[1:-1], {})
        elif line and not line.startswith(";") and "=" in line:
            key, value = line.split("=", 1)
            own[key.strip()] = value.strip()
    common, channels = sections["Common Infos"], []
    for i in range(int(common["NumberOfChannels"])):
        part = [x.replace(r"\1", ",") for x in sections["Channel Infos"][f"Ch{i + 1}"].split(",")] + ["", "", ""]
        channels.append((part[0], float(part[2] or 1.0) * VOLTS.get(part[3].strip(), 1e-6)))
    return {
        "data_file": common["DataFile"],
        "sfreq": 1e6 / float(common["SamplingInterval"]),
        "vectorized": common.get("DataOrientation", "MULTIPLEXED").upper() == "VECTORIZED",
        "dtype": SAMPLE_TYPES[sections["Binary Infos"]["BinaryFormat"].upper()],
        "channels": [c for c, _ in channels],
        "scale": [s for _, s in channels],
    }


@dataclass
class Frames(InputPartition):
    """Frames ``start`` to ``stop`` of one data file of ``total`` frames."""

    recording: str
    path: str
    header: dict
    total: int
    start: int
    stop: int


def frame_ranges(total: int, block: int, per_partition: int) -> list[tuple[int, int]]:
    """Ranges of whole blocks that cover all frames."""
    step = max(1, per_partition // block) * block
    return [(at, min(at + step, total)) for at in range(0, total, step)]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.block = options["path"], int(options["blocksize"])
        if self.block < 1:
            raise ValueError("blockSize is at least 1")
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.number = int(options.get("partitions", 0))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        store, base = self._store()
        files = {f.base_name: f for f in store.get_file_info(fs.FileSelector(base)) if f.is_file}
        out: list[InputPartition] = []
        for name in sorted(f for f in files if f.endswith(".vhdr")):
            with store.open_input_stream(files[name].path) as source:
                header = parse_header(source.read().decode("utf-8", "replace"))
            if header["data_file"] not in files:
                continue
            data = files[header["data_file"]]
            frame = len(header["channels"]) * np.dtype(header["dtype"]).itemsize
            total = data.size // frame
            per = -(-total // self.number) if self.number else self.bytes // frame
            per = max(self.block, -(-per // self.block) * self.block if self.number else per)
            out += [Frames(name.removesuffix(".vhdr"), data.path, header, total, a, b) for a, b in frame_ranges(total, self.block, per)]
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without recordings
            return
        store, _ = self._store()
        h, n = partition.header, len(partition.header["channels"])
        kind, scale = np.dtype(h["dtype"]), np.asarray(h["scale"])[:, None]
        values = pa.list_(pa.list_(pa.float64()))
        with store.open_input_file(partition.path) as source:

            def samples(first: int, count: int) -> np.ndarray:
                source.seek(first * kind.itemsize)
                return np.frombuffer(source.read(count * kind.itemsize), kind)

            for at in range(partition.start, partition.stop, self.block):
                size = min(self.block, partition.stop - at)
                if h["vectorized"]:
                    x = np.stack([samples(c * partition.total + at, size) for c in range(n)])
                else:
                    x = samples(at * n, size * n).reshape(size, n).T
                flat = pa.array(np.ascontiguousarray(x * scale).ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), flat)
                data = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows).cast(values)
                columns = [pa.array([partition.recording]), pa.array([h["sfreq"]]), pa.array([at], pa.int64()), pa.array([h["channels"]], pa.list_(pa.string())), data]
                yield pa.RecordBatch.from_arrays(columns, names=["recording", "sfreq", "start", "channels", "data"])


class BinaryFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader({k.lower(): v for k, v in self.options.items()})
