"""Data sources of two record files: hands' chunks as JSON documents, trajectories as numpy archives.

    register(spark)
    spark.read.format("hand_chunks").load(folder)
    spark.read.format("trajectory_records").load(folder)

A file is read whole by one task, as it is one document. Few files are a partition each; of many, those that follow each
other go together, by size, so that tasks grow with the bytes and not with the files. Files are listed in natural order.
A file that can't be read fails the query with its name, or is left out with option("corrupt", "skip").
Paths may be any that pyarrow's file systems open. Rows are written as one file each, under a name of its own that is
changed to the final one when the file is complete, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

JOINTS = 15
#: Up to so many files are a partition each; more are dealt to as many partitions at least, of about PARTITION bytes,
#: where opening a file counts as OPEN bytes.
ALONE, PARTITION, OPEN = 32, 1 << 26, 1 << 18


def natural(name: str) -> list:
    """A key by which 2_9 comes before 10_19."""
    return [int(part) if part.isdigit() else part for part in re.split(r"(\d+)", name)]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path with or without a scheme, as file system and path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str, suffix: str) -> list[str]:
    return [f.path for f in _found(path, suffix)]


def _found(path: str, suffix: str) -> list[fs.FileInfo]:
    system, base = opened(path)
    if system.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)), key=lambda f: natural(f.path))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Partitions of whole files; rows() makes the rows of one file from its bytes."""

    suffix = ""

    def __init__(self, options: dict):
        self.path, self.skip = options["path"], options.get("corrupt", "fail").lower() == "skip"

    def partitions(self) -> list[_Files]:
        found = _found(self.path, self.suffix)
        if len(found) <= ALONE:
            return [_Files([f.path]) for f in found]
        cost = np.array([f.size + OPEN for f in found])
        n = max(ALONE, -(-int(cost.sum()) // PARTITION))
        # a file goes where its middle lies
        place = ((np.cumsum(cost) - cost / 2) * n / cost.sum()).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        return [_Files([f.path for f in found[a:b]]) for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as file:
                    rows = self.rows(path, file.read())
            except Exception as wrong:
                if self.skip:
                    continue
                raise ValueError(f"{path} can't be read: {wrong}") from wrong
            yield from rows


class _Writer(DataSourceWriter):
    """A file a row; content() gives its name below the folder and its bytes."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.fields = options["path"], None
        system, base = opened(self.path)
        if overwrite and system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir_contents(base)
        system.create_dir(base, recursive=True)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, base = opened(self.path)
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for row in iterator:
            name, content = self.content(row)
            place = f"{base.rstrip('/')}/{name}"
            parent = place.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(f"{place}.{attempt}.part") as out:
                out.write(content)
            system.move(f"{place}.{attempt}.part", place)
        return WriterCommitMessage()


class ChunkReader(_Reader):
    suffix = ".json"

    def rows(self, path: str, data: bytes) -> list[tuple]:
        named = re.search(r"([^/]+)/(\d+)_(\d+)\.json$", path)
        if not named:
            raise ValueError("the name has to be <track>/<start>_<end>.json")
        track, start, end = named[1], int(named[2]), int(named[3])
        record = json.loads(data)
        # axes of length 1 in front are left out or kept by the writers
        root = np.array(record["init_root_orient"], float).reshape(-1, 3, 3)
        pose = np.array(record["init_hand_pose"], float).reshape(-1, JOINTS, 3, 3)
        trans = np.array(record["init_trans"], float).reshape(-1, 3)
        betas = np.array(record["init_betas"], float)
        betas = betas.reshape(-1, betas.shape[-1])
        n = len(root)
        betas = np.repeat(betas, n, axis=0) if len(betas) == 1 else betas
        if not len(pose) == len(trans) == len(betas) == n:
            raise ValueError(f"{n} orientations, {len(pose)} poses, {len(trans)} places, {len(betas)} shapes")
        return list(zip([track] * n, [start] * n, [end] * n, range(start, start + n), root.tolist(), pose.tolist(), trans.tolist(), betas.tolist(), strict=True))


class ChunkWriter(_Writer):
    def content(self, row) -> tuple[str, bytes]:
        record = {name: [row[name.removeprefix("init_")]] for name in ("init_root_orient", "init_hand_pose", "init_trans", "init_betas")}
        return f"{row['track']}/{row['start']}_{row['end']}.json", json.dumps(record).encode()


class HandChunks(DataSource):
    """Frames of chunk files <track>/<start>_<end>.json: camera-space orientation, pose, place and shape of a hand.

    One row of betas serves all frames. To write: a row a chunk (track, start, end, root_orient, hand_pose, trans, betas), arrays over the frames.
    """

    @classmethod
    def name(cls) -> str:
        return "hand_chunks"

    def schema(self) -> str:
        return "track string, start long, end long, frame long, root_orient array<array<double>>, hand_pose array<array<array<double>>>, trans array<double>, betas array<double>"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options, overwrite)


class TrajectoryReader(_Reader):
    suffix = ".npz"

    def rows(self, path: str, data: bytes) -> list[tuple]:
        with np.load(io.BytesIO(data), allow_pickle=False) as record:
            poses, scale = np.asarray(record["traj"], float), float(np.asarray(record["scale"]).reshape(-1)[0])
        if poses.ndim != 2 or poses.shape[1] != 7:
            raise ValueError(f"traj has the shape {poses.shape}, not (n, 7)")
        name = path.rpartition("/")[2].removesuffix(self.suffix)
        return [(name, i, pose, scale) for i, pose in enumerate(poses.tolist())]


class TrajectoryWriter(_Writer):
    def content(self, row) -> tuple[str, bytes]:
        out = io.BytesIO()
        np.savez(out, traj=np.array(row["traj"], float).reshape(-1, 7), scale=float(row["scale"]))
        return f"{row['name']}.npz", out.getvalue()


class TrajectoryRecords(DataSource):
    """Poses (tx ty tz qx qy qz qw, the translation not scaled yet) and the scale of archives <name>.npz.

    functions.rigid.from_trajectory makes them rigid transforms. To write: a row a file (name, traj, scale).
    """

    @classmethod
    def name(cls) -> str:
        return "trajectory_records"

    def schema(self) -> str:
        return "name string, row long, pose array<double>, scale double"

    def reader(self, schema) -> TrajectoryReader:
        return TrajectoryReader(self.options)

    def writer(self, schema, overwrite: bool) -> TrajectoryWriter:
        return TrajectoryWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    for source in (HandChunks, TrajectoryRecords):
        spark.dataSource.register(source)
