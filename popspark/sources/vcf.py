"""VCF files as a data source: spark.read.format("popspark_vcf") and df.write.format("popspark_vcf").

Files are read by splits. A line is cut into fields, but only the samples asked for are looked at. Parts are written by
the tasks where they are; the header is a file of its own, and names in order make one VCF file of the folder.
"""

from __future__ import annotations

import gzip
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from popspark.sources.shared import ship

#: Fixed values of the format.
HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=1,length=1000000>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
CODES = [b"0/0", b"0/1", b"1/1"]
FIXED = {"chrom": 0, "position": 1, "id": 2, "ref": 3, "alt": 4, "qual": 5, "filter": 6, "info": 7}

LONG = "ind_id bigint, position bigint, g bigint"
#: Bytes of a split, and lines in a batch.
SPLIT, LINES = 64 << 20, 2000
#: Genotypes in a block of a compressed file, at four bytes each; rows in a batch of carriers.
CELLS, ROWS = 16_000, 50_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def _lines(split: Split) -> Iterator[bytes]:
    """The lines that begin within a split; of a compressed file the only split has all."""
    if split.path.endswith(".gz"):
        yield from _packed_lines(split.path)
        return
    system, path = _place(split.path)
    with system.open_input_file(path) as f:
        at = split.start
        f.seek(max(0, at - 1))
        rest, first = b"", at > 0
        while chunk := f.read(1 << 20):
            lines = (rest + chunk).split(b"\n")
            rest = lines.pop()
            if first and lines:  # the end of a line that the split before has, or the end of that line alone
                at += len(lines[0])
                lines, first = lines[1:], False
            for line in lines:
                if at >= split.end:
                    return
                yield line
                at += len(line) + 1
        if rest and not first and at < split.end:
            yield rest


def _block(data: bytes) -> bytes:
    """data, at most 64 KB, as a block of the BGZF format, which is gzip."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


def _unpacked(f) -> Iterator[bytes]:
    """The bytes of a gzip file. Blocks of BGZF that came before, as those without a carrier do, are looked up."""
    head, known = f.read(18), {}
    if head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x06\x00BC\x02\x00":
        f.seek(0)
        with gzip.GzipFile(fileobj=f) as g:
            while chunk := g.read(1 << 20):
                yield chunk
        return
    while len(head) == 18:
        body = f.read(struct.unpack("<H", head[16:])[0] - 17)
        data = known.get(body)
        if data is None:
            data = zlib.decompress(body[:-8], -15, 1 << 16)
            if zlib.crc32(data) != struct.unpack("<I", body[-8:-4])[0]:
                raise ValueError("a block is damaged")
            if len(body) < 512 and len(known) < 64:
                known[body] = data
        yield data
        head = f.read(18)


def _packed_lines(path: str) -> Iterator[bytes]:
    """The lines of a compressed file."""
    system, local = _place(path)
    with system.open_input_file(local) as f:
        rest: list[bytes] = []
        for data in _unpacked(f):
            first, *more = data.split(b"\n")
            rest.append(first)
            for x in more:
                yield b"".join(rest)
                rest = [x]
        if last := b"".join(rest):
            yield last


def dosage(field: bytes) -> int | None:
    """The sum of two alleles that are 0 or else; null if one is missing."""
    a, b = field[:1], field[2:3]
    return None if a in (b".", b"") or b in (b".", b"") else (a != b"0") + (b != b"0")


class VcfReader(DataSourceReader):
    """Long layout: a row for each sample asked for and site. Wide: a row for each site with the columns of the schema alone."""

    def __init__(self, schema: StructType, options: dict):
        self.fields, self.long = [f.name for f in schema.fields], options.get("layout", "long") == "long"
        self.kinds = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in schema.fields])
        self.files, self.names = listed(options["path"]), None
        self.split, self.carriers = int(options.get("splitbytes", SPLIT)), self.long and options.get("carriers", "false") == "true"
        self.names = sample_names(self.files)
        wanted = options.get("samples")
        self.wanted = [self.names.index(x.strip()) for x in wanted.split(",")] if wanted else list(range(len(self.names)))

    def partitions(self) -> list[InputPartition]:
        return [Split(path, at, min(at + self.split, size)) for path, size in self.files for at in range(0, size, size if path.endswith(".gz") else self.split) if size]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if self.carriers:
            yield from self._carriers(partition)
            return
        held: list[list[bytes]] = []
        for line in _lines(partition):
            if line and not line.startswith(b"#"):
                held.append(line.rstrip(b"\r").split(b"\t"))
                if len(held) >= LINES:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _carriers(self, partition: Split) -> Iterator[pa.RecordBatch]:
        """Rows of dosages over 0. Where all fields have three bytes, those that aren't 0/0 are found at once."""
        zero, wanted = np.frombuffer(b"0/0\t", "<u4")[0], np.isin(np.arange(len(self.names)), self.wanted)
        held: list[tuple[int, int, int]] = []
        for line in _lines(partition):
            if not line or line.startswith(b"#"):
                continue
            fields = (line.rstrip(b"\r") + b"\t").split(b"\t", 9)
            position, cells = int(fields[1]), fields[9] if len(fields) > 9 else b""
            found = np.frombuffer(cells, "<u4") if len(cells) == 4 * len(self.names) else None
            if found is not None and (found >> 24 == 9).all() and cells.count(b"\t") == len(self.names):
                each = [(k, cells[4 * k : 4 * k + 3]) for k in np.flatnonzero((found != zero) & wanted).tolist()]
            else:
                own = cells.split(b"\t")
                each = [(k, own[k]) for k in self.wanted]
            held += [(k + 1, position, g) for k, x in each if (g := dosage(x))]
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=self.kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=self.kinds)

    def _batch(self, rows: list[list[bytes]]) -> pa.RecordBatch:
        if self.long:
            at = np.repeat(np.array([int(r[1]) for r in rows], np.int64), len(self.wanted))
            ids = np.tile(np.array(self.wanted, np.int64) + 1, len(rows))
            g = [dosage(r[9 + k]) for r in rows for k in self.wanted]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(g, pa.int64())], schema=self.kinds)
        columns = []
        for name, kind in zip(self.fields, self.kinds.types):
            if name in FIXED:
                cells = [r[FIXED[name]].decode() for r in rows]
                columns.append(pa.array(list(map(int, cells)) if pa.types.is_integer(kind) else cells, kind))
            else:
                k = 9 + self.names.index(name)
                columns.append(pa.array([dosage(r[k]) for r in rows], kind))
        return pa.RecordBatch.from_arrays(columns, schema=self.kinds)


def listed(path: str) -> list[tuple[str, int]]:
    """The files of a path in order of their names, with their sizes; hidden ones are left out."""
    system, local = _place(path)
    info = system.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(local))
    files = sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return [(f"{scheme}{p}", n) for p, n in files]


def sample_names(files: list[tuple[str, int]]) -> list[str]:
    """The names in the line of columns, which one of the files has."""
    for path, size in files:
        for line in _lines(Split(path, 0, size)):
            if line.startswith(b"#CHROM"):
                return line.rstrip(b"\r").decode().split("\t")[len(COLUMNS) :]
            if not line.startswith(b"#"):
                break
    raise ValueError("no file has a line of columns")


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    first: int
    last: int


class VcfWriter(DataSourceArrowWriter):
    """Rows (ind_id, position, g) of a task, ascending by position, become the lines of one part; absent genotypes are 0/0."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.ids = [int(x) for x in options["individuals"].split(",")] if options.get("individuals") else []
        self.run, self.packed = uuid.uuid4().hex, options.get("compression", "none") == "bgzf"
        self.end = ".vcf.gz" if self.packed else ".vcf"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, local = _place(self.path)
        name, place = f"_part-{self.run}-{uuid.uuid4().hex}", {x: k for k, x in enumerate(self.ids)}
        first, now, cells, changed, short = None, None, bytearray(b"\t0/0" * len(self.ids)), [], []
        zeros = {}  # blocks without a carrier by their length
        system.create_dir(local, recursive=True)
        with system.open_output_stream(posixpath.join(local, name)) as out:

            def pushed() -> None:
                if short:
                    out.write(_block(b"".join(short)))
                    short.clear()

            def flush() -> None:
                if now is None:
                    return
                head = b"1\t%d\t.\tA\tT\t.\tPASS\t.\tGT" % now
                if not self.packed:
                    out.write(head + cells + b"\n")
                elif len(cells) < CELLS:
                    short.append(head + cells + b"\n")
                    if sum(map(len, short)) > 2 * CELLS:
                        pushed()
                else:
                    short.append(head)
                    pushed()
                    touched = {k // CELLS for k in changed}
                    for k in range(0, len(self.ids), CELLS):
                        piece = cells[4 * k : 4 * (k + CELLS)]
                        if k // CELLS in touched:
                            out.write(_block(bytes(piece)))
                        else:
                            if len(piece) not in zeros:
                                zeros[len(piece)] = _block(bytes(piece))
                            out.write(zeros[len(piece)])
                    short.append(b"\n")
                for k in changed:
                    cells[4 * k + 1 : 4 * k + 4] = CODES[0]
                changed.clear()

            for batch in iterator:
                at = {c: batch.column(c).to_pylist() for c in ("ind_id", "position", "g")}
                for i, position, g in zip(at["ind_id"], at["position"], at["g"]):
                    if position != now:
                        if now is not None and position < now:
                            raise ValueError("rows of a task must ascend by position")
                        flush()
                        first, now = position if first is None else first, position
                    if i is not None:
                        k = place[i]
                        cells[4 * k + 1 : 4 * k + 4] = CODES[min(g, 2)]
                        changed.append(k)
            flush()
            pushed()
        return Part(name, first, now) if first is not None else Part(name, -1, -1)

    def commit(self, messages: list[Part | None]) -> None:
        system, local = _place(self.path)
        old = [f for f in system.get_file_info(pafs.FileSelector(local)) if f.type == pafs.FileType.File and not f.base_name.startswith(f"_part-{self.run}")]
        if old and not self.overwrite:
            raise ValueError(f"{self.path} isn't empty; overwrite it or take another folder")
        parts = sorted((m for m in messages if m is not None and m.first >= 0), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts, parts[1:])):
            raise ValueError("two tasks have the same positions; deal rows out by ranges of position")
        for f in old:
            system.delete_file(f.path)
        with system.open_output_stream(posixpath.join(local, f"part-00000-header{self.end}"), compression=None) as out:
            head = "\n".join([*HEAD, "\t".join([*COLUMNS, *(f"IND{x}" for x in self.ids)])]).encode() + b"\n"
            for k in range(0, len(head), 4 * CELLS if self.packed else len(head)):
                out.write(_block(head[k : k + 4 * CELLS]) if self.packed else head)
        for k, m in enumerate(parts, 1):
            system.move(posixpath.join(local, m.name), posixpath.join(local, f"part-{k:05d}{self.end}"))
        self._sweep()

    def abort(self, messages: list[Part | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Delete what tasks of this run left: empty parts, and those of tries that failed."""
        system, local = _place(self.path)
        if system.get_file_info(local).type == pafs.FileType.Directory:
            for f in system.get_file_info(pafs.FileSelector(local)):
                if f.base_name.startswith(f"_part-{self.run}"):
                    system.delete_file(f.path)


class VcfSource(DataSource):
    """Options to read: path, layout (long or wide), samples (names, by comma; all if not given), splitBytes, carriers (true: of the long layout only dosages over 0). To write: path, individuals (ids in order, by comma), compression (bgzf, or none).

    The wide layout has the columns chrom, position, id, ref, alt and one for each sample; a schema given by the user
    may name fewer, and no other sample is looked at.
    """

    @classmethod
    def name(cls) -> str:
        return "popspark_vcf"

    def schema(self) -> str:
        if self.options.get("layout", "long") == "long":
            return LONG
        names = sample_names(listed(self.options["path"]))
        wanted = self.options.get("samples")
        names = [x.strip() for x in wanted.split(",")] if wanted else names
        return ", ".join(["chrom string, position bigint, id string, ref string, alt string", *(f"`{x}` int" for x in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return VcfReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VcfWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(VcfSource)


def save(genotypes: DataFrame, individuals: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """Write (ind_id, position, g) as a folder of VCF parts in order of position, a column for each of individuals."""
    spark = genotypes.sparkSession
    register(spark)
    ids = individuals.select("ind_id").distinct().agg(F.array_join(F.sort_array(F.collect_list(F.col("ind_id").cast("long"))), ",")).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = genotypes.select(F.col("ind_id").cast("long"), F.col("position").cast("long"), F.col("g").cast("long"))
    rows.repartitionByRange(parts, "position").sortWithinPartitions("position").write.format("popspark_vcf").option("individuals", ids).option("compression", compression).mode(mode).save(path)


def load(spark: SparkSession, path: str, samples: list[str] | None = None, split: int = SPLIT, carriers: bool = False) -> DataFrame:
    """(ind_id, position, g) of VCF files, with carriers only those with g over 0; individuals are numbered as their columns are."""
    register(spark)
    reader = spark.read.format("popspark_vcf").option("splitBytes", split).option("carriers", str(carriers).lower())
    return (reader.option("samples", ",".join(samples)) if samples else reader).load(path)
