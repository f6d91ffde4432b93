"""Wind fields as a data source whose filters on case and step reach the files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .ranges import Ranges, _located
from .wind import FIXED, as_batch, decoded, parsed_header, record_size

SCHEMA = "case_id string, step int, ny int, nz int, u array<float>, v array<float>, w array<float>"
#: Headers that planning reads at a time.
THREADS = 32


@dataclass
class Block(InputPartition):
    """Steps first to last (exclusive) of one file."""

    path: str
    case: str
    first: int
    last: int
    at: int
    ny: int
    nz: int
    n_twr: int
    slope: list
    shift: list


class _Wanted:
    """What pushed filters leave of cases and steps; they are evaluated again by Spark."""

    def __init__(self):
        self.cases: set | None = None
        self.steps: set | None = None
        self.low, self.high = 0, 1 << 31

    def take(self, f: Filter) -> None:
        name = f.attribute[0] if len(f.attribute) == 1 else None
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if name == "case_id" and values is not None:
            self.cases = values if self.cases is None else self.cases & values
        elif name == "step" and values is not None:
            self.steps = values if self.steps is None else self.steps & values
        elif name == "step" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif name == "step" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))

    def block(self, first: int, last: int) -> bool:
        return first < self.high and last > self.low and (self.steps is None or any(first <= s < last for s in self.steps))

    def rows(self, step: np.ndarray) -> np.ndarray:
        keep = (step >= self.low) & (step < self.high)
        return keep if self.steps is None else keep & np.isin(step, list(self.steps))


class WindReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.bts")
        self.rows = int(options.get("steps_per_block", "500"))
        self.wanted = _Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.wanted.take(f)
        return filters

    def _files(self) -> list[tuple[str, str]]:
        """(path, case) of files whose name and length fit and whose case is wanted."""
        from pyarrow import fs

        system, name = _located(self.root)
        out = []
        for info in system.get_file_info(fs.FileSelector(name.rstrip("/"), recursive=True)):
            if info.is_file and info.size >= FIXED and fnmatch(info.base_name, self.pattern):
                rel = info.path[len(name.rstrip("/")) :].lstrip("/")
                case = rel[: rel.rindex(".")].replace("/", "__") if "." in rel else rel.replace("/", "__")
                if self.wanted.cases is None or case in self.wanted.cases:
                    path = info.path if "://" not in self.root else self.root.split("://", 1)[0] + "://" + info.path
                    out.append((path, case))
        return sorted(out)

    def _blocks(self, file: tuple[str, str]) -> list[Block]:
        files = Ranges()
        (_, nz, ny, n_twr, nt, *_), slope, shift, n = parsed_header(files.read(file[0], 0, FIXED))
        files.close()
        if min(ny, nz) <= 0 or n_twr < 0:
            raise ValueError(f"no field header in {file[0]}")
        cut = range(0, max(nt, 0), self.rows)
        return [Block(*file, k, min(k + self.rows, nt), FIXED + n, ny, nz, n_twr, slope, shift) for k in cut if self.wanted.block(k, min(k + self.rows, nt))]

    def partitions(self) -> list[Block]:
        with ThreadPoolExecutor(THREADS) as pool:
            found = [b for blocks in pool.map(self._blocks, self._files()) for b in blocks]
        return found or [Block("", "", 0, 0, 0, 1, 1, 0, [1.0] * 3, [0.0] * 3)]

    def read(self, block: Block) -> Iterator:
        if not block.path:
            return
        rec = record_size(block.ny, block.nz, block.n_twr)
        files = Ranges()
        raw = files.read(block.path, block.at + block.first * rec, (block.last - block.first) * rec)
        files.close()
        step = np.arange(block.first, block.first + len(raw) // rec, dtype=np.int32)
        own = self.wanted.rows(step)
        values = decoded(raw, block.ny, block.nz, block.n_twr, block.slope, block.shift, own)
        yield as_batch(block.case, step[own], values, (block.ny, block.nz))


class WindFields(DataSource):
    """``spark.read.format("windfields").load(folder)``: options pattern and steps_per_block."""

    @classmethod
    def name(cls) -> str:
        return "windfields"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindReader:
        return WindReader(dict(self.options))


def read_wind_table(spark: SparkSession, root: str, steps_per_block: int = 500, pattern: str = "*.bts") -> DataFrame:
    """(case_id, step, ny, nz, u, v, w) of all field files below ``root``.

    A filter on ``case_id`` leaves other files unopened, one on ``step`` reads only the blocks
    that hold such steps; so ``where`` is enough to prune a campaign. Files are listed, and headers of the
    files that filters leave are read, while Spark plans. The session's
    ``spark.sql.python.filterPushdown.enabled`` is set and stays set. For a list of steps that is a
    table of its own, see ``wind.read_wind_fields(steps=)``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WindFields)
    return spark.read.format("windfields").option("steps_per_block", steps_per_block).option("pattern", pattern).load(root)
