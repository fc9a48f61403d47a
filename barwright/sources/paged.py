"""Landed answers of a service that gives them page by page, read as a data source of its own.

A chain is one request and its continuations. Each answer is a line of JSON, `{"page": 0, "status": 200, "headers": {..}, "body": {..}}`, in
the folder `chain=<name>` of the landing, pages in order by file name and line. A chain goes on while an answer's header
`tr_cont` is M or F; what lies behind the first other one is left from an earlier request and isn't read. An answer that
isn't a success (status 200 and `rt_cd` 0) fails the read, as a page that is missing or out of order does.

A partition is some chains of together TASK_BYTES, or one longer chain: tasks follow the bytes, not the number of chains, and a
task holds a page at a time, however long the chain. Filters on `chain` and `output` are pushed down:
only those chains' folders are opened, and only those outputs are taken out of the bodies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .registry import Dataset

#: Fixed values of the service: the header's flags that say a page follows, and the code of success.
GOES_ON, SUCCESS = ("M", "F"), "0"
HEADER, CODE, MESSAGE_CODE, MESSAGE = "tr_cont", "rt_cd", "msg_cd", "msg1"
#: The characters that Spark writes as % and two digits in the name of a partition's folder.
ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
#: Bytes of the chains that one task reads.
TASK_BYTES = 4 << 20
SCHEMA = "chain string, page int, output string, n int, record string"


def records_of(output: object) -> list[dict]:
    """The records of an output: of an array its objects, of an object itself, of anything else none."""
    if isinstance(output, dict):
        return [output]
    return [x for x in output if isinstance(x, dict)] if isinstance(output, list) else []


def flag_of(headers: object) -> str:
    """The continuation flag, whatever the case of the header's name; empty where there is none."""
    pairs = headers.items() if isinstance(headers, dict) else []
    return next((str(v).strip() for k, v in pairs if k.lower() == HEADER and v is not None), "")


def folder_of(chain: str) -> str:
    """The name of a chain's folder, as Spark writes it."""
    return "chain=" + ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", chain)


class Chain:
    def __init__(self, name: str, files: list[str]):
        self.name, self.files = name, files


class Chains(InputPartition):
    def __init__(self, chains: list[Chain]):
        self.chains = chains


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options["pages"]) if options.get("pages") else None
        self.chains: set[str] | None = None
        self.outputs: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in ("chain", "output"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            own = f"{name}s"
            setattr(self, own, values if getattr(self, own) is None else getattr(self, own) & values)

    def partitions(self) -> list[Chains]:
        from pyarrow import fs

        at, root = _fs(self.path)
        if self.chains is None:
            found = at.get_file_info(fs.FileSelector(root, recursive=True))
            folders = {i.path: unquote(i.base_name[len("chain=") :]) for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("chain=") and i.path.rpartition("/")[0] == root.rstrip("/")}
        else:
            named = {f"{root.rstrip('/')}/{folder_of(c)}": c for c in self.chains if c is not None}
            folders = {i.path: named[i.path] for i in at.get_file_info(list(named)) if i.type == fs.FileType.Directory}
            found = [i for f in folders for i in at.get_file_info(fs.FileSelector(f))]
        files: dict[str, list] = {f: [] for f in folders}
        for i in found:
            if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and (folder := i.path.rpartition("/")[0]) in files:
                files[folder].append((i.path, i.size or 0))
        out, room = [], 0
        for folder, name in sorted(folders.items(), key=lambda x: x[1]):
            size = sum(s for _, s in files[folder])
            if size > room or not out:
                out.append([])
                room = TASK_BYTES
            out[-1].append(Chain(name, sorted(f for f, _ in files[folder])))
            room = max(0, room - size)
        return [Chains(c) for c in out]

    def _answers(self, chain: Chain) -> Iterator[dict]:
        import io

        at, _ = _fs(self.path)
        for f in chain.files:
            with at.open_input_stream(f) as raw:
                yield from (json.loads(line) for line in io.TextIOWrapper(raw, "utf-8") if line.strip())

    def read(self, partition: Chains | None) -> Iterator:
        for chain in partition.chains if partition else []:  # none: no chain is asked for
            yield from self._records(chain)

    def _records(self, partition: Chain) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("chain", pa.string()), ("page", pa.int32()), ("output", pa.string()), ("n", pa.int32()), ("record", pa.string())])
        want, on = 0, True
        for answer in self._answers(partition):
            body, page = answer.get("body"), answer.get("page")
            body = body if isinstance(body, dict) else {}
            if page != want:
                raise ValueError(f"chain {partition.name}: page {page} where {want} follows")
            if answer.get("status", 200) != 200 or str(body.get(CODE, "")).strip() != SUCCESS:
                raise ValueError(f"chain {partition.name}, page {page}: {body.get(MESSAGE_CODE) or '-'} {body.get(MESSAGE) or 'no reason given'}")
            rows = [(o, n, json.dumps(r, ensure_ascii=False)) for o, v in body.items() if self.outputs is None or o in self.outputs for n, r in enumerate(records_of(v))]
            if rows:
                names, places, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([partition.name] * len(rows), [page] * len(rows), names, places, texts), kinds.types)], schema=kinds)
            want, on = want + 1, flag_of(answer.get("headers")) in GOES_ON
            if not on or want == self.most:
                return
        if on and want:
            raise ValueError(f"chain {partition.name}: page {want} is missing")


class PagedSource(DataSource):
    """Format `landed_pages`: load(path); option `pages`, the most that are read of a chain (default: all)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def landed_pages(spark: SparkSession, path: str, pages: int | None = None) -> DataFrame:
    """The records of all chains: chain, page, output, place on the page, JSON text."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    source = spark.read.format("landed_pages")
    return (source.option("pages", pages) if pages else source).load(path)


def dataset_records(pages: DataFrame, dataset: Dataset, output: str) -> DataFrame:
    """One output's records with the dataset's raw fields as text, ready to be normalised: chain, _seq and the fields."""
    own = pages.where(F.col("output") == output)
    return own.select("chain", F.struct("page", "n").alias("_seq"), F.from_json("record", dataset.raw_schema).alias("_r")).select("chain", "_seq", "_r.*")


def answer(page: Column, flag: Column, body: Column) -> Column:
    """An answer as a line of a landing; the body is JSON text."""
    return F.concat(F.lit('{"page":'), page.cast("string"), F.lit(',"status":200,"headers":'), F.to_json(F.struct(flag.alias(HEADER))), F.lit(',"body":'), body, F.lit("}"))


def land(answers: DataFrame, path: str) -> None:
    """Writes answers (chain, page, line) as a landing: a chain's pages in order, in files of one task."""
    dealt = answers.select("chain", "page", "line").repartition("chain").sortWithinPartitions("chain", "page")
    dealt.drop("page").write.partitionBy("chain").text(path)
