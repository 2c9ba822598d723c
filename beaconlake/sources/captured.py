"""Captured payloads as a Spark data source: one partition per file of a domain folder.

spark.dataSource.register(CapturedPayloads)
spark.read.format("captured_payloads").option("path", folder).load()
spark.readStream.format("captured_payloads").option("path", folder).load()

With the option `pushdown` a filter on the domain opens only that domain's files; Spark wants its setting
spark.sql.python.filterPushdown.enabled for sources that take filters. A stream takes up files in the order of their time and name; a file
counts once it is `settle` seconds old (one by default), so that none appears before one that was read.
"""
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition


class _Files(InputPartition):
    """Files of a domain, with the place of the first one among them."""

    def __init__(self, domain, names, first):
        self.domain, self.names, self.first = domain, names, first


class _Folder:
    """The files of a folder by domain, and their lines."""

    def __init__(self, options):
        self.folder = options["path"]
        self.limit = int(options.get("limit", -1))
        wanted = options.get("domains", "")
        self.domains = [x for x in wanted.split(",") if x] or None

    def available(self):
        import pyarrow.fs as pf
        fs, root = pf.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pf.FileSelector(root))
        return sorted(f.base_name.removeprefix("domain=") for f in found if f.type == pf.FileType.Directory)

    def files(self, domain):
        import pyarrow.fs as pf
        fs, root = pf.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pf.FileSelector(f"{root}/domain={domain}", allow_not_found=True))
        return sorted((f for f in found if f.base_name[0] not in "._"), key=lambda f: f.path)

    def named(self):
        return self.available() if self.domains is None else self.domains

    def read(self, partition):
        """Lines in file order as Arrow batches; `seq` is the file's place and the line's in it."""
        import pyarrow as pa
        import pyarrow.fs as pf
        fs, _ = pf.FileSystem.from_uri(self.folder)
        left = self.limit if self.limit >= 0 else 1 << 62
        for place, name in enumerate(partition.names, partition.first):
            with fs.open_input_stream(name) as stream:
                seq = place << 32
                for lines in _blocks(stream):
                    lines = lines[:left]
                    if lines:
                        yield pa.RecordBatch.from_arrays([pa.array([partition.domain] * len(lines)), pa.array(range(seq, seq + len(lines)), pa.int64()), pa.array(lines, pa.string())],
                                                         names=["domain", "seq", "value"])
                    seq, left = seq + len(lines), left - len(lines)
                    if left <= 0:
                        return


def _blocks(stream):
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield [x.decode() for x in whole]
    if rest:
        yield [rest.decode()]


class _Reader(_Folder, DataSourceReader):
    def partitions(self):
        """One per file; with a limit, which counts over the files of a domain, one per domain."""
        out = []
        for domain in self.named():
            names = [f.path for f in self.files(domain)]
            out += [_Files(domain, names, 0)] if self.limit >= 0 else [_Files(domain, [n], i) for i, n in enumerate(names)]
        return out or [_Files("", [], 0)]


class _FilteringReader(_Reader):
    def pushFilters(self, filters):
        """Domains asked for by name are looked up alone; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("domain",):
                asked = set(f.value if isinstance(f, In) else [f.value])
                self.domains = [x for x in self.named() if x in asked]
            else:
                yield f


class _Stream(_Folder, DataSourceStreamReader):
    """New files between two marks; a mark is the time and name of the last file."""

    def __init__(self, options):
        super().__init__(options)
        self.settle = float(options.get("settle", 1.0))

    def _marked(self):
        return sorted((f.mtime_ns, f.path, domain, place) for domain in self.named() for place, f in enumerate(self.files(domain)))

    def initialOffset(self):
        return {"time": 0, "name": ""}

    def latestOffset(self):
        old = time.time_ns() - int(self.settle * 1e9)
        ready = [m for m in self._marked() if m[0] <= old]
        return {"time": ready[-1][0], "name": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start, end):
        first, last = (start["time"], start["name"]), (end["time"], end["name"])
        return [_Files(domain, [name], place) for at, name, domain, place in self._marked() if first < (at, name) <= last]


class CapturedPayloads(DataSource):
    @classmethod
    def name(cls):
        return "captured_payloads"

    def schema(self):
        return "domain string, seq bigint, value string"

    def reader(self, schema):
        return (_FilteringReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
