"""Tables of zipped XML, cell by cell: an event parser reads sections, and cells are laid to a grid by their spans.

Offered as a table function with Arrow transfer, for use in SQL and lateral joins."""

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..shipping import attach

SCHEMA = "section int, grid int, row int, nth int, col int, row_span int, col_span int, text string"
#: Cells that leave a file's reader at a time.
CELLS = 4096


class _Events:
    """What a section's tables hold.  A cell's text has a line for each of its own paragraphs; tables inside
    it are tables by themselves."""

    def __init__(self, section: int, first: int):
        self.section, self.next, self.out = section, first, []
        self.tables: list[dict] = []
        self.texts = 0

    def taken(self) -> list[tuple]:
        """The cells since the last call."""
        out, self.out = self.out, []
        return out

    def start(self, tag: str, attrs: dict) -> None:
        t = self.tables[-1] if self.tables else None
        if tag == "hp:tbl":
            self.tables.append({"no": self.next, "row": -1, "taken": {}, "cell": None, "texts": self.texts})
            self.next, self.texts = self.next + 1, 0
        elif t is None:
            return
        elif tag == "hp:tr":
            t["row"] += 1
            t["nth"] = -1
        elif tag == "hp:tc":
            t["nth"] = t.get("nth", -1) + 1
            t["cell"] = {"lines": [], "open": [], "span": (1, 1)}
        elif t["cell"] is None:
            return
        elif tag == "hp:cellSpan":
            t["cell"]["span"] = tuple(max(1, int(attrs.get(k, "1") or 1)) for k in ("rowSpan", "colSpan"))
        elif tag == "hp:p":
            t["cell"]["lines"].append("")
            t["cell"]["open"].append(len(t["cell"]["lines"]) - 1)
        elif tag == "hp:t":
            self.texts += 1

    def text(self, data: str) -> None:
        cell = self.tables[-1]["cell"] if self.tables else None
        if cell and self.texts and cell["open"]:
            cell["lines"][cell["open"][-1]] += data

    def end(self, tag: str) -> None:
        t = self.tables[-1] if self.tables else None
        if t is None:
            return
        cell = t["cell"]
        if tag == "hp:t" and self.texts:
            self.texts -= 1
        elif tag == "hp:p" and cell and cell["open"]:
            cell["open"].pop()
        elif tag == "hp:tc" and cell:
            rows, columns = cell["span"]
            at = next(c for c in range(1 << 20) if t["taken"].get(c, -1) < t["row"])  # free of what spans from above
            for c in range(at, at + columns):
                t["taken"][c] = t["row"] + rows - 1
            self.out.append((self.section, t["no"], t["row"], t["nth"], at, rows, columns, "\n".join(cell["lines"])))
            t["cell"] = None
        elif tag == "hp:tbl":
            self.texts = self.tables.pop()["texts"]


def iter_cells(content: bytes | None) -> Iterator[tuple]:
    """Rows of SCHEMA for a file, as they are read.  What is no archive has none; of a section that breaks off,
    the cells that are whole."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.match(r"Contents/section(\d+)\.xml", n)))
            first = 0
            for section, name in names:
                events, parser = _Events(section, first), expat.ParserCreate()
                parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = events.start, events.end, events.text
                parser.buffer_text = True
                try:
                    parser.Parse(b"<section>")
                    with z.open(name) as f:
                        head = re.sub(rb"^\s*(\xef\xbb\xbf)?\s*<\?xml[^>]*\?>", b"", f.read(1 << 16))
                        while head:
                            parser.Parse(head)
                            yield from events.taken()
                            head = f.read(1 << 16)
                    parser.Parse(b"</section>", True)
                except expat.ExpatError:
                    pass
                yield from events.taken()
                first = events.next
    except (zipfile.BadZipFile, TypeError):
        pass


def read_cells(content: bytes | None) -> list[tuple]:
    """All that iter_cells() gives."""
    return list(iter_cells(content))


@F.udtf(returnType=SCHEMA, useArrow=True)
class TableCells:
    """table_cells(content): the cells of a file's tables."""

    def eval(self, content: bytes):
        yield from iter_cells(content)


def register(spark: SparkSession) -> None:
    """Makes the function known to SQL as table_cells."""
    attach(spark)
    spark.udtf.register("table_cells", TableCells)


def table_cells(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, section, grid, row, nth, col, row_span, col_span, text) of every cell of each file's tables:
    ``nth`` counts a row's cells, ``col`` its place in the grid, beside cells that span from rows
    above.  Null contents and files that are no archives give no rows."""
    attach(files.sparkSession)
    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    schema = StructType([rows.schema["path"], *StructType.fromDDL(SCHEMA).fields])
    kinds = to_arrow_schema(schema)

    def run(batches):  # a table function would hold all cells of a file
        for batch in batches:
            for i in range(batch.num_rows):
                cells = iter_cells(batch.column(1)[i].as_py())
                while some := list(itertools.islice(cells, CELLS)):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), list(kinds)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(some))), *columns], kinds.names)

    return rows.mapInArrow(run, schema)


def start_pages(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(name, page_start): the first page of each of the ``names`` that a row of a table numbers and names in its
    first cell and gives a page in its second; the first such row counts."""
    key = ["path", "section", "grid", "row"]
    pair = cells.where("nth < 2").groupBy(*key).agg(*(F.max(F.when(F.col("nth") == i, strip("text"))).alias(c) for i, c in enumerate(("entry", "page"))))
    entry = r"(?s)^\d+\.\s*(.+)$"
    rows = pair.where(F.col("entry").rlike(entry) & F.col("page").rlike(r"^[0-9]{1,9}$"))
    rows = rows.select(*key, strip(F.regexp_replace(F.regexp_extract("entry", entry, 1), r"(?U)\s+", " ")).alias("name"), F.col("page").cast("int").alias("page_start"))
    return names.select("name").distinct().join(rows.groupBy("name").agg(F.min_by("page_start", F.struct(*key)).alias("page_start")), "name")
