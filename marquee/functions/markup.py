"""Pages as a table of elements, numbered so that containment is an interval.

Elements of a page are numbered in the order in which they begin (``pre``);
``last`` is the number of the last one that begins inside. So x lies in a exactly
if a.pre < x.pre <= a.last, and intervals either nest or don't meet. What an
element says is a slice of its page's text, which is kept once, in the row of
the page itself (number 0).

One Arrow-batched pass reads the tags, linear in the page; all that selects and
combines elements is DataFrame work on the numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PAGE = "#page"
#: Fixed values, from the HTML standard: elements without content, and those whose text nobody reads.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
SILENT = ["script", "style", "noscript", "template"]
#: Fixed values, from the HTML standard: what begins, what it ends, and what shields from that.
BLOCKS = [
    "address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "table", "ul",
]
P_SHIELDS = ["button", "object", "table", "td", "th"]
ENDS = {
    "li": (["li"], ["ol", "ul"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "option": (["option"], ["select"]), "tr": (["tr"], ["table"]), "td": (["td", "th"], ["table", "tr"]), "th": (["td", "th"], ["table", "tr"]),
}

_ROWS = 4000
_SCHEMA = "page_id long, pre int, last int, parent int, depth int, tag string, attrs map<string,string>, start int, stop int, child int, children int, text string"
_ARROW = pa.schema([
    ("page_id", pa.int64()), *((n, pa.int32()) for n in ("pre", "last", "parent", "depth")), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), *((n, pa.int32()) for n in ("start", "stop", "child", "children")), ("text", pa.string()),
])


class _Tree(HTMLParser):
    """Numbers of the elements of one page. ``open`` is the stack of open elements and ``at`` the places of each tag in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.parts: list[str] = []
        self.length = self.silent = 0
        self._begin(PAGE, [])

    def _begin(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        number, parent = len(self.rows), self.open[-1] if self.open else None
        if parent is not None:
            self.rows[parent][9] += 1
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        # pre, last, parent, depth, tag, attrs, start, stop, child, children
        self.rows.append([number, number, parent, len(self.open), tag, list(own.items()), self.length, self.length, self.rows[parent][9] if parent is not None else 1, 0])
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(number)
            self.silent += tag in SILENT

    def _cut(self, size: int) -> None:
        """End the open elements above the first ``size``."""
        while len(self.open) > size:
            row = self.rows[self.open.pop()]
            row[1], row[7] = len(self.rows) - 1, self.length
            self.at[row[4]].pop()
            self.silent -= row[4] in SILENT

    def _ended(self, tags: list[str], shields: list[str]) -> int:
        """How much of the stack stays if the innermost of ``tags`` ends, unless a shield is nearer."""
        inner = lambda names: max((self.at[n][-1] for n in names if self.at[n]), default=-1)
        found = inner(tags)
        return found if found > inner(shields) else len(self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        size = len(self.open)
        if tag in BLOCKS:
            size = self._ended(["p"], P_SHIELDS)
        if tag in ENDS:
            size = min(size, self._ended(*ENDS[tag]))
        self._cut(size)
        self._begin(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.at[tag]:
            self._cut(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            self.length += len(data)


def page_elements(html: str | None) -> tuple[list[list], str]:
    """Rows and text of one page. A tag that is not finished at the end is none; all that is open there ends there."""
    html = html or ""
    if (cut := html.rfind("<")) > html.rfind(">"):
        html = html[:cut]
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree._cut(0)
    return tree.rows, "".join(tree.parts)


def elements(pages: DataFrame) -> DataFrame:
    """Elements of every page (page_id, html), the page itself first: pre, last, parent, depth, tag, attrs, start and stop in the page's text, child (its place among its parent's), children, and for the page its text.

    Of an attribute that is given twice the first counts. A null page is an
    empty one. Rows go out a few thousand at a time, as far as pages end.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for x in batches:
            for page, html in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                rows, text = page_elements(html.as_py())
                for i, r in enumerate(rows):
                    out.append((page, *r, None if i else text))
                    if len(out) >= _ROWS:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return pages.selectExpr("cast(page_id AS long) AS page_id", "html").mapInArrow(run, _SCHEMA)


def _before() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)


def inside(what: Column) -> Column:
    """Whether an element lies in one for which ``what`` holds: as intervals nest, the furthest end of such ones before it decides. One sort a page, no join."""
    return F.coalesce(F.max(F.when(what, F.col("last"))).over(_before()) >= F.col("pre"), F.lit(False))


def innermost(rows: DataFrame, what: Column, name: str) -> DataFrame:
    """``rows`` with the number of the nearest element around each (itself included) for which ``what`` holds, as ``name``; null without one.

    An as-of join by containment, without a join: the places where such
    elements begin and end are put in order with all rows, a running count says
    how many are open, and at that depth the last one that began is the nearest.
    """
    own = rows.withColumn("_is", F.coalesce(what, F.lit(False)))
    begin = own.withColumns({"_place": F.col("pre"), "_step": F.col("_is").cast("int")})
    end = own.filter("_is").select("page_id", "pre", F.col("last").alias("_place"), F.lit(-1).alias("_step"))
    # A page's own rows come before the ends at the same place.
    both = begin.unionByName(end, allowMissingColumns=True)
    order = Window.partitionBy("page_id").orderBy("_place", F.col("_step").desc(), F.col("pre").desc())
    deep = both.withColumn("_deep", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_step >= 0")
    level = Window.partitionBy("page_id", "_deep").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.when(F.col("_deep") > 0, F.last(F.when(F.col("_is"), F.col("pre")), ignorenulls=True).over(level))
    return deep.withColumn(name, nearest).drop("_is", "_place", "_step", "_deep")


def texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (elements of ``rows``) with what each says, as ``said``; the text of a page meets its elements by one join."""
    page = rows.filter(F.col("tag") == PAGE).select("page_id", F.col("text").alias("_page"))
    own = found.drop("text").join(page, "page_id")
    return own.withColumn("said", F.substring("_page", F.col("start") + 1, F.col("stop") - F.col("start"))).drop("_page")
