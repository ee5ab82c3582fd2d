"""Elements of a page as nested intervals.

One Arrow-batched column function turns markup into three arrays: elements in page order, each with the interval of places
from its opening to its closing tag, text pieces with their place, and the JSON blocks. Everything else is expressions over
these arrays: an element lies inside another if its interval does, a text belongs to an element if its place does.

Elements that are never closed end with the element around them; closing tags without an element are passed over. Comments,
scripts, styles and templates have no text. Text pieces are stripped, empty ones left out. Null markup has no elements but
the root.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# Elements without a closing tag, elements whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(["script", "style", "template"])
JSON_BLOCK = "application/ld+json"
#: Pages held as Python objects at a time.
PAGES = 64

NODE = pa.struct([
    ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
    ("attributes", pa.map_(pa.string(), pa.string())), ("first", pa.int32()), ("last", pa.int32()),
])
TREE = pa.struct([
    ("nodes", pa.list_(NODE)), ("texts", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))), ("data", pa.list_(pa.string())),
])
class _Places(HTMLParser):
    """Numbers tags and texts in page order and keeps the open elements on a stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.place = 0
        self.nodes = [{"tag": "", "id": None, "classes": [], "attributes": [], "first": 0, "last": 0}]
        self.open = [self.nodes[0]]
        self.texts: list[dict] = []
        self.data: list[str] = []
        self.pending: list[str] = []

    def handle_starttag(self, tag, attrs):
        self._end_text()
        self.place += 1
        found = {k: v or "" for k, v in attrs}
        node = {"tag": tag, "id": found.get("id"), "classes": found.get("class", "").split(), "attributes": list(found.items()), "first": self.place, "last": self.place}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text()
        if any(n["tag"] == tag for n in self.open[1:]):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        node = self.open.pop()
        node["last"] = self.place
        return node["tag"]

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._end_text()

    def _end_text(self):
        if not self.pending:
            return
        self.place += 1
        whole, inside = "".join(self.pending), self.open[-1]
        self.pending.clear()
        if inside["tag"] == "script" and dict(inside["attributes"]).get("type", "").lower() == JSON_BLOCK:
            self.data.append(whole)
        text = whole.strip()
        if text and not any(n["tag"] in SILENT for n in self.open):
            self.texts.append({"at": self.place, "text": text})

    def tree(self, html: str) -> dict:
        self.feed(html)
        self.close()
        self._end_text()
        while self.open:
            self._close()
        return {"nodes": self.nodes, "texts": self.texts, "data": self.data}


@F.arrow_udf(from_arrow_type(TREE))
def tree(html: pa.Array) -> pa.Array:
    """The page's elements, texts and JSON blocks.

    A batch is turned a few pages at a time: as Python objects a page takes many times its size."""
    parts = (html.slice(at, PAGES).to_pylist() for at in range(0, len(html), PAGES))
    return pa.concat_arrays([pa.array([], TREE), *(pa.array([_Places().tree(h or "") for h in part], TREE) for part in parts)])


def inside(inner: Column, outer: Column) -> Column:
    """Does an element lie below another?"""
    return (inner["first"] > outer["first"]) & (inner["first"] <= outer["last"])


def select(page: Column, condition) -> Column:
    """Elements that meet a condition, in page order."""
    return F.filter(page["nodes"], condition)


def first(page: Column, condition) -> Column:
    return F.try_element_at(select(page, condition), F.lit(1))


def below(page: Column, node: Column, condition) -> Column:
    """Elements below another one that meet a condition."""
    return F.filter(page["nodes"], lambda n: inside(n, node) & condition(n))


def text_of(page: Column, node: Column, glue: str = " ") -> Column:
    """Texts inside an element; '' for a null one."""
    texts = F.filter(page["texts"], lambda t: (t["at"] > node["first"]) & (t["at"] <= node["last"]))
    return F.coalesce(F.array_join(F.transform(texts, lambda t: t["text"]), glue), F.lit(""))


def all_text(page: Column, glue: str = " ") -> Column:
    return F.array_join(F.transform(page["texts"], lambda t: t["text"]), glue)


def tagged(*tags: str):
    return lambda n: n["tag"].isin(*tags)


def classed(name: str):
    return lambda n: F.array_contains(n["classes"], name)


def attribute(node: Column, name: str) -> Column:
    """An attribute's value, '' if it has none."""
    return F.coalesce(F.try_element_at(node["attributes"], F.lit(name)), F.lit(""))


def pruned(rows: DataFrame, column: str, condition) -> tuple[DataFrame, Column]:
    """Rows whose page lacks the elements that meet a condition and all that lies inside them, and that page as a column.

    Elements and texts become columns of their own: fields of a struct column would be computed again at every use."""
    page = F.col(column)
    gone = F.filter(page["nodes"], condition)
    stays = lambda place: ~F.exists(gone, lambda g: (place >= g["first"]) & (place <= g["last"]))
    nodes, texts = F.filter(page["nodes"], lambda n: stays(n["first"])), F.filter(page["texts"], lambda t: stays(t["at"]))
    return rows.withColumns({f"{column}_nodes": nodes, f"{column}_texts": texts}), F.struct(F.col(f"{column}_nodes").alias("nodes"), F.col(f"{column}_texts").alias("texts"))


SELECTOR_TYPE = "struct<tag:string,class:string,attribute:string,how:string,value:string,inside_tag:string,inside_class:string>"


def selector(tag: str | None = None, class_: str | None = None, attribute: str | None = None, how: str = "has", value: str = "", inside_tag: str | None = None, inside_class: str | None = None) -> tuple:
    """A selector as a row of SELECTOR_TYPE: what is None is not asked for; how: has, starts or contains."""
    return (tag, class_, attribute, how, value, inside_tag, inside_class)


def meets(nodes: Column, node: Column, wanted: Column) -> Column:
    """Does an element meet one selector?"""
    value = F.try_element_at(node["attributes"], wanted["attribute"])
    by_value = F.when(wanted["how"] == "starts", value.startswith(wanted["value"])).when(wanted["how"] == "contains", value.contains(wanted["value"])).otherwise(value.isNotNull())
    around = F.exists(
        nodes,
        lambda a: inside(node, a)
        & (wanted["inside_tag"].isNull() | (a["tag"] == wanted["inside_tag"]))
        & (wanted["inside_class"].isNull() | F.array_contains(a["classes"], wanted["inside_class"])),
    )
    return (
        (wanted["tag"].isNull() | (node["tag"] == wanted["tag"]))
        & (wanted["class"].isNull() | F.array_contains(node["classes"], wanted["class"]))
        & (wanted["attribute"].isNull() | F.coalesce(by_value, F.lit(False)))
        & ((wanted["inside_tag"].isNull() & wanted["inside_class"].isNull()) | around)
    )


def chosen(nodes: Column, selectors: Column) -> Column:
    """Elements that meet any of the selectors, in page order."""
    return F.filter(nodes, lambda n: F.exists(selectors, lambda s: meets(nodes, n, s)))
