"""Deeply nested records into flat tables by shared inlining.

A schema graph has an edge for each element that occurs in another, with `one` or `many` as its cardinality. It is
found in the records themselves: names that hold alike objects are one element. Shared inlining gives a table to the
root and to each element that is repeated, shared by several parents or recursive; every other element occurs once
below one parent and is inlined into its table as columns. The rows of a table carry a key, the key of the row of the
parent table, and the role they have in it. What the graph doesn't have is in no table.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An element with more names than this may be a map from data to data, which has names of every other element by chance.
MANY_NAMES = 200


@dataclass(frozen=True)
class Edge:
    """`child` occurs in `parent` under the name `name`."""

    parent: str
    name: str
    child: str
    many: bool = False


@dataclass
class SchemaGraph:
    """Elements and edges. `relations()` says which elements get a table, `inlined()` what goes into each."""

    root: str
    edges: list[Edge] = field(default_factory=list)

    @cached_property
    def below(self) -> dict[str, list[Edge]]:
        """Element to its edges; they stay as they are once they have been asked for."""
        out: dict[str, list[Edge]] = defaultdict(list)
        for e in self.edges:
            out[e.parent].append(e)
        return dict(out)

    def children(self, element: str) -> list[Edge]:
        return self.below.get(element, [])

    def recursive(self) -> set[str]:
        """Elements that can reach themselves."""
        # Leaves reach nothing, however many there are.
        next_of = {p: {e.child for e in es if e.child in self.below} for p, es in self.below.items()}
        out = set()
        for start in next_of:
            seen, todo = set(), list(next_of[start])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo.extend(next_of[x])
            if start in seen:
                out.add(start)
        return out

    def relations(self) -> set[str]:
        """The root and every repeated, shared or recursive element."""
        return self._relations

    @cached_property
    def _relations(self) -> set[str]:
        into = defaultdict(set)
        for e in self.edges:
            into[e.child].add((e.parent, e.name))
        many = {e.child for e in self.edges if e.many}
        shared = {c for c, p in into.items() if len(p) > 1}
        return {self.root} | many | shared | self.recursive()

    def inlined(self, element: str) -> dict[str, list[str]]:
        """Column name to path, for everything that is inlined into the table of `element`."""
        tables, out = self.relations(), {}

        def walk(at: str, path: list[str]) -> None:
            below = [e for e in self.children(at) if e.child not in tables]
            for e in below:
                if any(c.child not in tables for c in self.children(e.child)):
                    walk(e.child, [*path, e.name])
                else:
                    out["_".join([*path, e.name])] = [*path, e.name]

        walk(element, [])
        return out

    def tables(self) -> dict[str, dict[str, list[str]]]:
        """Element to the columns of its table, for each element that has one."""
        return {e: self.inlined(e) for e in sorted(self.relations())}


    def links(self, element: str) -> list[tuple[list[str], Edge]]:
        """Edges that lead from the table of `element` to another table, with the names of inlined elements on the way."""
        tables, out = self.relations(), []

        def walk(at: str, path: list[str]) -> None:
            for e in self.children(at):
                if e.child in tables:
                    out.append((path, e))
                else:
                    walk(e.child, [*path, e.name])

        walk(element, [])
        return out


def unify(found: Iterable[tuple[str, str, bool]], root: str, alike: tuple[str, ...] = ()) -> SchemaGraph:
    """The graph of observed (parent, name, many). Names in `alike` hold the root's element again; of others those whose
    objects have more than half of their own names in common are one element, called by the first of its names. Of an element
    with more than MANY_NAMES names these must be more than half of its names too."""
    names: dict[str, set[str]] = defaultdict(set)
    found = sorted(found)
    for parent, name, _ in found:
        names[parent].add(name)
    same = {e: e for e in names} | {e: root for e in alike}

    def of(e: str) -> str:
        while same.get(e, e) != e:
            e = same[e]
        return e

    def are_alike(a: set[str], b: set[str]) -> bool:
        least, most = sorted((len(a), len(b)))
        return 2 * len(a & b) > (least if most <= MANY_NAMES else most)

    firsts: dict[frozenset[str], str] = {}
    for e in sorted(set(names) - {root, *alike}):
        if (first := firsts.setdefault(frozenset(names[e]), e)) != e:
            same[e] = first
    holders = list(firsts.values())
    for i, a in enumerate(holders):
        for b in holders[i + 1 :]:
            if of(a) != of(b) and are_alike(names[a], names[b]):
                first, second = sorted((of(a), of(b)))
                same[second] = first
    edges: dict[tuple[str, str, str], bool] = defaultdict(bool)
    for parent, name, many in found:
        # Leaves of one name below different elements are different columns, not one shared element.
        child = of(name) if name in names or name in alike else f"{of(parent)}.{name}"
        edges[of(parent), name, child] |= many
    return SchemaGraph(root, [Edge(p, n, c, many) for (p, n, c), many in sorted(edges.items())])


#: The columns of the table of parts and what they hold, whatever else the records have.
PART_COLUMNS = {
    "body": T.StringType(), "content_type_main": T.StringType(), "content_type_params": T.StringType(), "content_type_sub": T.StringType(),
    "disposition_params": T.StringType(), "disposition_value": T.StringType(), "size": T.StringType(),
}

NODE_SCHEMA = T.StructType(
    [
        T.StructField("node_kind", T.StringType()), T.StructField("node_path", T.StringType()), T.StructField("parent_path", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _as_list(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


# JSON of any depth: the library's reader and writer recurse.

_SKIP = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity)")
_OPEN, _CLOSE = object(), object()


def loads(text: str) -> object:
    """The value of a JSON text, however deep. Raises ValueError if it is none."""
    try:
        return json.loads(text, strict=False)
    except RecursionError:
        return _deep_loads(text)


def _deep_loads(text: str) -> object:
    top: list = []
    stack: list[tuple[object, object]] = [(top, None)]  # container and the key that waits for its value
    at, after = _SKIP.match(text).end(), False
    while True:
        holder, key = stack[-1]
        if after:
            if holder is top:
                if at != len(text):
                    raise ValueError("text after the value")
                return top[0]
            mark = text[at : at + 1]
            if mark == ("]" if isinstance(holder, list) else "}"):
                stack.pop()
                at = _SKIP.match(text, at + 1).end()
                continue
            if mark != ",":
                raise ValueError("no comma")
            at = _SKIP.match(text, at + 1).end()
        elif holder is not top and not holder and text[at : at + 1] == ("]" if isinstance(holder, list) else "}"):
            stack.pop()
            at, after = _SKIP.match(text, at + 1).end(), True
            continue
        if isinstance(holder, dict):
            if text[at : at + 1] != '"':
                raise ValueError("no name")
            key, at = scanstring(text, at + 1, False)
            at = _SKIP.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at = _SKIP.match(text, at + 1).end()
        mark = text[at : at + 1]
        if mark in ("{", "["):
            value: object = {} if mark == "{" else []
            at, after = at + 1, False
        elif mark == '"':
            value, at = scanstring(text, at + 1, False)
            after = True
        elif m := _SCALAR.match(text, at):
            value, at, after = json.loads(m.group()), m.end(), True
        else:
            raise ValueError("no value")
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        if not after:
            stack.append((value, None))
        at = _SKIP.match(text, at).end()


def dumps(x: object) -> str:
    """JSON of a value, however deep."""
    try:
        return json.dumps(x, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[object] = [x]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):
            out.append(v[0])
        elif isinstance(v, dict):
            pieces: list[object] = [("{",)]
            for i, (k, w) in enumerate(v.items()):
                pieces += [((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ",), w]
            todo.extend(reversed([*pieces, ("}",)]))
        elif isinstance(v, list):
            pieces = [("[",)]
            for i, w in enumerate(v):
                pieces += [(", ",), w] if i else [w]
            todo.extend(reversed([*pieces, ("]",)]))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else dumps(x)


def header_pairs(headers: object) -> Iterator[tuple[str, object]]:
    """(name, value) in the order written, from any of the shapes writers give: objects, pairs, or one object with names as keys."""
    if isinstance(headers, dict) and not ("name" in headers and set(headers) <= {"name", "value"}):
        entries: Iterable = headers.items()
    else:
        entries = (
            (e.get("name"), e.get("value")) if isinstance(e, dict) and "name" in e
            else tuple(e[:2]) if isinstance(e, list) and len(e) >= 2 and isinstance(e[0], str)
            else None
            for e in _as_list(headers)
        )
    for entry in entries:
        if entry is None or entry[0] is None:
            continue
        name, value = entry
        for v in value if isinstance(value, list) else [value]:
            yield str(name), v


def content_type(x: object) -> dict:
    """A content type from an object, `main/sub`, or a pair of that and parameters."""
    if isinstance(x, list):
        return content_type(x[0] if x else None) | {"params": x[1] if len(x) > 1 else None}
    if isinstance(x, str):
        main, _, sub = x.partition(";")[0].strip().partition("/")
        return {"main": main.lower() or None, "sub": sub.lower() or None}
    return x if isinstance(x, dict) else {}


_MESSAGE = {"headers", "parts", "content_type", "enclosed"}


def unwrapped(x: object) -> dict | None:
    """The object of a record, out of its wrappers (a text of JSON, a list of one, `message`), however many; null if there is none."""
    try:
        while True:
            if isinstance(x, str):
                x = loads(x)
            elif isinstance(x, list) and len(x) == 1:
                x = x[0]
            elif isinstance(x, dict) and isinstance(x.get("message"), (dict, str)) and not _MESSAGE & set(x):
                x = x["message"]
            else:
                return x if isinstance(x, dict) else None
    except ValueError:
        return None


def readable(text: str | None) -> dict | None:
    """The root object of a record; null if the text is no whole object."""
    return unwrapped(text) if text else None


def mail_children(node: dict, name: str) -> list[object]:
    """What an object of a parsed mail holds under a name, in one shape whichever writer wrote it; null entries keep their place."""
    value = node.get(name)
    if name == "headers":
        return [{"name": n, "value": v} for n, v in header_pairs(value)]
    if name == "content_type":
        return [content_type(value)] if value is not None else []
    if name == "params":  # a map from data to data
        return [] if value is None else [_text(value)]
    if name == "enclosed" and value is not None:
        inner = unwrapped(value) if isinstance(value, (dict, str, list)) else None
        return [inner] if inner is not None else []
    return _as_list(value)


#: Names under which a part holds parts.
MAIL_ALIKE = ("parts", "enclosed")
#: What the path of a row adds to that of its parent, by the name under which it lies.
MAIL_STEPS = {"parts": ".{}", "enclosed": ".e", "headers": "#{}"}
Children = Callable[[dict, str], list]


def observed(root: dict, children: Children = mail_children, seen: set[tuple[str, str, bool]] | None = None) -> set[tuple[str, str, bool]]:
    """(parent, name, many) of everything that a record has, under the names of its objects; the root is `root`. Adds to `seen` if it is given."""
    seen = set() if seen is None else seen
    add = seen.add
    todo = [("root", root)]
    while todo:
        element, node = todo.pop()
        for name, value in node.items():
            if value is None:
                continue
            if not isinstance(value, (dict, list, str)):
                add((element, name, False))
                continue
            if name == "headers" and ("headers", "name", False) in seen and ("headers", "value", False) in seen:
                if value:
                    add((element, name, True))
                continue
            below = [x for x in children(node, name) if x is not None]
            if below:
                add((element, name, name == "headers" or (isinstance(value, list) and name != "content_type")))
                for x in below:
                    if isinstance(x, dict):
                        todo.append((name, x))
    return seen


def shred(root: dict, graph: SchemaGraph, steps: dict[str, str], children: Children = mail_children, with_fields: bool = True) -> Iterator[tuple]:
    """(element, path, parent path, role, ordinal, fields) of the rows of all tables for one record, parents before children."""
    return Shredder(graph, steps, children, with_fields).rows(root)


def _of_node(by_name: dict[str, list], node: dict) -> Iterator[tuple]:
    """What is filed under the names that a node has, whichever are fewer: those of the node or those that are filed."""
    for name in by_name if len(by_name) <= len(node) else node:
        if name in node and name in by_name:
            yield from by_name[name]


class Shredder:
    """Rows of the tables of a graph, for one record after the other.

    Rows are those of the elements to which the graph gives a table; an edge leads from the row of a parent to the rows
    of its children and gives them their foreign key. The walk keeps its own stack, so depth is no limit.
    """

    def __init__(self, graph: SchemaGraph, steps: dict[str, str], children: Children = mail_children, with_fields: bool = True):
        tables = graph.tables()
        self.root, self.children, self.with_fields = graph.root, children, with_fields
        # Columns and links by the first name of their way, so that a node is asked for the names that it has.
        self.columns: dict[str, dict[str, list]] = {e: defaultdict(list) for e in tables}
        for e, columns in tables.items() if with_fields else ():
            for column, way in columns.items():
                self.columns[e][way[0]].append((column, way))
        links = {e: graph.links(e) for e in tables}
        self.links: dict[str, dict[str, list]] = {e: defaultdict(list) for e in tables}
        for e in tables:
            for way, x in links[e]:
                step = steps.get(x.name, "".join(f".{n}" for n in [*way, x.name]) + ".{}")
                self.links[e][[*way, x.name][0]].append((way, x.name, x.child, step, not links[x.child]))

    def fields(self, element: str, node: dict) -> dict[str, str | None] | None:
        """The inlined columns of a row."""
        if not self.with_fields:
            return None
        out = {}
        for column, way in _of_node(self.columns[element], node):
            at: object = node
            for name in way:
                found = self.children(at, name) if isinstance(at, dict) else []
                at = found[0] if len(found) == 1 else at.get(name) if found else None
            if at is not None:
                out[column] = _text(at)
        return out

    def rows(self, root: dict) -> Iterator[tuple]:
        todo: list[tuple] = [(self.root, root, "0", "", "root", 0)]
        while todo:
            element, node, path, parent, role, ordinal = todo.pop()
            yield element, path, parent, role, ordinal, self.fields(element, node)
            below = []
            for way, name, child, step, last in _of_node(self.links[element], node):
                holder: object = node
                for inner in way:
                    found = self.children(holder, inner) if isinstance(holder, dict) else []
                    holder = found[0] if len(found) == 1 else None
                if not isinstance(holder, dict) or name not in holder:
                    continue
                for i, x in enumerate(self.children(holder, name)):
                    if not isinstance(x, dict):
                        continue
                    if last:  # a table that leads to no other
                        yield child, path + step.format(i), path, name, i, self.fields(child, x)
                    else:
                        below.append((child, x, path + step.format(i), path, name, i))
            todo.extend(reversed(below))


def infer_graph(df: DataFrame, record: str, alike: tuple[str, ...] = MAIL_ALIKE) -> SchemaGraph:
    """The schema graph that the records themselves show: distinct (parent, name, many) over all rows.

    Every name of every element counts, also of a root or a map that has any number of them: what reaches the driver is the
    distinct names of the elements. Unreadable records show nothing; without any the graph is the root alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str, bool]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                root = readable(text)
                if root is not None:
                    observed(root, seen=seen)
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["parent", "name", "many"])

    edges = df.select(record).where(F.col(record).isNotNull() & (F.col(record) != "")).mapInArrow(run, "parent string, name string, many boolean").groupBy("parent", "name").agg(F.max("many").alias("many"))
    return unify(((r["parent"], r["name"], r["many"]) for r in edges.toLocalIterator()), "root", alike)


def flatten_records(df: DataFrame, key: str, record: str, with_fields: bool = True, graph: SchemaGraph | None = None) -> DataFrame:
    """One row for each part and header of each readable record: `key` and the columns of NODE_SCHEMA.

    `graph` is inferred from the records unless it is given. The kind of a row is `part` for the root's element, else
    the name under which the element lies (`header` for headers). Null, empty, cut-off and object-less records give no
    row; of several records under one key one counts: of those with an end the longest, then the greatest. It is chosen
    before anything is read, so the shuffle carries records and no rows. `fields` has the inlined columns. Other columns of `df` are dropped first.
    """
    source = df.select(key, record).where(F.col(record).isNotNull() & (F.col(record) != ""))
    graph = graph or infer_graph(source, record)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *NODE_SCHEMA.fields])

    def kind(element: str, role: str) -> str:
        return "part" if element == graph.root else "header" if role == "headers" else role

    # A record that was cut off has lost its end.
    best = F.max(F.struct(F.rtrim(record).rlike(r'[}\]"]\z').alias("ended"), F.length(record).alias("length"), F.col(record).alias("record")))
    once = source.groupBy(key).agg(best.alias("m")).select(key, F.col("m.record").alias(record))
    arrow = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [[kind(r[0], r[3]) for r in rows], *([r[i] for r in rows] for i in range(1, 5)), [None if r[5] is None else list(r[5].items()) for r in rows]]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.fieldNames())

        shredder = Shredder(graph, MAIL_STEPS, with_fields=with_fields)
        for batch in batches:
            at, rows, size = [], [], 0
            for n, text in enumerate(batch.column(1).to_pylist()):
                root = readable(text)
                for row in shredder.rows(root) if root is not None else ():
                    at.append(n)
                    rows.append(row)
                    size += len(row[1])
                    if len(rows) > 20_000 or size > 8 << 20:
                        yield give(batch, at, rows)
                        at, rows, size = [], [], 0
            yield give(batch, at, rows)

    return once.mapInArrow(run, schema)


def part_table(nodes: DataFrame, key: str) -> DataFrame:
    """The table of parts: key, path, the foreign key to the parent part, role, and the inlined columns."""
    columns = [F.col("fields")[c].alias(c) for c in PART_COLUMNS]
    return nodes.where(F.col("node_kind") == "part").select(key, "node_path", "parent_path", "role", "ordinal", *columns)


def header_table(nodes: DataFrame, key: str) -> DataFrame:
    """The table of headers, with the foreign key to their part."""
    return nodes.where(F.col("node_kind") == "header").select(
        key, "node_path", "parent_path", "ordinal", F.col("fields")["name"].alias("name"), F.col("fields")["value"].alias("value")
    )
