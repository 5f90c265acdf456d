"""HTML extraction by wrapper induction over all pages of one host.

Every page is read into blocks of text with the paths of their elements. Pages of a
host with the same scaffold, the containers around its content, share a layout. On the
distinct pages (copies count once) of a host, and of each of its layouts, every text is
counted with its path: what is the same on nearly all of them is template, the rest are
slots. The wrapper of a layout is its content region, the deepest container that holds
nearly all text of slots, and the constant blocks. It is then applied to every page:
blocks inside the region are the article, but for constants, and for menus, adverts,
forms, comments and the like, which vary too but are told by element, role, class or id.

A page without the region of its layout or host is read by its own article or main
element, or else by its whole body. Constants, and the regions of layouts, are only
trusted where ``min_pages`` distinct pages show them.

Null or empty html gives an empty text. A null url is a host of its own. Repeated rows
each give a row.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .html_dom import BLOCK, CONTAINER, Node, blocks, parse, squeeze


@dataclass(frozen=True)
class WrapperParams:
    min_pages: int = 5
    constant_share: float = 0.9
    region_share: float = 0.9
    #: Wrappers of at most so many bytes in all are broadcast; beyond, they are joined.
    broadcast_bytes: int = 16_000_000


@dataclass
class Folded:
    """Like siblings of a tree as one node: their texts and their children together."""

    label: str
    tag: str
    skipped: bool
    texts: set
    children: list


def _own_text(node: Node) -> str:
    """The text of a node outside its block children."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag not in BLOCK and not c.skipped:
            todo += reversed(c.children)
    return squeeze(parts)


def _block_children(node: Node) -> list[Node]:
    found, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag in BLOCK or c.tag in ("td", "th"):
            found.append(c)
        elif not c.skipped:
            todo += reversed(c.children)
    return found


def fold_tree(nodes: list[Node], depth: int = 0) -> Folded:
    first = nodes[0]
    children: list[list[Node]] = []
    if depth < 60:
        for n in nodes:
            for c in _block_children(n):
                if children and children[-1][0].label == c.label and children[-1][0].skipped == c.skipped:
                    children[-1].append(c)
                else:
                    children.append([c])
    merged: list[list[Node]] = []
    for c in children:  # runs of several folded parents meet again
        if merged and merged[-1][0].label == c[0].label and merged[-1][0].skipped == c[0].skipped:
            merged[-1] += c
        else:
            merged.append(c)
    texts = {t for n in nodes if (t := _own_text(n))}
    return Folded(first.label, first.tag, first.skipped, texts, [fold_tree(c, depth + 1) for c in merged])


def tree_match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: the largest order-keeping match of two trees, and its pairs of nodes."""
    if a.label != b.label or a.skipped != b.skipped:
        return 0, []
    n, m = len(a.children), len(b.children)
    got = [[(0, ())] * (m + 1) for _ in range(n + 1)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = tree_match(a.children[i - 1], b.children[j - 1])
            got[i][j] = w
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + w[0])
    pairs, i, j = [(a, b)], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += got[i][j][1]
            i, j = i - 1, j - 1
    return best[n][m] + 1, pairs


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _key(path: tuple[str, ...], text: str) -> int:
    return _hash("\x1f".join(path) + "\0" + text)


_SCAFFOLD = (CONTAINER | frozenset("header footer nav aside".split())) - {"html", "body"}
#: Levels of containers below the body that tell layouts apart.
SCAFFOLD_DEPTH = 3


def layout_of(root: Node) -> int:
    """A hash of the paths of containers, and of what is never text, around the content of a page."""
    found: set[tuple[str, ...]] = set()
    todo: list[tuple[Node, tuple[str, ...]]] = [(root, ())]
    while todo:
        node, path = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                continue
            if c.tag in _SCAFFOLD:
                found.add(own := (*path, c.label))
                # what lies in the article, or in a menu, differs from page to page
                if len(own) < SCAFFOLD_DEPTH and not (c.skipped or c.doubtful) and c.tag not in ("article", "main"):
                    todo.append((c, own))
            elif not c.skipped and (c.tag in ("html", "body") or c.tag not in BLOCK):
                todo.append((c, path))
    return _hash("\x1e".join(sorted("\x1f".join(x) for x in found)))


def region_of(varying: dict[tuple[str, ...], int], share: float) -> tuple[str, ...]:
    """The deepest container, not inside an article, that holds ``share`` of the text of slots by path."""
    held: dict[tuple[str, ...], int] = defaultdict(int)
    for path, size in varying.items():
        for k in range(1, len(path) + 1):
            held[path[:k]] += size
    least = share * sum(varying.values())
    fit = [
        path
        for path, size in held.items()
        if size >= least > 0 and path[-1].split(".")[0] in CONTAINER and not any(x.split(".")[0] in ("article", "main") for x in path[:-1])
    ]
    return max(fit, key=len, default=())


def _own_region(rows: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
    """Blocks of the page's own article or main element, or else all but its headers."""
    for tag in ("article", "main"):
        own = [r for r in rows if any(x.split(".")[0] == tag for x in r[0])]
        if own:
            return own
    return [r for r in rows if not any(x.split(".")[0] == "header" for x in r[0])]


def _load(wrapper: str) -> dict:
    """A host's wrapper from JSON, its paths as tuples and its constants as a set of each layout."""
    got = json.loads(wrapper)
    common = frozenset(got["constants"])
    layouts = {int(k): (tuple(region), common.union(own)) for k, (region, own) in got["layouts"].items()}
    return {"region": tuple(got["region"]), "constants": common, "layouts": layouts}


def extract(page: str, wrapper: dict | None) -> str:
    """The article's text: its blocks in page order, one a line."""
    root = parse(page)
    rows = blocks(root)
    if wrapper is None:
        return "\n".join(text for _, text in _own_region(rows))
    region, constant = wrapper["layouts"].get(layout_of(root), ((), wrapper["constants"])) if wrapper["layouts"] else ((), wrapper["constants"])
    inside: list[tuple[tuple[str, ...], str]] = []
    for own in (region, wrapper["region"]):
        if not inside and own and own[-1].split(".")[0] not in ("html", "body"):
            inside = [r for r in blocks(root, own) if r[0][: len(own)] == own]
    return "\n".join(text for path, text in inside or _own_region(rows) if not constant or _key(path, text) not in constant)


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


_READ = "host string, layout long, content long, blocks array<struct<key:long,path:long,size:long>>, paths array<struct<path:long,labels:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layout of every page, a hash of its texts, and its distinct blocks by path."""
    schema = pa.schema(
        [
            ("host", pa.string()),
            ("layout", pa.int64()),
            ("content", pa.int64()),
            ("blocks", pa.list_(pa.struct([("key", pa.int64()), ("path", pa.int64()), ("size", pa.int64())]))),
            ("paths", pa.list_(pa.struct([("path", pa.int64()), ("labels", pa.string())]))),
        ]
    )
    for rows, texts in slices(batches):
        out = []
        for host, t in zip(rows.column(0).to_pylist(), texts, strict=True):
            root = parse(t.decode())
            own = blocks(root)
            # doubtful blocks may turn out constant, but a region is not looked for by them
            doubtful = blocks(root, ())
            labels = {path: _hash(json.dumps(path)) for path, _ in own + doubtful}
            found = {_key(path, text): {"path": labels[path], "size": 0} for path, text in doubtful}
            found |= {_key(path, text): {"path": labels[path], "size": len(text)} for path, text in own}
            out.append(
                {
                    "host": host,
                    "layout": layout_of(root),
                    "content": _hash("\n".join(text for _, text in doubtful)),
                    "blocks": [{"key": k, **v} for k, v in found.items()],
                    "paths": [{"path": h, "labels": json.dumps(path)} for path, h in labels.items()],
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def learn_wrappers(pages: DataFrame, p: WrapperParams = WrapperParams()) -> DataFrame:
    """(host, wrapper) with the wrapper as JSON, from counts over all distinct pages of each host."""
    read = pages.where("html <> ''").select(_host("url").alias("host"), "html").mapInArrow(_read, _READ)
    distinct = cut(read.dropDuplicates(["host", "layout", "content"]))
    n_layout = cut(distinct.groupBy("host", "layout").agg(F.count("*").alias("n_layout")))
    n_host = n_layout.groupBy("host").agg(F.sum("n_layout").alias("n_host"))
    least = lambda n: F.greatest(F.lit(p.min_pages), F.lit(p.constant_share) * F.col(n))

    rows = distinct.select("host", "layout", F.inline("blocks"))
    # a text of a path by layout; texts on fewer pages than any constant needs are left out
    by_host = rows.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_pages)
    known = by_host.join(n_host, "host").select("host", "key", (F.col("n") >= least("n_host")).alias("common"))
    by_layout = rows.groupBy("host", "layout", "key").agg(F.first("path").alias("path"), F.first("size").alias("size"), F.count("*").alias("n"))
    constants = by_layout.join(known, ["host", "key"]).join(n_layout, ["host", "layout"]).where(F.col("common") | (F.col("n") >= least("n_layout")))
    constants = cut(constants.select("host", "layout", "key", "path", "common", (F.col("n") * F.col("size")).alias("size")))

    size = rows.select("host", "layout", "path", "size").unionByName(constants.select("host", "layout", "path", (-F.col("size")).alias("size")))
    labels = distinct.select(F.inline("paths")).distinct()
    varying = size.groupBy("host", "layout", "path").agg(F.sum("size").alias("size")).join(labels, "path").select("host", "layout", "labels", "size")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    whole = (
        varying.select("host", "layout", none("long", "n"), "labels", "size", none("long", "key"), none("boolean", "common"))
        .unionByName(n_layout.select("host", "layout", F.col("n_layout").alias("n"), none("string", "labels"), none("long", "size"), none("long", "key"), none("boolean", "common")))
        .unionByName(constants.select("host", "layout", none("long", "n"), none("string", "labels"), none("long", "size"), "key", "common"))
    )

    def one(key: tuple, table: pa.Table) -> pa.Table:
        pages_of: dict[int, int] = {}
        sizes: dict[int, dict[tuple[str, ...], int]] = defaultdict(lambda: defaultdict(int))
        common: set[int] = set()
        own: dict[int, set[int]] = defaultdict(set)
        for r in table.to_pylist():
            if r["n"] is not None:
                pages_of[r["layout"]] = r["n"]
            elif r["labels"] is not None:
                sizes[r["layout"]][tuple(json.loads(r["labels"]))] += r["size"]
            elif r["common"]:
                common.add(r["key"])
            else:
                own[r["layout"]].add(r["key"])
        whole: dict[tuple[str, ...], int] = defaultdict(int)
        for by_path in sizes.values():
            for path, n in by_path.items():
                whole[path] += n
        layouts = {str(x): [region_of(sizes[x], p.region_share), sorted(own[x])] for x, n in sorted(pages_of.items()) if n >= p.min_pages}
        got = {"region": region_of(whole, p.region_share), "constants": sorted(common), "layouts": layouts}
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(got)]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    return whole.groupBy("host").applyInArrow(one, "host string, wrapper string")


def extract_pages(pages: DataFrame, p: WrapperParams = WrapperParams()) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``."""
    wrappers = cut(learn_wrappers(pages, p))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    side = F.broadcast(wrappers) if size <= p.broadcast_bytes else wrappers.hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for rows, texts in slices(batches, 2):
            out = []
            for w, t in zip(rows.column(3).to_pylist(), texts, strict=True):
                if w is not None and w not in known:
                    if len(known) > 200:
                        known.clear()
                    known[w] = _load(w)
                out.append(extract(t.decode(), known.get(w)) if t else "")
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = pages.select("page_id", "url", "html", _host("url").alias("host")).join(side, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
