"""Hashes of syntax subtrees, and clones by them.

Trees come from the standard library: ``ast`` for Python, ``html.parser`` for
HTML, and for all other languages, and what ``ast`` rejects, the nesting of brackets over the tokens of the lexer.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.config import ScanConfig
from twinweave.operators.lexer import KINDS, lex, parseable
from twinweave.session import spread
from twinweave.sources.languages import language

SCHEMA = "file_idx bigint, hash_hex string, line_start int, line_end int, byte_offset bigint, node_kind string, depth int"


@dataclass
class Node:
    kind: str
    start: int = 1
    end: int = 1
    offset: int = 0
    children: list[Node] = field(default_factory=list)


_UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)


def _python(text: str) -> Node:
    offsets = [0]
    for line in text.split("\n"):
        offsets.append(offsets[-1] + len(line.encode("utf-8", "surrogatepass")) + 1)

    def one(n: ast.AST, at: Node, shift: int) -> Node:
        start = n.lineno + shift if hasattr(n, "lineno") else at.start
        return Node(type(n).__name__, start, (getattr(n, "end_lineno", None) or start - shift) + shift if hasattr(n, "lineno") else at.end, offsets[start - 1] + getattr(n, "col_offset", 0))

    def build(n: ast.AST, at: Node, shift: int = 0) -> Node:
        root = one(n, at, shift)
        todo = [(n, root)]
        while todo:  # however deep
            n, node = todo.pop()
            for c in ast.iter_child_nodes(n):
                child = one(c, node, shift)
                node.children.append(child)
                todo.append((c, child))
        return root

    try:
        return build(ast.parse(text), Node("Module", 1, text.count("\n") + 1))
    except _UNPARSED:
        pass
    lines = text.split("\n")
    try:
        return Node("ERROR", 1, len(lines), 0, _statements(lines, offsets, build))
    except RecursionError:
        return Node("ERROR", 1, len(lines), 0, _brackets(text, "Python").children)


def _statements(lines: list[str], offsets: list[int], build: Callable[..., Node]) -> list[Node]:
    """The trees of the statements of a text that doesn't parse as a whole; of those that don't parse either, their blocks' statements, and brackets."""
    _, _, first, last, _ = lex("\n".join(lines), language("Python"))
    inside = {n for x, y in zip(first.tolist(), last.tolist()) for n in range(x + 1, y + 1)}  # lines that begin in a string
    begun = set(first.tolist())
    indent = [len(x) - len(x.lstrip()) for x in lines]

    def parts(lo: int, hi: int) -> list[Node]:
        """Of the lines from lo to before hi, from 0."""
        own = [i for i in range(lo, hi) if i + 1 in begun and i + 1 not in inside]
        if not own:
            return []
        least = min(indent[i] for i in own)
        heads = [i for i in own if indent[i] == least and not _GOES_ON.match(lines[i], least)]
        heads = [i for n, i in enumerate(heads) if n == 0 or not lines[heads[n - 1]].lstrip().startswith("@")]
        heads = [lo, *heads[1:]] if heads and heads[0] >= own[0] else [lo, *heads]
        return [t for i, j in zip(heads, [*heads[1:], hi]) for t in statement(i, j)]

    def statement(lo: int, hi: int) -> list[Node]:
        text = "\n".join(lines[lo:hi])
        own = next((i for i in range(lo, hi) if i + 1 in begun), lo)
        deep = indent[own] > 0
        try:
            tree = ast.parse(f"if 1:\n{text}" if deep else text)
            return [build(x, Node("", lo + 1, hi), lo - deep) for x in (tree.body[0].body if deep else tree.body)]
        except _UNPARSED:
            head = next((i for i in range(own + 1, hi) if i + 1 in begun and i + 1 not in inside), hi)
            broken = _brackets("\n".join(lines[lo:head]), "Python", lo, offsets[lo]).children
            return [Node("ERROR", lo + 1, hi, offsets[lo], broken + parts(head, hi))]

    return parts(0, len(lines))


#: How a line begins that goes on with the statement before it.
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.root = Node("document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        line, _ = self.getpos()
        node = Node(tag, line, line)
        self.open[-1].children.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.kind == tag for n in self.open[1:]):
            while True:
                node = self.open.pop()
                node.end = self.getpos()[0]
                if node.kind == tag:
                    break


def _brackets(text: str, name: str, line: int = 0, offset: int = 0) -> Node:
    """The tree of brackets; line and offset are what stands before the text."""
    kind, tok, a, b, at = lex(text, language(name))
    a, b, at = a + line, b + line, at + offset
    root = Node("source", 1 + line, text.count("\n") + 1 + line, offset)
    stack = [root]
    for k, t, x, y, o in zip(kind.tolist(), tok.tolist(), a.tolist(), b.tolist(), at.tolist()):
        mark = chr(t - 2000) if k == 4 else ""
        if mark in ("(", "[", "{"):
            node = Node(mark, x, y, o)
            stack[-1].children.append(node)
            stack.append(node)
        elif mark in (")", "]", "}") and len(stack) > 1:
            stack.pop().end = y
        else:
            stack[-1].children.append(Node(mark or f"{KINDS[k]}{t if k == 3 else ''}", x, y, o))
    return root


@lru_cache(maxsize=1 << 16)
def _leaf(kind: int, tok: int) -> str:
    """The hash of a token by itself."""
    return hashlib.sha256((chr(tok - 2000) if kind == 4 else f"{KINDS[kind]}{tok if kind == 3 else ''}").encode()).hexdigest()


_OPENS, _CLOSES = [2000 + ord(c) for c in "([{"], [2000 + ord(c) for c in ")]}"]


def _bracket_hashes(text: str, name: str, min_depth: int) -> list[tuple[str, int, int, int, str, int]]:
    """What hashing the tree of _brackets gives, without making the tree: a subtree is hashed when its bracket closes, and what stands between two brackets is joined at once."""
    kind, tok, first, last, offset = lex(text, language(name))
    leaves = [_leaf(k, t) for k, t in zip(kind.tolist(), tok.tolist())]
    at = np.flatnonzero((kind == 4) & np.isin(tok, _OPENS + _CLOSES))
    out: list[tuple[str, int, int, int, str, int]] = []
    # of each open subtree: kind, first and last line, offset, hashes of its children, its greatest child's depth
    stack: list[list] = [["source", 1, text.count("\n") + 1, 0, [], 0]]

    def close() -> None:
        what, a, b, o, parts, below = stack.pop()
        h = hashlib.sha256((what + "".join(parts)).encode()).hexdigest()
        if below + 1 >= min_depth:
            out.append((h, a, b, o, what, below + 1))
        if stack:
            stack[-1][4].append(h)
            stack[-1][5] = max(stack[-1][5], below + 1)

    def plain(lo: int, hi: int) -> None:
        if lo < hi:
            stack[-1][4] += leaves[lo:hi]
            stack[-1][5] = max(stack[-1][5], 1)

    begin = 0
    for i, t, a, b, o in zip(at.tolist(), tok[at].tolist(), first[at].tolist(), last[at].tolist(), offset[at].tolist()):
        plain(begin, i)
        begin = i + 1
        if t in _OPENS:
            stack.append([chr(t - 2000), a, b, o, [], 0])
        elif len(stack) > 1:
            stack[-1][2] = b
            close()
        else:
            plain(i, i + 1)
    plain(begin, len(leaves))
    while stack:
        close()
    return out


@lru_cache(maxsize=1024)
def _kind_hash(kind: str) -> str:
    return hashlib.sha256(kind.encode()).hexdigest()


def _python_hashes(text: str, min_depth: int) -> list[tuple[str, int, int, int, str, int]]:
    """What hashing the tree of _python gives for a text that ast takes, without making the tree; raises what ast raises."""
    tree = ast.parse(text)
    offsets = [0]
    for line in text.split("\n"):
        offsets.append(offsets[-1] + (len(line) if line.isascii() else len(line.encode("utf-8", "surrogatepass"))) + 1)
    out: list[tuple[str, int, int, int, str, int]] = []
    leaf, node_type = _kind_hash, ast.AST

    def visit(n: ast.AST, start: int, end: int) -> tuple[str, int]:
        what = n.__class__.__name__
        line = getattr(n, "lineno", None)
        if line is not None:
            start, end = line, n.end_lineno or line
        parts, below = [], 0
        for f in n._fields:
            v = getattr(n, f, None)
            if v.__class__ is list:
                for x in v:
                    if isinstance(x, node_type):
                        h, d = visit(x, start, end)
                        parts.append(h)
                        if d > below:
                            below = d
            elif isinstance(v, node_type):
                h, d = visit(v, start, end)
                parts.append(h)
                if d > below:
                    below = d
        if not parts:
            return leaf(what), 1
        h = hashlib.sha256((what + "".join(parts)).encode()).hexdigest()
        if below + 1 >= min_depth:
            out.append((h, start, end, offsets[start - 1] + getattr(n, "col_offset", 0), what, below + 1))
        return h, below + 1

    visit(tree, 1, text.count("\n") + 1)
    return out


def subtree_hashes(text: str, name: str, min_depth: int = 2) -> list[tuple[str, int, int, int, str, int]]:
    """(hash, first line, last line, byte offset, kind, depth) of the subtrees at least min_depth deep, children before parents.

    A hash is of the node's kind and its children's hashes: names and values don't count.
    Nodes of comments aren't hashed, and neither they nor strings are listed, nor the nodes of kind ERROR that
    hold together what is left of Python that doesn't parse.
    """
    if name == "Python":
        if min_depth > 1:
            try:
                return _python_hashes(text, min_depth)
            except _UNPARSED:
                pass
        root = _python(text)
    elif name == "HTML":
        parser = _Html()
        parser.feed(text)
        root = parser.root
    elif min_depth > 1:
        return _bracket_hashes(text, name, min_depth)
    else:
        root = _brackets(text, name)
    out: list[tuple[str, int, int, int, str, int]] = []
    # post-order without recursion, so that deep trees are no limit
    result: dict[int, tuple[str, int]] = {}
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
            continue
        parts = [result[id(c)] for c in node.children if "comment" not in c.kind.lower()]
        h = hashlib.sha256((node.kind + "".join(p[0] for p in parts)).encode()).hexdigest()
        depth = 1 + max((result[id(c)][1] for c in node.children), default=0)
        result[id(node)] = (h, depth)
        low = node.kind.lower()
        if depth >= min_depth and node.kind != "ERROR" and "comment" not in low and "string" not in low:
            out.append((h, node.start, node.end, node.offset, node.kind, depth))
    return out


def ast_hashes(source_files: DataFrame, config: ScanConfig = ScanConfig(), min_depth: int = 2) -> DataFrame:
    """The subtree hashes of every file that a scan reads; of files that can't be parsed, those of their parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = [(i, *r) for i, name, text in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)) for r in subtree_hashes(text, name, min_depth)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spread(parseable(source_files, config), "file_idx").mapInArrow(make, SCHEMA)


def structural_clones(hashes: DataFrame, min_depth: int = 4) -> DataFrame:
    """(hash_hex, node_kind, n_places, n_files, first_file) of the subtrees that more than one file has: one row per class, not its pairs."""
    one = hashes.where(F.col("depth") >= min_depth).where(~F.col("node_kind").isin("ERROR", "MISSING")).select("hash_hex", "node_kind", "file_idx", "line_start", "line_end", "byte_offset").distinct()
    by_file = one.groupBy("hash_hex", "node_kind", "file_idx").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy("hash_hex", "node_kind").agg(F.sum("n").alias("n_places"), F.count(F.lit(1)).alias("n_files"), F.min("file_idx").alias("first_file")).where("n_files > 1")
