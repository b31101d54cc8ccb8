"""Nested JSON as flat tables that keep their links.

Every node of a document gets its pre-order and post-order number in a depth-first
walk. A node lies inside another exactly if its pre-order number is greater and its
post-order number smaller, so tables of any two node types can be linked without
knowing the layout between them. As siblings' intervals are disjoint, the enclosing
node of a type is the last one opened before, which one ordered pass per document finds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesim.session import spread

NODE_SCHEMA = "pre int, post int, depth int, parent int, field string, place int, kind string, value string"
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _loads_deep(text: str) -> object:
    """``json.loads`` with a stack of its own, for texts of any depth."""
    root: list = []
    stack: list[tuple] = []  # (container, name the next value gets)
    into, name = root, None
    at = _BLANK.match(text).end()
    n = len(text)

    def bad() -> ValueError:
        return ValueError(f"no JSON at {at}")

    def keyed(at: int) -> tuple[str, int]:
        """The name at ``at`` and where its value begins."""
        if text[at : at + 1] != '"':
            raise bad()
        key, at = scanstring(text, at + 1, True)
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] != ":":
            raise bad()
        return key, _BLANK.match(text, at + 1).end()

    while True:
        c = text[at : at + 1]
        value: object = None
        opened = False
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c == "{" or c == "[":
            value = {} if c == "{" else []
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                opened = True
        else:
            m = _NUMBER.match(text, at)
            if m:
                value = float(m.group()) if m.group(1) or m.group(2) else int(m.group())
                at = m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise bad()
                value, at = _WORDS[word], at + len(word)
        if isinstance(into, dict):
            into[name] = value
        else:
            into.append(value)
        if opened:
            stack.append((into, name))
            into = value
            if isinstance(into, dict):
                name, at = keyed(at)
            continue
        while True:  # what follows a value
            at = _BLANK.match(text, at).end()
            if not stack:
                if at != n:
                    raise bad()
                return root[0]
            c = text[at : at + 1]
            at += 1
            if c == ",":
                at = _BLANK.match(text, at).end()
                if isinstance(into, dict):
                    name, at = keyed(at)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise bad()
            into, name = stack.pop()


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_deep(text)


def _decoded(text: str) -> object:
    """The value in ``text``; text that holds JSON is decoded again, however often it was encoded (each time it gets shorter)."""
    value = _parsed(text)
    while isinstance(value, str):
        value = _parsed(value)
    return value


def walk(text: str | None, chain: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> list[tuple]:
    """The nodes of a JSON text in pre-order, [] if it is null or cannot be parsed.

    ``field`` is the name under which a node hangs (an array's elements have that of the
    array), ``place`` its position in an array from 1 (0 elsewhere), ``value`` the text of a
    scalar. With names in ``chain`` each row ends with whether it is an object reached from an outermost
    object through objects under these names alone. With ``only`` the rows are those of the root and of nodes under these names;
    numbers are the same. The stack is explicit: depth is not bounded.
    """
    if text is None:
        return []
    try:
        value = _decoded(text)
    except ValueError:
        return []
    out: list[list] = []
    me = done = 0
    stack: list[tuple] = [(value, 0, -1, None, 0, True, None)]
    while stack:
        value, depth, parent, field, place, inner, row = stack.pop()
        if depth < 0:  # a node's end
            if row is not None:
                row[1] = done
            done += 1
            continue
        shown = None
        linked = False
        if isinstance(value, dict):
            kind = "object"
            linked = inner and (depth == 0 or place == 0 and field in chain)
        elif isinstance(value, list):
            kind = "array"
        elif value is None:
            kind = "null"
        elif isinstance(value, bool):
            kind, shown = "boolean", str(value).lower()
        elif isinstance(value, (int, float)):
            kind, shown = "number", _shown(value)
        else:
            kind, shown = "string", value
        row = None
        if only is None or depth == 0 or field in only:
            row = [me, -1, depth, parent, field, place, kind, shown, *([linked] if chain else [])]
            out.append(row)
        if kind == "object" or kind == "array":
            stack.append((None, -1, 0, None, 0, False, row))
            if kind == "object":
                stack.extend([(v, depth + 1, me, k, 0, linked, None) for k, v in reversed(value.items())])
            else:
                stack.extend([(value[i - 1], depth + 1, me, field, i, False, None) for i in range(len(value), 0, -1)])
        else:
            if row is not None:
                row[1] = done
            done += 1
        me += 1
    return [tuple(x) for x in out]


def _shown(value: int | float) -> str:
    try:
        return repr(value) if isinstance(value, int) else json.dumps(value)
    except ValueError:  # an integer of more digits than are written in decimal; as the text of a JSON number it is still one
        return hex(value)


def nodes(df: DataFrame, key: str, text: str, chain: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> DataFrame:
    """The node table of the JSON column ``text``: ``key`` and NODE_SCHEMA. One row a node; documents that cannot be parsed have none.

    ``chain`` and ``only`` are those of ``walk``; with the former there is a column of this name.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ["pre", "post", "depth", "parent", "field", "place", "kind", "value"] + ["chain"] * bool(chain)
    types = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.string(), pa.string()] + [pa.bool_()] * bool(chain)
    clean = lambda v: v if v is None or v.isascii() else v.encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = walk(t, chain, only)
                at.extend([i] * len(found))
                rows.extend(found)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            cols[4], cols[7] = map(clean, cols[4]), map(clean, cols[7])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], [key, *names])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, {NODE_SCHEMA}" + ", chain boolean" * bool(chain))


def enclosing(of: Column, key: str) -> Column:
    """The ``of`` struct (with pre, post; null on other rows) of the latest opened node that contains this one, else null.

    For node types whose nodes do not nest in each other. Ordered by pre within a
    document, so the cost is that of sorting each document's nodes.
    """
    last = F.last(of, ignorenulls=True).over(Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    return F.when((last["pre"] < F.col("pre")) & (last["post"] > F.col("post")), last)


def report_tables(evidence: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of similarity reports: ``reports``, ``blocks``, ``lines``, ``scores``, all with ``evidence_id``.

    A report is the object in evidence_json, itself or below ``report``, ``result`` and
    ``data``. ``blocks`` are its ``matches`` or ``evidence`` elements, ``match_no`` their place
    with null elements counted; ``lines`` have ``match_no, side, line_no``, distinct.
    Rows repeated in the input are walked once. Unparsable and null JSON gives no row.
    """
    key = "evidence_id"
    documents = evidence.select(key, "evidence_json").where("evidence_json IS NOT NULL").distinct().withColumn("_doc", F.monotonically_increasing_id()).select(F.struct(key, "_doc").alias("doc"), "evidence_json")
    # scores have names of their own; for all else the nodes under known names are enough
    known = frozenset(OUTER + BLOCK_FIELDS + tuple(LINE_FIELDS))
    of = lambda only: nodes(documents, "doc", "evidence_json", frozenset(OUTER), only)
    return _linked(of(known), of(None), key)


OUTER = ("report", "result", "data")
BLOCK_FIELDS = ("matches", "evidence")
LINE_FIELDS = {"lineHighlightsA": "a", "line_highlights_a": "a", "lineHighlightsB": "b", "line_highlights_b": "b"}
SCORE_FIELDS = ("scores", "scoreBreakdown")


def _linked(n: DataFrame, every: DataFrame, key: str) -> dict[str, DataFrame]:
    """The typed node tables of reports, linked by interval containment."""
    order = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("pre", "post", "depth")
    within = lambda s: (s["pre"] < F.col("pre")) & (s["post"] > F.col("post"))
    # the report is an object in a chain of outer objects: the latest opened
    n = n.withColumn("_report", F.last(F.when(F.col("chain"), here), ignorenulls=True).over(order))
    lists = F.col("field").isin(*BLOCK_FIELDS) & (F.col("place") == 0) & F.col("kind").isin("array", "object") & (F.col("depth") == F.col("_report.depth") + 1) & within(F.col("_report"))
    n = n.withColumn("_lists", F.when(lists, F.struct("pre", "post", "depth", "kind")))
    n = n.withColumn("_in", F.last("_lists", ignorenulls=True).over(order))
    block = (F.col("_in.kind") == "array") & within(F.col("_in")) & (F.col("depth") == F.col("_in.depth") + 1)
    n = n.withColumn("_block", F.when(block, F.struct("pre", "post", "depth", F.col("place").alias("match_no"), F.col("kind").alias("kind"))).when(F.col("_lists.kind") == "object", F.struct("pre", "post", "depth", F.lit(1).alias("match_no"), F.lit("object").alias("kind"))))
    n = n.withColumn("_of", F.last("_block", ignorenulls=True).over(order))
    side = F.coalesce(*[F.when(F.col("field") == f, s) for f, s in LINE_FIELDS.items()])
    arrays = (F.col("kind") == "array") & (F.col("place") == 0) & side.isNotNull() & (F.col("depth") == F.col("_of.depth") + 1) & within(F.col("_of"))
    n = n.withColumn("_array", F.when(arrays, F.struct("pre", "post", "depth", side.alias("side"), F.col("_of.match_no").alias("match_no"))))
    n = n.withColumn("_line_of", F.last("_array", ignorenulls=True).over(order))
    line_no = F.col("value").try_cast("decimal(38,6)").try_cast("int")
    lines = (
        n.where(F.col("kind").isin("number", "string") & within(F.col("_line_of")) & (F.col("depth") == F.col("_line_of.depth") + 1))
        .select(F.col(f"doc.{key}").alias(key), F.col("_line_of.match_no").alias("match_no"), F.col("_line_of.side").alias("side"), line_no.alias("line_no"))
        .where("line_no IS NOT NULL").distinct()
    )
    score_of = F.last(F.when(F.col("field").isin(*SCORE_FIELDS) & (F.col("kind") == "object"), here), ignorenulls=True).over(order)
    scores = every.withColumn("_s", score_of).where(within(F.col("_s")) & (F.col("kind") == "number")).select(F.col(f"doc.{key}").alias(key), F.col("field").alias("name"), F.col("value").cast("double").alias("score")).distinct()
    blocks = n.where("_block IS NOT NULL").select(F.col(f"doc.{key}").alias(key), F.col("_block.match_no").alias("match_no"), F.col("_block.kind").alias("kind"), "pre", "post").distinct()
    reports = n.where("depth = 0").select(F.col(f"doc.{key}").alias(key), "pre", "post", "kind").distinct()
    return {"reports": reports, "blocks": blocks, "lines": lines, "scores": scores}
