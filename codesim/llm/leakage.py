"""Evaluation texts inside training text, by an Aho-Corasick automaton.

Words are maximal runs of letters and digits in lower case. Every run of WORDS words of a
test item is a pattern; all patterns of a block of items make one automaton, which
reads each document's normalised text once. Hits are mapped back to offsets of the
original text. Items beyond one block make further automata, and the corpus is read once
for each, so nothing that is sent to a task grows past BLOCK_CHARS. Tasks get the items' texts;
a worker builds the automaton once and keeps it for its later tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codesim.session import spread

WORDS = 12
BLOCK_CHARS = 4_000_000  # characters of normalised items in one automaton (about 1 GB at worst)
_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> str:
    """The words of a text, each followed by one space, after one space."""
    return " " + _GAP.sub(" ", text.lower()).strip() + " "


def patterns(items: list[tuple], words: int) -> dict[str, list]:
    """Every run of ``words`` words, with a space before and behind it, and the ids that hold it."""
    found: dict[str, set] = {}
    for item, text in items:
        w = normalised(text).split()
        for i in range(len(w) - words + 1):
            found.setdefault(f" {' '.join(w[i : i + words])} ", set()).add(item)
    return {p: sorted(ids) for p, ids in found.items()}


def _automaton(found: dict[str, list]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for p, ids in found.items():
        automaton.add_word(p, (len(p), ids))
    automaton.make_automaton()
    return automaton


def original_spans(text: str, first_word: int, words: int) -> tuple[int, int]:
    """Start and end (from 0, end excluded) in the text of the words first_word .. first_word + words - 1."""
    lowered = text.lower()
    if len(lowered) == len(text):
        source = lowered
        back = None
    else:  # some letters grow in lower case
        back = [i for i, c in enumerate(text) for _ in c.lower()]
        source = "".join(c.lower() for c in text)
    start = end = 0
    for k, m in enumerate(_WORD.finditer(source)):
        if k == first_word:
            start = m.start()
        if k == first_word + words - 1:
            end = m.end()
            break
    return (start, end) if back is None else (back[start], back[end - 1] + 1)


_kept: dict[tuple, ahocorasick.Automaton | None] = {}  # the last block's automaton


def _worker_automaton(items: list[tuple], words: int, block: str) -> ahocorasick.Automaton | None:
    """The automaton of a block of items, None without patterns."""
    if (block, words) not in _kept:
        _kept.clear()
        found = patterns(items, words)
        _kept[block, words] = _automaton(found) if found else None
    return _kept[block, words]


def _scan(rows: list[tuple], words: int, offsets: bool, types: tuple[pa.DataType, pa.DataType]):
    block = hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _worker_automaton(rows, words, block)
        if automaton is None:
            return
        for batch in batches:
            docs, items, starts, ends = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = normalised(text)
                hit: dict = {}
                for end, (length, ids) in automaton.iter(flat):
                    for item in ids:
                        a, b = hit.get(item, (end, end))
                        hit[item] = (min(a, end - length + 1), max(b, end))
                for item, (a, b) in hit.items():
                    docs.append(doc)
                    items.append(item)
                    if offsets:
                        first = flat.count(" ", 0, a)
                        start, end = original_spans(text, first, flat.count(" ", a + 1, b + 1))
                        starts.append(start)
                        ends.append(end)
            columns = [pa.array(docs, types[0]), pa.array(items, types[1])]
            if offsets:
                columns += [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first", "end"][: len(columns)])

    return run


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, offsets: bool = False) -> DataFrame:
    """``doc_id, item_id`` of documents and items with at least ``words`` consecutive words in common, once each.

    With ``offsets`` also ``first, end``: where in the original text (from 0, end excluded) the
    first shared run begins and the last ends. Null texts and items of fewer words are
    in no case; repeated rows change nothing; other columns are ignored.
    """
    key, item = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    out = f"doc_id {key.simpleString()}, item_id {item.simpleString()}" + ", first int, end int" * offsets
    types = (to_arrow_type(key), to_arrow_type(item))
    docs = spread(documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL"))
    result, block, held = None, [], 0
    held_items = items.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").distinct()

    def scanned(rows: list[tuple]) -> DataFrame:
        return docs.mapInArrow(_scan(rows, words, offsets, types), out)

    for row in held_items.toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1]) * words  # a pattern starts at every word
        if held >= BLOCK_CHARS * words:
            result = scanned(block) if result is None else result.union(scanned(block))
            block, held = [], 0
    if block or result is None:
        result = scanned(block) if result is None else result.union(scanned(block))
    if offsets:
        return result.groupBy("doc_id", "item_id").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return result.distinct()
