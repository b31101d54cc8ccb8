"""Template residue, filler, error pages and notices in place of content.

Records are cut into passages: lines, and the surroundings of whatever looks like a slot of a
template. A naive Bayes model of residue against everything else is learned from positive and
unlabelled passages. Positive are those of trusted records: a bounded sample (TRUSTED) of
records that lists of phrases and shapes know as an error, a notice, filler or an unfilled form.
All other records are unlabelled, and expectation-maximization estimates their
class: a round scores all passages, and a line counts as residue by its probability, but only if
its record is decided so; rounds end when the likelihood of held-out records no
longer grows. The lists label that sample and nothing else: what is residue is decided by the
model's scores alone, of trusted records, too.

A record is residue if one of its slots is scored unfilled, or if its lines are
scored residue but for a small part. So what quotes, prints or discusses such
phrases amid real content is none.

All records count. Their words are numbered once, in a checkpointed table which every round and
the decision read; the model is two numbers a bucket, whatever the corpus.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codesim.session import checkpointed, forget, spread

BUCKETS = 1 << 17  # of words and features
TRUSTED = 50_000  # trusted records that are labelled; of more an even sample by their keys' hashes
ROUNDS = 20  # of expectation-maximization at most
GAIN = 1e-4  # of held-out log likelihood a passage, below which rounds end
HELD_OUT = 0.1  # share of unlabelled records that only measure the likelihood
CONTENT = 0.34  # share of a record's words in other passages up to which it is residue
MOST_WORDS = 40  # words of one passage; longer lines make several
PRIOR = 0.1  # weight of the common distribution in either class, against what is counted
LABEL_WORDS = 60  # words of a record that phrases can label; longer ones stay unlabelled

#: Phrases that label a record as an error, a notice or filler, between words in lower case.
PHRASES = """
[45]\\d\\d (?:bad request|unauthorized|forbidden|not found|method not allowed|request time ?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time ?out)
(?:error|erreur|fehler) [45]\\d\\d | internal server error | access denied | request (?:blocked|denied|rejected) | (?:page|file) not found | not found on this server | error code
service (?:temporarily )?unavailable | something went wrong | traceback most recent call last | fatal error | connection (?:refused|reset|timed out) | timed out after | upstream connect
too many requests | (?:quota|rate limit) exceeded | (?:unable|failed) to load | (?:could not|cannot|can t) (?:reach|connect) | java lang \\w+(?:exception|error) | session (?:has )?expired | try again later
(?:enable|activate|turn on|allow|requires?|needs?|without) (?:\\w+ ){0,4}(?:javascript|cookies|scripts?) | (?:javascript|cookies|scripts?) (?:\\w+ ){0,4}(?:required|disabled|enabled|turned on|turned off|switched off)
noscript | browser does not support | checking your browser | (?:activer|aktivieren sie|active|habilite) (?:le )?(?:javascript|cookies)
page introuvable | seite nicht (?:gefunden|verfügbar) | página no encontrada | accès refusé | zugriff verweigert | acceso denegado | erreur interne | zeitüberschreitung | tiempo de espera | délai d attente dépassé
lorem ipsum | dolor sit amet | (?:sample|placeholder|dummy) text | coming soon | under construction | intentionally left blank
goes here | (?:your|the) (?:code|answer|solution|text) here | (?:write|put|add|enter) your (?:own )?(?:code|answer|solution|text) | (?:implement|replace) (?:me|this) | todo
"""
_PHRASE = re.compile(r"\b(?:" + "|".join(p.strip() for line in PHRASES.strip().splitlines() for p in line.split(" | ")) + r")\b")
#: Words of Latin filler; words before a slot that speak of it.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud".split())
MENTIONS = frozenset("every each any called named replace like placeholder placeholders".split())
#: First words of a slot that asks for something.
PROMPTS = frozenset("your insert enter fill add type".split())
_WORDS = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_TELLING_TAG = re.compile(r"<(?:noscript|error|code)\b")
_OPEN = re.compile(r"^\W*\w+(?: \w+)?\s*[:.]?\s*(?:n/?a|todo|tba|tbd|none|\.{2,}|-+|\?+|_{3,})\W*$", re.I)

# what looks like a slot: a few words in brackets or marks that stand by themselves, or joined capitals
_INSIDE = r"[^{}%()\[\]<>«»@\n\"']{1,40}"
_SHAPES = {
    "braces": rf"\{{\{{{_INSIDE}\}}\}}", "block": rf"\{{%{_INSIDE}%\}}", "scriptlet": rf"<%{_INSIDE}%>", "dollar": rf"\$\{{{_INSIDE}\}}", "hash": rf"#\{{{_INSIDE}\}}", "call": rf"\$\({_INSIDE}\)",
    "double": rf"\[\[{_INSIDE}\]\]", "angles": rf"<<{_INSIDE}>>", "quotes": rf"«{_INSIDE}»", "at": r"@@\w{1,40}@@", "percent": r"%[A-Za-z_]{2,40}%", "under": r"__[A-Za-z]\w{1,40}__",
    "angle": r"<[A-Za-z_ ]{2,40}>", "square": r"\[[A-Za-z_ ]{2,40}\]", "round": r"\([A-Za-z_ ]{2,40}\)", "capitals": r"[A-Z]{2,}(?:[_-][A-Z]+)+(?!\w)",
}
_MARKERS = {"braces": "{{", "block": "{%", "scriptlet": "<%", "dollar": "${", "hash": "#{", "call": "$(", "double": "[[", "angles": "<<", "quotes": "«", "at": "@@", "percent": "%", "under": "__", "angle": "<", "square": "[", "round": "("}
_FINDERS = [(k, _MARKERS.get(k, ""), re.compile(p)) for k, p in _SHAPES.items()]
_PLAIN = frozenset(("angle", "square", "round", "capitals", "under"))  # not right behind a word or a closer
_ENGINES = frozenset(_SHAPES) - {"angle", "square", "round", "capitals"}  # forms that template engines have
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:def |return\b|import |#include|for |if |while |print\(|else|class )|^\s*(?://|/\*|\*)|\(.*\)\s*$")

# -- words as numbers

_TOKEN = re.compile(r"[^\W_]+|_{3,}|[;{}=<(\[|\"]|[^\w\s\x00-\x7f]+|[\n\r\v\f\x85\u2028\u2029]")
_SPECIAL = 64  # buckets below: 0 a line end, marks and numbers; _BLANK counts as a word all the same
_MARKS = {m: i for i, m in enumerate(';{}=<([|"', 1)}
_SYMBOL, _LONG, _NUMBER, _ID, _CAMEL, _BLANK = 11, 12, 13, 24, 40, 41


def hashed(word: str) -> int:
    """The word's bucket, the same in every process."""
    h = 0x811C9DC5
    for c in word.encode("utf-8", "replace"):
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return (h ^ h >> 15) % (BUCKETS - _SPECIAL) + _SPECIAL


def _number(word: str) -> int:
    if word.isdigit():
        return _NUMBER + (min(len(word), 6) if len(word) != 3 else {"4": 7, "5": 8}.get(word[0], 3))
    stem = word if word.isalpha() else word.rstrip("0123456789")
    if not stem.isalpha():  # other mixtures are ids
        return _ID + min(len(word).bit_length(), 8)
    if len(stem) > 24:
        return _LONG
    return _CAMEL if stem[1:] != stem[1:].lower() and not stem.isupper() else hashed(stem.lower())


def bucket(word: str) -> int:
    """A token's bucket: words in lower case, numbers at their end aside, marks, numbers, ids and camel case by kind."""
    c = word[0]
    if c in _MARKS:
        return _MARKS[c]
    if c == "_":
        return _BLANK
    return _number(word) if c.isalnum() else 0 if c.isspace() else _SYMBOL


class _Known(dict):
    """The buckets of tokens met before, so many at most."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        b = self[word] = bucket(word)
        return b


_known = _Known()


def numbers_of(text: str) -> list[int]:
    return list(map(_known.__getitem__, _TOKEN.findall(text)))


#: What a passage is: a line, or a slot, which may be bare and of a form that is known, or spoken of.
LINE, SLOT, LISTED, SPOKEN = 0, 1, 2, 3


def slots_of(text: str) -> list[tuple[str, bool, int, list[int]]]:
    """Of each slot its shape, whether it lies in a line of code, which kind of passage it is, and its features: shape, words inside and around."""
    spans = []
    for shape, marker, pattern in _FINDERS:  # one by one: each begins with a fixed mark, which is found fast
        if marker in text:
            for m in pattern.finditer(text):
                a = m.start()
                if not (shape in _PLAIN and a and (text[a - 1].isalnum() or text[a - 1] in "_)]>")):
                    spans.append((a, m.end(), shape))
    if not spans:
        return []
    out, last = [], 0
    for a, z, shape in sorted(spans):
        if a < last:
            continue
        last = z
        told = text[a:z]
        begin = text.rfind("\n", 0, a) + 1
        end = text.find("\n", z)
        line = text[begin:] if end < 0 else text[begin:end]
        before, after = line[: a - begin], line[z - begin :]
        quoted = any(before.count(q) % 2 and q in after for q in "\"`") or before.count("'") % 2 == 1 and "'" in after
        inside = _WORDS.findall(told)
        left, right = _WORDS.findall(before[-80:])[-3:], _WORDS.findall(after[:80])[:3]
        left, right = ([w.lower() if w.isalpha() else "0" for w in ws] for ws in (left, right))
        case = "U" if told == told.upper() else "l" if told == told.lower() else "M"
        code = bool(_CODE.search(line))
        told = [f"q{quoted}", f"k{shape}{min(len(inside), 4)}{case}", f"c{code}{quoted}", *(f"i{w.lower()}" for w in inside[:4]), *(f"l{w}" for w in left), *(f"r{w}" for w in right)]
        told += [f"a{left[-1] if left else '^'}", f"b{right[0] if right else '$'}", "n" + "".join("w" if c.isalnum() else c for c in (before[-1:], after[:1]))]
        known = shape in _ENGINES or inside and inside[0].lower() in PROMPTS
        kind = SLOT if quoted else SPOKEN if left and left[-1] in MENTIONS else LISTED if known else SLOT
        out.append((shape, code, kind, [hashed("§" + f) for f in told]))
    return out


# -- labels of the sample


def _monotone(words: list) -> object | None:
    """The word of which nearly all of a record consists."""
    if len(words) < 4:
        return None
    most, times = Counter(words).most_common(1)[0]
    return most if times >= 0.8 * len(words) else None


def trusted(text: str, numbers: list[int], slots: list[tuple]) -> int:
    """1 for a record that is filler, an error or a notice beyond doubt, 2 for one with bare slots of known forms amid prose, or of several template engines, else 0."""
    if any(kind == LISTED and not code for _, code, kind, _ in slots) or len({shape for shape, _, kind, _ in slots if kind == LISTED} & _ENGINES) >= 2:
        return 2
    if any(shape in _ENGINES for shape, *_ in slots):
        return 0
    if len(numbers) > 4 * LABEL_WORDS and 3 * len(set(numbers)) > len(numbers):
        return 0  # long, and of too many different words
    words = [n for n in numbers if n >= _CAMEL]
    if len(words) >= 4 and _monotone(words) is not None:
        return 1
    if len(words) <= LABEL_WORDS or 4 * len(set(words)) <= len(words):
        lines = [x for x in text.splitlines() if x and not x.isspace()]
        if len(lines) >= 2 and all(map(_OPEN.match, lines)):
            return 1
        if len(lines) and _monotone([s for s in map(str.strip, re.split(r"[.\n]+", text.lower())) if s]) is not None:
            return 1
        lower = text.lower()
        plain = _WORDS.findall(lower if _TELLING_TAG.search(lower) else _TAG.sub(" ", lower))
        if len(plain) >= 4 and 5 * sum(w in LATIN for w in plain) >= len(plain):
            return 1
        if len(plain) <= LABEL_WORDS:  # a phrase opens the record or makes up a fifth of it
            joined = " ".join(plain)
            hits = [(joined.count(" ", 0, m.start()), m.group().count(" ") + 1) for m in _PHRASE.finditer(joined)]
            return int(bool(hits) and (hits[0][0] <= 1 or 5 * sum(n for _, n in hits) > len(plain)))
    return 0


# -- the table of numbered records

RECORD_SCHEMA = "pick double, label int, words array<int>, lengths array<int>, sizes array<int>, kinds array<int>"


def _passages(records: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of numbered records, each record ended by a 0: features of each passage (every word once, and the record's size and repetition), their numbers, words of each passage, its record."""
    of = np.repeat(np.arange(len(records)), [len(r) for r in records])
    flat = np.fromiter(chain.from_iterable(records), np.int64, len(of))
    word = flat > 0
    count = np.bincount(of, word, len(records))
    distinct = np.array([len(set(r)) - 1 for r in records], np.int64)
    size = np.clip(np.log2(np.maximum(count, 1)).astype(np.int64) // 2, 1, 4)
    rate = np.clip((4 * np.log2(np.maximum(count, 1) / np.maximum(distinct, 1))).astype(np.int64), 0, 8)
    begins = np.r_[True, ~word[:-1]] if len(flat) else np.zeros(0, bool)
    at = np.arange(len(flat))
    within = at - np.maximum.accumulate(np.where(begins, at, 0))
    begins |= within % MOST_WORDS == 0
    passage = np.cumsum(begins) - 1 if len(flat) else at
    n = int(passage[-1]) + 1 if len(flat) else 0
    natural = np.bincount(passage, (flat >= _SPECIAL) | (flat == _BLANK) | (flat == _CAMEL), n) > 0  # others say nothing
    words = np.bincount(passage, word, n)
    keep = natural[passage] & word if len(flat) else word
    record = np.zeros(n, np.int64)
    record[passage] = of
    whole = np.flatnonzero(natural)
    repeated = whole[(count[record[whole]] >= 8) & (rate[record[whole]] >= 4)]
    pairs = np.concatenate([(passage * BUCKETS + flat)[keep], whole * BUCKETS + 50 + size[record[whole]], repeated * BUCKETS + 54 + rate[record[repeated]]])
    pairs.sort()
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    lengths = np.bincount(pairs // BUCKETS, minlength=n)[whole]
    return pairs % BUCKETS, lengths, words[whole].astype(np.int64), record[whole]


def _records(key_type: pa.DataType):
    """Numbers the records: one row each, null and blank ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, labels, slot_words, slot_lengths, slot_kinds, slot_counts = [], [], [], array("i"), array("i"), array("i"), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text or text.isspace():
                    continue
                own, slots = numbers_of(text), slots_of(text)
                rows.append(i)
                labels.append(trusted(text, own, slots))
                own.append(0)
                numbers.append(own)
                slot_counts.append(len(slots))
                for _, _, kind, told in slots:
                    slot_words.extend(told)
                    slot_lengths.append(len(told))
                    slot_kinds.append(kind)
            features, lengths, words, record = _passages(numbers)
            # a record's lines, then its slots
            count = np.bincount(record, minlength=len(rows))
            slots = np.array(slot_counts, np.int64)
            ints = lambda a: np.frombuffer(a, np.int32).astype(np.int64) if a else np.zeros(0, np.int64)
            slot_of, slot_size = np.repeat(np.arange(len(rows)), slots), ints(slot_lengths)
            order = np.argsort(np.r_[2 * record, 2 * slot_of + 1], kind="stable")
            spans = np.r_[lengths, slot_size]
            starts = np.r_[0, np.cumsum(spans)[:-1]] if len(spans) else spans
            flat = np.concatenate([features, ints(slot_words)])
            moved = np.repeat(starts[order] - np.r_[0, np.cumsum(spans[order])[:-1]], spans[order]) + np.arange(spans.sum()) if len(spans) else spans
            total = np.bincount(np.r_[record, slot_of], spans, len(rows)).astype(np.int64)
            lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int32())), batch.column(2).take(pa.array(rows, pa.int32())), pa.array(labels, pa.int32()), lists(flat[moved], total), lists(spans[order], count + slots),
                    lists(np.r_[words, np.zeros(len(slot_of), np.int64)][order], count + slots), lists(np.r_[np.full(len(record), LINE), ints(slot_kinds)][order], count + slots),
                ],
                ["key", *(c.split()[0] for c in RECORD_SCHEMA.split(", "))],
            )

    return run


class _Batch:
    """The passages of a batch of records."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.pick, self.label, words, lengths, sizes, kinds = (batch.column(batch.schema.get_field_index(c.split()[0])) for c in RECORD_SCHEMA.split(", "))
        self.pick, self.label = self.pick.to_numpy(), self.label.to_numpy()
        self.words = words.flatten().to_numpy()
        self.span = lengths.flatten().to_numpy().astype(np.int64)
        self.ends = np.r_[0, np.cumsum(self.span)]
        self.size = sizes.flatten().to_numpy().astype(np.int64)
        self.kind = kinds.flatten().to_numpy()
        self.slot = self.kind > LINE
        self.n = len(self.label)
        self.record = np.repeat(np.arange(self.n), np.diff(lengths.offsets.to_numpy()))

        self.at = self.words + np.repeat(np.where(self.slot, BUCKETS, 0), self.span)  # in tables (line or slot, bucket)

    def sums(self, by_kind: np.ndarray) -> np.ndarray:
        """For each passage the sum of its features' values in a table (line or slot, bucket)."""
        total = np.zeros(len(self.at) + 1)
        np.cumsum(by_kind.ravel()[self.at], out=total[1:])
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def counts(self, share: np.ndarray | None = None) -> np.ndarray:
        """How often each feature occurs, a table; ``share`` weighs passages."""
        return np.bincount(self.at, None if share is None else np.repeat(share, self.span), 2 * BUCKETS).reshape(2, BUCKETS)

    def decided(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each record: is one of its slots unfilled; are its lines residue but for a small part?"""
        per = lambda w: np.bincount(self.record, w, self.n)
        positive = score > 0
        found = per(positive & ~self.slot) > 0
        return per(positive & self.slot) > 0, found & (per(np.where(positive, 0, self.size)) <= CONTENT * per(self.size))


# -- the model


class Model:
    """Log odds of residue by bucket, and a prior, for lines and slots apart; and the log probabilities of the rest."""

    def __init__(self, weights: np.ndarray, rest: np.ndarray, prior: np.ndarray) -> None:
        self.weights, self.rest, self.prior = weights, rest, prior
        self.likelihood: list[float] = []  # held out, a passage, by round

    @staticmethod
    def of(counts: np.ndarray, passages: np.ndarray) -> Model:
        """From expected counts (line or slot, residue or rest, bucket) and numbers of passages."""
        common = counts.sum(axis=1) + 2.0  # what is in neither class speaks for neither
        common /= common.sum(axis=1, keepdims=True)
        size = counts.sum(axis=2)
        p, q = ((counts[:, c] + PRIOR * np.maximum(size[:, c, None], 1) * common) / (np.maximum(size[:, c, None], 1) * (1 + PRIOR)) for c in (0, 1))
        return Model(np.where(size[:, 0, None] > 0, np.log(p / q), 0).astype(np.float32), np.log(q).astype(np.float32), np.log((passages[:, 0] + 1) / (passages[:, 1] + 1)))

    def score(self, b: _Batch) -> np.ndarray:
        """Log odds of each passage."""
        return b.sums(self.weights) + self.prior[b.slot.astype(np.int64)]


def _expected(model: Model | None, sampled: float):
    """Expected counts: rows (kind, bucket or BUCKETS for passages, residue, rest), and (2, 0, log likelihood, passages) of those held out; one set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BUCKETS + 1))
        likelihood = np.zeros(2)
        for batch in batches:
            b = _Batch(batch)
            label = np.where(b.pick < sampled, b.label, 0)
            held = (label == 0) & (b.pick >= 1 - HELD_OUT)
            certain = np.where(b.slot, (label == 2)[b.record] & (b.kind == LISTED), (label == 1)[b.record])
            residue = certain.astype(float)
            if model is not None:
                score = model.score(b)
                _, lines = b.decided(score)
                likely = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
                likely = np.where(b.slot, np.where(b.kind == SPOKEN, 0.0, likely), np.where(lines[b.record], likely, 0.0))
                residue = np.where(certain, 1.0, likely)
                out = held[b.record]
                own = b.sums(model.rest) - np.log1p(np.exp(model.prior))[b.slot.astype(np.int64)] + np.logaddexp(0, score)
                likelihood += own[out].sum(), out.sum()
            learnt = np.where(held[b.record], 0.0, 1.0)
            residue *= learnt
            every, mine = b.counts(learnt), b.counts(residue)
            total[:, 0, :BUCKETS] += mine
            total[:, 1, :BUCKETS] += every - mine
            for kind in (0, 1):
                own = b.slot == bool(kind)
                total[kind, :, BUCKETS] += residue[own].sum(), (learnt - residue)[own].sum()
        np.maximum(total, 0, out=total)
        kind, at = np.nonzero(total.sum(axis=1))
        columns = [np.r_[kind, 2], np.r_[at, 0], np.r_[total[kind, 0, at], likelihood[0]], np.r_[total[kind, 1, at], likelihood[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["kind", "at", "residue", "rest"])

    return run


def _decided(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch)
            slots, lines = b.decided(model.score(b))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(slots | lines, pa.bool_()))], ["key"])

    return run


def records(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The numbered records of a corpus, checkpointed."""
    kind = documents.schema[key].dataType
    pick = (F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    rows = spread(documents.select(key, text, pick.alias("_pick")).where(F.col(text).isNotNull()))
    return checkpointed(rows.mapInArrow(_records(to_arrow_type(kind)), f"key {kind.simpleString()}, {RECORD_SCHEMA}"))


def learned(numbered_records: DataFrame, rounds: int = ROUNDS, gain: float = GAIN, most: int = TRUSTED) -> Model:
    """The model of a corpus' records, which at most ``most`` trusted ones label. What reaches the driver are expected counts, at most 2 * BUCKETS rows."""
    trusted_records = numbered_records.where("label > 0").count()
    sampled = min(1.0, most / max(trusted_records, 1))
    model: Model | None = None
    trace: list[float] = []
    for _ in range(rounds + 1):
        counts = numbered_records.mapInArrow(_expected(model, sampled), "kind int, at int, residue double, rest double").groupBy("kind", "at").agg(F.sum("residue").alias("residue"), F.sum("rest").alias("rest")).toPandas()
        told = counts[counts["kind"] == 2]
        counts = counts[counts["kind"] < 2]
        if model is not None:
            trace.append(float(told["residue"].sum() / max(told["rest"].sum(), 1)))
            model.likelihood = trace
            if len(trace) > 1 and trace[-1] - trace[-2] < gain:
                break
        table = np.zeros((2, 2, BUCKETS + 1))
        table[counts["kind"], 0, counts["at"]] = counts["residue"]
        table[counts["kind"], 1, counts["at"]] = counts["rest"]
        model = Model.of(table[:, :, :BUCKETS], table[:, :, BUCKETS])
        model.likelihood = trace
    return model


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``key`` of each record that is residue, once. Null, empty and blank texts are none.

    Without ``model`` one is learned from the same records; an empty table gives no row. Of rows
    that share a key it is enough that one is residue; other columns are ignored.
    """
    rows = records(documents, key, text)
    found = rows.mapInArrow(_decided(model or learned(rows)), f"key {documents.schema[key].dataType.simpleString()}")
    out = checkpointed(found.select(F.col("key").alias(key)).distinct())
    forget(rows)
    return out
