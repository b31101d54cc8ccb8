"""The whole evidence of all pairs, as ``assembly.pair_evidence`` has it, two blocks of submissions a task.

Lines on which the same grams begin are of one class, and classes meet instead of grams; a range of lines that
matches comes out once, in the order in which ranges merge. Methods, ranges, claims and growth are arrays over
all pairs of a task. A pair is looked at by itself only if blocks of it meet on a side.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codesim.operators import assembly as Y
from codesim.operators import blocks as B
from codesim.operators import disguise as D
from codesim.operators import evidence as E
from codesim.operators import passages as Z
from codesim.operators.pairs import LEVELS

LISTED, ROWS, OUT = 4_000_000, 600_000, 20_000  # of gram matches of classes and of ranges at once, of rows of a batch
BITS = 62  # functions of a submission whose claims are bits of a number
STRENGTHS = np.array(sorted(E.RANK, key=E.RANK.get), dtype=object)
SOURCES = np.array(["ast", *(f"kgram{k}" for k in Y.GRAMS), "identical"], dtype=object)

Blocks = dict[str, np.ndarray]  # a, b (rows of both sides, one after the other), a1, a2, b1, b2, tokens, rank, source, sim, fa, fb


class Places:
    """Lines on which grams of a side's submissions begin, by submission and line, and the class of each; ``grams`` of a class are one line's."""

    def __init__(self, s: D.Stream, t: pa.Table, k: int) -> None:
        self.h, r, lo, hi = Z.gram_lines(s, t, k)
        order = np.lexsort((lo, r))
        self.h, r, lo, self.span = self.h[order], r[order], lo[order], (hi - lo)[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (lo[1:] != lo[:-1])
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(r)))
        self.row, self.line = r[self.first].astype(np.int32), lo[self.first].astype(np.int32)
        self.ends = np.searchsorted(self.row, np.arange(len(t) + 1))
        each = D._mixed(self.h + D._mixed(self.span.astype(np.uint64)))
        self.told = np.add.reduceat(each, self.first) if len(r) else np.zeros(0, np.uint64)


def _grams(p: Places, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram, class and number of lines behind the first of the grams of a side's classes, by gram."""
    c, first = np.unique(cls, return_index=True)
    n = p.n[first]
    at = B._flat(p.first[first], n)
    order = np.argsort(p.h[at], kind="stable")
    return p.h[at][order], np.repeat(c, n)[order], p.span[at][order]


def _longest(v: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The greatest value of the n from each first place on."""
    out = v[first]
    some = np.flatnonzero(n > 1)
    if len(some):
        out[some] = np.maximum.reduceat(v[B._flat(first[some], n[some])], np.cumsum(n[some]) - n[some])
    return out


def _sorted(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order and what else there is of each, none of it under 0; as one number each, if they have room in it."""
    bits = [int(v.max(initial=0)).bit_length() for v in more]
    if int(key.max(initial=0)).bit_length() + sum(bits) > 62:
        order = np.argsort(key)
        return key[order], *(v[order] for v in more)
    for v, n in zip(more, bits, strict=True):
        key = key << n | v
    key.sort()
    out = []
    for n in reversed(bits):
        out.append(key & (1 << n) - 1)
        key = key >> n
    return key, *reversed(out)


def ranges(p: Places, q: Places, wanted: np.ndarray, behind: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row of p and of q, a1, a2, b1, b2 of the ranges that match, sorted so, the longest of those that begin alike; whole rows of p at a time.

    Only ``wanted`` pairs; of a row of p those rows of q that are not before ``behind``.
    """
    if not len(p.row) or not len(q.row):
        return
    known, cls = np.unique(np.concatenate([p.told, q.told]), return_inverse=True)
    cp, cq, wide, items = cls[: len(p.row)], cls[len(p.row) :], len(known), len(q.row)
    hp, gp, sp = _grams(p, cp)
    hq, gq, sq = _grams(q, cq)
    often = np.bincount(cq, minlength=wide)
    of_class = np.argsort(cq, kind="stable")
    ptr = np.cumsum(often) - often
    lo, hi = np.searchsorted(hq, hp, "left"), np.searchsorted(hq, hp, "right")
    total = np.concatenate([[0], np.cumsum(often[gq])])
    weight = np.maximum(np.bincount(gp, weights=hi - lo, minlength=wide), np.minimum(np.bincount(gp, weights=total[hi] - total[lo], minlength=wide), items) / 2)
    met = weight[cp] > 0  # lines without a gram of the other side begin no range
    keep = np.flatnonzero(met)
    prow, pline, cp = p.row[keep], p.line[keep], cp[keep]
    pends = np.searchsorted(prow, np.arange(len(p.ends)))
    begin = q.ends[behind]
    m = len(q.ends) - 1
    at, n = 0, len(p.ends) - 1
    while at < n:
        seen, size, stop = np.zeros(wide, bool), 0.0, at
        while stop < n:
            own = np.unique(cp[pends[stop] : pends[stop + 1]])
            own = own[~seen[own]]
            more = weight[own].sum()
            if stop > at and size + more > LISTED:
                break
            seen[own] = True
            size, stop = size + more, stop + 1
        # classes that share a gram, and how far their longest shared grams reach on both sides
        some = seen[gp] & (hi > lo)
        f, g = np.repeat(np.flatnonzero(some), (hi - lo)[some]), B._flat(lo[some], (hi - lo)[some])
        key, reach_p, reach_q = _sorted(gp[f] * wide + gq[g], sp[f], sq[g])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(first):
            size = np.diff(np.append(first, len(key)))
            far = [_longest(v, first, size).astype(np.int32) for v in (reach_p, reach_q)]
            c1, c2 = np.divmod(key[first], wide)
            # lines of q that each class of p meets
            t = np.repeat(np.arange(len(c1)), often[c2])
            item = of_class[B._flat(ptr[c2], often[c2])]
            key, t = _sorted(c1[t] * items + item, t)
            item = (key % items).astype(np.int32)
            far_p, far_q = far[0][t], far[1][t]
            x0, x1 = pends[at], pends[stop]
            base = cp[x0:x1] * items
            start = np.searchsorted(key, base + begin[prow[x0:x1]])
            length = np.searchsorted(key, base + items) - start
            steps = np.concatenate([[0], np.cumsum(length)])
            ends = steps[pends[at : stop + 1] - x0]
            row = 0
            while row < stop - at:
                last = max(row + 1, int(np.searchsorted(ends, ends[row] + ROWS, "right")) - 1)
                o = slice(pends[at + row] - x0, pends[at + last] - x0)
                src = np.repeat(np.arange(o.start, o.stop, dtype=np.int32), length[o])
                idx = B._flat(start[o], length[o])
                it = item[idx]
                r, s = prow[x0 + src], q.row[it]
                fits = wanted[r, s]
                if not fits.all():
                    src, idx, it, r, s = src[fits], idx[fits], it[fits], r[fits], s[fits]
                pair = (r - (at + row)) * np.int64(m) + s
                order = np.argsort(pair.astype(np.uint16) if (last - row) * m <= 1 << 16 else pair, kind="stable")
                src, idx, it = src[order], idx[order], it[order]
                a1, b1 = pline[x0 + src], q.line[it]
                row = last
                if len(a1):
                    yield r[order], s[order], a1, a1 + far_p[idx], b1, b1 + far_q[idx]
        at = stop


def folded(pair: np.ndarray, a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, ...]:
    """``passages.merged`` of ranges that are sorted by pair, a1 and b1 and begin alike nowhere.

    A range that fits the one before it joins that one's block, whatever else the block has: such runs are one range. Of
    the few that are left to join, blocks are tried from all of them at once; those that begin within another one are none.
    """
    if not len(pair):
        return pair, a1, a2, b1, b2

    def fits(i: np.ndarray | slice, j: np.ndarray | slice, ea: np.ndarray, fb: np.ndarray, eb: np.ndarray) -> np.ndarray:
        return (pair[i] == pair[j]) & (a1[j] - ea <= gap[j]) & (b1[j] - eb <= gap[j]) & (b1[j] >= fb)

    before, behind = slice(0, -1), slice(1, None)
    first = np.flatnonzero(np.concatenate([[True], ~fits(before, behind, a2[before], b1[before], b2[before])]))
    n = np.diff(np.append(first, len(pair)))
    a2, b2 = _longest(a2, first, n), _longest(b2, first, n)
    pair, a1, b1, gap = pair[first], a1[first], b1[first], gap[first]
    i = np.flatnonzero(fits(before, behind, a2[before], b1[before], b2[before]))
    tried: list[tuple] = []
    at, ea, eb = i + 1, a2[i], b2[i]
    while len(i):
        ea, eb = np.maximum(ea, a2[at]), np.maximum(eb, b2[at])
        at = at + 1
        goes = at < len(pair)
        goes[goes] = fits(i[goes], at[goes], ea[goes], b1[i[goes]], eb[goes])
        tried.append(tuple(v[~goes] for v in (i, at, ea, eb)))
        i, at, ea, eb = i[goes], at[goes], ea[goes], eb[goes]
    if not tried:
        return pair, a1, a2, b1, b2
    i, end, ea, eb = (np.concatenate(c) for c in zip(*tried, strict=True))
    order = np.argsort(i)
    i, end, ea, eb = i[order], end[order], ea[order], eb[order]
    real, last = [], 0
    for no, (x, y) in enumerate(zip(i.tolist(), end.tolist())):
        if x >= last:
            real.append(no)
            last = y
    i, end = i[real], end[real]
    a2[i], b2[i] = ea[real], eb[real]
    begins = np.ones(len(pair), bool)
    begins[B._flat(i + 1, end - i - 1)] = False
    return tuple(v[begins] for v in (pair, a1, a2, b1, b2))


def _gram_blocks(p: Places, q: Places, wanted: np.ndarray, gaps: np.ndarray, behind: np.ndarray, lines: Z.Lines, rows: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """a, b, a1, a2, b1, b2, tokens of the blocks of grams, by pair and place; a side's rows begin at ``rows``."""
    out = [(np.zeros(0, np.int64),) * 7]
    m, flat = wanted.shape[1], gaps.astype(np.int32).ravel()
    for r, s, a1, a2, b1, b2 in ranges(p, q, wanted, behind):
        pair = r * np.int64(m) + s
        pair, a1, a2, b1, b2 = folded(pair, a1, a2, b1, b2, flat[pair])
        long = (a2 - a1 >= E.LEAST_LINES - 1) & (b2 - b1 >= E.LEAST_LINES - 1)
        pair, a1, a2, b1, b2 = (v[long] for v in (pair, a1, a2, b1, b2))
        a, b = pair // m + rows[0], pair % m + rows[1]
        na, nb = lines.inside(a, a1, a2)[1], lines.inside(b, b1, b2)[1]
        long = np.minimum(na, nb) >= E.LEAST_LINES
        out.append(tuple(v[long] for v in (a, b, a1, a2, b1, b2, 8 * np.maximum(na, nb))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Functions:
    """The functions of all submissions of a task: place in it of their own, lines, name, order in their submission, and as bits which they are and meet."""

    def __init__(self, tables: list[pa.Table]) -> None:
        each = [np.frombuffer(zlib.decompress(v), np.int32).reshape(-1, 2) for t in tables for v in t["spots"].to_pylist()]
        self.n = np.array([len(v) for v in each], np.int64)
        self.start, self.end = np.concatenate([np.zeros((0, 2), np.int32), *each]).astype(np.int64).T
        self.of = np.repeat(np.arange(len(each)), self.n)
        self.names = np.array([x for t in tables for v in t["funcs"].to_pylist() for x in v], dtype=object)
        order = np.lexsort((np.unique(self.names, return_inverse=True)[1] if len(self.names) else self.start, self.end, self.start, self.of))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.long = (self.start > 0) & (self.end - self.start >= 3)
        self.bit, self.meets = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        at = 0
        for n in self.n.tolist():
            if 0 < n <= BITS:
                s, e, bits = self.start[at : at + n], self.end[at : at + n], np.int64(1) << np.arange(n)
                self.bit[at : at + n] = bits
                self.meets[at : at + n] = ((s[:, None] <= e) & (s <= e[:, None])) @ bits
            at += n


def _alike(x: dict[str, B.Entries], n: int, y: dict[str, B.Entries], m: int) -> np.ndarray:
    """``structure.level_similarity`` of each two functions."""
    total = np.zeros((n, m))
    for level, w in LEVELS.items():
        total += w * B._shares(B.inner(x[level], n, y[level], m), B._count(x[level], n), B._count(y[level], m), 0.0)
    return B._rounded(np.minimum(total, 1.0))


def _claims(pair: np.ndarray, fa: np.ndarray, fb: np.ndarray, sim: np.ndarray, f: Functions) -> np.ndarray:
    """Which of the similar functions, sorted by pair and claim, ``evidence.claim_methods`` leaves."""
    kept = np.zeros(len(pair), bool)
    if not len(pair):
        return kept
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n = np.diff(np.append(starts, len(pair)))
    many = (f.n[f.of[fa[starts]]] > BITS) | (f.n[f.of[fb[starts]]] > BITS)
    for s, c in zip(starts[many].tolist(), n[many].tolist()):
        found = [(sim[i], f.start[fa[i]], f.end[fa[i]], f.start[fb[i]], f.end[fb[i]], i) for i in range(s, s + c)]
        kept[[r[5] for r in E.claim_methods(found)]] = True
    starts, n = starts[~many], n[~many]
    by = np.argsort(-n, kind="stable")
    starts, n = starts[by], n[by]
    taken = np.zeros((2, len(starts)), np.int64)
    for t in range(int(n.max(initial=0))):
        m = int(np.searchsorted(-n, -t, "left"))
        at = starts[:m] + t
        free = (taken[0, :m] & f.meets[fa[at]] | taken[1, :m] & f.meets[fb[at]]) == 0
        kept[at] = free
        taken[0, :m] |= np.where(free, f.bit[fa[at]], 0)
        taken[1, :m] |= np.where(free, f.bit[fb[at]], 0)
    return kept


def _method_blocks(p: D.Side, q: D.Side, less: np.ndarray, wanted: np.ndarray, f: Functions, least: float) -> Blocks:
    """The blocks of methods, by pair and claim."""
    (nx, fx), (ny, fy) = p.functions(), q.functions()
    apart = 0 if p is q else len(nx)  # where q's submissions begin, and its functions
    behind = int(nx.sum()) if apart else 0
    total = len(nx) + len(ny) if apart else len(nx)
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    ends, of = np.concatenate([[0], np.cumsum(nx)]), [np.repeat(np.arange(len(n)), n) for n in (nx, ny)]
    many = int(ny.sum())
    row = 0
    while row < len(nx) and many:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + B.FUNCTIONS, "right")) - 1)
        lo, hi = int(ends[row]), int(ends[stop])
        row = stop
        if lo == hi:
            continue
        some = {level: (e[0][(w := (e[0] >= lo) & (e[0] < hi))] - lo, e[1][w], e[2][w]) for level, e in fx.items()}
        (kx, ex, u), (ky, ey, v) = B._kinds(some, hi - lo), B._kinds(fy, many)
        sim = _alike(ex, u, ey, v)
        near = (sim >= least)[kx][:, ky] & f.long[lo:hi, None] & f.long[behind : behind + many] & wanted[of[0][lo:hi]][:, of[1]]
        a, b = np.nonzero(near)
        score = sim[kx[a], ky[b]]
        turned = ~less[of[0][a + lo], of[1][b]]
        a, b = a + lo, b + behind
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        out.append((f.of[a] * total + f.of[b], a, b, score))
    pair, a, b, score = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((f.rank[b], f.rank[a], -score, pair))
    pair, a, b, score = pair[order], a[order], b[order], score[order]
    kept = _claims(pair, a, b, score, f)
    a, b, score = a[kept], b[kept], score[kept]
    rank = np.select([score >= 0.70, score >= 0.45], [2, 1], 0)
    return {"a": f.of[a], "b": f.of[b], "a1": f.start[a], "a2": f.end[a], "b1": f.start[b], "b2": f.end[b], "tokens": np.zeros(len(a), np.int64), "rank": rank, "source": np.zeros(len(a), np.int64), "sim": score, "fa": a, "fb": b}


def _of_grams(told: tuple[np.ndarray, ...], source: int) -> Blocks:
    a, b, a1, a2, b1, b2, tokens = told
    n = len(a)
    return {"a": a, "b": b, "a1": a1, "a2": a2, "b1": b1, "b2": b2, "tokens": tokens, "rank": np.select([tokens >= 40, tokens >= 15], [2, 1], 0), "source": np.full(n, source), "sim": np.full(n, np.nan), "fa": np.full(n, -1), "fb": np.full(n, -1)}


def _joined(*each: Blocks) -> Blocks:
    return {c: np.concatenate([e[c] for e in each]) for c in each[0]}


def _new(primary: Blocks, more: Blocks, n: int) -> np.ndarray:
    """Which of the blocks overlap none of the primary ones of their pair."""
    pair = primary["a"] * n + primary["b"]
    order = np.argsort(pair, kind="stable")
    own = more["a"] * n + more["b"]
    lo, hi = np.searchsorted(pair[order], own, "left"), np.searchsorted(pair[order], own, "right")
    of, at = np.repeat(np.arange(len(own)), hi - lo), order[B._flat(lo, hi - lo)]
    meets = np.ones(len(of), bool)
    for s in "ab":
        meets &= (more[f"{s}1"][of] <= primary[f"{s}2"][at]) & (primary[f"{s}1"][at] <= more[f"{s}2"][of])
    return np.bincount(of[meets], minlength=len(own)) == 0


def one_to_one(v: Blocks, n: int) -> Blocks:
    """``evidence.one_to_one`` of the blocks of each pair, by pair and a1. Blocks of a pair that meet on no side are as they are."""
    pair = v["a"] * n + v["b"]
    meet = np.zeros(len(pair), bool)
    for s in "ab":
        order = np.lexsort((v[f"{s}1"], pair))
        p, lo, hi = pair[order], v[f"{s}1"][order], v[f"{s}2"][order]
        meet[order[1:][(p[1:] == p[:-1]) & (lo[1:] <= hi[:-1])]] = True
    some = np.isin(pair, pair[meet])
    own = np.flatnonzero(some)
    own = own[np.argsort(pair[own], kind="stable")]
    kept, trimmed = ~some & (v["a2"] - v["a1"] >= 2) & (v["b2"] - v["b1"] >= 2), []
    if len(own):
        columns = [v[c][own].tolist() for c in ("a1", "a2", "b1", "b2", "rank")]
        cuts = [0, *(np.flatnonzero(np.diff(pair[own])) + 1).tolist(), len(own)]
        names = STRENGTHS.tolist()
        rows = own.tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            blocks = [{"a1": a1, "a2": a2, "b1": b1, "b2": b2, "strength": names[rank], "at": at} for a1, a2, b1, b2, rank, at in zip(*(c[lo:hi] for c in columns), rows[lo:hi])]
            trimmed += [(e["at"], e["a1"], e["a2"], e["b1"], e["b2"]) for e in E.one_to_one(blocks)]
    at, *ends = np.array(trimmed, np.int64).reshape(-1, 5).T
    whole = np.flatnonzero(kept)
    out = {c: x[np.concatenate([whole, at])] for c, x in v.items()}
    for c, x in zip(("a1", "a2", "b1", "b2"), ends, strict=True):
        out[c][len(whole) :] = x
    order = np.lexsort((out["a1"], out["a"] * n + out["b"]))
    return {c: x[order] for c, x in out.items()}


class Texts:
    """The canonical lines of all submissions of a task, by place in their concatenations."""

    def __init__(self, tables: list[pa.Table]) -> None:
        self.lines: list[list[str]] = []
        self.files: list[list[tuple[int, int, str]]] = []  # last and first line, name
        known: dict[str, int] = {"": 0}
        ids: list[int] = []
        starts = [0]
        for t in tables:
            for names, text in zip(t["files"].to_pylist(), t["text"].to_pylist(), strict=True):
                own, files = [], []
                for name, one in zip(names, zlib.decompress(text).decode().split("\0") if names else (), strict=True):
                    own += [""] * (1 if not own else 2)
                    first = len(own) + 1
                    own += one.split("\n")
                    files.append((len(own), first, name))
                self.files.append(files)
                ids += [known.setdefault(x.strip(), len(known)) for x in own]
                self.lines.append([x.rstrip() for x in own])
                starts.append(len(ids))
        self.ids, self.starts = np.array([*ids, 0], np.int64), np.array(starts, np.int64)

    def line(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for the stripped text of a line of each submission, 0 of a blank one."""
        i = self.starts[of] + at - 1
        return np.where(i < self.starts[of + 1], self.ids[np.minimum(i, len(self.ids) - 1)], 0)

    def told(self, of: int, lo: int, hi: int) -> tuple[str | None, str]:
        """File and text of lines lo to hi, runs of blank ones made one."""
        out: list[str] = []
        for x in self.lines[of][lo - 1 : hi]:
            if x or out and out[-1]:
                out.append(x)
        files = self.files[of]
        i = bisect_left(files, lo, key=lambda f: f[0])
        return files[i][2] if i < len(files) and files[i][1] <= hi else None, "\n".join(out).strip("\n")


def extend_up(v: Blocks, n: int, texts: Texts) -> None:
    """``evidence.extend_up`` of the blocks of all pairs, which are sorted by pair and a1."""
    pair = v["a"] * n + v["b"]
    floors = []
    for c in ("a2", "b2"):
        floor = np.ones(len(pair), np.int64)
        floor[1:] = np.where(pair[1:] == pair[:-1], np.maximum(v[c][:-1] + 1, 1), 1)
        floors.append(floor)
    at = np.arange(len(pair))
    while len(at):
        at = at[(v["a1"][at] > floors[0][at]) & (v["b1"][at] > floors[1][at])]
        x, y = texts.line(v["a"][at], v["a1"][at] - 1), texts.line(v["b"][at], v["b1"][at] - 1)
        at = at[(x == y) & (x > 0)]
        v["a1"][at] -= 1
        v["b1"][at] -= 1


def _batches(assignment: str, v: Blocks, names: np.ndarray, lines: Z.Lines, texts: Texts, f: Functions) -> Iterator[pa.RecordBatch]:
    """The blocks as rows of ``assembly.SCHEMA``."""
    for start in range(0, len(v["a"]), OUT):
        w = {c: x[start : start + OUT] for c, x in v.items()}
        sides = {}
        for s in "ab":
            places, at = np.unique(np.stack([w[s], w[f"{s}1"], w[f"{s}2"]], axis=1), axis=0, return_inverse=True)
            told = [texts.told(*row) for row in places.tolist()]
            sides[f"file_{s}"], sides[f"code_{s}"] = (pa.array([r[i] for r in told], pa.string()).take(pa.array(at.ravel())) for i in (0, 1))
            sides[f"method_{s}"] = pa.array(np.where(w[f"f{s}"] >= 0, f.names[w[f"f{s}"]], None) if len(f.names) else [None] * len(at), pa.string())
            sides[f"line_highlights_{s}"] = lines.lists(*lines.inside(w[s], w[f"{s}1"], w[f"{s}2"]))
            sides[s] = pa.array(names[w[s]], pa.string())
            sides |= {f"{s}{i}": pa.array(w[f"{s}{i}"], pa.int32()) for i in (1, 2)}
        sides |= {
            "assignment_id": pa.array([assignment] * len(w["a"]), pa.string()), "match_strength": pa.array(STRENGTHS[w["rank"]], pa.string()), "tokens_matched": pa.array(w["tokens"], pa.int32()),
            "evidence_source": pa.array(SOURCES[w["source"]], pa.string()), "ast_similarity": pa.array(w["sim"], pa.float64(), from_pandas=True),
        }
        yield pa.RecordBatch.from_arrays([sides[c] for c in Y._NAMES], Y._NAMES)


def of_parts(x: pa.Table, y: pa.Table, least: float = 0.25) -> Iterator[pa.RecordBatch]:
    """``assembly.SCHEMA`` of the pairs of two parts."""
    alone = x is y
    x = x.sort_by("rep")
    y = x if alone else y.sort_by("rep")
    reps = [np.array(s["rep"].to_pylist(), dtype=object) for s in (x, y)]
    less = (reps[0][:, None] < reps[1][None, :]).astype(bool)
    wanted = B._allowed(x, y) & (less if alone else True)
    if not wanted.any():
        return
    p, q, known = D.both_sides(x, y)
    score = Z.base_scores(D.signals(p, q, known, less))
    gaps = np.select([score >= s for s, _ in E.GAPS], [g for _, g in E.GAPS], 2)
    tables = [x] if alone else [x, y]
    lines, functions, names = Z.Lines(*tables), Functions(tables), np.concatenate(reps[: len(tables)])
    n, behind = len(names), 0 if alone else len(x)
    of = lines.n > 0
    same = wanted & (score >= E.IDENTICAL) & of[: len(x), None] & of[behind:][None, :]
    rest = wanted & ~same
    v = _method_blocks(p, q, less, rest, functions, least)
    for no, k in enumerate(Y.GRAMS, 1):
        gx = Places(p.norm, x, k)
        gy = gx if alone else Places(q.norm, y, k)
        each = [_gram_blocks(gx, gy, rest & less, gaps, less.shape[1] - less.sum(axis=1), lines, (0, behind))]
        if not alone:
            each.append(_gram_blocks(gy, gx, (rest & ~less).T, gaps.T, less.sum(axis=0), lines, (behind, 0)))
        more = _of_grams(tuple(np.concatenate(c) for c in zip(*each, strict=True)), no)
        new = _new(v, more, n)
        v = _joined(v, {c: w[new] for c, w in more.items()})
    v = one_to_one(v, n)
    texts = Texts(tables)
    extend_up(v, n, texts)
    i, j = np.nonzero(same)
    j = j + behind
    turned = ~less[np.nonzero(same)]
    a, b = np.where(turned, j, i), np.where(turned, i, j)
    first, last = lines.starts, lines.starts + lines.n - 1
    whole = _of_grams((a, b, lines.code[first[a]], lines.code[last[a]], lines.code[first[b]], lines.code[last[b]], 8 * lines.n[a]), len(SOURCES) - 1)
    whole["rank"][:] = E.RANK["high"]
    yield from _batches(x["assignment_id"][0].as_py(), _joined(v, whole), names, lines, texts, functions)


def all_evidence(sides: DataFrame, counted: DataFrame) -> DataFrame:
    """``assembly.SCHEMA``: the whole evidence of all pairs that count; ``sides`` as for ``passages.gram_evidence``, with WHOLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in B.halves(pa.Table.from_batches(list(batches)), size + size // 4):
            yield from of_parts(x, y)

    size = D.SIZE * B.BLOCK
    return B.tasks(B.blocked(sides, size=size, counted=counted), "assignment_id", "i", "j").groupBy("assignment_id", "i", "j").applyInArrow(run, Y.SCHEMA)
