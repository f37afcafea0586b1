"""Operator 12: personal data by patterns and a character-level BiLSTM-CRF.

Four pattern kinds are the base: email, ip, card and phone. The method adds spans that look like them (kinds ``like_email``
to ``like_phone``): a tagger is trained from labelled spans, by default those of the base, and finds what the patterns'
rules miss.

* Training reads all texts. Every window that holds a digit or an at-sign may serve; each task keeps, of each kind and of
  windows without a span, the ``per_kind`` ones of least content hash, and so does the whole: a bounded sample of distinct
  windows (documented parameter) on which the driver trains. Digits of a drawn window, and letters of its spans, are redrawn at random at
  times, so that shapes are learned and not values.
* A span must hold a digit or an at-sign, so windows of ``WINDOW`` characters (one begins at every ``BLOCK``-th character)
  are scored only where they hold one. Where two windows overlap, a character's scores are their mean, weighted by its
  distance from either's edge.
* The windows' blocks are decoded for every tag before and after them; a pass over the blocks of each stretch of covered
  text then picks the path that is best for the whole stretch, however long, and the blocks are followed between their
  now known tags. So spans across any number of windows come out whole, and no window's edge decides anything.
* A span of the path is added if its score lies ``MARGIN`` above that of no span there and it overlaps no base span.

Starts and ends are in code points, ends exclusive. Base matches are the leftmost ones that don't overlap, kind by kind;
none of the searches goes back over what it has read, so they are linear in the text.

Defined cases: null counts as empty (no spans); an empty table gives an empty one; texts of any length are read whole, in
memory that grows with the text (some 10 bytes a character where digits are everywhere); without labelled spans to learn from only base spans come;
spans that begin together are in order of kind; repeated rows are tagged each, and equal windows count once in training;
further columns are dropped but for those asked for, which come back in a struct where no name can clash.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .char_tagger import END, Tagger, classes
from .frames import as_row, cut
from .textops import chunked, utf8

KINDS = ("email", "ip", "card", "phone", "like_email", "like_ip", "like_card", "like_phone")
#: The base patterns. Repeats that can't match otherwise are possessive, and digits before a
#: start are looked for, which changes no match: a match ends where its last run of digits ends.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9]([\x20().0-9-]+)")
WINDOW, BLOCK = 128, 64
#: Log odds of a span that is added.
MARGIN = 3.0
#: Windows scored at once, and steps and windows a step of the training.
GROUP, STEPS, BATCH = 512, 240, 80


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("+"), 0
    while at >= 0:
        m = PHONE.match(text, at)
        end = m.start(1) + len(m[1].rstrip(" ().-")) if m else at
        if m and end - m.start(1) >= 2:  # one character at least between the first digit and the last
            if 9 <= sum(c.isdigit() for c in text[at:end]) <= 15:
                yield at, end
            done = end
        else:
            done = at + 1
        at = text.find("+", done)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order of start, then kind."""
    found = [(s, k, e) for k, f in enumerate((_emails, _ips, _cards, _phones)) for s, e in f(text)]
    return sorted(found)


_TRIGGER = np.zeros(256, bool)
_TRIGGER[0x30:0x3A] = _TRIGGER[0x40] = True


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _starts(codes: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold a digit or an at-sign, ascending."""
    at = np.unique(np.flatnonzero((codes < 128) & _TRIGGER[np.minimum(codes, 127)]) // BLOCK)
    return np.union1d(at, at[at > 0] - 1)


def _cut(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Classes of windows, END beyond the text."""
    at = numbers[:, None] * BLOCK + np.arange(WINDOW)
    return np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], END)


_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)


def _block_scores(model: Tagger, windows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Mean scores (n, BLOCK, tags) of blocks: ``which`` (n, 2) are a block's windows as first and as second half, -1 for none."""
    used, place = np.unique(which, return_inverse=True)
    place = place.reshape(which.shape)
    e = model.scores(windows[np.maximum(used, 0)])
    total, weight = np.zeros((len(which), BLOCK, model.tags), np.float32), np.zeros((len(which), BLOCK, 1), np.float32)
    for half in (0, 1):
        there = (which[:, half] >= 0).astype(np.float32)[:, None, None] * _WEIGHT[half * BLOCK : (half + 1) * BLOCK, None]
        total += e[place[:, half], half * BLOCK : (half + 1) * BLOCK] * there
        weight += there
    return total / weight


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of the spans of each text's best path whose score passes MARGIN."""
    windows, which, block, owner, codes = [], [], [], [], [_codes(t) for t in texts]
    count = 0
    for i, c in enumerate(codes):
        numbers = _starts(c)
        if not len(numbers):
            continue
        windows.append(_cut(classes(c), numbers))
        own = np.union1d(numbers, numbers + 1)
        own = own[own * BLOCK < len(c)]
        half = np.full((len(own), 2), -1)
        for j in (0, 1):
            at = np.searchsorted(numbers, own - j)
            fits = at < len(numbers)
            fits[fits] = numbers[at[fits]] == own[fits] - j
            half[fits, j] = count + at[fits]
        which.append(half)
        block.append(own)
        owner.append(np.full(len(own), i))
        count += len(numbers)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not count:
        return out
    windows, which, block, owner = np.concatenate(windows), np.concatenate(which), np.concatenate(block), np.concatenate(owner)
    n = len(block)
    cache: dict[int, np.ndarray] = {}

    def scores(lo: int) -> np.ndarray:
        if lo not in cache:
            cache.clear()
            cache[lo] = _block_scores(model, windows, which[lo : lo + GROUP])
        return cache[lo]

    transfer = np.concatenate([model.blocks(scores(lo)) for lo in range(0, n, GROUP)])
    # stretches of neighbouring blocks, walked together: block number s of all of them at a time
    begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1] + 1)])
    length = np.diff(np.r_[begin, n])
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # stretches with more than s blocks
    best, came = np.full((len(begin), model.tags), -np.inf, np.float32), np.zeros((n, model.tags), np.int8)
    best[:, 0] = 0.0
    for s in range(length[0]):
        m = live[s]
        at = begin[:m] + s
        reach = best[:m, :, None] + transfer[at]
        came[at] = reach.argmax(axis=1)
        best[:m] = reach.max(axis=1)
    before, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tag = best.argmax(axis=1)
    for s in range(length[0] - 1, -1, -1):
        m = live[s]
        at = begin[:m] + s
        last[at] = tag[:m]
        tag[:m] = before[at] = came[at, tag[:m]]
    path, gain, move = np.empty((n, BLOCK), np.int64), np.empty((n, BLOCK), np.float32), model.move
    for lo in reversed(range(0, n, GROUP)):
        e = scores(lo)
        hi = lo + len(e)
        path[lo:hi] = tags = model.path(e, before[lo:hi], last[lo:hi])
        prior = np.c_[before[lo:hi], tags[:, :-1]]
        gain[lo:hi] = np.take_along_axis(e, tags[..., None], 2)[..., 0] + move[prior, tags] - e[..., 0] - move[0, 0]
    tags, gain = path.ravel(), gain.ravel().astype(np.float64)
    head = np.flatnonzero(tags % 2 == 1)
    if not len(head):
        return out
    after = (tags == 0) | (tags % 2 == 1)
    stops = np.flatnonzero(after)
    end = np.r_[stops, len(tags)][np.searchsorted(stops, head, "right")]
    begins = np.zeros(n, bool)
    begins[begin] = True
    edges = np.r_[np.flatnonzero(begins) * BLOCK, len(tags)]
    end = np.minimum(end, edges[np.searchsorted(edges, head, "right")])  # spans end with their stretch
    score = np.r_[0.0, np.cumsum(gain)]
    for h, e, s in zip(head.tolist(), end.tolist(), (score[end] - score[head]).tolist(), strict=True):
        i, start = owner[h // BLOCK], int(block[h // BLOCK]) * BLOCK + h % BLOCK
        stop = min(start + e - h, len(codes[i]))
        inside = codes[i][start:stop]
        if s >= MARGIN and len(inside) and _TRIGGER[inside[inside < 128]].any():
            out[i].append((start, int(tags[h]) // 2, stop, s))
    return out


def _labels(spans: list[tuple[int, int, int]], reach: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, set[int]] | None:
    """Tags of a window and the kinds of its spans; nothing if an edge cuts a span. ``reach``: how far the spans up to each one reach."""
    tags, kinds = np.zeros(WINDOW, np.int64), set()
    near = spans[int(np.searchsorted(reach, lo, "right")) : bisect.bisect_left(spans, (hi,))]
    for s, k, e in sorted(near, key=lambda x: (x[1], x[0])):
        if e > lo:
            if s < lo or e > hi:
                return None
            if not tags[s - lo : e - lo].any():
                tags[s - lo : e - lo] = 2 + 2 * k
                tags[s - lo] = 1 + 2 * k
                kinds.add(k)
    return tags, kinds


def _with_triggers(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, list[int], list[str]]]:
    """Runs of rows: the range, and number and text of those that hold a digit or an at-sign."""
    data, offsets = utf8(column)
    for lo, hi in chunked(offsets, most):
        some = np.diff(np.r_[0, np.cumsum(_TRIGGER[data[offsets[lo] : offsets[hi]]])][offsets[lo : hi + 1] - offsets[lo]]) > 0
        rows = (np.flatnonzero(some) + lo).tolist()
        yield lo, hi, rows, [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass") for i in rows]


def windows(docs: DataFrame, per_kind: int, text: str = "text", labelled: str | None = None) -> DataFrame:
    """kind (4 for none), draw, ids and tags of training windows, at most ``per_kind`` of a kind from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[int, tuple[bytes, bytes]]] = [{} for _ in range(5)]
        limit = [1 << 64] * 5
        for batch in batches:
            given = batch.column(1) if labelled else None
            for _, _, rows, texts in _with_triggers(batch.column(0)):
                for i, t in zip(rows, texts, strict=True):
                    spans = base(t) if given is None else sorted((s["start"], s["kind"], s["end"]) for s in given[i].as_py() or () if s)
                    reach = np.maximum.accumulate([e for _, _, e in spans]) if spans else np.zeros(0)
                    codes = _codes(t)
                    numbers = _starts(codes)
                    for number, ids in zip(numbers.tolist(), _cut(classes(codes), numbers) if len(numbers) else (), strict=True):
                        lo = number * BLOCK
                        raw = ids.astype(np.uint8).tobytes()
                        draw = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")
                        if draw >= max(limit) or (got := _labels(spans, reach, lo, lo + WINDOW)) is None:
                            continue
                        for kind in got[1] or {4}:
                            if draw < limit[kind]:
                                kept[kind][draw] = (raw, got[0].astype(np.uint8).tobytes())
                                if len(kept[kind]) > 4 * per_kind:
                                    least = heapq.nsmallest(per_kind, kept[kind])
                                    kept[kind], limit[kind] = {d: kept[kind][d] for d in least}, least[-1]
        rows = [(k, d - (1 << 63), *kept[k][d]) for k in range(5) for d in heapq.nsmallest(per_kind, kept[k])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "draw", "ids", "tags"])

    rows = docs.select(F.col(text).alias("text"), *([F.col(labelled).alias("spans")] if labelled else []))
    return rows.mapInArrow(run, "kind int, draw long, ids binary, tags binary")


def fit(docs: DataFrame, per_kind: int = 300, hidden: int = 16, steps: int = STEPS, text: str = "text", labelled: str | None = None, seed: int = 0) -> Tagger | None:
    """Trained from at most ``per_kind`` distinct windows of each kind and of none; None if no window holds a span.

    ``labelled`` names a column of arrays of (start, kind, end) that are learned instead of the base spans.
    """
    sample = cut(windows(docs, per_kind, text, labelled).dropDuplicates(["kind", "draw"]))
    groups = [sample.where(F.col("kind") == k).orderBy("draw").limit(per_kind).select("ids", "tags").collect() for k in range(5)]  # per_kind rows at most
    groups = [(np.array([np.frombuffer(r.ids, np.uint8) for r in g]), np.array([np.frombuffer(r.tags, np.uint8) for r in g]).astype(np.int64)) for g in groups if g]
    if not any(tags.any() for _, tags in groups):
        return None
    rng = np.random.default_rng(seed)

    def draw(_: int) -> tuple[np.ndarray, np.ndarray]:
        ids, tags = (np.concatenate(x) for x in zip(*((i[at], t[at]) for i, t in groups for at in [rng.integers(0, len(i), -(-BATCH // len(groups)))]), strict=True))
        other = rng.random(ids.shape)
        digits, upper, lower = (ids >= 48) & (ids < 58), (ids >= 65) & (ids < 91), (ids >= 97) & (ids < 123)
        fresh = np.where(digits, 48 + other * 10, np.where(upper, 65 + other * 26, 97 + other * 26)).astype(ids.dtype)
        anew = digits & (rng.random((len(ids), 1)) < 0.5) | (upper | lower) & (tags > 0) & (rng.random((len(ids), 1)) < 0.3)
        return np.where(anew, fresh, ids), tags

    model = Tagger(4, hidden, seed)
    model.train(draw, steps)
    return model


FOUND = "array<struct<start:int,kind:int,end:int,score:double>>"


def _listed(found: list[list[tuple[int, int, int, float]]]) -> pa.Array:
    flat = [x for f in found for x in f]
    fields = [pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
    offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "kind", "end", "score"]))


def find(docs: DataFrame, model: Tagger | None = None, train: Column | None = None, per_kind: int = 300, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, found (array of start, kind, end, score, in order of start then kind; base spans score null) and, of the columns in ``keep``, a struct ``row``.

    Without a model one is trained on the rows that ``train`` marks, by default all.
    """
    model = model or fit(docs if train is None else docs.where(train), per_kind, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, rows, texts in _with_triggers(batch.column("text")):
                found: list[list[tuple]] = [[] for _ in range(hi - lo)]
                more = tagged(m, texts) if m else [[]] * len(texts)
                for i, t, extra in zip(rows, texts, more, strict=True):
                    own = base(t)
                    taken = np.array([(s, e) for s, _, e in own]).reshape(-1, 2)
                    far = np.maximum.accumulate(np.r_[0, taken[:, 1]])  # how far the base spans up to each one reach
                    added = [(s, 4 + k, e, score) for s, k, e, score in extra if far[np.searchsorted(taken[:, 0], e, "left")] <= s]
                    found[i - lo] = sorted([(*x, None) for x in own] + added, key=lambda x: x[:2])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), _listed(found)], [*names, "found"])

    rows = docs.select(F.col(key).alias("key"), *[docs[f"`{c}`"].alias(f"kept_{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    names = [c for c in rows.columns if c != "text"]
    schema = rows.drop("text").withColumn("found", F.lit(None).cast(FOUND)).schema
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), *as_row(keep), "found")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = lambda f: F.expr(f"array_join(transform({f}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")
    count = lambda k: F.expr(f"cast(size(filter(found, x -> x.kind = {k})) AS long)")
    return found.select(key, *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(listed("filter(found, x -> x.kind < 4)"), 256).alias("base_sha256"), listed("found").alias("spans"))
