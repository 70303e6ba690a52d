"""Suffix-array dedup: remove every byte of a string of `length` units that starts anywhere else too.

Units are UTF-8 bytes or, for passages, words. Sorting every suffix of a corpus would move many times its
size. Of each string of `length` units, one suffix therefore stands for it: the one whose q-gram is least
among those inside the string, which equal strings choose alike. Only these leave the document, each with
the run of neighbouring strings that it stands for. They are sorted by bucket-pointer refinement:

1. Suffixes enter the buckets of their q-grams. Those alone in one are done: their strings occur once.
2. Runs whose bytes are equal as a whole settle together, and one of each goes on, if its bucket still
   holds others; the suffixes at every STRIDE-th offset of a run then enter q-gram buckets of their own.
3. Rounds of refinement. A suffix's bucket for 2d units comes from its bucket for d units and that of the
   suffix d units later, by grouping on the pair. The new bucket identifier is a pointer to the bucket's
   first member, and the next round reads it again, for its own offset and for earlier ones. Suffixes that
   are alone in their bucket leave, and with them all longer buckets that would need them.
4. The last pointers cover all that STRIDE neighbouring strings share. Where they meet, strings are told
   apart by the few units that are left on both sides: all STRIDE strings together, then fewer, then one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, hot_join, materialize, sliced

#: Bytes of a string, and of the q-gram by which suffixes are chosen and put into their first buckets.
LENGTH, Q = 400, 64
#: The same in words: passages of over 50 words repeat if 51 words do.
WORDS, WORD_Q = 51, 8
#: Units that are worked on at once; positions inside fit 20 bits.
SPAN = 1 << 17

_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_A_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))


def _join(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers of suffixes from those of their first bytes and those at a later offset."""
    out = first * _A
    out += later
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def byte_units(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "u1")


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    raw = np.frombuffer(data, "u1")
    blank = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    at = np.flatnonzero(blank[1:] != blank[:-1])
    return at[::2], at[1::2]


def word_units(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space: sums of byte values times powers, from the word's own begin."""
    first, end = word_edges(data)
    if not len(first):
        return np.empty(0, "<u8")
    power = np.full(len(data) + 1, _A)
    power[0] = 1
    back = np.full(len(data) + 1, _A_INVERSE)
    back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    upto = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTE[np.frombuffer(data, "u1")] * power[:-1], out=upto[1:])
    return _join((upto[end] - upto[first]) * back[first], (end - first).astype("u8"))


@dataclass(frozen=True)
class Strings:
    """Which strings are looked for: `length` units each, found by q-grams; width: bytes of one unit."""

    unit: str
    length: int
    q: int

    @property
    def width(self) -> int:
        return {"byte": 1, "word": 8}[self.unit]

    @property
    def stride(self) -> int:
        """Neighbouring strings that are refined together."""
        return self.q

    @property
    def fine(self) -> int:
        """Neighbouring strings that are told apart together once their shared part is known to repeat."""
        return max(self.q // 8, 1)

    def units(self, data: bytes) -> np.ndarray:
        return {"byte": byte_units, "word": word_units}[self.unit](data)


class Buckets:
    """Bucket identifiers of all suffixes of some units, for lengths 1, 2, 4, ... as far as asked for."""

    def __init__(self, data: np.ndarray, upto: int):
        self.level = {1: _BYTE[data] if data.dtype == np.uint8 else data}
        q = 1
        while 2 * q <= upto and len(data) >= 2 * q:
            last = self.level[q]
            self.level[2 * q] = _join(last[: len(last) - q], last[q:])
            q *= 2

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Identifiers of the strings of `size` units at `start`: two overlapping powers of two cover a size."""
        size = np.broadcast_to(np.asarray(size), start.shape)
        out = np.empty(len(start), "u8")
        top = 1 << (np.frexp(size.astype("f8"))[1] - 1)
        for q in np.unique(top):
            on = top == q
            level = self.level[int(q)]
            out[on] = _join(level[start[on]], level[start[on] + size[on] - q])
        return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    q, out = 1, keys
    while 2 * q <= width:
        out = np.minimum(out[: len(out) - q], out[q:])
        q *= 2
    rest = width - q
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def chosen_suffixes(data: np.ndarray, starts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """For the strings of `length` units at starts (ascending) of data: runs that one suffix stands for.

    Returns the suffix, the first and the last string of each run, the suffix's q-gram bucket and the
    bucket of the whole run's units, their number and the suffix's place in them.
    """
    buckets = Buckets(data, 2 * length)
    grams = buckets.level[q]
    keys = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype="u8")
    suffix = (_least(keys, length - q + 1) & np.uint64((1 << 20) - 1)).astype("i8")[starts]
    new = np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    low, high = starts[at], starts[np.concatenate([at[1:], [len(starts)]]) - 1]
    size = high - low + length
    # two blocks of one power of two cover runs of several sizes alike, so the size belongs to the bucket
    place = (size.astype("u8") << np.uint64(20)) + (suffix[at] - low).astype("u8")
    return suffix[at], low, high, grams[suffix[at]], _join(buckets.at(low, size), place)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view("i8"))


def _suffixes(rows: DataFrame, kinds: list[Strings]) -> DataFrame:
    """row_key, bytes, kind, suffix, low, high, gram, whole: the chosen suffixes of all documents, for strings of each kind."""
    names = ["row_key", "bytes", "kind", "suffix", "low", "high", "gram", "whole"]

    def emit(kind: int, held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        length = kinds[kind].length
        data = np.concatenate([h[3] for h in held])
        sizes = np.array([len(h[3]) for h in held])
        base = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(base, sizes, strict=True)])
        suffix, low, high, gram, whole = chosen_suffixes(data, starts, length, kinds[kind].q)
        gram = _join(gram, np.uint64(kind))  # each kind has buckets of its own
        doc = np.searchsorted(base, low, side="right") - 1
        shift = np.array([h[2] for h in held])[doc] - base[doc]
        columns = [pa.array(np.array([h[i] for h in held])[doc]) for i in (0, 1)] + [pa.array(np.full(len(doc), kind, "i4"))]
        columns += [pa.array(x + shift) for x in (suffix, low, high)] + [_signed(gram), _signed(whole)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [[] for _ in kinds], [SPAN for _ in kinds]
        for batch in sliced(batches):
            for key, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for i, kind in enumerate(kinds):
                    if size < kind.length:
                        continue
                    data = kind.units(raw)
                    for begin in range(0, len(data) - kind.length + 1, SPAN):  # a very long text goes in spans that share length - 1 units
                        part = data[begin : begin + SPAN + kind.length - 1]
                        if held[i] and len(part) > room[i]:
                            yield emit(i, held[i])
                            held[i], room[i] = [], SPAN
                        held[i].append((key, size, begin, part))
                        room[i] -= len(part)
        for i, rest in enumerate(held):
            if rest:
                yield emit(i, rest)

    return rows.select("row_key", "bytes", "text").mapInArrow(run, "row_key long, bytes long, kind int, suffix long, low long, high long, gram long, whole long")


def _contexts(texts: DataFrame, kinds: list[Strings]) -> DataFrame:
    """One row per run that is refined further, with its units as data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "suffix", "low", "high", "gram", "open"]
        for batch in sliced(batches, 64):
            for row in batch.to_pylist():
                raw, found = row["text"].encode(), row["suffixes"]
                data = {i: kinds[i].units(raw).tobytes() for i in {r["kind"] for r in found}}
                part = [data[r["kind"]][r["low"] * (k := kinds[r["kind"]]).width : (r["high"] + k.length) * k.width] for r in found]
                keys = [pa.array([row[n]] * len(found), pa.int64()) for n in ("row_key", "bytes")]
                columns = [pa.array([r[n] for r in found], pa.int32() if n == "kind" else None) for n in names]
                yield pa.RecordBatch.from_arrays([*keys, *columns, pa.array(part, pa.binary())], names=["row_key", "bytes", *names, "data"])

    return texts.mapInArrow(run, "row_key long, bytes long, kind int, suffix long, low long, high long, gram long, open boolean, data binary")


def _pointers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """at: for every ctx, its offsets j and the pointers of their buckets. Rows (ctx, j, keys) alone in their bucket leave."""
    buckets = materialize(rows.groupBy("j", *keys).agg(F.min("ctx").alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-buckets")
    met = hot_join(rows, buckets, ["j", *keys], rows.count())
    held = materialize(met.groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("j", "p"))).alias("at")), "suffix-pointers")
    discard(buckets)
    return held


def _later(held: DataFrame, step: int) -> DataFrame:
    """ctx, j, a, b: the pointer of offset j and that of the offset `step` later, where both are there."""
    first = F.filter(F.map_keys("at"), lambda j: F.map_contains_key(F.col("at"), j + step))
    pairs = F.transform(first, lambda j: F.struct(j.alias("j"), F.element_at("at", j).alias("a"), F.element_at("at", j + step).alias("b")))
    return held.select("ctx", F.explode(pairs).alias("x")).select("ctx", "x.*")


def _refined(contexts: DataFrame, kinds: list[Strings]) -> DataFrame:
    """row_key, bytes, kind, low, high: strings of open contexts that another context has too.

    Offsets j count strides from the chosen suffix, so that strings of all kinds take the same rounds.
    """
    n = F.count(F.lit(1))

    def of_kind(value: Callable[[Strings], int]) -> Column:
        return F.element_at(F.array(*[F.lit(value(k)) for k in kinds]), F.col("kind") + 1)

    length, q, width, stride = (of_kind(f) for f in (lambda k: k.length, lambda k: k.q, lambda k: k.width, lambda k: k.stride))
    at = F.col("j") * stride
    shared = [(k.length - k.stride + 1) // k.stride for k in kinds]  # strides that neighbouring strings share

    def piece(begin: Column, end: Column) -> Column:
        """Units from begin to end, offsets from the chosen suffix."""
        here = F.col("suffix") - F.col("low")
        return F.substring(F.col("data"), ((begin + here) * width + 1).cast("int"), ((end - begin) * width).cast("int"))

    first = F.ceil((F.col("low") - F.col("suffix")) / stride)
    last = F.floor((F.col("high") - F.col("suffix") + length - q) / stride)
    grams = contexts.withColumn("j", F.explode(F.sequence(first, last))).select("ctx", "j", "gram", F.xxhash64(piece(at, at + q)).alias("own"))
    grams = materialize(grams, "suffix-grams")
    held, depth = _pointers(grams, ["gram", "own"]), min(k.q // k.stride for k in kinds)
    discard(grams)
    while 2 * depth <= min(shared):
        pairs = materialize(_later(held, depth), "suffix-pairs")
        held, last_held, depth = _pointers(pairs, ["a", "b"]), held, 2 * depth
        discard(pairs, last_held)
    # two overlapping buckets reach as far as STRIDE neighbouring strings share, or up to a stride less
    more = min(shared) - depth
    core = (depth + more) * stride
    cells = materialize(_later(held, more), "suffix-cells")
    discard(held)
    # an odd ctx is an open one
    cores = cells.groupBy("j", "a", "b").agg(F.min("ctx").alias("p"), n.alias("n"), F.max(F.pmod("ctx", F.lit(2))).alias("any_open")).where("n > 1 and any_open = 1")
    cores = materialize(cores.drop("any_open"), "suffix-cores")
    met = hot_join(cells, cores, ["j", "a", "b"], cells.count())
    met = met.groupBy("ctx").agg(F.collect_list(F.struct("j", "p")).alias("cells"))
    met = contexts.join(met, "ctx").withColumn("cell", F.explode("cells")).select("*", "cell.*")
    far, near = F.greatest(at - (stride - 1), F.col("low") - F.col("suffix")), F.least(at, F.col("high") - F.col("suffix"))
    met = met.withColumn("far", far).withColumn("near", near).where("far <= near")
    met = met.select("row_key", "bytes", "kind", "suffix", "open", "j", "p", "far", "near", piece(F.col("far"), at).alias("before"), piece(at + core, F.col("near") + length).alias("after"))
    judged = _equal(materialize(met, "suffix-judged"), ["j", "p", "far", "near", "before", "after"])
    discard(cells, cores)

    def around(begin: Column, end: Column) -> tuple[Column, Column]:
        """Units from begin to the core, and from the core to end."""
        return (
            F.substring("before", ((begin - F.col("far")) * width + 1).cast("int"), ((at - begin) * width).cast("int")),
            F.substring("after", F.lit(1), ((end - at - core) * width).cast("int")),
        )

    # finer cells, known by all that their strings share; those that share it with no other leave
    fine = of_kind(lambda k: k.fine)
    parts = _with_open(judged, ["j", "p"]).withColumn("c", F.explode(F.sequence(F.floor((at - F.col("near")) / fine), F.floor((at - F.col("far")) / fine))))
    last, first = at - F.col("c") * fine, at - F.col("c") * fine - fine + 1
    sides = around(last, first + length)
    parts = parts.withColumns({"head": sides[0], "tail": sides[1], "from": F.greatest(first, "far"), "to": F.least(last, "near")})
    parts = materialize(parts, "suffix-parts")
    key = ["j", "p", "c", "head", "tail"]
    met = materialize(_with_open(parts, key), "suffix-parts-shared")
    sides = around(F.col("from"), F.col("to") + length)
    met = met.drop("head", "tail").withColumns({"head": sides[0], "tail": sides[1]})
    fine_judged = _equal(materialize(met, "suffix-fine"), ["j", "p", "from", "to", "head", "tail"])
    # strings one by one
    strings = _with_open(fine_judged, ["j", "p", "c"]).withColumn("r", F.explode(F.sequence("from", "to")))
    sides = around(F.col("r"), F.col("r") + length)
    strings = materialize(strings.select("row_key", "bytes", "kind", "suffix", "open", "p", "j", "r", sides[0].alias("head"), sides[1].alias("tail")), "suffix-strings")
    single = _equal(strings, ["p", "j", "r", "head", "tail"]).withColumns({"from": F.col("r"), "to": F.col("r")})

    def starts(found: DataFrame, begin: str, end: str) -> DataFrame:
        return found.where("equal and open").select("row_key", "bytes", "kind", (F.col("suffix") + F.col(begin)).alias("low"), (F.col("suffix") + F.col(end)).alias("high"))

    out = starts(judged, "far", "near").unionByName(starts(fine_judged, "from", "to")).unionByName(starts(single, "from", "to"))
    return materialize(out, "suffix-refined")


def _equal(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with equal: whether another of the same key is there. rows, which must be materialized, are removed."""
    twice = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("equal", F.lit(True)), "suffix-twice")
    met = hot_join(rows, twice, key, rows.count(), how="left").drop("n")
    met = materialize(met.withColumn("equal", F.coalesce("equal", F.lit(False))), "suffix-equal")
    discard(rows, twice)
    return met


def _with_open(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (materialized) of keys that several have, of which one at least is open and not settled."""
    settled = F.col("equal") if "equal" in rows.columns else F.lit(False)
    some = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("open") & ~settled).alias("some")).where("n > 1 and some")
    return hot_join(rows, materialize(some.drop("some"), "suffix-open"), key, rows.count()).drop("n", "equal")


def repeated_ranges(rows: DataFrame, kinds: list[Strings]) -> DataFrame:
    """row_key, bytes, kind, low, high: every string of that kind that starts at units low to high occurs elsewhere too.

    rows: row_key, bytes (of the UTF-8 text), text. Equal row_key and bytes mean equal text. Materialized.
    """
    n = F.count(F.lit(1)).alias("n")
    suffixes = materialize(_suffixes(rows, kinds), "suffixes")
    grams = suffixes.groupBy("gram").agg(n).where("n > 1")
    shared = materialize(hot_join(suffixes, grams, ["gram"], suffixes.count()).drop("n"), "suffixes-shared")
    discard(suffixes)
    runs = shared.groupBy("gram", "whole").agg(n, F.min(F.struct("row_key", "bytes", "kind", "suffix", "low", "high")).alias("of"))
    runs = materialize(runs, "suffix-runs")
    settled = hot_join(shared, runs.where("n > 1").select("gram", "whole", "n"), ["gram", "whole"], shared.count()).select("row_key", "bytes", "kind", "low", "high")
    settled = materialize(settled, "suffix-settled")
    discard(shared)
    # buckets in which runs differ and one at least is not settled: one suffix of each run goes on
    mixed = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")).where("g > 1 and least = 1").select("gram", "g")
    going = hot_join(runs, mixed, ["gram"], runs.count(), "g").select("of.*", "gram", (F.col("n") == 1).alias("open"))
    going = going.groupBy("row_key", "bytes").agg(F.collect_list(F.struct("kind", "suffix", "low", "high", "gram", "open")).alias("suffixes"))
    going = going.select(F.col("row_key").alias("of_key"), F.col("bytes").alias("of_bytes"), "suffixes")
    texts = rows.join(going, (F.col("row_key") == F.col("of_key")) & (F.col("bytes") == F.col("of_bytes"))).select("row_key", "bytes", "text", "suffixes")
    number = 2 * F.monotonically_increasing_id() + F.col("open").cast("long")
    contexts = materialize(_contexts(texts, kinds).withColumn("ctx", number), "suffix-contexts")
    refined = _refined(contexts, kinds)
    discard(runs, contexts)
    return settled.unionByName(refined)


def _covered(ranges: pa.Array, length: int) -> list[list[tuple[int, int]]]:
    """Maximal runs of covered units of each row, from its ranges of string starts."""
    counts = np.diff(ranges.offsets.to_numpy()) if len(ranges) else np.empty(0, "i8")
    counts = np.where(ranges.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    flat = ranges.flatten()
    row = np.repeat(np.arange(len(counts)), counts)
    low, end = flat.field("low").to_numpy(), flat.field("high").to_numpy() + length
    order = np.lexsort((low, row))
    row, low, end = row[order], low[order], end[order]
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    if not len(row):
        return out
    wide = int(end.max()) + 1
    upto = np.maximum.accumulate(end + row * wide)  # rows ascend, so a row's maximum starts anew
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] + row[1:] * wide > upto[:-1])]))
    last = np.concatenate([at[1:], [len(row)]]) - 1
    for i, a, b in zip(row[at].tolist(), low[at].tolist(), (upto[last] - row[last] * wide).tolist(), strict=True):
        out[i].append((a, b))
    return out


def _in_bytes(data: bytes, spans: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    if unit == "byte" or not spans:
        return spans
    first, end = word_edges(data)
    return [(int(first[a]), int(end[b - 1])) for a, b in spans]


def with_row_keys(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("bytes", F.octet_length(body).cast("long"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, unit: str = "byte", keep: tuple[str, ...] = (), passages: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text, n_passages, n_passage_bytes, row (the columns of keep, as a struct).

    Texts are UTF-8 bytes, null as empty. A unit goes if a string of `length` units that covers it also
    starts elsewhere, in any document, the same one included; strings are those of the input. Units are
    bytes, or words between ASCII white space, which go with the space between them. spans are the maximal
    removed runs (begin, end) in bytes. kept_sha256 is of the bytes that stay; kept_text is their text, in
    which a character that was cut apart is left out. Texts shorter than `length` lose nothing, and
    repeated rows lose everything that is as long. passages: also find the runs covered by repeated strings
    of so many words, and report their number and bytes, without taking them out; else these are null. An
    empty table gives no rows; other columns are not read.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    keyed = with_row_keys(docs.select("doc_id", "text", row.alias("row"))).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kinds = [Strings(unit, length, q)] + ([Strings("word", passages, WORD_Q)] if passages else [])
    span = F.struct("low", "high")
    found = repeated_ranges(keyed.select("row_key", "bytes", "text"), kinds).groupBy(F.col("row_key").alias("of_key"), F.col("bytes").alias("of_bytes"))
    found = materialize(found.agg(F.collect_set(F.when(F.col("kind") == 0, span)).alias("ranges"), F.collect_set(F.when(F.col("kind") == 1, span)).alias("passages")), "suffix-ranges")
    joined = keyed.join(found, (F.col("row_key") == F.col("of_key")) & (F.col("bytes") == F.col("of_bytes")), "left").select("doc_id", "row", "text", "ranges", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            n_bytes, n_removed, n_spans, sha, spans, kept, n_passages, n_passage_bytes = [], [], [], [], [], [], [], []
            found, shared = _covered(batch.column(3), length), _covered(batch.column(4), passages or 0)
            for text, gone, seen in zip(batch.column(2).to_pylist(), found, shared, strict=True):
                data = text.encode()
                gone = _in_bytes(data, gone, unit)
                rest = data
                if gone:
                    edges = [0, *(x for s in gone for x in s), len(data)]
                    rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                n_spans.append(len(gone))
                sha.append(hashlib.sha256(rest).hexdigest())
                spans.append([{"begin": a, "end": b} for a, b in gone])
                kept.append(rest.decode(errors="ignore"))
                seen = _in_bytes(data, seen, "word") if passages else None
                n_passages.append(None if seen is None else len(seen))
                n_passage_bytes.append(None if seen is None else sum(b - a for a, b in seen))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            counts = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            more = [pa.array(x, pa.int64()) for x in (n_passages, n_passage_bytes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(spans, span), pa.array(kept, pa.string()), *more, batch.column(1)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", "n_passages", "n_passage_bytes", "row"],
            )

    schema = T.StructType.fromDDL("doc_id int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>, kept_text string, n_passages long, n_passage_bytes long")
    schema["doc_id"].dataType = docs.schema["doc_id"].dataType
    return joined.mapInArrow(run, schema.add("row", joined.schema["row"].dataType))


def without_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, unit: str = "byte") -> DataFrame:
    """docs with their columns and rows, the repeated passages taken out of text; an n_chars column follows.

    A passage is what strings of `length` units cover that occur elsewhere too; every occurrence goes.
    A null text becomes empty, and so does a text all of which repeats; rows stay in any case. Other
    columns, whatever their names, are kept. An empty table stays empty.
    """
    rest = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    out = remove_repeats(docs, length, q, unit, keep=rest)
    kept = F.col("kept_text").cast(docs.schema["text"].dataType)
    columns = {"text": kept} | ({"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of 400 bytes, and how much of each document passages of over 50 words cover that repeat."""
    out = remove_repeats(documents(spark, sf_dir), passages=WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes")
