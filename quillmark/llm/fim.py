"""Fill-in-middle transformation of texts by displacement scatter.

A text is cut into units (a run of ASCII letters, or one other code point).
Two hashed cuts give prefix, middle and suffix, and the output holds them in
the order of its form:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* ``plain``: the text as it is.

The bytes of many texts lie in one array.  One running count of unit starts
finds every cut.  Every segment moves as a whole, so a difference array holds
the change of displacement where a segment begins; its cumulative sum is the
displacement of every byte, and one scatter writes all outputs.  ``restore``
reads the marks of an output, builds the displacements the other way round
and gathers the bytes of the texts.

Texts are taken ``at_once`` bytes at a time (a longer one alone), so a worker's
memory follows the longest text and not the batch.  There is no shuffle: a lost
task is read and cut again from its own rows, with the same hashes.

Defined cases: a null text counts as empty, and an empty text is plain; a text that holds a
mark is plain, so marks are never ambiguous; a null ``doc_id`` hashes as empty text; repeated rows
and ties are transformed one by one, the same way; extra columns are left out, whatever their names;
an empty table gives an empty result; in ``restore`` a null output gives an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmark.llm.common import texts_of

# The marks before prefix, suffix and middle, and the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def joined(column: pa.Array, at_once: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of texts of about ``at_once`` bytes; null counts as empty."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + at_once, side="right")) - 1)
        yield first, last, data[ends[first]: ends[last]], ends[first: last + 1] - ends[first]
        first = last


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String array over bytes and offsets."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def marks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every mark that lies within one text."""
    at = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    at = at[(data[at + 2] == PREFIX[2]) & np.isin(data[at + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    text = np.searchsorted(ends, at, side="right") - 1
    inside = at + 3 <= ends[text + 1]
    return at[inside], text[inside]


def displacement(n: int, begins: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Displacement of each of n bytes; ``begins`` are the ascending first bytes of segments (empty ones too)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, begins, np.diff(shifts, prepend=0))
    return np.cumsum(change[:n])


def places(form: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes in the outputs of (prefix, middle, suffix) and of the marks before prefix, suffix and middle.

    ``begin`` is where each output begins, ``length`` (texts, 3) the bytes of prefix, middle and suffix.
    """
    p, m, s = length.T
    k = len(PREFIX)
    psm = np.stack([begin + k, begin + 3 * k + p + s, begin + 2 * k + p], 1)
    spm = np.stack([begin + 2 * k + s, begin + 3 * k + p + s, begin + k], 1)
    plain = np.stack([begin, begin + p, begin + p + m], 1)
    to = np.where((form == PSM)[:, None], psm, np.where((form == SPM)[:, None], spm, plain))
    return to, to[:, [0, 2, 1]] - k


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers a document: the first digits of the hex sha256 of seed, colon and id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").astype(np.int64).reshape(-1, 4)


def cut(data: np.ndarray, ends: np.ndarray, h: np.ndarray, plain_percent: int, spm_percent: int):
    """(units, form, cuts): ``cuts`` (texts, 4) are the bytes where prefix, middle and suffix begin and the text ends."""
    start, stop = ends[:-1], ends[1:]
    letter = LETTER[data]
    follows = np.zeros(len(data), dtype=bool)
    follows[1:] = letter[:-1]
    follows[start[start < len(data)]] = False
    opens = ((data & 0xC0) != 0x80) & ~(letter & follows)
    before = np.concatenate([[0], np.cumsum(opens)])
    units = before[stop] - before[start]
    where = np.append(np.flatnonzero(opens), len(data))

    def place(k: np.ndarray) -> np.ndarray:
        return np.where(k < units, where[np.minimum(before[start] + k, len(where) - 1)], stop)

    a, b = h[:, 0] % (units + 1), h[:, 1] % (units + 1)
    cuts = np.stack([start, place(np.minimum(a, b)), place(np.maximum(a, b)), stop], 1)
    form = np.where(h[:, 3] % 100 < spm_percent, SPM, PSM)
    form[(units == 0) | (h[:, 2] % 100 >= 100 - plain_percent)] = PLAIN
    form[marks(data, ends)[1]] = PLAIN
    return units, form, cuts


def scatter(data: np.ndarray, form: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs."""
    size = cuts[:, 3] - cuts[:, 0] + np.where(form == PLAIN, 0, 3 * len(PREFIX))
    ends = np.concatenate([[0], np.cumsum(size)])
    to, at = places(form, ends[:-1], np.diff(cuts, axis=1))
    out = np.empty(ends[-1], dtype=np.uint8)
    shift = displacement(len(data), cuts[:, :3].ravel(), (to - cuts[:, :3]).ravel())
    out[np.arange(len(data)) + shift] = data
    for column, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        out[at[form != PLAIN, column][:, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    return out, ends


def gather(data: np.ndarray, ends: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts whose outputs these are."""
    moved = form != PLAIN
    at, text = marks(data, ends)
    at, text = at[moved[text]], text[moved[text]]
    found = np.tile(ends[:-1, None], (1, 3))
    seen = np.zeros(found.shape, dtype=np.int64)
    for column, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        own = data[at + 1] == mark[1]
        found[text[own], column] = at[own]
        np.add.at(seen[:, column], text[own], 1)
    if (seen[moved] != 1).any():
        raise ValueError("an output of form psm or spm must hold each mark once")
    k = len(PREFIX)
    p, s, m = found.T
    start, stop = ends[:-1], ends[1:]
    length = np.stack([np.where(form == PSM, s, m) - p - k, stop - m - k, np.where(form == PSM, m, p) - s - k], 1)
    length[~moved] = 0
    length[~moved, 0] = (stop - start)[~moved]
    if (length < 0).any():
        raise ValueError("the marks of an output do not stand in the order of its form")
    back = np.concatenate([[0], np.cumsum(length.sum(1))])
    to, _ = places(form, start, length)
    begins = back[:-1, None] + np.cumsum(length, axis=1) - length
    shift = displacement(int(back[-1]), begins.ravel(), (to - begins).ravel())
    return data[np.arange(back[-1]) + shift], back


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
              at_once: int = 4_000_000) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): n units, code points of prefix and middle (null if plain)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for first, last, data, ends in joined(b.column("text"), at_once):
                some = ids.slice(first, last - first)
                n, form, cuts = cut(data, ends, draws(some.to_pylist(), seed), plain_percent, spm_percent)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = np.diff(chars[cuts], axis=1)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [some, pa.array(n, pa.int64()), pa.array(np.array(FORMS, dtype=object)[form], pa.string()),
                     pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1], pa.int64(), mask=plain),
                     strings(*scatter(data, form, cuts))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts_of(docs, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, at_once: int = 4_000_000) -> DataFrame:
    """``rows`` (form, output and other columns) with ``restored``, the text built from form and output alone."""
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pc.index_in(b.column("form"), pa.array(FORMS)).fill_null(PLAIN).to_numpy(zero_copy_only=False)
            for first, last, data, ends in joined(b.column("output"), at_once):
                back = strings(*gather(data, ends, kinds[first:last].astype(np.int64)))
                kept = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*kept.columns, back], names=[*b.schema.names, "restored"])

    return rows.mapInArrow(run, schema)
