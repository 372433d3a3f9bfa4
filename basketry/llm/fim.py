"""Fill-in-middle by displacement scatter.

The texts of a slice are one run of bytes.  A scan of the bytes finds the
token ends, two of which are a document's cuts.  Each of its three segments
moves as a whole, so the shift of a byte is a step function: the steps are
written into a difference array, a cumulative sum turns them into the output
shift of every byte, and one scatter builds all outputs of the slice.  The way
back scans the outputs for the three marks, builds the shifts the same way and
gathers the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import by_bytes, filled, ship_package, text_bytes

#: Bytes of text that are laid out at a time (one longer text is laid out alone); eight-byte shifts make it some ten times as much.
SLICE_BYTES = 4_000_000
#: The marks, three bytes each, told apart by the middle one, and the share of documents that get each form.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
FIM_PERCENT, SPM_PERCENT = 50, 80
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the SHA-256 of ``seed:doc_id``; a null id reads as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def string_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data))


def _marks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that lie within one row, and their rows."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], [ord(c) for c in MARKS])]
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + 2 < bounds[row + 1]
    return at[inside], row[inside]


def _shifts(total: int, starts: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """The place that each of ``total`` bytes goes to: segments in rising order of their starts, column by column of each row."""
    flat = np.stack(shifts, 1).ravel()
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, np.stack(starts, 1).ravel(), np.diff(flat, prepend=0))
    moved = np.cumsum(steps[:total], out=steps[:total])
    moved += np.arange(total)
    return moved


def scattered(data: np.ndarray, bounds: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Output bytes and bounds, number of tokens, form, and the code points of prefix and middle of every row."""
    begin, end = bounds[:-1], bounds[1:]
    space = (data == 0x20) | (data >= 0x09) & (data <= 0x0D)
    last = np.zeros(len(data), bool)
    last[:-1] = ~space[:-1] & space[1:]  # a token ends before white space that follows a word, and with its text
    last[end[end > begin] - 1] = True
    stops = np.flatnonzero(last) + 1
    first = np.searchsorted(stops, begin, side="right")
    n = np.searchsorted(stops, end, side="right") - first
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    stops = np.concatenate((stops, [0]))
    one, two = (np.where(k > 0, stops[first + k - 1], begin) for k in (np.minimum(a, b), np.maximum(a, b)))
    form = np.where(h[3] % 100 < SPM_PERCENT, SPM, PSM)
    form[(n == 0) | (h[2] % 100 >= FIM_PERCENT)] = PLAIN
    form[_marks(data, bounds)[1]] = PLAIN
    plain, spm = form == PLAIN, form == SPM
    one, two = np.where(plain, end, one), np.where(plain, end, two)
    prefix, middle, suffix = one - begin, two - one, end - two
    out = np.concatenate(([0], np.cumsum(end - begin + np.where(plain, 0, 9))))
    o = out[:-1]
    to_prefix = o + np.where(plain, 0, np.where(spm, 6 + suffix, 3))
    to_suffix = o + np.where(spm, 3, 6 + prefix)
    to_middle = o + 9 + prefix + suffix
    result = np.empty(int(out[-1]), np.uint8)
    # of a plain row the prefix is everything
    result[_shifts(len(data), [begin, one, two], [to_prefix - begin, to_middle - one, to_suffix - two])] = data
    for mark, place in (("P", to_prefix - 3), ("S", to_suffix - 3), ("M", to_middle - 3)):
        for i, c in enumerate(MARKS[mark]):
            result[place[~plain] + i] = c
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return result, out, n, form, points[one] - points[begin], points[two] - points[one]


def gathered(data: np.ndarray, bounds: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts that the outputs were made of."""
    begin, end = bounds[:-1], bounds[1:]
    at, row = _marks(data, bounds)
    at = at[~plain[row]]
    if len(at) != 3 * int((~plain).sum()):
        raise ValueError("an output without its three marks")
    marks = np.stack((begin, end, end)).astype(np.int64)  # of a plain row the first segment is everything
    marks[:, ~plain] = at.reshape(-1, 3).T
    skip = np.where(plain, 0, 3)
    starts = [marks[0] + skip, marks[1] + skip, marks[2] + skip]
    sizes = [marks[1] - starts[0], marks[2] - starts[1], end - starts[2]]
    prefix = np.where(spm, starts[1], starts[0]), np.where(spm, sizes[1], sizes[0])
    suffix = np.where(spm, starts[0], starts[1]), np.where(spm, sizes[0], sizes[1])
    out = np.concatenate(([0], np.cumsum(prefix[1] + suffix[1] + sizes[2])))
    p = out[:-1]
    m = p + prefix[1]
    s = m + sizes[2]
    return data[_shifts(int(out[-1]), [p, m, s], [prefix[0] - p, starts[2] - m, suffix[0] - s])], out


def fill_in_middle(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Every document cut into prefix, middle and suffix and put together for filling in.

    Returns doc_id, n (tokens), form, prefix_chars, middle_chars (code points,
    null if plain), output.  What is drawn depends on doc_id and seed alone.

    Null texts count as empty, empty ones are plain; texts that hold a mark are
    plain; null ids draw from the seed alone; very long texts are laid out
    alone, in memory of some ten times their size; repeated rows stay and get
    equal outputs, so there are no ties to break; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for part in by_bytes(batches, 1, most):
            data, bounds = text_bytes(part.column(1))
            h = [c.to_numpy(zero_copy_only=False) for c in part.columns[2:]]
            out, out_bounds, n, form, prefix, middle = scattered(data, bounds, h)
            chars = [pa.array(v, pa.int64(), mask=form == PLAIN) for v in (prefix, middle)]
            said = pa.DictionaryArray.from_arrays(pa.array(form.astype(np.int8)), pa.array(FORMS)).cast(pa.string())
            columns = [part.column(0), pa.array(n, pa.int64()), said, *chars, string_column(out, out_bounds)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    ship_package(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("doc_id"), filled(docs, text_col).cast("string").alias("text"), *draws(docs[id_col], seed))
    return slim.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", most: int = SLICE_BYTES) -> DataFrame:
    """``outputs`` with the texts that they were made of in the column ``name``, from output and form alone.

    All other columns stay; a row that isn't plain and has not its three marks
    is an error.  Null outputs count as empty and plain; an empty table gives
    an empty result.
    """
    columns = [outputs[c] for c in outputs.columns if c != name]
    rest = len(columns)
    wide = outputs.select(*columns, filled(outputs, output_col).cast("string").alias("_output"),
                          F.when(outputs[output_col].isNull(), "plain").otherwise(outputs[form_col]).alias("_form"))
    schema = wide.drop("_output", "_form").withColumn(name, F.lit("")).schema

    def run(batches):
        for part in by_bytes(batches, rest, most):
            data, bounds = text_bytes(part.column(rest))
            form = np.array(part.column(rest + 1).to_pylist(), object)
            text = string_column(*gathered(data, bounds, form == "plain", form == "spm")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:rest], text], names=[*part.schema.names[:rest], name])

    ship_package(outputs.sparkSession)
    return wide.mapInArrow(run, schema)


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of each output and of the text restored from it."""
    out = restored(fill_in_middle(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def oracle_sql(seed: int = 42) -> str:
    """DuckDB SQL for ``fim_digests(documents)``."""
    space = r"\x20\x09-\x0D"
    return f"""
with t as (
  select doc_id, coalesce(text, '') as x, sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[{space}]*[^{space}]+|[{space}]+') as u
  from documents),
d as (
  select doc_id, x, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
    x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= {FIM_PERCENT} as plain,
    ('0x' || substr(h, 25, 8))::bigint % 100 < {SPM_PERCENT} as spm
  from t),
c as (
  select *, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(u[greatest(a, b) + 1:], '') as s from d)
select doc_id, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
  case when not plain then length(p) end as prefix_chars, case when not plain then length(m) end as middle_chars,
  sha256(case when plain then x when spm then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(x) as restored_sha256
from c"""
