"""Fill-in-middle transformation over a container set of code-point boundaries.

The boundaries of a text are the byte offsets at which a code point begins, and
the end of the text.  They are kept in containers of 65,536 offsets each,
whichever is smallest of a sorted array, a bitmap and a list of runs (an ASCII
text is one run a container), with cumulative cardinalities over the
containers.  ``select(k)``, the offset of the k-th boundary, is a search in the
cumulative cardinalities and a local select inside one container; the two cuts
of a text are two selects, and the pieces are byte slices.

The cuts and the form (plain, prefix-suffix-middle ``psm``, suffix-prefix-middle
``spm``) come from a hash of the document id, so a rerun or a lost executor
gives the same rows.  The original is rebuilt from output and form alone.
Nothing is shuffled; the work of a row is linear in its text.

Defined results: a null or empty text has 0 code points, is plain and gives the
empty string; a text that contains a marker stays plain; a null id hashes like
an empty one; rows that repeat an id draw the same numbers, applied to their
own texts; texts may be of any length; an empty table gives an empty table;
only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import text_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20
CONTAINER = 65_536
OUT_BYTES = 16 << 20  # of texts that leave a task at a time


# ---- the boundary set -------------------------------------------------------

@dataclass
class ArrayContainer:
    values: np.ndarray  # sorted offsets, uint16

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass
class BitmapContainer:
    words: np.ndarray  # uint64, lowest bit first
    upto: np.ndarray  # members up to and with each word

    @classmethod
    def of(cls, member: np.ndarray) -> BitmapContainer:
        padded = np.zeros(-(-len(member) // 64) * 64, bool)
        padded[:len(member)] = member
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        return cls(words, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        word = int(self.words[at])
        for _ in range(k - (int(self.upto[at - 1]) if at else 0)):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


@dataclass
class RunContainer:
    starts: np.ndarray
    before: np.ndarray  # members before each run

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(member: np.ndarray):
    """The smallest container for the flags of one block of offsets."""
    edge = np.diff(member.astype(np.int8), prepend=0)
    starts = np.nonzero(edge == 1)[0]
    n, runs = int(np.count_nonzero(member)), len(starts)
    bits = -(-len(member) // 64) * 16  # words and their counts
    if 8 * runs <= min(2 * n, bits):
        ends = np.nonzero(np.diff(member.astype(np.int8), append=0) == -1)[0] + 1
        sizes = ends - starts
        return RunContainer(starts, np.cumsum(sizes) - sizes)
    if 2 * n <= bits:
        return ArrayContainer(np.nonzero(member)[0].astype(np.uint16))
    return BitmapContainer.of(member)


class BoundarySet:
    """Code-point boundaries of UTF-8 bytes, the end included."""

    def __init__(self, data: bytes):
        self.containers, upto = [], []
        for at in range(0, len(data) + 1, CONTAINER):
            block = np.frombuffer(data, np.uint8, count=min(CONTAINER, len(data) - at), offset=at) if at < len(data) else np.empty(0, np.uint8)
            member = (block & 0xC0) != 0x80
            if at + CONTAINER > len(data):  # the end is a boundary too
                member = np.append(member, True)
            self.containers.append(container(member))
            upto.append(int(np.count_nonzero(member)))
        self.upto = np.cumsum(upto)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """Byte offset of the k-th boundary, counted from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        return at * CONTAINER + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


# ---- the transformation -----------------------------------------------------

def transform(data: bytes, seed_text: str, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
              markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, prefix and middle code points, output)."""
    digest = hashlib.sha256(seed_text.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[at:at + 8], 16) for at in range(0, 32, 8))
    bounds = BoundarySet(data)
    n = len(bounds) - 1
    p, s, m = (x.encode() for x in markers)
    if not n or h3 % 100 >= fim_percent or p in data or s in data or m in data:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.select(first), bounds.select(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", first, second - first, s + suffix + p + prefix + m + middle
    return n, "psm", first, second - first, p + prefix + s + suffix + m + middle


def restore(output: bytes, form: str, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> bytes:
    """The text an output was made of."""
    p, s, m = (x.encode() for x in markers)
    if form == "plain":
        return output
    one, two = (p, s) if form == "psm" else (s, p)
    head, _, rest = output[len(one):].partition(two)
    tail, _, middle = rest.partition(m)
    return head + middle + tail if form == "psm" else tail + middle + head


_COLUMNS = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()),
            ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string()), ("restored", T.StringType(), pa.string())]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output, restored)`` of
    every row; ``restored`` is rebuilt from output and form."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(c, t) for c, t, _ in _COLUMNS]])

    def rows(part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], key_type), *[
            pa.array([r[i + 1] for r in part], t) for i, (_, _, t) in enumerate(_COLUMNS)]], ["key", *[c for c, _, _ in _COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal key_type
        for batch in batches:
            key_type = batch.schema.field("key").type
            part, size = [], 0
            for k, s, t in zip(*(batch.column(c) for c in ("key", "seed", "text"))):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                n, form, prefix, middle, out = transform(data, s.as_py(), fim_percent, spm_percent)
                part.append((k.as_py(), n, form, prefix, middle, out.decode(), restore(out, form).decode()))
                size += len(data)
                if size >= OUT_BYTES:
                    yield rows(part)
                    part, size = [], 0
            if part:
                yield rows(part)

    key_type = None
    light = docs.select(F.col(key).alias("key"), F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("seed"),
                        F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).withColumnRenamed("key", key)
