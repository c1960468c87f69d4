"""Terms of whole texts as arrays of integers: what importance resampling and lexical search read.

A term is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null and empty texts
have none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Every byte that no term has becomes a space; A-Z become a-z; a character beyond ASCII keeps its bytes.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass
class Terms:
    """The terms of some texts: `words` has each different one once, `ids` one entry a term, `text` the row it is of."""

    words: pa.StringArray
    ids: np.ndarray
    text: np.ndarray

    def counts(self, texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=texts)


def terms_of(texts: pa.Array) -> Terms:
    """The terms of an array of strings, through an integer dictionary of its different words."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    clean = data[int(ends[0]) : int(ends[-1])].to_pybytes().translate(_CLEAN) if data is not None and len(texts) else b""
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[:1]), pa.py_buffer(clean))
    split = pc.ascii_split_whitespace(clean)
    coded = split.flatten().dictionary_encode()
    ids, rows = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    gap = pc.index(coded.dictionary, pa.scalar("", pa.string())).as_py()  # what splitting leaves at a text's ends
    if gap >= 0:
        there = ids != gap
        ids, rows = ids[there], rows[there]
    return Terms(coded.dictionary, ids, rows)
