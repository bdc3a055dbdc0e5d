import re

import pyarrow as pa
import pytest

from voxtable.llm.common import bounded, split_words


@pytest.mark.parametrize("lower", [False, True])
def test_words_of_slices(lower):
    texts = ["É Ab\tcd", None, "", " x ", "ÀB c\x0bD\x1c e", "word " * 300] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = []
    for part in bounded(iter([batch.slice(1), batch.slice(3, 9)]), "text", 40):
        offsets, words = split_words(part.column("text"), lower)
        words = words.to_pylist()
        got += [words[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
    want = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts[1:] + texts[3:12]]
    if lower:
        want = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in ws] for ws in want]
    assert got == want
