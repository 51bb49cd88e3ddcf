import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tenderlens.llm import blockcounts, textscan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x85 日", max_size=40)), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    lower = {c: c + 32 for c in range(65, 91)}
    want = [WORD.findall((t or "").translate(lower)) for t in texts]
    got = textscan.scan(pa.array(texts, pa.string()))
    flat = [w for ws in want for w in ws]
    assert [bytes(got.data[a:b]).decode() for a, b in zip(got.start, got.end)] == flat
    assert np.diff(got.first).tolist() == [len(w) for w in want]
    by_word = {}
    for w, h in zip(flat, got.hash.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingle_sets(texts, size):
    values, cuts = textscan.shingle_sets(textscan.scan(pa.array(texts, pa.string())), size)
    lower = {c: c + 32 for c in range(65, 91)}
    words = [WORD.findall((t or "").translate(lower)) for t in texts]
    sets = [{tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    assert np.diff(cuts).tolist() == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            mine = len(np.intersect1d(values[cuts[i]: cuts[i + 1]], values[cuts[j]: cuts[j + 1]]))
            assert mine == len(sets[i] & sets[j])


def test_sliced_arrays():
    whole = pa.array(["x", "a b", None, "c d e", "f"], pa.string())
    part = whole.slice(1, 3)
    assert np.diff(textscan.scan(part).first).tolist() == [2, 0, 3]
    batch = pa.RecordBatch.from_arrays([whole], names=["t"])
    assert sum(p.num_rows for p in textscan.slices(batch, 0, 2)) == 5


def test_counts_travel_whole():
    rng = np.random.default_rng(0)
    for bits in (0, 3):
        blocks = []
        for b in range(4):
            keys = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64) & np.uint64(0xFFF0000000000FFF))
            blocks.append((keys, rng.choice([0, 1, 126, 127, 128, 70_000], len(keys))))
        asked = pa.concat_tables([blockcounts.questions(i, [x], bits, False, True) for i, x in enumerate(blocks)])
        answers = []
        for part in range(1 << bits):
            answers.append(blockcounts._answer(asked.filter(pa.compute.equal(asked["part"], part))))
        answers = pa.concat_tables(answers)
        want = {}
        for keys, weights in blocks:
            for k, w in zip(keys.tolist(), weights.tolist()):
                want[k] = want.get(k, 0) + w
        for i, (keys, _) in enumerate(blocks):
            own = answers.filter(pa.compute.equal(answers["block"], i))
            got = blockcounts.totals_of([keys], own, bits)[0]
            assert got.tolist() == [want[k] for k in keys.tolist()]
