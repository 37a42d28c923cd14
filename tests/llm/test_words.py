"""Words, lines and windows in numpy against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, prose

from cohort_ledger.llm import words as W

TEXTS = [r[1] for r in prose() + awkward()]


@pytest.mark.parametrize("limit", [1, 300, 10**7])
def test_words_lines_and_hashes(limit):
    seen, at = {}, 0
    for texts in W.slices(pa.array(TEXTS), limit):
        assert (texts.rows.start, texts.n) == (at, texts.rows.stop - at)
        raw = texts.data.tobytes()
        for kind, pattern in (("blank", rb"[^\x20\x09-\x0D]+"), ("term", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            spans = W.words(texts, W.word_table(kind))
            hashed = W.hashes(texts, spans, lower=kind == "term")
            for i in range(texts.n):
                mine = (TEXTS[at + i] or "").encode()
                mine = mine.lower() if kind == "term" else mine
                got = [raw[a:b] for a, b in zip(spans.start[spans.first[i] : spans.first[i + 1]], spans.end[spans.first[i] : spans.first[i + 1]])]
                want = re.findall(pattern, mine)
                if kind == "term":
                    want = re.findall(rb"[0-9a-z\x80-\xff]+", mine)
                    got = [g.lower() for g in got]
                assert got == want
                for w, h in zip(got, hashed[spans.first[i] : spans.first[i + 1]].tolist()):
                    assert seen.setdefault((kind, w), h) == h
        rows = W.lines(texts)
        for i in range(texts.n):
            got = [raw[a:b].decode() for a, b in zip(rows.start[rows.first[i] : rows.first[i + 1]], rows.end[rows.first[i] : rows.first[i + 1]])]
            assert got == ([] if TEXTS[at + i] is None else TEXTS[at + i].split("\n"))
        at = texts.rows.stop
    assert at == len(TEXTS)
    for kind in ("blank", "term"):
        own = [h for (k, _), h in seen.items() if k == kind]
        assert len(set(own)) == len(own)


def test_windows_stay_in_their_document():
    texts = next(W.slices(pa.array(["a b c", "b c", None, "a b c d"])))
    spans = W.words(texts, W.word_table("blank"))
    names = W.window_hashes(W.hashes(texts, spans), 2)
    starts = W.window_starts(spans, 2)
    assert starts.tolist() == [0, 1, 3, 5, 6, 7]
    assert names[0] == names[5] and names[1] == names[3] == names[6] and len(np.unique(names[starts])) == 3


def test_slices_of_a_sliced_column_with_nulls():
    column = pa.array(["xx", None, "yy", "", "zz"]).slice(1, 3)
    texts = next(W.slices(column))
    assert texts.n == 3 and texts.valid.tolist() == [False, True, True] and texts.data.tobytes() == b"yy"
