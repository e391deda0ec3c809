import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from gaugemill.llm import infill

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(key, text):
    """The contract word by word."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a<PSM>é😀\n \r", max_size=60), st.integers(0, 10**6))
def test_transform_and_restore(text, key):
    n, form, before, inside, output = infill.transform(str(key), text.encode())
    assert (n, form, before, inside, output.decode()) == plain(key, text)
    assert infill.restore(output, form).decode() == text


@pytest.mark.parametrize("n", [0, 1, 4, 5, 17, 1000, 20011])
def test_every_rank_of_the_skip_list(n):
    units = [("é" * (i * 7 % 11) + "x" * (i % 3) + "\n") for i in range(n)]
    data = "".join(units).encode()
    lines, chars, size = infill.SkipList(data), 0, 0
    assert lines.n == n and (n < 100 or len(lines.lanes) >= 3)
    step = max(1, n // 997)
    for rank in range(n + 1):
        if rank % step == 0 or rank == n:
            assert lines.descend(rank) == (chars, size)
        if rank < n:
            chars, size = chars + len(units[rank]), size + len(units[rank].encode())


def test_lanes_thin_out():
    lines = infill.SkipList(b"a\n" * 100_000)
    sizes = [len(lane.below) for lane in lines.lanes]
    assert all(b < 0.4 * a for a, b in zip(sizes, sizes[1:], strict=False) if a > 500)
    assert all(lane.widths.sum(0).tolist() == [100_000, 200_000, 200_000] for lane in lines.lanes)


def test_rows_nulls_repeats_and_clashing_names(spark):
    long = "word é\n" * 400_000
    rows = [(1, "a\nb\nc", "k"), (1, "a\nb\nc", "k"), (2, None, "k"), (3, "", "k"), (4, "x<M>y\n", "k"), (None, "q\nr\n", None), (5, long, "k"), (6, "\n\n\n", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = infill.fill_in_middle(docs, ["doc_id", "form"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for key, text, _ in rows:
        n, form, before, inside, output = plain("" if key is None else key, text or "")
        r = by[key]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, before, inside, output)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert infill.fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0
    assert infill.fill_in_middle(docs, []).columns == infill.RESULTS
