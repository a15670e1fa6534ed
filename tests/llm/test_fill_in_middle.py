import hashlib
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text, i, rate=50, spm=80):
    """The rule, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[a : a + 8], 16) for a in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h3 % 100 >= rate or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text(alphabet="ab \n\t\x0b\x1c\xa0é😀<P>SM", max_size=60), st.integers(0, 40))
def test_same_as_the_rule_unit_by_unit(text, i):
    n, form, p, m, output = fim.transform(text.encode(), f"42:{i}", rate=80)
    assert (n, form, p, m, output.decode()) == plain(text, i, rate=80)
    assert fim.rebuilt(output, form).decode() == text


def test_masks_of_blocks_meet(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a é \n") for _ in range(rng.randrange(200))) for _ in range(150)]
    want = [plain(t, i) for i, t in enumerate(texts)]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(fim, "BLOCK", size)
        assert [(*r[:4], r[4].decode()) for r in (fim.transform(t.encode(), f"42:{i}") for i, t in enumerate(texts))] == want


def test_ranked_bits():
    rng = random.Random(1)
    for _ in range(50):
        bits = rng.getrandbits(rng.choice([1, 8, 500])) | 1
        places = [i for i in range(bits.bit_length()) if bits >> i & 1]
        assert [fim.select(bits, k) for k in range(len(places))] == places


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    some = [(i, " ".join(rng.choice(["wörd", "x\n\n", "\t", "😀", "<P", "S>"]) for _ in range(rng.randrange(30)))) for i in range(200)]
    return some + [(300, None), (301, ""), (302, "   "), (303, "has <S> inside"), (304, "y " * 600_000), (305, "z" * 2_000_000), (None, "no id here"), (None, None), (7, "again"), (7, "again")]


def test_whole_table(spark, rows):
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    done = fim.with_restored(fim.fill_in_middle(df)).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done), key=str)
    assert got == sorted(((i, *plain(t, i)) for i, t in rows), key=str)
    assert sorted((str(r.doc_id), r.restored) for r in done) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    done = fim.with_restored(fim.fill_in_middle(spark.createDataFrame([], "doc_id string, text string")))
    assert done.count() == 0 and done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
