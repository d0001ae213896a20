import hashlib
import random
import re

import pytest

from vellumspark.llm import fill_middle as M
from vellumspark.llm import queries

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, fim=100, spm=50):
    """The rule in words of its own: lines by a regular expression, slices by joining them."""
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    hexes = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(hexes[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= fim:
        return len(lines), "plain", None, None, text
    i, j = sorted(x % (len(lines) + 1) for x in h[:2])
    a, b, c = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(lines), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts(seed=0):
    rng = random.Random(seed)
    pieces = ["\n", "\n", "\r\n", "word ", "é", "🙂", "漢", " ", "\x85", "\x00", "<P", "P>", "\t", " "]
    odd = [None, "", "\n", "\n\n\n", "no end", "end\n", "a<P>b\nc", "<S>\n", "x\n<M>", "<\nP>", "$1\\Q\\E\n|.*\n", "a\n" * 60_000, "z" * 400_000, "é\n🙂\n" * 3000]
    return odd + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 0), (0, 50), (90, 100)])
def test_against_the_rule(spark, fim, spm):
    rows = [(k, t, "kept", k) for k, t in enumerate(texts())] + [(3, "\n\n\n", "kept", 3)] * 3 + [(None, "a\nb\nc", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n long")
    got = M.fill_middle(docs, fim_percent=fim, spm_percent=spm, keep=("output", "n")).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, ((i, *plain(i, t, fim, spm)) for i, t, _, _ in rows)))
    assert all(r.kept.n == r.doc_id and r.kept.output == (None if r.doc_id is None else "kept") for r in got)
    back = M.digest_outputs(M.fill_middle(docs, fim_percent=fim, spm_percent=spm)).collect()
    want = sorted((repr(i), sha(t or "")) for i, t, _, _ in rows)
    assert sorted((repr(r.doc_id), r.restored_sha256) for r in back) == want
    assert M.fill_middle(docs.where("false")).count() == 0


def test_other_units_and_marks(spark):
    docs = spark.createDataFrame([(k, "one two  three\nfour") for k in range(50)], "doc_id long, text string")
    made = M.fill_middle(docs, pattern="[^ ]* |[^ ]+", marks=("[p]", "(s)", "{m}"))
    assert {r.n for r in made.collect()} == {4}
    assert {r.restored_sha256 for r in M.digest_outputs(made, ("[p]", "(s)", "{m}")).collect()} == {sha("one two  three\nfour")}
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("", "a", "b"), ("xax", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.fill_middle(docs, marks=marks)


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: (sha(p := plain(r.doc_id, r.text)[4]), sha(r.text or ""), p) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op11_fill_middle"](spark, folder).collect()
    assert {r.doc_id: (r.output_sha256, r.restored_sha256) for r in got} == {k: v[:2] for k, v in want.items()}
    assert {"psm", "spm"} <= {r.form for r in got}
