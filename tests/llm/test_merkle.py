import hashlib
import random
import zlib

from vellumspark.llm import merkle as M
from vellumspark.llm.common import held_out, lower_ascii

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, idx long"


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of one tree, each a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[k : k + 8]) for k in range(0, len(row), 8)])
    return levels


def siblings(levels, at):
    """[(left, right)] from the node up to the root."""
    out = []
    for row in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(row[run:at]), "".join(row[at + 1 : run + 8])))
        at //= 8
    return out


def plain(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        shown = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n, shown), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (_, _, digest, shown, doc_id) in enumerate(sorted(groups[g])):
            proof = siblings(trees[g], at) + siblings(top, k)
            cur = shown
            for left, right in proof:
                cur = H(left, cur, right)
            out.append((doc_id, digest, trees[g][-1][0], top[-1][0], H(*(a + b for a, b in proof)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def query(docs):
    manifest = M.build_manifest(M.document_leaves(docs, held_out("doc_id", 3, 0), lower_ascii("text")))
    return manifest, M.proofs(manifest)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)


def test_against_plain_trees(spark):
    rng = random.Random(1)
    langs = [None, "", "-", "en", "En", "é", "zh", "漢", "a", "aa", "=", "b", "c", "d"]
    rows = [(k, rng.choice([None, "", "Plain Text", "É À lower", "漢字 ABC"]), "en" if k % 3 == 0 else rng.choice(langs), rng.choice([None, "", "s"]), rng.choice([None, 0, 7])) for k in range(700)]
    rows += [(None, "Null id", "en", None, None)] * 2 + [(3, "same", "en", "s", 4)] * 3 + [(9000, "X" * 500_000, "long", "s", 1), (-5, "N", "en", "s", 1)]
    rows += [(10_000 + k, "Nine", "nine", "s", k) for k in range(9)] + [(20_000 + k, "Sixty five", "sixty", "s", k) for k in range(65)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    manifest, proven = query(docs)
    got = sorted((tuple(r) for r in M.digest_proofs(proven).collect()), key=repr)
    assert got == plain(rows)
    assert manifest.subroots().count() == len({r[2] for r in rows}) and manifest.root() == got[0][3]
    manifest.discard()


def test_one_leaf_one_group_and_none(spark):
    for rows in ([(1, "A", "en", "s", 1)], [(k, "B", None, "s", 1) for k in range(8)], [(1, "A", "en", "s", 1), (2, "b", "de", "s", 1)]):
        _, proven = query(frame(spark, rows))
        assert sorted((tuple(r) for r in M.digest_proofs(proven).collect()), key=repr) == plain(rows)
    manifest, proven = query(frame(spark, [(1, "A", "en", "s", 1)]).where("false"))
    assert M.digest_proofs(proven).count() == 0 and manifest.root() is None


def test_a_hot_group_is_dealt_over_partitions(spark):
    docs = frame(spark, [(k, f"t{k}", "en", "s", 1) for k in range(4000)])
    nodes = M.ranked(M.document_leaves(docs), ["id", "digest"], "hot")
    assert [r.idx for r in nodes.orderBy("id").select("idx").collect()] == list(range(4000))
    assert nodes._vellum_placed.select("part").distinct().count() == 4


def test_saved_manifest_verifies_later_rows(spark, tmp_path):
    rows = [(k, f"Text {k}", "en" if k % 2 else "de", "s", k) for k in range(100)] + [(5, "other text of id 5", "en", "s", 0)]
    manifest, _ = query(frame(spark, rows))
    manifest.save(f"file://{tmp_path}/manifest")
    stored = M.load_manifest(spark, f"file://{tmp_path}/manifest")
    assert stored.root() == manifest.root()
    later = [(k, "changed" if k == 7 else f"Text {k}", "en" if k % 2 else "de", "s", k) for k in range(100)] + [(5, "other text of id 5", "en", "s", 0), (555, "new", "en", "s", 1)]
    got = M.verify(M.document_leaves(frame(spark, later)), M.proofs(stored)).collect()
    assert len(got) == 102 and {r.id for r in got if not r.verified} == {7, 555}
