import pytest

from vellumspark.functions import markdown as M
from vellumspark.operators import knowledge_graph
from vellumspark.operators.links import check_anchors
from vellumspark.sources import vault


def block(*lines):
    return "---\n" + "\n".join(lines) + "\n---\nbody\n"


def test_frontmatter_values():
    n = M.parse_note(block("title: 'it''s' # note", 'aliases: ["a, b", c, ]', "tags:", "  - x # y", "- 'z'", "empty:", "ratio: a#b", "quote: don't"))
    assert n.error is None and n.offset == 10 and n.body == "body\n"
    assert n.properties == {"title": ["it's"], "aliases": ["a, b", "c"], "tags": ["x", "z"], "empty": [], "ratio": ["a#b"], "quote": ["don't"]}
    assert n.lists == {"aliases", "tags", "empty"}


def test_frontmatter_keys_and_quotes():
    n = M.parse_note(block("url:http://x/y#z", "key : v", "q:'it # x' # c", "e: []", "l: ['a, b', \"c\\\"d\", 'e''f'] # c", "items :", "- \"x: y\"", " # note", "  -  z"))
    assert n.error is None and n.properties == {"url": ["http://x/y#z"], "key": ["v"], "q": ["it # x"], "e": [], "l": ["a, b", 'c"d', "e'f"], "items": ["x: y", "z"]}
    for lines in (["l: [don't, x]"], ["- "], ["a b: c"], [": x"], ["a: b", "- c"], ["plain"], ["a: 'x' y'z"]):
        assert M.parse_note(block(*lines)).error, lines


def test_quotes_in_links_and_written_aliases(spark):
    found = M.body_links("[[\"N|l\"]] [[ 'N#a' ]]")
    assert [(x["note"], x["anchor"], x["label"]) for x in found] == [("N", None, "l"), ("N", "a", None)]
    rows = [("v/one.md", block("type: learning", "aliases: it's")), ("v/two.md", block("type: learning", "aliases: [\"it's\", 'say \"x\"', 'b\\n', \"both ' and \\\"\"]")), ("v/none.md", block("type: learning")), ("v/blocks.md", "[[one#^B]] [[one#^b]] [[ONE#x]]\n"), ("v/w.md", block("type: learning") + "text ^b")]
    notes = vault.notes(spark.createDataFrame(rows, "path string, text string"))
    texts = {r.note_id: r.text.split("\n")[1] for r in knowledge_graph.semantic_chunks(notes).where("heading = 'Document'").collect()}
    assert texts == {"v/one": "Aliases: it's", "v/two": "Aliases: " + str(["it's", 'say "x"', "b\\n", "both ' and \""]), "v/none": "Aliases: []", "v/w": "Aliases: []"}
    links = spark.createDataFrame([("v/w", "^b"), ("v/w", "^B"), ("v/w", "none")], "target string, anchor string")
    assert {r.anchor: r.state for r in check_anchors(links, knowledge_graph.anchors(notes)).collect()} == {"^b": "resolved", "^B": "missing_anchor", "none": "missing_anchor"}


@pytest.mark.parametrize("lines", [["a: 1", "a: 2"], ["  a: 1"], ["- x"], ["a: {b: c}"], ["a: 'open"], ["a: >"], ["1a: x"], ["a: [b"], ["a: &x y"]])
def test_frontmatter_is_refused(lines):
    n = M.parse_note(block(*lines))
    assert n.error and not n.properties and n.body.startswith("---")


def test_frontmatter_edges():
    assert M.parse_note("---\nopen: 1\n").error
    crlf = M.parse_note("---\r\na: b\r\n...\r\nx\r\n")
    assert crlf.properties == {"a": ["b"]} and crlf.body == "x\r\n"
    assert M.parse_note("---\na: b\n --- \nx").properties == {"a": ["b"]}
    assert M.parse_note("text\n---\n").properties == {} and M.parse_note(None).body == ""


def test_visible_lines_and_links():
    body = "a [[One|l]] `[[no]]`\n````\n[[no]]\n```\n````\n<!-- [[no]] -->![[Two#h]]\n<!--\n[[no]]\n--> [[no]]\n[[#here]] a <!-- x --> b <!-- [[no]] --> <!-- [[no]]"
    found = M.body_links(body, 10)
    assert [(x["note"], x["anchor"], x["label"], x["line"], x["embedded"]) for x in found] == [("One", None, "l", 11, False), ("Two", "h", None, 16, True), ("", "here", None, 20, False)]


def test_sections():
    body = "intro\n# A #\n## C#\none\n# A\n```\n# no\n```\n## B\n\n## C#\ntwo"
    got = [("/".join(s["heading_path"]), s["occurrence"], s["start_line"]) for s in M.sections(body)]
    assert got == [("", 1, 1), ("A", 1, 2), ("A/C#", 1, 3), ("A", 2, 5), ("A/B", 1, 9), ("A/C#", 2, 11)]
    first, heading = M.sections("# A\n## B\ntext\n", 4)
    assert (first["body"], first["end_line"], heading["body"], heading["anchor"]) == ("# A", 5, "## B\ntext", "A#B")
    assert M.missing_roles("# Overview\n## Detail\ntext")[0] == "task"


def test_roles_drafts_regions():
    assert M.missing_roles("# 1. Overview\nx\n<summary>Task</summary>\n# 评估\ny") == ["challenges", "solutions", "conclusions", "evidence"]
    blocks = M.draft_blocks("x <!-- KOS:refs=b, a --> one <!--KOS:refs=c--> two")
    assert blocks == [{"refs": ["a", "b"], "text": "one"}, {"refs": ["c"], "text": "two"}]
    text = "x<!-- KOS:managed:r:start -->in<!-- KOS:managed:r:end -->y"
    a, b = M.region_span(text, "r")
    assert text[a:b] == "in"
    for bad in ("", text + text, text.replace("in", "<!-- KOS:managed:q:start -->"), "<!-- KOS:managed:q:start -->" + text):
        with pytest.raises(ValueError):
            M.region_span(bad, "r")


def test_vault(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "Home.md").write_text("---\ntype: project\naliases: [H]\nparents: ['[[Root]]']\nsource_refs: [`paper:x`。]\n---\n# T\nsee [[Other#T]] and repo://r@1/a.py, ok\n")
    (tmp_path / "Other.md").write_text("# T\ntext\n")
    notes = vault.notes(vault.markdown_files(spark, str(tmp_path)), str(tmp_path)).cache()
    assert sorted(r.id for r in notes.collect()) == ["Other", "p/Home"]
    links = {(r.kind, r.note, r.anchor, r.line) for r in vault.links(notes).collect()}
    assert links == {("wikilink", "Other", "T", 8), ("parents", "Root", None, None)}
    assert {r.name for r in vault.note_names(notes).where("id = 'p/Home'").collect()} >= {"p/Home", "Home", "Home.md", "H"}
    assert {(r.ref, r.inline) for r in vault.note_source_refs(notes).collect()} == {("paper:x", False), ("repo://r@1/a.py", True)}
    assert vault.sections(notes).where("id = 'Other'").count() == 1


def test_registry_and_records(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("repos:\n  - id: source:a\n    path: x/y\n    head: abc\n  - rank: 1\n    source_id: b\n    code_local_path: z\npapers:\n  - id: c\n    local_path: 'q'\n")
    rows = {r.source_id: (r.kind, r.path, r.revision) for r in vault.registry(spark, str(tmp_path / "r.yaml")).collect()}
    assert rows == {"a": ("repos", "x/y", "abc"), "b": ("repos", "z", None), "c": ("papers", "q", None)}
    (tmp_path / "f.jsonl").write_text('{"id": "1"}\n\n[1]\n{"id": \n{"id": "2"}\n')
    from pyspark.sql.types import StringType, StructField, StructType

    good, bad = vault.jsonl(spark, str(tmp_path / "f.jsonl"), StructType([StructField("id", StringType())]))
    assert [(r.line_no, r.id) for r in good.collect()] == [(1, "1"), (5, "2")]
    assert [r.line_no for r in bad.collect()] == [3, 4]
    assert vault.config_value("a: 1\nvector: 'on'\n", "vector") == "on" and vault.flag("on") and not vault.flag(None)


def test_workers_take_bounded_stretches_of_a_batch(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    from vellumspark.functions.batches import arrow_rows_udf, cuts

    texts = pa.array([None, "x" * 50, "", "é" * 10, "y" * 9, "z"])
    found = cuts([texts, pa.array(range(6))], rows=4, size=40)
    assert [k for a, n in found for k in range(a, a + n)] == list(range(6)) and len(found) > 2
    assert cuts([pa.array([], pa.string())]) == []
    whole = arrow_rows_udf(T.LongType(), lambda text, k: len(text) + k, 2)
    many = spark.range(0, 5_000, 1, 1).selectExpr("id", "repeat('ab', cast(id % 900 as int)) AS t").select("id", whole("t", "id").alias("n"))
    assert many.where("n <> id + 2 * (id % 900)").count() == 0 and many.count() == 5_000
