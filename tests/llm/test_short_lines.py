import corpus_pipeline
from tests.llm.helpers import docs
from tideline.llm import substring_dedup


def test_short_lines_and_scripts_without_spaces(spark):
    texts = [
        "All rights reserved.\nThe first text goes on with words of its own here.",
        "Another text stands before the same short line in this one.\nall rights reserved",
        "All rights reserved.\nYet other words follow it in the third of these texts.",
        "一行很短。",
        "一行很短。",
        "前面的话不同。这一句话在两个文本里面都是一样的没有空格。",
        "这里说的是别的。这一句话在两个文本里面都是一样的没有空格。后面也不同。",
        "A paragraph that is\nwrapped in one way",
        "A paragraph\nthat is wrapped in\none way",
        "---\na",
        "...\nb",
        "---\nc",
        "... Eight words are in this very line here.",
    ]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(docs(spark, texts)).collect()}
    want = dict(enumerate(texts))
    want |= {1: texts[1].split("\n")[0] + "\n", 2: texts[2].split("\n")[1], 4: "", 6: "这里说的是别的。后面也不同。", 8: "", 11: "c"}
    assert got == want


def test_every_whole_line_is_a_unit():
    t = "short\nanother short line. with two\n\nlast"
    assert {"short", "another short line. with two", "last"} <= {x for _, _, x in substring_dedup.units_of(t, "sentence", 8)}
    assert [x for _, _, x in substring_dedup.units_of("a b\nc", "line", 8)] == ["a b", "c"]


def test_texts_are_cut_once_whatever_is_filtered(spark):
    """A filter on the kept text took a second Python worker in every task, which cut the texts again."""
    same = "These are eight or more words of one line."
    d = docs(spark, [same, same, f"{same}\nOther words.", None, "", f"{same} {same}"], [0, 1, 2, 3, None, 5])
    done = substring_dedup.dedup(d).where("text is null or trim(text) != ''")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: (r.text, len(r.removed)) for r in done.collect()} == {0: (same, 0), 2: ("Other words.", 1), 3: (None, 0)}
    stage = corpus_pipeline.substrings(spark, d, "")
    assert stage._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in stage.collect()} == {0: same, 2: "Other words.", 3: None, None: ""}
