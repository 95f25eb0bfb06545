import hashlib

import pytest
from pyspark.sql import functions as F

from siftstone.functions import text
from siftstone.operators import chunking
from siftstone.operators.chunking import Budget

DOC = """# Guide
intro line one
intro line two

第一章 总则
第3条：内容
（一）小节

1.2 Numbers
- first
- second
after the list

a | b
c | d

Step 1: do
more of it
Step 2: done"""


def parsed(spark, *texts, levels=chunking.LEVELS):
    df = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "doc_id string, text string")
    return chunking.parse(df, levels).orderBy("doc_id", "number")


def test_structure_of_lines(spark):
    got = [(r.node_type, r.level, r.text.split("\n")[0], r.heading) for r in parsed(spark, DOC).collect()]
    assert got == [
        ("heading", 1, "# Guide", "Guide"), ("paragraph", 2, "intro line one", ""), ("heading", 1, "第一章 总则", "第一章 总则"), ("heading", 1, "第3条：内容", "第3条：内容"),
        ("clause", 3, "（一）小节", "（一）小节"), ("heading", 2, "1.2 Numbers", "1.2 Numbers"), ("list_item", 2, "- first", ""), ("paragraph", 2, "after the list", ""),
        ("table", 2, "a | b", ""), ("step", 2, "Step 1: do", ""), ("step", 2, "Step 2: done", ""),
    ]


def test_levels_can_be_switched_off(spark):
    kinds = {r.node_type for r in parsed(spark, DOC, levels=("paragraph",)).collect()}
    assert kinds == {"paragraph"}


def chunks(spark, text, **budget):
    docs = spark.createDataFrame([("d", text, "news")], "doc_id string, text string, business_type string")
    b = Budget(**{"overlap_tokens": 0, **budget})
    return chunking.chunk(chunking.parse(docs), docs, b, "v1").orderBy("number")


def test_tree_ids_and_trails(spark):
    rows = chunks(spark, "# A\npara a\n## B\npara b\n### C\npara c\n## D\npara d\n# E\npara e").collect()
    of = {r.text: r for r in rows}
    assert of["# A"].chunk_id == hashlib.sha1(b"d:1:1").hexdigest()[:16]
    parent = {t: next((s for s, o in of.items() if o.chunk_id == r.parent_id), None) for t, r in of.items()}
    assert parent == {"# A": None, "para a": "# A", "## B": "# A", "para b": "## B", "### C": "## B", "para c": "### C", "## D": "# A", "para d": "## D", "# E": None, "para e": "# E"}
    assert of["para c"].heading_path == ["A", "B", "C"] and of["para c"].context_text == "A > B > C\npara c"
    assert of["para e"].heading_path == ["E"] and of["## D"].position == 2 and len({r.chunk_id for r in rows}) == len(rows)
    assert (of["## D"].char_start, of["## D"].char_end) == (len("para a") + 1 + len("## B") + 1, len("para a") + 1 + len("## B") + 1 + len("## D"))


def test_guardrail_voids_offsets(spark):
    r = chunks(spark, "x" * 2000).first()
    assert len(r.text) == 3 * 320 and r.lc_group_id is None and r.char_start is None


def test_overlap_cascades(spark):
    rows = chunks(spark, "# H\n\n" + "\n\n".join(c * 9 for c in "abc"), overlap_tokens=2).collect()
    assert [r.text for r in rows[1:]] == ["aaaaaaaaa", "aaaaaa\nbbbbbbbbb", "bbbbbb\nccccccccc"] and rows[2].char_start is None and rows[1].char_start == 0


def test_sentences_and_packing(spark):
    text = "One is here. Two! 三。\n\nLast part"
    df = spark.createDataFrame([(text,), ("",)], "t string")
    rows = df.select(chunking.sentences(F.col("t")).alias("s")).collect()
    assert [s.text for s in rows[0].s] == ["One is here.", "Two!", "三。", "Last part"] and rows[1].s == []
    assert all(text[s.start : s.end] == s.text for s in rows[0].s)
    pieces = df.select(chunking.packed(F.col("t"), 6, least=1).alias("p")).first().p
    assert [text[p.start : p.end] for p in pieces] == ["One is here. Two!", "三。\n\nLast part"]


def test_semantic_split_ids(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    b = Budget(max_tokens=200, overlap_tokens=0, context_tokens=0, semantic=True, min_trigger_tokens=50)
    whole = chunking.chunk(chunking.parse(docs), docs, Budget(max_tokens=2000, overlap_tokens=0, context_tokens=0, semantic=True, min_trigger_tokens=50))
    rows = chunking.semantic_split(whole, b).orderBy("position").collect()
    parent = whole.first()
    assert len(rows) > 1 and all(r.parent_id == parent.chunk_id and r.hierarchy_level == 3 and not r.needs_semantic_split for r in rows)
    assert rows[0].chunk_id == hashlib.sha1(f"{parent.chunk_id}:sub:0".encode()).hexdigest()[:16]
    assert all(parent.text[r.char_start : r.char_end] == r.text and r.token_count <= 200 for r in rows)


def test_long_nodes_keep_their_whole_text(spark):
    long = " ".join(f"Sentence number {i} has some words in it." for i in range(400)) + " " + "x" * 5000 + "漢" * 700 + "ab c" * 300 + ". The end."
    docs = spark.createDataFrame([("d", f"# H\n\n{long}\n\nshort"), ("e", "y " * 20_000)], "doc_id string, text string")
    for semantic in (True, False):
        b = Budget(overlap_tokens=0, semantic=semantic, whole_nodes=True)
        rows = chunking.semantic_split(chunking.chunk(chunking.parse(docs), docs, b), b).collect()
        for doc, text in (("d", long), ("e", ("y " * 20_000).strip())):
            parts = sorted((r.position, r.char_start, r.char_end, r.text) for r in rows if r.doc_id == doc and (r.lc_group_id or "").startswith("sem:"))
            assert "".join("".join(p[3] for p in parts).split()) == "".join(text.split()) and all(text[a:z] == t for _, a, z, t in parts)
        assert {"# H", "short"} <= {r.text for r in rows} and max(chunking._tokens(r.text) for r in rows) == 320 and max(r.token_count for r in rows) <= 400


def test_late_chunks_pool_and_fall_back(spark):
    def provider(texts):
        return [([(i, i + 1) for i in range(len(t))], [[float(ord(c)), 0.0] for c in t]) for t in texts]

    c = spark.createDataFrame([("a", "g", 0, "xx", "xx", 0, 2), ("b", "g", 1, "yy", "yy", 3, 5), ("c", None, 0, "zz", "zz", None, None)], "chunk_id string, lc_group_id string, position int, text string, context_text string, char_start int, char_end int")
    rows = {r.chunk_id: r for r in chunking.late_chunk_vectors(c, provider, 2, 100).collect()}
    assert not rows["a"].fallback and not rows["b"].fallback and rows["c"].fallback and rows["a"].vector == [1.0, 0.0]


@pytest.mark.parametrize("text", ["", " \n\t", None])
def test_blank_documents_give_no_chunks(spark, text):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert chunking.parse(docs.where(F.length(F.trim("text")) > 0)).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_a_split_reads_its_chunks_once(spark, whole):
    b = Budget(max_tokens=130, overlap_tokens=0, semantic=True, min_trigger_tokens=20, whole_nodes=whole)
    body = "A short one.\n\n" + "One sentence. " * 40 + "\n\n" + "é中 word! " * 60
    docs = spark.createDataFrame([("d", body)], "doc_id string, text string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    chunks = chunking.chunk(chunking.parse(docs), docs, b)
    rows = chunking.semantic_split(chunks.mapInArrow(counted, chunks.schema), b).collect()
    assert seen.value == 3 and len({r.chunk_id for r in rows}) == len(rows) > 3
    assert not any(r.needs_semantic_split for r in rows) and "A short one." in {r.text for r in rows}


def test_ends_of_texts_lose_white_space_of_any_kind(spark):
    odd = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["﻿", "᠎", "\U0001d7ce"]
    df = spark.createDataFrame([(c, f"{c}{c}a{c}b{c}{c}") for c in odd], "c string, t string")
    old = F.regexp_replace(F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")
    assert df.where(text.strip(F.col("t")) != old).count() == 0
    gone = F.length(F.regexp_replace("c", r"(?U)[\s\x1c-\x1f]+", "")) == 0
    assert df.where(text.is_blank(F.col("c")) != gone).count() == 0
