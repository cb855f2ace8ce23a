from __future__ import annotations

from collections import Counter

import corpus_pipeline
from edge import documents, odd_texts, prose
from test_native import lines_left
from test_pairs import classes

from tidewire.llm.quality import quality_rules


def test_stages_take_effect(spark):
    texts = odd_texts() + [(1000 + i, prose(i, 80)) for i in range(40)] + [(2000 + i, prose(i, 80) + " one") for i in range(5)]
    docs = documents(spark, texts)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "lines", "near_duplicates", "secrets", "packing"]
    good = stage["quality"](spark, docs, "")
    kept = Counter(r["doc_id"] for r in quality_rules(docs).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in good.collect()) == kept
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    cut = stage["lines"](spark, good, "")
    want = lines_left(rows)
    left = [(i, want[i, t or ""][2] if want[i, t or ""][1] else t) for i, t in rows if want[i, t or ""][1] < want[i, t or ""][0]]
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr) == sorted(left, key=repr)
    one = stage["near_duplicates"](spark, cut, "")
    firsts = {(i, c) for i, c, _ in classes(left) if i == c}
    assert {r["doc_id"] for r in one.collect()} == {i for i, _ in firsts}
    safe = stage["secrets"](spark, one, "")
    assert safe.columns == docs.columns and safe.count() == one.count()
    packed = stage["packing"](spark, safe, "")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in safe.collect()}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_run_on_odd_and_long_texts(spark, tmp_path):
    """All stages in a row over nulls, repeated rows, clashing columns and texts of over a megabyte."""
    from test_tokens import JSON, check_packing
    from tokenizers import Tokenizer

    long = "\n".join(prose(s, 40) for s in range(6000))
    texts = [*odd_texts(), (5000, long), (5001, long + "\nand a tail"), (5002, prose(77, 80) + " AKIA" + "Q7" * 12), *((6000 + i, prose(900 + i, 70)) for i in range(30))]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {i for i, _ in left} >= {5000, 5002, 6000} and dict(left)[5000] == long and dict(left)[5001] == "and a tail"
    assert "AKIAQ7" not in dict(left)[5002] and "[access]" in dict(left)[5002]
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    check_packing(rows, [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in left], 2048)
